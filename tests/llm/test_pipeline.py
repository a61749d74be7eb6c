"""The pipeline's stages on small tables: columns, effect, and the whole run."""

from collections import Counter

import corpus_pipeline
from basalt.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in docs.collect())
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        after = Counter(r.doc_id for r in docs.collect())
        seen[name] = (before, after)
        assert set(after) <= set(before)
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
    for name in ("toxicity", "near_dedup", "decontamination"):
        assert seen[name][1] <= seen[name][0] and 0 < seen[name][1].total() < seen[name][0].total()
    assert seen["sharding"][0] == seen["sharding"][1]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
