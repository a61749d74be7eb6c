"""The ten operators against brute force, and their defined answers for odd input."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import ann, common, decontaminate, hilbert, license_scan, line_dedup, minhash, mixing, pii, quality, setjoin, toxicity
from basalt.llm import components as components_
from basalt.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(-1, None, None, None), (-2, "", "src0", "en"), (-3, "x", None, "en"), (-4, "x", "src0", None), (-4, "x", "src0", None), (None, "null id", "src1", "en"), (-5, "Ünï \U0001f600 cödé " * 3, "src1", "xx"), (-6, "long " * 30000, "src2", "en"), (-7, "\n\n \n", "src0", "en")]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, source string, lang string, n_chars long")
    # Columns whose names clash with names the operators use inside.
    return plain.unionByName(odd).withColumns({"shard": F.lit(1), "h": F.lit("x"), "c": F.lit(None).cast("int"), "size": F.lit(2)}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)


def shingles(t):
    w = WORD.findall(ascii_lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent):
    sets, ids = [shingles(t) for _, t, _ in rows], [i for i, _, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            inverted[g].append(n)
    shared = Counter(p for same in inverted.values() for p in itertools.combinations(same, 2))
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            parent[root(b)] = root(a)
    low = defaultdict(list)
    for n in range(len(rows)):
        low[root(n)].append(ids[n])
    least = {r: min((i for i in v if i is not None), default=None) for r, v in low.items()}
    return Counter((ids[n], len(sets[n]), least[root(n)] if sets[n] else ids[n]) for n in range(len(rows)))


@pytest.mark.parametrize("limit", [2, 32])
def test_near_duplicates(docs, rows, limit, monkeypatch):
    monkeypatch.setattr(minhash, "LIST", limit)
    monkeypatch.setattr(setjoin, "LIST", limit)
    monkeypatch.setattr(setjoin, "PAIRS", 16 if limit == 2 else setjoin.PAIRS)
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_pivots_find_members_between(spark, monkeypatch):
    """A far copy is linked with a member of a long list that the pivot does not link it with."""
    monkeypatch.setattr(minhash, "LIST", 3)
    monkeypatch.setattr(setjoin, "LIST", 3)
    monkeypatch.setattr(setjoin, "PAIRS", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [list(base)]
    for step in range(40):  # a chain of growing edits, and independent copies
        t = list(texts[-1] if step % 2 else base)
        for at in rng.sample(range(200), 2 if step % 2 else rng.choice([1, 3, 8])):
            t[at] = f"e{step}_{at}"
        texts.append(t)
    made = [(i, " ".join(t), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()) == components(made, 85)


def test_crowd_pairs_of_differences_are_similar(spark, monkeypatch):
    """A long list hands on similar pairs only, however many share a difference, and loses no link."""
    monkeypatch.setattr(setjoin, "LIST", 1)
    rng = random.Random(11)
    sets = [set(range(200))] + [set(range(200)) - set(rng.sample(range(200), rng.choice([5, 15, 30, 45]))) for _ in range(80)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, toks array<long>")
    similar = {(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2) if 100 * len(x & y) >= 80 * len(x | y)}
    got = {(r.a, r.b) for r in setjoin.crowd_pairs(df, 80).collect()}
    assert got <= similar
    of = lambda pairs: {r.node: r.root for r in connected_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert of(got) == of(similar)


def _exchanges(module, monkeypatch):
    """Counts of the exchanges by a key in each table that ``module`` writes, filled in as it writes them."""
    seen, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")), write(df))[1])
    return seen


def test_crowd_pairs_of_few_tokens_need_no_exchange(spark, monkeypatch):
    """Rounds over few rows would cost a task per shuffle partition and exchange; the pairs are those of the long way."""
    monkeypatch.setattr(setjoin, "LIST", 2)
    monkeypatch.setattr(setjoin, "PAIRS", 60)
    rng = random.Random(12)
    sets = [set(range(200))] + [set(range(200)) - set(rng.sample(range(200), rng.choice([5, 15, 30, 45]))) for _ in range(30)]
    df = common.materialize(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, toks array<long>"))
    seen = _exchanges(setjoin, monkeypatch)
    got = {(r.a, r.b) for r in setjoin.crowd_pairs(df, 80).collect()}
    assert len(seen) > 12 and not any(seen[:-1])  # at last all pairs are put together
    for limits in ({"FEW_PAIRS": -1}, {"ONE_TASK": -1}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(setjoin, k, v)
            if "ONE_TASK" in limits:
                m.setattr(common, "ONE_TASK", -1)
            seen.clear()
            assert got == {(r.a, r.b) for r in setjoin.crowd_pairs(df, 80).collect()}
            assert any(seen[:-1])


def test_small_rounds_of_a_large_crowd_need_no_exchange(spark, monkeypatch):
    """Rounds over few sets stay in one task however large the join began, and give the same pairs."""
    monkeypatch.setattr(setjoin, "LIST", 2)
    monkeypatch.setattr(setjoin, "PAIRS", 60)
    rng = random.Random(13)
    sets = [set(range(200))] + [set(range(200)) - set(rng.sample(range(200), rng.choice([5, 15, 30, 45]))) for _ in range(30)]
    df = common.materialize(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, toks array<long>"))
    want = {(r.a, r.b) for r in setjoin.crowd_pairs(df, 80).collect()}
    monkeypatch.setattr(setjoin, "ONE_TASK", 1000)  # the sets have more tokens together
    seen = _exchanges(setjoin, monkeypatch)
    assert want == {(r.a, r.b) for r in setjoin.crowd_pairs(df, 80).collect()}
    assert len(seen) > 12 and not any(seen[:-1])


def test_connected_components_of_few_edges_need_no_exchange(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)], "a long, b long")
    seen = _exchanges(components_, monkeypatch)
    got = sorted(connected_components(edges).collect())
    assert len(seen) > 2 and not any(seen[1:])  # the edges as they come are put together first
    monkeypatch.setattr(common, "ONE_TASK", -1)
    assert got == sorted(connected_components(edges).collect())
    assert seen[-1] > 0


def test_drop_near_duplicates_keeps_one_of_each_group(docs, rows):
    kept = minhash.drop_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    want = Counter({i for i, _, low in components(rows, 80) if i == low})
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_near_duplicates_join_few_groups_without_exchange(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 40 * 100 + j}" for j in range(30))) for i in range(120)], "doc_id long, text string").repartition(2).cache()
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = minhash.near_duplicates(docs)
        # A file for each task that wrote; an exchange before would have made twelve.
        assert len(found.inputFiles()) <= 2
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 40 for i in range(120)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_beyond_a_broadcast_are_sieved_before_the_shuffle(spark, monkeypatch):
    """A join with more keys than may be broadcast shuffles few of the rows that have no partner, and is exact."""
    df = spark.createDataFrame([(i if i % 7 else None, f"t{i % 50}") for i in range(3000)], "k long, text string")
    wanted = spark.createDataFrame([(i, f"t{i % 50}") for i in range(1, 3000, 60)] + [(None, "t0")], "a long, b string")
    pairs = {(r.a, r.b) for r in wanted.collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for anti in (False, True):
        got = common.matched(df, [df["k"], df["text"]], wanted, ["a", "b"], len(pairs), anti)
        assert got.columns == df.columns
        assert Counter(map(tuple, got.collect())) == Counter(x for x in map(tuple, df.collect()) if (x in pairs) != anti)
    maybe, other = common.sieved(df, [df["k"], df["text"]], wanted, ["a", "b"])
    assert maybe.count() + other.count() == 3000 and maybe.count() < 150


def test_drop_near_duplicates_shuffles_no_text_that_stays(docs, rows, monkeypatch):
    """With more rows to drop than may be broadcast, those that surely stay pass by the shuffle; rows without an id are linked too."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    kept = minhash.drop_near_duplicates(docs, 80)
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i for i, _, low in components(rows, 80) if i == low})
    words = [f"w{j}" for j in range(60)]
    made = docs.sparkSession.createDataFrame([(5, " ".join(words)), (None, " ".join(words[:59]))], "doc_id long, text string")
    for limit in (0, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        assert [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(made).orderBy("doc_id").collect()] == [(None, 5, False), (5, 5, True)]


def test_match_threshold_is_safe():
    for percent in (80, 85, 95):
        t, p = minhash.match_threshold(percent), percent / 100
        tail = sum(math.comb(minhash.COORDS, k) * p**k * (1 - p) ** (minhash.COORDS - k) for k in range(t))
        assert tail <= minhash.MISS


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_line_dedup_posts_no_common_tokens_among_many_rare_ones(spark, monkeypatch):
    """A phrase of five lines is told from single ones, however many of these share its bucket."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 64)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1, raising=False)
    made = [(i, " ".join([f"p{i // 5}a p{i // 5}b p{i // 5}c p{i // 5}d p{i // 5}e", *(f"w{i}x{j}" for j in range(100))])) for i in range(150)]
    lines = line_dedup._occurrences(spark.createDataFrame(made, "doc_id long, text string"))
    assert line_dedup._postings(lines.where("lk IS NOT NULL")).count() == 0


def test_line_dedup_sends_one_row_to_the_driver(spark, monkeypatch):
    """The counts by bucket reach the driver as one text, and are right."""
    monkeypatch.setattr(line_dedup, "SAMPLE", 1, raising=False)
    monkeypatch.setattr(line_dedup, "BUCKETS", 8)
    lines = spark.createDataFrame([(i, 0, [3, 8 + i % 2, 100 + 8 * i]) for i in range(6)], "th long, ln int, toks array<int>")
    fetched, collect = [], type(lines).collect

    def watched(df):
        fetched.append(collect(df))
        return fetched[-1]

    with monkeypatch.context() as m:
        m.setattr(type(lines), "collect", watched)
        counts = line_dedup._rarity(lines)
    assert sum(map(len, fetched)) <= 1
    assert spark.range(1).select(counts).first()[0] == [3, 3, 0, 6, 0, 0, 0, 0]


@pytest.mark.parametrize("rows", [0, 100])
def test_line_dedup_shuffles_sets_of_paired_lines_only(spark, monkeypatch, rows):
    """Sets of lines without a partner are dropped before the shuffle, by a broadcast or by the sieve."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    text = " ".join(f"w{i}" for i in range(30))
    made = [(0, text), (1, text + " more"), *((i, " ".join(f"u{i}x{j}" for j in range(9))) for i in range(2, 60))]
    left, matched = [], common.matched

    def watched(*args, **kw):
        out = matched(*args, **kw)
        left.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "matched", watched, raising=False)
    got = {r.doc_id: r.removed for r in line_dedup.duplicate_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert left == [2]
    assert got == {i: [0] if i == 1 else [] for i in range(60)}


@pytest.mark.parametrize("limit,dealt", [(2, 4096), (32, 4096), (2, 1), (32, 1)])
def test_line_dedup_gathers_lists_where_they_meet(spark, monkeypatch, limit, dealt):
    """A short list is one row, a long one a row for each line, whether or not its token is dealt; equal lines count once."""
    monkeypatch.setattr(setjoin, "LIST", limit)
    monkeypatch.setattr(line_dedup, "DEALT", dealt)
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    made = [(i, " ".join([*(f"w{j}" for j in range(12)), f"x{i % 3}"])) for i in range(6)]  # three lines, each twice, that post one token of theirs and a common one
    lists = line_dedup._postings(line_dedup._occurrences(spark.createDataFrame(made, "doc_id long, text string"))).collect()
    assert [r.f for r in lists] == ([3] if limit > 3 else [3, 3, 3])
    assert len({m.id for r in lists for m in r.members}) == sum(len(r.members) for r in lists) == 3
    assert {m.n for r in lists for m in r.members} == {9}


def test_matched_leaves_given_keys_as_they_are(spark, monkeypatch):
    """Keys that cannot be null are joined by the column itself, so a grouping by it needs no other exchange."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    got = common.matched(df, [df["id"]], spark.range(0, 50, 5).withColumnRenamed("id", "end"), ["end"], 10).groupBy("id").agg(F.first("v").alias("v"))
    assert "isnull(id" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(0, 50, 5)]


@pytest.mark.parametrize("limit", [2, 32])
def test_line_dedup(docs, rows, limit, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST", limit)
    seen, lines, want = defaultdict(list), [], {}
    distinct = {(i, t or "") for i, t, _ in rows}
    order = {(r.doc_id, r.text or ""): r.th for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    for i, t in sorted(distinct, key=lambda d: (d[0] is not None, d[0] or 0, order[d])):
        gone = []
        for n, line in enumerate(t.split("\n")):
            s = shingles(line.lower())
            near = Counter(x for g in s for x in seen[g])
            if any(5 * k >= 4 * (len(s) + len(lines[x]) - k) for x, k in near.items()):
                gone.append(n)
            for g in s:
                seen[g].append(len(lines))
            lines.append(s)
        want[i, order[i, t]] = (len(t.split("\n")), gone)
    got = {(r.doc_id, r.th): (r.n_lines, r.removed) for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == want
    clean = line_dedup.drop_duplicate_lines(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = dict(zip(names, itertools.cycle((3, 1, 2))))
    open_, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(2 * sizes[s], weight[s] * rate)
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        by_target[round(r.target, 6)][0] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in names:
        by_target[round(target[s], 6)][1] += target[s]
    largest = max(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(abs(taken - aim) <= largest * len(names) / 2 for taken, aim in by_target.values())
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}


def test_mix_documents_repeats_rows(docs):
    taken = Counter()
    for r in mixing.mix_sources(docs).where("size > 0").collect():
        taken[r.doc_id] += r.taken // r.size
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    have = Counter(r.doc_id for r in mixed.where(r"text rlike '[^\\x20\\x09-\\x0D]'").collect())
    assert have == +taken


def test_hilbert_shards(docs, rows):
    got = hilbert.hilbert_shards(docs, 40, ["source", "lang", "n_chars"]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    keys = sorted((r.shard, r.slot, r.curve) for r in got)
    assert [k[2] for k in keys] == sorted(k[2] for k in keys)
    named = hilbert.sharded_documents(docs, 40, ["source", "lang", "n_chars"])
    assert named.columns == [*docs.columns, "shard_", "slot"] and named.count() == len(rows)


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (2, 3)])
def test_hilbert_curve_steps_to_neighbours(spark, bits, dims):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"x{i}" for i in range(dims)]
    got = sorted(hilbert.hilbert_index(spark.createDataFrame(cells, names), names, bits, "i").collect(), key=lambda r: r.i)
    assert [r.i for r in got] == list(range(len(cells)))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(got, got[1:]))


def test_pii(docs, rows):
    def base(t):
        found = [(m.start(), 0, m.end(), "email") for m in pii.EMAIL.finditer(t)]
        found += [(m.start(), 1, m.end(), "ip") for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end(), "card") for m in pii.CARD.finditer(t) if 14 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
        found += [(m.start(), 3, m.end(), "phone") for m in pii.PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    got = pii.pii_digest(docs).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((i, hashlib.sha256(base(t or "").encode()).hexdigest()) for i, t, _ in rows)


def test_pii_checks_and_context():
    text = "é card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, bad 4111 1111 1111 1112, a@b.co +44 20 7946 0958 1.2.3.4 999.1.1.1"
    kinds = [(k, text[a:b]) for a, b, k, _ in pii.find_spans(text)]
    assert kinds == [("card", "4111 1111 1111 1111"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("email", "a@b.co"), ("phone", "+44 20 7946 0958 1.2.3.4 999.1.1.1")][: len(kinds)] or ("ip", "1.2.3.4") in kinds
    near = dict((k, s) for _, _, k, s in pii.find_spans("credit card 4111111111111111"))
    far = dict((k, s) for _, _, k, s in pii.find_spans("order 4111111111111111"))
    assert near["card"] > far["card"]
    assert pii.redact("mail a@b.co now") == "mail [email] now"


def test_pii_ibans_before_capitals_and_digits(spark):
    gb, de, no, xx = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947", "ZZ70 1111 2222 3333 44"
    assert pii.mod97(xx.replace(" ", ""))
    texts = {f"{gb} BIC NWBKGB2L": [gb], f"IBAN {gb} 100 EUR": [gb], f"{gb} {de} {no} {gb}": [gb, de, no, gb], f"REF AB12 3456 {gb} X": [gb], f"{xx} NEXT 77": [xx], f"{de} {de}X": [de], f"{gb}BIC": [], "GB82 WEST 1234 5698 7654 33 BIC": [], f"{gb}. {de}": [gb, de], gb: [gb]}
    for text, want in texts.items():
        assert [text[a:b] for a, b, k, _ in pii.find_spans(text) if k == "iban"] == want, text
    assert pii.redact(f"pay {no} NOW") == "pay [iban] NOW"
    df = spark.createDataFrame([(1, f"{gb} BIC NWBKGB2L")], "doc_id long, text string")
    assert [s.value for s in pii.scan_pii(df).collect()[0].found if s.kind == "iban"] == [gb]


def test_license_scan(docs, spark):
    extra = [(-20, "MIT License, the gnu General public license; apache license x mit license"), (-21, "general public general public license"), (-22, "é\x7fmit license"), (-23, "Licensed under the Apache License, Version 2.0 (the License); you may not use this old file except in compliance with the License")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def base(t):
        w = word.findall(ascii_lower(t))
        hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [h[0] for h in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({h[1] for h in hits}))

    got = license_scan.license_digest(both).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r.doc_id, *base(r.text)) for r in both.collect())
    labels = {r.doc_id: r.labels for r in got}
    assert "apache-2.0" in labels[-23]  # one word more than the template
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_scan_splits_columns_of_notices(spark):
    rights, apache = "All rights reserved. ", next(p for p in license_scan.NOTICES if len(p.split()) > 15)
    texts = [rights, rights * 2, "Copyright. " + rights * 50 + "End.", "all rights are rights reserved " * 20, rights + "all rights are rights reserved " + rights, "all rights " * 40, (apache + " ") * 3, "license x " * 30 + (apache + " ") + "rights reserved " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3], texts[5]])] + [(0, texts[0])], "doc_id long, text string")
    rows = license_scan.scan_licenses(df).collect()
    assert len(rows) == len(texts) + 3
    found = {r.doc_id: [(s.label, s.first, s.last, s.cover) for s in r.found if not s.exact] for r in rows}
    spans = lambda i, label: [s[1:] for s in found[i] if s[0] == label]
    assert spans(0, "proprietary") == [(0, 2, 1.0)]
    assert spans(1, "proprietary") == [(0, 2, 1.0), (3, 5, 1.0)]
    assert spans(2, "proprietary") == [(1 + 3 * i, 3 + 3 * i, 1.0) for i in range(50)]
    edited = spans(3, "proprietary")
    assert {n for a, b, _ in edited for n in range(a, b + 1)} == set(range(100)) and all(b - a <= 4 and c == 1 for a, b, c in edited)
    assert spans(4, "proprietary") == [(0, 2, 1.0), (3, 7, 1.0), (8, 10, 1.0)]
    assert found[5] == [] and found[8] == found[3] and found[9] == []
    n = len(apache.split())
    assert [s[:2] for s in spans(6, "apache-2.0") if s[1] - s[0] == n - 1] == [(0, n - 1), (n, 2 * n - 1), (2 * n, 3 * n - 1)]
    assert (60, 60 + n - 1, 1.0) in spans(7, "apache-2.0")
    labels = {r.doc_id: r.labels for r in license_scan.license_digest(df).collect()}
    assert all("proprietary" in labels[i] for i in range(5)) and labels[5] == ""


def test_decontamination(docs, spark):
    rng, items = random.Random(2), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted, want = [], set()
    for n, (item, text) in enumerate(items):
        t = list(decontaminate.normal(text))
        for _ in range(rng.randint(0, decontaminate.budget(len(t)))):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice("xyz")
        planted.append((1000 + n, "some words before " + "".join(t).upper() + "\nand after"))
        want.add((1000 + n, item))
    clean = docs.select("doc_id", "text").where("doc_id < 0 OR doc_id IS NULL")
    both = clean.union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (None, "x"), (99999, None), (99998, "  ")], "item_id long, text string")
    found = decontaminate.find_contamination(both, bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    assert {r.doc_id for r in found} == {d for d, _ in want}
    left = decontaminate.drop_contaminated(both, bench)
    assert left.columns == both.columns and left.count() == clean.count()


def test_decontamination_finds_excerpts_of_long_items(spark):
    rng = random.Random(8)
    for size in (61, 75, 90, 200):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(size)]
        matcher = decontaminate.Matcher([(7, " ".join(words))])
        for length in (50, 55, 60):
            for at in range(size - length + 1):
                text = "some words before " + " ".join(words[at : at + length]) + " and after"
                assert [r[0] for r in matcher.find(text)] == [7], (size, length, at)
    docs = spark.createDataFrame([(1, "x " + " ".join(words[20:70]) + " y"), (2, "x " + " ".join(words[15:75])), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()} == {(1, 7), (2, 7)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (20, 40))
        col = list(range(len(p) + 1))
        last = []
        for c in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (p[i - 1] != c)))
            col = new
            last.append(col[-1])
        k = rng.randint(0, len(p) - 1)
        best = min(last)
        assert decontaminate.myers(decontaminate.masks(p), len(p), t, k) == ((best, last.index(best) + 1) if best <= k else None)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 16)).repeat(30, 0) + rng.normal(size=(600, 16)) * 0.4
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a hot vector
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (None, [1.0] * 16), (5, rows[5][1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("radius", [None, 2, 16])
def test_nearest(blobs, radius):
    rows, df = blobs
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, radius=radius).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (m[1], m[0]))
        hit += len({ids[j] for j in order} & {m[1] for m in mine})
        total += 10
        if radius == 16:
            assert [m[1] for m in mine] == [ids[j] for j in order]
    assert set(got) == set(ids[ids % 20 == 0]) and hit / total >= (0.9 if radius != 2 else 0.5)


def test_substring_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    index = ann.SubstringIndex(codes)
    for radius in (0, 9, 15, 24):
        for masks in (None, ann.SubstringIndex.masks(radius // 4)):
            got = index.within(codes[7] ^ np.uint16(3), radius, masks)
            assert got.tolist() == np.flatnonzero(ann.hamming(codes, codes[7] ^ np.uint16(3)) <= radius).tolist()


def _auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_models_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for digest, label, floor in ((toxicity.toxicity_digest, "toxic", 0.9), (quality.quality_digest, "quality", 0.95)):
        t = digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert _auc(t.score.values, t[label].values) >= floor
        assert (t.predicted == t[label]).mean() >= 0.93


def test_models_on_odd_input(docs, rows, no_docs, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(100)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(docs, labels).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows) and all(0 <= r.score <= 1 for r in got)
        assert score(no_docs, labels).count() == 0
        assert score(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_chain_is_trained_outside_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    learn, driver, train = common.remainder(F.col("doc_id"), 5) != 0, os.getpid(), toxicity.train_chain
    want = train(common.labelled_sample(docs, labels, "toxic", learn, toxicity.SAMPLE))

    def elsewhere(sample):
        assert not sample or os.getpid() != driver
        return train(sample)

    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "train_chain", elsewhere)
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()} == scored
    assert 0 < toxicity.drop_toxic(docs, labels).count() <= docs.count()
    made = common.learnt(train, docs, labels, "toxic", learn, toxicity.SAMPLE)
    assert made.prior == want.prior and made.layer == want.layer and made.trans == want.trans
    assert np.array_equal(made.keys, want.keys) and np.array_equal(made.weights, want.weights)
    assert common.learnt(train, docs.limit(0), labels, "toxic", learn, toxicity.SAMPLE).prior == 0.0


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup", "decontamination"])
def test_texts_reach_python_in_small_batches(spark, monkeypatch, stage):
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.repeat(F.lit("words "), 1700)).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "an item that stands in no text")], "item_id long, text string")
    real = type(docs).mapInArrow

    def held(self, work, schema, *more):
        def small(batches):
            def looked_at():
                for batch in batches:
                    if batch.nbytes > 2 << 20:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch

            return work(looked_at())

        return real(self, small, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", held)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    out = {"toxicity": lambda: toxicity.drop_toxic(docs, labels), "near_dedup": lambda: minhash.features(docs), "decontamination": lambda: decontaminate.drop_contaminated(docs, items)}[stage]()
    assert out.count() == 2000


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    m = toxicity.ChainModel(np.zeros(0, np.uint32), np.zeros(0), bias=-0.3, trans=(0.0, -0.7, 0.4, 0.9), start=0.2)
    u, first = rng.normal(size=11), np.zeros(11, bool)
    first[[0, 4, 5]] = True
    got = toxicity.marginals(m, u, first)[0]
    for a, b in ((0, 4), (4, 5), (5, 11)):
        weight = np.zeros(b - a)
        total = 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            s = m.start * y[0] + sum((u[a + i] + m.bias) * v for i, v in enumerate(y)) + sum(m.trans[2 * p + q] for p, q in zip(y, y[1:]))
            total += math.exp(s)
            weight += math.exp(s) * np.array(y)
        assert np.allclose(got[a:b], weight / total)


def test_empty_tables(no_docs, spark):
    bench = spark.createDataFrame([(1, "some item text here that is long enough")], "item_id long, text string")
    assert minhash.near_duplicates(no_docs).count() == 0
    assert line_dedup.duplicate_lines(no_docs).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    assert hilbert.hilbert_shards(no_docs, 40, ["source", "lang", "n_chars"]).count() == 0
    assert pii.pii_digest(no_docs).count() == 0 and license_scan.license_digest(no_docs).count() == 0
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_no_items_means_no_contamination(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
