"""Queries over whole tables: every row of both sides takes part, at any scale."""

import pytest

from basalt.plans import catalog


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_full_join_keeps_every_row_of_both_sides(spark, sf):
    customer, supplier = catalog.load(spark, sf, "customer", "supplier")
    got = catalog.queries()["join_full_whole"](spark, sf).collect()
    left, right = [{r[0] for r in t.select(k).collect()} for t, k in ((customer, "c_custkey"), (supplier, "s_suppkey"))]
    assert {r.c_custkey for r in got} - {None} == left and {r.s_suppkey for r in got} - {None} == right
    matched = sum(None not in tuple(r) for r in got)
    assert matched > 0 and len(got) == len(left) + len(right) - matched
    assert any(r.c_custkey is None for r in got) and any(r.s_suppkey is None for r in got)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_null_keys_join_counts_the_pairs_of_whole_tables(spark, sf):
    """The pre-aggregated join gives the counts of the many-to-many join."""
    (part,) = catalog.load(spark, sf, "part")
    keys = [None if r.p_size == 7 else r.p_size for r in part.select("p_size").collect()]
    pairs = sum(keys.count(k) for k in keys if k is not None)
    alone = keys.count(None)
    (got,) = catalog.queries()["join_null_keys_whole"](spark, sf).collect()
    assert alone > 0 and (got.n, got.m) == (pairs + alone, pairs)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_merge_meets_every_row_of_target_and_source(spark, sf):
    """Each clause takes rows, and their numbers follow from the whole tables."""
    customer, supplier = catalog.load(spark, sf, "customer", "supplier")
    source = {2 * r.c_custkey for r in customer.select("c_custkey").collect()}
    target = {r.s_suppkey for r in supplier.select("s_suppkey").collect()}
    deleted = {k for k in target - source if k % 5 == 0}
    got = [r.k for r in catalog.queries()["dml_merge_whole"](spark, sf).collect()]
    assert deleted and target & source and source - target and target - source - deleted
    assert sorted(got) == sorted((target | source) - deleted)


def test_unnest_gives_every_component(spark):
    sf = "/root/testdata/sf0.001"
    (embeddings,) = catalog.load(spark, sf, "embeddings")
    want = sorted((r.vec_id, i, e) for r in embeddings.select("vec_id", "embedding").collect() for i, e in enumerate(r.embedding))
    assert sorted((r.vec_id, r.pos, r.e) for r in catalog.queries()["dialect_unnest_offset_whole"](spark, sf).collect()) == want
    assert max(w[1] for w in want) > 3


def test_distances_are_from_every_query_vector(spark):
    sf = "/root/testdata/sf0.001"
    ids = [r.vec_id for r in catalog.load(spark, sf, "embeddings")[0].select("vec_id").collect()]
    want = sorted((i, q) for i in ids for q in ids if q % 50 == 0)
    assert len({q for _, q in want}) > 1
    assert sorted((r.vec_id, r.query_id) for r in catalog.queries()["fn_vector_distance_queries"](spark, sf).collect()) == want
