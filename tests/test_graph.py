import random

import pytest

from weftline.operators import graph


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, prov string")


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_on_random_cyclic_graphs(spark, seed):
    r = random.Random(seed)
    pairs = {(str(r.randrange(40)), str(r.randrange(40))) for _ in range(60)}
    want, work = {"0"}, ["0"]
    while work:
        x = work.pop()
        for a, b in pairs:
            if a == x and b not in want:
                want.add(b)
                work.append(b)
    got = graph.reach(spark.createDataFrame([("0",)], "id string"), edges_df(spark, [(a, b, "x") for a, b in pairs]))
    assert ids(got) == want


def test_liveness_passes(spark):
    rows = [("m", "t", "table_member"), ("t", "rel", "relationship"), ("rel", "key", "relationship_endpoint"), ("key", "other", "table_member"), ("a", "b", "inactive_relationship")]
    live = graph.liveness(spark.createDataFrame([("m",), ("a",)], "id string"), edges_df(spark, rows))
    assert ids(live) == {"m", "t", "rel", "key", "a"}  # a key that is only weakly alive keeps no table


def test_bridges_need_two_distinct_live_ends(spark):
    flows = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "b"), ("a", "z"), ("z", "a"), ("a", "w")], "src string, dst string")
    assert ids(graph.bridge_tables(spark.createDataFrame([("a",), ("b",)], "id string"), flows)) == {"x", "y"}


def test_unused_counts_users(spark):
    nodes = spark.createDataFrame([("k", x) for x in "abcd"], "kind string, id string")
    out = graph.unused(nodes, spark.createDataFrame([("a",)], "id string"), edges_df(spark, [("a", "b", "p"), ("c", "d", "p"), ("c", "d", "q")]))
    assert {(r.id, r.used_by_count, r.also_unused_all) for r in out.collect()} == {("b", 1, False), ("c", 0, False), ("d", 1, True)}


def test_edges_are_deduped(spark):
    e = edges_df(spark, [("a", "a", "p"), ("a", "b", "p"), ("a", "b", "p"), ("a", "b", "q")])
    assert graph.dedupe_edges(e).count() == 2
