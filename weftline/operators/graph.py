"""Dependency graph operators: reachability, liveness, bridges, slices.

Graphs are DataFrames: nodes(kind, id), edges(src, dst, prov), roots(id). Traversals are semi-naive: each round
joins only the newest nodes with the edges and writes the next ones as a table, so lineage does not grow and
joins know their sides' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import new_path, shared_folder, write, written

#: Provenances that the strong pass, and the weak pass, do not follow (fixed values).
NOT_STRONG = ("relationship_endpoint", "inactive_relationship", "inactive_relationship_endpoint", "stale_bookmark")
NOT_WEAK = ("table_member", "inactive_relationship", "inactive_relationship_endpoint", "stale_bookmark")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Have a folder for checkpoints: the shared one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def strong(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("prov").isin(*NOT_STRONG))


def weak(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("prov").isin(*NOT_WEAK))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """No self-loops, each (src, dst, prov) once."""
    return edges.where("src <> dst").dropDuplicates(["src", "dst", "prov"])


def reach(seeds: DataFrame, edges: DataFrame, depth: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """id, depth of every node that the seeds (id) reach; the seeds have depth 0.

    ``first``: the edges of the first round where only some of ``edges`` can lead from the seeds to new nodes.
    """
    spark = seeds.sparkSession
    paths = [new_path(spark, "reach")]
    write(seeds.select("id").distinct().withColumn("depth", F.lit(0)), paths[0])
    read = lambda *p: spark.read.schema("id string, depth int").parquet(*p)
    at = 0
    while depth is None or at < depth:
        at += 1
        hops = edges if first is None or at > 1 else first
        new = read(paths[-1]).join(hops.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).distinct()
        paths.append(new_path(spark, "reach"))
        write(new.join(read(*paths[:-1]).select("id"), "id", "left_anti").withColumn("depth", F.lit(at)), paths[-1])
        if read(paths[-1]).isEmpty():
            break
    return read(*paths)


def _labels(live: DataFrame, flows: DataFrame) -> DataFrame:
    """Dead tables reachable from live ones through dead ones: id, least and greatest live start. flows: src, dst."""
    into_dead = written(flows.join(live.select(F.col("id").alias("dst")), "dst", "left_anti"), "flows")
    start = into_dead.join(live.select(F.col("id").alias("src")), "src", "left_semi")
    best = written(start.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("lo"), F.max("src").alias("hi")), "labels")
    changed = best
    while not changed.isEmpty():
        step = changed.join(into_dead, changed["id"] == into_dead["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        merged = written(best.unionByName(step).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "labels")
        changed = written(merged.join(best, ["id", "lo", "hi"], "left_anti"), "changed")
        best = merged
    return best


def bridge_tables(live: DataFrame, flows: DataFrame) -> DataFrame:
    """Dead tables on a filter path between two distinct live tables (id).

    A dead table carries a filter if some live start reaches it and it reaches some other live end,
    both through dead tables. The least and greatest labels of each side tell whether two differ.
    """
    forward = _labels(live, flows)
    backward = _labels(live, flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    both = forward.join(backward, "id")
    one = (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    return both.where(~one).select("id")


def liveness(seeds: DataFrame, edges: DataFrame, flows: DataFrame | None = None, weak_seeds: DataFrame | None = None) -> DataFrame:
    """Live ids: strong reach, then bridge tables until none is new, then weak reach from all of these.

    ``flows`` (src, dst, and rel, is_active where known): a flow counts if its relationship is active or live.
    Edges must be a table that is cheap to read again: each round reads them.
    """
    firm = strong(edges)
    alive = reach(seeds, firm).select("id")
    while flows is not None:
        if "rel" in flows.columns:
            live_rels = alive.select(F.col("id").alias("rel"), F.lit(True).alias("on"))
            own = flows.join(live_rels, "rel", "left").where("is_active or on").select("src", "dst")
        else:
            own = flows
        bridges = bridge_tables(alive, own)
        if bridges.isEmpty():
            break
        alive = written(alive.unionByName(reach(bridges, firm).select("id")).distinct(), "alive")
    start = alive if weak_seeds is None else alive.unionByName(weak_seeds.select("id")).distinct()
    # What the strong pass may follow leads to live nodes already, but for weak seeds.
    only_weak = edges.where(F.col("prov").isin(*(p for p in NOT_STRONG if p not in NOT_WEAK)))
    return reach(start, weak(edges), first=only_weak if weak_seeds is None else None).select("id")


def unused(nodes: DataFrame, live: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes outside ``live`` with how many objects use each, and whether those are all unused too."""
    dead = nodes.join(live, "id", "left_anti")
    used_by = edges.select("src", F.col("dst").alias("id")).distinct().join(live.select(F.col("id").alias("src"), F.lit(1).alias("l")), "src", "left")
    counts = used_by.groupBy("id").agg(F.count("*").alias("used_by"), F.count("l").alias("used_live"))
    return dead.join(counts, "id", "left").select("kind", "id", F.coalesce("used_by", F.lit(0)).cast("long").alias("used_by_count"), ((F.col("used_by") > 0) & (F.col("used_live") == 0)).alias("also_unused_all")).withColumn("also_unused_all", F.coalesce("also_unused_all", F.lit(False)))


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "prov")


def slice_of(roots: DataFrame, edges: DataFrame, depth: int | None, impact: bool = False) -> DataFrame:
    """Nodes of a dependency (or impact) slice: id, depth. Every edge counts, whatever its provenance."""
    return reach(roots, flipped(edges) if impact else edges, depth)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between nodes of ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "prov")


def keep_paths_to(slice_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes of a slice on a path to a match (id): reverse reach inside the slice."""
    return reach(matches, flipped(slice_edges)).select("id")


def consumers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """dst, consumer, prov: the objects that use each of ``of`` (dst)."""
    return edges.join(of, "dst").select("dst", F.col("src").alias("consumer"), "prov")


def producers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """src, producer, prov: the objects that each of ``of`` (src) uses."""
    return edges.join(of, "src").select("src", F.col("dst").alias("producer"), "prov")


def root_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, root_count: how many roots (id) use each object."""
    mine = edges.join(roots.select(F.col("id").alias("src")), "src", "left_semi")
    return mine.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("root_count"))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, neighbour, prov: each pair of objects once, with the first of its provenances."""
    return edges.groupBy(F.col("src").alias("id"), F.col("dst").alias("neighbour")).agg(F.min("prov").alias("prov"))


def reached_by(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id: what each root (id) reaches, itself included: a reach that keeps its label."""
    spark = roots.sparkSession
    paths = [new_path(spark, "reached")]
    write(roots.select(F.col("id").alias("root"), "id").distinct(), paths[0])
    read = lambda *p: spark.read.schema("root string, id string").parquet(*p)
    while not read(paths[-1]).isEmpty():
        new = read(paths[-1]).join(edges.select(F.col("src").alias("id"), "dst"), "id").select("root", F.col("dst").alias("id")).distinct()
        paths.append(new_path(spark, "reached"))
        write(new.join(read(*paths[:-1]), ["root", "id"], "left_anti"), paths[-1])
    return read(*paths)


def signed_distances(root: DataFrame, edges: DataFrame) -> DataFrame:
    """id, distance: edges away from the root, negative for what uses it."""
    up = reach(root, flipped(edges)).where("depth > 0").select("id", (-F.col("depth")).alias("distance"))
    return up.unionByName(reach(root, edges).select("id", F.col("depth").alias("distance")))
