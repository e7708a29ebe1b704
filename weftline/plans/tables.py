"""Encodings of the supplied tables: a foreign-key graph, a query log, storage sizes and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(mark: str, *cols: str):
    return F.concat(F.lit(mark), F.concat_ws("-", *(F.col(c).cast("string") for c in cols)))


#: kind, table, mark and key columns of the graph's nodes.
NODES = [("region", "region", "r", ["r_regionkey"]), ("nation", "nation", "n", ["n_nationkey"]), ("customer", "customer", "c", ["c_custkey"]), ("supplier", "supplier", "s", ["s_suppkey"]), ("part", "part", "p", ["p_partkey"]), ("orders", "orders", "o", ["o_orderkey"]), ("lineitem", "lineitem", "l", ["l_orderkey", "l_linenumber"])]
#: table, source mark and columns, target mark and column, provenance.
EDGES = [
    ("lineitem", "l", ["l_orderkey", "l_linenumber"], "o", "l_orderkey", "table_member"),
    ("lineitem", "l", ["l_orderkey", "l_linenumber"], "p", "l_partkey", "measure_expression"),
    ("lineitem", "l", ["l_orderkey", "l_linenumber"], "s", "l_suppkey", "measure_expression"),
    ("orders", "o", ["o_orderkey"], "c", "o_custkey", "relationship"),
    ("customer", "c", ["c_custkey"], "n", "c_nationkey", "relationship_endpoint"),
    ("supplier", "s", ["s_suppkey"], "n", "s_nationkey", "relationship_endpoint"),
    ("nation", "n", ["n_nationkey"], "r", "n_regionkey", "hierarchy_level"),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, name, mark, keys in NODES:
        part = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), _id(mark, *keys).alias("id"))
        part = part.distinct() if name == "lineitem" else part  # only its keys repeat
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, mark, keys, to, col, prov in EDGES:
        part = table(spark, sf_dir, name).select(_id(mark, *keys).alias("src"), _id(to, col).alias("dst"), F.lit(prov).alias("prov"))
        part = part.distinct() if name == "lineitem" else part
        out = part if out is None else out.unionByName(part)
    return written(out, "edges")


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(_id("l", "l_orderkey", "l_linenumber").alias("id")).distinct()


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, operation, ts (text), user, report, object_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("query_id"), F.col("event_type").alias("operation"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("report"), (F.col("event_id") % 97).alias("object_id"))


def _dedent(sql: str) -> str:
    return "\n".join(line.strip() for line in sql.strip().splitlines())


def _sql_id(mark: str, keys: list[str]) -> str:
    return f"'{mark}' || " + " || '-' || ".join(f"cast({k} as varchar)" for k in keys)


#: The same encodings for the SQL oracle.
GRAPH_SQL = _dedent(
    "nodes as (" + " union ".join(f"select '{k}' as kind, {_sql_id(m, keys)} as id from {t}" for k, t, m, keys in NODES) + "),\n"
    "edges as (" + " union ".join(f"select {_sql_id(m, keys)} as src, {_sql_id(to, [c])} as dst, '{p}' as prov from {t}" for t, m, keys, to, c, p in EDGES) + "),\n"
    f"roots as (select distinct {_sql_id('l', ['l_orderkey', 'l_linenumber'])} as id from lineitem where l_returnflag = 'R' and l_quantity >= 49)"
)
LIVE_SQL = """strong as (select id from roots union select e.dst from strong s join edges e on e.src = s.id where e.prov <> 'relationship_endpoint'),
live as (select id from strong union select e.dst from live s join edges e on e.src = s.id where e.prov <> 'table_member')"""
LOG_SQL = "log as (select event_id as query_id, event_type as operation, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, user_id as user_key, json_extract_string(props, '$.k') as report, event_id % 97 as object_id from events)"
