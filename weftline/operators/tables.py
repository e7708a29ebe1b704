"""Tables that a loop or a scan writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Drops a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a written table from which it is not broadcast. Names and ids shrink a lot in Parquet, and
#: Spark takes the size of the files for that of the rows, so its own limit lets far larger tables through the driver.
LARGE = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what setCheckpointDir() named; one of our own only on a local master where neither is set."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/{context.applicationId}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/table-{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df``, which no join broadcasts by its size; the other side of a join still may be. SQL has no name for this hint."""
    spark = df.sparkSession
    logical = spark._jvm.org.apache.spark.sql.catalyst.plans.logical
    no = getattr(getattr(logical, "NO_BROADCAST_HASH$"), "MODULE$")
    plan = logical.ResolvedHint(df._jdf.queryExecution().analyzed(), logical.HintInfo(spark._jvm.scala.Some(no)))
    return type(df)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def written(df: DataFrame, tag: str = "rows") -> DataFrame:
    """``df`` as a written table: its lineage ends here, and whoever joins it knows whether it is small."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    write(df, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    rows = spark.read.schema(df.schema).parquet(path)
    return never_broadcast(rows) if size >= LARGE else rows


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each ``key`` (never null). Rows whose key no other shares, as a rule all, are not moved; a 64-bit hash tells which may be shared."""
    mark = F.xxhash64(key)
    shared = written(rows.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).where("n > 1").select("mark"), "shared")
    if shared.isEmpty():
        return rows
    marked = rows.withColumn("mark", mark)
    alone, several = marked.join(shared, "mark", "left_anti"), marked.join(shared, "mark", "left_semi")
    return alone.unionByName(several.dropDuplicates([key])).select(*rows.columns)
