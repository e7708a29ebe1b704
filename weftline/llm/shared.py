"""Helpers that the operators of this subpackage share: staged tables, Arrow batches, word splitting."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it: space and \t \n \v \f \r.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what setCheckpointDir() named.

    Only on a local master, where all tasks run in one process's machine, an unset folder gets one of our own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{context.applicationId}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/weft-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Drops a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch; Spark bounds a batch by bytes as well.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, tag: str, rows: int = 10_000) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; Arrow batches have at most ``rows`` rows.

    This cuts the lineage: a lost executor costs a re-read, and row tags such as
    monotonically_increasing_id() stay what they were. The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    put = {CLEANUP: "true", BATCH: str(rows)}
    before = {k: spark.conf.get(k, "false" if k == CLEANUP else "10000") for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._weft_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name


def _is_scan(plan: object) -> bool:
    """Is this a file scan under projections and filters alone, so that a file's row appears once at most?"""
    kind, below = plan.getClass().getSimpleName(), plan.children()
    if kind == "LogicalRelation":
        return True
    return kind in ("Project", "Filter", "SubqueryAlias", "View") and below.size() == 1 and _is_scan(below.apply(0))


def tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart in every later pass over it, and that column's name.

    Rows of files are told apart by file and place, so nothing is copied; rows of other plans, whose order
    may change from pass to pass, are staged once with their number.
    """
    name = fresh(docs, "row_tag")
    if "_metadata" not in docs.columns and _is_scan(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select("*", F.unhex(F.md5(F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string")))).alias(name)), name
        except AnalysisException:  # a format without row numbers
            pass
    return stage(docs.withColumn(name, F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))), "tagged"), name


#: Up to so many marks (of at most 16 bytes) are broadcast; beyond it rows and marks are shuffled.
MARKS = 1_000_000


def without(rows: DataFrame, name: str, marks: DataFrame) -> DataFrame:
    """``rows`` but for those whose tag is in the narrow table ``marks``, without the tag."""
    few = marks.limit(MARKS + 1).count() <= MARKS
    return rows.join(F.broadcast(marks) if few else marks, name, "left_anti").drop(name)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def packed(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that are equal in all columns (sorted input)."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; WEFTLINE_TOKENIZERS may name another folder."""
    folder = os.environ.get("WEFTLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
