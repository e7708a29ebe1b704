"""One door for every format: what a folder holds is told by names and first bytes, and read by the reader of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import written
from weftline.sources import apps, archives, pbir, tmdl, tmsl, workbooks
from weftline.sources.facts import display_names, format_of, parse_files, read_files, typed

MODEL_READERS = {"tmdl": tmdl.parse, "tmsl": tmsl.parse, "archive": archives.parse_archive, "backup": archives.parse_backup}
REPORT_READERS = {"pbir": pbir.parse, "archive": archives.parse_archive, "workbook": workbooks.parse, "app": apps.parse}
SIZE_READERS = {"vpax": archives.parse_vpax}


def sorted_out(files: DataFrame) -> DataFrame:
    """Files (model, path, content) with ``format``; null where no reader takes them."""
    return files.withColumn("format", format_of(F.col("path"), F.col("content")))


#: Formats whose every file is a model or report of its own.
WHOLE = ("tmsl", "archive", "backup", "workbook", "vpax")


def _read(files: DataFrame, readers: dict) -> DataFrame:
    """Facts of the files that one of the readers takes, written once: what follows joins them with themselves."""
    known = sorted_out(files).where(F.col("format").isin(*readers)).where((F.col("format") != "app") | apps.is_source(F.col("path")))
    own = known.withColumn("model", F.when(F.col("format").isin(*WHOLE), F.col("path")).otherwise(F.col("model")))
    return written(parse_files(own, readers), "facts")


def model_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all models below a folder, in whatever format; missing M of archives is filled in, TMDL tables are in order."""
    found = _read(read_files(spark, folder).where(~F.col("path").rlike("/cultures/")), MODEL_READERS)
    if not found.where("kind = 'mashup_query'").isEmpty():
        found = written(archives.fill_missing_m(found), "filled")
    return tmdl.in_order(found).drop("place")


def report_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all reports, workbooks and apps below a folder."""
    return _read(read_files(spark, folder), REPORT_READERS)


def size_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all storage statistics below a folder."""
    return _read(read_files(spark, folder), SIZE_READERS)


def beside(spark: SparkSession, facts: DataFrame, name: str, read: bool = True) -> DataFrame:
    """model, path, content (if ``read``) of the file of that name in each model's folder, where there is one.

    Spark neither lists nor opens names that start with a dot, so the driver opens them by their paths: one
    small file a model.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for r in facts.select("model").distinct().toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{r['model']}/{name}")
        files = path.getFileSystem(conf)
        if files.exists(path):
            content = None
            if read:
                stream = files.open(path)
                content = bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                stream.close()
            found.append((r["model"], path.toString(), content))
    return spark.createDataFrame(found, "model string, path string, content binary")


def cached_backups(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """model, path of the cached backups that lie beside model folders; there may be none."""
    return beside(spark, facts, ".pbi/cache.abf", read=False).drop("content")


def named_models(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """model, display_name of the models that ``facts`` holds."""
    return facts.select("model").distinct().join(display_names(beside(spark, facts, ".platform")), "model", "left")


def datasets(facts: DataFrame) -> DataFrame:
    """report, how, reference of what each report says it is bound to."""
    return typed(facts, "dataset", "how string").select(F.col("model").alias("report"), "how", F.col("name").alias("reference"))
