"""Query logs in their export formats as rows of text cells, then natively as logged queries."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.sources.archives import query_text
from weftline.sources.facts import decode_text, read_files

#: Column names that stand for each field, in any case.
ALIASES = {
    "text": ["eventtext"], "operation": ["operationname"], "detail": ["operationdetailname"], "ts": ["timestamp", "timegenerated"], "item": ["itemname", "artifactname"],
    "item_id": ["itemid", "artifactid"], "application": ["applicationname"], "context": ["applicationcontext"], "user": ["executinguser", "user"],
}


def _cell(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def _columns_and_rows(table: dict) -> list[dict]:
    named = table.get("Columns") or table.get("columns") or []
    header = [c.get("ColumnName") or c.get("name") or c.get("columnName") for c in named]
    return [dict(zip(header, r)) for r in table.get("Rows") or table.get("rows") or []]


def rows_of(text: str) -> list[dict]:
    """Rows (column name -> cell) of any of the formats: CSV, an array of row objects, or a response with columns and rows."""
    text = text.removeprefix("\ufeff")
    if text.lstrip()[:1] not in ("[", "{"):
        return [dict(r) for r in csv.DictReader(io.StringIO(text, newline=""), restkey="")]
    value = json.loads(text)
    if isinstance(value, list) and any(isinstance(f, dict) and "FrameType" in f for f in value):
        table = next((f for f in value if f.get("FrameType") == "DataTable" and f.get("TableKind") == "PrimaryResult"), None)
        if table is None:
            raise ValueError("no primary result in this export")
        return _columns_and_rows(table)
    if isinstance(value, dict):
        tables = value.get("Tables") or value.get("tables")
        if not tables:
            raise ValueError("not a query export")
        return _columns_and_rows(tables[0])
    return [r for r in value if isinstance(r, dict)]


def raw_rows(files: DataFrame) -> DataFrame:
    """path, row (from 1), and the fields as text, of all log files."""
    fields = list(ALIASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = rows_of(decode_text(query_text(content or b"")))
                folded = [{str(k).strip().lower(): _cell(v) for k, v in r.items()} for r in rows]
                known = {k for r in folded for k in r}
                if folded and "eventtext" not in known:
                    raise ValueError(f"{path} is no query log: it has no EventText column")
                at = {f: next((a for a in names if a in known), None) for f, names in ALIASES.items()}
                columns = {f: pa.array([r.get(at[f]) if at[f] else None for r in folded], pa.string()) for f in fields}
                has = pa.array([at["operation"] is not None] * len(folded), pa.bool_())
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(folded), pa.string()), "row": pa.array(range(1, len(folded) + 1), pa.int64()), "has_operation": has, **columns})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, row long, has_operation boolean, " + ", ".join(f"{f} string" for f in fields))


def logged_queries(rows: DataFrame) -> DataFrame:
    """Rows of finished queries that have a text: path, row, text, language, ts, user, application, item, item_id, sources (report and visual ids)."""
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    finished = ~F.col("has_operation") | F.coalesce(F.upper(F.trim("operation")) == "QUERYEND", F.lit(False))
    text = F.nullif(names.strip_wait_time(F.trim("text")), F.lit(""))
    detail = F.upper(cell("detail"))
    language = F.when(detail == "MDXQUERY", "mdx").when(detail == "DAXQUERY", "dax").otherwise(names.query_language(text))
    return rows.where(finished).select("path", "row", text.alias("text"), language.alias("language"), cell("ts").alias("ts"), cell("user").alias("user"), cell("application").alias("application"), cell("item").alias("item"), cell("item_id").alias("item_id"), query_sources(F.col("context")).alias("sources"))


def query_sources(context):
    """Report and visual ids of an application context; malformed ones name none."""
    held = F.from_json(context, "struct<Sources:array<struct<ReportId:string,VisualId:string>>>")["Sources"]
    cleaned = F.transform(F.coalesce(held, F.array().cast("array<struct<ReportId:string,VisualId:string>>")), lambda s: F.struct(F.nullif(s["ReportId"], F.lit("")).alias("report"), F.nullif(s["VisualId"], F.lit("")).alias("visual")))
    return F.filter(cleaned, lambda s: s["report"].isNotNull() | s["visual"].isNotNull())


def log_notices(queries: DataFrame) -> DataFrame:
    """Finished queries without a text."""
    return queries.where("text is null").select("path", "row", F.lit("malformed_value").alias("skip_kind"))


def retain(queries: DataFrame, item: str | None = None, item_id: str | None = None) -> DataFrame:
    """Queries with a text that ran against one model, and those that say no model."""
    mine = F.lit(False)
    if item is not None:
        mine = mine | (F.lower("item") == item.lower())
    if item_id is not None:
        mine = mine | (F.lower("item_id") == item_id.lower())
    return queries.where("text is not null").where((F.col("item").isNull() & F.col("item_id").isNull()) | F.coalesce(mine, F.lit(False)))


def window(queries: DataFrame) -> DataFrame:
    """First and last time, compared as text, and the models' names, each once whatever its case."""
    some = queries.where("text is not null")
    return some.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("queries"), F.countDistinct(F.lower("item")).alias("items"))


def read_log(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return logged_queries(raw_rows(read_files(spark, folder, pattern)))
