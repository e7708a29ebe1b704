"""From what a user writes to one object: exact display, then shorthand, else the nearest names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import lexers, names


class NotFound(LookupError):
    """Nothing is called so; ``suggestion`` is the nearest written form, or None."""

    def __init__(self, text: str, suggestion: str | None):
        super().__init__(f'object "{text}" was not found' + (f', did you mean "{suggestion}"?' if suggestion else ""))
        self.suggestion = suggestion


class Ambiguous(LookupError):
    """Several objects are called so."""

    def __init__(self, text: str, candidates: list[str]):
        super().__init__(f'"{text}" matches multiple objects: ' + ", ".join(candidates))
        self.candidates = candidates


def match_keys(objects: DataFrame) -> DataFrame:
    """objects (id, kind, owner_table, name, display) with ``key``, folded: every form in which each can be written."""
    field = F.concat(names.quoted(F.col("owner_table")), F.lit("["), "name", F.lit("]"))
    short = F.when(F.col("kind").isin("column", "measure", "hierarchy", "calculation_item", "partition"), F.array(field, F.col("name"))).when(F.col("kind") != "relationship", F.array(F.col("name"))).otherwise(F.array().cast("array<string>"))
    return objects.select("*", F.explode(F.array_distinct(F.transform(F.concat(F.array("display"), F.array_compact(short)), lambda k: F.lower(k)))).alias("key"))


def candidates(objects: DataFrame, text: str) -> DataFrame:
    """Objects that a shorthand may mean: 'Table'[Name], [Name], a table or global name, a function call's name."""
    spark = objects.sparkSession
    refs = lexers.dax_refs(spark.createDataFrame([(text,)], "text string"))
    found = refs.limit(2).collect()  # what one user wrote
    if len(found) != 1:
        return objects.limit(0)
    ref = found[0]
    name = F.lower("name") == ref["name"].lower()
    if ref["shape"] == "field":
        own = F.col("kind").isin("column", "measure", "hierarchy", "calculation_item") & name
        return objects.where(own if ref["table_name"] is None else own & (F.lower("owner_table") == ref["table_name"].lower()))
    if ref["shape"] == "function":
        return objects.where((F.col("kind") == "function") & name)
    return objects.where(F.col("kind").isin("table", "role", "expression", "function", "report_measure", "bookmark") & name)


def suggest(objects: DataFrame, text: str) -> DataFrame:
    """The nearest object to ``text``, if any is near, ties by identity: at most one row."""
    return lexers.near_names(match_keys(objects), "key", text.strip()).orderBy("distance", "kind_rank", "id").limit(1)


def find_object(objects: DataFrame, text: str) -> str:
    """The id of the one object that ``text`` names."""
    text = text.strip()
    for found in (objects.where(F.lower("display") == text.lower()), candidates(objects, text)):
        rows = found.select("id", "display", "kind_rank").orderBy("kind_rank", "id").limit(20).collect()
        if len(rows) == 1:
            return rows[0]["id"]
        if rows:
            raise Ambiguous(text, [r["display"] for r in rows])
    near = suggest(objects, text).select("display").collect()
    raise NotFound(text, near[0]["display"] if near else None)
