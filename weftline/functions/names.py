"""Column expressions for names, patterns, sizes and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def fold_name(name: Column) -> Column:
    """The one place where names are folded: lower case."""
    return F.lower(name)


def glob_regex(pattern: str) -> str:
    """A whole-text regex for ``*`` (anything) and ``?`` (one character); other characters stand for themselves."""
    return r"(?s)\A" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern.lower()) + r"\z"


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Case-insensitive match with any of the globs."""
    return F.lower(text).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def unescape(name: Column, mark: str = "'") -> Column:
    return F.replace(name, F.lit(mark * 2), F.lit(mark))


def display(kind: Column, table: Column, name: Column, from_column: Column | None = None, to_table: Column | None = None, to_column: Column | None = None) -> Column:
    """How an object of each kind is written: 'Table'[Name] for columns and measures, the kind before others; relationships by their ends."""
    field = F.concat(quoted(table), F.lit("["), name, F.lit("]"))
    written = F.when(kind.isin("column", "measure"), field).when(kind.isin("hierarchy", "partition", "calculation_item"), F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), field))
    if from_column is not None:
        ends = F.concat(F.lit("relationship "), quoted(table), F.lit("["), from_column, F.lit("] -> "), quoted(to_table), F.lit("["), to_column, F.lit("]"))
        written = written.when(kind == "relationship", ends)
    return written.otherwise(F.concat_ws(" ", F.replace(kind, F.lit("_"), F.lit(" ")), quoted(name)))


def object_key(*parts: Column) -> Column:
    """Identity and comparison key: folded fields with a separator between them; null counts as empty."""
    return fold_name(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def unordered_pair(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def kpi_base(name: Column) -> Column:
    """The name without a KPI suffix; null where it has none."""
    return F.when(name.rlike(r"(?i)\S.*\s*(goal|status|trend|value)$"), F.regexp_replace(name, r"(?i)\s*(goal|status|trend|value)$", ""))


def is_guid(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def filters_both_ways(behaviour: Column, from_cardinality: Column, to_cardinality: Column) -> Column:
    """Any direction said other than one, or one-to-one whatever is said; what is not said is one direction, many to one."""
    one = lambda c, unsaid: F.lower(F.coalesce(c, F.lit(unsaid))) == "one"
    return (F.lower(F.coalesce(behaviour, F.lit("onedirection"))) != "onedirection") | (one(from_cardinality, "many") & one(to_cardinality, "one"))


#: Units of sizes, each 1,024 of the one before.
UNITS = ["KB", "MB", "GB", "TB"]


def format_bytes(size: Column) -> Column:
    """Bytes as they are below 1,024, else with one decimal in the largest unit that leaves a whole one; terabytes take all that is larger."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", F.bround(size / F.lit(1024.0**power), 1))  # noqa: E731  ties go to the even digit
    shown = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, name in enumerate(UNITS[:-1], 1):
        shown = shown.when(size < 1024 ** (power + 1), unit(power, name))
    return shown.otherwise(unit(len(UNITS), UNITS[-1]))


def initial_catalog(connection: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(connection, r"(?i)(?:^|;)\s*initial catalog\s*=\s*([^;]+)", 1)), F.lit(""))


def strip_wait_time(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+\z", ""), r"(?s)\s*\[WaitTime:(?!.*\[WaitTime:).*ms\]\z", "")


def query_language(text: Column) -> Column:
    return F.when(F.upper(F.regexp_extract(text, r"\A\s*([A-Za-z]*)", 1)).isin("SELECT", "WITH", "DRILLTHROUGH"), "mdx").otherwise("dax")


def fingerprint(key: Column) -> Column:
    return F.sha2(key, 256)


def escape_command(text: Column) -> Column:
    """Text of a CI logging command: percent and line ends escaped."""
    for a, b in (("%", "%AZP25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
