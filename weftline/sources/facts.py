"""What readers return: one row per object, property bag or notice, whatever format it was written in.

A fact has the model (or report) it belongs to, the file and line it stands in, its kind, the table that
owns it, its name, its place in source order, and its properties as JSON. Readers take DataFrames of files
(``model, path, content``), one file a row, so files are parsed where they lie and nothing is collected.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parsing a malformed file can raise.
MALFORMED = (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError, EOFError, SyntaxError, zipfile.BadZipFile, zlib.error, struct.error, sqlite3.Error)
FACT = "model string, path string, line int, kind string, tbl string, name string, seq long, props string"
NAMES = [part.split()[0] for part in FACT.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
#: Facts that are handed to Spark at once, at least, where there are more: a batch a file costs more than reading the file.
BATCH = 4096
_json = json.JSONEncoder(ensure_ascii=False).encode


class Facts:
    """Collects the facts of one file in source order; those of other kinds than ``kinds``, if it is given, only take their place in it."""

    def __init__(self, model: str | None, path: str | None, first: int = 0, kinds: frozenset[str] | None = None):
        self.model, self.path, self.rows, self.first, self.kinds, self.others = model, path, [], first, kinds, 0

    def wants(self, kind: str) -> bool:
        """Whether a fact of this kind is to be added; one that is not takes its place here, and what it says need not be gathered."""
        if self.kinds is None or kind in self.kinds:
            return True
        self.others += 1
        return False

    def add(self, kind: str, tbl: str | None, name: str | None, line: int | None = None, **props) -> None:
        if self.kinds is not None and kind not in self.kinds:
            self.others += 1
            return
        said = {k: v for k, v in props.items() if v is not None}
        self.rows.append((self.model, self.path, line, kind, tbl, name, self.first + len(self.rows) + self.others, _json(said)))

    def skip(self, kind: str, detail: str, line: int | None = None, at: str | None = None) -> None:
        self.add("skip", None, None, line, skip_kind=kind, detail=detail, at=at)


def parse_files(files: DataFrame, parse: Callable[[Facts, bytes], None] | dict[str, Callable[[Facts, bytes], None]], kinds: list[str] | None = None) -> DataFrame:
    """Facts of all files (model, path, content): ``parse`` adds the facts of one; a file that it cannot read becomes a notice.

    With a dict, each file (which then has ``format``) goes to the reader of its format. With ``kinds``, only facts of
    these are returned, as they are among all.
    """
    many = isinstance(parse, dict)
    wanted = frozenset(kinds) if kinds is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
        for batch in batches:
            for model, path, content, *kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                facts = Facts(model, path, kinds=wanted)
                try:
                    (parse[kind[0]] if many else parse)(facts, content if content is not None else b"")
                except MALFORMED as e:  # other files go on
                    facts.rows, facts.others = [], 0
                    facts.skip("malformed_value", f"{type(e).__name__}: {e}"[:300])
                rows += facts.rows
                if len(rows) >= BATCH:
                    yield as_batch()
                    rows = []
        if rows:
            yield as_batch()

    return files.select("model", "path", F.col("content").cast("binary").alias("content"), *(["format"] if many else [])).mapInArrow(run, FACT)


def decode_text(raw: bytes) -> str:
    """UTF-8 or UTF-16, told by the byte order mark; without one, NUL bytes at even or odd places tell UTF-16."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16")
    if len(raw) >= 2 and raw[1] == 0 and raw[0] != 0:
        return raw.decode("utf-16-le")
    if len(raw) >= 2 and raw[0] == 0 and raw[1] != 0:
        return raw.decode("utf-16-be")
    return raw.decode("utf-8")


def decoded(content: Column) -> Column:
    """The same natively, on a binary column."""
    first = F.hex(F.substring(content, 1, 2))
    bom8 = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    return (
        F.when(bom8, F.decode(F.substring(content, 4, 2**31 - 1), "UTF-8"))
        .when(first.isin("FFFE", "FEFF"), F.regexp_replace(F.decode(content, "UTF-16"), "\\A\ufeff", ""))
        .when(first.rlike("^(?!00)..00$"), F.decode(content, "UTF-16LE"))
        .when(first.rlike("^00(?!00)..$"), F.decode(content, "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*", model: Column | None = None) -> DataFrame:
    """model, path, content of all files below ``folder`` whose names match; the model is the item folder's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select((item_of(F.col("path")) if model is None else model).alias("model"), "path", "content")


def item_of(path: Column) -> Column:
    """The item folder of a file: what lies above ``definition`` (or ``definition.mobile``), else the file's folder."""
    above = F.regexp_extract(path, r"\A(.*?)/definition(?:\.mobile)?/", 1)
    return F.when(above != "", above).otherwise(F.regexp_replace(path, r"/[^/]*\z", ""))


def inside_definition(path: Column) -> Column:
    """A file's path below its definition folder; null for files outside one."""
    return F.nullif(F.regexp_extract(path, r"/definition(?:\.mobile)?/(.*)\z", 1), F.lit(""))


def display_names(files: DataFrame) -> DataFrame:
    """model, display_name of the items' ``.platform`` files."""
    text = decoded(F.col("content"))
    return files.where(F.col("path").rlike(r"/\.platform\z")).select("model", F.get_json_object(text, "$.metadata.displayName").alias("display_name"))


def format_of(path: Column, content: Column) -> Column:
    """Which reader a file wants: tmdl, tmsl, archive, backup, pbir, app source, query log or none, by its name and first bytes."""
    head, name = F.hex(F.substring(content, 1, 4)), F.lower(path)
    return (
        F.when(name.endswith(".tmdl"), "tmdl")
        .when(head.startswith("504B0304"), F.when(name.rlike(r"\.(xlsx|xlsm)\z"), "workbook").when(name.endswith(".vpax"), "vpax").otherwise("archive"))
        .when(F.regexp_replace(F.hex(F.substring(content, 1, 120)), "00", "").contains(b"STREAM_STORAGE_SIGNATURE".hex().upper()), "backup")
        .when(name.rlike(r"/definition(\.mobile)?/.*\.json\z") | name.endswith("definition.pbir"), "pbir")
        .when(name.rlike(r"(\.bim|datamodelschema|\.json)\z"), "tmsl")
        .when(name.rlike(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)\z"), "app")
        .when(name.rlike(r"\.(csv|log|gz)\z"), "query_log")
    )


def typed(facts: DataFrame, kind: str, props: str) -> DataFrame:
    """The facts of one kind with their properties as columns of the given types."""
    own = facts.where(F.col("kind") == kind).withColumn("p", F.from_json("props", props))
    return own.select("model", "path", "line", "tbl", "name", "seq", "p.*")
