"""Quality rules with thresholds that adapt to each language and source.

Row-local measures come from one pass over the texts. For each measure and each (language, source)
a mergeable quantile sketch is built: logarithmic bins of 2 % relative width with exact counts, so
sketches add up bin by bin, in any order and with the same result (per group, and again per
language and over all, towards which small groups lean). A group's limit for a measure is its upper
quartile plus a multiple of the spread between that and the median, or plus a least margin where a
clean group has no spread; the limits are joined back and the rows filtered. Besides, the two base rules hold everywhere: fewer than 50 words, or
more than half of the words in repeated three-word windows.

Defined results: null and empty texts have no words and fail; null languages and sources form
groups of their own; an empty table gives an empty result; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import stage, tagged, texts_of, without

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
#: The symbols that the rules count.
SYMBOLS = b"#*$%&|<>"
#: Measures with adaptive limits: expression, and the least spread that a limit leaves (in the measure's unit).
SIGNALS = {
    "symbols_per_word": ("n_symbols / n_words", 0.10),
    "dup_line_share": ("n_dup_lines / n_lines", 0.35),
    "repeat_share": ("n_repeat_words / n_words", 0.45),
    "mean_word_chars": ("word_chars / n_words", 2.0),
}
GAMMA, FLOOR = 1.02, 1e-3


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of characters other than ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    space = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    symbols = sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeated = 0
    if n > 3:
        k = len(known)
        if k < 2_000_000:
            keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:
            pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
            keys = pairs * k + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for shift in range(3):
                cover[shift : shift + n - 2] |= twice
            repeated = int(cover.sum())
    return n, len(text) - space, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(known)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("lang", "source"), extra: str | None = None) -> DataFrame:
    """doc_id, tag (the binary column ``extra``, or null), the carried columns as strings, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in texts_of(batch.column(batch.num_columns - 1))]
            columns = zip(*found, strict=True) if found else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[:-1], *COUNTS])

    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(extra) if extra else F.lit(None)).cast("binary").alias("tag"), *(F.col(c).cast("string").alias(a) for c, a in zip(carry, names, strict=True)), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, ", ".join(["doc_id long", "tag binary", *(f"{a} string" for a in names), *(f"{c} long" for c in COUNTS)]))
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def sketch_bins(value):
    """The logarithmic bin of a measure."""
    return F.floor(F.log(F.greatest(value, F.lit(FLOOR)) / FLOOR) / math.log(GAMMA)).cast("int")


def limits(rows: DataFrame, keys: list[str], reach: float = 6.0, weight: int = 200) -> DataFrame:
    """Per group of ``keys``: the upper limit of each signal.

    A group's own limit, from its sketch, and the limit of the group around it (the language, then all
    rows) are averaged: the own one weighs as much as the group has rows, the other ``weight`` rows. So a
    small group leans on what is around it, and no number of rows switches from one limit to another.
    """
    signals = F.explode(F.map_from_arrays(F.array(*map(F.lit, SIGNALS)), F.array(*(F.expr(e).cast("double") for e, _ in SIGNALS.values())))).alias("signal", "value")
    fine = rows.where("n_words > 0").select(*keys, signals).withColumn("bin", sketch_bins(F.col("value"))).groupBy(*keys, "signal", "bin").agg(F.count("*").alias("n"))
    fine = stage(fine, "sketches")
    found = []
    for depth in range(len(keys) + 1):  # sketches of a coarser level are sums of the finer ones
        level = keys[:depth]
        merged = fine.groupBy(*level, "signal", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*level, "signal").orderBy("bin")
        ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*level, "signal")))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
        value = lambda b: FLOOR * F.pow(F.lit(GAMMA), b + 0.5)
        q = ranked.groupBy(*level, "signal").agg(at(0.5).alias("b50"), at(0.75).alias("b75"), F.max("total").alias("total"))
        slack = F.element_at(F.create_map(*(x for k, (_, s) in SIGNALS.items() for x in (F.lit(k), F.lit(s)))), F.col("signal"))
        limit = value(F.col("b75")) + F.greatest(reach * (value(F.col("b75")) - value(F.col("b50"))), slack)
        found.append(q.select(*level, "signal", limit.alias(f"limit_{depth}"), F.col("total").alias(f"total_{depth}")))
    groups = fine.select(*keys, "signal").distinct()
    for depth, level in enumerate(found):
        cond = groups["signal"] == level["signal"]
        for k in keys[:depth]:
            cond = cond & groups[k].eqNullSafe(level[k])
        groups = groups.join(level, cond).select(*(groups[c] for c in groups.columns), level[f"limit_{depth}"], level[f"total_{depth}"])
    chosen = F.col("limit_0")
    for depth in range(1, len(keys) + 1):
        chosen = (F.col(f"limit_{depth}") * F.col(f"total_{depth}") + chosen * weight) / (F.col(f"total_{depth}") + weight)
    return groups.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("signal", chosen.alias("l")))).alias("limits"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 6.0, min_words: int = 50, extra: str | None = None) -> DataFrame:
    """One row per input row: doc_id, tag (the binary column ``extra``, or null), the counts, base_failed, over (signals beyond their limits), kept."""
    rows = stage(measures(docs, id_col, text_col, (lang_col, source_col), extra), "measures", rows=1000)
    lim = limits(rows, [lang_col, source_col], reach)
    r, g = rows.alias("r"), lim.alias("g")
    on = F.col(f"r.{lang_col}").eqNullSafe(F.col(f"g.{lang_col}")) & F.col(f"r.{source_col}").eqNullSafe(F.col(f"g.{source_col}"))
    over = F.array_compact(F.array(*(F.when(F.expr(f"r.{e.split(' / ')[0]} / r.{e.split(' / ')[1]}") > F.col("g.limits")[k], F.lit(k)) for k, (e, _) in SIGNALS.items())))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = r.join(g, on, "left").select("r.doc_id", "r.tag", *(f"r.{c}" for c in COUNTS), F.when(F.col("r.n_words") > 0, over).alias("over"))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.size("over"), F.lit(0)) <= 0))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, of whatever names.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty. Only tags of
    the rows that go meet the rows again; the texts are not moved.
    """
    rows, tag = tagged(docs)
    narrow = rows.select(F.col(tag).alias("tag"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    goes = judge(narrow, extra="tag", **options).where("not kept").select(F.col("tag").alias(tag))
    return without(rows, tag, stage(goes, "rejected"))
