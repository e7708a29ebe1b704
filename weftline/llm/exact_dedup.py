"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition forms one run: its rows sorted by digest, one row per distinct digest.
Runs then meet in rounds. In round r the 2^b runs whose numbers agree above bit b*(r+1) exchange
and merge (for b = 1 these are the rounds of a binomial tree), each digest apart from the others,
so that no task ever holds more than its share of the digests. A merge reads its runs in sorted
order, compares the whole SHA-256 (the 64-bit hash only sorts and deals out), and retains the best
row of each digest with the number of rows below it. The root's choice then goes down again: to
the runs by digest, and to the rows by run and digest, so a digest that a third of all rows share
is dealt out by run and never gathers in one task.

Defined results: null texts count as empty; of equal rows (same text, length and id) the first
tagged one stays; null ids lose to any other id; an empty table gives an empty result. Only the id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import ASCII_SPACE, bounds, partitions, stage, tagged, without

RUN_SCHEMA = "node long, h long, sha binary, n int, doc_id long, seq long, copies long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiway merge step: rows come sorted by (node, h, sha, best first); equal digests become one row."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t.cast(held.schema)]) if held is not None else t
        t = t.combine_chunks()
        sha = t["sha"].cast(pa.binary(32)).combine_chunks()
        sha = sha.chunk(0) if isinstance(sha, pa.ChunkedArray) else sha
        words = np.frombuffer(sha.buffers()[1], np.uint64, len(sha) * 4, sha.offset * 32).reshape(-1, 4)
        at = bounds(t["node"].to_numpy(), t["h"].to_numpy(), *words.T)
        copies = np.add.reduceat(t["copies"].to_numpy(), at)
        out = t.take(pa.array(at)).set_column(6, "copies", pa.array(copies, pa.int64()))
        yield from out.slice(0, out.num_rows - 1).to_batches()
        held = out.slice(out.num_rows - 1)  # its digest may go on in the next batch
    if held is not None:
        yield from held.to_batches()


def _best_first() -> list:
    return ["node", "h", "sha", F.col("n").desc(), F.col("doc_id").asc_nulls_last(), "seq"]


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, extra: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after all ASCII white space is deleted. The longest original
    text stays, then the smallest id. ``bits``: 2^bits runs meet in one merge.
    ``extra``: a column to carry along, as ``extra``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, ASCII_SPACE + "+", ""), 256)).alias("sha"),
        F.char_length(text).alias("n"),
        F.spark_partition_id().cast("long").alias("node"),
        F.monotonically_increasing_id().alias("seq"),
        *([F.col(extra).alias("extra")] if extra else []),
    ).withColumn("h", F.xxhash64("sha"))
    rows = stage(rows, "digests")
    runs = (
        rows.select("node", "h", "sha", "n", "doc_id", "seq", F.lit(1).cast("long").alias("copies"))
        .sortWithinPartitions(*_best_first())
        .mapInArrow(_merge, RUN_SCHEMA)
    )
    runs = stage(runs, "runs")
    last = runs.agg(F.max("node")).first()[0] or 0
    root = runs
    width = partitions(spark)
    while True:
        root = (
            root.withColumn("node", F.shiftright("node", bits))
            .repartition(width, "h", "node")
            .sortWithinPartitions(*_best_first())
            .mapInArrow(_merge, RUN_SCHEMA)
        )
        last >>= bits
        if not last:
            break
    best = root.select("h", "sha", F.col("doc_id").alias("keep_id"), F.col("seq").alias("keep_seq"), F.col("copies").alias("group_size"))
    down = runs.select("node", "h", "sha").dropDuplicates(["node", "h", "sha"]).join(best, ["h", "sha"])
    return rows.join(down, ["node", "h", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("seq") == F.col("keep_seq")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("seq").alias("row_seq"),
        *(["extra"] if extra else []),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, with all its columns, of whatever names.

    All null and empty texts are equal; which row stays says :func:`group_copies`; an empty table stays
    empty. Only tags of the rows that go meet the rows again; the texts are not moved.
    """
    rows, tag = tagged(docs)
    groups = group_copies(rows, id_col, text_col, extra=tag)
    return without(rows, tag, stage(groups.where("not kept").select(F.col("extra").alias(tag)), "copies"))
