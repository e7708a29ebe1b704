"""Best-fit packing of tokenised documents into sequences of fixed capacity, by linear grouping.

1. Documents are tokenised once; longer ones than the capacity are cut, the first piece taking the
   remainder. Each task counts pieces by length as it goes, so a piece's rank among all pieces of
   its length follows from per-task counts, without a sort or a hot group.
2. Only the histogram of lengths (at most ``capacity`` rows, whatever the input) reaches the driver.
   Large lengths (more than a third, or half, of the capacity: whichever plan is better) are sorted and cut into groups of equal
   cardinality, and each is rounded up to the largest of its group. Over these few sizes,
   configurations (which sizes share a sequence) come from column generation: a linear programme
   whose columns are priced by a knapsack; its solution is rounded down and the rest filled with
   single-pass best patterns.
3. The actual pieces replace the rounded ones, largest first, which only enlarges the gaps.
4. The small pieces, longest first, go into the tightest gap that takes them (best fit); what is
   left opens new sequences the same way. Equal pieces and equal gaps move in bulk, so the plan's
   size depends on the number of distinct lengths, not on the number of documents.
The plan is a table of runs (length, first rank, count, first sequence, offset); each piece finds
its run by binary search in a map over the pieces. Nothing but counts is shuffled.

Defined results: null and empty texts are one end token; repeated rows are packed each; an empty
table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import stage, texts_of, tokenizer_path

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long"
PLACED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary in a tokenizers file.

    Texts go through tiktoken with ranks taken from that file, where its merges stand in the order
    of their ids and it splits texts by the byte-level pattern alone (both checked), which gives the same
    ids in a fifth of the time; vocabularies for which that does not hold, texts with a special token's
    string, and texts whose white-space runs are too long for that pattern's matcher go through the
    tokenizers library.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not whole.get("normalizer")
        if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"] if "".join(m.split(" ") if isinstance(m, str) else m) in vocab]
        letters = byte_letters()
        if merged != sorted(merged) or any(c not in letters for k in vocab for c in k):
            return None
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
            except ValueError:  # the matcher's stack is bounded: some hundred thousand spaces in a row exceed it
                pass
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(1)
def byte_bpe(path: str) -> ByteBpe:
    """Loaded once in a Python worker."""
    return ByteBpe(path)


def tokenise(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """The pieces of all documents, each with its task and its rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ranks, end = byte_bpe(vocabulary), Counter(), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(bpe.encode, texts_of(batch.column(1))), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                size = (n - 1) % capacity + 1
                for piece in range((n - 1) // capacity + 1):
                    part = memoryview(ids)[4 * at : 4 * (at + size)]
                    rows.append((doc_id, piece, at, size, zlib.crc32(part), task, ranks[size]))
                    ranks[size] += 1
                    at, size = at + size, capacity
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES_SCHEMA)


def linear_groups(counts: dict[int, int], least: int, groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces) of the lengths >= least: equal cardinality, each rounded up to its group's largest."""
    sizes = sorted((s for s in counts if s >= least), reverse=True)
    total = sum(counts[s] for s in sizes)
    if not total:
        return []
    share, out, room, top = -(-total // groups), [], 0, 0
    for s in sizes:
        left = counts[s]
        while left:
            if not room:
                room, top = share, s
                out.append([s, 0])
            take = min(left, room)
            out[-1][1] += take
            left, room = left - take, room - take
    merged: dict[int, int] = defaultdict(int)
    for s, n in out:
        merged[s] += n
    return sorted(merged.items(), reverse=True)


def _knapsack(sizes: list[int], values: np.ndarray, most: list[int], capacity: int) -> list[int]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack, capped by what is there)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        best[w], last[w] = best[w - 1], -2
        for i, s in enumerate(sizes):
            if s <= w and best[w - s] + values[i] > best[w] + 1e-12:
                best[w], last[w] = best[w - s] + values[i], i
    out, w = [0] * len(sizes), capacity
    while w > 0:
        i = last[w]
        if i == -2:
            w -= 1
        else:
            out[i] += 1
            w -= sizes[i]
    return [min(a, b) for a, b in zip(out, most, strict=True)]


def configurations(grouped: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, times) that hold all grouped pieces: column generation over the few sizes, until no column improves the plan."""
    if not grouped:
        return []
    sizes, demand = [s for s, _ in grouped], np.array([n for _, n in grouped], float)
    m = len(sizes)
    columns = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    basis = list(range(m))
    x = np.zeros(m)
    met: set[tuple[int, ...]] = set()
    while tuple(sorted(basis)) not in met:  # a basis that comes back would come back for ever
        met.add(tuple(sorted(basis)))
        b = np.array([columns[j] for j in basis], float).T
        x = np.linalg.solve(b, demand)
        duals = np.linalg.solve(b.T, np.ones(m))
        new = _knapsack(sizes, duals, [capacity // s for s in sizes], capacity)
        if np.dot(duals, new) <= 1 + 1e-9:
            break
        direction = np.linalg.solve(b, np.array(new, float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        columns.append(new)
        basis[leaves] = len(columns) - 1
    left = np.array([n for _, n in grouped])
    out = []
    for j, times in sorted(zip(basis, x, strict=True), key=lambda p: -p[1]):
        c = np.array(columns[j])
        used = c > 0
        times = min(int(max(0, times) + 1e-6), *(left[used] // c[used])) if used.any() else 0
        if times > 0:
            out.append((columns[j], int(times)))
            left = left - c * times
    while left.any():  # what rounding down left over: the fullest pattern, as often as it fits
        c, room = np.zeros(m, int), capacity
        for i, s in enumerate(sizes):
            c[i] = min(left[i], room // s)
            room -= c[i] * s
        used = c > 0
        times = int((left[used] // c[used]).min())
        out.append((c.tolist(), times))
        left = left - c * times
    return out


def plan(counts: dict[int, int], capacity: int, groups: int = 32) -> tuple[np.ndarray, int]:
    """The best of the plans that call pieces large from a third and from half of the capacity on."""
    return min((plan_with(counts, capacity, groups, share) for share in (1 / 3, 1 / 2)), key=lambda p: p[1])


def plan_with(counts: dict[int, int], capacity: int, groups: int, large_share: float) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset), and the number of sequences.

    ``counts``: pieces by length. A run puts ``count`` pieces of one length, in rank order, each
    into the next sequence, at the same offset.
    """
    least = int(capacity * large_share) + 1
    next_rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [first sequence, count]
    sequences = 0

    def place(length: int, first: int, count: int, gap: int) -> None:
        runs.append((length, next_rank[length], count, first, capacity - gap))
        next_rank[length] += count

    large = [[s, counts[s]] for s in sorted((s for s in counts if s >= least), reverse=True)]
    grouped = linear_groups(counts, least, groups)
    # the actual pieces of each group, largest first
    supply, at = [], 0
    for _, need in grouped:
        mine = []
        while need:
            take = min(need, large[at][1])
            mine.append([large[at][0], take])
            large[at][1] -= take
            need -= take
            at += not large[at][1]
        supply.append(mine[::-1])
    for config, times in configurations(grouped, capacity):
        open_runs = [[sequences, times, capacity]]  # first sequence, count, gap
        sequences += times
        for i, copies in enumerate(config):
            for _ in range(copies):
                after = []
                for first, count, gap in open_runs:
                    while count:
                        length, there = supply[i][-1]
                        take = min(count, there)
                        place(length, first, take, gap)
                        after.append([first, take, gap - length])
                        first, count = first + take, count - take
                        supply[i][-1][1] -= take
                        if not supply[i][-1][1]:
                            supply[i].pop()
                open_runs = after
        for first, count, gap in open_runs:
            gaps[gap].append([first, count])
    free = sorted(g for g in gaps if g)
    for length in sorted((s for s in counts if s < least), reverse=True):
        left = counts[length]
        while left:
            k = int(np.searchsorted(free, length))
            if k == len(free):  # nothing takes it: open sequences, full of this length
                per = capacity // length
                fresh = -(-left // per)
                if capacity not in gaps or not gaps[capacity]:
                    gaps[capacity] = []
                    free.append(capacity)
                gaps[capacity].append([sequences, fresh])
                sequences += fresh
                continue
            gap = free[k]
            first, count = gaps[gap][-1]
            take = min(left, count)
            place(length, first, take, gap)
            left -= take
            if take == count:
                gaps[gap].pop()
                if not gaps[gap]:
                    free.pop(k)
            else:
                gaps[gap][-1] = [first + take, count - take]
            rest = gap - length
            if rest:
                if not gaps[rest]:
                    free.insert(int(np.searchsorted(free, rest)), rest)
                gaps[rest].append([first, take])
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return table, sequences


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, groups: int = 32) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    pieces = stage(tokenise(docs, id_col, text_col, capacity, end_id, vocabulary or tokenizer_path("byte_bpe_50k.json")), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity, groups)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        stride = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1
            placed = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(placed), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank"))
    return ranked.mapInArrow(run, PLACED_SCHEMA)
