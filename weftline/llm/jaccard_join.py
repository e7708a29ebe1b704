"""Exact near-duplicate join in the metric space of Jaccard distance, by pivots and regions.

Sets are distinct five-word shingles (64-bit hashes); equal sets are one point. Two points link when
intersection / union >= 0.8, that is within distance 0.2.

1. First-level pivots are single shingles as one-element sets: two documents that share nothing are at
   distance 1 from each other, so documents alone cannot part a corpus. In one global order (rare before
   frequent, then by hash) a point's window is its first n - ceil(0.8 n) + 1 shingles: a partner within
   distance 0.2 lacks at most a fifth of them, so every linked pair meets in a region. Regions larger
   than a block are dealt out in pairs of blocks.
2. Inside regions, parity sketches (their Hamming distance is a lower bound of the sets' symmetric
   difference) exclude what cannot link. What remains ties points into classes; no link crosses classes.
3. Each class's whole sets meet once, in one task, or for large classes in pairs of blocks. There
   documents are the pivots: exact Jaccard distances make Voronoi regions, members within twice the
   threshold of a region's border (triangle inequality) are copied into it, regions join recursively,
   and leaves compare whole sets. A task returns for each member its number of links and the least
   point it is tied to, never the pairs, so a group's pairs are compared but not written.
Bounds only exclude pairs that cannot link, so nothing is lost. Frequent shingles (the order) are
counted over all points; the count from which on a shingle is called frequent rises until their
list is small enough to broadcast, which changes the cost, never the result.

Defined results: null texts, and texts without words, have an empty set and link with nothing; fewer
than five words form one shingle; copies share a component and link with each other; rows with equal ids
are rows of their own, named alike; null ids never name a component that has another id; tables may be
empty; other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import bounds, discard, partitions, stage, tagged, texts_of, without

WORDS, PERCENT = 5, 80
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A frequent list longer than this is not broadcast; the limit of frequency doubles instead.
MOST_FREQUENT = 1_000_000
#: Members that meet in one task: of a first-level region, and of a class (there also so many shingles).
REGION, BLOCK, BLOCK_SHINGLES = 4096, 1024, 2_000_000
#: What a task remembers, to send equal rows once, before it starts anew.
REMEMBERED = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (constants of a public finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    acc = np.full(n, min(len(h), WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(len(h), WORDS)):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def sketch(values: np.ndarray) -> bytes:
    """Parity of the hashes per bit, of a width (a power of two, 64 at least) of a bit for each element or more."""
    width = 64
    while width < len(values):
        width *= 2
    bits = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, width_bytes: int) -> np.ndarray:
    """A sketch at a smaller width: parities of halves add up."""
    a = np.frombuffer(raw, np.uint64)
    while len(a) * 8 > width_bytes:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def most_apart(a, b):
    """The largest symmetric difference with which sets of these sizes still link."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def points(docs: DataFrame, id_col: str, text_col: str, tag_col: str | None = None) -> DataFrame:
    """doc_id, tag, row_seq, n, key (128 bits of the set), and once per task and key the set and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, met = WordHashes(), set()
        for batch in batches:
            n, key, sets, sketches = [], [], [], []
            for text in texts_of(batch.column(3)):
                s = shingles(text, hashes)
                raw = np.ascontiguousarray(s, "<u8").tobytes()
                k = xxhash.xxh3_128_digest(raw)
                n.append(len(s))
                key.append(k)
                new = len(s) > 0 and k not in met
                if len(met) > REMEMBERED:
                    met.clear()
                met.add(k)
                sets.append(raw if new else None)
                sketches.append(sketch(s) if new else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "tag", "row_seq", "n", "key", "set", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(tag_col) if tag_col else F.lit(None)).cast("binary").alias("tag"), F.monotonically_increasing_id().alias("row_seq"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag binary, row_seq long, n long, key binary, set binary, sketch binary")


def _prefixes(raw: bytes, frequent: np.ndarray | None) -> np.ndarray:
    """The first shingles in the global order: frequent ones last, then by hash."""
    s = unpack(raw)
    k = prefix_length(len(s))
    if frequent is None or not len(frequent):
        return s[:k]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often]
    return rare[:k] if len(rare) >= k else np.concatenate([rare, s[often][: k - len(rare)]])


def frequent_shingles(sets: DataFrame, least: int = 64) -> np.ndarray:
    """Shingles in the first places (by hash) of more than ``least`` points, or of more where these are too many.

    Tasks count before they send: shingles met once go as bare numbers, others with their counts.
    """
    width = partitions(sets.sparkSession)
    buckets = 4 * width

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            rows: dict[int, list] = {}
            for at, part in enumerate((n == 1, n > 1)):
                by = (tokens[part] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(by, kind="stable")
                t, c, edges = tokens[part][order], n[part][order], np.searchsorted(by[order], np.arange(buckets + 1))
                for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                    of = slice(edges[b], edges[b + 1])
                    rows.setdefault(b, [b""] * 3)[at : at + 1 + at] = [t[of].tobytes(), c[of].astype("<i8").tobytes()][: 1 + at]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(list(rows), pa.int32())} | {c: pa.array([x[i] for x in rows.values()], pa.binary()) for i, c in enumerate(("once", "tokens", "counts"))})

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(_prefixes(raw, None))
                size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(b, []).append(tuple(raw))
        for b in list(parts):
            once, tokens, counts = (b"".join(x) for x in zip(*parts.pop(b), strict=True))
            once, tokens, counts = unpack(once), unpack(tokens), np.frombuffer(counts, "<i8")
            t, where = np.unique(np.concatenate([once, tokens]), return_inverse=True)
            n = np.bincount(where, np.concatenate([np.ones(len(once), np.int64), counts]), len(t)).astype(np.int64)
            often = n > least
            yield pa.RecordBatch.from_arrays([pa.array(t[often].astype(np.int64)), pa.array(n[often])], names=["token", "n"])

    blocks = sets.select("set").mapInArrow(deal, "bucket int, once binary, tokens binary, counts binary")
    counts = stage(blocks.repartition(width, "bucket").mapInArrow(count, "token long, n long"), "frequent", rows=1000)
    limit = least
    while counts.where(F.col("n") > limit).count() > MOST_FREQUENT:
        limit *= 2
    found = counts.where(F.col("n") > limit).select("token").toPandas()["token"]  # at most MOST_FREQUENT
    discard(counts)
    return np.sort(found.to_numpy(np.int64).astype(np.uint64))


def regions(sets: DataFrame, frequent: np.ndarray, most: int = REGION) -> DataFrame:
    """First-level regions of two rows or more, those of equal members once: cell, chunk, row numbers (packed).

    Rows stream sorted by shingle, so no region is held: beyond ``most`` members it goes on in a new chunk.
    """
    spark = sets.sparkSession
    known = spark.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [_prefixes(raw, known.value) for raw in batch.column(0).to_pylist()]
            if tokens:
                seq = np.repeat(batch.column(1).to_numpy(), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(seq)], names=["token", "row_seq"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        met: set[bytes] = set()
        out: list[tuple] = []
        t, k, chunk = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def put(token: int, members: np.ndarray, ends: bool) -> None:
            nonlocal chunk
            raw = members.tobytes()
            if chunk or not ends:
                out.append((xxhash.xxh3_64_intdigest(int(token).to_bytes(8, "little", signed=True), 1) - (1 << 63), chunk, raw))
            elif len(members) > 1:
                cell = xxhash.xxh3_128_digest(raw)
                if cell not in met:
                    if len(met) > REMEMBERED:
                        met.clear()
                    met.add(cell)
                    out.append((int.from_bytes(cell[:8], "little", signed=True), 0, raw))
            chunk = 0 if ends else chunk + 1

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["cell", "chunk", "rows"])
            out.clear()
            return batch

        for batch in batches:
            t, k = np.concatenate([t, batch.column(0).to_numpy()]), np.concatenate([k, batch.column(1).to_numpy()])
            if not len(t):
                continue
            at = bounds(t)
            many = np.flatnonzero((np.diff(at) > 1) | (chunk > 0) & (at[:-1] == 0))
            for a, z in zip(at[many].tolist(), at[many + 1].tolist(), strict=True):
                put(t[a], k[a:z], True)
            t, k = t[at[-1] :], k[at[-1] :]
            while len(t) > most:
                put(t[0], k[:most], False)
                t, k = t[most:], k[most:]
            if out:
                yield sent()
        if len(t):
            put(t[0], k, True)
        if out:
            yield sent()

    rows = sets.select("set", "row_seq").mapInArrow(deal, "token long, row_seq long")
    spread = rows.repartition(partitions(spark), "token").sortWithinPartitions("token", "row_seq")
    cells = stage(spread.mapInArrow(gather, "cell long, chunk int, rows binary").dropDuplicates(), "cells", rows=2000)
    known.unpersist()
    return cells


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows that agree in the first ``keys`` columns of sorted input."""
    held: tuple | None = None
    columns: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(i).to_numpy() for i in range(keys)]
        rest = [c.to_pylist() for c in batch.columns[keys:]]
        at = [*bounds(*key).tolist(), batch.num_rows]
        for a, z in zip(at[:-1], at[1:], strict=True):
            mine = tuple(int(c[a]) for c in key)
            if mine == held:
                for have, more in zip(columns, rest, strict=True):
                    have += more[a:z]
            else:
                if held is not None:
                    yield held, columns
                held, columns = mine, [c[a:z] for c in rest]
    if held is not None:
        yield held, columns


def _tie(label: np.ndarray, x: int, others: np.ndarray) -> None:
    """Give x and the others the least of their labels, and all that shared one of theirs."""
    if len(others) and (label[others] != label[x]).any():
        mine = np.unique(np.append(label[others], label[x]))
        label[np.isin(label, mine)] = mine[0]


def near_classes(n: np.ndarray, sketches: list[bytes], part: np.ndarray, across: bool) -> np.ndarray:
    """Labels (least index) of what pairs tie together that sizes and sketches do not exclude; ``across``: pairs of different parts alone."""
    label = np.arange(len(n))
    width = np.array([len(s) for s in sketches])
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        both = np.concatenate([mine, np.flatnonzero(width == 2 * w)])  # a partner is at most 5/4 as large
        if len(both) < 2:
            continue
        words = np.stack([fold(sketches[i], w) for i in both])
        step = max(1, 4_000_000 // (words.size))
        for a in range(0, len(mine), step):
            xs = np.arange(a, min(a + step, len(mine)))
            apart = np.bitwise_count(words[xs, None, :] ^ words[None, :, :]).sum(2, dtype=np.int64)
            nx, ny = n[both[xs]][:, None], n[both][None, :]
            near = (apart <= most_apart(nx, ny)) & (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny))
            near[np.arange(len(xs)), xs] = False
            if across:
                near &= part[both[xs]][:, None] != part[both][None, :]
            for i in np.flatnonzero(near.any(1)).tolist():
                _tie(label, both[xs[i]], both[near[i]])
    return label


def candidate_ties(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """Step 2: (a, b), each point with the least point of what its region's sketches tie it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, chunk, nb, raw = (c.to_pylist() for c in batch.columns)
            rows = [np.frombuffer(x, np.int64) for x in raw]
            many = [len(x) for x in rows]
            spread = lambda c, ty: pa.array(np.repeat(np.array(c, ty), many))
            yield pa.RecordBatch.from_arrays([spread(cell, np.int64), spread(chunk, np.int32), spread(nb, np.int32), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], names=["cell", "chunk", "nb", "row_seq"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for (_, i, j), (pid, n, sketches, part) in _groups(batches, 3):
            pid, first = np.unique(np.array(pid, np.int64), return_index=True)
            if len(pid) < 2:
                continue
            label = near_classes(np.array(n, np.int64)[first], [sketches[x] for x in first], np.array(part)[first], i != j)
            moved = np.flatnonzero(label != np.arange(len(label)))
            new = set(zip(pid[moved].tolist(), pid[label[moved]].tolist(), strict=True)) - met
            if len(met) > REMEMBERED:
                met.clear()
            met |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new, strict=True)], names=["a", "b"])

    chunks = cells.groupBy("cell").agg((F.max("chunk") + 1).alias("nb")).where("nb > 1")
    sized = cells.join(chunks, "cell", "left").select("cell", "chunk", F.coalesce("nb", F.lit(1)).alias("nb"), "rows")
    members = sized.mapInArrow(run, "cell long, chunk int, nb int, row_seq long").join(ids, "row_seq")
    tasks = _blocks(members, "cell", "nb", "chunk", ["pid", "n", "sketch", "chunk"])
    return tasks.mapInArrow(tie, "a long, b long").dropDuplicates()


def _blocks(rows: DataFrame, group: str, count: str, block: str, columns: list[str]) -> DataFrame:
    """Rows dealt to the tasks (group, i, j) in which their block meets itself and each other block, sorted so."""
    ends = F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda o: F.struct(F.least(F.col(block), o).alias("i"), F.greatest(F.col(block), o).alias("j")))
    dealt = rows.select(group, F.inline(ends), *[F.col(c) if c != block else F.col(c).alias("block") for c in columns])
    return dealt.repartition(partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def components(ties: DataFrame, tag: str) -> DataFrame:
    """Label of each tied point (pid -> label): least neighbour's label, then the label's label, until nothing changes."""
    edges = stage(ties.select("a", "b").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(), f"{tag}-edges")
    labels = stage(edges.groupBy(F.col("a").alias("pid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{tag}-labels")
    while True:
        around = edges.join(labels.select(F.col("pid").alias("b"), "label"), "b").groupBy(F.col("a").alias("pid")).agg(F.min("label").alias("around"))
        near = stage(labels.join(around, "pid").select("pid", F.col("label").alias("was"), F.least("label", "around").alias("label")), f"{tag}-near")
        up = near.select(F.col("pid").alias("label"), F.col("label").alias("up"))
        new = stage(near.join(up, "label", "left").select("pid", "was", F.coalesce(F.least("up", "label"), "label").alias("label")), f"{tag}-labels")
        discard(labels, near)
        labels = new
        if new.where("label <> was").isEmpty():
            discard(edges)
            out = labels.select("pid", "label")
            out._weft_path = labels._weft_path
            return out


#: Bits of the table that keeps most sets that no class needs out of the shuffle: at least 8 for a point, up to this. It may let some through; the join drops them.
MOST_SLOTS = 1 << 26


def needed_sets(members: DataFrame, sets: DataFrame, of: int) -> DataFrame:
    """``members`` with their sets; of the others' sets few are moved."""
    slots = 1 << 12
    while slots < min(8 * of, MOST_SLOTS):
        slots *= 2
    slot = F.pmod(F.xxhash64("row_seq"), F.lit(slots))
    wanted = members.withColumnRenamed("pid", "row_seq")
    words = wanted.groupBy(F.shiftright(slot, 5).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int"))).alias("bits"))
    table = np.zeros(slots // 32, np.uint32)
    found = words.toPandas()  # at most MOST_SLOTS / 32 rows
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    bits = sets.sparkSession.sparkContext.broadcast(table)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            keep = (bits.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    some = sets.select("row_seq", slot.alias("slot"), "set").mapInArrow(likely, "row_seq long, slot long, set binary")
    return some.join(wanted, "row_seq").drop("slot").withColumnRenamed("row_seq", "pid")


def set_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, a column for each element that two sets or more have: intersections become counts of common bits."""
    size = np.array([len(s) for s in sets])
    u, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    words = max(1, -(-int(shared.sum()) // 64))
    column = np.cumsum(shared) - 1
    own, token = np.repeat(np.arange(len(sets)), size), where
    keep = shared[token]
    own, column = own[keep], column[token[keep]]
    bits = np.zeros(len(sets) * words, np.uint64)
    if len(own):
        slot = own * words + (column >> 6)  # ascending: sets are sorted
        at = bounds(slot)
        bits[slot[at]] = np.bitwise_or.reduceat(np.uint64(1) << (column & 63).astype(np.uint64), at)
    return bits.reshape(len(sets), words)


def voronoi_links(n: np.ndarray, bits: np.ndarray, leaf: int = 256, pivots: int = 8) -> np.ndarray:
    """Which sets link (a square of booleans): recursive Voronoi regions of documents under Jaccard distance.

    A member belongs to its nearest pivot's region and is copied into each whose pivot is at most twice the
    threshold further: a partner across the border is within the threshold of it, so it meets it there.
    """
    linked = np.zeros((len(n), len(n)), bool)

    def common(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        step = max(1, 4_000_000 // max(1, len(ys) * bits.shape[1]))
        return np.concatenate([np.bitwise_count(bits[xs[a : a + step], None, :] & bits[None, ys, :]).sum(2, dtype=np.int64) for a in range(0, len(xs), step)])

    work = [(np.arange(len(n)), np.arange(len(n)))]
    while work:
        home, mine = work.pop()
        inside = None
        if len(mine) > leaf:
            p = mine[np.linspace(0, len(mine) - 1, pivots).astype(int)]
            both = common(mine, p)
            d = 1 - both / (n[mine][:, None] + n[p][None, :] - both)
            nearest = d.argmin(1)
            inside = d <= d.min(1, keepdims=True) + 2 * (100 - PERCENT) / 100 + 1e-9
        if inside is None or inside.sum(0).max() > 0.7 * len(mine):
            both = common(home, mine)
            linked[np.ix_(home, mine)] |= 100 * both >= PERCENT * (n[home][:, None] + n[mine][None, :] - both)
        else:
            at_home = np.isin(mine, home)
            work += [(mine[at_home & (nearest == j)], mine[inside[:, j]]) for j in range(pivots) if (at_home & (nearest == j)).any()]
    np.fill_diagonal(linked, False)
    return linked


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Point, copies and links of each task's members: whole sets are compared."""
    for (_, i, j), (pid, copies, raw, block) in _groups(batches, 3):
        if len(pid) > 1:
            sets = [unpack(x) for x in raw]
            linked = voronoi_links(np.array([len(s) for s in sets]), set_bits(sets))
            if i != j:
                linked &= np.not_equal.outer(block, block)
            yield np.array(pid, np.int64), np.array(copies, np.int64), linked


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[np.ndarray] = []
    for pid, copies, linked in _compared(batches):
        label = np.arange(len(pid))
        order = np.argsort(pid)  # labels are least points
        pid, copies, linked = pid[order], copies[order], linked[np.ix_(order, order)]
        some = np.flatnonzero(linked.any(1))
        for x in some.tolist():
            _tie(label, x, np.flatnonzero(linked[x]))
        out.append(np.stack([pid[some], (linked[some] * copies).sum(1), pid[label[some]]], 1))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=["a", "links", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=["a", "links", "b"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pid, _, linked in _compared(batches):
        x, y = np.nonzero(np.triu(linked))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(pid[x], pid[y])), pa.array(np.maximum(pid[x], pid[y]))], names=["a", "b"])


def class_tasks(docs: DataFrame, id_col: str, text_col: str, tag_col: str | None = None, region: int = REGION, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 1 and 2: (rows, points, the classes' members with their sets, dealt to tasks). A point's number is that of its first row."""
    rows = stage(points(docs, id_col, text_col, tag_col), "points", rows=1000)
    sets = rows.where(F.col("set").isNotNull())
    distinct = stage(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row_seq").alias("pid")), "distinct")
    ids = stage(sets.select("row_seq", "key", "sketch").join(distinct.select("key", "pid", "n"), "key").drop("key"), "ids")
    cells = regions(sets, frequent_shingles(sets), region)
    ties = stage(candidate_ties(cells, ids), "ties")
    discard(cells, ids)
    classes = components(ties, "classes")
    sized = classes.join(distinct.select("pid", "n", "copies"), "pid")
    counts = sized.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    members = stage(sized.join(counts, "label").select("label", "pid", "copies", "nb", F.pmod(F.xxhash64("pid"), F.col("nb")).cast("int").alias("blk")), "members")
    discard(ties, classes)
    dealt = stage(needed_sets(members, sets, distinct.count()), "whole")
    discard(members)
    return rows, distinct, _blocks(dealt, "label", "nb", "blk", ["pid", "copies", "set", "blk"])


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, tag, row_seq, n_shingles, component (its number, null without words), component_id, and n_links: the other rows that link with it, copies of its own text included."""
    rows, distinct, tasks = class_tasks(docs, id_col, text_col, tag_col, region, block)
    counted = stage(tasks.mapInArrow(_counted, "a long, links long, b long"), "counted", rows=1000)
    labels = components(counted.where("a <> b"), "links")
    links = counted.groupBy(F.col("a").alias("pid")).agg(F.sum("links").alias("links"))
    named = stage(distinct.join(labels, "pid", "left").join(links, "pid", "left").withColumn("label", F.coalesce("label", "pid")), "named")
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(groups, "label").select("key", F.col("label").alias("component"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "tag", "row_seq", "n", "key").join(classes, "key", "left")
    columns = ["doc_id", "tag", "row_seq", "component", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = stage(out.select(*columns), "groups")
    discard(rows, distinct, counted, labels, named)
    return out


def link_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None, region: int = REGION, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, tag, row_seq, point; all links between points: a < b). Copies are one point; the pairs of a group grow with its square."""
    rows, distinct, tasks = class_tasks(docs, id_col, text_col, tag_col, region, block)
    pairs = stage(tasks.mapInArrow(_paired, "a long, b long"), "pairs", rows=1000)
    return rows.select("doc_id", "tag", "row_seq", "key").join(distinct.select("key", F.col("pid").alias("point")), "key", "left").drop("key"), pairs


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (the first such row; null ids last); texts without words all stay."""
    rows, tag = tagged(docs)
    groups = link_groups(rows, id_col, text_col, tag).where("component is not null")
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_seq")).alias("best"))
    others = groups.join(best, "component").where(F.col("row_seq") != F.col("best.row_seq"))
    return without(rows, tag, stage(others.select(F.col("tag").alias(tag)), "others"))
