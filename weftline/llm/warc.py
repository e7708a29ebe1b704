"""WARC archives, each compressed with a Zstandard dictionary of its own.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame per record, so every record can be read alone. Each task writes archives of at most
``archive_bytes`` of payload; the dictionary is built from that archive's own records (a bounded,
evenly spaced set of whole records: about ``sample_bytes``). Where they are too few to build one, the
sampled records themselves are the dictionary (raw content), so every archive has one. Archives go
through pyarrow's file systems into a folder that all executors share, under a temporary name until
complete, so a repeated task leaves no half file.

An archive starts with a warcinfo record. A response's block is an HTTP message with the payload, a
revisit's block is the HTTP header alone. Record ids are made from the page's id, the payload's digest
and, for rows that repeat both, the row; so a revisit names its response's record wherever that lies.

Which records are revisits is decided before, from narrow rows of tag, id and digest: of equal payloads of
at least ``min_revisit`` bytes the smallest id is the response. Only the marks of rows whose digest
occurs twice meet the pages again; payloads are not shuffled while these marks are few.

Defined results: a null html is an empty payload; repeated rows of the response's id are responses
too; a null id loses to any other and is a response only where no other is; a null address is left
out of the record; an empty table gives no archives and no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import MARKS, partitions, scratch_path, stage, tagged

SKIPPABLE = 0x184D2A5D
INDEX_SCHEMA = "path string, records long, bytes long"
READ_SCHEMA = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_record string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: " + re.sub(r"[\r\n]+", " ", str(v)) for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


#: A name of our own for ids made from pages (any fixed UUID serves).
PAGES = uuid.UUID("6f0f2f2e-6a52-5f3e-9d0a-2f6b1a3c7d41")


def record_id(page_id: int | None, digest: str, again: bytes | None = None) -> str:
    """A record's id; ``again`` tells rows apart that repeat a page's id and payload."""
    return f"<urn:uuid:{uuid.uuid5(PAGES, f'{page_id}:{digest}:{(again or b"").hex()}')}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def info_record(name: str, date: str) -> bytes:
    body = b"software: weftline\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))]
    return _header(fields) + body + b"\r\n\r\n"


def record(row: dict, date: str) -> bytes:
    """One WARC record. A revisit carries no payload, but the digest and size of the whole one."""
    revisit = row["record_type"] == "revisit"
    body = _http(row["payload_bytes"]) + (b"" if revisit else row["payload"])
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"], row["again"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["uri"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"]) if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-ID", row["page_id"]),
        ("X-Refers-To-Page-ID", row["refers_to"] if revisit else None),
        ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(body)),
    ]
    return _header(fields) + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict | None:
    """The fields of a response or revisit; None for other records."""
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "uri": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": block[block.index(b"\r\n\r\n") + 4 :],
        "record_id": fields["WARC-Record-ID"],
        "refers_to_record": fields.get("WARC-Refers-To"),
    }


def dictionary_of(records: list[bytes], dict_bytes: int, sample_bytes: int) -> bytes:
    """A Zstandard dictionary of evenly spaced records; the end of these records themselves where they are too few to build one."""
    import zstandard

    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = records[::step]
    total = sum(map(len, samples))
    if len(samples) >= 8 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(dict_bytes, total // 8), samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # samples of one kind alone
            pass
    return b"".join(samples)[-dict_bytes:]


def encode_archive(records: list[bytes], dict_bytes: int, sample_bytes: int, level: int) -> Iterator[bytes]:
    import zstandard

    held = dictionary_of(records, dict_bytes, sample_bytes)
    yield struct.pack("<II", SKIPPABLE, len(held)) + held
    data = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_AUTO)
    packer = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True)
    for r in records:
        yield packer.compress(r)


def decode_archive(raw: bytes) -> Iterator[bytes]:
    import zstandard

    magic, n = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    held = raw[8 : 8 + n]
    data = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_AUTO)
    rest = memoryview(raw)[8 + n :]
    while rest:
        unpacker = zstandard.ZstdDecompressor(dict_data=data).decompressobj()
        yield unpacker.decompress(rest)
        rest = rest[len(rest) - len(unpacker.unused_data) :] if unpacker.unused_data else rest[:0]


def plan_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """page_id, uri, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, again (for rows that repeat an id and a payload)."""
    tag_rows, tag = tagged(pages)
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = tag_rows.select(
        F.col(tag).alias("tag"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(uri_col).cast("string").alias("uri"),
        html.alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = stage(rows.select("tag", "page_id", "payload_bytes", F.unhex("payload_digest").alias("digest")), "payloads")
    of_page = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "tag"))
    again = narrow.groupBy("digest").agg(of_page.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    each = narrow.groupBy("digest", "page_id").agg(F.min("tag").alias("own"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    met = narrow.join(again, "digest").join(each.withColumnsRenamed({"digest": "d", "page_id": "p"}), (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    revisit = (F.col("payload_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    repeats = F.when(F.col("own").isNotNull() & (F.col("tag") != F.col("own")), F.col("tag"))
    marks = stage(met.select("tag", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), repeats.alias("again")).where(F.col("revisit") | F.col("again").isNotNull()), "revisits")
    few = marks.limit(MARKS + 1).count() <= MARKS
    revisit = F.coalesce("revisit", F.lit(False))
    return rows.join(F.broadcast(marks) if few else marks, "tag", "left").select(
        "page_id",
        "uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "refers_to",
        "again",
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 12 << 20, dict_bytes: int = 32 << 10, sample_bytes: int = 1 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Write ``plan_records`` rows as ``*.warc.zst`` into ``folder``; returns path, records, bytes per archive.

    ``date``: the records' WARC-Date; pages carry none of their own, so it is the time of writing where it is not given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        part, held, size, count = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            name = f"{root}/part-{part:06d}-{count:04d}.warc.zst"
            scratch, total = f"{name}.{uuid.uuid4().hex}.tmp", 0
            with fs.open_output_stream(scratch, compression=None) as out:
                for chunk in encode_archive([info_record(name.rsplit("/", 1)[1], date), *held], dict_bytes, sample_bytes, level):
                    out.write(chunk)
                    total += len(chunk)
            fs.move(scratch, name)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [len(held)], "bytes": [total]})
            held, size, count = [], 0, count + 1
            return done

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return records.mapInArrow(write, INDEX_SCHEMA)


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that ``index`` (a path column) lists; response payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_record", pa.string())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _fs(path)
                with fs.open_input_stream(name, compression=None) as f:
                    raw = f.read()
                rows = []
                for x in decode_archive(raw):
                    row = parse_record(x)
                    if row is None:
                        continue
                    if row["record_type"] == "response" and hashlib.sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"{path}: the payload of page {row['page_id']} does not match its digest")
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, partitions(index.sparkSession))
    return index.select("path").repartition(n).mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, **columns) -> tuple[DataFrame, str]:
    """Write all pages to new archives in the shared folder; returns the archives' index (staged) and the folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    return stage(write_archives(plan_records(pages, **columns), folder), "warc-index"), folder
