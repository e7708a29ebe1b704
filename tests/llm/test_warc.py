import hashlib

import pytest

from weftline.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first long"


def test_round_trip(spark):
    big = "<p>héllo</p>" * 20
    rows = [(i, f"http://h{i}/", big if i % 3 == 1 else f"<html>{i}</html>" * 30, "x", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "u\r\nv", "", None, None), (None, "n", big, None, None), (1, "again", big, None, None), (103, "s", "tiny", None, None), (104, "s", "tiny", None, None)]
    index, folder = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows)
    want_first = min(r[0] for r in rows if r[2] == big and r[0] is not None)
    for g in got:
        html = {r[2] for r in rows if r[0] == g.page_id}
        assert g.payload_digest in {hashlib.sha256((h or "").encode()).hexdigest() for h in html}
        if g.payload_digest == hashlib.sha256(big.encode()).hexdigest():
            assert g.payload_bytes == len(big.encode())
            assert (g.record_type, g.refers_to) == (("revisit", want_first) if g.page_id != want_first else ("response", None))
        else:
            assert (g.record_type, g.refers_to) == ("response", None)
            assert hashlib.sha256(g.payload).hexdigest() == g.payload_digest
    assert sum(g.record_type == "response" and g.payload_digest == hashlib.sha256(big.encode()).hexdigest() for g in got) == 2
    empty, _ = warc.archive_pages(spark.createDataFrame([], SCHEMA))
    assert warc.read_archives(empty).count() == 0


def test_records_are_valid_and_ids_are_unique(spark):
    big = "<p>some text</p>" * 20
    rows = [(i, f"http://h/{i}", big if i % 2 else f"<p>{i}</p>" * 40, None, None) for i in range(30)] + [(1, "http://h/1", big, None, None)] * 3 + [(None, "n", "", None, None)] * 2
    index, _ = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = warc.read_archives(index).collect()
    ids = [g.record_id for g in got]
    assert len(set(ids)) == len(ids) == len(rows)
    first = {g.record_id for g in got if g.record_type == "response" and g.page_id == 1}
    assert len(first) == 4
    assert all(g.refers_to_record in first for g in got if g.record_type == "revisit")
    for path in (r.path for r in index.select("path").collect()):
        raw = open(path.removeprefix("file:"), "rb").read()
        assert int.from_bytes(raw[4:8], "little") > 0  # every archive has its dictionary
        records = list(warc.decode_archive(raw))
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for r in records:
            head, block = r.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(fields)
            assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            if fields["WARC-Type"] == "response":
                assert fields["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n")


def test_archives_carry_their_dictionary():
    row = {"uri": "u", "record_type": "response", "payload_digest": "d", "payload_bytes": 1, "refers_to": None, "again": None}
    records = [warc.record(row | {"page_id": i, "payload": b"<html><body>common words %d</body></html>" % i * 20}, "2024-01-01T00:00:00Z") for i in range(200)]
    for some in (records, records[:1]):
        raw = b"".join(warc.encode_archive(some, 4096, 1 << 20, 3))
        assert raw[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(raw[4:8], "little") > 0
        assert list(warc.decode_archive(raw)) == some
    with pytest.raises(ValueError):
        list(warc.decode_archive(b"\0" * 16))
