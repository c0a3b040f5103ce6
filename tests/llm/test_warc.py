"""The archive's records on hand-made pages, held to brute force."""

import base64
import hashlib

from quirekit.llm import warc

ROWS = [
    (5, "http://a/é", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, "http://c", None), (7, "http://d", ""), (2, "http://e\r\nX: y", "é\r\n\r\nWARC/1.1\r\nz"),
    (4, None, "x" * 300_000), (8, "http://f", "x" * 300_000), (8, "http://f", "x" * 300_000), (None, "http://g", "<p>one</p>"), (None, "http://h", "lone"), (None, "http://h", "lone"),
]


def expected(rows, least=0):
    out = []
    for page, url, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        revisit = first is not None and len(raw) >= least and page != first
        out.append((page or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def read(spark, rows, folder, least=0):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archive = warc.write_archive(df, str(folder), least)
    return archive, warc.parsed(warc.read_archive(spark, archive)).collect()


def test_records_equal_brute_force(spark, tmp_path):
    for least in (0, 5):
        archive, got = read(spark, ROWS, tmp_path / str(least), least)
        assert sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, least)
        assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(ROWS)
        ids = {r.record_id: r for r in got}
        assert all(ids[r.refers_id].record_type == "response" and ids[r.refers_id].page_id == r.refers_to for r in got if r.record_type == "revisit")
        stored = spark.read.parquet(archive.payloads).collect()
        assert len(stored) == len({r.digest for r in stored}) == 5
    assert {r.url for r in got} == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in ROWS}


def test_a_record_is_exact_bytes(spark, tmp_path):
    archive, _ = read(spark, [(1, "http://a", "hé"), (2, "http://b", "hé")], tmp_path)
    full, revisit = sorted((bytes(r.record) for r in warc.read_archive(spark, archive).collect()), key=lambda b: b"revisit" in b)
    assert full.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:") and full.endswith("\r\n\r\nhé\r\n\r\n".encode())
    assert b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" in revisit and revisit.endswith(b"Content-Length: 3\r\n\r\n\r\n\r\n")
    for record in (full, revisit):
        head, block = record[:-4].split(b"\r\n\r\n", 1)
        stated = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        assert stated == len(block)


def test_empty_table(spark, tmp_path):
    assert read(spark, [], tmp_path)[1] == []
