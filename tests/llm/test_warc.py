import gzip
import hashlib

import pytest

from larkspur.llm import warc
from larkspur.llm.common import scratch_path
from larkspur.llm.queries import SQL, op4_warc
from tests.oracle import same


def pages(spark):
    big = "<html>" + "é東" * 3000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "x" * 9000 + "</html>"
    rows = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""),
            (2, "http://a/2", big), (None, "u", big), (None, "u", "y" * 200), (7, "u", "z" * 100), (8, "u", "z" * 100), (10, "u", "q" * 99), (11, "u", "q" * 99)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def expected(rows):
    first = {}
    for p, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        least = first.get(h or "")
        again = least is not None and least != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None, True))
    return sorted(map(repr, out))


@pytest.mark.parametrize("segment", [64, 1000, 32768])
def test_round_trip(spark, segment):
    df, rows = pages(spark)
    path = scratch_path(spark, "warc")
    warc.write(df, path, segment_bytes=segment)
    got = warc.summaries(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.reassemble(warc.read_records(spark, path)).filter("payload IS NOT NULL AND page_id = 2").collect()}
    assert payloads == {2: rows[1][2]}


def test_missing_segment_and_changed_byte_are_told(spark, tmp_path):
    records = warc.records_of(1, 0, "u", b"p" * 500, hashlib.sha256(b"p" * 500).hexdigest(), None, 200)
    good, end = records, warc.END.encode()
    (tmp_path / "good.warc.gz").write_bytes(b"".join(gzip.compress(r + end) for r in reversed(good)))
    assert warc.summaries(spark, str(tmp_path / "good.warc.gz")).first()["intact"]
    for name, kept in (("lost", [good[0], *good[2:]]), ("last", good[:-1]), ("changed", [r.replace(b"ppp", b"pqp", 1) for r in good])):
        (tmp_path / f"{name}.warc").write_bytes(b"".join(r + end for r in kept))
        row = warc.summaries(spark, str(tmp_path / f"{name}.warc")).first()
        assert not row["intact"]


def test_framing():
    for n in (0, 1, 8191, 8192, 8193, 30000):
        assert warc.unframe(warc.frame(bytes(range(256)) * (n // 256) + b"z" * (n % 256))) == bytes(range(256)) * (n // 256) + b"z" * (n % 256)
    assert warc.unframe(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.unframe(b"5\r\nhel") is None and warc.unframe(b"zz\r\n") is None


def test_query(spark):
    same(spark, op4_warc, SQL["op4_warc"], "sf0.001")


def test_no_pages(spark):
    df, _ = pages(spark)
    path = scratch_path(spark, "warc")
    warc.write(df.limit(0), path)
    assert warc.summaries(spark, path).count() == 0


def one(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return warc.reassemble(warc.read_records(spark, str(tmp_path / name))).collect()


def test_malformed_records_come_back_not_intact(spark, tmp_path):
    whole = hashlib.sha256(b"p" * 500).hexdigest()
    good = warc.records_of(1, 0, "u", b"p" * 500, whole, None, 4000)[0] + warc.END.encode()
    bad = warc.records_of(2, 0, "u", b"p" * 500, whole, None, 4000)[0] + warc.END.encode()
    parts = [x + warc.END.encode() for x in warc.records_of(2, 0, "u", b"p" * 500, whole, None, 200)]
    length = bad[bad.index(b"Content-Length: ") :].split(b"\r\n")[0]
    cases = {
        "length": bad.replace(length, b"Content-Length: many"), "negative": bad.replace(length, b"Content-Length: -7"),
        "huge": bad.replace(length, b"Content-Length: " + b"9" * 40), "number": b"".join(parts).replace(b"Segment-Number: 2", b"Segment-Number: two"),
        "big": b"".join(parts).replace(b"Segment-Number: 2", b"Segment-Number: 99999999999"), "total": b"".join(parts).replace(b"Total-Length: ", b"Total-Length: x"),
        "cut": bad[: len(bad) // 2], "head": bad[:60],
    }
    for name, data in cases.items():
        rows = one(spark, tmp_path, name, good + data)
        assert {r["page_id"]: r["intact"] for r in rows if r["page_id"] == 1} == {1: True}, name
        assert len(rows) > 1 and not any(r["intact"] for r in rows if r["page_id"] != 1), name
    rows = one(spark, tmp_path, "id", good + bad.replace(b"<urn:page:2#0>", b"<urn:uuid:7>") + bad.replace(b"<urn:page:2#0>", b"<urn:page:two#0>"))
    assert sorted((str(r["page_id"]), r["intact"]) for r in rows) == [("1", True), ("None", True), ("None", True)]


def test_damaged_gzip_is_read_as_far_as_it_goes(spark, tmp_path):
    digests = [hashlib.sha256(bytes([97 + k]) * 3000).hexdigest() for k in range(3)]
    records = [warc.records_of(k, 0, "u", bytes([97 + k]) * 3000, digests[k], None, 40_000)[0] + warc.END.encode() for k in range(3)]
    members = [gzip.compress(r) for r in records]
    for name, data in (("members", b"".join(members)), ("stream", gzip.compress(b"".join(records)))):
        for cut, most in ((0, 3), (40, 2)):
            rows = one(spark, tmp_path, f"{name}{cut}.gz", data[: len(data) - cut])
            assert sum(r["intact"] for r in rows) >= most - (name == "stream" and cut > 0), (name, cut)
            assert all(r["intact"] or r["payload"] is None for r in rows)
    flipped = bytearray(members[1])
    flipped[len(flipped) // 2] ^= 255
    assert [r["page_id"] for r in one(spark, tmp_path, "flipped", members[0] + bytes(flipped)) if r["intact"]] == [0]


def test_each_record_is_a_member(spark):
    df, rows = pages(spark)
    path = scratch_path(spark, "warc")
    warc.write(df.coalesce(1), path, segment_bytes=1000)
    files = [p for p in __import__("pathlib").Path(path.removeprefix("file:")).glob("part-*")]
    members = 0
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC-Type") == data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
        members += data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")
    assert members > len(rows)
