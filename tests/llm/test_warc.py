import glob
import gzip
import hashlib

from helpers import collected
from pyspark.sql import types as T

from chartledger.llm import warc

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("record", T.StringType()),
    T.StructField("original", T.LongType())])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], PAGES)


def record(page, payload, kind="response"):
    digest = hashlib.sha256(payload).hexdigest()
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\n"
            f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode() + payload + b"\r\n\r\n"


def read(data):
    return [(a, b, h and h["warc-record-id"][10:-1], p, w) for a, b, h, p, w in warc.salvage(data)]


def test_salvage_of_plain_records():
    parts = [record(i, f"payload {i} WARC/1.1\r\n inside".encode() * i) for i in range(1, 5)]
    whole = b"".join(parts)
    assert [r[2] for r in read(whole)] == ["1", "2", "3", "4"]
    broken = parts[0] + parts[1].replace(b"payload", b"PAYLOAD") + parts[2][:60] + parts[3]
    got = read(broken)
    assert [r[2] for r in got] == ["1", None, "4"]
    gap = got[1]
    assert gap[0] == len(parts[0]) and gap[1] == len(broken) - len(parts[3])
    assert gap[4] == "payload digest differs"
    covered = sum(b - a for a, b, *_ in got)
    assert covered == len(broken)


def test_salvage_of_members():
    parts = [gzip.compress(record(i, b"member " * 40 * i)) for i in range(1, 5)]
    assert [r[2] for r in read(b"".join(parts))] == ["1", "2", "3", "4"]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 0xFF
    data = b"junk" + parts[0] + bytes(bad) + record(9, b"plain") + parts[2] + parts[3][:30]
    got = read(data)
    assert [r[2] for r in got if r[2]] == ["1", "9", "3"]
    assert [(r[0], r[1]) for r in got if not r[2]] == [
        (0, 4), (4 + len(parts[0]), 4 + len(parts[0]) + len(bad)),
        (len(data) - 30, len(data))]


def test_salvage_of_odd_archives():
    assert read(b"") == [] and read(b"\r\n")[0][2] is None
    assert read(b"WARC/1.1\r\n")[0][4] == "header without end"
    one = record(1, b"x")
    assert [r[2] for r in read(one[:-1])] == [None]
    assert [r[2] for r in read(one + b"\0" * 9 + one)] == ["1", None, "1"]


def test_round_trip_with_nulls_repeats_and_hot_payload(spark):
    big = "<p>" + "é" * 60 + "</p>"
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
    rows = [(5, "u", big), (3, "u\r\nX: y", big), (4, None, big), (7, "u", None), (8, "u", ""),
            (9, "u", "short"), (10, "u", "short"), (11, "u", tricky), (12, "u", tricky),
            (None, "u", big)] + [(100 + i, "u", "hot " * 30) for i in range(400)]
    got = {r["page_id"]: r for r in warc.archived_pages(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page, _url, html in rows:
        raw = (html or "").encode()
        assert got[page]["payload_bytes"] == len(raw)
        assert got[page]["payload_digest"] == hashlib.sha256(raw).hexdigest()
    assert got[3]["record_type"] == "response" and got[5]["refers_to"] == 3 == got[4]["refers_to"]
    assert got[None]["refers_to"] == 3 and got[9]["record_type"] == got[10]["record_type"]
    assert got[12]["refers_to"] == 11
    assert sum(r["refers_to"] == 100 for r in got.values()) == 399


def test_archives_roll_over_and_damage_is_logged(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    warc.write_archives(pages(spark, rows).coalesce(1), path, archive_bytes=20_000)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 3
    copies = tmp_path / "damaged"
    copies.mkdir()
    for k, name in enumerate(files):
        whole = open(name, "rb").read()
        (copies / f"{k}.warc").write_bytes(whole[:300] + whole[340:] if k == 0 else whole)
    found = warc.read_archives(spark, str(copies))
    gaps = found.filter("gap IS NOT NULL").collect()
    assert len(gaps) == 1 and found.filter("gap IS NULL").count() == 199
    assert bytes(found.filter("page_id = 150").first()["payload"]) == b"<p>150</p>" * 50


def test_empty_table_and_repeated_rows(spark):
    assert warc.archived_pages(pages(spark, [(1, "u", "x")]).limit(0)).count() == 0
    twice = warc.archived_pages(pages(spark, [(1, "u", "z" * 200)] * 3))
    assert collected(twice, "page_id", "record_type") == [(1, "response")] * 3
