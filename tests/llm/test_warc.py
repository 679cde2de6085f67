import base64
import hashlib
import os
import random
import struct
from collections import Counter

import pytest
import zstandard

from airloom.llm import warc as w

PAGES = "page_id long, url string, html string, archive string, revisit string"


def pages():
    rng = random.Random(4)
    words = [f"<p>word{i} of the page</p>" for i in range(50)]
    rows = [(i, f"http://h{i % 5}.example/{i}", " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(200)]
    rows += [(300 + i, "http://copies.example/", "the same page") for i in range(40)]
    rows += [(400, "http://e.example/", None), (401, None, ""), (402, "", ""), (None, "http://n.example/", "the same page"), (None, "x", "null twice"), (None, "x", "null twice")]
    rows += [(500, "http://x/\r\nWARC-Type: warcinfo é", "é 日本 \r\n\r\n \U0001f600"), (500, "y", "é 日本 \r\n\r\n \U0001f600"), (-5, "z", "long " * 300_000)]
    return rows


def brute(rows):
    own = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, h in own:
        top[h] = max([x for x in (top.get(h), i) if x is not None], default=None)
    name = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    return Counter((i, len(h), name(h), "response", None) if i == top[h] else (i, len(h), name(h), "revisit", top[h]) for i, h in own)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("archive_bytes, most", [(1 << 25, 500_000), (3000, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, archive_bytes, most):
    monkeypatch.setattr(w, "MAX_BROADCAST", most)
    w.write_archives(frame(spark, pages()), f"file://{tmp_path}/out", archive_bytes)
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    heads = {open(tmp_path / "out" / f, "rb").read(4) for f in files}
    assert heads == {struct.pack("<I", w.DICTIONARY_MAGIC)} and (len(files) > 20) == (archive_bytes < 1 << 20)
    records = w.read_archives(spark, f"file://{tmp_path}/out", payloads=True).cache()
    assert records.filter("error is not null").count() == 0
    assert records.filter("record_type = 'warcinfo'").count() == len(files)
    texts = Counter(bytes(r.payload) for r in records.filter("record_type = 'response'").select("payload").collect())
    assert set(texts) == {(h or "").encode() for _, _, h in pages()}
    rows = w.resolved(w.written(records))
    assert rows.filter("error is not null").count() == 0
    got = Counter(map(tuple, rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == brute(pages())
    records.unpersist()


def test_no_pages(spark, tmp_path):
    w.write_archives(frame(spark, pages()).filter("false"), f"file://{tmp_path}/out")
    assert w.read_archives(spark, f"file://{tmp_path}/out").count() == 0


def rec(**changes):
    headers = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": "http://x/"} | {k.replace("_", "-"): v for k, v in changes.items()}
    return w.record([(k, v) for k, v in headers.items()], b"payload")


def test_archives_of_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    samples = [rec(X_N=str(i) * 50) for i in range(500)]
    words = zstandard.train_dictionary(4096, samples)
    pack = zstandard.ZstdCompressor(dict_data=words, write_checksum=True).compress
    plain = zstandard.ZstdCompressor(write_content_size=False).compress
    skip = struct.pack("<II", 0x184D2A5A, 3) + b"abc"
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    (tmp_path / "in" / "a.warc.zst").write_bytes(struct.pack("<II", w.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(map(pack, samples[:20])) + skip + pack(samples[20]))
    (tmp_path / "in" / "b.warc.zst").write_bytes(plain(rec()) + skip + plain(b"WARC/1.0" + rec()[8:]))
    rows = w.read_archives(spark, f"file://{tmp_path}/in", payloads=True).collect()
    assert len(rows) == 23 and {r.error for r in rows} == {None} and {bytes(r.payload) for r in rows} == {b"payload"}
    assert {r.payload_digest for r in rows} == {w.digest(b"payload")}


def test_damage_costs_one_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    good = pack(rec())
    bad = bytearray(pack(rec(X="y" * 50)))
    bad[-1] ^= 1  # its checksum
    unsound = [
        (rec()[:-1], "length differs from the block"),
        (rec() + rec(), "length differs from the block"),
        (rec().replace(b"Length: 7", b"Length: 6"), "length differs from the block"),
        (rec().replace(b"Length: 7", b"Length: x"), "length is no number"),
        (rec(WARC_Type=None), "no header warc-type"),
        (rec(WARC_Date="yesterday"), "date is no time stamp"),
        (rec(WARC_Record_ID="urn:x"), "record id is no URI"),
        (rec(WARC_Target_URI=None), "no target"),
        (rec(WARC_Payload_Digest="sha1:AAAA"), "payload digest differs"),
        (rec(WARC_Block_Digest="sha1:AAAA"), "block digest differs"),
        (rec(WARC_Type="revisit"), "revisit without a profile"),
        (b"HTTP" + rec()[4:], "unknown version"),
        (rec().replace(b"WARC-Date", b"WARC-Type: x\r\nWARC-Date"), "repeated header warc-type"),
        (rec().replace(b"WARC-Date", b"no name\r\nWARC-Date"), "header without a name"),
    ]
    (tmp_path / "in" / "a").write_bytes(good + bytes(bad) + b"".join(pack(x) for x, _ in unsound) + good)
    (tmp_path / "in" / "b").write_bytes(good + good[:-5])
    (tmp_path / "in" / "c").write_bytes(good + b"no frame")
    (tmp_path / "in" / "d").write_bytes(b"")
    rows = w.read_archives(spark, f"file://{tmp_path}/in").collect()
    by = {k: [r.error for r in sorted(rows, key=lambda r: r.offset) if r.archive.endswith(f"/{k}")] for k in "abcd"}
    assert by["a"][0] is None and by["a"][-1] is None and by["a"][1].startswith("frame: ")
    assert [e for e, (_, want) in zip(by["a"][2:-1], unsound) if want not in e.split("; ")] == [] and len(by["a"]) == len(unsound) + 3
    assert by["b"] == [None, "frame is cut off"] and by["c"] == [None, "no frame starts here"] and by["d"] == []


def test_revisit_of_a_missing_response(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lost = rec(WARC_Type="revisit", WARC_Profile=w.PROFILE, WARC_Refers_To="<urn:x:9>", WARC_Payload_Digest="sha1:ABC")
    (tmp_path / "in" / "a").write_bytes(zstandard.ZstdCompressor().compress(lost))
    row = w.resolved(w.written(w.read_archives(spark, f"file://{tmp_path}/in"))).collect()[0]
    assert (row.error, row.payload_bytes, row.payload_digest) == ("revisit of no such response", None, "ABC")
