"""Archives: exact round trips, revisits, validation, foreign archives."""

import os
import struct

import pytest
import zstandard

from hashsieve.llm import warc as W

PAGES = "page_id long, url string, html string, payload_bytes string, __first int"


def test_round_trip_and_revisits(spark, tmp_dir):
    rows = [(i, f"http://x/{i}", f"<p>page é {i % 40}</p>" * (1 + i % 5 * 200)) for i in range(400)]
    rows += [(1000 + i, None, "hot") for i in range(300)] + [(2000, "u\r\nWARC-Type: x", None), (2001, "", ""), (None, "n", "hot"), (1000, "again", "hot")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(5)
    path = f"{tmp_dir}/archives"
    W.write_archives(df, path)
    got = W.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = sorted(((i, len((h or "").encode()), W.digest_of((h or "").encode()),
                    "response" if i is None or first[h or ""] == i else "revisit",
                    None if i is None or first[h or ""] == i else first[h or ""], ) for i, _, h in rows), key=str)
    seen = sorted(((W.page_of(r.record_id), r.payload_bytes, r.payload_digest, r.warc_type, W.page_of(r.refers_to)) for r in got), key=str)
    assert seen == want
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[W.page_of(r.record_id)] for r in got if r.warc_type == "response")
    assert all(r.payload is None for r in got if r.warc_type == "revisit")


def test_archive_begins_with_its_dictionary(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>some text {i} and more</p>" * 40, None, None) for i in range(200)], PAGES).coalesce(1)
    W.write_archives(df, f"{tmp_dir}/a", archives=1)
    part = next(f for f in os.listdir(f"{tmp_dir}/a") if f.startswith("part-"))
    with open(f"{tmp_dir}/a/{part}", "rb") as f:
        data = f.read()
    assert struct.unpack("<I", data[:4])[0] == W.DICTIONARY_FRAME
    assert len(list(W.read_frames(data))) == 200
    size = struct.unpack("<I", data[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])  # a compressed dictionary is read as well
    again = struct.pack("<II", W.DICTIONARY_FRAME, len(packed)) + packed + data[8 + size:]
    assert [r for _, r in W.read_frames(again)] == [r for _, r in W.read_frames(data)]


def test_min_revisit_bytes(spark, tmp_dir):
    df = spark.createDataFrame([(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abcd", None, None), (4, "u", "abcd", None, None)], PAGES)
    W.write_archives(df, f"{tmp_dir}/m", min_revisit_bytes=3)
    assert {(W.page_of(r.record_id), r.warc_type) for r in W.read_archives(spark, f"{tmp_dir}/m").collect()} == {
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


@pytest.mark.parametrize("damage,says", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), "version line"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Gone"), "warc-date"),
    (lambda r: r[:-5] + r[-4:], "bytes where"),
    (lambda r: r.replace(b"payload!", b"pAyload!"), "digest"),
    (lambda r: r.replace(b"Content-Length: 8\r\n", b"Content-Length: 9\r\n"), "bytes where"),
])
def test_records_are_validated(damage, says):
    record = W.build_record(1, "http://x", b"payload!", None, "2024-01-01T00:00:00Z")
    assert W.parse_record(record)["payload"] == b"payload!"
    with pytest.raises(ValueError, match=says):
        W.parse_record(damage(record))


def test_broken_frames_become_rows(spark, tmp_dir):
    good = [zstandard.ZstdCompressor(write_checksum=True).compress(W.build_record(i, "u", b"x" * 100, None, "2024-01-01T00:00:00Z")) for i in range(3)]
    bad = bytearray(good[1])
    bad[-1] ^= 255
    os.makedirs(f"{tmp_dir}/b")
    with open(f"{tmp_dir}/b/part-0", "wb") as f:
        f.write(good[0] + bytes(bad) + good[2] + b"\x28\xb5\x2f\xfd\x00")
    rows = sorted(W.read_archives(spark, f"{tmp_dir}/b", strict=False).collect(), key=lambda r: r.offset)
    assert [W.page_of(r.record_id) for r in rows if r.error is None] == [0, 2]
    assert sum(r.error is not None for r in rows) == 2
    with pytest.raises(Exception, match="part-0"):
        W.read_archives(spark, f"{tmp_dir}/b").collect()


def test_empty_table(spark, tmp_dir):
    W.write_archives(spark.createDataFrame([], PAGES), f"{tmp_dir}/e")
    assert W.read_archives(spark, f"{tmp_dir}/e").count() == 0
