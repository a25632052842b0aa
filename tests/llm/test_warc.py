import io
import struct

import pytest
import zstandard

from waymark.llm import warc
from waymark.llm.common import scratch


def rows_of(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first_id int, sha_ string").repartition(2)
    folder = scratch(spark, "warc-test")
    return warc.read_archives(spark, folder, warc.write_archives(pages, folder, **more)).collect()


def test_nulls_ties_and_long_payloads(spark):
    long = "<p>é</p>\r\n\r\n" * 200_000
    rows = [(1, None, None, 0, ""), (2, "http://a/ b\n", "", 0, ""), (3, "http://x", long, 0, ""), (4, "http://y", long, 0, ""), (4, "http://y", long, 0, ""), (3, "z", long, 0, ""), (None, "n", "x", 0, ""), (9, "n", "x", 0, ""), (None, "m", "only", 0, "")]
    got = sorted(rows_of(spark, rows), key=str)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    n = len(long.encode())
    assert kinds == sorted([("1", "response", None, 0), ("2", "revisit", 1, 0), ("3", "response", None, n), ("3", "response", None, n), ("4", "revisit", 3, n), ("4", "revisit", 3, n), ("9", "response", None, 1), ("None", "revisit", 9, 1), ("None", "response", None, 4)], key=str)
    assert {r["payload_digest"] for r in got if r["page_id"] in (3, 4)} == {warc.digest_of(long.encode())}
    assert all(r["record_type"] == "response" for r in rows_of(spark, rows[:2], min_bytes=1))
    assert rows_of(spark, []) == []


def test_archive_round_trip_with_and_without_dictionary():
    for n in (1, 3000):
        records = [warc.record(i, f"http://h/{i}", f"<html><body>page {i} {'words and more ' * (i % 50)}</body></html>".encode(), None, False, "1970-01-01T00:00:00Z") for i in range(n)]
        out = io.BytesIO()
        assert warc.write_archive(out, iter(records)) == n
        data = out.getvalue()
        assert (struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC) == (n > 1)
        assert list(warc.read_archive(io.BytesIO(data))) == records
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(data[:-3])))


def test_raw_dictionary_is_read():
    d = zstandard.train_dictionary(4096, [f"some text {i} that repeats {i * 7}".encode() * 5 for i in range(900)])
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(d.as_bytes())) + d.as_bytes() + zstandard.ZstdCompressor(dict_data=d).compress(b"some text 5")
    assert list(warc.read_archive(io.BytesIO(data))) == [b"some text 5"]


def test_wrong_records_are_refused():
    good = warc.record(1, "u", b"payload", None, False, "1970-01-01T00:00:00Z")
    assert warc.page_of(warc.parse(good))["payload_bytes"] == 7
    for bad in (good[1:], good[:-1], good.replace(b"payload\r", b"paYload\r"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Date", b"X-Date"), good + b"x"):
        with pytest.raises(ValueError):
            warc.page_of(warc.parse(bad))
