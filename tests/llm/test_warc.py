"""WARC files, and a reader whose work grows with the archive."""

from __future__ import annotations

import gzip
import time

import numpy as np

from tidegauge.llm import warc


def test_reading_is_linear():
    record = warc.write_record(1, "http://a/", b"x" * 20, None)
    took = []
    for n in (4000, 32000):
        data = record * n
        began = time.perf_counter()
        records, gaps = warc.salvage(data)
        took.append(time.perf_counter() - began)
        assert len(records) == n and not gaps
    assert took[1] < 24 * took[0]


def test_false_starts_are_linear():
    """Many version lines and member heads without a record, and no header's end."""
    data = b"WARC/1.1\r\nkey: value\r\n" * 40_000 + b"WARC/1." * 40_000 + b"\x1f\x8b\x08" * 40_000 + warc.write_record(1, "u", b"y", None, False)
    began = time.perf_counter()
    records, gaps = warc.salvage(data)
    assert [r.headers["x-page-id"] for r in records] == ["1"] and gaps == [(0, records[0].start, "record")]
    assert time.perf_counter() - began < 30


def test_long_header_after_damage():
    """No bound on a header's length while the reader looks for the next record either."""
    for compress in (True, False):
        one, long, last = (warc.write_record(i, "http://a/" + "u" * n, b"body", None, compress) for i, n in ((1, 0), (2, 1 << 21), (3, 5)))
        hurt = bytearray(one)
        hurt[-6] ^= 0xFF  # of the body, or of the member's checksum
        records, gaps = warc.salvage(bytes(hurt) + long + last)
        assert [r.headers["x-page-id"] for r in records] == ["2", "3"] and [g[:2] for g in gaps] == [(0, len(hurt))]


def test_members_with_several_records():
    plain = [warc.write_record(i, "u", b"p%d" % i, None, False) for i in range(4)]
    data = gzip.compress(plain[0] + plain[1]) + gzip.compress(plain[2]) + plain[3]
    records, gaps = warc.salvage(data)
    assert [r.headers["x-page-id"] for r in records] == ["0", "1", "2", "3"] and not gaps
    broken = gzip.compress(plain[0] + b"rest")
    assert warc.salvage(broken + gzip.compress(plain[1]))[1][0][:2] == (0, len(broken))


def test_files(spark, tmp_path):
    """Archives as ``.warc.gz`` files that other tools read, and back; damage is one gap."""
    r = np.random.default_rng(1)
    rows = [(i, f"http://h/{i}", f"page {i % 40} " + "x" * int(r.integers(0, 500))) for i in range(200)] + [(200, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, archive_bytes=5000)
    folder = str(tmp_path / "out")
    made = warc.write_files(archives, folder).collect()
    names = sorted(f.name for f in (tmp_path / "out").iterdir())
    assert sorted(m.archive for m in made) == names and all(n.endswith(".warc.gz") for n in names)
    assert sum(gzip.decompress((tmp_path / "out" / n).read_bytes()).count(b"WARC/1.1\r\n") for n in names) == 201
    back = warc.read_files(spark, f"file://{folder}/*.warc.gz")
    same = lambda df: sorted((x.archive, x.start, x.page_id, x.payload_digest) for x in warc.read_archives(df).collect())
    assert same(back) == same(archives)
    hurt = tmp_path / "out" / names[0]
    data = bytearray(hurt.read_bytes())
    data[len(data) // 2] ^= 0xFF
    hurt.write_bytes(bytes(data))
    assert warc.read_archives(back).count() < 201
    assert {g.archive for g in warc.archive_gaps(back).collect()} == {names[0]}
    empty = warc.write_files(warc.write_archives(pages.limit(0)), str(tmp_path / "none"))
    assert empty.count() == 0
