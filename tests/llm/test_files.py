"""WARC packages and shards."""

import base64
import hashlib
import io
import zipfile
import zlib

import pytest

from simplark.llm import sharding, warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é" * 50_000), (6, "u", "PK\x05\x06 in a page"), (6, "v", "PK\x05\x06 in a page"), (None, "w", "<p>x</p>"), (None, "w", "only null")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, sha string")


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_packages(pages(spark).repartition(3), path, package_bytes=200)
    rows = warc.read_packages(spark, path).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for i, _, h in PAGES:
        by.setdefault(h or "", []).append(i)
    for r in rows:
        candidates = [(h or "") for i, _, h in PAGES if i == r.page_id]
        text = next(h for h in candidates if base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(text.encode())
        first = min((i for i in by[text] if i is not None), default=None)
        assert r.record_type == ("response" if first in (None, r.page_id) else "revisit") and r.refers_to == (None if r.record_type == "response" else first)
        assert r.record_type == "revisit" or bytes(r.payload) == text.encode()
    files = list((tmp_path / "warc").glob("part-*"))
    assert len(files) > 1
    for f in files:
        with zipfile.ZipFile(f) as z:  # any reader of ZIP and gzip reads them
            assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}
            assert warc.gzip.decompress(z.read(warc.ARCHIVE)).startswith(b"WARC/1.1\r\n")


def test_small_payloads_stay(spark, tmp_path):
    warc.write_packages(pages(spark, PAGES[:3]), f"file://{tmp_path}/w", least=100)
    assert {r.record_type for r in warc.read_packages(spark, f"file://{tmp_path}/w").collect()} == {"response"}


def test_empty(spark, tmp_path):
    assert warc.round_trip(pages(spark, []), f"file://{tmp_path}/w").count() == 0


def test_zip64_and_ranges():
    record = warc.gzip.compress(b"WARC/1.1\r\nx: y\r\n\r\n")
    raw = warc.build_package([("k", record), ("l", record)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:  # a member with 64-bit sizes in its extra field
        with z.open(zipfile.ZipInfo("archive/big.warc.gz"), "w", force_zip64=True) as f:
            f.write(record)
        z.comment = b"PK\x05\x06 not the end"
    assert warc.Package.of(out.getvalue()).record("big.warc.gz", 0, len(record)).startswith(b"WARC/1.1")
    reads = []
    package = warc.Package(lambda at, n: (reads.append(n), raw[at : at + n])[1], len(raw))
    entries = list(package.index())
    reads.clear()
    assert package.record(**{k: entries[1][k] for k in ("filename", "offset", "length")}) and sum(reads) <= 30 + len(record)
    with pytest.raises(ValueError):
        package.record("data.warc.gz", 0, 10**9)
    with pytest.raises(ValueError):
        warc.Package.of(b"no zip")


def zip64_end(raw: bytes) -> bytes:
    """The same package with a ZIP64 end record and full 32-bit fields."""
    import struct

    at = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, at + 10)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    tail = bytearray(raw[at:])
    struct.pack_into("<HHII", tail, 8, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    return raw[:at] + end + locator + bytes(tail)


def test_zip64_directory():
    record = warc.gzip.compress(b"WARC/1.1\r\n\r\n")
    raw = zip64_end(warc.build_package([("k", record)]))
    assert [e["length"] for e in warc.Package.of(raw).index()] == [len(record)]


DOCS = [(i, "ab" * (i % 97)) for i in range(500)] + [(7, "ab" * 7), (7, "ab" * 7), (900, None), (None, "n"), (None, "n"), (901, "é" * 30_000)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, slot string")


def test_shards_by_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    rows = sharding.shard(docs(spark), 16, "bytes", path).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS)
    sizes = [0] * 16
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        sizes[s] = sum(r.size for r in own)
        assert sorted(r.slot for r in own) == list(range(len(own)))
    big = max(r.size for r in rows)
    rest = sorted(sizes)[:-1]
    assert max(sizes) <= max(big, sum(sizes) / 16 + 200) and max(rest) - min(rest) <= 200
    first, second = (sharding.load_map(spark, path, v) for v in (0, 1))
    assert first == sharding.first_map(16) and {r.virtual_slot: r.shard for r in rows}.items() <= dict(enumerate(second)).items()


def test_shards_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/keys"
    rows = sharding.shard(docs(spark), 16, "key", path).collect()
    assert sorted(map(tuple, sharding.shard(docs(spark), 16, "key", path).collect()), key=str) == sorted(map(tuple, rows), key=str)  # the same path again
    fresh = {r.doc_id: r.shard for r in sharding.shard(docs(spark), 17, "key").collect() if r.doc_id is not None}
    assert fresh == {r.doc_id: r.grown_shard for r in rows if r.doc_id is not None}
    assert sharding.versions(spark, path) == {16, 17}
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    where = {r.doc_id: (r.shard, r.grown_shard) for r in rows if r.doc_id is not None}
    some = sharding.shard(docs(spark, DOCS[100:200]), 16, "key").collect()
    assert all(where[r.doc_id] == (r.shard, r.grown_shard) for r in some)
    for n in range(1, 41):
        now, grown = sharding.keyed_map(n), sharding.keyed_map(n + 1)
        moved = [b for a, b in zip(now, grown, strict=True) if a != b]
        sizes = [grown.count(s) for s in range(n + 1)]
        assert set(moved) == {n} and max(sizes) - min(sizes) <= 0.05 * 4096 / (n + 1) + n + 1


def test_shards_of_nothing(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs(spark), law="x")


def test_one_huge_slot_keeps_the_rest_even():
    out = sharding.rebalanced_map(sharding.first_map(4, 40), [1000] + [10] * 39, 4)
    loads = [sum(s for s, w in zip([1000] + [10] * 39, out, strict=True) if w == k) for k in range(4)]
    assert sorted(loads) == [130, 130, 130, 1000]
