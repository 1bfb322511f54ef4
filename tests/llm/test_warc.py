"""WARC archives: round trip, revisits, and damaged archives."""

import gzip

from hearthline.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip(spark):
    long = "<p>é" + "x" * 200
    rows = [
        (3, "http://a", long), (5, "http://b c\r\n", long), (9, None, long), (4, "u", "short"),
        (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 9),
        (3, "http://a", long), (10, "u", "z" * 300_000),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    found = warc.archived(pages).collect()
    import hashlib

    data = lambda html: (html or "").encode()
    expected = []
    for page, _, html in rows:
        again = html == long and page not in (3, None)
        expected.append(
            (page, len(data(html)), hashlib.sha256(data(html)).hexdigest(), "revisit" if again else "response", 3 if again else None)
        )
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert warc.archived(pages.limit(0)).count() == 0


def record(i, payload):
    import hashlib

    digest = hashlib.sha256(payload).hexdigest()
    return (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n"
        b"WARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n" % (i, digest.encode(), len(payload))
        + payload + b"\r\n\r\n"
    )


def names(found):
    return [f[2][b"warc-record-id"] for f in found if f[0] == "record"]


def covered(found, size):
    gaps = [f for f in found if f[0] == "gap"]
    assert all(f[2] > 0 and f[3] for f in gaps) and sum(f[2] for f in gaps) <= size
    return gaps


def test_salvage_of_plain_archives():
    parts = [record(i, b"payload %d " % i * 20) for i in range(6)]
    damaged = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    damaged[at] ^= 0xFF  # the digest of record 1 fails
    cut = len(b"".join(parts[:3])) + parts[3].index(b"Content-Length: ") + 16
    damaged[cut] = ord("9")  # the length of record 3 is wrong
    found = list(warc.salvage(bytes(damaged)))
    assert names(found) == [b"<urn:page:%d>" % i for i in (0, 2, 4, 5)]
    gaps = covered(found, len(damaged))
    assert [(g[1], g[2]) for g in gaps] == [
        (len(parts[0]), len(parts[1])),
        (len(b"".join(parts[:3])), len(parts[3])),
    ]
    assert list(warc.salvage(b"")) == []
    assert [f[0] for f in warc.salvage(b"no archive at all")] == ["gap"]
    assert names(warc.salvage(b"".join(parts)[:-30])) == [b"<urn:page:%d>" % i for i in range(5)]


def test_salvage_of_compressed_archives(spark, tmp_path):
    parts = [gzip.compress(record(i, b"payload %d " % i * 50), mtime=0) for i in range(5)]
    damaged = bytearray(b"junk" + b"".join(parts))
    at = 4 + len(parts[0]) + len(parts[1]) // 2
    damaged[at : at + 8] = b"\0" * 8
    found = list(warc.salvage(bytes(damaged)))
    assert names(found) == [b"<urn:page:%d>" % i for i in (0, 2, 3, 4)] or names(found) == [
        b"<urn:page:%d>" % i for i in (2, 3, 4)
    ]
    whole = b"".join(parts)
    assert names(warc.salvage(whole)) == [b"<urn:page:%d>" % i for i in range(5)]
    broken = bytearray(whole)
    broken[at - 4 : at + 4] = b"\0" * 8
    (tmp_path / "a.warc.gz").write_bytes(bytes(broken))
    rows = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r["kind"] for r in rows] == ["record", "gap", "record", "record", "record"]
    gap = rows[1]
    assert (gap["offset"], gap["gap_bytes"]) == (len(parts[0]), len(parts[1])) and gap["problem"]


def test_files_are_closed_by_bytes(spark, tmp_path):
    # Mostly tiny pages, then a run of large ones in the same task.
    rows = [(i, "u", f"{i} " + "x" * (200_000 if i >= 900 else 10), "clash") for i in range(1000)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = warc.write(pages, str(tmp_path / "archives"), file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "archives").rglob("part-*")]
    assert len(sizes) >= 15 and max(sizes) < (1 << 20) + 201_000
    found = warc.read(spark, path)
    assert found.filter("kind = 'record'").select("record_id").distinct().count() == 1000 == found.count()


def test_salvage_within_members():
    parts = [record(i, b"payload %d " % i * 30) for i in range(6)]
    content = bytearray(b"".join(parts))
    start = len(parts[0]) + len(parts[1])
    content[start + len(parts[2]) // 2] ^= 0xFF
    # One sound member that holds a damaged record, then an undamaged one.
    data = gzip.compress(bytes(content), mtime=0) + gzip.compress(record(9, b"last"), mtime=0)
    found = list(warc.salvage(data))
    assert names(found) == [b"<urn:page:%d>" % i for i in (0, 1, 3, 4, 5, 9)]
    gap = covered(found, len(data))[0]
    assert gap[1:3] == (0, len(parts[2])) and f"at {start} " in gap[3] and "digest" in gap[3]


def test_salvage_of_a_single_damaged_member(spark, tmp_path):
    random = __import__("random").Random(3)
    parts = [record(i, bytes(random.randrange(32, 127) for _ in range(9000))) for i in range(40)]
    parts[1] = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nno\r\n\r\n"
    whole = gzip.compress(b"".join(parts), mtime=0)
    damaged = bytearray(whole)
    damaged[len(whole) // 2 : len(whole) // 2 + 64] = b"\xff" * 64
    for data in (bytes(damaged), whole[: len(whole) // 2]):
        found = list(warc.salvage(data))
        kept = names(found)
        # Whole records before the damage, and none that nothing proves.
        assert 15 <= len(kept) < 25 and kept == [b"<urn:page:%d>" % i for i in range(len(kept) + 1) if i != 1]
        assert [(g[1], g[2]) for g in covered(found, len(data))] == [(0, len(data))]
    (tmp_path / "one.warc.gz").write_bytes(bytes(damaged))
    log = str(tmp_path / "log")
    assert warc.page_digest(warc.read(spark, str(tmp_path / "one.warc.gz")), log).count() >= 15
    (gap,) = spark.read.parquet(log).collect()
    assert (gap["offset"], gap["gap_bytes"], gap["problem"]) == (0, len(damaged), "damaged member")
