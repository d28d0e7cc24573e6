from __future__ import annotations

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from codelabels.llm import queries, warc


def brute(rows):
    """(page_id, html) rows: what an archive must say of each."""
    first = {}
    for i, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    count = {}
    for _, html in rows:
        count[html] = count.get(html, 0) + 1
    out = []
    for i, html in rows:
        body = (html or "").encode()
        again = body in first and count[html] > 1 and i != first[body]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def sample():
    rng = random.Random(6)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(40_000))
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n").decode("latin-1")
    rows = [(i, f"http://a/{i}", f"<html>page {i}</html>" * (i % 9)) for i in range(40)]
    rows += [(100 + i, f"http://b/{i}\r\nx: y", "same payload " * 12) for i in range(30)]
    rows += [(200, None, None), (201, "http://ü/", ""), (202, "u", "small"), (203, "u", "small"), (204, "n", noise), (205, "n", noise), (206, "g", "\x1f\x8b\x08" * 60 + inner)]
    rows += [(None, "no id", "same payload " * 12), (None, "no id", "x" * 200), (207, "u", "y" * 99), (208, "u", "y" * 99), (209, "u", "é" * 50), (90, "u", "é" * 50), (90, "u", "é" * 50)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, id int")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_over_small_ranges(spark, tmp_path):
    rows = sample()
    warc.write(warc.marked(frame(spark, rows)), f"{tmp_path}/a")
    for size in (64, 1000, 1 << 20):
        got = queries.archived(warc.read(spark, f"{tmp_path}/a", size))
        assert found(got) == brute([(i, h) for i, _, h in rows])


def test_files_are_plain_archives(spark, tmp_path):
    warc.write(warc.marked(frame(spark, sample()).repartition(3)), f"{tmp_path}/a")
    (tmp_path / "a" / "other.txt").write_bytes(b"not an archive \x1f\x8b\x08 at all")
    (tmp_path / "a" / "cut.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 99)[:-9])
    texts = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*"))]
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type") for t in texts) == len(sample())
    assert warc.read(spark, f"{tmp_path}/a", 100).count() == len(sample())


def test_very_long_record_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "long " * 4_000_000), (2, "u", "b")]
    warc.write(warc.marked(frame(spark, rows)), f"{tmp_path}/a")
    assert found(queries.archived(warc.read(spark, f"{tmp_path}/a", 4096))) == brute([(i, h) for i, _, h in rows])
    warc.write(warc.marked(frame(spark, rows).limit(0)), f"{tmp_path}/b")
    assert warc.read(spark, f"{tmp_path}/b").collect() == []


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert found(queries.op10_warc(spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in pages])


def test_ranges_are_dealt_to_many_tasks(spark, tmp_path):
    rows = [(i, None, "".join(random.Random(i).choices("abcdefgh", k=2000))) for i in range(300)]
    warc.write(warc.marked(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)), f"{tmp_path}/a")
    size = sum(p.stat().st_size for p in (tmp_path / "a").glob("part-*")) // 200
    records = warc.read(spark, f"{tmp_path}/a", size)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    parts = records.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(parts) > 8 and max(r["n"] for r in parts) < 60
    assert found(queries.archived(records)) == brute([(i, h) for i, _, h in rows])


def test_a_large_member_is_read_in_linear_time(tmp_path):
    noise = random.Random(2).randbytes(24 << 20)
    member = warc._record("1", None, noise, "d", None, False, "2024") + b"\0"
    (tmp_path / "a.gz").write_bytes(member * 2)

    class Counted:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, place):
            self.file.seek(place)

        def read(self, n):
            self.read_bytes += n
            return self.file.read(n)

    with (tmp_path / "a.gz").open("rb") as file:
        source = Counted(file)
        records = list(warc._records(warc._Source(source, 2 * len(member)), 0, 2 * len(member)))
    assert [r.endswith(noise + b"\r\n\r\n") for r in records] == [True, True]
    assert source.read_bytes < 2.1 * 2 * len(member)
