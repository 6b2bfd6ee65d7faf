import gzip
import hashlib
import io
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark):
    big, other = "<p>é" + "x" * 1200, "WARC/1.1\r\n\r\n" + "y" * 1500 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://h/{i}", big) for i in (4, 9, 2)] + [(5, "http://h/ a\r\nX: y", other), (6, None, other)]
    rows += [(10, "u", "small"), (11, "u", "small"), (12, "u", None), (13, "u", ""), (14, "u", "z" * 999), (15, "u", "z" * 999),
             (16, "u", "z" * 1000), (17, "u", "z" * 1000), (17, "u", "z" * 1000), (None, "u", big), (None, "u", "q" * 2000),
             (None, None, "q" * 2000), (18, "u", "long " * 200000), (19, "u", "ü" * 500), (20, "u", "ü" * 500)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    best = {}
    for i, b in body:
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = Counter()
    for i, b in body:
        to = best.get(b)
        to = None if to == i else to
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to)] += 1
    return out


def round_trip(df):
    segments = warc.write_archives(warc.resolve_revisits(warc.headers(df)))
    records = warc.read_archives(segments)
    return segments, records


def test_round_trip_matches_brute_force(spark, monkeypatch):
    rows, df = pages(spark)
    extra = df.withColumn("payload", F.lit(1)).withColumn("original", F.lit(2)).withColumn("refers_to", F.lit(3)) \
        .withColumn("check", F.lit(4)).withColumn("record_id", F.lit(5))
    for table in (df, extra):
        _, records = round_trip(table)
        got = warc.join_revisits(records).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    payloads = {r.page_id: r.payload for r in records.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    text = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(v) == text[i] for i, v in payloads.items())


def test_small_segments_give_the_same_records(spark, monkeypatch):
    rows, df = pages(spark)
    records = [warc.record_bytes(i, u, (h or "").encode(), len((h or "").encode()),
                                 hashlib.sha1((h or "").encode()).hexdigest(), None) for i, u, h in rows]
    packed, plain = b"".join(map(gzip.compress, records)), b"".join(records)
    for raw in (packed, plain, gzip.compress(plain)):
        got = list(warc.parse_records(io.BytesIO(raw)))
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [(h or "").encode() for *_, h in rows]
        assert all("\r" not in f["warc-target-uri"] and " " not in f["warc-target-uri"] for f, _ in got)


def test_archives_are_plain_gzip_members(spark):
    _, df = pages(spark)
    segments, _ = round_trip(df)
    names = {r.path for r in segments.collect()}
    whole = b"".join(gzip.open(n.removeprefix("file:"), "rb").read() for n in names)
    assert whole.count(b"WARC-Type: revisit") == sum(k[3] == "revisit" for k in brute(pages(spark)[0]).elements())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    segments, records = round_trip(none)
    assert segments.count() == 0 and warc.join_revisits(records).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = entry.queries()["op2_warc_revisits"](spark, sf).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
