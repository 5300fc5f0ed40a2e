import gzip
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from geoloom.llm import warc as op
from geoloom.llm.common import shared_folder


def test_sql(spark, data, same):
    same(op.op8_warc(spark, data), op.OP8_SQL)


def test_edges_and_round_trip(spark):
    pages = [
        (1, "http://a/é x\r\nWARC-Type: fake", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "u", "x\r\n\r\ny" * 5000), (5, "u", "x\r\n\r\ny" * 5000),
        (None, "n", "<p>ü</p>"), (None, "m", "only without id"), (None, "m", "only without id"),
    ]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, offset int")
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    index = op.write_archives(df, folder)
    rows = op.read_archives(index, folder, gap=0).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in rows) == sorted((str(p[0]), str(p[1])) for p in pages)
    text = {p[0]: (p[2] or "").encode() for p in pages[:6]}
    for r in rows:
        if r.page_id is not None:
            assert r.payload_digest == op.payload_digest(text[r.page_id]) and r.payload_bytes == len(text[r.page_id])
            assert r.payload == (text[r.page_id] if r.record_type == "response" else None)
    kind = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in rows}
    assert kind[2, None] == ("response", None) and kind[1, pages[0][1]] == kind[None, "n"] == ("revisit", 2)
    assert kind[4, "http://c"] == ("response", None) and kind[3, "http://b"] == ("revisit", 4)
    assert [r.record_type for r in rows if r.url == "m"] == ["response"] * 2 == [r.record_type for r in rows if r.url == "u"]
    # a selection is read alone, and the archives are gzip files
    some = op.read_archives(index.where(F.col("url") == "http://c"), folder, payloads=False).collect()
    assert [r.page_id for r in some] == [4]
    for f in Path(folder.removeprefix("file://")).glob("*.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    big = op.write_archives(df, folder, min_bytes=8)
    kinds = {(r.page_id, r.record_type) for r in op.read_archives(big, folder, payloads=False).collect()}
    assert {(3, "response"), (4, "response"), (1, "revisit")} <= kinds


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    assert op.read_archives(op.write_archives(df, folder), folder).count() == 0
