"""Archives: round trips, foreign archives, skipping, and the registered query against a plain version."""

import gzip
import hashlib
import io
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc
from lodestone.llm.queries import op5_warc
from tests.conftest import SF

BIG = "é\r\n\r\nWARC/1.1\r\n" * 200
PAGES = [(1, "http://a/\r\nx", BIG), (9, "http://b/", BIG), (9, "http://b/", BIG), (2, None, None), (3, "http://c/", "small"), (4, "http://d/", "small"), (None, "u", "z" * 1500), (5, "http://é/" + "long" * 3000, "y" * 3_000_000)]


@pytest.fixture
def pages(spark):
    shape = "page_id long, url string, html string, digest string, n long, kept string, value string, record_id string"
    return spark.createDataFrame([(*p, "d", 1, "k", "v", "r") for p in PAGES], shape).repartition(3)


def test_round_trip(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w")
    rows = Counter((r.record_id, r.type, r.refers_to, None if r.payload is None else bytes(r.payload), r.full_length) for r in got.collect())
    n = len(BIG.encode())
    assert rows == {
        ("<urn:page:9>", "response", None, BIG.encode(), n): 2, ("<urn:page:1>", "revisit", "<urn:page:9>", None, n): 1, ("<urn:page:2>", "response", None, b"", 0): 1,
        ("<urn:page:3>", "response", None, b"small", 5): 1, ("<urn:page:4>", "response", None, b"small", 5): 1, ("<urn:page:null>", "response", None, b"z" * 1500, 1500): 1,
        ("<urn:page:5>", "response", None, b"y" * 3_000_000, 3_000_000): 1,
    }
    assert warc.read(spark, f"{tmp_path}/w", type="revisit").count() == 1
    assert warc.read(spark, f"{tmp_path}/w", uri_prefix="http://b", payload="false").where("payload IS NULL").count() == 2
    assert warc.read(spark, f"{tmp_path}/w", digest=hashlib.sha1(b"small").hexdigest()).count() == 2
    assert all(r.digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in got.where("payload IS NOT NULL").collect())
    assert {r.target_uri for r in got.collect() if r.record_id == "<urn:page:5>"} == {PAGES[-1][1]}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert warc.read(spark, f"{tmp_path}/w").where("type = 'revisit' AND full_length > 3").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_any_gzip_reader_reads_the_archives(pages, tmp_path):
    warc.write(pages, f"{tmp_path}/w")
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*.warc.gz")))
    assert whole.count(b"WARC-Record-ID: <urn:page:") == len(PAGES) and whole.count(b"y" * 3_000_000) == 1
    assert not list((tmp_path / "w").glob(".part-*"))


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Type: application/warc-fields\r\nX-Odd: \xff\xfe\r\nContent-Length: 14\r\n\r\nsoftware: x\r\n\r" + b"\r\n\r\n"
    b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <urn:2>\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nServer: \xe9\r\n\r\nline\r\n\r\nend" + b"\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:3>\r\nContent-Length: 0\r\n\r\n" + b"\r\n\r\n"
)


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, lambda b: b"".join(gzip.compress(b"WARC/1.0" + r) for r in b.split(b"WARC/1.0")[1:]), lambda b: b"".join(warc.member(b"WARC/1.0" + r) for r in b.split(b"WARC/1.0")[1:])])
def test_foreign_archives(spark, tmp_path, pack):
    (tmp_path / "x.warc").write_bytes(pack(FOREIGN))
    got = {r.record_id: (r.type, None if r.payload is None else bytes(r.payload), r.full_length) for r in warc.read(spark, f"{tmp_path}/x.warc").collect()}
    assert got == {"<urn:1>": ("warcinfo", b"software: x\r\n\r", 14), "<urn:2>": ("response", b"line\r\n\r\nend", 11), "<urn:3>": ("resource", b"", 0)}
    assert [r.record_id for r in warc.read(spark, f"{tmp_path}/x.warc", type="response").collect()] == ["<urn:2>"]


def test_unwanted_payloads_are_not_inflated(tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n"
    noise = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(100_000))
    file = tmp_path / "x.warc.gz"
    file.write_bytes(b"".join(warc.member(head % (kind, len(body)) + body + b"\r\n\r\n") for kind, body in ((b"response", noise), (b"revisit", b""), (b"response", noise))))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

        def size(self):
            return len(self.getvalue())

    reader = warc.WarcReader({"path": str(file), "type": "revisit"})
    assert [r["type"] for r in reader._rows(Counted(file.read_bytes()))] == ["revisit"]
    assert Counted.taken < 20_000 < 6_000_000 < file.stat().st_size


def test_cut_archives_are_errors(spark, pages, tmp_path):
    warc.write(pages.coalesce(1), f"{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*")
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="no whole record"):
        warc.read(spark, f"{tmp_path}/w").collect()


def test_files_of_lost_tasks_stay_hidden(tmp_path):
    writer = warc.WarcWriter(str(tmp_path / "w"))
    batch = pa.record_batch([pa.array(["WARC/1.1\r\nContent-Length: 0\r\n\r\n"])], names=["value"])
    writer.write(iter([batch]))  # its executor is lost
    kept = writer.write(iter([batch, batch]))
    writer.commit([kept, writer.write(iter([]))])
    assert [f.name for f in (tmp_path / "w").iterdir()] == [kept.name]


def plain(pages):
    largest = {}
    for page, _, html in pages:
        text = html or ""
        if len(text.encode()) >= 1000 and page is not None:
            largest[text] = max(largest.get(text, page), page)
    out = Counter()
    for page, _, html in pages:
        text = (html or "").encode()
        kept = largest.get(html or "", page) if len(text) >= 1000 else page
        out[(page, len(text), hashlib.sha1(text).hexdigest(), "response" if kept == page else "revisit", None if kept == page else kept)] += 1
    return out


def test_the_query_equals_a_plain_version(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert Counter(map(tuple, op5_warc(spark, str(tmp_path)).collect())) == plain(PAGES)
    small = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.col("html")).collect()
    assert Counter(map(tuple, op5_warc(spark, SF).collect())) == plain(small)
