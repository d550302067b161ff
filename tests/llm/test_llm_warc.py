import base64
import glob
import gzip
import hashlib

import pytest

from sheaf.llm import warc
from sheaf.llm.queries import QUERIES
from sheaf.llm.store import new_path

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def brute(rows):
    first, out, stored = {}, [], set()
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = max(page, first.get(html or "", page))
    for page, _, html in rows:
        data = (html or "").encode()
        best = first.get(html or "")
        whole = page == best and (html or "") not in stored
        if whole:
            stored.add(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        refers = None if whole else (str(best) if best is not None else "null")
        out.append((str(page) if page is not None else "null", len(data), digest, "response" if whole else "revisit", refers))
    return sorted(out, key=str)


def read(spark, path, split):
    rows = warc.read_warc(spark, path, True, split).collect()
    return rows, sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str
    )


@pytest.mark.parametrize("split", [997, 1 << 23])
def test_round_trip(spark, split):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, None, None), (4, "x\r\ny é", ""), (5, "e", "dd"), (5, "e", "dd")]
    rows += [(None, "q", "abc"), (9, "z", "ÿ" * 20000), (11, "b", "x\r\n\r\ny")] + [(100 + i, "h", "hot") for i in range(50)]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path)
    got, plain = read(spark, path, split)
    assert plain == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert payloads["9"] == ("ÿ" * 20000).encode() and payloads["11"] == b"x\r\n\r\ny"


def test_files_are_gzip_members(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(i, "u", str(i)) for i in range(9)], PAGES).coalesce(1), path)
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert text.count(b"WARC/1.1\r\n") == 9


def test_revisits_name_a_record(spark):
    """As any reader sees the archive: ids are unique, and a revisit's reference is the response with its digest."""
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, None, None), (None, "q", "abc"), (None, "q", "abc"), (4, "w", "")]
    rows += [(5, "e", "dd")] * 3 + [(5, "e", "other"), (6, "e", "other")] + [(100 + i, "h", "hot") for i in range(50)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "7 AS digest", "8 AS copy", "9 AS _copy", "'x' AS _digest", "1 AS first")
    path = new_path(spark, "warc")
    warc.write_warc(df.repartition(3), path)
    heads = []
    for f in glob.glob(f"{path}/part-*"):
        for record in gzip.open(f).read().split(b"WARC/1.1\r\n")[1:]:
            heads.append(dict(x.split(": ", 1) for x in record.split(b"\r\n\r\n")[0].decode().split("\r\n")))
    assert len(heads) == len(rows)
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    assert len(by_id) == len(rows)
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == len(rows) - 5
    for h in revisits:
        named = by_id[h["WARC-Refers-To"]]
        assert named["WARC-Type"] == "response" and named["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        assert named["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_long_record_and_damage(spark, tmp_path):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "ab" * (9 << 20)), (2, "u", "c")], PAGES).coalesce(1), path)
    rows, _ = read(spark, path, 1 << 16)
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == [("1", 18 << 20), ("2", 1)]
    file = max(glob.glob(f"{path}/part-*"))
    data = open(file, "rb").read()
    cut = tmp_path / "part-00000-c000"
    cut.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside the record|cut or damaged"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_empty_archive(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_warc(spark, path).collect() == []


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(map(tuple, QUERIES["op10_warc"](spark, SMALL).collect()), key=str)
    want = [(int(p), n, d, k, int(r) if r else None) for p, n, d, k, r in brute(pages)]
    assert got == sorted(want, key=str)
