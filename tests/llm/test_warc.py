import base64
import hashlib

import pytest
from bazaarflow.llm import warc
from bazaarflow.llm.warc_query import op4_chunked_warc

LONG = "x" * 300_000 + "é"
ROWS = [(1, "u", "<a>"), (2, "u", "<a>"), (3, None, None), (4, "v", ""), (5, "é \r\n u", LONG), (6, "w", "<a>"), (None, "n", "<a>"),
        (7, "q", LONG), (7, "q2", "other"), (8, "r", "other")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, sha1 string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_records_equal_brute_force(pages, spark, folder):
    largest = {}
    for page_id, _, html in ROWS:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page_id is None else page_id)
    expected = []
    for page_id, _, html in ROWS:
        first = largest[html or ""]
        revisit = page_id != first
        expected.append((page_id or 0, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    found = [(r["page_id"] or 0, *[r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")])
             for r in op4_chunked_warc(spark, folder(pages=pages)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_chunks_carry_running_digests(pages):
    found = warc.read(warc.write(pages, chunk_bytes=1000), chunk_bytes=100_000).collect()
    mine = sorted((r for r in found if r["record_id"] == 7 and r["n_bytes"] > 10), key=lambda r: r["chunk"])
    assert [r["n_bytes"] for r in mine] == [100_000, 200_000, 300_000, 300_002]
    whole = b""
    for r in mine:
        whole += bytes(r["data"])
        assert r["digest"] == base64.b32encode(hashlib.sha1(whole).digest()).decode()
    assert whole.decode() == LONG and [r["last"] for r in mine] == [False, False, False, True]


def test_hot_payload_and_no_rows(spark, folder):
    rows = [(i, "u", "same" if i < 1500 else f"own {i}") for i in range(2000)]
    found = op4_chunked_warc(spark, folder(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sum(r["refers_to"] == 1499 for r in found) == 1499
    assert sum(r["record_type"] == "response" for r in found) == 501
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op4_chunked_warc(spark, folder(pages=none)).count() == 0
