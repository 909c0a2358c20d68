"""Archives and token files that are damaged, and records of many segments."""

import numpy as np
import pytest

from proofline.llm import token_files, warc
from proofline.llm.files import read_file, write_file


def read_one(spark, tmp_path, raw):
    path = write_file(f"file://{tmp_path}", "x", raw)
    rows = warc.read_archives(spark.createDataFrame([(path,)], "path string"), with_payload=True).collect()
    return [(r["record_type"], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for r in rows]


def response(block, digest=None):
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1:x>")] + ([("WARC-Payload-Digest", digest)] if digest else [])
    return warc.record(fields, block)


def test_damaged_records(spark, tmp_path):
    good = warc._HTTP + warc.chunked(b"payload")
    assert read_one(spark, tmp_path, response(good)) == [("response", 7, b"payload")]
    for bad in (good[:-9], good.replace(b"7\r\n", b"zz\r\n"), good.replace(b"7\r\n", b"ff\r\n")):
        assert read_one(spark, tmp_path, response(bad)) == [("damaged", None, None)]
    assert read_one(spark, tmp_path, response(good, "sha1:" + "A" * 32)) == [("damaged", None, None)]


def test_files_end_by_their_true_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    draw = np.random.default_rng(1)
    html = ["".join(map(chr, draw.integers(33, 1000, 60_000))) for _ in range(4)]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("*", "'u' url").coalesce(1)
    archives = warc.write_archives(pages)
    assert archives.count() == 4
    found = {r["page_id"]: (r["record_type"], r["payload"].decode()) for r in warc.read_archives(archives, True).collect()}
    assert found == {k: ("response", h) for k, h in enumerate(html)}


def test_revisits_name_a_record(spark):
    rows = [(1, "http://b/1", "x" * 1500), (2, "http://b/2", "x" * 1500), (2, "http://b/2", "x" * 1500), (2, "http://b/2", "y" * 90_000), (3, None, "y" * 90_000)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    heads = [f for r in archives.collect() for f, _ in warc.records(read_file(r["path"]))]
    ids = {f["warc-record-id"] for f in heads}
    revisits = [f for f in heads if f["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(f["warc-refers-to"] in ids for f in revisits)
    assert {f.get("warc-refers-to-target-uri") for f in revisits} == {"http://b/2", None}
    found = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.read_archives(archives).collect())
    assert found == [(1, "revisit", 2, 1500), (2, "response", 0, 1500), (2, "response", 0, 1500), (2, "revisit", 3, 90_000), (3, "response", 0, 90_000)]


def test_rank_directories_are_checked():
    ids = np.arange(0, 300_000, 7, dtype="<u4")
    raw = token_files.encode_file([1], np.array([0, len(ids)]), ids)
    held = token_files.TokenFile(raw)
    assert np.array_equal(held.scan(), ids)
    held._ranks[0] = held._ranks[0] + np.uint64(1)
    with pytest.raises(ValueError):
        held.scan()
