"""Rows that once were lost: ids on several rows, several blocks of items, long headers, records beside a bad one in their member."""

import pytest

from textlode.llm import decontaminate, pipeline, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block_words", [1 << 22, 40])
def test_decontamination_keeps_rows_of_one_id(spark, block_words):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(f"b{i}", " ".join(words[i:i + 12])) for i in range(0, 48, 6)] + [("b0", " ".join(words[:12]))], "item_id string, text string")
    rows = [(1, " ".join(words[:12])), (1, " ".join(words[30:45])), (None, "x " + " ".join(words[6:18])), (None, None), (2, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, bench, block_words=block_words).collect())
    one = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == one and len(got) == 5 and [r[2] for r in got] == [0, 12, 12, 12, 0]


def test_near_duplicates_judge_rows_of_one_id_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, None), (5, ""), (None, a), (6, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text or "") for r in pipeline.near_duplicate_stage(spark, docs, SMALL).collect())
    assert got == sorted([(0, a), (1, a), (2, b), (4, c), (5, ""), (5, "")])


def test_long_headers_and_bad_records_inside_members(spark, tmp_path):
    pages = spark.createDataFrame([(1, "data:" + "x" * 70000, "y" * 200), (2, "http://b", "z" * 300)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    back = {r.record_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "w")).filter("record_id is not null").collect()}
    assert back == {"1": 200, "2": 300}
    record = lambda i: warc._record(b"response", str(i).encode(), b"http://x", warc.hashlib.sha256(b"p%d" % i).hexdigest().encode(), 2, None, b"p%d" % i) + b"\r\n\r\n"
    bad = record(2).replace(b"p2", b"q2")
    whole = list(warc.salvage(warc._member(record(1) + bad + record(3))))
    assert [x[0] for x in whole] == ["record", "gap", "record"] and [x[3] for x in whole if x[0] == "record"] == [b"p1", b"p3"]
    broken = warc._member(b"".join(record(i) for i in range(1, 40)))
    cut = broken[:len(broken) * 2 // 3] + warc._member(record(50))
    parts = list(warc.salvage(cut))
    kept = [x[3] for x in parts if x[0] == "record"]
    assert kept[:3] == [b"p1", b"p2", b"p3"] and kept[-1] == b"p50" and any(x[0] == "gap" for x in parts)
