from pyspark.sql import functions as F

from textlode.operators import session as S, topk
from textlode.sources import documents, files as filesrc, persist, prebuilt
from textlode.streaming import sessions


def turn_rows(n):
    return [("s1", i, f"ask {i}", f"answer {i} " + ("```py\nx\n```" if i == n - 1 else "")) for i in range(n)]


SCHEMA = "session string, seq bigint, user string, assistant string"


def test_retention_renumbers_and_tags_follow(spark):
    turns = S.add_facts(spark.createDataFrame(turn_rows(52), SCHEMA))
    kept = S.retain(turns)
    rows = {r["seq"]: r["number"] for r in kept.collect()}
    assert len(rows) == 50 and rows[2] == 1 and rows[51] == 50
    marks = spark.createDataFrame([("s1", 0, "a"), ("s1", 2, "a"), ("s1", 51, "a")], "session string, seq bigint, tag string")
    assert sorted(r["number"] for r in S.turns_by_tag(S.renumber_marks(marks, kept), "a").collect()) == [1, 50]


def test_references(spark):
    turns = S.retain(S.add_facts(spark.createDataFrame(turn_rows(3), SCHEMA)))
    msgs = spark.createDataFrame([(1, "s1", "see @1.user, @last.code[0] and @9"), (2, "s1", "plain")], "message_id int, session string, text string")
    got = {r["message_id"]: r["expanded"] for r in S.expand_references(msgs, turns).collect()}
    assert got == {1: "see ask 0, x and @9", 2: "plain"}


def test_stream_matches_batch(spark, tmp_path):
    rows = turn_rows(7) + [("s2", 1, "u", "v")]
    src, out = str(tmp_path / "in"), "bounded_turns_out"
    df = spark.createDataFrame(rows, SCHEMA)
    df.filter("seq < 4").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = sessions.bounded_turns(stream, 3).writeStream.outputMode("append").format("memory").queryName(out) \
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        df.filter("seq >= 4").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table(out).filter("session = 's1'").orderBy("turn_id").collect()
    assert [(r["turn_id"], r["number"]) for r in got] == [(2, 1), (3, 2), (4, 3), (5, 1), (6, 2), (7, 3)]
    last = {r["user"] for r in S.retain(df.filter("session = 's1'"), 3).collect()}
    assert {r["user"] for r in got if r["turn_id"] >= 5} == last


def test_scan_decode_and_rules(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes("x = 'é'\n".encode())
    (tmp_path / "src" / "latin.c").write_bytes("é".encode("latin-1"))
    (tmp_path / "src" / "pic.png").write_bytes(b"1")
    (tmp_path / "node_modules" / "b.js").write_bytes(b"1")
    got = {r["path"]: (r["content"], r["language"], r["line_count"]) for r in filesrc.read_text(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("x = 'é'\n", "python", 2), "src/latin.c": ("é", "c", 1)}


def test_documents_never_fail_the_job(spark):
    raw = spark.createDataFrame([("a.docx", bytearray(b"no"))], "path string, raw binary")
    r = documents.parse_documents(raw).first()
    assert r["text"] is None and r["error"]
    ok = documents.parse_documents(raw, {"docx": lambda b: (b.decode(), 2, None)})
    assert documents.for_index(ok).first()["content"] == "[Document: a.docx]\n[Format: Word]\n[Pages: 2]\n\nno"


def test_naive_pdf_and_xsd(spark):
    pdf = spark.createDataFrame([(bytearray(b"BT [(Hello) (ab)] TJ ET (world text)"),)], "raw binary")
    assert "Hello world text Hello ab" in pdf.select(documents.naive_pdf_text(F.col("raw"))).first()[0]
    xsd = ('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="e" type="T" maxOccurs="3"/>'
           '<xs:simpleType name="T"><xs:restriction base="xs:string"><xs:enumeration value="A"/></xs:restriction></xs:simpleType></xs:schema>')
    df = spark.createDataFrame([("a.xsd", xsd), ("b.xsd", "<no")], "path string, content string")
    rows = {(r["path"], r["kind"], r["name"], r["base"]) for r in documents.xsd_components(df).collect()}
    assert rows == {("a.xsd", "element", "e", "T"), ("a.xsd", "simpleType", "T", "xs:string"), ("b.xsd", None, None, None)}
    assert documents.xsd_markdown(documents.xsd_components(df)).count() == 2


def test_sheet_tables(spark):
    cells = spark.createDataFrame([("x", "s", 0, [None, None]), ("x", "s", 1, ["a", "b"]), ("x", "s", 2, ["1|2", None])],
                                  "path string, sheet string, row_no int, cells array<string>")
    assert documents.table_markdown(cells).first()["markdown"] == "| a | b |\n|---|---|\n| 1\\|2 |  |"


def test_save_restore_and_prebuilt(spark, code, tmp_path):
    root = str(tmp_path / "ix")
    meta = persist.metadata(code, code, "ws")
    persist.save_tables({"files": code, "metadata": meta}, root)
    assert persist.restore_if_same(spark, root, code, ["files"])["files"].count() == 3
    assert persist.restore_if_same(spark, root, code.filter("ord = 1"), ["files"]) is None
    stored = spark.read.parquet(root + "/metadata")
    assert not persist.is_stale(stored, "ws").first()["stale"] and persist.is_stale(stored, "other").first()["stale"]
    old = F.current_timestamp() + F.expr("interval 25 hours")
    assert persist.is_stale(stored, "ws", old).first()["stale"]
    rows = {r["path"]: [f["name"] for f in r["functions"] or []] for r in prebuilt.build(code).collect()}
    assert rows["src/py/foo.py"] == ["Foo", "bar", "baz"]


def greedy(blocks):
    kept = []
    for line, n in blocks:
        s, e = line, line + n
        for k, (ks, ke, kn) in enumerate(kept):
            if s <= ke + 5 and e >= ks - 5:
                if n > ke - ks:
                    kept[k] = (s, e, n)
                break
        else:
            kept.append((s, e, n))
    return sorted((s, n) for s, _, n in kept)


def test_block_merge_matches_one_big_fold(spark):
    blocks = [(100, 10), (115, 3), (116, 3), (300, 2), (104, 30), (308, 9), (900, 1), (124, 4)]
    df = spark.createDataFrame([("f", line, "x\n" * (n - 1) + "x", i) for i, (line, n) in enumerate(blocks)],
                               "file string, line int, code string, ord long")
    got = sorted((r["line"], r["code"].count("x")) for r in topk.merge_blocks(df).collect())
    assert got == greedy(blocks)


def test_truncate_keeps_short_text(spark):
    df = spark.createDataFrame([("# head\n" + "body line\n" * 50,), ("short",)], "t string")
    got = [r["t"] for r in topk.truncated(df, "t", 100).collect()]
    assert got[1] == "short" and got[0].startswith("# head\nbody line") and got[0].endswith("[Context truncated]") and len(got[0]) < 130
