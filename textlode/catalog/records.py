"""Stored state as records and back, reading of raw files, and session commands."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import index, ordering, session as S
from ..sources import files as filesrc, persist, prebuilt, records
from . import registry as R
from .indexes import _FIN, _vocab
from .registry import corpus, edges, query, symbols, table, turns
from .sessions import NUM, SUMMARY

c = F.col
BIG = lambda *names: [c(n).cast("bigint").alias(n) for n in names]


def _again(df, name="t"):
    return records.import_records(records.export_records({name: df, "other": df.limit(0)}), name, df.schema)


@query("snk_01_index_records", f"SELECT 'symbols' AS part, key AS a, name AS b, line::BIGINT AS n FROM ({R.SYMBOLS}) UNION ALL SELECT 'edges', caller, callee, ord FROM ({R.EDGES})")
def _(spark, sf):
    tables = {"symbols": symbols(spark, sf), "edges": edges(spark, sf)}
    r = records.export_records(tables)
    s, e = (records.import_records(r, n, df.schema) for n, df in tables.items())
    return s.select(F.lit("symbols").alias("part"), c("key").alias("a"), c("name").alias("b"), c("line").cast("bigint").alias("n")).unionByName(
        e.select(F.lit("edges").alias("part"), c("caller").alias("a"), c("callee").alias("b"), c("ord").alias("n")))


@query("snk_02_rederived_names", f"SELECT lower(name) AS name_lower, count(*) AS keys FROM ({R.SYMBOLS}) GROUP BY 1")
def _(spark, sf):
    return index.symbol_names(_again(symbols(spark, sf))).groupBy("name_lower").agg(F.count("*").alias("keys"))


@query("snk_04_posting_records", f"SELECT path, term, tf FROM ({R.TF})")
def _(spark, sf):
    docs = index.plain_feed(corpus(spark, sf))
    if not ordering.one_row_each(docs, "doc_id"):
        return _again(index.postings(docs)).select(c("doc_id").alias("path"), "term", *BIG("tf"))
    lists = _again(index.posting_lists(docs))  # a record for each document
    return lists.select(c("doc_id").alias("path"), F.inline_outer(F.arrays_zip(c("terms").alias("term"), "tf"))).filter("term is not null")


@query("snk_05_vector_records", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def _(spark, sf):
    v = _again(table(spark, sf, "embeddings"))
    return v.select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("snk_08_restore_by_fingerprint", f"SELECT 'same' AS corpus, path FROM ({R.DOCS})")
def _(spark, sf):
    files = corpus(spark, sf).select("path", "content")
    r, stored = records.export_records({"files": files.select("path")}), persist.fingerprint(files)
    changed = files.withColumn("content", F.when(c("path") == files.agg(F.max("path")).scalar(), F.concat("content", F.lit("x"))).otherwise(c("content")))
    same = records.restored(r, "files", "path string", stored, files).select(F.lit("same").alias("corpus"), "path")
    return same.unionByName(records.restored(r, "files", "path string", stored, changed).select(F.lit("changed").alias("corpus"), "path"))


@query("snk_13_vocabulary_records", f"SELECT term, df, round(weight, 4) AS weight FROM ({_FIN})")
def _(spark, sf):
    return _again(_vocab(spark, sf).select("term", "df", "weight")).select("term", "df", F.round("weight", 4).alias("weight"))


@query("snk_15_session_records", f"SELECT session, seq, md5(user) AS user, md5(assistant) AS assistant FROM ({R.TURNS})")
def _(spark, sf):
    t = turns(spark, sf)
    old = records.export_records({"turns": t}, "0.9")
    r = records.export_records({"turns": t}, "1.0.0").unionByName(old)
    return records.import_records(r, "turns", t.schema, "1.0.0").select("session", "seq", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"))


@query("snk_19_state_record", f"SELECT 'ws' AS workspace, (SELECT count(*) FROM ({R.DOCS})) AS file_count, (SELECT count(*) FROM ({R.SYMBOLS})) AS symbol_count")
def _(spark, sf):
    return _again(records.state(corpus(spark, sf), symbols(spark, sf), "ws")).select("workspace", "file_count", "symbol_count")


def _raw(spark, sf):
    """documents as raw files, each once under a path that a scan reads (every third in Latin-1 if that can hold it), and copies under paths that it skips."""
    d = table(spark, sf, "documents")
    name = c("doc_id").cast("string")
    folder = F.element_at(F.array(F.lit("src"), F.lit("src/a/b"), F.lit("lib/c")), (c("doc_id") % 3 + 1).cast("int"))
    latin = (c("doc_id") % 3 == 0) & ~c("text").rlike("[^\\x00-\\xff]")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    skipped = F.array(F.concat(F.lit("node_modules/x/"), name, F.lit(".txt")), F.concat(F.lit(".hidden/"), name, F.lit(".txt")), F.concat(F.lit("src/"), name, F.lit(".png")),
                      F.concat(F.lit("src/a/b/c/d/"), name, F.lit(".txt")))
    paths = F.concat(F.array(F.concat(folder, F.lit("/"), name, F.lit(".txt"))), F.when(c("doc_id") % 5 == 0, skipped).otherwise(F.array().cast("array<string>")))
    return d.select(F.explode(paths).alias("path"), raw.alias("raw")).withColumn("length", F.octet_length("raw").cast("bigint"))


_READ = "SELECT ['src', 'src/a/b', 'lib/c'][doc_id % 3 + 1] || '/' || doc_id || '.txt' AS path, text FROM documents"


@query("src_01_read_file", f"SELECT path, md5(text) AS h FROM ({_READ} UNION ALL SELECT 'src/a/b/c/d/' || doc_id || '.txt', text FROM documents WHERE doc_id % 5 = 0)")
def _(spark, sf):
    kept = filesrc.select_files(_raw(spark, sf))
    return filesrc.corpus(kept.withColumn("content", filesrc.decode(c("raw")))).select("path", F.md5("content").alias("h"))


@query("src_02_folder_scan", f"SELECT path FROM ({_READ})")
def _(spark, sf):
    return filesrc.select_files(_raw(spark, sf), max_depth=3).select("path")


@query("src_10_prebuilt_index", f"SELECT path, md5(content) AS h FROM ({R.DOCS})")
def _(spark, sf):
    """documents as full index records of one file each, parsed back and joined to texts."""
    lines = F.transform(F.split("content", "\n", -1), lambda t, i: F.struct((i + 1).alias("line"), t.alias("content"), F.lower(t).alias("lower")))
    one = F.create_map("path", F.struct(c("path"), F.lit(".txt").alias("ext"), lines.alias("content")))
    text = corpus(spark, sf).select(F.to_json(F.struct(F.lit("1").alias("version"), F.lit("full").alias("type"), one.alias("files"))).alias("body"))
    parsed = text.select(F.from_json("body", prebuilt.SCHEMA).alias("i")).select("i.*")
    return prebuilt.stored_files(parsed).select("path", F.md5("content").alias("h"))


_CMD = ("/history 2", "/show 1", "/search ring", "/stats", "/compare 1 2")


@query("cls_14_session_commands", f"""WITH t AS (SELECT *, {SUMMARY} AS summary FROM ({NUM})), h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY number DESC) AS rn FROM t),
 f AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY number) AS rn FROM t WHERE contains(lower(user), 'ring') OR contains(lower(assistant), 'ring'))
 SELECT session, command, number, part, md5(text) AS h FROM (SELECT session, '/history 2' AS command, number, 'summary' AS part, summary AS text FROM h WHERE rn <= 2
 UNION ALL SELECT session, '/search ring', number, 'summary', summary FROM f WHERE rn <= 10 UNION ALL SELECT session, '/show 1', number, 'user', user FROM t WHERE number = 1 UNION ALL SELECT session, '/show 1', number, 'assistant', assistant FROM t WHERE number = 1
 UNION ALL SELECT session, '/compare 1 2', number, 'lengths', length(user) || '|' || length(assistant) FROM t WHERE number IN (1, 2)
 UNION ALL SELECT session, '/stats', NULL, 'totals', count(*) || '|' || sum(length(user) + length(assistant)) || '|' || sum(len(regexp_extract_all(assistant, '```(\\w*)\\n((?s:.)*?)```'))) FROM t GROUP BY session)""")
def _(spark, sf):
    numbered = S.retain(S.add_facts(turns(spark, sf)), fixed.MAX_TURNS)
    asked = numbered.select("session").distinct().select("session", F.explode(F.array(*[F.lit(x) for x in _CMD])).alias("command"))
    return S.run_commands(asked, numbered).select("session", "command", "number", "part", F.md5("text").alias("h"))


_KIND = "doc_id % 2 = 0 AS piped, doc_id % 3 = 0 AS h, doc_id % 5 = 0 AS w, doc_id % 7 = 0 AS a, doc_id % 11 = 0 AS llm"


@query("cls_19_gathered_sources", f"""SELECT doc_id, CASE WHEN p <> '' AND length(p) > 50 THEN '🔗 Piped;' ELSE '' END || CASE WHEN h AND p = '' AND length(t) > 50 THEN '📜 History;' ELSE '' END || CASE WHEN w AND t <> '' THEN '🔍 Workspace (2 files);' ELSE '' END
 || CASE WHEN a AND length(t) > 50 THEN '📎 Attachments (1);' ELSE '' END || CASE WHEN llm THEN '🤖 LLM only;' ELSE '' END AS used, md5(CASE WHEN p <> '' THEN p || chr(10) || chr(10) ELSE '' END || CASE WHEN h AND p = '' AND t <> '' THEN t || chr(10) || chr(10) ELSE '' END
 || CASE WHEN w AND t <> '' THEN '## Reference Code from Workspace' || chr(10) || chr(10) || t || source || chr(10) || chr(10) ELSE '' END || CASE WHEN a AND length(t) > 50 THEN '## Reference from Attachments' || chr(10) || chr(10) || t || chr(10) || chr(10) ELSE '' END) AS h
 FROM (SELECT *, coalesce(text, '') AS t, CASE WHEN piped THEN coalesce(text, '') ELSE '' END AS p FROM (SELECT *, {_KIND} FROM documents))""")
def _(spark, sf):
    from ..operators import context
    d = table(spark, sf, "documents")
    requests = d.selectExpr("doc_id AS request", *[x.strip() for x in _KIND.split(",")[1:]])
    part = lambda source, text, n=0: d.select(F.col("doc_id").alias("request"), F.lit(source).alias("source"), F.lit(n).alias("ord"), F.lit("x").alias("name"), text.alias("content"))
    text = F.col("text")
    parts = part("piped", text).filter("request % 2 = 0").unionByName(part("history", text)).unionByName(part("workspace", text)).unionByName(part("workspace", F.when(text != "", F.col("source")), 1)) \
        .unionByName(part("attachments", text))
    got = context.gather_sources(parts, requests)
    used = F.array_join(F.transform("sources_used", lambda u: F.concat(u, F.lit(";"))), "")
    return got.select(F.col("request").alias("doc_id"), used.alias("used"), F.md5("content").alias("h"))
