"""Session operators over conversations and events."""

from pyspark.sql import functions as F

from ..operators import ordering, session as S
from . import registry as R
from .registry import query, table, turns

c = F.col
BIG = lambda *names: [c(n).cast("bigint").alias(n) for n in names]
NUM = f"SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS number FROM ({R.TURNS})"
KEPT = f"SELECT session, seq, user, assistant, row_number() OVER (PARTITION BY session ORDER BY seq) AS number FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn FROM ({R.TURNS})) WHERE rn <= 2"
BLOCKS = "len(regexp_extract_all({0}, '```(\\w*)\\n((?s:.)*?)```'))"
SUMMARY = ("CASE WHEN contains(assistant, '```') THEN '💻' WHEN contains(assistant, '##') OR contains(assistant, '**') THEN '📝' WHEN length(assistant) < 200 THEN '💬' ELSE '📄' END || ' ' || left(split_part(user, chr(10), 1), 50) || '...' || "
           "CASE WHEN {b} > 1 THEN ' [' || {b} || ' code blocks]' WHEN {b} = 1 THEN ' [1 code block]' ELSE '' END").format(b=BLOCKS.format("assistant"))


def _facts(spark, sf):
    return S.add_facts(turns(spark, sf))


def _kept(spark, sf, n=2):
    return S.retain(_facts(spark, sf), n)


@query("ses_01_append_turns", f"SELECT session, seq, length(user) AS user_length, length(assistant) AS assistant_length, false AS truncated FROM ({R.TURNS})")
def _(spark, sf):
    return _facts(spark, sf).select("session", "seq", *BIG("user_length", "assistant_length"), "truncated")


@query("ses_01_truncation", f"SELECT session, seq, length(assistant) > 300 AS truncated, md5(CASE WHEN length(assistant) > 300 THEN left(assistant, 300) || chr(10) || chr(10) || '[... truncated ...]' ELSE assistant END) AS h FROM ({R.TURNS})")
def _(spark, sf):
    return S.add_facts(turns(spark, sf), 300).select("session", "seq", "truncated", F.md5("assistant").alias("h"))


@query("str_42_turn_summary", f"SELECT session, seq, {SUMMARY} AS summary FROM ({R.TURNS})")
def _(spark, sf):
    return _facts(spark, sf).select("session", "seq", "summary")


@query("ses_02_retain_and_renumber", f"SELECT session, seq, number FROM ({KEPT})")
def _(spark, sf):
    return _kept(spark, sf).select("session", "seq", *BIG("number"))


_TAGS = f"SELECT session, seq, CASE WHEN seq % 3 = 0 THEN 'todo' ELSE 'done' END AS tag FROM ({R.TURNS})"


def _tags(spark, sf):
    return turns(spark, sf).select("session", "seq", F.when(c("seq") % 3 == 0, "todo").otherwise("done").alias("tag"))


@query("ses_04_turns_by_tag", f"SELECT session, number FROM ({_TAGS}) JOIN ({KEPT}) USING (session, seq) WHERE tag = 'todo'")
def _(spark, sf):
    return S.turns_by_tag(S.renumber_marks(_tags(spark, sf), _kept(spark, sf)), "todo").select("session", *BIG("number"))


@query("ses_05_bookmarks", f"SELECT session, array_to_string(list(number ORDER BY number), '|') AS marks FROM ({_TAGS}) JOIN ({KEPT}) USING (session, seq) WHERE tag = 'done' GROUP BY session")
def _(spark, sf):
    m = S.renumber_marks(_tags(spark, sf).filter("tag = 'done'"), _kept(spark, sf))
    return m.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("number")).cast("array<string>"), "|").alias("marks"))


@query("ses_03_search_turns", f"SELECT session, seq, array_to_string(list_filter([CASE WHEN contains(lower(user), 'ering') THEN 'user message' END, CASE WHEN contains(lower(assistant), 'ering') THEN 'response' END], lambda x: x IS NOT NULL), '|') AS matches FROM ({R.TURNS}) WHERE contains(lower(user), 'ering') OR contains(lower(assistant), 'ering')")
def _(spark, sf):
    return S.search_turns(turns(spark, sf), "ERing").select("session", "seq", R.joined("matches").alias("matches"))


@query("ses_06_turn_list", f"SELECT session, number, CASE WHEN seq % 3 <> 0 THEN '⭐ ' ELSE '' END || '@' || number || ': ' || {SUMMARY} AS line FROM ({KEPT})")
def _(spark, sf):
    kept = _kept(spark, sf)
    marks = S.renumber_marks(_tags(spark, sf).filter("tag = 'done'"), kept)
    return S.turn_list(kept, 10, marks).select("session", *BIG("number"), "line")


_FENCED = f"SELECT session, seq, 'see ' || chr(96) || chr(96) || chr(96) || 'sql' || chr(10) || user || chr(10) || chr(96) || chr(96) || chr(96) || ' and ' || chr(96) || chr(96) || chr(96) || chr(10) || assistant || chr(96) || chr(96) || chr(96) AS t, user, assistant, number FROM ({NUM})"


def _fenced(spark, sf):
    t = S.retain(_facts(spark, sf))
    return t.withColumn("assistant", F.concat(F.lit("see ```sql\n"), "user", F.lit("\n``` and ```\n"), "assistant", F.lit("```")))


@query("ses_07_code_block", f"SELECT session, 'text' AS language, trim(assistant, ' ' || chr(10)) AS code FROM ({_FENCED}) WHERE number = 1")
def _(spark, sf):
    return S.code_block(_fenced(spark, sf), 1, 1).select("session", "language", "code")


@query("prs_21_fenced_blocks", f"SELECT session, number, 4 + CASE i WHEN 0 THEN 0 ELSE length(user) + 16 END AS start, CASE i WHEN 0 THEN 'sql' ELSE 'text' END AS language FROM ({_FENCED}), (SELECT unnest([0, 1]) AS i)".replace("length(user) + 16", "length(user) + 16"))
def _(spark, sf):
    from ..functions import text
    b = _fenced(spark, sf).select("session", "number", F.explode(text.fenced_blocks(c("assistant"))).alias("b"))
    return b.select("session", *BIG("number"), c("b.start").cast("bigint").alias("start"), "b.language")


@query("agg_09_session_stats", f"SELECT session, count(*) AS total_turns, sum(length(user) + length(assistant))::BIGINT AS total_chars, 0::BIGINT AS total_blocks FROM ({R.TURNS}) GROUP BY session")
def _(spark, sf):
    return S.session_stats(turns(spark, sf)).select("session", "total_turns", *BIG("total_chars", "total_blocks"))


@query("top_12_recent_turns", f"SELECT session, seq FROM ({NUM}) QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 2")
def _(spark, sf):
    return S.last_turns(turns(spark, sf), 2).select("session", "seq")


@query("src_33_history", f"SELECT session, md5(string_agg(assistant || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY seq)) AS content FROM (SELECT * FROM ({R.TURNS}) WHERE length(assistant) > 50 QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 2) GROUP BY session")
def _(spark, sf):
    return S.history(turns(spark, sf), 2).select("session", F.md5("content").alias("content"))


@query("str_44_expand_references", f"SELECT m.session, m.number, 'compare ' || coalesce(t.user, '@' || (m.number - 1) || '.user') || ' with ' || l.assistant || ' end' AS expanded FROM ({NUM}) m LEFT JOIN ({NUM}) t ON t.session = m.session AND t.number = m.number - 1 "
       f"JOIN (SELECT session, arg_max(assistant, number) AS assistant FROM ({NUM}) GROUP BY session) l ON l.session = m.session")
def _(spark, sf):
    t = S.retain(_facts(spark, sf))
    msgs = t.select("session", "number", F.concat_ws("-", c("session").cast("string"), c("number").cast("string")).alias("message_id"),
                    F.concat(F.lit("compare @"), (c("number") - 1).cast("string"), F.lit(".user with @last end")).alias("text"))
    return S.expand_references(msgs, t).select("session", *BIG("number"), "expanded")


_RING = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"


def _ring(spark, sf):
    return S.history_ring(table(spark, sf, "events"), 20, "user_id", "event_id")


@query("ses_08_history_ring", f"SELECT user_id, event_id, id FROM ({_RING}) WHERE rn <= 20")
def _(spark, sf):
    return _ring(spark, sf).select("user_id", "event_id", *BIG("id"))


@query("ses_09_history_item", f"SELECT user_id, event_id, event_type FROM ({_RING}) WHERE rn <= 20 AND id = 60")
def _(spark, sf):
    return S.history_results(_ring(spark, sf), 60).select("user_id", "event_id", "event_type")


@query("ses_10_reuse_item", f"SELECT a.user_id, e.event_id FROM ({_RING}) a JOIN events e ON e.user_id = a.user_id AND e.event_type = a.event_type WHERE a.rn <= 20 AND a.id = 60")
def _(spark, sf):
    item = S.history_results(_ring(spark, sf), 60).select("user_id", "event_type")
    return table(spark, sf, "events").join(item, ["user_id", "event_type"]).select("user_id", "event_id")


@query("ses_12_bounded_chat", f"SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _(spark, sf):
    return ordering.top_per_key(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


# A log of commands between the turns; turn k of a session has the numbers 100 k, its commands those behind it.
_LOG = ("/bookmark 1", "/tag 2 todo", "/tag 1 todo", "/bookmarks", "/tagged todo", "/stats", "/show 2", "/history 2", "/bookmark 99", "/bookmarks", "/search ering", "/compare 1 2", "/export-session")
_EVENTS = (f"SELECT session, seq * 100 AS seq, user, assistant, {SUMMARY} AS summary, row_number() OVER (PARTITION BY session ORDER BY seq) AS turn FROM ({R.TURNS})")
_REPLAY = f"""WITH t AS ({_EVENTS}), m AS (SELECT session, seq, turn, CASE WHEN turn % 4 = 3 THEN true ELSE false END AS clears FROM t),
 s AS (SELECT t.*, turn // 4 AS stretch, CASE WHEN turn < 4 THEN turn ELSE turn % 4 + 1 END AS number FROM t),
 c AS (SELECT session, seq + 1 + i AS seq, i, stretch, number AS n FROM s, (SELECT unnest(range(0, {len(_LOG)})) AS i)),
 mark AS (SELECT session, stretch, 1 AS number, min(seq) AS since FROM c WHERE i = 0 GROUP BY ALL),
 tag AS (SELECT session, stretch, CASE i WHEN 1 THEN 2 ELSE 1 END AS number, min(seq) AS since FROM c WHERE i IN (1, 2) AND CASE i WHEN 1 THEN 2 ELSE 1 END <= n GROUP BY ALL),
 v AS (SELECT c.session, c.seq, c.i, c.n, s.number, s.user, s.assistant, s.summary FROM c JOIN s USING (session, stretch) WHERE s.number <= c.n)
SELECT session, seq, kind, number::BIGINT AS number, part, md5(text) AS h FROM (
 SELECT session, seq, 'history' AS kind, number, 'summary' AS part, summary AS text FROM v WHERE i = 7 AND number > n - 2
 UNION ALL SELECT session, seq, 'show', number, 'user', user FROM v WHERE i = 6 AND number = 2 UNION ALL SELECT session, seq, 'show', number, 'assistant', assistant FROM v WHERE i = 6 AND number = 2
 UNION ALL SELECT session, seq, 'search', number, 'summary', summary FROM v WHERE i = 10 AND (contains(lower(user), 'ering') OR contains(lower(assistant), 'ering'))
 UNION ALL SELECT session, seq, 'compare', number, 'lengths', length(user) || '|' || length(assistant) FROM v WHERE i = 11 AND number IN (1, 2)
 UNION ALL SELECT c.session, c.seq, 'list-bookmarks', s.number, 'summary', summary FROM c JOIN mark k USING (session, stretch) JOIN s USING (session, stretch) WHERE c.i IN (3, 9) AND k.since < c.seq AND s.number = k.number
 UNION ALL SELECT c.session, c.seq, 'tagged', s.number, 'summary', summary FROM c JOIN tag k USING (session, stretch) JOIN s USING (session, stretch) WHERE c.i = 4 AND k.since < c.seq AND s.number = k.number
 UNION ALL SELECT session, seq, 'stats', NULL, 'totals', n || '|' || sum(length(user) + length(assistant)) || '|' || sum({BLOCKS.format('assistant')}) || '|1|1' FROM v WHERE i = 5 GROUP BY session, seq, n
 UNION ALL SELECT session, seq, 'export', NULL, 'state', '{{"turns":' || n || ',"bookmarks":[1],"tags":[{{"tag":"todo","number":1}}' || CASE WHEN n > 1 THEN ',{{"tag":"todo","number":2}}' ELSE '' END || ']}}' FROM c WHERE i = 12
 UNION ALL SELECT session, seq, CASE WHEN i IN (1, 2) THEN 'tag' ELSE 'bookmark' END, CASE i WHEN 1 THEN 2 WHEN 8 THEN 99 ELSE 1 END, 'changed', CASE WHEN i IN (0, 2) OR i = 1 AND n >= 2 THEN 'true' ELSE 'false' END FROM c WHERE i IN (0, 1, 2, 8)
 UNION ALL SELECT session, seq + 90, 'clear', NULL, 'changed', 'true' FROM m WHERE clears)"""


@query("cls_14_command_replay", _REPLAY)
def _(spark, sf):
    from pyspark.sql import Window
    t = turns(spark, sf).withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("seq")))
    logged = t.select("session", (c("seq") * 100).alias("seq"), "turn", F.posexplode(F.array(*[F.lit(x) for x in _LOG])).alias("i", "command"))
    log = logged.select("session", (c("seq") + 1 + c("i")).alias("seq"), "command")
    log = log.unionByName(t.filter("turn % 4 = 3").select("session", (c("seq") * 100 + 90).alias("seq"), F.lit("/clear-history").alias("command")))
    answers = S.replay_commands(log, t.select("session", (c("seq") * 100).alias("seq"), "user", "assistant"))
    return answers.select("session", "seq", "kind", "number", "part", F.md5("text").alias("h"))


@query("ses_01_stream_retention", f"SELECT session::VARCHAR AS session, seq, number, md5(user || assistant) AS h FROM ({KEPT.replace('rn <= 2', 'rn <= 3')})")
def _(spark, sf):
    import uuid

    from ..streaming import sessions as stream
    folder = f"{ordering.shared_folder(spark)}/{uuid.uuid4()}"
    # three files, each a trigger: a session's turns come in several of them
    turns(spark, sf).repartition(3, c("seq") % 3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema("session long, seq long, user string, assistant string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = stream.run_retention(source, folder, 3)
    return kept.select("session", "seq", *BIG("number"), F.md5(F.concat("user", "assistant")).alias("h"))
