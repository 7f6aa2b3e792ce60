"""Session turns: retention, lookup, tags, references and history, per session id."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify, fixed, text
from ..functions.classify import REFERENCE
from . import ordering


def pair_turns(messages: DataFrame, session="session", order="seq", role="role", body="text", dense=False) -> DataFrame:
    """User messages with the assistant message right behind them: one turn each.

    Messages are sorted per session, so gaps in the numbers change nothing.  A caller who knows that the
    numbers have no gaps may set ``dense``: the next message is then an equi-join on (session, number), which
    spreads a session of any length over all tasks.
    """
    if dense:
        asked = messages.filter(F.col(role) == "user").select(session, F.col(order).alias("seq"), F.col(body).alias("user"))
        said = messages.filter(F.col(role) == "assistant").select(session, (F.col(order) - 1).alias("seq"), F.col(body).alias("assistant"))
        return asked.join(said, [session, "seq"])
    w = Window.partitionBy(session).orderBy(order)
    df = messages.withColumn("__role", F.lead(role).over(w)).withColumn("assistant", F.lead(body).over(w))
    return df.filter((F.col(role) == "user") & (F.col("__role") == "assistant")) \
        .select(session, F.col(order).alias("seq"), F.col(body).alias("user"), "assistant")


def add_facts(turns: DataFrame, most=fixed.MAX_RESPONSE_CHARS) -> DataFrame:
    """Truncate long responses and record lengths, code blocks and the summary label."""
    n = F.length("assistant")
    cut = F.when(n > most, F.concat(F.left("assistant", F.lit(most)), F.lit("\n\n[... truncated ...]"))).otherwise(F.col("assistant"))
    df = turns.withColumn("user_length", F.length("user")).withColumn("assistant_length", n) \
        .withColumn("truncated", n > most).withColumn("assistant", cut)
    return df.withColumn("summary", turn_summary(F.col("user"), F.col("assistant")))


def block_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"```(\w*)\n([\s\S]*?)```"))


def turn_summary(user: Column, response: Column) -> Column:
    """Icon by response form, first 50 characters of the question, code block count."""
    blocks = block_count(response)
    icon = (F.when(F.contains(response, F.lit("```")), "💻")
            .when(F.contains(response, F.lit("##")) | F.contains(response, F.lit("**")), "📝")
            .when(F.length(response) < 200, "💬").otherwise("📄"))
    code = F.when(blocks > 1, F.concat(F.lit(" ["), blocks.cast("string"), F.lit(" code blocks]"))) \
        .when(blocks == 1, F.lit(" [1 code block]")).otherwise(F.lit(""))
    return F.concat(icon, F.lit(" "), F.left(F.substring_index(user, "\n", 1), F.lit(50)), F.lit("..."), code)


def retain(turns: DataFrame, most=fixed.MAX_TURNS, session="session", order="seq") -> DataFrame:
    """The newest turns of each session under fresh numbers from 1; the stable id stays.

    The cut is a per-session top-k (trimmed before the shuffle), so the renumbering window
    never holds more than ``most`` rows per session.
    """
    newest = ordering.top_per_key(turns, [session], [F.desc(order)], most).drop("rn")
    return newest.withColumn("number", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def renumber_marks(marks: DataFrame, kept: DataFrame, session="session", order="seq") -> DataFrame:
    """Tags or bookmarks by stable id, evicted turns dropped, carrying the new number."""
    return marks.join(kept.select(session, order, "number"), [session, order])


def last_turns(turns: DataFrame, n=5, session="session", order="seq") -> DataFrame:
    return ordering.top_per_key(turns, [session], [F.desc(order)], n).drop("rn")


def search_turns(turns: DataFrame, query: str) -> DataFrame:
    low = F.lit(query.lower())
    sides = F.filter(F.array(F.when(F.contains(F.lower("user"), low), "user message"),
                             F.when(F.contains(F.lower("assistant"), low), "response")), lambda x: x.isNotNull())
    return turns.withColumn("matches", sides).filter(F.size("matches") > 0)


def turns_by_tag(tags: DataFrame, tag: str) -> DataFrame:
    return tags.filter(F.col("tag") == tag).select("session", "number").distinct()


def turn_list(turns: DataFrame, most=10, bookmarks: DataFrame = None) -> DataFrame:
    """One text line per recent turn: star for bookmarks, number, summary."""
    recent = last_turns(turns, most)
    if bookmarks is not None:
        recent = recent.join(bookmarks.select("session", "number").distinct().withColumn("__b", F.lit("⭐ ")),
                             ["session", "number"], "left")
    else:
        recent = recent.withColumn("__b", F.lit(None).cast("string"))
    return recent.select("session", "number", F.concat(
        F.coalesce("__b", F.lit("")), F.lit("@"), F.col("number").cast("string"), F.lit(": "), F.col("summary")).alias("line"))


def code_block(turns: DataFrame, number: int, index=None) -> DataFrame:
    """Code blocks of a turn, or the one at an index."""
    blocks = turns.filter(F.col("number") == number).select("session", F.posexplode(text.fenced_blocks(F.col("assistant"))).alias("i", "b")) \
        .select("session", "i", "b.*")
    return blocks if index is None else blocks.filter(F.col("i") == index)


def session_stats(turns: DataFrame, session="session") -> DataFrame:
    return turns.groupBy(session).agg(
        F.count("*").alias("total_turns"), F.sum(F.length("user") + F.length("assistant")).alias("total_chars"),
        F.sum(block_count(F.col("assistant"))).alias("total_blocks"))


def references(messages: DataFrame, key="message_id", body="text") -> DataFrame:
    """Turn references of each message, in order: (position, ref, turn, property, index)."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(f"({REFERENCE})"), F.lit(1)).alias("ref"),
        F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1)).alias("turn"),
        F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(2)).alias("prop"),
        F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(3)).alias("idx"))
    return messages.select(key, "session", F.posexplode(zipped).alias("i", "z")).select(
        key, "session", "i", "z.ref", F.lower("z.turn").alias("turn"),
        F.coalesce(F.nullif(F.lower("z.prop"), F.lit("")), F.lit("response")).alias("prop"),
        F.nullif("z.idx", F.lit("")).cast("int").alias("idx"))


def expand_references(messages: DataFrame, turns: DataFrame, key="message_id", body="text") -> DataFrame:
    """Messages with each reference replaced by the turn part it names.

    References become rows, join the turn table on (session, number), and the pieces of
    text between them are put back in order.  Unknown turns leave the reference as it is.
    """
    refs = references(messages, key, body)
    newest = turns.groupBy("session").agg(F.max("number").alias("__last"))
    refs = refs.join(newest, "session", "left").withColumn(
        "number", F.when(F.col("turn") == "last", F.col("__last")).otherwise(F.col("turn").try_cast("int")))
    t = turns.select("session", "number", "user", "assistant", "summary")
    n = F.col("number").cast("string")
    codes = F.transform(text.fenced_blocks(F.col("assistant")), lambda b: b["code"])
    code = (F.when(F.size(codes) == 0, F.concat(F.lit("[No code blocks in turn "), n, F.lit("]")))
            .when(F.col("idx").isNull(), F.array_join(codes, "\n\n"))
            .otherwise(F.coalesce(F.get(codes, F.col("idx")), F.concat(
                F.lit("[Code block "), F.col("idx").cast("string"), F.lit(" not found in turn "), n, F.lit("]")))))
    value = F.when(F.col("assistant").isNull(), F.col("ref")).when(F.col("prop") == "code", code) \
        .when(F.col("prop") == "user", F.col("user")).when(F.col("prop") == "summary", F.col("summary")).otherwise(F.col("assistant"))
    parts = refs.join(t, ["session", "number"], "left").withColumn("value", value)
    grouped = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("values"))
    gaps = F.split(body, REFERENCE, -1)
    text_again = F.array_join(F.zip_with(gaps, "values", lambda g, v: F.concat(g, F.coalesce(v["value"], F.lit("")))), "")
    return messages.join(grouped, key, "left").withColumn(
        "expanded", F.when(F.col("values").isNull(), F.col(body)).otherwise(text_again)).drop("values")


def history(turns: DataFrame, count=1, min_chars=50, session="session", order="seq") -> DataFrame:
    """The newest long responses of each session, oldest first, joined by rules."""
    long = turns.filter(F.length("assistant") > min_chars)
    kept = ordering.top_per_key(long, [session], [F.desc(order)], count)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("assistant").alias("a"))))
    return kept.groupBy(session).agg(parts.alias("p")).select(session, F.array_join(
        F.transform("p", lambda x: F.concat(x["a"], F.lit("\n\n---\n\n"))), "").alias("content"))


def history_ring(items: DataFrame, most: int, key="user", order="seq") -> DataFrame:
    """Bounded query history: running ids from 1 per user, the newest kept under their ids."""
    total = items.groupBy(key).agg(F.count("*").alias("__n"))
    newest = ordering.top_per_key(items, [key], [F.desc(order)], most)
    return newest.join(total, key).withColumn("id", F.col("__n") - F.col("rn") + 1).drop("__n", "rn")


def history_results(ring: DataFrame, item: int) -> DataFrame:
    return ring.filter(F.col("id") == item)


def run_commands(commands: DataFrame, turns: DataFrame, tags: DataFrame = None, marks: DataFrame = None, most=10) -> DataFrame:
    """Results of reading commands: (session, command, kind, number, part, text), any number of commands of any number of sessions.

    ``commands``: (session, command); ``turns``: numbered turns with summaries; ``tags``: (session, number, tag);
    ``marks``: (session, number).  Commands meet the turns by one join on the session; a search gives its first ``most`` turns.
    """
    asked = commands.withColumn("c", classify.session_command(F.col("command"))).filter("c.type is not null") \
        .select("session", "command", F.col("c.type").alias("kind"), F.col("c.arg1").alias("a"), F.col("c.arg2").alias("b"))
    with_turn = asked.join(turns.select("session", "number", "user", "assistant", "summary"), "session")
    number = F.col("number").cast("string")
    out = lambda df, part, text: df.select("session", "command", "kind", F.col("number").cast("bigint").alias("number"), part.cast("string").alias("part"), text.alias("text"))

    def newest(df, k):
        rank = F.row_number().over(Window.partitionBy("session", "command").orderBy(F.desc("number")))
        return df.withColumn("rn", rank).filter(F.col("rn") <= k)

    low = F.lower("a")
    found = with_turn.filter((F.col("kind") == "search") & (F.contains(F.lower("user"), low) | F.contains(F.lower("assistant"), low)))
    first = F.row_number().over(Window.partitionBy("session", "command").orderBy("number"))
    shown = with_turn.filter((F.col("kind") == "show") & (number == F.col("a")))
    pair = with_turn.filter((F.col("kind") == "compare") & ((number == F.col("a")) | (number == F.col("b"))))
    code = with_turn.filter((F.col("kind") == "code") & (number == F.col("a"))) \
        .select("session", "command", "kind", "number", F.posexplode(text.fenced_blocks(F.col("assistant"))).alias("i", "block"))
    total = with_turn.filter(F.col("kind") == "stats").groupBy("session", "command", "kind").agg(
        F.count("*").alias("turns"), F.sum(F.length("user") + F.length("assistant")).alias("chars"), F.sum(block_count(F.col("assistant"))).alias("blocks"))
    legs = [out(newest(with_turn.filter(F.col("kind") == "history"), F.col("a").cast("int")), F.lit("summary"), F.col("summary")),
            out(found.withColumn("rn", first).filter(F.col("rn") <= most), F.lit("summary"), F.col("summary")),
            out(shown, F.lit("user"), F.col("user")), out(shown, F.lit("assistant"), F.col("assistant")),
            out(pair, F.lit("lengths"), F.concat_ws("|", F.length("user").cast("string"), F.length("assistant").cast("string"))),
            out(code, F.col("i"), F.col("block.code")),
            out(total.withColumn("number", F.lit(None)), F.lit("totals"), F.concat_ws("|", *[F.col(n).cast("string") for n in ("turns", "chars", "blocks")]))]
    if tags is not None:
        legs.append(out(with_turn.filter(F.col("kind") == "tagged").join(tags.withColumnRenamed("tag", "a").distinct(), ["session", "number", "a"]), F.lit("summary"), F.col("summary")))
    if marks is not None:
        legs.append(out(with_turn.filter(F.col("kind") == "list-bookmarks").join(marks.distinct(), ["session", "number"]), F.lit("summary"), F.col("summary")))
    return reduce(DataFrame.unionByName, legs)


def replay_commands(log: DataFrame, turns: DataFrame, most=10) -> DataFrame:
    """Answers of a log of commands, each as the session stood when it came: (session, seq, kind, number, part, text).

    ``log``: (session, seq, command); ``turns``: (session, seq, user, assistant), on the same scale of ``seq``, not numbered.  /bookmark and /tag change what
    later commands see if the turn exists then; /clear-history drops turns, bookmarks and tags, and turns that come behind it are numbered from 1 again.
    State is not carried from row to row: a command belongs to the stretch between two clears, sees the turns of its stretch before it, and a mark counts
    from the first command that made it; so a session of any length is windows and joins.
    """
    asked = log.withColumn("c", classify.session_command(F.col("command"))).filter("c.type is not null") \
        .select("session", "seq", F.col("c.type").alias("kind"), F.col("c.arg1").alias("a"), F.col("c.arg2").alias("b"))
    facts = turns.select("session", "seq", "user", "assistant", turn_summary(F.col("user"), F.col("assistant")).alias("summary"))
    none = F.lit(None).cast("string")
    events = asked.select("*", none.alias("user"), none.alias("assistant"), none.alias("summary")).unionByName(
        facts.select("*", none.alias("kind"), none.alias("a"), none.alias("b")))
    w = Window.partitionBy("session").orderBy("seq")
    stretch = F.coalesce(F.count_if(F.col("kind") == "clear").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    events = events.withColumn("stretch", stretch)
    here = Window.partitionBy("session", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    events = ordering.cut_lineage(events.withColumn("n", F.count_if(F.col("kind").isNull()).over(here).cast("int")))
    said = events.filter("kind is null").select("session", "stretch", F.col("n").alias("number"), "user", "assistant", "summary")
    cmd = events.filter("kind is not null").select("session", "stretch", "seq", "kind", "a", "b", "n")

    target = F.col("a").cast("int")
    made = cmd.filter(F.col("kind").isin("bookmark", "tag") & (target >= 1) & (target <= F.col("n"))).withColumn("number", target)
    marks = made.filter("kind = 'bookmark'").groupBy("session", "stretch", "number").agg(F.min("seq").alias("since"))
    tags = made.filter("kind = 'tag'").groupBy("session", "stretch", "number", F.col("b").alias("tag")).agg(F.min("seq").alias("since"))

    at = ["session", "stretch"]
    seen = cmd.filter(F.col("kind").isin("history", "search", "show", "compare", "code", "stats")).join(said, at).filter(F.col("number") <= F.col("n"))
    out = lambda df, part, text: df.select("session", "seq", "kind", F.col("number").cast("bigint").alias("number"), part.cast("string").alias("part"), text.alias("text"))
    number, low = F.col("number").cast("string"), F.lower("a")
    found = seen.filter((F.col("kind") == "search") & (F.contains(F.lower("user"), low) | F.contains(F.lower("assistant"), low)))
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("session", "seq").orderBy("number"))).filter(F.col("rn") <= most)
    shown = seen.filter((F.col("kind") == "show") & (number == F.col("a")))
    code = seen.filter((F.col("kind") == "code") & (number == F.col("a"))).select("session", "seq", "kind", "number", F.posexplode(text.fenced_blocks(F.col("assistant"))).alias("i", "block"))
    known = cmd.join(marks, at).filter(F.col("since") < F.col("seq"))
    named = cmd.join(tags, at).filter(F.col("since") < F.col("seq"))
    listed = known.filter("kind = 'list-bookmarks'").join(said.select("session", "stretch", "number", "summary"), [*at, "number"])
    tagged = named.filter((F.col("kind") == "tagged") & (F.col("tag") == F.col("a"))).join(said.select("session", "stretch", "number", "summary"), [*at, "number"])
    ids = ["session", "seq", "kind"]
    whole = cmd.filter(F.col("kind").isin("stats", "export")).select(*ids, "n")
    chars = seen.filter("kind = 'stats'").groupBy(*ids).agg(F.sum(F.length("user") + F.length("assistant")).alias("chars"), F.sum(block_count(F.col("assistant"))).alias("blocks"))
    whole = whole.join(known.groupBy(*ids).agg(F.array_sort(F.collect_list("number")).alias("marks")), ids, "left") \
        .join(named.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("tag", "number"))).alias("tags")), ids, "left").join(chars, ids, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    totals = F.concat_ws("|", count("n"), count("chars"), count("blocks"), count(F.size(F.coalesce("marks", F.array()))),
                         count(F.size(F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<struct<tag:string,number:int>>")), lambda t: t["tag"])))))
    state = F.to_json(F.struct(F.col("n").alias("turns"), F.coalesce("marks", F.array().cast("array<int>")).alias("bookmarks"),
                               F.coalesce("tags", F.array().cast("array<struct<tag:string,number:int>>")).alias("tags")))
    nothing = whole.withColumn("number", F.lit(None))
    done = cmd.filter(F.col("kind").isin("bookmark", "tag", "clear")).withColumn("number", target)
    changed = (target >= 1) & (target <= F.col("n"))
    return reduce(DataFrame.unionByName, [
        out(seen.filter((F.col("kind") == "history") & (F.col("number") > F.col("n") - F.col("a").cast("int"))), F.lit("summary"), F.col("summary")),
        out(found, F.lit("summary"), F.col("summary")), out(shown, F.lit("user"), F.col("user")), out(shown, F.lit("assistant"), F.col("assistant")),
        out(seen.filter((F.col("kind") == "compare") & ((number == F.col("a")) | (number == F.col("b")))), F.lit("lengths"),
            F.concat_ws("|", F.length("user").cast("string"), F.length("assistant").cast("string"))),
        out(code, F.col("i"), F.col("block.code")), out(listed, F.lit("summary"), F.col("summary")), out(tagged, F.lit("summary"), F.col("summary")),
        out(nothing.filter("kind = 'stats'"), F.lit("totals"), totals), out(nothing.filter("kind = 'export'"), F.lit("state"), state),
        out(done, F.lit("changed"), F.when(F.col("kind") == "clear", F.lit("true")).otherwise(changed.cast("string")))])
