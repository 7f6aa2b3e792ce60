"""Registry of queries over the given tables and the SQL that must give the same rows."""

from pyspark.sql import functions as F

REGISTRY = {}


def query(name, sql=None):
    def add(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, sql)
        return fn
    return add


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}
#: A caller whose text tables are single row groups, which are one task however many cores there are, may name a number of parts.
text_parts = None


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark, sf_dir, name):
    """A table whose rows are expensive to process, as its files are split, or in ``text_parts`` parts."""
    df = table(spark, sf_dir, name)
    return df if text_parts is None else df.repartition(text_parts, TEXT_TABLES[name])


def corpus(spark, sf_dir):
    """documents as files: path = source/lang/id.txt."""
    from ..sources.files import document_corpus
    return document_corpus(text_table(spark, sf_dir, "documents"))


def page_corpus(spark, sf_dir):
    """pages as files: path = host path of the url, made unique by the page id."""
    p = text_table(spark, sf_dir, "pages")
    return p.select(F.concat(F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit("/"), F.col("page_id").cast("string"),
                             F.lit(".js")).alias("path"),
                    F.col("html").alias("content"), F.lit("javascript").alias("language"), F.col("page_id").alias("ord"))


def symbols(spark, sf_dir):
    """part as symbols: snake-case name, type from p_type, file per brand, line from size and key."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("function", "struct", "variable", "method", "class")]),
                        (F.col("p_size") % 5 + 1).cast("int"))
    file = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".c"))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(F.concat(name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit("@"), file).alias("key"), name.alias("name"),
                    kind.alias("type"), file.alias("file"), (F.col("p_size") * 10 + F.col("p_partkey") % 10).cast("int").alias("line"),
                    F.col("p_partkey").alias("ord"))


def edges(spark, sf_dir):
    """events as call edges: user node -> props node, distinct, no self calls."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("fn_"), F.col("user_id").cast("string")).alias("caller"),
        F.concat(F.lit("fn_"), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("callee"), F.col("event_id").alias("ord"))
    return e.filter("caller <> callee").groupBy("caller", "callee").agg(F.min("ord").alias("ord"))


def turns(spark, sf_dir):
    from ..operators.session import pair_turns
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")
    return pair_turns(c)


def joined(c, sep="|"):
    return F.array_join(c, sep)


# --- SQL fragments --------------------------------------------------------------

DOCS = "SELECT doc_id AS ord, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS language FROM documents"
PAGES = "SELECT page_id AS ord, regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || page_id || '.js' AS path, html AS content FROM pages"
SYMBOLS = """SELECT replace(p_name, ' ', '_') || '_' || p_partkey || '@src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.c' AS key,
 replace(p_name, ' ', '_') AS name, ['function', 'struct', 'variable', 'method', 'class'][p_size % 5 + 1] AS type,
 'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.c' AS file, p_size * 10 + p_partkey % 10 AS line, p_partkey AS ord FROM part"""
EDGES = """SELECT caller, callee, min(event_id) AS ord FROM (SELECT 'fn_' || user_id AS caller, 'fn_' || regexp_extract(props, '"k": *([0-9]+)', 1) AS callee, event_id FROM events)
 WHERE caller <> callee GROUP BY 1, 2"""
TURNS = """SELECT session, seq, text AS user, assistant FROM (SELECT conv_id AS session, turn AS seq, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS assistant
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
LINES = f"SELECT ord, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM ({DOCS})"


def index_tokens(col):
    return f"list_filter(regexp_extract_all(lower(regexp_replace({col}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 50)"


def vector_tokens(col):
    return f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9_]+'), lambda w: length(w) BETWEEN 3 AND 29)"


def learner_tokens(col):
    return ("list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(" + col + ", '([a-z])([A-Z])', '\\1 \\2', 'g'), "
            "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 40)")


def stem(w):
    return f"""CASE WHEN length({w}) < 4 THEN {w}
 WHEN {w} LIKE '%ing' AND length({w}) > 4 AND length({w}) - 3 > 2 AND substring({w}, length({w}) - 3, 1) = substring({w}, length({w}) - 4, 1) THEN left({w}, length({w}) - 4)
 WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN left({w}, length({w}) - 3)
 WHEN {w} LIKE '%ied' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
 WHEN {w} LIKE '%ed' AND length({w}) > 4 AND length({w}) - 2 > 2 AND substring({w}, length({w}) - 2, 1) = substring({w}, length({w}) - 3, 1) THEN left({w}, length({w}) - 3)
 WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2)
 WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
 WHEN length({w}) > 4 AND regexp_matches({w}, '([xsz]|[sc]h)es$') THEN left({w}, length({w}) - 2)
 WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"""


def grams(s, n=3):
    return f"list_transform(range(1, length({s}) - {n - 2}), lambda i: substring({s}, i, {n}))"


def sql_in(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


TF = f"""SELECT ord, path, term, count(*) AS tf FROM (SELECT ord, path, {stem('w')} AS term FROM (SELECT ord, path, unnest({index_tokens('content')}) AS w FROM ({DOCS}))
 WHERE w NOT IN {sql_in(tuple('abcdefghijklmnopqrstuvwxyz') + ('the', 'an'))}) WHERE length(term) >= 2 GROUP BY 1, 2, 3"""
