"""Tokenizers, n-grams, stems, variants and string scores as Column expressions.

Everything here stays in the JVM.  Three tokenizers exist because answers depend
on which one is used: index terms (stemmed), vector terms and learner terms.
"""

from pyspark.sql import Column, functions as F

from . import fixed
from .matching import ascii_edges

# White space as a query string sees it (ASCII plus the Unicode spaces).
SPACE = r"[\s ﻿  -     　]"
TRIM = rf"^{SPACE}+|{SPACE}+$"


def evaluate(spark, expr):
    """Value of a constant expression, used to turn one query string into its terms."""
    return spark.range(1).select(expr.alias("v")).first()["v"]


def trim(s):
    return F.regexp_replace(s, TRIM, "")


def ascii_lower(s):
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty_strings():
    return F.array().cast("array<string>")


def words_of(s, separator=rf"{SPACE}+"):
    return F.split(s, separator)


def kept(words, at_least, stop=()):
    return F.filter(words, lambda w: (F.length(w) >= at_least) & (~w.isin(*stop) if stop else F.lit(True)))


# --- tokenizers -------------------------------------------------------------

def split_camel(s):
    return F.regexp_replace(s, "([A-Z])(?<=[a-z][A-Z])", " $1")  # capitals are few, so they are looked for first


def _lower_runs(s):
    """``s`` whose runs of ASCII letters and digits are those of ``ascii_lower``, by the JVM's much faster lower.

    Of all letters beyond ASCII, only the Kelvin sign and the dotted capital I have an ASCII letter in their lower case.
    """
    for letter in "\u212a\u0130":
        s = F.replace(s, F.lit(letter), F.lit("\u00e9"))
    return F.lower(s)


def _runs(s, letters, at_least, most):
    """Whole runs of ``letters``, ``at_least`` to ``most`` long; possessive, so that each is looked at once."""
    return F.filter(F.regexp_extract_all(s, F.lit(f"[{letters}]{{{at_least},}}+"), F.lit(0)), lambda w: F.length(w) <= most)


def counted(words: Column) -> Column:
    """The distinct words of an array, ascending, each repeated as often as it stands there, as one string (words hold no blank).

    Equal words are neighbours in the sorted line, so one match is all of them.  ``counted_lists`` reads them back.
    """
    return F.regexp_extract_all(F.array_join(F.sort_array(words), " "), F.lit(r"([^ ]++)(?: \1(?![^ ]))*+"), F.lit(0))


def counted_lists(df, keys, words: Column, name):
    """(keys, terms, ``name``): the distinct words of each row, ascending, and their numbers, counted inside the row."""
    runs = df.select(*keys, counted(words).alias("runs"))
    terms = runs.select(*keys, F.transform("runs", lambda r: F.substring_index(r, " ", 1)).alias("terms"), "runs")
    return terms.select(*keys, "terms", F.zip_with("runs", "terms", lambda r, t: F.floor((F.length(r) + 1) / (F.length(t) + 1))).alias(name))


def index_tokens(text: Column, stems=None, prefix=None) -> Column:
    """Unstemmed index words: camel and snake parts, 2..50 characters.

    With ``stems``, only words that can have one of them: ``stem`` keeps all of a stem but its last letter and takes at most four letters more off.
    With ``prefix``, only words whose stem can begin with it.
    """
    if stems is None and not (prefix and len(prefix) > 1):
        return _runs(_lower_runs(split_camel(text)), "a-z0-9", 2, 50)
    if stems is None:
        usable = len(prefix) <= 50 and prefix.isascii() and prefix.isalnum() and prefix == prefix.lower()
        run = f"{prefix[:-1]}[a-z0-9]{{1,{51 - len(prefix)}}}" if usable else "(?!)"
    else:
        heads = sorted({t[:-1] for t in stems if 2 <= len(t) <= 50 and t[:-1].isascii() and t[:-1].isalnum() and t[:-1] == t[:-1].lower()})
        run = "(?:" + "|".join(f"{h}[a-z0-9]{{1,{min(5, 50 - len(h))}}}" for h in heads) + ")" if heads else "(?!)"
    return F.regexp_extract_all(_lower_runs(split_camel(text)), F.lit(f"(?<![a-z0-9]){run}(?![a-z0-9])"), F.lit(0))


def keeps_index_token(word):
    return ~word.isin(*fixed.BOOTSTRAP_STOP_WORDS)


def stem(w: Column) -> Column:
    """Suffix stemmer; plain CASE logic so that it is compiled with the scan."""
    n = F.length(w)

    def cut(k):
        return F.substr(w, F.lit(1), n - k)

    def doubled(k):
        return (n - k > 2) & (F.substr(w, n - k, F.lit(1)) == F.substr(w, n - k - 1, F.lit(1)))

    ing = F.endswith(w, F.lit("ing")) & (n > 4)
    ed = F.endswith(w, F.lit("ed")) & (n > 4)
    ies = F.endswith(w, F.lit("ies")) & (n > 4)
    return (F.when((n < 4) | ~F.right(w, F.lit(1)).isin("g", "d", "s"), w)  # most words end otherwise
            .when(ing & doubled(3), cut(4))
            .when(ing & (n >= 6), cut(3))
            .when(ed & F.endswith(w, F.lit("ied")), F.concat(cut(3), F.lit("y")))
            .when(ed & doubled(2), cut(3))
            .when(ed, cut(2))
            .when(ies, F.concat(cut(3), F.lit("y")))
            .when((n > 4) & w.rlike("([xsz]|[sc]h)es$"), cut(2))
            .when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & (n > 3), cut(1))
            .otherwise(w))


def vector_tokens(text):
    return _runs(F.lower(text), "a-z0-9_", 3, 29)


def learner_tokens(text, prefix=None):
    """Learner words of 2..40 characters; those that begin with a prefix, if one is given."""
    s = F.regexp_replace(text, "([A-Z])(?:(?<=[a-z][A-Z])|(?<=[A-Z]{2})(?=[a-z]))", " $1")  # before a part's capital
    if not prefix:
        return _runs(_lower_runs(s), "a-z0-9", 2, 40)
    usable = len(prefix) <= 40 and prefix.isascii() and prefix.isalnum() and prefix == prefix.lower()
    run = f"{prefix}[a-z0-9]{{{max(0, 2 - len(prefix))},{40 - len(prefix)}}}" if usable else "(?!)"
    return F.regexp_extract_all(
        _lower_runs(s), F.lit(f"(?<![a-z0-9]){run}(?![a-z0-9])"), F.lit(0))


def keywords_upper(content):
    """Upper-cased identifier-like words, common programming words dropped."""
    word = r"[\p{L}\p{N}_]"
    edge = rf"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"  # letters of any script bound a word here
    found = F.regexp_extract_all(
        content, F.lit(f"{edge}[A-Z][A-Z0-9_-]{{2,}}{edge}|{edge}[a-z][a-zA-Z0-9_]{{3,}}{edge}"), F.lit(0))
    return F.filter(F.transform(found, F.upper), lambda w: ~w.isin(*fixed.COMMON_KEYWORDS))


# --- n-grams and hashes -----------------------------------------------------

def alnum_only(text):
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def alnum_trigrams(text):
    """Overlapping trigrams after separators are removed, found in one regex pass."""
    return F.regexp_extract_all(alnum_only(text), F.lit("(?=(...))"), F.lit(1))


def raw_trigrams(text, case_sensitive=False):
    s = text if case_sensitive else F.lower(text)
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?=((?!{SPACE}{{3}})...))"), F.lit(1))


def positioned_trigrams(text):
    """One entry per start offset, white-space-only ones included, so that index = offset."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))


def trigram_similarity(a, b):
    ta, tb = F.array_distinct(alnum_trigrams(a)), F.array_distinct(alnum_trigrams(b))
    both = F.size(F.array_union(ta, tb))
    return F.when((F.length(a) < 3) | (F.length(b) < 3) | (F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)) \
        .otherwise(F.size(F.array_intersect(ta, tb)) / both)


def djb2(s):
    """32-bit wrapping string hash (h * 33 + code unit, from 5381)."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    wrap = F.lit(0xFFFFFFFF)
    half = F.lit(0x80000000)
    return F.aggregate(
        chars, F.lit(5381).cast("bigint"),
        lambda h, c: (h * 33 + F.ascii(c) + half).bitwiseAND(wrap) - half).cast("int")


def hash_bucket(s, dimensions):
    return F.abs(djb2(s).cast("bigint")) % dimensions


# --- string scores ----------------------------------------------------------

def camel_initials(target):
    return F.array_join(F.regexp_extract_all(target, F.lit("([A-Z])"), F.lit(1)), "")


def matches_initials(query, target):
    initials, q = camel_initials(target), F.upper(query)
    return (initials == q) | (F.startswith(initials, q) & (F.length(q) >= 2))


def is_subsequence(query, target):
    """Characters of query appear in target in order: a fold of search positions."""
    q, t = F.lower(query), F.lower(target)
    chars = F.filter(F.split(q, ""), lambda c: c != "")
    end = F.aggregate(
        chars, F.lit(1),
        lambda pos, c: F.when(pos == 0, F.lit(0)).otherwise(
            F.when(F.call_function("locate", c, t, pos) == 0, F.lit(0))
            .otherwise(F.call_function("locate", c, t, pos) + 1)))
    return end > 0


def fuzzy_score(query, target):
    """100 equal, 95/90/85 contained, 80 initials, 60+ subsequence, else edit similarity."""
    q, t = F.lower(query), F.lower(target)
    at = F.call_function("locate", q, t)
    before = F.substr(t, at - 1, F.lit(1))
    similarity = 1 - F.levenshtein(q, t) / F.greatest(F.length(q), F.length(t))
    return (F.when(t == q, F.lit(100.0))
            .when(F.startswith(t, q), F.lit(95.0))
            .when((at > 0) & before.rlike("[^a-z0-9]"), F.lit(90.0))
            .when(at > 0, F.lit(85.0))
            .when(matches_initials(query, target), F.lit(80.0))
            .when(is_subsequence(query, target), 60 + F.length(query) / F.length(target) * 20)
            .when(similarity > 0.5, similarity * 50)
            .otherwise(F.lit(0.0)))


def name_score(pattern, text):
    """Score of a lower-cased symbol name against a lower-cased pattern, first rule wins."""
    words = F.split(text, r"[_\s]+")
    first_word = F.element_at(F.filter(words, lambda w: F.startswith(w, pattern)), 1)
    return (F.when(text == pattern, F.lit(100)).when(F.startswith(text, pattern), F.lit(90))
            .when(F.contains(text, pattern), F.lit(70))
            .when(F.exists(words, lambda w: F.startswith(w, pattern)),
                  F.when(first_word == pattern, F.lit(85)).otherwise(F.lit(75)))
            .otherwise(F.lit(0)))


# --- singular forms ---------------------------------------------------------

def _singular(w, ies_min, otherwise):
    n = F.length(w)
    return (F.when(F.endswith(w, F.lit("ies")) & (n > ies_min), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y")))
            .when(F.endswith(w, F.lit("es")) & (n > 4), F.substr(w, F.lit(1), n - 2))
            .when(F.endswith(w, F.lit("s")) & (n > 3), F.substr(w, F.lit(1), n - 1))
            .otherwise(otherwise))


def singular(w):
    return _singular(w, 4, w)


def concept_singular(w):
    return _singular(w, 0, w)


# --- query term extraction ----------------------------------------------------

def identifiers(q):
    return F.regexp_extract_all(q, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))


def search_terms(q):
    """Identifiers and words, then singular forms, then snake parts; first occurrence kept."""
    words = F.filter(
        F.transform(F.split(F.lower(q), rf"(?:{SPACE}|[,;:])+"), lambda w: F.regexp_replace(w, "[^a-z0-9_]", "")),
        lambda w: F.length(w) >= 2)
    base = F.array_distinct(F.concat(F.transform(identifiers(q), F.lower), words))
    singles = F.filter(F.transform(base, lambda w: _singular(w, 4, F.lit(None).cast("string"))),
                       lambda w: F.length(w) >= 3)
    both = F.array_distinct(F.concat(base, singles))
    parts = F.flatten(F.transform(
        F.filter(both, lambda w: F.contains(w, F.lit("_"))),
        lambda w: F.filter(F.split(w, "_"), lambda p: F.length(p) >= 2)))
    return F.filter(F.array_distinct(F.concat(both, parts)), lambda w: F.length(w) >= 2)


def without_stop_words(terms):
    """Stop words leave the query unless nothing else is in it."""
    clean = F.filter(terms, lambda t: ~t.isin(*fixed.UNIVERSAL_STOP_WORDS))
    return F.when(F.size(clean) > 0, clean).otherwise(terms)


def action_stems(q):
    """Base forms of the action verbs a question mentions, in pattern order."""
    found = F.array(*[F.regexp_extract(F.lower(q), ascii_edges(p), 1) for p in fixed.ACTION_PATTERNS])

    def base(v):
        short = F.regexp_replace(v, "(ed|ing|ion|e)$", "")
        return F.when(F.length(short) < 3, F.regexp_replace(v, "(ed|ing)$", "")).otherwise(short)

    return F.filter(F.transform(found, base), lambda v: F.length(v) >= 3)


def compound_terms(q, terms):
    """term_action and action_term for every term and action verb."""
    def pairs(t, actions):
        s = concept_singular(t)
        return F.flatten(F.transform(
            F.filter(actions, lambda a: (a != t) & (a != s)),
            lambda a: F.array(F.concat_ws("_", s, a), F.concat_ws("_", a, s))))

    long = F.filter(terms, lambda t: F.length(t) >= 3)
    found = F.transform(F.array(action_stems(q)), lambda actions: F.flatten(F.transform(long, lambda t: pairs(t, actions))))  # a question's actions are found once
    return F.array_distinct(F.flatten(found))


def capital(w):
    return F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))


def _join_tail(words, f):
    return F.array_join(F.transform(words, f), "")


def naming_variants(term):
    """Joined, snake, UPPER_SNAKE, camel and Pascal spellings of a term."""
    t = trim(term)
    words = F.filter(F.split(t, rf"(?:{SPACE}|[_-])+"), lambda w: F.length(w) > 0)
    lower_cap = lambda w: capital(F.lower(w))
    camel = F.concat(F.lower(F.get(words, F.lit(0))),
                     _join_tail(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lower_cap))
    forms = F.array(
        t, F.lower(t), F.lower(F.array_join(words, "")), F.lower(F.array_join(words, "_")),
        F.upper(F.array_join(words, "_")),
        F.when(F.size(words) > 1, camel), _join_tail(words, lower_cap))
    return F.array_distinct(F.filter(
        F.when(F.size(words) >= 1, forms).otherwise(F.array(t, F.lower(t))), lambda v: v.isNotNull()))


def topic_variants(topic):
    """Seven spellings of a topic, kebab included; the topic itself comes first."""
    words = F.split(F.lower(topic), rf"{SPACE}+")
    camel = F.concat(F.get(words, F.lit(0)),
                     _join_tail(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), capital))
    forms = F.array(
        topic, F.array_join(words, "_"), F.when(F.size(words) > 1, camel), _join_tail(words, capital),
        F.upper(F.array_join(words, "_")), F.array_join(words, "-"), F.array_join(words, ""))
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull()))


def scope_terms(q):
    """Quoted phrases whole, other words without stop words, each with its singular."""
    phrases = F.filter(F.transform(F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)),
                                   lambda p: trim(F.lower(p))), lambda p: F.length(p) >= 2)
    rest = F.regexp_replace(q, '"[^"]+"', " ")
    words = kept(F.split(F.regexp_replace(F.lower(rest), "[^a-z0-9_]", " "), " +"), 2, fixed.SCOPE_STOP_WORDS)
    return F.array_distinct(F.flatten(F.transform(
        F.concat(phrases, words),
        lambda t: F.when(F.contains(t, F.lit(" ")), F.array(t)).otherwise(F.array(t, singular(t))))))


def search_keywords(q):
    words = kept(F.split(F.regexp_replace(F.lower(q), "[^a-z0-9_-]", " "), " +"), 3, fixed.KEYWORD_STOP_WORDS)
    ids = F.filter(F.transform(identifiers(q), F.lower),
                   lambda w: (F.length(w) > 3) & ~w.isin(*fixed.KEYWORD_STOP_WORDS))
    return F.array_distinct(F.concat(words, ids))


def fallback_keywords(q):
    words = kept(F.split(F.regexp_replace(F.lower(q), r"[^\w-]", " "), " +"), 3, fixed.FALLBACK_STOP_WORDS)
    ids = F.regexp_extract_all(
        q, F.lit("[a-zA-Z_][a-zA-Z0-9_]*(?:_[a-zA-Z0-9_]+)+|[a-zA-Z][a-z]*(?:[A-Z][a-z]*)*"), F.lit(0))
    return F.array_distinct(F.concat(words, F.transform(ids, F.lower)))


def context_terms(q):
    words = kept(F.split(F.regexp_replace(F.lower(q), "[^a-z0-9_]", " "), " +"), 2, fixed.CONTEXT_STOP_WORDS)
    return F.transform(words, lambda w: F.replace(w, F.lit("_"), F.lit("")))


def workspace_terms(q):
    """4+5 letter compounds and snake pairs of neighbours, the words, then their roots."""
    words = F.transform(F.filter(F.split(F.lower(q), rf"{SPACE}+"), lambda w: F.length(w) >= 3),
                        lambda w: F.regexp_replace(w, "[^a-z0-9_]", ""))
    n = F.size(words)
    pairs = F.when(n > 1, F.flatten(F.zip_with(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.array(F.concat(F.left(a, F.lit(4)), F.left(b, F.lit(5))), F.concat_ws("_", a, b))))) \
        .otherwise(empty_strings())
    roots = F.filter(F.transform(words, lambda w: F.regexp_replace(
        F.regexp_replace(w, "(ing|tion|tions|ness|ment|s)$", ""), "e$", "")), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.concat(pairs, words, roots))


def instruction_terms(text):
    """Words named by 'from X', 'like X', 'X handling', ... in an instruction."""
    first = F.regexp_extract_all(text, F.lit(
        r"(?i)(?:from|like|based on|learn from|patterns? from|handling from)\s+(\w+)"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(
        r"(?i)(\w+)\s+(?:patterns?|validation|handling|logic|style)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(first, second), F.lower),
                                     lambda w: ~w.isin(*fixed.INSTRUCTION_SKIP_WORDS)))


def first_keywords(topic, most):
    return F.slice(F.filter(F.split(topic, rf"{SPACE}+"), lambda w: F.length(w) > 2), 1, most)


# --- names and summaries ------------------------------------------------------

def summary_from_name(name):
    return capital(F.lower(F.replace(split_camel(name), F.lit("_"), F.lit(" "))))


def verb_summary(name):
    """'Gets user name' for verb-first names, otherwise every word capitalised."""
    s = F.regexp_replace(split_camel(name), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.translate(s, "_-", "  ")), rf"{SPACE}+"), lambda w: F.length(w) > 0)
    head = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
    return (F.when(F.length(F.coalesce(name, F.lit(""))) == 0, F.lit("Unknown function"))
            .when(F.size(words) == 0, F.concat(F.lit("Function "), name))
            .when(head.isin(*fixed.SUMMARY_VERBS), F.concat(capital(head), F.lit("s "), rest))
            .otherwise(F.array_join(F.transform(words, capital), " ")))


def is_garbage_symbol(name):
    return (F.length(F.coalesce(name, F.lit(""))) < 2) | F.lower(name).isin(*fixed.GARBAGE_WORDS) \
        | name.rlike(r"^\d+$")


def escape_regex(s):
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def node_id(name):
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


# --- text shaping -------------------------------------------------------------

def clean_text(text):
    """Squeeze blank lines, join hyphenated words, break paragraphs after sentences."""
    t = F.regexp_replace(text, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?<=[a-z])-\n(?=[a-z])", "")
    t = F.regexp_replace(t, r"(?<=[.!?])\n(?=[A-Z])", "\n\n")
    return trim(t)


def text_lines(text):
    return F.split(text, "\n", -1)


def line_count(text):
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def first_lines(text, n):
    return F.array_join(F.slice(text_lines(text), 1, n), "\n")


def comment_texts(content, lang):
    """Comment bodies by language family; unknown languages read as // and /* */."""
    def found(*patterns):
        return F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])

    def marked(mark, pattern):
        return F.when(F.contains(content, F.lit(mark)), F.regexp_extract_all(content, F.lit(pattern), F.lit(1))).otherwise(empty_strings())

    slash = (r"(?m)//(.+)$", r"(/\*[\s\S]*?\*/)")
    return (F.when(lang == "python", found(r"(?m)#(.+)$", r"('''[\s\S]*?''')", r'("""[\s\S]*?""")'))
            .when(lang == "sql", found(r"(?m)--(.+)$", slash[1]))
            .when(lang == "cobol", F.transform(F.regexp_extract_all(content, F.lit(r"(?m)(^.{6}\*.*$)"), F.lit(1)),
                                               lambda m: F.when(F.length(m) > 7, F.substr(m, F.lit(8))).otherwise(m)))
            .when(lang == "tal", found(r"(?m)--(.+)$", r"(?m)!(.+)$"))
            .otherwise(F.concat(marked("//", slash[0]), marked("/*", slash[1]))))


# Possessive loops: same matches, no recursion on long literals.
STRING_PATTERNS = (r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^'\\]++|\\.)*+'", r"`(?:[^`\\]++|\\.)*+`")


def string_literals(content, shortest=None, longest=None):
    """Contents of string literals; a caller may set bounds of length."""
    parts = F.concat(*[F.when(F.contains(content, F.lit(p[0])), F.regexp_extract_all(content, F.lit(f"({p})"), F.lit(1))).otherwise(empty_strings())
                       for p in STRING_PATTERNS])
    inner = F.transform(parts, lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    if shortest is not None:
        inner = F.filter(inner, lambda s: F.length(s) >= shortest)
    return inner if longest is None else F.filter(inner, lambda s: F.length(s) <= longest)


def strip_code(content, lang):
    """Content without comments, string literals reduced to empty quotes."""
    def drop(s, *patterns):
        for p in patterns:
            s = F.regexp_replace(s, p, " ")
        return s

    block = r"/\*[\s\S]*?\*/"
    s = (F.when(lang == "python", drop(content, r"(?m)#.+$", r"'''[\s\S]*?'''", r'"""[\s\S]*?"""'))
         .when(lang == "sql", drop(content, r"(?m)--.+$", block))
         .when(lang == "cobol", drop(content, r"(?m)^.{6}\*.*$"))
         .when(lang == "tal", drop(content, r"(?m)--.+$", r"(?m)!.+$"))
         .otherwise(drop(content, r"(?m)//.+$", block)))
    for p, quotes in zip(STRING_PATTERNS, ('""', "''", "``")):
        s = F.regexp_replace(s, p, quotes)
    return s


def split_at_lines(lines, most):
    """Greedy packing of lines into pieces under a size: a bounded fold per text."""
    state = F.struct(empty_strings().alias("done"), F.lit("").alias("cur"))

    def step(s, line):
        full = (F.length(s["cur"]) + F.length(line) > most) & (F.length(s["cur"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(s["cur"]), line, F.lit("\n")).alias("cur"))

    return F.aggregate(lines, state, step, lambda s: F.when(
        F.length(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def fenced_blocks(text):
    """Fenced code blocks as (language, code, start, end) with character offsets."""
    pat = r"```(\w*)\n([\s\S]*?)```"
    gaps = F.split(text, pat, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({pat})"), F.lit(1))
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole,
                        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(pieces, zero, lambda s, p: F.struct(
        (s["end"] + p["gap"] + p["len"]).alias("end"),
        F.concat(s["spans"], F.array(F.struct((s["end"] + p["gap"]).alias("start"),
                                              (s["end"] + p["gap"] + p["len"]).alias("end")))).alias("spans")),
        lambda s: s["spans"])
    heads = F.zip_with(F.regexp_extract_all(text, F.lit(pat), F.lit(1)),
                       F.regexp_extract_all(text, F.lit(pat), F.lit(2)),
                       lambda lang, code: F.struct(
                           F.coalesce(F.nullif(lang, F.lit("")), F.lit("text")).alias("language"),
                           trim(code).alias("code")))
    return F.zip_with(heads, spans, lambda h, s: F.struct(
        h["language"].alias("language"), h["code"].alias("code"), s["start"].alias("start"), s["end"].alias("end")))
