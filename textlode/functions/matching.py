"""Regex matches with positions, computed without leaving the JVM.

``split`` gives the gaps between matches and ``regexp_extract_all`` the matches;
running lengths over (gap, match) pairs give offset, line and column.  The text
itself is consumed before the shuffle: only lengths and captured groups move.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_edges(pattern: str) -> str:
    r"""Spell \b out over ASCII word characters; what the JVM takes for a letter depends on its version."""
    return pattern.replace(r"\b", WORD_EDGE)


@dataclass(frozen=True)
class Rule:
    """One pattern; ``groups`` are the capture numbers kept as g1, g2, g3; ``zero_width`` for patterns that may match nothing."""
    pattern: str
    groups: tuple = (1,)
    zero_width: bool = False

    def __post_init__(self):
        object.__setattr__(self, "pattern", ascii_edges(self.pattern))


def _newlines(s):
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def _tail(s):
    """Characters after the last newline."""
    return F.length(F.substring_index(s, "\n", -1))


def _braces(s):
    return F.length(F.regexp_replace(s, "[^{]", "")) - F.length(F.regexp_replace(s, "[^}]", ""))


def _entries(content: Column, rule: Rule) -> Column:
    """Matches of one rule as an array of (gap, m, g1, g2, g3); the tail gap has no match."""
    whole = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    groups = [F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(g)) for g in rule.groups]
    groups += [F.array().cast("array<string>")] * (3 - len(groups))  # zipped as nulls
    gaps = F.split(content, rule.pattern, -1)
    if rule.zero_width:  # split leaves out the empty gap before a match of no width at the start
        gaps = F.when(F.size(gaps) <= F.size(whole), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
    return F.arrays_zip(gaps.alias("gap"), whole.alias("m"),
                        *[g.alias(f"g{k + 1}") for k, g in enumerate(groups)])


def _locate(by_rule: Column, df: DataFrame, keys, base, brace_rules=()) -> DataFrame:
    """Turn matches into pos (0-based), line and column (1-based), and brace depth.

    Gaps become lengths right behind the explode, in compiled code; the one shuffle by
    file moves those numbers and the captured text only.
    """
    def braces(s):
        return F.when(F.col("rule").isin(*brace_rules), _braces(s)).otherwise(0) if brace_rules else F.lit(0)

    flat = df.withColumn("__base", base).select(*keys, "__base", F.posexplode(by_rule).alias("r", "found")) \
        .select(*keys, (F.col("__base") + F.col("r")).alias("rule"), F.posexplode("found").alias("i", "e")) \
        .filter("e.m is not null") \
        .select(*keys, "i", "rule", F.col("e.m").alias("match_text"), "e.g1", "e.g2", "e.g3", F.col("e.gap").alias("gap"))
    gap, m = F.col("gap"), F.col("match_text")
    flat = flat.select(*keys, "i", "rule", "match_text", "g1", "g2", "g3", F.length(gap).alias("gap_len"),
                       _newlines(gap).alias("gap_nl"), _tail(gap).alias("gap_tail"), _newlines(m).alias("m_nl"),
                       _tail(m).alias("m_tail"), braces(gap).alias("gap_br"), braces(m).alias("m_br"))
    w = Window.partitionBy(*keys, "rule").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    m_len = F.length("match_text")

    def running(here, earlier):
        return F.sum(here).over(upto) + F.coalesce(F.sum(earlier).over(before), F.lit(0))

    df = flat.withColumns({
        "match_no": F.row_number().over(w) - 1,
        "pos": running("gap_len", m_len), "line": (running("gap_nl", "m_nl") + 1).cast("int"),
        "depth": running("gap_br", "m_br")})
    # offset just behind the last newline seen so far
    start_in_gap = F.when(F.col("gap_nl") > 0, F.col("pos") - F.col("gap_tail"))
    start_in_match = F.when(F.col("m_nl") > 0, F.col("pos") + m_len - F.col("m_tail"))
    df = df.withColumn("line_start", F.greatest(
        F.max(start_in_gap).over(upto), F.max(start_in_match).over(before), F.lit(0)))
    return df.withColumn("column", (F.col("pos") - F.col("line_start") + 1).cast("int")) \
        .select(*keys, "rule", "match_no", "pos", "line", "column", "depth",
                "match_text", "g1", "g2", "g3")


def match_rows(df: DataFrame, keys, content: str, rules) -> DataFrame:
    """Every match of every rule, one row each, ordered inside a file by (rule, match_no)."""
    text = F.col(content)
    return _locate(F.array(*[_entries(text, r) for r in rules]), df, keys, F.lit(0))


def match_rows_by(df: DataFrame, keys, content: str, selector: str, rule_sets, brace_rules=()) -> DataFrame:
    """Like match_rows, the rule set chosen per row by a column: one scan for all rule sets.

    ``rule_sets``: (first rule number, selector values, rules); the set without values is the default.
    """
    text = F.col(content)
    found = base = None
    for first, values, rules in sorted(rule_sets, key=lambda x: not x[1]):
        e, n = F.array(*[_entries(text, r) for r in rules]), F.lit(first)
        if values:
            cond = F.col(selector).isin(*values)
            found = F.when(cond, e) if found is None else found.when(cond, e)
            base = F.when(cond, n) if base is None else base.when(cond, n)
        else:
            found, base = found.otherwise(e), base.otherwise(n)
    return _locate(found, df, keys, base, brace_rules)
