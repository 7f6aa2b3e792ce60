"""Plug point for an external text model.

``complete`` is any picklable callable text -> text.  Without one, a deterministic
stand-in cuts the prompt, so plans run and repeat offline.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def stand_in(limit=1500):
    return lambda prompt: prompt if len(prompt) <= limit else prompt[:limit - 50] + "\n\n[Additional context truncated]"


def with_completion(rows: DataFrame, prompt: str, out="answer", complete=None) -> DataFrame:
    """Add the model's answer to each row; calls run inside Spark tasks, batch by batch."""
    call = complete or stand_in()

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        def one(p):
            try:
                return None if p is None else call(p)
            except Exception:
                return None
        return s.map(one)

    return rows.withColumn(out, ask(F.col(prompt)))


def with_fallback(*providers):
    """First provider that answers; the next one is tried on an error or an empty answer."""
    def call(prompt):
        for p in providers:
            try:
                answer = p(prompt)
            except Exception:
                continue
            if answer:
                return answer
        return None
    return call


def rerank(files: DataFrame, picked_numbers, most=50) -> DataFrame:
    """Order a numbered, bounded file list by a model's answer: score 100 for the first, one less each."""
    seen = list(dict.fromkeys(n for n in picked_numbers if n > 0))[:most]
    if not seen:
        return files
    place = F.array_position(F.array(*[F.lit(n) for n in seen]), F.col("file_no"))
    return files.withColumn("__p", place).filter("__p > 0").withColumn("score", 101 - F.col("__p")) \
        .withColumn("source", F.concat("source", F.lit("+model"))).drop("__p")


def summaries(chunks: DataFrame, query: str, complete=None, most_chunks=8) -> DataFrame:
    """Summaries of a search's leading chunks; short answers are dropped."""
    lead = chunks.orderBy(F.desc("file_score"), "file", "part").limit(most_chunks)
    asked = lead.withColumn("prompt", F.concat(F.lit(f"Query: {query}\n\n"), "chunk"))
    return with_completion(asked, "prompt", "summary", complete).filter(F.length(F.trim("summary")) > 50)
