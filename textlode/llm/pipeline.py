"""Stages of the training-data pipeline: quality, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with the columns of ``documents``; the last returns the token ids.  Stages
filter and rewrite rows where they stand; only the near-duplicate stage shuffles, and not the texts unless very many ids are dropped.

Defined cases: a null or empty text passes every stage that has no reason against it, and has no tokens; rows without an id are never dropped as
duplicates; rows that share an id are judged by their own texts (of those that links join, one stays); an empty table gives an empty table; extra columns pass through until
the last stage.
"""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, pii, quality, shared
from .queries import held_out

#: Most dropped ids that are sent to all executors; more are joined by shuffle.
BROADCAST = 500_000


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier does not reject (score at least 0.3)."""
    labels = shared.table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality.keep(docs, quality.train(docs, labels), least=0.3)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group that links of similarity reach, the document of smallest id."""
    found = shared.cut(jaccard.row_components(docs).filter("id is not null"))
    again = shared.cut(found.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"))
    once = found.join(again, "id", "left_anti")
    dropped = once.filter("id <> component_id").select(F.col("id").alias("doc_id"))
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST else dropped
    kept = docs.join(dropped, "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    # an id on several rows says nothing about one of them: their sets do
    several = again.withColumnRenamed("id", "doc_id")
    own = jaccard.with_digests(kept.join(several, "doc_id", "left_semi"), "text")
    sets = found.join(again, "id", "left_semi").select(F.col("id").alias("doc_id"), F.col("c").alias("set_digest"), "label", (F.col("n") == 0).alias("bare"),
                                                       (F.col("id") == F.col("component_id")).alias("first")).distinct()
    own = own.join(sets.filter("first or bare"), ["doc_id", "set_digest"])
    bare, full = own.filter("bare"), own.filter("not bare").dropDuplicates(["doc_id", "label"])
    return kept.join(several, "doc_id", "left_anti").unionByName(full.select(docs.columns)).unionByName(bare.select(docs.columns))


def decontamination_stage(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def pii_stage(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    out = pii.redacted(docs, pii.train(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def bpe_stage(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids, decoded_sha256) of every document."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    whole = bpe.decode(ids, ranks)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage),
          ("bpe", bpe_stage)]

#: The classifier is trained, so SQL cannot say the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage returns is written to the shared folder and read back as the next one's documents."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
