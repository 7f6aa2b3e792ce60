"""One query per operator over the whole given tables, and the SQL that must give the same rows where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, digest, fim, jaccard, license, oracles, phrases, pii, quality, shared, tokencount, vantage, warc
from .shared import table


def op1_byte_level_bpe(spark, sf_dir, vocabulary_path=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, packed=True).drop("text")
    whole = bpe.decode(ids, ranks)
    return whole.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_license_scan(spark, sf_dir):
    found = license.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_token_counts(spark, sf_dir, vocabulary_path=None):
    docs = table(spark, sf_dir, "documents")
    ranks = bpe.read_ranks(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # a space joins the fields, so a field's first token takes it in and crosses the border; it counts where it ends
    found = tokencount.count(docs, ranks, public_tokenizers.PATTERN, ("source", "lang", "text"), separator=" ", rule="end")
    tokens = [F.get("fields", F.lit(i))["tokens"].cast("long").alias(f"{n}_tokens") for i, n in enumerate(("source", "lang", "text", "layout"))]
    return found.select("doc_id", "n_tokens", *tokens, "n_crossing")


def held_out(of, folds, fold):
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op6_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_document_fingerprints(spark, sf_dir):
    return digest.edited_and_next(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = shared.new_folder(spark, "warc")
    warc.write(pages, folder)
    records = warc.read(spark, folder).filter("record_id is not null")
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("record_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").try_cast(kind).alias("refers_to"))


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_lm_scoring(spark, sf_dir):
    scored = ctw.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vantage.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op12_fill_in_middle(spark, sf_dir):
    made = fim.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_phrase_collocations(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_byte_level_bpe, op2_license_scan, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_token_counts, op6_quality_classifier, op7_document_fingerprints,
    op8_warc, op9_pii, op10_lm_scoring,
    op11_nearest_neighbours, op12_fill_in_middle, op13_phrase_collocations)}

#: The others cannot be said in SQL (merges, trained models, digests of counts); tests hold them against brute force.
SQL = {"op3_ngram_jaccard_join": oracles.JACCARD, "op4_benchmark_decontamination": oracles.DECONTAMINATION, "op8_warc": oracles.WARC,
       "op12_fill_in_middle": oracles.FILL_IN_MIDDLE, "op13_phrase_collocations": oracles.COLLOCATIONS}
