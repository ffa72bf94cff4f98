"""The operators' queries over the driver's tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, ctw, langid, licenses, lines, neardup, packing, quality, toxicity, transducer, winnow
from .common import bucket_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.cascade(docs, quality.default_rules(), first=quality.base_rules())
    failed = F.lit(False)
    for r in quality.base_rules():
        failed = failed | r.rejects
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), max_tokens=1024, with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.default_learn)
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, lambda i: bucket_of(i, 5) != 0)
    out = langid.identify_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, threshold=(75, 100))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = winnow.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    a, b, c = (winnow.hashes(F.col(x)) for x in ("prints", "edited_prints", "next_prints"))
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow.as_text(F.col("prints")).alias("fingerprint"), winnow.as_text(F.col("edited_prints")).alias("edited_fingerprint"), winnow.likeness(a, b).alias("near_edited"), winnow.likeness(a, c).alias("near_next"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_sites=6)
    return out.select("doc_id", "n_lines", "n_removed", (~F.col("emptied")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 5) == 1
    model, words = ctw.fit(docs, ~held_out, depth=6)
    out = ctw.score_documents(docs, model, words)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transducer.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_licenses": op4_licenses,
        "op5_language": op5_language,
        "op6_bpe": op6_bpe,
        "op7_neardup": op7_neardup,
        "op8_winnow": op8_winnow,
        "op9_lines": op9_lines,
        "op10_ctw": op10_ctw,
        "op11_centroids": op11_centroids,
        "op12_token_counts": op12_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": quality.ORACLE_SQL,
        "op9_lines": lines.ORACLE_SQL,
        "op11_centroids": centroids.oracle_sql(),
    }
