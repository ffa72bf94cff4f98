"""The corpus pipeline: toxicity, language, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir); docs is what its predecessor kept, read
again from Parquet. All stages but the last return the columns of documents,
and any further ones that docs has, whatever their names. Every stage works on
whole texts of any length; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.llm import langid, lines, neardup, packing, toxicity
from photonloom.llm.common import bucket_of, staged, table
from photonloom.llm.queries import tokenizer_path

#: A document with a toxic passage goes if it is toxic with at least this probability.
TOXIC = 0.3
#: A document goes if it has no letter or its language is less sure than this.
LEAST_SURE = 0.3
REST = "__rest"


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator is to see, and all others out of its way in one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(0)).alias(REST))


def together(out: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs again, those that the operator saw as it left them."""
    return out.select(*[F.col(c) if c in used else F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score TOXIC or more and have a significant passage.

    Null and empty texts have none and stay; repeated rows share their fate; a
    score of just TOXIC goes; labels without a document teach nothing.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity.default_learn)
    scored = toxicity.score_documents(apart(docs, "doc_id", "text"), model)
    return together(scored.where((F.col("score") < TOXIC) | (F.size("passages") == 0)), docs, "doc_id", "text")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language: with a letter, and one language at least LEAST_SURE.

    Null, empty and letterless texts go; repeated rows share their fate; of
    languages that tie the first in order counts. Without labelled text to
    learn from nothing is rejected.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"), lambda i: bucket_of(i, 5) != 0)
    if not model.languages:
        return docs
    found = langid.identify_documents(apart(docs, "doc_id", "text"), model)
    return together(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)), docs, "doc_id", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; documents of nothing else go. n_chars follows the text.

    Rows with a null doc_id keep their lines; null and empty texts stay as they
    are. Of places that tie the one with the least doc_id keeps its line.
    """
    out = lines.dedup_lines(apart(docs, "doc_id", "text", "source", "n_chars"), min_sites=6)
    out = out.where(~F.coalesce(F.col("emptied"), F.lit(False)))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return together(out, docs, "doc_id", "text", "source", "n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group.

    Documents with a null doc_id, and ones without words, belong to no group
    and stay; rows that share a doc_id are one document.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, threshold=(75, 100))
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens, without padding.

    Null and empty texts are an end token alone; repeated rows are packed as
    often as they occur; other columns are left out.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), max_tokens=1024, with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: No SQL: toxicity and language scores, near-duplicates and packing go beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
