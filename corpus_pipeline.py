"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, whatever their names, with further columns as they are.

In every stage a null or blank text is a document like any other: it gets a score, is no
near copy, holds no secret, takes no part of the mix (so it ends there) and would have no tokens. Null
ids, languages and sources are kept; a null source is a source of its own. Rows that repeat
are judged alike and count as copies of each other. Texts are whole at any length.
Ties are broken by id and then by hash of the row, so reruns agree. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, quality, secrets
from tidemark.llm.queries import QUALITY, documents, vocabulary
from tidemark.llm.textbits import fresh
from tidemark.session import materialize


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``QUALITY``; columns as they are."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_score")
    scored = quality.score(docs, model, out=score)
    return scored.where(F.col(score) >= QUALITY).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of rows with the same id and group one stays."""
    return jaccard_join.representatives(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the texts replaced by a mask; n_chars follows the new text, all documents stay."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and the SHA-256 of the text that they decode to, for each row."""
    rows = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(rows, vocabulary(), decoded="decoded_sha256")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: The classifier, the randomness tests and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
