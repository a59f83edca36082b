"""A training corpus from the documents table: judged, freed of near copies, mixed and tokenised.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import minhash, mixing, quality
from specloom.llm.bpe import Tokenizer
from specloom.llm.tables import remove_written, table, written, written_so_far

#: Documents with a lower score are rejected.
QUALITY_THRESHOLD = 0.3


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return name


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learnt from the labels, reaches the threshold.

    A null text is scored as an empty one; repeated rows are judged alike; without usable labels every
    score is the same; an empty table stays empty; all columns stay, whatever their names.
    """
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _unused("score", docs)
    return quality.score(docs, model, out=score).where(F.col(score) >= QUALITY_THRESHOLD).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, then the smallest digest of
    its text. A document is an id and a text: of rows that repeat both one stays, an id's other texts are
    documents of their own, and rows without an id come after all others.

    Texts without words are like no other, but for rows that repeat their id and text; an empty table
    stays empty; all columns stay, whatever their names.
    """
    key, digest = _unused("key", docs), _unused("digest", docs)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        kept = written(minhash.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id"), "kept")
        kept = F.broadcast(kept) if kept.count() <= minhash.BROADCAST_IDS else kept
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    # Ids don't tell documents apart: their places in the order of ids and digests do.
    marked = docs.withColumn(digest, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    documents = marked.select("doc_id", digest).distinct()
    placed = documents.orderBy(F.col("doc_id").asc_nulls_last(), digest)
    id_, mark = _unused("id", docs), _unused("mark", docs)
    placed = written(placed.select(F.col("doc_id").alias(id_), F.col(digest).alias(mark), F.monotonically_increasing_id().alias(key)), "places")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(mark))
    keyed = written(marked.join(placed, same).dropDuplicates([key]).select(*docs.columns, key), "keyed")
    kept = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80).where("kept")
    return keyed.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: its taken words over its size, to the
    nearest whole number.

    A document without words is not taken; a null source is a source of its own; rows that share an id
    are taken as often as they are together; an empty table stays empty; all columns stay, whatever
    their names.
    """
    plan = mixing.plan(docs).groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    key, copies = _unused("id", docs), _unused("copies", docs)
    plan = plan.where("_taken > 0").select(F.col("doc_id").alias(key), F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int").alias(copies))
    plan = written(plan.where(F.col(copies) > 0), "copies")
    plan = F.broadcast(plan) if plan.count() <= minhash.BROADCAST_IDS else plan
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(key)))
    return both.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the SHA-256 of the bytes that they decode to.

    A null text has no ids; repeated rows are encoded each; an empty table gives an empty table; of the
    documents' columns only ``doc_id``, ``lang`` and ``source`` are returned.
    """
    tokenizer = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = tokenizer.digests(docs.select("doc_id", "lang", "source", "text"), with_ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", judge),
    ("near_duplicates", deduplicate),
    ("mixing", mix),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, first = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_written(first, [docs])  # what led to this stage's rows
    return docs


#: The first and the second stage can't be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None
