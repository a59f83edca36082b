"""The training-data queries over the shared tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import ann, chat, lm, media, minhash, mixing, quality, urls, warc
from .bpe import Tokenizer
from .tables import table, written

URL_RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))
#: Documents scored below this are rejected.
QUALITY_THRESHOLD = 0.3


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return sides.select("conv_id", "side", "segment", "n_turns", "text", spans.alias("mask"), "mask_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokenizer.digests(_documents(spark, sf_dir, "doc_id", "text"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir, "doc_id", "text"), ~lm.held_out(F.col("doc_id")))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, "allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), words=4, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    stored = media.store(docs)
    examined = written(media.examine(stored), "examined", small=True)
    pages = media.parse(docs.select(media.key_of(F.col("text")).alias("key"), media.article(F.col("text")).alias("html")), keep=False)
    # Copies have one sequence; its places, captions and what the blocks look like are the feature.
    refs = media.references(pages, ["key"]).select("key", "position", "caption", "digest").distinct()
    shown = media.resolve(refs, media.looks(examined)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "caption", "look"))).alias("m"))
    feature = F.array_join(F.transform("m", lambda x: F.concat_ws("|", x["position"].cast("string"), x["caption"], x["look"])), ";")
    whole = examined.drop("blocks").join(shown.select("key", feature.alias("feature")), "key")
    return stored.select("doc_id", "n_bytes", "key").join(whole, "key").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_lm_score": op3_lm_score,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_urls": op7_urls,
    "op8_minhash": op8_minhash,
    "op9_warc": op9_warc,
    "op10_media": op10_media,
}

_UPPER_TO_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"

ORACLE_SQL: dict[str, str] = {
    "op1_chat": """
WITH t AS (
    SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS content,
        CASE WHEN role IS NULL THEN 'user' WHEN role = 'system' THEN role
            ELSE 'user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') END AS named
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), d AS (
    SELECT *, row_number() OVER w AS place, floor((sum(length(named) + length(content) + 24) OVER w - length(named) - length(content) - 24) / 4194304) AS segment
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, md5(content) ROWS UNBOUNDED PRECEDING)
), s AS (
    SELECT DISTINCT conv_id, role AS side FROM t WHERE role IS NOT NULL AND role <> 'system'
), m AS (
    SELECT d.conv_id, side, CAST(segment AS BIGINT) AS segment, place, role, content,
        '<|im_start|>' || CASE WHEN role = side THEN 'assistant' ELSE named END || chr(10) AS head
    FROM d JOIN s USING (conv_id)
), p AS (
    SELECT *, sum(length(head) + length(content) + 11) OVER (PARTITION BY conv_id, side ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM m
)
SELECT conv_id, side, segment, count(*) AS n_turns,
    string_agg(head || content || '<|im_end|>' || chr(10), '' ORDER BY place) AS text,
    coalesce(string_agg(CASE WHEN role = side THEN CAST(upto - length(content) - 11 AS BIGINT)::VARCHAR || '-' || CAST(upto AS BIGINT)::VARCHAR END,
        ',' ORDER BY place), '') AS mask,
    CAST(coalesce(sum(CASE WHEN role = side THEN length(content) + 11 END), 0) AS BIGINT) AS mask_chars
FROM p GROUP BY conv_id, side, segment
""",
    "op7_urls": f"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER_TO_LOWER}) AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
}
