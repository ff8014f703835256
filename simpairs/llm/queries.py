"""The numbered queries and, where SQL can express them, their DuckDB SQL.

Each query applies its operator with production parameters to the whole of
its table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests, encode_decode
from .common import table
from .conversation_repair import repair_report
from .embed_dup import embedding_duplicates
from .exact_dedup import exact_dedup
from .language import identify_languages
from .mixing import mix_counts
from .near_dup import near_duplicates
from .quality import score_quality
from .quality_rules import judge_quality
from .spelling import spelling_variants
from .suffix_dedup import removal_digests, remove_repeats
from .token_counts import token_counts
from .url_filters import RULE_SCHEMA, filter_urls

# The rules of the url contract.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public word-level BPE vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(remove_repeats(table(spark, sf_dir, "documents"), width=400))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, the document encoded whole."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, rule="most")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_embed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_near_dup": op6_near_dup,
    "op7_embed_dup": op7_embed_dup,
    "op8_language": op8_language,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling": op12_spelling,
    "op13_quality_rules": op13_quality_rules,
}

OP1_SQL = r"""
WITH rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), m AS (
  SELECT page_id, host, path, max({'n': length(rhost || rpath), 'h': length(rhost), 'rule': rhost || rpath, 'action': action}) AS best
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, CASE WHEN best.n IS NOT NULL THEN best.rule END AS rule, coalesce(best.action, 'allow') AS verdict FROM m
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)
), l AS (
  SELECT *, (total - filled) / w_left AS level FROM r
), lv AS (
  SELECT arg_min(level, filled) AS level FROM l WHERE cap >= level * w
), t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM lv) * w) AS target FROM l
), k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 2), d.doc_id) - 1 AS k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(d.source, '') || '|' || (d.source IS NULL)::VARCHAR), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor((k + 1) * rate + u) - floor(k * rate + u)) * size)::BIGINT AS taken FROM k
"""

ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_mixing": OP10_SQL,
}
