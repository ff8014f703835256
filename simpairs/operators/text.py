"""Text preparation and encoding.

The reference's per-row tokenizer is re-aimed as a batch job: regular
expression tokens, a vocabulary built from the whole corpus (ids in a seeded
hash order, so every engine numbers it the same way), truncation and padding
to the longest row of each batch.  The default sentence encoder is a hashed
bag of tokens: one vector per document, built behind a single exchange of the
texts by document.  A user encoder (``K2``) plugs in as any
``DataFrame -> DataFrame`` producing ``(id, vec array<double>)``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import scratch_dir
from .losses import triplet_terms
from .rank import hash_rank

# The token pattern (letter/digit runs, or one other non-space
# character), the padding id and the default truncation length.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
PAD_ID = 0
MAX_LENGTH = 512
HASH_DIMS = 256


def tokens(text) -> Column:
    """All tokens of the whole text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct tokens of the corpus with ids 1..V in md5 order (0 is padding).
    The numbering is a bucketed global rank, so no task holds the vocabulary."""
    tok = docs.select(F.explode(tokens(text_col)).alias("token")).distinct()
    return hash_rank(tok, F.md5("token"), ["token"], out="token_id")


def token_ids(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Per document: ``input_ids`` of its first ``max_length`` tokens.

    Tokens are exploded with their position, joined to the vocabulary on the
    token, and re-collected in position order; a document keeps at most
    ``max_length`` ids, so the collected array is bounded."""
    ex = docs.select(id_col, F.posexplode(F.slice(tokens(text_col), 1, max_length)).alias("_pos", "token"))
    j = ex.join(vocab.select("token", "token_id"), "token")
    ids = j.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "token_id"))), lambda x: x["token_id"]).alias("input_ids")
    )
    out = docs.select(id_col).join(ids, id_col, "left")
    return out.withColumn("input_ids", F.coalesce("input_ids", F.array().cast("array<bigint>")))


def pad_batches(df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids") -> DataFrame:
    """Pad every row to the longest row of its batch (G1): ``input_ids``
    padded with ``PAD_ID``, ``attention_mask`` of 1 then 0.  The window is
    per batch, whose size is bounded by the batch size."""
    n = F.size(ids_col)
    d = df.withColumn("n_tokens", n).withColumn("padded_length", F.max(n).over(Window.partitionBy(batch_col)))
    pad = F.col("padded_length") - F.col("n_tokens")
    return d.withColumn(
        "input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad))
    ).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), pad))
    )


# -- encoders ------------------------------------------------------------------

def hashed_bag(docs: DataFrame, id_col: str, text_col: str, dims: int = HASH_DIMS) -> DataFrame:
    """Default encoder (G5): ``(id, vec)`` with token counts hashed into
    ``dims`` buckets by md5.

    Tokens become their dimensions inside the row, so only small integers are
    dealt out by document, where rows of one id are counted together: no table
    of tokens is held.  Counting is numpy over Arrow batches."""
    dim = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims).cast("smallint" if dims <= 2**15 else "int")
    hashed = docs.select(id_col, F.transform(tokens(text_col), dim).alias("_dims"))
    gathered = hashed.groupBy(id_col).agg(F.flatten(F.collect_list("_dims")).alias("_dims"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        step = max(1, 2**20 // dims)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = part.column(1)
                size = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(np.arange(len(size)) * dims, size) + found.flatten().to_numpy(zero_copy_only=False)
                bags = pa.array(np.bincount(place, minlength=len(size) * dims).astype(np.float64))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * dims, pa.int32()), bags)
                yield pa.RecordBatch.from_arrays([part.column(0), vec], names=[id_col, "vec"])

    return gathered.mapInArrow(count, f"`{id_col}` {id_type}, vec array<double>")


Encoder = Callable[[DataFrame, str, str], DataFrame]


def encode_once(docs: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """The encoder's ``(id, vec)`` rows, written to the shared scratch folder:
    a pair or triplet table reads them once per side without encoding again."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "encoded")
    vec = encoder(docs, id_col, text_col).select(id_col, "vec")
    vec.write.parquet(path)
    return spark.read.schema(vec.schema).parquet(path)


def score_pairs(
    docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, a_id: str, b_id: str, encoder: Encoder = hashed_bag
) -> DataFrame:
    """End-to-end pair scoring (G6): encode every document once, then the
    cosine (F1) of each row of ``pairs`` as ``cos``; the columns of ``pairs``
    stay, and a pair that is listed twice is scored twice.  Ids without a
    document count as zero vectors.  ``encoder`` is the hook (K2)."""
    vec = encode_once(docs, id_col, text_col, encoder)
    u = vec.select(F.col(id_col).alias(a_id), F.col("vec").alias("_u"))
    v = vec.select(F.col(id_col).alias(b_id), F.col("vec").alias("_v"))
    j = pairs.join(u, a_id, "left").join(v, b_id, "left")
    return j.select(*pairs.columns, F.coalesce(cosine("_u", "_v"), F.lit(0.0)).alias("cos"))


def score_triplets(
    docs: DataFrame, triplets: DataFrame, id_col: str, text_col: str, anchor: str, positive: str, negative: str,
    margin: float = 1.0, p: float = 2.0, encoder: Encoder = hashed_bag,
) -> DataFrame:
    """End-to-end triplet scoring (G7): encode three texts, two distances,
    hinge and correctness per row (F4, D8, D9)."""
    vec, j = encode_once(docs, id_col, text_col, encoder), triplets
    for k, c in enumerate((anchor, positive, negative)):
        j = j.join(vec.select(F.col(id_col).alias(c), F.col("vec").alias(f"_x{k}")), c)
    return triplet_terms(j, "_x0", "_x1", "_x2", margin, p).drop("_x0", "_x1", "_x2")
