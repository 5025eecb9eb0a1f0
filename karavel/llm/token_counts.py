"""Exact token counts for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from karavel.llm.common import stage

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that byte-level vocabularies of this kind split texts with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 1024  # lengths that are summed together before the sums of all larger ones are added


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def encoded_lengths(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens of every whole text. Null and empty texts have 0 tokens; repeated rows count each.

    The vocabulary (a fixed file) is read by the driver and sent once to each executor; texts never hold special tokens.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per occurring length, with sums over it and all larger ones.

    limit: the length taken as context limit; n_docs: documents of just this length; docs_at_least and
    tokens_at_least: suffix sums; truncated_total: tokens left if every text is cut to ``limit``;
    docs_below: documents shorter than it, which gives quantiles; total_docs and total_tokens.
    Suffix sums are taken in blocks of lengths, then over the blocks, so no task holds all lengths. Empty input: no rows.
    """
    # written once: both uses below would encode every text again
    counts = stage(lengths.groupBy(F.col("n_tokens").alias("limit")).agg(F.count("*").alias("n_docs")), "token_lengths")
    counts = counts.withColumn("block", F.floor(F.col("limit") / BLOCK)).withColumn("tokens", F.col("limit") * F.col("n_docs"))
    sums = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of lengths
    all_ = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = sums.select("block", zero(F.sum("bd").over(above)).alias("docs_above"), zero(F.sum("bt").over(above)).alias("tokens_above"), F.sum("bd").over(all_).alias("total_docs"), F.sum("bt").over(all_).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("limit").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(sums, "block")
    out = out.withColumn("docs_at_least", F.col("d") + F.col("docs_above")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_above"))
    below = F.col("total_tokens") - F.col("tokens_at_least")
    return out.select("limit", "n_docs", "docs_at_least", "tokens_at_least", (below + F.col("limit") * F.col("docs_at_least")).alias("truncated_total"), (F.col("total_docs") - F.col("docs_at_least")).alias("docs_below"), "total_docs", "total_tokens")


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of the documents does not exceed, as one row (n_tokens), null if empty."""
    covered = F.col("docs_below") + F.col("n_docs") >= F.ceil(F.lit(q) * F.col("total_docs"))
    return histogram.where(covered).agg(F.min("limit").alias("n_tokens"))


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """Documents cut by any context limit, and the tokens that are left: (cut_docs, truncated_total), exact for limits between lengths too."""
    longer = F.col("limit") > limit
    kept = F.sum(F.least(F.col("limit"), F.lit(limit)) * F.col("n_docs"))
    return histogram.agg(F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("cut_docs"), kept.alias("truncated_total"))
