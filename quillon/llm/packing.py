"""Packing by optimal length buckets.

One global histogram of token counts decides the bucket boundaries: dynamic programming over its bins finds those that minimise the
padding of all documents. Inside a bucket every document is padded to the longest one there, and batches hold as many documents as the token
budget allows. Batches form inside shares of a bucket of about SHARE documents, so a bucket that holds most of the corpus is
spread over many tasks; only the last batch of a share may be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 12
BUDGET = 65_536
SHARE = 20_000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, k: int) -> list[int]:
    """The longest length of each of at most k consecutive buckets of bins, with the least padding in all.

    Bins ascend; of each the longest length, the number of documents and their tokens are given. Exact, O(k * bins^2).
    """
    n = len(longest)
    if not n:
        return []
    docs, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    best = longest * docs[1:] - tokens[1:]  # padding of bins 0..j as one bucket
    back = []
    for _ in range(min(k, n) - 1):
        new, step = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + longest[j] * (docs[j + 1] - docs[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], step[j] = cost[i], i
        best = new
        back.append(step)
    out, j = [int(longest[-1])], n - 1
    for step in reversed(back):
        if step[j] >= 0:
            j = int(step[j])
            out.append(int(longest[j]))
    return out[::-1]


def bin_of(n: Column) -> Column:
    """A length's bin: lengths below 1,024 have their own, longer ones share bins of 1/512 of their size. 64-bit lengths: 28,160 bins at most."""
    shift = F.greatest(F.lit(0), F.length(F.bin(n)) - 10)
    return shift * 512 + F.call_function("shiftright", n, shift)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None, id_col: str = "doc_id", share: int = SHARE) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, share, batch, slot, batch_docs, padding), one row per input row.

    `tokens` gives a row's length (default: the words of `text`); null and below 0 count as 0. A batch is named by
    (bucket, share, batch) and holds batch_docs documents at most, slot 0 on: budget // bucket_tokens, or one where a single
    document exceeds the budget. Where all lengths are below 1,024 the boundaries are the true optimum; longer lengths
    are told apart to 1/512. Order inside a share: length, doc_id (nulls first). An empty table gives no rows.
    """
    length = F.greatest(F.lit(0), F.coalesce(tokens if tokens is not None else word_count(F.col("text")), F.lit(0))).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n_tokens"))
    hist = rows.groupBy(bin_of(F.col("n_tokens")).alias("bin")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")).orderBy("bin").collect()
    longest, count, total = (np.array([h[c] for h in hist], np.int64) for c in ("longest", "docs", "tokens"))
    ends = boundaries(longest, count, total, buckets)
    held = np.bincount(np.searchsorted(ends, longest), count, minlength=len(ends)) if ends else np.zeros(0)
    shares = [max(1, int(-(-h // share))) for h in held] or [1]
    whole = lambda xs: F.expr(f"cast(array({', '.join(map(str, xs))}) as array<bigint>)")
    bucket = F.size(F.filter(whole(ends), lambda e: e < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", F.get(whole(ends), F.col("bucket")))
    # Rows of one id, or of none, are spread too: by their place in the task that reads them, which decides nothing but the share.
    spread = F.xxhash64("doc_id", F.floor(F.monotonically_increasing_id() / 64))
    placed = placed.withColumn("share", F.pmod(spread, F.get(whole(shares), F.col("bucket"))))
    placed = placed.withColumn("batch_docs", F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div greatest(1L, bucket_tokens)")))
    line = F.row_number().over(Window.partitionBy("bucket", "share").orderBy("n_tokens", "doc_id")) - 1
    return placed.withColumn("line", line.cast("long")).select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", "share", F.expr("line div batch_docs").alias("batch"), F.expr("line % batch_docs").alias("slot"), "batch_docs", (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
