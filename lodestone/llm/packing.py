"""Packing into optimal length buckets.

Texts longer than the longest sequence are cut into pieces, so the global histogram of piece
lengths has a bounded number of entries. Dynamic programming over it chooses the bucket
boundaries with the least padding; batches under a token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, no_clash
from lodestone.llm.token_rollup import Tokenizer, count_tokens

#: Longest sequence, number of buckets and tokens of a batch, padding included.
LONGEST, BUCKETS, BUDGET = 4096, 16, 65536
#: Pieces that one task numbers at most (in expectation).
SHARD = 100_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padding in all.

    ``lengths`` are distinct and ascending. A sequence pads to the bound of its bucket. The cost
    of a bucket over i..j is lengths[j] * n(i..j) - tokens(i..j); it satisfies the quadrangle
    inequality, so the best split moves one way and each layer is filled by divide and conquer.
    """
    m = len(lengths)
    if not m:
        return []
    size = np.asarray(lengths, float)
    n = np.concatenate([[0], np.cumsum(np.asarray(counts, float))])
    tokens = np.concatenate([[0], np.cumsum(size * np.asarray(counts, float))])
    best, choice = size * n[1:] - tokens[1:], []
    for _ in range(min(buckets, m) - 1):
        layer, split = best.copy(), np.zeros(m, int)  # split 0: one bucket fewer is enough
        todo = [(1, m - 1, 0, m - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)  # the last bucket starts after i
            cost = best[i] + size[j] * (n[j + 1] - n[i + 1]) - (tokens[j + 1] - tokens[i + 1])
            k = int(cost.argmin())
            if cost[k] < layer[j]:
                layer[j], split[j] = cost[k], i[k] + 1
            todo += [(lo, j - 1, first, i[k]), (j + 1, hi, i[k], last)]
        choice.append(split)
        best = layer
    out, j = [], m - 1
    for split in reversed(choice):
        if split[j]:
            out.append(lengths[j])
            j = split[j] - 1
    return [*reversed([*out, lengths[j]])]


def pack(docs: DataFrame, length: Tokenizer | Column, keep: tuple[str, ...] = ("doc_id",), longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: ``keep`` columns, piece, start, length, bucket, batch, slot.

    ``length`` is the tokenizer that counts the tokens of ``text`` (null: none), or a column with their
    number (null: none). Piece p covers tokens start .. start + length - 1. ``bucket`` is the padded length, ``batch`` numbers the
    bucket's batches from 0 and ``slot`` the places in a batch; bucket * places <= budget (at least
    one place). A row without tokens gives one piece of length 0 without bucket, batch and slot.
    Repeated rows stay repeated, null ids are ids like others. An empty table gives no rows. Very long
    texts are cut into pieces, none is left out. Which of equally long pieces share a batch may differ
    from run to run.

    Only lengths and ids are shuffled. Places are numbered by shards, whose sizes add up to
    offsets, so no bucket is sorted in one task; rows are dealt to shards by a number of their own,
    so rows with one id, or with none, don't gather.
    """
    no_clash(keep, ("piece", "start", "length", "bucket", "batch", "slot"))
    if isinstance(length, Tokenizer):
        sized = count_tokens(docs, length, list(keep)).select(*keep, F.col("n_tokens").alias("_n"))
    else:
        sized = docs.select(*keep, F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    counted = materialised(sized.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / longest).cast("int") - 1)
    pieces = counted.select(*keep, "_n", "_row", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("bigint") * longest)
    pieces = pieces.withColumn("length", F.least(F.lit(longest), F.col("_n") - F.col("start")).cast("int")).drop("_n")
    histogram = pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()  # at most ``longest`` rows
    bounds = boundaries([x.length for x in histogram], [x.n for x in histogram], buckets)
    if not bounds:
        none = F.lit(None)
        return pieces.select(*keep, "piece", "start", "length", none.cast("int").alias("bucket"), none.cast("bigint").alias("batch"), none.cast("int").alias("slot"))
    bucket, shards, rows = F.lit(bounds[0]), F.lit(1), 0
    for low, b in zip([0, *bounds], bounds, strict=False):
        here = sum(x.n for x in histogram if low < x.length <= b)
        bucket = F.when(F.col("length") > low, b).otherwise(bucket)
        shards = F.when(F.col("length") > low, -(-here // SHARD)).otherwise(shards)
        rows += -(-here // SHARD)
    placed = pieces.where("length > 0").withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64("_row", "piece"), shards))
    sizes = placed.groupBy("bucket", "_shard").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_shard", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("bucket", "_shard").orderBy("_row", "piece")
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(offsets) if rows <= 4096 else offsets, ["bucket", "_shard"])
    place, room = F.col("_at") + F.col("_offset"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    out = numbered.select(*keep, "piece", "start", "length", "bucket", F.floor(place / room).alias("batch"), (place % room).cast("int").alias("slot"))
    empty = pieces.where("length <= 0").select(*keep, "piece", "start", "length", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return out.unionByName(empty)
