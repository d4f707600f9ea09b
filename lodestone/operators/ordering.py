"""Places and running sums in a total order without gathering a group in one task.

A group's rows are cut into ranges by a bucket that grows with the order, rows are numbered inside
their range, and the ranges' totals, one row a range, add up to offsets. So a group with a third of
all rows is sorted by as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(digest: Column) -> Column:
    """Range of a hexadecimal digest: its first three digits, 4,096 ranges."""
    return F.substring(digest, 1, 3)


def running(rows: DataFrame, by: list[str], order: list[str], bucket: Column, size: Column | None = None, at: str = "_at", total: str = "_n") -> DataFrame:
    """``rows`` with ``at``, the sum of ``size`` (default: 1 a row) over the rows of the group before this
    one in ``order``, and ``total``, the sum over the group.

    ``bucket`` must not fall while ``order`` rises. Null group keys form a group. Ties in ``order``
    get some order among themselves.
    """
    sized = rows.withColumns({"_bucket": bucket, "_size": (F.lit(1) if size is None else size).cast("bigint")})
    sums = sized.groupBy(*by, "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_k{i}" for i, c in enumerate([*by, "_bucket"])}
    offsets = sums.select(*(F.col(c).alias(k) for c, k in names.items()), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(Window.partitionBy(*by)).alias(total))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    met = placed.join(offsets, on)
    return met.withColumn(at, F.col("_inside") + F.col("_offset")).drop("_bucket", "_size", "_inside", "_offset", *names.values())


#: Rows of a range about, ranges at most, and sampled keys a range.
RANGE_ROWS, RANGES, KEYS_A_RANGE = 50_000, 512, 16


def range_bucket(rows: DataFrame, key: Column) -> Column:
    """A bucket for ``running`` when the order has no arithmetic: the number of bounds up to ``key``.

    Bounds are taken from a sample of at most some RANGES * KEYS_A_RANGE keys, which the driver sorts. Any sample
    gives right results; it only decides how even the ranges are. ``key`` must not be null.
    """
    n = rows.count()
    ranges = min(RANGES, n // RANGE_ROWS + 1)
    if ranges == 1:
        return F.lit(0)
    share = min(1.0, ranges * KEYS_A_RANGE / n)
    keys = rows.select(key.alias("k")).where(F.shiftrightunsigned(F.xxhash64("k"), 1) < F.lit(int(share * (1 << 63)) - 1)).orderBy("k").collect()
    bounds = [keys[len(keys) * i // ranges].k for i in range(1, ranges) if keys]
    return F.size(F.filter(F.lit(bounds), lambda b: b <= key)) if bounds else F.lit(0)


def previous(rows: DataFrame, by: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the ``value`` of the row before this one in its group (null for the first).

    A range looks back inside itself; its first row gets the value that the range before ended with. ``bucket`` as
    in ``running``; ``order`` tells rows apart.
    """
    cut = rows.withColumn("_bucket", bucket)
    ends = cut.groupBy(*by, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    names = {c: f"_k{i}" for i, c in enumerate([*by, "_bucket"])}
    carried = ends.select(*(F.col(c).alias(k) for c, k in names.items()), F.lag("_end").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_carried"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    near = cut.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(value).over(inside)})
    met = near.join(carried, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()])
    return met.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_bucket", "_first", "_lag", "_carried", *names.values())


#: Rows of a block that gets the rows before it.
BLOCK = 4096


def with_halo(placed: DataFrame, at: str, n: int, size: int = BLOCK) -> DataFrame:
    """The rows of blocks of ``size`` places, each with the ``n`` rows before it: adds ``_block`` and ``_own``, false
    for the rows lent to a block. ``at`` are the places of a group's rows without gaps, as ``running`` gives them."""
    size = max(size, n)
    block = F.floor(F.col(at) / size)
    lent = F.when(F.col(at) % size >= size - n, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")))
    each = F.array_compact(F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")), lent))
    return placed.select("*", F.explode(each).alias("_e")).select("*", "_e._block", "_e._own").drop("_e")


def streamed_digest(rows: DataFrame, by: list[str], order: list[str], piece: Column, between: bytes = b"") -> DataFrame:
    """``by``, ``n`` (rows) and ``digest``: SHA-256, in hexadecimal, of a group's pieces in ``order``, joined by ``between``.

    ``piece`` is binary; null pieces are counted but left out. A digest is a sequence by nature, so a group is
    read by one task, but from sorted batches: the task holds a batch and the state of the hash, however large the
    group. Groups without rows have no row.
    """
    import hashlib

    import pyarrow as pa

    keyed = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), piece.alias("piece"))
    keys = [f"k{i}" for i in range(len(by))]
    cut = keyed.repartition(*keys) if keys else keyed.repartition(1)
    sorted_ = cut.sortWithinPartitions(*keys, *(f"o{i}" for i in range(len(order)))).select(*keys, "piece")
    fields = [f.name for f in sorted_.schema.fields if f.name != "piece"]

    def run(batches):
        now, h, n, some, done = None, None, 0, False, []

        def out(kinds):
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int64(), pa.string()], strict=True))], names=[*fields, "n", "digest"])

        for b in batches:
            kinds = [b.schema.field(c).type for c in fields]
            columns = [b.column(c).to_pylist() for c in fields]
            heads = list(zip(*columns, strict=True)) if columns else [()] * b.num_rows
            pieces = b.column("piece").to_pylist()
            start = 0
            while start < len(pieces):
                key = heads[start]
                stop = len(pieces) if heads[-1] == key else next(i for i in range(start, len(pieces)) if heads[i] != key)
                if key != now:
                    if h is not None:
                        done.append((*now, n, h.hexdigest()))
                        if len(done) == 4096:
                            yield out(kinds)
                    now, h, n, some = key, hashlib.sha256(), 0, False
                live = [p for p in pieces[start:stop] if p is not None]
                if live:
                    h.update((between if some else b"") + between.join(live))
                    some = True
                n += stop - start
                start = stop
        if h is not None:
            done.append((*now, n, h.hexdigest()))
            yield out(kinds)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.schema.fields if f.name != "piece"), "n bigint", "digest string"])
    return sorted_.mapInArrow(run, schema).withColumnsRenamed(dict(zip(keys, by, strict=True)))


def ordered_means(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``by`` and ``name``, the mean of a group's values, added one after the other in ``order``. Nulls don't count.

    Sums of doubles depend on their order, and where a mean is rounded or compared the last bit shows; this one is the
    same on every run and however rows are dealt. Like a digest it is a sequence by nature: a group is read by one
    task, from sorted batches, and the task holds a batch and one sum.
    """
    import numpy as np
    import pyarrow as pa

    keys = [f"k{i}" for i in range(len(by))]
    keyed = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).cast("double").alias("v"))
    sorted_ = keyed.repartition(*keys).sortWithinPartitions(*keys, *(f"o{i}" for i in range(len(order)))).select(*keys, "v")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sorted_.schema.fields if f.name != "v"), f"`{name}` double"])

    def run(batches):
        now, total, n, kinds = None, 0.0, 0, None

        def out(done):
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.float64()], strict=True)], names=[*keys, name])

        for b in batches:
            if not b.num_rows:
                continue
            kinds, done = [b.schema.field(k).type for k in keys], []
            heads = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            values = b.column("v").to_numpy()
            starts = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
            for start, stop in zip(starts, starts[1:], strict=False):
                if n and heads[start] != now:
                    done.append((*now, total / n))
                    total, n = 0.0, 0
                now = heads[start]
                total, n = float(np.cumsum(np.concatenate(([total], values[start:stop])))[-1]), n + stop - start
            if done:
                yield out(done)
        if n:
            yield out([(*now, total / n)])

    return sorted_.mapInArrow(run, schema).withColumnsRenamed(dict(zip(keys, by, strict=True)))


#: Rows of a group whose pieces are gathered.
GATHER = 10_000


def text_digest(rows: DataFrame, by: list[str], value: str, between: str, gather: int = GATHER, text: Callable[[Column], Column] = lambda v: v, distinct: bool = False) -> DataFrame:
    """``by``, ``n``, ``first`` and ``digest``: SHA-256 of a group's texts in their order, joined by ``between``; ``text`` makes the
    text of a ``value``, so that the short values move and not their texts. With ``distinct`` a value counts once.

    Groups of up to ``gather`` rows are sorted as arrays; larger ones are streamed in order, so none is gathered.
    """
    names = {c: f"_g{i}" for i, c in enumerate(by)}
    sizes = rows.groupBy(*(F.col(c).alias(k) for c, k in names.items())).agg(F.count("*").alias("_n"))

    def gathered(some: DataFrame) -> DataFrame:
        # nulls count, but have no text
        values = (F.collect_set if distinct else F.collect_list)(value)
        nulls = F.count_if(F.col(value).isNull())
        each = some.groupBy(*by).agg(values.alias("_v"), (F.least(nulls, F.lit(1)) if distinct else nulls).alias("_nulls"))
        each = each.select(*by, (F.size("_v") + F.col("_nulls")).cast("bigint").alias("n"), F.array_sort(F.transform("_v", text)).alias("_t"))
        return each.select(*by, "n", F.get("_t", F.lit(0)).alias("first"), F.sha2(F.array_join("_t", between).cast("binary"), 256).alias("digest"))

    if sizes.where(F.col("_n") > gather).isEmpty():
        return gathered(rows)
    met = rows.join(sizes, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]).drop(*names.values())
    large = met.where(F.col("_n") > gather).select(*by, value)
    large = (large.distinct() if distinct else large).withColumn("_t", text(F.col(value)))
    firsts = large.groupBy(*(F.col(c).alias(k) for c, k in names.items())).agg(F.min("_t").alias("first"))
    digests = streamed_digest(large, by, ["_t"], F.col("_t").cast("binary"), between.encode())
    digests = digests.join(firsts, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]).select(*by, "n", "first", "digest")
    return gathered(met.where(F.col("_n") <= gather)).unionByName(digests)
