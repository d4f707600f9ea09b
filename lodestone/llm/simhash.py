"""SimHash near-duplicates by a segment-popcount embedding.

Every fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a
range join on the vectors loses no pair. The vector is kept in unary code in one long
(0, 1, 2 set bits -> 00, 01, 11), where that distance is the popcount of an XOR.

The grid: the 32 coordinates are cut into g bands. Two vectors at distance <= r agree wholly
on at least g - r bands, so both fall into the same cell of one of the C(g, g - r) sub-grids.
g is chosen from the number of distinct fingerprints so that cells stay small at any size;
every g gives the same result.

Groups of many similar fingerprints never turn into all pairs: first each cell links its
members to the cell's least and greatest member, then components are contracted, and only
members outside a cell's leading component are compared with the rest of the cell.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, connected_components, free_name, materialised, small_side

SEED = 42
LOW_BITS = 0x5555555555555555
#: BITS[v, j]: bit j of the byte v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, as an unsigned 64-bit integer.

    A-Z is lower-cased, words are runs without ASCII white space, shingles count as often as
    they occur. A text with fewer words than ``width`` is one shingle; no word gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(h)
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 16):
        b = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((b + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BITS).ravel()
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """``keep`` columns plus ``fp`` (signed 64-bit) for every row; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", fp bigint"

    def run(batches):
        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], names=[*keep, "fp"])

    return kept.mapInArrow(run, schema)


def unary_popcounts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary code."""
    odd = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(odd).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(odd).bitwiseAND(F.lit(LOW_BITS))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def band_masks(g: int) -> list[int]:
    """g bands of whole segments, as bit masks."""
    edges = [2 * (32 * i // g) for i in range(g + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def grid(r: int, n: int) -> list[int]:
    """Masks of the sub-grids for n vectors: the coarsest with under one chance candidate each."""
    for g in range(r + 2, 17):
        # a two-bit count agrees by chance with probability 3/8, that is 1.415 bits a segment
        if n * comb(g, r) / 2 * 2 ** (-1.415 * 32 * (g - r) / g) < 1:
            break
    return [sum(c) for c in combinations(band_masks(g), g - r)]


def cells(distinct: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(members, stars) of distinct fingerprints ``fp``: members (fp, sub, at, lo, hi) of the grid cells that
    hold several, and links a, b of members to their cell's least and greatest fingerprint within ``distance``."""
    masks = grid(distance, distinct.count())
    t = unary_popcounts(F.col("fp"))
    each = F.array(*(F.struct(F.lit(i).alias("sub"), t.bitwiseAND(F.lit(_signed(m))).alias("at")) for i, m in enumerate(masks)))
    points = distinct.select("fp", F.explode(each).alias("cell")).select("fp", "cell.sub", "cell.at")
    heads = points.groupBy("sub", "at").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    members = materialised(points.join(heads, ["sub", "at"]), "cells")
    to_lo, to_hi = (F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) <= distance for c in ("lo", "hi"))
    stars = members.where(to_lo).select(F.col("fp").alias("a"), F.col("lo").alias("b")).unionByName(members.where(to_hi).select(F.col("fp").alias("a"), F.col("hi").alias("b")))
    return members, stars.where("a <> b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp``, ``component_id`` (the least id reachable over links),
    ``text_key`` (hash of the text) and ``root`` (the component's least fingerprint).

    Two rows are linked if their fingerprints differ in at most ``distance`` bits. Texts without
    words share fingerprint 0 and are linked like any other. Rows with a null id take part and
    keep a null id; ``component_id`` is null only if all ids of the component are null.
    Repeated rows stay repeated. An empty table gives no rows. Other columns are ignored.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    rows = materialised(fingerprints(keyed, keep=("doc_id", "text_key"), width=width), "fp")
    distinct = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    members, stars = cells(distinct, distance)
    first = materialised(connected_components(stars), "first")

    # what the stars left apart: members outside the component of the cell's least member
    labelled = members.join(first, members.fp == first.node, "left").select("sub", "at", "fp", "lo", F.coalesce("root", "fp").alias("root"))
    leading = labelled.groupBy("sub", "at").agg(F.min_by("root", "fp").alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    mixed = materialised(labelled.join(leading.select("sub", "at", "lead"), ["sub", "at"]), "mixed")
    x = mixed.where("root <> lead").select("sub", "at", F.col("fp").alias("fa"), F.col("root").alias("a"), unary_popcounts(F.col("fp")).alias("ta"))
    y = mixed.select(F.col("sub").alias("s2"), F.col("at").alias("at2"), F.col("fp").alias("fb"), F.col("root").alias("b"), unary_popcounts(F.col("fp")).alias("tb"))
    bound = F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))) <= distance
    exact = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    across = x.join(y, (F.col("sub") == F.col("s2")) & (F.col("at") == F.col("at2")) & (F.col("a") != F.col("b")) & bound & exact).select("a", "b")
    second = materialised(connected_components(across), "second")

    roots = distinct.join(first.withColumnRenamed("root", "r1"), distinct.fp == first.node, "left").select("fp", "least", F.coalesce("r1", "fp").alias("r1"))
    roots = roots.join(second, roots.r1 == second.node, "left").select("fp", "least", F.coalesce("root", "r1").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id", "text_key", "root")


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 3, width: int = 3, similar: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the
    least id (of several texts with that id, the one with the least hash; null ids come last).

    With ``similar`` links are pairs whose shingle sets have a Jaccard similarity of 0.8 or more: those that
    the fingerprints bring together and, since fingerprints miss most such pairs, all others as well.
    """
    if similar:
        from lodestone.llm.jaccard import similar_texts

        return representatives(docs, similar_texts(docs, text, doc_id, width, distance), text, doc_id)
    return representatives(docs, near_duplicates(docs, text, doc_id, distance, width), text, doc_id)


def representatives(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """As ``survivors``, for the components of ``found`` (id, ``text_key`` and ``root`` of each row)."""
    links = materialised(found.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "text_key").alias("who"), "root"), "links")
    groups = links.groupBy("root").agg(F.min("who").alias("rep"), F.count("*").alias("n")).where("n > 1").select("root", "rep")
    members = links.join(groups, "root")
    gone_id, gone_key = free_name(docs, "_gone_id"), free_name(docs, "_gone_key")
    gone = small_side(materialised(members.where("who <> rep").select(F.col("who.id").alias(gone_id), F.col("who.text_key").alias(gone_key)).distinct(), "gone"))
    stay = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_key)), "left_anti")
    if not members.where("who = rep").groupBy("root").count().where("count > 1").isEmpty():  # one id twice with one text
        name = free_name(docs, "_key")
        stay = stay.withColumn(name, F.xxhash64(text)).dropDuplicates([doc_id, name]).drop(name)
    return stay


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
