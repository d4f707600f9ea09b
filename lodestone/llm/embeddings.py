"""Embedding near-duplicates as an exact metric range join.

Unit vectors with cosine >= c lie at most r = sqrt(2 - 2c) apart. Vectors of one label and length form a
cell. A cell with too many vectors is split by pivots: each vector lives in the cell of its nearest pivot
and, by the triangle inequality, is also sent as a guest to every cell whose pivot is at most 2r further
away, and stays there only if it lies within r of the ball of that cell's own vectors. So all partners of a
vector meet it in the cell where it lives, and cells join independently. Cells are split until they are
small or a split no longer helps. Cells are compared in tiles of bounded size, by matrix products in double
precision; a tile gives a count a vector and a spanning star of the links, never pairs.

Copies of a vector are one vector with a number of copies. Vectors within r / 2 of their pivot, the cell's ball,
are all linked by the triangle inequality: they are counted by a sum and joined by a star, not compared. With what
lies beyond r of the ball's edge they have no link and aren't compared either. Pivots of a split are more than r / 2
apart, so a group of near copies gets one pivot and is such a ball, however large: its cost is linear.
"""

from __future__ import annotations

from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, connected_components, materialised, small_side

#: Vectors that live in a cell that isn't split, pivots of a split at most, vectors a side of a tile.
CELL, FAN, TILE = 2048, 32, 2048
#: Splits of a cell at most; what is still large is compared in tiles all the same.
DEPTH = 6
#: Distances differ from exact ones by far less than this.
SLACK = 1e-9


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision. A list of lists that all have that length."""
    flat = np.asarray(vectors.flatten(), np.float64)
    x = flat.reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_cell(cells: list):
    """(cell, places) for each cell of a batch."""
    places: dict = {}
    for i, c in enumerate(cells):
        places.setdefault(c, []).append(i)
    return places.items()


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def valid(vector):
    """Vectors that can be linked: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _split(state: DataFrame, crowded: DataFrame, r: float, cell: int, fan: int, level: int) -> DataFrame:
    """The rows of crowded cells (cell, lives: vectors that live there), dealt to the cells of their pivots."""
    spark = state.sparkSession
    crowded = materialised(crowded.select("cell", "lives", F.least(F.lit(fan), F.ceil(2 * F.col("lives") / cell)).cast("int").alias("fan")), "crowded")
    # pivots: the first by hash among a share of the cell that holds a few times as many
    rank = F.xxhash64("node", F.lit(level))
    here = state.where("home").select("cell", "node", "vec").join(small_side(crowded), "cell")
    share = F.shiftrightunsigned(rank, 1) < F.lit(float(1 << 63)) * F.least(F.lit(1.0), (4 * F.col("fan") + 16) / F.col("lives"))
    first = F.row_number().over(Window.partitionBy("cell").orderBy("rank", "node"))
    here = here.withColumn("rank", rank)
    chosen = here.where(share).withColumn("at", first).where("at <= 4 * fan + 16").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("s"))
    one = here.groupBy("cell").agg(F.array(F.min_by("vec", "rank")).alias("one"))  # should the share be empty
    sampled = one.join(chosen, "cell", "left").join(small_side(crowded.select("cell", "fan")), "cell").select("cell", "fan", F.coalesce(F.transform("s", lambda x: x["vec"]), "one").alias("pivots"))

    def apart(batches):
        for b in batches:
            out = []
            for fan, sample in zip(b.column("fan").to_pylist(), b.column("pivots"), strict=True):
                x, kept = unit_rows(sample.values), [0]
                for i in range(1, len(x)):
                    if len(kept) < fan and _distances(x[i : i + 1], x[kept]).min() > r / 2:
                        kept.append(i)
                out.append(sample.values.take(pa.array(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(out, b.column("pivots").type)], names=["cell", "pivots"])

    kind = state.schema["vec"].dataType.simpleString()
    pivots = materialised(sampled.mapInArrow(apart, f"cell string, pivots array<{kind}>"), "pivots")
    reach = 2 * r + SLACK

    def deal(batches):
        for b in batches:
            out = {"cell": [], "row": [], "home": [], "far": []}
            cells = b.column("cell").to_pylist()
            for c, at in _by_cell(cells):
                d = _distances(unit_rows(b.column("vec").take(pa.array(at))), unit_rows(b.column("pivots")[at[0]].values))
                home, near = np.array(b.column("home").take(pa.array(at)).to_pylist()), d.argmin(1)
                goes = d <= d.min(1, keepdims=True) + reach
                row, to = np.nonzero(goes)
                out["cell"] += [f"{c}/{j}" for j in to.tolist()]
                out["row"] += [at[i] for i in row.tolist()]
                out["home"] += (home[row] & (near[row] == to)).tolist()
                out["far"] += d[row, to].tolist()
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["cell"], pa.string()), b.column("node").take(rows), b.column("vec").take(rows), b.column("copies").take(rows), pa.array(out["home"], pa.bool_()), pa.array(out["far"], pa.float64())],
                names=["cell", "node", "vec", "copies", "home", "far"],
            )

    dealt = materialised(state.join(small_side(pivots), "cell").select("cell", "node", "vec", "copies", "home", "pivots").mapInArrow(deal, state.schema), "dealt")
    balls = small_side(materialised(dealt.where("home").groupBy("cell").agg(F.max("far").alias("radius")), "balls"))
    return dealt.join(balls, "cell").where((F.col("far") <= F.col("radius") + r + SLACK) | F.col("home")).drop("radius")


def _stars(a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each component of a boolean matrix that links rows to columns."""
    open_rows = np.flatnonzero(a.any(1))
    a = a[open_rows]
    left, out = np.ones(len(open_rows), bool), []
    fresh = np.ones(a.shape[1], bool)
    for i in range(len(open_rows)):
        if not left[i]:
            continue
        rows, columns, new = [np.array([i])], [], np.array([i])
        left[i] = False
        while len(new):
            c = np.flatnonzero(a[new].any(0) & fresh)
            fresh[c] = False
            columns.append(c)
            new = np.flatnonzero(left & a[:, c].any(1)) if len(c) else c
            left[new] = False
            rows.append(new)
        out.append((open_rows[np.concatenate(rows)], np.concatenate(columns)))
    return out


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of unit vectors have that cosine; those within rounding of it are summed exactly."""
    c = x @ y.T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-12), strict=True):
        dot, xx, yy = (fsum((p * q).tolist()) for p, q in ((x[i], y[j]), (x[i], x[i]), (y[j], y[j])))
        out[i, j] = dot / sqrt(xx * yy) >= cosine
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, fan: int = FAN, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows whose vector has at least that cosine),
    component_id (the least id reachable by links) and kept (whether it is the row's own id).

    Rows are compared only if their labels are equal and not null and their vectors have the same length.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do rows
    without a label. Repeated rows link with each other. Rows with a null id take part and keep a null id;
    ``component_id`` is null only if all ids of the component are. An empty table gives no rows. Other columns are ignored.
    """
    if not 0.5 < cosine <= 1:
        raise ValueError("a cosine above 0.5 is expected")
    spark = vectors.sparkSession
    bounded_batches(spark)
    r = sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vec"), F.col(f"`{label}`").cast("string").alias("label"))
    fit = valid(F.col("vec")) & F.col("label").isNotNull()
    distinct = rows.where(fit).groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialised(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, as written

    state = nodes.select(F.concat("label", F.lit("|"), F.size("vec")).alias("cell"), "node", "vec", "copies", F.lit(True).alias("home"), F.lit(2.0).alias("far"))
    settled, before = [], None
    ball, near = F.col("far") <= r / 2 - SLACK, F.col("far") <= 3 * r / 2 + SLACK
    home = F.col("home")
    for level in range(DEPTH + 1):
        # members of the ball, of the shell that links can reach from it, and of all but the ball; of each those that live here
        kinds = {"ball": ball, "shell": ~ball & near, "rest": ~ball}
        counts = state.groupBy("cell").agg(
            *(F.count_if(k).alias(n) for n, k in kinds.items()), *(F.count_if(k & home).alias(f"{n}_lives") for n, k in kinds.items()), F.count_if(home).alias("lives"),
            F.sum(F.when(ball, F.col("copies"))).alias("ball_copies"), F.min(F.when(ball, F.col("node"))).alias("ball_root"),
        )
        # a cell whose vectors outside the ball a split has hardly made fewer isn't split again
        if before is not None:
            counts = counts.withColumn("parent", F.regexp_replace("cell", "/[0-9]+$", "")).join(small_side(before), "parent", "left").drop("parent")
            useful = F.col("rest_lives") <= 0.9 * F.col("was")
        else:
            useful = F.lit(True)
        more = (F.col("rest_lives") > cell) & useful if level < DEPTH else F.lit(False)
        counts = materialised(counts.withColumn("more", more), "cells")
        settled.append(state.join(small_side(counts.where("NOT more AND lives > 0").drop("more", "was")), "cell"))
        crowded = counts.where("more")
        if crowded.isEmpty():
            break
        before = crowded.select(F.col("cell").alias("parent"), F.col("rest_lives").alias("was"))
        state = materialised(_split(state, crowded, r, cell, fan, level), "state")

    members = settled[0]
    for s in settled[1:]:
        members = members.unionByName(s)
    # inside the ball all is linked
    inside = members.where(ball & (F.col("ball_lives") > 0)).select("node", F.when(home, F.col("ball_copies") - F.col("copies")).otherwise(0).alias("links"), F.col("ball_root").alias("root"))
    # tiles: the ball against its shell, both ways, and all but the ball against itself
    slots = lambda n: F.ceil(F.col(n) / tile).cast("int")
    mine = lambda t: F.pmod(F.xxhash64("node", F.lit(7)), t).cast("int")
    every = lambda t: F.explode(F.sequence(F.lit(0), t - 1))
    both = None
    for number, (asks, answers) in enumerate((("ball", "shell"), ("shell", "ball"), ("rest", "rest"))):
        i, j = slots(f"{asks}_lives"), slots(answers)
        there = members.where((i > 0) & (j > 0))
        left = there.where(kinds[asks] & home).select("*", mine(i).alias("i"), every(j).alias("j"), F.lit(True).alias("asks"))
        right = there.where(kinds[answers]).select("*", every(i).alias("i"), mine(j).alias("j"), F.lit(False).alias("asks"))
        part = left.unionByName(right).select("cell", F.lit(number).alias("pair"), "i", "j", "asks", "node", "vec", "copies")
        both = part if both is None else both.unionByName(part)

    def meet(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist())
        vec = table.column("vec").combine_chunks()
        node, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        nodes, links, roots = [], [], []
        if len(a) and len(b):
            hit = linked(unit_rows(vec.take(pa.array(a))), unit_rows(vec.take(pa.array(b))), cosine)
            hit &= node[a][:, None] != node[b][None, :]
            n = hit @ copies[b]
            nodes.append(node[a][n > 0])
            links.append(n[n > 0])
            roots.append(node[a][n > 0])
            for rows_, columns in _stars(hit):
                all_ = np.unique(np.concatenate([node[a][rows_], node[b][columns]]))
                nodes.append(all_)
                links.append(np.zeros(len(all_), np.int64))
                roots.append(np.full(len(all_), all_[0]))
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"node": cat(nodes), "links": cat(links), "root": cat(roots)})

    met = materialised(both.groupBy("cell", "pair", "i", "j").applyInArrow(meet, "node bigint, links bigint, root bigint").unionByName(inside), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = materialised(connected_components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    found = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("least").alias("component"))
    found = materialised(found.join(least, "root").select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"), "found")
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n"), F.col("vec_id").alias("component"))
    out = rows.where(fit).join(found, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v"))).select("vec_id", "n", "component").unionByName(alone)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
