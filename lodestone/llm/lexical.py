"""Ranked lexical search over an inverted index in segments.

Index: a task cuts its documents into segments of bounded text. A segment numbers its documents in the
order of doc_id and keeps, for every term, its postings sorted by that number: gaps and occurrences as
variable-length integers. One row a term and segment, and one row a segment with the ids and lengths.

Search: the rows of the query terms meet by (block of items, segment). For each item the postings of its
terms are merged document by document with a heap, and the best documents stay in a bounded heap whose
order is score, then doc_id. The tasks' best are merged by item in two steps.

What can't reach the heap isn't merged: the lists of an item whose greatest contributions together stay
below the worst score of a full heap are only looked up for documents that another list brings. This drops
no document that belongs to the result.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SMALL_SIDE, bounded_batches, materialised, opened, shut, small_side

#: A-Z in lower case, and all ASCII but letters and digits as separators.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text in a segment (a longer text is a segment of its own) and items that are searched together.
SEGMENT_BYTES, ITEMS = 8 << 20, 256
#: Segments that a task ranks one after another, where there are many.
SEGMENTS = 64
#: Documents between two looks at which lists must be merged.
STEP = 1024
INDEX = "segment bigint, term string, df bigint, total bigint, postings binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length integers of ``x``: (bytes, where each ends)."""
    x = x.astype(np.uint64)
    sizes = np.ones(len(x), np.int64)
    for k in range(1, 10):
        sizes += x >> np.uint64(7 * k) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        m = sizes > k
        out[(ends - sizes)[m] + k] = (x[m] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(sizes[m] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpacked(block: bytes) -> np.ndarray:
    raw = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def _segment(number: int, rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sizes = np.fromiter((len(w) for _, w in rows), np.int64, len(rows))
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(t, len(known)) for _, w in rows for t in w), np.int64, int(sizes.sum()))
    terms = sorted(known)
    rank = np.empty(len(terms), np.int64)
    rank[[known[t] for t in terms]] = np.arange(len(terms))
    pair, tf = np.unique(rank[code] * len(rows) + np.repeat(np.arange(len(rows)), sizes), return_counts=True)
    term, doc = pair // len(rows), pair % len(rows)
    first = np.concatenate([[True], term[1:] != term[:-1]])
    gap = np.where(first, doc + 1, doc - np.concatenate([[0], doc[:-1]]))
    data, ends = packed(np.stack([gap, tf], 1).ravel())
    df = np.diff(np.append(np.flatnonzero(first), len(term)))
    edges = np.concatenate([[0], ends[2 * np.cumsum(df) - 1]])
    none = sum(d is None for d, _ in rows)
    ids = np.array([d for d, _ in rows if d is not None], np.int64)
    head = shut(np.diff(ids, prepend=np.int64(0)), sizes, np.array([none]))
    blocks = pa.array([data[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)] + [head], pa.binary())
    n = len(terms) + 1
    columns = [pa.array(np.full(n, number)), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array(np.append(df, len(rows))), pa.array([*[None] * len(terms), int(sizes.sum())], pa.int64()), blocks]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "df", "total", "postings"])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all rows that hold a term: segment, term, df (documents of the segment that hold it) and
    postings. The row of a segment without a term has its number of documents (df), of all their terms (total),
    their ids and lengths. Nothing is shuffled. Store it before use.

    Null texts hold no term. Rows with a null id are indexed and come last in the order of ids; repeated rows
    are indexed each. Texts of any length are read whole. An empty table gives an empty index.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t"))

    def build(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for d, t in zip(b.column("d").to_pylist(), b.column("t").cast(pa.binary()), strict=True):
                text = t.as_py()
                if not (words := terms_of(text)):
                    continue
                if held and size + len(text) > segment_bytes:
                    yield _segment(number, held)
                    held, size, number = [], 0, number + 1
                held.append((d, words))
                size += len(text)
        if held:
            yield _segment(number, held)

    return given.mapInArrow(build, INDEX)


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], ids: list[int | None], heap: list, k: int, lookup) -> None:
    """Merges the postings (numbers of documents, contributions) of one item into its heap of the ``k`` best
    (score, -id). ``lookup(i)`` gives list i as a mapping."""
    order = sorted((int(c.max()), i) for i, (_, c) in enumerate(lists))
    bounds = list(accumulate((most for most, _ in order), initial=0))
    floor = max((int(np.partition(c, len(c) - k)[len(c) - k]) for _, c in lists if len(c) >= k), default=0)  # k documents have that score at least
    edges = [np.searchsorted(at, np.arange(0, len(ids) + STEP, STEP)) for at, _ in lists]
    shift = max(bounds[-1].bit_length(), 1)
    low = (1 << shift) - 1
    whole = shift + len(ids).bit_length() > 62
    for step in range(len(edges[0]) - 1):
        worst = max(floor, heap[0][0]) if len(heap) == k else floor
        some = 0  # lists that are only looked up
        while some < len(order) and bounds[some + 1] < worst:
            some += 1
        merged = []
        for _, i in order[some:]:
            a, b = edges[i][step], edges[i][step + 1]
            if a < b:
                at, c = lists[i][0][a:b], lists[i][1][a:b]
                merged.append([(x << shift) + y for x, y in zip(at.tolist(), c.tolist(), strict=True)] if whole else ((at << shift) + c).tolist())
        now, score = -1, 0
        for x in heapq.merge(*merged, [len(ids) << shift]):  # one past the last document
            doc = x >> shift
            if doc == now:
                score += x & low
                continue
            if now >= 0:
                for j in range(some - 1, -1, -1):
                    if score + bounds[j + 1] < worst:
                        break
                    score += lookup(order[j][1]).get(now, 0)
                if score >= worst:
                    entry = (score, -ids[now] if ids[now] is not None else float("-inf"))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        worst = max(worst, heap[0][0])
            now, score = doc, x & low


class _Segment:
    """The postings that one block of items needs of one segment."""

    def __init__(self, head: bytes, n_docs: int, n_terms: int):
        gaps, sizes, none = opened(head)
        self.ids = np.cumsum(gaps).tolist() + [None] * int(none[0])
        if 25 * n_docs * int(sizes.max()) >> 63:
            self.m = np.array([75 + 25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
        else:
            self.m = 75 + 25 * sizes * n_docs // n_terms
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.maps: dict[tuple[int, int], dict[int, int]] = {}
        self.of: dict[int, list[tuple[int, int]]] = {}

    def add(self, weight: int, users: list[tuple[int, int]], block: bytes) -> None:
        x = unpacked(block)
        at, tf = np.cumsum(x[::2]) - 1, x[1::2]
        for q, repeats in users:
            self.of.setdefault(q, []).append((len(self.lists), repeats))
        self.lists.append((at, weight * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[at]))))

    def mapped(self, term: int, repeats: int) -> dict[int, int]:
        if (term, repeats) not in self.maps:
            at, c = self.lists[term]
            self.maps[term, repeats] = dict(zip(at.tolist(), (c * repeats).tolist(), strict=True))
        return self.maps[term, repeats]

    def rank(self, heaps: dict[int, list], k: int) -> None:
        for q, used in self.of.items():
            lists = [(self.lists[t][0], self.lists[t][1] * r) for t, r in used if self.lists[t][1].max() > 0]  # the others add nothing
            kept = [(t, r) for t, r in used if self.lists[t][1].max() > 0]
            if lists:
                best_of(lists, self.ids, heaps.setdefault(q, []), k, lambda i, kept=kept: self.mapped(*kept[i]))


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each row of ``items``: item_id, rank (from 1),
    doc_id, score; equal scores by ascending doc_id, null ids last.

    ``index``: a stored ``build_index``. With N documents that hold a term, L terms in all, n terms in a document,
    df documents that hold a term and tf occurrences in a document: a term weighs w = floor(1000 ln((2N + 2) /
    (2df + 1))), a document has m = 75 + 25nN div L, and its score sums w * (10^9 tf div (1000 tf + 12m)) over the
    item's terms, repeats included. Items without terms or matches give no rows; repeated items are answered
    each; ids of items may be null. An empty index or no items give no rows. Other columns are ignored.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("q"))
    numbered = materialised(named, "items")
    blocks = -(-max(1, numbered.count()) // ITEMS)

    def split(batches):
        for b in batches:
            q, term, n = [], [], []
            for who, t in zip(b.column("q").to_pylist(), b.column("t").cast(pa.binary()).to_pylist(), strict=True):
                count: dict[bytes, int] = {}
                for w in terms_of(t):
                    count[w] = count.get(w, 0) + 1
                q += [who] * len(count)
                term += count
                n += count.values()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["q", "term", "n"])

    asked = materialised(numbered.select("q", "t").mapInArrow(split, "q bigint, term string, n bigint"), "asked")
    small = asked.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE  # pairs of item and term
    near = F.broadcast if small else lambda df: df
    all_docs, all_terms, segments = index.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    df = index.select("term", "df").join(near(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * all_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    users = asked.join(df, "term").groupBy(block.alias("block"), "term").agg(F.first(weight).alias("w"), F.collect_list(F.struct("q", "n")).alias("users"))
    users = materialised(users, "users")
    heads = index.where("term IS NULL").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "segment", F.lit(None).cast("bigint").alias("w"), F.lit(None).cast(users.schema["users"].dataType).alias("users"), "postings")
    lists = index.where("term IS NOT NULL").join(near(users), "term").select("block", "segment", "w", "users", "postings")
    # postings are small for the work they cause, so tasks are counted in segments, not in bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments * blocks // SEGMENTS)
    met = lists.unionByName(heads).repartition(tasks, "block", "segment").sortWithinPartitions("block", "segment", "w")  # the head has a null weight and comes first

    def rank(batches):
        heaps, of, now, segment = {}, None, None, None
        task = TaskContext.get().partitionId()

        def done():
            if segment:
                segment.rank(heaps, k)

        def out():
            rows = [(q, s, None if d == float("-inf") else -d) for q, h in heaps.items() for s, d in h]
            heaps.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([task] * len(rows), pa.int32())], names=["q", "score", "doc_id", "task"])

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("block", "segment", "w", "users", "postings"))
            for group, part, w, who, data in zip(*columns, strict=True):
                if (group, part) != now:
                    done()
                    if of is not None and group != of:
                        yield out()
                    now, of = (group, part), group
                    segment = _Segment(data, all_docs, all_terms)
                else:
                    segment.add(w, [(u["q"], u["n"]) for u in who], data)
        done()
        yield out()

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = met.mapInArrow(rank, "q bigint, score bigint, doc_id bigint, task int")
    for by in (["q", F.col("task") % 64], ["q"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(small_side(numbered.select("q", "item_id")), "q").select("item_id", "rank", "doc_id", "score")
