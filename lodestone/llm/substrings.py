"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the least hash of its m-word grams, and
consecutive windows with one minimiser travel together as one packed string to the minimiser's
bucket, so equal windows always meet. In the bucket words become numbers, windows are sorted
and runs of equal windows, compared word by word, give the least document of each.

Before the shuffle, equal packed strings of a batch become one string with a list of places, and
all strings that go to one bucket travel as one compressed block. Minimisers that a bounded
probe of the input finds hot don't pull all their windows into one bucket: their windows are split
by a second key of the window, its greatest gram hash. Which minimisers are split changes where
windows meet, never whether they do, because the key depends on the window's words alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, materialised, opened, share_of, shut

WIDTH, GRAM = 13, 3
#: Buckets a shuffle partition at least, and bytes of text for each bucket and each partition; a bucket is
#: what a task holds in memory at once.
BUCKETS_A_PARTITION, BUCKET_BYTES, PARTITION_BYTES = 8, 4 << 20, 64 << 20
#: Documents that the probe for hot minimisers reads at most (in expectation), and a minimiser's share that is hot.
PROBE, HOT_SHARE = 2000, 1 / 2000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n consecutive entries, by doubling."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


def window_keys(words: list[bytes], width: int, gram: int, hot: np.ndarray) -> np.ndarray:
    """The bucket key of each window: its minimiser, or minimiser and greatest gram if that is hot."""
    h = _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    grams = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams = grams * np.uint64(1_000_003) + h[k : len(h) - gram + 1 + k]
    grams = _mixed(grams)
    least = _sliding(grams, width - gram + 1, np.minimum)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        split = hot[at] == least
        if split.any():
            greatest = _sliding(grams, width - gram + 1, np.maximum)
            least = np.where(split, _mixed(least + greatest * ODD), least)
    return least


def super_kmers(words: list[bytes], width: int, gram: int, hot: np.ndarray):
    """(keys, starts, window counts) of the runs of windows with one key."""
    keys = window_keys(words, width, gram, hot)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], starts, np.diff(np.append(starts, len(keys)))


def hot_minimisers(docs: DataFrame, n: int, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Minimisers with over HOT_SHARE of the super-k-mers of a probe of the ``n`` documents; at most 1 / HOT_SHARE of them.

    The probe only plans the layout: any set, also an empty one, gives the same result.
    """
    if not n:
        return np.zeros(0, np.uint64)
    probe = docs.where(share_of(F.xxhash64("doc_id"), PROBE, n))

    def run(batches):
        for b in batches:
            keys = [super_kmers(w, width, gram, np.zeros(0, np.uint64))[0] for t in b.column("text").cast(pa.binary()).to_pylist() if t and len(w := t.split()) >= width]
            k, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["k", "c"])

    counts = probe.select("text").mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    most = counts.where(F.col("c") > max(8.0, total * HOT_SHARE)).orderBy(F.desc("c"), "k").limit(int(1 / HOT_SHARE)).collect()
    return np.sort(np.array([x.k for x in most], np.int64).view(np.uint64))


def _packed(rows, buckets: int, width: int, gram: int, hot: np.ndarray, level: int = 6):
    """(bucket, block) for each bucket that the (doc_id, text_key, words) of ``rows`` reach."""
    keys, docs, texts, starts, strings = [], [], [], [], []
    for doc, text_key, words in rows:
        k, at, n = super_kmers(words, width, gram, hot)
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        strings += [flat[a:b] for a, b in zip(begins[at].tolist(), ends[at + n + width - 2].tolist(), strict=True)]
        keys.append(k)
        starts.append(at)
        docs.append(np.full(len(k), doc, np.int64))
        texts.append(np.full(len(k), text_key, np.int64))
    if not keys:
        return
    bucket = (np.concatenate(keys) % np.uint64(buckets)).astype(np.int64)
    docs, texts, starts = np.concatenate(docs), np.concatenate(texts), np.concatenate(starts).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    for a, b in zip(edges, edges[1:], strict=False):
        here, known = order[a:b], {}
        which = np.fromiter((known.setdefault(strings[i], len(known)) for i in here.tolist()), np.int32, b - a)
        text = np.frombuffer(b"\n".join(known), np.uint8)
        yield int(bucket[here[0]]), shut(np.diff(docs[here], prepend=0), texts[here], starts[here], np.diff(which, prepend=np.int32(0)), text, level=level)


def _unpacked(block: bytes):
    docs, texts, starts, which, text = opened(block)
    return np.cumsum(docs), texts, starts, np.cumsum(which), text.tobytes().split(b"\n")


def repeated_windows(strings: list[bytes], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct packed strings with their least documents: (edges, owner), where the windows of
    string i have the entries edges[i]:edges[i+1] of owner, the least document that starts the window."""
    split = [s.split(b" ") for s in strings]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for s in split for w in s]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    ends = np.cumsum(sizes)
    windows = sizes - width + 1
    edges = np.concatenate([[0], np.cumsum(windows)])
    begin = np.arange(edges[-1]) + np.repeat(ends - sizes - edges[:-1], windows)
    code = np.random.default_rng(1).integers(0, 1 << 63, len(number), np.int64).astype(np.uint64)[ids]
    h = np.zeros(len(begin), np.uint64)
    for k in range(width):
        h = h * ODD + code[begin + k]
    owner = np.repeat(first, windows)
    order = np.lexsort((owner, h))
    b = begin[order]
    same = h[order][1:] == h[order][:-1]
    alike = same.copy()
    for k in range(width):  # word by word
        alike[same] &= ids[b[1:][same] + k] == ids[b[:-1][same] + k]
    if (alike != same).any():  # different windows share a hash: sort those by their words
        table = ids[begin[:, None] + np.arange(width)]
        order = np.lexsort((owner, *table.T[::-1]))
        alike = (table[order][1:] == table[order][:-1]).all(1)
    group = np.concatenate([[0], np.cumsum(~alike)]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    least = owner[order][np.concatenate([[True], ~alike])] if len(order) else owner
    out = np.empty_like(owner)
    out[order] = least[group]
    return edges, out


def _bucket_runs(blocks: list[bytes], width: int):
    """Runs of windows that an earlier document starts too: (doc_id, text_key, start, count)."""
    parts, known = [], {}
    for block in blocks:
        docs, texts, starts, which, strings = _unpacked(block)
        number = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
        parts.append((docs, texts, starts, number[which]))
    docs, texts, starts, which = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    edges, owner = repeated_windows(list(known), first, width)
    # only strings with a window that some place must give up go on
    counts = np.diff(edges)
    least = np.minimum.reduceat(owner, edges[:-1])
    place = np.flatnonzero(docs > least[which])
    for at in range(0, len(place), 50_000):
        p = place[at : at + 50_000]
        n = counts[which[p]]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        late = owner[np.repeat(edges[which[p]], n) + offset] < np.repeat(docs[p], n)
        begins = late & np.concatenate([[True], ~late[:-1] | (offset[1:] == 0)])
        run = np.cumsum(begins)[late] - 1
        head = np.flatnonzero(begins)
        who = np.repeat(p, n)[head]
        yield docs[who], texts[who], (starts[who] + offset[head]).astype(np.int32), np.bincount(run, minlength=len(head)).astype(np.int32)


def repeated_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, count): runs of windows whose words a document with a smaller id starts too.

    ``docs``: doc_id, text_key, text. Rows with a null id own nothing and lose nothing.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.bytes // PARTITION_BYTES)
    buckets = buckets or max(BUCKETS_A_PARTITION * partitions, size.bytes // BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(hot_minimisers(docs, size.n, width, gram))

    def send(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            rows = ((d, k, w) for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), texts, strict=True) if len(w := t.split()) >= width)
            out = list(_packed(rows, buckets, width, gram, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["bucket", "block"])

    def meet(batches):
        now, held = None, []
        for b in batches:
            for k, v in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                if k != now and held:
                    yield from found(held)
                    held = []
                now = k
                held.append(v)
        if held:
            yield from found(held)

    def found(blocks):
        for d, t, s, c in _bucket_runs(blocks, width):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, t, s, c)], names=["doc_id", "text_key", "start", "count"])

    packed = docs.select("doc_id", "text_key", "text").mapInArrow(send, "bucket int, block binary")
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id bigint, text_key bigint, start int, count int")


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, text (the kept words) and
    removed (spans of words, [start, end) from 0).

    Words are runs without ASCII white space; a null text has none. A word goes if it lies in a
    window that also starts in a document with a smaller id, judged on the input. A row with a
    null id loses nothing. Rows that repeat an id lose the same words for the same text, and don't
    count against each other. Other columns are ignored. An empty table gives no rows. Very long texts
    are read whole.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # the text's hash travels only if some id has several texts
    several = keyed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b")
    if several.isEmpty():
        keyed = keyed.withColumn("text_key", F.lit(0).cast("bigint"))
    runs = materialised(repeated_runs(keyed, width, gram, buckets), "runs")
    spans = runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    joined = keyed.join(spans.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def cut(batches):
        for b in batches:
            rows = []
            for t, runs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                words, spans = (t or b"").split(), []
                for s, n in sorted((r["start"], r["start"] + r["count"] + width - 1) for r in runs or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], n)
                    else:
                        spans.append([s, n])
                kept, at = [], 0
                for s, n in spans:
                    kept += words[at:s]
                    at = n
                text = b" ".join(kept + words[at:])
                rows.append((len(words), sum(n - s for s, n in spans), hashlib.sha256(text).hexdigest(), text, spans))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "removed"],
            )

    return joined.select("doc_id", "text", "runs").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, removed array<array<int>>")
