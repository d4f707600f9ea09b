"""Stupid-backoff scores of a bigram model counted over the whole corpus.

    S(w | v) = c(v, w) / c(v)     if c(v, w) >= min_count
             = alpha * c(w) / N   otherwise

Counts hold the scored texts themselves, so with a ``min_count`` of 1 nothing would ever back off: 2 asks for
another occurrence.

A text's score is the mean of ln S over its words; the first word follows a start mark. The
relations are n-gram counts, partitioned by hash, and the exploded n-grams of the texts:

1. Bigram occurrences go to the bucket of their hash. There equal bigrams meet, which gives
   c(v, w), and each occurrence is joined to it.
2. Unigram counts of frequent words (a head of bounded size) are exact and broadcast. Occurrences
   that need the count of another word, and the counts themselves, go to that word's bucket.
3. Partial sums go to the bucket of their document and are added.

All three relations travel as compressed blocks of columns, one a batch and bucket, with equal
n-grams of a batch merged: a bigram costs a few bytes and a very frequent one no more than another.
Words are identified by 63-bit hashes, which are verified: the words of each hash are compared, and words
that share one get numbers in the head. What else is in the head comes from a bounded probe and
only decides where counts are looked up, not what they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, opened, share_of, shut

ALPHA = 0.4
#: Words in the head at most (two bytes a word, one code is the start mark), and documents that the probe reads (in expectation).
HEAD, PROBE = 65_535, 4000
START = 65_535
TAIL = np.uint64(1 << 63)
#: Partial sums and lookups that a task holds before it sends them.
FLUSH = 1_000_000
#: Words sharing a hash with another word that the head has room for; more are an error.
CLASHES = 1000
#: Bytes of text for a bucket, which a task holds at once, and for a shuffle partition, at least as many as the session has.
BUCKET_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes, bits: int = 63) -> int:
    """The top bit marks a hash; with fewer than 63 bits, for tests, hashes clash."""
    return xxhash.xxh64_intdigest(word) & ((1 << bits) - 1) | 1 << 63


class Codes(dict):
    """word -> its number in the head, or its 63-bit hash with the top bit set; remembered up to a bound."""

    def __init__(self, head: dict[int | bytes, int], bits: int = 63):
        super().__init__()
        self.head, self.bits = head, bits

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = word_hash(word, self.bits)
        number = self.head.get(h)
        if number is None:
            number = self.head.get(word, h)  # words that share their hash have numbers of their own
        code = self[word] = number
        return code

    def of(self, text: bytes | None) -> np.ndarray:
        """Codes of the text's words: runs without ASCII white space, A-Z lower-cased."""
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so sorting by hash sorts by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray):
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    return ((int(bucket[a]), int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False))


def _split(codes: np.ndarray) -> list[np.ndarray]:
    """Head codes in two bytes, others in eight, and which are which."""
    tail = codes >= TAIL
    return [np.packbits(tail), codes[~tail].astype(np.uint16), codes[tail]]


def _joined(flags: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    n = len(head) + len(tail)
    is_tail = np.unpackbits(flags, count=n).astype(bool)
    out = np.empty(n, np.uint64)
    out[~is_tail], out[is_tail] = head, tail
    return out


def bigram_blocks(ids: list[int], codes: list[np.ndarray], buckets: int):
    """(bucket, block) for each bucket that the texts' bigrams reach."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    ids, codes = np.array(ids, np.int64)[order], [codes[i] for i in order.tolist()]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    w = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    if not len(w):
        return
    v = np.concatenate([np.array([START], np.uint64), w[:-1]])
    v[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    doc = np.repeat(np.arange(len(ids)), sizes)
    h = _mixed(_mixed(v) + w)
    by = np.argsort(h, kind="stable")
    v, w, doc, h = v[by], w[by], doc[by], h[by]
    for bucket, a, b in _slices(_bucket(h, buckets)):
        new = np.flatnonzero(np.concatenate([[True], (v[a + 1 : b] != v[a : b - 1]) | (w[a + 1 : b] != w[a : b - 1])]))
        here, local = np.unique(doc[a:b], return_inverse=True)
        yield bucket, shut(*_split(v[a:b][new]), *_split(w[a:b][new]), np.diff(np.append(new, b - a)).astype(np.uint32), local.astype(np.uint16 if len(here) < 65536 else np.uint32), np.diff(ids[here], prepend=0))


class Sums:
    """Sums of values by document, sent as blocks to the documents' buckets."""

    def __init__(self, buckets: int, flush: int = FLUSH):
        self.buckets, self.flush, self.parts, self.size = buckets, flush, [], 0

    def add(self, ids: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        if len(ids):
            self.parts.append((ids, values, n))
            self.size += len(ids)

    def full(self):
        """The blocks to send now: none while sums fit. What was sent starts anew; sums are added up later."""
        if self.size > self.flush:
            yield from self.blocks()
            self.parts, self.size = [], 0

    def merged(self):
        ids, values, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        keys, inverse = np.unique(ids, return_inverse=True)
        return keys, np.bincount(inverse, values, len(keys)), np.bincount(inverse, n, len(keys)).astype(np.int64)

    def blocks(self):
        ids, values, n = self.merged()
        h = _mixed(ids.view(np.uint64))
        by = np.argsort(_bucket(h, self.buckets), kind="stable")  # ids stay sorted inside
        ids, values, n, h = ids[by], values[by], n[by], h[by]
        for bucket, a, b in _slices(_bucket(h, self.buckets)):
            yield bucket, 0, shut(np.diff(ids[a:b], prepend=0), values[a:b], n[a:b])


class Lookups:
    """Words outside the head: occurrences that need a count (sign +1 or -1), and counts (sign 0)."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, words: np.ndarray, ids: np.ndarray, sign: int, count: np.ndarray) -> None:
        if len(words):
            self.parts.append((words, ids, np.full(len(words), sign, np.int8), count.astype(np.uint64)))
            self.size += len(words)

    def blocks(self):
        if not self.parts:
            return
        words, ids, sign, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        h = _mixed(words)
        by = np.lexsort((ids, h))
        words, ids, sign, count, h = words[by], ids[by], sign[by], count[by], h[by]
        for bucket, a, b in _slices(_bucket(h, self.buckets)):
            new = np.flatnonzero(np.concatenate([[True], words[a + 1 : b] != words[a : b - 1]]))
            yield bucket, 1, shut(words[a:b][new], np.diff(np.append(new, b - a)).astype(np.uint32), np.diff(ids[a:b], prepend=0), sign[a:b], count[a:b])


def _meet_bigrams(blocks: list[bytes], sums: Sums, lookups: Lookups, logs: np.ndarray, total: int, alpha: float, min_count: int) -> None:
    """Count the bigrams of one bucket and join the counts to their occurrences."""
    vs, ws, sizes, docs = [], [], [], []
    for block in blocks:
        c = opened(block)
        vs.append(_joined(*c[:3]))
        ws.append(_joined(*c[3:6]))
        sizes.append(c[6].astype(np.int64))
        docs.append(np.cumsum(c[8])[c[7]])
    v, w, size, doc = (np.concatenate(x) for x in (vs, ws, sizes, docs))
    by = np.lexsort((w, v))
    new = np.concatenate([[True], (v[by][1:] != v[by][:-1]) | (w[by][1:] != w[by][:-1])])
    group = np.empty(len(v), np.int64)
    group[by] = np.cumsum(new) - 1
    c = np.bincount(group, size).astype(np.int64)[group]
    seen, v_tail, w_tail = c >= min_count, v >= TAIL, w >= TAIL
    at_v, at_w = np.where(v_tail, 0, v).astype(np.int64), np.where(w_tail, 0, w).astype(np.int64)
    value = np.where(seen, np.log(c) - np.where(v_tail, 0.0, logs[at_v]), np.log(alpha) - np.log(total) + np.where(w_tail, 0.0, logs[at_w]))
    sums.add(*sums_by(doc, np.repeat(value, size), np.ones(len(doc), np.int64)))
    counted = w_tail & seen
    if counted.any():
        words, inverse = np.unique(w[counted], return_inverse=True)
        lookups.add(words, np.zeros(len(words), np.int64), 0, np.bincount(inverse, size[counted]))
    for mask, words, sign, counts in ((w_tail & ~seen, w, 1, 1), (v_tail & seen, v, -1, 0)):
        each = np.repeat(mask, size)
        if each.any():
            lookups.add(np.repeat(words, size)[each], doc[each], sign, np.full(int(each.sum()), counts))


def sums_by(ids: np.ndarray, values: np.ndarray, n: np.ndarray):
    keys, inverse = np.unique(ids, return_inverse=True)
    return keys, np.bincount(inverse, values), np.bincount(inverse, n).astype(np.int64)


def _meet_words(blocks: list[bytes], sums: Sums) -> None:
    """Count the words of one bucket and join the counts to the occurrences that asked."""
    cols = [opened(b) for b in blocks]
    words = np.concatenate([np.repeat(c[0], c[1]) for c in cols])
    ids = np.concatenate([np.cumsum(c[2]) for c in cols])
    sign, count = np.concatenate([c[3] for c in cols]), np.concatenate([c[4] for c in cols])
    _, inverse = np.unique(words, return_inverse=True)
    logs = np.log(np.bincount(inverse, count))[inverse] * sign
    ask = sign != 0
    sums.add(*sums_by(ids[ask], logs[ask], np.zeros(int(ask.sum()), np.int64)))


def _grouped(batches, handle):
    """handle(key, blocks) for each key of a sorted stream of (key, block) batches; yields what it yields."""
    now, held = None, []
    for b in batches:
        for k, v in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if k != now and held:
                yield from handle(now, held)
                held = []
            now = k
            held.append(v)
    if held:
        yield from handle(now, held)


def _rows(out, names=("bucket", "kind", "block")):
    out = list(out)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=list(names))


def head_words(docs: DataFrame, size: int = HEAD, bits: int = 63) -> list[int]:
    """Hashes of the commonest words of a probe of the documents."""
    probe = docs.where(share_of(F.xxhash64("doc_id", "text"), PROBE, docs.count()))

    def run(batches):
        codes = Codes({}, bits)
        for b in batches:
            k, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(codes.of, b.column("text").cast(pa.binary()).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["k", "c"])

    counts = probe.select("text").mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))
    return [x.k % (1 << 64) for x in counts.orderBy(F.desc("c"), "k").limit(size).collect()]


def clashing_words(docs: DataFrame, bits: int = 63) -> list[bytes]:
    """Words of the documents that share their hash with another word."""

    def run(batches):
        codes, sent = Codes({}, bits), set()
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                codes.of(t)
            new = [(w, h) for w, h in codes.items() if w not in sent]
            sent.update(w for w, _ in new)
            if len(sent) >= 500_000:
                sent.clear(), codes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.array([h for _, h in new], np.uint64).view(np.int64)), pa.array([w for w, _ in new], pa.binary())], names=["h", "word"])

    words = docs.select("text").mapInArrow(run, "h bigint, word binary")
    # first one number a hash: of two words under one hash, least and greatest differ
    shared = words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").select("h")
    shared = [x.h for x in shared.limit(CLASHES + 1).collect()]
    if not shared:
        return []
    found = words.where(F.col("h").isin(shared)).select("word").distinct().limit(CLASHES + 1).collect()
    if len(found) > CLASHES or len(shared) > CLASHES:
        raise ValueError(f"over {CLASHES} words share their hash with another")
    return sorted(bytes(x.word) for x in found)


def head_counts(docs: DataFrame, head: dict[int | bytes, int], bits: int = 63) -> tuple[np.ndarray, int]:
    """Exact counts over all documents: by number in the head (the start mark: texts with words), and of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        codes, counts, total = Codes(shared.value, bits), np.zeros(HEAD + 1, np.int64), 0
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                c = codes.of(t)
                total += len(c)
                counts[START] += len(c) > 0
                counts += np.bincount(c[c < TAIL].astype(np.int64), minlength=HEAD + 1)
        i = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(counts[i], total), pa.int64())], names=["i", "c"])

    out, total = np.zeros(HEAD + 1, np.int64), 0
    for x in docs.select("text").mapInArrow(run, "i int, c bigint").groupBy("i").agg(F.sum("c").alias("c")).collect():  # at most HEAD + 2 rows
        if x.i < 0:
            total = x.c
        else:
            out[x.i] = x.c
    return out, total


def unused_id(docs: DataFrame, least: int | None, greatest: int | None) -> int:
    """A number that stands for null ids and is no id of ``docs``: one beside the ids, or the first one between them."""
    if least is None or least > -(1 << 63):
        return -(1 << 63)
    if greatest < (1 << 63) - 1:
        return (1 << 63) - 1
    i = 0
    while not docs.where(F.col("doc_id") == i).isEmpty():
        i += 1
    return i


def scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = 1, head: int = HEAD, buckets_a_partition: int = 8, hash_bits: int = 63, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_words and score (mean ln S) for every row of ``docs``; counts are over all of ``docs``.

    Rows with one id are scored as one document, and each of them carries its result. Rows with a
    null id and texts without words have a null score and n_words 0, but their words count. Other
    columns are ignored. An empty table gives no rows. Very long texts are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("doc_id"), F.max("doc_id")).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size[0] // PARTITION_BYTES)
    buckets, words_buckets = max(buckets_a_partition * partitions, size[0] // BUCKET_BYTES), 2 * partitions
    no_id = unused_id(docs, size[1], size[2])
    numbers = {w: i for i, w in enumerate(clashing_words(docs, hash_bits))}
    clashing = {word_hash(w, hash_bits) for w in numbers}
    common = [h for h in head_words(docs, head, hash_bits) if h not in clashing]
    numbers |= {h: i for i, h in enumerate(common[: HEAD - len(numbers)], len(numbers))}
    counts, total = head_counts(docs, numbers, hash_bits)
    shared = spark.sparkContext.broadcast((numbers, np.log(np.maximum(counts, 1)), total))

    def send(batches):
        codes = Codes(shared.value[0], hash_bits)
        for b in batches:
            ids = [no_id if i is None else i for i in b.column("doc_id").to_pylist()]
            found = bigram_blocks(ids, list(map(codes.of, b.column("text").cast(pa.binary()).to_pylist())), buckets)
            yield _rows((k, 0, v) for k, v in found)

    def meet(batches):
        _, logs, total = shared.value
        sums, lookups = Sums(words_buckets, flush), Lookups(words_buckets)

        def handle(_, blocks):
            _meet_bigrams(blocks, sums, lookups, logs, total, alpha, min_count)
            if lookups.size > flush:
                yield _rows(lookups.blocks())
            yield _rows(sums.full())

        yield from _grouped(batches, handle)
        yield _rows(lookups.blocks())
        yield _rows(sums.blocks())

    def look_up(batches):
        sums = Sums(words_buckets, flush)

        def handle(key, blocks):
            if key % 2:
                _meet_words(blocks, sums)
            else:
                for b in blocks:
                    ids, values, n = opened(b)
                    sums.add(np.cumsum(ids), values, n.astype(np.int64))
                    yield _rows(sums.full())
            yield _rows(sums.full())

        yield from _grouped(batches, handle)
        yield _rows(sums.blocks())

    def add_up(batches):
        def handle(_, blocks):
            sums = Sums(1)
            for b in blocks:
                ids, values, n = opened(b)
                sums.add(np.cumsum(ids), values, n.astype(np.int64))
            ids, values, n = sums.merged()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(values / np.maximum(n, 1))], names=["id", "n", "s"])

        yield from _grouped(batches, handle)

    kinds = "bucket int, kind int, block binary"
    sent = docs.mapInArrow(send, kinds).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    met = sent.mapInArrow(meet, kinds).withColumn("bucket", F.col("bucket") * 2 + F.col("kind"))
    looked = met.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(look_up, kinds)
    added = looked.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "id bigint, n bigint, s double")
    joined = docs.select("doc_id").join(added, (F.col("doc_id") == F.col("id")) & (F.col("id") != no_id), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_words"), F.col("s").alias("score"))
