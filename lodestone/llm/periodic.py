"""Periodic runs of words in linear time, and texts without their repetitions.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run of at
least two periods has a root whose longest Lyndon word is one period long, in the order of the words
or in the reversed order (for reference: Ellert and Fischer, "Linear Time Runs over General Ordered
Alphabets", ICALP 2021). So the Lyndon array of each order gives all candidates: position j, the next
smaller suffix i, the period i - j, and how far the two suffixes agree.

Suffixes are compared by words alone. The furthest agreement found so far says that a stretch repeats
an earlier one, so a comparison inside it is looked up from the earlier place and goes on only past
the end of the stretch. There are no suffix structures, and words are ranked by sorting, not hashed.

A word that occurs once in a stretch lies in no run of that stretch, since every word of a run recurs
one period away. Texts are cut at such words first, again and again, which leaves little of a text
that has no runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches

#: Shortest run, in words, and words that are cut together.
LEAST, TOGETHER = 12, 1 << 16
#: Rounds of cutting at most; what they leave is searched.
CUTS = 12


def next_smaller(s: list[int]) -> tuple[list[int], list[int], int]:
    """(next, agree, compared) of the suffixes of ``s``: where the next smaller suffix starts (or the
    length), the length of its common prefix with the suffix, and the comparisons of letters made."""
    n = len(s)
    after, before = [n] * n, [-1] * n
    agree, behind = [0] * n, [0] * n
    left = right = end = compared = 0  # s[right:end] repeats what starts at left
    for i in range(1, n):
        j, k, x = i - 1, -1, 0
        while j >= 0:
            known = 0
            if k >= 0:  # k lies between, and its agreement with j is known
                m = behind[k]
                if x > m:
                    before[i], behind[i] = j, m
                    break
                if x < m:
                    after[j], agree[j] = i, x
                    j, k = before[j], j
                    continue
                known = x
            x = known
            exact = False
            if j >= right and i + x < end:
                a, b = j - right + left, i - right + left
                seen = agree[a] if after[a] == b else behind[b] if before[b] == a else -1
                if seen >= 0:
                    exact = i + seen < end
                    x = seen if exact else end - i
            if not exact:
                at = x
                while i + x < n and s[j + x] == s[i + x]:
                    x += 1
                compared += x - at + 1
                if i + x > end:
                    left, right, end = j, i, i + x
            if i + x < n and s[j + x] < s[i + x]:
                before[i], behind[i] = j, x
                break
            after[j], agree[j] = i, x
            j, k = before[j], j
    return after, agree, compared


def runs_of(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` letters and two periods, in that order."""
    found = set()
    for letters in (s, [-x for x in s]):
        after, agree, _ = next_smaller(letters)
        reach = [-1] * len(s)  # agreement to the left of a root with its next smaller suffix, up to a period
        low = high = first = 0  # s[first:low] is what ends before high
        for j in range(len(s) - 1, -1, -1):
            i = after[j]
            p, right = i - j, agree[j]
            if not right or right + 2 * p <= least:  # the first root of a run has less than a period to its left
                continue
            x = 0
            if first < j and i <= low:
                j2 = j + high - low
                if after[j2] == i + high - low and (y := reach[j2]) >= 0:
                    x = y if j - y > first else min(p, j - first)
            while x < p and j - x > 0 and s[j - 1 - x] == s[i - 1 - x]:
                x += 1
            reach[j] = x
            if j - x < first or not high:
                low, high, first = j, i, j - x
            if x < p <= x + right and p + x + right >= least:
                found.add((j - x, p + x + right, p))
    return sorted(found)


def recurring(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [a, b) of the concatenated texts in which every word recurs; ``owner`` numbers the texts."""
    at, part = np.arange(len(words)), owner.astype(np.int64)
    for _ in range(CUTS):
        if not len(at):
            return []
        _, which, n = np.unique(part * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        stays = n[which] > 1
        done = stays.all()
        at, part = at[stays], part[stays]
        if not len(at):
            return []
        part = np.cumsum(np.concatenate([[0], (np.diff(at) > 1) | (np.diff(part) != 0)]))
        long = np.bincount(part)[part] >= least
        done = done and long.all()
        at, part = at[long], part[long]
        if done:
            break
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else []
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return out
    flat = pa.array([w for words in texts for w in words], pa.binary())
    rank = np.asarray(pc.rank(flat, tiebreaker="dense"), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    for a, b in recurring(rank, owner, least):
        k = int(owner[a])
        base = a - int(begin[k])
        out[k] += [(base + start, n, p) for start, n, p in runs_of(rank[a:b].tolist(), least)]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n, p in runs:
        edge[start + p] += 1
        edge[start + n] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def collapse_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """``keep`` columns plus ``n_words``, ``runs`` (start, length, period by start and period) and
    ``collapsed``, the words that no run contains after its first period, for every row of ``docs``.

    Words are runs without ASCII white space, compared as they are. Null and empty texts have no words, no
    runs and an empty ``collapsed``. Texts are read whole, however long, in one task each; repeated rows are
    judged alike and apart; ids may be null; an empty table gives no rows. Other columns are ignored, and
    the kept ones may have any name but those of the three results.
    """
    if clash := {"n_words", "runs", "collapsed"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{text}`").alias("t"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for b in batches:
            sizes, runs, texts, held = [], [], [], []

            def flush():
                for words, found in zip(held, text_runs(held, least), strict=True):  # noqa: B023
                    sizes.append(len(words))  # noqa: B023
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])  # noqa: B023
                    texts.append(_collapsed(words, found))  # noqa: B023
                held.clear()  # noqa: B023

            count = 0
            for t in b.column("t").cast(pa.binary()):
                held.append((t.as_py() or b"").split())
                count += len(held[-1])
                if count >= TOGETHER:
                    flush()
                    count = 0
            flush()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(runs, run), pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    schema = f"{kinds + ', ' if kinds else ''}n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return given.mapInArrow(search, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def with_loops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (its id and text) with loops planted by a rule of the id: of every tenth document with words
    (h = crc32 of the id as text, h % 10 = 0, g = h // 10) each word i >= a = g % n becomes word a + (i - a) % p,
    where p = 1 + (n - a) // (3 + g % 8), and the words are joined by spaces. Rows with a null id stay as they are."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")).alias("h"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def plant(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for k, h in enumerate(b.column("h").to_pylist()):
                if h is not None and h % 10 == 0 and texts[k] and (words := texts[k].split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    loop = words[a : a + p]
                    texts[k] = b" ".join(words[:a] + (loop * ((n - a) // p + 1))[: n - a])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(plant, fields)
