"""Quality classifier: hashed word n-grams, logistic regression fitted with FTRL-proximal.

Tokens are runs of letters and digits (bytes from 0x80 up count as letters) and runs of other
visible characters. Features, hashed into one table of weights: token 1- and 2-grams and 1- to
3-grams of token shapes, where a shape says how a token is written (case, digits, which mark) and
whether it repeats a token just before it. Each block is scaled by its number of n-grams, so a
score is a sparse dot product that doesn't depend on a text's length.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, held_out, materialised

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+")
#: log2 of the number of weights.
BITS = 18
#: Labelled rows that training uses at most, chosen by a hash of their id, and bytes of their features.
SAMPLE, SAMPLE_BYTES = 8192, 96 << 20
#: n-grams of one text in a pass; longer texts are scored in pieces that are summed.
PIECE = 1 << 18


def shape(token: bytes) -> int:
    c = token[:1]
    if c.isalnum() or c >= b"\x80":
        if token.isdigit():
            return 1
        text = token.decode("utf-8", "replace")
        if len(text) > 1 and text.isupper():
            return 2
        return 3 if text.islower() else 4 if text[:1].isupper() and (len(text) == 1 or text[1:].islower()) else 5
    return 8 + zlib.crc32(c * min(len(token), 3)) % 1000


#: Tokens whose codes a worker remembers at most: about 20 MB.
REMEMBERED = 100_000


class Codes(dict):
    """token -> hash | shape << 32, remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[token] = zlib.crc32(token) | shape(token) << 32
        return code


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def blocks(text: bytes | None, codes: Codes):
    """(indices, scale) of each block of features, in pieces of bounded size."""
    tokens = TOKEN.findall(text or b"")
    n = len(tokens)
    for at in range(0, n, PIECE):
        lead = min(at, 3)  # tokens before this piece that its n-grams and repeats look back to
        c = np.fromiter(map(codes.__getitem__, tokens[at - lead : at + PIECE]), np.uint64)
        h, s = c & np.uint64(0xFFFFFFFF), c >> np.uint64(32)
        again = np.zeros(len(c), bool)
        again[1:] |= h[1:] == h[:-1]
        again[2:] |= h[2:] == h[:-2]
        s = s + np.uint64(4096) * again
        for k, x in ((0, h), (1, s)):
            grams = [_mix(x[lead:], 11 + k)]
            for order in range(2, 3 + k):
                y = x[order - 1 :].copy()
                for back in range(1, order):
                    y = y * np.uint64(1_000_003) + x[order - 1 - back : len(x) - back]
                grams.append(_mix(y[max(0, lead - order + 1) :], 100 * order + k))
            for g in grams:
                yield g, 1.0 / n


def features(text: bytes | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and their values."""
    found = list(blocks(text, codes))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    idx = np.concatenate([g for g, _ in found])
    val = np.concatenate([np.full(len(g), v) for g, v in found])
    keys, inverse = np.unique(idx, return_inverse=True)
    return keys, np.bincount(inverse, val)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 1.0, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader updates in the given order; both classes weigh alike."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    positive = sum(y for *_, y in rows)
    balance = {1: len(rows) / max(1, 2 * positive), 0: len(rows) / max(1, 2 * (len(rows) - positive))}

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for idx, val, y in rows:
            i, x = np.append(idx, 1 << BITS), np.append(val * SCALE, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * balance[y] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], float(w[-1])


#: Values are shares of n-grams; they are scaled up to the size of the bias's feature.
SCALE = 10.0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """A model from at most ``sample`` labelled rows that aren't held out, in the order of a hash of the id.
    Rows beyond ``sample_bytes`` of features, which very long texts can reach, are left out of the sample.

    The sample's ids are bounded, so they are broadcast; texts aren't shuffled. Rows with a null
    id or label are no training rows. Without training rows, as with empty tables, the model scores every
    text 0.5. Only the columns named here are read.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = rows.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id", "y").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        codes = Codes()
        for b in batches:
            found = [features(t, codes) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("o"), b.column("doc_id"), b.column("y"), pa.array([k.astype(np.int32).tobytes() for k, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                names=["o", "doc_id", "y", "i", "x"],
            )

    found = materialised(texts.mapInArrow(run, f"o bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, i binary, x binary"), "features")
    # one narrow row a sampled text: at most ``sample`` rows in this window
    sizes = found.select("o", "doc_id", "y", F.xxhash64("i").alias("h"), (F.octet_length("i") + F.octet_length("x")).alias("b"))
    before = sizes.withColumn("upto", F.sum("b").over(Window.orderBy("o", "doc_id", "y", "h").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= sample_bytes)
    last = before.agg(F.max(F.struct("o", "doc_id", "y", "h")).alias("last")).first().last
    kinds = f"struct<o:bigint,doc_id:{docs.schema['doc_id'].dataType.simpleString()},y:int,h:bigint>"
    some = found.where(F.struct("o", "doc_id", "y", F.xxhash64("i").alias("h")) <= F.struct(*map(F.lit, last)).cast(kinds)) if last else found.limit(0)
    got = some.toArrow()
    i, x, y = (got.column(c) for c in ("i", "x", "y"))
    order = pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("o", "doc_id", "y", "i")]).to_pylist()
    # rows are views of the collected table: the driver holds it once
    model = fit_ftrl([(np.frombuffer(i[k].as_buffer(), np.int32), np.frombuffer(x[k].as_buffer(), np.float32), y[k].as_py()) for k in order])
    del got, i, x, y
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of every whole text.
    ``names`` renames the two where ``keep`` holds such columns.

    A null text and one without tokens get the bias alone. Repeated rows stay repeated; an empty table gives
    no rows; a long text is scored whole, in pieces whose sums add up.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    source = "text" if "text" in keep else "_text"
    kept = docs.select(*keep) if source == "text" else docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + f", `{names[0]}` double"

    def run(batches):
        (w, bias), codes = shared.value, Codes()
        for b in batches:
            out = [bias + SCALE * sum(float(w[i].sum(dtype=np.float64)) * v for i, v in blocks(t, codes)) for t in b.column(source).cast(pa.binary()).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], names=[*keep, names[0]])

    return kept.mapInArrow(run, schema).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
