"""Language identification with a blended-spectrum string kernel.

k(x, y) = |X & Y| / sqrt(|X| |Y|), where X and Y are the sets of character 1- to 4-grams that
occur in the lower-cased texts, hashed to a fixed number of slots. Landmark texts give the
Nystroem map x -> K_LL^(-1/2) k(L, x); ridge regression of +1/-1 targets in that space is
one-versus-rest kernel ridge regression. Landmarks, map and regression multiply to one matrix of a
weight for each slot and language, so a batch is scored by one matrix product.

A long text is scored in pieces of a fixed size, all of them, and the outputs are averaged over its
characters: marks of a whole long text would fill the slots and make all languages alike.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, held_out

SLOT_BITS = 13
ORDERS = (1, 2, 3, 4)
#: Landmarks at least, and of each language.
LANDMARKS, LANDMARKS_EACH = 128, 4
#: Training texts of one language at most (in expectation).
PER_LANGUAGE = 600
#: Characters of a piece at most, pieces of a long training text, and rows of marks that are held at a time.
PIECE, TRAIN_PIECES, BLOCK = 2048, 4, 256
UNKNOWN = "und"
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter (category L); numerals such as superscripts, fractions and Roman ones aren't."""
    return any(unicodedata.category(m[0])[0] == "L" for m in WORDLIKE.finditer(text))


def presence(text: str | None, row: np.ndarray) -> None:
    """Mark in ``row`` the slots of the text's n-grams."""
    if not text:
        return
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in ORDERS:
        if len(c) >= n:
            x = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                x = x * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
            x = (x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            row[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = 1


def presences(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << SLOT_BITS), np.float32)
    for t, row in zip(texts, out, strict=True):
        presence(t, row)
    return out


def pieces(text: str | None) -> list[str]:
    """The lower-cased text in equal pieces, each with the n-grams that start in it."""
    low = (text or "").lower()
    n = max(1, -(-len(low) // PIECE))
    at = [len(low) * i // n for i in range(n + 1)]
    return [low[a : b + max(ORDERS) - 1] if n > 1 else low for a, b in zip(at, at[1:], strict=False)]


def training_pieces(text: str | None) -> list[str]:
    """Up to TRAIN_PIECES pieces with a letter, spread over the text; without a letter the first piece."""
    every = pieces(text)
    some = [p for p in every if has_letter(p)] or every[:1]
    return [some[i * len(some) // min(TRAIN_PIECES, len(some))] for i in range(min(TRAIN_PIECES, len(some)))]


def outputs(texts: list[str | None], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Outputs of the languages for each text: the mean over its pieces that have a letter, by their characters."""
    total, chars = np.zeros((len(texts), len(bias))), np.zeros(len(texts))
    block, owner, size = [], [], []

    def score():
        r = normalised(presences(block)) @ weights + bias
        np.add.at(total, owner, r * np.array(size, float)[:, None])
        np.add.at(chars, owner, size)
        for held in (block, owner, size):
            held.clear()

    for i, text in enumerate(texts):
        for p in pieces(text):
            if has_letter(p):
                block.append(p), owner.append(i), size.append(len(p))
                if len(block) == BLOCK:
                    score()
    if block:
        score()
    return total / np.maximum(chars, 1)[:, None]


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def dense(x: np.ndarray) -> np.ndarray:
    """Presence rows, which may be packed to bits."""
    return x if x.shape[1] == 1 << SLOT_BITS else np.unpackbits(x, axis=1).astype(np.float32)


def fit(x: np.ndarray, lang: list[str], landmarks: int | None = None, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(landmark matrix, output matrix, languages) from presence rows in a fixed order.

    Landmarks are taken from each language in turn. Rare languages weigh as much as common ones.
    """
    names = sorted(set(lang))
    index = {v: k for k, v in enumerate(names)}
    y = np.array([index[v] for v in lang], np.int64)
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    turns = [rows[t] for t in range(max(map(len, by), default=0)) for rows in by if t < len(rows)]
    marks = normalised(dense(x[turns[: landmarks or max(LANDMARKS, LANDMARKS_EACH * len(names))]]))
    k_ll = (marks @ marks.T).astype(float)
    value, vector = np.linalg.eigh(k_ll)
    keep = value > 1e-6 * max(value.max(initial=0), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    weight = 1 / np.maximum(np.bincount(y, minlength=len(names)), 1)[y]
    gram, right = np.zeros((root.shape[1] + 1, root.shape[1] + 1)), np.zeros((root.shape[1] + 1, len(names)))
    for at in range(0, len(y), 1024):
        part = slice(at, at + 1024)
        seen = normalised(dense(x[part]))
        phi = np.hstack([(seen @ marks.T) @ root, np.ones((len(seen), 1))])
        target = np.where(y[part, None] == np.arange(len(names)), 1.0, -1.0)
        gram += phi.T @ (phi * weight[part, None])
        right += phi.T @ (target * weight[part, None])
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)) * len(names) / max(1, len(gram)), right)
    return marks.astype(np.float32), np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32), names


def train(docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE):
    """A model from a bounded sample of rows that aren't held out and have a language and a text.

    Rows are chosen by a hash of their id, about ``per_language`` of every language; only their
    n-gram marks (1 KB a piece) reach the driver. No such rows, as in an empty table: None. Of a very long
    text some pieces are used. Columns but doc_id, text and ``lang`` aren't read.
    """
    bounded_batches(docs.sparkSession)
    # only the columns needed, under names of their own
    rows = docs.select(F.col("doc_id"), F.col(lang).alias("l"), F.col("text")).where("l IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    counts = rows.groupBy(F.col("l").alias("l2")).agg(F.count("*").alias("n"))
    rates = counts.select("l2", (F.lit(float(per_language)) / F.col("n")).alias("rate"))
    texts = rows.join(F.broadcast(rates), F.col("l") == F.col("l2")).where("u < rate and text is not null").select("u", "doc_id", "l", "text")  # a row a language is broadcast

    def run(batches):
        for b in batches:
            parts = [(i, p) for i, t in enumerate(b.column("text").to_pylist()) for p in training_pieces(t)]
            for at in range(0, len(parts), BLOCK):
                some = parts[at : at + BLOCK]
                rows, marks = pa.array([i for i, _ in some]), presences([p for _, p in some]).astype(bool)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("u", "doc_id", "l")), pa.array([r.tobytes() for r in np.packbits(marks, axis=1)], pa.binary())], names=["u", "doc_id", "l", "x"])

    got = texts.mapInArrow(run, f"u double, doc_id {docs.schema['doc_id'].dataType.simpleString()}, l string, x binary").toPandas().sort_values(["u", "doc_id", "l", "x"])
    if not len(got):
        return None
    return fit(np.frombuffer(b"".join(got.x), np.uint8).reshape(len(got), -1), list(got.l))


def predict(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    A null text and one without a letter give ``und`` with score 0, as does a missing model. Repeated rows
    stay repeated, an empty table gives no rows, and a very long text is scored in all of its pieces.
    Of languages with equal outputs the first by name is given.
    """
    bounded_batches(docs.sparkSession)
    if model:
        marks, out, names = model
        model = marks.T @ out[:-1], out[-1], names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", lang_pred string, score double"

    def run(batches):
        for b in batches:
            texts, model = b.column("_text").to_pylist(), shared.value
            lettered = [bool(t and model and has_letter(t)) for t in texts]
            if model and texts:
                weights, bias, names = model
                r = outputs(texts, weights, bias)
                best = r.argmax(1)
                top = np.clip((r[np.arange(len(r)), best] + 1) / 2, 0, 1)
            pred = [names[best[i]] if ok else UNKNOWN for i, ok in enumerate(lettered)]
            score = [float(top[i]) if ok else 0.0 for i, ok in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
