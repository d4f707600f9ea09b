"""Token counts kept as delta-maintained rollups.

Each batch of changes becomes signed rows (+1 for what appears, -1 for what goes), which add up
to deltas by source, language and tokenizer version. A ledger holds one folder a committed batch;
its _SUCCESS mark appears only after all of its files, so a batch counts wholly or not at all,
and committing it again changes nothing. Totals are sums over the ledger: deltas are additive, so
their order doesn't matter. Compaction folds committed batches into one base and remembers their ids.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, no_clash, remove

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LARGEST_VOCABULARY = 64 << 20
#: Fixed value: what the pattern's ``\\s`` matches. Runs of it over LONG_RUN characters are cut by hand.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_chars", "n_tokens"]


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file of byte-pair ranks in ``folder`` on the driver; executors get it by broadcast.
    ``version``, the file's name, names it in the rollup."""

    folder: str
    version: str
    pattern: str = PATTERN

    def read(self) -> bytes:
        data = Path(self.folder, f"{self.version}.tiktoken").read_bytes()
        if len(data) > LARGEST_VOCABULARY:
            raise ValueError(f"{self.version} has {len(data)} bytes; at most {LARGEST_VOCABULARY} are broadcast")
        return data


def encoder(data: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of whole texts, of any length and content.

    The pattern's engine overflows its stack on white space of about a million characters. Such runs are cut
    out as the pattern itself would cut them: all characters but the last are one piece, the last goes with
    what follows; at the end of the text the whole run is one piece.
    """

    def __init__(self, data: bytes, pattern: str = PATTERN):
        self.encode = encoder(data, pattern).encode_ordinary
        self.data, self.merge = data, None
        self.long = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")

    def piece(self, run: str) -> int:
        if self.merge is None:
            self.merge = encoder(self.data, r"(?s:.)+").encode_ordinary
        return len(self.merge(run))

    def count(self, text: str) -> int:
        total, at = 0, 0
        for m in self.long.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            total += len(self.encode(text[at : m.start()])) + self.piece(text[m.start() : stop])
            at = stop
        return total + len(self.encode(text[at:] if at else text))


def count_versions(rows: DataFrame, tokenizers: list[Tokenizer], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_chars and ``n_tokens``, an array with the tokens under each tokenizer, of every whole text, which is
    read once for all of them; a null text counts as empty.

    Repeated rows stay, an empty table gives no rows, a batch holds at most 32 MB of text or one text.
    """
    bounded_batches(rows.sparkSession)
    no_clash(keep, ("n_chars", "n_tokens"))
    shared, patterns = rows.sparkSession.sparkContext.broadcast([t.read() for t in tokenizers]), [t.pattern for t in tokenizers]
    kept = rows.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text") + ", n_chars bigint, n_tokens array<bigint>"

    def run(batches):
        counters = [Counter(data, pattern) for data, pattern in zip(shared.value, patterns, strict=True)]
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([[c.count(t) for c in counters] for t in texts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *counts], names=[*keep, "n_chars", "n_tokens"])

    return kept.mapInArrow(run, schema)


def count_tokens(rows: DataFrame, tokenizer: Tokenizer, keep: list[str], text: str = "text") -> DataFrame:
    """As ``count_versions`` for one tokenizer, with its number of tokens as ``n_tokens``."""
    return count_versions(rows, [tokenizer], keep, text).withColumn("n_tokens", F.get("n_tokens", F.lit(0)))


def signed_rows(changes: DataFrame, payload: tuple[str, ...] = ("text",)) -> DataFrame:
    """(sign, source, lang and ``payload``) of a change table.

    ``changes``: op (insert, delete, revise), source, lang and the payload after the change and old_source, old_lang and
    old_ payload before it. An insert adds the new row, a delete takes the old one away, a revision does both.
    Any other op, null included, is an error. The payload is the text, or what was counted of it.
    """
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    names = ("source", "lang", *payload)
    new = F.struct(F.lit(1).alias("sign"), *(F.col(c) for c in names))
    old = F.struct(F.lit(-1).alias("sign"), *(F.col(f"old_{c}").alias(c) for c in names))
    sides = F.when(op == "insert", F.array(new)).when(op == "delete", F.array(old)).otherwise(F.array(old, new))
    return changes.select(F.explode(sides).alias("r")).select("r.*")


def summed(counted: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """Signed totals by source, lang and tokenizer of counted rows (sign, source, lang, n_chars, n_tokens as an array).
    ``versions`` names the tokenizers in the order of the arrays, each with the sign it counts with; 0 leaves it out."""
    each = F.array(*(F.struct(F.lit(name).alias("tokenizer"), sign.alias("by"), F.get("n_tokens", F.lit(at)).alias("n")) for at, (name, sign) in enumerate(versions.items())))
    rows = counted.select("source", "lang", "sign", "n_chars", F.explode(each).alias("v")).select("source", "lang", "v.tokenizer", (F.col("sign") * F.col("v.by")).alias("sign"), "n_chars", F.col("v.n").alias("n_tokens"))
    sums = [F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")]
    return rows.groupBy(*KEYS).agg(*sums).where("n_docs <> 0 OR n_chars <> 0 OR n_tokens <> 0")


def deltas(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Signed totals by source, lang and tokenizer. Null keys form groups of their own; zero deltas go.

    Sums are formed before the shuffle, so a source with a third of all rows costs no more than another.
    An empty table gives no rows.
    """
    return summed(count_versions(rows, [tokenizer], ["sign", "source", "lang"]), {tokenizer.version: F.lit(1)})


def recounted(docs: DataFrame, old: Tokenizer, new: Tokenizer) -> DataFrame:
    """Deltas that move documents (source, lang, text) from one tokenizer version to another, as one batch:
    what ``old`` counted goes, what ``new`` counts comes. Texts are read once."""
    counted = count_versions(docs.select(F.lit(1).alias("sign"), "source", "lang", "text"), [old, new], ["sign", "source", "lang"])
    return summed(counted, {old.version: F.lit(-1), new.version: F.lit(1)})


class Ledger:
    """Committed deltas under one folder of any Hadoop file system. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _named(self, prefix: str) -> list[str]:
        """Committed folders with that prefix, by name."""
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith(prefix) and self._done(f"{self.path}/{n}"))

    def _base(self) -> tuple[str | None, DataFrame]:
        """The newest base and the ids of the batches folded into it, which stay a table."""
        bases = self._named("base-")
        if not bases:
            return None, self.spark.createDataFrame([], "batch string")
        return bases[-1], self.spark.read.schema("batch string").json(f"{self.path}/ids-{bases[-1][5:]}")

    def _open(self) -> tuple[str | None, list[str]]:
        """The newest base, and committed batches (those not yet removed) that aren't folded into it."""
        base, folded = self._base()
        here = [n[6:] for n in self._named("batch-")]
        if base and here:
            left = self.spark.createDataFrame([(n,) for n in here], "batch string").join(folded, "batch", "left_anti")
            here = sorted(r.batch for r in left.collect())
        return base, here

    def committed(self, batch: str) -> bool:
        return self._done(f"{self.path}/batch-{batch}") or not self._base()[1].where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Write the deltas of a batch; False, and nothing happens, if it is committed already.

        What an attempt that died has left is overwritten, so an attempt can be repeated at any point.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r}")
        if self.committed(batch):
            return False
        rows.select(*KEYS, *SUMS).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups without documents, characters and tokens go."""
        base, batches = self._open()
        names = [f"batch-{b}" for b in batches] + ([base] if base else [])
        schema = "source string, lang string, tokenizer string, n_docs bigint, n_chars bigint, n_tokens bigint"
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0 OR n_chars <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold what is committed into a new base. A crash at any point leaves totals as they were."""
        base, batches = self._open()
        if not batches:
            return
        no = f"{int(base[5:]) + 1 if base else 0:08d}"
        new = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        (self._base()[1].unionByName(new) if base else new).write.mode("overwrite").json(f"{self.path}/ids-{no}")
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{no}")  # from its _SUCCESS on, it counts
        for b in batches:
            remove(self.spark, f"{self.path}/batch-{b}")
