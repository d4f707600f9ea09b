"""Tensor files and their text form (S13-S15, P15, F12): binary columns to long rows and back."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_HEADER = 100 << 20
#: Item sizes of the dtypes a file may hold.
ITEM = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}


def entries(text: bytes, size: int) -> tuple[dict, dict]:
    """(tensors by name, metadata) of a header's text; ValueError if the tensors do not tile ``size`` bytes without gaps."""
    head = json.loads(text)
    if not isinstance(head, dict):
        raise ValueError("header is no object")
    found = {k: v for k, v in head.items() if k != "__metadata__"}
    whole = lambda xs: isinstance(xs, list) and all(type(x) is int and x >= 0 for x in xs)
    if not all(isinstance(t, dict) and whole(t["shape"]) and whole(t["data_offsets"]) and len(t["data_offsets"]) == 2 for t in found.values()):
        raise ValueError("shapes and offsets are lists of whole numbers")
    at = 0
    for name, t in sorted(found.items(), key=lambda kv: kv[1]["data_offsets"]):
        begin, end = t["data_offsets"]
        if begin != at or end - begin != ITEM[t["dtype"]] * int(np.prod(t["shape"], dtype=np.int64)):
            raise ValueError(f"{name} does not tile the data")
        at = end
    if at != size:
        raise ValueError("data left over")
    return found, head.get("__metadata__") or {}


def header(data: bytes) -> dict:
    """The tensors of a file by name; ValueError if they do not tile its data without gaps."""
    if len(data) < 8:
        raise ValueError("shorter than its header's length")
    n = int.from_bytes(data[:8], "little")
    if n > min(LARGEST_HEADER, len(data) - 8):
        raise ValueError("header longer than the file")
    return entries(data[8 : 8 + n], len(data) - 8 - n)[0]


def is_valid(data: bytes) -> bool:
    try:
        header(bytes(data))
    except (ValueError, KeyError, TypeError):
        return False
    return True


def tensor_rows(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, name, shape, data) of the float32 tensors of each file; a malformed file is an error."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for k, data in zip(pdf[key], pdf[content], strict=True):
                data, n = bytes(data), int.from_bytes(bytes(data[:8]), "little")
                for name, t in header(data).items():
                    if t["dtype"] != "F32":
                        raise ValueError(f"{name} is {t['dtype']}")
                    begin, end = t["data_offsets"]
                    rows.append((k, name, t["shape"], np.frombuffer(data, "<f4", (end - begin) // 4, 8 + n + begin).astype(float)))
            yield pd.DataFrame(rows, columns=[key, "name", "shape", "data"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"`{key}` {kind}, name string, shape array<int>, data array<double>")


def to_file(tensors: dict[str, np.ndarray]) -> bytes:
    """Canonical bytes: names in order, float32, header padded to 8."""
    return packed_file(tensors)


def packed_file(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    """As ``to_file``, with metadata (texts by name) before the tensors."""
    at, head, parts = 0, {"__metadata__": dict(sorted(metadata.items()))} if metadata else {}, []
    for name in sorted(tensors):
        raw = np.ascontiguousarray(tensors[name], "<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(np.shape(tensors[name])), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def write_adapter(spark: SparkSession, path: str, config: dict, tensors: dict[str, np.ndarray]) -> None:
    """An adapter directory as one row: its configuration as JSON and its tensors as one file."""
    row = [(json.dumps(config, sort_keys=True), bytearray(to_file(tensors)))]
    spark.createDataFrame(row, "config string, tensors binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_adapter(spark: SparkSession, path: str, config_schema: str) -> DataFrame:
    """(config, name, shape, data) rows of an adapter directory; a configuration that doesn't parse is an error."""
    rows = spark.read.schema("config string, tensors binary").parquet(path)
    parsed = F.from_json("config", config_schema, {"mode": "FAILFAST"})
    return tensor_rows(rows, "config", "tensors").withColumn("config", parsed)


def encoded(rows: DataFrame, values: str, data: str = "data") -> DataFrame:
    """``rows`` with ``values`` replaced by ``data``, its base64 text as little-endian float32; null stays null."""
    rest = [c for c in rows.columns if c != values]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for b in batches:
            texts = [None if v.as_py() is None else base64.b64encode(np.asarray(v.values, "<f4").tobytes()).decode() for v in b.column(values)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, data])

    return rows.select(*rest, values).mapInArrow(run, f"{kinds}, `{data}` string")


def decoded(rows: DataFrame, data: str) -> DataFrame:
    """``rows`` with the base64 texts in ``data`` as arrays of their float32 values; a text of another size is an error."""
    rest = [c for c in rows.columns if c != data]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for b in batches:
            values = [None if t is None else np.frombuffer(base64.b64decode(t, validate=True), "<f4").astype(float) for t in b.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(values, pa.list_(pa.float64()))], names=[*rest, data])

    return rows.select(*rest, data).mapInArrow(run, f"{kinds}, `{data}` array<double>")


def base64_fits(data: Column, shape: Column, item: int = 4) -> Column:
    """Whether a base64 payload has the size that its shape asks for."""
    n = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
    return F.octet_length(F.unbase64(data)) == n * item


def key_parts(name: Column) -> tuple[Column, Column, Column]:
    """(layer, module, part) of a tensor name; other names are errors."""
    ok = name.rlike(r"layers\.\d+\..*\.lora_[AB](?:\.|$)")
    checked = F.when(ok, name).otherwise(F.raise_error(F.concat(F.lit("unknown tensor "), name)))
    return F.regexp_extract(checked, r"layers\.(\d+)\.", 1).cast("int"), F.regexp_extract(checked, r"layers\.\d+\.(?:.*\.)?([^.]+)\.lora_", 1), F.regexp_extract(checked, r"lora_([AB])", 1)
