"""Tensor files on disk as a Spark source, and adapter folders.

``spark.read.format("tensors").load(folder)`` gives a row a tensor. A task reads a file's header first (its first
bytes), drops the tensors that the query's filters on path, name, layer, module, part or dtype rule out, and then
reads the byte ranges of the others. Large files are dealt to several tasks by where their tensors begin; small
ones share a task. Files are opened by Arrow's file systems, so local paths and those of hdfs, s3 and gs work.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodestone.sources.tensors import ITEM, LARGEST_HEADER, entries, packed_file

SCHEMA = "path string, name string, dtype string, shape array<bigint>, layer int, module string, part string, config string, data array<double>"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("layer", pa.int32()), ("module", pa.string()), ("part", pa.string()), ("config", pa.string()), ("data", pa.list_(pa.float64()))])
#: Names of tensors in both conventions, and of an adapter folder's files.
KEY = r"(?:^|\.)layers\.(\d+)\.(?:.*\.)?([A-Za-z0-9_]+)\.(lora_[AB])\.weight$"
PREFIX, SEGMENT = "base_model.model.model", "self_attn"
CONFIG_FILE, TENSOR_FILE = "adapter_config.json", "adapter_model.safetensors"
#: Bytes of files for a task.
SLICE_BYTES = 64 << 20
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def opened(path: str) -> tuple[afs.FileSystem, str]:
    if "://" in path:
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path.removeprefix("file:")


def values(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":  # the upper half of a float
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32).astype(float)
    return np.frombuffer(raw, KINDS[dtype]).astype(float)


@dataclass
class Slice(InputPartition):
    """Files, each with which of how many equal slices of its bytes is meant."""

    files: list[tuple[str, int, int]]


COMPARE = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


class TensorReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.slice_bytes = int(options.get("slice_bytes", SLICE_BYTES))
        self.want_data = options.get("data", "true").lower() != "false"
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in ("path", "name", "layer", "module", "part", "dtype"):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        system, root = opened(self.root)
        found = system.get_file_info(afs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(".safetensors") and not i.base_name.startswith("."))
        out, held, size = [], [], 0
        for path, n in files:
            pieces = max(1, -(-n // self.slice_bytes))
            if pieces > 1:
                out += [Slice([(path, k, pieces)]) for k in range(pieces)]
                continue
            if held and size + n > self.slice_bytes:
                out.append(Slice(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += n
        return out + ([Slice(held)] if held else [])

    def passes(self, row: dict) -> bool:
        return all(row[f.attribute[0]] is not None and COMPARE[type(f)](row[f.attribute[0]], f.value) for f in self.kept)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for path, k, pieces in partition.files:
            with system.open_input_file(path) as f:
                whole = f.size()
                n = int.from_bytes(f.read_at(8, 0), "little")
                if not 0 < n <= min(LARGEST_HEADER, whole - 8):
                    raise ValueError(f"{path}: header longer than the file")
                found, meta = entries(f.read_at(n, 8), whole - 8 - n)
                for name, t in found.items():
                    begin, end = t["data_offsets"]
                    if (8 + n + begin) * pieces // whole != k and not (begin == end and 8 + n + begin == whole and k == pieces - 1):
                        continue
                    m = re.search(KEY, name)
                    row = {"path": path, "name": name, "dtype": t["dtype"], "shape": t["shape"], "layer": int(m[1]) if m else None, "module": m[2] if m else None, "part": m[3] if m else None, "config": meta.get("adapter_config")}
                    if self.passes(row):
                        row["data"] = values(f.read_at(end - begin, 8 + n + begin), t["dtype"]) if self.want_data else None
                        yield pa.RecordBatch.from_pylist([row], ARROW)


class TensorFiles(DataSource):
    """Options: path, slice_bytes, data (``false`` reads headers only)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)


def read_tensors(spark: SparkSession, root: str, **options) -> DataFrame:
    """The tensors below a folder. A file whose header is malformed, or whose tensors don't tile its data, is an error.
    Hidden files are skipped; null layer, module and part mark names of neither convention."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFiles)
    return spark.read.format("tensors").options(**options).load(root)


def write_adapters(tensors: DataFrame, configs: DataFrame, root: str) -> DataFrame:
    """Adapter folders below ``root``: a configuration and a float32 tensor file that holds it too. Gives a row a folder
    (folder, n_tensors, num_bytes, sha256) when it is run.

    ``tensors``: folder, name, shape, data; ``configs``: folder, config (JSON text). A task writes one folder at a time,
    each file under a hidden name first; the configuration comes last, and folders without one don't count. Running
    it again writes the same bytes.
    """
    import hashlib

    def write(key: tuple, rows: pd.DataFrame, config: pd.DataFrame) -> pd.DataFrame:
        if len(config) != 1 or rows["name"].duplicated().any():
            raise ValueError(f"{key[0]}: one configuration and one tensor a name are needed")
        text = config["config"].iloc[0]
        blob = packed_file({r.name_: np.reshape(r.data, r.shape) for r in rows.rename(columns={"name": "name_"}).itertuples()}, {"adapter_config": text, "format": "pt"})
        system, at = opened(root)
        folder = f"{at.rstrip('/')}/{key[0]}"
        system.create_dir(folder, recursive=True)
        for name, content in ((TENSOR_FILE, blob), (CONFIG_FILE, text.encode())):
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(content)
            system.move(part, f"{folder}/{name}")
        return pd.DataFrame({"folder": [key[0]], "n_tensors": [len(rows)], "num_bytes": [len(blob)], "sha256": [hashlib.sha256(blob).hexdigest()]})

    return tensors.select("folder", "name", "shape", "data").groupBy("folder").cogroup(configs.select("folder", "config").groupBy("folder")).applyInPandas(write, "folder string, n_tensors bigint, num_bytes bigint, sha256 string")


def read_adapters(spark: SparkSession, root: str, config_schema: str, **options) -> DataFrame:
    """The tensors of the adapter folders below ``root`` with ``folder`` and ``config``, the folder's configuration under
    ``config_schema``; one that doesn't parse is an error, and folders without one are skipped."""
    relative = lambda c: F.regexp_extract(c, rf"([^/]+)/(?:{re.escape(CONFIG_FILE)}|{re.escape(TENSOR_FILE)})$", 1)
    text = spark.read.option("wholetext", True).text(f"{root}/*/{CONFIG_FILE}").select(relative(F.input_file_name()).alias("folder"), F.from_json("value", config_schema, {"mode": "FAILFAST"}).alias("config"))
    tensors = read_tensors(spark, root, **options).drop("config").withColumn("folder", relative(F.col("path")))
    return tensors.join(text, "folder")


def parsed(name: Column) -> tuple[Column, Column, Column]:
    """(layer, module, part) of a tensor name of either convention; another name is an error."""
    checked = F.when(name.rlike(KEY), name).otherwise(F.raise_error(F.concat(F.lit("unrecognised tensor "), name)))
    return F.regexp_extract(checked, KEY, 1).cast("int"), F.regexp_extract(checked, KEY, 2), F.regexp_extract(checked, KEY, 3)


def renamed(tensors: DataFrame, by: list[str], name: str, to: str, prefix: str = PREFIX, segment: str = SEGMENT) -> DataFrame:
    """``tensors`` with names in the convention ``to``: ``long`` (prefix.layers.N.segment.module.part.weight) or ``short``
    (layers.N.module.part.weight). Two tensors of a file that get one name are an error."""
    if to not in ("long", "short"):
        raise ValueError(f"to = {to}")
    layer, module, part = parsed(F.col(name))
    middle = [F.lit(segment)] if to == "long" else []
    new = F.concat_ws(".", *([F.lit(prefix)] if to == "long" else []), F.lit("layers"), layer, *middle, module, part, F.lit("weight"))
    again = tensors.withColumn("_new", new)
    many = again.groupBy(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(by)), F.col("_new").alias("_key")).agg(F.count("*").alias("_many"))
    on = F.col("_new") == F.col("_key")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    met = again.join(many, on)
    checked = F.when(F.col("_many") == 1, F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("several tensors would be named "), F.col("_new"))))
    return met.withColumn(name, checked).select(*tensors.columns)


def described(tensors: DataFrame, by: list[str], name: str = "name", shape: str = "shape") -> DataFrame:
    """A row a file: n_layers, modules (sorted), rank, n_tensors and ``problems``, what its tensors lack: ``not_2d``,
    ``missing_layers`` (0 up to the greatest), ``mixed_rank``, ``count`` (a lora_A and a lora_B a layer and module)."""
    layer, module, part = parsed(F.col(name))
    t = tensors.select(*by, layer.alias("layer"), module.alias("module"), F.size(shape).alias("dims"), F.when(part == "lora_A", F.get(shape, F.lit(0))).otherwise(F.get(shape, F.lit(1))).alias("rank"))
    per = t.groupBy(*by).agg(
        F.countDistinct("layer").alias("n_layers"), F.max("layer").alias("_last"), F.array_sort(F.collect_set("module")).alias("modules"), F.min("rank").alias("rank"), F.max("rank").alias("_most"),
        F.count("*").alias("n_tensors"), F.count_if(F.col("dims") != 2).alias("_odd"),
    )
    problems = F.array_compact(F.array(
        F.when(F.col("_odd") > 0, "not_2d"), F.when(F.col("n_layers") <= F.col("_last"), "missing_layers"), F.when(F.col("rank") != F.col("_most"), "mixed_rank"),
        F.when(F.col("n_tensors") != 2 * F.col("n_layers") * F.size("modules"), "count"),
    ))
    return per.select(*by, "n_layers", "modules", "rank", "n_tensors", problems.alias("problems"))


assert set(KINDS) | {"BF16"} == set(ITEM)
