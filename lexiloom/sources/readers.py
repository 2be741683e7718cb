"""Readers: JSON lines with line numbers, the two-table Parquet form, dictionaries, summaries, configuration."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.nesting import nest, records
from ..operators.validation import Rules, auto_id, fail_fast, violations
from ..storage import checked_broadcast, cut, tidy

# Columns of the flat token table, and those a model reads.
MODEL_COLUMNS = (
    "sample_id", "token_index", "phoneme", "language", "surface_tone", "stress", "syllable_role", "articulatory_type", "articulatory_height", "articulatory_backness", "articulatory_rounded",
    "articulatory_place", "articulatory_manner", "articulatory_voiced", "articulatory_aspirated", "boundary_word_start", "boundary_word_end", "boundary_phrase_start", "boundary_phrase_end",
    "boundary_boundary_type", "viseme_id", "strength", "viseme_source", "strength_source",
)


@tidy
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of non-blank lines, trimmed; ``line_no`` counts all physical lines of a file from 1.

    Splits of a file are read in order, so a line's number is the lines of the earlier splits plus its place in its own. Counts per
    split are all that is summed up. A missing path is an error, an empty file gives no rows.
    """

    class Numbered:
        def __call__(self, batches):
            import pyarrow as pa

            at = 0
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64())], names=["file", "start", "value", "k"])
                at += b.num_rows

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    placed = cut(raw.mapInArrow(Numbered(), "file string, start long, value string, k long").withColumn("p", F.spark_partition_id()), "lines")
    parts = placed.groupBy("file", "start", "p").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("file").alias("_f"), F.col("start").alias("_s"), before.alias("before"), "first")
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    out = placed.join(checked_broadcast(cut(offsets, "offsets")), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))).select("file", (F.col("before") + F.col("k") - F.col("first") + 1).alias("line_no"), value.alias("value"))
    return out.where("value <> ''")


def load_samples(spark: SparkSession, path: str, rules: Rules = Rules(), limit: int | None = None) -> DataFrame:
    """Validated lines of a JSON-lines file, the first ``limit`` by line; the first violation is an error, and so is a file without records."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    lines = read_lines(spark, path)
    if limit is not None:
        lines = lines.orderBy("file", "line_no").limit(limit)
    checked = fail_fast(violations(lines, "value", rules), "line_no").withColumn("sample_id", auto_id(F.col("value"), F.concat_ws(":", "file", "line_no")))
    if not checked.limit(1).count():
        raise ValueError(f"{path}: no samples")
    return checked


def sibling(tokens_path: str) -> str:
    """``<split>.tokens.parquet`` -> ``<split>.samples.parquet``."""
    if not tokens_path.rstrip("/").endswith(".tokens.parquet"):
        raise ValueError(f"{tokens_path}: expected a name ending in .tokens.parquet")
    return tokens_path.rstrip("/")[: -len(".tokens.parquet")] + ".samples.parquet"


def read_pair(spark: SparkSession, tokens_path: str, columns: tuple[str, ...] | None = None, rules: Rules | None = None) -> DataFrame:
    """Sentences of the two-table form, nested by sample_id; only the wanted token columns are scanned. A sample_id is one sentence even where its rows are apart. With ``rules`` every sentence is put together as a record and checked like a JSON line; the first violation is an error, and so is a pair without sentences."""
    samples = spark.read.parquet(sibling(tokens_path))
    tokens = spark.read.parquet(tokens_path)
    if rules is not None:
        checked = cut(violations(records(tokens, samples), "value", rules), "checked")
        fail_fast(checked, "sample_id")
        if not checked.limit(1).count():
            raise ValueError(f"{tokens_path}: no samples")
    if columns:
        tokens = tokens.select(*columns)
    return nest(tokens, samples)


def load_split(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Parquet pair or JSON lines by the name's end."""
    return read_pair(spark, path, **options) if path.rstrip("/").endswith(".parquet") else load_samples(spark, path, **options)


# The escapes of the tab-separated format besides the doubled backslash.
TSV_ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f", "\\0": "\0", "\\'": "'", '\\"': '"', "\\`": "`", "\\=": "="}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated text with backslash escapes and ``\\N`` for null. A row with another number of fields is an error, not skipped."""
    n = len(schema.fields)
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields: "), F.col("value"))))
    rows = spark.read.text(path).select(checked.alias("p"))

    def plain(c):
        mark = ""
        c = F.replace(c, F.lit("\\\\"), F.lit(mark))
        for k, v in TSV_ESCAPES.items():
            c = F.replace(c, F.lit(k), F.lit(v))
        return F.replace(c, F.lit(mark), F.lit("\\"))

    one = lambda k: F.element_at("p", k + 1)
    return rows.select(*[F.when(one(k) != "\\N", plain(one(k))).cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)])


def find_summary(run_dir: str, name: str = "training_summary.json") -> str:
    """The summary file in a run folder, or that of its newest sub-folder; an error if there is none."""
    root = Path(run_dir)
    found = sorted(root.glob(name)) or sorted(root.glob(f"*/{name}"))
    if not found:
        raise FileNotFoundError(f"{run_dir}: no {name}")
    return str(found[-1])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def build_config(kind: type, raw: Any, path: str = "config") -> Any:
    """A dataclass from nested dictionaries; unknown keys, at any depth, are an error."""
    if not is_dataclass(kind) or raw is None:
        return raw
    known = {f.name: f for f in fields(kind)}
    extra = sorted(set(raw) - set(known))
    if extra:
        raise ValueError(f"{path}: unknown keys {extra}")
    types = {f.name: f.type if isinstance(f.type, type) else None for f in fields(kind)}
    return kind(**{k: build_config(types[k], v, f"{path}.{k}") if types[k] and is_dataclass(types[k]) else tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def read_config(path: str, kind: type = Rules) -> Any:
    """A configuration file: JSON, or YAML where the yaml package is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return build_config(kind, yaml.safe_load(text))
    return build_config(kind, json.loads(text))
