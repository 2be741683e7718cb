"""Writers: the two-table Parquet form, JSON lines, split files, metric artifacts, event logs."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category
from .readers import MODEL_COLUMNS, sibling


def write_pair(tokens: DataFrame, samples: DataFrame, tokens_path: str) -> None:
    """Both tables, zstd-compressed, next to each other; tokens are kept together by sentence and in order."""
    tokens.repartition("sample_id").sortWithinPartitions("sample_id", "token_index").write.option("compression", "zstd").parquet(tokens_path)
    samples.write.option("compression", "zstd").parquet(sibling(tokens_path))


def narrow(tokens: DataFrame) -> DataFrame:
    """The columns a model reads, without index; a null role is 'other'."""
    return tokens.select(*[c for c in MODEL_COLUMNS if c not in ("token_index",)]).withColumn("syllable_role", F.coalesce("syllable_role", F.lit("other")))


def textual(tokens: DataFrame) -> DataFrame:
    """All columns as text but strength, a float; index from 0."""
    cols = [F.col(c).cast("float") if c == "strength" else (F.col(c) - 1).cast("string").alias(c) if c == "token_index" else F.col(c).cast("string") for c in tokens.columns]
    return tokens.select(*cols)


def rebuild_lines(nested: DataFrame) -> DataFrame:
    """``sample_id, value``: JSON of each nested sentence, null fields written."""
    return nested.select("sample_id", F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str, order: str | None = None) -> None:
    """The ``value`` column as lines, verbatim; with ``order`` range-sorted across files."""
    df = lines.repartitionByRange(order).sortWithinPartitions(order) if order else lines
    df.select("value").write.text(path)


def write_split(lines: DataFrame, chosen: DataFrame, path: str) -> int:
    """The chosen lines (``line_no``) verbatim; an error if one of them does not exist."""
    want = chosen.select("line_no").distinct()
    picked = lines.join(want, "line_no", "left_semi")
    n, m = picked.count(), want.count()
    if n != m:
        raise ValueError(f"{m} lines chosen, {n} found")
    write_lines(picked, path, "line_no")
    return n


def write_artifacts(out_dir: str, overall: DataFrame, per_class: DataFrame, matrix: DataFrame, errors: DataFrame, failures: DataFrame) -> dict[str, str]:
    """metrics.json, per_class.csv, confusion_matrix.csv, strength_report.csv and failure_cases.jsonl. All but the failures are of bounded size (classes squared), the failures a top-k."""
    root = Path(out_dir)
    root.mkdir(parents=True, exist_ok=True)
    number = lambda x: "NaN" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)

    def table(name: str, header: list[str], rows) -> str:
        replace(root / name, "\n".join([",".join(header), *[",".join(map(number, r)) for r in rows]]) + "\n")
        return str(root / name)

    cells = {(r.target, r.predicted): r.n for r in matrix.collect()}
    size = max((t for t, _ in cells), default=-1) + 1
    classes = per_class.orderBy("class").collect()
    out = {"per_class": table("per_class.csv", ["class", "precision", "recall", "f1", "support"], [[r["class"], *([r.precision, r.recall, r.f1] if r.support else [None] * 3), r.support] for r in classes])}
    out["confusion_matrix"] = table("confusion_matrix.csv", ["target", *map(str, range(size))], [[t, *[cells.get((t, p), 0) for p in range(size)]] for t in range(size)])
    e = errors.collect()
    out["strength_report"] = table("strength_report.csv", errors.columns, [list(r) for r in e])
    replace(root / "metrics.json", json.dumps({**overall.first().asDict(), "strength": [r.asDict() for r in e]}, indent=2))
    replace(root / "failure_cases.jsonl", "".join(json.dumps(r.asDict(), ensure_ascii=False, default=str) + "\n" for r in failures.toLocalIterator()))
    return out | {"metrics": str(root / "metrics.json"), "failure_cases": str(root / "failure_cases.jsonl")}


def replace(path: Path, text: str) -> None:
    """Writes beside and renames, so a reader sees the old or the new file."""
    temp = path.with_name(path.name + ".part")
    temp.write_text(text, encoding="utf-8")
    os.replace(temp, path)


# Fields of an event that callers cannot overwrite.
RESERVED = ("ts", "stage", "message")


def append_event(path: str, stage: str, message: str = "", /, **fields) -> None:
    """One JSON line; fields with a reserved name get the prefix ``field_``."""
    row = {"ts": time.time(), "stage": stage, "message": message, **{f"field_{k}" if k in RESERVED else k: v for k, v in fields.items()}}
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False, default=str) + "\n")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def predictions(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """``sample_id, outputs``: predictions of each sentence in order, ready for JSON."""
    return tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", *columns))).alias("outputs"))


def percent_report(counts: DataFrame, field: str) -> str:
    """A line of shares, most frequent first, then by value."""
    rows = counts.where(F.col("field") == field).orderBy(F.desc("n"), "value").collect()
    total = sum(r.n for r in rows) or 1
    return ", ".join(f"{r.value}: {100 * r.n / total:.2f}%" for r in rows)


def cache_key(path: str, rows: int, fingerprint: str, weights: dict[str, float] | None = None, scale: float = 100.0) -> dict:
    """What a cached encoding depends on: the source's name, size and time of change (of all its files), its rows, the dictionary, source weights and the strength scale."""
    files = sorted(p for p in Path(path).rglob("*") if p.is_file()) if os.path.isdir(path) else [Path(path)]
    return {"path": str(Path(path).resolve()), "size": sum(p.stat().st_size for p in files), "mtime_ns": max((p.stat().st_mtime_ns for p in files), default=0), "rows": rows, "vocabulary": fingerprint, "weights": weights or {}, "scale": scale}


def cached(build, key: dict, folder: str, spark) -> DataFrame:
    """The frame ``build()`` makes, kept as Parquet under a hash of ``key``; another key is a miss. A half-written one has no success mark and is built again."""
    import hashlib

    digest = hashlib.md5(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{digest}"
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").limit(1).count()
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def as_categories(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and blanks of the columns as the [NA] category, as the older flat files have them."""
    return tokens.withColumns({c: category(F.col(c)) for c in columns})
