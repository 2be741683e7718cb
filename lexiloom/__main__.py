"""python -m lexiloom validate|split|gate ...; exit code 0: fine, 1: failed, 2: wrong use or unreadable input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .operators import dedup, metrics, nesting, split, validation
from .session import build_session
from .sources import readers, sinks
from .storage import cut, drop_cut


def validate(spark, a) -> int:
    """Counts of broken rules of a JSON-lines file; fails if there are any."""
    lines = readers.read_lines(spark, a.path)
    checked = validation.violations(lines, "value", validation.Rules(require_labels=not a.unlabelled))
    counts = {r.rule: r.records for r in validation.rule_counts(checked).collect()}
    n = lines.count()
    report = {"path": a.path, "records": n, "violations": counts}
    print(json.dumps(report, ensure_ascii=False))
    if a.report:
        sinks.replace(Path(a.report), json.dumps(report, ensure_ascii=False, indent=2))
    return 1 if counts or not n else 0


def split_data(spark, a) -> int:
    """Leakage-safe split of a Parquet pair into folders per split; fails if a targeted split stays empty or anything leaks."""
    samples, tokens = spark.read.parquet(readers.sibling(a.path)), spark.read.parquet(a.path)
    ratios = dict(zip(("train", "validation", "test"), a.ratios))
    found = dedup.duplicate_groups(nesting.latest_samples(samples) if "ingested_at" in samples.columns else samples, tokens)
    assigned = split.assign(found["groups"], ratios, a.seed)
    report = [r.asDict() for r in split.split_report(assigned, ratios).collect()]
    seqs = cut(dedup.sequences(tokens), "sequences")
    leaks = split.leaks(assigned, dedup.signatures(samples, seqs)).count()
    drop_cut(seqs)
    print(json.dumps({"splits": report, "leaks": leaks}))
    if leaks or any(r["n"] == 0 and r["target"] > 0 for r in report):
        return 1
    for name in ratios:
        ids = assigned.where(F.col("split") == name).select("sample_id")
        sinks.write_pair(tokens.join(ids, "sample_id", "left_semi"), samples.join(ids, "sample_id", "left_semi"), f"{a.out}/{name}.tokens.parquet")
    return 0


def loadable(folder: str) -> dict[str, bool]:
    """Whether a run folder's checkpoints are there and not empty; nothing is executed from them."""
    files = sorted(Path(folder).glob("*.pt")) if Path(folder).is_dir() else []
    return {"checkpoints present": bool(files), "checkpoints not empty": bool(files) and all(f.stat().st_size > 0 for f in files)}


def gate(spark, a) -> int:
    """Verdict over a run's summary."""
    summary = readers.read_summary(spark, readers.find_summary(a.path))
    checks = {r.check: r.passed for r in metrics.gate(summary, a.min_accuracy, a.max_mae).collect()}
    if a.checkpoints:
        checks |= loadable(a.checkpoints)
    passed = bool(checks) and all(checks.values())
    print(json.dumps({"passed": passed, "checks": checks}))
    return 0 if passed else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--report")
    v.add_argument("--unlabelled", action="store_true")
    s = sub.add_parser("split")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("--ratios", nargs=3, type=float, default=list(split.RATIOS.values()))
    s.add_argument("--seed", type=int, default=42)
    g = sub.add_parser("gate")
    g.add_argument("path")
    g.add_argument("--min-accuracy", type=float, default=metrics.MIN_ACCURACY)
    g.add_argument("--max-mae", type=float, default=metrics.MAX_MAE)
    g.add_argument("--checkpoints")
    a = p.parse_args(argv)
    spark = build_session()
    try:
        return {"validate": validate, "split": split_data, "gate": gate}[a.command](spark, a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
