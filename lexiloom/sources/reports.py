"""Text reports: profile, split, evaluation and gate. All lines come from frames of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .sinks import percent_report


def _rows(title: str, pairs) -> list[str]:
    pairs = list(pairs)
    width = max((len(k) for k, _ in pairs), default=0)
    return [title, "-" * len(title), *[f"{k.ljust(width)}  {'-' if v is None else f'{v:.4f}' if isinstance(v, float) else v}" for k, v in pairs], ""]


def profile_report(lengths: DataFrame, counts: DataFrame, fields: tuple[str, ...]) -> str:
    """Sizes of a corpus and the shares of each field's values, most frequent first, then by value."""
    return "\n".join(_rows("Corpus", lengths.first().asDict().items()) + _rows("Shares", ((f, percent_report(counts, f)) for f in fields)))


def split_text(report: DataFrame, summary: DataFrame, leaks: int) -> str:
    """Sizes and ratios of the splits, duplicates found, and the leak check."""
    lines = [(r["split"], f"{r['n']} ({100 * r['ratio']:.2f}%, target {100 * r['target']:.2f}%{', deviates' if r['deviates'] else ''})") for r in report.orderBy("split").collect()]
    return "\n".join(_rows("Splits", lines) + _rows("Duplicates", summary.first().asDict().items()) + _rows("Leaks", [("found", leaks)]))


def evaluation_report(overall: DataFrame, errors: DataFrame, per_class: DataFrame, slices: DataFrame | None = None) -> str:
    """Overall figures, then a line per class and per slice."""
    out = _rows("Evaluation", {**overall.first().asDict(), **errors.first().asDict()}.items())
    out += _rows("Classes", ((str(r["class"]), f"precision {r.precision:.4f} recall {r.recall:.4f} f1 {r.f1:.4f} support {r.support}") for r in per_class.orderBy("class").collect()))
    if slices is not None:
        out += _rows("Slices", ((f"{r['slice']} {r['key']}", f"tokens {r.tokens} accuracy {r.accuracy:.4f} macro F1 {r.macro_f1:.4f} error {r.mae:.4f}") for r in slices.orderBy("slice", "key").collect()))
    return "\n".join(out)


def gate_report(checks: DataFrame) -> str:
    """A line per check and the verdict: passed if there are checks and all hold."""
    rows = checks.collect()
    return "\n".join(_rows("Gate", [*[(r.check, "pass" if r.passed else "FAIL") for r in rows], ("verdict", "pass" if rows and all(r.passed for r in rows) else "FAIL")]))
