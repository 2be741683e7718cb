"""Classification and regression metrics, slices, failures, losses, gates and training logs, as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keyed, length_bucket, phrase_position
from ..storage import checked_broadcast, cut, tidy
from .percentiles import radix_percentiles
from .prefix import running_total


def confusion(pairs: DataFrame, target: str, predicted: str, classes: int) -> DataFrame:
    """``target, predicted, n`` of all cells, zeros too; rows with a null side do not count. The grid has classes squared rows, whatever the data."""
    spark = pairs.sparkSession
    counts = pairs.where(F.col(target).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(target).cast("long").alias("target"), F.col(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).alias("target"), (F.col("id") % classes).alias("predicted"))
    return grid.join(F.broadcast(counts), ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` from a confusion matrix; 0 where a denominator is 0."""
    rows = F.explode(
        F.array(
            F.struct(F.col("target").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
        )
    ).alias("x")
    s = matrix.select(rows).groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")


def overall(matrix: DataFrame) -> DataFrame:
    """``accuracy, macro_f1, weighted_f1, total``: macro over the classes that occur as targets; zeros for an empty matrix."""
    hits = matrix.agg(F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("total"))
    c = per_class(matrix).agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro"), F.sum(F.col("f1") * F.col("support")).alias("weighted"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return hits.crossJoin(c).select(z(F.try_divide(F.col("hits").cast("double"), F.col("total"))).alias("accuracy"), z(F.col("macro")).alias("macro_f1"), z(F.try_divide(F.col("weighted"), F.col("total"))).alias("weighted_f1"), F.coalesce("total", F.lit(0)).alias("total"))


@tidy
def errors(rows: DataFrame, target: Column, predicted: Column, by: list | None = None) -> DataFrame:
    """``n, mae, rmse, median`` of the absolute errors of rows with both sides; zeros for none, without ``by`` in one row. The median is exact, by radix selection."""
    keys = by or ["_all"]
    kept = cut((rows if by else rows.withColumn("_all", F.lit(0))).select(*keys, F.abs(predicted - target).cast("double").alias("_e")).where("_e is not null"), "errors")
    m = radix_percentiles(kept, keys, "_e", (50,)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("p50").alias("median"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    sums = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    out = sums.join(checked_broadcast(m), same).select(*(by or []), "n", "mae", "rmse", "median")
    return out if by else out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("mae", "rmse", "median")])


def state(rows: DataFrame, target: str, predicted: str, target_value: str, predicted_value: str, by: list[str] | None = None) -> DataFrame:
    """Mergeable partial result of both kinds of metrics: ``by..., target, predicted, n`` cells with ``values, absolute, squared`` sums of the strength errors. Can be stored by day or part; rows with a null class have null cells and count for the errors alone."""
    e = F.abs(F.col(predicted_value) - F.col(target_value))
    cells = rows.groupBy(*(by or []), F.col(target).cast("long").alias("target"), F.col(predicted).cast("long").alias("predicted"))
    return cells.agg(F.count("*").alias("n"), F.count(e).alias("values"), F.coalesce(F.sum(e), F.lit(0.0)).alias("absolute"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("squared"))


def merge_states(*states: DataFrame) -> DataFrame:
    """States of disjoint parts as one; merging in any order or grouping gives the same."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select("target", "predicted", "n", "values", "absolute", "squared") for s in states])
    return every.groupBy("target", "predicted").agg(*[F.sum(c).alias(c) for c in ("n", "values", "absolute", "squared")])


def finalise(merged: DataFrame, classes: int) -> DataFrame:
    """One row ``accuracy, macro_f1, weighted_f1, total, mae, rmse`` of a merged state; zeros for an empty one."""
    cells = merged.where("target is not null and predicted is not null").select("target", "predicted", "n")
    grid = merged.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).alias("target"), (F.col("id") % classes).alias("predicted"))
    matrix = grid.join(cells, ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("values")), F.lit(0.0))
    return overall(matrix).crossJoin(merged.agg(mean("absolute").alias("mae"), F.sqrt(mean("squared")).alias("rmse")))


def masked(rows: DataFrame, mask: Column, target: str, predicted: str, target_value: str, predicted_value: str) -> DataFrame:
    """``accuracy, mae`` over the rows where ``mask`` holds; 0 where none does."""
    ok = rows.where(F.coalesce(mask, F.lit(False)))
    hit = F.avg((F.col(target) == F.col(predicted)).cast("double"))
    return ok.agg(F.coalesce(hit, F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.abs(F.col(predicted_value) - F.col(target_value))), F.lit(0.0)).alias("mae"))


# Lines of acceptance: least macro F1, largest mean absolute error, largest fall of accuracy against a baseline.
MIN_F1, MAX_ERROR, MAX_FALL = 0.92, 8.0, 0.005


def acceptance(results: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``check, passed`` of one-row frames ``accuracy, macro_f1, mae``; a null or NaN fails its check. Without a baseline its check is left out."""
    r = results.select("accuracy", "macro_f1", "mae")
    checks = [("macro F1", F.col("macro_f1") >= MIN_F1), ("strength error", F.col("mae") <= MAX_ERROR)]
    if baseline is not None:
        r = r.crossJoin(baseline.select(F.col("accuracy").alias("_before")))
        checks.append(("no regression", F.col("accuracy") >= F.col("_before") - MAX_FALL - 1e-12))
    finite = lambda c: F.coalesce(c & ~F.isnan("macro_f1") & ~F.isnan("mae") & ~F.isnan("accuracy"), F.lit(False))
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), finite(c).alias("passed")) for k, c in checks])).alias("x")).select("x.*")


SLICES = ("language", "surface_tone", "stress", "syllable_role", "phrase_position", "length_bucket")


def with_slices(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``slice_key``, an array of (slice, key) over the six slicings; a sentence's length is its rows."""
    n = F.count("*").over(Window.partitionBy("sample_id"))
    pos = phrase_position(*[F.col(f"boundary_{c}") for c in ("word_start", "word_end", "phrase_start", "phrase_end")])
    keys = {"language": F.col("language"), "surface_tone": keyed("tone", F.col("surface_tone")), "stress": keyed("stress", F.col("stress")), "syllable_role": F.coalesce("syllable_role", F.lit("other")), "phrase_position": pos, "length_bucket": length_bucket(F.col("_len"))}
    return tokens.withColumn("_len", n).withColumn("slice_key", F.array(*[F.struct(F.lit(s).alias("slice"), k.alias("key")) for s, k in keys.items()])).drop("_len")


def with_context_slices(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``slice_key``: types of the phonemes before and behind, the tone before, and the third of the sentence a token lies in; 'edge' where there is no neighbour, 'none' for null."""
    w = Window.partitionBy("sample_id").orderBy("token_index")
    rank, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("sample_id"))
    named = lambda c, there: F.when(there.isNull(), "edge").otherwise(F.coalesce(c.cast("string"), F.lit("none")))
    before, after = F.lag(F.lit(1)).over(w), F.lead(F.lit(1)).over(w)
    third = F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (F.floor((rank - 1) * 3 / n) + 1).cast("int"))
    keys = {"type_before": named(F.lag("articulatory_type").over(w), before), "type_after": named(F.lead("articulatory_type").over(w), after), "tone_before": named(F.lag("surface_tone").over(w), before), "sentence_third": third}
    return tokens.withColumn("slice_key", F.array(*[F.struct(F.lit(s).alias("slice"), k.alias("key")) for s, k in keys.items()]))


def slice_metrics(tokens: DataFrame, target: str, predicted: str, target_value: str, predicted_value: str, slices=None) -> DataFrame:
    """``slice, key, tokens, accuracy, macro_f1, mae`` of each slice (:func:`with_slices`, or ``slices`` in its place), in one pass: per (slice, key, target, predicted) partial sums, then per slice. Only rows with all four values count."""
    ok = tokens
    for c in (target, predicted, target_value, predicted_value):
        ok = ok.where(F.col(c).isNotNull())
    cells = (slices or with_slices)(ok).select(F.explode("slice_key").alias("s"), F.col(target).alias("t"), F.col(predicted).alias("p"), F.abs(F.col(predicted_value) - F.col(target_value)).alias("e")).groupBy("s.slice", "s.key", "t", "p").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    each = F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("x")
    cls = cells.select("slice", "key", "n", "t", "p", each).groupBy("slice", "key", "x.c").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), F.sum(F.when((F.col("t") == F.col("p")) & (F.col("x.support") > 0), F.col("n")).otherwise(0)).alias("hit"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0))
    macro = cls.where("support > 0").groupBy("slice", "key").agg(F.avg(f1).alias("macro_f1"))
    sums = cells.groupBy("slice", "key").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"), F.sum("e").alias("e"))
    m = macro.select(F.col("slice").alias("_s"), F.col("key").alias("_k"), "macro_f1")
    return sums.join(m, (F.col("slice") == F.col("_s")) & F.col("key").eqNullSafe(F.col("_k"))).select("slice", "key", "tokens", (F.col("hit") / F.col("tokens")).alias("accuracy"), "macro_f1", (F.col("e") / F.col("tokens")).alias("mae"))


def failures(rows: DataFrame, target: str, predicted: str, error: str, order: list[str], limit: int = 500, tolerance: float = 15.0) -> DataFrame:
    """The worst rows: wrong class first, then by error; ties by ``order``. A top-k, so no full sort."""
    wrong = F.col(target) != F.col(predicted)
    return rows.where(wrong | (F.col(error) > tolerance)).orderBy(F.when(wrong, 0).otherwise(1), F.desc(error), *order).limit(limit)


def smooth_l1(d: Column, beta: float = 1.0) -> Column:
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def weighted_losses(rows: DataFrame, error: Column, weight: Column, beta: float = 1.0) -> DataFrame:
    """Weighted means of Huber, absolute and squared loss; 0 if the weights sum to nothing."""
    d = F.abs(error)
    mean = lambda x, name: F.when(F.sum(weight) > 0, F.sum(weight * x) / F.sum(weight)).otherwise(0.0).alias(name)
    return rows.agg(mean(smooth_l1(d, beta), "huber"), mean(d, "l1"), mean(d * d, "mse"))


def cross_entropy(scores: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Loss of one row from class scores, with label smoothing."""
    top = F.array_max(scores)
    log_sum = top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    hit = log_sum - F.element_at(scores, (target + 1).cast("int"))
    spread = log_sum - F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return (1 - smoothing) * hit + smoothing * spread


def total_loss(class_loss: Column, strength_loss: Column, class_weight: float = 1.0, strength_weight: float = 1.0) -> Column:
    return class_weight * class_loss + strength_weight * strength_loss


def composite(macro_f1: Column, mae: Column, alpha: float = 1.0, scale: float = 100.0) -> Column:
    return macro_f1 - alpha * mae / scale


# Thresholds of the gate.
MIN_ACCURACY, MAX_MAE = 0.95, 5.0


def gate(summary: DataFrame, min_accuracy: float = MIN_ACCURACY, max_mae: float = MAX_MAE, finite_loss: bool = True, validation: bool = True) -> DataFrame:
    """``check, passed`` over a one-row training summary.

    Reads global_step, saw_non_finite_loss, final_train_loss, final_train_viseme_accuracy, final_train_strength_mae and the struct
    ``validation`` with val_viseme_accuracy and val_strength_mae. What is missing, null, NaN or no number fails its check, never
    the query; with a null validation only its presence is checked. An empty summary has no checks.
    """
    have = set(summary.columns)
    inner = set(summary.schema["validation"].dataType.names) if "validation" in have and hasattr(summary.schema["validation"].dataType, "names") else set()

    def number(c: str, inside: bool = False) -> Column:
        if c not in (inner if inside else have):
            return F.lit(None).cast("double")
        field = F.col(f"validation.{c}" if inside else c)
        kind = dict(summary.select(field.alias("x")).dtypes)["x"]
        v = field.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.lit(None).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    checks = [("training ran", number("global_step") > 0)]
    if finite_loss:
        calm = F.col("saw_non_finite_loss").cast("string") == "false" if "saw_non_finite_loss" in have else F.lit(False)
        checks += [("no NaN or Inf", calm), ("train loss finite", number("final_train_loss").isNotNull())]
    checks += [("train accuracy", number("final_train_viseme_accuracy") >= min_accuracy), ("train strength error", number("final_train_strength_mae") <= max_mae)]
    if validation:
        there = F.col("validation").isNotNull() if inner else F.lit(False)
        checks += [("validation present", there), ("validation accuracy", number("val_viseme_accuracy", True) >= min_accuracy), ("validation strength error", number("val_strength_mae", True) <= max_mae)]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks])
    if validation:
        rows = F.when(there, rows).otherwise(F.slice(rows, 1, len(checks) - 2))
    return summary.select(F.explode(rows).alias("x")).select("x.check", "x.passed")


def gate_verdict(checks: DataFrame) -> DataFrame:
    """``passed``: all checks, and at least one."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))


def log_windows(log: DataFrame, step: str, value: str, every: int, by: list[str] | None = None, partial: bool = False) -> DataFrame:
    """``by..., window, steps, mean``: means of consecutive windows of ``every`` steps; a last window that is not full is left out unless it is the only one, or ``partial`` asks for it."""
    w = log.groupBy(*(by or []), F.floor((F.col(step) - 1) / every).alias("window")).agg(F.count("*").alias("steps"), F.avg(value).alias("mean"))
    return w if partial else w.where((F.col("steps") == every) | (F.col("window") == 0))


def running_best(log: DataFrame, run: str, step: str, value: str, higher_is_better: bool = True) -> DataFrame:
    """``log`` with ``best`` so far, ``improved`` (strictly better than all before; the first value is) and ``since``, rows since the last improvement. NaN and null never improve."""
    w = Window.partitionBy(run).orderBy(step)
    v = F.when(~F.isnan(value), F.col(value) if higher_is_better else -F.col(value))
    before = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = log.withColumn("improved", F.coalesce(v.isNotNull() & (before.isNull() | (v > before)), F.lit(False)))
    so_far = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumns({"best": so_far if higher_is_better else -so_far, "_n": F.row_number().over(w)})
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("since", F.col("_n") - F.coalesce(last, F.lit(0))).drop("_n")


def early_stop(best: DataFrame, run: str, step: str, patience: int) -> DataFrame:
    """``run, step`` of the first row whose count without improvement reaches ``patience``."""
    return best.where(F.col("since") >= patience).groupBy(run).agg(F.min(step).alias(step))


def learning_rate(step: Column, base: float, warmup: int, total: int, kind: str = "cosine", floor: float = 0.0) -> Column:
    """Linear warm-up, then constant, linear or cosine decay to ``floor`` times the base."""
    import math

    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    shape = {"constant": F.lit(1.0), "linear": 1.0 - done, "cosine": 0.5 * (1.0 + F.cos(F.lit(math.pi) * done))}[kind]
    after = F.greatest(F.lit(floor), shape)
    return F.lit(base) * (F.when(step < warmup, step / float(max(1, warmup))).otherwise(after) if warmup else after)


def newest(steps: DataFrame, run: str, step: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each run by step."""
    return steps.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))).where(F.col("_r") <= keep).drop("_r")


def agreement(labels: DataFrame, key: list[str], annotator: str, klass: str, value: str) -> DataFrame:
    """``a, b, n, class_agreement, mae`` of each pair of annotators over the items both labelled (each annotator once per item)."""
    x = labels.select(*key, F.col(annotator).alias("a"), F.col(klass).alias("ca"), F.col(value).alias("va"))
    y = labels.select(*key, F.col(annotator).alias("b"), F.col(klass).alias("cb"), F.col(value).alias("vb"))
    return x.join(y, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("class_agreement"), F.avg(F.abs(F.col("va") - F.col("vb"))).alias("mae"))


def calibration(rows: DataFrame, by: str, predicted: str, target: str) -> DataFrame:
    """Least-squares line from predicted to target per class: ``by, n, slope, intercept``; null slope where the predictions do not vary."""
    ok = rows.where(F.col(predicted).isNotNull() & F.col(target).isNotNull())
    return ok.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(target, predicted).alias("slope"), F.regr_intercept(target, predicted).alias("intercept"))


def numbered(rows: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Row numbers over the whole table in a unique order, by distributed counts."""
    return running_total(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in order], F.lit(1), out).drop("_all")
