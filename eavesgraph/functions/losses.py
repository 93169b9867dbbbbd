"""Losses and classification counts as column expressions and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.session import written


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bce_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of logits in the form that does not overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce(p: Column, y: Column, least: float = 1e-12) -> Column:
    """Binary cross-entropy of probabilities, clamped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """alpha-weighted (1 - pt)^gamma times cross-entropy."""
    pt = y * p + (1 - y) * (1 - p)
    return (y * alpha + (1 - y) * (1 - alpha)) * F.pow(1 - pt, F.lit(gamma)) * bce(p, y)


def focal_logits(x: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, weight: Column | float = 1.0) -> Column:
    """The same of logits, in the form that does not overflow, times a weight of the row."""
    p = sigmoid(x)
    miss = y * (1 - p) + (1 - y) * p
    return (y * alpha + (1 - y) * (1 - alpha)) * F.pow(miss, F.lit(gamma)) * bce_logits(x, y) * weight


def smooth_l1(d: Column, beta: float = 1 / 9) -> Column:
    """Quadratic under beta, linear above; a null or NaN difference costs nothing."""
    n = F.abs(d)
    loss = F.when(n < beta, 0.5 * n * n / beta).otherwise(n - 0.5 * beta)
    return F.when(d.isNull() | F.isnan(d), 0.0).otherwise(loss)


def l1(d: Column, weight: Column | float = 1.0) -> Column:
    return F.when(d.isNull() | F.isnan(d), 0.0).otherwise(F.abs(d)) * weight


def cross_entropy(scores: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Cross-entropy of an array of logits against a class from 0, optionally with label smoothing."""
    top = F.array_max(scores)
    total = F.ln(F.aggregate(scores, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top
    own = total - F.element_at(scores, (target + 1).cast("int"))
    if not smoothing:
        return own
    rest = F.aggregate(scores, F.lit(0.0), lambda a, v: a + total - v) - own
    return (1 - smoothing) * own + smoothing * rest / (F.size(scores) - 1)


def weighted_cross_entropy(scores: Column, target: Column, weight: Column | float) -> Column:
    """Cross-entropy of an array of logits against the largest entry of a one-hot (or soft) target array, times a weight of the row."""
    best = F.array_position(target, F.array_max(target)).cast("int") - 1
    return cross_entropy(scores, best) * weight


def positive_weights(df: DataFrame, label: str, by: list[str], name: str = "weight") -> DataFrame:
    """Add 1 / max(number of positives, 1) of each group; the positives are counted by an aggregate, not a window."""
    n = df.groupBy(*by).agg((1.0 / F.greatest(F.sum(label), F.lit(1))).alias(name))
    return df.join(n, by)


def lovasz(df: DataFrame, error: str, foreground: str, by: list[str]) -> DataFrame:
    """(by, loss): errors, floored at 0, times the gradient of the Lovász extension of the Jaccard loss, for each group of ``by``.

    Rows are ordered by falling error (ties do not change the value). They are
    dealt by ranges of this order and written; each range has its own running
    sums and adds those of the ranges before, so a group of any size is spread
    over tasks. The gradient of a row follows from the sums with and without it.
    """
    y, e = F.col(foreground).cast("double"), F.col(error)
    keyed = df.select(*by, e.alias("_e"), y.alias("_y"))
    ranged, _ = written(keyed.repartitionByRange(*by, F.desc("_e"), F.asc("_y")).withColumn("_p", F.spark_partition_id()), "errors")
    parts = ranged.groupBy(*by, "_p").agg(F.sum("_y").alias("_py"), F.sum(1 - F.col("_y")).alias("_pn"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    parts = parts.select(*by, "_p", F.coalesce(F.sum("_py").over(before), zero).alias("_by"), F.coalesce(F.sum("_pn").over(before), zero).alias("_bn"), F.sum("_py").over(Window.partitionBy(*by)).alias("_t"))
    upto = Window.partitionBy(*by, "_p").orderBy(F.desc("_e"), F.asc("_y")).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumns({"_cy": F.sum("_y").over(upto), "_cn": F.sum(1 - F.col("_y")).over(upto)})
    same = reduce(lambda a, b: a & b, [run[c].eqNullSafe(parts[c]) for c in [*by, "_p"]])
    j = run.join(parts, same).select(*[run[c] for c in by], "_e", "_y", (F.col("_cy") + F.col("_by")).alias("_cy"), (F.col("_cn") + F.col("_bn")).alias("_cn"), "_t")
    loss = lambda py, pn: F.when(py + pn > 0, 1 - F.try_divide(F.col("_t") - py, F.col("_t") + pn)).otherwise(zero)
    cy, cn = F.col("_cy"), F.col("_cn")
    grad = loss(cy, cn) - loss(cy - F.col("_y"), cn - (1 - F.col("_y")))
    return j.groupBy(*by).agg(F.sum(F.greatest("_e", zero) * grad).alias("loss"))


def lovasz_hinge(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, loss): the Lovász extension of the hinge loss of each group of ``by``."""
    y = F.col(label).cast("double")
    return lovasz(df.select(*by, (1 - F.col(score) * (2 * y - 1)).alias("_err"), y.alias("_fg")), "_err", "_fg", by)


def lovasz_softmax(df: DataFrame, probabilities: str, label: str, by: list[str]) -> DataFrame:
    """(by, loss): the mean over the classes present in a group of the Lovász extension of their Jaccard loss.

    probabilities: an array by class; label: a class from 0. Rows with a null label do not count.
    """
    each = df.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("_l"), F.posexplode(probabilities).alias("_class", "_q"))
    fg = (F.col("_l") == F.col("_class")).cast("double")
    present = df.where(F.col(label).isNotNull()).select(*by, F.col(label).cast("int").alias("_class")).distinct()
    one = lovasz(each.select(*by, "_class", F.abs(fg - F.col("_q")).alias("_err"), fg.alias("_fg")), "_err", "_fg", [*by, "_class"])
    return one.join(present, [*by, "_class"], "left_semi").groupBy(*by).agg(F.avg("loss").alias("loss"))


def total_loss(*parts: tuple[DataFrame, str, float], by: str = "frame_id") -> DataFrame:
    """(by, total): the weighted sum of the named columns of several losses; a loss that a group lacks counts 0."""
    rows = [df.select(by, (F.coalesce(c, F.lit(0.0)) * w).alias("_v")) for df, c, w in parts]
    return reduce(DataFrame.unionByName, rows).groupBy(by).agg(F.sum("_v").alias("total"))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and f1 with score >= threshold as positive; empty ratios are null."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    r = lambda a, b: F.try_divide(a, b)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", r(tp + tn, tp + fp + tn + fn).alias("accuracy"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


def edge_distance_penalty(df: DataFrame, probability: str, length: str, factor: float = 0.1) -> DataFrame:
    """(frame_id, penalty): mean of probability times length, scaled."""
    return df.groupBy("frame_id").agg((F.avg(F.col(probability) * F.col(length)) * factor).alias("penalty"))


def nan_mean(c: Column) -> Column:
    """Mean that skips NaN as well as null."""
    return F.avg(F.when(~F.isnan(c), c))
