"""Classification and regression metrics as aggregates, for many score sets at once.

Every function takes ``by``: columns that tell score sets apart, such as model and
split. Curves are built over distinct scores, so equal scores form one step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ordering import (
    average_ranks,
    global_rank,
    running_totals,
    spread_lookup,
)
from tideline.functions.scalars import clip, rounded, zero_if_undefined
from tideline.session import materialise

CALIBRATION_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)[1:-1]]
F1_THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 19)]
LOG_LOSS_CLIP = 1e-6
RATIO_GUARD = 1e-6


def confusion_counts(label: Column, predicted: Column) -> list[Column]:
    positive = label == 1
    return [
        F.count_if(predicted & positive).alias("true_positives"),
        F.count_if(predicted & ~positive).alias("false_positives"),
        F.count_if(~predicted & positive).alias("false_negatives"),
        F.count_if(~predicted & ~positive).alias("true_negatives"),
    ]


def _f1(tp: Column, flagged: Column, positives: Column) -> Column:
    return zero_if_undefined(2.0 * tp, flagged + positives)


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    tp = F.col("true_positives")
    flagged = tp + F.col("false_positives")
    positives = tp + F.col("false_negatives")
    return counts.withColumns(
        {
            "precision": zero_if_undefined(tp, flagged),
            "recall": zero_if_undefined(tp, positives),
            "f1": _f1(tp, flagged, positives),
        }
    )


def confusion_matrix(
    scored: DataFrame, label: str, prob: str, threshold: float | Column = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    return scored.groupBy(*by).agg(
        *confusion_counts(F.col(label), F.col(prob) >= _literal(threshold))
    )


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def brier(label: Column, prob: Column) -> Column:
    return F.avg((prob - label) * (prob - label))


def log_loss(label: Column, prob: Column) -> Column:
    p = clip(prob, LOG_LOSS_CLIP, 1 - LOG_LOSS_CLIP)
    return F.avg(F.when(label == 1, -F.ln(p)).otherwise(-F.ln(1 - p)))


def rank_curve(scored: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and average precision from one ordered pass over distinct scores."""
    steps = scored.groupBy(*by, prob).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    placed = running_totals(
        steps,
        [F.col(prob).desc()],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        by,
        sizes={"all_pos": "cum_pos", "all_neg": "cum_neg"},
    )
    pos, neg, above = F.col("pos"), F.col("neg"), F.col("cum_pos") - F.col("pos")
    # As doubles: the product outgrows a long from some billions of rows on.
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return placed.groupBy(*by).agg(
        F.try_divide(F.sum(neg * (above + pos / 2.0)), pairs).alias("roc_auc"),
        F.coalesce(
            F.try_divide(F.sum(pos * precision), F.max("all_pos")), F.lit(0.0)
        ).alias("pr_auc"),
    )


def calibration_error(
    scored: DataFrame, label: str, prob: str, by: Sequence[str] = ()
) -> DataFrame:
    """Gap between mean score and observed rate over ten bins, weighted by bin size."""
    bin_number = reduce(
        lambda a, b: a + b, [(F.col(prob) >= F.lit(e)).cast("int") for e in CALIBRATION_EDGES]
    )
    bins = scored.groupBy(*by, bin_number.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.abs(F.avg(label) - F.avg(prob)).alias("_gap"),
    )
    gap = F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")
    return bins.groupBy(*by).agg(gap.alias("expected_calibration_error"))


def classification_metrics(
    scored: DataFrame,
    label: str,
    prob: str,
    by: Sequence[str],
    threshold: float | Column = 0.5,
) -> DataFrame:
    """One row per score set with every classification metric, at four decimals."""
    y, p, cut = F.col(label), F.col(prob), _literal(threshold)
    flat = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *confusion_counts(y, p >= cut),
        brier(y, p).alias("brier"),
        log_loss(y, p).alias("log_loss"),
    )
    joined = (
        precision_recall_f1(flat)
        .join(rank_curve(scored, label, prob, by), list(by))
        .join(calibration_error(scored, label, prob, by), list(by))
        .withColumn("threshold", cut)
    )
    names = [
        "roc_auc", "pr_auc", "precision", "recall", "f1", "brier", "log_loss",
        "expected_calibration_error", "threshold",
    ]
    return joined.withColumns({n: rounded(F.col(n)) for n in names})


def best_f1_threshold(scored: DataFrame, label: str, prob: str) -> DataFrame:
    """First of nineteen thresholds with the best F1, from one aggregate."""
    y, p = F.col(label), F.col(prob)
    counts = scored.agg(
        F.count_if(y == 1).alias("positives"),
        *[F.count_if(p >= t).alias(f"flagged_{i}") for i, t in enumerate(F1_THRESHOLDS)],
        *[F.count_if((p >= t) & (y == 1)).alias(f"hit_{i}") for i, t in enumerate(F1_THRESHOLDS)],
    )
    candidates = F.array(
        *[
            F.struct(
                (-_f1(F.col(f"hit_{i}"), F.col(f"flagged_{i}"), F.col("positives"))).alias("loss"),
                F.lit(t).alias("threshold"),
            )
            for i, t in enumerate(F1_THRESHOLDS)
        ]
    )
    best = F.array_min(candidates)
    return counts.select(
        best["threshold"].alias("threshold"), (-best["loss"]).alias("f1")
    )


def top_size(rows: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.floor(rows * F.lit(float(fraction))))


def top_fraction_capture(
    scored: DataFrame, label: str, prob: str, tie: str, fractions: Sequence[float]
) -> DataFrame:
    """Share of positives, precision and lift among the highest scores, per fraction."""
    ranked = global_rank(scored.select(tie, label, prob), [F.col(prob).desc(), F.col(tie)])
    sized = ranked.withColumn("_rows", ranked.agg(F.count(F.lit(1))).scalar())
    totals = sized.agg(
        F.max("_rows").alias("rows"),
        F.sum(label).alias("positives"),
        *[
            F.sum(F.when(F.col("rank") <= top_size(F.col("_rows"), f), F.col(label))).alias(f"c{i}")
            for i, f in enumerate(fractions)
        ],
    )
    rate = F.col("positives") / F.col("rows")
    entries = []
    for i, fraction in enumerate(fractions):
        captured, size = F.col(f"c{i}"), top_size(F.col("rows"), fraction)
        entries.append(
            F.struct(
                F.lit(float(fraction)).alias("fraction"),
                size.alias("n_selected"),
                captured.alias("n_captured"),
                rounded(zero_if_undefined(captured, F.col("positives"))).alias("capture_rate"),
                rounded(zero_if_undefined(captured, size)).alias("precision"),
                rounded(zero_if_undefined(captured / size, rate)).alias("lift"),
            )
        )
    return totals.select(F.inline(F.array(*entries)))


def spearman(
    scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of average ranks; a value most rows share does not pile up in one task."""
    ranked = scored
    for side, column in (("_ra", actual), ("_rp", predicted)):
        ranks = average_ranks(scored, column, by).withColumnRenamed("average_rank", side)
        ranked = spread_lookup(ranked, materialise(ranks), [*by, column], "n")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rp").alias("spearman"))


def regression_metrics(
    scored: DataFrame, actual: str, predicted: str, tie: str, by: Sequence[str]
) -> DataFrame:
    """One row per score set with every regression metric, at four decimals."""
    y, p = F.col(actual), F.col(predicted)
    rows = scored.select(*by, tie, actual, predicted)
    flat = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        (F.avg(p) / (F.avg(y) + RATIO_GUARD)).alias("prediction_to_actual_ratio"),
    )
    sizes = flat.select(*by, top_size(F.col("n_rows"), 0.10).alias("_top"))
    ranked = global_rank(rows, [p.desc(), F.col(tie)], by=by).join(sizes, list(by))
    capture = ranked.groupBy(*by).agg(
        (
            F.sum(F.when(F.col("rank") <= F.col("_top"), y).otherwise(0.0))
            / (F.sum(y) + RATIO_GUARD)
        ).alias("top_decile_value_capture")
    )
    names = [
        "mae", "rmse", "r2", "spearman", "mean_actual", "mean_predicted",
        "prediction_to_actual_ratio", "top_decile_value_capture",
    ]
    return (
        flat.join(spearman(rows, actual, predicted, by), list(by))
        .join(capture, list(by))
        .withColumns({n: rounded(F.col(n)) for n in names})
    )
