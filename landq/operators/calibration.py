"""Expected calibration error, isotonic and logistic calibration and auto-accept precision."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.text import round_to
from landq.session import written

EXACT = "decimal(28,10)"
#: Labelled rows that a fit looks at; of more, each counts with the same chance.
FIT_ROWS = 1_000_000
LOWEST, HIGHEST = 0.05, 0.99
NEWTON_STEPS, RIDGE = 8, 1.0


def calibration_bins(scored: DataFrame, n_bins: int, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """bin, n, and exact sums of confidence and label. A confidence of 1 belongs to the last bin."""
    index = F.least(F.lit(n_bins - 1), F.floor(F.col(confidence) * n_bins)).cast("int")
    return scored.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(confidence).cast(EXACT)).alias("sum_confidence"),
        F.sum(F.col(label).cast(EXACT)).alias("sum_label"),
    )


def expected_error(bins: DataFrame) -> DataFrame:
    """Weighted mean gap between confidence and accuracy: n * |mean gap| = |gap of sums|."""
    gap = F.abs(F.col("sum_confidence") - F.col("sum_label"))
    return bins.agg((F.sum(gap).cast("double") / F.sum("n")).alias("ece"), F.sum("n").alias("samples"))


def ece(scored: DataFrame, n_bins: int, confidence: str = "confidence", label: str = "label") -> DataFrame:
    return expected_error(calibration_bins(scored, n_bins, confidence, label))


def auto_accept(scored: DataFrame, threshold: float, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """precision of the accepted part, its share in percent; nothing accepted counts as precise."""
    accepted = F.col(confidence) >= threshold
    return scored.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(accepted).alias("accepted"),
        F.sum(F.when(accepted, F.col(label).cast(EXACT))).alias("_right"),
    ).select(
        "samples",
        "accepted",
        F.coalesce(F.try_divide(F.col("_right").cast("double"), F.col("accepted").cast("double")), F.lit(1.0)).alias("precision"),
        F.try_divide(F.col("accepted") * 100.0, F.col("samples").cast("double")).alias("automation_pct"),
    )


def fit_isotonic(scored: DataFrame, confidence: str = "confidence", label: str = "label", fit_rows: int = FIT_ROWS):
    """Isotonic model of the scores as they are; equal ones merge to one weighted point first.

    The fit looks at ``fit_rows`` labelled rows, or as good as that by chance if there are more; prediction at all rows.
    """
    rows = scored.count()
    if rows > fit_rows:
        scored = scored.filter(F.rand(17) < fit_rows / rows)
    points = scored.groupBy(F.col(confidence).alias("score")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"),
        (F.sum(F.col(label).cast(EXACT)).cast("double") / F.count(F.lit(1))).alias("accuracy"),
    )
    features = VectorAssembler(inputCols=["score"], outputCol="features").transform(points)
    return IsotonicRegression(
        featuresCol="features", labelCol="accuracy", weightCol="weight", predictionCol="calibrated"
    ).fit(features)


def fit_logistic(
    scored: DataFrame, confidence: str = "confidence", label: str = "label", steps: int = NEWTON_STEPS, ridge: float = RIDGE
) -> tuple[float, float]:
    """(intercept, slope) of the logistic curve of the score: Newton steps, each over five sums of all rows.

    Equal scores merge to one weighted point first. The ridge keeps the curve finite where scores tell labels apart.
    """
    points = scored.groupBy(F.col(confidence).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast(EXACT)).cast("double").alias("t"))
    points = written(points, "points")
    a = b = 0.0
    for _ in range(steps):
        p = F.lit(1.0) / (F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))) + 1.0)
        gap, weight = F.col("t") - F.col("n") * p, F.col("n") * p * (F.lit(1.0) - p)
        sums = points.select(gap.alias("g"), weight.alias("h"), "x").agg(
            F.sum("g"), F.sum(F.col("g") * F.col("x")), F.sum("h"), F.sum(F.col("h") * F.col("x")), F.sum(F.col("h") * F.col("x") * F.col("x"))
        )
        g0, g1, h00, h01, h11 = (v or 0.0 for v in sums.first())
        g0, g1, h00, h11 = g0 - ridge * a, g1 - ridge * b, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        a, b = a + (g0 * h11 - g1 * h01) / det, b + (g1 * h00 - g0 * h01) / det
    return a, b


def calibrate_logistic(scored: DataFrame, confidence: str = "confidence", label: str = "label", steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds calibrated by the fitted logistic curve, within [0.05, 0.99]: for scores that an isotonic fit cannot serve."""
    a, b = fit_logistic(scored, confidence, label, steps)
    curve = F.lit(1.0) / (F.exp(-(F.lit(a) + F.lit(b) * F.col(confidence))) + 1.0)
    return scored.withColumn("calibrated", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.round(curve, 9))))


def calibrate(scored: DataFrame, confidence: str = "confidence", label: str = "label") -> DataFrame:
    """Adds calibrated, the isotonic value of the score within [0.05, 0.99]."""
    model = fit_isotonic(scored, confidence, label)
    features = VectorAssembler(inputCols=["_score"], outputCol="features")
    out = model.transform(features.transform(scored.withColumn("_score", F.col(confidence))))
    # twelve digits: pooled means don't depend on the order in which they were added up
    value = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.round("calibrated", 12)))
    return out.withColumn("calibrated", value).select(*scored.columns, "calibrated")


def calibration_report(scored: DataFrame, threshold: float = 0.90, n_bins: int = 8, fit=calibrate) -> DataFrame:
    """One row: errors before and after, reduction, precision and automation at the threshold."""
    fitted = fit(scored)
    before = ece(fitted, n_bins).select(F.col("ece").alias("ece_pre"), F.lit(1).alias("_k"))
    after = ece(fitted, n_bins, "calibrated").select(F.col("ece").alias("ece_post"), F.lit(1).alias("_k"))
    accept = auto_accept(fitted, threshold, "calibrated").withColumn("_k", F.lit(1))
    reduction = (F.col("ece_pre") - F.col("ece_post")) / F.greatest(F.lit(1e-5), F.col("ece_pre")) * 100.0
    return before.join(after, "_k").join(accept, "_k").select(
        "samples",
        round_to(F.col("ece_pre"), 4).alias("ece_pre"),
        round_to(F.col("ece_post"), 4).alias("ece_post"),
        round_to(reduction, 1).alias("reduction_pct"),
        round_to(F.col("precision"), 4).alias("auto_accept_precision"),
        round_to(F.col("automation_pct"), 1).alias("automation_pct"),
    )
