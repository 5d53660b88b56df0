"""Result shaping: pivot / unpivot (PVT1, PVT2), share of total (KPI4),
sentiment / target / profit bands (KPI1-KPI3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstar.functions.money import money

# Fixed values of the dashboard bands.
SENTIMENT_BANDS = ((0.5, "Very Positive"), (0.2, "Positive"), (0.0, "Neutral"),
                   (-0.2, "Negative"))
SENTIMENT_BAND_ELSE = "Very Negative"
FACE_BANDS = ((0.3, "happy"), (0.0, "neutral"))   # strictly greater than
FACE_ELSE = "sad"
GAUGE_BANDS = ((0.9, "green"), (0.7, "orange"))   # share of the gauge maximum
GAUGE_ELSE = "red"
GAUGE_STEPS = (0.5, 0.75)


def pivot(df: DataFrame, index: str, columns: str, values: str,
          column_values: list | None = None, prefix: str = "") -> DataFrame:
    """PVT1: one row per ``index``, one column per ``columns`` value.

    A duplicated (index, column) cell is an error (as in a pandas pivot);
    passing ``column_values`` avoids a pass to discover them.
    """
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"pivot: duplicate ({index}, {columns}) cells"))).otherwise(
        F.first(values))
    cells = df.groupBy(index, columns).agg(one.alias("_v"))
    p = cells.groupBy(index).pivot(columns, column_values).agg(F.first("_v"))
    if prefix:
        p = p.select(index, *[F.col(f"`{c}`").alias(f"{prefix}{c}")
                              for c in p.columns if c != index])
    return p


def unpivot(df: DataFrame, ids: list[str], measures: list[str],
            var: str = "metric", value: str = "value") -> DataFrame:
    """PVT2: wide -> long (id..., metric, value)."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return cast.unpivot(ids, measures, var, value)


def share_of_total(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """KPI4: value * 100 / total (a scalar subquery: no single-partition window)."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, money(F.try_divide(F.col(value) * 100.0, total)))


def sentiment_band(c) -> F.Column:
    expr = None
    for lo, label in SENTIMENT_BANDS:
        cond = c >= lo
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(SENTIMENT_BAND_ELSE)


def sentiment_face(c) -> F.Column:
    (hi, a), (mid, b) = FACE_BANDS
    return F.when(c > hi, a).when(c > mid, b).otherwise(FACE_ELSE)


def target_status(achievement_pct) -> F.Column:
    """KPI2: reached when >= 100 %."""
    return F.when(achievement_pct >= 100, "reached").otherwise("below")


def profit_status(profit) -> F.Column:
    return F.when(profit >= 0, "profit").otherwise("loss")


def gauge_band(value, maximum) -> F.Column:
    """KPI3: colour of a gauge needle relative to its maximum."""
    (g, a), (o, b) = GAUGE_BANDS
    return F.when(value >= maximum * g, a).when(value >= maximum * o, b).otherwise(GAUGE_ELSE)


def gauge_step(value, maximum) -> F.Column:
    """KPI3: which background step of the gauge the value falls in."""
    lo, mid = GAUGE_STEPS
    return F.when(value >= maximum * mid, "high").when(value >= maximum * lo, "mid").otherwise("low")


def sentiment_bands(dim_product: DataFrame) -> DataFrame:
    """Products per sentiment band (and face)."""
    s = F.col("avg_sentiment")
    return (dim_product.where(s.isNotNull())
            .groupBy(sentiment_band(s).alias("band"), sentiment_face(s).alias("face"))
            .agg(F.count(F.lit(1)).alias("product_count")))


def target_bands(store_ranking: DataFrame, maximum: float = 100.0) -> DataFrame:
    """Stores per gauge band of their target achievement."""
    a = F.col("target_achievement_pct")
    return (store_ranking.where(a.isNotNull())
            .groupBy(gauge_band(a, F.lit(maximum)).alias("band"),
                     gauge_step(a, F.lit(maximum)).alias("step"),
                     target_status(a).alias("status"))
            .agg(F.count(F.lit(1)).alias("store_count")))


def profit_bands(fact: DataFrame) -> DataFrame:
    """KPI2: stores by the sign of their net profit."""
    per = fact.groupBy("store_id").agg(F.sum("net_profit").alias("_p"))
    return (per.where("_p IS NOT NULL").groupBy(profit_status(F.col("_p")).alias("status"))
            .agg(F.count(F.lit(1)).alias("store_count"), money(F.sum("_p")).alias("net_profit")))
