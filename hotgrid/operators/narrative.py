"""Alert feeds, region briefs and report sentences."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.functions import labels

_SEVERITY_ORDER = ("critical", "high", "medium", "info")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in _SEVERITY_ORDER]), severity), F.lit(99))


def _item_severity() -> Column:
    return F.when(F.col("severity") == "critical", "critical").when(F.col("zscore") > 3, "high").otherwise("medium")


def alert_feed(feed: DataFrame, summary: DataFrame, n_anomalies: int | None = 12, n_regions: int | None = 5, min_yoy: float = 8) -> DataFrame:
    """Anomalies of the feed (first ``n_anomalies``) and rising regions, ordered by severity.

    Rising regions come in order of their total cases; ``None`` lifts a limit (the ticker's form).
    """
    up = F.col("zscore") > 0
    change = F.abs((F.col("observed") - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1.0)) * 100)
    kept = feed if n_anomalies is None else feed.where(F.col("rank") <= n_anomalies)
    # fixed values: alert titles and details
    anomalies = kept.select(
        F.lit("alert").alias("kind"),
        F.col("rank").alias("source_rank"),
        _item_severity().alias("severity"),
        F.concat(
            F.col("category_name"), F.lit(" "), F.when(up, "spike").otherwise("drop"), F.lit(" detected in "), F.col("region_name")
        ).alias("title"),
        F.concat(
            F.col("observed").cast("string"), F.lit(" observed vs "), F.format_string("%.0f", F.round("expected")), F.lit(" expected ("),
            F.when(up, "+").otherwise("-"), F.format_string("%.0f", F.round(change)), F.lit("%). Z-score: "),
            F.format_string("%.1f", F.round("zscore", 1)),
        ).alias("detail"),
        "region_name",
    )
    order = [F.desc("total_cases"), F.col("region_name")]
    rising = summary.where(F.col("yoy_change_pct") > min_yoy)
    if n_regions is not None:
        rising = rising.orderBy(*order).limit(n_regions)
    rising = rising.withColumn("source_rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    trends = rising.select(
        F.lit("trend").alias("kind"),
        "source_rank",
        F.when(F.col("yoy_change_pct") > 15, "high").otherwise("medium").alias("severity"),
        F.concat(F.col("region_name"), F.format_string(" crime trending +%.1f%% YoY", F.col("yoy_change_pct"))).alias("title"),
        F.concat(
            F.col("latest_year_cases").cast("string"), F.lit(" cases in "), F.col("latest_year").cast("string"),
            F.lit(", led by "), F.col("top_type"), F.format_string(". Heinous: %.1f%%", F.col("severe_pct")),
        ).alias("detail"),
        "region_name",
    )
    return ranked_alerts(anomalies.unionByName(trends))


def ranked_alerts(items: DataFrame) -> DataFrame:
    """Feed position by severity, anomalies before trends, each in its own order; a feed is a short list."""
    order = Window.orderBy(severity_rank(F.col("severity")), "kind", "source_rank")
    return items.withColumn("position", F.row_number().over(order).cast("bigint"))


def region_brief(summary: DataFrame, feed: DataFrame) -> DataFrame:
    """Level, trend, narrative and recommendation per region from its summary and its feed anomalies."""
    per = feed.groupBy("region_name").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.min_by(F.struct("category_name", "zscore"), "rank").alias("first"),
    )
    rows = summary.join(per, "region_name", "left").na.fill(0, ["n_alerts", "n_critical"])
    yoy = F.coalesce("yoy_change_pct", F.lit(0.0))
    rows = rows.withColumn("level", labels.region_level(F.col("n_alerts"), F.col("n_critical"), yoy)).withColumn(
        "trend", F.when(yoy > 2, "increasing").when(yoy < -2, "decreasing").otherwise("stable")
    )
    text = lambda c: F.col(c).cast("string")
    # fixed values: brief sentences
    narrative = F.concat(
        F.col("region_name"), F.lit(" recorded "), text("latest_year_cases"), F.lit(" FIRs in "), text("latest_year"),
        F.when(F.col("trend") == "increasing", F.format_string(", up %.1f%% year-over-year", yoy))
        .when(F.col("trend") == "decreasing", F.format_string(", down %.1f%% year-over-year", F.abs(yoy)))
        .otherwise(""),
        F.lit(". Top offence: "), F.col("top_type"), F.lit(" ("), text("top_type_count"), F.lit(" cases)."),
        F.when(F.col("severe_pct") > 10, F.format_string(" %.1f%% of cases are heinous offences.", F.col("severe_pct"))).otherwise(""),
        F.when(
            F.col("n_alerts") > 0,
            F.concat(F.lit(" "), text("n_alerts"), F.lit(" active anomaly alert"), F.when(F.col("n_alerts") > 1, "s").otherwise(""), F.lit(".")),
        ).otherwise(""),
    )
    recommendation = (
        F.when(
            F.col("level").isin("CRITICAL", "HIGH"),
            F.concat(
                F.lit("Increase patrol presence. Focus on "), F.col("top_type"), F.lit(" prevention."),
                F.when(
                    F.col("first").isNotNull(),
                    F.concat(
                        F.lit(" Priority: "), F.col("first.category_name"),
                        F.format_string(" spike (z=%.1f).", F.round("first.zscore", 1)),
                    ),
                ).otherwise(""),
            ),
        )
        .when(
            F.col("trend") == "increasing",
            F.concat(F.lit("Monitor "), F.col("top_type"), F.lit(" trend. Consider preventive deployment.")),
        )
        .otherwise(F.format_string("Maintain current deployment. Clearance rate: %.1f%%.", F.col("clearance_pct")))
    )
    return rows.select(
        "region_name", "level", "trend", F.col("yoy_change_pct").alias("trend_pct"), "n_alerts",
        narrative.alias("narrative"), recommendation.alias("recommendation"),
    )


def area_level(feed: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: alerts, mean yearly change and the resulting level."""
    n, yoy = feed.agg(F.count(F.lit(1))).scalar(), summary.agg(F.avg("yoy_change_pct")).scalar()
    row = feed.sparkSession.range(1).select(n.alias("n_alerts"), F.coalesce(yoy, F.lit(0.0)).alias("mean_yoy"))
    return row.withColumn("level", labels.threat_level(F.col("n_alerts"), F.col("mean_yoy")))


def _printed(v: Column, digits: int) -> Column:
    """As printf of C: rounded by the double's exact value, ties to even, where ``format_string`` goes by its decimal form."""
    return F.translate(F.format_number(v, digits), ",", "")


def model_sentence(auc: Column, hit_rate_5: Column, pai_5: Column, drivers: Column, undefined: str = "nan") -> Column:
    # without both classes there is no AUC: the sentence says ``undefined``, or is null if it is null
    shown = F.when(F.isnan(auc), undefined).when(auc.isNotNull(), _printed(auc, 2))
    # fixed value: model sentence
    return F.concat(
        F.lit("The model identifies "), _printed(hit_rate_5, 1), F.lit("% of future crime in just 5% of the area (AUC "), shown, F.lit("). "),
        F.lit("That is a "), _printed(pai_5, 1), F.lit("× improvement over random deployment. "),
        F.lit("Top prediction drivers: "), drivers, F.lit("."),
    )
