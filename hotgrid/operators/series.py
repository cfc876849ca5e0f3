"""Daily series per (region, category): anomalies, changepoints, feed, outlook, emerging cells, sprees."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import labels, periods
from hotgrid.session import cut_lineage

KEY = ("region_name", "category_name")


def daily_series(incidents: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Daily counts, zero-filled between the first and last day of each series.

    Counts are aggregated first; each counted day is then stretched up to the next one, so gaps are
    filled without joining a calendar, and later windows reuse the partitioning by series.
    """
    key = list(key)
    counts = (
        incidents.na.drop(subset=[*key, "ts"])
        .groupBy(*key, F.to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return fill_days(counts, key)


def fill_days(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    following = F.lead("date").over(Window.partitionBy(*key).orderBy("date"))
    stretched = counts.withColumn("_next", F.coalesce(F.date_sub(following, 1), F.col("date")))
    return stretched.select(
        *key, F.col("date").alias("_first"), "n", F.explode(F.sequence("date", "_next")).alias("date")
    ).select(*key, "date", F.when(F.col("date") == F.col("_first"), F.col("n")).otherwise(F.lit(0)).alias("n"))


def _scored_days(df: DataFrame, key: Sequence[str], expected: Column, residual: Column, z: Column) -> DataFrame:
    return df.select(
        *key,
        "date",
        F.col("n").alias("observed"),
        F.round(expected, 2).alias("expected"),
        F.round(residual, 2).alias("residual"),
        F.round(z, 2).alias("zscore"),
        labels.anomaly_severity(z).alias("severity"),
    )


def rolling_anomalies(
    series: DataFrame, key: Sequence[str] = KEY, points: int = S.ROLLING_POINTS, threshold: float = S.ANOMALY_Z
) -> DataFrame:
    """Days at least ``threshold`` deviations from the mean of the previous ``points`` days.

    Works on integer sums, z = (w*x - S1) / sqrt(w*S2 - S1^2), so the test itself is exact.
    """
    in_time = Window.partitionBy(*key).orderBy("date")
    x = F.col("n")
    # running sums up to the day before; their difference at distance ``points`` is the trailing sum
    so_far = in_time.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    df = (
        series.withColumn("_w", F.row_number().over(in_time) - 1)
        .withColumn("_c1", F.coalesce(F.sum("n").over(so_far), zero))
        .withColumn("_c2", F.coalesce(F.sum(x * x).over(so_far), zero))
        .withColumn("_s1", F.col("_c1") - F.lag("_c1", points).over(in_time))
        .withColumn("_s2", F.col("_c2") - F.lag("_c2", points).over(in_time))
    )
    return rolling_hits(df.where(F.col("_w") >= points), key, points, threshold)


def rolling_hits(days: DataFrame, key: Sequence[str], points: int, threshold: float) -> DataFrame:
    """The anomalous ones of days with count ``n`` and the trailing sums ``_s1`` of counts and ``_s2`` of their squares."""
    x = F.col("n")
    spread = F.lit(points) * F.col("_s2") - F.col("_s1") * F.col("_s1")
    lift = F.lit(points) * x - F.col("_s1")
    hit = days.where((spread > 0) & (lift * lift >= spread * F.lit(threshold * threshold)))
    mean = F.col("_s1") / points
    return _scored_days(hit, key, mean, x - mean, lift / F.sqrt(spread))


def seasonal_anomalies(
    series: DataFrame,
    key: Sequence[str] = KEY,
    period: int = S.SEASON_DAYS,
    threshold: float = S.ANOMALY_Z,
    min_days: int = 60,
) -> DataFrame:
    """Residual anomalies after removing a centred moving mean and the mean of each weekday.

    z is the residual over its population deviation, not re-centred. Series shorter than ``min_days``
    use the rolling test; series without any residual spread give nothing.
    """
    whole = Window.partitionBy(*key)
    centred = whole.orderBy("date").rowsBetween(-(period // 2), period // 2)
    df = (
        series.withColumn("_len", F.count(F.lit(1)).over(whole))
        .withColumn("_trend", F.avg("n").over(centred))
        .withColumn("_slot", F.pmod(F.unix_date("date"), F.lit(period)))
    )
    by_slot = Window.partitionBy(*key, "_slot")
    df = df.where(F.col("_len") >= min_days).withColumn("_detrended", F.col("n") - F.col("_trend"))
    df = df.withColumn("_season", F.avg("_detrended").over(by_slot) - F.avg("_detrended").over(whole))
    df = df.withColumn("_resid", F.col("_detrended") - F.col("_season"))
    df = df.withColumn("_sd", F.stddev_pop("_resid").over(whole))
    z = F.col("_resid") / F.col("_sd")
    hit = df.where((F.col("_sd") > 1e-9) & (F.abs(F.col("_resid")) >= F.col("_sd") * threshold))
    out = _scored_days(hit, key, F.col("_trend") + F.col("_season"), F.col("_resid"), z)
    short = series.withColumn("_len", F.count(F.lit(1)).over(whole)).where(F.col("_len") < min_days).drop("_len")
    return out.unionByName(rolling_anomalies(short, key, threshold=threshold))


def anomaly_cases(incidents: DataFrame, anomalies: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The incidents behind each anomalous day, one row per incident (no per-day lists to outgrow a row)."""
    days = anomalies.select(*key, "date")
    return incidents.select(*key, F.to_date("ts").alias("date"), "incident_id").join(days, [*key, "date"])


def changepoints(
    series: DataFrame,
    key: Sequence[str] = KEY,
    n_breaks: int = 5,
    min_size: int = 14,
    top_series: int | None = None,
    jump: int = 1,
) -> DataFrame:
    """Binary segmentation of all series (or of the ``top_series`` busiest) under squared-error cost, with 7-day change size.

    Every round scores all admissible splits of all series from prefix sums and keeps the best one per
    series by a window maximum, so the rounds share one partitioning and need no join or action.
    """
    key = list(key)
    if top_series is not None:
        volume = series.groupBy(*key).agg(F.sum("n").alias("volume"))
        series = series.join(volume.orderBy(F.desc("volume"), *key).limit(top_series).select(*key), key, "left_semi")
    whole = Window.partitionBy(*key)
    in_time = whole.orderBy("date")
    pts = (
        series.withColumn("t", F.row_number().over(in_time) - 1)
        .withColumn("c", F.coalesce(F.sum("n").over(in_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("e", F.count(F.lit(1)).over(whole).cast("int"))
        .where(F.col("e") >= 2 * n_breaks + 2)
        .withColumn("ce", F.sum("n").over(whole))
        .withColumn("before", F.avg("n").over(in_time.rowsBetween(-7, -1)))
        .withColumn("after", F.avg("n").over(in_time.rowsBetween(0, 6)))
        .withColumn("s", F.lit(0))
        .withColumn("cs", F.lit(0).cast("bigint"))
        .withColumn("round", F.lit(None).cast("int"))
    )
    left_n, right_n = F.col("t") - F.col("s"), F.col("e") - F.col("t")
    left_sum, right_sum, both = F.col("c") - F.col("cs"), F.col("ce") - F.col("c"), F.col("ce") - F.col("cs")
    gain = left_sum * left_sum / left_n + right_sum * right_sum / right_n - both * both / (left_n + right_n)
    allowed = (left_n >= min_size) & (right_n >= min_size) & (left_n % jump == 0)
    for r in range(1, n_breaks + 1):
        candidate = F.when(
            allowed, F.struct(gain.alias("gain"), (-F.col("t")).alias("nt"), F.col("c").alias("c"), F.col("s").alias("s"))
        )
        pts = pts.withColumn("b", F.max(candidate).over(whole))
        bt = -F.col("b.nt")
        inside = F.col("b").isNotNull() & (F.col("s") == F.col("b.s"))
        first, second = inside & (F.col("t") < bt), inside & (F.col("t") >= bt)
        pts = pts.select(
            *key, "date", "t", "c", "before", "after",
            F.when(second, bt).otherwise(F.col("s")).alias("s"),
            F.when(first, bt).otherwise(F.col("e")).alias("e"),
            F.when(second, F.col("b.c")).otherwise(F.col("cs")).alias("cs"),
            F.when(first, F.col("b.c")).otherwise(F.col("ce")).alias("ce"),
            F.when(F.col("t") == bt, F.lit(r)).otherwise(F.col("round")).alias("round"),
        )
    change = F.col("after") - F.col("before")
    return pts.where(F.col("round").isNotNull() & (F.col("t") >= 7)).select(
        *key,
        F.col("date").alias("changepoint_date"),
        "round",
        F.when(change > 0, "increase").otherwise("decrease").alias("direction"),
        F.round(F.abs(change), 2).alias("magnitude"),
    )


def describe_anomaly(key: Sequence[str] = KEY) -> Column:
    region, category = key
    # fixed value: sentence shown for an anomaly
    return F.concat(
        F.lit("Unusual "),
        F.when(F.col("zscore") > 0, "spike").otherwise("drop"),
        F.lit(" in "), F.col(category),
        F.lit(" cases in "), F.col(region),
        F.lit(" on "), F.col("date").cast("string"),
        F.lit(": observed "), F.col("observed").cast("string"),
        F.lit(" vs expected "), F.col("expected").cast("string"),
        F.lit(" (z-score "), F.col("zscore").cast("string"), F.lit(")."),
    )


def anomaly_feed(
    anomalies: DataFrame, key: Sequence[str] = KEY, top: int = S.FEED_SIZE, bucket_days: int = S.FEED_BUCKET_DAYS
) -> DataFrame:
    """Strongest anomaly per series and fixed day bucket, then the ``top`` strongest, ranked and described."""
    key = list(key)
    bucket = F.floor(periods.ordinal_day(F.col("date")) / bucket_days)
    order = F.struct(F.abs("zscore").alias("a"), (-F.unix_date("date")).alias("d"))
    cols = ["date", "observed", "expected", "zscore", "severity"]
    kept = (
        anomalies.groupBy(*key, bucket.alias("bucket"))
        .agg(F.max_by(F.struct(*cols), order).alias("r"))
        .select(*key, "r.*")
    )
    strongest = [F.desc(F.abs("zscore")), *key, F.col("date")]
    top_rows = kept.orderBy(*strongest).limit(top)
    return top_rows.withColumn("rank", F.row_number().over(Window.orderBy(*strongest)).cast("bigint")).withColumn(
        "description", describe_anomaly(key)
    )


def mappable(anomalies: DataFrame, region: str = "region_name", excluded: Sequence[str] = S.NON_TERRITORIAL) -> DataFrame:
    """Anomalies with a territory and with positive observed and expected counts."""
    return anomalies.where(~F.col(region).isin(*excluded) & (F.col("observed") > 0) & (F.col("expected") > 0))


def outlook(anomalies: DataFrame, top: int = 6) -> DataFrame:
    """Direction and confidence per category from its spikes and drops; the most confident first."""
    per = anomalies.groupBy("category_name").agg(
        F.count_if(F.col("zscore") > 0).alias("spikes"),
        F.count_if(F.col("zscore") <= 0).alias("drops"),
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("region_name").alias("regions"),
    )
    direction = (
        F.when(F.col("spikes") > F.col("drops"), "up").when(F.col("drops") > F.col("spikes"), "down").otherwise("stable")
    )
    plural = lambda c: F.when(c != 1, "s").otherwise("")
    detail = F.concat(
        F.col("spikes").cast("string"), F.lit(" spike"), plural(F.col("spikes")),
        F.lit(" across "), F.col("regions").cast("string"), F.lit(" region"), plural(F.col("regions")),
    )
    return (
        per.select(
            "category_name",
            direction.alias("direction"),
            F.least(F.lit(95), F.lit(50) + 8 * F.col("total")).cast("bigint").alias("confidence"),
            detail.alias("detail"),
        )
        .orderBy(F.desc("confidence"), "category_name")
        .limit(top)
    )


def emerging_cells(incidents: DataFrame, recent_months: int = 6, alpha: float = 0.05, min_cases: int = 5) -> DataFrame:
    """Mann-Kendall trend of monthly counts per cell with recent and earlier monthly means.

    The rule set is this library's own: 'new' = nothing before the recent months; 'intensifying' and
    'cooling' = significant trend up or down; 'persistent' = cases in at least half of all months.
    A cell's months form one array of calendar-bounded length, so no pairs of rows are produced.
    """
    month = (F.year("ts") * 12 + F.month("ts") - 1).cast("int")
    counts = incidents.where(F.col("ts").isNotNull()).groupBy("cell_id", month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)  # cells by months, read twice
    span = counts.agg(F.struct(F.min("m").alias("first"), F.max("m").alias("last"))).scalar()
    cells = counts.groupBy("cell_id").agg(
        F.map_from_entries(F.collect_list(F.struct("m", F.col("n").cast("int")))).alias("by_month"),
        F.sum("n").alias("total_cases"),
    )
    cells = cells.where(F.col("total_cases") >= min_cases)
    zero = F.lit(0)
    dense = F.transform(F.sequence("m0", "m1"), lambda m: F.coalesce(F.try_element_at("by_month", m), zero))
    # exploding a one-row array keeps the optimizer from copying the expression into each of its uses
    cells = cells.withColumn("m0", span["first"]).withColumn("m1", span["last"]).withColumn("x", F.explode(F.array(dense)))
    cells = cells.withColumn("k", F.size("x")).where(F.col("k") > recent_months)

    def later(i: Column) -> Column:
        rest = F.slice("x", i + 2, F.col("k"))
        here = F.element_at("x", i + 1)
        return F.aggregate(rest, zero, lambda a, v: a + F.when(v > here, 1).when(v < here, -1).otherwise(0))

    times = lambda v: F.size(F.filter("x", lambda w: w == v)).cast("bigint")
    sizes = F.transform(F.array_distinct("x"), times)
    mean_of = lambda arr, n: F.aggregate(arr, zero, lambda a, v: a + v) / n
    facts = F.struct(
        F.aggregate(F.sequence(zero, F.col("k") - 2), zero, lambda a, i: a + later(i)).alias("s"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, t: a + t * (t - 1) * (2 * t + 5)).alias("ties"),
        mean_of(F.slice("x", -recent_months, recent_months), F.lit(recent_months)).alias("recent_monthly"),
        mean_of(F.slice("x", F.lit(1), F.col("k") - recent_months), F.col("k") - recent_months).alias("hist_monthly"),
        F.size(F.filter("x", lambda v: v > 0)).alias("busy"),
    )
    cells = cells.select("cell_id", "total_cases", "k", F.explode(F.array(facts)).alias("f"))
    cells = cells.select("cell_id", "total_cases", "k", "f.*")
    k, s = F.col("k").cast("bigint"), F.col("s")
    var = (k * (k - 1) * (2 * k + 5) - F.col("ties")) / 18
    z = F.when(var > 0, (s - F.signum(s.cast("double"))) / F.sqrt(var)).otherwise(F.lit(0.0))
    cells = cells.withColumn("tau", s / (k * (k - 1) / 2)).withColumn("p", labels.normal_two_sided_p(z))
    category = (
        F.when((F.col("hist_monthly") == 0) & (F.col("recent_monthly") > 0), "new")
        .when((F.col("p") <= alpha) & (F.col("tau") > 0), "intensifying")
        .when((F.col("p") <= alpha) & (F.col("tau") < 0), "cooling")
        .when(F.col("busy") * 2 >= F.col("k"), "persistent")
    )
    return cells.select(
        "cell_id", category.alias("category"), "tau", "p", "recent_monthly", "hist_monthly", "total_cases"
    )
