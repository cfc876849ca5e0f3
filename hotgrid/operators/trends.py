"""Regional summaries, period counts, breakdowns and cross-tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.functions import periods
from hotgrid.session import cut_lineage


def _pct(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits))


def region_summary(incidents: DataFrame) -> DataFrame:
    """Per region: totals, latest and prior year, yearly change, top category, severe and cleared shares.

    One pass over the incidents makes (region, category, year) counts; all else works on those.
    Ties for the top category go to the smaller name.
    """
    base = (
        incidents.where(F.col("region_name").isNotNull())
        .groupBy("region_name", "category_name", F.year("ts").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("severity_id") == 1).alias("severe"),
            F.count_if(F.col("status_id") >= 3).alias("cleared"),
        )
    )
    base = cut_lineage(base)  # regions by categories by years, read twice
    years = base.agg(F.sort_array(F.collect_set("year"), asc=False)).scalar()
    latest, prior = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    by_cat = base.groupBy("region_name", "category_name").agg(
        F.sum("n").alias("n"),
        F.sum("severe").alias("severe"),
        F.sum("cleared").alias("cleared"),
        F.sum(F.when(F.col("year") == latest, F.col("n")).otherwise(0)).alias("latest_n"),
        F.sum(F.when(F.col("year") == prior, F.col("n")).otherwise(0)).alias("prior_n"),
    )
    # the smaller name wins a tie: compare by (n, inverted name) through a second max over equal counts
    best = Window.partitionBy("region_name")
    ranked = by_cat.withColumn("top_n", F.max(F.when(F.col("category_name").isNotNull(), F.col("n"))).over(best))
    out = ranked.groupBy("region_name").agg(
        F.sum("n").alias("total_cases"),
        F.sum("latest_n").alias("latest_year_cases"),
        F.sum("prior_n").alias("prior_year_cases"),
        F.min(F.when(F.col("n") == F.col("top_n"), F.col("category_name"))).alias("top_type"),
        F.max("top_n").alias("top_type_count"),
        F.sum("severe").alias("severe_count"),
        F.sum("cleared").alias("cleared_count"),
    )
    return out.select(
        "region_name",
        "total_cases",
        latest.alias("latest_year"),
        "latest_year_cases",
        "prior_year_cases",
        F.when(
            F.col("prior_year_cases") > 0,
            F.round((F.col("latest_year_cases") - F.col("prior_year_cases")) / F.col("prior_year_cases") * 100, 1),
        ).alias("yoy_change_pct"),
        "top_type",
        "top_type_count",
        "severe_count",
        _pct(F.col("severe_count"), F.col("total_cases"), 1).alias("severe_pct"),
        _pct(F.col("cleared_count"), F.col("total_cases"), 1).alias("clearance_pct"),
    )


def period_counts(incidents: DataFrame) -> DataFrame:
    """Monthly and weekly counts overall, by category and by severity, in one long table."""
    ts = F.col("ts")
    both = F.array(
        F.struct(F.lit("M").alias("freq"), periods.month_period(ts).alias("period")),
        F.struct(F.lit("W").alias("freq"), periods.week_period(ts).alias("period")),
    )
    daily = (
        incidents.where(ts.isNotNull())
        .groupBy(F.to_date(ts).alias("ts"), "category_name", "severity_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    small = (
        daily.select("category_name", "severity_name", "n", F.explode(both).alias("p"))
        .groupBy("p", "category_name", "severity_name")
        .agg(F.sum("n").alias("n"))
    )
    views = F.array(
        F.struct(F.lit("overall").alias("dim"), F.lit("ALL").alias("label")),
        F.struct(F.lit("category").alias("dim"), F.col("category_name").alias("label")),
        F.struct(F.lit("severity").alias("dim"), F.col("severity_name").alias("label")),
    )
    return (
        small.select("p.*", "n", F.explode(views).alias("v"))
        .where(F.col("v.label").isNotNull())
        .groupBy("freq", F.col("v.dim").alias("dim"), F.col("v.label").alias("label"), "period")
        .agg(F.sum("n").alias("n"))
    )


def type_breakdown(incidents: DataFrame) -> DataFrame:
    """Category shares with severity mix, for all regions together ('ALL') and each region."""
    sev = F.col("severity_id")
    base = incidents.groupBy("region_name", "category_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sev == 1).alias("severe"),
        F.count_if(sev == 2).alias("standard"),
        F.count_if(sev == 3).alias("minor"),
    )
    scoped = (
        base.select("*", F.explode(F.array(F.lit("ALL"), F.col("region_name"))).alias("scope"))
        .where(F.col("scope").isNotNull())
        .groupBy("scope", "category_name")
        .agg(*[F.sum(c).alias(c) for c in ("n", "severe", "standard", "minor")])
        .withColumn("total", F.sum("n").over(Window.partitionBy("scope")))
        .where(F.col("category_name").isNotNull())
    )
    return scoped.select(
        "scope",
        "category_name",
        "n",
        _pct(F.col("n"), F.col("total"), 2).alias("pct"),
        *[_pct(F.col(c), F.col("n"), 1).alias(f"{c}_pct") for c in ("severe", "standard", "minor")],
    )


def region_trends(incidents: DataFrame, n_places: int = 5) -> DataFrame:
    """Per region and (category or ALL): monthly and yearly counts, busiest cells, total; long form."""
    kept = incidents.where(F.col("region_name").isNotNull() & F.col("category_name").isNotNull())
    both = F.explode(F.array(F.lit("ALL"), F.col("category_name"))).alias("type_label")
    monthly = (
        kept.groupBy("region_name", "category_name", periods.month_period(F.col("ts")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("region_name", both, "month", "n")
    )
    spans = F.explode(
        F.array(
            F.struct(F.lit("monthly").alias("kind"), F.col("month").alias("item")),
            F.struct(F.lit("yearly").alias("kind"), F.substring("month", 1, 4).alias("item")),
            F.struct(F.lit("total").alias("kind"), F.lit("total").alias("item")),
        )
    )
    over_time = (
        monthly.select("region_name", "type_label", "n", spans.alias("s"))
        .groupBy("region_name", "type_label", "s")
        .agg(F.sum("n").alias("n"))
        .select("region_name", "type_label", "s.kind", "s.item", "n")
    )
    busiest = Window.partitionBy("region_name", "type_label").orderBy(F.desc("n"), "cell_id")
    places = (
        kept.groupBy("region_name", "category_name", "cell_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("region_name", both, "cell_id", "n")
        .groupBy("region_name", "type_label", "cell_id")
        .agg(F.sum("n").alias("n"))
        .withColumn("r", F.row_number().over(busiest))
        .where(F.col("r") <= n_places)
        .select("region_name", "type_label", F.lit("place").alias("kind"), F.col("cell_id").cast("string").alias("item"), "n")
    )
    return over_time.unionByName(places)


def nest_region_trends(long: DataFrame) -> DataFrame:
    """One row per (region, type) with sorted monthly, yearly and place lists; lists are calendar-bounded."""

    def items(kind: str, by_count: bool = False) -> Column:
        order = F.struct((-F.col("n")).alias("k"), "item", "n") if by_count else F.struct("item", "n")
        kept = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, order)))
        return F.transform(kept, lambda x: F.struct(x["item"].alias("item"), x["n"].alias("count")))

    return long.groupBy("region_name", "type_label").agg(
        items("monthly").alias("monthly"),
        items("yearly").alias("yearly"),
        items("place", True).alias("top_places"),
        F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("total"),
    )


def trim_partial_tail(points: DataFrame, group: Sequence[str], period: str = "period", n: str = "n") -> DataFrame:
    """Drop trailing periods below half the (upper) median; series under eight points stay whole."""
    whole = Window.partitionBy(*group)
    in_time, by_size = whole.orderBy(period), whole.orderBy(n, period)
    ranked = (
        points.withColumn("_t", F.row_number().over(in_time))
        .withColumn("_r", F.row_number().over(by_size))
        .withColumn("_len", F.count(F.lit(1)).over(whole))
    )
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_len") / 2) + 1, F.col(n))).over(whole)
    ranked = ranked.withColumn("_median", median)
    last_full = F.max(F.when(F.col(n) >= F.col("_median") * 0.5, F.col("_t"))).over(whole)
    keep = (F.col("_len") < 8) | (F.col("_t") <= F.coalesce(F.col("_last"), F.lit(1)))
    return ranked.withColumn("_last", last_full).where(keep).drop("_t", "_r", "_len", "_median", "_last")


def crosstab(rows: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` x ``col`` with one column per declared value."""
    counts = rows.where(F.col(row).isNotNull()).groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def shares(rows: DataFrame, attribute: str) -> DataFrame:
    """Count and percentage of each attribute value."""
    counts = rows.where(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 2))


def attribute_profile(rows: DataFrame, group: str, attribute: str, measure: str) -> DataFrame:
    """Per group: rows, dominant attribute value with its share, and the median of a small-domain measure."""
    sizes = (
        rows.where(F.col(group).isNotNull() & F.col(attribute).isNotNull())
        .groupBy(group, attribute)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("top", F.max("n").over(Window.partitionBy(group)))
    )
    dominant = sizes.groupBy(group).agg(
        F.sum("n").alias("total"),
        F.min(F.when(F.col("n") == F.col("top"), F.col(attribute))).alias("dominant"),
        F.max("top").alias("dominant_n"),
    )
    values = rows.where(F.col(group).isNotNull() & F.col(measure).isNotNull()).groupBy(group, measure).agg(
        F.count(F.lit(1)).alias("w")
    )
    medians = values.groupBy(group).agg(F.expr(f"percentile({measure}, 0.5, w)").alias("median_value"))
    return dominant.join(medians, group, "left").select(
        group,
        "total",
        "dominant",
        F.round(F.col("dominant_n") / F.col("total") * 100, 1).alias("dominant_pct"),
        "median_value",
    )
