"""Space-time panel, near-repeat counts, history profiles and the feature matrix."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.functions import labels
from hotgrid.operators import grid
from hotgrid.session import cut_lineage


def time_parts(incidents: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), month, year, weekend and night flags, shift, and the day."""
    ts = F.col("ts")
    return (
        incidents.withColumn("date", F.to_date(ts))
        .withColumn("hour", F.hour(ts))
        .withColumn("dow", F.weekday(ts))
        .withColumn("month", F.month(ts))
        .withColumn("year", F.year(ts))
        .withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
        .withColumn("is_night", ((F.col("hour") >= 22) | (F.col("hour") < 6)).cast("int"))
        .withColumn("shift", labels.shift_of(F.col("hour")))
    )


def daily_cell_counts(incidents: DataFrame) -> DataFrame:
    """Counts per (cell, day), in total and per shift: the small table everything else is built from."""
    shift = labels.shift_of(F.hour("ts"))
    return (
        incidents.where(F.col("ts").isNotNull())
        .groupBy("cell_id", F.to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(shift == s).alias(f"n{s}") for s in (0, 1, 2)])
    )


def active_days(incidents: DataFrame, min_cases: int = S.MIN_CASES_PER_CELL) -> tuple[DataFrame, DataFrame]:
    """Stored daily counts of the active cells, and the cells: one read of the incidents serves both."""
    shift = labels.shift_of(F.hour("ts"))
    counts = cut_lineage(
        incidents.groupBy("cell_id", F.to_date("ts").alias("date")).agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(shift == s).alias(f"n{s}") for s in (0, 1, 2)]
        )
    )
    cells = counts.groupBy("cell_id").agg(F.sum("n").alias("total_cases")).where(F.col("total_cases") >= min_cases)
    cells = cells.where(F.col("cell_id").isNotNull())
    return counts.where(F.col("date").isNotNull()).join(cells.select("cell_id"), "cell_id", "left_semi"), cells


def densify(daily: DataFrame, values: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Every day from ``first`` to ``last`` for every cell, zero where nothing is listed.

    Each listed day is stretched to the eve of the next one (the first one back to ``first``), so the
    calendar is filled inside one partitioning by cell, with no calendar join.
    """
    in_time = Window.partitionBy("cell_id").orderBy("date")
    spans = (
        daily.withColumn("_prev", F.lag("date").over(in_time))
        .withColumn("_next", F.lead("date").over(in_time))
        .withColumn("_from", F.when(F.col("_prev").isNull(), first).otherwise(F.col("date")))
        .withColumn("_to", F.coalesce(F.date_sub("_next", 1), last))
    )
    days = spans.select("cell_id", F.col("date").alias("_day"), *values, F.explode(F.sequence("_from", "_to")).alias("date"))
    here = F.col("date") == F.col("_day")
    return days.select("cell_id", "date", *[F.when(here, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values])


def _span(daily: DataFrame) -> tuple[Column, Column]:
    """First and last day, as one subquery."""
    span = daily.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    return span["first"], span["last"]


def panel(daily: DataFrame) -> DataFrame:
    """(cell, date, shift) for all cells of stored daily counts, all days between the first and last, all three shifts."""
    return split_shifts(densify(daily, ["n0", "n1", "n2"], *_span(daily)))


def split_shifts(days: DataFrame) -> DataFrame:
    """One row per shift from the per-shift count columns of a day."""
    parts = F.array(*[F.struct(F.lit(s).alias("shift"), F.col(f"n{s}").alias("n_crimes")) for s in (0, 1, 2)])
    return (
        days.select("*", F.explode(parts).alias("_p"))
        .select("*", "_p.shift", "_p.n_crimes")
        .drop("_p", "n0", "n1", "n2")
        .withColumn("has_crime", (F.col("n_crimes") > 0).cast("int"))
    )


def near_name(radius: float, days: int) -> str:
    return f"nr_{radius}km_{days}d"


def near_repeat_days(
    daily: DataFrame,
    cells: DataFrame,
    radii: Sequence[float] = S.NEAR_RADII_KM,
    windows: Sequence[int] = S.NEAR_WINDOWS_DAYS,
) -> DataFrame:
    """Dense (cell, date) rows with own shift counts and the near-repeat counts of every radius and window.

    One distance join at the largest radius carries the distance along; the sums per radius come out of
    one aggregation. Trailing windows exclude the day itself and are differences of running sums.
    """
    edges = grid.cells_within(cells.select("cell_id"), max(radii))
    around = [F.sum(F.when(F.col("km") <= r, F.col("n")).otherwise(0)).alias(f"_r{i}") for i, r in enumerate(radii)]
    own = F.col("cell_id") == F.col("nbr_id")
    mine = [F.sum(F.when(own, F.col(f"n{s}")).otherwise(0)).alias(f"n{s}") for s in (0, 1, 2)]
    first, last = _span(daily)
    sums = (
        edges.join(daily.withColumnRenamed("cell_id", "nbr_id"), "nbr_id")
        .groupBy("cell_id", "date")
        .agg(*around, *mine)
    )
    values = [f"_r{i}" for i in range(len(radii))]
    dense = densify(sums, [*values, "n0", "n1", "n2"], first, last)
    in_time = Window.partitionBy("cell_id").orderBy("date")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    for v in values:
        dense = dense.withColumn(v, F.coalesce(F.sum(v).over(so_far), zero))
    trailing = [
        (F.col(v) - F.coalesce(F.lag(v, w).over(in_time), zero)).alias(near_name(r, w))
        for v, r in zip(values, radii)
        for w in windows
    ]
    return dense.select("cell_id", "date", "n0", "n1", "n2", *trailing)


def split_of(date: Column, train_end: str, val_end: str) -> Column:
    return (
        F.when(date > F.lit(val_end).cast("date"), "test")
        .when(date > F.lit(train_end).cast("date"), "val")
        .otherwise("train")
    )


def history_cutoffs(train_end: str, val_end: str, reference_mode: bool = False, start: str | None = None) -> dict[str, str]:
    """Split -> exclusive end of the history its rows may see.

    Each history ends where its split begins, so no row sees its own period; training rows see what lies before
    ``start``. ``reference_mode`` gives training rows their whole window and the others everything before ``val_end``.
    """
    if reference_mode:
        return {"train": train_end, "val": val_end, "test": val_end}
    return {"train": start or "0001-01-01", "val": train_end, "test": val_end}


def history_profile(
    incidents: DataFrame,
    cutoffs: dict[str, str],
    violent: Sequence[int] = (1,),
    property_: Sequence[int] = (2, 3),
) -> DataFrame:
    """Per (split, cell): totals, severity and category shares, variety and entropy before the cutoff.

    One aggregation to (cell, category, band between cutoffs); the splits are then combined from those
    few rows. Entropy in bits is log2(T) - sum(n log2 n) / T.
    """
    ends = sorted(set(cutoffs.values()))
    day = F.to_date("ts")
    band = F.lit(len(ends))
    for i, end in reversed(list(enumerate(ends))):
        band = F.when(day < F.lit(end).cast("date"), F.lit(i)).otherwise(band)
    counts = (
        incidents.where(F.col("ts").isNotNull())
        .groupBy("cell_id", "category_id", band.alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity_id") == 1).alias("severe"))
    )
    splits = F.array(
        *[F.struct(F.lit(s).alias("split"), F.lit(ends.index(c)).alias("upto")) for s, c in cutoffs.items()]
    )
    by_cat = (
        counts.select("*", F.explode(splits).alias("s"))
        .where(F.col("band") <= F.col("s.upto"))
        .groupBy(F.col("s.split").alias("split"), "cell_id", "category_id")
        .agg(F.sum("n").alias("n"), F.sum("severe").alias("severe"))
    )
    n, total = F.col("n"), F.sum("n")
    share = lambda cond: F.sum(F.when(cond, n).otherwise(0)) / total
    return by_cat.groupBy("split", "cell_id").agg(
        total.alias("hist_total"),
        (F.sum("severe") / total).alias("hist_heinous_pct"),
        share(F.col("category_id").isin(*violent)).alias("hist_violent_pct"),
        share(F.col("category_id").isin(*property_)).alias("hist_property_pct"),
        F.count("category_id").alias("n_crime_types"),
        F.greatest(F.log2(total) - F.sum(n * F.log2(n)) / total, F.lit(0.0)).alias("crime_entropy"),
    )


def staff_per_cell(incidents: DataFrame, staff: DataFrame) -> DataFrame:
    """Staff counts placed at the cell where each station's first incident happened."""
    first_seen = F.struct("ts", "incident_id")
    station = incidents.groupBy("station_id").agg(F.min_by("cell_id", first_seen).alias("cell_id"))
    members = staff.groupBy(F.col("unit_id").alias("station_id")).agg(F.count(F.lit(1)).alias("n_staff"))
    joined = station.join(members, "station_id", "left")
    return joined.groupBy("cell_id").agg(F.coalesce(F.sum("n_staff"), F.lit(0)).alias("n_officers"))


def temporal_encodings(rows: DataFrame) -> DataFrame:
    """Calendar parts and cyclic encodings of (date, shift) rows, as 32-bit floats."""
    date, shift = F.col("date"), F.col("shift")
    turn = 2 * 3.141592653589793
    out = (
        rows.withColumn("dow", F.weekday(date))
        .withColumn("month", F.month(date))
        .withColumn("year", F.year(date))
        .withColumn("day_of_year", F.dayofyear(date))
        .withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
        .withColumn("is_night_shift", (shift == 2).cast("int"))
        .withColumn("is_morning_shift", (shift == 0).cast("int"))
        .withColumn("hour_proxy", shift * 8 + 4)
    )
    cycles = {"dow": F.col("dow") / 7, "month": (F.col("month") - 1) / 12, "hour": F.col("hour_proxy") / 24}
    for name, phase in cycles.items():
        out = out.withColumn(f"{name}_sin", F.sin(F.lit(turn) * phase).cast("float"))
        out = out.withColumn(f"{name}_cos", F.cos(F.lit(turn) * phase).cast("float"))
    return out


def sample_negatives(rows: DataFrame, rate: float = S.NEGATIVE_SAMPLE_RATE, seed: int = 42) -> DataFrame:
    """Keep all positives and a repeatable share of the negatives, chosen by arithmetic on the row key."""
    prime = 10_007
    key = F.col("cell_id") * 7_919 + F.unix_date("date") * 5_003 + F.col("shift") * 3_001 + F.lit(seed)
    mixed = F.pmod(F.pmod(key, F.lit(prime)) * (F.pmod(key, F.lit(prime)) + 17), F.lit(prime))
    return rows.where((F.col("has_crime") == 1) | (mixed < int(rate * prime)))


def feature_matrix(
    incidents: DataFrame,
    staff: DataFrame | None,
    train_end: str,
    val_end: str,
    reference_mode: bool = False,
    min_cases: int = S.MIN_CASES_PER_CELL,
    start: str | None = None,
) -> DataFrame:
    """The full (cell, date, shift) feature table over active cells: no row is left out, thinning is for fitting only."""
    daily, cells = active_days(incidents, min_cases)
    kept = incidents.join(cells.select("cell_id"), "cell_id", "left_semi")
    rows = split_shifts(near_repeat_days(daily, cells.select("cell_id")))
    rows = temporal_encodings(rows).withColumn("split", split_of(F.col("date"), train_end, val_end))
    rows = rows.join(history_profile(kept, history_cutoffs(train_end, val_end, reference_mode, start)), ["split", "cell_id"], "left")
    if staff is not None:
        rows = rows.join(staff_per_cell(kept, staff), "cell_id", "left")
    return rows.na.fill(0)


def decayed_risk(incidents: DataFrame, halflife_days: float = S.DECAY_HALFLIFE_DAYS) -> DataFrame:
    """Sum over a cell's incidents of 2^(-age in days / half-life), age counted from the last day seen."""
    daily = incidents.where(F.col("ts").isNotNull()).groupBy("cell_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    last = daily.agg(F.max("date")).scalar()
    age = F.datediff(last, F.col("date"))
    weight = F.exp(age * F.lit(-0.6931471805599453 / halflife_days))
    return daily.groupBy("cell_id").agg(F.sum(F.col("n") * weight).alias("fallback_risk"))


def risk_map(scored: DataFrame) -> DataFrame:
    """Mean and maximum score per cell, with the cell's position."""
    cells = scored.groupBy("cell_id").agg(F.avg("risk_score").alias("mean_risk"), F.max("risk_score").alias("max_risk"))
    return grid.with_position(cells)
