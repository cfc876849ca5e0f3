"""Joins and orderings that stay balanced when one key or one value holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.session import cut_lineage

HEAVY_SHARE = 0.001
HEAVY_MIN_ROWS = 1_000_000
SALTS = 32
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 64, 4096


def order_buckets(rows: int) -> int:
    """Range buckets that keep about ``ROWS_PER_BUCKET`` rows in each."""
    return max(MIN_BUCKETS, min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def heavy_keys(
    df: DataFrame, on: Sequence[str], share: float = HEAVY_SHARE, min_rows: int = HEAVY_MIN_ROWS
) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: never more than ``1/share`` of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where((F.col("_n") > total * F.lit(share)) & (F.col("_n") > min_rows)).select(*on)


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    salt_by: Sequence[str],
    counts_from: DataFrame | None = None,
    salts: int = SALTS,
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_MIN_ROWS,
    merge: bool = False,
) -> DataFrame:
    """Equi-join whose left side may hold hot keys.

    Rows of hot keys are spread over ``salts`` partitions by a hash of ``salt_by``; the matching right
    rows are repeated once per salt. The hot-key list has at most ``1/share`` rows, so it is broadcast.
    Hot keys are counted on ``left`` or, to spare a second evaluation, on a stored table with (at least)
    the same keys given as ``counts_from``. ``merge`` keeps the right side from being broadcast.
    """
    on = list(on)
    counted = left if counts_from is None else counts_from
    hot = F.broadcast(heavy_keys(counted, on, share, min_rows).withColumn("_hot", F.lit(True)))
    spread = left.join(hot, on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"),
    )
    copies = (
        right.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return spread.drop("_hot").join(copies.hint("merge") if merge else copies, [*on, "_salt"], how).drop("_salt")


def _order_buckets(df: DataFrame, value: str, tie: str | None, buckets: int) -> DataFrame:
    """Tag rows with (_pos, _eq, _sub) so that the tags sort like (value, tie).

    Values that are themselves a cut point get a bucket of their own, which is cut again by ``tie``;
    a value shared by many rows is therefore never sorted in one task.
    """
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = [F.array_distinct(F.percentile_approx(c, cuts, F.lit(10_000))).alias(f"b{i}") for i, c in enumerate([value, tie or value])]
    out = df.withColumn("_b", df.agg(F.struct(*bounds)).scalar())
    below = lambda arr, col: F.size(F.filter(arr, lambda b: b < F.col(col)))
    out = out.withColumn("_pos", below(F.col("_b.b0"), value))
    if tie is None:
        return out.drop("_b").withColumn("_eq", F.lit(0)).withColumn("_sub", F.lit(0))
    out = out.withColumn("_eq", F.array_contains("_b.b0", F.col(value)).cast("int"))
    sub = F.when(F.col("_eq") == 1, below(F.col("_b.b1"), tie)).otherwise(F.lit(0))
    return out.withColumn("_sub", sub).drop("_b")


_TAGS = ["_pos", "_eq", "_sub"]


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    tie: str | None = None,
    buckets: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Add ``before_<s>`` (sum of ``s`` over rows ordered strictly earlier) for each column in ``sums``.

    Rows are range-bucketed by ``value`` (then ``tie``); bucket totals are a table of bounded size whose
    running sum is broadcast back, and the sum inside a bucket is an ordinary window.
    The number of buckets follows the number of rows. Without ``tie`` the values must be distinct. The input is read three times, so it is written to the
    checkpoint folder first unless the caller says it already is.
    """
    df = df if written else cut_lineage(df)
    buckets = buckets or order_buckets(df.count())
    tagged = _order_buckets(df, value, tie, buckets)
    totals = tagged.groupBy(*_TAGS).agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    over_buckets = Window.orderBy(*_TAGS).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *_TAGS, *[F.coalesce(F.sum(f"_s_{s}").over(over_buckets), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = (
        Window.partitionBy(*_TAGS).orderBy(value, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = tagged.join(F.broadcast(offsets), _TAGS)
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop(*_TAGS, *[f"_o_{s}" for s in sums])


def global_row_number(
    df: DataFrame, value: str, tie: str, name: str = "rn", buckets: int | None = None, written: bool = False
) -> DataFrame:
    """Row number over (value, tie) ascending without putting the whole table into one task."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), value, ["_one"], tie, buckets, written)
    return out.withColumn(name, F.col("before__one") + 1).drop("_one", "before__one")


def percent_rank_avg(df: DataFrame, value: str, name: str = "pct_rank", buckets: int | None = None) -> DataFrame:
    """Share-of-rows rank where tied values get the average of their positions."""
    df = cut_lineage(df)
    sizes = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_m")))
    ranked = running_totals(sizes, value, ["_m"], buckets=buckets, written=True)
    n = sizes.agg(F.sum("_m")).scalar()
    ranks = ranked.select(value, ((F.col("before__m") + (F.col("_m") + 1) / 2) / n).alias(name))
    return skew_safe_join(df, ranks, [value], "left", [c for c in df.columns if c != value] or [value])
