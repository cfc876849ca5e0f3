"""Ranking, concentration and calibration metrics of scores."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.operators.scale import global_row_number, running_totals
from hotgrid.session import cut_lineage


def ranking_metrics(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: n, positive rate, ROC AUC (ties averaged), average precision and Brier score.

    Rows collapse to one per distinct score first; the order statistics come from bucketed running sums. As in the SQL, a figure
    that needs both classes is NaN where rows of one class are missing, and AUC is null without any positive row.
    """
    by_score = cut_lineage(
        scored.where(F.col(p).isNotNull())
        .groupBy(F.col(p).alias("p"))
        .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum((1 - F.col(y)).cast("bigint")).alias("neg"))
    )
    totals = by_score.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    r = running_totals(by_score, "p", ["pos", "neg"], written=True).withColumn("_t", totals)
    pos, neg, all_pos, all_neg = F.col("pos"), F.col("neg"), F.col("_t.pos"), F.col("_t.neg")
    at_or_above_pos = all_pos - F.col("before_pos")
    at_or_above_neg = all_neg - F.col("before_neg")
    none = F.lit(math.nan)
    pairs, above = all_pos * all_neg, at_or_above_pos + at_or_above_neg
    auc = F.when(pairs != 0, pos * (F.col("before_neg") + neg / 2) / pairs).when(all_pos != 0, none)
    precision = F.when(all_pos != 0, pos / all_pos * (at_or_above_pos / above)).otherwise(none)
    return r.agg(
        F.coalesce(F.sum(pos + neg), F.lit(0)).alias("n"),
        (F.sum(pos) / F.sum(pos + neg)).alias("pos_rate"),
        F.sum(auc).alias("auc"),
        F.sum(precision).alias("avg_precision"),
        (F.sum(pos * F.pow(1 - F.col("p"), 2) + neg * F.pow("p", 2)) / F.sum(pos + neg)).alias("brier"),
    )


def reliability_curve(scored: DataFrame, y: str = "y", p: str = "p", tie: str = "id", bins: int = 10) -> DataFrame:
    """Equal-count bins of rows ordered by (score, id): mean score, positive share, share of rows."""
    rows = cut_lineage(scored.select(F.col(p).alias("p"), F.col(y).alias("y"), F.col(tie).alias("tie")))
    n = rows.agg(F.count(F.lit(1))).scalar()
    rows = global_row_number(rows, "p", "tie", written=True)
    rows = rows.withColumn("n", n)
    q, extra = F.floor(F.col("n") / bins), F.col("n") % bins
    wide = extra * (q + 1)
    # the first n % bins bins hold one row more
    bin_no = F.when(F.col("rn") <= wide, F.ceil(F.col("rn") / (q + 1))).otherwise(
        extra + F.ceil((F.col("rn") - wide) / F.greatest(q, F.lit(1)))
    )
    return (
        rows.groupBy(bin_no.cast("bigint").alias("bin"))
        .agg(F.avg("p").alias("conf"), F.avg("y").alias("acc"), (F.count(F.lit(1)) / F.first("n")).alias("frac"))
    )


def expected_calibration_error(curve: DataFrame) -> Column:
    """Weighted mean gap between score and positive share, as a scalar subquery."""
    return curve.agg(F.sum(F.col("frac") * F.abs(F.col("acc") - F.col("conf")))).scalar()


def _test_cells(scored: DataFrame) -> DataFrame:
    """Mean score and incident count per cell of the test split; means are cut to 12 digits so that the
    order of cells does not depend on summation order."""
    cells = scored.where(F.col("split") == "test").groupBy("cell_id")
    return cut_lineage(
        cells.agg(F.round(-F.avg("risk_score"), 12).alias("neg_risk"), F.sum("n_crimes").alias("crimes"))
    )


def _hits(cells: DataFrame, order: str, pcts: Sequence[int], name: str) -> DataFrame:
    ranked = global_row_number(cells, order, "cell_id", written=True)
    n = cells.agg(F.count(F.lit(1))).scalar()
    total = cells.agg(F.sum("crimes")).scalar()
    ranked = ranked.withColumn("_n", n).withColumn("_total", total)
    cut = lambda pct: F.greatest(F.lit(1), F.floor(F.col("_n") * pct / 100))
    one = ranked.agg(
        F.first("_total").alias("total"),
        *[F.sum(F.when(F.col("rn") <= cut(pct), F.col("crimes")).otherwise(0)).alias(f"c{pct}") for pct in pcts],
    )
    pairs = F.array(*[F.struct(F.lit(pct).alias("area_pct"), F.col(f"c{pct}").alias("hits")) for pct in pcts])
    share = F.when(F.col("total") > 0, F.col("x.hits") / F.col("total") * 100).otherwise(0.0)
    # without any cell the SQL has no rows
    one = one.where(F.col("total").isNotNull())
    return one.select("total", F.explode(pairs).alias("x")).select(F.col("x.area_pct").alias("area_pct"), share.alias(name))


def accuracy_index(scored: DataFrame, pcts: Sequence[int] = S.AREA_PCTS) -> DataFrame:
    """PAI and hit rate per area share: percent of test incidents in the top cells, over the percent of area."""
    return _accuracy(_test_cells(scored), pcts)


def _round2(c: Column) -> Column:
    """Two digits as the SQL rounds: the hundredfold as a double. ``F.round`` goes by the decimal form, so 1.005 would differ."""
    return F.round(c * 100) / 100


def _accuracy(cells: DataFrame, pcts: Sequence[int]) -> DataFrame:
    hits = _hits(cells, "neg_risk", pcts, "hit_pct")
    return hits.select(
        "area_pct",
        _round2(F.col("hit_pct") / F.col("area_pct")).alias("pai"),
        _round2(F.col("hit_pct")).alias("hit_rate"),
        "hit_pct",
    )


def efficiency_index(scored: DataFrame, pcts: Sequence[int] = S.AREA_PCTS) -> DataFrame:
    """PEI: rounded PAI over the best PAI any ordering of the same cells can reach."""
    cells = _test_cells(scored)
    best = _hits(cells.withColumn("neg_crimes", -F.col("crimes")), "neg_crimes", pcts, "best_pct")
    return (
        _accuracy(cells, pcts)
        .join(best, "area_pct")
        .select(
            "area_pct",
            F.round(
                F.when(F.col("best_pct") > 0, F.col("pai") / (F.col("best_pct") / F.col("area_pct"))).otherwise(0.0), 4
            ).alias("pei"),
        )
    )


def top_share(cells: DataFrame, value: str, pct: float = 5.0) -> DataFrame:
    """The highest ``ceil(n * pct / 100)`` cells by value (ties by cell id)."""
    cells = cut_lineage(cells)
    ranked = global_row_number(cells.withColumn("_neg", -F.col(value)), "_neg", "cell_id", "position", written=True)
    n = cells.agg(F.count(F.lit(1))).scalar()
    return ranked.where(F.col("position") <= F.ceil(n * F.lit(pct) / 100)).drop("_neg")
