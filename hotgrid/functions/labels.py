"""Column functions that turn numbers into labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def significance(z: Column) -> Column:
    """Seven-way hot/cold label from a z-score (two-sided 90/95/99 %)."""
    out = F.lit("not_sig")
    for cut, level in ((1.645, "90"), (1.96, "95"), (2.576, "99")):
        out = F.when(z > cut, F.lit(f"hot_{level}")).when(z < -cut, F.lit(f"cold_{level}")).otherwise(out)
    return out


def significance_zp(z: Column, p: Column) -> Column:
    """Seven-way label when a p-value is at hand: p picks the level, the sign of z the side."""
    side = F.when(z > 0, F.lit("hot_")).otherwise(F.lit("cold_"))
    level = F.when(p <= 0.01, F.lit("99")).when(p <= 0.05, F.lit("95")).when(p <= 0.10, F.lit("90"))
    return F.coalesce(F.concat(side, level), F.lit("not_sig"))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    # fixed values: published coefficients
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = F.lit(a[4])
    for c in (a[3], a[2], a[1], a[0]):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def anomaly_severity(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 5, "critical").when(a >= 4, "high").when(a >= 3, "medium").otherwise("low")


def shift_of(hour: Column) -> Column:
    """0 = 06-14 h, 1 = 14-22 h, 2 = night."""
    return F.when(hour.between(6, 13), 0).when(hour.between(14, 21), 1).otherwise(2)


def threat_level(n_alerts: Column, yoy_pct: Column) -> Column:
    """Area-wide alert level from the number of anomalies and the mean yearly change."""
    return (
        F.when((n_alerts >= 8) | (yoy_pct > 15), "CRITICAL")
        .when((n_alerts >= 4) | (yoy_pct > 8), "HIGH")
        .when((n_alerts >= 2) | (yoy_pct > 3), "MEDIUM")
        .otherwise("LOW")
    )


def region_level(n_alerts: Column, n_critical: Column, yoy_pct: Column) -> Column:
    """Alert level of one region."""
    return (
        F.when((n_critical > 0) | (yoy_pct > 20), "CRITICAL")
        .when((n_alerts >= 3) | (yoy_pct > 10), "HIGH")
        .when((n_alerts >= 1) | (yoy_pct > 5), "MEDIUM")
        .otherwise("LOW")
    )


def safe_label(name: Column) -> Column:
    """File-name form of a label: spaces and slashes become underscores."""
    return F.translate(name, " /", "__")


def uplift_pct(value: Column, base: Column) -> Column:
    return F.when(base > 0, F.round((value - base) / base * 100, 1)).otherwise(F.lit(0.0))
