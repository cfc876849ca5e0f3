"""Daily counts and rolling anomalies kept up to date from a stream of incidents: the streaming form of the daily series."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hotgrid import settings as S
from hotgrid.operators.series import KEY, rolling_hits

DAY_MS = 86_400_000


def daily_counts(incidents: DataFrame, key: Sequence[str] = KEY, late: str = "2 days") -> DataFrame:
    """Counts per series and day; a day closes once the watermark has passed it."""
    timed = incidents.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 day").alias("w"), *key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*key, F.to_date("w.start").alias("date"), "n")


def rolling_anomalies(
    incidents: DataFrame, key: Sequence[str] = KEY, points: int = S.ROLLING_POINTS, threshold: float = S.ANOMALY_Z, late: str = "2 days"
) -> DataFrame:
    """Days at least ``threshold`` deviations from the mean of the previous ``points`` days, each told once it is closed.

    The state of a series is small: counts of the days that are still open, the counts of the last ``points`` closed days,
    and the day that comes next. A day closes when the watermark has passed its end (in UTC, as the sessions here); a
    timer wakes a series for that if no row does. Days without incidents count as zero once a later day closes, as the
    series in batch end with their last incident. Rows later than the watermark are left out.
    """
    key = list(key)
    timed = incidents.na.drop(subset=[*key, "ts"]).select(*key, F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late).withColumn("day", F.unix_date(F.to_date("ts")))
    fields = dict(timed.dtypes)
    ddl = ", ".join([*[f"`{c}` {fields[c]}" for c in key], "day int", "n bigint", "_s1 bigint", "_s2 bigint"])

    def close(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, days, counts, last = state.get if state.exists else (None, [], [], [])
        still_open, last = dict(zip(days, counts, strict=True)), list(last)
        for frame in frames:
            for day, n in frame["day"].value_counts().items():
                if following is None or day >= following:
                    still_open[int(day)] = still_open.get(int(day), 0) + int(n)
        passed = state.getCurrentWatermarkMs() // DAY_MS  # days before this one are closed
        out = []
        for day in sorted(d for d in still_open if d < passed):
            for at in range(day if following is None else following, day + 1):
                n = still_open.pop(at, 0)
                if len(last) == points:
                    out.append((*group, at, n, sum(last), sum(v * v for v in last)))
                last = [*last, n][-points:]
            following = day + 1
        state.update((following, list(still_open), list(still_open.values()), last))
        if still_open:
            state.setTimeoutTimestamp((min(still_open) + 1) * DAY_MS)
        yield pd.DataFrame(out, columns=[*key, "day", "n", "_s1", "_s2"])

    closed = timed.groupBy(*key).applyInPandasWithState(
        close, ddl, "following int, days array<int>, counts array<bigint>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    days = closed.withColumn("date", F.date_from_unix_date("day")).drop("day")
    return rolling_hits(days, key, points, threshold)
