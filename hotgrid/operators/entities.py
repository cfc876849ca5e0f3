"""Entity tables: repeat entities, profiles, local rankings, region-to-region moves. Ids only, no scores."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.session import cut_lineage


def case_counts(bridge: DataFrame) -> DataFrame:
    """Distinct cases per entity."""
    rows = bridge.na.drop(subset=["entity_id"]).select("case_id", "entity_id").distinct()
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_cases"))


def repeat_entities(bridge: DataFrame, incidents: DataFrame, top: int = 100, shown: int = 5) -> DataFrame:
    """The entities with most cases, with up to ``shown`` categories and regions and the first and last day.

    The top list is cut before anything is joined to it.
    """
    best = case_counts(bridge).orderBy(F.desc("total_cases"), "entity_id").limit(top)
    rows = bridge.join(F.broadcast(best), "entity_id").select("entity_id", "total_cases", "case_id").distinct()
    facts = incidents.select(F.col("incident_id").alias("case_id"), "category_name", "region_name", "ts")
    first = lambda c: F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, shown), ", ")
    return (
        rows.join(facts, "case_id", "left")
        .groupBy("entity_id", "total_cases")
        .agg(
            first("category_name").alias("types"),
            first("region_name").alias("regions"),
            F.min("ts").alias("first_incident"),
            F.max("ts").alias("last_incident"),
        )
    )


def entity_cases(bridge: DataFrame, incidents: DataFrame) -> DataFrame:
    """Distinct (entity, case) with the incident's attributes."""
    rows = bridge.na.drop(subset=["entity_id"]).select("case_id", "entity_id").distinct()
    facts = incidents.select(
        F.col("incident_id").alias("case_id"), "category_name", "region_name", "severity_id", "ts"
    )
    return rows.join(facts, "case_id")


def entity_profiles(
    bridge: DataFrame, incidents: DataFrame, charged: DataFrame, edges: DataFrame, shown: int = 10, members: DataFrame | None = None
) -> DataFrame:
    """One row per entity: cases, charged cases, category and region counts, severity share, span, associates.

    Category and region maps are bounded by the number of categories and regions; associate lists by ``shown``. With
    ``members`` (rank, node) of the listed communities a row also has the rank of the entity's community, if any.
    """
    flag = charged.select("case_id").distinct().withColumn("charged", F.lit(1))
    rows = entity_cases(bridge, incidents).join(flag, "case_id", "left")
    cells = rows.groupBy("entity_id", "category_name", "region_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity_id") == 1).alias("severe"),
        F.count("charged").alias("charged"),
        F.max(F.when(F.col("charged") == 1, F.col("ts"))).alias("last_charged"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    cells = cut_lineage(cells)  # three branches read it
    base = cells.groupBy("entity_id").agg(
        F.sum("n").alias("total_cases"),
        F.sum("charged").alias("charged_cases"),
        F.max("last_charged").alias("last_charged"),
        F.count_distinct("region_name").alias("n_regions"),
        (F.sum("severe") / F.sum("n")).alias("severe_share"),
        F.min("first").alias("first_incident"),
        F.max("last").alias("last_incident"),
    )

    def ranked(col: str, name: str) -> DataFrame:
        per = cells.groupBy("entity_id", col).agg(F.sum("n").alias("n"))
        pairs = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(col).alias("label"), "n")))
        return per.groupBy("entity_id").agg(
            F.transform(pairs, lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias(name)
        )

    ends = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    counts = ends.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_associates"))
    top = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown)
    lists = top.groupBy(F.col("src").alias("entity_id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("r", F.col("dst").alias("entity"), F.col("weight").alias("shared_cases")))),
            lambda x: F.struct(x["entity"].alias("entity"), x["shared_cases"].alias("shared_cases")),
        ).alias("associates")
    )
    if members is not None:
        base = base.join(members.select(F.col("node").alias("entity_id"), F.col("rank").alias("community")), "entity_id", "left")
    return (
        base.join(ranked("category_name", "types"), "entity_id")
        .join(ranked("region_name", "regions"), "entity_id")
        .join(counts, "entity_id", "left")
        .join(lists, "entity_id", "left")
        .na.fill(0, ["n_associates"])
        .withColumn("span_years", F.round(F.datediff("last_incident", "first_incident") / 365.25, 1))
    )


def local_entities(bridge: DataFrame, incidents: DataFrame, top: int = 5) -> DataFrame:
    """Per region: entities with most cases there, then most cases overall (ties by id)."""
    rows = entity_cases(bridge, incidents)
    here = rows.groupBy("entity_id", "region_name").agg(F.count(F.lit(1)).alias("here"))
    overall = here.groupBy("entity_id").agg(F.sum("here").alias("overall"))
    order = Window.partitionBy("region_name").orderBy(F.desc("here"), F.desc("overall"), "entity_id")
    return (
        here.join(overall, "entity_id")
        .where(F.col("region_name").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top)
    )


def search(rows: DataFrame, text_col: str, volume_col: str, needle: str, top: int = 8, by_volume: bool = True) -> DataFrame:
    """Rows whose text contains ``needle`` in any case: largest first, or in name order."""
    hits = rows.where(F.contains(F.lower(text_col), F.lit(needle.strip().lower())))
    order = [F.desc(volume_col), F.col(text_col)] if by_volume else [F.col(text_col)]
    return hits.orderBy(*order).limit(top)


def region_moves(bridge: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per ordered region pair: moves of entities between consecutive cases, and distinct entities.

    An entity's cases are ordered by (time, case). They are cut into calendar months so that one busy
    entity spreads over many tasks; the step between months links the last and first case of each.
    """
    rows = entity_cases(bridge, incidents).where(F.col("region_name").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("entity_id", "region_name", F.trunc(F.to_date("ts"), "month").alias("month"), F.struct("ts", "case_id").alias("at"))
    inside = Window.partitionBy("entity_id", "month").orderBy("at")
    within = rows.select("entity_id", F.lag("region_name").over(inside).alias("from_region"), F.col("region_name").alias("to_region"))
    ends = rows.groupBy("entity_id", "month").agg(
        F.min_by("region_name", "at").alias("first_region"), F.max_by("region_name", "at").alias("last_region")
    )
    months = Window.partitionBy("entity_id").orderBy("month")
    across = ends.select("entity_id", F.lag("last_region").over(months).alias("from_region"), F.col("first_region").alias("to_region"))
    steps = within.unionByName(across).where(F.col("from_region").isNotNull() & (F.col("from_region") != F.col("to_region")))
    per = steps.groupBy("from_region", "to_region", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("from_region", "to_region").agg(F.sum("n").alias("n_transitions"), F.count(F.lit(1)).alias("n_entities"))


def mobility_summary(bridge: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: entities, entities seen in more than one region, and their share."""
    pairs = entity_cases(bridge, incidents).where(F.col("region_name").isNotNull()).select("entity_id", "region_name").distinct()
    per = pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(F.col("n") > 1).alias("multi_region"),
        F.round(F.count_if(F.col("n") > 1) / F.count(F.lit(1)) * 100, 1).alias("multi_region_pct"),
    )
