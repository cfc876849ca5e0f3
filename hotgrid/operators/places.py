"""Polygons as edge tables, point clipping, centroids, name crosswalks, and chained incident sprees."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotgrid.functions import spatial
from hotgrid.operators import graph
from hotgrid.session import cut_lineage


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges (poly_id, x1, y1, x2, y2) from vertices (poly_id, ring_id, seq, lon, lat); rings close themselves."""
    ring = Window.partitionBy("poly_id", "ring_id")
    order = ring.orderBy("seq")
    start = ring.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(start))
    out = vertices.select("poly_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt("lon").alias("x2"), nxt("lat").alias("y2"))
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def polygons(spark: SparkSession, rings: dict[str, Sequence[Sequence[tuple[float, float]]]]) -> DataFrame:
    """Edge table of a few literal polygons: name -> rings of (lon, lat)."""
    rows = [
        (poly, ring, seq, float(lon), float(lat))
        for poly, parts in rings.items()
        for ring, points in enumerate(parts)
        for seq, (lon, lat) in enumerate(points)
    ]
    return ring_edges(spark.createDataFrame(rows, "poly_id string, ring_id int, seq int, lon double, lat double"))


def clip_points(points: DataFrame, edges: DataFrame, buffer_deg: float = 0.01, band_deg: float = 0.1) -> DataFrame:
    """Rows of ``points`` (lon, lat) inside any polygon or within ``buffer_deg`` of its border.

    Positions are made distinct, matched with edges of the same latitude band (an equi-join), and decided
    by the parity of crossings to the right or by nearness to an edge. Rows then pick up the verdict.
    """
    x, y = F.col("lon"), F.col("lat")
    band = lambda v: F.floor(v / band_deg)
    spots = points.select("lon", "lat").distinct().withColumn("band", band(y))
    low, high = F.least("y1", "y2") - buffer_deg, F.greatest("y1", "y2") + buffer_deg
    banded = edges.select("*", F.explode(F.sequence(band(low), band(high))).alias("band"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    t = F.least(
        F.greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)), F.lit(0.0)), F.lit(1.0)
    )
    near = F.pow(x - (x1 + t * (x2 - x1)), 2) + F.pow(y - (y1 + t * (y2 - y1)), 2) <= buffer_deg * buffer_deg
    tested = spots.join(banded, "band").groupBy("lon", "lat", "poly_id").agg(
        F.count_if(crosses).alias("n"), F.max(near.cast("int")).alias("close")
    )
    inside = tested.where((F.col("n") % 2 == 1) | (F.col("close") == 1)).select("lon", "lat").distinct()
    return points.join(inside, ["lon", "lat"], "left_semi")


def centroids(edges: DataFrame) -> DataFrame:
    """Area centroid of each polygon; where that falls outside, the middle of the widest stretch of the
    polygon on the horizontal line through the middle of its extent."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    area = edges.groupBy("poly_id").agg(
        F.sum(cross).alias("a"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"),
        ((F.min("y1") + F.max("y1")) / 2).alias("mid"),
    )
    centre = area.select(
        "poly_id", "mid", (F.col("sx") / (3 * F.col("a"))).alias("cx"), (F.col("sy") / (3 * F.col("a"))).alias("cy")
    )
    joined = edges.join(centre, "poly_id")
    y1, y2 = F.col("y1"), F.col("y2")
    at = lambda y: (F.col("x2") - F.col("x1")) * (y - y1) / (y2 - y1) + F.col("x1")
    hit = lambda y: (y1 > y) != (y2 > y)
    inside = joined.groupBy("poly_id").agg(
        (F.count_if(hit(F.col("cy")) & (F.col("cx") < at(F.col("cy")))) % 2 == 1).alias("is_inside")
    )
    by_x = Window.partitionBy("poly_id").orderBy("x")
    line = (
        joined.where(hit(F.col("mid")))
        .select("poly_id", "mid", at(F.col("mid")).alias("x"))
        .withColumn("i", F.row_number().over(by_x))
        .withColumn("next_x", F.lead("x").over(by_x))
        .where(F.col("i") % 2 == 1)
    )
    widest = line.groupBy("poly_id").agg(
        F.max_by((F.col("x") + F.col("next_x")) / 2, F.struct(F.col("next_x") - F.col("x"), -F.col("x"))).alias("ix"), F.first("mid").alias("iy")
    )
    return centre.join(inside, "poly_id").join(widest, "poly_id", "left").select(
        "poly_id",
        F.round(F.when(F.col("is_inside"), F.col("cx")).otherwise(F.col("ix")), 5).alias("lon"),
        F.round(F.when(F.col("is_inside"), F.col("cy")).otherwise(F.col("iy")), 5).alias("lat"),
        "is_inside",
    )


def outlines(points: DataFrame, key: str = "region_name") -> DataFrame:
    """Octagonal outline of each group's positions in micro-degrees: one aggregation, then eight corners."""
    x, y = F.col("lon_e6"), F.col("lat_e6")
    box = points.groupBy(F.col(key).alias("poly_id")).agg(
        F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"),
        F.min(x + y).alias("sl"), F.max(x + y).alias("sh"), F.min(x - y).alias("dl"), F.max(x - y).alias("dh"),
    )
    corners = [
        ("sl - yl", "yl"), ("dh + yl", "yl"), ("xh", "xh - dh"), ("xh", "sh - xh"),
        ("sh - yh", "yh"), ("dl + yh", "yh"), ("xl", "xl - dl"), ("xl", "sl - xl"),
    ]
    array = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), (F.expr(a) / 1_000_000).alias("lon"), (F.expr(b) / 1_000_000).alias("lat"))
            for i, (a, b) in enumerate(corners)
        ]
    )
    return box.select("poly_id", F.lit(0).alias("ring_id"), F.explode(array).alias("c")).select("poly_id", "ring_id", "c.*")


def match_names(names: DataFrame, known: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Match ``names.name`` to ``known.known``: explicit list, else same text, else one is a prefix of the other.

    Comparison ignores case. Prefixes are matched by an equi-join on all prefixes of the longer name.
    Among several matches of a kind the explicit order, else the smallest known name, wins.
    """
    left = names.select("name", F.upper(F.trim("name")).alias("up")).distinct()
    right = known.select("known", F.upper("known").alias("kup")).distinct()

    def heads(df: DataFrame, col: str) -> DataFrame:
        cuts = F.transform(F.sequence(F.lit(1), F.length(col)), lambda n: F.substring(F.col(col), F.lit(1), n))
        return df.where(F.length(col) > 0).select("*", F.explode(cuts).alias("head"))

    found = left.join(right, F.col("up") == F.col("kup")).select("name", "known", F.lit(2).alias("method"), F.lit(0).alias("place"))
    longer = heads(right, "kup").join(left, F.col("head") == F.col("up"))
    shorter = heads(left, "up").join(right, F.col("head") == F.col("kup"))
    for part in (longer, shorter):
        found = found.unionByName(part.select("name", "known", F.lit(3).alias("method"), F.lit(0).alias("place")))
    if explicit is not None:
        listed = explicit.select(F.upper("name").alias("up"), F.upper("known").alias("kup"), "place")
        hits = left.join(listed, "up").join(right, "kup")
        found = found.unionByName(hits.select("name", "known", F.lit(1).alias("method"), "place"))
    best = found.groupBy("name").agg(F.min(F.struct("method", "place", "known")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.col("b.known").alias("known"), F.col("b.method").alias("method"))


def sprees(
    incidents: DataFrame, km: float = 1.0, days: int = 7, min_cases: int = 3, grain_e6: int = 1_000
) -> tuple[DataFrame, DataFrame]:
    """Chains of same-subtype incidents, each link at most ``km`` and ``days`` apart: (summary, members).

    Incidents first collapse to places (a grain of about 100 m) and days. Days are cut into blocks of ``days`` + 1 and places
    into squares whose diagonal is under ``km``: what lies in one square and block is linked throughout, so that is one vertex of
    the chains, and its first and last day at each place decide every link to the following block. Places are paired through
    (subtype, tile, block) buckets, whose size is bounded by the grain, then the squares are chained as connected components.
    """
    if not 500 <= grain_e6 <= 10_000 * km:
        raise ValueError("grain_e6 must be at least 500 (ids hold 14 bits per axis) and at most a hundredth of a degree per km")
    lat0, lon0 = 11_000_000, 73_000_000
    gy = F.floor((F.col("lat_e6") - lat0) / grain_e6).cast("bigint")
    gx = F.floor((F.col("lon_e6") - lon0) / grain_e6).cast("bigint")
    spots = (
        incidents.where(F.col("ts").isNotNull() & F.col("subtype_id").isNotNull())
        .groupBy("subtype_id", gy.alias("gy"), gx.alias("gx"), F.unix_date(F.to_date("ts")).cast("bigint").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # place, day and subtype fit one 63-bit id that sorts by subtype, then day; so do square, block and subtype
    packed = lambda t, y, x: ((F.col("subtype_id") * 65_536 + t) * 16_384 + y) * 16_384 + x
    block = F.floor(F.col("day") / (days + 1))
    # a degree is at most 111.2 km; one part in a hundred is left for rounding
    side = 1 + int(0.99 * km / (111.2e-6 * grain_e6 * math.sqrt(2)))
    square = packed(block, F.floor(F.col("gy") / side), F.floor(F.col("gx") / side))
    spots = spots.withColumn("node", packed(F.col("day"), F.col("gy"), F.col("gx"))).withColumn("square", square)
    spots = cut_lineage(spots)
    stays = cut_lineage(
        spots.groupBy("square", "subtype_id", "gy", "gx", block.alias("block")).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    )
    reach = int(1_000_000 * 0.01 * km) // grain_e6
    near = [-1, 0, 1]
    # within a block each pair of tiles is met once
    moves = [(a, b, w) for a in near for b in near for w in (0, 1) if w or (a, b) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in moves])
    ty, tx = F.floor(F.col("gy") / reach), F.floor(F.col("gx") / reach)
    seek = stays.select("*", F.explode(steps).alias("s")).select(
        "subtype_id", "square", "gy", "gx", "last", F.col("s.w").alias("w"),
        (ty + F.col("s.a")).alias("ty"), (tx + F.col("s.b")).alias("tx"), (F.col("block") + F.col("s.w")).alias("block"),
    )
    hold = stays.select(
        "subtype_id", ty.alias("ty"), tx.alias("tx"), "block",
        F.col("square").alias("square2"), F.col("gy").alias("gy2"), F.col("gx").alias("gx2"), "first",
    )
    deg = lambda c, base: (F.lit(base) + F.col(c) * grain_e6) / 1_000_000
    dist = spatial.haversine_km(deg("gy", lat0), deg("gx", lon0), deg("gy2", lat0), deg("gx2", lon0))
    soon = (F.col("square") != F.col("square2")) & ((F.col("w") == 0) | (F.col("first") - F.col("last") <= days))
    links = seek.join(hold.hint("merge"), ["subtype_id", "ty", "tx", "block"]).where(soon & (dist <= km))
    links = links.select(F.least("square", "square2").alias("src"), F.greatest("square", "square2").alias("dst")).distinct()
    chain = graph.components(links).withColumnRenamed("node", "square")
    placed = spots.join(chain.hint("merge"), "square", "left").withColumn("chain", F.coalesce("component", "square"))
    lat, lon = deg("gy", lat0), deg("gx", lon0)
    summary = placed.groupBy("chain", "subtype_id").agg(
        F.min("node").alias("spree_id"),
        F.sum("n").alias("n_cases"),
        F.min("day").alias("d0"),
        F.max("day").alias("d1"),
        (F.sum(lat * F.col("n")) / F.sum("n")).alias("center_lat"),
        (F.sum(lon * F.col("n")) / F.sum("n")).alias("center_lon"),
    )
    kept = summary.where(F.col("n_cases") >= min_cases)
    members = placed.join(kept.select("chain", "spree_id").hint("merge"), "chain").select(
        "spree_id", lat.alias("lat"), lon.alias("lon"), F.date_from_unix_date(F.col("day").cast("int")).alias("date"), "n"
    )
    kept = kept.select(
        "spree_id", "subtype_id", "n_cases",
        F.date_from_unix_date(F.col("d0").cast("int")).alias("start_date"), F.date_from_unix_date(F.col("d1").cast("int")).alias("end_date"),
        (F.col("d1") - F.col("d0")).alias("span_days"), "center_lat", "center_lon",
    )
    return kept, members
