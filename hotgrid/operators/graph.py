"""Co-occurrence graph of entities sharing cases: construction, centrality, components, communities.

Edges are undirected rows (src < dst, weight). Iterative operators write their state to the checkpoint
folder each round and read back one scalar to decide whether to go on.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from hotgrid import settings as S
from hotgrid.operators.scale import HEAVY_MIN_ROWS, skew_safe_join
from hotgrid.session import cut_lineage, discard

# rows of a case up to which its entities are gathered without being made distinct before
LISTED_ROWS = 1_000


def case_members(bridge: DataFrame, cap: int = S.MAX_ENTITIES_PER_CASE) -> DataFrame:
    """Distinct (case, entity) rows of cases with at most ``cap`` entities; rows without ids are dropped."""
    rows = cut_lineage(bridge.na.drop(subset=["case_id", "entity_id"]).select("case_id", "entity_id").distinct())
    small = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select("case_id")
    return skew_safe_join(rows, small, ["case_id"], "left_semi", ["entity_id"])


def cooccurrence_edges(
    bridge: DataFrame, cap: int = S.MAX_ENTITIES_PER_CASE, min_cases: int = 2, min_weight: int = 1, groups: DataFrame | None = None
) -> DataFrame:
    """Edges between entities seen in the same case; weight = number of shared cases.

    Oversized cases go first. What is left of a case has at most ``cap`` entities, so its pairs are made from one small array.
    Entities seen in fewer than ``min_cases`` of these cases leave with their edges.

    With ``groups`` (rank, node) only edges inside a group are given, with its ``rank``: pairs of different groups are never
    written or shuffled. Cases and entities are judged by all their rows all the same. Where a node is listed more than once,
    all edges are made and joined with the groups.
    """
    if groups is not None:
        per = groups.groupBy("node").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        if (per["most"] or 0) > 1:
            return inner_edges(cut_lineage(cooccurrence_edges(bridge, cap, min_cases, min_weight)), groups)
        return _inner_edges_of(bridge, cap, min_cases, min_weight, groups, per["n"] or 0)
    cases = cut_lineage(_case_lists(bridge, cap))
    pairs = F.flatten(
        F.transform(
            "m",
            lambda a, i: F.transform(
                F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("src"), b.alias("dst"))
            ),
        )
    )
    edges = cases.select(F.explode(pairs).alias("p")).groupBy("p.src", "p.dst").agg(F.count(F.lit(1)).alias("weight"))
    edges = edges.where(F.col("weight") >= min_weight)
    if min_cases > 1:
        seen = cases.select(F.explode("m").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
        rare = cut_lineage(seen.where(F.col("n") < min_cases).select("e"))
        n = rare.count()
        rare = F.broadcast(rare) if n <= LISTED_ROWS * 100 else rare.hint("merge")
        for end in ("src", "dst") if n else ():
            edges = edges.join(rare, F.col(end) == F.col("e"), "left_anti")
    return edges


def _inner_edges_of(bridge: DataFrame, cap: int, min_cases: int, min_weight: int, groups: DataFrame, n_groups: int) -> DataFrame:
    """(rank, src, dst, weight) inside the groups; the entities of a case are gathered with their groups."""
    lists = _case_lists(bridge, cap)
    cases = cut_lineage(lists.select(F.explode("m").alias("node"), "case_id"))
    kept = cases
    if min_cases > 1:
        seen = cases.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        rare = cut_lineage(seen.where(F.col("n") < min_cases).select("node"))
        n = rare.count()
        if n:
            kept = kept.join(F.broadcast(rare) if n <= LISTED_ROWS * 100 else rare.hint("merge"), "node", "left_anti")
    listed = groups.select("node", "rank")
    placed = kept.join(listed.hint("merge") if n_groups > LISTED_ROWS * 500 else listed, "node")
    # a case has at most ``cap`` entities, so its part in a group is a small array
    parts = placed.groupBy("case_id", "rank").agg(F.sort_array(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    pairs = F.flatten(
        F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    )
    edges = parts.select("rank", F.explode(pairs).alias("p")).groupBy("rank", "p.src", "p.dst").agg(F.count(F.lit(1)).alias("weight"))
    return edges.where(F.col("weight") >= min_weight)


def _case_lists(bridge: DataFrame, cap: int) -> DataFrame:
    """(case_id, m): the distinct entities, sorted, of every case that has at most ``cap`` of them.

    Rows are counted before they are gathered. Cases of more than ``LISTED_ROWS`` rows are made distinct first, and only those
    that then have few entities are gathered, so no list can outgrow its task.
    """
    rows = bridge.na.drop(subset=["case_id", "entity_id"]).select("case_id", "entity_id")
    limit = max(LISTED_ROWS, cap)
    long = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("case_id")
    long = cut_lineage(long)
    repeated = cut_lineage(skew_safe_join(rows, long, ["case_id"], "left_semi", ["entity_id"]).distinct()) if long.count() else None
    if repeated is not None:
        few = repeated.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select("case_id")
        repeated = skew_safe_join(repeated, few, ["case_id"], "left_semi", ["entity_id"])
        rows = skew_safe_join(rows, long, ["case_id"], "left_anti", ["entity_id"]).unionByName(repeated)
    lists = rows.groupBy("case_id").agg(F.sort_array(F.collect_set("entity_id")).alias("m"))
    return lists.where(F.size("m") <= cap)


def both_ways(edges: DataFrame, scope: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Each edge in both directions."""
    turned = edges.select(*scope, F.col("dst").alias("src"), F.col("src").alias("dst"), *extra)
    return edges.select(*scope, "src", "dst", *extra).unionByName(turned)


def degrees(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Neighbours per vertex; vertices without edges do not appear."""
    ends = both_ways(edges, scope)
    return ends.groupBy(*scope, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    deg = degrees(edges)
    n = deg.agg(F.count(F.lit(1))).scalar()
    return deg.withColumn("centrality", F.col("degree") / F.greatest(n - 1, F.lit(1)))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` vertices of highest degree, ranked from 1 (ties by id)."""
    best = degrees(edges).orderBy(F.desc("degree"), "node").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node")))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, salt_by: Sequence[str], big: bool) -> DataFrame:
    """Plain join while no key can be hot, salted join beyond that size; neither side is ever broadcast.

    The size of a written state is that of its compressed files, so the optimizer would send millions of rows through the driver.
    """
    return skew_safe_join(left, right, on, how, salt_by, min_rows=HEAVY_MIN_ROWS, merge=True) if big else left.join(right.hint("merge"), list(on), how)


def eigenvector(edges: DataFrame, max_iter: int = 100, tol: float = 1e-6, fixed: bool = False) -> DataFrame:
    """Eigenvector centrality by power iteration on (A + I), unit length.

    Stops when the summed change is below ``n * tol`` and raises if ``max_iter`` steps do not suffice; ``fixed`` runs
    exactly ``max_iter`` steps. Every step is written once, before its length is taken, so no step is evaluated again; both
    sides of its join are files, so the adaptive optimizer cuts hot vertices.
    """
    sym = cut_lineage(both_ways(edges))
    x = sym.select(F.col("src").alias("node")).distinct()
    n = x.agg(F.count(F.lit(1))).scalar()
    x, states = x.withColumn("x", 1 / n), []
    for _ in range(max_iter):
        pulled = sym.join(x.select(F.col("node").alias("src"), "x").hint("merge"), "src")
        raw = (
            pulled.select(F.col("dst").alias("node"), "x")
            .unionByName(x.select("node", "x"))
            .groupBy("node")
            .agg(F.sum("x").alias("raw"))
        )
        raw = cut_lineage(raw)
        states.append(raw)
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0]
        new = raw.select("node", (F.col("raw") / F.lit(norm).cast("double")).alias("x"))
        if not fixed:
            old = x.withColumnRenamed("x", "old").hint("merge")
            done = new.join(old, "node").agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("c"), F.count(F.lit(1)).alias("n")).first()
        x = new
        discard(*states[:-1])
        del states[:-1]
        if not fixed and (not done["n"] or done["c"] < done["n"] * tol):
            break
    else:
        if not fixed:
            raise RuntimeError(f"eigenvector centrality did not converge in {max_iter} steps: change {done['c']}")
    return x.withColumnRenamed("x", "eigenvector")


def components(edges: DataFrame, scope: Sequence[str] = (), max_rounds: int = 40, contract_above: int = 200_000) -> DataFrame:
    """(scope, node, component): component is the smallest node id reachable, within each scope.

    A table of more than ``contract_above`` edges is contracted once: every vertex becomes its smallest neighbour (or itself), so
    the rounds that follow run on the few edges between these. Alternating large-star and small-star steps (Kiveris et al. 2014)
    then shrink the edges to stars around the smallest ids in a logarithmic number of rounds; hot vertices are salted once the
    edge table is large.
    """
    scope = list(scope)
    cur = cut_lineage(edges.select(*scope, F.col("src").alias("u"), F.col("dst").alias("v")).where(F.col("u") != F.col("v")))
    n = cur.count()
    if n <= contract_above:
        return _stars(cur, n, scope, max_rounds)
    sym = cur.unionByName(cur.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut_lineage(sym.groupBy(*scope, "u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    low_v = low.select(*scope, F.col("u").alias("v"), F.col("m").alias("mv"))
    met = cur.join(low.hint("merge"), [*scope, "u"]).select(*scope, "v", "m").join(low_v.hint("merge"), [*scope, "v"])
    met = met.where(F.col("m") != F.col("mv")).select(*scope, F.greatest("m", "mv").alias("u"), F.least("m", "mv").alias("v"))
    met = cut_lineage(met.distinct())
    labels = _stars(met, met.count(), scope, max_rounds).withColumnRenamed("node", "m")
    placed = low.join(labels.hint("merge"), [*scope, "m"], "left")
    return placed.select(*scope, F.col("u").alias("node"), F.coalesce("component", "m").alias("component"))


def _stars(cur: DataFrame, n: int, scope: Sequence[str], max_rounds: int) -> DataFrame:
    """Components of a written table of ``n`` edges (scope, u, v) without loops."""
    key = [*scope, "u"]

    def settled(df: DataFrame) -> tuple[int, bool]:
        """Row count, and whether every vertex has one parent that is itself no child."""
        ends = df.select(*scope, F.col("u").alias("w"), F.lit(1).alias("child")).unionByName(
            df.select(*scope, F.col("v").alias("w"), F.lit(0).alias("child"))
        )
        per = ends.groupBy(*scope, "w").agg(F.sum("child").alias("up"), F.min("child").alias("parent"))
        row = per.agg(
            F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("parent") == 0))).alias("open")
        ).first()
        return row["n"] or 0, not row["open"]

    done = False
    for _ in range(max_rounds):
        big = n > HEAVY_MIN_ROWS
        sym = cur.unionByName(cur.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy(*key).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            _join(sym, low, key, "inner", ["v"], big)
            .where(F.col("v") > F.col("u"))
            .select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        down = large.select(*scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy(*key).agg(F.min("v").alias("m"))
        linked = _join(down, low2, key, "inner", ["v"], big).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low2.select(*scope, "u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        cur = cut_lineage(small)
        n, done = settled(cur)
        if done:
            break
    if not done:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(*scope, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(*scope, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def component_sizes(labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*scope, "component").agg(F.count(F.lit(1)).alias("size"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weighted modularity of a labelling (node, community)."""
    strength = both_ways(edges, extra=["weight"]).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    per = strength.join(labels, "node").groupBy("community").agg(F.sum("k").alias("d"))
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    tagged = edges.join(a, "src").join(b, "dst")
    inner = tagged.where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("l"))
    m = edges.agg(F.sum("weight").cast("double")).scalar()
    rows = per.join(inner, "community", "left").withColumn("m", m)
    part = F.coalesce(F.col("l"), F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return rows.agg(F.sum(part).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def communities(edges: DataFrame, min_gain: float = 1e-6) -> DataFrame:
    """(node, community) by weighted modularity moves, then contraction and repeat, until modularity gains no more.

    A level ends when all the moves still open would gain less than ``min_gain`` of modularity together, which only covers
    rounding, and the search ends with a level that gains less. If plain components are better, they are returned.
    """
    base = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    total = base.agg(F.sum("weight")).first()[0]
    if not total:
        return base.select(F.col("src").alias("node"), F.col("src").alias("community"))
    level_edges, mapping = base, None
    while True:
        labels, gained = _move_vertices(level_edges, 2.0 * total, min_gain)
        if mapping is None:
            mapping = labels
        elif gained >= min_gain:
            step = labels.select(F.col("node").alias("community"), F.col("community").alias("next"))
            mapping = cut_lineage(
                mapping.join(step, "community", "left").select("node", F.coalesce("next", "community").alias("community"))
            )
        if gained < min_gain:
            break
        a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
        b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
        merged = level_edges.join(a, "src").join(b, "dst")
        # edges inside a community stay as loops: they keep counting towards its strength
        level_edges = cut_lineage(
            merged.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(
                F.sum("weight").alias("weight")
            )
        )
    parts = components(base).withColumnRenamed("component", "community")
    found, plain = modularity(base, mapping).first()[0], modularity(base, parts).first()[0]
    return mapping if found >= plain else parts


def _move_vertices(edges: DataFrame, two_m: float, min_gain: float) -> tuple[DataFrame, float]:
    """Labels of one level, and the modularity they gain over every vertex by itself.

    Every turn evaluates the vertices that are awake: at first all of them, then those next to a move and those whose
    move had to wait. Once none wants to move all are evaluated again, and only that can end the level. A move waits if
    its target is itself being left and comes later in an order drawn anew each turn. What the moves gain together is
    computed before they are made; where they would undo each other, only moves best for both their communities are
    made, whose gains add up.
    """
    loops = edges.where(F.col("src") == F.col("dst")).select("src", "dst", (F.col("weight") * 2).alias("weight"))
    links = edges.where(F.col("src") != F.col("dst"))
    sym = cut_lineage(both_ways(links, extra=["weight"]))
    strength = sym.unionByName(loops).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    state = cut_lineage(strength.select("node", "k", F.col("node").alias("community"), F.lit(True).alias("awake")))
    gained, everyone, turn = 0.0, True, 0
    while True:
        seen = Observation()
        wanted = _wanted_moves(sym, state, everyone, two_m)
        wanted = cut_lineage(wanted.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain")))
        if not seen.get["n"] or (everyone and seen.get["gain"] < min_gain):
            if everyone:
                return state.select("node", "community"), gained
            everyone = True
            continue
        turn += 1
        left = wanted.select(F.col("own").alias("target"), F.lit(True).alias("left")).distinct()
        order = F.xxhash64("target", F.lit(turn)) < F.xxhash64("own", F.lit(turn))
        moves = wanted.join(left, "target", "left").where(F.col("left").isNull() | order).drop("left")
        touched, gain = _try_moves(sym, state, moves, two_m)
        if gain <= 0.0:
            moves = _dominant(wanted)
            touched, gain = _try_moves(sym, state, moves, two_m)
        gained += gain
        moved = touched.select("node", "target").distinct()
        beside = touched.where(~F.col("there").eqNullSafe(F.col("target"))).select(F.col("other").alias("node"))
        woken = beside.unionByName(wanted.join(moved, "node", "left_anti").select("node")).distinct()
        new = state.drop("awake").join(moved, "node", "left").join(woken.withColumn("awake", F.lit(True)), "node", "left")
        new = new.select("node", "k", F.coalesce("target", "community").alias("community"), F.coalesce("awake", F.lit(False)).alias("awake"))
        before, state, everyone = state, cut_lineage(new), False
        discard(wanted, touched, before)


def _wanted_moves(sym: DataFrame, state: DataFrame, everyone: bool, two_m: float) -> DataFrame:
    """(node, k, own, target, gain) of vertices that gain modularity by a move; ties go to the smallest label."""
    volume = state.groupBy("community").agg(F.sum("k").alias("vol"))
    mine = state.select("node", F.col("community").alias("own"), "k", "awake")
    near = sym.withColumnRenamed("src", "node")
    if not everyone:
        mine = mine.where("awake")
        near = near.join(mine.select("node"), "node", "left_semi")
    ends = state.select(F.col("node").alias("dst"), "community")
    toward = near.join(ends, "dst").select("node", "community", "weight")
    stay = mine.select("node", F.col("own").alias("community"), F.lit(0.0).alias("weight"))
    options = toward.unionByName(stay).groupBy("node", "community").agg(F.sum("weight").alias("w"))
    options = options.join(mine, "node").join(volume, "community")
    here = F.col("community") == F.col("own")
    rest = F.col("vol") - F.when(here, F.col("k")).otherwise(0.0)
    score = F.round((F.col("w") - F.col("k") * rest / two_m) * (2 / two_m), 12)
    best = F.max(F.struct(score.alias("score"), (-F.col("community")).alias("label")))
    choice = options.groupBy("node", "own", "k").agg(best.alias("best"), F.max(F.when(here, score)).alias("stay"))
    gain = F.col("best.score") - F.col("stay")
    return choice.where(gain > 0).select("node", "k", "own", (-F.col("best.label")).alias("target"), gain.alias("gain"))


def _try_moves(sym: DataFrame, state: DataFrame, moves: DataFrame, two_m: float) -> tuple[DataFrame, float]:
    """The edges of the moving vertices with both ends' communities, and the modularity gained by all moves together."""
    ends = state.select(F.col("node").alias("other"), F.col("community").alias("there"))
    after = moves.select(F.col("node").alias("other"), F.col("target").alias("goes"))
    edges = sym.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    touched = edges.join(moves.drop("k", "gain"), "node").join(ends, "other").join(after, "other", "left")
    inside = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    moves_both = F.col("goes").isNotNull()
    change = F.when(moves_both, inside("target", "goes")).otherwise(inside("target", "there")) - inside("own", "there")
    # an edge of two moving vertices has two rows
    part = F.sum(F.col("weight") * change * F.when(moves_both, 0.5).otherwise(1.0))
    seen = Observation()
    touched = cut_lineage(touched.observe(seen, part.alias("w")))
    side = F.explode(F.array(F.struct(F.col("own").alias("c"), (-F.col("k")).alias("d")), F.struct(F.col("target").alias("c"), F.col("k").alias("d"))))
    shift = moves.select(side.alias("s")).groupBy(F.col("s.c").alias("community")).agg(F.sum("s.d").alias("d"))
    volume = state.groupBy("community").agg(F.sum("k").alias("vol"))
    spread = shift.join(volume, "community").agg(F.sum(F.col("d") * (2 * F.col("vol") + F.col("d")))).first()[0] or 0.0
    return touched, (seen.get["w"] or 0.0) * 2 / two_m - spread / two_m**2


def _dominant(wanted: DataFrame) -> DataFrame:
    """Moves that gain most among all that leave or enter either of their communities: no two share a community."""
    rank = F.struct("gain", "node")
    sides = wanted.select(F.explode(F.array("own", "target")).alias("community"), rank.alias("r"))
    top = sides.groupBy("community").agg(F.max("r").alias("top")).select("community", F.col("top.node").alias("node"))
    both = top.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return wanted.join(both, "node", "left_semi")


def removal_analysis(
    edges: DataFrame, top: int = S.TOP_REMOVALS, steps: Sequence[int] = S.REMOVAL_STEPS
) -> DataFrame:
    """Largest component and component count after removing top vertices, one by one and together.

    Components are found once for the graph without any of the top vertices. Every scenario then differs
    only in how the remaining top vertices glue those parts together, so it runs on the contracted graph
    (parts next to a top vertex, plus the top vertices), all scenarios in one pass.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    best = cut_lineage(top_nodes(edges, top))
    tops = best.select("node", "rank")
    a = F.broadcast(tops.select(F.col("node").alias("src"), F.col("rank").alias("ra")))
    b = F.broadcast(tops.select(F.col("node").alias("dst"), F.col("rank").alias("rb")))
    tagged = edges.join(a, "src", "left").join(b, "dst", "left")
    inner = tagged.where(F.col("ra").isNull() & F.col("rb").isNull())
    touching = tagged.where(F.col("ra").isNull() != F.col("rb").isNull()).select(
        F.coalesce("ra", "rb").alias("rank"), F.when(F.col("ra").isNull(), F.col("src")).otherwise(F.col("dst")).alias("node")
    )
    between = tagged.where(F.col("ra").isNotNull() & F.col("rb").isNotNull()).select("ra", "rb")
    parts = components(inner)
    # vertices all of whose neighbours are top vertices are parts of their own
    lone = touching.select("node").distinct().join(parts.select("node"), "node", "left_anti")
    parts = cut_lineage(parts.unionByName(lone.withColumn("component", F.col("node"))))
    sizes = cut_lineage(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    glue = cut_lineage(touching.join(parts, "node").select("rank", "component").distinct())
    untouched = sizes.join(glue.select("component").distinct(), "component", "left_anti")
    rest = untouched.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    ).scalar()

    n_top = best.count()
    scenarios = [("baseline", 0, [])] + [("single", r, [r]) for r in range(1, n_top + 1)]
    scenarios += [("cumulative", s, list(range(1, s + 1))) for s in sorted({*steps, top}) if s <= n_top]
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("scenario"), F.lit(kind).alias("kind"), F.lit(size).alias("n_removed"),
                F.array(*[F.lit(r) for r in gone]).cast("array<int>").alias("gone"),
            )
            for i, (kind, size, gone) in enumerate(scenarios)
        ]
    )
    spark = edges.sparkSession
    each = spark.range(1).select(F.explode(listed).alias("s")).select("s.*")
    kept = lambda *ranks: F.filter(listed, lambda s: F.arrays_overlap(s["gone"], F.array(*ranks)) == F.lit(False))
    # top vertices get negative ids so that they cannot collide with part numbers, which are made dense
    numbered = sizes.join(glue.select("component").distinct(), "component", "left_semi").withColumn(
        "part", F.dense_rank().over(Window.partitionBy(F.pmod(F.xxhash64("component"), F.lit(64))).orderBy("component")) * 64
        + F.pmod(F.xxhash64("component"), F.lit(64))
    )
    numbered = cut_lineage(numbered.select("component", "part", "size"))
    links = (
        glue.join(numbered, "component")
        .select("rank", "part", F.explode(kept(F.col("rank"))).alias("s"))
        .select("s.scenario", (-F.col("rank")).cast("bigint").alias("src"), F.col("part").cast("bigint").alias("dst"))
    )
    top_links = between.select("ra", "rb", F.explode(kept(F.col("ra"), F.col("rb"))).alias("s")).select(
        "s.scenario", (-F.col("ra")).cast("bigint").alias("src"), (-F.col("rb")).cast("bigint").alias("dst")
    )
    glued = components(links.unionByName(top_links), ["scenario"])
    weights = numbered.select(F.col("part").cast("bigint").alias("node"), "size").select(
        "node", "size", F.explode(F.array(*[F.lit(i) for i in range(len(scenarios))])).alias("scenario")
    ).unionByName(
        best.select((-F.col("rank")).cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("size"), F.explode(kept(F.col("rank"))).alias("s"))
        .select("node", "size", "s.scenario")
    )
    placed = weights.join(glued, ["scenario", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    merged = placed.groupBy("scenario", "component").agg(F.sum("size").alias("size"))
    per = merged.groupBy("scenario").agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))
    out = each.join(per, "scenario", "left").withColumn("rest", rest)
    out = cut_lineage(
        out.select(
            "kind",
            "n_removed",
            F.greatest(F.coalesce("largest", F.lit(0)), F.col("rest.largest")).alias("largest_comp"),
            (F.coalesce("n", F.lit(0)) + F.col("rest.n")).alias("n_components"),
        )
    )
    start = out.where(F.col("kind") == "baseline").agg(F.max("largest_comp")).scalar()
    ranked = best.select(F.col("rank").alias("n_removed"), F.lit("single").alias("kind"), "node", "degree")
    return out.join(ranked, ["kind", "n_removed"], "left").select(
        "kind",
        "n_removed",
        F.col("node").alias("removed_node"),
        F.col("degree").alias("edges_removed"),
        start.alias("largest_before"),
        "largest_comp",
        "n_components",
        F.round((start - F.col("largest_comp")) / start * 100, 2).alias("drop_pct"),
    )


def select_communities(labels: DataFrame, min_size: int = S.MIN_COMMUNITY, top: int = S.TOP_COMMUNITIES) -> DataFrame:
    """The ``top`` largest communities of at least ``min_size`` members, ranked by (size desc, id)."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    best = sizes.orderBy(F.desc("size"), "community").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))


def community_members(labels: DataFrame, selected: DataFrame) -> DataFrame:
    """(rank, node) of the selected communities; the selection is a top-k list, so it is broadcast."""
    return labels.join(F.broadcast(selected.select("community", "rank")), "community").select("rank", "node")


def inner_edges(edges: DataFrame, members: DataFrame, scope: str = "rank") -> DataFrame:
    """Edges whose two ends belong to the same listed community; long lists of members are not broadcast."""
    members = members.hint("merge") if members.count() > LISTED_ROWS * 500 else members
    a = members.select(F.col("node").alias("src"), F.col(scope))
    b = members.select(F.col("node").alias("dst"), F.col(scope).alias("_other"))
    tagged = edges.join(a, "src").join(b, "dst")
    return tagged.where(F.col(scope) == F.col("_other")).drop("_other")


def ranked_members(members: DataFrame, inside: DataFrame, scope: str = "rank", limit: int | None = None) -> DataFrame:
    """Members with their degree inside the community and position by (degree desc, id)."""
    deg = degrees(inside, [scope])
    rows = members.join(deg, [scope, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy(scope).orderBy(F.desc("degree"), "node")
    out = rows.withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= limit) if limit else out


def min_max(col: str) -> F.Column:
    """Scaling to 0..1 over all rows of a short list; a constant column becomes 0.5."""
    w = Window.partitionBy()
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(hi == lo, F.lit(0.5)).otherwise((F.col(col) - lo) / (hi - lo))


def community_profile(members: DataFrame, bridge: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per community: distinct cases, severe and violent share of its rows, regions, most frequent category."""
    rows = bridge.na.drop(subset=["entity_id"]).join(members.withColumnRenamed("node", "entity_id"), "entity_id")
    facts = incidents.select(
        F.col("incident_id").alias("case_id"), "severity_id", "category_id", "category_name", "region_name"
    )
    rows = rows.join(facts, "case_id", "left")
    parts = rows.groupBy("rank", "category_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity_id") == 1).alias("severe"),
        F.count_if(F.col("category_id") == 1).alias("violent"),
    )
    top_n = F.max(F.when(F.col("category_name").isNotNull(), F.col("n"))).over(Window.partitionBy("rank"))
    shares = (
        parts.withColumn("top", top_n)
        .groupBy("rank")
        .agg(
            (F.sum("severe") / F.sum("n")).alias("severe_share"),
            (F.sum("violent") / F.sum("n")).alias("violent_share"),
            F.min(F.when(F.col("n") == F.col("top"), F.col("category_name"))).alias("top_type"),
        )
    )
    cases = rows.select("rank", "case_id").distinct().groupBy("rank").agg(F.count(F.lit(1)).alias("total_cases"))
    regions = (
        rows.where(F.col("region_name").isNotNull())
        .select("rank", "region_name")
        .distinct()
        .groupBy("rank")
        .agg(F.count(F.lit(1)).alias("n_regions"))
    )
    return shares.join(cases, "rank").join(regions, "rank", "left").na.fill(0, ["n_regions"])


def composite_score(report: DataFrame) -> DataFrame:
    """Score and tier of each listed community (never of a person) from severity, size, cohesion, cases, reach.

    The input has one row per selected community, so the windows run over a short list.
    """
    severity = 0.6 * F.col("severe_share") + 0.4 * F.col("violent_share")
    total = (
        0.42 * severity
        + 0.20 * min_max("size")
        + 0.14 * min_max("cohesion")
        + 0.12 * min_max("total_cases")
        + 0.12 * min_max("n_regions")
    )
    scored = report.withColumn("score", F.round(100 * total, 1))
    place = (F.row_number().over(Window.orderBy(F.desc("score"), "rank")) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    return scored.withColumn("_f", place).withColumn(
        "tier", F.when(F.col("_f") < 0.30, "high").when(F.col("_f") < 0.65, "medium").otherwise("low")
    ).drop("_f")


def member_roles(roster: DataFrame, scope: str = "rank") -> DataFrame:
    """Role by position in a community's shown core: lead, then a few seconds, then members."""
    n = F.count(F.lit(1)).over(Window.partitionBy(scope))
    order = F.row_number().over(Window.partitionBy(scope).orderBy("position"))
    seconds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor((F.col("_n") - 1) / 5 + 0.5)))
    return (
        roster.withColumn("_n", n)
        .withColumn("_i", order - 1)
        .withColumn("role", F.when(F.col("_i") == 0, "lead").when(F.col("_i") <= seconds, "second").otherwise("member"))
        .drop("_n", "_i")
    )


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between listed nodes; the list is a top-k, so it is broadcast."""
    few = F.broadcast(nodes.select("node"))
    return edges.join(few.withColumnRenamed("node", "src"), "src", "left_semi").join(
        few.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )


def merge_edge_kinds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Undirected union of two edge lists; an edge in both keeps the weight of the first."""
    tag = lambda df, k: df.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct(F.lit(k).alias("k"), "weight").alias("w")
    )
    both = tag(first, 0).unionByName(tag(second, 1)).where(F.col("src") != F.col("dst"))
    return both.groupBy("src", "dst").agg(F.min("w").alias("w")).select("src", "dst", "w.weight")
