"""Articulation points of graphs of any depth, and the community report that counts them.

After Tarjan and Vishkin (1985): any spanning forest will do, and nothing walks along it. Trees come from rounds in which
every part takes its least edge; an Euler tour of each tree is ranked by pointer doubling; ranges of the tour are subtrees,
so how far the other edges of a subtree reach is a range minimum, found by doubling too. All loops are logarithmic.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.operators.graph import both_ways, components, inner_edges, ranked_members
from hotgrid.session import cut_lineage, discard

TURNS = 256  # parts of a vertex's circle of neighbours, so that a hub's circle is not ordered in one task


def spanning_forest(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The edges (scope, src, dst) of a spanning forest.

    In each round every part of a tree takes its least outgoing edge, by an order drawn by hash; parts hook along these
    edges, follow the hooks to their ends by doubling and contract. Of parallel edges only the least stays.
    """
    scope = list(scope)
    order = F.struct(F.xxhash64("src", "dst").alias("r"), "src", "dst")
    cur = edges.where(F.col("src") != F.col("dst")).groupBy(*scope, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cur = cut_lineage(cur.select(*scope, "a", "b", F.col("a").alias("src"), F.col("b").alias("dst")))
    taken = []
    while not cur.isEmpty():
        ends = cur.withColumn("o", order)
        ends = ends.select(*scope, "a", "b", "o").unionByName(ends.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"), "o"))
        picks = ends.groupBy(*scope, "a").agg(F.min(F.struct("o", "b")).alias("p"))
        picks = cut_lineage(picks.select(*scope, "a", F.col("p.b").alias("b"), F.col("p.o.src").alias("src"), F.col("p.o.dst").alias("dst")))
        taken.append(picks)
        # edges are taken in one total order, so hooks run into circles of two only; the smaller of the two is the end
        back = picks.select(*scope, F.col("a").alias("b"), F.col("b").alias("a2"))
        hooks = picks.join(back, [*scope, "b"])
        hooks = cut_lineage(hooks.select(*scope, "a", F.when((F.col("a2") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("end")))
        open_hooks = True
        while open_hooks:
            ends = hooks.select(*scope, F.col("a").alias("end"), F.col("end").alias("further"))
            moved = cut_lineage(hooks.join(ends, [*scope, "end"]).select(*scope, "a", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved")))
            open_hooks = not moved.where("moved").isEmpty()
            discard(hooks)
            hooks = moved
        of_a, of_b = (hooks.select(*scope, F.col("a").alias(side), F.col("end").alias(f"end_{side}")) for side in "ab")
        parts = cur.join(of_a, [*scope, "a"]).join(of_b, [*scope, "b"])
        parts = parts.where("end_a <> end_b").withColumn("o", order)
        parts = parts.groupBy(*scope, F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).agg(F.min("o").alias("o"))
        cur = cut_lineage(parts.select(*scope, "a", "b", "o.src", "o.dst"))
    if not taken:
        return cur.select(*scope, "src", "dst")
    forest = taken[0]
    for picks in taken[1:]:
        forest = forest.unionByName(picks)
    return cut_lineage(forest.select(*scope, "src", "dst").distinct())


def _tour(forest: DataFrame, roots: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, x, y, place) of every arc x -> y of a tree, counted from 1 at the end of its Euler tour.

    After x -> y the tour leaves y towards the neighbour after x in y's circle of neighbours, in any fixed order.
    """
    arcs = both_ways(forest, scope).select(*scope, F.col("src").alias("x"), F.col("dst").alias("y"))
    arcs = arcs.withColumn("turn", F.pmod(F.xxhash64("x"), F.lit(TURNS)))
    inside = Window.partitionBy(*scope, "y", "turn").orderBy("x")
    firsts = arcs.groupBy(*scope, "y", "turn").agg(F.min("x").alias("first"))
    around = Window.partitionBy(*scope, "y").orderBy("turn")
    begin = F.first("first").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(*scope, "y", "turn", F.coalesce(F.lead("first").over(around), begin).alias("across"))
    arcs = arcs.withColumn("z", F.lead("x").over(inside)).join(firsts, [*scope, "y", "turn"])
    arcs = arcs.select(*scope, "x", "y", F.coalesce("z", "across").alias("z"))
    # the tour of a root starts at its least neighbour, so it ends before that arc
    starts = arcs.join(roots.select(*scope, F.col("node").alias("x")), [*scope, "x"], "left_semi")
    starts = starts.groupBy(*scope, F.col("x").alias("y")).agg(F.min("y").alias("z")).withColumn("last", F.lit(True))
    state = arcs.join(starts, [*scope, "y", "z"], "left")
    state = cut_lineage(
        state.select(
            *scope, "x", "y", F.when(F.col("last"), None).otherwise(F.col("y")).alias("nx"), F.when(F.col("last"), None).otherwise(F.col("z")).alias("ny"),
            F.lit(1).cast("bigint").alias("place"),
        )
    )
    while True:
        ahead = state.where(F.col("nx").isNotNull())
        if ahead.isEmpty():
            return state.select(*scope, "x", "y", "place")
        there = state.select(*scope, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("nnx"), F.col("ny").alias("nny"), F.col("place").alias("more"))
        jumped = ahead.join(there, [*scope, "nx", "ny"]).select(
            *scope, "x", "y", F.col("nnx").alias("nx"), F.col("nny").alias("ny"), (F.col("place") + F.col("more")).alias("place")
        )
        before, state = state, cut_lineage(jumped.unionByName(state.where(F.col("nx").isNull())))
        discard(before)


def _reach(tree: DataFrame, other: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node, low, high): least and greatest place that edges outside the tree reach from each vertex's subtree."""
    at = tree.select(*scope, "node", "pre")
    ends = both_ways(other, scope)
    seen = ends.join(at.select(*scope, F.col("node").alias("dst"), F.col("pre").alias("p")), [*scope, "dst"])
    local = seen.groupBy(*scope, F.col("src").alias("node")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    # places where nothing is reached have no row; a tree's places are told from another's by its root
    level = tree.join(local, [*scope, "node"]).select(*scope, "root", F.col("pre").alias("p"), "lo", "hi")
    level, asked = cut_lineage(level), cut_lineage(
        tree.where(F.col("end") > 0).select(*scope, "node", "root", "pre", "end", F.floor(F.log2(F.col("pre") - F.col("end") + 1)).cast("int").alias("k"))
    )
    top = asked.agg(F.max("k")).first()[0] or 0
    key, found = [*scope, "root", "p"], None
    for k in range(top + 1):
        step = 1 << k
        asking = asked.where(F.col("k") == k)
        sides = asking.select(*scope, "node", "root", F.col("end").alias("p")).unionByName(
            asking.select(*scope, "node", "root", (F.col("pre") - step + 1).alias("p"))
        )
        here = sides.join(level, key).groupBy(*scope, "node").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
        here = cut_lineage(here)
        found = here if found is None else found.unionByName(here)
        if k < top:
            shifted = level.withColumn("p", F.col("p") - step).where("p > 0")
            level = cut_lineage(level.unionByName(shifted).groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return found


def articulation_points(edges: DataFrame, scope: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """Vertices whose removal splits their component, within each scope.

    Tree edges are named by their lower vertex. Two of them lie in one block if an edge outside the tree joins vertices
    below them, neither above the other; or if one hangs from the other and its subtree reaches out of the other's.
    Blocks are the components of these ties, and a vertex at edges of two blocks is an articulation point.
    """
    scope = list(scope)
    pair = [*scope, "node"]
    edges = edges.select(*scope, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = cut_lineage(edges.where(F.col("src") != F.col("dst")).distinct())
    labels = components(edges, scope) if labels is None else labels
    roots = labels.where(F.col("node") == F.col("component")).select(*pair)
    forest = spanning_forest(edges, scope)
    tour = _tour(forest, roots, scope)
    back = tour.select(*scope, F.col("y").alias("x"), F.col("x").alias("y"), F.col("place").alias("end"))
    down = tour.join(back, [*scope, "x", "y"]).where(F.col("place") > F.col("end"))
    tree = down.select(*scope, F.col("y").alias("node"), F.col("x").alias("parent"), F.col("place").alias("pre"), "end")
    tree = tree.join(labels.select(*pair, F.col("component").alias("root")), pair)
    tops = tree.groupBy(*scope, "root").agg((F.max("pre") + 1).alias("pre"))
    none = F.lit(None).cast(dict(edges.dtypes)["src"])
    tops = tops.select(*scope, F.col("root").alias("node"), none.alias("parent"), "pre", F.lit(0).cast("bigint").alias("end"), "root")
    tree = cut_lineage(tree.select(*scope, "node", "parent", "pre", "end", "root").unionByName(tops))
    child = tree.where(F.col("parent").isNotNull()).select(*pair, "parent")
    other = cut_lineage(edges.join(forest, [*scope, "src", "dst"], "left_anti"))
    blocks = child.withColumn("block", F.col("node"))
    if not other.isEmpty():
        spot = lambda name: tree.select(*scope, F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("pre", "end")])
        across = other.join(spot("src"), [*scope, "src"]).join(spot("dst"), [*scope, "dst"])
        apart = F.expr("not (src_pre between dst_end and dst_pre) and not (dst_pre between src_end and src_pre)")
        hangs = child.join(_reach(tree, other, scope), pair).join(
            tree.where(F.col("parent").isNotNull()).select(*scope, F.col("node").alias("parent"), "pre", "end"), [*scope, "parent"]
        )
        out = hangs.where((F.col("low") < F.col("end")) | (F.col("high") > F.col("pre")))
        ties = across.where(apart).select(*scope, "src", "dst").unionByName(
            out.select(*scope, F.col("parent").alias("src"), F.col("node").alias("dst"))
        )
        joined = components(ties, scope)
        blocks = child.join(joined, pair, "left").withColumn("block", F.coalesce("component", "node")).drop("component")
    at_ends = blocks.select(*pair, "block").unionByName(blocks.select(*scope, F.col("parent").alias("node"), "block"))
    return at_ends.groupBy(*pair).agg(F.count_distinct("block").alias("blocks")).where(F.col("blocks") > 1).select(*pair)


def _component_report(members: DataFrame, comp: DataFrame, scope: str) -> DataFrame:
    """Largest component and number of components per scope, members without edges included."""
    placed = members.join(comp, [scope, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy(scope, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(scope).agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))


def community_report(members: DataFrame, edges: DataFrame | None = None, remove: int = 3, inside: DataFrame | None = None) -> DataFrame:
    """Size, edges, cohesion, articulation points, and what removing the best-connected members does.

    ``edges`` are those of the whole graph; a caller that has those inside the communities, written, gives ``inside`` in place of them.
    """
    members = cut_lineage(members)
    inside = cut_lineage(inner_edges(edges, members)) if inside is None else inside
    inside = inside.select("rank", "src", "dst")
    gone = cut_lineage(ranked_members(members, inside, limit=remove).select("rank", "node"))
    few = F.broadcast(gone)
    left = members.join(few, ["rank", "node"], "left_anti")
    cut = inside.join(few.withColumnRenamed("node", "src"), ["rank", "src"], "left_anti").join(
        few.withColumnRenamed("node", "dst"), ["rank", "dst"], "left_anti"
    )
    whole = cut_lineage(components(inside, ["rank"]))
    before = _component_report(members, whole, "rank").select("rank", F.col("largest").alias("largest_before"))
    after = _component_report(left, components(cut, ["rank"]), "rank").select(
        "rank", F.col("largest").alias("largest_after"), F.col("n").alias("components_after")
    )
    artic = articulation_points(inside, ["rank"], whole).groupBy("rank").agg(F.count(F.lit(1)).alias("n_articulation"))
    size = members.groupBy("rank").agg(F.count(F.lit(1)).alias("size"))
    count = inside.groupBy("rank").agg(F.count(F.lit(1)).alias("n_edges"))
    rows = size.join(count, "rank", "left").join(before, "rank").join(after, "rank", "left").join(artic, "rank", "left")
    rows = rows.na.fill(0, ["n_edges", "largest_after", "components_after", "n_articulation"])
    return rows.withColumn(
        "drop_pct", F.round((F.col("largest_before") - F.col("largest_after")) / F.col("largest_before") * 100, 1)
    ).withColumn("cohesion", F.col("n_edges") / F.col("size"))
