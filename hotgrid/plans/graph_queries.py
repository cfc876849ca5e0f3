"""Co-occurrence graph and entity queries."""

from pyspark.sql import functions as F

from hotgrid.operators import biconnected, entities, graph
from hotgrid.plans.registry import query, view
from hotgrid.session import cut_lineage
from hotgrid.sources import tables

view(
    "kept",
    """
WITH d AS (SELECT DISTINCT case_id, entity_id FROM ce WHERE case_id IS NOT NULL AND entity_id IS NOT NULL),
c AS (SELECT * FROM d WHERE case_id IN (SELECT case_id FROM d GROUP BY case_id HAVING count(*) <= 10))
SELECT * FROM c WHERE entity_id IN (SELECT entity_id FROM c GROUP BY entity_id HAVING count(*) >= 2)""",
)
view(
    "edges",
    """
SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS weight FROM kept a JOIN kept b ON a.case_id = b.case_id AND a.entity_id < b.entity_id GROUP BY ALL""",
)
view("strong", "SELECT * FROM edges WHERE weight >= 2")
view("ends", "SELECT src AS node, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges")
view("degree", "SELECT node, count(*) AS degree FROM ends GROUP BY node")
G = "ce kept edges"
GD = G + " ends degree"


def cc_sql(name: str, source: str, scope: str = "") -> str:
    """Recursive view giving the smallest reachable node of every node of ``source`` (src, dst[, scope])."""
    s = f"{scope}, " if scope else ""
    on = f"e.{scope} = c.{scope} AND " if scope else ""
    old = f"r.{scope} = e.{scope} AND " if scope else ""
    es = f"e.{scope}, " if scope else ""
    return f"""{name}_sym AS MATERIALIZED (SELECT {s}src, dst FROM {source} UNION SELECT {s}dst, src FROM {source}),
{name}({s}node, component) USING KEY ({s}node) AS (
  SELECT DISTINCT {s}src, src FROM {name}_sym
  UNION
  SELECT {es}e.dst, min(c.component) FROM {name} c JOIN {name}_sym e ON {on}e.src = c.node
    JOIN recurring.{name} r ON {old}r.node = e.dst WHERE c.component < r.component GROUP BY {es}e.dst)"""


def edges_of(spark, d, min_weight=1):
    """The edge table, written once: every query below reads it several times."""
    return cut_lineage(graph.cooccurrence_edges(tables.case_entity(spark, d), min_weight=min_weight))


@query("cooccurrence_edges", G, "SELECT src, dst, weight FROM edges")
def cooccurrence_edges(spark, d):
    return graph.cooccurrence_edges(tables.case_entity(spark, d))


@query(
    "case_sizes",
    "ce",
    """SELECT n AS case_size, count(*) AS cases, CAST(n <= 10 AS INTEGER) AS kept FROM (SELECT case_id, count(DISTINCT entity_id) AS n FROM ce GROUP BY case_id) GROUP BY n""",
)
def case_sizes(spark, d):
    per = tables.case_entity(spark, d).distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("case_size"))
    return per.groupBy("case_size").agg(F.count(F.lit(1)).alias("cases")).withColumn("kept", (F.col("case_size") <= 10).cast("int"))


@query(
    "degree_centrality",
    GD,
    "SELECT node, degree, round(degree / ((SELECT count(*) FROM degree) - 1), 9) AS centrality FROM degree",
)
def degree_centrality(spark, d):
    return graph.degree_centrality(edges_of(spark, d)).withColumn("centrality", F.round("centrality", 9))


def _power_sql(steps: int) -> str:
    parts = ["x0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM degree) AS x FROM degree)"]
    for i in range(1, steps + 1):
        parts.append(
            f"y{i} AS (SELECT node, sum(x) AS x FROM (SELECT other AS node, x FROM ends JOIN x{i - 1} USING (node) UNION ALL SELECT node, x FROM x{i - 1}) GROUP BY node)"
        )
        parts.append(f"x{i} AS (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT node, round(x, 9) AS eigenvector FROM x{steps}"


@query("eigenvector_3", GD, _power_sql(3))
def eigenvector_3(spark, d):
    return graph.eigenvector(edges_of(spark, d), 3, fixed=True).withColumn("eigenvector", F.round("eigenvector", 9))


@query("eigenvector")
def eigenvector(spark, d):
    return graph.eigenvector(edges_of(spark, d))


@query("components", G, "WITH " + cc_sql("cc", "edges") + " SELECT node, component FROM cc", recursive=True)
def components(spark, d):
    return graph.components(edges_of(spark, d))


@query(
    "component_sizes_strong",
    G + " strong",
    "WITH " + cc_sql("cc", "strong") + " SELECT component, count(*) AS size FROM cc GROUP BY component",
    recursive=True,
)
def component_sizes_strong(spark, d):
    return graph.component_sizes(graph.components(edges_of(spark, d, min_weight=2)))


@query(
    "removal_analysis",
    GD + " strong",
    """WITH sd AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM strong UNION ALL SELECT dst FROM strong) GROUP BY node),
best AS (SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM sd QUALIFY rank <= 50),
scen AS (SELECT 'baseline' AS kind, 0 AS n_removed, 0 AS s, 0 AS lo, 0 AS hi UNION ALL SELECT 'single', rank, rank, rank, rank FROM best
  UNION ALL SELECT 'cumulative', k, 100 + k, 1, k FROM (SELECT unnest([1, 5, 10, 20, 30, 40, 50]) AS k)),
sn AS (SELECT s, sd.node FROM scen, sd LEFT JOIN best ON best.node = sd.node WHERE rank IS NULL OR rank < lo OR rank > hi),
se AS MATERIALIZED (SELECT a.s, src, dst FROM strong JOIN sn a ON a.node = src JOIN sn b ON b.node = dst AND a.s = b.s),
"""
    + cc_sql("cc", "se", "s")
    + """,
sz AS (SELECT s, coalesce(component, node) AS c, count(*) AS size FROM sn LEFT JOIN cc USING (s, node) GROUP BY ALL),
r AS (SELECT s, max(size) AS largest_comp, count(*) AS n_components FROM sz GROUP BY s)
SELECT kind, CAST(n_removed AS INTEGER) AS n_removed, CASE WHEN kind = 'single' THEN node END AS removed_node, CASE WHEN kind = 'single' THEN degree END AS edges_removed,
 (SELECT largest_comp FROM r WHERE s = 0) AS largest_before, largest_comp, n_components,
 round(((SELECT largest_comp FROM r WHERE s = 0) - largest_comp) / (SELECT largest_comp FROM r WHERE s = 0) * 100, 2) AS drop_pct
FROM scen JOIN r USING (s) LEFT JOIN best ON rank = n_removed""",
    recursive=True,
)
def removal_analysis(spark, d):
    return graph.removal_analysis(edges_of(spark, d, min_weight=2))


# A labelling SQL can repeat: entities grouped by the brand of the part.
def brand_labels(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))


view("labels_b", "SELECT p_partkey AS node, p_brand AS community FROM part")
view(
    "chosen",
    """SELECT community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, community) AS rank FROM labels_b GROUP BY community
HAVING count(*) >= 6 QUALIFY rank <= 24""",
)
view("mem", "SELECT CAST(rank AS INTEGER) AS rank, node FROM labels_b JOIN chosen USING (community)")
view("ins", "SELECT a.rank, src, dst, weight FROM edges JOIN mem a ON a.node = src JOIN mem b ON b.node = dst WHERE a.rank = b.rank")
view(
    "mdeg",
    """SELECT rank, node, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY rank ORDER BY coalesce(degree, 0) DESC, node) AS position
FROM mem LEFT JOIN (SELECT rank, node, count(*) AS degree FROM (SELECT rank, src AS node FROM ins UNION ALL SELECT rank, dst FROM ins) GROUP BY ALL) USING (rank, node)""",
)
C = G + " labels_b chosen mem ins mdeg"


@query(
    "modularity",
    GD + " labels_b",
    """WITH m AS (SELECT sum(weight)::DOUBLE AS m FROM edges),
dd AS (SELECT community, sum(weight) AS d FROM ends JOIN labels_b USING (node) GROUP BY community),
l AS (SELECT a.community, sum(weight) AS l FROM edges JOIN labels_b a ON a.node = src JOIN labels_b b ON b.node = dst AND a.community = b.community GROUP BY a.community)
SELECT round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity, count(*) AS n_communities FROM dd LEFT JOIN l USING (community), m""",
)
def modularity(spark, d):
    return graph.modularity(edges_of(spark, d), brand_labels(spark, d)).withColumn("modularity", F.round("modularity", 9))


@query("selected_communities", "labels_b chosen", "SELECT community, size, CAST(rank AS INTEGER) AS rank FROM chosen")
def selected_communities(spark, d):
    return graph.select_communities(brand_labels(spark, d))


def _members(spark, d):
    labels = brand_labels(spark, d)
    return cut_lineage(graph.community_members(labels, graph.select_communities(labels)))


def _inside(spark, d, members):
    """Edges inside the listed communities; those between them, most of all edges, are never made."""
    inside = graph.cooccurrence_edges(tables.case_entity(spark, d), groups=members)
    return cut_lineage(inside.select("src", "dst", "weight", "rank"))


@query(
    "community_core",
    C,
    """SELECT rank, node, degree, CAST(position AS INTEGER) AS position, CASE WHEN position = 1 THEN 'lead'
  WHEN position - 1 <= least(5, greatest(2, floor((count(*) OVER (PARTITION BY rank) - 1) / 5 + 0.5))) THEN 'second' ELSE 'member' END AS role
FROM mdeg WHERE position <= 22""",
)
def community_core(spark, d):
    """Best-connected members of each community with their roles; the number of seconds follows the size of the core."""
    members = _members(spark, d)
    core = graph.ranked_members(members, _inside(spark, d, members), limit=22)
    return graph.member_roles(core)


@query(
    "core_edges",
    C,
    "SELECT i.rank, src, dst, weight FROM ins i JOIN mdeg a ON a.rank = i.rank AND a.node = src AND a.position <= 22 JOIN mdeg b ON b.rank = i.rank AND b.node = dst AND b.position <= 22",
)
def core_edges(spark, d):
    members = _members(spark, d)
    inside = _inside(spark, d, members)
    core = cut_lineage(graph.ranked_members(members, inside, limit=22).select("node"))
    return graph.induced_edges(inside, core).select("rank", "src", "dst", "weight")


@query(
    "export_graph",
    GD,
    """WITH t AS (SELECT node FROM degree ORDER BY degree DESC, node LIMIT 500)
SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""",
)
def export_graph(spark, d):
    edges = edges_of(spark, d)
    return graph.induced_edges(edges, graph.top_nodes(edges, 500))


def split_sql(name: str, source: str, scope: str) -> str:
    """Views ending in ``name``(scope, node): vertices of ``source`` whose neighbours fall apart when they are taken out.

    Every vertex of degree two or more is taken out once, and labels spread from its neighbours over what is left.
    """
    return f"""{name}_b AS MATERIALIZED (SELECT {scope} AS s, src, dst FROM {source} UNION SELECT {scope}, dst, src FROM {source}),
{name}_v AS MATERIALIZED (SELECT s, src AS v FROM {name}_b GROUP BY ALL HAVING count(*) > 1),
{name}_e AS MATERIALIZED (SELECT struct_pack(s := s, v := v) AS cut, e.src, e.dst FROM {name}_b e JOIN {name}_v USING (s) WHERE e.src < e.dst AND v <> e.src AND v <> e.dst),
{cc_sql(f"{name}_c", f"{name}_e", "cut")},
{name} AS (SELECT s, v AS node FROM {name}_v JOIN {name}_b e ON e.s = {name}_v.s AND e.src = v
  LEFT JOIN {name}_c c ON c.cut = struct_pack(s := {name}_v.s, v := v) AND c.node = e.dst
  GROUP BY {name}_v.s, v HAVING count(DISTINCT coalesce(c.component, e.dst)) > 1)""".replace(f"SELECT s, v AS node FROM {name}_v JOIN", f"SELECT {name}_v.s AS s, v AS node FROM {name}_v JOIN")


REPORT_SQL = (
    "WITH gone AS (SELECT rank, node FROM mdeg WHERE position <= 3), lft AS (SELECT * FROM mem ANTI JOIN gone USING (rank, node)),\n"
    "cut AS MATERIALIZED (SELECT i.rank, src, dst FROM ins i ANTI JOIN gone g ON g.rank = i.rank AND g.node = src),\n"
    "cut2 AS MATERIALIZED (SELECT i.rank, src, dst FROM cut i ANTI JOIN gone g ON g.rank = i.rank AND g.node = dst),\n"
    + cc_sql("c1", "ins", "rank") + ",\n" + cc_sql("c2", "cut2", "rank") + ",\n" + split_sql("art", "ins", "rank")
    + """,
z1 AS (SELECT rank, max(n) AS largest_before FROM (SELECT rank, coalesce(component, node) AS c, count(*) AS n FROM mem LEFT JOIN c1 USING (rank, node) GROUP BY ALL) GROUP BY rank),
z2 AS (SELECT rank, max(n) AS largest_after, count(*) AS components_after FROM (SELECT rank, coalesce(component, node) AS c, count(*) AS n FROM lft LEFT JOIN c2 USING (rank, node) GROUP BY ALL) GROUP BY rank),
sz AS (SELECT rank, count(*) AS size FROM mem GROUP BY rank), ne AS (SELECT rank, count(*) AS n_edges FROM ins GROUP BY rank)
SELECT rank, size, coalesce(n_edges, 0) AS n_edges, largest_before, coalesce(largest_after, 0) AS largest_after, coalesce(components_after, 0) AS components_after,
  round((largest_before - coalesce(largest_after, 0)) / largest_before * 100, 1) AS drop_pct, round(coalesce(n_edges, 0) / size, 6) AS cohesion,
  coalesce(n_articulation, 0) AS n_articulation
FROM sz LEFT JOIN ne USING (rank) JOIN z1 USING (rank) LEFT JOIN z2 USING (rank) LEFT JOIN (SELECT s AS rank, count(*) AS n_articulation FROM art GROUP BY s) USING (rank)"""
)


@query("community_report", C, REPORT_SQL, recursive=True)
def community_report(spark, d):
    members = _members(spark, d)
    out = biconnected.community_report(members, inside=_inside(spark, d, members))
    return out.withColumn("cohesion", F.round("cohesion", 6))


@query("articulation_points", G + " strong", "WITH " + split_sql("art", "strong", "1") + "\nSELECT node FROM art", recursive=True)
def articulation_points(spark, d):
    return biconnected.articulation_points(edges_of(spark, d, min_weight=2).select("src", "dst"))


view(
    "cprof",
    """
WITH r AS (SELECT rank, c.case_id, severity_id, category_id, category_name, region_name FROM ce c JOIN mem ON node = entity_id LEFT JOIN inc ON incident_id = c.case_id)
SELECT rank, severe_share, violent_share, total_cases, n_regions, top_type FROM (
  SELECT rank, avg(CASE WHEN severity_id = 1 THEN 1.0::DOUBLE ELSE 0 END) AS severe_share, avg(CASE WHEN category_id = 1 THEN 1.0::DOUBLE ELSE 0 END) AS violent_share,
    count(DISTINCT case_id) AS total_cases, count(DISTINCT region_name) AS n_regions FROM r GROUP BY rank)
JOIN (SELECT rank, category_name AS top_type FROM r GROUP BY rank, category_name QUALIFY row_number() OVER (PARTITION BY rank ORDER BY count(*) DESC, category_name) = 1) USING (rank)""",
)


def _profile(spark, d, members):
    return graph.community_profile(members, tables.case_entity(spark, d), tables.order_incidents(spark, d))


@query(
    "community_profile",
    "inc " + C + " cprof",
    "SELECT rank, round(severe_share, 6) AS severe_share, round(violent_share, 6) AS violent_share, total_cases, n_regions, top_type FROM cprof",
)
def community_profile(spark, d):
    out = _profile(spark, d, _members(spark, d))
    return out.withColumn("severe_share", F.round("severe_share", 6)).withColumn("violent_share", F.round("violent_share", 6))


@query(
    "composite_score",
    "inc " + C + " cprof",
    """WITH b AS (SELECT rank, severe_share, violent_share, total_cases, n_regions, size, n_edges / size AS cohesion FROM cprof
  JOIN (SELECT rank, count(*) AS size FROM mem GROUP BY rank) USING (rank) JOIN (SELECT rank, count(*) AS n_edges FROM ins GROUP BY rank) USING (rank)),
s AS (SELECT rank, round(100 * (0.42 * (0.6 * severe_share + 0.4 * violent_share)
  + 0.20 * coalesce((size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0), 0.5)
  + 0.14 * coalesce((cohesion - min(cohesion) OVER ()) / nullif(max(cohesion) OVER () - min(cohesion) OVER (), 0), 0.5)
  + 0.12 * coalesce((total_cases - min(total_cases) OVER ()) / nullif(max(total_cases) OVER () - min(total_cases) OVER (), 0), 0.5)
  + 0.12 * coalesce((n_regions - min(n_regions) OVER ()) / nullif(max(n_regions) OVER () - min(n_regions) OVER (), 0), 0.5)), 1) AS score FROM b),
o AS (SELECT *, (row_number() OVER (ORDER BY score DESC, rank) - 1) / count(*) OVER () AS f FROM s)
SELECT rank, score, CASE WHEN f < 0.30 THEN 'high' WHEN f < 0.65 THEN 'medium' ELSE 'low' END AS tier FROM o""",
)
def composite_score(spark, d):
    members = _members(spark, d)
    inside = _inside(spark, d, members)
    size = members.groupBy("rank").agg(F.count(F.lit(1)).alias("size"))
    count = inside.groupBy("rank").agg(F.count(F.lit(1)).alias("n_edges"))
    rows = size.join(count, "rank").withColumn("cohesion", F.col("n_edges") / F.col("size"))
    return graph.composite_score(rows.join(_profile(spark, d, members), "rank")).select("rank", "score", "tier")


@query("communities")
def communities(spark, d):
    """On pairs that met in two cases or more: single meetings are one blob of chance pairs."""
    return graph.communities(edges_of(spark, d, min_weight=2))


@query("community_summary")
def community_summary(spark, d):
    """Modularity and number of the detected communities, next to those of plain components."""
    edges = edges_of(spark, d, min_weight=2)
    found = graph.modularity(edges, graph.communities(edges)).withColumn("labelling", F.lit("communities"))
    parts = graph.components(edges).withColumnRenamed("component", "community")
    return found.unionByName(graph.modularity(edges, parts).withColumn("labelling", F.lit("components")))


@query(
    "merged_edges",
    C,
    """WITH core AS (SELECT rank, node FROM mdeg WHERE position <= 22),
same AS (SELECT least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, 1 AS weight FROM core a JOIN core b ON a.rank = b.rank AND a.node < b.node)
SELECT src, dst, arg_min(weight, k) AS weight FROM (SELECT src, dst, weight, 0 AS k FROM edges UNION ALL SELECT src, dst, weight, 1 FROM same) GROUP BY src, dst""",
)
def merged_edges(spark, d):
    """Shared-case edges together with same-core edges; cores are at most 22 members, so pairs are few."""
    members = _members(spark, d)
    edges = edges_of(spark, d)
    core = graph.ranked_members(members, cut_lineage(graph.inner_edges(edges, members)), limit=22)
    lists = core.groupBy("rank").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    )
    same = lists.select(F.explode(pairs).alias("p")).select("p.*", F.lit(1).cast("bigint").alias("weight"))
    return graph.merge_edge_kinds(edges, same)


@query(
    "repeat_entities",
    "inc ce",
    """WITH t AS (SELECT entity_id, count(DISTINCT case_id) AS total_cases FROM ce GROUP BY entity_id ORDER BY total_cases DESC, entity_id LIMIT 100)
SELECT entity_id, total_cases, array_to_string(list_sort(list(DISTINCT category_name))[1:5], ', ') AS types, array_to_string(list_sort(list(DISTINCT region_name))[1:5], ', ') AS regions,
min(ts) AS first_incident, max(ts) AS last_incident FROM t JOIN ce USING (entity_id) LEFT JOIN inc ON incident_id = case_id GROUP BY entity_id, total_cases""",
)
def repeat_entities(spark, d):
    return entities.repeat_entities(tables.case_entity(spark, d), tables.order_incidents(spark, d))


view(
    "ent",
    "SELECT entity_id, case_id, category_name, region_name, severity_id, ts FROM (SELECT DISTINCT entity_id, case_id FROM ce) JOIN inc ON incident_id = case_id",
)


@query(
    "entity_profiles",
    "inc " + C + " ends ent",
    """WITH ch AS (SELECT DISTINCT l_orderkey AS case_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
b AS (SELECT entity_id, count(*) AS total_cases, count(ch.case_id) AS charged_cases, max(CASE WHEN ch.case_id IS NOT NULL THEN ts END) AS last_charged, count(DISTINCT region_name) AS n_regions,
  round(avg(CASE WHEN severity_id = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS severe_share, min(ts) AS first_incident, max(ts) AS last_incident,
  round(date_diff('day', min(ts), max(ts)) / 365.25, 1) AS span_years FROM ent LEFT JOIN ch USING (case_id) GROUP BY entity_id),
rg AS (SELECT entity_id, string_agg(region_name || '=' || n, ';' ORDER BY n DESC, region_name) AS regions FROM (SELECT entity_id, region_name, count(*) AS n FROM ent GROUP BY ALL) GROUP BY entity_id),
ty AS (SELECT entity_id, string_agg(category_name || '=' || n, ';' ORDER BY n DESC, category_name) AS types FROM (SELECT entity_id, category_name, count(*) AS n FROM ent GROUP BY ALL) GROUP BY entity_id),
a AS (SELECT node AS entity_id, count(*) AS n_associates, string_agg(other || '=' || weight, ';' ORDER BY r) FILTER (r <= 10) AS associates
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM ends) GROUP BY node)
SELECT b.*, mem.rank AS community, types, coalesce(regions, '') AS regions, coalesce(n_associates, 0) AS n_associates, coalesce(associates, '') AS associates FROM b JOIN ty USING (entity_id) JOIN rg USING (entity_id) LEFT JOIN a USING (entity_id) LEFT JOIN mem ON mem.node = entity_id""",
)
def entity_profiles(spark, d):
    out = entities.entity_profiles(
        tables.case_entity(spark, d), tables.order_incidents(spark, d), tables.charged_cases(spark, d), edges_of(spark, d),
        members=_members(spark, d),
    )
    flat = lambda c, k, v: F.coalesce(
        F.array_join(F.transform(c, lambda x: F.concat(x[k].cast("string"), F.lit("="), x[v].cast("string"))), ";"), F.lit("")
    )
    return out.select(
        "entity_id", "total_cases", "charged_cases", "last_charged", "n_regions", F.round("severe_share", 6).alias("severe_share"),
        "first_incident", "last_incident", "span_years", flat("types", "label", "n").alias("types"), "n_associates",
        flat("regions", "label", "n").alias("regions"), F.col("community").cast("int").alias("community"),
        flat("associates", "entity", "shared_cases").alias("associates"),
    )


@query(
    "local_entities",
    "inc ce ent",
    """WITH h AS (SELECT entity_id, region_name, count(*) AS here FROM ent GROUP BY ALL), o AS (SELECT entity_id, count(*) AS overall FROM ent GROUP BY entity_id)
SELECT entity_id, region_name, here, overall, CAST(row_number() OVER (PARTITION BY region_name ORDER BY here DESC, overall DESC, entity_id) AS INTEGER) AS position
FROM h JOIN o USING (entity_id) QUALIFY position <= 5""",
)
def local_entities(spark, d):
    return entities.local_entities(tables.case_entity(spark, d), tables.order_incidents(spark, d))


@query(
    "entity_search",
    "ce",
    """SELECT p_name || ' ' || p_partkey AS label, count(DISTINCT case_id) AS total_cases FROM ce JOIN part ON p_partkey = entity_id WHERE contains(lower(p_name), 'ring')
GROUP BY label ORDER BY total_cases DESC, label LIMIT 8""",
)
def entity_search(spark, d):
    names = tables.table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label")
    )
    rows = entities.case_counts(tables.case_entity(spark, d)).join(names, "entity_id")
    return entities.search(rows, "label", "total_cases", "Ring").select("label", "total_cases")


@query(
    "region_search",
    "inc",
    "SELECT region_name, count(*) AS n FROM inc WHERE contains(lower(region_name), 'n_1') GROUP BY region_name ORDER BY region_name LIMIT 8",
)
def region_search(spark, d):
    counts = tables.order_incidents(spark, d).groupBy("region_name").agg(F.count(F.lit(1)).alias("n"))
    return entities.search(counts, "region_name", "n", "N_1", by_volume=False)


@query(
    "corridors",
    "inc ce ent",
    """WITH s AS (SELECT entity_id, region_name AS to_region, lag(region_name) OVER (PARTITION BY entity_id ORDER BY ts, case_id) AS from_region FROM ent)
SELECT from_region, to_region, count(*) AS n_transitions, count(DISTINCT entity_id) AS n_entities FROM s WHERE from_region <> to_region GROUP BY ALL""",
)
def corridors(spark, d):
    return entities.region_moves(tables.case_entity(spark, d), tables.order_incidents(spark, d))


@query(
    "mobility_summary",
    "inc ce ent",
    """SELECT count(*) AS total_entities, count(*) FILTER (n > 1) AS multi_region, round(count(*) FILTER (n > 1) / count(*) * 100, 1) AS multi_region_pct
FROM (SELECT entity_id, count(DISTINCT region_name) AS n FROM ent GROUP BY entity_id)""",
)
def mobility_summary(spark, d):
    return entities.mobility_summary(tables.case_entity(spark, d), tables.order_incidents(spark, d))
