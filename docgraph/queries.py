"""Registered queries of the graph operators over the driver's tables, each with oracle SQL.

Graph view of the tables: region, nation, customer and orders as a containment tree; lineitem as an association with order,
part and supplier; supplier refers to nation; events are roles that represent a user's hub; parts are entities to resolve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.functions import scalars
from docgraph.operators import build, graph, mapping, reports, resolve
from docgraph.operators.store import GraphStore
from docgraph.plans import entity_types
from docgraph.scratch import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key and ``columns`` dealt by the key: a file is read by no more tasks than it has row groups, too few for work in Python."""
    return rows.select(key, *columns).repartition(key)


def _id(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(kind), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _elements(rows: DataFrame, file: str, **columns: Column) -> DataFrame:
    """Rows as classified elements of one file: the given columns, and defaults for the others that edges are made of."""
    default = {"doc_id": F.lit("d"), "source_file": F.lit(file), "upload_id": F.lit("u"), "ord": F.lit(0), "parent_ord": F.lit(None).cast("int"), "is_role": F.lit(True), "is_node": F.lit(True), "is_assoc": F.lit(False), "is_nil": F.lit(False)}
    default |= {c: F.lit(None).cast("string") for c in ("id", "qname", "uri_id", "sid", "sref", "suri")}
    return rows.select(*[columns.get(c, default[c]).alias(c) for c in default])


def contains(spark: SparkSession, d: str) -> DataFrame:
    """CONTAINS edges region -> nation -> customer -> order."""
    n = _t(spark, d, "nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"))
    c = _t(spark, d, "customer").select(_id("n", "c_nationkey"), _id("c", "c_custkey"))
    o = _t(spark, d, "orders").select(_id("c", "o_custkey"), _id("o", "o_orderkey"))
    return n.union(c).union(o).withColumn("rel_type", F.lit("CONTAINS"))


CONTAINS = """contains AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL
  SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def part_entities(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = _t(spark, d, "part")
    return p.select(_id("p", "p_partkey").alias("node_id"), F.lit("part").alias("qname"), F.col("p_brand").alias("source_file"), F.col("p_type").alias("upload_id"), F.col("p_name").alias("full_name"), *[none.alias(c) for c in resolve.FEATURES if c != "full_name"])


KEYED = "keyed AS (SELECT p_partkey, p_brand, p_type, p_name, replace(lower(trim(p_name)), ' ', '_') AS match_key FROM part WHERE trim(p_name) <> '')"
CLUSTERS = f"{KEYED}, clusters AS (SELECT match_key, 'RE_' || substr(sha256(match_key), 1, 12) AS entity_id, count(*) AS n FROM keyed GROUP BY 1 HAVING count(*) >= 2)"


@query(
    f"""WITH {KEYED} SELECT 'RE_' || substr(sha256(match_key), 1, 12) AS entity_id, min_by(p_name, 'p' || p_partkey) AS name, match_key, count(*) AS resolved_count,
    string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS source_docs, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS upload_ids FROM keyed GROUP BY match_key HAVING count(*) >= 2"""
)
def er_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    clusters, _ = resolve.text_clusters(part_entities(spark, d))
    return clusters.select("entity_id", "name", "match_key", "resolved_count", F.array_join("source_docs", ",").alias("source_docs"), F.array_join("upload_ids", ",").alias("upload_ids"))


@query(f"WITH {CLUSTERS} SELECT 'p' || p_partkey AS node_id, entity_id, 0.95::DOUBLE AS confidence, 'full_name' AS matched_on FROM keyed JOIN clusters USING (match_key)")
def er_members(spark: SparkSession, d: str) -> DataFrame:
    return resolve.text_clusters(part_entities(spark, d))[1]


def _part_links(spark: SparkSession, d: str) -> DataFrame:
    """Parts on one order: an edge from each line to the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = _t(spark, d, "lineitem").withColumn("next", F.lead("l_partkey").over(w)).filter("next IS NOT NULL")
    return li.select(_id("p", "l_partkey").alias("src"), _id("p", "next").alias("dst"), F.lit("NEXT_ON_ORDER").alias("rel_type")).distinct()


@query(
    f"""WITH {CLUSTERS}, m AS (SELECT p_partkey, entity_id FROM keyed JOIN clusters USING (match_key)),
    e AS (SELECT DISTINCT l_partkey AS a, b FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL)
    SELECT x.entity_id AS src, y.entity_id AS dst, 'NEXT_ON_ORDER' AS rel_type, count(*) AS n FROM e JOIN m x ON x.p_partkey = a JOIN m y ON y.p_partkey = b GROUP BY 1, 2"""
)
def er_edge_lift(spark: SparkSession, d: str) -> DataFrame:
    _, members = resolve.text_clusters(part_entities(spark, d))
    return resolve.lift_edges(_part_links(spark, d), members)


@query(f"WITH {KEYED} SELECT match_key, count(DISTINCT p_brand) AS n_sources FROM keyed GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT p_brand) > 1")
def er_cross_source(spark: SparkSession, d: str) -> DataFrame:
    clusters, _ = resolve.text_clusters(part_entities(spark, d))
    return clusters.filter(F.size("source_docs") > 1).select("match_key", F.size("source_docs").cast("long").alias("n_sources"))


@query(
    """SELECT 'Entity_' || user_id AS label, count(*) AS role_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS role_types
    FROM events GROUP BY user_id HAVING count(*) >= 2"""
)
def hub_detection(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.lit("d").alias("doc_id"), F.col("user_id").cast("string").alias("uri_id"), F.lit(None).cast("string").alias("sid"), F.lit(False).alias("is_nil"), F.col("event_type").alias("qname"))
    return build.find_hubs(e).select(F.concat(F.lit("Entity_"), "uri_id").alias("label"), "role_count", F.array_join("role_types", ",").alias("role_types"))


@query(
    """SELECT 'e' || event_id AS src, substr(sha1('events_u'), 1, 8) || '_' || user_id AS dst, CAST(user_id AS VARCHAR) AS id_value, event_type AS role_qname FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 2)"""
)
def represents_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(_t(spark, d, "events"), "events", id=_id("e", "event_id"), uri_id=F.col("user_id").cast("string"), qname=F.col("event_type"), ord=F.col("event_id").cast("int"))
    hubs = build.find_hubs(e).select("doc_id", "uri_id")
    return build.represents(e.join(hubs, ["doc_id", "uri_id"], "left_semi"), build.prefix()).select("src", "dst", F.col("props")["id_value"].alias("id_value"), F.col("props")["role_qname"].alias("role_qname"))


@query(
    f"""WITH {CONTAINS} SELECT src, dst, 1 AS hops FROM contains UNION ALL SELECT a.src, b.dst, 2 FROM contains a JOIN contains b ON a.dst = b.src
    UNION ALL SELECT a.src, c.dst, 3 FROM contains a JOIN contains b ON a.dst = b.src JOIN contains c ON b.dst = c.src"""
)
def contains_1_3(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(contains(spark, d), 1, 3, ["CONTAINS"]).select("src", "dst", "hops")


@query(
    f"""WITH RECURSIVE {CONTAINS}, below AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region
    UNION ALL SELECT root, dst, depth + 1 FROM below JOIN contains ON src = id) SELECT root, depth, count(*) AS n FROM below GROUP BY 1, 2"""
)
def contains_unbounded(spark: SparkSession, d: str) -> DataFrame:
    roots = _t(spark, d, "region").select(_id("r", "r_regionkey").alias("id"))
    return graph.descendants(contains(spark, d), ["CONTAINS"], roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(
    """SELECT 'o' || o_orderkey AS id, r_name || '/' || n_name || '/' || c_name AS hierarchy FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def hierarchy_path(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select(_id("o", "o_orderkey").alias("id"), F.concat_ws("/", "r_name", "n_name", "c_name").alias("hierarchy"))


@query("SELECT 'c' || c_custkey AS id, count(o_orderkey) AS n_large FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
def optional_match(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").select(_id("c", "c_custkey").alias("id"))
    orders = _t(spark, d, "orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"), F.lit("CONTAINS").alias("rel_type"), "o_totalprice")
    return graph.hop(customers, orders, ["CONTAINS"], optional=True, where=F.col("o_totalprice") > 200000).groupBy("id").agg(F.count("other").alias("n_large"))


@query(f"WITH {CONTAINS} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM contains UNION ALL SELECT dst FROM contains) GROUP BY 1")
def undirected_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(contains(spark, d))


@query(f"WITH {CONTAINS} SELECT id, CAST(greatest(20, least(40, 20 + count(*))) AS BIGINT) AS size FROM (SELECT src AS id FROM contains UNION ALL SELECT dst FROM contains) GROUP BY 1")
def degree_clamped(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(contains(spark, d)).select("id", graph.display_size(F.col("degree")).alias("size"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = _t(spark, d, "labels").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("LABELS").alias("rel_type"))
    return graph.orphans(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), edges)


@query(
    """SELECT id, count(*) AS n_refs FROM (SELECT 'Entity_' || user_id AS id FROM events UNION ALL SELECT 'n' || s_nationkey FROM supplier) GROUP BY 1 HAVING count(*) > 1"""
)
def multi_ref_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.concat(F.lit("Entity_"), F.col("user_id").cast("string")).alias("id"))
    return e.unionByName(_t(spark, d, "supplier").select(_id("n", "s_nationkey").alias("id"))).groupBy("id").agg(F.count("*").alias("n_refs")).filter("n_refs > 1")


@query(
    """SELECT 'n' || a.s_nationkey AS target, 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey
    AND 's' || a.s_suppkey < 's' || b.s_suppkey"""
)
def same_role_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    edges = s.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), F.lit("REFERS_TO").alias("rel_type"))
    return graph.same_target_pairs(edges, s.select(_id("s", "s_suppkey").alias("id"), F.lit("supplier").alias("qname")), ["REFERS_TO"])


ENDPOINTS = """SELECT 'l' || l_orderkey || '_' || l_linenumber AS src, substr(sha1('lineitem_u'), 1, 8) || '_o' || l_orderkey AS dst, 'order' AS role_qname, 'source' AS direction FROM lineitem
UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, substr(sha1('lineitem_u'), 1, 8) || '_p' || l_partkey, 'part', 'target' FROM lineitem
UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, substr(sha1('lineitem_u'), 1, 8) || '_s' || l_suppkey, 'supplier', 'target' FROM lineitem"""


def association_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each line as an association that refers to its order, part and supplier."""
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    li = _t(spark, d, "lineitem").select("*", F.lit("d").alias("doc_id"), F.lit("lineitem").alias("source_file"), F.lit("u").alias("upload_id"))
    ends = [("order", _id("o", "l_orderkey")), ("part", _id("p", "l_partkey")), ("supplier", _id("s", "l_suppkey"))]
    edges = build.wide_association_edges(li, line, ends, build.prefix())
    return edges.select("src", "dst", F.col("props")["role_qname"].alias("role_qname"), F.col("props")["direction"].alias("direction"))


@query(ENDPOINTS)
def assoc_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return association_edges(spark, d)


@query(f"SELECT role_qname, direction, count(*) AS n, count(DISTINCT dst) AS n_targets FROM ({ENDPOINTS}) GROUP BY 1, 2")
def assoc_by_role(spark: SparkSession, d: str) -> DataFrame:
    return association_edges(spark, d).groupBy("role_qname", "direction").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_targets"))


@query(
    """SELECT * FROM (SELECT 'region' AS qname, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)"""
)
def node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("region", "nation", "customer", "orders", "part", "supplier"):
        part = _t(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("qname"), "n")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("n"), "qname")


@query(f"WITH {CONTAINS} SELECT 'CONTAINS' AS rel_type, count(*) AS n FROM contains UNION ALL SELECT 'ASSOCIATED_WITH', 3 * count(*) FROM lineitem UNION ALL SELECT 'REFERS_TO', count(*) FROM supplier")
def rel_type_counts(spark: SparkSession, d: str) -> DataFrame:
    e = contains(spark, d).select("rel_type").unionByName(association_edges(spark, d).select(F.lit("ASSOCIATED_WITH").alias("rel_type"))).unionByName(_t(spark, d, "supplier").select(F.lit("REFERS_TO").alias("rel_type")))
    return e.groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type")


@query("SELECT source, lang, count(*) AS nodes, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def upload_stats(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("nodes"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderkey, 'syn_' || substr(sha1('orders|' || o_custkey || '|' || o_orderkey), 1, 16) AS id, substr(sha1('orders' || '_' || o_orderpriority), 1, 8) AS prefix FROM orders")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("*", F.lit("orders").alias("source_file"), F.col("o_orderpriority").alias("upload_id"))
    spot = F.concat_ws("|", F.lit("orders"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", build.synthetic_id(spot).alias("id"), build.prefix().alias("prefix"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_shred_props(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, CAST(i AS BIGINT) AS place, l AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS l, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS i FROM pages)")
def markup_links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("p", "href")).select("page_id", (F.col("p") + 1).cast("long").alias("place"), "href")


@query("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '\\s([a-z-]+)=\"', 1)) AS name FROM pages) GROUP BY 1")
def markup_attrs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'\s([a-z-]+)="'), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT conv_id, 'c_conversation__c_turn__' || role AS key, count(*) AS n FROM conversations GROUP BY 1, 2")
def flatten_keys(spark: SparkSession, d: str) -> DataFrame:
    key = build.flat_key(F.array(F.lit("c:conversation"), F.lit("c.turn"), F.col("role")))
    return _t(spark, d, "conversations").groupBy("conv_id", key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY 1")
def repeat_collect(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderkey").alias("ord"))
    return build.merge_nodes(rows, ("o_custkey",)).drop("ord")


@query(
    """SELECT p_partkey, 'p_brand' AS brand_key, p_brand AS brand, CAST((CASE WHEN p_name LIKE '%e%' THEN 1 ELSE 0 END) AS BOOLEAN) AS has_e FROM part"""
)
def key_suffix_extract(spark: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("p_name"), F.col("p_name"), F.lit("p_brand"), F.col("p_brand"), F.lit("p_type"), F.col("p_type"))
    p = _t(spark, d, "part").select("p_partkey", props.alias("props")).withColumn("brand_key", graph.first_key(lambda k: scalars.key_ends(k, "Brand")))
    return p.select("p_partkey", "brand_key", F.try_element_at("props", "brand_key").alias("brand"), graph.prop("p_name").contains("e").alias("has_e"))


@query("SELECT event_type, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value >= 40 AND value < 80) AS medium, count(*) FILTER (value < 40) AS low FROM events GROUP BY 1")
def match_quality_hist(spark: SparkSession, d: str) -> DataFrame:
    band = resolve.quality(F.col("value"), 80, 40)
    rows = _t(spark, d, "events").filter("value IS NOT NULL").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"))
    return rows.groupBy("event_type").pivot("band", ["high", "medium", "low"]).agg(F.sum("n")).fillna(0)


@query(f"WITH {KEYED} SELECT match_key, count(*) AS n FROM keyed GROUP BY 1 ORDER BY n DESC, match_key LIMIT 10")
def top10_match_keys(spark: SparkSession, d: str) -> DataFrame:
    return resolve.match_keys(part_entities(spark, d)).groupBy("match_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match_key").limit(10)


@query("SELECT o_orderpriority AS feature, round(avg(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 75 ELSE 50 END), 2) AS score FROM orders GROUP BY 1")
def feature_score_avg(spark: SparkSession, d: str) -> DataFrame:
    usage = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 75).otherwise(50)
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(F.round(F.avg(usage), 2).alias("score"))


@query("SELECT event_id, round(CASE WHEN value > 100 THEN least(value / 1000, 1.0) WHEN value > 1 THEN value / 100 ELSE coalesce(value, 0) END, 6) AS confidence FROM events")
def confidence_norm(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.round(scalars.confidence(F.col("value")), 6).alias("confidence"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_us, strftime(o_orderdate, '%Y-%m-%d') AS from_compact, 'n/a' AS unknown FROM orders")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    o, day = _t(spark, d, "orders"), F.col("o_orderdate")
    us = F.when(F.dayofmonth(day) > 12, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return o.select("o_orderkey", scalars.normal_date(us).alias("from_us"), scalars.normal_date(F.date_format(day, "yyyyMMdd")).alias("from_compact"), scalars.normal_date(F.lit("n/a")).alias("unknown"))


@query(
    """SELECT qname, CASE WHEN regexp_matches(lower(qname), 'person|driver|passenger|child|parent|guardian|witness|victim|subject|arrest|defendant|plaintiff|juror') THEN 'person' WHEN regexp_matches(lower(qname), 'organization|org|company|agency|department|unit|employer|enforcement') THEN 'organization'
    WHEN regexp_matches(lower(qname), 'address|location|place') THEN 'address' WHEN regexp_matches(lower(qname), 'vehicle|conveyance|car|aircraft|vessel|boat') THEN 'vehicle' ELSE 'other' END AS category
    FROM (SELECT DISTINCT p_type || 'Person' AS qname FROM part UNION SELECT DISTINCT o_orderpriority || 'Agency' FROM orders UNION SELECT DISTINCT event_type || ':Place' FROM events)"""
)
def category_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "part").select(F.concat("p_type", F.lit("Person")).alias("qname")).union(_t(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("Agency")))).union(_t(spark, d, "events").select(F.concat("event_type", F.lit(":Place"))))
    return q.distinct().select("qname", scalars.category(F.col("qname")).alias("category"))


@query(
    """WITH p AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p)
    UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM p)"""
)
def file_filter_induced(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), F.array(F.lit("customer")).alias("labels"), (F.col("c_mktsegment") == "BUILDING").alias("chosen"))
    o = _t(spark, d, "orders").select(_id("o", "o_orderkey").alias("id"), F.array(F.lit("orders")).alias("labels"), F.lit(False).alias("chosen"))
    n = _t(spark, d, "nation").select(_id("n", "n_nationkey").alias("id"), F.array(F.lit("nation")).alias("labels"), F.lit(False).alias("chosen"))
    edges = contains(spark, d).filter(~F.col("src").startswith("r"))
    return graph.induced(c.unionByName(o).unionByName(n), edges, F.col("chosen")).edges.select("src", "dst")


@query("SELECT lower(event_type) AS severity, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS line_sum FROM events GROUP BY 1")
def issue_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), "event_type", F.lit("] a.xml:"), (F.col("event_id") % 7).cast("string"), F.lit(":3: message"))
    parsed = _t(spark, d, "events").select(line.alias("line")).select(*[c.alias(k) for k, c in scalars.issue_fields(F.col("line")).items()])
    return parsed.groupBy("severity").agg(F.count("*").alias("n"), F.sum("line").alias("line_sum"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def setops_union(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def setops_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def setops_except(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER w AS first_order, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_first_last(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.first("o_orderkey").over(w).alias("first_order"), F.row_number().over(w).cast("long").alias("place"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_types(spark: SparkSession, d: str) -> DataFrame:
    out = _t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT c_nationkey, c_custkey, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, d, "customer").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("c_nationkey", "c_custkey", "place")


@query(f"WITH {CONTAINS} SELECT src, rel_type, dst FROM (SELECT *, 'CONTAINS' AS rel_type FROM contains) ORDER BY src, rel_type, dst LIMIT 500")
def full_graph_limited(spark: SparkSession, d: str) -> DataFrame:
    nodes = contains(spark, d).select(F.col("dst").alias("id"), F.array(F.lit("node")).alias("labels"))
    return graph.full_graph(nodes, contains(spark, d)).edges.select("src", "rel_type", "dst")


@query(f"WITH {KEYED} SELECT match_key, count(*) AS rows FROM keyed GROUP BY 1 HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicates(resolve.match_keys(part_entities(spark, d)), ["match_key"])


@query(
    f"""WITH RECURSIVE {CONTAINS}, u AS (SELECT src AS a, dst AS b FROM contains UNION SELECT dst, src FROM contains),
    w AS (SELECT 'n0' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN u ON a = node WHERE hops < 2)
    SELECT 'n0' AS source, node AS target, min(hops) AS hops FROM w GROUP BY node"""
)
def bounded_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = contains(spark, d)
    start = spark.createDataFrame([("n0",)], "id string")
    return graph.shortest(edges, start, edges.select(F.explode(F.array("src", "dst")).alias("id")), 2)


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _nation_documents(spark: SparkSession, d: str) -> DataFrame:
    """Elements of nations written as XML documents."""
    from docgraph.session import ship_package
    from docgraph.sources.shred import shred

    ship_package(spark)
    n = _t(spark, d, "nation")
    text = F.concat(F.lit('<t:Nation xmlns:t="http://example.org/t/" xmlns:s="http://example.org/structures/5.0/" s:id="N'), F.col("n_nationkey").cast("string"), F.lit('"><t:Name>'), "n_name", F.lit("</t:Name><t:Region><t:Key>"), F.col("n_regionkey").cast("string"), F.lit("</t:Key></t:Region></t:Nation>"))
    return shred(n.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat("n_name", F.lit(".xml")).alias("source_file"), F.lit("u").alias("upload_id"), text.alias("content")))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 't_Nation' AS label, 't_Name' AS key, n_name AS value FROM nation UNION ALL
    SELECT CAST(n_nationkey AS VARCHAR), 't_Region', 't_Key', CAST(n_regionkey AS VARCHAR) FROM nation"""
)
def xml_shred_nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations as XML documents, shredded and built: nodes with their properties."""
    g = build.build_graph(_nation_documents(spark, d))
    return g.nodes.select("doc_id", "label", F.explode("props").alias("key", "value"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, '{"t:Nation":{"@id":"N' || n_nationkey || '","t:Name":"' || n_name || '","t:Region":{"t:Key":"' || n_regionkey || '"}}}' AS json FROM nation"""
)
def xml_to_json_nations(spark: SparkSession, d: str) -> DataFrame:
    from docgraph.operators.records import xml_to_json

    return xml_to_json(_nation_documents(spark, d)).select("doc_id", "json")


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_shred_events(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as JSON documents, shredded and built."""
    from docgraph.session import ship_package
    from docgraph.sources.shred import shred

    ship_package(spark)
    docs = _spread(_t(spark, d, "events"), "event_id", "props").select(F.col("event_id").cast("string").alias("doc_id"), F.lit("event.json").alias("source_file"), F.lit("u").alias("upload_id"), F.col("props").alias("content"))
    return build.build_graph(shred(docs)).props.select("doc_id", "key", "value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 AS fits, count(*) AS n FROM events GROUP BY 1")
def json_valid_events(spark: SparkSession, d: str) -> DataFrame:
    from docgraph.operators.records import validate_json
    from docgraph.session import ship_package

    ship_package(spark)
    docs = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("source_file"), F.col("props").alias("content"))
    issues = validate_json(docs, {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}).select(F.col("file").alias("source_file")).distinct()
    return docs.join(issues.withColumn("bad", F.lit(True)), "source_file", "left").groupBy(F.col("bad").isNull().alias("fits")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE k AS (SELECT 'p' || p_partkey AS id, replace(lower(trim(p_name)), ' ', '_') AS name, trim(p_brand) AS brand FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> ''),
    s AS (SELECT name, brand, min(id) AS id, count(*) AS n FROM k GROUP BY 1, 2), e AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.brand = b.brand AND a.id <> b.id AND levenshtein(a.name, b.name) <= 2),
    r AS (SELECT id AS root, id FROM s UNION SELECT r.root, e.v FROM r JOIN e ON r.id = e.u), c AS (SELECT root, min(r.id) AS component, sum(s.n) AS size FROM r JOIN s ON s.id = r.id GROUP BY root)
    SELECT k.id AS node_id, 'SE_' || substr(sha256(component), 1, 12) AS entity_id FROM k JOIN s USING (name, brand) JOIN c ON c.root = s.id WHERE size > 1"""
)
def er_scored_equal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Scored matching of name and address, for which brands stand: names within two edits and equal brands reach the score."""
    e = part_entities(spark, d).withColumn("address", F.col("source_file"))
    return resolve.scored_clusters(e).select("node_id", "entity_id")


def _supplier_documents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as XML documents with a nested name, a contact with attributes, an augmentation and an element that is in no model."""
    from docgraph.session import ship_package
    from docgraph.sources.shred import shred

    ship_package(spark)
    s, key = _t(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('<t:Supplier xmlns:t="http://example.org/t/" xmlns:s="http://example.org/structures/5.0/" s:id="S'), key, F.lit('" t:grade="A'), key, F.lit('"><t:Name><t:Full>'), "s_name",
        F.lit("</t:Full><t:Full>second</t:Full></t:Name><t:Name><t:Full>other</t:Full></t:Name><t:SupplierAugmentation><t:Nation>"), F.col("s_nationkey").cast("string"), F.lit("</t:Nation></t:SupplierAugmentation><t:Odd>x"), key, F.lit("</t:Odd></t:Supplier>"),
    )
    return shred(s.select(key.alias("doc_id"), F.concat(F.lit("s"), key, F.lit(".xml")).alias("source_file"), F.lit("u").alias("upload_id"), text.alias("content")))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'full' AS key, s_name AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 't_grade', 'A' || s_suppkey FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier"""
)
def mapped_properties(spark: SparkSession, d: str) -> DataFrame:
    """Mapping mode: properties by path and by attribute, the first child at every step, and those of an augmentation."""
    m = mapping.load_mapping(
        """{"objects": [{"qname": "t:Supplier", "scalar_props": [{"path": "t:Name/t:Full", "property": "full"}, {"path": "@t:grade"}, {"path": "t:Gone/t:Full"}]}],
        "augmentations": [{"qname": "t:SupplierAugmentation", "properties": [{"qname": "t:Nation", "property": "nation"}]}]}"""
    )
    e = written(build.with_owner(build.classify(written(_supplier_documents(spark, d), "elements"), m.objects, m.associations)), "classified")
    return mapping.extra_props(m)(e).select("doc_id", "key", "value")


@query("SELECT 't:Odd' AS qname, count(*) AS n FROM supplier UNION ALL SELECT 't:SupplierAugmentation', count(*) FROM supplier")
def unknown_elements(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("t:Supplier",), ("t:Name",), ("t:Full",), ("t:Nation",)], "qname string")
    return mapping.element_names(mapping.unknown_elements(_supplier_documents(spark, d), known))


@query(
    """SELECT n_name AS name, n_nationkey % 5 = 0 OR n_nationkey % 4 = 1 OR (n_nationkey % 4 = 2 AND n_nationkey % 6 = 0) OR regexp_matches(n_name || 'Type', 'Date|Time|Text|Indicator|Boolean|Code|Category|Amount|Quantity|Measure|Numeric|ID|Identification|Value|Description|Count|Percent|Rate|Duration|Abstract') AS is_wrapper,
    n_nationkey % 4 = 3 OR (NOT (n_nationkey % 5 = 0 OR n_nationkey % 4 = 1 OR (n_nationkey % 4 = 2 AND n_nationkey % 6 = 0) OR regexp_matches(n_name || 'Type', 'Date|Time|Text|Indicator|Boolean|Code|Category|Amount|Quantity|Measure|Numeric|ID|Identification|Value|Description|Count|Percent|Rate|Duration|Abstract')) AND n_nationkey % 6 >= 3) AS is_entity
    FROM nation WHERE NOT regexp_matches(n_name, 'Person|Case|Item|Role')"""
)
def entity_and_wrapper_types(spark: SparkSession, d: str) -> DataFrame:
    """Nations as declared elements whose types extend nothing, a simple type, an own type, or one below a person's."""
    k, n = F.col("n_nationkey"), _t(spark, d, "nation").filter(~F.col("n_name").rlike("Person|Case|Item|Role"))
    base = F.when(k % 4 == 1, "xs:string").when(k % 4 == 2, "t:OwnType").when(k % 4 == 3, "t:MiddleType")
    types = n.select(F.concat(F.lit("t:"), "n_name", F.lit("Type")).alias("name"), base.alias("base"), (k % 5 == 0).alias("is_simple"), (k % 6).cast("int").alias("n_elements"))
    types = types.unionByName(spark.createDataFrame([("t:MiddleType", "nc:PersonType", False, 1)], "name string, base string, is_simple boolean, n_elements int"))
    declared = n.select(F.concat(F.lit("t:"), "n_name").alias("name"), F.concat(F.lit("t:"), "n_name", F.lit("Type")).alias("type"))
    return entity_types.entity_flags(declared, types).select(F.substring_index("name", ":", -1).alias("name"), "is_wrapper", "is_entity")


@query("SELECT n_name AS name, 'person' AS category FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_name, 'organization' FROM nation WHERE n_nationkey % 3 = 2")
def schema_based_categories(spark: SparkSession, d: str) -> DataFrame:
    """Nations that stand in for a person, through another element, or have a type derived from an organization's in two steps."""
    k, n = F.col("n_nationkey"), _t(spark, d, "nation")
    declared = n.select(F.col("n_name").alias("name"), F.when(k % 3 == 2, "t:BType").alias("type"), F.when(k % 3 == 1, "t:Someone").alias("substitution_group"))
    declared = declared.unionByName(spark.createDataFrame([("t:Someone", None, "nc:Person")], declared.schema))
    types = spark.createDataFrame([("t:AType", "nc:OrganizationType"), ("t:BType", "t:AType")], "name string, base string")
    return entity_types.schema_categories(declared, types).filter("name <> 't:Someone'")


@query(
    f"""WITH {CLUSTERS}, m AS (SELECT p_partkey, entity_id FROM keyed JOIN clusters USING (match_key)), e AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM m x JOIN m y ON y.p_partkey = x.p_partkey + 1)
    SELECT 'entities_extracted' AS name, (SELECT count(*) FROM part WHERE p_name IS NOT NULL) AS n UNION ALL SELECT 'duplicate_groups', (SELECT count(*) FROM clusters) UNION ALL SELECT 'clusters_created', (SELECT count(*) FROM clusters)
    UNION ALL SELECT 'entities_resolved', (SELECT count(*) FROM m) UNION ALL SELECT 'relationships_created', (SELECT count(*) FROM m) + (SELECT count(*) FROM e)"""
)
def er_run_counters(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over parts as nodes, each with an edge to the next."""
    p = _t(spark, d, "part")
    nodes = p.select(_id("p", "p_partkey").alias("id"), F.lit("part").alias("qname"), F.lit("f").alias("source_file"), F.lit("u").alias("upload_id"), F.create_map(F.lit("t_PersonFullName"), F.col("p_name")).alias("props"))
    edges = p.select(_id("p", "p_partkey").alias("src"), _id("p", F.col("p_partkey") + 1).alias("dst"), F.lit("NEXT").alias("rel_type"))
    done = resolve.run_resolution(nodes, edges, ["part"])
    return spark.createDataFrame(list(done.counts.items()), "name string, n long")


@query(
    """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT (SELECT count(*) FROM events) AS files, count(*) FILTER (event_id % 10 <> 0 AND k BETWEEN 10 AND 60) AS successful, count(*) FILTER (event_id % 10 = 0 OR k NOT BETWEEN 10 AND 60) AS failed,
    count(*) FILTER (event_id % 10 = 0 OR k NOT BETWEEN 10 AND 60) AS errors, 0::BIGINT AS warnings FROM k"""
)
def batch_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON files, some of them broken or out of bounds: outcomes of a validation run."""
    from docgraph.operators import records
    from docgraph.session import ship_package

    ship_package(spark)
    e = _t(spark, d, "events")
    docs = e.select(F.col("event_id").cast("string").alias("source_file"), F.when(F.col("event_id") % 10 == 0, "{").otherwise(F.col("props")).alias("content"))
    schema = {"definitions": {"small": {"minimum": 10, "maximum": 60}}, "properties": {"k": {"$ref": "#/definitions/small"}}, "required": ["k"]}
    return reports.batch_totals(reports.batch_outcomes(docs, records.validate_json(docs, schema)))


@query("SELECT 'n' || s_nationkey AS target, 's' || s_suppkey AS id, first FROM supplier JOIN (SELECT s_nationkey, min('s' || s_suppkey) AS first, count(*) AS n FROM supplier GROUP BY 1) USING (s_nationkey) WHERE n >= 2")
def same_role_groups(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    edges = s.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"), F.lit("REFERS_TO").alias("rel_type"))
    return graph.same_target_groups(edges, s.select(_id("s", "s_suppkey").alias("id"), F.lit("supplier").alias("qname")), ["REFERS_TO"]).drop("qname")


@query("SELECT 'MERGE (n:nation {id: ' || chr(39) || 'n' || n_nationkey || chr(39) || '}) ON CREATE SET n.`a name` = ' || chr(39) || n_name || chr(39) || ';' AS statement FROM nation")
def node_statements(spark: SparkSession, d: str) -> DataFrame:
    from docgraph.operators import export

    nodes = _t(spark, d, "nation").select(_id("n", "n_nationkey").alias("id"), F.lit("nation").alias("label"), F.create_map(F.lit("a name"), F.col("n_name")).alias("props"))
    return export.node_statements(nodes).select("statement")


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
    SELECT 'o' || a.o_orderkey AS child, 'o' || b.o_orderkey AS ancestor, CAST(a.k - b.k AS INTEGER) AS steps FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.k > b.k"""
)
def order_chain_closure(spark: SparkSession, d: str) -> DataFrame:
    """Each order derives from its customer's order before: all that it derives from, with the number of steps."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return graph.closure(_t(spark, d, "orders").select(_id("o", "o_orderkey").alias("child"), _id("o", F.lag("o_orderkey").over(w)).alias("parent")))


@query(
    """WITH b AS (SELECT *, o_orderkey % 3 AS batch FROM orders), n AS (SELECT o_custkey, o_orderkey, batch, row_number() OVER (PARTITION BY o_custkey ORDER BY batch, o_orderkey) AS k FROM b),
    e AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_edges FROM orders GROUP BY 1)
    SELECT 'c' || o_custkey AS id, 'o' || o_orderkey AS first_order, 'batch-' || batch AS upload_id, n_edges FROM n JOIN e USING (o_custkey) WHERE k = 1"""
)
def stored_first_writers(spark: SparkSession, d: str) -> DataFrame:
    """Orders merged into a stored graph in three batches, the second one twice: customers as their first order brought them, and edges once."""
    store = GraphStore(spark, scratch_path(spark, "store"), buckets=4)
    o = _t(spark, d, "orders").withColumn("batch", F.col("o_orderkey") % 3).withColumn("upload_id", F.concat(F.lit("batch-"), F.col("batch").cast("string")))
    for k in (0, 1, 1, 2):
        rows = o.filter(F.col("batch") == k)
        nodes = rows.select(F.lit("customer").alias("label"), _id("c", "o_custkey").alias("id"), "upload_id", F.col("o_orderkey").alias("ord"), _id("o", "o_orderkey").alias("first_order"))
        store.merge(nodes, rows.select(_id("c", "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("HAS").alias("rel_type"), "upload_id", F.col("o_orderkey").alias("ord")))
    counts = store.table("edges").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_edges"))
    return store.table("nodes").join(counts, "id").select("id", "first_order", "upload_id", "n_edges")


@query(
    """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'n' || c_nationkey, c_mktsegment FROM customer),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node, ['s' || s_suppkey] AS path FROM supplier
    UNION ALL SELECT source, b, list_append(path, b) FROM w JOIN u ON a = node WHERE len(path) < 5 AND NOT list_contains(path, b)),
    t AS (SELECT source, node AS target, path, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS k FROM w)
    SELECT source, target, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM t JOIN supplier ON source = 's' || s_suppkey AND target = 's' || (s_suppkey + 1) WHERE k = 1"""
)
def entity_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from each supplier to the next over nations, regions and market segments."""
    s = _t(spark, d, "supplier")
    e = s.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst"))
    e = e.union(_t(spark, d, "nation").select(_id("n", "n_nationkey"), _id("r", "n_regionkey"))).union(_t(spark, d, "customer").select(_id("n", "c_nationkey"), "c_mktsegment"))
    pairs = s.select(_id("s", "s_suppkey").alias("source"), _id("s", F.col("s_suppkey") + 1).alias("target"))
    return graph.shortest_paths(e, pairs, 4).withColumn("path", F.array_join("path", ">"))


@query(
    """WITH p AS (SELECT 'p' || p_partkey AS node_id, p_partkey, lower(trim(p_name)) AS name FROM part WHERE trim(p_name) <> ''),
    s AS (SELECT q.node_id AS query_id, p.node_id, round(1 - levenshtein(q.name, p.name) / greatest(length(q.name), length(p.name))::DOUBLE, 4) AS similarity FROM p q JOIN p ON q.p_partkey % 20 = 0)
    SELECT query_id, node_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS k FROM s WHERE similarity >= 0.7) WHERE k <= 10"""
)
def er_similar_names(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest names of every twentieth part, by an index of pairs of characters over all."""
    index = resolve.build_index(part_entities(spark, d), ["full_name"])
    wanted = _t(spark, d, "part").filter("p_partkey % 20 = 0").select(_id("p", "p_partkey").alias("query_id"), F.col("p_name").alias("full_name"))
    return resolve.search_index(index, wanted, 0.7, 10)


@query(
    """SELECT rule, count(*) AS n FROM (SELECT unnest(CASE event_id % 9 WHEN 0 THEN ['syntax'] WHEN 1 THEN ['syntax'] WHEN 2 THEN ['maximum'] WHEN 3 THEN ['type'] WHEN 4 THEN ['required'] WHEN 5 THEN ['syntax']
    WHEN 6 THEN ['enum', 'type'] WHEN 7 THEN ['uniqueItems'] ELSE [] END) AS rule FROM events) GROUP BY 1"""
)
def json_issue_rules(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON documents that are broken, not closed, out of bounds, of the wrong type or without a value, in turn."""
    from docgraph.operators import records
    from docgraph.session import ship_package

    ship_package(spark)
    e, turn = _t(spark, d, "events"), F.col("event_id") % 9
    k = F.get_json_object("props", "$.k")
    body = F.when(turn == 0, F.concat(F.lit('{"k": '), k)).when(turn == 1, F.repeat(F.lit("["), F.lit(50))).when(turn == 2, F.concat(F.lit('{"k": 1'), F.repeat(F.lit("0"), F.lit(400)), F.lit("}"))).when(turn == 3, F.concat(F.lit('{"k": "'), k, F.lit('"}')))
    body = body.when(turn == 4, F.lit("{}")).when(turn == 5, F.lit('{"k": NaN}')).when(turn == 6, F.concat(F.lit('{"k": 1, "of": true, "at": '), k, F.lit("}"))).when(turn == 7, F.concat(F.lit('{"k": 1, "all": ['), k, F.lit(", "), k, F.lit(".0]}"))).otherwise(F.lit('{"k": 1e2, "of": 1.0}'))
    docs = e.select(F.col("event_id").cast("string").alias("source_file"), body.alias("content"))
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 1000}, "of": {"enum": [1, "x"]}, "at": {"type": "string"}, "all": {"uniqueItems": True}}}
    return records.validate_json(docs, schema).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE p AS (SELECT 'p' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region
    UNION SELECT 'world', 'r0'), s AS (SELECT 'n' || n_nationkey AS a FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0),
    w AS (SELECT child, parent AS a, 1 AS steps FROM p UNION SELECT w.child, p.parent, steps + 1 FROM w JOIN p ON w.a = p.child WHERE steps < 6),
    x AS (SELECT child, a, steps, row_number() OVER (PARTITION BY child ORDER BY steps, a) AS k FROM w WHERE a IN (SELECT a FROM s) AND a <> child) SELECT child AS element, a AS ancestor, steps FROM x WHERE k = 1"""
)
def nearest_selected_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Customers, nations and regions as elements, in a graph with a cycle: the nearest selected nation or region above each."""
    from docgraph.plans.model_mapping import nearest_selected

    c, n, r = (_t(spark, d, t) for t in ("customer", "nation", "region"))
    pairs = c.select(_id("p", "c_custkey").alias("child"), _id("n", "c_nationkey").alias("parent")).union(n.select(_id("n", "n_nationkey"), _id("r", "n_regionkey"))).union(r.select(_id("r", "r_regionkey"), F.lit("world"))).union(r.filter("r_regionkey = 0").select(F.lit("world"), _id("r", "r_regionkey")))
    chosen = n.filter("n_nationkey % 3 = 0").select(_id("n", "n_nationkey").alias("element")).union(r.filter("r_regionkey % 2 = 0").select(_id("r", "r_regionkey")))
    return nearest_selected(pairs, chosen)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
