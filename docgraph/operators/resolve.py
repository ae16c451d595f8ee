"""Entity resolution: features by how property keys are named, grouping by name, clusters, lifted edges, scored matching."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import scalars
from docgraph.operators.graph import paths
from docgraph.scratch import written

#: Nodes that hold parts of an entity, and types that are never entities themselves.
PARTS = ["nc:PersonName", "nc:OrganizationName", "nc:PersonBirthDate"]
COMPONENTS = [
    "nc:PersonName", "nc:OrganizationName", "nc:PersonBirthDate", "nc:PersonDeathDate", "nc:PersonGivenName", "nc:PersonSurName", "nc:PersonMiddleName", "nc:PersonFullName", "nc:AddressFullText", "nc:Date",
    "nc:ActivityDate", "nc:TelephoneNumber", "nc:ContactInformation",
]


def _ends(*suffixes: str):  # noqa: ANN202
    return lambda k: F.lit(False) if not suffixes else k.rlike("(" + "|".join(suffixes) + ")$")


def _has(*parts: str):  # noqa: ANN202
    return lambda k: F.lower(k).rlike("|".join(parts))


def _either(*tests):  # noqa: ANN002, ANN202
    def test(k: Column) -> Column:
        out = tests[0](k)
        for t in tests[1:]:
            out = out | t(k)
        return out

    return test


def _without(test, *parts: str):  # noqa: ANN001, ANN202
    return lambda k: test(k) & ~F.lower(k).rlike("|".join(parts))


#: Feature -> test of a property key. The first key in order that passes gives the value, the entity's own keys first.
FEATURES = {
    "full_name": _either(_ends("PersonFullName", "OrganizationName"), _has("fullname", "organizationname")),
    "given_name": _either(_ends("PersonGivenName"), _has("givenname", "firstname")),
    "surname": _either(_ends("PersonSurName"), _has("surname", "lastname")),
    "middle_name": _either(_ends("PersonMiddleName"), _has("middlename")),
    "ssn": _either(_ends("PersonSSNIdentification"), _has("ssn$", "socialsecurity")),
    "driver_license": _either(_ends("DriverLicenseIdentification", "DriverLicenseCardIdentification"), _has("driverslicense", "dln")),
    "person_id": _without(_either(_ends("IdentificationID"), _has("identification")), "driver"),
    "birth_date": _either(_ends("PersonBirthDate"), _has("birthdate$", "dob")),
    "address": _without(_either(_ends("AddressFullText"), _has("address")), "email"),
    "city": _has("city"), "state": _has("state"), "zip": _either(_ends("PostalCode"), _has("zip$", "postal")),
    "phone": _has("phone"), "email": _either(_ends("ElectronicAddressText"), _has("email")),
}


def related_props(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(id, related): merged properties of an entity's part nodes, up to ``most`` containment steps below; the first in order wins."""
    below = paths(edges, 1, most, ["CONTAINS"]).select(F.col("src").alias("id"), F.col("dst").alias("part"))
    parts = nodes.filter(F.col("qname").isin(PARTS)).select(F.col("id").alias("part"), F.explode("props").alias("key", "value"))
    one = below.join(parts, "part").groupBy("id", "key").agg(F.min_by("value", "part").alias("value"))
    return one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("related"))


def extract_features(nodes: DataFrame, edges: DataFrame, qnames: list[str], most: int = 3) -> DataFrame:
    """Entities of the given types with their features; those without a name, a full pair of names, or another strong feature go."""
    chosen = nodes.filter(F.col("qname").isin(qnames)).join(related_props(nodes, edges, most), "id", "left")
    empty = F.create_map().cast("map<string,string>")
    own, related = F.coalesce("props", empty), F.coalesce("related", empty)
    out = chosen
    for name, test in FEATURES.items():
        mine = F.try_element_at(F.filter(F.array_sort(F.map_keys(own)), test), F.lit(1))
        theirs = F.try_element_at(F.filter(F.array_sort(F.map_keys(related)), test), F.lit(1))
        out = out.withColumn(name, F.coalesce(F.try_element_at(own, mine), F.try_element_at(related, theirs)))
    strong = F.col("full_name").isNotNull() | (F.col("given_name").isNotNull() & F.col("surname").isNotNull()) | F.coalesce("ssn", "driver_license", "birth_date", "address").isNotNull()
    return out.filter(strong).select(F.col("id").alias("node_id"), "qname", "source_file", "upload_id", *FEATURES)


def match_keys(entities: DataFrame) -> DataFrame:
    key = scalars.entity_key(F.col("full_name"), F.col("given_name"), F.col("surname"))
    rule = F.when(F.trim(F.coalesce("full_name", F.lit(""))) != "", "full_name").otherwise("given_name+surname")
    return entities.withColumn("match_key", key).withColumn("matched_on", rule).filter("match_key <> ''")


def text_clusters(entities: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): groups of ``least`` or more entities with one key. Groups are aggregated, never paired."""
    keyed = match_keys(entities)
    name = scalars.display_name(F.col("full_name"), F.col("given_name"), F.col("middle_name"), F.col("surname"))
    present = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    clusters = (
        keyed.withColumn("name", name).groupBy("match_key")
        .agg(F.count("*").alias("resolved_count"), F.min_by("name", "node_id").alias("name"), F.min("birth_date").alias("birth_date"), present("upload_id").alias("upload_ids"), present("source_file").alias("source_docs"))
        .filter(F.col("resolved_count") >= least)
        .select(scalars.cluster_id(F.col("match_key")).alias("entity_id"), "name", "birth_date", "match_key", "resolved_count", F.lit("text").alias("resolution_method"), F.lit(0.95).alias("confidence"), "upload_ids", "source_docs")
    )
    members = keyed.join(clusters.select("match_key", "entity_id"), "match_key").select("node_id", "entity_id", F.lit(0.95).alias("confidence"), "matched_on")
    return clusters, members


def lifted_members(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, rel_type, edge): each edge between members, without RESOLVED_TO, with the clusters at its ends."""
    a = members.select(F.col("node_id").alias("src"), F.col("entity_id").alias("a"))
    b = members.select(F.col("node_id").alias("dst"), F.col("entity_id").alias("b"))
    ident = F.sha1(F.concat_ws("|", "src", "rel_type", "dst"))
    return edges.filter("rel_type <> 'RESOLVED_TO'").withColumn("edge", ident).join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type", "edge").distinct()


def lift_edges(edges: DataFrame, members: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(src, dst, rel_type, n): edges between members as edges between their clusters, and how many each stands for; which
    ones they are is ``lifted_members``. Edges and members are made distinct before they meet, so nothing wide is held after."""
    e, m = edges.filter("rel_type <> 'RESOLVED_TO'").select("src", "dst", "rel_type").distinct(), members.select("node_id", "entity_id").distinct()
    a, b = m.select(F.col("node_id").alias("src"), F.col("entity_id").alias("a")), m.select(F.col("node_id").alias("dst"), F.col("entity_id").alias("b"))
    out = e.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type").agg(F.count("*").alias("n"))
    return out if existing is None else out.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def discover_types(nodes: DataFrame, edges: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """(qname, category, entities, attributes, keys, recommended): types whose own or part keys hold features."""
    related = related_props(nodes, edges, 2)
    keyed = nodes.filter(F.col("qname").isNotNull() & ~F.col("qname").isin(skip or COMPONENTS)).join(related, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    held = keyed.select("qname", F.explode(F.array_union(F.map_keys(F.coalesce("props", empty)), F.map_keys(F.coalesce("related", empty)))).alias("key")).distinct()
    sets = held.groupBy("qname").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # as many as the type has properties
    one = keyed.groupBy("qname").agg(F.countDistinct("id").alias("entities")).join(sets, "qname")
    counted = ["full_name", "given_name", "ssn", "driver_license", "person_id", "birth_date", "address", "phone", "email"]
    n = sum((F.exists("keys", FEATURES[f]).cast("int") for f in counted), F.lit(0))
    kind = scalars.category(F.col("qname"))
    return one.withColumn("attributes", n).filter("attributes > 0").select("qname", kind.alias("category"), "entities", "attributes", "keys", (kind.isin("person", "organization") & (F.col("attributes") >= 2)).alias("recommended"))


@dataclass
class Scoring:
    """Weights of agreeing features (log odds, after Fellegi and Sunter) and of disagreeing ones; a link needs ``least``."""

    agree: dict[str, float] = field(default_factory=lambda: {"ssn": 9.0, "driver_license": 8.0, "birth_date": 4.0, "name": 5.0, "address": 3.0, "phone": 4.0, "email": 6.0})
    differ: dict[str, float] = field(default_factory=lambda: {"ssn": -6.0, "birth_date": -4.0, "name": -3.0})
    least: float = 8.0
    near_name: int = 2


def blocks(scoring: Scoring) -> list[tuple[str, ...]]:
    """The smallest sets of features whose agreement can reach the least score: each link agrees on all of at least one."""
    above = {c: max(0.0, scoring.differ.get(c, 0.0)) for c in scoring.agree}
    best = lambda chosen: sum(max(w, above[c]) if c in chosen else above[c] for c, w in scoring.agree.items())
    if best(()) >= scoring.least:
        raise ValueError("pairs that agree on nothing reach the least score")
    out: list[tuple[str, ...]] = []
    for n in range(1, len(scoring.agree) + 1):
        for chosen in combinations(scoring.agree, n):
            if best(chosen) >= scoring.least and not any(set(b) <= set(chosen) for b in out):
                out.append(chosen)
    return out


def name_pieces(name: Column, most: int) -> tuple[Column, Column]:
    """(own, sought): arrays of keys such that, of any two names within ``most`` edits, some own key of the shorter is sought
    by the other. Of ``most`` + 1 pieces of the shorter one is untouched, and moved by ``most`` places at most (Li et al., 2011)."""
    n, parts = F.length(name), most + 1
    begin = lambda length, k: F.floor(length * k / parts).cast("int")
    key = lambda length, k, at: F.xxhash64(length, F.lit(k), F.substring(name, at + 1, begin(length, k + 1) - begin(length, k)))
    own = [key(n, k, begin(n, k)) for k in range(parts)]
    sought = []
    for shorter in range(most + 1):
        length = n - shorter
        for k in range(parts):
            for move in range(-most, most + 1):
                at = begin(length, k) + move
                fits = (length >= 0) & (at >= 0) & (at + begin(length, k + 1) - begin(length, k) <= n)
                sought.append(F.when(fits, key(length, k, at)))
    return F.array(*own), F.array_distinct(F.array_compact(F.array(*sought)))


def feature_sets(entities: DataFrame) -> DataFrame:
    """node_id and the compared features, trimmed, empty ones as null."""
    name = scalars.entity_key(F.col("full_name"), F.col("given_name"), F.col("surname"))
    return entities.select("node_id", F.nullif(name, F.lit("")).alias("name"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("ssn", "driver_license", "birth_date", "address", "phone", "email")])


def scored_links(entities: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """(a, b, score, match_key) of all pairs of different feature sets that reach the least score.

    Entities that are equal in all features are folded into one first, so a name that a third of all rows carry is one row
    in a block. Pairs come from blocks of equal features (``blocks``); a name within ``near_name`` edits is found by its pieces.
    """
    s = scoring or Scoring()
    base = feature_sets(entities)
    sets = written(base.groupBy(*[c for c in base.columns if c != "node_id"]).agg(F.min("node_id").alias("node_id")), "er-sets")
    own, sought = name_pieces(F.col("name"), s.near_name)
    left, right = [], []
    for k, chosen in enumerate(blocks(s)):
        equal = [c for c in chosen if c != "name"]
        mine = sets.filter(F.forall(F.array(*chosen), lambda x: x.isNotNull()))
        left.append(mine.withColumn("piece", F.explode(own if "name" in chosen else F.array(F.lit(0)))).select(F.xxhash64(F.lit(k), *equal, "piece").alias("key"), F.col("node_id").alias("i")))
        right.append(mine.withColumn("piece", F.explode(sought if "name" in chosen else F.array(F.lit(0)))).select(F.xxhash64(F.lit(k), *equal, "piece").alias("key"), F.col("node_id").alias("j")))
    together = reduce(DataFrame.unionByName, left).join(reduce(DataFrame.unionByName, right), "key").filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return _scored(together, sets, s)


def _scored(together: DataFrame, sets: DataFrame, s: Scoring) -> DataFrame:
    """(a, b, score, match_key) of the pairs (i, j) of ``sets`` that reach the least score."""
    whole = F.struct(*sets.columns)
    pairs = together.join(sets.select(F.col("node_id").alias("i"), whole.alias("x")), "i").join(sets.select(F.col("node_id").alias("j"), whole.alias("y")), "j")
    score, marks = F.lit(0.0), []
    for c, w in s.agree.items():
        a, b = F.col(f"x.{c}"), F.col(f"y.{c}")
        same = (a == b) if c != "name" else (F.levenshtein(a, b) <= s.near_name)
        score = score + F.when(same, w).when(a.isNotNull() & b.isNotNull(), s.differ.get(c, 0.0)).otherwise(0.0)
        marks.append(F.when(same, F.lit("+" + c.upper())))
    return pairs.select(F.col("x.node_id").alias("a"), F.col("y.node_id").alias("b"), score.alias("score"), F.concat_ws("", *marks).alias("match_key")).filter(F.col("score") >= s.least)


def components(links: DataFrame) -> DataFrame:
    """(id, component) by rounds of smallest neighbours, each written to the shared folder; ends when nothing changes."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "er-links")
    now = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "er-components")
    while True:
        seen = both.join(now, both["v"] == now["id"]).groupBy("u").agg(F.min("component").alias("m"))
        jump = now.select(F.col("id").alias("component"), F.col("component").alias("further"))
        joined = now.join(seen, now["id"] == seen["u"]).join(jump, "component", "left")
        new = written(joined.select("id", F.least("component", "m", "further").alias("component"), (F.least("component", "m", "further") != F.col("component")).alias("changed")), "er-components")
        now = new.select("id", "component")
        if new.filter("changed").isEmpty():
            return now


def _reaches(s: Scoring, agreeing: tuple[str, ...], differing: set[str]) -> bool:
    return sum(s.agree[c] for c in agreeing) + sum(s.differ[c] for c in differing) >= s.least


def sufficient_sets(s: Scoring) -> list[tuple[str, ...]]:
    """Sets of features whose agreement links two rows whatever else they hold, if of the features that count against a link
    when they differ, outside the set, both hold certain ones at most; each is the smallest for some such case."""
    against = [c for c, w in s.differ.items() if w < 0]
    out = []
    for n in range(1, len(s.agree) + 1):
        for chosen in combinations(s.agree, n):
            rest = [c for c in against if c not in chosen]
            cases = [set(x) for m in range(len(rest) + 1) for x in combinations(rest, m) if _reaches(s, chosen, set(x))]
            less = lambda x, c: _reaches(s, tuple(f for f in chosen if f != c), x | ({c} & set(against)))  # noqa: B023, E731
            if any(not any(less(x, c) for c in chosen) for x in cases):
                out.append(chosen)
    return out


def scored_evidence(entities: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """(a, b, score, match_key): links that join the same entities as all pairs of ``scored_links`` do, in numbers linear in the rows.

    Rows that agree on a sufficient set of features and hold the same of the counter-features form a group. Two groups of one
    set either link with all their rows or not at all, so each row is linked to the first row of each group that it links
    with: a default identifier on a million rows gives a million links, not their pairs. Names agree within ``near_name``
    edits: different names of a block meet by their pieces, each name once. Rows that are equal in all features are one.
    """
    s = scoring or Scoring()
    against = [c for c, w in s.differ.items() if w < 0]
    base = feature_sets(entities)
    held = F.lit(0)
    for k, c in enumerate(against):
        held = held + F.when(F.col(c).isNotNull(), 1 << k).otherwise(0)
    sets = written(base.groupBy(*[c for c in base.columns if c != "node_id"]).agg(F.min("node_id").alias("node_id")).withColumn("holds", held), "er-sets")
    chosen = sufficient_sets(s)
    entry = lambda k, c: F.when(
        F.forall(F.array(*c), lambda x: x.isNotNull()),
        F.struct(F.lit(k).alias("k"), F.to_json(F.struct(*[x for x in c if x != "name"])).alias("key"), (F.col("name") if "name" in c else F.lit("")).alias("name")),
    )
    rows = sets.select("node_id", "holds", F.explode(F.array_compact(F.array(*[entry(k, c) for k, c in enumerate(chosen)]))).alias("e")).select("node_id", "holds", "e.*")
    groups = written(rows.groupBy("k", "key", "name", "holds").agg(F.min("node_id").alias("first")), "er-groups")
    names = groups.select("k", "key", "name").distinct()
    own, sought = name_pieces(F.col("name"), s.near_name)
    spelled = names.filter(F.col("k").isin([k for k, c in enumerate(chosen) if "name" in c]))
    left = spelled.select("k", "key", F.col("name").alias("x"), F.explode(own).alias("piece"))
    right = spelled.select("k", "key", F.col("name").alias("y"), F.explode(sought).alias("piece"))
    near = left.join(right, ["k", "key", "piece"]).filter((F.col("x") != F.col("y")) & (F.levenshtein("x", "y", s.near_name) >= 0)).select("k", "key", "x", "y")
    both = near.unionByName(near.select("k", "key", F.col("y").alias("x"), F.col("x").alias("y"))).distinct().unionByName(names.select("k", "key", F.col("name").alias("x"), F.col("name").alias("y")))
    pattern = lambda p, q, c: {f for i, f in enumerate(against) if p & q & (1 << i) and f not in c}
    allowed = [(k, p, q) for k, c in enumerate(chosen) for p in range(1 << len(against)) for q in range(1 << len(against)) if _reaches(s, c, pattern(p, q, c))]
    fits = sets.sparkSession.createDataFrame(allowed, "k int, holds int, other int")  # sets x patterns of features: no more with more rows
    to = groups.select("k", "key", F.col("name").alias("y"), F.col("holds").alias("other"), "first")
    pairs = rows.withColumnRenamed("name", "x").join(both, ["k", "key", "x"]).join(to, ["k", "key", "y"]).join(fits, ["k", "holds", "other"], "left_semi")
    links = pairs.filter("node_id <> first").select(F.least("node_id", "first").alias("i"), F.greatest("node_id", "first").alias("j")).distinct()
    return _scored(links, sets.drop("holds"), s)


def scored_clusters(entities: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """(entity_id, node_id) of clusters of linked entities, equal feature sets included. Exact: as if all pairs were scored."""
    base = feature_sets(entities)
    ids = base.select("node_id", F.sha1(F.to_json(F.struct(*[c for c in base.columns if c != "node_id"]))).alias("set")).filter("set <> sha1('{}')")
    first = ids.groupBy("set").agg(F.min("node_id").alias("first"))
    equal = ids.join(first, "set").filter("node_id <> first").select(F.col("node_id").alias("a"), F.col("first").alias("b"))
    parts = components(scored_evidence(entities, scoring).select("a", "b").unionByName(equal))
    return parts.select(scalars.cluster_id(F.col("component"), "SE_").alias("entity_id"), F.col("id").alias("node_id"))


def quality(score: Column, high: float = 14.0, medium: float = 10.0) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def match_details(links: DataFrame) -> DataFrame:
    """(kind, name, n): quality of links, and the ten commonest match keys."""
    bands = links.select(quality(F.col("score")).alias("name")).groupBy("name").count().select(F.lit("quality").alias("kind"), "name", F.col("count").alias("n"))
    top = links.groupBy(F.col("match_key").alias("name")).count().orderBy(F.desc("count"), "name").limit(10).select(F.lit("match_key").alias("kind"), "name", F.col("count").alias("n"))
    return bands.unionByName(top)


@dataclass
class Resolution:
    """What a run of entity resolution made: counters, and the tables where it came so far."""

    status: str
    message: str
    counts: dict[str, int]
    clusters: DataFrame | None = None
    members: DataFrame | None = None
    lifted: DataFrame | None = None


def run_resolution(nodes: DataFrame, edges: DataFrame, qnames: list[str], scoring: Scoring | None = None) -> Resolution:
    """Extract, group, cluster, lift, in this order; ends early without types, without entities or without groups.

    Names decide (``text_clusters``), or, where ``scoring`` is given, weighted features (``scored_clusters``).
    """
    counts = dict.fromkeys(("entities_extracted", "duplicate_groups", "clusters_created", "relationships_created", "entities_resolved"), 0)
    if not qnames:
        return Resolution("error", "no node types are selected", counts)
    entities = written(extract_features(nodes, edges, qnames), "entities")
    counts["entities_extracted"] = entities.count()
    if not counts["entities_extracted"]:
        return Resolution("success", "no entities of the selected types", counts)
    if scoring is None:
        clusters, members = text_clusters(entities)
    else:
        members = scored_clusters(entities, scoring)
        clusters = members.groupBy("entity_id").agg(F.count("*").alias("resolved_count"))
    clusters, members = written(clusters, "clusters"), written(members, "members")
    counts["duplicate_groups"] = counts["clusters_created"] = clusters.count()
    if not counts["clusters_created"]:
        return Resolution("success", "all entities are unique", counts)
    lifted = written(lift_edges(edges, members), "lifted")
    counts["entities_resolved"] = members.count()
    counts["relationships_created"] = counts["entities_resolved"] + lifted.count()
    return Resolution("success", f"{counts['entities_resolved']} entities in {counts['clusters_created']} clusters", counts, clusters, members, lifted)


def status(nodes: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One row: entity nodes, clusters, resolved entities."""
    one = F.lit(1).alias("one")
    n = nodes.agg(F.count("*").alias("nodes")).select("*", one)
    c = clusters.agg(F.count("*").alias("clusters")).select("*", one)
    return n.join(c, "one").join(members.agg(F.countDistinct("node_id").alias("resolved")).select("*", one), "one").drop("one")


def matcher_records(nodes: DataFrame, mapping: dict[str, str], lists: list[str], data_source: str = "GRAPH") -> DataFrame:
    """(node_id, record): a flat JSON record for a matcher. ``mapping``: property key to record field; a later one wins.

    A key is looked up as it is, without its prefix, and without underscores. Fields in ``lists`` join all values with ;,
    others take the first; dates are brought to one format.
    """
    empty = F.create_map().cast("map<string,string>")
    own, many = F.coalesce("props", empty), F.coalesce("list_props", F.create_map().cast("map<string,array<string>>"))
    fields: dict[str, Column] = {}
    for key, name in mapping.items():
        forms = [key, key.split("_", 1)[-1], key.replace("_", "")]
        values = F.coalesce(*[F.try_element_at(many, F.lit(k)) for k in forms], *[F.when(F.try_element_at(own, F.lit(k)).isNotNull(), scalars.values_of(F.try_element_at(own, F.lit(k)))) for k in forms])
        value = F.array_join(values, ";") if name in lists else F.try_element_at(values, F.lit(1))
        value = scalars.normal_date(value) if "DATE" in name else value
        fields[name] = F.coalesce(value, fields[name]) if name in fields else value
    kind = scalars.record_type(scalars.category(F.col("qname")))
    head = [F.lit(data_source).alias("DATA_SOURCE"), F.col("id").alias("RECORD_ID"), kind.alias("RECORD_TYPE"), F.col("source_file").alias("SOURCE_FILE"), F.col("qname").alias("QNAME")]
    return nodes.select(F.col("id").alias("node_id"), F.to_json(F.struct(*head, *[v.alias(n) for n, v in fields.items()])).alias("record"))


def search(entities: DataFrame, wanted: dict[str, str], most: int = 10) -> DataFrame:
    """The ``most`` entities nearest to the wanted features: equal ones count 1, others by edit distance."""
    total = sum((F.coalesce(F.when(F.lower(c) == v.lower(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(F.lower(c), F.lit(v.lower())) / F.greatest(F.length(c), F.lit(len(v))))), F.lit(0.0)) for c, v in wanted.items()), F.lit(0.0))
    return entities.withColumn("similarity", F.round(total / max(1, len(wanted)), 4)).orderBy(F.desc("similarity"), "node_id").limit(most)


def _grams(value: Column) -> Column:
    """Pairs of neighbouring characters, the ends marked, each with how many like it came before: a multiset as a set."""
    marked = F.concat(F.lit("\x02"), value, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


@dataclass
class SimilarityIndex:
    """An inverted index of pairs of characters: ``postings`` (feature, gram, set, length), sorted by gram in files by gram.

    Entities that are equal in all features are one ``set``, so a common value has one posting a gram: ``sets`` (set, first,
    features) and ``members`` (set, node_id).
    """

    postings: DataFrame
    sets: DataFrame
    members: DataFrame
    features: list[str]


def build_index(entities: DataFrame, features: list[str]) -> SimilarityIndex:
    """Index the trimmed, lower-case values of ``features`` of entities (node_id, ...). Nulls and empty values have no posting."""
    kept = entities.select("node_id", *[F.nullif(F.lower(F.trim(c)), F.lit("")).alias(c) for c in features])
    kept = written(kept.filter(F.coalesce(*features).isNotNull()).select(F.sha1(F.to_json(F.struct(*features))).alias("set"), "*"), "indexed-entities")
    sets = written(kept.groupBy("set", *features).agg(F.min("node_id").alias("first")), "indexed-sets")
    each = sets.select("set", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))) for c in features]))).alias("v")).select("set", "v.*")
    postings = each.select("feature", "set", F.length("value").alias("length"), F.explode(_grams(F.col("value"))).alias("gram"))
    return SimilarityIndex(written(postings.repartition("gram", F.pmod(F.xxhash64("set"), F.lit(8))).sortWithinPartitions("gram", "feature", "length"), "postings"), sets, kept.select("set", "node_id"), features)


def search_index(index: SimilarityIndex, wanted: DataFrame, least: float = 0.6, most: int = 10) -> DataFrame:
    """(query_id, node_id, similarity): for each row of ``wanted`` (query_id and features), the ``most`` entities of highest similarity, ``least`` or more.

    Similarity is the mean over the features that the query has of 1 - edits / longer length; a feature that an entity lacks
    counts 0. So an entity reaches ``least`` only if one feature does: then its edits are at most (1 - least) of the longer
    length L, and it shares at least L + 1 - 2 edits of the query's pairs, which is positive from a half on. Candidates are
    counted in the postings; edit distances are computed for them alone. Ties go to the smaller node_id. Equal queries are
    searched once, among different sets; of a set the ``most`` smallest node_ids can be among the best, of the sets the
    ``most`` that are best by similarity and smallest node_id.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("from a half to one: below, similar values may share no pair")
    asking = wanted.select("query_id", *[F.nullif(F.lower(F.trim(c)), F.lit("")).alias(f"q_{c}") for c in index.features])
    asking = asking.withColumn("asked", F.sha1(F.to_json(F.struct(*asking.columns[1:]))))
    q = written(asking.drop("query_id").distinct(), "asked")
    one = lambda c: F.when(F.col(f"q_{c}").isNotNull(), F.struct(F.lit(c).alias("feature"), F.col(f"q_{c}").alias("value")))
    values = q.select("asked", F.explode(F.array_compact(F.array(*[one(c) for c in index.features]))).alias("v")).select("asked", "v.*")
    grams = values.select("asked", "feature", F.length("value").alias("q_length"), F.explode(_grams(F.col("value"))).alias("gram"))
    longer = F.greatest("length", "q_length")
    edits = F.floor((1 - least) * longer + 1e-9)
    met = index.postings.join(grams, ["feature", "gram"]).filter(F.abs(F.col("length") - F.col("q_length")) <= edits)
    shared = met.groupBy("asked", "set", "feature", "length", "q_length").agg(F.count("*").alias("n")).filter(F.col("n") >= longer + 1 - 2 * edits)
    found = shared.select("asked", "set").distinct().join(q, "asked").join(index.sets, "set")
    total, present = F.lit(0.0), F.lit(0)
    for c in index.features:
        a, b = F.col(c), F.col(f"q_{c}")
        total = total + F.coalesce(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), F.lit(0.0))
        present = present + F.when(b.isNotNull(), 1).otherwise(0)
    scored = found.select("asked", "set", "first", F.round(total / present, 4).alias("similarity")).filter(F.col("similarity") >= least)
    best = lambda df, by, *order: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most).drop("place")
    near = best(scored, "asked", F.desc("similarity"), "first").select("asked", "set", "similarity")
    nearest = best(near.join(best(index.members, "set", "node_id"), "set"), "asked", F.desc("similarity"), "node_id")
    return asking.select("query_id", "asked").join(nearest, "asked").select("query_id", "node_id", "similarity")
