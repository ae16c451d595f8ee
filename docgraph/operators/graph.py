"""Graph queries over nodes (id, labels, ...) and edges (src, dst, rel_type, ...): patterns are joins, paths are joins of joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.scratch import written


@dataclass
class GraphResult:
    nodes: DataFrame
    edges: DataFrame

    def metadata(self) -> DataFrame:
        """One row: labels, types and counts."""
        n = self.nodes.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("node_labels"), F.count("*").alias("node_count"))
        e = self.edges.agg(F.array_sort(F.collect_set("rel_type")).alias("relationship_types"), F.count("*").alias("relationship_count"))
        one = F.lit(1).alias("one")
        return n.select("*", one).join(e.select("*", one), "one").drop("one")


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.array_contains("labels", label))


def prop(name: str) -> Column:
    return F.try_element_at(F.col("props"), F.lit(name))


def any_key(test) -> Column:  # noqa: ANN001
    """Whether some property key passes ``test``, a function of a key."""
    return F.exists(F.map_keys("props"), test)


def first_key(test) -> Column:  # noqa: ANN001
    """The first key in order that passes; null if none does."""
    return F.try_element_at(F.filter(F.array_sort(F.map_keys("props")), test), F.lit(1))


def hop(start: DataFrame, edges: DataFrame, types: list[str] | None = None, direction: str = "out", optional: bool = False, where: Column | None = None) -> DataFrame:
    """Rows of ``start`` (with ``id``) joined to edges: adds rel_type, other. ``where`` on edges is part of an optional match."""
    e = edges.filter(F.col("rel_type").isin(types)) if types else edges
    e = e.filter(where) if where is not None else e
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type")
    back = e.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel_type")
    both = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    return start.join(both, "id", "left" if optional else "inner")


def paths(edges: DataFrame, least: int, most: int, types: list[str] | None = None, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops, trail) of directed paths with ``least`` to ``most`` edges and no edge twice: a union of joins."""
    e = edges.filter(F.col("rel_type").isin(types)) if types else edges
    step = e.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("edge_id") if "edge_id" in edges.columns else F.xxhash64("src", "dst", "rel_type").alias("edge_id"))
    first = step if start is None else step.join(start.select(F.col("id").alias("s")).distinct(), "s", "left_semi")
    now = first.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(1).alias("hops"), F.array("edge_id").alias("trail"))
    found = [now] if least <= 1 else []
    for k in range(2, most + 1):
        grown = now.join(step, now["dst"] == step["s"]).filter(~F.array_contains("trail", F.col("edge_id")))
        now = grown.select("src", F.col("d").alias("dst"), F.lit(k).alias("hops"), F.array_append("trail", F.col("edge_id")).alias("trail"))
        if k >= least:
            found.append(now)
    return reduce(DataFrame.unionByName, found)


def descendants(edges: DataFrame, types: list[str], roots: DataFrame) -> DataFrame:
    """(root, id, depth) of all nodes below ``roots`` (id), each with its fewest steps: one written table a round, without
    what was met before, so that cycles end and no number of rows is too large."""
    tree = written(edges.filter(F.col("rel_type").isin(types)).select("src", "dst").distinct(), "tree")
    last = written(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct(), "below")
    seen, depth = last, 0
    while not last.isEmpty():
        depth += 1
        step = last.select("root", F.col("id").alias("src")).join(tree, "src").select("root", F.col("dst").alias("id"), F.lit(depth).alias("depth")).distinct()
        last = written(step.join(seen.select("root", "id"), ["root", "id"], "left_anti"), "below")
        seen = seen.unionByName(last)
    return seen


def closure(pairs: DataFrame) -> DataFrame:
    """(child, ancestor, steps): all that is reached over (child, parent), with the fewest steps; a node on a cycle reaches itself.

    Each round doubles the reach d: what is d + 1 to 2 d steps away is a path of just d steps and one of d or fewer behind
    it, so a round makes no row twice on a chain, and a depth of n takes log2(n) rounds. What a round adds is written, and
    pairs that an earlier one has met are left out, which ends cycles. Where each child has one parent, a round can meet a
    pair again only around a cycle, which shows as a node that reaches itself: until one does, nothing is compared with
    what was met before. Nulls on either side make no pair. There is no cap.
    """
    itself = F.count_if(F.col("child") == F.col("ancestor"))
    first = pairs.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor")).distinct()
    seen = last = written(first.withColumn("steps", F.lit(1)), "closure")
    single = not seen.groupBy("child").agg(F.count("*").alias("n"), itself.alias("loops")).agg(F.count_if(F.expr("n > 1 OR loops > 0"))).first()[0]
    reach = 1
    while not last.isEmpty():
        far = seen.filter(F.col("steps") == reach).select("child", F.col("ancestor").alias("via"))
        on = seen.select(F.col("child").alias("via"), "ancestor", "steps")
        met = far.join(on, "via").select("child", "ancestor", (F.col("steps") + reach).alias("steps"))
        if single:
            last = written(met, "closure")
            single = not last.agg(itself).first()[0]
        if not single:
            met = met.groupBy("child", "ancestor").agg(F.min("steps").alias("steps"))
            last = written(met.join(seen.select("child", "ancestor"), ["child", "ancestor"], "left_anti"), "closure")
        seen, reach = seen.unionByName(last), 2 * reach
    return seen


def shortest(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, hops): fewest undirected steps, up to ``most``. Each node is kept once a source, so rounds stay small."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("hops"))
    last = seen
    for k in range(1, most + 1):
        step = last.join(both, last["at"] == both["src"]).select("source", F.col("dst").alias("at"), F.lit(k).alias("hops")).distinct()
        last = step.join(seen.select("source", "at"), ["source", "at"], "left_anti")
        seen = seen.unionByName(last)
    return seen.join(targets.select(F.col("id").alias("at")).distinct(), "at", "left_semi").select("source", F.col("at").alias("target"), "hops")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 3, types: list[str] | None = None) -> DataFrame:
    """(source, target, hops, path): for each row of ``pairs`` (source, target), a shortest undirected path of at most ``most`` edges, as node ids.

    Two searches meet: from the sources half of the way, from the targets the other. Each keeps a node once a start, with
    the first in order of its shortest ways, so the path is the first in order among the shortest. Each round is written.
    Nodes with one neighbour alone are inside no path, so no search steps on them: a hub's leaves cost a row each, not their
    pairs. Pairs that are neighbours are found by their edge.
    A pair of one node has the path of that node; pairs that are further apart, and those with a null, have no row.
    """
    e = edges.filter(F.col("rel_type").isin(types)) if types else edges
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    links, asked = written(both, "links"), written(pairs.select("source", "target").dropna().distinct(), "asked")
    several = links.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n")).filter("n >= 2")
    inner = written(links.join(several, "dst", "left_semi"), "links")

    def ways(start: str, rounds: int, grow) -> DataFrame:  # noqa: ANN001
        """(start, at, hops, way) of all within ``rounds`` edges."""
        now = written(asked.select(F.col(start).alias("start"), F.col(start).alias("at")).distinct().select("*", F.lit(0).alias("hops"), F.array("at").alias("way")), "ways")
        seen = now
        for k in range(1, rounds + 1):
            step = now.join(inner, now["at"] == inner["src"]).groupBy("start", F.col("dst").alias("at")).agg(F.min(grow(F.col("way"), F.col("dst"))).alias("way"))
            now = written(step.join(seen.select("start", "at"), ["start", "at"], "left_anti").select("start", "at", F.lit(k).alias("hops"), "way"), "ways")
            seen = seen.unionByName(now)
        return seen

    ahead = ways("source", (most + 1) // 2, lambda way, at: F.concat(way, F.array(at))).select(F.col("start").alias("source"), "at", F.col("hops").alias("a"), F.col("way").alias("head"))
    back = ways("target", most // 2, lambda way, at: F.concat(F.array(at), way)).select(F.col("start").alias("target"), "at", F.col("hops").alias("b"), F.col("way").alias("tail"))
    whole = F.struct((F.col("a") + F.col("b")).alias("hops"), F.concat("head", F.slice("tail", F.lit(2), F.size("tail"))).alias("path"))
    met = asked.join(ahead, "source").join(back, ["target", "at"]).select("source", "target", whole.alias("x"))
    if most >= 1:
        edge = asked.join(links.select(F.col("src").alias("source"), F.col("dst").alias("target")), ["source", "target"])
        met = met.unionByName(edge.select("source", "target", F.struct(F.lit(1).alias("hops"), F.array("source", "target").alias("path")).alias("x")))
    return met.groupBy("source", "target").agg(F.min("x").alias("x")).select("source", "target", "x.hops", "x.path")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def display_size(degree: Column, low: int = 20, high: int = 40) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(low) + degree))


def orphans(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes without any edge (of ``types``)."""
    e = edges.filter(F.col("rel_type").isin(types)) if types else edges
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def induced(nodes: DataFrame, edges: DataFrame, chosen: Column) -> GraphResult:
    """Chosen nodes and their neighbours, with the edges among these."""
    primary = nodes.filter(chosen).select("id")
    out = edges.join(primary.withColumnRenamed("id", "src"), "src", "left_semi").select(F.explode(F.array("src", "dst")).alias("id"))
    back = edges.join(primary.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.explode(F.array("src", "dst")).alias("id"))
    ids = primary.unionByName(out).unionByName(back).distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return GraphResult(nodes.join(ids, "id", "left_semi"), kept)


def full_graph(nodes: DataFrame, edges: DataFrame, limit: int = 500, include_resolved: bool = True) -> GraphResult:
    """The first ``limit`` edges in order of (src, type, dst) and their nodes. Resolved entities can be left out."""
    n, e = nodes, edges
    if not include_resolved:
        n = n.filter(~F.array_contains("labels", "ResolvedEntity"))
        e = e.filter(F.col("rel_type") != "RESOLVED_TO")
    e = e.orderBy("src", "rel_type", "dst").limit(limit)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return GraphResult(n.join(ids, "id", "left_semi"), e)


def same_target_pairs(edges: DataFrame, names: DataFrame, types: list[str], block: int = 512, task_pairs: int = 4_000_000) -> DataFrame:
    """(target, a, b): sources of one name that point to one target, a before b. As many rows as pairs: for targets of
    unbounded degree take ``same_target_groups``.

    A group is cut by hash into blocks of about ``block`` rows, and each two blocks meet by themselves, so that a hub's pairs are
    spread over tasks of about ``task_pairs`` pairs.
    """
    e = edges.filter(F.col("rel_type").isin(types)).select("src", "dst").join(names.select(F.col("id").alias("src"), "qname"), "src").dropna()
    groups = written(e.groupBy("dst", "qname").agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id()), "groups")
    pairs = groups.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // task_pairs))  # with fewer, or broadcast, the join would deal them again
    last = F.ceil(F.col("n") / block).cast("int") - 1
    dealt = e.join(groups, ["dst", "qname"]).select("dst", "g", "src", last.alias("last"), F.pmod(F.xxhash64("src"), last + 1).cast("int").alias("mine"))
    keys = ["g", "i", "j"]  # no name, which may be a constant that the join drops from its keys
    left = dealt.select("dst", "g", F.col("mine").alias("i"), F.explode(F.sequence("mine", "last")).alias("j"), F.col("src").alias("x")).repartition(tasks, *keys)
    right = dealt.select("g", F.explode(F.sequence(F.lit(0), "mine")).alias("i"), F.col("mine").alias("j"), F.col("src").alias("y")).repartition(tasks, *keys)
    return left.join(right.hint("merge"), keys).filter("i < j OR x < y").select(F.col("dst").alias("target"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def same_target_groups(edges: DataFrame, names: DataFrame, types: list[str]) -> DataFrame:
    """(target, qname, id, first): the members of each group of two or more sources of one name that point to one target."""
    e = edges.filter(F.col("rel_type").isin(types)).select("src", "dst").join(names.select(F.col("id").alias("src"), "qname"), "src").distinct()
    groups = e.groupBy("dst", "qname").agg(F.min("src").alias("first"), F.count("*").alias("n")).filter("n >= 2")
    return e.join(groups, ["dst", "qname"]).select(F.col("dst").alias("target"), "qname", F.col("src").alias("id"), "first")


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name) of all labels and relationship types, in order."""
    labels = nodes.select(F.lit("label").alias("kind"), F.explode("labels").alias("name"))
    return labels.unionByName(edges.select(F.lit("relationship").alias("kind"), F.col("rel_type").alias("name"))).distinct().orderBy("kind", "name")


def delete_upload(nodes: DataFrame, edges: DataFrame, upload_id: str) -> GraphResult:
    """Without an upload's nodes, and without edges that touch them."""
    gone = nodes.filter(F.col("upload_id") == upload_id).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return GraphResult(nodes.filter(F.col("upload_id").isNull() | (F.col("upload_id") != upload_id)), kept)


def delete_counts(nodes: DataFrame, edges: DataFrame, upload_id: str) -> DataFrame:
    """(nodes, edges): how many rows ``delete_upload`` takes."""
    gone = nodes.filter(F.col("upload_id") == upload_id).select("id")
    touched = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()
    one = F.lit(1).alias("one")
    return gone.agg(F.count("*").alias("nodes")).select("*", one).join(touched.agg(F.count("*").alias("edges")).select("*", one), "one").drop("one")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row: what a uniqueness constraint would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
