"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialise


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the least of them; edges come as ``u < v``."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    moved = joined.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` of every node that has an edge; a component is named by its least node.

    Every round is two aggregations and two equi-joins whose smaller side has one
    row a node, so a hub only makes a join side that adaptive execution can split.
    Rows with a null end and self loops carry no link. An empty table gives an
    empty result. Lineage is cut each round by a table in the shared folder.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    e = materialise(e, "components", compact=True)
    seen = None
    for _ in range(max_rounds):
        e = materialise(_smaller_to_least(_larger_to_least(e)), "components", compact=True)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def unordered(a, b):
    """Both ends of a pair, the lesser first."""
    return F.least(a, b), F.greatest(a, b)


def with_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``pairs (a, b, same)`` where a verdict ``(a, b, same)`` on the unordered pair, if any, decides."""
    v = verdicts.select(*(x.alias(n) for x, n in zip(unordered(F.col("a"), F.col("b")), ("__a", "__b"))), F.col("same").alias("__same"))
    v = v.groupBy("__a", "__b").agg(F.min("__same").alias("__same"))
    low, high = unordered(F.col("a"), F.col("b"))
    joined = pairs.join(v, (low == F.col("__a")) & (high == F.col("__b")), "left")
    return joined.withColumn("same", F.coalesce("__same", "same")).drop("__a", "__b", "__same")


def separated(links: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of ``links (a, b, density)`` in which no pair of ``apart (a, b)`` is together, and the links cut for it.

    While a component holds such a pair, in the pairs' order, the sparsest link on
    a shortest chain between the two is cut. Components without such a pair are
    not looked at; one that has some is handled as one group of links.
    """
    kept = links.select(*(x.alias(n) for x, n in zip(unordered(F.col("a"), F.col("b")), ("a", "b"))), "density")
    kept = materialise(kept.groupBy("a", "b").agg(F.max("density").alias("density")), "links", compact=True)
    parts = materialise(connected_components(kept, "a", "b"), "parts", compact=True)
    x, y = parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    wrong = materialise(apart.select("a", "b").join(x, "a").join(y, "b").where("ca = cb").select(F.col("ca").alias("component"), F.col("a").alias("one"), F.col("b").alias("other")), "wrong", compact=True)
    own = kept.join(x, "a").withColumnRenamed("ca", "component").join(wrong.select("component").distinct(), "component", "left_semi").select("component", "a", "b", "density")
    cuts = materialise(own.groupBy("component").cogroup(wrong.groupBy("component")).applyInPandas(_cut_apart, kept.schema), "cuts", compact=True)
    return connected_components(kept.join(cuts.select("a", "b"), ["a", "b"], "left_anti"), "a", "b"), cuts


def _cut_apart(links, pairs):
    """The links to cut so that no pair is connected any more."""
    density = {(a, b): d for a, b, d in zip(links.a, links.b, links.density)} if len(links) else {}
    near: dict = {}
    for a, b in density:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def chain(start, goal):
        """Links of a shortest chain, breadth first with neighbours in order; None if there is none."""
        came, queue = {start: None}, deque([start])
        while queue and goal not in came:
            node = queue.popleft()
            for n in sorted(near.get(node, ())):
                if n not in came:
                    came[n] = node
                    queue.append(n)
        if goal not in came:
            return None
        out, node = [], goal
        while came[node] is not None:
            out.append(tuple(sorted((node, came[node]))))
            node = came[node]
        return out

    cut = []
    for start, goal in sorted(zip(pairs.one, pairs.other)) if len(pairs) else ():
        while found := (chain(start, goal) if start != goal else None):
            a, b = min(found, key=lambda x: (density[x], x))
            near[a].discard(b)
            near[b].discard(a)
            cut.append((a, b, density[a, b]))
    import pandas as pd

    return pd.DataFrame(cut, columns=["a", "b", "density"])


def families(recordings: DataFrame, titles: DataFrame, relations: DataFrame) -> DataFrame:
    """``(tier, node, family)``: components of the links of each tier and all tiers before it, named by their least member."""
    pair = lambda df: df.select("a", "b")
    tiers = [("recording", pair(recordings)), ("title", pair(recordings).unionByName(pair(titles))), ("relation", pair(recordings).unionByName(pair(titles)).unionByName(pair(relations)))]
    out = None
    for name, links in tiers:
        own = connected_components(links, "a", "b").select(F.lit(name).alias("tier"), "node", F.col("component").alias("family"))
        out = own if out is None else out.unionByName(own)
    return out


def frontier(seeds: DataFrame, links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, round)``: nodes reached from ``seeds (node)`` over ``links (a, b)``, round by round until none is new."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = materialise(seeds.select("node").distinct().withColumn("round", F.lit(0)), "frontier", compact=True)
    for n in range(1, max_rounds + 1):
        new = found.where(F.col("round") == n - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = materialise(new.join(found, "node", "left_anti").withColumn("round", F.lit(n)), "frontier", compact=True)
        if not new.limit(1).count():
            break
        found = materialise(found.unionByName(new), "frontier", compact=True)
    return found


def sparse(pairs: DataFrame, density: str = "density", share: float = 0.1) -> DataFrame:
    """Pairs below ``share`` of the upper median density."""
    by = pairs.groupBy(F.col(density).alias("__d")).agg(F.count("*").alias("__c"))
    from pyspark.sql.window import Window

    upto = F.sum("__c").over(Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0))
    total = F.broadcast(by.agg(F.sum("__c").alias("__n")))
    median = by.withColumn("__upto", upto).crossJoin(total).where(F.col("__upto") > F.floor(F.col("__n") / 2)).agg(F.min("__d").alias("__median"))
    return pairs.crossJoin(F.broadcast(median)).where(F.col(density) < share * F.col("__median")).drop("__median")


def related(pairs: DataFrame, clusters: DataFrame, least: int = 30) -> DataFrame:
    """Of pairs ``(a, b, hits)`` across clusters with ``least`` hits the strongest of each pair of clusters."""
    c = clusters.select(F.col("node"), F.col("component"))
    joined = pairs.where(F.col("hits") >= least)
    for side in ("a", "b"):
        joined = joined.join(c.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    joined = joined.where("ca <> cb")
    low, high = unordered(F.col("ca"), F.col("cb"))
    return joined.groupBy(low.alias("ca"), high.alias("cb")).agg(F.max(F.struct("hits", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x")).select("ca", "cb", F.col("x.hits").alias("hits"), (-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b"))
