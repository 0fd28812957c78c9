"""Repeats within a sequence, and passages that recur across sequences."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.graph import connected_components
from seqloom.operators.index import fullest_threshold, hash_stats
from seqloom.operators.intervals import merged
from seqloom.session import materialise


def repeat_hits(hashes: DataFrame, keys: Sequence[str], lag: int, most: int = 40, cell: int = 312, step: int = 2) -> DataFrame:
    """``(keys, cell, lag, hits)``: equal hashes at least ``lag`` apart in one sequence, counted by cell and lag.

    Hashes ``(keys, hash, at)`` that occur more than ``most`` times in a sequence
    are left out, which bounds the pairs of a hash.
    """
    lists = hashes.groupBy(*keys, "hash").agg(F.collect_list("at").alias("ats"), F.count("*").alias("n")).where(F.col("n").between(2, most))
    pairs = lists.select(*keys, "ats", F.explode("ats").alias("a")).select(*keys, "a", F.explode("ats").alias("b")).where(F.col("b") - F.col("a") >= lag)
    rounded = (F.floor((F.col("b") - F.col("a")) / step) * step).cast("long")
    return pairs.groupBy(*keys, F.floor(F.col("a") / cell).cast("long").alias("cell"), rounded.alias("lag")).agg(F.count("*").alias("hits"))


def repeat_groups(repeat_hits_: DataFrame, keys: Sequence[str], least: int = 10, cell: int = 312) -> DataFrame:
    """``(keys, cell, group)``: cells joined, transitively, to those their repeats reach from the middle."""
    strong = repeat_hits_.where(F.col("hits") >= least)
    to = F.floor((F.col("cell") * cell + cell / 2 + F.col("lag")) / cell).cast("long")
    node = lambda c: F.concat_ws("/", *(F.col(k).cast("string") for k in keys), F.lpad(c.cast("string"), 12, "0"))
    names = strong.select(*keys, F.col("cell")).unionByName(strong.select(*keys, to.alias("cell"))).distinct().withColumn("node", node(F.col("cell")))
    comps = connected_components(strong.select(node(F.col("cell")).alias("u"), node(to).alias("v")))
    return names.join(comps, "node").select(*keys, "cell", F.col("component").alias("group"))


def repeat_blocks(groups: DataFrame, keys: Sequence[str], cell: int = 312, least: int = 1875) -> DataFrame:
    """Stretches of neighbouring cells of a group, ``least`` long or more; those that overlap are one."""
    cells = groups.select(*keys, "group", (F.col("cell") * cell).alias("start"), ((F.col("cell") + 1) * cell).alias("end"))
    blocks = merged(cells, [*keys, "group"], 0).where(F.col("end") - F.col("start") >= least)
    return merged(blocks.select(*keys, "start", "end"), keys, 0, touching=False).select(*keys, "start", "end")


def correspondences(links: DataFrame) -> DataFrame:
    """``(a, b, link, no)``: links ``(a, b, link, a_start, a_end, b_start, b_end)`` of two sequences, each put to the first
    correspondence that it overlaps in both, else to a new one; a correspondence grows with its links. In order of link.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, out = [], []
        for r in pdf.sort_values("link", kind="stable").itertuples():
            for n, c in enumerate(found):
                if r.a_start < c[1] and c[0] < r.a_end and r.b_start < c[3] and c[2] < r.b_end:
                    c[:] = [min(c[0], r.a_start), max(c[1], r.a_end), min(c[2], r.b_start), max(c[3], r.b_end)]
                    break
            else:
                n = len(found)
                found.append([r.a_start, r.a_end, r.b_start, r.b_end])
            out.append((r.a, r.b, r.link, n))
        return pd.DataFrame(out, columns=["a", "b", "link", "no"])

    fields = links.select("a", "b", "link", "a_start", "a_end", "b_start", "b_end")
    types = {f.name: f.dataType.simpleString() for f in fields.schema.fields}
    return fields.groupBy("a", "b").applyInPandas(run, f"a {types['a']}, b {types['b']}, link {types['link']}, no int")


def pieces(spans: DataFrame, keys: Sequence[str], length: int, step: int) -> DataFrame:
    """Overlapping pieces of spans ``(start, end)``; a span shorter than ``length`` is one piece."""
    last = F.greatest(F.col("start"), F.col("end") - length)
    starts = F.array_distinct(F.array_append(F.sequence(F.col("start"), last, F.lit(step)), last))
    cut = spans.select(*keys, "end", F.explode(starts).alias("start"))
    return cut.select(*keys, "start", F.least(F.col("end"), F.col("start") + length).alias("end"))


def digests(pairs_table: DataFrame, id_col: str, *more: Column) -> DataFrame:
    """Items with ``__n, __x, __s``, the same for those with the same hashes at the same places, and ``more``."""
    h = lambda salt: F.xxhash64("hash", "pos", F.lit(salt))
    return pairs_table.groupBy(id_col).agg(F.count("*").alias("__n"), F.bit_xor(h(0)).alias("__x"), F.sum(h(1).bitwiseAND((1 << 32) - 1)).alias("__s"), *more)


def equal_items(pairs_table: DataFrame, id_col: str) -> DataFrame:
    """``(id, representative)``: of items with the same hashes ``(id, hash, pos)`` at the same places the least one stands for all."""
    digest = digests(pairs_table, id_col)
    least = digest.groupBy("__n", "__x", "__s").agg(F.min(id_col).alias("representative"))
    return digest.join(least, ["__n", "__x", "__s"]).select(id_col, "representative")


def representatives(pairs_table: DataFrame, id_col: str, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with what stands for them, the postings ``(id, hash, pos)`` of those that do, and these in lists of several with whether the list is ``full``.

    Hashes are 64-bit numbers here. The ``share`` of lists that are longest are full.
    """
    every = materialise(pairs_table.select(id_col, F.xxhash64("hash").alias("hash"), F.col("pos").cast("long").alias("pos")), "match-postings")
    members = materialise(equal_items(every, id_col), "equal-items", compact=True)
    copies = members.where(F.col(id_col) != F.col("representative")).select(id_col)
    postings = every.join(copies, id_col, "left_anti")
    stats = materialise(hash_stats(postings), "match-lists", compact=True)
    full = F.coalesce(F.col("len") > F.col("threshold"), F.lit(False))
    lists = stats.where("len > 1").crossJoin(F.broadcast(fullest_threshold(stats, share))).select("hash", full.alias("full"))
    return members, postings, materialise(postings.join(lists, "hash"), "match-marked")


def measured(candidates: DataFrame, left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """``(a, b, offset, hits)`` of each pair ``(a, b)`` by all hashes: the offset that most share, of several the least."""
    x = candidates.join(left.select(F.col(id_col).alias("a"), "hash", F.col("pos").alias("pa")), "a")
    votes = x.join(right.select(F.col(id_col).alias("b"), "hash", F.col("pos").alias("pb")), ["b", "hash"])
    votes = votes.groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("offset")).agg(F.count("*").alias("hits"))
    best = votes.groupBy("a", "b").agg(F.max(F.struct("hits", (-F.col("offset")).alias("o"))).alias("x"))
    return best.select("a", "b", (-F.col("x.o")).alias("offset"), F.col("x.hits").alias("hits"))


def self_matches(pairs_table: DataFrame, id_col: str, share: float = 0.01, least_hits: int = 3, least_share: float = 0.2, searched: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Pairs of items that share hashes on one offset, ``a, b, offset, hits, share`` of the shorter; and ``(id, representative)`` of all.

    ``pairs_table (id, hash, pos)``. Equal items are one: pairs are of representatives,
    so copies make none. Two items are measured, by all their hashes, if they meet on
    one offset ``least_hits`` times and ``searched`` of as often as the result asks for: in the lists but for the fullest ``share``,
    where all holders meet, or in a full one, where each meets the first holder, so
    a list makes no more pairs than it has places however many items hold it.
    """
    members, postings, marked = representatives(pairs_table, id_col, share)
    kept, full = marked.where("not full").drop("full"), marked.where("full").drop("full")
    a, b = kept.select("hash", F.col(id_col).alias("a"), F.col("pos").alias("pa")), kept.select("hash", F.col(id_col).alias("b"), F.col("pos").alias("pb"))
    first = full.groupBy("hash").agg(F.min(F.struct(F.col(id_col).alias("a"), F.col("pos").alias("pa"))).alias("first")).select("hash", "first.a", "first.pa")
    met = a.join(b, "hash").where("a < b")
    met = met.unionByName(full.select("hash", F.col(id_col).alias("b"), F.col("pos").alias("pb")).join(first, "hash").where("a < b"))
    votes = met.groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("offset")).agg(F.count("*").alias("hits"))
    met = votes.where(F.col("hits") >= least_hits).groupBy("a", "b").agg(F.max("hits").alias("hits"))
    size = postings.groupBy(id_col).agg(F.count("*").alias("size"))
    met = met.join(size.select(F.col(id_col).alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col(id_col).alias("b"), F.col("size").alias("sb")), "b")
    candidates = met.where(F.col("hits") >= searched * least_share * F.least("sa", "sb")).select("a", "b", F.least("sa", "sb").alias("shorter"))
    candidates = materialise(candidates, "match-candidates", compact=True)
    best = measured(candidates.select("a", "b"), postings, postings, id_col).join(candidates, ["a", "b"])
    part = F.col("hits") / F.col("shorter")
    return best.select("a", "b", "offset", "hits", part.alias("share")).where(F.col("share") >= least_share), members
