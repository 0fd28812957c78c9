"""Scores of detections against truth, calibration, resampling, and differences of reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.intervals import overlap_join


def slots(truth: DataFrame, margin: float = 90.0) -> DataFrame:
    """``truth (set_id, position, start_s)`` with each track's slot: from ``margin`` before it to ``margin`` after the next."""
    after = F.lead("start_s").over(Window.partitionBy("set_id").orderBy("start_s", "position"))
    return truth.withColumns({"slot_start": F.col("start_s") - margin, "slot_end": F.coalesce(after, F.lit(1e12)) + margin})


def credited(truth: DataFrame, detections: DataFrame, clusters: DataFrame, titles: DataFrame | None = None, width: float = 600.0) -> DataFrame:
    """``(set_id, position, det)``: detections of a referenced recording (its cluster, or one of the same title) in the track's slot.

    ``truth`` has ``references array``; ``clusters (asset_id, cluster)``; ``titles
    (cluster, same)`` names clusters of one title.
    """
    c = clusters.select("asset_id", "cluster")
    want = slots(truth).select("set_id", "position", "slot_start", "slot_end", F.explode("references").alias("asset_id"))
    want = want.join(c, "asset_id", "left").withColumn("cluster", F.coalesce("cluster", "asset_id")).drop("asset_id")
    if titles is not None:
        more = want.join(titles, "cluster").where("cluster <> same").drop("cluster").withColumnRenamed("same", "cluster")
        want = want.unionByName(more)
    d = detections.join(c, "asset_id", "left").withColumn("cluster", F.coalesce("cluster", "asset_id"))
    a = want.distinct().select("set_id", "cluster", "position", F.col("slot_start").alias("a_start"), F.least("slot_end", F.lit(1e6)).alias("a_end"))
    b = d.select("set_id", "cluster", "det", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlap_join(a, b, ["set_id", "cluster"], width).select("set_id", "position", "det").distinct()


def set_score(truth: DataFrame, detections: DataFrame, credit: DataFrame) -> DataFrame:
    """``(set_id, referenced, identified, possible, wrong)``; detections have ``rank`` (2 confident)."""
    ranked = credit.join(detections.select("set_id", "det", "rank"), ["set_id", "det"]).groupBy("set_id", "position").agg(F.max("rank").alias("rank"))
    tracks = truth.where(F.size("references") > 0).select("set_id", "position").join(ranked, ["set_id", "position"], "left")
    score = tracks.groupBy("set_id").agg(F.count("*").alias("referenced"), F.count_if(F.col("rank") == 2).alias("identified"), F.count_if(F.col("rank") == 1).alias("possible"))
    wrong = detections.where("rank = 2").join(credit, ["set_id", "det"], "left_anti").groupBy("set_id").agg(F.count("*").alias("wrong"))
    return score.join(wrong, "set_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)))


def top_false(detections: DataFrame, credit: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` strongest detections of each set that no track is credited with."""
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("hits"), "det"))
    return detections.join(credit, ["set_id", "det"], "left_anti").withColumn("place", rank).where(F.col("place") <= k)


def seconds_classes(seconds: DataFrame, truth: DataFrame, labels: DataFrame, width: int = 600) -> DataFrame:
    """One class for each second ``(set_id, s)``, judged at its middle, in half seconds to stay whole.

    ``truth (set_id, start, end, track, indexed)`` is half open, ``labels (set_id,
    start, end, track, rank)`` closed. First that holds: a wrong confident label
    (of an unindexed time), silent (nothing indexed plays), correct, possible,
    unlabelled.
    """
    at = F.col("s") * 2 + 1
    points = seconds.select("set_id", "s", F.floor(F.col("s") / width).cast("long").alias("__bin"))

    def during(spans: DataFrame, closed: bool) -> DataFrame:
        """Seconds with the spans they are in; spans are cut into bins of ``width``."""
        cut = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
        within = at <= F.col("end") * 2 if closed else at < F.col("end") * 2
        return points.join(cut, ["set_id", "__bin"]).where((at >= F.col("start") * 2) & within).drop("__bin")

    t, l = during(truth, False), during(labels, True)  # noqa: E741
    playing = t.groupBy("set_id", "s").agg(F.max(F.col("indexed").cast("int")).alias("indexed"))
    right = l.join(t.select("set_id", "s", "track"), ["set_id", "s", "track"], "left_semi")
    wrong = l.where("rank = 2").join(t.select("set_id", "s", "track"), ["set_id", "s", "track"], "left_anti").select("set_id", "s").distinct().withColumn("wrong", F.lit(1))
    best = right.groupBy("set_id", "s").agg(F.max("rank").alias("rank"))
    joined = seconds.join(playing, ["set_id", "s"], "left").join(wrong, ["set_id", "s"], "left").join(best, ["set_id", "s"], "left")
    indexed = F.coalesce(F.col("indexed"), F.lit(0)) == 1
    klass = (
        F.when(F.col("wrong").isNotNull() & indexed, "mislabelled")
        .when(F.col("wrong").isNotNull(), "mislabelled_unindexed")
        .when(~indexed, "silent")
        .when(F.col("rank") == 2, "correct")
        .when(F.col("rank") == 1, "possible")
        .otherwise("unlabelled")
    )
    return joined.select("set_id", "s", klass.alias("class"))


def sweep_rows(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """``results (.., found boolean, wrong int, error)`` by condition: queries, found, recall, wrong, mean and greatest error of the found."""
    error = F.when(F.col("found"), F.abs("error"))
    return results.groupBy(*by).agg(F.count("*").alias("queries"), F.count_if("found").alias("found"), F.avg(F.col("found").cast("int")).alias("recall"), F.sum("wrong").alias("wrong"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def condition_rows(results: DataFrame, condition: str, speed: str) -> DataFrame:
    """Confident, possible and wrong by condition and speed, with totals (null) as a rollup."""
    return results.rollup(condition, speed).agg(F.count("*").alias("queries"), F.count_if(F.col("rank") == 2).alias("confident"), F.count_if(F.col("rank") == 1).alias("possible"), F.sum("wrong").alias("wrong"))


def calibration(results: DataFrame, least: int = 30) -> DataFrame:
    """One row: weakest right hits, strongest false ones, their ratio, and how many of each reach ``least``."""
    right, false = F.when(F.col("right"), F.col("hits")), F.when(~F.col("right"), F.col("hits"))
    return results.agg(F.min(right).alias("weakest_right"), F.max(false).alias("strongest_false"), (F.min(right) / F.max(false)).alias("margin"), F.count_if(right >= least).alias("right_kept"), F.count_if(false >= least).alias("false_kept"))


def family_rates(items: DataFrame, family: str, hit: str) -> DataFrame:
    """One row: share of items hit, and the mean over families of each family's share."""
    by = items.groupBy(family).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("k"))
    return by.agg((F.sum("k") / F.sum("n")).alias("item_rate"), F.avg(F.col("k") / F.col("n")).alias("family_rate"), F.count("*").alias("families"))


def draw_weight(draw, unit, units, slots_):
    """Unit that a slot of a draw takes: an integer hash that this engine, plain SQL and NumPy can state."""
    x = (draw * 7919 + slots_ * 104729 + 12345) % 2147483647
    x = (x * 48271) % 2147483647
    return (x * 48271 % 2147483647) % units


#: Units that a task of the bootstrap holds; more are gone through block by block.
BOOTSTRAP_UNITS = 1 << 20


def bootstrap(unit_sums: DataFrame, draws: int = 2000, block: int = BOOTSTRAP_UNITS) -> DataFrame:
    """Nearest-rank 2.5 and 97.5 % of the rate over resamples of whole units ``(unit_no 0.., k, n)``, one row.

    A draw takes as many units as there are, with replacement; the arithmetic of
    the draws is whole numbers, so the result is the same everywhere. Units are dealt to
    parts of the draws in blocks; what a draw takes exists only as arrays of one task.
    """
    spark = unit_sums.sparkSession
    parts = max(1, min(draws, 2 * spark.sparkContext.defaultParallelism))
    kind = "long" if all(unit_sums.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for c in "kn") else "double"
    count = unit_sums.agg(F.count("*").alias("units"))
    dealt = unit_sums.select(F.col("unit_no").cast("long").alias("unit_no"), F.col("k").cast(kind).alias("k"), F.col("n").cast(kind).alias("n")).crossJoin(F.broadcast(count))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("block", F.floor(F.col("unit_no") / block).cast("long"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, first = key[0].as_py(), key[1].as_py() * block
        units = table.column("units")[0].as_py()
        held = np.zeros((2, min(block, max(units - first, 0))), np.int64 if kind == "long" else np.float64)
        at = table.column("unit_no").to_numpy() - first
        for row, name in zip(held, "kn"):
            np.add.at(row, at[at < len(row)], table.column(name).fill_null(0).to_numpy()[at < len(row)])
        mine, sums = range(part, draws, parts), []
        for draw in mine:
            k = n = 0
            for lo in range(0, units, 1 << 18):
                taken = draw_weight(draw, None, units, np.arange(lo, min(units, lo + (1 << 18)))) - first
                taken = taken[(taken >= 0) & (taken < held.shape[1])] if units > block else taken
                k, n = k + held[0][taken].sum().item(), n + held[1][taken].sum().item()
            sums.append((draw, k, n))
        columns = list(zip(*sums))
        return pa.table({"draw": pa.array(columns[0], pa.int64()), "k": pa.array(columns[1]), "n": pa.array(columns[2])})

    sums = dealt.repartition(parts, "part").groupBy("part", "block").applyInArrow(run, f"draw long, k {kind}, n {kind}")
    rate = sums.groupBy("draw").agg((F.sum("k") / F.sum("n")).alias("rate"))
    # as many values as draws: a fixed number
    at = lambda p: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * p).cast("int")))
    held = rate.agg(F.sort_array(F.collect_list("rate")).alias("v"))
    return held.select(at(0.025).alias("low"), at(0.975).alias("high"), F.size("v").alias("draws"))


def sweep_diff(old: DataFrame, new: DataFrame, key: str, identity: str, values: Sequence[str]) -> DataFrame:
    """Positional difference of two sweeps: ``(key, state)``, incomparable where the query identities differ."""
    a = old.select(key, F.col(identity).alias("__ia"), F.struct(*values).alias("__a"))
    b = new.select(key, F.col(identity).alias("__ib"), F.struct(*values).alias("__b"))
    state = (
        F.when(F.col("__ia").isNull(), "new")
        .when(F.col("__ib").isNull(), "gone")
        .when(F.col("__ia") != F.col("__ib"), "incomparable")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(set_id, old_no, new_no)``: each old detection, by start, takes the unmatched new one of its asset that overlaps it most."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free, out = {r.no: r for r in b.sort_values("no").itertuples()} if len(b) else {}, []
        for r in a.sort_values(["start", "no"], kind="stable").itertuples() if len(a) else ():
            best, most = None, 0
            for n, c in free.items():
                common = min(r.end, c.end) - max(r.start, c.start)
                if common > most:
                    best, most = n, common
            if best is not None:
                free.pop(best)
            out.append((key[0], key[1], r.no, best))
        out += [(key[0], key[1], None, n) for n in free]
        return pd.DataFrame(out, columns=["set_id", "asset_id", "old_no", "new_no"]).astype({"old_no": "Int64", "new_no": "Int64"})

    g, fields = ["set_id", "asset_id"], ["set_id", "asset_id", "no", "start", "end"]
    old, new = (df.select(*fields).toDF(*(f"{c}_{k}" for c in fields)).toDF(*fields) for k, df in enumerate((old, new)))  # two views of one table have columns of their own
    return old.groupBy(*g).cogroup(new.groupBy(*g)).applyInPandas(run, "set_id long, asset_id long, old_no long, new_no long")


def identical(old: DataFrame, new: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return not old.exceptAll(new).limit(1).count() and not new.exceptAll(old).limit(1).count()


def loss_rows(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hits available and kept by window, band or both."""
    return hits.groupBy(*by).agg(F.count("*").alias("available"), F.count_if("kept").alias("kept"), F.avg(F.col("kept").cast("int")).alias("share"))


def pair_fate(anchor: Column, target: Column, paired: Column, rank: Column) -> Column:
    """Why a pair was lost: its points gone, paired elsewhere by rank, or its value changed."""
    return (
        F.when(~anchor & ~target, "both gone")
        .when(~anchor, "anchor gone")
        .when(~target, "target gone")
        .when(paired == "same", "kept")
        .when(paired == "near", "near")
        .when(paired == "far", "value changed")
        .when(rank.isNull(), "outside zone")
        .when(rank <= 2, "kept")
        .when(rank == 3, "displaced 3")
        .when(rank <= 5, "displaced 4-5")
        .when(rank <= 8, "displaced 6-8")
        .otherwise("displaced later")
    )


def patch_state(corr: Column, residual_db: Column, has_anchor: Column, eq_shape: Column) -> Column:
    """State of a band of a version patch."""
    return (
        F.when(corr >= 0.5, "supported")
        .when((residual_db < -10) & eq_shape, "killed")
        .when(~has_anchor, "unobservable")
        .when(residual_db < -10, "contradicted")
        .when(residual_db > 3, "masked")
        .when(corr < 0.2, "contradicted")
        .otherwise("unobservable")
    )


def latest_answers(answers: DataFrame) -> DataFrame:
    """Answers ``(question, seq, answer, undoes)`` folded: those an undo record names go, then the latest of each question stays."""
    undone = answers.where("undoes is not null").select(F.col("undoes").alias("seq"))
    left = answers.where("undoes is null").join(undone, "seq", "left_anti")
    return left.groupBy("question").agg(F.max(F.struct("seq", "answer")).alias("x")).select("question", F.col("x.seq").alias("seq"), F.col("x.answer").alias("answer"))


def minimised(steps: list[tuple[str, float]], fails: Callable[[list[tuple[str, float]]], bool]) -> list[tuple[str, float]]:
    """The steps of a failing case less those it does not need, then halved while it still fails."""
    i = 0
    while i < len(steps):
        less = steps[:i] + steps[i + 1 :]
        if fails(less):
            steps = less
        else:
            i += 1
    for i in range(len(steps)):
        while abs(steps[i][1]) > 1e-3:
            half = [*steps[:i], (steps[i][0], steps[i][1] / 2), *steps[i + 1 :]]
            if not fails(half):
                break
            steps = half
    return steps


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, failed)`` counts of rows for which a rule is false or null."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules))).alias("x")).select("x.*")
