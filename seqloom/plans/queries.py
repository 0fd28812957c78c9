"""Registered queries over the driver's tables, each with SQL that says the same where SQL can.

Events stand for detections: one is an interval of its user from its time on,
600 s for each unit of its value. Documents and test items stand for recordings:
their tokens are points, pairs of tokens the hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import scalars as sc
from seqloom.operators import align, fits, graph, harness, index, intervals, plays, repeats, scoring, verify
from seqloom.plans import compose
from seqloom.session import materialise
from seqloom.sources import library, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000000")
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", start.alias("start"))
    return e.withColumn("end", F.col("start") + F.round(F.col("value") * 100).cast("long") * 6)


def named(df: DataFrame) -> DataFrame:
    """``start`` and ``end`` are words of SQL."""
    return df.withColumnsRenamed({"start": "start_s", "end": "end_s"})


def doc_pairs(spark, sf_dir):
    return compose.document_pairs(t(spark, sf_dir, "documents"), "doc_id")


def item_pairs(spark, sf_dir):
    return compose.document_pairs(t(spark, sf_dir, "benchmark"), "item_id")


#: The same intervals, tokens and pairs in SQL.
IV = "iv AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(round(value * 100) AS BIGINT) * 6 AS b FROM events)"


def PAIRS(table: str, key: str, name: str) -> str:  # noqa: N802
    return f"""{name}_t AS (SELECT {key}, unnest(ws) AS tok, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {table})),
    {name}_l AS (SELECT *, lead(tok, 1) OVER w AS n1, lead(tok, 2) OVER w AS n2 FROM {name}_t WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
    {name} AS (SELECT {key}, tok || '|' || n1 || '|1' AS hash, pos FROM {name}_l WHERE n1 IS NOT NULL UNION ALL SELECT {key}, tok || '|' || n2 || '|2', pos FROM {name}_l WHERE n2 IS NOT NULL)"""


DP, IP = PAIRS("documents", "doc_id", "dp"), PAIRS("benchmark", "item_id", "ip")
STATS = "st AS (SELECT hash, count(*) AS len FROM dp GROUP BY hash)"
CUT = "cut AS (SELECT CASE WHEN k = 0 THEN NULL WHEN k >= n THEN 0 ELSE (SELECT len FROM (SELECT len, row_number() OVER (ORDER BY len DESC) - 1 AS r FROM st) WHERE r = k) END AS threshold FROM (SELECT count(*) AS n, CAST(round(count(*) * 0.01) AS BIGINT) AS k FROM st))"


# -- search ----------------------------------------------------------------------


@query(f"""WITH {DP}, {IP}, size AS (SELECT item_id, count(*) AS pairs FROM ip GROUP BY 1),
    v AS (SELECT item_id, doc_id, dp.pos - ip.pos AS "offset", count(*) AS hits FROM ip JOIN dp USING (hash) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC, "offset") AS k FROM v)
    SELECT item_id, doc_id, hits, "offset", pairs, CASE WHEN hits >= 0.8 * pairs THEN 'confident' WHEN hits >= 0.2 * pairs THEN 'possible' ELSE 'weak' END AS tier FROM r JOIN size USING (item_id) WHERE k = 1""")
def passage_search(spark, sf_dir):
    return align.passage_search(item_pairs(spark, sf_dir), doc_pairs(spark, sf_dir), "item_id", "doc_id")


@query(f"""WITH {DP}, {IP} SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ip JOIN dp USING (hash) GROUP BY item_id""")
def lookup_join(spark, sf_dir):
    hits = align.lookup(item_pairs(spark, sf_dir).withColumnRenamed("pos", "qframe"), doc_pairs(spark, sf_dir))
    return hits.groupBy("item_id").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH {DP}, {IP}, h AS (SELECT item_id, doc_id, floor((dp.pos - ip.pos) / 4) AS bk FROM ip JOIN dp USING (hash)),
    p AS (SELECT item_id, doc_id, bk AS pr FROM h UNION ALL SELECT item_id, doc_id, bk + 1 FROM h),
    ok AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, doc_id, pr FROM p GROUP BY ALL HAVING count(*) >= 3))
    SELECT item_id, doc_id, count(*) AS hits FROM h SEMI JOIN ok USING (item_id, doc_id) GROUP BY ALL""")
def prefilter_buckets(spark, sf_dir):
    hits = align.lookup(item_pairs(spark, sf_dir).withColumnRenamed("pos", "qpos"), doc_pairs(spark, sf_dir))
    return align.possible_lines(hits, ["item_id", "doc_id"], F.col("pos") - F.col("qpos")).groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))


@query()
def line_trace(spark, sf_dir):
    """Lines of test items in documents, with the chain each belongs to."""
    q = item_pairs(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.lit(0).alias("rung_no"), F.lit(1.0).alias("speed"), F.lit("turntable").alias("playback"), "hash", F.col("pos").cast("double").alias("qframe"))
    p = doc_pairs(spark, sf_dir).select("hash", F.col("doc_id").alias("asset_id"), F.col("pos").cast("long").alias("frame"))
    return align.align(q, p, trace=True)


@query(f"""WITH {DP}, {IP}, b AS (SELECT item_id, doc_id, max(hits) AS hits FROM (SELECT item_id, doc_id, dp.pos - ip.pos AS o, count(*) AS hits FROM ip JOIN dp USING (hash) GROUP BY ALL) GROUP BY ALL)
    SELECT item_id, count(*) AS docs, max(hits) AS strongest FROM b WHERE hits >= 10 GROUP BY item_id""")
def holders_of_passages(spark, sf_dir):
    found = passage_search(spark, sf_dir).where("hits >= 10")
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("hits").alias("strongest"))


@query(f"""WITH {DP}, {IP}, q AS (SELECT DISTINCT item_id, hash, pos FROM ip) SELECT item_id, count(*) AS met FROM q WHERE EXISTS (SELECT 1 FROM dp WHERE dp.hash = q.hash AND abs(dp.pos - q.pos) <= 2) GROUP BY item_id""")
def survival_join(spark, sf_dir):
    q = item_pairs(spark, sf_dir).distinct().withColumnRenamed("pos", "frame")
    return align.near_hits(q, doc_pairs(spark, sf_dir).withColumnRenamed("pos", "frame").select("hash", "frame").distinct()).groupBy("item_id").agg(F.count("*").alias("met"))


@query()
def identify_synthetic(spark, sf_dir):
    """The whole search on made-up audio peaks: a library that grows with the data, a mix of ten stretches, 41 speeds and both playbacks."""
    assets = max(4, t(spark, sf_dir, "customer").count() // 60)
    plan = [(0, k * 7 % assets, 30, 55, (0.95, 1.0, 1.03, 1.06)[k % 4], 60 * k) for k in range(10)]
    plan = spark.createDataFrame(plan, "query_id long, asset_id long, from_s int, length_s int, speed double, at_s int")
    made = compose.synthetic_library(spark, assets)
    postings, mix = materialise(compose.build_index(made), "postings"), materialise(compose.synthetic_mix(made, plan), "mix")
    found = compose.identify(mix, postings, index.speed_ladder(spark))
    return named(found.select("query_id", "asset_id", "start", "end", "level", "hits", "windows", "speed", "playback"))


@query("""WITH n AS (SELECT greatest(4, count(*) // 60) AS assets FROM customer), p AS (SELECT k, k * 7 % assets AS asset_id, [0.95, 1.0, 1.03, 1.06][k % 4 + 1] AS speed FROM n, range(10) r(k))
    SELECT k AS stretch, asset_id, CAST(speed AS DOUBLE) AS speed, 'confident' AS level, true AS at_its_place FROM p""")
def identify_planted(spark, sf_dir):
    """Of the stretches that the mix of :func:`identify_synthetic` plays, which the search names, at which speed, and whether where they are."""
    assets = max(4, t(spark, sf_dir, "customer").count() // 60)
    plan = spark.range(10).select(F.col("id").alias("stretch"), (F.col("id") * 7 % assets).alias("asset_id"), F.element_at(F.array(*map(F.lit, (0.95, 1.0, 1.03, 1.06))), (F.col("id") % 4 + 1).cast("int")).alias("planned"), (F.col("id") * 60).alias("at_s"))
    found = identify_synthetic(spark, sf_dir).where("level = 'confident'").select("asset_id", "start_s", "end_s", F.col("speed").alias("heard"), "level")
    met = plan.join(found, "asset_id").where((F.abs(F.col("heard") - F.col("planned")) <= 0.002) & (F.col("start_s") < F.col("at_s") + 50) & (F.col("end_s") > F.col("at_s")))
    near = (F.abs(F.col("start_s") - F.col("at_s")) <= 5) & (F.abs(F.col("end_s") - F.col("at_s") - 55 / F.col("planned")) <= 5)
    return met.select("stretch", "asset_id", F.col("planned").alias("speed"), "level", near.alias("at_its_place"))


@query(f"""WITH {DP}, {IP}, v AS (SELECT item_id, doc_id, dp.pos - ip.pos AS o, count(*) AS hits FROM ip JOIN dp USING (hash) GROUP BY ALL), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC, o) AS k FROM v) WHERE k = 1 AND hits >= 3),
    m AS (SELECT d.item_id, d.doc_id, ip.pos // 16 AS w, dp.pos - (ip.pos + o) AS dev FROM d JOIN ip ON ip.item_id = d.item_id JOIN dp ON dp.doc_id = d.doc_id AND dp.hash = ip.hash WHERE hits >= 10 AND abs(dp.pos - (ip.pos + o)) <= 24),
    r AS (SELECT item_id, doc_id, max(n) AS run FROM (SELECT *, count(*) OVER (PARTITION BY item_id, doc_id, w ORDER BY dev RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM m) GROUP BY item_id, doc_id, w HAVING max(n) >= 3)
    SELECT item_id, doc_id, 'fitted' AS pass, count(*) AS windows, CAST(sum(run) AS BIGINT) AS hits FROM r GROUP BY item_id, doc_id UNION ALL SELECT item_id, doc_id, 'ladder', 0, hits FROM d WHERE hits < 10""")
def refine_passages(spark, sf_dir):
    """The second pass on passages found by votes: evidence counted again near the alignment, window by window of 16 words."""
    found = passage_search(spark, sf_dir).where("hits >= 3")
    d = found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("asset_id"), F.lit(0).alias("ord"), F.lit(0).alias("rung_no"), F.lit(0.0).alias("start"), F.lit(1e6).alias("end"), F.lit(1.0).alias("speed"), F.col("offset").cast("double").alias("offset"), F.lit(0).alias("windows"), F.col("hits").cast("int").alias("hits"))
    heard = item_pairs(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.lit(0).alias("rung_no"), "hash", F.col("pos").cast("double").alias("qframe"))
    p = doc_pairs(spark, sf_dir).select("hash", F.col("doc_id").alias("asset_id"), F.col("pos").cast("long").alias("frame"))
    out = align.refine(d, heard, p, align.Options(window_frames=16))
    return out.select(F.col("query_id").alias("item_id"), F.col("asset_id").alias("doc_id"), "pass", F.col("windows").cast("long").alias("windows"), F.col("hits").cast("long").alias("hits"))


# -- index -----------------------------------------------------------------------


@query(f"""WITH {DP}, {STATS} SELECT len, count(*) AS lists FROM st GROUP BY len""")
def posting_stats(spark, sf_dir):
    return index.hash_stats(doc_pairs(spark, sf_dir)).groupBy("len").agg(F.count("*").alias("lists"))


@query(f"""WITH {DP}, {STATS}, {CUT} SELECT threshold, (SELECT count(*) FROM st, cut WHERE len > threshold) AS aside FROM cut""")
def fullest_cut(spark, sf_dir):
    stats = index.hash_stats(doc_pairs(spark, sf_dir))
    cut = index.fullest_threshold(stats)
    aside = stats.crossJoin(F.broadcast(cut)).agg(F.count_if(F.col("len") > F.col("threshold")).alias("aside"))
    return cut.crossJoin(F.broadcast(aside))


@query(f"""WITH {DP}, {STATS}, {CUT} SELECT doc_id, count(*) AS postings, count(*) FILTER (WHERE len > threshold) AS set_aside, count(*) FILTER (WHERE len > threshold) / count(*) AS share FROM dp JOIN st USING (hash), cut GROUP BY doc_id""")
def hash_census(spark, sf_dir):
    p = doc_pairs(spark, sf_dir).withColumnRenamed("doc_id", "asset_id")
    stats = index.hash_stats(p)
    return index.census(p, stats, index.fullest_threshold(stats)).withColumnRenamed("asset_id", "doc_id")


@query(f"""WITH {DP}, {STATS}, {CUT} SELECT doc_id, count(*) AS postings FROM dp WHERE hash NOT IN (SELECT hash FROM st, cut WHERE len > threshold) GROUP BY doc_id""")
def without_fullest_lists(spark, sf_dir):
    p = doc_pairs(spark, sf_dir)
    stats = index.hash_stats(p)
    return index.without_fullest(p, stats, index.fullest_threshold(stats)).groupBy("doc_id").agg(F.count("*").alias("postings"))


@query(f"""WITH {DP}, h AS (SELECT hash, count(*) AS len, count(DISTINCT doc_id) AS holders FROM dp GROUP BY hash) SELECT hash, len, holders FROM h WHERE holders >= 5""")
def rank_by_holders(spark, sf_dir):
    return index.holders(doc_pairs(spark, sf_dir), "doc_id").where("holders >= 5")


@query(f"""WITH {DP}, {STATS} SELECT doc_id, round(sum(1 / ln(2.718281828459045 + len)), 6) AS rarity, count(*) AS kept, quantile_cont(len, 0.5) AS median_len FROM dp JOIN st USING (hash) GROUP BY doc_id""")
def rarity_sum(spark, sf_dir):
    p = doc_pairs(spark, sf_dir).withColumnRenamed("doc_id", "asset_id")
    return index.rarity(p, index.hash_stats(p)).select(F.col("asset_id").alias("doc_id"), F.round("rarity", 6).alias("rarity"), "kept", "median_len")


@query(f"""WITH {DP}, {STATS}, a AS (SELECT len FROM st UNION ALL SELECT 0 FROM range(2097152 - (SELECT count(*) FROM st))), o AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS r FROM a)
    SELECT (SELECT count(*) FROM st) AS used, CAST(sum(len) AS BIGINT) AS postings, sum(len) / 2097152 AS mean_len, CAST(max(len) FILTER (WHERE r = 2076180) AS BIGINT) AS p99_len, max(len) AS max_len, CAST(sum(len) FILTER (WHERE r >= 2097152 - 20972) AS BIGINT) AS top_postings FROM o""")
def index_statistics(spark, sf_dir):
    return index.index_stats(index.hash_stats(doc_pairs(spark, sf_dir)), 1 << 21)


@query(f"""WITH {DP} SELECT hash FROM dp JOIN documents USING (doc_id) WHERE lang = 'en' INTERSECT SELECT hash FROM dp JOIN documents USING (doc_id) WHERE lang <> 'en'""")
def shared_hashes(spark, sf_dir):
    p = doc_pairs(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return index.shared_hashes(p, F.col("lang") == "en", F.col("lang") != "en")


@query(f"""WITH {DP} SELECT doc_id, count(*) AS postings FROM dp WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_id""")
def without_assets(spark, sf_dir):
    return index.without_assets(doc_pairs(spark, sf_dir), t(spark, sf_dir, "labels").where("quality = 0"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("postings"))


@query("""SELECT doc_id, 'own' AS origin, n_chars FROM documents UNION ALL SELECT item_id, 'items', length(text) FROM benchmark UNION ALL SELECT doc_id, 'copy ' || k, n_chars FROM documents, range(2) r(k)""")
def padding_union(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("own").alias("origin"), "n_chars")
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("items").alias("origin"), F.length("text").cast("long").alias("n_chars"))
    copies = d.crossJoin(F.broadcast(spark.range(2))).select("doc_id", F.concat(F.lit("copy "), F.col("id").cast("string")).alias("origin"), "n_chars")
    return compose.union_all([d, b, copies])


@query(f"""WITH {DP}, {DP.replace('dp', 'tr')} SELECT 'pairs' AS hashing, count(*) AS hashes, count(DISTINCT hash) AS kinds FROM dp UNION ALL SELECT 'triplets', count(*), count(DISTINCT tok || '|' || n1 || '|' || n2) FROM tr_l WHERE n2 IS NOT NULL""")
def hash_cost(spark, sf_dir):
    tok = index.tokens(t(spark, sf_dir, "documents"), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("pos")
    three = tok.select(F.concat_ws("|", "tok", F.lead("tok", 1).over(w), F.lead("tok", 2).over(w)).alias("hash"), F.lead("tok", 2).over(w).alias("last")).where("last is not null")
    rows = lambda df, name: df.agg(F.lit(name).alias("hashing"), F.count("*").alias("hashes"), F.count_distinct("hash").alias("kinds"))
    return rows(doc_pairs(spark, sf_dir), "pairs").unionByName(rows(three, "triplets"))


@query("""WITH g AS (SELECT l_partkey AS k, l_orderkey AS v, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS p FROM lineitem), z AS (SELECT k, (v - coalesce(p, 0)) * 2 AS d FROM g)
    SELECT k AS l_partkey, count(*) AS n, CAST(sum(CASE WHEN d < 128 THEN 1 WHEN d < 16384 THEN 2 WHEN d < 2097152 THEN 3 WHEN d < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM z GROUP BY k""")
def delta_sizes(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return index.delta_bytes(li, ["l_partkey"], "o", "l_orderkey")


# -- intervals -------------------------------------------------------------------


@query(f"""WITH {IV}, r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 5400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(a) AS start_s, max(b) AS end_s, count(*) AS parts FROM i GROUP BY user_id, island""")
def plays_islands(spark, sf_dir):
    return named(intervals.merged(events(spark, sf_dir), ["user_id"], 5400))


@query(f"""WITH {IV}, r AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT event_type, CAST(island AS BIGINT) AS island, min(a) AS start_s, max(b) AS end_s, count(*) AS parts FROM i GROUP BY event_type, island""")
def merged_blocks(spark, sf_dir):
    return named(intervals.merged(events(spark, sf_dir), ["event_type"], 0, touching=False))


#: Times between which coverage is asked for: January 2024.
LOW, HIGH = 1704067200, 1706745600
GAPS = f"""g AS (SELECT user_id, greatest(coalesce(max(b) OVER w, {LOW}), {LOW}) AS a, least(a, {HIGH}) AS b FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    UNION ALL SELECT user_id, greatest(max(b), {LOW}), {HIGH} FROM iv GROUP BY user_id), gaps AS (SELECT user_id, a, b FROM g WHERE b - a >= 7200)"""


@query(f"""WITH {IV}, {GAPS.replace('least(a,', 'least(iv.a,')} SELECT user_id, a AS start_s, b AS end_s FROM gaps""")
def gaps_uncovered(spark, sf_dir):
    return named(intervals.uncovered(events(spark, sf_dir), ["user_id"], LOW, HIGH, 7200))


@query(f"""WITH {IV}, {GAPS.replace('least(a,', 'least(iv.a,').replace('b - a >= 7200', 'b > a')}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, a) AS k FROM gaps) SELECT user_id, a AS start_s, b AS end_s FROM r WHERE k = 1""")
def longest_uncovered(spark, sf_dir):
    return named(intervals.longest_uncovered(events(spark, sf_dir), ["user_id"], LOW, HIGH))


CONSECUTIVE = "cs AS (SELECT user_id, a, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS b FROM iv), ci AS (SELECT * FROM cs WHERE b IS NOT NULL)"


@query(f"""WITH {IV}, {CONSECUTIVE} SELECT user_id, a AS start_s, b AS end_s FROM ci""")
def consecutive_starts(spark, sf_dir):
    return named(intervals.consecutive(events(spark, sf_dir), ["user_id"]))


@query(f"""WITH {IV}, {GAPS.replace('least(a,', 'least(iv.a,')}, {CONSECUTIVE} SELECT user_id, a AS start_s, b AS end_s FROM ci WHERE NOT EXISTS (SELECT 1 FROM gaps WHERE gaps.user_id = ci.user_id AND ci.a <= gaps.b AND gaps.a <= ci.b)""")
def clean_intervals(spark, sf_dir):
    e = events(spark, sf_dir)
    gaps = intervals.uncovered(e, ["user_id"], LOW, HIGH, 7200)
    return named(intervals.clean_intervals(intervals.consecutive(e, ["user_id"]), gaps, ["user_id"], 86400))


EXCLUSIVE = "CASE WHEN n = 1 THEN v[1] ELSE v[greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS BIGINT)))] + (v[greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS BIGINT))) + 1] - v[greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS BIGINT)))]) * ({p} * (n + 1) - greatest(1, least(n - 1, CAST(floor({p} * (n + 1)) AS BIGINT)))) END"
QUART = f"q AS (SELECT user_id, n, {EXCLUSIVE.format(p=0.25)} AS q1, {EXCLUSIVE.format(p=0.5)} AS median, {EXCLUSIVE.format(p=0.75)} AS q3 FROM (SELECT user_id, list(CAST(b - a AS DOUBLE) ORDER BY b - a) AS v, len(list(b - a)) AS n FROM ci GROUP BY user_id))"


@query(f"""WITH {IV}, {CONSECUTIVE}, {QUART} SELECT user_id, n, q1, median, q3 FROM q""")
def gap_quartiles(spark, sf_dir):
    c = intervals.consecutive(events(spark, sf_dir), ["user_id"]).withColumn("v", F.col("end") - F.col("start"))
    return intervals.quartiles(c, ["user_id"], "v").withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {IV}, {GAPS.replace('least(a,', 'least(iv.a,')}, {CONSECUTIVE}, {QUART}, r AS (SELECT gaps.user_id, gaps.a, gaps.b, count(e.event_id) AS records FROM gaps LEFT JOIN iv e ON e.user_id % 10 = gaps.user_id % 10 AND e.event_type = 'error' AND (e.a + e.b) / 2 >= gaps.a AND (e.a + e.b) / 2 < gaps.b GROUP BY ALL),
    x AS (SELECT r.*, CASE WHEN n >= 3 THEN greatest(1, round_even((b - a) / q3, 0)) END AS lo, CASE WHEN n >= 3 THEN greatest(1, round_even((b - a) / q1, 0)) END AS hi FROM r JOIN q USING (user_id))
    SELECT user_id, a AS start_s, b AS end_s, records, CAST(lo AS INTEGER) AS low, CAST(CASE WHEN records = 0 OR lo IS NULL THEN records ELSE least(greatest(records, lo), hi) END AS INTEGER) AS likely, CAST(hi AS INTEGER) AS high FROM x""")
def gap_estimate(spark, sf_dir):
    e = events(spark, sf_dir)
    gaps = intervals.uncovered(e, ["user_id"], LOW, HIGH, 7200).withColumnRenamed("user_id", "query_id")
    lists = e.where("event_type = 'error'").select((F.col("user_id") % 10).alias("list"), "start", "end")
    counted = plays.records_in_gaps(gaps.withColumn("list", F.col("query_id") % 10), lists, 86400.0, "list").withColumnRenamed("query_id", "user_id")
    q = gap_quartiles(spark, sf_dir)
    low, likely, high = intervals.estimate(F.col("end") - F.col("start"), F.col("q1"), F.col("q3"), F.col("n"), F.col("records"))
    return named(counted.join(q, "user_id").select("user_id", "start", "end", "records", low.alias("low"), likely.alias("likely"), high.alias("high")))


def two_kinds(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a, b


AB = "x AS (SELECT user_id, event_id AS a_id, a AS a0, b AS a1 FROM iv WHERE event_type = 'click'), y AS (SELECT user_id, event_id AS b_id, a AS b0, b AS b1 FROM iv WHERE event_type = 'view')"


@query(f"""WITH {IV}, {AB} SELECT a_id, b_id, least(a1, b1) - greatest(a0, b0) AS common FROM x JOIN y ON x.user_id = y.user_id AND a0 < b1 AND b0 < a1""")
def overlap_join(spark, sf_dir):
    a, b = two_kinds(spark, sf_dir)
    return intervals.overlap_join(a, b, ["user_id"], 36000).select("a_id", "b_id", intervals.shared(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("common"))


@query(f"""WITH {IV}, {AB} SELECT a_id FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.user_id = y.user_id AND a0 < b1 AND b0 < a1)""")
def unmatched_anti_join(spark, sf_dir):
    a, b = two_kinds(spark, sf_dir)
    return intervals.overlap_join(a, b, ["user_id"], 36000, how="left_anti").select("a_id")


@query(f"""WITH {IV}, {AB}, r AS (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY b0, b_id) AS k FROM x JOIN y ON x.user_id = y.user_id AND b0 <= a0 AND a1 <= b1) SELECT a_id, b_id FROM r WHERE k = 1""")
def containment_join(spark, sf_dir):
    a, b = two_kinds(spark, sf_dir)
    return intervals.containing_first(a, b, ["user_id"], 36000, [F.col("b_start"), F.col("b_id")]).select("a_id", "b_id")


@query(f"""WITH {IV}, {AB} SELECT a_id, b_id FROM x JOIN y ON x.user_id = y.user_id AND a0 < b1 AND b0 < a1 AND least(a1, b1) - greatest(a0, b0) >= 0.5 * least(a1 - a0, b1 - b0)""")
def same_passage_join(spark, sf_dir):
    a, b = two_kinds(spark, sf_dir)
    same = intervals.same_passage(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return intervals.overlap_join(a, b, ["user_id"], 36000, condition=same).select("a_id", "b_id")


@query(f"""WITH {IV}, {AB} SELECT a_id, b_id FROM x JOIN y ON x.user_id = y.user_id AND a0 < b1 AND b0 < a1 AND abs((a0 - (a1 - a0) / 2.0) - (b0 - (b1 - b0) / 2.0)) <= 3600""")
def same_recording_join(spark, sf_dir):
    a, b = two_kinds(spark, sf_dir)
    zero = lambda s: F.col(f"{s}_start") - (F.col(f"{s}_end") - F.col(f"{s}_start")) / 2
    return intervals.overlap_join(a, b, ["user_id"], 36000, condition=intervals.same_recording(zero("a"), zero("b"), 3600)).select("a_id", "b_id")


@query(f"""WITH {IV}, x AS (SELECT user_id, event_id AS id, a AS "at" FROM iv WHERE event_type = 'purchase'), y AS (SELECT user_id, a AS ref FROM iv WHERE event_type = 'error'),
    r AS (SELECT x.user_id, id, "at", ref, abs("at" - ref) AS distance, row_number() OVER (PARTITION BY id ORDER BY abs("at" - ref), ref) AS k FROM x JOIN y ON x.user_id = y.user_id AND abs("at" - ref) <= 43200)
    SELECT user_id, id, "at", ref, distance FROM r WHERE k = 1""")
def nearest_match(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("start").alias("at"))
    return align.nearest(left, e.where("event_type = 'error'").select("user_id", F.col("start").alias("ref")), ["user_id"], 43200)


@query(f"""WITH {IV} SELECT event_type, a // 36000 * 36000 AS from_s, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM iv GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type", (sc.window_of(F.col("start"), 36000) * 36000).alias("from_s")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(f"""WITH {IV}, d AS (SELECT event_id, user_id, a, count(*) OVER (PARTITION BY user_id ORDER BY a RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS run FROM iv), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, a, event_id) AS k FROM d) SELECT user_id, a AS start_s, run FROM r WHERE k = 1""")
def densest_runs(spark, sf_dir):
    e = events(spark, sf_dir)
    run = F.count("*").over(Window.partitionBy("user_id").orderBy("start").rangeBetween(0, 86400))
    best = e.withColumn("run", run).groupBy("user_id").agg(F.max(F.struct("run", (-F.col("start")).alias("s"))).alias("x"))
    return best.select("user_id", (-F.col("x.s")).alias("start_s"), F.col("x.run").alias("run"))


@query(f"""WITH RECURSIVE {IV}, o AS (SELECT *, CAST(length(event_type) AS BIGINT) AS asset_id, CAST(round(value * 100) AS INTEGER) AS hits, row_number() OVER (PARTITION BY user_id, length(event_type) ORDER BY round(value * 100) DESC, event_id) AS n FROM iv),
    w AS (SELECT user_id, asset_id, n, true AS kept, [{{'a': a, 'b': b}}] AS held FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.asset_id, o.n, len(list_filter(held, lambda x: o.a < x.b AND x.a < o.b)) = 0, CASE WHEN len(list_filter(held, lambda x: o.a < x.b AND x.a < o.b)) = 0 THEN list_append(held, {{'a': o.a, 'b': o.b}}) ELSE held END FROM w JOIN o ON o.user_id = w.user_id AND o.asset_id = w.asset_id AND o.n = w.n + 1)
    SELECT o.user_id AS query_id, o.asset_id, CAST(a AS DOUBLE) AS start_s, CAST(b AS DOUBLE) AS end_s, 1.0::DOUBLE AS speed, hits, CAST(event_id AS INTEGER) AS ord FROM o JOIN w USING (user_id, asset_id, n) WHERE kept""")
def nms_strongest(spark, sf_dir):
    """Greedy suppression: of overlapping events of a user and kind the one of greatest value stays."""
    e = events(spark, sf_dir)
    d = e.select(F.col("user_id").alias("query_id"), F.length("event_type").cast("long").alias("asset_id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(1.0).alias("speed"), F.round(F.col("value") * 100).cast("int").alias("hits"), F.col("event_id").cast("int").alias("ord"))
    return named(align.suppress(d))


@query(f"""WITH RECURSIVE {IV}, o AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS n FROM iv), w AS (SELECT user_id, n, a AS s, b AS e, 1 AS entry FROM o WHERE n = 1
    UNION ALL SELECT user_id, n, CASE WHEN near THEN s ELSE a END, CASE WHEN near THEN greatest(e, b) ELSE b END, entry + CASE WHEN near THEN 0 ELSE 1 END FROM (SELECT o.*, s, e, entry, least(e, b) - greatest(s, a) >= 0.5 * least(e - s, b - a) AS near FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))
    SELECT user_id, min(s) AS start_s, max(e) AS end_s FROM w GROUP BY user_id, entry""")
def entry_starts(spark, sf_dir):
    return named(plays.entry_starts(events(spark, sf_dir), "user_id"))


PLAYS = f"""{IV}, d AS (SELECT user_id AS query_id, CAST(length(event_type) AS BIGINT) AS asset_id, a, b, CAST(round(value * 10) AS BIGINT) AS hits, CASE WHEN value >= 100 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END AS rank FROM iv),
    e AS (SELECT *, max(b) OVER (PARTITION BY query_id, asset_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d WHERE rank >= 1),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 5400 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, asset_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS play_no FROM e)"""


def event_plays(spark, sf_dir):
    e = events(spark, sf_dir)
    rank = F.when(F.col("value") >= 100, 2).when(F.col("value") >= 20, 1).otherwise(0)
    d = e.select(F.col("user_id").alias("query_id"), F.length("event_type").cast("long").alias("asset_id"), "start", "end", F.lit(0).alias("track_start"), F.lit(1.0).alias("speed"), F.lit("turntable").alias("playback"), F.round(F.col("value") * 10).cast("long").alias("hits"), F.lit(1).alias("windows"), rank.alias("rank"))
    return plays.plays(d, 5400)


@query(f"""WITH {PLAYS} SELECT query_id, asset_id, CAST(play_no AS BIGINT) AS play_no, min(a) AS start_s, max(b) AS end_s, max(rank) AS rank, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS segments, CASE max(rank) WHEN 2 THEN 'confident' ELSE 'possible' END AS level FROM i GROUP BY ALL""")
def play_totals(spark, sf_dir):
    return named(event_plays(spark, sf_dir).select("query_id", "asset_id", "play_no", "start", "end", "rank", "hits", F.size("segments").cast("long").alias("segments"), "level"))


@query(f"""WITH {PLAYS}, s AS (SELECT query_id, asset_id, play_no, list((a, b) ORDER BY a, b) AS seg FROM i GROUP BY ALL) SELECT query_id, min(asset_id) AS asset_id, count(DISTINCT asset_id) AS assets FROM s GROUP BY query_id, seg""")
def same_audio_merge(spark, sf_dir):
    same = plays.same_audio(event_plays(spark, sf_dir))
    return same.select("query_id", "asset_id", (F.size("also") + 1).cast("long").alias("assets"))


@query(f"""WITH RECURSIVE {PLAYS}, p AS (SELECT query_id, asset_id * 100000 + CAST(play_no AS BIGINT) AS play, min(a) AS a, max(b) AS b, arg_max(a, (hits, -a)) AS zero FROM i GROUP BY query_id, asset_id, play_no), q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, play) AS n FROM p),
    l AS (SELECT x.query_id, x.n AS x, y.n AS y FROM q x JOIN q y ON x.query_id = y.query_id AND x.n <> y.n AND least(x.b, y.b) - greatest(x.a, y.a) >= 0.5 * least(x.b - x.a, y.b - y.a) AND abs(x.zero - y.zero) <= 5), c AS (SELECT query_id, n, n AS first FROM q UNION SELECT l.query_id, l.y, c.first FROM c JOIN l ON l.query_id = c.query_id AND l.x = c.n WHERE c.first < l.y),
    f AS (SELECT query_id, n, min(first) AS first FROM c GROUP BY ALL) SELECT query_id, play, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS entry FROM f JOIN q USING (query_id, n)""")
def tracklist_entries(spark, sf_dir):
    p = event_plays(spark, sf_dir).withColumn("play", F.col("asset_id") * 100_000 + F.col("play_no")).withColumn("track", F.lit(None).cast("string"))
    return plays.entries(p)


@query(f"""WITH {IV}, r AS (SELECT user_id AS query_id, a AS start_s, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS n, a - {LOW} AS s FROM iv) SELECT query_id, start_s, CAST(max(s * 75 - n) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS BIGINT) AS frame FROM r""")
def cue_sheet_times(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("entry"), (F.col("start") - LOW).alias("start"))
    return plays.cue_times(e).select("query_id", (F.col("start") + LOW).alias("start_s"), "frame")


# -- joins -----------------------------------------------------------------------


@query("""WITH f AS (SELECT c_custkey AS k, c_nationkey AS size, c_custkey % 7 = 3 AS ign FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 1 THEN c_nationkey + 1 ELSE c_nationkey END AS size FROM customer WHERE c_custkey % 3 <> 0)
    SELECT 'p' || coalesce(f.k, s.k) AS path, CASE WHEN f.k IS NULL THEN 'orphan' WHEN s.k IS NULL AND ign THEN 'skipped' WHEN ign THEN 'ignored' WHEN s.k IS NULL THEN 'unindexed' WHEN f.size = s.size THEN 'current' ELSE 'stale' END AS state FROM f FULL JOIN s ON f.k = s.k""")
def survey_full_outer(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    path = F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path")
    files = c.where("c_custkey % 5 <> 0").select(path, F.col("c_nationkey").alias("size"), F.lit(0).alias("modified"), F.when(F.col("c_custkey") % 7 == 3, "ignored").alias("reason"))
    stored = c.where("c_custkey % 3 <> 0").select(path, F.when(F.col("c_custkey") % 11 == 1, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("size"), F.lit(0).alias("modified"))
    return library.survey(files, stored)


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, l_quantity > 25 AS same FROM lineitem WHERE l_linenumber = 1), v AS (SELECT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y, min(l_returnflag = 'R') AS same FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
    SELECT a, b, coalesce(v.same, p.same) AS same FROM p LEFT JOIN v ON least(a, b) = x AND greatest(a, b) = y""")
def verdict_override(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    pairs = li.where("l_linenumber = 1").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_quantity") > 25).alias("same"))
    verdicts = li.where("l_linenumber = 2").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_returnflag") == "R").alias("same"))
    return graph.with_verdicts(pairs, verdicts)


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def same_tagged_join(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size", sc.normalise(F.concat_ws(" ", "p_brand", "p_name")).alias("track"))
    a, b = p.select(F.col("p_partkey").alias("a"), "p_size", "track"), p.select(F.col("p_partkey").alias("b"), "p_size", "track")
    return a.join(b, ["track", "p_size"]).where("a < b").select("a", "b")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, p_brand ORDER BY p_name, p_partkey) AS n FROM part WHERE p_partkey % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, p_brand ORDER BY p_name, p_partkey) AS n FROM part WHERE p_partkey % 2 = 1)
    SELECT count(*) AS matched FROM a JOIN b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.n = b.n""")
def library_map_sizes(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_type").alias("seconds"), F.col("p_size").alias("digest"), F.col("p_brand").alias("size"), F.format_string("%010d", "p_partkey").alias("path"), "p_partkey")
    rank = F.row_number().over(Window.partitionBy("seconds", "digest", "size").orderBy("path"))
    x, y = (p.where(F.col("p_partkey") % 2 == k).withColumn("n", rank).select("seconds", "digest", "size", "n") for k in (0, 1))
    return x.join(y, ["seconds", "digest", "size", "n"]).agg(F.count("*").alias("matched"))


@query("""WITH p AS (SELECT p_type AS t, p_size AS d, p_brand AS z, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS path, p_partkey % 2 AS side FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY side, t, d, z ORDER BY path) AS n FROM p),
    m AS (SELECT x.path AS a_path, y.path AS b_path FROM r x JOIN r y ON x.t = y.t AND x.d = y.d AND x.z = y.z AND x.n = y.n AND x.side = 0 AND y.side = 1), l AS (SELECT *, row_number() OVER (PARTITION BY side, t, d ORDER BY path) AS n FROM p WHERE path NOT IN (SELECT a_path FROM m) AND path NOT IN (SELECT b_path FROM m))
    SELECT a_path, b_path FROM m UNION ALL SELECT x.path, y.path FROM l x JOIN l y ON x.t = y.t AND x.d = y.d AND x.n = y.n AND x.side = 0 AND y.side = 1""")
def library_map(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_type").alias("seconds"), F.col("p_size").alias("digest"), F.col("p_brand").alias("size"), F.format_string("%010d", "p_partkey").alias("path"), "p_partkey")
    return library.library_map(p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 2 = 1").drop("p_partkey"))


HASHES = "h AS (SELECT doc_id, len(text) % 200 AS l, n_chars % 120 - 60 AS b, doc_id % 60 + 1 AS f, (len(text) % 200) * 8192 + (n_chars % 120 - 60 + 63) * 64 + doc_id % 60 + 1 AS hash FROM documents)"


def doc_hashes(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    level, dbin, dframe = (F.length("text") % 200).cast("int"), (F.col("n_chars") % 120 - 60).cast("int"), (F.col("doc_id") % 60 + 1).cast("int")
    return d.select("doc_id", sc.pair_hash(level, dbin, dframe).alias("hash"))


@query(f"""WITH {HASHES} SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON abs(x.l - y.l) <= 1 AND abs(x.b - y.b) <= 1 AND abs(x.f - y.f) <= 1 AND x.doc_id < y.doc_id""")
def near_hash_join(spark, sf_dir):
    h = doc_hashes(spark, sf_dir)
    a = h.select(F.col("doc_id").alias("a"), F.explode(sc.near_hashes(F.col("hash"))).alias("hash"))
    return a.join(h.withColumnRenamed("doc_id", "b"), "hash").where("a < b").select("a", "b")


@query(f"""WITH {HASHES} SELECT doc_id, CAST(hash AS INTEGER) AS hash, CAST(l AS INTEGER) AS level, CAST(b AS INTEGER) AS dbin, CAST(f AS INTEGER) AS dframe FROM h""")
def pair_hash_layout(spark, sf_dir):
    h = doc_hashes(spark, sf_dir)
    level, dbin, dframe = sc.pair_parts(F.col("hash"))
    return h.select("doc_id", "hash", level.alias("level"), dbin.alias("dbin"), dframe.alias("dframe"))


@query(f"""WITH {DP}, f AS (SELECT doc_id, hash FROM dp GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40), x AS (SELECT dp.doc_id, dp.hash, pos FROM dp JOIN f ON dp.doc_id = f.doc_id AND dp.hash = f.hash)
    SELECT p.doc_id, p.pos // 64 AS cell, (q.pos - p.pos) // 2 * 2 AS lag, count(*) AS hits FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.hash = q.hash AND q.pos - p.pos >= 16 GROUP BY ALL""")
def self_repeats(spark, sf_dir):
    return repeats.repeat_hits(doc_pairs(spark, sf_dir).withColumnRenamed("pos", "at"), ["doc_id"], 16, 40, 64, 2)


@query(f"""WITH RECURSIVE rh AS (WITH {DP}, f AS (SELECT doc_id, hash FROM dp GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40), x AS (SELECT dp.doc_id, dp.hash, pos FROM dp JOIN f ON dp.doc_id = f.doc_id AND dp.hash = f.hash)
    SELECT p.doc_id, p.pos // 64 AS cell, (q.pos - p.pos) // 2 * 2 AS lag, count(*) AS hits FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.hash = q.hash AND q.pos - p.pos >= 16 GROUP BY ALL), g AS (SELECT doc_id, cell AS x, CAST(floor((cell * 64 + 32 + lag) / 64) AS BIGINT) AS y FROM rh WHERE hits >= 10), l AS (SELECT doc_id, x, y FROM g WHERE x <> y UNION SELECT doc_id, y, x FROM g WHERE x <> y),
    c AS (SELECT doc_id, x AS cell, x AS least FROM l UNION SELECT l.doc_id, l.y, c.least FROM c JOIN l ON l.doc_id = c.doc_id AND l.x = c.cell WHERE c.least < l.y) SELECT doc_id, cell, doc_id || '/' || lpad(CAST(min(least) AS VARCHAR), 12, '0') AS "group" FROM c GROUP BY doc_id, cell""")
def repeat_groups(spark, sf_dir):
    hits = self_repeats(spark, sf_dir)
    return repeats.repeat_groups(hits, ["doc_id"], 10, 64)


#: Equal documents are one; the fullest lists of what is left.
ALONE = f"""{DP}, sig AS (SELECT doc_id, string_agg(hash || '@' || pos, ' ' ORDER BY pos, hash) AS s FROM dp GROUP BY 1), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sig), rp AS (SELECT dp.* FROM dp JOIN cls USING (doc_id) WHERE rep = dp.doc_id),
    st AS (SELECT hash, count(*) AS len, min(doc_id * 1000000 + pos) AS head FROM rp GROUP BY hash), {CUT}, li AS (SELECT hash, head // 1000000 AS c, head % 1000000 AS cp, coalesce(len > threshold, false) AS is_full FROM st, cut WHERE len > 1), ok AS (SELECT rp.* FROM rp JOIN li USING (hash) WHERE NOT is_full)"""
MATCHES = f"""{ALONE}, v AS (SELECT p.doc_id AS a, q.doc_id AS b, q.pos - p.pos AS o, count(*) AS n FROM ok p JOIN ok q ON p.hash = q.hash AND p.doc_id < q.doc_id GROUP BY ALL UNION ALL SELECT c, rp.doc_id, pos - cp, count(*) FROM rp JOIN li USING (hash) WHERE is_full AND c < rp.doc_id GROUP BY ALL),
    s AS (SELECT doc_id, count(*) AS n FROM rp GROUP BY 1),
    cand AS (SELECT DISTINCT a, b FROM (SELECT a, b, o, sum(n) AS met FROM v GROUP BY a, b, o) JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE met >= 3 AND met >= 0.25 * 0.2 * least(x.n, y.n)), w AS (SELECT a, b, q.pos - p.pos AS "offset", count(*) AS hits FROM cand JOIN rp p ON p.doc_id = a JOIN rp q ON q.doc_id = b AND q.hash = p.hash GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hits DESC, "offset") AS k FROM w), m AS (SELECT a, b, "offset", hits, hits / least(x.n, y.n) AS share FROM r JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE k = 1 AND hits / least(x.n, y.n) >= 0.2)"""


@query(f"""WITH {ALONE} SELECT doc_id, rep AS representative FROM cls""")
def equal_items(spark, sf_dir):
    return repeats.equal_items(doc_pairs(spark, sf_dir), "doc_id")


@query(f"""WITH {MATCHES} SELECT a, b, "offset", hits, share FROM m""")
def self_matches(spark, sf_dir):
    return repeats.self_matches(doc_pairs(spark, sf_dir), "doc_id")[0]


@query(f"""WITH RECURSIVE {MATCHES}, e AS (SELECT a, b FROM m WHERE share >= 0.8 UNION SELECT rep, doc_id FROM cls WHERE rep <> doc_id), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT a AS node, a AS component FROM l UNION SELECT l.b, c.component FROM c JOIN l ON l.a = c.node WHERE c.component < l.b)
    SELECT node, min(component) AS component FROM c GROUP BY node""")
def duplicate_clusters(spark, sf_dir):
    return compose.duplicate_clusters(doc_pairs(spark, sf_dir), "doc_id")[1]


# -- graph -----------------------------------------------------------------------


#: Priorities of the orders whose links make each tier: all orders together.
PRIORITIES = (["1-URGENT"], ["2-HIGH"], ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


def order_links(spark, sf_dir):
    """Customers and pairs of neighbouring orders."""
    c = t(spark, sf_dir, "orders")
    link = lambda *status: c.where(F.col("o_orderpriority").isin(*status)).select(F.col("o_custkey").alias("a"), (-F.expr("o_orderkey div 2")).alias("b"))
    return tuple(link(*p) for p in PRIORITIES)


def LINKS(k):  # noqa: N802
    return f"SELECT o_custkey AS a, -(o_orderkey // 2) AS b FROM orders WHERE o_orderpriority IN ({', '.join(repr(p) for p in PRIORITIES[k])})"


def _tier(n, links):
    return f"""l{n} AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})), c{n} AS (SELECT a AS node, least(a, b) AS family FROM l{n} WHERE a <> b UNION SELECT l.b, c.family FROM c{n} c JOIN l{n} l ON l.a = c.node WHERE c.family < l.b)"""


@query(f"""WITH RECURSIVE {_tier(1, LINKS(0))}, {_tier(2, LINKS(0) + ' UNION ALL ' + LINKS(1))}, {_tier(3, LINKS(0) + ' UNION ALL ' + LINKS(1) + ' UNION ALL ' + LINKS(2))}
    SELECT 'recording' AS tier, node, min(family) AS family FROM c1 GROUP BY node UNION ALL SELECT 'title', node, min(family) FROM c2 GROUP BY node UNION ALL SELECT 'relation', node, min(family) FROM c3 GROUP BY node""")
def families(spark, sf_dir):
    return graph.families(*order_links(spark, sf_dir))


@query(f"""WITH RECURSIVE l AS (SELECT a, b FROM ({LINKS(0)}) UNION SELECT b, a FROM ({LINKS(0)})), f AS (SELECT c_custkey AS node, 0 AS round FROM customer WHERE c_nationkey = 3 UNION SELECT l.b, round + 1 FROM f JOIN l ON l.a = f.node WHERE round < 40) SELECT CAST(node AS BIGINT) AS node, min(round) AS round FROM f GROUP BY node""")
def frontier_clusters(spark, sf_dir):
    seeds = t(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("node"))
    return graph.frontier(seeds, order_links(spark, sf_dir)[0], 40)


@query()
def must_not_link(spark, sf_dir):
    """Components of document links, less the links cut to keep documents of other languages apart."""
    m = self_matches(spark, sf_dir).where("share >= 0.5")
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = graph.connected_components(m, "a", "b").join(d, F.col("node") == F.col("doc_id"))
    x, y = parts.select("component", F.col("node").alias("a"), F.col("lang").alias("la")), parts.select("component", F.col("node").alias("b"), F.col("lang").alias("lb"))
    apart = x.join(y, "component").where("a < b and la <> lb").select("a", "b")
    return graph.separated(m.select("a", "b", F.col("share").alias("density")), apart)[0]


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS density FROM lineitem), m AS (SELECT density AS md FROM (SELECT density, row_number() OVER (ORDER BY density) - 1 AS r, count(*) OVER () AS n FROM p) WHERE r = n // 2) SELECT l_orderkey, l_linenumber, density FROM p, m WHERE density < 0.1 * md""")
def sparse_joins(spark, sf_dir):
    return graph.sparse(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("density")))


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, CAST(l_quantity AS BIGINT) AS hits FROM lineitem WHERE l_quantity >= 30), c AS (SELECT a, b, hits, CASE WHEN a % 2 = 0 THEN a - a % 10 ELSE a END AS ca, CASE WHEN b % 2 = 0 THEN b - b % 10 ELSE b END AS cb FROM p),
    r AS (SELECT least(ca, cb) AS x, greatest(ca, cb) AS y, hits, a, b, row_number() OVER (PARTITION BY least(ca, cb), greatest(ca, cb) ORDER BY hits DESC, a, b) AS k FROM c WHERE ca <> cb) SELECT x AS ca, y AS cb, hits, a, b FROM r WHERE k = 1""")
def related_recordings(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").cast("long").alias("hits"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().where("node % 2 = 0")
    return graph.related(pairs, nodes.withColumn("component", F.col("node") - F.col("node") % 10))


# -- scores ----------------------------------------------------------------------


@query("""WITH r AS (SELECT l_shipdate, l_returnflag, l_linestatus, l_discount >= 0.03 AS found, CAST(l_tax >= 0.07 AS BIGINT) AS wrong, l_extendedprice - l_quantity * 1000 AS error FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) AS queries, count(*) FILTER (WHERE found) AS found, round(avg(CAST(found AS INTEGER)), 6) AS recall, CAST(sum(wrong) AS BIGINT) AS wrong, round(avg(abs(error)) FILTER (WHERE found), 4) AS mean_error, round(max(abs(error)) FILTER (WHERE found), 4) AS max_error FROM r GROUP BY ALL""")
def sweep_rows(spark, sf_dir):
    r = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.03).alias("found"), (F.col("l_tax") >= 0.07).cast("long").alias("wrong"), (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("error"))
    out = scoring.sweep_rows(r, ["l_returnflag", "l_linestatus"])
    return out.withColumns({"recall": F.round("recall", 6), "mean_error": F.round("mean_error", 4), "max_error": F.round("max_error", 4)})


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 20 THEN 1 ELSE 0 END AS rank, CAST(l_tax >= 0.07 AS BIGINT) AS wrong FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) AS queries, count(*) FILTER (WHERE rank = 2) AS confident, count(*) FILTER (WHERE rank = 1) AS possible, CAST(sum(wrong) AS BIGINT) AS wrong FROM r GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def condition_rollup(spark, sf_dir):
    rank = F.when(F.col("l_quantity") >= 40, 2).when(F.col("l_quantity") >= 20, 1).otherwise(0)
    r = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", rank.alias("rank"), (F.col("l_tax") >= 0.07).cast("long").alias("wrong"))
    return scoring.condition_rows(r, "l_returnflag", "l_linestatus")


@query("""WITH r AS (SELECT l_returnflag <> 'R' AS ok, l_orderkey % 400 + CASE WHEN l_returnflag <> 'R' THEN 15 ELSE 0 END AS hits FROM lineitem)
    SELECT min(hits) FILTER (WHERE ok) AS weakest_right, max(hits) FILTER (WHERE NOT ok) AS strongest_false, min(hits) FILTER (WHERE ok) / max(hits) FILTER (WHERE NOT ok) AS margin, count(*) FILTER (WHERE ok AND hits >= 30) AS right_kept, count(*) FILTER (WHERE NOT ok AND hits >= 30) AS false_kept FROM r""")
def calibration_margin(spark, sf_dir):
    right = F.col("l_returnflag") != "R"
    return scoring.calibration(t(spark, sf_dir, "lineitem").select(right.alias("right"), (F.col("l_orderkey") % 400 + F.when(right, 15).otherwise(0)).alias("hits")))


@query("""WITH f AS (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY 1) SELECT round(sum(k) / sum(n), 9) AS item_rate, round(avg(k / n), 9) AS family_rate, count(*) AS families FROM f""")
def family_rates(spark, sf_dir):
    r = scoring.family_rates(t(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_discount") > 0.05), "l_suppkey", "hit")
    return r.select(F.round("item_rate", 9).alias("item_rate"), F.round("family_rate", 9).alias("family_rate"), "families")


def _mod(x):
    return f"({x} * 48271) % 2147483647"


@query(f"""WITH u AS (SELECT l_suppkey AS unit, row_number() OVER (ORDER BY l_suppkey) - 1 AS unit_no, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM lineitem GROUP BY l_suppkey), m AS (SELECT count(*) AS units FROM u),
    s AS (SELECT d.draw, ({_mod(_mod('((d.draw * 7919 + s.slot * 104729 + 12345) % 2147483647)'))}) % units AS unit_no FROM m, range(2000) d(draw), range(units) s(slot)),
    r AS (SELECT draw, sum(k) / sum(n) AS rate FROM s JOIN u USING (unit_no) GROUP BY draw), v AS (SELECT list(rate ORDER BY rate) AS v FROM r)
    SELECT round(v[50], 9) AS low, round(v[1950], 9) AS high, CAST(len(v) AS INTEGER) AS draws FROM v""")
def bootstrap_ci(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum((F.col("l_discount") > 0.05).cast("long")).alias("k"))
    units = li.withColumn("unit_no", F.row_number().over(Window.orderBy("l_suppkey")) - 1)  # as many rows as units
    b = scoring.bootstrap(units)
    return b.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "draws")


def truth_sets(spark, sf_dir):
    """Orders of a customer as a set's tracks, lines of its orders as detections; days since 1990."""
    o = t(spark, sf_dir, "orders")
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date"))
    truth = o.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("position"), (day(F.col("o_orderdate")) * 100).cast("double").alias("start_s"), F.array((F.col("o_orderkey") % 50).cast("long")).alias("references"))
    li = t(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = (day(F.col("l_shipdate")) * 100).cast("double")
    det = li.select(F.col("o_custkey").alias("set_id"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("det"), (F.col("l_partkey") % 50).cast("long").alias("asset_id"), start.alias("start"), (start + F.col("l_quantity") * 10).alias("end"), F.when(F.col("l_tax") >= 0.04, 2).when(F.col("l_tax") >= 0.02, 1).otherwise(0).alias("rank"), F.col("l_quantity").cast("long").alias("hits"))
    clusters = spark.range(50).select(F.col("id").alias("asset_id"), (F.col("id") % 25).alias("cluster"))
    return truth, det, clusters


TRUTH = """o AS (SELECT o_custkey AS set_id, o_orderkey AS position, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 100.0::DOUBLE AS s, o_orderkey % 50 % 25 AS c FROM orders),
    sl AS (SELECT *, s - 90 AS a, coalesce(lead(s) OVER (PARTITION BY set_id ORDER BY s, position), 1e12) + 90 AS b FROM o),
    d AS (SELECT o_custkey AS set_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS det, l_partkey % 50 % 25 AS c, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 100.0::DOUBLE AS a, l_quantity, CASE WHEN l_tax >= 0.04 THEN 2 WHEN l_tax >= 0.02 THEN 1 ELSE 0 END AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    cr AS (SELECT DISTINCT sl.set_id, position, det, rank FROM sl JOIN d ON sl.set_id = d.set_id AND sl.c = d.c AND sl.a < d.a + l_quantity * 10 AND d.a < sl.b)"""


@query(f"""WITH {TRUTH}, tr AS (SELECT o.set_id, o.position, max(rank) AS rank FROM o LEFT JOIN cr ON o.set_id = cr.set_id AND o.position = cr.position GROUP BY ALL), w AS (SELECT set_id, count(*) AS wrong FROM d WHERE rank = 2 AND det NOT IN (SELECT det FROM cr) GROUP BY 1)
    SELECT tr.set_id, count(*) AS referenced, count(*) FILTER (WHERE rank = 2) AS identified, count(*) FILTER (WHERE rank = 1) AS possible, coalesce(max(wrong), 0) AS wrong FROM tr LEFT JOIN w ON w.set_id = tr.set_id GROUP BY tr.set_id""")
def set_score(spark, sf_dir):
    truth, det, clusters = truth_sets(spark, sf_dir)
    return scoring.set_score(truth, det, scoring.credited(truth, det, clusters, width=20000.0))


@query(f"""WITH {TRUTH}, r AS (SELECT set_id, det, CAST(l_quantity AS BIGINT) AS hits, row_number() OVER (PARTITION BY set_id ORDER BY l_quantity DESC, det) AS place FROM d WHERE det NOT IN (SELECT det FROM cr)) SELECT set_id, det, hits, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def top_false(spark, sf_dir):
    truth, det, clusters = truth_sets(spark, sf_dir)
    return scoring.top_false(det, scoring.credited(truth, det, clusters, width=20000.0)).select("set_id", "det", "hits", "place")


@query(f"""WITH {IV}, tr AS (SELECT user_id % 20 AS set_id, (a - {LOW}) // 60 AS a, (b - {LOW}) // 60 AS b, event_type AS track, value < 60 AS indexed FROM iv WHERE event_type IN ('click', 'view', 'error')),
    lb AS (SELECT user_id % 20 AS set_id, (a - {LOW}) // 60 AS a, (b - {LOW}) // 60 AS b, CASE WHEN event_type = 'signup' THEN 'click' ELSE 'view' END AS track, CASE WHEN value >= 50 THEN 2 ELSE 1 END AS rank FROM iv WHERE event_type IN ('signup', 'purchase')),
    s AS (SELECT i.set_id, r.s FROM range(20) i(set_id), range(0, 43200) r(s)), p AS (SELECT s.set_id, s.s, max(CAST(indexed AS INTEGER)) AS ix FROM s JOIN tr ON tr.set_id = s.set_id AND s.s * 2 + 1 >= a * 2 AND s.s * 2 + 1 < b * 2 GROUP BY ALL),
    l AS (SELECT s.set_id, s.s, lb.track, rank, EXISTS (SELECT 1 FROM tr WHERE tr.set_id = s.set_id AND tr.track = lb.track AND s.s * 2 + 1 >= tr.a * 2 AND s.s * 2 + 1 < tr.b * 2) AS ok FROM s JOIN lb ON lb.set_id = s.set_id AND s.s * 2 + 1 >= lb.a * 2 AND s.s * 2 + 1 <= lb.b * 2),
    g AS (SELECT set_id, s, bool_or(NOT ok AND rank = 2) AS wrong, max(rank) FILTER (WHERE ok) AS rank FROM l GROUP BY ALL)
    SELECT s.set_id, CASE WHEN coalesce(wrong, false) AND coalesce(ix, 0) = 1 THEN 'mislabelled' WHEN coalesce(wrong, false) THEN 'mislabelled_unindexed' WHEN coalesce(ix, 0) = 0 THEN 'silent' WHEN rank = 2 THEN 'correct' WHEN rank = 1 THEN 'possible' ELSE 'unlabelled' END AS class, count(*) AS seconds
    FROM s LEFT JOIN p ON p.set_id = s.set_id AND p.s = s.s LEFT JOIN g ON g.set_id = s.set_id AND g.s = s.s GROUP BY ALL""")
def seconds_score(spark, sf_dir):
    e = events(spark, sf_dir)
    minute = lambda c: F.expr(f"({c} - {LOW}) div 60")
    base = e.select((F.col("user_id") % 20).alias("set_id"), minute("start").alias("start"), minute("end").alias("end"), "event_type", "value")
    truth = base.where("event_type in ('click', 'view', 'error')").select("set_id", "start", "end", F.col("event_type").alias("track"), (F.col("value") < 60).alias("indexed"))
    labels = base.where("event_type in ('signup', 'purchase')").select("set_id", "start", "end", F.when(F.col("event_type") == "signup", "click").otherwise("view").alias("track"), F.when(F.col("value") >= 50, 2).otherwise(1).alias("rank"))
    seconds = spark.range(20).select(F.col("id").alias("set_id")).crossJoin(spark.range(0, 43200).select(F.col("id").alias("s")))
    return scoring.seconds_classes(seconds, truth, labels).groupBy("set_id", "class").agg(F.count("*").alias("seconds"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey AS i, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey END AS i, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 4)
    SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.i <> b.i THEN 'incomparable' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def regress_diff(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 10 <> 4").withColumns({"o_custkey": F.when(F.col("o_orderkey") % 13 == 0, F.lit(-1)).otherwise(F.col("o_custkey")), "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return scoring.sweep_diff(o.where("o_orderkey % 10 <> 3"), new, "o_orderkey", "o_custkey", ["o_orderstatus"])


@query(f"""WITH RECURSIVE {IV}, e AS (SELECT user_id AS set_id, CAST(length(event_type) AS BIGINT) AS asset_id, event_id AS no, a, b FROM iv), old AS (SELECT *, row_number() OVER (PARTITION BY set_id, asset_id ORDER BY a, no) AS n FROM e WHERE no % 2 = 0),
    new AS (SELECT set_id, asset_id, list({{'no': no, 'a': a, 'b': b}} ORDER BY no) AS free FROM e WHERE no % 2 = 1 GROUP BY ALL), s AS (SELECT old.*, coalesce(free, []) AS free FROM old LEFT JOIN new ON new.set_id = old.set_id AND new.asset_id = old.asset_id),
    w AS (SELECT set_id, asset_id, n, no, list_min(list_transform(list_filter(free, lambda x: least(x.b, b) > greatest(x.a, a)), lambda x: {{'c': greatest(x.a, a) - least(x.b, b), 'no': x.no}})).no AS met, free FROM s WHERE n = 1
    UNION ALL SELECT o.set_id, o.asset_id, o.n, o.no, list_min(list_transform(list_filter(w.free, lambda x: x.no IS DISTINCT FROM w.met AND least(x.b, o.b) > greatest(x.a, o.a)), lambda x: {{'c': greatest(x.a, o.a) - least(x.b, o.b), 'no': x.no}})).no, list_filter(w.free, lambda x: x.no IS DISTINCT FROM w.met) FROM w JOIN old o ON o.set_id = w.set_id AND o.asset_id = w.asset_id AND o.n = w.n + 1)
    SELECT set_id, asset_id, no AS old_no, met AS new_no FROM w UNION ALL SELECT set_id, asset_id, NULL, no FROM e WHERE no % 2 = 1 AND no NOT IN (SELECT met FROM w WHERE met IS NOT NULL)""")
def scan_diff(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("set_id"), F.length("event_type").cast("long").alias("asset_id"), F.col("event_id").alias("no"), "start", "end")
    return scoring.scan_diff(e.where("no % 2 = 0"), e.where("no % 2 = 1"))


@query("""SELECT l_returnflag, l_shipdate >= TIMESTAMP '1998-01-01' AS late, count(*) AS available, count(*) FILTER (WHERE l_discount > 0.02) AS kept, round(avg(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END), 9) AS share FROM lineitem GROUP BY ALL""")
def loss_attribution(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("late"), (F.col("l_discount") > 0.02).alias("kept"))
    return scoring.loss_rows(li, ["l_returnflag", "late"]).withColumn("share", F.round("share", 9))


@query("""WITH r AS (SELECT l_quantity > 5 AS a, l_discount > 0.01 AS b, CASE l_linenumber % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'near' WHEN 2 THEN 'far' END AS p, l_orderkey % 12 AS k FROM lineitem)
    SELECT CASE WHEN NOT a AND NOT b THEN 'both gone' WHEN NOT a THEN 'anchor gone' WHEN NOT b THEN 'target gone' WHEN p = 'same' THEN 'kept' WHEN p = 'near' THEN 'near' WHEN p = 'far' THEN 'value changed' WHEN k = 0 THEN 'outside zone' WHEN k <= 2 THEN 'kept' WHEN k = 3 THEN 'displaced 3' WHEN k <= 5 THEN 'displaced 4-5' WHEN k <= 8 THEN 'displaced 6-8' ELSE 'displaced later' END AS fate, count(*) AS pairs FROM r GROUP BY 1""")
def pair_loss_split(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    rank = F.nullif(F.col("l_orderkey") % 12, F.lit(0))
    fate = scoring.pair_fate(F.col("l_quantity") > 5, F.col("l_discount") > 0.01, F.when(n == 0, "same").when(n == 1, "near").when(n == 2, "far"), rank)
    return t(spark, sf_dir, "lineitem").groupBy(fate.alias("fate")).agg(F.count("*").alias("pairs"))


@query("""WITH r AS (SELECT l_discount * 10 AS c, l_quantity - 25 AS d, l_tax > 0.01 AS k, l_returnflag = 'A' AS e FROM lineitem)
    SELECT CASE WHEN c >= 0.5 THEN 'supported' WHEN d < -10 AND e THEN 'killed' WHEN NOT k THEN 'unobservable' WHEN d < -10 THEN 'contradicted' WHEN d > 3 THEN 'masked' WHEN c < 0.2 THEN 'contradicted' ELSE 'unobservable' END AS state, count(*) AS patches FROM r GROUP BY 1""")
def version_patches(spark, sf_dir):
    state = scoring.patch_state(F.col("l_discount") * 10, F.col("l_quantity") - 25, F.col("l_tax") > 0.01, F.col("l_returnflag") == "A")
    return t(spark, sf_dir, "lineitem").groupBy(state.alias("state")).agg(F.count("*").alias("patches"))


@query("""WITH a AS (SELECT conv_id AS q, conv_id * 100 + turn AS seq, text, CASE WHEN turn % 5 = 4 THEN conv_id * 100 + turn - 1 END AS undoes FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY seq DESC) AS k FROM a WHERE undoes IS NULL AND seq NOT IN (SELECT undoes FROM a WHERE undoes IS NOT NULL))
    SELECT q AS question, seq, text AS answer FROM l WHERE k = 1""")
def answers_fold(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 100 + F.col("turn")
    return scoring.latest_answers(c.select(F.col("conv_id").alias("question"), seq.alias("seq"), F.col("text").alias("answer"), F.when(F.col("turn") % 5 == 4, seq - 1).alias("undoes")))


# -- fits ------------------------------------------------------------------------


@query("""SELECT l_suppkey, round((sum(l_quantity * l_partkey * l_discount) - sum(l_quantity * l_partkey) * sum(l_quantity * l_discount) / sum(l_quantity)) / (sum(l_quantity * l_partkey * l_partkey) - sum(l_quantity * l_partkey) * sum(l_quantity * l_partkey) / sum(l_quantity)), 9) AS slope,
    round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS mean, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS key_locked FROM lineitem GROUP BY 1""")
def weighted_fits(spark, sf_dir):
    x, y, w = F.col("l_partkey").cast("double"), F.col("l_discount"), F.col("l_quantity")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(fits.weighted_slope(x, y, w), 9).alias("slope"), F.round(fits.weighted_mean(y, w), 9).alias("mean"), fits.majority(F.col("l_returnflag") == "R", w).alias("key_locked"))


@query(f"""WITH {IV}, p AS (SELECT user_id, CAST(a AS DOUBLE) AS x, value AS y FROM iv WHERE event_type = 'click'), s AS (SELECT p.user_id, (q.y - p.y) / (q.x - p.x) AS k FROM p JOIN p q ON p.user_id = q.user_id AND p.x < q.x) SELECT user_id, round(quantile_cont(k, 0.5), 12) AS slope, count(*) AS pairs FROM s GROUP BY 1""")
def theil_sen_slope(spark, sf_dir):
    s = fits.theil_sen(events(spark, sf_dir).where("event_type = 'click'"), ["user_id"], "start", "value")
    return s.withColumn("slope", F.round("slope", 12))


@query("""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), l AS (SELECT a.vec_id, g.lag, corr(a.v, b.v) AS c FROM c a, range(-8, 9) g(lag), c b WHERE b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 AND b.i = a.i + g.lag GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, lag) AS k FROM l) SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(c, 6) AS corr FROM r WHERE k = 1""")
def best_lag(spark, sf_dir):
    cells = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    a = cells.where("vec_id % 2 = 0")
    b = cells.where("vec_id % 2 = 1").withColumn("vec_id", F.col("vec_id") - 1)
    return fits.best_lag(a, b, ["vec_id"], 8).withColumn("corr", F.round("corr", 6))


@query("""WITH c AS (SELECT vec_id // 500 AS asset, vec_id AS f, generate_subscripts(embedding, 1) AS b, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT asset, f AS frame, CAST(b AS INTEGER) AS bin, round(v, 6) AS power FROM c WHERE v >= 0.1 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.asset = c.asset AND o.f BETWEEN c.f - 3 AND c.f + 3 AND o.b BETWEEN c.b - 3 AND c.b + 3 AND (o.f <> c.f OR o.b <> c.b) AND o.v >= c.v)""")
def local_peaks(spark, sf_dir):
    cells = t(spark, sf_dir, "embeddings").select(F.expr("vec_id div 500").alias("asset"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("bin", "power"))
    cells = cells.select("asset", "frame", (F.col("bin") + 1).alias("bin"), F.col("power").cast("double").alias("power"))
    return fits.local_peaks(cells, ["asset"], 3, 3, 0.1).withColumn("power", F.round("power", 6))


# -- scalars ---------------------------------------------------------------------


@query(r"""SELECT page_id, nullif(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS name FROM pages""")
def title_normalize(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", sc.normalise(F.col("url")).alias("name"))


@query("""WITH e AS (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' ELSE (s // 60) || ':' END || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS code, CAST(s AS DOUBLE) AS seconds, CASE WHEN s % 97 < 60 THEN CAST(s % 89 * 60 + s % 97 AS DOUBLE) END AS short FROM e""")
def timecodes(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "value", sc.format_timecode(F.col("value") * 40).alias("code"))
    s = F.floor(F.col("value") * 40).cast("long")
    short = F.concat((s % 89).cast("string"), F.lit(":"), (s % 97).cast("string"))  # fields of one digit, and seconds of 60 or more
    return e.select("event_id", "code", sc.parse_timecode(F.col("code")).alias("seconds"), sc.parse_timecode(short).alias("short"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey % 400 AS hits, l_linenumber AS windows, CASE WHEN l_returnflag = 'R' THEN 240 ELSE 200 END AS least FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN hits >= least AND windows >= 3 THEN 'confident' WHEN hits >= 60 THEN 'possible' ELSE 'weak' END AS level,
    CASE WHEN hits >= least AND windows >= 3 THEN '' WHEN hits >= 60 THEN 'confident: ' || concat_ws(', ', CASE WHEN hits < least THEN (least - hits) || ' more hits' END, CASE WHEN windows = 2 THEN '1 more window' WHEN windows < 3 THEN (3 - windows) || ' more windows' END) ELSE 'possible: ' || (60 - hits) || ' more hits' END AS lacks FROM d""")
def confidence_levels(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400).alias("hits"), F.col("l_linenumber").alias("windows"), F.when(F.col("l_returnflag") == "R", "fitted").otherwise("ladder").alias("pass"))
    return li.select("l_orderkey", "l_linenumber", sc.level(sc.level_rank(F.col("hits"), F.col("windows"), F.col("pass"))).alias("level"), sc.shortfall(F.col("hits"), F.col("windows"), F.col("pass")).alias("lacks"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS hz FROM part), b AS (SELECT *, CASE WHEN hz < 125 THEN 0 WHEN hz < 250 THEN 1 WHEN hz < 500 THEN 2 WHEN hz < 1000 THEN 3 WHEN hz < 2000 THEN 4 WHEN hz < 4000 THEN 5 ELSE 6 END AS band FROM p) SELECT band, count(*) AS peaks, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY band""")
def octave_bands(spark, sf_dir):
    return index.peak_stats(t(spark, sf_dir, "part"), F.col("p_retailprice")).withColumn("share", F.round("share", 9))


@query("""SELECT p_partkey, CAST(least(255, round(CASE WHEN p_size < 50 THEN p_size ELSE 50 + ln(p_size / 50) / ln(1.02) END)) AS INTEGER) AS level, round(10 * log10(p_retailprice), 6) AS db, round(p_size * 7.8125, 4) AS hz, CASE WHEN p_partkey < 128 THEN 1 WHEN p_partkey < 16384 THEN 2 ELSE 3 END AS bytes, p_size BETWEEN 10 AND 40 AS kept FROM part""")
def point_scalars(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", sc.anchor_level(F.col("p_size")).alias("level"), F.round(sc.decibels(F.col("p_retailprice")), 6).alias("db"), F.round(sc.bin_to_hz(F.col("p_size")), 4).alias("hz"), sc.varint_length(F.col("p_partkey")).alias("bytes"), sc.track_length_ok(F.col("p_size"), 10, 40).alias("kept"))


@query(r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN ' ' ELSE 'Artist ' || page_id END AS artist, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Title' END AS title FROM pages)
    SELECT page_id, CASE WHEN nullif(trim(title), '') IS NULL THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') ELSE concat_ws(' - ', nullif(trim(artist), ''), nullif(trim(title), '')) END AS name FROM p""")
def track_names(spark, sf_dir):
    n = F.col("page_id")
    artist = F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("Artist "), n.cast("string")))
    return t(spark, sf_dir, "pages").select("page_id", sc.track_name(artist, F.when(n % 4 == 0, "").otherwise("Title"), F.col("url")).alias("name"))


@query(r"""WITH f AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), d AS (SELECT page_id, list_position(string_split(path, '/'), 'fr') AS fr, regexp_matches(path, '^[^/]*/en/[^/]*1[^/]*(/|$)') AS en FROM f)
    SELECT page_id, CAST(CASE WHEN fr > 0 AND (NOT en OR fr <= 3) THEN 1 WHEN en THEN 3 END AS INTEGER) AS line FROM d""")
def ignore_patterns(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return t(spark, sf_dir, "pages").select("page_id", library.ignored_by(path, ["fr", "# a comment", "*/en/*1*"]).alias("line"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'one-channel' WHEN s_acctbal < -800 THEN 'inverted' WHEN s_nationkey % 4 = 1 THEN 'delayed' WHEN s_nationkey * -2.0 <= -40 THEN 'mono' WHEN s_nationkey * -2.0 <= -20 THEN 'nearly-mono' WHEN s_nationkey * -2.0 <= -10 THEN 'narrow' ELSE 'wide' END AS class FROM supplier""")
def channel_classes(spark, sf_dir):
    c = sc.channel_class(F.col("s_acctbal") / 1000, F.when(F.col("s_nationkey") % 4 == 1, 3).otherwise(0), F.col("s_nationkey") * -2.0, F.col("s_suppkey") % 10 == 0)
    return t(spark, sf_dir, "supplier").select("s_suppkey", c.alias("class"))


@query("""WITH l AS (SELECT i AS rung_no, CASE WHEN i < 41 THEN 'turntable' ELSE 'key-locked' END AS playback, round(0.92 + 0.004 * (i % 41), 6) AS speed FROM range(82) r(i)) SELECT p_partkey, CAST(rung_no AS INTEGER) AS rung_no, CAST(round(p_partkey * 64 * speed) AS BIGINT) AS frame64, CAST(round(p_size * 64 / CASE WHEN playback = 'turntable' THEN speed ELSE 1.0 END) AS INTEGER) AS bin64 FROM part, l""")
def ladder_rescale(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 64).alias("frame64"), (F.col("p_size") * 64).alias("bin64"))
    return index.rescaled(p, index.speed_ladder(spark)).select("p_partkey", "rung_no", "frame64", "bin64")


@query("""SELECT concat_ws(',', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), printf('%.2f', l_extendedprice), '"' || l_returnflag || ',' || l_linestatus || '"') AS line FROM lineitem""")
def csv_sink(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat_ws(",", "l_returnflag", "l_linestatus").alias("flags"))
    return sinks.csv_lines(li, {"l_extendedprice": 2})


@query(f"""WITH {IV}, e AS (SELECT *, CAST((a - {LOW}) / 2678400.0 * 60 AS DOUBLE) AS x, CAST((b - {LOW}) / 2678400.0 * 60 AS DOUBLE) AS y FROM iv WHERE b < {HIGH}), f AS (SELECT event_id, CAST(floor(x) AS BIGINT) AS p, CAST(greatest(floor(x) + 1, ceil(y)) AS BIGINT) AS q FROM e) SELECT event_id, repeat('.', p) || repeat('#', q - p) || repeat('.', greatest(0, 60 - q)) AS bar FROM f""")
def timeline_bars(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("end") < HIGH)
    return e.select("event_id", sinks.timeline((F.col("start") - LOW).cast("double"), (F.col("end") - LOW).cast("double"), F.lit(2678400.0)).alias("bar"))


@query("""SELECT 'positive price' AS rule, count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 0, false)) AS failed FROM lineitem UNION ALL SELECT 'ships after 1995', count(*) FILTER (WHERE NOT coalesce(l_shipdate >= TIMESTAMP '1995-01-01', false)) FROM lineitem""")
def doctor_expectations(spark, sf_dir):
    return scoring.expectations(t(spark, sf_dir, "lineitem"), {"positive price": F.col("l_extendedprice") > 0, "ships after 1995": F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")})


# -- verification and test sets ----------------------------------------------------


CELLS = "c AS (SELECT vec_id // 500 AS asset, vec_id AS f, generate_subscripts(embedding, 1) AS b, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), pk AS (SELECT asset, f * 64 AS frame64, b * 64 AS bin64, f * 100 + b AS seq FROM c WHERE v >= 0.2)"


def embedding_points(spark, sf_dir):
    cells = t(spark, sf_dir, "embeddings").select(F.expr("vec_id div 500").alias("asset_id"), F.col("vec_id").alias("f"), F.posexplode("embedding").alias("b", "v"))
    return cells.where(F.col("v").cast("double") >= 0.2).select("asset_id", (F.col("f") * 100 + F.col("b") + 1).alias("seq"), (F.col("f") * 64).alias("frame64"), ((F.col("b") + 1) * 64).alias("bin64"))


@query(f"""WITH {CELLS}, d AS (SELECT v.vec_id AS det, v.vec_id // 500 AS asset, v.vec_id % 7 - 3 AS o FROM embeddings v), e AS (SELECT det, seq, frame64 - o * 64 AS pt, bin64, asset FROM d JOIN pk USING (asset) WHERE frame64 - o * 64 BETWEEN (det - 10) * 64 AND (det + 10) * 64),
    s AS (SELECT * FROM (VALUES (0), (-388 * 64), (-312 * 64), (312 * 64), (388 * 64)) x(shift)), h AS (SELECT DISTINCT det, shift, e.seq, floor(pt / 3968) AS sec FROM e, s WHERE EXISTS (SELECT 1 FROM pk q WHERE q.asset = e.asset AND abs(q.frame64 - (pt + shift)) <= 64 AND abs(q.bin64 - e.bin64) <= 64)),
    n AS (SELECT det, count(*) FILTER (WHERE shift = 0) AS found, count(DISTINCT sec) FILTER (WHERE shift = 0) AS support, count(*) FILTER (WHERE shift <> 0) AS ch FROM h GROUP BY det), z AS (SELECT det, count(*) AS reference FROM e GROUP BY det)
    SELECT z.det, reference, coalesce(found, 0) AS found, coalesce(found, 0) / reference AS share, coalesce(support, 0) AS support, coalesce(ch, 0) / reference / 4 AS chance FROM z LEFT JOIN n ON n.det = z.det""")
def peak_verifier(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    v = t(spark, sf_dir, "embeddings")
    d = v.select(F.col("vec_id").alias("det"), F.expr("vec_id div 500").alias("asset_id"), F.expr("vec_id div 500").alias("query_id"), (F.col("vec_id") - 10).alias("start"), (F.col("vec_id") + 10).alias("end"), F.lit(1.0).alias("speed"), (F.col("vec_id") % 7 - 3).alias("offset"))
    return verify.found_share(verify.expected_peaks(d, p), p.withColumnRenamed("asset_id", "query_id"))


@query(f"""WITH {CELLS}, d AS (SELECT v.vec_id AS det, v.vec_id // 500 AS asset, v.vec_id % 7 - 3 AS o FROM embeddings v WHERE label = 3), e AS (SELECT frame64 - o * 64 AS pt, bin64, asset FROM d JOIN pk USING (asset) WHERE frame64 - o * 64 BETWEEN (det - 10) * 64 AND (det + 10) * 64)
    SELECT asset, count(*) AS peaks FROM pk q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.asset = q.asset AND abs(q.frame64 - pt) <= 64 AND abs(q.bin64 - e.bin64) <= 64) GROUP BY asset""")
def residual_points(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    v = t(spark, sf_dir, "embeddings").where("label = 3")
    d = v.select(F.col("vec_id").alias("det"), F.expr("vec_id div 500").alias("asset_id"), F.expr("vec_id div 500").alias("query_id"), (F.col("vec_id") - 10).alias("start"), (F.col("vec_id") + 10).alias("end"), F.lit(1.0).alias("speed"), (F.col("vec_id") % 7 - 3).alias("offset"))
    left = verify.residual_peaks(p.withColumnRenamed("asset_id", "query_id"), verify.expected_peaks(d, p))
    return left.groupBy(F.col("query_id").alias("asset")).agg(F.count("*").alias("peaks"))


@query("""WITH r AS (SELECT p_partkey, p_type, md5('7/' || p_partkey) AS o FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY o, p_partkey) AS n FROM r) SELECT p_partkey, p_type FROM k WHERE n <= 5""")
def stratified_panel(spark, sf_dir):
    return harness.drawn_by(t(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"], "p_partkey", 5, 7)


@query("""WITH f AS (SELECT p_partkey AS asset_id, p_size AS seconds, md5('3/' || p_partkey) AS o, CAST('0x' || substr(md5('3:' || p_partkey), 1, 8) AS BIGINT) AS n FROM part ORDER BY o, p_partkey LIMIT 20)
    SELECT asset_id, n % greatest(1, seconds - 30) AS start_s, n % 5 = 0 AS held_out, speed FROM f, (VALUES (0.96), (1.0), (1.04)) s(speed)""")
def sweep_panel(spark, sf_dir):
    speeds = spark.createDataFrame([(0.96,), (1.0,), (1.04,)], "speed double")
    return harness.panel(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_size").alias("seconds")), speeds, 20, 3)


MIX = "pl AS (SELECT l_orderkey AS mix, l_linenumber AS ord, l_partkey % 40 AS asset_id, l_quantity AS len FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) AS u FROM lineitem) WHERE u = 1), pm AS (SELECT mix, ord, asset_id, coalesce(sum(len - 4) OVER (PARTITION BY mix ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS a, len FROM pl), plan AS (SELECT mix, ord, asset_id, a, a + len AS b FROM pm)"


def mixes(spark, sf_dir):
    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_discount"))
    li = t(spark, sf_dir, "lineitem").withColumn("u", one).where("u = 1")
    return harness.mix_plan(li.select(F.col("l_orderkey").alias("mix"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 40).alias("asset_id"), F.col("l_quantity").alias("length_s"), F.lit(1.0).alias("speed")))


def mix_detections(spark, sf_dir):
    o = t(spark, sf_dir, "lineitem")
    return o.select(F.col("l_orderkey").alias("mix"), (F.col("l_partkey") % 40).alias("asset_id"), (F.col("l_discount") * 1000).alias("start"), (F.col("l_discount") * 1000 + 25).alias("end"), F.lit(0.0).alias("track_start"), F.lit(1.0).alias("speed"), F.when(F.col("l_tax") > 0.04, 2).otherwise(1).alias("rank"), F.col("l_suppkey").cast("int").alias("hits"))


@query(f"""WITH {MIX} SELECT mix, CAST(ord AS INTEGER) AS ord, round(a, 6) AS start_s, round(b, 6) AS end_s FROM plan""")
def mix_plan(spark, sf_dir):
    return mixes(spark, sf_dir).select("mix", "ord", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"""WITH {MIX}, d AS (SELECT l_orderkey AS mix, l_partkey % 40 AS asset_id, l_discount * 1000 AS a, l_discount * 1000 + 25 AS b, CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END AS rank, l_suppkey AS hits FROM lineitem)
    SELECT p.mix, p.ord, p.asset_id, max(d.rank) AS rank, max(d.hits) AS hits, round(min(d.a) - p.a, 6) AS late_s, round(p.b - max(d.b), 6) AS early_s FROM plan p LEFT JOIN d ON d.mix = p.mix AND d.asset_id = p.asset_id AND d.a < p.b AND p.a < d.b GROUP BY p.mix, p.ord, p.asset_id, p.a, p.b""")
def mix_score(spark, sf_dir):
    s = harness.mix_score(mixes(spark, sf_dir), mix_detections(spark, sf_dir))
    return s.withColumns({"late_s": F.round("late_s", 6), "early_s": F.round("early_s", 6)})


@query(f"""WITH {MIX}, d AS (SELECT l_orderkey AS mix, l_partkey % 40 AS asset_id, l_discount * 1000 AS a, l_discount * 1000 + 25 AS b FROM lineitem) SELECT mix, count(*) AS false FROM d WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.mix = d.mix AND p.asset_id = d.asset_id AND d.a < p.b AND p.a < d.b) GROUP BY mix""")
def mix_false(spark, sf_dir):
    return harness.false_detections(mixes(spark, sf_dir), mix_detections(spark, sf_dir)).groupBy("mix").agg(F.count("*").alias("false"))


@query(f"""WITH {ALONE}, e AS (SELECT doc_id, (min(pos) + max(pos)) / 2 AS m FROM rp GROUP BY 1), q AS (SELECT rp.doc_id, hash, pos FROM rp JOIN e ON e.doc_id = rp.doc_id WHERE pos >= m - 50 AND pos < m + 50),
    v AS (SELECT q.doc_id AS a, ok.doc_id AS b, ok.pos - q.pos AS o, count(*) AS hits FROM q JOIN ok USING (hash) WHERE q.doc_id <> ok.doc_id GROUP BY ALL), m AS (SELECT a, b, max(hits) AS hits FROM v GROUP BY a, b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hits DESC, b) AS k FROM m),
    w AS (SELECT a, b, rp.pos - q.pos AS o, count(*) AS hits FROM r JOIN q ON q.doc_id = a JOIN rp ON rp.doc_id = b AND rp.hash = q.hash WHERE k <= 20 GROUP BY ALL) SELECT a, b, max(hits) AS hits FROM w GROUP BY a, b""")
def library_wide_candidates(spark, sf_dir):
    return harness.text_candidates(t(spark, sf_dir, "documents"), "doc_id", 100)


@query("""SELECT h AS least_hits, w AS least_windows, count(*) FILTER (WHERE l_quantity >= h AND l_linenumber >= w AND l_returnflag <> 'R') AS "right", count(*) FILTER (WHERE l_quantity >= h AND l_linenumber >= w AND l_returnflag = 'R') AS wrong FROM lineitem, (VALUES (10), (20), (40)) x(h), (VALUES (1), (3)) y(w) GROUP BY h, w""")
def rule_grid(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("hits"), F.col("l_linenumber").alias("windows"), (F.col("l_returnflag") != "R").alias("right"))
    return harness.rule_grid(d, [10, 20, 40], [1, 3])


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 8 AS hits, CASE WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 8 THEN 1 ELSE 0 END AS rank FROM lineitem) SELECT CASE WHEN hits >= 240 THEN 2 WHEN hits >= 60 THEN 1 ELSE 0 END AS new_rank, (CASE WHEN hits >= 240 THEN 2 WHEN hits >= 60 THEN 1 ELSE 0 END) <> rank AS changed, count(*) AS detections FROM d GROUP BY ALL""")
def rescore(spark, sf_dir):
    q = F.col("l_quantity")
    d = t(spark, sf_dir, "lineitem").select((q.cast("int") * 8).alias("hits"), F.when(q >= 25, 2).when(q >= 8, 1).otherwise(0).alias("rank"))
    return harness.rescored(d, sc.level_rank(F.col("hits"), F.lit(3), "fitted")).groupBy("new_rank", "changed").agg(F.count("*").alias("detections"))


@query(f"""WITH {IV}, {GAPS.replace('least(a,', 'least(iv.a,')}, tr AS (SELECT user_id, a AS t0, b AS t1, value < 60 AS ix FROM iv), x AS (SELECT gaps.user_id, gaps.a, gaps.b, ix, coalesce(greatest(0, least(gaps.b, t1) - greatest(gaps.a, t0)), 0) AS c FROM gaps LEFT JOIN tr ON tr.user_id + 1 = gaps.user_id)
    SELECT user_id, a AS start_s, b AS end_s, CAST(sum(CASE WHEN ix THEN c ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN NOT ix THEN c ELSE 0 END) AS BIGINT) AS unindexed, count(*) FILTER (WHERE c > 0) AS tracks FROM x GROUP BY ALL""")
def gaps_against_truth(spark, sf_dir):
    e = events(spark, sf_dir)
    gaps = intervals.uncovered(e, ["user_id"], LOW, HIGH, 7200)
    truth = e.select((F.col("user_id") + 1).alias("user_id"), F.col("start").alias("t0"), F.col("end").alias("t1"), (F.col("value") < 60).alias("indexed"))
    return named(harness.gaps_against_truth(gaps, truth, ["user_id"]))


@query(f"""WITH {DP}, {IP}, h AS (SELECT item_id AS a, doc_id AS b, ip.pos AS q FROM ip JOIN dp USING (hash)) SELECT a, b, count(*) AS hits, count(DISTINCT floor(q / 62.5)) AS seconds FROM h GROUP BY a, b""")
def pair_evidence(spark, sf_dir):
    a = item_pairs(spark, sf_dir).select(F.col("item_id").alias("a"), "hash", F.col("pos").alias("qframe"))
    return verify.supported_seconds(a.join(doc_pairs(spark, sf_dir).select(F.col("doc_id").alias("b"), "hash"), "hash"))


@query("""WITH d AS (SELECT l_suppkey AS file, 200.0::DOUBLE AS len, l_discount * 1000 AS a, least(200.0, l_discount * 1000 + l_quantity * 2) AS b, l_partkey % 150 AS hits, l_partkey % 30 AS other, 150.0::DOUBLE AS ol, l_tax * 1000 AS oa, l_tax * 1000 + l_quantity AS ob FROM lineitem),
    p AS (SELECT *, greatest(CASE WHEN a <= 15 THEN oa ELSE 0 END, CASE WHEN b >= len - 15 THEN ol - ob ELSE 0 END) AS beyond FROM d), q AS (SELECT * FROM p WHERE b - a >= 20 AND hits >= 60 AND b - a < 0.8 * len AND len - (b - a) >= 30 AND (a <= 15 OR b >= len - 15) AND beyond >= 30),
    r AS (SELECT file, count(DISTINCT other) AS others, max(hits) AS hits, min(a) AS x, max(b) AS y, max(b - a) AS longest FROM q GROUP BY file) SELECT file, others, hits, (others >= 2 AND y - x >= longest + 20) OR hits >= 100 AS worth_hearing FROM r""")
def multi_recording_files(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    start = F.col("l_discount") * 1000
    d = li.select(F.col("l_suppkey").alias("file"), F.lit(200.0).alias("length_s"), start.alias("start_s"), F.least(F.lit(200.0), start + F.col("l_quantity") * 2).alias("end_s"), (F.col("l_partkey") % 150).alias("hits"), (F.col("l_partkey") % 30).alias("other"), F.lit(150.0).alias("other_length_s"), (F.col("l_tax") * 1000).alias("other_start_s"), (F.col("l_tax") * 1000 + F.col("l_quantity")).alias("other_end_s"))
    return verify.edge_parts(d)


@query("""WITH d AS (SELECT l_suppkey AS q, l_partkey % 20 AS f, l_linenumber % 2 AS r, CAST(l_orderkey % 1000 AS BIGINT) AS a, CAST(l_orderkey % 1000 + l_quantity AS BIGINT) AS b, CAST(l_extendedprice AS BIGINT) AS hits FROM lineitem)
    SELECT count(*) AS kept FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.q = d.q AND o.f = d.f AND o.r <> d.r AND d.a < o.b AND o.a < d.b AND (o.hits > d.hits OR (o.hits = d.hits AND o.r < d.r)))""")
def second_records(spark, sf_dir):
    start = F.col("l_orderkey") % 1000
    d = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 20).alias("file"), (F.col("l_linenumber") % 2).alias("record"), start.alias("start"), F.rint(start + F.col("l_quantity")).cast("long").alias("end"), F.rint("l_extendedprice").cast("long").alias("hits"))  # halves to even, as the SQL's CAST
    return verify.stronger_record(d).agg(F.count("*").alias("kept"))


@query(f"""WITH {DP} SELECT lang AS set_id, dp.doc_id, count(*) AS postings FROM dp, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) s WHERE dp.doc_id NOT IN (SELECT doc_id FROM documents d WHERE d.lang = s.lang) GROUP BY ALL""")
def leave_out(spark, sf_dir):
    """The index each language's documents are searched in when all of that language are left out."""
    d = t(spark, sf_dir, "documents").where("lang is not null")
    langs = sorted(r.lang for r in d.select("lang").distinct().collect())  # a handful
    tracks = d.select(F.col("lang").alias("set_id"), F.array("doc_id").alias("references"))
    p = doc_pairs(spark, sf_dir).withColumnRenamed("doc_id", "asset_id")
    out = [harness.leave_out(p, tracks, F.lit(g)).groupBy("asset_id").agg(F.count("*").alias("postings")).withColumn("set_id", F.lit(g)) for g in langs]
    return compose.union_all(out).withColumnRenamed("asset_id", "doc_id").select("set_id", "doc_id", "postings")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag = 'R')""")
def without_reported(spark, sf_dir):
    recordings = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.lit(1).alias("size"), F.lit(0).alias("modified"))
    reports = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("size"), F.lit(0).alias("modified"), F.col("l_returnflag").alias("settings"))
    return library.without_reported(recordings, reports, "R").select("o_orderkey")


@query("""SELECT l_orderkey, l_partkey || '#' || c AS part, c AS copy_no FROM lineitem, range(3) r(c)""")
def exact_copies(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    return index.exact_copies(li, 3, "part").select("l_orderkey", "part", F.col("copy_no").cast("long").alias("copy_no"))


STRETCHED = "s AS (SELECT asset, k AS copy_no, CAST(round((CASE WHEN rev THEN top - frame64 ELSE frame64 END) * tf) AS BIGINT) AS frame64, CAST(round(bin64 * bf) AS INTEGER) AS bin64, rev FROM (SELECT *, max(frame64) OVER (PARTITION BY asset) AS top FROM pk), (VALUES (0, 0.5, 2.0, false), (1, 1.25, 8.0, false), (0, 1.0, 6.0, true)) c(k, tf, bf, rev))"


@query(f"""WITH {CELLS}, {STRETCHED} SELECT asset AS asset_id, CAST(copy_no AS INTEGER) AS copy_no, rev AS reversed, count(*) AS peaks, CAST(sum(frame64) AS BIGINT) AS frames, CAST(sum(bin64) AS BIGINT) AS bins FROM s WHERE bin64 BETWEEN 320 AND 32000 GROUP BY ALL""")
def stretched_copies(spark, sf_dir):
    """Synthetic assets: stretched, and turned round."""
    p = embedding_points(spark, sf_dir)
    copies = spark.createDataFrame([(0, 0.5, 2.0), (1, 1.25, 8.0)], "copy_no int, time_factor double, bin_factor double")
    back = spark.createDataFrame([(0, 1.0, 6.0)], "copy_no int, time_factor double, bin_factor double")
    both = index.stretched_copies(p, copies).withColumn("reversed", F.lit(False)).unionByName(index.stretched_copies(p, back, reverse=True).withColumn("reversed", F.lit(True)))
    return both.groupBy("asset_id", "copy_no", "reversed").agg(F.count("*").alias("peaks"), F.sum("frame64").alias("frames"), F.sum("bin64").alias("bins"))


@query(f"""WITH {IV}, p AS (SELECT user_id AS query_id, event_id AS play, event_type AS track, a, b, a // 3600 AS zero, value >= 50 AS sure FROM iv) SELECT x.query_id, x.play, string_agg(DISTINCT y.track, ',' ORDER BY y.track) AS titles FROM p x JOIN p y ON x.query_id = y.query_id AND y.sure AND x.play <> y.play AND x.track <> y.track AND least(x.b, y.b) - greatest(x.a, y.a) >= 0.5 * least(x.b - x.a, y.b - y.a) AND x.a < y.b AND y.a < x.b AND abs(x.zero - y.zero) <= 5 GROUP BY ALL""")
def other_titles(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("play"), F.col("event_type").alias("track"), "start", "end", F.floor(F.col("start") / 3600).alias("zero"), F.when(F.col("value") >= 50, 2).otherwise(1).alias("rank"))
    return plays.other_titles(p, 36000).select("query_id", "play", F.concat_ws(",", "titles").alias("titles"))
