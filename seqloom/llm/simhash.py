"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Two fingerprints within ``radius`` bits agree on at least ``parts - radius`` of
``parts`` bit ranges, so one table for each choice of so many ranges, keyed by
their bits, brings every such pair together at least once. Within a bucket the
bits stand vertically: plane p holds bit p of 64 fingerprints in one word, and
64 distances at a time are kept in bitwise counters that a carry-save adder
updates; words in which every distance has passed the radius are abandoned.
Buckets give spanning links, never all pairs.

Where a similarity of shingle sets is asked for and not a radius (:func:`one_of_each`),
bits alone can't tell: at a Jaccard similarity of 0.8 two fingerprints differ in some 10
bits. There documents meet that share one of ``BANDS`` keys, each made of ``ROWS``
least hashes of their shingles; the bit-sliced comparison leaves out the pairs far
beyond any such similarity, and the others are decided by their shingle sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqloom.llm.common import BROADCAST_IDS, small_batches, texts, without_ids
from seqloom.operators.graph import connected_components
from seqloom.session import few_files, materialise

SEED = 42
#: Fingerprints of one bucket that meet in one task; larger buckets are split and every two splits meet.
TILE = 4096
#: Pairs of words compared at a time, and links held before they are reduced.
WORDS, LINKS = 16_384, 1_000_000
ALL = ~np.uint64(0)


def hashes_of(text: bytes, shingle: int) -> np.ndarray:
    """Of each shingle of words its hash; of fewer words that of all of them, of none nothing."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero without words."""
    return majority(hashes_of(text, shingle))


def majority(hashes: np.ndarray) -> int:
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    # eight bits at a time as bytes of a word: up to 255 rows add up before a byte could overflow
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(hashes), 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id long, fp long)`` for each row; a null text is an empty one."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64 x words) of fingerprints laid out as words x 64 lanes."""
    out = np.empty((64, len(fps)), np.uint64)
    for lo in range(0, len(fps), 1024):
        part = np.ascontiguousarray(fps[lo : lo + 1024])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        out[:, lo : lo + len(part)] = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0].T
    return out


def near_lanes(planes: np.ndarray, query: np.ndarray, lane: int, target: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """For each pair of words, the lanes of ``target`` within ``radius`` of one lane of ``query``; only ``live`` lanes count."""
    digits = (radius + 1).bit_length()
    start = (1 << digits) - radius - 1  # so that a counter overflows with the first bit beyond the radius
    out = np.zeros(len(query), np.uint64)
    at = np.arange(len(query))
    count = [np.full(len(query), ALL if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = ~live

    def differ(p):
        same = (planes[p][query] >> np.uint64(lane)) & np.uint64(1)
        return planes[p][target] ^ (np.uint64(0) - same)

    def add(x, d):
        while d < digits:
            carry = count[d] & x
            count[d] ^= x
            x, d = carry, d + 1
        np.bitwise_or(over, x, out=over)

    for p in range(0, 64, 3):
        if p == 63:
            add(differ(p), 0)
            break
        a, b, c = differ(p), differ(p + 1), differ(p + 2)
        ab = a ^ b
        add(ab ^ c, 0)
        add((a & b) | (c & ab), 1)
        if p % 6 == 3:
            keep = np.flatnonzero(over != ALL)
            if not len(keep):
                return out
            if len(keep) < 0.75 * len(at):
                at, query, target, over = at[keep], query[keep], target[keep], over[keep]
                count = [x[keep] for x in count]
    out[at] = ~over
    return out


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, each node to the least of its component."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (deeper := label[label] != label).any():
            label = np.where(deeper, label[label], label)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def bucket_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all pairs within ``radius`` in the same bucket; rows come bucket by bucket."""
    none = np.zeros(0, np.uint64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(bucket)])
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return none, none
    words = -(-size // 64)
    first = np.cumsum(words) - words
    lanes = np.zeros((int(words.sum()), 64), np.uint64)
    live = np.zeros(lanes.shape, bool)
    row = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    spot = np.repeat(first * 64 - np.cumsum(size) + size, size) + np.arange(size.sum())
    lanes.reshape(-1)[spot], live.reshape(-1)[spot] = fps[row], True
    filled = live.sum(1)
    alive = np.packbits(live, axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = planes_of(lanes)
    links_u, links_v, held = [], [], 0

    def reduce():
        nonlocal links_u, links_v, held
        u, v = spanning(np.concatenate(links_u), np.concatenate(links_v))
        links_u, links_v, held = [u], [v], len(u)

    def pairs():
        """Words of a bucket that meet, a bounded number at a time."""
        a, b, n = [], [], 0
        for f, w in zip(first.tolist(), words.tolist()):
            for i in range(w):
                a.append(np.full(w - i, f + i))
                b.append(np.arange(f + i, f + w))
                n += w - i
                if n >= WORDS:
                    yield np.concatenate(a), np.concatenate(b)
                    a, b, n = [], [], 0
        if n:
            yield np.concatenate(a), np.concatenate(b)

    for q, t in pairs():
        for lane in range(64):
            on = np.flatnonzero(filled[q] > lane)
            if not len(on):
                break
            qq, tt = q[on], t[on]
            later = np.uint64(0) if lane == 63 else ALL << np.uint64(lane + 1)
            found = near_lanes(planes, qq, lane, tt, np.where(qq == tt, alive[tt] & later, alive[tt]), radius)
            hit = np.flatnonzero(found)
            if len(hit):
                w, bit = np.nonzero(np.unpackbits(found[hit, None].view(np.uint8), axis=1, bitorder="little"))
                links_u.append(lanes[qq[hit[w]], lane])
                links_v.append(lanes[tt[hit[w]], bit])
                held += len(w)
                if held > LINKS:
                    reduce()
    if not links_u:
        return none, none
    reduce()
    return links_u[0], links_v[0]


def _link_buckets(radius: int):
    def run(batches):
        """Buckets come in order; the last one of a batch may go on in the next."""
        rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            b = np.concatenate([rest_b, batch.column("bucket").to_numpy()])
            f = np.concatenate([rest_f, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(b, b[-1])) if len(b) else 0
            rest_b, rest_f = b[cut:], f[cut:]
            u, v = bucket_links(f[:cut].view(np.uint64), b[:cut], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        u, v = bucket_links(rest_f.view(np.uint64), rest_b, radius)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def parts_for(fingerprints: int, radius: int) -> int:
    """The fewest bit ranges that leave keys so many bits that a bucket of unlike fingerprints has some 16 of them."""
    most = radius + 4
    return next((p for p in range(radius + 2, most) if fingerprints >> 4 <= 1 << 64 * (p - radius) // p), most)


def near_links(distinct: DataFrame, radius: int = 4, parts: int = 6) -> DataFrame:
    """``(u, v)``: links with the components of all pairs of ``distinct.fp`` within ``radius`` bits.

    More ``parts`` make more tables with longer keys (see :func:`parts_for`); the links are of the same components.
    """
    if not 0 <= radius < parts <= 16:
        raise ValueError("there must be more parts than the radius, and at most 16")
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in some) for some in combinations(range(parts), parts - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("x")).select("x.t", "x.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["t", "key"]).withColumn("s", F.ceil(F.col("n") / TILE).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    met = met.select(F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp")
    met = met.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    # two keys with one hash only make a bucket larger; what is linked is decided by the bits
    return met.mapInArrow(_link_buckets(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``radius`` differing bits, the row's own included. Equal fingerprints are one
    node, so copies of a text make no pairs. Null and empty texts have the
    fingerprint zero and link like any other. A null ``doc_id`` keeps its row and
    is the component only where no row of it has an id. Repeated rows stay. An
    empty table gives no rows; other columns are not read.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    of = _groups(fps, radius)
    out = fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return few_files(out)


def _groups(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, component, component_id)`` of each distinct fingerprint: the least fingerprint and ``doc_id`` of its group."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps", compact=True)
    member = connected_components(near_links(distinct, radius, parts_for(distinct.count(), radius)))
    member = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return member.join(least, "component").select("fp", "component", "component_id")


#: Keys of a document, and least hashes in each: two of similarity 0.8 share none with a probability of 0.002, two of 0.9 with one of 10^-6.
BANDS, ROWS = 12, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits in which fingerprints of similar sets never differ; sets smaller than ``FEW`` shingles are compared whatever theirs.
FAR, FEW = 24, 16
#: Sets, and shingles of them, that one tile of a group holds.
TILE_SETS, TILE_SHINGLES = 512, 200_000


def band_keys(distinct: np.ndarray) -> list[int]:
    """The keys of a set of shingle hashes; none of an empty one."""
    if not len(distinct):
        return []
    least = np.full(BANDS * ROWS, ALL)
    for lo in range(0, len(distinct), 4096):
        least = np.minimum(least, ((distinct[lo : lo + 4096, None] ^ _MIX[0]) * _MIX[1]).min(0))
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def set_of(text: bytes, shingle: int) -> tuple[int, int, np.ndarray]:
    """Name, fingerprint and distinct hashes of a text's shingles."""
    hashes = hashes_of(text, shingle)
    distinct = np.unique(hashes)
    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED) if len(distinct) else 0, majority(hashes), distinct


def _signed(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _sketches(shingle: int):
    def run(batches):
        for batch in batches:
            got = [set_of(t, shingle) for t in texts(batch.column("text"))]
            keys = [band_keys(x) for _, _, x in got]
            ends = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _signed(n for n, _, _ in got), pa.array([len(x) for _, _, x in got], pa.int64()), pa.ListArray.from_arrays(ends, _signed(k for own in keys for k in own))],
                names=["doc_id", "set", "size", "keys"],
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            got = [set_of(t, shingle) for t in texts(batch.column("text"))]
            ends = pa.array(np.cumsum([0, *(len(x) for _, _, x in got)], dtype=np.int64))
            hashes = pa.LargeListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in got)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([_signed(n for n, _, _ in got), _signed(f for _, f, _ in got), hashes.cast(pa.list_(pa.int64()))], names=["set", "fp", "hashes"])

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < similarity * len(b):
        return len(a) == len(b)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int((b[at] == a).sum())
    return same >= similarity * (len(a) + len(b) - same)


def set_links(names: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of all pairs of one bucket that are alike."""
    n, links = len(names), []
    if n == 2:
        return [(int(names[0]), int(names[1]))] if alike(*sets, similarity) else []
    label, size = np.arange(n), np.array([len(x) for x in sets])
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = fps
    live = np.zeros(lanes.size, bool)
    live[:n] = True
    alive = np.packbits(live.reshape(lanes.shape), axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = planes_of(lanes)
    few = size < FEW
    for i in range(n - 1):
        word, lane = divmod(i, 64)
        target = np.arange(word, len(lanes))
        near = near_lanes(planes, np.full(len(target), word), lane, target, alive[target], FAR)
        near = np.unpackbits(near[:, None].view(np.uint8), axis=1, bitorder="little").reshape(-1)[: n - 64 * word].astype(bool)
        j = np.arange(64 * word, n)
        ok = (j > i) & (near | few[j] | few[i]) & (label[j] != label[i])
        ok &= np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])
        for other in j[ok].tolist():
            if label[other] != label[i] and alike(sets[i], sets[other], similarity):
                links.append((int(names[i]), int(names[other])))
                label[label == label[other]] = label[i]
    return links


def _link_sets(similarity: float):
    def run(batches):
        """Buckets come in order; the last one of a batch may go on in the next."""

        def linked(rows):
            links = set_links(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).view(np.uint64), [r[2] for r in rows], similarity) if len(rows) > 1 else []
            u, v = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

        bucket, rows = None, []
        for batch in batches:
            hashes = batch.column("hashes")
            at, values = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
            for i, (b, name, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "set", "fp")))):
                if b != bucket:
                    yield linked(rows)
                    bucket, rows = b, []
                rows.append((name, fp, values[at[i] : at[i + 1]].copy()))
        yield linked(rows)

    return run


def similar_sets(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, set)`` of each row and ``(set, component, component_id)`` of each shingle set: groups of all that links of ``similarity`` join.

    Equal sets are one node. Sets that share a key, over others as well, make a
    group of candidates; a large one is split into tiles and every two tiles meet in
    a task. ``component_id`` is the least ``doc_id`` of a group.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(rows.mapInArrow(_sketches(shingle), "doc_id long, set long, size long, keys array<long>"), "shingle-sets")
    nodes = materialise(sketch.groupBy("set").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct-sets", compact=True)
    keyed = nodes.select("set", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("set").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    stars = keyed.join(shared, "key").where("set <> first").select(F.col("first").alias("u"), F.col("set").alias("v")).distinct()
    group = materialise(connected_components(stars), "candidate-sets", compact=True)
    member = group.select(F.col("node").alias("set"), F.col("component").alias("group")).join(nodes.select("set", "size", "least"), "set")
    tiles = member.groupBy("group").agg(F.ceil(F.greatest(F.sum("size") / TILE_SHINGLES, F.count("*") / TILE_SETS)).cast("int").alias("s"))
    member = materialise(member.join(tiles, "group"), "tiles", compact=True)
    few = member.count() <= BROADCAST_IDS
    if few:  # only documents whose id is that of a candidate are read again, else all are
        rows = rows.join(F.broadcast(member.select(F.col("least").alias("__least")).distinct()), rows["doc_id"].eqNullSafe(F.col("__least")), "left_semi")
    sets = rows.mapInArrow(_sets(shingle), "set long, fp long, hashes array<long>")
    asked = member.select("set", "group", "s")
    met = sets.join(F.broadcast(asked) if few else asked, "set").dropDuplicates(["set"])
    met = met.withColumn("mine", F.pmod(F.xxhash64("set"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    met = met.select(F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "set", "fp", "hashes")
    met = met.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    linked = connected_components(met.mapInArrow(_link_sets(similarity), "u long, v long"))
    out = nodes.select("set", "least").join(linked.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    least = out.groupBy("component").agg(F.min("least").alias("component_id"))
    return sketch.select("doc_id", "set"), out.join(least, "component").select("set", "component", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest ``doc_id``.

    Near duplicates are linked by a Jaccard similarity of their sets of word shingles
    of at least ``similarity``; texts of fewer words are one shingle, and all texts
    without words are alike. A row with a null id stays only where its group has no
    other; of rows that share an id and a group the one with the least text hash
    stays. Columns are those of ``docs``. Where ids are unique only ids are joined;
    else the rows meet their groups by the set's name.
    """
    sets, groups = similar_sets(docs, shingle, similarity)
    groups = materialise(groups, "set-groups", compact=True)
    rows, ids = sets.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        gone = materialise(sets.join(groups, "set").where("doc_id <> component_id").select("doc_id"), "near-copies", compact=True)
        return without_ids(docs, gone, "doc_id")
    groups = groups.select(F.col("set").alias("__own"), F.col("component").alias("__group"))
    held = docs.mapInArrow(_with_set(shingle), StructType([*docs.schema.fields, StructField("__set", LongType())]))
    held = held.join(groups, F.col("__set") == F.col("__own"))
    held = held.withColumn("__rank", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")))
    first = held.groupBy("__group").agg(F.min("__rank").alias("__first"))
    kept = held.join(first, "__group").where(F.col("__rank").eqNullSafe(F.col("__first")))
    return kept.dropDuplicates(["__group"]).select(*docs.columns)


def _with_set(shingle: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(set_of(t, shingle)[0] for t in texts(batch.column("text")))], names=[*batch.schema.names, "__set"])

    return run
