"""Quality classification by co-training of two views.

One view sees the text (shares of byte classes, of their trigrams, repetition),
the other what is known about the page (source, language, stated length). Each is
a logistic regression. In every round both are fitted to what they have been given
and score every unlabelled document; of those that a view is confident of, some are
handed to the other view as labelled: in the classes' proportions, evenly over the
sources, and drawn by a hash from all of them. What is given to a view is bounded
(``most`` labelled rows and ``exchange`` a round), what it is drawn from is not. The
views are calibrated on labelled rows that neither was fitted to, and their calibrated
log-odds are combined by a last regression on these rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seqloom.llm.common import flat, small_batches, steps, texts
from seqloom.llm.linear import logistic, logit_of, sigmoid
from seqloom.session import materialise

#: Byte classes: blank, line end, lower, upper, digit, above ASCII, sentence marks, other marks.
CLASSES = np.array([0 if b in (32, 9) else 1 if b in (10, 13) else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 5 if b >= 128 else 6 if b in b".,;:'\"?-()" else 7 for b in range(256)], np.uint8)
KINDS, TRIGRAMS = 8, 512
#: Numbers about words that follow the class trigrams in the text view.
WORD_FEATURES = 8
TEXT_WIDTH = TRIGRAMS + WORD_FEATURES
SOURCES, LANGS, SIZES = 64, 16, 12
META_WIDTH = SOURCES + LANGS + SIZES
#: Odds beyond which a view is confident enough to hand on a decision.
CONFIDENT = 3.0


def _word_numbers(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * WORD_FEATURES
    n, kinds = len(words), {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    return [np.log1p(n), np.log1p(len(kinds)) - np.log1p(n), max(kinds.values()) / n, same, len(text) / n / 10, float(n < 20), sum(len(w) < 2 for w in words) / n, 1.0]


def text_view(column) -> np.ndarray:
    raw, offsets = flat(column)
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_WIDTH), np.float32)
    for lo, hi in steps(offsets):
        c = CLASSES[raw[offsets[lo] : offsets[hi]]].astype(np.int32)
        rows = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(offsets[lo : hi + 1]))
        if len(c) > 2:
            one = rows[2:] == rows[:-2]
            cell = (rows[2:] * TRIGRAMS + c[:-2] * 64 + c[1:-1] * 8 + c[2:])[one]
            counts = np.bincount(cell, minlength=(hi - lo) * TRIGRAMS).reshape(-1, TRIGRAMS)
            # whole numbers of 255, so that a byte holds one
            out[lo:hi, :TRIGRAMS] = np.rint(255 * np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))) / 255
    out[:, TRIGRAMS:] = [_word_numbers(t) for t in texts(column)] if n else np.zeros((0, WORD_FEATURES))
    return out


def meta_codes(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three bytes a row: the source's and the language's hash, and the size of the stated length."""
    out = np.zeros((len(source), 3), np.uint8)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        out[i, 0] = xxhash.xxh32_intdigest((s or "").encode()) % SOURCES
        out[i, 1] = xxhash.xxh32_intdigest((g or "").encode()) % LANGS
        out[i, 2] = min(SIZES - 1, int(max(0, n or 0)).bit_length() // 2 if n is not None else SIZES - 1)
    return out


def meta_view(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), META_WIDTH), np.float32)
    for k, start in enumerate((0, SOURCES, SOURCES + LANGS)):
        out[np.arange(len(codes)), start + codes[:, k].astype(int)] = 1
    return out


def _meta_codes(batch) -> np.ndarray:
    return meta_codes(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(_meta_codes(batch))


#: Bytes of a row's packed views: a byte a trigram, four a number about words, three of metadata.
PACKED = TRIGRAMS + 4 * WORD_FEATURES + 3


def _pack(batches):
    for batch in batches:
        t = text_view(batch.column("text"))
        rows = np.hstack([np.rint(255 * t[:, :TRIGRAMS]).astype(np.uint8), np.ascontiguousarray(t[:, TRIGRAMS:]).view(np.uint8).reshape(len(t), -1), _meta_codes(batch)])
        views = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PACKED), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("good"), views], names=["place", "good", "views"])


_PACKED = "place long, good int, views binary"


def _unpacked(column) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The source of each row, and its two views."""
    rows = flat(column)[0].reshape(-1, PACKED)
    words = np.ascontiguousarray(rows[:, TRIGRAMS:-3]).view(np.float32).reshape(len(rows), WORD_FEATURES)
    return rows[:, -3], (np.hstack([rows[:, :TRIGRAMS].astype(np.float32) / 255, words]), meta_view(rows[:, -3:]))


def _moments(batches):
    """Of each feature of both views the count, sum and sum of squares over a partition."""
    n, s, ss = 0, np.zeros(TEXT_WIDTH + META_WIDTH), np.zeros(TEXT_WIDTH + META_WIDTH)
    for batch in batches:
        x = np.hstack(_unpacked(batch.column("views"))[1]).astype(np.float64)
        n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(np.full(len(s), n, np.int64)), pa.array(s), pa.array(ss)], names=["i", "n", "s", "ss"])


def _confident(weights_bc, used_bc, rates_bc, salt: int):
    """Decisions that a view is confident of: how many by view, class and source, or those drawn at the ``rates``."""

    def run(batches):
        weights, used, rates = weights_bc.value, used_bc.value, rates_bc.value if rates_bc else None
        counts = np.zeros((2, 2, 256), np.int64)
        for batch in batches:
            place = batch.column("place").to_numpy()
            source, views = _unpacked(batch.column("views"))
            u = _uniform(place, salt) if rates is not None else None
            free = ~np.isin(place, used)
            for k in (0, 1):
                centre, spread, w = weights[k]
                z = logit_of((views[k] - centre) / spread, w)
                for c, sure in enumerate((z < -CONFIDENT, z > CONFIDENT)):
                    rows = np.flatnonzero(sure & free)
                    if rates is None:
                        counts[k, c] += np.bincount(source[rows], minlength=256)
                    else:
                        rows = rows[u[rows] < rates[k, c, source[rows]]]
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(place[rows]), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, c, np.int32)), batch.column("views").take(pa.array(rows))], names=["place", "view", "good", "views"])
        if rates is None:
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["cell", "n"])

    return run


def _uniform(place: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each place, another one for each salt."""
    x = place.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def even_rates(counts: np.ndarray, n: int) -> np.ndarray:
    """Share of each source's rows that is drawn so that ``n`` are, as many of each source as there are."""
    order = np.sort(counts[counts > 0])
    level, left = 0.0, float(n)
    for i, c in enumerate(order):
        level = left / (len(order) - i)
        if c >= level:
            break
        left -= c
        level = float(c)
    return np.where(counts > 0, np.minimum(1.0, level / np.maximum(counts, 1)), 0.0)


@dataclass
class Model:
    """Standardisation and weights of both views, their calibration (slope, offset), and the combination."""

    centre: list[np.ndarray]
    spread: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray]
    combined: np.ndarray

    def logits(self, views: tuple[np.ndarray, ...]) -> np.ndarray:
        raw = [logit_of((v - c) / s, w) for v, c, s, w in zip(views, self.centre, self.spread, self.weights)]
        return np.stack([logit_of(z[:, None], k) for z, k in zip(raw, self.calibration)], 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, rounds: int = 3, exchange: int = 400, seed: int = 5) -> Model | None:
    """A model from at most ``most`` labelled documents, drawn by a hash of the id, and all others unlabelled; each text whole."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("other"))
    known = known.where("good = other").select(F.col("doc_id").alias("label_id"), (F.col("good") > 0).cast("int").alias("good"), F.xxhash64("doc_id", F.lit(3)).alias("order"))
    few = materialise(known.orderBy("order").limit(most).select("label_id", "good"), "quality-labels", compact=True)
    rows = small_batches(docs).select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(few), rows["doc_id"] == few["label_id"], "left")  # few has at most ``most`` rows
    rows = rows.select(F.xxhash64("doc_id", "text").alias("place"), "good", "text", "source", "lang", "n_chars")
    packed = materialise(rows.mapInArrow(_pack, _PACKED), "quality-views")
    has = packed.where("good is not null").dropDuplicates(["place"]).orderBy("place").limit(most).toArrow()
    y = has.column("good").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return None
    views = [v.astype(np.float64) for v in _unpacked(has.column("views"))[1]]
    moments = packed.mapInArrow(_moments, "i int, n long, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toArrow().sort_by("i")
    n, s, ss = (moments.column(c).to_numpy() for c in ("n", "s", "ss"))
    mean = s / n
    deviation = np.maximum(np.sqrt(np.maximum(ss / n - mean * mean, 0)), 0.02)
    centre, spread = ([x[:TEXT_WIDTH], x[TEXT_WIDTH:]] for x in (mean, deviation))
    views = [(v - c) / d for v, c, d in zip(views, centre, spread)]
    fold = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), bool)
    held = fold if fold.any() else np.ones(len(y), bool)
    given = [(v[~fold], y[~fold].astype(float)) for v in views]
    weights: list = [None, None]

    def fitted(k):
        return logistic(*given[k], ridge=5.0, start=weights[k], rounds=8)

    free, used, share = packed.where("good is null"), np.zeros(0, np.int64), [1 - y.mean(), y.mean()]
    for r in range(rounds):
        weights = [fitted(k) for k in (0, 1)]
        now = spark.sparkContext.broadcast([(c, d, w) for c, d, w in zip(centre, spread, weights)]), spark.sparkContext.broadcast(used)
        cells = free.mapInArrow(_confident(*now, None, r), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((2, 2, 256), np.int64)
        counts.ravel()[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        if not counts.any():
            break
        rates = np.array([[even_rates(counts[k, c], round(exchange * share[c])) for c in (0, 1)] for k in (0, 1)])
        drawn = free.mapInArrow(_confident(*now, spark.sparkContext.broadcast(rates), r), "place long, view int, good int, views binary").dropDuplicates(["place", "view"]).toArrow().sort_by([("place", "ascending"), ("view", "ascending")])
        _, first = np.unique(drawn.column("place").to_numpy(), return_index=True)  # copies of a row, and rows that both views hand on, once
        drawn = drawn.take(first)
        got, view, good = _unpacked(drawn.column("views"))[1], drawn.column("view").to_numpy(), drawn.column("good").to_numpy()
        used = np.r_[used, drawn.column("place").to_numpy()]
        for to in (0, 1):
            rows = view == 1 - to
            given[to] = np.vstack([given[to][0], (got[to][rows] - centre[to]) / spread[to]]), np.r_[given[to][1], good[rows].astype(float)]
    weights = [fitted(k) for k in (0, 1)]
    raw = [logit_of(v[held], w) for v, w in zip(views, weights)]
    calibration = [logistic(z[:, None], y[held].astype(float), ridge=1e-3) for z in raw]
    both = np.stack([logit_of(z[:, None], k) for z, k in zip(raw, calibration)], 1)
    return Model(centre, spread, weights, calibration, logistic(both, y[held].astype(float), ridge=1e-1))


def _score(model_bc):
    def run(batches):
        model = model_bc.value
        for batch in batches:
            n = len(batch)
            z = np.zeros((n, 2))
            total = np.full(n, np.inf)
            if model is not None and n:
                z = model.logits(_views(batch))
                total = logit_of(z, model.combined)
            p = sigmoid(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(sigmoid(total))], names=[*batch.schema.names, *SCORES])

    return run


SCORES = ("text_score", "meta_score", "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 6000, rounds: int = 3) -> DataFrame:
    """``docs (doc_id, text, source, lang, n_chars)`` with ``text_score, meta_score, score, keep``, row by row.

    ``labels (doc_id, quality)`` tells good (1) from bad (0) documents. Scores are
    probabilities of being good: each view's, and of both. ``keep`` is
    ``score >= threshold``. Null texts count as empty, null metadata as values of
    their own, null labels and ids with labels that disagree as not labelled.
    Where the labels lack a class nothing can be learned and every row is kept
    with score 1. Repeated rows each give a row; an empty table gives none. Other
    columns pass through, but for those with the names of the new ones.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, rounds))
    rows = small_batches(docs).drop(*SCORES, "keep")
    schema = StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in SCORES)])
    return rows.mapInArrow(_score(model), schema).withColumn("keep", F.col("score") >= threshold)


def _accept(model_bc, threshold: float):
    def run(batches):
        model = model_bc.value
        for batch in batches:
            if model is not None and len(batch):
                batch = batch.filter(pa.array(sigmoid(logit_of(model.logits(_views(batch)), model.combined)) >= threshold))
            yield batch

    return run


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 6000, rounds: int = 3) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with just their own columns, whatever these are called."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, rounds))
    return small_batches(docs).mapInArrow(_accept(model, threshold), docs.schema)


def digest(classified: DataFrame) -> DataFrame:
    return classified.select("doc_id", *SCORES, "keep")
