"""Language identification: the family first, then one-versus-one machines within it.

Features are the relative frequencies of hashed byte n-grams (1 to 3 bytes) of the
lower-cased text, where anything that is no letter is one blank. A linear score of
relative frequencies is the mean of the n-grams' weights, so a text of any length
is scored by table lookups over its whole bytes. Families are told apart by one
machine for each two of them, and so are the languages of the winning family;
most wins decide, then the sum of margins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bucket_of, flat, range_sums, small_batches, steps
from seqloom.llm.linear import sigmoid, svm

#: Language families by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id ms tl jv mi",
    "bantu": "sw zu xh rn",
}
UNKNOWN = "und"
FEATURES = 1 << 13
#: Lower-cases ASCII; bytes that are no ASCII letter and below 128 are blanks.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
ANY_LETTER = regex.compile(r"\p{L}")
SCALE = 100.0


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0]
    return next((f for f, langs in FAMILIES.items() if base in langs.split()), lang)


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n its hashed n-grams from each place, and where each text begins in them; a blank stands before and after a text.

    A text of m bytes has m + 1 places: the blank before it and each byte.
    """
    n = len(offsets) - 1
    at = np.arange(len(raw)) + np.repeat(np.arange(n) * 2 + 1, np.diff(offsets))
    buf = np.full(len(raw) + 2 * n + 2, 32, np.uint8)
    # é and É differ by 32 in the second byte of two
    folded = FOLD[raw]
    if len(raw):
        folded[1:] += ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).astype(np.uint8) * 32
    buf[at] = folded
    code = buf.astype(np.uint32)
    one = code[:-2]
    two = one << 8 | code[1:-1]
    three = two << 8 | code[2:]
    mixed = [(g * np.uint32(2654435761) + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(19) for k, g in ((1, one), (2, two), (3, three))]
    return mixed, offsets[:-1] + 2 * np.arange(n)


def has_letter(text: bytes) -> bool:
    return ANY_LETTER.search(text.decode("utf-8", "replace")) is not None


def _features(batches):
    """Sparse relative frequencies of each text."""
    for batch in batches:
        raw, offsets = flat(batch.column("text"))
        index, value = [], []
        for i in range(len(batch)):
            hashes, _ = _hashed(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            counts = np.bincount(np.concatenate([h[:-1] for h in hashes]), minlength=FEATURES)
            some = np.flatnonzero(counts)
            index.append(some.astype(np.int16))
            value.append((counts[some] / counts.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(index, pa.list_(pa.int16())), pa.array(value, pa.list_(pa.float32()))], names=["lang", "order", "index", "value"])


@dataclass
class Model:
    """``pairs[k]`` is the two classes that column k of ``weights`` tells apart (the first where positive)."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def votes(self, margins: np.ndarray, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number among ``classes`` and its least margin, for each row."""
        n = len(margins)
        if len(classes) == 1:
            return np.zeros(n, np.int64), np.full(n, np.inf)
        own = {c: [] for c in classes}
        for k, (a, b) in enumerate(self.pairs):
            if a in own and b in own:
                own[a].append(margins[:, k])
                own[b].append(-margins[:, k])
        m = np.stack([np.stack(own[c]) for c in classes])  # class, opponent, row
        rank = (m > 0).sum(1) + sigmoid(m.sum(1)) * 0.5
        best = rank.argmax(0)
        return best, m.min(1)[best, np.arange(n)]

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, sure = self.votes(margins, [f"family:{f}" for f in self.families])
        out, score = np.empty(len(margins), object), sigmoid(sure)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            own = [x for x in self.langs if family_of(x) == name]
            best, inner = self.votes(margins[rows], own)
            out[rows] = np.array(own, object)[best]
            score[rows] = np.minimum(score[rows], sigmoid(inner))
        return out.tolist(), score


def fit(rows: DataFrame, per_lang: int = 400, most_langs: int = 200, seed: int = 11) -> Model | None:
    """A model from ``rows (doc_id, text, lang)``, of which at most about ``per_lang`` a language are used, whole.

    The ``most_langs`` languages with most texts are learned: machines are fitted for
    each two of a family and of families, so labels that are no languages must not be
    without bound.
    """
    labelled = rows.where("lang is not null and text is not null and length(text) > 0")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    parts = 1 << 20
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(parts, -(-parts * per_lang // n)))) for k, n in counts.items()))
    some = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < share)
    some = some.select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    got = some.mapInArrow(_features, "lang string, order long, index array<smallint>, value array<float>").toArrow().sort_by("order")
    y = np.array(got.column("lang").to_pylist(), object)
    x = np.zeros((len(y), FEATURES))
    for i, (k, v) in enumerate(zip(got.column("index").to_pylist(), got.column("value").to_pylist())):
        x[i, k] = v
    x *= np.sqrt(SCALE)
    langs = sorted(set(y))
    families = sorted({family_of(v) for v in langs})
    fam = np.array([family_of(v) for v in y], object)
    pairs, weights = [], []
    todo = [(f"family:{a}", f"family:{b}", fam == a, fam == b) for a, b in combinations(families, 2)]
    todo += [(a, b, y == a, y == b) for f in families for a, b in combinations([v for v in langs if family_of(v) == f], 2)]
    for a, b, first, second in todo:
        rows_ = first | second
        pairs.append((a, b))
        weights.append(svm(x[rows_], np.where(first[rows_], 1.0, -1.0), c=10.0))
    return Model(langs, families, pairs, np.sqrt(SCALE) * np.array(weights, np.float64).reshape(len(pairs), FEATURES).T)


def _predict(model_bc):
    def run(batches):
        model = model_bc.value
        weights = model.weights.astype(np.float32) if model else None
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            n = len(batch)
            lang, score = [UNKNOWN] * n, np.zeros(n)
            letters = np.array([has_letter(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(n)], bool)
            for lo, hi in steps(offsets) if model else ():
                hashes, at = _hashed(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                places = np.diff(offsets[lo : hi + 1]) + 1
                margins = np.stack([sum(range_sums(w[h], at, at + places) for h in hashes) for w in weights.T], 1) if weights.shape[1] else np.zeros((hi - lo, 0))
                names, sure = model.predict(margins / (3 * places)[:, None])
                for i in np.flatnonzero(letters[lo:hi]):
                    lang[lo + i], score[lo + i] = names[i], sure[i]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, per_lang: int = 400, most_langs: int = 200) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs (doc_id, text, lang)``.

    Learns the ``most_langs`` most frequent languages from rows where ``held_out`` is
    false, about ``per_lang`` texts each (both bound the sample, drawn by a hash of
    the id); predicts from the whole text alone. ``score`` is the logistic of
    the least margin by which the family and the language won. A null text, one
    without a letter, or no language to learn from gives ``und`` and zero. Null
    ids count as an empty id text in the split; null languages are not learned
    from; repeated rows each give a row; other columns are not read. An empty
    table gives no rows.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out.alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), per_lang, most_langs)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out_remainder(doc_id: Column) -> Column:
    return bucket_of(doc_id, 5) == 0
