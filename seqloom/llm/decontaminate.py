"""Benchmark decontamination: rare gapped word pairs as seeds, then local alignment.

The similarity of a text and a test item is their Smith-Waterman score (match 2,
other word or gap -1) as a share of the item's score against itself. An alignment
with m matches and e errors scores 2m - e, so one of similarity s with an item of n
words has e <= 2m - 2sn; at most m - sn of the m - 1 steps from one match to the next
have two errors or more, and at least sn - 1 steps have one error at most. Such a
step is a pair of words that stand side by side or one word apart, in the item and in
the text. These gapped pairs are the seeds: an alignment that counts shows them at sn
- 1 places of the item or more, so the item's commonest places may be left out as long
as fewer than that are, and what is left still meets every text that has to be found.

The pairs are counted over all documents, and of each item the rarest places are
kept. Where a document holds one, the words around it, as far as an alignment can
reach, are aligned with the item if all of the item's pairs show at enough places.
Items are held in blocks of a bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches

#: Bytes of items that one block holds, and so what is broadcast.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: ASCII marks stand for blanks.
BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Documents that one step reads.
STEP_ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BLANK).split()


def fewest_places(size: int, least: float) -> int:
    """At how many places of an item an alignment of similarity ``least`` shows a gapped pair."""
    return max(0, math.ceil(least * size - 1e-9) - 1)


@dataclass
class Block:
    """Test items as word numbers, and their gapped pairs: code, and where each occurs.

    An item of one or two words shows no pair in a part of it, so its seed is all
    of it: the word, as a pair with itself at no distance, or the pair side by side.
    """

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]
    grams: np.ndarray = None
    first: np.ndarray = None  # of a pair in the next two
    item: np.ndarray = None
    offset: np.ndarray = None
    words: np.ndarray = None  # of items of one word
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> "Block":
        vocabulary: dict[bytes, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
        self = cls(ids, items, vocabulary)
        found = [(i, *self.pairs(x, len(x) > 2)) for i, x in enumerate(items)]
        none = [np.zeros(0, np.int64)]
        self._index(np.concatenate(none + [c for _, _, c in found]), np.concatenate(none + [np.full(len(c), i) for i, _, c in found]), np.concatenate(none + [at for _, at, _ in found]))
        self.words = np.unique(np.concatenate(none + [x for x in items if len(x) == 1]))
        return self

    def _index(self, code: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        by = np.lexsort((offset, item, code))
        code, self.item, self.offset = code[by], item[by], offset[by]
        self.grams, first = np.unique(code, return_index=True)
        self.first = np.r_[first, len(code)]

    def pairs(self, words: np.ndarray, gapped: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the pairs of known words side by side and one word apart; of a single word its code."""
        v = len(self.vocabulary) + 1
        at, code = [], []
        for step in (1, 2) if gapped else (1,):
            a, b = words[:-step], words[step:]
            ok = np.flatnonzero((a >= 0) & (b >= 0))
            at.append(ok)
            code.append(a[ok] * v + b[ok])
        if not gapped and len(words) == 1:
            return np.zeros(1, np.int64), words * v + v - 1
        return np.concatenate(at), np.concatenate(code)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a pair of the block, and the pair's number."""
        at, code = self.pairs(words)
        if len(self.words):
            alone = np.flatnonzero(np.isin(words, self.words))
            at, code = np.r_[at, alone], np.r_[code, words[alone] * (len(self.vocabulary) + 1) + len(self.vocabulary)]
        if not len(self.grams) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[g] == code)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return at[hit], g[hit]

    def rare(self, df: np.ndarray, least: float) -> "Block":
        """The block with seeds only: of each item the rarest places, as many as any alignment that counts must show one of."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        keep = np.zeros(len(gram), bool)
        by_item = np.argsort(self.item, kind="stable")
        for rows in np.split(by_item, np.flatnonzero(np.diff(self.item[by_item])) + 1) if len(gram) else ():
            places = np.bincount(self.offset[rows], df[gram[rows]])  # a place is as frequent as its pairs together
            needed = len(places) - max(0, fewest_places(len(self.items[self.item[rows[0]]]), least) - 1)
            keep[rows] = np.isin(self.offset[rows], np.argsort(places, kind="stable")[: max(1, needed)])
        out = Block(self.ids, self.items, self.vocabulary, words=self.words)
        out._index(self.grams[gram[keep]], self.item[keep], self.offset[keep])
        return out


#: A score and, where scores are equal, the equal words are one number; equal words count in the lower bits.
BITS = 32


def _program(item: np.ndarray, window: np.ndarray, local: bool) -> tuple[int, int, int]:
    """Best packed score of an alignment, where it ends in the item and in the window; of two rows at a time.

    A ``local`` alignment begins anywhere, else with the first words of both.
    """
    m = len(window)
    match, other, gap = (MATCH << BITS) + 1, MISMATCH << BITS, GAP << BITS
    ramp = np.arange(m + 1, dtype=np.int64) * -gap
    above = np.zeros(m + 1, np.int64) if local else -ramp
    best, row, column = 0, 0, 0
    for i, word in enumerate(item, 1):
        here = np.empty(m + 1, np.int64)
        here[0] = 0 if local else gap * i
        np.maximum(above[:-1] + np.where(window == word, match, other), above[1:] + gap, out=here[1:])
        if local:
            np.maximum(here, 0, out=here)
        above = np.maximum.accumulate(here + ramp) - ramp
        j = int(above.argmax())
        if above[j] > best:
            best, row, column = int(above[j]), i, j
    return best, row, column


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, begin and end in the window, and equal words; the most equal words of the best ones.

    A second program runs from its end backwards to where it begins, so nothing
    larger than a row is held.
    """
    best, row, column = _program(item, window, True)
    if not best:
        return 0, 0, 0, 0
    size = MATCH * row + 1  # words of the window that an alignment of so many words of the item can span
    low = max(0, column - size)
    back, _, length = _program(item[:row][::-1], window[low:column][::-1], False)
    assert back == best
    return best >> BITS, column - length, column, best & ((1 << BITS) - 1)


def matches(block: Block, words: np.ndarray, at: np.ndarray, gram: np.ndarray, least: float) -> list[tuple]:
    """``(item, similarity, begin, end, equal words)`` of each item with a window of the document at ``least`` or above; the best of an item."""
    count = block.first[gram + 1] - block.first[gram]
    place = np.repeat(at, count)
    entry = np.repeat(block.first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
    item, diagonal = block.item[entry], place - block.offset[entry]
    by = np.lexsort((diagonal, item))
    item, diagonal, place = item[by], diagonal[by], place[by]
    out = []
    for rows in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
        k = int(item[rows[0]])
        own = block.items[k]
        size = len(own)
        if size < 3:  # found only as a whole, so where its seed is
            if size == 1 or len(rows := rows[words[np.minimum(place[rows] + 1, len(words) - 1)] == own[-1]]):
                begin = int(place[rows[0]])
                out.append((k, 1.0, begin, begin + size, size))
            continue
        slack = int(MATCH * size * (1 - least)) + 1  # errors that an alignment can have
        d = diagonal[rows]
        best = None
        # a window reaches as far as errors can shift an alignment from each diagonal; those that overlap are one
        for part in np.split(d, np.flatnonzero(np.diff(d) > size + 2 * slack) + 1):
            lo, hi = max(0, int(part[0]) - slack), min(len(words), int(part[-1]) + size + slack)
            window = words[lo:hi]
            if not _may_hold(block, own, window, least):
                continue
            score, a, b, same = align(own, window)
            found = (score / (MATCH * size), -(lo + a), lo + b, same)
            best = found if best is None or found > best else best
        if best is not None and best[0] >= least:
            out.append((k, best[0], -best[1], best[2], best[3]))
    return out


def _may_hold(block: Block, own: np.ndarray, window: np.ndarray, least: float) -> bool:
    """Whether the window has as many of the item's words, and of its places with a pair, as an alignment that counts."""
    if np.isin(own, window).sum() < least * len(own):
        return False
    at, code = block.pairs(own)
    return len(np.unique(at[np.isin(code, block.pairs(window)[1])])) >= fewest_places(len(own), least)


def _numbered(block: Block, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, an unknown one after each, and where each text begins."""
    all_words: list[bytes] = []
    start = []
    for t in texts:
        start.append(len(all_words))
        all_words += words_of(t)
        all_words.append(b"")
    return np.fromiter(map(block.vocabulary.get, all_words, repeat(-1)), np.int64, len(all_words)), np.array([*start, len(all_words)])


def _parts(batch):
    for lo in range(0, len(batch), STEP_ROWS):
        yield batch.slice(lo, STEP_ROWS)


def _gram_counts(block_bc):
    def run(batches):
        block = block_bc.value
        df = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for part in _parts(batch):
                words, start = _numbered(block, part.column("text").to_pylist())
                at, gram = block.hits(words)
                doc = np.searchsorted(start, at, "right")
                seen = np.unique(doc * (len(block.grams) + 1) + gram)
                df += np.bincount(seen % (len(block.grams) + 1), minlength=len(df)) if len(seen) else 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["gram", "df"])

    return run


_FOUND = "doc_id long, item_id long, similarity double, word_start long, word_end long, equal_words long"


def _search(block_bc, least: float):
    def run(batches):
        block = block_bc.value
        for batch in batches:
            out = []
            for part in _parts(batch):
                words, start = _numbered(block, part.column("text").to_pylist())
                at, gram = block.hits(words)
                doc = np.searchsorted(start, at, "right") - 1
                ids = part.column("doc_id").to_pylist()
                for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else ():
                    d = int(doc[rows[0]])
                    own = words[start[d] : start[d + 1] - 1]
                    out += [(ids[d], block.ids[k], *rest) for k, *rest in matches(block, own, at[rows] - start[d], gram[rows], least)]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _clean(block_bc, least: float):
    """Passes on the rows whose text holds no item."""

    def run(batches):
        block = block_bc.value
        for batch in batches:
            for part in _parts(batch):
                words, start = _numbered(block, part.column("text").to_pylist())
                at, gram = block.hits(words)
                doc = np.searchsorted(start, at, "right") - 1
                clean = np.ones(len(part), bool)
                for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else ():
                    d = int(doc[rows[0]])
                    clean[d] = not matches(block, words[start[d] : start[d + 1] - 1], at[rows] - start[d], gram[rows], least)
                yield part.filter(pa.array(clean))

    return run


def _seeded_blocks(docs: DataFrame, benchmark: DataFrame, least: float):
    """Each block of items with its seeds, broadcast."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be above 0 and at most 1")
    context = small_batches(docs).sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        some = some.toArrow()
        block = Block.of(some.column("item_id").to_pylist(), some.column("text").to_pylist())
        counts = docs.select("text").mapInArrow(_gram_counts(context.broadcast(block)), "gram long, df long")
        counts = counts.groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block.grams), np.int64)
        df[counts.column("gram").to_numpy()] = counts.column("df").to_numpy()
        yield context.broadcast(block.rare(df, least))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, item_id, similarity, word_start, word_end, equal_words``: documents that hold a test item, or an edited copy.

    ``docs (doc_id, text)``, ``benchmark (item_id, text)``. Words are lower-cased,
    ASCII marks are blanks. ``similarity`` is the alignment score (match 2, other
    word or gap -1) over the item's own; every document row and item row of at least
    ``least`` gives one row, with the span of the best place in words (of several the
    first) and how many of them are equal. An item of one or two words is found only
    whole. Items without words, null texts among them, are never found; null document
    texts hold nothing. Null ids stay null; repeated rows on either side each give
    rows. Empty tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [rows.mapInArrow(_search(block, least), _FOUND) for block in _seeded_blocks(rows, benchmark, least)]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`contaminated` does not name, with all their columns; nothing is shuffled."""
    out = docs
    for block in _seeded_blocks(docs, benchmark, least):
        out = out.mapInArrow(_clean(block, least), docs.schema)
    return out
