"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts is counted over every training text and then frozen, so
a document's code length needs no state from any other. At each byte the longest
known context predicts; a symbol it has not seen costs an escape (method C: one
count for each distinct successor), and the next shorter context then leaves out
the symbols the longer one already ruled out. Because a symbol seen after a
context was also seen after every suffix of it, what is left out at a suffix is a
fixed pair of numbers for each context, and scoring is table lookups on arrays.

Every gram of the training texts is in the trie, however rare. It is dealt out by
the last bytes of the context, so a part holds all that its contexts and their
suffixes need besides the shortest ones, which every part gets; there each gram of
any text meets its probability, escapes included. The ``max_nodes`` most frequent
grams are broadcast with theirs, as are the most frequent ``head_words`` words of at
most ``HEAD_BYTES`` bytes; all others meet theirs in a shuffle join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bucket_of, flat, small_batches, steps, texts
from seqloom.session import few_files, materialise

#: Stands before a text, for contexts that reach beyond its start; never a symbol.
PAD = 0xFF
#: Follows a text, as its last symbol.
END = 0xFE
#: Longest word that is broadcast.
HEAD_BYTES = 64
#: Rows of a partition's running counts before they are handed on.
FLUSH = 1_000_000
#: Grams of three bytes that may be broadcast; beyond it those of two, at most 65,536, are.
LOW = 1_000_000
#: Grams of a part of the trie.
PART = 1_000_000
_SEEN: dict[str, "_Table"] = {}


def _grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``order`` context bytes and a symbol, for each symbol of each text; offsets of the texts in them."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    at = np.arange(len(raw)) + np.repeat(np.arange(n) * (order + 1) + order, lens)
    buf = np.full(len(raw) + n * (order + 1), PAD, np.uint8)
    buf[at] = np.minimum(raw, END - 1)
    buf[offsets[1:] + np.arange(1, n + 1) * (order + 1) - 1] = END
    width, code, size = {1: buf}, buf, 1
    while size < order + 1:  # doubles the bytes of a code until they would be too many
        step = max(s for s in width if size + s <= order + 1)
        tail = width[step]
        m = len(buf) - size - step + 1
        code = (code[:m].astype(np.uint64) << np.uint64(8 * step)) | tail[size : size + m]
        size += step
        width[size] = code
    return code[buf[order:] != PAD], offsets + np.arange(n + 1)


def _counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
    else:
        by = np.argsort(codes, kind="stable")
        codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    sums = np.diff(np.r_[first, len(codes)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return codes[first], sums


def _count_partition(order: int):
    """Grams of all rows and words of training rows: ``n`` in training rows, ``m`` in all."""

    def run(batches):
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(grams, counts, some_words):
            g, w = len(grams), len(some_words)
            uses = pa.array(list(some_words.values()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(grams.astype(np.int64)), pa.nulls(w, pa.int64())]),
                    pa.concat_arrays([pa.nulls(g, pa.binary()), pa.array(list(some_words), pa.binary())]),
                    pa.concat_arrays([pa.array(counts[:, 0]), uses]),
                    pa.concat_arrays([pa.array(counts[:, 1]), uses]),
                ],
                names=["gram", "word", "n", "m"],
            )

        none = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for batch in batches:
            learn = batch.column("train")
            for weight, rows in ((1, batch.filter(learn)), (0, batch.filter(pc.invert(learn)))):
                raw, offsets = flat(rows.column("text"))
                for lo, hi in steps(offsets):
                    part = raw[offsets[lo] : offsets[hi]]
                    codes, n = _counted(_grams(part, offsets[lo : hi + 1] - offsets[lo], order)[0])
                    held.append((codes, np.stack([n * weight, n], axis=1)))
            for text in texts(batch.filter(learn).column("text")):
                words.update(text.lower().split())
                if len(words) > FLUSH // 4:
                    yield out(*none, words)
                    words = Counter()
            if sum(len(c) for c, _ in held) > FLUSH:
                held = [_counted(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > FLUSH // 2:
                    yield out(*held.pop(), {})
        if held:
            yield out(*_counted(*map(np.concatenate, zip(*held))), {})
        yield out(*none, words)

    return run


@dataclass
class Trie:
    """Frozen counts: for each length 1..order+1 the codes in order and how often each occurred."""

    order: int
    codes: list[np.ndarray]
    counts: list[np.ndarray]


@dataclass
class Head:
    """The most frequent grams and their log10 probabilities."""

    order: int
    codes: np.ndarray
    values: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class _Model:
    """Log10 probabilities of grams under a trie; ``known`` are those of its longest grams, in order."""

    def __init__(self, trie: Trie):
        self.order, self.entries, self.nodes = trie.order, [], []
        for o, (codes, counts) in enumerate(zip(trie.codes, trie.counts)):
            ctx, start = np.unique(codes >> np.uint64(8), return_index=True)
            node = np.repeat(np.arange(len(ctx), dtype=np.int32), np.diff(np.r_[start, len(codes)]))
            total = np.bincount(node, counts, len(ctx))
            kinds = np.bincount(node, minlength=len(ctx)).astype(float)
            left_n = left_k = np.zeros(len(ctx))
            if o:  # the suffix context: what remains there once this context's symbols are out
                low = np.uint64((1 << 8 * o) - 1)
                here, there = self.entries[o - 1], self.nodes[o - 1]
                used = np.bincount(node, here[1][np.searchsorted(here[0], codes & low)], len(ctx))
                suffix = np.searchsorted(there[0], ctx & np.uint64((1 << 8 * (o - 1)) - 1))
                left_n, left_k = there[1][suffix] - used, there[2][suffix] - kinds
            self.entries.append((codes, counts, node))
            self.nodes.append((ctx, total, kinds, left_n, left_k))
        codes, counts, node = self.entries[-1]
        _, total, kinds, _, _ = self.nodes[-1]
        self.codes, self.known = codes, np.log10(counts / (total + kinds)[node]) if len(codes) else counts

    def escaped(self, codes: np.ndarray) -> np.ndarray:
        """The whole rule, from the longest context down to equal shares."""
        out = np.zeros(len(codes))
        todo, above = np.arange(len(codes)), np.full(len(codes), -1)
        for o in range(self.order, -1, -1):
            entry, (ctx, total, kinds, _, _) = self.entries[o], self.nodes[o]
            if not len(ctx):
                continue
            want = (codes[todo] >> np.uint64(8)) & np.uint64((1 << 8 * o) - 1)
            node = np.minimum(np.searchsorted(ctx, want), len(ctx) - 1)
            known = ctx[node] == want
            gram = codes[todo] & np.uint64((1 << 8 * (o + 1)) - 1)
            at = np.minimum(np.searchsorted(entry[0], gram), len(entry[0]) - 1)
            seen = entry[0][at] == gram
            n, k = total[node].copy(), kinds[node].copy()
            from_longer = above[todo] >= 0
            if from_longer.any():
                longer = self.nodes[o + 1]
                n[from_longer], k[from_longer] = longer[3][above[todo][from_longer]], longer[4][above[todo][from_longer]]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, miss = np.log10(entry[1][at] / (n + k)), np.log10(k / (n + k))
            out[todo] += np.where(known, np.where(seen, hit, np.where(k > 0, miss, 0.0)), 0.0)
            above[todo] = np.where(known, node, -1)
            todo = todo[~seen]
        kinds = self.nodes[0][2]
        out[todo] -= math.log10(256 - (kinds[0] if len(kinds) else 0))
        return out


class _Table:
    """Open addressing, at most three quarters full, for the grams of the head."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(codes) // 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, ~np.uint64(0)), np.zeros(size, np.float32)
        slot, todo = self._slot(codes), np.arange(len(codes))
        while len(todo):
            free = self.keys[slot[todo]] == ~np.uint64(0)
            self.keys[slot[todo[free]]] = codes[todo[free]]  # of several the last one stays
            done = self.keys[slot[todo]] == codes[todo]
            self.values[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each gram, zero for those that are not in the table, and where those are."""
        slot = self._slot(codes)
        found = self.keys[slot]
        out = self.values[slot].astype(np.float64)
        todo = np.flatnonzero(found != codes)
        slot = slot[todo]
        unknown = np.zeros(len(codes), bool)
        while len(todo):
            empty = self.keys[slot] == ~np.uint64(0)
            unknown[todo[empty]], out[todo[empty]] = True, 0
            todo, slot = todo[~empty], (slot[~empty] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot] == codes[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo, slot = todo[~hit], slot[~hit]
        return out, unknown


def lookup(head: Head) -> _Table:
    """The head's table, made once in each Python worker."""
    if head.key not in _SEEN:
        _SEEN.clear()
        _SEEN[head.key] = _Table(head.codes, head.values)
    return _SEEN[head.key]


def _levels(codes: np.ndarray, counts: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the grams of that context length that end the given ones, and their counts."""
    return [_counted(codes & np.uint64((1 << 8 * (o + 1)) - 1), counts) for o in orders]


def _valued_partition(order: int, low_bc):
    def run(batches):
        """All grams of some contexts: those learned make the trie, and every one gets its probability."""
        got = [(b.column("gram").to_numpy().view(np.uint64), b.column("n").to_numpy(), b.column("m").to_numpy()) for b in batches]
        if not got:
            return
        codes, n, m = map(np.concatenate, zip(*got))
        del got
        shortest, low_codes, low_counts = low_bc.value
        learned = n > 0
        levels = _levels(low_codes, low_counts, range(shortest)) + _levels(codes[learned], n[learned], range(shortest, order + 1))
        model = _Model(Trie(order, [c for c, _ in levels], [k.astype(np.float64) for _, k in levels]))
        value = np.empty(len(codes), np.float32)
        value[learned] = model.known[np.searchsorted(model.codes, codes[learned])]
        value[~learned] = model.escaped(codes[~learned])
        for lo in range(0, len(codes), FLUSH // 8):
            part = slice(lo, lo + FLUSH // 8)
            yield pa.RecordBatch.from_arrays([pa.array(codes[part].view(np.int64)), pa.array(m[part]), pa.array(value[part])], names=["gram", "m", "value"])

    return run


def fit(docs: DataFrame, order: int = 5, max_nodes: int = 2_000_000) -> tuple[Head, DataFrame, DataFrame]:
    """Of ``docs (text, train)``: the head, ``(gram, m, value)`` of every gram of any text and ``(word, n)`` of the training texts.

    ``m`` counts a gram in all texts, ``value`` is its log10 probability as learned
    from all training texts. The head has at most ``max_nodes`` grams.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7: a gram is one 64-bit number")
    spark = docs.sparkSession
    counted = docs.select("text", "train").mapInArrow(_count_partition(order), "gram long, word binary, n long, m long")
    counted = materialise(counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-counts", compact=True)
    grams = counted.where("gram is not null").select("gram", "n", "m")
    for shortest in (min(3, order), min(2, order)):
        low = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND((1 << 8 * shortest) - 1).alias("code")).agg(F.sum("n").alias("n"))
        low = materialise(low, "lm-low", compact=True)
        if low.count() <= LOW:
            break
    low = low.toArrow()
    low = spark.sparkContext.broadcast((shortest, low.column("code").to_numpy().astype(np.uint64), low.column("n").to_numpy()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // PART))
    suffix = F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 8 * shortest) - 1)
    valued = grams.repartition(parts, suffix).mapInArrow(_valued_partition(order, low), "gram long, m long, value float")
    valued = materialise(valued, "lm-values", compact=True)
    most = 1 << 20
    kept, least = 0, 1 << 62
    for m, rows in sorted((tuple(r) for r in valued.groupBy(F.least("m", F.lit(most))).count().collect()), reverse=True):
        if (kept := kept + rows) > max_nodes:
            break
        least = m
    top = valued.where(F.col("m") >= least).select("gram", "value").toArrow()
    head = Head(order, top.column("gram").to_numpy().astype(np.uint64), top.column("value").to_numpy())
    return head, valued, counted.where("word is not null").select("word", "n")


_SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, head_sum double, score double, tail array<struct<word: binary, n: long>>, rest array<long>"


def _score_partition(trie_bc, head_bc):
    def run(batches):
        order, table, head = trie_bc.value.order, lookup(trie_bc.value), head_bc.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            score = np.zeros(len(batch))
            rest, ends = [np.zeros(0, np.uint64)], np.zeros(len(batch) + 1, np.int32)
            for lo, hi in steps(offsets):
                grams, at = _grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
                values, unknown = table(grams)
                score[lo:hi] = np.add.reduceat(values, at[:-1])
                rest.append(grams[unknown])
                ends[lo + 1 : hi + 1] = np.add.reduceat(unknown, at[:-1], dtype=np.int32)
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(np.concatenate(rest).view(np.int64)))
            n_tokens, sums, tails = [], [], []
            for text in texts(batch.column("text")):
                words = text.lower().split()
                total, tail = 0.0, []
                for w, n in Counter(words).items():
                    if (v := head.get(w)) is None:
                        tail.append({"word": w, "n": n})
                    else:
                        total += v * n
                n_tokens.append(len(words) + 1)
                sums.append(total)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(batch))), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(sums, pa.float64()), pa.array(score), pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), rest],
                names=["row_id", "doc_id", "held_out", "n_tokens", "head_sum", "score", "tail", "rest"],
            )
            row += len(batch)

    return run


def score_documents(docs: DataFrame, held_out: Column, order: int = 5, max_nodes: int = 2_000_000, head_words: int = 1 << 17) -> DataFrame:
    """Scores every text of ``docs (doc_id, text)`` with models learned where ``held_out`` is false.

    Gives ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``:
    ``base_score`` is the add-one unigram log10 probability of the lower-cased
    (A-Z) words and one end; ``score`` the trie's log10 probability of the text's
    bytes and one end. One row for each row of ``docs``.

    A null text counts as empty (one token, the end). A null or repeated
    ``doc_id`` is scored row by row. Extra columns are not read. Without training
    rows every base token has probability 1 and every byte 1/256. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", "text", held_out.alias("held_out"))
    train = rows.where(~F.col("held_out"))
    top, values, counts = fit(rows.select("text", F.coalesce(~F.col("held_out"), F.lit(False)).alias("train")), order, max_nodes)
    ends = train.count()
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    floor = math.log10(tokens + kinds + 1)
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    head = dict(zip((bytes(w) for w in head.column("word").to_pylist()), np.log10(head.column("n").to_numpy() + 1.0).tolist()))
    scored = rows.mapInArrow(_score_partition(spark.sparkContext.broadcast(top), spark.sparkContext.broadcast(head)), _SCORED)
    scored = materialise(scored, "lm-scored")
    tail = scored.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.word", F.col("t.n").alias("tf"))
    tail = tail.join(counts, "word", "left").groupBy("row_id").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("tail_sum"),
        F.sum(F.when(F.col("n").isNull(), F.col("tf")).otherwise(0)).alias("unknown"),
    )
    rare = scored.select("row_id", F.explode("rest").alias("gram")).join(values.select("gram", "value"), "gram")
    rare = rare.groupBy("row_id").agg(F.sum(F.col("value").cast("double")).alias("rest_sum"))
    end_sum, end_known = math.log10(ends + 1), int(ends > 0)
    out = scored.drop("tail", "rest").join(tail, "row_id", "left").join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - 1 + end_known - F.coalesce("unknown", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + end_sum - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("rest_sum", F.lit(0.0))).alias("score"),
    )
    return few_files(out)


def held_out_remainder(doc_id: Column) -> Column:
    return bucket_of(doc_id, 7) == 2
