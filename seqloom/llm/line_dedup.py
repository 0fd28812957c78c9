"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines (those with words) puts one
boundary of a chunk there: if it is even, chunks may end behind the second line, if
odd, they may begin with the first. From each line on, a chunk goes to the first such
end by which it has ``min_words`` words; up to each line, one comes from the last such
beginning. So a chunk depends on nothing but its own lines, an insertion moves no
boundary but those next to it, and the lines of a repeated passage, its edges
included, lie in chunks that the copies share: any two neighbours with ``min_words``
words do, and all but one in some hundred lines of longer passages of very short
lines. No chunk has more than ``most_lines``
lines: in a stretch without ends all pairs are beginnings, and the chunks that come
from these cover it.

A line of ``long_words`` words or more is a paragraph that was never wrapped, and a
chunk of its own besides. Chunks are compared over all documents: first by hash, then
those with a repeated hash byte by byte.

A line goes if it lies in a chunk whose bytes occur earlier: in a document of a
smaller id, or further up in the same one. The first occurrence of a line lies
only in first occurrences of chunks, so of every line at least one copy stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, texts
from seqloom.session import materialise

LONG_WORDS, MIN_WORDS, MOST_LINES = 50, 10, 32
#: Hashes that may be broadcast (8 bytes each), and marks of lines (1 byte each) of documents (24 bytes each).
BROADCAST_HASHES, BROADCAST_MARKS, BROADCAST_DOCS = 2_000_000, 16_000_000, 500_000
#: Stands for a null id: it comes last.
LAST = (1 << 63) - 1


def spans(words: list[int], even: list[bool], long_words: int, min_words: int, most_lines: int) -> set[tuple[int, int]]:
    """First and last line of each chunk; ``even[i]`` is of the lines ``i - 1`` and ``i``."""
    n, out = len(words), {(i, i) for i, w in enumerate(words) if w >= long_words}
    for i in range(n):
        total = words[i]
        for j in range(i + 1, min(n, i + most_lines)):
            total += words[j]
            if total >= min_words and even[j]:
                out.add((i, j))
                break
        total = words[i]
        for j in range(i - 1, max(-1, i - most_lines), -1):
            total += words[j]
            if total >= min_words and not even[j + 1]:
                out.add((j, i))
                break
    return out


def chunks(text: bytes, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, most_lines: int = MOST_LINES):
    """``(start, lines, bytes)`` of the chunks of a text in order, each span once."""
    every = text.split(b"\n")
    words = [len(line.split()) for line in every]
    at = [i for i, w in enumerate(words) if w]
    if not at:
        return
    words, even, before = [words[i] for i in at], [], 0
    for i in at:
        here = int.from_bytes(hashlib.md5(every[i]).digest()[:4], "big")
        even.append((31 * before + here) >> 16 & 1 == 0)
        before = here
    for a, b in sorted(spans(words, even, long_words, min_words, most_lines)):
        a, b = at[a], at[b] + 1
        yield a, b - a, b"\n".join(every[a:b])


def _hash(chunk: bytes, bits: int) -> int:
    h = xxhash.xxh64_intdigest(chunk) & ((1 << bits) - 1)
    return h - (1 << 64) if h >> 63 else h


def _listed(options, bits):
    """All chunks by hash; ``again`` if the same bytes stood further up in the document."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, text in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), texts(batch.column("text"))):
                seen: set[bytes] = set()
                for start, n, chunk in chunks(text, *options):
                    out.append((doc, key, start, n, _hash(chunk, bits), chunk in seen))
                    seen.add(chunk)
            c = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["doc", "key", "start", "n", "hash", "again"])

    return run


_LISTED = "doc long, key long, start int, n int, hash long, again boolean"
_SPOKEN = _LISTED + ", chunk binary"


def _spoken(options, bits, wanted):
    """The bytes of the chunks whose hash is wanted: those broadcast, in order, or listed in the row."""

    def run(batches):
        for batch in batches:
            found = [(i, start, n, _hash(chunk, bits), chunk) for i, text in enumerate(texts(batch.column("text"))) for start, n, chunk in chunks(text, *options)]
            h = np.array([x[3] for x in found], np.int64)
            if wanted is not None:
                every = wanted.value
                at = np.minimum(np.searchsorted(every, h), max(0, len(every) - 1))
                hit = every[at] == h if len(every) else np.zeros(len(h), bool)
            else:
                own = [set(x) for x in batch.column("wanted").to_pylist()]
                hit = np.array([x[3] in own[x[0]] for x in found], bool)
            docs, keys, out, seen = batch.column("doc").to_pylist(), batch.column("key").to_pylist(), [], set()
            for k in np.flatnonzero(hit):
                i, start, n, value, chunk = found[k]
                out.append((docs[i], keys[i], start, n, value, (i, chunk) in seen, chunk))
                seen.add((i, chunk))
            c = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["doc", "key", "start", "n", "hash", "again", "chunk"])

    return run


def _marked(batches):
    """For each document whether each line goes."""
    for batch in batches:
        marks = []
        for spans in batch.column("spans").to_pylist():
            gone = np.zeros(max(s["start"] + s["n"] for s in spans), bool)
            for s in spans:
                gone[s["start"] : s["start"] + s["n"]] = True
            marks.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(marks, pa.list_(pa.bool_()))], names=["doc", "key", "gone"])


def removals(docs: DataFrame, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, most_lines: int = MOST_LINES, hash_bits: int = 64) -> DataFrame:
    """``(doc, key, gone array<boolean>)`` of the documents that lose lines; ``doc`` and ``key`` as of :func:`keyed`."""
    options = (long_words, min_words, most_lines)
    rows = keyed(small_batches(docs)).select("doc", "key", "text").where("text is not null")
    listed = materialise(rows.mapInArrow(_listed(options, hash_bits), _LISTED), "chunks")
    repeated = materialise(listed.groupBy("hash").agg(F.count("*").alias("rows")).where("rows > 1").select("hash"), "repeated", compact=True)
    if repeated.count() <= BROADCAST_HASHES:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column("hash").to_numpy()))
        spoken = rows.mapInArrow(_spoken(options, hash_bits, wanted), _SPOKEN)
    else:
        lists = listed.join(repeated, "hash").groupBy("doc", "key").agg(F.collect_set("hash").alias("wanted"))
        spoken = rows.join(lists, ["doc", "key"]).select("doc", "key", "text", "wanted").mapInArrow(_spoken(options, hash_bits, None), _SPOKEN)
    same = materialise(spoken.groupBy("hash", "chunk").agg(F.min("doc").alias("first")).groupBy("hash").agg(F.min("first").alias("first"), F.count("*").alias("texts")), "first-chunks", compact=True)
    # one text behind a hash: its bytes are equal wherever the hash is; the others are told apart by their bytes
    late = listed.join(same.where("texts = 1"), "hash").where("again or first < doc").select("doc", "key", "start", "n")
    if same.where("texts > 1").limit(1).count():
        mixed = spoken.join(same.where("texts > 1").select("hash"), "hash")
        least = mixed.groupBy("hash", "chunk").agg(F.min("doc").alias("first"))
        late = late.unionByName(mixed.join(least, ["hash", "chunk"]).where("again or first < doc").select("doc", "key", "start", "n"))
    spans = late.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return materialise(spans.mapInArrow(_marked, "doc long, key long, gone array<boolean>"), "gone-lines", compact=True)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc`` (the id, null last) and ``key`` (a hash of the text): rows alike in both are copies of one row."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "key": F.xxhash64("text")})


def dedup_lines(docs: DataFrame, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, most_lines: int = MOST_LINES, hash_bits: int = 64, removed: str = "lines_removed") -> DataFrame:
    """``docs`` with ``text`` less the lines that repeat what stands earlier, and how many were ``removed``; every row stays.

    A document that is a copy loses all its lines and keeps an empty text. A null
    text stays null. Rows with one ``doc_id`` count as one document, and a null id
    comes after all others; exact repetitions of a row are treated alike. A text
    without a line end is one line. Columns of ``docs`` keep their names and
    order; one with the name of the new one is replaced. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != removed]
    gone = removals(docs, long_words, min_words, most_lines, hash_bits).withColumnsRenamed({"doc": "__doc", "key": "__key", "gone": "__gone"})
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()
    if size[0] <= BROADCAST_DOCS and size[1] <= BROADCAST_MARKS:
        gone = F.broadcast(gone)
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"), F.xxhash64("text").alias("__key"))
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(F.coalesce(F.get("__gone", i), F.lit(False)), F.lit(None)).otherwise(line))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    count = F.when(F.col("__gone").isNull(), 0).otherwise(F.size(F.filter("__gone", lambda x: x))).cast("long")
    joined = rows.join(gone, ["__doc", "__key"], "left")
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in columns), count.alias(removed))
