"""Byte-pair encoding and decoding, long texts by tree concatenation.

A text longer than ``leaf_chars`` is halved until its leaves fit; leaves are rows
of their own and are encoded in parallel. A document's leaves then meet in one
task and are joined pairwise up the tree. At each join a window around the seam
is encoded again, and widened until both sides agree. What is agreed on makes the
result exact:

* a pre-token boundary that the window's scan and the right side's scan share:
  the scan has no memory, so both go on alike from there (boundaries so near to
  an end that more text could move them don't count), or
* inside one pre-token that spans the seam, the first token of the window with
  the left side's and the last with the right side's. Every adjacent pair of
  tokens then stands in an encoding that is known to be right, and a sequence is
  the encoding of its bytes if every adjacent pair is.

A window that reaches both outer ends is the encoding of the whole.

Pre-tokens are encoded by the tokenizers library, each distinct one about once in
a worker. Texts are split here only if they hold nothing but characters whose
class is known to be the library's; all others are split by the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches
from seqloom.session import few_files

#: A tokenizer file is broadcast, and must not be larger.
MOST_BYTES = 64 << 20
#: Shortest pre-token within which tokens, not boundaries, are compared.
LONG_WORD = 16
#: Pre-tokens a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: The byte-level pre-tokenizer's split, as Python's classes say it.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which Python's classes are not known to be the library's: separators 1C to 1F, fractions and raised digits, and all from 558 on.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0558-\U0010ffff]")
_LOADED: dict[str, "Coder"] = {}


class Coder:
    """A tokenizer as read from its JSON text, without truncation or padding."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(text)
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        # nothing further than this from an end of a text depends on what is beyond the end
        self.margin = max(map(len, self.added), default=0) + 4
        split, decoder = said.get("pre_tokenizer") or {}, said.get("decoder") or {}
        #: Whether the vocabulary is of bytes, split as SPLIT does and joined again without a change.
        self.bytes = (split.get("type"), split.get("use_regex", True), split.get("add_prefix_space")) == ("ByteLevel", True, False) and decoder.get("type") == "ByteLevel" and not said.get("normalizer")
        self.known: dict[str, bytes] = {}

    @cached_property
    def table(self) -> list[bytes]:
        """The bytes of each token."""
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = [b""] * (1 + max(self.tokenizer.get_vocab().values()))
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = token.encode() if token in self.added else bytes(byte[c] for c in token)
        return out

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.table], np.int64)

    def plain(self, text: str) -> bool:
        """Whether SPLIT splits this text as the library does."""
        return self.bytes and not ODD.search(text) and not any(a in text for a in self.added)

    def packed_words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(words).difference(self.known)
        long = {w: self._packed([w])[0] for w in new if len(w) > REMEMBERED_CHARS}
        # a blank and letters: many such can stand in one text, which splits at the blanks again
        spaced = [w for w in new if w[0] == " " and w not in long and w[1:].isalpha()]
        for lo in range(0, len(spaced), 512):
            part = spaced[lo : lo + 512]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.blank_first[ids])
            if len(at) != len(part):
                raise AssertionError("a pre-token was not encoded by itself")
            raw, at = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
            self.known.update(zip(part, (raw[i:j] for i, j in zip(at, at[1:]))))
        rest = [w for w in new.difference(spaced) if w not in long]
        self.known.update(zip(rest, self._packed(rest)))
        return [long[w] if w in long else self.known[w] for w in words] if long else list(map(self.known.__getitem__, words))

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def blank_first(self) -> np.ndarray:
        return np.array([x[:1] == b" " for x in self.table], bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plain = [self.plain(t) for t in texts]
        words = [SPLIT.findall(t) for t, p in zip(texts, plain) if p]
        packed = iter(self.packed_words([w for some in words for w in some]))
        ours = iter([b"".join(islice(packed, len(some))) for some in words])
        odd = [t for t, p in zip(texts, plain) if not p]
        theirs = iter(self._packed(odd))
        return [next(ours) if p else next(theirs) for p in plain]

    def decode(self, ids: list[int]) -> str:
        if self.bytes:
            try:
                return b"".join(map(self.table.__getitem__, ids)).decode()
            except UnicodeDecodeError:
                pass
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def piece(self, text: str, at: int = 0) -> "Piece":
        if self.plain(text):
            words = SPLIT.findall(text)
            packed = self.packed_words(words)
            return Piece(np.frombuffer(b"".join(packed), "<u4"), np.array([len(x) // 4 for x in packed], np.int64), np.array(list(map(len, words)), np.int64), at)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        low = np.array([a for a, _ in e.offsets], np.int64)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)]) if len(word) else np.zeros(0, np.int64)
        return Piece(np.array(e.ids, np.uint32), np.diff(np.r_[first, len(word)]), np.diff(np.r_[low[first], len(text)]), at)


def coder(text: str) -> Coder:
    """The coder, made once in each Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Coder(text)
    return _LOADED[key]


@dataclass
class Piece:
    """The exact encoding of a stretch of text from character ``start`` on: ids, and of each pre-token its tokens and characters."""

    ids: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    start: int

    @cached_property
    def low(self) -> np.ndarray:
        """Where each pre-token begins."""
        return self.start + np.cumsum(self.sizes) - self.sizes

    @cached_property
    def end(self) -> int:
        return self.start + int(self.sizes.sum())

    def cut(self, a: int, b: int) -> "Piece":
        """Its pre-tokens from a to b."""
        i, j = int(self.counts[:a].sum()), int(self.counts[:b].sum())
        return Piece(self.ids[i:j], self.counts[a:b], self.sizes[a:b], self.start + int(self.sizes[:a].sum()))

    def packed(self) -> bytes:
        """As few bytes as the largest values allow; :meth:`unpacked` reads them."""
        parts = (self.ids, self.counts, self.sizes)
        widths = [next(w for w in (1, 2, 4) if int(x.max(initial=0)) < 1 << 8 * w) for x in parts]
        head = np.array([v for x, w in zip(parts, widths) for v in (len(x), w)], "<i8").tobytes()
        return head + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(parts, widths))

    @classmethod
    def unpacked(cls, data: bytes, start: int) -> "Piece":
        head, parts, at = np.frombuffer(data, "<i8", 6).tolist(), [], 48
        for n, w in zip(head[::2], head[1::2]):
            parts.append(np.frombuffer(data, f"<u{w}", n, at))
            at += n * w
        return cls(parts[0].astype(np.uint32), parts[1].astype(np.int64), parts[2].astype(np.int64), start)


def _joined(*pieces: Piece) -> Piece:
    return Piece(*(np.concatenate([getattr(p, k) for p in pieces]) for k in ("ids", "counts", "sizes")), pieces[0].start)


def join(text: str, left: Piece, right: Piece, coder: Coder, width: int = 32) -> Piece:
    """The encoding of the two pieces' text as one; ``text`` is the whole document."""
    seam = left.end
    while True:
        reach = max(width, coder.margin)
        i = max(0, int(np.searchsorted(left.low, seam - reach, "right")) - 1)
        j = int(np.searchsorted(right.low, seam + reach))
        s, e = int(left.low[i]), int(right.low[j]) if j < len(right.low) else right.end
        whole = s == left.start and e == right.end
        if e - s <= 8 * reach or whole:
            mid = coder.piece(text[s:e], s)
            if whole:
                return mid
            if e == right.end:
                return _joined(left.cut(0, i), mid)
            shared = np.intersect1d(mid.low[(mid.low >= seam) & (mid.low <= e - coder.margin)], right.low)
            if len(shared):
                m, k = int(np.searchsorted(mid.low, shared[0])), int(np.searchsorted(right.low, shared[0]))
                return _joined(left.cut(0, i), mid.cut(0, m), right.cut(k, len(right.sizes)))
        if (found := _within_word(text, left, right, coder, reach)) is not None:
            return found
        width *= 2


def _edges(ids: np.ndarray, raw: bytes, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Ends of tokens in their bytes, and which of them are between characters."""
    ends = np.cumsum(coder.lengths[ids])
    after = np.frombuffer(raw + b" ", np.uint8)[ends]
    return ends, (after & 0xC0) != 0x80


def _within_word(text: str, left: Piece, right: Piece, coder: Coder, reach: int) -> Piece | None:
    """A join inside a pre-token that spans the seam, if the tokens at both edges of the window agree."""
    seam, p, q = left.end, int(left.low[-1]), right.start + int(right.sizes[0])
    if not coder.bytes or min(seam - p, q - seam) < LONG_WORD or text[seam].isspace() or text[seam - 1].isspace():
        return None
    own, theirs = left.ids[len(left.ids) - left.counts[-1] :], right.ids[: right.counts[0]]
    before, after = text[p:seam].encode(), text[seam:q].encode()
    low, low_clean = _edges(own, before, coder)
    high, high_clean = _edges(theirs, after, coder)
    if len(low) == 0 or low[-1] != len(before) or high[-1] != len(after):
        return None  # an added token
    i = np.flatnonzero(low_clean[:-1] & (low[:-1] <= len(before) - reach))
    j = np.flatnonzero(high_clean & (high >= reach))
    if not len(i) or not len(j):
        return None
    i, j = int(i[-1]), int(j[0])
    mid = coder.piece((before[low[i] :] + after[: high[j]]).decode())
    if len(mid.sizes) != 1 or mid.ids[0] != own[i + 1] or mid.ids[-1] != theirs[j]:
        return None
    ids = np.concatenate([own[: i + 1], mid.ids, theirs[j + 1 :]])
    word = Piece(ids, np.array([len(ids)]), np.array([q - p]), p)
    return _joined(left.cut(0, len(left.sizes) - 1), word, right.cut(1, len(right.sizes)))


def leaves(n: int, most: int) -> list[tuple[int, int]]:
    """Halves of halves of ``n`` characters, until each has at most ``most``."""
    if n <= most:
        return [(0, n)]
    half = n // 2
    return leaves(half, most) + [(a + half, b + half) for a, b in leaves(n - half, most)]


def concatenated(text: str, pieces: list[Piece], coder: Coder) -> Piece:
    """Joins neighbours, then neighbours of those, up to the root."""
    while len(pieces) > 1:
        pieces = [join(text, *pieces[k : k + 2], coder) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(doc_ids: list, packed: list[bytes], coder: Coder) -> pa.RecordBatch:
    decoded = (coder.decode(np.frombuffer(ids, "<u4").tolist()) for ids in packed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array([len(ids) // 4 for ids in packed], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids in packed], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _short(vocabulary):
    def run(batches):
        c = coder(vocabulary.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield _digest(part.column("doc_id").to_pylist(), c.encode([t or "" for t in part.column("text").to_pylist()]), c)

    return run


def _cut(leaf_chars: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                at = leaves(len(text), leaf_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at)), pa.array([doc_id] * len(at), pa.int64()), pa.array([a for a, _ in at], pa.int64()), pa.array([text[a:b] for a, b in at])], names=["row_id", "doc_id", "at", "leaf"]
                )

    return run


def _encode_leaves(vocabulary):
    def run(batches):
        c = coder(vocabulary.value)
        for batch in batches:
            got = [c.piece(t, a) for t, a in zip(batch.column("leaf").to_pylist(), batch.column("at").to_pylist())]
            packed = [p.packed() for p in got]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "at")), pa.array(packed, pa.binary())], names=["row_id", "doc_id", "at", "tokens"])

    return run


def _join_leaves(vocabulary):
    def run(group: pa.Table) -> pa.Table:
        c = coder(vocabulary.value)
        rows = sorted(zip(group.column("at").to_pylist(), group.column("tokens").to_pylist()))
        pieces = [Piece.unpacked(data, at) for at, data in rows]
        text = "".join(c.decode(p.ids.tolist()) for p in pieces)  # a leaf's tokens hold its text
        ids = concatenated(text, pieces, c).ids.astype("<u4").tobytes()
        return pa.Table.from_batches([_digest(group.column("doc_id").slice(0, 1).to_pylist(), [ids], c)])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, leaf_chars: int = 16_384) -> DataFrame:
    """Encodes and decodes every text of ``docs (doc_id, text)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The result is that of the tokenizers library on the whole text, without added
    special tokens; the digests are of the ids as little-endian 32-bit integers
    and of the decoded text in UTF-8. One row for each row: a null text counts as
    empty (no tokens), a null or repeated ``doc_id`` changes nothing. An empty
    table gives no rows; other columns are not read. Only texts of over
    ``leaf_chars`` characters are shuffled, as leaves. Leaves travel as tokens, which
    hold their text where the vocabulary is of bytes; texts for any other tokenizer
    (with a normaliser, or unknown tokens) are encoded whole, each in a task.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"the tokenizer file has over {MOST_BYTES} bytes")
    vocabulary = docs.sparkSession.sparkContext.broadcast(text)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not Coder(text).bytes:
        return rows.mapInArrow(_short(vocabulary), _RESULT)
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf_chars
    short = rows.where(~is_long).mapInArrow(_short(vocabulary), _RESULT)
    cut = rows.where(is_long).mapInArrow(_cut(leaf_chars), "row_id long, doc_id long, at long, leaf string")
    encoded = cut.repartition("row_id", "at").mapInArrow(_encode_leaves(vocabulary), "row_id long, doc_id long, at long, tokens binary")
    long = encoded.groupBy("row_id").applyInArrow(_join_leaves(vocabulary), _RESULT)
    return short.unionByName(few_files(long))
