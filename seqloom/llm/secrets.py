"""Secret scans: fixed patterns, and a lexer for assignments with constant propagation.

The lexer reads source and configuration syntax (``name = "x"``, ``name: x``,
``"name": "x"``, ``name := x``, ``name => x``, ``a + "b"``) into pairs of a name and
the literals that make up its value. A name on the right side stands for what
was last assigned to it. A literal is reported when the words of the name it
reaches are those of secrets and the literal itself looks like one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, texts

#: Fixed patterns; letters of ``assign`` in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: A name and the operator that gives it a value. Starts only where a word does and never gives back, so a text takes linear time.
TARGET = re.compile(r"""(?<![\w.\-])(?P<quote>["'`]?)(?P<name>[A-Za-z_][\w.\-]*+)(?P=quote)\]?[ \t]*+(?::=|=>|=(?!=)|:(?![:/=]))[ \t]*+""")
#: A part of a value: quoted, or a run up to a blank or separator.
PART = re.compile(r"""(?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)|[^\s"'`;,(){}\[\]]++""")
PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
#: Weights of name words: what they say about the value being secret.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "private": 0.4, "access": 0.3,
    "api": 0.4, "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.2, "cookie": 0.4, "salt": 0.4,
}
#: Words that make a name speak of something about the secret rather than of it.
ABOUT_WORDS = {"path", "file", "url", "uri", "name", "length", "len", "count", "type", "hint", "field", "label", "prompt", "max", "min", "expires", "expiry", "ttl", "id", "public", "header", "policy"}
PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|placeholder|password|secret|token|null|none|true|false|undefined|todo|test|x+|\*+|\.+|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Name score times literal score from which a literal is reported.
LEAST = 0.5


#: Characters of a value that are kept as they are; of a longer one its make-up is.
KEPT_CHARS = 4096
#: Length at which the make-up of a value stops growing, as a value that doubles with each line would.
MOST_CHARS = 1e15


def name_score(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    score = sum(NAME_WORDS.get(w, 0.0) for w in set(words))
    return min(1.0, score) * (0.3 if ABOUT_WORDS & set(words) else 1.0)


@dataclass(frozen=True)
class Makeup:
    """What the score needs to know of a value too long to keep: its length, and how often each low byte of a character occurs."""

    length: float
    counts: np.ndarray
    kinds: int
    spaced: bool

    @classmethod
    def of(cls, value: str) -> "Makeup":
        codes = np.frombuffer(value.encode("utf-32-le", "replace"), np.uint32)
        kinds = sum(bit for bit, f in KINDS_OF if any(map(f, value)))
        return cls(float(len(value)), np.bincount(codes & 255, minlength=256).astype(float), kinds, any(map(str.isspace, value)))

    def __add__(self, other: "Makeup") -> "Makeup":
        length = self.length + other.length
        shrink = min(1.0, MOST_CHARS / length) if length else 1.0
        return Makeup(length * shrink, (self.counts + other.counts) * shrink, self.kinds | other.kinds, self.spaced or other.spaced)


KINDS_OF = ((1, str.islower), (2, str.isupper), (4, str.isdigit), (8, lambda c: not c.isalnum()))


def _scored(length: float, bits: float, kinds: int) -> float:
    return min(1.0, 0.15 * kinds + bits / 6 + (0.2 if length >= 12 else 0.0))


def literal_score(value: str | Makeup) -> float:
    """0 for placeholders and short or plain words, to 1 for long mixed ones."""
    if isinstance(value, Makeup):
        share = value.counts[value.counts > 0] / max(1.0, value.length)
        return 0.0 if value.spaced else _scored(value.length, float(-(share * np.log2(share)).sum()), value.kinds.bit_count())
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return _scored(len(value), bits, sum(any(map(f, value)) for _, f in KINDS_OF))


@dataclass(eq=False)
class Value:
    """What a name stands for: spans of literals and values assigned before, in order, and all of it as one text."""

    spans: list[tuple[int, int]]
    parts: list["Value"]
    text: str | Makeup
    score: float = 0.0


def _joined_text(pieces: list[str | Makeup]) -> str | Makeup:
    if all(isinstance(p, str) for p in pieces) and sum(map(len, pieces)) <= KEPT_CHARS:
        return "".join(pieces)
    made = [p if isinstance(p, Makeup) else Makeup.of(p) for p in pieces]
    return sum(made[1:], made[0])


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """``(name, value)`` of each assignment in order, constants propagated; ``a = b = "x"`` gives both names.

    A value refers to the values that it is made of, so it takes no more room than its own line,
    however often what it refers to is doubled.
    """
    known: dict[str, Value] = {}
    at = 0
    while m := TARGET.search(text, at):
        names = [m["name"]]
        while n := TARGET.match(text, m.end()):
            m = n
            names.append(m["name"])
        at = m.end()
        spans, parts, pieces = [], [], []
        while part := PART.match(text, at):
            at, value = part.end(), part.group()
            if part["quoted"]:
                spans.append((part.start() + 1, part.end() - 1))
                pieces.append(value[1:-1])
            elif all(v in known for v in value.split("+")):
                parts += (known[v] for v in value.split("+"))
                pieces += (known[v].text for v in value.split("+"))
            else:
                spans.append((part.start(), part.end()))
                pieces.append(value)
            if not (more := PLUS.match(text, at)):
                break
            at = more.end()
        if pieces:
            # a name of a name is the same value
            value = parts[0] if len(parts) == 1 and not spans else Value(spans, parts, _joined_text(pieces))
            for name in names:
                known[name] = value
                yield name, value


def literals(text: str) -> dict[tuple[int, int], float]:
    """Spans of reported literals and their scores; a value of several parts is scored as a whole.

    The score of a value reaches everything that it is made of: values are looked at
    from the last to the first, so each hands on the greatest score it got.
    """
    out: dict[tuple[int, int], float] = {}
    if "=" not in text and ":" not in text:
        return out
    values: dict[int, Value] = {}
    names: dict[str, float] = {}
    for name, value in pairs(text):
        values.setdefault(id(value), value)
        if name not in names:
            names[name] = name_score(name)
        if (s := names[name]) and (s := s * literal_score(value.text)) >= LEAST:
            value.score = max(value.score, s)
    for value in reversed(values.values()):
        if value.score:
            for part in value.parts:
                part.score = max(part.score, value.score)
            for span in value.spans:
                if span[1] > span[0]:
                    out[span] = max(value.score, out.get(span, 0.0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in code points."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long, score double"


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
            text = raw.decode("utf-8", "replace")
            base, more = base_spans(text), literals(text)
            n = Counter(k for _, k, _ in base)
            rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + [(a, 3, b) for a, b in more]), len(more), max(more.values(), default=0.0)))
        columns = list(zip(*rows)) or [()] * 8
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _SCAN.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text of ``docs (doc_id, text)``, one row for each row.

    ``n_assign, n_access, n_hex`` count the fixed patterns and ``base_sha256``
    digests their ``kind:start:end`` (code points, end exclusive; an ``assign``
    span is its whole match). ``spans`` lists these and the lexer's ``literal``
    spans; ``n_literal`` counts the latter and ``score`` is the greatest of
    theirs. A null text counts as empty: no spans, the digest of the empty text.
    Null or repeated ids stay as they are. An empty table gives no rows; other
    columns are not read. Nothing is shuffled.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCAN)
