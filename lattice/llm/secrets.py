"""Secret scans over a trigram index.

From each rule's regex a Boolean query of trigrams follows that every match must satisfy. Documents are indexed in
blocks of bounded size (an index sharded by document): only trigrams that a query names get postings. The query
intersects and unites postings; the regex then verifies the candidates. A rule without mandatory trigrams scans
every document. Matching is on UTF-8 bytes, as every pattern is ASCII; offsets are turned into code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import raw, sliced

#: Bytes of text in one index block.
BLOCK = 1 << 22
#: Most strings that a part of a regex is spelled out into.
SPELLED = 64
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and what group (0: all) must have at least how many characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The three base kinds, in order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds, after the base.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"

#: A query is None (any document), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None or a == b else ("and", a, b)


def _any(options: list[Query]) -> Query:
    return None if not options or None in options else options[0] if len(set(options)) == 1 else ("or", *dict.fromkeys(options))


def _spelled(strings: set[bytes]) -> Query:
    """The query of "one of these strings occurs"; lower-cased, as the index is."""
    out = []
    for s in sorted(strings):
        q: Query = None
        for t in dict.fromkeys(s[i : i + 3].lower() for i in range(len(s) - 2)):
            q = _both(q, t)
        out.append(q)
    return _any(out)


def _walk(parts) -> tuple[set[bytes] | None, Query]:
    """The exact strings of a parsed regex, if they are few, and a query that each match satisfies."""
    now, query, exact = {b""}, None, True

    def flush() -> None:
        nonlocal now, query, exact
        query, now, exact = _both(query, _spelled(now)), {b""}, False

    for op, arg in parts:
        strings, inner = None, None
        if op is sre.LITERAL and arg < 128:
            strings = {bytes([arg])}
        elif op is sre.IN:
            chars = [bytes([x]) for kind, x in arg if kind is sre.LITERAL]
            strings = set(chars) if len(chars) == len(arg) and len(chars) <= 4 else None
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            each = [_walk(x) for x in arg[1]]
            inner = _any([_both(q, _spelled(s)) if s else q for s, q in each])
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, inner = _walk(body)
            if (low, high) == (0, 1) and strings is not None:
                strings = strings | {b""}
            elif low != 1 or high != 1:
                strings, inner = None, (inner if strings is None else _spelled(strings)) if low else None
        elif op is sre.AT:
            continue
        if strings is not None and len(strings) * len(now) <= SPELLED:
            now = {a + b for a, b in product(now, strings)}
        else:
            flush()
            query = _both(query, _spelled(strings) if strings is not None else inner)
    if not exact:
        return None, _both(query, _spelled(now))
    return now, query


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query of a regex, over lower-cased text; None if it has no mandatory trigram."""
    strings, query = _walk(_parser.parse(regex))
    return _both(query, _spelled(strings)) if strings is not None else query


def _trigrams(query: Query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1:]))


def _matching(query: Query, postings: dict[bytes, set[int]]) -> set[int]:
    if isinstance(query, bytes):
        return postings.get(query, set())
    found = (_matching(q, postings) for q in query[1:])
    return set.intersection(*found) if query[0] == "and" else set.union(*found)


class Scanner:
    """Finds the spans of all rules in a block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.regex) for r in rules]
        self.trigrams = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = None

    def _open(self) -> None:
        if self.number is None:
            self.compiled = [re.compile(r.regex.encode()) for r in self.rules]
            self.number = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 256 else np.uint16)
            for k, t in enumerate(self.trigrams, 1):
                self.number[t[0] << 16 | t[1] << 8 | t[2]] = k

    def postings(self, texts: list[bytes]) -> dict[bytes, set[int]]:
        """For each trigram of the queries, the numbers of the texts that have it."""
        block = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", np.uint8).astype(np.int32)
        ends = np.cumsum([len(t) + 2 for t in texts])
        found = self.number[block[:-2] << 16 | block[1:-1] << 8 | block[2:]]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        out: dict[bytes, set[int]] = {}
        for k, doc in zip((pairs // len(texts)).tolist(), (pairs % len(texts)).tolist(), strict=True):
            out.setdefault(self.trigrams[k - 1], set()).add(doc)
        return out

    def spans(self, texts: list[bytes]) -> list[list[dict]]:
        """For each text its spans, by start, then in the order of the rules."""
        self._open()
        postings = self.postings(texts) if self.trigrams else {}
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for doc in range(len(texts)) if query is None else sorted(_matching(query, postings)):
                for m in regex.finditer(texts[doc]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[doc].append((m.start(), k, m.end()))
        out = []
        for text, spans in zip(texts, found, strict=True):
            point = (lambda at: at) if text.isascii() else (lambda at, t=text: len(t[:at].translate(None, _CONTINUATION)))
            out.append([{"kind": self.rules[k].kind, "start": point(a), "end": point(b)} for a, k, b in sorted(spans)])
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches, BLOCK):  # each slice is a block of the index
            spans = self.spans(batch.column(1).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): a row for each row of ``docs``; spans are (kind, start, end) in code points, end exclusive.

    Matches of a kind are leftmost and don't overlap; those of different kinds may. A null or empty text has no spans; very long ones are
    scanned whole. Repeated rows are rows of their own, ids may be null. Other columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long"), raw(text_col)).mapInArrow(Scanner(rules), f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base digest and the joined spans of :func:`find_secrets`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(of(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
