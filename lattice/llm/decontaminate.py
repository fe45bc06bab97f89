"""Benchmark decontamination by pigeonhole edit matching over words.

A test item is cut into windows, one at every word. A window of n words may differ by k = floor(n * error_rate) word edits. It is
split into k + 1 pieces; k edits leave at least one piece whole, so every match has an exact piece hit. Pieces are
found by one Aho-Corasick pass over each whole text; Myers' bit-parallel distance verifies the words around each hit.

The test items are a stated query set: they are broadcast in blocks of bounded bytes and meet all texts block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import ALNUM, drop_ids, map_docs, raw
from lattice.plans.materialize import materialize

#: Words in a window, words from one window's start to the next, edits per word.
WINDOW, STRIDE, ERROR_RATE = 25, 1, 0.2
#: Most bytes of test items that are sent to executors at once; some 200 MB as an automaton.
BLOCK_BYTES = 1 << 20
#: Windows whose bit masks a worker keeps.
MASKS = 4096

HITS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; characters beyond ASCII count as letters."""
    return text.translate(ALNUM).split()


def starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """First words of the windows of an item of ``n`` words: every stride and the end; a stride above 1 loses edited passages between them."""
    last = n - window
    return [0] if last <= 0 else sorted({*range(0, last, stride), last})


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` pieces, start and end, of near equal length."""
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def masks(pattern: list[bytes]) -> dict[bytes, int]:
    """For each word of the pattern the bits of its places."""
    out: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << i
    return out


def myers(peq: dict[bytes, int], m: int, text: list[bytes]) -> tuple[int, int]:
    """Least edit distance between the pattern and any stretch of ``text``, and the first end (exclusive) that has it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds the windows of a block of test items in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW, stride: int = STRIDE, error_rate: float = ERROR_RATE):
        self.items = [(item_id, item) for item_id, text in items if (item := words(text))]
        self.window, self.stride, self.error_rate = window, stride, error_rate
        self.found = None

    def _open(self) -> None:
        """Built in the worker: the automaton isn't sent. A piece that several windows of an item share is one place."""
        self.starts, self.cuts = [], []
        at: dict[str, dict[tuple[int, int], None]] = {}
        for number, (_, item) in enumerate(self.items):
            m = min(self.window, len(item))
            cuts, own = pieces(m, int(m * self.error_rate)), starts(len(item), self.window, self.stride)
            self.starts.append(set(own))
            self.cuts.append(cuts)
            for start in own:
                for a, b in cuts:
                    at.setdefault(f" {b' '.join(item[start + a : start + b]).decode('latin-1')} ", {})[number, start + a] = None
        self.found = ahocorasick.Automaton()
        for piece, places in at.items():
            self.found.add_word(piece, (len(piece) - 1, piece.count(" ") - 1, tuple(places)))
        self.found.make_automaton()
        self.masks = lru_cache(MASKS)(self._masks)

    def _masks(self, number: int, start: int) -> tuple[dict[bytes, int], dict[bytes, int]]:
        pattern = self.items[number][1][start : start + self.window]
        return masks(pattern), masks(pattern[::-1])

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window, "stride": self.stride, "error_rate": self.error_rate, "found": None}

    def match(self, text: bytes) -> list[dict]:
        """For each item found: its least distance, and the first words (start, end exclusive) that have it."""
        if not self.items:
            return []
        if self.found is None:
            self._open()
        said = words(text)
        joined = f" {b' '.join(said).decode('latin-1')} "
        tried: set[tuple[int, int, int]] = set()
        best: dict[tuple[int | None, int], tuple[int, int, int]] = {}
        counted, at_word = 0, 0
        for last, (back, size, places) in self.found.iter(joined):
            first = last - back
            if first < counted:
                at_word -= joined.count(" ", first, counted)
            else:
                at_word += joined.count(" ", counted, first)
            counted = first
            for number, place in places:
                for offset in (a for a, b in self.cuts[number] if b - a == size and place - a in self.starts[number]):
                    start = at_word - offset
                    if (number, place - offset, start) in tried:
                        continue  # another piece of the same alignment was verified
                    tried.add((number, place - offset, start))
                    item_id, item = self.items[number]
                    m = min(self.window, len(item))
                    errors, (forward, backward) = len(self.cuts[number]) - 1, self.masks(number, place - offset)
                    low = max(0, start - errors)
                    part = said[low : start + m + errors]
                    distance, end = myers(forward, m, part)
                    if distance <= errors:
                        _, length = myers(backward, m, part[:end][::-1])
                        span = (distance, low + end - length, low + end)
                        of = (item_id, -1 if item_id is not None else number)  # items without an id are items of their own
                        if of not in best or span < best[of]:
                            best[of] = span
        return [{"item_id": k, "distance": d, "start": a, "end": b} for (k, _), (d, a, b) in sorted(best.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1]))]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct test items in blocks of about ``block_bytes``, one block on the driver at a time; texts of one id are in one block."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), raw(text_col).alias("text")).filter(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64(F.coalesce("item_id", F.xxhash64("text"))), F.lit(count)) == k) if count > 1 else items
        if found := [(r["item_id"], bytes(r["text"])) for r in part.collect()]:
            yield sorted(found, key=lambda x: (x[0] is not None, x))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, stride: int = STRIDE, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word): a row for each row of ``docs`` and test item it holds a window of.

    distance is the least number of word edits, start_word to end_word (exclusive) the first words that have it. Null, empty and
    wordless texts or items match nothing; very long texts are searched whole. Repeated items are one, and so are texts under one id; those
    without an id are items of their own. Repeated documents are rows of their own; ids may be null. Other columns are ignored; an empty table on either side gives no rows.

    Several blocks are searched one after the other; each block's rows are written, and its items released, before the next one is read.
    """
    schema = "doc_id long, item_id long, distance int, start_word int, end_word int"
    sizes = benchmark.select(raw(text_col).alias("text")).agg(F.sum(F.length("text") + 16)).first()[0] or 0
    out = None
    for block in blocks(benchmark, block_bytes=block_bytes):
        matcher = Matcher(block, window, stride, error_rate)
        found = map_docs(docs, [F.col(id_col).cast("long"), raw(text_col)], f"doc_id long, hits {HITS}", lambda i, t, m=matcher: (i, h) if (h := m.match(t)) else None)
        rows = found.select("doc_id", F.inline("hits")).select("doc_id", "item_id", "distance", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
        if sizes > block_bytes:
            rows = materialize(rows)
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of a test item, all columns kept.

    Of rows that repeat an id, all go if any matches; rows with a null id can't be named and stay.
    """
    found = materialize(contamination(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct())
    return drop_ids(docs, found, id_col)
