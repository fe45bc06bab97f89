"""Column functions on text: hashes, token estimates, chunk boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace and U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
PARAGRAPH = rf"(?U)\n{_SPACE}*\n"
HEADING = rf"(?Udm)(?=^#{{1,6}}{_SPACE})"
SPANS = "array<struct<start:int,end:int>>"


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{_SPACE}*$")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def strip_code_fence(text: Column) -> Column:
    """The trimmed text without a leading fence (with or without json or yaml) and a trailing one."""
    bare, rest = _stripped(text), lambda c, n: F.substr(c, F.lit(n + 1))
    inside = rest(bare, 3)
    inside = _stripped(F.when(inside.startswith("json") | inside.startswith("yaml"), rest(inside, 4)).otherwise(inside))
    closed = F.when(inside.endswith("```"), _stripped(F.left(inside, F.length(inside) - 3))).otherwise(inside)
    return F.when(bare.startswith("```"), closed).otherwise(bare)


def fixed_spans(text: Column, max_chars: int, overlap: int) -> Column:
    """Windows of ``max_chars`` characters that overlap; a closed form, without a loop."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be less than the window")
    n, step = F.length(text), max_chars - overlap
    starts = F.filter(F.sequence(F.lit(0), n, F.lit(step)), lambda s: (s == 0) | (s + overlap < n))
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + max_chars, n).cast("int").alias("end")))


def pattern_spans(text: Column, pattern: str, max_chars: int, zero_width: bool = False) -> Column:
    """Pieces between matches of ``pattern``, merged greedily until the next would make more than ``max_chars``.

    Only characters of pieces count, so the separators inside a chunk can make it longer. A piece above the limit stays whole. A text
    that begins with a match has an empty first piece.
    """
    pieces = F.split(text, pattern, -1)
    if zero_width:  # the regex engine leaves out the empty piece before a match at the start
        at_start = text.rlike(pattern.replace("(?=^", "(?=\\A", 1).replace("(?Udm)", "(?Ud)\\A", 1))
        pieces = F.when(at_start, F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)
        gaps = F.transform(pieces, lambda _: F.lit(0))
    else:
        gaps = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.length(s))
    steps = F.zip_with(F.transform(pieces, lambda p: F.length(p)), gaps, lambda n, g: F.struct(n.alias("n"), F.coalesce(g, F.lit(0)).alias("gap")))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    first = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("size"), F.array().cast(SPANS).alias("done"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["start"] >= 0) & (state["size"] + piece["n"] > max_chars)
        end = state["at"] + piece["n"]
        return F.struct(
            (end + piece["gap"]).alias("at"),
            F.when(full | (state["start"] < 0), state["at"]).otherwise(state["start"]).alias("start"),
            end.alias("end"),
            F.when(full, piece["n"]).otherwise(state["size"] + piece["n"]).alias("size"),
            F.when(full, F.concat(state["done"], F.array(span(state["start"], state["end"])))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(steps, first, add, lambda s: F.concat(s["done"], F.array(span(s["start"], s["end"]))))


def chunk_spans(text: Column, max_chars: int = 4000, overlap: int = 200, split_on: str = "paragraph") -> Column:
    """Chunk boundaries of a text; blank texts have none. Modes: fixed, heading, anything else paragraph."""
    if split_on == "fixed":
        spans = fixed_spans(text, max_chars, overlap)
    elif split_on == "heading":
        spans = pattern_spans(text, HEADING, max_chars, zero_width=True)
    else:
        spans = pattern_spans(text, PARAGRAPH, max_chars)
    return F.when(text.isNull() | is_blank(text), F.array().cast(SPANS)).otherwise(spans)
