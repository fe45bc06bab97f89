"""Chunk boundaries, hashes, fences."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattice.functions.text import chunk_spans, content_hash, fixed_spans, normalize_newlines, strip_code_fence
from lattice.operators.chunking import chunk


def spans(spark, text, **how):
    row = spark.createDataFrame([(text,)], "t string").select(chunk_spans(F.col("t"), **how).alias("s")).first()
    return [(s["start"], s["end"]) for s in row["s"]]


@pytest.mark.parametrize(
    ("text", "how", "expected"),
    [
        ("x" * 100, {"max_chars": 30, "overlap": 10, "split_on": "fixed"}, [(0, 30), (20, 50), (40, 70), (60, 90), (80, 100)]),
        ("a\n\nb\n\nc\n\nd\n\ne", {"max_chars": 5}, [(0, 13)]),
        ("p" * 16 + "\n\n" + "q" * 17 + "\n\n" + "r" * 16, {"max_chars": 50}, [(0, 53)]),
        ("p" * 16 + "\n\n" + "q" * 17 + "\n\n" + "r" * 16, {"max_chars": 1000}, [(0, 53)]),
        ("x" * 5000, {}, [(0, 5000)]),
        ("# Title\n\nSome opening.\n## One is here\n\nText one.\n## Two\n\nText two here.", {"max_chars": 40, "split_on": "heading"}, None),
        ("# abc\n" + "y" * 30, {"max_chars": 20, "split_on": "heading"}, [(0, 0), (0, 36)]),
        ("", {}, []),
        (" \n\t \n ", {}, []),
        (None, {}, []),
    ],
)
def test_chunks(spark, text, how, expected):
    found = spans(spark, text, **how)
    if expected is None:
        assert len(found) >= 2
        assert found[-1][1] == len(text)
    else:
        assert found == expected


def greedy(text, pattern, most):
    """The rule in plain Python."""
    pieces, at, cut = [], 0, [m.span() for m in re.finditer(pattern, text, re.M)]
    for a, b in cut:
        pieces.append((at, a))
        at = b
    pieces.append((at, len(text)))
    out, size, now = [], 0, None
    for a, b in pieces:
        if now and size + b - a > most:
            out.append(now)
            now, size = None, 0
        now, size = (now[0] if now else a, b), size + b - a
    return [*out, now]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab# \n\r", min_size=1, max_size=60), st.integers(1, 20))
def test_chunks_against_plain_python(spark, text, most):
    if not text.strip():
        return
    pieces = re.split(r"\n\s*\n", text)
    if all(p.strip() for p in pieces):
        assert spans(spark, text, max_chars=most) == greedy(text, r"\n\s*\n", most)
    assert spans(spark, text, max_chars=most, split_on="heading") == greedy(text, r"(?=^#{1,6}\s)", most)


def test_overlap_must_be_less_than_window():
    with pytest.raises(ValueError, match="overlap"):
        fixed_spans(F.lit("x"), 10, 10)


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "one\n\ntwo\n\nthree"), (2, " ")], "id int, text string")
    rows = chunk(df, "text", max_chars=6).orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index, r.content, r.char_start, r.char_end, r.token_count) for r in rows] == [(1, 0, "one\n\ntwo", 0, 8, 2), (1, 1, "three", 10, 15, 1)]


def test_hash_and_newlines(spark):
    row = spark.createDataFrame([("a\r\nb\rc",)], "t string").select(normalize_newlines(F.col("t")).alias("t"), content_hash(F.lit("é")).alias("h")).first()
    assert row["t"] == "a\nb\nc"
    assert row["h"] == hashlib.sha256("é".encode()).hexdigest()


@pytest.mark.parametrize(("text", "bare"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ("  x ", "x"), ("```\ny\n```", "y"), ("```yaml\na: 1", "a: 1")])
def test_code_fence(spark, text, bare):
    from lattice.sources.models import strip_code_fence as plain

    assert spark.createDataFrame([(text,)], "t string").select(strip_code_fence(F.col("t"))).first()[0] == bare
    assert plain(text) == bare
