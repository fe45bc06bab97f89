"""Quality, sharding, lines, mixing, the language model, the pipeline."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lattice.llm import hmm, lines, mixing, quality, shards
from lattice.llm.oracle import ORACLE
from lattice.llm.queries import QUERIES
from test_dedup import plain_similar_groups
from tests_llm_helpers import edit_table

SF = "/root/testdata/sf0.001"


def plain_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if again[w] > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered)


def test_quality(docs, rows, clashing, empty):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()]
    expected = [(r[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]) for r in rows for m in [plain_measure(r[1])]]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert quality.quality(empty).count() == 0
    bad = {r.doc_id for r in quality.quality(docs).filter("not kept").collect()} - {None}
    out = quality.keep_good(clashing)
    assert out.columns == clashing.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in bad)


def test_bad_hosts_go_and_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "word " * 60
    data = [(i, good, "fine") for i in range(50)] + [(100 + i, bad if i else good, "spam") for i in range(50)] + [(200 + i, good, f"h{i}") for i in range(20)] + [(300, bad, "new"), (301, good, "new")]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not found[100].base_failed
    assert found[100].host_rejected
    assert not found[100].kept
    assert found[0].kept
    assert found[301].kept


def plain_rates(fails, n):
    """Shrunk rate and limit of each host from its failures and documents, by the formulas of the docstring."""
    total = sum(n.values())
    m = sum(fails.values()) / total
    between = sum(n[h] * (fails[h] / n[h] - m) ** 2 for h in n) / total - m * (1 - m) * len(n) / total
    k = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return {h: (fails[h] + m * k) / (n[h] + k) for h in n}, min(max(m + 3 * math.sqrt(m * (1 - m) / (k + 1)), 0.2), 0.5)


def test_registered_verdicts_follow_from_hosts(spark, tmp_path):
    """The registered query, on hosts of very different rates: its verdicts, rates and limits against plain Python and SQL."""
    rng = np.random.default_rng(4)
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"#$%&{i}" for i in range(60))
    data, n = [], 0
    for host, rate in [*((f"h{i}", 0.02) for i in range(25)), ("junk", 0.9), ("mixed", 0.35), (None, 0.0), ("tiny", 1.0)]:
        for _ in range(2 if host == "tiny" else 80):
            data.append((n, bad if rng.random() < rate else good, host))
            n += 1
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_quality_rules"](spark, str(tmp_path)).collect()
    counts = Counter(h or "" for _, _, h in data)
    rates, limit = plain_rates({h: sum(t == bad and (s or "") == h for _, t, s in data) for h in counts}, counts)
    for r in got:
        assert r.rate_symbols == pytest.approx(rates[r.host], abs=2e-6)
        assert r.limit_symbols == pytest.approx(limit, abs=2e-6)
        assert r.host_rejected == (rates[r.host] > limit)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert {r.host for r in got if r.host_rejected} >= {"junk"}
    assert any(r.host_rejected and not r.base_failed for r in got)
    assert all(r.kept for r in got if r.host.startswith("h"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(ORACLE["op5_quality_rules"])
    order = sorted(expected.columns)
    shown = lambda names, rows: sorted(repr([r[names.index(k)] for k in order]) for r in rows)
    assert shown(list(got[0].asDict()), got) == shown(expected.columns, expected.fetchall())


def test_shards(docs, rows, clashing, empty):
    got = shards.shard(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.grown_shard in (r.shard, 24)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        ids = [(r.doc_id is not None, r.doc_id) for r in sorted(members, key=lambda r: r.slot)]
        assert ids == sorted(ids)
    text = {repr((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))) for r in rows}
    assert {repr((r.doc_id, r.size, r.text_crc32)) for r in got} == text
    owner = {}
    for r in got:
        assert owner.setdefault(r.doc_id, r.shard) == r.shard
    assert sorted(map(repr, shards.shard(clashing).collect())) == sorted(map(repr, got))
    assert shards.shard(empty).count() == 0


def test_weighted_shards(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text")
    n = Counter(r.shard for r in shards.shard(df, weights=[1.0, 2.0, 0.0, 3.0]).collect())
    assert set(n) == {0, 1, 3}
    assert n[0] == pytest.approx(1000, abs=150)
    assert n[1] == pytest.approx(2000, abs=200)
    got = shards.shard(df, weights=[1.0] * 9).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {9}
    assert len(moved) == pytest.approx(600, abs=120)


def plain_lines(rows, ratio=0.1, least=2):
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text, host)."""
    bare = lambda x: x.strip("\t\n\v\f\r ")
    pages = Counter(h or "" for _, _, h in rows)
    on = Counter((h or "", x) for _, t, h in rows for x in {bare(x) for x in (t or "").split("\n")} - {""})
    out = []
    for d, t, h in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (on[h or "", bare(x)] >= least and on[h or "", bare(x)] / pages[h or ""] > ratio)]
        out.append((d, sum(bare(x) != "" for x in lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sent", [lines.SENT, 0])
def test_lines(spark, docs, rows, clashing, empty, sent):
    menu = [(i, f"Home | About\nbody {i}\n\n  Home | About ", "a") for i in range(8)] + [(20 + i, f"text {i}", "a") for i in range(30)]
    data = [*menu, (50, None, "a"), (51, "Home | About", None), (52, "only\n", "solo"), (53, "only\n", "solo"), (None, "Home | About\nz", "a")]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lines.drop_lines(table, sent=sent).collect()}
    assert (got[3].n_lines, got[3].n_dropped, got[3].text) == (3, 2, "body 3\n")
    assert (got[50].n_lines, got[50].text) == (0, "")
    assert got[51].text == "Home | About"
    assert (got[52].n_dropped, got[52].text) == (1, "")
    assert got[None].text == "z"
    plain = sorted(map(repr, plain_lines([(r[0], r[1], r[3]) for r in rows])))
    for df in (docs, clashing):
        out = lines.drop_lines(df, sent=sent)
        assert out.columns == ["doc_id", "n_lines", "n_dropped", "text"]
        assert sorted(map(repr, map(tuple, out.collect()))) == plain
    assert lines.drop_lines(empty, sent=sent).count() == 0


@pytest.mark.parametrize("sent", [lines.SENT, 0])
def test_lines_against_brute_force(spark, sent):
    rng = np.random.default_rng(6)
    pool = ["", " ", "menu", " menu\t", "é", "x\u00a0", "\u00a0x", "a b", "footer\r", "footer", "\x1c", *(f"line {i}" for i in range(60))]
    data = [(int(i), "\n".join(rng.choice(pool, rng.integers(0, 30))), ["a", "b", "ü", "", None][rng.integers(5)]) for i in range(250)]
    data += [data[3], data[3], (None, None, None), (900, "\n".join(f"unique {i}" if i % 3 else "menu" for i in range(50_000)), "a")]
    got = lines.drop_lines(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3), sent=sent)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_lines(data)))


def margin(rows, at):
    out = defaultdict(float)
    for r in rows:
        out[r[at]] += r.weight
    return out


@pytest.mark.parametrize("most", [mixing.CELLS, 1])
def test_raking(spark, most):
    """Given and tempered targets are met; the total is the largest that the cells can give."""
    cells = [("a", "en", "x", 100), ("a", "fr", "x", 50), ("b", "en", "y", 300), ("b", "fr", "x", 30), ("b", "fr", "y", 60), ("a", "en", "y", 10), ("c", "en", "x", 0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = {"source": spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.75), ("fr", 0.25)], "lang string, share double")}
    out = mixing.rake(df, 0.9, {"topic": 0.5, "source": 1, "lang": 1}, share, most=most).collect()
    total = out[0].total
    assert total == pytest.approx(sum(r.weight for r in out))
    assert margin(out, 0) == pytest.approx({"a": 0.75 * total, "b": 0.25 * total, "c": 0})
    assert margin(out, 1) == pytest.approx({"en": 0.75 * total, "fr": 0.25 * total})
    t = {r.topic: r.target for r in mixing.shares(df, "topic", 0.5).collect()}
    assert margin(out, 2) == pytest.approx({k: v * total for k, v in t.items()})
    assert max(r.weight / r.tokens for r in out if r.tokens) == pytest.approx(1.0)
    assert max(r[k] for r in out for k in ("residual_source", "residual_lang", "residual_topic")) <= mixing.TOLERANCE
    few = mixing.rake(df, 0.01, {"topic": 0.5, "source": 1, "lang": 1}, share, most=most).collect()
    assert sum(r.weight for r in few) == pytest.approx(0.01 * 550)


def test_contradicting_targets_are_reported(spark):
    df = spark.createDataFrame([("a", "en", "x", 100), ("b", "fr", "x", 100)], "source string, lang string, topic string, tokens long")
    share = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "lang string, share double")}
    out = mixing.rake(df, 0.5, {"topic": 1.0}, share, 16).collect()
    assert max(out[0].residual_source, out[0].residual_lang) > 0.3


def test_tiny_names_do_not_hold_back_the_total(spark):
    df = spark.createDataFrame([("big", "en", "x", 10**9), ("small", "en", "x", 10**6), ("tiny", "en", "x", 3)], "source string, lang string, topic string, tokens long")
    out = {r.source: r for r in mixing.rake(df).collect()}
    assert out["big"].total == pytest.approx(0.6 * (10**9 + 10**6 + 3))
    assert out["tiny"].weight / 3 == pytest.approx(1.25 * out["big"].total / (10**9 + 10**6 + 3))


def test_mixing(docs, rows, clashing, empty):
    kept = mixing.mix(docs).collect()
    assert 0 < len(kept) < len(rows)
    out = mixing.sample(clashing)
    assert out.columns == clashing.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r.doc_id) for r in kept)
    assert mixing.mix(empty).count() == mixing.sample(empty).count() == 0
    cell = lambda r: (r[3], r[2], "table" if " | " in (r[1] or "") else "prose")
    full = {cell(r) for r in rows if (r[1] or "").strip()}
    assert mixing.mix(docs, keep=1.0, temper=dict.fromkeys(mixing.MARGINS, 1.0)).count() == sum(cell(r) in full for r in rows)


def test_kept_tokens_meet_the_margins(spark):
    """Many documents: the tokens kept by the hash lie near the raked targets of every margin."""
    rng = np.random.default_rng(9)
    source, lang = rng.choice(["a", "b", "c"], 20_000, p=[0.7, 0.2, 0.1]).tolist(), rng.choice(["en", "fr"], 20_000, p=[0.8, 0.2]).tolist()
    df = spark.createDataFrame([(i, "w " * 10 + ("| x" if i % 9 == 0 else "y z"), s, x) for i, (s, x) in enumerate(zip(source, lang, strict=True))], "doc_id long, text string, source string, lang string")
    kept = mixing.mix(df).collect()
    n = sum(r.n_tokens for r in kept)
    assert n == pytest.approx(kept[0].total, rel=0.03)
    slim = df.select(*mixing.with_cell(df), mixing.tokens(df.text).alias("tokens"))
    for m in mixing.MARGINS:
        for r in mixing.shares(slim, m, mixing.TEMPER[m]).collect():
            assert sum(k.n_tokens for k in kept if k[m] == r[0]) / n == pytest.approx(r.target, rel=0.08)


def test_a_topic_column_is_used(docs):
    from pyspark.sql import functions as F

    kept = mixing.mix(docs.withColumn("subject", F.when(F.col("doc_id") % 2 == 0, "even")), topic_col="subject")
    assert {r.topic for r in kept.collect()} == {"even", ""}


def enumerate_paths(m, q):
    total, start, move, emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for z in itertools.product(range(2), repeat=len(q)):
        p = m.start[z[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(z)) * math.prod(m.emit[c, s] for s, c in zip(z, q, strict=True))
        total += p
        start[z[0]] += p
        for s, c in zip(z, q, strict=True):
            emit[c, s] += p
        for a, b in itertools.pairwise(z):
            move[a, b] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_are_exact():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    seqs = [np.array(x, np.uint16) for x in ([0, 1, 2], [2], [1, 1, 0, 2], [0, 0])]
    plain = [enumerate_paths(m, q) for q in seqs]
    assert np.allclose(hmm.log_likelihoods(m, seqs), [math.log(p[0]) for p in plain])
    for found, k in zip(hmm.expected_counts(m, seqs), (1, 2, 3), strict=True):
        assert np.allclose(found, sum(p[k] for p in plain))


@pytest.mark.parametrize("held", [1, 500, 1 << 25])
def test_long_sequences_are_counted_whole(monkeypatch, held):
    """Blocks of few steps give the counts of the plain forward-backward recursion."""
    rng = np.random.default_rng(2)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 37, 37, 60, 300)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for q in seqs:
        alpha, beta = [m.start * m.emit[q[0]]], [np.ones(3)]
        for c in q[1:]:
            alpha.append(alpha[-1] @ m.move * m.emit[c])
        for c in q[:0:-1]:
            beta.insert(0, m.move @ (m.emit[c] * beta[0]))
        total = alpha[-1].sum()
        start += alpha[0] * beta[0] / total
        for t, c in enumerate(q):
            emit[c] += alpha[t] * beta[t] / total
            if t:
                move += np.outer(alpha[t - 1], m.emit[c] * beta[t]) * m.move / total
    monkeypatch.setattr(hmm, "HELD", held)
    for found, plain in zip(hmm.expected_counts(m, seqs), (start, move, emit), strict=True):
        assert np.allclose(found, plain)


def test_score_against_enumerated_states(spark):
    """The whole score of a small corpus: classes, Baum-Welch rounds and chances by enumerating all paths of states."""
    own, rare, rounds = 3, 2, 2
    texts = ["a b", "A c a", "b a c", "c", "ab a", "ba", "", "a a b c", None, "zz a", "b b"]
    rows = [(i, texts[i % len(texts)]) for i in range(44)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    said = lambda t: [*(t or "").lower().split(), " "]
    c = Counter(w for d, t in rows if not held(d) for w in said(t))
    often = sorted(c, key=lambda w: (-c[w], w.encode()))
    inside = often[: own - 1] + [" "] * (" " not in often[: own - 1])
    klass = lambda w: inside.index(w) if w in inside else own + zlib.crc32(w.encode()[-3:]) % rare
    sizes = [sum(c[w] for w in c if klass(w) == k) for k in range(own + rare)]
    prior = np.array(sizes) + 1.0
    prior /= prior.sum()
    model, codes = hmm.first_model(prior, 2), [[klass(w) for w in said(t)] for d, t in rows if not held(d)]

    def paths(q):
        for z in itertools.product(range(2), repeat=len(q)):
            yield z, model.start[z[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(z)) * math.prod(model.emit[k, s] for k, s in zip(q, z, strict=True))

    for _ in range(rounds):
        start, move, emit = np.ones(2), np.ones((2, 2)), np.repeat(prior[:, None], 2, axis=1)
        for q in codes:
            total = sum(p for _, p in paths(q))
            for z, p in paths(q):
                start[z[0]] += p / total
                for k, s in zip(q, z, strict=True):
                    emit[k, s] += p / total
                for a, b in itertools.pairwise(z):
                    move[a, b] += p / total
        model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def chance(w):
        k = klass(w)
        return 1.0 if k < own else (c[w] + 1) / (sizes[k] + sum(klass(x) == k for x in c) + 1)

    expected = {d: math.log10(sum(p for _, p in paths([klass(w) for w in said(t)])) * math.prod(map(chance, said(t)))) for d, t in rows}
    for top in (2, 4, 100):
        got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=2, rounds=rounds, own=own, rare=rare, top=top).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx(expected)


def test_classes_grow_with_the_vocabulary(spark):
    vocab = spark.range(800_000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS word", "1L AS c")
    large, small = hmm.lexicon(vocab, top=100), hmm.lexicon(vocab.limit(50), top=100)
    assert (small.own, small.rare) == (4096, 1024)
    assert (large.own, large.rare) == (6250, 1562)


def test_language_model(spark, docs, rows, clashing, empty):
    small = {"own": 16, "rare": 8, "top": 20, "rounds": 2, "states": 3}
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    expected = sorted(repr((r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4))) for r in rows for w in [tokens(r[1])])
    for df in (docs, clashing):
        got = hmm.score(df, **small).collect()
        assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in got) == expected
        assert all(r.score < 0 for r in got)
    assert hmm.score(empty, **small).count() == 0
    only = spark.createDataFrame([(d, "some words") for d in range(60) if held(d)], "doc_id long, text string")
    assert {r.n_known for r in hmm.score(only, **small).collect()} == {0}


def test_scores_are_probabilities(spark):
    """Over one word and the end, the chances of all words and one stand-in for the unseen add up to at most one."""
    data = [(i, t) for i, t in enumerate(["a b", "a c", "b a c", "c", "ab a", "ba"] * 3) if zlib.crc32(str(i).encode()) % 7 != 2]
    small = {"own": 3, "rare": 4, "top": 4, "rounds": 2, "states": 2}
    probes = [(d, w) for d, w in zip([d for d in range(100, 300) if zlib.crc32(str(d).encode()) % 7 == 2], ["a", "b", "c", "ab", "ba", "zz", "q"], strict=False)]
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(data + probes, "doc_id long, text string"), **small).collect()}
    assert 0 < sum(10 ** got[d] for d, _ in probes) < 1


def test_training_raises_likelihood(spark):
    rng = np.random.default_rng(3)
    true = hmm.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]]))
    seqs = []
    for _ in range(60):
        s, q = rng.integers(2), []
        for _ in range(40):
            q.append(rng.choice(3, p=true.emit[:, s]))
            s = rng.choice(2, p=true.move[s])
        seqs.append(np.array(q, np.uint16))
    lex = hmm.Lexicon({}, np.zeros(0), np.zeros(0), np.zeros(1), np.bincount(np.concatenate(seqs)) / 2400, 3, 0, 2400, 3)
    table = spark.createDataFrame([(s.tobytes(),) for s in seqs], "codes binary")
    before = [hmm.log_likelihoods(hmm.train(table, lex, 2, k), seqs).sum() for k in (0, 1, 4)]
    assert before == sorted(before)
    assert before[2] > np.log(lex.prior[np.concatenate(seqs)]).sum()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    shown = lambda names, rows: sorted(repr([f"{x:.9g}" if isinstance(x, float) else x for k in order for x in [r[names.index(k)]]]) for r in rows)
    assert shown(got.columns, got.collect()) == shown(expected.columns, expected.fetchall())


def plain_quality(rows, _):
    """Rows that neither fail the base rules nor come from a rejected host."""
    measured = [(r, m, len([x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])) for r in rows for m in [plain_measure(r[1])]]
    failed = [(m[0] < 50, 100 * m[4] > 50 * m[0], 10 * m[2] > m[1], 2 * m[3] > n, m[1] < 2 * m[0] or m[1] > 15 * m[0]) for _, m, n in measured]
    hosts = Counter(r[3] or "" for r in rows)
    bad = set()
    for k in range(5):
        rates, limit = plain_rates({h: sum(f[k] for f, r in zip(failed, rows, strict=True) if (r[3] or "") == h) for h in hosts}, hosts)
        bad |= {h for h, x in rates.items() if x > limit}
    gone = {r[0] for r, f in zip(rows, failed, strict=True) if f[0] or f[1] or (r[3] or "") in bad}
    return [r for r in rows if r[0] is None or r[0] not in gone]


def plain_dedup(rows, _):
    groups = plain_similar_groups([(r[0], r[1]) for r in rows])
    kept = {}
    for at, (r, (d, least)) in enumerate(zip(rows, groups, strict=True)):
        if r[0] is None or d == least:
            kept.setdefault(at if r[0] is None else (r[0], least), r)
    return list(kept.values())


def plain_decontamination(rows, items):
    """Rows without any stretch within the budget of edits of a window of an item; a stretch lacks few of the window's words."""
    said = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [w[k : k + 25] for t in items for w in [said(t)] if w for k in range(max(1, len(w) - 24))]
    gone = set()
    for r in rows:
        w = said(r[1])
        bag = Counter(w)
        if any(sum((Counter(p) - bag).values()) <= len(p) // 5 and edit_table(p, w)[0] <= len(p) // 5 for p in windows):
            gone.add(r[0])
    return [r for r in rows if r[0] is None or r[0] not in gone]


def plain_mixing(rows, _):
    text = lambda r: r[1] or ""
    cell = lambda r: (r[3] or "", r[2] or "", "table" if " | " in text(r) else "loud" if "!! " in text(r) else "markup" if re.search(r"[#$%&*]{3}", text(r)) else "prose")
    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", text(r)))
    everything = sum(tokens.values())
    targets = []
    for at, e in enumerate((0.5, 0.7, 0.7)):
        held = Counter()
        for c, n in tokens.items():
            held[c[at]] += n
        held = {k: n for k, n in held.items() if n}
        most = {k: 1.25 * n / everything for k, n in held.items()}
        share = {k: min(n**e / sum(x**e for x in held.values()), most[k]) for k, n in held.items()}
        left, room = 1 - sum(share.values()), sum(most.values()) - sum(share.values())
        targets.append({k: share[k] + (most[k] - share[k]) * (left / room if room else 0) for k in held})
    weight = {c: n / everything for c, n in tokens.items()} if everything else {}
    for _ in range(60):
        for at, t in enumerate(targets):
            whole = Counter()
            for c, w in weight.items():
                whole[c[at]] += w
            weight = {c: w * t.get(c[at], 0) / whole[c[at]] if whole[c[at]] else 0 for c, w in weight.items()}
    total = min([0.6 * everything, *(tokens[c] / w for c, w in weight.items() if w)])
    unit = lambda d: int(hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
    return [r for r in rows if tokens[cell(r)] and unit(r[0]) < weight[cell(r)] * total / tokens[cell(r)]]


def plain_sharding(rows, _):
    def place(d, n):
        u = lambda k: (int(hashlib.md5(f"{'null' if d is None else d}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max((1 / -math.log(u(k)), k) for k in range(n))[1]

    found = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), place(r[0], 24), place(r[0], 25)) for r in rows]
    order, slots = sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1])), Counter()
    out = []
    for d, size, crc, shard, grown in order:
        out.append((d, size, crc, "key", shard, slots[shard], grown))
        slots[shard] += 1
    return out


PLAIN_STAGES = (plain_quality, plain_dedup, plain_decontamination, plain_mixing, plain_sharding)


def check_stages(spark, docs, sf_dir, items):
    """Every stage, on the rows that its predecessor kept, against its plain version; then the whole run."""
    now = [tuple(r) for r in docs.collect()]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN_STAGES, strict=True):
        out = stage(spark, spark.createDataFrame(now, docs.schema), sf_dir)
        now = plain(now, items)
        if plain is not plain_sharding:
            assert out.columns == docs.columns
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, now)), name
    return now


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, items)
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, SF).collect()))) == sorted(map(repr, expected))
    assert len(expected) > 20


def test_pipeline_on_odd_rows(spark, docs, rows, clashing, empty, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing columns and empty tables, through every stage and the whole run."""
    from pyspark.sql import functions as F

    items = [" ".join(rows[4][1].split()[3:30]), "", None, "one two"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = clashing.select("doc_id", "text", "lang", "source", "n_chars", *(F.col(c) for c in clashing.columns[5:]))
    expected = check_stages(spark, wide, str(tmp_path), items)
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, expected))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_rows_dropped_by_id(spark, monkeypatch, most):
    from lattice.llm.words import drop_ids
    from lattice.plans import materialize

    monkeypatch.setattr(materialize, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    for gone in ([(1,), (1,), (None,), (9,)], []):
        left = drop_ids(docs, spark.createDataFrame(gone, "doc_id long"))
        assert sorted(map(repr, map(tuple, left.collect()))) == sorted(repr(tuple(r)) for r in docs.collect() if r.doc_id is None or (r.doc_id,) not in gone)
