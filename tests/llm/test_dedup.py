"""SimHash groups and pipeline stages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from lattice.llm import simhash, similar


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_groups(rows):
    """Component ids by comparing all distinct fingerprints."""
    fps = [plain_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[root(f)] = min(least.get(root(f), r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(root(f))) for r, f in zip(rows, fps, strict=True)]


def test_groups(docs, rows, clashing, empty):
    expected = sorted(map(repr, plain_groups(rows)))
    for df in (docs, clashing):
        assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(df).collect()) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_tie_bits():
    assert simhash.fingerprint(b"a b c d") == int.from_bytes(plain_fingerprint("a b c d").to_bytes(8, "big"), "big", signed=True)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0


def spread(rng, n, centres, flips):
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


def components(values, edges):
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        up[root(a)] = root(b)
    groups = {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_tree_search_keeps_all_links():
    rng = random.Random(2)
    for _ in range(30):
        values = spread(rng, rng.randrange(2, 150), [rng.getrandbits(64) for _ in range(3)], 9)
        pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
        assert components(values, simhash.shard_links(values, values)) == components(values, pairs)
        cut = len(values) // 2
        across = [(a, b) for a in values[:cut] for b in values[cut:] if (a ^ b).bit_count() <= 3]
        found = simhash.shard_links(values[:cut], values[cut:]) if cut else []
        joined = components(values, found)
        assert all(any(a in g and b in g for g in map(set, joined)) for a, b in across)


def test_split_shards(spark):
    rng = random.Random(4)
    values = spread(rng, 400, [rng.getrandbits(64)], 8)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    for limit in (40, 1 << 16):
        found = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df, tree_rows=limit).collect()]
        assert components(values, found) == components(values, pairs)


def plain_similar_groups(rows):
    """(doc_id, least id of its group) by comparing the five-word shingles of all texts."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in split]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_keep_one_finds_all_texts_of_four_fifths(spark):
    """Chains of edited copies: similarities on both sides of 0.8, most of them over 3 bits apart."""
    rng, data = random.Random(6), []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(4):
            data.append((len(data), " ".join(words)))
            for _ in range(rng.randrange(1, 1 + max(2, len(words) // 35))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
    groups = plain_similar_groups(data)
    kept = {d for d, g in groups if d == g}
    assert 25 < len(kept) < len({g[2] for g in plain_groups(data)})
    out = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in out.collect()} == kept


def test_keep_one_decides_texts_under_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    data = [(3, a), (5, a + " more"), (5, b), (7, c), (7, d), (7, d)]
    out = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(3, a), (5, b), (7, c), (7, d)]


def test_keep_one(docs, rows, clashing, empty):
    """Groups of five-word shingles at 0.8; a null id can't be named, so its rows stay."""
    groups = plain_similar_groups([(r[0], r[1]) for r in rows])
    kept = [r for r, g in zip(rows, groups, strict=True) if r[0] is None or r[0] == g[1]]
    named = {(r[0], repr(g)): r for r, g in zip(rows, groups, strict=True) if r[0] is not None and r[0] == g[1]}
    expected = sorted(map(repr, [*named.values(), *(r for r in kept if r[0] is None)]))
    assert sorted(repr(tuple(r)) for r in simhash.keep_one(docs).collect()) == expected
    out = simhash.keep_one(clashing)
    assert out.columns == clashing.columns
    assert sorted(repr(tuple(r)[:5]) for r in out.collect()) == expected
    assert simhash.keep_one(empty).count() == 0


def test_trees_of_similar_texts_keep_all_groups(spark):
    """One passage in all texts, with copies of very different closeness; shards cut into sub-shards give the same groups."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    data = []
    for k in range(60):
        own = passage + [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 12, 20, 200]))]
        for _ in range(rng.randrange(1, 4)):
            data.append((len(data), " ".join(own)))
            data.append((len(data), " ".join(own).upper() + " "))  # another text, the same fingerprint
            own[rng.randrange(60, len(own))] = f"x{k}"
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    expected = sorted(plain_similar_groups(data))
    assert len({g for _, g in expected}) not in (1, len(data))
    for limit in (similar.SETS, 2000):
        found = similar.similar_groups(docs, held=limit)
        assert sorted((r.doc_id, r.component_id) for r in found.collect()) == expected


def test_wide_fingerprints_of_similar_sets_are_close():
    rng = np.random.default_rng(5)
    for n in (9, 50, 500):
        for _ in range(200):
            both = rng.integers(-(1 << 63), 1 << 63, n)
            a, b = (similar.wide_fingerprint(np.unique(np.concatenate([both, rng.integers(-(1 << 63), 1 << 63, n // 9)]))) for _ in range(2))
            assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)) <= similar.WIDE
