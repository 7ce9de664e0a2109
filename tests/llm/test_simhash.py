import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivane.llm import queries, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(rows, budget=2):
    """{row: smallest id} of rows (id, fingerprint) linked at `budget` bits or fewer."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_matches_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs]
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))}


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(odd).collect() if r["id"] is not None)
    prints = [(r[0], brute_fingerprint(r[1])) for r in odd_rows]
    want = sorted((d, p, c) for (d, p), c in zip(prints, brute_components(prints)) if d is not None)
    assert got == want
    assert simhash.near_duplicates(odd).count() == len(odd_rows)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2


def _cloud(n, seed=1):
    rng = np.random.default_rng(seed)
    center = int(rng.integers(1 << 63))
    return sorted({center ^ sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 5)), replace=False)) for _ in range(n)})


def _joined(links, fps):
    """Sets of fingerprints that links hold together."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("node_rows", "budget"), [(5, 2), (5, 3), (40, 2), (10_000, 3)])
def test_cut_tries_lose_no_link(spark, node_rows, budget):
    """A dense cloud, cut into many nodes of the upper trie, gives the same components as brute force."""
    fps = _cloud(600)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r[0] % (1 << 64), r[1] % (1 << 64)) for r in simhash.fingerprint_links(nodes, budget, node_rows=node_rows).collect()]
    assert all((a ^ b).bit_count() <= budget for a, b in links)
    of, want, groups = _joined(links, fps), brute_components([(k, f) for k, f in enumerate(fps)], budget), {}
    for k, f in enumerate(fps):
        groups.setdefault(of[f], set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_upper_trie_holds_every_fingerprint_once(spark):
    fps = _cloud(600)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    ends = simhash.upper_trie(nodes, 5)
    sizes = [sum(f >> (64 - d) == p for f in fps) for p, d in ends]
    assert sum(sizes) == len(fps) and max(sizes) <= 5 and min(sizes) > 0
    near = {(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2}
    end = {f: next(k for k, (p, d) in enumerate(ends) if f >> (64 - d) == p) for f in fps}
    assert {tuple(sorted((end[a], end[b]))) for a, b in near} <= {(a, b) for a, b, _ in simhash.node_pairs(ends, 2)}


def test_traversal_goes_down_bit_by_bit():
    """Node pairs are visited far below the root, and far fewer than all pairs of codes."""
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 64, size=20_000, dtype=np.uint64))
    n, visits = len(codes), Counter()
    list(simhash.trie_links(codes, [np.array([x]) for x in (0, n, 0, n, 0)], 64, 2, visits))
    assert visits[63] == 1 and visits[52] > 10_000 and sum(visits.values()) < n * n / 50


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, (1 << 12) - 1), min_size=2, max_size=60, unique=True), st.integers(0, 3))
def test_trie_finds_exactly_the_close_pairs(values, budget):
    codes = np.array(sorted(values), dtype=np.uint64)
    n = len(codes)
    frontier = [np.array([x]) for x in (0, n, 0, n, 0)]
    got = {(int(a), int(b)) for i, j in simhash.trie_links(codes, frontier, 12, budget) for a, b in zip(codes[i], codes[j])}
    assert got == {(a, b) for a in map(int, codes) for b in map(int, codes) if a < b and (a ^ b).bit_count() <= budget}


def test_five_word_near_copies_fall_together(spark):
    words = [f"term{i * 7919 % 3001}" for i in range(400)]
    near = [w if i % 100 else "changed" for i, w in enumerate(words)]
    other = [f"other{i}" for i in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other))], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {1, 3}
    assert simhash.similar_groups(df).where(F.col("id") == 3).first()["component_id"] == 3


def _jaccard(a, b, width=5):
    a, b = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_similarity_stage_equals_brute_force_jaccard(spark):
    """Planted pairs of similarity 0.5 to 0.95: all of 0.8 and more fall together, none below does."""
    rng = np.random.default_rng(5)
    texts, want = [], []
    for p in range(300):
        n = int(rng.choice([64, 304]))
        words = [f"p{p}w{k}" for k in range(n)]
        near, cut = list(words), int(rng.uniform(0.02, 0.33) * n)
        near[n - cut :] = [f"p{p}x{k}" for k in range(cut)]
        near = near if p % 2 else near[-3:] + near[:-3]
        texts += [words, near]
        want.append(_jaccard(words, near) >= 0.8)
    assert 60 < sum(want) < 240
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert [got[2 * p + 1] == 2 * p for p in range(300)] == want


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    texts = [[*words[: 200 - k], *(f"x{k}y{i}" for i in range(k))] for k in range(0, 80, 2)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    want = brute_links(texts)
    for most in (1_000, 7):
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", most)
        got = [r["component_id"] for r in simhash.similar_groups(df).orderBy("id").collect()]
        assert got == want


def brute_links(texts):
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((least[i], least[j]))
                least = [lo if x == hi else x for x in least]
    return least
