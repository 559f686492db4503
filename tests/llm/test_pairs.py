"""Near-duplicate and embedding joins, components and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, embedding_dedup, graph, minhash
from barloom.llm.common import staged

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = components_of(edges, {n for e in edges for n in e})
    assert all(want[n] == root for n, root in got.items())
    assert {n for e in edges if e[0] != e[1] for n in e} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("m", [16, 64])
def test_signatures_equal_the_sequential_algorithm(m):
    rng = np.random.default_rng(m)
    for n in (1, 2, 5, 40, 300):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        want = [2**64 - 1] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                v, k = minhash.draw(np.array([x]), j, m)
                p[j], p[int(k[0])] = p[int(k[0])], p[j]
                want[p[j]] = min(want[p[j]], int(v[0]))
        assert minhash.signatures([s, s[:0]], m)[0].tolist() == want


def shingles(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(f"w{rnd.randrange(900)}" for _ in range(rnd.choice((3, 30, 120)))) for _ in range(12)]
    texts = [None, "", " \n\t", "one", "One", "a b", "A  b"]
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(w))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x"), (None, "one", "x"), (None, None, "x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node string"), shingle_words=4).collect()
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components_of(links, range(len(texts)))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, True), (True, True)] or {r.component_id for r in got if r.doc_id is None} == {None, 3}
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tile", [1 << 20, 900])
def test_groups_of_several_components_match_brute_force(spark, monkeypatch, tile):
    """Families whose members differ from the leader by more than a link allows, so that tiles have to find the links among the others."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "ROW", 10)
    rnd, texts = random.Random(11), []
    for f in range(3):
        base = [f"b{f}.{i}" for i in range(120)]
        for g in range(5):
            own = list(base)
            own[20 * g:20 * g + 14] = [f"v{f}.{g}.{i}" for i in range(14)]
            for c in range(7):
                texts.append(" ".join([*own[:100], *(f"x{f}.{g}.{c}.{i}" for i in range(rnd.randrange(9))), *own[100:]]))
    rnd.shuffle(texts)
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components_of(links, range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want and 3 < len(set(want.values())) < len(texts)


def test_tiles_hold_each_pair_with_an_outer_member_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 40)
    monkeypatch.setattr(minhash, "ROW", 10)
    stars = spark.createDataFrame([(0, i, 3, False) for i in range(1, 31)] + [(50, 51, 3, True), (50, 52, 3, False)], "lead long, node long, n long, fits boolean")
    tree = spark.createDataFrame([(i, 0) for i in range(21)] + [(i, 21) for i in range(21, 25)] + [(50, 50), (51, 50)], "node long, root long")
    rows = minhash.tiles_of(stars, tree).collect()
    met = []
    for lead, i, j in {(r.lead, r.i, r.j) for r in rows}:
        own = [r for r in rows if (r.lead, r.i, r.j) == (lead, i, j)]
        met += [tuple(sorted((x.node, y.node))) for x in own for y in own if x.node != y.node and x.outer and x.comp != y.comp and (x.side < y.side if i != j else x.node < y.node or not y.outer)]
    comp = {i: 0 for i in range(1, 21)} | {i: 21 for i in range(21, 25)} | {i: i for i in range(25, 31)} | {51: 50, 52: 52}
    assert len({(r.i, r.j) for r in rows if r.lead == 0}) > 10
    assert sorted(met) == sorted((x, y) for x in comp for y in comp if x < y and (x < 50) == (y < 50) and comp[x] != comp[y])


def test_pairs_just_above_the_threshold_are_found(spark):
    rnd, texts = random.Random(4), []
    for i in range(300):
        w = [f"p{i}.{k}" for k in range(rnd.choice((90, 200, 400)))]
        n = len(w) - 4  # one changed word inside costs five shingles, words added at the end one each
        texts += [" ".join(w), " ".join([*w, *(f"q{i}.{k}" for k in range(n // 4))])]
    sets = [shingles(t, 5) for t in texts]
    assert all(80 <= 100 * len(a & b) / len(a | b) < 81 for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] == i and got[i + 1] == i for i in range(0, 600, 2)) >= 299


def test_linked_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = np.vstack([centres[rng.integers(6, size=120)] + 0.25 * rng.normal(size=(120, 8)), rng.normal(size=(40, 8))])
    x[5] = x[6] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, x[0].tolist()), (901, None), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None]), (905, []), (906, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids = [*range(160), 900]
    v = np.vstack([x, x[:1]])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    want = components_of([(ids[i], ids[j]) for i, j in np.argwhere(near)], ids)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum() - 1, want[i], want[i] == i)
    for i in range(901, 907):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def hits(words, items, window=10):
    hit, found = [False] * len(words), set()
    for name, t in items:
        w = WORDS.findall((t or "").lower())
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            for b in range(len(words) - k + 1):
                if words[b:b + k] == w[a:a + k]:
                    found.add(name)
                    hit[b:b + k] = [True] * k
    return hit, sorted(found)


@pytest.mark.parametrize("item_words", [10**6, 30])
def test_decontamination_matches_brute_force(spark, item_words):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=n))) for i, n in enumerate((1, 3, 10, 14, 25, 12))] + [(7, None), (8, "--"), (2, "w1 w1 w2")]
    texts = [None, "", "..."]
    for _ in range(25):
        w = rnd.choices([*vocabulary, "zz", "yy"], k=rnd.choice((1, 9, 60)))
        w[len(w) // 2:len(w) // 2] = (rnd.choice(items)[1] or "").upper().split()
        texts.append(", ".join(w))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, item_words=item_words).collect()}
    for i, t in enumerate(texts):
        words = WORDS.findall((t or "").lower())
        hit, found = hits(words, [(str(n), x) for n, x in items])
        own = [False] * len(words)
        for s, e in got[i].found.spans:
            own[s:e] = [True] * (e - s)
        assert (got[i].found.n_words, own, got[i].found["items"]) == (len(words), hit, found)
    clean = decontaminate.cleaned(spark.createDataFrame([(1, "Keep w1. W2, w3 w4 w0 w1 w2 w3 w4 w0 end.", 5), (2, "zz yy", 5), (3, "w1 w2 w3 w4 w0 w1 w2 w3 w4 w0", 9)], "doc_id long, text string, n_chars long"),
                                  spark.createDataFrame([(1, "w1 w2 w3 w4 w0 w1 w2 w3 w4 w0")], "item_id long, text string"))
    assert sorted(tuple(r) for r in clean.collect()) == [(1, "Keep  end.", 10), (2, "zz yy", 5)]
    assert decontaminate.find_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.hit_counts(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_passes_with_clashing_columns_and_long_items(spark):
    rnd = random.Random(4)
    long_item = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(70_000))
    items = [(None, "a b c d e f g h i j k"), (3, long_item), (3, "c d e f g h i j k l"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    piece = " ".join(long_item.split()[65_530:65_550])
    texts = [f"x {piece} y", "a b c d e f g h i j k l", "clean text", None, piece, long_item]
    rows = [(i, t, "own", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __earlier string, __row int")
    doubled = staged(docs).select("*", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("copy"))
    want = {0: (22, [[1, 21]], ["3"]), 1: (12, [[0, 12]], ["", "3"]), 2: (2, [], []), 3: (0, [], []), 4: (20, [[0, 20]], ["3"]), 5: (70_000, [[0, 70_000]], ["3"])}
    for source, times in ((docs, 1), (doubled, 2)):
        out = decontaminate.find_hits(source, bench, item_words=30_000)
        assert out.columns == [*source.columns, "found"]
        got = out.collect()
        assert len(got) == times * len(rows) and all(r["__earlier"] == "own" and r["__row"] == r.doc_id for r in got)
        assert all((r.found.n_words, r.found.spans, r.found["items"]) == want[r.doc_id] for r in got)
    blocks = list(decontaminate.item_blocks(bench, "item_id", "text", 10, 30_000))
    assert len(blocks) == 3 and all(len(b.items) <= 30_000 for b in blocks) and sum(len(b.items) for b in blocks) == 70_000 - 9 + 2 + 1
    clean = decontaminate.cleaned(doubled, bench, item_words=30_000).collect()
    assert sorted((r.doc_id, r.text) for r in clean if r["copy"] == "q") == [(0, "x  y"), (2, "clean text"), (3, None)]
