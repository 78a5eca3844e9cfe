"""Operators 1, 5 and 10 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from ledgerframe.llm import embedding_dedup, mtree, simhash
from ledgerframe.llm.components import components

VEC = "vec_id long, embedding array<double>, label long, other string"


def groups_of(ids, pairs):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    pick = random.Random(2)
    pairs = {"random": [(pick.randint(0, 200), pick.randint(0, 200)) for _ in range(150)],
             "chain": [(k, k + 1) for k in range(60)], "star": [(500, k) for k in range(90)],
             "none": [(3, 3), (None, 4)]}[shape]
    got = {r["node"]: r["component"] for r in
           components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == groups_of({x for p in real for x in p}, real)


def simple_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).encode().split()]
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs):
    pick = random.Random(9)
    base = [" ".join(pick.choice("abcdefghij") * pick.randint(1, 3) for _ in range(400)) for _ in range(4)]
    rows = [(None, "null id"), (700, None), (701, ""), (702, " \n"), (703, "One"), (704, "one"),
            (705, "a b c"), (705, "a b c"), (706, "x " * 20000)]
    for k in range(120):
        words = base[k % 4].split()
        for _ in range(k % 3):
            words[pick.randrange(400)] = "edit"
        rows.append((k, " ".join(words)))
    for limit in (64, 1):  # the second sends every shared block through the variants
        got = {}
        import ledgerframe.llm.simhash as module
        links = module.links
        module.links = lambda c, d, b, n=limit: links(c, d, n)
        try:
            out = simhash.simhash_groups(docs(rows)).collect()
        finally:
            module.links = links
        assert len(out) == len(rows)
        for r in out:
            got[r["doc_id"]] = (int(r["fingerprint"], 16), r["component_id"])
        prints = {i: simple_print(t or "") for i, t in rows}
        assert {i: p for i, (p, _) in got.items()} == prints
        known = [i for i in prints if i is not None]
        want = groups_of(known, [(a, b) for a in known for b in known if a < b
                                 and bin(prints[a] ^ prints[b]).count("1") <= 2])
        assert {i: c for i, (_, c) in got.items() if i is not None} == want
        assert got[None][1] is None
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.simhash_groups(docs([])).count() == 0 == simhash.keep_one(docs([])).count()


def vector_rows(n=240, dim=8):
    pick = np.random.default_rng(3)
    centre = pick.normal(size=(5, dim))
    rows = []
    for k in range(n):
        v = centre[k % 5] + pick.normal(size=dim) * (0.05 if k % 3 else 0.25)
        rows.append((k, v.tolist(), k % 2 if k % 5 else 0, "x"))
    rows += [(n + 1, rows[4][1], rows[4][2], None), (n + 2, rows[4][1], rows[4][2], None),
             (n + 3, None, 0, "x"), (n + 4, [0.0] * dim, 0, "x"), (n + 5, rows[4][1], None, "x"),
             (n + 6, [1.0] * (dim - 1) + [None], 0, "x"), (n + 7, [float("nan")] * dim, 0, "x"),
             (n + 8, [], 0, "x"), (n + 9, [1e-200 * x for x in rows[4][1]], rows[4][2], "x"),
             (n + 10, [1.0, 2.0], 0, "x"), (n + 11, [float("inf")] + [1.0] * (dim - 1), 0, "x")]
    return rows


@pytest.mark.parametrize("tile", [1000, 16])
def test_embedding_groups(spark, tile):
    rows = vector_rows()
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_groups(
        spark.createDataFrame(rows, VEC), tile_rows=tile).collect()}
    fine = {i: np.array(v) for i, v, label, _ in rows
            if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x, _ in rows}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in fine.items()}
    pairs = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b]
             and len(fine[a]) == len(fine[b]) and unit[a] @ unit[b] >= 0.98]
    want = groups_of([r[0] for r in rows], pairs)
    assert len(pairs) > 100 and {i: r["component_id"] for i, r in out.items()} == want
    assert {i: r["n_links"] for i, r in out.items()} == {
        i: sum(i in p for p in pairs) for i in want}
    assert all(r["kept"] == (i == want[i]) for i, r in out.items())
    empty = spark.createDataFrame([], VEC)
    assert embedding_dedup.embedding_groups(empty).count() == 0
    null_id = spark.createDataFrame([(None, [1.0], 0, "x")], VEC)
    assert embedding_dedup.embedding_groups(null_id).collect()[0]["n_links"] == 0


def test_error_bounds_hold():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(300, 16))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for threshold in (0.0, 0.3, 0.6):
        i, j = embedding_dedup.tile_links(x, x, threshold, same=True)
        assert set(zip(i.tolist(), j.tolist())) == {
            (a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= threshold)) if a < b}


@pytest.mark.parametrize("block", [4096, 20])
def test_top_k(spark, block):
    rows = [(i * 10, v, x, o) for i, v, x, o in vector_rows()]
    out = mtree.top_k(spark.createDataFrame(rows, VEC), k=5, block_rows=block).collect()
    points = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v, _, _ in rows
              if v and None not in v and np.isfinite(v).all()}
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in points if i % 100 == 0):
        scored = sorted((-int(points[q] @ v), i) for i, v in points.items()
                        if i != q and len(v) == len(points[q]))[:5]
        assert sorted(got.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not got
    assert mtree.top_k(spark.createDataFrame([], VEC)).count() == 0


def test_top_k_large_components_and_repeated_rows(spark):
    pick = np.random.default_rng(8)
    rows = [(i, (pick.normal(size=4) * 10.0 ** pick.integers(0, 14)).tolist()) for i in range(0, 1200, 7)]
    rows += [(100, [2e9] * 4), (200, [-1e305, 1e305, 3.5, 0.0]), (300, [1.0, 2.0, 3.0, 4.0]), (301, [1e12, 0.0, -1e12, 5.0]),
             (302, [1.5e12, 0.0, -1e12, 5.0])]
    rows += [(300, [1.0, 2.0, 3.0, 4.0]), (301, [1e12, 0.0, -1e12, 5.0]), (303, [9.0, 9.0, 9.0, 9.0]), (303, [9.0, 9.0, 9.0, 9.0])]
    out = mtree.top_k(spark.createDataFrame([(i, v, 0, "") for i, v in rows], VEC), k=6, block_rows=20).collect()
    whole = [[mtree.whole(c, 1024) for c in v] for _, v in rows]
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in rows if i % 100 == 0}:
        at = next(n for n, (i, _) in enumerate(rows) if i == q)
        scored = sorted((-sum(a * b for a, b in zip(whole[at], w)), rows[n][0]) for n, w in enumerate(whole) if n != at)[:6]
        want = [(k + 1, i, max(min(-s, 2 ** 63 - 1), -2 ** 63)) for k, (s, i) in enumerate(scored)]
        assert sorted(got.pop(q)) == want, q
    assert not got


def test_order_rises_with_the_score():
    scores = sorted({s * m for s in (0, 1, 2, 9, 10, 11, 99, 100, 10 ** 18, 7 * 10 ** 40) for m in (1, -1)})
    orders = [mtree.order_of(s) for s in scores]
    assert orders == sorted(orders)


def test_mtree_skips_pages():
    pick = np.random.default_rng(5)
    x = (pick.normal(size=(40, 6))[pick.integers(0, 40, 4000)] * 1000
         + pick.normal(size=(4000, 6)) * 5).astype(np.int64)
    tree = mtree.MTree(x)
    for q in x[:20]:
        rows, scores = tree.search(q, 7)
        assert sorted(scores.tolist())[::-1][:7] == sorted((x @ q).tolist())[::-1][:7]
        assert len(rows) < 400
