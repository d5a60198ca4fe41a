"""Whitening, vantage-point trees and the filter audit against brute force on small tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import audit, vptree, whiten

VECTORS = "vec_id long, embedding array<double>, v string, dim int, idx string, part long, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3, "y", 1, 2) for i, v in rows], VECTORS).repartition(5)


def fine(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


ODD = [(900, None), (901, []), (902, [1.0, None, 0.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0])]


# --- whitening -----------------------------------------------------------------------------

def spec_whiten(rows, components=32):
    """Textbook whitening in one process: (id, exact deviation) counts, V's eigenvalues and the projections."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    values, vecs = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:components]
    return n, dev, values[order], values.sum(), c @ vecs[:, order] / np.sqrt(np.maximum(values[order], 1e-300))


@pytest.mark.parametrize("dim,count", [(3, 40), (40, 130)])
def test_whitening_equals_the_textbook(spark, monkeypatch, dim, count):
    monkeypatch.setattr(whiten, "ROWS_PER_BLOCK", 16)     # many blocks
    monkeypatch.setattr(whiten, "COLS_PER_BLOCK", 24)     # two columns of blocks in the wide case
    rng = np.random.default_rng(3)
    x = rng.normal(size=(count, dim)) @ rng.normal(size=(dim, dim))
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (7, rows[9][1])]        # repeated rows and ids, no id
    got = whiten.whiten_embeddings(vectors(spark, rows + (ODD if dim == 3 else ODD[:4]))).collect()
    n, dev, values, trace, z = spec_whiten(rows)
    k = min(dim, 32)
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(
        (i, d) for (i, _), d in zip(rows, dev))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    for c in range(k):
        mine = sorted((r.whitened for r in got if r.component == c + 1))
        share = {r.explained for r in got if r.component == c + 1}
        assert len(share) == 1 and math.isclose(share.pop(), values[c] / trace, rel_tol=1e-9)
        close = [np.allclose(mine, sorted(sign * z[:, c]), atol=1e-6) for sign in (1, -1)]
        assert any(close)
    # the sign is the same for all rows: a row's coordinates fit its vector
    by = defaultdict(dict)
    for r in got:
        by[(r.vec_id, r.deviation)].setdefault(r.component, r.whitened)
    first = {(i, d): row for (i, _), d, row in zip(rows, dev, z)}
    signs = [{np.sign(by[key][c + 1] * row[c]) for key, row in first.items() if abs(row[c]) > 1e-3} for c in range(k)]
    assert all(len(s) == 1 for s in signs)


def test_whitening_of_flat_mixed_and_no_vectors(spark):
    flat = [(i, [float(i), 2 * float(i), 5.0]) for i in range(9)]
    other = [(50 + i, [float(i % 2)]) for i in range(4)]
    same = [(70, [1.0, 2.0])] * 3
    got = whiten.whiten_embeddings(vectors(spark, flat + other + same)).collect()
    assert Counter(r.n for r in got) == {9: 27, 4: 4, 3: 6}
    three = [r for r in got if r.n == 9]
    assert {r.component for r in three if r.whitened is None} == {2, 3}
    assert max(r.identity_error for r in got if r.n != 3) < 1e-9
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0
               for r in got if r.n == 3)
    assert math.isclose(sum(r.explained for r in three if r.vec_id == 0), 1.0)
    for rows in ([], ODD[:2]):
        empty = whiten.whiten_embeddings(vectors(spark, rows))
        assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_deviation_beyond_a_long_is_null_and_just_below_it_exact(spark):
    big = [(0, [4e7]), (1, [-4e7])]
    got = {r.vec_id: r.deviation for r in whiten.whiten_embeddings(vectors(spark, big + [(2, [0.0])])).collect()}
    x = [64 * 40000000, -64 * 40000000, 0]
    spec = [(3 * v - sum(x)) ** 2 for v in x]
    assert [got[i] for i in range(3)] == [None if s > 2 ** 63 - 1 else s for s in spec] and None in got.values()
    small = {r.vec_id: r.deviation for r in whiten.whiten_embeddings(vectors(spark, [(0, [1e7]), (1, [-1e7])])).collect()}
    assert small == {0: (2 * 64 * 10 ** 7) ** 2, 1: (2 * 64 * 10 ** 7) ** 2}


# --- vantage-point trees ----------------------------------------------------------------------

def spec_nearest(rows, every, k):
    live = [(i, v) for i, v in rows if i is not None and fine(v) and any(v)]
    out = {}
    for i, q in {i: v for i, v in reversed(live)}.items():
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in live if j != i and len(v) == len(q)]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return {i: v for i, v in out.items() if v}


def grid_vectors(rng, n, dim):
    # multiples of 1/8: products and sums are exact, so ties are real
    return [[rng.randrange(-8, 9) / 8 for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("shard_rows", [25, 100000])
def test_factor_one_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "QUERY_BLOCK", 7)
    rng = random.Random(4)
    vs = grid_vectors(rng, 260, 3)
    rows = list(enumerate(vs)) + [(300 + i, vs[0]) for i in range(60)]                # copies of a query
    rows += [(400, vs[5]), (400, vs[5]), (420, [0.0, 0.0, 0.0]), (None, vs[1])] + ODD
    rows += [(500 + i, v) for i, v in enumerate(grid_vectors(rng, 3, 2))]             # another dimension, few candidates
    rows += [(20, vs[20])] * 45                                                      # one row repeated
    got = defaultdict(list)
    for r in vptree.search_embeddings(vectors(spark, rows), factor=1.0, shard_rows=shard_rows).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == spec_nearest(rows, 20, 20)


def test_pruning_of_clusters_and_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.VPTree.from_bytes(vptree.VPTree.build(np.arange(4000), x, 20).to_bytes())
    own = np.arange(0, 4000, 20)
    exact = tree.search(own, x[own], 20, 1.0)
    seen = tree.computed
    assert seen < 0.5 * 4000 * len(own)                       # bounds leave halves out, none of the nearest
    brute = np.argsort(np.where(np.arange(4000) == own[:, None], -9, x[own] @ x.T), axis=1)[:, ::-1][:, :20]
    want = {(int(q), int(v)) for q, r in zip(own, brute) for v in r}
    assert {(int(a), int(b)) for a, b, _ in zip(*exact)} == want
    loose = tree.search(own, x[own], 20, vptree.FACTOR)
    assert tree.computed < seen
    assert len({(int(a), int(b)) for a, b, _ in zip(*loose)} & want) >= 0.9 * len(want)


def test_recall_of_the_registered_search(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = vptree.search_embeddings(table, shard_rows=500)
    exact = vptree.search_embeddings(table, factor=1.0)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -9
    brute = {(int(ids[q]), int(ids[j])) for q, s in zip(asked, scores) for j in np.argsort(-s)[:20]}
    assert {(r.query_id, r.vec_id) for r in exact.collect()} == brute
    assert vptree.recall(found, exact) >= 0.9


def test_no_vectors_and_a_bad_factor(spark):
    assert vptree.search_embeddings(vectors(spark, ODD[:2])).collect() == []
    with pytest.raises(ValueError):
        vptree.search_embeddings(vectors(spark, [(0, [1.0])]), factor=0.5)


# --- filter audit -----------------------------------------------------------------------------

def spec_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w),
                                           100 * sum("A" <= ch <= "Z" for ch in t) > 5 * len(t),
                                           any(ch in "#$%&*|" for ch in t), i is not None and least[t] < i)) if bad}
        parts[s or ""].append((f, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        lines = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[c] += len(gone)
                lines[(part, "".join(order), step)] = [
                    len(left), len(gone), sum(c in r[0] for r in rows) - len(gone), sum(r[0] == {c} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone), c]
        for key, line in lines.items():
            out[key] = (*line[:6], shapley[line[6]])
    return out


def audit_docs():
    rng = random.Random(9)
    vocabulary = ["word%d" % i for i in range(150)] + ["Upper", "CAPS", "a#b", "50%", "é", "日本"]
    docs = [(0, None, "s1"), (1, "", None), (2, "   \n", "s1"), (3, "", "s2"), (None, "", "s2"), (None, "x y", "s1")]
    for i in range(10, 130):
        n = rng.choice([3, 49, 50, 51, 120, 400])
        docs.append((i, " ".join(rng.choices(vocabulary[:rng.choice([20, 150, 156])], k=n)), rng.choice(["s1", "s2", "s3"])))
    docs += [(200 + i, docs[-1][1], "s1") for i in range(40)] + [(205, docs[-1][1], "s3")]     # copies, a repeated id
    docs += [(300, "long " * 30000 + "Z", "s2"), (9, docs[10][1], "s2"), (20, docs[20][1], "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)]
    return docs, labels + [(10, 1, 0), (10, 0, 1), (None, 1, 1)]


def test_audit_equals_filters_run_one_by_one(spark):
    docs, labels = audit_docs()
    d = spark.createDataFrame([(i, t, s, "x", 5, 6, True) for i, t, s in docs],
                              "doc_id long, text string, source string, part string, n long, quality int, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(d.repartition(4), marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == spec_audit(docs, labels)
    assert len(got) == 600 * 4                                # each line once
    none = audit.audit(d.where("doc_id < -1"), marks)
    assert none.collect() == [] and [f.name for f in none.schema] == [f.split()[0] for f in audit.REPORT.split(", ")]
    unmarked = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(d, marks.limit(0)).collect()}
    assert unmarked == spec_audit(docs, [])


def test_positional_popcount_by_carry_save():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 64, 1000):
        words = rng.integers(0, 2 ** 32, n, dtype=np.uint32)
        times = rng.integers(0, 70000, n)
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        assert (audit.positional_popcount(words) == bits.sum(axis=0)).all()
        assert (audit.positional_popcount(words, times) == (bits.astype(np.int64) * times[:, None]).sum(axis=0)).all()
    fails = np.arange(32)
    words = audit.survival_words(fails)
    assert all(((int(words[f]) >> s) & 1) == (s & f == 0) for f in fails for s in range(32))
