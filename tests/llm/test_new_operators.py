"""Filter audit, Jaccard join and centroid clusters against brute force, and their hard cases."""

import hashlib
import os
import random
import sys
from itertools import combinations, permutations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from waymark.llm import audit, centroids, jaccard

BIG = 2**53 + 1


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": t in least and (d is None or d > least[t])}
        docs.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed, kept = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                out[part, order, step] = [len(kept), len(removed), sum(d[1][f] for d in gone), only, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                total[f] += len(removed)
                left, gone = kept, gone + removed
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def audited(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in frame.collect()}


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [None, "", "SHOUT " * 120, " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k % 20}" for k in range(150)), "a # b", "A" * 30_000, "long " * 40_000, "é ß" * 50, " ".join(f"v{k}" for k in range(120)) + " $"]
    rows = [(k, r.choice(texts), r.choice(["en", "fr", "", None])) for k in range(60)]
    rows += [(None, texts[3], "en"), (None, texts[3], "en"), (None, "alone", "fr"), (None, "alone", "fr"), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (BIG, texts[4], "en"), (BIG, texts[4], "fr"), (-5, texts[4], "en")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(4, 1, 0), (7, None, 1), (None, 1, 1), (999, 1, 1)]
    spec = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(*x, "?", 5) for x in rows], spec + ", part string, mask int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(audit.filter_audit(docs, table))
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600
    assert audit.filter_audit(spark.createDataFrame([], spec), table).count() == 0
    alone = audited(audit.filter_audit(spark.createDataFrame([(None, None, None)] * 3, spec), table.limit(0)))
    assert alone == brute_audit([(None, None, None)] * 3, [])


def brute_jaccard(rows, percent=80, size=5):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    links = []
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[max(find(i), find(j))] = min(find(i), find(j))
            links.append((i, j))
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if find(x) == find(k) and rows[x][0] is not None]
        out.append((d, len(sets[k]), min(ids) if ids else None))
    return out, links, sets


def near_rows(seed=3):
    """Texts of many sizes and their edits, chains whose ends are far apart, passages that many share, and the hard cases."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    rows = []
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 130, 200, 350] * 2:
        words = [word() for _ in range(size)]
        rows.append(words)
        for edits in (1, 1, 2, 3, size // 40 + 1):
            other = list(words)
            for _ in range(edits):
                at = r.randrange(len(other))
                other[at : at + 1] = r.choice(([], [word()], [other[at], word()])) or ([word()] if len(other) == 1 else [])
            rows.append(other)
    chain = [word() for _ in range(150)]
    for k in range(12):
        chain = [*chain[3:], *[word() for _ in range(3)]]
        rows.append(chain)
    passage = [word() for _ in range(60)]
    rows += [[word() for _ in range(r.randrange(5, 40))] + passage for _ in range(30)]
    rows += [["same"] * n for n in (3, 4, 5, 6, 7, 40, 4000)]
    out = [(k, " ".join(w)) for k, w in enumerate(rows)]
    r.shuffle(out)
    out = [(k, t) for k, (_, t) in enumerate(out)]
    out += [(500, None), (501, ""), (502, " \n\t"), (None, out[3][1]), (None, "nobody else says any such thing"), (None, None), (7, out[7][1]), (7, out[9][1]), (BIG, out[5][1].upper()), (BIG + 2, "x" * 60_000), (-4, out[11][1] + "  \n")]
    return out


@pytest.mark.parametrize("small", [None, 0, 10, 48])
def test_jaccard_components(spark, small):
    rows = near_rows()
    docs = spark.createDataFrame([(*x, "?", 3, 1) for x in rows], "doc_id long, text string, key string, n int, cid long")
    want, links, _ = brute_jaccard(rows)
    key = lambda r: tuple(map(str, r))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, small=small).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(links) > 100


@pytest.mark.parametrize(("percent", "shingle"), [(80, 5), (60, 3), (100, 2)])
def test_jaccard_links_are_all_pairs(spark, percent, shingle):
    rows = [(k, t) for k, (_, t) in enumerate(near_rows(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = jaccard.links(docs, percent=percent, shingle=shingle, small=12)
    of = {r.doc_id: r.class_id for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    _, links, sets = brute_jaccard(rows, percent, shingle)
    assert got == {frozenset((of[i], of[j])) for i, j in links if sets[i] != sets[j]}
    assert all((of[i] == of[j]) == (sets[i] == sets[j]) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j])
    assert [d for d, c in of.items() if c is None] == [d for d, s in enumerate(sets) if not s]


def test_jaccard_hot_group(spark):
    """A group of near copies that are not all linked: one component, with fewer pairs tried than there are."""
    r = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(2):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.Join(docs).hub_pairs().count() < 300 * 20
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    want, _, _ = brute_jaccard(rows)
    assert got == {d: c for d, _, c in want} and len(set(got.values())) < 20


def test_jaccard_order_decides_costs_only(spark):
    """With a sketch of few cells, where all counts run together, results are the same; counts are never too small."""
    rows = near_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, sets = brute_jaccard(rows)
    counts = jaccard.sketch(docs, 5)
    hashes = [jaccard.shingle_set(t) for _, t in rows]
    assert [len(h) for h in hashes] == [len(s) for s in sets]
    every, n = np.unique(np.concatenate(hashes), return_counts=True)
    assert (counts[jaccard.cell(every, len(counts))] >= n).all() and counts.sum() == n.sum()
    names = lambda df: sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect()))
    assert names(jaccard.components(docs, cells=64)) == sorted((str(d), n, str(c)) for d, n, c in brute_jaccard(rows)[0])


def test_parities_never_say_more_than_sets_differ():
    r = np.random.default_rng(9)
    for size in (1, 5, 100, 3000):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 5 :], r.integers(0, 2**63, size // 4).astype(np.uint64)]))
        apart = sum(int(x).bit_count() for x in (jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (size != 100 or apart > 30)
        assert not (jaccard.parity(a) ^ jaccard.parity(a)).any()


def test_jaccard_empty_tables(spark):
    spec = "doc_id long, text string"
    assert jaccard.components(spark.createDataFrame([], spec)).count() == 0
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame([(None, None)] * 2 + [(3, "")], spec)).collect()) == [("3", 0, 3), ("None", 0, None), ("None", 0, None)]


def brute_clusters(rows, k=40, rounds=5):
    """Full scans in Python's own numbers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda: [min((far(v, m), n) for n, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        own = near()
        for n in range(len(c)):
            mine = [v for (_, v), (_, m) in zip(kept, own, strict=True) if m == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = near()
    inertia = sum(d for d, _ in own)
    return [(i, n, d, sum(e for e, m in own if m == n), inertia, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, own, strict=True)]


def clustered(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("spread", [0.5, 0.01, 8000.0])
def test_clusters_against_full_scans(spark, spread):
    r = np.random.default_rng(6)
    centers = r.normal(size=(9, 64)) * spread
    rows = [(int(k), (centers[k % 9] + r.normal(size=64) * spread * (0.05 + (k % 4) * 0.2)).tolist()) for k in range(180)]
    # Ties: few distinct whole numbers, the same vector under many ids, one id with two vectors; and what is not kept.
    rows += [(1000 + k, [float(k % 2)] * 63 + [float(k % 3)]) for k in range(40)] + [(2000, rows[0][1]), (2000, rows[1][1]), (None, rows[2][1]), (BIG, rows[3][1]), (-3, rows[4][1])]
    bad = [(1, None), (2, []), (3, [0.0] * 63), (4, [0.0] * 65), (5, [None] + [0.0] * 63), (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63)]
    table = spark.createDataFrame([(*x, 1, 2.0) for x in rows + bad], "vec_id long, embedding array<double>, cluster int, upper double").repartition(5)
    assert clustered(centroids.cluster(table)) == sorted(brute_clusters(rows), key=str)


def test_clusters_of_few_vectors(spark):
    spec = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], spec)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(None, None)] * 3, spec)).count() == 0
    for rows in ([(1, [0.5] * 64)], [(1, [0.5] * 64), (2, [-0.25] * 64), (2, [0.5] * 64), (None, [9.0] * 64)]):
        assert clustered(centroids.cluster(spark.createDataFrame(rows, spec))) == sorted(brute_clusters(rows), key=str)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e12] * 64)], spec)).collect()


def test_bounds_skip_scans_and_hold():
    r = np.random.default_rng(2)
    v = np.concatenate([c + r.integers(-9, 9, (200, 8)) for c in r.integers(-300, 300, (6, 8))])
    c = v[r.choice(len(v), 6, replace=False)].copy()
    own, upper, lower = np.full(len(v), -1), np.zeros(len(v)), np.zeros(len(v))
    scans = []
    for _ in range(6):
        scans.append(centroids.assign(v, c, own, upper, lower))
        d = np.sqrt(((v[:, None] - c[None]) ** 2).sum(axis=2))
        assert (own == (d**2).round().argmin(axis=1)).all() and (upper >= d[np.arange(len(v)), own] - 1e-6).all()
        d[np.arange(len(v)), own] = np.inf
        assert (lower <= d.min(axis=1) + 1e-6).all()
        moved = np.array([v[own == k].sum(axis=0) // max((own == k).sum(), 1) if (own == k).any() else c[k] for k in range(6)])
        centroids.drifted(own, upper, lower, np.sqrt(((moved - c) ** 2).sum(axis=1)))
        c = moved
    assert scans[0] == len(v) and scans[-1] < len(v) // 4
