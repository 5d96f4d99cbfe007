"""Every operator against brute force on small tables, and on the hard cases: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import os
import random
import re
import sys
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from waymark.llm import decontaminate, html_text, language, licenses, lines, packing, quality, rules, scratch, simhash, substrings
from waymark.llm.components import components

SPEC = "doc_id long, text string, lang string, source string, n_chars long, gid long, fp long, line string, key long, score double, g string"
#: A number that a double does not hold.
BIG = 2**53 + 1
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefghijé") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("\n" if r.random() < 0.08 else "") for _ in range(n))


def hard_rows():
    base = prose(120, 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "  ", 3), "en", None), (4, None, "fr", "a"), (5, "", None, "b"), (None, prose(60, 2), "en", "b"), (None, None, None, None),
        (6, prose(4000, 3), "en", "b"), (7, "x" * 50_000, "en", "c"), (8, prose(40, 4) + " " + " ".join(base.split()[10:60]), "fr", "c"), (9, "12 34 !!", "fr", "c"), (9, "12 34 !!", "fr", "c"), (10, "\n\n \t\n", "en", "a"), (11, "a <|endoftext|> b", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), 0, 0, "x", 0, 0.0, "g") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SPEC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SPEC)


def words(t):
    return (t or "").encode().split()


def test_substrings(docs, none):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedupe_substrings(docs, group_bytes=3000, shard_windows=500).collect())
    rows = sorted(((r[0] is None, r[0] or 0, r[1] or ""), r) for r in hard_rows())
    seen, want = set(), []
    for _, r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if x in seen else set()
            seen.add(x)
        want.append((str(r[0]), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert got == sorted(want)
    assert substrings.dedupe_substrings(none).count() == 0


def test_substrings_spread_equal_rows(spark):
    """Hundreds of equal rows, with and without an id, and a large id: one of them keeps its words."""
    base = prose(60, 31)
    rows = [(None, base)] * 150 + [(7, base + " end")] * 150 + [(BIG, prose(50, 32)), (BIG + 2, prose(50, 32)), (1, prose(40, 33))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedupe_substrings(df, group_bytes=200, shard_windows=200).collect()
    assert len(got) == len(rows)
    n = len(words(base))
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == sorted([0] + [n + 1] * 149)
    assert {r.n_removed for r in got if r.doc_id is None} == {n}
    assert {r.doc_id: r.n_removed for r in got if (r.doc_id or 0) not in (0, 7)} == {BIG: 0, BIG + 2: 50, 1: 0}


def test_windows_that_share_a_hash():
    order, begins = substrings._runs(np.array([5, 5, 3, 5, 5], np.uint64), np.array([1, 2, 9, 1, 2], np.uint64))
    assert order.tolist() == [2, 0, 3, 1, 4] and begins.tolist() == [0, 1, 3]
    assert [len(x) for x in substrings._runs(np.empty(0, np.uint64), np.empty(0, np.uint64))] == [0, 0]


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps):
    """Least non-null id of the group of every row."""
    root = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    return [min((x[0] for k, x in enumerate(rows) if root[k] == root[i] and x[0] is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("tree_size", [2, 2048])
def test_simhash(docs, none, tree_size):
    rows = hard_rows()
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, tree_size=tree_size).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert got == sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, brute_components(rows, fps), strict=True))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_any_number_of_blocks_finds_the_same_links(spark, blocks):
    r = random.Random(2)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        fps |= {x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {x.node % (1 << 64): x.component for x in components(simhash.link_fingerprints(df, blocks=blocks, tree_size=4)).collect()}
    names = brute_components([(k,) for k in range(len(fps))], fps)
    groups = lambda label: sorted(sorted(k for k in range(len(fps)) if label[k] == x) for x in set(label))
    assert groups([got.get(x, ("single", x)) for x in fps]) == groups(names)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 3, 2048) for n in (10, 10**8, 10**9, 10**11, 10**12)] == [4, 4, 5, 6, 6]
    assert all(bin(sum(simhash._masks(3, b)) % 2) for b in (4, 5, 6)) and [len(simhash._masks(3, b)) for b in (4, 5, 6)] == [4, 10, 20]


def test_bk_forest_finds_all_links():
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds ^ np.uint64(1 << int(b)) for b in r.integers(0, 63, 30)]))
    shard = (values % np.uint64(5)).astype(np.int64)
    pairs = {(int(q), int(v)) for a, b in simhash.Forest(values, shard).near(values, shard, 3, block=64) for q, v in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert pairs == want


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (300, 300), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100}


def brute_lines(rows):
    """(lines, removed, links, kept text) of every row: by id, then by the operator's hash of the text; equal rows are one."""
    keys = {(r[0], r[1]) for r in rows if r[1] is not None}
    order = sorted(keys, key=lambda k: (k[0] is None, k[0] or 0, hash_of(k[1])))
    first, out = {}, {}
    for key in order:
        for k, x in enumerate(key[1].split("\n")):
            if x.strip(" \t\x0b\x0c\r"):
                first.setdefault(x, (order.index(key), k))
    near = {x: [y for y in first if y != x and min(len(x), len(y)) >= 5 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2] for x in first}
    for key in order:
        n, gone, links, kept = 0, 0, 0, []
        for k, x in enumerate(key[1].split("\n")):
            if not x.strip(" \t\x0b\x0c\r"):
                kept.append(x)
                continue
            here = first[x] == (order.index(key), k)
            n, links = n + 1, links + len(near[x]) * here
            if here and not any(first[y] < first[x] for y in near[x]):
                kept.append(x)
            else:
                gone += 1
        out[key] = (n, gone, links, "\n".join(kept))
    return [(0, 0, 0, None) if r[1] is None else out[r[0], r[1]] for r in rows]


def hash_of(text):
    """Spark's signed xxhash64 of a text, seed 42."""
    h = xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_lines(spark, none):
    base = "a line that has some thirty characters"
    rows = hard_rows() + [(k, t, "en", "a", 0, 0, 0, "x", 0, 0.0, "g") for k, t in ((BIG, base + "\nother"), (60, base[:10] + "X" + base[10:]), (61, base[:-2]), (None, base[1:] + "!"), (62, "short one\nshort ones"), (63, "tiny\ntin\nabcde\nabXde\nabcd\nbcde"), (None, base), (62, base.replace("h", "H", 2)))]
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_links, r.text) for r in lines.dedupe_lines(spark.createDataFrame(rows, SPEC)).collect()), key=key)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute_lines(rows), strict=True)), key=key)
    assert lines.dedupe_lines(none).count() == 0


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_line_links(spark, monkeypatch, tau):
    r, texts = random.Random(tau), set()
    for letters, size in (("ab", 9), ("ab", 12), ("abé", 10), ("abé𝄞", 14)):
        for _ in range(12):
            x = [r.choice(letters) for _ in range(size + r.randrange(4))]
            texts.add("".join(x))
            for _ in range(4):
                y = list(x)
                for _ in range(r.randrange(1, tau + 1)):
                    k = r.randrange(len(y))
                    y[k : k + r.randrange(2)] = r.choice(["", r.choice(letters), r.choice(letters)])
                texts.add("".join(y))
    # Shifted copies of periodic lines, and edits at the borders of segments.
    texts |= {("ab" * 10)[k : k + n] for k in (0, 1) for n in range(9, 16)} | {"abcdefghijkl", "Xabcdefghijk", "abcdXefghijk", "abcdefghXijk", "bcdefghijklX", "abcefghijkXl"}
    dealt = []
    monkeypatch.setattr(lines, "_keyed", lambda *args, keyed=lines._keyed: dealt.append(keyed(*args)) or dealt[-1])
    texts = sorted(texts)
    firsts, links = lines.near_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tau, 1)
    place = {row.lid: row.doc for row in firsts.collect()}
    got = sorted(tuple(sorted((place[row.a], place[row.b]))) for row in links.collect())
    least = 2 * tau + 1
    assert got == [(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and min(len(x), len(y)) >= least and distance(x, y) <= tau]
    # Rows to shuffle for each line: 4 to 8 substrings and 3 segments at tau = 2, where there were up to 15.
    if tau == 2:
        assert sum(df.count() for df in dealt) <= 10 * len(texts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    r, pairs = random.Random(tau), []
    for _ in range(150):
        x = [r.choice("abé") for _ in range(r.randrange(8, 40))]
        y = list(x)
        for _ in range(r.randrange(5)):
            y[r.randrange(len(y)) :][:1] = []
            k = r.randrange(len(y))
            y[k : k + r.randrange(2)] = r.choice(["", "a", "b"])
        if abs(len(x) - len(y)) <= tau and len(y) > tau:
            pairs.append(("".join(x), "".join(y)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", lines.banded_distance(df.a, df.b, tau).alias("d")).collect():
        assert min(row.d, tau + 1) == min(distance(row.a, row.b), tau + 1)


def test_decontaminate(spark, docs, none):
    item = prose(40, 77).replace("\n", " ")
    typo = item[:50] + "Q" + item[52:120] + item[123:]
    rows = [(20, prose(200, 8) + " " + item.upper() + " " + prose(20, 9)), (21, prose(50, 10) + "\n" + typo + " " + prose(90, 12)), (22, prose(300, 13)), (23, None), (24, "")]
    bench = spark.createDataFrame([(1, item), (2, prose(40, 78)), (3, None), (4, ""), (None, prose(30, 79))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(20, 1), (21, 1)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_alignment_is_exact():
    r = random.Random(2)
    for _ in range(60):
        a = "".join(r.choice("abc") for _ in range(r.randrange(5, 30)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(1, 60)))
        want = min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got = decontaminate.best_alignment(a, b, len(a))
        assert got is None or got[0] == want
        assert got is not None or want == len(a)


def test_decontamination_recall():
    r = random.Random(6)
    items = [(k, prose(35, 500 + k).replace("\n", " ")) for k in range(60)]
    index = decontaminate.Index([(k, decontaminate.normal(t)) for k, t in items], 0.05, 9, 3, 20, 6)
    texts = []
    for _, t, most in index.items:
        x = list(t)
        for _ in range(most):
            x[r.randrange(len(x))] = "z"
        texts.append(decontaminate.normal(prose(80, r.random()) + " " + "".join(x) + " " + prose(30, 5)))
    found = index.search(texts)
    assert sum(any(i == k for i, _, _ in f) for k, f in enumerate(found)) >= 0.9 * len(items)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in often for j in range(8)}
    held = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in held[:k] for k, x in enumerate(held)), len(covered)


def test_rules(spark, docs, none):
    rows = [*hard_rows(), *((k, t, "en", "a", 0, 0, 0, "x", 0, 0.0, "g") for k, t in ((50, "# a\n# a\n \n \nb <|> c\n# a"), (51, prose(30, 7) * 3), (BIG, prose(80, 21) + "\n" + prose(9, 21)), (52, "\u00a0 é\u2003é\x1c a\x85b")))]
    got = rules.quality_rules(spark.createDataFrame(rows, SPEC)).collect()
    key = lambda r: tuple(map(str, r))
    want = [(r[0], *brute_counts(r[1])) for r in rows]
    assert sorted(((r.doc_id, *(r[c] for c in rules.COUNTS)) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        # Too few texts for any estimate: all are kept that the base rules keep.
        assert r.level in ("none", None) and r.kept == (not r.base_failed)
    assert rules.quality_rules(none).count() == 0


def brute_mcd(x, w, support, starts=150):
    """Concentration steps to convergence from random subsets; the smallest determinant, reweighted."""
    r, n, p = np.random.default_rng(0), len(x), x.shape[1]

    def moments(part, weight=None):
        c = np.ones(len(part)) if weight is None else weight
        mean = (c * w[part]) @ x[part] / (c * w[part]).sum()
        off = (x[part] - mean) * np.sqrt(c * w[part])[:, None]
        return mean, off.T @ off / c.sum() + rules.FLOOR**2 * np.eye(p)

    def distances(mean, cov):
        return w * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    best = None
    for _ in range(starts):
        part = r.choice(n, p + 2, replace=False)
        last = np.inf
        while True:
            estimate = moments(part)
            det = np.linalg.slogdet(estimate[1])[1]
            if len(part) > p + 2 and det > last - 1e-9:
                break
            last = det if len(part) > p + 2 else np.inf
            part = np.argsort(distances(*estimate), kind="stable")[: int(np.ceil(support * n))]
        if best is None or det < best[0]:
            best = det, estimate
    near = np.flatnonzero(distances(*best[1]) <= rules.quantile(0.975, p) * rules.consistency(support))
    mean, cov = moments(near)
    return best[0], distances(mean, rules.consistency(0.975) * (cov - rules.FLOOR**2 * np.eye(p)) + rules.FLOOR**2 * np.eye(p))


@pytest.mark.parametrize(("lengths", "bad"), [(False, 0.0), (False, 0.2), (True, 0.15)])
def test_mcd_against_brute_force(spark, lengths, bad):
    r = np.random.default_rng(5)
    groups = {}
    for n in (30, 60, 150, 500):
        mix = r.normal(size=(6, 6)) * 0.03 + np.eye(6) * 0.1
        x = r.normal(size=(n, 6)) @ mix + 1
        k = int(bad * n)
        x[:k] = r.normal(size=(k, 6)) * 0.01 + np.array([2, 1, 1, 0.5, 1, 1])
        groups[f"g{n}"] = x, (r.uniform(0.1, 0.9, n) if lengths else np.full(n, 0.5)), k
    rows = [(g, x[i].tolist(), float(w[i]), i) for g, (x, w, _) in groups.items() for i in range(len(x))]
    good = spark.createDataFrame(rows, "g string, x array<double>, w double, i int")
    found = rules.minimum_covariance(good.drop("i"), 0.75, 30, lambda df: df)
    scored = good.join(found, "g").select("g", "i", "logdet", rules._distance(F.col("m"), F.col("q")).alias("d")).collect()
    for g, (x, w, k) in groups.items():
        det, brute = brute_mcd(x, w, 0.75)
        mine = {s.i: s.d for s in scored if s.g == g}
        assert next(s.logdet for s in scored if s.g == g) <= det + (0.6 if len(x) < 100 else 0.1)
        if len(x) >= 60:
            assert all((mine[i] > rules.CUT) == (brute[i] > rules.CUT) for i in range(len(x)) if abs(math.log(brute[i] / rules.CUT)) > 0.5)
        assert all(mine[i] > rules.CUT for i in range(k)) and np.mean([mine[i] <= rules.CUT for i in range(k, len(x))]) >= (0.85 if len(x) < 60 else 0.97)


def test_chi_square_and_consistency():
    r = np.random.default_rng(1)
    d = np.square(r.normal(size=(200_000, 6))).sum(axis=1)
    for share in (0.5, 0.75, 0.975):
        assert abs((d <= rules.quantile(share, 6)).mean() - share) < 0.01
    z = r.normal(size=(200_000, 6))
    kept = z[np.square(z).sum(axis=1) <= rules.quantile(0.75, 6)]
    assert abs(kept.var() * rules.consistency(0.75) - 1) < 0.02


def test_rules_levels_and_outliers(spark):
    vocabulary = [f"{a}{b}{c}" for a in ("the", "stor", "an", "wind") for b in ("", "y", "ing") for c in ("", "s", "er")]
    text = lambda n, k: ". ".join(" ".join(random.Random(f"{k}-{j}").choices(vocabulary, k=9)).capitalize() for j in range(n)) + "."
    junk = lambda k: " ".join(random.Random(k).choice(vocabulary).upper() + "!!##" for _ in range(60))
    rows = [(k, text(10 + k % 9, k), "en", "big") for k in range(80)] + [(100 + k, text(8, 100 + k), "en", "small") for k in range(4)] + [(200 + k, junk(k), "en", "big" if k % 2 else "small") for k in range(6)]
    rows += [(300 + k, rows[0][1], "en", "big") for k in range(400)] + [(900, text(9, 900), None, None), (901, junk(77), None, None)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {got[0].level, got[300].level} == {"group"} and got[100].level == "language" and got[900].level == "all"
    # Hundreds of copies of one text do not make all others outliers.
    assert all(got[k].kept for k in got if k < 200 or 300 <= k <= 900)
    assert not any(got[k].kept for k in got if 200 <= k < 300 or k == 901)


def test_decontaminate_finds_passages_anywhere():
    r = random.Random(5)
    signs = [chr(c) for c in range(0x4E00, 0x5200)]
    items = [(k, decontaminate.normal(prose(25, 900 + k))) for k in range(30)] + [(k, "".join(r.choice(signs) for _ in range(60))) for k in range(30, 60)]
    index = decontaminate.Index(items, 0.05, 9, 3, 20, 6)
    glue = lambda n: "".join(r.choice(signs if n % 2 else 'xyz{":,_') for _ in range(n))
    texts = [(k, f"before {glue(n)}{t}{glue(5)} after") for k, t in items for n in (5, 13, 20, 40, 41)]
    found = index.search([t for _, t in texts])
    assert all((k, 0) in [(index.item_id(i), d) for i, d, _ in f] for (k, _), f in zip(texts, found, strict=True))
    near = [(k, f"before {glue(13)}{t[:30]}{t[31:]} after") for k, t in items]
    assert sum(k in [index.item_id(i) for i, _, _ in f] for (k, _), f in zip(near, index.search([t for _, t in near]), strict=True)) >= 57


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("no markup &amp; text", "no markup & text"),
        ("<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One  two<br>three<p>Four &eacute;</article><div class='comments'><p>me too</p></div><footer>f</footer>", "Head\n\nOne two three\n\nFour é"),
        ("<body><div id=cookie-notice>Accept</div><main><p>Text <b>bold<p>more</main><script>var a='<p>x</p>'</script>", "Text bold\n\nmore"),
        ("<div class='content has-sidebar no-banner'><h1>Head</h1><p>One of the text</p></div><div class=sidebar><p>Side</p></div><section><article class=comment-body><p>A reader says so and so much</p></article></section>", "Head\n\nOne of the text"),
        ("<article class='post with-nav'><p>One of the text</p></article><div class=nav><p>Elsewhere</p></div>", "One of the text"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("wrap", ["{}", "<main>{}</main>", "<div><div>{}</div></div>"])
def test_html_density_decides_without_article(wrap):
    text = [f"Paragraph {k} of the story goes on for a good while, with commas, words and no links at all in it." for k in range(8)]
    paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    links = "".join(f"<li><a href=/{k}>Other story {k}</a></li>" for k in range(12))
    page = wrap.format(f"<div class=a><ul>{links}</ul></div><div class=b><h1>Head</h1><div>By <a href=/x>X</a></div><div class=c>{paragraphs(text)}</div></div><div class=d><h3>More</h3><div><a href=/1>One</a> in short</div><div><a href=/2>Two</a> in short</div></div>")
    assert html_text.main_text(f"<body>{page}</body>") == "\n\n".join(["Head", *text])
    split = wrap.format(f"<div>{paragraphs(text[:5])}</div><div><ul>{links}</ul></div><div>{paragraphs(text[5:])}</div>")
    assert html_text.main_text(f"<body>{split}</body>") == "\n\n".join(text)


@pytest.mark.parametrize("start, end", [("<form id=aspnetForm>", "</form>"), *[(f"<div class='{c}'>", "</div>") for c in ("content-with-sidebar", "layout right-sidebar", "site sidebar-left")], ("<form><div class='layout left-sidebar'>", "</div></form>")])
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_html_wrapped_article(start, end, tag):
    text = [f"Paragraph {k} of the story goes on for a good while, with commas and words." for k in range(4)]
    page = f"<head><title>t</title></head><body>{start}<div class=nav><a href=/>Home</a></div><{tag}><p>{'<p>'.join(text)}</{tag}><form class=search>Find a story</form><div class=sidebar>Some words on us</div>{end}<footer>f</footer></body>"
    assert html_text.main_text(page) == "\n\n".join(text)


def test_html_marked_text_beside_an_article():
    long = "A reader says so and so much. " * 20
    assert html_text.main_text(f"<article><p>Short text</article><div class=comments><p>{long}</div>") == "Short text"
    assert html_text.main_text(f"<main><article><p>Short text</article><aside><p>{long}</aside></main>") == "Short text"
    assert html_text.main_text(f"<div><p>Short text</div><div class=comments><p>{long}</div>") == "Short text"
    assert html_text.main_text(f"<p>Menu</p><div class=post-no-comments><h1>Head</h1><p>{long}</div>").startswith("Head\n\nA reader")
    assert html_text.main_text(f"<div hidden><p>{long}</div><div><p>Short text</div>") == "Short text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>Hello don't stop here</p><p>Next para</p>", "Hello don't stop here\n\nNext para"),
        ('<p>One</p><p title="a"">Two</p>', "One\n\nTwo"),
        ('<p title="a>One</p><p>Two</p>', "One\n\nTwo"),
        ("<p>One<!-->Two<!-- x --!>Three</p>", "OneTwoThree"),
        ("<p>One</p><script>if (a<b && c=\"x) y</script><p>Two \"said</p>", 'One\n\nTwo "said'),
        ("<p>One</p><svg/><svg/><p>Two</p><script src=x />var hidden</script>", "One\n\nTwo"),
        ("<a title='>'>T</a> &am<b>p;x</b> &lt;b&gt; &#x26;lt;", "T &amp;x <b> &lt;"),
        ("<p data-x = 'a > b' hidden=\"\">no</p><p>Yes, this is shown</p>", "Yes, this is shown"),
        ("plain < text and <3 and a<", "plain < text and <3 and a<"),
    ],
)
def test_html_tokens(page, text):
    assert html_text.main_text(page) == text


def test_html_density_matters(monkeypatch):
    story = "".join(f"<p>Paragraph {k} of the story goes on for a good while, with commas, words and no links at all in it.</p>" for k in range(5))
    page = "<body><div>" + "".join(f"<a href=/{k}>Other story {k}</a> " for k in range(15)) + f"</div><div>{story}</div><div><a href=/a>About</a> <a href=/b>Help</a></div></body>"
    text = html_text.main_text(page)
    assert text.startswith("Paragraph 0") and text.endswith("in it.") and text.count("\n\n") == 4
    measure = html_text._measure

    def flat(root):
        order = measure(root)
        for node in order:
            node.density, node.total = 1.0, 0.0
        return order

    monkeypatch.setattr(html_text, "_measure", flat)
    assert html_text.main_text(page) != text


def test_html_tables(spark):
    long = "<p>" + "word " * 200_000 + "</p>" + "<b>" * 20_000 + "x<hr>" * 2000 + "<div>" * 20_000 + "</i>" * 1000
    rows = [(1, "u", "<p>Same</p>"), (1, "u", "<p>Same</p>"), (2, None, None), (None, "v", ""), (BIG, "w", "<p>Large id</p>"), (3, "x", long)]
    pages = spark.createDataFrame([(*r, "text", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got if r.page_id != 3) == sorted([("1", "u", "Same"), ("1", "u", "Same"), ("2", "None", ""), ("None", "v", ""), (str(BIG), "w", "Large id")])
    assert all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) > 900_000
    assert html_text.extract(pages.limit(0)).count() == 0


def test_scratch_tables_are_swept(spark):
    table = scratch.materialize(spark.range(5), "swept")
    assert table.count() == 5
    with scratch.own_tables() as made:
        other = scratch.materialize(spark.range(3), "swept")
        scratch.drop(scratch.materialize(spark.range(3), "swept"))
    assert made == {other._waymark_path}
    scratch.sweep(spark, made)
    assert not made and not os.path.exists(other._waymark_path.removeprefix("file://")) and table.count() == 5
    scratch.drop(table)
    assert not os.path.exists(table._waymark_path.removeprefix("file://"))


def test_packing(spark, docs, none):
    got = packing.pack(docs, size=64, bucket_pieces=20).collect()
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for row in hard_rows():
        ids = [*t.encode(row[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(row[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]  # noqa: B905
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack(none).count() == 0


def test_ids_are_those_of_the_tokenizers_file():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = "/root/testdata/sf0.01/documents.parquet"
    texts = [x for x in pq.read_table(table)["text"].to_pylist() if x] if os.path.exists(table) else []
    r = random.Random(1)
    texts += ["".join(chr(r.choice((32, 32, 10, 9, 0xA0, r.randrange(33, 127), r.randrange(0x80, 0x2FFF), r.randrange(0x1F300, 0x1FAFF)))) for _ in range(200)) for _ in range(400)]
    texts += ["a" * 3000, " " * 500 + "x", "don't we'LL it's 12,345.67\r\n\r\n  end  ", packing.SPECIAL * 3 + " x " + packing.SPECIAL, prose(30_000, 9)]
    encode = packing.encoder()
    assert all(encode(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)
    assert len(list(packing.parts(texts[-1]))) > 1


def test_best_two_fit_is_tight():
    r = np.random.default_rng(1)
    n = r.integers(1, 1024, 4000)
    bins, offset = packing.best_two_fit(n, 1024)
    assert np.bincount(bins, n).max() <= 1024 and len(set(zip(bins, offset, strict=True))) == len(n)
    assert bins.max() + 1 <= 1.02 * max(n.sum() / 1024, (n > 512).sum())


def test_language(spark, docs, none):
    rows = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        r = random.Random(k)
        stems = {"en": ["the", "thing", "ow"], "de": ["der", "schü", "ung"], "fr": ["le", "eaux", "ère"]}[lang]
        rows.append((k, " ".join(r.choice(stems) + r.choice(stems) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "123 !", None), (None, "the thing the", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and all(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"}
    assert language.identify(docs).count() == len(hard_rows())
    assert language.identify(none).count() == 0


def test_rare_languages_are_learned(spark):
    """Ten documents of a language among thousands of others are all in the sample, and those held out are found."""
    r = random.Random(5)
    words = {"aa": "ka lo mi ru ta".split(), "bb": "sen vor dix pul gam".split(), "rare": "zzy qwx yyq xzw wqy".split()}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(30))
    rows = [(k, text("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb") for k in range(3000)] + [(10_000 + k, text("rare"), "rare") for k in range(10)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=60).collect()
    want = {d: lang for d, _, lang in rows}
    assert sum(x.lang_pred == want[x.doc_id] for x in got) >= 0.99 * len(rows) and all(x.lang_pred == "rare" for x in got if x.doc_id >= 10_000)


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_quality(spark, docs, none):
    rows = [(k, prose(60, k) if k % 3 else (prose(10, k) + " # $ % ") * 6) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and held and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, labels).collect())
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_licenses(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.txt", "plain words of a text"), (3, "p/a/y.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "q/z.txt", "plain"), (5, "p/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "p/b/c/d.txt", ""), (7, None, None), (8, "top.txt", None),
    ]
    got = {r.doc_id: (r.license, r.how, r.license_dir) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "p"), 3: ("Apache-2.0", "header", None), 4: (None, None, None), 5: ("GPL-3.0", "file", None), 6: ("GPL-3.0", "inherited", "p/b"), 7: (None, None, None), 8: (None, None, None)}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by brute force: with one language nothing is ambiguous, and planted passages are exact."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    item = prose(40, 901).replace("\n", " ")
    rows = [(k, prose(80, 100 + k), "en", "s", 1) for k in range(12)]
    rows += [(20, rows[3][1], "en", "s", 1), (21, "123 456", "en", "s", 1), (22, prose(50, 300) + " " + item + " end", None, "s", 1), (23, None, "en", None, None), (24, "", "en", "s", 0), (25, rows[5][1] + " more", "en", "s", 1)]
    rows += [(None, prose(60, 400), "en", "s", 1), (None, prose(60, 400), "en", "s", 1), (26, prose(70, 401), "en", "s", 1), (26, prose(70, 401), "en", "s", 1), (BIG, prose(3000, 402), "en", "s", 1), (27, rows[2][1].split("\n")[0] + "\n" + prose(30, 403), "en", "s", 1)]
    # A result from before the pipeline that is read after it.
    live = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for part, more in (("plain", ""), ("clash", ", fp long, _text string, lid long, held_out boolean, draw long")):
        table = [r + (5, "x", 6, True, 7) for r in rows] if more else rows
        folder = f"{tmp_path}/{part}"
        spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long" + more).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"file://{folder}").collect()

        left = [r[:2] for r in rows if any(map(str.isalpha, r[1] or ""))]
        left = [(r[0], b[3]) for r, b in zip(left, brute_lines(left), strict=True)]
        names = brute_components(left, [brute_fingerprint(t) for _, t in left])
        left = [(i, t) for (i, t), c in zip(left, names, strict=True) if i is None or i == c]
        left = [(i, t) for i, t in left if i is None or decontaminate.normal(item) not in decontaminate.normal(t)]
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = []
        for i, t in left:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
        used = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == used[r.sequence_id]
            used[r.sequence_id] += r.length
        assert max(used.values()) <= 1024 and len({r.doc_id for r in got} & set(range(12))) >= 11 and not {21, 22, 23, 24} & {r.doc_id for r in got}
    assert live.count() == len(rows)
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0 and len(corpus_pipeline.STAGES) == 5


OPERATORS = {
    "substrings": lambda df, more: substrings.dedupe_substrings(df),
    "licenses": lambda df, more: licenses.scan(df.withColumn("path", F.lit("a/b.txt"))),
    "simhash": lambda df, more: simhash.near_duplicates(df),
    "decontaminate": lambda df, more: decontaminate.contaminated(df, more),
    "rules": lambda df, more: rules.quality_rules(df),
    "html": lambda df, more: html_text.extract(df.withColumn("url", F.lit("u")), id_col="doc_id", html_col="text").withColumnRenamed("page_id", "doc_id"),
    "packing": lambda df, more: packing.pack(df),
    "language": lambda df, more: language.identify(df),
    "quality": lambda df, more: quality.quality_scores(df, more),
    "lines": lambda df, more: lines.dedupe_lines(df),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_large_ids_beside_nulls_and_clashing_columns(spark, name):
    item = prose(60, 3).replace("\n", " ")
    names = "x w z m q g n s e fp gid lid row doc line letters first draw known found pieces level start bin v _text text_ _file path_ bucket sequence_id score held_out lang_pred place".split()
    spec = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names)
    rows = [(i, f"{prose(25, k)} {item} {prose(9, 50 + k)}", "en", "s", *["?"] * len(names)) for k, i in enumerate((BIG, None, BIG + 2, -BIG, 2**63 - 1))]
    more = spark.createDataFrame([(BIG, BIG, item, 1)], "item_id long, doc_id long, text string, quality int")
    got = OPERATORS[name](spark.createDataFrame(rows, spec), more).collect()
    assert sorted({str(r.doc_id) for r in got}) == sorted(str(r[0]) for r in rows)
    if name == "decontaminate":
        assert {r.item_id for r in got} == {BIG}
    if name == "quality":
        assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows if r[0] is not None}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_all_null_tables(spark, name):
    spec = "doc_id long, text string, lang string, source string"
    more = spark.createDataFrame([], "item_id long, doc_id long, text string, quality int")
    assert OPERATORS[name](spark.createDataFrame([], spec), more).count() == 0
    got = OPERATORS[name](spark.createDataFrame([(None, None, None, None)] * 3, spec), more).collect()
    assert len(got) == (0 if name == "decontaminate" else 3) and all(r.doc_id is None for r in got)


def test_decontamination_against_exhaustive_search(spark):
    """All pairs of documents and items by exact alignment: nothing is found that is not there, nothing exact is missed, and little else."""
    r = random.Random(12)
    items = [(k, prose(r.randrange(8, 40), 700 + k).replace("\n", " ")) for k in range(12)] + [(50, prose(20, 700)), (51, "tiny"), (52, ""), (53, None), (50, prose(20, 700))]
    docs = []
    for k in range(60):
        _, t = items[k % 12]
        x = list(t)
        for _ in range(k % 4):
            at = r.randrange(len(x))
            x[at : at + 1] = r.choice(([], ["z"], ["z", x[at]]))
        docs.append((k if k != 7 else None, f"{prose(30, k)}{' ' * (k % 3)}{''.join(x)}{prose(20, 90 + k)}"))
    docs += [(100, items[0][1] + " " + items[1][1] + " " + items[0][1]), (100, items[0][1] + " " + items[1][1] + " " + items[0][1]), (101, "it is tiny here"), (102, ("word " * 300_000) + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((str(g.doc_id), g.item_id, g.distance) for g in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    want = Counter()
    for i, t in docs[:-1]:
        for k, x in items:
            x, text = decontaminate.normal(x or ""), decontaminate.normal(t)
            best = decontaminate.best_alignment(x, text, decontaminate.allowed_edits(len(x), 0.05, 9)) if x else None
            if best:
                want[str(i), k, best[0]] += 1
    want["102", 2, 0] += 1
    assert {k for k in want if k[2] == 0} == {k for k in got if k[2] == 0} and all(got[k] == want[k] for k in got)
    assert sum(got.values()) >= 0.95 * sum(want.values())


def test_licenses_against_brute_force(spark):
    """Dense vectors over all terms, all lines and all runs of lines."""
    notices = {"A": ("alpha beta gamma delta epsilon", "this text is under the licence alpha of beta"), "B": ("permission is granted to use zeta eta theta in any way",)}
    terms = licenses.terms
    r = random.Random(4)
    pool = [w for t in notices.values() for n in t for w in terms(n)] + ["plain", "words", "here"]
    texts = [None, "", "plain\n\n"] + ["\n".join(" ".join(r.choice(pool) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    for k in range(20):
        t = r.choice([n for ns in notices.values() for n in ns]).split()
        cut = r.randrange(1, len(t))
        texts.append("intro\n" + " ".join(t[:cut]) + "\n// " + " ".join(t[cut:]) + r.choice(["", " plain", "\nend"]))
    rows = [(k, f"d{k}/{'LICENSE' if k % 7 == 0 else 'x.txt'}", t) for k, t in enumerate(texts)] + [(99, "d5/x.txt", texts[5])]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted((x.doc_id, x.license, x.how, x.score) for x in licenses.scan(files, templates=notices).collect())

    vocabulary = {w for ns in notices.values() for n in ns for w in terms(n)}
    df = Counter(w for *_, t in rows for w in vocabulary & set(terms(t or "")))
    weight = lambda w: math.log((len(rows) + 1) / (df[w] + 1)) + 1

    def cosine(a, b):
        x, y = Counter(a), Counter(b)
        dot = sum(x[w] * y[w] * weight(w) ** 2 for w in x)
        return dot / math.sqrt(sum((n * weight(w)) ** 2 for w, n in x.items()) * sum((n * weight(w)) ** 2 for w, n in y.items())) if x and y else 0

    want = []
    for i, path, t in rows:
        lines_ = [x for x in map(terms, (t or "").split("\n")) if x]
        runs = [[w for x in lines_[a:b] for w in x] for a in range(len(lines_)) for b in range(a + 1, len(lines_) + 1)]
        scored = [(-round(c, 9), name) for run in runs for name, ns in notices.items() for n in ns if (c := cosine(run, terms(n))) >= 0.8]
        best = min(scored, default=None)
        want.append((i, best and best[1], best and ("file" if path.endswith("LICENSE") else "header"), best and round(-best[0], 6)))
    assert [g[:3] for g in got] == sorted(w[:3] for w in want) or [(g, w) for g, w in zip(got, sorted(want, key=str), strict=True) if g[:3] != w[:3]] == []
    by_id = {(w[0], w[1]): w[3] for w in want}
    assert all(g[3] is None or abs(g[3] - by_id[g[0], g[1]]) < 1e-5 for g in got) and sum(g[1] is not None for g in got) > 15


def test_licenses_wrapped_and_whole(spark):
    texts = licenses.full_texts()
    rows = [(k, f"{name}/LICENSE", "Copyright (c) 2020 Jane Doe\n\n" + "\n".join(textwrap.wrap(t[0], 70))) for k, (name, t) in enumerate(texts.items())]
    rows += [(100 + k, f"{name}/src/x.c", "plain") for k, name in enumerate(texts)]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = texts["BSD-3-Clause"][0]
    for k, t in enumerate([gpl, bsd, licenses.TEMPLATES["MIT"][2]]):
        rows.append((200 + k, f"h/{k}.py", "# Copyright 2020\n#\n" + "\n".join("# " + x for x in textwrap.wrap(t, 60)) + "\n\nimport os\n"))
    got = {r.doc_id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(texts):
        assert (got[k], got[100 + k]) == ((name, "file"), (name, "inherited"))
    assert [got[200 + k] for k in range(3)] == [("GPL-3.0", "header"), ("BSD-3-Clause", "header"), ("MIT", "header")]


def test_quality_scores_against_plain_formulas(spark):
    """Moments over all labelled training rows and log densities by inverse and determinant."""
    rows = [(k, prose(20 + k % 50, k) if k % 3 else (prose(10, k) + " # $ % ") * (2 + k % 4)) for k in range(200)] + [(None, prose(30, 1)), (500, ""), (501, None)]
    marks = [(k, int(k % 3 != 0)) for k in range(0, 200, 2)] + [(8, 1), (9999, 1), (None, 0), (10, 7)]
    got = {(r.doc_id, r.held_out): r.score for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    texts = dict(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    train = [(quality.features(texts[i]), y) for i, y in marks if i is not None and i in texts and y in (0, 1) and not held(i)]
    x = {y: np.array([v for v, z in train if z == y]) for y in (0, 1)}
    covariance = lambda a: (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / len(a)
    pooled = sum(covariance(a) * len(a) for a in x.values()) / len(train)
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))

    def log_density(v, a):
        c = 0.9 * covariance(a) + 0.1 * target + 1e-6 * np.eye(len(v))
        d = v - a.mean(axis=0)
        return -0.5 * (d @ np.linalg.inv(c) @ d + np.linalg.slogdet(c)[1])

    for i, t in rows:
        v = np.array(quality.features(t))
        gap = log_density(v, x[1]) - log_density(v, x[0]) + math.log(len(x[1]) / len(x[0]))
        assert abs(got[i, held(i)] - 1 / (1 + math.exp(-max(min(gap, 500), -500)))) < 1e-6


def test_languages_against_plain_formulas(spark):
    """n-grams counted one by one, ridge classifiers by least squares, and losses summed bit by bit."""
    stems = {"en": ["the", "thing", "ow"], "de": ["der", "schü", "ung"], "fr": ["le", "eaux", "ère"]}
    rows = []
    for k in range(90):
        r, lang = random.Random(k), ("en", "de", "fr")[k % 3]
        rows.append((k, " ".join(r.choice(stems[lang]) + r.choice(stems[lang if r.random() < 0.9 else "en"]) for _ in range(1 + k % 20)), lang if k % 11 else None))
    rows += [(200, "123", "en"), (201, None, "en"), (None, "the der le", "fr"), (202, "Ωmega thing", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    m = (1 << 32) - 1

    def vector(t):
        codes = [32, *((c if chr(c).isalpha() else 32) if c < 128 else min(c, 0xFFFF) for c in map(ord, t.lower())), 32]
        v = np.zeros(language.DIM)
        for i, a in enumerate(codes):
            one = a * 0x9E3779B1 & m
            v[one >> 21] += 1
            if i + 1 < len(codes):
                two = (one ^ codes[i + 1] * 0x85EBCA77 & m) * 0xC2B2AE3D & m
                v[two >> 21] += 1
                if i + 2 < len(codes):
                    v[((two ^ codes[i + 2] * 0x27D4EB2F & m) * 0x165667B1 & m) >> 21] += 1
        return np.append(np.sqrt(v) / np.linalg.norm(np.sqrt(v)), 1)

    train = [(vector(t), lang) for i, t, lang in rows if i is not None and lang and language.has_letter(t) and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({y for _, y in train})
    code = language.codewords(len(names))
    weight = np.array([1 / sum(z == y for _, z in train) for _, y in train])
    x, bits = np.array([v for v, _ in train]), np.array([code[names.index(y)] for _, y in train])
    ridge = 0.05 * weight.sum() / len(train)
    root = np.sqrt(weight)[:, None]
    w = np.linalg.lstsq(np.vstack([x * root, math.sqrt(ridge) * np.eye(x.shape[1])]), np.vstack([bits * root, np.zeros((x.shape[1], code.shape[1]))]), rcond=None)[0]
    trust = np.maximum(1 - (np.maximum(0, 1 - bits * (x @ w)) * weight[:, None]).sum(axis=0) / weight.sum(), 0.05)
    trust /= trust.sum()
    for i, t, _ in rows:
        if not language.has_letter(t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        margin = vector(t) @ w
        losses = [sum(trust[b] * max(0, 1 - margin[b] * row[b]) for b in range(len(trust))) for row in code]
        share = np.exp(-6 * np.array(losses))
        assert got[i].lang_pred == names[int(np.argmin(losses))] and abs(got[i].score - max(share) / share.sum()) < 1e-3
        assert got[i].ambiguous == (sorted(losses)[1] - min(losses) < 0.02) or abs(sorted(losses)[1] - min(losses) - 0.02) < 1e-3


def test_html_on_generated_pages():
    """Articles in plain divs among lists of links, notices and footers of many makes: all of the article and nothing else."""
    r = random.Random(3)
    word = lambda: r.choice(VOCAB)
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<li><a href='/{k}'>{word()} {word()}</a></li>" for k in range(n))
    rest = [
        lambda: f"<ul>{links(r.randrange(4, 15))}</ul>", lambda: f"<div><span><a href=#>{word()}</a> | <a href=#>{word()}</a></span></div>", lambda: f"<footer>{sentence(6)}</footer>", lambda: f"<nav><ul>{links(5)}</ul></nav>",
        lambda: f"<div class='cookie-notice'>{sentence(9)}<button>OK</button></div>", lambda: f"<script>var a = '<p>{sentence(30)}</p>';</script>", lambda: f"<aside>{sentence(12)}</aside>", lambda: "<style>p { color: red }</style>", lambda: f"<!-- <p>{sentence(20)}</p> -->",
    ]
    for _ in range(60):
        blocks = [sentence(r.randrange(20, 60)) for _ in range(r.randrange(4, 9))]
        made = "".join(r.choice(("<p>{}</p>", "<p class=x>{}", "<p>\n {}\n</p>")).format(b.replace(" ", r.choice((" ", " ", "\n", "&#32;")), 2)) for b in blocks)
        title = sentence(4)
        before, after = "".join(r.choice(rest)() for _ in range(r.randrange(4))), "".join(r.choice(rest)() for _ in range(r.randrange(4)))
        wrap = r.choice(("<div>{}</div>", "<div><div>{}</div></div>", "<section>{}</section>", "<article>{}</article>", "<main>{}</main>"))
        page = f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{before}{wrap.format(f'<h1>{title}</h1>{made}')}{after}</body></html>"
        assert html_text.main_text(page) == "\n\n".join([title, *blocks])
