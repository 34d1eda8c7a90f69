"""Merkle manifest, whitening and mixing against brute force, and hard cases of their tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragmill.llm import merkle, mixing, whitening

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, root string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], DOC)


def hash_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return hash_of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hash_of(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, j):
    for level in levels[:-1]:
        k = j - j % 3
        yield level[k:j], level[j + 1 : k + 3]
        j //= 3


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    trees = {}
    for source, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[source] = (mine, levels_of([leaf_of(*r) for r in mine]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for j, r in enumerate(trees[s][0]):
            path = [*siblings(trees[s][1], j), *siblings(top, at)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf_of(r[0], r[1].replace("\n", ""), *r[2:]) if changed else leaf_of(*r)
            for left, right in path:
                h = hash_of(*left, h, *right)
            out.append((r[0], leaf_of(*r), trees[s][1][-1][0], top[-1][0], hash_of(*[x for pair in path for side in pair for x in side]), h, h == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows):
    got = merkle.manifest(documents(spark, rows))
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect())


def hard_rows():
    rnd = random.Random(4)
    rows = [(i, f"line {i}\nline {rnd.random()}", "en", "hot", i) for i in range(120)]
    rows += [(i, None if i % 3 == 0 else "a\nb", None, None, None) for i in range(200, 210)]
    rows += [(None, "no id\n", "de", "b", 1), (None, "no id\n", "de", "b", 1), (None, "other", "de", "b", 2), (300, "", "", "", 0), (301, "x\n" * 60_000, "fr", "é", 9)]
    return rows + [(400, "same\nrow", "en", "copies", 8)] * 30 + [(401, "ties\n" + "t" * k, "en", "copies", 8) for k in range(5)]


@pytest.mark.parametrize("limits", [(5, 8), (1, 1), (1, 2)])
def test_manifest(spark, monkeypatch, limits):
    monkeypatch.setattr(merkle, "WHOLE", limits[0])
    monkeypatch.setattr(merkle, "MOST", limits[1])  # many tiers of small blocks
    assert manifest_rows(spark, hard_rows()) == manifest_by_hand(hard_rows())


def test_manifest_small(spark):
    one = [(1, "a\nb", "en", "s", 3)]
    assert manifest_rows(spark, one) == manifest_by_hand(one)
    assert manifest_rows(spark, []) == Counter()


def test_van_emde_boas_order():
    for levels in range(1, 8):
        places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
        assert sorted(np.concatenate(places)) == list(range(merkle.nodes_of(levels)))
        assert places[0][0] == 0
        lower = levels - levels // 2  # a subtree below the upper half lies in one run, ordered as a tree of its own
        for k in range(3 ** (levels // 2) if levels > 1 else 0):
            start = places[levels // 2][k]
            for d in range(lower):
                own = places[levels // 2 + d][k * 3**d : (k + 1) * 3**d] - start
                assert (own == merkle.address(lower, d, np.arange(3**d))).all()


def test_block_paths_fold_to_the_root():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(50)]
    nodes = merkle.build_block(leaves, 4)
    for leaf, path in zip(leaves, merkle.block_paths(nodes, 4, 50), strict=True):
        assert merkle.fold(leaf.hex(), path) == nodes[0].tobytes().hex()


def whitened_by_hand(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ basis / np.sqrt(values), values / np.trace(cov)


def assert_whitened(spark, rows, good, k=16):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int").repartition(3)).toPandas()
    n, dev, w, share = whitened_by_hand([v for _, v in good], k)
    assert len(got) == len(good) * k
    got = got.sort_values(["vec_id", "component"])
    z = got["whitened"].to_numpy().reshape(len(good), k)
    z = z * np.sign((z * w).sum(0))
    assert np.abs(z - w).max() < 1e-7
    assert (got["n"] == n).all() and (got["deviation"].to_numpy().reshape(-1, k) == dev[:, None]).all()
    assert np.allclose(got["explained"].to_numpy()[:k], share, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-9


def vectors_of(count, d, seed=1):
    rnd = np.random.default_rng(seed)
    return (rnd.standard_normal((count, d)) * np.linspace(3, 0.5, d)).astype(np.float32).tolist()


@pytest.mark.parametrize("d", [20, 70])
def test_whitening(spark, d):
    good = list(enumerate(vectors_of(300, d)))
    good += [(1000 + i, good[5][1]) for i in range(40)]  # repeated vectors count once in the fit list
    bad = [(2000, None), (2001, []), (2002, [None, *good[0][1][1:]]), (2003, [math.nan, *good[0][1][1:]]), (2004, [math.inf, *good[0][1][1:]]), (2005, [1.0, 2.0]), (2006, [3e38, *good[0][1][1:]])]
    assert_whitened(spark, [(i, v, 1, "clash", 2) for i, v in good + bad], good)


def test_whitening_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    got = whitening.whiten(frame([(None, [1.0, 2.0, 5.0]), (2, [2.0, 4.0, 5.0]), (2, [2.0, 4.0, 5.0])])).toPandas()
    assert len(got) == 3 and (got["component"] == 1).all() and np.allclose(got["whitened"].abs(), 1) and np.allclose(got["explained"], 1)


def test_whitening_large_entries(spark):
    rows = [(i, [float(2**40 * ((i * 7) % 5)), float(2**41 * ((i * 3) % 4))]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 24 and got["deviation"].isna().all() and got["identity_error"].iat[0] < 1e-9


def test_filter_reaches_close_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([np.linspace(2, 1.9, 20), np.linspace(1.8, 0.1, 100)])
    cov = (q * values) @ q.T
    got, basis = whitening.leading_components(lambda m: cov @ m, 120, 16)
    assert np.allclose(got, values[:16], rtol=1e-12)
    assert np.abs(np.abs((basis * q[:, :16]).sum(0)) - 1).max() < 1e-9


def targets_by_hand(size):
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(size.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * size[s]
            left -= out[s]
            free.discard(s)
    return out


def mix_rows():
    rnd = random.Random(8)
    word = lambda n: " ".join(["w"] * n)
    rows = [(i, word(int(rnd.lognormvariate(4, 1))), "en", "hot", 0) for i in range(1500)]
    rows += [(2000 + i, word(rnd.randrange(30)), "en", s, 0) for i, s in enumerate(["a", "b", "é", None, "z"] * 60)]
    rows += [(2500 + i, word(20), "en", "long", 0) for i in range(900)] + [(2499, word(9_000), "en", "long", 0)]
    rows += [(3000, word(50), "en", "copies", 0)] * 301 + [(None, None, None, "b", None), (None, "x y", None, None, None), (None, word(120_000), "en", "hot", 1), (4000, None, "en", "void", 0), (4001, " \n", "en", "void", 0)]
    return rows


def test_mix(spark):
    rows = mix_rows()
    got = mixing.mix(documents(spark, rows).repartition(5)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    want = targets_by_hand({s: sums[s] for s in {r[3] for r in rows}})
    of = defaultdict(set)
    for r in rows:
        of[r[0], size(r[1])].add(r[3])
    taken = Counter()
    for r in got:
        source = next(s for s in of[r["doc_id"], r["size"]] if sums[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6)
        taken[source] += r["taken"]
        assert r["taken"] in ({0} if not r["size"] else {r["size"] * math.floor(want[source] / sums[source] + k) for k in (0, 1)}) and r["taken"] <= 3 * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(9)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"], r["target"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_small(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.mix(documents(spark, [(1, None, "en", None, 0)])).collect()] == [(1, 0, 0, 0.0, 0)]
    assert [tuple(r) for r in mixing.mix(documents(spark, [(1, "a b", "en", "s", 0)])).collect()] == [(1, 2, 2, 2.0, 2)]


def test_pivot_keeps_words_and_expectations():
    rnd = random.Random(1)
    for _ in range(300):
        p, q, a, b = rnd.random(), rnd.random(), rnd.randrange(1, 50), rnd.randrange(1, 50)
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        chance = down / (up + down)
        high, low = mixing.pivot(p, a, q, b, 0.0), mixing.pivot(p, a, q, b, 1.0)
        for got in (high, low):
            assert abs(a * got[0] + b * got[1] - a * p - b * q) < 1e-6
            assert got[0] in (0.0, 1.0) or got[1] in (0.0, 1.0)
        assert abs(chance * high[0] + (1 - chance) * low[0] - p) < 1e-6


def test_settle_passes_choices_on():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = sorted((int(2 ** (k + rnd.random())) for k in range(1, 12)), reverse=True)
        p = [rnd.random() for _ in sizes]
        got = mixing.settle(sizes, p, [rnd.random() for _ in sizes])
        want = sum(s * x for s, x in zip(sizes, p, strict=True)) + 5000 * 0.4
        some = mixing.settle(sizes, p, [rnd.random() for _ in sizes], 5000, 0.4)
        assert 0 <= want - sum(s * x for s, x in zip(sizes, some, strict=True)) <= 5000  # the others can make up for it
        gap = max(a - sum(sizes[i + 1 :]) for i, a in enumerate(sizes))  # what no smaller documents can make up for
        assert abs(sum(s * x for s, x in zip(sizes, got, strict=True)) - sum(s * x for s, x in zip(sizes, p, strict=True))) <= gap
