"""Operators 11 to 13 against brute force, on rows with every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webtables.llm import merkle, simhash, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", None]), "en", k) for k in range(330)]
    base = prose(400)
    for k in range(60):  # near copies: some words differ
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 + k, " ".join(w).upper() if k % 2 else "\n".join(w), "ä", None, None))
    rows += [(2000, None, "z", None, None), (2001, "", "z", "", 0), (2002, " \t\n", "Z", "x", 1), (2003, "one", "lone", None, 3), (2004, "ONE  ", "", None, None)]
    rows += [(None, base, "a", None, None), (None, None, None, None, None), (2003, "one", "lone2", None, 3), (2003, "one", "lone2", None, 3), (-7, prose(20_000), "b", "en", -1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    names = ["id", "fp", "salt", "least", "home", "anchor", "component", "tree", "pos", "n", "digest", "own", "root", "_key", "leaf"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])


# --- 11 ----------------------------------------------------------------------


def brute_manifest(rows):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t)
    groups = {}
    for i, text, source, lang, n in rows:
        leaf = h(enc(i), enc(source), enc(lang), enc(n), enc(text))
        bad = h(enc(i), enc(source), enc(lang), enc(n), enc(lower(text))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        groups.setdefault(source, []).append(((i is not None, i or 0, leaf), i, leaf, bad))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[k : k + 16]) for k in range(0, len(last), 16)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            out.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
            at //= 16
        return out

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for at, (_, i, leaf, bad) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            steps = path(trees[s], at) + path(top, j)
            folded = bad or leaf
            for k, sib in steps:
                folded = h(*sib[:k], folded, *sib[k:])
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h(*[d for _, sib in steps for d in sib]), folded, folded == top[-1][0]))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_manifest(spark, docs):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    want = brute_manifest(documents())
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} == {True, False}
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_manifest_over_several_rounds_and_many_groups(spark):
    rows = [(k, "T%d" % k, "s" if k < 9000 else f"g{k % 20}", None, None) for k in range(9400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(got) == sorted(brute_manifest(rows))
    one = spark.createDataFrame(rows[:1], df.schema)
    assert [tuple(r) for r in merkle.manifest(one).collect()] == brute_manifest(rows[:1])


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 4096])
def test_sweeps_prove_each_leaf(n):
    digests = [hashlib.sha256(str(k).encode()).hexdigest().encode() for k in range(n)]
    levels = merkle.forward(digests, merkle.height(n))
    assert len(levels[-1]) == 1
    for d, s in zip(digests, merkle.backward(levels, None), strict=True):
        assert merkle.prove(d, s)[1] == levels[-1][0].decode()


# --- 12 ----------------------------------------------------------------------


def vectors(spark, m):
    rows = [(k, [float(c) for c in v], "x") for k, v in enumerate(m)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")


def check_whitened(rows, x, components):
    n, d = x.shape
    y = x - x.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, components + 1))
    w = np.zeros((n, components))
    for c, part in by.items():
        part.sort(key=lambda r: r.vec_id)
        w[:, c - 1] = [r.whitened for r in part]
        want = y @ axes[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign((w[:, c - 1] * want).sum())
        assert np.abs(w[:, c - 1] - sign * want).max() < 1e-6
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-9 for r in part)
        exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, x.sum(0), strict=True)) for v in x]
        assert [r.deviation for r in part] == exact and {r.n for r in part} == {n}
    error = np.abs(np.cov(w.T, bias=True).reshape(components, -1) - np.eye(components)).max()
    assert error < 1e-9 and all(r.identity_error < 1e-9 for r in rows)


def test_whitening(spark):
    rng = np.random.default_rng(0)
    m = (rng.standard_normal((500, 12)) * 2.0 ** -np.arange(12)).astype(np.float32)
    fit = vectors(spark, m)
    bad = spark.createDataFrame([(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 5), (905, []), (906, [1e30] + [0.0] * 11)], "vec_id long, embedding array<double>")
    both = fit.unionByName(bad.withColumn("embedding", F.col("embedding").cast("array<float>")), allowMissingColumns=True).repartition(3)
    x = np.floor(m.astype(float) * 1024).astype(np.int64) + 100_000
    check_whitened(whitening.whitened(both).collect(), x, 8)


def test_whitening_of_dependent_and_equal_rows(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 50, (300, 3)) @ rng.integers(-3, 4, (3, 10)) / 1024.0  # three dimensions in ten
    m[7] = m[3]
    rows = whitening.whitened(vectors(spark, m)).collect()
    x = np.floor(np.float32(m).astype(float) * 1024).astype(np.int64) + 100_000
    check_whitened(rows, x, int(np.linalg.matrix_rank(x - x.mean(0))))
    assert whitening.whitened(vectors(spark, [[0.5] * 4] * 9)).collect() == []
    assert whitening.whitened(vectors(spark, [[0.5] * 4])).collect() == []
    assert whitening.whitened(vectors(spark, [[0.5] * 4]).limit(0)).collect() == []


def test_whitening_of_nearly_dependent_columns():
    rng = np.random.default_rng(2)
    y = rng.standard_normal((400, 6))
    y[:, 5] = y[:, 0] + 1e-9 * y[:, 5]
    r, factors = np.eye(6), []
    for _ in range(whitening.PASSES):
        q = y
        for f in factors:
            q = np.linalg.solve(f.T, q.T).T
        factors.append(whitening.shifted_cholesky(q.T @ q, len(y)))
        r = factors[-1] @ r
    got, want = np.linalg.svd(r)[1], np.linalg.svd(y)[1]
    assert np.allclose(got[:5], want[:5], rtol=1e-10) and got[5] < 1e-6


def test_deviation_beyond_a_long_is_null(spark):
    far = vectors(spark, [[0.0], [0.0], [0.0]] + [[float(2**31)]])
    assert {r.deviation for r in whitening.whitened(far).collect()} == {None}


# --- 13 ----------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """The least id reachable for each (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_simhash_components(docs):
    fps = [(r[0], brute_fingerprint(r[1])) for r in documents()]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps), strict=True)]
    assert len({c for _, _, c in want if c and c >= 1000}) < 40  # there are links
    got = [tuple(r) for r in simhash.near_components(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_components(docs.limit(0)).collect() == []
    nameless = docs.where("doc_id IS NULL")
    assert {r.component_id for r in simhash.near_components(nameless).collect()} == {None}


@pytest.mark.parametrize("most", [2048, 3, 1])
def test_every_link_is_found_at_every_depth(spark, most):
    """Dense families of fingerprints, so that crowded anchors go through all codes."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:6]:
        for _ in range(80):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps)) + [0, 1, 3, 7, (1 << 64) - 1]
    rows = [(int(np.uint64(x).view(np.int64)),) for x in set(fps)]
    links = simhash.links(spark.createDataFrame(rows, "fp long"), most_homes=most).collect()
    pairs = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links]
    assert all((a ^ b).bit_count() <= 2 * 64 for a, b in pairs)
    label = {x: x for x in set(fps)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components([(k, x) for k, x in enumerate(sorted(set(fps)))])
    got = {}
    for k, x in enumerate(sorted(set(fps))):
        got.setdefault(find(x), k)
    assert [got[find(x)] for x in sorted(set(fps))] == want


def test_covering_code():
    """Every syndrome has one error of weight 3 at most: each word has one home."""
    assert (np.diff(simhash.golay_errors(0)[1]) == 1).all()
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    for code in simhash.CODES:
        row, anchor, home = simhash.places(fp, code, 2)
        assert (np.bincount(row[home], minlength=200) == 1).all()
        at = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
        reach = set(zip(row.tolist(), anchor.tolist(), strict=True))
        assert len(reach) == len(row)
        for k in range(0, 200, 7):  # a word two bits off meets the first one at its home
            near = fp[k : k + 1] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
            _, other, _ = simhash.places(near, code, 2)
            assert at[k] in other.tolist()
