"""SimHash, whitening and centroid clustering against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import catalog, centroids, common, eigen, simhash, whitening, words

SF_DIR = "/root/testdata/sf0.001"
NONE, NAN, INF = None, float("nan"), float("inf")


# SimHash --------------------------------------------------------------------------------------


def term_hash(parts):
    """The hash of one word, or of a shingle of several, from single-word hashes."""
    mask = (1 << 64) - 1
    data = [np.frombuffer(p.encode(), np.uint8) for p in parts]
    single = [int(words.span_hashes(d, np.array([0]), np.array([len(d)]))[0]) for d in data]
    if len(parts) == 1:
        return single[0]
    h = len(parts)
    for one in single:
        h = int(words._mixed(np.array([(h * 0x9E3779B97F4A7C15 + one) & mask], np.uint64))[0])
    return h


def plain_fingerprint(text):
    """Votes bit by bit."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    terms = Counter(term_hash([w]) for w in found)
    width = min(5, len(found))
    if width:
        for i in range(len(found) - width + 1):
            if width > 1:
                terms[term_hash(found[i : i + width])] += 1
            else:
                mixed = words._mixed(np.array([(0x9E3779B97F4A7C15 + term_hash(found)) & (2**64 - 1)], np.uint64))
                terms[int(mixed[0])] += 1
    if not terms:
        return "0" * 32
    votes, least = [0] * 128, min(terms)
    for h, n in terms.items():
        second = int(words._mixed(np.array([(h + 0xA0761D6478BD642F) & (2**64 - 1)], np.uint64))[0])
        bits = [b >> s & 1 for word in (h, second) for b in word.to_bytes(8, "little") for s in range(7, -1, -1)]
        for i, bit in enumerate(bits):
            votes[i] += (2 * n.bit_length() + (h == least)) * (1 if bit else -1)
    packed = [int("".join("1" if v > 0 else "0" for v in votes[i : i + 8]), 2) for i in range(0, 128, 8)]
    return "".join(f"{int.from_bytes(bytes(packed[i : i + 8]), 'little'):016x}" for i in (0, 8))


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def simhashed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, hi string, _text string, n_near int")
    marked = simhash.with_edited(df)
    searched = simhash.with_near(marked, F.col("_id") % 2 == 0, **options)
    return searched.withColumn("mark", simhash.text_of("hi", "lo")).withColumn("next_mark", simhash.text_of("next_hi", "next_lo"))


def test_simhash_query(spark):
    documents = {r.doc_id: r.text or "" for r in common.read(spark, SF_DIR, "documents").collect()}
    order = sorted(documents, reverse=True)
    rows = {r.doc_id: r for r in catalog.op11_simhash(spark, SF_DIR).collect()}
    assert sorted(rows) == sorted(documents)
    marks = {d: r.fingerprint for d, r in rows.items()}
    for place, doc in enumerate(order):
        text, after = documents[doc], order[(place + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + documents[after][:half]
        row = rows[doc]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if place % 10 == 0:
            assert row.fingerprint == plain_fingerprint(text) and row.edited_fingerprint == plain_fingerprint(edited)
        assert row.near_edited == 1 - apart(row.fingerprint, row.edited_fingerprint) / 128
        assert row.near_next == 1 - apart(row.fingerprint, marks[after]) / 128
        near = sum(apart(row.fingerprint, m) <= 4 for d, m in marks.items() if d != doc)
        assert row.n_near == (near if doc % 20 == 0 else None)
    likelier = [r.near_edited > r.near_next for d, r in rows.items() if len(documents[d].split()) > 20]
    assert sum(likelier) / len(likelier) > 0.97


@pytest.mark.parametrize("crowd", [512, 3])
def test_simhash_finds_all_within_the_radius(spark, monkeypatch, crowd):
    """Near copies of a few texts, exact ones too; with the small limit crowded keys are cut into grids."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(400)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(400)] = word()
            rows += [(len(rows) + i, " ".join(copy), None, None, None) for i in range(rng.choice([1, 1, 3]))]
    for radius, blocks in ((4, 6), (9, 11), (0, 1)):
        got = simhashed(spark, rows, radius=radius, blocks=blocks).collect()
        marks = {r._id: r.mark for r in got}
        for r in got:
            near = sum(apart(r.mark, m) <= radius for d, m in marks.items() if d != r._id)
            assert r.n_near == (near if r._id % 2 == 0 else None)
        assert radius == 0 or sum(r.n_near or 0 for r in got) > 100


def test_simhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(9_000))  # more terms than vote at once
    rows = [(5, "Same text"), (5, "Same text"), (5, "another"), (None, "no id"), (None, None), (3, ""), (2, " \t "), (1, "é😀x"), (0, long), (-1, None)]
    got = simhashed(spark, [(*r, "x", "y", 1) for r in rows]).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert [r[0] for r in order[:3]] == [5, 5, 5]
    marks = {}
    for r in got:
        marks.setdefault(r._id, []).append(r.mark)
    for doc, text in rows:
        assert plain_fingerprint(text or "") in marks[doc]
    # The text behind each, where ids tell the order: 5 .. 3, 2, 1, 0, -1, null.
    follows = {r._id: r.next_mark for r in got}
    texts = {r[0]: r[1] for r in rows}
    for a, b in ((3, 2), (2, 1), (1, 0), (0, -1)):
        assert follows[a] == plain_fingerprint(texts[b] or "")
    assert follows[-1] in marks[None]
    chars = Counter(len(t or "") for _, t in rows)
    assert Counter(r.n_chars for r in got) == chars
    one = next(r for r in got if r._id == 1)
    assert one.edited_sha256 == hashlib.sha256(("é😀" + long[:1]).encode()).hexdigest()
    same = [r for r in got if r._id == 5]
    assert len({r.mark for r in same}) == 2
    assert simhashed(spark, []).count() == 0
    alone = simhashed(spark, [(2, "just this text", None, None, None)]).collect()
    assert len(alone) == 1 and alone[0].mark == alone[0].next_mark and alone[0].n_near == 0
    assert alone[0].edited_sha256 == hashlib.sha256(b"just this text"[:7] + b"just th").hexdigest()
    with pytest.raises(ValueError):
        simhash.tables(4, 4)


def test_equal_texts_have_equal_fingerprints_in_any_batch():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    whole = simhash.fingerprints(pa.array(texts))
    single = np.concatenate([simhash.fingerprints(pa.array([t])) for t in texts])
    assert (whole == single).all()
    sliced = simhash.fingerprints(pa.array(["x y", *texts]).slice(1))
    assert (whole == sliced).all()


# Whitening ------------------------------------------------------------------------------------


def test_eigenpairs_against_numpy():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 64):
        for kind in range(5):
            x = rng.normal(size=(n + 3, n))
            a = [x.T @ x, x[:2].T @ x[:2], np.diag(rng.integers(0, 3, n).astype(float)), np.zeros((n, n)), x.T @ x * 1e-200][kind]
            if kind == 0 and n > 4:
                a[:, 1], a[1] = 0, 0  # an off-diagonal zero
            k = min(32, n)
            values, axes = eigen.leading(a, k)
            scale = max(np.abs(a).max(), 1e-300)
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * n * scale
            assert np.abs(a @ axes - axes * values).max() < 1e-13 * n * scale
            assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def plain_whitening(x, n_components):
    """Rows, deviations, absolute whitened values and shares of the variance, by numpy's own solver."""
    mean = x.mean(axis=0, dtype=np.longdouble).astype(float)
    z = x - mean
    values, axes = np.linalg.eigh(z.T @ z / len(x))
    values, axes = values[::-1][:n_components], axes[:, ::-1][:, :n_components]
    sums = [int(s) for s in x.astype(np.int64).sum(axis=0)]
    deviation = [sum((len(x) * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return deviation, np.abs(z @ axes / np.sqrt(values)), values / (z * z).mean(axis=0).sum()


def test_whitening_query(spark):
    table = common.read(spark, SF_DIR, "embeddings").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in table], np.float64)) + 1_000_000
    deviation, whitened, explained = plain_whitening(x, 32)
    rows = catalog.op12_whitening(spark, SF_DIR).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in rows] == [(t.vec_id, c) for t in table for c in range(1, 33)]
    assert [r.deviation for r in rows[::32]] == deviation and {r.n for r in rows} == {len(table)}
    got = np.array([r.whitened for r in rows]).reshape(-1, 32)
    assert np.abs(np.abs(got) - whitened).max() < 1e-7
    assert np.abs(np.array([r.explained for r in rows[:32]]) / explained - 1).max() < 1e-10
    error = np.abs(np.cov(got.T, bias=True) - np.eye(32)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9 and error < 1e-9


def vectors(spark, rows):
    schema = "vec_id long, embedding array<double>, n int, _vector string, component string"
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    good += [(3, good[3][1]), (None, [0.5, -0.25, 1.0]), (70, [0.25, 2.0]), (71, [])]
    bad = [(80, None), (81, [1.0, NAN, 0.0]), (82, [1.0, None, 0.0]), (83, [INF, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    x = np.array([list(map(lambda v: math.floor(64 * v) + 1_000_000, [*e, 0, 0, 0][:3])) for _, e in good], float)
    deviation, whitened, explained = plain_whitening(x, 3)
    assert len(got) == 3 * len(good) and {r.component for r in got} == {1, 2, 3}
    want = sorted((d, *np.round(w, 6)) for d, w in zip(deviation, whitened))
    by_row = [sorted(got[i : i + 3], key=lambda r: r.component) for i in range(0, len(got), 3)]
    assert np.allclose(sorted((r[0].deviation, *(round(abs(c.whitened), 6) for c in r)) for r in by_row), want, atol=1e-5)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, bad)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0  # no variance
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert len(flat) == 5 and {r.component for r in flat} == {1} and flat[0].identity_error < 1e-12
    huge = whitening.whiten(vectors(spark, [(i, [1e300 * (-1) ** i, 1.0, float(i)]) for i in range(6)])).collect()
    assert huge and all(r.deviation <= (1 << 63) - 1 and math.isfinite(r.whitened) for r in huge)


# Centroid clustering --------------------------------------------------------------------------


def plain_clusters(rows, clusters=8, rounds=10):
    """``id, cluster, distance`` by full scans, and the final centroids."""
    x = [[math.floor(1024 * v) for v in e] for _, e in rows]
    keys = [hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest() for i, _ in rows]
    means = [list(x[i]) for i in sorted(range(len(x)), key=lambda i: (keys[i], x[i]))[:clusters]]
    a = np.array(x, np.int64)

    def nearest():
        scan = np.stack([((a - np.array(m)) ** 2).sum(axis=1) for m in means], axis=1)
        return scan.argmin(axis=1), scan.min(axis=1)

    for _ in range(rounds):
        cluster, _ = nearest()
        for j in range(len(means)):
            own = a[cluster == j]
            if len(own):
                means[j] = [int(s) // len(own) for s in own.sum(axis=0)]
    cluster, distance = nearest()
    return [(i, int(c), int(d)) for (i, _), c, d in zip(rows, cluster, distance)], means


def plain_rows(rows, **options):
    found, means = plain_clusters(rows, **options)
    own = Counter()
    for _, c, d in found:
        own[c] += d
    marks = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return Counter((i, c, d, own[c], sum(own.values()), marks[c]) for i, c, d in found)


def test_clusters_of_real_groups(spark):
    """Overlapping groups of vectors: bounds skip vectors, fall by less than the drift, and change no result."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] * rng.uniform(0.3, 1) + 0.3 * rng.normal(size=64)).tolist()) for i in range(3000)]
    trace = []
    got = centroids.cluster(vectors(spark, rows).repartition(5), trace=trace)
    assert Counter(map(tuple, got.collect())) == plain_rows(rows)
    assert all(t["vectors"] == 3000 for t in trace) and trace[0]["ambiguous"] == 3000
    assert min(t["ambiguous"] for t in trace[1:]) < 1500
    assert all((t["loosen"] <= t["drift"].max() * (1 + 1e-6)).all() for t in trace)
    assert any((t["loosen"][np.arange(8)] < 0.9 * t["drift"].max()).any() for t in trace)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("blocks_", "clusters_"))]


def test_the_planar_bound_holds():
    """No point of a sphere gains more than the bound when another centroid moves; the bound is below the full drift."""
    rng = np.random.default_rng(9)
    below = 0
    for _ in range(300):
        d = int(rng.integers(1, 5))
        old, new = rng.normal(size=(3, d)) * 5, rng.normal(size=(3, d)) * 5
        radius = np.abs(rng.normal(size=3)) * 3
        bound = centroids.loosened(old, new, radius)
        for c in range(3):
            way = rng.normal(size=(400, d))
            points = old[c] + radius[c] * rng.uniform(0, 1, (400, 1)) ** 0.3 * way / np.linalg.norm(way, axis=1)[:, None]
            for j in {0, 1, 2} - {c}:
                gain = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert gain.max() <= bound[c] + 1e-9
            below += bound[c] < max(np.linalg.norm(new[j] - old[j]) for j in {0, 1, 2} - {c}) * 0.9
    assert below > 100


def test_clusters_edges(spark):
    rng = np.random.default_rng(6)
    good = [(i, np.round(rng.normal(size=64), 1).tolist()) for i in range(30)]
    good += [(4, good[4][1]), (4, good[5][1]), (None, good[6][1]), (50, [0.0] * 64), (51, [0.0] * 64)]
    bad = [(60, None), (61, [0.0] * 63), (62, [0.0] * 65), (63, [NAN] * 64), (64, [None] + [0.0] * 63), (65, [INF] * 64), (66, [])]
    got = centroids.cluster(vectors(spark, good + bad))
    assert Counter(map(tuple, got.collect())) == plain_rows(good)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert Counter(map(tuple, centroids.cluster(vectors(spark, few)).collect())) == plain_rows(few)
    ties = [(i, [float(i % 2)] * 64) for i in range(40)]  # equal vectors: equal centroids, the smaller number wins
    assert Counter(map(tuple, centroids.cluster(vectors(spark, ties)).collect())) == plain_rows(ties)
    once = centroids.cluster(vectors(spark, good), rounds=0)
    assert Counter(map(tuple, once.collect())) == plain_rows(good, rounds=0)
    assert centroids.cluster(vectors(spark, [])).count() == 0 and centroids.cluster(vectors(spark, bad)).count() == 0
    large = [(i, [3e38 * (-1) ** i] + [float(i)] * 63) for i in range(12)]
    assert centroids.cluster(vectors(spark, large)).count() == 12  # cut to 2^27
