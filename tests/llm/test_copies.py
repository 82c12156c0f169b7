"""Exact, SimHash and embedding duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quernstone.llm import exact_dedup, simhash, vectors
from quernstone.llm.common import components


def groups(n, linked):
    root = [*range(n)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("hot", [{}, {"hot_share": 1000, "hot_least": 2}])
@pytest.mark.parametrize("largest", [True, False])
def test_exact(docs, hot, largest):
    found = exact_dedup.content_sort(docs, "doc_id", "text", keep_largest=largest, **hot).select("doc.*", *[F.col(c).alias(f"__{c}") for c in ("keep_id", "group_size", "kept", "text_sha256")]).collect()
    own = defaultdict(list)
    for r in found:
        own[r.text or ""].append(r)
    assert Counter(tuple(r)[:5] for r in found) == Counter(map(tuple, docs.collect()))
    for text, rows in own.items():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        keep = (max if largest else min)(ids, default=None)
        assert {(r["__keep_id"], r["__group_size"], r["__text_sha256"]) for r in rows} == {(keep, len(rows), hashlib.sha256(text.encode()).hexdigest())}
        assert [r.doc_id for r in rows if r["__kept"]] == [keep]


@pytest.mark.parametrize("largest", [True, False])
def test_exact_after_a_shuffle(spark, largest):
    """Rows come in another order each time they are read; of every frequent text exactly one row stays."""
    docs = spark.range(40000).select((F.col("id") % 20000).alias("doc_id"), F.when(F.col("id") % 6 < 5, F.concat(F.lit("t"), (F.col("id") % 6).cast("string"))).alias("text")).repartition(7)
    found = exact_dedup.content_sort(docs, "doc_id", "text", keep_largest=largest).select("doc.text", "doc.doc_id", "keep_id", "group_size", "kept").toPandas()
    assert len(found) == 40000
    for text, own in found.groupby(found.text.fillna("")):
        assert own.group_size.tolist() == [len(own)] * len(own) and own.keep_id.nunique() == 1
        assert own.keep_id.iloc[0] == (own.doc_id.max() if largest else own.doc_id.min())
        assert own[own.kept].doc_id.tolist() == [own.keep_id.iloc[0]], text
    assert exact_dedup.exact_dedup(docs, "doc_id", "text", keep_largest=largest).count() == 6


def test_exact_of_long_texts(spark):
    long = "x" * 3_000_000
    docs = spark.createDataFrame([(1, long), (2, long + "y"), (3, long), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.content_sort(docs, "doc_id", "text", keep_largest=True).select("doc.doc_id", "keep_id", "group_size").collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_of_other_types(spark):
    docs = spark.createDataFrame([(1, 5, "x"), (2, 5, None), (3, None, "y"), (4, None, "z")], "doc_id long, text int, body string")
    assert sorted(exact_dedup.exact_dedup(docs, "doc_id", "text").collect()) == [(1, 5, "x"), (3, None, "y")]


def test_exact_keeps_columns(docs, empty):
    assert exact_dedup.exact_dedup(docs, "doc_id", "text").columns == docs.columns
    assert exact_dedup.exact_dedup(empty, "doc_id", "text").count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    got = simhash.near_dedup(docs, "doc_id", "text").collect()
    assert Counter((r.id, r.fp & (1 << 64) - 1) for r in got) == Counter((r.doc_id, brute_fingerprint(r.text or "")) for r in docs.collect())


@pytest.mark.parametrize("block_rows", [512, 8])
def test_near_components(spark, block_rows):
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for seed in [*fps][:12]:
        for _ in range(25):
            bits = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            fps.add(seed ^ sum(1 << int(b) for b in bits))
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 4]
    want = groups(len(fps), linked)
    found = simhash.near_components(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, block_rows)
    root = {r.node: r.root for r in found.collect()}
    got = [root.get(x, x) for x in fps]
    assert len(root) == len({x for p in linked for x in p})
    assert len({*zip(got, want, strict=True)}) == len({*got}) == len({*want})


def test_near_dedup(docs, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in docs.collect()]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4]
    root = groups(len(rows), linked)
    least = {g: min((rows[k][0] for k in range(len(rows)) if root[k] == g and rows[k][0] is not None), default=None) for g in root}
    got = simhash.near_dedup(docs, "doc_id", "text").collect()
    assert Counter((r.id, r.component_id) for r in got) == Counter((d, least[g]) for (d, _), g in zip(rows, root, strict=True))
    assert simhash.near_dedup(empty, "doc_id", "text").count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 600)] + [(7, 7)]
    root = groups(700, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root[k] for k in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32))
    for k in range(0, 300, 2):
        x[k + 1] = x[k] + rng.standard_normal(32) * 0.02
    x[300:420] = x[300] + rng.standard_normal((120, 32)) * 0.02
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    rows += [(1500 + k, rows[299][1], 0) for k in range(40)] + [(1600, None, 0), (1601, [], 0), (1602, [0.0] * 32, 0), (1603, [float("nan")] * 32, 0), (1604, [None] + [1.0] * 31, 0), (1605, [1.0], 0), (1606, [2.0], 0), (None, rows[0][1], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int"), "vec_id", "embedding", how=vectors.Descent(longest=16)).collect()
    good = [k for k, r in enumerate(rows) if r[1] and len(r[1]) == 32 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    m = np.array([rows[k][1] for k in good], dtype=np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    want = {rows[k][0]: int(n) - 1 for k, n in zip(good, near.sum(axis=1), strict=True)}
    found = {r.id: r for r in got}
    assert len(got) == len(rows) and all(found[k].n_links == 0 and found[k].component_id == k for k in (1600, 1601, 1602, 1603, 1604))
    assert found[1605].n_links == found[1606].n_links == 1 and found[1606].component_id == 1605
    assert all(found[k].n_links <= n for k, n in want.items())
    assert sum(found[k].n_links for k in want) >= 0.97 * sum(want.values()) and all(r.recall >= 0.97 for r in got)
    root = groups(len(good), [(a, b) for a, b in np.argwhere(near).tolist() if b < a])
    least = {g: min(rows[k][0] for k, h in zip(good, root, strict=True) if g == h and rows[k][0] is not None) for g in root}
    held = [found[rows[k][0]].component_id == least[g] for k, g in zip(good, root, strict=True)]
    assert np.mean(held) >= 0.97 and all(found[rows[k][0]].component_id >= least[g] for k, g in zip(good, root, strict=True))
    assert all(r.kept == (r.id == r.component_id) for r in got if r.id is not None)


@pytest.mark.parametrize("spread", [0.002, 0.03, 0.3])
def test_links_of_blocks(spark, spread):
    """Tight, middling and loose components in small blocks: counts by angles and by comparison agree with all pairs."""
    rng = np.random.default_rng(12)
    x = (np.eye(16)[0] + rng.standard_normal((90, 16)) * spread).astype(np.float32)
    m = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near, copies = m @ m.T >= 0.95, 1 + np.arange(90) % 3
    points = spark.createDataFrame([(k, v.tolist(), int(c), k) for k, (v, c) in enumerate(zip(x, copies, strict=True))], "v long, x array<float>, copies long, first long")
    named = spark.createDataFrame([(k, k // 60) for k in range(90)], "v long, root long")
    got = {r.v: r.n for r in vectors._within(points, named, 0.95, vectors.Descent(rows=16)).collect()}
    np.fill_diagonal(near, False)
    same = np.arange(90)[:, None] // 60 == np.arange(90) // 60
    assert [got.get(k, 0) for k in range(90)] == ((near & same) @ copies).tolist()
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_vectors_of_many_lengths(spark):
    """However many lengths there are, each one's vectors meet; a vector alone in its length stays alone."""
    rows = [(n, [1.0 + n + k for k in range(n)]) for n in range(1, 80)]
    rows += [(100 + k, [float(k % 2 + 10 * i) for i in range(90)]) for k in range(4)]
    got = {r.id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    assert all(got[n].n_links == 0 and got[n].component_id == n and got[n].kept for n in range(1, 80))
    assert all(got[k].n_links == 3 and got[k].component_id == 100 and got[k].kept == (k == 100) for k in range(100, 104))


def families(rng, axes, size, dims=32):
    """Tight families around unit vectors, as rows of float32."""
    x = [a / np.linalg.norm(a) + rng.standard_normal((size, dims)) * 0.012 for a in axes]
    return np.concatenate(x).astype(np.float32)


def test_links_between_families(spark):
    """Two families whose members fill each other's lists, yet are linked across, are one component."""
    rng = np.random.default_rng(6)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    x = families(rng, [a, 0.97 * a + (1 - 0.97**2) ** 0.5 * b], 60)
    m = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = m @ m.T >= 0.95
    own = np.sort(m @ m.T, axis=1)[:, ::-1]
    assert near[:60, 60:].any() and (own[:, 33] > (m @ m.T)[:60, 60:].max()).all()
    got = vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == {k: (int(near[k].sum()) - 1, 0) for k in range(120)}


def test_audit_counts_vectors_not_links(spark):
    """One large group that is whole cannot hide pairs that are missing."""
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((32, 32)))[0][:13]
    x = np.concatenate([families(rng, axes[:1], 48), families(rng, axes[1:], 2)])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "v long, x array<float>")
    named = spark.createDataFrame([(k, 0 if k < 48 else k) for k in range(len(x))], "v long, root long")
    assert vectors._audit(points, named, 0.95, vectors.Descent(), len(x)) == pytest.approx(48 / 72)


def test_missed_recall_is_not_returned(spark, monkeypatch):
    x = families(np.random.default_rng(9), np.eye(32)[:4], 5)
    monkeypatch.setattr(vectors, "_audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="0.500"):
        vectors.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding", how=vectors.Descent(rounds=1)).collect()
