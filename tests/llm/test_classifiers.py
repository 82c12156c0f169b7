"""Language identification and toxicity by held-out accuracy and against plain Python."""

import math
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import language, queries, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op8_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark, docs, empty):
    model = language.train(docs.where("lang is not null"), "text", "lang")
    got = docs.select("text", language.identify(model, F.col("text")).alias("p")).collect()
    for r in got:
        assert (r.p.lang == language.UNDETERMINED) == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.p.score <= 1
    none = language.train(empty, "text", "lang")
    assert docs.select(language.identify(none, F.col("text")).alias("p")).where("p.lang <> 'und'").count() == 0
    assert empty.select(language.identify(model, F.col("text"))).count() == 0


@pytest.mark.parametrize("classes", [1, 2, 4, 7, 20])
def test_codewords_differ(classes):
    codes = language.codewords(classes)
    assert len({tuple(c) for c in codes}) == classes
    if classes > 7:
        assert min((codes[a] != codes[b]).sum() for a in range(classes) for b in range(a)) >= codes.shape[1] // 4


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    yes, n = got.toxic == 1, len(got)
    auc = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (n - yes.sum()))
    assert auc > 0.95 and got[~yes].predicted.mean() < 0.02 and got[yes].predicted.mean() > 0.6


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    for tagged in (labels, labels.where("false")):
        model = toxicity.train(docs, tagged, "doc_id", "text", "toxic")
        scores = [r[0] for r in docs.select(toxicity.toxicity(model, F.col("text"))).collect()]
        assert all(0 <= s <= 1 for s in scores)
    assert scores == [0.5] * len(scores)
    assert empty.select(toxicity.toxicity(model, F.col("text"))).count() == 0


def test_ftrl_learns_sparse_weights():
    rng = np.random.default_rng(0)
    model = toxicity.Ftrl(100, 1.0, 0.1, 2.0, 1.0)
    for _ in range(400):
        at = np.unique(np.append(rng.integers(1, 100, 5), 100))
        y = int(rng.random() < 0.3)
        model.learn(np.append(at, 0)[np.argsort(np.append(at, 0))] if y else at, y)
    w = model.weight(np.arange(101))
    assert w[0] > 1 and (w[1:100] == 0).mean() > 0.5


def brute_language(rows, bits=14, smoothing=0.5):
    """A predictor from (text, lang) rows by loops over single n-grams: text -> (lang, score, ambiguous)."""

    def grams(text):
        raw = text.lower().encode()
        raw = b" ".join(bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in raw).split())
        raw = b" " + raw + b" "
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            yield ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) * 0x27D4EB2F % 2**32) >> (32 - bits)

    counts = defaultdict(lambda: defaultdict(int))
    for text, lang in rows:
        if lang is not None:
            own = counts[lang]
            for g in grams(text or ""):
                own[g] += 1
    langs = sorted(x for x in counts if counts[x])
    share = {x: (lambda own, n: lambda g: (own.get(g, 0) + smoothing) / (n + smoothing * 2**bits))(counts[x], sum(counts[x].values())) for x in langs}
    sides = [set(c) for n in range(1, len(langs)) for c in combinations(range(1, len(langs)), n)]
    mean = lambda side, g: sum(share[langs[k]](g) for k in side) / len(side)
    weights, trust = [], []
    for yes in sides:
        no = {*range(len(langs))} - yes
        w, t = {}, 0.0
        for g in range(2**bits):
            p, q = mean(yes, g), mean(no, g)
            w[g] = math.log(p / q)
            t += (p - q) * w[g] / 2
        weights.append(w)
        trust.append(t)
    trust = [t / (sum(trust) / len(trust)) for t in trust]

    def predict(text):
        if not any(map(str.isalpha, text)):
            return "und", 0.0, True
        own = [*grams(text)]
        margins = [sum(w[g] for g in own) / len(own) ** 0.5 for w in weights]
        loss = [sum(t * np.logaddexp(0, -(1 if k in s else -1) * m) for s, m, t in zip(sides, margins, trust, strict=True)) for k in range(len(langs))]
        odds = [math.exp(-(x - min(loss))) / sum(math.exp(-(y - min(loss))) for y in loss) for x in loss]
        best, second = sorted(odds, reverse=True)[:2]
        return langs[odds.index(best)], best, best - second < 0.05

    return predict


def fold(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def test_language_like_plain_python(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    predict = brute_language([(r.text, r.lang) for r in rows if not fold(r.doc_id, 4, 2)])
    got = {r.doc_id: r for r in queries.op8_language_id(spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score, ambiguous = predict(r.text or "")
        g = got[r.doc_id]
        assert (g.lang_pred, g.ambiguous, g.held_out) == (lang, ambiguous, fold(r.doc_id, 4, 2)) and abs(g.score - score) < 1e-3


def test_too_many_languages(spark):
    df = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(9)], "text string, lang string")
    with pytest.raises(Exception, match="over 8"):
        language.train(df, "text", "lang", most_languages=8)


def brute_features(text, bits):
    words = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in text.lower().encode()).split()
    h = [zlib.crc32(w) for w in words]
    found = {x * 0x9E3779B1 % 2**32 >> (32 - bits) for x in h}
    for skip, odd in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (3, 0x27D4EB2F)):
        found |= {((a * odd % 2**32 ^ b) * 0x165667B1 + skip) % 2**32 >> (32 - bits) for a, b in zip(h, h[skip:], strict=False)}
    return sorted(found)


def brute_ftrl(rows, bits, epochs=3, alpha=1.0, beta=0.1, l1=5.0, l2=1.0):
    """Weights by bucket from (label, text) rows, one coordinate at a time; the intercept is at 2**bits."""
    z, n, top = defaultdict(float), defaultdict(float), 1 << bits

    def weight(i):
        least = 0.0 if i == top else l1
        return 0.0 if abs(z[i]) <= least else -(z[i] - math.copysign(least, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for label, text in rows:
            at = [*brute_features(text, bits), top]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: w for i in [*z] if (w := weight(i))}


def test_toxicity_like_plain_python(spark):
    """One shard, so the fit is one run of FTRL over the rows in the order of their hashes."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", bits=16)
    joined = docs.join(labels, "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("order")).orderBy("order").collect()
    want = brute_ftrl([(r.toxic, r.text) for r in joined], 16)
    assert set(model.buckets.tolist()) == set(want) - {1 << 16}
    assert np.allclose(model.weights, [want[i] for i in model.buckets.tolist()], rtol=1e-4) and abs(model.intercept - want.get(1 << 16, 0.0)) < 1e-6
    for r in joined[:40]:
        total = want.get(1 << 16, 0.0) + sum(want.get(i, 0.0) for i in brute_features(r.text, 16))
        assert abs(model.score(r.text) - 1 / (1 + math.exp(-total))) < 1e-4


def test_toxicity_does_not_depend_on_order(spark, docs):
    """Documents that share an identifier: one text is learnt from, whatever the order."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    more = docs.union(docs.select(F.lit(3).cast("long").alias("doc_id"), F.concat("text", F.lit(" again")), "lang", "row", "kept"))
    fits = [toxicity.train(d, labels, "doc_id", "text", "toxic", bits=14, l1=0.1) for d in (more, more.repartition(7), more.orderBy(F.desc("text")))]
    for f in fits[1:]:
        assert sorted(zip(f.buckets, f.weights, strict=True)) == sorted(zip(fits[0].buckets, fits[0].weights, strict=True)) and f.intercept == fits[0].intercept
