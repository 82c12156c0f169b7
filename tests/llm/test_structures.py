"""Merkle manifest, prefix trie and language model against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import TEXTS
from pyspark.sql import functions as F

from quernstone.llm import language_model, merkle, prefix_trie, queries
from quernstone.llm.common import in_fold

DATA = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees, found = defaultdict(list), Counter()
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        other = plain_leaf((*r[:4], None if r[4] is None else r[4].translate(LOWER))) if changed else None
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), other, r[0]))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: plain_tree([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in order}
    above = plain_tree([levels[g][-1][0] for g in order])
    for at, g in enumerate(order):
        for k, (_, _, leaf, other, doc) in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            siblings, node = [], other or leaf
            for way, j in ((levels[g], k), (above, at)):
                for nodes in way[:-1]:
                    run = nodes[j - j % 8 : j - j % 8 + 8]
                    siblings += run[: j % 8] + run[j % 8 + 1 :]
                    run[j % 8] = node
                    node, j = sha(*run), j // 8
            found[doc, leaf, levels[g][-1][0], above[-1][0], sha(*siblings), node, node == above[-1][0]] += 1
    return found


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs, **more):
    return merkle.manifest(docs, "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", in_fold("doc_id", 3, 0), {"text": merkle.ascii_lower(F.col("text"))}, **more)


def test_manifest_query(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_merkle_manifest(spark, DATA).select(*COLUMNS).collect()) == plain_manifest(rows)


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_awkward(spark, depth):
    """Several tiers through small blocks, many groups, nulls anywhere, repeated rows, one-leaf groups, clashing names."""
    rows = [(k, None if k % 7 == 0 else "s", [None, "en", "é", "~", "", "z"][k % 6] if k < 300 else f"g{k % 90}" if k < 400 else "en", None if k % 5 == 0 else k, TEXTS[k % len(TEXTS)], "x", 1) for k in range(1500)]
    rows += [rows[3], (None, None, None, None, None, None, None), (None, "s", "en", 1, "Abc", "x", 2), (-4, "s", "only", 1, "Abc" * 100_000, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, pos string, n long").repartition(5)
    found = manifest(docs, depth=depth)
    assert Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == plain_manifest([r[:5] for r in rows])
    for r in found.select("leaf", "copied", "root", "verified").collect():
        assert r.verified == (r.copied[0] == r.leaf) == (r.copied[-1] == r.root)


def test_manifest_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(docs).collect() == []


def plain_trie(rows):
    """rows: (conv_id, turn, role, text), ties by the digest of role and text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    found = Counter()
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (saved + sum(sums[q][0] for q in children[p]), sum(sums[q][1] for q in children[p]) or 1)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(seqs[c]) == len(p)))
        found[min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sums[p][1], sums[p][0], sha(ends)] += 1
    return found


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_prefix_trie(spark, DATA).select(*NODES).collect()) == plain_trie(rows)


@pytest.mark.parametrize("cells", [1, 60, 1 << 20])
def test_trie_awkward(spark, monkeypatch, cells):
    """Shards and chunks of few rows, many equal conversations, one long one, prefixes of others, ties, nulls, no base."""
    monkeypatch.setattr(prefix_trie, "_CELLS", cells)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(400):
        if c % 5 == 0 and c % 3 == 0:
            continue
        if c % 4 == 0:
            rows += [(c, t, "user", f"same {t}") for t in range(4)]
        else:
            rows += [(c, t, ["user", "é", None][int(rng.integers(3))], [None, "a", "ü", "a b"][int(rng.integers(4))]) for t in range(int(rng.integers(1, 7)))]
    rows += [(1001, t, "user", f"t{t % 3}") for t in range(300)] + [(1002, t, "user", f"t{t % 3}") for t in range(250)]
    rows += [(2, None, "user", "first"), (2, 1, "user", "twice"), (2, 1, "user", "twice"), (None, 1, "user", "nobody"), (-3, 0, "u", "x"), (-5, 0, "u", "y"), (7, 1, "a", "tie"), (7, 1, "b", "tie")]
    conv = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, size string").repartition(7)
    got = prefix_trie.trie(prefix_trie.regrown(prefix_trie.turns(conv), 5, 9))
    assert Counter(tuple(r) for r in got.select(*NODES).collect()) == plain_trie(rows)


def test_trie_turnless_and_empty(spark):
    """A base of one turn leaves its short family without turns; no conversation gives no node."""
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:30]
    rows = [(c, 0, "u", "x") for c in ids]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(prefix_trie.regrown(prefix_trie.turns(conv), 5, 9)).select(*NODES).collect()
    assert Counter(tuple(r) for r in got) == plain_trie(rows) and len(got) == 1
    assert prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns(conv.limit(0)))).collect() == []


def plain_words(text):
    out, word = [], ""
    for ch in (text or "").translate(LOWER) + " ":
        if ch == " " or "\t" <= ch <= "\r":
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return [*out, "\n"]


class PlainModel:
    """Modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.raw = order, Counter(w for t in texts for w in plain_words(t))
        self.levels = {order: Counter()}
        for t in texts:
            ws = ["\r"] * (order - 1) + plain_words(t)
            self.levels[order].update(tuple(ws[k : k + order]) for k in range(len(ws) - order + 1))
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter()
            for g, n in self.levels[k + 1].items():
                self.levels[k][g[1:]] += n if k > 1 and g[1] == "\r" else 1
        self.d, self.ctx = {}, defaultdict(lambda: [0, 0, 0, 0])
        for k, c in self.levels.items():
            n = Counter(c.values())
            self.d[k] = (0.5, 1.0, 1.5)
            if all(n[j] for j in (1, 2, 3, 4)):
                y = n[1] / (n[1] + 2 * n[2])
                d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
                if all(0 <= x <= j for j, x in enumerate(d, 1)):
                    self.d[k] = d
            for g, a in c.items():
                x = self.ctx[k, g[:-1]]
                x[0] += a
                x[min(a, 3)] += 1

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        total, *n = self.ctx.get((k, gram[:-1]), (0, 0, 0, 0))
        if not total:
            return lower
        a = self.levels[k][gram]
        return max(a - self.d[k][min(a, 3) - 1], 0) / total * (a > 0) + sum(x * y for x, y in zip(self.d[k], n, strict=True)) / total * lower

    def score(self, text):
        ws = ["\r"] * (self.order - 1) + plain_words(text)
        return sum(math.log10(self.p(tuple(ws[k - self.order + 1 : k + 1]))) for k in range(self.order - 1, len(ws)))

    def base(self, text):
        return sum(math.log10((self.raw[w] + 1) / (self.raw.total() + len(self.raw) + 1)) for w in plain_words(text))


def check_scores(rows, model, texts):
    assert len(rows) == len(texts)
    for r in rows:
        ws = plain_words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(ws), sum(w in model.raw for w in ws))
        assert r.base_score == pytest.approx(model.base(texts[r.doc_id]), abs=1e-6) and r.score == pytest.approx(model.score(texts[r.doc_id]), abs=1e-6)


def test_lm_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    model = PlainModel([t for d, t in texts.items() if not held[d]], 2)
    rows = queries.op13_lm_scoring(spark, DATA).collect()
    check_scores(rows, model, texts)
    assert all(r.held_out == held[r.doc_id] and r.train_tokens == model.raw.total() for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_awkward(spark, monkeypatch, order):
    """Long words, contexts that are spread, repeats, empty texts, shards of few n-grams."""
    monkeypatch.setattr(language_model, "_GATHERED", 300)
    monkeypatch.setattr(language_model, "_FREQUENT", 5)
    rng = np.random.default_rng(1)
    texts = [*TEXTS, "w" * 300 + " " + "W" * 300 + " x" * 900, *(" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 60) % 50) for _ in range(60))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    learned = docs.where("doc_id % 3 > 0")
    model = PlainModel([t for k, t in enumerate(texts) if k % 3 > 0], order)
    fitted = language_model.train(learned.union(learned.where("doc_id < 0")), "text", order)
    assert (fitted.tokens, fitted.distinct) == (model.raw.total(), len(model.raw))
    check_scores(language_model.score(fitted, docs, "doc_id", "text").collect(), model, dict(enumerate(texts)))
    grams = [("\r",) * (order - 1), ("w1",) * (order - 1), ("nowhere",) * (order - 1)]
    for g in grams:
        assert sum(model.p((*g, w)) for w in model.raw) + model.p((*g, "unseen word")) == pytest.approx(1)


@pytest.mark.parametrize("piece", [1, 40, 500])
def test_streams_in_pieces(monkeypatch, piece):
    """The same n-grams whether a long text is divided or not."""
    raw = [(t or "").encode() for t in TEXTS]

    def grams():
        return Counter((int(text[k]), *hashes[k - 2 : k + 1].tolist()) for hashes, text, predicted in language_model.streams(raw, 3) for k in np.flatnonzero(predicted))

    whole = grams()
    monkeypatch.setattr(language_model, "_PIECE", piece)
    assert grams() == whole and whole.total() == sum(len(plain_words(t)) for t in TEXTS)


def test_lm_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    fitted = language_model.train(docs.limit(0), "text", 2)
    got = language_model.score(fitted, docs, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == [(0, 1, 0, 0.0, 0.0), (1, 3, 0, 0.0, 0.0), (1, 3, 0, 0.0, 0.0)]
    assert language_model.score(fitted, docs.limit(0), "doc_id", "text").collect() == []
