"""The registered queries themselves, column by column, against plain Python at the smallest scale."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from test_copies import brute_fingerprint, groups
from test_scans import base_licenses, base_secrets, entropy_spans, listed
from test_tokens import BYTE, PIECE, WORD
from tokenizers import Tokenizer

from quernstone.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def got(spark, name, columns):
    found = queries.QUERIES[name](spark, DATA)
    assert set(columns) <= {*found.columns}
    return Counter(tuple(r) for r in found.select(*columns).collect())


def test_op1(spark, rows):
    t, want = Tokenizer.from_file(BYTE), Counter()
    for d, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [(0, head)] * bool(head) + [(a, a + 1024) for a in range(head, len(ids), 1024)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(cuts))
    assert got(spark, "op1_best_fit_packing", ["doc_id", "piece", "start", "length", "ids_crc32"]) == want


def test_op2(spark, rows):
    sp = SentencePieceProcessor(model_file=PIECE)
    n = {d: len(sp.encode(t)) for d, t in rows}
    assert got(spark, "op2_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == Counter((d, len(t.encode()), n[d], n[d] > 4096) for d, t in rows)


def test_op3(spark, rows):
    assert got(spark, "op3_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == Counter((d, *base_licenses(t)) for d, t in rows)


def test_op4(spark, rows):
    found = queries.op4_toxicity(spark, DATA).collect()
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((d, zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_op5(spark, rows):
    t, want = Tokenizer.from_file(WORD), Counter()
    for d, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got(spark, "op5_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_op6(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    m = np.array([r.embedding for r in rows], dtype=np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    root = groups(len(rows), np.argwhere(near & np.tri(len(rows), k=-1, dtype=bool)).tolist())
    least = defaultdict(lambda: 1 << 60)
    for r, g in zip(rows, root, strict=True):
        least[g] = min(least[g], r.vec_id)
    want = Counter((r.vec_id, int(n) - 1, least[g], r.vec_id == least[g]) for r, n, g in zip(rows, near.sum(axis=1), root, strict=True))
    assert got(spark, "op6_embedding_near_dedup", ["vec_id", "n_links", "component_id", "kept"]) == want


def test_op7(spark, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {g: min(d for (d, _), h in zip(rows, root, strict=True) if g == h) for g in root}
    assert got(spark, "op7_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]) == Counter((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, root, strict=True))


def test_op10(spark, rows):
    want = Counter()
    for d, t in rows:
        base = base_secrets(t)
        n = Counter(k for _, k, _ in base)
        want[d, n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + entropy_spans(t))] += 1
    assert got(spark, "op10_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]) == want
