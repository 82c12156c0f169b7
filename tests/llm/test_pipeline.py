"""The pipeline against plain Python versions of all its stages, and its stages on awkward rows."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_classifiers import brute_language, fold
from test_copies import brute_fingerprint, groups
from test_scans import base_secrets, entropy_spans
from test_tokens import BYTE
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"


def brute_stages(rows):
    """Rows (doc_id, text, lang) left after each of the first four stages."""
    predict = brute_language([(t, x) for d, t, x in rows if d is not None and not fold(d, 4, 2)])
    judged = [(r, predict(r[1] or "")) for r in rows]
    rows = [r for r, (lang, _, ambiguous) in judged if lang != "und" and not ambiguous]
    yield "language_id", rows
    best = {}
    for r in rows:
        if r[1] not in best or (best[r[1]][0] or -1) < (r[0] or -1):
            best[r[1]] = r
    rows = [*best.values()]
    yield "exact_dedup", rows
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    first = {}
    for r, g in zip(rows, root, strict=True):
        if g not in first or (r[0] is None, r[0]) < (first[g][0] is None, first[g][0]):
            first[g] = r
    rows = [*first.values()]
    yield "simhash_near_dedup", rows
    yield "secret_scan", [r for r in rows if not base_secrets(r[1]) and not entropy_spans(r[1])]


def test_run_like_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    stages, now = dict(corpus_pipeline.STAGES), docs
    for name, want in brute_stages(rows):
        now = stages[name](spark, now, DATA).cache()
        assert now.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter((d, t) for d, t, _ in want), name
    assert len(want) < len(rows)
    tokenizer, sizes = Tokenizer.from_file(BYTE), Counter()
    out = corpus_pipeline.run(spark, DATA).collect()
    for d, t, _ in want:
        sizes[d] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got, sequences = Counter(), {}
    for r in out:
        got[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == sizes
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.fixture(scope="module")
def awkward(spark, docs):
    """Names that stages might use themselves, nulls in all columns, repeated rows."""
    extra = ["found", "gone_id", "gone_hash", "gone", "doc", "own_id", "row_", "hash", "__found", "__gone_id"]
    made = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "fr").otherwise(F.col("lang")).alias("lang"), *[F.lit(k).alias(n) for k, n in enumerate(extra)])
    return made.union(made.where("doc_id = 36")).union(made.where("doc_id is null")).cache()


def test_stages_on_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text or "", r.lang) for r in awkward.collect()]
    stages = dict(corpus_pipeline.STAGES)
    now = awkward
    for name, want in brute_stages(rows):
        now = stages[name](spark, now, DATA).cache()
        assert now.columns == awkward.columns
        assert Counter((r.doc_id, r.text or "") for r in now.collect()) == Counter((d, t) for d, t, _ in want), name
    assert stages["best_fit_packing"](spark, now, DATA).count() >= len(want)


def test_near_copies_of_repeated_rows(spark, awkward):
    """The third stage on rows that repeat: one row of each group stays."""
    rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in awkward.collect()]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4])
    kept = corpus_pipeline.distinct_fingerprints(spark, awkward.repartition(5), DATA)
    assert kept.count() == len({*root}) and kept.columns == awkward.columns


def test_empty_table(spark, awkward):
    now = awkward.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert now.count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
