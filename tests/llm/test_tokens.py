"""Packing, token counts and BPE against the libraries themselves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quernstone.llm import bpe, packing, token_counts

BYTE, RANKS, WORD, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.text(st.characters(blacklist_categories=["Cs"]), max_size=60) | st.text("ab '\n\t▁<|>éΣİ́\x1c0", max_size=40)


def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_of_divided_texts(text):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_ids_of_divided_texts, "t") else test_ids_of_divided_texts.t
    test_ids_of_divided_texts.t = t
    raw = packing._ids(BYTE, RANKS)([text])[0]
    assert np.frombuffer(raw, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(docs):
    t, want = Tokenizer.from_file(BYTE), Counter()
    for d, text in rows(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [(0, head)] * bool(head) + [(a, a + 1024) for a in range(head, len(ids), 1024)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(cuts))
    got = packing.pack_documents(docs, "doc_id", "text", BYTE, ranks_path=RANKS, cell_items=16).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 1024, 1500))[::-1].astype(np.int32)
    packer = packing.Packer(lengths, 1024, 3)
    first = [*packer.population(3, 0.05), packer.tight()]
    best = packer.evolve(first, 30)
    assert packer.cost(best[0]) <= min(map(packer.cost, first))
    assert packer.fill(best[0]).max() <= 1024 and packer.cost(best[0])[0] <= 1.01 * packer.bound


def test_bound_of_small_packings():
    """Against all packings of a few items."""

    def fewest(items, bins=()):
        if not items:
            return len(bins)
        head, *rest = items
        with_old = [fewest(rest, (*bins[:k], b + head, *bins[k + 1 :])) for k, b in enumerate(bins) if b + head <= 10]
        return min([*with_old, fewest(rest, (*bins, head))])

    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 10, 6))[::-1].astype(np.int32)
        packer, best = packing.Packer(lengths, 10, 1), fewest(lengths.tolist())
        assert packer.bound <= best
        found = packer.evolve([packer.fresh(0.0), packer.tight(), packer.fresh(0.2)], 40)[0]
        assert packer.fill(found).max() <= 10 and packer.cost(found)[0] >= best


def test_crossover_brings_whole_bins():
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(1, 1024, 800))[::-1].astype(np.int32)
    packer = packing.Packer(lengths, 1024, 2)
    a, b = packer.fresh(0.3), packer.tight()
    for _ in range(10):
        child = packer.cross(a, b)
        assert packer.fill(child).max() <= 1024 and packer.fill(child).sum() == lengths.sum() and (packer.fill(child) > 0).all()


def test_empty_tables(empty):
    assert packing.pack_documents(empty, "doc_id", "text", BYTE, ranks_path=RANKS).count() == 0
    assert token_counts.token_counts(empty, "doc_id", "text", PIECE).count() == 0
    assert bpe.encode(empty, "doc_id", "text", WORD, digests=True).count() == 0


@pytest.mark.parametrize("common", [0, 20])
def test_token_counts(docs, common):
    sp = SentencePieceProcessor(model_file=PIECE)
    got = token_counts.token_counts(docs, "doc_id", "text", PIECE, common=common).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((d, len(t.encode()), len(sp.encode(t))) for d, t in rows(docs))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_piece_counts_of_pretokens(text):
    p = token_counts._processor(PIECE)
    assert sum(token_counts.piece_counts(p, token_counts.pretokens(text))) == len(p.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_rank_arrays(text):
    vocab = bpe.rank_arrays(WORD)
    found = vocab.encode_chunks(bpe.divide(text))
    ids = np.frombuffer(b"".join(raw for raw, _ in found), dtype="<u4").tolist()
    assert " ".join(t for _, t in found if t) == vocab.decode(ids)
    assert ids == vocab.tokenizer.encode(text, add_special_tokens=False).ids
    assert vocab.decode(ids) == vocab.tokenizer.decode(ids, skip_special_tokens=False)


def test_merges_make_only_later_pairs():
    vocab = bpe.rank_arrays(WORD)
    made = {int(x): k for k, x in reversed([*enumerate(vocab.made)])}
    for key, rank in zip(vocab.keys.tolist(), vocab.ranks.tolist(), strict=True):
        assert all(made.get(x, -1) < rank for x in divmod(key, vocab.base))


def test_bpe(docs):
    t = Tokenizer.from_file(WORD)
    want, plain = Counter(), Counter()
    for d, text in rows(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        plain[d, tuple(ids), back] += 1
    got = bpe.encode(docs, "doc_id", "text", WORD, digests=True)
    assert Counter(map(tuple, got.collect())) == want
    whole = bpe.encode(docs, "doc_id", "text", WORD).select("doc_id", "ids", "decoded")
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in whole.collect()) == plain
    assert got.where(F.col("ids_sha256").isNull()).count() == 0
