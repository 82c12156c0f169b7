"""BPE encoding and decoding of whole texts by contiguous rank arrays."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import body
from quernstone.llm.packing import slices

NO_RANK = np.int32(2**31 - 1)
#: Bytes of a word up to which words are merged together, one merge of each in a step.
_SHORT = 48
_KEPT_WORDS = 250_000
#: Longer words are forgotten after each run of texts, so the tables of words have a size bound.
_KEPT_CHARS = 256
#: These divide a text for str.split() though they are not white space in Unicode.
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")
_SPLIT_EXACTLY = re.compile("(?:[^\\s]|[\x1c-\x1f])+")
#: Characters that leave the range where Python and the library agree on letters, numbers, lower case and composition.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")


def _latin_words() -> re.Pattern:
    """The word pattern of the vocabulary (fixed value) with the letters and numbers below U+0250 spelt out.

    A line feed, which no run without white space holds, is found as the mark between two runs.
    """
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+|\\n")


_LATIN_WORDS = _latin_words()


class RankArrays:
    """A BPE vocabulary with word ends: merge ranks by pair of ids, for words given as rows of byte symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.token = {v: k for k, v in (self.vocab | self.special).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = 1 << 20
        keys = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        self.tokenizer = Tokenizer.from_file(path)
        self.symbols = _byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in self.symbols], dtype=np.int64)
        self.last = np.array([self.vocab.get(s + self.end, -1) for s in self.symbols], dtype=np.int64)
        if (self.inner < 0).any() or (self.last < 0).any():
            raise ValueError(f"{path}: not every byte has a symbol")
        #: Ids and decoded text of words met lately, and of special tokens.
        self.known: dict[bytes | int, tuple[bytes, str]] = {k: (array("I", [k]).tobytes(), t) for t, k in self.special.items()}
        self.divide = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def start(self, word: bytes) -> np.ndarray:
        parts = self.inner[np.frombuffer(word, dtype=np.uint8)]
        parts[-1] = self.last[word[-1]]
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """One word: scan for the least rank, merge each place that has it from the left, refresh the ranks beside them.

        A merge only makes symbols whose own pairs rank later, so all places of the least rank come before any of them.
        """
        parts = self.start(word)
        ranks = self.rank(parts[:-1], parts[1:])
        while len(ranks) and (least := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == least)
            runs = np.cumsum(np.diff(at, prepend=-2) > 1)
            nth = np.arange(len(at)) - np.searchsorted(runs, runs)
            at = at[nth % 2 == 0]
            parts[at] = self.made[least]
            left = np.ones(len(parts), dtype=bool)
            left[at + 1] = False
            parts = parts[left]
            new = at - np.arange(len(at))
            keep = np.append(ranks, NO_RANK)[left][: len(parts) - 1]
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(keep))]
            # the rank that stood at a merged place belonged to the deleted boundary
            keep[near] = self.rank(parts[near], parts[near + 1])
            ranks = keep
        return parts.tolist()

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Many words of at most _SHORT bytes: a row each for parts and for adjacent ranks, a merge in each row a step."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        out: list[list[int]] = [[]] * len(words)
        if not words:
            return out
        for chunk in np.array_split(order, -(-len(order) // 4096)):
            width = int(sizes[chunk[-1]])
            parts = np.full((len(chunk), width + 1), -1, dtype=np.int64)
            raw = np.frombuffer(b"".join([words[k] for k in chunk.tolist()]), dtype=np.uint8)
            n = sizes[chunk]
            parts[:, :width][np.arange(width) < n[:, None]] = self.inner[raw]
            ends = np.cumsum(n) - 1
            parts[np.arange(len(chunk)), n - 1] = self.last[raw[ends]]
            ranks = self.rank(parts[:, :-1], parts[:, 1:])
            live, place = np.arange(len(chunk)), np.arange(width)
            done = parts.copy()
            while len(live):
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(live)), at]
                go = least != NO_RANK
                if not go.all():
                    done[live[~go]] = parts[~go]
                    live, parts, ranks, at, least = live[go], parts[go], ranks[go], at[go], least[go]
                    if not len(live):
                        break
                rows = np.arange(len(live))
                parts[rows, at] = self.made[least]
                shift = np.minimum(place + (place > at[:, None]), width)
                parts[:, :width] = np.take_along_axis(parts, shift, axis=1)
                ranks = np.take_along_axis(ranks, np.minimum(place + (place >= at[:, None]), width - 1), axis=1)
                ranks[:, -1] = NO_RANK
                ranks[rows, at] = self.rank(parts[rows, at], parts[rows, at + 1])
                before = np.maximum(at - 1, 0)
                ranks[rows, before] = self.rank(parts[rows, before], parts[rows, before + 1])
            for k, row in zip(chunk.tolist(), done.tolist(), strict=True):
                out[k] = [x for x in row if x >= 0]
        return out

    def words(self, chunks: list[str]) -> list[list[bytes | int]]:
        """The words of each run without white space as bytes, special tokens as ids."""
        if not chunks:
            return []
        marked = "\n".join(chunks)
        odd = _BEYOND_LATIN.search(marked) or _CONTROL_SPACE.search(marked) or self.divide and self.divide.search(marked)
        slow = {k for k, c in enumerate(chunks) if _BEYOND_LATIN.search(c) or _CONTROL_SPACE.search(c) or self.divide and self.divide.search(c)} if odd else set()
        if slow:
            marked = "\n".join(["" if k in slow else c for k, c in enumerate(chunks)])
        out: list[list[bytes | int]] = [[]]
        for w in _LATIN_WORDS.findall(marked.lower()):
            if w == "\n":
                out.append([])
            else:
                out[-1].append(w.encode())
        back = _symbol_bytes()
        for k in slow:
            for part in self.divide.split(chunks[k]) if self.divide else [chunks[k]]:
                if part in self.special:
                    out[k].append(self.special[part])
                elif part:
                    found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
                    out[k] += [bytes(map(back.__getitem__, w)) for w, _ in found]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and their decoded text, for each run without white space."""
        divided = self.words(chunks)
        if len(self.known) > _KEPT_WORDS:
            self.known = {k: v for k, v in self.known.items() if isinstance(k, int)}
        new = {w for ws in divided for w in ws} - self.known.keys()
        short, long = [w for w in new if len(w) <= _SHORT], [w for w in new if len(w) > _SHORT]
        for w, ids in [*zip(short, self.merge_short(short), strict=True), *zip(long, map(self.merge_long, long), strict=True)]:
            self.known[w] = array("I", ids).tobytes(), self.decode(ids)
        known = self.known
        out = [known[ws[0]] if len(ws) == 1 else (b"".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])) for ws in divided]
        for w in long:
            if len(w) > _KEPT_CHARS:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with no decoder of its own: tokens joined by spaces; unknown ids are left out."""
        return " ".join(map(self.token.__getitem__, filter(self.token.__contains__, ids)))


def _byte_symbols() -> list[str]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def _symbol_bytes() -> dict[str, int]:
    return {s: b for b, s in enumerate(_byte_symbols())}


@functools.lru_cache(maxsize=2)
def rank_arrays(path: str) -> RankArrays:
    return RankArrays(path)


def divide(text: str) -> list[str]:
    """Runs between white space; the control characters that only str.split() takes for space stay inside."""
    return _SPLIT_EXACTLY.findall(text) if _CONTROL_SPACE.search(text) else text.split()


def encode(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str, digests: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: (<id_col>, n_tokens, ids, decoded).

    With ``digests`` the last two come as lower-case hex SHA-256 of the ids (little-endian unsigned 32-bit) and of the
    decoded text in UTF-8, and are never put together as one array. A null text is empty and has no ids. Every word
    is merged once per worker while its table of words has room. Other columns are not read. Repeated rows and null
    identifiers give a row each; a very long text is divided into words like any other.
    """
    outs = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = rank_arrays(vocabulary_path)
        raw, plain = _tables(vocabulary_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                chunks = [divide(t) for t in texts[part]]
                if len(raw) > _KEPT_WORDS:
                    raw.clear()
                    plain.clear()
                new = set()
                for c in chunks:
                    new.update(c)
                new = [*(new - raw.keys())]
                for c, (ids, text) in zip(new, vocab.encode_chunks(new), strict=True):
                    raw[c] = ids
                    plain[c] = text
                n, first, second = [], [], []
                for c in chunks:
                    ids = b"".join(map(raw.__getitem__, c))
                    text = " ".join(filter(None, map(plain.__getitem__, c)))
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, dtype="<u4").astype(np.int32))
                    second.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                for c in new:
                    if len(c) > _KEPT_CHARS:
                        del raw[c], plain[c]
                columns = [batch.column(0).slice(part.start, part.stop - part.start), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", *(x.split()[0] for x in outs.split(", "))])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), body(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, {outs}").withColumnRenamed("id", id_col)


@functools.lru_cache(maxsize=2)
def _tables(path: str) -> tuple[dict[str, bytes], dict[str, str]]:
    """This worker's words so far: their ids and their decoded text."""
    return {}, {}
