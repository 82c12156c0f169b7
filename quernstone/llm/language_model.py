"""Interpolated modified Kneser-Ney model: n-grams counted in Spark, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import body, cut
from quernstone.operators.checkpoints import shared_folder

#: Hashes of the beginning of a text, which is a context only, and of its end, which is predicted like a word.
BEGIN, END = np.uint64(1), np.uint64(2)
#: Bytes of text that are divided at once; bytes of a word that are hashed as an array; n-grams that a task gathers.
_PIECE, _LONG_WORD, _GATHERED = 1 << 21, 256, 1 << 21
#: Contexts made of the most frequent words alone are spread by the whole n-gram, so any other holds at most 1/256 of all.
_FREQUENT = 256
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_POWER = np.cumprod(np.full(_LONG_WORD, _STEP, dtype=np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``raw``, A-Z like a-z; words end at a space or \\x09 to \\x0D."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    own = np.flatnonzero(~_SPACE[codes])
    if not len(own):
        return np.zeros(0, dtype=np.uint64), own
    first = np.empty(len(own), dtype=bool)
    first[0], first[1:] = True, np.diff(own) > 1
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(own)))
    place = np.arange(len(own)) - np.repeat(at, size)
    found = _mix(np.add.reduceat(_BYTE[codes[own]] * _POWER[np.minimum(place, _LONG_WORD - 1)], at) + size.astype(np.uint64))
    for k in np.flatnonzero(size > _LONG_WORD):
        word = raw[own[at[k]] : own[at[k]] + size[k]].lower()
        found[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return np.where(found <= END, found + np.uint64(8), found), own[at]


def streams(texts: Sequence[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, text, predicted) of tokens: ``order`` - 1 begins, the words and an end for each text, in pieces.

    A piece of a long text begins with the last ``order`` - 1 tokens of the piece before, which aren't predicted again.
    """
    at = 0
    while at < len(texts):
        last, size = at, 0
        while last < len(texts) and (last == at or size + len(texts[last]) <= _PIECE):
            size += len(texts[last]) + 1
            last += 1
        if size <= _PIECE + 1:
            words, starts = word_hashes(b"\n".join(texts[at:last]))
            bounds = np.cumsum([0, *(len(t) + 1 for t in texts[at:last])])
            count = np.diff(np.searchsorted(starts, bounds))
            text = np.repeat(np.arange(last - at), count + order)
            hashes, predicted = np.full(len(text), BEGIN), np.ones(len(text), dtype=bool)
            heads = np.cumsum(np.append(0, count[:-1] + order))
            for k in range(order - 1):
                predicted[heads + k] = False
            hashes[heads + order - 1 + count] = END
            hashes[np.arange(len(words)) + np.repeat(np.arange(last - at) * order + order - 1, count)] = words
            yield hashes, text + at, predicted
        else:
            raw, done, carry = texts[at], 0, np.full(order - 1, BEGIN)
            while True:
                gap = _GAP.search(raw, min(done + _PIECE, len(raw)))
                till = gap.start() if gap else len(raw)
                words = word_hashes(raw[done:till])[0]
                hashes = np.concatenate([carry, words, *([[END]] if till == len(raw) else [])]).astype(np.uint64)
                yield hashes, np.full(len(hashes), at), np.arange(len(hashes)) >= order - 1
                if till == len(raw):
                    break
                done, carry = till, hashes[len(hashes) - (order - 1) :]
        at = last


def _key(words: Sequence[np.ndarray]) -> np.ndarray:
    found = np.full(len(words[0]), len(words), dtype=np.uint64)
    for w in words:
        found = _mix((found + w) * _STEP)
    return found


@dataclass(frozen=True)
class Dealing:
    """Where an n-gram is kept: shards by its context, or by all of it where its context is made of frequent words."""

    shards: int
    frequent: np.ndarray

    def __call__(self, words: Sequence[np.ndarray], key: np.ndarray) -> np.ndarray:
        if len(words) == 1:
            return (key % np.uint64(self.shards)).astype(np.int32)
        often = np.ones(len(key), dtype=bool)
        for w in words[:-1]:
            often &= self.frequent[np.minimum(np.searchsorted(self.frequent, w), len(self.frequent) - 1)] == w
        return (np.where(often, key, _key(words[:-1])) % np.uint64(self.shards)).astype(np.int32)


#: What is kept of an n-gram: its adjusted count, and as a context the sum of its n-grams' counts and how many have 1, 2, more.
_TOP, _LOWER, _WORD = ("n",), ("n", "total", "once", "twice", "more"), ("n", "total", "once", "twice", "more", "raw")


def _fields(level: int, order: int) -> tuple[str, ...]:
    return _WORD if level == 1 else _TOP if level == order else _LOWER


def _summed(words: list[np.ndarray], values: list[np.ndarray], deal: Dealing) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams by (shard, key) with the sums of their values."""
    key = _key(words)
    shard = deal(words, key)
    by = np.lexsort((key, shard))
    key, shard = key[by], shard[by]
    at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])))
    return [w[by][at] for w in words], [np.add.reduceat(v[by], at) for v in values], shard[at], key[at]


def _runs(words: list[np.ndarray], values: list[np.ndarray], shard: np.ndarray, level: int, order: int) -> pa.RecordBatch:
    """One row a shard: the n-grams of it, sorted by context so that neighbours repeat themselves."""
    by = np.lexsort((*words[::-1], shard))
    at = np.flatnonzero(np.append(True, shard[by[1:]] != shard[by[:-1]]))
    bounds = pa.array(np.append(at, len(by)), pa.int32())
    columns = [pa.array(shard[by][at], pa.int32())]
    columns += [pa.ListArray.from_arrays(bounds, pa.array(w[by].view(np.int64))) for w in words]
    columns += [pa.ListArray.from_arrays(bounds, pa.array(v[by].astype(np.int64))) for v in values]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in _run_columns(level, order)])


def _run_columns(level: int, order: int) -> list[tuple[str, str]]:
    return [("shard", "int"), *((f"w{k}", "array<long>") for k in range(level)), *((f, "array<long>") for f in _fields(level, order))]


def _schema(level: int, order: int) -> str:
    return ", ".join(f"{n} {t}" for n, t in _run_columns(level, order))


def _grams(hashes: np.ndarray, text: np.ndarray, predicted: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-grams that end in the predicted tokens."""
    ends = np.flatnonzero(predicted)
    return [hashes[ends - k] for k in range(order - 1, -1, -1)]


def _file_system(folder: str):
    """(file system, path in it) of a folder named as Spark names it."""
    from pyarrow import fs

    if re.match("/|file:/", folder):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def _written(folder: str, level: int, fields: Sequence[str], key: np.ndarray, shard: np.ndarray, values: list[np.ndarray]) -> dict:
    """Keys and values one array behind the other in a new file; what a reader needs to map it. A task that is repeated
    leaves a file that nothing names.
    """
    store, path = _file_system(folder)
    name = f"{level}-{uuid.uuid4().hex}"
    narrow = [v.astype(np.min_scalar_type(int(v.max(initial=0)))) for v in values]
    with store.open_output_stream(f"{path}/{name}") as out:
        for a in (key, *narrow):
            out.write(a.tobytes())
            out.write(bytes(-a.nbytes % 8))
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    n = values[0]
    return {"file": name, "size": len(key), "kinds": [a.dtype.name for a in narrow], "shards": shard[at].tolist(), "starts": at.tolist(), "counts": [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 0).sum()), int(n.sum())]}


_FILES = pa.struct([("file", pa.string()), ("size", pa.int64()), ("kinds", pa.list_(pa.string())), ("shards", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_FILES_SQL = "struct<file: string, size: long, kinds: array<string>, shards: array<int>, starts: array<long>, counts: array<long>>"


def _discounts(counts: Sequence[int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from how many n-grams have counts 1 to 4; fixed values if those don't give any."""
    one, two, three, four = counts[:4]
    if min(one, two, three, four):
        y = one / (one + 2 * two)
        found = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


@dataclass(frozen=True)
class Model:
    """Files of each level with their places in shards, discounts, tokens and distinct tokens of the training texts."""

    order: int
    folder: str
    deal: Dealing
    files: dict[int, list[dict]]
    discounts: dict[int, tuple[float, float, float]]
    counts: dict[int, list[int]]
    tokens: int
    distinct: int


def _level(runs: DataFrame, level: int, order: int, deal: Dealing, folder: str, partitions: int) -> DataFrame:
    """(files, <runs of the level below>): each task sums its shards, writes them and gives what they say about the level below."""
    fields, lower = _fields(level, order), _fields(level - 1, order) if level > 1 else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c.flatten()) for c in b.columns[1:]] for b in batches if b.num_rows]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        del held
        words, values, shard, key = _summed([c.view(np.uint64) for c in columns[:level]], columns[level:], deal)
        del columns
        files = [_written(folder, level, fields, key, shard, values)]
        more = [pa.nulls(1, pa.list_(pa.int64()))] * (level - 1 + len(lower))
        yield pa.RecordBatch.from_arrays([pa.array(files, _FILES), pa.array([None], pa.int32()), *more], ["files", "shard", *(f"c{k}" for k in range(len(more)))])
        if level == 1:
            return
        n, zero = values[0], np.zeros(len(key), dtype=np.int64)
        seen = n > 0
        # a word is followed by this context, or preceded by something: once a kind, but as often as it stands at a beginning
        after = [np.where(words[1] == BEGIN, n, 1) if level > 2 else np.ones(len(key), dtype=np.int64), *[zero] * (len(lower) - 1)]
        before = [zero, n, n == 1, n == 2, n > 2, *[zero] * (len(lower) - 5)]
        for own, given in ((words[1:], after), (words[:-1], before)):
            own, given, where, _ = _summed([w[seen] for w in own], [np.asarray(v, dtype=np.int64)[seen] for v in given], deal)
            if len(where):
                part = _runs(own, given, where, level - 1, order)
                yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, _FILES), *part.columns], ["files", "shard", *(f"c{k}" for k in range(part.num_columns - 1))])

    dealt = runs.repartition(partitions, "shard")
    columns = [n for n, _ in _run_columns(level - 1, order)][1:] if level > 1 else []
    return cut(dealt.mapInArrow(run, f"files {_FILES_SQL}, shard int" + "".join(f", c{k} array<long>" for k in range(len(columns)))).toDF("files", "shard", *columns))


def train(docs: DataFrame, text_col: str, order: int = 2) -> Model:
    """Counts of the whole texts of ``docs``; null counts as empty. ``order`` is the longest n-gram, 2 at least.

    Words (lower-cased A-Z) are 64-bit hashes. Tasks sum their n-grams and send them, as sorted runs, to shards; a shard's
    counts are written as arrays sorted by the hash of the n-gram, and what they say about the n-grams without their first
    word (in how many ways it is continued) and about their contexts goes on to the level below. Files lie in the shared
    folder, as large as the counts; the driver gets a line a shard. Two n-grams among n share a hash with odds n^2 / 2^65.
    """
    spark = docs.sparkSession
    if order < 2:
        raise ValueError("the longest n-gram has two words at least")
    texts = docs.select(body(text_col).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, _, predicted in streams(batch.column(0).to_pylist(), 2):
                word, n = np.unique(hashes[predicted], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    raw = cut(texts.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, distinct = raw.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = [r.word for r in raw.orderBy(F.desc("n"), "word").limit(_FREQUENT).collect()]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // _GATHERED))
    deal = Dealing(4 * partitions, np.sort(np.array([BEGIN, *np.array(often, dtype=np.int64).view(np.uint64)], dtype=np.uint64)))
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    store, path = _file_system(folder)
    store.create_dir(path)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            words, values, shard, _ = _summed([np.concatenate(w) for w in zip(*(h[0] for h in held), strict=True)], [np.concatenate([h[1] for h in held])], deal)
            return _runs(words, values, shard, order, order)

        for batch in batches:
            for part in streams(batch.column(0).to_pylist(), order):
                words, values, *_ = _summed(grams := _grams(*part, order), [np.ones(len(grams[0]), dtype=np.int64)], deal)
                held.append((words, values[0]))
                if sum(len(h[1]) for h in held) >= _GATHERED:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, n = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
                yield _runs([word], [*[np.zeros(len(n), dtype=np.int64)] * (len(_WORD) - 1), n], deal([word], _key([word])), 1, order)

    runs, files, counts = texts.mapInArrow(gathered, _schema(order, order)), {}, {}
    for level in range(order, 0, -1):
        found = _level(runs, level, order, deal, folder, partitions)
        files[level] = [r.files.asDict() for r in found.where("files is not null").select("files").collect()]
        counts[level] = [sum(x["counts"][k] for x in files[level]) for k in range(6)]
        if level > 1:
            runs = found.where("files is null").drop("files")
        if level == 2:
            runs = runs.unionByName(raw.mapInArrow(vocabulary, _schema(1, order)))
    return Model(order, folder, deal, files, {k: _discounts(c) for k, c in counts.items()}, counts, tokens, distinct)


def _mapped(spark: SparkSession, model: Model) -> str | None:
    """None if workers can map the files where they lie; else Spark sends the files to each executor."""
    if re.match("/|file:/", model.folder):
        return None
    spark.sparkContext.addFile(model.folder, recursive=True)
    return model.folder.rsplit("/", 1)[1]


@functools.lru_cache(maxsize=4096)
def _arrays(path: str, size: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The keys and values of a file, mapped: pages are read when a search touches them."""
    raw, found, at = np.memmap(path, dtype=np.uint8, mode="r"), [], 0
    for kind in ("uint64", *kinds):
        n = size * np.dtype(kind).itemsize
        found.append(raw[at : at + n].view(kind))
        at += n + -n % 8
    return found


class _Lookup:
    """Values of n-grams of one level."""

    def __init__(self, model: Model, level: int, sent: str | None):
        self.fields, self.deal = _fields(level, model.order), model.deal
        self.folder = SparkFiles.get(sent) if sent else _file_system(model.folder)[1]
        self.places = {s: (f, a, b) for f in model.files[level] for s, a, b in zip(f["shards"], f["starts"], [*f["starts"][1:], f["size"]], strict=True)}

    def __call__(self, words: list[np.ndarray]) -> dict[str, np.ndarray]:
        key = _key(words)
        shard = self.deal(words, key)
        by = np.lexsort((key, shard))
        found = {f: np.zeros(len(key), dtype=np.int64) for f in self.fields}
        cuts = np.flatnonzero(np.append(True, shard[by[1:]] != shard[by[:-1]])) if len(by) else []
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            own = by[a:b]
            if (place := self.places.get(int(shard[own[0]]))) is None:
                continue
            f, start, stop = place
            keys, *values = _arrays(f"{self.folder}/{f['file']}", f["size"], tuple(f["kinds"]))
            at = start + np.searchsorted(keys[start:stop], key[own])
            hit = keys[np.minimum(at, stop - 1)] == key[own]
            for name, v in zip(self.fields, values, strict=True):
                found[name][own[hit]] = v[at[hit]]
        return found


def probabilities(model: Model, lookups: dict[int, _Lookup], hashes: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, training count) of every predicted token of a stream."""
    order, ends = model.order, np.flatnonzero(predicted)
    d, (*_, kinds, total) = model.discounts[1], model.counts[1]
    less = lambda n, d: np.maximum(n - np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])), 0)
    known = lookups[1]([hashes])
    if total:
        counts = model.counts[1]
        rest = (d[0] * counts[0] + d[1] * counts[1] + d[2] * (kinds - counts[0] - counts[1])) / total
        p = less(known["n"][ends], d) / total + rest / (model.distinct + 1)
    else:
        p = np.full(len(ends), 1 / (model.distinct + 1))
    context = known
    for level in range(2, order + 1):
        # the n-gram that ends in token t stands at t; for the first tokens of a piece there is none, and none is asked for
        own = lookups[level]([np.append(np.full(k, BEGIN), hashes[: len(hashes) - k]) for k in range(level - 1, -1, -1)])
        d, (total, once, twice, more) = model.discounts[level], (context[f][ends - 1] for f in ("total", "once", "twice", "more"))
        there, safe = total > 0, np.maximum(total, 1)
        p = np.where(there, less(own["n"][ends], d) / safe + (d[0] * once + d[1] * twice + d[2] * more) / safe * p, p)
        context = own
    return p, known["raw"][ends]


def score(model: Model, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(<id_col>, n_tokens, n_known, base_score, score) of every row of ``docs``: log10 probabilities of the whole text.

    Tokens are the words and one end; ``n_known`` of them stand in the training texts. ``base_score`` is that of single
    tokens with one added to each count. A null text is empty and has the end alone; repeated rows and null identifiers
    give a row each; a long text is divided in pieces. Unknown words share what the model leaves for one. No row moves.
    """
    sent = _mapped(docs.sparkSession, model)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        lookups = {k: _Lookup(model, k, sent) for k in range(1, model.order + 1)}
        for batch in batches:
            n = batch.num_rows
            tokens, seen, base, own = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
            for hashes, text, predicted in streams(batch.column(1).to_pylist(), model.order):
                p, raw = probabilities(model, lookups, hashes, predicted)
                where = text[predicted]
                tokens += np.bincount(where, minlength=n)
                seen += np.bincount(where[raw > 0], minlength=n)
                base += np.bincount(where, np.log10((raw + 1) / (model.tokens + model.distinct + 1)), minlength=n)
                own += np.bincount(where, np.log10(p), minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(own)], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), body(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)
