"""Token counts of whole texts: pieces counted once per distinct pre-token, summed through per-document frequencies."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import body
from quernstone.llm.packing import slices

#: Fixed value: the character that stands for a space in the pieces of a model.
SPACE = "▁"
_RUNS = re.compile(" +[^ ]*|[^ ]+")
#: Longer pre-tokens are no keys of a shuffle: their pieces are counted where they stand.
_KEY_CHARS = 256


@functools.lru_cache(maxsize=2)
def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=path)
    pieces = [found.id_to_piece(k) for k in range(found.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or found.encode(" a  a", out_type=str)[0] not in (SPACE, SPACE * 2):
        raise ValueError(f"{path}: a piece can cross the beginning of a word or spaces are dropped; texts can't be divided there")
    return found


def pretokens(text: str) -> list[str]:
    """Words with the run of spaces before them; the library puts one space in front of a text that isn't empty.

    No piece of the model holds a space after another character, so no merge crosses the boundary of two pre-tokens.
    """
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _RUNS.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def piece_counts(processor, words: list[str]) -> list[int]:
    """Pieces of each pre-token; the library itself puts the first space in front."""
    return [len(x) if w != " " else 1 for w, x in zip(words, processor.encode([w[1:] for w in words], num_threads=1), strict=True)]


def common_pretokens(docs: DataFrame, text_col: str, model_path: str, sample_docs: int, most: int) -> dict[str, int]:
    """Piece counts of the ``most`` pre-tokens found in most of about ``sample_docs`` whole texts.

    A bounded table (``most`` words of 256 characters at most), broadcast as one side of the join for the keys that would
    be frequent in a shuffle. The sample decides which way a word is joined, never what is counted.
    """
    rows = docs.count()
    texts = docs.select(body(text_col).alias("text"))
    if rows > sample_docs:
        texts = texts.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(rows)) < sample_docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                seen: Counter = Counter()
                for t in texts[part]:
                    seen.update({w for w in pretokens(t) if len(w) <= _KEY_CHARS})
                yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["word", "n"])

    ranked = texts.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = [r.word for r in ranked.orderBy(F.desc("n"), "word").limit(most).collect()]
    return dict(zip(words, piece_counts(_processor(model_path), words), strict=True))


def token_counts(docs: DataFrame, id_col: str, text_col: str, model_path: str, sample_docs: int = 2000, common: int = 1 << 17) -> DataFrame:
    """(<id_col>, n_bytes, n_tokens) of every row of ``docs``, without begin or end tokens; a null text is empty.

    Each document gives its pre-tokens with their frequencies. The common ones are joined to a broadcast table of piece
    counts. The others are shuffled and sorted by pre-token, so all frequencies of one lie side by side: its pieces are
    counted once, joined to each of them as they pass by, and go back to the documents as sums. No ids are kept and no
    table of words grows in a task. A pre-token of over 256 characters would be a key as large as a text and is counted
    where it stands. Rows are told apart by position, so repeated or null identifiers give a row each. Other columns are
    not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(common_pretokens(docs, text_col, model_path, sample_docs, common))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, processor = known.value, _processor(model_path)
        for batch in batches:
            all_rows, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in slices(texts):
                rows, own, out_rows, out_words, out_n = all_rows[part], [], [], [], []
                for row, text in zip(rows, texts[part], strict=True):
                    total, long = 0, []
                    for w, n in Counter(pretokens(text)).items():
                        pieces = counts.get(w)
                        if pieces is not None:
                            total += pieces * n
                        elif len(w) > _KEY_CHARS:
                            long.append((w, n))
                        else:
                            out_rows.append(row)
                            out_words.append(w)
                            out_n.append(n)
                    if long:
                        total += sum(p * n for p, (_, n) in zip(piece_counts(processor, [w for w, _ in long]), long, strict=True))
                    own.append(total)
                more, size = len(out_rows), len(rows)
                ids = pa.concat_arrays([batch.column(1).slice(part.start, size), pa.nulls(more, batch.column(1).type)])
                n_bytes = pa.concat_arrays([batch.column(3).slice(part.start, size), pa.nulls(more, pa.int64())])
                word = pa.concat_arrays([pa.nulls(size, pa.string()), pa.array(out_words, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(rows + out_rows, pa.int64()), ids, n_bytes, word, pa.array(own + out_n, pa.int64())], ["row", "id", "n_bytes", "word", "n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, last, pieces = _processor(model_path), None, 0
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            # equal words are neighbours, so only the first one of a batch can have been counted before
            new = [w for w in dict.fromkeys(words) if w is not None and w != last]
            own = {last: pieces, **dict(zip(new, piece_counts(processor, new), strict=True))}
            if words and words[-1] is not None:
                last, pieces = words[-1], own[words[-1]]
            n = [k if w is None else k * own[w] for w, k in zip(words, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "n_bytes")), pa.array(n, pa.int64())], ["row", "id", "n_bytes", "n"])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    text = body(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    pairs = rows.mapInArrow(frequencies, f"row long, id {kind}, n_bytes long, word string, n long")
    # a row without a word holds what its document had in the common table; these rows are spread by their number
    by_word = pairs.repartition("word", F.when(F.col("word").isNull(), F.col("row"))).sortWithinPartitions("word")
    sums = by_word.mapInArrow(joined, f"row long, id {kind}, n_bytes long, n long")
    total = sums.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
