"""Texts of a million characters beside the usual ones: the registered queries against the libraries and plain Python."""

import random
import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import test_queries

from quernstone.llm import queries


def long_texts():
    """Prose in several scripts, one word without a break, and one short line over and over."""
    draw = random.Random(11)
    words = ["the", "language", "straße", "Ünïcödé", "你好", "世界", "привет", "it's", "x1y2", "don't", "\n\n", "AKIA", "(see)", "3.14159"]
    prose = " ".join(draw.choice(words) + draw.choice(["", "", "s", ",", "."]) for _ in range(150_000))
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    return [prose, word, "one line again\n" * 70_000]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """The smallest tables with three more documents, one of them a language's own texts put together."""
    folder = tmp_path_factory.mktemp("long")
    for path in Path(test_queries.DATA).glob("*.parquet"):
        if path.name != "documents.parquet":
            shutil.copy(path, folder)
    docs = pq.read_table(f"{test_queries.DATA}/documents.parquet")
    own = docs.to_pylist()
    lang = next(r["lang"] for r in own if r["lang"] is not None)
    texts = [r["text"] for r in own if r["lang"] == lang and r["text"]]
    top = max(r["doc_id"] for r in own)
    joined = " ".join(texts)
    long = [*long_texts(), joined * (1 + 1_000_000 // len(joined))]
    more = [{**own[0], "doc_id": top + 1 + k, "text": text, "lang": None} for k, text in enumerate(long)]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(more, schema=docs.schema)]), f"{folder}/documents.parquet")
    return str(folder), top, lang


@pytest.fixture
def rows(spark, data, monkeypatch):
    monkeypatch.setattr(test_queries, "DATA", data[0])
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data[0]}/documents.parquet").collect()]


@pytest.mark.parametrize("check", ["test_op1", "test_op2", "test_op4", "test_op5", "test_op7"])
def test_long(spark, rows, check):
    getattr(test_queries, check)(spark, rows)


def test_long_language(spark, data):
    folder, top, lang = data
    found = {r.doc_id: r for r in queries.op8_language_id(spark, folder).where(f"doc_id > {top}").collect()}
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found.values())
    assert found[top + 4].lang_pred == lang
