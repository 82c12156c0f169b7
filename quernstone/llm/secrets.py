"""Secret scans by fixed patterns and sliding-window entropy, on DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import body

#: Fixed values of the base scan: kind, pattern, test of a match (group 2 of the first has 6 characters or more).
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: A run this long can hold a secret; in a shorter one a window of entropy doesn't fit.
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Class of characters, pattern of a candidate of the class, bits of entropy that its best window needs.
CLASSES = (
    ("decimal", "^[0-9]+$", 9.0),  # ten digits are numbers, not secrets
    ("hexadecimal", "^[0-9A-Fa-f-]+$", 3.0),
    ("lower", "^[a-z0-9_-]+$", 3.7),
    ("upper", "^[A-Z0-9_-]+$", 3.7),
    ("mixed", "^.*$", 3.8),
)
#: Candidates that are known to be harmless as a whole: no digit, no letter, words joined by marks, UUIDs.
ALLOWED = (
    "^[^0-9]+$",
    "^[^A-Za-z]+$",
    "^(?:[A-Za-z]++[0-9]{0,4}+[/_=-]++)++[A-Za-z]*+[0-9]{0,4}+$",  # possessive: a long path needs no stack
    "^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
)
#: Harmless parts: placeholders, alphabets, repeats. A window that touches one doesn't count; the rest of the run does.
HARMLESS = "(?i:example|sample|placeholder|changeme|dummy|xxxx|your[_-]|abcdefgh|01234567|12345678)|(.)\\1{5,}"
#: What other kinds find by themselves.
BASE_RUNS = ("^[0-9a-f]{24,}$", "^AKIA[A-Z0-9]{16,}$")
#: Characters of a candidate that are scanned at a time; the next 19 go with them, so every window is in one chunk.
CHUNK = 1024
_FIRST, _SLOTS = ord("+"), ord("z") - ord("+") + 1


def _least_sum(chunk: Column) -> Column:
    """The least sum of c log2 c over the counts c of the characters of a window, over all windows of a chunk.

    One pass with the counts of the present window: a character enters, the one 20 before leaves, and each changes one
    count and the sum by a step that depends on that count alone.
    """
    weight = [n * math.log2(n) if n > 1 else 0.0 for n in range(WINDOW + 2)]
    step = F.array(*[F.lit(b - a) for a, b in zip(weight, weight[1:], strict=False)])
    codes = F.transform(F.slice(F.split(chunk, "", -1), F.lit(1), F.length(chunk)), lambda c: F.ascii(c) - _FIRST)
    behind = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
    moves = F.zip_with(codes, F.slice(behind, F.lit(1), F.length(chunk)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))

    def move(at: Column, x: Column) -> Column:
        gone = F.when(x["old"] >= 0, F.get(step, F.get(at["counts"], x["old"]) - 1)).otherwise(F.lit(0.0))
        held = F.get(at["counts"], x["new"]) - F.when(x["new"] == x["old"], 1).otherwise(0)
        total = at["total"] - gone + F.get(step, held)
        counts = F.transform(at["counts"], lambda n, k: n + F.when(k == x["new"], 1).otherwise(0) - F.when(k == x["old"], 1).otherwise(0))
        full = at["seen"] + 1 >= WINDOW
        return F.struct(counts.alias("counts"), (at["seen"] + 1).alias("seen"), total.alias("total"), F.when(full, F.least(at["least"], total)).otherwise(at["least"]).alias("least"))

    start = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("counts"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    return F.aggregate(moves, start, move, lambda at: at["least"])


def entropy(candidate: Column) -> Column:
    """Bits of the best window of a candidate that touches no harmless part; null if there is no such window."""
    parts = F.filter(F.split(candidate, HARMLESS, -1), lambda p: F.length(p) >= WINDOW)
    cut_up = f"(?s)(.{{1,{CHUNK}}})(?=(.{{0,{WINDOW - 1}}}))"
    piece = lambda p, k: F.regexp_extract_all(p, F.lit(cut_up), F.lit(k))
    chunks = F.flatten(F.transform(parts, lambda p: F.zip_with(piece(p, 1), piece(p, 2), lambda a, b: F.concat(a, b))))
    return F.log2(F.lit(float(WINDOW))) - F.array_min(F.transform(chunks, _least_sum)) / WINDOW


def is_secret(candidate: Column) -> Column:
    """Whether the entropy of some window reaches the bound of the candidate's class; allow-listed ones never do."""
    allowed = candidate.rlike("|".join([*ALLOWED, *BASE_RUNS]))
    bound = F.coalesce(*[F.when(candidate.rlike(pattern), F.lit(least)) for _, pattern, least in CLASSES])
    return F.when(~allowed, F.coalesce(entropy(candidate) >= bound, F.lit(False))).otherwise(F.lit(False))


def _alternatives(text: Column) -> list[tuple[Column, str]]:
    """Gate and pattern by kind. Runs of 24 or 20 characters are the matches of the open pattern that pass its test."""
    return [
        (text.rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"), ASSIGN),
        (F.contains(text, F.lit("AKIA")), ACCESS),
        (text.rlike("[0-9a-f]{24}"), "[0-9a-f]{24,}"),
        (text.rlike("[A-Za-z0-9+/=_-]{20}"), CANDIDATE),
    ]


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kind, start, end) of all secrets in whole texts, in code points, ends exclusive; ``kind`` indexes KINDS.

    A document without any has one row with a null kind. Matches of a pattern lie between the parts that splitting by
    it leaves, so their places follow from running sums of lengths. A candidate string is an ``entropy`` secret where
    the entropy of some window of 20 characters reaches the bound of its class. It is scanned in the row that holds it,
    in chunks that overlap by a window, so only numbers are shuffled. Allow-listed candidates, and those that the base
    kinds ``hex`` and ``access`` find, are left out. Null texts are empty. Rows are told apart by position, so repeated
    rows and null identifiers give rows of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), body(text_col).alias("text"))
    none = F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("pattern"))
    tried = F.filter(F.array(none, *[F.when(gate, F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"))) for k, (gate, p) in enumerate(_alternatives(F.col("text")))]), lambda x: x.isNotNull())
    each = rows.select("row", "id", "text", F.explode(tried).alias("t"))
    pairs = F.when(F.col("t.kind") >= 0, F.arrays_zip(F.regexp_extract_all("text", F.col("t.pattern"), F.lit(0)).alias("m"), F.split("text", F.col("t.pattern"), -1).alias("gap")))
    places = each.select("row", "id", F.col("t.kind").alias("kind"), F.posexplode_outer(pairs).alias("k", "at")).where("kind < 0 or at.m is not null")
    places = places.select("row", "id", "kind", "k", F.col("at.m").alias("m"), F.length("at.m").cast("long").alias("size"), F.length("at.gap").cast("long").alias("gap"))
    enough = (
        F.when(F.col("kind") == 0, F.length(F.regexp_extract("m", ASSIGN, 2)) >= 6)
        .when(F.col("kind") == 1, F.col("size") >= 20)
        .when(F.col("kind") == 3, is_secret(F.col("m")))
        .otherwise(F.lit(True))
    )
    places = places.withColumn("enough", enough).drop("m").repartition("row")
    places = places.withColumn("end", F.sum(F.col("size") + F.col("gap")).over(Window.partitionBy("row", "kind").orderBy("k"))).where("enough")
    known = F.col("kind") >= 0
    return places.select("row", "id", F.when(known, F.col("kind")).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def summary(found: DataFrame) -> DataFrame:
    """One row per document: (id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy)."""
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    grouped = found.groupBy("row").agg(
        F.first("id").alias("id"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("all"),
    )
    listed = lambda xs: F.array_join(F.transform(xs, name), ",")
    base = F.sha2(listed(F.filter("all", lambda s: s["kind"] < 3)), 256)
    return grouped.select("id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), listed(F.col("all")).alias("spans"), "n_entropy", "row")


def has_secret(text: Column) -> Column:
    """Whether a text holds a secret of any kind, decided where the text is; null for a null text."""
    gates = [gate for gate, _ in _alternatives(text)]
    assigned = F.exists(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    mixed = F.exists(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), is_secret)
    access = gates[1] & text.rlike("AKIA[A-Z0-9]{16}")
    return access | gates[2] | F.when(gates[0], assigned).otherwise(F.lit(False)) | F.when(gates[3], mixed).otherwise(F.lit(False))


def without_secrets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` in which no secret is found, with their own columns; nothing is shuffled.

    A null text holds none. Repeated rows and null identifiers are judged one by one.
    """
    return docs.where(~has_secret(body(text_col)))
