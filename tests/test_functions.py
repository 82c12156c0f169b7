"""Conversions on literals: an accepted and a rejected value for each branch."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from quernstone.functions import casts, cells, times
from quernstone.operators import lookups

FLAGS = {"A": 1, "B": 2, "C": 4}
LIST, MAP = casts.to_list(casts.to_signed(32)), casts.to_map(casts.to_string, casts.to_signed(32))
GOOD = [
    (casts.to_signed(32), "12", 12), (casts.to_signed(32), "-3", -3), (casts.to_signed(32), "+7", 7), (casts.to_signed(32), "0x1F", 31), (casts.to_signed(32), "-2147483648", -(2**31)), (casts.to_signed(8), "127", 127),
    (casts.to_signed(64), "0xFFFFFFFFFFFFFFFF", -1), (casts.to_signed(64), "000000000000000000000000000000000000012", 12), (casts.to_unsigned(8), "255", 255), (casts.to_unsigned(64), "18446744073709551615", Decimal(2**64 - 1)), (casts.to_unsigned(64), "0xFFFFFFFFFFFFFFFF", Decimal(2**64 - 1)),
    (casts.to_bool, "true", True), (casts.to_bool, "FALSE", False), (casts.to_double, "1.5", 1.5), (casts.to_double, "-2e3", -2000.0), (casts.to_float_checked, "1.5", 1.5), (casts.to_string, "x", "x"), (casts.to_string, "null", None), (casts.to_string, "", None),
    (casts.to_datetime, "2021-02-16", dt.datetime(2021, 2, 16)), (casts.to_datetime, "2021-02-16 01:02:03", dt.datetime(2021, 2, 16, 1, 2, 3)), (casts.to_timespan, "01:02:03", dt.timedelta(hours=1, minutes=2, seconds=3)),
    (casts.to_timespan, "1 02:03:04", dt.timedelta(days=1, hours=2, minutes=3, seconds=4)), (casts.to_timespan, "-1.02:03:04.5", -dt.timedelta(days=1, hours=2, minutes=3, seconds=4.5)),
    (LIST, "1 & 2 & 3", [1, 2, 3]), (LIST, "1\n2", [1, 2]), (LIST, "", []), (LIST, None, []), (MAP, "a:1 & b:2", {"a": 1, "b": 2}), (MAP, "", {}),
    (casts.to_point(), "3, 4", (3, 4)), (casts.to_size(), "3,4", (3, 4)), (casts.to_range(), "1 ~ 9", (1, 9)), (casts.to_enum(FLAGS), "A", ("A", 1)), (casts.to_enum(FLAGS), "A | B", (None, 3)), (casts.to_enum(FLAGS), "A|B&C", (None, 0)),
    (casts.to_call, "item(1, x)", ("item", ["1", "x"])), (casts.to_call, "f()", ("f", [])), (casts.nullable(casts.to_signed(32)), "null", None), (casts.to_list(casts.to_call), "f(1 & 2) & g(3)", [("f", ["1 & 2"]), ("g", ["3"])]),
    (casts.to_date_range, "2021-02-16 ~ 2021-03-16", (dt.datetime(2021, 2, 16), dt.datetime(2021, 3, 16))), (casts.to_date_range, "1 00:00:00", (dt.datetime(1, 1, 1), dt.datetime(1, 1, 2))),
]
BAD = [
    (casts.to_signed(32), "1.5"), (casts.to_signed(32), "2147483648"), (casts.to_signed(32), ""), (casts.to_signed(32), None), (casts.to_signed(32), "1e3"), (casts.to_signed(64), "9" * 60), (casts.to_signed(64), "0x1" + "0" * 16), (casts.nullable(casts.to_signed(32)), "x"),
    (casts.to_unsigned(8), "256"), (casts.to_unsigned(8), "-1"), (casts.to_unsigned(64), "18446744073709551616"), (casts.to_float_checked, "1e39"), (casts.to_double, "1.5d"), (casts.to_bool, "1"), (casts.to_bool, "yes"), (casts.to_datetime, "soon"), (casts.to_datetime, "2021"), (casts.to_datetime, "2021-02-30"),
    (casts.to_timespan, "1h"), (casts.to_timespan, "25:00:00"), (casts.to_date_range, "a ~ b"), (LIST, "1 & x"), (MAP, "a"), (MAP, "a:1:2"), (MAP, "a:1 & a:2"), (casts.to_point(), "3"), (casts.to_point(), "-1,2"), (casts.to_range(), "1-9"), (casts.to_enum(FLAGS), "Z"), (casts.to_enum(FLAGS), "~A"), (casts.to_call, "item"),
]


def one(spark, cast, text):
    r = spark.createDataFrame([(text,)], "c string").select(cast(F.col("c")).alias("r")).first().r
    return r.value, r.error


def plain(x):
    if isinstance(x, tuple):
        return tuple(map(plain, x))
    return [plain(y) for y in x] if isinstance(x, list) else x


def test_accepted(spark):
    for cast, text, want in GOOD:
        value, error = one(spark, cast, text)
        assert error is None and plain(value) == want, (text, value, error)


def test_cast_columns(spark):
    """Casts of a whole table give what they give one by one, whatever its columns are called."""
    for cast, name in ((casts.to_signed(32), "int"), (LIST, "list"), (MAP, "map"), (casts.to_enum(FLAGS), "enum"), (casts.nullable(casts.to_timespan), "span"), (casts.to_date_range, "range"), (casts.to_point(), "point")):
        texts = [t for _, t, *_ in GOOD] + [t for _, t in BAD]
        df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "__text0 int, __found0 string, __text string")
        single = df.select("__text0", cast(F.col("__found0")).cast("string").alias("r")).collect()
        table = casts.cast_columns(df, {"r": (cast, F.col("__found0"))})
        assert table.columns == ["__text0", "__found0", "__text", "r"]
        assert {r["__text0"]: r.r for r in table.select("__text0", F.col("r").cast("string").alias("r")).collect()} == {r["__text0"]: r.r for r in single}, name


def test_rejected(spark):
    for cast, text in BAD:
        value, error = one(spark, cast, text)
        assert error and value is None, (text, value, error)


def test_nested_enums(spark):
    want = {"A": 1, "(A | B) & C": 0, "(A|B)": 3, "A | (B & C) | C": 5, "((A))": 1, "A |": None, "(A": None, "A)": None, "()": None, "A B": None, "~A": None, "Z": None, "A | Z": None, "": None, "& A": None}
    got = lookups.evaluate_enums(spark.createDataFrame([(t,) for t in want], "text string"), "text", FLAGS).collect()
    assert {r.text: r.mask for r in got} == want
    assert all((r.mask is None) == (r.mask_error is not None) for r in got)


def test_nested_enums_like_python(spark):
    """Random expressions, fully parenthesised, against Python's own operators."""
    rng = random.Random(3)

    def make(depth):
        return rng.choice("ABC") if not depth or rng.random() < 0.2 else f"({make(depth - 1)}{rng.choice('&|')}{make(depth - 1)})"

    texts = sorted({make(4) for _ in range(150)})
    got = lookups.evaluate_enums(spark.createDataFrame([(t,) for t in texts], "text string"), "text", FLAGS).collect()
    assert {r.text: r.mask for r in got} == {t: eval(t, {}, FLAGS) for t in texts}  # noqa: S307


def test_enum_values(spark):
    """Aliases of any depth, hexadecimal, inversion; circles and unknown names are faults."""
    tokens = {"A": ["1"], "B": ["A", "|", "0x2"], "C": ["(", "B", "|", "4", ")", "&", "~", "A"], "D": ["C"], "E": ["D", "|", "B"], "X": ["Y"], "Y": ["X"], "Z": ["nope"], "W": ["1", "|"]}
    got = {r.member: (r.value, r.fault) for r in lookups.enum_values(spark.createDataFrame([("F", m, t) for m, t in tokens.items()], "enum string, member string, tokens array<string>")).collect()}
    assert {m: v for m, (v, f) in got.items() if f is None} == {"A": 1, "B": 3, "C": 6, "D": 6, "E": 7}
    assert {m for m, (_, f) in got.items() if f == "unknown or circular name"} == {"X", "Y", "Z"} and got["W"][1] == "not an expression"


def test_cells(spark):
    df = spark.createDataFrame([("numeric", "3.00000001", "int"), ("numeric", "2.55555", "int"), ("numeric", "44243.5", "DateTime"), ("numeric", "0.25", "TimeSpan"), ("string", " x ", "string"), ("blank", "", "int")], "kind string, value string, declared string")
    got = [r[0] for r in df.select(cells.normalize_cell(F.col("kind"), F.col("value"), F.col("declared"))).collect()]
    assert got == ["3", got[1], "2021-02-16 12:00:00", "06:00:00", "x", None] and got[1].startswith("2.555")


def test_times(spark):
    r = spark.range(1).select(
        times.total_millis(times.parse_span(F.lit("-1.00:00:01.5"))).alias("a"), times.span_text(F.lit(-90061007)).alias("b"), times.span_parts(F.lit(-90061007)).alias("c"), times.is_empty(times.span_of()).alias("d"),
        times.in_range(F.expr("timestamp_ntz'2021-01-02'"), F.expr("named_struct('Start', timestamp_ntz'2021-01-01', 'End', timestamp_ntz'2021-01-02')")).alias("e"), times.moment_text().alias("f"),
    ).first()
    assert (r.a, r.b, tuple(r.c), r.d, r.e) == (-86401500, "-1.01:01:01.7", (-1, -1, -1, -1, -7), True, False) and len(r.f) == 19
