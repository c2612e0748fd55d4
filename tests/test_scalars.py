import pytest
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.plans.schema import BOOL, FLOAT, INT, Scalar


def values(spark, make, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


CASES = [
    (S.parse_int, {"5": 5, " -7\n": -7, "+3": 3, "007": 7, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "1.5": None, "": None, "1 2": None, "0x1": None}),
    (S.parse_float, {"1.5": 1.5, " -2e3 ": -2000.0, ".5": 0.5, "5.": 5.0, "INF": float("inf"), "-inf": float("-inf"), "1d": None, "1f": None, "x": None, "": None}),
    (S.parse_bool, {"true": True, " 1 ": True, "false": False, "0": False, "TRUE": None, "yes": None, "": None}),
    (S.parse_date, {"2024-02-29": "2024-02-29", "2023-02-29": None, "1900-02-29": None, "2000-02-29Z": "2000-02-29Z", " 2024-04-30 ": "2024-04-30", "2024-04-31": None, "2024-13-01": None, "2024-00-01": None, "2024-01-00": None, "024-01-01": None, "02024-01-01": None, "12024-12-31": "12024-12-31", "-0044-03-15": "-0044-03-15", "-0000-01-01": None, "0000-01-01": "0000-01-01", "2024-01-01+14:00": "2024-01-01+14:00", "2024-01-01+14:01": None, "2024-01-01-05:60": None, "2024-1-1": None}),
    (lambda x: S.parse_gregorian(x, "gDay"), {"---31": "---31", "---00": None, "---32": None, "--31": None, "---15Z": "---15Z"}),
    (lambda x: S.parse_gregorian(x, "gMonth"), {"--12": "--12", "--13": None, "--01-05:00": "--01-05:00"}),
    (lambda x: S.parse_gregorian(x, "gMonthDay"), {"--02-29": "--02-29", "--02-30": None, "--04-31": None, "--12-31Z": "--12-31Z"}),
    (lambda x: S.parse_gregorian(x, "gYear"), {"2024": "2024", "-0001": "-0001", "024": None, "02024": None, "2024+01:00": "2024+01:00"}),
    (lambda x: S.parse_gregorian(x, "gYearMonth"), {"2024-12": "2024-12", "2024-13": None, "12024-01Z": "12024-01Z"}),
    (lambda x: S.parse_integer(x, "positiveInteger"), {"1": "1", "0": None, "-1": None, "+0009": "+0009", "9" * 50: "9" * 50}),
    (lambda x: S.parse_integer(x, "nonPositiveInteger"), {"0": "0", "-0": "-0", "1": None, "-5": "-5"}),
    (S.local_name, {"{urn:x}a": "a", "p:a": "a", "a": "a"}),
    (S.infer, {"true": "true", "TRUE": '"TRUE"', " 7 ": "7", "007": "7", "1.5": "1.5", "nan": '"nan"', "a\"b": '"a\\"b"', "": '""', "  ": '""', "9223372036854775807": "9223372036854775807"}),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_lexical_rules(spark, number):
    make, cases = CASES[number]
    assert dict(zip(cases, values(spark, make, list(cases)), strict=True)) == cases


def test_unbounded_integers_sort_like_integers(spark):
    numbers = [0, 1, -1, 10, -10, 9, -9, 10**40, -(10**40), 10**39, 123456789012345678901234567890, -123456789012345678901234567890]
    df = spark.createDataFrame([(str(n) if i % 2 else f"{'-' if n < 0 else '+'}000{abs(n)}", str(n)) for i, n in enumerate(numbers)], "x string, n string")
    assert [int(r.n) for r in df.orderBy(S.integer_key(F.col("x"))).collect()] == sorted(numbers)


def test_binary_codecs(spark):
    assert values(spark, lambda x: S.parse_binary(x, "hexBinary"), ["0aFF", "0a f\n0", "0", "zz", ""]) == [b"\x0a\xff", b"\x0a\xf0", None, None, b""]
    assert values(spark, lambda x: S.parse_binary(x, "base64Binary"), ["aGk=", "aG k=", "a", "a===", ""]) == [b"hi", b"hi", None, None, b""]
    assert values(spark, lambda x: S.format_binary(S.parse_binary(x, "hexBinary"), "hexBinary"), ["0aff"]) == ["0AFF"]


FACETS = [
    (Scalar(enumeration=("a", "b c")), {" a ": " a ", "b c": "b c", "c": None}),
    (Scalar(patterns=("[a-z]+", ".{2,3}")), {"ab": "ab", "abcd": None, "AB": None, "a": None}),
    (Scalar(length=2), {"ab": "ab", "é€": "é€", "a": None}),
    (Scalar("int", min_inclusive="5", max_exclusive="10"), {"5": 5, "9": 9, "10": None, "x": None}),
    (Scalar("integer", max_inclusive="9" * 30), {"9" * 30: "9" * 30, "1" + "0" * 30: None}),
    (Scalar("float", min_exclusive="0.5"), {"0.6": 0.6, "0.5": None}),
    (Scalar("int", min_inclusive="what"), {"5": None}),
    (Scalar("list", item=INT), {" 1\t2\n3 ": [1, 2, 3], "": [], "1 x": None}),
    (Scalar("list", item=Scalar("int", max_inclusive="3"), max_length=2), {"1 2": [1, 2], "1 2 3": None, "4": None}),
    (Scalar("union", union=(INT, BOOL)), {"07": "7", "true": "true", "x": None}),
    (FLOAT, {"1": 1.0}),
    (Scalar("decimal"), {" 1.50 ": "1.50", "any": "any"}),
]


@pytest.mark.parametrize("number", range(len(FACETS)))
def test_facets(spark, number):
    scalar, cases = FACETS[number]
    assert dict(zip(cases, values(spark, scalar.parse, list(cases)), strict=True)) == cases
