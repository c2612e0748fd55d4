"""Lexical rules of XML Schema scalars as Column expressions.

Parsers return null for text that is not a value of the type; none of them raises. White space is ASCII's.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\r\n\f"
#: Time zone suffix, parts of Gregorian values as W3C XML Schema Datatypes spells them, sign rules of the unbounded
#: integer kinds.
ZONE = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
YEAR, MONTH, DAY = "(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
GREGORIAN = {"gDay": f"---{DAY}", "gMonth": f"--{MONTH}", "gMonthDay": f"--{MONTH}-{DAY}", "gYear": YEAR, "gYearMonth": f"{YEAR}-{MONTH}"}
INTEGER_SIGNS = {
    "integer": (-1, 0, 1),
    "nonPositiveInteger": (-1, 0),
    "negativeInteger": (-1,),
    "nonNegativeInteger": (0, 1),
    "positiveInteger": (1,),
}
FLOAT = r"(?i)[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


@lru_cache(1 << 12)
def compiles(pattern: str) -> bool:
    """Whether Spark can read the pattern, told by a constant that it folds."""
    try:
        SparkSession.active().sql("SELECT regexp_like('', :pattern)", args={"pattern": rf"\A(?:{pattern})\z"}).first()
    except Exception as e:  # of several kinds, by where the pattern is looked at first
        if "INVALID_PARAMETER_VALUE" in str(e) or "PatternSyntax" in str(e):
            return False
        raise
    return True


def matches(x: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the text; one that is no regular expression matches nothing."""
    if not compiles(pattern):
        return F.when(x.isNotNull(), F.lit(False))
    return F.regexp_like(x, F.lit(rf"\A(?:{pattern})\z"))


def parse_string(x: Column) -> Column:
    return x


def _spaced(x: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the text but white space at its ends, which casts skip too: cheaper than trimming."""
    return F.regexp_like(x, F.lit(rf"\A[{SPACES}]*(?:{pattern})[{SPACES}]*\z"))


def parse_int(x: Column) -> Column:
    """64-bit integers, with a sign or without."""
    return F.when(_spaced(x, "[+-]?[0-9]+"), x.try_cast("bigint"))


def parse_float(x: Column) -> Column:
    return F.when(_spaced(x, FLOAT), x.try_cast("double"))


def parse_bool(x: Column) -> Column:
    return F.when(trim(x).isin("true", "1"), F.lit(True)).when(trim(x).isin("false", "0"), F.lit(False))


def parse_decimal(x: Column) -> Column:
    """Decimals keep their text; callers that need a number cast it."""
    return trim(x)


def integer_key(x: Column) -> Column:
    """A struct that sorts like the unbounded integer that the text denotes."""
    digits = F.ltrim(F.regexp_replace(trim(x), "^[+-]", ""), F.lit("0"))
    sign = F.when(digits == "", 0).when(F.startswith(trim(x), F.lit("-")), -1).otherwise(1)
    return F.struct(sign.alias("sign"), (sign * F.length(digits)).alias("size"), F.when(sign < 0, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"))


def parse_integer(x: Column, kind: str = "integer") -> Column:
    """Text of an unbounded integer whose sign the kind allows."""
    good = matches(trim(x), "[+-]?[0-9]+")
    return F.when(good & integer_key(x).sign.isin(*INTEGER_SIGNS[kind]), trim(x))


def last_day(month: Column, year: Column | None = None) -> Column:
    """The last day of a month; without a year, of a leap year's."""
    leap = F.lit(True) if year is None else (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_date(x: Column) -> Column:
    """Text of a date: year of four digits or more, none of them a needless zero, a day that its month has, a zone or none."""
    pattern = rf"\A{YEAR}-{MONTH}-{DAY}{ZONE}\z"
    part = lambda i: F.regexp_extract(trim(x), pattern, i)
    year = part(1).try_cast("bigint")
    return F.when(year.isNotNull() & (part(1) != "-0000") & (part(3).try_cast("int") <= last_day(part(2).try_cast("int"), year)), trim(x))


def parse_gregorian(x: Column, kind: str) -> Column:
    good = matches(trim(x), GREGORIAN[kind] + ZONE)
    if kind == "gMonthDay":
        part = lambda i: F.regexp_extract(trim(x), rf"\A{GREGORIAN[kind]}", i).try_cast("int")
        good = good & (part(2) <= last_day(part(1)))
    return F.when(good, trim(x))


def parse_binary(x: Column, encoding: str) -> Column:
    """Bytes of hexBinary or base64Binary text; white space between digits does not count."""
    packed = F.regexp_replace(x, r"[ \t\r\n]+", "")
    if encoding == "hexBinary":
        return F.when(matches(packed, "(?:[0-9A-Fa-f]{2})*"), F.try_to_binary(packed, F.lit("hex")))
    return F.when(matches(packed, "(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"), F.try_to_binary(packed, F.lit("base64")))


def format_binary(x: Column, encoding: str) -> Column:
    return F.hex(x) if encoding == "hexBinary" else F.base64(x)


def split_list(x: Column) -> Column:
    """Items of a lexical list."""
    return F.filter(F.split(F.translate(x, "\t\r\n", "   "), " "), lambda t: t != "")


def local_name(x: Column) -> Column:
    return F.regexp_replace(x, r"^(?:\{[^}]*\}|[^:]*:)", "")


def clark_name(uri: Column, local: Column) -> Column:
    return F.when(F.coalesce(uri, F.lit("")) == "", local).otherwise(F.concat(F.lit("{"), uri, F.lit("}"), local))


def infer(x: Column) -> Column:
    """JSON text of a schema-free scalar: true and false, 64-bit integers and finite floats as such, everything else as a string."""
    number = parse_float(x)
    finite = number.isNotNull() & ~F.isnan(number) & ~number.isin(float("inf"), float("-inf"))
    quoted = F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r"\A\{\"v\":|\}\z", "")
    return (
        F.when(trim(x) == "", F.lit('""')).when(trim(x).isin("true", "false"), trim(x)).when(parse_int(x).isNotNull(), parse_int(x).cast("string")).when(finite, number.cast("string")).otherwise(quoted)
    )


def escape_text(x: Column) -> Column:
    """XML character data: the characters that markup begins with become references."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return F.replace(x, F.lit("\r"), F.lit("&#13;"))


def escape_attribute(x: Column) -> Column:
    x = escape_text(x)
    for char, name in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x
