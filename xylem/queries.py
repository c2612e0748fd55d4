"""Registered queries. Each goes through XML or JSON text; its SQL computes the same from the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.operators import transcode
from xylem.operators.publish import publish
from xylem.operators.shred import shred, valid
from xylem.plans.schema import BOOL, FLOAT, INT, STRING, Builder, Record, Scalar
from xylem.sources import nodes as N
from xylem.sources import records as R
from xylem.xsd import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def element(tag: str, value: Column | str) -> Column:
    """Markup around a value, written by hand so that reading is tested against something other than our own writer."""
    inside = S.escape_text(value.cast("string")) if isinstance(value, Column) else F.lit(value)
    return F.concat(F.lit(f"<{tag}>"), inside, F.lit(f"</{tag.split()[0]}>"))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


# -- shredding

ITEM = Builder("Item").attribute("sku", INT).element("quantity", INT).element("price", INT).element("flag", STRING).build()
ORDER = Builder("Order").attribute("id", INT).attribute("status").element("placed").element("item", ITEM, many=True, xml_name="Item").build()


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order with its items, published from the tables."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("bigint").alias("quantity"), cents(F.col("l_extendedprice")).alias("price"), F.col("l_returnflag").alias("flag")).alias("item")
    )
    items = lines.groupBy("l_orderkey").agg(F.collect_list("item").alias("item"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    value = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), "item")
    return orders.select("o_orderkey", publish(ORDER, value).alias("doc"))


@query(
    """SELECT o_orderkey AS order_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS placed, count(*) AS n_items,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""
)
def shred_order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shred(order_documents(spark, sf_dir), "doc", ORDER).select("record.id", "record.status", "record.placed", F.explode("record.item").alias("i"))
    return rows.groupBy(F.col("id").alias("order_id"), "status", "placed").agg(F.count("*").alias("n_items"), F.sum("i.quantity").alias("quantity"), F.sum("i.price").alias("price_cents"))


CUSTOMER = Builder("customer").attribute("key", INT).attribute("name").attribute("nation", INT).attribute("balance", FLOAT).attribute("segment").build()


@query("SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def attr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return shred(table(spark, sf_dir, "customer").select(publish(CUSTOMER, value).alias("doc")), "doc", CUSTOMER).select("record.*")


PART = Builder("part", "urn:parts").element("key", INT).element("name").element("brand").element("kind", xml_name="type").element("size", INT).element("price", FLOAT).build()


@query("SELECT p_partkey AS key, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part")
def element_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price"))
    return shred(table(spark, sf_dir, "part").select(publish(PART, value).alias("doc")), "doc", PART).select("record.*")


@query("SELECT '<n0:part xmlns:n0=\"urn:parts\"><n0:key>' || p_partkey || '</n0:key><n0:name>' || p_name || '</n0:name><n0:brand>' || p_brand || '</n0:brand></n0:part>' AS doc FROM part")
def publish_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = PART.only("key", "name", "brand")
    value = F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return table(spark, sf_dir, "part").select(publish(record, value, prefixes={"urn:parts": "n0"}).alias("doc"))


BALANCE = Builder("v").attribute("unit").text("amount", FLOAT).build()


@query("SELECT s_suppkey AS key, 'usd' AS unit, s_acctbal AS amount FROM supplier")
def text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('<v unit="usd"> '), F.col("s_acctbal").cast("string"), F.lit("\n</v>")).alias("doc"))
    return shred(docs, "doc", BALANCE).select(F.col("s_suppkey").alias("key"), "record.unit", "record.amount")


@query("SELECT o_orderkey AS order_id, CAST(count(*) AS BIGINT) AS n_items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def list_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the list alone: unused fields are pruned from the schema that from_xml gets."""
    rows = shred(order_documents(spark, sf_dir), "doc", ORDER, columns=["id", "item"])
    return rows.select(F.col("record.id").alias("order_id"), F.size("record.item").cast("bigint").alias("n_items"))


PAIR = Builder("r").element("a", INT).element("b").build()


@query("SELECT c_custkey AS key, c_custkey + 1 AS a FROM customer")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(key, F.concat(F.lit("<r>"), element("a", key), element("b", "x"), element("a", key + 1), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", PAIR).select(F.col("c_custkey").alias("key"), "record.a")


@query("SELECT c_custkey AS key, c_custkey AS a, c_name AS b FROM customer")
def unknown_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = '<extra><a>0</a><deep x="1">t<b>no</b></deep></extra>'
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<r>" + extra), element("a", F.col("c_custkey")), F.lit(extra), element("b", F.col("c_name")), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", PAIR).select(F.col("c_custkey").alias("key"), "record.a", "record.b")


@query("SELECT c_custkey AS key, c_custkey AS a, c_name AS b FROM customer")
def prefix_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('<m:r xmlns:m="urn:m" xmlns:n="urn:n">'), element("m:a", F.col("c_custkey")), element("n:b", F.col("c_name")), F.lit("</m:r>")).alias("doc"))
    return shred(docs, "doc", PAIR).select(F.col("c_custkey").alias("key"), "record.a", "record.b")


@query(
    """SELECT c_custkey AS key, c_custkey % 3 = 0 AS nil, c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AS absent,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_name END AS b FROM customer"""
)
def nil_vs_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nil, absent and present are told apart by the node table: a missing node is absent, a nil one has the flag."""
    key = F.col("c_custkey")
    middle = F.when(key % 3 == 0, F.lit('<b xsi:nil="true">ignored</b>')).when(key % 5 == 0, F.lit("")).otherwise(element("b", F.col("c_name")))
    docs = table(spark, sf_dir, "customer").select(key, F.concat(F.lit(f'<r xmlns:xsi="{N.XSI}">'), middle, F.lit("</r>")).alias("doc"))
    rows = N.read_nodes(docs, "c_custkey", "doc")
    found = rows.filter("kind = 'element'").groupBy("c_custkey").agg(F.max(F.when(F.col("name") == "b", F.struct("nil", "text"))).alias("b"))
    return found.select(F.col("c_custkey").alias("key"), F.coalesce("b.nil", F.lit(False)).alias("nil"), F.col("b").isNull().alias("absent"), F.when(~F.col("b.nil"), F.col("b.text")).alias("b"))


NILLABLE = Builder("r").element("a", INT, nillable=True).build()


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS a FROM customer")
def nil_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(key, F.when(key % 3 == 0, F.lit(f'<r xmlns:xsi="{N.XSI}"><a xsi:nil="1">7</a></r>')).otherwise(F.concat(F.lit("<r>"), element("a", key), F.lit("</r>"))).alias("doc"))
    return shred(docs, "doc", NILLABLE).select(key.alias("key"), "record.a")


DEFAULTS = Builder("r").attribute("unit", default="kg").element("n", INT, default="7").element("s", STRING, default="none").build()


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'kg' ELSE 'lb' END AS unit FROM part")
def attr_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    docs = table(spark, sf_dir, "part").select(key, F.when(key % 4 == 0, "<r/>").otherwise('<r unit="lb"></r>').alias("doc"))
    return shred(docs, "doc", DEFAULTS).select(key.alias("key"), "record.unit")


@query("SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE p_brand END AS s FROM part")
def empty_element_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    inside = F.when(key % 3 == 0, F.lit("<n>1</n>")).when(key % 3 == 1, F.lit("<n>1</n><s></s>")).otherwise(F.concat(F.lit("<n>1</n>"), element("s", F.col("p_brand"))))
    docs = table(spark, sf_dir, "part").select(key, F.concat(F.lit("<r>"), inside, F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", DEFAULTS).select(key.alias("key"), "record.s")


@query(
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'well-formed document' END AS expected,
    CASE WHEN c_custkey % 5 NOT IN (1, 2, 3) THEN c_custkey END AS a, c_custkey % 5 NOT IN (1, 2, 3) AS kept FROM customer"""
)
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that end too early, close the wrong element or use an undefined entity are violations, and are dropped where asked."""
    key = F.col("c_custkey")
    good = F.concat(F.lit("<r>"), element("a", key), F.lit("</r>"))
    doc = F.when(key % 5 == 1, F.concat(F.lit("<r>"), element("a", key), F.lit("</r"))).when(key % 5 == 2, F.concat(F.lit("<r><a>"), key, F.lit("</b></r>"))).when(key % 5 == 3, F.lit("<r><a>&who;</a></r>")).otherwise(good)
    rows = shred(table(spark, sf_dir, "customer").select(key, doc.alias("doc")), "doc", PAIR)
    kept = valid(rows, "DROPMALFORMED").select(key.alias("kept_key"))
    joined = rows.join(kept, key == F.col("kept_key"), "left")
    return joined.select(key.alias("key"), F.get("errors", F.lit(0)).expected.alias("expected"), "record.a", F.col("kept_key").isNotNull().alias("kept"))


@query("SELECT p_partkey AS key, p_partkey * 10 + 2 AS a, p_name || ' <b>&' AS b FROM part")
def markup_in_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements inside a scalar are skipped and the text around them is joined; text that only looks like markup stays."""
    inside = F.concat(F.lit("<a>"), F.col("p_partkey").cast("string"), F.lit("<x y='1'>9<z/></x>2</a><b>"), S.escape_text(F.col("p_name")), F.lit("<i>no</i> &lt;b>&amp;</b>"))
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<r>"), inside, F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", PAIR).filter("size(errors) = 0").select(F.col("p_partkey").alias("key"), "record.a", "record.b")


@query("SELECT s_suppkey AS key, 'Dear ' || s_name || ', of ' AS said, CAST(s_nationkey AS VARCHAR) AS place FROM supplier")
def text_around_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = Builder("p").text("said").element("place").build()
    doc = F.concat(F.lit("<p>Dear "), S.escape_text(F.col("s_name")), element("place", F.col("s_nationkey")), F.lit(", of <unknown/></p>"))
    rows = shred(table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc")), "doc", record)
    return rows.select(F.col("s_suppkey").alias("key"), "record.said", "record.place")


@query("SELECT n_nationkey AS key, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'q' WHEN 2 THEN '{urn:x}r' ELSE 'r' END AS found FROM nation")
def strict_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of another name, of another namespace and of none are violations."""
    key = F.col("n_nationkey")
    doc = F.when(key % 4 == 0, "<?xml version='1.0'?><!-- > --><m:r a='>' xmlns:m = 'urn:m'/>").when(key % 4 == 1, "<q/>").when(key % 4 == 2, '<r xmlns="urn:x"/>').otherwise("<r/>")
    rows = shred(table(spark, sf_dir, "nation").select(key, doc.alias("doc")), "doc", Record("r", PAIR.fields, "urn:m"), strict_root=True)
    return rows.select(key.alias("key"), F.get("errors", F.lit(0)).value.alias("found"))


# -- validation


def _checked(df: DataFrame, key: str, value: Column, scalar: Scalar, **how) -> DataFrame:
    """key and whether the text of a value, written and read, is valid."""
    record = Builder("r").element("v", scalar, **how).build()
    docs = df.select(F.col(key).alias("key"), F.concat(F.lit("<r>"), element("v", value), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", record)


def _validity(df: DataFrame, key: str, value: Column, scalar: Scalar, **how) -> DataFrame:
    return _checked(df, key, value, scalar, **how).select("key", (F.size("errors") == 0).alias("valid"))


@query("SELECT c_custkey AS key, c_custkey % 10 = 5 AS valid FROM customer")
def fixed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validity(table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("00"), F.col("c_custkey") % 10), INT, fixed="5")


@query("SELECT c_custkey AS key, c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid FROM customer")
def enum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validity(table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit(" "), "c_mktsegment"), Scalar(enumeration=("BUILDING", "MACHINERY")))


@query("SELECT o_orderkey AS key, regexp_full_match(o_orderpriority, '[1-3]-[A-Z ]+') AS valid FROM orders")
def pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validity(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderpriority"), Scalar(patterns=("[1-3]-[A-Z ]+",)))


@query("SELECT o_orderkey AS key, FALSE AS valid FROM orders")
def pattern_that_is_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that is no regular expression matches nothing, and fails nothing."""
    return _validity(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderpriority"), Scalar(patterns=("[1-3",)))


@query("SELECT p_partkey AS key, p_size >= 10 AND p_size < 40 AS valid FROM part")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validity(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size"), Scalar("int", min_inclusive="10", max_exclusive="40"))


@query("SELECT p_partkey AS key, length(p_name) BETWEEN 3 AND 20 AS valid FROM part")
def length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validity(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), Scalar(min_length=3, max_length=20))


@query("SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'true' END AS v FROM part")
def union_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    value = F.when(key % 3 == 0, F.concat(F.lit(" "), "p_size")).when(key % 3 == 1, F.lit("true")).otherwise(F.lit("neither"))
    return _checked(table(spark, sf_dir, "part"), "p_partkey", value, Scalar("union", union=(INT, BOOL))).select("key", "record.v")


@query("SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def lexical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_quantity").cast("bigint").cast("string")), " \n ").alias("v"))
    rows = _checked(lists, "l_orderkey", F.col("v"), Scalar("list", item=INT))
    return rows.select("key", F.aggregate("record.v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("record.v").cast("bigint").alias("n"))


@query(
    """SELECT o_orderkey AS key, CAST('1000000000000000000000' || o_orderkey AS HUGEINT) * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END)
    < CAST('1000000000000000000000' || o_custkey AS HUGEINT) * (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END) AS less FROM orders"""
)
def big_integer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "+").otherwise("-"), F.lit("0001000000000000000000000"), F.col(c).cast("string"))
    record = Builder("r").element("a", Scalar("integer")).element("b", Scalar("integer")).build()
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<r>"), element("a", big("o_orderkey")), element("b", big("o_custkey")), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", record).select(F.col("o_orderkey").alias("key"), (S.integer_key(F.col("record.a")) < S.integer_key(F.col("record.b"))).alias("less"))


@query(
    """SELECT o_orderkey AS key, try_cast(strftime(o_orderdate, '%Y-') || CASE o_orderkey % 4 WHEN 0 THEN '02-30' WHEN 1 THEN '02-29'
    ELSE strftime(o_orderdate, '%m-%d') END AS DATE) IS NOT NULL AS valid FROM orders"""
)
def date_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 4 == 0, "02-30").when(F.col("o_orderkey") % 4 == 1, "02-29").otherwise(F.date_format("o_orderdate", "MM-dd"))
    zone = F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("+13:30")
    return _validity(table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-"), day, zone), Scalar("date"))


@query("SELECT o_orderkey AS key, o_orderkey % 32 BETWEEN 1 AND 31 AS day_valid, o_orderkey % 13 BETWEEN 1 AND 12 AS month_valid FROM orders")
def gregorian_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = Builder("r").element("d", Scalar("gDay")).element("m", Scalar("gMonth")).build()
    key = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(key, F.concat(F.lit("<r>"), element("d", F.concat(F.lit("---"), F.lpad((key % 32).cast("string"), 2, "0"))), element("m", F.concat(F.lit("--"), F.lpad((key % 13).cast("string"), 2, "0"), F.lit("-05:00"))), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", record).select(key.alias("key"), F.col("record.d").isNotNull().alias("day_valid"), F.col("record.m").isNotNull().alias("month_valid"))


@query(
    """SELECT o_orderkey AS key, o_orderkey % 3 <> 0 AS year_valid, o_orderkey % 14 BETWEEN 1 AND 12 AS year_month_valid,
    try_cast('2000-' || lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS month_day_valid FROM orders"""
)
def gregorian_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, months of years and days of months; 29 February is a day without a year."""
    key, two = F.col("o_orderkey"), lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    record = Builder("r").element("y", Scalar("gYear")).element("ym", Scalar("gYearMonth")).element("md", Scalar("gMonthDay")).build()
    year = F.when(key % 3 == 0, F.lit("012345")).when(key % 3 == 1, F.lit("-0044Z")).otherwise(F.lit("12024"))
    inside = [element("y", year), element("ym", F.concat(F.lit("1999-"), two(14), F.lit("+14:00"))), element("md", F.concat(F.lit("--"), two(13), F.lit("-"), two(33)))]
    rows = shred(table(spark, sf_dir, "orders").select(key, F.concat(F.lit("<r>"), *inside, F.lit("</r>")).alias("doc")), "doc", record)
    return rows.select(key.alias("key"), F.col("record.y").isNotNull().alias("year_valid"), F.col("record.ym").isNotNull().alias("year_month_valid"), F.col("record.md").isNotNull().alias("month_day_valid"))


@query("SELECT c_custkey AS key, c_name AS hex_text, c_name AS base64_text FROM customer")
def binary_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = Builder("r").element("h", Scalar("hexBinary")).element("b", Scalar("base64Binary")).build()
    value = F.struct(F.encode("c_name", "UTF-8").alias("h"), F.encode("c_name", "UTF-8").alias("b"))
    docs = table(spark, sf_dir, "customer").select("c_custkey", publish(record, value).alias("doc"))
    return shred(docs, "doc", record).select(F.col("c_custkey").alias("key"), F.decode("record.h", "UTF-8").alias("hex_text"), F.decode("record.b", "UTF-8").alias("base64_text"))


@query("SELECT CASE WHEN p_size < 20 THEN 'low' ELSE 'high' END AS what, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size < 20 OR p_size >= 45 GROUP BY 1")
def violations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are rows: two restricted fields of one document are counted apart."""
    low, high = Scalar("int", min_inclusive="20"), Scalar("int", max_exclusive="45")
    record = Builder("r").element("low", low).element("high", high).build()
    docs = table(spark, sf_dir, "part").select(F.concat(F.lit("<r>"), element("low", F.col("p_size")), element("high", F.col("p_size")), F.lit("</r>")).alias("doc"))
    return shred(docs, "doc", record).select(F.explode("errors").alias("e")).groupBy(F.col("e.field").alias("what")).agg(F.count("*").alias("n"))


# -- nodes


@query("SELECT doc_id, text FROM documents")
def escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, half of it as escaped text and half as CDATA sections, read back from the node table."""
    docs = table(spark, sf_dir, "documents")
    half = (F.length("text") / 2).cast("int")
    legal = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    first, second = F.substr(legal, F.lit(1), half), F.substr(legal, half + 1)
    cdata = F.concat(F.lit("<![CDATA["), F.replace(second, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    rows = N.read_nodes(docs.select("doc_id", F.concat(F.lit("<t>"), S.escape_text(first), cdata, F.lit("</t>")).alias("doc")), "doc_id", "doc")
    return rows.filter("parent is null").select("doc_id", "text")


@query("SELECT event_id, event_type, CASE WHEN event_type < 'm' THEN 'A' ELSE 'B' END AS type, round(value, 6) AS value FROM events")
def xsi_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived types in one wide struct; xsi:type says which fields count."""
    a, b = Builder("A").element("x", FLOAT).build(), Builder("B").element("y", FLOAT).build()
    record = Record("e", Builder("e").element("kind").build().fields, abstract=True, variants=(a, b))
    first = F.col("event_type") < "m"
    inside = F.concat(element("kind", F.col("event_type")), F.when(first, element("x", F.col("value"))).otherwise(element("y", F.col("value"))))
    docs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(f'<e xmlns:xsi="{N.XSI}" xmlns:t="urn:t" xsi:type="t:'), F.when(first, "A").otherwise("B"), F.lit('">'), inside, F.lit("</e>")).alias("doc"))
    rows = shred(docs, "doc", record).filter("size(errors) = 0")
    return rows.select("event_id", F.col("record.kind").alias("event_type"), F.col("record.xsi_type").alias("type"), F.round(F.when(F.col("record.xsi_type") == "A", F.col("record.x")).otherwise(F.col("record.y")), 6).alias("value"))


@query(
    """SELECT c_custkey AS key, i AS position, CASE i WHEN 0 THEN '#text' WHEN 1 THEN 'b' WHEN 2 THEN '#text' ELSE 'i' END AS kind,
    CASE i WHEN 0 THEN 'Dear ' WHEN 1 THEN c_name WHEN 2 THEN ', of ' ELSE c_mktsegment END AS value FROM customer, (VALUES (0), (1), (2), (3)) t(i)"""
)
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<p>Dear "), element("b", F.col("c_name")), F.lit(", of "), element("i", F.col("c_mktsegment")), F.lit("</p>")).alias("doc"))
    items = N.mixed_items(N.read_nodes(docs, "c_custkey", "doc"), "c_custkey").filter("parent = 0")
    return items.select(F.col("c_custkey").alias("key"), F.posexplode("items").alias("position", "item")).select("key", "position", "item.kind", "item.value")


@query("SELECT s_suppkey AS key, '{urn:x}extra' AS qname, s_name AS text, CAST(s_nationkey AS VARCHAR) AS n FROM supplier WHERE s_suppkey % 2 = 0")
def wildcard_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    extra = F.when(key % 2 == 0, F.concat(F.lit('<x:extra x:n="'), F.col("s_nationkey").cast("string"), F.lit('">'), S.escape_text(F.col("s_name")), F.lit("</x:extra>"))).otherwise(F.lit("<y:other/>"))
    docs = table(spark, sf_dir, "supplier").select(key, F.concat(F.lit('<r xmlns:x="urn:x" xmlns:y="urn:y">'), element("a", key), extra, F.lit("</r>")).alias("doc"))
    taken = N.wildcard(N.read_nodes(docs, "s_suppkey", "doc").filter("depth = 1"), ["a"], "urn:x")
    return taken.select(key.alias("key"), S.clark_name(F.col("uri"), F.col("name")).alias("qname"), "text", F.col("attributes")["x:n"].alias("n"))


@query("SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS other FROM supplier")
def any_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('<r xmlns:q="urn:q" id="1" q:name="'), S.escape_attribute(F.col("s_name")), F.lit('" other="'), F.col("s_nationkey").cast("string"), F.lit('"/>')).alias("doc"))
    kept = N.any_attributes(F.col("attributes"), ["id"])
    return N.read_nodes(docs, "s_suppkey", "doc").select(F.col("s_suppkey").alias("key"), kept["q:name"].alias("name"), kept["other"].alias("other"))


@query("SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 2 THEN 'a;b;' ELSE 'a;c;' END AS tokens FROM part WHERE p_partkey % 4 >= 2")
def content_model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a | b), then any number of (c, d), as compiled from a schema."""
    from xylem.xsd.compile import compile_text

    leaf = lambda name: f'<xs:element name="{name}"/>'
    model = f'<xs:sequence><xs:choice>{leaf("a")}{leaf("b")}</xs:choice><xs:sequence minOccurs="0" maxOccurs="unbounded">{leaf("c")}{leaf("d")}</xs:sequence></xs:sequence>'
    record = compile_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType>{model}</xs:complexType></xs:element></xs:schema>').record("r")
    key = F.col("p_partkey")
    inside = F.when(key % 4 == 0, "<a/>").when(key % 4 == 1, "<b/><c/><d/><c/><d/>").when(key % 4 == 2, "<a/><b/>").otherwise("<a/><c/>")
    nodes = N.read_nodes(table(spark, sf_dir, "part").select(key, F.concat(F.lit("<r>"), inside, F.lit("</r>")).alias("doc")), "p_partkey", "doc")
    return N.content_violations(nodes, "p_partkey", record).select(key.alias("key"), "tokens")


@query("SELECT n_nationkey AS key, CASE n_nationkey % 3 WHEN 0 THEN 'urn:outer' WHEN 1 THEN 'urn:inner' END AS uri FROM nation")
def namespace_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    inside = F.when(key % 3 == 0, "<p:v/>").when(key % 3 == 1, '<v xmlns="urn:inner"/>').otherwise('<g xmlns="urn:gone"><v xmlns=""/></g>')
    docs = table(spark, sf_dir, "nation").select(key, F.concat(F.lit('<r xmlns:p="urn:outer">'), inside, F.lit("</r>")).alias("doc"))
    return N.read_nodes(docs, "n_nationkey", "doc").filter("name = 'v'").select(key.alias("key"), F.nullif("uri", F.lit("")).alias("uri"))


@query("SELECT n_nationkey AS key, n_nationkey % 2 = 0 AS refused FROM nation")
def unsafe_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types, undefined entities and too many levels are errors, not text."""
    key = F.col("n_nationkey")
    bad = F.when(key % 4 == 0, '<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>').otherwise("<r>" + "<d>" * 300 + "</d>" * 300 + "</r>")
    docs = table(spark, sf_dir, "nation").select(key, F.when(key % 2 == 0, bad).otherwise("<r>fine &amp; well</r>").alias("doc"))
    return N.read_nodes(docs, "n_nationkey", "doc").filter("node = 0").select(key.alias("key"), (F.col("kind") == "error").alias("refused"))


@query("SELECT 'error' AS kind, CAST(count(*) AS BIGINT) AS n_pages FROM pages WHERE html ILIKE '%<!DOCTYPE%' HAVING count(*) > 0")
def html_is_not_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages have document types, which the reader refuses."""
    rows = N.read_nodes(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc")), "page_id", "doc", columns=["node", "kind"])
    return rows.filter("node = 0").groupBy("kind").agg(F.count("*").alias("n_pages"))


# -- records

EVENT = Builder("event").attribute("id", INT).element("type").element("value", FLOAT).build()


@query("SELECT event_id AS id, event_type AS type, round(value, 6) AS value, user_id FROM events")
def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit('<event id="'), F.col("event_id").cast("string"), F.lit('">'), element("type", F.col("event_type")), element("value", F.col("value")), F.lit("</event>"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("<log>"), F.array_join(F.collect_list(one), "\n"), F.lit("</log>")).alias("doc"))
    return R.split_records(docs, "doc", EVENT).select("record.id", "record.type", F.round("record.value", 6).alias("value"), "user_id")


@query("SELECT event_id AS id, event_type AS type, user_id FROM events")
def record_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from nodes, for records at any depth and namespaces from outside of the record."""
    one = F.concat(F.lit("<l:event><id>"), F.col("event_id").cast("string"), F.lit("</id>"), element("type", F.col("event_type")), F.lit("</l:event>"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('<log xmlns:l="urn:l"><part>'), F.array_join(F.collect_list(one), ""), F.lit("</part></log>")).alias("doc"))
    rows = N.subtrees(N.read_nodes(docs, "user_id", "doc"), "user_id", "l:event")
    value = lambda name: F.max(F.when((F.col("name") == name) & (F.col("kind") == "element"), F.col("text")))
    return rows.groupBy("user_id", "record").agg(value("id").cast("bigint").alias("id"), value("type").alias("type")).select("id", "type", "user_id")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents WHERE octet_length(encode(text)) + 7 <= 1000")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<t>"), "text", F.lit("</t>")).alias("doc"))
    return R.within_bytes(docs, "doc", 1000).select("doc_id", (F.octet_length("doc") - 7).cast("bigint").alias("n_bytes"))


# -- transcoding


@query("""SELECT '{"key":' || p_partkey || ',"name":"' || p_name || '","brand":"' || p_brand || '","type":"' || p_type || '","size":' || CAST(p_size AS BIGINT) || '}' AS json FROM part""")
def xml_to_json_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = PART.only("key", "name", "brand", "kind", "size")
    inside = [element("n:key", F.col("p_partkey")), element("n:name", F.col("p_name")), element("brand", F.col("p_brand")), element("n:type", F.col("p_type")), element("n:size", F.col("p_size").cast("bigint"))]
    docs = table(spark, sf_dir, "part").select(F.concat(F.lit('<n:part xmlns:n="urn:parts">'), *inside, F.lit("<more>1</more></n:part>")).alias("doc"))
    return transcode.xml_to_json(docs, "doc", record).select("json")


@query("SELECT '<part><key>' || p_partkey || '</key><name>' || p_name || '</name><brand>' || p_brand || '</brand></part>' AS doc FROM part")
def json_to_xml_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = Record("part", PART.only("key", "name", "brand").fields)
    docs = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"))).alias("json"))
    return transcode.json_to_xml(docs, "json", record, "doc").select("doc")


@query(
    """SELECT event_id, '{"e":{"@id":' || event_id || ',"t":["' || event_type || '","x"],"u":' || user_id || ',"none":[null,""],"flag":true}}' AS json FROM events"""
)
def xml_to_json_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('<p:e xmlns:p="urn:p" id="'), F.col("event_id").cast("string"), F.lit('">'), element("t", F.col("event_type")), element("u", F.col("user_id")), F.lit("<none/><t>x</t><none ></none><flag>true</flag></p:e>"))
    return transcode.xml_to_json_dynamic(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "doc").select("event_id", "json")


@query("""SELECT event_id, '<e id="' || event_id || '">' || coalesce('<k>' || CAST(props->>'$.k' AS VARCHAR) || '</k>', '<k/>') || '<t>' || event_type || '</t><t>1</t></e>' AS xml FROM events""")
def json_to_xml_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"e":{"@id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(',"t":["'), "event_type", F.lit('",1]}}'))
    return transcode.json_to_xml_dynamic(events.select("event_id", doc.alias("doc")), "doc").select("event_id", "xml")


@query("SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS n, p_size % 2 = 0 AS b, CAST(p_size AS VARCHAR) AS s, CAST(1 AS BIGINT) AS items FROM part")
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fraction for an integer, a quoted boolean in capitals, a number for a string, one value for a list, a name for an alias."""
    record = Builder("r").element("n", INT, xml_name="Count").element("b", BOOL).element("s").element("many", INT, many=True).build()
    size = F.col("p_size")
    doc = F.concat(F.lit('{"n":'), size.cast("string"), F.lit('.75,"b":"'), F.when(size % 2 == 0, "TRUE").otherwise("False"), F.lit('","s":'), size.cast("string"), F.lit(',"many":3}'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), transcode.from_json(record, doc).alias("r"))
    return rows.select("key", "r.n", "r.b", "r.s", F.size("r.many").cast("bigint").alias("items"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '\"' || event_type || '\"' ELSE '\"\"' END AS json FROM events")
def infer_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    text = F.when(key % 4 == 0, " true ").when(key % 4 == 1, F.concat(F.lit("00"), key)).when(key % 4 == 2, F.col("event_type")).otherwise("  ")
    return table(spark, sf_dir, "events").select("event_id", S.infer(text).alias("json"))


# -- schema graphs


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier and customer -> nation -> region, as edges between names."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return nation.union(supplier)


_EDGE_SQL = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


@query(f"WITH RECURSIVE e AS ({_EDGE_SQL}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({_EDGE_SQL}), c AS (SELECT dst AS node FROM e WHERE src = 's1' UNION SELECT e.dst FROM c JOIN e ON c.node = e.src) SELECT node FROM c UNION SELECT 's1'")
def root_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), spark.range(1).select(F.lit("s1").alias("node")))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey // 5) * 5 + (n_nationkey + 1) % 5 AS dst FROM nation
    UNION ALL SELECT 100 + n_regionkey, n_nationkey FROM nation),
    c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
    SELECT CAST(n AS BIGINT) AS node, CAST(least(n, coalesce((SELECT min(a.dst) FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src = n), n)) AS BIGINT) AS component
    FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)"""
)
def schema_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components: rings of five nations, and regions that point into them."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    ring = nation.select(key.alias("src"), ((key / 5).cast("bigint") * 5 + (key + 1) % 5).alias("dst"))
    return graph.cycles(ring.union(nation.select((F.col("n_regionkey") + 100).cast("bigint").alias("src"), key.alias("dst"))))


@query(
    """WITH o AS (SELECT node, row_number() OVER (ORDER BY level, node) - 1 AS i FROM (SELECT 'r' || r_regionkey AS node, 0 AS level FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier)),
    e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
    SELECT DISTINCT CAST(a.i // 10 AS BIGINT) AS chunk, CAST(b.i // 10 AS BIGINT) AS needs FROM e JOIN o a ON e.src = a.node JOIN o b ON e.dst = b.node WHERE a.i // 10 <> b.i // 10"""
)
def chunk_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten types in the order of their needs, and which chunks need which."""
    edges = _edges(spark, sf_dir)
    return graph.chunk_needs(edges, graph.chunks(edges, 10))


@query(
    """SELECT o_orderkey AS id, o_orderstatus AS phase, strftime(o_orderdate, '%Y-%m-%d') AS begun, CAST(count(*) AS BIGINT) AS n_legs,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS miles, CAST(sum(CAST(l_linenumber AS BIGINT)) AS DOUBLE) AS load, CAST(count(*) AS INTEGER) AS n_errors
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""
)
def xsd_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a compiled schema: union, pattern, enumeration, list, and simple content five levels down. Each berth breaks its
    pattern."""
    from xylem.xsd.compile import compile_text
    from xylem.xsd.fixtures import VOYAGES

    record = compile_text(VOYAGES).record("Voyage")
    load = F.concat(F.lit('</Miles><Hold deck="1"><Load unit="kg">'), F.col("l_linenumber").cast("string"), F.lit("</Load></Hold><Draughts>1 2.5</Draughts></Leg>"))
    leg = F.concat(F.lit('<Leg berth="'), F.col("l_partkey").cast("string"), F.lit('"><Miles>'), F.col("l_quantity").cast("bigint").cast("string"), load)
    legs = table(spark, sf_dir, "lineitem").select("l_orderkey", leg.alias("leg")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("leg"), "").alias("legs"))
    head = F.concat(F.lit('<v:Voyage xmlns:v="urn:voyages" number="'), F.col("o_orderkey").cast("string"), F.lit('" phase="'), "o_orderstatus", F.lit('">'), element("v:Begun", F.date_format("o_orderdate", "yyyy-MM-dd")))
    docs = table(spark, sf_dir, "orders").join(legs, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(head, F.lit("<Route>"), "legs", F.lit('</Route><Ship hull="9"/><Sail>true</Sail></v:Voyage>')).alias("doc"))
    rows = shred(docs, "doc", record)
    total = lambda of, start: F.aggregate("record.Route.Leg", start, of)
    return rows.select(
        F.col("record.number").alias("id"),
        "record.phase",
        F.col("record.Begun").alias("begun"),
        F.size("record.Route.Leg").cast("bigint").alias("n_legs"),
        total(lambda a, leg: a + leg.Miles, F.lit(0).cast("bigint")).alias("miles"),
        total(lambda a, leg: a + leg.Hold.Load[0].value, F.lit(0.0)).alias("load"),
        F.size("errors").alias("n_errors"),
    )


_DEEP = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r">' + "".join(f'<xs:complexType><xs:sequence><xs:element name="l{i}"' + (">" if i < 7 else ' type="xs:string"/>') for i in range(1, 8)) + "</xs:sequence></xs:complexType></xs:element>" * 7 + "</xs:schema>"


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def deep_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled schema of seven nested elements, none of which recurs."""
    from xylem.xsd.compile import compile_text

    tags = [f"l{i}" for i in range(1, 8)]
    doc = F.concat(F.lit("<r>" + "".join(f"<{t}>" for t in tags[:-1])), element("l7", F.col("c_name")), F.lit("".join(f"</{t}>" for t in tags[-2::-1]) + "</r>"))
    rows = shred(table(spark, sf_dir, "customer").select("c_custkey", doc.alias("doc")), "doc", compile_text(_DEEP).record("r"))
    return rows.filter("size(errors) = 0").select(F.col("c_custkey").alias("key"), F.col("record." + ".".join(tags)).alias("value"))


@query("SELECT CAST(i AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n FROM customer, (VALUES (1), (2), (3)) t(i) WHERE c_custkey % 3 + 1 >= i GROUP BY 1")
def recursive_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type below itself, to three levels; documents have one to three."""
    from xylem.xsd.compile import compile_text

    schema = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="N"><xs:sequence><xs:element name="kid" type="N" minOccurs="0"/></xs:sequence><xs:attribute name="id" type="xs:int"/></xs:complexType><xs:element name="r" type="N"/></xs:schema>'
    key = F.col("c_custkey")
    doc = F.when(key % 3 == 0, '<r id="1"/>').when(key % 3 == 1, '<r id="1"><kid id="2"/></r>').otherwise('<r id="1"><kid id="2"><kid id="3"/></kid></r>')
    rows = shred(table(spark, sf_dir, "customer").select(doc.alias("doc")), "doc", compile_text(schema).record("r", depth=3))
    levels = F.array_compact(F.array("record.id", "record.kid.id", "record.kid.kid.id"))
    return rows.select(F.explode(F.transform(levels, lambda n: n.cast("int"))).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT r_name AS head, n_name AS member FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name <> r_name
    UNION SELECT 'world', r_name FROM region), c AS (SELECT head, member FROM e UNION SELECT c.head, e.member FROM c JOIN e ON c.member = e.head) SELECT head, member FROM c"""
)
def substitution_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may stand for whom, in a schema made of the tables: nations for their region, and regions for the world."""
    from xylem.xsd.compile import compile_text

    regions = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").collect()}
    pairs = [(regions[r.n_regionkey], r.n_name) for r in table(spark, sf_dir, "nation").collect()] + [("world", r) for r in regions.values()]
    named = lambda n: n.replace(" ", "-")
    body = "".join(f'<xs:element name="{named(member)}" substitutionGroup="{named(head)}"/>' for head, member in pairs)
    schema = compile_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="world"/>{body}</xs:schema>')
    edges = [(node.get("substitutionGroup"), node.get("name")) for node, _ in schema.elements.values() if node.get("substitutionGroup")]
    found = graph.closure(spark.createDataFrame(edges, "src string, dst string"))
    return found.select(F.replace("src", F.lit("-"), F.lit(" ")).alias("head"), F.replace("dst", F.lit("-"), F.lit(" ")).alias("member"))


@query("SELECT 'simple' AS kind, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'complex', CAST(count(*) AS BIGINT) FROM nation UNION ALL SELECT 'simple content', 1")
def schema_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema with a simple type for each region, a complex type for each nation and one type with simple content."""
    from xylem.xsd.compile import compile_text

    simple = "".join(f'<xs:simpleType name="R{r.r_regionkey}"><xs:restriction base="xs:token"><xs:maxLength value="{len(r.r_name)}"/></xs:restriction></xs:simpleType>' for r in table(spark, sf_dir, "region").collect())
    types = "".join(f'<xs:complexType name="N{r.n_nationkey}"><xs:sequence><xs:element name="part" type="R{r.n_regionkey}"/></xs:sequence></xs:complexType>' for r in table(spark, sf_dir, "nation").collect())
    content = '<xs:complexType name="S"><xs:simpleContent><xs:extension base="xs:int"/></xs:simpleContent></xs:complexType>'
    schema = compile_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{simple}{types}{content}</xs:schema>')
    return graph.catalog(spark, schema)["types"].groupBy("kind").agg(F.count("*").alias("n"))
