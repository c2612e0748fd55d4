"""Registered queries over compiled schemas, files, writing and JSON; see xylem.queries."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.operators import transcode
from xylem.operators.publish import content_unwritable, publish, publish_mixed, unwritable
from xylem.operators.shred import shred
from xylem.plans.schema import FLOAT, INT, STRING, Builder, Record, Scalar
from xylem.queries import DEFAULTS, element, query, table
from xylem.sources import nodes as N
from xylem.sources import records as R
from xylem.sources.shared import shared_dir
from xylem.xsd.compile import Schema, SchemaError, compile_file, compile_text

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def _schema(body: str) -> Schema:
    return compile_text(f"<xs:schema {XS}>{body}</xs:schema>")


def _documents(spark: SparkSession, sf_dir: str, name: str, key: str, *parts: Column | str) -> DataFrame:
    """key and doc, the parts one after the other, of each row of a table."""
    return table(spark, sf_dir, name).select(F.col(key).alias("key"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("doc"))


# -- sources


@query("SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' WHEN 2 THEN 'json' END AS format FROM customer")
def format_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    doc = F.when(key % 4 == 0, F.concat(F.lit("﻿ \n<a>"), key, F.lit("</a>"))).when(key % 4 == 1, F.concat(F.lit("\t[ "), key, F.lit("]"))).when(key % 4 == 2, F.lit('{"a":"<"}')).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(key.alias("key"), R.detect_format(doc).alias("format"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/xylem-{uuid.uuid4().hex[:12]}"


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document, with line breaks inside."""
    path, record = _folder(spark), Builder("n").attribute("key", INT).element("name").build()
    docs = _documents(spark, sf_dir, "nation", "n_nationkey", '<n\n key="', F.col("n_nationkey").cast("string"), '">\n', element("name", F.col("n_name")), "\n</n>")
    docs.select("doc").write.option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    return shred(R.read_documents(spark, path), "document", record).select("record.key", "record.name")


_ROW = Builder("row").attribute("id", INT).element("kind").element("amount", FLOAT).build()
_EVENT_SQL = "SELECT event_id AS id, event_type AS kind, round(value, 6) AS amount FROM events"


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark)
    R.write_records(table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.col("event_type").alias("kind"), F.col("value").alias("amount")), path, "rows", "row")
    return path


@query(_EVENT_SQL)
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records, written a row at a time by each task, and split at records when they are read."""
    return R.read_records(spark, _event_files(spark, sf_dir), _ROW).select("record.id", "record.kind", F.round("record.amount", 6).alias("amount"))


@query(_EVENT_SQL)
def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, all that is there at once."""
    out = _folder(spark)
    rows = R.stream_records(spark, _event_files(spark, sf_dir), _ROW).select("record.id", "record.kind", F.round("record.amount", 6).alias("amount"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("SELECT n_nationkey AS key, n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'last' FROM nation")
def records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record inside a record of its tag is part of it, not one of its own."""
    docs = _documents(spark, sf_dir, "nation", "n_nationkey", "<l><r>", element("r", F.col("n_name")), "</r><x><r>last</r></x></l>")
    rows = N.subtrees(N.read_nodes(docs, "key", "doc"), "key", "r").filter("kind = 'text'")
    return rows.select("key", "text")


@query("SELECT c_custkey AS key, c_custkey AS a FROM customer")
def after_the_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the root is not looked at, well formed or not."""
    docs = _documents(spark, sf_dir, "customer", "c_custkey", "<r>", element("a", F.col("c_custkey")), "</r> <a>0</a><b")
    rows = N.read_nodes(docs, "key", "doc", columns=["name", "text", "depth"])
    return rows.filter("name = 'a' and depth = 1").select("key", F.col("text").cast("bigint").alias("a"))


@query("SELECT c_custkey AS key, TRUE AS there, 'kg' AS unit, CAST(NULL AS BIGINT) AS n FROM customer")
def empty_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty root is a record, with the defaults of attributes and without elements."""
    rows = shred(_documents(spark, sf_dir, "customer", "c_custkey", "<r/>"), "doc", DEFAULTS)
    return rows.select("key", F.col("record").isNotNull().alias("there"), "record.unit", "record.n")


@query("SELECT c_custkey AS key, c_custkey % 3 = 1 AS valid FROM customer")
def abstract_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abstract type needs an xsi:type that names one of its variants."""
    record = Record("base", Builder("base").element("x").build().fields, abstract=True, variants=(Builder("Derived").element("y", INT).build(),))
    kind = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, ' xsi:type="t:Derived"').otherwise(' xsi:type="Other"')
    docs = _documents(spark, sf_dir, "customer", "c_custkey", f'<base xmlns:xsi="{N.XSI}" xmlns:t="urn:t"', kind, "><x>a</x></base>")
    return shred(docs, "doc", record).select("key", (F.size("errors") == 0).alias("valid"))


# -- compiled schemas


def _shredded(spark: SparkSession, sf_dir: str, body: str, *parts: Column | str, root: str = "r") -> DataFrame:
    return shred(_documents(spark, sf_dir, "customer", "c_custkey", *parts), "doc", _schema(body).record(root))


@query("SELECT c_custkey AS key, c_custkey % 20 <= 9 AS valid, c_name AS u FROM customer")
def content_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple content that restricts simple content keeps its attributes."""
    body = """<xs:complexType name="A"><xs:simpleContent><xs:extension base="xs:int"><xs:attribute name="u"/></xs:extension></xs:simpleContent></xs:complexType>
    <xs:complexType name="C"><xs:simpleContent><xs:restriction base="A"><xs:maxInclusive value="9"/></xs:restriction></xs:simpleContent></xs:complexType><xs:element name="r" type="C"/>"""
    rows = _shredded(spark, sf_dir, body, '<r u="', S.escape_attribute(F.col("c_name")), '">', (F.col("c_custkey") % 20).cast("string"), "</r>")
    return rows.select("key", (F.size("errors") == 0).alias("valid"), "record.u")


@query("SELECT c_custkey AS key, c_custkey % 3 = 2 AS valid FROM customer")
def pattern_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of one step are alternatives; those of two steps must both match."""
    body = """<xs:simpleType name="A"><xs:restriction base="xs:string"><xs:pattern value="[a-z]+[0-9]"/><xs:pattern value="[0-9]+"/></xs:restriction></xs:simpleType>
    <xs:simpleType name="B"><xs:restriction base="A"><xs:pattern value="x.*"/></xs:restriction></xs:simpleType><xs:element name="r"><xs:complexType><xs:attribute name="v" type="B"/></xs:complexType></xs:element>"""
    value = F.when(F.col("c_custkey") % 3 == 0, "17").when(F.col("c_custkey") % 3 == 1, "y7").otherwise("xy7")
    return _shredded(spark, sf_dir, body, '<r v="', value, '"/>').select("key", (F.size("errors") == 0).alias("valid"))


@query("SELECT c_custkey AS key, CAST(NULL AS VARCHAR) AS x, c_name AS kept, c_custkey AS ref FROM customer")
def restricted_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restriction restates its elements, leaves out a prohibited attribute, inherits another and refers to a global one."""
    body = """<xs:attribute name="ref" type="xs:int"/><xs:group name="g"><xs:sequence><xs:element name="x" type="xs:string" minOccurs="0" maxOccurs="2"/></xs:sequence></xs:group>
    <xs:complexType name="B"><xs:sequence><xs:group ref="g"/></xs:sequence><xs:attribute name="old"/><xs:attribute name="kept" use="required"/></xs:complexType>
    <xs:complexType name="R"><xs:complexContent><xs:restriction base="B"><xs:sequence><xs:element name="x" type="xs:string" minOccurs="0"/></xs:sequence><xs:attribute name="old" use="prohibited"/><xs:attribute ref="ref"/></xs:restriction></xs:complexContent></xs:complexType>
    <xs:element name="r" type="R"/>"""
    rows = _shredded(spark, sf_dir, body, '<r old="1" kept="', S.escape_attribute(F.col("c_name")), '" ref="', F.col("c_custkey").cast("string"), '"/>')
    assert "old" not in rows.schema["record"].dataType.fieldNames()
    return rows.select("key", "record.x", "record.kept", F.col("record.ref").alias("ref"))


@query("SELECT c_custkey AS key, c_name AS one, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS two FROM customer")
def substitutes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference to an abstract head takes the members of its group."""
    body = """<xs:element name="head" abstract="true" type="xs:string"/><xs:element name="one" substitutionGroup="head"/><xs:element name="two" type="xs:int" substitutionGroup="one"/>
    <xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="head" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>"""
    two = F.when(F.col("c_custkey") % 2 == 0, element("two", F.col("c_custkey"))).otherwise("")
    rows = _shredded(spark, sf_dir, body, "<r>", two, element("one", F.col("c_name")), "</r>")
    return rows.select("key", F.get("record.one", F.lit(0)).alias("one"), F.get("record.two", F.lit(0)).alias("two"))


@query("SELECT c_custkey AS key, c_custkey % 2 = 0 AS valid FROM customer")
def gregorian_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("gDay", "gMonth", "gMonthDay", "gYear", "gYearMonth")
    body = '<xs:element name="r"><xs:complexType>' + "".join(f'<xs:attribute name="{k}" type="xs:{k}"/>' for k in kinds) + "</xs:complexType></xs:element>"
    good = '<r gDay="---31" gMonth="--12Z" gMonthDay="--02-29" gYear="-0044" gYearMonth="2024-02+01:00"/>'
    doc = F.when(F.col("c_custkey") % 2 == 0, good).when(F.col("c_custkey") % 4 == 1, good.replace("02-29", "02-30")).otherwise(good.replace("-0044", "044"))
    return _shredded(spark, sf_dir, body, doc).select("key", (F.size("errors") == 0).alias("valid"))


_LEAVES = {name: f'<xs:element name="{name}" type="xs:string"/>' for name in "abc"}


@query("SELECT c_custkey AS key, c_name || CASE WHEN c_custkey % 2 = 0 THEN ',second' ELSE '' END AS a, CASE WHEN c_custkey % 2 = 1 THEN 'b' END AS b FROM customer")
def choice_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element in two branches of a choice is one field, a list where a branch has it twice."""
    twice = _LEAVES["a"].replace("/>", ' maxOccurs="2"/>')
    body = f'<xs:element name="r"><xs:complexType><xs:choice><xs:sequence>{_LEAVES["a"]}{_LEAVES["b"]}</xs:sequence><xs:sequence>{_LEAVES["c"]}{twice}</xs:sequence></xs:choice></xs:complexType></xs:element>'
    first = element("a", F.col("c_name"))
    inside = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<c/>"), first, F.lit("<a>second</a>"))).otherwise(F.concat(first, F.lit("<b>b</b>")))
    return _shredded(spark, sf_dir, body, "<r>", inside, "</r>").select("key", F.array_join("record.a", ",").alias("a"), "record.b")


@query("SELECT c_custkey AS key, i AS position, CASE i WHEN 1 THEN 'b' ELSE 'a' END AS kind, CASE i WHEN 0 THEN 'one' WHEN 1 THEN c_name ELSE 'two' END AS value FROM customer, (VALUES (0), (1), (2)) t(i)")
def items_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice that repeats is read as one stream of items, in the order of the document."""
    record = _schema(f'<xs:element name="r"><xs:complexType><xs:choice maxOccurs="unbounded">{_LEAVES["a"]}{_LEAVES["b"]}</xs:choice></xs:complexType></xs:element>').record("r")
    docs = _documents(spark, sf_dir, "customer", "c_custkey", "<r><a>one</a>", element("b", F.col("c_name")), "<a>two</a></r>")
    items = N.ordered_items(N.read_nodes(docs, "key", "doc"), "key", record)
    return items.select("key", F.posexplode("items").alias("position", "item")).select("key", "position", "item.kind", "item.value")


@query("SELECT p_partkey AS key FROM part WHERE p_partkey % 4 >= 2")
def all_group_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an all group each child stands once, in any order; optional ones may be missing."""
    optional = _LEAVES["b"].replace("/>", ' minOccurs="0"/>')
    record = _schema(f'<xs:element name="r"><xs:complexType><xs:all>{_LEAVES["a"]}{optional}{_LEAVES["c"]}</xs:all></xs:complexType></xs:element>').record("r")
    key = F.col("p_partkey")
    inside = F.when(key % 4 == 0, "<c/><b/><a/>").when(key % 4 == 1, "<a/><c/>").when(key % 4 == 2, "<a/><c/><a/>").otherwise("<b/><a/>")
    docs = _documents(spark, sf_dir, "part", "p_partkey", "<r>", inside, "</r>")
    return N.content_violations(N.read_nodes(docs, "key", "doc"), "key", record).select("key")


@query("SELECT n_nationkey AS key, n_nationkey % 3 = 0 AS compiles FROM nation")
def schemas_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each nation: a name that nothing defines, and one that is ambiguous, are refused."""
    found = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey").collect():
        kind = ("xs:int", "Missing", "xs:int")[r.n_nationkey % 3]
        field = f'<xs:element name="n" type="{kind}" minOccurs="0"/>'
        try:
            _schema(f'<xs:element name="r"><xs:complexType><xs:sequence>{field * (1 + (r.n_nationkey % 3 == 2))}</xs:sequence></xs:complexType></xs:element>')
            found.append((r.n_nationkey, True))
        except SchemaError:
            found.append((r.n_nationkey, False))
    return spark.createDataFrame(found, "key int, compiles boolean")


@query("SELECT c_custkey AS key, c_custkey AS a, c_custkey % 2 = 0 AS e FROM customer")
def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that includes one without a namespace, which includes it again, and imports another namespace."""
    files = {
        "main.xsd": 'targetNamespace="urn:m" xmlns="urn:m" xmlns:o="urn:o"><xs:include schemaLocation="part.xsd"/><xs:import namespace="urn:o" schemaLocation="other.xsd"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="P"/><xs:element ref="o:e"/></xs:sequence></xs:complexType></xs:element>',
        "part.xsd": '><xs:include schemaLocation="main.xsd"/><xs:simpleType name="P"><xs:restriction base="xs:int"/></xs:simpleType>',
        "other.xsd": 'targetNamespace="urn:o"><xs:element name="e" type="xs:boolean"/>',
    }
    with tempfile.TemporaryDirectory() as folder:
        for name, body in files.items():
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(f"<xs:schema {XS} {body}</xs:schema>")
        record = compile_file(os.path.join(folder, "main.xsd")).record("r")
    docs = _documents(spark, sf_dir, "customer", "c_custkey", '<m:r xmlns:m="urn:m" xmlns:o="urn:o">', element("m:a", F.col("c_custkey")), element("o:e", (F.col("c_custkey") % 2 == 0)), "</m:r>")
    return shred(docs, "doc", record, strict_root=True).filter("size(errors) = 0").select("key", "record.a", "record.e")


# -- writing

_WRITTEN = Record("w", (*Builder("w").element("last").text("said").attribute("z", INT).element("list", INT, many=True).attribute("a").build().fields,))


@query("""SELECT c_custkey AS key, '<w z="' || c_custkey || '">' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '<last>x</last>' ELSE '' END || '<list>1</list><list>2</list></w>' AS doc FROM customer""")
def parts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, then text, then elements; nulls are left out and lists repeat their element."""
    value = F.struct(F.when(F.col("c_custkey") % 2 == 0, "x").alias("last"), F.col("c_name").alias("said"), F.col("c_custkey").alias("z"), F.array(F.lit(1), F.lit(2)).alias("list"), F.lit(None).cast("string").alias("a"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), publish(_WRITTEN, value).alias("doc"))


@query("""SELECT p_partkey AS key, '<box xmlns="urn:b" xmlns:ns0="urn:i"><ns0:item id="' || p_partkey || '"/></box>' AS doc FROM part""")
def default_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One namespace without a prefix, as the caller has it, and one with the next free prefix."""
    record = Builder("box", "urn:b").element("item", Builder("item", "urn:i").attribute("id", INT).build()).build()
    value = F.struct(F.struct(F.col("p_partkey").alias("id")).alias("item"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), publish(record, value, prefixes={"urn:b": ""}).alias("doc"))


_BASE = Record("base", Builder("base").element("x", INT).build().fields, variants=(Builder("Big").element("y", INT).build(),))


@query(
    f"""SELECT c_custkey AS key, '<base xmlns:xsi="{N.XSI}"' || CASE WHEN c_custkey % 2 = 0 THEN ' xsi:type="Big"' ELSE '' END || '><x>' || c_custkey || '</x>' ||
    CASE WHEN c_custkey % 2 = 0 THEN '<y>1</y>' ELSE '' END || '</base>' AS doc FROM customer"""
)
def variants_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that names a variant becomes XML with its xsi:type."""
    key = F.col("c_custkey")
    doc = F.concat(F.when(key % 2 == 0, '{"@xsi:type":"Big","y":1,"x":').otherwise('{"x":'), key.cast("string"), F.lit("}"))
    return transcode.json_to_xml(table(spark, sf_dir, "customer").select(key.alias("key"), doc.alias("json")), "json", _BASE, "doc").select("key", "doc")


@query("SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'n' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'l' ELSE '' END AS fields FROM part")
def values_unwritable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside of their facets, and items of lists with blanks in them, are told before they are written."""
    record = Builder("r").element("n", Scalar("int", max_inclusive="25")).element("l", Scalar("list", item=STRING)).build()
    value = F.struct(F.col("p_size").cast("bigint").alias("n"), F.array(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "b c").otherwise("b")).alias("l"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array_join(unwritable(record, value), "").alias("fields"))


@query("SELECT c_custkey AS key, '<p>Dear <b>' || c_name || '</b>, of &lt;' || c_mktsegment || '&gt;</p>' AS doc FROM customer")
def mixed_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed content read as items in order, and written from them."""
    docs = _documents(spark, sf_dir, "customer", "c_custkey", "<p>Dear ", element("b", F.col("c_name")), ", of <![CDATA[<]]>", S.escape_text(F.col("c_mktsegment")), "></p>")
    items = N.mixed_items(N.read_nodes(docs, "key", "doc"), "key").filter("parent = 0")
    return items.select("key", publish_mixed("p", F.col("items")).alias("doc"))


@query("""SELECT s_suppkey AS key, '<x:extra xmlns:x="urn:x" xmlns:y="urn:y" n="' || s_nationkey || '">' || s_name || ' &amp; <y:in y:a="&lt;"/><x:none></x:none></x:extra>' AS xml FROM supplier""")
def wildcard_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wildcard took, at any depth, written again with the namespaces that it needs."""
    extra = F.concat(F.lit('<x:extra n="'), F.col("s_nationkey").cast("string"), F.lit('">'), S.escape_text(F.col("s_name")), F.lit(' &amp; <y:in y:a="&lt;"/><x:none></x:none></x:extra>'))
    docs = _documents(spark, sf_dir, "supplier", "s_suppkey", '<r xmlns:x="urn:x" xmlns:y="urn:y" xmlns:z="urn:z"><a>1</a>', extra, "<z:b/></r>")
    return N.markup(N.subtrees(N.read_nodes(docs, "key", "doc", columns=[*N.NAMES, "uses"]), "key", "x:extra"), "key", "record").select("key", "xml")


@query("""SELECT s_suppkey AS key, s_name AS name, '<r id="1" other="' || s_nationkey || '" q:name="' || s_name || '"/>' AS doc FROM supplier""")
def any_attribute_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that no field has, shredded into a map and published from it."""
    record = Builder("r").attribute("id", INT).add("any_attribute", "rest").build()
    docs = _documents(spark, sf_dir, "supplier", "s_suppkey", '<r xmlns:q="urn:q" id="1" q:name="', S.escape_attribute(F.col("s_name")), '" other="', F.col("s_nationkey").cast("string"), '"/>')
    rows = shred(docs, "doc", record, key="key")
    return rows.select("key", F.col("record.rest")["q:name"].alias("name"), publish(record, F.col("record")).alias("doc"))


@query("SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a;b;' ELSE 'c;c;' END AS tokens FROM customer")
def content_unwritable_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that has both branches of a choice, or too many of an element, is told before it is written."""
    body = f'<xs:element name="r"><xs:complexType><xs:choice>{_LEAVES["a"]}{_LEAVES["b"]}{_LEAVES["c"]}</xs:choice></xs:complexType></xs:element>'
    made = _schema(body).record("r")
    record = Record(made.name, tuple(replace(f, many=f.name == "c") for f in made.fields), content=made.content)
    key, x = F.col("c_custkey"), F.lit("x")
    value = F.struct(F.when(key % 3 < 2, x).alias("a"), F.when(key % 3 == 1, x).alias("b"), F.when(key % 3 == 2, F.array(x, x)).alias("c"))
    return table(spark, sf_dir, "customer").select(key.alias("key"), content_unwritable(record, value).alias("tokens"))


@query(
    """SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'syntax' WHEN 1 THEN 'root scalar facet fixed' WHEN 2 THEN 'facet' ELSE 'scalar fixed' END AS codes FROM customer"""
)
def violation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong comes in one order: syntax alone, the root, fields, and fixed values after all fields."""
    record = Builder("r").attribute("f", INT, fixed="5").element("n", INT).element("p", Scalar(patterns=("[a-c]+",))).build()
    key = F.col("c_custkey")
    doc = F.when(key % 4 == 0, "<r><n>").when(key % 4 == 1, '<q f="6"><n>x</n><p>d</p></q>').when(key % 4 == 2, '<r f="5"><n>1</n><p>d</p></r>').otherwise('<r f="7"><n>-</n><p>abc</p></r>')
    rows = shred(_documents(spark, sf_dir, "customer", "c_custkey", doc), "doc", record, strict_root=True)
    return rows.select("key", F.array_join(F.transform("errors", lambda e: e.code), " ").alias("codes"))


# -- JSON


@query("""SELECT event_id, '{"a":{"n":null,"t":"' || event_type || '"},"b":[' || user_id || ',2.5,true]}' AS json FROM events""")
def json_of_any_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any JSON read without a schema, and written with its keys in order and without its spaces."""
    doc = F.concat(F.lit('{ "b": ['), F.col("user_id").cast("string"), F.lit(', 2.5, true], "a": {"t": "'), "event_type", F.lit('", "n": null}}'))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(transcode.parse_dynamic(doc)).alias("json"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS a, CASE WHEN o_orderkey % 2 = 1 THEN '123456789012345678901234567890' ELSE CAST(o_orderkey AS VARCHAR) END AS b FROM orders")
def large_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON integers beyond 64 bits: null where 64 bits are asked for, whole where unbounded ones are."""
    record, key = Builder("r").element("a", INT).element("b", Scalar("integer")).build(), F.col("o_orderkey")
    number = F.when(key % 2 == 1, "123456789012345678901234567890").otherwise(key.cast("string"))
    doc = F.concat(F.lit('{"a":'), number, F.lit(',"b":"'), number, F.lit('"}'))
    rows = table(spark, sf_dir, "orders").select(key.alias("key"), transcode.from_json(record, doc).alias("r"))
    return rows.select("key", "r.a", "r.b")


@query("""SELECT p_partkey AS key, '{"k":"' || p_brand || '"}' AS named, '{"kind":"' || p_brand || '"}' AS aliased FROM part""")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are field names or XML names; nulls have none."""
    record = Builder("r").element("k", xml_name="kind").element("none", INT).build()
    value = F.struct(F.col("p_brand").alias("k"), F.lit(None).cast("bigint").alias("none"))
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("key"), transcode.to_json(record, value, by_alias=False).alias("named"), transcode.to_json(record, value).alias("aliased"))

