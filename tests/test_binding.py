import pytest
from pyspark.sql import functions as F

from xylem.operators import transcode
from xylem.operators.publish import namespaces, publish, unwritable
from xylem.operators.shred import shred, valid
from xylem.plans.schema import BOOL, FLOAT, INT, STRING, Builder, Record, Scalar
from xylem.sources import nodes as N
from xylem.sources import records as R

INNER = Builder("item", "urn:i").attribute("id", INT).element("name").element("price", FLOAT).build()
OUTER = Builder("box", "urn:b").attribute("unit", default="kg").attribute("note").text("said").element("tag", many=True).element("item", INNER, many=True).element("on", BOOL).element("sizes", Scalar("list", item=INT)).build()


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, doc string")


def read(spark, record, *texts):
    return [(r.record, [(e.field, e.value) for e in r.errors]) for r in shred(documents(spark, *texts), "doc", record).orderBy("k").collect()]


def test_nested_records(spark):
    text = '<b:box xmlns:b="urn:b" note="n &amp; m">hello<b:tag>x</b:tag><b:tag/><i:item xmlns:i="urn:i" id="4"><i:name>N</i:name><i:price>1.5</i:price><i:extra><i:name>no</i:name></i:extra></i:item><b:on>1</b:on><b:sizes>1 2</b:sizes></b:box>'
    (record, errors), (nothing, none) = read(spark, OUTER, text, None)
    assert record.asDict(recursive=True) == {"unit": "kg", "note": "n & m", "said": "hello", "tag": ["x", ""], "item": [{"id": 4, "name": "N", "price": 1.5}], "on": True, "sizes": [1, 2]}
    assert errors == [] and nothing is None and none == []


def test_violations_are_rows(spark):
    text = '<box><item id="x"><price>dear</price></item><item id="7"><price>2</price></item><on>maybe</on><sizes>1 b</sizes></box>'
    ((record, errors),) = read(spark, OUTER, text)
    assert errors == [("item.id", "x"), ("item.price", "dear"), ("on", "maybe"), ("sizes", "1 b")]
    assert record.item[1].id == 7 and record.item[0].id is None


def test_modes(spark):
    df = shred(documents(spark, "<r><a>1</a></r>", "<r><a>x</a></r>"), "doc", Builder("r").element("a", INT).build())
    assert valid(df).count() == 2 and valid(df, "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="invalid document"):
        valid(df, "FAILFAST").collect()


def test_pruned_columns_prune_the_schema(spark):
    plan = shred(documents(spark, "<box/>"), "doc", OUTER, columns=["on"])._jdf.queryExecution().optimizedPlan().toString()
    assert "price" not in plan and "on" in plan


def test_fixed_and_defaults(spark):
    record = Builder("r").attribute("v", INT, fixed="13").element("d", INT, default="5").element("f", STRING, fixed="0013").build()
    got = read(spark, record, '<r v="013"><d/><f>0013</f></r>', '<r v="14"><f>13</f></r>', "<r/>")
    assert [(r.v, r.d, r.f, e) for r, e in got[:1]] == [(13, 5, "0013", [])]
    assert got[1][1] == [("v", "14"), ("f", "13")] and got[1][0].d is None
    assert (got[2][0].v, got[2][0].f) == (13, None) if got[2][0] else True


def test_publish_reads_back(spark):
    text = '<box note="&lt;&quot;&#10;">a &lt; b &amp; c<tag>&gt;</tag><item id="1"><name> spaced </name><price>0.1</price></item><on>0</on><sizes> 3  4</sizes></box>'
    df = shred(documents(spark, text), "doc", OUTER).select("record", publish(OUTER, F.col("record")).alias("doc"))
    again = shred(df.withColumnRenamed("record", "before"), "doc", OUTER).first()
    assert again.record == again.before and again.errors == []
    assert again.doc.startswith('<ns0:box xmlns:ns0="urn:b" xmlns:ns1="urn:i" unit="kg"') and "<ns1:item" in again.doc
    assert publish_one(spark, Builder("r").element("a").build(), "named_struct('a', cast(null as string))") == "<r/>"
    assert publish_one(spark, Builder("r").element("a", many=True).build(), "named_struct('a', array('x', 'y'))", root="other") == "<other><a>x</a><a>y</a></other>"


def publish_one(spark, record, value, **how):
    return spark.range(1).select(publish(record, F.expr(value), **how)).first()[0]


def test_namespaces_from_the_caller():
    assert namespaces(OUTER) == {"urn:b": "ns0", "urn:i": "ns1"}
    assert namespaces(OUTER, {"urn:i": "ns0"}) == {"urn:b": "ns1", "urn:i": "ns0"}


def test_unwritable_values(spark):
    record = Builder("r").element("n", Scalar("int", max_inclusive="5")).element("l", Scalar("list", item=STRING)).build()
    rows = spark.sql("select named_struct('n', n, 'l', l) v from values (3L, array('a', 'b')), (9L, array('a b')), (5L, array('')) t(n, l)")
    assert [r[0] for r in rows.select(unwritable(record, F.col("v"))).collect()] == [[], ["n", "l"], ["l"]]


def test_variants(spark):
    derived = Builder("Derived").element("y", INT).build()
    record = Record("base", Builder("base").element("x").build().fields, abstract=True, variants=(derived,))
    xsi = f'xmlns:xsi="{N.XSI}"'
    got = read(spark, record, f'<base {xsi} xsi:type="t:Derived"><x>a</x><y>2</y></base>', f'<base {xsi} xsi:type="Other"/>', "<base><x>b</x></base>")
    assert (got[0][0].xsi_type, got[0][0].y, got[0][1]) == ("Derived", 2, [])
    assert [e[0][0] for _, e in got[1:]] == ["xsi:type", "xsi:type"]


def node_rows(spark, *texts, **how):
    return N.read_nodes(documents(spark, *texts), "k", "doc", **how)


def test_nodes_of_a_document(spark):
    text = '<a xmlns="urn:a" xmlns:p="urn:p" q="1">x<p:b xsi:nil="true" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="p:T"/><![CDATA[<y>]]></a> <!-- end --> junk'
    rows = node_rows(spark, text).orderBy("node").collect()
    assert [(r.kind, r.uri, r.name, r.text, r.place) for r in rows] == [("element", "urn:a", "a", "x<y>", 0), ("text", None, None, "x", 0), ("element", "urn:p", "b", "", 1), ("text", None, None, "<y>", 2)]
    assert rows[2].nil and rows[2].type == "{urn:p}T" and rows[0].attributes == {"q": "1"} and rows[0].last == 3 and rows[2].empty


def test_refused_documents(spark):
    bad = ["<a>", "<a></b>", "<a>&who;</a>", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', "", "<d>" * 5 + "</d>" * 5]
    rows = node_rows(spark, *bad, None, "<d/>", limit=4).collect()
    assert {r.k for r in rows if r.kind == "error"} == set(range(6)) and {r.k for r in rows} == {*range(6), 7}
    assert N.errors(node_rows(spark, *bad), "k").count() == 5


def test_tokens_mixed_items_and_wildcards(spark):
    rows = node_rows(spark, '<r xmlns:x="urn:x">one<b>B</b> two<x:c n="1">C<d/></x:c></r>')
    assert N.child_tokens(rows, "k").filter("parent = 0").first().tokens == "b;{urn:x}c;"
    items = N.mixed_items(rows, "k").filter("parent = 0").first()["items"]
    assert [(i.kind, i.value) for i in items] == [("#text", "one"), ("b", "B"), ("#text", " two"), ("c", "C")]
    top = rows.filter("depth = 1")
    names = lambda ns, target=None: [r.name for r in N.wildcard(top, [], ns, target).collect()]
    assert (names("##any"), names("##local"), names("##other", "urn:x"), names("##targetNamespace", "urn:x"), names("urn:x"), names("urn:none")) == (["b", "c"], ["b"], [], ["c"], ["c"], [])


def test_markup_reads_back(spark):
    """Prefixes bound twice, default namespaces that come and go, references and both kinds of empty elements."""
    texts = ['<a xmlns="urn:a" xmlns:p="urn:p" p:q="1 &lt;&#10;"><p:b xmlns:p="urn:other"><p:c/></p:b><p:d/><e xmlns=""><f></f></e>x &amp; <![CDATA[<y>]]></a>', "<r>t<s/>u</r>", "<xml:a xml:lang='en'/>"]
    nodes = node_rows(spark, *texts, columns=[*N.NAMES, "uses"])
    again = N.read_nodes(N.markup(nodes, "k"), "k", "xml")
    shown = lambda df: sorted((r.k, r.node, r.kind, r.uri, r.name, r.text, r.closed, sorted((r.attributes or {}).items())) for r in df.filter("kind = 'element'").collect())
    same = lambda rows: [(k, kind, uri or None, *rest) for k, _, kind, uri, *rest in rows]
    assert same(shown(again)) == same(shown(nodes))
    assert N.markup(nodes.filter("k = 1"), "k").first().xml == texts[1]


def test_records_inside_records_are_not_their_own(spark):
    rows = N.subtrees(node_rows(spark, "<l><r><r>in</r></r><x><r>out</r></x></l>"), "k", "r")
    assert sorted({r.record for r in rows.collect()}) == [1, 5]


def test_record_files_batch_and_stream(spark, tmp_path):
    record = Builder("row").attribute("id", INT).element("v").build()
    R.write_records(spark.sql("select id as _id, concat('v', id) as v from range(50)").repartition(3), str(tmp_path / "in"), "rows", "row")
    batch = R.read_records(spark, str(tmp_path / "in"), record)
    assert sorted(r.record.id for r in batch.collect()) == list(range(50))
    stream = R.stream_records(spark, str(tmp_path / "in"), record)
    run = stream.writeStream.format("memory").queryName("rows_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("rows_seen").select("record.id").distinct().count() == 50
    assert R.read_documents(spark, str(tmp_path / "in")).count() == 3


def test_records_in_a_column(spark):
    got = R.split_records(documents(spark, '<l><row id="1"><v>a</v></row>t<row id="x"/></l>', "<l/>", None), "doc", Builder("row").attribute("id", INT).element("v").build()).collect()
    assert [(r.k, r.position, r.record.id, len(r.errors)) for r in got] == [(0, 0, 1, 0), (0, 1, None, 1)]
    assert [r[0] for r in documents(spark, " <a/>", "\n[1]", '{"a":1}', "x", None).select(R.detect_format(F.col("doc"))).collect()] == ["xml", "json", "json", None, None]


def test_json_with_a_schema(spark):
    doc = '{"unit": null, "note": 5, "tag": "one", "item": {"id": "7", "name": true, "price": "2.5"}, "on": "False", "sizes": "1 2"}'
    record = documents(spark, doc).select(transcode.from_json(OUTER, F.col("doc")).alias("r")).first().r
    assert record.asDict(recursive=True) == {"unit": None, "note": "5", "said": None, "tag": ["one"], "item": [{"id": 7, "name": "true", "price": 2.5}], "on": False, "sizes": [1, 2]}
    xml = transcode.json_to_xml(documents(spark, '{"a":"<","b":[1,2]}'), "doc", Builder("r").element("a").element("b", INT, many=True).build()).first().xml
    assert xml == "<r><a>&lt;</a><b>1</b><b>2</b></r>"
    back = transcode.xml_to_json(documents(spark, xml), "doc", Builder("r").element("a", xml_name="a").element("b", INT, many=True).build()).first().json
    assert back == '{"a":"<","b":[1,2]}'


def test_json_without_a_schema():
    pairs = {
        '<a x="1" p:y="t"><b>1</b><c/><b>two</b><d></d>text</a>'.replace("p:y", "y"): '{"a":{"@x":1,"@y":"t","b":[1,"two"],"c":null,"d":"","value":"text"}}',
        "<a>8080</a>": '{"a":8080}',
        "<a>1e5</a>": '{"a":100000.0}',
        "<a>nan</a>": '{"a":"nan"}',
        "<a> </a>": '{"a":""}',
        "<a/>": '{"a":null}',
        "<a><t/><t></t><t ></t><t />x</a>": '{"a":{"t":[null,"","",null],"value":"x"}}',
        "<a><t><!-- /> --></t><t q='/'></t></a>": '{"a":{"t":["",{"@q":"/"}]}}',
    }
    for xml, doc in pairs.items():
        assert transcode.json_text(xml) == doc
    assert transcode.xml_of('{"a":{"@x":1,"b":[1,null],"value":"t<"}}') == '<a x="1"><b>1</b><b/>t&lt;</a>'
    assert transcode.xml_of("[1,2]") == "<root>1</root><root>2</root>" and transcode.xml_of('{"a":1,"b":2}', "r") == "<r><a>1</a><b>2</b></r>"
    assert transcode.xml_of('{"a":{}}') == "<a/>" and transcode.xml_of("null") == "<root/>"


def test_variants_of_any_json(spark):
    rows = documents(spark, '{"b":[1,2.5],"a":null}', "{", None).select("k", F.to_json(transcode.parse_dynamic(F.col("doc"))).alias("j")).orderBy("k").collect()
    assert [r.j for r in rows] == ['{"a":null,"b":[1,2.5]}', None, None]


def test_bad_documents_are_errors_not_failures(spark):
    rows = transcode.xml_to_json_dynamic(documents(spark, "<a>", None, "<a/>"), "doc").orderBy("k").collect()
    assert [(r.json, r.error is None) for r in rows] == [(None, False), (None, True), ('{"a":null}', True)]
    assert transcode.json_to_xml_dynamic(documents(spark, "{"), "doc").first().error


def test_published_text_is_planned_once(spark):
    """What an element holds is written once, however deep it is nested."""
    record = Builder("e5").element("leaf_value").build()
    for i in range(4, -1, -1):
        record = Builder(f"e{i}").element(f"e{i + 1}", record).build()
    value = F.struct(F.col("leaf_value"))
    for i in range(5, 0, -1):
        value = F.struct(value.alias(f"e{i}"))
    text = publish(record, value)
    rows = spark.createDataFrame([("a<",), ("",), (None,)], "leaf_value string")
    start, end = "".join(f"<e{i}>" for i in range(5)), "".join(f"</e{i}>" for i in range(4, -1, -1))
    assert [r[0] for r in rows.select(text).collect()] == [f"{start}<e5><leaf_value>a&lt;</leaf_value></e5>{end}", f"{start}<e5><leaf_value/></e5>{end}", f"{start}<e5/>{end}"]
    assert str(text).count("</leaf_value>") == 1


def test_bounds_and_lists_at_their_limits(spark):
    record = Builder("r").element("v", Scalar("int", min_inclusive="-5", max_exclusive="99999999999999999999")).element("w", Scalar("list", item=INT, max_length=2)).build()
    texts = ["<r><v> +7\n</v><w>1\t\n2</w></r>", "<r><v>-6</v><w>1 2 3</w></r>", "<r><v>1.5</v><w>1 x</w></r>", "<r><v>9223372036854775807</v><w> </w></r>", "<r><v>7 7</v></r>"]
    found = [(r.v, r.w) for r, _ in read(spark, record, *texts)]
    assert found == [(7, [1, 2]), (None, None), (None, None), (9223372036854775807, []), (None, None)]
