import pytest

from xylem.operators.shred import shred
from xylem.plans.schema import INT, STRING, Record, Scalar
from xylem.sources.nodes import content_violations, read_nodes, wrong_roots
from xylem.xsd import graph
from xylem.xsd.compile import SchemaError, compile_file, compile_text
from xylem.xsd.fixtures import VOYAGES


def schema(body, **attributes):
    more = " ".join(f'{k}="{v}"' for k, v in attributes.items())
    return compile_text(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" {more}>{body}</xs:schema>')


def test_voyages_compile_and_read(spark):
    record = compile_text(VOYAGES).record("Voyage")
    by_name = {f.name: f for f in record.fields}
    assert [f.name for f in record.fields] == ["Begun", "Route", "Ship", "Sail", "Engine", "number", "phase"]
    leg = by_name["Route"].type.fields[0]
    assert leg.many and leg.type.fields[0].type == Scalar("int", min_inclusive="0")
    assert by_name["phase"].type.enumeration == ("O", "F", "P") and by_name["Begun"].type.union == (Scalar("date"), Scalar("gYearMonth"))
    assert [v.name for v in by_name["Ship"].type.variants] == ["Tanker"]
    text = '<Voyage xmlns="urn:voyages" number="5" phase="X"><Begun>2024-02</Begun><Route><Leg berth="AB1"><Miles>2</Miles><Hold><Load>9.5</Load></Hold><Draughts>1 2.5</Draughts></Leg><Leg berth="bad"><Miles>-1</Miles><Hold deck="d"><Load unit="kg">1</Load></Hold></Leg></Route><Ship hull="7"/><Engine>e</Engine></Voyage>'
    row = shred(spark.createDataFrame([(text,)], "doc string"), "doc", record).first()
    assert [e.field for e in row.errors] == ["Route.Leg.Miles", "Route.Leg.Hold.deck", "Route.Leg.berth", "phase"]
    first, second = row.record.Route.Leg
    assert (first.Hold.Load[0].value, first.Hold.Load[0].unit, second.Hold.Load[0].unit, first.Draughts, row.record.Begun) == (9.5, "t", "kg", [1.0, 2.5], "2024-02")


def test_content_patterns():
    record = schema('<xs:element name="r"><xs:complexType><xs:sequence><xs:choice><xs:element name="a"/><xs:element name="b"/></xs:choice><xs:sequence minOccurs="0" maxOccurs="2"><xs:element name="c"/><xs:element name="d"/></xs:sequence></xs:sequence></xs:complexType></xs:element>').record("r")
    import re

    good = lambda t: re.fullmatch(record.content, t) is not None
    assert good("a;") and good("b;c;d;c;d;") and not good("a;b;") and not good("a;c;") and not good("c;d;") and not good("a;" + "c;d;" * 3)


def test_groups_attributes_and_restrictions():
    made = schema(
        """<xs:attribute name="ref" type="xs:int"/><xs:group name="g"><xs:sequence><xs:element name="x" type="xs:string" maxOccurs="2"/></xs:sequence></xs:group>
        <xs:complexType name="B"><xs:sequence><xs:group ref="g"/></xs:sequence><xs:attribute name="old"/><xs:attribute name="kept" use="required"/></xs:complexType>
        <xs:complexType name="R"><xs:complexContent><xs:restriction base="B"><xs:sequence><xs:element name="x"/></xs:sequence><xs:attribute name="old" use="prohibited"/><xs:attribute ref="ref"/></xs:restriction></xs:complexContent></xs:complexType>
        <xs:element name="r" type="R"/>"""
    ).record("r")
    assert {(f.name, f.kind, f.many) for f in made.fields} == {("x", "element", False), ("kept", "attribute", False), ("ref", "attribute", False)}


def test_simple_content_inherits():
    made = schema(
        """<xs:complexType name="A"><xs:simpleContent><xs:extension base="xs:int"><xs:attribute name="u"/></xs:extension></xs:simpleContent></xs:complexType>
        <xs:complexType name="C"><xs:simpleContent><xs:restriction base="A"><xs:maxInclusive value="9"/></xs:restriction></xs:simpleContent></xs:complexType><xs:element name="r" type="C"/>"""
    ).record()
    assert [(f.name, f.kind) for f in made.fields] == [("u", "attribute"), ("value", "text")] and made.fields[1].type == Scalar("int", max_inclusive="9")


def test_substitution_groups_and_recursion():
    made = schema(
        """<xs:element name="head" abstract="true" type="xs:string"/><xs:element name="one" substitutionGroup="head"/><xs:element name="two" type="xs:int" substitutionGroup="one"/>
        <xs:complexType name="N"><xs:sequence><xs:element ref="head" maxOccurs="unbounded"/><xs:element name="kid" type="N" minOccurs="0"/></xs:sequence></xs:complexType><xs:element name="r" type="N"/>"""
    ).record("r", depth=3)
    assert [(f.name, f.many) for f in made.fields] == [("one", True), ("two", True), ("kid", False)] and made.fields[0].type == STRING and made.fields[1].type == INT
    depth, at = 0, made
    while isinstance(at, Record) and at.fields:
        depth, at = depth + 1, at.fields[-1].type
    assert depth == 3


@pytest.mark.parametrize(
    "body",
    [
        '<xs:element name="r" type="xs:nothing"/>',
        '<xs:element name="r" type="Missing"/>',
        '<xs:element name="r" type="p:T"/>',
        '<xs:simpleType name="s"><xs:sequence/></xs:simpleType><xs:element name="r" type="s"/>',
        '<xs:element name="r" type="xs:int"><xs:alternative type="xs:string"/></xs:element>',
        '<xs:complexType name="A"><xs:simpleContent><xs:extension base="A"/></xs:simpleContent></xs:complexType><xs:element name="r" type="A"/>',
    ],
)
def test_schemas_that_are_refused(body):
    with pytest.raises(SchemaError):
        schema(body).record("r")


def test_includes_imports_and_cycles(tmp_path):
    head = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" '
    (tmp_path / "main.xsd").write_text(head + 'targetNamespace="urn:m" xmlns="urn:m" xmlns:o="urn:o"><xs:include schemaLocation="part.xsd"/><xs:import namespace="urn:o" schemaLocation="other.xsd"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="P"/><xs:element ref="o:e"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    (tmp_path / "part.xsd").write_text(head + '><xs:include schemaLocation="main.xsd"/><xs:simpleType name="P"><xs:restriction base="xs:int"/></xs:simpleType></xs:schema>')
    (tmp_path / "other.xsd").write_text(head + 'targetNamespace="urn:o"><xs:element name="e" type="xs:boolean"/></xs:schema>')
    made = compile_file(str(tmp_path / "main.xsd")).record("r")
    assert [(f.name, f.type.base, f.namespace) for f in made.fields] == [("a", "int", "urn:m"), ("e", "bool", "urn:o")]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "e"), ("f", "d")], "src string, dst string")
    assert {(r.node, r.component) for r in graph.cycles(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")}
    assert {r.node for r in graph.reachable(edges, spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b", "c"}
    assert {r.node: r.level for r in graph.levels(edges).collect()} == {"a": 0, "b": 0, "c": 0, "e": 0, "d": 1, "f": 2}
    of = graph.chunks(edges, 2)
    chunk = {r.node: r.chunk for r in of.collect()}
    assert len({chunk[x] for x in "abc"}) == 1 and all(a >= b for a, b in ((chunk[s], chunk[d]) for s, d in edges.collect()))
    assert all(r.needs < r.chunk for r in graph.chunk_needs(edges, of).collect())
    frames = graph.catalog(spark, compile_text(VOYAGES))
    assert {r.kind: r["count"] for r in frames["types"].groupBy("kind").count().collect()} == {"simple": 4, "complex": 4, "simple content": 1}
    assert graph.closure(frames["edges"].select("src", "dst")).filter("src = '{urn:voyages}Leg' and dst = '{urn:voyages}Load'").count() == 1


def test_ddl_and_field_metadata(spark):
    record = compile_text(VOYAGES).record("Voyage")
    made = record.typed_schema()
    assert shred(spark.createDataFrame([("<Voyage/>",)], "doc string"), "doc", record).schema["record"].dataType.simpleString() == made.simpleString()
    load = made["Route"].dataType["Leg"].dataType.elementType["Hold"].dataType["Load"].dataType.elementType
    assert load["unit"].metadata == {"xml_name": "unit", "kind": "attribute", "default": "t"}


def test_contents_and_roots(spark):
    record = compile_text(VOYAGES).record("Voyage")
    assert list(record.contents()) == ["Voyage"]
    good = '<Voyage xmlns="urn:voyages"><Begun/><Route><Leg/></Route><Ship/><Sail/></Voyage>'
    docs = spark.createDataFrame([(0, good), (1, good.replace("<Sail/>", "<Sail/><Engine/>")), (2, good.replace("<Ship/>", "")), (3, "<Voyage/>"), (4, good.replace("urn:voyages", "urn:other"))], "k int, doc string")
    rows = read_nodes(docs, "k", "doc")
    assert {r.k for r in content_violations(rows, "k", record).collect()} == {1, 2, 3, 4}
    assert {r.k for r in wrong_roots(rows, "k", record).collect()} == {3, 4}
    assert {r.k for r in shred(docs, "doc", record, strict_root=True).filter("exists(errors, e -> e.expected like 'element %')").collect()} == {3, 4}


def test_schemas_are_read_to_any_depth(spark):
    """What does not recur is not cut; what does is kept as markup below the cut."""
    nested = "".join(f'<xs:complexType><xs:sequence><xs:element name="e{i}"' + (">" if i < 9 else ' type="xs:int"/>') for i in range(10)) + "</xs:sequence></xs:complexType></xs:element>" * 9 + "</xs:sequence></xs:complexType>"
    at, levels = schema(f'<xs:element name="r">{nested}</xs:element>').record("r"), 0
    while isinstance(at, Record):
        at, levels = at.fields[0].type, levels + 1
    assert (levels, at) == (10, INT)
    loop = schema('<xs:complexType name="N"><xs:sequence><xs:element name="leaf"><xs:complexType><xs:sequence><xs:element name="x" type="xs:int"/></xs:sequence></xs:complexType></xs:element><xs:element name="kid" type="N" minOccurs="0"/></xs:sequence></xs:complexType><xs:element name="r" type="N"/>').record("r", depth=2)
    text = "<r><leaf><x>1</x></leaf><kid><leaf><x>2</x></leaf><kid><leaf><x>3</x></leaf></kid></kid></r>"
    row = shred(spark.createDataFrame([(text,)], "doc string"), "doc", loop).first().record
    assert (row.leaf.x, row.kid.leaf.x, row.kid.kid) == (1, 2, "<leaf><x>3</x></leaf>")


def model(body, rest=""):
    return schema(f'{rest}<xs:element name="r"><xs:complexType>{body}</xs:complexType></xs:element>')


A, B = '<xs:element name="a"/>', '<xs:element name="b"/>'
OPTIONAL, ANY = '<xs:element name="a" minOccurs="0"/>', '<xs:any namespace="##any" minOccurs="0"/>'
HEAD = '<xs:element name="h"/><xs:element name="m" substitutionGroup="h"/>'


@pytest.mark.parametrize(
    ("body", "rest"),
    [
        (f"<xs:sequence>{OPTIONAL}{A}</xs:sequence>", ""),
        (f"<xs:choice>{A}<xs:sequence>{A}{B}</xs:sequence></xs:choice>", ""),
        (f'<xs:sequence><xs:choice minOccurs="0" maxOccurs="unbounded">{A}{B}</xs:choice>{A}</xs:sequence>', ""),
        (f"<xs:sequence>{ANY}{A}</xs:sequence>", ""),
        ('<xs:sequence><xs:element ref="h" minOccurs="0"/><xs:element ref="m"/></xs:sequence>', HEAD),
        (f"<xs:sequence>{OPTIONAL}{ANY}</xs:sequence>", ""),
        ('<xs:sequence><xs:any namespace="urn:x" minOccurs="0"/><xs:any namespace="##any"/></xs:sequence>', ""),
        ('<xs:sequence><xs:element name="a" minOccurs="1" maxOccurs="2"/><xs:element name="a"/></xs:sequence>', ""),
    ],
)
def test_ambiguous_content(body, rest):
    with pytest.raises(SchemaError, match="more than one particle"):
        model(body, rest)


@pytest.mark.parametrize(
    ("body", "rest"),
    [
        (f"<xs:sequence>{A}{OPTIONAL}{B}</xs:sequence>", ""),
        ('<xs:sequence><xs:element name="a" minOccurs="0" maxOccurs="5"/><xs:element name="b"/></xs:sequence>', ""),
        (f'<xs:sequence><xs:sequence minOccurs="0" maxOccurs="2">{A}{B}</xs:sequence><xs:element name="c"/></xs:sequence>', ""),
        (f"<xs:all>{A}{B}</xs:all>", ""),
        ('<xs:sequence><xs:any namespace="##other" minOccurs="0" maxOccurs="unbounded"/><xs:element name="a"/></xs:sequence>', ""),
        ('<xs:sequence><xs:any namespace="urn:x" minOccurs="0"/><xs:any namespace="urn:y"/></xs:sequence>', ""),
        ('<xs:choice maxOccurs="unbounded"><xs:element ref="h"/><xs:element name="c"/></xs:choice>', HEAD),
        (f'<xs:sequence minOccurs="30" maxOccurs="40">{A}{B}</xs:sequence>', ""),
    ],
)
def test_clear_content(body, rest):
    model(body, rest)
