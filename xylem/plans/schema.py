"""Declared schemas: scalars with facets, fields and records, and what Spark makes of them.

A record compiles to three things: the struct that ``from_xml`` reads, in which every scalar is still text; an expression that
turns that struct into typed columns; and an expression for the violations, one row for each. Text first keeps one bad value from
spoiling its record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions import scalars as S

BOUNDS = ("min_inclusive", "max_inclusive", "min_exclusive", "max_exclusive")


@dataclass(frozen=True)
class Scalar:
    """base: string, int, float, bool, decimal, date, a Gregorian or unbounded integer kind, hexBinary, base64Binary or any other
    name, which is trimmed text. patterns: each must match. union: the first member that parses counts. item: of a lexical list."""

    base: str = "string"
    enumeration: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: str | None = None
    max_inclusive: str | None = None
    min_exclusive: str | None = None
    max_exclusive: str | None = None
    union: tuple[Scalar, ...] = ()
    item: Scalar | None = None

    def parse(self, text: Column) -> Column:
        """The value, or null where the text is none."""
        if self.item:
            parsed = F.transform(S.split_list(text), self.item.parse)
            # transform over a one-element array binds the items once
            return F.get(F.transform(F.array(parsed), lambda p: F.when(F.forall(p, F.isnotnull) & self._holds(text, p), p)), F.lit(0))
        if self.union:
            return F.when(self._holds(text, None), F.coalesce(*(m.parse(text).cast("string") for m in self.union)))
        value = self._base(text)
        return F.when(self._holds(text, None), value) if self._restricted() else value

    def _base(self, text: Column) -> Column:
        match self.base:
            case "string":
                return text
            case "int":
                return S.parse_int(text)
            case "float":
                return S.parse_float(text)
            case "bool":
                return S.parse_bool(text)
            case "date":
                return S.parse_date(text)
            case "hexBinary" | "base64Binary":
                return S.parse_binary(text, self.base)
            case kind if kind in S.GREGORIAN:
                return S.parse_gregorian(text, kind)
            case kind if kind in S.INTEGER_SIGNS:
                return S.parse_integer(text, kind)
            case _:
                return S.trim(text)

    def _restricted(self) -> bool:
        return self != Scalar(self.base)

    def _holds(self, text: Column, items: Column | None) -> Column:
        tests = [F.lit(True)]
        if self.enumeration:
            tests.append(S.trim(text).isin(*self.enumeration))
        tests += [S.matches(S.trim(text), p) for p in self.patterns]
        size = F.length(text) if items is None else F.size(items)
        for limit, test in ((self.length, size.__eq__), (self.min_length, size.__ge__), (self.max_length, size.__le__)):
            if limit is not None:
                tests.append(test(limit))
        for name in BOUNDS:
            limit = getattr(self, name)
            if limit is not None:
                tests.append(self._bounded(text, limit, name))
        out = tests[0]
        for t in tests[1:]:
            out = out & F.coalesce(t, F.lit(False))
        return out

    def _bounded(self, text: Column, limit: str, name: str) -> Column:
        """Integers compare exactly, all others as doubles; a limit that is no number holds for nothing."""
        if self.base == "int" and re.fullmatch("[+-]?[0-9]{1,18}", limit.strip(S.SPACES), re.ASCII):
            value, bound = text.try_cast("bigint"), F.lit(int(limit)).cast("bigint")
        elif self.base in S.INTEGER_SIGNS or self.base == "int":
            value, bound = S.integer_key(text), S.integer_key(F.lit(limit))
        else:
            value, bound = S.parse_float(text), S.parse_float(F.lit(limit))
        return {"min_inclusive": value >= bound, "max_inclusive": value <= bound, "min_exclusive": value > bound, "max_exclusive": value < bound}[name]

    def spark_type(self) -> T.DataType:
        if self.item:
            return T.ArrayType(self.item.spark_type())
        if self.union:
            return T.StringType()
        return {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "hexBinary": T.BinaryType(), "base64Binary": T.BinaryType()}.get(self.base, T.StringType())

    def text(self, value: Column) -> Column:
        """Lexical form of a value."""
        if self.item:
            return F.array_join(F.transform(value, self.item.text), " ")
        if self.base in ("hexBinary", "base64Binary"):
            return S.format_binary(value, self.base)
        return value.cast("string")


STRING, INT, FLOAT, BOOL = Scalar(), Scalar("int"), Scalar("float"), Scalar("bool")
#: Text of an element with the markup in it.
MARKUP = Scalar("markup")


@dataclass(frozen=True)
class Field:
    """kind: element, attribute, text or any_attribute. fixed and default are lexical forms."""

    name: str
    type: Scalar | Record = STRING
    kind: str = "element"
    many: bool = False
    xml_name: str | None = None
    namespace: str | None = None
    required: bool = False
    nillable: bool = False
    default: str | None = None
    fixed: str | None = None

    @property
    def tag(self) -> str:
        return (self.xml_name or self.name).rpartition(":")[2]

    @property
    def source(self) -> str:
        """The field of the struct that from_xml makes."""
        return {"attribute": f"_{self.tag}", "text": "_VALUE"}.get(self.kind, self.tag)


@dataclass(frozen=True)
class Record:
    """variants: types that xsi:type may name in place of this one; their fields are added to the struct, under a discriminator.
    content: a pattern over the children's names, each followed by a semicolon. ordered: whether children of several names may take
    turns, so that their lists alone do not tell their order; see nodes.ordered_items."""

    name: str
    fields: tuple[Field, ...] = ()
    namespace: str | None = None
    abstract: bool = False
    variants: tuple[Record, ...] = ()
    content: str | None = None
    ordered: bool = False

    def all_fields(self) -> list[Field]:
        found = {f.name: f for f in self.fields}
        for v in self.variants:
            found |= {f.name: f for f in v.fields if f.name not in found}
        return list(found.values())

    def only(self, *names: str) -> Record:
        """The record with some of its fields; what from_xml does not know it skips."""
        return replace(self, fields=tuple(f for f in self.fields if f.name in names))

    def read_schema(self, pieces: bool = False) -> T.StructType:
        """What from_xml reads. Text beside elements comes in pieces, as an array; pieces: so does that of scalar elements, without
        what markup inside of them holds, or else their markup is part of the text."""
        out, parts = T.StructType(), T.ArrayType(T.StringType())
        for f in self.all_fields():
            if f.kind == "any_attribute":
                continue
            if isinstance(f.type, Record):
                kind: T.DataType = f.type.read_schema(pieces)
            elif f.kind == "text":
                kind = parts
            elif f.kind == "element" and (pieces or f.nillable):
                kind = T.StructType().add("_VALUE", parts if pieces else T.StringType())
                kind = kind.add("_nil", "string") if f.nillable else kind
            else:
                kind = T.StringType()
            out.add(f.source, T.ArrayType(kind) if f.many else kind)
        return out.add("_type", "string") if self.variants else out

    def mended(self, raw: Column, pieces: Column) -> Column:
        """raw with the text of scalar elements taken from pieces where it holds markup, or what looks like it."""

        def own(f: Field, value: Column, parts: Column) -> Column:
            if isinstance(f.type, Record):
                return f.type.mended(value, parts)
            if f.type == MARKUP:
                return value
            text = lambda v: F.when(F.contains(v, F.lit("<")), F.coalesce(F.array_join(parts._VALUE, ""), F.lit(""))).otherwise(v)
            return F.when(value.isNotNull(), F.struct(text(value._VALUE).alias("_VALUE"), value._nil.alias("_nil"))) if f.nillable else text(value)

        columns = []
        for f in self.all_fields():
            if f.kind == "any_attribute":
                continue
            value, parts = raw.getField(f.source), pieces.getField(f.source)
            if f.kind == "element":
                value = F.zip_with(value, parts, _binary(lambda v, p, f=f: own(f, v, p))) if f.many else own(f, value, parts)
            columns.append(value.alias(f.source))
        if self.variants:
            columns.append(raw.getField("_type").alias("_type"))
        return F.when(raw.isNotNull(), F.struct(*columns))

    def same(self, raw: Column) -> Column:
        """raw with its fields alone."""
        names = self.read_schema().fieldNames()
        return F.when(raw.isNotNull(), F.struct(*(raw.getField(n).alias(n) for n in names))) if names else raw

    def typed_schema(self) -> T.StructType:
        """What typed() makes; its simpleString() is the DDL of a table for the records."""
        out = T.StructType()
        for f in self.all_fields():
            if f.kind == "any_attribute":
                out.add(f.name, T.MapType(T.StringType(), T.StringType()), True, {"xml_name": f.tag, "kind": f.kind})
            else:
                kind = f.type.typed_schema() if isinstance(f.type, Record) else f.type.spark_type()
                about = {"xml_name": f.tag, "kind": f.kind} | {k: v for k in ("namespace", "default", "fixed") if (v := getattr(f, k)) is not None}
                out.add(f.name, T.ArrayType(kind) if f.many else kind, True, about)
        return out.add("xsi_type", "string") if self.variants else out

    def contents(self) -> dict[str, str]:
        """Content pattern by element name, of this record and of those below it."""
        found = {self.name: self.content} if self.content else {}
        for f in self.all_fields():
            if isinstance(f.type, Record):
                inner = f.type.contents()
                if f.type.content:
                    inner[f.tag] = inner.pop(f.type.name)
                found |= inner
        return found

    def ordered_names(self) -> list[str]:
        """Names of the elements, this record's and those below it, whose children may take turns."""
        below = [(f.tag, f.type) for f in self.all_fields() if isinstance(f.type, Record)]
        found = ([self.name] if self.ordered else []) + [tag for tag, r in below if r.ordered]
        for _, r in below:
            found += replace(r, ordered=False).ordered_names()
        return list(dict.fromkeys(found))

    def _text(self, f: Field, value: Column) -> Column:
        """Text of a scalar as it counts: null where nil, the default where empty."""
        if f.nillable and f.kind == "element":
            text = F.when(F.coalesce(S.trim(value._nil).isin("true", "1"), F.lit(False)), F.lit(None)).otherwise(F.coalesce(value._VALUE, F.when(value.isNotNull(), F.lit(""))))
        else:
            text = F.array_join(value, "") if f.kind == "text" else value
        stand_in = f.default if f.default is not None else f.fixed
        if stand_in is not None:
            text = F.coalesce(text, F.lit(stand_in)) if f.kind == "attribute" else F.when(text == "", F.lit(stand_in)).otherwise(text)
        return F.nullif(text, F.lit("")) if f.kind == "text" else text

    def typed(self, raw: Column) -> Column:
        """The struct of typed fields that the text of raw denotes; null where raw is null."""
        columns = []
        for f in self.all_fields():
            if f.kind == "any_attribute":  # filled in from nodes, as from_xml cannot read it
                columns.append(F.lit(None).cast(ANY_ATTRIBUTES).alias(f.name))
                continue
            one = f.type.typed if isinstance(f.type, Record) else lambda v, f=f: f.type.parse(self._text(f, v))
            value = raw.getField(f.source)
            columns.append((F.transform(value, _unary(one)) if f.many else one(value)).alias(f.name))
        if self.variants:
            columns.append(S.local_name(raw.getField("_type")).alias("xsi_type"))
        return F.when(raw.isNotNull(), F.struct(*columns))

    def violations(self, raw: Column, path: str = "") -> Column:
        """array of struct(code, field, expected, value): values that are none of their type or break its facets, types that may not
        stand, and fixed values that differ."""
        found, after = [], []
        for f in self.all_fields():
            if f.kind == "any_attribute":
                continue
            where, value = f"{path}{f.name}", raw.getField(f.source)
            if isinstance(f.type, Record):
                one = lambda v, f=f, where=where: f.type.violations(v, f"{where}.")
                found.append(F.coalesce(F.flatten(F.transform(value, _unary(one))), no_violations()) if f.many else F.when(value.isNotNull(), one(value)).otherwise(no_violations()))
                continue
            tests = [(found, self._scalar_violations)] + ([(after, self._fixed_violations)] if f.fixed is not None else [])
            for out, test in tests:
                one = lambda v, f=f, where=where, test=test: test(f, v, where)
                out.append(F.coalesce(F.flatten(F.transform(value, _unary(one))), no_violations()) if f.many else one(value))
        if self.variants and self.abstract:
            known = [v.name for v in self.variants]
            named = S.local_name(raw.getField("_type"))
            found.append(F.when(raw.isNotNull() & ~F.coalesce(named.isin(*known), F.lit(False)), one_violation("type", f"{path}xsi:type", " | ".join(known), named)).otherwise(no_violations()))
        return F.concat(*found, *after) if found else no_violations()

    def _scalar_violations(self, f: Field, value: Column, where: str) -> Column:
        text, kind = self._text(f, value), f.type.item.base if f.type.item else f.type.base
        bad = text.isNotNull() & f.type.parse(text).isNull()
        plain = replace(Scalar(), base=f.type.base, item=f.type.item, union=f.type.union)
        if plain == f.type:
            return F.when(bad, one_violation("scalar", where, kind, text)).otherwise(no_violations())
        facet = one_violation("facet", where, kind, text)
        return F.when(bad, F.when(plain.parse(text).isNull(), one_violation("scalar", where, kind, text)).otherwise(facet)).otherwise(no_violations())

    def _fixed_violations(self, f: Field, value: Column, where: str) -> Column:
        text = self._text(f, value)
        parsed = f.type.parse(text)
        return F.when(parsed.isNotNull() & ~parsed.eqNullSafe(f.type.parse(F.lit(f.fixed))), one_violation("fixed", where, f"fixed {f.fixed}", text)).otherwise(no_violations())


ANY_ATTRIBUTES = "map<string,string>"
#: Codes, in the order that violations of a document have: syntax alone; root; then of each record, those of its fields in their
#: order (scalar, facet, and what is below), xsi:type, and fixed.
VIOLATION = "array<struct<code:string,field:string,expected:string,value:string>>"


def no_violations() -> Column:
    return F.array().cast(VIOLATION)


def _unary(f):
    """Spark counts a lambda's parameters, default ones too."""
    return lambda v: f(v)


def _binary(f):
    return lambda v, w: f(v, w)


def one_violation(code: str, where: str, expected: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(code).alias("code"), F.lit(where).alias("field"), F.lit(expected).alias("expected"), value.alias("value")))


class Builder:
    """Records declared field by field."""

    def __init__(self, name: str, namespace: str | None = None):
        self.name, self.namespace, self.fields = name, namespace, []

    def add(self, kind: str, name: str, type: Scalar | Record = STRING, **how) -> Builder:
        self.fields.append(Field(name, type, kind, **how))
        return self

    def attribute(self, name: str, type: Scalar = STRING, **how) -> Builder:
        return self.add("attribute", name, type, **how)

    def element(self, name: str, type: Scalar | Record = STRING, **how) -> Builder:
        return self.add("element", name, type, **how)

    def text(self, name: str, type: Scalar = STRING, **how) -> Builder:
        return self.add("text", name, type, **how)

    def build(self, **how) -> Record:
        return Record(self.name, tuple(self.fields), self.namespace, **how)
