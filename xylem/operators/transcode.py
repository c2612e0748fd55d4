"""XML to JSON and back, with a schema or without."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions import scalars as S
from xylem.operators.publish import publish
from xylem.operators.shred import shred
from xylem.plans.schema import BOOL, INT, Field, Record, Scalar
from xylem.sources.nodes import Reader

# -- with a schema


def to_json(record: Record, value: Column, by_alias: bool = True, indent: bool = False) -> Column:
    """JSON text of a struct: keys are XML names or field names, nulls are left out, the discriminator comes first."""
    return F.to_json(_aliased(record, value, by_alias), {"pretty": "true"} if indent else {})


def _aliased(record: Record, value: Column, by_alias: bool) -> Column:
    columns = [value.getField("xsi_type").alias("@xsi:type")] if record.variants else []
    for f in record.all_fields():
        own = value.getField(f.name)
        if isinstance(f.type, Record):
            own = _each(f, own, by_alias)
        columns.append(own.alias(f.tag if by_alias else f.name))
    return F.when(value.isNotNull(), F.struct(*columns))


def _each(f: Field, own: Column, by_alias: bool) -> Column:
    return F.transform(own, lambda v: _aliased(f.type, v, by_alias)) if f.many else _aliased(f.type, own, by_alias)


def xml_to_json(df: DataFrame, xml: str, record: Record, into: str = "json", by_alias: bool = True) -> DataFrame:
    """df with JSON text of each document, without a wrapper for the root."""
    return shred(df, xml, record, "__record", "__errors").withColumn(into, to_json(record, F.col("__record"), by_alias)).drop("__record", "__errors")


def coerced(scalar: Scalar, text: Column) -> Column:
    """A JSON scalar, given as its text, as a value of the type: floats lose their fraction for integers, numbers and booleans may
    be quoted, booleans in any case."""
    if scalar == INT:
        number = S.parse_float(text)
        return F.coalesce(S.parse_int(text), F.when(number.between(-9.2e18, 9.2e18), number.cast("bigint")))
    if scalar == BOOL:
        return S.parse_bool(F.lower(text))
    return scalar.parse(text)


def from_json(record: Record, doc: Column) -> Column:
    """The record's struct from JSON text: a key is a field's XML name or else its name, and one value may stand for a list."""
    keys = sorted({k for f in record.all_fields() for k in (f.tag, f.name)} | ({"@xsi:type", "$type"} if record.variants else set()))
    found = F.from_json(doc, "STRUCT<" + ", ".join(f"`{k}`: STRING" for k in keys) + ">")
    columns = []
    for f in record.all_fields():
        raw = found.getField(f.tag) if f.tag == f.name else F.coalesce(found.getField(f.tag), found.getField(f.name))
        one = (lambda v, f=f: from_json(f.type, v)) if isinstance(f.type, Record) else (lambda v, f=f: coerced(f.type, v))
        if f.many:
            items = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, "ARRAY<STRING>")).otherwise(F.array(raw))
            own = F.when(raw.isNotNull(), F.transform(items, _unary(one)))
        else:
            own = one(raw)
        columns.append(own.alias(f.name))
    if record.variants:
        columns.append(S.local_name(F.coalesce(found.getField("@xsi:type"), found.getField("$type"))).alias("xsi_type"))
    return F.when(found.isNotNull(), F.struct(*columns))


def _unary(f):
    return lambda v: f(v)


def json_to_xml(df: DataFrame, doc: str, record: Record, into: str = "xml", root: str | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """df with XML text of each JSON document; the root is named after the record unless told otherwise."""
    return df.withColumn("__record", from_json(record, F.col(doc))).withColumn(into, publish(record, F.col("__record"), root, prefixes)).drop("__record")


# -- without a schema


def parse_dynamic(doc: Column) -> Column:
    """Any JSON as a variant; null where the text is none. ``F.to_json`` writes it again, with sorted keys."""
    return F.try_parse_json(doc)


def _scalar(text: str):
    trimmed = text.strip()
    if trimmed in ("true", "false"):
        return trimmed == "true"
    for kind in (int, float):
        try:
            value = kind(trimmed) if "_" not in trimmed and trimmed.isascii() else None
        except ValueError:
            continue
        if value is not None and (-(1 << 63) <= value < 1 << 63 if kind is int else value - value == 0):
            return value
    return text if trimmed else ""


def json_of(nodes: Reader, first: int, end: int) -> str:
    """Root tag around its content: attributes with @, children by local name, repeated ones as a list, text as value. An element
    without any content is null if it is written as one tag, and else an empty string. first, end: of a document's rows."""
    parent, kind, name, text, closed, attributes = (nodes.columns[c] for c in ("parent", "kind", "name", "text", "closed", "attributes"))
    if first == end or kind[first] == "error":
        raise ValueError(text[first] if first < end else "no root")
    children: dict[int, list] = {}
    for i in range(end - 1, first - 1, -1):
        if kind[i] != "element":
            continue
        value: dict = {f"@{k.rpartition(':')[2]}": _scalar(v) for k, v in attributes[i]}
        for tag, child in reversed(children.pop(i - first, ())):
            if tag not in value:
                value[tag] = child
            elif isinstance(value[tag], _Many):
                value[tag].append(child)
            else:
                value[tag] = _Many([value[tag], child])
        inside = text[i].strip()
        if value and inside:
            value["value"] = _scalar(inside)
        result = value or (_scalar(inside) if inside else None if closed[i] else "")
        if parent[i] is None:
            return json.dumps({name[i]: result}, ensure_ascii=False, separators=(",", ":"))
        children.setdefault(parent[i], []).append((name[i], result))
    raise ValueError("no root")


class _Many(list):
    """Values of one repeated tag."""


def xml_of(doc: str, root: str | None = None) -> str:
    """The reverse: the only key of an object is the root's tag, else the given one or root."""
    from xml.sax.saxutils import escape, quoteattr

    value = json.loads(doc)
    plain = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def element(tag: str, v) -> str:
        if isinstance(v, list):
            return "".join(element(tag, x) for x in v)
        if v is None:
            return f"<{tag}/>"
        if not isinstance(v, dict):
            return f"<{tag}>{escape(plain(v))}</{tag}>"
        attributes = "".join(f" {k[1:]}={quoteattr(plain(x))}" for k, x in v.items() if k.startswith("@"))
        texts = [plain(x) for k, x in v.items() if k in ("value", "#text", "$")]
        inside = "".join(element(k, x) for k, x in v.items() if not k.startswith("@") and k not in ("value", "#text", "$"))
        if not texts and not any(not k.startswith("@") for k in v):
            return f"<{tag}{attributes}/>"
        return f"<{tag}{attributes}>{inside}{escape(texts[-1]) if texts else ''}</{tag}>"

    if root is None and isinstance(value, dict) and len(value) == 1:
        return element(*next(iter(value.items())))
    return element(root or "root", value)


def _per_document(df: DataFrame, column: str, into: str, convert) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, problems = [], []
            for doc in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    values.append(convert(doc) if doc is not None else None)
                    problems.append(None)
                except (ValueError, RecursionError) as e:
                    values.append(None)
                    problems.append(str(e))
            yield batch.append_column(into, pa.array(values, pa.string())).append_column("error", pa.array(problems, pa.string()))

    kept = df.drop(into, "error")
    made = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType()), T.StructField("error", T.StringType())])
    return kept.mapInArrow(run, made)


def json_text(xml: str) -> str:
    nodes = Reader()
    return json_of(nodes, 0, nodes.read(xml))


def xml_to_json_dynamic(df: DataFrame, xml: str, into: str = "json") -> DataFrame:
    """df with JSON text of each document, and error where there is none."""
    return _per_document(df, xml, into, json_text)


def json_to_xml_dynamic(df: DataFrame, doc: str, into: str = "xml", root: str | None = None) -> DataFrame:
    """df with XML text of each JSON document, and error where there is none."""
    return _per_document(df, doc, into, lambda d: xml_of(d, root))
