"""Typed columns to XML text, as one expression per record.

Attributes come first, in the order of the fields, then text, then elements; nulls are left out and lists repeat their element.
Namespaces get prefixes from the caller or ns0, ns1, ...; all are declared at the root. Values are checked again before they are
written: see ``violations``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.plans.schema import BOOL, FLOAT, INT, Field, Record, Scalar

XSI = "http://www.w3.org/2001/XMLSchema-instance"


def namespaces(record: Record, prefixes: dict[str, str] | None = None) -> dict[str, str]:
    """Prefix of each namespace that the record and what is below it use, in the order they are met."""
    given = {uri: p for uri, p in (prefixes or {}).items()}
    found: dict[str, str] = {}

    def visit(r: Record, above: tuple[str, ...]) -> None:
        for uri in [r.namespace, *(f.namespace for f in r.all_fields())]:
            if uri and uri not in found:
                free = (f"ns{i}" for i in range(len(found) + len(given) + 1))
                found[uri] = given[uri] if uri in given else next(p for p in free if p not in found.values() and p not in given.values())
        for f in r.all_fields():
            if isinstance(f.type, Record) and f.type.name not in above:
                visit(f.type, (*above, r.name))

    visit(record, ())
    if record.variants:
        found[XSI] = "xsi"
    return found


def _name(local: str, uri: str | None, known: dict[str, str]) -> str:
    return f"{known[uri]}:{local}" if uri and known.get(uri) else local


def _element(tag: str, attributes: Column, inside: Column, blank: Column) -> Column:
    """blank: whether inside is empty, told without it, as what is named twice is written twice, at each level again."""
    start = F.concat(F.lit(f"<{tag}"), attributes)
    return F.concat(start, F.when(blank, F.lit("/>")).otherwise(F.concat(F.lit(">"), inside, F.lit(f"</{tag}>"))))


def _text(kind: Scalar, value: Column) -> tuple[Column, Column]:
    """Escaped text of a scalar, and whether it is empty."""
    text = kind.text(value)
    if kind.base in ("int", "float", "bool") and not kind.item and not kind.union:
        return text, F.lit(False)
    return S.escape_text(text), text == ""


def _blank(record: Record, value: Column) -> Column:
    """Whether a record has no content."""
    out = F.lit(True)
    for f in record.all_fields():
        own = value.getField(f.name)
        if f.kind == "text":
            out = out & F.coalesce(_text(f.type, own)[1] | own.isNull(), F.lit(True))
        elif f.kind == "element":
            out = out & (~F.coalesce(F.exists(own, F.isnotnull), F.lit(False)) if f.many else own.isNull())
    return out


def _parts(record: Record, value: Column, known: dict[str, str]) -> tuple[Column, Column]:
    """Attributes and content of a record."""
    attributes, content = [F.lit("")], [F.lit("")]
    for f in sorted(record.all_fields(), key=lambda f: ("attribute", "any_attribute", "text", "element").index(f.kind)):
        own = value.getField(f.name)
        if f.kind == "attribute":
            escaped = own.cast("string") if f.type in (INT, FLOAT, BOOL) else S.escape_attribute(f.type.text(own))
            attributes.append(F.coalesce(F.concat(F.lit(f' {_name(f.tag, f.namespace, known)}="'), escaped, F.lit('"')), F.lit("")))
        elif f.kind == "any_attribute":
            pairs = F.array_sort(F.map_entries(own))
            attributes.append(F.coalesce(F.array_join(F.transform(pairs, lambda p: F.concat(F.lit(" "), p.key, F.lit('="'), S.escape_attribute(p.value), F.lit('"'))), ""), F.lit("")))
        elif f.kind == "text":
            content.append(F.coalesce(_text(f.type, own)[0], F.lit("")))
        else:
            content.append(_child(f, own, record, known))
    if record.variants:
        attributes.append(F.coalesce(F.concat(F.lit(' xsi:type="'), value.getField("xsi_type"), F.lit('"')), F.lit("")))
    return F.concat(*attributes), F.concat(*content)


def _child(f: Field, own: Column, owner: Record, known: dict[str, str]) -> Column:
    if isinstance(f.type, Scalar):
        tag = _name(f.tag, f.namespace or owner.namespace, known)
        one = lambda v: F.when(v.isNotNull(), _element(tag, F.lit(""), *_text(f.type, v)))
    else:
        tag = _name(f.tag, f.namespace or f.type.namespace, known)
        one = lambda v: F.when(v.isNotNull(), _element(tag, *_parts(f.type, v, known), _blank(f.type, v)))
    if f.many:
        return F.coalesce(F.array_join(F.transform(own, lambda v: F.coalesce(one(v), F.lit(""))), ""), F.lit(""))
    return F.coalesce(one(own), F.lit(""))


def publish(record: Record, value: Column, root: str | None = None, prefixes: dict[str, str] | None = None) -> Column:
    """XML text of a struct; null for a null struct. The root is named after the record unless told otherwise."""
    known = namespaces(record, prefixes)
    declared = "".join(f' xmlns{":" + p if p else ""}="{uri}"' for uri, p in known.items())
    attributes, content = _parts(record, value, known)
    tag = _name(root or record.name, record.namespace, known)
    return F.when(value.isNotNull(), _element(tag, F.concat(F.lit(declared), attributes), content, _blank(record, value)))


def publish_mixed(tag: str, items: Column) -> Column:
    """Mixed content from items in order, as mixed_items gives them: text runs (#text) and children of text."""
    one = lambda i: F.when(i.kind == "#text", S.escape_text(i.value)).otherwise(F.concat(F.lit("<"), i.kind, F.lit(">"), S.escape_text(F.coalesce(i.value, F.lit(""))), F.lit("</"), i.kind, F.lit(">")))
    inside = F.array_join(F.transform(items, one), "")
    return _element(tag, F.lit(""), inside, inside == "")


def content_unwritable(record: Record, value: Column) -> Column:
    """Names of the elements that would be written, each with a semicolon, where they do not follow the record's content pattern;
    null where they do, or there is none."""
    if not record.content:
        return F.lit(None).cast("string")
    tokens = [F.lit("")]
    for f in record.all_fields():
        if f.kind == "element":
            uri, own = f.namespace or record.namespace, value.getField(f.name)
            token = (f"{{{uri}}}" if uri else "") + f"{f.tag};"
            times = F.size(F.filter(own, F.isnotnull)) if f.many else own.isNotNull().cast("int")
            tokens.append(F.coalesce(F.repeat(F.lit(token), F.greatest(times, F.lit(0))), F.lit("")))
    joined = F.concat(*tokens)
    return F.when(value.isNotNull() & ~S.matches(joined, record.content), joined)


def unwritable(record: Record, value: Column) -> Column:
    """Names of scalar fields whose values do not read back as they are: facets, and blanks in items of lexical lists."""
    tests = []
    for f in record.all_fields():
        if isinstance(f.type, Scalar) and not f.many and f.kind != "any_attribute":
            own = value.getField(f.name)
            good = f.type.parse(f.type.text(own)).eqNullSafe(own)
            if f.type.item:
                good = good & F.forall(own, lambda t: F.regexp_like(t.cast("string"), F.lit(r"\A[^ \t\r\n]+\z")))
            tests.append(F.when(own.isNotNull() & ~F.coalesce(good, F.lit(False)), F.lit(f.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
