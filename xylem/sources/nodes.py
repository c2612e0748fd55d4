"""XML documents as a table of nodes, for what nested structs cannot hold: namespaces, nil, mixed content, wildcards, order.

One narrow pass reads each document into rows; binding, checking and rebuilding are joins, filters and aggregates over them.
Documents with a DTD, an unknown entity or more levels than allowed, and those that are not well formed, become one error row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import scalars as S

XSI = "http://www.w3.org/2001/XMLSchema-instance"
DEPTH = 256
#: node: number in document order. last: greatest number below the node. place: among its parent's nodes. kind: element, text or
#: error. text: of a text node or an error, else the element's own text. closed: written as one tag. type: xsi:type, with its prefix
#: resolved.
NODE = "node int, parent int, last int, depth int, place int, kind string, uri string, name string, qname string, text string, empty boolean, closed boolean, nil boolean, type string, attributes map<string,string>"
NAMES = [c.split()[0] for c in NODE.split(", ")]
#: A further column, read where it is asked for: namespaces by the prefixes that an element's name and attributes have.
USES = "uses map<string,string>"
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split(" ", 1)[1]]) for c in [*NODE.split(", "), USES]])
#: Nodes of a batch of rows.
BATCH = 10_000


class Reader:
    """Nodes of documents, as one list for each column."""

    def __init__(self, limit: int = DEPTH, uses: bool = False):
        self.limit, self.uses = limit, uses
        self.clear()

    def clear(self) -> None:
        self.columns: dict[str, list] = {name: [] for name in SCHEMA.names}

    def __len__(self) -> int:
        return len(self.columns["node"])

    def read(self, xml: str | bytes) -> int:
        """Adds a document's nodes and says how many they are."""
        self.data = xml if isinstance(xml, bytes) else xml.encode()
        self.first, self.done = len(self), False
        self.open: list[int] = []  # rows of open elements
        self.places: list[int] = [0]
        self.scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
        parser = self.parser = expat.ParserCreate(None if isinstance(xml, bytes) else "utf-8")
        parser.buffer_text = True
        parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text
        parser.StartDoctypeDeclHandler = self.refuse
        try:
            parser.Parse(self.data, True)
        except (expat.ExpatError, ValueError) as e:
            if not self.done:  # what follows the root is not looked at
                for column in self.columns.values():
                    del column[self.first :]
                self.add(None, None, 0, None, "error", None, None, None, str(e), None, None, None, None, [])
        return len(self) - self.first

    def refuse(self, *_):
        raise ValueError("document type declarations are not read")

    def add(self, parent, last, depth, place, kind, uri, name, qname, text, empty, closed, nil, type_, attributes, uses=None) -> None:
        values = (len(self) - self.first, parent, last, depth, place, kind, uri, name, qname, text, empty, closed, nil, type_, attributes, uses)
        for column, value in zip(self.columns.values(), values, strict=True):
            column.append(value)

    def resolved(self, name: str, attribute: bool = False) -> tuple[str | None, str]:
        prefix, _, local = name.rpartition(":")
        if not prefix:
            return (None if attribute else self.scopes[-1].get("")), local
        return self.scopes[-1].get(prefix), local

    def below(self) -> tuple[int | None, int]:
        """Parent and place of a node that begins here."""
        place = self.places[-1]
        self.places[-1] += 1
        if not self.open:
            return None, place
        self.columns["empty"][self.open[-1]] = False
        return self.open[-1] - self.first, place

    def start(self, name: str, flat: list[str]) -> None:
        if self.done:
            return
        if len(self.open) >= self.limit:
            raise ValueError(f"more than {self.limit} levels")
        nil, kind, pairs, scope = False, None, [], self.scopes[-1]
        if flat:
            pairs = list(zip(flat[::2], flat[1::2], strict=True))
            own = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
            if own:
                scope, pairs = {**scope, **own}, [(k, v) for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")]
        self.scopes.append(scope)
        for k, v in pairs:
            at = k.rpartition(":")[2]
            if at == "nil" and v.strip() in ("true", "1"):
                nil = True
            if at == "type" and self.resolved(k, attribute=True)[0] == XSI:
                to, what = self.resolved(v.strip())
                kind = f"{{{to}}}{what}" if to else what
        uri, local = self.resolved(name)
        depth, (parent, place) = len(self.open), self.below()
        self.open.append(len(self))
        self.places.append(0)
        uses = None
        if self.uses:
            uses = {name.rpartition(":")[0]: uri or ""} | {k.rpartition(":")[0]: self.resolved(k, attribute=True)[0] for k, _ in pairs if ":" in k}
            uses = [(k, v) for k, v in uses.items() if v is not None and k != "xml"]
        self.add(parent, None, depth, place, "element", uri, local, name, "", True, False, nil, kind, pairs, uses)

    def end(self, name: str) -> None:
        if self.open:
            at = self.open.pop()
            self.columns["last"][at] = len(self) - 1 - self.first
            if self.columns["empty"][at]:
                byte = self.parser.CurrentByteIndex
                self.columns["closed"][at] = self.data[byte - 2 : byte] == b"/>"
            self.places.pop()
            self.scopes.pop()
            self.done = not self.open

    def text(self, data: str) -> None:
        if self.open:
            self.columns["text"][self.open[-1]] += data
            depth, (parent, place) = len(self.open), self.below()
            self.add(parent, len(self) - self.first, depth, place, "text", None, None, None, data, None, None, None, None, [])


def read_nodes(df: DataFrame, key: str, xml: str, limit: int = DEPTH, columns: Sequence[str] = NAMES) -> DataFrame:
    """key and NODE, or some of its columns, for each node of each document; null documents have no nodes."""
    kinds = dict(c.split(" ", 1) for c in [*NODE.split(", "), USES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(limit, "uses" in columns)
        schema = pa.schema([SCHEMA.field(c) for c in columns])

        def out(keys: list, of: pa.Array) -> pa.RecordBatch:
            made = [of.take(pa.array(keys, pa.int32())), *(pa.array(reader.columns[c], schema.field(c).type) for c in columns)]
            reader.clear()
            return pa.RecordBatch.from_arrays(made, [key, *columns])

        for batch in batches:
            keys: list[int] = []
            for i, xml in enumerate(batch.column(1)):
                if xml.is_valid:
                    keys += [i] * reader.read(xml.as_py())
                    if len(keys) >= BATCH:
                        yield out(keys, batch.column(0))
                        keys = []
            if keys:
                yield out(keys, batch.column(0))

    return df.select(key, xml).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def errors(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.filter("kind = 'error'").select(key, F.col("text").alias("error"))


def subtrees(nodes: DataFrame, key: str, tag: str) -> DataFrame:
    """The nodes of each record of a tag (local, or prefixed as written), with record, the number of its first node.

    A record is taken whole, so one inside another of the same tag is not a record of its own. Namespaces were resolved against
    all ancestors, those outside of the record too. One pass over each document's nodes in their order: the greatest end of a
    record so far tells whether a node is in it.
    """
    named = (F.col("kind") == "element") & (F.col("qname") == tag if ":" in tag else F.col("name") == tag)
    so_far = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    outer = named & (F.coalesce(F.max(F.when(named, F.col("last"))).over(before), F.lit(-1)) < F.col("node"))
    found = nodes.withColumn("__outer", outer)
    found = found.withColumns({"record": F.max(F.when(F.col("__outer"), F.col("node"))).over(so_far), "__end": F.max(F.when(F.col("__outer"), F.col("last"))).over(so_far)})
    return found.filter(F.col("node") <= F.col("__end")).drop("__outer", "__end")


def child_tokens(nodes: DataFrame, key: str) -> DataFrame:
    """key, parent and tokens: the names of an element's children in order, each with its namespace and a semicolon."""
    children = nodes.filter("kind = 'element' and parent is not null")
    token = F.concat(F.when(F.col("uri").isNotNull(), F.concat(F.lit("{"), "uri", F.lit("}"))).otherwise(""), "name", F.lit(";"))
    ordered = F.sort_array(F.collect_list(F.struct("place", token.alias("token"))))
    return children.groupBy(key, "parent").agg(F.array_join(ordered.getField("token"), "").alias("tokens"))


def content_violations(nodes: DataFrame, key: str, record) -> DataFrame:
    """key, node, name and tokens of elements whose children do not follow the content pattern that the record has for them."""
    patterns = record.contents()
    if not patterns:
        return nodes.limit(0).select(key, "node", "name", F.lit("").alias("tokens"))
    elements = nodes.filter((F.col("kind") == "element") & F.col("name").isin(*patterns)).select(key, "node", "name")
    found = elements.join(child_tokens(nodes, key).withColumnRenamed("parent", "node"), [key, "node"], "left").withColumn("tokens", F.coalesce("tokens", F.lit("")))
    good = F.lit(False)
    for name, pattern in patterns.items():
        good = F.when(F.col("name") == name, F.regexp_like("tokens", F.lit(rf"\A(?:{pattern})\z"))).otherwise(good)
    return found.filter(~good)


def wrong_roots(nodes: DataFrame, key: str, record) -> DataFrame:
    """key and name of documents whose root is not the record's element, namespace included."""
    roots = nodes.filter("kind = 'element' and parent is null")
    return roots.filter(~((F.col("name") == record.name) & F.col("uri").eqNullSafe(F.lit(record.namespace)))).select(key, "name")


def mixed_items(nodes: DataFrame, key: str) -> DataFrame:
    """key, parent and items: text runs and children of an element in order, as struct(kind, value); text has the kind #text."""
    inner = nodes.filter("parent is not null")
    item = F.struct("place", F.when(F.col("kind") == "text", F.lit("#text")).otherwise(F.col("name")).alias("kind"), F.when(~F.coalesce("nil", F.lit(False)), F.col("text")).alias("value"))
    ordered = F.sort_array(F.collect_list(item))
    return inner.groupBy(key, "parent").agg(F.transform(ordered, lambda i: F.struct(i.kind.alias("kind"), i.value.alias("value"))).alias("items"))


def ordered_items(nodes: DataFrame, key: str, record) -> DataFrame:
    """key, node, name and items, as mixed_items gives them, of the elements whose children may take turns by the record's schema."""
    owners = nodes.filter((F.col("kind") == "element") & F.col("name").isin(*record.ordered_names())).select(key, "node", "name")
    return owners.join(mixed_items(nodes, key).withColumnRenamed("parent", "node"), [key, "node"], "left").select(key, "node", "name", F.coalesce("items", F.array().cast("array<struct<kind:string,value:string>>")).alias("items"))


def wildcard(nodes: DataFrame, known: list[str], namespace: str = "##any", target: str | None = None) -> DataFrame:
    """Elements that a wildcard takes: not among the known names, and in a namespace that it allows."""
    uri = F.col("uri")
    allowed = {
        "##any": F.lit(True),
        "##other": uri.isNotNull() & (uri != F.lit(target or "")),
        "##targetNamespace": uri.eqNullSafe(F.lit(target)),
        "##local": uri.isNull(),
    }.get(namespace, uri.eqNullSafe(F.lit(namespace)))
    return nodes.filter((F.col("kind") == "element") & ~F.col("name").isin(*known) & allowed)


def markup(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys and xml: the text of each group of nodes, which are those of a document or of one of its subtrees, read with USES.

    Names and prefixes are as they were written; the top declares the namespaces that prefixes stand for, and where a prefix stands
    for several, each element that uses it declares its own. A group is as large as its document.
    """
    entry = "array<struct<key:string,value:string>>"
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda p: F.concat(F.lit(" "), p.key, F.lit('="'), S.escape_attribute(p.value), F.lit('"'))), "")
    event = lambda at, side, depth, head, tail, uses: F.struct(at.alias("at"), F.lit(side).alias("side"), depth.alias("depth"), head.alias("head"), tail.alias("tail"), uses.cast(entry).alias("uses"))
    none, nothing = F.array(), F.lit("")
    start = event(F.col("node"), 0, F.lit(0), F.concat(F.lit("<"), "qname"), F.concat(attributes, F.when(F.col("closed"), "/>").otherwise(">")), F.coalesce(F.map_entries("uses"), none.cast(entry)))
    end = event(F.col("last"), 1, -F.col("depth"), F.concat(F.lit("</"), "qname", F.lit(">")), nothing, none)
    text = event(F.col("node"), 0, F.lit(0), S.escape_text(F.col("text")), nothing, none)
    events = F.when(F.col("kind") == "text", F.array(text)).when(F.col("closed"), F.array(start)).otherwise(F.array(start, end))
    rows = nodes.filter("kind in ('element', 'text')").select(*keys, F.explode(events).alias("event"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("event")).alias("events"), F.flatten(F.collect_set("event.uses")).alias("all"))
    pairs = F.array_sort(F.array_distinct("all"))
    shared = F.filter(pairs, lambda p: F.size(F.filter(pairs, lambda q: q.key == p.key)) == 1)
    declared = lambda of: F.array_join(F.transform(of, lambda p: F.concat(F.when(p.key == "", " xmlns").otherwise(F.concat(F.lit(" xmlns:"), p.key)), F.lit('="'), S.escape_attribute(p.value), F.lit('"'))), "")
    top = F.filter("shared", lambda p: p.value != "")
    own = lambda e: F.filter(e.uses, lambda p: ~F.exists("shared", lambda q: q.key == p.key))
    shown = F.transform("events", lambda e, i: F.concat(e.head, F.when(i == 0, declared(top)).otherwise(""), declared(own(e)), e.tail))
    return grouped.withColumn("shared", shared).select(*keys, F.array_join(shown, "").alias("xml"))


def any_attributes(attributes: Column, known: list[str]) -> Column:
    """Attributes whose local names no field has, under the names that were written."""
    return F.map_filter(attributes, lambda k, _: ~F.regexp_replace(k, "^[^:]*:", "").isin(*known))
