"""Columns of XML documents to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.functions import scalars as S
from xylem.plans.schema import Record, no_violations, one_violation
from xylem.sources.nodes import any_attributes, read_nodes

MALFORMED = "__malformed"
#: Elements and attributes match by local name, text is not trimmed, unknown markup is skipped, documents that are not read are kept.
OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def root_of(xml: Column) -> tuple[Column, Column]:
    """Namespace (null for none) and local name of a document's root, from its start tag."""
    tag = F.regexp_extract(xml, r"(?s)\A\uFEFF?(?:\s+|<\?.*?\?>|<!--.*?-->)*(<[^\s/>]+(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)
    name = F.regexp_extract(tag, r"\A<([^\s/>]+)", 1)
    prefix = F.regexp_extract(name, r"\A([^:]*):", 1)
    key = F.concat(F.lit(r"(?s)\sxmlns"), F.when(prefix != "", F.concat(F.lit(":"), prefix)).otherwise(""), F.lit(r"\s*=\s*[\"']([^\"']*)"))
    uri = F.call_function("regexp_extract", tag, key, F.lit(1))
    return F.nullif(uri, F.lit("")), F.regexp_replace(name, r"\A[^:]*:", "")


def shred(df: DataFrame, xml: str, record: Record, into: str = "record", errors: str = "errors", columns: list[str] | None = None, strict_root: bool = False, key: str | None = None) -> DataFrame:
    """df with a struct of typed fields and an array of violations; columns keeps from_xml from reading more than is needed.

    Null documents have a null struct and no violations. Documents that are not well formed, or use undefined entities, have a struct
    of nulls and the violation "well-formed document" without a field. strict_root: a root that is not the record's element, its
    namespace included, is a violation too. A document is read a second time, in pieces, only where a scalar's text holds a "<".
    key: a column that tells documents apart; with it, the root's any_attribute field is filled in from the node reader, by a join.
    Without it, and below the root, such fields are null.
    """
    wanted = record.only(*columns) if columns else record
    doc, raw = F.col(xml), F.col("__raw")
    # explode() of one row is a barrier: filters of what is typed are not pushed below it, where they would read documents again
    parsed = df.select("*", F.explode(F.array(F.from_xml(doc, wanted.read_schema().add(MALFORMED, "string"), OPTIONS))).alias("__raw"))
    pieces = F.from_xml(doc, wanted.read_schema(pieces=True), OPTIONS)
    pieces = F.when(raw[MALFORMED].isNull() & F.contains(raw.cast("string"), F.lit("<")), pieces)
    mended = F.transform(F.array(pieces), lambda p: F.when(p.isNotNull(), wanted.mended(raw, p)).otherwise(wanted.same(raw)))
    parsed = parsed.select("*", F.explode(mended).alias("__whole"))
    whole = F.col("__whole")
    malformed = raw[MALFORMED].isNotNull()
    found = [F.when(malformed, one_violation("syntax", "", "well-formed document", raw[MALFORMED])).otherwise(no_violations())]
    if strict_root:
        uri, name = root_of(doc)
        good = (name == record.name) & uri.eqNullSafe(F.lit(record.namespace))
        expected = f"element {{{record.namespace}}}{record.name}" if record.namespace else f"element {record.name}"
        found.append(F.when(~malformed & ~good, one_violation("root", "", expected, S.clark_name(uri, name))).otherwise(no_violations()))
    found.append(F.when(malformed, no_violations()).otherwise(wanted.violations(whole)))
    out = parsed.withColumns({into: wanted.typed(whole), errors: F.concat(*found)}).drop("__raw", "__whole")
    rest = next((f.name for f in wanted.fields if f.kind == "any_attribute"), None)
    if key and rest:
        roots = read_nodes(df, key, xml, columns=["node", "kind", "attributes"]).filter("node = 0 and kind = 'element'")
        known = [f.tag for f in wanted.fields if f.kind == "attribute"]
        found_there = roots.select(F.col(key).alias("__key"), any_attributes(F.col("attributes"), known).alias("__rest"))
        out = out.join(found_there, F.col(key) == F.col("__key"), "left").withColumn(into, F.when(F.col(into).isNotNull(), F.col(into).withField(rest, F.col("__rest")))).drop("__key", "__rest")
    return out


def valid(df: DataFrame, mode: str = "PERMISSIVE", errors: str = "errors") -> DataFrame:
    """PERMISSIVE keeps all rows, DROPMALFORMED those without violations, FAILFAST raises on the first."""
    if mode == "PERMISSIVE":
        return df
    clean = F.size(errors) == 0
    if mode == "DROPMALFORMED":
        return df.filter(clean)
    message = F.concat(F.lit("invalid document: "), F.to_json(F.col(errors)))
    return df.withColumn(errors, F.when(clean, F.col(errors)).otherwise(F.raise_error(message).cast(df.schema[errors].dataType)))
