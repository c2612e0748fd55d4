"""xylem: XML data binding for Spark DataFrames.

Schemas compile to Spark struct types, columns of XML documents are shredded into typed nested columns, validated, published
back to XML and transcoded to and from JSON. Every operation is a DataFrame transformation.
"""
