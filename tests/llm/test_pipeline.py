from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm import cases
from tests.llm.cases import edited, prose
from tests.llm.test_near_and_repeats import shingles
from xylem.llm import queries


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing to target weights", "packing"]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_of_corpus_queries(spark, name):
    con, sf_dir = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_one_after_the_other(spark):
    """Each stage's decisions, checked by hand on its own input."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    inputs, staging = [docs], corpus_pipeline.Staging(spark, "test")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(staging.save(stage(spark, inputs[-1], sf_dir), f"s{i}"))
    raw, good, single, cut, mixed = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in inputs[:5])
    assert all(x.columns == docs.columns for x in inputs[:5])
    clean = {i for i, x in labels.items() if x == (1, 0)}
    assert len([i for i in clean & set(raw) if i not in good]) <= 8 and not any(t is None or len(t.split()) < 20 for t in good.values())
    sets = {i: shingles(t) for i, t in good.items()}
    gone = set(good) - set(single)
    assert gone and all(any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets if j < i) or any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in gone - {i}) for i in gone)
    assert set(cut) == set(single) and any(cut[i] != single[i] for i in cut) and all(len(cut[i]) <= len(single[i]) for i in cut)
    assert all(r.n_chars == len(r.text) for r in inputs[3].collect())
    toxic = {i for i, x in labels.items() if x[1] == 1} & set(cut)
    assert len(toxic & set(mixed)) <= 0.1 * len(toxic) and len(clean & set(cut) - set(mixed)) <= 0.01 * len(clean & set(cut))
    pieces = inputs[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {p.doc_id for p in pieces} == set(mixed) and all(p.n == p.of for p in pieces)


def test_whole_run_on_awkward_documents(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, int(rng.integers(25, 90))), "en", "s", 1) for i in range(20)] + [(30, prose(300, 80), "en", "s", 1), (31, prose(300, 80), "en", "s", 1), (None, edited(prose(0, 60), 1, 1), None, None, None), (40, None, None, None, None), (41, "", "", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(20), 30]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in got and 30 in got and not got & {31, 40, 41} and set(range(20)) <= got
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_take_awkward_rows_one_by_one(spark, tmp_path):
    """Clashing columns, nulls, blanks, repeated rows, and one id for two texts: each stage's rows by what it may do to them."""
    spark.createDataFrame([(1, 1, 0), (20, 1, 0), (5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = [(900, prose(700 + i, 60), *cases.rows()[0][2:]) for i in range(2)] * 2
    docs = spark.createDataFrame([*cases.rows(), *shared], cases.SCHEMA).repartition(3)
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out, nothing = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0
        if name == "packing":
            pieces = out.collect()
            assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and sum(p.start == 0 for p in pieces) == before.total()
            continue
        assert out.columns == docs.columns == nothing.columns
        rows = out.collect()
        after = Counter((r.doc_id, r.text) for r in rows)
        assert all(r.node == 1 and r.record == "r" and bytes(r.digest) == b"d" for r in rows)
        if name == "suffix-array dedup":
            assert Counter(i for i, _ in after.elements()) == Counter(i for i, _ in before.elements())
        else:
            assert not after - before
        if name == "quality rules":
            assert not any((t or "").strip() == "" or len(t.split()) < 20 for _, t in after)
        if name == "n-gram Jaccard join":  # one row of each text that has words, all of those that have none
            assert all(n == (1 if (t or "").split() else before[i, t]) for (i, t), n in after.items())
            assert {t for i, t in after if i == 900} == {t for i, t in before if i == 900} and {i for i, t in before if not (t or "").split()} <= {i for i, _ in after}
