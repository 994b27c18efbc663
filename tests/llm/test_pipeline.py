"""The corpus pipeline on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c
    from lattica.llm import near_copies, piece_encoding, rule_ensemble

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    seen = []
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, before, SF)
        assert k == len(c.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"]: r["text"] for r in before.collect()})
    good = {r["doc_id"] for r in rule_ensemble.classify(docs, labels).where("predicted = 1").collect()}
    assert set(seen[0]) == good
    classes = near_copies.near_copies(docs.where(docs.doc_id.isin(list(good)))).collect()
    assert set(seen[1]) == {r["class_id"] for r in classes}
    assert set(seen[2]) == set(seen[1])
    assert set(seen[4]) == set(seen[3]) <= set(seen[2])
    run = sorted((r["doc_id"], r["n_tokens"]) for r in c.run(spark, SF).collect())
    assert run == sorted((r["doc_id"], r["n_tokens"]) for r in before.collect())
    digests = {r["doc_id"]: r["n_tokens"] for r in piece_encoding.encoding_digests(spark.read.parquet(str(tmp_path / "3"))).collect()}
    assert {i for i, _ in run} == set(digests)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} and len({n.split("_")[0] for n in names if n.startswith("op")}) == 10


def test_queries_against_their_sql(spark):
    """Every row of the queries that have SQL, as DuckDB has it."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name in ("op4_host_rules", "op5_pii", "op6_mixing", "op7_near_copies"):
        rows, want = e.queries()[name](spark, SF), con.execute(e.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(rows.columns) == sorted(columns)
        assert sorted(map(tuple, rows.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_a_failed_stage_leaves_nothing(spark, monkeypatch):
    import corpus_pipeline as c
    from lattica.llm.common import shared_folder

    def fails(*_):
        raise RuntimeError("stage")

    monkeypatch.setattr(c, "STAGES", [("a", lambda spark, docs, sf: docs), ("b", fails), *c.STAGES[2:]])
    def left():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        return {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}

    before = left()
    with pytest.raises(RuntimeError):
        c.run(spark, SF)
    assert left() == before
