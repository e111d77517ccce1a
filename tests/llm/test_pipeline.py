import corpus_pipeline as pipeline
from helpers import edge_docs, save

import __spark_entry__ as entry


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns, name
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= before and len(ids) > 0.5 * len(before), name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert pipeline.STAGES[-1][1](spark, kept, sf_dir).count() == kept.count()


def test_edges(spark, tmp_path, sf_dir):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, quality int").selectExpr("doc_id", "quality", "quality as toxic")
    bench = spark.createDataFrame([(1, "zzz yyy")], "item_id long, text string")
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        save(docs, tmp_path, "documents")
        save(labels, tmp_path, "labels")
        save(bench, tmp_path, "benchmark")
        rows = pipeline.run(spark, str(tmp_path)).collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and not {1, 2, 3, 5} & set(ids)
        if docs.count():
            assert {4, 6, 8, 9, None} <= set(ids)


def test_decisions_take_effect(spark, sf_dir):
    text = "some fairly long english text about the weather of the day and what the people of the town think of it"
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, "the other document of the day has some different words in it"), (1, text)], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]
    other = "an entirely different text under an id that another row has got as well"
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (2, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [(1, text), (2, other)]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, f"before {leak} after"), (2, "nothing of it here")], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.decontamination(spark, docs, sf_dir).collect()] == [2]


def test_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "doc_id as `__text`", "lang as `__lang`", "1 as found_rate", "2 as toxic_score", "3 as text_hash", "4 as c", "5 as node")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).limit(1).count() == 1


def test_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
