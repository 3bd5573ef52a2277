"""The pipeline's stages, each against a plain version over the rows it gets."""

import duckdb
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from streakframe.llm import quality, queries, toxicity  # noqa: E402
from streakframe.llm.common import remainder  # noqa: E402
from test_models import plain_score, plain_statistics, walked  # noqa: E402
from test_rows import plain_near_duplicates  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    good = stages[0](spark, docs, SF)
    model = quality.train(spark, docs, labels, "quality", remainder("doc_id", 5) != 0)
    rows = docs.collect()
    assert good.columns == docs.columns and ids(good) == {r.doc_id for r in rows if walked(model, plain_statistics(r.text or "")) >= 0.3}
    clean_rows = labels.where("quality = 1").join(docs, "doc_id")
    assert clean_rows.join(good, "doc_id", "left_semi").count() >= 0.97 * clean_rows.count()

    mild = stages[1](spark, good, SF)
    model = toxicity.train(spark, good, labels, "toxic", remainder("doc_id", 3) != 1)
    assert mild.columns == docs.columns and ids(mild) == {r.doc_id for r in good.collect() if plain_score(model, r.text or "") < 0.7}
    marked = good.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    assert mild.join(marked, "doc_id", "left_semi").count() <= 0.25 * marked.count()

    single = stages[2](spark, mild, SF)
    assert single.columns == docs.columns and ids(single) == set(plain_near_duplicates(mild.collect()))

    pure = stages[3](spark, single, SF)
    con = duckdb.connect()
    con.register("documents", single.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    leaks = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({queries.DECONTAMINATION_SQL})").fetchall()}
    assert leaks and pure.columns == docs.columns and ids(pure) == ids(single) - leaks

    packed = stages[4](spark, pure, SF)
    assert ids(packed) == ids(pure)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_over_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None), (2, ""), (3, "plain words of a text that says little"), (3, "plain words of a text that says little"), (None, "no id"), (5, " ".join(f"w{k}" for k in range(30_000)))]
    for name in ("some", "empty"):
        folder = tmp_path / name
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows if name == "some"], schema)
        clashing = {c: F.lit(c) for c in ("score", "y", "fp", "row", "piece", "part", "_text_hash", "length", "item_id")}
        docs.withColumns(clashing).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted({str(r.doc_id) for r in out}) == (["1", "3", "5", "None"] if name == "some" else [])
