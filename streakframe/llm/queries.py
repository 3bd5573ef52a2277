"""The registered queries opN_<name> over the given tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm import decontam, knn, langid, licenses, lm, packing, quality, simhash, tokenfile, toxicity
from streakframe.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 5) == 0
    model = quality.train(spark, docs, labels, "quality", ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(spark, table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = langid.train(spark, docs, ~held)
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write(spark, table(spark, sf_dir, "documents"), "word_bpe_49k.json", end=2)
    return tokenfile.read(spark, files)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 10) == 0
    model = lm.train(spark, docs.where(~held))
    scored = lm.score(docs, model)
    known = F.lit(model.train_tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", known, "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 3) == 1
    model = toxicity.train(spark, docs, labels, "toxic", ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end=0)
    return packing.pack(spark, cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_simhash_groups": op3_simhash_groups,
        "op4_language_id": op4_language_id,
        "op5_token_files": op5_token_files,
        "op6_nearest_vectors": op6_nearest_vectors,
        "op7_lm_scores": op7_lm_scores,
        "op8_decontamination": op8_decontamination,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
    }


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d
) WHERE rank <= 10
"""

_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
_WORDS = r"list_filter(regexp_split_to_array(lower({text}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATION_SQL = f"""
WITH iw AS (SELECT DISTINCT item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, list_distinct({_SHINGLES}) AS q FROM iw),
q AS (SELECT item_id, len(q) AS n, unnest(q) AS s FROM i),
dw AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, unnest(list_distinct({_SHINGLES})) AS s FROM dw)
SELECT doc_id, item_id, n::INT AS n_shingles, count(*)::INT AS matched, count(*) / n AS containment
FROM d JOIN q USING (s) GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8
"""


def license_sql() -> str:
    plain = r"""regexp_replace(regexp_replace({text}, '[.,;:()"]+([\x20\x09-\x0D]|$)', '\1', 'g'), '(^|[\x20\x09-\x0D])[("]+', '\1', 'g')"""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES.items())
    w = _WORDS.format(text=plain.format(text="text"))
    return f"""
WITH t0(license, text) AS (VALUES {values}),
tw AS (SELECT license, {w} AS w FROM t0),
t AS (SELECT license, list_distinct({_SHINGLES}) AS q FROM tw),
step AS (SELECT max(len(q)) AS stride FROM t),
dw AS (SELECT doc_id, {w} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_SHINGLES} AS s FROM dw),
win AS (SELECT doc_id, s, stride, unnest(range(0, greatest(len(s) - stride - 1, 0) + 1, stride)) AS "window" FROM d, step WHERE len(s) > 0),
ws AS (SELECT DISTINCT doc_id, "window", unnest(s["window" + 1 : "window" + 2 * stride]) AS x FROM win),
tq AS (SELECT license, len(q) AS n, unnest(q) AS x FROM t),
m AS (SELECT doc_id, "window", license, n, count(*) AS k FROM ws JOIN tq USING (x) GROUP BY ALL HAVING count(*) / n >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY k DESC, "window") AS place FROM m)
SELECT doc_id, license, n::INT AS n_shingles, k::INT AS matched, k / n AS containment, "window"::INT AS "window" FROM r WHERE place = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op6_nearest_vectors": NEAREST_SQL, "op8_decontamination": DECONTAMINATION_SQL}
