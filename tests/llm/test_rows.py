"""Which rows stay, and which vectors count: nulls, repeated ids with several texts, repeats, overflow, other dimensions."""

import collections
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streakframe.llm import common, components, decontam, knn, langid, quality, queries, simhash, toxicity
from streakframe.llm.common import remainder

ITEM = "the small brown fox that ran over seven lazy dogs and one old cat this morning"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_clean_decides_for_each_text(spark):
    rows = [(None, f"x {ITEM}"), (1, f"{ITEM} y"), (2, "nothing of the kind is in here at all"), (2, f"z {ITEM}"), (None, "clean and without any id"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "k": F.lit(2), "item_id": F.lit("c")})
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    want = sorted([rows[2], rows[4], rows[5], rows[6]], key=repr)
    for settings in ({}, {"constants": 0}):
        got = decontam.clean(spark, docs, bench, **settings)
        assert rows_of(got) == want and got.columns == docs.columns
    assert sorted((r.doc_id for r in decontam.search(spark, docs, bench, constants=0).collect()), key=repr) == sorted([None, 1, 2], key=repr)


def test_clean_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{k} {ITEM}" if k % 3 else f"{k} only words") for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST", 0)
    assert {r.doc_id for r in decontam.clean(spark, docs, bench).collect()} == set(range(0, 30, 3))


def test_keep_one_decides_for_each_text(spark):
    base = [f"w{k}" for k in range(400)]
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    text = " ".join(base)
    unique = " ".join(f"u{k}" for k in range(300))
    rows = [(1, text), (7, near(10)), (7, unique), (None, near(200)), (None, near(300)), (None, "alone and without id"), (9, unique), (9, unique), (4, None), (3, " \n"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "fp": F.lit(2), "fp_1": F.lit(3), "k": F.lit(4)})
    got = simhash.keep_one(spark, docs)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted([(1, text), (7, unique), (None, "alone and without id"), (3, " \n")], key=repr)
    alone = docs.where("doc_id is null")
    assert len(rows_of(simhash.keep_one(spark, alone))) == 2
    assert simhash.keep_one(spark, docs.where("1 = 0")).count() == 0


def test_keep_one_finds_near_copies(spark):
    """Texts in which one word in 45 is another: 5-word shingles share 0.8 or a little more."""
    draw = np.random.default_rng(8)
    rows = []
    for k in range(120):
        words = [f"t{j}" for j in draw.integers(0, 3_000, int(draw.integers(90, 900)))]
        copy = list(words)
        for j in range(int(draw.integers(0, 45)), len(copy), 45):
            copy[j] = f"new{draw.integers(0, 10_000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.keep_one(spark, docs).collect()}
    assert set(range(0, 240, 2)) <= left
    assert sum(k in left for k in range(1, 240, 2)) <= 12


def plain_word_fingerprints(text, lanes):
    found = sorted({xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().lower().split()})
    out = []
    for lane in range(lanes):
        hashes = simhash.mixed(np.array(found, np.uint64), lane).tolist()
        out.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0)
    return out


def test_near_duplicate_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
    least = plain_near_duplicates(docs.collect())
    assert {r.doc_id for r in simhash.keep_one(spark, docs).collect()} == set(least)
    assert len(least) < docs.count()


def plain_near_duplicates(rows):
    """The smallest id of each group of texts that link in any of three fingerprints of their words."""
    prints = [plain_word_fingerprints(r.text, 3) for r in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if any((x ^ y).bit_count() <= 4 for x, y in zip(prints[a], prints[b], strict=True)):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r.doc_id)
    return [min(v) for v in least.values()]


def test_components_of_random_graphs(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (330, 2))]
    parent = {k: k for e in edges for k in e}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.components(spark, df).collect()}
    assert got == {k: find(k) for k in parent if any(k in e and e[0] != e[1] for e in edges)}


def test_vectors_of_great_size_and_of_other_dimensions(spark):
    rows = [(0, [1e160, 1.0]), (1, [1e160, 2.0]), (2, [1.0, 1.0]), (100, [1.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0]), (102, [1.0, 0.5, 0.0]), (200, [2.0]), (300, [4.0, 4.0]), (300, [3.0, 3.0]), (300, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in knn.nearest(spark, df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0][0] == (1, 1.0) and {i for i, _ in got[0]} == {1, 2, 300} and got[0][1][1] == float("inf")
    assert got[100] == [(102, 0.5), (101, 2**0.5)] and 200 not in got
    assert [i for i, _ in got[300]] == [2, 0, 1] and got[300][0][1] == 8**0.5


def test_small_vectors_keep_their_order(spark):
    rows = [(0, [1e-170, 0.0]), (1, [3e-170, 0.0]), (2, [1e-3, 0.0])] + [(k, [float(k), 1.0]) for k in range(3, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [r.vec_id for r in knn.nearest(spark, df, F.col("id") % 100 == 0, k=3).orderBy("rank").collect()]
    assert found == [1, 2, 3]


@pytest.mark.parametrize(("text", "known"), [("½ ² Ⅷ", False), ("½ x", True), ("٣ _ 9", False), ("中", True), ("ª", True)])
def test_letters_are_those_of_unicode(text, known):
    model = langid.fit(["der die das und ist"] * 3 + ["the of and that is"] * 3, ["de"] * 3 + ["en"] * 3)
    assert (model.predict([text])[0][0] != "und") == known


def test_examples_do_not_depend_on_tasks(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " * (k % 7 + 1)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, quality int")
    model = [quality.train(spark, d, labels, "quality", F.lit(True), 50) for d in (docs, docs.repartition(7, "text"))]
    assert all((getattr(model[0], n) == getattr(model[1], n)).all() for n in ("feature", "cut", "leaf"))
    model = [toxicity.train(spark, d, labels, "quality", F.lit(True), 50) for d in (docs, docs.repartition(7, "text"))]
    assert model[0].weight == model[1].weight and model[0].intercept == model[1].intercept


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "b" * 100, "c", "d" * 250, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], ["text", "n"])
    parts = list(common.bounded([batch, batch.slice(0, 0)], most=100))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(7))
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) < 350 for p in parts) and len(parts) >= 3


def test_found_terms_are_swapped_and_scores_move_less(spark):
    """Words as frequent in toxic as in other texts are terms; swapping them moves the score hardly at all once it is penalised."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = remainder("doc_id", 3) == 1
    texts = [r.text or "" for r in docs.join(labels.where("toxic is not null"), "doc_id").where(held).select("text").collect()]
    moved = {}
    for swap in (0.0, 1.0):
        model = toxicity.train(spark, docs, labels, "toxic", ~held, swap=swap)
        own = {a: b for a, b in model.counterpart.items() if a not in toxicity.LISTED}
        assert len(own) >= 20 and all(own[own[a]] == a != own[a] for a in own) and model.twins > 500
        moved[swap] = float(np.abs(model.moved(texts)).mean())
    assert moved[1.0] < 0.1 * moved[0.0]


def test_license_and_decontamination_recall_on_the_tables(spark):
    """The share of shingles in bands, and that no match is lost against the SQL, are what the size classes promise."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sizes = [r.n for r in decontam.items_of(bench).select(F.size("q").alias("n")).distinct().collect()]
    classes = decontam.size_classes(sizes, 0.8, 1e-5)
    known = decontam.sized(decontam.shingled(docs), classes).cache()
    total = known.agg(F.sum(F.size("s"))).first()[0]
    kept = known.agg(*(F.sum(F.size(f"sig.c{k}")) for k in range(len(classes)))).first()
    known.unpersist()
    assert [c.bins is None for c in classes] == [False] * len(classes)
    shares = [k / total for k in kept]
    assert all(s <= bound for s, bound in zip(shares, (0.88, 0.75, 0.6), strict=False)), shares
    assert set(queries.oracle_sql()) >= {"op1_license_scan", "op8_decontamination"}


def test_a_lesser_bound_of_arrow_batches_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("64m", common.ARROW_BYTES), ("1m", 1 << 20), ("1000b", 1000)):
            spark.conf.set(name, given)
            common.ready(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
