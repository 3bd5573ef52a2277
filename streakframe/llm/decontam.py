"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size, powers of two of their number of word shingles, and documents by theirs. A document has MinHash
bands for each partition of items, so many that an item of which it holds the wanted share meets it in some band with all but
a stated chance, however long the document is: the larger a partition's items, the fewer bands (`minhash.py`). Partitions of
items so small that bands would keep nearly all shingles look up all of them. What meets is verified by the exact share of the
item's shingles that the document has. Everything is a DataFrame expression. The items' shingles go into the plan as constants
while their number is within a bound that is checked first; beyond it they are joined by hash.

Defined cases: null, empty and blank texts and items match nothing; a text or item shorter than a shingle is one shingle;
items of equal text match each; rows that repeat an item are one item; search() returns documents of one id as one document,
those without id too; clean() decides for each text, whatever its id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import fresh, once, row_key, saved, shingle_hashes, words
from streakframe.llm.minhash import SizeClass, finest, meeting, nested_signatures, size_classes

SIZE = 5
SHARE = 0.8
#: Most shingle hashes of all items together that go into the plan as constants.
CONSTANTS = 50_000
#: Most keys of documents that clean() broadcasts, 16 bytes each; more are joined by a shuffle.
BROADCAST = 100_000


def items_of(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, q): the distinct shingle hashes of each item that has any."""
    q = F.array_distinct(shingle_hashes(words(F.col("text")), size))
    return benchmark.where("item_id is not null").select("item_id", q.alias("q")).where(F.size("q") > 0).distinct()


def shingled(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, k, k_2, s): key and distinct shingle hashes in ascending order of each document that has any."""
    k, k_2 = row_key()
    own = F.sort_array(F.array_distinct(shingle_hashes(words(F.col("text")), size)))
    found = once(docs.where(F.col("text").isNotNull()).select("doc_id", "text", k.alias("k"), k_2.alias("k_2")), ["doc_id", "k", "k_2"], s=own)
    return found.where(F.size("s") > 0)


def sized(known: DataFrame, classes: list[SizeClass]) -> DataFrame:
    """shingled() with `sig`: the bands for each class of items."""
    return once(known, ["doc_id", "k", "k_2", "s"], sig=nested_signatures(F.col("s"), F.size("s"), classes))


def pairs(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = SHARE, chance: float = 1e-5, constants: int = CONSTANTS) -> DataFrame:
    """(doc_id, k, k_2, item_id, n_shingles, matched, containment): matches by the documents' row keys.

    chance: a match of the least wanted share is missed with this chance at most; one of all the item's shingles far less often.
    """
    items = items_of(benchmark, size)
    n = F.size("q")
    sizes = [r.n for r in items.groupBy(F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)).agg(F.max(n).alias("n")).collect()]  # one of each power of two
    classes = size_classes(sizes, share, chance)
    known = shingled(docs, size)
    total = items.agg(F.sum(F.size("q"))).first()[0] or 0
    found = _by_constants(known, items, classes) if total <= constants else _by_join(known, items, classes)
    return found.withColumn("containment", F.col("matched") / F.col("n_shingles")).where(F.col("containment") >= share)


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, n_shingles, matched, containment): each pair with at least `share` of the item's shingles in the document."""
    found = pairs(spark, docs, benchmark, **settings)
    rows = found.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("matched").alias("matched"))
    return rows.withColumn("containment", F.col("matched") / F.col("n_shingles"))


def _by_constants(known: DataFrame, items: DataFrame, classes: list[SizeClass]) -> DataFrame:
    rows = items.collect()  # within CONSTANTS
    spark, kind = known.sparkSession, items.schema["item_id"].dataType.simpleString()
    by_class = {c: {h for r in rows if c.low < len(r.q) <= c.high for h in r.q} for c in classes}
    every = {h for hashes in by_class.values() for h in hashes}
    listed = ",".join(f"{h}L" for h in sorted(every)) or "null"
    key, banded = ["doc_id", "k", "k_2", "s"], [c for c in classes if c.bins is not None]
    # most documents meet nothing in the bands of the smallest items, and so nothing in any others
    first = {c: by_class[c] if c.bins is None else {h for b in banded for h in by_class[b]} for c in finest(classes)}
    least = banded[-1].bins if banded else None
    some = once(known, key, sig=nested_signatures(F.col("s"), F.size("s"), finest(classes), least))
    some = once(some, key, any=meeting(finest(classes), first)).where(F.size("any") > 0)
    met = once(once(some, key, sig=nested_signatures(F.col("s"), F.size("s"), classes)), key, met=meeting(classes, by_class)).where(F.size("met") > 0)
    # of a document that met any item only the items' shingles go on
    held = once(met, ["doc_id", "k", "k_2", "met"], s=F.expr(f"filter(s, h -> h in ({listed}))"))
    of_hash = spark.createDataFrame([(r.item_id, h) for r in rows for h in r.q], f"item_id {kind}, hash long").groupBy("hash").agg(F.collect_set("item_id").alias("items"))
    item = spark.createDataFrame([(r.item_id, r.q) for r in rows], f"item_id {kind}, q array<long>")
    hits = held.select("doc_id", "k", "k_2", "s", F.explode("met").alias("hash")).join(F.broadcast(of_hash), "hash")
    tested = hits.select("doc_id", "k", "k_2", "s", F.explode("items").alias("item_id")).join(F.broadcast(item), "item_id")
    found = tested.select("doc_id", "k", "k_2", "item_id", F.size("q").alias("n_shingles"), F.size(F.array_intersect("q", "s")).alias("matched"))
    return found.groupBy("doc_id", "k", "k_2", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("matched").alias("matched"))


def _by_join(known: DataFrame, items: DataFrame, classes: list[SizeClass]) -> DataFrame:
    n = F.size("q")
    which = F.coalesce(*(F.when((n > c.low) & (n <= c.high), F.lit(k)) for k, c in enumerate(classes)), F.lit(-1))
    bands = items.select("item_id", which.alias("class"), F.explode("q").alias("hash"))
    own, k = [], 0
    for c in classes:
        own.append(F.col("s") if c.bins is None else F.col(f"sig.c{k}"))
        k += c.bins is not None
    sides = F.posexplode(F.array(*own) if own else F.array().cast("array<array<long>>")).alias("class", "all")
    each = sized(known, classes).select("k", "k_2", sides).select("k", "k_2", "class", F.explode("all").alias("hash"))
    met = each.join(bands, ["class", "hash"]).select("k", "k_2", "item_id").distinct()
    rows = known.select("doc_id", "k", "k_2", "s").dropDuplicates(["k", "k_2"])
    tested = met.join(rows, ["k", "k_2"]).join(items, "item_id")
    return tested.select("doc_id", "k", "k_2", "item_id", F.size("q").alias("n_shingles"), F.size(F.array_intersect("q", "s")).alias("matched"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents whose text holds no item. Rows are told apart by id and text, so that one text's match spares the others."""
    own = [fresh(n, docs.columns) for n in ("_key", "_key_2")]
    found = pairs(spark, docs, benchmark, **settings).select(F.col("k").alias(own[0]), F.col("k_2").alias(own[1])).distinct()
    bad = saved(spark, found, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST else bad.hint("merge")
    keyed = docs.withColumns(dict(zip(own, row_key(), strict=True)))
    return keyed.join(bad, own, "left_anti").select(docs.columns)
