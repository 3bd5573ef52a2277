"""Operators of the llm subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import math
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streakframe.llm import components, decontam, knn, langid, licenses, lm, minhash, packing, quality, queries, simhash, tokenfile, tokens, toxicity
from streakframe.llm.common import remainder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeats, a null id, and columns whose names operators use inside."""
    long = " ".join(f"word{k % 977} of" for k in range(12_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "One two three"), (6, "one  TWO\tthree"), (7, long), (8, long + " tail"), (8, long + " tail"), (9, "é Σ 中 <|endoftext|> \x00 ok"), (None, "no id here at all"), (10, "12345 !!")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    return df.withColumns({"score": F.lit("s"), "fp": F.lit(1), "row": F.lit("r"), "length": F.lit(2.5), "part": F.lit("p"), "s": F.lit(0), "y": F.lit(None).cast("string"), "w": F.lit(1)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


# simhash


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(values, bits=4):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(values))]


def check_groups(spark, df):
    got = simhash.groups(spark, df).collect()
    rows = df.select("doc_id", "text").collect()
    values = [plain_fingerprint(r.text) for r in rows]
    roots = plain_groups(values)
    least = collections.defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        least[root].append(r.doc_id)
    name = {root: min((i for i in ids if i is not None), default=None) for root, ids in least.items()}
    want = sorted((repr(r.doc_id), f"{v:016x}", repr(name[root])) for r, v, root in zip(rows, values, roots, strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


def test_simhash_groups(spark, odd, none):
    check_groups(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(150))
    check_groups(spark, odd)
    assert simhash.groups(spark, none).count() == 0


def test_simhash_links_of_every_kind_of_list(spark, monkeypatch):
    draw = np.random.default_rng(0)
    centres = draw.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    values = list(centres)
    for c in centres[:5]:
        for _ in range(60):
            flips = draw.choice(64, draw.integers(1, 5), replace=False)
            values.append(np.uint64(int(c) ^ sum(1 << int(b) for b in flips)))
    values = np.unique(np.array(values, np.uint64))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = plain_groups([int(v) for v in values])
    want = len(set(roots))
    for longest in (20_000, 20):
        monkeypatch.setattr(simhash, "LIST", longest)
        monkeypatch.setattr(simhash, "_CHUNK", 500)
        edges = simhash.links(spark, df)
        assert all((int(np.int64(r.a).view(np.uint64)) ^ int(np.int64(r.b).view(np.uint64))).bit_count() <= 4 for r in edges.collect())
        found = components.components(spark, edges)
        assert df.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp")).distinct().count() == want


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(5, 60)} == {5} and got[300] == 299
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, odd):
    left = simhash.keep_one(spark, odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x)) == [1, 4, 5, 7, 9, 10, None]


# minhash, licenses, decontamination


def test_signature_and_its_settings(spark):
    draw = np.random.default_rng(1)
    hashes = draw.integers(-(1 << 63), (1 << 63) - 1, 300).tolist()
    df = spark.createDataFrame([(hashes,)], "h array<long>")
    for bins in (16, 500, 70_001):
        assert df.select(minhash.signature(F.sort_array("h"), F.lit(bins).cast("long"))).first()[0] == minhash.signature_of(hashes, bins)
    # a class's bands are a part of those of smaller sets
    classes = minhash.size_classes([12, 20, 60, 200], 0.8, 1e-5)
    kept = df.select(minhash.nested_signatures(F.sort_array("h"), F.size("h"), classes).alias("s")).select("s.*").first()
    assert len(kept) == 4 and all(set(kept[k + 1]) < set(kept[k]) for k in range(3)) and set(kept[0]) < set(hashes)
    for c, found in zip(classes, kept, strict=True):
        assert minhash.kept_share(c.bins) - 0.08 <= len(found) / 300 <= minhash.kept_share(c.bins * 1.2) + 0.08
    for shared in (5, 20):
        bins = minhash.bins_for(shared, 1e-2)
        assert minhash.miss(shared, bins) <= 1e-2 < minhash.miss(shared, bins * 0.99)
        missed = 0
        for _ in range(500):
            both, other = draw.integers(-(1 << 63), (1 << 63) - 1, shared).tolist(), draw.integers(-(1 << 63), (1 << 63) - 1, 400 - shared).tolist()
            missed += not set(both) & set(minhash.signature_of(both + other, math.ceil(400 * bins)))
        assert missed / 500 <= 0.03


@pytest.mark.parametrize("size", [1, 3, 8, 12, 30, 100, 300])
def test_bands_keep_less_of_a_text_the_longer_the_items_are(spark, size):
    """Recall is measured at the least share that counts as a match."""
    draw = np.random.default_rng(size)
    new = lambda n: draw.integers(-(1 << 63), (1 << 63) - 1, n).tolist()
    (c,) = minhash.size_classes([size], 0.8, 1e-5)
    rows, found, kept = [], 0, 0.0
    for _ in range(200):
        item = new(size)
        rows.append((item, item[: math.ceil(0.8 * size)] + new(int(draw.integers(size, 20 * size + 50)))))
    if c.bins is None:
        assert size <= 8
        return
    df = spark.createDataFrame(rows, "q array<long>, h array<long>")
    sig = minhash.nested_signatures(F.sort_array("h"), F.size("h"), [c])
    found, kept = df.select(F.avg(F.arrays_overlap("q", sig.getField("c0")).cast("int")), F.sum(F.size(sig.getField("c0"))) / F.sum(F.size("h"))).first()
    assert found >= 0.99 and kept <= {12: 0.85, 30: 0.7, 100: 0.3, 300: 0.12}[size]


def duck(tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con


def test_license_scan_says_what_its_sql_says(spark, odd, none):
    filler = " ".join(f"w{k}" for k in range(300))
    rows = [(1, f"{filler} Licensed under the Apache License, Version 2.0. {filler}"), (2, licenses.TEMPLATES["MIT-permission"].upper()), (3, filler), (4, f"x Released under the MIT\nLicense, {filler} released under the MIT License"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, f'{filler} {licenses.TEMPLATES["Apache-2.0-header"]}')]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = licenses.scan(spark, df).toPandas().sort_values(["doc_id", "license"]).reset_index(drop=True)
    want = duck({"documents": df.toPandas()}).execute(queries.license_sql()).df().sort_values(["doc_id", "license"]).reset_index(drop=True)
    assert got[want.columns].astype(str).to_numpy().tolist() == want.astype(str).to_numpy().tolist()
    found = set(zip(got.doc_id, got.license, strict=True))
    assert {(1, "Apache-2.0"), (2, "MIT-permission"), (4, "MIT"), (7, "CC-BY-NC-4.0"), (8, "Apache-2.0-header")} <= found and 3 not in set(got.doc_id)
    assert licenses.scan(spark, odd).count() == 0 and licenses.scan(spark, none).count() == 0


def test_decontamination_finds_items_in_long_texts_both_ways(spark, odd, none):
    draw = np.random.default_rng(3)
    word = lambda n: " ".join(f"t{k}" for k in draw.integers(0, 5000, n))
    items = [(k, word(int(n))) for k, n in enumerate((3, 8, 20, 60, 60, 4))] + [(6, None), (7, ""), (8, "the same item twice over here"), (9, "the same item twice over here")]
    texts = [word(15_000) + " " + items[3][1].upper() + " " + word(15_000), items[1][1], word(400) + "\n" + items[2][1], items[0][1], " ".join(items[4][1].split()[:55]), " ".join(items[4][1].split()[:30]), "oh the same item twice over here oh", None, "", word(5)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = duck({"documents": docs.toPandas(), "benchmark": bench.toPandas()}).execute(queries.DECONTAMINATION_SQL).df()
    want = sorted(map(tuple, want[["doc_id", "item_id", "n_shingles", "matched"]].to_numpy().tolist()))
    assert {(a, b) for a, b, *_ in want} == {(0, 3), (1, 1), (2, 2), (3, 0), (4, 4), (6, 8), (6, 9)}
    for constants in (50_000, 0):
        got = decontam.search(spark, docs, bench, constants=constants)
        assert sorted((r.doc_id, r.item_id, r.n_shingles, r.matched) for r in got.collect()) == want
    assert sorted(r.doc_id for r in decontam.clean(spark, docs, bench).collect()) == [5, 7, 8, 9]
    assert decontam.search(spark, odd, bench).count() == 0 and decontam.search(spark, none, bench).count() == 0
    assert decontam.search(spark, docs, bench.where("1 = 0")).count() == 0 and decontam.clean(spark, odd, bench).columns == odd.columns


# classifiers


def test_trees_are_walked_as_they_were_grown():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = quality.fit(x, y, trees=40)
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    margin = np.full(len(x), model.base)
    for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        for k, row in enumerate(x):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            margin[k] += leaf[node - (2**model.depth - 1)]
    assert score == pytest.approx(1 / (1 + np.exp(-margin)))
    assert quality.fit(x, np.ones(600)).score(x[:2]) == pytest.approx([601 / 602] * 2)
    assert quality.statistics([b""]).sum() == 0


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_score_every_row(spark, odd, none, operator):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (None, 1), (10, None)], "doc_id long, quality int")
    for train_on in (labels, labels.where("1 = 0"), labels.where("quality = 1")):
        model = operator.train(spark, odd, train_on, "quality", F.lit(True))
        rows = operator.score(odd, model, ["doc_id", "fp"]).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 and r.fp == 1 for r in rows)
    assert operator.score(none, model).count() == 0


@pytest.mark.parametrize(("name", "label", "cut", "n", "rest"), [("op2_quality_classifier", "quality", 0.3, 5, 0), ("op9_toxicity", "toxic", 0.7, 3, 1)])
def test_held_out_accuracy(spark, name, label, cut, n, rest):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 1000 and (got.held_out == [crc32(str(i).encode()) % n == rest for i in got.doc_id]).all() and (got.predicted == (got.score >= cut)).all()
    held = got[got.held_out & got[label].notna()]
    assert (held.predicted == held[label]).mean() > 0.93


def test_swapped_identity_terms_move_scores_less():
    draw = np.random.default_rng(2)
    texts, y = [], []
    for k in range(600):
        words = [f"w{j}" for j in draw.integers(0, 200, 12)]
        bad = k % 3 == 0
        words += ["idiot"] * bad + ["muslim"] * int(draw.random() < (0.8 if bad else 0.05)) + ["christian"] * int(draw.random() < (0.05 if bad else 0.3))
        texts.append(" ".join(words))
        y.append(float(bad))
    found = [toxicity.words_of(t) for t in texts]
    x, twins = [toxicity._vector(f) for f in found], [toxicity._vector(toxicity.twin(f)) for f in found]
    gap = {}
    for swap in (0.0, 30.0):
        model = toxicity.fit(x, twins, np.array(y), swap=swap)
        a, b = model.score(["we met a muslim", "we met a christian"])
        gap[swap] = abs(a - b)
        assert model.score(["you idiot w1 w2 w3"])[0] > 0.7
    assert gap[30.0] < 0.5 * gap[0.0]


def test_codewords_are_apart():
    for n in (2, 4, 5, 9):
        code = langid.codewords(n)
        assert all((code[a] != code[b]).sum() >= max(1, code.shape[1] // 4) for a in range(n) for b in range(a))
    assert langid.codewords(4).shape == (4, 7)


def test_language_id(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    model = langid.fit(["der die das und ist"] * 3 + ["the of and that is"] * 3, ["de"] * 3 + ["en"] * 3)
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert len(rows) == 11 and all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (1, 2, 3, 10)) and rows[5].lang_pred in ("de", "en")
    assert langid.predict(none, model).count() == 0
    nothing = langid.train(spark, odd, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    single = langid.fit(["abc def"], ["xx"])
    assert single.predict(["hello", "1"])[0] == ["xx", "und"]


# tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(name, documents):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    parts = ["a", "Be", "é", "Σ", "ς", "ß", " ", "  ", "\n", "\t", " \n ", "1", "23", "'s", "'LL", "…", "́", "中", "<|endoftext|>", "\x1c", "\xa0", "²", "_", "!!", "İ", "👍", "\r\n", "Ö", "×", "the"]
    draw = np.random.default_rng(9)
    texts = ["".join(parts[k] for k in draw.integers(0, len(parts), n)) for n in draw.integers(0, 15, 3000)] + documents.text.head(60).tolist() + [None, ""]
    got = tokens.encoder(name).ids(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_look_up_tables_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "_PIECES", 200_000)
    monkeypatch.setattr(tokens, "_WORDS", 200_000)
    encode, plain = tokens.Encoder("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw, most = np.random.default_rng(4), 0
    for _ in range(30):
        # words of 300 letters, with a comma and without, of which none comes twice
        text = " ".join("".join(map(chr, draw.integers(97, 123, 300))) + end for end in ("", ",") * 30)
        assert encode.ids(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        most = max(most, *(sum(len(k) + len(v) for k, v in t.items()) for t in (encode.led, encode.words)))
    assert most < 400_000
    assert encode.share == tokens.encoder("word_bpe_49k.json").share == 1 and tokens.encoder("word_bpe_49k.json", 0.25).share == 0.25


def test_token_index_in_one_folder_once(spark, tmp_path):
    rows = [(k, "a text " * k) for k in range(200)]
    docs = spark.createDataFrame(rows, "k int, text string")
    for n, kind in enumerate(("k", "cast(k as string)", "cast(k as decimal(20, 3))", "timestamp_seconds(k)", "cast(date_add(date'2020-01-01', k) as date)")):
        files = tokenfile.write(spark, docs.selectExpr(f"{kind} AS doc_id", "text"), "word_bpe_49k.json", 2, folder=f"file://{tmp_path}/{n}")
        want = docs.selectExpr(f"{kind} AS doc_id").collect()
        assert sorted(r.doc_id for r in tokenfile.read(spark, files).collect()) == sorted(r.doc_id for r in want)
        assert files.index.schema["doc_id"].dataType == docs.selectExpr(f"{kind} AS doc_id").schema["doc_id"].dataType
    with pytest.raises(Exception, match="index"):
        tokenfile.write(spark, docs.selectExpr("k AS doc_id", "text"), "word_bpe_49k.json", 2, folder=f"file://{tmp_path}/0")
    named = spark.read.parquet(f"file://{tmp_path}/0/index").select("file").distinct().collect()
    assert {p.name for p in (tmp_path / "0").iterdir()} == {"index", *(r.file for r in named)}


def test_token_files_read_back(spark, odd, none):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = tokenfile.write(spark, odd, "word_bpe_49k.json", 2, length=64)
    got = tokenfile.read(spark, files).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    name = files.index.where("doc_id = 7").first()
    reader = tokenfile.Reader(f"{files.folder}/{name.file}")
    ids, mask = reader.sequence(name.place // 64)
    assert len(ids) == len(mask) == 64 and ids[name.place % 64 :].tolist() == reader.ids(name.place, 64 - name.place % 64).tolist() and mask.all()
    total = sum(r.n_tokens for r in files.index.where(F.col("file") == name.file).collect())
    last, mask = reader.sequence((total - 1) // 64)
    assert mask.sum() == (total - 1) % 64 + 1
    assert tokenfile.read(spark, tokenfile.write(spark, none, "word_bpe_49k.json", 2)).count() == 0


def test_packing_is_gapless_and_tight(spark, odd, none):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack(spark, packing.pieces(df, "byte_bpe_50k.json", 0)).toPandas()
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
            first = len(ids) % 2048 or 2048
            for k, a in enumerate([0, *range(first, len(ids), 2048)]):
                part = ids[a : first if a == 0 else a + 2048]
                want[(str(r.doc_id), k, a, len(part), crc32(np.array(part, "<u4").tobytes()))] += 1
        rows = zip((str(None if math.isnan(x) else int(x)) for x in got.doc_id.astype(float)), got.piece, got.start, got.length, got.ids_crc32, strict=True)
        assert collections.Counter(rows) == want
        o = got.sort_values(["sequence_id", "offset"])
        assert (o.groupby("sequence_id").length.cumsum() - o.length == o.offset).all() and (o.offset + o.length).max() <= 2048
        assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) * 1.02 + 1
    assert packing.pack(spark, packing.pieces(none, "byte_bpe_50k.json", 0)).count() == 0


@pytest.mark.parametrize(("kind", "slack"), [("even", 1.01), ("long", 1.0), ("short", 1.001), ("one", 1.0)])
def test_plans_cover_every_piece_once(kind, slack):
    draw = np.random.default_rng(6)
    lengths = {"even": draw.integers(1, 257, 20_000), "long": draw.integers(150, 257, 2_000), "short": draw.integers(1, 40, 5_000), "one": np.full(1_001, 85)}[kind]
    histogram = np.bincount(lengths, minlength=257)
    p = packing.plan(histogram)
    ends = collections.defaultdict(list)
    seen = collections.Counter()
    for length, first, sequence, offset, each in zip(p.length, p.first, p.sequence, p.offset, p.each, strict=True):
        after = [f for ln, f in zip(p.length, p.first, strict=True) if ln == length and f > first]
        count = (min(after) if after else histogram[length]) - first
        assert count % each == 0
        for k in range(count):
            ends[sequence + k // each].append((offset + k % each * length, length))
        seen[int(length)] += int(count)
    assert all(seen[k] == n for k, n in enumerate(histogram.tolist()) if n)
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(ends) == p.sequences <= max(math.ceil(lengths.sum() / 256), (lengths > 128).sum(), math.ceil(len(lengths) / (256 // lengths.min()))) * slack + 1


# nearest neighbours


@pytest.mark.parametrize("dim", [3, 64, 700])
def test_nearest_is_exact(spark, dim):
    draw = np.random.default_rng(dim)
    x = draw.normal(size=(900, dim)).astype(np.float32)
    x[500:520] = x[0]
    rows = [(int(k), r.tolist(), 0) for k, r in enumerate(x)]
    rows += [(2000, None, 0), (2100, [0.0] * dim, 0), (2200, [float("nan")] * dim, 0), (2300, [1.0, None] + [1.0] * (dim - 2), 0), (2400, [1.0], 0), (2500, [float("inf")] + [1.0] * (dim - 1), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1))
    got = knn.nearest(spark, df, F.col("id") % 100 == 0)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    assert len(found) == 90
    y = x.astype(np.float64)
    for q in range(0, 900, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(900), d)) if k != q][:10]
        assert [found[(q, r)][0] for r in range(1, 11)] == order
        assert [found[(q, r)][1] for r in range(1, 11)] == pytest.approx(d[order])


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in knn.nearest(spark, df, F.col("id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 1)]
    assert knn.nearest(spark, df.where("1 = 0"), F.col("id") % 100 == 0).count() == 0


def test_error_bounds_hold():
    draw = np.random.default_rng(4)
    a, b = draw.normal(size=(50, 600)) * draw.lognormal(0, 2, (50, 1)), draw.normal(size=(70, 600))
    (qa, sa, ea), (qb, sb, eb) = knn.quantised(a), knn.quantised(b)
    near = knn.products(qa, qb) * sa[:, None] * sb
    bound = ea[:, None] * np.linalg.norm(b, axis=1) + (np.linalg.norm(a, axis=1) + ea)[:, None] * eb
    assert (np.abs(a @ b.T - near) <= bound).all() and qa.dtype == np.int8
    assert (knn.products(qa, qb) == qa.astype(np.int64) @ qb.astype(np.int64).T).all()


# language model


def plain_lm(texts):
    tok = [(t or "").encode().lower().split() + [0] for t in texts]
    count = collections.Counter(w for t in tok for w in t)
    pair = collections.Counter(p for t in tok for p in zip([None, *t], t, strict=False))
    after = collections.Counter(w for _, w in pair)
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in pair.items():
        context[u][0] += c
        context[u][min(c, 3)] += 1

    def cut(values):
        n = collections.Counter(values)
        return (0, *lm.discounts(n[1], n[2], n[3], n[4]))

    d2, d1, total = cut(pair.values()), cut(after.values()), sum(after.values())
    kinds = collections.Counter(min(c, 3) for c in after.values())

    def word(w):
        if not total:
            return 1 / (len(count) + 1)
        rest = sum(d1[k] * kinds[k] for k in (1, 2, 3)) / total
        return (after[w] - d1[min(after[w], 3)]) / total + rest / (len(count) + 1)

    def given(u, w):
        if u not in context:
            return word(w)
        c = context[u]
        return (pair[(u, w)] - d2[min(pair[(u, w)], 3)]) / c[0] + sum(d2[k] * c[k] for k in (1, 2, 3)) / c[0] * word(w)

    return count, given


@pytest.mark.parametrize("most", [4096, 3])
def test_lm_is_kneser_ney(spark, documents, odd, most):
    rows = documents.head(60)
    df = spark.createDataFrame([(int(i), t, None, None, 0) for i, t in zip(rows.doc_id, rows.text, strict=True)], SCHEMA).unionByName(odd.select(SCHEMA.replace(" long", "").replace(" string", "").split(", ")))
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(True))
    model = lm.train(spark, df.where(~held), shard_bytes=20_000, most=most)
    assert model.shards > 4 and model.shards % -(-model.shards // most) == 0
    all_rows = df.withColumn("h", held).select("doc_id", "text", "h").collect()
    count, given = plain_lm([r.text for r in all_rows if not r.h])
    n, v = sum(count.values()), len(count)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    assert sum(given(b"of", w) for w in count) + given(b"of", b"?") == pytest.approx(1)
    want = []
    for r in all_rows:
        t = (r.text or "").encode().lower().split() + [0]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((str(r.doc_id), len(t), sum(count[w] > 0 for w in t), round(base, 6), round(sum(math.log10(given(u, w)) for u, w in zip([None, *t], t, strict=False)), 6)))
    got = lm.score(df, model).collect()
    assert len(got) == len(want)
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-6, abs=1e-5)


def test_lm_without_training_text(spark, odd, none):
    model = lm.train(spark, none)
    rows = {r.doc_id: r for r in lm.score(odd, model).collect()}
    assert rows[2].n_tokens == 1 and rows[2].n_known == 0 and rows[2].score == 0 and rows[2].base_score == 0


def test_packed_columns_come_back():
    key = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    count = np.arange(1000, dtype=np.uint32)
    a, b = lm._unpacked(lm._packed(key, count), 1000, np.uint64, np.uint32)
    assert (a == key).all() and (b == count).all()


def test_license_scan_finds_a_notice_beside_a_lesser_hash(spark):
    """The first words' hash shares 21 bits with that of the MIT notice, and is less."""
    df = spark.createDataFrame([(1, "w1067378 and so it goes Released under the MIT License")], "doc_id long, text string")
    assert [r.license for r in licenses.scan(spark, df).collect()] == ["MIT"]


def test_lm_keys_that_share_their_first_part():
    """Words whose keys agree in 40 bits share pairs, those that agree in fewer don't; look-ups go along equal first columns."""
    draw = np.random.default_rng(5)
    word = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    close = np.concatenate([word, word ^ np.uint64(1 << 30), word ^ np.uint64(1 << 3)])
    before, key = np.repeat(word[:5], len(close)), np.tile(close, 5)
    high, low = lm.pairs(before, key)
    assert len(np.unique(high)) == 5 * 40 and len(set(zip(high.tolist(), low.tolist(), strict=True))) == 5 * 80
    h, lo, n = lm._summed_pairs(high, low, np.ones(len(high), np.uint32))
    assert n.sum() == len(high) and len(h) == 5 * 80 and (np.diff(h.astype(float)) >= 0).all()
    first, second = lm._contexts(h, lo)
    assert set(first.tolist()) == {int(w) >> 24 for w in word[:5]} and set(second.tolist()) == {int(w) >> 24 for w in close}
    model = lm.Model("nowhere", 1, there=frozenset(["pair-0"]), open={"pair-0": [h, lo, n]})
    (found,) = model.look_up("pair", high, np.zeros(len(high), np.uint64), 1, low)
    want = {(a, b): c for a, b, c in zip(h.tolist(), lo.tolist(), n.tolist(), strict=True)}
    assert found.tolist() == [want[x] for x in zip(high.tolist(), low.tolist(), strict=True)]
    (none,) = model.look_up("pair", high, np.zeros(len(high), np.uint64), 1, low ^ np.uint16(9))
    assert not none.any()


def test_workers_close_shards(tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "OPEN_BYTES", 10_000)
    model = lm.Model(str(tmp_path), 6, there=frozenset(f"word-{k}" for k in range(6)))
    for k in range(6):
        lm._write(f"{tmp_path}/word-{k}", np.arange(k, 3_000, 6, dtype=np.uint64), np.arange(500, dtype=np.uint32) + k)
    keys = np.arange(600, dtype=np.uint64)
    (found,) = model.look_up("word", keys, keys % 6, 1)
    assert found.tolist() == [k // 6 + k % 6 for k in range(600)] and 1 <= len(model.open) <= 2
