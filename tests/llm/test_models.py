"""Toxicity, languages, pieces, shards, vectors: held-out accuracy, round trips, brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cases import documents, texts
from gaugeworks.llm import embedding_dedup, language, neighbours, pieces, sharding, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_documents(spark):
    out = toxicity.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = out.collect()
    right = sum(r.predicted == r.toxic for r in rows)
    found = sum(r.predicted for r in rows if r.toxic)
    assert right / len(rows) > 0.95 and found / sum(r.toxic for r in rows) > 0.8


def test_toxicity_cases(spark):
    insults, plain = ["awful rotten person", "rotten awful thing"], ["kind gentle person", "gentle kind thing"]
    rows = [(i, r, i % 2) for i, r in enumerate((insults[i % 4 // 2] if i % 2 else plain[i % 4 // 2]) for i in range(200))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "awful"), (900, None), (901, ""), (902, "rotten " * 30_000), (3, rows[3][1])], "doc_id long, text string")
    docs = docs.withColumn("Score", F.lit("old")).withColumn("toxic", F.lit(5)).withColumn("block", F.lit(1))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (901, None), (1, 0), (77777, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    got = [r for r in out.collect()]
    assert len(got) == 205 and out.columns.count("score") == 1 and "Score" not in out.columns
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert all(by[i][0].predicted == i % 2 for i in range(200)) and by[902][0].predicted == 1
    assert by[900][0].score == by[901][0].score and by[None][0].predicted == 1 and len({r.score for r in by[3]}) == 1
    none = toxicity.toxicity(docs, labels.where("false"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_toxicity_ignores_labels_without_a_document(spark):
    rows = [(i, "awful rotten thing" if i % 2 else "kind gentle thing", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    absent = spark.range(1000, 9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    a, b = toxicity.train(docs, labels, 5), toxicity.train(docs, labels.union(absent), 5)
    assert (a[0] == b[0]).all() and a[1] == b[1] and np.isfinite(b[1])


def test_languages_on_held_out_documents(spark):
    out = language.op6_compression_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_numerals_are_no_letters(spark):
    assert language.plain("½ ² ① Ⅷ 7_") == b"" and language.plain("X²y ½Z") == b"x y z"
    assert language.plain("Straße de l'été") == "straße de l été".encode()
    rows = [(i, "ein wort und noch eins " * 9, "de") for i in range(30)] + [(100, "½ ² ①", "de"), (101, "½ x", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs)).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "de"


def test_language_cases(spark):
    r = random.Random(1)
    a, b = ["the", "house", "river", "stone"], ["der", "fluss", "haus", "stein"]
    data = [(i, " ".join(r.choices(a if i % 2 else b, k=60)), "en" if i % 2 else "de") for i in range(60)]
    data += [(100, None, "en"), (101, "", None), (102, "12 3!", "de"), (103, "river stone " * 9000, None), (None, "fluss haus der stein fluss", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("SCORE", F.lit(1))
    out = language.identify(docs, language.learn(docs))
    got = {x.doc_id: x for x in out.collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert got[100].score == 0 and out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    blind = language.identify(docs, language.learn(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {x.lang_pred for x in blind.collect()} == {"und"}
    assert language.identify(docs.where("false"), language.learn(docs.where("false"))).count() == 0


@pytest.mark.parametrize("letters", [3, 8, 20])
def test_a_rare_language_leaves_the_others_whole(spark, letters):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**9 + i, "qzxvkwjyhgfbdmpqzxvk"[:letters], "aa") for i in (1, 2, 3)], "doc_id long, text string, lang string")
    learned = language.learn(docs.union(rare))
    assert 0 < len(learned["aa"]) <= 3 * letters + 2
    assert all(len(x) > 90_000 for lang, x in learned.items() if lang != "aa")
    rows = language.identify(docs.where("doc_id % 3 = 0"), learned).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_a_dictionary_is_filled_from_one_long_text_and_from_many_short_ones(spark):
    r = random.Random(3)
    a, b = ([ "".join(r.choices(x, k=7)) for _ in range(3000)] for x in ("abcdefg", "hijklmn"))
    own = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = [(own, " ".join(r.choices(a, k=40_000)) + " marker", "long")]
    rows += [(1000 + i, " ".join(r.choices(b, k=3)), "short") for i in range(8000)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(len(x) > 0.99 * language.DICTIONARY_BYTES for x in learned.values())
    assert b"marker" in learned["long"] and learned["long"][:500] in language.plain(rows[0][1])


ODD = ["", " ", "  a  b ", "\n\n x", "▁▁ a▁b", "日本語 🎉🎉" * 9, "a" * 500, "\x00\t é́ ﷽", "    " * 9 + "x", "<s> </s> <0x0A>"]


def test_pieces_without_dropout_are_the_models_own():
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rows = [t for t in texts(4) if t] + ["The quick  brown fox\njumps over thirteen lazy dogs' houses."]
    ids, counts = pieces.encode_texts(pieces.model(), rows, 1, 0.0)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [own.encode(t) for t in rows]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_pieces_decode_losslessly_and_vary(dropout):
    m = pieces.model()
    r = random.Random(2)
    rows = ODD + ["".join(r.choices("abcde \n▁é🎉the", k=r.randint(0, 60))) for _ in range(200)] + [t for t in texts(5) if t]
    seen = set()
    for key in (1, 2, 3):
        ids, counts = pieces.encode_texts(m, rows, key, dropout)
        assert pieces.decode_ids(m, ids, counts) == [t.encode() for t in rows]
        again = pieces.encode_texts(m, rows, key, dropout)
        assert (again[0] == ids).all()
        seen.add(ids.tobytes())
    assert len(seen) == (3 if dropout < 1 else 1)


def test_occurrences_and_documents_drop_merges_by_themselves():
    m = pieces.model()
    text = " ".join(["international"] * 300)
    first, n = pieces.encode_texts(m, [text, text], [1, 2], 0.1)
    assert first[: n[0]].tolist() != first[n[0] :].tolist()
    ids, counts = pieces.encode_words(m, [" international"] * 300, np.arange(300, dtype=np.uint64), 0.1)
    ends = np.cumsum(counts)
    assert len({tuple(ids[e - k : e].tolist()) for e, k in zip(ends, counts)}) > 10
    # One word repeated in one text: cut at the spaces, more than four segmentations.
    cut: list[list[int]] = []
    for i in first[: n[0]].tolist():
        piece = m.raw[m.raw_at[i] : m.raw_at[i] + m.raw_size[i]].tobytes()
        if piece.startswith(b" "):
            cut.append([])
        cut[-1].append(i)
    assert len(cut) == 300 and len(set(map(tuple, cut))) > 10


def test_agendas_agree():
    m = pieces.model()
    found = sorted({w for t in texts(6) if t for w in pieces.WORD.findall(" " + t) if len(w) <= pieces.LONG})
    ids, counts = pieces.encode_words(m, found, 9, 0.3)
    ends = np.cumsum(counts)
    keyed = np.uint64(pieces.xxhash.xxh3_64_intdigest((9).to_bytes(8, "little", signed=True)))
    for w, e, n in zip(found, ends, counts):
        h = np.array([keyed])
        for c in w:
            h = pieces._mixed(h * pieces.FACTORS[0] + np.array([ord(c)], np.uint32))
        assert pieces._by_agenda(m, w, int(h[0]), 0.3) == ids[e - n : e].tolist()


@pytest.mark.parametrize("dropout", [0.02, 0.3])
def test_pieces_merge_only_the_occurrences_that_skip_something(monkeypatch, dropout):
    m = pieces.model()
    rng = np.random.default_rng(3)
    distinct = [" international", " a", "the", " processing", " of", " unbelievable", " 2024", "   x"]
    found = [distinct[i] for i in rng.integers(0, len(distinct), 3000)]
    keys = rng.integers(0, 2**63, len(found)).astype(np.uint64)
    merged, by_length = [], pieces._by_length

    def counted(m, chars, *rest):
        merged.append(len(chars))
        return by_length(m, chars, *rest)

    monkeypatch.setattr(pieces, "_by_length", counted)
    ids, counts = pieces.encode_words(m, found, keys, dropout)
    assert sum(merged) < 0.9 * len(found)
    for w, k, n, e in zip(found, keys, counts.tolist(), np.cumsum(counts).tolist()):
        h = np.array([k], np.uint64)
        for c in w:
            h = pieces._mixed(h * pieces.FACTORS[0] + np.array([ord(c)], np.uint32))
        assert pieces._by_agenda(m, w, int(h[0]), dropout) == ids[e - n : e].tolist()


def test_pieces_of_tables(spark):
    rows = [None, *ODD, *texts(7)]
    docs = documents(spark, rows, ids="string", N_PIECES="int").union(documents(spark, [None, "x"], ids="string", N_PIECES="int"))
    out = pieces.decode(pieces.encode(docs)).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
        if r.ids is not None:
            assert r.lossless and r.n_pieces == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.encode(docs.where("false")).count() == 0


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    c = np.array(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij")).reshape(dimensions, -1)
    index = sharding.hilbert(c, bits)
    assert sorted(index) == list(range(c.shape[1]))
    assert (np.abs(np.diff(c[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, tmp_path):
    rows = texts(8)
    docs = documents(spark, rows, shard="int", rank="int", curve="string").union(documents(spark, rows[:9], shard="int", rank="int", curve="string"))
    got = sharding.shard(docs).collect()
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        t = rows[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(24)) and len(got) == len(rows) + 9
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(docs.where("false")).count() == 0
    few = sharding.shard(documents(spark, [None, "a"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2
    plain = documents(spark, rows)
    sharding.write_shards(plain, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id", "text").exceptAll(plain.select("doc_id", "text")).isEmpty() and back.count() == len(rows)


def test_shards_prune(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = sharding.shard(docs).drop("size").join(docs, "doc_id")
    spread = out.groupBy("shard").agg(F.countDistinct("source").alias("s")).agg(F.avg("s")).first()[0]
    assert spread < 0.75 * docs.select("source").distinct().count()


def vectors(spark, seed=1, n=300, size=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    for i in range(n // 3):  # families
        x[n // 3 + i] = x[i % 7] * r.uniform(0.5, 2) + r.normal(size=size) * 0.1
    rows = [(i, [float(v) for v in e], int(i % 3) if i % 11 else None) for i, e in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * size, 1), (n + 3, [1.0, None] + [0.0] * (size - 2), 1), (n + 4, [float("nan")] * size, 1), (n + 5, [float("inf")] + [1.0] * (size - 1), 1)]
    rows += [(n + 6, rows[2][1], 2), (n + 7, rows[2][1], 2), (n + 8, [1.0, 0.0], 2), (n + 9, [1.0, 0.001], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def usable(e):
    return bool(e) and None not in e and np.isfinite(e).all() and any(e)


@pytest.mark.parametrize("block", [1000, 5])
def test_embedding_dedup_against_brute_force(spark, block, monkeypatch):
    from cases import components

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows, df = vectors(spark)
    links = []
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if x is not None and x == y and usable(a) and usable(b) and len(a) == len(b):
                a_, b_ = np.array(a), np.array(b)
                if a_ @ b_ / np.sqrt(a_ @ a_) / np.sqrt(b_ @ b_) >= 0.98:
                    links.append((i, j))
    assert len(links) > 100
    want = components(len(rows), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    out = embedding_dedup.embedding_dedup(df.withColumn("n_links", F.lit("x")).withColumn("class", F.lit(1)).repartition(5))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got == {i: (n[i], c, i == c) for i, c in enumerate(want)}


def test_embedding_dedup_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, [9.0, -1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


def test_probe_sets_are_in_order_and_valid():
    found = neighbours.probe_sets(3, 27)
    assert found[0] == () and len(found) == len(set(found)) == 27
    assert all(5 - z not in s for s in found for z in s)


def best(rows, every, k):
    out = {}
    for i, e, _ in rows:
        if i % every == 0 and usable(e):
            q = np.array(e)
            s = [(-float(q @ np.array(v)), j) for j, v, _ in rows if j != i and usable(v) and len(v) == len(e)]
            out[i] = [(j, -x) for x, j in sorted(s)[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rows, df = vectors(spark, 2, 2000, 24)
    want = best(rows, 20, 20)
    got: dict[int, dict] = {}
    for r in neighbours.nearest(df.withColumn("score", F.lit("x")).withColumn("task", F.lit(1))).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        mine = [got[q][i + 1] for i in range(len(got[q]))]
        assert len(mine) == len(w) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len({j for j, _ in mine} & {j for j, _ in w})
        e = np.array(rows[q][1])
        assert all(abs(s - e @ np.array(rows[j][1])) < 1e-12 * max(1, abs(s)) for j, s in mine)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (None, [5.0, 5.0], 1), (20, [-3.0, 0.5], 2), (40, [7.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    # All candidates where there are fewer; ties to the smaller id; another length is no candidate.
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -3.0), (20, 1, 0, -3.0), (20, 2, 1, -3.0), (20, 3, 2, -3.0)]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 10)
    rows = [(i, [1.0, i / 1e6], 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got: dict[int, list] = {}
    for r in neighbours.nearest(df).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for j, _ in w] for q, w in best(rows, 20, 20).items()}


def test_neighbours_are_distinct_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 300)
    r = np.random.default_rng(11)
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(r.normal(size=(2000, 64)))]
    # Copies of a query's neighbour: rows of one id are candidates each, in both tables.
    rows += [(5000, [3 * v for v in rows[0][1]], 1)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got: dict[int, list] = {}
    for x in neighbours.nearest(df).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert len(got) == 101 and got[0][:3] == [5000] * 3
    for q, ids in got.items():
        own = [i for i in ids if i != 5000]
        assert len(ids) == 20 and len(set(own)) == len(own), q


def test_scores_do_not_depend_on_the_block():
    r = np.random.default_rng(12)
    q, x = r.normal(size=(40, 64)), r.normal(size=(40, 64))
    whole = neighbours.inner(q, x)
    assert all(neighbours.inner(q[i : i + 1], x[i : i + 1])[0] == whole[i] for i in range(40))
    assert (neighbours.inner(q[::3], x[::3]) == whole[::3]).all()
