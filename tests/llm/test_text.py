"""Line dedup, Jaccard join, suffix dedup and packing against brute force and defined cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import documents, lines, near, repeats, texts, words
from gaugeworks.llm import line_dedup, ngram_join, packing, suffix_dedup


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return texts(request.param)


def test_line_dedup_against_brute_force(spark, rows):
    found = line_dedup.line_dedup(documents(spark, rows, kept="int", mask="int", lines="int", N_LINES="int"))
    assert {"kept", "mask", "lines"} < set(found.columns) and found.columns.count("n_lines") == 1
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()}
    for i, want in enumerate(lines(rows)):
        assert got[i] == want, i


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_variants_of_long_lines(spark, n):
    words = [f"w{i % 7}" for i in range(n + 5)]
    df = spark.createDataFrame([(1, words), (2, words[:3] + words[4:])], "place int, words array<string>")
    a, b = line_dedup._variants(df).orderBy("place").collect()
    assert len(a.cut) == n + 5 and a.cut[3] == b.whole and a.whole not in a.cut


def test_words_are_made_of_the_lines_looked_at(spark, monkeypatch):
    plans, written = {}, line_dedup.written

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().optimizedPlan().toString().lower()
        return written(df, purpose)

    monkeypatch.setattr(line_dedup, "written", noted)
    df = spark.createDataFrame([(1, "a b c d e\n\tf  g h i j "), (2, " a b c d x\nf g h i j")], "doc_id int, text string")
    out = line_dedup.line_dedup(df).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed) for r in out] == [(2, 0), (2, 2)]
    # Children come after their parents: the lines are picked before they are searched for white space.
    plan = plans["line-variants"]
    assert plan.rindex("contains(") < plan.index("leftsemi")


def test_line_dedup_null_ids_and_repeated_rows(spark):
    rows = [(None, "one line of some words\nx"), (7, "one line of some words"), (7, "one line of some words"), (None, "x")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id or -1, r.text) for r in out.collect()))
    # The null id comes later; both rows of one document are treated alike. Of the null ids one keeps x.
    assert [g for g in got if g[0] == 7] == [(7, "one line of some words")] * 2
    assert sorted(t for i, t in got if i == -1) == ["", "x"]


@pytest.mark.parametrize("tree_rows", [4000, 4])
def test_ngram_join_against_brute_force(spark, rows, tree_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(documents(spark, rows, n="int", set_id="int"), tree_rows).collect()}
    assert [got[i] for i in range(len(rows))] == near(rows)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(3)
    rows = texts(4) + ["w" * 5000 + " a b c d " + "É" * 3000 + " e", " " * 9000, "x" * 7000, " ".join(r.choice(["a", "Bc", "é\t"], 4000))]
    whole = [x.tolist() for _, x in ngram_join.shingle_sets(pa.array(rows))]
    monkeypatch.setattr(ngram_join, "PIECE", 500)
    assert [x.tolist() for _, x in ngram_join.shingle_sets(pa.array(rows))] == whole


def test_a_family_of_copies_with_edits(spark):
    """Hundreds of copies that are mostly less alike than 0.8 to each other, but alike to the original."""
    r = random.Random(6)
    w = words(6, n=400)
    base = r.choices(w, k=300)
    rows = [" ".join(base)]
    for i in range(300):
        own = list(base)
        for at in r.sample(range(300), 3 + i % 6):
            own[at] = f"new{i}-{at}"
        rows.append(" ".join(own))
    rows += [" ".join(r.choices(w, k=150) + base[:120]) for _ in range(40)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(documents(spark, rows).repartition(6)).collect()}
    want = near(rows)
    assert [got[i] for i in range(len(rows))] == want and sum(c == 0 for _, c in want) > 200


def test_trees_find_all_similar_pairs():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 2**63, r.integers(1, 400), dtype=np.uint64)) for _ in range(40)]
    sets = list(base)
    for b in base:
        for share in (0.02, 0.08, 0.1, 0.12, 0.3):
            own = b.copy()
            own[r.random(len(b)) < share] = r.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(own))
    bits = np.array([ngram_join.bitmap(x) for x in sets]).view(np.uint64)
    n = np.array([len(x) for x in sets])
    component = np.arange(len(sets))
    found = {tuple(sorted(p)) for p in ngram_join.tree_pairs(bits, n, component).tolist()}
    true = {
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if ngram_join.similar(len(np.intersect1d(sets[i], sets[j])), n[i], n[j])
    }
    assert true <= found and len(found) < 3 * len(true)
    part = component % 3
    across = {tuple(sorted(p)) for p in ngram_join.tree_pairs(bits, n, component, part).tolist()}
    assert {p for p in true if part[p[0]] != part[p[1]]} <= across and all(part[a] != part[b] for a, b in across)


def test_ngram_join_null_ids(spark):
    t = "a b c d e f g h i j"
    out = ngram_join.ngram_join(spark.createDataFrame([(None, t), (5, t), (3, None), (None, "z")], "doc_id long, text string"))
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out.collect())) == [
        (-1, 1, -1), (-1, 6, 5), (3, 0, 3), (5, 6, 5),
    ]


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_suffix_dedup_against_brute_force(spark, rows, group_rows):
    df = documents(spark, rows, spans="int", kept="int", hash="int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, group_rows).collect()}
    for i, want in enumerate(repeats(rows)):
        assert got[i] == want, i


def test_long_text_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(1)
    body = "".join(r.choice(list("abcdefg "), 30_000))
    rows = [body, body[:9000] + "#" + body[9100:20_000], body[500:700], "q" * 5000]
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    import pyarrow as pa

    whole = []
    for piece in (4096, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        windows = set()
        for part, room, source, begins in suffix_dedup.pieces(pa.RecordBatch.from_pydict({"text": rows})):
            for _, _, lo, hi in zip(*suffix_dedup.segments(part, room)):
                own = np.searchsorted(begins, lo, "right") - 1
                windows.update((int(source[own]), int(w - begins[own])) for w in range(lo, hi + 1))
        whole.append(windows)
    assert whole[0] == whole[1] == {(i, w) for i, t in enumerate(rows) for w in range(len(t) - 199)}


def test_merged_transforms_equal_one():
    r = np.random.default_rng(2)
    columns, group = r.integers(0, 3, (30, 200)), np.sort(r.integers(0, 5, 200))
    expected = np.zeros((30 - 6 + 1, 200), bool)
    for c in range(len(expected)):
        for i in range(200):
            for j in range(200):
                if i != j and group[i] == group[j] and (columns[c : c + 6, i] == columns[c : c + 6, j]).all():
                    expected[c, i] = True
    for cuts in ([], [100], [10, 40, 150]):
        shards = []
        for at in np.split(np.arange(200), cuts):
            shards.append((suffix_dedup.positional_bwt(columns[:, at], group[at]), group[at]))
        assert (np.concatenate(suffix_dedup.merged_repeats(shards, 6), axis=1) == expected).all()


def optimum(items, capacity):
    best = len(items)
    items = sorted(items, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                at = rooms.index(room)
                go(i + 1, rooms[:at] + [room - items[i]] + rooms[at + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r = np.random.default_rng(3)
    for _ in range(400):
        capacity = int(r.integers(5, 30))
        items = r.integers(1, capacity + 1, r.integers(1, 10)).tolist()
        counts = {w: items.count(w) for w in items}
        fixed, left = packing.reduced(counts, capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)
        taken: dict[int, int] = {}
        for times, pattern in packing.patterns(counts, capacity):
            assert times > 0 and sum(w * k for w, k in pattern.items()) <= capacity
            for w, k in pattern.items():
                taken[w] = taken.get(w, 0) + times * k
        assert taken == counts


def test_packing(spark, rows):
    rows = [*rows, "<|endoftext|> is text", "a " * 2046, "a " * 2047, "a " * 2048]
    out = packing.pack(documents(spark, rows, length="int", rank="int").union(documents(spark, rows[:12], length="int", rank="int")))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    want = []
    for i, t in [*enumerate(rows), *enumerate(rows[:12])]:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = out.collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize(
    "run", [line_dedup.line_dedup, ngram_join.ngram_join, suffix_dedup.suffix_dedup, packing.pack]
)
def test_empty_tables(spark, run):
    assert run(documents(spark, [])).count() == 0
    nothing = run(documents(spark, [None, ""]))
    assert nothing.count() == 2


def test_stages_keep_columns_and_clean_documents(spark):
    from cases import words

    r = np.random.default_rng(9)
    w = words(9, "abcdefgh")
    clean = [" ".join(r.choice(w, 80)) for _ in range(10)]
    copy, passage = clean[0], " ".join(r.choice(w, 70))
    docs = documents(spark, [*clean, copy, clean[1] + " " + passage, clean[2] + "\n" + passage, None])
    by_lines = line_dedup.stage(spark, docs, "")
    assert by_lines.columns == docs.columns
    assert {x.doc_id for x in by_lines.collect()} == set(range(14)) - {10}
    by_sets = ngram_join.stage(spark, docs, "")
    assert by_sets.columns == docs.columns and {x.doc_id for x in by_sets.collect()} == set(range(14)) - {10}
    cut = suffix_dedup.stage(spark, by_sets, "")
    kept = {x.doc_id: x.text for x in cut.collect()}
    assert cut.columns == docs.columns and passage not in kept.get(11, "") and kept[5] == clean[5] and kept[13] is None
    assert packing.stage(spark, cut, "").select(F.countDistinct("doc_id")).first()[0] == len(kept)


def test_pipeline_keeps_one_of_repeated_and_null_id_rows(spark, tmp_path):
    import corpus_pipeline
    from cases import words

    r = np.random.default_rng(10)
    w = words(10, "abcdefgh")
    a, b, c, d, e = (" ".join(r.choice(w, 160)) for _ in range(5))
    near_c = " ".join(["changed", "words", *c.split(" ")[2:]])
    # Repeated rows; an id and null-id (near) copies; null ids alone, repeated and near.
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (3, c), (None, near_c), (None, d), (None, d), (4, e), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_sets = ngram_join.stage(spark, docs, "")
    want = sorted([(1, a), (2, b), (3, c), (-1, d), (4, e), (5, ""), (6, "")])
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in by_sets.collect()) == want
    cut = suffix_dedup.stage(spark, by_sets, "")
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in cut.collect()) == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(900, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).where("start = 0").collect()
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in whole) == [-1, 1, 2, 3, 4, 5, 6]


def test_one_row_stays_of_an_id_with_several_texts(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, t), (1, t.upper()), (1, "another text of six words"), (2, t)]
    out = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(out) == 2 and {(x.doc_id, x.text.lower()) for x in out} == {(1, t), (1, "another text of six words")}


@pytest.mark.parametrize("c", [" ", "\n", " \u00a0"])
def test_long_runs_of_white_space(c):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding, run = packing.encoder(packing.VOCABULARY), c * (1_200_000 // len(c))
    for text in ("a" + run, f"it's {run}x 1{run}\n!{run}", f"a{c * 99_999}b{c * 100_000} c{c * 100_001}"):
        assert packing.ids_of(encoding, text).tolist() == tokens.encode(text, add_special_tokens=False).ids


def test_packing_of_a_run_of_millions(spark):
    rows = [(1, " " * 3_000_000 + "x"), (2, "\n" * 2_500_000), (3, "plain")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n"))
    encoding = packing.encoder(packing.VOCABULARY)
    assert {r.doc_id: r.n for r in out.collect()} == {i: len(packing.ids_of(encoding, t)) + 1 for i, t in rows}


def test_added_tokens_as_the_files_own_library_has_them(spark, tmp_path):
    end = "<|endoftext|>"
    rows = [f"{end} x", f"a{end}{end}b  {end}\n", "<|endoftext |>", f"it's  {end}", "y" * 99_999 + f"  {end} z", " " * 150_000 + end + " " * 150_000 + "x"]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(rows):
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    for out in (packing.op2_best_fit_packing(spark, str(tmp_path)), packing.stage(spark, documents(spark, rows), "")):
        assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)
