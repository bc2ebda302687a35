"""Collocations, chunked encoding and lexical search against brute force and defined cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import documents, texts, words
from gaugeworks.llm import chunk_bpe, collocations, lexical_search
from gaugeworks.llm.wording import stretches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path(chunk_bpe.VOCABULARY)


def phrases(rows, least, limit):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of 1 to 5 words."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        cands = {w: c for (k, w), c in f.items() if k == lang and len(w) > 1 and c >= least}
        inside = collections.Counter()
        for w, c in cands.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inside[w[i : i + m]] = max(inside[w[i : i + m]], c)
        told = []
        for w, a in cands.items():
            if inside[w] and inside[w] >= a:
                continue
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, (left, right) = min((1000 * a * n[lang] // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
            told.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(told)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def spoken(seed, n=60):
    r = random.Random(seed)
    w = words(seed, n=30)
    some = [" ".join(r.choices(w, k=r.randint(2, 6))) for _ in range(6)]
    rows = [(None, "en"), ("", None), ("...\n;", "de"), ("\xa0 x\xa0y", "de"), ("A a A a " * 40, "en")]
    for _ in range(n):
        text = "".join(r.choice([*some, *w]) + r.choice([" ", " ", "\t ", ". ", "\n", ", "]) for _ in range(r.randint(1, 80)))
        rows.append((text.upper() if r.random() < 0.2 else text, r.choice(["en", "de", None, "und", "e\tn", ""])))
    return rows + rows[5:9]


@pytest.mark.parametrize(("seed", "group_rows"), [(1, 400_000), (2, 150)])
def test_collocations_against_brute_force(spark, seed, group_rows):
    rows = spoken(seed)
    df = spark.createDataFrame(rows, "text string, lang string").withColumns(
        {c: F.lit(1) for c in ("phrase", "n", "KEY", "rank", "doc_id")}
    )
    got = collocations.collocations(df.repartition(3), least=4, limit=25, group_rows=group_rows)
    assert dict(got.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in got.columns}
    assert sorted(map(tuple, got.collect())) == phrases(rows, 4, 25)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_collocation_blocks_overlap(spark, monkeypatch):
    # One piece of many words, longer than a block and a stretch.
    r = random.Random(3)
    text = " ".join(r.choices("abcdefgh", k=5000))
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr("gaugeworks.llm.wording.STRETCH", 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([text, text]), "lang": ["x", None]})
    total = {}
    blocks = list(collocations._blocks(iter([batch]), total))
    assert total == {"x": 5000, "und": 5000} and sum(int(np.count_nonzero(x[:n])) for x, n in blocks) == 10000
    fives = sum(sum(bool(x[i : i + 5].all()) and i + 5 <= len(x) for i in range(n)) for x, n in blocks)
    assert fives == 2 * 4996


def test_slots_keep_to_the_budget():
    r = random.Random(5)
    totals = {s: r.choice([1, 5, 50, 400, 3000]) for s in range(0, 900, 2)}
    group, over, whole = collocations.pack_slots(totals, 900, 1000)
    used = collections.Counter()
    for s, c in totals.items():
        assert (over[s] == 1) == (c <= 1000) and (group[s] < whole) == (c <= 1000)
        used[group[s]] += c if c <= 1000 else 0
    assert max(used.values()) <= 1000
    heavy = sorted((group[s], over[s]) for s in totals if totals[s] > 1000)
    assert all(a + n == b for (a, n), (b, _) in zip(heavy, heavy[1:])) and heavy[0][0] == whole


def told(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)), ids


def odd(seed):
    r = random.Random(seed)
    shared = "".join(r.choice(["ab ", "é", "é", "don't", "I'LL ", "Σας ", "7", "\xa0", "漢字", "\n\n", "!?", "<|endoftext|>"]) for _ in range(900))
    out = [shared, shared[3:], "x" + shared, shared + shared, "É" + shared[: len(shared) // 2], shared[100:1500] + "́tail"]
    out += ["n" * 9000, "'" * 700 + "re", "漢" * 9000, " " * 20_000, "́" * 300, "<|startoftext|>a<|endoftext|", "a\x00b \x85c d"]
    out += ["lead " + "n" * 9000, "".join(chr(r.randrange(1, 0xD800)) for _ in range(4000))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunk_bpe_against_the_library(spark, seed):
    rows = [*texts(seed), *odd(seed)]
    tokenizer = Tokenizer.from_file(PATH)
    df = documents(spark, rows, ids="int", text_key="int", chunk="int", N_TOKENS="int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in chunk_bpe.encoded(df, PATH, digests=True).collect()}
    want = [told(t, tokenizer) for t in rows]
    assert [got[i] for i in range(len(rows))] == [w[:3] for w in want]
    ids = chunk_bpe.encoded(df, PATH)
    found = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u2").tolist()) for r in ids.collect()}
    assert [found[i] for i in range(len(rows))] == [(w[0], w[3]) for w in want]
    back = {r.doc_id: r.text for r in chunk_bpe.decoded(ids, PATH).collect()}
    assert [hashlib.sha256(back[i].encode()).hexdigest() for i in range(len(rows))] == [w[2] for w in want]


def test_chunk_bpe_repeated_rows_and_null_ids(spark):
    t = " ".join(words(4)) * 3
    rows = [(None, t), (None, t), (3, t), (3, t), (3, None), (4, ""), (5, t[1:])]
    got = chunk_bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, digests=True)
    tokenizer = Tokenizer.from_file(PATH)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *told(t, tokenizer)[:3])) for i, t in rows)
    assert chunk_bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_chunks_follow_the_content():
    r = random.Random(7)
    text = " ".join(r.choices(words(7), k=30_000)).encode()

    def cut(x):
        ends = chunk_bpe.chunk_ends(x)
        return [x[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(text), cut("éé new words ".encode() + text)
    assert b"".join(a) == text and len(set(a) & set(b)) > 0.95 * len(a)
    assert max(map(len, a)) <= chunk_bpe.MAX_CHUNK + 3 and min(map(len, a[:-1])) >= chunk_bpe.MIN_CHUNK
    for c in a:
        c.decode()
    assert cut(b"") == [] and b"".join(cut(b"\xc3\xa9" * 40_000)) == b"\xc3\xa9" * 40_000


def test_long_text_is_encoded_in_stretches():
    own = chunk_bpe.Encoder(PATH)
    text = "don't stop\n" * 150_000 + "z" * 1_100_000 + " end"
    tokenizer = Tokenizer.from_file(PATH)
    head = tokenizer.encode("don't stop\n" * 100, add_special_tokens=False).ids * 1500
    tail = tokenizer.encode("z" * 1_100_000, add_special_tokens=False).ids + tokenizer.encode("end", add_special_tokens=False).ids
    assert np.frombuffer(own.ids([text.encode()])[0], "<u2").tolist() == head + tail


def test_words_asked_for_of_late_stay_known(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "KNOWN", 40)
    own = chunk_bpe.Encoder(public_tokenizers.path(chunk_bpe.VOCABULARY))
    asked, by_parts = [], own._by_parts
    monkeypatch.setattr(own, "_by_parts", lambda words: asked.extend(words) or by_parts(words))
    for i in range(30):
        text = b"Often " + b" ".join(b"it's%d\x01<|x|>!'%c" % (j, 97 + j % 26) for j in range(10 * i, 10 * i + 10))
        assert own.ids([text]) == own.whole([text])
        assert len(own.known) + len(own.known.older) <= 40 + 11
    assert asked.count(b"Often") == 1


def test_words_by_parts_and_in_joint_calls():
    own, tokenizer = chunk_bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.splits and own.mark is not None
    r = random.Random(8)
    letters = [*"abcXYZ019'.,-", "'s", "'RE", "'ll", "\x00", "\x1c", "\x7f", "é", "É", "漢", "\u0301", "\xa0", "½", "ǅ", "<|endoftext|>", "<|"]
    ws = ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(4000)]
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in ws]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.ids([w.encode() for w in ws])] == want
        own.splits = False
        own.known.clear()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    split = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, split)), sum(map(len, split))
    df = collections.Counter(t for w in split for t in set(w))
    out = []
    for item, text in items:
        terms = {t for t in TERM.findall((text or "").translate(LOWER)) if df[t]}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for (doc_id, _), x in zip(docs, split):
            m = 50 + 50 * len(x) * n_docs // n_terms if n_terms else 0
            tf = collections.Counter(t for t in x if t in terms)
            score = sum(w[t] * (1000000000 * c // (1000 * c + 20 * m)) for t, c in tf.items())
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("tree_docs", "leaf_docs", "block_terms"), [(20_000, 64, 100_000), (37, 3, 100_000), (60, 2, 40)])
def test_lexical_search_against_brute_force(spark, monkeypatch, tree_docs, leaf_docs, block_terms):
    monkeypatch.setattr(lexical_search, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(lexical_search, "LEAF_DOCS", leaf_docs)
    rows = texts(3)
    docs = [*enumerate(rows), *enumerate(rows[20:30]), (None, rows[12]), (None, rows[12]), (None, rows[40])]
    items = [(1, rows[12]), (2, rows[30][:60].upper()), (2, "é ß zzzz"), (3, None), (None, "..."), (4, rows[50]), (None, rows[-1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n", "terms", "SCORE", "item")})
    found = lexical_search.lexical_search(
        df.repartition(3), spark.createDataFrame(items, "item_id long, text string").coalesce(1), 7, block_terms
    )
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, items, 7)


def test_lexical_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = docs.where("doc_id > 5")
    assert lexical_search.lexical_search(none, items).count() == 0
    assert lexical_search.lexical_search(docs, items.where("item_id > 5")).count() == 0
    assert [tuple(r) for r in lexical_search.lexical_search(docs, items).collect()] == ranked([(1, "a b"), (2, None)], [(1, "a b c")], 50)


def test_search_cuts_branches():
    r = np.random.default_rng(2)
    n, terms = 4000, 300
    rows = [np.unique(r.integers(0, 30, 20)) if i % 40 else np.unique(np.r_[r.integers(0, 30, 20), r.integers(200, 300, 20)]) for i in range(n)]
    held = np.r_[0, np.cumsum([len(x) for x in rows])]
    rank = np.concatenate(rows)
    tf, m = r.integers(1, 5, len(rank)), r.integers(50, 200, n)
    tree = lexical_search.Tree(held, rank, tf, m)
    w = np.zeros(terms, np.int64)
    w[rows[80]] = 10 + 30 * (rows[80] >= 200)
    best = lexical_search.Best(10).of(np.arange(n), np.zeros(n, bool))
    leaves = tree.search(w, best)
    score = np.zeros(n, np.int64)
    np.add.at(score, np.repeat(np.arange(n), np.diff(held)), lexical_search.gain(w[rank], tf, np.repeat(m, np.diff(held))))
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert leaves < n // lexical_search.LEAF_DOCS


def test_stretches_are_cut_at_separators():
    text = b"ab cd\tefghijk l"
    parts = list(stretches(text, re.compile(rb"[ \t]"), 3))
    assert b"".join(parts) == text and parts == [b"ab cd\t", b"efghijk ", b"l"]
