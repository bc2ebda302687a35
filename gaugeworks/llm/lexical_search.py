"""The documents that score highest for each item's words, by branch and bound over FP-trees of documents.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. With N
documents of at least one term, L terms in all, n a document's terms and df a term's documents, a
term weighs w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's m is 50 + (50 * n * N) div L,
and its score for an item the sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the item's
terms, once each.

1. The items' terms are the vocabulary. Every document becomes its restricted term vector (the
   vocabulary's terms it holds, with their tf); N, L and all df are counted over all documents.
2. Each task puts its documents' vectors, most frequent term first, into FP-trees of TREE_DOCS
   documents. In the order of their paths a node's documents lie together. Nodes are kept where they
   have at most half the documents of the node kept above, down to leaves of LEAF_DOCS. For its
   children a node keeps the greatest tf of each term below them, and their least m.
3. For each item the tree is searched depth first, the most promising child first. A child's bound is
   the score of a document with those greatest tf and that least m; a branch whose bound is below the
   item's k-th score so far is cut. Leaves are scored exactly. The scores found carry over to the
   task's next tree.
4. The best of each task are merged by a window limited to k rows.

Items are taken in blocks of BLOCK_TERMS different terms, so that a vocabulary's size is bounded however
many items there are (an item's own terms are never split); each block is a pass over the documents.

Defined cases. Null texts and texts without a term hold no terms, on either side. Each row of the items
is an item of its own, also where ids repeat, and each row of the documents a document. Equal scores go by
ascending doc_id, null ids last. Documents that share no term with an item aren't returned for it; nor
are those that only share terms of weight 0. Integers are 64-bit. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import table
from gaugeworks.llm.wording import stretches
from gaugeworks.session import written

BEST = 50
BLOCK_TERMS = 100_000
TREE_DOCS = 20_000
#: Entries (a term of a document) of a tree, beyond its first document.
TREE_ENTRIES = 2_000_000
LEAF_DOCS = 64

# A term's bytes (in UTF-8), and a byte between terms.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms_of(text: str | None) -> set[bytes]:
    return set(_TERM.findall((text or "").encode().lower()))


def _vectors(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, terms, tfs = [], [0], [], []
            for text in batch["text"]:
                found, size = [], 0
                for part in stretches(bytes(text.as_buffer()) if text.is_valid else b"", _BETWEEN):
                    words = _TERM.findall(part.lower())
                    size += len(words)
                    x = np.fromiter(map(vocabulary.get, words, itertools.repeat(-1)), np.int32, len(words))
                    found.append(np.unique(x[x >= 0], return_counts=True))
                term, place = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                tf = np.zeros(len(term), np.int64)
                np.add.at(tf, place, np.concatenate([c for _, c in found]))
                n.append(size)
                held.append(held[-1] + len(term))
                terms.append(term)
                tfs.append(tf)
            if not n:
                continue
            offsets = pa.array(held, pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].cast(pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "terms": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms), pa.int32())),
                    "tfs": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tfs), pa.int64())),
                }
            )

    return run


def gain(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; never less for more tf or less m."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Tree:
    """Documents in the order of their paths, and the nodes kept above them.

    nodes: for each, (term, child and greatest tf of every entry; least m of every child; the
    children: a node's number, or -1 - first document of a leaf).
    """

    def __init__(self, held: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """held: where each document's entries begin, and the end; rank: of each entry's term by frequency."""
        doc = np.repeat(np.arange(len(m)), np.diff(held))
        order = np.lexsort((rank, doc))
        rank, tf = rank[order], tf[order]
        paths = rank.astype(">u4").tobytes()
        keys = [paths[4 * a : 4 * b] for a, b in zip(held[:-1].tolist(), held[1:].tolist())]
        self.order = np.array(sorted(range(len(m)), key=keys.__getitem__), np.int64)
        sizes = np.diff(held)[self.order]
        self.held = np.r_[0, np.cumsum(sizes)]
        entry = np.repeat(held[:-1][self.order] - self.held[:-1], sizes) + np.arange(self.held[-1])
        self.term, self.tf, self.m = rank[entry], tf[entry], m[self.order]
        self.doc = np.repeat(np.arange(len(m)), sizes)
        self.nodes: list[tuple] = []
        if not len(m):
            return
        self.shared = np.zeros(len(m), np.int64)
        for i in range(1, len(m)):
            a, b = self.term[self.held[i - 1] : self.held[i]], self.term[self.held[i] : self.held[i + 1]]
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            self.shared[i] = other[0] if len(other) else k
        # Breadth first: a node's children get their numbers when they are met.
        waiting = [(0, len(m))]
        for a, b in waiting:
            starts = self._children(a, b)
            ends = [*starts[1:], b]
            told = []
            for x, y in zip(starts, ends):
                if y - x > LEAF_DOCS:
                    told.append(len(waiting))
                    waiting.append((x, y))
                else:
                    told.append(-1 - x)
            self.nodes.append((*self._maxima(a, b, np.array(starts)), np.array(told), ends))

    def _children(self, a: int, b: int) -> list[int]:
        """Where the children of documents a to b begin: nodes of at most half of them, small ones put together."""
        done, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            if y - x <= max(LEAF_DOCS, (b - a) // 2):
                done.append((x, y))
                continue
            inner = self.shared[x + 1 : y]
            cuts = x + 1 + np.flatnonzero(inner == inner.min())
            todo += zip([x, *cuts.tolist()], [*cuts.tolist(), y])
        starts, size = [], 0
        for x, y in sorted(done):
            if not starts or size + y - x > LEAF_DOCS:
                starts.append(x)
                size = 0
            size += y - x
        return starts

    def _maxima(self, a: int, b: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        p, q = self.held[a], self.held[b]
        child = np.searchsorted(starts, self.doc[p:q], "right") - 1
        key = self.term[p:q].astype(np.int64) * len(starts) + child
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        most = np.maximum.reduceat(self.tf[p:q][order], first) if len(key) else np.empty(0, np.int64)
        least = np.minimum.reduceat(self.m[a:b], starts - a)
        return key[first] // len(starts), key[first] % len(starts), most, least

    def search(self, w: np.ndarray, best: Best) -> int:
        """Offer `best` every document that may be among the best by the weights of an item's terms (0
        for others); returns the leaves visited."""
        stack = [(np.iinfo(np.int64).max, 0)] if self.nodes else []
        leaves = 0
        while stack:
            bound, at = stack.pop()
            if bound < best.least:
                continue
            if isinstance(at, tuple):
                leaves += 1
                a, b = at
                p, q = self.held[a], self.held[b]
                some = p + np.flatnonzero(w[self.term[p:q]])
                score = np.zeros(b - a, np.int64)
                doc = self.doc[some]
                np.add.at(score, doc - a, gain(w[self.term[some]], self.tf[some], self.m[doc]))
                best.offer(score, self.order[a:b])
                continue
            term, child, most, least, told, ends = self.nodes[at]
            some = np.flatnonzero(w[term])
            bounds = np.zeros(len(told), np.int64)
            np.add.at(bounds, child[some], gain(w[term[some]], most[some], least[child[some]]))
            for k in np.argsort(bounds, kind="stable"):
                if bounds[k] > 0 and bounds[k] >= best.least:
                    below = int(told[k])
                    stack.append((int(bounds[k]), below if below >= 0 else (-1 - below, ends[k])))
        return leaves


class Best:
    """An item's k best (score, id) so far; `least` is what a document must reach to be among them."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score, self.id, self.no_id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def of(self, ids: np.ndarray, no_id: np.ndarray) -> Best:
        self.ids, self.no_ids = ids, no_id
        return self

    def offer(self, score: np.ndarray, rows: np.ndarray) -> None:
        some = score >= self.least
        if not some.any():
            return
        score = np.r_[self.score, score[some]]
        id_, no_id = np.r_[self.id, self.ids[rows[some]]], np.r_[self.no_id, self.no_ids[rows[some]]]
        order = np.lexsort((id_, no_id, -score))[: self.k]
        self.score, self.id, self.no_id = score[order], id_[order], no_id[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _searching(items: list[tuple[int, np.ndarray]], rank: np.ndarray, weight: np.ndarray, terms: int, docs: int, k: int):
    """items: (number, ranks of its terms); rank: of each term; weight: by rank; N and L."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[pa.RecordBatch] = []
        size = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                more = len(part["terms"].flatten())
                if size and (size + part.num_rows > TREE_DOCS or entries + more > TREE_ENTRIES):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size, entries = [], 0, 0
                held.append(part)
                size, entries = size + part.num_rows, entries + more
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _ in items}
        w = np.zeros(len(rank), np.int64)
        for rows in trees(batches):
            lists = rows["terms"].combine_chunks()
            held = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
            m = 50 + np.array([50 * n * docs // terms for n in rows["n"].to_pylist()], np.int64)
            tf = rows["tfs"].combine_chunks().flatten().to_numpy()
            tree = Tree(held, rank[lists.flatten().to_numpy()], tf, m)
            ids = rows["doc_id"].combine_chunks()
            id_, no_id = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for number, own in items:
                w[own] = weight[own]
                tree.search(w, best[number].of(id_, no_id))
                w[own] = 0
        for number, b in best.items():
            if len(b.id):
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array(np.full(len(b.id), number), pa.int64()),
                        "doc_id": pa.array(b.id, pa.int64(), mask=b.no_id),
                        "score": pa.array(b.score, pa.int64()),
                    }
                )

    return run


def _searched(docs: DataFrame, items: list[tuple[int, set[bytes]]], k: int) -> DataFrame:
    """(item, doc_id, score) of a block of items, at most k from each task."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    vectors = docs.select("doc_id", "text").mapInArrow(
        _vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"
    )
    vectors = written(vectors.where("n > 0"), "restricted-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # A row for each of the items' terms at most.
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row[0]] = row[1]
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weight = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df[order]], np.int64
    )
    ranked = [(number, rank[[vocabulary[t] for t in terms]]) for number, terms in items]
    run = _searching(ranked, rank, weight, n_terms, n_docs, k)
    return vectors.where("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    blocks: list[DataFrame] = []
    names: list[tuple] = []
    block: list[tuple[int, set[bytes]]] = []
    seen: set[bytes] = set()

    def search() -> None:
        named = spark.createDataFrame(names, f"item long, item_id {kind}")
        found = _searched(docs, block, k).join(F.broadcast(named), "item")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        blocks.append(written(found.select("item_id", "rank", "doc_id", "score"), "lexical-hits"))

    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        terms = terms_of(row.text)
        if block and len(seen | terms) > block_terms:
            search()
            block, names, seen = [], [], set()
        if terms:
            block.append((number, terms))
            names.append((number, row.item_id))
            seen |= terms
    if block:
        search()
    out = blocks[0] if blocks else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for more in blocks[1:]:
        out = out.union(more)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM docs WHERE len(w) > 0),
items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM benchmark
), tf AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM items) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY t, n_docs
), gains AS (
  SELECT doc_id, t, weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))) AS g
  FROM tf JOIN weights USING (t), totals
), scores AS (
  SELECT item_id, doc_id, sum(g)::BIGINT AS score FROM items JOIN gains USING (t) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
