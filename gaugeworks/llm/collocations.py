"""Phrases whose words occur together more often than apart, from suffix subtrees partitioned by prefix.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words
`[^\\x20\\x09]+`. Within a language, n counts all words and f(phrase) its contiguous occurrences
inside pieces. Candidates are phrases of 2 to 5 words with f >= `least`; a candidate's score is the
lowest floor(1000 * a * n / (l * r)) over its cuts in two.

The counts come from suffix trees of the words, truncated at five and partitioned vertically:

1. Words, the prefixes of one word, are counted. A suffix ends where a word is rarer than `least`.
2. Prefixes of two words are counted likewise; a suffix ends where a pair is rarer.
3. Prefixes are put into groups, as many to a group as its memory budget (GROUP_ROWS suffixes) holds:
   they are dealt into slots by hash, and slots with known totals into groups, largest
   first. The prefixes of a slot beyond the budget are extended to the whole suffix and dealt
   over as many groups as they need, which then count parts of a node.
4. Every suffix goes to its prefix's group; equal ones travel once from a task, with a count. A group
   sorts its suffixes, which is the order of its subtree's leaves, and reads the count of each node of
   depth 2 to 5 from the total of the leaves under it. Nodes counted in parts are summed.

The driver holds a number for each slot, SLOTS_PER_GROUP to a group. Rare words and pairs are told by
filters of 2 ** FILTER_BITS bits at most, which only ever add rows.

Defined cases. A null text is empty, a null language is `und`. Repeated rows count as often as they
are there. Words are compared by 64-bit hashes that include the language. An empty table gives no
rows. Counts are 64-bit; products are decimals of 38 digits, exact up to 10 ** 17 words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import Bits, table
from gaugeworks.llm.wording import Tally, mixed, stretches
from gaugeworks.session import written

LEAST = 100
LONGEST = 5
LIMIT = 2000
#: Suffixes that a group's subtree may have: its memory budget (some 60 bytes each).
GROUP_ROWS = 400_000
SLOTS_PER_GROUP = 16
FILTER_BITS = 26
#: Words of a block, and known words of a task.
BLOCK = 1 << 19
KNOWN = 300_000

# A word, or one of the characters that end a piece.
_TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
_SEPARATOR = re.compile(rb"[ \t.,;:!?\n-\r]")
_ENDS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Codes of one language's words; the end of a piece is 0. New words are noted."""

    def __init__(self, lang: str, noted: list | None) -> None:
        self.lang, self.noted = lang, noted
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update(dict.fromkeys(_ENDS, 0))

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        if self.noted is not None:
            self.noted.append((code, word, self.lang))
        return code


def _blocks(
    batches: Iterator[pa.RecordBatch], totals: dict[str, int] | None = None, noted: list | None = None
) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, how many of them are first words): later ones are there to look ahead only.

    Texts follow one another with a 0 between them. totals: words of each language.
    """
    known: dict[str, _Codes] = {}
    held: list[np.ndarray] = []
    size = 0
    end = np.zeros(1, np.uint64)
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            if not text.is_valid:
                continue
            lang = "und" if lang is None else lang
            codes = known.get(lang)
            if codes is None:
                if len(known) > 64:
                    known.clear()
                codes = known[lang] = _Codes(lang, noted)
            for part in stretches(bytes(text.as_buffer()), _SEPARATOR):
                tokens = _TOKEN.findall(part.lower())
                x = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
                if totals is not None:
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(x))
                held.append(x)
                size += len(x)
                if size > BLOCK:
                    x = np.concatenate(held)
                    yield x, len(x) - LONGEST + 1
                    held, size = [x[len(x) - LONGEST + 1 :]], LONGEST - 1
            held.append(end)
            size += 1
    x = np.concatenate([*held, end])
    yield x, len(x)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, null, count) of words; (null, language, count) of all words."""
    totals: dict[str, int] = {}
    tally = Tally()

    def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for keys, counts in found:
            yield pa.RecordBatch.from_pydict(
                {"key": _signed(keys), "lang": pa.nulls(len(keys), pa.string()), "f": pa.array(counts)}
            )

    for x, starts in _blocks(batches, totals):
        x = x[:starts]
        yield from rows(tally.add(x[x != 0]))
    yield from rows(tally.rest())
    yield pa.RecordBatch.from_pydict(
        {
            "key": pa.nulls(len(totals), pa.int64()),
            "lang": pa.array(list(totals), pa.string()),
            "f": pa.array(list(totals.values()), pa.int64()),
        }
    )


def _pairs(x: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the pair that starts at each word, whether both its words are frequent)."""
    second = np.r_[x[1:], np.zeros(1, np.uint64)]
    return mixed(mixed(x) * _STEP + second), frequent & np.r_[frequent[1:], False]


def _dealt(rows: np.ndarray, group: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    columns = {f"w{k}": _signed(np.ascontiguousarray(rows[:, k])) for k in range(rows.shape[1])}
    return pa.RecordBatch.from_pydict({"part": pa.array(group, pa.int32()), **columns, "f": pa.array(count, pa.int64())})


def suffixes(x: np.ndarray, starts: int, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct truncated suffixes, their counts); follows: the word and its next are a frequent pair.

    A suffix ends with the last word that follows so, filled up with zeros.
    """
    at = np.flatnonzero(follows[:starts])
    rows = np.zeros((len(at), LONGEST), np.uint64)
    rows[:, 0] = x[at]
    alive = np.ones(len(at), bool)
    for k in range(1, LONGEST):
        alive &= follows[np.minimum(at + k - 1, len(x) - 1)]
        rows[alive, k] = x[at[alive] + k]
    whole = np.zeros(len(at), np.uint64)
    for k in range(LONGEST):
        whole = mixed(whole * _STEP + rows[:, k])
    _, first, count = np.unique(whole, return_index=True, return_counts=True)
    return rows[first], count


def subtree_nodes(rows: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By depth from 2, (the words of each node, the total of the leaves under it), totals of `least` or more."""
    order = np.lexsort([rows[:, k] for k in reversed(range(rows.shape[1]))])
    rows, count = rows[order], count[order]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for depth in range(1, rows.shape[1] + 1):
        new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
        first = np.flatnonzero(new)
        if depth == 1 or not len(first):
            continue
        total = np.add.reduceat(count, first)
        there = (rows[first, depth - 1] != 0) & (total >= least)
        yield rows[first[there], :depth], total[there]


def pack_slots(totals: dict[int, int], slots: int, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each slot, groups it is dealt over, groups that are whole): largest first, into the most room.

    Slots beyond the budget come after the whole groups, and are dealt over several.
    """
    group, over = np.zeros(slots, np.int64), np.ones(slots, np.int64)
    room: list[tuple[int, int]] = []  # a heap of (used, group)
    ordered = sorted(totals, key=lambda s: (-totals[s], s))
    heavy = [s for s in ordered if totals[s] > budget]
    for slot in ordered[len(heavy) :]:
        used, k = heapq.heappop(room) if room and room[0][0] + totals[slot] <= budget else (0, len(room))
        heapq.heappush(room, (used + totals[slot], k))
        group[slot] = k
    whole = top = max(1, len(room))
    for slot in heavy:
        group[slot], over[slot] = top, -(-totals[slot] // budget)
        top += int(over[slot])
    return group, over, whole


def frequencies(docs: DataFrame, least: int = LEAST, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (words, f) of 1 to 5 words, names (key, word, lang), totals (lang, n)) of docs (text, lang)."""
    spark = docs.sparkSession
    docs = docs.select("text", "lang")
    counted = docs.mapInArrow(_word_counts, "key long, lang string, f long")
    counted = counted.groupBy("key", "lang").agg(F.sum("f").alias("f"))
    counted = written(counted.where(f"key is null or f >= {least}"), "words")
    words = counted.where("key is not null").select("key", "f")
    totals = counted.where("key is null").select("lang", F.col("f").alias("n"))
    common = spark.sparkContext.broadcast(Bits(words, "key", FILTER_BITS))

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, null, count) of pairs; (key, word and language, null) of frequent words."""
        tally = Tally()
        noted: list[tuple[int, bytes, str]] = []

        def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for keys, counts in found:
                yield pa.RecordBatch.from_pydict(
                    {"key": _signed(keys), "name": pa.nulls(len(keys), pa.string()), "f": pa.array(counts)}
                )

        for x, starts in _blocks(batches, noted=noted):
            pair, both = _pairs(x, common.value.has(x) & (x != 0))
            yield from rows(tally.add(pair[:starts][both[:starts]]))
            keys = np.array([c for c, _, _ in noted], np.uint64)
            some = np.flatnonzero(common.value.has(keys))
            # A word has no tab.
            names = [noted[i][1] + b"\t" + noted[i][2].encode() for i in some]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": _signed(keys[some]),
                    "name": pa.array(names, pa.binary()).cast(pa.string()),
                    "f": pa.nulls(len(some), pa.int64()),
                }
            )
            noted.clear()
        yield from rows(tally.rest())

    pairs = docs.mapInArrow(pair_counts, "key long, name string, f long")
    pairs = pairs.groupBy("key", "name").agg(F.sum("f").alias("f"))
    pairs = written(pairs.where(f"name is not null or f >= {least}"), "pairs")
    names = pairs.where("name is not null").select(
        "key",
        F.substring_index("name", "\t", 1).alias("word"),
        F.expr("substring(name, instr(name, '\t') + 1)").alias("lang"),
    )
    pairs = pairs.where("name is null").select("key", "f")
    follow = spark.sparkContext.broadcast(Bits(pairs, "key", FILTER_BITS))
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    slots = SLOTS_PER_GROUP * (total // group_rows + 1)
    sums = pairs.groupBy(F.pmod("key", F.lit(slots)).alias("slot")).agg(F.sum("f").alias("f"))
    packed = spark.sparkContext.broadcast(pack_slots({r.slot: r.f for r in sums.collect()}, slots, group_rows))
    whole = packed.value[2]

    def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, over, _ = packed.value
        for x, starts in _blocks(batches):
            pair, both = _pairs(x, common.value.has(x) & (x != 0))
            rows, count = suffixes(x, starts, both & follow.value.has(pair))
            slot = np.mod(mixed(mixed(rows[:, 0]) * _STEP + rows[:, 1]).view(np.int64), slots)
            spread = np.zeros(len(rows), np.uint64)
            for k in range(LONGEST):
                spread = mixed(spread * _STEP + rows[:, k])
            spread = (spread >> np.uint64(1)).astype(np.int64)
            yield _dealt(rows, group[slot] + spread % over[slot], count)

    def nodes(key: tuple, rows: pa.Table) -> pa.Table:
        found = [rows[f"w{k}"].to_numpy().view(np.uint64) for k in range(LONGEST)]
        keep = least if key[0].as_py() < whole else 1
        phrases: list[pa.Array] = []
        counts = []
        for words_, total_ in subtree_nodes(np.stack(found, axis=1), rows["f"].to_numpy(), keep):
            flat = words_.ravel().view(np.int64)
            offsets = np.arange(0, flat.size + 1, words_.shape[1], dtype=np.int32)
            phrases.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())))
            counts.append(total_)
        kind = pa.list_(pa.int64())
        return pa.table(
            {
                "words": pa.chunked_array(phrases, kind),
                "f": pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64()),
            }
        )

    columns = ", ".join(f"w{k} long" for k in range(LONGEST))
    dealt = docs.mapInArrow(suffix_rows, f"part int, {columns}, f long")
    found = dealt.groupBy("part").applyInArrow(nodes, "words array<long>, f long")
    found = found.groupBy("words").agg(F.sum("f").alias("f")).where(f"f >= {least}")
    phrases = written(found.union(words.select(F.array("key"), "f")), "phrases")
    return phrases, names.dropDuplicates(["key"]), totals


def collocations(docs: DataFrame, least: int = LEAST, limit: int = LIMIT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `limit` best phrases of each language of docs (text, lang)."""
    phrases, names, totals = frequencies(docs, least, group_rows)
    names = written(names, "names")
    candidates = phrases.where("size(words) > 1").select("words", F.col("f").alias("a"))
    # Inside: from the length below its own down to two words.
    longer = candidates.where("size(words) > 2").selectExpr(
        "a", "explode(sequence(2, size(words) - 1)) as n", "words"
    )
    inside = longer.selectExpr(
        "a as outer_a", "explode(transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))) as words"
    )
    inside = inside.groupBy("words").agg(F.max("outer_a").alias("outer_a"))
    stay = candidates.join(inside, "words", "left").where("outer_a is null or 100 * outer_a < 100 * a")
    lang = names.select(F.col("key").alias("first"), "lang")
    stay = stay.drop("outer_a").withColumn("first", F.col("words")[0]).join(lang, "first").drop("first")
    stay = stay.join(totals, "lang")
    cuts = stay.selectExpr(
        "*", "explode(sequence(1, size(words) - 1)) as k"
    ).selectExpr("*", "slice(words, 1, k) as lead", "slice(words, k + 1, size(words) - k) as rest")
    cuts = cuts.join(phrases.selectExpr("words as lead", "f as l"), "lead")
    cuts = cuts.join(phrases.selectExpr("words as rest", "f as r"), "rest")
    score = F.expr(
        "cast((1000bd * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"
    )
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    best = best.select("lang", "words", "a", "n", "cut.score", "cut.l", "cut.r")
    # Phrases are spelt only for those that may be among the first, ties included.
    order = [F.col("score").desc(), F.col("a").desc()]
    near = best.withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
    near = written(near.where(F.col("near") <= limit).drop("near"), "near-best")
    spelt = near.select("words", F.posexplode("words").alias("at", "key")).join(names.select("key", "word"), "key")
    spelt = spelt.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("told"))
    spelt = spelt.select("words", F.array_join(F.col("told.word"), " ").alias("phrase"))
    ranked = near.join(spelt, "words").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    )
    return ranked.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), spans AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), lengths AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM spans
), f AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM lengths GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cands AS (SELECT * FROM f WHERE m >= 2 AND f >= 100),
stay AS (
  SELECT * FROM cands c WHERE NOT EXISTS (
    SELECT 1 FROM cands o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.f >= 100 * c.f
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM stay),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, a.f AS l, b.f AS r, t.n, k,
    ((1000::HUGEINT * c.f * t.n) // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
