"""Language identification by compression.

Each language has a zstandard raw-content dictionary of DICTIONARY_BYTES: stretches of training
texts. A text, lower-cased and reduced to its words of letters, is cut into windows of WINDOW bytes;
each window is compressed with each dictionary, and the language with the smallest sum is chosen.
Windows keep a long text from becoming its own dictionary. Sizes are code lengths, so the score
is the chosen language's share of 2**-bits over all languages. A text whose best and second sizes are
closer than MARGIN of the second is marked as rejected (`rejected`); its best language is told still.

Dictionaries take FIT_TEXTS texts of each language, the first by the hash of their id among those
not held out, and more where these are too short to fill one; from each the same number of bytes (all
of a shorter text), in stretches spread over the whole text. No dictionary is cut for another's sake.
Languages with the longest dictionaries (DICTIONARY_BYTES where training texts suffice) are compared
as they are. A rarer one with a shorter dictionary then competes, in order of length, with the best
language so far, whose dictionary is cut to that length for this comparison alone; its size counts as
the best one's plus the difference, plus a handicap for chance: HANDICAP bytes and MARGIN of the size,
times the share of the length that it lacks.

Defined cases. A null text, or one without a letter, is `und` with score 0 and not rejected, and so
is any text if nothing could be learned. Equal sizes: the smaller language name, rejected. Null
languages are not learned; a null id is neither held out nor learned from. Repeated rows get equal
results. Further columns are kept; the added ones replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from gaugeworks.llm.common import held_out, joined, table
from gaugeworks.session import written

FIT_TEXTS = 320
DICTIONARY_BYTES = 96 * 1024
WINDOW = 2048
LEVEL = 6
MARGIN = 0.01
HANDICAP = 2
#: Bytes of one stretch of a text, and cut dictionaries that are kept ready.
STRETCH = 512
READY = 64

# Letters and numerals such as a half; the second form, slower, is letters alone.
_LETTERS_OR_NUMERALS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def plain(text: str) -> bytes:
    """The words of letters, as the letter test of `learn` has them."""
    text = text.lower()
    words = _LETTERS_OR_NUMERALS.findall(text)
    if not all(map(str.isalpha, words)):
        words = _LETTERS.findall(text)
    return " ".join(words).encode()


def quota(sizes: list[int]) -> int:
    """The bytes to take of each text so that all together fill a dictionary."""
    left, q = DICTIONARY_BYTES, 0
    for i, n in enumerate(sorted(sizes)):
        q = -(-left // (len(sizes) - i))
        if n >= q:
            break
        left -= n
    return q


def stretches(raw: bytes, size: int) -> bytes:
    """`size` bytes of raw, in stretches spread evenly over it."""
    if len(raw) <= size:
        return raw
    k = max(1, size // STRETCH)
    each, room = size // k, len(raw) - size // k
    begins = [room // 2] if k == 1 else [room * i // (k - 1) for i in range(k)]
    return b"".join(raw[a : a + each] for a in begins)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of docs (doc_id, text, lang) that aren't held out."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    found: dict[str, bytes] = {}
    limit, short = FIT_TEXTS, None
    while short is None or short:
        some = known if short is None else known.where(F.col("lang").isin(sorted(short)))
        some = some.select("lang", "doc_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
        picked = written(some, "language-sample")
        ends = {r.lang: r.n for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        texts = joined(known, picked.select("lang", "doc_id").distinct(), ["lang", "doc_id"], "inner")
        # Lengths first, then the bytes of a dictionary: whole texts stay where they are.
        sizes: dict[str, list[int]] = {}
        for row in texts.select("lang", "text").mapInArrow(_sizes, "lang string, n long").toLocalIterator():
            sizes.setdefault(row.lang, []).append(row.n + 1)
        short = {x for x, n in ends.items() if n >= limit and sum(sizes.get(x, ())) < DICTIONARY_BYTES}
        quotas = {x: quota(n) for x, n in sizes.items() if x not in short}
        rows = texts.where(F.col("lang").isin(sorted(quotas))).mapInArrow(_taken(quotas), "lang string, h long, doc_id string, raw binary")
        taken: dict[str, list[tuple]] = {}
        for row in rows.toLocalIterator():
            taken.setdefault(row.lang, []).append((row.h, row.doc_id, bytes(row.raw)))
        for lang, parts in taken.items():
            whole = b" ".join(raw for _, _, raw in sorted(parts))[:DICTIONARY_BYTES]
            if whole.strip():
                found[lang] = whole
        limit *= 4
    return found


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(plain(x.as_py())) for x in batch["text"]]
        yield pa.RecordBatch.from_pydict({"lang": batch["lang"].cast(pa.string()), "n": pa.array(n, pa.int64())})


def _taken(quotas: dict[str, int]):
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, ids = batch["lang"].cast(pa.string()), [str(x) for x in batch["doc_id"].to_pylist()]
            raw = [stretches(plain(x.as_py()), quotas[y.as_py()]) for x, y in zip(batch["text"], lang)]
            h = [xxhash.xxh3_64_intdigest(x) >> 1 for x in ids]
            yield pa.RecordBatch.from_pydict(
                {"lang": lang, "h": pa.array(h, pa.int64()), "doc_id": pa.array(ids, pa.string()), "raw": pa.array(raw, pa.binary())}
            )

    return taken


class Sizes:
    """Compressed sizes of a text with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.dictionaries = [dictionaries[x] for x in self.languages]
        lengths = [len(x) for x in self.dictionaries]
        self.longest = [i for i, n in enumerate(lengths) if n == max(lengths)]
        self.shorter = sorted((i for i, n in enumerate(lengths) if n < max(lengths)), key=lambda i: (-lengths[i], i))
        self.whole = [self._compressor(x) for x in self.dictionaries]
        self.cut = lru_cache(maxsize=READY)(lambda i, n: self._compressor(self.dictionaries[i][-n:]))

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)

    def of(self, text: str) -> np.ndarray:
        raw = plain(text)
        parts = [raw[a : a + WINDOW] for a in range(0, len(raw), WINDOW)]

        def size(c: zstandard.ZstdCompressor) -> int:
            return sum(len(c.compress(p)) for p in parts)

        out = np.full(len(self.languages), np.inf)
        for i in self.longest:
            out[i] = size(self.whole[i])
        best = int(out.argmin())
        for i in self.shorter:
            n, of = len(self.dictionaries[i]), len(self.dictionaries[best])
            other = size(self.cut(best, n) if n < of else self.whole[best])
            out[i] = out[best] + size(self.whole[i]) - other + (1 - n / of) * (HANDICAP + MARGIN * other)
            if out[i] < out[best]:
                best = i
        return out


def judged(text: str | None, sizes: Sizes) -> tuple[str, float, bool]:
    if not sizes.languages or not text or not _LETTERS.search(text):
        return "und", 0.0, False
    n = sizes.of(text)
    best = int(n.argmin())
    score = float(1 / np.exp2(np.maximum(-8.0 * (n - n[best]), -1000)).sum())
    second = np.partition(n, 1)[1] if len(n) > 1 else None
    return sizes.languages[best], score, second is not None and bool(second - n[best] < MARGIN * second)


ADDED = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs plus lang_pred, score and rejected."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED])
    names = docs.columns
    text = next(i for i, c in enumerate(names) if c.lower() == "text")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(shared.value)
        for batch in batches:
            found = [judged(x.as_py(), sizes) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                names=[*names, *ADDED],
            )

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return docs.mapInArrow(identified, StructType([*docs.schema.fields, *added]))


def op6_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
