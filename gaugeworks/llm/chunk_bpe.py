"""Encoding and decoding by a public BPE vocabulary, with content-defined chunks encoded once.

A rolling hash of the last 32 bytes cuts texts into chunks of some 500 bytes, wherever they stand, so
that passages which documents share fall into the same chunks.

1. Texts are cut. Equal texts are one from here on, and one row of each stands for it. Chunks are
   counted over the distinct texts; one occurrence of each chunk that has several owns it.
2. Owners encode their shared chunk, whole and by itself: its ids, and how many of them lie before
   its first and after its last blank.
3. Every distinct text encodes what isn't in a shared chunk, and repairs the joins: the text around
   a chunk's edge is encoded anew, as far on either side as until its ids agree with those of the
   chunk. A blank (space, tab, line feeds, form feed, return) never is inside a token and no
   normalisation reaches across it, so that they agree from the chunk's first and last blank on, which
   is verified where the chunk is encoded; a chunk without a blank belongs to the join as a whole,
   however many such follow one another. Texts without shared chunks are done at once.
4. The ids of shared chunks are joined to the texts that hold them and laid in their order between
   the repaired joins.

Tasks encode distinct words once while they remember them (KNOWN words of WORD_BYTES at most).

`encoded` gives ids, `decoded` texts; the query takes digests of both. Decoding joins the ids' pieces
as the tokenizers library does for this vocabulary, which has no decoder: with a space.

Defined cases. A null text is the empty one, without ids. Rows that repeat are encoded once and all
returned, also with null ids. Added tokens of the vocabulary are recognised in texts, as the library
does unless told otherwise. Texts of any length are encoded whole. An empty table gives no rows.
Chunks and texts are compared by 128-bit hashes. Filters of 2 ** FILTER_BITS bits at most tell which
chunks are shared; those taken for shared by mistake are treated so throughout.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm.common import Bits, table
from gaugeworks.llm.wording import STRETCH, stretches
from gaugeworks.session import written

VOCABULARY = "word_bpe_49k.json"
#: A cut where so many bits of the rolling hash are 0; never before MIN bytes, always after MAX.
CUT_BITS = 9
MIN_CHUNK = 64
MAX_CHUNK = 8192
FILTER_BITS = 26
#: Words that a task remembers, and the longest of them.
KNOWN = 300_000
WORD_BYTES = 64
#: Bytes whose rolling hashes are computed at once.
BLOCK = 1 << 21
#: Ids that are spelt at once.
SPELT = 1 << 16

#: Words that go to the library in one call.
JOINT = 1000

# How the vocabulary's file makes words of a text; of ASCII that is _PART, lower-cased.
SPLIT = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_PART = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

#: Parts that the library's byte alphabet leaves as they are.
_PRINTED = re.compile(rb"[!-~]+").fullmatch

_GEAR = np.random.default_rng(12).integers(0, 2**32, 256, dtype=np.uint32)
# The blanks that end a word.
_BLANK = re.compile(rb"[ \t-\r]")


class Known(dict):
    """Ids of words, KNOWN of them at most and those of one call; what was not asked for of late goes first."""

    def __init__(self) -> None:
        self.older: dict[bytes, bytes] = {}

    def lacks(self, words: set[bytes]) -> list[bytes]:
        """Which of the words are to be learned; the others are held until the next call at least."""
        new = words - self.keys()
        if len(self) + len(new) > KNOWN // 2:
            self.older = dict(self) if len(self) <= KNOWN else {}
            self.clear()
            new = words
        older = self.older
        self.update((w, older[w]) for w in new if w in older)
        return [w for w in new if w not in older]


class Encoder:
    """Ids of texts as little-endian bytes, `width` to an id; each distinct word is encoded once.

    Of a vocabulary with SPLIT, words of ASCII without an added token are put together from the ids
    of their parts, which fewer words share.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.type = np.dtype(f"<u{array(self.code).itemsize}")
        self.width = self.type.itemsize
        self.decimal = [str(i) for i in range(size)]
        self.piece = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        told = json.loads(self.tokenizer.to_str())
        added = b"|".join(re.escape(t["content"].encode()) for t in told["added_tokens"])
        self.added = re.compile(added or rb"(?!)").search
        # An added token that is taken as it is, between words, tells where one ends in a joint encoding.
        marks = [t for t in told["added_tokens"] if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = marks[0] if marks else None
        self.splits = {k: told.get(k) for k in SPLIT} == SPLIT
        self.model = self.tokenizer.model
        self.known, self.runs = Known(), Known()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as the library has them."""
        if self.mark is not None and len(words) > 1 and not self.added(b" ".join(words)):
            text = self.mark["content"].join(w.decode() for w in words)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            ends = [*np.flatnonzero(ids == self.mark["id"]).tolist(), len(ids)]
            if len(ends) == len(words):
                raw, w = ids.tobytes(), self.width
                return [raw[w * (a + 1) : w * b] for a, b in zip([-1, *ends], ends)]
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _learn(self, known: dict[bytes, bytes], words: list[bytes]) -> None:
        for at in range(0, len(words), JOINT):
            some = words[at : at + JOINT]
            known.update(zip(some, self._encoded(some)))

    def _by_parts(self, words: list[bytes]) -> list[bytes]:
        parts = [_PART.findall(w.lower()) for w in words]
        new = self.runs.lacks(set(itertools.chain.from_iterable(parts)))
        # A part is a word of the vocabulary's model: nothing is left to normalise or split.
        spelt = [p for p in new if _PRINTED(p)]
        tokens = map(self.model.tokenize, map(bytes.decode, spelt))
        self.runs.update(zip(spelt, (array(self.code, [t.id for t in ts]).tobytes() for ts in tokens)))
        self._learn(self.runs, [p for p in new if p not in self.runs])
        return [b"".join(map(self.runs.__getitem__, p)) for p in parts]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as the library has them, not by words."""
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _of_stretch(self, text: bytes) -> bytes:
        return self.ids([text])[0] if len(text) <= STRETCH else b"".join(self.whole(text.split()))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, by its words."""
        if any(len(t) > STRETCH for t in texts):
            # A stretch may be longer where one word is; it's a word by itself then.
            return [b"".join(self._of_stretch(part) for part in stretches(t, _BLANK)) for t in texts]
        words = [t.split() for t in texts]
        new = self.known.lacks(set(itertools.chain.from_iterable(words)))
        long = {w: self.whole([w])[0] for w in new if len(w) > WORD_BYTES}
        short = [w for w in new if len(w) <= WORD_BYTES]
        if self.splits:
            plain = [w for w in short if w.isascii() and not self.added(w)]
            self.known.update(zip(plain, self._by_parts(plain)))
            short = [w for w in short if w not in self.known]
        self._learn(self.known, short)
        known = self.known.__getitem__ if not long else lambda w: long[w] if len(w) > WORD_BYTES else self.known[w]
        return [b"".join(map(known, w)) for w in words]

    def told(self, ids: bytes) -> tuple[int, str, str]:
        """(number of ids, digest of them in decimals, digest of the decoded text)."""
        x = np.frombuffer(ids, self.type)
        first, second = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(x), SPELT):
            some = x[at : at + SPELT].tolist()
            gap = " " if at else ""
            first.update((gap + " ".join(map(self.decimal.__getitem__, some))).encode())
            second.update((gap + " ".join(map(self.piece.__getitem__, some))).encode())
        return len(x), first.hexdigest(), second.hexdigest()

    def decoded(self, ids: bytes) -> str:
        return " ".join(map(self.piece.__getitem__, np.frombuffer(ids, self.type).tolist()))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One to a worker, so that its tasks share what is known."""
    return Encoder(path)


def chunk_ends(text: bytes) -> list[int]:
    """Where each chunk ends: by content, never inside a character."""
    data = np.frombuffer(text, np.uint8)
    found = []
    for at in range(0, len(data), BLOCK):
        back = min(at, 31)
        h = _GEAR[data[at - back : at + BLOCK]]
        # After k rounds h sums 2 ** k bytes, each shifted by its distance.
        for k in (1, 2, 4, 8, 16):
            before = h[:-k] << np.uint32(k)
            h[k:] += before
        found.append(at + 1 + np.flatnonzero((h >> np.uint32(32 - CUT_BITS))[back:] == 0))
    ends, last = [], 0
    for end in itertools.chain(*(f.tolist() for f in found), [len(data)]):
        while end - last > MAX_CHUNK:
            last = _start_of_character(data, last + MAX_CHUNK)
            ends.append(last)
        if end - last >= MIN_CHUNK or end == len(data):
            end = _start_of_character(data, end)
            if end > last:
                ends.append(end)
                last = end
    return ends


def _start_of_character(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _blanks(text: bytes, a: int, b: int) -> tuple[int, int] | None:
    """Places of the first and the last blank of a chunk."""
    first = _BLANK.search(text, a, b)
    if first is None:
        return None
    return first.start(), max(text.rfind(bytes([c]), a, b) for c in b" \t\n\x0b\x0c\r")


def _long(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _standing(key: bytes, doc_id: object) -> int:
    return _long(xxhash.xxh3_64_digest(key + repr(doc_id).encode()))


def _place(key: bytes, chunk: bytes, at: int) -> int:
    return _long(xxhash.xxh3_64_digest(b"%s%s%d" % (key, chunk, at)))


def _bytes(text: pa.Scalar) -> bytes:
    return bytes(text.as_buffer()) if text.is_valid else b""


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its text's key, what it'd stand by, and the chunks: hash, its first 8 bytes, place."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = _bytes(text)
            key = _text_key(text)
            ends = chunk_ends(text)
            chunks = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)]
            rows.append(
                {
                    "doc_id": doc_id,
                    "text_key": key,
                    "standing": _standing(key, doc_id),
                    "chunks": [
                        {"chunk": c, "mark": _long(c), "place": _place(key, c, i)} for i, c in enumerate(chunks)
                    ],
                }
            )
        item = pa.struct([("chunk", pa.binary()), ("mark", pa.int64()), ("place", pa.int64())])
        schema = pa.schema(
            [("doc_id", batch["doc_id"].type), ("text_key", pa.binary()), ("standing", pa.int64()), ("chunks", pa.list_(item))]
        )
        yield pa.RecordBatch.from_pylist(rows, schema)


def pieces_of(text: bytes, ends: list[int], shared: list[bool]) -> list[tuple[int, bytes]]:
    """(order, text) of what a text encodes itself: between the blanks of its shared chunks, joins included.

    The inside of shared chunk i has order 2 * i + 1, what lies before it 2 * i.
    """
    out = []
    last = 0
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        inside = _blanks(text, a, b) if shared[i] else None
        if inside is None:
            continue
        # What the chunk's own encoding has before its first blank is encoded with what lies before it.
        if inside[0] > last:
            out.append((2 * i, text[last : inside[0]]))
        last = inside[1]
    if last < len(text):
        out.append((2 * len(ends), text[last:]))
    return out


def insides(own: Encoder, chunks: list[bytes]) -> list[bytes]:
    """What joins leave of each chunk's own ids: those between its first and its last blank.

    Joins encode what lies outside anew, by words. That their ids and those of the chunk, encoded
    whole, agree from the blanks on is verified here for every chunk.
    """
    parts = []
    for c in chunks:
        a, b = _blanks(c, 0, len(c)) or (len(c), len(c))
        parts += [c[:a], c[a:b], c[b:]]
    ids = own.ids(parts)
    out = []
    for k, whole in enumerate(own.whole(chunks)):
        head, mid, tail = ids[3 * k : 3 * k + 3]
        if whole != head + mid + tail:
            raise ValueError("tokens of this vocabulary reach across blanks")
        out.append(whole[len(head) : len(whole) - len(tail)])
    return out


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of docs (doc_id, text), ids as little-endian binary; with digests
    (doc_id, n_tokens, ids_sha256, decoded_sha256) instead, which never carries a text's ids further than it must."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunk_type = "array<struct<chunk: binary, mark: long, place: long>>"
    rows = written(
        docs.mapInArrow(_chunked, f"doc_id {id_type}, text_key binary, standing long, chunks {chunk_type}"), "chunked"
    )
    texts = written(
        rows.groupBy("text_key").agg(F.min("standing").alias("standing"), F.first("chunks").alias("chunks")), "texts"
    )
    held = texts.select("text_key", F.posexplode("chunks").alias("at", "c")).select("text_key", "at", "c.*")
    counted = held.groupBy("chunk", "mark").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    counted = written(counted, "chunks")
    sc = spark.sparkContext
    shared = sc.broadcast(Bits(counted.where("n > 1").select("mark"), "mark", FILTER_BITS))

    def taken_for_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch["mark"].to_numpy())))

    owners = counted.select("chunk", "mark", "place").mapInArrow(taken_for_shared, "chunk binary, mark long, place long")
    owners = sc.broadcast(Bits(written(owners.select("place"), "owners"), "place", FILTER_BITS))
    standing = sc.broadcast(Bits(texts.select("standing"), "standing", FILTER_BITS))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes, list[int], list[bytes], np.ndarray]]]:
        """(key, text, chunk ends, chunks, those taken for shared) of the rows that stand for their text."""
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = _bytes(text)
                key = _text_key(text)
                if key in seen or not standing.value.has(np.array([_standing(key, doc_id)], np.int64))[0]:
                    continue
                # Only saves work: a text that is met again would be dropped later.
                if len(seen) < KNOWN:
                    seen.add(key)
                ends = chunk_ends(text)
                chunks = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)]
                marks = np.array([_long(c) for c in chunks], np.int64)
                out.append((key, text, ends, chunks, shared.value.has(marks)))
            yield out

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for found in distinct(batches):
            names, mine = [], []
            for key, text, ends, chunks, told in found:
                if not told.any():
                    continue
                places = np.array([_place(key, c, i) for i, c in enumerate(chunks)], np.int64)
                for i in np.flatnonzero(told & owners.value.has(places)).tolist():
                    names.append(chunks[i])
                    mine.append(text[ends[i - 1] if i else 0 : ends[i]])
            columns = [pa.array(names, pa.binary()), pa.array(insides(own, mine), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for found in distinct(batches):
            parts = [(key, told.any(), pieces_of(text, ends, told.tolist())) for key, text, ends, _, told in found]
            ids = iter(own.ids([text for _, _, pieces in parts for _, text in pieces]))
            rows = []
            for key, some, pieces in parts:
                for order, _ in pieces:
                    rows.append((key, order, next(ids)))
                if not pieces:
                    rows.append((key, 0, b""))
                if not some and digests:
                    # Done: nothing is to come from elsewhere.
                    rows[-1] = (key, None, b"".join(_packed(own.told(rows[-1][2]))))
            yield pa.RecordBatch.from_pydict(
                {
                    "text_key": pa.array([r[0] for r in rows], pa.binary()),
                    "at": pa.array([r[1] for r in rows], pa.int64()),
                    "ids": pa.array([r[2] for r in rows], pa.binary()),
                }
            )

    once = written(docs.mapInArrow(owned, "chunk binary, ids binary").dropDuplicates(["chunk"]), "encoded-chunks")
    kind = "text_key binary, at long, chunk binary, mark long"
    wanted = held.select("text_key", F.expr("2L * at + 1").alias("at"), "chunk", "mark")
    wanted = wanted.mapInArrow(taken_for_shared, kind).drop("mark")
    fetched = wanted.join(once, "chunk").select("text_key", "at", "ids")
    parts = docs.mapInArrow(others, "text_key binary, at long, ids binary").union(fetched)
    parts = parts.repartition("text_key").sortWithinPartitions("text_key", "at")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        key, last, held_ids = None, None, []

        def row() -> tuple:
            if last is None:
                n, a, b = _unpacked(held_ids[0])
                return key, n, None, a, b
            ids = b"".join(held_ids)
            if not digests:
                return key, len(ids) // own.width, ids, None, None
            return (key, *_with_ids(own.told(ids)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string())
            columns = zip(*rows) if rows else [()] * len(kinds)
            names = ["text_key", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            rows = []
            for k, at, ids in zip(batch["text_key"].to_pylist(), batch["at"].to_pylist(), batch["ids"].to_pylist()):
                if k != key:
                    if key is not None:
                        rows.append(row())
                    key, last, held_ids = k, at, [ids]
                elif at != last:  # otherwise it is met again
                    last = at
                    held_ids.append(ids)
            yield batch_of(rows)
        if key is not None:
            yield batch_of([row()])

    done = parts.mapInArrow(
        laid, "text_key binary, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    )
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids"]
    return rows.select("doc_id", "text_key").join(done, "text_key").select("doc_id", *names)


def _with_ids(told: tuple[int, str, str]) -> tuple:
    return told[0], None, told[1], told[2]


def _packed(told: tuple[int, str, str]) -> tuple[bytes, ...]:
    return told[0].to_bytes(8, "little"), told[1].encode(), told[2].encode()


def _unpacked(packed: bytes) -> tuple[int, str, str]:
    return int.from_bytes(packed[:8], "little"), packed[8:72].decode(), packed[72:].decode()


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decoded(_bytes(x)) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digests=True)
