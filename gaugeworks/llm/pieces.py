"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding merges the characters of a text by the model's pieces, best score first, leftmost of
equal ones, as byte-pair models do; every candidate merge is skipped with probability `dropout`,
decided by a hash of (seed, document id, the word's place in the text, the word, the places where the
two parts begin, meet and end). One seed always gives one segmentation; another seed, another document
or another occurrence of a word gives its own. Without dropout the result is the model's own.

No piece goes on after a space (it may begin with some) and none holds a line feed, so words are
segmented one by one; every occurrence by itself (without dropout each different word once), those of a length
together: the agenda is then a column of candidate ranks per word, of which every step takes the
least. A word that is met again is first merged without dropout, and an occurrence of which none of those
merges is skipped ends alike: other candidates were never the least, skipped or not. Words that are long or
hold characters without a piece take an agenda of their own (a heap) and bytes for such characters.

Decoding joins the pieces' bytes, and is lossless for every text, spaces and the model's space
sign included.

Defined cases. Null texts have null ids and decode to null; empty ones have no ids. Repeated rows
get equal ids, rows with a null id those of a document called null. Texts of any length are encoded whole.
Further columns are kept; the added ones replace columns of their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from gaugeworks.llm.common import table

MODEL = "piece_bpe_32k.model"
SEED = 20
DROPOUT = 0.1
#: Words of more characters are taken one by one.
LONG = 20
#: Bits of a place in a word that is not.
PLACE_BITS = 5
#: Characters that are worked on at once; a longer text is worked on alone.
STRETCH = 1_000_000
#: Occurrences of a length that are merged at once.
AT_ONCE = 50_000
SPACE = "▁"
WORD = re.compile(r" *[^ \n]+|\n| +")
NONE = np.int32(2**31 - 1)

FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * FACTORS[1]
    x = (x ^ (x >> np.uint64(27))) * FACTORS[2]
    return x ^ (x >> np.uint64(31))


class Model:
    """Pieces of a model: their merges as a table of pairs, and their bytes."""

    def __init__(self, path: str) -> None:
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        plain = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        text = {i: own.id_to_piece(i).replace(SPACE, " ") for i in plain}
        if any("\n" in x or " " in x.lstrip(" ") for x in text.values()):
            raise ValueError("pieces go across words")
        ids = {x: i for i, x in text.items()}
        order = sorted(plain, key=lambda i: (-own.get_score(i), i))
        rank = np.full(n, NONE, np.int32)
        rank[order] = np.arange(len(order))
        self.id_of = np.array(order, np.int32)
        self.pairs: dict[tuple[int, int], int] = {}
        for x, i in ids.items():
            for cut in range(1, len(x)):
                left, right = ids.get(x[:cut]), ids.get(x[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = int(rank[i])
        self.size = n
        keys = np.array([a * n + b for a, b in self.pairs], np.int64)
        self.bits = 22
        slots = np.full(1 << self.bits, -1, np.int64)
        ranks = np.full(1 << self.bits, NONE, np.int32)
        for key, r in zip(keys.tolist(), self.pairs.values()):  # open addressing
            at = int(self._slot(np.array([key]))[0])
            while slots[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            slots[at], ranks[at] = key, r
        self.slots, self.ranks = slots, ranks
        self.of_char = np.full(0x110000, -1, np.int32)
        for x, i in ids.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        self.byte_id = np.full(256, -1, np.int32)
        for i in range(n):
            if own.is_byte(i):
                self.byte_id[int(own.id_to_piece(i)[1:-1], 16)] = i
        raw = [text[i].encode() if i in text else bytes([int(own.id_to_piece(i)[1:-1], 16)]) if own.is_byte(i) else b"" for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * FACTORS[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two adjacent ones make, NONE without one."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[(held >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=2)
def model(name: str = MODEL) -> Model:
    return Model(public_tokenizers.path(name))


def skipped(word: np.ndarray, begin: np.ndarray, meet: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of [begin, meet) and [meet, end) is skipped; word: keyed hashes of the words."""
    u = np.uint64
    h = _mixed(word + begin.astype(u) * FACTORS[0] + meet.astype(u) * FACTORS[1] + end.astype(u) * FACTORS[3])
    return (h >> u(11)).astype(np.float64) < dropout * 2.0**53


def _by_agenda(m: Model, word: str, key: int, dropout: float) -> list[int]:
    """Ids of one word, with a heap of candidate merges."""
    ids = [int(m.of_char[ord(c)]) for c in word]
    n = len(ids)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    agenda: list[tuple[int, int, int, int]] = []
    one = np.array([key], np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and ids[i] >= 0 and ids[j] >= 0:
            rank = m.pairs.get((ids[i], ids[j]))
            if rank is not None and not skipped(one, np.array([i]), np.array([j]), np.array([end[j]]), dropout)[0]:
                heapq.heappush(agenda, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while agenda:
        rank, i, j, stop = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j]) or after[i] != j or end[j] != stop or end[i] != j:
            continue
        ids[i], end[i], after[i], alive[j] = int(m.id_of[rank]), stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            out += [ids[i]] if ids[i] >= 0 else [int(m.byte_id[b]) for b in word[i].encode()]
    return out


def _by_length(
    m: Model, chars: np.ndarray, keys: np.ndarray, dropout: float, steps: list[tuple[np.ndarray, ...]] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of words of one length; chars: ids of their characters, words x length.

    Pieces stand at the place of their first character, a column to a word. An agenda's entry is the
    rank of a merge and its place, so that the least one is the best merge, the leftmost of equal ones.
    steps is given the merges made: word, and where the two parts begin, meet and end.
    """
    n, width = chars.shape
    ids = np.ascontiguousarray(chars.T)
    places = np.arange(width + 1, dtype=np.int32)[:, None]
    after = np.repeat(places + 1, n, axis=1)
    before = np.repeat(places - 1, n, axis=1)
    alive = np.ones((width, n), bool)

    def offers(rows: np.ndarray, begin: np.ndarray, meet: np.ndarray, end: np.ndarray) -> np.ndarray:
        rank = m.merge_rank(ids[begin, rows], ids[meet, rows])
        some = np.flatnonzero(rank != NONE)
        if dropout > 0 and len(some):
            some = some[~skipped(keys[rows[some]], begin[some], meet[some], end[some], dropout)]
        out = np.full(len(rows), NONE, np.int32)
        out[some] = (rank[some] << PLACE_BITS) | begin[some]
        return out

    # The last place begins no pair.
    agenda = np.full((width, n), NONE, np.int32)
    rows = np.arange(n)
    if width > 1:
        begin = np.repeat(places[: width - 1, 0], n)
        agenda[:-1] = offers(np.tile(rows, width - 1), begin, begin + 1, begin + 2).reshape(width - 1, n)
    while True:
        best = agenda.min(axis=0)
        live = np.flatnonzero(best != NONE)
        if not len(live):
            break
        if 4 * len(live) < 3 * len(best):
            agenda, rows, best = agenda[:, live], rows[live], best[live]
            live = np.arange(len(live))
        r, best = rows[live], best[live]
        begin = best & ((1 << PLACE_BITS) - 1)
        meet = after[begin, r]
        end = after[meet, r]
        if steps is not None:
            steps.append((r, begin, meet, end))
        ids[begin, r] = m.id_of[best >> PLACE_BITS]
        after[begin, r], before[end, r], alive[meet, r] = end, begin, False
        # The merged pair's entries go; its neighbours are offered anew.
        agenda[begin, live] = agenda[meet, live] = NONE
        right, left = np.flatnonzero(end < width), np.flatnonzero(begin > 0)
        first = np.concatenate([begin[right], before[begin[left], r[left]]])
        second = np.concatenate([end[right], begin[left]])
        third = np.concatenate([after[end[right], r[right]], end[left]])
        both = np.concatenate([right, left])
        agenda[first, live[both]] = offers(r[both], first, second, third)
    return ids.T[alive.T], alive.sum(axis=0)


class Usual:
    """Words of one length as they are without dropout: their ids, and the merges that lead there.

    A word of which no such merge is skipped ends as here: what else is skipped was never the best.
    """

    def __init__(self, m: Model, chars: np.ndarray) -> None:
        steps: list[tuple[np.ndarray, ...]] = []
        self.ids, self.counts = _by_length(m, chars, np.empty(0, np.uint64), 0, steps)
        self.at = np.cumsum(self.counts) - self.counts
        word, *places = [np.concatenate(x) for x in zip(*steps)] if steps else [np.empty(0, np.int64)] * 4
        order = np.argsort(word, kind="stable")
        self.begin, self.meet, self.end = (x[order] for x in places)
        self.merges = np.bincount(word, minlength=len(chars))
        self.merged_at = np.cumsum(self.merges) - self.merges

    def holds(self, words: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
        """Which occurrences (the word of each, and its key) end so."""
        owner = np.repeat(np.arange(len(words)), self.merges[words])
        step = _ragged(self.merged_at[words], self.merges[words])
        out = np.ones(len(words), bool)
        out[owner[skipped(keys[owner], self.begin[step], self.meet[step], self.end[step], dropout)]] = False
        return out

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[_ragged(self.at[words], self.counts[words])], self.counts[words]


def encode_words(m: Model, words: list[str], key: int | np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words laid end to end, number of ids of each); key: one for all, or hashes, one for each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    chars = m.of_char[points]
    unknown = np.zeros(len(words), bool)
    unknown[np.searchsorted(starts, np.flatnonzero(chars < 0), "right") - 1] = True
    counts = np.zeros(len(words), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    keyed = key if isinstance(key, np.ndarray) else np.full(len(words), _key(key))

    def word_keys(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = keyed[rows]
        for column in points[at].T:
            h = _mixed(h * FACTORS[0] + column)
        return h

    # Words that are met again share what they are without dropout.
    same = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy() if dropout > 0 else np.arange(len(words))
    again = np.bincount(same, minlength=1)[same] > 1
    for size in np.unique(sizes[(sizes <= LONG) & ~unknown]):
        whole = (sizes == size) & ~unknown
        alone, common = np.flatnonzero(whole & ~again), np.flatnonzero(whole & again)
        if len(common):
            _, first, word = np.unique(same[common], return_index=True, return_inverse=True)
            usual = Usual(m, chars[starts[common[first]][:, None] + np.arange(size)])
            for part in np.split(np.arange(len(common)), range(AT_ONCE, len(common), AT_ONCE)):
                rows = common[part]
                held = usual.holds(word[part], word_keys(rows, starts[rows][:, None] + np.arange(size)), dropout)
                ids, counts[rows[held]] = usual.of(word[part[held]])
                found.append((rows[held], ids))
                alone = np.concatenate([alone, rows[~held]])
        for rows in np.split(alone, range(AT_ONCE, len(alone), AT_ONCE)):
            at = starts[rows][:, None] + np.arange(size)
            ids, n = _by_length(m, chars[at], word_keys(rows, at), dropout)
            counts[rows] = n
            found.append((rows, ids))
    for row in np.flatnonzero((sizes > LONG) | unknown):
        at = starts[row] + np.arange(sizes[row])
        h = _long_key(points[at], keyed[row]) if sizes[row] > LONG else int(word_keys(np.array([row]), at[None, :])[0])
        ids = np.array(_by_agenda(m, words[row], h, dropout), np.int32)
        counts[row] = len(ids)
        found.append((np.array([row]), ids))
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for rows, ids in found:
        out[_ragged(ends[rows] - counts[rows], counts[rows])] = ids
    return out, counts


def _long_key(points: np.ndarray, keyed: np.uint64) -> int:
    return xxhash.xxh3_64_intdigest(points.tobytes(), seed=int(keyed))


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each stretch, laid end to end."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _key(key: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True)))


def encode_texts(m: Model, texts: list[str], key: int | list[int], dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids laid end to end, number of ids of each text); key: one for all, or one for each text."""
    words = [WORD.findall(" " + t) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n)
    if dropout > 0:
        own = np.array([_key(k) for k in (key if isinstance(key, list) else [key] * len(texts))], np.uint64)
        place = _ragged(np.zeros(len(n), np.int64), n).astype(np.uint64)
        keyed = _mixed(np.repeat(own, n) + place * FACTORS[0])
        ids, counts = encode_words(m, [w for ws in words for w in ws], keyed, dropout)
        total = np.r_[0, np.cumsum(counts)]
        return ids, total[ends] - total[ends - n]
    flat = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    ids, counts = encode_words(m, flat.dictionary.to_pylist(), 0, dropout)
    use = flat.indices.to_numpy()
    begin = np.cumsum(counts) - counts
    ids = ids[_ragged(begin[use], counts[use])]
    total = np.r_[0, np.cumsum(counts[use])]
    return ids, total[ends] - total[ends - n]


def decode_ids(m: Model, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of each text."""
    sizes = m.raw_size[ids]
    raw = m.raw[_ragged(m.raw_at[ids], sizes)].tobytes()
    total = np.r_[0, np.cumsum(sizes)]
    ends = np.cumsum(counts)
    # The space put before a text is no part of it.
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(total[ends - counts].tolist(), total[ends].tolist())]


def document_key(seed: int, doc_id: object) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}") >> 1


ADDED = ("n_pieces", "ids_crc32", "lossless", "ids")


def encode(
    docs: DataFrame, seed: int = SEED, dropout: float = DROPOUT, vocabulary: str = MODEL, with_ids: bool = True
) -> DataFrame:
    """docs plus n_pieces, ids_crc32, lossless (they decode to the text) and, unless told otherwise, ids."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED])
    names = docs.columns
    text, doc_id = (next(i for i, c in enumerate(names) if c.lower() == x) for x in ("text", "doc_id"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            texts, ids = batch.column(text).to_pylist(), batch.column(doc_id).to_pylist()
            done: list[tuple] = [(None, None, None, None)] * len(texts)
            for part in _stretches([i for i, t in enumerate(texts) if t is not None], texts):
                own = [texts[i] for i in part]
                found, counts = encode_texts(m, own, [document_key(seed, ids[i]) for i in part], dropout)
                back = decode_ids(m, found, counts)
                ends = np.cumsum(counts)
                for i, t, b, a, z in zip(part, own, back, (ends - counts).tolist(), ends.tolist()):
                    each = found[a:z]
                    crc = zlib.crc32(each.astype("<u4").tobytes())
                    done[i] = (z - a, crc, b == t.encode(), each if with_ids else None)
            out = [
                pa.array([x[0] for x in done], pa.int64()),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([x[2] for x in done], pa.bool_()),
            ]
            if with_ids:
                out.append(pa.array([x[3] for x in done], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*names, *ADDED[: len(out)]])

    added = [StructField("n_pieces", LongType()), StructField("ids_crc32", LongType()), StructField("lossless", BooleanType())]
    added += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    return docs.mapInArrow(encoded, StructType([*docs.schema.fields, *added]))


def _stretches(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    part, size = [], 0
    for i in rows:
        if part and size + len(texts[i]) > STRETCH:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


def decode(encoded: DataFrame, vocabulary: str = MODEL, column: str = "decoded") -> DataFrame:
    """encoded plus the text of its ids."""
    encoded = encoded.select([c for c in encoded.columns if c.lower() != column.lower()])
    names = encoded.columns
    at = next(i for i, c in enumerate(names) if c.lower() == "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            lists = batch.column(at)
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            flat = [x.values.to_numpy() for x in lists if x.is_valid and len(x.values)]
            back = decode_ids(m, np.concatenate(flat) if flat else np.empty(0, np.int32), counts)
            texts = [b.decode("utf-8", "replace") if x.is_valid else None for x, b in zip(lists, back)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, column])

    return encoded.mapInArrow(decoded, StructType([*encoded.schema.fields, StructField(column, StringType())]))


def op4_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, with_ids=False).select("doc_id", "n_pieces", "ids_crc32", "lossless")
