"""Small documents with every defined case, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, letters: str = "abcdeéß", n: int = 300) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(1, 8))) for _ in range(n)]


def texts(seed: int = 1) -> list[str | None]:
    """Copies, near copies, shared passages and lines, odd texts."""
    r, w = random.Random(seed), words(seed)
    base = [
        "\n".join(" ".join(r.choices(w, k=r.randint(1, 30))) for _ in range(r.randint(1, 6))) for _ in range(25)
    ]
    out: list[str | None] = [None, "", " \n\t ", "a", "a" * 1000, "ab " * 400, "x" * 199, "y" * 200, "y" * 200]
    passage = " ".join(r.choices(w, k=60))
    for b in base:
        out.append(b)
        if r.random() < 0.3:
            out.append(b)
        for _ in range(r.randint(0, 3)):
            parts = b.split(" ")
            for _ in range(r.randint(1, 3)):
                parts[r.randrange(len(parts))] = r.choice(w)
            out.append(" ".join(parts))
        if r.random() < 0.4:
            at = r.randrange(len(b) + 1)
            out.append(b[:at] + passage + b[at:])
    out.append(" ".join(r.choices(w, k=20_000)))
    return out


def documents(spark, rows: list[str | None], **extra: str):
    """documents with null ids, a repeated row and columns whose names clash with those the operators add."""
    lang = ["en", "de", None]
    data = [(i, t, lang[i % 3], f"s{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    for name, kind in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(rows: list[str | None]) -> list[tuple[int, int]]:
    """(set size, component) of each document."""
    sets = [shingles(t) for t in rows]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    return list(zip(map(len, sets), components(len(rows), links)))


def repeats(rows: list[str | None], window: int = 200) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, runs, kept bytes) of each document."""
    seen: collections.Counter = collections.Counter()
    raw = [(t or "").encode() for t in rows]
    for b in raw:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def one_word_apart(a: list[str], b: list[str]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def lines(rows: list[str | None]) -> list[tuple[str | None, int, int]]:
    """(text that stays, lines, lines removed) of each document, ids being places in the list."""
    import re

    split = lambda x: [w for w in re.split(r"[ \t\n\x0b\f\r]+", x) if w]
    first: list[list[str]] = []
    known: dict[tuple[str, ...], bool] = {}
    out = []
    for t in rows:
        if t is None:
            out.append((None, 0, 0))
            continue
        stay, n = [], 0
        for line in t.split("\n"):
            n += 1
            w = split(line)
            if not w:
                stay.append(line)
                continue
            if tuple(w) in known:
                continue
            near = len(w) >= 5 and any(len(o) >= 5 and one_word_apart(w, o) for o in first)
            known[tuple(w)] = not near
            first.append(w)
            if not near:
                stay.append(line)
        out.append(("\n".join(stay), n, n - len(stay)))
    return out
