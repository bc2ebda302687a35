"""Line dedup by a deletion-neighbourhood join, with DataFrame and SQL functions only.

A line goes if it equals an earlier line, or is at most one word (inserted, deleted or
replaced) away from an earlier line and both have at least MIN_WORDS words. Earlier: smaller
(doc_id, line number); a null doc_id comes after all others. Lines are compared by their
words, which white space separates, case and all. Lines without a word always stay.

How. Equal lines become one class with its earliest place. Two lines one word apart share
their first or their last half, so classes that share neither with another one are left out.
Each remaining class emits the hashed keys of all its variants: the line itself, and the line
without its i-th word, for every i. Classes of equal variants are joined through the earliest
one of a key (deletions of the same place: a replaced word; a deletion and a whole line: an
inserted word), so a key held by many lines makes a row per line and not pairs. The edit
distance of each class and its earliest partner is then verified on the words.

Defined cases. A null text stays null and has no lines; an empty one has one blank line.
Repeated rows (same id and text) are one document and are treated alike; rows of one id with
different texts are ordered by the texts' hash where their line numbers tie. Other columns
are kept. The variants' keys have 64 bits: two variants that collide can hide a partner
(never remove a line wrongly), at about one in 10**7 for 10**6 classes of 50 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import fresh, joined, table
from gaugeworks.session import written

MIN_WORDS = 5
BLOCK = 256


#: White space but the blank, which nearly all lines have alone: a blank is split at faster.
RARE_SPACE = "\t\n\x0b\f\r"


def words(line: Column) -> Column:
    rare = F.lit(False)
    for c in RARE_SPACE:
        rare = rare | F.contains(line, F.lit(c))
    split = F.when(rare, F.split(line, f"[ {RARE_SPACE}]+")).otherwise(F.split(line, " "))
    return F.array_remove(split, "")


def _running_xor(values: str) -> str:
    """SQL for [0, v0, v0 ^ v1, ...], in blocks, so that long lines cost in proportion."""
    scan = "aggregate({0}, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) ^ x)))"
    blocks = f"transform(sequence(0, size({values}) div {BLOCK}), b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform({blocks}, s -> aggregate(s, 0L, (t, x) -> t ^ x))"
    inner = f"transform({blocks}, s -> {scan.format('s')})"
    whole = f"zip_with({inner}, slice({scan.format(totals)}, 1, size({values}) div {BLOCK} + 1), (a, p) -> transform(a, x -> x ^ p))"
    # Each block's last value is the next one's first.
    return f"concat(array(0L), flatten(transform({whole}, a -> slice(a, 2, greatest(size(a) - 1, 0)))))"


def _variants(places: DataFrame) -> DataFrame:
    """places (.., words) plus whole (key of the line) and cut (keys without the i-th word)."""
    hashed = places.select(
        "*",
        F.expr("transform(words, (w, i) -> xxhash64(w, i))").alias("here"),
        F.expr("reverse(transform(words, (w, i) -> xxhash64(w, i - 1)))").alias("moved"),
    )
    # A one-row generator keeps the arrays from being worked out again inside later expressions.
    hashed = hashed.withColumn("h", F.explode(F.array(F.struct("here", "moved")))).drop("here", "moved")
    both = hashed.select(
        "*",
        F.expr(_running_xor("h.here")).alias("before"),
        F.expr(f"reverse({_running_xor('h.moved')})").alias("after"),
    ).drop("h")
    both = both.withColumn("r", F.explode(F.array(F.struct("before", "after")))).drop("before", "after")
    return both.select(
        "*",
        F.expr("element_at(r.before, -1)").alias("whole"),
        F.expr("zip_with(slice(r.before, 1, size(words)), slice(r.after, 2, size(words)), (a, b) -> a ^ b)").alias("cut"),
    ).drop("r")


def line_classes(lines: DataFrame) -> DataFrame:
    """One row per distinct line: key, n, halves (hashed) and its earliest place."""
    n = F.size("words")

    def half(size: Column) -> tuple[Column, Column]:
        first, last = F.slice("words", F.lit(1), size), F.slice("words", n - size + 1, size)
        return F.xxhash64(F.lit("first"), size, first), F.xxhash64(F.lit("last"), size, last)

    more, less = (half(x.cast("int")) for x in (n / 2, (n - 1) / 2))
    # Of an odd number of words both are the same.
    halves = F.when(n % 2 == 1, F.array(*more)).otherwise(F.array(*more, *less))
    return lines.select(
        F.unhex(F.md5(F.array_join("words", " "))).alias("key"),
        n.alias("n"),
        F.when(n >= MIN_WORDS, halves).alias("halves"),
        "place",
    ).groupBy("key", "n", "halves").agg(F.min("place").alias("place"))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line and its place, which sorts by doc_id, line number."""
    # Hashed and split once per document, before there is a row per line.
    lines = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines")
    )
    return lines.select("doc_id", "text_hash", F.posexplode("lines").alias("line", "of")).select(
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line", "text_hash").alias("place"), "of"
    )


def _worded(lines: DataFrame) -> DataFrame:
    """The places and words of the lines that have any."""
    return lines.select("place", F.explode(F.array(words(F.col("of")))).alias("words")).where(F.size("words") > 0)


def earlier_neighbours(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Places of classes that are a word away from an earlier class."""
    halves = classes.where("n >= %d" % MIN_WORDS).select("place", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    near = written(halves.join(shared, "half", "left_semi").select("place").distinct(), "line-candidates")
    # Words are only made of the lines that are looked at.
    lines = _worded(joined(_lines(docs), near, ["place"], "left_semi")).distinct()
    kept = written(_variants(lines), "line-variants")
    cut = kept.select("place", F.posexplode("cut").alias("i", "variant"))
    whole = kept.select("place", F.col("whole").alias("variant"))
    least = F.min("place").alias("partner")
    replaced = cut.groupBy("variant", "i").agg(least, F.count("*").alias("c")).where("c > 1").drop("c")
    replaced = cut.join(replaced, ["variant", "i"]).select("place", "partner")
    matched = cut.join(whole.select("variant").distinct(), "variant", "left_semi")
    longer = matched.join(whole.groupBy("variant").agg(least), "variant").select("place", "partner")
    shorter = whole.join(matched.groupBy("variant").agg(least), "variant").select("place", "partner")
    pairs = written(
        replaced.union(longer).union(shorter).where("partner < place").distinct(), "line-pairs"
    )
    told = pairs.join(kept.select("place", F.col("words").alias("a")), "place").join(
        kept.select(F.col("place").alias("partner"), F.col("words").alias("b")), "partner"
    )
    return told.where(_one_word_apart("a", "b")).select("place").distinct()


def _one_word_apart(a: str, b: str) -> Column:
    """Edit distance in words of at most one: what both share at either end is all but a word."""
    least, most = f"least(size({a}), size({b}))", f"greatest(size({a}), size({b}))"
    def shared(x: str, y: str) -> str:
        same = f"zip_with(slice({x}, 1, {least}), slice({y}, 1, {least}), (p, q) -> p = q)"
        return f"coalesce(nullif(array_position({same}, false), 0) - 1, {least})"
    return F.expr(f"{shared(a, b)} + {shared(f'reverse({a})', f'reverse({b})')} >= {most} - 1 and {most} - {least} <= 1")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with their text's lines that stay, plus n_lines and n_removed (longs)."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    names = docs.columns
    classes = written(line_classes(_worded(_lines(docs))), "line-classes")
    gone = written(earlier_neighbours(docs, classes), "line-near")
    stays = classes.select("place").join(gone, "place", "left_anti")
    # Which lines of a document stay, as one character per line up to the last one that does.
    lists = stays.groupBy("place.doc_id", "place.text_hash").agg(F.sort_array(F.collect_list("place.line")).alias("kept"))
    id_, hash_, mask, lines = fresh(docs, "id", "hash", "mask", "lines")
    masks = lists.select(
        F.col("doc_id").alias(id_),
        F.col("text_hash").alias(hash_),
        F.expr(
            "cast(array_join(zip_with(kept, concat(array(-1), slice(kept, 1, size(kept) - 1)), "
            "(k, p) -> concat(repeat('0', k - p - 1), '1')), '') as binary)"
        ).alias(mask),
    )
    found = docs.join(
        masks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left"
    ).withColumn(mask, F.coalesce(mask, F.lit(b"")))
    split = found.withColumn(lines, F.explode(F.array(F.split("text", "\n"))))
    blank = lambda x: F.size(words(x)) == 0
    stay = F.filter(lines, lambda x, i: (F.substring(F.col(mask), i + 1, F.lit(1)) == F.lit(b"1")) | blank(x))
    split = split.withColumn(hash_, F.explode(F.array(F.struct(F.size(lines).alias("n"), stay.alias("stay")))))
    return split.select(
        *[F.array_join(F.col(hash_)["stay"], "\n").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.col(hash_)["n"], F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col(hash_)["n"] - F.size(F.col(hash_)["stay"]), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), told AS (
  SELECT doc_id, pos, line,
         list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM lines
), classes AS (
  SELECT words, min((doc_id, pos)) AS place FROM told WHERE len(words) > 0 GROUP BY words
), cut AS (
  SELECT place, words, i, list_concat(words[1:i - 1], words[i + 1:]) AS variant
  FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM classes WHERE len(words) >= 5)
), gone AS (
  SELECT place FROM (
    SELECT place, min(place) OVER (PARTITION BY variant, i) AS least FROM cut
  ) WHERE least < place
  UNION
  SELECT greatest(a.place, b.place) FROM cut a JOIN classes b ON a.variant = b.words
  WHERE len(b.words) >= 5
), kept AS (
  SELECT place FROM classes ANTI JOIN gone USING (place)
), stay AS (
  SELECT t.doc_id, t.pos, t.line, k.place IS NOT NULL OR len(t.words) = 0 AS stays
  FROM told t LEFT JOIN kept k ON k.place = (t.doc_id, t.pos)
), by_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
         md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_md5
  FROM stay GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_md5
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; a document that lost every line it had goes."""
    names = docs.columns
    out = line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.size(words(F.col("text"))) == 0)
    return out.where(~emptied).select(names)
