"""Column helpers for hashing, sampling, patterns and label maps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

# The patterns of the validator.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URI = r"^[a-zA-Z][a-zA-Z0-9+.-]*:\/\/"
SHA256_HEX = r"^[0-9a-f]{64}$"
BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"

# Free-text forms of the same things (no anchors).
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# The leading group stands in for a word boundary, whose meaning differs by engine.
IPV4_IN_TEXT = r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_match(c: Column, pattern: str) -> Column:
    """Java's `$` also matches before a final line break; `\\z` does not."""
    return F.rlike(c, F.lit(pattern[:-1] + r"\z" if pattern.endswith("$") else pattern))


def hash_pii(c: str | Column, salt: str) -> Column:
    """Lower-case hex SHA-256 of salt followed by value, in UTF-8."""
    return F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256)


def is_hashed_or_encoded(c: str | Column, strict: bool = False) -> Column:
    """True for a SHA-256 digest or (unless strict) base64-looking text; null is false."""
    c = col(c)
    hashed = full_match(c, SHA256_HEX)
    if not strict:
        hashed = hashed | (full_match(c, BASE64) & (F.length(c) % 4 == 0))
    return F.coalesce(hashed, F.lit(False))


def hash_fraction(c: str | Column, seed: int | str) -> Column:
    """A number in [0, 1) fixed by seed and value, the same in every run and task."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col(c).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def put_labels(labels: Column, new: Mapping[str, Column]) -> Column:
    """The label map with `new` laid over it; keys whose value is null are left out."""
    names = list(new)
    kept = F.map_filter(
        F.coalesce(labels, F.create_map().cast("map<string,string>")),
        lambda k, _: ~k.isin(*names),
    )
    added = F.map_filter(
        F.create_map(*[x for k in names for x in (F.lit(k), new[k].cast("string"))]),
        lambda _, v: v.isNotNull(),
    )
    return F.map_concat(kept, added)


def drop_labels(labels: Column, names: Iterable[str]) -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def label_entries(labels: Column) -> Column:
    """A map as a sorted entry array: comparable, groupable, hashable."""
    return F.array_sort(F.map_entries(labels))


def hashable(df: DataFrame) -> list[Column]:
    """The columns as a hash can read them: maps as sorted entries; variants and maps inside
    other values are left out."""

    def readable(kind: DataType) -> bool:
        return not any(word in kind.simpleString() for word in ("map<", "variant"))

    out = []
    for field in df.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, MapType) and readable(kind.keyType) and readable(kind.valueType):
            out.append(F.array_sort(F.map_entries(column)))
        elif readable(kind):
            out.append(column)
    return out or [F.lit(0)]


def bound_text(bound: float) -> str:
    """A bucket bound in the fewest digits, with an exponent below 1e-4 and from 1e+06."""
    if bound in (float("inf"), float("-inf")):
        return "+Inf" if bound > 0 else "-Inf"
    sign, digits, exponent = Decimal(repr(float(bound))).normalize().as_tuple()
    number = "".join(map(str, digits))
    power = len(number) + exponent - 1
    if number == "0":
        body = "0"
    elif power < -4 or power >= 6:
        mantissa = number[0] + ("." + number[1:] if number[1:] else "")
        body = f"{mantissa}e{power:+03d}"
    else:
        body = format(Decimal((0, digits, exponent)), "f")
    return ("-" if sign else "") + body


def bound_text_sql(bound: str) -> str:
    """`bound_text` as SQL over an expression of type double.

    The engine writes 1.5E7 where an exponent is wanted, and 1234567.5 or 0.00123 in between.
    """
    text = f"CAST(abs({bound}) AS STRING)"
    # Digits and the power of ten of the first one, from either way of writing.
    mantissa = "split(t, 'E')[0]"
    shown = f"replace({mantissa}, '.', '')"
    digits = f"regexp_replace(regexp_replace({shown}, '^0+', ''), '0+$', '')"
    leading = f"length({shown}) - length(regexp_replace({shown}, '^0+', ''))"
    power = (
        f"instr({mantissa}, '.') - 2 - ({leading}) + coalesce(CAST(get(split(t, 'E'), 1) AS INT), 0)"
    )
    exponent = (
        "concat(left(n.d, 1), CASE WHEN length(n.d) > 1 THEN concat('.', substring(n.d, 2)) ELSE '' END, "
        "CASE WHEN n.p < 0 THEN 'e-' ELSE 'e+' END, CASE WHEN abs(n.p) < 10 THEN '0' ELSE '' END, abs(n.p))"
    )
    plain = (
        "CASE WHEN n.p < 0 THEN concat('0.', repeat('0', -n.p - 1), n.d) "
        "WHEN length(n.d) <= n.p + 1 THEN rpad(n.d, n.p + 1, '0') "
        "ELSE concat(left(n.d, n.p + 1), '.', substring(n.d, n.p + 2)) END"
    )
    finite = (
        f"get(transform(array({text}), t -> get(transform(array(named_struct('d', {digits}, 'p', {power})), n -> "
        f"CASE WHEN n.d = '' THEN '0' WHEN n.p < -4 OR n.p >= 6 THEN {exponent} ELSE {plain} END), 0)), 0)"
    )
    return (
        f"CASE WHEN isnan({bound}) THEN 'NaN' WHEN {bound} = CAST('Infinity' AS DOUBLE) THEN '+Inf' "
        f"WHEN {bound} = CAST('-Infinity' AS DOUBLE) THEN '-Inf' "
        f"ELSE concat(CASE WHEN {bound} < 0 THEN '-' ELSE '' END, {finite}) END"
    )
