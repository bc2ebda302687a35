"""Validation of JSON payloads against a declared schema.

The schema (a dict with type, required, properties, items, format) is turned into one
Column over the parsed payload, evaluated inside the scan's own stage: no shuffle, no
Python. Checks run in a fixed order and the first failure is reported: an object's
required fields as listed, its properties by name (type, format, then what is inside),
then its personal fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.values import (
    DATE_TIME,
    EMAIL,
    URI,
    full_match,
    is_hashed_or_encoded,
)
from gaugeworks.model import ERR_INVALID_INPUT

VIOLATION = "struct<error:string,path:string>"

# Messages.
MISSING = "missing required field"
BAD_TYPE = "invalid field type"
BAD_VALUE = "invalid field value"
PII = "PII field detected without hashing"
UNPARSABLE = "failed to parse batch data"

# Format name, pattern, name in the message.
FORMATS = {
    "date-time": (DATE_TIME, "date-time"),
    "email": (EMAIL, "email"),
    "uri": (URI, "URI"),
}


class _Scope:
    """Where the values of one payload, or of one array item, are held.

    Every member a check looks at gets a slot `v<n>`, and `k<n>` where its kind matters,
    so it is taken out of the payload once however many checks use it.
    """

    def __init__(self, column: Callable[[str], Column]) -> None:
        self.column = column
        self.slots: dict[tuple[str, ...], int] = {(): 0}
        self.kinds: set[int] = set()

    def stages(self) -> Iterator[tuple[dict[str, tuple[str, str]], dict[str, str]]]:
        """By depth: new value slots as (parent slot, member name), and kind slots."""
        for depth in sorted({len(path) for path in self.slots}):
            level = {p: n for p, n in self.slots.items() if len(p) == depth}
            values = {
                f"v{n}": (f"v{self.slots[p[:-1]]}", p[-1]) for p, n in level.items() if p
            }
            yield values, {f"k{n}": f"v{n}" for n in level.values() if n in self.kinds}


class _Node:
    """A value of the payload, with its members."""

    def __init__(self, scope: _Scope, path: tuple[str, ...] = ()) -> None:
        self.scope, self.path = scope, path
        self.slot = scope.slots.setdefault(path, len(scope.slots))

    def member(self, name: str) -> _Node:
        return _Node(self.scope, (*self.path, name))

    @property
    def value(self) -> Column:
        """Null when absent, a variant null when null."""
        return self.scope.column(f"v{self.slot}")

    @property
    def kind(self) -> Column:
        self.scope.kinds.add(self.slot)
        return self.scope.column(f"k{self.slot}")

    @property
    def absent(self) -> Column:
        return self.value.isNull()

    @property
    def is_object(self) -> Column:
        return F.startswith(self.kind, F.lit("OBJECT"))

    @property
    def text(self) -> Column:
        """The text of a string value; null for every other kind."""
        return F.when(self.kind == "STRING", F.try_variant_get(self.value, "$", "string"))


def _take(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{quoted}"]', "variant")


def _violation(error: str, path: Column | str) -> Column:
    where = F.lit(path) if isinstance(path, str) else path
    return F.struct(F.lit(error).alias("error"), where.alias("path"))


def _none() -> Column:
    return F.lit(None).cast(VIOLATION)


def _join(path: Column | str, name: str) -> Column | str:
    if isinstance(path, str):
        return f"{path}.{name}" if path else name
    return F.concat(path, F.lit(f".{name}"))


def _type_ok(node: _Node, expected: str) -> Column:
    kind = node.kind
    double = F.try_variant_get(node.value, "$", "double")
    checks = {
        "string": lambda: kind == "STRING",
        "number": lambda: kind.isin("BIGINT", "DOUBLE", "FLOAT")
        | F.startswith(kind, F.lit("DECIMAL")),
        # Trailing zeros are not kept, so an integral decimal has scale 0.
        "integer": lambda: (kind == "BIGINT")
        | (F.startswith(kind, F.lit("DECIMAL")) & F.endswith(kind, F.lit(",0)")))
        | (kind.isin("DOUBLE", "FLOAT") & (F.floor(double) == double)),
        "boolean": lambda: kind == "BOOLEAN",
        "object": lambda: node.is_object,
        "array": lambda: F.startswith(kind, F.lit("ARRAY")),
    }
    return checks[expected]() if expected in checks else F.lit(True)


def _value_checks(node: _Node, schema: Mapping[str, Any], path) -> list[Column]:
    """Type, then format, of one present value."""
    checks = []
    expected = schema.get("type")
    if isinstance(expected, str):
        checks.append(
            F.when(
                ~_type_ok(node, expected),
                _violation(f"{BAD_TYPE}: expected {expected}", path),
            )
        )
    form = schema.get("format")
    if isinstance(form, str):
        checks.append(
            F.when(
                node.kind != "STRING",
                _violation(f"{BAD_TYPE}: format validation requires string", path),
            )
        )
        if form in FORMATS:
            pattern, title = FORMATS[form]
            checks.append(
                F.when(
                    ~full_match(node.text, pattern),
                    _violation(f"{BAD_VALUE}: invalid {title} format", path),
                )
            )
    return checks


def _inside(node: _Node, schema: Mapping[str, Any], path, pii) -> list[Column]:
    if schema.get("type") == "object" and isinstance(schema.get("properties"), Mapping):
        return _object_checks(node, schema, path, pii)
    return []


def _items(node: _Node, items: Mapping[str, Any], path, pii) -> Column:
    """The first failing item's violation."""

    def checks(scope: _Scope, at) -> list[Column]:
        item = _Node(scope)
        return _value_checks(item, items, at) + _inside(item, items, at, pii)

    # Building the checks once shows which slots an item needs.
    needed = _Scope(lambda slot: F.col(slot))
    if not checks(needed, ""):
        return _none()
    fields = ["v0"]
    held = F.transform(
        F.try_variant_get(node.value, "$", "array<variant>"),
        lambda item: F.struct(item.alias("v0")),
    )

    def grown(items: Column, added: dict[str, Callable[[Column], Column]]) -> Column:
        old = list(fields)
        fields.extend(added)
        return F.transform(
            items,
            lambda s: F.struct(
                *[s[f].alias(f) for f in old], *[make(s).alias(n) for n, make in added.items()]
            ),
        )

    for values, kinds in needed.stages():
        if values:
            held = grown(
                held,
                {
                    v: lambda s, of=of, name=name: _take(s[of], name)
                    for v, (of, name) in values.items()
                },
            )
        if kinds:
            held = grown(
                held, {k: lambda s, v=v: F.schema_of_variant(s[v]) for k, v in kinds.items()}
            )

    def one(item: Column, i: Column) -> Column:
        at = F.concat(
            F.lit(path) if isinstance(path, str) else path,
            F.lit("["),
            i.cast("string"),
            F.lit("]"),
        )
        return F.coalesce(*checks(_Scope(lambda slot: item[slot]), at), _none())

    return F.get(F.filter(F.transform(held, one), lambda r: r.isNotNull()), 0)


def _object_checks(
    node: _Node, schema: Mapping[str, Any], path, pii: Sequence[str]
) -> list[Column]:
    checks = []
    for name in schema.get("required") or ():
        if isinstance(name, str):
            checks.append(
                F.when(
                    node.member(name).absent,
                    _violation(f"{MISSING}: {name}", _join(path, name)),
                )
            )
    for name, sub in sorted((schema.get("properties") or {}).items()):
        if not isinstance(sub, Mapping):
            continue
        member, at = node.member(name), _join(path, name)
        inner = _value_checks(member, sub, at) + _inside(member, sub, at, pii)
        if sub.get("type") == "array" and isinstance(sub.get("items"), Mapping):
            inner.append(_items(member, sub["items"], at, pii))
        if inner:
            checks.append(F.when(~member.absent, F.coalesce(*inner)))
    return checks + _pii_checks(node, path, pii)


def _pii_checks(node: _Node, path, pii: Sequence[str]) -> list[Column]:
    """A listed field under its own (dotted) key, its path, or its last part."""
    checks = []
    for listed in pii:
        parts = listed.split(".")
        found = [(node.member(listed), listed)]
        if len(parts) > 1:
            nested = node
            for part in parts:
                nested = nested.member(part)
            found += [(nested, listed), (node.member(parts[-1]), parts[-1])]
        for member, name in found:
            checks.append(
                F.when(
                    ~member.absent & ~is_hashed_or_encoded(member.text),
                    _violation(f"{PII}: {name}", _join(path, name)),
                )
            )
    return checks


def _root_check(root: _Node) -> Column:
    return F.when(
        ~root.is_object & (root.kind != "VOID"), _violation(BAD_TYPE, "")
    )


def _simple_checks(
    root: _Node, required: Sequence[str], pii_fields: Sequence[str]
) -> list[Column]:
    """Dotted required paths, then dotted personal paths."""
    checks = []
    for dotted in required:
        parts = dotted.split(".")
        current = root
        for part in parts[:-1]:
            current = current.member(part)
            checks += [
                F.when(current.absent, _violation(f"{MISSING}: {dotted}", dotted)),
                F.when(
                    ~current.is_object,
                    _violation(f"{BAD_TYPE}: {part} is not an object", dotted),
                ),
            ]
        last = current.member(parts[-1])
        checks.append(F.when(last.absent, _violation(f"{MISSING}: {dotted}", dotted)))
    for dotted in pii_fields:
        current = root
        for part in dotted.split("."):
            current = current.member(part)
        checks.append(
            F.when(
                ~current.absent & ~is_hashed_or_encoded(current.text),
                _violation(f"{PII}: {dotted}", dotted),
            )
        )
    return checks


def parse_payload(text: Column) -> Column:
    """The payload as a variant; null when it is not exactly one JSON value."""
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(one, F.try_parse_json(text))


def with_violation(
    df: DataFrame,
    schema: Mapping[str, Any] | None = None,
    payload: str = "data",
    pii_fields: Sequence[str] = (),
    required: Sequence[str] | None = None,
    custom: Sequence[Callable[[Column], Column]] = (),
) -> DataFrame:
    """Adds `violation`: by schema, or by `required` paths where no schema is given.

    A custom check gets the payload (a variant) and returns a struct of error and path,
    or null; custom checks come last, in their order.
    """
    scope = _Scope(lambda slot: F.col(f"_{slot}"))
    root = _Node(scope)
    if schema is not None:
        checks = _object_checks(root, schema, "", pii_fields)
    else:
        checks = _simple_checks(root, required or (), pii_fields)
    checks = [_root_check(root), *checks, *[check(root.value) for check in custom]]
    text = F.col(payload).cast("string")
    start = F.ltrim(text, F.lit(" \t\r\n"))
    out = df.withColumns(
        {
            "_v0": parse_payload(text),
            # The root's kind shows in its first character; no need to walk it.
            "_k0": F.when(F.startswith(start, F.lit("{")), F.lit("OBJECT"))
            .when(F.startswith(start, F.lit("null")), F.lit("VOID"))
            .otherwise(F.lit("OTHER")),
        }
    )
    for values, kinds in scope.stages():
        if values:
            out = out.withColumns(
                {
                    f"_{v}": _take(F.col(f"_{of}"), name)
                    for v, (of, name) in values.items()
                }
            )
        kinds.pop("k0", None)
        if kinds:
            out = out.withColumns(
                {f"_{k}": F.schema_of_variant(F.col(f"_{v}")) for k, v in kinds.items()}
            )
    verdict = F.when(
        root.absent, _violation(UNPARSABLE, F.lit(None).cast("string"))
    ).otherwise(F.coalesce(*checks, _none()))
    # A one-row generator: filters on the verdict stay above it, so nothing is parsed
    # or checked a second time for a filter. The verdict itself is a projection, which
    # Spark compiles.
    return out.withColumn("_verdict", verdict).select(
        *df.columns, F.explode(F.array("_verdict")).alias("violation")
    )


def error_message(v: Column) -> Column:
    """The rejection text of a violation."""
    return F.when(v["path"].isNull(), v["error"]).otherwise(
        F.concat(
            F.lit("schema validation failed at path '"),
            v["path"],
            F.lit("': "),
            v["error"],
        )
    )


def validate(
    df: DataFrame,
    schema: Mapping[str, Any] | None = None,
    payload: str = "data",
    pii_fields: Sequence[str] = (),
    required: Sequence[str] | None = None,
    enforce: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with `error_code` and `error_message`."""
    if not enforce:
        nothing = df.limit(0).withColumns(
            {
                "error_code": F.lit(None).cast("string"),
                "error_message": F.lit(None).cast("string"),
            }
        )
        return df, nothing
    checked = with_violation(df, schema, payload, pii_fields, required)
    valid = checked.filter("violation is null").drop("violation")
    rejected = checked.filter("violation is not null").withColumns(
        {
            "error_code": F.lit(ERR_INVALID_INPUT),
            "error_message": error_message(F.col("violation")),
        }
    )
    return valid, rejected.drop("violation")


def validation_counts(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per reason; valid rows count under an empty reason."""
    return checked.groupBy(
        *by, F.coalesce("violation.error", F.lit("")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("rows"))
