"""A JSON schema compiled to predicates on a variant column: closed objects, types, forms.

Rows are judged where they lie, in one projection; nothing leaves the JVM. A
keyword speaks only of values of its type, as in the 2020-12 draft; ``format``
is an annotation, and a keyword that is not known here is an error, so that no
rule is passed over in silence.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.integrity import EngineError, failures

_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated"}
_KNOWN = {
    "type", "const", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minItems", "maxItems", "uniqueItems", "prefixItems", "items", "required", "properties", "additionalProperties", "unevaluatedProperties",
    "$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
Problem = tuple[str, str, Column]


def part(value: Column, name: str) -> Column:
    """A member of an object, null where it has none."""
    return F.try_variant_get(value, "$['" + name.replace("'", "\\'") + "']", "variant")


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def kind(value: Column) -> Column:
    """Type of a JSON value; a number without a fraction is an integer."""
    t = F.schema_of_variant(value)
    number = F.when(F.try_variant_get(value, "$", "double") % 1 == 0, "integer").otherwise("number")
    return (
        F.when(t == "VOID", "null")
        .when(F.startswith(t, F.lit("OBJECT")), "object")
        .when(F.startswith(t, F.lit("ARRAY")), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.isNotNull(), number)
    )


def _any(found: list[Problem]) -> Column:
    out = F.lit(False)
    for _, _, bad in found:
        out = out | bad
    return out


def _resolve(schema: dict, root: dict) -> dict:
    at = root
    for step in schema["$ref"].removeprefix("#/").split("/"):
        at = at.get(step) if isinstance(at, dict) else None
    if at is None:
        raise EngineError("schema", f"no such reference: {schema['$ref']}")
    return at


def _names(schema: dict, root: dict) -> set[str]:
    """Members that a schema and what it always includes speak of."""
    if schema.keys() & {"anyOf", "oneOf", "if"}:
        raise EngineError("schema", "unevaluatedProperties beside a choice is not supported")
    inner = [*schema.get("allOf", []), *([_resolve(schema, root)] if "$ref" in schema else [])]
    return set(schema.get("properties", {})).union(*(_names(s, root) for s in inner))


def problems(value: Column, schema: dict | bool, root: dict, path: str = "", depth: int = 0) -> list[Problem]:
    """What can be wrong with a value that is there: (path, message, predicate), none of them null."""
    if isinstance(schema, bool):
        return [] if schema else [(path, "is not allowed", value.isNotNull())]
    if depth > 40:
        raise EngineError("schema", f"{path}: the schema refers to itself")
    strange = {k for k in schema if k not in _KNOWN and k not in _NOTES and not k.startswith("x-")}
    if strange:
        raise EngineError("schema", f"unknown keyword {', '.join(sorted(strange))} at {path or 'the root'}")
    found: list[Problem] = []
    is_a = kind(value) if schema.keys() - {"const", "enum", "$ref", "properties"} else None

    def add(message: str, bad: Column, at: str = path) -> None:
        found.append((at, message, F.coalesce(value.isNotNull() & bad, F.lit(False))))

    def inner(s: dict | bool, v: Column = value, at: str = path) -> list[Problem]:
        return problems(v, s, root, at, depth + 1)

    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        add(f"is not of type {' or '.join(wanted)}", ~is_a.isin(*wanted, *(["integer"] if "number" in wanted else [])))
    literal = [schema["const"]] if "const" in schema else schema.get("enum")
    if literal is not None:
        shown = [json.dumps(c, ensure_ascii=False, separators=(",", ":")) for c in literal]
        add(f"is not {' or '.join(shown)}", ~F.to_json(value).isin(*shown))
    string = lambda: is_a == "string"
    number = lambda: is_a.isin("integer", "number")
    array = lambda: is_a == "array"
    sized = lambda: F.char_length(text(value))
    double = lambda: F.try_variant_get(value, "$", "double")
    for word, message, applies, bad in (
        ("pattern", "does not match", string, lambda a: ~text(value).rlike(a)),
        ("minLength", "is shorter than", string, lambda a: sized() < a),
        ("maxLength", "is longer than", string, lambda a: sized() > a),
        ("minimum", "is less than", number, lambda a: double() < a),
        ("maximum", "is greater than", number, lambda a: double() > a),
        ("exclusiveMinimum", "is not above", number, lambda a: double() <= a),
        ("exclusiveMaximum", "is not below", number, lambda a: double() >= a),
        ("multipleOf", "is not a multiple of", number, lambda a: F.try_variant_get(value, "$", "decimal(38,12)") % F.lit(str(a)).cast("decimal(38,12)") != 0),
        ("minItems", "has fewer items than", array, lambda a: F.size(items(value)) < a),
        ("maxItems", "has more items than", array, lambda a: F.size(items(value)) > a),
    ):
        if word in schema:
            add(f"{message} {schema[word]}", applies() & bad(schema[word]))
    if schema.get("uniqueItems"):
        shown_items = F.transform(items(value), lambda e: F.to_json(e))
        add("has equal items", F.size(shown_items) != F.size(F.array_distinct(shown_items)))
    first = schema.get("prefixItems", [])
    for i, s in enumerate(first):
        found += inner(s, F.get(items(value), F.lit(i)), f"{path}[{i}]")
    if "items" in schema:
        rest = F.slice(items(value), len(first) + 1, F.greatest(F.size(items(value)), F.lit(1))) if first else items(value)
        add("has an item that does not fit", F.exists(rest, lambda e: _any(inner(schema["items"], e))))
    for name in schema.get("required", []):
        add("is missing", (is_a == "object") & part(value, name).isNull(), f"{path}.{name}".lstrip("."))
    for name, s in schema.get("properties", {}).items():
        found += inner(s, part(value, name), f"{path}.{name}".lstrip("."))
    closed = schema.get("additionalProperties") is False or schema.get("unevaluatedProperties") is False
    others = schema.get("additionalProperties", schema.get("unevaluatedProperties", True))
    if not isinstance(others, bool):
        raise EngineError("schema", f"{path or 'the root'}: only a closed or an open object is supported")
    if closed:
        names = set(schema.get("properties", {})) if schema.get("additionalProperties") is False else _names(schema, root)
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        add("has a member that is not known", F.size(F.array_except(keys, F.array(*map(F.lit, sorted(names))).cast("array<string>"))) > 0)
    if "$ref" in schema:
        found += inner(_resolve(schema, root))
    for s in schema.get("allOf", []):
        found += inner(s)
    for word, good in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema:
            fits = sum(((~_any(inner(s))).cast("int") for s in schema[word]), F.lit(0))
            add(f"does not fit {'one' if word == 'oneOf' else 'any'} of its {len(schema[word])} forms", ~good(fits))
    if "not" in schema:
        add("has a form that it must not have", ~_any(inner(schema["not"])))
    if "if" in schema:
        holds = ~_any(inner(schema["if"]))
        for branch, applies in (("then", holds), ("else", ~holds)):
            found += [(at, message, applies & bad) for at, message, bad in inner(schema.get(branch, True))]
    return found


def check_json(rows: DataFrame, raw: str, schema: dict, record: Column, check: str = "schema") -> DataFrame:
    """A failure per row and broken rule; ``raw`` is JSON text, and text that is none is one failure."""
    value = F.col("_v")
    said = [F.when(bad, F.lit(f"{path or '<record root>'}: {message}")) for path, message, bad in problems(value, schema, schema)]
    said.append(F.when(value.isNull(), F.lit("<record root>: is not JSON")))
    each = rows.select(record.alias("_r"), F.try_parse_json(raw).alias("_v")).select("_r", F.explode(F.filter(F.array(*said), lambda m: m.isNotNull())).alias("_m"))
    return failures(each, check, F.col("_r"), F.col("_m"))


def marks(schema: dict, at: tuple[str, ...] = ()) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """Paths marked restricted, and paths without a mark; a mark covers all that lies under it."""
    marked, bare = [], []
    for name, s in schema.get("properties", {}).items():
        path, mark = (*at, name), s.get("x-sensitivity")
        if mark == "restricted":
            marked.append(path)
        elif mark is None and isinstance(s.get("properties"), dict):
            under = marks(s, path)
            marked, bare = marked + under[0], bare + under[1]
        elif mark is None:
            bare.append(path)
    return marked, bare


def strings_at(rows: DataFrame, raw: str, paths: list[tuple[str, ...]], record: Column) -> DataFrame:
    """Rows (record, value) of the strings at the paths, and in the arrays there, that are not blank."""

    def values(path: tuple[str, ...]) -> Column:
        v = F.try_parse_json(raw)
        for name in path:
            v = part(v, name)
        return F.transform(F.filter(F.coalesce(items(v), F.array(v)), lambda e: F.schema_of_variant(e) == "STRING"), text)

    every = F.flatten(F.array(*(values(p) for p in paths))) if paths else F.array().cast("array<string>")
    return rows.select(record.alias("record"), F.explode(every).alias("value")).where("trim(value) <> ''")
