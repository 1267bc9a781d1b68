"""JSON texts checked against a schema: the first fault of each row, as one expression.

A schema is a dictionary in the manner of JSON Schema: `type` (object, array, string,
integer, number, boolean, null, or a list of them), `enum`, `minimum`, `maximum`,
`max_words`, `properties`, `required` (all properties if absent), `extra` (whether other
keys are allowed; not if absent) and `items`. It is compiled into expressions over the
parsed variant. Faults are told in a fixed order: type, missing keys in the schema's
order, unknown keys by name, then values in the schema's order and items in theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import word_count

_TYPES: dict[str, Callable[[Column], Column]] = {
    "object": lambda t: t.startswith("OBJECT"),
    "array": lambda t: t.startswith("ARRAY"),
    "string": lambda t: t == "STRING",
    "integer": lambda t: (t == "BIGINT") | F.regexp_like(t, F.lit(r"^DECIMAL\(\d+,0\)$")),
    "number": lambda t: (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL"),
    "boolean": lambda t: t == "BOOLEAN",
    "null": lambda t: t == "VOID",
}


def _fault(value: Column, schema: dict, at: Column) -> Column:
    """What is wrong with a variant that is there, or null; `at` is its path."""
    said = lambda what: F.concat(at, F.lit(f": {what}"))
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    kind = F.schema_of_variant(value)
    nothing = F.lit(None).cast("string")
    checks = []
    if kinds:
        fits = F.lit(False)
        for k in kinds:
            fits = fits | _TYPES[k](kind)
        checks.append(F.when(~fits, said(f"no {' or '.join(kinds)}")))
    is_ = lambda k: _TYPES[k](kind)
    if "enum" in schema:
        options = F.array(*[F.lit(str(v)) for v in schema["enum"]])
        checks.append(F.when(~F.coalesce(F.array_contains(options, F.try_variant_get(value, "$", "string")), F.lit(False)), said("no allowed value")))
    for name, over in (("minimum", lambda v, m: v < m), ("maximum", lambda v, m: v > m)):
        if name in schema:
            checks.append(F.when(is_("number") & over(F.try_variant_get(value, "$", "double"), schema[name]), said(f"{'under' if name == 'minimum' else 'over'} {schema[name]}")))
    if "max_words" in schema:
        checks.append(F.when(is_("string") & (word_count(F.try_variant_get(value, "$", "string")) > schema["max_words"]), said(f"over {schema['max_words']} words")))
    if "properties" in schema:
        # keys hold variants; a null in JSON is a variant too, and only a missing key is null
        held = F.try_variant_get(value, "$", "map<string,variant>")
        known = list(schema["properties"])
        required = schema.get("required", known)
        gone = F.filter(F.array(*[F.lit(k) for k in known if k in required]).cast("array<string>"), lambda k: ~F.map_contains_key(held, k))
        checks.append(F.when(is_("object") & (F.size(gone) > 0), F.concat(at, F.lit("."), F.try_element_at(gone, F.lit(1)), F.lit(": missing"))))
        if not schema.get("extra", False):
            extra = F.array_sort(F.array_except(F.map_keys(held), F.array(*[F.lit(k) for k in known]).cast("array<string>")))
            checks.append(F.when(is_("object") & (F.size(extra) > 0), F.concat(at, F.lit("."), F.try_element_at(extra, F.lit(1)), F.lit(": unknown"))))
        for key, inner in schema["properties"].items():
            part = F.try_element_at(held, F.lit(key))
            checks.append(F.when(is_("object") & F.map_contains_key(held, F.lit(key)), _fault(part, inner, F.concat(at, F.lit(f".{key}")))))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        faults = F.transform(items, lambda x, i: _fault(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        checks.append(F.when(is_("array"), F.try_element_at(F.filter(faults, lambda f: f.isNotNull()), F.lit(1))))
    return F.coalesce(*checks, nothing)


def first_fault(text: Column, schema: dict) -> Column:
    """What is wrong with a JSON text, or null: `$.key: missing` and the like; null and broken texts are no JSON."""
    parsed = F.try_parse_json(text)
    # the parser stops at a value's end; as the item of an array, the text has to be one value and nothing more
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    return F.when(parsed.isNull() | ~one, F.lit("$: no JSON")).otherwise(_fault(parsed, schema, F.lit("$")))


def checked(df: DataFrame, text: str, schema: dict, columns: str, strict: bool = False) -> DataFrame:
    """`df` with `fault` and the parsed `value` of the type `columns`, null where there is a fault, or failing on one if `strict`."""
    marked = df.withColumn("fault", first_fault(F.col(text), schema))
    value = F.from_json(text, columns)
    bad = F.raise_error(F.concat(F.lit("invalid: "), F.col("fault"))) if strict else F.lit(None)
    return marked.withColumn("value", F.when(F.col("fault").isNull(), value).otherwise(bad))
