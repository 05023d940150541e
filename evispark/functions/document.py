"""JSON documents: a value set at a path, and violations of a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def set_path(document: Column, path: str, value: Column) -> Column:
    """The JSON text with ``value`` (a scalar column) at a dotted path.

    Objects on the way that are missing, or are no objects, are made; everything else is unchanged, and keys come in
    alphabetical order. Null and malformed documents count as empty."""
    return F.to_json(_with(F.try_parse_json(document), path.split("."), value))


def _with(document: Column, names: list[str], value: Column) -> Column:
    """The variant ``document`` with ``value`` at ``names``."""
    fields = F.coalesce(document.try_cast(OBJECT), F.from_json(F.lit("{}"), OBJECT))
    name, rest = names[0], names[1:]
    new = _with(F.element_at(F.map_filter(fields, lambda k, v: k == name), name), rest, value) if rest else value.cast("variant")
    others = F.map_filter(fields, lambda k, v: k != name)
    return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(name), new)))


def _kind(value: Column) -> Column:
    """JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name == "BIGINT", "integer")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def violations(document: Column, schema: dict, path: str = "$") -> list[Column]:
    """A column for each rule of a JSON schema: what is wrong ('path: rule'), or null.

    ``document`` is a variant; type, required, properties, additionalProperties, enum, minimum, maximum and
    minLength are read. What is below a value of the wrong type isn't looked at; a missing value breaks 'required' alone."""
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    here = F.try_variant_get(document, path, "variant")
    kind, told = _kind(here), lambda wrong, rule: F.when(here.isNotNull() & wrong, f"{path}: {rule}")
    out = []
    if types:
        fits = kind.isin(types) | (F.lit("number" in types) & (kind == "integer"))
        out.append(told(~fits, "type"))
    if "enum" in schema:
        out.append(told((kind == "string") & ~F.coalesce(F.try_variant_get(document, path, "string").isin(schema["enum"]), F.lit(False)), "enum"))
    numeric = kind.isin("integer", "number")
    for rule, wrong in (("minimum", lambda v, x: v < x), ("maximum", lambda v, x: v > x)):
        if rule in schema:
            out.append(told(numeric & wrong(F.try_variant_get(document, path, "double"), F.lit(float(schema[rule]))), rule))
    if "minLength" in schema:
        out.append(told((kind == "string") & (F.length(F.try_variant_get(document, path, "string")) < schema["minLength"]), "minLength"))
    names = F.coalesce(F.json_object_keys(F.to_json(here)), F.array().cast("array<string>"))
    for name in schema.get("required", []):
        out.append(told((kind == "object") & ~F.array_contains(names, name), f"required {name}"))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(names, F.array(*map(F.lit, schema.get("properties", {}))))
        out.append(told((kind == "object") & (F.size(extra) > 0), "additionalProperties"))
    for name, inner in schema.get("properties", {}).items():
        out += violations(document, inner, f"{path}.{name}")
    return out


def checked(reports, key: str, text: str, schema: dict):
    """key, violation: a row for each rule that a report (JSON text) breaks; 'not JSON' for what isn't."""
    parsed = F.try_parse_json(F.col(text))
    found = F.filter(F.array(*violations(F.col("_v"), schema)), lambda x: x.isNotNull())
    rows = reports.select(key, parsed.alias("_v"))
    return rows.select(key, F.explode(F.when(F.col("_v").isNull(), F.array(F.lit("not JSON"))).otherwise(found)).alias("violation"))
