"""Helpers over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, path: str) -> Column:
    """The value at ``path`` as VARIANT; SQL NULL when the path is missing."""
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def members(value: Column) -> Column:
    """An object as MAP<STRING, VARIANT>; SQL NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_object(value: Column) -> Column:
    return members(value).isNotNull()


def present(value: Column) -> Column:
    """Neither missing nor JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def identity_key(request_id: Column) -> Column:
    """Pairing key of a request id: its JSON text, so 1 and "1" differ, 1 and 1.0 agree."""
    return F.when(present(request_id), F.to_json(request_id))


def kind_name(value: Column) -> Column:
    """Name of a JSON value's type as findings print it (int, float, str, ...)."""
    schema = F.schema_of_variant(value)
    wide_integer = schema.rlike(r"^DECIMAL\((19|[2-3][0-9]),0\)$")
    return (
        F.when(schema.isNull() | (schema == "VOID"), "NoneType")
        .when((schema == "BIGINT") | wide_integer, "int")
        .when((schema == "DOUBLE") | schema.startswith("DECIMAL"), "float")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "STRING", "str")
        .when(schema.startswith("OBJECT"), "dict")
        .when(schema.startswith("ARRAY"), "list")
        .otherwise("str")
    )


def accepts(type_name: Column, kind: Column) -> Column:
    """Does a schema type name accept a value of this kind?  Unknown names accept all."""
    return (
        F.when(type_name == "string", kind == "str")
        .when(type_name == "boolean", kind == "bool")
        .when(type_name == "integer", kind == "int")
        .when(type_name == "number", kind.isin("int", "float"))
        .when(type_name == "object", kind == "dict")
        .when(type_name == "array", kind == "list")
        .when(type_name == "null", kind == "NoneType")
        .otherwise(F.lit(True))
    )


def schema_parts(schema: Column) -> list[Column]:
    """What ``schema_problems`` reads of a tool's schema, one row per tool."""
    closed = F.schema_of_variant(field(schema, "$.additionalProperties")).eqNullSafe("BOOLEAN") & (
        ~F.coalesce(F.try_variant_get(schema, "$.additionalProperties", "boolean"), F.lit(True))
    )
    applies = is_object(schema) & (
        field(schema, "$.type").isNull() | text_at(schema, "$.type").eqNullSafe("object")
    )
    return [
        F.coalesce(applies, F.lit(False)).alias("applies"),
        F.coalesce(members(field(schema, "$.properties")), F.create_map().cast("map<string,variant>")).alias("properties"),
        F.coalesce(F.try_variant_get(schema, "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"),
        closed.alias("closed"),
    ]


def schema_problems(args: str) -> Column:
    """Problems of a call's arguments as an array of texts.

    Reads the columns of ``schema_parts`` and ``given``, the arguments' members.  Covers required members, additionalProperties=false and top-level member types.
    """
    given, properties = F.col("given"), F.col("properties")
    missing = F.transform(
        F.filter("required", lambda r: ~F.map_contains_key(given, r)),
        lambda r: F.concat(F.lit("missing required argument '"), r, F.lit("'")),
    )
    extra = F.transform(
        F.filter(F.map_keys(given), lambda k: F.col("closed") & ~F.map_contains_key(properties, k)),
        lambda k: F.concat(F.lit("unexpected argument '"), k, F.lit("' (additionalProperties: false)")),
    )

    def declared(entry: Column) -> Column:
        return field(F.try_element_at(properties, entry.key), "$.type")

    def wrong(entry: Column) -> Column:
        kind = F.schema_of_variant(declared(entry))
        one = accepts(text_at(declared(entry), "$"), kind_name(entry.value))
        several = F.exists(
            F.try_variant_get(declared(entry), "$", "array<string>"),
            lambda t: accepts(t, kind_name(entry.value)),
        )
        return (
            F.when(kind == "STRING", ~one)
            .when(kind.startswith("ARRAY") & (F.to_json(declared(entry)) != "[]"), ~several)
            .otherwise(F.lit(False))
        )

    def wrong_text(entry: Column) -> Column:
        listed = F.array_join(F.try_variant_get(declared(entry), "$", "array<string>"), "', '")
        shown = F.when(
            F.schema_of_variant(declared(entry)) == "STRING", text_at(declared(entry), "$")
        ).otherwise(F.concat(F.lit("['"), listed, F.lit("']")))
        return F.concat(
            F.lit("argument '"), entry.key, F.lit("' is "), kind_name(entry.value),
            F.lit(", schema expects "), shown,
        )

    mistyped = F.transform(F.filter(F.map_entries(given), wrong), wrong_text)
    not_object = F.array(
        F.concat(F.lit("arguments are "), kind_name(F.col(args)), F.lit(", schema expects object"))
    )
    return F.when(given.isNull(), not_object).otherwise(F.concat(missing, extra, mistyped))
