"""Reading dynamic JSON values held in a VARIANT column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# JSON texts of the values Python calls false, strings aside.
_EMPTY_TEXTS = ("0", "0.0", "-0.0", "-0", "false", "[]", "{}")


def is_json(raw: Column | str) -> Column:
    """Whether the whole text is one JSON value.

    Spark's parsers stop after the first value, so the text is put between two
    keys: anything left over breaks the object or adds a key.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    framed = F.concat(F.lit('{"r":'), raw, F.lit(',"e":0}'))
    return F.coalesce(F.json_object_keys(framed) == F.array(F.lit("r"), F.lit("e")), F.lit(False))


def is_json_object(raw: Column | str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    return raw.rlike(r"^\s*\{") & is_json(raw)


def field(rec: Column | str, key: str, kind: str = "variant") -> Column:
    """Value of a top-level key, any characters allowed in the key."""
    return F.try_variant_get(rec, f'$["{key}"]', kind)


def is_kind(value: Column, kind: str) -> Column:
    """True when a variant holds the given kind: STRING, ARRAY, OBJECT, ..."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def filled_text(rec: Column | str, key: str) -> Column:
    """Text of a top-level value, NULL when the value counts as empty.

    Lists and objects give their JSON text; ``true`` gives ``True``.
    """
    text = field(rec, key, "string")
    kind = F.schema_of_variant(field(rec, key))
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")))
        .when(~text.isin(*_EMPTY_TEXTS), text)
    )


def as_list(value: Column) -> Column:
    """A list stays a list, any other value becomes a list of one."""
    return F.when(
        is_kind(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    ).when(value.isNotNull(), F.array(value))


def json_string(text: Column | str) -> Column:
    """JSON string literal, quotes included, of a text."""
    # The array text is ["..."]: only its brackets can be trimmed, the quotes stop it.
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))
