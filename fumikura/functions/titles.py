"""Title, identifier and search text of a record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import settings
from .variants import as_list, field, filled_text, is_kind


def first_filled(*parts: Column | str, default: str = "") -> Column:
    """First part that is neither NULL nor empty."""
    cols = [F.nullif(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.coalesce(*cols, F.lit(default))


def title(
    rec: Column | str,
    keys: tuple[str, ...] = (settings.LABEL_KEY, settings.NAME_KEY),
    default: str = "",
) -> Column:
    """First filled key as text; lists keep their JSON text."""
    return F.coalesce(*[filled_text(rec, k) for k in keys], F.lit(default))


def title_of_list(
    rec: Column | str, keys: tuple[str, ...] = (settings.LABEL_KEY, settings.NAME_KEY)
) -> Column:
    """Like :func:`title`, but a list gives its first element."""
    options = []
    for key in keys:
        text = filled_text(rec, key)
        head = F.try_variant_get(rec, f'$["{key}"][0]', "string")
        listed = is_kind(field(rec, key), "ARRAY")
        options.append(F.when(listed & text.isNotNull(), F.coalesce(head, F.lit(""))).otherwise(text))
    return F.coalesce(*options, F.lit(""))


def search_text(
    rec: Column | str,
    title_col: Column,
    key: str = settings.ABOUT_KEY,
    divider: str = settings.TEXT_DIVIDER,
) -> Column:
    """Title and the JSON text of another value, joined by a divider.

    A string value keeps its quotes, as in JSON text.  Spark writes no blank
    after ``,`` and ``:``.
    """
    value = F.when(filled_text(rec, key).isNotNull(), F.to_json(field(rec, key)))
    return F.concat(title_col, F.lit(divider), F.coalesce(value, F.lit("")))


def record_id(rec: Column | str, keys: tuple[str, ...] = settings.ID_KEYS) -> Column:
    """Text of the first identifier key that is present, empty or not."""
    found = F.lit(None).cast("string")
    for key in reversed(keys):
        # A key with a JSON null is present: its variant is not an SQL NULL.
        found = F.when(field(rec, key).isNotNull(), field(rec, key, "string")).otherwise(found)
    return found


def description(
    rec: Column | str, keys: tuple[str, ...] = settings.DESCRIPTION_KEYS
) -> Column:
    """First filled description key, else the empty text."""
    return F.coalesce(*[filled_text(rec, k) for k in keys], F.lit(""))


def in_class(
    rec: Column | str,
    uri: str = settings.CLASS_URI,
    marker: str = settings.CLASS_MARKER,
    about_key: str = settings.ABOUT_KEY,
    description_key: str = settings.DESCRIPTION_KEYS[0],
) -> Column:
    """Scalar subject equal to ``uri``, or a description string holding ``marker``."""
    about = field(rec, about_key)
    scalar_hit = is_kind(about, "STRING") & (field(rec, about_key, "string") == uri)
    texts = as_list(field(rec, description_key))
    text_hit = F.exists(
        texts,
        lambda v: is_kind(v, "STRING") & F.try_variant_get(v, "$", "string").contains(marker),
    )
    return F.coalesce(scalar_hit, F.lit(False)) | F.coalesce(text_hit, F.lit(False))
