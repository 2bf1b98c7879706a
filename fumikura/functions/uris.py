"""URI shortening and the sub-node test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import settings
from .words import _col


def shorten(uri: Column | str, prefixes=settings.URI_PREFIXES) -> Column:
    """Replace the first listed prefix the URI starts with, wherever it occurs."""
    uri = _col(uri)
    if not prefixes:
        return uri
    cases = F
    for long, short in prefixes:
        cases = cases.when(F.startswith(uri, F.lit(long)), F.replace(uri, F.lit(long), F.lit(short)))
    return cases.otherwise(uri)


def is_subnode(node: Column | str, root: Column | str, boundary: str | None = None) -> Column:
    """Blank node, or a URI that begins with the root's URI.

    Without ``boundary`` the prefix test is plain: ``…/x1`` owns ``…/x10``.
    With it (say ``"[#/]"``) the character after the root must match.
    """
    node, root = _col(node), _col(root)
    owned = F.startswith(node, root)
    if boundary is not None:
        after = F.substring(node, F.length(root) + 1, F.lit(1))
        owned = owned & ((after == "") | after.rlike(f"^(?:{boundary})$"))
    return F.startswith(node, F.lit("_:")) | owned
