"""Rows carried through Python tasks whatever their other columns are called."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from ..operators.scale import BATCH_BYTES, bound_batches  # noqa: F401  used by all operators here

#: Bytes of one Arrow batch of texts that a task takes 1,024 rows at a time; an executor holds several of each task's.
TEXT_BATCH = 2 << 20

_STORES: list[dict] = []
_asked: set[int] = set()


def store() -> dict:
    """A place for what a worker makes once for many tasks; see :func:`asked`."""
    _STORES.append({})
    return _STORES[-1]


def asked(kept: dict) -> dict:
    """The store, marked as used by this task; others that the task has not asked for are emptied, so that they do not pile up."""
    if id(kept) not in _asked:
        _asked.add(id(kept))
        _empty_others()
    return kept


def _empty_others() -> None:
    for kept in _STORES:
        if id(kept) not in _asked:
            kept.clear()


def _task_begins() -> None:
    _asked.clear()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system when its task ends.

    Spark keeps Python workers for later tasks, which need other things; so stores go that the task did not ask for.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _task_begins()
        try:
            yield from run(batches)
        finally:
            _empty_others()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others do without
            if trim is not None:
                trim(0)

    return wrapped


def schema(df: DataFrame, keep: Sequence[str], more: str) -> StructType:
    """Fields of the kept columns, then those written out in ``more``."""
    return StructType([*[df.schema[c] for c in keep], *DataType.fromDDL(more).fields])


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """<_row, text> and what else is asked for; ``_row`` holds all other columns, so no name clashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row"), "text", *more)


def unpacked(df: DataFrame, columns: Sequence[str], *more: str, **new: Column) -> DataFrame:
    """Columns of the packed documents in their order, some with a new value, then ``more``."""
    own = [new.get(c, F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in columns]
    return df.select(*own, *more)


def row_key() -> Column:
    """Hash of doc_id and text hash ``_text``; a null id differs from every text an id can have."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("")), F.col("_text"))


def counted_chars(docs: DataFrame, changed: Column) -> dict[str, Column]:
    """New value of ``n_chars``, if the documents have it: that of the text where it was changed."""
    if "n_chars" not in docs.columns:
        return {}
    old = F.col("_row").getField("n_chars")
    return {"n_chars": F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)}
