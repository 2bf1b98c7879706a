"""Text helpers for words, compounds, packed cells and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .. import settings


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim every Unicode blank at both ends, the ideographic space included."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def drop_symbols(text: Column | str, symbols: str = settings.GRAM_SYMBOLS) -> Column:
    return F.regexp_replace(text, symbols, "")


#: Characters per chunk of a long text, if nothing longer is looked for.
CHUNK = 64


def ngrams(text: Column | str, n: int) -> Column:
    """Overlapping character n-grams in text order; none if the text is short.

    One pass of a pattern that looks ahead to ``n`` characters and moves on by
    one, so the cost is linear in the length of the text.  Counting goes
    through ``operators.mine.gram_counts`` instead.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


#: Bytes of texts that are looked at together: their arrays stay in the processor's cache.
SLICE = 1 << 18


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where slices of about SLICE bytes begin, and their number of texts; a longer text is one of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + SLICE, "right")))
        yield at, end - at
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of an array of texts, where each text begins and the last ends, and where characters begin."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0], np.flatnonzero((raw & 0xC0) != 0x80)


def compounds(
    text: Column | str, run: str = settings.COMPOUND_RUN, end: str = settings.COMPOUND_END
) -> Column:
    """Longest runs of ``run`` letters that close with ``end``."""
    return F.regexp_extract_all(text, F.lit(f"({run}{end})"), F.lit(1))


def pack(word: Column | str, count: Column | str) -> Column:
    """``word (count)``."""
    return F.concat(_col(word), F.lit(" ("), _col(count).cast("string"), F.lit(")"))


def packed_word(cell: Column | str) -> Column:
    """Word of a packed cell, the last bracketed number cut off; NULL if none."""
    return F.nullif(F.regexp_extract(cell, settings.PACKED_CELL, 1), F.lit(""))


def packed_count(cell: Column | str) -> Column:
    return F.try_to_number(
        F.nullif(F.regexp_extract(cell, settings.PACKED_CELL, 2), F.lit("")), F.lit("9" * 18)
    ).cast("bigint")


def candidate_word(cell: Column | str) -> Column:
    """Text before the first `` (`` of a cell that holds a bracket, else NULL."""
    return F.when(_col(cell).contains("("), F.substring_index(cell, " (", 1))


def short_label(word: Column | str, size: int = 15) -> Column:
    word = _col(word)
    return F.when(F.length(word) > size, F.concat(F.left(word, F.lit(size)), F.lit(".."))).otherwise(word)


def short_uri_label(word: Column | str, longest: int = 30, kept: int = 25) -> Column:
    word = _col(word)
    cut = (F.length(word) > longest) & is_uri(word)
    return F.when(cut, F.concat(F.lit("..."), F.right(word, F.lit(kept)))).otherwise(word)


def is_uri(word: Column | str) -> Column:
    return F.startswith(_col(word), F.lit("http"))


def lookup_link(word: Column | str) -> Column:
    """The URI itself, or a web search for the word."""
    word = _col(word)
    query = F.url_encode(F.concat(word, F.lit(settings.SEARCH_SUFFIX)))
    query = F.replace(F.replace(query, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    query = F.replace(F.replace(query, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(is_uri(word), word).otherwise(F.concat(F.lit(settings.SEARCH_URL), query))


def comma_words(text: Column | str) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda w: w != "")


def percent(part: Column | str, whole: Column | str) -> Column:
    """Share of a total as ``12.3%``.

    Integer arithmetic, halves rounded up: tenths of a percent are counted in
    whole numbers so that no binary fraction can tip the last digit.
    """
    part, whole = _col(part), _col(whole)
    tenths = F.call_function("div", part * 2000 + whole, whole * 2)
    return F.concat(
        F.call_function("div", tenths, F.lit(10)).cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
        F.lit("%"),
    )
