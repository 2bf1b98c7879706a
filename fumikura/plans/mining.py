"""Titles to rankings, examples and word candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import settings
from ..operators import match, mine
from ..sources import rankings


@dataclass(frozen=True)
class GramMining:
    top: DataFrame
    wide: DataFrame
    samples: DataFrame


def mine_grams(
    titles: DataFrame,
    sizes=settings.GRAM_SIZES,
    k: int = settings.TOP_GRAMS,
    examples: int = settings.MAX_SAMPLES,
    **options,
) -> GramMining:
    """Top grams of titles <ord, title>, as long and wide ranking, with examples."""
    top = mine.frequent_grams(titles, k, sizes, **options)
    option = {key: options[key] for key in ("symbols", "ord_col", "title") if key in options}
    shown = mine.gram_examples(titles, top, examples, **option)
    return GramMining(top, mine.wide_ranking(top, sizes, k), mine.samples_by_gram(shown))


def drop_list_from_ranking(
    packed: DataFrame,
    extra=settings.MANUAL_DROPS,
    noise=settings.NOISE_WORDS,
    safe=settings.SAFE_WORDS,
    exceptions=settings.NOISE_EXCEPTIONS,
) -> DataFrame:
    """Drop words <word> from a packed suffix ranking."""
    return match.noise_words(rankings.candidate_words(packed), extra, noise, safe, exceptions)
