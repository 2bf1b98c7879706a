"""Triples to root list to nested documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..operators import graph
from ..session import stages, stored
from ..sources import records

_SCHEMA, _RDFS, _RDF = (settings.URI_PREFIXES[i][0] for i in (0, 1, 2))


@dataclass(frozen=True)
class Harvest:
    hits: DataFrame
    stats: DataFrame
    uris: DataFrame


def harvest_patterns(
    triples: DataFrame,
    type_uri: str,
    codes=settings.HARVEST_CODES,
    code_prefix: str = settings.HARVEST_CODE_PREFIX,
    title_regex: str = settings.HARVEST_TITLE_REGEX,
    text_regex: str = settings.HARVEST_TEXT_REGEX,
) -> Harvest:
    """Subjects of a type found by code, label, name or description."""
    title_test, text_test = graph.regex_test(title_regex), graph.regex_test(text_regex)
    patterns = [
        (_SCHEMA + "about", graph.code_test(codes, code_prefix)),
        (_RDFS + "label", title_test),
        (_SCHEMA + "name", title_test),
        (_SCHEMA + "description", text_test),
    ]
    hits = graph.pattern_hits(triples, _RDF + "type", type_uri, patterns)
    return Harvest(hits, graph.harvest_stats(hits, len(patterns)), graph.harvested_uris(hits))


def harvest_documents(triples: DataFrame, roots: DataFrame, path: str, batches: int = settings.HARVEST_BATCHES, derived: bool = True, **options) -> DataFrame:
    """Appends the nested documents of all roots <uri> that the output lacks; gives the whole output <root, part, doc>.

    Roots already in the JSON Lines at ``path`` are left out before anything
    is folded, by the filter beside the output.  What is reached from the
    others is looked up once for all of them and stored by batch; they are
    dealt out to ``batches`` by their hash, and each batch is written when it
    is folded: a run that ends early loses one batch and the lookup, and the
    next run goes on with the rest, whatever the order or the growth of the
    root list.  ``options`` are those of :func:`graph.nested_documents`; null
    roots are left out.  Derived triples are written first; pass
    ``derived=False`` for a stored table.
    """
    spark = triples.sparkSession
    wanted = roots.select(F.col("uri").alias("root")).where(F.col("root").isNotNull()).distinct()
    share = F.pmod(F.xxhash64("root"), F.lit(batches)).cast("int")
    reach = {name: value for name, value in options.items() if name in ("depth", "boundary", "most")}
    with stages(spark):
        todo = stored(records.unwritten(wanted, path, "root").withColumn("_batch", share))
        left = sorted(r._batch for r in todo.select("_batch").distinct().collect())  # at most ``batches`` rows
        facts = stored(triples.select("s", "p", "o", "ord")) if left and derived else triples
        levels = graph.nested_levels(facts, todo.select(F.col("root").alias("uri")), share=share, **reach) if left else []
        for batch in left:
            with stages(spark):
                mine = todo.where(F.col("_batch") == batch).select("root")
                found = [level.where(F.col("_share") == batch).drop("_share") for level in levels]
                docs = graph.nested_documents(facts, mine.withColumnRenamed("root", "uri"), derived=False, levels=found, **options)
                records.append_new(docs, mine, path, "root")
    return spark.read.schema("root string, part string, doc string").json(path)


def harvest(triples: DataFrame, type_uri: str, path: str, batches: int = settings.HARVEST_BATCHES, patterns: dict | None = None, **options) -> tuple[Harvest, DataFrame]:
    """The whole flow, resumable: subjects found by the patterns, then the documents of those not written yet."""
    triples = stored(triples.select("s", "p", "o", "ord"))
    found = harvest_patterns(triples, type_uri, **(patterns or {}))
    return found, harvest_documents(triples, found.uris, path, batches, derived=False, **options)
