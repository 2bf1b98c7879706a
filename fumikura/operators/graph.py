"""Triples: pattern filters and joins, grouping, nested documents.

A triple table is <s, p, o STRING, ord BIGINT>; ``ord`` is unique and gives
the arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions.uris import is_subnode, shorten
from ..functions.variants import json_string
from ..session import Buckets, scratch_path, stored
from .scale import dealt, lookup_join, with_dense_rank

GROUP_ROWS = 100_000  # most values that go into one array or document
_HEAD = 64  # most characters of a root by which objects are told apart roughly


def code_test(codes: Sequence[str], prefix: str) -> Callable[[Column], Column]:
    """Object is one of the codes or begins with the prefix."""
    return lambda o: o.isin(*codes) | F.startswith(o, F.lit(prefix))


def regex_test(pattern: str) -> Callable[[Column], Column]:
    """Object matches a regular expression, case ignored."""
    return lambda o: o.rlike("(?iu)" + pattern)


def pattern_hits(
    triples: DataFrame,
    type_pred: str,
    type_uri: str,
    patterns: Sequence[tuple[str, Callable[[Column], Column]]],
) -> DataFrame:
    """Subjects of a type with a property that passes a test: <pattern, s, hits>.

    Each pattern is a property and a test of its object, numbered from 1; both
    triple patterns of a query share the subject.  ``hits`` is the number of
    solutions.  All patterns are counted per subject in one pass over the
    triples, with partial sums before the shuffle, instead of one self join
    per pattern.
    """
    o, p = F.col("o"), F.col("p")
    wanted = triples.where(p.isin(type_pred, *{pred for pred, _ in patterns}))
    counts = [F.count_if((p == type_pred) & (o == type_uri)).alias("_typed")]
    counts += [F.count_if((p == pred) & test(o)).alias(f"_{no}") for no, (pred, test) in enumerate(patterns, 1)]
    per_subject = wanted.groupBy("s").agg(*counts).where(F.col("_typed") > 0)
    rows = [
        F.struct(F.lit(no).alias("pattern"), (F.col("_typed") * F.col(f"_{no}")).alias("hits"))
        for no in range(1, len(patterns) + 1)
    ]
    return per_subject.select("s", F.inline(F.array(*rows))).where(F.col("hits") > 0).select("pattern", "s", "hits")


def page_after(hits: DataFrame, last: str | None, limit: int = settings.PAGE_SIZE) -> DataFrame:
    """Keyset page: the next ``limit`` solutions after a key, repeats counted.

    A key is repeated at most ``limit`` times, as a page can hold no more.
    """
    rest = hits if last is None else hits.where(F.col("s") > last)
    page = rest.orderBy("s").limit(limit)
    times = F.sequence(F.lit(1).cast("bigint"), F.least("hits", F.lit(limit).cast("bigint")))
    return page.select("s", F.explode(times).alias("copy")).orderBy("s", "copy").limit(limit).select("s")


@dataclass(frozen=True)
class Pages:
    """Solutions <s, hits> sorted over files, and what each file holds: <file, first, last, hits>."""

    path: str
    index: DataFrame

    def after(self, last: str | None, limit: int = settings.PAGE_SIZE) -> DataFrame:
        """:func:`page_after` that reads only the files the page lies in."""
        spark = self.index.sparkSession
        rest = self.index if last is None else self.index.where(F.col("last") > last)
        files, held = [], 0
        for row in rest.orderBy("first").limit(limit + 1).collect():  # every file has a solution
            files.append(row.file)
            # The first file may hold solutions up to the key.
            held += row.hits if len(files) > 1 or last is None or row.first > last else 0
            if held >= limit:
                break
        rows = spark.read.schema("s string, hits bigint")
        return page_after(rows.parquet(*files) if files else spark.createDataFrame([], "s string, hits bigint"), last, limit)


def page_store(hits: DataFrame) -> Pages:
    """Writes solutions <s, hits> once, in sorted ranges, for any number of pages.

    A file covers a range of keys that no other does; the index has one row per file.
    """
    spark = hits.sparkSession
    path, index = scratch_path(spark, "pages"), scratch_path(spark, "page-index")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hits.select("s", F.col("hits").cast("bigint").alias("hits")).where(F.col("s").isNotNull())
    rows.repartitionByRange(ranges, "s").sortWithinPartitions("s").write.parquet(path)
    read = spark.read.schema("s string, hits bigint").parquet(path).select("s", "hits", F.col("_metadata.file_path").alias("file"))
    read.groupBy("file").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.sum("hits").alias("hits")).write.parquet(index)
    return Pages(path, spark.read.schema("file string, first string, last string, hits bigint").parquet(index))


def harvest_stats(hits: DataFrame, patterns: int | None = None) -> DataFrame:
    """Per pattern: all solutions, and subjects no earlier pattern had found.

    With the number of ``patterns`` those without a solution have a row of zeros.
    """
    # A subject has at most one row per pattern, so its list is short; hits come grouped by subject already.
    per_subject = hits.groupBy("s").agg(F.min("pattern").alias("_first"), F.collect_list(F.struct("pattern", "hits")).alias("_rows"))
    found = (
        per_subject.select("_first", F.inline("_rows"))
        .groupBy("pattern")
        .agg(F.sum("hits").alias("hits"), F.count_if(F.col("_first") == F.col("pattern")).alias("new_ids"))
    )
    if patterns is None:
        return found
    every = hits.sparkSession.range(1, patterns + 1).select(F.col("id").cast("int").alias("pattern"))
    zero = F.lit(0).cast("bigint")
    return every.join(found, "pattern", "left").select("pattern", F.coalesce("hits", zero).alias("hits"), F.coalesce("new_ids", zero).alias("new_ids"))


def harvested_uris(hits: DataFrame) -> DataFrame:
    """Distinct subjects of all patterns, sorted."""
    return hits.select(F.col("s").alias("uri")).distinct().orderBy("uri")


def of_roots(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Triples whose subject is in the root list <uri>."""
    wanted = roots.select(F.col("uri").alias("s")).distinct()
    return lookup_join(triples, wanted, ["s"], "left_semi", derived=True)


def failed_roots(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots without any triple: <uri, status>."""
    known = triples.select(F.col("s").alias("uri")).distinct()
    return roots.select("uri").distinct().join(known, "uri", "left_anti").withColumn(
        "status", F.lit("failed")
    )


def _paged(triples: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Adds <total, page>: for keys with more than ``most`` rows their number and a page, else NULL and 0.

    Pages count positions in the order of ``ord``, so a page holds ``most``
    rows whatever the gaps in ``ord``; those of a large key start at 1.  Only
    rows of large keys are ranked: a range sort and one offset per key.  Large
    keys are looked for by a hash, which is narrow; rows of those alone are
    counted by key.
    """
    coded = triples.select(*keys, F.xxhash64(*keys).alias("_code"))
    heavy = stored(coded.groupBy("_code").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select("_code"))
    counted = lookup_join(coded, heavy, ["_code"], "left_semi", derived=False).groupBy(*keys).agg(F.count("*").alias("total"))
    sizes = heavy if heavy.isEmpty() else stored(counted.where(F.col("total") > most))
    if sizes.isEmpty():
        return triples.withColumn("total", F.lit(None).cast("bigint")).withColumn("page", F.lit(0).cast("bigint"))
    tagged = lookup_join(triples, sizes, keys, "left", derived=False)
    large = tagged.where(F.col("total").isNotNull())
    small = tagged.where(F.col("total").isNull()).withColumn("page", F.lit(0).cast("bigint"))
    ranked = stored(with_dense_rank(large, [*[F.asc(k) for k in keys], F.asc("ord")], "_rank"))
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    placed = lookup_join(ranked, first, keys, "inner")
    page = F.call_function("div", F.col("_rank") - F.col("_first"), F.lit(most)) + 1
    return small.unionByName(placed.withColumn("page", page).drop("_rank", "_first"))


def grouped_objects(triples: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """Objects per subject and property in arrival order: <s, p, page, total, objects>.

    ``total`` is the number of values of the whole group.  A group of up to
    ``most`` values is one array on page 0.  A larger one is cut into pages of
    ``most`` values, so that no task has to hold it; its pages in order give
    the whole list.
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", "o")))
    keys = ["s", "p", "page"]
    rows = _paged(triples, ["s", "p"], most).select(*keys, "ord", "o", "total")
    # A page number that is the same for all is no key to Spark, which would deal the rows out once more.
    by = keys[:2] if rows.where(F.col("page") > 0).isEmpty() else keys
    pages = dealt(rows, by, triples.count()).groupBy(*keys).agg(
        F.max("total").alias("_total"), F.transform(listed, lambda x: x["o"]).alias("objects")
    )
    total = F.coalesce("_total", F.size("objects").cast("bigint"))
    return pages.select("s", "p", "page", total.alias("total"), "objects")


def collapsed(values: Column | str, total: Column | str | None = None) -> Column:
    """JSON text of a string list: the value itself if single, else the list.

    ``total`` is the size of the whole group where ``values`` is one page of
    it: a page with one value of many is still a list.
    """
    col = F.col(values) if isinstance(values, str) else values
    size = F.size(col) if total is None else F.col(total) if isinstance(total, str) else total
    return F.when(size == 1, json_string(F.get(col, F.lit(0)))).otherwise(F.to_json(col))


def _level(triples: DataFrame, d: int, *also: str) -> DataFrame:
    return triples.select(*[F.col(c).alias(f"{c}{d}") for c in ("s", "p", "o", "ord")], *also)


def _path(d: int) -> list[Column]:
    """Nodes above the object of level d: the root and the objects before it."""
    return [F.col("root")] + [F.col(f"o{i}") for i in range(1, d)]


def expand(
    triples: DataFrame,
    roots: DataFrame,
    depth: int = 3,
    boundary: str | None = None,
    most: int = GROUP_ROWS,
) -> DataFrame:
    """One row per path from a root: root, then p, o, ord of every level.

    Level 1 holds the triples of the root.  An object that is a sub-node and
    not on its own path is followed if it has triples; columns of levels that
    do not exist are NULL.

    Objects that cannot be followed join on a key of their own, which keeps
    them spread evenly.  A node with more than ``most`` triples is joined page
    by page, so its triples never meet in one task.
    """
    rows = _level(of_roots(triples, roots), 1).withColumnRenamed("s1", "root")
    if depth < 2:
        return rows
    paged = _paged(triples, ["s"], most)
    # One number per large node, its count of pages.
    pages = stored(paged.where(F.col("page") > 0).groupBy("s").agg(F.max("page").alias("_pages"))).withColumnRenamed("s", "_key")
    for d in range(2, depth + 1):
        node = F.col(f"o{d - 1}")
        on_path = F.lit(False)
        for above in _path(d - 1):
            on_path = on_path | (node == above)
        follow = F.coalesce(is_subnode(node, "root", boundary) & ~on_path, F.lit(False))
        own = F.concat(F.lit("\u0000"), *[F.coalesce(F.col(f"ord{i}").cast("string"), F.lit("")) for i in range(1, d)])
        keyed = rows.withColumn("_key", F.when(follow, node).otherwise(own))
        single, one = F.array(F.lit(0).cast("bigint")), F.lit(1).cast("bigint")
        keyed = lookup_join(keyed, pages, ["_key"], "left", derived=False).withColumn(
            "_page", F.explode(F.when(F.col("_pages").isNull(), single).otherwise(F.sequence(one, "_pages")))
        )
        child = _level(paged, d, "page").withColumnRenamed(f"s{d}", "_key").withColumnRenamed("page", "_page")
        rows = keyed.join(child, ["_key", "_page"], "left").drop("_key", "_page", "_pages")
    return rows


def _plain(boundary: str | None) -> Column:
    """JSON of an object that is not expanded; ``above`` holds the nodes over it, its own subject included."""
    node = F.col("o")
    cycle = F.coalesce(F.array_contains("above", node) & is_subnode(node, "root", boundary), F.lit(False))
    ref = F.concat(F.lit('{"@id":'), json_string(node), F.lit(',"meta":"cyclic_reference"}'))
    return F.when(cycle, ref).otherwise(json_string(node))


def _below(followed: DataFrame, paged: DataFrame, pages: DataFrame, way: Sequence[str], name: str) -> DataFrame:
    """Triples of the objects that are followed: <root, way, name, above, p, o>.

    A node with more triples than a page is joined page by page, so its
    triples never meet in one task.
    """
    single, one = F.array(F.lit(0).cast("bigint")), F.lit(1).cast("bigint")
    keyed = followed.select("root", *way, "above", F.col("o").alias("_key"))
    keyed = lookup_join(keyed, pages, ["_key"], "left", derived=False).withColumn(
        "_page", F.explode(F.when(F.col("_pages").isNull(), single).otherwise(F.sequence(one, "_pages")))
    )
    child = paged.select(F.col("s").alias("_key"), F.col("page").alias("_page"), "p", "o", F.col("ord").alias(name))
    return keyed.join(child, ["_key", "_page"]).select("root", *way, name, F.array_append("above", F.col("_key")).alias("above"), "p", "o")


def _folded(rows: DataFrame, keys: Sequence[str], order: str, prefixes, total: Column | None = None) -> DataFrame:
    """<keys, _text, _paths>: properties of a node as JSON, in arrival order; ``rows`` is <keys, p, order, value, paths>."""
    values = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), "value")))
    texts = F.transform("_values", lambda x: x["value"])
    many = F.size("_values").cast("bigint") if total is None else F.coalesce(F.col("_whole"), F.size("_values").cast("bigint"))
    json_value = F.when(many == 1, F.get(texts, F.lit(0))).otherwise(
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    )
    prop = F.concat(json_string(shorten("p", prefixes)), F.lit(":"), json_value)
    whole = [] if total is None else [F.max(total).alias("_whole")]
    props = rows.groupBy(*keys, "p").agg(F.min(order).alias("_first"), values.alias("_values"), F.sum("paths").alias("_paths"), *whole)
    props = props.select(*keys, "_paths", F.struct("_first", prop.alias("text")).alias("_p"))
    nodes = props.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_props"), F.sum("_paths").alias("_paths"))
    return nodes.select(*keys, F.array_join(F.transform("_props", lambda x: x["text"]), ",").alias("_text"), "_paths")


def nested_levels(
    triples: DataFrame,
    roots: DataFrame,
    depth: int = 3,
    boundary: str | None = None,
    most: int = GROUP_ROWS,
    share: Column | None = None,
) -> list[DataFrame]:
    """The triples reached from the roots <uri>, level by level: <root, ord1, .., above, p, o, _follow>.

    Every level joins only the objects that are followed, by number: a value
    is named by the ordinals on the way to it.  Levels end where nothing is
    followed, at ``depth`` at the latest.  With ``share``, a number made of
    ``root``, all levels are stored by it and have it as ``_share``, so that
    the roots of one share can be folded without reading the others.
    """
    level = of_roots(triples, roots).select(F.col("s").alias("root"), F.col("ord").alias("ord1"), F.array("s").alias("above"), "p", "o")
    levels, paged, pages = [], None, None
    for d in range(1, depth + 1):
        way = [f"ord{i}" for i in range(1, d + 1)]
        follow = F.coalesce(is_subnode("o", "root", boundary) & ~F.array_contains("above", F.col("o")), F.lit(False)) if d < depth else F.lit(False)
        level = level.withColumn("_follow", follow)
        if share is not None:
            levels.append(stored(level.withColumn("_share", share), by="_share"))
        else:
            levels.append(stored(level) if d == 1 or d < depth else level)
        if d == depth or levels[-1].where("_follow").isEmpty():
            break
        if paged is None:
            paged = _paged(triples, ["s"], most)
            # One number per large node, its count of pages.
            pages = stored(paged.where(F.col("page") > 0).groupBy("s").agg(F.max("page").alias("_pages"))).withColumnRenamed("s", "_key")
        level = _below(levels[-1].where("_follow"), paged, pages, way, f"ord{d + 1}")
    return levels


def nested_documents(
    triples: DataFrame,
    roots: DataFrame,
    depth: int = 3,
    prefixes=settings.URI_PREFIXES,
    boundary: str | None = None,
    most: int = GROUP_ROWS,
    derived: bool = True,
    levels: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """One JSON document per root: <root, part, doc>.

    Properties are shortened and keep their arrival order, a single value
    stands bare, several form a list.  Roots without triples give a document
    with status ``failed``.  Other roots have part ''.

    A root with more than ``most`` paths is given in fragments: part '1' on
    holds a range of the root's own values, each with all that is below it, so
    no value and no inner node stands in two of them.  Whether a property is a
    list is decided by all its values, so the lists of the fragments in order
    are the whole list; a fragment tells its place as ``"part":k``.  Levels
    beyond ``depth`` stay references.

    Going down, see :func:`nested_levels`; where these were made before, for
    just these roots, pass them as ``levels``.  Going up, a
    node is folded once, and its text joins the one value that refers to it;
    values that refer to nothing are not moved for it.  Derived triples are
    written first; pass ``derived=False`` for a stored table.
    """
    if levels is None:
        triples = stored(triples.select("s", "p", "o", "ord")) if derived else triples
        levels = nested_levels(triples, roots, depth, boundary, most)

    docs = None
    for d in range(len(levels), 0, -1):
        way = [f"ord{i}" for i in range(1, d + 1)]
        value = [*(["root"] if d == 1 else []), *way, "p", _plain(boundary).alias("value"), F.lit(1).cast("bigint").alias("paths")]
        rows = levels[d - 1].where(~F.col("_follow")).select(*value)
        if docs is not None:
            inner = levels[d - 1].where("_follow").select(*value, "o").join(docs, way, "left")
            text = F.concat(F.lit('{"@id":'), json_string("o"), F.lit(","), "_text", F.lit("}"))
            kept = [c for c in rows.columns if c not in ("value", "paths")]
            rows = rows.unionByName(inner.select(*kept, F.coalesce(text, "value").alias("value"), F.coalesce("_paths", "paths").alias("paths")))
        if d > 1:
            docs = _folded(rows, way[:-1], way[-1], prefixes)

    rows = stored(rows)
    sizes = rows.groupBy("root").agg(F.sum("paths").alias("_size"))
    large = stored(sizes.where(F.col("_size") > most))
    rows = rows.withColumn("part", F.lit(""))
    total = None
    if not large.isEmpty():
        own = lookup_join(rows.select("root", "p", "ord1"), large, ["root"], "inner", derived=False)
        # As many of the root's values as have about ``most`` paths between them.
        ranked = stored(with_dense_rank(own, [F.asc("root"), F.asc("ord1")], "_rank"))
        first = ranked.groupBy("root").agg(F.min("_rank").alias("_first"), F.count("*").alias("_values"))
        each = F.greatest(F.lit(1), F.call_function("div", F.lit(most) * F.col("_values"), F.col("_size")))
        number = F.call_function("div", F.col("_rank") - F.col("_first"), each) + 1
        parts = lookup_join(ranked, first, ["root"], "inner").select("root", "ord1", number.cast("string").alias("_part"))
        rows = lookup_join(rows, parts, ["root", "ord1"], "left").withColumn("part", F.coalesce("_part", "part")).drop("_part")
        totals = ranked.groupBy("root", "p").agg(F.count("*").alias("_total"))
        rows = lookup_join(rows, totals, ["root", "p"], "left")
        total = F.col("_total")
    whole = _folded(rows, ["root", "part"], "ord1", prefixes, total)
    place = F.when(F.col("part") == "", F.lit("")).otherwise(F.concat(F.lit('"part":'), "part", F.lit(",")))
    body = F.concat(F.lit('{"@id":'), json_string("root"), F.lit(","), place, "_text", F.lit(',"status":"success"}'))

    known = levels[0].select(F.col("root").alias("s"))  # a root has triples if the first level has some of it
    failed = failed_roots(known, roots).select(
        F.col("uri").alias("root"), F.lit("").alias("part"), F.to_json(F.struct("uri", "status")).alias("doc")
    )
    return whole.select("root", "part", body.alias("doc")).unionByName(failed)


def _links(triples: DataFrame, roots: DataFrame, subjects: DataFrame) -> DataFrame:
    """<node, next> of all steps that may be followed from some root, stored.

    Only blank nodes and objects that begin like some root can be followed;
    the test against the very root comes later.  That keeps types and other
    hot objects out of the join.
    """
    size = min(_HEAD, roots.agg(F.min(F.length("uri"))).first()[0] or 0)
    begins = stored(roots.select(F.left("uri", F.lit(size)).alias("_head")).distinct())
    maybe = triples.select("s", "o").withColumn("_head", F.left("o", F.lit(size)))
    is_blank = F.startswith("o", F.lit("_:"))
    blank = maybe.where(is_blank).select("s", "o")
    named = lookup_join(maybe.where(~is_blank), begins, ["_head"], "left_semi", derived=False)
    inner = blank.unionByName(named.select("s", "o")).distinct().join(subjects.withColumnRenamed("node", "o"), "o", "left_semi")
    return stored(inner.select(F.col("s").alias("node"), F.col("o").alias("next")))


def frontier(
    triples: DataFrame,
    roots: DataFrame,
    max_depth: int | None = None,
    boundary: str | None = None,
    paths: bool = False,
) -> DataFrame:
    """Nodes of every tree at their least depth: <root, depth, node>.

    Depth 1 is the root.  Each round follows the sub-nodes that have triples
    and were not reached before; without ``max_depth`` the rounds go on until
    none is left.

    What was reached is one table in the shared folder, in buckets by root and
    node.  A round takes the nodes of the round before, follows their links,
    leaves out by one anti join all that the table holds, and appends the rest;
    so its plan is the same at any depth, and the table is never shuffled.
    Triples and roots are written first, as all of them are read several times.

    With ``paths`` there is one row per way to a node that visits no node
    twice, and a column ``path``; their number can grow with the factorial of
    the nodes that link each other.
    """
    spark = triples.sparkSession
    triples, roots = stored(triples.select("s", "o")), stored(roots.select("uri").distinct())
    subjects = stored(triples.select(F.col("s").alias("node")).distinct())
    first = roots.select(F.col("uri").alias("node")).distinct().join(subjects, "node", "left_semi")
    columns = ["root", "node", *(["path"] if paths else [])]
    level = first.select(F.col("node").alias("root"), "node", F.array("node").alias("path")).select(*columns)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached = Buckets(spark, "reached", buckets, ["root", "node"])
    links = Buckets(spark, "links", buckets, ["node"])
    try:
        links.append(_links(triples, roots, subjects))
        depth = 1
        while reached.append(level.withColumn("depth", F.lit(depth)), "depth") and (max_depth is None or depth < max_depth):
            last = reached.rows().where(F.col("depth") == depth).drop("depth")
            step = last.join(links.rows(), "node").where(is_subnode("next", "root", boundary))
            if paths:
                step = step.where(~F.array_contains("path", F.col("next")))
                level = step.select("root", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
            else:
                step = step.select("root", F.col("next").alias("node")).distinct()
                level = step.join(reached.rows().select("root", "node"), ["root", "node"], "left_anti")
            depth += 1
        return reached.files().select("root", "depth", *columns[1:])
    finally:
        links.forget()
        reached.forget()
