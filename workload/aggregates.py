"""Counts, rankings, rollups, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import titles as t
from fumikura.operators import graph, match, mine, review, search
from fumikura.operators.scale import top_per_group
from fumikura.session import scratch_path
from fumikura.sources import records

from . import base, filters, joins
from .base import DECIDED, GRAMS, JUDGED, REC, SUBJECTS, SUFFIX, TRIPLES, VOCAB, query
from .filters import SPLIT
from .joins import HARVEST


@query("e1_gram_counts", f"WITH {GRAMS} SELECT n, gram, cnt, first_pos FROM gcount")
def gram_counts(spark, sf):
    return base.gram_counts(spark, sf).withColumns({c: F.col(c).cast("bigint") for c in ("n", "first_pos")})


@query("e1_large_ord", f"WITH {GRAMS} SELECT n, gram, cnt, CAST(first_pos + (CAST(1 AS HUGEINT) << 70) AS VARCHAR) AS first_pos FROM gcount")
def large_ord(spark, sf):
    """Record ordinals far beyond what fits into one BIGINT together with a position."""
    far = base.titles(spark, sf).withColumn("ord", F.col("ord") + (1 << 46))
    return mine.gram_counts(far).select(F.col("n").cast("bigint").alias("n"), "gram", "cnt", F.col("first_pos").cast("string"))


@query(
    "e2_class_compounds",
    f"""WITH {REC}, found AS (SELECT unnest(regexp_extract_all(text, '({base.RUN}{base.END})', 1)) AS word FROM rec
      WHERE (coalesce(quality, 2) = 1 AND source = 'src7') OR (toxic IS NOT NULL AND contains(text, 'ouble')))
    SELECT word, count(*) AS cnt FROM found GROUP BY word""",
)
def class_compounds(spark, sf):
    rows = base.parsed(spark, sf).where(t.in_class("rec", "http://data.example/keyword/src7", "ouble"))
    named = rows.select(F.col("doc_id").alias("ord"), t.title_of_list("rec").alias("title"))
    return mine.compound_counts(named, base.RUN, base.END).select("word", "cnt")


@query(
    "e3_reasons",
    f"""WITH {SPLIT} SELECT verdict, word, cnt, rank FROM (
      SELECT verdict, word, count(*) AS cnt, row_number() OVER (PARTITION BY verdict ORDER BY count(*) DESC, word) AS rank
      FROM split WHERE word IS NOT NULL GROUP BY verdict, word) WHERE rank <= 20""",
)
def reasons(spark, sf):
    counts = match.reason_counts(filters.split(spark, sf))
    return top_per_group(counts, ["verdict"], [F.desc("cnt"), F.asc("word")], 20)


@query(
    "e4_counters",
    f"""WITH {SPLIT} SELECT verdict, count(*) AS cnt, count(*) FILTER (WHERE is_score) AS flagged FROM split GROUP BY verdict
    UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE is_score) FROM split""",
)
def counters(spark, sf):
    """Counted in the pass that writes the split."""
    rows = filters.split(spark, sf).withColumn("raw", F.col("id").cast("string"))
    counts = records.write_split(rows, scratch_path(spark, "split"))
    return spark.createDataFrame([(name, *pair) for name, pair in counts.items() if pair[0]], "verdict string, cnt bigint, flagged bigint")


@query(
    "e5_fields",
    f"""WITH {REC}, keys AS (
      SELECT CASE lang WHEN 'en' THEN '@id' WHEN 'fr' THEN 'id' WHEN 'de' THEN 'uri' ELSE 'url' END AS field FROM rec
      UNION ALL SELECT 'rdfs:label' FROM rec WHERE lang <> 'es'
      UNION ALL SELECT 'schema:name' FROM rec WHERE lang IN ('fr', 'es')
      UNION ALL SELECT 'schema:about' FROM rec
      UNION ALL SELECT 'schema:description' FROM rec WHERE toxic IS NOT NULL
      UNION ALL SELECT 'k' FROM events),
    t AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM events) AS total),
    c AS (SELECT field, count(*) AS cnt, any_value((SELECT total FROM t)) AS total FROM keys GROUP BY field),
    p AS (SELECT field, cnt, (cnt * 2000 + total) // (total * 2) AS tenths FROM c)
    SELECT field, cnt, (tenths // 10) || '.' || (tenths % 10) || '%' AS percent FROM p""",
)
def fields(spark, sf):
    return mine.field_presence(base.all_lines(spark, sf))


@query(
    "e6_about",
    f"WITH {SUBJECTS} SELECT row_number() OVER (ORDER BY cnt DESC, word) AS rank, word, cnt FROM subjects",
)
def about(spark, sf):
    return mine.subject_ranking(base.parsed(spark, sf), k=None)


@query("e7_suffix_rank", f"WITH {SUFFIX} SELECT n, rank, word, cnt FROM stop")
def suffix_rank(spark, sf):
    rows = base.suffix_top(spark, sf)
    return rows.select(F.col("n").cast("bigint").alias("n"), "rank", "word", "cnt")


def _rollup_sql(size: int) -> str:
    return f"""{VOCAB}, rooted AS (SELECT right(word, {size}) AS root, word, cnt, first_pos,
        row_number() OVER (PARTITION BY right(word, {size}) ORDER BY cnt DESC, first_pos, word) AS k
      FROM vocab WHERE length(word) >= {size}),
    rollup AS (SELECT root, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS variations,
      string_agg(word || '(' || cnt || ')', ', ' ORDER BY k) FILTER (WHERE k <= 5)
        || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS examples FROM rooted GROUP BY root)"""


@query("e8_rollup", f"WITH {_rollup_sql(base.ROOT)} SELECT root, total, variations, examples FROM rollup")
def rollup(spark, sf):
    return mine.vocabulary_rollup(base.vocabulary(spark, sf), base.ROOT)


@query(
    "e9_orphans",
    f"""WITH {_rollup_sql(base.ROOT)}, heads AS (SELECT word FROM vocab WHERE length(word) = {base.ROOT})
    SELECT root, total, variations, examples, FALSE AS orphan FROM rollup WHERE root IN (SELECT word FROM heads)
    UNION ALL SELECT word, cnt, 1, '(No 2-char parent)', TRUE FROM vocab
      WHERE cnt >= 2 AND right(word, {base.ROOT}) NOT IN (SELECT word FROM heads)""",
)
def orphans(spark, sf):
    return mine.rollup_with_orphans(base.vocabulary(spark, sf), base.ROOT)


@query("e10_vocab", f"WITH {VOCAB} SELECT word, cnt, first_pos FROM vocab ORDER BY cnt DESC, first_pos, word")
def vocab(spark, sf):
    return mine.ranked_vocabulary(base.vocabulary(spark, sf)).withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query(
    "e11_group",
    f"""WITH {TRIPLES} SELECT s, p, CAST(0 AS BIGINT) AS page, string_agg(o, '|' ORDER BY ord) AS objects
    FROM triples GROUP BY s, p""",
)
def group(spark, sf):
    rows = graph.grouped_objects(base.triples(spark, sf))
    return rows.select("s", "p", "page", F.array_join("objects", "|").alias("objects"))


@query(
    "e11_pages",
    f"""WITH {TRIPLES}, cut AS (SELECT left(s, 20) AS s, p, o, ord FROM triples),
    counted AS (SELECT *, count(*) OVER (PARTITION BY p, s) AS total, row_number() OVER (PARTITION BY p, s ORDER BY ord) - 1 AS i FROM cut),
    placed AS (SELECT *, CASE WHEN total > 40 THEN i // 40 + 1 ELSE 0 END AS page FROM counted)
    SELECT s, p, page, total, string_agg(o, '|' ORDER BY ord) AS objects, CASE WHEN total = 1 THEN CAST(to_json(min(o)) AS VARCHAR) END AS bare
    FROM placed GROUP BY s, p, page, total""",
)
def group_pages(spark, sf):
    """Subjects cut to a prefix make large groups with gaps in ``ord``; 40 values go on a page."""
    rows = base.triples(spark, sf).withColumn("s", F.left("s", F.lit(20)))
    pages = graph.grouped_objects(rows, most=40)
    bare = F.when(F.col("total") == 1, graph.collapsed("objects", "total"))
    return pages.select("s", "p", "page", "total", F.array_join("objects", "|").alias("objects"), bare.alias("bare"))


@query(
    "e12_new_ids",
    f"""WITH {HARVEST}, first AS (SELECT s, min(pattern) AS pattern FROM hits GROUP BY s)
    SELECT pattern, coalesce(h.hits, 0) AS hits, coalesce(f.new_ids, 0) AS new_ids
    FROM (SELECT unnest([1, 2, 3, 4]::BIGINT[]) AS pattern)
    LEFT JOIN (SELECT pattern, count(*) AS hits FROM hits GROUP BY pattern) h USING (pattern)
    LEFT JOIN (SELECT pattern, count(*) AS new_ids FROM first GROUP BY pattern) f USING (pattern)""",
)
def new_ids(spark, sf):
    return joins.harvested(spark, sf).stats.withColumn("pattern", F.col("pattern").cast("bigint"))


@query(
    "e13_dist",
    f"""WITH {JUDGED}, {DECIDED} SELECT is_score, count(*) AS cnt, count(decision) AS overrides
    FROM judged LEFT JOIN decided USING (id) GROUP BY is_score""",
    text=("is_score",),
)
def dist(spark, sf):
    decided = review.last_decisions(base.decision_log(spark, sf))
    return review.verdict_summary(review.with_override(review.unify_columns(base.judged(spark, sf)), decided))


@query("f1_topn", f"WITH {GRAMS} SELECT n, rank, gram, cnt FROM gtop")
def topn(spark, sf):
    return base.top_grams(spark, sf).select(F.col("n").cast("bigint").alias("n"), "rank", "gram", "cnt")


@query(
    "f2_wide",
    "WITH " + GRAMS + ' SELECT r AS "Rank", ' + ", ".join(
        f'max(gram) FILTER (WHERE n = {n}) AS "{name}-gram", max(cnt) FILTER (WHERE n = {n}) AS "{name}-Count"'
        for n, name in ((2, "Bi"), (3, "Tri"), (4, "Tetra"), (5, "Penta"))
    ) + " FROM (SELECT unnest(range(1, 201)) AS r) LEFT JOIN gtop ON r = rank GROUP BY r",
)
def wide(spark, sf):
    return mine.wide_ranking(base.top_grams(spark, sf), (2, 3, 4, 5), 200)


@query(
    "f3_examples",
    f"""WITH {GRAMS},
    held AS (SELECT DISTINCT g.n, g.gram, g.doc_id FROM grams g JOIN gtop t ON g.n = t.n AND g.gram = t.gram),
    digest AS (SELECT doc_id, md5(text) AS title FROM documents),
    firsts AS (SELECT CAST(n AS BIGINT) AS n, gram, title, min(doc_id) AS doc_id
      FROM held JOIN digest USING (doc_id) GROUP BY n, gram, title)
    SELECT n, gram, place, title FROM (
      SELECT *, row_number() OVER (PARTITION BY n, gram ORDER BY doc_id) AS place FROM firsts) WHERE place <= 10""",
)
def examples(spark, sf):
    rows = mine.gram_examples(base.titles(spark, sf), base.top_grams(spark, sf))
    return rows.select(F.col("n").cast("bigint").alias("n"), "gram", "place", F.md5("title").alias("title"))


@query(
    "f4_sorted_counts",
    f"WITH {SUFFIX}, every AS (SELECT word, CAST(sum(cnt) AS BIGINT) AS cnt FROM suffix GROUP BY word) SELECT word, cnt FROM every ORDER BY cnt DESC, word",
)
def sorted_counts(spark, sf):
    """Every ending of every size, most frequent first."""
    ends = mine.suffixes(base.vocabulary(spark, sf), base.SIZES)
    counts = ends.groupBy(F.col("suffix").alias("word")).agg(F.sum("cnt").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "word")


@query(
    "f5_limit",
    f"""WITH {VOCAB} SELECT word, cnt, (SELECT count(*) > 500 FROM vocab) AS truncated
    FROM vocab ORDER BY cnt DESC, word LIMIT 500""",
)
def limit(spark, sf):
    words = base.vocabulary(spark, sf).select("word", "cnt")
    rows, more = search.head_of(words, [F.desc("cnt"), F.asc("word")], 500)
    return rows.withColumn("truncated", more)


_LAST = base.HOME + "customer/12"


@query("f6_page", f"WITH {HARVEST} SELECT s FROM hits WHERE s > '{_LAST}' ORDER BY s LIMIT 500")
def page(spark, sf):
    """One page out of a sorted store."""
    return graph.page_store(joins.harvested(spark, sf).hits.groupBy("s").agg(F.sum("hits").alias("hits"))).after(_LAST)


@query("f7_sample", f"WITH {JUDGED} SELECT id, is_score FROM judged ORDER BY md5(id || '#7'), id LIMIT 300", text=("is_score",))
def sample(spark, sf):
    rows = review.unify_columns(base.judged(spark, sf))
    return review.sample_rows(rows, seed="7").select("id", "is_score")


@query("f8_sorted", f"WITH {HARVEST} SELECT DISTINCT s AS uri FROM hits ORDER BY s")
def sorted_uris(spark, sf):
    return joins.harvested(spark, sf).uris
