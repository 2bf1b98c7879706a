"""Joins: word lists against titles, covered words, lookups, graph patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import graph, match, mine, review
from fumikura.operators.scale import with_dense_rank
from fumikura.plans import harvest as harvesting
from fumikura.session import checkpointed, stored

from . import base
from .base import DECIDED, GRAMS, HOME, JUDGED, RDF_TYPE, ROOTS, SCHEMA, SUBJECTS, TRIPLES, VOCAB, query, table
from .filters import CODES, CODE_PREFIX, LONG_WORDS, long_words


@query("d1_theta", f"SELECT doc_id AS id, {base.sql_first_hit('text', base.KEEP)} AS hit FROM documents")
def theta(spark, sf):
    """Short list: tested word by word, in list order, inside one expression."""
    return match.with_first_hit(base.ids_titles(spark, sf), base.KEEP).select("id", "hit")


@query(
    "d1_equi",
    f"""WITH tokens AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{base.RUN}')) AS word FROM benchmark),
    list AS (SELECT row_number() OVER (ORDER BY length(word) DESC, word) AS ord, word FROM tokens WHERE length(word) >= 5),
    hits AS (SELECT d.doc_id, min(l.ord) AS ord FROM documents d JOIN list l ON contains(d.text, l.word) GROUP BY d.doc_id)
    SELECT d.doc_id AS id, l.word AS hit FROM documents d LEFT JOIN hits h USING (doc_id) LEFT JOIN list l ON h.ord = l.ord""",
)
def equi(spark, sf):
    """Long list, taken from the benchmark texts: gram equi join."""
    tokens = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(f"({base.RUN})"), F.lit(1))).alias("word")
    )
    words = tokens.where(F.length("word") >= 5).distinct()
    listed = with_dense_rank(words, [F.desc(F.length("word")), F.asc("word")], "ord")
    return match.first_hit_join(base.ids_titles(spark, sf), listed).select("id", "hit")


@query(
    "d1_long_words",
    f"""WITH {LONG_WORDS}, places AS (SELECT doc_id, w, position(w IN text) AS pos, ord FROM documents JOIN list ON contains(text, w))
    SELECT doc_id AS id, hit, earliest FROM documents LEFT JOIN (SELECT doc_id, arg_min(w, ord) AS hit, arg_min(w, (pos, ord)) AS earliest
      FROM places GROUP BY doc_id) USING (doc_id)""",
)
def long_words_join(spark, sf):
    """Words of up to 110 characters, first in list order and first in the text."""
    words = stored(long_words(spark, sf))
    rows = match.with_first_hit(base.ids_titles(spark, sf), words)
    return match.with_leftmost_hit(rows, words, hit="earliest").select("id", "hit", "earliest")


_CHOSEN = "SELECT word FROM vocab WHERE cnt >= 100"


@query(
    "d2_cover_suffix",
    f"""WITH {VOCAB}, chosen AS ({_CHOSEN}),
    pairs AS (SELECT v.word, c.word AS parent FROM vocab v JOIN chosen c
      ON length(c.word) < length(v.word) AND suffix(v.word, c.word) WHERE v.word NOT IN (SELECT word FROM chosen)),
    best AS (SELECT word, parent FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(parent) DESC, parent) AS k
      FROM pairs) WHERE k = 1)
    SELECT v.word, v.cnt, v.word IN (SELECT word FROM chosen) AS checked, b.parent IS NOT NULL AS covered, b.parent
    FROM vocab v LEFT JOIN best b USING (word)""",
)
def cover_suffix(spark, sf):
    words = base.vocabulary(spark, sf).select("word", "cnt")
    words = checkpointed(words)
    return match.cover_state(words, words.where("cnt >= 100"), "suffix")


@query(
    "d3_cover_sub",
    f"""WITH {GRAMS}, chosen AS (SELECT gram AS word FROM gtop WHERE n IN (2, 3) AND rank BETWEEN 21 AND 60),
    pairs AS (SELECT g.gram AS word, c.word AS parent FROM gtop g JOIN chosen c
      ON length(c.word) < length(g.gram) AND contains(g.gram, c.word) WHERE g.gram NOT IN (SELECT word FROM chosen)),
    best AS (SELECT word, parent FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(parent) DESC, parent) AS k
      FROM pairs) WHERE k = 1)
    SELECT g.n, g.gram AS word, g.cnt, g.gram IN (SELECT word FROM chosen) AS checked, b.parent IS NOT NULL AS covered, b.parent
    FROM gtop g LEFT JOIN best b ON g.gram = b.word""",
)
def cover_sub(spark, sf):
    top = base.top_grams(spark, sf).withColumnRenamed("gram", "word").select(
        F.col("n").cast("bigint").alias("n"), "rank", "word", "cnt"
    )
    top = checkpointed(top)
    chosen = top.where("n in (2, 3) and rank between 21 and 60")
    return match.cover_state(top.drop("rank"), chosen, "substring")


DUAL = f"""{GRAMS},
    dropped AS (SELECT gram AS word FROM gtop WHERE n = 2 AND rank BETWEEN 11 AND 40),
    kept AS (SELECT gram AS word FROM gtop WHERE n = 3 AND rank BETWEEN 11 AND 60),
    open_words AS (SELECT gram AS word FROM gtop WHERE gram NOT IN (SELECT word FROM dropped) AND gram NOT IN (SELECT word FROM kept)),
    ng AS (SELECT o.word, arg_min(d.word, (-length(d.word), d.word)) AS p FROM open_words o JOIN dropped d
      ON length(d.word) < length(o.word) AND contains(o.word, d.word) GROUP BY o.word),
    ok AS (SELECT o.word, arg_min(k.word, (-length(k.word), k.word)) AS p FROM open_words o JOIN kept k
      ON length(k.word) < length(o.word) AND contains(o.word, k.word) GROUP BY o.word),
    dual AS (SELECT g.n, g.rank, g.gram AS word, g.cnt,
      CASE WHEN g.gram IN (SELECT word FROM dropped) THEN 'NG' WHEN g.gram IN (SELECT word FROM kept) THEN 'OK' END AS state,
      coalesce(ng.p, ok.p) AS parent,
      CASE WHEN ng.p IS NOT NULL THEN 'NG' WHEN ok.p IS NOT NULL THEN 'OK' END AS parent_list
      FROM gtop g LEFT JOIN ng ON g.gram = ng.word LEFT JOIN ok ON g.gram = ok.word)"""


def dual_lists(spark, sf):
    top = base.top_grams(spark, sf).withColumnRenamed("gram", "word").select(
        F.col("n").cast("bigint").alias("n"), "rank", "word", "cnt"
    )
    top = checkpointed(top)
    return top, top.where("n = 2 and rank between 11 and 40"), top.where("n = 3 and rank between 11 and 60")


@query("d4_cover_dual", f"WITH {DUAL} SELECT n, word, state, parent, parent_list FROM dual")
def cover_dual(spark, sf):
    return match.dual_cover_state(*dual_lists(spark, sf)).select("n", "word", "state", "parent", "parent_list")


PROTECTED = ["src1", "lang/f", "src"]


@query(
    "d5_protect",
    f"""WITH {SUBJECTS}, p AS (SELECT word, {base.sql_first_hit('word', PROTECTED)} AS hit FROM subjects)
    SELECT word, hit IS NOT NULL AS protected, coalesce(hit, '') AS key FROM p""",
)
def protect(spark, sf):
    words = mine.subject_keywords(base.parsed(spark, sf)).distinct()
    return words.select("word", match.protection("word", PROTECTED).alias("g")).select("word", "g.*")


@query(
    "d6_samples",
    f"""WITH {GRAMS},
    held AS (SELECT DISTINCT g.n, g.gram, g.doc_id FROM grams g JOIN gtop t ON g.n = t.n AND g.gram = t.gram),
    digest AS (SELECT doc_id, md5(text) AS t FROM documents),
    firsts AS (SELECT n, gram, t, min(doc_id) AS doc_id FROM held JOIN digest USING (doc_id) GROUP BY n, gram, t),
    shown AS (SELECT n, gram, string_agg('・' || t, chr(10) ORDER BY doc_id) AS examples FROM (
      SELECT *, row_number() OVER (PARTITION BY n, gram ORDER BY doc_id) AS k FROM firsts) WHERE k <= 10 GROUP BY n, gram)
    SELECT g.n, g.gram AS word, coalesce(examples, 'no sample') AS examples
    FROM gtop g LEFT JOIN shown s ON g.n = s.n AND g.gram = s.gram""",
)
def sample_lookup(spark, sf):
    """Ranked grams with their examples."""
    top = checkpointed(base.top_grams(spark, sf))
    shown = mine.gram_examples(base.titles(spark, sf), top)
    digests = shown.withColumn("title", F.md5("title"))
    words = top.select("n", F.col("gram").alias("word"))
    rows = review.with_samples(words, mine.samples_by_gram(digests).withColumnRenamed("gram", "word"))
    return rows.select(F.col("n").cast("bigint").alias("n"), "word", "examples")


@query(
    "d7_override",
    f"""WITH {JUDGED}, {DECIDED} SELECT id, is_score, coalesce(decision, is_score) AS final,
      decision IS NOT NULL AS overridden FROM judged LEFT JOIN decided USING (id)""",
    text=("is_score", "final",),
)
def override(spark, sf):
    rows = review.unify_columns(base.judged(spark, sf))
    decided = review.last_decisions(base.decision_log(spark, sf))
    return review.with_override(rows, decided).select("id", "is_score", "final", "overridden")


@query(
    "d8_bgp",
    f"""WITH {TRIPLES} SELECT a.s, count(*) AS hits FROM triples a JOIN triples b ON a.s = b.s
    WHERE a.p = '{RDF_TYPE}' AND a.o = '{HOME}type/customer' AND b.p = '{SCHEMA}about'
      AND (b.o IN ('{CODES[0]}') OR b.o LIKE '{CODE_PREFIX}%') GROUP BY a.s""",
)
def bgp(spark, sf):
    test = graph.code_test(CODES, CODE_PREFIX)
    hits = graph.pattern_hits(base.triples(spark, sf), RDF_TYPE, HOME + "type/customer", [(SCHEMA + "about", test)])
    return hits.select("s", "hits")


@query(
    "d9_optional",
    f"""WITH {TRIPLES}, {ROOTS}
    SELECT a.s AS root, a.p AS p1, a.o AS o1, b.p AS p2, b.o AS o2, c.p AS p3, c.o AS o3
    FROM triples a JOIN roots r ON a.s = r.uri
    LEFT JOIN triples b ON b.s = a.o AND a.o <> a.s AND (starts_with(a.o, '_:') OR starts_with(a.o, a.s))
    LEFT JOIN triples c ON c.s = b.o AND b.o <> a.s AND b.o <> a.o AND (starts_with(b.o, '_:') OR starts_with(b.o, a.s))""",
)
def optional(spark, sf):
    rows = graph.expand(base.triples(spark, sf), base.root_list(spark, sf), 3)
    return rows.select("root", "p1", "o1", "p2", "o2", "p3", "o3")


@query("d10_roots", f"WITH {TRIPLES}, {ROOTS} SELECT s, p, o FROM triples WHERE s IN (SELECT uri FROM roots)")
def roots(spark, sf):
    return graph.of_roots(base.triples(spark, sf), base.root_list(spark, sf)).select("s", "p", "o")


@query(
    "d11_failed",
    f"WITH {TRIPLES}, {ROOTS} SELECT uri, 'failed' AS status FROM roots WHERE uri NOT IN (SELECT s FROM triples)",
)
def failed(spark, sf):
    return graph.failed_roots(base.triples(spark, sf), base.root_list(spark, sf))


def harvested(spark, sf):
    return harvesting.harvest_patterns(
        base.triples(spark, sf),
        HOME + "type/customer",
        CODES,
        CODE_PREFIX,
        title_regex="customer#0*(1|2[0-4])",
        text_regex="house|furni",
    )


_TYPED = f"(SELECT s FROM triples WHERE p = '{RDF_TYPE}' AND o = '{HOME}type/customer')"
HARVEST = f"""{TRIPLES}, hits AS (
  SELECT 1 AS pattern, s FROM triples JOIN {_TYPED} USING (s) WHERE p = '{SCHEMA}about'
    AND (o IN ('{CODES[0]}') OR o LIKE '{CODE_PREFIX}%')
  UNION ALL SELECT 2, s FROM triples JOIN {_TYPED} USING (s)
    WHERE p = '{base.LABEL}' AND regexp_matches(o, '(?i)customer#0*(1|2[0-4])')
  UNION ALL SELECT 3, s FROM triples JOIN {_TYPED} USING (s)
    WHERE p = '{SCHEMA}name' AND regexp_matches(o, '(?i)customer#0*(1|2[0-4])')
  UNION ALL SELECT 4, s FROM triples JOIN {_TYPED} USING (s)
    WHERE p = '{SCHEMA}description' AND regexp_matches(o, '(?i)house|furni'))"""
