"""Judging, review queues, decisions, and the whole cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import titles as t
from fumikura.operators import judge, mine, review
from fumikura.plans import curation
from fumikura.session import checkpointed

from . import base, filters, joins
from .base import DECIDED, FOLDED, JUDGED, REC, SUBJECTS, SUFFIX, VOCAB, query, table
from .joins import DUAL

YES, NO = ["thernt", "éêe", "keit"], ["ouble", "ción"]


def _asked_sql(text: str) -> str:
    """What the keyword scorer answers for a text: <verdict, reason>."""
    no, yes = base.sql_first_hit(text, NO), base.sql_first_hit(text, YES)
    return f"""CASE WHEN {no} IS NOT NULL THEN FALSE WHEN {yes} IS NOT NULL THEN TRUE END AS judgment,
      CASE WHEN {no} IS NOT NULL THEN 'holds ' || {no} WHEN {yes} IS NOT NULL THEN 'holds ' || {yes}
        ELSE 'no known word' END AS reason"""


@query("h4_judge", f"WITH {REC} SELECT id, title AS label, {_asked_sql('text')} FROM rec", text=("judgment",))
def judged(spark, sf):
    return judge.judge(base.parsed(spark, sf), judge.keyword_scorer(YES, NO))


@query("h3_fold", f"WITH {FOLDED} SELECT word, nullif(state, '-') AS state FROM folded")
def fold(spark, sf):
    return review.fold_decisions(base.action_log(spark, sf))


@query(
    "h3_toggles",
    "SELECT 'w' || user_id AS word FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) % 2 = 1",
)
def toggles(spark, sf):
    return review.fold_toggles(base.action_log(spark, sf).where("action = 'TOGGLE_NG'"))


@query(
    "g4_exclusive",
    f"""WITH {FOLDED} SELECT 'NG' AS list, word FROM folded WHERE state = 'NG'
    UNION ALL SELECT 'OK', word FROM folded WHERE state = 'OK'""",
)
def exclusive(spark, sf):
    drop, keep = review.lists_of(review.fold_decisions(base.action_log(spark, sf)))
    return drop.select(F.lit("NG").alias("list"), "word").unionAll(keep.select(F.lit("OK"), "word"))


@query(
    "g2_bulk",
    f"""WITH {VOCAB}, sel AS (SELECT word FROM vocab WHERE cnt BETWEEN 3 AND 9),
    vis AS (SELECT word FROM vocab WHERE cnt BETWEEN 7 AND 20)
    SELECT 'select' AS action, word FROM (SELECT word FROM sel UNION SELECT word FROM vis)
    UNION ALL SELECT 'clear', word FROM sel WHERE word NOT IN (SELECT word FROM vis)""",
)
def bulk(spark, sf):
    words = base.vocabulary(spark, sf)
    sel, vis = words.where("cnt between 3 and 9"), words.where("cnt between 7 and 20")
    added = review.select_all(sel, vis).select(F.lit("select").alias("action"), "word")
    return added.unionAll(review.clear_all(sel, vis).select(F.lit("clear"), "word"))


@query(
    "h5_queue",
    f"""WITH {SUBJECTS}, shown AS (SELECT row_number() OVER (ORDER BY cnt DESC, word) AS rank, word, cnt FROM subjects
      ORDER BY rank LIMIT 1000),
    sel AS (SELECT DISTINCT 'http://data.example/keyword/' || source AS word FROM documents WHERE lang = 'de' AND n_chars > 4000)
    SELECT rank, word, cnt, word IN (SELECT word FROM sel) AS checked,
      {base.sql_first_hit('word', joins.PROTECTED)} IS NOT NULL AS protected,
      coalesce({base.sql_first_hit('word', joins.PROTECTED)}, '') AS key,
      CASE WHEN length(word) > 30 THEN '...' || right(word, 25) ELSE word END AS label, word AS link FROM shown""",
)
def queue(spark, sf):
    ranked = mine.subject_keywords(base.parsed(spark, sf)).groupBy("word").agg(F.count("*").alias("cnt"))
    docs = table(spark, sf, "documents").where("lang = 'de' and n_chars > 4000")
    sel = docs.select(F.concat(F.lit("http://data.example/keyword/"), "source").alias("word"))
    return review.subject_queue(ranked, sel, joins.PROTECTED, uris_only=True)


_LINK = "'https://www.google.com/search?q=' || replace(url_encode(word || ' とは'), '%2F', '/')"


_SHOWN = """held AS (SELECT DISTINCT g.n, g.gram, g.doc_id FROM grams g JOIN gtop t ON g.n = t.n AND g.gram = t.gram),
    digest AS (SELECT doc_id, md5(text) AS t FROM documents),
    firsts AS (SELECT n, gram, t, min(doc_id) AS doc_id FROM held JOIN digest USING (doc_id) GROUP BY n, gram, t),
    shown AS (SELECT n, gram, string_agg('・' || t, chr(10) ORDER BY doc_id) AS examples FROM (
      SELECT *, row_number() OVER (PARTITION BY n, gram ORDER BY doc_id) AS k FROM firsts) WHERE k <= 10 GROUP BY n, gram)"""


@query(
    "h5_dual_queue",
    f"""WITH {DUAL}, {_SHOWN} SELECT d.n, rank, word, cnt, state, parent, parent_list, {_LINK} AS link, coalesce(examples, 'no sample') AS examples
    FROM dual d LEFT JOIN shown s ON d.n = s.n AND word = gram""",
)
def dual_queue(spark, sf):
    """All ranked words, with their examples."""
    ranked, drop, keep = joins.dual_lists(spark, sf)
    examples = mine.gram_examples(base.titles(spark, sf), ranked.withColumnRenamed("word", "gram")).withColumn("title", F.md5("title"))
    samples = mine.samples_by_gram(examples).withColumnRenamed("gram", "word")
    return review.dual_queue(ranked, drop, keep, samples)


@query(
    "h5_dual_search",
    f"WITH {DUAL} SELECT n, rank, word, cnt, state, parent, parent_list, {_LINK} AS link FROM dual WHERE regexp_matches(word, '^[a-t]')",
)
def dual_search(spark, sf):
    """A search pattern shows all words that match."""
    return review.dual_queue(*joins.dual_lists(spark, sf), pattern="^[a-t]")


@query(
    "h5_word_queue",
    f"""WITH {SUFFIX}, chosen AS (SELECT word FROM stop WHERE n IN (5, 6) AND rank <= 10),
    best AS (SELECT s.word, arg_min(c.word, (-length(c.word), c.word)) AS parent FROM stop s JOIN chosen c
      ON length(c.word) < length(s.word) AND suffix(s.word, c.word) WHERE s.word NOT IN (SELECT word FROM chosen) GROUP BY s.word)
    SELECT n, rank, word, cnt, word IN (SELECT word FROM chosen) AS checked, parent IS NOT NULL AS covered, parent, {_LINK} AS link
    FROM stop LEFT JOIN best USING (word)""",
)
def word_queue(spark, sf):
    ranked = checkpointed(base.suffix_top(spark, sf).withColumn("n", F.col("n").cast("bigint")))
    return review.word_queue(ranked, ranked.where("n in (5, 6) and rank <= 10"))


@query(
    "h6_verified",
    f"""WITH {JUDGED}, {DECIDED} SELECT id, label, coalesce(decision, is_score, FALSE) AS is_score, reason AS llm_reason,
      decision IS NOT NULL AS verified_by_human FROM judged LEFT JOIN decided USING (id)""",
)
def verified(spark, sf):
    return review.verified(base.judged(spark, sf), review.last_decisions(base.decision_log(spark, sf)))


def _cascade_sql(wanted: str) -> str:
    return f"""{REC}, {DECIDED},
    split AS (SELECT id, text, title, {base.sql_first_hit('title', base.DROP)} AS ng, {base.sql_first_hit('title', ['ment', '@'])} AS ok FROM rec
      WHERE len(list_filter({base.sql_list(['thaner', 'osja'])}, lambda w: contains(title, w))) = 0 AND {wanted}),
    gray AS (SELECT id, text, title FROM split WHERE ng IS NULL AND ok IS NULL),
    asked AS (SELECT id, title AS label, {_asked_sql('title')} FROM gray)"""


def cascade_result(spark, sf, wanted=None):
    rows = base.parsed(spark, sf).select(t.record_id("rec").alias("id"), "raw", "rec")
    decisions = review.last_decisions(base.decision_log(spark, sf))
    scorer = judge.keyword_scorer(YES, NO)
    return curation.curate(rows, ["thaner", "osja"], base.DROP, ["ment", "@"], scorer, decisions, wanted=wanted)


def _of_class():
    return t.in_class("rec", "http://data.example/keyword/src7", "e")


_SPLIT_SQL = """SELECT id, CASE WHEN ng IS NOT NULL THEN 'ng' WHEN ok IS NOT NULL THEN 'ok' ELSE 'gray' END AS verdict,
      coalesce('NG: ' || ng, 'OK: ' || ok) AS reason FROM split"""
_SAMPLE_SQL = "SELECT id, label, judgment, reason FROM asked ORDER BY md5(id || '#0'), id LIMIT 300"
_FINAL_SQL = """SELECT id, label, coalesce(decision, judgment, FALSE) AS is_score, reason AS llm_reason,
      decision IS NOT NULL AS verified_by_human FROM asked LEFT JOIN decided USING (id)"""
_DROPS = f"""SELECT word FROM ({filters.NOISE_SQL} FROM (SELECT DISTINCT word FROM stop)) WHERE noise IS NOT NULL
    UNION SELECT unnest(['系図', '系譜'])"""
_WHOLE = _cascade_sql("TRUE")
_CLASS = _cascade_sql("((coalesce(quality, 2) = 1 AND source = 'src7') OR (toxic IS NOT NULL AND contains(text, 'e')))")


@query("h7_split", f"WITH {_WHOLE} {_SPLIT_SQL}")
def cascade_split(spark, sf):
    return cascade_result(spark, sf).split.select("id", "verdict", "reason")


@query("h7_class_split", f"WITH {_CLASS} {_SPLIT_SQL}")
def class_split(spark, sf):
    return cascade_result(spark, sf, _of_class()).split.select("id", "verdict", "reason")


@query("h7_sample", f"WITH {_WHOLE} {_SAMPLE_SQL}", text=("judgment",))
def cascade_sample(spark, sf):
    """300 of the undecided rows, of which there are more."""
    return cascade_result(spark, sf).sample


@query("h7_cascade", f"WITH {_WHOLE} {_FINAL_SQL}")
def cascade(spark, sf):
    return cascade_result(spark, sf).final


@query("h7_class_cascade", f"WITH {_CLASS} {_FINAL_SQL}")
def class_cascade(spark, sf):
    """Records of one class only."""
    return cascade_result(spark, sf, _of_class()).final


_MINED = f"""{SUFFIX}, {REC}, drops AS ({_DROPS}),
    split AS (SELECT id, title, (SELECT min(word) FROM drops WHERE contains(title, word)) AS ng, {base.sql_first_hit('title', ['ment', '@'])} AS ok FROM rec
      WHERE len(list_filter({base.sql_list(['thaner', 'osja'])}, lambda w: contains(title, w))) = 0)"""


@query("h7_mined_split", f"WITH {_MINED} {_SPLIT_SQL}")
def mined_split(spark, sf):
    """The cascade with the drop list that its own titles give: compounds, endings, noise heuristic, split."""
    rows = base.parsed(spark, sf).select(F.col("doc_id").alias("ord"), t.record_id("rec").alias("id"), "raw", "rec")
    decisions = review.last_decisions(base.decision_log(spark, sf))
    heuristic = {"noise": base.NOISE, "safe": base.SAFE, "exceptions": base.EXCUSED}
    mined = curation.mine_and_curate(
        rows, ["thaner", "osja"], ["ment", "@"], judge.keyword_scorer(YES, NO), decisions, sizes=base.SIZES, k=100, run=base.RUN, end=base.END, heuristic=heuristic
    )
    return mined.curation.split.select("id", "verdict", "reason")
