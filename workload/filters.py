"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import titles as t, uris
from fumikura.operators import graph, judge, match, mine, review, search
from fumikura.operators.scale import pinned, with_dense_rank
from fumikura.session import scratch_path
from fumikura.sources import rankings, records
from fumikura.plans import curation, mining

from . import base, scans
from .base import HOME, JUDGED, LABEL, REC, SCHEMA, SUFFIX, SUBJECTS, TRIPLES, VOCAB, query, table

_SUBJECT = "http://data.example/keyword/src7"


@query(
    "c1_class",
    f"""WITH {REC} SELECT doc_id, (coalesce(quality, 2) = 1 AND source = 'src7')
      OR (toxic IS NOT NULL AND contains(text, 'ouble')) AS in_class FROM rec""",
)
def in_class(spark, sf):
    flag = t.in_class("rec", _SUBJECT, "ouble")
    return base.parsed(spark, sf).select("doc_id", flag.alias("in_class"))


@query("c2_first_hit", f"SELECT doc_id AS id, {base.sql_first_hit('text', base.DROP)} AS hit FROM documents")
def first_hit(spark, sf):
    return match.with_first_hit(base.ids_titles(spark, sf), base.DROP).select("id", "hit")


_LITERAL = "|".join(x.replace("|", r"\|") for x in base.DROP)


@query(
    "c3_leftmost",
    f"SELECT doc_id AS id, nullif(regexp_extract(text, '{_LITERAL}', 0), '') AS hit FROM documents",
)
def leftmost(spark, sf):
    return base.ids_titles(spark, sf).select("id", match.leftmost_hit("title", base.DROP).alias("hit"))


@query(
    "c4_keep_first",
    f"""WITH h AS (SELECT doc_id AS id, nullif(regexp_extract(text, '{"|".join(base.KEEP)}', 0), '') AS k,
        nullif(regexp_extract(text, '{_LITERAL}', 0), '') AS d FROM documents)
    SELECT id, CASE WHEN k IS NULL AND d IS NOT NULL THEN 'drop' ELSE 'keep' END AS verdict,
      CASE WHEN k IS NULL THEN 'NG Hit: ' || d END AS reason, k IS NOT NULL AND d IS NOT NULL AS rescued FROM h""",
)
def keep_first(spark, sf):
    verdict = match.keep_first_verdict("title", base.KEEP, base.DROP)
    return base.ids_titles(spark, sf).select("id", verdict.alias("v")).select("id", "v.*")


#: A list longer than the inline bound, with words of up to 110 characters; built from the benchmark texts.
LONG_WORDS = """words AS (SELECT DISTINCT w FROM (SELECT unnest([left(text, 110), substr(text, 7, 71), substr(text, 3, 9), right(text, 5)]) AS w FROM benchmark)
      WHERE length(w) >= 5 AND NOT contains(w, chr(10))),
    list AS (SELECT w, row_number() OVER (ORDER BY md5(w), w) - 1 AS ord FROM words)"""


def long_words(spark, sf):
    """The list <ord, word> as a frame."""
    texts = table(spark, sf, "benchmark")
    cuts = F.array(F.left("text", F.lit(110)), F.substring("text", 7, 71), F.substring("text", 3, 9), F.right("text", F.lit(5)))
    words = texts.select(F.explode(cuts).alias("word")).distinct().where("length(word) >= 5 and not contains(word, '\n')")
    return with_dense_rank(words, [F.md5("word"), F.asc("word")], "ord")


@query(
    "c5_long_list",
    f"""WITH {LONG_WORDS}, rows AS (SELECT text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 7 END AS id FROM documents),
    hits AS (SELECT t, arg_min(w, ord) AS hit FROM (SELECT DISTINCT text AS t FROM rows) JOIN list ON contains(t, w) GROUP BY t)
    SELECT id, md5(text) AS digest, CASE WHEN hit IS NULL THEN 'keep' ELSE 'drop' END AS verdict, hit AS reason FROM rows LEFT JOIN hits ON text = t""",
)
def long_list(spark, sf):
    """Hundreds of words, some over 65 characters; ids repeat or are missing."""
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.call_function("div", F.col("doc_id"), F.lit(7))).alias("id"), F.col("text").alias("title")
    )
    tagged = match.with_first_hit(rows, long_words(spark, sf))
    return tagged.select("id", F.md5("title").alias("digest"), match.drop_only_verdict("hit").alias("v")).select("id", "digest", "v.*")


@query(
    "c4_about",
    f"""WITH {REC}, {LONG_WORDS}, texts AS (SELECT doc_id, text || ' | ' || CASE WHEN quality = 1 THEN to_json(subject)
        WHEN quality = 0 THEN '[' || to_json(subject) || ',' || to_json(tongue) || ']' ELSE '{{"@id":' || to_json(subject) || '}}' END AS t FROM rec),
    places AS (SELECT doc_id, w, position(w IN t) AS pos, ord FROM texts JOIN list ON contains(t, w)),
    dropped AS (SELECT doc_id, arg_min(w, (pos, ord)) AS d FROM places GROUP BY doc_id),
    kept AS (SELECT doc_id, contains(t, 'src11') OR contains(t, 'ment') AS k FROM texts)
    SELECT doc_id, CASE WHEN NOT k AND d IS NOT NULL THEN 'drop' ELSE 'keep' END AS verdict,
      CASE WHEN NOT k THEN 'NG Hit: ' || d END AS reason, k AND d IS NOT NULL AS rescued FROM texts JOIN kept USING (doc_id) LEFT JOIN dropped USING (doc_id)""",
)
def keep_by_subject(spark, sf):
    """Keep and drop lists over title and subjects together, the drop list a long one."""
    rows = curation.keep_by_subject(base.parsed(spark, sf), ["src11", "ment"], long_words(spark, sf))
    return rows.select("doc_id", "verdict", "reason", "rescued")


_ABOUT_SQL = base.ORACLES["c4_about"]


@query(
    "c4_final_outputs",
    f"""SELECT CASE verdict WHEN 'keep' THEN 'kept' ELSE 'dropped' END AS output, 'doc/' || doc_id AS id, reason, lang || '|' || md5(text) AS line
    FROM ({_ABOUT_SQL}) JOIN documents USING (doc_id)
    UNION ALL SELECT 'counts', CAST(count_if(verdict = 'keep') AS VARCHAR), CAST(count_if(verdict = 'drop') AS VARCHAR),
      CAST(count_if(rescued) AS VARCHAR) FROM ({_ABOUT_SQL})""",
)
def final_outputs(spark, sf):
    """The final filter with both outputs and its counters; kept lines and the table of dropped ones are read back."""
    kept, dropped = scratch_path(spark, "kept"), scratch_path(spark, "dropped")
    counts = curation.final_filter(base.parsed(spark, sf), ["src11", "ment"], long_words(spark, sf), kept, dropped)
    rows = records.read_records(spark, kept)
    lang, text = _tongue_of("rec"), t.title_of_list("rec")
    stay = rows.select(F.lit("kept").alias("output"), t.record_id("rec").alias("id"), F.lit(None).cast("string").alias("reason"), F.concat_ws("|", lang, F.md5(text)).alias("line"))
    table_ = rankings.read_table(spark, dropped, multiline=True)
    ids = {key: F.nullif(F.col(f"`{key}`"), F.lit("")) for key in ("@id", "id", "uri", "url") if key in table_.columns}
    lang = F.coalesce(*[F.when(value.isNotNull(), F.lit(_TONGUES[key])) for key, value in ids.items()])
    label = F.nullif(F.col("`rdfs:label`"), F.lit(""))
    text = F.when(lang == "de", F.try_variant_get(F.try_parse_json(label), "$[0]", "string")).otherwise(F.coalesce(label, F.col("`schema:name`")))
    gone = table_.select(F.lit("dropped"), F.coalesce(*ids.values()), "exclusion_reason", F.concat_ws("|", lang, F.md5(text)))
    seen = [F.lit(str(counts[name])) for name in ("kept", "dropped", "rescued")]
    return stay.unionAll(gone).unionAll(spark.range(1).select(F.lit("counts"), *seen))


_TONGUES = {"@id": "en", "id": "fr", "uri": "de", "url": "es"}


def _tongue_of(rec: str):
    """The language that decided which key holds the id."""
    return F.coalesce(*[F.when(F.try_variant_get(rec, f"$['{key}']", "string").isNotNull(), F.lit(tongue)) for key, tongue in _TONGUES.items()])


@query(
    "c5_drop_only",
    f"""WITH h AS (SELECT doc_id AS id, {base.sql_first_hit('text', base.DROP)} AS hit FROM documents)
    SELECT id, CASE WHEN hit IS NULL THEN 'keep' ELSE 'drop' END AS verdict, hit AS reason FROM h""",
)
def drop_only(spark, sf):
    rows = match.with_first_hit(base.ids_titles(spark, sf), base.DROP)
    return rows.select("id", match.drop_only_verdict("hit").alias("v")).select("id", "v.*")


SPLIT = f"""hit AS (SELECT doc_id AS id, {base.sql_first_hit('text', base.DROP)} AS ng,
    {base.sql_first_hit('text', base.KEEP)} AS ok FROM documents),
split AS (SELECT id, CASE WHEN ng IS NOT NULL THEN 'ng' WHEN ok IS NOT NULL THEN 'ok' ELSE 'gray' END AS verdict,
    coalesce(ng, ok) AS word, coalesce('NG: ' || ng, 'OK: ' || ok) AS reason,
    CASE WHEN ng IS NULL AND ok IS NOT NULL THEN TRUE END AS is_score FROM hit)"""


def split(spark, sf):
    return match.split_three_ways(base.ids_titles(spark, sf), base.DROP, base.KEEP).drop("title")


@query("c6_split", f"WITH {SPLIT} SELECT id, verdict, word, reason, is_score FROM split", text=("is_score",))
def three_ways(spark, sf):
    return split(spark, sf)


@query("c7_nonempty", f"""WITH {REC} SELECT id, title FROM rec WHERE title <> ''""")
def nonempty(spark, sf):
    """Objects without a title fall out; only document records have one."""
    rows = records.parse_records(base.all_lines(spark, sf))
    named = pinned(rows, id=t.record_id("rec"), title=t.title("rec"))
    return named.select("id", "title").where(F.col("title") != "")


@query("c8_search", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('LICENSE'))")
def search_text(spark, sf):
    return table(spark, sf, "documents").where(search.holds_text("text", "LICENSE")).select("doc_id")


@query("c9_search_regex", f"WITH {VOCAB} SELECT word, cnt FROM vocab WHERE regexp_matches(word, '^(th|on).*er')")
def search_regex(spark, sf):
    return base.vocabulary(spark, sf).where(search.holds_pattern("word", "^(th|on).*er")).select("word", "cnt")


@query(
    "c10_search_any",
    f"WITH {JUDGED} SELECT id FROM judged WHERE regexp_matches(label, '(?i)SRC1 |élAN') OR regexp_matches(reason, '(?i)SRC1 |élAN')",
)
def search_any(spark, sf):
    rows = review.unify_columns(base.judged(spark, sf))
    return rows.where(search.any_holds_pattern(["label", "reason"], "SRC1 |élAN")).select("id")


@query("c11_uri_words", f"WITH {SUBJECTS} SELECT word, cnt, word LIKE 'http%' AS is_uri FROM subjects UNION ALL SELECT lang, count(*), FALSE FROM documents GROUP BY lang")
def uri_words(spark, sf):
    subjects = mine.subject_keywords(base.parsed(spark, sf)).unionAll(table(spark, sf, "documents").select("lang"))
    counted = subjects.groupBy("word").agg(F.count("*").alias("cnt"))
    return search.with_uri_flag(counted)


@query(
    "c12_tristate",
    f"""WITH {JUDGED} SELECT id, CASE WHEN is_score THEN 'true' WHEN NOT is_score THEN 'false' ELSE 'null' END AS picked
    FROM judged UNION ALL SELECT id, 'all' FROM judged""",
)
def tristate(spark, sf):
    rows = review.unify_columns(base.judged(spark, sf))
    out = None
    for name, wanted in (("true", True), ("false", False), ("null", None), ("all", "all")):
        part = search.by_verdict(rows, wanted).select("id", F.lit(name).alias("picked"))
        out = part if out is None else out.unionAll(part)
    return out


CODES = [f"{HOME}segment#BUILDING"]
CODE_PREFIX = f"{HOME}segment#MA"


@query(
    "c13_codes",
    f"""WITH {TRIPLES} SELECT s, o FROM triples WHERE p = '{SCHEMA}about'
      AND (o IN ('{CODES[0]}') OR o LIKE '{CODE_PREFIX}%')""",
)
def codes(spark, sf):
    test = graph.code_test(CODES, CODE_PREFIX)
    return base.triples(spark, sf).where((F.col("p") == SCHEMA + "about") & test(F.col("o"))).select("s", "o")


@query(
    "c14_regex",
    f"""WITH {TRIPLES} SELECT s, p, o FROM triples WHERE p IN ('{LABEL}', '{SCHEMA}name', '{SCHEMA}description')
      AND regexp_matches(o, '(?i)CUSTOMER#0*1[0-4]|auto.* BUYER|supplier')""",
)
def regex(spark, sf):
    test = graph.regex_test("CUSTOMER#0*1[0-4]|auto.* BUYER|supplier")
    fields = [LABEL, SCHEMA + "name", SCHEMA + "description"]
    return base.triples(spark, sf).where(F.col("p").isin(*fields) & test(F.col("o"))).select("s", "p", "o")


@query(
    "c15_subnode",
    f"""WITH {TRIPLES} SELECT s, p, o, (o LIKE '\\_:%' ESCAPE '\\' OR starts_with(o, s)) AS sub,
      (o LIKE '\\_:%' ESCAPE '\\' OR (starts_with(o, s) AND substr(o, length(s) + 1, 1) IN ('', '#', '/'))) AS strict
    FROM triples""",
)
def subnode(spark, sf):
    return base.triples(spark, sf).select(
        "s", "p", "o", uris.is_subnode("o", "s").alias("sub"), uris.is_subnode("o", "s", "[#/]").alias("strict")
    )


_STRUCK = base.sql_first_hit("word", base.NOISE)
NOISE_SQL = f"""SELECT word, CASE WHEN NOT (word IN ({', '.join(f"'{x}'" for x in base.SAFE)}) OR (len(list_filter(
      {base.sql_list(base.SAFE)}, lambda x: contains(word, x))) > 0 AND ({" OR ".join(
        f"({_STRUCK} = '{a}' AND contains(word, '{b}'))" for a, b in base.EXCUSED)}))) THEN {_STRUCK} END AS noise"""


@query("c16_noise", f"WITH {VOCAB} {NOISE_SQL} FROM vocab")
def noise(spark, sf):
    struck = match.noise_pattern("word", base.NOISE, base.SAFE, base.EXCUSED)
    return base.vocabulary(spark, sf).select("word", struck.alias("noise"))


@query("c17_first_lines", "SELECT event_id FROM events ORDER BY event_id LIMIT 4036")
def first_lines(spark, sf):
    """The judge's row limit over lines written in event order."""
    path = scratch_path(spark, "ordered")
    line = F.to_json(F.struct("event_id"))
    records.write_lines(table(spark, sf, "events").orderBy("event_id"), path, line)
    rows = records.parse_records(judge.first_lines(records.read_lines(spark, path)))
    return rows.select(F.try_variant_get("rec", "$.event_id", "bigint").alias("event_id"))


@query(
    "h2_list",
    f"""WITH {SUFFIX} SELECT word FROM ({NOISE_SQL} FROM (SELECT DISTINCT word FROM stop)) WHERE noise IS NOT NULL
    UNION SELECT unnest(['系図', '系譜'])""",
)
def drop_list(spark, sf):
    path = scratch_path(spark, "packed")
    rankings.write_csv(scans._packed(spark, sf), path, bom=True)
    return mining.drop_list_from_ranking(
        rankings.read_table(spark, path), noise=base.NOISE, safe=base.SAFE, exceptions=base.EXCUSED
    )


@query(
    "g3_manual",
    f"WITH {VOCAB} SELECT word FROM vocab WHERE contains(word, 'keit') OR contains(word, 'thtion') UNION SELECT unnest(['系図', '系譜'])",
)
def manual(spark, sf):
    return match.noise_words(base.vocabulary(spark, sf), noise=["keit", "thtion"], safe=[], exceptions=[])
