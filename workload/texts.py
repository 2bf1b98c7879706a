"""Scalar functions over whole records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import replies, titles as t, uris, words as w
from fumikura.operators import graph, judge, match, mine, review

from . import base
from .base import GRAMS, JUDGED, REC, TRIPLES, VOCAB, query, table


@query("b1_title", f"WITH {REC} SELECT doc_id, title FROM rec")
def title(spark, sf):
    return base.parsed(spark, sf).select("doc_id", t.title("rec").alias("title"))


@query("b2_title_list", "SELECT doc_id, text AS title FROM documents")
def title_list(spark, sf):
    return base.parsed(spark, sf).select("doc_id", t.title_of_list("rec").alias("title"))


@query(
    "b3_search_text",
    f"""WITH {REC} SELECT doc_id, title || ' ||| ' || CASE quality
      WHEN 1 THEN '"' || subject || '"' WHEN 0 THEN '["' || subject || '","' || tongue || '"]'
      ELSE '{{"@id":"' || subject || '"}}' END AS body FROM rec""",
)
def search_text(spark, sf):
    return base.parsed(spark, sf).select("doc_id", t.search_text("rec", t.title("rec")).alias("body"))


@query("b4_id", "SELECT doc_id, 'doc/' || doc_id AS id FROM documents")
def record_id(spark, sf):
    rows = base.parsed(spark, sf).select("doc_id", t.record_id("rec").alias("id"))
    return rows.where(F.col("id") != "")


@query("b5_row_id", "SELECT 'row_' || (row_number() OVER (ORDER BY url) - 1) AS id, url FROM pages")
def row_id(spark, sf):
    return review.with_row_id(table(spark, sf, "pages").select("url"), [F.col("url")])


_PAGE_PREFIXES = (("http://", "web:"), ("https://m.", "mobile:"), ("https://blog.", "blog:"), ("https://", "safe:"))


@query(
    "b6_prefix",
    """SELECT page_id, CASE WHEN url LIKE 'http://%' THEN replace(url, 'http://', 'web:')
      WHEN url LIKE 'https://m.%' THEN replace(url, 'https://m.', 'mobile:')
      WHEN url LIKE 'https://blog.%' THEN replace(url, 'https://blog.', 'blog:')
      WHEN url LIKE 'https://%' THEN replace(url, 'https://', 'safe:') ELSE url END AS name FROM pages""",
)
def prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", uris.shorten("url", _PAGE_PREFIXES).alias("name"))


@query(
    "b7_b8_grams",
    f"""WITH {GRAMS},
    listed AS (SELECT doc_id, CAST(n AS BIGINT) AS n, count(*) AS grams, md5(string_agg(gram, '|' ORDER BY i)) AS digest
      FROM grams GROUP BY doc_id, n),
    all_sizes AS (SELECT doc_id, unnest([2, 3, 4, 5]) AS n FROM documents)
    SELECT doc_id, CAST(a.n AS BIGINT) AS n, coalesce(grams, 0) AS grams, coalesce(digest, md5('')) AS digest
    FROM all_sizes a LEFT JOIN listed USING (doc_id, n)""",
)
def grams(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", w.drop_symbols("text").alias("t"))
    sizes = [F.struct(F.lit(n).cast("bigint").alias("n"), w.ngrams("t", n).alias("g")) for n in (2, 3, 4, 5)]
    flat = rows.select("doc_id", F.inline(F.array(*sizes)))
    return flat.select(
        "doc_id", "n", F.size("g").cast("bigint").alias("grams"), F.md5(F.array_join("g", "|")).alias("digest")
    )


@query(
    "b9_compounds",
    f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '({base.RUN}{base.END})', 1), '|') AS words
    FROM documents""",
)
def compounds(spark, sf):
    found = w.compounds("text", base.RUN, base.END)
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, "|").alias("words"))


@query(
    "b10_suffixes",
    f"""WITH {VOCAB} SELECT word, CAST(n AS BIGINT) AS n, right(word, n) AS suffix
    FROM vocab, (SELECT unnest({list(base.SIZES)}) AS n) WHERE length(word) >= n""",
)
def suffixes(spark, sf):
    rows = mine.suffixes(base.vocabulary(spark, sf).select("word"), base.SIZES)
    return rows.select("word", F.col("n").cast("bigint"), "suffix")


@query(
    "b12_reason",
    f"""SELECT doc_id, '{{"doc_id":' || doc_id || ',"source":"' || source || '"' ||
      coalesce(', "_removed_reason":"' || {base.sql_first_hit('text', base.DROP)} || '"', '') || '}}' AS line
    FROM documents""",
)
def reason(spark, sf):
    docs = table(spark, sf, "documents")
    raw = F.to_json(F.struct("doc_id", "source"))
    hit = match.first_hit("text", base.DROP)
    return docs.select("doc_id", match.annotate(raw, _removed_reason=hit).alias("line"))


_P = replies.PROMPT.replace("'", "''")


@query(
    "b13_prompt",
    f"""WITH {REC}, v AS (SELECT doc_id, title, CASE toxic WHEN 0 THEN text
        WHEN 1 THEN '[' || to_json(text) || ',' || to_json(source) || ']' ELSE '' END AS notes FROM rec)
    SELECT doc_id, split_part('{_P}', '{{title}}', 1) || title || split_part(split_part('{_P}', '{{title}}', 2), '{{label}}', 1)
      || title || split_part(split_part('{_P}', '{{label}}', 2), '{{description}}', 1) || notes
      || split_part('{_P}', '{{description}}', 2) AS prompt FROM v""",
)
def prompt(spark, sf):
    name = t.title("rec", default="No Title")
    return base.parsed(spark, sf).select(
        "doc_id", replies.prompt(name, name, t.description("rec")).alias("prompt")
    )


def _replies(spark, sf):
    """Four kinds of reply, by language: JSON, JSON in prose, braces, prose."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "false").otherwise("null")
    good = F.concat(F.lit('{"is_score": '), verdict, F.lit(', "reason": "from '), F.col("source"), F.lit('"}'))
    lang = F.col("lang")
    reply = (
        F.when(lang == "en", good)
        .when(lang == "fr", F.concat("text", F.lit("\nAnswer: "), good, F.lit("\nDone")))
        .when(lang == "de", F.concat(F.lit("{ "), F.col("text"), F.lit(" }")))
        .otherwise(F.col("text"))
    )
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("label"),
        reply.alias("reply"),
        F.lit(None).cast("string").alias("error"),
    )


@query(
    "b14_reply_parse",
    f"""WITH {REC} SELECT id, source AS label, CASE WHEN lang IN ('en', 'fr') THEN quality = 1 END AS judgment,
      CASE WHEN lang IN ('en', 'fr') THEN 'from ' || source WHEN lang = 'de'
        THEN 'API Error: braced block is not JSON' ELSE 'JSON Parse Error' END AS reason FROM rec""",
    text=("judgment",),
)
def reply_parse(spark, sf):
    return judge.judgments(_replies(spark, sf))


@query(
    "b15_reply_cols",
    """SELECT event_id, TRUE AS judgment, '' AS reason, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def reply_cols(spark, sf):
    """Replies without a reason: event properties with a verdict put in."""
    rows = table(spark, sf, "events").select(
        "event_id", match.annotate("props", is_score=F.lit(True)).alias("reply")
    )
    parsed = rows.withColumn("v", replies.parsed_reply("reply"))
    return parsed.select(
        "event_id",
        replies.reply_verdict(F.col("v")).alias("judgment"),
        replies.reply_reason(F.col("v")).alias("reason"),
        F.try_variant_get("v", "$.k", "bigint").alias("k"),
    )


@query("b16_rename", f"WITH {JUDGED} SELECT id, label, is_score, reason FROM judged", text=("is_score",))
def rename(spark, sf):
    return review.unify_columns(base.judged(spark, sf).withColumnRenamed("reason", "thought"))


@query(
    "b17_final_cast",
    f"""WITH {JUDGED}, {base.DECIDED}
    SELECT id, coalesce(decision, is_score, FALSE) AS is_score, decision IS NOT NULL AS by_hand FROM judged LEFT JOIN decided USING (id)""",
)
def final_cast(spark, sf):
    """Override, then cast: what nobody decided and no verdict tells is false."""
    done = review.verified(base.judged(spark, sf), review.last_decisions(base.decision_log(spark, sf)))
    return done.select("id", "is_score", F.col("verified_by_human").alias("by_hand"))


@query(
    "b18_collapse",
    f"""WITH {TRIPLES}, listed AS (SELECT s, p, list(o ORDER BY ord) AS v FROM triples GROUP BY s, p)
    SELECT s, p, CASE WHEN len(v) = 1 THEN CAST(to_json(v[1]) AS VARCHAR) ELSE CAST(to_json(v) AS VARCHAR) END AS val
    FROM listed""",
)
def collapse(spark, sf):
    return graph.grouped_objects(base.triples(spark, sf)).select("s", "p", graph.collapsed("objects", "total").alias("val"))


@query(
    "b19_label",
    f"""WITH {VOCAB} SELECT word, CASE WHEN length(word) > 15 THEN left(word, 15) || '..' ELSE word END AS label FROM vocab
    UNION ALL SELECT url, CASE WHEN length(url) > 30 THEN '...' || right(url, 25) ELSE url END FROM pages""",
)
def label(spark, sf):
    words = base.vocabulary(spark, sf).select("word", w.short_label("word").alias("label"))
    return words.unionAll(table(spark, sf, "pages").select("url", w.short_uri_label("url")))


@query(
    "b20_link",
    f"""WITH {VOCAB} SELECT word, 'https://www.google.com/search?q=' || replace(url_encode(word || ' とは'), '%2F', '/') AS link
    FROM vocab UNION ALL SELECT url, url FROM pages""",
)
def link(spark, sf):
    words = base.vocabulary(spark, sf).select("word").unionAll(table(spark, sf, "pages").select("url"))
    return words.select("word", w.lookup_link("word").alias("link"))


@query(
    "b21_comma_list",
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS words FROM documents""",
)
def comma_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(w.comma_words("text"), "|").alias("words"))


@query(
    "b22_percent",
    """SELECT lang, cnt, (tenths // 10) || '.' || (tenths % 10) || '%' AS percent FROM (
      SELECT lang, count(*) AS cnt, (count(*) * 2000 + t) // (t * 2) AS tenths
      FROM documents, (SELECT count(*) AS t FROM documents) GROUP BY lang, t)""",
)
def percent(spark, sf):
    docs = table(spark, sf, "documents")
    total = docs.select(F.count("*")).scalar()
    return docs.groupBy("lang").agg(F.count("*").alias("cnt")).withColumn("percent", w.percent("cnt", total))
