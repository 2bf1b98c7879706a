"""Tables as curation inputs: titles, records, vocabulary, triples, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fumikura.functions.variants import json_string
from fumikura.operators import mine
from fumikura.operators.scale import spread
from fumikura.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a query and, if SQL can say it, its expected result.

    Columns named in ``text``, true, false or unknown, are given as text.
    """

    def register(fn):
        QUERIES[name] = fn
        if text:
            QUERIES[name] = lambda spark, sf: fn(spark, sf).withColumns({c: F.col(c).cast("string") for c in text})
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if text else sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


# -- word lists used by the filters; order is deliberate ------------------------
DROP = ["ouble", "oublean", "License", "%%%", "worthless", "tionon"]
KEEP = ["keit", "ción", "@", "License", "ment"]
NOISE = ["asción", "ouble", "titi", "êe", "keitver", "ver"]
SAFE = ["keit", "pertion", "ertion", "retion"]
EXCUSED = (("titi", "tition"), ("ver", "verer"))

# -- letters and ending that stand in for the Japanese compound pattern ---------
RUN, END = "[A-Za-zÀ-ɏ]+", "tion"
SIZES = (5, 6, 7, 8, 9)
ROOT = 6


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_first_hit(text: str, words: list[str]) -> str:
    """List-order first hit in SQL, written over the list rather than as CASE."""
    return f"list_filter({sql_list(words)}, lambda w: contains({text}, w))[1]"


# -- titles: every document, its whole text -------------------------------------


def titles(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("title"))


def ids_titles(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))


# -- records: JSON lines of dynamic shape, with noise lines in between ----------
# lang decides where the title stands, labels decide the shape of the subject.


def record_lines(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    text, source, lang = json_string("text"), json_string("source"), F.col("lang")
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    subject = json_string(F.concat(F.lit("http://data.example/keyword/"), F.col("source")))
    tongue = json_string(F.concat(F.lit("http://data.example/lang/"), lang))
    key = F.when(lang == "en", "@id").when(lang == "fr", "id").when(lang == "de", "uri").otherwise("url")

    def pair(field: str, value) -> F.Column:
        return F.concat(F.lit(f'"{field}":'), value)

    def listed(*values):
        return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))

    parts = [
        F.concat(F.lit('"'), key, F.lit('":'), json_string(name)),
        pair(
            "rdfs:label",
            F.when(lang == "en", text).when(lang == "fr", F.lit('""')).when(lang == "de", listed(text, source)),
        ),
        pair("schema:name", F.when(lang.isin("fr", "es"), text)),
        pair(
            "schema:about",
            F.when(F.col("quality") == 1, subject)
            .when(F.col("quality") == 0, listed(subject, tongue))
            .otherwise(F.concat(F.lit('{"@id":'), subject, F.lit("}"))),
        ),
        pair("schema:description", F.when(F.col("toxic") == 1, listed(text, source)).when(F.col("toxic") == 0, text)),
    ]
    return docs.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("raw"))


def all_lines(spark, sf) -> DataFrame:
    """Records, prose (no JSON), bare numbers (no object), small objects."""
    prose = table(spark, sf, "benchmark").select(F.regexp_replace("text", "\n", " ").alias("raw"))
    numbers = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("raw"))
    objects = table(spark, sf, "events").select(F.col("props").alias("raw"))
    lines = record_lines(spark, sf).select("raw")
    return lines.unionAll(prose).unionAll(numbers).unionAll(objects)


def parsed(spark, sf) -> DataFrame:
    """<doc_id, raw, rec> of the document records."""
    return records.parse_records(record_lines(spark, sf))


REC = """rec AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
    CASE d.lang WHEN 'de' THEN '[' || to_json(d.text) || ',' || to_json(d.source) || ']' ELSE d.text END AS title,
    'http://data.example/keyword/' || d.source AS subject,
    'http://data.example/lang/' || d.lang AS tongue,
    'doc/' || d.doc_id AS id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


# -- grams ----------------------------------------------------------------------
GRAMS = r"""chars AS (
  SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(0, length(t))) AS i
  FROM (SELECT doc_id, regexp_replace(text, '[ 　()（）\[\]「」『』.,]', '', 'g') AS t FROM documents)),
win AS (
  SELECT doc_id, i, c AS c1, lead(c, 1) OVER w AS c2, lead(c, 2) OVER w AS c3, lead(c, 3) OVER w AS c4,
    lead(c, 4) OVER w AS c5
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (
  SELECT * FROM (
    SELECT 2 AS n, c1 || c2 AS gram, doc_id, i FROM win
    UNION ALL SELECT 3, c1 || c2 || c3, doc_id, i FROM win
    UNION ALL SELECT 4, c1 || c2 || c3 || c4, doc_id, i FROM win
    UNION ALL SELECT 5, c1 || c2 || c3 || c4 || c5, doc_id, i FROM win)
  WHERE gram IS NOT NULL),
gcount AS (
  SELECT CAST(n AS BIGINT) AS n, gram, count(*) AS cnt, min(doc_id * 16777216 + i) AS first_pos
  FROM grams GROUP BY n, gram),
gtop AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, first_pos, gram) AS rank FROM gcount)
  WHERE rank <= 200)"""


def gram_counts(spark, sf) -> DataFrame:
    return mine.gram_counts(titles(spark, sf))


def top_grams(spark, sf) -> DataFrame:
    return mine.frequent_grams(titles(spark, sf))


# -- compound vocabulary ----------------------------------------------------------


def vocabulary(spark, sf) -> DataFrame:
    return mine.compound_counts(titles(spark, sf), RUN, END)


VOCAB = f"""found AS (
  SELECT doc_id, unnest(m) AS word, unnest(range(0, len(m))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '({RUN}{END})', 1) AS m FROM documents)),
vocab AS (
  SELECT word, count(*) AS cnt, min(doc_id * 16777216 + i) AS first_pos FROM found GROUP BY word)"""

SUFFIX = VOCAB + f""",
suffix AS (
  SELECT n, right(word, n) AS word, sum(cnt) AS cnt, min(first_pos) AS first_pos
  FROM vocab, (SELECT unnest({list(SIZES)}) AS n) WHERE length(word) >= n GROUP BY n, right(word, n)),
stop AS (
  SELECT * FROM (
    SELECT CAST(n AS BIGINT) AS n, word, CAST(cnt AS BIGINT) AS cnt,
      row_number() OVER (PARTITION BY n ORDER BY cnt DESC, first_pos, word) AS rank FROM suffix)
  WHERE rank <= 100)"""


def suffix_top(spark, sf) -> DataFrame:
    return mine.suffix_ranking(vocabulary(spark, sf), SIZES)


# -- subjects ---------------------------------------------------------------------
SUBJECTS = REC + """,
about AS (
  SELECT subject AS word FROM rec UNION ALL SELECT tongue FROM rec WHERE quality = 0),
subjects AS (SELECT word, count(*) AS cnt FROM about GROUP BY word)"""


# -- judgments and decisions --------------------------------------------------------


def judged(spark, sf) -> DataFrame:
    """<id, label, judgment, reason>; unlabelled documents are unknown."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"),
        F.concat_ws(" ", "source", "lang").alias("label"),
        (F.col("quality") == 1).alias("judgment"),
        F.when(F.col("toxic") == 1, F.lit("Élan toxic")).otherwise(F.col("lang")).alias("reason"),
    )


JUDGED = """judged AS (
  SELECT 'doc/' || d.doc_id AS id, d.source || ' ' || d.lang AS label, l.quality = 1 AS is_score,
    CASE WHEN l.toxic = 1 THEN 'Élan toxic' ELSE d.lang END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def decision_log(spark, sf) -> DataFrame:
    """<id, seq, decision> from the event stream: clicks of reviewers."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("doc/"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_id").alias("seq"),
        (F.col("value") > 20).alias("decision"),
    )


DECIDED = """decided AS (
  SELECT 'doc/' || user_id AS id, arg_max(value > 20, event_id) AS decision FROM events GROUP BY user_id)"""


def action_log(spark, sf) -> DataFrame:
    """<word, seq, action>: one reviewed word per user, one action per event."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "TOGGLE_NG")
        .when(kind == "view", "TOGGLE_OK")
        .when(kind == "signup", "NG")
        .when(kind == "purchase", "OK")
        .otherwise("RESET")
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("word"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
    )


FOLDED = """folded AS (
  SELECT word, list_reduce(list_prepend('-', list(action ORDER BY seq)), lambda s, a:
    CASE a WHEN 'NG' THEN 'NG' WHEN 'OK' THEN 'OK' WHEN 'RESET' THEN '-'
      WHEN 'TOGGLE_NG' THEN CASE s WHEN 'NG' THEN '-' ELSE 'NG' END
      ELSE CASE s WHEN 'OK' THEN '-' ELSE 'OK' END END) AS state
  FROM (SELECT 'w' || user_id AS word, event_id AS seq,
      CASE event_type WHEN 'click' THEN 'TOGGLE_NG' WHEN 'view' THEN 'TOGGLE_OK' WHEN 'signup' THEN 'NG'
        WHEN 'purchase' THEN 'OK' ELSE 'RESET' END AS action FROM events)
  GROUP BY word)"""


# -- triples ------------------------------------------------------------------------
# <table, ord offset, rows of (subject, predicate, object)>; the expressions are
# plain SQL that both engines read.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SCHEMA = "http://schema.org/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
HOME = "http://data.example/"

_C = f"'{HOME}customer/' || CAST(c_custkey AS STRING)"
_S = f"'{HOME}supplier/' || CAST(s_suppkey AS STRING)"
_N = f"'{HOME}nation/' || CAST(n_nationkey AS STRING)"
_R = f"'{HOME}region/' || CAST(r_regionkey AS STRING)"
_BAL = "'_:bal' || CAST(c_custkey AS STRING)"

FACTS = [
    ("customer", "c_custkey", 1, [
        (_C, RDF_TYPE, f"'{HOME}type/customer'"),
        (_C, LABEL, "c_name"),
        (_C, SCHEMA + "name", "lower(c_name)"),
        (_C, SCHEMA + "about", f"'{HOME}segment#' || c_mktsegment"),
        (_C, SCHEMA + "description", "c_mktsegment || ' buyer'"),
        (_C, SCHEMA + "location", f"{_C} || '#addr'"),
        (_C, SCHEMA + "price", _BAL),
        (_C, SKOS + "related", f"'{HOME}customer/' || CAST(c_custkey * 10 AS STRING)"),
        (_C, SKOS + "related", f"'{HOME}supplier/' || CAST(c_nationkey AS STRING)"),
        (f"{_C} || '#addr'", SCHEMA + "addressCountry", f"'{HOME}nation/' || CAST(c_nationkey AS STRING)"),
        (f"{_C} || '#addr'", SCHEMA + "geo", f"{_C} || '#addr/geo'"),
        (f"{_C} || '#addr/geo'", LABEL, "'Geo of ' || c_name"),
        (f"{_C} || '#addr/geo'", SKOS + "broader", f"{_C} || '#addr'"),
        (f"{_C} || '#addr/geo'", SKOS + "related", _C),
        (_BAL, SCHEMA + "value", "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING)"),
    ]),
    ("supplier", "s_suppkey", 2, [
        (_S, RDF_TYPE, f"'{HOME}type/supplier'"),
        (_S, LABEL, "s_name"),
        (_S, SCHEMA + "location", f"'{HOME}nation/' || CAST(s_nationkey AS STRING)"),
    ]),
    ("nation", "n_nationkey", 3, [
        (_N, RDF_TYPE, f"'{HOME}type/nation'"),
        (_N, LABEL, "n_name"),
        (_N, SCHEMA + "isPartOf", f"'{HOME}region/' || CAST(n_regionkey AS STRING)"),
    ]),
    ("region", "r_regionkey", 4, [
        (_R, RDF_TYPE, f"'{HOME}type/region'"),
        (_R, LABEL, "r_name"),
    ]),
]


def _ord(key: str, no: int, k: int) -> str:
    return f"CAST({no} AS BIGINT) * 1000000000000000 + CAST({key} AS BIGINT) * 16 + {k}"


def triples(spark, sf) -> DataFrame:
    """All facts, one scan per table: <s, p, o, ord>."""
    out = None
    for name, key, no, facts in FACTS:
        rows = ", ".join(
            f"named_struct('s', {s}, 'p', '{p}', 'o', {o}, 'ord', {_ord(key, no, k)})"
            for k, (s, p, o) in enumerate(facts)
        )
        part = spread(table(spark, sf, name), key).selectExpr(f"inline(array({rows}))")
        out = part if out is None else out.unionAll(part)
    return out


TRIPLES = "triples AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {_ord(key, no, k)} AS ord FROM {name}"
    for name, key, no, facts in FACTS
    for k, (s, p, o) in enumerate(facts)
) + ")"


def root_list(spark, sf) -> DataFrame:
    """<uri>: every customer that ever ordered, and every part, which has no triples."""
    buyers = spread(table(spark, sf, "orders").select("o_custkey"), "o_custkey").select(
        F.concat(F.lit(HOME + "customer/"), F.col("o_custkey").cast("string")).alias("uri")
    )
    missing = table(spark, sf, "part").select(
        F.concat(F.lit(HOME + "part/"), F.col("p_partkey").cast("string")).alias("uri")
    )
    return buyers.unionAll(missing).distinct()


ROOTS = f"""roots AS (
  SELECT '{HOME}customer/' || o_custkey AS uri FROM orders
  UNION SELECT '{HOME}part/' || p_partkey FROM part)"""
