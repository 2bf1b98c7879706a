"""Queries of the operators of this subpackage over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, in at least as many partitions as there are cores.

    A small table can be one file that Spark does not split; its rows are
    dealt out anew then.
    """
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query(
    "op5_decontamination",
    rf"""WITH items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
    docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    runs AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
    found AS (SELECT doc_id, i, k, item_id FROM runs JOIN windows USING (k, gram)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (
      SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .decontam import find_overlap

    found = find_overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_bpe_codec")
def op10_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf, "documents"), vocabulary(), ids=False)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf, "documents")).drop("spans")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .secrets import scan_secrets, spelled

    found = scan_secrets(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled("strong"), 256).alias("base_sha256"),
        spelled("found").alias("spans"),
    )


@query(
    "op4_jaccard_join",
    rf"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)])) END AS s FROM docs),
    classes AS (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
    grams AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
    links AS (SELECT a.c AS x, b.c AS y FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
      HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    steps AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT c, c AS r FROM classes UNION SELECT steps.x, reach.r FROM reach JOIN steps ON reach.c = steps.y),
    least AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
    SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.r, doc_id) AS component_id
    FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN least USING (c)""",
)
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard import similarity_join

    members, _ = similarity_join(table(spark, sf, "documents"), 3, 90)
    return members.select("doc_id", "n_shingles", "component_id")


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query(
    "op9_line_dedup",
    r"""WITH lines AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(1)),
      '([.!?])([ \t\r\f\v]+)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents),
    pieces AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines),
    placed AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) - length(line) AS begin FROM pieces),
    units AS (SELECT doc_id, i, CAST(begin AS BIGINT) + length(line) - length(regexp_replace(line, '^\s+', '')) AS start,
      CAST(begin AS BIGINT) + length(regexp_replace(line, '\s+$', '')) AS stop, [x for x in string_split_regex(lower(line), '\s+') if x <> ''] AS w FROM placed),
    ranked AS (SELECT *, row_number() OVER u AS k, first_value(doc_id) OVER u AS kept_in FROM units WHERE len(w) >= 6 WINDOW u AS (PARTITION BY w ORDER BY doc_id, i)),
    gone AS (SELECT doc_id, count(*) AS n_removed, CAST(sum(len(w)) AS BIGINT) AS removed_words,
      string_agg(start || ':' || stop || ':' || kept_in, ',' ORDER BY i) AS removed_spans FROM ranked WHERE k > 1 GROUP BY doc_id)
    SELECT doc_id, n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words, coalesce(removed_spans, '') AS removed_spans
    FROM (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_units FROM units GROUP BY doc_id) LEFT JOIN gone USING (doc_id)""",
)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _repeats(spark, sf, "sentence")


@query("op9_nested_dedup")
def op9_nested_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as in op9_line_dedup, and besides whole lines and paragraphs, however short their sentences."""
    return _repeats(spark, sf, "nested")


def _repeats(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    from .lines import find_repeats

    found = find_repeats(table(spark, sf, "documents"), unit)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"], s["kept_in"])), ",")
    return found.select("doc_id", "n_units", "n_removed", "removed_words", spans.alias("removed_spans"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from .token_counts import edited_counts

    return edited_counts(table(spark, sf, "documents"), vocabulary())


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf, "documents"))[0]


#: Rules that the query applies: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query(
    "op13_url_filter",
    r"""WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    rests AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    urls AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    best AS (SELECT k, arg_max(rules.host || rules.path, length(rules.host) + length(rules.path)) AS rule, arg_max(verdict, length(rules.host) + length(rules.path)) AS verdict
      FROM urls JOIN rules ON (urls.host = rules.host OR ends_with(urls.host, '.' || rules.host)) AND starts_with(urls.path, rules.path) GROUP BY k)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (k)""",
)
def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    from .urls import judge_urls, rule_table

    return judge_urls(table(spark, sf, "pages"), rule_table(spark, URL_RULES))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


@query("op11_spelling_groups")
def op11_spelling_groups(spark: SparkSession, sf: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf, "documents"))
