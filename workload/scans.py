"""Sources and sinks; files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import titles as t, words as w
from fumikura.functions.variants import field
from fumikura.operators import match, mine, review
from fumikura.operators.scale import pinned
from fumikura.session import scratch_path
from fumikura.sources import rankings, records, samples, triples as triple_files, wordlists

from . import base
from .base import GRAMS, JUDGED, REC, SUBJECTS, SUFFIX, TRIPLES, VOCAB, query, table


@query(
    "a1_jsonl_scan",
    f"""WITH {REC}
    SELECT id, CASE lang WHEN 'de' THEN text ELSE title END AS title FROM rec
    UNION ALL SELECT '', '' FROM events""",
)
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "lines")
    records.write_lines(base.all_lines(spark, sf), path)
    rows = records.read_records(spark, path)
    return rows.select(
        F.coalesce(t.record_id("rec"), F.lit("")).alias("id"), t.title_of_list("rec").alias("title")
    )


@query(
    "a2_scan_counts",
    """SELECT d + b + l + e AS lines, d + l + e AS parsed, d + e AS objects FROM
      (SELECT count(*) AS d FROM documents), (SELECT count(*) AS b FROM benchmark),
      (SELECT count(*) AS l FROM labels), (SELECT count(*) AS e FROM events)""",
)
def scan_counts(spark, sf):
    """Counted in the pass that writes the objects."""
    counts = records.write_objects(base.all_lines(spark, sf), scratch_path(spark, "objects"))
    return spark.createDataFrame([(counts["lines"], counts["parsed"], counts["objects"])], "lines bigint, parsed bigint, objects bigint")


@query("a3_header_alias", f"WITH {SUBJECTS} SELECT word, cnt FROM subjects")
def header_alias(spark, sf):
    path = scratch_path(spark, "ranking")
    ranked = mine.subject_ranking(base.parsed(spark, sf), k=None)
    rankings.write_csv(ranked.toDF(" Rank", " Keyword ", "Count"), path, bom=True)
    table_ = rankings.read_ranking(spark, path)
    return table_.select(F.col("Word").alias("word"), F.col("Count").alias("cnt"))


def _packed(spark, sf):
    return mine.packed_ranking(base.suffix_top(spark, sf), base.SIZES, 100)


@query("a4_unpack_ranking", f"WITH {SUFFIX} SELECT n, word, cnt FROM stop")
def unpack(spark, sf):
    path = scratch_path(spark, "packed")
    rankings.write_csv(_packed(spark, sf), path, quote_all=True)
    return rankings.read_packed_ranking(spark, path).select(F.col("n").cast("bigint"), "word", "cnt")


@query("a5_candidates", f"WITH {SUFFIX} SELECT DISTINCT word FROM stop")
def candidates(spark, sf):
    return rankings.candidate_words(_packed(spark, sf))


@query(
    "a6_word_list",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, source || ' ' || lang AS word
    FROM documents WHERE lang <> 'es'""",
)
def word_list(spark, sf):
    """Padded lines with ideographic blanks; every 'es' line is blank."""
    path = scratch_path(spark, "words")
    word = F.when(F.col("lang") != "es", F.concat_ws(" ", "source", "lang")).otherwise(F.lit(""))
    lines = table(spark, sf, "documents").orderBy("doc_id")
    records.write_lines(lines, path, F.concat(F.lit(" 　"), word, F.lit("　")))
    return wordlists.read_word_list(spark, path)


@query(
    "a7_samples_map",
    f"""WITH {GRAMS},
    held AS (SELECT DISTINCT g.n, g.gram, g.doc_id FROM grams g JOIN gtop t ON g.n = t.n AND g.gram = t.gram),
    digest AS (SELECT doc_id, md5(text) AS title FROM documents),
    firsts AS (SELECT CAST(n AS BIGINT) AS n, gram, title, min(doc_id) AS doc_id FROM held JOIN digest USING (doc_id) GROUP BY n, gram, title)
    SELECT n, gram AS word, place, title FROM (
      SELECT *, row_number() OVER (PARTITION BY n, gram ORDER BY doc_id) AS place FROM firsts)
    WHERE place <= 10""",
)
def samples_map(spark, sf):
    """All top grams with all their examples, written as one document and read back."""
    top = base.top_grams(spark, sf)
    shown = mine.samples_by_gram(mine.gram_examples(base.titles(spark, sf), top).withColumn("title", F.md5("title")))
    path = scratch_path(spark, "samples")
    samples.write_samples(shown.withColumnRenamed("gram", "word"), path)
    rows = samples.read_samples(spark, path)
    return rows.select("n", "word", F.posexplode("samples").alias("_i", "title")).select(
        F.col("n").cast("bigint"), "word", (F.col("_i") + 1).cast("bigint").alias("place"), "title"
    )


@query("a8_bindings", f"WITH {TRIPLES} SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY ord) - 1 AS pos FROM triples")
def bindings(spark, sf):
    """Saved result documents, one per subject with all its triples in arrival order, read back as triples."""
    term = lambda x, c: F.struct(x[c].alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "s", "p", "o")))
    docs = base.triples(spark, sf).groupBy("s").agg(listed.alias("rows"))
    every = F.transform("rows", lambda x: F.struct(term(x, "s").alias("s"), term(x, "p").alias("p"), term(x, "o").alias("o")))
    path = scratch_path(spark, "bindings")
    records.write_lines(docs, path, F.to_json(F.struct(F.struct(every.alias("bindings")).alias("results"))))
    rows = triple_files.read_binding_lines(spark, path)
    return rows.select("s", "p", "o", F.col("pos").cast("bigint").alias("pos"))


@query("a9_jsonl_out", f"WITH {JUDGED} SELECT id, label, is_score, reason FROM judged", text=("is_score",))
def jsonl_out(spark, sf):
    """Rows written as JSON objects, unknown values as null, and read back."""
    path = scratch_path(spark, "jsonl")
    records.write_jsonl(review.unify_columns(base.judged(spark, sf)), path)
    back = records.parse_records(records.read_lines(spark, path))
    text = lambda key: field("rec", key, "string").alias(key)
    return back.select(text("id"), text("label"), field("rec", "is_score", "boolean").alias("is_score"), text("reason"))


@query(
    "a11_csv_out",
    f"WITH {JUDGED} SELECT '\"' || replace(reason, '\"', '\"\"') || '\",\"' || id || '\",\"' || label || '\"' AS line FROM judged",
)
def csv_out(spark, sf):
    """Byte order mark, all values quoted, one column moved to the front; header lines have the mark."""
    path = scratch_path(spark, "quoted")
    rows = base.judged(spark, sf).select("id", "label", "reason")
    rankings.write_csv(rows, path, first=("reason",), quote_all=True, bom=True)
    lines = spark.read.text(path)
    # The text reader drops the mark again.
    return lines.where(F.ltrim(F.col("value"), F.lit("\ufeff")) != '"reason","id","label"').select(F.col("value").alias("line"))


@query(
    "a14_samples_out",
    """SELECT lang AS word, source AS title, row_number() OVER (PARTITION BY lang ORDER BY source) AS place
    FROM (SELECT DISTINCT lang, source FROM documents)""",
)
def samples_out(spark, sf):
    """A map of words to lists, written as one document per size and read back."""
    pairs = table(spark, sf, "documents").select("lang", "source").distinct()
    rows = pairs.groupBy(F.col("lang").alias("word")).agg(F.array_sort(F.collect_list("source")).alias("samples"))
    path = scratch_path(spark, "samples")
    samples.write_samples(rows.withColumn("n", F.lit(2)), path)
    back = samples.read_samples(spark, path)
    return back.select("word", F.posexplode("samples").alias("_i", "title")).select("word", "title", (F.col("_i") + 1).cast("bigint").alias("place"))


@query("a10_raw_keep", "SELECT props AS raw FROM events WHERE NOT contains(props, '7') AND NOT contains(props, '13')")
def raw_keep(spark, sf):
    """Rows without a drop word keep every byte of their line."""
    path = scratch_path(spark, "raw")
    records.write_lines(table(spark, sf, "events"), path, "props")
    rows = pinned(records.read_records(spark, path), title=t.title("rec", ("k",)))
    kept = rows.where(match.first_hit("title", ["7", "13"]).isNull())
    out = scratch_path(spark, "kept")
    records.write_lines(kept, out)
    return records.read_lines(spark, out).select("raw")


@query("a12_list_out", f"WITH {VOCAB} SELECT word FROM vocab WHERE cnt >= 2")
def list_out(spark, sf):
    path = scratch_path(spark, "list")
    wordlists.write_word_list(base.vocabulary(spark, sf).where("cnt >= 2"), path, one_file=False)
    return spark.read.text(path).select(F.col("value").alias("word"))


@query(
    "a13_verdict_parts",
    f"""WITH hit AS (SELECT 'doc/' || doc_id AS id, {base.sql_first_hit('text', base.DROP)} AS ng,
      {base.sql_first_hit('text', base.KEEP)} AS ok FROM documents)
    SELECT id, CASE WHEN ng IS NOT NULL THEN 'ng' WHEN ok IS NOT NULL THEN 'ok' ELSE 'gray' END AS verdict,
      coalesce('NG: ' || ng, 'OK: ' || ok) AS reason, CASE WHEN ng IS NULL AND ok IS NOT NULL THEN TRUE END AS is_score
    FROM hit""",
    text=("is_score",),
)
def verdict_parts(spark, sf):
    rows = pinned(base.parsed(spark, sf), title=t.title_of_list("rec"))
    back = _split_back(spark, rows, base.DROP, base.KEEP)
    return back.select(
        t.record_id("rec").alias("id"),
        "verdict",
        field("rec", "_filter_reason", "string").alias("reason"),
        field("rec", "is_score", "boolean").alias("is_score"),
    )


def _split_back(spark, rows, drop, keep):
    """Split records <raw, title>, write them by verdict and read them again."""
    split = match.split_three_ways(rows, drop, keep)
    path = scratch_path(spark, "split")
    line = match.verdict_line("raw", "reason", "is_score")
    records.write_by_verdict(split.withColumn("line", line), path, "line")
    return records.parse_records(spark.read.text(path).withColumnRenamed("value", "raw"))


@query(
    "a13_resplit",
    f"""WITH hit AS (SELECT 'doc/' || doc_id AS id, {base.sql_first_hit('text', base.DROP)} AS ng1, {base.sql_first_hit('text', base.KEEP)} AS ok1,
      {base.sql_first_hit('text', base.KEEP[:2])} AS ng2, {base.sql_first_hit('text', base.DROP[:3])} AS ok2 FROM documents),
    one AS (SELECT *, coalesce('NG: ' || ng1, 'OK: ' || ok1) AS r1, coalesce('NG: ' || ng2, 'OK: ' || ok2) AS r2 FROM hit)
    SELECT id, CASE WHEN ng2 IS NOT NULL THEN 'ng' WHEN ok2 IS NOT NULL THEN 'ok' ELSE 'gray' END AS verdict, coalesce(r2, r1) AS reason,
      CASE WHEN r2 IS NOT NULL THEN CASE WHEN ng2 IS NULL THEN TRUE END WHEN ng1 IS NULL AND ok1 IS NOT NULL THEN TRUE END AS is_score FROM one""",
    text=("is_score",),
)
def resplit(spark, sf):
    """The output of a split is split again: no record is lost, the last reason stands."""
    rows = pinned(base.parsed(spark, sf), title=t.title_of_list("rec"))
    once = _split_back(spark, rows, base.DROP, base.KEEP).drop("verdict")
    back = _split_back(spark, pinned(once, title=t.title_of_list("rec")), base.KEEP[:2], base.DROP[:3])
    return back.select(
        t.record_id("rec").alias("id"),
        "verdict",
        field("rec", "_filter_reason", "string").alias("reason"),
        field("rec", "is_score", "boolean").alias("is_score"),
    )


@query(
    "a15_list_json",
    f"""WITH {VOCAB} SELECT CAST(0 AS BIGINT) AS page,
      'NOISE_PATTERNS = ' || replace(CAST(to_json(list(word ORDER BY word)) AS VARCHAR), ',', ',' || chr(10) || '    ') AS code
    FROM vocab""",
)
def list_json(spark, sf):
    return wordlists.list_as_code(base.vocabulary(spark, sf), "NOISE_PATTERNS")


@query(
    "a15_paged",
    f"""WITH {VOCAB}, placed AS (SELECT word, (row_number() OVER (ORDER BY word) - 1) // 100 AS page FROM vocab)
    SELECT page, 'NOISE_PATTERNS' || CASE WHEN page = 0 THEN ' = ' ELSE ' += ' END
      || replace(CAST(to_json(list(word ORDER BY word)) AS VARCHAR), ',', ',' || chr(10) || '    ') AS code FROM placed GROUP BY page""",
)
def list_pages(spark, sf):
    """Pages of 100 words; executed in order they give the whole list."""
    return wordlists.list_as_code(base.vocabulary(spark, sf), "NOISE_PATTERNS", 100)


@query("a16_resume_anti", "SELECT doc_id AS uri FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("uri"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("uri"))
    return records.pending(wanted, done)


@query(
    "b11_pack",
    f"WITH {VOCAB} SELECT word || ' (' || cnt || ')' AS cell, word, cnt FROM vocab",
)
def pack(spark, sf):
    cells = base.vocabulary(spark, sf).select(w.pack("word", "cnt").alias("cell"))
    return cells.select("cell", w.packed_word("cell").alias("word"), w.packed_count("cell").alias("cnt"))
