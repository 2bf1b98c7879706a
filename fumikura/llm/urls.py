"""URL rules by host and path, in DataFrame functions only.

A rule is a host and the beginning of a path.  Every URL is expanded into
expressions, each a suffix of its host with a beginning of its path; those of
the shape of some rule are hashed, met with the rules on a short beginning of
the hash, and confirmed on the whole digest.  Of the rules that fit, the
longest decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scale import is_small, lookup_join
from ..session import stored

#: Hexadecimal digits of a digest on which URLs and rules are joined; the rest confirms.
SHORT = 8
VERDICTS = ("allow", "block")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``.

    The host goes from the first ``://`` to ``/``, ``?``, ``#`` or the end, the
    path from there to ``?``, ``#`` or the end.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """<host, path, verdict> of rules that are written out."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _hashed(rules: DataFrame) -> DataFrame:
    """<_short, _digest, _rule, _verdict, _order>, one row per rule that can fit; of equal ones block wins."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    able = ~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("verdict").isin(*VERDICTS)
    once = rules.where(able).groupBy("host", "path").agg(F.max("verdict").alias("_verdict"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return once.select(
        F.substring(digest, 1, SHORT).alias("_short"),
        digest.alias("_digest"),
        F.concat("host", "path").alias("_rule"),
        "_verdict",
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host")).alias("_order"),
        "host",
        "path",
    )


def _expressions(host: Column, path: Column, labels: int, chars: int, stubs: Sequence[int]) -> Column:
    """Suffixes of the host of at most ``labels`` labels, each with beginnings of the path of at most ``chars`` characters.

    A path begins with nothing, ends behind any slash, or ``stubs`` characters
    behind one: these are all lengths that rules have.
    """
    parts = F.split(host, r"\.", -1)
    count = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(count - labels + 1, F.lit(1)), count), lambda i: F.array_join(F.slice(parts, i, count), "."))
    pieces = F.split(F.substring(path, 1, chars), "/", -1)
    ends = F.slice(F.sequence(F.lit(0), F.size(pieces) - 1), F.lit(2), F.size(pieces))
    folders = F.transform(ends, lambda k: F.struct(F.concat(F.array_join(F.slice(pieces, F.lit(1), k), "/"), F.lit("/")).alias("up"), F.get(pieces, k).alias("next")))
    behind = lambda n: F.transform(F.filter(folders, lambda f: F.length(f["next"]) >= n), lambda f: F.concat(f["up"], F.substring(f["next"], 1, n)))
    longer = [behind(n) for n in stubs]
    beginnings = F.concat(F.array(F.lit("")), F.transform(folders, lambda f: f["up"]), *longer)
    return F.flatten(F.transform(suffixes, lambda h: F.transform(beginnings, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns of every row with <host, path, rule, verdict>.

    ``rules`` is <host, path, verdict> with a verdict of ``allow`` or
    ``block``.  A rule fits its host and all below it where the URL's path
    starts with the rule's.  The longest host and path together win, of equally
    long ones that with the longer host; the same rule with both verdicts blocks.

    * No rule fits: rule null, verdict ``default``.  Without rules that is every row.
    * Null URL, or one without ``://``: host and path empty, and no rule but one for the empty host fits.
    * An empty path begins with the empty path only, so a rule with path ``/`` does not fit ``http://host``.
    * Rules with a null, with a host that holds ``/``, ``?`` or ``#``, or with a path that begins otherwise than with ``/`` never fit.
    * Repeated rows each have a result; URLs of any length are taken whole; other columns are not read.

    A URL has as many expressions as rules have shapes, however long it is.
    Equal URLs are judged once behind a partial aggregation, and the rules are
    broadcast only if they are measured to be few.
    """
    if default not in VERDICTS:
        raise ValueError(f"default must be one of {VERDICTS}")
    known = stored(_hashed(rules))
    stub = F.length(F.regexp_extract("path", "[^/]*$", 0))
    # One row: the shapes of rules.  There are at most as many stub lengths as the longest path has characters.
    shape = known.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.length("path")).alias("chars"), F.sort_array(F.collect_set(stub)).alias("stubs")).first()
    own = [F.col(f"`{c}`") for c in keep]
    host, path = host_and_path(F.col("url"))
    if shape.labels is None:
        return pages.select(*own, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = pages.select(F.struct(host.alias("host"), path.alias("path")).alias("_url"))
    expanded = parts.select("_url", F.explode(_expressions(F.col("_url.host"), F.col("_url.path"), shape.labels, shape.chars, [n for n in shape.stubs if n])).alias("_text"))
    hashed = expanded.select("_url", F.sha2("_text", 256).alias("_full")).withColumn("_short", F.substring("_full", 1, SHORT))
    known = known.select("_short", "_digest", "_rule", "_verdict", "_order")
    met = hashed.join(F.broadcast(known) if is_small(known) else known, "_short").where(F.col("_full") == F.col("_digest"))
    best = met.groupBy("_url").agg(F.max(F.struct("_order", "_rule", "_verdict")).alias("_best"))
    best = best.select(F.col("_url.host").alias("host"), F.col("_url.path").alias("path"), F.col("_best._rule").alias("rule"), F.col("_best._verdict").alias("verdict"))
    judged = lookup_join(pages.select(F.struct(*own).alias("_own"), host.alias("host"), path.alias("path")), best, ["host", "path"])
    return judged.select(*[F.col("_own").getField(c).alias(c) for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows whose URL is not blocked, with all their columns, as :func:`judge_urls` decides."""
    carried = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), "url")
    kept = judge_urls(carried, rules, ("_page",), default).where(F.col("verdict") == "allow")
    return kept.select(*[F.col("_page").getField(c).alias(c) for c in pages.columns])
