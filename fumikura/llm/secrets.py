"""Secret scan with multipart linking, in DataFrame functions only.

Every kind of part is found by one pattern over the whole text.  Strong kinds
are reported as they are.  Weak kinds (a bare token, a login, an endpoint) say
little alone: an interval join over parts of the same document reports them
only where the complementary parts stand within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scale import lookup_join
from ..session import stored
from .rows import counted_chars, packed, row_key, unpacked

# Strong kinds, in the order in which they are listed (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# access: AKIA[A-Z0-9]+, hex: [0-9a-f]+
#: Least characters of a secret value, an access identifier and a hexadecimal run.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

# Weak kinds: reported only beside their complement.
LOGIN = r"""(?i)\b(?:username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?"""
BARE = r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"""
#: Code points between the starts of parts that belong together.
REACH = 256

KINDS = ("assign", "access", "hex", "login", "endpoint", "bare")
STRONG = 3


def _found(text: Column, number: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern: structs <kind, i, skipped, size, fits>.

    ``skipped`` is the length of the text between a match and the one before,
    so running sums over ``i`` give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("s"))
    made = F.transform(
        parts,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(x["s"]).alias("skipped"), F.length(x["w"]).alias("size"), (F.length(x["v"]) >= least).alias("fits")
        ),
    )
    return F.when(text.rlike(pattern), made)


def find_parts(docs: DataFrame) -> DataFrame:
    """<doc_id, text hash, rows, kind, start, end, fits>, one row per part, and one of kind null per text.

    ``rows`` (where kind is null) is the number of input rows with that id and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # A run of these two kinds is taken whole, so asking for the least size in
    # the pattern leaves the same spans as dropping shorter matches afterwards.
    kinds = [
        _found(text, 0, ASSIGN, 2, ASSIGN_LEAST),
        _found(text, 1, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"),
        _found(text, 2, rf"[0-9a-f]{{{HEX_LEAST},}}"),
        _found(text, 3, LOGIN),
        _found(text, 4, ENDPOINT),
        _found(text, 5, BARE),
    ]
    nothing = "array<struct<kind:int,i:int,skipped:int,size:int,fits:boolean>>"
    head = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("skipped"), F.lit(0).alias("size"), F.lit(True).alias("fits")))
    every = F.concat(head, *[F.coalesce(k, F.array().cast(nothing)) for k in kinds])
    key = ["doc_id", "_text"]
    found = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.inline(every))
    counted = found.groupBy(*key, "kind", "i", "skipped", "size", "fits").agg(F.count("*").alias("rows"))
    running = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("skipped").cast("bigint") + F.col("size")).over(running)
    return counted.withColumn("end", end).select(*key, "rows", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "fits")


def _near(parts: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """Parts with another part within reach: an interval join on stretches of the text.

    Parts do not overlap within a kind, so a stretch holds a bounded number of them.
    """
    spread = others.select(
        F.col("doc_id").alias("_id"),
        F.col("_text").alias("_other"),
        F.col("start").alias("_start"),
        F.explode(F.transform(F.array(*[F.lit(x) for x in (-1, 0, 1)]), lambda x: F.floor(F.col("start") / reach) + x)).alias("_stretch"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_other")) & (F.floor(F.col("start") / reach) == F.col("_stretch"))
    return parts.join(spread, same & (F.abs(F.col("start") - F.col("_start")) <= reach), "left_semi")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts that complementary parts stand near to.

    * A bare token is reported beside an access identifier or a login.
    * A login is reported beside a secret: assigned, hexadecimal or bare.
    * An endpoint is reported beside an access identifier or login and a secret.
    """
    number = {name: i for i, name in enumerate(KINDS)}
    of = lambda *names: parts.where(F.col("kind").isin(*[number[n] for n in names]) & F.col("fits"))
    identifier, secret = of("access", "login"), of("assign", "hex", "bare")
    bare = _near(of("bare"), identifier, reach)
    login = _near(of("login"), secret, reach)
    endpoint = _near(_near(of("endpoint"), identifier, reach), secret, reach)
    return bare.unionByName(login).unionByName(endpoint)


def free_parts(parts: DataFrame) -> DataFrame:
    """Without the weak parts that overlap a strong one.

    One sweep over the parts of a text in each direction: the farthest end of
    the strong parts begun so far, and the nearest start of those to come.
    """
    text = Window.partitionBy("doc_id", "_text")
    ahead = text.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = text.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    is_strong = F.col("kind") < STRONG
    begun, to_come = F.max(F.when(is_strong, F.col("end"))).over(ahead), F.min(F.when(is_strong, F.col("start"))).over(back)
    covered = (begun > F.col("start")) | (to_come < F.col("end"))
    swept = parts.withColumn("_covered", F.coalesce(covered & (F.col("kind") >= STRONG), F.lit(False)))
    return swept.where(~F.col("_covered")).drop("_covered")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row <doc_id, found, strong>: structs <start, kind, end> in order, all and the strong ones.

    * Null text counts as empty: nothing found.
    * Strong kinds are never dropped; a bare token that overlaps a strong span is part of that one and not listed again.
    * Rows that share doc_id and text give equal results, once per row; a null doc_id is a key like any other.
    * Places are code points, the end exclusive; other columns are not read.
    """
    parts = stored(find_parts(docs))
    strong = parts.where((F.col("kind") < STRONG) & F.col("fits"))
    linked = link_parts(parts, reach)
    every = free_parts(parts.where(F.col("kind").isNull()).unionByName(strong).unionByName(linked))
    span = F.struct("start", "kind", "end")
    gathered = every.groupBy("doc_id", "_text").agg(
        F.max(F.when(F.col("kind").isNull(), F.col("rows"))).alias("_rows"),
        F.array_sort(F.collect_list(F.when(F.col("kind") < STRONG, span))).alias("strong"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("found"),
    )
    return gathered.select("doc_id", "_text", "found", "strong", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_copy"))


def spelled(spans: Column | str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by a mark; all columns and their order kept.

    Overlapping spans are replaced as one; ``n_chars`` follows the text.  Rows
    without a span, and null texts, stay as they are.
    """
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = scan_secrets(docs, reach).where(F.size("found") > 0).select(row_key().alias("_key"), spans.alias("_spans"))
    keyed = packed(docs, "doc_id", F.xxhash64("text").alias("_text")).withColumn("_key", row_key())
    joined = lookup_join(keyed, found.dropDuplicates(["_key"]), ["_key"], "left")
    # Fold from the left: text so far, and where the last span ended.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(done, span):
        inside = span["start"] < done["at"]
        piece = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(inside, done["out"]).otherwise(F.concat(done["out"], piece, F.lit(mark))).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    folded = F.aggregate("_spans", start, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))))
    changed = F.col("_spans").isNotNull()
    clean = joined.select("_row", "_spans", F.when(changed, folded).otherwise(F.col("text")).alias("text"))
    return unpacked(clean, docs.columns, **counted_chars(docs, changed))
