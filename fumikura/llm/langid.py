"""Language ID by prediction by partial matching.

For every language a tree of byte contexts of up to ``ORDER`` bytes is counted
on a bounded sample of labelled rows and then frozen.  The probability of a
byte after a context is, by escape method C with exclusion,

    count / (total + kinds)                                  if it was seen there,
    kinds / (total + kinds) * p(byte | shorter context, byte not seen here)

down to one part in 256 below the empty context.  These probabilities sum to
one, so their logarithms are code lengths; a text gets the language that codes
all its bytes shortest.

Frozen statistics allow all code lengths to be worked out beforehand.  A byte
seen after a context was seen after all shorter ones too, so its code length is
8 bits, plus for every order the escape from the context, and for every order
where the byte was seen what that is more or less than the escape.  Both are
kept only for what the sample has: one number per (context, language) and one
per (context, byte, language), in sorted keys.  No counted context is left out.
Bytes never seen in training are all alike to every tree, so they share a code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scale import lookup_join
from .bytewords import small_batches, text_buffer
from .rows import TEXT_BATCH, bound_batches, lean, packed, schema, unpacked

ORDER = 3
#: Labelled rows per language used for training (about; drawn by a hash).
SAMPLE_ROWS = 1500
_PIECE = 1 << 18


def training_rows(labelled: DataFrame, per_language: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """A bounded sample of <lang, text>, about ``per_language`` rows of each language.

    Rows are drawn by a hash of their key against the share that the language
    needs, so one frequent language costs no more than a rare one.
    """
    bound_batches(labelled.sparkSession, TEXT_BATCH)
    rows = labelled.select(key, "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = lookup_join(rows, sizes, ["lang"], "inner").where(place * F.col("_n") < F.lit(float(per_language)))
    return drawn.select("lang", "text")


@lean
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language, how often each run of ORDER + 1 bytes occurs.

    A run is one number, its last byte lowest; a text is led by ORDER marks
    (256), so early bytes have only the contexts that are there.
    """
    for batch in small_batches(batches, 256):
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code = np.full(ORDER + len(raw := text.encode()), 256, np.int64)
            code[ORDER:] = np.frombuffer(raw, np.uint8)
            run = np.zeros(len(raw), np.int64)
            for i in range(ORDER + 1):
                run = run * 257 + code[i:i + len(raw)]
            found.setdefault(lang, []).append(run)
        for lang, runs in found.items():
            values, counts = np.unique(np.concatenate(runs), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values)), "run": values, "n": counts})


class _Sparse:
    """Numbers by (key, language), for the few languages that have the key."""

    def __init__(self, both: np.ndarray, values: np.ndarray, langs: int):
        """``both`` is key times ``langs`` plus language, ascending."""
        self.keys, first = np.unique(both // langs, return_index=True)
        self.start = np.append(first, len(both))
        self.lang = (both % langs).astype(np.uint16 if langs <= 1 << 16 else np.int64)
        self.value = values.astype(np.float32)

    def add(self, out: np.ndarray, keys: np.ndarray) -> None:
        """Adds to each row of ``out`` the numbers of its key."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == keys)
        at = at[row]
        sizes = self.start[at + 1] - self.start[at]
        spot = np.arange(int(sizes.sum())) + np.repeat(self.start[at] - (np.cumsum(sizes) - sizes), sizes)
        out[np.repeat(row, sizes), self.lang[spot]] += self.value[spot]


class Model:
    """Code lengths of every (context, byte) for every language, in bits."""

    def __init__(self, langs: list[str], lang: np.ndarray, raw: np.ndarray, times: np.ndarray):
        """``raw`` runs of ORDER + 1 bytes seen ``times`` in the language numbered ``lang``."""
        self.langs = langs
        # Codes: 0 is the mark and every unseen byte, then the bytes seen.
        seen = np.unique(raw % 257)
        self.codes = width = len(seen) + 1
        to_code = np.zeros(257, np.int64)
        to_code[seen] = np.arange(1, width)
        self.of_byte = to_code[:256].astype(np.uint8 if width <= 256 else np.uint16)
        digits = [to_code[raw // 257 ** (ORDER - i) % 257] for i in range(ORDER + 1)]
        n = max(1, len(langs))

        # Runs by order as numbers in base ``width``; those with a mark before the last byte are not counted.
        self.escapes: list[_Sparse] = []
        self.hits: list[_Sparse] = []
        for order in range(ORDER + 1):
            run = np.zeros(len(raw), np.int64)
            whole = np.ones(len(raw), bool)
            for digit in digits[ORDER - order:ORDER]:
                run = run * width + digit
                whole &= digit > 0
            run = (run * width + digits[ORDER])[whole]
            both, spot = np.unique(run * n + lang[whole], return_inverse=True)
            count = np.bincount(spot, times[whole], len(both))
            context, spot = np.unique(both // n // width * n + both % n, return_inverse=True)
            size = np.bincount(spot, count, len(context)) + (kinds := np.bincount(spot, minlength=len(context)))
            # What the shorter context leaves for bytes not seen here, in its counts, so that nothing is lost to rounding.
            if order:
                shorter = np.searchsorted(last[0], both // n % width ** order * n + both % n)
                above = np.searchsorted(last[3], context // n % width ** (order - 1) * n + context % n)
                less, of, own = last[1][shorter], last[4][above], last[2][shorter]
            else:
                less, of, own = np.ones(len(both)), np.full(len(context), 256.0), np.full(len(both), 8.0)
            rest = (of - np.bincount(spot, less, len(context))) / of
            escape = np.log2(np.maximum(rest, 1e-30)) - np.log2(kinds / size)
            bits = np.log2(size[spot]) - np.log2(count)
            self.escapes.append(_Sparse(context, escape, n))
            self.hits.append(_Sparse(both, bits - own - escape[spot], n))
            last = both, count, bits, context, size

    def lengths(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits of consecutive texts, one row each, one column per language."""
        n = len(sizes)
        out = np.zeros((n, len(self.langs)))
        ends = np.cumsum(sizes)
        first = 0
        while first < n:
            base = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
            if last == first + 1:
                text, before = data[base:int(ends[first])], np.zeros(ORDER, np.int64)
                for at in range(0, len(text), _PIECE):
                    code = self.of_byte[text[at:at + _PIECE]]
                    led = np.concatenate([before, code])
                    out[first] += self._cells(led, np.arange(len(code))).sum(0, dtype=np.float64)
                    before = led[len(led) - ORDER:]
            else:
                own = sizes[first:last]
                led = np.zeros(int(own.sum()) + ORDER * len(own), np.int64)
                at = np.arange(int(own.sum())) + np.repeat(np.arange(len(own)) * ORDER, own)
                led[at + ORDER] = self.of_byte[data[base:int(ends[last - 1])]]
                some = own > 0
                if some.any():
                    cuts = (np.cumsum(own) - own)[some]
                    out[first:last][some] = np.add.reduceat(self._cells(led, at), cuts, 0, dtype=np.float64)
            first = last
        return out

    def _cells(self, led: np.ndarray, at: np.ndarray) -> np.ndarray:
        width = self.codes
        run = np.zeros(max(0, len(led) - ORDER), np.int64)
        for i in range(ORDER + 1):
            run = run * width + led[i:i + len(run)]
        runs, spot = np.unique(run[at], return_inverse=True)
        bits = np.full((len(runs), len(self.langs)), 8.0)
        for order, (escapes, hits) in enumerate(zip(self.escapes, self.hits)):
            escapes.add(bits, runs // width % width ** order)
            hits.add(bits, runs % width ** (order + 1))
        return bits.astype(np.float32)[spot]


def train(rows: DataFrame) -> Model:
    """Frozen trees from <lang, text>; counting runs on the executors.

    What comes to the driver is the model: runs seen in a bounded sample.
    """
    counted = rows.mapInArrow(_gram_counts, "lang string, run bigint, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    table = counted.toArrow().sort_by([("lang", "ascending"), ("run", "ascending")])
    langs = sorted(set(table.column("lang").unique().to_pylist()))
    lang = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    return Model(langs, lang, table.column("run").to_numpy(), table.column("n").to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with <lang_pred, score, bits_per_byte> of every whole text.

    * Null, empty or letterless text: lang_pred ``und``, score 0; bits null if there is no byte.
    * No language learned: ``und`` for all.  Equal code lengths: first language in order.
    * ``score`` is the share of the winner among 2**-bits of all languages.
    * Every input row gives one output row, repeated rows too; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark, TEXT_BATCH)
    held = spark.sparkContext.broadcast(model)  # runs seen in a bounded sample
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    @lean
    def run(batches):
        trees = held.value
        names = np.array([*trees.langs, "und"], object)
        for batch in batches:
            data, offsets = text_buffer(batch.column("_text"))
            sizes = np.diff(offsets)
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if trees.langs:
                bits = trees.lengths(data[offsets[0]:offsets[-1]], sizes)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(np.minimum(least[:, None] - bits, 0.0)).sum(1)
            else:
                best, least, share = np.zeros(len(sizes), int), np.zeros(len(sizes)), np.zeros(len(sizes))
                letter = np.zeros(len(sizes), bool)
            pred = np.where(letter, best, len(trees.langs))
            per = np.divide(least, sizes, out=np.zeros(len(sizes)), where=sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array(names[pred], pa.string()),
                    pa.array(np.where(letter, share, 0.0)),
                    pa.array(per, mask=sizes == 0),
                ],
                names=[*keep, "lang_pred", "score", "bits_per_byte"],
            )

    return kept.mapInArrow(run, schema(docs, keep, "lang_pred string, score double, bits_per_byte double"))


def fold(key: str = "doc_id"):
    """Remainder of crc32 of the key's text modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def identify(docs: DataFrame, per_language: int = SAMPLE_ROWS) -> DataFrame:
    """<doc_id, held_out, lang_pred, score, bits_per_byte> of every row.

    Trees learn from rows whose fold is not 2, with text and language.  A null
    doc_id is in no fold: it is not learned from and ``held_out`` is null.
    """
    model = train(training_rows(docs.where(fold() != 2), per_language))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", fold() == 2)


def keep_known(docs: DataFrame, per_language: int = SAMPLE_ROWS) -> DataFrame:
    """Documents in a learned language, ``lang`` set to it; all columns and their order kept.

    Dropped are rows without a letter: null, empty or letterless texts.  Where
    nothing can be learned (no row with a language), every such row but no other is dropped
    and ``lang`` stays as it is.
    """
    model = train(training_rows(docs.where(fold() != 2), per_language))
    named = predict(packed(docs), model, ("_row", "text"))
    if not model.langs:
        return unpacked(named.where(F.col("text").rlike(r"\p{L}")), docs.columns)
    new = {"lang": F.col("lang_pred")} if "lang" in docs.columns else {}
    return unpacked(named.where(F.col("lang_pred") != "und"), docs.columns, **new)
