"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  How often
each pattern of votes occurs is counted over all documents; expectation-
maximisation on these counts estimates how reliable every labeller is and how
likely each pattern is good.  These posterior labels train a linear scorer on
hashed features, which then scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .bytewords import PIECE, SPACES, mix, text_buffer, word_hashes
from .rows import bound_batches

#: Slots of the hashed features.
SLOTS = 1 << 17
#: Documents, about, on which the scorer is fitted (drawn by a hash of the text).
SAMPLE_ROWS = 6_000
EPOCHS = 12
KEEP_FROM = 0.5
#: Chances of a bad, no and good vote before any is seen: on good documents, on
#: bad ones, and on those bad in the way the labeller looks for; and how much
#: that counts as a share of all documents.
PRIOR_VOTES = ((0.002, 0.398, 0.6), (0.1, 0.5, 0.4), (0.8, 0.15, 0.05))
PRIOR = 0.002

_UPPER, _LOWER, _DIGIT, _MARK, _STOP, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:] = _LOWER  # bytes of other letters, which have no case here
_CLASS[ord("A"):ord("Z") + 1] = _UPPER
_CLASS[ord("a"):ord("z") + 1] = _LOWER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
for _c in "#$%&*+<=>@\\^_`{|}~/[]":
    _CLASS[ord(_c)] = _MARK
for _c in ".!?":
    _CLASS[ord(_c)] = _STOP

#: Labellers in the order of their votes.
LABELLERS = ("case", "marks", "repeats", "variety", "sentences", "exclamations", "length", "words", "columns")
_NAMES = ("upper", "marks", "repeats", "distinct", "stops", "bangs", "n", "mean", "pipes")


def measures(data: np.ndarray) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Measures of a text's bytes, and its hashed words with their counts.

    A long text is measured in pieces that end between words; counts add up.
    """
    sums = np.zeros(10)
    words: list[np.ndarray] = []
    kinds = np.zeros(len(_NAMES) + 4)
    last_word = None
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(SPACES[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        piece = data[at:end]
        at = end
        kind = _CLASS[piece]
        count = np.bincount(kind, minlength=6)
        hashes, starts, ends = word_hashes(piece, SPACES)
        n = len(hashes)
        if not n:
            continue
        before = np.concatenate([[last_word if last_word is not None else ~hashes[0]], hashes[:-1]])
        last_word = hashes[-1]
        marked = np.add.reduceat(kind == _MARK, starts) > 0
        shouted = (np.add.reduceat(kind == _LOWER, starts) == 0) & (np.add.reduceat(kind == _UPPER, starts) > 1)
        stops = kind[ends - 1] == _STOP
        bangs = (piece[ends - 1] == 0x21) & (ends - starts > 1) & (piece[np.maximum(ends - 2, 0)] == 0x21)
        pipes = (ends - starts == 1) & (piece[starts] == 0x7C)
        repeated = hashes == before
        sums += [count[_UPPER], count[_UPPER] + count[_LOWER], marked.sum(), repeated.sum(), stops.sum(), bangs.sum(), n, (ends - starts).sum(), pipes.sum(), shouted.sum()]
        words.append(hashes)
    n = max(1.0, sums[6])
    every, counts = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = {
        "upper": sums[0] / max(1.0, sums[1]), "marks": sums[2] / n, "repeats": sums[3] / n, "distinct": len(every) / n, "stops": sums[4] / n,
        "bangs": sums[5] / n, "n": sums[6], "mean": sums[7] / n, "pipes": sums[8] / n,
    }
    return out, every, counts


def votes(m: dict[str, float]) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 none.

    Most only know one kind of bad text, and say nothing where it is absent.
    """
    n = m["n"]
    grade = lambda bad, good: -1 if bad else 1 if good else 0
    return [
        grade(m["upper"] > 0.5, False),
        grade(m["marks"] > 0.12, False),
        grade(m["repeats"] > 0.15, False),
        grade(n >= 50 and m["distinct"] < 0.15, n >= 20 and m["distinct"] > 0.35),
        grade(n >= 60 and m["stops"] < 0.01, 0.03 <= m["stops"] <= 0.35),
        grade(m["bangs"] > 0.1, False),
        grade(n < 2, n >= 2),
        grade(not 2.0 <= m["mean"] <= 14.0, False),
        grade(m["pipes"] > 0.1, False),
    ]


def _packed(vote: list[int]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def unpacked(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


def features(m: dict[str, float], words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights: words by the root of their count, measures by the bin they fall into; unit length each."""
    slot = (words >> np.uint64(40)) % np.uint64(SLOTS)
    weight = np.sqrt(counts)
    weight = weight / max(1e-9, np.linalg.norm(weight))
    bins = [int(10 * min(m[k], 1.0) ** 0.5) if k not in ("n", "mean") else int(2 * np.log2(1 + m[k])) for k in _NAMES]
    own = mix(np.array([i * 64 + b for i, b in enumerate(bins)], np.uint64) + np.uint64(1 << 60)) % np.uint64(SLOTS)
    return np.concatenate([slot, own]).astype(np.int64), np.concatenate([weight, np.full(len(own), 1.0)])


class LabelModel:
    """Reliability of every labeller, from counts of vote patterns alone.

    Documents are good, or bad in one of several ways, one for each labeller
    that can say so; given the class, votes are taken as independent.  A class
    starts with the patterns in which its labeller votes bad (shared among
    those that do), the good one with the patterns without a bad vote.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        m = len(LABELLERS)
        vote = np.array([unpacked(int(p)) for p in patterns], np.int64).reshape(len(patterns), m) + 1
        weight = counts.astype(np.float64)
        bad = (vote == 0).astype(float)
        share = np.concatenate([(bad.sum(1) == 0).astype(float)[:, None], bad / np.maximum(bad.sum(1), 1)[:, None]], 1)
        # Beforehand, as if seen on PRIOR of all documents: false alarms are rare, and a labeller knows its own kind.
        belief = np.repeat(np.array(PRIOR_VOTES)[[0] + [1] * m][:, None, :], m, 1)
        belief[np.arange(1, m + 1), np.arange(m)] = PRIOR_VOTES[2]
        belief = belief * (PRIOR * weight.sum() + 1)
        each = np.arange(m)
        for _ in range(rounds):
            size = (share * weight[:, None]).sum(0) + 1
            chance = belief.copy()
            for v in range(3):
                chance[:, :, v] += (share * weight[:, None]).T @ (vote == v)
            chance /= chance.sum(2, keepdims=True)
            log = np.log(size / size.sum()) + np.log(chance[:, each, vote]).sum(2).T
            now = np.exp(log - log.max(1, keepdims=True))
            now /= now.sum(1, keepdims=True)
            done = np.abs(now - share).max(initial=0.0) < 1e-9
            share = now
            if done:
                break
        good = share[:, 0]
        self.posterior = dict(zip((int(p) for p in patterns), good.tolist()))
        # Share of right ones among a labeller's votes.
        right = weight @ (np.where(vote == 2, good[:, None], 0) + np.where(vote == 0, 1 - good[:, None], 0))
        cast = weight @ (vote != 1).astype(float)
        self.accuracy = dict(zip(LABELLERS, np.divide(right, cast, out=np.full(m, np.nan), where=cast > 0).tolist()))


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = text_buffer(batch.column("text"))
    for i in range(len(batch)):
        yield data[offsets[i]:offsets[i + 1]]


def vote_patterns(docs: DataFrame) -> DataFrame:
    """<doc_id, _text, pattern> of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_packed(votes(measures(text)[0])) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(found, pa.int32())], names=["doc_id", "_text", "pattern"])

    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(run, f"doc_id {kind}, _text bigint, pattern int")


def _sampled(docs: DataFrame, patterns: DataFrame, most: int) -> pa.Table:
    """<pattern, slots, weights> of about ``most`` documents of different texts."""
    distinct = patterns.agg(F.approx_count_distinct("_text")).first()[0] or 1
    place = F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.select("text").where(place * distinct < most).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, slots, weights = [], [], []
            for text in _texts(batch):
                m, words, counts = measures(text)
                a, b = features(m, words, counts)
                pattern.append(_packed(votes(m))), slots.append(a.astype(np.int32)), weights.append(b.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), pa.array(slots, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["pattern", "slots", "weights"])

    return drawn.mapInArrow(run, "pattern int, slots array<int>, weights array<float>").toArrow()


def fit_scorer(sample: pa.Table, model: LabelModel, epochs: int = EPOCHS) -> np.ndarray:
    """Logistic regression on posterior labels by adaptive gradient steps; the last weight is the bias."""
    weight, seen = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    rows = []
    for pattern, slots, values in zip(sample.column("pattern").to_pylist(), sample.column("slots"), sample.column("weights")):
        rows.append((model.posterior[pattern], np.append(slots.values.to_numpy(), SLOTS), np.append(values.values.to_numpy(), 1.0)))
    # A fixed order, whatever the order in which tasks delivered.
    rows.sort(key=lambda r: (len(r[1]), r[1].tobytes()))
    rng = np.random.default_rng(17)
    share = min(0.98, max(0.02, float(np.mean([r[0] for r in rows])))) if rows else 0.5
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, slots, values = rows[i]
            guess = 1 / (1 + np.exp(-np.clip(weight[slots] @ values, -40, 40)))
            # The rarer side weighs as much as the other.
            step = (guess - label) * (label * 0.5 / share + (1 - label) * 0.5 / (1 - share))
            move = step * values
            np.add.at(seen, slots, move * move)
            np.subtract.at(weight, slots, 0.3 * move / np.sqrt(seen[slots]))
    return weight.astype(np.float32)


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> tuple[DataFrame, LabelModel]:
    """(<doc_id, posterior, score, keep> of every row, label model).

    ``posterior`` is what the label model makes of the row's votes, ``score``
    the linear scorer's chance that it is good; rows from ``keep_from`` on are kept.

    * Null, empty or wordless text: score 0, not kept; it takes part in the counts of votes.
    * Repeated rows each have a result; a text counts once in the fitting sample however often it occurs.
    * Empty table: no row.  Other columns are not read.
    """
    patterns = stored(vote_patterns(docs))
    # At most 3 ** len(LABELLERS) patterns.
    counted = patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    model = LabelModel(counted.column("pattern").to_numpy(), counted.column("n").to_numpy())
    weight = fit_scorer(_sampled(docs, patterns, sample_rows), model)
    held = docs.sparkSession.sparkContext.broadcast((weight, model.posterior))  # SLOTS weights, one number per pattern
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, posterior = held.value
        for batch in batches:
            label, score = [], []
            for text in _texts(batch):
                m, words, counts = measures(text)
                label.append(posterior.get(_packed(votes(m)), 0.5))
                slots, values = features(m, words, counts)
                score.append(float(1 / (1 + np.exp(-np.clip(weight[slots] @ values + weight[SLOTS], -40, 40)))) if m["n"] else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(label, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= keep_from for s in score], pa.bool_())],
                names=["doc_id", "posterior", "score", "keep"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, posterior double, score double, keep boolean"), model
