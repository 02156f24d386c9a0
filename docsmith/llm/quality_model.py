"""Operator 3, quality classifier from weak labels.

Heuristic labellers vote good (+1), bad (-1) or abstain (0) on every whole text.
Expectation-maximisation over the counts of vote patterns, of which there are at most
3 ** labellers whatever the input, estimates what each labeller votes on good and on bad
texts, and so the posterior of each pattern.  The posteriors of a bounded sample
(``SAMPLE`` documents of an even hash sample of rows, by id and text) train a logistic scorer over hashed
features: byte trigrams, and words that repeat the one before.  Every document is then scored.

Counts cover all documents; only the fit of the scorer is on the sample.  No shuffle but
for the pattern counts.

Edge cases: a null or empty text is rejected, with posterior and score 0; where every
labeller abstains the posterior is the prior; repeated rows count each; an empty table gives
an empty result.  Columns other than id and text are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, slices, sums
from .suffix_dedup import LETTERS, SLICE, mix, powers

SAMPLE, BUCKETS, CUTOFF = 3000, 1 << 16, 0.5
#: The prior on each labeller, in votes: so many on good and so many on bad texts, with these shares of "bad".
PRIOR_VOTES, WRONG, FOUND = 10, 0.01, 0.3
#: The trigrams added to every count.
SMOOTH = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>~^@{}")] = True
BLANKS = np.zeros(256, bool)
BLANKS[[*range(9, 14), 32]] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?\"'):;,")] = True
#: Frequent function words.
FUNCTION_WORDS = (
    "the of and to in is that it for on with as by at from be this are or an "
    "le la les de des du et en un une que qui dans pour par sur au aux "
    "el los las del y una por con para se su al lo "
    "der die das und zu den von mit ist auf für im dem ein eine nicht sich"
).split()
LABELLERS = ("symbols", "capitals", "shouting", "repeated_words", "bars", "function_words", "repeated_lines", "sentence_ends", "distinct_words")


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    up, _ = powers(len(raw))
    return int(mix(np.array([(LETTERS[raw] * up[: len(raw)]).sum(dtype=np.uint64)]))[0])


FUNCTION_HASHES = np.sort(np.array([_word_hash(w) for w in set(FUNCTION_WORDS)], np.uint64))


def _pieces(data: np.ndarray, lower: np.ndarray, inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of the runs of inside bytes, cut at rows."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTERS[lower] * up[:n], out=total[1:])
    return start, end, np.searchsorted(at, start, "right") - 1, mix((total[end] - total[start]) * down[start])


def _again(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a row has had the value before."""
    order = np.lexsort((np.arange(len(value)), value, row))
    out = np.zeros(len(value), bool)
    out[order[1:]] = (value[order[1:]] == value[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return out


def votes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The votes of all labellers on each text, the words that repeat the one before, and the rows' words."""
    rows = len(at) - 1
    if not len(data):
        none = np.zeros(rows, np.int64)
        return np.zeros((rows, len(LABELLERS)), np.int8), none, none
    upper = (data >= 65) & (data <= 90)
    lower = np.where(upper, data + 32, data).astype(np.uint8)
    letters = sums((lower >= 97) & (lower <= 122), at)
    start, end, row, own = _pieces(data, lower, ~BLANKS[data], at)
    words = np.bincount(row, minlength=rows)
    each = np.maximum(words, 1)
    repeats = np.zeros(len(start), bool)
    repeats[1:] = (own[1:] == own[:-1]) & (row[1:] == row[:-1])
    n_repeats = np.bincount(row[repeats], minlength=rows)
    function = FUNCTION_HASHES[np.minimum(np.searchsorted(FUNCTION_HASHES, own), len(FUNCTION_HASHES) - 1)] == own
    double = np.zeros(len(data), bool)
    double[:-1] = (data[1:] == 33) & (data[:-1] == 33)
    l_start, l_end, l_row, l_own = _pieces(data, data, data != 10, at)
    has_word = np.diff(np.searchsorted(start, np.stack([l_start, l_end]), "left"), axis=0)[0] > 0
    l_end, l_row, l_own = l_end[has_word], l_row[has_word], l_own[has_word]
    lines = np.bincount(l_row, minlength=rows)
    again = np.bincount(l_row[_again(l_own, l_row)], minlength=rows) / np.maximum(lines, 1)
    ends = np.bincount(l_row[STOPS[data[l_end - 1]]], minlength=rows) / np.maximum(lines, 1)
    symbols, bars, shouts = sums(SYMBOLS[data], at) / each, sums(data == 124, at) / each, sums(double, at) / each
    capitals = sums(upper, at) / np.maximum(letters, 1)
    functions = np.bincount(row[function], minlength=rows) / each
    repeated = n_repeats / each
    distinct = 1 - np.bincount(row[_again(own, row)], minlength=rows) / each

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)

    some = words > 0
    out = [
        vote(symbols >= 0.1, some & (symbols <= 0.02)),
        vote((capitals >= 0.4) & (letters >= 20), (capitals <= 0.2) & (letters >= 20)),
        vote(shouts >= 0.05, some & (shouts == 0)),
        vote((repeated >= 0.2) & (words >= 8), (repeated <= 0.05) & (words >= 8)),
        vote(bars >= 0.05, some & (bars == 0)),
        vote((functions == 0) & (words >= 20), functions >= 0.05),
        vote((again >= 0.4) & (lines >= 4), (again <= 0.1) & (lines >= 4)),
        vote((ends < 0.3) & (lines >= 3), ends >= 0.7),
        vote((distinct < 0.25) & (words >= 20), (distinct >= 0.4) & (words >= 20)),
    ]
    return np.stack(out, axis=1), n_repeats, words


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM for two classes: the posterior of good for each pattern, the prior, and P(vote good | class, voted) by labeller.

    Votes are independent given the class, abstentions say nothing.  The prior on the rates is worth
    ``PRIOR_VOTES`` votes a class, so it settles what few votes leave open, which class is the good one among
    that, and hardly moves a labeller with many.
    """
    counts = counts.astype(np.float64)
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    # to start with, a text is bad if any labeller says so: labellers each see a fault of their own
    q = np.where(bad.sum(axis=1) > 0, 0.02, 0.95)
    prior, rates = 0.5, np.full((2, patterns.shape[1]), 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        rates = np.stack([(w @ good + PRIOR_VOTES * (1 - share)) / (w @ (good + bad) + PRIOR_VOTES) for w, share in zip(weight, (FOUND, WRONG))])
        prior = (weight[1].sum() + 5) / (counts.sum() + 10)
        log = good @ np.log(rates[1] / rates[0]) + bad @ np.log((1 - rates[1]) / (1 - rates[0])) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return q, float(prior), rates


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; of a row's last two bytes it reaches into the next row."""
    x = data.astype(np.uint32)
    packed = np.zeros(len(x), np.uint32)
    packed[:-2] = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return ((packed * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _grams(at: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(at) - 2, 0)


def features(data: np.ndarray, at: np.ndarray, n_repeats: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each row: shares of trigrams, and in the last bucket the share of words that repeat."""
    bucket, out = trigrams(data) if len(data) > 2 else np.zeros(len(data), np.int64), []
    for a, n, r, w in zip(at[:-1].tolist(), _grams(at).tolist(), n_repeats.tolist(), words.tolist()):
        own, count = np.unique(bucket[a : a + n], return_counts=True)
        out.append((np.append(own, BUCKETS).astype(np.int32), np.append(count / (n + SMOOTH), r / max(w, 1)).astype(np.float32)))
    return out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic weights over BUCKETS + 1 features and the bias, by gradient steps scaled for each feature (Adagrad)."""
    weights, bias = np.zeros(BUCKETS + 1), 2.0
    if not rows:
        return weights, bias
    column, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    seen, seen_bias = np.full(BUCKETS + 1, 1e-12), 1e-8
    # both classes weigh the same, within bounds
    share = min(max(float(target.mean()), 0.1), 0.9)
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    for _ in range(rounds):
        score = np.bincount(row, weights[column] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) * weight
        slope = np.bincount(column, error[row] * value, BUCKETS + 1) + decay * weights
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.1 * error.sum() / seen_bias**0.5
    return weights, float(bias)


def _code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of vote patterns of a task."""
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            v, _, words = votes(*flat_texts(part.column("text")))
            total += np.bincount(_code(v[words > 0]), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])


def _sample_rows(posterior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, at = flat_texts(part.column("text"))
                v, repeats, words = votes(data, at)
                keep = np.flatnonzero(words > 0)
                found = features(data, at, repeats, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for k in keep], t) for x, t in ((part.column("h").to_pylist(), pa.int64()), (posterior[_code(v)].tolist(), pa.float64()), ([f[0].tobytes() for f in found], pa.binary()), ([f[1].tobytes() for f in found], pa.binary()))],
                    names=["h", "target", "columns", "shares"],
                )

    return run


def _score_rows(posterior: np.ndarray, weights: np.ndarray, bias: float, cutoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, at = flat_texts(part.column("text"))
                v, repeats, words = votes(data, at)
                n = _grams(at)
                total = np.concatenate([[0.0], np.cumsum(weights[trigrams(data)] if len(data) > 2 else np.zeros(len(data)))])
                mean = (total[at[:-1] + n] - total[at[:-1]]) / (n + SMOOTH)
                score = 1 / (1 + np.exp(-np.clip(mean + weights[BUCKETS] * repeats / np.maximum(words, 1) + bias, -50, 50)))
                score = np.where(words > 0, score, 0.0)
                good = np.where(words > 0, posterior[_code(v)], 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(good), pa.array(score), pa.array(score >= cutoff)], names=["id", "posterior", "score", "kept"])

    return run


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The posterior of each vote pattern, from all of (id, text), and the scorer's weights and bias, from a sample."""
    counts = rows.select("text").mapInArrow(_pattern_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers rows at most
    every = np.array(list(product((-1, 0, 1), repeat=len(LABELLERS))), np.int8)
    every = every[np.argsort(_code(every))]
    seen = np.zeros(len(every))
    for r in counts:
        seen[r["pattern"]] = r["n"]
    posterior, _, _ = fit_votes(every, seen)
    # an even sample by hash: its size does not grow with the table
    share = min(1.0, sample / max(int(seen.sum()), 1))
    limit = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    hashed = rows.withColumn("h", F.xxhash64("id", "text", F.lit(3)))

    def take(chosen: DataFrame) -> list:
        found = chosen.mapInArrow(_sample_rows(posterior), "h long, target double, columns binary, shares binary")
        # twice the expected size at most, least hashes first
        return sorted(found.orderBy("h").limit(2 * sample).collect(), key=lambda r: (r["h"], r["columns"], r["shares"]))

    drawn = take(hashed.filter(F.col("h") <= F.lit(limit)))
    if not drawn and seen.sum():
        # a few distinct rows, repeated very often, may have no hash in the range
        least = hashed.filter("text <> ''").groupBy("h").agg(F.any_value("text").alias("text")).orderBy("h").limit(sample)
        drawn = take(least)
    weights, bias = fit_scorer([(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in drawn], np.array([r["target"] for r in drawn]))
    return posterior, weights, bias


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """(id, posterior, score, kept): the labellers' posterior of good, the scorer's, and whether that reaches the cutoff."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score_rows(*fit(rows, sample), cutoff), f"id {df.schema[id_col].dataType.simpleString()}, posterior double, score double, kept boolean")
    return scored.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """The rows, with all their columns, that ``classify`` keeps."""
    posterior, weights, bias = fit(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), sample)
    score = _score_rows(posterior, weights, bias, cutoff)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col).cast(pa.string())], names=["id", "text"])
            kept = [p.column("kept") for p in score(iter([texts]))]
            if kept:
                yield batch.filter(pa.chunked_array(kept).combine_chunks())

    return df.mapInArrow(run, df.schema)
