"""Quality rules: fixed counts of a text, and a logistic regression on hashed n-grams for what they let pass.

Words and pairs of words, and strings of two to four bytes, are hashed into one table of weights each. A text's
logit is the mean weight of its words' grams plus that of its strings', so it does not depend on its length.
The weights are trained on labelled rows, a line fitted on rows kept aside makes probabilities of logits (Platt),
and texts are scored in Arrow batches, many at once, by array operations on their bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches
from tidemark.llm.runs import STARTS, WORD, Runs, Slab, byte_class, packed, runs, slabs

SYMBOLS = byte_class(b"#*$%&|<>")
#: Words of a window; one found twice counts all words of both.
WINDOW = 8
#: Fixed thresholds of the base: least words, and most words in repeated windows in hundredths.
LEAST_WORDS, MOST_REPEATED = 20, 30
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

BITS, LENGTHS = 17, (2, 3, 4)
#: Odd factors of the multiplicative hashes.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def repeated_lines(slab: Slab, words: Runs) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    marks = slab.heads()
    at = np.flatnonzero(slab.data == 10) + 1
    marks[at[at < len(marks)]] = True
    start = np.flatnonzero(marks)
    if not len(start):
        return np.zeros(len(slab), np.int64)
    kept = slab.data != 10
    upto = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    lengths = upto[np.append(start[1:], len(kept))] - upto[start]
    codes = packed(slab.data[kept], lengths).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.bincount(np.searchsorted(start, words.start, side="right") - 1, minlength=len(start)) > 0
    text = slab.text_of(start)
    different = np.unique(codes[filled] * len(slab) + text[filled]) % len(slab)
    return np.bincount(text[filled], minlength=len(slab)) - np.bincount(different, minlength=len(slab))


def repeated_words(words: Runs, texts: int) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in it.

    Windows are ordered by a hash of their words and text; neighbours of one hash are compared word by word.
    Should two different windows share a hash, all windows of that slab are told apart by their words.
    """
    out = np.zeros(texts, np.int64)
    n = len(words.code) - WINDOW + 1
    if n <= 1:
        return out
    at = np.flatnonzero(words.text[:n] == words.text[WINDOW - 1 :])
    with np.errstate(over="ignore"):
        key = words.text[at].astype(np.uint64) * FACTORS[WINDOW]
        for j in range(WINDOW):
            key += words.code[at + j].astype(np.uint64) * FACTORS[j]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    left, right = at[order[:-1][same]], at[order[1:][same]]
    equal = words.text[left] == words.text[right]
    for j in range(WINDOW):
        equal &= words.code[left + j] == words.code[right + j]
    if equal.all():
        twice = np.union1d(left, right)
    else:
        rows = np.column_stack([words.text[at], *(words.code[at + j] for j in range(WINDOW))])
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[count[inverse.ravel()] > 1]
    covered = np.zeros(len(words.code) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return np.bincount(words.text[np.cumsum(covered[:-1]) > 0], minlength=texts)


def measures(slab: Slab, words: Runs) -> np.ndarray:
    """The columns MEASURES of each text."""
    return np.column_stack([
        np.bincount(words.text, minlength=len(slab)), slab.total(WORD[slab.data] & STARTS[slab.data]), slab.total(SYMBOLS[slab.data]), repeated_lines(slab, words), repeated_words(words, len(slab)),
    ])


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Whether the fixed rules reject texts of these measures."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def mixed(h: np.ndarray) -> np.ndarray:
    """Places in a table of weights, from the upper bits of multiplied hashes."""
    with np.errstate(over="ignore"):
        return ((h * FACTORS[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def word_grams(words: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of words and of pairs of neighbours."""
    hashes = np.fromiter((zlib.crc32(w) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))[words.code]
    pair = np.flatnonzero(words.text[1:] == words.text[:-1])
    with np.errstate(over="ignore"):
        pairs = hashes[pair] * FACTORS[1] + hashes[pair + 1] * FACTORS[2]
    pairs[hashes[pair] == hashes[pair + 1]] = 1  # a word twice in a row is one pair, whatever the word
    return np.concatenate([words.text, words.text[pair]]), np.concatenate([mixed(hashes), mixed(pairs)])


def byte_grams(slab: Slab):
    """(length, places, whole) for strings of each length: the place of that which begins at each byte, and
    whether it lies within one text."""
    wide = slab.data.astype(np.uint64)
    left = np.repeat(slab.offsets[1:], np.diff(slab.offsets)) - np.arange(len(wide))
    h = wide
    for length in range(2, max(LENGTHS) + 1):
        if len(h) < 2:
            return
        h = (h[:-1] << np.uint64(8)) | wide[length - 1 :]
        if length in LENGTHS:
            yield length, mixed(h + np.uint64(length << 40)), left[: len(h)] >= length


def means(text: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """Mean value of each text, 0 of those without any."""
    return np.bincount(text, values, texts) / np.maximum(1, np.bincount(text, minlength=texts))


@dataclass(frozen=True)
class Model:
    """Weights of word and of string grams, the bias, and the line from logits to those of probabilities."""

    words: np.ndarray
    strings: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, slab: Slab, words: Runs) -> np.ndarray:
        """Raw logits of each text of a slab."""
        text, place = word_grams(words)
        out = self.bias + means(text, self.words[place], len(slab))
        lengths = np.diff(slab.offsets)
        filled, values, count = np.flatnonzero(lengths), np.zeros(len(slab.data)), np.zeros(len(slab), np.int64)
        for length, place, whole in byte_grams(slab):
            values[: len(place)] += np.where(whole, self.strings[place], 0.0)
            count += np.maximum(0, lengths - length + 1)
        if len(filled):
            out[filled] += np.add.reduceat(values, slab.offsets[filled]) / np.maximum(1, count[filled])
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, rounded so that it does not depend on the company of a text."""
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30))), 9)


#: Bytes of a slab of training texts, whose grams take some hundred times as much.
TRAINING_SLAB = 1 << 17


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of training texts: where each one's grams begin, the grams' places, those of strings behind those of
    words, and the share of the text's grams that each is."""
    lengths, places, shares = [np.zeros(1, np.int64)], [], []
    for slab in slabs(pa.array(texts, pa.string()), TRAINING_SLAB):
        text, place = word_grams(runs(slab, WORD))
        grams = [(text << (BITS + 1)) | place]
        of = np.repeat(np.arange(len(slab)), np.diff(slab.offsets))
        for _, place, whole in byte_grams(slab):
            grams.append((of[: len(place)][whole] << (BITS + 1)) | (1 << BITS) | place[whole])
        key, count = np.unique(np.concatenate(grams), return_counts=True)
        of, where = key >> (BITS + 1), key & ((1 << (BITS + 1)) - 1)
        group = of * 2 + (where >> BITS)
        lengths.append(np.bincount(of, minlength=len(slab)))
        places.append(where.astype(np.int32))
        shares.append((count / np.bincount(group, count, 2 * len(slab))[group]).astype(np.float32))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.cumsum(np.concatenate(lengths)), join(places, np.int32), join(shares, np.float32)


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 2.0, batch: int = 64, decay: float = 1e-6, seed: int = 13) -> Model:
    """Stochastic gradient descent with a step of its own for each weight; with one class only, a constant at its rate."""
    y = np.array(labels, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    weights, bias = np.zeros(2 << BITS), float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Model(weights[: 1 << BITS], weights[1 << BITS :], bias)
    bounds, places, shares = features(texts)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    aside[rng.permutation(len(y))[: max(2, len(y) // 5)]] = True
    squares, bias_square = np.full(2 << BITS, 1e-8), 1e-8
    # Both classes count alike, so that the rarer one is learned too; the line below restores their shares.
    balance = np.where(y > 0, 0.5 / max(1e-9, y[~aside].mean()), 0.5 / max(1e-9, 1 - y[~aside].mean()))
    inside = np.flatnonzero(~aside)
    cells = lambda part: np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(inside), max(1, len(inside) // batch)):
            at = cells(part)
            of = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
            z = bias + np.bincount(of, weights[places[at]] * shares[at], len(part))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * balance[part] / len(part)
            g = np.bincount(places[at], e[of] * shares[at], 2 << BITS) + decay * weights
            squares += g * g
            weights -= rate * g / np.sqrt(squares)
            bias_square += e.sum() ** 2
            bias -= 0.1 * e.sum() / np.sqrt(bias_square)
    z = np.array([bias + (weights[places[bounds[i] : bounds[i + 1]]] * shares[bounds[i] : bounds[i + 1]]).sum() for i in np.flatnonzero(aside)])
    slope, shift = platt(z, y[aside])
    half = 1 << BITS
    return Model(weights[:half], weights[half:], bias, slope, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the line that makes log odds of logits, by Newton steps on smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.column_stack([z, np.ones(len(z))])
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - target @ (x @ t)) + 1e-4 * float((t - [1, 0]) @ (t - [1, 0]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2e-4 * np.eye(2), x.T @ (p - target) + 2e-4 * (theta - [1, 0]))
        size = 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1600, most_chars: int = 10_000, total_chars: int = 4_000_000, seed: int = 13) -> Model:
    """Trains on at most ``sample_rows`` labelled rows for which ``usable(id)`` holds, texts of up to ``most_chars``,
    and ``total_chars`` in all.

    Both labels get half of the rows where both have so many. Null labels and ids are left out; of contradictory
    labels the lower counts; of rows that repeat an id the least text. Without labels, the model is a constant.
    """
    key, mark = "__label_id", "__label"
    known = labels.select(F.col(id_col).alias(key), F.col(label_col).cast("int").alias(mark)).where(F.col(mark).isin(0, 1) & F.col(key).isNotNull() & usable(F.col(key))).groupBy(key).agg(F.min(mark).alias(mark))
    order = (F.xxhash64(F.lit(seed), key), F.col(key))
    chosen = known.where(F.col(mark) == 0).orderBy(*order).limit(sample_rows // 2).unionByName(known.where(F.col(mark) == 1).orderBy(*order).limit(sample_rows // 2))
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, most_chars))
    picked = narrow.join(F.broadcast(chosen), F.col("i") == F.col(key)).groupBy("i").agg(F.min("text").alias("text"), F.min(mark).alias(mark))
    got = sorted(picked.withColumn("o", F.xxhash64(F.lit(seed + 1), "i")).collect(), key=lambda r: (r.o, r.i))
    upto = int(np.searchsorted(np.cumsum([len(r.text) for r in got]), total_chars, side="right"))
    return train([r.text for r in got[:upto]], [r[mark] for r in got[:upto]], seed=seed)


def judge(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, its measures, base_failed, score and kept; no shuffle.

    kept is false where the base fails, else whether the calibrated probability of a good text reaches
    ``threshold``. Null and empty texts have no words, so the base fails them; a very long one is measured whole;
    repeated rows fare alike; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for slab in slabs(batch.column(1)):
                words = runs(slab, WORD)
                counts = measures(slab, words)
                failed, score = base_failed(counts), shared.value.probability(shared.value.logits(slab, words))
                columns = [batch.column(0).slice(slab.first, len(slab)), *(pa.array(counts[:, i], pa.int64()) for i in range(len(MEASURES))), pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *MEASURES, "base_failed", "score", "kept"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, {', '.join(f'{m} long' for m in MEASURES)}, base_failed boolean, score double, kept boolean")
