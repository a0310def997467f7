"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A word's subwords are the n-grams of 1 to 4 bytes of <word> in UTF-8, hashed into a table of embeddings.
The mean embedding of a text goes through one linear layer and a softmax. One temperature, fitted on
rows kept aside, calibrates the probabilities; below the calibrated rejection level a prediction is
marked as rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches

BUCKETS, WIDTH, STEP = 1 << 15, 12, 8192
#: Bytes of the sums that a worker keeps, and the longest words that have one.
KEPT_BYTES, KEPT_CHARS = 1 << 26, 64
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def subwords(word: str) -> list[int]:
    """Hashed n-grams of a lower-cased word; of a very long one, those of its pieces of 64 letters."""
    out = []
    for i in range(0, len(word), 64):
        w = f"<{word[i : i + 64]}>".encode("utf-8", "surrogatepass")
        out += [crc32(w[j : j + n]) % BUCKETS for n in (1, 2, 3, 4) for j in range(len(w) - n + 1)]
    return out


@dataclass
class Model:
    """Languages, the table's contribution to each logit, bias, temperature and rejection level."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def __post_init__(self):
        self._rows = self._sums = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None, "_sums": None}

    def _sum(self, word: str) -> np.ndarray:
        """The contributions of a word's subwords, and their number."""
        ids = subwords(word)
        return np.append(sum((self.table[ids[i : i + STEP]].sum(axis=0) for i in range(0, len(ids), STEP)), np.zeros(len(self.languages))), len(ids))

    def _total(self, words: list[str]) -> np.ndarray:
        """Summed contributions and number of the subwords of ``words``; sums of short words are kept for
        reuse, in a table that doubles up to KEPT_BYTES and then starts anew."""
        width = len(self.languages) + 1
        most = max(STEP, KEPT_BYTES // (8 * width))
        if self._rows is None:
            self._rows, self._sums = {}, np.zeros((STEP, width))
        rows, total = self._rows, np.zeros(width)
        for i in range(0, len(words), STEP):
            part = words[i : i + STEP]
            if len(rows) + len(part) > most:
                rows.clear()
            if len(rows) + len(part) > len(self._sums):
                self._sums = np.concatenate([self._sums, np.zeros((min(len(self._sums), most), width))])
            at = []
            for w in part:
                if len(w) > KEPT_CHARS:
                    total += self._sum(w)
                    continue
                r = rows.get(w)
                if r is None:
                    r = rows[w] = len(rows)
                    ids = subwords(w)
                    self._sums[r, :-1], self._sums[r, -1] = self.table[ids].sum(axis=0), len(ids)
                at.append(r)
            total += self._sums[at].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; und and 0 where there is no letter or nothing was learned."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total = self._total(words)
        z = (total[:-1] / total[-1] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(texts: list[str], langs: list[str], seed: int = 5, epochs: int = 4, per_text: int = 3, rate: float = 2.0, accepted_errors: float = 0.01) -> Model:
    """SGD over windows of 8 to 60 words of each text; a fifth of the texts is kept aside for calibration."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    grams: dict[str, np.ndarray] = {}

    def ids(words):
        for w in words:
            if w not in grams:
                grams[w] = np.array(subwords(w))
        return np.concatenate([grams[w] for w in words])

    examples = []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        words = WORD.findall(text.lower())
        for _ in range(per_text if words else 0):
            n = min(len(words), int(rng.integers(8, 61)))
            at = int(rng.integers(0, len(words) - n + 1))
            examples.append((i % 5 == 0, ids(words[at : at + n]), names.index(lang)))
    table, out, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(names))), np.zeros(len(names))
    inside, aside = [e for e in examples if not e[0]], [e for e in examples if e[0]] or examples
    steps, done = epochs * max(1, len(inside)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(inside)):
            _, g, k = inside[j]
            step = rate * (1 - done / steps)
            done += 1
            h = table[g].mean(axis=0)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            back = out @ p
            out -= 0.5 * step * np.outer(h, p)
            bias -= 0.05 * step * p
            unique, counts = np.unique(g, return_counts=True)
            table[unique] -= step * np.outer(counts / len(g), back) * 10
    contributions = table @ out
    raw = np.array([contributions[g].mean(axis=0) + bias for _, g, _ in aside])
    truth = np.array([k for *_, k in aside])

    def chances(temperature):
        z = raw / temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: float(-np.log(chances(t)[np.arange(len(truth)), truth] + 1e-12).mean()))
    p = chances(temperature)
    order = np.argsort(-p.max(axis=1))
    wrong = np.cumsum(p.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= accepted_errors)
    return Model(names, contributions, bias, float(temperature), float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0)


def learn(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, most_langs: int = 4000, most_chars: int = 20_000, most_texts: int = 40_000, total_chars: int = 64_000_000, seed: int = 5) -> Model:
    """Trains on at most ``per_lang`` texts of each language: those rows with a language, a text and
    ``usable(id)`` whose ids hash lowest. Of a longer text a window of ``most_chars`` characters at a
    seeded place is learned from. No language is left out: more than ``most_langs`` raise an error.

    What the driver gets is bounded over all languages together: with many of them each has fewer texts, so that
    there are ``most_texts`` at most, and their windows are shorter, so that there are ``total_chars`` at most."""
    known = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("k"), F.length(text_col).alias("c")).where(F.col("k").isNotNull() & F.col("i").isNotNull() & (F.col("c") > 0) & usable(F.col("i"))).select("i", "k")
    order = F.xxhash64(F.lit(seed), "i")
    counts = {r.k: r.n for r in known.groupBy("k").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"{lang_col} has more than {most_langs} values")
    per_lang = min(per_lang, max(1, most_texts // max(1, len(counts))))
    most_chars = min(most_chars, max(1, total_chars // max(1, per_lang * len(counts))))
    # A hash threshold per language keeps some 1.5 times what is wanted; the sort then sees only those.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_lang / n + 50 / n))]) if counts else F.lit(None).cast("map<string,double>")
    few = known.where(F.pmod(order, F.lit(1 << 30)) < share[F.col("k")] * (1 << 30))
    chosen = few.distinct().withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(order, "i"))).where(F.col("n") <= per_lang).select(F.col("i").alias("j"), "k")
    window = F.substring(F.col("text"), (F.pmod(order, F.greatest(F.length("text") - most_chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(most_chars))
    narrow = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    picked = narrow.join(F.broadcast(chosen), (F.col("i") == F.col("j")) & (F.col("l") == F.col("k"))).select("i", "k", window.alias("text"))
    got = sorted((r.i, r.text, r.k) for r in picked.groupBy("i", "k").agg(F.min("text").alias("text")).collect())
    return train([g[1] for g in got], [g[2] for g in got], seed=seed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, lang_pred, score and rejected, from the whole text alone; no shuffle. A text that is
    null or has no letter gets und with score 0 and is rejected; a very long one is read whole; repeated rows fare alike;
    an empty table gives no rows."""
    short_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [broadcast.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] < broadcast.value.reject_below or g[0] == UNKNOWN for g in got], pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
