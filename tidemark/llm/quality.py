"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Each token has a fixed sparse ternary index vector, drawn from its hash. Its context vector is the
sum of the index vectors of its neighbours over the training texts. Tokens are frequent words as
written and, for all others, their shape (runs of upper case, lower case, digits; other characters
as they are, repeats shortened), so unseen words still have vectors. A document is the mean of its
tokens' context and index vectors with four counts. A two-layer numpy network is trained on it, and
one temperature, fitted on rows kept aside, calibrates its probabilities. All labelled texts are learned
from: words and contexts are counted by Spark, and shards of rows are trained side by side in rounds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, broadcast_if_few, discard, materialize, short_batches

WIDTH, NONZERO, WINDOW = 48, 6, 2
STEP = 8192
#: Texts that hold a word with a row of its own, and most such words; units and epochs of the network.
LEAST, MOST, HIDDEN, EPOCHS = 12, 4000, 24, 60
TEMPERATURES = np.geomspace(0.5, 8, 41)
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1{2,}", re.DOTALL), r"\1\1"))


def shape(word: str) -> str:
    """The form of a word: Aa for Word, A!! for WORD!!, a### for word###."""
    for pattern, into in _SHAPES:
        word = pattern.sub(into, word)
    return "\x00" + word[:12]


def index_vector(token: str) -> np.ndarray:
    """The token's sparse ternary vector."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")))
    out = np.zeros(WIDTH, np.float32)
    out[rng.choice(WIDTH, NONZERO, replace=False)] = np.where(np.arange(NONZERO) % 2 == 0, 1.0, -1.0)
    return out


@dataclass
class Classifier:
    """Vocabulary rows, their vectors, the network and its temperature."""

    rows: dict[str, int]
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    centre: np.ndarray
    scale: np.ndarray
    temperature: float
    prior: float

    def __post_init__(self):
        self._cache = None

    def __getstate__(self):
        return self.__dict__ | {"_cache": None}

    def row_of(self, word: str) -> int:
        """The word's own row, its shape's, or that of unknown shapes."""
        got = self.rows.get(word)
        return got if got is not None else self.rows.get(shape(word), 0)

    def features(self, text: str) -> np.ndarray:
        """Pooled vectors and counts of a whole text, in steps of bounded size."""
        if self._cache is None:
            self._cache = BoundedCache(self.row_of, 150_000)
        words = text.split()
        total = np.zeros(self.vectors.shape[1])
        look = self._cache
        for i in range(0, len(words), STEP):
            total += self.vectors[[look[w] for w in words[i : i + STEP]]].sum(axis=0)
        n = max(1, len(words))
        counts = (np.log1p(len(words)), len(set(words)) / n, len(text) / n / 10, text.count("\n") / n)
        return np.concatenate([total / n, counts])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Raw network outputs of feature rows."""
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities of label 1; 0 for texts without words."""
        real = [i for i, t in enumerate(texts) if t and not t.isspace()]
        out = np.zeros(len(texts))
        if real and not self.rows:
            out[real] = self.prior
        elif real:
            z = self.logits(np.stack([self.features(texts[i]) for i in real])) / self.temperature
            out[real] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def random_indexing(texts: list[str], least: int = LEAST, most: int = MOST) -> tuple[dict[str, int], np.ndarray]:
    """Token rows and their vectors, context beside index. Words in at least ``least`` texts, at most
    ``most`` of them, keep rows of their own; shapes seen twice have rows too; row 0 is for the rest."""
    df = Counter(w for t in texts for w in set(t.split()))
    kept = sorted((w for w, c in df.items() if c >= least), key=lambda w: (-df[w], w))[:most]
    shapes = Counter(s for w, c in df.items() for s in [shape(w)])
    names = ["\x00?", *kept, *sorted(s for s, c in shapes.items() if c >= 2 and s != "\x00?")[: 4 * most]]
    rows = {t: i for i, t in enumerate(names)}
    index = np.stack([index_vector(t) for t in names])
    context = np.zeros_like(index)
    look = BoundedCache(lambda w: rows[w] if w in rows else rows.get(shape(w), 0), 300_000)
    for t in texts:
        r = np.array([look[w] for w in t.split()], np.int64)
        for d in range(1, WINDOW + 1):
            if len(r) > d:
                np.add.at(context, r[d:], index[r[:-d]])
                np.add.at(context, r[:-d], index[r[d:]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return rows, np.hstack([context / np.where(norm > 0, norm, 1), index / np.sqrt(NONZERO)]).astype(np.float32)


def constant(prior: float) -> Classifier:
    """A model without words that scores every text with words at one rate."""
    return Classifier({}, np.zeros((1, 2 * WIDTH), np.float32), (), np.zeros(1), np.ones(1), 1.0, prior)


def first_layers(width: int, hidden: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The random weights at which training begins."""
    return [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]


def descend(w: list[np.ndarray], z: np.ndarray, y: np.ndarray, inside: np.ndarray, epochs: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights after so many epochs of Adam over the rows ``inside``, in batches of about 64."""
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    w = list(w)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(inside), max(1, len(inside) // 64)):
            h = np.tanh(z[part] @ w[0] + w[1])
            e = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[part]) / len(part)
            back = np.outer(e, w[2]) * (1 - h**2)
            grads = [z[part].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ e + 1e-4 * w[2], np.array([e.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def losses(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of log losses at each of TEMPERATURES."""
    signed = -np.where(y > 0, raw, -raw)
    return np.array([float(np.logaddexp(0, signed / t).sum()) for t in TEMPERATURES])


def train(texts: list[str], labels: list[int], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> Classifier:
    """Fits vectors, network and temperature; with one class only, a constant at its rate."""
    y = np.array(labels, float)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return constant(prior)
    rows, vectors = random_indexing(texts)
    model = Classifier(rows, vectors, (), np.zeros(1), np.ones(1), 1.0, prior)
    x = np.stack([model.features(t) for t in texts])
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    aside[rng.permutation(len(y))[: max(1, len(y) // 5)]] = True
    model.centre, model.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    z = (x - model.centre) / model.scale
    model.layers = tuple(descend(first_layers(z.shape[1], hidden, rng), z, y, np.flatnonzero(~aside), epochs, rng))
    model.temperature = float(TEMPERATURES[losses(model.logits(x[aside]), y[aside]).argmin()])
    return model


def vocabulary(texts: DataFrame, least: int = LEAST, most: int = MOST) -> dict[str, int]:
    """The token rows that `random_indexing` gives, from the words of every text: words are counted in tasks, and only
    those that keep rows, and the shapes, reach the driver."""

    def words(batches):
        for batch in batches:
            df = Counter(w for t in batch.column(0).to_pylist() for w in set(t.split()))
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    def shapes(batches):
        for batch in batches:
            found = Counter(map(shape, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["shape", "n"])

    df = materialize(texts.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    kept = [r.word for r in df.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]
    forms = df.select("word").mapInArrow(shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n")).where("n >= 2").where(F.col("shape") != "\x00?")
    names = ["\x00?", *kept, *(r["shape"] for r in forms.orderBy("shape").limit(4 * most).collect())]
    discard(df)
    return {t: i for i, t in enumerate(names)}


def indexed(texts: DataFrame, rows: dict[str, int]) -> np.ndarray:
    """The vectors that `random_indexing` gives to the rows, context beside index, from every text: contexts are whole
    numbers, summed in tasks first, so their order does not matter."""
    index = np.stack([index_vector(t) for t in rows])
    shared = texts.sparkSession.sparkContext.broadcast((rows, index))

    def contexts(batches):
        rows, index = shared.value
        # One row more, of zeros, stands between texts.
        gap = len(index)
        at = np.vstack([np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO], np.zeros((1, NONZERO), np.int64)])
        signs = np.vstack([np.take_along_axis(index, at[:gap], axis=1), np.zeros((1, NONZERO), np.float32)])
        look = BoundedCache(lambda w: rows[w] if w in rows else rows.get(shape(w), 0), 150_000)
        total = np.zeros((gap + 1) * WIDTH)
        for batch in batches:
            parts = []
            for t in batch.column(0).to_pylist():
                parts += [np.array([look[w] for w in t.split()], np.int64), np.full(WINDOW, gap)]
            r = np.concatenate([*parts, np.zeros(0, np.int64)])
            for i in range(0, len(r), 16 * STEP):
                some = r[max(0, i - WINDOW) : i + 16 * STEP]
                for d in range(1, WINDOW + 1):
                    # Pairs whose second word was in the step before have been counted there.
                    new = max(0, min(i, WINDOW) - d)
                    x, y = some[new:][:-d], some[new:][d:]
                    for a, b in ((x, y), (y, x)):
                        total += np.bincount((a[:, None] * WIDTH + at[b]).ravel(), signs[b].ravel(), len(total))
        sums = total.reshape(-1, WIDTH)[:gap]
        held = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(sums[held, j].astype(np.int64)) for j in range(WIDTH))], ["row", *columns])

    columns = [f"c{j}" for j in range(WIDTH)]
    summed = texts.select("text").mapInArrow(contexts, "row int, " + ", ".join(f"{c} long" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    context = np.zeros_like(index)
    context[summed["row"].to_numpy()] = summed[columns].to_numpy()
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return np.hstack([context / np.where(norm > 0, norm, 1), index / np.sqrt(NONZERO)]).astype(np.float32)


def train_all(known: DataFrame, count: int, prior: float, shard_rows: int, hidden: int = HIDDEN, epochs: int = EPOCHS, rounds: int = 6, seed: int = 11) -> Classifier:
    """`train` over the rows (i, text, mark) of a table of any size.

    Rows are dealt by a hash of their ids into shards of about ``shard_rows``. In each of ``rounds`` every shard
    goes on from the common weights for its part of the epochs, and the driver takes the mean of what they reach;
    every row is in each epoch but the fifth kept aside for the temperature. The driver sees sums and weights, no row.
    """
    short_batches(known.sparkSession)
    rows = vocabulary(known)
    model = Classifier(rows, indexed(known, rows), (), np.zeros(1), np.ones(1), 1.0, prior)
    shared = known.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            x = [shared.value.features(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3, 4)), pa.array(x, pa.binary())], ["shard", "order", "aside", "mark", "x"])

    drawn = F.xxhash64(F.lit(seed), "i")
    dealt = known.select(F.pmod(drawn, F.lit(max(1, -(-count // shard_rows)))).cast("int").alias("shard"), "text", drawn.alias("order"), (F.pmod(F.xxhash64(F.lit(seed + 1), "i"), F.lit(5)) == 0).alias("aside"), "mark")
    dealt = materialize(dealt.mapInArrow(features, "shard int, order long, aside boolean, mark int, x binary"))

    def each(work) -> list[tuple[np.ndarray, ...]]:
        """What ``work(shard, x, y, aside)`` gives for every shard, in their order: arrays of doubles."""

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("order")
            x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(table.num_rows, -1).astype(float)
            got = work(table["shard"][0].as_py(), x, table["mark"].to_numpy().astype(float), table["aside"].to_numpy())
            return pa.table({"shard": table["shard"][:1], "got": pa.array([[np.asarray(g, float).tobytes() for g in got]], pa.list_(pa.binary()))})

        out = dealt.groupBy("shard").applyInArrow(run, "shard int, got array<binary>").collect()
        return [tuple(np.frombuffer(g) for g in r.got) for r in sorted(out, key=lambda r: r["shard"])]

    sums = each(lambda shard, x, y, aside: ([(~aside).sum()], x[~aside].sum(axis=0), (x[~aside] ** 2).sum(axis=0)))
    n, one, two = (sum(s[k] for s in sums) for k in range(3))
    model.centre = one / max(1, n[0])
    model.scale = np.sqrt(np.maximum(0, two / max(1, n[0]) - model.centre**2)) + 1e-3
    w = first_layers(len(one), hidden, np.random.default_rng(seed))
    for turn in range(rounds):
        todo = epochs * (turn + 1) // rounds - epochs * turn // rounds

        def go_on(shard, x, y, aside, w=w, turn=turn, todo=todo, centre=model.centre, scale=model.scale):
            inside = np.flatnonzero(~aside)
            reached = descend(w, (x - centre) / scale, y, inside, todo, np.random.default_rng([seed, turn, shard]))
            return [len(inside)], *(a.ravel() for a in reached)

        got = each(go_on)
        w = [(sum(g[0][0] * g[k + 1] for g in got) / max(1, sum(g[0][0] for g in got))).reshape(a.shape) for k, a in enumerate(w)]
    model.layers = tuple(w)
    layers, centre, scale = model.layers, model.centre, model.scale
    found = each(lambda shard, x, y, aside: (losses(np.tanh((x[aside] - centre) / scale @ layers[0] + layers[1]) @ layers[2] + layers[3], y[aside]),))
    model.temperature = float(TEMPERATURES[sum(f[0] for f in found).argmin()])
    discard(dealt)
    return model


def learn(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shard_rows: int = 4096, shard_chars: int = 1 << 24, seed: int = 11) -> Classifier:
    """Trains on every labelled row for which ``usable(id)`` holds, whole texts of any length. Null labels and texts
    without characters are left out; of contradictory labels the lower counts, of rows that repeat an id the least text.

    Up to ``shard_rows`` rows with ``shard_chars`` characters in all are one shard, which the driver trains on itself.
    """
    key, mark = "__label_id", "__label"
    known = labels.select(F.col(id_col).alias(key), F.col(label_col).cast("int").alias(mark)).where(F.col(mark).isin(0, 1) & F.col(key).isNotNull() & usable(F.col(key))).groupBy(key).agg(F.min(mark).alias(mark))
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).withColumn("chars", F.length("text")).where("chars >= 1")
    known = broadcast_if_few(known)
    both = narrow.join(known, F.col("i") == F.col(key)).select("i", "text", "chars", F.col(mark).alias("mark"))
    # One row an id, the least text; only the texts of ids that are repeated are compared.
    facts = materialize(both.groupBy("i").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("mark").alias("mark")))
    repeated = facts.where("n > 1").select(F.col("i").alias("__again"))
    if not repeated.isEmpty():
        repeated = broadcast_if_few(repeated)
        again = both.join(repeated, F.col("i") == F.col("__again"), "left_semi").groupBy("i").agg(F.min("text").alias("text"), F.min("mark").alias("mark"))
        both = both.select("i", "text", "mark").join(repeated, F.col("i") == F.col("__again"), "left_anti").unionByName(again)
    size = facts.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("mark").alias("good")).first()
    if size.n <= shard_rows and (size.chars or 0) <= shard_chars:
        got = sorted((r.i, r.text, r.mark) for r in both.collect())
        return train([g[1] for g in got], [g[2] for g in got], seed=seed)
    if size.good in (0, size.n):
        return constant(size.good / size.n)
    texts = materialize(both.select("text", "i", "mark"))
    model = train_all(texts, size.n, size.good / size.n, shard_rows, seed=seed)
    discard(texts, facts)
    return model


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row's id and calibrated score, from the text alone; no shuffle. Null, empty and blank texts score 0;
    a very long text is scored whole, in steps; repeated rows score alike; an empty table gives no rows."""
    short_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(broadcast.value.scores(batch.column(1).to_pylist()), pa.float64())], [id_col, score_col])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, {score_col} double")


def kept(docs: DataFrame, model: Classifier, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``.

    Null, empty and blank texts score 0; repeated rows fare alike; a very long text is scored whole; an
    empty table stays empty. Columns of any names pass through."""
    short_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(broadcast.value.scores(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
