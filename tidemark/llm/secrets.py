"""Secret scans: fixed formats, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters are trained from labelled samples: one of random
strings (hexadecimal, base 32, base 62, base 64), one of ordinary words and identifiers, among
them the distinct words of all texts. A long token whose log-likelihood ratio per character
exceeds the threshold is reported beside the fixed formats. Thresholds are calibrated apart for
tokens without digits, with one, and with more.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, short_batches

# The base formats, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: No token of fewer characters is called random.
SHORTEST, DIGIT = 16, re.compile(r"[0-9]")
WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{3,30}(?![A-Za-z])")
#: Training tokens of a label, the share of ordinary tokens that may be reported, and the steps in which scores are counted.
EACH, FALSE_ALARMS, STEPS = 6000, 0.0005, 1024

ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
IDENTIFIERS = ("get", "set", "user", "name", "value", "count", "index", "table", "column", "order", "item", "list", "total", "price", "date", "time", "file", "path", "config", "default", "handler", "request", "response", "session", "message", "update", "create", "delete", "number", "version", "release", "model", "data", "test", "http", "www", "example", "chapter", "section", "figure", "page")


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of character pairs, random over ordinary, and the thresholds per character
    of tokens with no digit, one, and more."""

    ratio: np.ndarray
    thresholds: tuple[float, float, float]

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character; -1 for a token of fewer than two different characters, so no
        run of one letter is random. A pair that speaks for random counts once however often it comes.
        """
        codes = np.minimum(np.frombuffer(token.encode("latin-1", "replace"), np.uint8), 127)
        if len(codes) < 2 or (codes == codes[0]).all():
            return -1.0
        pairs = codes[:-1].astype(np.int64) * 128 + codes[1:]
        ratios, once = self.ratio.ravel()[pairs], self.ratio.ravel()[np.unique(pairs)]
        return float((ratios[ratios < 0].sum() + once[once > 0].sum()) / len(pairs))

    def random(self, token: str) -> bool:
        """Whether the ratio calls a token random."""
        return self.score(token) > self.thresholds[digit_class(token)]


def digit_class(token: str) -> int:
    """0, 1, or 2 for more digits."""
    return min(2, len(DIGIT.findall(token)))


def random_tokens(n: int, rng: random.Random) -> list[str]:
    """Labelled positives: random strings of the usual alphabets, 16 to 64 characters."""
    return ["".join(rng.choices(ALPHABETS[i % len(ALPHABETS)], k=rng.randint(16, 64))) for i in range(n)]


def shortest_random(n: int, digits: int, rng: random.Random) -> list[str]:
    """Random strings of SHORTEST characters with so many digits, of the alphabets that HEX does not cover."""
    out = []
    for i in range(n):
        alphabet = ALPHABETS[1 + i % (len(ALPHABETS) - 1)]
        token = rng.choices(DIGIT.sub("", alphabet), k=SHORTEST)
        for at in rng.sample(range(SHORTEST), digits):
            token[at] = rng.choice(DIGIT.findall(alphabet))
        out.append("".join(token))
    return out


def ordinary_tokens(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Labelled negatives: words, and identifiers, slugs, dates and numbered names made of them."""
    words = words or list(IDENTIFIERS)
    pick = lambda: rng.choice(words if rng.random() < 0.6 else IDENTIFIERS)
    joined = (
        lambda p: "_".join(p), lambda p: "-".join(p), lambda p: "".join(x.title() for x in p), lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "_".join(p).upper(),
        lambda p: "/".join(p), lambda p: "".join(p), lambda p: "-".join(p) + f"-{rng.randint(1, 2030)}", lambda p: f"20{rng.randint(0, 29):02}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}_" + "_".join(p), lambda p: rng.choice("-=_+") * rng.randint(16, 40),
        lambda p: "_".join(p) + str(rng.randint(0, 9)), lambda p: p[0].title() + str(rng.randint(0, 9)) + "".join(x.title() for x in p[1:]), lambda p: "-".join(p[:-1]) + f"-{rng.randint(0, 9)}/" + p[-1], lambda p: "/" + "/".join(p) + "/", lambda p: (rng.choice(("-=", "+-", "=_", "/", "/=")) * 40)[: rng.randint(16, 40)],
    )
    return [joined[i % len(joined)]([pick() for _ in range(rng.randint(2, 5))]) for i in range(n)]


def transitions(tokens: list[str]) -> np.ndarray:
    """How often each pair of characters comes within the tokens."""
    codes = np.minimum(np.frombuffer("\0".join(tokens).encode("latin-1", "replace"), np.uint8), 127).astype(np.int64)
    counts = np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128).reshape(128, 128).astype(float)
    counts[0], counts[:, 0] = 0, 0
    return counts


def chain(counts: np.ndarray) -> np.ndarray:
    """Logarithms of a Markov chain's probabilities."""
    return np.log((counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True))


def split(words: list[str]) -> tuple[list[str], list[str]]:
    """Words for training in order, and those kept out of it."""
    words = sorted({w for w in words if w.isascii() and w.isalpha() and len(w) > 2})
    return [w for i, w in enumerate(words) if i % 5], words[::5]


def ordinary_scores(draft: Models, kept_out: list[str], n: int, rng: random.Random) -> tuple[list[float], list[float], list[float]]:
    """Scores, by digit class, of ordinary tokens that could be called random."""
    scores = ([], [], [])
    for t in ordinary_tokens(kept_out, n, rng):
        if len(t) >= SHORTEST:
            scores[digit_class(t)].append(draft.score(t))
    return scores


def calibrated(draft: Models, most: list[float], each: int, false_alarms: float, rng: random.Random) -> Models:
    """The draft with thresholds: of a digit class the smallest above ``most``, which as few ordinary tokens exceed as
    allowed, or midway from there to where as few of the shortest random ones are missed."""
    thresholds = []
    for digits, ordinary in enumerate(most):
        least = max(0.0, ordinary) + 0.05
        missed = sorted(draft.score(t) for t in shortest_random(each, digits, rng))
        thresholds.append(max(least, (least + missed[int(len(missed) * false_alarms)]) / 2))
    return Models(draft.ratio, tuple(thresholds))


def fit(words: list[str], seed: int = 7, each: int = EACH, false_alarms: float = FALSE_ALARMS) -> Models:
    """Trains both chains on ``each`` samples of a label, and calibrates the threshold of a digit class on
    others, made of words kept out of the training: the smallest at which at most ``false_alarms`` of the
    ordinary ones are reported, or midway from there to where as few of the shortest random ones are missed."""
    rng = random.Random(seed)
    words, kept_out = split(words)
    draft = Models(chain(transitions(random_tokens(each, rng))) - chain(transitions(ordinary_tokens(words, each, rng) + words)), (0.0, 0.0, 0.0))
    scores = ordinary_scores(draft, kept_out, 10 * each, rng)
    most = [sorted(x)[min(len(x) - 1, int(len(x) * (1 - false_alarms)))] if x else 0.0 for x in scores]
    return calibrated(draft, most, each, false_alarms, rng)


def fit_all(words: DataFrame, shards: int, seed: int = 7, each: int = EACH, false_alarms: float = FALSE_ALARMS) -> Models:
    """`fit` on a table of distinct words of any size, dealt by their hash into shards.

    Every shard makes its ordinary tokens and counts their characters and those of its words as `fit` does; the chain is
    that of the shards' mean. The thresholds come from the scores of all shards' ordinary tokens, counted in steps of
    1 / STEPS and rounded up. The driver sees counts only.
    """
    dealt = materialize(words.select(F.pmod(F.xxhash64(F.lit(seed), "word"), F.lit(shards)).cast("int").alias("shard"), "word"))

    def count(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        known, _ = split(table["word"].to_pylist())
        # Whole numbers, so that the sums do not depend on their order.
        counts = transitions(ordinary_tokens(known, each, random.Random(f"{seed}:{shard}")) + known).ravel().astype(np.int64)
        held = np.flatnonzero(counts)
        return pa.table({"pair": pa.array(held, pa.int32()), "n": counts[held]})

    counts = np.zeros(128 * 128)
    for r in dealt.groupBy("shard").applyInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n / shards
    rng = random.Random(seed)
    draft = Models(chain(transitions(random_tokens(each, rng))) - chain(counts.reshape(128, 128)), (0.0, 0.0, 0.0))

    def rate(table: pa.Table) -> pa.Table:
        _, kept_out = split(table["word"].to_pylist())
        scores = ordinary_scores(draft, kept_out, 10 * each, random.Random(f"{seed}:{table['shard'][0].as_py()}:rate"))
        bins = Counter((k, int(np.ceil(x * STEPS))) for k, part in enumerate(scores) for x in part)
        return pa.table({"digits": pa.array([k for k, _ in bins], pa.int32()), "step": pa.array([x for _, x in bins], pa.int32()), "n": pa.array(list(bins.values()), pa.int64())})

    rated = dealt.groupBy("shard").applyInArrow(rate, "digits int, step int, n long").groupBy("digits", "step").agg(F.sum("n").alias("n")).orderBy("digits", "step").collect()
    discard(dealt)
    most = []
    for digits in range(3):
        part = [r for r in rated if r.digits == digits]
        before = np.cumsum([r.n for r in part]) if part else np.zeros(0)
        most.append(part[int(np.searchsorted(before, min(before[-1] - 1, int(before[-1] * (1 - false_alarms))), "right"))].step / STEPS if part else 0.0)
    return calibrated(draft, most, each, false_alarms, rng)


def find(text: str, models: Models | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in code points, by start and then kind as listed."""
    spans = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if models is not None:
        # Both lists go forward: base spans by start, with the furthest end so far, and tokens, which do not overlap.
        base, i, reached, added = sorted((s, e) for s, _, e in spans), 0, -1, []
        for m in TOKEN.finditer(text):
            while i < len(base) and base[i][0] < m.end():
                reached = max(reached, base[i][1])
                i += 1
            if reached <= m.start() and models.random(m.group()):
                added.append((m.start(), 3, m.end()))
        spans += added
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each maximal run of overlapping spans replaced by ``mask``."""
    out, at, until = [], 0, -1
    for s, _, e in spans:
        if s >= until:
            if until >= 0:
                out.append(mask)
                at = until
            out.append(text[at:s])
            until = e
        else:
            until = max(until, e)
    return text if until < 0 else "".join([*out, mask, text[until:]])


def ordinary_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct words of all whole texts. A word of SHORTEST letters or more may itself be a secret, so it counts
    only if texts of two ids hold it."""

    def run(batches):
        for batch in batches:
            short, long = set(), set()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(WORD.findall(text or "")):
                    short.add(w) if len(w) < SHORTEST else long.add((w, i))
            yield pa.RecordBatch.from_arrays([pa.array([*short, *(w for w, _ in long)], pa.string()), pa.array([*([None] * len(short)), *(i for _, i in long)], batch.schema.field(0).type)], ["word", "i"])

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    held = narrow.mapInArrow(run, f"word string, i {narrow.schema[0].dataType.simpleString()}").groupBy("word").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return held.where((F.length("word") < SHORTEST) | (F.col("a") < F.col("b"))).select("word")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 250_000, seed: int = 7) -> Models:
    """Models whose ordinary samples hold the words of all texts: up to ``shard_words`` distinct ones are one shard,
    which the driver fits itself."""
    words = materialize(ordinary_words(docs, id_col, text_col))
    n = words.count()
    models = fit(sorted(r.word for r in words.collect()), seed) if n <= shard_words else fit_all(words, -(-n // shard_words), seed)
    discard(words)
    return models


def scan(docs: DataFrame, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text; one row per input row, no shuffle.

    Returns the id, n_assign, n_access, n_hex, n_random, base_sha256 and spans. A null or empty
    text has none: counts of 0, an empty span list and the digest of nothing. A very long text is read whole, in time
    proportional to its length; repeated rows have the same spans; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column(1):
                spans = find(text.as_py() or "", models)
                for k in range(4):
                    out[k].append(sum(x[1] == k for x in spans))
                out[4].append(hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest())
                out[5].append(joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(docs: DataFrame, models: Models | None = None, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret masked; ``chars_col`` follows where a text changed.

    Null and empty texts stay as they are, repeated rows are masked alike, a very long text is read whole
    and an empty table stays empty. Columns of any names pass through."""
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts, lengths = [], batch.column(count_at).to_pylist() if count_at is not None else []
            for i, text in enumerate(batch.column(at).to_pylist()):
                spans = find(text, models) if text else []
                texts.append(redact(text, spans, mask) if spans else text)
                if spans and lengths:
                    lengths[i] = len(texts[-1])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if count_at is not None:
                columns[count_at] = pa.array(lengths, batch.column(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
