"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two sets of a and b
shingles with Jaccard 0.8 or more differ in at most (a + b) / 9 of them, and b is at most 5 a / 4.

Parity sketch: tokens are dealt to p parts by their leading bits, and each part is the XOR of its
tokens' hashes. A token that only one set has changes one part, so the number of differing parts is
at most the symmetric difference. Pigeonhole: in any order common to all, the first (a + b) / 9 + 1
non-empty parts of both sets share one. These are the join keys. p grows with the size band, with two
to four tokens a part; a set near the upper end of its band has keys in the next band too, so every
similar pair meets in one. A part is shared only by documents with the very same tokens in it, so
those that share a mere passage share few parts; the common order puts what a sample shows to be
frequent last, so that even these make few large buckets.

A second sketch of four to eight bits a token, in which each token flips one bit, bounds the
symmetric difference from below by its Hamming distance and drops candidates before texts are
compared. Those left are verified on their whole shingle sets.

Copies with equal sets are one class from the start. Each class is first compared with one earlier
class only, the one it shares most keys with; linked ones become one component. Then those that share
a key but lie in different components are compared. No pair of these ever becomes a row: the task that
has a bucket compares whole sketches and returns, for each member that is close to another, one edge
to the first of those it hangs together with. The families so found, all close pairs inside them, get
their texts once; the task that has a family compares whole shingle sets and returns at most one edge
a member. Buckets and families of more than a bounded size are cut into blocks, of one component
where that is large, and only blocks of different components meet. So no link between different
components is lost, a group of n near copies takes about n comparisons of texts, and what shuffles
grows with the members of buckets, not with their pairs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, broadcast_if_few, discard, materialize, short_batches
from tidemark.operators.graph import components

WORDS = 5
SLICE = 1 << 18
#: In bands up to this many tokens each is a part of its own.
SMALL = 64
#: Where the size bands begin: powers of the square root of two, rounded up.
BOUNDS = [1, *(isqrt((1 << j) - 1) + 1 for j in range(1, 96))]
LEAST_BITS = 1024
#: A bucket or family with more members is compared in blocks, and so is one with more shingles in all:
#: a sketch has up to a byte a shingle, a text and its set some fifteen.
CELL, SKETCHED, VERIFIED = 8192, 1 << 25, 1 << 21
#: The side of rows that are compared with all others of their cell.
BOTH = 2
# The white space that divides words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes (of A-Z those of a-z), whether a byte is white space, and the shingle's factors."""
    values = np.arange(1, 257, dtype=np.uint64)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return values, space, np.random.default_rng(20240607).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _factors(n: int) -> np.ndarray:
    """A random 64-bit factor for every place in a word, at least ``n`` of them."""
    if len(_FACTORS[0]) < n:
        _FACTORS[0] = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _FACTORS[0]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``: the sum of its bytes' values, each times the factor of
    its place, scrambled. Any two different words collide with a chance of 2**-56 at most."""
    values, space, _ = _tables()
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], space[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    at = np.flatnonzero(~gap[1:-1])
    terms = values[raw[at]] * _factors(int(lengths.max()))[at - np.repeat(starts, lengths)]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = _tables()[2]
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, starts = word_hashes(b" ".join(data))
    edges = np.cumsum([0] + [len(d) + 1 for d in data])
    first = np.searchsorted(starts, edges)
    n = len(words) - WORDS + 1
    rolled = mixed(sum((words[i : i + n] * factors[i] for i in range(WORDS)), np.zeros(max(n, 0), np.uint64))) if n > 0 else words[:0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(rolled[a : b - WORDS + 1])
        elif b > a:
            yield mixed((words[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(b - a))
        else:
            yield words[:0]


def band_of(m: int) -> int:
    """The size band of a set: sizes from one power of the square root of two to the next."""
    return bisect_right(BOUNDS, m) - 1


def schemes(m: int) -> Iterator[tuple[int, int]]:
    """The bands in which a set has keys, each with the number of parts that decide there.

    Of its partners in a band the largest sets the bound: with b tokens it differs in (m + b) / 9 at most.
    """
    j = band_of(m)
    yield j, (m + min(5 * m // 4, BOUNDS[j + 1] - 1)) // 9 + 1
    if 5 * m >= 4 * BOUNDS[j + 1]:
        yield j + 1, (m + 5 * m // 4) // 9 + 1


def parts_of(band: int) -> int:
    """The number of parts of a band, 0 where each token is a part of its own.

    The more tokens a part has, the less often documents that only share a passage share a part; but
    the largest sets must fill more parts than they can differ in, by eight deviations at least.
    """
    top = BOUNDS[band + 1]
    return 0 if top <= SMALL else top // 2 if top <= 128 else top // 3 if top <= 512 else int(top / 3.8)


def part_keys(tokens: np.ndarray, band: int) -> np.ndarray:
    """Keys of the non-empty parts in a band; tokens come sorted, so those of a part are neighbours."""
    salt, parts = np.uint64((band + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1), parts_of(band)
    if not parts:
        return mixed(tokens ^ salt)
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mixed(mixed(np.bitwise_xor.reduceat(mixed(tokens), at) + salt) ^ part[at])


def join_keys(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The parts that decide, in the common order: by frequency in the sample, then by value."""
    m = len(tokens)
    if not m:
        return tokens
    out = []
    for band, need in schemes(m):
        keys = part_keys(tokens, band)
        if len(keys) < need:
            raise ValueError(f"{m} tokens fill only {len(keys)} parts; {need} are needed for an exact join")
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], keys), len(frequent[0]) - 1)
            often = np.where(frequent[0][at] == keys, frequent[1][at], 0)
            keys = keys[np.lexsort((keys, often))[:need]]
        elif need < len(keys):
            keys = np.partition(keys, need - 1)[:need]
        out.append(keys)
    return np.concatenate(out)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """The bit sketch as signed 64-bit words: four to eight bits a token, 1024 at least; each token flips one.

    Its length is a power of two and a token's bit is its hash modulo the length, so the XOR of both
    halves is the sketch of half the length.
    """
    size = max(LEAST_BITS, 4 << (len(tokens).bit_length() - 1) if len(tokens) else 0)
    bits = np.bincount((mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def halved(bits: np.ndarray, times: int) -> np.ndarray:
    """The sketch of half the length, so many times."""
    for _ in range(times):
        bits = bits[..., : bits.shape[-1] // 2] ^ bits[..., bits.shape[-1] // 2 :]
    return bits


def close_links(cells, ids, families, sides, sizes, bits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Edges (a, b) that join, within each cell, the ids that chains of close pairs connect: one an id.

    A pair is close whose families differ, whose sides differ or are BOTH, and whose sizes and sketches
    allow a link. Rows come sorted by cell, row i's sketch ending at ``ends[i]`` of ``bits``; all pairs
    at one distance in that order are compared at once.
    """
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    lengths = np.diff(np.concatenate([[0], ends]))
    least = np.repeat(np.minimum.reduceat(lengths, starts), np.diff([*starts, len(cells)]))
    labels = np.arange(len(cells))

    def connect(x: np.ndarray, y: np.ndarray) -> None:
        while True:
            one, two = labels[x], labels[y]
            apart = one != two
            if not apart.any():
                return
            x, y, one, two = x[apart], y[apart], one[apart], two[apart]
            np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]

    for width in np.unique(least):
        of = np.flatnonzero(least == width)
        sketch = np.empty((len(of), width), np.uint64)
        for length in np.unique(lengths[of]):
            at = np.flatnonzero(lengths[of] == length)
            raw = bits[(ends[of[at]] - length)[:, None] + np.arange(length)]
            sketch[at] = halved(raw, int(length // width).bit_length() - 1)
        c, f, n, s = cells[of], families[of], sizes[of], sides[of]
        i, d = np.arange(len(of)), 0
        while True:
            d += 1
            i = i[i < len(of) - d]
            i = i[c[i] == c[i + d]]
            if not len(i):
                break
            j = i + d
            able = (f[i] != f[j]) & ((s[i] != s[j]) | (s[i] == BOTH)) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            a, b = i[able], j[able]
            step = max(1, (1 << 22) // int(width))
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                near = 9 * np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                if near.any():
                    connect(of[x[near]], of[y[near]])
    joined = np.flatnonzero(labels != np.arange(len(cells)))
    pairs = np.stack([ids[labels[joined]], ids[joined]], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def verified_links(ids, families, sides, texts: list[str | None]) -> list[tuple[int, int]]:
    """Pairs of a cell that link, one for each time that two families become one; pairs of one family,
    or of the same side unless that is BOTH, are not compared. Tokens are numbered within the cell, so a
    set is compared with all smaller ones by looking their numbers up in its marks."""
    sets = list(shingle_sets(texts))
    rows = np.array([i for i in np.argsort([len(s) for s in sets], kind="stable") if len(sets[i])], np.int64)
    if len(rows) < 2:
        return []
    sizes, side, id_ = np.array([len(sets[i]) for i in rows]), sides[rows], ids[rows]
    roots = np.unique(families[rows], return_inverse=True)[1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)[1]
    marks, found = np.zeros(int(numbers.max()) + 1, bool), []
    for i in range(1, len(rows)):
        lo = int(np.searchsorted(sizes[:i], -(-4 * sizes[i] // 5)))
        others = lo + np.flatnonzero((roots[lo:i] != roots[i]) & ((side[lo:i] != side[i]) | (side[i] == BOTH)))
        if not len(others):
            continue
        own = numbers[offsets[i] : offsets[i + 1]]
        marks[own] = True
        if 2 * len(others) > i - lo:
            both = np.add.reduceat(marks[numbers[offsets[lo] : offsets[i]]], offsets[lo:i] - offsets[lo], dtype=np.int64)[others - lo]
        else:
            both = np.array([np.count_nonzero(marks[numbers[offsets[j] : offsets[j + 1]]]) for j in others])
        marks[own] = False
        for j in others[100 * both >= 80 * (sizes[i] + sizes[others] - both)]:
            if roots[i] != roots[j]:
                found.append((int(id_[i]), int(id_[j])))
                roots[roots == roots[j]] = roots[i]
    return found


def cells_of(rows: DataFrame, members: int, shingles: int) -> DataFrame:
    """Rows (key, id, c, n_shingles) dealt to cells, as (cell, side, id, c, n_shingles).

    A key within both bounds is a cell. A larger one is cut into blocks of half a cell: components of
    more than a block by their ids, the others together by their component. Each pair of its blocks is
    a cell, except those of one component, and so is each block of several components. Hence the many
    rows of one component are repeated only as often as there are blocks of others.
    """
    size = [F.count("*").alias("n"), F.sum("n_shingles").alias("w")]
    parts = F.ceil(F.greatest(2 * F.col("n") / members, 2 * F.col("w") / shingles)).cast("int")
    large = materialize(rows.groupBy("key").agg(*size).where((F.col("n") > members) | (F.col("w") > shingles)).select("key"))
    whole = rows.select(F.col("key").alias("cell"), F.lit(BOTH).alias("side"), "id", "c", "n_shingles")
    if large.isEmpty():
        return whole
    whole = rows.join(large, "key", "left_anti").select(F.col("key").alias("cell"), F.lit(BOTH).alias("side"), "id", "c", "n_shingles")
    cut = materialize(rows.join(large, "key", "left_semi"))
    by_c = materialize(cut.groupBy("key", "c").agg(*size).withColumn("own", parts))
    pool = by_c.where("own <= 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select("key", parts.alias("pool"))
    placed = cut.join(by_c.where("own > 1").select("key", "c", "own"), ["key", "c"], "left").join(pool, "key", "left")
    alone = F.when(F.col("own").isNotNull(), F.col("c"))
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), "own")).otherwise(F.pmod(F.xxhash64("c"), "pool"))
    placed = materialize(placed.select("key", F.concat_ws(":", F.coalesce(alone.cast("string"), F.lit("-")), number.cast("string")).alias("block"), alone.alias("alone"), "id", "c", "n_shingles"))
    blocks = placed.select("key", "block", "alone").distinct()
    one, two = (blocks.select("key", F.col("block").alias(f"b{i}"), F.col("alone").alias(f"a{i}")) for i in (1, 2))
    pairs = one.join(two, "key").where(((F.col("b1") < F.col("b2")) & ~F.coalesce(F.col("a1") == F.col("a2"), F.lit(False))) | ((F.col("b1") == F.col("b2")) & F.col("a1").isNull()))
    pairs = pairs.select("key", F.xxhash64("key", "b1", "b2").alias("cell"), "b1", "b2")
    at = F.explode(F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.col("b1").alias("block"), F.lit(BOTH).alias("side")))).otherwise(F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side")))))
    seats = pairs.select("key", "cell", at.alias("at")).select("key", "cell", "at.block", "at.side")
    return whole.union(placed.join(seats, ["key", "block"]).select("cell", "side", "id", "c", "n_shingles"))


def _by_cell(cells: DataFrame, compare: Callable[[pa.Table], list[tuple[int, int]] | np.ndarray]) -> DataFrame:
    """The edges (a, b) that ``compare`` finds in whole cells, several at a time, each held by one task."""

    def run(batches):
        held = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = here if held is None else pa.concat_tables([held, here])
            cell = here["cell"].to_numpy()
            end = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            held = here.slice(end)
            if end:
                yield edges(here.slice(0, end))
        if held is not None and held.num_rows:
            yield edges(held)

    def edges(t: pa.Table) -> pa.RecordBatch:
        pairs = np.array(compare(t), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _close(t: pa.Table) -> np.ndarray:
    lists = t["bits"].combine_chunks()
    ends = lists.offsets.to_numpy()
    columns = (t[c].to_numpy() for c in ("cell", "id", "c", "side", "n_shingles"))
    return close_links(*columns, lists.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]], ends[1:] - ends[0])


def _verified(t: pa.Table) -> list[tuple[int, int]]:
    cell, found = t["cell"].to_numpy(), []
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
        part = t.slice(a, b - a)
        found += verified_links(part["id"].to_numpy(), part["c"].to_numpy(), part["side"].to_numpy(), part["text"].to_pylist())
    return found


def _links_across(placed: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components that share a bucket: enough to join all that link.

    Buckets with the very same members would find the same pairs; one of them is compared.
    """
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("h2")]
    contested = placed.groupBy("key").agg(*members, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    rows = materialize(placed.join(contested, "key").join(prints.select("id", "n_shingles"), "id").select("key", "id", "c", "n_shingles"))
    cells = cells_of(rows, CELL, SKETCHED).join(prints.select("id", "n_shingles", "bits"), ["id", "n_shingles"])
    close = materialize(_by_cell(cells.select("cell", "id", "c", "side", "n_shingles", "bits"), _close).distinct())
    if close.isEmpty():
        return close
    families = components(close).select("id", F.col("component").alias("key"))
    of = rows.select("id", "c", "n_shingles").distinct().join(families, "id").select("key", "id", "c", "n_shingles")
    cells = cells_of(materialize(of), CELL, VERIFIED).join(texts, "id")
    found = materialize(_by_cell(cells.select("cell", "id", "c", "side", "text"), _verified))
    discard(rows, close)
    return found


def _slices(batch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of some SLICE characters each."""
    texts, start, size = batch.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def sample_frequencies(docs: DataFrame, rows: int, seed: int, least: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Parts that at least ``least`` of a bounded sample have (three documents at least), and how many do.

    They only set the order of the keys: any sample gives the same result. Their number is at most
    1 / ``least`` times a document's parts.
    """

    def run(batches):
        for batch in batches:
            for _, texts in _slices(batch):
                keys = [part_keys(s, k) for s in shingle_sets(texts) if len(s) for k, _ in schemes(len(s))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64))], ["key"])

    sample = bounded_sample(docs, "id", rows, seed, 20_000)
    counted = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    got = counted.where(F.col("n") >= max(3, int(least * rows))).toPandas()
    keys = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def fingerprints(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n_shingles, class digest, parity bits and join keys of every row of (id, text); ``often`` has
    those of the keys that are frequent in the sample."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch):
                sizes, classes, bits, keys, often = [], [], [], [], []
                for tokens in shingle_sets(texts):
                    sizes.append(len(tokens))
                    classes.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    bits.append(parity_bits(tokens))
                    mine = join_keys(tokens, shared.value)
                    hot = np.isin(mine, shared.value[0])
                    keys.append(mine[~hot].view(np.int64))
                    often.append(mine[hot].view(np.int64))
                as_lists = lambda arrays: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(a) for a in arrays]), pa.int32()), pa.array(np.concatenate(arrays)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), as_lists(bits), as_lists(keys), as_lists(often)], ["id", "n_shingles", "class", "bits", "keys", "often"])

    return docs.mapInArrow(run, "id long, n_shingles long, class binary, bits array<long>, keys array<long>, often array<long>")


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: first by sizes and parity bits, then by their whole shingle sets."""
    one = prints.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba"))
    two = prints.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), xor)
    # Sets that can be similar differ in size by a quarter, so one sketch is at most twice as long as the other.
    fitted = lambda c, other: F.when(F.size(c) > F.size(other), half(F.col(c))).otherwise(F.col(c))
    distance = F.aggregate(F.transform(F.zip_with(fitted("ba", "bb"), fitted("bb", "ba"), xor), F.bit_count), F.lit(0), lambda s, x: s + x)
    able = pairs.join(one, "a").where("na IS NOT NULL").join(two, "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")).where(9 * distance <= F.col("na") + F.col("nb"))
    able = materialize(able.select("a", "b").distinct())
    wanted = able.select(F.col("a").alias("id")).union(able.select(F.col("b").alias("id"))).distinct()
    few = materialize(texts.join(wanted, "id", "left_semi"))

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a not in known:
                    known.clear()
                    (known[a],) = shingle_sets([text_a.as_py()])
                x, (y,) = known[a], shingle_sets([text_b.as_py()])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = able.join(few.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(few.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000, seed: int = 29) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles and component_id, the smallest id that links lead to.

    Rows without words have no shingles and stand alone. Rows that repeat an id are one document: what
    links to one of them links to all. Rows without an id take no part and have a null component.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where(F.col("id").isNotNull())
    prints = materialize(fingerprints(rows, sample_frequencies(named, sample_rows, seed)))
    member = prints.where("id IS NOT NULL AND n_shingles > 0").select("id", "class", "n_shingles", "bits", "keys", "often")
    classes = materialize(member.groupBy("class").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    repeated = broadcast_if_few(classes.where("rep < last").select("class", "rep"))
    copies = member.select("id", "class").join(repeated, "class").where("id <> rep").select("id", "class")
    reps = member.join(broadcast_if_few(copies), ["id", "class"], "left_anti")

    ends = [F.min("id"), F.max("id")]
    key = Window.partitionBy("key")
    rare = reps.select(F.explode("keys").alias("key"), "id").withColumn("leader", ends[0].over(key)).withColumn("last", ends[1].over(key))
    hot = reps.select(F.explode("often").alias("key"), "id")
    # Frequent keys may have any part of all rows: their ends are partial aggregates, joined back.
    shared = broadcast_if_few(hot.groupBy("key").agg(ends[0].alias("leader"), ends[1].alias("last")).where("leader < last").select("key", "leader"))
    buckets = materialize(rare.where("leader < last").select("key", "id", "leader").distinct().union(hot.join(shared, "key").select("key", "id", "leader").distinct()))
    first = buckets.where("id > leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    first = materialize(first.groupBy("id").agg(F.max(F.struct("n", -F.col("leader"))).alias("m")).select((-F.col("m.col2")).alias("a"), F.col("id").alias("b")))
    brief, texts = reps.select("id", "n_shingles", "bits"), named
    linked = materialize(_similar(first, brief, texts))
    found = components(linked)

    placed = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    more = _links_across(placed, brief, texts)
    if not more.isEmpty():
        discard(found)
        found = components(linked.union(more))
    of_class = materialize(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id")))
    discard(classes, buckets, first, linked, more, found)
    joined = prints.where("id IS NOT NULL AND n_shingles > 0").select("id", "n_shingles", "class").join(of_class, "class").select("id", "n_shingles", "component_id")
    alone = prints.where("id IS NULL OR n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return joined.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id")
