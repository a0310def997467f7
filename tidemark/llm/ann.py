"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, rotated at random into a space of ``bits`` dimensions and reduced to
the signs there: one packed bit a dimension. With c = <signs / sqrt(bits), rotated vector>, the inner
product with a query is estimated from the bits as norm * <signs / sqrt(bits), rotated query> / c; its
error stays below norm * |query| * sqrt(1 - c * c) / c * eps / sqrt(bits - 1) but for a small chance
that falls with eps. Codes, c and norm are made once for every row.

Rows are put in order of coarse cells, fitted on a bounded sample, and written once with their codes. A search
reads that index where it lies, without a shuffle: a block of queries of bounded size goes to all tasks, and each
task takes its rows in chunks. A chunk's mean and radius bound every product with it, so queries that cannot
gain from a chunk skip it; for the others estimates are summed straight from the packed codes, one look-up a byte
in a table of the query's 256 partial sums for it. Rows whose upper bound reaches the query's bar are reranked
by their original vectors. The bar is the k-th best exact score so far, from the start that of a sample of rows,
so a task returns few rows of which most are among the best. More queries are searched in more blocks.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

QUERY_BLOCK, CHUNK, STEP = 16_384, 4096, 64
#: Rows of the sample that cells and first bars are made from, and rows a cell and cells at most.
SAMPLE, PER_CELL, MOST_CELLS = 4096, 2048, 256


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite components that are not all 0."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the smaller on ties; 0 if there are none."""
    found = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    return found.d if found else 0


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` x ``dim`` with orthonormal columns, drawn from the seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, c and norm of each row."""
    norms = np.linalg.norm(vectors, axis=1)
    rotated = (vectors / norms[:, None]) @ turn.T
    bits = rotated > 0
    return np.packbits(bits, axis=1), np.where(bits, rotated, -rotated).sum(axis=1) / np.sqrt(turn.shape[0]), norms


def _matrix(column, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cells_of(sample: np.ndarray, cells: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centres of coarse cells, by Lloyd's rounds over a sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = (sample @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    return centres


def build_index(rows: DataFrame, dim: int, bits: int, seed: int, centres: np.ndarray) -> DataFrame:
    """id, vector, code, c and norm of every row of (id, vector), and the cell whose centre is nearest."""

    def run(batches):
        turn = rotation(dim, bits, seed)
        for batch in batches:
            vectors = _matrix(batch.column(1), dim)
            codes, c, norms = encode(vectors, turn)
            cell = (vectors @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1) if len(centres) else np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(c), pa.array(norms), pa.array(cell, pa.int32())], ["id", "vector", "code", "c", "norm", "cell"])

    return rows.mapInArrow(run, f"id long, vector {rows.schema['vector'].dataType.simpleString()}, code binary, c double, norm double, cell int")


@lru_cache(maxsize=1)
def byte_signs() -> np.ndarray:
    """The eight signs of every byte, highest bit first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def sign_products(codes: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """<signs, rotated query> for every query and code, by a look-up for each byte of the code."""
    parts = rotated.astype(np.float32).reshape(len(rotated), -1, 8)
    tables = np.einsum("vj,qbj->bvq", byte_signs(), parts).copy()
    total, one = np.zeros((len(codes), len(rotated)), np.float32), np.empty((len(codes), len(rotated)), np.float32)
    for b in range(codes.shape[1]):
        total += np.take(tables[b], codes[:, b], axis=0, out=one)
    return total.T


def best_of_block(query_ids, queries, ids, vectors, codes, c, norms, turn, k: int, eps: float, bars=None):
    """(query, id, score) of the k best of a chunk for each query of a block, of those that reach the query's bar."""
    bits = turn.shape[0]
    scale = (norms / c / np.sqrt(bits)).astype(np.float32)
    spread = (norms * np.sqrt(np.maximum(0, 1 - c * c)) / c * eps / np.sqrt(bits - 1)).astype(np.float32)
    exact = lambda row, part, query: np.concatenate([(vectors[row[i : i + 65536]] * part[query[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    bars = np.full(len(queries), -np.inf) if bars is None else bars
    # No product with a row of the chunk exceeds that with their mean by more than the radius times the query's length.
    mean = vectors.mean(axis=0)
    reach = queries @ mean + np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors - mean, axis=1).max()
    asked = np.flatnonzero(reach >= bars - 1e-9 * np.abs(np.where(np.isinf(bars), 0.0, bars)) - 1e-12)
    for at in range(0, len(asked), STEP):
        some = asked[at : at + STEP]
        part, part_ids = queries[some], query_ids[some]
        estimate = np.where(part_ids[:, None] == ids[None, :], -np.inf, sign_products(codes, part @ turn.T) * scale[None, :])
        error = np.linalg.norm(part, axis=1).astype(np.float32)[:, None] * spread[None, :] + 1e-5
        least = np.full(len(part), -np.inf)
        if len(ids) > k and np.isinf(bars[some]).any():
            # k rows score at least the least exact score of the k best by estimate; one may be the query itself.
            top = np.argpartition(-estimate, k - 1, axis=1)[:, :k]
            scores = exact(top.ravel(), part, np.repeat(np.arange(len(part)), k)).reshape(-1, k)
            least = np.where(np.isinf(np.take_along_axis(estimate, top, axis=1)), -np.inf, scores).min(axis=1)
        least = np.maximum(least, bars[some])
        query, row = np.nonzero((estimate + error >= least[:, None] - 1e-6 * np.abs(np.where(np.isinf(least), 0.0, least))[:, None]) & (estimate > -np.inf))
        score = exact(row, part, query)
        fit = score >= bars[some][query]
        query, row, score = query[fit], row[fit], score[fit]
        order = np.lexsort((ids[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        first = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - first < k
        yield some[query[keep]], ids[row[keep]], score[keep]


class Bests:
    """The k best of each query of a block among the rows seen so far, and the bars that they set."""

    def __init__(self, bars: np.ndarray, k: int):
        self.bars, self.k, self.held = bars.copy(), k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Takes in more (query's place, id, score) and raises the bars."""
        query, row, score = (np.concatenate([a, *(f[i] for f in found)]) for i, a in enumerate(self.held))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = place == self.k - 1
        self.bars[query[last]] = np.maximum(self.bars[query[last]], score[last])
        keep = place < self.k
        self.held = query[keep], row[keep], score[keep]


def chunks_of(batches, rows: int):
    """Arrow batches put together up to so many rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n and n + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def search_block(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, dim: int, bits: int, seed: int, k: int, eps: float) -> DataFrame:
    """query_id, vec_id and score of what each task finds for a block of queries."""
    shared = index.sparkSession.sparkContext.broadcast((query_ids, queries, bars))

    def run(batches):
        ids, block, first = shared.value
        best, turn = Bests(first, k), rotation(dim, bits, seed)
        for chunk in chunks_of(batches, CHUNK):
            codes = np.frombuffer(b"".join(chunk["code"].to_pylist()), np.uint8).reshape(chunk.num_rows, -1)
            best.add(list(best_of_block(ids, block, chunk["id"].to_numpy(), _matrix(chunk["vector"], dim), codes, chunk["c"].to_numpy(), chunk["norm"].to_numpy(), turn, k, eps, best.bars)))
        query, row, score = best.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[query], pa.int64()), pa.array(row, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    return index.select("id", "vector", "code", "c", "norm").mapInArrow(run, "query_id long, vec_id long, score double")


def first_bars(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k-th best exact score of each query among a sample of rows, its own left out; none where there are fewer."""
    out = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256) if len(ids) > k else ():
        score = queries[at : at + 256] @ vectors.T
        score[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        kth = np.partition(score, -k, axis=1)[:, -k]
        # Sums are made in another order than in the tasks, so the bar stays a little below.
        out[at : at + 256] = kth - 1e-9 * (1 + np.abs(np.where(np.isinf(kth), 0.0, kth)))
    return out


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None, eps: float = 3.0, seed: int = 41) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` rows of ``base`` with the largest inner product.

    Scores are exact, in double precision, on the original vectors; ties go to the smaller id. A row
    with a query's own id is no candidate. Null ids, and vectors that are null, zero, not finite or not
    of the commonest length, take no part on either side. An empty table gives no rows. Repeated rows are candidates
    each; of queries that share an id the least vector counts.
    """
    dim = dimension(base, vector_col)
    spark = base.sparkSession
    form = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    rows, asked = form(base), form(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    bits = bits or max(128, -(-4 * dim // 64) * 64)
    n = rows.count()
    hashed = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    # A cut on the hash leaves some 1.2 times what is wanted, however many tasks there are; repeated ids go on one place.
    drawn = rows.where(hashed < int(min(1.0, 1.2 * SAMPLE / max(1, n)) * (1 << 30))).orderBy(hashed, "id").limit(SAMPLE).toArrow()
    sample, sample_ids = (_matrix(drawn["vector"], dim), drawn["id"].to_numpy()) if drawn.num_rows else (np.zeros((0, max(1, dim))), np.zeros(0, np.int64))
    centres = cells_of(sample, int(min(MOST_CELLS, max(1, n // PER_CELL), max(1, len(sample)))), seed) if len(sample) else sample
    index = materialize(build_index(rows, dim, bits, seed, centres).hint("rebalance", "cell").sortWithinPartitions("cell"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks))
    parts = []
    for i in range(blocks):
        some = asked.where(block == i).orderBy("id").toArrow()
        if some.num_rows:
            ids, vectors = some["id"].to_numpy(), _matrix(some["vector"], dim)
            found = search_block(index, ids, vectors, first_bars(ids, vectors, sample_ids, sample, k), dim, bits, seed, k, eps)
            parts.append(found if blocks == 1 else materialize(found))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = reduce(DataFrame.unionByName, parts)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
