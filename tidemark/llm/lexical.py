"""Ranked lexical search, impact-ordered and score-at-a-time, over the documents of one task after the other.

The items' terms are the vocabulary; a forward index of the documents holds their occurrences and lengths. From
its sums follow the terms' weights, and so the impact of every posting: an exact integer. A task takes the
index in slabs of bounded size and inverts each: postings by term, and within a term grouped by impact, highest
first. For an item the groups of its terms are added in the order of their impacts, whatever the term. What no
group has added yet bounds what any score can still gain; once that proves that all documents but a short list
stay out of the k best, the rest of the postings is skipped and the scores of the list are completed from the
forward index. The k-th best score of a sample, and of what a task has seen, is the bar from the start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, seeded, short_batches
from tidemark.llm.runs import byte_class, runs, slabs

#: What terms consist of, after A to Z have been lower-cased: digits, letters, and all beyond ASCII.
TERM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the terms of a block of items, sent to all tasks; more items are searched in more blocks.
BLOCK = 32 << 20
#: Documents and postings of a slab, documents of the sample that gives the first bar, and of a list whose scores are completed.
SLAB_ROWS, SLAB_POSTINGS, SAMPLE_ROWS, LISTED = 65_536, 4_000_000, 8_192, 256
#: Documents of the sample hold at most so many different terms of the items each. It sets only how soon searches end.
SAMPLE_TERMS = 512


def term_counts(column: pa.Array):
    """(first text, text, occurrences, terms): a row for each text of a slab and each different term in it, by text and term."""
    for slab in slabs(column):
        slab.data = LOWER[slab.data]
        found = runs(slab, TERM)
        key, count = np.unique(found.text * max(1, len(found.distinct)) + found.code, return_counts=True)
        yield slab, key // max(1, len(found.distinct)), count, found.distinct, key % max(1, len(found.distinct)), np.bincount(found.text, minlength=len(slab))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """__item, __term (UTF-8) and __times of every item.

    Items without an id or without terms have no rows; of rows that repeat an id the least text counts.
    """
    narrow = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__item")).agg(F.min(F.col(text_col).cast("string")).alias("text"))

    def run(batches):
        for batch in batches:
            for slab, text, count, terms, code, _ in term_counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + slab.first)), terms.cast(pa.binary()).take(pa.array(code)), pa.array(count, pa.int64())], ["__item", "__term", "__times"])

    return narrow.mapInArrow(run, f"__item {narrow.schema[0].dataType.simpleString()}, __term binary, __times long")


def forward_index(docs: DataFrame, vocabulary: pa.Array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, n, terms and times of every document with a term: how many terms it has in all, and how often it
    holds which of the vocabulary, by their numbers. Each text is read whole, and read once."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            for slab, text, count, terms, code, n in term_counts(batch.column(1)):
                number = pc.index_in(terms, value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
                known = np.flatnonzero(number >= 0)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text[known], minlength=len(slab)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[known], t)) for x, t in ((number, pa.int32()), (count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.first, len(slab)), pa.array(n, pa.int64()), *lists], ["__id", "n", "terms", "times"]).filter(pa.array(n > 0))

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"__id {narrow.schema[0].dataType.simpleString()}, n long, terms array<int>, times array<long>")


@dataclass
class Searcher:
    """What tasks need of a block of items: each one's terms with times, the terms' weights, N and L, and the bar
    that a document has to reach, by item."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    docs: int
    terms: int
    k: int
    bars: np.ndarray

    def impacts(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What each posting adds to the score of its document for each time that an item holds the term."""
        m = 75 + (25 * n * self.docs) // max(1, self.terms)
        return self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))

    def best(self, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, times: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of each item's k best of a slab that reach the bar, which rises with them.

        ``bounds`` are the limits of each row's postings; equal scores go by ``rank``.
        """
        row = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = self.impacts(n, row, term, times)
        order = np.lexsort((-impact, term))
        by_term, rows, falling = term[order], row[order], impact[order]
        begins, ends = (np.searchsorted(by_term, np.arange(len(self.weights)), side) for side in ("left", "right"))
        out = []
        for i in range(len(self.items)):
            found, scores = self._search(i, len(n), begins, ends, rows, falling, (bounds, term, impact))
            keep = np.lexsort((rank[found], -scores))[: self.k]
            found, scores = found[keep], scores[keep]
            if len(scores) == self.k:
                self.bars[i] = max(self.bars[i], scores[-1])
            out.append((found, scores))
        return out

    def _search(self, i: int, texts: int, begins, ends, rows, falling, forward) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a slab that reach the bar and, with ties, all that can be among the k best; exact scores."""
        terms, wanted = self.items[i]
        there = np.flatnonzero(begins[terms] < ends[terms])
        terms, wanted = terms[there], wanted[there]
        at, end = begins[terms].copy(), ends[terms]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        high = wanted * falling[at] if len(terms) else np.zeros(0, np.int64)
        bar = max(1, int(self.bars[i]))
        if high.sum() < bar:
            return none
        sums, cut = np.zeros(texts, np.int64), int(high.max())
        while True:
            # All groups of an impact of at least the cut, of whatever term, which halves from round to round.
            cut //= 2
            for t in np.flatnonzero(high >= max(1, cut)):
                part = falling[at[t] : end[t]]
                upto = int(np.searchsorted(-part, -(max(1, cut) / wanted[t]), side="right"))
                sums[rows[at[t] : at[t] + upto]] += wanted[t] * part[:upto]
                at[t] += upto
                high[t] = wanted[t] * falling[at[t]] if at[t] < end[t] else 0
            rest = int(high.sum())
            kth = int(np.partition(sums, -self.k)[-self.k]) if texts >= self.k else 0
            bar = max(bar, kth)
            if rest == 0:
                found = np.flatnonzero(sums >= bar)
                return found, sums[found]
            if rest < bar:
                listed = np.flatnonzero(sums + rest >= bar)
                if len(listed) <= max(LISTED, 2 * self.k):
                    scores = self._complete(i, listed, *forward)
                    reach = scores >= max(1, int(self.bars[i]))
                    return listed[reach], scores[reach]

    def _complete(self, i: int, listed: np.ndarray, bounds: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores of listed rows from all their postings."""
        terms, wanted = self.items[i]
        times = np.zeros(len(self.weights), np.int64)
        times[terms] = wanted
        lengths = bounds[listed + 1] - bounds[listed]
        at = np.repeat(bounds[listed] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        out = np.zeros(len(listed), np.int64)
        np.add.at(out, np.repeat(np.arange(len(listed)), lengths), times[term[at]] * impact[at])
        return out


def index_slabs(batches):
    """Batches of the forward index put together up to SLAB_ROWS rows or SLAB_POSTINGS postings: (ids, n, bounds, terms, times)."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = len(batch.column(2).flatten())
        if held and (rows + batch.num_rows > SLAB_ROWS or postings + size > SLAB_POSTINGS):
            yield put_together(held)
            held, rows, postings = [], 0, 0
        held.append(batch)
        rows, postings = rows + batch.num_rows, postings + size
    if held:
        yield put_together(held)


def put_together(batches):
    """One slab of some batches of the forward index."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, n, terms, times = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, n.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]), flat(terms), flat(times)


def search_slabs(searcher: Searcher, batches):
    """(item's number, ids, scores) of each item's k best rows among all batches, or more where scores tie."""
    best: dict[int, list] = {}
    for ids, n, bounds, term, times in index_slabs(batches):
        rank = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        for i, (rows, scores) in enumerate(searcher.best(n, bounds, term, times, rank)):
            if not len(rows):
                continue
            got_ids, got = pa.concat_arrays([*(x[0] for x in best.get(i, [])), ids.take(pa.array(rows))]), np.concatenate([*(x[1] for x in best.get(i, [])), scores])
            keep = np.lexsort((np.argsort(np.argsort(got_ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"), -got))[: searcher.k]
            best[i] = [(got_ids.take(pa.array(keep)), got[keep])]
            if len(keep) == searcher.k:
                searcher.bars[i] = max(searcher.bars[i], got[keep[-1]])
    for i, [(ids, scores)] in sorted(best.items()):
        yield i, ids, scores


def search_block(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, doc_id and score of the best documents of each task for a block of items.

    The driver gets the block's terms, one count a term, and a sample of bounded rows.
    """
    spark = docs.sparkSession
    held = terms.orderBy("__item", "__term").toPandas()
    words = sorted(set(map(bytes, held["__term"])))
    number = {w: i for i, w in enumerate(words)}
    names = list(dict.fromkeys(held["__item"]))
    parts = {name: ([], []) for name in names}
    for name, term, times in zip(held["__item"], held["__term"], held["__times"], strict=True):
        parts[name][0].append(number[bytes(term)])
        parts[name][1].append(times)
    index = materialize(forward_index(docs, pa.array(words, pa.large_binary()), id_col, text_col))
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    searcher = Searcher([(np.array(a, np.int64), np.array(b, np.int64)) for a, b in parts.values()], weights, n_docs, n_terms, k, np.zeros(len(names), np.int64))
    ranked = index.where("__id IS NOT NULL").select("__id", "n", "terms", "times")
    # A cut on the hash leaves some 1.2 times what is wanted, however many tasks there are; the sort sees only that.
    share = 1.2 * SAMPLE_ROWS / max(1, n_docs)
    drawn = ranked.where((F.size("terms") <= SAMPLE_TERMS) & (F.pmod(seeded(F.col("__id"), 3), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))))
    sample = drawn.orderBy(seeded(F.col("__id"), 3), "__id").limit(SAMPLE_ROWS).toArrow()
    for _ in search_slabs(searcher, sample.to_batches()):
        pass  # raises the bars
    shared = spark.sparkContext.broadcast((searcher, pa.array(names)))
    id_type = ranked.schema[0].dataType.simpleString()

    def run(batches):
        own, item_ids = shared.value
        own = Searcher(own.items, own.weights, own.docs, own.terms, own.k, own.bars.copy())
        for i, ids, scores in search_slabs(own, batches):
            yield pa.RecordBatch.from_arrays([pa.repeat(item_ids[i], len(ids)), ids, pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return ranked.mapInArrow(run, f"item_id {terms.schema['__item'].dataType.simpleString()}, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k documents of the highest scores above 0, ties by id.

    The terms of a block of items, of about ``block`` bytes, go to all tasks; more items are searched in more
    blocks, by a hash of their ids. A slab of documents is inverted and searched inside a task, each task
    returns k rows an item, and the last ranking takes k of each task's first, so no item's documents meet
    in one task. Null, empty and termless texts hold no terms and count for nothing; a row without an id
    counts for the weights only; rows that repeat an id are ranked each; a very long text is read whole;
    without documents or items there are no rows.
    """
    terms = materialize(item_terms(items, item_col))
    total = terms.agg(F.coalesce(F.sum(F.length("__term") + 24), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    found = None
    for b in range(blocks):
        part = search_block(docs, terms.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == b), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
