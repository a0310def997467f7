"""Discovery for many questions at once: one equi-join of their terms with the postings of an index, and a top list
for each.

Postings are the strings of two and three letters that a row's texts hold. A term can only occur in rows that hold
all its strings, so the rarest of them leads to its rows by an equi-join, and each pair is then compared as
`discover` does. What a question names, its filters and its rules are columns of its row, so one plan serves all
questions. The dense half ranks rows by hashed n-gram vectors under the same filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.plans.discovery import ASKED, ORDER, Asked, Domain, has_currency, is_amount, name_match, named, other_currency, question, ruled, within
from tidemark.shared import materialize

#: Letters of a posting; shorter terms are their own.
GRAM = 3
TEXTS = ("key", "name", "context")
#: Numbers of a vector, letters of the strings that are hashed into it, and questions that a task compares at a time.
WIDTH, LENGTHS, BLOCK = 512, (3, 4, 5), 1024


def interpreted(questions: DataFrame, domain: Domain) -> DataFrame:
    """question_id, asked (a struct of ASKED) and words: terms in order with their weights and the concepts that
    each covers. Words of concepts that are no terms have no weight. Null texts have no terms."""

    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            q = question(text or "", domain)
            words = [{"place": i, "term": t, "weight": w, "concepts": [c for c, pair in enumerate(q.concepts.items()) if t in pair]} for i, (t, w) in enumerate(q.terms.items())]
            more = dict.fromkeys(x for pair in q.concepts.items() for x in pair if x and x not in q.terms)
            words += [{"place": len(q.terms) + i, "term": t, "weight": None, "concepts": [c for c, pair in enumerate(q.concepts.items()) if t in pair]} for i, t in enumerate(more)]
            out.append({"asked": named(q, domain), "words": words if q.terms else []})
        return pd.DataFrame(out, columns=["asked", "words"])

    fields = ", ".join(f"{n}: {t}" for n, t in ASKED.items())
    parse = F.pandas_udf(read, f"asked struct<{fields}>, words array<struct<place: int, term: string, weight: double, concepts: array<int>>>")
    return questions.select("question_id", parse(F.col("text").cast("string")).alias("q")).select("question_id", "q.asked", "q.words")


def grams(text: Column, length: int) -> Column:
    """The strings of a length that a text holds."""
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substring(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame) -> DataFrame:
    """(gram, __row): which strings of one to GRAM letters the texts of each row hold."""
    held = [grams(F.coalesce(F.col(c), F.lit("")), n) for c in TEXTS for n in range(1, GRAM + 1)]
    return rows.select("__row", F.explode(F.array_distinct(F.concat(*held))).alias("gram"))


def touched(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, __row, points): rows in which each distinct term occurs, and what a weight of 1 gives there."""
    length = F.least(F.length("term"), F.lit(GRAM))
    needed = terms.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - length + 1), lambda i: F.substring(F.col("term"), i, length)))).alias("gram"))
    wanted = materialize(postings(rows).join(needed.select("gram").distinct(), "gram", "left_semi"))
    often = wanted.groupBy("gram").agg(F.count("*").alias("n"))
    # A term one of whose strings nothing holds occurs nowhere; else the rarest string has the fewest rows to compare.
    rarest = needed.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("held")).where("held").drop("held")
    key, name, context = (F.coalesce(F.col(c), F.lit("")) for c in TEXTS)
    pairs = rarest.join(wanted, "gram").select("term", "__row").join(rows.select("__row", *TEXTS), "__row")
    at = {"in_key": F.contains(key, F.col("term")), "leads": F.startswith(key, F.col("term")), "in_name": F.contains(name, F.col("term")), "in_context": F.contains(context, F.col("term"))}
    return pairs.select("term", "__row", *(c.alias(n) for n, c in at.items())).where("in_key OR in_name OR in_context")


def matched(words: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, __row, matches): the points of a row's terms, added up in the order of the question's terms,
    and those of the concepts covered. Rows that only words without weight touch are left out."""
    both = words.join(hits, "term")
    at_key = F.when(F.col("in_key"), F.when(F.col("leads"), 3.0 * F.col("weight")).otherwise(2.0 * F.col("weight"))).otherwise(0.0)
    at_name = F.when(F.col("in_name"), 1.5 * F.col("weight")).when(F.col("in_context"), 0.6 * F.col("weight")).otherwise(0.0)
    per_row = both.groupBy("question_id", "__row").agg(F.array_sort(F.collect_list(F.struct("place", at_key.alias("a"), at_name.alias("b"), "weight", "concepts"))).alias("t"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t", lambda x: x["concepts"]))))
    total = F.aggregate(F.filter("t", lambda x: x["weight"].isNotNull()), F.lit(0.0), lambda s, x: s + x["a"] + x["b"])
    scored = per_row.where(F.exists("t", lambda x: x["weight"].isNotNull())).select("question_id", "__row", total.alias("total"), covered.alias("covered"))
    bonus = F.when(F.col("total") > 0, 2.0 * F.greatest(F.col("covered") - 1, F.lit(0))).otherwise(0.0)
    return scored.select("question_id", "__row", (F.col("total") + bonus).alias("matches"))


def first_of_kind(rows: DataFrame, hits: DataFrame, domain: Domain, limit: int) -> DataFrame:
    """(__row): of rows that score alike for every question the first ``limit`` by key, source and row.

    Rows are of a kind if the same terms occur in them at the same places, and all else that filters, rules and names
    read is equal: every column but the key, whose length and matches with the domain's patterns count instead. Of a
    kind, those behind the first ``limit`` come behind them in every list, so no list of ``limit`` rows holds them.
    """
    key, raw = F.col("key"), F.coalesce(F.col("code"), F.col("key")) if "code" in rows.columns else F.col("key")
    read = [c for c in ("source", "name", "unit", "semantics", "grain", "tier", "depth", "currencies", "dataset") if c in rows.columns]
    patterns = [raw.rlike(p) for p in (domain.derived, domain.averaged, domain.coded, domain.commercial)] + [F.contains(F.upper(raw), F.lit(domain.national))]
    said = [F.contains(key, F.lit(n)) for n in domain.qualifiers]
    at = hits.groupBy("__row").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "term", *(F.col(c).cast("string") for c in ("in_key", "leads", "in_name", "in_context"))))), "\1"), 256).alias("__hits"))
    kinds = rows.select("__row", "key", "source", F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(read)), F.length("key").alias("n"), *(c.alias(f"p{i}") for i, c in enumerate([*patterns, *said]))).alias("__facts"))
    within_kind = Window.partitionBy("__hits", "__facts").orderBy(F.asc("key"), F.asc("source"), F.asc("__row"))
    return at.join(kinds, "__row").withColumn("__n", F.row_number().over(within_kind)).where(F.col("__n") <= limit).select("__row")


def discover_all(index: DataFrame, questions: DataFrame, limit: int = 20, domain: Domain | None = None, per_source: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """For every question (question_id, text) the rows that `discover` gives, with rank from 1.

    ``dense`` is a ranked list (question_id, source, key, rank), such as `dense_ranks` gives. Its rows join each
    question's pool, under the same filters, with the matches that they have; then fused ranks of both lists come before
    scores, and a row with a score of 0 or less in the words' list gets nothing from the vectors'. Questions without
    terms, and an empty index, give no rows.
    """
    domain = domain or Domain()
    rows = materialize(index.withColumn("__row", F.monotonically_increasing_id()))
    asked = materialize(interpreted(questions, domain))
    words = asked.select("question_id", F.explode("words").alias("w")).select("question_id", "w.*")
    hits = materialize(touched(rows, words.select("term").distinct()))
    if dense is None:
        leading = materialize(first_of_kind(rows, hits, domain, limit))
        hits, rows = hits.join(leading, "__row", "left_semi"), rows.join(leading, "__row", "left_semi")
    found = matched(words, hits).withColumn("by_words", F.lit(True))
    if dense is not None:
        ids = rows.select("source", "key", "__row").groupBy("source", "key").agg(F.min("__row").alias("__row"))
        near = dense.join(ids, ["source", "key"]).groupBy("question_id", "__row").agg(F.min("rank").alias("near"))
        found = found.join(near, ["question_id", "__row"], "full").withColumns({"matches": F.coalesce("matches", F.lit(0.0)), "by_words": F.coalesce("by_words", F.lit(False))})
    q, by = Asked.columns("asked"), ["question_id"]
    pool = found.join(asked.where(F.size("words") > 0).select("question_id", "asked"), by).join(rows, "__row").where(within(q, index))
    pool = pool.withColumns({"score": ruled(F.col("matches"), q, index, domain), "name_match": name_match(q)})
    if "currencies" in index.columns:
        # Whether any row that words touch is published in the currency, by partial aggregates.
        published = pool.where(F.col("by_words") & has_currency(q)).select("question_id").distinct().withColumn("__published", F.lit(True))
        pool = pool.join(published, by, "left").where(F.col("__published").isNull() | ~other_currency(q)).drop("__published")
    if domain.regions:
        pool = pool.withColumn("region", F.when(F.col("source").isin(*domain.regional), q.region))
    (down, first), (up, then) = ORDER
    order = [*(down(c) for c in first), *(up(c) for c in then), F.asc("__row")]
    if per_source:
        each = Window.partitionBy("question_id", "source").orderBy(*order)
        pool = pool.withColumn("__n", F.row_number().over(each)).where((F.col("__n") <= per_source) | ~F.col("by_words")).drop("__n")
    pool = pool.withColumn("seated", q.ratio & q.amount & is_amount()).withColumn("two_kinds", q.ratio & q.amount)
    if dense is not None:
        place = F.row_number().over(Window.partitionBy("question_id", "by_words").orderBy(*order))
        points = F.when(F.col("by_words"), 1 / (60 + place)).otherwise(0.0) + F.when(F.col("near").isNotNull() & (~F.col("by_words") | (F.col("score") > 0)), 1 / (60 + F.col("near"))).otherwise(0.0)
        pool = pool.withColumn("fused", points)
        order = [order[0], F.desc("fused"), *order[1:]]
    else:
        pool = pool.withColumn("fused", F.lit(None).cast("double"))
    kept = [*index.columns, "score", "name_match", *(["region"] if domain.regions else [])]
    narrow = pool.select("question_id", *kept, "fused", "seated", "two_kinds", "__row")
    top = Window.partitionBy("question_id").orderBy(*order)
    # Both top lists are short; written, so that the pool is made once for each.
    best = materialize(narrow.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit))
    # Of a question for a ratio and an amount the best amount has the last seat where it is not seated anyway.
    amounts = materialize(narrow.where("seated").withColumn("rank", F.row_number().over(top)).where("rank = 1").withColumn("rank", F.lit(limit)))
    have = best.where("seated").select("question_id").distinct()
    late = amounts.join(have, by, "left_anti")
    displaced = late.select("question_id", F.lit(limit).alias("rank"))
    full = best.join(displaced, ["question_id", "rank"], "left_anti").unionByName(late)
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", *order))).select("question_id", "rank", *kept, "fused")


def vector(text: str) -> np.ndarray:
    """The unit vector of a text: its words' strings, with the ends of words, hashed with signs; 0 for no words."""
    out = np.zeros(WIDTH)
    for word in text.replace("_", " ").replace("/", " ").split():
        whole = f"<{word}>"
        for n in LENGTHS:
            for i in range(max(1, len(whole) - n + 1)):
                h = zlib.crc32(whole[i : i + n].encode("utf-8", "surrogatepass"))
                out[h % WIDTH] += 1.0 if h >> 31 else -1.0
    length = np.linalg.norm(out)
    return out / length if length else out


def dense_ranks(index: DataFrame, questions: DataFrame, k: int = 50, domain: Domain | None = None, least: float = 0.05) -> DataFrame:
    """(question_id, source, key, similarity, rank): the k rows of the index nearest to each question by hashed n-gram vectors, of
    those within the publisher and basis that it names; ties by key and source. Similarities below ``least`` are left out.

    Blocks of BLOCK questions go to all tasks as matrices, one after the other; each task makes its rows' vectors
    once a block and keeps k rows a question.
    """
    domain = domain or Domain()
    spark = index.sparkSession
    asked = materialize(interpreted(questions, domain).where(F.size("words") > 0).withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(max(1, -(-questions.count() // BLOCK))))))
    rows = index.select("source", "key", F.concat_ws(" ", F.col("key"), F.coalesce("name", F.lit("")), F.coalesce("context", F.lit(""))).alias("words"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("semantics", F.lit("")).alias("semantics"))
    parts = []
    for (block,) in sorted(asked.select("block").distinct().collect()):
        some = asked.where(F.col("block") == block).select("question_id", "asked.text", "asked.sources", "asked.basis").orderBy("question_id").toPandas()
        shared = spark.sparkContext.broadcast((some["question_id"].tolist(), np.stack([vector(t) for t in some["text"]]), [set(s) for s in some["sources"]], some["basis"].tolist()))

        def run(batches, shared=shared):
            ids, matrix, sources, bases = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                source, key, words, unit, semantics = (c.to_pylist() for c in batch.columns)
                near = np.stack([vector(w) for w in words]) @ matrix.T
                percent = np.array(unit, dtype=object) == "%"
                of_flow = {b: percent & np.isin(semantics, [x for x in ("flow", "stock") if x != b]) for b in set(bases) - {None}}
                out = []
                for j, q in enumerate(ids):
                    fit = near[:, j] >= least
                    if sources[j]:
                        fit &= np.isin(source, list(sources[j]))
                    if bases[j] is not None:
                        fit &= ~of_flow[bases[j]]
                    at = np.flatnonzero(fit)
                    out += [(q, source[i], key[i], round(float(near[i, j]), 9)) for i in sorted(at, key=lambda i: (-round(float(near[i, j]), 9), key[i], source[i]))[:k]]
                yield pa.RecordBatch.from_pydict({"question_id": pa.array([o[0] for o in out], batch_type), "source": pa.array([o[1] for o in out], pa.string()), "key": pa.array([o[2] for o in out], pa.string()), "similarity": pa.array([o[3] for o in out], pa.float64())})

        kind = asked.schema["question_id"].dataType
        batch_type = {"int": pa.int32(), "bigint": pa.int64()}.get(kind.simpleString(), pa.string())
        parts.append(rows.mapInArrow(run, f"question_id {kind.simpleString()}, source string, key string, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"question_id {asked.schema['question_id'].dataType.simpleString()}, source string, key string, similarity double, rank int")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return search.ranked(both, [F.desc("similarity"), "key", "source"], ["question_id"]).where(F.col("rank") <= k)
