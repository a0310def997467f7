"""Finding series and documents: weighted terms, vectors, and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components


def term_score(key: Column, name: Column, context: Column, terms: dict[str, float], concepts: dict[str, str] | None = None) -> Column:
    """Weighted matches: twice the weight in the key (three times if it is or begins the key), and 1.5 times in
    the name, else 0.6 times in the context. What is covered adds 2 for every concept after the first, if
    anything matched at all; ``concepts`` are words with their stems, either of which covers them, and all
    terms if not given."""
    total = F.lit(0.0)
    for term, weight in terms.items():
        t = F.lit(term)
        at_key = F.when(F.contains(key, t), F.when(F.startswith(key, t), 3.0 * weight).otherwise(2.0 * weight)).otherwise(0.0)
        at_name = F.when(F.contains(name, t), 1.5 * weight).when(F.contains(context, t), 0.6 * weight).otherwise(0.0)
        total = total + at_key + at_name
    covered = F.lit(0)
    for word, stem in (concepts if concepts is not None else dict.fromkeys(terms, "")).items():
        covered = covered + any_term([key, name, context], [w for w in (word, stem) if w]).cast("int")
    return total + F.when(total > 0, 2.0 * F.greatest(covered - 1, F.lit(0))).otherwise(0.0)


def any_term(columns: list[Column], terms: list[str]) -> Column:
    """Whether any term occurs in any of the columns; null columns hold none."""
    out = F.lit(False)
    for c in columns:
        for t in terms:
            out = out | F.coalesce(F.contains(c, F.lit(t)), F.lit(False))
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine_topk(df: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k rows nearest to one query vector by cosine; the query is a literal and the sort keeps k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def fuse(lists: list[DataFrame], id_col: str, weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): the sum of weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [df.select(id_col, (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in zip(lists, weights, strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(id_col).agg(F.sum("part").alias("rrf"))


def ranked(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Adds rank by ``order``, within ``by`` if given. Without it the frame must be a bounded top list."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)))


def recall_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """Share of questions whose wanted row ranks within each k; a null rank is a miss."""
    return ranks.agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"recall_at_{k}") for k in ks), F.count("*").alias("n"))


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with the smallest id of its text, by the text's digest; only digests are shuffled.

    The join is a plain equi-join, so the adaptive plan can split the rows of a very common text.
    """
    keyed = df.select(F.col(id_col), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min(id_col).alias("canonical_id"), F.count("*").alias("n_copies"))
    return keyed.join(first, "digest").select(id_col, "canonical_id", "n_copies")


def merge_documents(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Documents that share any of their keys (an address, a content digest), directly or through others, as
    one: id and canonical_id, the smallest id reached.

    Every document of a key is linked to the key's smallest id; the links' components are found over ids
    alone, until no label moves.
    """
    links = df.select(F.col(id_col).alias("b"), F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys)))).alias("key")).where("b IS NOT NULL").distinct()
    least = links.groupBy("key").agg(F.min("b").alias("a"))
    found = components(links.join(least, "key").select("a", "b").where("a <> b")).select(F.col("id").alias(id_col), F.col("component").alias("canonical_id"))
    return df.select(id_col).distinct().join(found, id_col, "left").select(id_col, F.coalesce("canonical_id", id_col).alias("canonical_id"))


def filter_hits(hits: DataFrame, url: str, order: list, domains: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Search hits of the named domains and what lies below them, the first of each address, the first ``k`` in order."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z]+://([^/?#:]+)", 1)), r"\.$", "")
    if domains is not None:
        below = F.lit(False)
        for d in domains:
            below = below | (host == d.lower()) | F.endswith(host, F.lit("." + d.lower()))
        hits = hits.where(below)
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy(url).orderBy(*order))).where("__n = 1").drop("__n")
    return first if k is None else first.orderBy(*order).limit(k)


def distinct_roots(citations: DataFrame, run: str, root: str) -> DataFrame:
    """How many different documents the citations of a run go back to."""
    return citations.groupBy(run).agg(F.countDistinct(root).alias("n_roots"), F.count("*").alias("n_citations"))
