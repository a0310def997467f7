"""Finding series by words: what a question names is peeled off, the rest becomes weighted terms, and one
expression scores the whole index.

The pool is every index row that a term touches; nothing is cut before ranking, and the sort keeps only
what is asked for (a bounded heap in each task). The index is (source, key, name, context, unit,
semantics, grain, tier, depth) with folded text columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import search

# Words that carry no meaning for search, words that ask for ratios or amounts, and words
# that say a grain or a currency.
STOP = frozenset("ve ile icin bir bu su the of in for and to a an nedir kac ne kadar goster son arasi".split())
RATIO = frozenset("oran orani oranlari yuzde rate ratio share pay payi".split())
AMOUNT = frozenset("tutar tutari bakiye bakiyesi stok amount balance volume hacim".split())
GRAINS = {"gunluk": "daily", "haftalik": "weekly", "aylik": "monthly", "ceyreklik": "quarterly", "yillik": "annual", "daily": "daily", "weekly": "weekly", "monthly": "monthly", "quarterly": "quarterly", "annual": "annual"}
CURRENCIES = {"tl": "TL", "yp": "FX", "doviz": "FX", "fx": "FX"}
BASES = {"akis": "flow", "akim": "flow", "flow": "flow", "stok": "stock", "stock": "stock"}
#: Weights of the whole phrase, of a phrase of one word, an alias, a word, and its first five letters; most terms.
PHRASE, ONE_WORD, ALIAS, WORD, STEM, MOST = 4.0, 1.5, 3.0, 1.0, 0.8, 18
FOLD = str.maketrans("çğıöşüÇĞİÖŞÜâîû", "cgiosucgiosuaiu")


@dataclass(frozen=True)
class Domain:
    """What a corpus is about, as far as ranking depends on it.

    ``sources`` are names of publishers and the sources they stand for, ``regions`` folded names of regions and
    how tables spell them; ``qualifiers`` are words of keys that narrow a row, with the words by which a question
    asks for them; ``regional`` sources answer by region, ``tiered`` ones rank their series; ``sectors``
    are datasets by sector that a question must ask for with ``sector_word``; ``averaged``, ``coded``,
    ``derived`` and ``commercial`` are patterns of keys: moving averages, series of one region, derived series,
    property that is no housing.
    """

    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    regions: dict[str, str] = field(default_factory=dict)
    qualifiers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    regional: tuple[str, ...] = ("finturk",)
    tiered: tuple[str, ...] = ("macro",)
    sectors: tuple[str, ...] = ()
    sector_word: str = "sekt"
    averaged: str = r"\.K?MA$"
    coded: str = r"\.K?TR[0-9A-C]"
    national: str = "TOPLAM"
    derived: str = r"^DERIVED\."
    commercial: str = r"$^"
    commercial_words: tuple[str, ...] = ("is yeri", "isyeri", "ticari", "commercial")


@dataclass(frozen=True)
class Question:
    """The terms of a question and what it names besides: ``asked`` is its folded text."""

    terms: dict[str, float]
    grain: str | None = None
    currency: str | None = None
    basis: str | None = None
    ratio: bool = False
    amount: bool = False
    concepts: dict[str, str] = field(default_factory=dict)
    sources: tuple[str, ...] = ()
    region: str | None = None
    asked: str = ""


def clauses(text: str) -> list[str]:
    """Parts of a question at commas and "and", not within brackets."""
    out, depth, part = [], 0, []
    for token in re.findall(r"[()]|,|;|[^\s(),;]+", text):
        depth += (token == "(") - (token == ")")
        if depth <= 0 and (token in (",", ";") or token.lower() in ("ve", "and", "ile")):
            out.append(" ".join(part))
            part = []
        else:
            part.append(token)
    return [c for c in [*out, " ".join(part)] if c]


def peel(text: str, names: dict) -> tuple[str | None, str]:
    """The one of ``names`` that a folded text holds as words (with an ending of case), and the text without it;
    longer names are tried first, and none counts if several are named."""
    spans: dict[str, tuple[int, int]] = {}
    for name in sorted(names, key=len, reverse=True):
        hit = re.search(rf"(?<![a-z0-9]){re.escape(name)}(?:'?[a-z]{{0,4}})?(?![a-z0-9])", text)
        if hit and not any(hit.start() < e and s < hit.end() for s, e in spans.values()):
            spans[name] = hit.span()
    if len(spans) != 1:
        return None, text
    ((name, (start, end)),) = spans.items()
    return name, " ".join((text[:start] + " " + text[end:]).split())


def meant(phrase: str, aliases: dict[str, tuple[str, ...]]) -> list[str]:
    """What the aliases in a phrase stand for. Longer aliases claim their words first; from four letters on an
    alias may have an ending of case. What the alias itself says already is left out."""
    free, out = f" {phrase} ", []
    for alias in sorted(aliases, key=len, reverse=True):
        hit = re.search(rf"(?<= ){re.escape(alias)}{'[a-z0-9]{0,4}' if len(alias) > 3 else ''}(?= )", free)
        if hit:
            free = free[: hit.start()] + "\0" * len(hit.group()) + free[hit.end() :]
            out += [m.lower() for m in aliases[alias] if m.lower() not in {alias, *alias.split()}]
    return out


def question(text: str, domain: Domain | None = None) -> Question:
    """A question as terms: the phrase weighs most, then what aliases stand for, words, and their first five
    letters; 18 terms at most. Publishers, a region, a grain and a currency are peeled off."""
    domain = domain or Domain()
    folded = text.translate(FOLD).lower()
    source, rest = peel(folded, domain.sources)
    region, rest = peel(rest, domain.regions)
    words = re.findall(r"[a-z0-9%]+", rest)
    grain = next((GRAINS[w] for w in words if w in GRAINS), None)
    currency = next((CURRENCIES[w] for w in words if w in CURRENCIES), None)
    basis = {BASES[w] for w in words if w in BASES}
    kept = [w for w in words if w not in STOP and w not in GRAINS and w not in CURRENCIES and len(w) > 1]
    phrase = " ".join(w for w in words if w not in GRAINS and w not in CURRENCIES)
    terms = {phrase: PHRASE if " " in phrase else ONE_WORD} if kept else {}
    for meaning in meant(phrase, domain.aliases):
        terms[meaning] = max(terms.get(meaning, 0), ALIAS)
    concepts = {w: w[:5] if len(w) > 6 else "" for w in kept}
    for w, stem in concepts.items():
        terms.setdefault(w, WORD)
        if stem:
            terms.setdefault(stem, STEM)
    best = dict(sorted(terms.items(), key=lambda t: (-t[1], t[0]))[:MOST])
    return Question(best, grain, currency, next(iter(basis)) if len(basis) == 1 else None, bool(RATIO & set(words)), bool(AMOUNT & set(words)), concepts, domain.sources.get(source, ()), domain.regions.get(region), folded)


def _has(index: DataFrame, column: str) -> Column:
    return F.col(column) if column in index.columns else F.lit(None).cast("string")


@dataclass(frozen=True)
class Asked:
    """What a question names, as columns: literals of one question, or the columns of a table of questions."""

    ratio: Column
    amount: Column
    basis: Column
    grain: Column
    currency: Column
    sources: Column
    region: Column
    text: Column
    sector: Column
    commercial: Column
    unsaid: Column

    @classmethod
    def of(cls, q: Question, domain: Domain) -> Asked:
        """The literals of one question."""
        text = lambda v: F.lit(v).cast("string")
        texts = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        row = named(q, domain)
        return cls(F.lit(q.ratio), F.lit(q.amount), text(q.basis), text(q.grain), text(q.currency), texts(q.sources), text(q.region), text(row["text"]), F.lit(row["sector"]), F.lit(row["commercial"]), texts(row["unsaid"]))

    @classmethod
    def columns(cls, prefix: str) -> Asked:
        """The columns of a table of questions, by the names of the fields."""
        return cls(*(F.col(f"{prefix}.{name}") for name in ASKED))


#: The fields of Asked, with their types in a table of questions.
ASKED = {"ratio": "boolean", "amount": "boolean", "basis": "string", "grain": "string", "currency": "string", "sources": "array<string>", "region": "string", "text": "string", "sector": "boolean", "commercial": "boolean", "unsaid": "array<string>"}


def named(q: Question, domain: Domain) -> dict:
    """The values of ASKED of one question; text has its words one space apart."""
    said = lambda words: any(w in q.asked for w in words)
    return {
        "ratio": q.ratio, "amount": q.amount, "basis": q.basis, "grain": q.grain, "currency": q.currency, "sources": list(q.sources), "region": q.region, "text": f" {' '.join(re.findall(r'[a-z0-9]+', q.asked))} ",
        "sector": domain.sector_word in q.asked, "commercial": said(domain.commercial_words), "unsaid": [n for n, words in domain.qualifiers.items() if not said(words)],
    }


def rules(q: Asked, domain: Domain, index: DataFrame) -> list[tuple[Column, float]]:
    """Conditions on an index row and what each adds to its score."""
    key, unit, source = F.col("key"), F.coalesce("unit", F.lit("")), F.col("source")
    raw = F.coalesce(_has(index, "code"), key)
    out = [(F.array_contains(q.unsaid, name) & (F.contains(key, F.lit(name)) | F.contains(F.col("name"), F.lit(name.replace("_", " ")))), -6.0) for name in domain.qualifiers]
    if domain.sectors:
        out.append((~q.sector & _has(index, "dataset").isin(*domain.sectors), -3.0))
    out += [(q.ratio & (unit == "%"), 3.0), (q.ratio & F.endswith(unit, F.lit("TL")), -3.0), (q.ratio & raw.rlike(domain.derived), 2.0)]
    out += [(F.col("semantics") == q.basis, 4.0), ((F.col("semantics") != q.basis) & F.col("semantics").isin("flow", "stock"), -8.0), (q.amount & (unit == "adet"), -4.0)]
    tiered = source.isin(*domain.tiered)
    national = F.contains(F.upper(raw), F.lit(domain.national))
    out += [(F.col("tier") == 0, 3.0), (F.col("tier") == 1, 1.0), (tiered & raw.rlike(domain.averaged), -2.0), (tiered & ~raw.rlike(domain.averaged) & ~national & raw.rlike(domain.coded), -6.0), (~q.commercial & raw.rlike(domain.commercial), -5.0)]
    out.append(((F.col("grain") != q.grain) & ~((q.grain == "monthly") & tiered), -10.0))
    if "currencies" in index.columns:
        out.append((F.array_contains("currencies", q.currency), 15.0))
    return out


def ruled(matches: Column, q: Asked, index: DataFrame, domain: Domain) -> Column:
    """The score of an index row whose terms give ``matches``: what agrees or disagrees with the question is added. Sources
    by region are for questions that name one: else they count two fifths."""
    total = matches
    for condition, points in rules(q, domain, index):
        total = total + F.when(condition, points).otherwise(0.0)
    total = total - 1.5 * F.coalesce("depth", F.lit(0)) - F.least(F.length("key"), F.lit(90)) / 45.0
    # Nine digits, so that sums that are equal but for the order of their parts tie.
    return F.round(F.when(F.col("source").isin(*domain.regional), F.when(q.region.isNotNull(), total + 4.0).otherwise(total * 0.4)).otherwise(total), 9)


def score(q: Question, index: DataFrame, domain: Domain | None = None) -> Column:
    """The score of an index row for one question."""
    domain = domain or Domain()
    return ruled(search.term_score(F.col("key"), F.col("name"), F.col("context"), q.terms, q.concepts), Asked.of(q, domain), index, domain)


def name_match(q: Asked) -> Column:
    """The length of a row's name if it has three words or more and the question holds them in order, else 0."""
    words = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), "[^a-z0-9]+", " "))
    return F.when((F.size(F.split(words, " ")) >= 3) & F.contains(q.text, F.concat(F.lit(" "), words, F.lit(" "))), F.length(words)).otherwise(0)


def within(q: Asked, index: DataFrame) -> Column:
    """Whether a row is of the publisher and the basis that a question names; with none named, every row is."""
    of_source = (F.size(q.sources) == 0) | F.array_contains(q.sources, F.col("source"))
    other_basis = (F.coalesce("unit", F.lit("")) == "%") & (F.coalesce("semantics", F.lit("")) != q.basis) & F.coalesce("semantics", F.lit("")).isin("flow", "stock")
    return of_source & ~F.coalesce(other_basis, F.lit(False))


def has_currency(q: Asked) -> Column:
    """Whether a row is published in the currency that a question names."""
    return F.coalesce(F.array_contains("currencies", q.currency), F.lit(False))


def other_currency(q: Asked) -> Column:
    """Whether a row is published in other currencies only."""
    return q.currency.isNotNull() & ~has_currency(q) & (F.coalesce(F.size("currencies"), F.lit(0)) > 0)


def pool_of(index: DataFrame, q: Question, domain: Domain) -> DataFrame:
    """Every row of the index that a term touches, scored, within what the question names.

    A named publisher keeps its sources; a named currency, if any row publishes it, drops rows that publish
    others only; a named basis drops rates of the other one. A named region is carried on regional rows.
    """
    asked = Asked.of(q, domain)
    pool = index.where(search.any_term([F.col("key"), F.col("name"), F.col("context")], list(q.terms))).where(within(asked, index))
    pool = pool.withColumns({"score": score(q, index, domain), "name_match": name_match(asked)})
    if q.currency and "currencies" in index.columns and not pool.where(has_currency(asked)).isEmpty():
        pool = pool.where(~other_currency(asked))
    if domain.regions:
        pool = pool.withColumn("region", F.when(F.col("source").isin(*domain.regional), F.lit(q.region)))
    return pool


ORDER = (F.desc, ("name_match", "score")), (F.asc, ("key", "source"))


def _ordered() -> list[Column]:
    return [way(c) for way, columns in ORDER for c in columns]


def is_amount() -> Column:
    """Rows of amounts: in money, or stocks, and not in percent."""
    unit = F.coalesce("unit", F.lit(""))
    return (unit != "%") & (F.endswith(unit, F.lit("TL")) | (F.coalesce("semantics", F.lit("")) == "stock"))


def discover(index: DataFrame, text: str, limit: int = 20, domain: Domain | None = None, per_source: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """The best rows of the index with their score: rows whose full name the question holds, then by score; ties by
    key and source.

    ``per_source`` bounds the rows of each source. A question for a ratio and an amount keeps its last seat for
    the best amount. ``dense`` is a ranked list (source, key, rank) from vectors: its rows join the pool within
    what the question names, and fused ranks come before scores. Many questions are for `batch.discover_all`.
    """
    domain = domain or Domain()
    q = question(text, domain)
    if not q.terms:
        return index.limit(0).withColumns({"score": F.lit(0.0), "name_match": F.lit(0)})
    if dense is not None:
        from tidemark.plans import batch

        asked = index.sparkSession.createDataFrame([(0, text)], "question_id int, text string")
        found = batch.discover_all(index, asked, limit, domain, per_source, dense.select(F.lit(0).alias("question_id"), "source", "key", "rank"))
        return found.orderBy("rank").drop("question_id", "rank", "fused")
    pool = pool_of(index, q, domain)
    order = _ordered()
    if per_source:
        pool = pool.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("__n") <= per_source).drop("__n")
    best = pool.orderBy(*order).limit(limit)
    if q.ratio and q.amount:
        seat = pool.where(is_amount()).orderBy(*order).limit(1)
        first = Window.partitionBy("source", "key").orderBy(F.desc("__seat"))
        both = best.withColumn("__seat", F.lit(0)).unionByName(seat.withColumn("__seat", F.lit(1))).withColumn("__n", F.row_number().over(first))
        best = both.where("__n = 1").orderBy(F.desc("__seat"), *order).limit(limit).drop("__seat", "__n").orderBy(*order)
    return best


def discover_concepts(index: DataFrame, text: str, limit: int = 8, domain: Domain | None = None, per_source: int | None = None) -> list[dict]:
    """Seats for a question of several parts, searched together: rows whose full name a part holds, each part's
    first row, then a third of the seats (two at least) to every source, then the rest in rank order."""
    from tidemark.plans import batch

    parts = clauses(text)
    if not parts:
        return []
    asked = index.sparkSession.createDataFrame(list(enumerate(parts)), "question_id int, text string")
    found: list[list[dict]] = [[] for _ in parts]
    for r in batch.discover_all(index, asked, limit, domain, per_source).orderBy("question_id", "rank").collect():
        found[r.question_id].append({k: v for k, v in r.asDict().items() if k not in ("question_id", "rank", "fused")})
    every = [r for rank in range(limit) for rows in found for r in rows[rank : rank + 1]]
    named_rows = sorted((r for r in every if r["name_match"]), key=lambda r: -r["name_match"])
    seats: dict[tuple, dict] = {}
    for row in [*named_rows, *(rows[0] for rows in found if rows)]:
        seats.setdefault((row["source"], row["key"]), row)
    for quota in (max(2, limit // 3), limit):
        for row in every:
            if sum(s == row["source"] for s, _ in seats) < quota or quota == limit:
                seats.setdefault((row["source"], row["key"]), row) if len(seats) < limit else None
    return list(seats.values())[:limit]


def recall(index: DataFrame, wanted: dict[str, tuple[str, str]], ks: tuple[int, ...] = (1, 3, 8), domain: Domain | None = None, dense: DataFrame | None = None) -> dict[int, float]:
    """The share of questions whose wanted (source, key) is among the first k found; all are searched together.
    ``dense`` is a ranked list (question_id, source, key, rank), ids being the places of the questions."""
    from tidemark.plans import batch

    spark, most = index.sparkSession, max(ks)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "question_id int, text string")
    answers = spark.createDataFrame([(i, *row) for i, row in enumerate(wanted.values())], "question_id int, source string, key string")
    places = answers.join(batch.discover_all(index, asked, most, domain, dense=dense).select("question_id", "source", "key", "rank"), ["question_id", "source", "key"], "left")
    first = places.groupBy("question_id").agg(F.min("rank").alias("rank"))
    row = first.agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in ks)).first()
    return {k: row[str(k)] or 0.0 for k in ks}
