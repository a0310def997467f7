"""The filter audit, the lexical search and the quality rules against brute force, with the awkward rows."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, lexical, rules, runs
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def awkward(rng, n=120):
    """Rows with repeats, ties, null and empty texts, white space of all kinds and one long text."""
    say = lambda k, words: rng.choice((" ", "\n", "\t ", " ", "\x0b")).join(rng.choices(words, k=k))
    words = ["a", "B", "ÄÖ", "x1", "#tag", "été", "THE", "end.", "a-b", "漢字", " q", "I"]
    texts = [None, "", "  \n\t", "x", "a b c d e f g h i a b c d e f g h", "line one\nline one\n\n\nline one \nline one", "\n", "a\n", "one two " * 30_000]
    texts += [say(rng.randint(1, 400), words[: rng.randint(1, len(words))]) for _ in range(n)]
    texts += texts[3:30]
    return [(None if i == 17 else i if i != 40 else 39, t, rng.choice(["web", "books", None, "", "web", "web"])) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "'c' AS class", "7L AS n", "'s' AS score").repartition(3)


# The audit


def fails(text, doc_id, first):
    text = text or ""
    w = WORDS.findall(text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and first.get(text, doc_id) < doc_id}


def brute_audit(rows, good, toxic):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = [(p or "", i, fails(t, i, first)) for i, t, p in rows]
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            for part in {p for p, _, _ in judged}:
                c = Counter()
                for p, i, failed in judged:
                    if p == part:
                        earlier = any(failed[x] for x in order[: step - 1])
                        c["kept"] += not earlier and not failed[f]
                        c["removed"] += failed[f] and not earlier
                        c["redundant"] += failed[f] and earlier
                        c["unique_fails"] += [x for x in "ABCDE" if failed[x]] == [f]
                        c["good_lost"] += failed[f] and not earlier and i in good
                        c["toxic_lost"] += failed[f] and not earlier and i in toxic
                out[part, order, step] = c
    for (part, order, step), c in out.items():
        c["shapley"] = sum(x["removed"] for (p, o, s), x in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def test_audit_equals_the_filters_applied_one_by_one(spark, rows, docs):
    labels = [(i, i % 3 == 0, i % 7 == 0) for i in range(150)] + [(9, 0, 0), (10, 1, None), (None, 1, 1), (11, None, 1)]
    found = audit.audit(docs, spark.createDataFrame([(i, None if g is None else int(g), None if t is None else int(t)) for i, g, t in labels], "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): {c: r[c] for c in audit.COUNTS} for r in found.collect()}
    want = brute_audit(rows, {i for i, g, _ in labels if g and i is not None}, {i for i, _, t in labels if t and i is not None})
    assert got.keys() == want.keys() and len(got) == 3 * 600
    assert all(got[k] == {c: want[k][c] for c in audit.COUNTS} for k in want)


def test_audit_of_no_rows_and_of_few_parts_at_a_time(spark, docs, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).count() == 0
    whole = sorted(map(str, audit.audit(docs, labels).collect()))
    counted = audit.histograms(audit.masks(docs), labels)
    monkeypatch.setattr(audit, "PARTS", 1)
    assert sorted(map(str, audit.interactions(counted).collect())) == whole


def test_copies_in_many_rows_are_counted_once_as_first(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 else f"text {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    found = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").first()
    assert (found.kept, found.removed) == (1001, 1999)


# The search


def brute_search(rows, items, k):
    tokens = [(i, TERMS.findall((t or "").translate(LOWER))) for i, t, _ in rows]
    tokens = [(i, w) for i, w in tokens if w]
    n_docs, n_terms = len(tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = {}
    for item, text in items:
        scored = []
        for i, w in tokens:
            tf, m = Counter(w), 75 + 25 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in TERMS.findall((text or "").translate(LOWER)) if tf[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return {item: found for item, found in out.items() if found}


ITEMS = [(1, "a x1 été THE the"), (2, "end 漢字 a a a a tag"), (3, "nothing of this kind"), (4, None), (5, ""), (6, "q i b a ÄÖ one two line"), (7, "x"), (8, "line One"), (None, "a b"), (9, "c d e f g h")]


@pytest.mark.parametrize(("k", "block", "slab"), [(20, lexical.BLOCK, 65_536), (3, lexical.BLOCK, 40), (5, 200, 65_536), (500, lexical.BLOCK, 7)])
def test_search_equals_brute_force(spark, rows, docs, monkeypatch, k, block, slab):
    monkeypatch.setattr(lexical, "SLAB_ROWS", slab)
    monkeypatch.setattr(lexical, "LISTED", 4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 AS score", "'d' AS doc_id")
    got = {}
    for r in lexical.search(docs, items, k, block=block).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    assert got == brute_search(rows, [i for i in ITEMS if i[0] is not None], k)


def test_search_takes_the_least_text_of_a_repeated_item_and_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "zz"), (1, "a")], "item_id long, text string")
    alone = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == lexical.search(docs, alone).collect()
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_search_skips_postings_once_the_list_is_short(monkeypatch):
    """A rare term decides, so most postings of the frequent one are never added."""
    n = 5000
    rng = np.random.default_rng(1)
    length = rng.integers(50, 500, n)
    rare = np.arange(n) % 100 == 0
    bounds = np.concatenate([[0], np.cumsum(1 + rare)])
    term = np.concatenate([[0, 1] if r else [0] for r in rare])
    times = np.ones(len(term), np.int64)
    weights = np.array([400, 9000], np.int64)
    one = lexical.Searcher([(np.array([0, 1]), np.array([1, 1]))], weights, n, int(length.sum()), 20, np.zeros(1, np.int64))
    completed = []
    monkeypatch.setattr(lexical.Searcher, "_complete", lambda self, i, listed, *f, real=lexical.Searcher._complete: completed.append(len(listed)) or real(self, i, listed, *f))
    [(found, scores)] = one.best(length, bounds, term, times, np.arange(n))
    impact = one.impacts(length, np.repeat(np.arange(n), np.diff(bounds)), term, times)
    total = np.add.reduceat(impact, bounds[:-1])
    want = np.lexsort((np.arange(n), -total))[:20]
    assert list(found) == list(want) and list(scores) == list(total[want])
    assert completed and completed[0] <= max(lexical.LISTED, 40)


# The rules


def brute_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("most", [runs.SLAB, 300])
def test_measures_equal_brute_force(rows, most):
    texts = [t for _, t, _ in rows]
    got = [list(map(int, r)) for slab in runs.slabs(pa.array(texts, pa.string()).slice(2), most) for r in rules.measures(slab, runs.runs(slab, runs.WORD))]
    assert got == [list(brute_measures(t)) for t in texts[2:]]


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(rules, "FACTORS", np.zeros(9, np.uint64))
    for text in ("a b c d e f g h " * 2 + "i j k l m n o p", " ".join(map(str, range(40)))):
        slab = next(runs.slabs(pa.array([text, text])))
        assert list(rules.repeated_words(runs.runs(slab, runs.WORD), 2)) == [brute_measures(text)[4]] * 2


def test_rules_judge_every_row(spark, rows, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = rules.learn(table, labels, lambda i: ~held_out(i, 5, 0))
    got = rules.judge(docs, model, 0.3).collect()
    assert sorted(map(str, ((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in got))) == sorted(map(str, ((i, *brute_measures(t)) for i, t, _ in rows)))
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= 0.3) and 0 <= r.score <= 1
    assert rules.judge(docs.limit(0), model, 0.3).count() == 0
    aside = rules.judge(table, model, 0.3).join(labels, "doc_id").where(held_out(F.col("doc_id"), 5, 0)).where("NOT base_failed").toPandas()
    assert (aside.kept == (aside.quality == 1)).mean() > 0.95
    loss = -np.where(aside.quality == 1, np.log(aside.score.clip(1e-6, 1)), np.log((1 - aside.score).clip(1e-6, 1))).mean()
    assert loss < 0.2  # calibrated: far below the loss of the labels' share
    constant = rules.learn(table, labels.limit(0), lambda i: F.lit(True))
    assert {r.score for r in rules.judge(docs, constant, 0.3).collect()} == {0.5}


def test_rules_do_not_depend_on_the_company_of_a_text(rows):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["stone", "river", "cloud", "garden", "light"], k=60)) for _ in range(60)]
    bad = [" ".join(rng.choices(["win!!", "cash$$", "CLICK", "now###"], k=60)) for _ in range(60)]
    model = rules.train(good + bad, [1] * 60 + [0] * 60)
    score = lambda texts: np.concatenate([model.probability(model.logits(s, runs.runs(s, runs.WORD))) for s in runs.slabs(pa.array(texts, pa.string()))])
    texts = [t for _, t, _ in rows] + good[:3] + bad[:3]
    assert np.allclose(score(texts), np.concatenate([score([t]) for t in texts]), atol=2e-9)
    assert score(good[:3]).min() > 0.8 and score(bad[:3]).max() < 0.2
