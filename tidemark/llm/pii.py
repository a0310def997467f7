"""Personal data: fixed formats, and spans chosen among overlapping proposals by boosted trees.

Everything on the rows is an expression of built-in functions: matches come from
regexp_extract_all, their offsets from the lengths of what split leaves between them, features from
the match and some characters around it, and the trees are sums of CASE expressions.

The trees are trained on the driver from generated labelled examples, whose features are computed by
the same expressions; one threshold a generator is calibrated on examples kept aside.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in the order in which they are listed, and their base formats. The forms
# below match the same text as
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# but try a run of characters only from its start, and never give back what cannot help.
KINDS = ("email", "ip", "card", "phone", "number")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
#: High-recall generators of further spans: the kind, the pattern, and what a text must hold.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+", r"(?:\[|\(|\{)at(?:\]|\)|\})"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{3}"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("number", r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}"),
    ("number", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{4}[./][0-9]{4}[./]"),
)
CONTEXT = 32
FEATURES = ("generator", "chars", "digits", "groups", "longest", "brackets", "dots", "hyphens", "spaces", "luhn", "years", "letters", "before_word", "personal", "impersonal", "repeats")
PERSONAL = r"(?i)(?:phone|tel|call|fax|mobile|cell|contact|reach|mail|card|visa|iban|account|ssn|social|security|address|host|server|client|login|user|dial|whatsapp|sms)[^0-9A-Za-z]{0,8}(?:[a-z]{1,8}[^0-9A-Za-z]{0,4})?$"
IMPERSONAL = r"(?i)(?:isbn|issn|version|ver|order|invoice|part|model|page|pages|pp|table|fig|figure|no|nr|ref|date|serial|sku|item|lot|batch|doi|score|range|coordinates|build)[^0-9A-Za-z]{0,8}(?:[a-z]{1,8}[^0-9A-Za-z]{0,4})?$"
BLOCK = 128


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def offsets(gaps: Column, matches: Column) -> Column:
    """Starts, in code points, of matches of the lengths ``matches``, with texts of the lengths ``gaps``
    between them: running sums over blocks of BLOCK matches."""
    n = F.size(matches)
    empty = F.array().cast("array<int>")

    def block(b):
        at = b * BLOCK + 1
        steps = F.zip_with(F.slice(gaps, at, F.lit(BLOCK)), F.slice(matches, at, F.lit(BLOCK)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        steps = F.filter(steps, lambda s: s["m"].isNotNull())
        start = F.struct(F.lit(0).alias("sum"), empty.alias("starts"))
        return F.aggregate(steps, start, lambda s, x: F.struct((s["sum"] + x["g"] + x["m"]).alias("sum"), F.concat(s["starts"], F.array(s["sum"] + x["g"])).alias("starts")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    shifted = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("all")),
        lambda s, b: F.struct((s["sum"] + b["sum"]).alias("sum"), F.concat(s["all"], F.array(F.transform(b["starts"], lambda x: x + s["sum"]))).alias("all")),
    )["all"]
    return F.flatten(shifted)


def located(text: Column, pattern: str, kind: int, needs: Column | None = None, generator: int | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern as structs (kind, s, e, m), those of a generator with its
    number and the CONTEXT characters ``before``: the end of what lies behind the match before the last."""
    fields = "kind:int,s:int,e:int,m:string" + (",generator:int,before:string" if generator is not None else "")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs is not None:
        matches = F.when(needs, matches).otherwise(F.array().cast("array<string>"))

    def spans(matches, gaps, starts):
        def one(m, i):
            own = [F.lit(kind).alias("kind"), F.get(starts, i).alias("s"), (F.get(starts, i) + F.length(m)).alias("e"), m.alias("m")]
            if generator is not None:
                before = F.concat(F.when(i > 0, F.get(matches, i - 1)).otherwise(""), F.get(gaps, i))
                own += [F.lit(generator).alias("generator"), F.substring(before, -CONTEXT, CONTEXT).alias("before")]
            return F.struct(*own)

        return F.transform(matches, one)

    def over_gaps(matches):
        lengths = lambda v: F.transform(v, F.length)
        return let(F.split(text, pattern, -1), lambda gaps: let(F.struct(lengths(gaps).alias("g"), lengths(matches).alias("m")), lambda x: let(offsets(x["g"], x["m"]), lambda starts: spans(matches, gaps, starts))))

    return let(matches, lambda v: F.when(F.size(v) > 0, over_gaps(v)).otherwise(F.array().cast(f"array<struct<{fields}>>")))


def valid(kind: str, match: Column) -> Column:
    """The check a base match must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed and then by start."""
    parts = []
    for i, kind in enumerate(KINDS[:4]):
        needs = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(None)
        spans = located(text, BASE[kind], i, needs if kind in NEEDS else None)
        parts.append(_checked(spans, kind))
    return F.concat(*parts)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: valid(kind, x["m"]))


def proposals(text: Column) -> Column:
    """The generators' spans as structs (kind, s, e, m, generator, before); spans of several may overlap."""
    return F.concat(*(located(text, pattern, KINDS.index(kind), text.rlike(needs), g) for g, (kind, pattern, needs) in enumerate(GENERATORS)))


def _number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def features(p: Column) -> dict[str, Column]:
    """Format and context features of a proposal, as numbers."""
    m, before = p["m"], p["before"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    count = lambda c: (F.length(m) - F.length(F.regexp_replace(m, c, ""))).cast("int")
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    values = (
        p["generator"], F.length(m), F.length(digits), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), count(r"[()\[\]{}]"), count("[.]"), count("-"), count(" "),
        F.coalesce(F.call_function("luhn_check", digits) & (F.length(digits) > 0), F.lit(False)).cast("int"), m.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])").cast("int"), count("[A-Za-z]"), before.rlike(r"[A-Za-z]\W*$").cast("int"), before.rlike(PERSONAL).cast("int"), before.rlike(IMPERSONAL).cast("int"),
        (F.length(digits) - F.size(F.array_distinct(F.split(digits, "")))).cast("int"),
    )
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested tuples (feature, cut, below, above) with numbers as leaves; a threshold a generator."""

    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, x: Column) -> Column:
        """The sum of all trees on a struct of features."""

        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, below, above = node
            return F.when(x[FEATURES[f]] <= cut, walk(below)).otherwise(walk(above))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walk(tree)
        return total

    def accepts(self, x: Column, score: Column) -> Column:
        """Whether a score reaches its generator's threshold."""
        limit = F.lit(float("inf"))
        for g, t in enumerate(self.thresholds):
            limit = F.when(x["generator"] == g, F.lit(t)).otherwise(limit)
        return score >= limit


def examples(n: int, seed: int) -> list[tuple[str, int]]:
    """Labelled texts, each with one proposal: personal (1) or another thing of the same form (0)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    h = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    cue = lambda names: rng.choice(names) + rng.choice([": ", " ", " is ", " at ", " = "])
    phone = lambda: rng.choice([f"({d(3)}) 555-{d(4)}", f"{rng.randint(200, 999)}-{d(3)}-{d(4)}", f"{rng.randint(200, 999)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"])
    iban = lambda: rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + rng.choice(["", " "]).join(d(4) for _ in range(rng.randint(4, 6)))
    code = lambda: rng.choice(["AB", "XK", "PO", "TX"]) + d(2) + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.choice([8, 12])))
    yes = (
        lambda: f"{word()}.{word()}{rng.choice([' ', ''])}{rng.choice(['[at]', '(at)', '{at}'])}{rng.choice([' ', ''])}{word()}{rng.choice([' [dot] ', '(dot)', '.'])}com",
        lambda: cue(["phone", "tel", "call me", "Fax", "mobile", "contact"]) + phone(), lambda: cue(["host", "client address", "server", "login from"]) + ":".join(h(rng.randint(1, 4)) for _ in range(8)), lambda: cue(["SSN", "social security number", "social"]) + f"{d(3)}-{d(2)}-{d(4)}",
        lambda: cue(["IBAN", "account", "my account"]) + iban(), lambda: cue(["card", "visa", "Card number"]) + rng.choice("./").join(d(4) for _ in range(4)), lambda: "(" + str(rng.randint(200, 999)) + ") " + d(3) + "-" + d(4),
    )
    no = (
        lambda: f"{rng.randint(1990, 2030)} {d(3)} {d(4)}", lambda: cue(["ISBN", "order", "part", "invoice no", "ref", "serial"]) + f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: cue(["part", "lot", "item"]) + f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}",
        lambda: cue(["part", "model", "sku", "serial"]) + code(), lambda: cue(["version", "build", "date"]) + rng.choice("./").join(d(4) for _ in range(4)), lambda: cue(["table", "page", "pp"]) + f"{d(3)}.{d(3)}.{d(3)}", lambda: ":".join(d(2) for _ in range(8)), lambda: f"{words(1, 3)} {d(3)} {d(3)} {d(3)}", lambda: code(),
        lambda: f"{word()} (at) {word()}. {word().title()}",
    )
    out = []
    for i in range(n):
        kinds, label = (yes, 1) if i % 2 == 0 else (no, 0)
        out.append((f"{words(1, 6)} {kinds[(i // 2) % len(kinds)]()}{rng.choice([' ', ', ', '. ', ''])}{words(0, 4)}", label))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4, least: int = 8) -> list:
    """Gradient boosting of the log loss with Newton leaves; the first cut wins among equal gains."""
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6

        def grow(rows, level, g=g, h=h):
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            best = (1e-6, None)
            for f in range(x.shape[1]) if level else ():
                for cut in np.unique(x[rows, f])[:-1]:
                    low = rows[x[rows, f] <= cut]
                    if least <= len(low) <= len(rows) - least:
                        high_g, high_h = g[rows].sum() - g[low].sum(), h[rows].sum() - h[low].sum()
                        gain = g[low].sum() ** 2 / (h[low].sum() + 1) + high_g**2 / (high_h + 1) - whole
                        if gain > best[0]:
                            best = (gain, (f, float(cut)))
            if best[1] is None:
                return round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
            f, cut = best[1]
            under = x[rows, f] <= cut
            return (f, cut, grow(rows[under], level - 1), grow(rows[~under], level - 1))

        trees.append(grow(np.arange(len(y)), depth))
        score += np.array([value_of(trees[-1], r) for r in x])
    return trees


def value_of(node, row) -> float:
    """A tree's value on one row of features."""
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def learn(spark: SparkSession, n: int = 1600, seed: int = 13, precision: float = 0.99) -> Trees:
    """Trees and thresholds from ``n`` generated examples, a quarter of them kept aside to calibrate.

    A generator's threshold lies below the last score down to which at least ``precision`` of the
    examples kept aside are personal, halfway to the next one, and never below even odds.
    """
    made = examples(n, seed)
    lines = ", ".join("('{}', {}, {})".format(t.replace("\\", "\\\\").replace("'", "\\'"), label, i) for i, (t, label) in enumerate(made))
    df = spark.sql(f"SELECT * FROM VALUES {lines} AS v(text, label, i)")
    got = df.select("i", "label", F.explode(proposals(F.col("text"))).alias("p"))
    got = got.select("i", "label", *(v.cast("double").alias(k) for k, v in features(F.col("p")).items())).collect()
    got.sort(key=lambda r: (r.i, *r[2:]))
    x, y, aside = np.array([r[2:] for r in got]), np.array([r.label for r in got], float), np.array([r.i // 168 % 4 == 3 for r in got])
    trees = boost(x[~aside], y[~aside])
    score = np.array([sum(value_of(t, r) for t in trees) for r in x])
    thresholds = []
    for g in range(len(GENERATORS)):
        own = np.flatnonzero(aside & (x[:, 0] == g))
        order = own[np.argsort(-score[own])]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            thresholds.append(float("inf"))
            continue
        last = good[-1]
        lower = score[order[last + 1]] if last + 1 < len(order) else -np.inf
        thresholds.append(max(0.0, round(float(score[order[last]] + lower) / 2, 6)))
    return Trees(tuple(trees), tuple(thresholds))


def _key(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))


SPAN = "struct<s:int,e:int,kind:int,score:double>"
SWEEP = 64


def span(s: Column, e: Column, kind: Column, score: Column) -> Column:
    """A span for `swept`, ordered by where it starts."""
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), kind.cast("int").alias("kind"), score.cast("double").alias("score"))


def swept(spans: Column, start: Column, step, give) -> Column:
    """One pass over an array of spans with a state: ``step(state, x)`` is the next state, ``give(state, x)``
    the array of spans that x yields. Arrays grow by blocks of SWEEP, so the time follows their length."""
    state = start.alias("state")

    def over_block(done, block):
        inner = F.struct(done["state"].alias("state"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(
            block,
            inner,
            lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], give(a["state"], x)).alias("out")),
            lambda a: F.struct(a["state"].alias("state"), F.concat(done["all"], F.array(a["out"])).alias("all")),
        )

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / SWEEP), F.lit(0)).cast("int")), lambda b: F.slice(v, b * SWEEP + 1, F.lit(SWEEP)))
    return F.flatten(F.aggregate(let(spans, cut), F.struct(state, F.array().cast(f"array<array<{SPAN}>>").alias("all")), over_block, lambda a: a["all"]))


def apart_from(base: Column, good: Column) -> Column:
    """The spans of ``good`` that touch none of ``base``, in order: a pass forward looks at base spans that
    start earlier, one back at those that start later. Base spans have the score -inf."""
    is_base = lambda x: x["score"] == float("-inf")
    none = F.array().cast(f"array<{SPAN}>")
    forward = swept(F.array_sort(F.concat(base, good)), F.lit(0), lambda end, x: F.when(is_base(x), F.greatest(end, x["e"])).otherwise(end), lambda end, x: F.when(is_base(x) | (x["s"] >= end), F.array(x)).otherwise(none))
    back = swept(F.reverse(forward), F.lit(2**31 - 1), lambda at, x: F.when(is_base(x), F.least(at, x["s"])).otherwise(at), lambda at, x: F.when(~is_base(x) & (x["e"] <= at), F.array(x)).otherwise(none))
    return F.reverse(back)


def winners(good: Column) -> Column:
    """Of overlapping spans the best: from left to right a span is kept until a better one, by score and then
    by start, kind and end, overlaps it; what starts after the kept one's end is kept next."""
    none = F.array().cast(f"array<{SPAN}>")
    nothing = span(F.lit(-1), F.lit(-1), F.lit(-1), F.lit(float("-inf")))
    last = span(F.lit(2**31 - 1), F.lit(2**31 - 1), F.lit(-1), F.lit(0.0))
    better = lambda x, kept: x["score"] > kept["score"]
    step = lambda kept, x: F.when((x["s"] >= kept["e"]) | better(x, kept), x).otherwise(kept)
    give = lambda kept, x: F.when((x["s"] >= kept["e"]) & (kept["e"] > 0), F.array(kept)).otherwise(none)
    return swept(F.concat(good, F.array(last)), nothing, step, give)


def find(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text; one row per input row, no shuffle, no Python.

    Returns the id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added. Accepted proposals
    that touch a base span, or a better one, are left out. A null or empty text has no spans; a very long
    one is read whole, in time proportional to its length and the spans in it; repeated rows have the same spans; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col), text.alias("text")).select(id_col, base_spans(F.col("text")).alias("base"), (proposals(F.col("text")) if trees else F.array()).alias("proposed"))
    nothing = F.array().cast(f"array<{SPAN}>")
    if trees:
        scored = F.transform("proposed", lambda p: F.struct(F.struct(*(v.alias(k) for k, v in features(p).items())).alias("x"), p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
        scored = F.transform(scored, lambda p: F.struct(trees.score(p["x"]).alias("score"), p["x"].alias("x"), p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
        good = F.transform(F.filter(scored, lambda p: trees.accepts(p["x"], p["score"])), lambda p: span(p["s"], p["e"], p["kind"], p["score"]))
        found = found.withColumn("good", F.when(F.size("proposed") > 0, good).otherwise(nothing))
        base = F.transform("base", lambda b: span(b["s"], b["e"], b["kind"], F.lit(float("-inf"))))
        found = found.withColumn("free", F.when(F.size("good") > 0, apart_from(base, F.col("good"))).otherwise(nothing))
        found = found.withColumn("chosen", F.when(F.size("free") > 0, winners(F.col("free"))).otherwise(nothing))
    else:
        found = found.withColumn("chosen", nothing)
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    counts = [_number_of("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return found.select(
        id_col,
        *counts,
        F.sha2(F.array_join(F.transform("base", _key), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(F.concat(plain("base"), plain("chosen"))), _key), ",").alias("spans"),
        F.size("chosen").cast("long").alias("n_added"),
    )
