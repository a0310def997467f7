"""Labels, numbers and dates of published tables, as column functions.

All of them are built from the engine's own functions, so they run inside generated code. Nulls give
nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a one-letter ASCII decomposition in lower case, and accented Latin
# letters beside the letter they fold to.
LETTERS = "çğıöşüÇĞİÖŞÜâîûÂÎÛàáãäåèéêëìíïñòóôõùúýÿÀÁÃÄÅÈÉÊËÌÍÏÑÒÓÔÕÙÚÝ"
PLAIN = "cgiosucgiosuaiuaiuaaaaaeeeeiiinoooouuyyaaaaaeeeeiiinoooouuy"
# Month names by number, spelled with and without their accents.
MONTHS = (("ocak",), ("şubat", "subat"), ("mart",), ("nisan",), ("mayıs", "mayis"), ("haziran",), ("temmuz",), ("ağustos", "agustos"), ("eylül", "eylul"), ("ekim",), ("kasım", "kasim"), ("aralık", "aralik"))
ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Units that a label states in brackets behind its name.
UNITS = {"%": "%", "yüzde": "%", "adet": "adet", "bin tl": "bin TL", "gün": "gün", "kişi": "kişi"}
# Units and the folded words that name them, most specific first.
UNIT_NAMES = {
    "milyar ABD doları": ("milyar abd dolar",),
    "milyon ABD doları": ("milyon abd dolar",),
    "milyar TL": ("milyar tl",),
    "milyon TL": ("milyon tl",),
    "bin TL": ("bin tl",),
    "TL": ("turk lirasi", "deger (tl"),
    "TL/kg": ("tl/kg",),
    "TL/gr": ("tl/gr",),
    "USD/ons": ("usd/ons",),
    "Euro/ons": ("euro/ons",),
    "m2": ("metrekare", "m2"),
    "bin kişi": ("bin kisi",),
    "%": ("%", "yuzde"),
    "endeks": ("endeks", "=100"),
    "adet": ("adet", "sayisi", "islem"),
}
#: Names that count as whole words only, and such that must be all there is.
WHOLE_WORDS, WHOLE_TEXTS = ("adet", "sayisi"), ("islem",)
#: Signs that stand apart from words, and endings between the numbers of a spelled range.
SIGNS, FROM, UPTO = "/(=%", ("den", "dan"), ("ya", "ye", "a", "e")
MARKS = "*†‡"


def fold(text: Column) -> Column:
    """Lower-case ASCII-like form for searching; letters are exchanged before lowering, since the
    lower case of a dotted capital I is not i. Combining marks are dropped."""
    return F.regexp_replace(F.lower(F.translate(text, LETTERS, PLAIN)), r"\p{M}+", "")


def ascii_fold(text: Column) -> Column:
    """`fold`, without what is still not ASCII."""
    return F.regexp_replace(fold(text), r"[^\x00-\x7F]", "")


def slug(text: Column) -> Column:
    """A stable key: folded, other characters as single underscores."""
    return F.trim(F.regexp_replace(fold(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def qualified(parent: Column, own: Column) -> Column:
    """parent/own, or own alone without a parent."""
    return F.when(F.coalesce(parent, F.lit("")) == "", own).otherwise(F.concat_ws("/", parent, own))


def split_camel(text: Column) -> Column:
    """A space before each capital that follows a small letter or digit."""
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")


DIGITS, OPERATORS, BRACKETS = "0123456789", "+-*/…", "[]()'’"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def trailing_groups(text: Column) -> Column:
    """How many characters at the end of a text are groups in brackets joined by plus and minus, with numbers
    among them; 0 where the text ends otherwise.

    One scan from the end counts brackets. Before a whole group only a sign may go on; a letter, or a
    bracket that has no partner, stops.
    """
    start = F.struct(*(F.lit(0).alias(n) for n in ("depth", "seen", "taken")), F.lit(False).alias("joined"), F.lit(False).alias("stopped"))

    def step(s, c):
        closing, opening, sign = c.isin(")", "]"), c.isin("(", "["), c.isin("+", "-")
        blank, digit = F.trim(c) == "", c.between("0", "9")
        outside = s["depth"] == 0
        stops = s["stopped"] | (outside & (opening | ~(closing | sign | blank | digit) | (s["joined"] & (closing | digit))))
        begins = ~stops & opening & (s["depth"] == 1)
        return F.struct(
            F.when(stops, s["depth"]).otherwise(s["depth"] + closing.cast("int") - opening.cast("int")).alias("depth"), (s["seen"] + 1).alias("seen"), F.when(begins, s["seen"] + 1).otherwise(s["taken"]).alias("taken"),
            F.when(begins, True).when(outside & sign, False).otherwise(s["joined"]).alias("joined"), stops.alias("stopped"),
        )

    letters = F.reverse(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, start, step, lambda s: s["taken"])


def spelled_range(group: Column) -> Column:
    """Whether a group in brackets is a range in words: a number, from, a number, up to."""
    apart = F.regexp_replace(F.lower(group), "([0-9])([a-z])", "$1 $2")
    words = F.filter(F.split(F.translate(apart, "()'’", "    "), r"\s+"), lambda w: w != "")
    number = lambda w: F.coalesce(w.rlike("^[0-9]+$"), F.lit(False))
    return F.startswith(group, F.lit("(")) & (F.size(words) == 4) & number(F.get(words, F.lit(0))) & number(F.get(words, F.lit(2))) & F.coalesce(F.get(words, F.lit(1)).isin(*FROM) & F.get(words, F.lit(3)).isin(*UPTO), F.lit(False))


def strip_decorations(label: Column, passes: int = 6) -> Column:
    """A struct of name, formula, footnote and unit: what follows a name is peeled off its end, in any
    order, a few times over."""
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    state = lambda n, f, o, u: F.struct(F.trim(n).alias("name"), f.alias("formula"), o.alias("footnote"), u.alias("unit"))
    lacks = lambda text, signs: F.length(F.translate(text, signs, "")) == F.length(text)

    def footnote(s):
        bare = F.rtrim(s["name"], F.lit(MARKS))
        return state(bare, s["formula"], F.concat(F.substring(s["name"], F.length(bare) + 1, F.length(s["name"])), s["footnote"]), s["unit"])

    def bracketed(s):
        def peeled(found):
            body = F.substring(s["name"], F.length(s["name"]) - found + 1, F.length(s["name"]))
            rest = F.substring(s["name"], F.lit(1), F.length(s["name"]) - found)
            only = F.trim(F.translate(body, DIGITS + OPERATORS + BRACKETS + ".", "")) == ""
            arithmetic = (found > 0) & only & ~lacks(body, DIGITS) & (~lacks(body, OPERATORS) | F.contains(body, F.lit("..")))
            formula = arithmetic | ((found > 0) & spelled_range(body))
            inner = F.trim(F.lower(F.substring(body, F.lit(2), F.length(body) - 2)))
            unit = F.when((found > 0) & F.startswith(body, F.lit("(")) & ~formula, F.try_element_at(known, inner))
            return F.when(formula, state(rest, body, s["footnote"], s["unit"])).when(unit.isNotNull(), state(rest, s["formula"], s["footnote"], unit)).otherwise(state(s["name"], s["formula"], s["footnote"], s["unit"]))

        return let(trailing_groups(s["name"]), peeled)

    start = state(F.trim(label), F.lit(""), F.lit(""), F.lit(None).cast("string"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, lambda s, _: let(footnote(s), bracketed))


def canonical_key(label: Column) -> Column:
    """The slug of a label's name."""
    return slug(strip_decorations(label)["name"])


def formula_terms(formula: Column) -> Column:
    """Signed positions of an additive formula as array<struct<sign,position>>; null where it multiplies or
    divides. Ranges (a+...+b and the spelled form) are filled in; a minus before a group holds for all of it."""
    spelled = F.regexp_extract(formula, r"\(\s*(\d+)\s*(?:den|dan)\s*(\d+)", 1)
    spelled_to = F.regexp_extract(formula, r"\(\s*(\d+)\s*(?:den|dan)\s*(\d+)", 2)
    flat = F.regexp_replace(formula, r"\s|'|’", "")
    flat = F.regexp_replace(flat, r"(\d+)\+?(?:\.{2,}|…)\+?(\d+)", "$1..$2")
    negative = F.transform(F.regexp_extract_all(flat, F.lit(r"-[(\[]([^()\[\]]*)[)\]]"), F.lit(1)), lambda g: F.regexp_replace(g, r"^(?=\d)", "+"))
    positive = F.regexp_replace(flat, r"-[(\[][^()\[\]]*[)\]]", "")
    terms = lambda text, flip: F.transform(F.regexp_extract_all(text, F.lit(r"[+\-]?\d+(?:\.\.\d+)?"), F.lit(0)), lambda t: F.struct((F.when(F.startswith(t, F.lit("-")), -1).otherwise(1) * flip).alias("sign"), F.regexp_replace(t, r"^[+\-]", "").alias("span")))
    both = F.concat(terms(positive, 1), terms(F.array_join(negative, "+"), -1))
    filled = F.flatten(F.transform(both, lambda t: F.transform(F.sequence(F.split(t["span"], r"\.\.")[0].cast("int"), F.element_at(F.split(t["span"], r"\.\."), -1).cast("int")), lambda p: F.struct(t["sign"].alias("sign"), p.alias("position")))))
    ranged = F.transform(F.sequence(spelled.cast("int"), spelled_to.cast("int")), lambda p: F.struct(F.lit(1).alias("sign"), p.alias("position")))
    return F.when(flat.rlike(r"[*/]"), F.lit(None)).when(spelled != "", F.when(spelled != "", ranged)).when(flat.rlike(r"\d"), filled)


def parse_number(text: Column, comma_decimal: Column) -> Column:
    """A number as published; ``comma_decimal`` is the convention of its column, from `comma_decimals`.
    Unreadable text gives null."""
    bare = F.rtrim(F.regexp_replace(F.trim(text), "[  ]", ""), F.lit("%"))
    turned = F.when(comma_decimal, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return turned.try_cast("double")


def comma_decimals(text: Column) -> Column:
    """An aggregate: whether a column writes decimals with a comma. One number that can only be read one way
    settles it; a number with groups by comma outweighs those with a single comma."""
    bare = F.rtrim(F.regexp_replace(F.trim(text), "[ \u00a0]", ""), F.lit("%"))

    def says(number):
        parts = F.split(F.ltrim(number, F.lit("-")), "[.,]")
        signs = F.translate(number, DIGITS + "-", "")
        grouped = lambda upto: (F.length(parts[0]) <= 3) & F.forall(F.slice(parts, 2, F.greatest(upto, F.lit(0))), lambda p: F.length(p) == 3)
        after, kinds = F.length(signs), F.size(F.array_distinct(F.filter(F.split(signs, ""), lambda c: c != "")))
        decimal = F.substring(signs, -1, 1)
        mixed = (kinds == 2) & (F.length(F.translate(signs, ".", "")) == 1) & (decimal == ",") & grouped(after - 1)
        swapped = (kinds == 2) & (F.length(F.translate(signs, ".", "")) == 1) & (decimal == ".") & grouped(after - 1)
        comma = mixed | ((kinds == 1) & (decimal == ".") & grouped(after)) | (signs == ",")
        return F.struct(comma.alias("comma"), (swapped | ((kinds == 1) & (decimal == ",") & grouped(after))).alias("point"))

    readable = (F.translate(bare, DIGITS + ".,-", "") == "") & F.forall(F.split(F.ltrim(bare, F.lit("-")), "[.,]"), lambda p: (p != "") & ~F.contains(p, F.lit("-")))
    found = F.when(readable, let(bare, says))
    return F.coalesce(F.bool_or(found["comma"]), F.lit(False)) & ~F.coalesce(F.bool_or(found["point"]), F.lit(False))


def without_translation(text: Column) -> Column:
    """A name and its translation behind a slash, as the name alone; slashes before digits stay."""
    parts = F.split(text, "/")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(F.trim(p).rlike("^[A-Za-z]"), F.concat(F.lit(" "), F.array_join(F.slice(F.split(F.trim(p), " "), 2, F.size(F.split(p, " "))), " "))).otherwise(F.concat(F.lit("/"), p)))
    return F.trim(F.concat(F.rtrim(parts[0]), F.array_join(rest, "")))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three integers, null where there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """A date: year-first as it is, else day-first, with month names in two languages; a name and a year is
    the first of the month. Years before 1900 or after 2100, and what is no date, give null."""
    bare = F.lower(F.translate(without_translation(F.trim(text)), "İI", "iı"))
    for i, (names, english) in enumerate(zip(MONTHS, ENGLISH, strict=True), start=1):
        bare = F.regexp_replace(bare, rf"\b(?:{'|'.join((*names, english, english.replace('i', 'ı')))})\b", str(i))
    parts = lambda p, y, m, d: F.when(bare.rlike(p), date_of(*(F.regexp_extract(bare, p, g).try_cast("int") if g else F.lit(1) for g in (y, m, d))))
    found = F.coalesce(
        parts(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ t].*)?$", 1, 2, 3),
        parts(r"^(\d{1,2})[./\- ](\d{1,2})[./\- ](\d{4})$", 3, 2, 1),
        parts(r"^(\d{1,2})[./\- ](\d{4})$", 2, 1, 0),
        parts(r"^(\d{4})[./\- ](\d{1,2})$", 1, 2, 0),
    )
    return F.when(F.year(found).between(1900, 2100), found)


def parse_period_label(text: Column) -> Column:
    """dd-mm-yyyy, yyyy-m or yyyy-Qn as a struct of date and grain; a quarter sits on its last month."""
    year = F.substring(text, 1, 4).try_cast("int")
    day = F.when(text.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.struct(F.try_to_date(text, "dd-MM-yyyy").alias("date"), F.lit("day").alias("grain")))
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.struct(date_of(year, F.regexp_extract(text, r"-(\d{1,2})$", 1).try_cast("int"), F.lit(1)).alias("date"), F.lit("month").alias("grain")))
    quarter = F.when(text.rlike(r"^\d{4}-Q[1-4]$"), F.struct(date_of(year, 3 * F.regexp_extract(text, r"Q([1-4])$", 1).try_cast("int"), F.lit(1)).alias("date"), F.lit("quarter").alias("grain")))
    return F.coalesce(day, month, quarter)


def spaced(text: Column) -> Column:
    """A folded text as words with one space before each; signs are words of their own."""
    out = fold(F.trim(text))
    for sign in SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(f" {sign} "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"\s+", " ")))


def scan_units(text: Column) -> Column:
    """All units a text names, in the order of the vocabulary: a name counts where its words begin words of the text."""

    def named(words: Column, name: str) -> Column:
        plain = name
        for sign in SIGNS:
            plain = plain.replace(sign, f" {sign} ")
        sought = " " + " ".join(plain.split())
        if name in WHOLE_TEXTS:
            return words == sought
        if name in WHOLE_WORDS:
            return F.array_contains(F.split(words, "[^a-z0-9]+"), sought.strip())
        return F.contains(words, F.lit(sought))

    def found(words: Column) -> Column:
        hits = []
        for unit, names in UNIT_NAMES.items():
            hit = named(words, names[0])
            for other in names[1:]:
                hit = hit | named(words, other)
            hits.append(F.when(hit, F.lit(unit)))
        return F.array_compact(F.array(*hits))

    return let(spaced(text), found)


def resolve_unit(name: Column, group_unit: Column, semantics: Column, overridden: Column) -> Column:
    """The one unit of a series, or null where nothing states it.

    Evidence is asked in turn: the unit of its group, unless the series is declared apart from it; its own
    name; both narrowed by what the semantics allow (a rate is a percentage, an index a number, anything else
    neither); and last the semantics alone.
    """
    group = F.when(F.coalesce(overridden, F.lit(False)) | group_unit.isNull(), F.array().cast("array<string>")).otherwise(scan_units(group_unit))
    own = scan_units(name)
    says = F.when((F.size(group) == 1) | (F.size(own) == 0), group).otherwise(own)
    implied = F.when(semantics == "rate", "%").when(semantics == "index", "endeks")

    def narrowed(units):
        amounts = F.array_except(units, F.array(F.lit("%"), F.lit("endeks")))
        one = F.when(F.size(units) == 1, units[0]).when(F.coalesce(F.array_contains(units, implied), F.lit(False)), implied).when(F.size(amounts) == 1, amounts[0])
        return F.coalesce(one, implied)

    return let(says, narrowed)


#: Words for powers of a thousand, and currencies whose amounts are rescaled by them.
SCALES = {"": 0, "bin": 3, "milyon": 6, "milyar": 9, "trilyon": 12}
MONEY = ("TL", "USD", "EUR", "ABD doları")


def signed_number(value: Column, digits: int, signed: bool) -> Column:
    """`format_number`, with a plus before what is not negative if asked."""
    return F.concat(F.when(F.lit(signed) & (value >= 0), "+").otherwise(""), format_number(value, digits))


def format_quantity(value: Column, unit: Column, signed: bool = False) -> Column:
    """A figure with its unit: amounts at the largest scale that leaves at least 1, percent
    signs in front, counts whole; a dash for null."""
    unit = F.trim(F.coalesce(unit, F.lit("")))
    word, last = F.element_at(F.split(unit, " "), 1), F.regexp_replace(unit, "^(?:bin|milyon|milyar|trilyon) ", "")
    power = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair)), word), F.lit(0))
    base = value * F.pow(F.lit(10.0), power)
    money = F.concat(signed_number(base, 2, signed), F.lit(" "), last)
    for scale in ("bin", "milyon", "milyar", "trilyon"):
        size = 10.0 ** SCALES[scale]
        money = F.when(F.abs(base) >= size, F.concat(signed_number(base / size, 2, signed), F.lit(f" {scale} "), last)).otherwise(money)
    plain = F.rtrim(F.concat(signed_number(value, 2, signed), F.lit(" "), unit))
    return F.when(value.isNull(), "-").when(unit == "%", F.concat(F.lit("%"), signed_number(value, 2, signed))).when(last.isin(*MONEY), money).when(unit == "adet", F.concat(signed_number(value, 0, signed), F.lit(" adet"))).otherwise(plain)


def format_change(points: Column, percent: Column) -> Column:
    """The change of a rate in points, else of an amount in percent, else null."""
    return F.coalesce(F.concat(signed_number(points, 2, True), F.lit(" puan")), F.concat(F.lit("%"), signed_number(percent, 1, True)))


def caption_unit(caption: Column) -> Column:
    """The monetary unit a caption states in brackets, or null."""
    found = F.regexp_extract(caption, r"(?i)\(\s*((?:bin|milyon|milyar)\s+TL)\s*\)", 1)
    return F.when(found != "", F.concat(F.lower(F.regexp_extract(found, r"^\S+", 0)), F.lit(" TL")))


def format_number(value: Column, digits: int = 2) -> Column:
    """Thousands by point and decimals by comma."""
    return F.translate(F.format_number(value, digits), ",.", ".,")
