import dataclasses
import datetime as dt

import pytest

from tidemark.operators import search
from tidemark.plans import discovery
from tidemark.sources import grids

ROWS = [
    ("m", "konut_kredileri", "konut kredileri", "tuketici", "milyon TL", "stock", "monthly", None, 0),
    ("m", "konut_kredileri/takipteki", "takipteki konut kredileri", "tuketici", "milyon TL", "stock", "monthly", None, 1),
    ("w", "konut_kredileri_h", "konut kredileri", "haftalik", "milyon TL", "stock", "weekly", None, 0),
    ("x", "konut_faiz", "konut kredisi faiz orani", "faiz", "%", "rate", "weekly", 0, 0),
    ("x", "altin", "altin", "maden", "TL/gr", "rate", "daily", 1, 0),
]


@pytest.fixture
def index(spark):
    return spark.createDataFrame(ROWS, "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int")


def test_the_named_thing_comes_first(index):
    first = lambda q, **k: discovery.discover(index, q, 3, **k).first().key
    assert first("Konut kredileri aylık bakiye") == "konut_kredileri"
    assert first("haftalık konut kredileri") == "konut_kredileri_h"
    assert first("konut kredisi faiz oranı") == "konut_faiz"
    assert first("gold", domain=discovery.Domain(aliases={"gold": ("altin",)})) == "altin"
    assert discovery.discover(index, "ve ile", 3).count() == 0
    assert {r.key for r in discovery.discover(index, "konut", 5, per_source=1).collect()} == {"konut_kredileri", "konut_kredileri_h", "konut_faiz"}


def test_every_clause_gets_a_seat(index):
    assert discovery.clauses("a (b, c), d ve e") == ["a ( b , c )", "d", "e"]
    got = [r["key"] for r in discovery.discover_concepts(index, "konut kredileri aylık ve altın", 3)]
    assert got[:2] == ["konut_kredileri", "altin"]


def test_grids_down_across_and_with_year_and_month():
    down = [["Baslik", ""], ["Tarih", "Deger"], ["Ocak 2021", "1.234,5"], ["Şubat 2021", "2,5"], ["not", ""]]
    assert grids.series_of(down) == [("Deger", dt.date(2021, 1, 1), 1234.5), ("Deger", dt.date(2021, 2, 1), 2.5)]
    across = [["", "2021-01-01", "2021-02-01"], ["A", "1", "2"], ["B", "3", "4"]]
    assert grids.series_of(across)[2] == ("B", dt.date(2021, 1, 1), 3.0)
    parts = [["Yil", "Ay", "X"], ["2021", "Mayıs", "5"], ["2021", "Haziran", "6"]]
    assert grids.series_of(parts) == [("X", dt.date(2021, 5, 1), 5.0), ("X", dt.date(2021, 6, 1), 6.0)]
    with pytest.raises(grids.NoSeries):
        grids.series_of([["a", "b"], ["1", "2"]])
    assert grids.table_errors({"columns": ["p", "v"], "rows": [["2021-01-01", "1"], ["2021-01-01", "x"], ["?", "2"], ["2021-02-01"]]}) == ["row 1: the period occurs twice", "row 1: 'x' is no number", "row 2: no period", "row 3 has 1 cells"]


def test_tables_keep_their_contract_or_tell_what_breaks_it(spark):
    tables = {
        "good": [["Ad", "Tutar"], ["a", "1.234.567,1234567890123456789"], ["b", "-5"], ["c", "+7,50"]], "header": [["Ad", "Miktar"], ["a", "1"]], "hole": [["Ad", "Tutar"], ["a", ""], [None, "2"]], "short": [["Ad", "Tutar"], ["a"]], "long": [["Ad", "Tutar"], ["a", "1", "2"]],
        "english": [["Ad", "Tutar"], ["a", "1,234.5"], ["b", "12.34"]], "empty": [["Ad", "Tutar"]],
    }
    cells = [(k, i, j, t) for k, rows in tables.items() for i, row in enumerate(rows, 1) for j, t in enumerate(row, 1)]
    df = spark.createDataFrame(cells, "t string, row int, col int, text string")
    contract = grids.Contract(("Ad", "Tutar"), ("Tutar",), "milyon TL", "2024-03", "http://h/x", "2024-04-01", "s. 3", True, ",", ".")
    values, errors = grids.certified(df, ["t"], contract)
    assert [(r.row, r.number, str(r.value)) for r in values.where("column = 'Tutar'").orderBy("row").collect()] == [(2, "1234567.1234567890123456789", "1234567.123456789012345679"), (3, "-5", "-5.000000000000000000"), (4, "7.50", "7.500000000000000000")]
    assert {(r.unit, r.period, r.url, r.t) for r in values.collect()} == {("milyon TL", "2024-03", "http://h/x", "good")}
    assert {(r.t, r.row, r.why) for r in errors.collect()} == {("header", 1, "another header"), ("hole", 2, "an empty cell"), ("hole", 3, "an empty cell"), ("short", 2, "cells are missing"), ("long", 2, "more cells than columns"), ("english", 2, "no number"), ("english", 3, "no number"), ("empty", None, "no header or no rows")}
    for change, says in (({"verified": False}, "not verified"), ({"unit": " "}, "unit is missing"), ({"thousands": ","}, "separators"), ({"numeric": ("x",)}, "numeric"), ({"columns": ("Ad", "Ad")}, "each once")):
        with pytest.raises(ValueError, match=says):
            grids.certified(df, ["t"], dataclasses.replace(contract, **change))
    assert grids.certified(df.limit(0), ["t"], contract)[0].count() == 0


def test_sheets_become_series(spark):
    cells = [("s", i, j, t) for i, row in enumerate([["Tarih", "X"], ["01.02.2021", "5"], ["01.03.2021", "6"]]) for j, t in enumerate(row)] + [("bad", 0, 0, "x"), ("bad", 0, 1, "y")]
    out = grids.grid_series(spark.createDataFrame(cells, "sheet string, row int, col int, text string"), ["sheet"]).orderBy("period").collect()
    assert [(r.sheet, str(r.period), r.value) for r in out] == [("s", "2021-02-01", 5.0), ("s", "2021-03-01", 6.0)]


def test_documents_merge_by_any_key(spark):
    rows = [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u3", "h2"), (4, None, None), (5, "u5", "h5")]
    got = {r.i: r.canonical_id for r in search.merge_documents(spark.createDataFrame(rows, "i long, url string, digest string"), "i", ["url", "digest"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_long_chains_of_documents_merge(spark):
    rows = [(f"d{i:03}", f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(80)] + [("z", "other", None), (None, "u1", None)]
    got = {r.i: r.canonical_id for r in search.merge_documents(spark.createDataFrame(rows, "i string, url string, digest string"), "i", ["url", "digest"]).collect()}
    assert got == {f"d{i:03}": "d000" for i in range(80)} | {"z": "z", None: None}


def test_vectors_and_fusion(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "i int, v array<double>")
    assert [(r.i, r.score) for r in search.cosine_topk(df, [2.0, 0.0], 3, "i", "v").collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    lists = [spark.createDataFrame([(1, 1), (2, 2)], "i int, rank int"), spark.createDataFrame([(2, 1)], "i int, rank int")]
    assert {r.i: r.rrf for r in search.fuse(lists, "i", [1.0, 0.0]).collect()} == pytest.approx({1: 1 / 61, 2: 1 / 62})


@pytest.fixture
def corpus(spark):
    rows = [
        ("bulletin", "tuketici_kredileri_konut", "tuketici kredileri - konut", "kredi tuketici konut", "milyon TL", "stock", "monthly", None, 0, ["TL", "FX"], "tuketici"),
        ("bulletin", "takipteki_konut", "takipteki konut kredileri", "kredi takipteki", "milyon TL", "stock", "monthly", None, 0, ["TL"], "tuketici"),
        ("bulletin", "takipteki_orani", "takipteki alacaklar orani", "rasyo", "%", "ratio", "monthly", None, 0, None, "rasyo"),
        ("bulletin", "sektor_konut", "konut kredileri", "sektorel dagilim", "bin TL", "stock", "monthly", None, 0, None, "sektorel"),
        ("finturk", "konut_kredisi", "konut kredisi", "il bazinda", "bin TL", "stock", "quarterly", None, 0, None, "il"),
        ("macro", "tp.ktf12", "konut kredisi faiz orani (akim)", "faiz ktf", "%", "flow", "weekly", 0, 0, None, "faiz"),
        ("macro", "tp.bkr12", "konut kredisi faiz orani (stok)", "faiz", "%", "stock", "weekly", 0, 0, None, "faiz"),
        ("macro", "tp.akonutsat1.ktoplam", "konut satislari", "satis", "adet", "flow", "monthly", 0, 0, None, "satis"),
        ("macro", "tp.akonutsat1.ktr10", "konut satislari istanbul", "satis", "adet", "flow", "monthly", 0, 0, None, "satis"),
        ("macro", "derived.ipotekli_pay", "ipotekli konut satislarinin toplam konut satislarina orani", "satis", "%", "ratio", "monthly", 0, 0, None, "satis"),
        ("weekly", "mevduat", "mevduat", "haftalik", "milyon TL", "stock", "weekly", None, 0, ["TL", "FX"], "mevduat"),
    ]
    return spark.createDataFrame(rows, "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int, currencies array<string>, dataset string")


DOMAIN = discovery.Domain(
    aliases={"housing loan": ("konut",), "npl": ("takipteki",), "faiz": ("ktf", "faiz"), "deposit": ("mevduat",)},
    sources={"haftalik bulten": ("weekly",), "merkez bankasi": ("macro",)},
    regions={"istanbul": "İSTANBUL", "ankara": "ANKARA"},
    qualifiers={"takipteki": ("takipteki", "npl"), "ipotekli": ("ipotekli", "mortgaged")},
    sectors=("sektorel",),
    coded=r"(?i)\.K?TR[0-9A-C]",
    derived=r"(?i)^DERIVED\.",
)
WANTED = {
    "tüketici kredileri konut": ("bulletin", "tuketici_kredileri_konut"),
    "NPL oranı": ("bulletin", "takipteki_orani"),
    "konut kredisi faiz oranı stok": ("macro", "tp.bkr12"),
    "konut kredisi faiz oranı akım": ("macro", "tp.ktf12"),
    "konut satışları": ("macro", "tp.akonutsat1.ktoplam"),
    "ipotekli konut satışları oranı": ("macro", "derived.ipotekli_pay"),
    "Ankara konut kredisi": ("finturk", "konut_kredisi"),
    "deposit": ("weekly", "mevduat"),
    "TL mevduat haftalık bülten": ("weekly", "mevduat"),
    "takipteki konut kredileri": ("bulletin", "takipteki_konut"),
    "sektörel konut kredileri": ("bulletin", "sektor_konut"),
}


def test_recall_stays_above_its_floors(corpus):
    got = discovery.recall(corpus, WANTED, domain=DOMAIN)
    assert got[1] >= 0.85 and got[3] >= 0.9 and got[8] >= 0.95, got


def test_what_a_question_names_narrows_its_rows(corpus):
    found = lambda t, n=8, **k: [(r.source, r.key) for r in discovery.discover(corpus, t, n, domain=DOMAIN, **k).collect()]
    assert {s for s, _ in found("merkez bankası konut")} == {"macro"}
    assert ("bulletin", "takipteki_konut") not in found("döviz konut kredileri") and ("bulletin", "tuketici_kredileri_konut") in found("döviz konut kredileri")
    assert ("macro", "tp.ktf12") not in found("konut kredisi faiz oranı stok")
    seats = found("konut faiz oranı ve kredi tutarı", 3)
    assert any(k.startswith("tp.") for _, k in seats) and any(s in ("bulletin", "finturk") for s, _ in seats)
    named = discovery.discover(corpus, "İstanbul'da konut kredisi", 1, domain=DOMAIN).first()
    assert (named.source, named.region) == ("finturk", "İSTANBUL")
    assert discovery.peel("ankara ve istanbul konut", DOMAIN.regions) == (None, "ankara ve istanbul konut")


def test_dense_lists_add_rows_that_no_word_reaches(corpus):
    dense = corpus.sparkSession.createDataFrame([("weekly", "mevduat", 1), ("bulletin", "tuketici_kredileri_konut", 2)], "source string, key string, rank int")
    got = discovery.discover(corpus, "konut", 3, domain=DOMAIN, dense=dense).collect()
    assert got[0].key == "tuketici_kredileri_konut" and "mevduat" in {r.key for r in discovery.discover(corpus, "konut", 11, domain=DOMAIN, dense=dense).collect()}
