"""Discovery of many questions at once against one at a time, the dense half, and recall over phrasings."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_discovery import DOMAIN, WANTED, corpus  # noqa: F401
from tidemark.plans import batch, discovery

INDEX = "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int, currencies array<string>, dataset string, code string"


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(6)
    words = ["konut", "kredi", "kredileri", "faiz", "orani", "mevduat", "takipteki", "satis", "tutar", "ihtiyac", "tasit", "npl", "a", "tl"]
    pick = lambda a, b: rng.choices(words, k=rng.randint(a, b))
    rows = [
        (rng.choice(("macro", "finturk", "weekly", "bulletin")), "_".join(pick(1, 4)) + rng.choice(("", f"_{i}", "/alt")), " ".join(pick(1, 4)), None if i % 17 == 0 else " ".join(pick(0, 3)), rng.choice(("%", "milyon TL", "adet", None)), rng.choice(("stock", "flow", "rate", None)), rng.choice(("monthly", "weekly", "quarterly")), rng.choice((0, 1, None)), rng.choice((0, 1, 2, None)), rng.choice((["TL"], ["FX"], ["TL", "FX"], [], None)), rng.choice(("sektorel", "x")), rng.choice(("TP.K1.MA", "TP.KTR10", "DERIVED.X", None)))
        for i in range(400)
    ]
    return spark.createDataFrame(list({(r[0], r[1]): r for r in rows}.values()), INDEX)


TEXTS = [
    "konut kredileri", "aylık konut kredisi faiz oranı", "TL mevduat haftalık bülten", "döviz kredi tutarı", "faiz oranı ve kredi tutarı", "İstanbul'da konut kredisi", "merkez bankası faiz oranı stok", "npl", "", None, "ve ile", "zzz yok", "a", "ihtiyaç kredileri konut tutar bakiyesi oranı", "housing loan deposit rate", "sektörel konut kredi satış", "konut kredi faiz",
]


@pytest.mark.parametrize("how", [{}, {"limit": 3, "per_source": 2}])
def test_many_questions_give_the_rows_of_each(spark, index, how):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "question_id int, text string")
    got = {}
    for r in batch.discover_all(index, asked, domain=DOMAIN, **how).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.source, r.key, r.score, r.region))
        assert r["rank"] == len(got[r.question_id])
    for i, text in enumerate(TEXTS):
        one = [(r.source, r.key, r.score, r.region) for r in discovery.discover(index, text or "", domain=DOMAIN, **how).collect()] if discovery.question(text or "", DOMAIN).terms else []
        assert got.get(i, []) == one, text


def test_no_questions_and_no_index(spark, index):
    none = spark.createDataFrame([], "question_id int, text string")
    some = spark.createDataFrame([(1, "konut")], "question_id int, text string")
    assert batch.discover_all(index, none).count() == batch.discover_all(index.limit(0), some).count() == 0
    assert batch.dense_ranks(index, none).count() == batch.dense_ranks(index.limit(0), some).count() == 0


def test_the_dense_half_keeps_to_what_a_question_names(spark, index):
    asked = spark.createDataFrame([(1, "merkez bankası konut"), (2, "konut faiz stok"), (3, "konut kredisi İstanbul"), (4, "TL mevduat")], "question_id int, text string")
    everything = index.select("source", "key").crossJoin(asked.select("question_id")).withColumn("rank", F.lit(1))
    found = batch.discover_all(index, asked, 1000, DOMAIN, dense=everything).collect()
    of = lambda i: [r for r in found if r.question_id == i]
    assert {r.source for r in of(1)} == {"macro"} and len(of(1)) == index.where("source = 'macro'").count()
    assert not any(r.unit == "%" and r.semantics == "flow" for r in of(2))
    assert {r.region for r in of(3)} == {"İSTANBUL", None}
    assert not any(r.currencies == ["FX"] for r in of(4))
    ranks = batch.dense_ranks(index, asked, 7, DOMAIN).collect()
    assert {r.source for r in ranks if r.question_id == 1} == {"macro"} and max(r["rank"] for r in ranks) == 7
    assert len(batch.discover_all(index, asked.where("question_id = 3"), 1000, DOMAIN, dense=everything).collect()) == index.count()  # nothing is cut


def test_full_names_come_first_and_have_seats(spark, corpus):  # noqa: F811
    text = "ipotekli konut satislarinin toplam konut satislarina orani ve mevduat"
    first = discovery.discover(corpus, text, 3, DOMAIN).first()
    assert first.key == "derived.ipotekli_pay" and first.name_match > 0
    seats = discovery.discover_concepts(corpus, "mevduat, konut satışları ve ipotekli konut satislarinin toplam konut satislarina orani", 4, DOMAIN)
    assert seats[0]["key"] == "derived.ipotekli_pay" and {"mevduat", "tp.akonutsat1.ktoplam"} <= {s["key"] for s in seats} and len(seats) == 4
    assert max(sum(s["source"] == x for s in seats) for x in ("macro", "weekly", "bulletin")) <= 3
    assert discovery.discover_concepts(corpus, "", 4, DOMAIN) == []


# Seventeen things, five ways of asking for each.
THINGS = {
    "konut_kredileri": ("konut kredileri", "tuketici kredi", "milyon TL", "stock"), "tasit_kredileri": ("tasit kredileri", "tuketici kredi", "milyon TL", "stock"), "ihtiyac_kredileri": ("ihtiyac kredileri", "tuketici kredi", "milyon TL", "stock"), "kredi_kartlari": ("bireysel kredi kartlari", "kart taksitli", "milyon TL", "stock"),
    "ticari_krediler": ("ticari ve kurumsal krediler", "firma", "milyon TL", "stock"), "kobi_kredileri": ("kobi kredileri", "kucuk isletme", "milyon TL", "stock"), "mevduat_vadeli": ("vadeli mevduat", "tasarruf", "milyon TL", "stock"), "mevduat_vadesiz": ("vadesiz mevduat", "tasarruf", "milyon TL", "stock"), "takipteki_alacaklar": ("takipteki alacaklar", "sorunlu brut", "milyon TL", "stock"),
    "takipteki_orani": ("takipteki alacaklarin krediler icindeki orani", "rasyo", "%", "ratio"), "sermaye_yeterliligi": ("sermaye yeterliligi orani", "rasyo", "%", "ratio"), "konut_faizi": ("konut kredisi faiz orani", "faiz", "%", "rate"), "mevduat_faizi": ("mevduat faiz orani", "faiz", "%", "rate"), "tufe": ("tuketici fiyat endeksi", "enflasyon", "endeks", "index"),
    "konut_fiyat": ("konut fiyat endeksi", "emlak", "endeks", "index"), "konut_satis": ("konut satislari", "emlak adet", "adet", "flow"), "dolar_kuru": ("dolar kuru alis", "doviz kur", "TL", "rate"),
}
PHRASES = (lambda n: n, lambda n: f"{n} ne kadar oldu", lambda n: f"aylık {n} göster", lambda n: f"son {n} nedir", lambda n: " ".join(reversed(n.split())))


@pytest.fixture(scope="module")
def things(spark):
    rows = [("m", k, name, context, unit, kind, "monthly", None, 0) for k, (name, context, unit, kind) in THINGS.items()]
    return spark.createDataFrame(rows, "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int")


def test_recall_over_85_phrasings(spark, things):
    wanted = {phrase(name): ("m", key) for key, (name, *_) in THINGS.items() for phrase in PHRASES}
    assert len(wanted) == 85
    got = discovery.recall(things, wanted)
    assert got[1] >= 0.85 and got[3] >= 0.9 and got[8] >= 0.95, got
    asked = spark.createDataFrame(list(enumerate(wanted)), "question_id int, text string")
    both = discovery.recall(things, wanted, dense=batch.dense_ranks(things, asked))
    assert both[1] >= 0.85 and both[3] >= 0.9 and both[8] >= 0.95, both


def test_vectors_find_what_is_misspelled(spark, things):
    rng = random.Random(2)

    def misspelled(name):
        words = []
        for w in name.split():
            i = rng.randrange(1, len(w) - 1) if len(w) > 3 else None
            words.append(w if i is None else w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        return " ".join(words)

    wanted = {misspelled(name): ("m", key) for key, (name, *_) in THINGS.items()}
    asked = spark.createDataFrame(list(enumerate(wanted)), "question_id int, text string")
    words, both = discovery.recall(things, wanted, (3,)), discovery.recall(things, wanted, (3,), dense=batch.dense_ranks(things, asked))
    assert both[3] >= 0.7 and both[3] > words[3], (words, both)


def test_wanted_rows_are_found_together(corpus):  # noqa: F811
    assert discovery.recall(corpus, WANTED, domain=DOMAIN)[1] >= 0.85


def test_rows_of_a_kind_behind_the_limit_take_no_part(spark):
    same = [("m", f"konut_{i:03}", "konut kredi", "", "%", "stock", "monthly", 0, 0) for i in range(300)] + [("m", "konut_longer_key", "konut kredi", "", "%", "stock", "monthly", 0, 0)]
    index = spark.createDataFrame(same, "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int")
    rows = index.withColumn("__row", F.monotonically_increasing_id())
    terms = spark.createDataFrame([("konut",), ("kredi",)], "term string")
    left = batch.first_of_kind(rows, batch.touched(rows, terms), discovery.Domain(), 4).join(rows, "__row")
    assert sorted(r.key for r in left.collect()) == ["konut_000", "konut_001", "konut_002", "konut_003", "konut_longer_key"]
    asked = spark.createDataFrame([(1, "konut kredi")], "question_id int, text string")
    assert [r.key for r in batch.discover_all(index, asked, 4).orderBy("rank").collect()] == [r.key for r in discovery.discover(index, "konut kredi", 4).collect()]
