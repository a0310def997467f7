import contextlib
import datetime as dt
import itertools
import json
import math
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, pages
from tidemark.sources import published
from tidemark.sources.commits import CommitLog, Fenced, Landing, Late, fence
from tidemark.sources.zone import EvidenceLog, Zone, verify
from tidemark.streaming import landing


def write_table(folder, name, rows, fields=("Tp", "Yp", "Toplam"), caption="Tablo (milyon TL), 2021", note="<b>not</b> bir"):
    names = ["BankaAdi", "BasitSira", "Ad", "BasitFont", *fields]
    body = {"success": True, "Json": {"colNames": names, "colModels": [{"name": n} for n in names], "caption": caption, "uyari": note, "data": {"rows": [{"id": str(i), "cell": ["x", i, *r]} for i, r in enumerate(rows, 1)]}}}
    (folder / name).write_text(json.dumps(body), encoding="utf-8")


def test_table_in_long_form_with_leading_parents(spark, tmp_path):
    write_table(tmp_path, "2021_03.json", [["Krediler (2+3)*", "bold", "10", "5", "15"], ["a) Konut", "italic", "4", "", "4"], ["b) Taşıt (Adet)", "italic", "1.234,5", "2", None]])
    out = {(r.entity_key, r.currency): r for r in published.read_tables(spark, str(tmp_path), "d").collect()}
    top = out[("krediler", "TL")]
    assert (top.period, top.metric, top.value, top.unit, top.formula, top.footnote, top.row_position) == (dt.date(2021, 3, 1), "balance", 10.0, "milyon TL", "(2+3)", "*", 1)
    assert out[("krediler/a_konut", "total")].value == 4.0 and ("krediler/a_konut", "FX") not in out
    assert out[("krediler/b_tasit", "TL")].value == 1234.5 and out[("krediler/b_tasit", "TL")].unit == "adet"
    (note,) = published.read_notes(spark, str(tmp_path), "d").collect()
    assert note.footnote == "not bir" and note.n_periods == 1


def test_trailing_parents_and_measures_without_currency(spark, tmp_path):
    write_table(tmp_path, "2021_03.json", [["A", "", "1", "2"], ["B", "", "3", "4"], ["Bölüm", "bold", "4", "6"]], fields=("OnBin", "Toplam"))
    out = {(r.entity_key, r.metric): r for r in published.read_tables(spark, str(tmp_path), "d", hierarchy="trailing").collect()}
    assert out[("bolum/a", "on_bin")].currency is None and out[("bolum", "toplam")].value == 6.0


def test_bad_files_are_reported(spark, tmp_path):
    write_table(tmp_path, "2021_03.json", [["A", "", "1", "2", "3"]], caption="(bin TL)")
    (tmp_path / "2021_04.json").write_text(json.dumps({"success": False}))
    assert {(r.file, r.why) for r in published.check_tables(spark, str(tmp_path), "milyon TL").collect()} == {("2021_03.json", "unit"), ("2021_04.json", "no success")}


def test_envelopes_and_overlaps(spark, tmp_path):
    def put(name, items):
        (tmp_path / name).write_text(json.dumps({"datagroup": "g", "series": ["A.B", "A.C"], "startDate": "", "endDate": "", "fetched_at": "", "response": {"totalCount": 1, "items": items}}))

    put("a.json", [{"Tarih": "01-02-2021", "A_B": "1.5", "UNIXTIME": {"$n": "1"}}, {"Tarih": "2021-Q2", "A_B": None, "A_C": "7"}])
    put("b.json", [{"Tarih": "01-02-2021", "A_B": "1.5"}, {"Tarih": "2021-Q2", "A_C": "8"}, {"Tarih": "2021-5", "A_C": "9"}])
    one, bad = published.reconcile_overlaps(published.read_envelopes(spark, str(tmp_path)))
    assert sorted((r.series_code, str(r.date), r.grain) for r in one.collect()) == [("A.B", "2021-02-01", "day"), ("A.C", "2021-05-01", "month"), ("A.C", "2021-06-01", "quarter")]
    assert [(r.series_code, str(r.date)) for r in bad.collect()] == [("A.C", "2021-06-01")]


def test_catalogue_parents_and_weekly_rows(spark, tmp_path):
    items = [{"item_id": 5, "display": "", "label": "Toplam (2+3)"}, {"item_id": 6, "display": "", "label": "Bir"}, {"item_id": 9, "display": "", "label": "Eski (01.02.2020 tarihinden itibaren)"}, {"item_id": 7, "display": "", "label": "İki"}]
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"table_id": 1, "items": items}]}))
    got, twice = published.attach_parents(published.read_items(spark, str(tmp_path / "c.json")))
    by = {r.item_id: r for r in got.collect()}
    assert (by[6].parent_key, by[7].parent_key, by[5].parent_key) == ("toplam", "toplam", None)
    assert by[9].retired_on == dt.date(2020, 2, 1) and by[9].row_position is None and twice.isEmpty()
    (tmp_path / "w.json").write_text(json.dumps({"request": {"items": [5, 6]}, "table_html": "<table><tr><th>T</th></tr><tr><td>3.02.2021</td><td>1.000,5</td><td>-</td><td>2</td><td>7</td><td>8</td><td>9</td></tr></table>"}))
    rows = {(r.item_id, r.currency): r.value for r in published.read_weekly(spark, str(tmp_path / "w.json")).collect()}
    assert rows == {(5, "TL"): 1000.5, (5, "total"): 2.0, (6, "TL"): 7.0, (6, "FX"): 8.0, (6, "total"): 9.0}


def test_delimited_file_with_day_first_dates(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Tarih;Deger\n03.02.2021;"1.017"\n05.02.2021;"93.824.682"\n01.03.2021;"5,5"\n')
    out = published.read_delimited(spark, str(tmp_path / "x.csv"), "deger", delimiter=";").orderBy("period").collect()
    assert [(str(r.period), r.value) for r in out] == [("2021-02-01", 93824682.0), ("2021-03-01", 5.5)]


@pytest.mark.parametrize(
    ("label", "want"),
    [("Menkul Değerler (2 den 26'ya)", ("Menkul Değerler", "(2 den 26'ya)", "", None)), ("Kâr (Net)", ("Kâr (Net)", "", "", None)), ("Sayı (6+7+8) (Adet)**", ("Sayı", "(6+7+8)", "**", "adet")), ("Oran ((6/7)*100) (%)", ("Oran", "((6/7)*100)", "", "%")), ("X (2023)", ("X (2023)", "", "", None))],
)
def test_decorations(spark, label, want):
    r = spark.createDataFrame([(label,)], "t string").select(labels.strip_decorations(F.col("t")).alias("d")).first().d
    assert tuple(r) == want


def test_formula_terms_dates_and_keys(spark):
    f = lambda text: spark.createDataFrame([(text,)], "t string").select(labels.formula_terms(F.col("t")).alias("x")).first().x
    assert [(t.sign, t.position) for t in f("(3+..+5)-(7+8)")] == [(1, 3), (1, 4), (1, 5), (-1, 7), (-1, 8)]
    assert [(t.sign, t.position) for t in f("(2 den 4'e)")] == [(1, 2), (1, 3), (1, 4)]
    assert f("((6/7)*100)") is None
    dates = ["2021-02-01", "03.02.2021", "Mayıs 2026", "Ocak / January 2020", "01-08", "1 Şubat 2021", "0001-01-01", None]
    got = [r.d for r in spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, t string").select("i", labels.parse_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [str(d) for d in got] == ["2021-02-01", "2021-02-03", "2026-05-01", "2020-01-01", "None", "2021-02-01", "None", "None"]
    assert spark.createDataFrame([("İŞ Kârı (Çok)",)], "t string").select(labels.slug(F.col("t"))).first()[0] == "is_kari_cok"
    assert spark.createDataFrame([("milyon TL ve yüzde",)], "t string").select(labels.scan_units(F.col("t"))).first()[0] == ["milyon TL", "%"]


def test_zone_lands_and_is_seen_only_with_its_manifest(spark, tmp_path):
    zone = Zone(spark, f"file://{tmp_path}/zone")
    obs = spark.createDataFrame([("k", "2021-01-01", "5.5", "x"), ("k", "oops", "6", "y")], "series_key string, period string, value string, extra string")
    assert zone.read("observations").isEmpty()
    zone.write("s1", "http://a", "h1", {"observations": obs})
    assert sorted((r.source_id, str(r.period), r.value) for r in zone.read("observations").collect()) == [("s1", "2021-01-01", 5.5), ("s1", "None", 6.0)]
    assert zone.is_current("s1", "h1") and not zone.is_current("s1", "h2")
    query = landing.maintain(spark, f"file://{tmp_path}/zone", f"file://{tmp_path}/table", f"file://{tmp_path}/check")
    query.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == 2
    assert zone.remove("s1") and not zone.remove("s1")
    assert zone.read("observations").isEmpty() and zone.sources().isEmpty() and not zone.is_current("s1", "h1")
    landing.maintain(spark, f"file://{tmp_path}/zone", f"file://{tmp_path}/table", f"file://{tmp_path}/check").awaitTermination(60)
    assert not (tmp_path / "table" / "source_id=s1").exists()
    zone.write("s1", "http://a", "h3", {"observations": obs})
    assert zone.read("observations").count() == 2 and zone.is_current("s1", "h3")
    landing.maintain(spark, f"file://{tmp_path}/zone", f"file://{tmp_path}/table", f"file://{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == 2


def test_verify_finds_scale_mismatch(spark):
    d = [dt.date(2021, m, 1) for m in range(1, 6)]
    corpus = spark.createDataFrame([("c", p, 100.0 + i) for i, p in enumerate(d)], "series_key string, period date, value double")
    landed = corpus.select(F.lit("same").alias("series_key"), "period", "value").union(corpus.select(F.lit("thousand"), "period", F.col("value") * 1000)).union(corpus.select(F.lit("other"), "period", F.col("value") * 7))
    assert {r.landed_key: (r.corpus_key, r.verdict) for r in verify(landed, corpus).collect()} == {"same": ("c", "match"), "thousand": ("c", "scale_mismatch"), "other": (None, "none")}
    assert verify(landed.limit(0), corpus).count() == 0 and {r.verdict for r in verify(landed, corpus.limit(0)).collect()} == {"none"}


def plain_verdicts(landed, corpus, tolerance=0.005, least=0.9):
    """Every landed series against every series of the corpus, period by period."""
    out = set()
    for a, xs in landed.items():
        for b, ys in corpus.items():
            ratios = sorted(xs[p] / ys[p] for p in xs.keys() & ys.keys() if xs[p] and ys[p])
            if ratios:
                middle = (ratios[(len(ratios) - 1) // 2] + ratios[len(ratios) // 2]) / 2
                power = round(math.log10(abs(middle))) if middle else 0
                part = lambda scale, ratios=ratios: sum(abs(r / scale - 1) <= tolerance for r in ratios) / len(ratios)
                if part(1.0) >= least:
                    out.add((a, b, "match", len(ratios)))
                elif power and part(10.0**power) >= least:
                    out.add((a, b, "scale_mismatch", len(ratios)))
    return out


def test_verify_equals_comparing_all_pairs(spark):
    rng = random.Random(11)
    month = lambda i: dt.date(2015 + i // 12, i % 12 + 1, 1)
    grids = [[month(i) for i in range(a, a + 40, step)] for a in (0, 7, 30) for step in (1, 3, 12)] + [[dt.date(2018, 1, 5) + dt.timedelta(7 * i) for i in range(60)]]
    corpus, landed = {}, {}
    for i in range(40):
        level, grid = rng.choice((1.0, 9.99, 250.0, 1e6)), rng.choice(grids)
        corpus[f"c{i}"] = {p: level * (1 + 0.3 * rng.random()) * (-1 if i == 7 else 1) for p in grid}
    corpus |= {"flat": dict.fromkeys(grids[0], 100.0), "zeros": dict.fromkeys(grids[0], 0.0), "edge": {p: 9.995 + 0.01 * (i % 2) for i, p in enumerate(grids[0])}}
    for i in range(60):
        of = corpus[rng.choice(list(corpus))]
        scale, noise = rng.choice((1.0, 1.0, 1000.0, 0.01, 3.0, -1.0)), rng.choice((0.0, 0.004, 0.0049, 0.02))
        kept = [p for p in of if rng.random() > rng.choice((0.0, 0.05))]
        landed[f"l{i}"] = {p: of[p] * scale * (1 + noise * rng.uniform(-1, 1)) if rng.random() > 0.04 else rng.random() for p in kept}
    frame = lambda series: spark.createDataFrame([(k, p, v) for k, x in series.items() for p, v in x.items()], "series_key string, period date, value double")
    found = verify(frame(landed), frame(corpus)).collect()
    assert {(r.landed_key, r.corpus_key, r.verdict, r.n_common) for r in found if r.corpus_key} == {x for x in plain_verdicts(landed, corpus) if x[3] >= 2}
    assert {r.landed_key for r in found} == {k for k in landed if landed[k]}


def test_candidates_of_a_check_are_few(spark):
    from tidemark.sources.zone import fingerprints

    months = F.explode(F.expr("sequence(DATE'2010-01-01', DATE'2014-12-01', INTERVAL 1 MONTH)")).alias("period")
    series = lambda n, seed: spark.range(n).select(F.concat(F.lit(f"{seed}-"), "id").alias("series_key"), months).withColumn("value", 100 * F.exp(F.randn(seed)))
    ours, theirs = series(300, 1), series(300, 2)
    pairs = fingerprints(ours, 0.005, True).withColumnRenamed("series_key", "a").join(fingerprints(theirs, 0.005, False), "print").select("a", "series_key").distinct().count()
    assert pairs < 0.1 * 300 * 300


def test_a_source_landed_again_is_seen_as_it_was_until_it_is_whole(spark, tmp_path, monkeypatch):
    zone = Zone(spark, f"file://{tmp_path}/zone")
    obs = lambda v: {"observations": spark.createDataFrame([("k", v)], "series_key string, value double")}
    seen = lambda: [r.value for r in zone.read("observations").collect()]
    zone.write("s", "u", "h1", obs(1.0))
    stage = Zone._stage

    def failing(self, name, *rest):
        if name == "quality":
            assert seen() == [1.0]
            raise OSError("lost")
        stage(self, name, *rest)

    monkeypatch.setattr(Zone, "_stage", failing)
    with pytest.raises(OSError, match="lost"):
        zone.write("s", "u", "h2", obs(2.0))
    assert seen() == [1.0] and zone.is_current("s", "h1") and not zone.is_current("s", "h2")
    monkeypatch.undo()
    for v in (3.0, 4.0, 5.0):
        begun = zone.read("observations")
        zone.write("s", "u", f"h{v}", obs(v))
        assert seen() == [v] and zone.sources().count() == 1
        assert len(begun.collect()) == 1  # who has begun reads the version before
    assert len(zone.versions("observations", "s")) == 5  # one landing failed halfway
    assert zone.sweep() == [] and len(zone.versions("observations", "s")) == 5
    assert len(Zone(spark, zone.root, retain=0).sweep()) == 3 and len(zone.versions("observations", "s")) == 2
    assert len(Zone(spark, zone.root, lease=0).sweep()) == 1 and len(zone.versions("observations", "s")) == 1 and seen() == [5.0]
    assert zone.remove("s") and seen() == []


def test_writers_of_one_source_at_once_leave_one_of_them(spark, tmp_path):
    zone = Zone(spark, f"file://{tmp_path}/zone", retain=0)
    frames = {v: {"observations": spark.createDataFrame([(f"k{i}", float(v)) for i in range(5)], "series_key string, value double")} for v in range(4)}
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(zone.write, "s", "u", f"h{v}", frames[v], f"2024-01-01T00:00:0{v}") for v in frames]
    late = [v for v, d in enumerate(done) if isinstance(d.exception(), Late)]
    assert all(d.exception() is None or isinstance(d.exception(), Late) for d in done) and 3 not in late
    assert [r.value for r in zone.read("observations").collect()] == [3.0] * 5
    assert len(zone.versions("observations", "s")) == 1  # what was late or replaced is gone
    with pytest.raises(Late):
        zone.write("s", "u", "old", frames[0], "2023-01-01T00:00:00")
    assert zone.is_current("s", "h3")


class Writer:
    """A writer that does one thing at a time: it puts its file in two halves, reads the log, writes the log, deletes."""

    def __init__(self, log, folder, token, fetched):
        self.log, self.folder, self.landing, self.fetched, self.outcome = log, folder, Landing(log, "s", token), fetched, None
        self.steps = self._steps()

    def _steps(self):
        home = self.folder / self.landing.token
        home.mkdir()
        (home / "a").write_text(self.landing.token)
        yield
        (home / "b").write_text(self.landing.token)
        yield
        try:
            for entry in self.landing.attempts({"version": self.landing.token, "fetched_at": self.fetched}, retain=0, newer=lambda theirs, ours: theirs["fetched_at"] > ours["fetched_at"]):
                yield
        except (Late, Fenced) as e:
            self.outcome = type(e)
            shutil.rmtree(home, ignore_errors=True)
            return
        self.outcome = "landed"
        for token in entry["expired"]:
            shutil.rmtree(self.folder / token, ignore_errors=True)
        yield

    def step(self):
        return next(self.steps, "end") == "end"


def whole(log, folder):
    """The version that a reader gets, its files being there and of one writer."""
    current = log.latest("s")["current"]
    if current:
        assert {f.read_text() for f in (folder / current["version"]).iterdir()} == {current["version"]} and len(list((folder / current["version"]).iterdir())) == 2
    return current and current["version"]


def test_two_writers_and_a_reader_interleaved_at_every_step(spark, tmp_path):
    for n, order in enumerate(itertools.product((0, 1), repeat=6)):
        folder = tmp_path / f"run{n}"
        folder.mkdir()
        log = CommitLog(spark, f"file://{folder}/log")
        writers = [Writer(log, folder, "1-old", "t1"), Writer(log, folder, "2-new", "t2")]
        for who in (*order, *(0,) * 9, *(1,) * 9):
            writers[who].step()
            whole(log, folder)
        assert writers[1].outcome == "landed" and writers[0].outcome in ("landed", Late)
        assert whole(log, folder) == "2-new" and not (folder / "1-old").exists()
        assert [log.files.read(log._path("s", i)) is not None for i in log.numbers("s")] and log.numbers("s") == list(range(1, len(log.numbers("s")) + 1))


def test_a_fenced_writer_commits_before_or_never(spark, tmp_path):
    for at in range(7):
        folder = tmp_path / f"run{at}"
        folder.mkdir()
        log = CommitLog(spark, f"file://{folder}/log")
        writer = Writer(log, folder, "1-slow", "t1")
        for _ in range(at):
            writer.step()
        gone = fence(log, "s", ["1-slow"])
        for token in gone:
            shutil.rmtree(folder / token, ignore_errors=True)
        with contextlib.suppress(FileNotFoundError):
            while not writer.step():
                whole(log, folder)
        assert (whole(log, folder) == "1-slow") == (gone == []) == (writer.outcome == "landed")


def test_an_entry_under_an_old_number_is_found_out(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", kept=4)
    for i in range(1, 9):
        assert log.append("s", {"number": i, "source_id": "s", "current": {"version": str(i)}, "retired": [], "fenced": []})
    assert log.numbers("s") == [5, 6, 7, 8] and not log.append("s", {"number": 8}) and not log.append("s", {"number": 3})
    assert log.numbers("s") == [5, 6, 7, 8] and log.latest("s")["current"] == {"version": "8"}


def test_evidence_log(spark, tmp_path):
    log = EvidenceLog(spark, f"file://{tmp_path}/log")
    run = log.start("q")
    log.record(run, [("fetch", {"n": 1}), ("chart", {"ş": [1]})])
    assert [r["payload"] for r in log.results(run)] == [{"n": 1}, {"ş": [1]}] and log.runs().first().n == 2


def test_the_evidence_log_stays_small_and_readable(spark, tmp_path):
    log = EvidenceLog(spark, f"file://{tmp_path}/log", most=5, retain=0)
    run = log.start("q")
    small = lambda: [f for f in (tmp_path / "log" / "records").iterdir() if f.name.endswith(".parquet") and not f.name.startswith(".")]
    for i in range(40):
        log.record(run, [("step", {"i": i})])
        if i % 7 == 0:
            assert [r["payload"]["i"] for r in log.results(run)] == list(range(i + 1))
    assert len(small()) <= 2 * 6 and [r["payload"]["i"] for r in log.results(run)] == list(range(40)) and log.get(run)["n"] == 40
    assert len(list((tmp_path / "log" / "merged" / "records").iterdir())) <= 2
    lazy = EvidenceLog(spark, log.root, most=5)
    begun = lazy._read("records", EvidenceLog.RECORDS)
    assert lazy.compact("records") and not lazy.compact("records")
    assert begun.count() == 40 == lazy._read("records", EvidenceLog.RECORDS).count()  # who has begun reads on


def test_the_evidence_log_is_read_while_it_is_written_and_merged(spark, tmp_path):
    log = EvidenceLog(spark, f"file://{tmp_path}/log", most=3)
    run, seen, failed = log.start("q"), [], []

    def read():
        while len(seen) < 200 and not (seen and seen[-1] == 24):
            try:
                seen.append(len(log.results(run)))
            except Exception as e:  # noqa: BLE001
                failed.append(e)
                return

    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(read)
        for i in range(24):
            log.record(run, [("step", {"i": i})])
        done.result(120)
    assert not failed and seen == sorted(seen) and seen[-1] == 24


def test_grids_and_links(spark):
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    assert pages.html_grids(html) == [[["a", "b", "b"], ["a", "c", "d"]]]
    assert pages.markdown_grids("| x | y |\n|---|---|\n| 1 | 2 |\n") == [[["x", "y"], ["1", "2"]]]
    assert pages.continued([[["x"], ["1"]], [["x"], ["2"]], [["y"]]]) == [[["x"], ["1"], ["2"]], [["y"]]]
    df = spark.createDataFrame([(1, "http://h.org/p", "<a href='/a.pdf'>x</a><a href='b'>y</a><a href='/a.pdf'>")], "i int, u string, h string")
    assert [(r.link, r.type_hint) for r in pages.assets(df, "i", "u", "h", 5).collect()] == [("http://h.org/a.pdf", "pdf"), ("b", "html")]
    assert pages.readable("<nav>m</nav><p>a &amp; b</p><script>x</script>c") == "a & b\nc"


def test_runs_end_and_the_schema_card_tells_values_and_notes(spark, tmp_path):
    from tidemark.sources.zone import schema_card

    log = EvidenceLog(spark, str(tmp_path / "log"))
    assert log.get("none") is None
    run = log.start("q?")
    assert log.get(run)["answer"] is None and log.get(run)["n"] == 0
    log.record(run, [("search", {"a": 1})])
    log.finish(run, "first", "failed")
    log.finish(run, "second")
    got = log.get(run)
    assert (got["answer"], got["verdict"], got["n"], got["results"]) == ("second", "passed", 1, [{"tool": "search", "payload": {"a": 1}}])
    facts = spark.createDataFrame([(dt.date(2021, 1, 1), "TL", f"k{i}") for i in range(30)] + [(None, None, None)], "period date, currency string, key string")
    notes = spark.createDataFrame([("d", "old", dt.date(2020, 1, 1), dt.date(2020, 2, 1)), ("d", "new", dt.date(2020, 3, 1), dt.date(2020, 4, 1))], "dataset string, footnote string, first_period date, last_period date")
    card = schema_card(spark, {"facts": facts}, notes)
    assert "31 rows, 2021-01-01 to 2021-01-01" in card and "currency: TL" in card and "key:" not in card and "2020-04-01: new" in card and "old" not in card
