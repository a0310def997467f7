"""Incremental builds against builds of the whole archive, after random edits."""

import os
import random
from functools import reduce

import pytest

from tests.test_build import rows
from tests.test_sources import write_table
from tidemark.operators import series
from tidemark.operators.quality import ValidationError
from tidemark.plans import build
from tidemark.plans.incremental import Incremental
from tidemark.sources import published
from tidemark.sources.commits import Late


def datasets(root):
    return [build.Dataset("stock", str(root / "stock"), "milyon TL"), build.Dataset("ytd", str(root / "ytd"), "milyon TL", "cumulative_ytd")]


@pytest.fixture
def archive(tmp_path):
    for name in ("stock", "ytd"):
        (tmp_path / name).mkdir()
        for year in (2020, 2021, 2022):
            for month in (1, 2, 5, 8, 11):
                write_table(tmp_path / name, f"{year}_{month:02d}.json", rows(10 * month, year % 100))
    return tmp_path


def plain(df):
    columns = sorted(df.columns)
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*columns).collect())


def full(spark, root):
    tables, _ = build.monthly(spark, datasets(root))
    return tables | {"growth": series.growth_table(tables["observations"].select(*build.KEYS, "period", "value"), build.KEYS)}


def same(spark, now, root):
    have, want = now.tables(), full(spark, root)
    for t in ("observations", "growth", "entities", "metrics", "footnotes"):
        assert sorted(have[t].columns) == sorted(want[t].columns), t
        assert plain(have[t]) == plain(want[t]), t


def test_edits_give_what_a_build_of_everything_gives(spark, archive, tmp_path, monkeypatch):
    read = []
    real = published.table_rows
    monkeypatch.setattr(published, "table_rows", lambda spark, path: read.append(path) or real(spark, path))
    now, rng = Incremental(spark, f"file://{tmp_path}/out", datasets(archive), retain=0), random.Random(8)
    assert now.run() and now.run() is None
    same(spark, now, archive)
    for _ in range(2):
        before, touched, read[:] = now.state()["parts"], set(), []
        for _ in range(rng.randint(1, 2)):
            name, year, month = rng.choice(("stock", "ytd")), rng.choice((2020, 2021, 2022, 2023)), rng.choice((1, 5, 9))
            file = archive / name / f"{year}_{month:02d}.json"
            if file.exists() and rng.random() < 0.4:
                file.unlink()
            else:
                write_table(archive / name, file.name, rows(rng.randint(1, 999), rng.randint(1, 99)), note=rng.choice(("not bir", "iki")))
            touched.add((name, year, file))
        os.utime(archive / "stock" / "2020_02.json", (1, rng.randint(10, 10**9)))  # touched, but of the same content
        assert now.run()
        assert {p.split("/", 3)[-1] if p.startswith("file:") else p for path in read for p in path} == {str(f)[1:] for _, _, f in touched if f.exists()} or {os.path.basename(p) for path in read for p in path} == {f.name for _, _, f in touched if f.exists()}
        after = now.state()["parts"]
        replaced = {k for k in before["observations"].keys() | after["observations"].keys() if before["observations"].get(k) != after["observations"].get(k)}
        assert replaced == {f"{name}/{year}" for name, year, _ in touched}
        first = {name: min(y for n, y, _ in touched if n == name) for name, _, _ in touched}
        assert all(before["growth"].get(k) == f for k, f in after["growth"].items() if int(k.split("/")[1]) < first.get(k.split("/")[0], 9999))
        same(spark, now, archive)
    kept = {f for t in now.state()["parts"].values() for f in t.values()}
    assert all(os.path.isdir(tmp_path / "out" / f) for f in kept)


def test_a_failed_check_leaves_the_version_before(spark, archive, tmp_path):
    now = Incremental(spark, f"file://{tmp_path}/out", datasets(archive))
    first = now.run()
    before = plain(now.tables()["observations"])
    write_table(archive / "stock", "2021_05.json", [["Toplam (2+3)", "bold", "99", "0", "99"], *rows(50, 21)[1:]])
    with pytest.raises(ValidationError, match="true sums"):
        now.run()
    write_table(archive / "stock", "2021_05.json", rows(1, 1), caption="(bin TL)")
    with pytest.raises(ValidationError, match="layout"):
        now.run()
    assert now.state()["version"] == first and plain(now.tables()["observations"]) == before
    assert all(os.listdir(tmp_path / "out" / "parts" / t) == [first] for t in ("observations", "growth"))
    write_table(archive / "stock", "2021_05.json", rows(7, 1))
    assert now.run() != first
    same(spark, now, archive)


def test_of_two_runs_at_once_one_is_late(spark, archive, tmp_path, monkeypatch):
    now = Incremental(spark, f"file://{tmp_path}/out", datasets(archive)[:1])
    other = Incremental(spark, f"file://{tmp_path}/out", datasets(archive)[:1])
    carry, ran = Incremental._carry, []

    def during(self, *a):
        if self is now and not ran:
            ran.append(other.run())
        carry(self, *a)

    monkeypatch.setattr(Incremental, "_carry", during)
    with pytest.raises(Late):
        now.run()
    assert now.state()["version"] == ran[0] and now.run() is None


def test_digests_are_taken_where_times_are_not_trusted(spark, archive, tmp_path):
    now = Incremental(spark, f"file://{tmp_path}/out", datasets(archive)[:1], trust_times=False)
    now.run()
    file = archive / "stock" / "2021_05.json"
    at = os.stat(file)
    write_table(archive / "stock", file.name, rows(60, 21))
    os.utime(file, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert file.stat().st_size == at.st_size
    assert Incremental(spark, now.out, datasets(archive)[:1]).changes().read == []
    assert now.changes().read == [("stock", "2021_05.json")]
    assert reduce(max, now.changes().touched()["stock"]) == 2021
