"""Sector workbooks, made by hand and read back."""

import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from tidemark.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(col):
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_book(path, sheets, inline=False):
    """Sheets as {name: rows of cells}; texts are shared or inline, None leaves a cell out."""
    shared, parts = [], {}
    for i, rows in enumerate(sheets.values(), 1):
        body = ""
        for r, cells in enumerate(rows, 1):
            body += f'<row r="{r}">'
            for c, v in enumerate(cells, 1):
                at = f'r="{letters(c)}{r}"'
                if isinstance(v, int | float):
                    body += f"<c {at}><v>{v}</v></c>"
                elif v is not None and inline:
                    body += f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                elif v is not None:
                    shared.append(v)
                    body += f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
            body += "</row>"
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'<workbook {NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    if not inline:
        parts["xl/sharedStrings.xml"] = f"<sst {NS}>" + "".join(f'<si><r><t xml:space="preserve">{escape(s[:3])}</t></r><r><t xml:space="preserve">{escape(s[3:])}</t></r></si>' for s in shared) + "</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)


def ranked(rng, mains=31, subs=25):
    """A sheet of main sectors in an order of its own with sub-sectors below them, amounts beside shares; and what it says."""
    names = [f"Sektör {i} & Ş" for i in range(mains)]
    rng.shuffle(names)
    below = [rng.randrange(mains) for _ in range(subs)]
    rows, want = [["Rapor"], [None, "No", "Sektör adı", "Toplam Kredi", "% Pay", "Nakdi", None, "Tasfiye", "Pay (%)"]], {}
    figures = lambda: [round(rng.uniform(1, 1e6), 1) for _ in range(3)]
    sums = [0.0] * 3
    for i, name in enumerate(names):
        own = figures()
        sums = [a + b for a, b in zip(sums, own, strict=True)]
        for j, (label, number) in enumerate([(name, str(i + 1)), *((f"   Alt {k}", None) for k, of in enumerate(below) if of == i)]):
            values = own if j == 0 else figures()
            rows.append([None, number, label, *(x for v in values for x in (v, 100.0 / mains))])
            want[label.strip()] = (name if j else None, values)
    rows.append([None, "Toplam", None, *(x for v in sums for x in (v, 100.0))])
    return [*rows, [None, "(1) Bir not, uzun bir metin"], [None, "(2) Başka bir not"]], want, sums


def test_ranked_sectors_with_indented_ones_below(spark, tmp_path):
    rng = random.Random(1)
    wanted = {}
    for month in (1, 2):
        rows, want, sums = ranked(rng)
        wanted[f"T_2022_{month:02d}.xlsx"] = (want, sums)
        write_book(tmp_path / f"T_2022_{month:02d}.xlsx", {"Sayfa 1": rows}, inline=month == 2)
    (tmp_path / "~$T_2022_03.xlsx").write_bytes(b"a lock")
    tables = workbooks.sector_tables(workbooks.read_cells(spark, str(tmp_path))).cache()
    assert workbooks.sector_errors(tables, 31, 25).count() == 0
    slug = lambda s: s.lower().replace("ö", "o").replace(" & ş", "_s").replace(" ", "_")
    found = {}
    for r in tables.collect():
        found.setdefault((r.file, r.sector_code), {})[r.metric] = r.value
        want, sums = wanted[r.file]
        assert str(r.period) == f"2022-{r.file[7:9]}-01"
        if r.is_total:
            assert r.sector_code == "TOTAL" and r.value == pytest.approx(sums[["toplam_kredi", "nakdi", "tasfiye"].index(r.metric)])
        else:
            parent, values = want[r.sector_name]
            assert r.parent_code == (slug(parent) if parent else None) and r.value == values[["toplam_kredi", "nakdi", "tasfiye"].index(r.metric)]
    assert len(found) == 2 * (31 + 25 + 1) and all(set(m) == {"toplam_kredi", "nakdi", "tasfiye"} for m in found.values())


def test_coded_sectors_and_several_sheets(spark, tmp_path):
    head = ["Tür", "Sektör Kodu", "Sektör", "Kısa Vadeli", "Uzun Vadeli"]
    rows = [head, *([["Sektör", i, f"Ad {i} (1+...+{i})", 10 * i, 20 * i] for i in range(1, 70)]), ["Sektör", 70, "TOPLAM", 5.5, 6]]
    write_book(tmp_path / "B_2021_05.xlsx", {"Bir": rows, "İki & üç": rows[:12] + [rows[-1]]})
    tables = workbooks.sector_tables(workbooks.read_cells(spark, str(tmp_path)))
    got = {(r.sheet, r.sector_code, r.metric): (r.sector_name, r.value, r.parent_code) for r in tables.collect()}
    assert len(got) == 2 * 70 + 2 * 12 and got["Bir", "07", "uzun_vadeli"] == ("Ad 7 (1+...+7)", 140.0, None) and got["İki & üç", "TOTAL", "kisa_vadeli"][1] == 5.5
    assert {(r.sheet, r.why) for r in workbooks.sector_errors(tables, 69).collect()} == {("İki & üç", "sectors")}


def test_what_is_wrong_with_a_table_is_told(spark, tmp_path):
    head = [None, "No", "Sektör", "Nakdi"]
    books = {
        "a_2021_01": [head, [None, None, "  Alt", 1.0], [None, "1", "Bir", 2.0], [None, "Toplam", None, 3.0]], "b_2021_01": [head, [None, "1", "Bir", 2.0]], "c": [head, [None, "1", "Bir", 2.0], [None, "Toplam", None, 2.0]],
        "d_2021_01": [[*head, "Diğer"], [None, "1", "Bir", 2.0, 1], [None, "2", "Bir", 2.0, 1], [None, "3", "Üç", 2.0, None], [None, "Toplam", None, 2.0, 2]],
        "f_2021_01": [head, [None, "1", "Bir", 2.0], [None, "1", "Bir", 2.0], [None, "Toplam", None, 4.0]],
    }
    for name, rows in books.items():
        write_book(tmp_path / f"{name}.xlsx", {"s": rows})
    write_book(tmp_path / "e_2021_01.xlsx", {"s": [["only a text"]], "t": []})
    errors = workbooks.sector_errors(workbooks.sector_tables(workbooks.read_cells(spark, str(tmp_path))))
    assert {(r.file[0], r.why) for r in errors.collect()} == {("a", "a sub-sector before any sector"), ("b", "no total"), ("c", "no period"), ("f", "a sector twice"), ("d", "an empty cell")}
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        workbooks.read_cells(spark, str(tmp_path)).count()


def test_places_of_cells():
    assert [workbooks.place_of(x) for x in ("A1", "Z9", "AA10", "BC12")] == [(1, 1), (9, 26), (10, 27), (12, 55)]
