"""Readers of well logs and workbooks."""

import zipfile

from lodestone.sources import files

LAS = """~Version
VERS. 2.0 : CWLS
~Well
NULL. -999.25 : null
WELL. DH-1 : well
~Curve
DEPT.M : depth
GR  .API : gamma
DEN .G/CC :
~ASCII
1.0 55.5 2.7
2.0 -999.25 2.8
"""


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS)
    (tmp_path / "b.las").write_text("~A\n")
    got = sorted(tuple(r)[1:] for r in files.read_las(spark, str(tmp_path / "*.las")).collect())
    assert got == [("DH-1", 1.0, "DEN", 2.7), ("DH-1", 1.0, "GR", 55.5), ("DH-1", 2.0, "DEN", 2.8)]


def test_xlsx(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>hole</t></si><si><r><t>A</t></r><r><t>u</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>0045</t></is></c><c r="C2"><v>1.5</v></c></row><row><c r="C3"><v>2</v></c></row></sheetData></worksheet>')
    cells = files.read_xlsx(spark, str(tmp_path / "w.xlsx"))
    got = [tuple(r) for r in files.sheet_table(cells, "S1", ["hole", "Au"]).orderBy("row").collect()]
    assert got == [(1, "0045", "1.5"), (2, None, "2")]


def test_wrapped_logs_usual_nulls_and_feet():
    from lodestone.sources.files import parse_las

    text = "~V\nVERS. 2.0:\nWRAP. YES:\n~W\nSTRT.FT 10:\nWELL. A-1:\n~C\nDEPT.FT :\nGR. :\nRES. :\n~A\n10\n1.5 -999.25\n20 2.5\n7 30 1\n"
    header, curves, rows = parse_las(text)
    assert header["WELL"] == "A-1" and curves == ["DEPT", "GR", "RES"]
    assert rows == [[3.048, 1.5, None], [6.096, 2.5, 7.0]]


def test_layouts():
    from lodestone.sources.rawtables import guess_mapping, guess_target, layout_of

    a = layout_of(["# note", "Company X", "", "Hole;From;To;Au", "A;0;1;0,5", "A;1;2;0,7", "A;2;3;1"])
    assert (a.delimiter, a.headers) == (";", ("Hole", "From", "To", "Au")) and a.above[-1].startswith("Hole;")
    b = layout_of([",Lithology,,", "Hole Number,From (m),To (m),Code", "A,0,1,GR", "A,1,2,GR"])
    assert b.headers == ("Hole Number", "From (m)", "To (m)", "Code")
    c = layout_of(["x\ty\tAu\tAu", "1\t2\t3\t4"])
    assert c.headers == ("x", "y", "Au", "Au_again1") and layout_of([]).headers == ()
    headers = ["Hole_Length", "HoleID", "Easting (m)", "North", "RL", "Bearing"]
    assert guess_target(headers) == "collars"
    assert guess_mapping("collars", headers) == {"hole_id": "HoleID", "x": "Easting (m)", "y": "North", "z": "RL", "azimuth": "Bearing", "length": "Hole_Length"}


def test_decimal_commas_are_decided_by_column(spark, tmp_path):
    from lodestone.sources import rawtables

    (tmp_path / "t.csv").write_bytes("note \u2013 Süd\nname;a;b;c;d\nx;1,5;1,234;0045;7\n#y;1,234;2,345;7;na\n# note\nz\u2013;2;3,456;1;1.5\n".encode("windows-1252"))
    raw = rawtables.read_raw(spark, str(tmp_path / "t.csv"))
    assert rawtables.decimal_commas(raw, raw.columns) == {"a": "convert", "b": "ambiguous"}
    got = [tuple(r) for r in rawtables.typed(raw).orderBy("name").collect()]
    assert got == [("#y", 1.234, "2,345", "7", None), ("x", 1.5, "1,234", "0045", 7.0), ("z\u2013", 2.0, "3,456", "1", 1.5)]


def test_variogram_fit_keeps_within_bounds():
    import numpy as np

    from lodestone.operators import geostat

    h = np.arange(5.0, 105.0, 10.0)
    bins = [(float(x), float(2 + 3 * (1.5 * x / 60 - 0.5 * (x / 60) ** 3 if x < 60 else 1)), 50) for x in h]
    fit = geostat.fit_model(bins, "spherical")
    assert abs(fit["nugget"] - 2) < 0.05 and abs(fit["sill"] - 5) < 0.05 and abs(fit["range"] - 60) < 1
    falling = geostat.fit_model([(10.0, 5.0, 9), (20.0, 4.0, 9), (30.0, 3.0, 9)], "spherical")
    assert falling["nugget"] == falling["sill"] == 4.0
    import pytest

    with pytest.raises(ValueError):
        geostat.fit_model([(10.0, 5.0, 9), (20.0, None, 0), (30.0, 3.0, 9)], "spherical")


def test_kriging_is_the_dense_systems_solution(spark):
    import numpy as np

    from lodestone.operators import geostat

    rng = np.random.default_rng(3)
    pts = [(f"p{i}", float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.uniform(0, 100, (9, 3)))]
    df = spark.createDataFrame(pts, "id string, x double, y double, value double")
    model = {"kind": "spherical", "nugget": 1.0, "sill": 9.0, "range": 80.0}
    at = spark.createDataFrame([("t", 40.0, 60.0)], "block string, x double, y double")
    got = geostat.krige(at, df, "block", "id", "value", 500.0, model).first()
    x = np.array([p[1:3] for p in pts])
    cov = lambda d: 9.0 - np.where(d > 0, geostat.model_gamma(d, "spherical", 1.0, 9.0, 80.0), 0.0)
    a = np.ones((10, 10))
    a[:9, :9], a[9, 9] = cov(np.linalg.norm(x[:, None] - x, axis=2)), 0
    c = np.append(cov(np.linalg.norm(x - [40.0, 60.0], axis=1)), 1.0)
    w = np.linalg.solve(a, c)
    assert got.block == "t" and abs(got.estimate - w[:9] @ [p[3] for p in pts]) < 1e-9 and abs(got.variance - (9.0 - w @ c)) < 1e-9


def test_layouts_of_spaced_and_ended_rows():
    from lodestone.sources.rawtables import layout_of

    a = layout_of(["notes", "by: x", "LINE,STN,MX", "1,2,3,", "1,3,4,", "2,2,5,"])
    assert a.headers == ("LINE", "STN", "MX") and a.above == ("notes", "by: x", "LINE,STN,MX")
    b = layout_of(["", " LINE  STN   MX", "10  1  2.5", " 10   2   3", "total"] + ["10 3 4"] * 4)
    assert b.spaced and b.headers == ("LINE", "STN", "MX") and b.delimiter == "\t"
    assert not layout_of(["one two three", "1,2 3 4", "1 2 3"]).spaced and not layout_of(["one two", "1 2"]).spaced


def test_hole_ids_are_not_their_attributes():
    from lodestone.sources.rawtables import guess_mapping

    got = guess_mapping("collars", ["Hole_Azi", "Hole_Dip", "Site", "Easting", "Northing", "RL"])
    assert "hole_id" not in got and got["azimuth"] == "Hole_Azi" and got["dip"] == "Hole_Dip" and got["z"] == "RL"
    got = guess_mapping("collars", ["Hole_Type", "HoleNo", "Planned_Azimuth", "Azimuth", "Depth_to_Base", "Precollar_Depth", "EOH"])
    assert got == {"hole_id": "HoleNo", "azimuth": "Azimuth", "length": "EOH"}


def test_encoding_by_all_bytes(spark, tmp_path):
    from lodestone.sources import rawtables

    path = tmp_path / "late.csv"
    path.write_bytes(b"hole,place\n" + b"a,plain\n" * 900 + "b,S\u00fcd\n".encode("windows-1252"))
    layout = rawtables.probe(spark, str(path))
    assert layout.encoding == "windows-1252"
    assert rawtables.read_raw(spark, str(path), layout).where("hole = 'b'").first().place == "S\u00fcd"
    path.write_bytes(b"hole,place\n" + "b,S\u00fcd\n".encode())
    assert rawtables.probe(spark, str(path)).encoding == "utf-8"
