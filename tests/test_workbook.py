import zipfile

from kerbline.sources import traffic, workbook

HEAD = ["DET_NAME_ALT", "DET_ID15", "MQ_KURZNAME", "STRASSE", "RICHTUNG", "LÄNGE (WGS84)", "LAENGE (WGS84)", "BREITE (WGS84)", "INBETRIEBNAHME", "ABBAUDATUM", "deinstalliert"]


def cell(at, value, style=None):
    s = f' s="{style}"' if style is not None else ""
    if value is None:
        return f'<c r="{at}"{s}/>'
    if isinstance(value, tuple):
        return f'<c r="{at}" t="{value[0]}"{s}>{value[1]}</c>'
    return f'<c r="{at}"{s}><v>{value}</v></c>'


def book(path, rows, shared=(), formats="", xfs=(0, 14), extra="", sheet_target="worksheets/sheet1.xml"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}>{extra}<sheets><sheet name="a" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="rId1" Target="styles.xml"/><Relationship Id="rId7" Target="{sheet_target}"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="22"/></cellStyleXfs><cellXfs>{"".join(f"""<xf numFmtId="{x}"/>""" for x in xfs)}</cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(rows)}</sheetData></worksheet>")


def test_cells(tmp_path):
    shared = ["<si><t>plain</t></si>", "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>", "<si/>"]
    formats = '<numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/><numFmt numFmtId="172" formatCode="[Red]0.0"/>'
    values = [("s", "<v>0</v>"), ("s", "<v>1</v>"), ("s", "<v>2</v>"), ("inlineStr", "<is><t>in line</t></is>"), ("b", "<v>1</v>"), ("b", "<v>0</v>"), ("e", "<v>#N/A</v>"), ("str", "<f>A1</f><v>made</v>")]
    line = "".join(cell(f"{chr(65 + i)}2", v) for i, v in enumerate(values))
    numbers = cell("A4", "100101010000167") + cell("C4", "13.4050") + cell("D4", "1.0E2") + cell("E4", "45000", 1) + cell("F4", "45000.75", 2) + cell("G4", "45000", 3) + cell("H4", "1.5", 4) + cell("AB4", "-7.0")
    book(tmp_path / "a.xlsx", [f'<row r="2">{line}</row>', '<row r="3"><c r="A3"/></row>', f'<row r="4">{numbers}</row>', "<row><c><v>5</v></c><c><v>6</v></c></row>"], shared, formats, (0, 14, 170, 171, 172))
    got = dict(workbook.sheet_rows((tmp_path / "a.xlsx").read_bytes()))
    assert got[2] == ["plain", "rich text", "", "in line", "true", "false", None, "made"]
    assert got[4][:8] == ["100101010000167", None, "13.405", "100", "2023-03-15", "2023-03-15", "45000", "1.5"]
    assert len(got[4]) == 28 and got[4][27] == "-7" and got[5] == ["5", "6"] and set(got) == {2, 4, 5}
    book(tmp_path / "b.xlsx", [f'<row r="1">{cell("A1", "0", 1)}</row>'], extra='<workbookPr date1904="1"/>', sheet_target="/xl/worksheets/sheet1.xml")
    assert dict(workbook.sheet_rows((tmp_path / "b.xlsx").read_bytes())) == {1: ["1904-01-01"]}


def test_detectors_from_workbooks(spark, tmp_path):
    head = "".join(cell(f"{chr(65 + i)}1", ("inlineStr", f"<is><t> {h} </t></is>")) for i, h in enumerate(HEAD))
    row = cell("A2", ("inlineStr", "<is><t>TE001</t></is>")) + cell("B2", "100101010000167.0") + cell("D2", ("inlineStr", "<is><t>Weg</t></is>")) + cell("G2", "13.4051") + cell("H2", "52.5") + cell("I2", "45000", 1) + cell("K2", ("b", "<v>1</v>"))
    book(tmp_path / "one.xlsx", [f'<row r="1">{head}</row>', f'<row r="2">{row}</row>'])
    other = "".join(cell(f"{chr(65 + i)}3", ("inlineStr", f"<is><t>{h}</t></is>")) for i, h in enumerate(["Strasse", "DET_NAME_ALT"]))
    book(tmp_path / "two.xlsx", [f'<row r="3">{other}</row>', f'<row r="4">{cell("A4", ("inlineStr", "<is><t>Allee</t></is>"))}{cell("B4", ("inlineStr", "<is><t>TE002</t></is>"))}</row>'])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "notes.txt").write_text("x")
    rows = workbook.read_sheet(spark, str(tmp_path))
    assert rows.count() == 2
    got = {r.detector_key: r for r in traffic.detectors(rows).collect()}
    a, b = got["TE001"], got["TE002"]
    assert (a.det_id15, a.detector_street, a.lon, a.lat, str(a.active_from), a.active_to, a.removed) == ("100101010000167", "Weg", 13.4051, 52.5, "2023-03-15", None, True)
    assert (b.det_id15, b.detector_street, b.lon, b.removed) == (None, "Allee", None, False)
