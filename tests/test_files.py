import io
import struct
import zipfile

from brookloom.sources import files as f

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def packed(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


def test_docx():
    data = packed(
        {
            "word/styles.xml": f'<w:styles {W}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='T1'/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:p><w:r><w:t>Kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>"
            "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Age</w:t></w:r></w:p></w:tc></w:tr>"
            "<w:tr><w:tc><w:p><w:r><w:t>Ada</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>36</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        }
    )
    assert f.text_of("a.docx", data)[1] == "# Plan\n\nKept\n- item\nName: Ada; Age: 36"


def test_xlsx():
    data = packed(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Costs" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>Day</t></si><si><t>Sum</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>45000</v></c><c r="B2"><v>12.5</v></c></row></sheetData></worksheet>',
        }
    )
    assert f.text_of("a.xlsx", data)[1] == "Sheet: Costs\nDay: 2023-03-15; Sum: 12.5"
    assert f.serial_text(1) == "1900-01-01" and f.serial_text(61) == "1900-03-01" and f.serial_text(0.5) == "12:00"


def test_pptx():
    sp = lambda kind, text: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    data = packed({"ppt/slides/slide1.xml": f"<p:sld {A}>{sp('title', 'Start')}{sp('body', 'Point')}{sp('sldNum', '1')}</p:sld>", "ppt/notesSlides/notesSlide1.xml": f"<p:notes {A}>{sp('body', 'say it')}</p:notes>"})
    assert f.text_of("a.pptx", data)[1] == "Slide 1: Start\nPoint\nNotes: say it"


def test_refusals_and_images():
    assert f.text_of("a.docx", b"no zip")[2] == "broken_zip" and f.text_of("a.exe", b"x")[2] == "unsupported" and f.text_of("noext", b"x")[2] == "unsupported"
    assert f.text_of("a.txt", b" \n")[2] == "empty" and f.text_of("a.json", b"{x")[2] == "invalid_json" and f.text_of("a.docx", packed({"x": "y"}))[2] == "not_docx"
    assert f.text_of("a.docx", packed({"../x": "y"}))[2] == "zip_name" and f.text_of("a.docx", packed({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"}))[2] == "xml_entities"
    assert f.text_of("a.html", b"<meta charset=latin-1><p>f\xfcr</p>")[1] == "für"
    assert f.image_facts(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == ("image/png", 3, 4) and f.image_facts(b"abc") is None
    assert f.image_facts(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06" + b"\0" * 9) == ("image/jpeg", 6, 5)


def test_read_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_bytes(b"\xef\xbb\xbf# T\r\nbody")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text, r.error) for r in f.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("csv", "id: 1; name: x", None), "b.md": ("text", "# T\nbody", None), "c.bin": (None, None, "unsupported")}


def test_document_types_anywhere_and_depth():
    late = "<?xml version='1.0'?>" + "<!-- " + "x" * 5000 + " --><!DOCTYPE x [<!ENTITY a 'b'>]><x/>"
    for data in (late.encode(), late.replace("<?xml version='1.0'?>", "<?xml version='1.0' encoding='utf-16'?>").encode("utf-16")):
        assert f.text_of("a.docx", packed({"word/document.xml": data}))[2] == "xml_entities"
    assert f.text_of("a.docx", packed({"word/document.xml": "<x>" * 300 + "</x>" * 300}))[2] == "xml_depth"


def test_overlapping_entries_and_more_images():
    data = packed({"a": "x" * 50, "b": "y" * 50})
    at = data.rfind(b"PK\x01\x02")
    assert f.text_of("a.docx", data[: at + 42] + struct.pack("<I", 0) + data[at + 46 :])[2] in ("zip_overlap", "broken_zip")
    assert f.image_facts(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)) == ("image/bmp", 7, 9)
    assert f.image_facts(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (4).to_bytes(3, "little")) == ("image/webp", 10, 5)
