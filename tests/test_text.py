"""Text functions, structure and formats against plain expectations."""

import datetime as dt
import html
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import structure
from corpusloom.functions import text as T
from corpusloom.plans import catalogue
from corpusloom.sources import documents as D
from corpusloom.sources import formats

LAW = """Luật số: 10/2026/QH15\nLUẬT\nThử nghiệm\n\nChương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\nNội dung một.\nĐiều 2. Đối tượng\n1. Khoản một theo\nĐiều 9 của luật.\n2. Khoản hai.
Chương II\nTHI HÀNH\nĐiều 3.\nHiệu lực\nVăn bản.\nPhụ lục I\nĐiều 1. Mẫu đơn"""


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "key"), [("66.13/2026/NQ-CP", "66-13-2026-nq-cp"), ("01/2026/NĐ-CP", "01-2026-nd-cp"), ("  Điều 5: Phạm vi ", "dieu-5-pham-vi"), ("--", "")]
)
def test_make_key(spark, text, key):
    assert one(spark, T.make_key, text) == key


def test_tokens_fold_accents(spark):
    assert one(spark, T.tokens, "hợp Đồng đường_ĐƯỜNG Straße 12a") == ["hop", "dong", "duong", "duong", "straße", "12a"]
    assert one(spark, T.query_terms, "hợp a_b, c") == ["hợp", "a_b", "c"]
    assert one(spark, lambda c: T.tokens(T.nfc(c)), "hợp") == ["hop"]
    assert one(spark, T.casefold, "Straße") == "strasse"


def test_find_numbers(spark):
    text = "theo 99/2026/NĐ-CP, 01/TT-BTC, 99/2026/NĐ-CP; 984/Ngày 25-8-2024; a/12/2026/QH15; 1.234/QĐ-BTC"
    assert one(spark, T.find_numbers, text) == ["99/2026/NĐ-CP", "01/TT-BTC", "1.234/QĐ-BTC"]
    assert one(spark, T.is_number, " 99/2026/NĐ-CP ") and not one(spark, T.is_number, "so 99/2026/NĐ-CP")


def test_windows(spark):
    text = "orchard harvest " * 100
    found = one(spark, lambda c: T.windows(c, 100, 10), text)
    assert found[0]["start"] == 0 and all(text[w["start"] : w["stop"]] == text[w["start"] : w["stop"]].strip() for w in found)
    assert found[-1]["stop"] == len(text.rstrip()) and [w["ordinal"] for w in found] == list(range(len(found)))
    assert one(spark, T.windows, "") == [] and one(spark, T.windows, None) == [] and one(spark, T.windows, " \n ") == []
    with pytest.raises(ValueError):
        T.windows(F.col("t"), 100, 100)


def test_words_and_lines(spark):
    assert one(spark, T.words, "") == 0 and one(spark, T.words, " a b\tc ") == 3
    assert [tuple(r) for r in one(spark, T.text_lines, "a\n\n  b \r\nc")] == [(1, "a"), (3, "b"), (4, "c")]
    assert one(spark, T.first_line, "\n \n  x y \nz") == "x y"


def heads(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r["level"], r["number"], r["title"]) for r in structure.headings(df).orderBy("start").collect()]


def test_headings(spark):
    assert heads(spark, LAW) == [
        ("chuong", "I", ""), ("dieu", "1", "Phạm vi"), ("dieu", "2", "Đối tượng"), ("chuong", "II", ""), ("dieu", "3", "Hiệu lực"), ("phuluc", "", "Phụ lục I"),
    ]


def test_headings_reject_references(spark):
    text = "Điều 1. Một\nxem theo quy định tại\nĐiều 5. của luật này\nXong.\nĐiều 3. Ba\nĐiều 3a. Ba a\nĐiều 20. Xa"
    assert [n for _, n, _ in heads(spark, text)] == ["1", "3", "3a"]


def test_sections_and_clauses(spark):
    df = spark.createDataFrame([(1, LAW), (2, "Điều 1. Một.")], "doc_id int, text string")
    got = structure.sections(df).orderBy("start").collect()
    assert [r["part"] for r in got] == ["mo-dau", "dieu-1", "dieu-2", "dieu-3", "phu-luc"]
    assert got[2]["path"] == ["Chương I", "Điều 2. Đối tượng"] and got[2]["text"].startswith("Điều 2.") and got[2]["text"].endswith("Khoản hai.")
    assert all(r["text"] == LAW[r["start"] : r["stop"]].strip() for r in got)


def chunks(spark, text, limit):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return structure.legal_chunks(df, limit=limit).orderBy("start", "part").collect()


def test_legal_chunks_cut(spark):
    long = "từ ngữ " * 60
    text = f"Điều 1. Một\n1. {long}\n2. hai:\na) {long}\nb) {long}\n3. ba\nĐiều 2. Hai\n{long}\n\n{long}\n\n{long}\n"
    got = chunks(spark, text, 200)
    assert [r["part"] for r in got] == [
        "dieu-1-khoan-1", "dieu-1-khoan-2", "dieu-1-khoan-2-diem-a", "dieu-1-khoan-2-diem-b", "dieu-1-khoan-3", "dieu-2", "dieu-2-pt2",
    ]
    assert got[2]["path"] == ["Điều 1. Một", "khoản 2", "điểm a"] and got[0]["body"].startswith("Điều 1. Một")
    assert all(r["body"] == text[r["start"] : r["stop"]] for r in got)
    assert [r["part"] for r in chunks(spark, text, 5000)] == ["dieu-1", "dieu-2"]


def test_legal_chunks_markup(spark):
    text = "# **Điều 1. Phạm vi** Nội dung *một*. Điều 2. Hai. Xong.\n\n<u>Điều 3.</u> Ba"
    got = chunks(spark, text, 2000)
    assert [r["part"] for r in got] == ["dieu-1", "dieu-2", "dieu-3"]
    assert got[0]["body"].startswith("Điều 1. Phạm vi") and "*" not in "".join(r["body"] for r in got)
    assert text[got[1]["start"] : got[1]["stop"]] == "Điều 2. Hai. Xong." and text[got[2]["start"] : got[2]["stop"]].endswith("Ba")


@pytest.mark.parametrize(
    ("head", "number", "name"),
    [("QUỐC HỘI\nLUẬT\nĐất đai\n", None, "Luật Đất đai"), ("NGHỊ ĐỊNH\nVề thuế\n", None, "Về thuế"), ("Số: 1/2020/TT-BTC\nTHÔNG TƯ\nHướng dẫn", "1/2020/TT-BTC", "Hướng dẫn"), ("x\ny", None, "")],
)
def test_document_name(spark, head, number, name):
    df = spark.createDataFrame([(head, number)], "h string, n string")
    assert df.select(structure.document_name(F.col("h"), F.col("n")).alias("x")).first()["x"] == name


@pytest.mark.parametrize(
    ("head", "number"),
    [("QUỐC HỘI\nLuật số: 10/2026/QH15\n", "10/2026/QH15"), ("Số: 5/2020/TT-BTC\ntheo 1/2019/NĐ-CP", "5/2020/TT-BTC"), ("THÔNG TƯ\ntheo 1/2019/NĐ-CP và 2/2019/TT-BTC", "2/2019/TT-BTC"), ("không có", None)],
)
def test_own_number(spark, head, number):
    assert one(spark, structure.own_number, head) == number


def test_page_titles_of_every_page(spark, tmp_path):
    """References in titles, no title, null html: a row for each page, as plain string handling has it."""
    raw = ["Plain", "a &amp; b", "&quot;q&quot; it&#39;s", "x&#x41;&eacute; &lt;b&gt;", " two\n  lines ", "AT&T", "&amp;amp;", None]
    pages = [(i, f"<html><head><title>{t}</title></head><body>t</body></html>" if t is not None else "<p>none</p>") for i, t in enumerate(raw)]
    pages.append((len(raw), None))
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: " ".join(html.unescape(t or "").split()) for i, t in enumerate([*raw, None])}
    got = catalogue.QUERIES["page_titles"](spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and {r["page_id"]: r["title"] for r in got} == want


def test_html_blocks():
    blocks, title = formats.html_blocks(
        "<title> A  b </title><style>x</style><h2>Head</h2><p>one<br>two <b>bold</b></p><ul><li>i1<li>i2</ul><table><tr><td>a<td>b</tr></table><script>1</script>&amp; tail"
    )
    assert title == "A b" and blocks == ["## Head", "one two bold", "- i1", "- i2", "a | b", "& tail"]


def parts(path, data):
    row = formats.read_file(path, data)
    return row["error"] or [(p["locator"], p["text"]) for p in row["parts"]]


def test_plain_formats():
    assert parts("a.json", b'{"a": {"c": [1, {"d e": true}]}, "b": null}') == [("$.a.c[0]", "a.c[0]: 1"), ('$.a.c[1]["d e"]', 'a.c[1]["d e"]: true'), ("$.b", "b: null")]
    assert parts("a.csv", b"name;city\nAnn;Hanoi\n;\nBob;\n") == [("row:2", "name: Ann; city: Hanoi"), ("row:4", "name: Bob")]
    assert parts("a.txt", "x\n\n y ".encode()) == [("line:1", "x"), ("line:3", "y")]
    assert parts("a.json", b"{") == "format_parse_failed" and parts("a.bin", b"") == "unsupported_format"
    assert formats.read_file("a.pdf", b"%PDF")["reviews"] == ["ocr_runtime_missing"]
    assert formats.decode("é".encode("cp1258"))[1] == "cp1258"




def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'


def test_archives():
    docx = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert parts("a.docx", docx) == [("paragraph:1", "Hi\tyou"), ("table:1/row:1/column:1", "c")]
    odt = zipped({"content.xml": '<o xmlns:t="u"><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b<t:line-break/>c</t:p></o>'})
    assert parts("a.odt", odt) == [("paragraph:1", "## H"), ("paragraph:2", "a  b\nc")]
    ods = zipped({"content.xml": '<o xmlns:t="u"><t:table t:name="S"><t:table-row t:number-rows-repeated="3"><t:table-cell/></t:table-row><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>v</t:p></t:table-cell></t:table-row></t:table></o>'})
    assert parts("a.ods", ods) == [("sheet:S/row:4", "v | v")]
    epub = zipped({
        "META-INF/container.xml": '<c><rootfile full-path="o/b.opf"/></c>',
        "o/b.opf": '<p><title>T</title><item id="b" href="2.html"/><item id="a" href="1.html"/><itemref idref="a"/><itemref idref="b"/></p>',
        "o/1.html": "<p>one</p>", "o/2.html": "<p>two</p>",
    })
    assert parts("a.epub", epub) == [("chapter:1", "one"), ("chapter:2", "two")]
    pptx = zipped({"ppt/slides/slide2.xml": "<s><sp><p><t>b</t></p></sp></s>", "ppt/slides/slide1.xml": "<s><sp><p><t>a</t></p></sp></s>"})
    assert parts("a.pptx", pptx) == [("slide:1/shape:1", "a"), ("slide:2/shape:1", "b")]
    xlsx = zipped({
        "xl/workbook.xml": '<w xmlns:r="r"><sheet name="S" r:id="r1"/></w>', "xl/_rels/workbook.xml.rels": '<r><x Id="r1" Target="worksheets/sheet1.xml"/></r>',
        "xl/sharedStrings.xml": "<s><si><t>word</t></si></s>", "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/></cellXfs></s>',
        "xl/worksheets/sheet1.xml": '<s><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45000</v></c><c r="C1" s="2"><v>0.125</v></c><c r="D1"><v>7</v></c><c r="E1"/></s>',
    })
    assert parts("a.xlsx", xlsx) == [("sheet:S/cell:A1", "word"), ("sheet:S/cell:B1", "2023-03-15"), ("sheet:S/cell:C1", "12.50%"), ("sheet:S/cell:D1", "7")]
    assert parts("a.docx", b"no zip") == "format_parse_failed"
    assert parts("a.odt", zipped({"content.xml": '<!DOCTYPE x [<!ENTITY a "b">]><o/>'})) == "format_parse_failed"


@pytest.mark.parametrize(
    ("value", "shape", "text"),
    [(1234.0, "General", "1234"), (1234567, "#,##0", "1,234,567"), (0.5, "0%", "50%"), (1.005, "0.00", "1.00"), (True, None, "TRUE"), ("x", "0", "x"),
     (dt.datetime(2026, 1, 2), "dd/mm/yyyy", "02/01/2026"), (dt.datetime(2026, 1, 2, 3, 4), "yyyy-mm-dd", "2026-01-02 03:04"), (dt.time(5, 6, 7), None, "05:06:07"), (1.5, None, "1.5")],
)
def test_cell_text(value, shape, text):
    assert formats.cell_text(value, shape) == text


def test_spans(spark):
    d = D.joined([{"kind": "line", "locator": "line:1", "text": "ab"}, {"kind": "line", "locator": "line:2", "text": "🙂c"}])
    assert d["text"] == "ab\n\n🙂c" and [(s["start"], s["stop"]) for s in d["spans"]] == [(0, 2), (4, 6)]
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "🙂c")], "doc int, n int, text string")
    got = D.spans_of(rows, ["doc"], "n", "text", "turn").first()["spans"]
    assert [(s["start"], s["stop"], s["locator"]) for s in got] == [(0, 2, "turn:0"), (4, 6, "turn:1")]


def test_long_text_is_linear(spark):
    text = "Điều 1. Một\nx\n" + "dòng thường\n" * 60_000 + "Điều 2. Hai\ny"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [r["part"] for r in structure.sections(df).orderBy("start").collect()] == ["dieu-1", "dieu-2"]
