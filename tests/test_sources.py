import pytest

from textquarry.plans import made_files as MF
from textquarry.sources import docx, files, pdf

LINES = ["The first line of a page with enough words in it.", "A second (line) with \\ signs and more words to read.", "And a third line so that the text layer is long enough to be accepted."]
CORE = '<cp:coreProperties><dc:creator>A &amp; B</dc:creator><cp:revision>1</cp:revision></cp:coreProperties>'


def test_docx():
    made = MF.docx_bytes(["one <two>", "", "  three "], core=CORE)
    assert docx.text_of(made) == "one <two>\n\nthree" and docx.fields_of(made) == {"creator": "A & B", "revision": "1"}
    for bad in (b"nonsense", docx.OLD_FORMAT + b"x", b""):
        with pytest.raises(ValueError):
            docx.text_of(bad)


def test_pdf_plain_and_damaged():
    made = MF.pdf_bytes(LINES)
    assert [x.strip() for x in pdf.text_of(made).split("\n")] == LINES
    for bad in (b"no pdf", MF.pdf_bytes(["short"]), made.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")):
        with pytest.raises(ValueError):
            pdf.text_of(bad)


def test_pdf_to_unicode_two_byte_and_ascii85():
    import base64

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <001A> <0061> endbfrange 2 beginbfchar <0020> <0020> <0030> <00660066> endbfchar"
    code = lambda s: "".join("0020" if c == " " else "0030" if c == "F" else f"{ord(c) - 96:04X}" for c in s)
    words = "the text layer oF a page with many words " * 6
    stream = base64.a85encode(f"BT /F1 9 Tf 10 10 Td <{code(words)}> Tj ET".encode()) + b"~>"
    made = MF.pdf_bytes([], {4: b"<< /Length 6 0 R /Filter [/ASCII85Decode] >>\nstream\n" + stream + b"\nendstream", 5: b"<< /Type /Font /ToUnicode 7 0 R >>", 6: b"%d" % len(stream), 7: b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"})
    assert pdf.text_of(made) == words.replace("F", "ff").strip()
    hostile = pdf.CMap.parsed(b"beginbfrange <0000> <FFFFFFFF> <0041> endbfrange")
    assert len(hostile.codes) <= pdf.MOST_RANGE + 1


def test_extract_keeps_going(spark):
    rows = [("a/x.docx", MF.docx_bytes(["hello there"])), ("a/y.pdf", MF.pdf_bytes(LINES)), ("a/z.png", b"1"), ("a/q.pdf", b""), ("a/w.txt", None)]
    found = {r.path: r for r in files.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["a/x.docx"].text == "hello there" and found["a/y.pdf"].error is None
    assert all(found[p].text is None and found[p].error for p in ("a/z.png", "a/q.pdf", "a/w.txt"))
