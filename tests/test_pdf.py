import base64
import zlib

import pytest

from veridelta.operators.layout import build_blocks, rows_of
from veridelta.plans.pdf_samples import SHOWS, Style, pdf_file
from veridelta.sources import pdf_syntax as P
from veridelta.sources import pdf_text as X
from veridelta.sources.pdf import extract_blocks, pdf_blocks, read_pdfs


def read(data):
    return P.Reader(data).next()


def test_primitives():
    assert isinstance(read(b"/Name"), P.Name) and read(b"/Name") == "Name" and read(b"/A#20B#zz") == "A B#zz"
    assert [read(x) for x in (b"123", b"-4.5", b"true", b"false", b"null", b"1.2.3", b".5", b"+7")] == [123, -4.5, True, False, None, 0, 0.5, 7]
    assert read(b"% note\n  42") == 42 and read(b"Tj") == P.Keyword("Tj")
    for bad in (b"]", b">>", b")", b"<< 1 2 >>"):
        with pytest.raises(ValueError):
            read(bad)
    with pytest.raises(EOFError):
        read(b"  ")


def test_strings():
    assert read(b"(hello)") == b"hello" and read(rb"(a\(b\)c)") == b"a(b)c" and read(rb"(line\nbreak)") == b"line\nbreak"
    assert read(rb"(a(b(c))\101\7\q)") == b"a(b(c))A\x07q" and read(b"(a\\\r\nb)") == b"ab" and read(b"(open") == b"open"
    assert read(b"<48656c6c6f>") == b"Hello" and read(b"<48 6>") == b"H`" and read(b"<4g>") == b""


def test_containers_and_streams():
    assert read(b"[1 2 3 R /X]") == [1, P.Ref(2, 3), "X"] and read(b"[1 [2 (x)] <</A [3]>>]") == [1, [2, b"x"], {"A": [3]}]
    assert read(b"<< /Type /Page /Count 3 >>") == {"Type": "Page", "Count": 3} and read(b"[1 2") == [1, 2]
    s = read(b"<< /Length 5 >>\nstream\nABCDE\nendstream")
    assert isinstance(s, P.Stream) and s.raw == b"ABCDE" and s.entries == {"Length": 5}
    assert read(b"[" * 5000 + b"]" * 5000)


def test_filters():
    text = b"the quick brown fox" * 10
    z = zlib.compress(text)
    for broken in (z, b"x" + z, z[2:-4]):
        assert P.decoded(broken, P.Name("FlateDecode"), None) == text
    assert P.decoded(base64.a85encode(b"Hello, PDF!"), P.Name("ASCII85Decode"), None) == b"Hello, PDF!"
    assert P.decoded(b"<~" + base64.a85encode(b"Hi") + b"~>junk", [P.Name("A85")], None) == b"Hi"
    assert P.decoded(b"Hello, PDF!".hex().encode() + b">", P.Name("AHx"), None) == b"Hello, PDF!"
    assert P.decoded(zlib.compress(b"Hi").hex().encode(), [P.Name("AHx"), P.Name("Fl")], None) == b"Hi"
    for bad in ("DCTDecode", "LZWDecode", "Strange"):
        with pytest.raises(P.FilterError):
            P.decoded(b"", P.Name(bad), None)


def test_stream_data_that_ends_like_a_line():
    texts = [b"BT /F1 10 Tf 72 700 Td (%s) Tj ET" % (b"a" * i) for i in range(256)]
    ends = {}
    for t in texts:
        ends.setdefault(zlib.compress(t)[-1:], t)
    for last in (b"\r", b"\n", b"\0"):
        z = zlib.compress(ends[last])
        for eol in (b"\n", b"\r\n", b"\r", b""):
            for length in (b"/Length %d" % len(z), b"/Length 7", b"/Length 9 0 R", b""):
                s = read(b"<< /Filter /FlateDecode %s >>\nstream\n%s%sendstream" % (length, z, eol))
                assert P.decoded(s.raw, s.entries["Filter"], None) == ends[last]
    for broken in (z[:-6], z[:-1] + b"?"):
        with pytest.raises(P.FilterError):
            P.decoded(broken, P.Name("FlateDecode"), None)


def test_positions_where_a_streams_data_end_like_a_line():
    for style in (Style(), Style("png", "to-unicode", "each", "nested"), Style("flate", "to-unicode", "quote", "bare"), Style("tiff", "winansi", "quote", "xref-stream")):
        for i in range(200):
            heading, line = "H" * (i + 1), "a" * (i + 1) + " b"
            blocks = extract_blocks(pdf_file([[[(72, 2000, 18, heading)], [(72, 1948, 10, line)]]], style))
            assert [(b.text, b.x, round(b.y, 6), b.size, len(b.lines)) for b in blocks] == [(heading, 72, 2000, 18, 1), (line, 72, 1948, 10, 1)]


def test_positions_far_down_a_page():
    for show in SHOWS:
        blocks = extract_blocks(pdf_file([[[(72, -1234568, 10, "one"), (72, -1234580, 10, "two")], [(72, -1234633, 10, "three")]]], Style(show=show)))
        assert [(b.text, b.x, b.y, b.size, len(b.lines)) for b in blocks] == [("one two", 72, -1234568, 10, 2), ("three", 72, -1234633, 10, 1)]


def test_predictors():
    rows = [bytes(range(i, i + 6)) for i in (10, 20, 200, 7, 90)]

    def coded(tag, row, above):
        out = []
        for i, x in enumerate(row):
            a, b, c = (row[i - 2] if i > 1 else 0), above[i], (above[i - 2] if i > 1 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, paeth)[tag]) & 0xFF)
        return bytes([tag, *out])

    parms = {"Predictor": 15, "Colors": 2, "Columns": 3}
    data = b"".join(coded(t, r, rows[t - 1] if t else bytes(6)) for t, r in enumerate(rows))
    assert P.unpredicted(data, parms) == b"".join(rows)
    assert P.unpredicted(data[:-2], parms)[:24] == b"".join(rows)[:24]
    with pytest.raises(P.FilterError):
        P.unpredicted(b"\x09abcdef", parms)
    assert P.unpredicted(bytes([1, 2, 1, 1, 1, 1, 5, 5, 0, 0, 0, 0]), {"Predictor": 2, "Colors": 2, "Columns": 3}) == bytes([1, 2, 2, 3, 3, 4, 5, 5, 5, 5, 5, 5])


def test_fonts():
    cmap = b"beginbfchar <01> <0041> <02> <00660069> endbfchar beginbfrange <10> <12> <0061> <20> <21> [<0058> <0059>] endbfrange"
    assert X.to_unicode(cmap) == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "X", 33: "Y"}
    assert [X.glyph_text(n) for n in ("fi", "uni0041", "u1F600", "x", "weird", ".notdef")] == ["fi", "A", "\U0001f600", "x", "", ""]
    assert X.Font({1: "A"}, True).decode(b"\x00\x01\x00\x02\x00") == "A"
    doc = P.Document(pdf_file([[[(1, 1, 9, "x")]]]))
    f = X.font({"Subtype": P.Name("Type1"), "Encoding": {"BaseEncoding": P.Name("MacRomanEncoding"), "Differences": [65, P.Name("fl"), P.Name("b")]}}, doc)
    assert f.decode(b"ABC\x8a") == "flbC" + b"\x8a".decode("mac_roman")
    assert X.font({"Subtype": P.Name("Type0")}, doc).decode(b"\x00A") == ""


def runs(content):
    return [(r.text, round(r.x, 3), round(r.y, 3), round(r.size, 3)) for r in X.TextMachine({}).run(content)]


def test_content_operators():
    assert runs(b"BT /F 10 Tf 5 7 Td (a) Tj 0 -3 TD (b) Tj T* (c) Tj ET") == [("a", 5, 7, 10), ("b", 5, 4, 10), ("c", 5, 1, 10)]
    assert runs(b"q 2 0 0 2 10 10 cm BT /F 10 Tf 1 0 0 1 3 4 Tm (a) Tj ET Q BT /F 10 Tf (b) Tj ET") == [("a", 16, 18, 20), ("b", 0, 0, 10)]
    assert runs(b"BT /F 10 Tf [(A) -200 (B) -180 (C) 50 (D)] TJ (e) Tj ET") == [("A BCD", 0, 0, 10), ("e", 25, 0, 10)]
    assert runs(b"BT /F 10 Tf 12 TL (a) ' 1 2 (b) \" ET") == [("a", 0, -12, 10), ("b", 0, -24, 10)]
    assert runs(b"BI /W 1 ID \x00(x) Tj EI BT /F 8 Tf 1 Tc 2 Tw (a b) Tj (c) Tj ET") == [("a b", 0, 0, 8), ("c", 17, 0, 8)]
    assert runs(b"BT ) > /F 9 Tf (ok) Tj") == [("ok", 0, 0, 9)]


def test_table_and_paragraph():
    grid = [["Service", "SLA", "Owner"], ["API", "99.5%", "Platform"], ["DB", "99.9%", "Infra"]]
    cells = [X.Run(t, x, y, 10, "F1") for y, row in zip((100, 85, 70), grid) for x, t in zip((10, 60, 110), row)]
    blocks = build_blocks([*cells, X.Run("A normal paragraph sentence here.", 10, 40, 10, "F1")], 1)
    assert [b.table for b in blocks] == [grid, None] and blocks[0].text.startswith("Service SLA Owner API") and "normal paragraph" in blocks[1].text


def test_layout_rules():
    line = lambda t, y, size=10, x=10: X.Run(t, x, y, size, "F")
    blocks = build_blocks([line("Title", 100, 14), line("one", 80), line("two", 66), line("far", 20), line("inset", 8, 10, 60)], 3)
    assert [(b.text, b.is_heading, b.page) for b in blocks] == [("Title", True, 3), ("one two", False, 3), ("far", False, 3), ("inset", False, 3)]
    rows = rows_of([line("b", 50.04, 10, 30), line("a", 50, 10, 10), line(" ", 50), line("c", 46, 10, 50), line("d", 40)])
    assert [[c.text for c in r.cells] for r in rows] == [["a", "b", "c"], ["d"]]
    assert build_blocks([], 1) == []


def test_files(spark, tmp_path):
    data = pdf_file([[[(72, 700, 18, "System (Design) Review")], [(72, 600, 10, "First café paragraph."), (72, 588, 10, "goes on")]], [[(72, 700, 10, "Second page")]]])
    want = [("System (Design) Review", True, 1), ("First café paragraph. goes on", False, 1), ("Second page", False, 2)]
    assert [(b.text, b.is_heading, b.page) for b in extract_blocks(b"junk\n" + data)] == want
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(data.replace(b"/Size", b"/Encrypt 1 0 R /Size"))
    rows = read_pdfs(spark, str(tmp_path / "*.pdf")).collect()
    assert [(r.text, r.is_heading, r.page) for r in sorted((r for r in rows if r.error is None), key=lambda r: r.block_ord)] == want
    assert sorted(r.error for r in rows if r.error) == ["no %PDF- header", "the file is encrypted"]
    empty = spark.createDataFrame([], "doc_id string, content binary")
    assert pdf_blocks(empty).collect() == []


def test_command_line(spark, tmp_path, capsys):
    from veridelta.cli import main

    paths = []
    for name, text in (("a", "The cat sat on the mat."), ("b", "The cat sat on the rug.")):
        paths.append(str(tmp_path / f"{name}.pdf"))
        (tmp_path / f"{name}.pdf").write_bytes(pdf_file([[[(72, 700, 18, "Title")], [(72, 600, 10, text)]]]))
    assert main([*paths, "--output", "md"], spark) == 0
    assert "| paragraph ★ |" in capsys.readouterr().out
    assert main([paths[0], paths[0], "--granularity", "section"], spark) == 0
    assert "SIMILARITY  section=100.0%" in capsys.readouterr().out
    assert main([paths[0], str(tmp_path / "none.pdf")], spark) == 1
    assert main([*paths, "--embed-backend", "voyage"], spark) == 1
    assert "veridelta: " in capsys.readouterr().err
