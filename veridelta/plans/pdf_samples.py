"""PDF files made from blocks and tables, in many spellings of the same content.

A file's style follows its doc_id, so that one table of documents meets every filter,
predictor, font encoding, text operator and file structure that the reader knows, and each
must give the same text back.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = ("plain", "flate", "ascii85", "hex", "ascii85 flate", "hex flate", "png", "tiff")
FONTS = ("winansi", "macroman", "differences", "to-unicode", "composite")
SHOWS = ("each", "next-line", "quote", "scaled", "array")
STRUCTURES = ("flat", "nested", "xref-stream", "bare")
#: words of a line, units between lines, blocks on a page
WORDS, LEADING, PER_PAGE = 12, 12, 40
#: fixed values: glyph names that the font with differences moves to other codes
_MOVED = {1: "a", 2: "e", 3: "fi", 4: "uni00F1", 5: "u00E9", 6: "parenleft", 7: "period"}
_MOVED_TEXT = {"a": 1, "e": 2, "ñ": 4, "é": 5, "(": 6, ".": 7}


@dataclass(frozen=True)
class Style:
    filter: str = "flate"
    font: str = "winansi"
    show: str = "each"
    structure: str = "flat"

    @staticmethod
    def of(doc_id: int) -> Style:
        i = abs(doc_id)
        return Style(FILTERS[i % 8], FONTS[i // 2 % 5], SHOWS[i // 3 % 5], STRUCTURES[i // 5 % 4])


# -- strings and fonts


def _codes(text: str, font: str) -> bytes:
    """The text in the font's codes."""
    if font == "composite":
        return b"".join((ord(c) + 0x100 & 0xFFFF).to_bytes(2) for c in text)
    if font == "macroman":
        return text.encode("mac_roman", "replace")
    raw = text.encode("cp1252", "replace")
    if font == "differences":
        return b"".join(bytes([_MOVED_TEXT[c]]) if c in _MOVED_TEXT else c.encode("cp1252", "replace") for c in text)
    if font == "to-unicode":
        return bytes((b + 1) & 0xFF for b in raw)
    return raw


def _string(raw: bytes, hexadecimal: bool) -> bytes:
    if hexadecimal:
        return b"<" + raw.hex(" ").encode() + b">"
    out = bytearray(b"(")
    for b in raw:
        if b in b"\\()":
            out += b"\\" + bytes([b])
        elif b < 0x20 or b >= 0x7F:
            out += b"\\%03o" % b
        else:
            out.append(b)
    return bytes(out + b")")


def _font_entries(font: str, to_unicode: int) -> bytes:
    if font == "composite":
        return b"<< /Type /Font /Subtype /Type0 /BaseFont /Sample /Encoding /Identity-H /ToUnicode %d 0 R >>" % to_unicode
    if font == "to-unicode":
        return b"<< /Type /Font /Subtype /Type1 /BaseFont /Sample /ToUnicode %d 0 R >>" % to_unicode
    if font == "differences":
        listed = b" ".join(b"%d /%s" % (c, n.encode()) for c, n in _MOVED.items())
        return b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [%s] >> >>" % listed
    return b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /%s >>" % {"macroman": b"MacRomanEncoding"}.get(font, b"WinAnsiEncoding")


def _cmap(font: str) -> bytes:
    if font == "composite":
        return b"1 beginbfrange\n<0120> <017E> <0020>\n<01A0> <01FF> <00A0>\nendbfrange"
    chars = {(b + 1) & 0xFF: bytes([b]).decode("cp1252", "replace") for b in range(0x20, 0x100)}
    pairs = b"\n".join(b"<%02X> <%s>" % (c, t.encode("utf-16-be").hex().encode()) for c, t in chars.items() if c % 3)
    lists = b"\n".join(b"<%02X> <%02X> [<%s>]" % (c, c, t.encode("utf-16-be").hex().encode()) for c, t in chars.items() if c % 3 == 0)
    return b"beginbfchar\n%s\nendbfchar\nbeginbfrange\n%s\nendbfrange" % (pairs, lists)


# -- streams


def _png(data: bytes, columns: int) -> bytes:
    """Rows with the five row filters in turn."""
    rows = [data[i : i + columns] for i in range(0, len(data), columns)]
    out, above = bytearray(), bytes(columns)
    for i, row in enumerate(rows):
        tag = i % 5
        out.append(tag)
        for k, x in enumerate(row):
            a, b, c = (row[k - 1] if k else 0), above[k], (above[k - 1] if k else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, nearest)[tag]) & 0xFF)
        above = row
    return bytes(out)


def _tiff(data: bytes, columns: int) -> bytes:
    return b"".join(bytes((x - (row[k - 1] if k else 0)) & 0xFF for k, x in enumerate(row)) for row in (data[i : i + columns] for i in range(0, len(data), columns)))


def _stream(data: bytes, how: str, more: bytes = b"", length: int | None = None) -> bytes:
    columns = 32
    padded = data + b"\n" * (-len(data) % columns)
    entries = b""
    if how == "flate":
        data, entries = zlib.compress(data), b"/Filter /FlateDecode"
    elif how == "ascii85":
        data, entries = base64.a85encode(data) + b"~>", b"/Filter [/ASCII85Decode]"
    elif how == "hex":
        data, entries = data.hex().encode() + b">", b"/Filter /AHx"
    elif how == "ascii85 flate":
        data, entries = b"<~" + base64.a85encode(zlib.compress(data)) + b"~>", b"/Filter [/A85 /Fl]"
    elif how == "hex flate":
        data, entries = zlib.compress(data).hex().encode() + b">", b"/Filter [/ASCIIHexDecode /FlateDecode]"
    elif how == "png":
        data, entries = zlib.compress(_png(padded, columns)), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns %d >>" % columns
    elif how == "tiff":
        data, entries = zlib.compress(_tiff(padded, columns)), b"/Filter [/FlateDecode] /DP [<< /Predictor 2 /Columns %d >>]" % columns
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (entries, more, len(data) if length is None else length, data)


# -- content

Cell = tuple[float, float, float, str]


def _number(x: float) -> bytes:
    """All digits of a position, however far down a page, and no exponent, which PDF does not have."""
    return f"{x:.6f}".rstrip("0").rstrip(".").encode()


def _shown(lines: list[Cell], style: Style) -> bytes:
    """Operators that show lines at (x, y, size), each LEADING under the one before."""
    hexadecimal = style.font == "composite" or style.structure == "bare"
    text = lambda t: _string(_codes(t, style.font), hexadecimal)
    x, y, size, first = lines[0]
    rest = [t for *_, t in lines[1:]]
    if style.show == "next-line":
        return b"BT /F1 %g Tf %g TL 1 0 0 1 %s %s Tm %s Tj\n%sET" % (size, LEADING, _number(x), _number(y), text(first), b"".join(b"T* %s Tj\n" % text(t) for t in rest))
    if style.show == "quote":
        shown = b"".join(b"%s '\n" % text(t) if i % 2 == 0 else b"0 0 %s \"\n" % text(t) for i, t in enumerate([first, *rest]))
        return b"q 1 0 0 1 %s %s cm BT /F1 %g Tf %g TL 0 %g Td\n%sET Q" % (_number(x), _number(y), size, LEADING, LEADING, shown)
    if style.show == "scaled":
        shown = b"".join(b"0 %g TD %s Tj\n" % (-LEADING / 2, text(t)) for t in rest)
        return b"q 2 0 0 2 0 0 cm 0.5 Tc 1 Tw BT /F1 %g Tf %s %s Td %s Tj\n%sET 0 Tc 0 Tw Q" % (size / 2, _number(x / 2), _number(y / 2), text(first), shown)
    if style.show == "array":
        words = lambda t: b"[%s] TJ" % b" -250 ".join(text(w) if i % 2 else text(w[:1]) + b" -100 " + text(w[1:]) for i, w in enumerate(t.split(" ")))
        image = b"BI /W 1 /H 1 /BPC 8 /CS /G ID \x01(EI\n"
        return image + b"\n".join(b"BT /F1 %g Tf %s %s Td %s ET" % (size, _number(x), _number(y - LEADING * i), words(t)) for i, t in enumerate([first, *rest]))
    return b"\n".join(b"BT /F1 %g Tf %s %s Td %s Tj ET" % (size, _number(x), _number(y - LEADING * i), text(t)) for i, t in enumerate([first, *rest]))


def pdf_file(pages: list[list[list[Cell]]], style: Style = Style()) -> bytes:  # noqa: B008
    """A PDF of pages; a page is a list of groups of lines."""
    if style.font == "macroman" and any(c.encode("mac_roman", "ignore") == b"" for p in pages for g in p for *_, t in g for c in t):
        style = Style(style.filter, "winansi", style.show, style.structure)
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    cmap = add(_stream(_cmap(style.font), "flate")) if style.font in ("to-unicode", "composite") else 0
    font = add(_font_entries(style.font, cmap))
    fonts = b"/Resources << /Font << /F1 %d 0 R >> >>" % font
    top = add(b"")
    inner = add(b"") if style.structure == "nested" else top
    kids = []
    for groups in pages:
        parts = [_shown(g, style) for g in groups]
        half = len(parts) // 2 if style.structure == "nested" else len(parts)
        streams = [add(_stream(b"\n".join(p), style.filter, length=7 if style.structure == "bare" else None)) for p in (parts[:half], parts[half:]) if p or p is parts]
        contents = b"[%s]" % b" ".join(b"%d 0 R" % s for s in streams) if len(streams) != 1 else b"%d 0 R" % streams[0]
        name = b"/Con#74ents" if style.structure == "xref-stream" else b"/Contents"
        kids.append(add(b"<< /Type /Page /Parent %d 0 R %s %s %s >>" % (inner, name, contents, fonts if style.structure == "bare" else b"")))
    refs = b" ".join(b"%d 0 R" % k for k in kids)
    if style.structure == "nested":
        objects[top - 1] = b"<< /Type /Pages /Kids [%d 0 R %d 0 R] /Count %d >>" % (inner, top, len(kids))  # a cycle is met once
        objects[inner - 1] = b"<< /Type /Pages /Parent %d 0 R /Kids [%s] %s >> %% pages" % (top, refs, fonts)
    elif style.structure != "bare":
        objects[top - 1] = b"<< /Type /Pages /Kids [%s] /Count %d %s >>" % (refs, len(kids), fonts)
    else:
        objects[top - 1] = b"null"
    root = add(b"<< /Type /Catalog %s >>" % (b"" if style.structure == "bare" else b"/Pages %d 0 R" % top))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    head = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"
    if style.structure == "nested":
        head = b"junk before the file\n" + head
    if style.structure == "xref-stream":
        older = b"%d 0 obj\n(an older version)\nendobj\n" % root
        return head + older + body + b"%d 0 obj\n%s\nendobj\n%%%%EOF\n" % (root + 1, _stream(b"\0", "flate", b"/Type /XRef /Root %d 0 R" % root))
    if style.structure == "bare":
        return head + body
    return head + body + b"trailer\n<< /Root %d 0 R /Size %d >>\n%%%%EOF\n" % (root, len(objects) + 1)


def _lines(text: str, heading: bool) -> list[str]:
    """The text's words in lines; a heading is one line."""
    words = text.split()
    return [" ".join(words)] if heading else [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]


def page_pdfs(blocks: DataFrame, styled: bool = True) -> DataFrame:
    """(doc_id, content): a file for each document, headings in 18 points, paragraphs in lines of 10."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for doc_id, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist(), strict=True):
                pages = []
                for i in range(0, len(parts), PER_PAGE):
                    y, groups = 2000, []
                    for p in parts[i : i + PER_PAGE]:
                        lines = _lines(p["text"] or "", p["is_heading"])
                        if lines:
                            groups.append([(72, y - LEADING * k, 18 if p["is_heading"] else 10, t) for k, t in enumerate(lines)])
                        y -= LEADING * len(lines) + 40
                    pages.append(groups)
                files.append(pdf_file(pages, Style.of(doc_id) if styled else Style()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    grouped = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "text", "is_heading"))).alias("parts"))
    return grouped.mapInArrow(write, "doc_id long, content binary")


#: left edges of a table's columns, and how far apart rows are
COLUMNS, ROW_STEP = (72, 190, 330), 15


def table_pdfs(rows: DataFrame) -> DataFrame:
    """(doc_id, content): a file for each doc_id with one table of its rows (doc_id, key, cells) in order of key, under a line of text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for doc_id, own in zip(b.column("doc_id").to_pylist(), b.column("own").to_pylist(), strict=True):
                groups = [[(72, 20000, 10, f"Listing {doc_id}")]]
                for k, r in enumerate(own):
                    # edges wander less than the tolerance of a column
                    groups += [[(x + r["key"] % 3 * 1.5, 19900 - ROW_STEP * k, 10, c)] for x, c in zip(COLUMNS, r["cells"], strict=True) if c]
                files.append(pdf_file([groups], Style.of(doc_id)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "cells"))).alias("own"))
    return grouped.mapInArrow(write, "doc_id long, content binary")
