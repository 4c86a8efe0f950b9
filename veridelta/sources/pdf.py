"""PDF files as tables of blocks.

binaryFile finds and reads the files, so any store that Spark knows will do; files are spread
over partitions by size and parsed by the workers, one at a time.  A file that can't be read
gives one row with its error and ends nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.operators.layout import Block, anchors, build_blocks, rows_of, tolerance_of
from veridelta.sources.pdf_syntax import Document, PdfError
from veridelta.sources.pdf_text import page_runs

BLOCKS = "doc_id string, block_ord int, page int, text string, is_heading boolean, x double, y double, size double, lines array<struct<y:double,x0:double,size:double,text:string>>, `table` array<array<string>>, error string"
_LINE = pa.struct([("y", pa.float64()), ("x0", pa.float64()), ("size", pa.float64()), ("text", pa.string())])
_TYPES = {"doc_id": pa.string(), "block_ord": pa.int32(), "page": pa.int32(), "text": pa.string(), "is_heading": pa.bool_(), "x": pa.float64(), "y": pa.float64(), "size": pa.float64(), "lines": pa.list_(_LINE), "table": pa.list_(pa.list_(pa.string())), "error": pa.string()}


def extract_blocks(content: bytes) -> list[Block]:
    """S3: blocks of all pages in order; pages are numbered from 1, one that fails is left out."""
    doc = Document(content)
    out: list[Block] = []
    for number, page in enumerate(doc.pages(), 1):
        try:
            out += build_blocks(page_runs(page, doc), number)
        except Exception:  # noqa: BLE001, S112
            continue
    return out


def _rows(doc_id: str, content: bytes) -> list[dict]:
    try:
        blocks = extract_blocks(content)
    except (PdfError, RecursionError, MemoryError) as e:
        return [{"doc_id": doc_id, "error": str(e)}]
    return [{"doc_id": doc_id, "block_ord": i, "page": b.page, "text": b.text, "is_heading": b.is_heading, "x": b.x, "y": b.y, "size": b.size, "lines": [vars(x) for x in b.lines], "table": b.table} for i, b in enumerate(blocks)]


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Blocks of each file (doc_id, content); rows with an error hold nothing else."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content in zip(b.column("doc_id"), b.column("content"), strict=True):
                rows = _rows(doc_id.as_py(), content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _TYPES.items()], names=list(_TYPES))

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(parse, BLOCKS)


def column_anchors(files: DataFrame) -> DataFrame:
    """(doc_id, page, anchor) of the columns that left edges on each page make; unreadable files have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int, float]] = []
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    doc = Document(content or b"")
                    pages = [rows_of(page_runs(p, doc)) for p in doc.pages()]
                except (PdfError, RecursionError, MemoryError):
                    continue
                out += [(doc_id, n, a) for n, rows in enumerate(pages, 1) if rows for a in anchors(rows, tolerance_of(rows))]
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "page", "anchor"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(find, "doc_id string, page int, anchor double")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the PDF files under a path or pattern; doc_id is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return pdf_blocks(files.select(F.col("path").alias("doc_id"), "content"))
