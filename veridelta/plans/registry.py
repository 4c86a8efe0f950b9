"""Registered queries of the document-comparison engine, each with its DuckDB SQL.

The keys follow the operator inventory: chunks (C), embedding and matching (E, M), judge and
score (J, K), report (R), layout (L), PDF (S, P, F, I).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import text as X
from veridelta.operators import chunk as C
from veridelta.operators import embed as E
from veridelta.operators import judge as J
from veridelta.operators import match as M
from veridelta.operators import report as R
from veridelta.operators import score as S
from veridelta.plans import oracles as O
from veridelta.plans import pdf_samples, samples
from veridelta.plans.compare import CompareConfig, Comparison, candidates, compare
from veridelta.sources import adapters as A
from veridelta.sources.pdf import column_anchors, pdf_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PARAGRAPHS = CompareConfig.of("paragraph")


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["similarity_summary"](spark, sf_dir)


def _document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_blocks(table(spark, sf_dir, "documents"))


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_blocks(table(spark, sf_dir, "pages"))


CHUNK = ("doc_id", "index", "text", "section", "weight")
_CHUNK_SQL = "SELECT doc_id, index, text, section, weight FROM chunks"


@query(f"WITH {O.blocks()}, {O.chunks('paragraph')} {_CHUNK_SQL}")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, K1"""
    return C.chunk(_document_blocks(spark, sf_dir), "paragraph").select(*CHUNK)


@query(f"WITH {O.blocks()}, {O.chunks('sentence')} {_CHUNK_SQL}")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, C6, K1"""
    return C.chunk(_document_blocks(spark, sf_dir), "sentence").select(*CHUNK)


@query(f"WITH {O.blocks('pages')}, {O.chunks('section')} {_CHUNK_SQL}")
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C4"""
    return C.chunk(_page_blocks(spark, sf_dir), "section").select(*CHUNK)


@query(f"WITH {O.blocks('pages')}, {O.chunks('paragraph')} SELECT doc_id, index, section FROM chunks")
def section_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C2"""
    return C.chunk(_page_blocks(spark, sf_dir), "paragraph").select("doc_id", "index", "section")


@query(f"WITH {O.blocks()}, {O.chunks('paragraph', 3)} SELECT doc_id, index, text FROM chunks")
def chunk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of three chunks is the feature."""
    return C.chunk(_document_blocks(spark, sf_dir), "paragraph", max_chunks=3).select("doc_id", "index", "text")


@query(f"SELECT doc_id, {O.weight('text')} AS weight FROM documents")
def word_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1"""
    return table(spark, sf_dir, "documents").select("doc_id", X.word_weight("text").alias("weight"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("granularity"), F.lit(0).alias("index"), "text")


_WHOLE_SQL = "(SELECT doc_id, 'document' AS granularity, 0 AS index, text FROM documents)"


@query(f"WITH {O.features(_WHOLE_SQL)} SELECT doc_id, bucket, v FROM features")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 over whole documents"""
    return E.hash_features(_whole(spark, sf_dir)).select("doc_id", "bucket", "v")


def _paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First-line pairs, and paragraphs of the documents that they name."""
    docs = table(spark, sf_dir, "documents")
    pairs = A.first_line_pairs(docs)
    named = pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b")).distinct()
    return pairs, C.chunk(A.document_blocks(docs.join(named, "doc_id", "left_semi")), "paragraph")


_ROUNDED = "SELECT pair_id, i, j, round(s, 6) AS s FROM {}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "i", "j", F.round("s", 6).alias("s"))


@query(f"WITH {O.TEXT_PAIRS} {_ROUNDED.format('candidates')}")
def cosine_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2 of hashed texts"""
    return _rounded(candidates(*_paired(spark, sf_dir), PARAGRAPHS))


@query(f"WITH {O.TEXT_PAIRS} {_ROUNDED.format('matched')}")
def greedy_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M5"""
    return _rounded(M.greedy_grouped(candidates(*_paired(spark, sf_dir), PARAGRAPHS)))


DENSE_FLOOR = 0.2


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as pairs: even vec_ids are A's chunks, odd ones B's, in order of vec_id."""
    e = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("label") * 2 + F.col("vec_id") % 2)
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("vec_id")) - 1
    chunks = e.select("doc_id", F.lit("vector").alias("granularity"), index.alias("index"), "embedding")
    pairs = e.select(F.col("label").alias("pair_id"), (F.col("label") * 2).alias("doc_a"), (F.col("label") * 2 + 1).alias("doc_b")).distinct()
    return pairs, chunks


_DENSE_SQL = f"""vs AS (SELECT label, vec_id % 2 AS side, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS index, embedding::DOUBLE[] AS e FROM embeddings),
candidates AS (SELECT a.label AS pair_id, 'vector' AS granularity, a.index AS i, b.index AS j, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s
  FROM vs a JOIN vs b ON a.label = b.label AND a.side = 0 AND b.side = 1 WHERE s >= {DENSE_FLOOR})"""


@query(f"WITH {_DENSE_SQL} {_ROUNDED.format('candidates')}")
def cosine_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2 of vectors"""
    return _rounded(M.dense_cosine(*_dense(spark, sf_dir), DENSE_FLOOR))


@query(f"WITH {_DENSE_SQL}, {O.MATCHED} {_ROUNDED.format('matched')}")
def greedy_match_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M5 of vectors"""
    return _rounded(M.greedy_grouped(M.dense_cosine(*_dense(spark, sf_dir), DENSE_FLOOR)))


def _alone(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    pairs, chunks = _paired(spark, sf_dir)
    matched = M.greedy_grouped(candidates(pairs, chunks, PARAGRAPHS))
    return M.unmatched(pairs, chunks, matched)[side].select("pair_id", "index", "text")


@query(f"WITH {O.TEXT_PAIRS}, {O.changes()} SELECT pair_id, n AS index, ta AS text FROM changes WHERE kind = 'deleted'")
def unmatched_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M6"""
    return _alone(spark, sf_dir, 0)


@query(f"WITH {O.TEXT_PAIRS}, {O.changes()} SELECT pair_id, n AS index, tb AS text FROM changes WHERE kind = 'added'")
def unmatched_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M6"""
    return _alone(spark, sf_dir, 1)


@query(f"WITH {O.TEXT_PAIRS} SELECT pair_id, count(*) FILTER (s BETWEEN 0.5 AND 0.99) AS judged_pairs, count(*) AS matched_pairs FROM matched GROUP BY pair_id")
def judge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K6"""
    matched = M.greedy_grouped(candidates(*_paired(spark, sf_dir), PARAGRAPHS))
    return matched.groupBy("pair_id").agg(F.count_if(S.in_band("s", S.BAND)).alias("judged_pairs"), F.count("*").alias("matched_pairs"))


def _verdicts(chunks: DataFrame) -> DataFrame:
    """Literal-like verdicts on texts of a comparison: by length of A's text, with failures."""
    t = chunks.select("text").distinct()
    n = F.length("text")
    a = t.where(n % 3 != 0).select(F.col("text").alias("a_text"), F.lit(1).alias("one"))
    return a.select("a_text", F.when(F.length("a_text") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(0.75)).alias("similarity"), F.lit("by table").alias("explanation"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, chunks = _paired(spark, sf_dir)
    matched = M.greedy_grouped(candidates(pairs, chunks, PARAGRAPHS))
    attached = S.attach(pairs, chunks, matched)
    own = attached.select("a_text", "b_text").distinct().join(_verdicts(chunks), "a_text")
    return S.rescored(attached, J.table_judge(own))


_IN_BAND = "s BETWEEN 0.5 AND 0.99"


@query(
    f"WITH {O.TEXT_PAIRS}, {O.SIDES} SELECT pair_id, i, j, round(CASE WHEN {_IN_BAND} AND length(ta) % 3 = 2 THEN 0.75 WHEN {_IN_BAND} AND length(ta) % 3 = 0 THEN 0.5 ELSE s END, 6) AS similarity,"
    f" CASE WHEN NOT {_IN_BAND} THEN '' WHEN length(ta) % 3 = 0 THEN '?' ELSE 'by table' END AS explanation, {_IN_BAND} AS judged FROM matched JOIN ca USING (pair_id, granularity, i)"
)
def judge_table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed, missing and failed verdicts"""
    return _judged(spark, sf_dir).select("pair_id", "i", "j", F.round("similarity", 6).alias("similarity"), "explanation", "judged")


@query(
    "SELECT id, similarity, explanation FROM (VALUES "
    + ", ".join(f"({i}, {'NULL' if s is None else s}::DOUBLE, {'NULL' if e is None else repr(e)})" for i, (_, s, e) in enumerate(samples.VERDICTS))
    + ") AS v(id, similarity, explanation)"
)
def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 on literal answers"""
    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(samples.VERDICTS)], "id int, raw string")
    return rows.withColumn("v", J.parsed(F.col("raw"))).select("id", "v.similarity", "v.explanation")


def _compared(spark: SparkSession, sf_dir: str) -> Comparison:
    docs = table(spark, sf_dir, "documents")
    return compare(A.first_line_pairs(docs), A.document_blocks(docs), PARAGRAPHS)


@query(f"WITH {O.TEXT_PAIRS}, {O.changes()} SELECT pair_id, kind, count(*) AS n, round(sum(weight), 6) AS weight FROM changes GROUP BY ALL")
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4"""
    return _compared(spark, sf_dir).changes.groupBy("pair_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _summed(c: Comparison) -> DataFrame:
    return c.summary.withColumns({n: F.round(n, 6) for n in ("similarity_pct", "difference_pct")})


@query(f"WITH {O.TEXT_PAIRS}, {O.changes()} {O.summary()}")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6"""
    return _summed(_compared(spark, sf_dir))


_LEVELS = "('section'), ('paragraph'), ('sentence')"


def _all_levels(table_: str, key: str) -> str:
    parts = [f"{g}_chunks AS (WITH {O.blocks(table_)}, {O.chunks(g)} SELECT * FROM chunks)" for g in C.GRANULARITIES]
    every = "chunks AS (" + " UNION ALL ".join(f"SELECT * FROM {g}_chunks" for g in C.GRANULARITIES) + ")"
    return f"WITH {O.neighbours(table_, key)}, {', '.join(parts)}, {every}, {O.features()}, {O.candidates()}, {O.MATCHED}, {O.changes()} {O.summary(_LEVELS)}"


@query(_all_levels("pages", "page_id"))
def similarity_all_granularities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 on neighbouring pages"""
    pages = table(spark, sf_dir, "pages")
    return _summed(compare(A.neighbour_pairs(pages, "page_id"), A.page_blocks(pages)))


@query(_all_levels("conversations", "conv_id"))
def compare_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on neighbouring conversations"""
    talks = table(spark, sf_dir, "conversations")
    return _summed(compare(A.neighbour_pairs(talks, "conv_id"), A.conversation_blocks(talks)))


@query(
    f"""WITH {O.TEXT_PAIRS}, {O.changes()},
real AS (SELECT *, CASE kind WHEN 'changed' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END AS o, weight * (1 - similarity) AS mass FROM changes WHERE kind <> 'same')
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY o, mass DESC, k, n) AS rank, kind, CASE WHEN kind = 'changed' THEN round(similarity, 6) END AS similarity, weight,
  coalesce(nullif(coalesce(sa, sb), ''), 'p1') AS section, {O.trimmed('ta')} AS a, {O.trimmed('tb')} AS b FROM real"""
)
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R3, R7"""
    return _compared(spark, sf_dir).listed().select("pair_id", "rank", "kind", F.round("similarity", 6).alias("similarity"), "weight", "section", "a", "b")


@query(O.reports("text"))
def rendered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report for each pair"""
    return _compared(spark, sf_dir).reports("text")


@query(O.reports("json"))
def rendered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, R8"""
    return _compared(spark, sf_dir).reports("json")


@query(O.reports("md"))
def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9"""
    return _compared(spark, sf_dir).reports("md")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in five listings, one cell now and then empty."""
    s = table(spark, sf_dir, "supplier")
    cells = F.array(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 7 == 3, F.lit("")).otherwise(F.col("s_name")), F.col("s_nationkey").cast("string"))
    return pdf_samples.table_pdfs(s.select((F.col("s_suppkey") % 5).alias("doc_id"), F.col("s_suppkey").alias("key"), cells.alias("cells")))


@query(O.COLUMNS)
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L5 of listings in PDF files"""
    return column_anchors(_tables(spark, sf_dir)).withColumn("anchor", F.round("anchor", 6))


@query(f"WITH {O.LISTINGS} SELECT doc_id, block_ord, n_rows, n_columns, grid FROM listed")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in PDF files, row by row"""
    found = pdf_blocks(_tables(spark, sf_dir)).where("`table` is not null")
    grid = F.array_join(F.transform("table", lambda r: F.array_join(r, "|")), "\n")
    return found.select("doc_id", "block_ord", F.size("table").alias("n_rows"), F.size(F.element_at("table", 1)).alias("n_columns"), grid.alias("grid"))


@query(f"WITH {O.LISTINGS} SELECT doc_id, text, page, false AS is_heading FROM listed")
def flatten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11"""
    return pdf_blocks(_tables(spark, sf_dir)).where("`table` is not null").select("doc_id", "text", "page", "is_heading")


@query(O.pdf_pages())
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S5, P, F, I, L: every page's article, written as a PDF file in a style of its own and read back"""
    return pdf_blocks(pdf_samples.page_pdfs(_page_blocks(spark, sf_dir))).select("doc_id", "block_ord", "page", "text", "is_heading", "error")


@query(O.pdf_pages("doc_id, block_ord, round(x, 6) AS x, round(y, 6) AS y, size, n_lines"))
def pdf_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blocks of the same files stand"""
    found = pdf_blocks(pdf_samples.page_pdfs(_page_blocks(spark, sf_dir)))
    return found.select("doc_id", "block_ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("size", 6).alias("size"), F.size("lines").alias("n_lines"))


@query(
    "SELECT page_id::VARCHAR AS doc_id, CASE page_id % 3 WHEN 0 THEN 'no %PDF- header' WHEN 1 THEN 'no catalog' ELSE 'the file is encrypted' END AS error FROM pages"
)
def pdf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a header, without a catalog, and encrypted ones give one row with an error"""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.expr("repeat(' ', int(page_id) % 3 * 40)"), F.when(F.col("page_id") % 3 == 0, F.lit("no file")).when(F.col("page_id") % 3 == 1, F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Font >>\nendobj\n")).otherwise(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer\n<< /Root 1 0 R /Encrypt 2 0 R >>\n"))).cast("binary").alias("content"))
    return pdf_blocks(files).select("doc_id", "error")
