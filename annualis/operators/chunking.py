"""Token-window chunking (TXT-5/6) and global chunk numbering (TXT-7).

Chunking is a per-row generator (``posexplode`` of window starts): documents are
spread over tasks by the scan, so a 20,000-word filing costs one task a few ms and no
shuffle.  Global numbering needs each document's chunk count summed over the documents before
it, in catalog order (:func:`annualis.operators.prefix.prefix_sums`): only positions and counts
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators.prefix import prefix_sums


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP,
                    keep: list[str] | None = None) -> DataFrame:
    """One row per window: (id, chunk_no, n_tokens, text).  Empty text -> no chunk."""
    keep = keep or []
    toks = docs.select(id_col, *keep, TX.word_pieces(text_col).alias("_toks"))
    # a row takes its own window along, not all tokens of its document
    windows = F.transform(TX.window_starts(F.size("_toks"), size, overlap), lambda s: F.slice("_toks", s + 1, size))
    win = F.col("_win")
    return toks.select(id_col, *keep, F.posexplode(windows).alias("chunk_no", "_win")).select(
        id_col, *keep, F.col("chunk_no").cast("int").alias("chunk_no"),
        F.size(win).alias("n_tokens"),
        TX.detokenize(win).alias("text"),
    )


def document_offsets(docs: DataFrame, text_col: str = "text", order: list[str] | None = None,
                     size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """(order columns, kept columns, n_chunks, offset): the number of windows of all documents before
    each one in the order of ``order`` (default ``doc_id``): a catalog's position, a file and line,
    any orderable columns that tell the documents apart.  Only these narrow rows are shuffled."""
    order = order or ["doc_id"]
    n = F.size(TX.window_starts(F.size(TX.word_pieces(text_col)), size, overlap))
    counts = docs.select(*order, *[c for c in (keep or []) if c not in order], n.cast("long").alias("n_chunks"))
    return prefix_sums(counts, order, {"offset": "n_chunks"})


def chunk_ids(docs: DataFrame, text_col: str = "text", order: list[str] | None = None, keep: list[str] | None = None,
              out_col: str = "chunk_id", **window) -> DataFrame:
    """TXT-7 without the texts: (order and kept columns, chunk_no, ``out_col``) of every window."""
    order = order or ["doc_id"]
    offs = document_offsets(docs, text_col, order, keep=keep, **window).where("n_chunks > 0")
    rows = offs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("_no"))
    return rows.select(*dict.fromkeys([*order, *(keep or [])]), F.col("_no").cast("int").alias("chunk_no"),
                       (F.col("offset") + F.col("_no")).alias(out_col))


def chunk_and_number(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP, keep: list[str] | None = None,
                     out_col: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """TXT-5/6/7: the windows of every document with ids that run on over the documents in the
    order of ``order`` (default the id; must not be null and tell the documents apart)."""
    order = order or [id_col]
    wanted = list(dict.fromkeys([id_col, *(keep or [])]))
    offs = document_offsets(docs, text_col, order, size, overlap).where("n_chunks > 0").select(*order, "offset")
    chunks = chunk_documents(docs.join(offs, order), id_col, text_col, size, overlap, keep=list(dict.fromkeys([*(keep or []), "offset"])))
    return chunks.select(*wanted, "chunk_no", (F.col("offset") + F.col("chunk_no")).alias(out_col), "n_tokens", "text")


def number_chunks(chunks: DataFrame, id_col: str = "doc_id", pos_col: str = "chunk_no",
                  out_col: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """TXT-7: global chunk id = chunks of all earlier documents + position in the document, for
    chunks that are there already."""
    order = order or [id_col]
    counts = chunks.groupBy(*dict.fromkeys([*order, id_col])).agg(F.count(F.lit(1)).alias("_n"))
    offs = prefix_sums(counts, order, {"offset": "_n"}).select(id_col, "offset")
    return chunks.join(offs, id_col, "inner").withColumn(out_col, F.col("offset") + F.col(pos_col)).drop("offset")
