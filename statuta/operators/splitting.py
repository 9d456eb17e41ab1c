"""Documents into chunks with their metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import first_article

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "；", "！", "？", "，", " ")
_ARTICLE = re.compile(r"(?=第[零一二三四五六七八九十百千万\d]+条)")
_HEADING = re.compile(r"(?m)^(?=\s*(?:[（(]\s*[一二三四五六七八九十]+\s*[）)]|[一二三四五六七八九十]{1,3}\s*[、.．]))")


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces together as far as ``size`` allows; each new chunk starts with the end of the last one."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(p) <= size:
            out[-1] += p
        else:
            out.append((out[-1][-overlap:] if out and overlap else "") + p)
    return out


def _windows(text: str, size: int, overlap: int) -> list[str]:
    last = max(0, -(-(len(text) - size) // (size - overlap)))
    return [text[i * (size - overlap) :][:size] for i in range(last + 1)]


def _pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest separators that do."""
    if len(text) <= size:
        return [text] if text.strip() else []
    for i, sep in enumerate(separators):
        if sep in text.strip():
            parts = [p for p in re.split(f"(?<={re.escape(sep)})", text) if p.strip()]
            if len(parts) > 1:
                return [q for p in parts for q in _pieces(p, size, overlap, separators[i:])]
    return _windows(text, size, overlap)


def chunks_of(text: str, sectioned: bool, size: int = 512, overlap: int = 100) -> list[str]:
    """Chunks of a text: its articles (or numbered headings, unless ``sectioned``), long ones cut further and packed.

    All characters but outer blanks come out. A chunk has at most ``size`` characters, and the
    repeated end of the chunk before it besides.
    """
    text = text.strip()
    sections = [s.strip() for s in _ARTICLE.split(text) if s.strip()]
    if len(sections) < 2 and not sectioned:
        cut = [s.strip() for s in _HEADING.split(text) if s.strip()]
        sections = cut if len(cut) > 2 else sections
    return [c for s in sections for c in ([s] if len(s) <= size else _packed(_pieces(s, size, overlap, SEPARATORS), size, overlap))]


def split_documents(documents: DataFrame, *, size: int = 512, overlap: int = 100) -> DataFrame:
    """(``source``, ``chunk_id``, ``chunk_index``, ``text``, ``article_num``, ``doc_type``) of documents with ``source``, ``text``, ``doc_type``.

    Null and blank texts give no chunks. ``chunk_id`` is the source and the four-digit place.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chunks_of(t or "", k in ("law", "case"), size, overlap) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.list_(pa.string()))], ["source", "doc_type", "chunks"])

    cut = documents.select(F.col("source").cast("string"), "text", F.col("doc_type").cast("string")).mapInArrow(run, "source string, doc_type string, chunks array<string>")
    each = cut.select("source", "doc_type", F.posexplode("chunks").alias("i", "text"))
    return each.select("source", F.format_string("%s_chunk_%04d", "source", "i").alias("chunk_id"), F.col("i").cast("long").alias("chunk_index"), "text", first_article(F.col("text")).alias("article_num"), "doc_type")
