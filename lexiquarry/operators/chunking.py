"""Documents to overlapping chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions.text import strip, without_masthead

SIZE = 1200
OVERLAP = 150
BLANK_LINE = r"\n(?U:\s*)\n"


def packed(paragraphs: list[str], size: int, overlap: int) -> tuple[list[str], str]:
    """Finished chunks and what is left, in time linear to the text: a paragraph is looked at once, and a buffer is joined once.

    Paragraphs gather in a buffer up to ``size`` characters; a full one ends a chunk, and its tail opens the next. A longer paragraph is sliced, its last slice stays.
    """
    stride = size - overlap
    done, buffer, length = [], [], 0  # the buffer's pieces, to be joined by blank lines
    for p in paragraphs:
        at = 0
        if len(p) > size:
            if length:
                done.append("\n\n".join(buffer))
                buffer, length = [], 0
            while len(p) - at > size:
                done.append(p[at : at + size])
                at += stride
        rest = p[at:]
        if length and length + len(rest) + 2 > size:
            whole = "\n\n".join(buffer)
            done.append(whole)
            buffer = [f"{whole[-overlap:]}\n{rest}" if overlap else rest]
            length = len(buffer[0])
        else:
            length += len(rest) + (2 if length else 0)
            buffer.append(rest)
    return done, "\n\n".join(buffer)


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP, separator: str = BLANK_LINE) -> Column:
    """An array of chunks: paragraphs packed up to ``size`` characters; longer ones sliced; a chunk's tail opens the next."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    paragraphs = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")

    @F.arrow_udf("struct<done:array<string>,left:string>")
    def pack(lists: pa.Array) -> pa.Array:
        made = [([], "") if x is None else packed(x.as_py(), size, overlap) for x in lists]
        return pa.StructArray.from_arrays([pa.array([d for d, _ in made], pa.list_(pa.string())), pa.array([r for _, r in made], pa.string())], ["done", "left"])

    return F.transform(F.array(pack(paragraphs)), lambda s: F.concat(s["done"], F.filter(F.array(strip(s["left"])), lambda x: x != "")))[0]


def chunk(docs: DataFrame, id_col: str = "document_number", size: int = SIZE, overlap: int = OVERLAP, separator: str = BLANK_LINE) -> DataFrame:
    """``(chunk_id, doc_id, title, agency, text, position)``; a document without text gives none."""
    have = set(docs.columns)
    agency = F.coalesce(F.try_element_at("agency_names", F.lit(1)), F.lit("?")) if "agency_names" in have else F.lit("?")
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in have else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), title.alias("title"), agency.alias("agency"), F.posexplode(chunks_of(without_masthead("text"), size, overlap, separator)).alias("position", "text"))
    return rows.select(F.concat_ws("#", "doc_id", "position").alias("chunk_id"), "doc_id", "title", "agency", "text", "position")
