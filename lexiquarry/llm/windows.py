"""Substring dedup by word windows: count-min prefilter, exact second pass.

A word window can only be repeated as often as its trigger (see :mod:`lexiquarry.llm.anchors`). Partitions count the triggers of
their windows in sketches, ``DEPTH`` rows of a width that follows the corpus's size, of which only the cells that occur are held; adding the partitions' sketches
cell by cell gives counts that are never below a window's own. The second pass groups exactly, by 128 bits of phrase and window hashes,
only those windows all of whose cells count at least two. The sketch stays a table: it is joined, not broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import anchors, repeats
from lexiquarry.llm.common import batches, record, table
from lexiquarry.session import materialise

WINDOW = 35
GRAM = 18
DEPTH = 2


def width(rows: DataFrame) -> int:
    """Bits of a sketch's width: at least a cell for every eight bytes of text, so that some seven cells in eight stay free (a trigger stands for about fifty bytes)."""
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(16, (size // 8).bit_length())


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch (the key's low and high bits), with the row's number above it."""
    return [keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits) | np.uint64(1 << bits)]


def _cell(row: int, bits: int):
    """:func:`cells` in Spark's arithmetic, for one row of the sketch."""
    return F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) if row == 0 else F.shiftrightunsigned("key", 64 - bits).bitwiseOR(F.lit(1 << bits))


def sketch(rows: DataFrame, kind: repeats.Kind, bits: int) -> DataFrame:
    """``cell`` of all partitions' sketches added up, those that count at least two.

    A count is never below a trigger's own. With w = 2**bits cells in a row and n triggers it is over it by e n / w or more with a
    probability of at most exp(-DEPTH); a trigger that occurs once passes for a repeated one with (n / w)**DEPTH, about.
    """
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(source):
        for batch in batches(source, rows=4096, size=32 << 20):
            texts = repeats._bytes(batch.column(0))
            keys = [anchors.runs(*kind.units(texts[i : i + 256]), kind.window, kind.gram, digests=False).key for i in range(0, len(texts), 256)]
            got, n = np.unique(np.concatenate(cells(np.concatenate(keys), bits)), return_counts=True)
            yield record(schema, got.view(np.int64), n)

    return rows.select("t").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell")


def _content(texts, owner, start, count, window):
    """The windows' hashes, eight bytes each."""
    units, lens = anchors.word_units(texts)
    at = anchors.spread(start + (np.cumsum(lens) - lens)[owner], count)
    data = anchors.Rolling(units, 1).of(at, at + window).astype("<u8").tobytes()
    ends = np.cumsum(count) * 8
    return [data[e - 8 * c : e] for e, c in zip(ends.tolist(), count.tolist())]


def _compare(content, key, count, window):
    hashes = np.frombuffer(b"".join(content.to_pylist()), "<u8")
    pair = np.stack([np.repeat(key.view(np.uint64), count), hashes], 1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = (np.diff(pair[order], axis=0) != 0).any(1)
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(new)])
    return group


WORDS = repeats.Kind(WINDOW, GRAM, anchors.word_units, _content, _compare)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: repeats.Kind = WORDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row: ``kept`` is the text without words of repeated windows, joined by one space.

    All occurrences go, also within one document and in repeated rows. Null texts have no words; texts shorter than a window lose none;
    ids may be null or repeat; no rows give no rows; other columns are ignored.
    """
    rows = repeats.identified(docs, id_col, text_col)
    bits = width(rows)
    many = materialise(sketch(rows, kind, bits), "cells")

    def repeated(found: DataFrame) -> DataFrame:
        names = found.columns
        for row in range(DEPTH):
            found = found.withColumn("_c", _cell(row, bits)).join(many.select(F.col("cell").alias("_m")), F.col("_c") == F.col("_m"), "left_semi").select(names)
        return found

    gone = repeats.removals(rows, repeated, kind, by_count=True)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(source):
        for batch in batches(source):
            ids, texts, starts, masks = (c.to_pylist() for c in batch.columns)
            n, lost, kept = [], [], []
            for t, s, m in zip(texts, starts, masks):
                words = (t or b"").split()
                if s:
                    out = anchors.covered(len(words), np.array(s, np.int64), np.array(m, np.int64), kind.window)
                    left = [w for w, o in zip(words, out.tolist()) if not o]
                else:
                    left = words
                n.append(len(words))
                lost.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield record(schema, ids, n, lost, kept)

    return gone.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_windows": query}
ORACLES = {
    "op2_substring_windows": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')))) AS h FROM d WHERE len(w) >= {WINDOW}),
hit AS (SELECT r, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)""",
}
