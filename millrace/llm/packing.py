"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most one sequence.  Only the histogram of piece
lengths, one count for each possible length, reaches the driver.  There a bin is
opened with the longest length left, and a bitset subset-sum over the lengths still
available finds the fullest combination that fits; the combination is repeated as
often as the counts allow and removed.  Each such pattern leaves fewer copies of one
of its lengths than it takes, so the number of patterns follows the number of lengths,
about one to one, and not the number of documents.

Pieces then find their place by their rank among the pieces of equal length: ranks
are numbered in groups by the turn in which a piece was written, so that a length
shared by very many pieces, or by one piece repeated, is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialize, ship, table
from .tokens import WordEncoder

CAPACITY = 4096
#: Pieces that share one numbering task, on average, before more salts are used.
ROWS_PER_SALT = 2_000_000
SALTS = 32

_ENCODERS: dict[str, WordEncoder] = {}


def fullest(lengths: list[tuple[int, int]], room: int) -> list[int]:
    """The lengths (longest first, each with its count) whose sum comes closest to ``room``.

    Bit s of ``reach`` says that some choice among the lengths seen sums to s.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        if length > room:
            continue
        for _ in range(min(count, room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def min_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict]]:
    """Patterns ``(times, {length: copies})`` that use up ``counts``."""
    left = {k: counts[k] for k in sorted(counts, reverse=True) if counts[k] > 0}
    patterns = []
    while left:
        first = next(iter(left))
        rest = [(k, n - (k == first)) for k, n in left.items()]
        pattern = {first: 1}
        for k in fullest(rest, capacity - first):
            pattern[k] = pattern.get(k, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        patterns.append((times, pattern))
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
    return patterns


def recipe(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank.

    Rows (length, first rank, first sequence, copies, offset), sorted by the first two.
    Patterns follow the number of lengths, and each has at most sqrt(2 * capacity) of
    them, which bounds this table whatever the data.
    """
    rows, used, sequence = [], {}, 0
    for times, pattern in min_bin_slack(counts, capacity):
        at = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, copies, at))
            used[length] = used.get(length, 0) + times * copies
            at += length * copies
        sequence += times
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {
        "key": table_[:, 0] << 44 | table_[:, 1],
        "rank": table_[:, 1],
        "sequence": table_[:, 2],
        "copies": table_[:, 3],
        "offset": table_[:, 4],
    }


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, turn`` of every piece, in one pass.

    ``turn`` counts the pieces of one task; it is no name, but spreads repeated rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder, end = _ENCODERS[tokenizer], np.array([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "turn"]
        turn = 0
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for piece, a in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * (a + capacity)]
                    rows.append((k, piece, a, len(part) // 4, zlib.crc32(part)))
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(cols[:, 0])),
                    pa.array(cols[:, 1].astype(np.int32)),
                    *(pa.array(cols[:, j]) for j in (2, 3, 4)),
                    pa.array(np.arange(turn, turn + len(cols))),
                ],
                names=names,
            )
            turn += len(cols)

    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, turn bigint"
    )


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row
    for each piece.  A document is its ids and ``end_id``; a null or empty text is
    ``end_id`` alone.  Only documents longer than a sequence are cut.  Repeated rows
    are packed each for itself, other columns are ignored, an empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    # One row for each length that occurs: at most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = recipe(counts, capacity)
    salts = SALTS + sum(counts.values()) // ROWS_PER_SALT
    keys = ["length", "salt"]
    salted = cut.withColumn("salt", F.pmod("turn", F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32")
    whole = cut.columns[:5]
    ranked = salted.withColumn("in_", F.row_number().over(inside) - 1).join(starts, keys)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(places["key"], length << 44 | rank, side="right") - 1
            local, copies = rank - places["rank"][at], places["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(places["sequence"][at] + local // copies),
                    pa.array(places["offset"][at] + local % copies * length),
                ],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*whole).schema)
    return ranked.select(*whole, (F.col("first") + F.col("in_")).alias("rank")).mapInArrow(
        place, f"{head}, sequence_id bigint, offset bigint"
    )


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
