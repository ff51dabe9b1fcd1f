"""SimHash near-duplicate groups by exact comparison of all fingerprints, in tiles.

Fingerprints are sorted into cells by the population counts of their four 16-bit
quarters.  Two fingerprints differ in at least as many bits as the sum of the
differences of these counts, so cells further apart than the radius cannot link.
Consecutive cells form blocks of bounded size; a tile is a pair of blocks whose
counts come within the radius, and is compared with numpy exclusive-or and bit
counts, smaller tiles inside being skipped by the same rule.  What a tile finds
leaves it as a spanning forest, never as all pairs of a group.

Only the histogram of cells, at most 17^4 rows, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, materialize, ship, table
from .components import components

RADIUS = 4
WORDS = 4
QUARTERS = 4
BASE = 17
#: A block has about the distinct fingerprints over this, within the two bounds.
BLOCKS = 128
BLOCK_LEAST, BLOCK_MOST = 4096, 1 << 20
SMALL = 256
#: Blocks that a block is compared with in one group of tiles; it travels once for each group.
ROW_OF_TILES = 8
#: Shingles whose bits are counted at once.
RUN = 65_536


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of one text."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])]  # noqa: B905
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), RUN):
        part = np.array(hashes[a : a + RUN], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, fp``: the SimHash of every text, as a signed 64-bit number."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; a label is the least member seen."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, QUARTERS)).astype(np.int16)


def _sorted(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Fingerprints in the order of their counts, and small tiles with their least and most."""
    q = _quarters(fps)
    order = np.lexsort(q.T[::-1])
    fps, q = fps[order], q[order]
    tiles = [
        (a, min(a + SMALL, len(fps)), q[a : a + SMALL].min(axis=0), q[a : a + SMALL].max(axis=0))
        for a in range(0, len(fps), SMALL)
    ]
    return fps, tiles


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple:
    """A spanning forest of the links in one tile; ``right`` None: within ``left``."""
    own = right is None
    left, tiles = _sorted(left)
    right, others = (left, tiles) if own else _sorted(right)
    both = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    labels = np.arange(len(both))
    low = np.array([t[2] for t in others]).reshape(-1, QUARTERS)
    high = np.array([t[3] for t in others]).reshape(-1, QUARTERS)
    for i, (a, b, least, most) in enumerate(tiles):
        gap = np.maximum(low - most, 0) + np.maximum(least - high, 0)
        near = np.flatnonzero(gap.sum(axis=1) <= radius)
        if own:
            near = near[near >= i]
        part = left[a:b, None]
        for first in range(0, len(near), 16):
            cols = np.concatenate([np.arange(others[j][0], others[j][1]) for j in near[first : first + 16]])
            hit = np.bitwise_count(part ^ right[cols]) <= radius
            x, y = np.nonzero(hit)
            if len(x):
                _merge(labels, x + a, cols[y] + shift)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return both[moved].view(np.int64), both[labels[moved]].view(np.int64)


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``radius`` of each other.

    ``distinct`` has one row for each fingerprint ``fp``.
    """
    spark = distinct.sparkSession
    ship(spark)
    count = [f"bit_count(shiftright(fp, {16 * i}) & 65535)" for i in range(QUARTERS)]
    cell = F.expr(" + ".join(f"{c} * {BASE ** (QUARTERS - 1 - i)}" for i, c in enumerate(count)))
    celled = distinct.select("fp", cell.cast("int").alias("cell"))
    # At most 17^4 rows, whatever the input.
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    total = int(cells["n"].sum()) if len(cells) else 0
    size = min(max(total // BLOCKS, BLOCK_LEAST), BLOCK_MOST)
    rows, boxes, filled = [], [], size
    for c, n in zip(cells["cell"], cells["n"], strict=True):
        q = np.array([c // BASE ** (QUARTERS - 1 - i) % BASE for i in range(QUARTERS)])
        parts = -(-int(n) // size)
        if parts > 1 or filled + n > size:
            rows.append((int(c), len(boxes), parts))
            boxes += [[q, q] for _ in range(parts)]
            filled = size if parts > 1 else int(n)
        else:
            boxes[-1] = [np.minimum(boxes[-1][0], q), np.maximum(boxes[-1][1], q)]
            rows.append((int(c), len(boxes) - 1, 1))
            filled += int(n)
    low = np.array([b[0] for b in boxes]).reshape(-1, QUARTERS)
    high = np.array([b[1] for b in boxes]).reshape(-1, QUARTERS)
    tiles = []
    for i in range(len(boxes)):
        gap = np.maximum(low[i:] - high[i], 0) + np.maximum(low[i] - high[i:], 0)
        j = np.flatnonzero(gap.sum(axis=1) <= radius) + i
        tiles.append(np.stack([np.full(len(j), i), j], axis=1))
    pairs = np.concatenate(tiles) if tiles else np.zeros((0, 2), dtype=np.int64)

    places = spark.createDataFrame(rows, "of int, first int, parts int")
    blocks = materialize(
        celled.join(F.broadcast(places), F.col("cell") == F.col("of"))
        .groupBy((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("block"))
        .agg(F.collect_list("fp").alias("fps")),
        "simhash-blocks",
    )
    # A row of tiles is dealt in groups: each begins with its own block, and the others follow.
    groups, start = [], 0
    for i, n in enumerate(np.bincount(pairs[:, 0], minlength=len(boxes)) if len(boxes) else []):
        others = pairs[start : start + n, 1]
        start += n
        for c in range(0, n, ROW_OF_TILES):
            group = others[c : c + ROW_OF_TILES]
            head = np.array([[i, len(groups), -1]])
            rest = np.stack([group, np.full(len(group), len(groups)), group], axis=1)
            groups.append(np.concatenate([head, rest]))
    dealt = np.concatenate(groups) if groups else np.zeros((0, 3), dtype=np.int64)
    schema = T.StructType([T.StructField(k, T.IntegerType()) for k in ("block", "row", "j")])
    listed = spark.createDataFrame(pd.DataFrame(dealt.astype(np.int32), columns=["block", "row", "j"]), schema)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(groups), 100_000))
    work = (
        listed.join(blocks, "block")
        .select("row", "block", "j", "fps")
        .repartition(tasks, "row")
        .sortWithinPartitions("row", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left = None, None
        for batch in batches:
            for block, j, fps in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
                found = np.asarray(fps.values).view(np.uint64)
                if j.as_py() < 0:
                    own, left = block.as_py(), found.copy()
                    continue
                a, b = compare(left, None if block.as_py() == own else found, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work.mapInArrow(run, "a bigint, b bigint")


def near_groups(
    docs: DataFrame,
    radius: int = RADIUS,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Words are runs of non-space characters after lower-casing A-Z; shingles are
    ``words`` of them, a shorter text is one shingle, and a text without words (or
    null) has fingerprint zero and is linked like any other.  Fingerprints link when
    they differ in ``radius`` bits at most; ``component_id`` is the smallest id
    reachable.  Repeated rows each give a row; a null id has its fingerprint's
    component; other columns are ignored; an empty table gives no rows.  A text of any
    length is hashed whole, in time and memory in proportion to it.
    """
    fps = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    # Written out, so that a very large component or a very common fingerprint can be split
    # in the joins: their sides must not come dealt by the key already.
    rooted = materialize(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    groups = materialize(rooted.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
