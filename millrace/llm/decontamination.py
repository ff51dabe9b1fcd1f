"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ``window`` words is represented by the least hash of the k-grams
inside it, and neighbouring windows with the same one are kept as one run.  Equal
windows have equal least hashes, so a document window can only occur in the benchmark
if its least hash is among the benchmark's: that semi-join finds every shared span of
``window`` words, however it lies.  The runs that survive are extended to their whole
windows and joined on the words, so no hash decides a hit.

All of this happens in the row of the document while the benchmark's windows fit a
broadcast of checked size; only what a document has in common with it is shuffled.
Beyond, a bitmap of fixed size clears most runs in place, and what is left is joined
by shuffles that adaptive execution can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, body, lower_ascii, marked, materialize, table

WINDOW = 13
#: Everything that is not part of a word, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of the benchmark's windows, with their items, that are broadcast.
BROADCAST_BYTES = 64 << 20
#: The end of a document's windows: it takes the document's word count along.
LAST = (1 << 63) - 1


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _gram(length: int) -> int:
    """Words in the k-grams of windows of ``length``: a power of two, at most 8."""
    return min(8, 1 << (length.bit_length() - 1))


def _with_minima(words: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``m<length>`` for each length: the least hash of every window of it.

    ``words`` has ``w``, the word array, and ``n``, its size.
    """
    df = words.withColumn("g1", F.expr("transform(w, x -> xxhash64(x))"))
    top = max(_gram(k) for k in lengths)
    k = 1
    while k < top:
        # The last entries reach beyond the text; no window below reads them.
        df = df.withColumn(f"g{2 * k}", F.expr(f"transform(g{k}, (x, i) -> xxhash64(x, get(g{k}, i + {k})))"))
        k *= 2
    for length in lengths:
        g, wide = f"g{_gram(length)}", length - _gram(length) + 1
        others = "".join(f", get({g}, i + {d})" for d in range(1, wide))
        least = f"transform({g}, (x, i) -> least(x{others}))" if others else g
        df = df.withColumn(f"m{length}", F.expr(f"slice({least}, 1, greatest(n - {length - 1}, 0))"))
    return df.drop(*(f"g{1 << i}" for i in range(4)))


def _with_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``runs``: for each length, its windows in runs of one least hash.

    A run is ``least``, ``start`` and ``stop`` (positions of its windows) and ``len``.  The
    last entry, of hash ``LAST``, stands for the document itself.
    """
    for k in lengths:
        fresh = f"filter(transform(m{k}, (x, i) -> if(i > 0 and x = get(m{k}, i - 1), null, i)), x -> x is not null)"
        df = df.withColumn(f"s{k}", F.expr(fresh))
    parts = [
        f"transform(s{k}, (x, j) -> named_struct('least', get(m{k}, x), 'start', x, "
        f"'stop', coalesce(get(s{k}, j + 1), size(m{k})), 'len', {k}))"
        for k in lengths
    ]
    parts.append(f"array(named_struct('least', {LAST}L, 'start', 0, 'stop', 1, 'len', 0))")
    return df.withColumn("runs", F.expr(f"concat({', '.join(parts)})"))


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``least, gram, items`` of every distinct window of the benchmark."""
    words = items.select(F.col(item_col).cast("string").alias("item"), word_array(body(text_col)).alias("w"))
    words = words.withColumn("n", F.size("w")).where("n > 0")
    # An inner explode would push a filter on its array down through all the steps that
    # make it, and compute each of them inside the lambda of the next.  No array is empty.
    out = []
    for length in range(1, window + 1):
        own = words.where(F.col("n") == length if length < window else F.col("n") >= window)
        rows = _with_minima(own, [length]).select("item", "w", F.posexplode_outer(f"m{length}").alias("p", "least"))
        out.append(
            rows.select("item", "least", F.concat_ws(" ", F.slice("w", F.col("p") + 1, length)).alias("gram"),
                        F.lit(length).alias("len"))
        )
    every = reduce(DataFrame.unionByName, out)
    # Sorted, so that equal sets are equal arrays, which a document then holds once.
    return every.groupBy("least", "gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """What each document has in common with the benchmark.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for
    each row of ``docs``.  A window is ``window`` consecutive words of an item; an item
    of fewer words, but not none, is one window.  A document word inside any
    occurrence of a window is hit; a document is contaminated when words are hit and
    ``share`` times as many as it has are no fewer than it has.  A null or empty text
    has no words; a very long one is one row all the same, taken whole in time in
    proportion to its words.  Repeated rows each give a row and a null id is a value like
    any other.  An item without an id hits, but is not listed.  An empty benchmark hits
    nothing, an empty ``docs`` gives no rows; other columns are ignored.
    """
    bench = materialize(benchmark_windows(benchmark, window, item_col, item_text_col), "benchmark-windows")
    wide = F.octet_length("gram") + 40 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    found = bench.groupBy("len").agg(F.sum(wide).alias("bytes")).collect()  # ``window`` rows at most
    lengths = sorted({window, *(r["len"] for r in found)}, reverse=True)
    small = sum(r["bytes"] for r in found) <= broadcast_bytes

    words = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        word_array(body(text_col)).alias("w"),
    ).withColumn("n", F.size("w"))
    entries = (
        _with_runs(_with_minima(words, lengths), lengths)
        .select("rid", "doc_id", "w", "n", F.explode_outer("runs").alias("run"))
        .select("rid", "doc_id", "w", "n", "run.*")
    )
    least = bench.select("least").unionByName(docs.sparkSession.range(1).select(F.lit(LAST).alias("least"))).distinct()
    if small:
        near = entries.join(F.broadcast(least), "least", "left_semi")
    else:
        near = marked(
            entries.withColumn("hash_", F.xxhash64("least")), bitmap(least.select(F.xxhash64("least").alias("hash_")))
        ).where("maybe_")
    near = near.select(
        "rid", "doc_id", "n", "len", "least",
        (F.col("least") == LAST).alias("last"),
        "w",
        F.explode(F.expr("sequence(start, stop - 1)")).alias("start"),
    ).select(
        "rid", "doc_id", "n", "len", "least", "last", "start", F.expr("concat_ws(' ', slice(w, start + 1, len))").alias("gram")
    )
    windows = bench.select("least", "gram", "items")
    on = ["least", "gram"]
    hits = near.join(F.broadcast(windows) if small else windows, on, "left").where("last or items is not null")
    spans = F.expr("if(items is null, null, named_struct('start', start, 'stop', start + len))")
    per = hits.groupBy("rid", "doc_id").agg(
        F.max("n").cast("bigint").alias("n_words"),
        F.collect_set(spans).alias("spans"),
        F.collect_set("items").alias("sets"),
    )
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('stop', 0, 'sum', 0L), (a, s) -> named_struct("
        "'stop', greatest(a.stop, s.stop), "
        "'sum', a.sum + greatest(s.stop - greatest(a.stop, s.start), 0)), a -> a.sum)"
    )
    items = F.array_sort(F.array_distinct(F.flatten("sets")))
    return per.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        "rid",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "rid"
    )


def op2_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.p, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
spans AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hit)) GROUP BY 1),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(s.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.list, '')) AS items_sha256,
       coalesce(s.n_hit, 0) > 0 AND 20 * coalesce(s.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN names m ON m.doc_id = d.doc_id
"""
