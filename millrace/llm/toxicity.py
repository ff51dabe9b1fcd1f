"""Toxicity scores by non-negative positive-unlabelled learning, in numpy.

The classifier is linear over words and word beginnings.  It is trained on texts
confirmed as toxic and on unlabelled texts, with the non-negative risk estimator: the
loss of calling unlabelled text clean, less the share of it that the class prior
puts on toxic texts, and never below zero; where a step would go below, the excess
is undone instead.  Its features are those that toxic texts have more often than chance
explains, given how many were looked at.  Only hashed features of the training sample,
which is of bounded size, reach the driver; all texts are scored where they lie, in one
pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, lower_ascii, materialize, ship, table

#: Documented bounds of the training sample, in distinct texts; README has figures.
MOST_POSITIVE = 2_000
MOST_UNLABELLED = 8_000
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"\w+")
THRESHOLD = 0.7
#: Words whose features or weights one worker remembers.
MEMO = 300_000


def features(word: str) -> list[int]:
    """The hashed features of one word: itself, and its beginnings where it is longer."""
    named = [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]
    return [xxhash.xxh32_intdigest(x) - (1 << 31) for x in named]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def hashed(text: str, memo: dict | None = None) -> np.ndarray:
    """The features of a text's distinct words, sorted; one that several words have is repeated."""
    memo, found = {} if memo is None else memo, []
    for w in distinct_words(text):
        fs = memo.get(w)
        if fs is None:
            fs = memo[w] = features(w)
        found += fs
    if len(memo) > MEMO:
        memo.clear()
    return np.sort(np.array(found, dtype=np.int32))


@dataclass
class Model:
    """Weights of features; a text's logit is the sum over its distinct words, and ``bias``."""

    weights: dict[int, float]
    bias: float
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def score(self, text: str) -> float:
        memo, get, found = self.memo, self.weights.get, [self.bias]
        for w in distinct_words(text):
            x = memo.get(w)
            if x is None:
                x = memo[w] = sum(get(f, 0.0) for f in features(w))
            if x:
                found.append(x)
        if len(memo) > MEMO:
            memo.clear()
        total = math.fsum(found)  # rounded once, so the order of words is no matter
        return 1 / (1 + math.exp(-min(max(total, -700.0), 700.0)))


def _shown(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features, sorted, and how many of ``texts`` have each."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    once = np.concatenate([t[np.diff(t, prepend=t[:1] - 1) != 0] if len(t) else t for t in texts])
    once.sort()
    first = np.flatnonzero(np.diff(once, prepend=once[:1] - 1))
    return once[first], np.diff(np.append(first, len(once)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> list[int]:
    """The features that tell positive texts from unlabelled ones, the most telling first.

    Positive texts have them more often than the unlabelled share of them explains, by
    more standard deviations than the greatest of so many draws is expected to show:
    ``sqrt(2 ln m)`` for m features looked at.
    """
    names, among_pos = _shown(positive)
    if not len(names):
        return []
    others, n = _shown(unlabelled)
    at = np.minimum(np.searchsorted(others, names), max(len(others) - 1, 0))
    among_un = np.where(others[at] == names, n[at], 0) if len(others) else np.zeros(len(names))
    expected = len(positive) * (among_un + 1) / (len(unlabelled) + 2)
    gain = (among_pos - expected) / np.sqrt(expected + 0.5)
    order = np.lexsort([names, -gain])
    return [int(names[i]) for i in order if gain[i] >= math.sqrt(2 * math.log(max(len(names), 2)))]


def marks(names: list[int], positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> list[int]:
    """So many of ``names``, the most telling first, as set positive texts furthest apart.

    That is where the share of positive texts that show any of them is furthest above the
    share of unlabelled ones: an estimate made from who shows them varies least there.
    """
    order = np.argsort(names)
    known, rank = np.array(names, dtype=np.int64)[order], order

    def showing(texts: list[np.ndarray]) -> np.ndarray:
        first = [int(rank[np.searchsorted(known, f)].min()) for t in texts if len(f := t[np.isin(t, known)])]
        return np.cumsum(np.bincount(first, minlength=len(names))) / max(len(texts), 1)

    return names[: int(np.argmax(showing(positive) - showing(unlabelled))) + 1] if names else []


def fit(
    positive: list,
    unlabelled: list,
    prior: float,
    names: list[int] | None = None,
    epochs: int = 300,
    rate: float = 0.1,
    decay: float = 1e-4,
) -> Model:
    """Minimise the non-negative PU risk with the logistic loss.

    ``positive`` and ``unlabelled`` are texts, or their ``hashed`` features; ``prior`` is
    the share of toxic texts among the unlabelled.  ``names`` are the features, by default
    those that are ``telling``.  Nothing bounds how many texts are called toxic.  Without
    positive texts the model is the prior alone, which is kept off 0 and 1 by less than
    one text of the sample.
    """
    positive, unlabelled = ([hashed(t) if isinstance(t, str) else t for t in ts] for ts in (positive, unlabelled))
    n_pos, n_un = len(positive), len(unlabelled)
    least = 1 / (n_pos + n_un + 2)
    prior = min(max(prior, least), 1 - least)
    bias = math.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return Model({}, bias)
    names = telling(positive, unlabelled) if names is None else names
    known = np.sort(np.array(names, dtype=np.int64))
    kept = [t[np.isin(t, known)] for t in (*positive, *unlabelled)]
    row = np.repeat(np.arange(len(kept)), [len(t) for t in kept])
    col = np.searchsorted(known, np.concatenate(kept))
    pos = np.arange(len(kept)) < n_pos
    w, b = np.zeros(len(known)), bias
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, epochs + 1):
        _, gw, gb = risk(w, b, row, col, pos, prior)
        grad = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({int(f): float(x) for f, x in zip(known, w, strict=True)}, float(b))


def risk(
    w: np.ndarray, b: float, row: np.ndarray, col: np.ndarray, pos: np.ndarray, prior: float
) -> tuple[float, np.ndarray, float]:
    """What a step goes down on, and its gradient by ``w`` and ``b``.

    ``row`` and ``col`` list the features of texts, of which ``pos`` are positive.  The
    risk is ``prior`` times the loss of calling positive texts clean, plus the negative
    part: the loss of calling unlabelled texts toxic less ``prior`` times that of the
    positive.  Where the negative part is below zero, it is what goes down, reversed.
    """
    z = np.bincount(row, weights=w[col], minlength=len(pos)) + b
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    soft = np.logaddexp(0, z)  # the loss of calling a text toxic that is clean
    n_pos, n_un = pos.sum(), (~pos).sum()
    negative = soft[~pos].mean() - prior * soft[pos].mean()
    # d/dz of log(1 + e^-z) is p - 1, of log(1 + e^z) is p.
    if negative >= 0:
        value = prior * np.logaddexp(0, -z)[pos].mean() + negative
        g = np.where(pos, -prior / n_pos, p / n_un)
    else:
        value = -negative
        g = np.where(pos, prior * p / n_pos, -p / n_un)
    return float(value), np.bincount(col, weights=g[row], minlength=len(w)), float(g.sum())


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(text_col: str) -> Column:
    """Names a text; letter case A-Z is no matter."""
    return F.xxhash64(lower_ascii(body(text_col)), F.lit(11))


def votes(docs: DataFrame, own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``digest, positive`` of every labelled text: positive where half of its labels are toxic."""
    by_id = own.groupBy("of").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    return (
        docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"))
        .join(by_id, F.col("id") == F.col("of"))
        .groupBy("digest")
        .agg((2 * F.sum("toxic") >= F.sum("n")).alias("positive"))
    )


def toxic_share(docs: DataFrame, voted: DataFrame, names: list[int], text_col: str) -> float | None:
    """The share of toxic texts among all distinct ones, from who shows any of ``names``.

    Labelled texts need not be a fair sample, but toxic ones show such features as often
    among the labelled as anywhere, and so do clean ones.  Hence the share of all texts
    that show them, less that of the clean, over the distance from the clean to the toxic.
    None where the labelled do not tell.
    """
    ship(docs.sparkSession)
    shows = Model(dict.fromkeys(names, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [shows.score(t.as_py()) > 0.5 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.bool_())], names=["digest", "shown"])

    flags = docs.select(digest(text_col).alias("digest"), body(text_col).alias("text")).mapInArrow(
        run, "digest bigint, shown boolean"
    )
    each = flags.groupBy("digest").agg(F.max("shown").cast("double").alias("shown")).join(voted, "digest", "left")
    own = [F.avg(F.when(F.col("positive") == k, F.col("shown"))) for k in (True, False)]
    among_all, among_pos, among_neg = each.agg(F.avg("shown"), *own).first()
    among_neg = among_neg or 0.0
    if among_pos is None or among_pos <= among_neg:
        return None
    return (among_all - among_neg) / (among_pos - among_neg)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
    prior: float | None = None,
) -> Model:
    """Fit on a sample of ``docs``; labels count only where ``held_out`` is false.

    Both samples are of distinct texts, those with the least digest, so copies of a text
    count once, and nothing depends on the layout of the data.  ``prior`` defaults to the
    ``toxic_share`` of all texts by their ``marks``, or the share of toxic texts among the
    labelled where these do not tell.
    """
    own = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("toxic")
    )
    seen = docs.where(~held_out(id_col))
    voted = materialize(votes(seen, own, id_col, text_col), "toxic-votes")
    # Narrow rows only: the texts of the samples are fetched by digest afterwards.
    chosen = voted.where("positive").orderBy("digest").limit(most_positive)
    others = (
        seen.select(digest(text_col).alias("digest"), F.lit(False).alias("positive"))
        .distinct()
        .orderBy("digest")
        .limit(most_unlabelled)
    )
    # Bounded by the two limits, and so small enough to broadcast.
    sample = chosen.unionByName(others).groupBy("digest").agg(
        F.max("positive").alias("positive"), F.min("positive").alias("only")
    )
    sample = sample.select(F.col("digest").alias("of"), "positive", (~F.col("only")).alias("unlabelled"))
    fetched = (
        seen.select(digest(text_col).alias("digest"), lower_ascii(body(text_col)).alias("text"))
        .join(F.broadcast(sample), F.col("digest") == F.col("of"))
        .groupBy("digest", "positive", "unlabelled")
        .agg(F.min("text").alias("text"))
    )
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found = pa.array([hashed(t.as_py(), memo) for t in batch.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["digest", "positive", "unlabelled", "found"])

    # Hashed features, not texts: repeated words of a long text do not travel.
    taken = fetched.mapInArrow(run, "digest bigint, positive boolean, unlabelled boolean, found array<int>").toArrow()
    taken = taken.combine_chunks()
    lists = pa.concat_arrays(taken["found"].chunks) if len(taken) else pa.array([], pa.list_(pa.int32()))
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    chosen_, others_ = (np.array(taken[k], dtype=bool) for k in ("positive", "unlabelled"))
    order = np.argsort(np.array(taken["digest"], dtype=np.int64))
    positive, unlabelled = ([values[ends[i] : ends[i + 1]] for i in order if of[i]] for of in (chosen_, others_))
    names = telling(positive, unlabelled)
    if prior is None and names:
        prior = toxic_share(seen, voted, marks(names, positive, unlabelled), text_col)
    if prior is None:
        prior = voted.agg(F.coalesce(F.avg(F.col("positive").cast("int")), F.lit(0.0))).first()[0]
    return fit(positive, unlabelled, prior, names)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found),
                 pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), body(text_col).alias("text")
    ).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filter_toxic(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``.

    A null or empty text has the model's base score; repeated rows each give a row; a
    null id is scored and not held out; without labels every score is the least prior.
    A repeated id gives its labels to each of its texts, and a text that has several is
    positive where half of them are toxic.  Only texts are looked at when scoring; a very
    long one is scored whole, in time in proportion to it.  An empty table gives no rows.
    """
    return score(docs, train(docs, labels, **columns), **columns)


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
