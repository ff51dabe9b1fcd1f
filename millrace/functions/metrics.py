"""Counters and distributions.

Over columns they are observations, computed by the query itself while it runs.  In
Python functions they are accumulators, which may count a retried task twice.  Results
are keyed ``<transform>.<metric>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counter:
    """Counts rows, or sums ``by`` where it is given."""

    name: str
    by: Column | None = None


@dataclass(frozen=True)
class Distribution:
    """Count, sum, min and max of ``of``."""

    name: str
    of: Column


def _aggregates(metrics: Iterable[Counter | Distribution]) -> list[Column]:
    exprs = []
    for m in metrics:
        if isinstance(m, Counter):
            by = F.count(F.lit(1)) if m.by is None else F.coalesce(F.sum(m.by), F.lit(0))
            exprs.append(by.alias(m.name))
        else:
            for kind, agg in (("count", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max)):
                exprs.append(agg(m.of).alias(f"{m.name}_{kind}"))
    return exprs


def measure(df: DataFrame, *metrics: Counter | Distribution) -> DataFrame:
    """The same metrics as a table of one row, without an action."""
    return df.agg(*_aggregates(metrics))


def _finished(seen: Observation) -> bool:
    return bool(seen._jo is not None and seen._jo.future().isCompleted())


class _Spread(AccumulatorParam):
    def zero(self, value):
        return (0, 0, None, None)

    def addInPlace(self, a, b):  # noqa: N802  the name Spark calls
        if not a[0] or not b[0]:
            return a if a[0] else b
        return (a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]))


@dataclass
class Metrics:
    """The metrics of one pipeline; ``counters`` and ``distributions`` hold results after an action."""

    observations: dict[str, tuple[Observation, list]] = field(default_factory=dict)
    accumulators: dict[str, object] = field(default_factory=dict)
    finalizers: list[Callable[[], object]] = field(default_factory=list)

    def after_commit(self, fn: Callable[[], object]) -> None:
        """Have ``fn`` called once on the driver when all outputs of the pipeline are committed."""
        self.finalizers.append(fn)

    def observe(self, transform: str, df: DataFrame, *metrics: Counter | Distribution) -> DataFrame:
        """Attach metrics to the rows of ``df``; names of transforms must differ."""
        if transform in self.observations:
            raise ValueError(f"transform {transform!r} is observed already")
        exprs = _aggregates(metrics)
        seen = Observation(f"millrace-{id(self)}-{transform}")
        self.observations[transform] = (seen, list(metrics))
        return df.observe(seen, *exprs)

    def counter(self, spark: SparkSession, key: str):
        """An accumulator for Python functions; call ``add`` on it."""
        return self.accumulators.setdefault(key, spark.sparkContext.accumulator(0))

    def distribution(self, spark: SparkSession, key: str):
        """As ``counter``; add ``(1, v, v, v)`` for a value v."""
        return self.accumulators.setdefault(
            key, spark.sparkContext.accumulator((0, 0, None, None), _Spread())
        )

    def _results(self, waiting: bool = True):
        for transform, (seen, metrics) in self.observations.items():
            if not waiting and not _finished(seen):
                continue
            row = seen.get  # waits for the action that computes it
            for m in metrics:
                if isinstance(m, Counter):
                    yield f"{transform}.{m.name}", int(row[m.name] or 0)
                else:
                    yield f"{transform}.{m.name}", {k: row[f"{m.name}_{k}"] for k in ("count", "sum", "min", "max")}
        for key, acc in self.accumulators.items():
            v = acc.value
            yield key, dict(zip(("count", "sum", "min", "max"), v, strict=True)) if isinstance(v, tuple) else v

    def so_far(self) -> tuple[dict[str, int], dict[str, dict]]:
        """Counters and distributions that are known now; an observation that has not ended is not."""
        found = dict(self._results(waiting=False))
        spread = {k: v for k, v in found.items() if isinstance(v, dict)}
        return {k: v for k, v in found.items() if k not in spread}, spread

    @property
    def counters(self) -> dict[str, int]:
        return {k: v for k, v in self._results() if not isinstance(v, dict)}

    @property
    def distributions(self) -> dict[str, dict]:
        return {k: v for k, v in self._results() if isinstance(v, dict)}
