"""Named pipelines: loaded once, run by name, with results, counters and distributions."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from concurrent.futures import CancelledError
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.metrics import Metrics

_IDS = itertools.count()


@dataclass
class Pipeline:
    """A running pipeline.  ``wait`` returns when it is done; metrics are there even if it failed."""

    name: str
    spark: SparkSession
    metrics: Metrics
    outputs: dict[str, DataFrame]
    tag: str
    results: dict[str, int] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    distributions: dict[str, dict] = field(default_factory=dict)
    error: BaseException | None = None
    cancelled: bool = False
    _thread: threading.Thread | None = None

    def _run(self, sink: Callable[[str, DataFrame], object]) -> None:
        # Tags belong to a thread, and jobs that it starts carry them.
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            for name, df in self.outputs.items():
                if self.cancelled:
                    raise CancelledError(f"pipeline {self.name!r} was cancelled")
                self.results[name] = sink(name, df)
            for finish in self.metrics.finalizers:
                finish()
        except BaseException as e:  # noqa: BLE001  handed to wait()
            self.error = e
        finally:
            context.removeJobTag(self.tag)

    def wait(self) -> Pipeline:
        """Wait for the end; raise what the pipeline raised, its metrics being there all the same."""
        if self._thread:
            self._thread.join()
        if self.error is None:
            self.counters, self.distributions = self.metrics.counters, self.metrics.distributions
            return self
        self.counters, self.distributions = self.metrics.so_far()
        raise self.error

    def cancel(self) -> None:
        """Stop the running job of this pipeline, and no other's; outputs not begun are left out."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


#: A builder gets the session, the metrics to attach to, and options; it returns outputs.
Builder = Callable[..., dict[str, DataFrame] | DataFrame]


@dataclass(frozen=True)
class Options:
    """Features of a run: the pipeline's ``name``, and the ``endpoint`` it is sent to."""

    name: str | None = None
    endpoint: str | None = None


def name(value: str) -> Options:
    return Options(name=value)


def endpoint(value: str) -> Options:
    """A master or a Spark Connect address; see ``session``."""
    return Options(endpoint=value)


def merged(*options: Options) -> Options:
    """One of all; what a later one sets overrides an earlier one."""
    out = Options()
    for o in options:
        out = replace(out, **{k: v for k, v in vars(o).items() if v is not None})
    return out


class Launcher:
    """A registry of pipelines."""

    def __init__(self):
        self.builders: dict[str, Builder] = {}
        self.sealed = False

    def load(self, name: str, builder: Builder) -> None:
        if builder is None:
            raise ValueError("a pipeline needs a builder")
        if self.sealed:
            raise RuntimeError("pipelines are loaded before ready()")
        if name in self.builders:
            raise ValueError(f"pipeline {name!r} is loaded already")
        self.builders[name] = builder

    def ready(self) -> Launcher:
        self.sealed = True
        return self

    def run(
        self,
        spark: SparkSession,
        name: str,
        sink: Callable[[str, DataFrame], object] | None = None,
        wait: bool = False,
        **options: object,
    ) -> Pipeline:
        """Build and start a pipeline.  ``sink`` consumes each output; by default it is counted."""
        if not self.sealed:
            raise RuntimeError("call ready() first")
        if name not in self.builders:
            raise KeyError(f"no pipeline named {name!r}")
        metrics = Metrics()
        built = self.builders[name](spark, metrics, **options)
        outputs = {"out": built} if isinstance(built, DataFrame) else built
        if not outputs:
            raise ValueError("empty pipeline")
        p = Pipeline(name, spark, metrics, outputs, f"millrace-{name}-{next(_IDS)}")
        p._thread = threading.Thread(target=p._run, args=(sink or (lambda _, df: df.count()),), daemon=True)
        p._thread.start()
        return p.wait() if wait else p


def launch(spark: SparkSession, builder: Builder, name: str = "default", *options: Options, **params: object) -> Pipeline:
    """Load, and run at once; an option's name goes before ``name``."""
    chosen = merged(Options(name=name), *options).name
    launcher = Launcher()
    launcher.load(chosen, builder)
    return launcher.ready().run(spark, chosen, **params)


def launch_and_wait(spark: SparkSession, builder: Builder, name: str = "default", *options: Options, **params: object) -> Pipeline:
    return launch(spark, builder, name, *options, **params).wait()
