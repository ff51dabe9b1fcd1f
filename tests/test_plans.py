import os
import subprocess
import sys
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import Counter, Distribution, Metrics
from millrace.operators import DoFn, par_do
from millrace.plans import Launcher, Options, endpoint, launch, launch_and_wait, merged, name
from millrace.plans import queries as own
from millrace.streaming import fixed_windows, run_available, session_windows, sliding_windows, stream_parquet, stream_text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = own.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=str)
    want = tables.sql(f"SELECT {', '.join(cols)} FROM ({own.ORACLES[name]})").fetchall()
    assert got == sorted(map(plain, want), key=str)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(own.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module imports where the training-data parts are not there."""
    import shutil

    for name in ("millrace", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "millrace" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wordcount' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = own.pardo_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,150000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = own.wordcount(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "partial_count" in plan and "Python" not in plan
    plan = own.side_map_lookup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_metrics(spark):
    metrics = Metrics()
    df = metrics.observe("pants", spark.range(10), Counter("Processed"), Counter("total", F.col("id")), Distribution("spread", F.col("id")))
    df.collect()
    assert metrics.counters == {"pants.Processed": 10, "pants.total": 45}
    assert metrics.distributions == {"pants.spread": {"count": 10, "sum": 45, "min": 0, "max": 9}}
    with pytest.raises(ValueError):
        metrics.observe("pants", df, Counter("x"))


def test_metrics_in_python_functions(spark):
    metrics = Metrics()
    hits, spread = metrics.counter(spark, "fn.hits"), metrics.distribution(spark, "fn.spread")

    class Count(DoFn):
        def process(self, element, emit):
            hits.add(1)
            spread.add((1, element, element, element))
            emit(element)

    par_do(spark.range(10).select(F.col("id").alias("value")), Count(), int).collect()
    assert metrics.counters == {"fn.hits": 10}
    assert metrics.distributions == {"fn.spread": {"count": 10, "sum": 45, "min": 0, "max": 9}}


def build(spark, metrics, n=10):
    return {"a": metrics.observe("src", spark.range(n), Counter("rows")), "b": spark.range(3)}


def test_launch(spark):
    p = launch_and_wait(spark, build, n=11)
    assert p.results == {"a": 11, "b": 3} and p.counters == {"src.rows": 11}
    assert launch(spark, lambda s, m: s.range(4)).wait().results == {"out": 4}


def test_launcher_checks(spark):
    launcher = Launcher()
    with pytest.raises(ValueError):
        launcher.load("x", None)
    launcher.load("x", build)
    with pytest.raises(ValueError):
        launcher.load("x", build)
    with pytest.raises(RuntimeError):
        launcher.run(spark, "x")
    launcher.ready()
    with pytest.raises(KeyError):
        launcher.run(spark, "y")
    with pytest.raises(RuntimeError):
        launcher.load("z", build)
    with pytest.raises(ValueError, match="empty"):
        launch(spark, lambda s, m: {})


def test_failures_reach_wait(spark):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        launch(spark, lambda s, m: par_do(s.range(3), lambda v: [1 / 0], float), sink=lambda _, df: df.collect()).wait()


@pytest.mark.parametrize("kind", ["fixed", "sliding", "session"])
def test_windows_alike_in_batch_and_stream(spark, sf_dir, tmp_path, kind):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))

    def windows(df):
        if kind == "fixed":
            return fixed_windows(df, "1 hour", n=F.count("*"))
        if kind == "sliding":
            return sliding_windows(df, "2 hours", "1 hour", n=F.count("*"))
        return session_windows(df, "30 minutes", "user_id", n=F.count("*"))

    batch = sorted(map(str, windows(events).collect()))
    out = windows(stream_parquet(spark, str(tmp_path / "in"), events.schema))
    got = sorted(map(str, run_available(out, str(tmp_path / "out"), str(tmp_path / "c")).collect()))
    assert set(got) <= set(batch) and len(batch) - 3 <= len(got) <= len(batch)
    with pytest.raises(ValueError):
        fixed_windows(events, "1 hour")


def test_stream_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x\r\ny\n")
    (tmp_path / "in" / "b.log").write_bytes(b"no\n")
    out = stream_text(spark, str(tmp_path / "in"), "*.txt")
    got = run_available(out, str(tmp_path / "out"), str(tmp_path / "c")).collect()
    assert sorted(r.value for r in got) == ["x\r", "y"]


def test_cancel_stops_the_running_job_and_no_other(spark):
    def _sleepy(batches):
        for batch in batches:
            time.sleep(1)
            yield batch

    def slow(spark, metrics):
        return {"a": spark.range(0, 40, 1, 40).mapInArrow(_sleepy, "id bigint"), "b": spark.range(3)}

    p = launch(spark, slow, "slow")
    other = launch(spark, lambda spark, metrics: spark.range(0, 8, 1, 8).mapInArrow(_sleepy, "id bigint"), "other")
    time.sleep(3)
    began = time.monotonic()
    p.cancel()
    with pytest.raises(Exception):  # noqa: B017  Spark's own, or CancelledError between two outputs
        p.wait()
    assert time.monotonic() - began < 8 and p.results == {}
    assert other.wait().results == {"out": 8}
    assert launch_and_wait(spark, lambda spark, metrics: spark.range(5), "after").results == {"out": 5}


def test_metrics_are_there_after_a_failure(spark):
    def build(spark, metrics):
        seen = metrics.counter(spark, "work.seen")
        rows = metrics.observe("read", spark.range(10), Counter("rows"))
        late = metrics.observe("late", spark.range(10), Counter("rows"))

        class Work(DoFn):
            def process(self, element, emit):
                seen.add(1)
                emit(element["id"])

            def finish_bundle(self, emit):
                pass

        class Bad(DoFn):
            def process(self, element, emit):
                raise RuntimeError("broken")

        done = par_do(rows, Work(), int)
        return {"good": done, "bad": par_do(late, Bad(), int)}

    p = launch(spark, build)
    with pytest.raises(Exception, match="broken"):
        p.wait()
    assert p.results == {"good": 10}
    assert p.counters["read.rows"] == 10 and p.counters["work.seen"] == 10
    assert p.counters.get("late.rows", 0) <= 10  # what the failed job had seen


def test_finalizers_run_after_all_outputs(spark):
    calls = []

    def build(spark, metrics):
        metrics.after_commit(lambda: calls.append(threading.current_thread().name))
        return spark.range(3)

    assert launch_and_wait(spark, build).results == {"out": 3} and len(calls) == 1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        launch_and_wait(spark, lambda s, m: (m.after_commit(lambda: calls.append(1)), s.range(1).selectExpr("1 / (id * 0) AS x"))[1],
                        sink=lambda _, df: df.collect())
    assert len(calls) == 1


def test_later_options_override(spark):
    assert merged(name("a"), endpoint("local[2]"), name("b")) == Options("b", "local[2]")
    assert merged() == Options()
    assert launch(spark, lambda s, m: s.range(1), "first", name("second")).wait().name == "second"


def test_session_leaves_the_master_to_spark_submit(tmp_path):
    code = "from millrace.session import session; s = session(); print('master', s.sparkContext.master, s.conf.get('spark.sql.adaptive.enabled'))"
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.adaptive.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert "master local[2] false" in done.stdout, done.stderr[-500:]


def test_composite_word_count_observes_lines(spark):
    metrics = Metrics()
    lines = spark.createDataFrame([("a bc  defg",), ("",), ("  ",), ("don't a",)], "value string")
    got = {r.key: r.value for r in own.count_words(lines, metrics).collect()}
    assert got == {"a": 2, "bc": 1, "defg": 1, "don't": 1}
    assert metrics.counters == {"lines.small_words": 3, "lines.empty_lines": 2}
    assert metrics.distributions["lines.line_len"] == {"count": 4, "sum": 19, "min": 0, "max": 10}
