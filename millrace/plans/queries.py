"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import Counter, Distribution, Metrics, measure
from ..functions.text import byte_length, extract_words, is_blank, split_lines
from ..operators import (
    DoFn,
    StatefulFn,
    add_merge,
    as_of_join,
    as_side_iter,
    as_side_map,
    co_group_by_key,
    combine_globally,
    combine_per_key,
    create,
    cube,
    distinct,
    except_,
    expand,
    explode_range,
    filter_,
    flat_map,
    flatten,
    full_combine,
    group_by_key,
    group_into_batches,
    grouping_sets,
    impulse,
    intersect,
    interval_join,
    join,
    map_,
    merge_extract,
    par_do,
    partition,
    process_ranges,
    reshuffle,
    rollup,
    simple_merge,
    stateful_par_do,
)
from ..operators import top_per_key as top_rows
from ..operators.ranges import OffsetRange
from ..operators.state import Bag, Combining, Map, MultiMap, OrderedList, Set, Value
from ..sources.files import match_all, match_files, read_content, read_matches
from ..sources.scratch import scratch_dir
from ..sources.synthetic import SourceConfig, synthetic_ranges, synthetic_source, synthetic_step
from ..sources.text import immediate, read_all, read_text, read_with_filename, write_single
from ..streaming.windows import fixed_windows, session_windows, sliding_windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impulse_count(spark, sf_dir):
    return impulse(spark).agg(F.count("*").alias("n"))


def create_values(spark, sf_dir):
    return create(spark, 1, 2, 3, 4, 5)


def pardo_key_mod(spark, sf_dir):
    return map_(
        table(spark, sf_dir, "lineitem"),
        key=F.col("l_orderkey") % 3,
        l_orderkey=F.col("l_orderkey"),
        l_linenumber=F.col("l_linenumber"),
    )


def pardo_filter(spark, sf_dir):
    rows = filter_(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 150000)
    return rows.select("o_orderkey", "o_totalprice")


def wordcount(spark, sf_dir):
    """Words of all documents with their counts: flat-map, then a combiner per key."""
    words = flat_map(table(spark, sf_dir, "documents"), extract_words(F.col("text")), "key")
    return combine_per_key(words.withColumn("value", F.lit(1)), "count").select(
        F.col("key").alias("word"), F.col("value").alias("n")
    )


class _Route(DoFn):
    """Clicks go one way, everything else another, big values also a third."""

    def process(self, element, emit):
        emit(element["event_id"], "clicks" if element["event_type"] == "click" else "others")
        if element["value"] is not None and element["value"] > 50:
            emit((element["event_id"], element["value"]), "big")


def pardo_multi_output(spark, sf_dir):
    """One Python pass, three outputs."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    outs = par_do(events, _Route(), {"clicks": int, "others": int, "big": "event_id bigint, value double"})
    return flatten(
        *[
            outs[k].agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("ids")).withColumn("tag", F.lit(k))
            for k, c in (("clicks", "value"), ("others", "value"), ("big", "event_id"))
        ]
    )


def partition_flatten(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return flatten(*partition(orders, F.col("o_orderkey") % 2, 2))


def map_format(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return map_(
        customers, F.col("c_custkey"), line=F.format_string("%s: %s", F.col("c_name"), F.col("c_mktsegment"))
    )


def map_python(spark, sf_dir):
    """An opaque function over elements, in Arrow batches."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    return par_do(names, lambda v: [(v, v[::-1].lower())], "n_name string, mirrored string")


def flatten_union(spark, sf_dir):
    return flatten(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source")),
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("source")),
    )


def gbk_sizes(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return group_by_key(keyed).select(
        "key",
        F.size("values").cast("bigint").alias("n"),
        F.expr("aggregate(values, 0L, (a, v) -> a + v)").alias("total"),
        F.concat_ws(",", F.transform(F.array_sort("values"), lambda v: v.cast("string"))).alias("list"),
    )


def reshuffle_identity(spark, sf_dir):
    return reshuffle(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


def _keyed_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("value"))


def _combine(name):
    def query(spark, sf_dir):
        return combine_per_key(_keyed_lines(spark, sf_dir), name).select("key", F.col("value").alias(name))

    return query


def combine_mean_full(spark, sf_dir):
    """Mean by a custom combiner with all four functions, in two phases."""
    keyed = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value")
    mean = full_combine(
        create=lambda: (0, 0.0),
        add=lambda a, v: (a[0] + 1, a[1] + v),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        extract=lambda a: a[1] / a[0],
    )
    out = combine_per_key(keyed, mean, output=float)
    return out.select("key", F.round("value", 4).alias("mean"))


def combine_custom_merge(spark, sf_dir):
    """A custom combiner of one function: the longest name of each segment, ties by order."""
    keyed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return combine_per_key(keyed, simple_merge(lambda a, b: min(a, b, key=lambda s: (-len(s), s))), output=str).select(
        "key", F.col("value").alias("longest")
    )


def combine_global(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return combine_globally(lines, F.sum("l_quantity")).select(F.col("value").alias("total"))


def side_iter_threshold(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))
    return (
        as_side_iter(mean).join(orders, F.col("o_totalprice") > 1.5 * F.col("mean")).select("o_orderkey", "o_totalprice")
    )


def side_map_lookup(spark, sf_dir):
    nations = as_side_map(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer")
    return nations.get(customers, F.col("c_nationkey")).select("c_custkey", F.col("side_value").alias("n_name"))


def side_map_missing(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    orders = as_side_map(dear, "o_custkey", "o_orderkey")
    return orders.lacking(table(spark, sf_dir, "customer"), F.col("c_custkey")).select("c_custkey")


def side_map_having(spark, sf_dir):
    orders = as_side_map(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return orders.having(table(spark, sf_dir, "customer"), F.col("c_custkey")).select("c_custkey")


def side_map_keys(spark, sf_dir):
    return as_side_map(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").keys()


def cogbk_tagged(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    both = co_group_by_key(customers=customers, orders=orders)
    return both.select(
        "key",
        F.size("customers").cast("bigint").alias("n_customers"),
        F.size("orders").cast("bigint").alias("n_orders"),
        F.expr("aggregate(orders, 0L, (a, v) -> a + v)").alias("orders_total"),
    )


class _BagSum(StatefulFn):
    """The sum of the bag after each element; the bag is emptied at three."""

    bag = Bag()

    def process(self, key, row, emit):
        self.bag.append(row["cents"])
        held = list(self.bag.read())
        emit((key, row["event_id"], sum(held)))
        if len(held) == 3:
            self.bag.clear()


def _by_user(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("key"), "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents")
    )


def stateful_bag(spark, sf_dir):
    return stateful_par_do(
        _by_user(spark, sf_dir), _BagSum(), "user_id bigint, event_id bigint, total bigint", order_by=["ts", "event_id"]
    )


class _First(StatefulFn):
    seen = Set()

    def process(self, key, row, emit):
        if self.seen.add(row["event_type"]):
            emit((key, row["event_type"], row["event_id"]))


def stateful_dedup(spark, sf_dir):
    return stateful_par_do(
        _by_user(spark, sf_dir), _First(), "user_id bigint, event_type string, event_id bigint", order_by=["ts", "event_id"]
    )


class _Change(StatefulFn):
    last = Value()

    def process(self, key, row, emit):
        before = self.last.read(0)
        self.last.write(row["cents"])
        emit((key, row["event_id"], row["cents"] - before))


def stateful_last_value(spark, sf_dir):
    return stateful_par_do(
        _by_user(spark, sf_dir), _Change(), "user_id bigint, event_id bigint, change bigint", order_by=["ts", "event_id"]
    )


class _Recent(StatefulFn):
    """How many events the user had in the hour up to each one."""

    times = OrderedList()

    def process(self, key, row, emit):
        now = row["second"]
        self.times.clear_range(float("-inf"), now - 3600)
        self.times.add(now, row["event_id"])
        emit((key, row["event_id"], len(self.times.read())))


def stateful_ordered_list(spark, sf_dir):
    rows = _by_user(spark, sf_dir).withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return stateful_par_do(
        rows.select("key", "second", "event_id"), _Recent(), "user_id bigint, event_id bigint, n bigint",
        order_by=["second", "event_id"],
    )


def sdf_offset_range(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return explode_range(parts, F.lit(0), F.col("p_size") + 1).select("p_partkey", F.col("position").cast("bigint").alias("position"))


def sdf_python_range(spark, sf_dir):
    """The same range claimed by an opaque function, every second position."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def work(row, position):
        return position + 1, [(row["p_partkey"], position)] if position % 2 == 0 else []

    return process_ranges(
        parts, lambda row: OffsetRange(0, row["p_size"] + 1), work, "p_partkey bigint, position bigint", most=16
    )


def synthetic_fanout(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    return synthetic_ranges(suppliers, 3).select("s_suppkey", F.col("position").cast("bigint").alias("position"))


def metrics_distribution(spark, sf_dir):
    """The distribution that an observation gathers, as a table."""
    metrics = Metrics()
    docs = table(spark, sf_dir, "documents")
    seen = metrics.observe("bytes", docs, Distribution("length", byte_length(F.col("text"))))
    seen.write.format("noop").mode("overwrite").save()
    d = metrics.distributions["bytes.length"]
    return spark.createDataFrame(
        [(d["count"], d["sum"], d["min"], d["max"])], "n bigint, total bigint, least bigint, most bigint"
    )


def text_lines(spark, sf_dir):
    lines = flat_map(table(spark, sf_dir, "documents"), split_lines(F.col("text")), "line", ["doc_id"])
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(byte_length(F.col("line"))).alias("bytes"))


def composite_expand(spark, sf_dir):
    """A composite: filter, key, combine."""
    return expand(
        table(spark, sf_dir, "orders"),
        lambda d: filter_(d, F.col("o_orderstatus") == "O"),
        lambda d: map_(d, key=F.col("o_orderpriority"), value=F.lit(1)),
        lambda d: combine_per_key(d, "count").select("key", F.col("value").alias("n")),
    )


def win_fixed(spark, sf_dir):
    return fixed_windows(table(spark, sf_dir, "events"), "1 hour", n=F.count("*")).select(
        F.unix_timestamp("start").alias("start_s"), "n"
    )


def win_sliding(spark, sf_dir):
    return sliding_windows(table(spark, sf_dir, "events"), "2 hours", "1 hour", n=F.count("*")).select(
        F.unix_timestamp("start").alias("start_s"), "n"
    )


def win_session(spark, sf_dir):
    return session_windows(table(spark, sf_dir, "events"), "30 minutes", "user_id", n=F.count("*")).select(
        "user_id", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "n"
    )


def distinct_values(spark, sf_dir):
    return distinct(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


def top_per_key(spark, sf_dir):
    """The three dearest orders of each priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_rows(orders, "o_orderpriority", 3, F.desc("o_totalprice"), "o_orderkey")


def count_words(lines: DataFrame, metrics: Metrics | None = None, small: int = 4) -> DataFrame:
    """The word count as a composite: ``key, value`` of the words of ``lines``.

    Observes, where ``metrics`` are given, how many words are shorter than ``small``, the
    lengths of lines, and how many lines are blank.
    """
    if metrics is not None:
        lines = metrics.observe("lines", lines, *line_metrics(F.col("value"), small))
    words = flat_map(lines, extract_words(F.col("value")), "key")
    return combine_per_key(words.withColumn("value", F.lit(1)), "count")


def line_metrics(line, small: int) -> list:
    short = F.size(F.filter(extract_words(line), lambda w: byte_length(w) < small))
    blank = F.when(is_blank(line), 1).otherwise(0)
    return [Counter("small_words", short), Distribution("line_len", byte_length(line)), Counter("empty_lines", blank)]


def wordcount_metrics(spark, sf_dir):
    """The word count's metrics, as a table."""
    lines = flat_map(table(spark, sf_dir, "documents"), split_lines(F.col("text")), "value")
    return measure(lines, *line_metrics(F.col("value"), 4))


def metrics_counter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = F.when(F.col("event_type") == "click", 1).otherwise(0)
    return measure(events, Counter("rows"), Counter("clicks", clicks))


def combine_add_merge(spark, sf_dir):
    """Letters in the names of each brand: an accumulator that is the output."""
    keyed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    letters = add_merge(create=lambda: 0, add=lambda a, v: a + len(v), merge=lambda a, b: a + b)
    return combine_per_key(keyed, letters, output=int).select("key", F.col("value").alias("letters"))


def combine_merge_extract(spark, sf_dir):
    """Sizes of each brand's parts, merged as they are and extracted as text."""
    keyed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("value"))
    total = merge_extract(merge=lambda a, b: a + b, extract=lambda a: f"<{a}>")
    return combine_per_key(keyed, total, output=str).select("key", F.col("value").alias("total"))


class _BundleCount(DoFn):
    """Emits nothing for an element and the number of elements for a bundle."""

    def start_bundle(self):
        self.n = 0

    def process(self, element, emit):
        self.n += 1

    def finish_bundle(self, emit):
        emit(self.n)


def bundle_hooks(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value"))
    return par_do(keys, _BundleCount(), int).agg(F.sum("value").alias("n"))


def multiplex(spark, sf_dir):
    """Three consumers of one collection."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return flatten(
        map_(orders, key=F.lit("all"), value=F.col("o_orderkey")),
        map_(filter_(orders, F.col("o_totalprice") > 200000), key=F.lit("dear"), value=F.col("o_orderkey")),
        map_(orders, key=F.lit("mod"), value=F.col("o_orderkey") % 7),
    ).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class _Running(StatefulFn):
    total = Combining(simple_merge(lambda a, b: a + b))

    def process(self, key, row, emit):
        self.total.add(row["cents"])
        emit((key, row["event_id"], self.total.read()))


class _PerType(StatefulFn):
    seen = Map()

    def process(self, key, row, emit):
        n = self.seen.get(row["event_type"], 0) + 1
        self.seen.put(row["event_type"], n)
        emit((key, row["event_id"], n))


class _Listed(StatefulFn):
    """The events of the type so far, and the first of them."""

    events = MultiMap()

    def process(self, key, row, emit):
        self.events.put(row["event_type"], row["event_id"])
        held = list(self.events.get(row["event_type"]))
        emit((key, row["event_id"], len(held), held[0]))


def _stateful(fn, output):
    def query(spark, sf_dir):
        return stateful_par_do(_by_user(spark, sf_dir), fn(), f"user_id bigint, event_id bigint, {output}", order_by=["ts", "event_id"])

    return query


def synthetic_records(spark, sf_dir):
    made = synthetic_source(spark, SourceConfig(1000, key_size=12, value_size=100, initial_splits=4))
    return made.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("key_bytes"),
        F.sum(F.octet_length("value")).alias("value_bytes"), F.count_distinct("key").alias("keys"),
    )


def synthetic_repeats(spark, sf_dir):
    return synthetic_step(table(spark, sf_dir, "supplier").select("s_suppkey"), outputs=4).groupBy("s_suppkey").agg(F.count("*").alias("n"))


def _nation_files(spark, sf_dir) -> str:
    """A folder with a file for each region, ``<region>.txt``, of its nations, one on a line."""
    folder = scratch_dir(spark, "nations")
    nations = table(spark, sf_dir, "nation")
    for region in table(spark, sf_dir, "region").collect():  # five rows at any scale
        own = nations.where(F.col("n_regionkey") == region["r_regionkey"]).orderBy("n_name")
        write_single(own.select(F.col("n_name").alias("value")), folder, f"{region['r_name']}.txt")
    return folder


def io_match_files(spark, sf_dir):
    return match_files(spark, _nation_files(spark, sf_dir), "A*.txt").select("key", "size")


def io_match_all(spark, sf_dir):
    folder = _nation_files(spark, sf_dir)
    globs = spark.createDataFrame([(folder, "A*.txt"), (folder, "EUROPE.*"), (folder, "*none*")], "key string, value string")
    return match_all(globs).select("key", "size")


def io_read_matches(spark, sf_dir):
    files = read_matches(match_files(spark, _nation_files(spark, sf_dir), "*.txt"))
    return read_content(files, text=True).select("key", "content")


def io_read_text(spark, sf_dir):
    return read_text(spark, _nation_files(spark, sf_dir), "*.txt")


def io_read_all(spark, sf_dir):
    folder = _nation_files(spark, sf_dir)
    return read_all(spark.createDataFrame([(folder, "AMERICA.txt"), (folder, "AS*")], "key string, value string"))


def io_read_with_filename(spark, sf_dir):
    return read_with_filename(spark, _nation_files(spark, sf_dir), "*.txt")


def io_write_single(spark, sf_dir):
    """Words written to one file and read back."""
    folder = scratch_dir(spark, "single")
    lines = table(spark, sf_dir, "customer").select(F.format_string("%s: %s", "c_name", "c_mktsegment").alias("value"))
    write_single(lines, folder, "out/customers.txt")
    return read_text(spark, folder, "out/*")


def io_immediate(spark, sf_dir):
    folder = scratch_dir(spark, "immediate")
    write_single(table(spark, sf_dir, "region").select(F.col("r_name").alias("value")), folder, "regions.txt")
    return immediate(spark, f"{folder}/regions.txt")


def _customer_orders(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return customers, orders


def _join(how):
    def query(spark, sf_dir):
        return join(*_customer_orders(spark, sf_dir), "key", how)

    return query


def set_intersect(spark, sf_dir):
    customers, orders = _customer_orders(spark, sf_dir)
    return intersect(customers.select("key"), orders.select("key"))


def set_except(spark, sf_dir):
    customers, orders = _customer_orders(spark, sf_dir)
    return except_(customers.select("key"), orders.select("key"))


def _flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


def agg_rollup(spark, sf_dir):
    return rollup(_flags(spark, sf_dir), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum("l_quantity"))


def agg_cube(spark, sf_dir):
    return cube(_flags(spark, sf_dir), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum("l_quantity"))


def agg_grouping_sets(spark, sf_dir):
    sets = [["l_returnflag"], ["l_linestatus"], []]
    return grouping_sets(_flags(spark, sf_dir), sets, ["l_returnflag", "l_linestatus"], n=F.count("*"))


def agg_distinct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("n"))


def asof_join(spark, sf_dir):
    """Each purchase with the user's last click before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return as_of_join(bought, clicks, "ts", ["user_id"], ["click_id"]).select("user_id", "event_id", "click_id")


def range_join(spark, sf_dir):
    """Parts by the price bands that hold their sizes."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    bands = spark.createDataFrame([("low", 0, 10), ("mid", 5, 30), ("high", 30, 1000)], "band string, low int, high int")
    return interval_join(parts, bands, "p_size", "low", "high", 25).select("p_partkey", "band")


def batches(spark, sf_dir):
    """Orders of each customer in batches of three."""
    keyed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return group_into_batches(keyed, 3).select(
        "key", "batch", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("list")
    )


QUERIES = {
    "impulse_count": impulse_count,
    "create_values": create_values,
    "pardo_key_mod": pardo_key_mod,
    "pardo_filter": pardo_filter,
    "wordcount": wordcount,
    "pardo_multi_output": pardo_multi_output,
    "partition_flatten": partition_flatten,
    "map_format": map_format,
    "map_python": map_python,
    "flatten_union": flatten_union,
    "gbk_sizes": gbk_sizes,
    "reshuffle_identity": reshuffle_identity,
    "combine_sum": _combine("sum"),
    "combine_min": _combine("min"),
    "combine_max": _combine("max"),
    "combine_count": _combine("count"),
    "combine_mean_full": combine_mean_full,
    "combine_custom_merge": combine_custom_merge,
    "combine_global": combine_global,
    "side_iter_threshold": side_iter_threshold,
    "side_map_lookup": side_map_lookup,
    "side_map_missing": side_map_missing,
    "side_map_having": side_map_having,
    "side_map_keys": side_map_keys,
    "cogbk_tagged": cogbk_tagged,
    "stateful_bag": stateful_bag,
    "stateful_dedup": stateful_dedup,
    "stateful_last_value": stateful_last_value,
    "stateful_ordered_list": stateful_ordered_list,
    "sdf_offset_range": sdf_offset_range,
    "sdf_python_range": sdf_python_range,
    "synthetic_fanout": synthetic_fanout,
    "metrics_distribution": metrics_distribution,
    "text_lines": text_lines,
    "composite_expand": composite_expand,
    "win_fixed": win_fixed,
    "win_sliding": win_sliding,
    "win_session": win_session,
    "distinct_values": distinct_values,
    "top_per_key": top_per_key,
    "wordcount_metrics": wordcount_metrics,
    "metrics_counter": metrics_counter,
    "combine_add_merge": combine_add_merge,
    "combine_merge_extract": combine_merge_extract,
    "bundle_hooks": bundle_hooks,
    "multiplex": multiplex,
    "stateful_combining": _stateful(_Running, "total bigint"),
    "stateful_map": _stateful(_PerType, "n bigint"),
    "stateful_multimap": _stateful(_Listed, "n bigint, first bigint"),
    "synthetic_records": synthetic_records,
    "synthetic_repeats": synthetic_repeats,
    "io_match_files": io_match_files,
    "io_match_all": io_match_all,
    "io_read_matches": io_read_matches,
    "io_read_text": io_read_text,
    "io_read_all": io_read_all,
    "io_read_with_filename": io_read_with_filename,
    "io_write_single": io_write_single,
    "io_immediate": io_immediate,
    "join_inner": _join("inner"),
    "join_left": _join("left"),
    "join_full": _join("full"),
    "join_anti": _join("left_anti"),
    "set_intersect": set_intersect,
    "set_except": set_except,
    "agg_rollup": agg_rollup,
    "agg_cube": agg_cube,
    "agg_grouping_sets": agg_grouping_sets,
    "agg_distinct": agg_distinct,
    "asof_join": asof_join,
    "range_join": range_join,
    "group_into_batches": batches,
}

_ROLLING = "(PARTITION BY user_id ORDER BY ts, event_id)"
_TYPED = "(PARTITION BY user_id, event_type ORDER BY ts, event_id)"
_LINES = """SELECT unnest(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2]
    ELSE string_split(text, chr(10)) END) AS line FROM documents"""
_FILES = "nation JOIN region ON n_regionkey = r_regionkey"
_PAIRS = """(SELECT c_custkey AS key, c_nationkey FROM customer) c {} JOIN
    (SELECT o_custkey AS key, o_orderkey FROM orders) o ON c.key = o.key"""
_SUMS = "count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY"

ORACLES = {
    "impulse_count": "SELECT CAST(1 AS BIGINT) AS n",
    "create_values": "SELECT CAST(value AS BIGINT) AS value FROM (VALUES (1), (2), (3), (4), (5)) v(value)",
    "pardo_key_mod": "SELECT l_orderkey % 3 AS key, l_orderkey, l_linenumber FROM lineitem",
    "pardo_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000",
    "wordcount": """SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+(''[a-z])?', 0)) AS word FROM documents) GROUP BY word""",
    "pardo_multi_output": """
        SELECT 'clicks' AS tag, count(*) AS n, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS ids FROM events WHERE event_type = 'click'
        UNION ALL SELECT 'others', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM events WHERE event_type <> 'click'
        UNION ALL SELECT 'big', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM events WHERE value > 50""",
    "partition_flatten": "SELECT o_orderkey, o_custkey FROM orders",
    "map_format": "SELECT c_custkey, c_name || ': ' || c_mktsegment AS line FROM customer",
    "map_python": "SELECT n_name, lower(reverse(n_name)) AS mirrored FROM nation",
    "flatten_union": """SELECT c_custkey AS key, 'customer' AS source FROM customer
        UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""",
    "gbk_sizes": """SELECT o_custkey AS key, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS list FROM orders GROUP BY 1""",
    "reshuffle_identity": "SELECT p_partkey, p_name, p_size FROM part",
    "combine_sum": "SELECT l_suppkey AS key, sum(l_quantity) AS sum FROM lineitem GROUP BY 1",
    "combine_min": "SELECT l_suppkey AS key, min(l_quantity) AS min FROM lineitem GROUP BY 1",
    "combine_max": "SELECT l_suppkey AS key, max(l_quantity) AS max FROM lineitem GROUP BY 1",
    "combine_count": "SELECT l_suppkey AS key, count(l_quantity) AS count FROM lineitem GROUP BY 1",
    "combine_mean_full": "SELECT event_type AS key, round(avg(value), 4) AS mean FROM events GROUP BY 1",
    "combine_custom_merge": """SELECT p_brand AS key, p_name AS longest FROM (
        SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS r
        FROM part) WHERE r = 1""",
    "combine_global": "SELECT sum(l_quantity) AS total FROM lineitem",
    "side_iter_threshold": """SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)""",
    "side_map_lookup": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "side_map_missing": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "side_map_having": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "side_map_keys": "SELECT DISTINCT o_custkey AS key FROM orders",
    "cogbk_tagged": """SELECT coalesce(c.key, o.key) AS key, coalesce(n_customers, 0) AS n_customers,
        coalesce(n_orders, 0) AS n_orders, coalesce(orders_total, 0) AS orders_total
        FROM (SELECT c_custkey AS key, count(*) AS n_customers FROM customer GROUP BY 1) c
        FULL JOIN (SELECT o_custkey AS key, count(*) AS n_orders, CAST(sum(o_orderkey) AS BIGINT) AS orders_total
                   FROM orders GROUP BY 1) o ON c.key = o.key""",
    "stateful_bag": f"""SELECT user_id, event_id, CAST(sum(cents) OVER (PARTITION BY user_id, (r - 1) // 3
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
        FROM (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
              row_number() OVER {_ROLLING} AS r FROM events)""",
    "stateful_dedup": """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
    "stateful_last_value": f"""SELECT user_id, event_id, cents - coalesce(lag(cents) OVER {_ROLLING}, 0) AS change
        FROM (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
    "stateful_ordered_list": """SELECT a.user_id, a.event_id, count(*) AS n FROM
        (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) a JOIN
        (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) b
        ON a.user_id = b.user_id AND b.s >= a.s - 3600 AND (b.s < a.s OR (b.s = a.s AND b.event_id <= a.event_id))
        GROUP BY 1, 2""",
    "sdf_offset_range": "SELECT p_partkey, unnest(range(0, p_size + 1)) AS position FROM part",
    "sdf_python_range": "SELECT p_partkey, unnest(range(0, p_size + 1, 2)) AS position FROM part",
    "synthetic_fanout": "SELECT s_suppkey, unnest(range(0, 3)) AS position FROM supplier",
    "metrics_distribution": """SELECT count(text) AS n, CAST(sum(strlen(text)) AS BIGINT) AS total,
        min(strlen(text)) AS least, max(strlen(text)) AS most FROM documents""",
    "text_lines": """SELECT doc_id, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM (
        SELECT doc_id, unnest(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2]
               ELSE string_split(text, chr(10)) END) AS line FROM documents) GROUP BY 1""",
    "composite_expand": """SELECT o_orderpriority AS key, count(*) AS n FROM orders
        WHERE o_orderstatus = 'O' GROUP BY 1""",
    "win_fixed": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start_s, count(*) AS n FROM events GROUP BY 1",
    "win_sliding": """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 - back * 3600 AS start_s, count(*) AS n
        FROM events, (VALUES (0), (1)) v(back) GROUP BY 1""",
    "win_session": """SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s,
        CAST(floor(epoch(max(ts))) AS BIGINT) + 1800 AS end_s, count(*) AS n FROM (
          SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session
          FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE
                THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""",
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "top_per_key": """SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
        WHERE rank <= 3""",
    "wordcount_metrics": f"""SELECT CAST(sum(len(list_filter(regexp_extract_all(line, '[a-zA-Z]+(''[a-z])?', 0), lambda x: strlen(x) < 4))) AS BIGINT) AS small_words,
        count(*) AS line_len_count, CAST(sum(strlen(line)) AS BIGINT) AS line_len_sum, min(strlen(line)) AS line_len_min, max(strlen(line)) AS line_len_max,
        CAST(sum(CASE WHEN trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_lines FROM ({_LINES})""",
    "metrics_counter": "SELECT count(*) AS rows, count(*) FILTER (event_type = 'click') AS clicks FROM events",
    "combine_add_merge": "SELECT p_brand AS key, CAST(sum(length(p_name)) AS BIGINT) AS letters FROM part GROUP BY 1",
    "combine_merge_extract": "SELECT p_brand AS key, '<' || CAST(sum(p_size) AS VARCHAR) || '>' AS total FROM part GROUP BY 1",
    "bundle_hooks": "SELECT count(*) AS n FROM orders",
    "multiplex": """SELECT 'all' AS key, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders
        UNION ALL SELECT 'dear', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_totalprice > 200000
        UNION ALL SELECT 'mod', count(*), CAST(sum(o_orderkey % 7) AS BIGINT) FROM orders""",
    "stateful_combining": f"""SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events""",
    "stateful_map": f"SELECT user_id, event_id, row_number() OVER {_TYPED} AS n FROM events",
    "stateful_multimap": f"""SELECT user_id, event_id, row_number() OVER {_TYPED} AS n,
        first_value(event_id) OVER {_TYPED} AS first FROM events""",
    "synthetic_records": "SELECT CAST(1000 AS BIGINT) AS n, CAST(12000 AS BIGINT) AS key_bytes, CAST(100000 AS BIGINT) AS value_bytes, CAST(1000 AS BIGINT) AS keys",
    "synthetic_repeats": "SELECT s_suppkey, CAST(4 AS BIGINT) AS n FROM supplier",
    "io_match_files": f"SELECT r_name || '.txt' AS key, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS size FROM {_FILES} WHERE r_name LIKE 'A%' GROUP BY 1",
    "io_match_all": f"""SELECT r_name || '.txt' AS key, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS size FROM {_FILES}
        WHERE r_name LIKE 'A%' OR r_name = 'EUROPE' GROUP BY 1""",
    "io_read_matches": f"SELECT r_name || '.txt' AS key, string_agg(n_name || chr(10), '' ORDER BY n_name) AS content FROM {_FILES} GROUP BY 1",
    "io_read_text": f"SELECT n_name AS value FROM {_FILES}",
    "io_read_all": f"SELECT n_name AS value FROM {_FILES} WHERE r_name = 'AMERICA' OR r_name LIKE 'AS%'",
    "io_read_with_filename": f"SELECT r_name || '.txt' AS key, n_name AS value FROM {_FILES}",
    "io_write_single": "SELECT c_name || ': ' || c_mktsegment AS value FROM customer",
    "io_immediate": "SELECT r_name AS value FROM region",
    "join_inner": f"SELECT c.key, c_nationkey, o_orderkey FROM {_PAIRS.format('')}",
    "join_left": f"SELECT c.key, c_nationkey, o_orderkey FROM {_PAIRS.format('LEFT')}",
    "join_full": f"SELECT coalesce(c.key, o.key) AS key, c_nationkey, o_orderkey FROM {_PAIRS.format('FULL')}",
    "join_anti": "SELECT c_custkey AS key, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "set_intersect": "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_except": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders",
    "agg_rollup": f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS level,
        {_SUMS} ROLLUP (l_returnflag, l_linestatus)""",
    "agg_cube": f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS level,
        {_SUMS} CUBE (l_returnflag, l_linestatus)""",
    "agg_grouping_sets": """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
    "agg_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1",
    "asof_join": """SELECT p.user_id, p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS click_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
        ON p.user_id = c.user_id AND c.ts <= p.ts GROUP BY 1, 2""",
    "range_join": """SELECT p_partkey, band FROM part JOIN (VALUES ('low', 0, 10), ('mid', 5, 30), ('high', 30, 1000)) b(band, low, high)
        ON low <= p_size AND p_size < high""",
    "group_into_batches": """SELECT key, batch, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS list FROM (
        SELECT o_custkey AS key, o_orderkey AS v, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS batch
        FROM orders) GROUP BY 1, 2""",
}
