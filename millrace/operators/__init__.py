"""Transforms, combiners, side inputs, state and ranges, each from DataFrame to DataFrame."""

from .combine import (
    Combiner,
    add_merge,
    builtin,
    combine_globally,
    combine_per_key,
    full_combine,
    merge_extract,
    simple_merge,
)
from .ranges import OffsetRange, RangeTracker, explode_range, process_ranges, split_ranges
from .relational import (
    as_of_join,
    cube,
    distinct,
    except_,
    group_into_batches,
    grouping_sets,
    intersect,
    interval_join,
    join,
    rollup,
    top_per_key,
)
from .side import as_side_iter, as_side_map
from .state import StatefulFn, stateful_par_do
from .transforms import (
    DoFn,
    co_group_by_key,
    compose,
    create,
    expand,
    filter_,
    flat_map,
    flatten,
    group_by_key,
    impulse,
    map_,
    par_do,
    partition,
    reshuffle,
)

__all__ = [
    "Combiner", "DoFn", "OffsetRange", "RangeTracker", "StatefulFn", "add_merge", "as_of_join", "as_side_iter",
    "as_side_map", "builtin", "co_group_by_key", "combine_globally", "combine_per_key", "compose", "create", "cube",
    "distinct", "except_", "expand", "explode_range", "filter_", "flat_map", "flatten", "full_combine",
    "group_by_key", "group_into_batches", "grouping_sets", "impulse", "intersect", "interval_join", "join", "map_",
    "merge_extract", "par_do", "partition", "process_ranges", "reshuffle", "rollup", "simple_merge", "split_ranges",
    "stateful_par_do", "top_per_key",
]
