from rowproof.operators.aggregate import Agg, aggregate
from rowproof.operators.filter import filter_rows, read_cell, rows_at, search_rows, top, window
from rowproof.operators.join import align, enrich, expand, key_coverage
from rowproof.operators.project import (
    check_writes, extend, map_frames, map_rows, narrow, refuse_where, replace, row_errors,
    rule_branches, trim)
from rowproof.operators.reshape import SortKey, dedupe, explode_rows, sort_rank, union

__all__ = [
    "Agg", "SortKey", "aggregate", "align", "check_writes", "dedupe", "enrich", "expand",
    "explode_rows", "extend", "filter_rows", "key_coverage", "map_frames", "map_rows", "narrow",
    "read_cell", "refuse_where", "replace", "row_errors", "rows_at", "rule_branches",
    "search_rows", "sort_rank", "top", "trim", "union", "window",
]
