from rowproof.provenance.citations import Citations, check_citations, cited_rows, publish_with, require_citations
from rowproof.provenance.diff import (
    cell_diff, field_diff, filter_diff, is_filter_lineage, multiset_cells, multiset_diff, row_diff)
from rowproof.provenance.trace import (
    Stage, closure, contributor_rows, contributors, trace_row, trace_rows)

__all__ = ["Citations", "Stage", "cell_diff", "check_citations", "cited_rows", "closure", "contributor_rows",
           "contributors", "field_diff", "filter_diff", "is_filter_lineage", "multiset_cells",
           "multiset_diff", "publish_with", "require_citations", "row_diff", "trace_row", "trace_rows"]
