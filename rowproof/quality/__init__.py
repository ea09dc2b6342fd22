from rowproof.quality.profile import output_shape, profile, profile_source, value_counts
from rowproof.quality.validate import (
    check_counts, check_keys, rollup_issues, stage_status, validate)

__all__ = ["check_counts", "check_keys", "output_shape", "profile", "profile_source",
           "rollup_issues", "stage_status", "validate", "value_counts"]
