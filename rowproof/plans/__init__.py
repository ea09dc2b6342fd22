from rowproof.plans.workflow import (
    Run, StageDef, Workflow, grain_blockers, preview, run_slice, slice_run)

__all__ = ["Run", "StageDef", "Workflow", "grain_blockers", "preview", "run_slice", "slice_run"]
