"""Persisted outputs of the analysis, written as tables.

The analysis hands its stages over through saved tables: active accounts
and the expansion universe, the account feature table, the scored accounts
and the final target list. ``write_outputs`` produces the same set from one
scoring run (the feature table is materialised once and read by the rest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import profile, targets
from ..operators.scoring import ScoringRun
from ..sources.fixtures import Tables
from ..sources.readers import write_table


def output_tables(t: Tables, run: ScoringRun | None = None) -> dict[str, DataFrame]:
    run = run or ScoringRun.shared(t)
    return {
        "active_accounts": profile.active_accounts(t),
        "expansion_universe": profile.expansion_universe(t),
        "account_features": run.features,
        "scored_accounts": run.scored_accounts,
        "expansion_target_list": targets.target_list(run),
    }


def write_outputs(t: Tables, out_dir: str, fmt: str = "parquet",
                  run: ScoringRun | None = None) -> dict[str, str]:
    """Write every output table under ``out_dir``; returns name -> path."""
    paths = {}
    for name, df in output_tables(t, run).items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_table(df, path, fmt=fmt)
        paths[name] = path
    return paths
