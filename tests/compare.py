"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import pandas as pd


def same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        wrong = [(x, y) for x, y in zip(a[c], b[c]) if not (pd.isna(x) and pd.isna(y) if pd.isna(x) or pd.isna(y) else x == y)]
        assert not wrong, (c, wrong[:3])
