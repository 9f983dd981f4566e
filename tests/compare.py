"""Order-insensitive comparison of two results."""

from __future__ import annotations

import pandas as pd


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(cell(x.item() if hasattr(x, "item") else x) for x in row) for row in df.itertuples(index=False)), key=str)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _plain(got), _plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q, (x, y)
