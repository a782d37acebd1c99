"""Functions over groups that degrade instead of failing: what goes wrong with one recording stays with it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd


def guarded(run: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str], default: dict) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``run`` with a column ``error``; a group on which it raises gives its keys, ``default`` and what was raised."""

    def safe(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf).assign(error=None)
        except Exception as e:  # noqa: BLE001 - any failure is the recording's own
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **default, "error": f"{type(e).__name__}: {e}"}])

    return safe


def schema(df, keys: list[str], columns: str) -> str:
    """The schema of a guarded function over ``df``: its keys, ``columns`` and ``error``."""
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {columns}, error string"
