"""Pandas frames on their way back to Spark."""

from __future__ import annotations

import pandas as pd


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """frame in a form that always converts: Arrow-backed text in several chunks, as joining or filtering batches leaves it,
    and empty columns of a guessed type do not."""
    if frame.empty:
        return frame.astype(object)
    text = [c for c in frame.columns if isinstance(frame[c].dtype, pd.StringDtype)]
    return frame.astype(dict.fromkeys(text, object)) if text else frame
