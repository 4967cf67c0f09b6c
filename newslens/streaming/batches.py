"""Rows of one key in a micro-batch. A key often has a row or two, for which frames cost far more than lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[list]:
    """Values of each of `columns`, by `event_id`."""
    held = [f for f in frames if len(f)]
    values = {c: [f[c].to_numpy() for f in held] for c in ["event_id", *columns]}
    whole = {c: v[0] if len(v) == 1 else np.concatenate(v) for c, v in values.items()}
    order = np.argsort(whole["event_id"], kind="stable")
    return [whole[c][order].tolist() for c in columns]
