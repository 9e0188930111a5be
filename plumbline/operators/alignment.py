"""Likeness of short sequences: longest common subsequences of frames, lines and tokens, on Arrow batches.

No built-in measures these; pairs come from equality joins, and each is a few dozen items or one line long."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames of a stack that are compared; tokens that make a block.
MOST_FRAMES, LEAST_BLOCK = 64, 3


def common(a: Sequence, b: Sequence) -> int:
    """The length of the longest common subsequence, a row of its table at a time as bits of one integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(quoted: str | None, line: str | None) -> float | None:
    """1 if the line holds the quoted text, else the share of characters that insertions and deletions leave; null for null."""
    if quoted is None or line is None:
        return None
    if quoted == line or (quoted and quoted in line):
        return 1.0
    return 2 * common(quoted, line) / (len(quoted) + len(line))


def anchored(claimed: Sequence[str] | None, observed: Sequence[str] | None) -> int:
    """The longest alignment of two stacks that pairs the first or second claimed frame; 0 if neither is observed."""
    a, b = list(claimed if claimed is not None else ())[:MOST_FRAMES], list(observed if observed is not None else ())[:MOST_FRAMES]
    best = 0
    for i, name in enumerate(a[:2]):
        for j, other in enumerate(b):
            if name == other:
                best = max(best, common(a[:i], b[:j]) + 1 + common(a[i + 1 :], b[j + 1 :]))
    return best


def shared(a: Sequence[str] | None, b: Sequence[str] | None) -> int:
    """The most tokens that blocks of at least LEAST_BLOCK, in the order of both, can match; a longest block taken first may cost more than it gives.

    Row by row of the table of both: run is how long the tokens before a place agree, open the best that ends in a block there, best the best so far."""
    if a is None or b is None:
        return 0
    k = LEAST_BLOCK
    numbers = {x: i for i, x in enumerate(dict.fromkeys((*a, *b)))}
    right = np.array([numbers[x] for x in b], dtype=np.int64)
    none = np.zeros(len(right) + 1, dtype=np.int64)
    run, opened, best = none, none, [none] * k
    for x in a:
        same = right == numbers[x]
        longer, here = none.copy(), none.copy()
        longer[1:] = np.where(same, run[:-1] + 1, 0)
        begun = none.copy()
        begun[k:] = best[0][:-k] + k
        here[1:] = np.where(run[:-1] >= k, np.maximum(opened[:-1] + 1, begun[1:]), begun[1:])
        here[longer < k] = 0
        run, opened, best = longer, here, [*best[1:], np.maximum.accumulate(np.maximum(best[-1], here))]
    return int(best[-1][-1])


@F.pandas_udf(T.DoubleType())
def line_likeness(quoted: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([likeness(q, x) for q, x in zip(quoted, line, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def anchored_alignment(claimed: pd.Series, observed: pd.Series) -> pd.Series:
    return pd.Series([anchored(a, b) for a, b in zip(claimed, observed, strict=True)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def shared_tokens(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([shared(a, b) for a, b in zip(left, right, strict=True)], dtype="int32")
