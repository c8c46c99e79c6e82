"""Longest-common-subsequence alignment of two sequences, as a column function."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of equal items whose changes are logged at a time.
MATCHES = 1 << 22
ALIGN, LEFT_ONLY, RIGHT_ONLY = "ALIGN", "LEFT_ONLY", "RIGHT_ONLY"


def edit_script(left: list, right: list) -> list[tuple[str, int | None, int | None]]:
    """Steps (kind, left index, right index); on a tie the left item goes first.

    Going up from the last left item, the shortest end of ``right`` that has a common subsequence of each length with what is
    left of ``left`` is held in one ascending list; an item changes it at the places of its equals only, and the
    changes are logged. Going down again undoes them, so that each step knows by one search whether leaving out the left
    item costs a match. Memory follows the lists and a stretch of at most MATCHES pairs of equals; between such
    stretches the list itself is held, and a stretch's log is made again when the way down comes to it.
    """
    n, m = len(left), len(right)
    places: dict = {}
    for j, x in enumerate(right):
        places.setdefault(x, []).append(m - j)  # descending lengths of the ends of ``right`` that begin with x
    least: list[int] = []  # by length - 1 of a common subsequence: the shortest such end

    def row(i: int, log: list | None) -> None:
        for end in places.get(left[i], ()):
            k = bisect_left(least, end)
            if k == len(least):
                least.append(end)
                old = 0
            elif least[k] == end:
                continue
            else:
                old, least[k] = least[k], end
            if log is not None:
                log.append((i, k, old))

    bounds, held = [n], 0  # stretches of rows, from the last
    for i in range(n - 1, -1, -1):
        held += len(places.get(left[i], ()))
        if held > MATCHES:
            bounds.append(i)
            held = 0
    if bounds[-1] != 0:
        bounds.append(0)
    saved: list[list[int]] = []
    for after, start in zip(bounds, bounds[1:]):
        saved.append(least.copy() if len(bounds) > 2 else [])
        for i in range(after - 1, start - 1, -1):
            row(i, None)
    out: list[tuple[str, int | None, int | None]] = []
    j, best = 0, len(least)
    for (after, start), least_after in zip(reversed(list(zip(bounds, bounds[1:]))), reversed(saved)):
        least, log = least_after, []
        for i in range(after - 1, start - 1, -1):
            row(i, log)
        for i in range(start, after):
            while log and log[-1][0] == i:
                _, k, old = log.pop()
                if old:
                    least[k] = old
                else:
                    least.pop()
            while True:
                if j < m and left[i] == right[j]:
                    out.append((ALIGN, i, j))
                    j, best = j + 1, best - 1
                elif j >= m or bisect_right(least, m - j) == best:
                    out.append((LEFT_ONLY, i, None))
                else:
                    out.append((RIGHT_ONLY, None, j))
                    j += 1
                    continue
                break
    out.extend((RIGHT_ONLY, None, k) for k in range(j, m))
    return out


_STEPS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("left", T.IntegerType()).add("right", T.IntegerType()))


@F.pandas_udf(_STEPS)
def lcs_align(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit script of two array columns; a null array is empty."""
    pairs = zip(left, right)
    return pd.Series([[{"kind": k, "left": i, "right": j} for k, i, j in edit_script([] if x is None else list(x), [] if y is None else list(y))] for x, y in pairs])
