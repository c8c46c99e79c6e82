"""The score lattice: every score that a profile can give, as a table on the driver.

A score is the sum of the weights of equal features over the sum of applicable
ones. Identifiers and labels apply if either node has one; signatures and child
signatures always do. Six bits say what applies and what is equal, so a score is
a lookup, with no arithmetic on the cluster and no drift.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from arboris.profiles import Matching

#: Bits of a mask.
ID_APPLIES, LABEL_APPLIES, ID, SIGNATURE, LABEL, CHILDREN = (1 << i for i in range(6))
_FEATURE = {ID: "PERSISTENT_ID", SIGNATURE: "SEMANTIC_SIGNATURE", LABEL: "NORMALIZED_LABEL", CHILDREN: "WEIGHTED_SIMILARITY"}
_COLUMN = {ID: "persistent_id", SIGNATURE: "signature", LABEL: "label", CHILDREN: "child_signature"}


def score_of(mask: int, profile: Matching) -> float:
    applies = [(b, profile.weight(f)) for b, f in _FEATURE.items() if b not in (ID, LABEL) or mask & (ID_APPLIES if b == ID else LABEL_APPLIES)]
    total = sum(w for _, w in applies if w > 0)
    return round(sum(w for b, w in applies if w > 0 and mask & b) / total, 6) if total > 0 else 0.0


def table(profile: Matching) -> list[float]:
    return [score_of(m, profile) for m in range(64)]


def blocking_keys(profile: Matching) -> list[tuple[str, ...]]:
    """Fewest sets of columns such that each pair scoring at least the probable threshold agrees on one of them."""
    enough = []
    for bits in product((0, 1), repeat=4):
        equal = [b for b, on in zip(_FEATURE, bits) if on]
        applies = [ID_APPLIES * x | LABEL_APPLIES * y for x, y in product((0, 1), repeat=2)]
        fit = [m for m in applies if not (ID in equal and not m & ID_APPLIES) and not (LABEL in equal and not m & LABEL_APPLIES)]
        if any(score_of(m | sum(equal), profile) >= profile.probable_threshold for m in fit):
            enough.append(frozenset(equal))
    least = [s for s in enough if not any(t < s for t in enough)]
    return sorted(tuple(_COLUMN[b] for b in _FEATURE if b in s) for s in least)


def mask(s: str = "s", t: str = "t") -> Column:
    """Mask of two joined nodes whose evidence columns are prefixed with ``s_`` and ``t_``."""
    out = F.lit(0)
    for bit, name in ((ID_APPLIES, "persistent_id"), (LABEL_APPLIES, "label")):
        out = out + F.when(F.col(f"{s}_{name}").isNotNull() | F.col(f"{t}_{name}").isNotNull(), bit).otherwise(0)
    for bit, name in _COLUMN.items():
        out = out + F.when(F.col(f"{s}_{name}") == F.col(f"{t}_{name}"), bit).otherwise(0)
    return out


def score(mask_column: Column, profile: Matching) -> Column:
    return F.get(F.array(*(F.lit(float(x)) for x in table(profile))), mask_column)


def evidence(mask_column: Column, profile: Matching) -> Column:
    """Codes of the features that count for a pair."""
    codes = [F.when(mask_column.bitwiseAND(b) != 0, F.lit(f)) for b, f in _FEATURE.items() if profile.weight(f) > 0]
    return F.filter(F.array(*codes), lambda x: x.isNotNull()) if codes else F.array().cast("array<string>")
