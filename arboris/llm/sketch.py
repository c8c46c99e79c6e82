"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

The sketch of a text holds the hash of every five-word shingle that falls below
a fixed fraction of the hash space. The fraction is the same for all documents,
so sketches of texts of very unequal length can be compared, united and
intersected. A text with shingles of which none falls below keeps its smallest
hash, so that only a text without words has an empty sketch.

Words are split at ASCII white space; a text of fewer than five words is one
shingle. Defined results: null is the empty text; two empty sketches are alike
(1.0), an empty and a non-empty one are not (0.0); where a sketch is a smallest
hash alone, containment is all or nothing and no estimate; equal texts have
equal sketches; repeated rows and rows of equal or null doc_id are documents of
their own, next to each other in order of text; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hash in FRACTION is kept.
FRACTION = 4
_LIMIT = -(2**63) + 2**64 // FRACTION


def _of_words(words: Column) -> Column:
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    rows = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(rows, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    hashes = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < 5, whole).otherwise(hashes)
    return hashes


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of one column. Each step is a column of its own, so that it is computed once."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return (
        df.withColumn("_words", words).withColumn("_hashes", _of_words(F.col("_words"))).drop("_words")
        .withColumn("_low", F.filter("_hashes", lambda h: h < F.lit(_LIMIT)))
        .withColumn("_low", F.when((F.size("_low") > 0) | (F.size("_hashes") == 0), F.col("_low")).otherwise(F.array(F.array_min("_hashes"))))
        .drop("_hashes").withColumn(name, F.sort_array(F.array_distinct("_low"))).drop("_low")
    )


def fingerprint(sketch_column: Column) -> Column:
    """The sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch_column, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the two texts' shingles taken together."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(_LIMIT))
    return F.when((F.size(low) > 0) | (F.size(both) == 0), low).otherwise(F.slice(both, 1, 1))


def _range_of(key: Column, rows: Column) -> Column:
    """Number of the range that ``key`` is in: how many bounds are at or below it. ``rows`` holds the bounds in
    rows of equal length (the last may be shorter), so that it takes two steps of about the root of their number."""
    outer = F.size(F.filter(rows, lambda r: F.get(r, F.lit(0)) <= key))
    inner = F.size(F.filter(F.coalesce(F.get(rows, outer - 1), F.array().cast("array<bigint>")), lambda b: b <= key))
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * F.size(F.get(rows, F.lit(0))) + inner)


def ranges_for(df: DataFrame, text: str = "text", bytes_each: int = 4 << 20, rows_each: int = 2048) -> int:
    """How many key ranges hold about so many bytes of text, or rows, each."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, min(max(-(-size // bytes_each), -(-n // rows_each)), 1 << 20))


def with_next(df: DataFrame, key: str, columns: list[str], ranges: int) -> DataFrame:
    """``df`` with ``next_<c>`` of each column: its value in the next row by ``key``, after the last row that of the first.

    Rows are dealt into ``ranges`` key ranges whose bounds are keys that occur; the row at each
    bound also goes to the range before, where it only serves as the next row of the last one.
    So the rows move once and no task sees more than a few ranges. The bounds are found by one
    pass over the keys and are a value of the plan, not rows that the driver handles. Null keys
    come first; rows of equal keys are ordered by the other columns.
    """
    k = F.col(key)
    shares = F.lit(np.arange(1, max(2, ranges)) / ranges)  # one value, however many
    edges = df.agg(F.min(k).alias("low"), F.percentile_approx(k, shares, F.lit(min(100 * ranges, 10**8))).alias("q"), F.max(k.isNull()).alias("nulls"))
    bounds = F.array_sort(F.array_distinct(F.filter(F.coalesce("q", F.array().cast("array<bigint>")), lambda b: b > F.col("low"))))
    edges = edges.select("low", bounds.alias("bounds"), F.coalesce("nulls", F.lit(False)).alias("nulls"))
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("bounds"))).cast("int"))
    cut = F.when(F.size("bounds") > 0, F.transform(F.sequence(F.lit(0), F.size("bounds") - 1, step), lambda i: F.slice("bounds", i + 1, step)))
    edges = edges.select(F.struct("low", "nulls", F.size("bounds").alias("last"), F.coalesce(cut, F.array().cast("array<array<bigint>>")).alias("rows")).alias("e"))
    df = df.withColumn("_e", edges.scalar())
    e = F.col("_e")
    at = F.coalesce(_range_of(k, e["rows"]), F.lit(0))
    first = F.when(e["nulls"], k.isNull()).otherwise(k.eqNullSafe(e["low"]))  # the row that follows the last one
    own = F.struct(at.alias("range"), F.lit(0).alias("side"))
    bound = F.exists(F.filter(e["rows"], lambda r: F.get(r, F.lit(0)) <= k), lambda r: (F.element_at(r, -1) >= k) & F.array_contains(r, k))
    before = F.when(bound, F.struct((at - 1).alias("range"), F.lit(1).alias("side")))
    wrapped = F.when(first, F.struct(e["last"].alias("range"), F.lit(2).alias("side")))
    dealt = df.withColumn("_at", F.explode(F.filter(F.array(own, before, wrapped), lambda x: x.isNotNull()))).drop("_e")
    dealt = dealt.repartition(-(-ranges // 4), F.col("_at.range"))  # several ranges a task, so that tasks are alike
    w = Window.partitionBy("_at.range").orderBy(F.col("_at.side"), F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in columns))
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out.where(F.col("_at.side") == 0).drop("_at")


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter is replaced by the beginning of the next text."""
    ranges = ranges or ranges_for(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = with_sketch(docs.select("doc_id", text.alias("text")), "text", "sketch")
    rows = with_next(base, "doc_id", ["text", "sketch"], ranges)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select(
        "doc_id", n.alias("n_chars"), "sketch", "next_sketch",
        F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut)).alias("edited"),
    )
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
