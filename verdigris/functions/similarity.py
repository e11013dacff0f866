"""Order-insensitive text similarity: 2 * LCS / (m + n) of the sorted words."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def sorted_words(c: Column) -> Column:
    """The words in order of their characters, joined by one space."""
    return F.array_join(F.sort_array(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), " ")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        return 2.0 * common_length(x, y) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Similarity in [0, 1] by Arrow batches; two empty texts are alike."""
    return _similarity(sorted_words(a), sorted_words(b))


_SCORED = ArrayType(StructType([StructField("s", DoubleType()), StructField("i", IntegerType()), StructField("j", IntegerType())]))


#: Scores of different pairs that a batch keeps.
_KEPT = 100_000


@F.arrow_udf(_SCORED)
def _pair_scores(a: pa.Array, b: pa.Array) -> pa.Array:
    ends, scores, first, second = [0], [], [], []
    kept: dict[tuple, float] = {}
    for xs, ys in zip(a.to_pylist(), b.to_pylist(), strict=True):
        for i, x in enumerate(xs or ()):
            for j, y in enumerate(ys or ()):
                score = kept.get((x, y))
                if score is None:
                    score = -1.0 if x == y else -2.0 * common_length(x, y) / (len(x) + len(y)) if x and y else -0.0
                    if len(kept) >= _KEPT:
                        kept.clear()
                    kept[x, y] = score
                scores.append(score)
                first.append(i)
                second.append(j)
        ends.append(len(scores))
    pairs = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=["s", "i", "j"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def pair_scores(a: Column, b: Column) -> Column:
    """ARRAY<STRUCT<s, i, j>>: minus the similarity of every item of one array with every one of the other, by Arrow batches."""
    return _pair_scores(F.transform(a, sorted_words), F.transform(b, sorted_words))
