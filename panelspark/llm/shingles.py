"""Five-word shingles as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

WIDTH = 5


def with_shingles(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds the sorted 64-bit hashes of the text's shingles; a text with fewer words is
    one shingle, one without words has none. Each step is a column of its own: what a
    lambda reads must not be computed anew for each element."""
    df = df.withColumn("__h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    some = F.transform(F.sequence(F.lit(0), F.size("__h") - width), lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(width)]))
    none = F.array().cast("array<bigint>")
    all_ = F.when(F.size("__h") >= width, some).when(F.size("__h") > 0, F.array(F.xxhash64("__h"))).otherwise(none)
    return df.withColumn(out, F.sort_array(all_)).drop("__h")


def with_shingle_texts(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds the distinct shingles themselves, words joined by one space."""
    df = df.withColumn("__w", words(F.col(text)))
    some = F.transform(F.sequence(F.lit(0), F.size("__w") - width), lambda i: F.concat_ws(" ", *[F.get("__w", i + j) for j in range(width)]))
    none = F.array().cast("array<string>")
    all_ = F.when(F.size("__w") >= width, some).when(F.size("__w") > 0, F.array(F.concat_ws(" ", "__w"))).otherwise(none)
    return df.withColumn(out, F.array_distinct(all_)).drop("__w")


def with_minima(df: DataFrame, hashes: str, out: str, bits) -> DataFrame:
    """Adds the least hash of each bin, bins being the hashes' first ``bits`` bits: in a
    sorted array, the elements whose bin isn't that of the element before."""

    def bin_(x):
        return F.call_function("shiftright", x, F.lit(64) - bits if not isinstance(bits, int) else F.lit(64 - bits))

    return df.withColumn(out, F.filter(F.col(hashes), lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(hashes, i - 1)))))
