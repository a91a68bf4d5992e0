"""Expected against actual: tokens, grids, bytes, numeric tolerance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM = ["frame_id", "stream"]
BYTE_CHUNK = 4096


def compare_runs(expected: DataFrame, actual: DataFrame, max_value_delta: int = 0) -> DataFrame:
    """One verdict per (frame_id, stream) from (frame_id, stream, ordinal, context, value) tables.

    A length difference is reported alone: values are then not compared.  Contexts must be equal, values may
    differ by ``max_value_delta``.  The join key includes the ordinal, so a huge stream spreads over all tasks.
    A stream in which an ordinal occurs twice on either side gets the verdict ``duplicate``; lengths count all rows and
    of equal ordinals the least (context, value) stands.
    """
    def side(df, p):
        each = df.groupBy(*STREAM, "ordinal").agg(F.min(F.struct("context", "value")).alias("v"), F.count(F.lit(1)).alias("n"))
        return each.select(*STREAM, "ordinal", F.struct("v.context", "v.value", "n").alias(p))

    both = side(expected, "e").join(side(actual, "a"), [*STREAM, "ordinal"], "full_outer")
    differs = (F.col("e.context") != F.col("a.context")) | (F.abs(F.col("e.value") - F.col("a.value")) > max_value_delta)
    hit = F.coalesce(differs, F.lit(False))
    first = F.min(F.when(hit, F.struct("ordinal", "a", "e")))
    verdict = both.groupBy(*STREAM).agg(
        F.coalesce(F.sum("e.n"), F.lit(0)).alias("len_expected"), F.coalesce(F.sum("a.n"), F.lit(0)).alias("len_actual"),
        F.count_if(hit).alias("_n"), first.alias("_first"), F.coalesce(F.max(F.greatest("e.n", "a.n")) > 1, F.lit(False)).alias("_twice"),
    )
    same = (F.col("len_expected") == F.col("len_actual")) & ~F.col("_twice")
    pick = lambda path: F.when(same, F.col(f"_first.{path}"))
    return verdict.select(
        *STREAM, "len_expected", "len_actual",
        F.when((F.col("len_expected") == 0) | (F.col("len_actual") == 0), F.lit("one_sided"))
        .when(F.col("_twice"), F.lit("duplicate")).when(~same, F.lit("length"))
        .when(F.col("_n") > 0, F.lit("values")).otherwise(F.lit("equal")).alias("verdict"),
        F.when(same, F.col("_n")).alias("mismatches"), pick("ordinal").alias("first_ordinal"),
        pick("a.context").alias("first_actual_context"), pick("a.value").alias("first_actual_value"),
        pick("e.context").alias("first_expected_context"), pick("e.value").alias("first_expected_value"),
    )


def compare_grids(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One verdict per frame from (frame_id, row, col, value) grids; shapes must agree first, and no cell may occur twice."""
    def side(df, p):
        each = df.groupBy("frame_id", "row", "col").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
        return each.select("frame_id", "row", "col", F.struct("value", "row", "col", "n").alias(p))

    both = side(expected, "e").join(side(actual, "a"), ["frame_id", "row", "col"], "full_outer")
    hit = F.coalesce(F.col("e.value") != F.col("a.value"), F.lit(False))
    shape = lambda p: F.struct(F.max(f"{p}.row"), F.max(f"{p}.col"), F.count(p))
    verdict = both.groupBy("frame_id").agg(
        ((shape("e") == shape("a")) & (F.max(F.greatest("e.n", "a.n")) == 1)).alias("same_shape"), F.count_if(hit).alias("_n"),
        F.min(F.when(hit, F.struct("row", "col", "a", "e"))).alias("_first"),
    )
    pick = lambda path: F.when(F.col("same_shape"), F.col(f"_first.{path}"))
    return verdict.select(
        "frame_id", "same_shape", F.when(F.col("same_shape"), F.col("_n")).alias("mismatches"),
        pick("row").alias("first_row"), pick("col").alias("first_col"), pick("a.value").alias("first_actual"),
        pick("e.value").alias("first_expected"),
    )


def mismatch_summary(verdicts: DataFrame) -> DataFrame:
    """Mismatch totals per frame, per stream and overall."""
    return verdicts.rollup("frame_id", "stream").agg(
        F.sum(F.coalesce("mismatches", F.lit(0))).alias("mismatches"),
        F.count_if(F.col("verdict") == "length").alias("length_differences"), F.count(F.lit(1)).alias("streams"),
    )


def worst_frames(verdicts: DataFrame, k: int = 10) -> DataFrame:
    """The k frames with the most mismatches (ties by frame)."""
    totals = verdicts.groupBy("frame_id").agg(F.sum(F.coalesce("mismatches", F.lit(0))).alias("mismatches"))
    return totals.orderBy(F.desc("mismatches"), "frame_id").limit(k)


def first_byte_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, len_expected, len_actual, first_difference) from (key, content BINARY); equal contents yield null.

    When one content is a prefix of the other the offset is the shorter length.  Contents are compared in chunks, and only the
    first unequal chunk is opened, so no list is longer than a chunk or the number of chunks.
    """
    both = expected.select("key", F.col("content").alias("e")).join(actual.select("key", F.col("content").alias("a")), "key", "full_outer")
    shorter = F.least(F.length("e"), F.length("a"))
    size = F.lit(BYTE_CHUNK)
    last = F.greatest(F.floor((shorter - 1) / BYTE_CHUNK).cast("int"), F.lit(0))
    chunk = F.try_element_at(F.filter(F.sequence(F.lit(0), last), lambda i: F.substring("e", i * BYTE_CHUNK + 1, size) != F.substring("a", i * BYTE_CHUNK + 1, size)), F.lit(1))
    both = both.withColumn("_at", F.when(F.col("e") != F.col("a"), chunk) * BYTE_CHUNK)
    offsets = F.filter(
        F.sequence(F.col("_at"), F.greatest(F.least(F.col("_at") + BYTE_CHUNK, shorter) - 1, F.col("_at"))),
        lambda i: (i < shorter) & (F.substring("e", i + 1, F.lit(1)) != F.substring("a", i + 1, F.lit(1))),
    )
    first = F.when(F.col("e") != F.col("a"), F.coalesce(F.try_element_at(offsets, F.lit(1)), shorter))
    return both.select(
        "key", F.length("e").cast("bigint").alias("len_expected"), F.length("a").cast("bigint").alias("len_actual"),
        first.cast("bigint").alias("first_difference"),
    )


def error_bounds(expected: DataFrame, actual: DataFrame, keys: list, group: list) -> DataFrame:
    """Largest absolute and relative difference of ``value`` per group."""
    both = expected.select(*keys, F.col("value").alias("e")).join(actual.select(*keys, F.col("value").alias("a")), keys)
    gap = F.abs(F.col("a") - F.col("e"))
    return both.groupBy(*group).agg(
        F.max(gap).alias("max_absolute"),
        F.max(gap.cast("double") / F.greatest(F.abs("e"), F.lit(1)).cast("double")).alias("max_relative"),
        F.count(F.lit(1)).alias("compared"),
    )


def common_frames(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Frames that both sides have, each once; null is a frame like any other.

    Rows become one per frame and part before any shuffle, and neither side is held as a table to search.
    """
    side = lambda df, bit: df.select("frame_id", F.lit(bit).alias("_side"))
    both = side(expected, 1).unionByName(side(actual, 2)).groupBy("frame_id").agg(F.bit_or("_side").alias("_sides"))
    return both.where(F.col("_sides") == 3).select("frame_id")
