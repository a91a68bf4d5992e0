"""Mixing token streams of several stages to target weights by capped water-filling. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.llm.shared import partitions, staged, word_count

MAX_EPOCHS = 3
SEED = 42
#: Seeded order inside a stage: first this many buckets of the hash, then the hash itself.
BUCKET_DIGITS = 3
#: Copies of a row that are written out in one place.
COPIES = 4096


def _exact(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def stage_targets(sizes: DataFrame, weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(stage, stage_tokens, target DOUBLE) by water-filling: a stage is clamped at ``max_epochs`` times its own tokens and
    what it leaves is shared again by weight until no stage is above its cap.

    ``sizes(stage, stage_tokens)`` and ``weights(stage, weight)`` hold one row per stage; stages are matched null-safely.
    The stages are filled in order of cap over weight: one is clamped if its share of what is left, by weight among it and
    all later ones, reaches its cap.  Shares are compared as exact integers.  Stages without weight, or with a weight that
    is null or not positive, get zero.  The budget is the sum of all tokens of weighted and unweighted stages.
    """
    w = F.when(F.col("weight") > 0, F.col("weight").cast("bigint"))
    rows = sizes.join(weights.select(F.col("stage").alias("_s"), w.alias("weight")), F.col("stage").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumn("_cap", F.when(F.col("weight").isNotNull(), _exact("stage_tokens") * max_epochs).otherwise(_exact(F.lit(0))))
    everything = Window.partitionBy()
    filled = everything.orderBy(F.col("_cap") / F.col("weight"), "stage").rowsBetween(Window.unboundedPreceding, -1)
    later = everything.orderBy(F.col("_cap") / F.col("weight"), "stage").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_left": F.sum(_exact("stage_tokens")).over(everything) - F.coalesce(F.sum("_cap").over(filled), _exact(F.lit(0))),
        "_weights": F.coalesce(F.sum("weight").over(later), F.lit(0)),
    })
    clamped = _exact("_left") * _exact("weight") >= _exact("_cap") * _exact("_weights")
    first = rows.withColumn("_free", F.when(F.col("weight").isNotNull() & ~clamped, F.struct(_exact("_left").alias("tokens"), _exact("_weights").alias("weights"))))
    # The first stage below its cap fixes the level of all later ones.
    order = everything.orderBy(F.col("_cap") / F.col("weight"), "stage").rowsBetween(Window.unboundedPreceding, 0)
    level = first.withColumn("_level", F.first("_free", ignorenulls=True).over(order))
    share = (F.col("_level.tokens") * _exact("weight")).cast("decimal(38,0)").cast("double") / F.col("_level.weights").cast("double")
    target = F.when(F.col("weight").isNull(), F.lit(0.0)).when(F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(share)
    return level.select("stage", "stage_tokens", target.alias("target"))


def mix_streams(streams: DataFrame, weights: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
                key: str = "frame_id", stage: str = "stage", tokens: str = "token_count") -> DataFrame:
    """Take token streams until every stage has its target: whole repetitions of all, a fraction of one more by seeded order.

    ``streams`` holds one row per stream: (frame_id, stage, token_count).  Returns every row's (key, stage, token_count,
    stage_tokens, target, repeats, part, taken): ``repeats`` whole repetitions plus ``part`` tokens of one more, ``taken`` =
    repeats * token_count + part.  The fractional pass walks a stage in the order of md5(seed:key); the stream on its end
    gives the tokens that are missing, so a stage's taken tokens are its target rounded, and none is repeated beyond
    ``max_epochs``.  The walk adds up hash buckets of a stage first and streams inside a bucket then, so a stage that holds
    a third of all rows is spread over its buckets.

    Null stages form a stage; a null or negative token_count counts as zero; a null key has its own place in the order;
    repeated rows count each; other columns are dropped; an empty table gives an empty one.
    """
    n = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    each = streams.select(F.col(key).alias("_key"), F.col(stage).alias("stage"), n.alias("_n"), order.alias("_h"))
    # equal rows are walked as one with their count, so a key that most rows have is as many rows as it has token counts
    rows = each.groupBy("_key", "stage", "_n", "_h").agg(F.count(F.lit(1)).alias("_c")).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("stage", "_bucket").agg(F.sum(F.col("_n") * F.col("_c")).alias("_sum"))
    targets = stage_targets(buckets.groupBy("stage").agg(F.sum("_sum").alias("stage_tokens")), weights, max_epochs)
    before = Window.partitionBy("stage").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(
        targets.withColumnRenamed("stage", "_t"), F.col("stage").eqNullSafe(F.col("_t"))
    ).select(F.col("stage").alias("_s"), F.col("_bucket").alias("_b"), "_start", "stage_tokens", "target")
    inside = Window.partitionBy("stage", "_bucket").orderBy("_h", F.col("_key").cast("string"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(rows.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("_c")).over(inside), F.lit(0))).join(
        starts, F.col("stage").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b"))
    copy = lambda first, n: F.explode(F.sequence(first, first + n - 1)).alias("_i")
    many = placed.where("_c > 1").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1, F.lit(COPIES).cast("bigint"))).alias("_first"))
    many = many.repartition(partitions(streams.sparkSession), "_key", "_n", "_first").select(*placed.columns, copy(F.col("_first"), F.least(F.lit(COPIES), F.col("_c") - F.col("_first"))))
    walked = placed.where("_c = 1").withColumn("_i", F.lit(0).cast("bigint")).unionByName(many).withColumn("_before", F.col("_before") + F.col("_i") * F.col("_n"))
    whole = F.round("target").cast("bigint")
    repeats = F.when(F.col("stage_tokens") > 0, F.expr("_whole div stage_tokens")).otherwise(F.lit(0))
    rest = F.col("_whole") - F.col("repeats") * F.col("stage_tokens") - F.col("_start") - F.col("_before")
    out = walked.withColumn("_whole", whole).withColumn("repeats", repeats).withColumn("part", F.greatest(F.lit(0), F.least("_n", rest)))
    return out.select(
        F.col("_key").alias(key), F.col("stage").alias(stage), F.col("_n").alias(tokens), "stage_tokens", "target", "repeats", "part",
        (F.col("repeats") * F.col("_n") + F.col("part")).alias("taken"))


def cycled_weights(streams: DataFrame, stage: str = "stage", cycle: tuple = (1, 2, 3)) -> DataFrame:
    """(stage, weight): stages in code point order, null last, weigh the numbers of ``cycle`` in turn. One row per stage."""
    place = F.row_number().over(Window.orderBy(F.col("stage").asc_nulls_last())) - 1
    return streams.select(F.col(stage).alias("stage")).distinct().select(
        "stage", F.element_at(F.lit(list(cycle)), (place % len(cycle) + 1).cast("int")).cast("bigint").alias("weight"))


def repeated_rows(artifacts: DataFrame, key: str = "frame_id", content: str = "content", group: str = "stage") -> DataFrame:
    """Artifacts as often as the mix of their words to cycled weights takes them, as whole rows.

    The one artifact a group whose fractional repetition is only partly taken counts from one half of its words on.  Rows are
    told apart by key and a hash of all columns; rows equal in all columns are each taken as often as the one taken most.
    """
    columns = artifacts.columns
    row = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.hex(F.xxhash64(*columns)))
    keyed = artifacts.select("*", row.alias("_key"), word_count(content).alias("_n"))
    streams = staged(keyed.select(F.col("_key").alias("frame_id"), F.col(group).alias("stage"), F.col("_n").alias("token_count")))
    mixed = mix_streams(streams, cycled_weights(streams))
    more = F.when(F.col("part") * 2 >= F.greatest("token_count", F.lit(1)), 1).otherwise(0)
    often = mixed.groupBy(F.col("frame_id").alias("_id")).agg(F.max(F.col("repeats") + more).cast("int").alias("_often"))
    taken = keyed.join(often.where("_often > 0"), F.col("_key") == F.col("_id"))
    return taken.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_often"))).alias("_copy")).select(*columns)
