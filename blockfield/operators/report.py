"""Stream volume and timing per frame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfield.functions import constants as C


def volume_report(trace: DataFrame, inputs: DataFrame = None) -> DataFrame:
    """Words per stage, span, bubbles, stalls and latency from a ``cycle`` column.

    All of it is closed-form over counts and extrema: bubbles are the span minus the words in it, so beats are
    never ordered.
    """
    stage = lambda n: F.count_if(F.col("stage") == C.STAGES[n])
    out = trace.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("words"), stage("DcTokens").alias("dc_words"), stage("AcStrategy").alias("strategy_words"),
        stage("AcMetadataTokens").alias("metadata_words"), stage("AcTokens").alias("ac_words"),
        F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"),
    ).withColumn("span", F.col("last_cycle") - F.col("first_cycle") + 1)
    out = out.withColumn("bubbles", F.col("span") - F.col("words"))
    if inputs is None:
        return out
    taken = inputs.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("input_words"), F.min("cycle").alias("_in0"), F.max("cycle").alias("_in1")
    ).withColumn("input_span", F.col("_in1") - F.col("_in0") + 1)
    return out.join(taken, "frame_id").select(
        *out.columns, "input_words", "input_span", (F.col("input_span") - F.col("input_words")).alias("stalls"),
        (F.col("first_cycle") - F.col("_in1")).alias("first_output_latency"),
        (F.col("last_cycle") - F.col("_in0") + 1).alias("total_cycles"),
    )
