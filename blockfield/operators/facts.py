"""Bundle documents as long facts, and rules over them.

A fact is (frame_id, source, field, value): what one document, log or stream of a frame says about one field.  Fields are named
``group.name``.  However many sources state a field, one grouping by (frame_id, field) finds whether they agree, who states
it and what the extremes are; rules are rows that are evaluated on that grouping.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = ["frame_id", "source", "field", "value"]
#: Rule kinds: what ``argument`` holds.
AGREE, REQUIRED, EQUALS, ONE_OF, AT_LEAST, AT_MOST, ABSENT, SAME_AS = "agree", "required", "equals", "one_of", "at_least", "at_most", "absent", "same_as"


def facts_of(rows: DataFrame, source: str, **fields: str | Column) -> DataFrame:
    """Facts from columns: ``group__name=column`` states the field group.name; null columns state nothing."""
    pairs = [F.struct(F.lit(name.replace("__", ".")).alias("field"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value")) for name, c in fields.items()]
    return rows.select("frame_id", F.lit(source).alias("source"), F.inline(F.array(*pairs))).where("value IS NOT NULL")


def map_facts(rows: DataFrame, source: str, group: str, entries: str) -> DataFrame:
    """Facts from a map column: every key is a field of the group."""
    each = rows.select("frame_id", F.explode(entries).alias("k", "v")).where("v IS NOT NULL")
    return each.select("frame_id", F.lit(source).alias("source"), F.concat(F.lit(group + "."), F.col("k")).alias("field"), F.col("v").cast("string").alias("value"))


def pair_facts(rows: DataFrame, source: str, group: str, name: str, value: str) -> DataFrame:
    """Facts from rows of a name and a value, such as a register log or digests of artifacts."""
    return rows.where(F.col(value).isNotNull()).select("frame_id", F.lit(source).alias("source"), F.concat(F.lit(group + "."), F.col(name)).alias("field"), F.col(value).cast("string").alias("value"))


def manifest_facts(manifests: DataFrame, source: str = "manifest") -> DataFrame:
    """Facts of manifest rows (read_manifests): frame, stream and discovery fields, registers and checksums."""
    plain = facts_of(manifests, source, document__format="format", frame__xsize="xsize", frame__ysize="ysize", frame__x_tiles="x_tiles", frame__y_tiles="y_tiles",
                     stream__word_count="word_count", discovery__required_capabilities="required_capabilities", discovery__active_route="active_route")
    return plain.unionByName(map_facts(manifests, source, "register", "registers")).unionByName(map_facts(manifests, source, "checksum", "checksums"))


def stream_facts(words: DataFrame, word_bytes: int, source: str = "stream") -> DataFrame:
    """Facts of captured words (frame_id, ordinal, last): counts, and whether last stands on the final word alone."""
    ends = F.max_by("last", "ordinal")
    counted = words.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("last").alias("lasts"), ends.alias("ended"))
    return facts_of(counted, source, stream__word_count="n", stream__byte_count=F.col("n") * word_bytes, stream__last_count="lasts", stream__final_last="ended")


def _stated(facts: DataFrame, sources: list[str]) -> DataFrame:
    """One row per (frame_id, field): least and greatest value with a source each, and a bit per source that states it.

    Values of constant size only, summed up before the shuffle, so a field that one source repeats without end stays one row.
    """
    bit = F.lit(0).cast("bigint")
    for k, s in enumerate(sources):
        bit = F.when(F.col("source") == s, F.lit(1 << k).cast("bigint")).otherwise(bit)
    by = F.struct("value", "source")
    return facts.groupBy("frame_id", "field").agg(F.min(by).alias("least"), F.max(by).alias("greatest"), F.bit_or(bit).alias("held"))


def _said(side: str) -> Column:
    return F.concat(F.col(f"{side}.source"), F.lit("="), F.col(f"{side}.value"))


def _names(bits: Column, sources: list[str]) -> Column:
    return F.concat_ws(",", *[F.when(bits.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.lit(s)) for k, s in enumerate(sources)])


def reconcile(facts: DataFrame, sources: list[str]) -> DataFrame:
    """(frame_id, rule, field, expected, actual) of every field whose sources disagree, found in one shuffle.

    ``expected`` and ``actual`` name the least and the greatest value, each with a source that states it.  A source that
    contradicts itself disagrees like two.  Fields that one source alone states agree; null values are no statement; sources
    beyond those listed take part but are not named as missing.
    """
    apart = _stated(facts, sources).where(F.col("least.value") != F.col("greatest.value"))
    return apart.select("frame_id", F.lit(AGREE).alias("rule"), "field", _said("least").alias("expected"), _said("greatest").alias("actual"))


def evaluate(facts: DataFrame, rules: list[tuple], sources: list[str], expectations: DataFrame = None) -> DataFrame:
    """(frame_id, rule, field, expected, actual) of the rules that do not hold.

    ``rules`` are (field, kind, argument) for every frame that has a fact; a field ``group.*`` stands for the group's stated fields.
    ``expectations`` (frame_id, field, kind, argument) are rules of single frames, also of frames without a fact.  Kinds:
    agree; required (argument: sources, comma-joined, that must state it); equals; one_of (comma-joined); at_least, at_most
    (numbers; what is no number fails); absent; same_as (another field of the frame).  A field that is not stated fails
    required and, for single fields, every kind but absent and agree.
    """
    stated = _stated(facts, sources)
    number = {s: 1 << k for k, s in enumerate(sources)}
    rows = [(f, kind, a, sum(number[x] for x in a.split(",")) if kind == REQUIRED else 0) for f, kind, a in rules]
    each = lambda some: F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.lit(k).alias("kind"), F.lit(a).cast("string").alias("argument"), F.lit(b).cast("bigint").alias("bits")) for f, k, a, b in some]))
    single, grouped = [r for r in rows if not r[0].endswith(".*")], [r for r in rows if r[0].endswith(".*")]
    due = None
    if single:
        due = stated.select("frame_id").distinct().select("frame_id", each(single))
    if expectations is not None:
        bits = F.aggregate(F.split("argument", ","), F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(F.try_element_at(F.create_map(*[x for k, v in number.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), s), F.lit(0)))
        own = expectations.select("frame_id", F.col("field").alias("_field"), "kind", F.col("argument").cast("string").alias("argument"), F.when(F.col("kind") == REQUIRED, bits).otherwise(F.lit(0)).alias("bits"))
        due = own if due is None else due.unionByName(own)
    met = stated.withColumn("_field", F.col("field")).withColumn("stated", F.lit(True))
    checked = None
    if due is not None:
        checked = due.join(met.drop("field"), ["frame_id", "_field"], "left")
    if grouped:
        family = F.concat(F.substring_index("field", ".", 1), F.lit(".*"))
        wide = stated.select("frame_id", "field", "least", "greatest", "held", F.lit(True).alias("stated"), each(grouped)).where(family == F.col("_field"))
        wide = wide.drop("_field").withColumnRenamed("field", "_field")
        checked = wide if checked is None else checked.unionByName(wide.select(*checked.columns))
    other = stated.select("frame_id", F.col("field").alias("argument"), F.col("least.value").alias("_other"))
    checked = checked.join(other, ["frame_id", "argument"], "left")
    low, high, argument = F.col("least.value"), F.col("greatest.value"), F.col("argument")
    as_number = lambda c: c.try_cast("decimal(38,6)")
    within = lambda c, sign: F.coalesce((as_number(c) >= as_number(argument)) if sign > 0 else (as_number(c) <= as_number(argument)), F.lit(False))
    one = F.array_contains(F.split(argument, ","), low) & F.array_contains(F.split(argument, ","), high)
    holds = (
        F.when(F.col("kind") == ABSENT, F.col("stated").isNull()).when(F.col("kind") == AGREE, F.coalesce(low == high, F.lit(True)))
        .when(F.col("stated").isNull(), F.lit(False)).when(F.col("kind") == REQUIRED, F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"))
        .when(F.col("kind") == EQUALS, (low == argument) & (high == argument)).when(F.col("kind") == ONE_OF, one)
        .when(F.col("kind") == AT_LEAST, within(low, 1) & within(high, 1)).when(F.col("kind") == AT_MOST, within(low, -1) & within(high, -1))
        .when(F.col("kind") == SAME_AS, F.coalesce((low == F.col("_other")) & (high == F.col("_other")), F.lit(False)))
    )
    said = F.when(F.col("stated").isNull(), F.lit("missing")).when(F.col("kind") == REQUIRED, _names(F.col("held"), sources)).when(low == high, low).otherwise(F.concat_ws(" ", _said("least"), _said("greatest")))
    wanted = F.when(F.col("kind") == SAME_AS, F.coalesce("_other", F.lit("missing"))).when(F.col("kind") == AGREE, F.lit("one value")).otherwise(F.coalesce(argument, F.lit("missing")))
    return checked.where(~F.coalesce(holds, F.lit(False))).select("frame_id", F.col("kind").alias("rule"), F.col("_field").alias("field"), wanted.alias("expected"), said.alias("actual"))
