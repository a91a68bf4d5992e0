"""Captured traces, comparison, audits, sources, sinks and streams on the traces derived from events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockfield.catalog import inputs as I
from blockfield.catalog.base import register, staged
from blockfield.catalog.sql import CTES
from blockfield.catalog.value_queries import _ROUTE
from blockfield.functions import constants as C
from blockfield.functions.fixed import int_div, lit
from blockfield.operators import audit, compare, facts, report
from blockfield.operators import geometry as G
from blockfield.operators import trace as T
from blockfield.operators.params import literal_table
from blockfield.session import work_dir
from blockfield.sources import binary, sinks, text
from blockfield.streaming.frames import assemble_blocks, beat_gaps, check_ownership, delimit_frames, running_counts

TRACE = ["frame_id", "stage", "group", "index", "value"]
CTES["tokens_e"] = 'SELECT frame_id, stage AS stream, "group" AS ordinal, "index" AS context, value FROM trace'
CTES["tokens_a"] = 'SELECT frame_id, stage AS stream, "group" AS ordinal, "index" AS context, value FROM trace_actual'
CTES["words"] = "SELECT *, event_id % 500 AS ordinal, event_id = max(event_id) OVER (PARTITION BY frame_id) OR event_id % 331 = 0 AS last FROM trace"


def words(s, d):
    """(frame_id, ordinal, data, last): packed events; a last flag too many on every 331st event."""
    t = T.pack_words(I.trace(s, d)).withColumn("ordinal", F.col("event_id") % I.FRAME_EVENTS)
    ends = t.groupBy("frame_id").agg(F.max("event_id").alias("_end"))
    return t.join(ends, "frame_id").select(
        "frame_id", "ordinal", "data", ((F.col("event_id") == F.col("_end")) | (F.col("event_id") % 331 == 0)).alias("last"))


def expected(s, d):
    return I.tokens_of(I.trace(s, d))


def actual(s, d):
    return I.tokens_of(I.trace_actual(s, d))


# ---- decode, extract ------------------------------------------------------------------------------------------

register("job19_decode_trace", """SELECT frame_id, ordinal, stage, "group", "index", value, last,
  CASE WHEN last AND ordinal <> max(ordinal) OVER (PARTITION BY frame_id) THEN 'early_last' WHEN NOT last AND ordinal = max(ordinal) OVER (PARTITION BY frame_id) THEN 'missing_last' ELSE '' END AS errors FROM words""")(
    lambda s, d: T.decode_trace(words(s, d), require_final_last=True).withColumn("errors", F.array_join("errors", ","))
)
register("win09_last_flag", "SELECT frame_id, ordinal, 'early_last' AS last_error FROM words WHERE last AND ordinal < (SELECT max(ordinal) FROM words w WHERE w.frame_id = words.frame_id)")(
    lambda s, d: T.flag_last(words(s, d)).where(F.col("last_error").isNotNull()).select("frame_id", "ordinal", "last_error")
)
register("win01_raster_position", "SELECT s.frame_id, s.p AS ordinal, s.p % f.xsize AS x, s.p // f.xsize AS y FROM samples s JOIN frames f USING (frame_id)")(
    lambda s, d: I.order_samples(s, d).join(I.frames(s, d).select("frame_id", "xsize"), "frame_id").select(
        "frame_id", F.col("p").alias("ordinal"), (F.col("p") % F.col("xsize")).alias("x"), int_div(F.col("p"), F.col("xsize")).alias("y"))
)
register("job20_extract_tokens", "SELECT frame_id, \"group\" AS ordinal, \"index\" AS context, value FROM trace_actual WHERE stage = 11 AND value >= 0")(
    lambda s, d: T.extract_tokens(I.trace_actual(s, d), "AcMetadataTokens")[0]
)
_MISSING = """SELECT DISTINCT t.frame_id, t.stream, t.ordinal FROM tokens_e t WHERE NOT EXISTS (SELECT 1 FROM tokens_a a WHERE a.frame_id = t.frame_id AND a.stream = t.stream AND a.ordinal = t.ordinal)
  AND t.ordinal < (SELECT max(ordinal) FROM tokens_a a WHERE a.frame_id = t.frame_id AND a.stream = t.stream)"""
register("join12_missing", _MISSING)(lambda s, d: T.missing_ordinals(actual(s, d), ["frame_id", "stream"]))
register("top04_first_missing", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, stream ORDER BY ordinal) AS rank FROM ({_MISSING})) WHERE rank <= 8")(
    lambda s, d: T.first_missing(T.missing_ordinals(actual(s, d), ["frame_id", "stream"]), ["frame_id", "stream"])
)
register("job20_token_rejects", f"SELECT frame_id, 'missing' AS rule, CAST(ordinal AS VARCHAR) AS detail FROM ({_MISSING}) WHERE stream = 11")(
    lambda s, d: T.extract_tokens(I.trace_actual(s, d), "AcMetadataTokens")[1]
)
register("job20_negative_group", """SELECT frame_id, 'negative_ordinal' AS rule, '-1' AS detail FROM trace WHERE stage = 11 AND "group" = 0""")(
    lambda s, d: T.extract_tokens(I.trace(s, d).withColumn("group", F.col("group") - 1), "AcMetadataTokens")[1]
)
CTES["grid_in"] = "SELECT frame_id, p AS i, o % 300 - 20 AS v FROM (SELECT o_orderkey // 1440 AS frame_id, o_orderkey % 1440 AS p, o_custkey AS o FROM orders)"


def grid_trace(s, d):
    orders = I.table(s, d, "orders").select(F.expr("o_orderkey div 1440").alias("frame_id"), (F.col("o_orderkey") % 1440).alias("index"), (F.col("o_custkey") % 300 - 20).alias("value"))
    return orders.select("frame_id", lit(C.STAGES["AcStrategy"]).alias("stage"), lit(0).alias("group"), "index", "value")


register("job20_extract_grid", "SELECT g.frame_id, i AS \"index\", v AS value FROM grid_in g JOIN geo f USING (frame_id) WHERE v BETWEEN 0 AND 255 AND i < f.xb * f.yb")(
    lambda s, d: T.extract_grid(grid_trace(s, d), "AcStrategy", I.frames(s, d))[0]
)
register("job20_grid_rejects", """SELECT frame_id, CASE WHEN f_i IS NULL THEN 'index_range' WHEN v IS NULL THEN 'missing' ELSE 'value_range' END AS rule, CAST(coalesce(i, f_i) AS VARCHAR) AS detail FROM (
  SELECT coalesce(g.frame_id, f.frame_id) AS frame_id, g.i, g.v, f.i AS f_i FROM grid_in g FULL JOIN (SELECT frame_id, unnest(range(xb * yb)) AS i FROM geo) f ON f.frame_id = g.frame_id AND f.i = g.i)
  WHERE f_i IS NULL OR v IS NULL OR v NOT BETWEEN 0 AND 255""")(lambda s, d: T.extract_grid(grid_trace(s, d), "AcStrategy", I.frames(s, d))[1])
register("agg12_duplicates", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")(
    lambda s, d: T.duplicates(I.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), ["l_orderkey", "l_linenumber"])
)

# ---- compare --------------------------------------------------------------------------------------------------

CTES["verdicts"] = """SELECT frame_id, stream, len_expected, len_actual,
  CASE WHEN len_expected = 0 OR len_actual = 0 THEN 'one_sided' WHEN len_expected <> len_actual THEN 'length' WHEN n > 0 THEN 'values' ELSE 'equal' END AS verdict,
  CASE WHEN len_expected = len_actual THEN n END AS mismatches, CASE WHEN len_expected = len_actual THEN fo END AS first_ordinal FROM (
  SELECT frame_id, stream, count(ev) AS len_expected, count(av) AS len_actual, count(*) FILTER (ec <> ac OR ev <> av) AS n, min(ordinal) FILTER (ec <> ac OR ev <> av) AS fo FROM (
  SELECT coalesce(e.frame_id, a.frame_id) AS frame_id, coalesce(e.stream, a.stream) AS stream, coalesce(e.ordinal, a.ordinal) AS ordinal, e.context AS ec, a.context AS ac, e.value AS ev, a.value AS av
  FROM tokens_e e FULL JOIN tokens_a a ON e.frame_id = a.frame_id AND e.stream = a.stream AND e.ordinal = a.ordinal) GROUP BY frame_id, stream)"""
register("job21_compare_runs", """SELECT v.*, a.context AS first_actual_context, a.value AS first_actual_value, e.context AS first_expected_context, e.value AS first_expected_value FROM verdicts v
  LEFT JOIN tokens_a a ON a.frame_id = v.frame_id AND a.stream = v.stream AND a.ordinal = v.first_ordinal
  LEFT JOIN tokens_e e ON e.frame_id = v.frame_id AND e.stream = v.stream AND e.ordinal = v.first_ordinal""")(lambda s, d: compare.compare_runs(expected(s, d), actual(s, d)))
register("join11_full_outer_delta", "SELECT frame_id, stream, verdict, CASE WHEN verdict IN ('values', 'equal') THEN CAST(0 AS BIGINT) END AS mismatches FROM (SELECT frame_id, stream, CASE WHEN verdict = 'values' THEN 'equal' ELSE verdict END AS verdict FROM verdicts)")(
    lambda s, d: compare.compare_runs(expected(s, d), actual(s, d), max_value_delta=1).select("frame_id", "stream", "verdict", "mismatches")
)
register("agg14_mismatch_rollup", """SELECT frame_id, stream, CAST(sum(coalesce(mismatches, 0)) AS BIGINT) AS mismatches, count(*) FILTER (verdict = 'length') AS length_differences, count(*) AS streams
  FROM verdicts GROUP BY ROLLUP (frame_id, stream)""")(lambda s, d: compare.mismatch_summary(compare.compare_runs(expected(s, d), actual(s, d))))
register("top05_worst_frames", "SELECT frame_id, CAST(sum(coalesce(mismatches, 0)) AS BIGINT) AS mismatches FROM verdicts GROUP BY frame_id ORDER BY mismatches DESC, frame_id LIMIT 10")(
    lambda s, d: compare.worst_frames(compare.compare_runs(expected(s, d), actual(s, d)))
)


def _grids(s, d, bump):
    t = I.trace(s, d).where("stage = 10")
    value = F.col("value") + (F.col("event_id") % 97 == 0).cast("bigint") * bump
    return t.select("frame_id", int_div(F.col("group"), 12).alias("row"), (F.col("group") % 12).alias("col"), value.alias("value"))


register("job21_compare_grids", """SELECT frame_id, TRUE AS same_shape, count(*) FILTER (bad) AS mismatches, min("group") FILTER (bad) // 12 AS first_row, min("group") FILTER (bad) % 12 AS first_col,
  min_by(value, "group") FILTER (bad) + 1 AS first_actual, min_by(value, "group") FILTER (bad) AS first_expected FROM (SELECT *, event_id % 97 = 0 AS bad FROM trace WHERE stage = 10) GROUP BY frame_id""")(
    lambda s, d: compare.compare_grids(_grids(s, d, 0), _grids(s, d, 1))
)
register("agg16_first_byte", """SELECT event_id AS "key", length(e) AS len_expected, length(a) AS len_actual, CASE WHEN e = a THEN NULL ELSE coalesce((SELECT min(i) FROM (SELECT unnest(range(least(length(e), length(a)))) AS i) WHERE e[i + 1] <> a[i + 1]), least(length(e), length(a))) END AS first_difference
  FROM (SELECT event_id, props AS e, replace(props, '7', CASE WHEN event_id % 2 = 0 THEN '8' ELSE '' END) AS a FROM events)""")(lambda s, d: _bytes(s, d))


def _bytes(s, d):
    e = I.table(s, d, "events")
    swapped = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit("7"), F.lit("8"))).otherwise(F.replace("props", F.lit("7"), F.lit("")))
    left = e.select(F.col("event_id").alias("key"), F.col("props").cast("binary").alias("content"))
    return compare.first_byte_difference(left, e.select(F.col("event_id").alias("key"), swapped.cast("binary").alias("content")))


register("set05_common_frames", "SELECT frame_id FROM trace INTERSECT SELECT frame_id FROM trace_actual")(
    lambda s, d: compare.common_frames(I.trace(s, d), I.trace_actual(s, d))
)
register("set04_except", """SELECT frame_id, stage, value, side FROM (SELECT frame_id, stage, value, 'expected' AS side FROM (SELECT frame_id, stage, value FROM trace EXCEPT ALL SELECT frame_id, stage, value FROM trace_actual)
  UNION ALL SELECT frame_id, stage, value, 'actual' FROM (SELECT frame_id, stage, value FROM trace_actual EXCEPT ALL SELECT frame_id, stage, value FROM trace))""")(
    lambda s, d: audit.set_difference(I.trace(s, d).select("frame_id", "stage", "value"), I.trace_actual(s, d).select("frame_id", "stage", "value"))
)
register("set02_concatenate_inputs", 'SELECT frame_id, stage, "group", "index", value FROM trace UNION ALL SELECT frame_id, stage, "group", "index", value FROM trace_actual')(
    lambda s, d: I.trace(s, d).select(*TRACE).unionByName(I.trace_actual(s, d).select(*TRACE))
)

# ---- volume, routing ------------------------------------------------------------------------------------------

CTES["cycles"] = 'SELECT *, (event_id % 500) * 3 + "index" % 3 + 40 AS cycle FROM trace'
register("agg15_volume", """SELECT o.*, i.input_words, i.input_span, i.input_span - i.input_words AS stalls, o.first_cycle - i.in1 AS first_output_latency, o.last_cycle - i.in0 + 1 AS total_cycles FROM (
  SELECT frame_id, count(*) AS words, count(*) FILTER (stage = 10) AS dc_words, count(*) FILTER (stage = 6) AS strategy_words, count(*) FILTER (stage = 11) AS metadata_words, count(*) FILTER (stage = 12) AS ac_words,
    min(cycle) AS first_cycle, max(cycle) AS last_cycle, max(cycle) - min(cycle) + 1 AS span, max(cycle) - min(cycle) + 1 - count(*) AS bubbles FROM cycles GROUP BY frame_id) o
  JOIN (SELECT frame_id, count(*) AS input_words, min(event_id % 500 * 2) AS in0, max(event_id % 500 * 2) AS in1, max(event_id % 500 * 2) - min(event_id % 500 * 2) + 1 AS input_span FROM trace GROUP BY frame_id) i USING (frame_id)""")(
    lambda s, d: report.volume_report(
        I.trace(s, d).withColumn("cycle", (F.col("event_id") % 500) * 3 + F.col("index") % 3 + 40),
        I.trace(s, d).withColumn("cycle", (F.col("event_id") % 500) * 2))
)
register("job24_volume_report", """SELECT frame_id, stage, count(*) AS words, CAST(max(value) AS BIGINT) AS peak FROM trace GROUP BY frame_id, stage""")(
    lambda s, d: I.trace(s, d).groupBy("frame_id", "stage").agg(F.count(F.lit(1)).alias("words"), F.max("value").alias("peak"))
)
register("job25_route", f"SELECT t.frame_id, t.stage, t.\"group\", t.\"index\", t.value FROM trace t JOIN (SELECT frame_id, {_ROUTE} AS r FROM frames) f ON f.frame_id = t.frame_id AND f.r = t.stage")(
    lambda s, d: T.route_trace(I.frames(s, d), I.trace(s, d).select(*TRACE)).select(*TRACE)
)
register("join14_semi", "SELECT frame_id, stage, \"group\", value FROM trace WHERE frame_id IN (SELECT frame_id FROM frames WHERE distance_q8 <> 300)")(
    lambda s, d: I.trace(s, d).join(I.frames(s, d).where("distance_q8 <> 300").select("frame_id"), "frame_id", "left_semi").select("frame_id", "stage", "group", "value")
)

# ---- word regrouping ------------------------------------------------------------------------------------------

register("src08_rgb_words", "SELECT frame_id, x, y, r - 100 AS r, g - 100 AS g, b - 100 AS b FROM pixels")(
    lambda s, d: T.unpack_rgb_words(T.pack_rgb_words(_shifted(s, d), I.frames(s, d)), I.frames(s, d))
)


def _shifted(s, d):
    return I.pixels(s, d).select("frame_id", "x", "y", *[(F.col(c) - 100).alias(c) for c in "rgb"])


register("snk04_rgb_words", """SELECT p.frame_id, y * xsize + x AS ordinal, (CASE WHEN r < 100 THEN r - 100 + 65536 ELSE r - 100 END) + (CASE WHEN g < 100 THEN g - 100 + 65536 ELSE g - 100 END) * 65536
  + (CASE WHEN b < 100 THEN b - 100 + 65536 ELSE b - 100 END) * 4294967296 AS data, y * xsize + x = xsize * ysize - 1 AS last FROM pixels p JOIN frames f USING (frame_id)""")(
    lambda s, d: T.pack_rgb_words(_shifted(s, d), I.frames(s, d))
)


def record_blocks(s, d):
    params = I.prepared_params(s, d).drop("stripe", "bx", "by", "raw_strategy")
    return I.embedding_blocks(s, d, 65536).select("frame_id", "block", "x", "y", "b").join(params, ["frame_id", "block"])


register("src07_prepared_words", """SELECT frame_id, block, quant, CAST(scale AS BIGINT) AS scale_q16, CAST(inv_qac AS BIGINT) AS inv_qac_q16, CAST(idx AS BIGINT) AS inv_dc_x_q16, ytox, ytob, CAST(sum(x * (k + 1)) AS BIGINT) AS x_sum, CAST(sum(b * (k + 1)) AS BIGINT) AS b_sum, TRUE AS complete
  FROM prepared_in GROUP BY frame_id, block, quant, scale, inv_qac, idx, ytox, ytob""")(lambda s, d: _records(s, d))


def _records(s, d):
    words_ = T.pack_prepared_words(record_blocks(s, d).withColumnRenamed("quant", "quant"))
    weigh = lambda p: F.aggregate(F.transform(F.col(p), lambda v, i: v * (i + 1)), lit(0), lambda a, v: a + v)
    return T.unpack_prepared_words(words_).select(
        "frame_id", "block", "quant", "scale_q16", "inv_qac_q16", "inv_dc_x_q16", "ytox", "ytob", weigh("x").alias("x_sum"), weigh("b").alias("b_sum"), "complete")


register("job22_assemble_blocks", """SELECT q.frame_id, q.block, CAST(day AS BIGINT) AS dc_y, ny AS nonzeros_y, CAST(sum(qy * (k + 1)) AS BIGINT) AS y_sum, '' AS errors FROM prepared_blocks q JOIN prepared_levels l USING (frame_id, block)
  GROUP BY q.frame_id, q.block, day, ny""")(lambda s, d: _assembled(s, d))


def _assembled(s, d):
    from blockfield.catalog.frame_queries import prepared
    from blockfield.operators.quantize import quantized_trace

    rows = T.assemble_quantized_blocks(quantized_trace(prepared(s, d)), I.block_frames(s, d))
    total = F.aggregate(F.transform(F.col("quantized")[1], lambda v, i: v * (i + 1)), lit(0), lambda a, v: a + v)
    return rows.select("frame_id", "block", F.col("dc")[1].alias("dc_y"), F.col("num_nonzeros")[1].alias("nonzeros_y"), total.alias("y_sum"), F.array_join("errors", ",").alias("errors"))


# ---- audits ---------------------------------------------------------------------------------------------------

CTES["manifests"] = """SELECT frame_id, xsize, ysize, xt AS x_tiles, yt + CASE WHEN frame_id % 4 = 3 THEN 1 ELSE 0 END AS y_tiles, xsize * ysize + CASE WHEN frame_id % 3 = 2 THEN 1 ELSE 0 END AS word_count,
  512 + frame_id % 512 AS required_capabilities FROM geo"""


def manifests(s, d):
    """Declared bundle metadata with deliberate errors in some frames."""
    g = G.with_geometry(I.frames(s, d))
    f = F.col("frame_id")
    return g.select("frame_id", "xsize", "ysize", "x_tiles", (F.col("y_tiles") + (f % 4 == 3).cast("bigint")).alias("y_tiles"),
                    (F.col("xsize") * F.col("ysize") + (f % 3 == 2).cast("bigint")).alias("word_count"), (f % 512 + 512).alias("required_capabilities"))


def observed(s, d):
    return I.frames(s, d).select("frame_id", (F.col("frame_id") * 5 % 512 + 512).alias("capabilities"), lit((64 << 16) | 72).alias("max_geometry"))


def rgb_words(s, d):
    w = T.pack_rgb_words(I.pixels(s, d), I.frames(s, d))
    return w.withColumn("last", F.col("last") | ((F.col("ordinal") == 700) & (F.col("frame_id") % 5 == 1)))


def registers(s, d, broken=False):
    r = I.frames(s, d).select("frame_id", F.inline(F.array(
        *[F.struct(F.lit(n).alias("register"), F.col(n).cast("bigint").alias("data")) for n in ("xsize", "ysize", "distance_q8", "fixed_raw_quant")])))
    if not broken:
        return r
    bump = ((F.col("frame_id") % 6 == 2) & (F.col("register") == "distance_q8")).cast("bigint")
    kept = r.withColumn("data", F.col("data") + bump).where(~((F.col("frame_id") % 7 == 3) & (F.col("register") == "ysize")))
    return kept.unionByName(I.frames(s, d).where("frame_id % 8 = 5").select("frame_id", F.lit("build_id").alias("register"), lit(1).alias("data")))


def artifacts(s, d, tampered=False):
    rows = I.table(s, d, "pages").select(F.col("page_id").alias("frame_id"), F.lit("page").alias("artifact"), F.col("html").alias("content"))
    return rows.withColumn("content", F.when(F.col("frame_id") % 9 == 4, F.concat("content", F.lit("!"))).otherwise(F.col("content"))) if tampered else rows


_FINDINGS = {
    "geometry": "SELECT frame_id, 'geometry' AS rule, 'y_tiles' AS field, CAST(yt AS VARCHAR) AS expected, CAST(yt + 1 AS VARCHAR) AS actual FROM geo WHERE frame_id % 4 = 3",
    "words": "SELECT frame_id, 'word_count', 'stream.word_count', CAST(xsize * ysize + 1 AS VARCHAR), CAST(xsize * ysize AS VARCHAR) FROM geo WHERE frame_id % 3 = 2",
    "last": "SELECT frame_id, 'last', 'early_last', 'false', 'true' FROM geo WHERE frame_id % 5 = 1 AND xsize * ysize - 1 > 700",
    "registers": """SELECT frame_id, 'register', 'distance_q8', CAST(distance_q8 AS VARCHAR), CAST(distance_q8 + 1 AS VARCHAR) FROM geo WHERE frame_id % 6 = 2
      UNION ALL SELECT frame_id, 'missing_register', 'ysize', CAST(ysize AS VARCHAR), 'missing' FROM geo WHERE frame_id % 7 = 3
      UNION ALL SELECT frame_id, 'unknown_register', 'build_id', 'missing', '1' FROM geo WHERE frame_id % 8 = 5""",
    "capability": """SELECT frame_id, 'capability', 'capabilities', CAST(512 + frame_id % 512 AS VARCHAR), CAST(512 + frame_id * 5 % 512 AS VARCHAR) FROM geo WHERE ((512 + frame_id % 512) & (1023 - (512 + frame_id * 5 % 512))) <> 0
      UNION ALL SELECT frame_id, 'capability', 'max_geometry', xsize || 'x' || ysize, '72x64' FROM geo WHERE xsize > 72 OR ysize > 64""",
    "checksum": "SELECT page_id, 'checksum', 'page', sha256(html), sha256(html || '!') FROM pages WHERE page_id % 9 = 4",
}
register("job23_audit_bundles", " UNION ALL ".join(_FINDINGS.values()))(
    lambda s, d: audit.audit_bundles(manifests(s, d), rgb_words(s, d), registers(s, d), registers(s, d, True), observed(s, d),
                                     audit.checksum(artifacts(s, d)), artifacts(s, d, True))
)
register("job23_discovery", """SELECT frame_id, 'discovery' AS rule, 'build_id' AS field, CAST(distance_q8 AS VARCHAR) AS expected, CAST(distance_q8 + 1 AS VARCHAR) AS actual FROM frames WHERE frame_id % 3 = 1
  UNION ALL SELECT frame_id, 'missing_field', 'active_route', CAST(token_select AS VARCHAR), 'missing' FROM frames WHERE frame_id % 5 = 2
  UNION ALL SELECT frame_id, 'unknown_field', 'serial', 'missing', '9' FROM frames WHERE frame_id % 7 = 4""")(
    lambda s, d: audit.discovery_findings(_discovery(s, d), _discovery(s, d, True))
)


def _discovery(s, d, broken=False):
    f = I.frames(s, d).select("frame_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("bigint").alias("data")) for n, c in (
        ("identity", "xsize"), ("abi_version", "ysize"), ("build_id", "distance_q8"), ("active_route", "token_select"))])))
    if not broken:
        return f
    kept = f.where("NOT (frame_id % 5 = 2 AND field = 'active_route')").withColumn("data", F.col("data") + ((F.col("frame_id") % 3 == 1) & (F.col("field") == "build_id")).cast("bigint"))
    return kept.unionByName(I.frames(s, d).where("frame_id % 7 = 4").select("frame_id", F.lit("serial").alias("field"), lit(9).alias("data")))


_FORMAT = "CASE WHEN frame_id % 4 = 1 THEN 'rgb_manifest.v2' WHEN frame_id % 6 = 2 THEN 'stream_manifest.v1' ELSE 'rgb_manifest.v1' END"
register("job23_formats", f"""SELECT frame_id, 'format' AS rule, CASE WHEN f LIKE 'stream%' THEN 'kind' ELSE 'version' END AS field, CASE WHEN f LIKE 'stream%' THEN 'rgb_manifest' ELSE 'v1' END AS expected, f AS actual
  FROM (SELECT frame_id, {_FORMAT} AS f FROM frames) WHERE f <> 'rgb_manifest.v1'""")(
    lambda s, d: audit.format_findings(I.frames(s, d).withColumn("format", F.expr(_FORMAT)), "rgb_manifest")
)
register("job23_agreement", """SELECT frame_id, 'agreement' AS rule, 'distance_q8' AS field, CAST(distance_q8 AS VARCHAR) AS expected, CAST(distance_q8 + 5 AS VARCHAR) AS actual FROM frames WHERE frame_id % 3 = 0 AND frame_id % 5 <> 1
  UNION ALL SELECT frame_id, 'agreement', 'frame', 'present', 'missing' FROM frames WHERE frame_id % 5 = 1""")(
    lambda s, d: audit.agreement_findings(_index(s, d), _index(s, d).where("frame_id % 5 <> 1").withColumn("distance_q8", F.col("distance_q8") + (F.col("frame_id") % 3 == 0).cast("int") * 5))
)


def _index(s, d):
    return I.frames(s, d).select("frame_id", "xsize", "ysize", "distance_q8", F.col("token_select").alias("active_route"))


register("agg17_checksum", "SELECT page_id AS frame_id, 'page' AS artifact, sha256(html) AS sha256 FROM pages")(lambda s, d: audit.checksum(artifacts(s, d)))
register("join15_manifest_artifacts", "SELECT page_id AS frame_id, 'checksum' AS rule, 'page' AS field, sha256(html) AS expected, sha256(html || '!') AS actual FROM pages WHERE page_id % 9 = 4")(
    lambda s, d: audit.checksum_findings(audit.checksum(artifacts(s, d)), audit.checksum(artifacts(s, d, True)))
)
def _frame_files(s, d, path):
    """One text file a frame: its pixels, a line each, in raster order."""
    line = F.concat_ws(",", "x", "y", "r", "g", "b")
    rows = I.pixels(s, d).select(F.col("frame_id").alias("_of"), "y", "x", line.alias("value")).repartition("_of").sortWithinPartitions("_of", "y", "x")
    rows.select("_of", "value").write.partitionBy("_of").text(path)
    files = audit.file_checksums(s, path)
    return files.select(F.regexp_extract("file", "_of=(-?[0-9]+)", 1).cast("bigint").alias("frame_id"), F.lit("pixels").alias("artifact"), "bytes", "sha256")


CTES["pixel_files"] = "SELECT frame_id, string_agg(x || ',' || y || ',' || r || ',' || g || ',' || b, chr(10) ORDER BY y, x) || chr(10) AS content FROM pixels GROUP BY frame_id"
register("agg17_file_checksums", "SELECT frame_id, 'pixels' AS artifact, strlen(content) AS bytes, sha256(content) AS sha256 FROM pixel_files")(lambda s, d: _frame_files(s, d, work_dir(s)))
SOURCES = ["index", "manifest", "stream", "artifact", "log"]


def _bundle_facts(s, d):
    """Facts of five sources, with planted errors: another distance in every third manifest, a word lost in every fourth
    stream, another digest in every fifth, a register that the log of every seventh frame states twice."""
    f = I.frames(s, d)
    count = F.col("xsize") * F.col("ysize")
    plant = lambda n, k: (F.col("frame_id") % n == k).cast("bigint")
    index = facts.facts_of(f, "index", frame__xsize="xsize", frame__ysize="ysize", frame__distance_q8="distance_q8", trace__route="token_select", stream__word_count=count, stream__byte_count=count * 16)
    manifest = facts.facts_of(f, "manifest", frame__xsize="xsize", frame__ysize="ysize", frame__distance_q8=F.col("distance_q8") + 5 * plant(3, 0), trace__route="token_select",
                              register__xsize="xsize", register__ysize="ysize")
    lost = (F.col("frame_id") % 4 == 1) & F.col("last")
    stream = facts.stream_facts(T.pack_rgb_words(_shifted(s, d), f).where(~lost), 16)
    sums = _frame_files(s, d, work_dir(s))
    declared = sums.withColumn("sha256", F.when(F.col("frame_id") % 5 == 2, F.reverse("sha256")).otherwise(F.col("sha256")))
    log = f.select("frame_id", F.inline(F.array(*[F.struct(F.lit(n).alias("register"), F.col(n).cast("bigint").alias("data")) for n in ("xsize", "ysize")])))
    twice = f.where("frame_id % 7 = 3").select("frame_id", F.lit("ysize").alias("register"), (F.col("ysize") + 1).cast("bigint").alias("data"))
    parts = [index, manifest, stream, facts.pair_facts(declared, "manifest", "checksum", "artifact", "sha256"), facts.pair_facts(sums, "artifact", "checksum", "artifact", "sha256"),
             facts.pair_facts(log.unionByName(twice), "log", "register", "register", "data")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CTES["said_apart"] = """SELECT frame_id, 'frame.distance_q8' AS field, 'index' AS s1, CAST(distance_q8 AS VARCHAR) AS a, 'manifest' AS s2, CAST(distance_q8 + 5 AS VARCHAR) AS b FROM frames WHERE frame_id % 3 = 0
  UNION ALL SELECT frame_id, 'stream.word_count', 'index', CAST(xsize * ysize AS VARCHAR), 'stream', CAST(xsize * ysize - 1 AS VARCHAR) FROM frames WHERE frame_id % 4 = 1
  UNION ALL SELECT frame_id, 'stream.byte_count', 'index', CAST(xsize * ysize * 16 AS VARCHAR), 'stream', CAST(xsize * ysize * 16 - 16 AS VARCHAR) FROM frames WHERE frame_id % 4 = 1
  UNION ALL SELECT frame_id, 'checksum.pixels', 'artifact', sha256(content), 'manifest', reverse(sha256(content)) FROM pixel_files WHERE frame_id % 5 = 2"""
register("join15_reconcile", """SELECT frame_id, 'agree' AS rule, field, CASE WHEN a < b THEN s1 || '=' || a ELSE s2 || '=' || b END AS expected, CASE WHEN a < b THEN s2 || '=' || b ELSE s1 || '=' || a END AS actual FROM said_apart
UNION ALL SELECT frame_id, 'agree', 'register.ysize', CASE WHEN ysize::VARCHAR < (ysize + 1)::VARCHAR THEN 'log=' || ysize ELSE 'log=' || (ysize + 1) END,
  CASE WHEN ysize::VARCHAR < (ysize + 1)::VARCHAR THEN 'log=' || (ysize + 1) ELSE 'manifest=' || ysize END FROM frames WHERE frame_id % 7 = 3""")(
    lambda s, d: facts.reconcile(_bundle_facts(s, d), SOURCES)
)
RULES = [
    ("frame.xsize", "required", "index,manifest"), ("frame.xsize", "at_least", "1"), ("frame.ysize", "at_most", "65535"), ("stream.last_count", "equals", "1"), ("stream.final_last", "equals", "true"),
    ("stream.word_count", "required", "index,stream"), ("checksum.*", "required", "manifest,artifact"), ("checksum.*", "agree", None), ("register.*", "required", "manifest,log"),
    ("register.xsize", "same_as", "frame.xsize"), ("target.board", "absent", None),
]


def _expected(s, d):
    """What a replay expects of single frames: the route of all, and one more column than they have of every sixth."""
    f = I.frames(s, d)
    route = f.select("frame_id", F.lit("trace.route").alias("field"), F.lit("one_of").alias("kind"), F.lit("0,1,2").alias("argument"))
    return route.unionByName(f.where("frame_id % 6 = 0").select("frame_id", F.lit("frame.xsize").alias("field"), F.lit("at_least").alias("kind"), (F.col("xsize") + 1).cast("string").alias("argument")))


register("job23_replay", """SELECT frame_id, 'equals' AS rule, 'stream.last_count' AS field, '1' AS expected, '0' AS actual FROM frames WHERE frame_id % 4 = 1
  UNION ALL SELECT frame_id, 'equals', 'stream.final_last', 'true', 'false' FROM frames WHERE frame_id % 4 = 1
  UNION ALL SELECT frame_id, 'agree', 'checksum.pixels', 'one value', CASE WHEN sha256(content) < reverse(sha256(content)) THEN 'artifact=' || sha256(content) || ' manifest=' || reverse(sha256(content))
    ELSE 'manifest=' || reverse(sha256(content)) || ' artifact=' || sha256(content) END FROM pixel_files WHERE frame_id % 5 = 2
  UNION ALL SELECT frame_id, 'at_least', 'frame.xsize', CAST(xsize + 1 AS VARCHAR), CAST(xsize AS VARCHAR) FROM frames WHERE frame_id % 6 = 0
  UNION ALL SELECT frame_id, 'one_of', 'trace.route', '0,1,2', CAST(token_select AS VARCHAR) FROM frames WHERE token_select NOT IN (0, 1, 2)""")(
    lambda s, d: facts.evaluate(_bundle_facts(s, d), RULES, SOURCES, _expected(s, d))
)
register("join13_unknown_registers", "SELECT event_id, (event_id * 4) % 80 AS address FROM ev WHERE (event_id * 4) % 80 > 60")(lambda s, d: _unknown(s, d))


def _unknown(s, d):
    log = I.table(s, d, "events").select("event_id", (F.col("event_id") * 4 % 80).alias("address"))
    return log.join(F.broadcast(text.register_table(s)), "address", "left_anti").select("event_id", "address")


# ---- sources and sinks: written by Spark from the given tables, read back -------------------------------------


@register("src01_trace_csv", 'SELECT stage, "group", "index", value, \'\' AS errors FROM trace')
def _trace_csv(s, d):
    path = work_dir(s)
    names = literal_table(s, ["stage"], [(v,) for v in range(21)]).select("stage", F.element_at(F.array(*[F.lit(n) for n in C.STAGES]), (F.col("stage") + 1).cast("int")).alias("name"))
    t = I.trace(s, d).join(F.broadcast(names), "stage")
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("0x"), F.hex("stage")))
    t.select(mixed.alias("stage"), "group", F.concat(F.lit("0x"), F.hex("index")).alias("index"), "value").write.option("header", True).csv(path)
    return text.read_trace_csv(s, path).select("stage", "group", "index", "value", F.array_join("_errors", ",").alias("errors"))


@register("src02_words_csv", """SELECT stage, "group", "index", value, last FROM words""")
def _words_csv(s, d):
    path = work_dir(s)
    flag = F.when(F.col("last"), F.lit("Yes")).otherwise(F.lit("f"))
    words(s, d).select(F.col("data").cast("string").alias("TDATA"), flag.alias("TLast")).write.option("header", True).csv(path)
    return T.unpack_words(text.read_words_csv(s, path)).select("stage", "group", "index", "value", "last")


@register("src03_words_bin", """SELECT stage, "group", "index", value, last, ordinal FROM words""")
def _words_bin(s, d):
    path = work_dir(s)
    sinks.write_word_buffers(words(s, d), path)
    return T.unpack_binary(binary.read_words_bin(s, path, 16, ".last")).select("stage", "group", "index", "value", "last", "ordinal")


@register("set02_mixed_formats", """SELECT stage, "group", "index", value, CASE WHEN ordinal % 3 > 0 THEN last END AS last, '' AS errors FROM words""")
def _mixed(s, d):
    """The trace captured in three formats by ordinal: trace CSV, word CSV and binary words."""
    rows, path = words(s, d), work_dir(s)
    I.trace(s, d).where(f"event_id % {I.FRAME_EVENTS} % 3 = 0").select("value", "index", "stage", "group").write.option("header", True).csv(f"{path}/csv")
    rows.where("ordinal % 3 = 1").select(F.col("last").cast("string").alias("tlast"), F.col("data").cast("string").alias("tdata")).write.option("header", True).csv(f"{path}/words")
    sinks.write_word_buffers(rows.where("ordinal % 3 = 2"), f"{path}/bin")
    read = text.read_traces(s, f"{path}/csv", f"{path}/words", f"{path}/bin")
    return read.select("stage", "group", "index", "value", "last", F.array_join("_errors", ",").alias("errors"))


@register("src04_float_images", "SELECT frame_id, x, y, r, g, b FROM pixels")
def _float_images(s, d):
    path = work_dir(s)
    samples = I.pixels(s, d).select("frame_id", "x", "y", *[(F.col(c) / 256).alias(c) for c in "rgb"])
    sinks.write_pfm(samples, I.frames(s, d), path)
    read = binary.read_pfm(s, path)
    frame = F.regexp_extract("file", "frame-([0-9]+)", 1).cast("bigint")
    return read.select(frame.alias("frame_id"), "x", "y", *[(F.col(c) * 256).cast("bigint").alias(c) for c in "rgb"])


@register("snk01_trace_table", 'SELECT frame_id, CAST(stage AS BIGINT) AS stage, "group", "index", value FROM trace')
def _trace_table(s, d):
    path = work_dir(s)
    sinks.write_trace(I.trace(s, d), path)
    return s.read.parquet(path).select("frame_id", F.col("stage").cast("bigint").alias("stage"), "group", "index", "value")


@register("snk02_token_table", "SELECT frame_id, ordinal, context, value FROM tokens_e")
def _token_table(s, d):
    path = work_dir(s)
    sinks.write_tokens(expected(s, d), path)
    return s.read.parquet(path)


@register("snk05_run_summary", """SELECT frame_id, CAST(sum(coalesce(mismatches, 0)) AS BIGINT) AS mismatches FROM verdicts GROUP BY frame_id""")
def _summary(s, d):
    docs = sinks.run_summary(compare.compare_runs(expected(s, d), actual(s, d)))
    return docs.select("frame_id", F.get_json_object("summary", "$.mismatches").cast("bigint").alias("mismatches"))


@register("snk06_fixture_table", "SELECT frame_id, x, y, xv AS x_q12, yv AS y_q12, bv AS b_q12 FROM xyb12")
def _fixture(s, d):
    path = work_dir(s)
    sinks.xyb_fixture(G.pad_frames(I.pixels(s, d), I.frames(s, d))).write.parquet(path)
    return s.read.parquet(path).select("frame_id", "x", "y", "x_q12", "y_q12", "b_q12")


@register("src05_prepared_json", """SELECT frame_id, block, quant, CAST(scale AS BIGINT) AS scale_q16, ytox, CAST(sum(x * (k + 1)) AS BIGINT) AS x_sum, CAST(nx AS BIGINT) AS nonzeros_x, '' AS errors
  FROM prepared_in JOIN (SELECT frame_id, block, nx FROM prepared_blocks) USING (frame_id, block) GROUP BY frame_id, block, quant, scale, ytox, nx""")
def _prepared_json(s, d):
    path = work_dir(s)
    each_a_file(_block_documents(s, d), path)
    weigh = F.aggregate(F.transform(F.col("x"), lambda v, i: v * (i + 1)), lit(0), lambda a, v: a + v)
    return text.read_prepared_blocks_json(s, path).select("frame_id", "block", "quant", "scale_q16", "ytox", weigh.alias("x_sum"), F.col("num_nonzeros")[0].alias("nonzeros_x"), F.array_join("_errors", ",").alias("errors"))


@register("src05_rejects", """SELECT frame_id, block, unnest(CASE frame_id % 4 WHEN 1 THEN ['format'] WHEN 2 THEN ['quant'] ELSE ['malformed', 'block_count', 'no_block'] END) AS rule
  FROM (SELECT frame_id, block FROM prepared_blocks WHERE frame_id % 4 IN (1, 2) UNION ALL SELECT frame_id, NULL FROM block_frames WHERE frame_id % 4 = 3)""")
def _block_rejects(s, d):
    """Every fourth document of another format, every fourth with a quantizer out of range, every fourth broken off at its end;
    the blocks read before a break are counted with the document's fault."""
    path = work_dir(s)
    docs = _block_documents(s, d)
    wide = F.transform("blocks", lambda b: b.withField("inputs", b["inputs"].withField("quant", b["inputs"]["quant"] + 256)))
    docs = docs.withColumn("format", F.when(F.col("frame_id") % 4 == 1, F.lit("other.v2")).otherwise(F.col("format"))).withColumn(
        "blocks", F.when(F.col("frame_id") % 4 == 2, wide).otherwise(F.col("blocks")))
    each_a_file(docs, path, F.col("frame_id") % 4 == 3)
    read = text.read_prepared_blocks_json(s, path, "blocks.v1")
    whole = (F.col("frame_id") % 4 != 3) | F.col("block").isNull()
    return read.where(whole).select("frame_id", "block", F.explode("_errors").alias("rule"))


def each_a_file(docs, path, broken=None):
    """One JSON document a file; where ``broken`` holds, without its last ten characters."""
    value = F.to_json(F.struct(*docs.columns))
    if broken is not None:
        value = F.when(broken, F.expr("substring(_value, 1, length(_value) - 10)")).otherwise(F.col("_value"))
        docs = docs.select("*", F.to_json(F.struct(*docs.columns)).alias("_value"))
    docs.select(F.col("frame_id").alias("_of"), value.alias("value")).repartition("_of").write.partitionBy("_of").text(path)


def _block_documents(s, d):
    from blockfield.catalog.frame_queries import prepared

    b = record_blocks(s, d).join(prepared(s, d).select("frame_id", "block", "bx", "by", *[f"{n}_{p}" for p in "xyb" for n in ("q", "nnz", "dc")]), ["frame_id", "block"])
    each = lambda n: F.array(*[F.col(f"{n}_{p}") for p in "xyb"])
    block = F.struct(
        F.col("block").alias("block_index"), F.col("bx").alias("block_x"), F.col("by").alias("block_y"), int_div(F.col("bx"), 8).alias("tile_x"), int_div(F.col("by"), 8).alias("tile_y"),
        F.struct("quant", "scale_q16", "inv_qac_q16", F.array(*[f"inv_dc_{p}_q16" for p in "xyb"]).alias("inv_dc_factor_q16"), F.col("x_qm_q16").alias("x_qm_multiplier_q16"), "ytox", "ytob", F.array("x", "y", "b").alias("coefficients")).alias("inputs"),
        F.struct(each("q").alias("quantized_ac"), F.array(*[F.col(f"dc_{p}")[0] for p in "xyb"]).alias("quantized_dc"), each("nnz").alias("num_nonzeros")).alias("expected"))
    g = G.with_geometry(I.block_frames(s, d))
    image = F.struct("xsize", "ysize", "x_blocks", "y_blocks", "x_tiles", "y_tiles").alias("image")
    docs = b.groupBy("frame_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).join(g.select("frame_id", image), "frame_id")
    return docs.select("frame_id", F.lit("blocks.v1").alias("format"), "image", F.lit(16).alias("coefficient_fraction_bits"), "blocks")


PATTERNS = ("constant", "gradient", "checkerboard", "impulse", "random")


@register("src12_synthetic_frames", """SELECT frame_id, x, y, CASE frame_id % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN rx WHEN 2 THEN square WHEN 3 THEN centre ELSE -1 END AS r,
  CASE frame_id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN ry WHEN 2 THEN square WHEN 3 THEN centre ELSE -1 END AS g,
  CASE frame_id % 5 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN (rx + ry) / 2 WHEN 2 THEN square WHEN 3 THEN centre ELSE -1 END AS b
  FROM (SELECT frame_id, x, y, x / greatest(xsize - 1, 1)::DOUBLE AS rx, y / greatest(ysize - 1, 1)::DOUBLE AS ry, ((x // 4 + y // 4) % 2)::DOUBLE AS square,
    (x = xsize // 2 AND y = ysize // 2)::INT::DOUBLE AS centre FROM (SELECT *, CAST(i % xsize AS BIGINT) AS x, CAST(i // xsize AS BIGINT) AS y FROM (SELECT *, unnest(range(xsize * ysize)) AS i FROM frames)))""")
def _synthetic(s, d):
    """All patterns in all planes; of random samples, that they lie from 0 to below 1, as -1."""
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (F.col("frame_id") % 5 + 1).cast("int"))
    specs = I.frames(s, d).select("frame_id", pattern.alias("pattern"), "xsize", "ysize", lit(1).alias("seed"))
    ranged = lambda c: F.when(F.col("frame_id") % 5 < 4, F.col(c)).when((F.col(c) >= 0) & (F.col(c) < 1), F.lit(-1.0)).alias(c)
    return binary.synth_frames(s, specs).select("frame_id", "x", "y", *[ranged(c) for c in "rgb"])


# ---- streams --------------------------------------------------------------------------------------------------


def _run_stream(df):
    """Drain a file stream into a table in the shared folder."""
    path = work_dir(df.sparkSession)
    query = df.writeStream.format("parquet").option("checkpointLocation", path + "-log").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _merged_stream(df, keys, mode="update"):
    """Drain a stream of windows that grow into a versioned table in the shared folder, and read its last versions."""
    from blockfield.streaming.tables import VersionedTable

    path = work_dir(df.sparkSession)
    table = VersionedTable(path, keys, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    query = df.writeStream.foreachBatch(table.merge).option("checkpointLocation", path + "-log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read(df.sparkSession)


def stream_of(s, rows, files=4):
    path = work_dir(s)
    rows.repartition(files).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("str01_decode_stream", 'SELECT stage, "group", "index", value, last FROM words')
def _decode_stream(s, d):
    """Word files written by the committing sink, read back as a stream of packed words, a bounded number a trigger."""
    rows, path = words(s, d), work_dir(s)
    sinks.write_word_buffers(rows, path)
    limit = max(1 << 12, rows.count() // 3)
    stream = T.unpack_binary(binary.stream_words_bin(s, path, path + "-plans", 16, ".last", limit)).select("stage", "group", "index", "value", "last")
    query = stream.writeStream.format("parquet").option("checkpointLocation", path + "-log").start(path + "-out")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return s.read.schema(stream.schema).parquet(path + "-out")


#: The events of a table come in no order of time; their streams drop none of them.
LONGEST = "3650 days"
#: Longer than a slice of time, so no row of a slice is late.
SPREAD = "10 minutes"
SLICES = 4
BEGIN = 1_000_000_000
#: Rows of a source are dealt to files by stretches of so many, so files are out of order inside a slice of time.
STRETCH = 512
SLICE_SECONDS = 500
SOURCE_EVENTS = 2000


def _source_stream(s, rows, slices=1):
    """A file stream in slices of event time; inside a slice the stretches of a source lie in several files, in no order."""
    path = work_dir(s)
    for i in range(slices):
        part = rows.where(int_div(F.unix_seconds("ts") - BEGIN, SLICE_SECONDS) == i) if slices > 1 else rows
        part.repartition("source", int_div(F.col("seq"), STRETCH)).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)


def source_events(s, d):
    """Words of sources of 2000 events each, one a second, all sources at once; every 40th word of a source ends a frame."""
    e = I.trace(s, d)
    per = F.col("event_id") % SOURCE_EVENTS
    return e.select(
        int_div(F.col("event_id"), SOURCE_EVENTS).alias("source"), per.alias("seq"), F.timestamp_seconds(BEGIN + per).alias("ts"), lit(0).alias("kind"), "stage", "group", "index", "value",
        (per % 40 == 39).alias("last"), lit(0).alias("distance_q8"), lit(0).alias("expected_words"))


@register("str02_delimit_frames", """SELECT event_id // 2000 AS source, event_id % 2000 // 40 AS frame, event_id % 40 AS ordinal, stage, value, event_id % 40 = 39 AS last FROM trace""")
def _delimited(s, d):
    out = delimit_frames(_source_stream(s, source_events(s, d), SLICES), lateness=SPREAD)
    return _run_stream(out.where("outcome IS NULL").select("source", "frame", "ordinal", "stage", "value", "last"))


@register("str02_expired_frames", """SELECT source, CASE WHEN source % 3 = 0 AND n > 1000 THEN 25 ELSE n // 40 END AS frame, CASE WHEN source % 3 = 0 AND n > 1000 THEN n - 1000 ELSE n % 40 END AS words
  FROM (SELECT event_id // 2000 AS source, count(*) AS n FROM trace GROUP BY ALL) WHERE source % 3 = 0 AND n > 1000 OR n % 40 > 0""")
def _expired(s, d):
    """Every third source gives no last flag after its first 1000 words; a source that goes on moves the event time, and the
    timers close what is open."""
    open_ = (F.col("source") % 3 == 0) & (F.col("seq") >= 1000)
    rows = source_events(s, d).withColumn("last", F.col("last") & ~open_)
    clock = s.range(2).select(lit(-1).alias("source"), F.col("id").alias("seq"), F.timestamp_seconds(BEGIN + 9000 + F.col("id")).alias("ts"), *[lit(0).alias(c) for c in ("kind", "stage", "group", "index", "value")],
                              F.lit(True).alias("last"), lit(0).alias("distance_q8"), lit(0).alias("expected_words"))
    path = work_dir(s)
    for part in (rows, clock.where("seq = 0"), clock.where("seq = 1")):
        part.repartition("source", int_div(F.col("seq"), STRETCH)).write.mode("append").parquet(path)
    out = delimit_frames(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path), lateness="1 hour")
    return _run_stream(out.where("outcome = 'expired'").select("source", "frame", F.col("ordinal").alias("words")))


@register("str07_running_counts", "SELECT date_trunc('hour', ts) AS start, stage, count(*) AS words FROM trace GROUP BY ALL")
def _running(s, d):
    counts = running_counts(stream_of(s, I.trace(s, d).select(F.col("ts").cast("timestamp").alias("ts"), "stage")), lateness=LONGEST)
    return _merged_stream(counts, ["start", "stage"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "stage", "words")


@register("str08_beat_gaps", """SELECT date_trunc('hour', ts) AS start, count(*) AS words, epoch_us(max(ts)) - epoch_us(min(ts)) + 1 AS span, epoch_us(max(ts)) - epoch_us(min(ts)) + 1 - count(*) AS bubbles FROM trace GROUP BY ALL""")
def _gaps(s, d):
    rows = I.trace(s, d).select(F.col("ts").cast("timestamp").alias("ts"))
    out = _merged_stream(beat_gaps(stream_of(s, rows), lateness=LONGEST), ["start"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("str05_assemble_blocks", """SELECT frame_id AS source, row_number() OVER (PARTITION BY frame_id ORDER BY block) - 1 AS block, CAST(sum(y * (k + 1)) AS BIGINT) AS y_sum FROM prepared_in GROUP BY frame_id, block""")
def _stream_blocks(s, d):
    w = T.pack_prepared_words(record_blocks(s, d)).select(F.col("frame_id").alias("source"), F.col("ordinal").alias("seq"), F.timestamp_millis(BEGIN * 1000 + F.col("ordinal")).alias("ts"), "data")
    out = _run_stream(assemble_blocks(_source_stream(s, w), lateness=SPREAD))
    return out.select("source", "block", F.aggregate(F.transform(F.col("y"), lambda v, i: v * (i + 1)), lit(0), lambda a, v: a + v).alias("y_sum"))


@register("str06_ownership", "SELECT frame_id AS source, CAST(0 AS BIGINT) AS frame, count(*) AS owners, 'complete' AS outcome FROM owner_blocks GROUP BY frame_id")
def _stream_ownership(s, d):
    from blockfield.catalog.frame_queries import shaped
    owners = shaped(s, d)[0].select("frame_id", "block", "raw_strategy", "covered")
    ends = owners.groupBy("frame_id").agg(F.max("block").alias("_end"))
    g = G.with_geometry(I.frames(s, d)).select("frame_id", "x_blocks", "y_blocks")
    rows = owners.join(ends, "frame_id").join(g, "frame_id").select(
        F.col("frame_id").alias("source"), (F.row_number().over(Window.partitionBy("frame_id").orderBy("block")) - 1).cast("bigint").alias("seq"),
        F.timestamp_millis(BEGIN * 1000 + F.col("block")).alias("ts"), "block", F.col("raw_strategy").cast("bigint").alias("raw_strategy"),
        (F.col("block") == F.col("_end")).alias("last"), "x_blocks", "y_blocks")
    return _run_stream(check_ownership(_source_stream(s, rows), lateness=SPREAD)).select("source", "frame", "owners", "outcome")
