"""Remaining inventory entries: file round trips, predictor and candidate views, sticky stream errors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockfield.catalog import frame_queries as Q
from blockfield.catalog import inputs as I
from blockfield.catalog import sql as S
from blockfield.catalog import trace_queries as TQ
from blockfield.catalog.base import register
from blockfield.functions.fixed import int_div, lit
from blockfield.operators import geometry as G
from blockfield.operators import shape, tokens
from blockfield.session import work_dir
from blockfield.sources import sinks, text
from blockfield.streaming import frames as stream

S.CTES["dc_planes"] = "SELECT frame_id, block, CAST(unnest([0, 1, 2]) AS BIGINT) AS plane_rank, CAST(unnest([day, dax, dab]) AS BIGINT) AS v FROM prepared_blocks"

# ---- joins and windows ----------------------------------------------------------------------------------------

register("join03_three_by_three", f"SELECT frame_id, cx, cy, count(*) AS members, CAST(sum(v) AS BIGINT) AS total FROM ({Q.CLAMPED}) GROUP BY frame_id, cx, cy")(
    lambda s, d: Q.around(s, d).select("frame_id", "cx", "cy", F.size("around").cast("bigint").alias("members"), F.aggregate("around", lit(0), lambda t, v: t + v).alias("total"))
)


register("join04_predictors", """SELECT c.plane_rank, c.frame_id, c.block, c.v AS value, coalesce(l.v, u.v, 0) AS west, coalesce(u.v, l.v, 0) AS north FROM (
  SELECT p.*, p.block % g.xb AS bcol, g.xb FROM dc_planes p JOIN block_frames g USING (frame_id)) c
  LEFT JOIN dc_planes l ON l.plane_rank = c.plane_rank AND l.frame_id = c.frame_id AND l.block = c.block - 1 AND c.bcol > 0
  LEFT JOIN dc_planes u ON u.plane_rank = c.plane_rank AND u.frame_id = c.frame_id AND u.block = c.block - c.xb""")(
    lambda s, d: tokens.predict_dc(tokens.dc_cells(Q.prepared(s, d), I.block_frames(s, d))).select(
        "plane_rank", "frame_id", "block", "value", F.col("left").alias("west"), F.col("top").alias("north"))
)
register("join10_candidate_members", """SELECT frame_id, rx, ry, c.candidate, brow * xb + bcol AS block FROM (SELECT frame_id, xb, rx, ry, unnest(range(8)) AS candidate FROM (
  SELECT *, unnest(range(yb // 2)) AS ry FROM (SELECT *, unnest(range(xb // 2)) AS rx FROM geo))) c
  JOIN (VALUES (0,0,0),(1,1,0),(2,0,1),(3,1,1),(4,0,0),(4,0,1),(5,1,0),(5,1,1),(6,0,0),(6,1,0),(7,0,1),(7,1,1)) m(candidate, mx, my) ON m.candidate = c.candidate
  CROSS JOIN LATERAL (SELECT rx * 2 + mx AS bcol, ry * 2 + my AS brow)""")(lambda s, d: _members(s, d))


def _members(s, d):
    from blockfield.catalog.value_queries import _regions

    return shape.candidate_members(_regions(s, d), I.frames(s, d))


_AC = S.ac_tokens_sql("prepared_levels", "prepared_blocks", "block_frames")
register("win07_prev_flag", f"SELECT frame_id, count(*) AS contexts, CAST(sum(context % 2) AS BIGINT) AS odd FROM ({_AC}) GROUP BY frame_id")(
    lambda s, d: tokens.ac_tokens(Q.prepared(s, d), I.block_frames(s, d)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("contexts"), F.sum(F.col("context") % 2).alias("odd"))
)
register("win08_token_ordinal", f"SELECT frame_id, min(ordinal) AS first, max(ordinal) AS final, count(DISTINCT ordinal) AS ordinals FROM ({_AC}) GROUP BY frame_id")(
    lambda s, d: tokens.ac_tokens(Q.prepared(s, d), I.block_frames(s, d)).groupBy("frame_id").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("final"), F.count_distinct("ordinal").alias("ordinals"))
)
register("win12_candidate_rank", """SELECT frame_id, bcol AS bx, brow AS "by", CAST(shape AS BIGINT) AS raw_strategy, row_number() OVER (PARTITION BY frame_id, bcol // 2, brow // 2 ORDER BY cost, shape, brow, bcol) AS rank FROM shape_costs""")(
    lambda s, d: _ranked(s, d)
)


def _ranked(s, d):
    return shape.ranked_candidates(Q._costs(s, d)).select("frame_id", "bx", "by", F.col("raw_strategy").cast("bigint").alias("raw_strategy"), "rank")


_META = S.metadata_tokens_sql("prepared_blocks", "prepared_tiles", "block_frames")
register("set03_metadata_phases", f"SELECT frame_id, context, count(*) AS tokens, min(ordinal) AS first FROM ({_META}) GROUP BY frame_id, context")(
    lambda s, d: tokens.metadata_tokens(Q.prepared(s, d), Q.prepared_tiles(s, d), I.block_frames(s, d)).groupBy("frame_id", "context").agg(
        F.count(F.lit(1)).alias("tokens"), F.min("ordinal").alias("first"))
)

# ---- files ----------------------------------------------------------------------------------------------------


@register("top03_ordered_tokens", "SELECT frame_id, count(*) AS tokens, min(ordinal) AS first, max(ordinal) AS final, CAST(0 AS BIGINT) AS out_of_order FROM tokens_a GROUP BY frame_id")
def _ordered(s, d):
    """Written tokens read back with their files and rows: inside a file every row comes after the one before it."""
    path = work_dir(s)
    sinks.write_tokens(TQ.actual(s, d), path)
    rows = s.read.parquet(path).select("frame_id", "ordinal", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag(F.struct("frame_id", "ordinal")).over(Window.partitionBy("file").orderBy("row"))
    late = F.struct("frame_id", "ordinal") < before
    return rows.withColumn("late", late).groupBy("frame_id").agg(F.count(F.lit(1)).alias("tokens"), F.min("ordinal").alias("first"), F.max("ordinal").alias("final"), F.count_if("late").alias("out_of_order"))


_NAMES = ", ".join(f"('{n}', {a})" for n, a in text.REGISTERS)


@register("src11_register_log", f"""SELECT event_id AS strb, r.name AS register, event_id * 4 % 80 AS address, w AS data FROM ev LEFT JOIN (VALUES {_NAMES}) r(name, place) ON r.place = event_id * 4 % 80""")
def _register_log(s, d):
    """A control log of writes in mixed notations, to known registers and behind them."""
    from blockfield.catalog.value_queries import W, ev

    path = work_dir(s)
    address = F.col("event_id") * 4 % 80
    hexed = lambda c: F.concat(F.lit("0x"), F.hex(c))
    rows = ev(s, d).select(F.when(F.col("event_id") % 2 == 0, hexed(address)).otherwise(address.cast("string")).alias("address"),
                           F.when(F.col("event_id") % 3 == 0, W().cast("string")).otherwise(hexed(W())).alias("data"), F.col("event_id").cast("string").alias("strb"))
    rows.write.option("header", True).csv(path)
    return text.read_register_log(s, path).select("strb", "register", "address", "data")


@register("src09_manifests", "SELECT frame_id, xsize, ysize, x_tiles, y_tiles, word_count, required_capabilities, 'v1' AS version FROM manifests")
def _manifests(s, d):
    path = work_dir(s)
    m = TQ.manifests(s, d)
    m.select("frame_id", F.lit("rgb_manifest.v1").alias("format"), F.struct(F.col("xsize").alias("width"), F.col("ysize").alias("height"), "x_tiles", "y_tiles").alias("image"),
             F.struct("word_count").alias("stream"), F.struct("required_capabilities").alias("discovery")).write.json(path)
    read = text.read_manifests(s, path, suffix="_manifest.v1", multi_line=False)
    return read.select("frame_id", "xsize", "ysize", "x_tiles", "y_tiles", "word_count", "required_capabilities", F.substring_index("format", ".", -1).alias("version"))


@register("src06_prepared_tokens_json", """SELECT frame_id, block, channel, nnz AS nonzeros, CAST(total AS BIGINT) AS total FROM (
  SELECT q.frame_id, q.block, CAST(unnest([0, 1, 2]) AS BIGINT) AS channel, unnest([nx, ny, nb]) AS nnz, unnest([sx, sy, sb]) AS total FROM prepared_blocks q
  JOIN (SELECT frame_id, block, sum(qx * (k + 1)) AS sx, sum(qy * (k + 1)) AS sy, sum(qb * (k + 1)) AS sb FROM prepared_levels GROUP BY frame_id, block) USING (frame_id, block))""")
def _tokens_json(s, d):
    ac = text.read_prepared_tokens_json(s, _token_documents(s, d), multi_line=False)[1]
    total = F.aggregate(F.transform("coefficients", lambda v, i: v * (i + 1)), lit(0), lambda a, v: a + v)
    return ac.select("frame_id", "block", "channel", "nonzeros", total.alias("total"))


@register("src06_rejects", "SELECT frame_id, CASE frame_id % 4 WHEN 1 THEN 'format' ELSE 'dc_count' END AS rule FROM block_frames WHERE frame_id % 4 IN (1, 2)")
def _token_rejects(s, d):
    return text.read_prepared_tokens_json(s, _token_documents(s, d, True), suffix="_tokens.v1", multi_line=False)[2].select("frame_id", "rule")


def _token_documents(s, d, broken=False):
    """Prepared-token documents; broken: every fourth of another format, every fourth with a sample too many."""
    path = work_dir(s)
    g = G.with_geometry(I.block_frames(s, d))
    each = lambda n: F.array(*[F.col(f"{n}_{p}") for p in "xyb"])
    blocks = Q.prepared(s, d).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("block_index"), each("nnz").alias("num_nonzeros"), each("q").alias("quantized")))).alias("ac_blocks"))
    dc = sinks.prepared_dc(tokens.dc_cells(Q.prepared(s, d), I.block_frames(s, d)), g)
    samples = dc.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda e: e["value"]).alias("dc_samples"))
    image = F.struct("xsize", "ysize", "x_blocks", "y_blocks", "x_tiles", "y_tiles").alias("image")
    docs = blocks.join(samples, "frame_id").join(g.select("frame_id", image), "frame_id").withColumn("format", F.lit("prepared_tokens.v1"))
    if broken:
        docs = docs.withColumn("format", F.when(F.col("frame_id") % 4 == 1, F.lit("prepared_blocks.v1")).otherwise(F.col("format"))).withColumn(
            "dc_samples", F.when(F.col("frame_id") % 4 == 2, F.array_append("dc_samples", lit(0))).otherwise(F.col("dc_samples")))
    docs.write.json(path)
    return path


# ---- streams --------------------------------------------------------------------------------------------------


@register("str03_config_snapshot", """SELECT event_id // 2000 AS source, event_id % 2000 // 40 AS frame, 64 + event_id % 2000 // 40 AS distance_q8,
  bool_or(event_id % 2000 // 40 % 7 = 3 AND event_id % 40 = 39) AS protocol_error FROM trace GROUP BY ALL""")
def _snapshots(s, d):
    """Each frame is preceded by its configuration; every seventh frame expects one word more than it gets.

    A clear row at the start of each frame keeps the sticky error inside its own frame.
    """
    events = TQ.source_events(s, d)
    frame = int_div(F.col("seq"), 40)
    heads = events.where(F.col("seq") % 40 == 0)
    control = heads.withColumn("distance_q8", 64 + frame).withColumn(
        "expected_words", F.when(frame % 7 == 3, lit(41)).otherwise(lit(40))
    ).withColumn("kind", lit(stream.CONTROL)).withColumn("seq", frame * 42)
    clear = heads.withColumn("seq", frame * 42 + 1).withColumn("kind", lit(stream.CLEAR))
    rows = events.withColumn("seq", F.col("seq") + 2 * frame + 2).unionByName(control).unionByName(clear)
    out = TQ._run_stream(stream.delimit_frames(TQ._source_stream(s, rows, TQ.SLICES), lateness=TQ.SPREAD)).where("outcome IS NULL")
    return out.groupBy("source", "frame", "distance_q8").agg(F.bool_or("protocol_error").alias("protocol_error"))


@register("str04_sticky_error", """SELECT event_id // 2000 AS source, count(*) AS words, count(*) FILTER (event_id % 2000 >= 39) AS flagged FROM trace GROUP BY ALL""")
def _sticky(s, d):
    """One early configuration expects 50 words while frames have 40: from the first early last on, every word is flagged."""
    events = TQ.source_events(s, d)
    first = events.where("seq = 0").withColumn("kind", lit(stream.CONTROL)).withColumn("expected_words", lit(50))
    rows = events.withColumn("seq", F.col("seq") + 1).unionByName(first)
    out = TQ._run_stream(stream.delimit_frames(TQ._source_stream(s, rows, TQ.SLICES), lateness=TQ.SPREAD)).where("outcome IS NULL")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("words"), F.count_if("protocol_error").alias("flagged"))

