"""Pixels to tokens on the frames derived from orders, and quantization of prepared blocks from embeddings."""

from pyspark.sql import functions as F

from blockfield.catalog import inputs as I
from blockfield.catalog import sql as S
from blockfield.catalog import value_queries as V
from blockfield.catalog.base import register, staged
from blockfield.functions import constants as C
from blockfield.functions import coding
from blockfield.functions.fixed import lit
from blockfield.operators import aq, audit, cfl, compare, geometry as G, params as P, quantize, shape, tokens, transform
from blockfield.plans import jobs
from blockfield.session import stage, write_table
from blockfield.sources import sinks


@staged
def parts(s, d):
    return G.stripe_parts(I.pixels(s, d), I.frames(s, d))


@staged
def columns(s, d):
    return G.placed(stage(G.block_columns(I.pixels(s, d), I.frames(s, d), (12, 18, 21), parts(s, d))), parts(s, d))


@staged
def statistics(s, d):
    return G.placed(stage(aq.block_statistics(columns(s, d))), parts(s, d))


@staged
def aq_fields(s, d):
    return G.placed(stage(aq.final_fields(aq.modulate(aq.with_masks(aq.erosion(statistics(s, d))), I.frames(s, d)))), parts(s, d))


@staged
def coefficients12(s, d):
    return stage(transform.block_transform(columns(s, d), 12))


@staged
def square(s, d):
    """(quantized blocks, stripe tiles) of the 8x8 route with estimated multipliers."""
    frames = I.frames(s, d)
    tiles = stage(cfl.cfl_tiles(coefficients12(s, d), 12))
    params = jobs.square_params(aq_fields(s, d), frames, tiles)
    return write_table(quantize.quantize(coefficients12(s, d), params, 12)), tiles


@staged
def square_fixed(s, d):
    params = jobs.square_params(aq_fields(s, d), I.frames(s, d))
    return write_table(quantize.quantize(coefficients12(s, d), params, 12))


@staged
def shaped(s, d):
    return jobs.quantize_shaped_frames(I.pixels(s, d), I.frames(s, d))


@staged
def shape_cells(s, d):
    return jobs.choose_shapes(columns(s, d), I.frames(s, d), parts(s, d))[0]


@staged
def prepared(s, d):
    return write_table(quantize.quantize(I.prepared_coefficients(s, d), I.prepared_params(s, d), 16))


def prepared_tiles(s, d):
    grid = G.with_geometry(I.block_frames(s, d))
    return grid.select("frame_id", F.explode(F.sequence(lit(0), F.col("tile_count") - 1)).alias("tile"), "ytox", "ytob")


def fixed_tiles(s, d):
    grid = G.with_geometry(I.frames(s, d))
    return grid.select("frame_id", F.explode(F.sequence(lit(0), F.col("tile_count") - 1)).alias("tile"), F.col("fixed_ytox").alias("ytox"), F.col("fixed_ytob").alias("ytob"))


def pick(df, **names):
    return df.select(*[F.col(c).cast("bigint").alias(n) for n, c in names.items()])


# ---- pixels ---------------------------------------------------------------------------------------------------

register("join01_pad", "SELECT frame_id, x, y, r, g, b, block FROM padded")(lambda s, d: G.pad_frames(I.pixels(s, d), I.frames(s, d)))
register("job01_pad_trace", """SELECT p.frame_id, CAST(0 AS BIGINT) AS stage, CAST(0 AS BIGINT) AS "group", (c * g.yb * 8 + p.y) * g.xb * 8 + p.x AS "index", ([p.r, p.g, p.b])[CAST(c + 1 AS INTEGER)] AS value
  FROM (SELECT *, unnest(range(3)) AS c FROM padded) p JOIN geo g USING (frame_id)""")(
    lambda s, d: G.samples_as_trace(G.pad_frames(I.pixels(s, d), I.frames(s, d)), I.frames(s, d), C.STAGES["InputPadded"])
)


def _xyb(q):
    def run(s, d):
        from blockfield.functions.color import to_xyb

        return to_xyb(G.pad_frames(I.pixels(s, d), I.frames(s, d)), (q,)).select("frame_id", "x", "y", F.col(f"x_q{q}").alias("xyb_x"), F.col(f"y_q{q}").alias("xyb_y"), F.col(f"b_q{q}").alias("xyb_b"))

    return run


for _q, _name in ((12, "prj06_xyb"), (18, "prj07_xyb_q18"), (21, "prj07_xyb_q21")):
    register(_name, f"SELECT frame_id, x, y, xv AS xyb_x, yv AS xyb_y, bv AS xyb_b FROM xyb{_q}")(_xyb(_q))


@register("job02_xyb_trace", """SELECT p.frame_id, CAST(1 AS BIGINT) AS stage, CAST(0 AS BIGINT) AS "group", (c * g.yb * 8 + p.y) * g.xb * 8 + p.x AS "index", ([p.xv, p.yv, p.bv])[CAST(c + 1 AS INTEGER)] AS value
  FROM (SELECT *, unnest(range(3)) AS c FROM xyb12) p JOIN geo g USING (frame_id)""")
def _xyb_trace(s, d):
    px = _xyb(12)(s, d)
    return G.samples_as_trace(px, I.frames(s, d), C.STAGES["Xyb"], ("xyb_x", "xyb_y", "xyb_b"))


register("join02_neighbours", "SELECT frame_id, x, y, xv AS cx, yv AS cy, lx, rx, ux, dx, ly, ry, uy, dy FROM near")(
    lambda s, d: aq.neighbour_samples(columns(s, d)).select(
        "frame_id", (F.col("bx") * 8 + F.col("col")).alias("x"), (F.col("by") * 8 + F.col("row")).alias("y"), "cx", "cy", "lx", "rx", "ux", "dx", "ly", "ry", "uy", "dy")
)
register("agg02_contrast_pixels", "SELECT frame_id, x, y, CAST(contrast AS BIGINT) AS contrast_q16 FROM contrast")(
    lambda s, d: aq.contrast_pixels(aq.neighbour_samples(columns(s, d))).select(
        "frame_id", (F.col("bx") * 8 + F.col("col")).alias("x"), (F.col("by") * 8 + F.col("row")).alias("y"), "contrast_q16")
)
register("agg01_contrast_cells", "SELECT frame_id, cy * xb * 2 + cx AS cell, cx AS cell_x, cy AS cell_y, CAST(v AS BIGINT) AS contrast_q16 FROM cells")(
    lambda s, d: aq.contrast_map(columns(s, d), I.frames(s, d))
)
register("job05_contrast_map", "SELECT frame_id, cy * xb * 2 + cx AS cell, CAST(v AS BIGINT) AS contrast_q16 FROM cells")(
    lambda s, d: aq.contrast_map(G.block_columns(I.pixels(s, d), I.frames(s, d)), I.frames(s, d)).select("frame_id", "cell", "contrast_q16")
)
register("job06_erosion_map", "SELECT frame_id, block AS \"index\", e AS value FROM eroded")(
    lambda s, d: pick(aq_fields(s, d), frame_id="frame_id", index="block", value="erosion_q16")
)
register("agg03_erosion", "SELECT frame_id, block, e AS erosion_q16 FROM eroded")(
    lambda s, d: aq.erosion(statistics(s, d)).select("frame_id", "block", "erosion_q16")
)
register("win11_inner_edges", "SELECT frame_id, block, CAST(edge AS BIGINT) AS edge_sum, CAST(red AS BIGINT) AS red_sum, CAST(blue AS BIGINT) AS blue_sum, CAST(ratio AS BIGINT) AS ratio_sum FROM edges")(
    lambda s, d: pick(statistics(s, d), frame_id="frame_id", block="block", edge_sum="edge_sum", red_sum="red_sum", blue_sum="blue_sum", ratio_sum="ratio_sum")
)
for _name, _cols in (
    ("job07_masks", {"mask_q16": "mask", "seed_q24": "seed"}), ("agg04_hf", {"hf_q24": "hf"}), ("agg05_color", {"color_q24": "color"}),
    ("agg06_gamma", {"gamma_q24": "gamma"}), ("job08_modulation", {"hf_q24": "hf", "color_q24": "color", "gamma_q24": "gamma"}),
    ("job09_raw_quant", {"aq_map_q24": "aq", "raw_quant": "rq"}),
):
    register(_name, "SELECT frame_id, block, " + ", ".join(f"{c} AS {n}" for n, c in _cols.items()) + " FROM aqmap")(
        lambda s, d, names=tuple(_cols): pick(aq_fields(s, d), frame_id="frame_id", block="block", **{n: n for n in names})
    )
# Every cell beside its nine coordinates, clamped at the frame and at the 16-cell stripe.
CLAMPED = """SELECT c.frame_id, c.cx, c.cy, n.v FROM (
  SELECT k.frame_id, k.cx, k.cy, CASE WHEN cx + ox < 0 THEN 0 WHEN cx + ox >= g.xb * 2 THEN cx ELSE cx + ox END AS nx,
    CASE WHEN (cy + oy) // 16 <> cy // 16 OR cy + oy < 0 OR cy + oy >= g.yb * 2 THEN cy ELSE cy + oy END AS ny
  FROM cells k JOIN geo g USING (frame_id), (SELECT unnest([-1, 0, 1]) AS ox) a, (SELECT unnest([-1, 0, 1]) AS oy) b) c
  JOIN cells n ON n.frame_id = c.frame_id AND n.cx = c.nx AND n.cy = c.ny"""
register("top02_four_smallest", f"SELECT frame_id, cx, cy, CAST(list_sum(list_sort(list(v))[1:4]) AS BIGINT) AS lowest FROM ({CLAMPED}) GROUP BY frame_id, cx, cy")(
    lambda s, d: _lowest(s, d)
)


def around(s, d):
    """The sorted 3x3 windows of all cells."""
    cells = aq.contrast_map(columns(s, d), I.frames(s, d))
    return aq.neighbourhood(cells, I.frames(s, d)).withColumnsRenamed({"cell_x": "cx", "cell_y": "cy"})


def _lowest(s, d):
    n = F.col("around")
    return around(s, d).select("frame_id", "cx", "cy", (n[0] + n[1] + n[2] + n[3]).alias("lowest"))


# ---- parameters -----------------------------------------------------------------------------------------------

register("join06_distance_default", "SELECT frame_id, distance_q8, supported, CAST(scale_q16 AS BIGINT) AS scale_q16, CAST(quant_dc AS BIGINT) AS quant_dc, CAST(epf_iters AS BIGINT) AS epf_iters FROM params")(
    lambda s, d: P.with_distance(I.frames(s, d)).select("frame_id", "distance_q8", "supported", "scale_q16", "quant_dc", "epf_iters")
)
register("join05_block_tile_map", "SELECT c.frame_id, c.block, t.ytox, t.ytob FROM (SELECT DISTINCT frame_id, block, bcol, brow FROM dct12) c JOIN geo g USING (frame_id) JOIN tiles12 t ON t.frame_id = c.frame_id AND t.tile = (c.brow // 8) * g.xt + c.bcol // 8")(
    lambda s, d: jobs.attach_tiles(aq_fields(s, d).select("frame_id", "stripe", "block", "bx", "by"), square(s, d)[1]).select("frame_id", "block", "ytox", "ytob")
)


@register("join09_gradient_buckets", """SELECT e.event_id, CAST(c.context AS BIGINT) AS context FROM ev e JOIN (VALUES """ + ", ".join(
    f"({lo}, {hi}, {c})" for lo, (hi, c) in zip([0] + [u + 1 for u, _ in C.GRADIENT_CONTEXTS], [*C.GRADIENT_CONTEXTS, (1023, C.GRADIENT_CONTEXT_DEFAULT)])
) + """) c(lo, hi, context) ON e.w % 1024 BETWEEN c.lo AND c.hi""")
def _buckets(s, d):
    ladder = [*C.GRADIENT_CONTEXTS, (1023, C.GRADIENT_CONTEXT_DEFAULT)]
    rows = [(lo, hi, c) for lo, (hi, c) in zip([0] + [u + 1 for u, _ in C.GRADIENT_CONTEXTS], ladder)]
    table = P.literal_table(s, ["lo", "hi", "context"], rows)
    prop = F.col("w") % 1024
    return V.ev(s, d).join(F.broadcast(table), (prop >= F.col("lo")) & (prop <= F.col("hi"))).select("event_id", "context")


# ---- transforms and regression --------------------------------------------------------------------------------

register("job03_block_transform", "SELECT frame_id, block, k, x, y, b FROM dct12")(lambda s, d: coefficients12(s, d).select("frame_id", "block", "k", "x", "y", "b"))
register("job03_guarded_transform", "SELECT frame_id, block, k, x, y, b FROM dct18")(
    lambda s, d: transform.block_transform(columns(s, d), 18, 8).select("frame_id", "block", "k", "x", "y", "b")
)
register("job04_vertical_transform", "SELECT frame_id, block, k, x, y, b FROM tall12")(
    lambda s, d: transform.vertical_transform(columns(s, d), 12).select("frame_id", "block", "k", "x", "y", "b")
)
register("job04_horizontal_transform", "SELECT frame_id, block, k, x, y, b FROM flat12")(
    lambda s, d: transform.horizontal_transform(columns(s, d), 12).select("frame_id", "block", "k", "x", "y", "b")
)
register("agg07_cfl", "SELECT frame_id, tile, ytox, ytob, n FROM tiles12")(lambda s, d: cfl.cfl_maps(coefficients12(s, d), I.frames(s, d), 12))
register("job10_cfl_maps", S.cfl_sql("vector_coefficients", 16, "block_frames"))(
    lambda s, d: cfl.cfl_maps(I.prepared_coefficients(s, d), I.block_frames(s, d), 16)
)

# ---- quantization of prepared blocks --------------------------------------------------------------------------


def _levels(s, d):
    joined = I.prepared_coefficients(s, d).join(I.prepared_params(s, d).select("frame_id", "stripe", "block", *quantize.PARAMS), ["frame_id", "stripe", "block"])
    return quantize.quantize_coefficients(joined, 16)


register("join07_weights", f"SELECT frame_id, block, k, CAST((y * {S._inverse(C.Y)}) >> 16 AS BIGINT) AS weighted FROM (SELECT *, 0 AS shape FROM vector_coefficients)")(
    lambda s, d: I.prepared_coefficients(s, d).select("frame_id", "block", "k", _weighted().alias("weighted"))
)


def _weighted():
    from blockfield.functions.quant import weighted

    return weighted(F.col("y"), C.Y, F.col("k"), lit(C.DCT))


register("prj17_quantize", "SELECT frame_id, block, k, CAST(qx AS BIGINT) AS q_x, CAST(qy AS BIGINT) AS q_y, CAST(qb AS BIGINT) AS q_b FROM prepared_levels")(
    lambda s, d: _levels(s, d).select("frame_id", "block", "k", "q_x", "q_y", "q_b")
)
register("prj18_luma_and_prj19_residual", "SELECT frame_id, block, k, CAST(rx AS BIGINT) AS res_x, CAST(rb AS BIGINT) AS res_b FROM prepared_levels")(
    lambda s, d: _levels(s, d).select("frame_id", "block", "k", "res_x", "res_b")
)
register("prj20_quantize_dc", "SELECT frame_id, block, CAST(dax AS BIGINT) AS dc_x, CAST(day AS BIGINT) AS dc_y, CAST(dab AS BIGINT) AS dc_b FROM prepared_blocks")(
    lambda s, d: prepared(s, d).select("frame_id", "block", *[F.col(f"dc_{p}")[0].alias(f"dc_{p}") for p in "xyb"])
)
register("agg08_nonzeros", "SELECT frame_id, block, nx AS nnz_x, ny AS nnz_y, nb AS nnz_b FROM prepared_blocks")(
    lambda s, d: prepared(s, d).select("frame_id", "block", "nnz_x", "nnz_y", "nnz_b")
)
register("job13_quantize_blocks", S.quantized_trace_sql("prepared_levels", "prepared_blocks"))(lambda s, d: quantize.quantized_trace(prepared(s, d)))
register("job13_quantize_frames", S.quantized_trace_sql("square_levels", "square_blocks"))(lambda s, d: quantize.quantized_trace(square(s, d)[0]))
register("job13_quantize_fixed_cfl", S.quantized_trace_sql("fixed_levels", "fixed_blocks"))(lambda s, d: quantize.quantized_trace(square_fixed(s, d)))

# ---- shapes ---------------------------------------------------------------------------------------------------


def _costs(s, d):
    frames, cols = I.frames(s, d), columns(s, d)
    sq = transform.block_transform(cols, 18, 8)
    candidates = shape.candidate_fields(aq_fields(s, d), stage(cfl.cfl_tiles(sq, 18)), frames)
    parts = [(C.DCT, sq), (C.DCT16X8, transform.vertical_transform(cols, 18, 8)), (C.DCT8X16, transform.horizontal_transform(cols, 18, 8))]
    rows = None
    for code, part in parts:
        part = part.withColumn("raw_strategy", lit(code))
        rows = part if rows is None else rows.unionByName(part)
    joined = rows.join(candidates, [*G.BLOCK_KEYS, "raw_strategy"])
    return shape.candidate_costs(shape.coefficient_costs(joined, 18), frames)


register("agg09_candidate_costs", "SELECT frame_id, bcol AS bx, brow AS \"by\", CAST(shape AS BIGINT) AS raw_strategy, CAST(est AS BIGINT) AS estimate_q16, CAST(cost AS BIGINT) AS cost_q16 FROM shape_costs")(
    lambda s, d: _costs(s, d).select("frame_id", "bx", "by", F.col("raw_strategy").cast("bigint").alias("raw_strategy"), "estimate_q16", "cost_q16")
)
register("agg10_candidate_maxima", "SELECT DISTINCT frame_id, bcol AS bx, brow AS \"by\", CAST(shape AS BIGINT) AS raw_strategy, cq AS aq_map_q24, cm AS mask_q16 FROM candidate_rows")(
    lambda s, d: shape.candidate_fields(aq_fields(s, d), _tiles18(s, d), I.frames(s, d)).select(
        "frame_id", "bx", "by", F.col("raw_strategy").cast("bigint").alias("raw_strategy"), F.col("cq").alias("aq_map_q24"), F.col("cm").alias("mask_q16"))
)


@staged
def _tiles18(s, d):
    return stage(cfl.cfl_tiles(transform.block_transform(columns(s, d), 18, 8), 18))


register("top01_shape", "SELECT frame_id, block, CAST(code AS BIGINT) AS code FROM shape_cells")(
    lambda s, d: shape_cells(s, d).select("frame_id", "block", F.col("code").cast("bigint").alias("code"))
)
register("job11_choose_shape", "SELECT frame_id, block, CAST(code AS BIGINT) AS code, CAST(code // 2 AS BIGINT) AS raw_strategy, code % 2 = 1 AS is_first FROM shape_cells")(
    lambda s, d: shape_cells(s, d).select("frame_id", "block", F.col("code").cast("bigint").alias("code"), coding.raw_strategy(F.col("code")).cast("bigint").alias("raw_strategy"), coding.is_first(F.col("code")).alias("is_first"))
)
register("job11_shape_rejects", """SELECT frame_id, 'unsupported_distance' AS rule, CAST((g.xb // 2 * 2) * (g.yb // 2 * 2) AS VARCHAR) AS detail FROM geo g JOIN params p USING (frame_id)
  WHERE NOT p.supported AND g.xb > 1 AND g.yb > 1""")(lambda s, d: shape.shape_rejects(shape_cells(s, d)))
register("job12_adjust_quant", "SELECT frame_id, block, arq AS raw_quant FROM adjusted")(lambda s, d: shape_cells(s, d).select("frame_id", "block", "raw_quant"))
register("job14_quantize_owners", S.quantized_trace_sql("owner_levels", "owner_blocks"))(lambda s, d: quantize.quantized_trace(shaped(s, d)[0]))
register("join08_covered_cells", """SELECT frame_id, block, CAST(0 AS BIGINT) AS part, block AS cell FROM owner_blocks UNION ALL
  SELECT q.frame_id, block, 1, block + CASE WHEN shape = 1 THEN g.xb ELSE 1 END FROM owner_blocks q JOIN geo g USING (frame_id) WHERE shape <> 0""")(
    lambda s, d: G.covered_cells(shaped(s, d)[0].join(tokens.block_counts(I.frames(s, d)), "frame_id")).select("frame_id", "block", "part", "cell")
)
register("win10_ownership", "SELECT frame_id, count(*) AS cells, CAST(max(copies) AS BIGINT) AS most_copies, max(xb * yb) = count(*) AS complete FROM (SELECT q.frame_id, block, 1 AS copies, g.xb, g.yb FROM aqmap q JOIN geo g USING (frame_id)) GROUP BY frame_id")(
    lambda s, d: _ownership(s, d)
)


def _ownership(s, d):
    counts = tokens.block_counts(I.frames(s, d))
    cells = G.covered_cells(shaped(s, d)[0].join(counts, "frame_id"))
    each = cells.groupBy("frame_id", "cell").agg(F.count(F.lit(1)).alias("copies"))
    return each.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.max("copies").alias("most_copies")).join(counts, "frame_id").select(
        "frame_id", "cells", "most_copies", (F.col("cells") == F.col("block_count")).alias("complete"))


S.CTES["own_o"] = """SELECT q.frame_id, q.block, q.shape, g.xb, g.yb, max(q.block) OVER (PARTITION BY q.frame_id) AS final FROM owner_blocks q JOIN geo g USING (frame_id)
  WHERE NOT (q.frame_id % 4 = 1 AND q.block % 7 = 3)"""
S.CTES["own_c"] = """SELECT frame_id, block AS cell FROM own_o UNION ALL SELECT frame_id, block + CASE WHEN shape = 1 THEN xb ELSE 1 END FROM own_o WHERE shape <> 0
  UNION ALL SELECT frame_id, 0 FROM own_o WHERE frame_id % 4 = 2 AND block = final"""
register("win10_ownership_rules", """SELECT frame_id, 'overlap' AS rule, CAST(cell AS VARCHAR) AS detail FROM own_c GROUP BY frame_id, cell HAVING count(*) > 1
UNION ALL SELECT frame_id, 'gap', CAST(xb * yb - n AS VARCHAR) FROM geo JOIN (SELECT frame_id, count(DISTINCT cell) AS n FROM own_c GROUP BY frame_id) USING (frame_id) WHERE n < xb * yb
UNION ALL SELECT frame_id, 'order', '0' FROM own_o WHERE frame_id % 4 = 2 AND block = final AND final > 0
UNION ALL SELECT frame_id, 'early_last', CAST(final AS VARCHAR) FROM own_o WHERE frame_id % 4 = 2 AND block = final
UNION ALL SELECT frame_id, 'missing_last', '0' FROM own_o WHERE frame_id % 4 = 2 AND block = final""")(lambda s, d: _ownership_rules(s, d))


def _ownership_rules(s, d):
    """Owners in order of their block; some are left out in every fourth frame, and every fourth gets block 0 once more at its end."""
    owners = shaped(s, d)[0].select("frame_id", "block", F.col("raw_strategy").cast("bigint").alias("raw_strategy")).where("NOT (frame_id % 4 = 1 AND block % 7 = 3)")
    ends = owners.groupBy("frame_id").agg(F.max("block").alias("_end"))
    rows = owners.join(ends, "frame_id").select("frame_id", F.col("block").alias("seq"), "block", "raw_strategy", (F.col("block") == F.col("_end")).alias("last"))
    again = ends.where("frame_id % 4 = 2").select("frame_id", (F.col("_end") + 1).alias("seq"), lit(0).alias("block"), lit(0).alias("raw_strategy"), F.lit(False).alias("last"))
    return audit.ownership_findings(rows.unionByName(again), I.frames(s, d))


# ---- tokens ---------------------------------------------------------------------------------------------------

_PREP = ("prepared_levels", "prepared_blocks")
register("win02_dc_tokens", S.dc_tokens_sql("prepared_blocks", "block_frames"))(
    lambda s, d: tokens.dc_tokens(tokens.dc_cells(prepared(s, d), I.block_frames(s, d)), I.block_frames(s, d))
)
register("job15_dc_tokens_shaped", S.dc_tokens_sql("owner_blocks", "geo"))(
    lambda s, d: tokens.dc_tokens(tokens.dc_cells(shaped(s, d)[0], I.frames(s, d)), I.frames(s, d))
)
register("win05_metadata_tokens", S.metadata_tokens_sql("prepared_blocks", "prepared_tiles", "block_frames"))(
    lambda s, d: tokens.metadata_tokens(prepared(s, d), prepared_tiles(s, d), I.block_frames(s, d))
)
register("win03_cfl_tokens", "SELECT * FROM (" + S.metadata_tokens_sql("square_blocks", "tiles12", "geo") + ") m WHERE ordinal < (SELECT 2 * xt * yt FROM geo g WHERE g.frame_id = m.frame_id)")(
    lambda s, d: tokens.cfl_tokens(jobs.raster_tiles(square(s, d)[1], I.frames(s, d)), I.frames(s, d))
)
register("job16_metadata_tokens_shaped", S.metadata_tokens_sql("owner_blocks", "tiles18", "geo"))(
    lambda s, d: tokens.metadata_tokens(shaped(s, d)[0], jobs.raster_tiles(shaped(s, d)[1], I.frames(s, d)), I.frames(s, d))
)
register("win06_ac_tokens", S.ac_tokens_sql(*_PREP, "block_frames"))(lambda s, d: tokens.ac_tokens(prepared(s, d), I.block_frames(s, d)))
register("win04_nonzero_prefix", "SELECT frame_id, ordinal, context, value, last FROM (" + S.ac_tokens_sql(*_PREP, "block_frames", True) + ")")(
    lambda s, d: tokens.ac_tokens(prepared(s, d), I.block_frames(s, d), prefix_only=True)
)
register("job17_ac_tokens_shaped", S.ac_tokens_sql("owner_levels", "owner_blocks", "geo"))(lambda s, d: tokens.ac_tokens(shaped(s, d)[0], I.frames(s, d)))
register("set01_all_tokens", S.all_tokens_sql(*_PREP, "prepared_tiles", "block_frames"))(
    lambda s, d: tokens.all_tokens(prepared(s, d), prepared_tiles(s, d), I.block_frames(s, d))
)
register("job18_all_tokens_estimated", S.all_tokens_sql("square_levels", "square_blocks", "tiles12", "geo"))(
    lambda s, d: tokens.all_tokens(square(s, d)[0], jobs.raster_tiles(square(s, d)[1], I.frames(s, d)), I.frames(s, d))
)
register("job18_all_tokens_fixed", S.all_tokens_sql("fixed_levels", "fixed_blocks", "fixed_tiles", "geo"))(
    lambda s, d: tokens.all_tokens(square_fixed(s, d), fixed_tiles(s, d), I.frames(s, d))
)
register("job18_all_tokens_shaped", S.all_tokens_sql("owner_levels", "owner_blocks", "tiles18", "geo"))(
    lambda s, d: tokens.all_tokens(shaped(s, d)[0], jobs.raster_tiles(shaped(s, d)[1], I.frames(s, d)), I.frames(s, d))
)
_ALL = S.all_tokens_sql(*_PREP, "prepared_tiles", "block_frames")
register("agg18_context_histogram", f'SELECT stage, "index" AS context, count(*) AS tokens FROM ({_ALL}) GROUP BY ROLLUP (stage, "index")')(
    lambda s, d: tokens.context_histogram(tokens.all_tokens(prepared(s, d), prepared_tiles(s, d), I.block_frames(s, d)).withColumnRenamed("index", "context"), totals=True)
)
register("agg11_block_assembly", """SELECT frame_id, block, string_agg(CAST(qy AS VARCHAR), ' ' ORDER BY k) AS coefficients FROM (SELECT frame_id, block, k, CAST(qy AS BIGINT) AS qy FROM prepared_levels) GROUP BY frame_id, block""")(
    lambda s, d: prepared(s, d).select("frame_id", "block", F.array_join(F.col("q_y").cast("array<string>"), " ").alias("coefficients"))
)
register("agg13_declared_counts", f"""SELECT q.frame_id, q.block, ny AS declared, count(*) FILTER (k > 0 AND qy <> 0) AS counted FROM prepared_blocks q JOIN prepared_levels l USING (frame_id, block) GROUP BY q.frame_id, q.block, ny""")(
    lambda s, d: prepared(s, d).select("frame_id", "block", F.col("nnz_y").alias("declared"), F.size(F.filter(F.slice("q_y", 2, 63), lambda v: v != 0)).cast("bigint").alias("counted"))
)
register("snk03_prepared_dc", "SELECT q.frame_id, rank * g.xb * g.yb + block AS ordinal, CAST(v AS BIGINT) AS value FROM (SELECT frame_id, block, unnest([0, 1, 2]) AS rank, unnest([day, dax, dab]) AS v FROM prepared_blocks) q JOIN block_frames g USING (frame_id)")(
    lambda s, d: sinks.prepared_dc(tokens.dc_cells(prepared(s, d), I.block_frames(s, d)), tokens.block_counts(I.block_frames(s, d)))
)
register("snk03_prepared_ac", " UNION ALL ".join(
    f"""SELECT frame_id, block, CAST({i} AS BIGINT) AS channel, n{p} AS nonzeros, coefficients FROM (SELECT frame_id, block, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY k) AS coefficients FROM
  (SELECT frame_id, block, k, CAST(q{p} AS BIGINT) AS v FROM prepared_levels) GROUP BY frame_id, block) JOIN prepared_blocks USING (frame_id, block)""" for i, p in enumerate("xyb")))(
    lambda s, d: sinks.prepared_ac(prepared(s, d))
)


_ROOT = lambda row: f"cbrt(greatest({' + '.join(f'{m} / {float(1 << 26)} * ({c} / 256.0::DOUBLE)' for m, c in zip(row, 'rgb'))} + {C.OPSIN_BIAS}::DOUBLE, 0)) + {C.CBRT_NEGATIVE_BIAS}::DOUBLE"
_FLOATS = f"SELECT frame_id, x, y, (r0 - r1) / 2 * 4096 AS xf, (r0 + r1) / 2 * 4096 AS yf, r2 * 4096 AS bf FROM (SELECT frame_id, x, y, {', '.join(f'{_ROOT(row)} AS r{i}' for i, row in enumerate(C.MIX_Q26))} FROM padded)"


@register("agg19_xyb_error_bounds", " UNION ALL ".join(
    f"""SELECT '{p}' AS plane, round(max(abs({p}v - {p}f)), 6) AS max_absolute, round(max(abs({p}v - {p}f) / greatest(abs({p}f), 1)), 6) AS max_relative, count(*) AS compared
  FROM ({_FLOATS}) JOIN xyb12 USING (frame_id, x, y)""" for p in "xyb"))
def _bounds(s, d):
    """Floating-point conversion against fixed point, largest difference per plane, to six decimals."""
    fixture = sinks.xyb_fixture(G.pad_frames(I.pixels(s, d), I.frames(s, d)))
    out = None
    for p in "xyb":
        e = fixture.select("frame_id", "x", "y", F.lit(p).alias("plane"), (F.col(f"{p}_float") * 4096).alias("value"))
        a = fixture.select("frame_id", "x", "y", F.lit(p).alias("plane"), F.col(f"{p}_q12").cast("double").alias("value"))
        part = compare.error_bounds(e, a, ["frame_id", "x", "y", "plane"], ["plane"])
        out = part if out is None else out.unionByName(part)
    return out.select("plane", F.round("max_absolute", 6).alias("max_absolute"), F.round("max_relative", 6).alias("max_relative"), "compared")
