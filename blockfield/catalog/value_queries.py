"""Scalar projections and filters on values derived from events, orders and embeddings."""

from pyspark.sql import functions as F

from blockfield.catalog import inputs as I
from blockfield.catalog.base import register
from blockfield.catalog.sql import CTES, _gradient, _piece, _ratio, at, away, away_div, big, clip, huge, up, zigzag
from blockfield.functions import coding, color, curves, masks
from blockfield.functions import constants as C
from blockfield.functions.fixed import int_div, lit, pack_signed, unpack_signed
from blockfield.operators import geometry as G
from blockfield.operators import params as P
from blockfield.operators import trace as T
from blockfield.operators import transform
from blockfield.sources.text import parse_int

CTES["ev"] = """SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS v, value AS d,
  (event_id * 7919 + user_id * 104729) % 65536 AS w FROM events"""


def ev(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", "user_id", F.floor(F.col("value") * 100).alias("v"), F.col("value").alias("d"),
        ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 65536).alias("w"),
    )


def scalar(name, sql_columns, **columns):
    """A query of event_id plus named expressions, with the same expressions in SQL."""
    sql = "SELECT event_id, " + ", ".join(f"{big(e)} AS {n}" for n, e in sql_columns.items()) + " FROM ev"
    register(name, sql)(lambda spark, sf: ev(spark, sf).select("event_id", *[f().cast("bigint").alias(n) for n, f in columns.items()]))


W, V, U = (lambda: F.col("w")), (lambda: F.col("v")), (lambda: F.col("user_id"))

register("prj01_unpack_words", 'SELECT event_id, stage, "group", "index", value, FALSE AS oversized FROM trace')(
    lambda s, d: T.unpack_words(T.pack_words(I.trace(s, d)).select("event_id", "data")).select("event_id", "stage", "group", "index", "value", "oversized")
)
register("prj02_pack_words", """SELECT event_id, CAST(CAST(stage AS HUGEINT) + CAST("group" AS HUGEINT) * 256
  + CAST("index" AS HUGEINT) * 16777216 + (CASE WHEN value < 0 THEN value + 4294967296 ELSE value END) * CAST(72057594037927936 AS HUGEINT) AS VARCHAR) AS data FROM trace""")(
    lambda s, d: T.pack_words(I.trace(s, d)).select("event_id", F.col("data").cast("string").alias("data"))
)
register("prj03_geometry", """SELECT frame_id, xsize, ysize, xb AS x_blocks, yb AS y_blocks, xb * 8 AS padded_xsize, yb * 8 AS padded_ysize,
  xt AS x_tiles, yt AS y_tiles, xb * yb AS block_count, xt * yt AS tile_count FROM geo""")(
    lambda s, d: G.with_geometry(I.frames(s, d).select("frame_id", "xsize", "ysize"))
)
register("prj03_block_tile", "SELECT frame_id, block, (block // xb // 8) * xt + (block % xb) // 8 AS tile FROM (SELECT *, unnest(range(xb * yb)) AS block FROM geo)")(
    lambda s, d: G.constant_grid(I.frames(s, d), lit(0)).join(G.with_geometry(I.frames(s, d)), "frame_id").select(
        "frame_id", F.col("index").alias("block"), G.block_tile(F.col("index"), F.col("x_blocks"), F.col("x_tiles")).alias("tile"))
)
register("prj04_srgb_linear", """SELECT event_id, CAST(round_even(CASE WHEN u <= 0.04045 THEN u / 12.92 ELSE pow((u + 0.055) / 1.055, 2.4) END * 4096, 0) AS BIGINT) AS linear_q12
  FROM (SELECT event_id, (w % 256) / 255.0 AS u FROM (SELECT event_id, CAST(w AS DOUBLE) AS w FROM ev))""")(
    lambda s, d: ev(s, d).select("event_id", color.quantize_sample(color.srgb_to_linear((F.col("w") % 256).cast("double") / 255.0), 12).alias("linear_q12"))
)
register("prj05_quantize_sample", "SELECT event_id, CAST(least(greatest(round_even(d * 256, 0), -32768), 32767) AS BIGINT) AS sample FROM ev")(
    lambda s, d: ev(s, d).select("event_id", color.quantize_sample(F.col("d"), 8).alias("sample"))
)
_e = "((w * 32767 + user_id) % 2147483648)"
_ec = lambda: (F.col("w") * 32767 + F.col("user_id")) % lit(1 << 31)
scalar("prj08_strategy_mask", {"mask_q16": f"(4294967296000 + ({_e} * 1000 + 65536) // 2) // ({_e} * 1000 + 65536)"},
       mask_q16=lambda: masks.strategy_mask(_ec()))


def _nonlinear_sql():
    v = f"greatest({up(f'{huge(_e)} * 12542718', 16)}, 16777)"
    sq = up(f"{v} * {v}", 24)
    term = lambda m, den: f"({huge(m << 24)} + ({den}) // 2) // ({den})"
    return f"-12444499 + {term(54279760, sq + ' + 9196322')} + {term(216527232, v + ' + 5117727744')} + {term(84255704, sq + ' + 36785288')}"


scalar("prj09_nonlinear_mask", {"seed_q24": _nonlinear_sql()}, seed_q24=lambda: masks.nonlinear_mask(_ec()))
_g = curves.contrast_gamma()
_j = "(w % 40000)"
scalar("prj10_gamma_ratio", {
    "inverse_q20": _ratio(f"({_j} - 2000)"),
    "contrast_q16": f"CASE WHEN {_j} <= 256 THEN {at(_g['fine'], f'least({_j}, 256)')} WHEN {_j} <= 4096 THEN {_piece(_g['coarse'], f'{_j} - 256', 4, 240)} ELSE {up(f'least({_j}, 32768) * {_g['slope']}', 12)} + {_g['intercept']} END",
}, inverse_q20=lambda: masks.inverse_gamma_ratio(W() % 40000 - 2000), contrast_q16=lambda: masks.contrast_gamma(W() % 40000))
_x = "(w * 16 + 1)"
_ld = f"(length(ltrim(bin({_x}), '0')) - 1)"
_m = f"(CAST({_x} * pow(2, 20 - {_ld}) AS BIGINT) - 1048576)"
_lt = curves.log2_mantissa()
scalar("prj11_fast_log2", {"log2_q20": f"({_ld} - 20) * 1048576 + {up(f'{at(_lt, f'{_m} >> 12')} * (4096 - ({_m} & 4095)) + {at(_lt, f'({_m} >> 12) + 1')} * ({_m} & 4095)', 12)}"},
       log2_q20=lambda: masks.fast_log2(W() * 16 + 1))
_pt = curves.pow2_mantissa()
CTES["exps"] = f"""SELECT *, CASE WHEN ex >= 9 THEN 4294967295 WHEN ex < -26 THEN 0 {' '.join(f"WHEN ex = {i} THEN {f'pw * {1 << i}' if i >= 0 else up('pw', -i)}" for i in range(-26, 9))} END AS raw FROM (
  SELECT *, {up(f"{at(_pt, 'fr >> 16')} * (65536 - (fr & 65535)) + {at(_pt, '(fr >> 16) + 1')} * (fr & 65535)", 16)} AS pw FROM (
  SELECT *, lg >> 24 AS ex, lg - (lg >> 24) * 16777216 AS fr FROM (
  SELECT event_id, user_id, w, {away(f"{huge('(w * 4096 - 234881024)')} * {masks.LOG2E_Q24}", 24)} AS lg FROM ev)))"""
register("prj12_fast_exp", f"SELECT event_id, {big('least(raw, 4294967295)')} AS exp_q24 FROM exps")(
    lambda s, d: ev(s, d).select("event_id", masks.fast_exp(W() * 4096 - 234881024).alias("exp_q24"))
)
_mul = lambda a, b: f"least({up(f'{huge(a)} * {huge(b)}', 24)}, 4294967295)"
_sc, _dm = "(1739378 + user_id * 4096)", "(16777216 - (user_id % 5) * 1048576)"
register("prj13_final_map", f"""SELECT event_id, {big(f"least({_mul('least(raw, 4294967295)', _mul(_sc, _dm))} + {_mul(f'16777216 - {_dm}', f'({_sc} + 1) >> 1')}, 4294967295)")} AS map_q24 FROM exps""")(
    lambda s, d: ev(s, d).select("event_id", masks.final_map(W() * 4096 - 234881024, U() * 4096 + 1739378, lit(16777216) - (U() % 5) * 1048576).alias("map_q24"))
)
scalar("prj14_raw_quant", {"raw_quant": clip(up(f"{huge('w * 4096')} * (37449308 + user_id * 65536)", 48), 1, 255)},
       raw_quant=lambda: masks.raw_quant(W() * 4096, U() * 65536 + 37449308))
_q = "((event_id % 256) * (w % 29360))"
scalar("prj15_inverse_scale", {"inv_qac_q16": f"CASE WHEN {_q} = 0 THEN 4294967295 ELSE least((4294967296 + {_q} // 2) // {_q}, 4294967295) END"},
       inv_qac_q16=lambda: masks.inverse_ac_scale(W() % 29360, F.col("event_id") % 256))


def _cfl(base):
    from blockfield.functions.quant import cfl_factor

    return lambda: cfl_factor(F.col("event_id") % 256 - 128, base)


scalar("prj16_cfl_factor", {"x_q16": away_div("(event_id % 256 - 128) * 65536", 84), "b_q16": f"65536 + {away_div('(event_id % 256 - 128) * 65536', 84)}"},
       x_q16=_cfl(0), b_q16=_cfl(1 << 16))
_n, _w2, _nw = "(w % 401 - 200)", "(user_id % 301 - 150)", "(event_id % 351 - 175)"
north, west, corner = (lambda: W() % 401 - 200), (lambda: U() % 301 - 150), (lambda: F.col("event_id") % 351 - 175)
scalar("prj21_pack_signed", {"packed": zigzag("v - 500"), "restored": "v - 500"},
       packed=lambda: pack_signed(V() - 500), restored=lambda: unpack_signed(pack_signed(V() - 500)))
scalar("prj22_clamped_gradient", {"guess": _gradient(_n, _w2, _nw)}, guess=lambda: coding.clamped_gradient(north(), west(), corner()))
_ctx = lambda p: "CASE " + " ".join(f"WHEN {p} <= {u} THEN {c}" for u, c in C.GRADIENT_CONTEXTS) + f" ELSE {C.GRADIENT_CONTEXT_DEFAULT} END"
scalar("prj23_gradient_context", {"context": _ctx(f"least(greatest(512 + {_n} + {_w2} - {_nw}, 0), 1023)")},
       context=lambda: coding.gradient_context(coding.gradient_property(north(), west(), corner())))
_left = lambda a, b, c, d: f"CASE WHEN w % 20 > 11 THEN {a} WHEN w % 20 > 5 THEN {b} WHEN w % 20 > 3 THEN {c} ELSE {d} END"
scalar("prj24_left_contexts", {"strategy": _left(7, 8, 9, 10), "quant": _left(3, 4, 5, 6)},
       strategy=lambda: coding.strategy_context(W() % 20), quant=lambda: coding.quant_context(W() % 20))
_bc = "(CASE WHEN user_id % 3 = 0 THEN ([2,0,2])[CAST(event_id % 3 + 1 AS INTEGER)] ELSE ([3,1,3])[CAST(event_id % 3 + 1 AS INTEGER)] END)"
block_ctx = lambda: coding.block_context(F.col("event_id") % 3, U() % 3)
scalar("prj25_nonzero_context", {"context": f"(CASE WHEN w % 100 < 8 THEN w % 100 WHEN w % 100 >= 64 THEN 36 ELSE 4 + (w % 100) // 2 END) * 4 + {_bc}"},
       context=lambda: coding.nonzero_context(W() % 100, block_ctx()))
_cov = "(1 + user_id % 2)"
scalar("prj26_zero_density", {"context": f"148 + 458 * {_bc} + 2 * ({at(C.COEFF_NONZERO_CONTEXT, f'(w % 62 + 1 + {_cov} - 1) // {_cov}')} + {at(C.COEFF_FREQ_CONTEXT, f'(event_id % 62 + 2) // {_cov}')}) + w % 2"},
       context=lambda: coding.zero_density_context(W() % 62 + 1, F.col("event_id") % 62 + 2, U() % 2 + 1, W() % 2, block_ctx()))
scalar("prj27_strategy_code", {"code": "([0,6,7])[CAST(user_id % 3 + 1 AS INTEGER)]", "encoded": "(user_id % 3) * 2 + event_id % 2"},
       code=lambda: coding.strategy_code(U() % 3), encoded=lambda: coding.encode_strategy(U() % 3, F.col("event_id") % 2 == 1))


def _scan(position, table):
    from blockfield.functions.fixed import lookup

    return lambda: lookup(table, position())


scalar("prj28_scan_order", {"square": at(C.SCAN_SQUARE, "event_id % 64"), "rect": at(C.SCAN_RECT, "event_id % 128")},
       square=_scan(lambda: F.col("event_id") % 64, C.SCAN_SQUARE), rect=_scan(lambda: F.col("event_id") % 128, C.SCAN_RECT))
_ROUTE = """CASE WHEN enable_dct AND enable_quant AND enable_tokenize AND token_select = 0 THEN 10
  WHEN enable_quant AND enable_tokenize AND token_select = 1 THEN 11 WHEN enable_dct AND enable_quant THEN 8 WHEN enable_dct THEN 2
  WHEN enable_xyb AND enable_quant AND NOT enable_tokenize AND token_select = 3 THEN 13
  WHEN enable_quant AND NOT enable_tokenize THEN 6 WHEN enable_xyb THEN 1 ELSE 0 END"""
_flags = [F.col, "enable_xyb", "enable_dct", "enable_quant", "enable_tokenize", "token_select"]
register("prj29_route", f"SELECT frame_id, CAST({_ROUTE} AS BIGINT) AS stage FROM frames")(
    lambda s, d: I.frames(s, d).select("frame_id", coding.route_stage(*[F.col(c) for c in _flags[1:]]).alias("stage"))
)
register("prj30_config_words", """SELECT frame_id, CAST(enable_xyb AS BIGINT) + 2 * CAST(enable_dct AS BIGINT) + 4 * CAST(enable_quant AS BIGINT)
  + 8 * CAST(enable_tokenize AS BIGINT) + 256 * token_select AS flags, CASE WHEN fixed_ytox < 0 THEN fixed_ytox + 4294967296 ELSE fixed_ytox END AS ytox_word FROM frames""")(
    lambda s, d: I.frames(s, d).select("frame_id", coding.config_flags(*[F.col(c) for c in _flags[1:]]).alias("flags"), coding.as_uint32(F.col("fixed_ytox")).alias("ytox_word"))
)
register("prj31_overrides", """SELECT frame_id, CAST(CASE WHEN fixed_point_scale = 0 THEN scale_q16 ELSE fixed_point_scale END AS BIGINT) AS scale_q16,
  CAST(CASE WHEN fixed_point_scale = 0 AND fixed_raw_quant = 0 THEN inv_qac_q16 ELSE fixed_inv_qac_q16 END AS BIGINT) AS inv_qac_q16,
  CAST(CASE WHEN fixed_raw_quant = 0 THEN 5 ELSE fixed_raw_quant END AS BIGINT) AS raw_quant FROM params""")(lambda s, d: P.ac_scale(I.frames(s, d)))
register("prj32_fixed_grids", """SELECT frame_id, 'strategy' AS grid, "index", 1 AS value FROM (SELECT *, unnest(range(xb * yb)) AS "index" FROM geo)
  UNION ALL SELECT frame_id, 'quant', i, CASE WHEN fixed_raw_quant = 0 THEN 5 ELSE fixed_raw_quant END FROM (SELECT *, unnest(range(xb * yb)) AS i FROM geo)
  UNION ALL SELECT frame_id, 'ytox', i, fixed_ytox FROM (SELECT *, unnest(range(xt * yt)) AS i FROM geo)
  UNION ALL SELECT frame_id, 'ytob', i, fixed_ytob FROM (SELECT *, unnest(range(xt * yt)) AS i FROM geo)""")(
    lambda s, d: _grids(I.frames(s, d))
)


def _grids(frames):
    quant = F.when(F.col("fixed_raw_quant") == 0, lit(C.DEFAULT_RAW_QUANT)).otherwise(F.col("fixed_raw_quant"))
    parts = [("strategy", lit(1), "block"), ("quant", quant, "block"), ("ytox", F.col("fixed_ytox"), "tile"), ("ytob", F.col("fixed_ytob"), "tile")]
    out = None
    for name, value, unit in parts:
        part = G.constant_grid(frames, value, unit).select("frame_id", F.lit(name).alias("grid"), "index", "value")
        out = part if out is None else out.unionByName(part)
    return out


register("prj33_passthrough", """SELECT frame_id, CAST(0 AS BIGINT) AS stage, CAST(0 AS BIGINT) AS "group", (y * xsize + x) * 3 + c AS "index", ([r, g, b])[CAST(c + 1 AS INTEGER)] AS value
  FROM (SELECT p.*, f.xsize, unnest(range(3)) AS c FROM pixels p JOIN frames f USING (frame_id))""")(
    lambda s, d: G.interleaved_trace(I.pixels(s, d), I.frames(s, d))
)

# ---- filters --------------------------------------------------------------------------------------------------

register("flt01_stage", 'SELECT frame_id, "group", "index", value FROM trace WHERE stage = 11')(
    lambda s, d: T.of_stage(I.trace(s, d), "AcMetadataTokens").select("frame_id", "group", "index", "value")
)
register("flt02_token_substream", 'SELECT frame_id, "group", "index", value FROM trace WHERE stage = 12')(
    lambda s, d: T.of_stage(I.trace(s, d), "AcTokens").select("frame_id", "group", "index", "value")
)
register("flt03_crop", "SELECT frame_id, x - 5 AS x, y - 3 AS y, r, g, b FROM pixels WHERE x BETWEEN 5 AND 16 AND y BETWEEN 3 AND 12")(
    lambda s, d: G.crop(I.pixels(s, d), 5, 3, 12, 10)
)
scalar_filter = "SELECT event_id, user_id % 6 AS code FROM ev WHERE user_id % 2 = 1"
register("flt04_first_owner", scalar_filter)(
    lambda s, d: ev(s, d).select("event_id", (U() % 6).alias("code")).where(coding.is_first(F.col("code")))
)
register("flt05_frame_range", "SELECT frame_id, 'overflow' AS rule, xsize || 'x' || ysize AS detail FROM frames WHERE xsize > 64 OR ysize > 64")(
    lambda s, d: G.rejected_frames(I.frames(s, d), 64, 64)
)
_MOVED = "(x * 31 + y * 17) % 97 = 5"
register("flt05_job_rejects", f"""SELECT frame_id, 'overflow' AS rule, xsize || 'x0' AS detail FROM frames WHERE frame_id % 6 = 4
  UNION ALL SELECT frame_id, CASE WHEN frame_id % 6 = 4 THEN 'unknown_frame' ELSE 'outside' END, (CASE WHEN {_MOVED} THEN x + 1000 ELSE x END) || ',' || y FROM pixels WHERE frame_id % 6 = 4 OR {_MOVED}
  UNION ALL SELECT frame_id, 'missing_pixels', CAST(count(*) AS VARCHAR) FROM pixels WHERE frame_id % 6 <> 4 AND {_MOVED} GROUP BY frame_id""")(
    lambda s, d: G.job_rejects(
        I.pixels(s, d).withColumn("x", F.when(F.expr(_MOVED), F.col("x") + 1000).otherwise(F.col("x"))),
        I.frames(s, d).withColumn("ysize", F.when(F.col("frame_id") % 6 == 4, lit(0)).otherwise(F.col("ysize"))))
)
register("flt06_value_ranges", """SELECT event_id, unnest(list_filter([CASE WHEN w % 1000 < 100 THEN 'negative_ordinal' END, CASE WHEN user_id < 20 AND user_id % 10 <> 9 THEN 'negative_context' END,
  CASE WHEN v < 300 THEN 'negative_value' END, CASE WHEN user_id % 10 = 9 THEN 'context_range' END, CASE WHEN w % 7 = 3 AND v >= 300 THEN 'value_range' END], lambda x: x IS NOT NULL)) AS rule FROM ev""")(lambda s, d: _value_ranges(s, d))


def _value_ranges(s, d):
    """Token rows with fields out of range on either side, each with all of its reasons."""
    wide = lit(1 << 32)
    index = F.when(U() % 10 == 9, U() + wide).otherwise(U() - 20)
    value = F.when((W() % 7 == 3) & (V() >= 300), V() + wide).otherwise(V() - 300)
    rows = ev(s, d).select("event_id", (W() % 1000 - 100).alias("group"), index.alias("index"), value.alias("value"))
    return rows.select("event_id", F.explode(T.token_errors()).alias("rule"))


register("flt07_complete_regions", """SELECT frame_id, brow * xb + bcol AS block, bcol // 2 AS rx, brow // 2 AS ry FROM (
  SELECT *, i % xb AS bcol, i // xb AS brow FROM (SELECT *, unnest(range(xb * yb)) AS i FROM geo))
  WHERE (bcol // 2) * 2 + 1 < xb AND (brow // 2) * 2 + 1 < yb""")(lambda s, d: _regions(s, d))


def _regions(s, d):
    from blockfield.operators.shape import complete_regions

    frames = I.frames(s, d)
    cells = G.constant_grid(frames, lit(0)).join(G.with_geometry(frames).select("frame_id", F.col("x_blocks").alias("w")), "frame_id")
    blocks = cells.select("frame_id", F.col("index").alias("block"), (F.col("index") % F.col("w")).alias("bx"), int_div(F.col("index"), F.col("w")).alias("by"))
    return complete_regions(blocks, frames).select("frame_id", "block", "rx", "ry")


register("flt08_capability", "SELECT event_id, w & 1023 AS required FROM ev WHERE ((w & 1023) & (1023 - (user_id * 7 & 1023))) <> 0")(
    lambda s, d: ev(s, d).select("event_id", W().bitwiseAND(lit(1023)).alias("required"), (U() * 7).bitwiseAND(lit(1023)).alias("seen"))
    .where(F.col("required").bitwiseAND(F.bitwise_not(F.col("seen"))) != 0).select("event_id", "required")
)

# ---- parsing --------------------------------------------------------------------------------------------------

register("src11_register_values", "SELECT event_id, w AS parsed_hex, v - 500 AS parsed_decimal FROM ev")(
    lambda s, d: ev(s, d).select("event_id", parse_int(F.concat(F.lit("0x"), F.hex("w"))).alias("parsed_hex"), parse_int((V() - 500).cast("string")).alias("parsed_decimal"))
)
register("job03_vector_transform", "SELECT frame_id, block, k, x, y, b FROM vector_dct")(
    lambda s, d: transform.block_transform(G.blocks_to_columns(I.embedding_blocks(s, d))).select("frame_id", "block", "k", "x", "y", "b")
)
