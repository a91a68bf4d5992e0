"""Reference SQL fragments: common table expressions that restate the computation for the SQL checker.

They follow the definition step by step (self-joins on clamped coordinates, windows, HUGEINT products) rather
than the layout the Spark operators use, so agreement is meaningful.
"""

import re

from blockfield.functions import constants as C
from blockfield.functions import curves, masks

CTES = {}


def with_ctes(body: str) -> str:
    """Prefix a query with the fragments it needs, dependencies first."""
    order, open_names = [], set()

    def need(text: str):
        for name in CTES:
            if name not in order and name not in open_names and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                open_names.add(name)
                need(CTES[name])
                order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + body


def up(x, n):
    return f"((({x}) + {1 << (n - 1)}) >> {n})"


def away(x, n):
    return f"(CASE WHEN ({x}) < 0 THEN -((-({x}) + {1 << (n - 1)}) >> {n}) ELSE (({x}) + {1 << (n - 1)}) >> {n} END)" if n else f"({x})"


def away_div(x, d):
    return f"(CASE WHEN ({x}) < 0 THEN -((-({x}) + ({d}) // 2) // ({d})) ELSE (({x}) + ({d}) // 2) // ({d}) END)"


def clip(x, lo, hi):
    return f"least(greatest({x}, {lo}), {hi})"


def at(values, index):
    return f"([{','.join(str(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


def big(x):
    return f"CAST({x} AS BIGINT)"


def huge(x):
    return f"CAST({x} AS HUGEINT)"


def zigzag(x):
    return f"(CASE WHEN ({x}) < 0 THEN -2 * ({x}) - 1 ELSE 2 * ({x}) END)"


def isqrt(x):
    """Floor square root: start two below the double estimate and count the steps that still fit."""
    r = f"{huge(f'floor(sqrt(CAST({x} AS DOUBLE)))')}"
    steps = " + ".join(f"CASE WHEN ({r} + {i}) * ({r} + {i}) <= ({x}) THEN 1 ELSE 0 END" for i in (0, 1, 2))
    return f"({r} - 1 + {steps})"


# ---- inputs -------------------------------------------------------------------------------------------------

CTES["samples"] = """SELECT o_orderkey // 1440 AS frame_id, o_orderkey % 1440 AS p, o_orderkey * 37 % 257 AS r,
  o_custkey % 257 AS g, CAST(floor(o_totalprice) AS BIGINT) % 257 AS b FROM orders"""
_DISTANCE = "([64,128,256,300,512,1024,2048])[CAST({f} % 7 + 1 AS INTEGER)]"
CTES["frames"] = f"""SELECT frame_id,
  CASE WHEN n <> 1440 THEN n WHEN frame_id % 2 = 0 THEN 72 ELSE 20 END AS xsize,
  CAST(CASE WHEN n <> 1440 THEN 1 WHEN frame_id % 2 = 0 THEN 20 ELSE 72 END AS BIGINT) AS ysize,
  CAST({_DISTANCE.format(f='frame_id')} AS BIGINT) AS distance_q8,
  CASE WHEN frame_id % 5 = 4 THEN 6000 ELSE 0 END AS fixed_point_scale,
  CASE WHEN frame_id % 5 IN (3, 4) THEN 102261 ELSE 0 END AS fixed_inv_qac_q16,
  CASE WHEN frame_id % 5 = 3 THEN 7 ELSE 0 END AS fixed_raw_quant,
  frame_id * 7 % 41 - 20 AS fixed_ytox, frame_id * 13 % 51 - 25 AS fixed_ytob,
  frame_id % 2 = 0 AS enable_xyb, frame_id % 3 <> 1 AS enable_dct, frame_id % 4 <> 2 AS enable_quant,
  frame_id % 5 < 3 AS enable_tokenize, frame_id % 4 AS token_select
  FROM (SELECT frame_id, count(*) AS n FROM samples GROUP BY frame_id)"""
CTES["geo"] = """SELECT *, (xsize + 7) // 8 AS xb, (ysize + 7) // 8 AS yb, (xsize + 63) // 64 AS xt, (ysize + 63) // 64 AS yt
  FROM frames"""
CTES["pixels"] = """SELECT s.frame_id, s.p % f.xsize AS x, s.p // f.xsize AS y, s.r, s.g, s.b
  FROM samples s JOIN frames f USING (frame_id)"""
CTES["padded"] = """SELECT g.frame_id, g.x, g.y, p.r, p.g, p.b, g.xb, g.yb, (g.y // 8) * g.xb + g.x // 8 AS block
  FROM (SELECT *, unnest(range(yb * 8)) AS y FROM (SELECT *, unnest(range(xb * 8)) AS x FROM geo)) g
  JOIN pixels p ON p.frame_id = g.frame_id AND p.x = least(g.x, g.xsize - 1) AND p.y = least(g.y, g.ysize - 1)"""


def _xyb(q):
    table, bias = curves.cube_root(q), curves.fixed(C.CBRT_NEGATIVE_BIAS, q)
    code = "CASE " + " ".join(f"WHEN a < {1 << (24 + 3 * (e + 1))} THEN {e}" for e in range(-8, 2)) + " ELSE 2 END"
    mix = " UNION ALL ".join(
        f"SELECT frame_id, x, y, block, xb, yb, {i} AS i, greatest({up(f'r*{m[0]} + g*{m[1]} + b*{m[2]}', 10)} + {C.OPSIN_BIAS_Q24}, 0) AS a FROM padded"
        for i, m in enumerate(C.MIX_Q26)
    )
    cell = clip("n >> 18", 64, 511)
    root = up(f"{at(table, f'{cell} - 64')} * (262144 - (n & 262143)) + {at(table, f'{cell} - 63')} * (n & 262143)", 18)
    scaled = "CASE " + " ".join(f"WHEN e = {e} THEN {up('t', -e) if e < 0 else f't * {1 << e}'}" for e in range(-8, 3)) + " END"
    normal = "CASE " + " ".join(f"WHEN e = {e} THEN {f'a * {1 << (-3 * e)}' if e < 0 else f'a >> {3 * e}'}" for e in range(-8, 3)) + " END"
    return f"""SELECT frame_id, x, y, block, xb, yb, y // 64 AS stripe,
  (max(CASE WHEN i = 0 THEN v END) - max(CASE WHEN i = 1 THEN v END)) >> 1 AS xv,
  (max(CASE WHEN i = 0 THEN v END) + max(CASE WHEN i = 1 THEN v END)) >> 1 AS yv,
  max(CASE WHEN i = 2 THEN v END) AS bv
  FROM (SELECT *, CAST(CASE WHEN a <= 0 THEN {bias} ELSE ({scaled}) + {bias} END AS BIGINT) AS v
    FROM (SELECT *, {root} AS t FROM (SELECT *, {normal} AS n FROM (SELECT *, {code} AS e FROM ({mix})))))
  GROUP BY frame_id, x, y, block, xb, yb"""


for _q in (12, 18, 21):
    CTES[f"xyb{_q}"] = _xyb(_q)

# ---- adaptive quantization ----------------------------------------------------------------------------------

CTES["near"] = """SELECT c.frame_id, c.x, c.y, c.block, c.xb, c.yb, c.stripe, c.xv, c.yv, c.bv, l.xv AS lx, l.yv AS ly, r.xv AS rx, r.yv AS ry,
  u.xv AS ux, u.yv AS uy, d.xv AS dx, d.yv AS dy
  FROM xyb12 c
  JOIN xyb12 l ON l.frame_id = c.frame_id AND l.y = c.y AND l.x = greatest(c.x - 1, 0)
  JOIN xyb12 r ON r.frame_id = c.frame_id AND r.y = c.y AND r.x = least(c.x + 1, c.xb * 8 - 1)
  JOIN xyb12 u ON u.frame_id = c.frame_id AND u.x = c.x AND u.y = greatest(c.y - 1, c.stripe * 64)
  JOIN xyb12 d ON d.frame_id = c.frame_id AND d.x = c.x AND d.y = least(c.y + 1, c.stripe * 64 + 63, c.yb * 8 - 1)"""


def _piece(table, rel, bits, last):
    base = f"(({rel}) >> {bits})"
    part = f"(({rel}) & {(1 << bits) - 1})"
    inner = f"least(greatest({base}, 0), {last - 1})"
    mixed = up(f"{at(table, inner)} * ({1 << bits} - {part}) + {at(table, inner + ' + 1')} * {part}", bits)
    return f"CASE WHEN {base} >= {last} THEN {table[-1]} ELSE {mixed} END"


def _contrast():
    g = curves.contrast_gamma()
    lim = lambda v: clip(v, -32768, 32767)
    gamma = (
        f"CASE WHEN j <= 256 THEN {at(g['fine'], 'least(j, 256)')} WHEN j <= 4096 THEN {_piece(g['coarse'], 'j - 256', 4, 240)} "
        f"ELSE {up(f'least(j, 32768) * {g['slope']}', 12)} + {g['intercept']} END"
    )
    diff = lambda a: f"4 * {lim(a + 'v')} - ({lim('l' + a)} + {lim('r' + a)} + {lim('u' + a)} + {lim('d' + a)})"
    return f"""SELECT *, least(({up('root', 6)}), {masks.INT31_MAX}) AS contrast FROM (SELECT *, {isqrt('masking')} AS root FROM (
  SELECT *, least({up(f"sy * sy + {up(f'sx * sx * {masks.CONTRAST_X_MULTIPLIER_Q16}', 16)}", 16)} * {masks.CONTRAST_SQRT_MULTIPLIER_Q16}
    + {masks.CONTRAST_OFFSET_Q40}, {masks.CONTRAST_INPUT_MAX}) AS masking FROM (
  SELECT *, {huge(up(f"({diff('x')}) * gamma", 10))} AS sx, {huge(up(f"({diff('y')}) * gamma", 10))} AS sy FROM (
  SELECT *, {gamma} AS gamma FROM (SELECT *, greatest({lim('yv')} + {masks.GAMMA_OFFSET_Q12}, 0) AS j FROM near)))))"""


CTES["contrast"] = _contrast()
CTES["cells"] = f"""SELECT frame_id, x // 4 AS cx, y // 4 AS cy, stripe, xb, least({up('sum(contrast)', 2)}, {masks.INT31_MAX}) AS v
  FROM contrast GROUP BY frame_id, x // 4, y // 4, stripe, xb"""
CTES["eroded"] = """SELECT frame_id, block, bcol, brow, stripe, CAST(least((sum(w) + 10) // 20, 2147483647) AS BIGINT) AS e FROM (
  SELECT c.frame_id, (c.cy // 2) * c.xb + c.cx // 2 AS block, c.cx // 2 AS bcol, c.cy // 2 AS brow, c.stripe,
    c.v + list_sum(list_sort(list(n.v))[1:4]) AS w
  FROM cells c
  CROSS JOIN (SELECT unnest([-1, 0, 1]) AS ox) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS oy)
  JOIN (SELECT frame_id, max(cx) AS mx, max(cy) AS my FROM cells GROUP BY frame_id) m ON m.frame_id = c.frame_id
  JOIN cells n ON n.frame_id = c.frame_id AND n.cx = least(greatest(c.cx + ox, 0), mx)
    AND n.cy = least(greatest(c.cy + oy, c.stripe * 16), c.stripe * 16 + 15, my)
  GROUP BY c.frame_id, c.cx, c.cy, c.xb, c.stripe, c.v) GROUP BY frame_id, block, bcol, brow, stripe"""


def _nonlinear():
    def term(mul, den):
        return f"({huge(mul << 24)} + ({den}) // 2) // ({den})"

    v = f"greatest({up('e * 12542718', 16)}, 16777)"
    return f"""SELECT *, CAST(-12444499 + {term(54279760, 'sq + 9196322')} + {term(216527232, 'v + 5117727744')}
      + {term(84255704, 'sq + 36785288')} AS BIGINT) AS seed,
    CAST((4294967296000 + (e * 1000 + 65536) // 2) // (e * 1000 + 65536) AS BIGINT) AS mask
    FROM (SELECT *, {up('v * v', 24)} AS sq FROM (SELECT *, {huge(v)} AS v FROM eroded))"""


CTES["masked"] = _nonlinear()


def _ratio(v):
    g = curves.inverse_gamma()
    c = clip(v, 0, 32768)
    return (
        f"CASE WHEN {c} <= 256 THEN {at(g['fine'], f'least({c}, 256)')} WHEN {c} <= 4096 THEN {_piece(g['coarse'], f'{c} - 256', 4, 240)} "
        f"ELSE {_piece(g['hdr'], f'{c} - 4096', 6, len(g['hdr']) - 1)} END"
    )


CTES["edges"] = f"""SELECT frame_id, block, sum(CASE WHEN x % 8 < 7 THEN abs(yv - ry) ELSE 0 END + CASE WHEN y % 8 < 7 THEN abs(yv - dy) ELSE 0 END) AS edge,
  sum({clip('xv * 16 - 480', 0, 1273)}) AS red, sum({clip('(bv - yv) * 16 - 17677', 0, 5694)}) AS blue,
  sum({_ratio('yv + 655 - xv')}) + sum({_ratio('yv + 655 + xv')}) AS ratio
  FROM near GROUP BY frame_id, block"""
CTES["distances"] = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in C.DISTANCE_ROWS) + f") t({', '.join(C.DISTANCE_COLUMNS)})"
CTES["params"] = """SELECT f.*, d.* EXCLUDE (distance_q8), e.distance_q8 IS NOT NULL AS supported
  FROM frames f LEFT JOIN distances e ON e.distance_q8 = f.distance_q8
  JOIN distances d ON d.distance_q8 = coalesce(e.distance_q8, 256)"""


def _modulated():
    sat = lambda v: clip(v, -(1 << 31), (1 << 31) - 1)
    fold = lambda c: up(f"{c} * s", 10)
    color = sat(
        f"hf - {fold(335218)} + {up(f'least(red, 38962) * {fold(7152598)}', 16)} + {up(f'least(blue, 174311) * {fold(1193632)}', 16)}"
    )
    log_table = curves.log2_mantissa()
    n = "(m - 1048576)"
    mantissa = up(f"{at(log_table, f'{n} >> 12')} * (4096 - ({n} & 4095)) + {at(log_table, f'({n} >> 12) + 1')} * ({n} & 4095)", 12)
    pow_table = curves.pow2_mantissa()
    fraction = "(lg - (ex * 16777216))"
    power = up(
        f"{at(pow_table, f'{fraction} >> 16')} * (65536 - ({fraction} & 65535)) + {at(pow_table, f'({fraction} >> 16) + 1')} * ({fraction} & 65535)", 16
    )
    exp = "CASE WHEN ex >= 9 THEN 4294967295 WHEN ex < -26 THEN 0 " + " ".join(
        f"WHEN ex = {i} THEN {f'pw * {1 << i}' if i >= 0 else up('pw', -i)}" for i in range(-26, 9)
    ) + " END"
    times = lambda a, b: f"least({up(f'{huge(a)} * {huge(b)}', 24)}, 4294967295)"
    return f"""SELECT frame_id, block, bcol, brow, stripe, e, mask, seed, CAST(hf AS BIGINT) AS hf, CAST(color AS BIGINT) AS color,
    CAST(gamma AS BIGINT) AS gamma, CAST(aq AS BIGINT) AS aq,
    CAST(CASE WHEN fixed_raw_quant <> 0 THEN fixed_raw_quant ELSE {clip(up('aq * aq_inv_global_q24', 48), 1, 255)} END AS BIGINT) AS rq FROM (
  SELECT *, {huge(f"least({times(f'least({exp}, 4294967295)', times('aq_scale_q24', 'aq_dampen_q24'))} + {times('16777216 - aq_dampen_q24', '(aq_scale_q24 + 1) >> 1')}, 4294967295)")} AS aq FROM (
  SELECT *, {power} AS pw FROM (SELECT *, lg >> 24 AS ex FROM (
  SELECT *, {away(f'{huge("gamma")} * {masks.LOG2E_Q24}', 24)} AS lg FROM (
  SELECT *, {sat(f"color + {away(f'((ld - 20) * 1048576 + {mantissa}) * (-1805633)', 20)}")} AS gamma FROM (
  SELECT *, CASE WHEN ld <= 20 THEN av * CAST(power_of(20 - ld) AS BIGINT) ELSE av // CAST(power_of(ld - 20) AS BIGINT) END AS m FROM (
  SELECT *, length(ltrim(bin(av), '0')) - 1 AS ld FROM (
  SELECT *, CASE WHEN s = 0 THEN hf ELSE {color} END AS color, CAST((ratio + 64) >> 7 AS BIGINT) AS av FROM (
  SELECT k.*, p.*  EXCLUDE (frame_id), q.* EXCLUDE (frame_id, block), greatest(1024 - p.distance_q8, 0) AS s,
    {sat(f"seed - {up('edge * 76895992', 20)}")} AS hf
  FROM masked k JOIN params p USING (frame_id) JOIN edges q USING (frame_id, block))))))))))""".replace(
        "power_of(20 - ld)", "pow(2, 20 - ld)").replace("power_of(ld - 20)", "pow(2, ld - 20)")


CTES["aqmap"] = _modulated()

# ---- transforms ---------------------------------------------------------------------------------------------


def _dct(v, bits, names, out):
    """Append lateral definitions for one line; returns the output names."""
    def fresh(expression):
        name = f"{names}{len(out)}"
        out.append(f"{expression} AS {name}")
        return name

    k = curves.transform_constants(bits)

    def go(w):
        n = len(w)
        if n == 2:
            return [fresh(f"{w[0]} + {w[1]}"), fresh(f"{w[0]} - {w[1]}")]
        h = n // 2
        even = go([fresh(f"{w[i]} + {w[n - 1 - i]}") for i in range(h)])
        odd = go([fresh(f"(({w[i]} - {w[n - 1 - i]}) * {k[n][i]}) >> {bits}") for i in range(h)])
        odd[0] = fresh(f"(({odd[0]} * {k['sqrt2']}) >> {bits}) + {odd[1]}")
        for i in range(1, h - 1):
            odd[i] = fresh(f"{odd[i]} + {odd[i + 1]}")
        return [value for pair in zip(even, odd) for value in pair]

    return go(v)


def transform_sql(source, keys, rows, cols, bits, guard, k):
    """Two passes over (keys, sx, sy, xv, yv, bv) samples; ``k`` is an index formula in fx and fy."""
    key = ", ".join(keys)
    lists = ", ".join(f"list({huge(p)} * {1 << guard} ORDER BY sy) AS {p}" for p in ("xv", "yv", "bv"))
    first = f"SELECT {key}, sx, {lists} FROM ({source}) GROUP BY {key}, sx"

    def line(table, n, fixed, new):
        steps, arrays = [], []
        for p in ("xv", "yv", "bv"):
            steps += [f"{p}[{i + 1}] AS {p}_{i}" for i in range(n)]
            freq = _dct([f"{p}_{i}" for i in range(n)], bits + guard, f"{p}t", steps)
            arrays.append(f"[{', '.join(f'{f} >> {n.bit_length() - 1}' for f in freq)}] AS {p}o")
        levels = f"SELECT {key}, {fixed}, {', '.join(arrays)} FROM (SELECT *, {', '.join(steps)} FROM ({table}))"
        return (
            f"SELECT {key}, {fixed}, {new}, xvo[{new} + 1] AS xv, yvo[{new} + 1] AS yv, bvo[{new} + 1] AS bv FROM "
            f"(SELECT *, unnest(range({n})) AS {new} FROM ({levels}))"
        )

    columns = line(first, rows, "sx", "fy")
    lists2 = ", ".join(f"list({p} ORDER BY sx) AS {p}" for p in ("xv", "yv", "bv"))
    second = line(f"SELECT {key}, fy, {lists2} FROM ({columns}) GROUP BY {key}, fy", cols, "fy", "fx")
    rounded = ", ".join(f"CAST({away(p, guard)} AS BIGINT) AS {o}" for p, o in (("xv", "x"), ("yv", "y"), ("bv", "b")))
    return f"SELECT {key}, CAST({k} AS BIGINT) AS k, {rounded} FROM ({second})"


def square_source(q):
    return f"SELECT frame_id, block, x // 8 AS bcol, y // 8 AS brow, stripe, x % 8 AS sx, y % 8 AS sy, xv, yv, bv FROM xyb{q}"


def tall_source(q):
    """Samples of every vertical pair, keyed brow its upper block."""
    return f"""SELECT frame_id, (y // 16) * 2 * xb + x // 8 AS block, x // 8 AS bcol, (y // 16) * 2 AS brow, stripe, x % 8 AS sx, y % 16 AS sy,
      xv, yv, bv FROM xyb{q} WHERE (y // 16) * 2 + 1 < yb"""


def flat_source(q):
    return f"""SELECT frame_id, (y // 8) * xb + (x // 16) * 2 AS block, (x // 16) * 2 AS bcol, y // 8 AS brow, stripe, x % 16 AS sx, y % 8 AS sy,
      xv, yv, bv FROM xyb{q} WHERE (x // 16) * 2 + 1 < xb"""


BLOCK = ["frame_id", "block", "bcol", "brow", "stripe"]
CTES["dct12"] = transform_sql(square_source(12), BLOCK, 8, 8, 12, 0, "fx * 8 + fy")
CTES["dct18"] = transform_sql(square_source(18), BLOCK, 8, 8, 18, 8, "fx * 8 + fy")
CTES["dct21"] = transform_sql(square_source(21), BLOCK, 8, 8, 21, 0, "fx * 8 + fy")
CTES["tall12"] = transform_sql(tall_source(12), BLOCK, 16, 8, 12, 0, "fx * 16 + fy")
CTES["flat12"] = transform_sql(flat_source(12), BLOCK, 8, 16, 12, 0, "fy * 16 + fx")
CTES["tall18"] = transform_sql(tall_source(18), BLOCK, 16, 8, 18, 8, "fx * 16 + fy")
CTES["flat18"] = transform_sql(flat_source(18), BLOCK, 8, 16, 18, 8, "fy * 16 + fx")
CTES["tall21"] = transform_sql(tall_source(21), BLOCK, 16, 8, 21, 7, "fx * 16 + fy")
CTES["flat21"] = transform_sql(flat_source(21), BLOCK, 8, 16, 21, 7, "fy * 16 + fx")

# ---- regression ---------------------------------------------------------------------------------------------


def cfl_sql(source, bits, frames_source="geo"):
    """(frame_id, tile, ytox, ytob, n) from (frame_id, bcol, brow, k, x, y, b)."""
    q16 = lambda p: f"{huge(p)} * {1 << (16 - bits)}" if bits <= 16 else f"({huge(p)} >> {bits - 16})"
    parts = []
    for p, weights, base in (("x", C.INV_SQUARE_X_Q16, 0), ("b", C.INV_SQUARE_B_Q16, 1)):
        parts.append(f"({q16('y')} * {at(weights, 'k')}) >> 16 AS m{p}, ({q16(p)} * {at(weights, 'k')}) >> 16 AS s{p}")
    fit = lambda p: (
        f"CAST({clip(away_div(f'-ab{p}', f'(aa{p} + n * 33)'), -128, 127)} AS BIGINT)"
    )
    return f"""SELECT frame_id, tile, {fit('x')} AS ytox, {fit('b')} AS ytob, n FROM (
  SELECT frame_id, tile, sum((ax * ax) >> 16) AS aax, sum((ax * (0 - sx)) >> 16) AS abx,
    sum((ab * ab) >> 16) AS aab, sum((ab * (mb - sb)) >> 16) AS abb, count(*) AS n FROM (
  SELECT *, {away_div('mx', 84)} AS ax, {away_div('mb', 84)} AS ab FROM (
  SELECT c.frame_id, (brow // 8) * g.xt + bcol // 8 AS tile, {', '.join(parts)} FROM {source} c JOIN {frames_source} g USING (frame_id)))
  GROUP BY frame_id, tile)"""


CTES["tiles12"] = cfl_sql("dct12", 12)
CTES["tiles18"] = cfl_sql("dct18", 18)

# ---- shapes -------------------------------------------------------------------------------------------------

CTES["costs_table"] = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in C.SHAPE_COST_ROWS) + ") t(dq, cost1, mul0, mul1)"
_complete = "(c.bcol // 2) * 2 + 1 < g.xb AND (c.brow // 2) * 2 + 1 < g.yb"


def _candidate_rows():
    def part(source, shape, members):
        return f"""SELECT c.frame_id, c.bcol, c.brow, {shape} AS shape, c.k, c.x, c.y, c.b, mx.aq AS cq, mx.mask AS cm, t.ytox, t.ytob
          FROM {source} c JOIN geo g USING (frame_id)
          JOIN tiles18 t ON t.frame_id = c.frame_id AND t.tile = (c.brow // 8) * g.xt + c.bcol // 8
          JOIN ({members}) mx ON mx.frame_id = c.frame_id AND mx.bcol = c.bcol AND mx.brow = c.brow WHERE {_complete}"""

    single = "SELECT frame_id, bcol, brow, aq, mask FROM aqmap"
    tall = """SELECT a.frame_id, a.bcol, a.brow, greatest(a.aq, z.aq) AS aq, greatest(a.mask, z.mask) AS mask
      FROM aqmap a JOIN aqmap z ON z.frame_id = a.frame_id AND z.bcol = a.bcol AND z.brow = a.brow + 1 WHERE a.brow % 2 = 0"""
    flat = tall.replace("z.bcol = a.bcol AND z.brow = a.brow + 1 WHERE a.brow", "z.brow = a.brow AND z.bcol = a.bcol + 1 WHERE a.bcol")
    return " UNION ALL ".join([part("dct18", 0, single), part("tall18", 1, tall), part("flat18", 2, flat)])


def _inverse(channel):
    square = {C.X: C.INV_SQUARE_X_Q16, C.Y: C.INV_SQUARE_Y_Q16, C.B: C.INV_SQUARE_B_Q16}[channel]
    rect = {C.X: C.INV_RECT_X_Q16, C.Y: C.INV_RECT_Y_Q16, C.B: C.INV_RECT_B_Q16}[channel]
    return f"(CASE WHEN shape = 0 THEN {at(square, 'least(k, 63)')} ELSE {at(rect, 'k')} END)"


def _factor(m, base):
    return f"({base} + {away_div(f'{m} * 65536', 84)})"


def _costs():
    factor = {C.X: _factor("ytox", 0), C.Y: "0", C.B: _factor("ytob", 65536)}
    plane = {C.X: "x", C.Y: "y", C.B: "b"}
    terms = " UNION ALL ".join(
        f"""SELECT frame_id, bcol, brow, shape, cm, {ch} AS ch,
          {up(f"abs({huge(plane[ch])} * 65536 - {huge('y')} * {factor[ch]}) * {huge(_inverse(ch))} * {huge('cq')}", 58)} AS mag FROM candidate_rows"""
        for ch in (C.X, C.Y, C.B)
    )
    quantized = "(mag >> 16) + CASE WHEN (mag & 65535) > 32768 OR ((mag & 65535) = 32768 AND (mag >> 16) % 2 = 1) THEN 1 ELSE 0 END"
    return f"""SELECT frame_id, bcol, brow, shape, est,
      {up(f"({huge('est')} + CASE WHEN shape = 0 THEN 196608 ELSE 0 END) * CASE WHEN shape = 0 THEN mul0 ELSE mul1 END", 16)} AS cost FROM (
  SELECT *, entropy + {up(f"{huge('cm')} * (138 * loss + {up(f'{isqrt('loss2 * CASE WHEN shape = 0 THEN 1 ELSE 2 END')} * {C.INFO_LOSS2_MULTIPLIER_Q16}', 16)})", 16)} AS est FROM (
  SELECT s.frame_id, s.bcol, s.brow, s.shape, s.cm, max(mul0) AS mul0, max(mul1) AS mul1,
    sum(ent + nnz * cost1 + {at(curves.nbits_cost(), 'nnz')}) AS entropy, sum(loss) AS loss, sum(loss2) AS loss2 FROM (
  SELECT frame_id, bcol, brow, shape, cm, ch, count(*) FILTER (q <> 0) AS nnz, sum(l) AS loss, sum(l * l) AS loss2,
    sum({up(f"{isqrt('q * 4294967296')} * {C.COST_DELTA_Q16}", 16)} + CASE WHEN q >= 2 THEN {C.COST2_Q16} ELSE 0 END) AS ent FROM (
  SELECT *, {quantized} AS q, CASE WHEN (mag & 65535) > 32768 THEN 65536 - (mag & 65535) ELSE mag & 65535 END AS l FROM ({terms}))
  GROUP BY frame_id, bcol, brow, shape, cm, ch) s
  JOIN frames f USING (frame_id) LEFT JOIN costs_table e ON e.dq = f.distance_q8
  JOIN costs_table p ON p.dq = coalesce(e.dq, 256)
  GROUP BY s.frame_id, s.bcol, s.brow, s.shape, s.cm))""".replace("nnz * cost1", "nnz * p.cost1").replace(
        "max(mul0) AS mul0, max(mul1) AS mul1", "max(p.mul0) AS mul0, max(p.mul1) AS mul1")


CTES["candidate_rows"] = _candidate_rows()
CTES["shape_costs"] = _costs()


def _decided():
    slot = {0: "shape = 0 AND bcol % 2 = 0 AND brow % 2 = 0", 1: "shape = 0 AND bcol % 2 = 1 AND brow % 2 = 0",
            2: "shape = 0 AND bcol % 2 = 0 AND brow % 2 = 1", 3: "shape = 0 AND bcol % 2 = 1 AND brow % 2 = 1",
            4: "shape = 1 AND bcol % 2 = 0", 5: "shape = 1 AND bcol % 2 = 1", 6: "shape = 2 AND brow % 2 = 0", 7: "shape = 2 AND brow % 2 = 1"}
    ks = ", ".join(f"max(cost) FILTER ({c}) AS k{i}" for i, c in slot.items())
    return f"""SELECT frame_id, rx, ry, k0, k1, k2, k3, k4, k5, k6, k7,
      least(k4, k0 + k2) + least(k5, k1 + k3) < least(k6, k0 + k1) + least(k7, k2 + k3) AS tall
      FROM (SELECT frame_id, bcol // 2 AS rx, brow // 2 AS ry, {ks} FROM shape_costs GROUP BY frame_id, bcol // 2, brow // 2)"""


CTES["regions"] = _decided()
CTES["shape_cells"] = """SELECT a.frame_id, a.block, a.bcol, a.brow, g.xb, a.rq, CASE WHEN r.frame_id IS NULL THEN 1
    WHEN r.tall AND ((a.bcol % 2 = 0 AND r.k4 < r.k0 + r.k2) OR (a.bcol % 2 = 1 AND r.k5 < r.k1 + r.k3)) THEN 3 - a.brow % 2
    WHEN NOT r.tall AND ((a.brow % 2 = 0 AND r.k6 < r.k0 + r.k1) OR (a.brow % 2 = 1 AND r.k7 < r.k2 + r.k3)) THEN 5 - a.bcol % 2
    ELSE 1 END AS code
  FROM aqmap a JOIN geo g USING (frame_id) LEFT JOIN regions r ON r.frame_id = a.frame_id AND r.rx = a.bcol // 2 AND r.ry = a.brow // 2"""
CTES["adjusted"] = """SELECT *, max(rq) OVER (PARTITION BY frame_id, owner) AS arq FROM (
  SELECT *, block - CASE code WHEN 4 THEN 1 WHEN 2 THEN xb ELSE 0 END AS owner FROM shape_cells)"""

# ---- quantization -------------------------------------------------------------------------------------------


def _thresholds(channel, rect):
    values = (C.THRESHOLD_RECT_Q12 if rect else C.THRESHOLD_SQUARE_Q12)[channel]
    width = 16 if rect else 8
    return [values[(2 if k // width >= 4 else 0) + (1 if k % width >= width // 2 else 0)] for k in range(8 * width)]


def levels_sql(source, bits):
    """Per-coefficient levels from (frame_id, block, shape, k, x, y, b, quant, scale, inv_qac, idx, idy, idb, xqm, ytox, ytob)."""
    def level(value, ch, qm):
        limit = f"(CASE WHEN shape = 0 THEN {at(_thresholds(ch, False), 'least(k, 63)')} ELSE {at(_thresholds(ch, True), 'k')} END) * {1 << (bits - 12)}"
        v = f"((({huge(value)} * {_inverse(ch)}) >> 16) * {huge('scale')} * quant * {qm}) >> 32"
        return f"(CASE WHEN abs({v}) >= {limit} THEN {away(v, bits)} ELSE 0 END)"

    weight = f"(CASE WHEN shape = 0 THEN {at(C.WEIGHT_SQUARE_Y_Q32, 'least(k, 63)')} ELSE {at(C.WEIGHT_RECT_Y_Q32, 'k')} END)"
    point = f"(CASE WHEN qy = 0 THEN 0 WHEN abs(qy) = 1 THEN qy * {C.QUANT_BIAS_ONE_Q16} ELSE (qy // abs(qy)) * (abs(qy) * 65536 - {C.QUANT_BIAS_OTHER_Q16} // abs(qy)) END)"
    return f"""SELECT *, {level('rx', C.X, 'xqm')} AS qx, {level('rb', C.B, '65536')} AS qb FROM (
  SELECT *, x - (({_factor('ytox', 0)} * luma) >> 16) AS rx, b - (({_factor('ytob', 65536)} * luma) >> 16) AS rb FROM (
  SELECT *, ({huge(point)} * {weight} * inv_qac) >> {64 - bits} AS luma FROM (
  SELECT *, {level('y', C.Y, '65536')} AS qy FROM {source})))"""


def quantized_sql(levels, bits):
    """One row per owner: levels brow coefficient, counts, DC per covered cell."""
    pair = lambda c, sign: f"(max({c}) FILTER (k = 0) {sign} {away(f'max({c}) FILTER (k = 1) * {C.RECT_LOW_SCALE_Q32}', 32)})"
    first = lambda c: f"CASE WHEN shape = 0 THEN max({c}) FILTER (k = 0) ELSE {pair(c, '+')} END"
    lows = ", ".join(f"{huge(first(c))} AS wa{p}, {huge(pair(c, '-'))} AS wb{p}" for p, c in (("x", "rx"), ("y", "y"), ("b", "rb")))
    counts = ", ".join(f"count(*) FILTER (k >= CASE WHEN shape = 0 THEN 1 ELSE 2 END AND q{p} <> 0) AS n{p}" for p in "xyb")
    dc = lambda p, cell: away(f"w{cell}{p} * id{p}", bits + 16)
    blue = lambda cell: away(f"w{cell}b * idb - d{cell}y * {1 << (15 + bits)}", bits + 16)
    return f"""SELECT *, {dc('x', 'a')} AS dax, {dc('x', 'b')} AS dbx, {blue('a')} AS dab, {blue('b')} AS dbb FROM (
  SELECT *, {dc('y', 'a')} AS day, {dc('y', 'b')} AS dby FROM (
  SELECT frame_id, block, shape, quant, ytox, ytob, idx, idy, idb, {lows}, {counts} FROM {levels}
  GROUP BY frame_id, block, shape, quant, ytox, ytob, idx, idy, idb))"""


def quantized_trace_sql(levels, blocks):
    ac = " UNION ALL ".join(
        f"SELECT frame_id, 8 AS stage, block AS \"group\", {ch} * CASE WHEN shape = 0 THEN 64 ELSE 128 END + k AS \"index\", q{p} AS value FROM {levels}"
        for ch, p in enumerate("xyb")
    )
    dc = " UNION ALL ".join(
        f"SELECT frame_id, 7, block, {ch} * CASE WHEN shape = 0 THEN 1 ELSE 2 END + {i}, d{cell}{p} FROM {blocks} WHERE shape <> 0 OR {i} = 0"
        for ch, p in enumerate("xyb") for i, cell in enumerate("ab")
    )
    counts = " UNION ALL ".join(
        [f"SELECT frame_id, 9, block, {ch}, n{p} FROM {blocks}" for ch, p in enumerate("xyb")]
        + [f"SELECT frame_id, 9, block, {ch + 3}, (n{p} + 1) >> 1 FROM {blocks} WHERE shape <> 0" for ch, p in enumerate("xyb")]
    )
    return (
        'SELECT frame_id, CAST(stage AS BIGINT) AS stage, CAST("group" AS BIGINT) AS "group", CAST("index" AS BIGINT) AS "index", '
        f"CAST(value AS BIGINT) AS value FROM ({ac} UNION ALL {dc} UNION ALL {counts})"
    )


_INV_QAC = "CASE WHEN p.fixed_raw_quant <> 0 THEN p.fixed_inv_qac_q16 ELSE least((4294967296 + (p.scale_q16 * {q}) // 2) // (p.scale_q16 * {q}), 4294967295) END"
_IDS = "p.inv_dc_x_q16 AS idx, p.inv_dc_y_q16 AS idy, p.inv_dc_b_q16 AS idb, p.x_qm_q16 AS xqm"
CTES["square_in"] = f"""SELECT c.frame_id, c.block, 0 AS shape, c.k, c.x, c.y, c.b, a.rq AS quant, p.scale_q16 AS scale,
  {_INV_QAC.format(q='a.rq')} AS inv_qac, {_IDS}, t.ytox, t.ytob
  FROM dct12 c JOIN aqmap a USING (frame_id, block) JOIN params p USING (frame_id) JOIN geo g USING (frame_id)
  JOIN tiles12 t ON t.frame_id = c.frame_id AND t.tile = (c.brow // 8) * g.xt + c.bcol // 8"""
CTES["fixed_in"] = CTES["square_in"].replace("t.ytox, t.ytob", "p.fixed_ytox AS ytox, p.fixed_ytob AS ytob").split("\n  JOIN tiles12")[0]
_owner_rows = """SELECT c.frame_id, c.block, c.bcol, c.brow, {s} AS shape, c.k, c.x, c.y, c.b, o.arq FROM {t} c
  JOIN adjusted o ON o.frame_id = c.frame_id AND o.block = c.block AND o.code = {code}"""
CTES["owner_in"] = f"""SELECT c.frame_id, c.block, c.shape, c.k, c.x, c.y, c.b, c.arq AS quant, p.scale_q16 AS scale,
  {_INV_QAC.format(q='c.arq')} AS inv_qac, {_IDS}, t.ytox, t.ytob FROM (
  {' UNION ALL '.join(_owner_rows.format(s=s, t=t, code=code) for s, t, code in ((0, 'dct21', 1), (1, 'tall21', 3), (2, 'flat21', 5)))}) c
  JOIN params p USING (frame_id) JOIN geo g USING (frame_id)
  JOIN tiles18 t ON t.frame_id = c.frame_id AND t.tile = (c.brow // 8) * g.xt + c.bcol // 8"""
for _n, _bits in (("square", 12), ("fixed", 12), ("owner", 21)):
    CTES[f"{_n}_levels"] = levels_sql(f"{_n}_in", _bits)
    CTES[f"{_n}_blocks"] = quantized_sql(f"{_n}_levels", _bits)

# ---- prepared coefficient blocks from embeddings --------------------------------------------------------------

CTES["vectors"] = "SELECT vec_id, label, count(*) OVER () AS n, vec_id // 25 AS frame_id, vec_id % 25 AS block, embedding FROM embeddings"
CTES["block_frames"] = f"""SELECT frame_id, CASE WHEN c = 25 THEN 40 ELSE c * 8 END AS xsize, CASE WHEN c = 25 THEN 40 ELSE 8 END AS ysize,
  CASE WHEN c = 25 THEN 5 ELSE c END AS xb, CASE WHEN c = 25 THEN 5 ELSE 1 END AS yb,
  (CASE WHEN c = 25 THEN 40 ELSE c * 8 END + 63) // 64 AS xt, 1 AS yt,
  CAST({_DISTANCE.format(f='frame_id')} AS BIGINT) AS distance_q8, frame_id * 7 % 41 - 20 AS ytox, frame_id * 13 % 51 - 25 AS ytob
  FROM (SELECT frame_id, count(*) AS c FROM vectors GROUP BY frame_id)"""


def _embedding_rows(scale):
    value = lambda v: f"CAST(floor(CAST({v}.embedding[k + 1] AS DOUBLE) * {scale}) AS BIGINT)"
    return f"""SELECT v.frame_id, v.block, v.block % f.xb AS bcol, v.block // f.xb AS brow, 0 AS stripe, v.vec_id, v.label, k,
      {value('cx')} AS x, {value('v')} AS y, {value('cb')} AS b
      FROM (SELECT *, unnest(range(64)) AS k FROM vectors) v JOIN block_frames f USING (frame_id)
      JOIN vectors cx ON cx.vec_id = (v.vec_id + 1) % v.n JOIN vectors cb ON cb.vec_id = (v.vec_id + 2) % v.n"""


CTES["vector_samples"] = _embedding_rows(4096)
CTES["vector_coefficients"] = _embedding_rows(65536)
CTES["vector_dct"] = transform_sql(
    "SELECT frame_id, block, bcol, brow, stripe, k % 8 AS sx, k // 8 AS sy, x AS xv, y AS yv, b AS bv FROM vector_samples",
    BLOCK, 8, 8, 12, 0, "fx * 8 + fy",
)
CTES["prepared_in"] = """SELECT c.frame_id, c.block, c.bcol, c.brow, 0 AS shape, c.k, c.x, c.y, c.b, c.vec_id % 16 + 1 AS quant, p.scale_q16 AS scale,
  least((4294967296 + (p.scale_q16 * (c.vec_id % 16 + 1)) // 2) // (p.scale_q16 * (c.vec_id % 16 + 1)), 4294967295) AS inv_qac,
  p.inv_dc_x_q16 AS idx, p.inv_dc_y_q16 AS idy, p.inv_dc_b_q16 AS idb, p.x_qm_q16 AS xqm, f.ytox, f.ytob
  FROM vector_coefficients c JOIN block_frames f USING (frame_id) LEFT JOIN distances e ON e.distance_q8 = f.distance_q8
  JOIN distances p ON p.distance_q8 = coalesce(e.distance_q8, 256)"""
CTES["prepared_levels"] = levels_sql("prepared_in", 16)
CTES["prepared_blocks"] = quantized_sql("prepared_levels", 16)
CTES["prepared_tiles"] = "SELECT frame_id, unnest(range(xt * yt)) AS tile, ytox, ytob FROM block_frames"
CTES["fixed_tiles"] = "SELECT frame_id, unnest(range(xt * yt)) AS tile, fixed_ytox AS ytox, fixed_ytob AS ytob FROM geo"

# ---- tokens -------------------------------------------------------------------------------------------------


def _gradient(n, w, nw):
    return f"(CASE WHEN {nw} < least({n}, {w}) THEN greatest({n}, {w}) WHEN {nw} > greatest({n}, {w}) THEN least({n}, {w}) ELSE {n} + {w} - {nw} END)"


def dc_tokens_sql(blocks, geo):
    cells = " UNION ALL ".join(
        f"""SELECT q.frame_id, block + {step} AS block, {rank} AS rank, d{cell}{p} AS v, g.xb, g.xb * g.yb AS total
          FROM {blocks} q JOIN {geo} g USING (frame_id) WHERE {cond}"""
        for rank, p in enumerate("yxb")
        for cell, step, cond in (("a", "0", "TRUE"), ("b", "CASE WHEN shape = 1 THEN g.xb ELSE 1 END", "shape <> 0"))
    )
    context = "CASE " + " ".join(f"WHEN prop <= {u} THEN {c}" for u, c in C.GRADIENT_CONTEXTS) + f" ELSE {C.GRADIENT_CONTEXT_DEFAULT} END"
    return f"""SELECT frame_id, CAST(rank * total + block AS BIGINT) AS ordinal, CAST({context} AS BIGINT) AS context,
    CAST({zigzag(f"v - {_gradient('n', 'w', 'nw')}")} AS BIGINT) AS value FROM (
  SELECT *, least(greatest(512 + n + w - nw, 0), 1023) AS prop FROM (
  SELECT *, CASE WHEN brow <> 0 THEN north ELSE w END AS n, CASE WHEN bcol <> 0 AND brow <> 0 THEN corner ELSE w END AS nw FROM (
  SELECT c.*, CASE WHEN bcol <> 0 THEN l.v WHEN brow <> 0 THEN u.v ELSE 0 END AS w, u.v AS north, x.v AS corner FROM (
    SELECT *, block % xb AS bcol, block // xb AS brow FROM ({cells})) c
  LEFT JOIN ({cells}) l ON l.frame_id = c.frame_id AND l.rank = c.rank AND l.block = c.block - 1
  LEFT JOIN ({cells}) u ON u.frame_id = c.frame_id AND u.rank = c.rank AND u.block = c.block - c.xb
  LEFT JOIN ({cells}) x ON x.frame_id = c.frame_id AND x.rank = c.rank AND x.block = c.block - c.xb - 1)))"""


def metadata_tokens_sql(owners, tiles, geo):
    """``owners``: (frame_id, block, shape, quant)."""
    left_ctx = lambda v, a, b, c, d: f"CASE WHEN {v} > 11 THEN {a} WHEN {v} > 5 THEN {b} WHEN {v} > 3 THEN {c} ELSE {d} END"
    maps = " UNION ALL ".join(f"SELECT frame_id, {i} AS m, tile, {c} AS v FROM {tiles}" for i, c in enumerate(("ytox", "ytob")))
    cfl = f"""SELECT frame_id, m * tt + tile AS ordinal, 2 - m AS context, {zigzag(f"v - {_gradient('n', 'w', 'nw')}")} AS value FROM (
      SELECT *, CASE WHEN ty <> 0 THEN north ELSE w END AS n, CASE WHEN tx <> 0 AND ty <> 0 THEN corner ELSE w END AS nw FROM (
      SELECT c.*, CASE WHEN tx <> 0 THEN l.v WHEN ty <> 0 THEN u.v ELSE 0 END AS w, u.v AS north, x.v AS corner FROM (
        SELECT k.*, g.xt, g.xt * g.yt AS tt, tile % g.xt AS tx, tile // g.xt AS ty FROM ({maps}) k JOIN {geo} g USING (frame_id)) c
      LEFT JOIN ({maps}) l ON l.frame_id = c.frame_id AND l.m = c.m AND l.tile = c.tile - 1
      LEFT JOIN ({maps}) u ON u.frame_id = c.frame_id AND u.m = c.m AND u.tile = c.tile - c.xt
      LEFT JOIN ({maps}) x ON x.frame_id = c.frame_id AND x.m = c.m AND x.tile = c.tile - c.xt - 1))"""
    own = f"""SELECT o.frame_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o.frame_id) AS n, code, quant - 1 AS q,
      lag(code) OVER w AS pc, lag(quant - 1) OVER w AS pq, 2 * g.xt * g.yt AS start
      FROM (SELECT *, ([0, 6, 7])[CAST(shape AS INTEGER) + 1] AS code FROM {owners}) o JOIN {geo} g USING (frame_id)
      WINDOW w AS (PARTITION BY o.frame_id ORDER BY block)"""
    strategy = f"SELECT frame_id, start + i, {left_ctx('coalesce(pc, 0)', 7, 8, 9, 10)}, {zigzag('code')} FROM ({own})"
    quant = f"SELECT frame_id, start + n + i, {left_ctx('coalesce(pq, code)', 3, 4, 5, 6)}, {zigzag('q - coalesce(pq, code)')} FROM ({own})"
    literal = f"""SELECT frame_id, 2 * tt + 2 * n + unnest(range(cells)), 0, 8 FROM (
      SELECT o.frame_id, count(*) AS n, max(g.xt * g.yt) AS tt, max(g.xb * g.yb) AS cells FROM {owners} o JOIN {geo} g USING (frame_id) GROUP BY o.frame_id)"""
    return f"""SELECT frame_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(context AS BIGINT) AS context, CAST(value AS BIGINT) AS value
      FROM ({cfl} UNION ALL {strategy} UNION ALL {quant} UNION ALL {literal})"""


def ac_tokens_sql(levels, blocks, geo, prefix_only=False):
    ctx = "(CASE WHEN shape = 0 THEN ([2, 0, 2])[ch + 1] ELSE ([3, 1, 3])[ch + 1] END)"
    covered = "(CASE WHEN shape = 0 THEN 1 ELSE 2 END)"
    planes = (("y", 1), ("x", 0), ("b", 2))
    counts = " UNION ALL ".join(
        f"SELECT q.frame_id, q.block, shape, {rank} AS rank, {ch} AS ch, n{p} AS nnz, CASE WHEN shape = 0 THEN n{p} ELSE (n{p} + 1) >> 1 END AS shown, g.xb FROM {blocks} q JOIN {geo} g USING (frame_id)"
        for rank, (p, ch) in enumerate(planes)
    )
    cells = f"""SELECT frame_id, block AS cell, rank, shown, xb FROM ({counts}) UNION ALL
      SELECT frame_id, block + CASE WHEN shape = 1 THEN xb ELSE 1 END, rank, shown, xb FROM ({counts}) WHERE shape <> 0"""
    predicted = f"""SELECT c.frame_id, c.cell AS block, c.rank, CASE WHEN c.cell = 0 THEN 32 WHEN c.cell % c.xb = 0 THEN u.shown
      WHEN c.cell // c.xb = 0 THEN l.shown ELSE (u.shown + l.shown + 1) >> 1 END AS predicted FROM ({cells}) c
      LEFT JOIN ({cells}) l ON l.frame_id = c.frame_id AND l.rank = c.rank AND l.cell = c.cell - 1
      LEFT JOIN ({cells}) u ON u.frame_id = c.frame_id AND u.rank = c.rank AND u.cell = c.cell - c.xb"""
    bucket = "CASE WHEN predicted < 8 THEN predicted WHEN predicted >= 64 THEN 36 ELSE 4 + predicted // 2 END"
    prefix = f"""SELECT c.frame_id, c.block, c.rank, -1 AS pos, ({bucket}) * 4 + {ctx} AS context, nnz AS value
      FROM ({counts}) c JOIN ({predicted}) USING (frame_id, block, rank)"""
    inverse = [C.SCAN_SQUARE.index(k) for k in range(64)]
    inverse_rect = [C.SCAN_RECT.index(k) for k in range(128)]
    flat = " UNION ALL ".join(f"SELECT frame_id, block, shape, {rank} AS rank, {ch} AS ch, k, q{p} AS v FROM {levels}" for rank, (p, ch) in enumerate(planes))
    scan = f"""SELECT *, n - coalesce(sum(nz) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
        coalesce(lag(nz) OVER w, CASE WHEN n <= CASE WHEN shape = 0 THEN 4 ELSE 8 END THEN 1 ELSE 0 END) AS prev FROM (
      SELECT *, sum(nz) OVER (PARTITION BY frame_id, block, rank) AS n FROM (
      SELECT *, CASE WHEN v <> 0 THEN 1 ELSE 0 END AS nz,
        CASE WHEN shape = 0 THEN {at(inverse, 'least(k, 63)')} ELSE {at(inverse_rect, 'k')} END AS pos FROM ({flat}))
      WHERE pos >= {covered})
      WINDOW w AS (PARTITION BY frame_id, block, rank ORDER BY pos)"""
    density = f"""148 + 458 * {ctx} + 2 * ({at(C.COEFF_NONZERO_CONTEXT, f"(remaining + {covered} - 1) // {covered}")} + {at(C.COEFF_FREQ_CONTEXT, f"pos // {covered}")}) + prev"""
    rows = prefix if prefix_only else f"{prefix} UNION ALL SELECT frame_id, block, rank, pos, {density}, {zigzag('v')} FROM ({scan}) WHERE remaining > 0"
    return f"""SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY block, rank, pos) - 1 AS BIGINT) AS ordinal,
      CAST(context AS BIGINT) AS context, CAST(value AS BIGINT) AS value,
      row_number() OVER (PARTITION BY frame_id ORDER BY block DESC, rank DESC, pos DESC) = 1 AS last FROM ({rows})"""


def all_tokens_sql(levels, blocks, tiles, geo):
    grid = f"""SELECT q.frame_id, block, shape * 2 + 1 AS code FROM {blocks} q UNION ALL
      SELECT q.frame_id, block + CASE WHEN shape = 1 THEN g.xb ELSE 1 END, shape * 2 FROM {blocks} q JOIN {geo} g USING (frame_id) WHERE shape <> 0"""
    parts = [
        f'SELECT frame_id, 0 AS phase, 10 AS stage, ordinal AS "group", context AS "index", value, FALSE AS last FROM ({dc_tokens_sql(blocks, geo)})',
        f"SELECT frame_id, 1, 6, 0, block, code, FALSE FROM ({grid})",
        f"SELECT frame_id, 2, 11, ordinal, context, value, FALSE FROM ({metadata_tokens_sql(blocks, tiles, geo)})",
        f"SELECT frame_id, 3, 12, ordinal, context, value, last FROM ({ac_tokens_sql(levels, blocks, geo)})",
    ]
    return (
        'SELECT frame_id, CAST(phase AS BIGINT) AS phase, CAST(stage AS BIGINT) AS stage, CAST("group" AS BIGINT) AS "group", '
        f'CAST("index" AS BIGINT) AS "index", CAST(value AS BIGINT) AS value, last FROM ({" UNION ALL ".join(parts)})'
    )


# ---- traces -------------------------------------------------------------------------------------------------

CTES["trace"] = """SELECT event_id // 500 AS frame_id, event_id % 3 + 10 AS stage,
  row_number() OVER (PARTITION BY event_id // 500, event_id % 3 ORDER BY event_id) - 1 AS "group", user_id AS "index",
  CAST(floor(value) AS BIGINT) AS value, event_id, ts FROM events"""
CTES["trace_actual"] = """SELECT * REPLACE (value + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS value) FROM trace WHERE event_id % 211 <> 0"""
