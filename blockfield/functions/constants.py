"""Fixed values.

Every table here is a constant of the computation: results only agree with other
producers of the same traces when these integers are used exactly as listed.
Lookup tables that follow a formula are generated in ``curves.py`` instead.
"""

BLOCK = 8
TILE = 64
GROUP = 256
DC_GROUP = 2048
BLOCKS_PER_TILE = TILE // BLOCK

# Channel numbers and the order in which planes are tokenized.
X, Y, B = 0, 1, 2
PLANE_ORDER = [Y, X, B]

# Trace stages, in numeric order.
STAGES = {
    "InputPadded": 0, "Xyb": 1, "RawDct8x8": 2, "RawQuantField": 3, "YtoxMap": 4, "YtobMap": 5,
    "AcStrategy": 6, "QuantDc": 7, "QuantizedAc": 8, "NumNonzeros": 9, "DcTokens": 10,
    "AcMetadataTokens": 11, "AcTokens": 12, "AqContrast": 13, "AqFuzzyErosion": 14,
    "AqStrategyMask": 15, "AqNonlinearMask": 16, "AqHfModulation": 17, "AqColorModulation": 18,
    "AqGammaModulation": 19, "AqFinalMap": 20,
}

# Transform shapes.
DCT, DCT16X8, DCT8X16 = 0, 1, 2

# Distance parameters: distance_q8, scale_q16, inv_qac_q16, aq_scale_q24, aq_dampen_q24,
# aq_inv_global_scale_q24, quant_dc, inv_dc_factor_q16 for X / Y / B, x_qm_multiplier_q16, epf_iters.
DISTANCE_ROWS = [
    (64, 29360, 29257, 55660092, 16777216, 37449308, 10, 1202585600, 150323200, 75161600, 81920, 0),
    (128, 14680, 58514, 27830046, 16777216, 74898616, 10, 601292800, 75161600, 37580800, 65536, 0),
    (256, 7340, 117029, 13915023, 16777216, 149797232, 10, 300646400, 37580800, 18790400, 65536, 1),
    (512, 3670, 234058, 6957512, 16777216, 299594464, 10, 150323200, 18790400, 9395200, 81920, 2),
    (1024, 2107, 407685, 3478756, 16777216, 521837504, 10, 86302720, 10787840, 5393920, 81920, 3),
    (2048, 1310, 655720, 1739378, 14380471, 839321856, 11, 59023360, 7377920, 3688960, 81920, 3),
]
DISTANCE_COLUMNS = [
    "distance_q8", "scale_q16", "inv_qac_q16", "aq_scale_q24", "aq_dampen_q24", "aq_inv_global_q24",
    "quant_dc", "inv_dc_x_q16", "inv_dc_y_q16", "inv_dc_b_q16", "x_qm_q16", "epf_iters",
]
DEFAULT_DISTANCE_Q8 = 256
DEFAULT_RAW_QUANT = 5

# Shape cost parameters: distance_q8, cost1_q16, dct_multiplier_q16, rect_multiplier_q16.
SHAPE_COST_ROWS = [
    (64, 113980, 36384, 39627),
    (128, 162424, 38540, 41947),
    (256, 259311, 41504, 45247),
    (512, 453086, 44817, 49098),
    (1024, 646862, 47762, 52674),
    (2048, 646862, 49892, 55356),
]
COST2_Q16 = 292475
COST_DELTA_Q16 = 349695
INFO_LOSS_MULTIPLIER = 138
INFO_LOSS2_MULTIPLIER_Q16 = 3307497
NBITS_MULTIPLIER = 7.565053364251793

# RGB to XYB: Q26 mixing matrix rows, Q24 opsin bias, cube-root bias.
MIX_Q26 = [
    (20132659, 41741714, 5234491),
    (15435039, 46439334, 5234491),
    (16335820, 13741711, 37031333),
]
OPSIN_BIAS_Q24 = 63637
CBRT_NEGATIVE_BIAS = -0.15595420054

# Transform multipliers as real numbers; the working precision decides the integer.
SQRT2 = 1.41421356237
WC4 = [0.541196100146197, 1.3065629648763764]
WC8 = [0.5097955791041592, 0.6013448869350453, 0.8999762231364156, 2.5629154477415055]
WC16 = [
    0.5024192861881557, 0.5224986149396889, 0.5669440348163577, 0.6468217833599901,
    0.7881546234512502, 1.060677685990347, 1.7224470982383342, 5.101148618689155,
]

# Quantization thresholds per quadrant (top-left, top-right, bottom-left, bottom-right), Q12.
THRESHOLD_SQUARE_Q12 = {X: [2376, 2929, 3031, 3195], Y: [2376, 2601, 2703, 2867], B: [2376, 3072, 3072, 3072]}
THRESHOLD_RECT_Q12 = {X: [2351, 2904, 3006, 3170], Y: [2351, 2576, 2679, 2843], B: [2351, 3047, 3047, 3047]}
QUANT_BIAS_ONE_Q16 = 60945
QUANT_BIAS_OTHER_Q16 = 9503
COLOR_FACTOR_DENOMINATOR = 84
CFL_REGULARIZER_Q16 = 33
RECT_LOW_SCALE_Q32 = 3873047726

# Token contexts.
STRATEGY_CODE = {DCT: 0, DCT16X8: 6, DCT8X16: 7}
BLOCK_METADATA_LITERAL = 4
BLOCK_CONTEXT_SQUARE = [2, 0, 2]
BLOCK_CONTEXT_RECT = [3, 1, 3]
NONZERO_CONTEXTS = 148
ZERO_DENSITY_CONTEXTS = 458

# Upper bound of the gradient property and its DC context; larger properties use the default.
GRADIENT_CONTEXTS = [
    (12, 44), (120, 43), (257, 40), (321, 39), (385, 38), (417, 37), (449, 36), (465, 35), (481, 34),
    (489, 33), (497, 32), (501, 31), (505, 30), (508, 29), (509, 28), (511, 27), (512, 26), (513, 42),
    (515, 41), (517, 25), (519, 24), (523, 23), (527, 22), (535, 21), (543, 20), (559, 19), (575, 18),
    (607, 17), (639, 16), (703, 15), (767, 14), (904, 13), (1012, 12),
]
GRADIENT_CONTEXT_DEFAULT = 11

COEFF_FREQ_CONTEXT = [
    2989, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14,
    15, 15, 16, 16, 17, 17, 18, 18, 19, 19, 20, 20, 21, 21, 22, 22,
    23, 23, 23, 23, 24, 24, 24, 24, 25, 25, 25, 25, 26, 26, 26, 26,
    27, 27, 27, 27, 28, 28, 28, 28, 29, 29, 29, 29, 30, 30, 30, 30,
]

COEFF_NONZERO_CONTEXT = [
    2989, 0, 31, 62, 62, 93, 93, 93, 93, 123, 123, 123, 123, 152, 152, 152,
    152, 152, 152, 152, 152, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180,
    180, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206,
    206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206,
]

# Scan position -> coefficient offset.

SCAN_SQUARE = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

SCAN_RECT = [
    0, 1, 16, 2, 3, 17, 32, 18, 4, 5, 19, 33, 48, 34, 20, 6,
    7, 21, 35, 49, 64, 50, 36, 22, 8, 9, 23, 37, 51, 65, 80, 66,
    52, 38, 24, 10, 11, 25, 39, 53, 67, 81, 96, 82, 68, 54, 40, 26,
    12, 13, 27, 41, 55, 69, 83, 97, 112, 98, 84, 70, 56, 42, 28, 14,
    15, 29, 43, 57, 71, 85, 99, 113, 114, 100, 86, 72, 58, 44, 30, 31,
    45, 59, 73, 87, 101, 115, 116, 102, 88, 74, 60, 46, 47, 61, 75, 89,
    103, 117, 118, 104, 90, 76, 62, 63, 77, 91, 105, 119, 120, 106, 92, 78,
    79, 93, 107, 121, 122, 108, 94, 95, 109, 123, 124, 110, 111, 125, 126, 127,
]

# Inverse quantization weights, Q16, in coefficient order.

INV_SQUARE_X_Q16 = [
    0, 206438240, 205734432, 173580464, 146452064, 123563264, 104251904, 87958504,
    206438240, 206438208, 197644048, 168858816, 143419936, 121501336, 102795848, 86902568,
    205734432, 197644048, 178716208, 156605648, 135160208, 115734224, 98657424, 83869496,
    173580464, 168858816, 156605648, 140535856, 123563264, 107290176, 92430272, 79219120,
    146452064, 143419936, 135160208, 123563264, 110512008, 97348872, 84858856, 69507016,
    123563264, 121501336, 115734224, 107290176, 97348872, 86902568, 76643696, 51508872,
    104251904, 102795848, 98657424, 92430272, 84858856, 76643696, 54965184, 36571552,
    87958504, 86902568, 83869496, 79219120, 69507016, 51508872, 36571552, 25077688,
]

INV_SQUARE_Y_Q16 = [
    0, 36700132, 36602540, 32059826, 28080906, 24595806, 21543242, 18869526,
    36700132, 36700124, 35475252, 31377774, 27626534, 24275182, 21308262, 18692656,
    36602540, 35475252, 32797080, 29587730, 26377868, 23371944, 20636350, 18181960,
    32059826, 31377774, 29587730, 27192376, 24595806, 22031282, 19613446, 17390946,
    28080906, 27626534, 26377868, 24595806, 22545458, 20422610, 18348984, 16391852,
    24595806, 24275182, 23371944, 22031282, 20422610, 18692656, 16948494, 15259739,
    21543242, 21308262, 20636350, 19613446, 18348984, 16948494, 15498261, 14061320,
    18869526, 18692656, 18181960, 17390946, 16391852, 15259739, 14061320, 12849758,
]

INV_SQUARE_B_Q16 = [
    0, 19264944, 11106382, 7825810, 5592405, 5592401, 5475586, 3858222,
    19264944, 15309101, 10225394, 7393602, 5592404, 5592401, 5319209, 3763414,
    11106382, 10225394, 8310282, 6330810, 5592404, 5592400, 4887470, 3497828,
    7825810, 7393602, 6330810, 5592404, 5592401, 5592398, 4273197, 3110020,
    5592405, 5592404, 5592404, 5592401, 5592398, 4754866, 3583360, 2583396,
    5592401, 5592401, 5592400, 5592398, 4754866, 3763414, 2905322, 1914451,
    5475586, 5319209, 4887470, 4273197, 3583360, 2905322, 2042913, 1359270,
    3858222, 3763414, 3497828, 3110020, 2583396, 1914451, 1359270, 932073,
]

INV_RECT_X_Q16 = [
    0, 0, 351482304, 302498144, 260340560, 224058368, 192832592, 165958592,
    156517568, 148650848, 141179568, 134083528, 127344408, 120943968, 114865240, 109091832,
    344026528, 332760416, 305638624, 272874048, 240152000, 209745264, 182384160, 162098000,
    154257776, 146734752, 139536464, 132661392, 126103920, 119854800, 113903304, 108238480,
    249412800, 245140528, 233344832, 216411104, 196857280, 176613712, 161657424, 154849616,
    148072128, 141410400, 134918096, 128628792, 122561640, 116726944, 111128592, 105766856,
    180819760, 178733744, 172757040, 164002640, 160015184, 155358736, 150241872, 144836976,
    139278688, 133668400, 128081472, 122571768, 117177760, 111926016, 106834840, 101915664,
    151972688, 151517776, 150179008, 148029232, 145174976, 141740000, 137850368, 133623920,
    129164928, 124560888, 119883536, 115190128, 110525336, 105924096, 101412328, 97009408,
    136073696, 135747344, 134781248, 133212672, 131098424, 128508536, 125519544, 122208640,
    118649304, 114908416, 111044800, 107109336, 103144288, 99184664, 95258808, 87131720,
    121838248, 121594512, 120870608, 119687544, 118078384, 116085072, 113755448, 111140584,
    108291128, 105255920, 102080272, 98805152, 95466832, 88638608, 81576056, 74869056,
    109091832, 108904696, 108347616, 107433432, 106182512, 104621448, 102781328, 100696208,
    98401344, 95931928, 91282456, 85473728, 79714240, 74072536, 68603200, 63348060,
]

INV_RECT_Y_Q16 = [
    0, 0, 75454144, 67278640, 59988856, 53489024, 47693456, 42525840,
    37918076, 33809628, 30146336, 27555660, 26170694, 24855332, 23606088, 22419588,
    74228040, 72363336, 67811712, 62183360, 56400616, 50857872, 45705892, 40990404,
    36711328, 32848074, 29371616, 27263394, 25915762, 24631496, 23408400, 22244214,
    58055100, 57293668, 55174896, 52088344, 48452228, 44596732, 40743056, 37025296,
    33517592, 30256068, 27727174, 26434652, 25187784, 23988690, 22838164, 21736268,
    45406020, 45005212, 43850656, 42069220, 39828292, 37296556, 34619660, 31910740,
    29251082, 27470346, 26322170, 25189864, 24081334, 23002040, 21955750, 20944802,
    35512872, 35276892, 34587444, 33495998, 32076588, 30413116, 28588162, 27461204,
    26544832, 25598650, 24637402, 23672854, 22714188, 21768582, 20841362, 19936514,
    27964662, 27897594, 27699050, 27376686, 26942186, 26409936, 25795666, 25115238,
    24383754, 23614960, 22820944, 22012162, 21197300, 20383552, 19576746, 18781504,
    25039116, 24989028, 24840256, 24597126, 24266424, 23856776, 23378012, 22840628,
    22255032, 21631264, 20978632, 20305560, 19619498, 18926868, 18233248, 17543232,
    22419588, 22381128, 22266642, 22078766, 21821690, 21500874, 21122708, 20694192,
    20222572, 19715080, 19178666, 18619954, 18044936, 17459060, 16867140, 16273400,
]

INV_RECT_B_Q16 = [
    0, 0, 20243402, 15803153, 13512934, 12833763, 12188728, 11576115,
    10368222, 9244818, 8243137, 7349976, 6553601, 5843514, 5210365, 4104238,
    19539824, 18495370, 16074750, 13733018, 13143311, 12545952, 11957649, 11208311,
    10038252, 8981894, 8031300, 7177730, 6412474, 5727128, 5098416, 3945408,
    13315298, 13236487, 13014096, 12681544, 12275545, 11826284, 11140677, 10124103,
    9164965, 8273142, 7452102, 6701507, 6018757, 5400036, 4504089, 3512962,
    11922307, 11874869, 11736907, 11503300, 10890546, 10198275, 9466312, 8725592,
    7998342, 7299462, 6638258, 6019864, 5446528, 4668880, 3694896, 2915518,
    9710549, 9646023, 9457503, 9159060, 8770940, 8316084, 7817074, 7294062,
    6763785, 6239282, 5730181, 5243197, 4382544, 3539287, 2843868, 2275250,
    7594798, 7554347, 7435302, 7244232, 6991018, 6687582, 6346574, 5980274,
    5599810, 5214724, 4487047, 3742855, 3096498, 2543490, 2076260, 1479636,
    5940038, 5913646, 5835633, 5709370, 5540062, 5334221, 5065238, 4506532,
    3955062, 3428498, 2939260, 2494956, 2099149, 1578273, 1154679, 836033,
    4104238, 4068974, 3965441, 3800119, 3582897, 3325886, 3042122, 2744366,
    2444128, 2151053, 1762884, 1376423, 1058578, 803045, 601672, 445752,
]

# Luma dequantization weights, Q32, in coefficient order.

WEIGHT_SQUARE_Y_Q32 = [
    7669586, 7669590, 7690040, 8779679, 10023714, 11444023, 13065581, 14916908,
    7669590, 7669592, 7934404, 8970521, 10188574, 11595175, 13209664, 15058051,
    7690040, 7934404, 8582318, 9513233, 10670877, 12043285, 13639766, 15481003,
    8779679, 8970521, 9513233, 10351246, 11444023, 12776151, 14351123, 16185145,
    10023714, 10188574, 10670877, 11444023, 12484775, 13782517, 15340085, 17171640,
    11444023, 11595175, 12043285, 12776151, 13782517, 15058051, 16607669, 18445596,
    13065581, 13209664, 13639766, 14351123, 15340085, 16607669, 18161714, 20017678,
    14916908, 15058051, 15481003, 16185145, 17171640, 18445596, 20017678, 21905080,
]

WEIGHT_RECT_Y_Q32 = [
    2965821, 3326219, 3730411, 4183720, 4692121, 5262294, 5901752, 6618916,
    7423240, 8325290, 9336955, 10214779, 10755350, 11324531, 11923830, 12554868,
    3792030, 3889746, 4150831, 4526532, 4990636, 5534541, 6158396, 6866850,
    7667252, 8568995, 9583231, 10324282, 10861150, 11427441, 12024529, 12653851,
    4848411, 4912846, 5101504, 5403800, 5809330, 6311560, 6908538, 7602234,
    8397828, 9303092, 10151593, 10647955, 11175059, 11733654, 12324764, 12949554,
    6199068, 6254275, 6418946, 6690758, 7067212, 7546943, 8130495, 8820697,
    9622720, 10246503, 10693456, 11174136, 11688513, 12236957, 12820103, 13438894,
    7925998, 7979018, 8138068, 8403242, 8775091, 9255052, 9845858, 10249914,
    10603758, 10995696, 11424702, 11890200, 12392033, 12930331, 13505594, 14118565,
    10065381, 10089579, 10161900, 10281558, 10447370, 10657920, 10911716, 11207339,
    11543546, 11919350, 12334064, 12787248, 13278813, 13808927, 14378027, 14986818,
    11241410, 11263943, 11331404, 11443409, 11599360, 11798534, 12040159, 12323434,
    12647700, 13012415, 13417223, 13861966, 14346696, 14871714, 15437457, 16044648,
    12554868, 12576443, 12641106, 12748673, 12898862, 13091327, 13325705, 13601641,
    13918852, 14277141, 14676463, 15116846, 15598558, 16122001, 16687771, 17296630,
]

# The masking gamma and the rational fits of log2 and pow2, coefficients from the constant on.
GAMMA_EPSILON = 1e-2
GAMMA_SCALE = 226.0480446705883
GAMMA_DIVISOR = 73.377132366608819
GAMMA_RETURN = 18.6580932135
GAMMA_LOG2 = 0.693147181
GAMMA_OFFSET = 7.14672470003
LOG2_TOP = [-1.8503833400518310e-06, 1.4287160470083755, 0.74245873327820566]
LOG2_LOW = [0.99032814277590719, 1.0096718572241148, 0.17409343003366823]
POW2_TOP = [9.85506591e1, 4.88687798e1, 1.01749063e1, 1.0]
POW2_LOW = [9.85506633e1, -1.94414990e1, -2.22328856e-2, 2.10242958e-1]

# Fixed value: bias added before the cube root of the floating-point conversion.
OPSIN_BIAS = 0.0037930732552754493
