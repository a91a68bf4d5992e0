"""Token contexts, predictors and coded fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.fixed import clamp, lit, lookup, shift_right_by


def clamped_gradient(north: Column, west: Column, northwest: Column) -> Column:
    low, high = F.least(north, west), F.greatest(north, west)
    return F.when(northwest < low, high).when(northwest > high, low).otherwise(north + west - northwest)


def gradient_property(north: Column, west: Column, northwest: Column) -> Column:
    return clamp(lit(512) + north + west - northwest, 0, 1023)


def gradient_context(prop: Column) -> Column:
    chain = None
    for upper, context in C.GRADIENT_CONTEXTS:
        hit = prop <= upper
        chain = F.when(hit, lit(context)) if chain is None else chain.when(hit, lit(context))
    return chain.otherwise(lit(C.GRADIENT_CONTEXT_DEFAULT))


def _left_context(left: Column, contexts) -> Column:
    a, b, c, d = (lit(v) for v in contexts)
    return F.when(left > 11, a).when(left > 5, b).when(left > 3, c).otherwise(d)


def strategy_context(left: Column) -> Column:
    return _left_context(left, (7, 8, 9, 10))


def quant_context(left: Column) -> Column:
    return _left_context(left, (3, 4, 5, 6))


def block_context(channel: Column, raw_strategy: Column) -> Column:
    return F.when(raw_strategy == C.DCT, lookup(C.BLOCK_CONTEXT_SQUARE, channel)).otherwise(
        lookup(C.BLOCK_CONTEXT_RECT, channel)
    )


def nonzero_context(predicted: Column, block_ctx: Column) -> Column:
    half = F.shiftright(predicted, 1)
    bucket = F.when(predicted < 8, predicted).when(predicted >= 64, lit(36)).otherwise(half + 4)
    return bucket * 4 + block_ctx


def zero_density_context(remaining: Column, position: Column, covered: Column, prev: Column, block_ctx: Column) -> Column:
    shift = covered - 1
    row = lookup(C.COEFF_NONZERO_CONTEXT, shift_right_by(remaining + covered - 1, shift))
    column = lookup(C.COEFF_FREQ_CONTEXT, shift_right_by(position, shift))
    offset = lit(C.NONZERO_CONTEXTS) + lit(C.ZERO_DENSITY_CONTEXTS) * block_ctx
    return offset + F.shiftleft(row + column, 1) + prev


def strategy_code(raw_strategy: Column) -> Column:
    return lookup([C.STRATEGY_CODE[s] for s in (C.DCT, C.DCT16X8, C.DCT8X16)], raw_strategy)


def encode_strategy(raw_strategy: Column, is_first: Column) -> Column:
    return F.shiftleft(raw_strategy, 1) + is_first.cast("bigint")


def raw_strategy(code: Column) -> Column:
    return F.shiftright(code, 1)


def is_first(code: Column) -> Column:
    return code.bitwiseAND(lit(1)) == 1


def config_flags(enable_xyb: Column, enable_dct: Column, enable_quant: Column, enable_tokenize: Column, token_select: Column) -> Column:
    """Enable bits 0..3 and the token selector from bit 8."""
    bit = lambda flag, n: F.shiftleft(flag.cast("bigint"), n)
    return (
        bit(enable_xyb, 0).bitwiseOR(bit(enable_dct, 1)).bitwiseOR(bit(enable_quant, 2))
        .bitwiseOR(bit(enable_tokenize, 3)).bitwiseOR(F.shiftleft(token_select.cast("bigint"), 8))
    )


def as_uint32(value: Column) -> Column:
    return value.cast("bigint").bitwiseAND(lit(0xFFFFFFFF))


def route_stage(xyb: Column, dct: Column, quant: Column, tokenize: Column, token_select: Column) -> Column:
    """The trace stage a frame's flags ask for, highest priority first."""
    s = {name: lit(v) for name, v in C.STAGES.items()}
    return (
        F.when(dct & quant & tokenize & (token_select == 0), s["DcTokens"])
        .when(quant & tokenize & (token_select == 1), s["AcMetadataTokens"])
        .when(dct & quant, s["QuantizedAc"])
        .when(dct, s["RawDct8x8"])
        .when(xyb & quant & ~tokenize & (token_select == 3), s["AqContrast"])
        .when(quant & ~tokenize, s["AcStrategy"])
        .when(xyb, s["Xyb"])
        .otherwise(s["InputPadded"])
    )
