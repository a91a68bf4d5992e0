"""CSV and JSON scans with field-level errors kept beside the data."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.fixed import lit
from blockfield.sources.elements import read_elements

TRUE_WORDS = ["1", "true", "t", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n"]

# Register map: name and byte address.
REGISTERS = [
    ("status_control", 0), ("xsize", 4), ("ysize", 8), ("distance_q8", 12), ("fixed_point_scale", 16),
    ("fixed_inv_qac_q16", 20), ("fixed_raw_quant", 24), ("flags", 28), ("fixed_ytox", 32), ("fixed_ytob", 36),
    ("identity", 40), ("abi_version", 44), ("capabilities", 48), ("max_frame_geometry", 52), ("active_route", 56),
    ("build_id", 60),
]

PREPARED_BLOCK_SCHEMA = """struct<block_index:bigint,
  block_x:bigint,block_y:bigint,tile_x:bigint,tile_y:bigint,inputs:struct<quant:bigint,scale_q16:bigint,inv_qac_q16:bigint,
  inv_dc_factor_q16:array<bigint>,x_qm_multiplier_q16:bigint,ytox:bigint,ytob:bigint,coefficients:array<array<bigint>>>,
  expected:struct<quantized_ac:array<array<bigint>>,quantized_dc:array<bigint>,num_nonzeros:array<bigint>>>"""
PREPARED_BLOCKS_SCHEMA = f"""frame_id bigint, format string, image struct<xsize:bigint,ysize:bigint,x_blocks:bigint,y_blocks:bigint,
  x_tiles:bigint,y_tiles:bigint>, coefficient_fraction_bits int, distance double, blocks array<{PREPARED_BLOCK_SCHEMA}>"""
PREPARED_TOKEN_SCHEMA = """struct<block_index:bigint,block_x:bigint,
  block_y:bigint,tile_x:bigint,tile_y:bigint,num_nonzeros:array<bigint>,quantized:array<array<bigint>>>"""
PREPARED_TOKENS_SCHEMA = f"""frame_id bigint, format string, image struct<xsize:bigint,ysize:bigint,x_blocks:bigint,y_blocks:bigint,
  x_tiles:bigint,y_tiles:bigint>, dc_samples array<bigint>, ac_blocks array<{PREPARED_TOKEN_SCHEMA}>"""
MANIFEST_SCHEMA = """frame_id bigint, format string, image struct<width:bigint,height:bigint,x_tiles:bigint,y_tiles:bigint>,
  stream struct<word_count:bigint,pixel_bits:bigint,fraction_bits:bigint>, discovery struct<required_capabilities:bigint,
  active_route:bigint>, registers map<string,bigint>, checksums map<string,string>"""


def parse_int(text: Column) -> Column:
    """Decimal, 0x, 0o or 0b integers with an optional sign; null when the text is none of them."""
    t = F.lower(F.trim(text))
    digits = F.regexp_replace(t, "^[+-]", "")
    radix = lambda base, pattern: F.when(digits.rlike(pattern), F.conv(F.substring(digits, 3, 64), base, 10))
    plain = F.when(digits.rlike("^[0-9]+$"), digits)
    body = F.coalesce(plain, radix(16, "^0x[0-9a-f]+$"), radix(8, "^0o[0-7]+$"), radix(2, "^0b[01]+$")).try_cast("bigint")
    return F.when(t.startswith("-"), -body).otherwise(body)


def parse_word(text: Column) -> Column:
    """Nonnegative integers up to 128 bits as DECIMAL(38,0), decimal or hexadecimal."""
    t = F.lower(F.trim(text))
    padded = F.lpad(F.substring(t, 3, 64), 32, "0")
    half = lambda start: F.conv(F.substring(padded, start, 8), 16, 10).cast("decimal(38,0)")
    scale = F.lit(1 << 32).cast("decimal(20,0)")
    hexed = half(1)
    for start in (9, 17, 25):
        hexed = (hexed * scale).cast("decimal(38,0)") + half(start)
    small_enough = F.substring(padded, 1, 2) == "00"
    return F.when(t.rlike("^0x[0-9a-f]{1,32}$") & small_enough, hexed.cast("decimal(38,0)")).when(
        t.rlike("^[0-9]{1,38}$"), t.try_cast("decimal(38,0)")
    )


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def parse_stage(text: Column) -> Column:
    """A stage name or an integer in any base."""
    t = F.trim(text)
    by_name = F.coalesce(*[F.when(t == name, lit(value)) for name, value in C.STAGES.items()])
    return F.coalesce(by_name, parse_int(t))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _names): the lower-case column names of every CSV file, from its first line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    first = lines.where("_at = 0").groupBy("_file").agg(F.min_by("value", "_id").alias("h"))
    clean = lambda n: F.lower(F.trim(n, F.lit(" \t\r\"\ufeff")))
    return first.select("_file", F.transform(F.split("h", ","), clean).alias("_names"))


def _ordered_csv(spark: SparkSession, path: str, columns: dict) -> DataFrame:
    """(_file, ordinal, one string column per entry of columns): columns are found by name in each file's own header.

    ``columns`` maps a name to its accepted spellings in lower case.  Position = rows of earlier splits of the file + rank
    inside the split; both come from split-level aggregates, so a file of any size is never sorted.
    """
    heads = _headers(spark, path)
    missing = F.array_compact(F.array(*[F.when(~F.arrays_overlap("_names", F.array(*map(F.lit, alias))), F.lit(c)) for c, alias in columns.items()]))
    width, lost = heads.agg(F.max(F.size("_names")), F.max(F.array_join(missing, ", "))).first()
    if lost:
        raise ValueError(f"missing CSV columns: {lost}")
    cells = [f"_c{i}" for i in range(width or 1)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", True).csv(path)
    rows = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), lit(0))).join(heads, "_file")
    place = lambda alias: F.coalesce(*[F.nullif(F.array_position("_names", F.lit(a)), lit(0)) for a in alias])
    return rows.join(splits, ["_file", "_split"]).select(
        "_file", (F.col("_base") + F.col("_id") - F.col("_first")).alias("ordinal"),
        *[F.try_element_at(F.array(*cells), place(alias).cast("int")).alias(c) for c, alias in columns.items()])


def read_trace_csv(spark: SparkSession, path: str) -> DataFrame:
    """(stage, group, index, value, _file, _line, _errors); every file's header must name all four columns, in any order."""
    raw = _ordered_csv(spark, path, {c: [c] for c in ("stage", "group", "index", "value")})
    parsed = {"stage": parse_stage(F.col("stage")), **{c: parse_int(F.col(c)) for c in ("group", "index", "value")}}
    errors = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(f"bad_{c}")) for c, v in parsed.items()]))
    return raw.select(*[v.alias(c) for c, v in parsed.items()], "_file", (F.col("ordinal") + 2).alias("_line"), errors.alias("_errors"))


def read_words_csv(spark: SparkSession, path: str) -> DataFrame:
    """(_file, ordinal, data, last, _errors) from data/tdata and last/tlast columns in any letter case and order."""
    raw = _ordered_csv(spark, path, {"data": ["data", "tdata"], "last": ["last", "tlast"]})
    data, last = parse_word(F.col("data")), parse_bool(F.col("last"))
    errors = F.array_compact(F.array(F.when(data.isNull(), F.lit("bad_data")), F.when(last.isNull(), F.lit("bad_last"))))
    return raw.select("_file", "ordinal", data.alias("data"), last.alias("last"), errors.alias("_errors"))


def read_traces(spark: SparkSession, trace_csv: str = None, words_csv: str = None, words_bin: str = None, word_size: int = 16) -> DataFrame:
    """Trace rows of captures in any mixture of formats: (stage, group, index, value, last, _file, _errors).

    ``last`` is null for trace CSV, which has no such flag.  Rows that do not parse stay, with their reasons.
    """
    from blockfield.operators.trace import unpack_binary, unpack_words
    from blockfield.sources.binary import read_words_bin

    columns, parts = ["stage", "group", "index", "value"], []
    if trace_csv:
        parts.append(read_trace_csv(spark, trace_csv).select(*columns, F.lit(None).cast("boolean").alias("last"), "_file", "_errors"))
    wide = F.when(F.col("oversized"), F.array(F.lit("width"))).otherwise(F.array().cast("array<string>"))
    if words_csv:
        parts.append(unpack_words(read_words_csv(spark, words_csv)).select(*columns, "last", "_file", F.concat("_errors", wide).alias("_errors")))
    if words_bin:
        rows = unpack_binary(read_words_bin(spark, words_bin, word_size, ".last"))
        parts.append(rows.select(*columns, "last", F.col("_file") if "_file" in rows.columns else F.lit(words_bin).alias("_file"), wide.alias("_errors")))
    if not parts:
        raise ValueError("no input given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', {address}L)" for name, address in REGISTERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(register, address)")


def read_register_log(spark: SparkSession, path: str) -> DataFrame:
    """(_file, register, address, data, strb or resp) with unknown addresses left without a name."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    extra = [c for c in ("strb", "resp") if c in raw.columns]
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), parse_int(F.col("address")).alias("address"),
                      parse_int(F.col("data")).alias("data"), *[parse_int(F.col(c)).alias(c) for c in extra])
    return rows.join(F.broadcast(register_table(spark)), "address", "left")


def _json(spark: SparkSession, path: str, schema: str, suffix: str = None, multi_line: bool = True) -> DataFrame:
    """One document per file, or one per line when ``multi_line`` is off, with ``_file`` and ``_document``: its faults.

    A document that is no JSON has the fault ``malformed``, one whose format does not end in ``suffix`` has ``format``.
    """
    docs = spark.read.schema(schema + ", _corrupt string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    other = F.lit(False) if suffix is None else ~F.coalesce(F.col("format").endswith(suffix), F.lit(False))
    faults = F.array_compact(F.array(F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")).when(other, F.lit("format"))))
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), faults.alias("_document")).drop("_corrupt")


def rejected_documents(docs: DataFrame) -> DataFrame:
    """(_file, frame_id, rule) of the faults of whole documents."""
    return docs.select("_file", "frame_id", F.explode("_document").alias("rule"))


def image_errors() -> Column:
    """Geometry reasons of an ``image`` struct."""
    i = lambda f: F.col(f"image.{f}")
    grid = lambda size, cells, n: F.floor((i(size) + (n - 1)) / n) != i(cells)
    return F.array_compact(F.array(
        F.when((i("xsize") <= 0) | (i("ysize") <= 0), F.lit("size")),
        F.when(grid("xsize", "x_blocks", 8) | grid("ysize", "y_blocks", 8), F.lit("block_grid")),
        F.when(grid("xsize", "x_tiles", 64) | grid("ysize", "y_tiles", 64), F.lit("tile_grid")),
    ))


def _streamed(spark: SparkSession, path: str, schema: str, suffix: str, *arrays: str) -> tuple:
    """(documents, elements) of one document a file, read incrementally.

    documents: the schema's other members, _file, _document (faults) and _n_<array>; elements: _file, array, position and the
    element's JSON text.
    """
    rows = read_elements(spark, path, *arrays)
    parts = [F.from_json("element", schema).alias("d"), F.col("file").alias("_file"), "counts", "error"]
    docs = rows.where("array IS NULL").select(*parts).select("d.*", "_file", "error", *[F.coalesce(F.try_element_at("counts", F.lit(a)), F.lit(0)).alias(f"_n_{a}") for a in arrays])
    other = F.lit(False) if suffix is None else ~F.coalesce(F.col("format").endswith(suffix), F.lit(False))
    faults = F.array_compact(F.array(F.when(F.col("error").isNotNull(), F.lit("malformed")).when(other, F.lit("format"))))
    return docs.withColumn("_document", faults).drop("error", *arrays), rows.where("array IS NOT NULL").select(F.col("file").alias("_f"), "array", "position", "element")


def _whole_blocks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Block rows of documents on a line each."""
    docs = _json(spark, path, PREPARED_BLOCKS_SCHEMA, suffix, False).withColumn("_image", F.concat("_document", image_errors()))
    docs = docs.withColumn("_n_blocks", F.size("blocks"))
    return _counted(docs).select("frame_id", "image", "coefficient_fraction_bits", "_image", F.posexplode_outer("blocks").alias("_at", "block"))


def _counted(docs: DataFrame) -> DataFrame:
    wrong = F.col("_n_blocks") != F.col("image.x_blocks") * F.col("image.y_blocks")
    return docs.withColumn("_image", F.when(wrong, F.array_append("_image", F.lit("block_count"))).otherwise(F.col("_image")))


def _streamed_blocks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Block rows of documents in files of their own, however many blocks they hold; a document that breaks off, or has no
    block, has a row without a block behind those that were read."""
    docs, elements = _streamed(spark, path, PREPARED_BLOCKS_SCHEMA, suffix, "blocks")
    docs = _counted(docs.withColumn("_image", F.concat("_document", F.coalesce(image_errors(), F.array().cast("array<string>")))))
    block = F.from_json("element", PREPARED_BLOCK_SCHEMA).alias("block")
    rows = elements.join(docs, F.col("_f") == F.col("_file")).select("frame_id", "image", "coefficient_fraction_bits", "_image", F.col("position").cast("int").alias("_at"), block)
    bare = docs.where((F.col("_n_blocks") == 0) | F.array_contains("_document", "malformed")).select(
        "frame_id", "image", "coefficient_fraction_bits", "_image", F.col("_n_blocks").cast("int").alias("_at"), F.lit(None).cast(PREPARED_BLOCK_SCHEMA).alias("block"))
    return rows.unionByName(bare)


def read_prepared_blocks_json(spark: SparkSession, path: str, suffix: str = None, multi_line: bool = True) -> DataFrame:
    """One row per block with its inputs, expectations and errors.

    With ``multi_line`` a file is one document and is read incrementally, so a document may hold any number of blocks; else a
    line is.  Rows without a block are rejects of the document.
    """
    rows = _streamed_blocks(spark, path, suffix) if multi_line else _whole_blocks(spark, path, suffix)
    b, n = (lambda f: F.col(f"block.{f}")), F.col("block.inputs")
    ranged = lambda c, lo, hi, name: F.when(~F.coalesce(c.between(lo, hi), F.lit(False)), F.lit(name))
    outside = lambda values, lo, hi, name: F.when(F.exists(values, lambda v: v.isNull() | ~v.between(lo, hi)), F.lit(name))
    counted = F.transform(b("expected.quantized_ac"), lambda plane: F.size(F.filter(F.slice(plane, 2, 63), lambda v: v != 0)).cast("bigint"))
    errors = F.array_compact(F.concat(F.col("_image"), F.array(
        F.when(b("block_index") != F.col("_at"), F.lit("block_order")),
        F.when((b("block_x") != F.col("_at") % F.col("image.x_blocks")) | (b("block_y") != F.floor(F.col("_at") / F.col("image.x_blocks"))), F.lit("block_position")),
        ranged(n["quant"], 0, 255, "quant"), ranged(n["scale_q16"], 0, 65535, "scale_q16"),
        ranged(n["inv_qac_q16"], 0, (1 << 32) - 1, "inv_qac_q16"), ranged(n["ytox"], -128, 127, "ytox"), ranged(n["ytob"], -128, 127, "ytob"),
        F.when(F.exists(n["coefficients"], lambda plane: F.size(plane) != 64) | (F.size(n["coefficients"]) != 3), F.lit("coefficients")),
        F.when(counted != b("expected.num_nonzeros"), F.lit("nonzero_count")),
        F.when((b("tile_x") != F.floor(b("block_x") / 8)) | (b("tile_y") != F.floor(b("block_y") / 8)), F.lit("tile_position")),
        outside(F.flatten(n["coefficients"]), -(1 << 31), (1 << 31) - 1, "coefficient_range"),
        outside(F.flatten(b("expected.quantized_ac")), -(1 << 31), (1 << 31) - 1, "level_range"),
        outside(b("expected.num_nonzeros"), 0, 63, "nonzero_range"), outside(b("expected.quantized_dc"), -(1 << 31), (1 << 31) - 1, "dc_range"),
        F.when(F.size(b("expected.quantized_dc")) != 3, F.lit("dc_length")),
        F.when(F.size(n["inv_dc_factor_q16"]) != 3, F.lit("inv_dc_length")), outside(n["inv_dc_factor_q16"], 0, (1 << 32) - 1, "inv_dc_range"),
        ranged(n["x_qm_multiplier_q16"], 0, (1 << 32) - 1, "x_qm_q16"),
    )))
    errors = F.when(F.col("block").isNull(), F.array_append("_image", F.lit("no_block"))).otherwise(errors)
    return rows.select(
        "frame_id", b("block_index").alias("block"), b("block_x").alias("bx"), b("block_y").alias("by"),
        n["quant"].alias("quant"), n["scale_q16"].alias("scale_q16"), n["inv_qac_q16"].alias("inv_qac_q16"),
        *[n["inv_dc_factor_q16"][i].alias(f"inv_dc_{p}_q16") for i, p in enumerate("xyb")],
        n["x_qm_multiplier_q16"].alias("x_qm_q16"), n["ytox"].alias("ytox"), n["ytob"].alias("ytob"),
        *[n["coefficients"][i].alias(p) for i, p in enumerate("xyb")],
        b("expected.quantized_dc").alias("dc"), b("expected.num_nonzeros").alias("num_nonzeros"), b("expected.quantized_ac").alias("quantized"),
        errors.alias("_errors"),
    )


def read_prepared_tokens_json(spark: SparkSession, path: str, suffix: str = None, multi_line: bool = True) -> tuple:
    """(dc samples by ordinal, AC rows by block and channel, rejects (_file, frame_id, rule)).

    Documents with a fault of their own (malformed, another format, a bad image, sample or block counts that do not fit the
    image) give no samples but a reject each; values out of range give their rows and a reject.
    """
    blocks = F.col("image.x_blocks") * F.col("image.y_blocks")
    counts = F.array_compact(F.array(
        F.when(F.col("_n_dc_samples") != 3 * blocks, F.lit("dc_count")), F.when(F.col("_n_ac_blocks") != blocks, F.lit("block_count"))))
    if multi_line:
        docs, elements = _streamed(spark, path, PREPARED_TOKENS_SCHEMA, suffix, "dc_samples", "ac_blocks")
    else:
        docs = _json(spark, path, PREPARED_TOKENS_SCHEMA, suffix, False).withColumns({f"_n_{a}": F.size(a) for a in ("dc_samples", "ac_blocks")})
    shape = F.when(F.col("image").isNull(), F.array(F.lit("image"))).otherwise(F.concat(image_errors(), F.coalesce(counts, F.array().cast("array<string>"))))
    docs = docs.withColumn("_document", F.when(F.size("_document") > 0, F.col("_document")).otherwise(shape))
    good = docs.where(F.size("_document") == 0)
    if multi_line:
        met = elements.join(good.select("_file", "frame_id"), F.col("_f") == F.col("_file"))
        samples = met.where("array = 'dc_samples'").select("_file", "frame_id", F.col("position").alias("ordinal"), F.col("element").try_cast("bigint").alias("value"))
        held = met.where("array = 'ac_blocks'").select("_file", "frame_id", F.from_json("element", PREPARED_TOKEN_SCHEMA).alias("b"))
    else:
        samples = good.select("_file", "frame_id", F.posexplode("dc_samples").alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
        held = good.select("_file", "frame_id", F.explode("ac_blocks").alias("b"))
    dc = samples.drop("_file")
    ac = held.select(
        "_file", "frame_id", F.col("b.block_index").alias("block"), F.posexplode(F.arrays_zip("b.num_nonzeros", "b.quantized")).alias("channel", "e")
    ).select("_file", "frame_id", "block", F.col("channel").cast("bigint").alias("channel"), F.col("e.num_nonzeros").alias("nonzeros"), F.col("e.quantized").alias("coefficients"))
    levels = F.col("coefficients")
    counted = F.size(F.filter(F.slice(levels, 2, 63), lambda v: v != 0)).cast("bigint")
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("nonzeros").between(0, 63), F.lit(False)), F.lit("nonzero_range")),
        F.when(F.size(levels) != 64, F.lit("coefficients")), F.when(counted != F.col("nonzeros"), F.lit("nonzero_count")),
        F.when(F.exists(levels, lambda v: v.isNull() | ~v.between(-(1 << 31), (1 << 31) - 1)), F.lit("level_range"))))
    wrong = samples.where(F.col("value").isNull() | ~F.col("value").between(-(1 << 31), (1 << 31) - 1))
    rejects = rejected_documents(docs).unionByName(ac.select("_file", "frame_id", F.explode(faults).alias("rule"))).unionByName(
        wrong.select("_file", "frame_id", F.lit("dc_range").alias("rule")))
    return dc, ac.drop("_file"), rejects


def read_manifests(spark: SparkSession, path: str, suffix: str = None, multi_line: bool = True) -> DataFrame:
    """Flat manifest rows; registers and checksums stay maps; ``errors`` names the faults of the document."""
    return _json(spark, path, MANIFEST_SCHEMA, suffix, multi_line).select(
        "frame_id", "format", F.col("image.width").alias("xsize"), F.col("image.height").alias("ysize"),
        F.col("image.x_tiles").alias("x_tiles"), F.col("image.y_tiles").alias("y_tiles"),
        F.col("stream.word_count").alias("word_count"), "discovery.required_capabilities", "discovery.active_route", "registers", "checksums", F.col("_document").alias("errors"),
    )


