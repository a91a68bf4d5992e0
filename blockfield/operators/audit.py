"""Bundle audits: manifests against the streams, registers and artifacts they describe.

Every rule is a join or an aggregate and yields (frame_id, rule, field, expected, actual) rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockfield.functions import constants as C
from blockfield.functions.fixed import lit
from blockfield.operators.geometry import with_geometry

SEQ_CHUNK = 4096
FINDING = ["frame_id", "rule", "field", "expected", "actual"]


def _finding(rows: DataFrame, rule: str, field, expected: Column, actual: Column) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("missing"))
    return rows.select(
        "frame_id", F.lit(rule).alias("rule"), (F.lit(field) if isinstance(field, str) else field).alias("field"),
        text(expected).alias("expected"), text(actual).alias("actual"),
    )


def geometry_findings(manifests: DataFrame) -> DataFrame:
    """Declared tile grid against the declared size; sizes must be positive."""
    shaped = with_geometry(manifests.withColumnRenamed("x_tiles", "dx").withColumnRenamed("y_tiles", "dy"))
    out = None
    for declared, name in (("dx", "x_tiles"), ("dy", "y_tiles")):
        part = _finding(shaped.where(~F.col(declared).eqNullSafe(F.col(name))), "geometry", name, F.col(name), F.col(declared))
        out = part if out is None else out.unionByName(part)
    positive = shaped.where((F.col("xsize") <= 0) | (F.col("ysize") <= 0))
    return out.unionByName(_finding(positive, "geometry", "size", F.lit("positive"), F.concat_ws("x", "xsize", "ysize")))


def word_count_findings(manifests: DataFrame, words: DataFrame) -> DataFrame:
    """Declared word count against the captured words."""
    counted = words.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = manifests.join(counted, "frame_id", "left").withColumn("_n", F.coalesce("_n", lit(0)))
    return _finding(joined.where(F.col("word_count") != F.col("_n")), "word_count", "stream.word_count", F.col("word_count"), F.col("_n"))


def last_findings(flagged: DataFrame) -> DataFrame:
    """Rows of flag_last with an error."""
    return _finding(flagged.where(F.col("last_error").isNotNull()), "last", F.col("last_error"), F.col("is_final"), F.col("last"))


def register_findings(expected: DataFrame, log: DataFrame) -> DataFrame:
    """Register values that differ, are missing, or are unknown; both sides (frame_id, register, data)."""
    e = expected.select("frame_id", "register", F.col("data").alias("e"))
    a = log.select("frame_id", "register", F.col("data").alias("a"))
    both = e.join(a, ["frame_id", "register"], "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    rule = F.when(F.col("e").isNull(), F.lit("unknown_register")).when(F.col("a").isNull(), F.lit("missing_register")).otherwise(F.lit("register"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return both.select("frame_id", rule.alias("rule"), F.col("register").alias("field"), text("e").alias("expected"), text("a").alias("actual"))


def capability_findings(manifests: DataFrame, observed: DataFrame) -> DataFrame:
    """Required capability bits that are absent, and maximum geometry below the required minimum."""
    both = manifests.join(observed, "frame_id")
    lacking = F.col("required_capabilities").bitwiseAND(F.bitwise_not(F.col("capabilities")))
    width, height = F.col("max_geometry").bitwiseAND(lit(0xFFFF)), F.shiftright("max_geometry", 16).bitwiseAND(lit(0xFFFF))
    small = both.where((width < F.col("xsize")) | (height < F.col("ysize")))
    return _finding(both.where(lacking != 0), "capability", "capabilities", F.col("required_capabilities"), F.col("capabilities")).unionByName(
        _finding(small, "capability", "max_geometry", F.concat_ws("x", "xsize", "ysize"), F.concat_ws("x", width, height))
    )


def discovery_findings(expected: DataFrame, observed: DataFrame, fields=("identity", "abi_version", "build_id", "active_route")) -> DataFrame:
    """Discovery fields (frame_id, field, data) that differ, are missing, or are not known; only ``fields`` are known."""
    e = expected.where(F.col("field").isin(*fields)).select("frame_id", "field", F.col("data").alias("e"))
    a = observed.select("frame_id", "field", F.col("data").alias("a"))
    both = e.join(a, ["frame_id", "field"], "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    rule = F.when(~F.col("field").isin(*fields), F.lit("unknown_field")).when(F.col("a").isNull(), F.lit("missing_field")).otherwise(F.lit("discovery"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    return both.select("frame_id", rule.alias("rule"), "field", text("e").alias("expected"), text("a").alias("actual"))


def format_findings(manifests: DataFrame, kind: str, versions=("v1",)) -> DataFrame:
    """Manifests (frame_id, format) of another kind, and known kinds in an unknown version; format reads kind.version."""
    version = F.substring_index("format", ".", -1)
    named = F.regexp_replace("format", "\\.[^.]*$", "")
    other = ~F.coalesce(named == kind, F.lit(False))
    bad = manifests.where(other | ~version.isin(*versions))
    return _finding(bad, "format", F.when(other, F.lit("kind")).otherwise(F.lit("version")), F.when(other, F.lit(kind)).otherwise(F.lit(",".join(versions))), F.col("format"))


def agreement_findings(index: DataFrame, manifests: DataFrame, fields=("xsize", "ysize", "distance_q8", "active_route")) -> DataFrame:
    """Fields in which a bundle's index and its manifest disagree, and frames that only one of them names."""
    columns = lambda df, side: df.select("frame_id", F.struct(*fields).alias(side))
    both = columns(index, "i").join(columns(manifests, "m"), "frame_id", "full_outer")
    alone = both.where(F.col("i").isNull() | F.col("m").isNull())
    side = lambda c: F.when(F.col(c).isNotNull(), F.lit("present"))
    out = _finding(alone, "agreement", "frame", side("i"), side("m"))
    known = both.where(F.col("i").isNotNull() & F.col("m").isNotNull())
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"i.{f}").cast("string").alias("e"), F.col(f"m.{f}").cast("string").alias("a")) for f in fields])
    each = known.select("frame_id", F.inline(F.filter(pairs, lambda p: ~p["e"].eqNullSafe(p["a"]))))
    return out.unionByName(_finding(each, "agreement", F.col("field"), F.col("e"), F.col("a")))


def ownership_findings(owners: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, rule, detail) over owners (frame_id, seq, block, raw_strategy, last), each frame's in order of seq.

    An owner must start at the first uncovered cell, stay inside, overlap nothing, and last must come exactly with full
    coverage.  For owners that cover every cell once that is the same as: blocks ascend with seq, and last is on the final
    owner alone.  So every part of the rule is a grouping or a neighbour look-up: ``bounds`` (owner's block), ``overlap``
    (cell), ``gap`` (number of uncovered cells), ``order`` (block), ``early_last`` and ``missing_last`` (block).
    """
    from blockfield.operators.geometry import covered_cells

    shape = with_geometry(frames).select("frame_id", "x_blocks", "y_blocks", "block_count")
    rows = owners.join(shape, "frame_id")
    wide, high = F.when(F.col("raw_strategy") == C.DCT8X16, 2).otherwise(1), F.when(F.col("raw_strategy") == C.DCT16X8, 2).otherwise(1)
    bx, by = F.col("block") % F.col("x_blocks"), F.floor(F.col("block") / F.col("x_blocks"))
    inside = (F.col("block") >= 0) & (bx + wide <= F.col("x_blocks")) & (by + high <= F.col("y_blocks"))
    found = lambda df, rule, detail: df.select("frame_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    cells = covered_cells(rows.where(inside)).groupBy("frame_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = shape.join(cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), "frame_id", "left")
    short = F.col("block_count") - F.coalesce("n", lit(0))
    by_seq = Window.partitionBy("frame_id", "_c").orderBy("seq")
    chunked = rows.withColumn("_c", F.floor(F.col("seq") / SEQ_CHUNK)).withColumn("_before", F.lag("block").over(by_seq))
    ends = chunked.groupBy("frame_id", "_c").agg(F.min_by("block", "seq").alias("_first"), F.max_by("block", "seq").alias("_last"))
    across = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("frame_id").orderBy("_c")))
    final = rows.groupBy("frame_id").agg(F.max("seq").alias("_final"))
    marked = rows.join(final, "frame_id")
    at_end = F.col("seq") == F.col("_final")
    parts = [
        found(rows.where(~inside), "bounds", F.col("block")), found(cells.where("n > 1"), "overlap", F.col("cell")), found(counts.where(short > 0), "gap", short),
        found(chunked.where(F.col("block") <= F.col("_before")), "order", F.col("block")), found(across.where(F.col("_first") <= F.col("_before")), "order", F.col("_first")),
        found(marked.where(F.col("last") & ~at_end), "early_last", F.col("block")), found(marked.where(~F.col("last") & at_end), "missing_last", F.col("block")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def checksum(content: DataFrame) -> DataFrame:
    """(frame_id, artifact, sha256) from (frame_id, artifact, content)."""
    return content.select("frame_id", "artifact", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def checksum_findings(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts named on one side only, and digests that differ; digests compare without case."""
    d = declared.select("frame_id", "artifact", F.lower("sha256").alias("e"))
    a = actual.select("frame_id", "artifact", F.lower("sha256").alias("a"))
    both = d.join(a, ["frame_id", "artifact"], "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    rule = F.when(F.col("e").isNull() | F.col("a").isNull(), F.lit("artifact_set")).otherwise(F.lit("checksum"))
    text = lambda c: F.coalesce(F.col(c), F.lit("missing"))
    return both.select("frame_id", rule.alias("rule"), F.col("artifact").alias("field"), text("e").alias("expected"), text("a").alias("actual"))


def unknown_fields(fields: DataFrame, known: DataFrame) -> DataFrame:
    """(frame_id, field) entries whose field is not in the known list."""
    return fields.join(known, "field", "left_anti")


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity: side 'expected' or 'actual'."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(
        actual.exceptAll(expected).withColumn("side", F.lit("actual"))
    )


def audit_bundles(manifests: DataFrame, words: DataFrame, registers: DataFrame, log: DataFrame, observed: DataFrame,
                  declared: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All rules over a corpus of bundles; an empty result is a clean corpus."""
    from blockfield.operators.trace import flag_last

    parts = [
        geometry_findings(manifests), word_count_findings(manifests, words), last_findings(flag_last(words)),
        register_findings(registers, log), capability_findings(manifests, observed), checksum_findings(declared, checksum(artifacts)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Bytes of a file that are digested at a time.
DIGEST_CHUNK = 1 << 22


def file_checksums(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below the path, digested chunk by chunk: no content becomes a row, so a file may
    have any length.  A file is one task's, as the digest is of one sequence of bytes; empty files have a digest, hidden ones none."""
    from pyarrow import fs

    from blockfield.sources.binary import file_system

    found, root = file_system(path)
    infos = found.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(i.path,) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]

    def digest(batches):
        import hashlib

        import pyarrow as pa

        store, _ = file_system(path)
        for batch in batches:
            sizes, sums = [], []
            for name in batch.column("path").to_pylist():
                state, size = hashlib.sha256(), 0
                with store.open_input_stream(name) as handle:
                    while data := handle.read(DIGEST_CHUNK):
                        state.update(data)
                        size += len(data)
                sizes.append(size)
                sums.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["file", "bytes", "sha256"])

    files = spark.createDataFrame(names, "path string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)))
    return files.mapInArrow(digest, "file string, bytes bigint, sha256 string")
