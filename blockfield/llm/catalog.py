"""Queries of the corpus operators: thin steps from the given tables to the operators' records and back."""

from pyspark.sql import functions as F

from blockfield.llm import counting, extraction, leaks, merkle, mixing, packing, passages, periods, quality, simhash, suffixes, token_files, topk
from blockfield.llm.shared import staged, trimmed, word_count

QUERIES, ORACLES = {}, {}
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def documents(spark, sf_dir):
    """The documents table as artifacts: frame_id, content."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("content"), "source")


@register("op1_mix_to_weights", """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('42:' || doc_id) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, 3 * n AS cap, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
l AS (SELECT *, first_value(CASE WHEN rest * w < cap * ws THEN rest END IGNORE NULLS) OVER o AS lr, first_value(CASE WHEN rest * w < cap * ws THEN ws END IGNORE NULLS) OVER o AS lw
  FROM f WINDOW o AS (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, n, CASE WHEN lr IS NULL THEN CAST(cap AS DOUBLE) ELSE CAST(lr * w AS DOUBLE) / CAST(lw AS DOUBLE) END AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.n, t.target, CAST(round(t.target) AS HUGEINT) AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST(CASE WHEN n > 0 THEN whole // n * size + greatest(0, least(size, whole - whole // n * n - before)) ELSE 0 END AS BIGINT) AS taken FROM x""")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    streams = staged(docs.select("frame_id", F.col("source").alias("stage"), word_count("content").alias("token_count")))
    mixed = mixing.mix_streams(streams, mixing.cycled_weights(streams))
    return mixed.select(F.col("frame_id").alias("doc_id"), F.col("token_count").alias("size"), F.col("stage_tokens").alias("source_size"), "target", "taken")


@register("op4_simhash_components")
def op4(spark, sf_dir):
    return simhash.near_duplicate_artifacts(documents(spark, sf_dir)).withColumnRenamed("frame_id", "doc_id")


@register("op8_suffix_repeats")
def op8(spark, sf_dir):
    kept = suffixes.remove_repeats(documents(spark, sf_dir))
    return kept.select(F.col("frame_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def trusted(spark, sf_dir):
    """Keys of the documents labelled good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("frame_id"))


@register("op9_quality_rules")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir).select("frame_id", "content")
    judged = quality.quality(docs, quality.bucket_ratios(docs, trusted(spark, sf_dir)))
    return judged.drop("content").withColumnRenamed("frame_id", "doc_id")


@register("op10_best_fit_packing")
def op10(spark, sf_dir):
    streams = staged(documents(spark, sf_dir).select("frame_id", word_count("content").alias("token_count")))
    return packing.pack_streams(streams).withColumnRenamed("frame_id", "doc_id")


@register("op5_token_counts")
def op5(spark, sf_dir):
    return counting.count_tokens(documents(spark, sf_dir), vocabulary()).withColumnRenamed("frame_id", "doc_id")


@register("op7_token_files")
def op7(spark, sf_dir):
    manifest = token_files.write_token_files(documents(spark, sf_dir), vocabulary())
    return token_files.read_artifact_ids(manifest).withColumnRenamed("frame_id", "doc_id")


@register("op6_exact_top_k", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op6(spark, sf_dir):
    x = lambda e: e.cast("double")
    whole = lambda e: F.when(F.isnan(x(e)) | (F.abs(x(e)) == float("inf")), None).otherwise(F.floor(256 * x(e)))
    blocks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("block"), F.transform("embedding", whole).alias("coefficients"))
    return topk.nearest_blocks(blocks.where("block % 50 = 0"), blocks).withColumnRenamed("block", "vec_id")


@register("op3_main_text")
def op3(spark, sf_dir):
    return extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register("op2_near_duplicate_passages")
def op2(spark, sf_dir):
    return passages.near_duplicate_passages(documents(spark, sf_dir)).withColumnRenamed("frame_id", "doc_id")


@register("op11_periodic_runs")
def op11(spark, sf_dir):
    """Documents whose checksum ends in 0 get a planted period; then the operator's runs and kept words as digests."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), word_count("text").alias("n"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    own = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    split = rows.where(own).withColumn("words", F.split(trimmed("text"), "[\\x20\\x09-\\x0D]+"))
    block = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    plants = split.select(F.col("doc_id").alias("frame_id"), planted.alias("content"))
    others = rows.where(~F.coalesce(own, F.lit(False))).select(F.col("doc_id").alias("frame_id"), F.col("text").alias("content"))
    runs = F.col("runs")
    longest = F.element_at(F.array_sort(runs, lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 1)
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = periods.periodic_runs(plants.union(others)).select("frame_id", "kept", lines.alias("lines"), F.size("runs").cast("bigint").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("top"))
    return found.select(
        F.col("frame_id").alias("doc_id"), "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def lowered(text: str):
    """The text with A-Z lower-cased and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@register("op12_merkle_manifest", """
WITH RECURSIVE f AS (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
    list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295)) AS h FROM documents),
d AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN h % 3 = 0 THEN sha256(head || CASE WHEN low IS NULL THEN '-' ELSE strlen(low) || ':' || low END) END AS tampered,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM f),
t(l, lang, p, n, d) AS (SELECT 0, lang, p, n, leaf FROM d
  UNION ALL SELECT l + 1, lang, p // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY l, lang, p // 8, n),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
r(l, p, n, d) AS (SELECT 0, p, n, subroot FROM s UNION ALL SELECT l + 1, p // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY p)) FROM r WHERE n > 1 GROUP BY l, p // 8, n),
a(l, doc_id, lang, p, acc, proof) AS (SELECT 0, doc_id, lang, p, coalesce(tampered, leaf), '' FROM d
  UNION ALL SELECT a.l + 1, a.doc_id, a.lang, a.p // 8, sha256(string_agg(CASE WHEN t.p = a.p THEN a.acc ELSE t.d END, '' ORDER BY t.p)),
    a.proof || coalesce(string_agg(t.d, '' ORDER BY t.p) FILTER (WHERE t.p <> a.p), '')
  FROM a JOIN t ON t.l = a.l AND t.lang IS NOT DISTINCT FROM a.lang AND t.p // 8 = a.p // 8 WHERE t.n > 1 GROUP BY a.l, a.doc_id, a.lang, a.p, a.acc, a.proof),
b(l, doc_id, p, acc, proof) AS (SELECT 0, a.doc_id, s.p, a.acc, a.proof FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) = 1) a
    JOIN s ON s.lang IS NOT DISTINCT FROM a.lang
  UNION ALL SELECT b.l + 1, b.doc_id, b.p // 8, sha256(string_agg(CASE WHEN r.p = b.p THEN b.acc ELSE r.d END, '' ORDER BY r.p)),
    b.proof || coalesce(string_agg(r.d, '' ORDER BY r.p) FILTER (WHERE r.p <> b.p), '')
  FROM b JOIN r ON r.l = b.l AND r.p // 8 = b.p // 8 WHERE r.n > 1 GROUP BY b.l, b.doc_id, b.p, b.acc, b.proof)
SELECT d.doc_id, d.leaf, s.subroot, r.d AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.d AS verified
FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) = 1) e USING (doc_id), (SELECT d FROM r WHERE n = 1) r""")
def op12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records = docs.select(F.col("doc_id").alias("frame_id"), F.col("lang").alias("artifact"), "source", "n_chars", F.col("text").alias("content"))
    seen = F.when(F.crc32(F.col("frame_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_digest("frame_id", "source", "artifact", "n_chars", lowered("content")))
    manifest = merkle.merkle_manifest(records.withColumn("seen", seen), ("frame_id", "source", "artifact", "n_chars", "content"), carry=("seen",))
    folded = manifest.select(F.col("frame_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"),
                             merkle.folded_root("path", F.coalesce("seen", "leaf")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@register("op13_fixture_leaks", """
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, m, array_to_string(w[p + 1 : p + m], ' ') AS x FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, p, m, array_to_string(w[p + 1 : p + m], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
h AS (SELECT o.doc_id, o.p, o.m, i.item_id FROM o JOIN i USING (m, x)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS at FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)""")
def op13(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("frame_id"), F.col("text").alias("content"))
    leaked = leaks.fixture_leaks(documents(spark, sf_dir), items)
    return leaked.select(
        F.col("frame_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
