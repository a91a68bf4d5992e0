"""Quality of text artifacts: base counts and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Unigrams and bigrams of words fall into ``BUCKETS`` hash buckets.  Two multinomials are counted over whole corpora: the
trusted artifacts and all artifacts, the latter scaled to the total of the former; both are smoothed with ``PSEUDO`` counts
a bucket, so an n-gram that is rare in both says little.  An artifact's score is the mean over its n-grams of the log ratio
of the two; it is kept if the score reaches a fixed threshold, so every artifact gets the same verdict in every run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockfield.llm.shared import staged, trimmed

BUCKETS = 1 << 16
THRESHOLD = -0.1
PSEUDO = 5.0
#: Trusted artifacts that are counted at most.
SAMPLE = 20_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _words(content: str) -> Column:
    bare = trimmed(content)
    return F.when(bare == "", F.lit([]).cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _length_of(text: Column, dropped: str) -> Column:
    return F.length(text) - F.length(F.translate(text, dropped, ""))


def _duplicate_lines(content: str) -> Column:
    lines = F.filter(F.split(F.coalesce(F.col(content), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def _windows(hashes: str, n: int) -> Column:
    """Hashes of the runs of n words, from the hashes of the words."""
    at = lambda i, k: F.get(hashes, i + k)
    count = F.size(hashes) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[at(i, k) for k in range(n)]))).otherwise(F.lit([]).cast("array<bigint>"))


def _repeated_words(windows: str, n: int) -> Column:
    """Words under windows that occur twice or more: the windows are sorted with their places only if some occur again."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(F.get(a, b)["h"], F.lit(None).cast("bigint"))

    def covered(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda x, k: (x["h"] == same(sorted_, k - 1)) | (x["h"] == same(sorted_, k + 1)))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last"))
        return F.aggregate(places, start, lambda s, i: F.struct((s["sum"] + F.least(F.lit(n), i - s["last"])).alias("sum"), i.alias("last")), lambda s: s["sum"])

    # transform over a one-element array binds the sorted windows once
    found = F.element_at(F.transform(F.array(placed), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)


def _buckets(hashes: str, buckets: int) -> Column:
    pairs = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def _hashed(artifacts: DataFrame, content: str) -> DataFrame:
    return artifacts.withColumn("_words", _words(content)).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def bucket_ratios(artifacts: DataFrame, trusted: DataFrame, key: str = "frame_id", content: str = "content", buckets: int = BUCKETS,
                  pseudo: float = PSEUDO, sample: int = SAMPLE) -> DataFrame:
    """One row: ``ratios``, the log ratio of the trusted to the raw multinomial for each bucket.

    ``trusted(key)`` names the trusted artifacts; of more than ``sample`` the ones with the least hash are taken, so the table
    that every task gets is bounded.  The raw multinomial counts all artifacts.  Counts are added up inside each task
    before they meet; what meets is bounded by the number of buckets.
    """
    marks = trusted.select(F.col(key).alias("_t")).where(F.col(key).isNotNull()).distinct()
    marks = marks.orderBy(F.xxhash64("_t"), "_t").limit(sample)
    marked = artifacts.select(F.col(key).alias("_k"), F.col(content).alias("_text")).join(F.broadcast(marks), F.col("_k") == F.col("_t"), "left")
    grams = _hashed(marked, "_text").select(F.col("_t").isNotNull().alias("good"), F.explode(_buckets("_h", buckets)).alias("bucket"))
    seen = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    every = artifacts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("raw"), F.lit(0).cast("bigint").alias("target"))
    counts = seen.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("n"), F.sum("target").alias("t"))
    share = F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(F.lit(0.0))
    ratio = lambda x: F.log(x["target"] + pseudo) - F.log(x["raw"] * share + pseudo)
    return staged(packed.select(F.transform("c", ratio).alias("ratios")))


def quality(artifacts: DataFrame, ratios: DataFrame, content: str = "content", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``artifacts`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Words are runs of characters other than blanks.  ``base_failed``: fewer than ten words, or more than a fifth of them
    in repeated five-word windows.  ``score``: mean log ratio of the n-grams, 0 without words.  ``kept``: not base_failed and
    score >= threshold.  A null content counts as empty and fails; repeated rows each get the same verdict; input columns
    of these names are replaced; an empty table gives an empty one.
    """
    table = ratios.select("ratios").scalar()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    rows = _hashed(artifacts.drop(*[c for c in names if c in artifacts.columns]), content)
    text = F.coalesce(F.col(content), F.lit(""))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("bigint"), "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": _length_of(text, SYMBOLS).cast("bigint"), "n_dup_lines": _duplicate_lines(content).cast("bigint"),
        "_windows": _windows("_h", WINDOW), "_buckets": _buckets("_h", buckets), "_ratios": table,
    })
    sum_ = F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get("_ratios", b))
    rows = rows.withColumns({
        "n_repeat_words": _repeated_words("_windows", WINDOW).cast("bigint"),
        "score": F.when(F.size("_buckets") > 0, sum_ / F.size("_buckets")).otherwise(F.lit(0.0)),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return rows.select(*[c for c in artifacts.columns if c not in names], *names)
