"""Corpus pipeline over the documents table: quality rules, SimHash near-dedup, suffix-array dedup, mixing to target
weights, best-fit packing.

Every stage gets what its predecessor kept, as (doc_id, text, lang, source, n_chars), and all but the last return those
columns.  SQL cannot express fingerprints, hashed n-grams or the packing, so there is no reference SQL; tests compare the
stages with brute-force versions.
"""

from pyspark.sql import functions as F

from blockfield.llm import catalog, mixing, packing, quality, simhash, suffixes
from blockfield.llm.shared import staged, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A passage worth cutting has more than 50 words; 51 words of prose are hardly ever shorter than this many bytes.
PASSAGE_BYTES, PASSAGE_WORDS = 256, 51
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go; a null text has no words and is rejected, repeated rows are judged alike and null ids by their
    text, as untrusted. Corpus statistics are those of the documents given. The verdicts are written before they are
    used: as a filter, their long expressions would be copied into each other."""
    rows = docs.select(*COLUMNS)
    ratios = quality.bucket_ratios(rows, catalog.trusted(spark, sf_dir).withColumnRenamed("frame_id", "doc_id"), key="doc_id", content="text")
    judged = staged(quality.quality(rows, ratios, content="text").select(*COLUMNS, "kept"))
    return judged.where("kept").select(*COLUMNS)


def simhash_dedup(spark, docs, sf_dir):
    """One row of every component stays: that of the smallest id, of its rows the one with the smallest hash of its text and
    then of the other columns.  Components are those of rows, so repeated ids with different texts are judged each by itself,
    and a row with a null id stays unless a row with an id or an earlier row is its near copy."""
    return simhash.one_of_each_component(docs.select(*COLUMNS), key="doc_id", content="text")


def suffix_dedup(spark, docs, sf_dir):
    """Passages of more than 50 words that repeat are cut, all occurrences: byte strings of PASSAGE_BYTES that repeat, where
    together they hold PASSAGE_WORDS whole words, from the first of these to the last. n_chars follows. All rows stay."""
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), key="doc_id", content="text", length=PASSAGE_BYTES, words=PASSAGE_WORDS, carry=("lang", "source", "n_chars"), chars=True)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark, docs, sf_dir):
    """Every document as often as the mix takes it, as whole rows: the one document a source whose fractional repetition is
    only partly taken counts from one half on. Rows are told apart by id and a hash of their columns; rows that are equal in
    all columns are each taken as often as the one taken most."""
    return mixing.repeated_rows(docs.select(*COLUMNS), key="doc_id", content="text", group="source")


def best_fit(spark, docs, sf_dir):
    """Places of the documents' words in sequences: one row per piece. Every row is packed, also repeated ones, those with a
    null id and those the suffix stage left without words."""
    streams = docs.select(F.col("doc_id").alias("frame_id"), word_count("text").alias("token_count"))
    return packing.pack_streams(staged(streams)).withColumnRenamed("frame_id", "doc_id")


STAGES = [
    ("quality rules", quality_rules), ("simhash near-dedup", simhash_dedup), ("suffix-array dedup", suffix_dedup),
    ("mix to weights", mix_sources), ("best-fit packing", best_fit),
]


def run(spark, sf_dir):
    """Apply the stages to the documents table, each written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
