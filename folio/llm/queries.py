"""The queries of this subpackage: ``opN_<name>`` each over its whole table, and the pipeline.

``QUERIES`` and ``ORACLES`` are what the driver's entry adds to its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import byte_cnn, mixing, sharding
from folio.llm import decontamination as deco
from folio.llm.alignment import alignments
from folio.llm.language_id import page_languages
from folio.llm.lexical_search import ranked_documents
from folio.llm.licenses import license_matches
from folio.llm.ngram_join import ngram_components
from folio.llm.pii import pii_spans
from folio.llm.quality_rules import quality_votes
from folio.llm.runtime import table
from folio.llm.substring_dedup import without_repeats
from folio.llm.url_filters import ENTRY_SCHEMA, judged
from folio.llm.vocabularies import Shared


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by links of Jaccard similarity 0.75 over five-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id."""
    return sharding.with_shard(table(spark, sf_dir, "documents"), F.col("doc_id")).select("doc_id", "slot", "shard")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it is kept by its posterior."""
    votes = quality_votes(table(spark, sf_dir, "documents"))
    return votes.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return pii_spans(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by text, markup, address and host."""
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every document that holds a licence notice."""
    return license_matches(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a network learned from labels outside fold 1."""
    return byte_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


#: The dated lists of the URL filter: (list, effect, pattern, action, day).
LIST_LOG = (
    ("gambling", "block", "casino-win.example.com", "add", "2023-11-01"),
    ("gambling", "block", "free-bets.example.com", "add", "2024-03-15"),
    ("gambling", "block", "free-bets.example.com", "remove", "2024-09-01"),
    ("adult", "block", "adult-x.example.net", "add", "2024-02-01"),
    ("adult", "block", "adult-x.example.net", "remove", "2024-05-01"),
    ("adult", "block", "adult-x.example.net", "add", "2024-06-15"),
    ("pharmacy", "block", "cheap-pills.example.com", "add", "2024-01-20"),
    ("spam", "block", "spam-farm.example.com", "add", "2023-01-01"),
    ("spam", "block", "ads-track.example.com", "add", "2024-04-01"),
    ("reviewed", "allow", "www.spam-farm.example.com/en/", "add", "2024-07-01"),
    ("reviewed", "allow", "m.ads-track.example.com/de/", "add", "2024-04-01"),
    ("reviewed", "allow", "m.ads-track.example.com/de/", "remove", "2024-10-01"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the lists that held when it was fetched.

    The table has no fetch time; a page's is the hour page_id * 7 of the leap
    year 2024, taken round.
    """
    hour = F.pmod(F.col("page_id") * 7, F.lit(8784))
    fetched = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), hour.cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', timestamp'{e} 00:00:00')" for a, b, c, d, e in LIST_LOG)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(x.split()[0] for x in ENTRY_SCHEMA.split(', '))})")
    return judged(pages, entries).select("page_id", "url", "fetched_at", "host", "matched_list", "matched_pattern", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that share a passage."""
    return deco.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words that stand in an earlier one."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Groups and links of every document's tokens by two vocabularies."""
    return alignments(table(spark, sf_dir, "documents"), Shared(spark, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_sharding, op3_quality_rules, op4_pii, op5_language_id, op6_source_mix, op7_url_filter, op8_quality_classifier,
        op9_license_scan, op10_decontamination, op11_substring_dedup, op12_token_alignment, op13_lexical_search,
    )
}
