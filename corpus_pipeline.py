"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

Every stage takes null ids, null, empty and very long texts, rows that repeat and empty tables, and
passes other columns through whatever their names; what it does with each case stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe_automaton import encode_documents
from sparkloom.llm.decontaminate import clean_documents
from sparkloom.llm.language_bloom import UND, identify
from sparkloom.llm.language_bloom import fit as fit_languages
from sparkloom.llm.minmax_dedup import keep_one
from sparkloom.llm.suffix_dedup import remove_repeats

#: Documents whose best language holds less than this share of their n-grams are rejected.
LEAST_SCORE = 0.3
#: Texts of fewer bytes have too few n-grams for a share and stay if they have a letter.
LEAST_BYTES = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; null, empty, letterless and foreign texts go.  Rows are judged one by
    one, so rows that repeat stay or go together; texts of any length are judged whole."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.octet_length("text").alias("bytes"), "text")
    found = identify(packed, fit_languages(docs), keep_text=False)
    known = (F.col("lang_pred") != UND) & ((F.col("score") >= LEAST_SCORE) | (F.col("bytes") < LEAST_BYTES))
    return found.where(known).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates, and one of rows that
    repeat; a null doc_id comes last.  Texts without words (null, empty, blank) are near nothing and stay."""
    return keep_one(docs, words=5, percent=80)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings, and n_chars of what is left; documents with
    nothing left go, such as rows that repeat a long text.  Null and short texts stay as they are."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"))
    rest = remove_repeats(packed, whole_characters=True).where("text is null or n_removed = 0 or length(trim(text)) > 0")
    cut = {"text": F.col("text")}
    if "n_chars" in names:
        cut["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rest.select(*[cut.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, and rows that repeat
    stay or go together."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with the token ids, their number, and the digests of ids and
    decoded text; columns named like these are replaced.  Null and empty texts have no tokens."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False, keep_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("exact_dedup", exact_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]
#: No SQL can express the filters, the sketches and the automaton; a brute-force run stands in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    from sparkloom.llm.store import materialize, release

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
