"""The corpus operators over their whole tables: one query each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe_automaton import encode_documents
from sparkloom.llm.compression_quality import quality
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.language_bloom import fit as fit_languages
from sparkloom.llm.language_bloom import identify
from sparkloom.llm.license_scan import scan_licenses
from sparkloom.llm.lm_difference import score
from sparkloom.llm.minmax_dedup import near_duplicates
from sparkloom.llm.suffix_dedup import remove_repeats
from sparkloom.llm.url_trees import UrlModel, judge, labelled_sample
from sparkloom.llm.warc_salvage import round_trip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer files than there are cores, and few splits, are dealt over all cores first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in ("documents", "pages") and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < 2 * cores
    return df.repartition(cores) if few else df


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False)


@_query
def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_uid")


@_query
def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@_query
def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), fit_languages(docs), keep_text=False)


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@_query
def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(table(spark, sf_dir, "pages"))
    return records.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, UrlModel(*labelled_sample(pages))).drop("url")


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return score(docs, good, keep_text=False)


#: DuckDB SQL of the queries that SQL expresses exactly.
ORACLES |= {
    "op1_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS s FROM d),
k AS MATERIALIZED (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS k FROM w),
r AS (SELECT doc_id, s FROM k JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r),
j AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
p AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM j GROUP BY 1, 2),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
g AS (SELECT q.doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY 1)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op3_minmax_near_dedup": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN component ON node = doc_id""",
    "op6_warc_salvage": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, i // 4 * 5 + 1, 5))::INTEGER >> (15 - i % 4 * 5)) & 31), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
