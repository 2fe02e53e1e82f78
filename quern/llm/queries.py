"""The operators' queries over whole tables, with production parameters; SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, huffman, line_dedup, packing, quality_model, quality_rules, simhash, tiff, url_filter, warc
from quern.llm.common import batch, map_arrow


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continues_before", "continues_after")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"), min_bytes=0)
    number = lambda c: F.expr(f"cast(substring({c}, {len('urn:page:') + 1}) as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal, decode = [str(i) for i in range(1 << 16)], bpe.decoder(path).decode
        for b in batches:
            sums, texts = [], []
            for ids in b.column(2):
                numbers = np.frombuffer(ids.as_buffer(), dtype="<u4").tolist()
                sums.append(hashlib.sha256(",".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                texts.append(hashlib.sha256(decode(numbers)).hexdigest())
            yield batch({"doc_id": b.column(0), "n_tokens": b.column(1), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return map_arrow(encoded, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = huffman.write_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup(docs, min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


URL_RULES = [
    url_filter.Rule.of("com/en/", "block"),
    url_filter.Rule.of("example.com/en/7", "allow"),
    url_filter.Rule.of("net/de/", "allow"),
    url_filter.Rule.of("example.net/de/8", "block"),
    url_filter.Rule.of("org/es/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    urls, labels = url_filter.labelled_by_rules(pages, URL_RULES)
    return url_filter.judge(pages, URL_RULES, url_filter.train(urls, labels, url_filter.suffix_shares(pages)))


QUALITY_THRESHOLD = 0.3


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_machine(docs: DataFrame, labels: DataFrame) -> quality_model.Machine:
    """Learnt from labels outside the held-out fifth only."""
    return quality_model.train(docs, labels.filter(~held_out()))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_model.score(docs, quality_machine(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality_rules.MEASURES, "kept", "posterior")


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.encode_texts(table(spark, sf_dir, "documents")).withColumn("media_sha256", F.sha2("media", 256))
    pages = tiff.pages(media, carry=["n_bytes", "media_sha256"])
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_warc, op3_byte_bpe, op4_simhash, op5_huffman_ids, op6_line_dedup, op7_url_filter, op8_quality_fm, op9_quality_rules, op10_tiff, pipeline)
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE: dict[str, str] = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + CAST(((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, url AS target_uri
        FROM d""",
    "op6_line_dedup": f"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
        k AS (SELECT doc_id, i, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
}
