"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import (
    arc,
    backoff,
    bitplanes,
    bpe,
    hot,
    html_extract,
    itq,
    jaccard,
    langid,
    ordinal,
    packing,
    pii,
    queries_sql,
    rules,
    rules_sql,
    strassen,
    warc,
)
from tidebar.llm.registry import query
from tidebar.session import durable, scratch_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.withColumn("ids", bpe.encode("text", BYTE_BPE))
    back = coded.withColumn("data", bpe.decode("ids", BYTE_BPE))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, window=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"),
                        langid.predict(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 2 is good, 1 good but toxic, 0 poor; null where a label is missing."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).when(
        F.col("toxic") < 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@query(rules_sql.oracle())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rules.judged(docs)
    return found.select(
        "doc_id",
        *[F.col(f"{rules.M}.{name}").alias(name) for name in rules.MEASURES],
        F.col(f"{rules.M}_verdict.base_failed").alias("base_failed"),
        F.col(f"{rules.M}_verdict.kept").alias("kept"),
    )


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", html_extract.extract("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on labels outside the fold that is held out for measuring (crc32 mod 4 = 2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = grades(table(spark, sf_dir, "labels")).filter(fold != 2)
    model = ordinal.fit(docs, known, levels=3)
    found = docs.withColumn("score", ordinal.score(docs, model, levels=3))
    return found.select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        F.round("score.expected", 9).alias("expected_grade"),
        F.round("score.top", 9).alias("top_probability"),
        F.coalesce(F.col("score.top") >= ordinal.LEAST, F.lit(True)).alias("selected"),
    )


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


@query()
def op2_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings"))
    same = F.col("vec_id") == F.col("component_id")
    return found.withColumn("kept", F.coalesce(same, F.lit(True)))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w3 FROM docs),
seq AS (SELECT r, i, w3, lag(w3) OVER p AS w2, lag(w3, 2) OVER p AS w1 FROM pos
        WINDOW p AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w3, count(*) AS n FROM seq GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS n FROM seq WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM seq WHERE w1 IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT seq.r, CASE WHEN c3.n >= 2 THEN ln(c3.n / ctx2.n)
    WHEN c2.n >= 2 THEN ln(c2.n / ctx1.n) + ln(0.4)
    ELSE ln(c1.n / (SELECT count(*) FROM seq)) + 2 * ln(0.4) END AS s
  FROM seq JOIN c1 USING (w3)
  LEFT JOIN c2 ON c2.w2 = seq.w2 AND c2.w3 = seq.w3
  LEFT JOIN c3 ON c3.w1 = seq.w1 AND c3.w2 = seq.w2 AND c3.w3 = seq.w3
  LEFT JOIN c2 ctx2 ON ctx2.w2 = seq.w1 AND ctx2.w3 = seq.w2
  LEFT JOIN c1 ctx1 ON ctx1.w3 = seq.w2)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  round(coalesce(sum(s), 0) + 1.234e-8, 5) AS log_score, round(sum(s) / nullif(len(w), 0) + 1.234e-8, 6) AS mean_log_score
FROM docs LEFT JOIN scored USING (r) GROUP BY r, doc_id, w
""")
def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.score(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words",
        F.round(F.col("log_score") + 1.234e-8, 5).alias("log_score"),
        F.round(F.col("mean_log_score") + 1.234e-8, 6).alias("mean_log_score"))


#: Key of the surrogates; whoever runs this in earnest passes a secret of their own.
PII_KEY = "surrogate-key"


@query()
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replaced(docs, PII_KEY, count="n_replaced")


#: HTTP header that carries a page's id through both formats.
PAGE_HEADER = "X-Page-Id"


def page_id() -> Column:
    """The page's id in the head of a record."""
    pattern = rf"\r\n{PAGE_HEADER}: (-?[0-9]+)\r\n"
    return F.regexp_extract(F.col("head").cast("string"), pattern, 1).try_cast("long")


def messages(pages: DataFrame) -> DataFrame:
    """Pages as HTTP messages for ``arc.write``; the html (null: empty) is the payload."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat_ws(
        "\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=UTF-8"),
        F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("string")),
        F.concat(F.lit("Content-Length: "), F.length(html).cast("string")), F.lit("\r\n"))
    return pages.select(
        F.col("url").cast("string").alias("uri"), F.lit("0.0.0.0").alias("ip"), F.lit("20000101000000").alias("stamp"),
        F.lit("text/html").alias("mime"), F.concat(head.cast("binary"), html).alias("document"))


@query(queries_sql.archived())
def op11_arc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files of both versions, these to WARC files, and those read back.

    Null pages come last among equal payloads; of several rows with the least page_id one is
    the response.
    """
    legacy, target = scratch_folder(spark, "arc"), scratch_folder(spark, "warc")
    arc.write(messages(table(spark, sf_dir, "pages").select("page_id", "url", "html")), legacy)
    warc.from_arc(spark, legacy, target, first_by=[page_id()])
    back = warc.read(spark, target, payload=False).filter(F.col("type").isin("response", "revisit"))
    back = durable(back.select(
        page_id().alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "record_id", "refers_to"))
    revisits = back.filter("record_type = 'revisit'").drop("record_id")
    sizes = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    firsts = back.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id")).join(sizes, "refers_to")
    found = hot.lookup(revisits, durable(firsts), "refers_to", revisits.count()).drop("refers_to")
    found = found.withColumnRenamed("first_id", "refers_to")
    responses = back.filter("record_type = 'response'").drop("record_id", "refers_to")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


@query(queries_sql.hard_negatives())
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"))


@query(queries_sql.clusters())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(table(spark, sf_dir, "embeddings"))
