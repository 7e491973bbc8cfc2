"""Registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, exactdedup, htmltext, licenses, mixing, nbsvm, nearcopies, neighbours, periodic, pii, repair, transducer, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The list of unwanted sites: six families, each under three domains. It does not depend on the pages that are judged.
UNWANTED = tuple(
    f"{name}.example.{zone}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org")
)
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: Most tokens of a document that is not over the limit.
TOKEN_LIMIT = 1024


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_nearest")
def nearest(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query("op2_main_text")
def main_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op3_quality")
def quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return nbsvm.scores(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


@query("op4_license_scan")
def license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def _cdf_sql() -> str:
    targets = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in mixing.TARGETS.items())
    return f"""
        target(source, part) AS (VALUES {targets}, (NULL, {mixing.REST!r}::DOUBLE)),
        grouped AS (
            SELECT d.*, CASE WHEN source IN (SELECT source FROM target WHERE source IS NOT NULL) THEN source END AS g
            FROM documents d),
        counted AS (SELECT g, count(*) AS n FROM grouped GROUP BY g),
        weighed AS (
            SELECT c.g, c.n, t.part, sum(t.part) OVER () AS parts, sum(c.n) OVER () AS total
            FROM counted c JOIN target t ON t.source IS NOT DISTINCT FROM c.g),
        rate AS (SELECT g, 1.0::DOUBLE * total::DOUBLE * part / parts / n::DOUBLE AS mean FROM weighed),
        steps AS (
            SELECT g, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM rate
            UNION ALL
            SELECT g, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps
            WHERE k < mean + 60),
        drawn AS (
            SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
                / 4503599627370496.0 AS u
            FROM grouped),
        copied AS (
            SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
                (SELECT count(*) FROM steps s WHERE s.g IS NOT DISTINCT FROM d.g AND s.cdf <= d.u) AS n
            FROM drawn d)"""


@query(
    "op5_source_mix",
    f"""WITH RECURSIVE {_cdf_sql()}
        SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy FROM copied WHERE n > 0""",
)
def source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), with_copy=True)


@query(
    "op6_url_filter",
    f"""WITH parsed AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        named AS (
            SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\\.', ''), ':(80|443)?$', '') AS site FROM parsed),
        listed(entry) AS (VALUES {", ".join(f"('{site}')" for site in UNWANTED)}),
        found AS (
            SELECT *, EXISTS (
                SELECT 1 FROM listed WHERE site = entry OR site LIKE '%.' || entry OR site || regexp_replace(path, '/+$', '') = entry) AS hit
            FROM named),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM found)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN hit THEN 'block' ELSE 'allow' END AS verdict,
            hit AS listed
        FROM ruled""",
)
def url_filter(spark, sf_dir):
    listed = spark.createDataFrame([(site,) for site in UNWANTED], "canon string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed).withColumnRenamed("hit", "listed")


@query("op7_personal_data")
def personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, least = pii.train(docs)
    return pii.find(docs, model, least).drop("found")


@query("op8_near_copies")
def near_copies(spark, sf_dir):
    found = nearcopies.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")


@query("op9_byte_bpe")
def byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query(
    "op10_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def exact_dedup(spark, sf_dir):
    return exactdedup.copies(table(spark, sf_dir, "documents"))


def _damaged(conversations: DataFrame) -> DataFrame:
    """One row in five dropped, emptied, without ends of sentences, repeated or given to the user, by hash."""
    return (
        conversations.selectExpr(
            "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text",
            "crc32(cast(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')) as binary))"
            " % 20 as damage",
        )
        .filter("damage <> 0")
        .selectExpr(
            "conv_id", "turn", "if(damage = 4, 'user', role) as role",
            "case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end as text",
            "explode(if(damage = 3, array(0, 1), array(0))) as nth",
        )
        .drop("nth")
    )


@query("op11_conversation_repair")
def conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    parts = repair.repair(_damaged(conversations)).selectExpr(
        "*", "lag(struct(last_initial, last_turn)) over (partition by conv_id order by part) as before",
        "array_join(transform(edits, e -> e.edit), '') as audit",
        "array_join(transform(filter(edits, e -> e.edit <> 'D'), e -> concat(e.role, ':', e.text)), '\n') as said",
        "exists(edits, e -> e.edit <> 'D') as says",
    ).selectExpr(
        "*", "cast(before is not null and concat(before.last_initial, first_initial) not in ('su', 'ua', 'au') as int) as seam",
        "cast(coalesce(before.last_turn = first_turn, false) as int) as same_turn",
    )
    found = parts.groupBy("conv_id").agg(
        F.expr("coalesce(max(last_turn) - min(first_turn) + 1 - sum(turns - same_turn), 0) as gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
        F.expr("sum(illegal + seam) as illegal"), F.sum("cost").alias("cost"),
        F.expr("array_sort(collect_list(struct(part, audit, says, said))) as parts"),
    )
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    zero = {name: F.coalesce(name, F.lit(0).cast("long")) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, F.col("conv").eqNullSafe(F.col("conv_id")), "left").withColumns(zero).selectExpr(
        "conv as conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        "coalesce(array_join(transform(parts, p -> p.audit), ''), '') as audit",
        "sha2(coalesce(array_join(transform(filter(parts, p -> p.says), p -> p.said), '\n'), ''), 256) as repaired_sha256",
    )


@query("op12_token_counts")
def token_counts(spark, sf_dir):
    import public_tokenizers

    found = transducer.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.selectExpr("*", f"n_tokens > {TOKEN_LIMIT} as over_limit")


def _with_periods(docs: DataFrame) -> DataFrame:
    """Text of every tenth document by hash: from some word on, a stretch is repeated to the end."""
    words = "filter(split(coalesce(text, ''), '[ \\\\x09-\\\\x0D]+'), w -> w <> '')"
    return (
        docs.selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) as h")
        .selectExpr("*", "h div 10 as g", f"case when h % 10 = 0 then {words} end as w")
        .selectExpr("*", "cast(g % greatest(size(w), 1) as int) as a")
        .selectExpr("*", "cast(1 + (size(w) - a) div (3 + g % 8) as int) as p")
        .selectExpr(
            "doc_id",
            "coalesce(array_join(transform(w, (x, i) -> if(i >= a, w[a + (i - a) % p], x)), ' '), text) as text",
        )
    )


@query("op13_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periodic.describe(_with_periods(table(spark, sf_dir, "documents")))
    line = "concat(r.start, ',', r.length, ',', r.period, '\n')"
    return (
        found.selectExpr("*", "array_max(transform(runs, r -> struct(r.length, -r.start as s, -r.period as p))) as top")
        .selectExpr(
            "doc_id", "cast(size(runs) as long) as n_runs", "-top.s as start", "top.length as length", "-top.p as period",
            "1000 * top.length div -top.p as exponent_milli",
            f"sha2(array_join(transform(runs, r -> {line}), ''), 256) as runs_sha256",
            "sha2(collapsed, 256) as collapsed_sha256",
        )
    )
