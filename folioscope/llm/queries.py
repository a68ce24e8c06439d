"""One thin query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, exact, language, media, min_max, ngram_join, packing, piece_codec, privacy, repeats, toxicity, url_filter
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ("ids", "decoded", "spans_sha256"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "spans_sha256",
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.own_list(spark))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"), keep_media=False)


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in privacy.KINDS]
    return found.select("doc_id", *counts, F.sha2(privacy.spans_text("base"), 256).alias("base_sha256"), privacy.spans_text("base", "terms").alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = language.build(language.samples(docs.where(~F.col("held_out"))))
    found = language.identify(docs, model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op11_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = min_max.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_piece_codec,
        op2_ngram_join,
        op3_packing,
        op4_toxicity,
        op5_exact_dedup,
        op6_url_filter,
        op7_media_columns,
        op8_privacy,
        op9_language,
        op10_repeats,
        op11_min_max,
        op12_collocations,
        op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op6_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), r AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
            END AS rule FROM u
        ), listed AS (
            SELECT name || '.' || under AS key
            FROM (SELECT unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS name),
                 (SELECT unnest(['example.com', 'example.net', 'example.org']) AS under)
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN EXISTS (SELECT 1 FROM listed WHERE r.host = listed.key OR ends_with(r.host, '.' || listed.key)) THEN 'block'
            ELSE 'allow' END AS verdict
        FROM r
    """,
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
        ), f AS MATERIALIZED (
            SELECT lang, k, phrase, count(*) AS f FROM (
                SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
                UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
                UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
            ) GROUP BY ALL
        ), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, phrase, f AS a, k AS words, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
        ), parts AS MATERIALIZED (
            SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS front, array_to_string(ws[cut + 1:], ' ') AS rest FROM c
        ), s AS MATERIALIZED (
            SELECT parts.lang, parts.phrase, a, cut, x.f AS l, y.f AS r,
                   ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = front JOIN f y ON y.lang = parts.lang AND y.phrase = rest
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), longer AS (
            SELECT lang, inner_phrase, max(f) AS most FROM (
                SELECT lang, f, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS inner_phrase
                FROM f WHERE k = 3 AND f >= 10
            ) GROUP BY ALL
        ), kept AS (
            SELECT b.* FROM b LEFT JOIN longer o ON o.lang = b.lang AND o.inner_phrase = b.phrase
            WHERE o.most IS NULL OR 100 * o.most < 50 * a
        )
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang)
        QUALIFY rank <= 2000
    """,
}
