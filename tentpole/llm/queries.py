"""Queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.llm import chat, collocations, decontaminate, hmm, html_extract, packing, periodic, pieces, quality, simhash, substring, toxicity, warc


def tokenizer_file() -> str:
    """The vocabulary file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    """The model file that the SentencePiece query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.FOUR_BITS)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.summary(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents"), piece_file()), piece_file())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def with_a_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one document in ten, the words from a place on repeat with a period; both follow from the id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of the runs; the best run is the first of those with the greatest length / period, compared as products."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=with_a_period)
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_decontamination": op9_decontamination,
    "op10_hmm_lm": op10_hmm_lm,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

#: Words of a text: runs of characters other than blank and \x09-\x0D.
WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT hex, min(page_id) AS low, count(*) AS n FROM p GROUP BY hex),
        b AS (SELECT p.*, low, n, unhex(p.hex)::BIT::VARCHAR AS bits FROM p JOIN f USING (hex))
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (list_aggregate(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INTEGER * (16 >> j)), 'sum') + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN n = 1 OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n = 1 OR page_id = low THEN NULL ELSE low END AS refers_to
        FROM b
    """,
    "op5_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
        h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        f AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM h JOIN f USING (k), range(50) AS t(o) WHERE doc_id > low),
        each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
        win AS (SELECT doc_id, i, ws[i : i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
        again AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win JOIN again USING (doc_id, k), range(3) AS t(o) GROUP BY doc_id),
        lines AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(n_lines, 0) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters
            FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars OR 2 * n_upper > n_letters OR 2 * n_dup_lines > n_lines
                    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM m
    """,
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(ws) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
        inside AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS longer
                   FROM (SELECT lang, ws, f, m, unnest(range(1, len(ws) - m + 2)) AS i FROM c, range(2, 5) AS t(m) WHERE m < k) GROUP BY ALL),
        cut AS (SELECT c.lang, c.phrase, f AS a, j, array_to_string(ws[1 : j], ' ') AS lp, array_to_string(ws[j + 1 :], ' ') AS rp
                FROM c LEFT JOIN inside USING (lang, phrase), range(1, 5) AS t(j) WHERE j < k AND (longer IS NULL OR longer < f)),
        s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN n ON n.lang = cut.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
        QUALIFY rank <= 2000
    """,
}
