"""The registered query of each operator here, over its whole table, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import contaminated
from .exactdup import exact_duplicates
from .mixing import mix, taken
from .neardup import near_duplicates
from .phrases import collocations
from .quality import fit_quality, score_quality
from .radixdup import repeated_bytes
from .secrets import secrets
from .substring import repeated_passages
from .tokenfiles import token_digest
from .toxicity import fit_toxicity, score_toxicity
from .turns import damaged, repair_conversations
from .warc import header_text, page_captures, resolve_revisits


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("class_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(*mix(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "ts", "outcome", "target_id", header_text(F.col("headers")).alias("headers"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damaged(table(spark, sf_dir, "conversations")), there_col="there")
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_token_files, op3_toxicity, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_secret_scans, op7_mix_sources, op8_substring_dedup, op9_exact_dedup, op10_warc_revisits, op11_conversation_repair, op12_phrase_collocations, op13_suffix_radix_dedup, pipeline)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _after(value: str, cost: int | str, edit: str) -> str:
    """SQL of a state's value, cost in nine digits and then the audit, after one more edit."""
    return f"(lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{edit}')"


_IN2 = "least(" + ", ".join(["e2", *(_after(e, 3, "I") for e in ("e0", "e1", "e3"))]) + ")"
_IN3 = "least(" + ", ".join(["e3", _after("e2", 3, "I"), *(_after(e, 6, "II") for e in ("e0", "e1"))]) + ")"


def _read(initial: str, states: tuple[str, ...]) -> str:
    reads = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_after(n, 'cut', 'K')} END" for n in states]
    return ", ".join(reads + ([f"CASE WHEN NOT gone THEN {_after(n, '3 + cut', 'R')} END" for n in states] if initial != "s" else []))


ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v) c USING (doc_id)""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i AS start, md5(array_to_string(w[i : i + 49], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS k FROM win JOIN firsts USING (h) WHERE doc_id > first),
        per AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ks, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN per USING (doc_id)""",
    "op10_warc_revisits": r"""
        WITH p AS (
            SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id // 7)::VARCHAR AS since, length(coalesce(html, '')) AS n,
                   regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?', '') AS rest FROM pages),
        c AS (
            SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^utm_'))) AS q FROM p),
        u AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\d*\.', '')
                || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
                || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
        full_ AS (SELECT canonical, 100 * page_id AS ts, 3 * page_id AS target_id, tag, since, n FROM u),
        asked AS (
            SELECT canonical, page_id, 100 * page_id + d AS ts, 3 * page_id + k AS record_id,
                   CASE page_id % 4 WHEN 0 THEN 'W/' || tag WHEN 1 THEN '"other"' END AS tag, CASE page_id % 4 WHEN 2 THEN since END AS since
            FROM u, (VALUES (1, -50), (2, 50)) AS t(k, d)),
        j AS (
            SELECT a.*, f.target_id, f.tag AS f_tag, f.since AS f_since, f.n,
                   CASE WHEN f.target_id IS NULL THEN 'no_response'
                        WHEN a.tag IS NOT NULL THEN CASE WHEN replace(a.tag, 'W/', '') = f.tag THEN 'resolved' ELSE 'changed' END
                        WHEN a.since IS NOT NULL THEN CASE WHEN a.since = f.since THEN 'resolved' ELSE 'changed' END
                        ELSE 'unverified' END AS outcome
            FROM asked a ASOF LEFT JOIN full_ f ON a.canonical = f.canonical AND a.ts > f.ts)
        SELECT record_id, canonical, ts, outcome, target_id,
               CASE WHEN target_id IS NULL THEN NULL ELSE
                 'cache-control: ' || CASE outcome WHEN 'resolved' THEN 'max-age=600' ELSE 'max-age=60' END || chr(10) || 'content-length: ' || n || chr(10)
                 || 'content-type: text/html' || chr(10) || CASE outcome WHEN 'resolved' THEN 'date: at ' || page_id || chr(10) ELSE '' END
                 || 'etag: ' || CASE WHEN outcome = 'resolved' AND tag IS NOT NULL THEN tag ELSE f_tag END || chr(10) || 'last-modified: ' || f_since END AS headers
        FROM j""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op13_suffix_radix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        cuts AS (SELECT doc_id, n, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS s FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS k FROM d)),
        win AS (SELECT doc_id, base + i AS i, md5(substr(s, 2 * i + 1, 100)) AS w FROM (SELECT *, unnest(range(0, least(1000, n - 49 - base))) AS i FROM cuts)),
        firsts AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN firsts USING (w) WHERE doc_id > first),
        runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR k > before + 1) AS n_spans
                 FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
        bytes AS (SELECT doc_id, substr(s, 2 * i + 1, 2) AS b, base + i AS k FROM (SELECT *, unnest(range(0, least(1000, n - base))) AS i FROM cuts SEMI JOIN runs USING (doc_id))),
        kept AS (SELECT doc_id, string_agg(b, '' ORDER BY k) AS h FROM bytes ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
        FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_phrase_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k))),
        f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g),
        sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE f >= 100 AND len(g) > 1),
        parts AS (SELECT lang, part, max(f) AS f FROM (
            SELECT lang, g, f, g[i : i + k - 1] AS part FROM (SELECT *, unnest(range(1, len(g) - k + 2)) AS i FROM c, range(2, 5) AS r(k) WHERE k < len(g))) GROUP BY lang, part),
        left_ AS (SELECT c.lang, c.g, c.f FROM c LEFT JOIN parts ON parts.lang = c.lang AND parts.part = c.g WHERE parts.f IS NULL OR 100 * parts.f < 100 * c.f),
        cut AS (SELECT x.lang, x.g, x.f AS a, l.f AS l, r.f AS r, n, k, (1000::HUGEINT * x.f * n) // (l.f::HUGEINT * r.f) AS score
                FROM (SELECT *, unnest(range(1, len(g))) AS k FROM left_) x JOIN sizes USING (lang)
                JOIN f l ON l.lang = x.lang AND l.g = x.g[1 : k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1 :]),
        best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op11_conversation_repair": rf"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) AS r(i)),
        c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM c, crc),
        d AS (SELECT ck, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE fault <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
        r AS (SELECT *, left(role, 1) AS initial, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
                     lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY i) AS before FROM n),
        rows_ AS (SELECT ck, i, initial, f IN (1, 2) AS gone, CASE WHEN f = 3 THEN 3 ELSE 0 END AS cut FROM r),
        chart AS (
            SELECT DISTINCT ck, 0::BIGINT AS i, '000000000' AS e0, NULL::VARCHAR AS e1, NULL::VARCHAR AS e2, NULL::VARCHAR AS e3 FROM c
            UNION ALL
            SELECT ck, i, {_after("e0", 4, "D")}, least({_after("e1", 4, "D")}, {_read("s", ("e0",))}),
                   least({_after("n2", 4, "D")}, {_read("u", ("e0", "e1", "n3"))}), least({_after("n3", 4, "D")}, {_read("a", ("n2",))})
            FROM (SELECT x.*, rows_.i AS next, initial, gone, cut FROM (SELECT *, {_IN2} AS n2, {_IN3} AS n3 FROM chart) x JOIN rows_ ON rows_.ck = x.ck AND rows_.i = x.i + 1) y(ck, before, e0, e1, e2, e3, n2, n3, i, initial, gone, cut)),
        best AS (SELECT ck, least(e0, {_IN3}) AS v FROM chart QUALIFY row_number() OVER (PARTITION BY ck ORDER BY i DESC) = 1),
        audits AS (SELECT ck, left(v, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM best),
        edits AS (SELECT *, substr(audit, p, 1) AS e FROM (SELECT ck, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
        placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY ck ORDER BY p)),
        opened AS (SELECT ck, 1 AS s FROM placed JOIN r USING (ck, i) WHERE o = 1 AND e = 'K' AND initial = 's'),
        lines AS (SELECT ck, p, CASE WHEN e = 'K' THEN role WHEN (o - 1 - coalesce(s, 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
                  FROM placed LEFT JOIN r USING (ck, i) LEFT JOIN opened USING (ck) WHERE e <> 'D'),
        whole AS (SELECT ck, string_agg(line, chr(10) ORDER BY p) AS t FROM lines GROUP BY ck),
        counts AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
                          count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY ck)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, ck FROM c) JOIN audits USING (ck) LEFT JOIN counts USING (ck) LEFT JOIN whole USING (ck)""",
}
