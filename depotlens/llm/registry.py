"""Query name -> callable(spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify
from .lexical_search import lexical_search
from .licenses import license_scan
from .mixing import mix
from .packing import pack
from .quality_mil import classify
from .quality_rules import quality_rules
from .simhash import simhash_dedup
from .span_dedup import remove_repeats
from .spelling import spelling_groups
from .toxicity import detect

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), words=3, distance=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_retrieval_packing": op13_retrieval_packing,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        lines AS (SELECT r, unnest(string_split(body, chr(10))) AS line FROM d),
        dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
        win AS (
            SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        many AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM win WHERE c IS NOT NULL),
        rep AS (SELECT r, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) AS t(k) WHERE many.n > 1 GROUP BY r),
        m AS (
            SELECT d.r, doc_id, source, len(words) AS n_words,
                   length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
            FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r),
        f AS (
            SELECT m.*, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 5 * n_dup_lines > n_words]) AS failed,
                   unnest([1, 2, 3, 4]) AS rule
            FROM m),
        h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY ALL),
        p AS (
            SELECT rule, sum(k) / sum(n) AS mean, greatest(sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ^ 2, 0) AS var FROM h GROUP BY rule),
        s AS (
            SELECT rule, mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 10), 1e6) ELSE 1e6 END AS strength FROM p),
        v AS (SELECT source, bool_or((k + mean * strength) / (n + strength) > 0.8) AS host_failed FROM h JOIN s USING (rule) GROUP BY source)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, host_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept
        FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g ON d.body = g.body""",
    "op7_source_mixing": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, '')) || ' ' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1) AS name,
                   (('0x' || substr(md5(name), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
            FROM d GROUP BY source),
        -- sources by size per weight: the first ones get their cap, the water level of the rest decides
        o AS (
            SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k,
                   sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
                   sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
            FROM s),
        lvl AS (SELECT words::DOUBLE AS words, ws::DOUBLE AS ws, k FROM o WHERE words::DOUBLE * w / ws <= 3 * source_size ORDER BY k LIMIT 1),
        t AS (
            SELECT source, source_size,
                   CASE WHEN o.k < (SELECT k FROM lvl) THEN 3.0::DOUBLE * source_size
                        ELSE (SELECT words FROM lvl) * w / (SELECT ws FROM lvl) END AS target
            FROM o),
        r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.source, u, length(bin(d.size))::DOUBLE AS bits
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        -- documents above a number of bits are full; the first number whose rate leaves it below the cap
        b AS (SELECT source, target, bits, sum(size)::DOUBLE AS words, sum(size * bits) AS weighed FROM r GROUP BY ALL),
        lv AS (
            SELECT source, bits, target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weighed) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighed
            FROM b),
        rt AS (SELECT source, max_by(rest / weighed, bits) AS rate FROM lv WHERE weighed > 0 AND bits * (rest / weighed) < 3 GROUP BY source),
        e AS (
            SELECT r.*, CASE WHEN target >= 3 * source_size THEN 3.0::DOUBLE ELSE least(bits * coalesce(rate, 0), 3.0::DOUBLE) END AS copies
            FROM r LEFT JOIN rt ON r.source IS NOT DISTINCT FROM rt.source),
        q AS (
            SELECT *, floor(copies)::BIGINT AS whole, target - sum(floor(copies) * size) OVER (PARTITION BY source) AS need,
                   CASE WHEN copies > floor(copies)
                        THEN u / (1 - u) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS odds
            FROM e),
        c AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                   sum(size) OVER (PARTITION BY source, odds) AS unit
            FROM q)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               size * (whole + CASE WHEN odds IS NOT NULL AND need > 0
                   AND (upto <= need OR (upto - unit < need AND upto - need <= need - (upto - unit))) THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM c""",
    "op11_ranked_search": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents),
        n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
        a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
        b AS (SELECT DISTINCT item_id, text FROM benchmark),
        q AS (
            SELECT i, item_id, term, count(*) AS times
            FROM (SELECT row_number() OVER () AS i, item_id,
                         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
                  FROM b) GROUP BY ALL),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, docs),
        v AS (
            SELECT p.r, n.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * a.docs) // a.length))) AS impact
            FROM p JOIN n USING (r) JOIN w USING (term), a),
        s AS (SELECT i, item_id, r, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL),
        k AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op12_spelling_groups": """
        WITH RECURSIVE bit(i, c, k) AS (
            SELECT i, i, 0 FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS of FROM bit WHERE k = 8),
        run AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run
            FROM documents),
        h AS (
            SELECT run, times, len(run) AS size,
                   xor(4294967295, list_reduce(list_transform(string_split(hex(encode(id || ':' || run)).regexp_replace('(..)', '\\1 ', 'g').rtrim(), ' '),
                                                              lambda x: ('0x' || x)::BIGINT),
                                               lambda a, x: xor(a >> 8, of[1 + (xor(a, x) & 255)]), 4294967295::BIGINT)) AS h
            FROM (SELECT id, run, count(*) AS times FROM run GROUP BY ALL), crc),
        v AS (
            SELECT word, sum(times)::BIGINT AS n
            FROM (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % size)::INT) || substr(run, (h % size)::INT + 2) ELSE run END AS word FROM h)
            WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        -- levenshtein() counts bytes here: one byte a letter
        u AS (SELECT *, translate(word, 'LATIN', 'ASCII') AS plain FROM v),
        near AS (
            SELECT a.word, b.word AS other, a.n, b.n AS other_n
            FROM u a JOIN u b ON abs(len(a.word) - len(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
        best AS (
            SELECT word, n, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS best FROM near GROUP BY word, n),
        f AS (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * v.n THEN best.form END AS form,
                   CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n
            FROM v LEFT JOIN best USING (word)),
        walk(word, spot) AS (
            SELECT word, word FROM f
            UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.spot = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, walk.spot AS root, f.n, f.n_near, f.form_n
        FROM f JOIN walk USING (word) JOIN f AS last ON last.word = walk.spot AND last.form IS NULL""",
}

ORACLES["op12_spelling_groups"] = (ORACLES["op12_spelling_groups"].replace("LATIN", "".join(map(chr, range(0xC0, 0x100))))
                                   .replace("ASCII", "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'`\"\\\\")))
