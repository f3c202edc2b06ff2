"""DuckDB twins of the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from marketspark.llm.rules import CLASSES, COMMON


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules_sql() -> str:
    """Base counts by unnesting lines and windows; distances from long tables of bins."""
    classes = [*CLASSES.values()]
    counted = ", ".join(f"length(t) - length(regexp_replace(t, {_sql(p)}, '', 'g'))" for p in classes)
    common = " UNION ALL ".join(
        f"SELECT {_sql(lang)} AS lang, {i} AS bin, {_sql(word)} AS word"
        for lang, words in COMMON.items()
        for i, word in enumerate(words)
    )
    last = len(next(iter(COMMON.values())))
    return f"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words
      FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
    ), lines AS (
      SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
    ), windows AS (
      SELECT r, i, list_slice(words, i, i + 4) AS w
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM d)
    ), twice AS (
      SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1
    ), repeats AS (
      SELECT r, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows JOIN twice USING (r, w)) GROUP BY r
    ), base AS MATERIALIZED (
      SELECT d.r, doc_id, lang, len(words) AS n_words,
        coalesce(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars,
        [{counted}] AS seen,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
    ), judged AS MATERIALIZED (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
    ), listed AS ({common}
    ), hits AS (
      SELECT r, bin, count(*) AS n
      FROM (SELECT r, lang, lower(unnest(words)) AS word FROM d) JOIN listed USING (lang, word) GROUP BY r, bin
    ), bins AS MATERIALIZED (
      SELECT r, 'c' AS kind, i AS bin, seen[i]::DOUBLE AS n FROM judged, range(1, {len(classes) + 1}) AS x(i)
      UNION ALL SELECT r, 'c', 0, word_chars - list_sum(seen) FROM judged
      UNION ALL SELECT r, 'w', bin, n FROM hits
      UNION ALL SELECT r, 'w', {last}, n_words - coalesce(n, 0)
        FROM judged LEFT JOIN (SELECT r, sum(n) AS n FROM hits GROUP BY r) USING (r)
    ), wanted AS (
      SELECT lang, kind, bin, sum(n) AS n FROM bins JOIN judged USING (r)
      WHERE NOT base_failed AND lang IN (SELECT lang FROM listed) GROUP BY ALL
    ), q AS (
      SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM wanted
    ), p AS (
      SELECT r, kind, bin, n / nullif(sum(n) OVER (PARTITION BY r, kind), 0) AS p FROM bins
    ), pairs AS (
      SELECT judged.r, q.kind, coalesce(p, 0) AS p, q, (coalesce(p, 0) + q) / 2 AS m
      FROM judged JOIN q USING (lang) LEFT JOIN p ON p.r = judged.r AND p.kind = q.kind AND p.bin = q.bin
    ), far AS (
      SELECT r, sqrt(greatest(sum(s) FILTER (kind = 'c') / 2, 0)) AS c, sqrt(greatest(sum(s) FILTER (kind = 'w') / 2, 0)) AS w
      FROM (SELECT r, kind, CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END AS s FROM pairs) GROUP BY r
    )
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars, seen[3]::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed
        AND NOT (word_chars >= 400 AND coalesce(c, 0) > 0.30)
        AND NOT (n_words >= 100 AND coalesce(w, 0) > 0.27) AS kept
    FROM judged LEFT JOIN far USING (r)
    """


def warc_sql() -> str:
    """What a reader finds in the archives: digests from the pages, copies by a window over equal payloads."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)"
    return f"""
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
      FROM pages
    )
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
      list_aggregate([{digit} FOR i IN range(32)], 'string_agg', '') AS payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
    FROM p
    """


def divergence_sql() -> str:
    """Every kept term beside every source of its language, and every two sources over all these terms."""
    share = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source
      FROM documents
    ), tokens AS MATERIALIZED (
      SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d)
    ), kept AS MATERIALIZED (
      SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
    ), langs AS (
      SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
    ), sources AS (
      SELECT DISTINCT lang, source FROM d
    ), counts AS (
      SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL
    ), totals AS (
      SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL
    ), shares AS MATERIALIZED (
      SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share.format(n="coalesce(c.n, 0)", total="coalesce(t.n, 0)")} AS p,
        {share.format(n="k.n", total="l.n")} AS q
      FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang)
        LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
    ), pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum({f.replace("q", "b.p").replace("(p", "(a.p")}) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), found AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
      FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, {f} FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
      SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found
    ) WHERE part = 'pair' OR rank <= 10
    """
