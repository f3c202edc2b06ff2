"""The number check in DuckDB SQL."""

from __future__ import annotations

from oracle.tables import TABLES

TABLES["doc_numbers"] = r"""
SELECT doc_id, pos - 1 AS pos, replace(found[pos], ',', '') AS number
FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?') AS found FROM documents))"""

TABLES["all_numbers"] = r"""
SELECT DISTINCT number FROM doc_numbers
UNION
SELECT replace(unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')), ',', '') FROM fact_texts"""

def _rounded(places: int) -> str:
    """Half-even rounding in whole units of 10^-8: quotient, remainder, and the point put back."""
    step = 10 ** (8 - places)
    up = f"(units % {step} * 2 > {step} OR (units % {step} * 2 = {step} AND (units // {step}) % 2 = 1))"
    text = f"CAST(units // {step} + CASE WHEN {up} THEN 1 ELSE 0 END AS VARCHAR)"
    if not places:
        return text
    padded = f"lpad({text}, CAST(greatest(len({text}), {places + 1}) AS INTEGER), '0')"
    return f"left({padded}, len({padded}) - {places}) || '.' || right({padded}, {places})"


TABLES["spellings"] = f"""
SELECT number, unnest(list_distinct([
           head || CASE WHEN rtrim(tail, '0') = '' THEN '' ELSE '.' || rtrim(tail, '0') END,
           {_rounded(0)}, {_rounded(1)}, {_rounded(2)}])) AS variant
FROM (SELECT *, TRY_CAST(head || rpad(left(tail, 7), 7, '0')
             || CASE WHEN ltrim(substr(tail, 8), '0') = '' THEN '0' ELSE '1' END AS HUGEINT) AS units
      FROM (SELECT number, CASE WHEN ltrim(split_part(number, '.', 1), '0') = '' THEN '0'
                           ELSE ltrim(split_part(number, '.', 1), '0') END AS head,
                   split_part(number, '.', 2) AS tail FROM all_numbers))"""

TABLES["allowed"] = r"""
SELECT variant FROM spellings WHERE number IN (
    SELECT replace(unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')), ',', '') FROM fact_texts)
UNION
SELECT CAST(unnest(range(0, 11)) AS VARCHAR)"""

TABLES["invented"] = """
SELECT doc_id, pos, number FROM doc_numbers
WHERE number NOT IN (SELECT number FROM spellings WHERE variant IN (SELECT variant FROM allowed))"""

_CHECK = """
SELECT doc_id, count(number) AS numbers_in_text,
       coalesce(string_agg(bad, ' ' ORDER BY pos), '') AS unsupported_numbers,
       count(bad) = 0 AS passed
FROM (
    SELECT d.doc_id, n.number, n.pos, i.number AS bad
    FROM documents AS d
    LEFT JOIN doc_numbers AS n ON n.doc_id = d.doc_id
    LEFT JOIN invented AS i ON i.doc_id = n.doc_id AND i.pos = n.pos
) GROUP BY doc_id"""

SHOWN = {
    "extract_numbers": "SELECT doc_id, pos, number FROM doc_numbers",
    "number_variants": "SELECT number, variant FROM spellings WHERE number IN (SELECT number FROM doc_numbers)",
    "allowed_numbers": "SELECT variant FROM allowed",
    "unsupported_numbers": "SELECT doc_id, pos, number FROM invented",
    "number_check": _CHECK,
    "number_check_by_join": _CHECK,
}
