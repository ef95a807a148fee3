"""Tokenisation: one definition for Spark and one for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"[\p{L}\p{N}]+"

#: DuckDB: ``d`` has a list of words for each document, ``tok`` a row for each word, ``docs_t`` the layout of the documents.
SQL = rf"""d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '{PATTERN}'), []) AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS term, (generate_subscripts(l, 1) - 1)::BIGINT AS pos FROM d),
docs_t AS (SELECT doc_id, len(l)::BIGINT AS n_tokens, (len(l) + 1)::BIGINT AS doc_len,
  coalesce(sum(len(l) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_start FROM d)"""


def words(text: Column | str) -> Column:
    """The lower-cased runs of letters and digits of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
