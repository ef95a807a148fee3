"""BM25 as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, FLOOR = 1.2, 0.75, 1e-6


def bm25(n_docs: Column, df: Column, tf: Column, doc_len: Column, avg_len: Column, query_tf: Column | float = 1.0) -> Column:
    weight = F.greatest(F.lit(FLOOR), F.log((n_docs - df + 0.5) / (df + 0.5)) * query_tf)
    k = K1 * ((1 - B) + (B * doc_len / avg_len))
    return weight * ((K1 + 1) * tf / (k + tf))
