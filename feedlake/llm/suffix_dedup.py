"""Operator 5: suffix-array dedup over sampled suffixes, by anchors and blocks in place of prefix doubling.

Names of 8 bytes double to 16 and 32 at every position inside a task. From there Spark
groups suffix positions by names at growing lengths (32, 273, 385, 400 bytes by default):
each round takes the pairs (name of the shared text, name of the text with its extension)
of surviving positions, drops unique names, and ends when a name passes the threshold
length. Positions are the anchors of ``repeats``, a sample that every 400-byte string
meets at the same offset in all its copies, so the sparse suffix order decides every
string exactly. Every byte covered by a string that also starts anywhere else is removed.

Defined results: null text = empty; texts shorter than the length keep all; matches never
cross documents; rows with a null id are neither compared nor cut; repeated rows are
documents of their own (both lose what they share); an empty table gives an empty result.
Other columns pass through (kept, spans, n_symbols are replaced).
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from feedlake.llm import repeats


def dedup_suffixes(docs: DataFrame, length: int = 400, gram: int = 32, blocks: tuple[int, ...] = (128, 16, 1),
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (remaining bytes), spans (removed byte ranges, maximal) and n_symbols (bytes)."""
    return repeats.cut(docs, key, text, "bytes", length, gram, blocks, later_only=False)
