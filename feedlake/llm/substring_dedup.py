"""Operator 4: substring dedup over word windows, by level-wise doubling on sampled windows.

Windows of few words are tested first; only those that repeat at one length are extended to
about twice that length (1, 2, 4, 8 words by names inside a task, then 17, 34 and the whole
window of 50 by Spark), until no candidate survives or the full window is reached. Every word that a window covers whose word
sequence also starts in a document with a smaller id is removed; windows are judged on
the input. See ``repeats`` for how windows are sampled without loss and reranked.

Defined results: null text = no words; texts shorter than the window keep all; rows with a
null id are neither compared nor cut; rows that share an id never cut each other; an empty
table gives an empty result. Other columns pass through (kept, spans, n_symbols are replaced).
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from feedlake.llm import repeats


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 8, blocks: tuple[int, ...] = (34, 17, 1),
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (remaining words, one blank between), spans (removed word ranges) and n_symbols (words)."""
    return repeats.cut(docs, key, text, "words", window, gram, blocks, later_only=True)
