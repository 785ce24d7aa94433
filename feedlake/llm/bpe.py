"""Operator 1: BPE encoding and decoding.

Encoding never runs the merge loop. For every prefix of a word the byte-pair
encoding has one last token; it is the only token that ends there and does not
merge across its seam with the last token of the remaining prefix. An automaton
over the vocabulary lists the tokens that end at each position, a pair test on
the merge tree decides compatibility, and back-pointers from the word's end give
the ids (dynamic programming over prefixes; linear in the word length).

The vocabulary is a ``tokenizers`` JSON file with an ``end_of_word_suffix`` and
no decoder, lower-casing and dropping white space. Its normalizer and pre-tokenizer
are applied by the library (printable ASCII by the same pattern here); white space
always ends a word, so texts are cut there and each distinct word is handled once
per task (a bounded memo).

Defined results: null text = empty text = no ids and an empty decoded text;
repeated rows are encoded each; extra columns are ignored; texts of any length
are handled whole, row by row. An empty table gives an empty result.
"""
from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import give_back, slices

#: Pre-tokenized words of printable lower-case ASCII: what the library's pattern gives there.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
END = "\x00"  # stands for the end-of-word suffix; never a character of a pre-tokenized word


class PrefixBPE:
    """Encoder and decoder of one vocabulary file; ``memo`` bounds the chunk memo."""

    def __init__(self, vocabulary_json: str, memo: int = 800_000):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary_json)
        model, tok = spec["model"], Tokenizer.from_str(vocabulary_json)
        self.normalize, self.pre_tokenize = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        suffix = model["end_of_word_suffix"]
        mark = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        vocab = {mark(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        size = max(self.strings) + 1
        self.size = size
        self.rank_of_pair: dict[int, int] = {}
        self.made_at, self.left, self.right = [-1] * size, [0] * size, [0] * size
        for rank, (a, b) in enumerate(merges):
            x, y = vocab[mark(a)], vocab[mark(b)]
            self.rank_of_pair[x * size + y] = rank
            z = vocab[mark(a + b)]
            self.made_at[z], self.left[z], self.right[z] = rank, x, y
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self.strings[i] not in self.added:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.memo = memo

    def compatible(self, a: int, b: int) -> bool:
        """True if encoding the text of ``a`` then ``b`` keeps their seam.

        Undo the merges next to the seam from the latest to the earliest; if at some
        moment the two neighbours could merge sooner than the merge just undone
        happened, the seam would have been crossed. Equal ranks go left to right.
        """
        before, made_at, x, y = len(self.rank_of_pair), self.made_at, a, b
        while True:
            if self.rank_of_pair.get(x * self.size + y, before) < before:
                return False
            if made_at[x] < 0 and made_at[y] < 0:
                return True
            if made_at[x] > made_at[y]:
                before, x = made_at[x], self.right[x]
            else:
                before, y = made_at[y] + 1, self.left[y]

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-tokenized word."""
        s = piece + END
        last, start = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        pairs, size = self.pairs, self.size
        for end, (token, length) in self.automaton.iter(s):
            here = end + 1
            if last[here] >= 0:
                continue
            j = here - length
            if j:
                before = last[j]
                if before < 0:
                    continue
                ok = pairs.get(before * size + token)
                if ok is None:
                    ok = pairs[before * size + token] = self.compatible(before, token)
                if not ok:
                    continue
            last[here], start[here] = token, j
        at, ids = len(s), []
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of normalized text without white space."""
        if text.isascii() and text.isprintable():
            pieces = PIECES.findall(text)
        else:
            pieces = [p for p, _ in self.pre_tokenize(text)]
        out, words = [], self.words
        for piece in pieces:
            found = words.get(piece)
            if found is None:
                found = array("I", self.word(piece)).tobytes()
                if len(piece) <= 64:
                    words[piece] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if self.specials is not None and "<|" in text and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self.encode(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self.encode(text[at:])])
        for memo in (self.pairs, self.words, self.chunks):
            if len(memo) > self.memo:
                memo.clear()
        # normalized text has single blanks for white space; str.split would also break at the separators
        parts = text.lower().split() if text.isascii() and not SEPARATORS.search(text) else self.normalize(text).split(" ")
        words, chunks = self.words, self.chunks
        out = [*map(words.get, parts)]
        for i, found in enumerate(out):
            if found is None:
                c = parts[i]
                found = words.get(c) or chunks.get(c)
                if found is None:
                    found = self.chunk(c)
                    if len(c) <= 64 and c not in words:
                        chunks[c] = found
                out[i] = found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space, as a tokenizer without decoder gives them; unknown ids are left out."""
        return " ".join([t for t in map(self.strings.get, np.frombuffer(ids, dtype="<u4").tolist()) if t is not None])


_LOADED: dict[int, PrefixBPE] = {}


def _loaded(vocabulary_json: str) -> PrefixBPE:
    key = hash(vocabulary_json)
    if key not in _LOADED:
        _LOADED[key] = PrefixBPE(vocabulary_json)
    return _LOADED[key]


def _map(df: DataFrame, key: str, column: str, vocabulary: str, outputs: str, run) -> DataFrame:
    """One narrow pass; the vocabulary file (fixed size) is read on the driver and broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    key_type = df.select(key).schema[0].dataType.simpleString()
    names = [key, *[x.split()[0] for x in outputs.split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                rows = [run(bpe, x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in zip(*rows, strict=True)]], names=names)
        for memo in (bpe.words, bpe.chunks):
            memo.clear()  # the worker lives on
        give_back()

    return df.select(key, column).mapInArrow(work, f"`{key}` {key_type}, {outputs}")


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): whole texts to little-endian unsigned 32-bit ids."""
    return _map(df, key, text, vocabulary, "ids binary", lambda b, x: (b.encode(x),))


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded string) from the ids that ``encode`` returns."""
    return _map(df, key, ids, vocabulary, "decoded string", lambda b, x: (b.decode(x or b""),))


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string) in one pass over the texts."""
    def both(b: PrefixBPE, x: str | None):
        ids = b.encode(x)
        return ids, b.decode(ids)
    return _map(df, key, text, vocabulary, "ids binary, decoded string", both)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of a round trip with its token count and digests."""
    return encoded.select(
        *keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
