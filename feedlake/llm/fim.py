"""Operator 11: fill-in-middle transformation by displacement scatter.

A text is cut at two token borders into prefix, middle and suffix, and rewritten as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). Cuts and
form follow from a digest of the row's key, so a rerun gives the same rows. Tokens are
letter runs ``[A-Za-z]+`` and single other code points.

A batch of texts is one byte buffer. A scan marks token starts; cuts are looked up among
them. Every moved segment adds its output shift to a difference array at its first byte;
the cumulative sum is the shift of every byte, and one numpy scatter builds all outputs of
the batch. ``restore`` finds the markers in the outputs, lays out the same differences the
other way and gathers the texts back; it reads nothing but output and form.

Defined results: null and empty texts are empty and plain, as are texts that contain a
marker; a null key is hashed as an empty string; repeated rows give repeated results (equal
keys, equal cuts); extra columns are ignored; a text is never split between batches; an
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import slices

FORMS = ("plain", "psm", "spm")
SLICE = 1 << 20                     # bytes of text that are moved at once
OUTPUT = "output string, form string, n long, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rule:
    """Markers, shares and seed. Markers look like ``<X>``, so that neighbours never make up another one."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    seed: int = 1
    moved_percent: int = 90         # of the rows that can be moved
    spm_percent: int = 20           # of the moved rows

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(m[:1] != b"<" or m[-1:] != b">" or not m[1:-1].isalnum() for m in marks):
            raise ValueError("markers must be three different strings like <P>")


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws per key, from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row borders from 0) of a string array; nulls are empty."""
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def _array(raw: np.ndarray, borders: np.ndarray) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(np.ascontiguousarray(borders, dtype=np.int64)), pa.py_buffer(raw))
    return made.cast(pa.string())


def _shifts(starts: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """Shift of each of ``size`` bytes; segment k begins at ``starts[k]`` (ascending, empty ones allowed) and moves by ``shift[k]``."""
    differences = np.zeros(size + 1, dtype=np.int64)
    np.add.at(differences, starts, np.diff(shift, prepend=0))
    return np.cumsum(differences[:size])


def _hits(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Positions of ``mark`` in the buffer."""
    if len(raw) < len(mark):
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(raw[: len(raw) - len(mark) + 1] == mark[0])
    for i in range(1, len(mark)):
        at = at[raw[at + i] == mark[i]]
    return at


def _inside(at: np.ndarray, length: int, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the hits that do not run over a row's end."""
    row = np.searchsorted(borders, at, "right") - 1
    whole = at + length <= borders[row + 1]
    return at[whole], row[whole]


def move(texts: pa.Array, h: list[np.ndarray], rule: Rule) -> list[pa.Array]:
    """The columns of ``OUTPUT`` for one batch."""
    raw, borders = _strings(texts)
    rows, begin, end = len(borders) - 1, borders[:-1], borders[1:]
    first = (raw & 0xC0) != 0x80                                   # first byte of a code point
    token = first.copy()
    letter = _LETTER[raw]
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[begin[end > begin]] = True
    tokens = np.flatnonzero(token)
    base = np.searchsorted(tokens, begin)
    n = np.searchsorted(tokens, end) - base
    tokens = np.append(tokens, len(raw))

    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    one, two = (np.where(c < n, tokens[np.minimum(base + c, len(tokens) - 1)], end) for c in cuts)
    form = np.where(h[3] % 100 < rule.spm_percent, 2, 1)
    form[(n == 0) | (h[2] % 100 >= rule.moved_percent)] = 0
    for mark in (rule.prefix, rule.suffix, rule.middle):
        form[_inside(_hits(raw, mark), len(mark), borders)[1]] = 0

    moved, spm = form > 0, form == 2
    p, s, m = len(rule.prefix), len(rule.suffix), len(rule.middle)
    out = np.concatenate([[0], np.cumsum(end - begin + (p + s + m) * moved)])
    at = out[:-1]
    head, tail = one - begin, end - two                            # lengths of prefix and suffix
    to_prefix = np.where(moved, at + p + spm * (s + tail), at)
    to_suffix = np.where(moved, at + s + ~spm * (p + head), at + two - begin)
    to_middle = np.where(moved, at + p + s + m + head + tail, at + one - begin)
    starts = np.stack([begin, one, two], axis=1).ravel()
    shift = _shifts(starts, (np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel() - starts), len(raw))
    made = np.empty(out[-1], dtype=np.uint8)
    made[np.arange(len(raw)) + shift] = raw
    for mark, where in ((rule.prefix, to_prefix), (rule.suffix, to_suffix), (rule.middle, to_middle)):
        for i, byte in enumerate(mark):
            made[where[moved] - len(mark) + i] = byte

    chars = np.concatenate([[0], np.cumsum(first)])
    plain = ~moved
    return [_array(made, out), pa.array(FORMS).take(pa.array(form)), pa.array(n),
            pa.array(chars[one] - chars[begin], mask=plain), pa.array(chars[two] - chars[one], mask=plain)]


def put_back(outputs: pa.Array, forms: pa.Array, rule: Rule) -> pa.Array:
    """The texts of one batch from outputs and forms alone."""
    raw, borders = _strings(outputs)
    begin, end = borders[:-1], borders[1:]
    form = np.array([FORMS.index(f) for f in forms.to_pylist()], dtype=np.int64)
    moved, spm = form > 0, form == 2
    p, s, m = len(rule.prefix), len(rule.suffix), len(rule.middle)
    found = []
    for mark in (rule.prefix, rule.suffix, rule.middle):
        at, row = _inside(_hits(raw, mark), len(mark), borders)
        place = begin.copy()
        place[row[::-1]] = at[::-1]                                # the first hit of a row stays
        found.append(place)
    prefix, suffix, middle = found
    # where the three parts lie in the output, and how long they are
    from_prefix, from_suffix, from_middle = (np.where(moved, f + k, begin) for f, k in ((prefix, p), (suffix, s), (middle, m)))
    head = np.where(moved, np.where(spm, middle, suffix) - from_prefix, 0)
    tail = np.where(moved, np.where(spm, prefix, middle) - from_suffix, 0)
    body = np.where(moved, end - from_middle, end - begin)
    back = np.concatenate([[0], np.cumsum(head + body + tail)])
    starts = np.stack([back[:-1], back[:-1] + head, back[:-1] + head + body], axis=1).ravel()
    shift = _shifts(starts, np.stack([from_prefix, from_middle, from_suffix], axis=1).ravel() - starts, int(back[-1]))
    return _array(raw[np.arange(back[-1]) + shift], back)


def _map(df: DataFrame, key: str, schema: str, run) -> DataFrame:
    kind = df.select(key).schema[0].dataType.simpleString()
    names = [key, *[x.split()[0] for x in schema.split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *run(part.columns[1:])], names=names)

    return df.mapInArrow(work, f"`{key}` {kind}, {schema}")


def _drawn(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    return df.select(F.col(key), F.col(text).cast("string"), *draws(F.col(key), rule.seed))


def _numbers(columns: list[pa.Array]) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, output, form, n tokens, prefix_chars, middle_chars); the last two count code points, null if plain."""
    return _map(_drawn(df, key, text, rule), key, OUTPUT, lambda c: move(c[0], _numbers(c[1:]), rule))


def restore(df: DataFrame, key: str = "doc_id", output: str = "output", form: str = "form", rule: Rule = Rule()) -> DataFrame:
    """(key, text) rebuilt from the two columns that ``transform`` made."""
    return _map(df.select(key, output, form), key, "text string", lambda c: [put_back(c[0], c[1], rule)])


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``transform`` with the column restored, in one pass over the texts."""
    def both(columns: list[pa.Array]) -> list[pa.Array]:
        made = move(columns[0], _numbers(columns[1:]), rule)
        return [*made, put_back(made[0], made[1], rule)]
    return _map(_drawn(df, key, text, rule), key, f"{OUTPUT}, restored string", both)
