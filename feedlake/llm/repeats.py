"""Exact repeats of a fixed window length over sequences of symbols, level by level.

The two repeat operators (word windows, byte strings) share this engine. A window is
``window`` symbols of one document. Listing every window as a row would multiply the
input, so positions are sampled without loss: a window is represented by its anchor, the
leftmost smallest ``gram`` among the grams it holds. Equal windows have equal anchors at
equal offsets, and about one position in window/2 is an anchor. Text of a short period has
an anchor in every period; consecutive anchors with one span are a run, kept as one row.

Names are made by doubling: the name of length 2m at i is a mix of the names of length m
at i and i + m. Spark then reranks anchors level by level, at growing lengths:

1. the anchor with its whole run of windows (its span). Equal spans are decided together
   and one of them goes on; an anchor gram with a single span is unique and drops out;
2. for block sizes b1 > b2 > ... > 1, the windows of an anchor are cut into blocks of b
   offsets (aligned, so equal windows fall into equal blocks). The core of a block is the
   text that all its windows share, ``window - b + 1`` symbols: each level takes the pairs
   (core, span) of the surviving positions, groups them, drops cores that are unique,
   decides spans that repeat, and hands one position per distinct span to the next level
   with longer cores. At b = 1 core, span and window are the same and all is decided.

Work follows the edges of repeated regions, not their size: copies are settled at
level 1 and a boundary costs a few rows per level. All grouping is partial aggregation
before a shuffle on 128-bit names, so common passages are counted map-side; joins back
on names are left to AQE's skew splitting. Each level is written to the shared folder.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import materialize, scratch, slices

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_POSITION = np.uint64((1 << 24) - 1)
CHUNK = 1 << 22          # windows whose anchors are chosen at once


class _WordNames(dict):
    """word -> 64-bit name, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        name = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = name
        return name


_NAMES = _WordNames()


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8: exactly the white space of bytes.split."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_symbols(text: str | None) -> np.ndarray:
    words = split_words(text)
    return np.fromiter(map(_NAMES.__getitem__, words), dtype=np.uint64, count=len(words))


def byte_symbols(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


SYMBOLS = {"words": word_symbols, "bytes": byte_symbols}


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K[0]
    x += b * _K[1]
    x ^= x >> np.uint64(29)
    x *= _K[2]
    x ^= x >> np.uint64(32)
    return x


def gram_names(symbols: np.ndarray, gram: int) -> np.ndarray:
    """64-bit names of the ``gram`` symbols at every position (gram: a power of two, 8 at least for bytes)."""
    if symbols.dtype == np.uint8:  # eight bytes at once are a name already
        raw = np.ascontiguousarray(symbols)
        names, m = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)).copy(), 8
    else:
        names, m = symbols, 1
    if m == gram:
        names = _mix(names, names)
    while m < gram:
        names = _mix(names[:-m], names[m:])
        m *= 2
    return names


def anchors(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of every anchor; ``width`` grams a window."""
    found = []
    windows = len(names) - width + 1
    for at in range(0, windows, CHUNK):
        part = names[at : min(at + CHUNK, windows) + width - 1]
        low = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)  # ties go left
        m = 1
        while m * 2 <= width:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if m < width:
            low = np.minimum(low[: m - width], low[width - m :])
        place = (low & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        found.append((place[first] + at, first + at, last + at))
    place, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # a run over a chunk's edge is one run
    return place[new], first[new], last[np.append(new[1:], len(place)) - 1]


def _digests(pieces: list, place) -> np.ndarray:
    """128-bit names of texts at a place (offsets in the anchor's window) as two int64 columns."""
    import xxhash
    names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), dtype=np.uint64).reshape(-1, 2).copy()
    names[:, 0] = _mix(names[:, 0], np.asarray(place, dtype=np.uint64))
    return names.view(np.int64)


def span_table(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """(doc, h, p, q, lo, hi, g, s1, s2): every anchor with its window offsets lo..hi, gram name and span name.

    Consecutive anchors of one span are one row: places p, p + (hi - lo + 1), ... to q, whose windows follow without a gap.
    """
    symbols_of = SYMBOLS[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for doc, h, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    symbols = symbols_of(text)
                    if len(symbols) < window:
                        continue
                    names = gram_names(symbols, gram)
                    p, first, last = anchors(names, window - gram + 1)
                    view, size = memoryview(symbols.view(np.uint8)), symbols.itemsize
                    spans = _digests([view[a * size : (b + window) * size] for a, b in zip(first.tolist(), last.tolist(), strict=True)],
                                     (p - last) * window + p - first)
                    every = np.column_stack([p - last, p - first, names[p].view(np.int64), spans])
                    new = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)]))
                    q, p, (lo, hi, g, s1, s2) = p[np.append(new[1:], len(p)) - 1], p[new], every[new].T
                    out.append((np.full(len(p), doc), np.full(len(p), h), p, q, lo, hi, g, s1, s2))
                if out:
                    doc, h, p, q, lo, hi, g, s1, s2 = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc), pa.array(h), *[pa.array(x.astype(np.int32)) for x in (p, q, lo, hi)], *map(pa.array, (g, s1, s2))],
                        names=["doc", "h", "p", "q", "lo", "hi", "g", "s1", "s2"])

    return docs.select("doc", "h", "text").mapInArrow(work, "doc long, h long, p int, q int, lo int, hi int, g long, s1 long, s2 long")


def _cut_slices(docs: DataFrame, kind: str, window: int, gram: int, block: int) -> DataFrame:
    """Representatives with the symbols around them that their blocks of offsets can reach."""
    symbols_of = SYMBOLS[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for doc, h, text, reps in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    symbols = symbols_of(text)
                    for r in reps:
                        p, lo, hi = r["p"], r["lo"], r["hi"]
                        top = min(hi // block * block + block - 1, window - gram)
                        a, b = max(0, p - top), min(len(symbols), p - lo // block * block + window)
                        out.append((doc, h, p, lo, hi, p - a, symbols[a:b].tobytes()))
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *[pa.array(x, pa.int32()) for x in c[2:6]], pa.array(c[6], pa.binary())],
                        names=["doc", "h", "p", "lo", "hi", "before", "symbols"])

    return docs.mapInArrow(work, "doc long, h long, p int, lo int, hi int, before int, symbols binary")


def _block_names(pending: DataFrame, window: int, gram: int, block: int, size: int) -> DataFrame:
    """(doc, h, p, lo, hi, c1, c2, t1, t2): for every pending block of offsets its core and span names.

    A span that would leave the document is unlike any other (named after its place).
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cores, spans = [], [], []
            for doc, h, p, lo, hi, before, symbols, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, view = len(symbols) // size, memoryview(symbols)
                for r in ranges:
                    for k in range(max(lo, r["lo"]) // block, min(hi, r["hi"]) // block + 1):
                        first, top = k * block, min(k * block + block - 1, window - gram)
                        a, b = before - top, before - first + window
                        rows.append((doc, h, p, k, max(lo, r["lo"], first), min(hi, r["hi"], top)))
                        cores.append(view[(before - first) * size : (before - top + window) * size])
                        spans.append(view[a * size : b * size] if a >= 0 and b <= n else b"%d %d %d" % (doc, h, p))
            if rows:
                r = list(zip(*rows, strict=True))
                c, t = _digests(cores, r[3]), _digests(spans, r[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r[0], pa.int64()), pa.array(r[1], pa.int64()), *[pa.array(r[x], pa.int32()) for x in (2, 4, 5)],
                     *[pa.array(np.ascontiguousarray(x[:, j])) for x in (c, t) for j in (0, 1)]],
                    names=["doc", "h", "p", "lo", "hi", "c1", "c2", "t1", "t2"])

    fields = ["doc", "h", "p", "lo", "hi", "before", "symbols", "ranges"]
    return pending.select(*fields).mapInArrow(work, "doc long, h long, p int, lo int, hi int, c1 long, c2 long, t1 long, t2 long")


def _level(entries: DataFrame, core: list[str], span: list[str], later_only: bool, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decided windows (doc, h, p, q, lo, hi), representatives that go on, their twins) of one level.

    With ``later_only`` a span's first document is left undecided; its places besides the
    representative (rh, rp) are twins, to which decisions of deeper levels have to come back.
    Of a run of places p to q the first is the representative; entries without q are single places.
    """
    if "q" not in entries.columns:
        entries = entries.withColumn("q", F.col("p"))
    spans = materialize(
        entries.groupBy(*span).agg(
            *[F.min(c).alias(c) for c in core], F.sum(F.expr("1 + (q - p) div (hi - lo + 1)")).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("final"),
            F.min(F.struct("doc", "h", "p", "lo", "hi")).alias("rep"))
        .where(F.lit(True) if not last else (F.col("first") < F.col("final")) if later_only else F.col("n") > 1), "spans")
    twins, places = None, ["doc", "h", "p", "q", "lo", "hi"]
    if later_only and not last:
        repeated = spans.where("n > 1").select(*span, "first", F.col("rep.h").alias("rh"), F.col("rep.p").alias("rp"))
        hit = entries.select(*places, *span).join(repeated, span).where("doc > first or h <> rh or p <> rp or p < q")
        early = F.col("doc") == F.col("first")
        hit = materialize(hit.select(*places, *[F.when(early, F.col(c)).alias(c) for c in ("rh", "rp")]), "decided")
        decided, twins = hit.where("rh is null").select(*places), hit.where("rh is not null")
    elif later_only:
        repeated = spans.where("first < final").select(*span, "first")
        decided = entries.select(*places, *span).join(repeated, span).where("doc > first").select(*places)
    else:  # spans are grouped by ``span``: a place stays or goes, and is never paired with another
        decided = entries.select(*places, *span).join(spans.where("n > 1").select(*span), span, "left_semi").select(*places)
    if last:
        return decided, None, None
    mixed = (spans.groupBy(*core).agg(F.count("*").alias("m"), F.min("first").alias("first"), F.max("final").alias("final"))
             .where("m > 1 and first < final" if later_only else "m > 1").select(*core))
    return decided, spans.join(mixed, core).select("rep.*"), twins


def _union(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every


def _with_twins(found: list[tuple[DataFrame, DataFrame]]) -> list[DataFrame]:
    """Decided windows of all levels, those of representatives repeated at their twins, deepest level first."""
    deeper = [materialize(found[-1][0], "decided")]
    for decided, twins in reversed(found[:-1]):
        twins = twins.distinct()
        if not twins.isEmpty():
            at = twins.select("doc", F.col("h").alias("th"), F.col("p").alias("tp"), F.col("q").alias("tq"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"),
                              F.col("rh").alias("h"), F.col("rp").alias("p"))
            same = _union(deeper).distinct().join(at, ["doc", "h", "p"]).where("tlo <= lo and hi <= thi")
            places = F.explode(F.sequence("tp", "tq", F.expr("thi - tlo + 1")))
            deeper.append(materialize(same.select("doc", F.col("th").alias("h"), places.alias("p"), "lo", "hi")
                                      .select("doc", "h", "p", F.col("p").alias("q"), "lo", "hi"), "twins"))
        deeper.append(decided)
    return deeper


def repeated_windows(docs: DataFrame, kind: str, window: int, gram: int, blocks: tuple[int, ...], later_only: bool) -> DataFrame:
    """(doc, h, covered array<struct<a,b>>): what repeated windows cover, as disjoint ranges of symbols in order.

    ``docs`` has doc (id), h (digest of the text) and text. A window counts if it also
    starts at any other place, or with ``later_only`` in a document of a smaller id.
    """
    if blocks[-1] != 1 or any(a % b for a, b in zip(blocks, blocks[1:], strict=False)):
        raise ValueError("block sizes must divide each other and end with 1")
    size = 8 if kind == "words" else 1
    spans = materialize(span_table(docs, kind, window, gram), "anchors")
    decided, reps, twins = _level(spans, ["g"], ["s1", "s2"], later_only, False)
    found = [(decided, twins)]
    listed = reps.groupBy("doc", "h").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("reps"))
    around = materialize(_cut_slices(docs.join(listed, ["doc", "h"]).select("doc", "h", "text", "reps"), kind, window, gram, blocks[0]), "around")
    pending = around.withColumn("ranges", F.array(F.struct("lo", "hi")))
    for block in blocks:
        entries = materialize(_block_names(pending, window, gram, block, size), "blocks")
        decided, reps, twins = _level(entries, ["c1", "c2"], ["t1", "t2"], later_only, block == 1)
        found.append((decided, twins))
        if block > 1:
            ranges = reps.groupBy("doc", "h", "p").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
            pending = around.join(ranges, ["doc", "h", "p"])
    every = _union(_with_twins(found) if later_only else [decided for decided, _ in found])
    ends = F.struct((F.col("p") - F.col("hi")).alias("a"), (F.col("q") - F.col("lo") + window).alias("b"))
    return every.groupBy("doc", "h").agg(F.array_sort(F.collect_set(ends)).alias("covered"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges {a, b} merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for r in ranges or []:
        if out and r["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["b"]))
        else:
            out.append((r["a"], r["b"]))
    return out


def with_covered(docs: DataFrame, key: str, text: str, kind: str, window: int, gram: int, blocks: tuple[int, ...], later_only: bool) -> DataFrame:
    """(row, text, ranges): the other columns of ``docs`` as one struct, the text, and the ranges that ``repeated_windows`` finds (null: none, or a null id).

    The ranges are written before it returns; the tables of the levels are removed.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    marked = docs.select(rest.alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("name"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as stay:
        given = marked.where("id is not null").select(F.col("id").alias("doc"), F.col("name").alias("h"), "text")
        covered = materialize(repeated_windows(given, kind, window, gram, blocks, later_only), "covered")
        stay.append(covered)
    return (marked.join(covered, (F.col("id") == F.col("doc")) & (F.col("name") == F.col("h")), "left")
            .select("row", "text", F.col("covered").cast("array<struct<a:int,b:int>>").alias("ranges")))


def cut(docs: DataFrame, key: str, text: str, kind: str, window: int, gram: int, blocks: tuple[int, ...], later_only: bool) -> DataFrame:
    """``docs`` with kept (binary), spans array<struct<a,b>> and n_symbols long (columns of those names are replaced): what ``with_covered`` finds is cut out."""
    found = with_covered(docs, key, text, kind, window, gram, blocks, later_only)
    rest = [c for c in docs.columns if c != text and c not in ("kept", "spans", "n_symbols")]
    inner = {c: f"c{i}" for i, c in enumerate(rest)} | {text: "text"}  # no given name meets one of ours
    wide = found.select("text", "ranges", *[F.col("row").getField(c).alias(inner[c]) for c in rest])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields if f.name != "ranges")
    names = [*(c for c in wide.columns if c != "ranges"), "kept", "spans", "n_symbols"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                kept, spans, n = [], [], []
                for t, covered in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    symbols = split_words(t) if kind == "words" else (t or "").encode("utf-8", "surrogatepass")
                    ranges, left, at = merged(covered), [], 0
                    for a, b in ranges:
                        left.append(symbols[at:a])
                        at = b
                    left.append(symbols[at:])
                    kept.append(b" ".join([w for x in left for w in x]) if kind == "words" else b"".join(left))
                    spans.append([{"a": a, "b": b} for a, b in ranges])
                    n.append(len(symbols))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(n, pa.int64())],
                    names=names)

    done = wide.mapInArrow(work, f"{fields}, kept binary, spans array<struct<a:int,b:int>>, n_symbols long")
    return done.select(*[F.col(inner[c]).alias(c) for c in docs.columns if c in inner], "kept", "spans", "n_symbols")
