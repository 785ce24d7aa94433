"""Operator 7: n-gram Jaccard join by vertical partitioning.

Every document is a set of shingles; the global shingle order is the order of their
64-bit names, which needs no counting pass and is even whatever the words are.

Candidates. The order is cut into F fragments, about a quarter more than the differences that a
linked pair of a size band can have. A set emits one key per fragment (band, fragment, name of the
segment); pairs meet only in a group of equal keys. Of its keys a set needs as many as it can have
differences with a partner of the band, and one more: those that the fewest classes have, in an order
that is the same for all sets. Of the keys that a linked pair shares, the first in that order comes
after keys that only one of them has, so both sets keep it. Keys that many classes have (a common line
or passage, a short segment) are thus left out, and a set with enough keys of its own meets nobody.
Empty segments come last in the order, and only a set that has too few others emits them. Sets
smaller than any difference allows link with equal sets only.

Overlaps. For a candidate pair the order is cut into ``PARTS`` vertical fragments; the
overlap of each is counted separately and summed per pair, and the pair links if
100 * intersection >= threshold * union.

Groups. Equal sets form one class first. A pair of a group is verified only if the odd
sketches of both sets (parities of hashed shingle counts; their Hamming distance never
exceeds the number of differences) leave a link possible and it would join two components.
First every member meets its group's smallest class, one partner per member and round, with
components updated in between; then the groups that still hold several components compare
all their members' sketches inside tasks (large groups in pairs of blocks of ``BLOCK``
members). Each member has its possible partners in a fixed order and is verified with the
next few of them per round (``TURNS``), components updated in between: most possible pairs
are links, so a group is one component after few rounds. The last round takes all that
remain, so no link that could change a component is lost, and a group of thousands of near
copies costs a few rows per member. Keys are
dealt by range of (key, class), so a hot key spreads over many tasks; copies are combined
in the tasks that read them.

Defined results: null or empty texts have an empty set and link with nothing; texts with
fewer words than a shingle are one shingle; rows with a null id get a null component and
link with nothing; repeated rows are one class; rows that share an id but not the set are
linked by their sets alone; an empty table gives an empty result; extra columns are ignored.
Shingles are compared by 64-bit names.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from feedlake.llm.common import give_back, materialize, remove, scratch, slices, write
from feedlake.llm.components import components
from feedlake.llm.repeats import _WordNames, _mix

ROUNDS = 1     # rounds with one partner per member, before the rest is verified at once
TURNS = ((0, 1), (1, 9), (9, 73), (73, 585), (585, None))  # a member's possible partners [first, last) of each round
PARTS = 4      # vertical fragments in which overlaps are counted
BLOCK = 2048   # members of a group whose sketches one task compares
SKETCH = 4096  # most bits of an odd sketch
_NAMES = _WordNames()
REMEMBERED = 50_000  # words whose names a worker keeps between texts
SLACK = 1     # identical fragments beyond the first that the cut guarantees, at least
SPARE = 4     # and one more for so many differences: as many keys of a set can be left out
BAND = 63     # bits of a key that name its band
EMPTY = 64    # bit of the key of an empty segment
BITS = 25     # log2 of the bits of the filter on wanted ids: at most 2^(BITS - 6) words of 64 bits are broadcast


def _distinct(names: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: a hash table costs more at this size)."""
    names = np.sort(names)
    return names[np.concatenate([[True], names[1:] != names[:-1]])]


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted distinct names of the shingles of a whole text, A-Z lower-cased."""
    if len(_NAMES) > REMEMBERED:
        _NAMES.clear()
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    names = np.fromiter(map(_NAMES.__getitem__, found), dtype=np.uint64, count=len(found))
    if not len(names):
        return names
    if len(names) < words:
        out = np.full(1, len(names), dtype=np.uint64)
        for i in range(len(names)):
            out = _mix(out, names[i : i + 1])
        return out
    out = names[: len(names) - words + 1]
    for i in range(1, words):
        out = _mix(out, names[i : len(names) - words + 1 + i])
    return _distinct(out)


class Bands:
    """Size bands [low, high] with the number of fragments that their linked pairs need."""

    def __init__(self, threshold: int):
        self.threshold, self.high = threshold, [8]
        while self.high[-1] < 1 << 40:
            self.high.append(self.high[-1] * 3 // 2 + 1)

    def fragments(self, band: int) -> int:
        """Differences of a linked pair of at most ``high`` shingles each, and some more; 0: equal sets only."""
        d = 2 * self.high[band] * (100 - self.threshold) // (100 + self.threshold)
        return d + 1 + max(SLACK, d // SPARE) if d else 0

    def needed(self, band: int, n: int) -> int:
        """Keys of which one is shared with any linked set of the band: the most differences from it, and one more."""
        return most_differences(n, min(self.high[band], n * 100 // self.threshold), self.threshold) + 1

    def of(self, n: int) -> range:
        """The set's own band and those of larger partners."""
        return range(bisect_left(self.high, n), bisect_left(self.high, n * 100 // self.threshold) + 1)

    def keys(self, names: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """One key per identical-segment test of a sorted set, and (band, keys beyond those needed)."""
        out, spare = [], []
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(names, names))])
        for band in self.of(len(names)):
            f = self.fragments(band)
            if not f:
                continue
            fragment = ((names >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
            edge = np.searchsorted(fragment, np.arange(f + 1, dtype=np.uint64))
            size = edge[1:] - edge[:-1]
            need, use = self.needed(band, len(names)), np.flatnonzero(size)
            if len(use) < need:
                use = np.arange(f)
            tag = use.astype(np.uint64) | np.uint64(band << 40)
            key = _mix(total[edge[use + 1]] - total[edge[use]], tag) & np.uint64(~(BAND | EMPTY) & (1 << 64) - 1)
            key = _distinct(key | np.uint64(band) | np.where(size[use] == 0, np.uint64(EMPTY), np.uint64(0)))
            out.append(key)
            spare.append((band, len(key) - need))
        return np.concatenate(out) if out else np.empty(0, np.uint64), spare


def set_class(names: np.ndarray) -> int:
    """Signed 64-bit name of a whole set."""
    import xxhash
    value = xxhash.xxh3_64_intdigest(names.tobytes())
    return value - (1 << 64) if value >> 63 else value


def odd_sketch(names: np.ndarray, bits: int) -> bytes:
    """Parity of the number of shingles per bit, packed."""
    return np.packbits((np.bincount((names & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_bits(n: int) -> int:
    """A power of two, about twice the set's size."""
    return min(SKETCH, max(64, 1 << (2 * n - 1).bit_length()))


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketch rows of packed bytes reduced to ``width`` bytes: bit i of the result is the parity of all i + k * 8 * width."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, width), axis=1)


def most_differences(nx, ny, threshold: int):
    return (nx + ny) * (100 - threshold) // (100 + threshold)


def _sets(docs: DataFrame, words: int, threshold: int, remembered: int = 200_000) -> DataFrame:
    """(doc, n, cls, sketch, keys array<long>, spare map<int, int>): one pass over the texts.

    ``spare`` tells by band how many of the set's keys it does not need. A task gives sketch and
    keys of a class once (as far as it remembers), so copies are combined before any shuffle.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(threshold), set()
        for batch in batches:
            for part in slices(batch, 1):
                n, cls, sketch, keys, spare = [], [], [], [], []
                for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    names = shingle_set(text, words)
                    whole = set_class(names)
                    n.append(len(names))
                    cls.append(whole)
                    again = whole in seen or doc is None or not len(names)
                    sketch.append(None if again else odd_sketch(names, sketch_bits(len(names))))
                    own, beyond = (None, None) if again else bands.keys(names)
                    keys.append(None if again else own.view(np.int64))
                    spare.append(beyond)
                    if not again:
                        if len(seen) >= remembered:
                            seen.clear()
                        seen.add(whole)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(spare, pa.map_(pa.int32(), pa.int32()))],
                    names=["doc", "n", "cls", "sketch", "keys", "spare"])
        _NAMES.clear()  # the worker lives on
        give_back()
    return docs.select("doc", "text").mapInArrow(work, "doc long, n long, cls long, sketch binary, keys array<long>, spare map<int, int>")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, cls) of keys that several classes have, from rows in (key, cls) order.

    A key can go on in the next task, so each task also returns its first and last key.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_cls = None
        shared, sent = True, False   # the first key of a task may have begun before it: its rows are returned

        def table(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64())], names=["key", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = (np.asarray(batch.column(i)) for i in (0, 1))
            first = last_key is None
            if not first:  # put the row before in front
                key, cls = np.concatenate([[last_key], key]), np.concatenate([[last_cls], cls])
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, cls = key[new], cls[new]
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            many = np.bincount(group) > 1
            if shared:
                many[0] = True
            take = many[group]
            if not first and len(take):
                take[0] = take[0] and not sent
            shared = bool(many[-1])
            sent = bool(take[-1]) or (len(take) == 1 and not first and sent)
            last_key, last_cls = key[-1], cls[-1]
            yield table(key[take], cls[take])
        if last_key is not None and not sent:
            yield table([last_key], [last_cls])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(n, "key", "cls").sortWithinPartitions("key", "cls")
    return ordered.mapInArrow(work, "key long, cls long").distinct()


def _needed_keys(group: DataFrame, spare: DataFrame) -> DataFrame:
    """``group`` (key, cls) without the keys that a class can spare: those that the most classes have, by band.

    ``spare`` has cls, band, spare. Keys that are not in ``group`` are a class's own and come first
    in the order, so all that it can spare are taken from its rows here. Empty segments go first.
    """
    many = group.groupBy("key").agg(F.count("*").alias("many"))
    common = Window.partitionBy("cls", "band").orderBy(F.col("key").bitwiseAND(F.lit(EMPTY)).desc(), F.col("many").desc(), F.col("key").desc())
    return (group.join(many, "key").withColumn("band", F.col("key").bitwiseAND(F.lit(BAND)).cast("int"))
            .withColumn("at", F.row_number().over(common))
            .join(spare, ["cls", "band"]).where("at > spare").select("key", "cls"))


def _different_groups(group: DataFrame) -> DataFrame:
    """``group`` (key, cls) with one key of those that have the same members.

    Near copies share most of their fragments, so most groups come many times; equal ones
    hold the same pairs. Members are compared by number and two 64-bit sums without carry.
    """
    members = group.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("a"),
                                       F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("b"))
    first = members.where("n > 1").groupBy("n", "a", "b").agg(F.min("key").alias("key"))
    return group.join(first.select("key"), "key", "left_semi")


def _maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc may be in ``wanted`` (doc), found before any shuffle.

    One bit per hashed id, packed into words, is broadcast: a size fixed by ``BITS``,
    whatever the number of ids. No wanted row is lost; an exact join must follow.
    """
    at = F.pmod(F.xxhash64("doc"), F.lit(1 << BITS))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    return (docs.join(F.broadcast(words), word == F.col("_word"))
            .where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1).drop("_word", "_bits"))


def _segments(docs: DataFrame, words: int) -> DataFrame:
    """(cls, part, n, names): the sets of ``docs`` (cls, text) in vertical fragments."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for cls, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    names = shingle_set(text, words)
                    if set_class(names) != cls:  # another row of a repeated id
                        continue
                    edge = np.searchsorted(names >> np.uint64(62), np.arange(PARTS + 1, dtype=np.uint64))
                    rows += [(cls, k, len(names), names[edge[k] : edge[k + 1]].tobytes()) for k in range(PARTS) if edge[k + 1] > edge[k]]
                c = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["cls", "part", "n", "names"])
        _NAMES.clear()  # the worker lives on
        give_back()
    return docs.select("cls", "text").mapInArrow(work, "cls long, part int, n long, names binary")


def linked(pairs: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs`` (x, y) that reach the threshold: overlaps counted per fragment, summed per pair."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                       for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(overlap, pa.int64())], names=["x", "y", "nx", "ny", "part", "overlap"])
        give_back()

    side = lambda s: segments.select(F.col("cls").alias(s), "part", F.col("n").alias(f"n{s}"), F.col("names").alias(f"names_{s}"))
    partial = (pairs.join(side("y"), "y").join(side("x"), ["x", "part"])
               .select("x", "y", "nx", "ny", "part", "names_x", "names_y")
               .mapInArrow(work, "x long, y long, nx long, ny long, part int, overlap long"))
    return (partial.groupBy("x", "y", "nx", "ny", "part").agg(F.max("overlap").alias("overlap"))  # repeated rows count once
            .groupBy("x", "y", "nx", "ny").agg(F.sum("overlap").alias("both"))
            .where(F.col("both") * (100 + threshold) >= threshold * (F.col("nx") + F.col("ny"))).select("x", "y"))


def _possible(pairs: DataFrame, threshold: int) -> DataFrame:
    """The (x, y) of pairs (x, y, nx, ny, sx, sy) whose sketches allow a link."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for nx, ny, a, b in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                a, b = (np.frombuffer(v, np.uint8)[None, :] for v in (a, b))
                width = min(a.shape[1], b.shape[1])
                ok.append(np.bitwise_count(fold(a, width) ^ fold(b, width)).sum() <= most_differences(nx, ny, threshold))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return pairs.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(work, "x long, y long")


def _compare_groups(live: DataFrame, classes: DataFrame, threshold: int, first: int, last: int | None) -> DataFrame:
    """(key, x, y): pairs of members of a group in different components whose sketches allow a link.

    ``live`` has key, cls, base, component; ``base`` is the component before the first
    round; ``classes`` has cls, n, sketch. The partners of a member y are those x < y of other ``base`` components, in
    the order of cls; only partners [first, last) are returned, if their components still
    differ. A row with null x and y says that the group has partners beyond ``last``. A group
    of more than ``BLOCK`` members is dealt to the pairs of its blocks.
    """
    size = live.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (live.join(size, "key").withColumn("own", F.pmod(F.hash("cls"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"),
                     "own", "cls", "base", "component")
             .join(classes.select("cls", "n", "sketch"), "cls")  # sketches are most of a row and are dealt once
             .select("task", "own", "cls", "base", "component", "n", "sketch").repartition("task").sortWithinPartitions("task", "cls"))

    def pairs_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, bool]:
        own, cls, base, comp, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(1, 6))
        mixed, more = rows[0][0]["i"] != rows[0][0]["j"], False
        width = min(len(r[6]) for r in rows)
        bits = np.concatenate([fold(np.frombuffer(r[6], np.uint8)[None, :], width) for r in rows]).view(np.uint64)
        xs, ys = [], []
        for y in range(1, len(rows)):
            x = np.flatnonzero((base[:y] != base[y]) & ((own[:y] != own[y]) | (not mixed)))
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(1)
            x = x[far <= most_differences(n[x], n[y], threshold)]
            more |= last is not None and len(x) > last
            x = x[first:last]
            x = x[comp[x] != comp[y]]
            xs.append(cls[x])
            ys.append(np.full(len(x), cls[y]))
        return np.concatenate(xs or [cls[:0]]), np.concatenate(ys or [cls[:0]]), more

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done():
            x, y, more = pairs_of(held)
            ask = pa.nulls(int(more), pa.int64())
            x, y = (pa.concat_arrays([pa.array(v, pa.int64()), ask]) for v in (x, y))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), held[0][0]["key"]), pa.int64()), x, y], names=["key", "x", "y"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()
        give_back()

    return dealt.mapInArrow(work, "key long, x long, y long")


def set_names(text, words: int):
    """Column: the class of a text, as ``jaccard_groups`` names it."""
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([set_class(shingle_set(x.as_py(), words)) for x in batch], pa.int64())
        _NAMES.clear()  # the worker lives on
        give_back()
    return arrow_udf(work, "long")(text)


def jaccard_groups(docs: DataFrame, threshold: int = 90, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, cls, component) per row of ``docs``.

    component_id is the smallest id reachable by links; cls names the row's set and component
    the smallest such name reachable, so that unlike texts of one id stay apart. Written
    before it returns; the tables of the rounds are removed.
    """
    with scratch(docs.sparkSession) as kept:
        found = materialize(_groups(docs, threshold, words, key, text), "links")
        kept.append(found)
    return found


def _groups(docs: DataFrame, threshold: int, words: int, key: str, text: str) -> DataFrame:
    given = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    spark, path = docs.sparkSession, write(_sets(given, words, threshold), "sets")
    sets = spark.read.parquet(path)
    classes = materialize(sets.where("doc is not null and n > 0").groupBy("cls").agg(
        F.min("doc").alias("doc"), F.max("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
    keys = sets.where("keys is not null").select(F.explode("keys").alias("key"), "cls")
    spare = sets.where("keys is not null").select("cls", F.explode("spare").alias("band", "spare")).distinct()
    group = materialize(_needed_keys(materialize(_shared_keys(keys), "groups"), spare), "groups")
    group = materialize(_different_groups(group), "groups")
    sets = materialize(sets.select("doc", "n", "cls"), "rows")
    remove(spark, path)  # the keys are most of it
    told = lambda c: classes.select(F.col("cls").alias(c), F.col("doc").alias(f"d{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    edges = classes.limit(0).select(F.col("cls").alias("u"), F.col("cls").alias("v"))
    reached = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def of(frame: DataFrame, cls: str, name: str, reached: DataFrame) -> DataFrame:
        to = reached.select(F.col("node").alias(f"_{name}"), F.col("component").alias(f"c_{name}"))
        return frame.join(to, F.col(cls) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"c_{name}", cls)).drop(f"_{name}", f"c_{name}")

    def mixed(state: DataFrame) -> DataFrame:
        return state.groupBy("key").agg(F.min("cls").alias("centre"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "centre")

    def named(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.join(told("x").select("x", "dx"), "x").join(told("y").select("y", "dy"), "y"), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("x").alias("cls"), F.col("dx").alias("doc")).unionByName(pairs.select(F.col("y").alias("cls"), F.col("dy").alias("doc"))).distinct()
        wanted = materialize(wanted, "wanted")
        # candidates grow with the corpus: a sort-merge join at every size, never a broadcast of them
        return materialize(_segments(_maybe(given, wanted).join(wanted.hint("merge"), "doc"), words), "segments")

    def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
        found = linked(pairs.select("x", "y"), segments, threshold)
        return materialize(edges.unionByName(found.select(F.col("x").alias("u"), F.col("y").alias("v"))), "edges")

    # every member with its group's smallest class
    state = of(group, "cls", "component", reached)
    near = state.join(mixed(state), "key").where("cls <> centre").select(F.col("centre").alias("x"), F.col("cls").alias("y")).distinct()
    left = named(_possible(near.join(told("x"), "x").join(told("y"), "y"), threshold))
    if not left.isEmpty():
        with scratch(spark) as stay:
            segments = sets_of(left)
            for turn in range(ROUNDS + 1):
                now = left
                if turn < ROUNDS:  # one partner per member
                    now = materialize(left.groupBy("y").agg(F.min_by(F.struct("x", "dx", "dy"), "x").alias("p")).select("p.x", "y", "p.dx", "p.dy"), "turn")
                edges = verified(now, segments)
                reached = components(edges)
                if turn == ROUNDS:
                    break
                left = left.join(now.select("x", "y"), ["x", "y"], "left_anti")
                left = materialize(of(of(left, "x", "cx", reached), "y", "cy", reached).where("cx <> cy").select("x", "y", "dx", "dy"), "pairs")
                if left.isEmpty():
                    break
            stay += [edges, reached]

    # members with each other, in the groups that still hold several components
    base, open_groups = reached, None
    for first, last in TURNS:
        state = of(group, "cls", "component", reached)
        live = state.join(mixed(state), "key")
        if open_groups is not None:
            live = live.join(open_groups, "key")
        live = of(live, "cls", "base", base).select("key", "cls", "base", "component")
        compared = materialize(_compare_groups(live, classes, threshold, first, last), "compared")
        with scratch(spark) as stay:
            left = named(compared.where("x is not null").select("x", "y").distinct())
            if not left.isEmpty():
                edges = verified(left, sets_of(left))
                reached = components(edges)
                stay += [edges, reached]
        open_groups = compared.where("x is null").select("key").distinct()
        if open_groups.isEmpty():
            break
    named_classes = of(classes.select("cls", "doc"), "cls", "component", reached)
    smallest = named_classes.groupBy("component").agg(F.min("doc").alias("smallest"))
    named_classes = named_classes.select("cls", "component").join(smallest, "component")
    alone = F.col("doc").isNull() | (F.col("n") == 0)
    return (sets.join(named_classes, "cls", "left")
            .select(F.col("doc").alias(key), F.col("n").alias("n_shingles"),
                    F.when(alone, F.col("doc")).otherwise(F.col("smallest")).alias("component_id"), "cls",
                    F.when(~alone, F.col("component")).alias("component")))
