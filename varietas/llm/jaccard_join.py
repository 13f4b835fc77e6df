"""Exact Jaccard self-join of word-shingle sets, with set-relation skipping.

Two sets link when ``9 * |difference| <= |x| + |z|`` (Jaccard 0.8 or more).
Rows with one and the same set are one member of the join.

1. Profile (one pass): each document's set size, a 64-bit set id, and a
   parity bitmap of 2 to 4 bits a shingle.  Two bitmaps differ in at most as
   many bits as their sets do in shingles.  The pass also deals all shingles
   out by hash range, packed, and counts them there; those in ``FREQUENT`` or
   more documents are marked in a filter of fixed size.  Unmarked shingles
   come before marked ones and have no list.  Any order gives the same links;
   this one keeps passages and chance repetitions out of the lists.  The filter's size is a
   parameter to raise with the corpus: 2^28 bits serve some 10^8 repeated
   shingles.
2. Index lists: a set is listed under the shingles of its prefix, the first
   ``n - ceil(0.8 n) + 1``, of which linked sets share one.  At the first
   shingle that two linked sets share, their positions add up to a ninth of
   their sizes at most; so of a list, which is cut in two blocks by position,
   the far block need not meet itself, and a list without a near block is
   skipped.  Lists of one set vanish in a pre-aggregation; lists with the
   same least set make one bucket, of whose members each comes once.
3. Buckets (at most ``CELL`` members a task; larger ones are dealt out as
   pairs of hashed blocks): the first member's distance to all others is
   computed; the others' answers derive from it, since distances that differ
   by more than the allowed one rule a link out without a comparison.  Sets
   already joined are not compared again.  What remains is a forest of likely
   links, plus the doubtful ones.
4. Those are verified on the whole sets.  The first round counts on links that
   look well inside, and takes ``doubts`` doubtful ones of a set at most.  A
   bucket where more are left, or where a link counted on was refuted, is gone
   through again with what is known.  Further rounds count on nothing that is
   not verified, so a refuted link asks for no other round, and take ``MORE``
   times as many links of a set each, until none is left out: some
   ``log(2 * cell / doubts) / log(MORE)`` rounds at most.  Then all links
   between different components have been seen.

The links found join the same components as all links; the number of all
links, which grows with the square of a group, is not listed.  Shingles are
compared by 64-bit hashes.

Defined results: a null, empty or blank text has no shingles and is linked
with nothing; fewer than ``words`` words make one shingle; a text of any
length is read whole; repeated rows have a row each and belong together; a
null key counts as larger than any other for ``component_id``; an empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import (Words, chunks, gram_hashes, mix, ship_by_value, small_batches,
                                 starts_of, table, written)
from varietas.llm.graph import components

WORDS, CELL, DOUBTS, MORE = 5, 2048, 64, 8
# Shingles of this many documents are frequent; a task sends its shingles on
# whenever it holds HELD of them.
FREQUENT, HELD = 2, 1 << 21
# Sizes of the membership filters in bits, as powers of two, and of the slices
# in which they travel, in bytes.
FREQUENT_BITS, FILTER_BITS, SLICE = 28, 24, 1 << 14
PROFILE = "kind int, doc bigint, sid bigint, n bigint, data binary"
CELLS = ("lo bigint, i int, j int, kind int, sid bigint, rep bigint, n bigint, data binary, "
         "other bigint")
# ``sure`` links have been counted on.  A row without z: set x has a link that
# had to wait for another round.
EDGES = "lo bigint, i int, j int, x bigint, xr bigint, z bigint, zr bigint, sure boolean"


def white_words() -> Words:
    """Words are what stands between ASCII white space."""
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return Words(inside)


def shingle_sets(texts: list[bytes], words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = words.hashes(texts)
    grams = gram_hashes(h, k)
    for a, n in zip(starts_of(counts).tolist(), counts.tolist()):
        if n >= k:
            yield np.unique(grams[a:a + n - k + 1])
        elif n:
            yield gram_hashes(h[a:a + n], n)
        else:
            yield h[:0]


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of ``2^b >= 2 n`` bits: sets
    with a Jaccard below 0.77 or so differ in more bits than linked ones may."""
    size = 1 << max(6, int(2 * len(s) - 1).bit_length())
    counts = np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(bool), bitorder="little")


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


class Bits:
    """Membership filter of fixed size: all members pass, and others by
    chance, which costs work and changes no result."""

    def __init__(self, power: int):
        self.power, self.bits = power, np.zeros((1 << power) // 8, np.uint8)

    def places(self, values: np.ndarray) -> np.ndarray:
        return (mix(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.power)).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        self.set(self.places(values))

    def has(self, values: np.ndarray) -> np.ndarray:
        return self.at(self.places(values))

    def set(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def slices(self, kind: int | None = None) -> pa.RecordBatch:
        rows = self.bits.reshape(-1, SLICE)
        used = np.flatnonzero(rows.any(axis=1))
        columns = {"n": pa.array(used, pa.int64()),
                   "data": pa.array([rows[u].tobytes() for u in used], pa.binary())}
        if kind is not None:
            columns = {"kind": pa.array(np.full(len(used), kind), pa.int32()),
                       "doc": pa.nulls(len(used), pa.int64()), "sid": pa.nulls(len(used), pa.int64()),
                       **columns}
        return pa.RecordBatch.from_pydict(columns)

    @classmethod
    def gathered(cls, power: int, slices: DataFrame) -> "Bits":
        """The union of slices ``n, data`` of many tasks.  Equal slices are
        united first, so no more than the filter's own size is fetched, and in
        a few jobs however many tasks there were."""
        out = cls(power)
        rows = out.bits.reshape(-1, SLICE)
        united = slices.select("n", "data").repartition("n").mapInArrow(one_of_each, "n bigint, data binary")
        for r in united.toLocalIterator():
            rows[r.n] |= np.frombuffer(bytes(r.data), np.uint8)
        return out


def one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of the slices of each number: a filter's size at most."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            bits = np.frombuffer(data, np.uint8)
            found[n] = found[n] | bits if n in found else bits
    for n, bits in found.items():
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()),
                                          "data": pa.array([bits.tobytes()], pa.binary())})


def packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def short_form(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range (``2^ranges`` of them) and the next 32 bits."""
    return ((h >> np.uint64(64 - ranges)).astype(np.int64),
            (h >> np.uint64(32 - ranges)).astype(np.uint32))


def profile(k: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = white_words()
        held: list[np.ndarray] = []
        waiting = 0

        def dealt() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            which, rest = short_form(h, ranges)
            cuts = np.searchsorted(which, np.arange((1 << ranges) + 1))
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_pydict({
                "kind": pa.array(np.ones(len(used)), pa.int32()),
                "doc": pa.nulls(len(used), pa.int64()), "sid": pa.nulls(len(used), pa.int64()),
                "n": pa.array(used, pa.int64()),
                "data": pa.array([packed(rest[cuts[u]:cuts[u + 1]]) for u in used], pa.binary())})

        for batch, texts in chunks(batches, "text"):
            sids, ns, maps = [], [], []
            for s in shingle_sets(texts, words, k):
                sids.append(set_id(s) if len(s) else None)
                ns.append(len(s))
                maps.append(parity_bitmap(s).tobytes() if len(s) else None)
                held.append(s)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.zeros(len(ns)), pa.int32()), "doc": batch.column("doc"),
                "sid": pa.array(sids, pa.int64()), "n": pa.array(ns, pa.int64()),
                "data": pa.array(maps, pa.binary())})
            waiting += sum(ns)
            if waiting >= HELD:
                yield dealt()
                held, waiting = [], 0
        if waiting:
            yield dealt()

    return run


def tallied(ranges: int):
    """Passes profiles on; counts the shingles of each hash range, which come
    together, and marks the frequent ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Bits(FREQUENT_BITS)
        current, parts = None, []

        def count() -> None:
            rest = np.sort(np.concatenate(parts))
            often = rest[FREQUENT - 1:][rest[FREQUENT - 1:] == rest[:len(rest) - FREQUENT + 1]]
            # a hash range is a run of the filter, so tasks mark apart
            marked.set(((current << 32) | np.unique(often).astype(np.int64)) >> (ranges + 32 - FREQUENT_BITS))

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kinds == 0))
            own = batch.filter(pa.array(kinds == 1))
            for n, data in zip(own.column("n").to_pylist(), own.column("data").to_pylist()):
                if n != current:
                    if parts:
                        count()
                    current, parts = n, []
                parts.append(unpacked(data))
        if parts:
            count()
        yield marked.slices(2)

    return run


def or_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a partition as slices of a membership filter."""
    found = Bits(FILTER_BITS)
    for batch in batches:
        found.add(batch.column("value").to_numpy())
    yield found.slices()


def membership(values: DataFrame) -> Bits:
    """Filter over the column ``value``."""
    return Bits.gathered(FILTER_BITS, values.select("value").mapInArrow(
        or_slices, "n bigint, data binary"))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def listed(k: int, marked: Bits, wanted: Bits | None):
    """The index entries of every set, once a task: shingle, set, whether its
    position is in the near block, and how many entries the set has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = white_words(), set()
        for _, texts in chunks(batches, "text"):
            tokens, sids, near, many = [], [], [], []
            for s in shingle_sets(texts, words, k):
                if not len(s) or (sid := set_id(s)) in done:
                    continue
                done.add(sid)
                p = prefix_length(len(s))
                often = marked.at((s >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64))
                # a shingle of one document lists one set: it takes its place
                # in the order, but needs no entry
                alone = min(p, int(np.count_nonzero(~often)))
                first = s[often][:p - alone]
                # positions of a linked pair add up to (|x| + |z|) / 9 at most
                close = np.arange(alone, p) * 8 <= len(s)
                if wanted is not None:
                    keep = wanted.has(signed(first))
                    first, close = first[keep], close[keep]
                tokens.append(signed(first))
                sids.append(np.full(len(first), sid))
                near.append(close)
                many.append(np.full(len(first), len(first)))
            if tokens:
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate(tokens), pa.int64()),
                    "sid": pa.array(np.concatenate(sids), pa.int64()),
                    "near": pa.array(np.concatenate(near), pa.bool_()),
                    "many": pa.array(np.concatenate(many), pa.int32())})

    return run


class Cell:
    """The members of a bucket, or of two of its blocks."""

    def __init__(self, members: list[tuple[int, int, int, bytes]], known: list[tuple[int, int, bool]]):
        members.sort(key=lambda m: (m[2], m[0]))
        self.sids = [m[0] for m in members]
        self.reps = [m[1] for m in members]
        self.n = np.array([m[2] for m in members], np.int64)
        self.maps = [np.frombuffer(m[3], np.uint8) for m in members]
        self.parent = list(range(len(members)))
        self.refuted: dict[int, set[int]] = {}
        self.waiting: list[int] = []
        at = {s: i for i, s in enumerate(self.sids)}
        for x, z, linked in known:
            if linked:
                self.join(at[x], at[z])
            else:
                self.refuted.setdefault(max(at[x], at[z]), set()).add(min(at[x], at[z]))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)

    def folded(self, i: int, size: int) -> np.ndarray:
        m = self.maps[i]
        while len(m) > size:
            half = len(m) // 2
            m = m[:half] ^ m[half:]
        return m.view(np.uint64)

    def likely(self, doubts: int, trusting: bool) -> list[tuple[int, int, bool]]:
        """Links that the bitmaps allow, and whether they are counted on: a
        forest of those well inside, if ``trusting``, and up to ``doubts``
        others a set; ``waiting`` has the ends of what is left."""
        count = len(self.n)
        if count == 2:
            return self.only_pair()
        found: list[tuple[int, int, bool]] = []
        over: list[tuple[int, np.ndarray]] = []
        sizes = np.array([len(m) for m in self.maps])
        # bitmaps of each width, of the members that have it or twice of it
        at_width = {w: (np.flatnonzero((sizes == w) | (sizes == 2 * w))) for w in set(sizes.tolist())}
        matrix = {w: np.stack([self.folded(i, w) for i in rows]) for w, rows in at_width.items()}
        # distances to the first member of a width bound all others'
        leads = {w: np.bitwise_count(m ^ m[0]).sum(axis=1, dtype=np.int64) for w, m in matrix.items()}
        roots = np.array([self.root(i) for i in range(count)])
        least = np.searchsorted(self.n, -(-4 * self.n // 5))
        for x in range(1, count):
            w_x = int(sizes[x])
            best: list[tuple[int, int]] = []  # (distance, other)
            for w in (w_x, w_x // 2):
                if w not in matrix:
                    continue
                rows = at_width[w]
                lo, hi = np.searchsorted(rows, (least[x], x))
                if lo >= hi:
                    continue
                me = int(np.searchsorted(rows, x))
                others = rows[lo:hi]
                allowed = (self.n[x] + self.n[others]) // 9
                pick = (roots[others] != roots[x]) & (np.abs(leads[w][lo:hi] - leads[w][me]) <= allowed)
                if w != w_x:
                    pick &= sizes[others] == w
                if not pick.any():
                    continue
                others, allowed = others[pick], allowed[pick]
                d = np.bitwise_count(matrix[w][lo:hi][pick] ^ matrix[w][me]).sum(axis=1, dtype=np.int64)
                ok = d <= allowed
                for dist, room, z in zip(d[ok].tolist(), allowed[ok].tolist(), others[ok].tolist()):
                    if z not in self.refuted.get(x, ()):
                        best.append((dist * 1024 // max(room, 1), z))
            best.sort()
            left, later = doubts, []
            for ratio, z in best:
                if roots[z] == roots[x]:
                    continue
                if trusting and ratio <= 900:  # well inside: counts as joined until refuted
                    found.append((x, z, True))
                    roots[roots == roots[x]] = roots[z]
                elif left:  # in doubt: verified, not counted on
                    found.append((x, z, False))
                    left -= 1
                else:
                    later.append(z)
            if later:
                over.append((x, np.array(later)))
        ends: set[int] = set()
        for x, later in over:  # what has been joined since has no need to wait
            later = later[roots[later] != roots[x]]
            if len(later):
                ends.update(later.tolist(), [x])
        self.waiting = sorted(ends)
        return found

    def only_pair(self) -> list[tuple[int, int, bool]]:
        a, b = self.n.tolist()
        if 5 * a < 4 * b or self.root(0) == self.root(1) or self.refuted:
            return []
        size = min(len(m) for m in self.maps)
        d = int(np.bitwise_count(self.folded(0, size) ^ self.folded(1, size)).sum())
        return [(1, 0, False)] if 9 * d <= a + b else []


def searched(doubts: int, trusting: bool):
    """Likely links of every cell; rows come sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, known = None, [], []
        names = [f.split()[0] for f in EDGES.split(", ")]

        def solved() -> pa.RecordBatch | None:
            if key is None or len(members) < 2:
                return None
            cell = Cell(members, known)
            out = [(*key, cell.sids[x], cell.reps[x], cell.sids[z], cell.reps[z], sure)
                   for x, z, sure in cell.likely(doubts, trusting)]
            out += [(*key, cell.sids[x], cell.reps[x], None, None, False) for x in cell.waiting]
            if not out:
                return None
            kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 4 + [pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in
                       ("lo", "i", "j", "kind", "sid", "rep", "n", "data", "other")]
            for lo, i, j, kind, sid, rep, n, data, other in zip(*columns):
                if (lo, i, j) != key:
                    out = solved()
                    if out is not None:
                        yield out
                    key, members, known = (lo, i, j), [], []
                if kind == 0:
                    members.append((sid, rep, n, data))
                else:
                    known.append((sid, other, kind == 2))
        out = solved()
        if out is not None:
            yield out

    return run


def sets_in(wanted: Bits):
    """Profiles of the sets asked for, which spares the others a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.has(batch.column("sid").to_numpy(zero_copy_only=False))))

    return run


def whole_sets(k: int, wanted: Bits):
    """Sets of the documents asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = white_words()
        for batch, texts in chunks(batches, "text"):
            out = [[], [], []]
            for doc, s in zip(batch.column("doc").to_pylist(), shingle_sets(texts, words, k)):
                if len(s):
                    sid = set_id(s)
                    if wanted.has(np.array([sid ^ (doc or 0)]))[0]:
                        out[0].append(sid)
                        out[1].append(doc)
                        out[2].append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.binary())], ["sid", "rep", "body"])

    return run


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lo", "i", "j", "x", "z", "sure"]
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("body").to_pylist(), batch.column("other_body").to_pylist()):
            both = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"),
                                      assume_unique=True))
            linked.append(180 * both >= 80 * (len(a) // 8 + len(b) // 8))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in names] + [pa.array(linked, pa.bool_())], [*names, "linked"])


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                       words: int = WORDS, cell: int = CELL, doubts: int = DOUBTS) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` and ``component_id``, the least key
    among the rows that its links reach."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"),
                       F.col(text).cast("binary").alias("text"))
    ranges = min(14, max(9, (4 * parts - 1).bit_length()))
    profiles = written(
        rows.mapInArrow(profile(words, ranges), PROFILE)
        .repartition(parts, F.when(F.col("kind") == 1, F.col("n")).otherwise(F.xxhash64("doc", "sid")))
        .sortWithinPartitions("kind", F.when(F.col("kind") == 1, F.col("n")))
        .mapInArrow(tallied(ranges), PROFILE), "profiles")
    sets = profiles.where("kind = 0")
    classes = sets.where("sid is not null").groupBy("sid").agg(F.min("doc").alias("rep"))
    marked = Bits.gathered(FREQUENT_BITS, profiles.where("kind = 2"))

    entries = "token bigint, sid bigint, near boolean, many int"
    texts = rows.select("text")
    lists = texts.mapInArrow(listed(words, marked, None), entries) \
        .groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"),
                              F.max("near").alias("near")) \
        .where("lo <> hi and near").select(F.col("token").alias("value"))
    common = membership(lists)
    index = written(texts.mapInArrow(listed(words, marked, common), entries)
                    .select("token", "sid", "many"), "index")
    leaders = index.groupBy("token").agg(
        F.max(F.struct("many", "sid")).alias("lead"), F.min("sid").alias("lo"), F.max("sid").alias("hi")) \
        .where("lo <> hi").select("token", F.col("lead.sid").alias("lo"))
    bucket = written(index.select("token", "sid").join(leaders, "token")
                     .select("lo", "sid").distinct(), "buckets")

    blocks = bucket.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("blocks"))
    placed = written(bucket.join(blocks, "lo").withColumn(
        "own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        .withColumn("c", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda b: F.struct(F.least("own", b).alias("i"), F.greatest("own", b).alias("j")))))
        .select("lo", "c.i", "c.j", "sid"), "placed")

    def with_maps(places: DataFrame, owners: DataFrame) -> DataFrame:
        maps = owners.groupBy("sid").agg(
            F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("data").alias("data"))
        return places.join(maps, "sid").select(
            "lo", "i", "j", F.lit(0).alias("kind"), "sid", "rep", "n", "data",
            F.lit(None).cast("bigint").alias("other"))

    def search(found: DataFrame, doubts: int, trusting: bool) -> DataFrame:
        dealt = found.repartition(parts, "lo", "i", "j").sortWithinPartitions("lo", "i", "j", "kind")
        return written(dealt.mapInArrow(searched(doubts, trusting), EDGES), "likely")

    with_sets = sets.where("sid is not null")
    likely = search(with_maps(placed, with_sets), doubts, True)
    # later rounds only meet sets that are linked or waiting here
    ends = likely.select(F.col("x").alias("sid"), F.col("xr").alias("rep")).unionByName(
        likely.where("z is not null").select(F.col("z").alias("sid"), F.col("zr").alias("rep")))
    asked = membership(ends.select(F.col("sid").bitwiseXOR(
        F.coalesce("rep", F.lit(0))).alias("value")))
    bodies = written(rows.mapInArrow(whole_sets(words, asked), "sid bigint, rep bigint, body binary"),
                     "sets")
    one = bodies.select("sid", F.coalesce("rep", F.lit(0)).alias("rep"), "body")

    def verify(edges: DataFrame) -> DataFrame:
        left = one.select(F.col("sid").alias("x"), F.col("rep").alias("xr"), "body")
        right = one.select(F.col("sid").alias("z"), F.col("rep").alias("zr"),
                           F.col("body").alias("other_body"))
        pairs = edges.where("z is not null").withColumn("xr", F.coalesce("xr", F.lit(0))) \
            .withColumn("zr", F.coalesce("zr", F.lit(0))) \
            .join(left, ["x", "xr"]).join(right, ["z", "zr"]) \
            .select("lo", "i", "j", "x", "z", "sure", "body", "other_body")
        return written(pairs.mapInArrow(verified, (
            "lo bigint, i int, j int, x bigint, z bigint, sure boolean, linked boolean")).distinct(),
            "verified")

    known = verify(likely)

    def unsettled(edges: DataFrame, answers: DataFrame) -> DataFrame:
        """Cells with waiting links, or that counted on a refuted one."""
        cells = answers.where("sure and not linked").select("lo", "i", "j")
        return cells.unionByName(edges.where("z is null").select("lo", "i", "j")).distinct()

    again = unsettled(likely, known)
    while again.take(1):
        doubts *= MORE
        told = known.join(again, ["lo", "i", "j"], "left_semi").select(
            "lo", "i", "j", F.when(F.col("linked"), 2).otherwise(1).alias("kind"),
            F.col("x").alias("sid"), F.lit(None).cast("bigint").alias("rep"),
            F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("data"),
            F.col("z").alias("other"))
        places = written(placed.join(again, ["lo", "i", "j"], "left_semi"), "places")
        wanted = membership(places.select(F.col("sid").alias("value")))
        likely = search(with_maps(places, with_sets.mapInArrow(sets_in(wanted), PROFILE))
                        .unionByName(told), doubts, False)
        new = verify(likely)
        known = written(known.unionByName(new), "known")
        again = unsettled(likely, new)
    roots = components(known.where("linked").select(F.col("x").alias("u"), F.col("z").alias("v")))

    least = classes.join(roots, classes.sid == roots.node, "left") \
        .select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    of_root = least.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = least.select("sid", "root").join(of_root, "root").select("sid", "component")
    return sets.select("doc", "sid", "n").join(of_class, "sid", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') g
  from w, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id x, b.doc_id z, count(*) c from s a join s b using (g)
  where a.doc_id < b.doc_id group by 1, 2),
l as (select x, z from c join n p on p.doc_id = x join n q on q.doc_id = z
  where 100 * c >= 80 * (p.n + q.n - c)),
e as (select x, z from l union all select z, x from l),
r(x, z) as (select doc_id, doc_id from documents union select r.x, e.z from r join e on e.x = r.z)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id
from (select x doc_id, min(z) component_id from r group by x) left join n using (doc_id)
"""

ship_by_value(__name__)
