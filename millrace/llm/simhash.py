"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints are 64-bit majority hashes of word shingles. Each is embedded as the
bit counts of its ``SEGMENTS`` segments; the Manhattan distance of two embeddings
is a lower bound of their Hamming distance. The embedding's coordinates are laid
out in ``GROUPS`` groups: within distance ``d`` at least ``GROUPS - d`` groups are
equal, so two fingerprints that link share a grid cell of some choice of
``GROUPS - d`` groups. Cells are joined by equality, the bound is tested over all
coordinates, and what passes is verified bit by bit.

Only distinct fingerprints are joined, so a group of copies is one point. A large
cell is split again, by bits this time (``_split``), so that the work on it is a few
sorts and not all pairs. Within a part, points are taken up breadth first and leave
it when reached: a dense part of ``n`` points gives ``n - 1`` links, never all pairs,
and the same components. Components are the fixed point of alternating large-star and
small-star rounds over written tables; no link reaches the driver.

``alike``, for stages that ask for a similarity of shingle sets, draws its grid
from several such fingerprints, bit by bit, and counts the similarity itself. What
the grid leaves apart is then joined exactly (``missed``): sets of a similarity of 0.8
share a shingle among the rarest fifth of each, and bounds that hold for every pair
leave few to count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Of two bits each.
SEGMENTS = 32
GROUPS = 8
#: For stages that take five words and a Jaccard similarity of 0.8 (4 / 5) or more.
STAGE_WORDS = 5
#: Independent 64-bit fingerprints of a set of shingles.
PRINTS = 4
#: Least bits of a grid cell, drawn from all fingerprints, and sets that a cell of more bits is planned to hold.
CELL_BITS, CELL_SETS = 17, 128
#: Bits of a pair at 0.8 agree with this probability, and such a pair is to share no cell with this one at most.
AGREE, MISSED = 0.85, 0.0015
#: Pairs at 0.8 differ in some 39 of the 256 bits, with a deviation of 6; pairs up to this many are verified. Sets of fewer than ``FEW`` shingles vary more.
NEAR_BITS, FEW, FEW_NEAR_BITS = 54, 32, 80
#: Points of a cell up to this many are compared by sorted neighbourhoods, all cells at once; larger cells one by one.
SMALL_CELL = 8
#: Cells of more points are split by bits.
SPLIT_CELL = 256
#: The same as ``SMALL_CELL``, for cells of sets.
SMALL_SET_CELL = 256
ROUNDS = 60
#: Slots in which the shingles of all texts are counted: tokens are ordered by their slot's count, the rarest first. Any counts give the same links.
SLOT_BITS = 16
#: Least bits of a set's parity, and pairs of one task that are made different from each other at a time.
PARITY_BITS, SOME_PAIRS = 256, 1 << 20
#: Not names that tables have.
KEY, ROW = "_millrace_key", "_millrace_row"


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of the bits of XXH64 over the word shingles of a lower-cased text; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(found)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # memory stays small for the longest texts
        h = np.fromiter(
            (one(whole[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)], strict=True)), np.uint64,
            len(starts[i : i + (1 << 16)])
        )
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for part, texts in work.text_slices(batches):
        bits = np.array([fingerprint(x, words, seed) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "bits": pa.array(bits)})


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lambda it: _fingerprints(it, words, seed), "doc_id long, bits long")


def popcounts(bits: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The embedding: one row per fingerprint, the bit count of each segment."""
    each = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return each.reshape(len(bits), segments, -1).sum(axis=2, dtype=np.int8)


def _cells(batches: Iterator[pa.RecordBatch], groups: int, distance: int, segments: int) -> Iterator[pa.RecordBatch]:
    chosen = list(combinations(range(groups), groups - distance))
    spread = np.random.default_rng(7).integers(0, 2**63, segments, dtype=np.uint64) | np.uint64(1)
    starts = [int(x[0]) for x in np.array_split(np.arange(segments), groups)]
    for batch in batches:
        for at in range(0, len(batch), 4096):
            bits = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = np.add.reduceat(popcounts(bits, segments).astype(np.uint64) * spread, starts, axis=1)
            keys = np.concatenate([_mixed(sum(_mixed(cells[:, g] + np.uint64(g)) for g in pick) + np.uint64(i)) for i, pick in enumerate(chosen)])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(keys.view(np.int64)), "bits": pa.array(np.tile(bits, len(chosen)))})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _near(one: np.ndarray, many: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs link: Manhattan distance of the bit counts first, then the bits themselves."""
    found = np.zeros(len(many), bool)
    # Bit counts of 2-bit segments, packed: a field per segment holds 0 to 2, so the fields' absolute difference is the Manhattan distance.
    low = np.uint64(0x5555555555555555)
    a, b = one.view(np.uint64), many.view(np.uint64)
    pa_, pb = (a & low) + ((a >> np.uint64(1)) & low), (b & low) + ((b >> np.uint64(1)) & low)
    x = pa_ ^ pb
    # Fields 0,1,2 as bits 00,01,10: |difference| is 1 for 01 and 11 (xor), 2 for 10.
    bound = np.bitwise_count(x & low).astype(np.int16) + 2 * np.bitwise_count(((x >> np.uint64(1)) & low) & ~(x & low))
    maybe = np.flatnonzero(bound <= distance)
    a = a[maybe] if len(a) == len(many) else a
    found[maybe] = np.bitwise_count(a ^ b[maybe]) <= distance
    return found


def _parts(mask: np.uint64, n: int) -> list[np.uint64]:
    """The two-bit segments that are set in ``mask``, dealt into ``n`` masks."""
    own = [i for i in range(SEGMENTS) if int(mask) >> (2 * i) & 3]
    return [np.uint64(sum(3 << (2 * i) for i in own[k::n])) for k in range(n)]


def _split(bits: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Sets of places in ``bits``, the points of one cell, that hold each pair within ``distance`` together in one of them.

    Where all points have the same count, a pair can differ only by a swap within a
    segment: two bits. So if ``e`` of these segments differ, the rest differs in
    ``distance - 2 e`` bits at most. Cut the former into ``e + 1`` parts and the rest
    into one more than it can differ in: the pair agrees in one part of each.
    """
    counts = popcounts(bits)
    same = (counts == counts[0]).all(axis=0)
    equal = np.uint64(sum(3 << (2 * i) for i in np.flatnonzero(same).tolist()))
    rest = ~equal
    for e in range(distance // 2 + 1):
        left = distance - 2 * e
        for one in _parts(equal, e + 1) if left else [np.uint64(0)]:
            for two in _parts(rest, left + 1) if e else [np.uint64(0)]:
                key = bits & (one | two)
                order = np.argsort(key, kind="stable")
                key = key[order]
                edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                sizes = np.diff(edges)
                yield from (order[edges[i] : edges[i + 1]] for i in np.flatnonzero(sizes > 1).tolist())


def _reached(bits: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what ``bits`` connect, found breadth first from any point."""
    rest, ready = bits, []
    while len(rest):
        if not ready:
            ready, rest = [rest[:1]], rest[1:]
        point = ready.pop()
        near = _near(point, rest, distance)
        if near.any():
            got = rest[near]
            yield np.repeat(point, len(got)), got
            ready += [got[i : i + 1] for i in range(len(got))]
            rest = rest[~near]


def _links(batches: Iterator[pa.RecordBatch], distance: int, split: bool) -> Iterator[pa.RecordBatch]:
    """Links of a partition that holds whole cells: enough to connect what each cell connects."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    cell, bits = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
    del parts
    order = np.argsort(cell, kind="stable")
    cell, bits = cell[order], bits[order]
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[edges, len(cell)])
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for lag in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[lag:] == cell[:-lag]) & (size_of[lag:] <= SMALL_CELL))
        if len(i):
            i = i[_near(bits[i], bits[i + lag], distance)]
            left.append(bits[i])
            right.append(bits[i + lag])
    for start, n in zip(edges[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        points = bits[start : start + n]
        for some in _split(points.view(np.uint64), distance) if split and n > SPLIT_CELL else [np.arange(n)]:
            for a, b in _reached(points[some], distance):
                left.append(a)
                right.append(b)
    if left:
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})


def links(points: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of distinct ``bits`` that link, and enough of them that components are whole."""
    cells = points.select("bits").mapInArrow(lambda it: _cells(it, groups, distance, segments), "cell long, bits long")
    # By hash of the cell, with the rows of a cell together and unordered; a cell is then 8 bytes a point.
    return cells.repartition(F.col("cell")).mapInArrow(lambda it: _links(it, distance, segments == SEGMENTS), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it reaches."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = work.cut(both)
    for _ in range(ROUNDS):
        # Large star: each node's larger neighbours point to its smallest; small star: a node and its smaller neighbours do.
        every = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.cut(every.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = work.cut(every.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = work.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        ).filter("u <> v").distinct()
        after = work.cut(small)
        if not after.select("u", "v").exceptAll(now.select("u", "v")).take(1) and after.count() == now.count():
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(
        docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED, groups: int = GROUPS, segments: int = SEGMENTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that the row reaches over links. Nulls: a
    null text has no words and, as an empty one, fingerprint zero, which links like
    any other; a null doc_id is passed over when the smallest is taken. Repeated
    rows are equal points. An empty table gives no rows. Other columns are not read.
    """
    base = work.cut(fingerprints(docs, words, seed))
    points = work.cut(base.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    members = work.cut(components(links(points, distance, groups, segments)))
    roots = work.cut(members.join(points, members["node"] == points["bits"]).groupBy("root").agg(F.min("first_id").alias("root_id")))
    named = members.join(roots, "root").select(F.col("node").alias("bits"), "root_id")
    named = work.cut(points.join(named, "bits", "left").select("bits", F.coalesce("root_id", "first_id").alias("component_id")))
    return base.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, words: int = STAGE_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 values of the word shingles of a lower-cased text, in order; a shorter text is one shingle, none without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    n = max(1, len(found) - words + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(words, len(found)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((one(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def set_prints(hashes: np.ndarray) -> np.ndarray:
    """``PRINTS`` majority fingerprints of a set of shingles, each of hashes mixed anew; zeros for the empty set."""
    out = np.zeros(PRINTS, np.uint64)
    if not len(hashes):
        return out
    for k in range(PRINTS):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            h = _mixed(part ^ np.uint64(k << 60)) if k else part
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


PRINT_COLUMNS = [f"w{k}" for k in range(PRINTS)]
SETS = "row long, doc_id long, id long, n int, " + ", ".join(f"{c} long" for c in PRINT_COLUMNS) + ", parity binary, counts binary"


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each slot of two or more a shingle: whether it has an odd number of them. Sets differ in as many shingles as parities in bits, at least."""
    bits = max(PARITY_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(one: bytes, two: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the shorter one's slots."""
    if len(one) < len(two):
        one, two = two, one
    x, n = int.from_bytes(one, "little"), len(one)
    while n > len(two):
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return (x ^ int.from_bytes(two, "little")).bit_count()


def _sets(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, and a last one without ids: how often the task's shingles fall into each slot."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), *((c, pa.int64()) for c in PRINT_COLUMNS),
         ("parity", pa.binary()), ("counts", pa.binary())]
    )
    for part, texts in work.text_slices(batches):
        ids, sizes, prints, parities = [], [], [], []
        for x in texts:
            hashes = shingle_set(x, seed=seed)
            ids.append(set_id(hashes))
            sizes.append(len(hashes))
            prints.append(set_prints(hashes))
            parities.append(parity(hashes))
            np.add.at(counts, (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        words = np.array(prints, np.uint64).reshape(-1, PRINTS).view(np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "row": part.column(0), "doc_id": part.column(1), "id": pa.array(np.array(ids, np.uint64).view(np.int64)),
                "n": pa.array(np.array(sizes, np.int32)), **{c: pa.array(words[:, k].copy()) for k, c in enumerate(PRINT_COLUMNS)},
                "parity": pa.array(parities, pa.binary()), "counts": pa.nulls(len(texts), pa.binary())
            }, schema
        )
    if counts.any():
        yield pa.RecordBatch.from_pylist([{"counts": counts.tobytes()}], schema)


def _shingles(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for part, texts in work.text_slices(batches):
        yield pa.RecordBatch.from_pydict(
            {"id": part.column(0), "hashes": pa.array([shingle_set(x, seed=seed).view(np.int64) for x in texts], pa.list_(pa.int64()))}
        )


def grid(sets: int) -> tuple[int, int]:
    """(cells of a set, bits of a cell) for so many sets: cells keep their size, and a pair at 0.8 its chance to share one."""
    bits = max(CELL_BITS, math.ceil(math.log2(max(1, sets) / CELL_SETS)))
    return math.ceil(math.log(MISSED) / math.log(1 - AGREE**bits)), bits


def cell_keys(words: np.ndarray, cells: int, cell_bits: int) -> np.ndarray:
    """The cells of sets with fingerprints ``words``, a row each: ``cells`` columns, each its own ``cell_bits`` bits."""
    rng = np.random.default_rng(7)
    kind = np.float32 if cell_bits < 24 else np.float64  # sums are exact
    pick = np.zeros((64 * PRINTS, cells), kind)
    for i in range(cells):
        pick[rng.choice(64 * PRINTS, cell_bits, replace=False), i] = 2.0 ** np.arange(cell_bits)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return (bits.astype(kind) @ pick).astype(np.int64) + (np.arange(cells, dtype=np.int64) << cell_bits)


def _set_cells(batches: Iterator[pa.RecordBatch], cells: int, cell_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            columns = {c: part.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(part.schema.names)}
            keys = cell_keys(np.stack([columns[c] for c in PRINT_COLUMNS], axis=1), cells, cell_bits)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(keys.T.reshape(-1)), **{c: pa.array(np.tile(x, cells)) for c, x in columns.items()}})


def _apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits that pairs of sets (rows: n, fingerprints) differ in, or -1 where size or bits rule out a similarity of 0.8."""
    n, m = one[..., 0], many[..., 0]
    most = np.maximum(n, m)
    found = np.full(len(many), -1, np.int64)
    at = np.flatnonzero(5 * np.minimum(n, m) >= 4 * most)
    bits = np.bitwise_count(
        (one[at] if one.ndim == 2 else one)[..., 1:].view(np.uint64) ^ many[at][:, 1:].view(np.uint64)
    ).sum(axis=1, dtype=np.int64)
    found[at] = np.where(bits <= np.where(most[at] < FEW, FEW_NEAR_BITS, NEAR_BITS), bits, -1)
    return found


def _forest(left: np.ndarray, right: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that span what they connect with fewest bits."""
    root: dict[int, int] = {}
    order = np.argsort(bits, kind="stable")
    left, right = left[order], right[order]
    kept = np.zeros(len(left), bool)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while (x := root.get(a, a)) != a:
            root[a] = a = root.get(x, x)
        while (x := root.get(b, b)) != b:
            root[b] = b = root.get(x, x)
        if a != b:
            root[a], kept[k] = b, True
    return left[kept], right[kept]


def _spanning(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell: a spanning forest of fewest differing bits, found from any point outward."""
    best, by = np.full(len(points), 1 << 30), np.zeros(len(points), np.int64)
    left, right, rest, at = [], [], np.arange(1, len(points)), 0
    while len(rest):
        d = _apart(points[at], points[rest])
        nearer = (d >= 0) & (d < best[rest])
        best[rest[nearer]], by[rest[nearer]] = d[nearer], at
        k = int(np.argmin(best[rest]))
        at = int(rest[k])
        if best[at] < 1 << 30:
            left.append(int(by[at]))
            right.append(at)
        rest = np.delete(rest, k)
    return np.array(left, np.int64), np.array(right, np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets to verify, of a partition that holds whole cells: of each cell the spanning forest of fewest differing bits."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1) for b in batches if len(b)]
    if not parts:
        return
    rows = np.concatenate(parts)
    del parts
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]  # ties between pairs fall alike in each run
    cell, ids, points = rows[:, 0], rows[:, 1], rows[:, 2:]
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[edges, len(cell)])
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL_SET_CELL)
    none = np.zeros(0, np.int64)
    left, right, bits = [none], [none], [none]
    for lag in range(1, SMALL_SET_CELL):
        small = small[small < len(cell) - lag]
        small = small[cell[small + lag] == cell[small]]
        if not len(small):
            break
        for i in np.array_split(small, len(small) // (1 << 16) + 1):
            d = _apart(points[i], points[i + lag])
            left.append(i[d >= 0])
            right.append(left[-1] + lag)
            bits.append(d[d >= 0])
    left, right = _forest(*map(np.concatenate, (left, right, bits)))
    left, right = [left], [right]
    for start, n in zip(edges[sizes > SMALL_SET_CELL].tolist(), sizes[sizes > SMALL_SET_CELL].tolist(), strict=True):
        i, j = _spanning(points[start : start + n])
        left.append(start + i)
        right.append(start + j)
    a, b = ids[np.concatenate(left)], ids[np.concatenate(right)]
    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def candidates(points: DataFrame) -> DataFrame:
    """(a, b): pairs of ``points`` (id, n, fingerprints) that share a cell and may be alike, each once; the same in each run."""
    n = points.count()
    columns, (each, bits) = ["id", "n", *PRINT_COLUMNS], grid(n)
    cells = work.in_python(
        points.select(*columns), lambda it: _set_cells(it, each, bits), "cell long, id long, n int, " + ", ".join(f"{c} long" for c in PRINT_COLUMNS)
    )
    # The forest is one over the cells of a partition, so which those are must follow from the rows alone.
    parts = max(work.MIN_PARTS, min(n * each // work.PART, work.MOST_PARTS))
    return work.in_python(cells.repartition(parts, "cell"), _candidates, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` whose sets have a Jaccard similarity of 0.8 or more, counted over the sets themselves."""
    one, two = sets.select(F.col("id").alias("a"), F.col("hashes").alias("_one")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("_two"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("_one", "_two"))
    return both.filter(9 * shared >= 4 * (F.size("_one") + F.size("_two"))).select("a", "b")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def slot_ranks(base: DataFrame) -> np.ndarray:
    """The rank of each slot by its count in all of ``base``; eight sums of half a megabyte reach the driver."""
    counts = base.filter("counts is not null").select("counts").mapInArrow(_summed, "counts binary").repartition(8).mapInArrow(_summed, "counts binary")
    total = sum((np.frombuffer(r["counts"], np.int64) for r in counts.collect()), np.zeros(1 << SLOT_BITS, np.int64))
    ranks = np.empty(1 << SLOT_BITS, np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    return ranks


def prefix(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, renamed so that rare slots come first: one more than a set can lack of another at 0.8, which shares one of them."""
    if not len(hashes):
        return hashes
    rest = np.uint64(64 - SLOT_BITS)
    tokens = (ranks[(hashes >> rest).astype(np.int64)] << rest) | (hashes & np.uint64((1 << (64 - SLOT_BITS)) - 1))
    most = len(hashes) - -(-4 * len(hashes) // 5) + 1
    return np.sort(np.partition(tokens, most - 1)[:most])


def _prefixes(batches: Iterator[pa.RecordBatch], seed: int, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, texts in work.text_slices(batches):
        sets = [shingle_set(x, seed=seed) for x in texts]
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.array(np.array([set_id(x) for x in sets], np.uint64).view(np.int64)), "n": pa.array([len(x) for x in sets], pa.int32()),
                "tokens": pa.array([prefix(x, ranks).view(np.int64) for x in sets], pa.list_(pa.int64()))
            }
        )


def _meeting(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether sets (rows: id, root, n, place of the token) of different roots can be at 0.8 if the token is the first that they share."""
    n, m = one[..., 2], many[..., 2]
    room = 1 + np.minimum(n - 1 - one[..., 3], m - 1 - many[..., 3])
    return (one[..., 1] != many[..., 1]) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * room >= 4 * (n + m))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets with a shared token and different roots, of a partition that holds whole tokens."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1) for b in batches if len(b)]
    if not parts:
        return
    rows = np.concatenate(parts)
    del parts
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    token, sets = rows[:, 0], rows[:, 1:]
    edges = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[edges, len(token)])

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        every = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_pydict({c: pa.array(every[:, k].copy()) for k, c in enumerate(("a", "b", "one", "two"))})

    def put(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        x, y = sets[i, :2] if not isinstance(i, int) else np.broadcast_to(sets[i, :2], (len(j), 2)), sets[j, :2]
        turn = (x[:, 1] > y[:, 1])[:, None]  # one link between two roots is enough, so pairs are told apart by these
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        return np.stack([x[:, 0], y[:, 0], x[:, 1], y[:, 1]], axis=1)

    got, held = [], 0
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL_SET_CELL)
    for lag in range(1, SMALL_SET_CELL):
        small = small[small < len(token) - lag]
        small = small[token[small + lag] == token[small]]
        if not len(small):
            break
        for i in np.array_split(small, len(small) // (1 << 16) + 1):
            i = i[_meeting(sets[i], sets[i + lag])]
            got.append(put(i, i + lag))
            held += len(i)
            if held > SOME_PAIRS:
                yield pairs(got)
                got, held = [], 0
    for start, n in zip(edges[sizes > SMALL_SET_CELL].tolist(), sizes[sizes > SMALL_SET_CELL].tolist(), strict=True):
        roots, most = np.unique(sets[start : start + n, 1], return_counts=True)
        # The largest root's sets last: no two of them are a pair.
        order = start + np.argsort(sets[start : start + n, 1] == roots[np.argmax(most)], kind="stable")
        for k in range(n - int(most.max())):
            i, rest = int(order[k]), order[k + 1 :]
            rest = rest[_meeting(sets[i], sets[rest])]
            got.append(put(i, rest))
            held += len(rest)
            if held > SOME_PAIRS:
                yield pairs(got)
                got, held = [], 0
    if held:
        yield pairs(got)


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities leave a similarity of 0.8 possible, with the bits that these differ in."""
    for batch in batches:
        n, m, x, y = (batch.column(i).to_pylist() for i in range(4, 8))
        bits = [parity_distance(p, q) for p, q in zip(x, y, strict=True)]
        kept = pa.array([9 * d <= k + j for d, k, j in zip(bits, n, m, strict=True)], pa.bool_())
        columns = {c: batch.column(i) for i, c in enumerate(("a", "b", "one", "two"))}
        yield pa.RecordBatch.from_pydict(columns | {"bits": pa.array(bits, pa.int32())}).filter(kept)


def missed(texts: DataFrame, base: DataFrame, points: DataFrame, members: DataFrame, seed: int = SEED) -> DataFrame:
    """(a, b, one, two, bits): every pair of ``points`` of different components that may be at 0.8 or more, with their roots.

    A prefix filter: all pairs at 0.8 share a token of their prefixes, and none that
    sizes, the tokens' places or parities leave out can be at 0.8. So nothing is
    missed, whatever the counts that order the tokens are. Tokens of one component
    alone are dropped before sets are dealt out by token.
    """
    ranks = slot_ranks(base)
    first = work.cut(work.in_python(texts.select("text"), lambda it: _prefixes(it, seed, ranks), "id long, n int, tokens array<long>"))
    rooted = first.dropDuplicates(["id"]).join(members.withColumnRenamed("node", "id"), "id", "left")
    tokens = work.cut(rooted.withColumn("root", F.coalesce("root", "id"))).select("id", "root", "n", F.posexplode("tokens").alias("at", "token"))
    shared = work.cut(tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token"))
    maybe = work.passes(shared, "token")
    met = tokens.filter(maybe(F.col("token"))).select("token", "id", "root", "n", "at")
    found = work.in_python(met.repartition(F.col("token")), _crossing, "a long, b long, one long, two long").distinct()
    sides = [points.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab"]
    both = found.join(sides[0], "a").join(sides[1], "b").select("a", "b", "one", "two", "n_a", "n_b", "parity_a", "parity_b")
    return work.in_python(both, _differing, "a long, b long, one long, two long, bits int")


def _sets_of(pairs: DataFrame, texts: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """(id, hashes) of the sets in ``pairs``, each from one text."""
    met = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    of = work.cut(points.join(met, "id").select("id", F.col("row").alias("_row")))
    maybe = work.passes(of, "_row")
    found = texts.filter(maybe(F.col("row"))).join(of, F.col("row") == F.col("_row")).select("id", "text").dropDuplicates(["id"])
    return work.cut(work.in_python(found, lambda it: _shingles(it, seed), "id long, hashes array<long>"))


def alike(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, root) for every row of ``docs``: which texts reach each other over shingle similarities of 0.8 or more.

    ``row`` is a hash of doc_id and text, ``root`` names the component. Candidates
    share a grid cell of their fingerprints; each is verified over the sets of
    shingles. A cell of ``n`` sets gives ``n - 1`` candidates, those of fewest
    differing bits that connect it, never all pairs. What these leave apart is joined
    exactly: of all pairs of two components that no bound rules out (``missed``) the
    likeliest is verified first, the others where that was none. Nulls: a null text has no
    words, and texts without words are equal. Equal sets are one point.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    texts = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = work.cut(work.in_python(texts, lambda it: _sets(it, seed), SETS))
    rows = base.filter("counts is null")
    points = work.cut(rows.groupBy("id").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", *PRINT_COLUMNS, "parity")]))
    pairs = work.cut(candidates(points))
    linked = work.cut(similar(pairs, _sets_of(pairs, texts, points, seed)))
    members = work.cut(components(linked))
    close = work.cut(missed(texts, base, points, members, seed))
    if close.take(1):
        sets = _sets_of(close, texts, points, seed)
        best = close.groupBy("one", "two").agg(F.min(F.struct("bits", "a", "b")).alias("s")).select("s.a", "s.b")
        linked = work.cut(linked.union(similar(work.cut(best), sets)))
        members = work.cut(components(linked))
        now = [members.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        rest = close.join(now[0], "a", "left").join(now[1], "b", "left")
        rest = work.cut(rest.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b").join(best, ["a", "b"], "left_anti"))
        if rest.take(1):
            members = work.cut(components(work.cut(linked.union(similar(rest, sets)))))
    return rows.join(members.withColumnRenamed("node", "id"), "id", "left").select("row", "doc_id", F.coalesce("root", "id").alias("root"))


def drop_near_duplicates(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component of ``alike`` stays: the smallest (doc_id, hash of doc_id and text).

    Rows without an id stay; a row repeated with its id and text stays once.
    Different texts of one id are rows of their own.
    """
    kept = alike(docs, seed).filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row"))["row"].alias(KEY)).select(KEY)
    rows = docs.filter("doc_id is not null").withColumn(ROW, F.xxhash64("doc_id", "text"))
    return docs.filter("doc_id is null").unionByName(rows.join(kept, rows[ROW] == kept[KEY], "left_semi").dropDuplicates([ROW]).drop(ROW))
