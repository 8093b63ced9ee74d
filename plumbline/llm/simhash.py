"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats joined by a
space (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Candidates: a fingerprint is cut into two halves. Two fingerprints that differ in at most two bits differ in at most
one bit of the high half, or else are equal in the low half. So the table has each distinct fingerprint under its two
halves, and each fingerprint looks up the 33 values of the Hamming ball of radius 1 around its high half and the one
value of its low half. Complete distances are then verified.

A half that more than ``hot_bucket`` distinct fingerprints share is not joined with itself: those fingerprints look up
the whole ball of radius 2 around them (2,081 complete fingerprints), which finds the same links and grows in
proportion to their number. So no bucket gives more than hot_bucket * 33 * hot_bucket comparisons, and none is capped.

The same on wide fingerprints finds near copies, groups() and keep_one(): a Jaccard similarity of five-word shingles
of at least 0.8. Two such texts differ in about 15 % of the bits of their fingerprints, whatever the hashes, so 64 bits
and a small radius are not enough. A wide fingerprint has ``SEGMENTS`` segments of ``SEGMENT_BITS`` bits, made as above
from as many hashes of each distinct shingle, and is filed under each of them. The Hamming ball of radius 1 around each
segment is looked up in that segment's table: two texts of similarity 0.8 meet and pass with a probability of 0.99 (0.85 if
they have about five shingles), and two that have nothing in common in 1 of 14,000. A sketch of 384 bits is compared where
two entries meet, and what meets is one family: a task gives each text's family, never its pairs, so rows grow with the
texts and not with their pairs. The look-ups go in rounds, and a pair that is in one family by then is not taken up again: first
equal values of the first ``FIRST`` segments, which join most of what is to be joined, then the rest of the balls. Of a value
that more than ``SMALL`` texts share, these rounds compare only the middle one with all others; a last round takes all its
pairs that are still apart, by complete fingerprints, so none is left out.

A family is only where links can be. Its texts then come together, in blocks of ``BLOCK`` texts or ``BLOCK_BYTES`` bytes and
pairs of blocks if there are more, and of all its pairs whose complete fingerprints are close enough the exact similarity
of the shingles is verified, nearest first, unless links of others have joined the two; so nothing else is linked. A task
again gives each text's component, not its links.

Copies have one fingerprint and are one row of all this. Links become components by contraction in distributed tables.

Edge cases: null, empty and blank texts have fingerprint zero, which links like any other; a null doc_id is no
candidate for component_id (a component of nulls alone has null); repeated rows give repeated rows; an empty table
gives an empty result; extra columns are ignored by near_duplicates and kept by keep_one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plumbline.llm.nearcopies import SIMILARITY, one_of_each, shared, shingles
from plumbline.llm.text import Words, map_arrow, mix, slices, tasks_for, texts_of
from plumbline.plans.components import PER_TASK as EDGES
from plumbline.plans.components import connected_components, stars
from plumbline.plans.lineage import cut

HOT_BUCKET = 1000
SEED = 42
#: Of the wide fingerprints: all bits behind the first word are cut into segments, the first words are a sketch.
SEGMENTS, SEGMENT_BITS, SKETCH = 48, 24, 6
WIDE = 1 + SEGMENTS * SEGMENT_BITS // 64
#: The share of bits in which texts of similarity 0.8 differ, a bit more than expected; larger for few shingles.
#: SPREADS standard deviations above it, a pair is given up.
FAR, FAR_IF_FEW, FEW_SHINGLES, SPREADS = 0.155, 0.19, 24, 2.5
#: The segments of the first round.
FIRST = 12
#: Entries with a value that more of them share are first compared with the middle one.
SMALL = 8
#: Entries of one task.
PER_TASK = 1 << 20
#: Texts, and bytes of text, of a block of a family; rows of a block whose fingerprints are compared at once.
BLOCK, BLOCK_BYTES, STRIP = 2048, 8 << 20, 512
_PART = 1 << 16
_SALTS = np.random.default_rng(23).integers(1, 1 << 63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < 3:
        return xxh64_intdigest(joined, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.zeros(n, np.int64)
    start[1:] = end[:-1] + 1
    total, m = np.zeros(64, np.int64), n - 2
    for a in range(0, m, _PART):  # bounded memory for very long texts
        b = min(m, a + _PART)
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(start[a:b].tolist(), end[a + 2 : b + 2].tolist())]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    out = np.packbits(2 * total > m)
    return int(out.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(x) for x in texts_of(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id bigint, fp bigint")


def _masks(bits: int, radius: int) -> list[int]:
    masks = [0, *[1 << i for i in range(bits)]]
    if radius > 1:
        masks += [(1 << i) | (1 << j) for i in range(bits) for j in range(i)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(src, dst) with src < dst, once for each pair of distinct fingerprints ``fp`` within two bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = distinct.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("part")), F.struct(F.lit(1).alias("seg"), low.alias("part")))).alias("k"))
    table = table.select("fp", "k.seg", "k.part")
    hot = cut(table.groupBy("seg", "part").count().where(F.col("count") > hot_bucket).select("seg", "part"))
    cold = table.join(hot, ["seg", "part"], "left_anti").withColumnRenamed("fp", "dst")
    near = [high, *[high.bitwiseXOR(F.lit(m).cast("long")) for m in _masks(32, 1)[1:]]]
    probe = distinct.select(F.col("fp").alias("src"), F.explode(F.array(*[F.struct(F.lit(0).alias("seg"), x.alias("part")) for x in near], F.struct(F.lit(1).alias("seg"), low.alias("part")))).alias("k"))
    probe = probe.select("src", "k.seg", "k.part")
    pairs = probe.join(cold, ["seg", "part"]).where("src < dst and bit_count(src ^ dst) <= 2").select("src", "dst")
    if hot.isEmpty():
        return pairs.distinct()
    crowded = table.join(hot, ["seg", "part"], "left_semi").select("fp").distinct()
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(64, 2)]))
    wide = crowded.select(F.col("fp").alias("a"), masks.alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("fp"))
    found = wide.join(distinct.select("fp"), "fp").where("a <> fp")
    return pairs.union(found.select(F.least("a", "fp"), F.greatest("a", "fp"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, n_links) for each row; n_links: other fingerprints within two bits."""
    rows = cut(fingerprints(docs, text, id))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    edges = cut(links(distinct.select("fp"), hot_bucket))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    label = connected_components(edges).withColumnRenamed("node", "fp")
    placed = cut(distinct.join(label, "fp", "left").join(degree, "fp", "left"))
    lowest = placed.where("label is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = placed.join(lowest, "label", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies")
    placed = cut(placed)
    # Fingerprints of many rows (over 1 / 5000 of all, so 5,000 at most) are broadcast: no task gets all rows of one.
    often = F.col("copies") > max(1000, (placed.agg(F.sum("copies")).first()[0] or 0) // 5000)
    few = F.broadcast(placed.where(often))
    rare = rows.join(F.broadcast(placed.where(often).select("fp")), "fp", "left_anti").join(placed.where(~often), "fp")
    return rare.unionByName(rows.join(few, "fp")).select("doc_id", "fp", "component_id", "n_links")


# Groups of near copies: wide fingerprints, an index of their segments, exact similarity.


def distinct_shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each document's distinct shingles, where each document's begin and the number of all)."""
    x, first = shingles(words)
    doc = np.repeat(np.arange(words.docs), np.diff(first))
    z = mix(x ^ mix(doc.astype(np.uint64)))
    order = np.argsort(z)
    again = np.zeros(len(z), bool)
    again[order[1:]] = z[order[1:]] == z[order[:-1]]
    return x[~again], np.concatenate([[0], np.cumsum(np.bincount(doc[~again], minlength=words.docs))])


def wide_fingerprints(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """documents x WIDE: a bit is set if over half of the document's shingles have it set in the hash that belongs to it;
    if just half have, the document's smallest shingle decides."""
    docs = len(first) - 1
    count = np.diff(first)
    least = np.minimum.reduceat(x, first[:-1])
    out = np.empty((docs, WIDE), np.uint64)
    for j, salt in enumerate(_SALTS):
        total = np.zeros((docs, 64), np.int32)
        for a in range(0, len(x), _PART):  # bounded memory for very long texts
            b = min(a + _PART, len(x))
            who = np.arange(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left"))
            begin, end = np.maximum(first[who], a), np.minimum(first[who + 1], b)
            parts = -(-(end - begin) // 255)  # sums of up to 255 bits fit into a byte
            edges = np.repeat(begin - a, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            bits = np.unpackbits(mix(x[a:b] ^ salt).view(np.uint8)).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(bits, edges, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int32)
            total[who] += np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
        decides = np.unpackbits(mix(least ^ salt).view(np.uint8)).reshape(-1, 64)
        out[:, j] = np.packbits(2 * total + decides > count[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def _wide(rows: DataFrame) -> DataFrame:
    """(k, fp) of the rows (k, text): the fingerprint as bytes, and behind it the number of shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x, first = distinct_shingles(Words(part.column("text")))
                fp = np.column_stack([wide_fingerprints(x, first), np.diff(first).astype(np.uint64)])
                size = 8 * (WIDE + 1)
                blobs = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(len(fp) + 1, dtype=np.int32) * size), pa.py_buffer(fp.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("k"), blobs], ["k", "fp"])

    return map_arrow(rows, run, "k bigint, fp binary")


def _parsed(fp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, numbers of shingles)."""
    words = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(-1, WIDE + 1)
    return words[:, :WIDE], words[:, WIDE].astype(np.int64)


def most_differing(low: np.ndarray, bits: int) -> np.ndarray:
    """In how many of ``bits`` bits two texts may differ, of which the shorter one has ``low`` shingles; texts of few
    shingles differ in more."""
    p = np.where(low < FEW_SHINGLES, FAR_IF_FEW, FAR)
    return bits * p + SPREADS * np.sqrt(bits * p * (1 - p))


def close(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Marks pairs whose numbers of shingles allow the similarity and whose bits differ little enough for it."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = low >= SIMILARITY * high - 1e-9
    out[out] = np.bitwise_count(a[out] ^ b[out]).sum(1, dtype=np.int64) <= most_differing(low[out], 64 * a.shape[1])
    return out


def segments(fp: np.ndarray) -> np.ndarray:
    """documents x SEGMENTS: the values of the segments behind the first word; of a sketch, of those that it holds."""
    bits = np.unpackbits(np.ascontiguousarray(fp[:, 1:]).view(np.uint8).reshape(len(fp), -1), axis=1)
    held = bits.shape[1] // SEGMENT_BITS
    packed = np.packbits(bits[:, : held * SEGMENT_BITS].reshape(len(fp), held, SEGMENT_BITS), axis=2).astype(np.uint32)
    value = np.zeros(packed.shape[:2], np.uint32)
    for k in range(packed.shape[2]):
        value = (value << np.uint32(8)) | packed[:, :, k]
    return value


def _entry(words: int) -> np.dtype:
    return np.dtype([("value", np.uint32), ("k", np.int64), ("n", np.int64), ("label", np.int64), ("sketch", np.uint64, words)])


_HALF = (1 << SEGMENT_BITS // 2) - 1


def _entries(prints: DataFrame, views: int, parts: int, words: int, turn: int) -> DataFrame:
    """(table, part, blob) of the rows (k, fp, label): each fingerprint under each of its segments that the round looks
    at, with its first ``words`` words as a sketch. With one view, a segment's table is one part. With two, the table is dealt by the lower half of the value, and once more by the upper
    half: values that differ in one bit share one half, so they meet in one part. Equal values meet in either view."""
    last, shown = (FIRST, 1) if turn == EQUAL else (SEGMENTS, views)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, n = _parsed(batch.column("fp"))
            value = segments(fp)
            e = np.empty(len(fp), _entry(words))
            e["k"], e["label"], e["n"], e["sketch"] = batch.column("k").to_numpy(), batch.column("label").to_numpy(), n, fp[:, :words]
            tables, at, blobs = [], [], []
            for s in range(last):
                e["value"] = value[:, s]
                for v in range(shown):
                    half = (e["value"] >> np.uint32(SEGMENT_BITS // 2 * v)) & np.uint32(_HALF)
                    where = mix(half.astype(np.uint64)) % np.uint64(parts) if views > 1 else np.zeros(len(e), np.uint64)
                    for p in np.unique(where):
                        tables.append(views * s + v)
                        at.append(int(p))
                        blobs.append(e[where == p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["table", "part", "blob"])

    return map_arrow(prints, run, "table int, part int, blob binary")


def _ball(view: int, views: int) -> list[int]:
    """What a value of a view's table is xored with to give its neighbours: nothing, or one bit of the half that the
    view is not dealt by (of the whole value with one view). Of two views only the first has the value itself."""
    if views == 1:
        return [0, *[1 << b for b in range(SEGMENT_BITS)]]
    half = SEGMENT_BITS // 2
    return [0, *[1 << b for b in range(half, SEGMENT_BITS)]] if view == 0 else [1 << b for b in range(half)]


#: The rounds of look-ups: equal values of the first segments; the other values of the balls; what the two left out of large groups.
EQUAL, NEAR_BY, REST = range(3)


def _look_up(e: np.ndarray, ball: list[int], turn: int, crowd: list[np.ndarray], segment: int = 0):
    """Pairs (src, dst) of one part of a table, in pieces: entries whose values are in each other's ball, whose sketches
    are near and whose labels differ. Within a large group of values, or between it and another, only the pairs with
    the middle of a group, the entry whose sketch is nearest to what most of its sketches are, are taken, in the last
    round (REST) all of them. The round before (NEAR_BY) adds to ``crowd`` what the last one has to look at."""
    e = e[np.argsort(e["value"], kind="stable")]
    value, begin, group = np.unique(e["value"], return_index=True, return_inverse=True)
    size = np.diff(np.append(begin, len(e)))
    off = np.zeros(len(e), np.int64)  # bits of the sketch that differ from most of the group's
    some = np.flatnonzero(size[group] > SMALL)
    for j in range(e["sketch"].shape[1] if len(some) else 0):
        bits = np.unpackbits(np.ascontiguousarray(e["sketch"][some, j]).view(np.uint8)).reshape(-1, 64)
        first = np.flatnonzero(np.diff(group[some], prepend=-1))
        most = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > size[group[some[first]], None]
        off[some] += (bits != most[np.cumsum(np.diff(group[some], prepend=-1) != 0) - 1]).sum(1)
    e = e[np.lexsort((e["k"], off, group))]
    k, label, shingles_, sketch = (np.ascontiguousarray(e[c]) for c in ("k", "label", "n", "sketch"))

    def near(a, b, once=True):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        ok = close(sketch[a], shingles_[a], sketch[b], shingles_[b])
        a, b = a[ok], b[ok]
        if once and turn != EQUAL and segment and len(a):  # a pair that an earlier table has, too, is taken there, or in the last round
            new = (np.bitwise_count(segments(sketch[a]) ^ segments(sketch[b]))[:, :segment] > 1).all(1)
            a, b = a[new], b[new]
        a, b = k[a], k[b]
        return np.minimum(a, b), np.maximum(a, b)

    def product(g, h):
        """All pairs of the groups g and h, in pieces."""
        pairs = size[g] * size[h]
        total, at = np.cumsum(pairs), 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PART, "right")))
            n, h_size = pairs[at:to], np.repeat(size[h[at:to]], pairs[at:to])
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield near(np.repeat(begin[g[at:to]], n) + place // h_size, np.repeat(begin[h[at:to]], n) + place % h_size)
            at = to

    for flip in ball:
        if flip and turn == EQUAL:
            continue
        if flip:
            g = np.flatnonzero(value < value ^ np.uint32(flip))
            h = np.minimum(np.searchsorted(value, value[g] ^ np.uint32(flip)), max(len(value) - 1, 0))
            there = value[h] == value[g] ^ np.uint32(flip)
            g, h = g[there], h[there]
        else:
            g = h = np.flatnonzero(size > 1)
        large = (size[g] > SMALL) | (size[h] > SMALL)
        if turn == REST:
            yield from product(g[large], h[large])
            continue
        if turn == NEAR_BY:
            full = np.zeros(len(value), bool)
            full[g[large]] = full[h[large]] = True
            crowd.append(e["k"][full[group]])  # the entries are in the order of their groups
            if not flip and segment < FIRST:
                continue
        yield from product(g[~large], h[~large])
        g, h = g[large], h[large]
        if len(g):
            for one, other in ((g, h), (h, g)) if flip else ((g, h),):
                n = size[other]
                total = np.cumsum(n)
                yield near(np.repeat(begin[one], n), np.repeat(begin[other] - (total - n), n) + np.arange(n.sum()), once=False)


class Joined:
    """Edges, kept as stars: each node and the smallest one that it is joined with."""

    def __init__(self):
        self.u, self.v, self.held, self.least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, EDGES

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > self.least:
            u, v = self.stars()
            self.u, self.v, self.held, self.least = [u], [v], len(u), max(EDGES, 2 * len(u))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        node, root = stars(np.concatenate(self.u), np.concatenate(self.v))
        return node[node != root], root[node != root]


def _matches(prints: DataFrame, views: int, parts: int, turn: int) -> DataFrame:
    """What the index joins in a round, for the rows (k, fp, label): rows (src, dst), in each task no more than one for
    a text, or (crowd), keys that the last round has to look at, as bytes."""
    words = WIDE if turn == REST else SKETCH

    def run(batches):
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for t, p, b in zip(*[batch.column(c).to_pylist() for c in ("table", "part", "blob")]):
                found.setdefault((t, p), []).append(np.frombuffer(b, _entry(words)))
        joined = Joined()
        for (t, _), blobs in found.items():
            crowd = []
            for a, b in _look_up(np.concatenate(blobs), _ball(t % views, views), turn, crowd, t // views):
                joined.add(a, b)
            if any(map(len, crowd)):
                keys = pa.array([np.unique(np.concatenate(crowd)).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), keys], ["src", "dst", "crowd"])
        node, root = joined.stars()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.nulls(len(node), pa.binary())], ["src", "dst", "crowd"])

    tasks = FIRST * parts if turn == EQUAL else SEGMENTS * views * parts // 4
    return map_arrow(_entries(prints, views, parts, words, turn).repartition(tasks, "table", "part"), run, "src bigint, dst bigint, crowd binary")


def _crowd(found: DataFrame) -> DataFrame:
    """(k) of the keys in ``crowd``."""

    def run(batches):
        for batch in batches:
            for b in batch.column("crowd").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b, np.int64))], ["k"])

    return map_arrow(found.where("crowd is not null").select("crowd"), run, "k bigint").distinct()


def true_links(side: np.ndarray, fp: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each text of a family, or of a pair of its blocks, the smallest place among those that links join with it.
    side: the text's block, in order; fp, n: fingerprints and numbers of shingles; x: all shingles, text by text."""
    m, bits = len(n), 64 * WIDE
    first = np.concatenate([[0], np.cumsum(n)])
    values, x = np.unique(x, return_inverse=True)
    keys = np.sort(np.repeat(np.arange(m) * len(values), n) + x)  # each text's shingles by their places in values
    x = keys - np.repeat(np.arange(m) * len(values), n)
    signs = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(m, -1), axis=1).astype(np.float32) * 2 - 1
    split = int(np.searchsorted(side, side[-1])) if side[0] != side[-1] else 0
    ends = split or m
    root = np.arange(m)
    for at in range(0, ends, STRIP):
        a, start = np.arange(at, min(at + STRIP, ends)), split or at
        differ = (bits - signs[a] @ signs[start:].T) / 2
        low, high = np.minimum(n[a, None], n[start:]), np.maximum(n[a, None], n[start:])
        i, j = np.nonzero((low >= SIMILARITY * high - 1e-9) & (differ <= most_differing(low, bits)) & (root[a, None] != root[start:]))
        nearest = np.argsort(differ[i, j], kind="stable")
        i, j = a[i[nearest]], start + j[nearest]
        if not split:
            i, j = i[i < j], j[i < j]
        while len(i):
            to = max(1, int(np.searchsorted(np.cumsum(np.minimum(n[i], n[j])), _PART, "right")))
            u, v = i[:to], j[:to]
            both = shared(keys, x, first, len(values), u, v)
            linked = both >= SIMILARITY * (n[u] + n[v] - both) - 1e-9
            if linked.any():
                node, least = stars(root[u[linked]], root[v[linked]])
                new = np.arange(m)
                new[node] = least
                root = new[root]
            i, j = i[to:], j[to:]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    return root


def _families(rows: DataFrame, prints: DataFrame, family: DataFrame, tasks: int) -> DataFrame:
    """(src, dst): links within families that join what all links of a family join, for the texts (k, text)."""

    def run(batches):
        held, unit, out = [], None, []

        def done():
            k, side, fp, n, x = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((k, side))
            first = np.concatenate([[0], np.cumsum(n)])
            x = np.concatenate([x[first[i] : first[i + 1]] for i in order])
            k = k[order]
            root = true_links(side[order], fp[order], n[order], x)
            joined = np.flatnonzero(root != np.arange(len(k)))
            out.append((k[joined], k[root[joined]]))

        def given():
            a, b = (np.concatenate(c) for c in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        for batch in batches:
            for part in slices(batch, "text"):
                x, first = distinct_shingles(Words(part.column("text")))
                fp, n = _parsed(part.column("fp"))
                k, side = part.column("k").to_numpy(), part.column("side").to_numpy()
                of = np.stack([part.column(c).to_numpy() for c in ("g", "low", "high")], 1)
                cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), len(of)]
                for i, j in zip(cuts, cuts[1:]):
                    if held and (of[i] != unit).any():
                        done()
                        held.clear()
                    unit = of[i]
                    held.append((k[i:j], side[i:j], fp[i:j], n[i:j], x[first[i] : first[j]]))
            if out:
                yield given()
        if held:
            done()
            yield given()

    at = prints.join(family.select(F.col("node").alias("k"), F.col("label").alias("g")), "k")
    texts = cut(rows.join(at, "k").groupBy("k").agg(*[F.first(c).alias(c) for c in ("text", "g", "fp")]))
    size = texts.groupBy("g").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1))
    blocks = F.least("n", blocks).cast("int")  # a block of very long texts may hold one
    large = cut(size.select("g", blocks.alias("blocks")).where("blocks > 1"))  # no more than all texts make full blocks
    texts = texts.join(F.broadcast(large), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    texts = texts.withColumn("side", F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = texts.select("g", "k", "fp", "text", "side", other)
    units = units.select("g", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "k", "fp", "text")
    units = units.repartition(tasks, "g", "low", "high").sortWithinPartitions("g", "low", "high")
    return map_arrow(units, run, "src bigint, dst bigint")


def groups(docs: DataFrame, text: str = "text", per_task: int = PER_TASK) -> DataFrame:
    """(node, label) for each text (by xxhash64) that has near copies: five-word shingles of a Jaccard similarity of at
    least 0.8. label is the same all over a component."""
    rows = docs.select(F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    prints = cut(_wide(rows).groupBy("k").agg(F.first("fp").alias("fp")))  # equal keys have equal texts
    n = prints.count()
    views, parts = (1, 1) if n <= per_task else (2, -(-2 * n // per_task))
    family, joined, crowd = None, None, None
    for turn in (EQUAL, NEAR_BY, REST):
        if family is None:
            placed = prints.withColumn("label", F.col("k"))
        else:
            at = family.select(F.col("node").alias("k"), "label")
            placed = prints.join(at, "k", "left").withColumn("label", F.coalesce("label", "k"))
        if turn == REST:
            placed = placed.join(crowd, "k", "left_semi")
        found = cut(_matches(placed, views, parts, turn))
        if turn == NEAR_BY:
            crowd = cut(_crowd(found))
        new = found.where("crowd is null").select("src", "dst")
        if family is None or not new.isEmpty():
            joined = new if joined is None else joined.unionByName(new)
            family = connected_components(joined)
    return connected_components(_families(rows, prints, family, tasks_for(docs)))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group of near copies: the smallest id stays, null last,
    then the smallest hash of the text. Rows are told apart by id and text, so no other row of that id comes or goes
    with it."""
    found = groups(docs, text, **options)
    return one_of_each(docs, found.select(F.col("node").alias("k"), F.col("label").alias("g")), id, text)
