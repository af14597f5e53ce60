"""SimHash fingerprints and bit-sliced near-duplicate search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free_name, lower_words, small_batches, stash, table, texts_of

BLOCK = 4096  # members of one block of bit planes
LARGE = 1024  # groups with more members are dealt in blocks, so that a task holds about as many at once


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(data: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; the whole sequence if there are fewer words."""
    words = lower_words(data)
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())), np.uint64, len(words) - n + 1)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """64 bits, least significant first: 1 where over half the hashes have the bit. Counted in slices of 4096."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * counts > len(hashes)).astype(np.uint8)


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd constants for derived hashes


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th derived hash of each hash; k = 0 gives the hashes themselves."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(k * _MIX[0] & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(29)
        x *= np.uint64(_MIX[2])
        return x ^ (x >> np.uint64(32))


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """bits / 64 groups of majority bits, each of other derived hashes; little-endian bytes. All zero without hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    return b"".join(np.packbits(majority_bits(mixed(hashes, k)), bitorder="little").tobytes() for k in range(bits // 64))


def least_hashes(hashes: np.ndarray, count: int) -> list[int]:
    """count minima of the shingles under derived hashes; two texts of similarity s share each with chance s."""
    if not len(hashes):
        return [0] * count
    return [int(mixed(hashes, 101 + k).min().astype(np.int64)) for k in range(count)]


def fingerprints(docs: DataFrame, shingle: int, seed: int, bits: int, keys: int) -> DataFrame:
    """doc_id, fp binary, keys array<long> (least shingle hashes) of every whole text; null is empty."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps, least = [], []
            for data in texts_of(batch):
                h = shingle_hashes(data, shingle, seed)
                fps.append(fingerprint(h, bits))
                least.append(least_hashes(h, keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp binary, keys array<long>")


# ---------------------------------------------------------------- bit-sliced comparison
def planes_of(fps: list[bytes]) -> np.ndarray:
    """(bits, words) uint64: plane b holds bit b of all members, 64 members to a word, with a word of zeros behind."""
    raw = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little").T
    width = (len(fps) + 63) // 64 + 1
    padded = np.zeros((bits.shape[0], width * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def moved(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which member i has the bits of member i + by."""
    words, rest = divmod(by, 64)
    out = np.zeros_like(planes)
    tail = planes[..., words:]
    out[..., : tail.shape[-1]] = tail
    if rest:
        out = (out >> np.uint64(rest)) | np.concatenate([out[..., 1:] << np.uint64(64 - rest), np.zeros_like(out[..., :1])], axis=-1)
    return out


def within(left: np.ndarray, right: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """Of the members marked in `live`, those whose left and right bits differ in `radius` bits or fewer.

    Distances of all members grow together: each plane of differences is added into vertical counters by
    carry-save steps (three planes into a sum and a carry, then a ripple through the counter's digits), and
    the comparison is given up as soon as every live member exceeds the radius.
    """
    digits = radius.bit_length() + 1
    counter = [np.zeros_like(live) for _ in range(digits)]
    over = np.zeros_like(live)
    start = (1 << digits) - 1 - radius  # a counter that starts here overflows at radius + 1
    for d in range(digits):
        if start >> d & 1:
            counter[d] = live.copy()

    def add(plane: np.ndarray, digit: int) -> None:
        nonlocal over
        for d in range(digit, digits):
            counter[d], plane = counter[d] ^ plane, counter[d] & plane
        over = over | plane

    bits = left.shape[0]
    for b in range(0, bits, 3):
        x = left[b] ^ right[b]
        y = left[b + 1] ^ right[b + 1] if b + 1 < bits else np.zeros_like(x)
        z = left[b + 2] ^ right[b + 2] if b + 2 < bits else np.zeros_like(x)
        u = x ^ y
        add(u ^ z, 0)
        add((x & y) | (u & z), 1)
        if b % 6 == 0 and not (live & ~over).any():
            break
    return live & ~over


def positions(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


class Links:
    """Least linked member of each member, kept compressed."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            np.minimum.at(self.root, high, low)
            while not np.array_equal(nxt := self.root[self.root], self.root):
                self.root = nxt


def similar_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Of the pairs (a, b) of sorted sets, those with a common share of `share` of their union or more."""
    out = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= share * max(len(x), len(y)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[k] = both >= share * (len(x) + len(y) - both)
    return out


def joined_members(fps: list[bytes], groups: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, share: float = 0.0) -> np.ndarray:
    """The root of each member, linking members of one group within the radius. Rows of a group are neighbours.

    With `sets`, pairs within the radius are linked only if their sets are similar; pairs linked already are not looked at.

    All members are compared with those `lag` places further at once, for each lag up to the largest
    group; blocks whose groups are shorter, or are one component already, are passed over.
    """
    n = len(fps)
    links = Links(n)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[first, n])
    row_end = np.repeat(first + sizes, sizes)
    planes = planes_of(fps)
    lag, active = 1, np.flatnonzero(row_end - np.arange(n) > 1)
    while len(active):
        marks = np.zeros((planes.shape[1] * 64,), np.uint8)
        marks[active] = 1
        live = np.packbits(marks, bitorder="little").view(np.uint64)
        for w in range(0, planes.shape[1], BLOCK // 64):
            part = live[w : w + BLOCK // 64]
            if part.any():
                reach = (lag + 63) // 64 + 1
                near = planes[:, w : w + len(part) + reach]
                hits = positions(within(near[:, : len(part)], moved(near, lag)[:, : len(part)], part, radius)) + w * 64
                if len(hits) and sets is not None:
                    hits = hits[links.root[hits] != links.root[hits + lag]]
                    hits = hits[similar_pairs(sets, hits, hits + lag, share)]
                if len(hits):
                    links.join(hits, hits + lag)
        lag += 1
        active = active[row_end[active] - active > lag]
        if lag in (2, 8, 32) or lag % 128 == 0:  # groups that have become one component need no more lags
            whole = np.maximum.reduceat(links.root, first) == np.minimum.reduceat(links.root, first)
            active = active[~np.repeat(whole, sizes)[active]]
    return links.root


def links_in_groups(rows: DataFrame, radius: int, sets: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """Edges (a, b) between nodes that share a key and differ in `radius` bits or fewer; per key a forest.

    rows: key long, node long, fp binary. Rows of a key meet in one task, sorted; complete groups are
    compared about 8192 rows (or 32 MB of sets) at a time. With sets (doc_id, fp, members binary: a sorted array of
    uint32; fp ends in 16 bytes of digest; node is a doc_id of the fp), edges are also at least `share` similar in their members.
    Sets are fetched only for nodes that have company.
    """
    names = ("key", "node", "fp") if sets is None else ("key", "node", "fp", "members")

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[list] = [[] for _ in names]
        size = 0

        def compared(cut: int):
            keys, nodes, fps, *members = (x[:cut] for x in held)
            for x in held:
                del x[:cut]
            arrays = [np.frombuffer(x, "<u4") for x in members[0]] if members else None
            root = joined_members([x[:-16] for x in fps] if members else fps, np.array(keys, np.int64), radius, arrays, share)
            nodes = np.array(nodes, np.int64)
            own = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])

        for batch in batches:
            for x, name in zip(held, names):
                x.extend(batch.column(name).to_pylist())
            size += batch.nbytes
            if len(held[0]) >= 8192 or size >= 32 << 20:
                last = held[0][-1]
                cut = len(held[0])
                while cut and held[0][cut - 1] == last:
                    cut -= 1
                if cut:
                    yield compared(cut)
                    size = sum(map(len, held[-1]))
        if held[0]:
            yield compared(len(held[0]))

    # a group of one has nothing to be compared with
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("key").alias("__key"))
    kept = rows.join(sizes, F.col("key") == F.col("__key"), "left_semi").select("key", "node", "fp")
    if sets is not None:
        kept = stash(kept)
        needed = kept.select(F.col("fp").alias("__fp"), F.col("node").alias("__node")).distinct()
        own = sets.join(needed, (F.col("fp") == F.col("__fp")) & (F.col("doc_id") == F.col("__node")), "left_semi")
        own = own.groupBy(F.col("fp").alias("__fp"), F.col("doc_id").alias("__node")).agg(F.first("members").alias("members"))
        kept = kept.join(own, (F.col("fp") == F.col("__fp")) & (F.col("node") == F.col("__node"))).select(*names)
    return kept.select(*names).repartition("key").sortWithinPartitions("key", "node").mapInArrow(of, "a long, b long")


def large_groups(rows: DataFrame, large: int) -> DataFrame:
    """__key, __n of the groups of more than `large` rows."""
    return stash(rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large).select(F.col("key").alias("__key"), "__n"))


def split_large(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """rows (key, others array<long>, node, fp) with the rows of large groups dealt anew to (key, other) groups.

    `others` has to be such that any two rows of a group that have to meet share one of them, so no link
    is lost; rows of small groups pass unchanged. What stays large after this is compared block by block.
    """
    hot = large_groups(rows, large)
    if hot.isEmpty():
        return rows.select("key", "node", "fp")
    marked = rows.join(hot, F.col("key") == F.col("__key"), "left")
    keys = F.when(F.col("__n").isNotNull(), F.transform("others", lambda x, i: F.xxhash64(F.col("key"), i, x))).otherwise(F.array("key"))
    return in_blocks(marked.select(F.explode(keys).alias("key"), "node", "fp"), large)


def in_blocks(rows: DataFrame, large: int = LARGE) -> DataFrame:
    """rows (key, node, fp) with each large group dealt in blocks by a hash of fp: every two blocks meet under a key of their own.

    No two rows of a group stay apart, and a task holds about `large` rows of it.
    """
    hot = large_groups(rows, large)
    if hot.isEmpty():
        return rows
    marked = rows.join(hot, F.col("key") == F.col("__key"), "left")
    count = F.ceil(F.col("__n") / (large / 2))
    own = F.pmod(F.xxhash64("fp"), count)
    pair = lambda j: F.xxhash64(F.col("key"), F.least(own, j), F.greatest(own, j))
    keys = F.when(F.col("__n").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), count - 1), pair)).otherwise(F.array("key"))
    return marked.select(F.explode(keys).alias("key"), "node", "fp")


# ---------------------------------------------------------------- 64 bits, radius 3, exact
def bit_ranges(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` near-equal runs of the given bit numbers."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> list[tuple[int, list[int]]]:
    """Pairs of bit blocks, radius + 2 blocks in all, with masks that part the other bits in radius + 1 blocks.

    Fingerprints within the radius agree on at least two of the blocks, and of the others on one.
    """
    blocks = bit_ranges(list(range(64)), radius + 2)
    out = []
    for i in range(len(blocks)):
        for j in range(i):
            both = blocks[i] | blocks[j]
            out.append((both, bit_ranges([b for b in range(64) if not both >> b & 1], radius + 1)))
    return out


def component_of_fingerprints(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, component) for linked nodes (node, fp of 8 bytes, fp_long the same as a number): every pair within the radius is a link."""
    rows = nodes.withColumn("bits", F.col("fp_long"))
    made = []
    for k, (mask, subs) in enumerate(masks(radius)):
        at = F.col("bits").bitwiseAND(F.lit(as_long(mask)))
        made.append(F.struct(F.xxhash64(F.lit(k), at).alias("key"), F.array(*[F.col("bits").bitwiseAND(F.lit(as_long(s))) for s in subs]).alias("others")))
    dealt = rows.select("node", "fp", F.explode(F.array(*made)).alias("__m")).select("__m.key", "__m.others", "node", "fp")
    return components(links_in_groups(split_large(dealt), radius))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id, text).

    Words are cut at ASCII white space, A-Z lower-cased; a fingerprint bit is 1 if set in over half the
    shingle hashes. Fingerprints at most `radius` bits apart are linked; component_id is the least
    doc_id reachable. Equal fingerprints are one node, so copies cost nothing. Null or wordless texts
    have fingerprint zero and are linked like any other. Rows of null doc_id belong to their
    fingerprint's component (null if no other row has an id). Ids are whole numbers. Repeated rows are rows like any others; very
    long texts are read whole. An empty table gives an empty one. Extra columns are ignored.
    """
    made = stash(fingerprints(docs, shingle, seed, 64, 0).select("doc_id", "fp"))
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    little = F.col("fp")
    value = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.substring(little, i + 1, 1)), 16, 10).cast("long")
        value = value.bitwiseOR(F.shiftleft(byte, 8 * i))
    nodes = stash(nodes.withColumn("fp_long", value))
    found = component_of_fingerprints(nodes, radius)
    labelled = nodes.join(found.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("component_id"))
    shown = F.lower(F.hex(F.concat(*[F.substring("fp", i, 1) for i in range(8, 0, -1)])))
    return made.join(labelled, F.col("fp") == F.col("__fp"), "left").select("doc_id", shown.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- longer fingerprints, for a similarity of word shingles
#: 256 bits; shingle sets of Jaccard 0.8 differ in 39 bits on average (standard deviation 6; 48 for sets of 4 and 5), unrelated
#: texts in 128. The radius only finds candidates: NEAR_SHARE of the shingles has to be common.
NEAR_BITS, NEAR_RADIUS, NEAR_SHINGLE, NEAR_KEYS, NEAR_SHARE = 256, 72, 5, 5, 0.8


def shingle_sets(docs: DataFrame, shingle: int, seed: int, bits: int, keys: int) -> DataFrame:
    """doc_id, fp binary, keys array<long>, n int, members binary of the distinct shingles of every whole text; null is empty.

    fp: the SimHash, then 16 bytes of digest of the set, so that equal fps are equal sets. members: the upper
    halves of the hashes, sorted, as uint32; n: their number.
    """
    small_batches(docs.sparkSession)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps, least, sizes, members = [], [], [], []
            for data in texts_of(batch):
                h = np.unique(shingle_hashes(data, shingle, seed))
                fps.append(fingerprint(h, bits) + xxhash.xxh128_digest(h.tobytes()))
                least.append(least_hashes(h, keys))
                half = np.unique((h >> np.uint64(32)).astype("<u4"))
                sizes.append(len(half))
                members.append(half.tobytes())
            columns = [batch.column("doc_id"), pa.array(fps, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "keys", "n", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp binary, keys array<long>, n int, members binary")


def near_groups(docs: DataFrame, bits: int = NEAR_BITS, radius: int = NEAR_RADIUS, shingle: int = NEAR_SHINGLE, keys: int = NEAR_KEYS, seed: int = 42, share: float = NEAR_SHARE, large: int = LARGE) -> DataFrame:
    """doc_id, group_id: texts whose sets of five-word shingles have a similarity of `share` or more are linked, no others.

    Repeated shingles count once. Candidates share one of `keys` least shingle hashes (all but 0.2**keys of the
    pairs of similarity 0.8) and differ in `radius` bits or fewer (all but about 1 in 10 000). Groups that grow
    large, such as around a passage many texts share, are parted by size, as similar sets have similar
    sizes, and what stays large is compared block by block: neither loses a pair.
    """
    made = stash(shingle_sets(docs, shingle, seed, bits, keys))
    nodes = stash(made.groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n").alias("n")).where("node IS NOT NULL"))
    dealt = nodes.select("node", "fp", "n", F.posexplode("keys").alias("i", "k"))
    # sets of sizes a <= b meet if a >= share * b: their buckets are equal or neighbours
    bucket = F.floor(F.log(F.greatest("n", F.lit(1))) / -math.log(share) * (1 - 1e-9)) if share < 1 else F.col("n")
    rows = stash(dealt.select(F.xxhash64("i", "k").alias("key"), bucket.cast("long").alias("bucket"), "node", "fp"))
    hot = large_groups(rows, large)
    if hot.isEmpty():
        rows = rows.select("key", "node", "fp")
    else:
        sized = F.transform(F.array(F.col("bucket"), F.col("bucket") + 1), lambda x: F.xxhash64(F.col("key"), x))
        marked = rows.join(hot, F.col("key") == F.col("__key"), "left")
        rows = in_blocks(marked.select(F.explode(F.when(F.col("__n").isNotNull(), sized).otherwise(F.array("key"))).alias("key"), "node", "fp"), large)
    found = components(links_in_groups(rows, radius, made.select("doc_id", "fp", "members"), share))
    labelled = nodes.join(found.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("group_id"))
    return made.select("doc_id", "fp").join(labelled, F.col("fp") == F.col("__fp"), "left").select("doc_id", "group_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row of the least doc_id stays, null ids last; of equal ids one row.

    Rows are numbered in a written table first and grouped by their number, so null, equal and clashing ids are rows like any
    others. Null, empty and wordless texts are copies of each other; texts of fewer than five words are near copies only if
    they are equal. Very long texts are compared whole. An empty table gives an empty one; no name of a column is reserved.
    """
    row = free_name(docs.columns, "row_number")
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_groups(numbered.select(F.col(row).alias("doc_id"), "text"))
    ids = numbered.select(F.col(row).alias("number"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    placed = groups.join(ids, F.col("doc_id") == F.col("number"))
    kept = placed.groupBy("group_id").agg(F.min(F.struct("none", "id", "number")).alias("k")).select(F.col("k.number").alias(f"_{row}"))
    return numbered.join(kept, F.col(row) == F.col(f"_{row}"), "left_semi").drop(row)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
