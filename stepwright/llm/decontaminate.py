"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, free_name, small_batches, stash, table, texts_of

#: Fewest tokens of an item and its seeds; 1: the token counts, 0: it is ignored. The seeds leave out no pattern of 20 %
#: substitutions in a whole item of 5 to 19 tokens or in 20 tokens of a longer one (enumerated in the tests). Of fewer than five
#: tokens 20 % are less than one, so these are searched for as they are.
SEEDS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011", "11101", "10111"),
    10: ("1111011", "110010111", "101100111", "111111", "110101011", "1101111"),
    15: ("11101111", "111010010011", "11011000111", "111000100010011", "11000101111", "110111101", "111000010100011"),
}
LEAST_TOKENS = min(SEEDS)
LONGEST = max(len(m) for masks in SEEDS.values() for m in masks)
SALTED, MOST_SALTS = 10_000, 1024  # hits of a seed that meet in a task, about; parts of a seed at most
RUN = 1 << 16  # tokens of neighbouring documents that are hashed at once
LEAST_BITS, MOST_BITS = 20, 30  # the filter of benchmark hashes has 2**20 to 2**30 bits (128 KB to 128 MB)
BITS_A_HASH = 1024  # so that about one foreign hash in 260 000 passes its two slots
MARGIN = 24  # tokens kept on either side of a hit
WINDOW = 20  # tokens of an overlap
SHARE = 0.8  # of them equal

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum() and c > 32)


def tokens(data: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return data.lower().translate(None, _PUNCTUATION).split()


def seed_hashes(th: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed's hash at each position of the token hashes."""
    n = len(th) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                out = (out ^ th[i : i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
                out ^= out >> np.uint64(31)
    return out


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of a hash, in a filter of 2**bits."""
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def seeds_of(least: int) -> list[tuple[int, str]]:
    """(number, mask) of the seeds for items of `least` tokens or more."""
    return [(least * 16 + k, m) for k, m in enumerate(SEEDS[least])]


def least_of(n: int) -> int:
    """The key in SEEDS of an item of n tokens."""
    return max(x for x in SEEDS if x <= n)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, toks array<long>, seeds array<struct<h, pos>> of each benchmark row with a token or more."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = []
            for item, data in zip(batch.column("item_id").to_pylist(), texts_of(batch)):
                words = tokens(data)
                if len(words) < LEAST_TOKENS:
                    continue
                th = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
                seeds = []
                for k, mask in seeds_of(least_of(len(words))):
                    seeds += [{"h": int(x), "pos": i} for i, x in enumerate(seed_hashes(th, mask, k).view(np.int64))]
                key = xxhash.xxh64_intdigest(data, seed=(item or 0) & 0xFFFFFFFFFFFFFFFF)
                rows.append({"item_key": int(np.uint64(key).view(np.int64)), "item_id": item, "toks": th.view(np.int64).tolist(), "seeds": seeds})
            kind = pa.struct([("h", pa.int64()), ("pos", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_key", pa.int64()), ("item_id", pa.int64()), ("toks", pa.list_(pa.int64())), ("seeds", pa.list_(kind))]))

    narrow = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(of, "item_key long, item_id long, toks array<long>, seeds array<struct<h: long, pos: int>>").dropDuplicates(["item_key"])


def filter_of(seeds: DataFrame) -> np.ndarray:
    """A bit for each of the two slots of each hash, in a filter sized by the count of hashes.

    The driver gets a number for each 64 bits that are not all unset, 2**MOST_BITS / 64 at most; beyond 2**MOST_BITS / BITS_A_HASH hashes
    the filter lets more pass, which the exact join then stops.
    """
    bits = min(max(LEAST_BITS, (seeds.count() * BITS_A_HASH).bit_length()), MOST_BITS)
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    high = F.shiftrightunsigned(F.col("h"), 64 - bits)
    slot = seeds.select(F.explode(F.array(high, low)).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint8)


def passages_near_hits(docs: DataFrame, bits: np.ndarray, used: list[tuple[int, str]]) -> DataFrame:
    """seg, doc_id, start, toks, hits array<struct<h, pos>>: the tokens around positions that pass the filter; whole texts are searched for the seeds in `used`."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(bits)  # 2**MOST_BITS bits at most

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        table_ = sent.value
        width = len(table_).bit_length() + 2  # of 2**width bits
        kind = pa.schema([("seg", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("toks", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())])))])
        one = np.uint64(7)

        def passing(th: np.ndarray, bounds: np.ndarray) -> list[list]:
            """Per document, which begin at `bounds` in th, the (position, hash) pairs that pass."""
            out = [[] for _ in bounds[1:]]
            for k, mask in used:
                h = seed_hashes(th, mask, k)
                a, b = slots(h, width)
                at = np.flatnonzero((table_[(a >> np.uint64(3)).astype(np.int64)] >> (a & one).astype(np.uint8)) & 1)
                b = b[at]
                at = at[((table_[(b >> np.uint64(3)).astype(np.int64)] >> (b & one).astype(np.uint8)) & 1).astype(bool)]
                own = np.searchsorted(bounds, at, "right") - 1
                inside = at + len(mask) <= bounds[own + 1]
                for p, d, x in zip((at - bounds[own])[inside].tolist(), own[inside].tolist(), h[at[inside]].view(np.int64).tolist()):
                    out[d].append((p, x))
            return out

        for batch in batches:
            number = Numbering()
            data_of = texts_of(batch)
            texts = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in map(tokens, data_of)]
            hashes = number.hashes()
            rows, hits_of = [], []
            while len(hits_of) < len(texts):
                part, size = texts[len(hits_of) : len(hits_of) + 1], len(texts[len(hits_of)])
                for ids in texts[len(hits_of) + 1 :]:
                    if (size := size + len(ids)) > RUN:
                        break
                    part.append(ids)
                ids = np.concatenate(part)
                hits_of += passing(hashes[ids] if len(ids) else np.empty(0, np.uint64), np.cumsum([0, *map(len, part)]))
            for doc, ids, data, found in zip(batch.column("doc_id").to_pylist(), texts, data_of, hits_of):
                if not found:
                    continue
                th = hashes[ids]
                found.sort()
                own = xxhash.xxh64_intdigest(data, seed=(doc or 0) & 0xFFFFFFFFFFFFFFFF)
                begin, end, hits = max(0, found[0][0] - MARGIN), 0, []

                def row() -> dict:
                    seg = xxhash.xxh64_intdigest(b"%d" % begin, seed=own)
                    return {"seg": int(np.uint64(seg).view(np.int64)), "doc_id": doc, "start": begin, "toks": th[begin:end].view(np.int64).tolist(), "hits": [{"h": h, "pos": p} for p, h in hits]}

                for p, h in found:
                    if hits and p - MARGIN > end:
                        rows.append(row())
                        begin, hits = p - MARGIN, []
                    hits.append((p, h))
                    end = min(len(th), p + LONGEST + MARGIN)
                rows.append(row())
            yield pa.RecordBatch.from_pylist(rows, kind)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(of, "seg long, doc_id long, start int, toks array<long>, hits array<struct<h: long, pos: int>>").dropDuplicates(["seg"])


def best_window(equal: np.ndarray, width: int) -> tuple[int, int]:
    """(most equal tokens in a window of the width, where it starts)."""
    sums = np.convolve(equal, np.ones(width, np.int64), "valid")
    at = int(sums.argmax())
    return int(sums[at]), at


def verified(pairs: DataFrame, window: int, share: float) -> DataFrame:
    """Pairs (doc_id, start, toks, item_id, item_toks, shift) whose aligned tokens agree in `share` of a window."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("n_tokens", pa.int32()), ("n_equal", pa.int32())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                d, i = np.array(r["toks"], np.int64), np.array(r["item_toks"], np.int64)
                at = r["shift"] - r["start"]  # where the item would start in toks
                a, b = max(0, at), min(len(d), at + len(i))
                if b <= a:
                    continue
                width = min(window, len(i))
                if b - a < width:
                    continue
                n, first = best_window((d[a:b] == i[a - at : b - at]).astype(np.int64), width)
                if n >= share * width:
                    out.append({"doc_id": r["doc_id"], "item_id": r["item_id"], "doc_start": r["start"] + a + first, "n_tokens": width, "n_equal": n})
            yield pa.RecordBatch.from_pylist(out, kind)

    return pairs.mapInArrow(of, "doc_id long, item_id long, doc_start int, n_tokens int, n_equal int")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, doc_start, n_tokens, n_equal, one row for each document and item that overlap.

    A document overlaps an item if some `window` aligned tokens (the whole item if it is shorter) agree in
    `share` of the places: substitutions are tolerated. Candidates are positions at which one of the
    spaced seeds for the item's length hashes alike in both; at the default window and share they miss none.
    Tokens are words without ASCII punctuation, A-Z lower-cased. Null and empty texts and items overlap nothing; items
    of fewer than five tokens have to occur as they are. Equal rows give one row, as do rows of one id; of several best windows the
    first is told. Ids are whole numbers; rows without an id are one document. Very long texts are searched whole. Documents pass
    a filter of bounded size first, so only passages around likely hits are shuffled. Empty tables give none; extra columns are ignored.
    """
    items = stash(items_of(benchmark))
    seeds = stash(items.select("item_key", F.explode("seeds").alias("s")).select("item_key", F.col("s.h").alias("h"), F.col("s.pos").alias("at")))
    least = F.greatest(*[F.when(F.size("toks") >= x, x).otherwise(0) for x in SEEDS])
    used = [s for row in items.select(least.alias("least")).distinct().sort("least").collect() for s in seeds_of(row["least"])]
    segments = stash(passages_near_hits(docs, filter_of(seeds), used))
    hits = segments.select("seg", F.explode("hits").alias("s")).select("seg", F.col("s.h").alias("h"), F.col("s.pos").alias("pos"))
    # a seed's items are many only where items share a phrase; its hits are many where documents do: both are spread by salt
    crowd = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALTED).select(F.col("h").alias("hot"), F.least(F.ceil(F.col("n") / SALTED), F.lit(MOST_SALTS)).cast("int").alias("salts"))
    crowd = stash(crowd.join(seeds.select(F.col("h").alias("hot")).distinct(), "hot", "left_semi"))
    salted_hits = hits.join(crowd, F.col("h") == F.col("hot"), "left").select("seg", "h", "pos", F.pmod(F.xxhash64("seg"), F.coalesce("salts", F.lit(1))).alias("salt"))
    all_salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt")
    salted_seeds = seeds.join(crowd, F.col("h") == F.col("hot"), "left").select("item_key", "h", "at", all_salts)
    lined_up = salted_hits.join(salted_seeds, ["h", "salt"]).select("seg", "item_key", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    texts = items.select("item_key", "item_id", F.col("toks").alias("item_toks"))
    pairs = lined_up.join(segments.select("seg", "doc_id", "start", "toks"), "seg").join(texts, "item_key")
    found = verified(pairs.select("doc_id", "start", "toks", "item_id", "item_toks", "shift"), window, share)
    best = F.max_by(F.struct("doc_start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("doc_start"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap a benchmark item; docs' own columns, whatever their names.

    Rows are told by a 64-bit hash of their text, on which alone it depends whether they overlap: of rows that share an id, or have
    none, only those go whose own text overlaps, and copies are searched once. Other cases as in contaminated.
    """
    own = free_name(docs.columns, "bad_text")
    text = F.xxhash64(F.col("text").cast("string"))
    bad = stash(contaminated(docs.select(text.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(bad, text == F.col(own), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
