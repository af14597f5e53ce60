"""Ranked lexical search: impact-sorted posting lists per shard of documents, read by the no-random-access algorithm."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbering, arrow_batches, running, stash, table, texts_of

TOP = 10
SHARD_DOCS = 16_384  # documents of a shard, 65 536 at most, as places in it are 16-bit numbers
SHARD_TERMS = 4_000_000  # or terms of its documents, repeats counted
BLOCK_BYTES = 8 << 20  # UTF-8 bytes of the queries that are searched together
FIRST_READ = 64  # postings read of each list in the first round; each round reads twice as many

#: A-Z become a-z, other ASCII letters and digits stay, all other ASCII characters part terms; bytes from 0x80 on are of terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms) of a table with the column text."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [len(terms(x)) for x in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"n_docs": [sum(map(bool, n))], "n_terms": [sum(n)]})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(of, "n_docs long, n_terms long")
    with arrow_batches(docs.sparkSession):
        row = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


_INDEX = "shard long, term binary, n_docs int, places binary, times binary, ids array<long>, sizes array<long>"


def lengths(sizes: list[int], stats: tuple[int, int]) -> np.ndarray:
    """m of documents of so many terms."""
    return np.array([25 + 75 * n * stats[0] // max(1, stats[1]) for n in sizes], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def index(docs: DataFrame, stats: tuple[int, int], only: list[bytes] | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A written table of posting lists, a row per shard and term, and a row without a term per shard, with its documents.

    places: 16-bit numbers of the documents in the shard, by descending impact (the part of a score that the term's weight multiplies), ties by
    number; times: 32-bit counts. ids, sizes: each document's doc_id and number of terms. A shard is a run of a partition's documents,
    so nothing is shuffled. only: terms that get lists, all if None.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(only)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        kind = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int32()), ("places", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
        shard = TaskContext.get().partitionId() << 32
        wanted = None if sent.value is None else {t: i for i, t in enumerate(sent.value)}
        number = Numbering() if wanted is None else wanted
        ids, sizes, found, held = [], [], [], 0

        def cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
            """Slices of an array's bytes."""
            offsets = (bounds * data.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

        def ended() -> Iterator:
            n = len(ids)
            doc = np.repeat(np.arange(n), [len(x) for x in found])
            keys, tf = np.unique(np.concatenate(found).astype(np.int64) * n + doc, return_counts=True)
            term, doc = np.divmod(keys, n)
            order = np.lexsort((doc, -impacts(tf, lengths(sizes, stats)[doc]), term))
            first = np.flatnonzero(np.diff(term, prepend=-1))
            bounds = np.append(first, len(term))
            names = list(number)
            rows = len(first)
            lists = [pa.array([shard] * rows, pa.int64()), pa.array([names[i] for i in term[first].tolist()], pa.binary()), pa.array(np.diff(bounds), pa.int32()), cut(doc[order].astype("<u2"), bounds), cut(tf[order].astype("<u4"), bounds)]
            yield pa.RecordBatch.from_arrays([*lists, pa.nulls(rows, kind.field(5).type), pa.nulls(rows, kind.field(6).type)], schema=kind)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": ids, "sizes": sizes}], kind)

        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                own = terms(data)
                if not own:
                    continue
                size = len(own)
                if wanted is not None:
                    own = [t for t in own if t in wanted]
                ids.append(doc)
                sizes.append(size)
                found.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                held += len(own)
                if len(ids) >= shard_docs or held >= SHARD_TERMS:
                    yield from ended()
                    ids, sizes, found, held, shard = [], [], [], 0, shard + 1
                    number = Numbering() if wanted is None else wanted
        if ids:
            yield from ended()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark):
        return stash(narrow.mapInArrow(of, _INDEX))


class Postings:
    """A list with its impacts, and how far it has been read."""

    def __init__(self, places: np.ndarray, values: np.ndarray) -> None:
        self.places, self.values, self.read = places, values, 0

    def bound(self) -> int:
        """No posting that has not been read is worth more."""
        return 0 if self.read == len(self.values) else int(self.values[max(self.read - 1, 0)])


def resolved(lists: list[Postings], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best of n documents, and of all that tie with the last of them.

    Lists are read a run at a time, by descending value, and a document is never looked up in one. A document's score lies between the sum of
    the values read of it and that sum plus the bounds of the lists in which it has not been met. Reading goes on until no document
    that is not among the best, seen or unseen, can reach the k-th of them, and no interval of those that can is open. Once unseen
    documents cannot reach it, postings of others than those that still can are passed over.
    """
    lower = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    closed, run = False, FIRST_READ  # closed: unseen documents are out
    while True:
        for x in lists:
            part = slice(x.read, x.read + run)
            places, values = x.places[part], x.values[part]
            if closed:
                mine = alive[places]
                places, values = places[mine], values[mine]
            lower[places] += values  # a list has a document once
            x.read = min(x.read + run, len(x.values))
        bounds = [x.bound() for x in lists]
        unseen = sum(bounds)
        threshold = int(np.partition(lower, n - k)[n - k]) if n >= k else 0
        if unseen == 0:
            break
        if unseen < threshold:
            known = np.zeros(n, np.int64)
            for x, b in zip(lists, bounds):
                if b:
                    known[x.places[: x.read]] += b
            upper = lower + unseen - known
            alive &= upper >= threshold
            closed = True
            if not np.any(alive & (upper > lower)):
                break
        run *= 2
    best = np.flatnonzero(alive & (lower >= max(threshold, 1)))
    return best, lower[best]


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each row of queries (item_id, text), of docs (doc_id, text).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, of whole texts, A-Z lower-cased. A score sums, over a query's
    terms with repeats, floor(1000 ln((2 N + 2) / (2 df + 1))) times 10**9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L; scores of 0 are not
    told, ties go by ascending doc_id, null ids last. Null and empty texts have no terms: such documents count for nothing, such queries
    get no rows. Rows are documents and queries each, repeated rows and ids too. Very long texts are read whole. An empty table
    gives none; extra columns are ignored. Documents are indexed in shards, in which lists are read by `resolved`; the
    results of shards are merged. Queries go to the executors in blocks of block_bytes (a longer one alone): if there is one block, only its terms get lists,
    else all terms get lists once, and blocks are searched in turn.
    """
    spark = docs.sparkSession
    out = "query long, doc_id long, score long"
    items = stash(queries.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)))
    texts = items.groupBy("digest").agg(F.first("text").alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    blocks = stash(running(texts, [], ["digest"], "size", "upto").withColumn("block", F.floor((F.col("upto") - F.col("size")) / block_bytes)).withColumn("query", F.monotonically_increasing_id()))
    numbers = [row["block"] for row in blocks.select("block").distinct().sort("block").collect()]
    stats = statistics(docs) if numbers else (0, 0)
    made = None
    results = spark.createDataFrame([], out)
    for number in numbers if stats[1] else []:
        asked = {row["query"]: Counter(terms(row["text"].encode())) for row in blocks.where(F.col("block") == number).select("query", "text").toLocalIterator()}
        vocabulary = sorted(set().union(*asked.values()))
        if made is None:
            made = index(docs, stats, vocabulary if len(numbers) == 1 else None, shard_docs)
        mine = made
        if len(numbers) > 1:
            wanted = spark.createDataFrame([(bytearray(t),) for t in vocabulary], "__term binary")  # of block_bytes at most
            mine = made.join(F.broadcast(wanted), F.col("term") == F.col("__term"), "left").where("term IS NULL OR __term IS NOT NULL").drop("__term")
        held = mine.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * stats[0] + 2) / (2 * F.col("df") + 1)))
        weights = {bytes(row["term"]): row["w"] for row in held.select("term", weight.alias("w")).where("w > 0").toLocalIterator()}  # of the block's terms
        results = results.unionByName(stash(mine.groupBy("shard").applyInArrow(_searcher(spark, asked, weights, stats, top), out)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = stash(results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    named = blocks.select("query", F.col("digest").alias("__digest"))
    each = items.join(named, F.col("digest") == F.col("__digest")).select(F.col("query").alias("__query"), "item_id")
    return each.join(ranked, F.col("__query") == F.col("query")).select("item_id", "rank", "doc_id", "score")


def _searcher(spark: SparkSession, asked: dict[int, Counter], weights: dict[bytes, int], stats: tuple[int, int], top: int):
    """The best documents of one shard for each query of a block."""
    sent = spark.sparkContext.broadcast((asked, weights))

    def of(shard):
        import pyarrow as pa

        asked, weights = sent.value
        ids: list = []
        lists: dict[bytes, tuple[bytes, bytes]] = {}
        for row in shard.select(["term", "places", "times", "ids", "sizes"]).to_pylist():
            if row["term"] is None:
                ids, sizes = row["ids"], row["sizes"]
            else:
                lists[row["term"]] = row["places"], row["times"]
        m = lengths(sizes, stats)
        read: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def postings(term: bytes, times: int) -> Postings:
            if term not in read:
                places, tf = np.frombuffer(lists[term][0], "<u2").astype(np.int64), np.frombuffer(lists[term][1], "<u4").astype(np.int64)
                values = weights[term] * impacts(tf, m[places])
                read[term] = places, values[values > 0]
            places, values = read[term]
            return Postings(places, values * times)

        rows = []
        for query, bag in asked.items():
            own = [postings(t, n) for t, n in bag.items() if t in weights and t in lists]
            places, scores = resolved(own, len(ids), top) if own else ((), ())
            best = sorted((-s, ids[p] is None, ids[p] or 0) for p, s in zip(map(int, places), map(int, scores)))[:top]
            rows += [(query, None if no else d, -s) for s, no, d in best]
        columns = zip(*rows) if rows else ([], [], [])
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return of


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
l AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM l),
m AS (SELECT r, doc_id, 25 + (75 * n * nd) // nt AS m FROM l, s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
i AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS ts FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
scored AS (
  SELECT k, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
