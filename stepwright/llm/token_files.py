"""Token ids in files of wavelet matrices."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stash, table
from .pieces import encoder

END = 2
SHARD_TOKENS = 4_000_000  # ids of a file; a task holds one file's ids at a time
MAGIC = b"WMX2"
CHUNK_LOG2 = 17  # bits of a plane that are compressed together, and of which the ones before are stored
SPAN = 1 << 23  # ids that are read at once: as a rule a whole file


class Plane:
    """A bit plane with ranks: words of 64 bits and the ones before each; chunks of a file are fetched when they are asked for."""

    def __init__(self, n: int, before: np.ndarray, load: Callable[[int, int], np.ndarray]) -> None:
        """before: ones before each chunk and, last, in all; load(first, end): the words of some neighbouring chunks."""
        self.n, self.before, self.load = n, before, load
        size = (n + 63) // 64
        self.words, self.ranks = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint32)
        self.words[size], self.ranks[size] = 0, before[-1]
        self.there = np.zeros(len(before) - 1, bool)
        self.zeros = n - int(before[-1])

    def _fetch(self, at: np.ndarray) -> None:
        """Have the chunks of all positions; neighbours that lack come by one read."""
        if self.there.all() or not len(at):
            return
        asked = np.zeros(len(self.there), bool)
        asked[np.minimum(at, self.n - 1) >> CHUNK_LOG2] = True
        lacking = np.flatnonzero(asked & ~self.there)
        for run in np.split(lacking, np.flatnonzero(np.diff(lacking) > 1) + 1) if len(lacking) else ():
            words = self.load(int(run[0]), int(run[-1]) + 1)
            begin = int(run[0]) << (CHUNK_LOG2 - 6)
            self.words[begin : begin + len(words)] = words
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.ranks[begin : begin + len(words)] = int(self.before[run[0]]) + np.r_[0, ones[:-1]]
            self.there[run] = True

    def bits(self, at: np.ndarray) -> np.ndarray:
        self._fetch(at)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bits of some runs of positions, in order; long runs are unpacked, short ones gathered."""
        sizes = end - begin
        if 64 * len(sizes) > sizes.sum():
            at = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            return self.bits(at).astype(bool)
        out = []
        for a, b in zip(begin.tolist(), end.tolist()):
            self._fetch(np.r_[np.arange(a, b, 1 << CHUNK_LOG2), b - 1])
            first = a >> 6
            words = self.words[first : (b + 63) >> 6]
            out.append(np.unpackbits(words.view(np.uint8), bitorder="little")[a - (first << 6) : b - (first << 6)].view(bool))
        return np.concatenate(out)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position, from 0 to n."""
        self._fetch(at)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[at >> 6].astype(np.int64) + np.bitwise_count(self.words[at >> 6] & mask)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero: its chunk by the stored ranks, then by bisection."""
        counts = self.before if bit else np.minimum(np.arange(len(self.before)) << CHUNK_LOG2, self.n) - self.before
        chunk = int(np.searchsorted(counts, k, "right")) - 1
        low, high = chunk << CHUNK_LOG2, min(self.n, (chunk + 1) << CHUNK_LOG2)
        while low < high:
            mid = (low + high) // 2
            ones = int(self.rank1(np.array([mid + 1]))[0])
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low


class WaveletMatrix:
    """Bit planes of a sequence, most significant first, each stably parted by the plane before.

    access, count and find walk the planes, so they take logarithmic time in the alphabet and read only the chunks they meet.
    """

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, values: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        n, planes = len(values), []
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            plane = (now & now.dtype.type(1 << b)) != 0
            padded = np.zeros((n + 63) // 64 * 64, bool)
            padded[:n] = plane
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            planes.append(Plane(n, chunk_ranks(words), lambda first, end, w=words: w[first << (CHUNK_LOG2 - 6) : end << (CHUNK_LOG2 - 6)]))
            zeros = n - np.count_nonzero(plane)
            parted = np.empty_like(now)
            np.compress(~plane, now, out=parted[:zeros])
            np.compress(plane, now, out=parted[zeros:])
            now = parted
        return cls(n, planes)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for plane in self.planes:
            bit = plane.bits(at)
            one = plane.rank1(at)
            at = np.where(bit == 1, plane.zeros + one, at - one)
            out = out << 1 | bit.astype(np.uint32)
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """Values at positions begin to end - 1.

        Going down, a run of positions becomes two in the next plane, its zeros and its ones; runs that touch are one, so
        that a whole sequence stays one run. Going up, the bits that were met put the values back into their order.
        """
        if begin >= end:
            return np.empty(0, np.uint32)
        a, b, met = np.array([begin], np.int64), np.array([end], np.int64), []
        for plane in self.planes:
            met.append(plane.runs(a, b))
            ra, rb = plane.rank1(a), plane.rank1(b)
            a, b = np.r_[a - ra, plane.zeros + ra], np.r_[b - rb, plane.zeros + rb]
            some = a < b
            a, b = a[some], b[some]
            apart = np.r_[True, a[1:] != b[:-1]]
            a, b = a[apart], b[np.r_[apart[1:], True]]
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(end - begin, kind)
        for level, bits in enumerate(met[::-1]):
            back = np.empty_like(out)
            zeros = len(bits) - np.count_nonzero(bits)
            back[~bits] = out[:zeros]
            back[bits] = out[zeros:] | kind(1 << level)
            out = back
        return out.astype(np.uint32)

    def _ranges(self, value: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of a value at positions begin to end - 1 stand below the last plane."""
        a, b = np.asarray(begin, np.int64), np.asarray(end, np.int64)
        if value >> len(self.planes):
            return np.zeros_like(a), np.zeros_like(a)
        for p, plane in enumerate(self.planes):
            ra, rb = plane.rank1(a), plane.rank1(b)
            a, b = (plane.zeros + ra, plane.zeros + rb) if value >> (len(self.planes) - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def counts(self, value: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of a value in each span of positions."""
        a, b = self._ranges(value, begin, end)
        return b - a

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a value at positions begin to end - 1."""
        return int(self.counts(value, np.array([begin]), np.array([self.n if end is None else end]))[0])

    def find(self, value: int, k: int) -> int | None:
        """Position of the k-th (from 0) occurrence of a value, None beyond the last."""
        a, b = (int(x[0]) for x in self._ranges(value, np.array([0]), np.array([self.n])))
        if not 0 <= k < b - a:
            return None
        at = a + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - p) & 1
            at = self.planes[p].select(bit, at - self.planes[p].zeros if bit else at)
        return at


def chunk_ranks(words: np.ndarray) -> np.ndarray:
    """Ones before each chunk and in all."""
    ones = np.bitwise_count(words).astype(np.int64)
    starts = np.arange(0, len(words), 1 << (CHUNK_LOG2 - 6))
    return np.r_[0, np.cumsum(np.add.reduceat(ones, starts))] if len(words) else np.zeros(1, np.int64)


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """One file: header, directory, documents, chunks.

    Directory: for each plane the ones before each chunk, and where each chunk begins. Documents: whether each has an id, ids,
    lengths, compressed. A chunk is compressed by itself, or raw where that is not shorter.
    """
    ids = np.array([x or 0 for x in doc_ids], np.int64)
    there = np.array([x is not None for x in doc_ids], np.uint8)
    head = zlib.compress(there.tobytes() + ids.tobytes() + lengths.astype(np.int64).tobytes(), 1)
    chunks = []
    for plane in matrix.planes:
        for c in range(len(plane.there)):
            raw = plane.load(c, c + 1).tobytes()
            small = zlib.compress(raw, 1)
            chunks.append(small if len(small) < len(raw) else raw)
    directory = np.r_[np.concatenate([p.before for p in matrix.planes]), np.cumsum([0, *map(len, chunks)])].astype(np.int64).tobytes()
    return b"".join([MAGIC, struct.pack("<qqqqq", matrix.n, len(ids), len(matrix.planes), len(directory), len(head)), directory, head, *chunks])


def opened(read: Callable[[int, int], bytes]) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(ids, lengths, matrix) of a file of which read(offset, size) gives a range; planes are read as they are asked for."""
    first = read(0, 44)
    if first[:4] != MAGIC:
        raise ValueError("not a token file")
    n, docs, bits, dir_size, head_size = struct.unpack_from("<qqqqq", first, 4)
    directory = np.frombuffer(read(44, dir_size), np.int64)
    head = zlib.decompress(read(44 + dir_size, head_size))
    there = np.frombuffer(head, np.uint8, docs)
    ids, lengths = np.frombuffer(head, np.int64, docs, docs), np.frombuffer(head, np.int64, docs, docs * 9)
    chunks = (n + (1 << CHUNK_LOG2) - 1) >> CHUNK_LOG2
    offsets = directory[bits * (chunks + 1) :] + 44 + dir_size + head_size

    def loader(plane: int) -> Callable[[int, int], np.ndarray]:
        def load(begin: int, end: int) -> np.ndarray:
            own = offsets[plane * chunks + begin : plane * chunks + end + 1]
            data = read(int(own[0]), int(own[-1] - own[0]))
            parts = []
            for c, a, b in zip(range(begin, end), own[:-1] - own[0], own[1:] - own[0]):
                size = (min(n, (c + 1) << CHUNK_LOG2) - (c << CHUNK_LOG2) + 63) // 64 * 8
                parts.append(data[a:b] if b - a == size else zlib.decompress(data[a:b]))
            return np.frombuffer(b"".join(parts), np.uint64)

        return load

    planes = [Plane(n, directory[p * (chunks + 1) : (p + 1) * (chunks + 1)], loader(p)) for p in range(bits)]
    return [int(i) if t else None for i, t in zip(ids, there)], lengths, WaveletMatrix(n, planes)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    return opened(lambda offset, size: data[offset : offset + size])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts (null: empty), each with the end id behind, in ascending doc_id order, and write the files.

    Returns the manifest: part, seq (files in order), n_docs, n_tokens, first_token, path. Each attempt of a
    task writes files under names of its own; the manifest names those of the attempts that succeeded.
    Null ids come first; equal ids stand next to each other. Ids are whole numbers. Repeated rows are documents like any others;
    a very long text is one document of one file. An empty table gives an empty manifest; extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        own, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        ids: list[int | None] = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        held, seq = 0, 0
        last = np.uint32(end).tobytes()

        def flushed():
            nonlocal held, seq
            values = np.frombuffer(b"".join(chunks), np.uint32)
            name = f"{base}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(name) as out:
                out.write(to_bytes(ids, np.array(lengths, np.int64), WaveletMatrix.of(values)))
            row = [part, seq, len(ids), len(values), name]
            for x in (ids, lengths, chunks):
                x.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["part", "seq", "n_docs", "n_tokens", "name"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = own.ids(text or "") + last
                ids.append(doc)
                lengths.append(len(data) // 4)
                chunks.append(data)
                held += len(data) // 4
                if held >= shard_tokens:
                    yield flushed()
        if ids:
            yield flushed()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = stash(ordered.mapInArrow(of, "part int, seq int, n_docs long, n_tokens long, name string"))
    # a row of this table stands for millions of ids: parts are summed first, and files are numbered within their part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    begun = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begun"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = files.withColumn("__inside", inside).join(begun, F.col("part") == F.col("__part"))
    return numbered.select("part", "seq", "n_docs", "n_tokens", (F.col("__begun") + F.col("__inside")).alias("first_token"), F.col("name").alias("path"))


def read_token_files(manifest: DataFrame, folder: str, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_end of every document, all from the files of a manifest.

    Documents' ids are read span by span, and their end ids counted by ranks, in the compressed files. A document without an id
    keeps none; an empty manifest gives an empty table.
    """

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    ids, lengths, matrix = opened(lambda offset, size: f.read_at(size, offset))
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    crc: list[int] = []
                    while len(crc) < len(ids):
                        first = len(crc)
                        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SPAN, "right")))
                        values = matrix.span(int(starts[first]), int(ends[last - 1])).astype("<u4")
                        crc += [zlib.crc32(values[a:b]) for a, b in zip((starts[first:last] - starts[first]).tolist(), (ends[first:last] - starts[first]).tolist())]
                    n_end = matrix.counts(end, starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + row["first_token"]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(n_end)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_end"])

    # a file is a task's work: as many parts as files, which Spark doesn't join to fewer
    spread = manifest.repartition(max(1, manifest.count()), F.xxhash64("part", "seq"))
    return spread.mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(manifest, folder)
