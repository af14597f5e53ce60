"""Alignment of two tokenizers' ids of the same texts, and how often ids meet over the whole corpus."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stash, table
from .pieces import PieceEncoder, printable_bytes

BLOCK_LINKS = 2_000_000  # a block of documents ends after so many links
BLOCK_DOCS = 20_000  # or so many documents
MOST_CHUNKS = 250_000  # aligned chunks that a worker remembers, in each of two generations
B_BITS = 32  # an id pair is the number a << 32 | b

#: Characters at which a text is not parted into chunks: rare spaces, letters beyond U+024F, and what normalisers change.
_WHOLE = re.compile("[\x00-\x08\x0b-\x1f\x7f\x85\xa0\xadİıŉſɐ-\U0010ffff]")
_CHUNK = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")


def align(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(groups, links) of two id lists over the same bytes; sizes: bytes of each id.

    The ends of the tokens of each side are keys of a dictionary to the place behind the token; ends that both have are found as an
    intersection of the key sets and, sorted, cut both lists into groups (from, to in a; from, to in b). A link is the number
    a << 32 | b of two tokens of a group whose byte ranges overlap.
    """
    ends_a, ends_b, groups, links = {}, {}, [], []
    end = 0
    for i, x in enumerate(a, 1):
        end += a_size[x]
        ends_a[end] = i
    end = 0
    for i, x in enumerate(b, 1):
        end += b_size[x]
        ends_b[end] = i
    i = j = 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        p, q = ends_a[end], ends_b[end]
        groups.append((i, p, j, q))
        if p - i == 1 or q - j == 1:  # one token spans the group
            links += [x << B_BITS | y for x in a[i:p] for y in b[j:q]]
        else:
            x_end, y_end = a_size[a[i]], b_size[b[j]]
            while True:
                links.append(a[i] << B_BITS | b[j])
                on_a, on_b = x_end <= y_end, y_end <= x_end
                if on_a:
                    i += 1
                if on_b:
                    j += 1
                if i == p or j == q:
                    break
                if on_a:
                    x_end += a_size[a[i]]
                if on_b:
                    y_end += b_size[b[j]]
        i, j = p, q
    return groups, links


class Aligner:
    """Two tokenizers side by side; a worker remembers aligned chunks of text (white space and the word behind it).

    No token of either tokenizer crosses from a word into white space (which is seen from their pieces, else texts are taken whole), so
    a chunk's ends are ends of both and the text's groups are those of its chunks.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.a = PieceEncoder(a_path)
        self.a.library.encode_special_tokens = True  # their strings in a text are plain text
        letters = {c: b for b, c in printable_bytes().items()}
        vocabulary = self.a.library.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes([letters[c] for c in piece]) if all(c in letters for c in piece) else piece.encode()
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.line = self.b.encode("\n")
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        # dummy space in front, nothing normalised, no piece into white space
        as_it_is = len(self.line) == 2 and self._b_bytes(self.b.encode("a  b\tc\n d")) == b" a  b\tc\n d"
        self.parted = self.a.chunk is not None and not self.a.lower and as_it_is and not any(re.search(r"[^ \t\n][ \t\n]", p) for p in plain)
        self.stops = self.parted and not any(c.isalpha() and d in ".," for p in plain for c, d in zip(p, p[1:]))
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _b_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.b_bytes[i] for i in ids])

    def _value(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(groups as text, links as 64-bit numbers, tokens of a, of b, groups), or None if the tokens do not spell the text."""
        data = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or self._b_bytes(b) != data:
            return None
        groups, links = align(a, b, self.a_size, self.b_size)
        told = ";".join([f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}" for i, p, j, q in groups])
        return told.encode(), array("q", links).tobytes(), len(a), len(b), len(groups)

    def _new(self, chunk: str) -> tuple | None:
        out = self.old.get(chunk)
        if out is None:
            if self.stops and chunk[-1] in ".," and chunk[-2:-1].isalpha():
                word = self.young.get(chunk[:-1]) or self._new(chunk[:-1])
                stop = self.young.get(chunk[-1]) or self._new(chunk[-1])
                out = word and stop and (word[0] + b";" + stop[0], word[1] + stop[1], word[2] + stop[2], word[3] + stop[3], word[4] + stop[4])
            else:
                a = array("I", self.a.ids_of_chunk(chunk)).tolist()
                if chunk[0] == " ":  # the library puts one in front
                    out = self._value(chunk, a, self.b.encode(chunk[1:]))
                else:  # behind a line feed, which is a byte of its own, nothing joins that space
                    b = self.b.encode("\n" + chunk)
                    out = self._value(chunk, a, b[2:]) if b[:2] == self.line else None
            if out is None:
                return None
        if len(self.young) >= MOST_CHUNKS:  # the younger memory becomes the older one
            self.old, self.young = self.young, {}
        self.young[chunk] = out
        return out

    def __call__(self, text: str) -> tuple | None:
        """What _value tells of space + text; None: no tokens."""
        if not text:
            return None
        whole = " " + text
        if self.parted and not _WHOLE.search(text):
            known, new = self.young.get, self._new
            parts = []
            for c in _CHUNK.findall(whole):
                v = known(c)
                if v is None:
                    v = new(c)
                    known = self.young.get  # a new generation may have begun
                    if v is None:
                        break
                parts.append(v)
            else:
                return b";".join([v[0] for v in parts]), b"".join([v[1] for v in parts]), sum([v[2] for v in parts]), sum([v[3] for v in parts]), sum([v[4] for v in parts])
        return self._value(whole, self.a.library.encode(whole, add_special_tokens=False).ids, self.b.encode(text))


_made: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner; its memory outlives a task."""
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs, as compressed 32-bit steps."""
    import pyarrow as pa

    return pa.compress(np.concatenate([np.diff(numbers, prepend=0), times]).astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    both = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, n_pairs int, links binary, pairs array<long>, n_docs array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written table of documents and blocks: each document's groups and packed links, each block's id pairs.

    A partition's documents are taken in blocks of about BLOCK_LINKS links. Rows with `pairs` are a block's: its id pairs and how many of
    its documents hold each. Other rows are documents; `links` names places of those pairs.
    """

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        one = aligner(a_path, b_path)
        kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("block", pa.int64()), ("n_pairs", pa.int32()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        codes: list[np.ndarray] = []
        held = 0

        def ended():
            """The block's rows."""
            n = np.array([len(x) for x in codes], np.int64)
            pairs, number = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_inverse=True)
            own = np.repeat(np.arange(len(codes)), n) * max(1, len(pairs)) + number
            own, times = np.unique(own, return_counts=True)
            doc, number = np.divmod(own, max(1, len(pairs)))
            cuts = np.searchsorted(doc, np.arange(len(codes) + 1))
            packed = [_packed(number[i:j], times[i:j]) for i, j in zip(cuts, cuts[1:])]
            columns = [pa.array(x, kind.field(k).type) for k, x in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([block] * len(rows), pa.int64()), pa.array(np.diff(cuts), pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int64()))], schema=kind)
            if len(pairs):
                arrays = [pa.ListArray.from_arrays([0, len(pairs)], pa.array(x, pa.int64())) for x in (pairs, np.bincount(number, minlength=len(pairs)))]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind.field(k).type) for k in range(6)], pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *arrays], schema=kind)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                told, links, n_a, n_b, n_groups = one(text) or (b"", b"", 0, 0, 0)
                rows.append((doc, n_a, n_b, n_groups, len(links) // 8, hashlib.sha256(told).hexdigest() if told else ""))
                codes.append(np.frombuffer(links, np.int64))
                held += len(links) // 8
                if held >= BLOCK_LINKS or len(rows) >= BLOCK_DOCS:
                    yield from ended()
                    rows, codes, held, block = [], [], 0, block + 1
        if rows:
            yield from ended()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession):
        return stash(narrow.mapInArrow(of, _DOC))


def pair_counts(written: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (no other pair of its A id has more) of every id pair of an aligned table."""
    held = written.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    # an A id has a pair for each B id at most
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    return counts.withColumn("best", (F.col("count") == most).cast("long"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text), of whole texts.

    space + text is encoded by A, text by B, which adds the space; both without special tokens, whose strings are plain text. Texts
    that are null or empty, or that the tokens of A or B do not spell byte by byte, have no tokens: zeros and ''. Rows are
    documents each, repeated rows and ids as well as null ids; ties for an A id's highest count are all best. Very long texts are aligned
    whole, by one task, as a block of their own. An empty table gives an empty one; extra columns are ignored. Counts are over
    all documents: each block of documents sends its distinct pairs once, and gets their counts back.
    """
    written = aligned(docs, a_path, b_path)
    counts = stash(pair_counts(written)).withColumnRenamed("pair", "__pair")
    theirs = written.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "pair"))
    back = theirs.join(counts, F.col("pair") == F.col("__pair")).select("block", "at", "count", "best")
    rows = written.where("pairs IS NULL").drop("pairs", "n_docs")

    def scored(left, right):
        import pyarrow as pa

        places = right.column("at").to_numpy()
        count, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        count[places], best[places] = right.column("count").to_numpy(), right.column("best").to_numpy()
        sums, bests = [], []
        for data, n in zip(left.column("links").to_pylist(), left.column("n_pairs").to_pylist()):
            number, times = _unpacked(data, n)
            sums.append(int(count[number] @ times))
            bests.append(int(best[number] @ times))
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", left.column("groups_sha256"))

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    back = back.withColumnRenamed("block", "__block")
    return rows.groupBy("block").cogroup(back.groupBy("__block")).applyInArrow(scored, out)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
