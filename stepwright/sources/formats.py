"""Data sources for spark.read and df.write: chunked episodes with their metadata, and shards of embeddings with a manifest.

    register(spark)
    spark.read.format("lerobot").option("chunks", "0,1").load(folder)
    df.write.format("embedding_shards").option("shards", 64).mode("append").save(folder)

The driver only lists folders and names; metadata and data are read, cut and written by tasks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, LongType, StructType

from .records import chunk_filter

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Episodes)
    spark.dataSource.register(EmbeddingShards)


def place(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def names(files, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    from pyarrow import fs

    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def write_whole(files, path: str, data: bytes) -> None:
    """A file that is there as a whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, path)


def _batches(rows, schema: StructType) -> Iterator:
    """Arrow batches with the columns and types of the read schema; columns that a file lacks are null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    for batch in rows:
        columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in kind]
        yield pa.RecordBatch.from_arrays(columns, schema=kind)


# ---------------------------------------------------------------- chunked episodes
@dataclass
class MetaFile(InputPartition):
    """One task: the episodes of a metadata file, or (chunk given) those of a chunk in the list of all episodes."""

    path: str
    chunk: int | None = None
    chunk_size: int = 1000


class Episodes(DataSource):
    """Frames of a folder of chunked episodes: the columns of its data files and episode_index, chunk_index, file_index.

    Layouts: meta/episodes/chunk-*/file-*.parquet, whose episodes are rows [dataset_from_index, dataset_to_index) by the column `index` of
    data/chunk-*/file-*.parquet; or, without those, meta/episodes.jsonl and a file data/chunk-*/episode_*.parquet for each episode, of which missing ones
    are left out. Options: chunks ("0,1": only these; others are neither listed nor opened); layout (for writes: "files" or "jsonl"). With
    filters=true, for which the session has to allow PUSHDOWN, filters of episode_index and chunk_index by = and IN are taken over: chunks
    prune files, episodes prune data files.
    """

    @classmethod
    def name(cls) -> str:
        return "lerobot"

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files, root = place(self.options["path"])
        asked = chunk_filter(self.options.get("chunks"))
        for chunk in names(files, f"{root}/data"):
            if asked and int(chunk.rpartition("-")[2]) not in asked:
                continue
            for name in names(files, f"{root}/data/{chunk}"):
                found = from_arrow_schema(pq.read_schema(f"{root}/data/{chunk}/{name}", filesystem=files))
                for c in ("episode_index", "chunk_index", "file_index"):
                    found = found if c in found.names else found.add(c, LongType() if c == "episode_index" else IntegerType())
                return found
        raise FileNotFoundError(f"no data files in {root}")

    def reader(self, schema: StructType) -> EpisodeReader:
        return (FilteredReader if self.options.get("filters") == "true" else EpisodeReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> EpisodeWriter:
        return EpisodeWriter(self.options)


class EpisodeReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.root, self.schema = options["path"], schema
        self.chunks: set[int] | None = set(chunk_filter(options.get("chunks")) or ()) or None
        self.episodes: set[int] | None = None

    def partitions(self) -> list[InputPartition]:
        files, root = place(self.root)
        of = lambda name: int(name.rpartition("-")[2])
        asked = lambda folder: [c for c in names(files, folder) if re.fullmatch(r"chunk-\d+", c) and (self.chunks is None or of(c) in self.chunks)]
        meta = f"{root}/meta/episodes"
        found = [MetaFile(f"{meta}/{c}/{n}") for c in asked(meta) for n in names(files, f"{meta}/{c}") if re.fullmatch(r"file-\d+\.parquet", n)]
        if found:
            return found
        if "episodes.jsonl" not in names(files, f"{root}/meta"):
            return []
        size = 1000
        if "info.json" in names(files, f"{root}/meta"):
            with files.open_input_stream(f"{root}/meta/info.json") as f:
                size = int(json.loads(f.read()).get("chunks_size", size))
        return [MetaFile(f"{root}/meta/episodes.jsonl", of(c), size) for c in asked(f"{root}/data")]

    def read(self, partition: MetaFile) -> Iterator:
        files, root = place(self.root)
        yield from _batches(self._jsonl(files, root, partition) if partition.chunk is not None else self._slices(files, root, partition.path), self.schema)

    def _with(self, batch, **columns):
        """batch with columns of one value each."""
        import pyarrow as pa

        for c, v in columns.items():
            if c not in batch.schema.names:
                batch = batch.append_column(c, pa.repeat(pa.scalar(v, pa.int64()), batch.num_rows))
        return batch

    def _slices(self, files, root: str, meta: str) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = pq.read_table(meta, filesystem=files).to_pylist()
        own: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in rows:
            chunk, file = (r.get(f"data/{c}", r.get(c)) for c in ("chunk_index", "file_index"))
            if (self.episodes is None or r["episode_index"] in self.episodes) and (self.chunks is None or chunk in self.chunks):
                own.setdefault((chunk, file), []).append((r["dataset_from_index"], r["dataset_to_index"], r["episode_index"]))
        for (chunk, file), slices in own.items():
            slices.sort()
            begin, end, episode = (np.array(x, np.int64) for x in zip(*slices))
            data = pq.ParquetFile(f"{root}/data/chunk-{chunk:03d}/file-{file:03d}.parquet", filesystem=files)
            wanted = [c for c in data.schema_arrow.names if c in self.schema.names or c == "index"]
            for batch in data.iter_batches(columns=wanted):
                index = batch.column("index").to_numpy()
                at = np.searchsorted(begin, index, "right") - 1
                inside = (at >= 0) & (index < end[np.maximum(at, 0)])
                kept = batch.filter(pa.array(inside))
                if "episode_index" not in kept.schema.names:
                    kept = kept.append_column("episode_index", pa.array(episode[at[inside]]))
                yield self._with(kept, chunk_index=chunk, file_index=file)

    def _jsonl(self, files, root: str, partition: MetaFile) -> Iterator:
        import pyarrow.parquet as pq

        folder = f"{root}/data/chunk-{partition.chunk:03d}"
        there = set(names(files, folder))
        with files.open_input_stream(partition.path) as f:
            data = f.read()
        for line in data.splitlines():
            episode = json.loads(line).get("episode_index") if line.strip() else None
            if episode is None or episode // partition.chunk_size != partition.chunk or self.episodes is not None and episode not in self.episodes:
                continue
            name = f"episode_{episode:06d}.parquet"
            if name in there:
                file = pq.ParquetFile(f"{folder}/{name}", filesystem=files)
                for batch in file.iter_batches(columns=[c for c in file.schema_arrow.names if c in self.schema.names]):
                    yield self._with(batch, episode_index=episode, chunk_index=partition.chunk, file_index=None)


class FilteredReader(EpisodeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if column == "chunk_index":
                self.chunks = values if self.chunks is None else self.chunks & values
            elif column == "episode_index":
                self.episodes = values if self.episodes is None else self.episodes & values
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]


class EpisodeWriter(DataSourceArrowWriter):
    """Writes frames (episode_index, chunk_index, file_index, index, ...), of which a task has whole files in order; see `write_episodes`."""

    def __init__(self, options) -> None:
        self.root, self.jsonl, self.chunk_size = options["path"], options.get("layout", "files") == "jsonl", int(options.get("chunk_size", "1000"))

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, root = place(self.root)
        done, held, key = [], [], None
        own = ("episode_index",) if self.jsonl else ("chunk_index", "file_index")

        def end() -> None:
            table = pa.Table.from_batches(held)
            chunk = table.column("chunk_index")[0].as_py()
            name = f"episode_{key[0]:06d}" if self.jsonl else f"file-{key[1]:03d}"
            files.create_dir(f"{root}/data/chunk-{chunk:03d}", recursive=True)
            sink = pa.BufferOutputStream()
            pq.write_table(table.drop_columns(["chunk_index", "file_index"]), sink)
            write_whole(files, f"{root}/data/chunk-{chunk:03d}/{name}.parquet", sink.getvalue().to_pybytes())
            if not self.jsonl:
                by = table.group_by("episode_index").aggregate([("index", "min"), ("index", "max")])
                top = pa.compute.add(by.column("index_max"), 1)
                n = pa.repeat(pa.scalar(1, pa.int64()), by.num_rows)
                meta = pa.table({"episode_index": by.column("episode_index"), "chunk_index": pa.compute.multiply(n, key[0]), "file_index": pa.compute.multiply(n, key[1]), "dataset_from_index": by.column("index_min"), "dataset_to_index": top})
                files.create_dir(f"{root}/meta/episodes/chunk-{chunk:03d}", recursive=True)
                sink = pa.BufferOutputStream()
                pq.write_table(meta, sink)
                write_whole(files, f"{root}/meta/episodes/chunk-{chunk:03d}/{name}.parquet", sink.getvalue().to_pybytes())
            done.append(tuple(key))

        import pyarrow.compute  # noqa: F401

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in own]
            first = 0
            for i, now in enumerate(zip(*columns)):
                if now != key:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    if held:
                        end()
                    held, key, first = [], now, i
            held.append(batch.slice(first))
        if held and key:
            end()
        return Written(done)

    def commit(self, messages: list) -> None:
        """The list of all episodes that the layout asks for: names only, one line each."""
        if self.jsonl:
            files, root = place(self.root)
            episodes = sorted(key[0] for m in messages if m for key in m.files)
            files.create_dir(f"{root}/meta", recursive=True)
            write_whole(files, f"{root}/meta/info.json", json.dumps({"chunks_size": self.chunk_size, "total_episodes": len(episodes)}).encode())
            write_whole(files, f"{root}/meta/episodes.jsonl", "".join(f'{{"episode_index": {e}}}\n' for e in episodes).encode())


def write_episodes(frames: DataFrame, path: str, layout: str = "files", chunk_size: int = 1000) -> None:
    """Write frames (episode_index, chunk_index, file_index, index, ...) as a folder that `Episodes` reads; a file's frames meet in one task."""
    own = ["chunk_index", "episode_index"] if layout == "jsonl" else ["chunk_index", "file_index"]
    dealt = frames.repartition(*own).sortWithinPartitions(*dict.fromkeys([*own, "episode_index", "index"]))
    dealt.write.format("lerobot").option("layout", layout).option("chunk_size", chunk_size).mode("append").save(path)


# ---------------------------------------------------------------- shards of embeddings
MANIFEST = "_manifest"


def shard_name(shard: int, shards: int) -> str:
    return f"shard-{shard:05d}-of-{shards:05d}.parquet"


def finished(path: str) -> dict[int, dict]:
    """shard -> {file, rows} of the shards that a commit has told: a small file for each, however many runs it took."""
    files, root = place(path)
    out = {}
    for name in names(files, f"{root}/{MANIFEST}"):
        if name.endswith(".json"):
            with files.open_input_stream(f"{root}/{MANIFEST}/{name}") as f:
                out[int(name[:5])] = json.loads(f.read())
    return out


class EmbeddingShards(DataSource):
    """A folder of shards, each one Parquet file that counts once the manifest names it.

    Writes (rows with `shard`; option shards) put each shard in a file of its own name and attempt; the commit enters whole shards in the manifest, so
    a failed or repeated task leaves nothing that is read. Reads give the rows of finished shards, without rows whose vector (option vector,
    length dim) is null or of another length; option problems=true gives instead (shard, file, problem) of what is missing or malformed.
    """

    @classmethod
    def name(cls) -> str:
        return "embedding_shards"

    def schema(self) -> StructType | str:
        if self.options.get("problems") == "true":
            return "shard int, file string, problem string"
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files, root = place(self.options["path"])
        for entry in finished(self.options["path"]).values():
            try:
                return from_arrow_schema(pq.read_schema(f"{root}/{entry['file']}", filesystem=files))
            except Exception:  # noqa: BLE001, S112  a malformed shard: another one tells
                continue
        raise FileNotFoundError(f"no readable shard in {root}")

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


@dataclass
class Shard(InputPartition):
    shard: int
    file: str | None
    rows: int


class ShardReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.root, self.schema, self.problems = options["path"], schema, options.get("problems") == "true"
        self.shards, self.vector, self.dim = int(options.get("shards", "0")), options.get("vector"), int(options.get("dim", "0"))

    def partitions(self) -> list[InputPartition]:
        there = finished(self.root)
        lacking = [Shard(i, None, 0) for i in range(self.shards) if i not in there] if self.problems else []
        return [*(Shard(i, x["file"], x["rows"]) for i, x in sorted(there.items())), *lacking]

    def _good(self, batch):
        import pyarrow.compute as pc

        if not self.vector:
            return batch
        return batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(self.vector)), self.dim), False))

    def read(self, partition: Shard) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, root = place(self.root)
        problem = None if partition.file else "missing"
        if partition.file:
            try:
                file = pq.ParquetFile(f"{root}/{partition.file}", filesystem=files)
                if file.metadata.num_rows != partition.rows:
                    problem = f"{file.metadata.num_rows} rows of {partition.rows}"
            except Exception as e:  # noqa: BLE001  told by `problems`
                problem = f"unreadable: {type(e).__name__}"
        if problem is None and not self.problems:
            wanted = [c for c in file.schema_arrow.names if c in self.schema.names or c == self.vector]
            yield from _batches((self._good(b) for b in file.iter_batches(columns=wanted)), self.schema)
        elif self.problems:
            if problem is None and self.vector:
                bad = sum(b.num_rows - self._good(b).num_rows for b in file.iter_batches(columns=[self.vector]))
                problem = f"{bad} malformed rows" if bad else None
            if problem:
                yield from _batches([pa.RecordBatch.from_pydict({"shard": [partition.shard], "file": pa.array([partition.file], pa.string()), "problem": [problem]})], self.schema)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.root, self.shards = options["path"], int(options["shards"])

    def write(self, iterator: Iterator) -> Written:
        """A task's shards come one after another (see write_shards), so one file is open at a time and batches stream through."""
        import pyarrow.parquet as pq
        import pyarrow.compute as pc

        files, root = place(self.root)
        files.create_dir(root, recursive=True)
        attempt, done, out, now, rows = uuid.uuid4().hex, [], None, None, 0

        def end() -> None:
            out.close()
            done.append((now, f"{attempt}-{shard_name(now, self.shards)}", rows))

        for batch in iterator:
            shard = batch.column("shard")
            for s in pc.unique(shard).to_pylist():
                part = batch.filter(pc.equal(shard, s))
                if s != now:
                    if out:
                        end()
                    if any(s == x[0] for x in done):
                        raise ValueError(f"rows of shard {s} are not in one piece")
                    now, rows = s, 0
                    out = pq.ParquetWriter(f"{root}/{attempt}-{shard_name(s, self.shards)}", part.schema, filesystem=files)
                out.write_batch(part)
                rows += part.num_rows
        if out:
            end()
        return Written(done)

    def commit(self, messages: list) -> None:
        files, root = place(self.root)
        told = [x for m in messages if m for x in m.files]
        if len({s for s, *_ in told}) < len(told):
            raise ValueError("a shard was written by two tasks")
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        for shard, file, rows in told:
            write_whole(files, f"{root}/{MANIFEST}/{shard:05d}.json", json.dumps({"file": file, "rows": rows}).encode())

    def abort(self, messages: list) -> None:
        files, root = place(self.root)
        for m in messages:
            for _, file, _ in m.files if m else ():
                files.delete_file(f"{root}/{file}")


def write_missing_shards(rows: DataFrame, path: str, shards: int) -> None:
    """Write the shards of rows (with `shard`) that the manifest does not name yet; a run that broke off is resumed by calling it again."""
    there = sorted(finished(path))  # a number for each shard
    todo = rows.where(~F.col("shard").isin(there)) if there else rows
    dealt = todo.repartition(shards, "shard").sortWithinPartitions("shard")
    dealt.write.format("embedding_shards").option("shards", shards).mode("append").save(path)
