"""spark.read.format("blockimage"): raw images as rows of fixed-size blocks, read in parallel byte ranges."""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

BLOCK = 512
SCHEMA = "image_id string, block_id long, offset long, data binary"
#: Bytes that one task reads, and that it reads at once.
PARTITION_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Above so many tasks each reads more, so that the driver's list of them doesn't grow with the data.
MOST_TASKS = 100_000
#: So many tasks are no burden, however little each reads.
FEW_TASKS = 64
#: Files of a write that isn't finished are below a folder of this name.
PENDING = ".pending"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local path or a URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def open_input(path: str):
    where, at = filesystem(path)
    return where.open_input_file(at)


def image_files(path: str) -> list[tuple[str, str, int]]:
    """(image id, path, bytes) of a file, of all files below a folder, or of those below a folder that match a last part with * or ?.

    An image's id is its path below the folder, so files of one name in two folders are two images.
    """
    where, at = filesystem(path)
    prefix = path[: len(path) - len(at)]
    head, _, last = at.rstrip("/").rpartition("/")
    if any(c in last for c in "*?"):
        found = [f for f in where.get_file_info(fs.FileSelector(head)) if fnmatch.fnmatchcase(f.base_name, last)]
        root = head
    else:
        info = where.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        root = head if info.type == fs.FileType.File else at.rstrip("/")
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
    files = sorted((f.path[len(root) :].lstrip("/"), prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f"/{PENDING}" not in f.path)
    if not files:
        raise FileNotFoundError(path)
    return files


def part_of(image: str) -> tuple[str, int]:
    """(image id, first block) of a file: a split image is a folder of files <first block>.part."""
    folder, _, name = image.rpartition("/")
    return (folder, int(name[:-5])) if folder and name.endswith(".part") and name[:-5].isdigit() else (image, 0)


class ByteRange(InputPartition):
    """Blocks first to last of an image, from a file that begins with block begin."""

    def __init__(self, image: str, path: str, begin: int, first: int, last: int):
        self.image, self.path, self.begin, self.first, self.last = image, path, begin, first, last


class ByteRanges(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[ByteRange]):
        self.ranges = ranges


def packed(ranges: list[ByteRange], blocks: int) -> list[ByteRanges]:
    """The ranges in tasks of up to so many blocks, in order: a task of its own for each of many small images would cost more than its bytes.

    Up to FEW_TASKS of them stay apart.
    """
    blocks = min(blocks, sum(r.last - r.first + 1 for r in ranges) // FEW_TASKS)
    out, room = [], 0
    for r in ranges:
        n = r.last - r.first + 1
        if not out or n > room:
            out.append(ByteRanges([]))
            room = blocks
        out[-1].ranges.append(r)
        room -= n
    return out or [ByteRanges([])]


class BlockImageSource(DataSource):
    """Options: path (see image_files; a place that all executors can read), start_block and end_block
    (inclusive), block_size, partition_bytes. The last block of an image may be short; an empty image has none.
    Filters on block_id and image_id decide which byte ranges are read."""

    @classmethod
    def name(cls) -> str:
        return "blockimage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BlockImageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BlockImageStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockImageWriter(self.options["path"], overwrite)


class BlockImageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("block_size", BLOCK))
        self.start = int(options.get("start_block", 0))
        self.end = int(options["end_block"]) if "end_block" in options else None
        self.part = int(options.get("partition_bytes", PARTITION_BYTES))
        self.images: set[str] | None = None
        if self.start < 0 or self.size < 1:
            raise ValueError("start_block and block_size must be positive")

    def _between(self, first: int | None, last: int | None) -> None:
        if first is not None:
            self.start = max(self.start, first)
        if last is not None:
            self.end = last if self.end is None else min(self.end, last)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the ranges; filters that ranges express in full aren't applied again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("block_id",) and isinstance(f, EqualTo):
                self._between(f.value, f.value)
            elif column == ("block_id",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._between(f.value + isinstance(f, GreaterThan), None)
            elif column == ("block_id",) and isinstance(f, LessThan | LessThanOrEqual):
                self._between(None, f.value - isinstance(f, LessThan))
            elif column == ("image_id",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.images = own if self.images is None else self.images & own
            else:
                yield f

    def partitions(self) -> list[ByteRanges]:
        files, out = image_files(self.path), []
        step = max(1, max(self.part, sum(size for *_, size in files) // MOST_TASKS) // self.size)
        for file, path, size in files:
            image, begin = part_of(file)
            if self.images is None or image in self.images:
                last = begin - (-size // self.size) - 1
                last = last if self.end is None else min(last, self.end)
                out += [ByteRange(image, path, begin, a, min(a + step - 1, last)) for a in range(max(self.start, begin), last + 1, step)]
        return packed(out, step)

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self._blocks(r)

    def _blocks(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        per = max(1, READ_BYTES // self.size)
        with open_input(partition.path) as f:
            for a in range(partition.first, partition.last + 1, per):
                at = (a - partition.begin) * self.size
                data = f.read_at(min(per * self.size, (partition.last + 1 - a) * self.size, f.size() - at), at)
                n = -(-len(data) // self.size)
                ids = np.arange(a, a + n)
                ends = np.minimum(np.arange(n + 1) * self.size, len(data)).astype(np.int32)
                blocks = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                image = pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [partition.image]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([image, pa.array(ids, pa.int64()), pa.array(ids * self.size, pa.int64()), blocks], ["image_id", "block_id", "offset", "data"])


def read_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of images; filters on block_id and image_id are pushed down to the byte ranges."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockImageSource)
    return spark.read.format("blockimage").options(**{k: str(v) for k, v in options.items()}).load(path)


class BlockImageStream(DataSourceStreamReader):
    """Image files as they come: an offset is the set of files seen, as hashes of their paths. A file must be put in place whole, and stay.

    Options: path (a folder), partition_bytes, block_size, files_per_batch.
    """

    def __init__(self, options):
        self.options, self.limit = options, int(options.get("files_per_batch", 1000))

    @staticmethod
    def _mark(path: str) -> str:
        return hashlib.sha256(path.encode()).hexdigest()[:16]

    def _files(self) -> dict[str, tuple[str, str, int]]:
        try:
            return {self._mark(path): (file, path, size) for file, path, size in image_files(self.options["path"])}
        except FileNotFoundError:
            return {}

    def initialOffset(self) -> dict:
        self.last = set()
        return {"seen": ""}

    def latestOffset(self) -> dict:
        seen = getattr(self, "last", set())
        new = sorted(set(self._files()) - seen)[: self.limit]
        self.last = seen | set(new)
        return {"seen": " ".join(sorted(self.last))}

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        before, after = set(start["seen"].split()), set(end["seen"].split())
        self.last = getattr(self, "last", set()) | after
        files, size = self._files(), int(self.options.get("block_size", BLOCK))
        if lost := after - before - set(files):
            raise FileNotFoundError(f"{len(lost)} files of a batch are gone")
        step, out = max(1, int(self.options.get("partition_bytes", PARTITION_BYTES)) // size), []
        for file, path, n in sorted(files[k] for k in after - before):
            image, begin = part_of(file)
            last = begin - (-n // size) - 1
            out += [ByteRange(image, path, begin, a, min(a + step - 1, last)) for a in range(begin, last + 1, step)]
        return packed(out, step)

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        return BlockImageReader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    """(where a file lies, where it belongs) for all files of a task."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class BlockImageWriter(DataSourceArrowWriter):
    """Blocks (image_id, block_id, data; of one size but for the last of an image) as image files below a folder.

    A task writes each stretch of an image that comes to it in order as a file, <image_id>/<first block>.part, below a
    folder of the attempt's own. The commit puts all files in place; files of attempts that failed, and all of them
    when the job does, are deleted. overwrite deletes what the folder had.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = filesystem(self.path)
        own = f"{root}/{PENDING}-{self.job}/{uuid.uuid4().hex}"
        out, now, next_, files = None, None, None, []
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                image, k, data = (b.column(b.schema.get_field_index(c)) for c in ("image_id", "block_id", "data"))
                ids, who = k.to_numpy(), image.dictionary_encode()
                code, names = who.indices.to_numpy(), who.dictionary.to_pylist()
                turns = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1] + 1)])
                for i, j in zip(turns.tolist(), [*turns[1:].tolist(), len(ids)]):  # blocks that follow each other, by one write
                    name, first = names[code[i]], int(ids[i])
                    if (name, first) != (now, next_):
                        if out:
                            out.close()
                        where.create_dir(f"{own}/{name}", recursive=True)
                        part = f"{name}/{first:012d}.part"
                        out, now = where.open_output_stream(f"{own}/{part}", compression=None), name
                        files.append((f"{own}/{part}", f"{root}/{part}"))
                    out.write(b"".join(data.slice(i, j - i).to_pylist()))
                    next_ = first + j - i
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, root = filesystem(self.path)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not f.base_name.startswith(PENDING):
                    where.delete_dir(f.path) if f.type == fs.FileType.Directory else where.delete_file(f.path)
        for src, dst in (x for m in messages if m for x in m.files):
            where.create_dir(dst.rsplit("/", 1)[0], recursive=True)
            where.move(src, dst)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        where, root = filesystem(self.path)
        if where.get_file_info(f"{root}/{PENDING}-{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{PENDING}-{self.job}")


def write_images(blocks: DataFrame, folder: str, mode: str = "append") -> None:
    """Blocks (image_id, block_id, data) as image files in folder, a file for each 32 MB of an image; the source reads an image's files as one."""
    blocks.sparkSession.dataSource.register(BlockImageSource)
    rows = blocks.select("image_id", "block_id", "data").repartition("image_id", F.call_function("shiftright", "block_id", F.lit(16))).sortWithinPartitions("image_id", "block_id")
    rows.write.format("blockimage").mode(mode).save(folder)


def stream_images(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the blocks of image files that come into the folder path."""
    spark.dataSource.register(BlockImageSource)
    return spark.readStream.format("blockimage").options(**{k: str(v) for k, v in options.items()}).load(path)


def read_block(path: str, block_id: int, size: int = BLOCK) -> bytes:
    """One block of an image, by a seek; IndexError beyond its end or below 0."""
    with open_input(path) as f:
        if block_id < 0 or block_id * size >= f.size():
            raise IndexError(block_id)
        return f.read_at(min(size, f.size() - block_id * size), block_id * size)


def hash_file(path: str) -> str:
    """SHA-256 of a whole file; sequential by nature."""
    with open_input(path) as f:
        h = hashlib.sha256()
        while data := f.read(READ_BYTES):
            h.update(data)
        return h.hexdigest()


def blocks_of_text(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Texts (doc_id, text) as images of blocks."""
    d = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    last = F.ceil(F.length(d) / size).cast("int") - 1
    parts = docs.filter(F.length(d) > 0).select(F.col("doc_id").cast("string").alias("image_id"), d.alias("d"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return parts.select("image_id", F.col("i").cast("long").alias("block_id"), (F.col("i") * F.lit(size).cast("long")).alias("offset"), F.substring(F.col("d"), F.col("i") * size + 1, F.lit(size)).alias("data"))


def blocks_of_column(rows: DataFrame, image: str, block: str, data: str, size: int = BLOCK) -> DataFrame:
    """Any table with a binary column as blocks."""
    return rows.select(F.col(image).cast("string").alias("image_id"), F.col(block).cast("long").alias("block_id"), (F.col(block) * size).cast("long").alias("offset"), F.col(data).cast("binary").alias("data"))
