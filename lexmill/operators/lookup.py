"""Tables that Python workers search where they lie, whatever their size.

``publish`` sorts a table of (key, integers) by the hash of its keys and has
tasks write it as Arrow files below the shared folder. A worker maps these files
into memory one after another and searches the sorted hashes: nothing is loaded up
front, pickled or sent through the driver, and what a worker holds does not grow
with the table. In a store that cannot be mapped, blocks are read as they are needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lexmill.session import shared_dir

#: The folder below which files are published; the session's shared folder where it is unset.
FOLDER_SETTING = "lexmill.lookup.dir"
#: Rows of a block: the unit that is searched, and read from a store that cannot be mapped.
BLOCK_ROWS = 1 << 16
#: Blocks a worker keeps of a store that cannot be mapped.
KEPT_BLOCKS = 256
#: Fixed value: the seed that Spark's ``xxhash64`` starts from.
SPARK_SEED = 42


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Python sees it, and the path in it."""
    known = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri
    try:
        return fs.FileSystem.from_uri(known) if ":/" in known else (fs.LocalFileSystem(), known)
    except (pa.ArrowInvalid, ValueError, OSError) as problem:
        raise RuntimeError(f"Python workers cannot open {uri}; set {FOLDER_SETTING} to a folder they can") from problem


def key_hash(key: str) -> int:
    """What Spark's ``xxhash64`` gives for the string, as a signed integer."""
    value = xxhash.xxh64_intdigest(key.encode(), SPARK_SEED)
    return value - 2**64 if value >= 2**63 else value


#: The five factors of XXH64, and the length in bytes from which it works in another way.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_LONG = 32
#: Up to so many keys are hashed one by one.
FEW_KEYS = 64


def key_hashes(keys: pa.StringArray) -> np.ndarray:
    """``key_hash`` of every key, taken of all keys shorter than 32 bytes at once."""
    if len(keys) <= FEW_KEYS:
        return np.fromiter((key_hash(k) for k in keys.to_pylist()), np.int64, len(keys))
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    held = keys.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.empty(0, np.uint8)
    data = np.r_[data, np.zeros(8, np.uint8)]  # so that eight bytes can be read from every place
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    fours = np.ndarray((len(data) - 7,), "<u4", data, strides=(1,))
    at, length = offsets[:-1] - offsets[0], np.diff(offsets)
    h = np.uint64(SPARK_SEED) + _P5 + length.astype(np.uint64)
    short = length < _LONG
    for lane in range(0, _LONG, 8):
        of = np.flatnonzero(short & (length >= lane + 8))
        h[of] = _turned(h[of] ^ (_turned(eights[at[of] + lane] * _P2, 31) * _P1), 27) * _P1 + _P4
    done = length & ~7
    of = np.flatnonzero(short & (length - done >= 4))
    h[of] = _turned(h[of] ^ (fours[at[of] + done[of]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    done[of] += 4
    for byte in range(3):
        of = np.flatnonzero(short & (length > done + byte))
        h[of] = _turned(h[of] ^ (data[at[of] + done[of] + byte].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    hashes = (h ^ (h >> np.uint64(32))).view(np.int64)
    for i in np.flatnonzero(~short).tolist():
        hashes[i] = key_hash(keys[i].as_py())
    return hashes


def _turned(values: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each value turned to the left."""
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


@dataclass(frozen=True, eq=False)
class SharedLookup:
    """A published table: its files, and the first hash of each of their blocks in rising order.

    What it holds itself is a few bytes for every block of the table.
    """

    folder: str
    width: int
    files: tuple[str, ...]
    firsts: np.ndarray
    block_file: np.ndarray
    block_in_file: np.ndarray

    def open(self) -> Lookup:
        """The table, opened once per process."""
        return _opened(_Key(self))


def publish(df: DataFrame, key: str, values: str, width: int, label: str = "lookup") -> SharedLookup:
    """Write (key string, values array of ``width`` integers) for workers to search.

    Keys should be distinct; rows with a null key are left out. A task that runs
    again writes another file, and only files that finished tasks report are read.
    """
    spark = df.sparkSession
    folder = spark.conf.get(FOLDER_SETTING, None) or f"{shared_dir(spark)}/lexmill"
    folder = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = pa.schema([("hash", pa.int64()), ("key", pa.string()), ("values", pa.list_(pa.int64(), width))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        name, firsts, sink, writer = f"{path}/{uuid.uuid4().hex}.arrow", [], None, None
        for block in _blocks(batches, schema):
            if writer is None:
                sink = store.open_output_stream(name)
                writer = pa.ipc.new_file(sink, schema)
            firsts.append(block.column(0)[0].as_py())
            writer.write_batch(block)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([firsts])], ["name", "firsts"])

    rows = df.where(F.col(key).isNotNull()).select(
        F.xxhash64(key).alias("hash"), F.col(key).alias("key"), F.col(values).cast("array<bigint>").alias("values")
    )
    ordered = rows.repartitionByRange("hash").sortWithinPartitions("hash", "key")
    written = ordered.mapInArrow(write, "name string, firsts array<bigint>").collect()  # a row per file
    written = sorted(written, key=lambda row: row["firsts"][0])
    return SharedLookup(
        folder,
        width,
        tuple(row["name"] for row in written),
        np.array([first for row in written for first in row["firsts"]], np.int64),
        np.array([file for file, row in enumerate(written) for _ in row["firsts"]], np.int64),
        np.array([block for row in written for block in range(len(row["firsts"]))], np.int64),
    )


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about BLOCK_ROWS, with lists of fixed length."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        values = table["values"].combine_chunks()
        fixed = pa.FixedSizeListArray.from_arrays(pc.list_flatten(values), schema.field("values").type.list_size)
        columns = [table["hash"].combine_chunks(), table["key"].cast(pa.string()).combine_chunks(), fixed]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield block()
            held, rows = [], 0
    if held:
        yield block()


class Lookup:
    """An opened table, to be searched from one thread."""

    def __init__(self, shared: SharedLookup) -> None:
        self.shared = shared
        self._file: int | None = None
        self._reader: pa.ipc.RecordBatchFileReader | None = None
        self._store, _ = file_system(shared.folder)
        self._mapped = isinstance(self._store, fs.LocalFileSystem)
        self._block = self._read_block if self._mapped else lru_cache(maxsize=KEPT_BLOCKS)(self._read_block)

    def _read_block(self, block: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(hashes, keys, values) of a block; of a mapped file only what is touched is read.

        One file is open at a time: keys are looked up in the order of the files, and a
        mapping would keep all pages that were ever touched.
        """
        file = int(self.shared.block_file[block])
        if file != self._file:
            name = self.shared.files[file]
            source = pa.memory_map(name) if self._mapped else self._store.open_input_file(name)
            self._reader, self._file = pa.ipc.open_file(source), file
        batch = self._reader.get_batch(int(self.shared.block_in_file[block]))
        values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.shared.width)
        return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), values

    def find(self, keys: Sequence[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((n, width) integers, n booleans): the values of each key, zeros where it is unknown."""
        keys = pa.array(keys, pa.string())
        values = np.zeros((len(keys), self.shared.width), np.int64)
        found = np.zeros(len(keys), bool)
        firsts = self.shared.firsts
        if not len(keys) or not len(firsts):
            return values, found
        hashes = key_hashes(keys)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        # The last block that begins below a hash has its first row of that hash, or the next block does.
        blocks = np.maximum(np.searchsorted(firsts, ranked, "left") - 1, 0)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)]):
            self._search(int(blocks[start]), keys, hashes, order[start:stop], values, found)
        return values, found

    def _search(
        self, block: int, keys: pa.StringArray, hashes: np.ndarray, wanted: np.ndarray, values: np.ndarray, found: np.ndarray
    ) -> None:
        held, names, numbers = self._block(block)
        at = np.searchsorted(held, hashes[wanted], "left")
        inside = at < len(held)
        equal = np.zeros(len(wanted), bool)
        equal[inside] = held[at[inside]] == hashes[wanted[inside]]
        hits, places = wanted[equal], at[equal]
        same = pc.equal(names.take(pa.array(places)), keys.take(pa.array(hits)))
        same = same.to_numpy(zero_copy_only=False)
        values[hits[same]] = numbers[places[same]]
        found[hits[same]] = True
        # Left are keys beyond the block's end and keys that share a hash with another.
        open_keys = ~inside
        open_keys[equal] = ~same
        for i, place in zip(wanted[open_keys], at[open_keys]):
            self._walk(block, int(place), keys[int(i)].as_py(), hashes[i], i, values, found)

    def _walk(self, block: int, place: int, key: str, wanted: int, i: int, values: np.ndarray, found: np.ndarray) -> None:
        """Go on through rows of one hash, into the next block where they do."""
        while block < len(self.shared.firsts):
            held, names, numbers = self._block(block)
            if place == len(held):
                block, place = block + 1, 0
            elif held[place] != wanted:
                return
            elif names[place].as_py() == key:
                values[i], found[i] = numbers[place], True
                return
            else:
                place += 1


class _Key:
    """A handle that equals another of the same folder."""

    def __init__(self, shared: SharedLookup) -> None:
        self.shared = shared

    def __hash__(self) -> int:
        return hash(self.shared.folder)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Key) and other.shared.folder == self.shared.folder


@lru_cache(maxsize=4)
def _opened(key: _Key) -> Lookup:
    return Lookup(key.shared)
