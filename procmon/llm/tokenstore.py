"""Token-id store: raw id payloads with a minimal perfect hash index.

``write`` encodes every document, appends an end id, and writes the ids of all
documents in ascending id order as shard files into a folder that all executors
share.  A shard has two files:

* ``<name>.bin``: the ids one after the other, unsigned little-endian, 2 bytes
  each if the vocabulary has at most 65,536 ids, else 4;
* ``<name>.idx``: one line of JSON (sections with type and count), then the
  sections: the document keys in file order, the documents' offsets in the
  payload, and a minimal perfect hash of the distinct keys.

The hash has levels of bits: a key that falls alone on a bit of a level owns it,
the others go on to the next level.  The number of set bits before a key's bit
is its slot.  A slot holds a 32-bit fingerprint of its key, which tells absent
keys apart (a wrong hit has a chance of 2^-32), and the key's first document and
number of documents.  A lookup reads a few array cells, however many keys the
shard has.

Files are named after the attempt that wrote them, and a shard counts only when
its row reaches the manifest, a table that Spark commits: a task that is lost or
run twice leaves files that no manifest names.

Keys are integers; null keys come first and have no slot in the hash (they are
found by ``read``).  Repeated keys lie side by side, ordered by text, in one slot.
Null and empty texts hold the end id alone.  An empty table gives an empty
manifest.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmon.llm.chunks import encoder
from procmon.llm.common import partitions, slices, texts, written

LEVELS = 48
GAMMA = 2  # bits of a level for each key that reaches it
MANIFEST = "shard int, name string, n_docs long, n_tokens long, min_key long, max_key long"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), different for each seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys with fingerprints."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, marks: np.ndarray):
        self.bits, self.sizes, self.marks = bits, sizes, marks
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # of each level's bits
        per_word = np.bitwise_count(bits)
        self.rank = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-GAMMA * len(left) // 64) * 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
            level += 1
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        out = cls(bits, np.array(sizes, np.int64), np.zeros(len(keys), np.uint32))
        out.marks[out._place(keys)] = cls.mark(keys)
        return out

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if no level has its bit."""
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            bit = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.bits[word] >> low) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << low[hit]) - np.uint64(1))
            slot[open_[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the set."""
        slot = self._place(keys)
        known = slot >= 0
        known[known] = self.marks[slot[known]] == self.mark(keys[known])
        return np.where(known, slot, -1)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path there."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the store into ``folder`` (shared by all executors); returns the manifest, ordered shards' rows.

    ``shards`` range partitions of the documents become that many files (the
    session's shuffle partitions by default).
    """
    spark = docs.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId(), encoder(tokenizer_file, "byte")
        fs, base = file_system(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        keys, counts, nulls = [], [], 0
        out = None
        for b in slices(batches, "t"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.bin")
            ids, off = own.encode(texts(b, "t"))
            ids = np.insert(ids, off[1:], end_id).astype(width)
            out.write(ids.tobytes())
            counts.append(np.diff(off) + 1)
            k = b.column("k")
            nulls += k.null_count
            keys.append(k.drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        key, lens = np.concatenate(keys).astype(np.int64), np.concatenate(counts)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        distinct = key[first].view(np.uint64)
        hashed = PerfectHash.build(distinct)
        slot = hashed.slots(distinct)
        doc, copies = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        doc[slot], copies[slot] = first + nulls, np.diff(np.append(first, len(key)))
        sections = {"keys": key, "offsets": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), "bits": hashed.bits, "sizes": hashed.sizes, "marks": hashed.marks, "doc": doc, "copies": copies}
        head = {"ids": width, "nulls": nulls, "sections": [[n, a.dtype.str, len(a)] for n, a in sections.items()]}
        with fs.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(json.dumps(head).encode() + b"\n")
            for a in sections.values():
                f.write(np.ascontiguousarray(a).tobytes())
        low, high = (int(key[0]), int(key[-1])) if len(key) else (None, None)
        row = {"shard": [shard], "name": [name], "n_docs": [len(lens)], "n_tokens": [int(lens.sum())], "min_key": [low], "max_key": [high]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("name", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "min_key", "max_key"))]))

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange(shards or partitions(spark), F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return written(rows.mapInArrow(run, MANIFEST), "manifest")


class Shard:
    """An opened shard: its index in memory, its payload read where asked."""

    def __init__(self, folder: str, name: str):
        fs, base = file_system(folder)
        with fs.open_input_stream(f"{base}/{name}.idx") as f:
            raw = f.read()
        end = raw.index(b"\n")
        head = json.loads(raw[:end])
        at, part = end + 1, {}
        for n, kind, count in head["sections"]:
            part[n] = np.frombuffer(raw, kind, count, at)
            at += part[n].nbytes
        self.nulls, self.width = head["nulls"], np.dtype(head["ids"])
        self.keys, self.offsets, self.doc, self.copies = part["keys"], part["offsets"], part["doc"], part["copies"]
        self.hash = PerfectHash(part["bits"], part["sizes"], part["marks"])
        self.payload = fs.open_input_file(f"{base}/{name}.bin")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key (0 documents: absent)."""
        slot = self.hash.slots(keys.astype(np.int64).view(np.uint64))
        ok = slot >= 0
        return np.where(ok, self.doc[slot] if len(self.doc) else 0, -1), np.where(ok, self.copies[slot] if len(self.copies) else 0, 0)

    def ids(self, doc: int, docs: int = 1) -> np.ndarray:
        """The ids of ``docs`` documents from ``doc`` on, one after the other."""
        a, b = int(self.offsets[doc]), int(self.offsets[doc + docs])
        w = self.width.itemsize
        return np.frombuffer(self.payload.read_at((b - a) * w, a * w), self.width).astype("<u4")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32), a row for each document.

    Each shard's keys are looked up in its perfect hash, and the ids are read at
    the offsets found there; null keys, which the hash does not hold, are the
    shard's first documents.  The manifest has a row for each shard.
    """
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
    n = max(1, min(manifest.count(), 4 * partitions(spark)))
    step = 256  # documents read at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                s = Shard(folder, name)
                doc, copies = s.find(s.keys)
                fresh = np.concatenate([[True], s.keys[1:] != s.keys[:-1]]) if len(s.keys) else np.zeros(0, bool)
                nth = np.arange(len(s.keys)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s.keys)), 0))
                if (nth >= copies).any():
                    raise ValueError(f"shard {name}: index and keys differ")
                docs = np.concatenate([np.arange(s.nulls), doc + nth]).astype(np.int64)
                keys = pa.concat_arrays([pa.nulls(s.nulls, pa.int64()), pa.array(s.keys, pa.int64())])
                for i in range(0, len(docs), step):
                    part = docs[i : i + step]
                    crc = [zlib.crc32(s.ids(d).tobytes()) for d in part.tolist()]
                    yield pa.RecordBatch.from_arrays([keys.slice(i, len(part)), pa.array(s.offsets[part] + start), pa.array(s.offsets[part + 1] - s.offsets[part]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: DataFrame, keys: DataFrame, key_col: str) -> DataFrame:
    """Keyed access: (key, copy, ids array<long>) for every document of the keys asked for; absent keys give no row.

    Keys go to the one shard whose key range can hold them, in an exchange; a
    shard's index is opened once for the keys that follow each other.  The
    shards' ranges (one row a shard) travel with the tasks.
    """
    ranges = manifest.where(F.col("max_key").isNotNull()).select("name", "min_key", "max_key").orderBy("min_key").collect()
    names, low, high = [r[0] for r in ranges], np.array([r[1] for r in ranges], np.int64), np.array([r[2] for r in ranges], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(low, k, side="right") - 1
            ok = (at >= 0) & (k <= high[np.maximum(at, 0)]) if len(low) else np.zeros(len(k), bool)
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(at[ok], pa.int64())], ["k", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard = -1, None
        for b in batches:
            at, k = b.column("at").to_numpy(), b.column("k").to_numpy()
            out: dict[str, list] = {"k": [], "copy": [], "ids": []}
            for i in np.unique(at).tolist():
                if i != opened:
                    opened, shard = i, Shard(folder, names[i])
                asked = k[at == i]
                doc, copies = shard.find(asked)
                for key, d, n in zip(asked.tolist(), doc.tolist(), copies.tolist(), strict=True):
                    for c in range(n):
                        out["k"].append(key)
                        out["copy"].append(c)
                        out["ids"].append(shard.ids(d + c).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int64()), pa.array(out["copy"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64()))], ["k", "copy", "ids"])

    routed = keys.select(F.col(key_col).cast("long").alias("k")).mapInArrow(route, "k long, at long")
    spread = routed.repartition(partitions(keys.sparkSession), "at").sortWithinPartitions("at", "k")
    return spread.mapInArrow(run, "k long, copy long, ids array<long>").withColumnRenamed("k", key_col)
