"""Token ids of whole texts in flat unsigned integer files.

A dataset is a folder of shards and a manifest.  Shard ``k`` holds the documents of the ``k``-th range of
(id, text hash), in that order:

* ``*.bin``: the ids of all its documents, one after the other, little-endian, 16 bits if the vocabulary
  allows it and 32 bits else;
* ``*.idx``: 64-bit unsigned offsets into the ids, one more than documents, then the documents' own ids as
  64-bit signed numbers.

The manifest is Parquet, a row a shard: number, file, documents, ids, rows with a null id (they come first)
and *base*, the number of ids in all shards before it.  Bases are prefix sums over the shards' totals, so no
shard waits for another; id ``i`` of the corpus is id ``i - base`` of its shard.  Readers map the files.

One shuffle moves each text once, to its range; there it is encoded, written and forgotten.  A shard's file
is named by the attempt that wrote it and counts only if the manifest, which Spark commits, names it: a lost
executor or a second attempt leaves a file that nobody reads.

Encoding goes by pieces.  A byte-level BPE splits a text by a pattern before it merges, so a text may be cut
wherever the pattern must cut; each distinct piece is encoded by the library once a worker (``CACHE``
pieces at most, then it starts anew), and the ids of a text are those of its pieces.  A tokenizer of
another kind gets whole texts.

Nulls: a null text is empty, and has the end id alone; a null id sorts first.  Repeated ids are in order of
their texts' hashes, repeated rows stay rows.  An empty table gives an empty manifest.  Only ``doc_id`` and
``text`` are read, so other columns can't clash; without one of them a ValueError is raised.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corymb.llm import tokens
from corymb.llm.shared import need, shared_dir, small_batches

#: Distinct pieces that a worker remembers.
CACHE = 1_000_000
#: Ids that are read or checked at once; a longer document is read alone.
READ_IDS = 1 << 20
#: Ids that a reading task takes in all, about, where the shards allow more tasks than twice the cores.
TASK_IDS = 1 << 24

_SOLID = np.zeros(256, bool)  # what stands beside a cut space: visible ASCII, or a character of two bytes that is no space
_SOLID[0x21:0x7F] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[0x21:0x7F] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False


def cuts(data: np.ndarray, offsets: np.ndarray, specials: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where consecutive texts are cut: at their bounds, before a lone space, and between a letter and a sign.

    A pattern of a byte-level BPE ends a match at each of these places whatever is around them.  A place
    that can't be judged by its neighbouring bytes isn't cut, and neither is the text of a special token.
    """
    n = len(data)
    if n < 3:
        return np.unique(np.concatenate([offsets, [0, n]]))
    wide = (data >= 0xC3) & (data <= 0xDF)
    before, after = _SOLID[data], _SOLID[data] | wide
    before[1:] |= wide[:-1]
    at = np.zeros(n + 1, bool)
    at[1 : n - 1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    at[1:n] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    raw = data.tobytes() if specials else b""
    for s in specials:
        p = raw.find(s)
        while p >= 0:
            at[p + 1 : p + len(s)] = False
            p = raw.find(s, p + 1)
    at[offsets] = True
    at[0] = at[n] = True
    return np.flatnonzero(at)


class Encoder:
    """Ids of batches of texts by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        added = spec.get("added_tokens") or []
        self.by_piece = self.by_piece and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.specials = tuple(t["content"].encode() for t in added)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.flat, self.ends = self.ids[0], self.bounds[0]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and how many each has."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        each = [e.ids for e in found]
        return np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each], np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of these pieces among the known ones; unknown ones are encoded."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE and self.known:
            self._forget()
            new = pieces
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            ids, counts = self._library([p.decode() for p in part])
            for i, p in enumerate(part, len(self.known)):
                self.known[p] = i
            self.ids.append(ids)
            self.bounds.append(counts)
        if new:
            self.flat = np.concatenate(self.ids)
            counts = np.concatenate([self.bounds[0][:1], *self.bounds[1:]])
            self.ends = np.cumsum(counts)
            self.ids = [self.flat]
            self.bounds = [counts]
            self.bounds = [np.zeros(1, np.int64), counts[1:]]
        return np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of consecutive texts, and where each text's ids begin (one more than texts)."""
        if not self.by_piece:
            raw = data.tobytes()
            ids, counts = self._library([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return ids, np.concatenate([[0], np.cumsum(counts)])
        at = cuts(data, offsets, self.specials)
        if len(at) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        number = self._learn(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        begin, count = self.ends[number], self.ends[number + 1] - self.ends[number]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(at, offsets)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder named by a URI."""
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def _writer(folder: str, tokenizer: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer)
        store, top = _place(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, offsets, ids, nulls, total = None, [np.zeros(1, np.uint64)], [], 0, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.bin")
            nulls += b.column("doc_id").null_count
            ids.append(b.column("doc_id").fill_null(0).to_numpy())
            data, at = tokens.text_bytes(b.column("text"))
            for lo, hi in tokens.runs(at, 1 << 22):
                found, begin = enc.encode(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                ends = begin[1:]
                flat = np.insert(found.astype(kind), ends, end_id)
                offsets.append((total + ends + np.arange(1, len(ends) + 1)).astype(np.uint64))
                total += len(flat)
                out.write(flat.astype(f"<{kind}").tobytes())
        if out is not None:
            out.close()
            ids = np.concatenate(ids)
            with store.open_output_stream(f"{top}/{name}.idx") as idx:
                idx.write(np.concatenate(offsets).astype("<u8").tobytes())
                idx.write(ids.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": name, "n_docs": len(ids), "n_null": nulls, "n_ids": total}], schema=_SHARD)

    return run


_SHARD = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())])


def write_ids(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, below ``folder``; returns the manifest.

    ``tokenizer`` is the path of a tokenizer file that all executors have.  The folder must be one that they
    share.  ``shards`` is the number of ranges, the shuffle partitions' unless stated.
    """
    docs = need(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    small_batches(spark)
    kind = "u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "u4"
    # equal rows are told apart by their place, so that one text a third of all rows hold is no single range
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.monotonically_increasing_id().alias("place"))
    keys = ("doc_id", "th", "place")
    ranged = keyed.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    # a row a shard: they meet in one task and one file, since a Parquet file each costs more than the row
    written = ranged.mapInArrow(_writer(folder, tokenizer, end_id, kind), "part int, file string, n_docs long, n_null long, n_ids long")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    manifest = written.select("*", F.coalesce(before, F.lit(0)).alias("base"), F.lit(kind).alias("kind"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest.parquet")


class Shard:
    """One shard: its documents' ids by number, from mapped files, or by ranged reads where there is no mapping."""

    def __init__(self, folder: str, file: str, n_docs: int, n_null: int, kind: str):
        store, top = _place(folder)
        self.n_null, self.type = n_null, np.dtype(f"<{kind}")
        with store.open_input_file(f"{top}/{file}.idx") as f:
            raw = f.read()
        self.offsets = np.frombuffer(raw, "<u8", n_docs + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, 8 * (n_docs + 1))
        self.file, self.map = None, None
        if isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(f"{top}/{file}.bin", self.type, "r")
        else:
            self.file = store.open_input_file(f"{top}/{file}.bin")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of the shard."""
        if self.map is not None:
            return self.map[first:last]
        self.file.seek(first * self.type.itemsize)
        return np.frombuffer(self.file.read((last - first) * self.type.itemsize), self.type)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))

    def groups(self, most: int = READ_IDS) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``most`` ids together."""
        return tokens.runs(self.offsets, most)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files.

    ``ids_crc32`` is taken over the ids as little-endian numbers of 32 bits, whatever the file's width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(folder, row["file"], row["n_docs"], row["n_null"], row["kind"])
                for lo, hi in shard.groups():
                    at = shard.offsets[lo : hi + 1]
                    raw = memoryview(shard.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                    near = (4 * (at - at[0])).tolist()
                    sums = [zlib.crc32(raw[i:j]) for i, j in zip(near[:-1], near[1:], strict=True)]
                    ids = pa.array(shard.doc_ids[lo:hi], mask=np.arange(lo, hi) < shard.n_null)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    shards, total = manifest.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    # small shards are read several in a task, as Spark packs small files; each is still read in runs of READ_IDS
    tasks = max(1, min(shards, max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_IDS))))
    return manifest.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """The contract's rows: a documents table written to files in the shared folder and read back.

    ``tokenizer`` is the 50 257-word byte-level vocabulary of the installed public tokenizers unless stated.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/corymb/ids-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    write_ids(docs, folder, tokenizer=tokenizer, end_id=end_id)
    return read_ids(spark, folder)
