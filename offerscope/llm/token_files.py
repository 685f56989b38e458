"""Token ids in fixed-width bit-packed files with random access.

File: magic, packed ids, then the index (block offsets, doc ids, doc starts)
and a trailer.  Each id takes the least bits that hold the vocabulary; a block
holds ``BLOCK`` ids, so every block starts on a byte and its offset is in the
index.  Readers unpack any run of blocks with numpy only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_stages, text_or_empty
from .encode import encoder

MAGIC = b"OSBITS01"
LANES = 64              # ids that fill whole 64-bit words whatever their width: one array operation a lane
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}    # widths of machine numbers: their lanes are an array as it is
BLOCK = 4096            # ids; a multiple of LANES, so that blocks end on whole words
READ_BLOCKS = 256       # blocks unpacked at once
TRAILER = struct.Struct("<QQQQQ8s")   # bits, ids, docs, null mask bytes, index offset, magic


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first; the end is
    padded with zero bits to a whole 64-bit word."""
    ids = np.ascontiguousarray(ids)
    if ids.dtype.kind != "u":
        ids = ids.astype(np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in WHOLE:
        raw = ids.astype(WHOLE[bits]).tobytes()
        return raw + bytes(-len(raw) % 8)
    groups = -(-len(ids) // LANES)
    lanes = np.zeros((groups, LANES), np.uint64)
    lanes.reshape(-1)[:len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.T)
    words = np.zeros((bits, groups), np.uint64)
    for k, lane in enumerate(lanes):
        word, shift = divmod(k * bits, 64)
        words[word] |= lane << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lane >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()[:-(-len(ids) * bits // 64) * 8]


def unpack(raw: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """Ids ``first .. first + n`` of a packed run, without a loop over ids."""
    begin = first // LANES
    groups = -(-(first + n) // LANES) - begin
    raw = raw[8 * bits * begin:8 * bits * (begin + groups)]
    if bits in WHOLE:
        return np.frombuffer(raw + bytes(-len(raw) % 8), WHOLE[bits])[first - LANES * begin:][:n].astype(np.uint32)
    words = np.frombuffer(raw + bytes(8 * bits * groups - len(raw)), "<u8").astype(np.uint64).reshape(groups, bits)
    words, mask = np.ascontiguousarray(words.T), np.uint64((1 << bits) - 1)
    out = np.empty((LANES, groups), np.uint32)
    for k in range(LANES):
        word, shift = divmod(k * bits, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[word + 1] << np.uint64(64 - shift))
        out[k] = lane & mask
    return np.ascontiguousarray(out.T).reshape(-1)[first - LANES * begin:][:n]


class TokenFile:
    """Random access to one file: ``ids(start, n)`` reads only its blocks."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        self.bits, self.n_ids, self.n_docs, nulls, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        raw = self.file.read_at(index, size - TRAILER.size - index)
        blocks = -(-self.n_ids // BLOCK)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, 8 * blocks)
        self.doc_null = np.frombuffer(raw, np.uint8, nulls, 8 * (blocks + self.n_docs))
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * (blocks + self.n_docs) + nulls).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, (start + n - 1) // BLOCK
        begin = int(self.offsets[a])
        end = int(self.offsets[b]) + BLOCK * self.bits // 8
        return unpack(self.file.read_at(end - begin, begin), self.bits, n, start - a * BLOCK)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))

    def crcs(self) -> Iterator[int]:
        """crc32 of every document's ids, from one pass over the blocks."""
        crc, k, step = 0, 0, READ_BLOCKS * BLOCK
        for at in range(0, max(1, self.n_ids), step):
            n = min(step, self.n_ids - at)
            part, done = self.ids(at, n).astype("<u4"), at
            while k < self.n_docs:
                end = min(int(self.starts[k + 1]), at + n)
                crc, done = zlib.crc32(part[done - at:end - at].tobytes(), crc), end
                if end < self.starts[k + 1]:
                    break
                yield crc
                crc, k = 0, k + 1

    def close(self) -> None:
        self.file.close()


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _write_file(batches, folder: str, tokenizer: str, end_id: int, bits: int):
    """One file of this task's rows, in their order, put in place by a rename
    (a repeated or speculative attempt writes the same bytes)."""
    import pyarrow as pa
    from pyspark import TaskContext

    ctx = TaskContext.get()
    name = f"part-{ctx.partitionId():06d}.bits"
    fs, base = _open(folder)
    temporary = f"{base}/.{name}-{ctx.taskAttemptId()}"
    enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
    out, rest, doc_ids, lengths = None, np.empty(0, np.uint32), [], []

    def block(ids):
        return pack(np.concatenate([ids, np.zeros(-len(ids) % BLOCK, np.uint32)]), bits)

    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(temporary)
            out.write(MAGIC)
        coded = [x + end for x in enc.encode(batch.column(1).to_pylist())]
        doc_ids += batch.column(0).to_pylist()
        lengths += [len(x) // 4 for x in coded]
        rest = np.concatenate([rest, np.frombuffer(b"".join(coded), "<u4")])
        whole = len(rest) // BLOCK * BLOCK
        for at in range(0, whole, READ_BLOCKS * BLOCK):
            out.write(block(rest[at:min(whole, at + READ_BLOCKS * BLOCK)]))
        rest = rest[whole:].copy()
    if out is None:
        return
    if len(rest):
        out.write(block(rest))
    starts = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
    n_ids = int(starts[-1])
    offsets = len(MAGIC) + np.arange(-(-n_ids // BLOCK), dtype=np.int64) * (BLOCK * bits // 8)
    null = np.asarray([d is None for d in doc_ids], np.uint8)
    index = (offsets.astype("<u8").tobytes() + np.asarray([d or 0 for d in doc_ids], "<i8").tobytes()
             + null.tobytes() + starts.astype("<u8").tobytes())
    out.write(index + TRAILER.pack(bits, n_ids, len(doc_ids), len(null), len(index), MAGIC))
    out.close()
    fs.move(temporary, f"{base}/{name}")
    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": [ctx.partitionId()], "n_ids": [n_ids],
                                      "n_docs": [len(doc_ids)]},
                                     schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("n_ids", pa.int64()),
                                                       ("n_docs", pa.int64())]))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocab: int) -> list[tuple[str, int, int, int]]:
    """Encode ``docs`` (doc_id, text) in ascending ``doc_id`` and write one
    file a partition below ``folder``.  Returns (path, first id, ids, docs) of
    each file, in order; that list is as long as there are partitions.

    Null text is empty (its end id only); a null ``doc_id`` sorts first; rows
    with equal ``doc_id`` are ordered by a hash of their text, and equal rows
    are stored each.  No rows: no file.  Other columns are not read."""
    python_stages(docs.sparkSession)
    ordered = (docs.select("doc_id", text_or_empty().alias("text"))
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    bits = bits_for(vocab)
    files = ordered.mapInArrow(lambda it: _write_file(it, folder, tokenizer, end_id, bits),
                               "path string, part long, n_ids long, n_docs long").collect()
    first, listed = 0, []
    for f in sorted(files, key=lambda f: f["part"]):
        listed.append((f["path"], first, f["n_ids"], f["n_docs"]))
        first += f["n_ids"]
    return listed


def _digests(batches):
    import pyarrow as pa
    for batch in batches:
        for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(uri)
            crcs = np.fromiter(file.crcs(), np.int64, file.n_docs)
            doc_ids = pa.array(file.doc_ids, mask=file.doc_null.astype(bool))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(file.starts[:-1] + first), pa.array(np.diff(file.starts)), pa.array(crcs)],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])
            file.close()


def read_digests(spark: SparkSession, files: list[tuple[str, int, int, int]]) -> DataFrame:
    """Per document, from the files alone: place, length and crc32."""
    listed = spark.createDataFrame([(p, s) for p, s, _, _ in files], "path string, first long")
    return (listed.repartition(max(1, len(files)))
            .mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long"))
