"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record is, little-endian: payload length (8 bytes), masked CRC-32C of those 8 bytes (4), payload,
masked CRC-32C of the payload (4). The payload is flags (1 byte: bit 0 the doc_id is null, bit 1 the
ids take 4 bytes instead of 2), doc_id (8, signed) and the ids. Record files can be read front to
back without the index. The index has one entry of 24 bytes for each record, in file order:
doc_id (8), offset of the record in its file (8), number of ids (8).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import SLICE_BYTES, crc32c_many, fresh_path, gathered, masked, stored
from strandwork.llm.tokens import encoder

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
HEADER, FRAME = 9, 16
#: Bytes of text that go to one record file.
SHARD_BYTES = 32 << 20
MANIFEST = "shard int, path string, n_records long, n_tokens long"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of the payloads, and where each one starts."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    head_crc, body_crc = (masked(crc32c_many(x, n)).astype("<u4").tobytes() for x, n in ((heads, 8), (payloads, 256)))
    out = b"".join(x for i, (h, p) in enumerate(zip(heads, payloads, strict=True)) for x in (h, head_crc[4 * i : 4 * i + 4], p, body_crc[4 * i : 4 * i + 4]))
    return out, np.cumsum(sizes + FRAME) - (sizes + FRAME)


def unframe(data: bytes, starts: np.ndarray) -> list[bytes]:
    """Payloads of the records that start there; raises on a wrong length or checksum."""
    at = starts.tolist()
    heads = [data[s : s + 8] for s in at]
    if b"".join(data[s + 8 : s + 12] for s in at) != masked(crc32c_many(heads, 8)).astype("<u4").tobytes():
        raise ValueError("a record's length is damaged")
    sizes = [int.from_bytes(h, "little") for h in heads]
    if any(s + n + FRAME > len(data) for s, n in zip(at, sizes, strict=True)):
        raise ValueError("a record is cut short")
    payloads = [data[s + 12 : s + 12 + n] for s, n in zip(at, sizes, strict=True)]
    if b"".join(data[s + 12 + n : s + FRAME + n] for s, n in zip(at, sizes, strict=True)) != masked(crc32c_many(payloads)).astype("<u4").tobytes():
        raise ValueError("a record's payload is damaged")
    return payloads


def write_token_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes each text, appends end_id and writes the ids in ascending id order; returns the manifest.

    Null texts count as empty (one record with end_id), null ids come first, rows with equal ids are
    ordered by a digest of the text and each has its record, and may lie in several files; other columns are left out; an empty table gives no files.
    Every attempt of a task writes files of its own name and the manifest names those of the attempt
    that counted, so a lost executor leaves unused files at most. One manifest row for each file.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # ids that many rows share are cut by the texts' digests, and equal rows by where they lie
    order = ["doc_id", "_digest", "_row"]
    dealt = base.withColumns({"_digest": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        flag = 2 * (encode.dtype.itemsize == 4)
        end = np.array([end_id], encode.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex[:12]}"
        files, at, n_records, n_tokens = None, 0, 0, 0
        for batch in gathered(batches, "text", 4 * SLICE_BYTES):
            if files is None:
                store, root = filesystem(folder)
                store.create_dir(root, recursive=True)
                files = [store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("rec", "idx")]
            keys = batch.column("doc_id").to_pylist()
            ids, counts = encode.encode(batch.column("text"))
            raw, ends = memoryview(ids).cast("B"), (np.cumsum(counts) * ids.itemsize).tolist()
            out, starts = frame([b"".join((bytes([flag + (k is None)]), (k or 0).to_bytes(8, "little", signed=True), raw[a:b], end)) for k, a, b in zip(keys, [0, *ends], ends, strict=False)])
            index = np.zeros(len(keys), INDEX)
            index["doc_id"], index["offset"], index["n_tokens"] = [k or 0 for k in keys], starts + at, counts + 1
            files[0].write(out)
            files[1].write(index.tobytes())
            at, n_records, n_tokens = at + len(out), n_records + len(keys), n_tokens + int(index["n_tokens"].sum())
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_records": pa.array([n_records], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_index(path: str) -> np.ndarray:
    store, root = filesystem(f"{path}.idx")
    with store.open_input_stream(root) as f:
        return np.frombuffer(f.read(), INDEX)


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    key = None if payload[0] & 1 else int.from_bytes(payload[1:9], "little", signed=True)
    return key, np.frombuffer(payload, "<u4" if payload[0] & 2 else "<u2", offset=HEADER)


def read_at(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of these numbers in that order, each by one seek: what a shuffled reader does."""
    index = read_index(path)
    store, root = filesystem(f"{path}.rec")
    with store.open_input_file(root) as f:
        out = []
        for n in numbers:
            f.seek(int(index["offset"][n]))
            head = f.read(12)
            data = head + f.read(int.from_bytes(head[:8], "little") + 4)
            out.append(payload_ids(unframe(data, np.zeros(1, np.int64))[0]))
        return out


def read_token_records(manifest: DataFrame, with_ids: bool = True, read_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, shard, record, start, n_tokens, ids_crc32 and, if asked for, ids of every record, checked and in order of the shards.

    start counts the ids of all records before; it comes from the manifest (one row for each file)
    and the running count inside the file.
    """
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = "doc_id long, shard int, record long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            index = read_index(row["path"])
            store, root = filesystem(f"{row['path']}.rec")
            start, at = row["base"], 0
            with store.open_input_stream(root) as f:
                size = store.get_file_info(root).size
                while at < len(index):
                    first = int(index["offset"][at])
                    end = max(at + 1, int(np.searchsorted(index["offset"], first + read_bytes)))
                    upto = int(index["offset"][end]) if end < len(index) else size
                    found = [payload_ids(p) for p in unframe(f.read(upto - first), index["offset"][at:end] - first)]
                    counts = np.array([len(x) for _, x in found], np.int64)
                    if (counts != index["n_tokens"][at:end]).any():
                        raise ValueError("the index does not fit its records")
                    starts = start + np.cumsum(counts) - counts
                    columns = {
                        "doc_id": pa.array([k for k, _ in found], pa.int64()), "shard": pa.array(np.full(end - at, row["shard"], np.int32)), "record": pa.array(np.arange(at, end)), "start": pa.array(starts), "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for _, x in found], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate([x for _, x in found]).astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
                    start, at = start + int(counts.sum()), end

    n = manifest.count()
    return bases.repartitionByRange(max(1, n), "shard").mapInArrow(read, schema)
