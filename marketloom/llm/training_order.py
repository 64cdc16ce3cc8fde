"""Training order: fixed-stride token shards in a keyed random order.

Texts are encoded and cut into sequences of at most ``seq_len`` ids. A document
is numbered by a hash of its id and text, so a sequence's index, that number
and its own number in the document, depends on nothing else: not on files,
partitions or cores. A keyed Feistel network over the smallest even number of
bits that holds the domain, walked along its cycle until it lands inside, maps
every index to a place: a permutation that each task evaluates for itself,
without a sort or a table. Places are dealt by ranges to shards, each a file
of records of the same length in the order of their places. A sequence's
global slot is its number in that order, so slots are dense, a slot lies at a
known offset of a known shard, and a reader can go on wherever it stopped.

Texts are encoded once and moved once; nothing is staged in between, and the
driver gets one row of sums. Shards grow with the domain once there are
MAX_SHARDS of them.

Null and empty texts have no sequence; very long ones have many, nothing is
cut short or dropped. Ids are integers. A null id is kept as such (``has_id``
is false, the field says -1). Repeated rows, and documents whose hashes
collide, share their places and follow each other there in the order of id,
number and payload. Only the id and the text are read, so other columns do
not matter, whatever their names; an empty table has no shard.
"""

from __future__ import annotations

import struct
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.llm.bpe import codec
from marketloom.llm.common import mix64, raw_rows, shared_path, small_batches, staged, text_or_empty

SEQ_LEN = 512
#: Room of one shard in sequences of one-byte tokens; with some 0.4 tokens a byte about that share are records.
SHARD_PLACES = 40_000
#: Shards at most; beyond, they grow.
MAX_SHARDS = 100_000
#: Bits of a document's number and of the whole domain, at most.
NUMBER_BITS, DOMAIN_BITS = 48, 61
ROUNDS = 6
MAGIC = b"MLSHARD1"
#: Magic, sequence length, bytes of an id, first place, number of places.
HEADER = "<8sIIQQ"
#: Document id, number of the sequence in the document, ids that are no padding, whether there is a document id.
RECORD = "<qii?"
ROWS = 1024
#: Tasks that read shards, at most.
READERS = 20_000


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slots of ``index`` under the permutation of ``range(size)`` that ``key`` names."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(np.array([key & (1 << 64) - 1], np.uint64)))

    def once(x):
        left, right = x >> bits, x & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        return left << bits | right

    slots = once(index.astype(np.uint64))
    while (out := np.flatnonzero(slots >= size)).size:
        slots[out] = once(slots[out])
    return slots.astype(np.int64)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Domain(NamedTuple):
    """Number of places, and of the sequences that there would be if every token had one byte."""

    size: int
    room: int


def domain_of(docs: DataFrame, text: str = "text", seq_len: int = SEQ_LEN) -> tuple[Domain, int, int]:
    """The domain, the bits of a document's number in it, and the sequences that a document has at most."""
    room = F.ceil(F.octet_length(text_or_empty(text)) / seq_len)
    most, total = docs.agg(F.max(room), F.sum(room)).head()
    most = max(1, int(most or 0))
    bits = min(NUMBER_BITS, DOMAIN_BITS - most.bit_length())
    return Domain(most << bits, int(total or 0)), bits, most


def place_sequences(docs: DataFrame, tokenizer_path: str, key: int, id_col: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN) -> tuple[DataFrame, Domain]:
    """``place, id, seq_no, n_tokens, payload`` of all sequences, and the domain."""
    small_batches(docs.sparkSession)
    domain, bits, most = domain_of(docs, text, seq_len)

    def rows(batches):
        one = codec(tokenizer_path)
        width = np.dtype(id_type(len(one.token_bytes)))
        for batch in batches:
            out, index = [], []
            for doc, number, raw in zip(batch.column("id").to_pylist(), batch.column("number").to_pylist(), raw_rows(batch.column("text"))):
                ids = np.frombuffer(one.encode(raw), np.int32).astype(width)
                for no, low in enumerate(range(0, len(ids), seq_len)):
                    piece = ids[low : low + seq_len]
                    out.append((doc, no, len(piece), piece.tobytes()))
                    index.append(number * most + no)
            places = feistel(np.array(index, np.int64), domain.size, key)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for low in range(0, len(out), ROWS):
                part = out[low : low + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(places[low : low + ROWS]), *(pa.array([r[i] for r in part], t) for i, t in enumerate(kinds))], ["place", "id", "seq_no", "n_tokens", "payload"])

    doc, body = F.col(id_col).cast("long"), text_or_empty(text)
    number = F.shiftrightunsigned(F.xxhash64(doc, body), 64 - bits)
    rows_in = docs.select(doc.alias("id"), number.alias("number"), body.alias("text"))
    return rows_in.mapInArrow(rows, "place long, id long, seq_no int, n_tokens int, payload binary"), domain


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(sequences: DataFrame, domain: Domain, vocabulary: int, path: str | None = None, seq_len: int = SEQ_LEN, shard_places: int = SHARD_PLACES) -> DataFrame:
    """Write the shards; returns their manifest ``(shard, path, first_slot, n_records, n_bytes)``.

    A shard is written beside its name and moved there when complete, so that
    repeated and lost tasks leave whole files only. Padding is zero.
    """
    spark = sequences.sparkSession
    path = path or shared_path(spark, "shards")
    shards = max(1, min(MAX_SHARDS, -(-domain.room // shard_places)))
    stride = -(-domain.size // shards)
    width = np.dtype(id_type(vocabulary)).itemsize

    def write(batches):
        store = out = None
        n = shard = 0
        for batch in batches:
            for place, doc, no, length, payload in zip(*(batch.column(c).to_pylist() for c in ("place", "id", "seq_no", "n_tokens", "payload"))):
                if out is None:
                    shard = place // stride
                    store, root = _open(path)
                    store.create_dir(root, recursive=True)
                    name = f"{root}/shard-{shard:08d}.bin"
                    part = f"{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    out.write(struct.pack(HEADER, MAGIC, seq_len, width, shard * stride, stride))
                out.write(struct.pack(RECORD, -1 if doc is None else doc, no, length, doc is not None) + payload.ljust(seq_len * width, b"\0"))
                n += 1
        if out is not None:
            out.close()
            store.move(part, name)
            total = struct.calcsize(HEADER) + n * (struct.calcsize(RECORD) + seq_len * width)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, f"{path}/shard-{shard:08d}.bin", n, total), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_records", "n_bytes"])

    dealt = sequences.withColumn("shard", F.expr(f"cast(place div {stride} as int)"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "id", "seq_no", "payload").drop("shard")
    written = staged(dealt.mapInArrow(write, "shard int, path string, n_records long, n_bytes long"), "manifest")
    before = F.sum("n_records").over(Window.orderBy("shard")) - F.col("n_records")  # a row for each shard, MAX_SHARDS at most
    return staged(written.select("shard", "path", before.alias("first_slot"), "n_records", "n_bytes"), "manifest")


def read_shards(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """``slot, shard, id, has_id, seq_no, n_tokens, payload`` from ``from_slot`` on, in order within each shard."""

    def read(batches):
        head = struct.calcsize(RECORD)
        for batch in batches:
            for shard, path, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "first_slot", "n_records"))):
                store, name = _open(path)
                with store.open_input_file(name) as file:
                    magic, seq_len, width, *_ = struct.unpack(HEADER, file.read(struct.calcsize(HEADER)))
                    if magic != MAGIC:
                        raise ValueError(f"no shard: {path}")
                    stride, at = head + seq_len * width, max(first, from_slot)
                    file.seek(struct.calcsize(HEADER) + (at - first) * stride)
                    while at < first + n:
                        data = file.read(min(ROWS, first + n - at) * stride)
                        heads = [struct.unpack_from(RECORD, data, k) for k in range(0, len(data), stride)]
                        bodies = [data[k * stride + head : k * stride + head + h[2] * width] for k, h in enumerate(heads)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(at, at + len(heads))), pa.array([shard] * len(heads), pa.int32()), pa.array([h[0] for h in heads], pa.int64()), pa.array([h[3] for h in heads], pa.bool_()), pa.array([h[1] for h in heads], pa.int32()), pa.array([h[2] for h in heads], pa.int32()), pa.array(bodies, pa.binary())],
                            ["slot", "shard", "id", "has_id", "seq_no", "n_tokens", "payload"],
                        )
                        at += len(heads)

    wanted = manifest.where(F.col("first_slot") + F.col("n_records") > from_slot).select("shard", "path", "first_slot", "n_records")
    return wanted.repartition(max(1, min(wanted.count(), READERS)), "shard").mapInArrow(read, "slot long, shard int, id long, has_id boolean, seq_no int, n_tokens int, payload binary")
