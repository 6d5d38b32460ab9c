"""Token ids in a binary file format: fixed-size id blocks as byte planes, each compressed with zstandard.

Documents are dealt out in ranges of doc_id, one shard per range. Each shard is a sequence of chunks,
a chunk holds whole documents and says which; its ids (each document's, then the end id) are cut into
blocks of `block` ids. A block is transposed: the first bytes of its 32-bit little-endian ids, then
the second bytes, and so on; each plane is a zstandard frame. Planes of high bytes are nearly constant,
planes of low bytes alike within themselves, and both compress better than interleaved bytes.

The chunk index is the chunk row without its payload: shard, chunk, the place of its first id in the
shard, documents, ids in each document, and the length of each plane. Chunk rows are written with
Spark's Parquet writer, so that a lost task leaves no half-written shard.

Defined results: a null or empty text is the end id alone; rows of the same doc_id stand in the order
of their texts; special strings in a text are special ids, as the tokenizers library has it by
default; a null doc_id sorts first; an empty table gives no rows; a long text takes as many blocks
as it needs in one chunk.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.bpe_count import byte_alphabet
from seqloom.llm.common import WHITE, in_batches, partitions, text_or_empty

BLOCK = 16_384
CHUNK_IDS = 262_144
PLANES = 4
CHUNK_SCHEMA = "shard int, chunk int, start long, n_ids long, doc_ids array<{kind}>, doc_sizes array<long>, plane_sizes array<int>, payload binary"
#: Punctuation that may be cut off a word's end, fixed; not apostrophes and not what special strings are made of.
MARKS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
#: Characters that are letters or digits beyond doubt.
SAFE = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: A piece of text that the tokenizer's pattern never joins to its neighbours: white space, then visible characters,
#: without the marks at its end where a letter or digit stands before them; such marks are a piece of their own.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}{MARKS}]+(?:[{MARKS}]+[^{WHITE}{MARKS}]+)*(?:(?<![{SAFE}])[{MARKS}]+)?|[{MARKS}]+(?=[{WHITE}]|\\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Encoder:
    """Texts to ids by the tokenizers library; the ids of pieces that were met before are remembered.

    The tokenizer's pattern always cuts between a visible character and white space after it, and between a letter
    or digit and marks after it, so the ids of a text are those of its pieces one after another.
    """

    def __init__(self, path: str, remembered: int = 1_300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = dict(enumerate(byte_alphabet()))
        self.remembered, self.ids = remembered, {}

    def learn(self, piece: str) -> bytes:
        """The library's ids of a piece. A word of letters, with a space before it or not, is one unit of its pattern and goes to its model straight."""
        if len(self.ids) >= self.remembered:
            self.ids.clear()
        if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()):
            found = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        else:
            found = self.library.encode(piece, add_special_tokens=False).ids
        ids = self.ids[piece] = array("I", found).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        pieces = PIECE.findall(text)
        found = [*map(self.ids.get, pieces)]
        at = -1
        while True:
            try:
                at = found.index(None, at + 1)
            except ValueError:
                return b"".join(found)
            found[at] = self.ids.get(pieces[at]) or self.learn(pieces[at])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray, block: int = BLOCK, level: int = 1) -> tuple[list[int], bytes]:
    """Plane sizes and payload of ids: for each block PLANES compressed planes."""
    write, planes = zstandard.ZstdCompressor(level=level).compress, []
    for i in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[i : i + block].astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
        planes += [write(p.tobytes()) for p in part]
    return [len(p) for p in planes], b"".join(planes)


def unpack(sizes: list[int], payload: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of a payload."""
    read, out, at = zstandard.ZstdDecompressor().decompress, np.empty((n, PLANES), np.uint8), 0
    for k, size in enumerate(sizes):
        first = k // PLANES * block
        rows = out[first : first + block]
        rows[:, k % PLANES] = np.frombuffer(read(payload[at : at + size], max_output_size=len(rows)), np.uint8)
        at += size
    return out.reshape(-1).view("<u4")


def encode_chunks(docs: DataFrame, tokenizer: str, *, end_id: int = 0, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The chunk rows of docs, shards in ascending order of the ids. Shuffles the texts once."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    rows = rows.repartitionByRange(shards or partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    names = ["shard", "chunk", "start", "n_ids", "doc_ids", "doc_sizes", "plane_sizes", "payload"]

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, chunk, start, ids, doc_ids, sizes, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush():
            nonlocal chunk, start, ids, doc_ids, sizes, held
            plane_sizes, payload = pack(np.frombuffer(b"".join(ids), "<u4"))
            row = [[shard], [chunk], [start], [held], [doc_ids], [sizes], [plane_sizes], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            chunk, start, ids, doc_ids, sizes, held = chunk + 1, start + held, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(encode(text) + end)
                doc_ids.append(doc_id)
                sizes.append(len(ids[-1]) // 4)
                held += sizes[-1]
                if held >= CHUNK_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    return rows.transform(in_batches, run, CHUNK_SCHEMA.format(kind=kind))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, **options) -> None:
    encode_chunks(docs, tokenizer, **options).write.mode("overwrite").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Each chunk with the number of ids before it in all shards. Reads no payload."""
    chunks = spark.read.parquet(path).select("shard", "chunk", "start", "n_ids", F.size("doc_ids").alias("n_docs"), F.size("plane_sizes").alias("n_planes"))
    # a row per shard: as many as partitions were written, whatever the size of the table
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(shards.select("shard", before.alias("before")), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_documents(spark: SparkSession, path: str, *, id_column: str = "doc_id") -> DataFrame:
    """Per document, from the files: start, n_tokens and the ids' crc32."""
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a chunk at a time: blocks of one chunk are in memory
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(row["plane_sizes"], row["payload"], row["n_ids"])
                ends = np.cumsum(row["doc_sizes"])
                first = ends - row["doc_sizes"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, ends)]
                n, id_type = len(crc), batch.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], id_type), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["start"] + first, pa.int64()), pa.array(row["doc_sizes"], pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "shard", "start", "n_tokens", "ids_crc32"],
                )

    rows = chunks.transform(in_batches, run, f"id {kind}, shard int, start long, n_tokens long, ids_crc32 long")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per written shard, so it can be sent to every task
    shards = F.broadcast(shards.select("shard", before.alias("before")))
    return rows.join(shards, "shard").select(F.col("id").alias(id_column), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
