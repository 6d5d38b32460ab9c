"""Hard-negative mining by a two-dimensional block matrix multiply.

Components become floor(256 * x); the score of an anchor and a row is their integer inner product. All scores of anchors against
rows are one matrix product, made in blocks:

1. Rows are dealt to row blocks of about `ROW_BLOCK`, anchors to anchor blocks of about `ANCHOR_BLOCK`, and the components of both to
   chunks of `CHUNK`. A block's chunk is one record of packed integers.
2. An anchor chunk is sent to every row block; the task of a (row block, chunk) multiplies the two, which gives a partial tile of
   64-bit sums (packed in as few bytes as the largest one needs).
3. Partial tiles are shuffled by (anchor block, row block) and added. Of a whole tile only the best rows of each anchor leave.
4. First the product gives each anchor its best rows of the same label, its positives. Their scores are the windows of the
   negatives, so the product is made again, and a tile gives for each (anchor, positive) its best rows of another label in the
   window. The few rows of all tiles are merged by (anchor, positive).

Multiplying twice takes less than keeping the matrix. Anchors are gone through in panels of `PANEL`, each a round of jobs whose result is
written to the shared folder, so what is in shuffle files at a time grows with the rows and not with their square. The work is
anchors x rows, which is what is asked for.

Products of floating-point numbers are exact here, as a chunk's sums stay below 2**53, which is checked; beyond, integers are multiplied.

Defined results: rows with a null label, a null vector or null or non-finite components take no part; a null id is no anchor and comes
after all others; rows of one id take part each for itself (a row isn't its own positive, an equal one can be); an anchor without a
positive and a positive without a negative give no rows; an empty table gives no rows. Vectors of different lengths and components
of 2**16 or more are errors.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches, partitions, settled, shared_dir
from seqloom.llm.vector_codes import LARGEST, usable, vectors_of

SCALE = 256
ROW_BLOCK = 4096
ANCHOR_BLOCK = 256
CHUNK = 32
PANEL = 2048
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
LEAST = np.iinfo(np.int64).min
WINDOWS = "array<struct<row:bigint,place:int,score:bigint>>"
MEMBERS = "array<struct<nameless:boolean,id:bigint,row:bigint,label:bigint>>"
CHUNK_SCHEMA = f"block int, chunk int, data binary, members {MEMBERS}"


def packed(x: np.ndarray) -> bytes:
    """A matrix of integers in as few bytes each as the largest needs; that number and the number of rows come first."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return np.array([width, len(x)], "<i4").tobytes() + x.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, rows = np.frombuffer(data, "<i4", 2).tolist()
    flat = np.frombuffer(data, f"<i{width}", offset=8).astype(np.int64)
    return flat.reshape(rows, len(flat) // rows)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def best(scores: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of the k largest values of each row, ties to the left; LEAST counts as none. scores is spoilt."""
    rows, out = np.arange(len(scores)), []
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        values = scores[rows, at]
        own = values > LEAST
        if not own.any():
            break
        out.append((rows[own], at[own], values[own]))
        scores[rows, at] = LEAST
    return out


def prepared(df: DataFrame, *, id_column: str, vector_column: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, label and vector (integers) of the rows that take part; written once."""
    x = F.col(vector_column)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = df.where(usable(x)).select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector")).where("label IS NOT NULL")
    wide = F.exists("vector", lambda c: F.abs(c) >= LARGEST * scale)
    fits = F.when(wide, F.raise_error(F.lit(f"a component is {LARGEST} or more"))).otherwise(F.col("vector")).cast("array<int>")
    rows = settled(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", fits.alias("vector")))
    widths = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"vectors of {widths['a']} and of {widths['b']} components")
    return rows


def chunks(rows: DataFrame, n: int, chunk: int) -> DataFrame:
    """block, chunk, data (packed components) and members of rows dealt to n blocks of about one size; members are in the order of ids and come with chunk 0 alone."""
    record = F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "label", "vector")
    dealt = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(record)).alias("held"))
    dealt = dealt.select("block", F.transform("held", lambda h: F.struct(h["nameless"].alias("nameless"), h["id"].alias("id"), h["row"].alias("row"), h["label"].alias("label"))).alias("members"), F.transform("held", lambda h: h["vector"]).alias("vectors"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                lists = own.column(2).flatten()
                vectors = lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)
                places = range(0, max(1, vectors.shape[1]), chunk)
                members = pa.concat_arrays([own.column(1), pa.nulls(len(places) - 1, own.column(1).type)])
                block = pa.array([own.column(0)[0].as_py()] * len(places), pa.int32())
                data = pa.array([packed(vectors[:, at : at + chunk]) for at in places], pa.binary())
                yield pa.RecordBatch.from_arrays([block, pa.array(range(len(places)), pa.int32()), data, members], ["block", "chunk", "data", "members"])

    return settled(dealt.transform(in_batches, run, CHUNK_SCHEMA, 4))


def tiles(anchors: DataFrame, rows: DataFrame, row_blocks: int) -> DataFrame:
    """ab, rb, chunk, tile (packed partial scores), own and other (members of both blocks, with chunk 0 alone) and windows of all blocks of anchors against all blocks of rows."""
    sent = anchors.select(F.col("block").alias("ab"), "chunk", F.col("data").alias("a"), F.col("members").alias("own"), "windows", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    met = sent.join(rows.select(F.col("block").alias("rb"), "chunk", F.col("data").alias("b"), F.col("members").alias("other")), ["rb", "chunk"])

    def run(batches):
        for batch in batches:
            found = [packed(product(unpacked(a), unpacked(b))) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary()), *batch.columns[5:]], ["ab", "rb", "chunk", "tile", "own", "other", "windows"])

    return met.select("ab", "rb", "chunk", "a", "b", "own", "other", "windows").transform(in_batches, run, f"ab int, rb int, chunk int, tile binary, own {MEMBERS}, other {MEMBERS}, windows {WINDOWS}", 4)


def added(parts: DataFrame, reduce, schema: str) -> DataFrame:
    """reduce(scores, own members, other members, windows) of each whole tile: partial tiles meet by (ab, rb) and are added."""

    def run(batches):
        last, scores, rest = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                part = unpacked(batch.column(3)[k].as_py())
                if key == last:
                    scores += part
                    continue
                if last is not None:
                    yield from reduce(scores, *rest)
                last, scores = key, part
                # chunk 0 comes first
                rest = [batch.column(c)[k].values for c in (4, 5, 6)]
        if last is not None:
            yield from reduce(scores, *rest)

    n = partitions(parts.sparkSession) * 4
    dealt = parts.repartition(n, "ab", "rb").sortWithinPartitions("ab", "rb", "chunk")
    return dealt.transform(in_batches, run, schema, 4)


def members_of(members: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return members.field("row").to_numpy(), members.field("label").to_numpy(), members.field("id")


def best_of_label(k: int):
    """The k best rows of an anchor's own label in a tile."""

    def reduce(scores, own, other, _):
        (row, label, ids), (others, labels, other_ids) = members_of(own), members_of(other)
        scores[(label[:, None] != labels[None, :]) | (row[:, None] == others[None, :])] = LEAST
        for i, at, score in best(scores, k):
            yield pa.RecordBatch.from_arrays([pa.array(row[i]), ids.take(pa.array(i)), other_ids.take(pa.array(at)), pa.array(score)], ["row", "anchor_id", "positive_id", "positive_score"])

    return reduce


def best_in_window(k: int, low: int, high: int):
    """For each positive of an anchor, the k best rows of another label in a tile whose scores are in the positive's window."""

    def reduce(scores, own, other, windows):
        (row, label, _), (others, labels, other_ids) = members_of(own), members_of(other)
        scores[label[:, None] == labels[None, :]] = LEAST
        place = {r: i for i, r in enumerate(row.tolist())}
        of = np.array([place[r] for r in windows.field("row").to_pylist()], np.int64)
        number, limit = windows.field("place").to_numpy(), windows.field("score").to_numpy()
        for n in np.unique(number).tolist():
            mine = np.flatnonzero(number == n)
            values, bound = scores[of[mine]], limit[mine, None]
            # scores are whole, so the bounds can be too: 100 * score would overflow sooner
            values[(values < -(-low * bound // 100)) | (values > high * bound // 100)] = LEAST
            for i, at, score in best(values, k):
                yield pa.RecordBatch.from_arrays([pa.array(row[of[mine[i]]]), pa.array(np.full(len(i), n, np.int32)), other_ids.take(pa.array(at)), pa.array(score)], ["row", "place", "negative_id", "negative_score"])

    return reduce


def first(df: DataFrame, keys: list[str], score: str, ident: str, k: int, name: str) -> DataFrame:
    """The k rows of each key of the highest scores, ties by smaller id, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident).asc_nulls_last())
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    df: DataFrame, anchor: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, chunk: int = CHUNK, panel: int = PANEL,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor (rows where the condition `anchor` on `id` holds)."""
    spark = df.sparkSession
    rows = prepared(df, id_column=id_column, vector_column=vector_column, label=F.col("label") if label is None else label)
    chosen = rows.where(anchor)
    n_rows, n_anchors = rows.count(), chosen.count()
    row_blocks, anchor_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    right, left = chunks(rows, row_blocks, chunk), chunks(chosen, anchor_blocks, chunk)
    folder, each = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", max(1, panel // anchor_block)
    for at in range(0, anchor_blocks, each):
        own = left.where(F.col("block").between(at, at + each - 1))
        none = F.lit(None).cast(WINDOWS)
        near = added(tiles(own.withColumn("windows", none), right, row_blocks), best_of_label(positives), "row long, anchor_id long, positive_id long, positive_score long")
        near = settled(first(near, ["row"], "positive_score", "positive_id", positives, "place"))
        block = F.pmod(F.xxhash64("row"), F.lit(anchor_blocks)).cast("int").alias("block")
        windows = near.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("row", "place", F.col("positive_score").alias("score")))).alias("windows"))
        # an anchor block without positives has no windows
        asked = own.join(windows, "block").withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
        hard = added(tiles(asked, right, row_blocks), best_in_window(negatives, low, high), "row long, place int, negative_id long, negative_score long")
        hard = first(hard, ["row", "place"], "negative_score", "negative_id", negatives, "rank")
        out = hard.join(near, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out.write.parquet(f"{folder}/panel={at // each}")
    return spark.read.parquet(folder).drop("panel")
