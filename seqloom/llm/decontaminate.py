"""Benchmark decontamination with DataFrame functions alone.

Words of both tables are normalised alike (A-Z in lower case; a word is a run of letters and digits, any
character beyond ASCII counting as one). The benchmark's windows of 10 words, and whole items of fewer,
make a set of 64-bit hashes. One scan of the documents hashes the windows of all widths, looks them up in the set where
they are read, and gives the hits with their words beside one row per document with its number of words; a
join on the words verifies the hits and finds their items. The set is broadcast only while it has at most
`broadcast_windows` hashes (eight bytes each), which is counted first; beyond that the same lookup is a shuffled join on the hash.

Defined results: a null or empty text has no words and no hits; an item without words has no window;
equal items are each counted; rows of equal doc_id and text get equal results, as many rows as came in;
an empty benchmark hits nothing; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in texts whose letters A-Z are still there.
RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item, window (its words), size and key (its hash) of each window of each item."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), words(F.col(text_column)).alias("words")).where(F.size("words") > 0)
    own = F.least(F.size("words"), F.lit(width))
    rows = rows.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - own + 1), lambda i: F.slice("words", i, own))).alias("window")).distinct()
    key = F.aggregate("window", F.lit(None).cast("long"), lambda hashed, word: F.xxhash64(hashed, word))
    return rows.select("item", "window", F.size("window").alias("size"), key.alias("key"))


def scanned(docs: DataFrame, windows: DataFrame, *, id_column: str, text_column: str, broadcast_windows: int) -> DataFrame:
    """id and row (a hash of id and text), and either n_words, once for each row of docs, or at, size and window of each hit."""
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count_distinct("key").alias("n")).collect()}  # as many rows as a window has words, at most
    base = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column), text_column).alias("row"), words(F.col(text_column)).alias("words"))
    document = [F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("window")]
    if not sizes:
        return settled(base.select("id", "row", *document))
    known = windows.select("key").distinct().withColumn("hit", F.lit(True))
    # place -1 stands for the document itself
    rows = base.select("id", "row", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    # a window's hash is that of the one shorter by its last word, hashed with this word
    key, each = F.lit(None).cast("long"), []
    for k in range(max(sizes)):
        key = F.xxhash64(key, F.get("words", F.col("at") + k))
        if k + 1 in sizes:
            rows = rows.withColumn(f"key{k + 1}", key)
            key = F.col(f"key{k + 1}")
            inside = (F.col("at") >= 0) & (F.col("at") + (k + 1) <= F.size("words"))
            each.append(F.struct(F.lit(k + 1).alias("size"), F.when(inside, key).alias("key")))
    rows = rows.select("id", "row", "words", "at", F.inline(F.array(*each)))
    inside = F.col("at") >= 0
    window = F.when(inside, F.slice("words", F.col("at") + 1, F.col("size"))).alias("window")
    if sum(sizes.values()) <= broadcast_windows:
        own = ~inside & (F.col("size") == min(sizes))
        found = rows.join(F.broadcast(known), "key", "left").where(F.col("hit") | own)
        n_words = F.when(own, F.size("words").cast("long")).alias("n_words")
        found = found.select("id", "row", n_words, F.when(inside, F.col("at")).alias("at"), F.when(inside, F.col("size")).alias("size"), window)
    else:  # what is shuffled is the window, not the text
        sought = rows.where(F.col("key").isNotNull()).select("id", "row", F.lit(None).cast("long").alias("n_words"), "at", "size", window, "key")
        found = sought.join(known, "key").drop("key", "hit").unionByName(base.select("id", "row", *document))
    return settled(found)


def per_document(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, id_column: str = "doc_id", text_column: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, row, n_words, copies (rows of that id and text), spans (sorted struct at, width) and items (sorted strings) of each id and text."""
    windows = settled(benchmark_windows(benchmark, width))
    seen = scanned(docs, windows, id_column=id_column, text_column=text_column, broadcast_windows=broadcast_windows)
    found = seen.where(F.col("at").isNotNull()).distinct()
    # verified: the words are those of a window, not only their hash
    hits = found.join(windows.select("window").distinct(), "window").select("id", "row", F.lit(None).cast("long").alias("n_words"), F.struct("at", F.col("size").alias("width")).alias("span"), F.lit(None).cast("string").alias("item"))
    items = found.select("id", "row", "window").distinct().join(windows.select("window", "item"), "window").select("id", "row", "item").distinct()
    items = items.select("id", "row", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("struct<at:int,width:int>").alias("span"), "item")
    own = seen.where(F.col("at").isNull()).select("id", "row", "n_words", F.lit(None).cast("struct<at:int,width:int>").alias("span"), F.lit(None).cast("string").alias("item"))
    # a document's own hits and items
    rows = own.unionByName(hits).unionByName(items).groupBy("id", "row")
    return rows.agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("item")).alias("items"))


def covered(spans: Column) -> Column:
    """The number of words that sorted (at, width) spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, span: Column) -> Column:
        end = span["at"] + span["width"]
        more = F.greatest(end - F.greatest(span["at"], acc["end"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    found = per_document(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    n_hit = covered(F.col("spans"))
    out = found.select(F.col("id").alias(id_column), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "copies")
    out = out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.drop("copies")


def remove_hits(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", drop_documents: bool = False, **options) -> DataFrame:
    """docs without the words of hits and what separates them from the next word, or without documents that have hits."""
    found = per_document(docs, benchmark, id_column=id_column, text_column=text_column, **options).where(F.size("spans") > 0)
    hit_id, hit_row, spans = (fresh(docs, n) for n in ("_hit_id", "_hit_row", "_spans"))
    found = found.select(F.col("id").alias(hit_id), F.col("row").alias(hit_row), F.col("spans").alias(spans))
    on = F.col(id_column).eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.col(id_column), text_column) == F.col(hit_row))
    if drop_documents:
        return docs.join(found, on, "left_anti")
    # each word with what separates it from the next
    parts = F.regexp_extract_all(text_column, F.lit(f"{RAW_WORD}+{RAW_BETWEEN}*"), F.lit(0))
    inside = F.filter(
        F.transform(parts, lambda p, i: F.when(~F.exists(spans, lambda s: (s["at"] <= i) & (i < s["at"] + s["width"])), p)),
        lambda p: p.isNotNull(),
    )
    kept = F.concat(F.regexp_extract(text_column, f"^{RAW_BETWEEN}*", 0), F.array_join(inside, ""))
    text = F.when(F.col(spans).isNull(), F.col(text_column)).otherwise(kept)
    return docs.join(found, on, "left").withColumn(text_column, text).select(*docs.columns)
