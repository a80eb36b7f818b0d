"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is the set of its five-word shingles; a document contains it if at least THRESHOLD of them are among the
document's.  An item's sketch is its floor((1 - THRESHOLD) * n) + 1 smallest shingle hashes, where shingles of more than
COMMON items come after all others, so that what many items and documents share calls up few items: a document that contains the
item lacks at most floor((1 - THRESHOLD) * n) shingles, so it has one of the sketch, and no containing document is
missed however long it is.  Documents are partitioned by size, in powers of four of their words; an item is looked up
only in the partitions whose documents can be large enough.  Each partition has marks, a bit for each hash of its
sketches: shingles without one are passed over inside the document's array, the others become rows and are joined with the
sketches, and what that finds is checked on the shingles themselves.

All of it is DataFrame operations.  Words are lower-cased runs without white space and ASCII punctuation.

Defined results: a null text is empty and contains nothing; an item of fewer than five words has no shingle and is found
nowhere; rows without an id are in no pair, and `clean` keeps such documents; rows that share a doc_id are found if one
of them contains the item, with the largest containment; an empty table gives no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scope, columns_for, materialise, maybe_broadcast

SIZE, THRESHOLD = 5, 0.8
CLASSES = 16
COMMON = 8
#: Words of marks that a size class may have; with more hashes than these can tell apart more shingles go on to the join.
MARK_WORDS = 1 << 17


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D\p{Punct}]+"), "")


def _hashes(of: str) -> Column:
    """Hashes of the shingles of a column of word hashes, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(of) - SIZE), lambda at: F.xxhash64(*[F.col(of)[at + i] for i in range(SIZE)]))


def _shingles(of: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(of) - (SIZE - 1)), lambda i: F.concat_ws(" ", F.slice(F.col(of), i, SIZE)))


def _size_class(n: Column) -> Column:
    """Partition of a document of n words: powers of four."""
    return F.least(F.floor(F.length(F.bin(n)) / 2), F.lit(CLASSES - 1)).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, shingles, hashes): each item's distinct shingles, and their hashes in order."""
    rows = columns_for(benchmark, "item_id", "text").where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") >= SIZE)
    rows = rows.select("item_id", F.array_distinct(_shingles("words")).alias("shingles"))
    return rows.select("item_id", "shingles", F.array_sort(F.transform("shingles", lambda s: F.xxhash64(*[F.xxhash64(F.split(s, " ")[i]) for i in range(SIZE)]))).alias("hashes"))


def _mark(hash_: Column, n: Column) -> Column:
    """The place of a hash among n words of marks, a power of two."""
    return F.shiftrightunsigned(hash_, 6).bitwiseAND(n.cast("long") - 1).cast("int")


def _marks(sketches: DataFrame) -> DataFrame:
    """(class, marks): a bit set for each hash of the class's sketches, in about as many 64-bit words as it has hashes."""
    n = sketches.groupBy("class").agg(F.least(F.lit(MARK_WORDS), F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.countDistinct("hash") - 1)))).alias("n"))
    empty = n.select("class", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), F.lit(0).cast("long").alias("word"))
    bits = sketches.join(F.broadcast(n), "class").select("class", _mark(F.col("hash"), F.col("n")).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(63).cast("int")).alias("word"))
    words_ = empty.unionByName(bits).groupBy("class", "at").agg(F.bit_or("word").alias("word"))
    return materialise(words_.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("class", F.col("w.word").alias("marks")), "marks")


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every document and item that it contains."""
    items = materialise(items_of(benchmark), "items")
    n = F.size("hashes")
    need = F.ceil(n * F.lit(THRESHOLD) - 1e-9).cast("int")
    each = items.select("item_id", (need + SIZE - 1).alias("least_words"), (n - need + 1).alias("take"), F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg((F.count(F.lit(1)) > COMMON).alias("common"))
    order = Window.partitionBy("item_id", "least_words", "take").orderBy("common", "hash")
    sketches = each.join(common, "hash").withColumn("i", F.row_number().over(order)).where("i <= take").select("item_id", "least_words", "hash")
    sketches = sketches.distinct().select("item_id", "hash", F.explode(F.sequence(_size_class(F.col("least_words")), F.lit(CLASSES - 1))).alias("class"))
    sketches = materialise(sketches, "sketches")
    marks = F.broadcast(_marks(sketches))  # a row for each class, at most MARK_WORDS numbers

    source = columns_for(docs, "doc_id", "text").where("doc_id is not null")
    # arrays of numbers, not rows, until few shingles are left; the generator keeps the optimiser from putting the words'
    # hashes into the lambda below, where they would be computed again for each shingle
    split = source.select("doc_id", F.explode(F.array(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))).alias("words")).where(F.size("words") >= SIZE)
    split = split.withColumn("class", _size_class(F.size("words"))).join(marks, "class")
    low = split.select("doc_id", "class", F.array_distinct(F.filter(_hashes("words"), lambda h: F.getbit(F.col("marks")[_mark(h, F.size("marks"))], h.bitwiseAND(63).cast("int")) == 1)).alias("low"))
    hashed = low.select("doc_id", "class", F.explode("low").alias("hash"))
    pairs = hashed.join(maybe_broadcast(sketches), ["class", "hash"]).select("doc_id", "item_id").distinct()
    pairs = materialise(pairs, "contained-candidates")

    whole = source.join(maybe_broadcast(pairs), "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("words")).where(F.size("words") >= SIZE)
    whole = whole.join(maybe_broadcast(items.select("item_id", "shingles")), "item_id")
    shared = whole.select("doc_id", "item_id", F.size(F.array_intersect("shingles", _shingles("words"))).alias("shared"), F.size("shingles").alias("n"))
    found = shared.groupBy("doc_id", "item_id").agg(F.max("shared").cast("long").alias("n_shared"), F.max("n").cast("long").alias("n_shingles"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= THRESHOLD)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with their columns."""
    with Scope() as made:
        gone = made.keep(materialise(contained(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated"))
    return docs.join(maybe_broadcast(gone), docs["doc_id"] == F.col("__gone"), "left_anti").select(docs.columns)
