"""Benchmark decontamination with DataFrame functions alone.

The windows of all benchmark items, hashed, are one side of a join; the other
is every window of the documents. Hits are verified word by word in the join
condition, so a hash collision changes nothing. Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismara.llm.shared import fresh, small_broadcast, stored
from prismara.llm.text import ALNUM_WORD, LOWER, UPPER

#: Windows are broadcast up to this many bytes of words and ids. Beyond, their hashes alone are, up to so many, and only
#: document windows of those hashes are shuffled to be verified; beyond that, all are.
BROADCAST_BYTES, BROADCAST_HASHES = 64 << 20, 4_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of a-z, 0-9 and characters outside ASCII; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(ALNUM_WORD), F.lit(0))


def _hash(array: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(array, start + k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The distinct windows with the ids of their items: ``b_n`` words, ``b_words``, ``b_items``.

    An item of fewer than ``window`` words is one window; one without words has
    none. An item id that is null stands as the empty string.
    """
    w = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = w.select("item", "w", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("i"))
    return at.groupBy(F.slice("w", F.col("i"), window).alias("b_words")).agg(F.collect_set("item").alias("b_items")).select(F.size("b_words").alias("b_n"), "b_words", "b_items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, broadcast_bytes: int = BROADCAST_BYTES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """What of the benchmark occurs in each document.

    Columns: ``id_col``, ``n_words``, ``n_hit`` (words inside an occurrence of
    a window), ``n_items`` (items with occurring windows), ``items_sha256``
    (of those ids, sorted as strings and comma-joined), ``contaminated``
    (``n_hit`` > 0 and at least a twentieth of the words), ``items``.

    There is one row for each input row, whether ids repeat or are null. Null
    and empty texts have no words and no hits. An empty benchmark hits
    nothing. Columns of other names are not read.
    """
    windows, _ = stored(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    size = windows.agg(F.collect_set("b_n"), F.sum(F.octet_length(F.concat_ws(" ", "b_words")) + F.octet_length(F.concat_ws(" ", "b_items")) + 64)).first()
    lengths, n_bytes = sorted(size[0]) or [window], size[1] or 0

    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select("uid", "id", "w", F.size("w").alias("n_words"))
    # Place -1 stands for the document itself, so that one without hits stays.
    d = d.select("*", F.explode_outer(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - lengths[0]))).alias("at"))
    if len(lengths) == 1:
        d = d.select("*", F.lit(lengths[0]).alias("n"), F.when(F.col("at") >= 0, _hash(F.col("w"), F.col("at"), lengths[0])).alias("h"))
    else:
        each = F.array(*(F.struct(F.lit(n).alias("n"), F.when((F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words")), _hash(F.col("w"), F.col("at"), n)).alias("h")) for n in lengths))
        d = d.select("*", F.explode_outer(F.when(F.col("at") < 0, F.slice(each, 1, 1)).otherwise(each)).alias("x")).select("*", "x.n", "x.h").drop("x")
    # A place without a hash must not meet the others that have none in one task.
    d = d.withColumn("h", F.coalesce("h", F.xxhash64("uid", "at")))
    hashed = F.coalesce(*(F.when(F.col("b_n") == n, _hash(F.col("b_words"), F.lit(0), n)) for n in lengths))
    b = windows.select(hashed.alias("b_h"), "b_n", "b_words", "b_items")
    window_words = F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("n"))
    if n_bytes <= broadcast_bytes:
        b = F.broadcast(b)  # the words of a document stay where they are
    else:
        hashes, _ = stored(b.select(F.col("b_h").alias("h")).distinct(), "hashes")
        if hashes.count() <= broadcast_hashes:
            there = F.broadcast(hashes.withColumn("b_there", F.lit(True)))
            d = d.join(there, "h", "left").where((F.col("at") < 0) | F.col("b_there")).drop("b_there")
        b = b.hint("merge")
        d, window_words = d.withColumn("w", window_words), F.col("w")  # only a window's own words are shuffled
    same = (F.col("h") == F.col("b_h")) & (F.col("n") == F.col("b_n")) & (F.col("at") >= 0) & (window_words == F.col("b_words"))
    hits = d.join(b, same, "left").where((F.col("at") < 0) | F.col("b_n").isNotNull()).select("uid", "id", "n_words", "at", (F.col("at") + F.col("b_n")).alias("end"), "b_items")

    before = Window.partitionBy("uid").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("at") >= 0, F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0)))))
    per = hits.withColumn("new", new).groupBy("uid", "id", "n_words").agg(F.sum(F.coalesce("new", F.lit(0))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("b_items")))).alias("items"))
    return per.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "items",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that :func:`contamination` does not call contaminated, with all their columns.

    Of rows with one id, all go if one is contaminated. Rows with a null id stay.
    """
    name = fresh(docs, "bad")
    bad, _ = stored(contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias(name)).distinct(), "contaminated")
    return docs.join(small_broadcast(bad), F.col(id_col) == F.col(name), "left_anti")
