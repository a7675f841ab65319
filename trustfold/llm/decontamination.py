"""Removal of benchmark passages from training texts, by normalised word n-grams.

The n-grams of the benchmark are broadcast as hash sets of at most SET_GRAMS
rows, one pass over the texts for each set. A text's windows are looked up
inside the task that reads it, by a hash that folds the case of all letters;
hits are verified on the words themselves, and only verified ones are shuffled. Documents or the hit spans then go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable
from trustfold.llm.columns import bound, loose_hashes, lower_ascii, run_hashes, text_key, whole

WINDOW = 13
#: N-grams of one broadcast set, some 200 bytes each.
SET_GRAMS = 100_000
#: Bytes of a row of hits: two keys, two counts and the ids of some items.
HIT_BYTES = 500
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: What lies between words, once A-Z are in lower case and before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words of a text as they are written; a null text has none."""
    return F.filter(F.split(whole(text), BETWEEN_RAW), lambda w: w != "")


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a null text has none."""
    return F.filter(F.split(lower_ascii(whole(text)), BETWEEN), lambda w: w != "")


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, gram, hash): each distinct window of each item; an item of fewer words is one window, one without words none.

    ``item_id`` comes as string; null ids stay null and count as one item.
    """
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
        .withColumn("size", F.least(F.size("w"), F.lit(window))).filter("size > 0")
    )
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    cut = items.withColumn("at", starts).select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram"))
    one = lambda n: F.get(bound(loose_hashes(F.col("gram")), lambda h: run_hashes(h, n)), F.lit(0))
    by_size = reduce(lambda c, n: c.when(F.col("size") == n, one(n)), range(2, window + 1), F.when(F.col("size") == 1, one(1)))
    return cut.withColumn("hash", by_size).distinct()


def verified_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_grams: int = SET_GRAMS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, hit_words, items) of the texts that hold a window of an item.

    ``hit_words`` are the 0-based places of words inside any occurrence,
    ``items`` the ids of the items whose windows occur. Repeated rows give one.
    """
    grams = durable(benchmark_grams(benchmark, window), "grams")
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most ``window`` numbers
    passes = -(-grams.count() // set_grams) if sizes else 1
    grams = grams.groupBy("size", "hash", "gram").agg(F.collect_set("item_id").alias("items"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")

    def placed(hashed: Column, size: int) -> Column:
        return F.transform(run_hashes(hashed, size), lambda x, at: F.struct(at.alias("at"), F.lit(size).alias("size"), x.alias("hash")))

    every = lambda h: F.concat(*(placed(h, n) for n in sizes or [window]))
    # neither text nor words go along with the windows: most match nothing
    windows = text.select("doc_id", "text_key", F.inline(bound(loose_hashes(raw_words(F.col("text"))), every)))
    found = []
    for part in range(passes):
        some = grams.filter(F.pmod("hash", F.lit(passes)) == part) if passes > 1 else grams
        found.append(windows.join(F.broadcast(some.select("hash", "size").distinct()), ["hash", "size"]))
    near = durable(
        reduce(DataFrame.union, found).groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("at", "size", "hash")).alias("places")), "near-hits",
    ).withColumnsRenamed({"doc_id": "near_doc", "text_key": "near_key"})
    match = F.col("doc_id").eqNullSafe(F.col("near_doc")) & (F.col("text_key") == F.col("near_key"))
    # only ids are broadcast, and only the texts with hits move to where their places are
    held = text.join(broadcast_if_small(near.select("near_doc", "near_key")), match, "left_semi")
    placed_texts = held.join(near, match).select("doc_id", "text_key", raw_words(F.col("text")).alias("words"), "places")
    rows = placed_texts.select("doc_id", "text_key", "words", F.inline("places"))
    same = (rows["hash"] == grams["hash"]) & (rows["size"] == grams["size"]) & (
        F.transform(F.slice("words", F.col("at") + 1, rows["size"]), lower_ascii) == grams["gram"])
    few = F.broadcast(grams) if passes == 1 else grams
    checked = rows.join(few, same).select("doc_id", "text_key", F.size("words").alias("n_words"), "at", rows["size"], "items")
    spread = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))
    return (
        checked.groupBy("doc_id", "text_key", "n_words")
        .agg(F.sort_array(F.array_distinct(spread)).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .withColumn("n_hit", F.size("hit_words"))
    )


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, set_grams: int = SET_GRAMS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row.

    Null and empty texts have no words and are clean; so is every text when
    the benchmark is empty. Repeated rows get a row each, null ids stay null.
    """
    hits = durable(verified_hits(docs, benchmark, window, set_grams).drop("n_words", "hit_words"), "hits")
    hits = broadcast_if_small(hits, row_bytes=HIT_BYTES)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.size(raw_words(F.col("text"))).alias("n_words")
    )
    match = texts["doc_id"].eqNullSafe(hits["doc_id"]) & (texts["text_key"] == hits["text_key"])
    n_hit = F.coalesce("n_hit", F.lit(0))
    return texts.join(hits, match, "left").select(
        texts["doc_id"], F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        is_contaminated(n_hit, F.col("n_words"), share).alias("contaminated"),
    )


def _rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to keyed rows by id and text, both null-safe."""
    match = docs["doc_id"].cast("long").eqNullSafe(keys["_hit_doc"]) & (text_key(docs["text"]) == keys["_hit_key"])
    return docs.join(broadcast_if_small(keys), match, how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, set_grams: int = SET_GRAMS) -> DataFrame:
    """``docs`` without contaminated rows; the other rows and all columns stay as they are."""
    hits = verified_hits(docs, benchmark, window, set_grams).filter(is_contaminated(F.col("n_hit"), F.col("n_words"), share))
    return _rows_of(docs, durable(hits.select(F.col("doc_id").alias("_hit_doc"), F.col("text_key").alias("_hit_key")), "contaminated"), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_grams: int = SET_GRAMS) -> DataFrame:
    """``docs`` with every word inside an occurrence taken out of the text, along with what follows it up to the next word."""
    hits = verified_hits(docs, benchmark, window, set_grams)
    keys = durable(hits.select(F.col("doc_id").alias("_hit_doc"), F.col("text_key").alias("_hit_key"), F.col("hit_words").alias("_hit_words")), "spans")
    joined = _rows_of(docs, keys, "left")
    text = docs["text"].cast("string")
    # pieces alternate: what lies before the first word, then words, each with what follows it
    lead = F.regexp_extract(text, f"^{BETWEEN_RAW}", 0)
    parts = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    kept = F.filter(parts, lambda _, at: ~F.array_contains(keys["_hit_words"], at))
    cut = F.when(keys["_hit_words"].isNull(), text).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.select(*[cut.alias(c) if c == "text" else docs[c] for c in docs.columns])
