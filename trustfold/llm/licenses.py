"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Texts and templates become five-word shingles. A template of fewer words is
looked for as a run of its own length. Any other is put into one of three
classes by its length; a class has a window length, and windows that
overlap by half run over every text, and at every offset over the templates.
The k least
shingle hashes of a window (its bottom-k MinHash) are a band each.

A copy that keeps 0.8 of a template of t shingles holds, for windows of w
shingles with t >= 1.5 w, a whole window inside it, and the best of these
shares at least 0.8 of its shingles with the template window at its place:
likeness 2/3. The least shared hash stands in both bottoms unless k unshared
ones lie below it, so two windows that differ in fewer than k shingles always
meet: 4 of 8 may differ, 13 of 32. Beyond that the k least of both together
are all unshared with a probability of at most (1/3)^k, 1 of 243 for the five
of eight shingles. Exact copies are never missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable
from trustfold.llm.columns import bound, loose_hashes, text_key, whole, window_hashes
from trustfold.llm.decontamination import BETWEEN_RAW, words

SHINGLE_WORDS = 5
LEAST_CONTAINMENT = 0.8
#: Bytes of a row that lists the templates of a text.
MATCH_BYTES = 500
#: (least shingles of a template, shingles of a window, bands of a window) of each class.
CLASSES = ((1, 1, 1), (12, 8, 5), (48, 32, 14))


def shingles(found: Column, width: int = SHINGLE_WORDS) -> Column:
    """Distinct shingles of a list of words; fewer words than ``width`` make one shingle of all, none make none."""
    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda at: F.array_join(F.slice(w, at, width), " "))
        few = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.array_distinct(F.when(F.size(w) >= width, every).otherwise(few))

    return bound(found, runs)


def runs_of(found: Column, length: int) -> Column:
    """Distinct runs of ``length`` words of a list; fewer words make none."""
    return F.when(F.size(found) >= length, shingles(found, length)).otherwise(F.expr("cast(array() as array<string>)"))


def shingles_of(hashed: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of a bound list of word hashes, in their order and with repeats."""
    few = F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(F.size(hashed) >= width, window_hashes(hashed, width)).otherwise(few)


def shingle_hashes(found: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of a list of words in any case, in their order and with repeats."""
    return bound(loose_hashes(found), lambda hashed: shingles_of(hashed, width))


def least_hashes(hashed: Column, window: int, count: int, step: int) -> Column:
    """The ``count`` least hashes of each window that starts at every ``step``-th shingle, and of the last window."""
    if window == 1:
        return hashed
    last = F.size(hashed) - window
    starts = F.when(last >= 0, F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.flatten(F.transform(starts, lambda at: F.slice(F.sort_array(F.slice(hashed, at + 1, window)), 1, count)))


def bands(rows: DataFrame, kinds: list[int], hashed: Column, *kept: str) -> DataFrame:
    """(kept columns, band) of ``hashed``, a list of hashes for each of ``kinds``; equal hashes of two kinds are two bands.

    Lists are unfolded in two steps, so that bands are hashed in generated code.
    """
    parted = rows.select(*kept, F.posexplode(hashed).alias("_at", "_hashes"))
    kind = F.get(F.array(*map(F.lit, kinds)), F.col("_at"))
    single = parted.select(*kept, kind.alias("_kind"), F.explode("_hashes").alias("_hash"))
    return single.select(*kept, F.xxhash64("_kind", "_hash").alias("band"))


def short_lengths(templates: DataFrame) -> list[int]:
    """Lengths, in words, of the templates too short for a shingle."""
    size = F.size(words(F.col("text"))).alias("n")
    return sorted(r["n"] for r in templates.select(size).filter(F.col("n").between(1, SHINGLE_WORDS - 1)).distinct().collect())


def template_bands(templates: DataFrame) -> DataFrame:
    """(band, template_id) of every window of every template, by its class. Templates without words have none."""
    found = templates.select("template_id", words(F.col("text")).alias("w"))
    rows = found.filter(F.size("w") >= SHINGLE_WORDS).select("template_id", shingle_hashes(F.col("w")).alias("h"))
    parts = []
    for n in range(1, SHINGLE_WORDS):
        few = found.filter(F.size("w") == n).select("template_id", loose_hashes(F.col("w")).alias("h"))
        parts.append(bands(few, [-n], F.array(window_hashes(F.col("h"), n)), "template_id"))
    for number, (least, window, count) in enumerate(CLASSES):
        size = F.size("h") >= least
        if number + 1 < len(CLASSES):
            size &= F.size("h") < CLASSES[number + 1][0]
        parts.append(bands(rows.filter(size), [window], F.array(least_hashes(F.col("h"), window, count, 1)), "template_id"))
    return reduce(DataFrame.union, parts).select("band", "template_id").distinct()


def candidates(docs: DataFrame, templates: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, text_key, template_id) of texts and templates that share a band; ``short`` has the lengths of short templates."""
    known = durable(template_bands(templates), "template-bands")
    windows = lambda h: F.array(*(least_hashes(h, window, count, max(1, window // 2)) for _, window, count in CLASSES))

    def every(hashed: Column) -> Column:  # words are split and hashed once, for shingles and for short runs
        long = bound(shingles_of(hashed), windows)
        return F.concat(long, F.array(*(window_hashes(hashed, n) for n in short))) if short else long

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
        bound(loose_hashes(F.array_remove(F.split(whole(F.col("text")), BETWEEN_RAW), "")), every).alias("hashed"),
    )
    kinds = [window for _, window, _ in CLASSES] + [-n for n in short]
    found = bands(keyed, kinds, F.col("hashed"), "doc_id", "text_key")
    return found.join(broadcast_if_small(known), "band").select("doc_id", "text_key", "template_id").distinct()


def license_matches(docs: DataFrame, templates: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, template_id, license, n_shared, containment) of the templates that a text contains.

    ``containment`` is the share of a template's distinct shingles that occur
    in the text, compared as words; one of fewer than five words has a single
    run of its own length. ``templates`` has template_id, license and
    text; its ids are unique. Repeated rows of ``docs`` give one row.
    """
    short = short_lengths(templates)
    found = durable(candidates(docs, templates, short), "license-candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"), F.col("text").cast("string").alias("text"))
    named = templates.select("template_id", "license", shingles(words(F.col("text"))).alias("template"))
    match = texts["_id"].eqNullSafe(found["doc_id"]) & (texts["_key"] == found["text_key"])
    ids = found.groupBy("doc_id", "text_key").agg(F.collect_set("template_id").alias("ids"))
    held = texts.join(broadcast_if_small(ids, row_bytes=MATCH_BYTES), match)
    sets = held.select("doc_id", "text_key", "ids", bound(words(F.col("text")), lambda w: F.concat(shingles(w), *(runs_of(w, n) for n in short))).alias("shingles"))
    pairs = sets.select("doc_id", "text_key", "shingles", F.explode("ids").alias("template_id")).join(broadcast_if_small(named), "template_id")
    shared = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", "template")))
    share = F.col("n_shared") / F.size("template")
    return shared.filter(share >= least).select("doc_id", "text_key", "template_id", "license", "n_shared", share.alias("containment")).distinct()


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """(doc_id, matches) of every row; ``matches`` lists template_id, license, n_shared and containment, sorted.

    Null and empty texts match nothing; null ids stay null; repeated rows get
    a row each; extra columns are not carried; no templates match no text.
    """
    found = license_matches(docs, templates, least).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("template_id", "license", "n_shared", "containment"))).alias("matches")
    )
    found = broadcast_if_small(durable(found, "licenses"), row_bytes=MATCH_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    match = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])
    none = F.expr("cast(array() as array<struct<template_id:string,license:string,n_shared:int,containment:double>>)")
    return rows.join(found, match, "left").select(rows["doc_id"], F.coalesce("matches", none).alias("matches"))
