"""One-permutation MinHash fingerprints of documents, packed to a few bits per bin.

A text's word shingles are hashed once. The upper bits of a hash name its bin,
the rest is its value; a bin keeps its least value. An empty bin takes the
value of the first filled bin in a random order of its own: it probes hashed
bin numbers, and after PROBES misses ranks the filled bins by a hash. That is
a uniform choice among the filled bins (optimal densification). Stored are the lowest bits of every bin's value, one
hexadecimal digit a bin; the likeness of two fingerprints corrects the share
of equal digits for those equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.positions import cut_of, quantile_cuts
from trustfold.llm.columns import bound, hashes, whole, window_hashes

SHINGLE_WORDS = 5
#: Bins are named by the upper 8 bits of a hash, and keep the lowest 4 of the rest.
BIN_BITS, KEPT_BITS = 8, 4
BINS = 1 << BIN_BITS
#: Bins that an empty one probes before it ranks all filled ones.
PROBES = 6
#: Documents of one slice of the order by id.
SLICE_ROWS = 1_000


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``width`` words (split at white space, A-Z as they are); shorter texts have one of all their words."""
    words = F.filter(F.split(whole(text), r"[\x00-\x20]+"), lambda w: w != "")

    def runs(hashed: Column) -> Column:
        few = F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.when(F.size(hashed) >= width, window_hashes(hashed, width)).otherwise(few)

    return bound(hashes(words), runs)


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - BIN_BITS)  # signed: -128 to 127


def bin_values(hashed: Column) -> Column:
    """The densified value of every bin, in bin order; none for a text without words.

    One marker per bin, larger than all its values, is sorted in with the
    hashes, so that the first entry of each bin is its least value, or the
    marker if it is empty.
    """
    low = (1 << (64 - BIN_BITS)) - 1
    markers = F.array(*(F.lit((b << (64 - BIN_BITS)) | low) for b in range(-BINS // 2, BINS // 2)))
    ordered = F.sort_array(F.concat(hashed, markers))

    def firsts(all_values: Column) -> Column:
        return F.filter(all_values, lambda v, at: (at == 0) | (_bin(v) != _bin(F.get(all_values, at - 1))))

    def densified(least: Column) -> Column:
        empty = lambda v: v.bitwiseAND(F.lit(low)) == low

        def probe(i: Column, k: int) -> Column:
            found = F.get(least, F.xxhash64(i, F.lit(k)).bitwiseAND(F.lit(BINS - 1)).cast("int"))
            return F.when(~empty(found), found)

        def first_ranked(i: Column, filled: Column) -> Column:
            """The filled bin whose hash with bin ``i`` is least; its place rides in the lowest bits."""
            ranked = F.transform(filled, lambda f, p: F.xxhash64(i, _bin(f)).bitwiseAND(F.lit(-BINS)).bitwiseOR(p))
            return F.get(filled, F.array_min(ranked).bitwiseAND(F.lit(BINS - 1)).cast("int"))

        def dense(v: Column, i: Column, filled: Column) -> Column:
            return F.when(~empty(v), v).otherwise(F.coalesce(*(probe(i, k) for k in range(PROBES)), first_ranked(i, filled)))

        return bound(F.filter(least, lambda v: ~empty(v)), lambda filled: F.transform(least, lambda v, i: dense(v, i, filled)))

    return F.when(F.size(hashed) > 0, bound(bound(ordered, firsts), densified)).otherwise(F.expr("cast(array() as array<bigint>)"))


def fingerprint(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """One hexadecimal digit per bin; '' for a text without words.

    The digit is of a hash of value and bin, so that bins which share a
    borrowed value still agree by chance independently of each other.
    """
    low = (1 << KEPT_BITS) - 1
    digit = lambda v, at: F.hex(F.xxhash64(v, at).bitwiseAND(F.lit(low)))
    return F.lower(bound(shingle_hashes(text, width), lambda h: F.array_join(F.transform(bin_values(h), digit), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1; 1 for two texts without words, 0 for one, null for a null."""
    chance = 1 / (1 << KEPT_BITS)
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    corrected = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(corrected)
    )


def with_next(docs: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, text, slice, own, next_text) in the order by doc_id; after the last comes the first.

    Texts move once, to their slices. The first row of a slice is also sent to
    the slice before it as a guest (``own`` false), where it is the last
    one's next. Null ids come first; rows of one id follow each other by text.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    cuts = quantile_cuts(plain, "doc_id", plain.count(), rows) or [0]
    first = F.array(*map(F.lit, cuts))
    placed = plain.withColumn("slice", F.coalesce(cut_of(F.col("doc_id"), cuts), F.lit(0)))
    has_null = not plain.filter("doc_id is null").isEmpty()
    begins = F.col("doc_id").isNull() if has_null else F.col("doc_id") == cuts[0]
    guest_of = F.when(begins, F.lit(len(cuts) - 1)).when(F.array_contains(first, F.col("doc_id")) & (F.col("slice") > 0), F.col("slice") - 1)
    stays = F.struct(F.col("slice").alias("slice"), F.lit(True).alias("own"))
    visits = F.struct(guest_of.alias("slice"), F.lit(False).alias("own"))
    dealt = placed.select("doc_id", "text", F.inline(F.filter(F.array(stays, visits), lambda s: s["slice"].isNotNull())).alias("slice", "own"))
    order = Window.partitionBy("slice").orderBy(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by as many (or all) of the first ones of the next."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter))


def fingerprint_report(docs: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A null text counts as empty; a single document is its own next; extra
    columns are not carried; repeated rows get a row each; no rows give none.
    """
    placed = with_next(docs, rows)
    printed = placed.select(
        "doc_id", "slice", "own", "text", F.length("text").cast("long").alias("n_chars"),
        F.when(F.col("own"), edited(F.col("text"), F.col("next_text"))).alias("edited"), fingerprint(F.col("text")).alias("fingerprint"),
    )
    both = printed.select(
        "doc_id", "slice", "own", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        F.when(F.col("own"), fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    order = Window.partitionBy("slice").orderBy(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next", F.lead("fingerprint").over(order)).filter("own").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
