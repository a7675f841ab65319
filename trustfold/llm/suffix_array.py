"""Repeated byte strings by a partitioned suffix array.

A byte is repeated when a string of ``length`` bytes that covers it also
starts anywhere else, in another document or in its own. A whole suffix array
would move ``length`` bytes for each byte of text, so suffixes are sorted where
a repeat can be, and nowhere else:

1. Every window of ``length`` bytes names one anchor, the place in it whose
   following ``gram`` bytes have the least hash. Equal windows have equal
   anchors at equal places, so a window can only repeat if its anchor's bytes
   do: anchors are counted by hash, and those that stand alone are dropped.
2. What surrounds an anchor as far as its windows reach is its context. Where
   the same whole context stands twice, all windows of the anchor repeat.
   Contexts are counted with partial aggregates, so a passage with millions of
   copies is one row from here on.
3. Of each different context of a shared anchor one is cut from its text. These
   suffixes are range-partitioned by their leading bytes with sampled
   splitters. A bucket orders the suffixes, and what stands before them read
   backwards, by multikey quicksort over words of eight bytes. Common prefixes
   of neighbours then tell which windows agree on both sides.
4. An anchor with more than ``HOT_CONTEXTS`` contexts would be one task's
   burden. Its windows are range-partitioned one by one, by their leading bytes
   and a 128-bit fingerprint; buckets compare neighbours, and the first and
   last window of every bucket are compared across the boundaries.

Nothing is capped: both ways are exact up to 128-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.functions.sizing import BROADCAST_BYTES
from trustfold.functions.storage import durable

#: Different contexts of an anchor that one task compares (6 MB of them); beyond it its windows are spread over the cluster.
HOT_CONTEXTS = 20_000
#: Bytes of a text whose hashes are held at once, and bytes of contexts that a bucket sorts at once.
CHUNK_BYTES, SORT_BYTES = 1 << 18, 1 << 20
#: Contexts taken from a batch at once when their bytes are cut or their windows spread.
CONTEXTS_AT_ONCE = 512
#: Odd factor of the rolling hash and its inverse modulo 2^64, and the factor that spreads its bits.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
SPREAD = 0xBF58476D1CE4E5B9
#: Bits of a hash key that hold the place within a chunk.
PLACE_BITS = 20

KEY = ["doc_id", "text_hash"]


@dataclass(frozen=True)
class Repeats:
    """Bytes of a repeated string, and bytes whose hash makes an anchor."""

    length: int = 200
    gram: int = 80

    def __post_init__(self):
        if not 8 <= self.gram <= self.length:
            raise ValueError(f"gram must lie in 8..{self.length}, got {self.gram}")
        if self.reach > 255:
            raise ValueError("a window may hold at most 255 grams")

    @property
    def reach(self) -> int:
        """Places before an anchor at which its windows may start."""
        return self.length - self.gram


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


# --- anchors of one text ---

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        with np.errstate(over="ignore"):
            _powers[n] = tuple(np.cumprod(np.full(n, f, np.uint64)) for f in (FACTOR, INVERSE))
    return _powers[n]


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each place on, the same wherever they stand."""
    power, inverse = _power_tables(CHUNK_BYTES + 512)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
        found = (sums[gram:] - sums[:-gram]) * inverse[: len(text) - gram + 1]
        found ^= found >> np.uint64(29)
        found *= np.uint64(SPREAD)
        found ^= found >> np.uint64(32)
    return found


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash in each run of ``width``, the first one on ties."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    return (least & low).astype(np.int64)


def anchors_of(text: bytes, how: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of a text's anchors: its windows start at the places ``first`` to ``last``."""
    windows = len(text) - how.length + 1
    parts = []
    whole = np.frombuffer(text, np.uint8)
    for begin in range(0, max(windows, 0), CHUNK_BYTES):
        end = min(begin + CHUNK_BYTES, windows)
        hashes = _gram_hashes(whole[begin : end + how.length - 1], how.gram)
        place = _least_places(hashes, how.reach + 1)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        lasts = np.append(starts[1:], len(place)) - 1
        found = [hashes[place[starts]], place[starts] + begin, starts + begin, lasts + begin]
        if parts and parts[-1][1][-1] == found[1][0]:  # an anchor's windows may lie in two chunks
            parts[-1][3][-1] = found[3][0]
            found = [x[1:] for x in found]
        if len(found[0]):
            parts.append(found)
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def _context(text: bytes, place: int, how: Repeats) -> tuple[bytes, int]:
    """What surrounds an anchor as far as its windows reach, and how many bytes of it stand before the anchor."""
    begin = max(0, place - how.reach)
    return text[begin : place + how.length], place - begin


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place, and how far before it its windows start, in one number."""
    return place << 16 | (place - first) << 8 | (place - last)


def _anchors(docs: DataFrame, how: Repeats, grams_only: bool = False) -> DataFrame:
    """(gram), or (gram, context, doc_id, text_hash, at) of every anchor of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_py().encode()
                gram, place, first, last = anchors_of(text, how)
                if not len(gram):
                    continue
                arrays = [pa.array(gram.view(np.int64))]
                if not grams_only:
                    seen = [xxh3_64_intdigest(c, b) for c, b in (_context(text, p, how) for p in place.tolist())]
                    arrays += [
                        pa.array(np.array(seen, np.uint64).view(np.int64)), pa.repeat(doc, len(gram)), pa.repeat(key, len(gram)),
                        pa.array(_packed(place, first, last)),
                    ]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "context", *KEY, "at"][: len(arrays)])

    schema = "gram long" if grams_only else "gram long, context long, doc_id long, text_hash long, at long"
    return _keyed(docs).mapInArrow(_gathered(run), schema)


def _gathered(run, rows: int = 50_000):
    """``run`` with its small batches put together."""
    def gathered(batches):
        held, count = [], 0
        for batch in run(batches):
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return gathered


# --- buckets ---

def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; ``text`` ends in eight bytes more."""
    n = len(text) - 8
    found = np.zeros(n, np.uint64)
    for k in range(8):
        found = found << np.uint64(8) | text[k : k + n]
    return found


def multikey_order(groups: np.ndarray, words, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, agree): items sorted by group, then by ``words(k)`` for k below ``rounds``; words shared with the item before.

    Multikey quicksort, breadth first: a round orders by one word only those
    items that tie with a neighbour in all words before. ``agree`` is -1 at the
    first item of a group.
    """
    order = np.argsort(groups, kind="stable")
    tied = np.diff(groups[order], prepend=groups[order[:1]] - 1) == 0  # with the item before
    agree = np.where(tied, 0, -1)
    for k in range(rounds):
        live = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(live):
            break
        run = np.cumsum(~tied[live])
        items = order[live]
        value = words(k, items)
        by = np.lexsort((value, run))
        order[live], value = items[by], value[by]
        same = np.append(False, value[1:] == value[:-1]) & tied[live]
        tied[live] = same
        agree[live[same]] = k + 1
    return order, agree


def _shared(text: np.ndarray, begin: np.ndarray, size: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): items sorted by group and bytes; common bytes of each item with the one before, -1 across groups."""
    words = _words(text)
    last = len(words) - 1

    def word(k: int, items: np.ndarray) -> np.ndarray:
        left = size[items] - 8 * k
        value = words[np.minimum(begin[items] + 8 * k, last)]
        short = np.clip(8 - left, 0, 8).astype(np.uint64)
        cut = np.where(short < 8, value >> (np.minimum(short, 7) * 8) << (np.minimum(short, 7) * 8), 0)
        return cut.astype(np.uint64)

    order, agree = multikey_order(groups, word, -(-most // 8))
    common = np.where(agree < 0, -1, agree * 8)
    at = np.flatnonzero((agree >= 0) & (agree * 8 < most))
    mine, before = order[at], order[at - 1]
    differ = word_bytes = np.zeros(len(at), np.int64)
    for k in np.unique(agree[at]):
        some = agree[at] == k
        gap = word(int(k), mine[some]) ^ word(int(k), before[some])
        lead = np.zeros(some.sum(), np.int64)
        for byte in range(8):
            lead += (gap >> np.uint64(8 * (7 - byte)) == 0)
        word_bytes[some] = lead
    common[at] += differ
    ends = np.minimum(size[order], size[np.append(order[:1], order[:-1])])
    return order, np.where(common < 0, -1, np.minimum(common, ends))


def _runs(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Number of each item's run of neighbours that share ``least`` bytes."""
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(common < least)
    return run


def repeated_windows(gram: np.ndarray, contexts: list[bytes], before: np.ndarray, far: np.ndarray, near: np.ndarray, how: Repeats) -> np.ndarray:
    """(item, shift) flags: does the window that starts ``shift`` bytes before the anchor stand in another context too?

    Contexts of equal ``gram`` are compared; all of a gram must be there.
    Windows start ``near`` to ``far`` bytes before their anchor.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    back = np.frombuffer(b"".join(c[:b][::-1] for c, b in zip(contexts, before.tolist())) + bytes(8), np.uint8)
    back_offsets = np.concatenate([[0], np.cumsum(before)[:-1]])
    right, after = _shared(text, offsets + before, sizes - before, gram, how.length)
    left, ahead = _shared(back, back_offsets, before, gram, how.reach)
    flags = np.zeros((len(contexts), how.reach + 1), bool)
    for shift in range(how.reach + 1):
        items = np.flatnonzero((near <= shift) & (shift <= far))
        if len(items) < 2:
            continue
        both = _runs(right, after, how.length - shift)[items] * len(gram) + _runs(left, ahead, shift)[items]
        _, where, count = np.unique(both, return_inverse=True, return_counts=True)
        flags[items[count[where] > 1], shift] = True
    return flags


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, far, near) of packed anchors."""
    return at >> 16, at >> 8 & 255, at & 255


SPANS = "doc_id long, text_hash long, first long, last long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*KEY, "first", "last"])


def _in_buckets(contexts: DataFrame, how: Repeats, partitions: int) -> DataFrame:
    """(doc_id, text_hash, first, last): starts of windows that another context holds too, of anchors with few contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sorted_out(table: pa.Table) -> pa.RecordBatch:
            _, gram = np.unique(table["gram"].to_numpy(), return_inverse=True)
            place, far, near = _unpacked(table["at"].to_numpy())
            flags = repeated_windows(gram, table["bytes"].to_pylist(), table["before"].to_numpy(), far, near, how)
            single = table["single"].to_numpy(zero_copy_only=False)
            docs, keys = table["doc_id"].to_pylist(), table["text_hash"].to_pylist()
            return _spans([
                (docs[i], keys[i], int(place[i]) - b, int(place[i]) - a)
                for i in np.flatnonzero(single & flags.any(axis=1)) for a, b in _intervals(flags[i])
            ])

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.nbytes >= SORT_BYTES:
                grams = held["gram"].to_numpy()
                whole = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if grams[0] != grams[-1] else 0
                if whole:
                    yield sorted_out(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield sorted_out(held)

    dealt = contexts.repartitionByRange(partitions, "lead", "gram").sortWithinPartitions("lead", "gram")
    return dealt.mapInArrow(run, SPANS)


def _one_by_one(contexts: DataFrame, how: Repeats, partitions: int) -> DataFrame:
    """The same for anchors with many contexts: every window is dealt by its own leading bytes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in (b.slice(at, CONTEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, CONTEXTS_AT_ONCE)):
            table = pa.Table.from_batches([batch])
            place, far, near = _unpacked(table["at"].to_numpy())
            rows = zip(table["bytes"].to_pylist(), table["before"].to_pylist(), far.tolist(), near.tolist())
            cut = [[c[b - s : b - s + how.length] for s in range(n, f + 1)] for c, b, f, n in rows]
            counts = np.array([len(x) for x in cut])
            flat = [w for x in cut for w in x]
            lead = np.frombuffer(b"".join(w[:8] for w in flat), ">u8").astype(np.uint64)
            prints = np.frombuffer(b"".join(map(xxh3_128_digest, flat)), ">u8").astype(np.uint64).reshape(-1, 2)
            start = np.concatenate([p - np.arange(n, f + 1) for p, f, n in zip(place, far, near)])
            repeat = lambda name: table[name].take(pa.array(np.repeat(np.arange(len(counts)), counts))).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array((x ^ np.uint64(1 << 63)).view(np.int64)) for x in (lead, prints[:, 0], prints[:, 1])]
                + [repeat("doc_id"), repeat("text_hash"), pa.array(start), repeat("single")],
                names=["lead", "p", "q", *KEY, "start", "single"],
            )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first = True

        def judged(table: pa.Table, last: bool) -> pa.RecordBatch:
            words = [table[c].to_numpy() for c in ("lead", "p", "q")]
            same = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
            alike = np.append(same, False) | np.append(False, same)
            run = np.concatenate([[0], np.cumsum(~same)])
            edge = (run == run[0]) & first | (run == run[-1]) & last
            keep = alike | edge
            arrays = [table[c].combine_chunks().filter(pa.array(keep)) for c in table.column_names]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(alike[keep]), pa.array(edge[keep])], names=[*table.column_names, "alike", "edge"]
            )

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            words = [held[c].to_numpy() for c in ("lead", "p", "q")]
            change = np.flatnonzero(np.logical_or.reduce([w[1:] != w[:-1] for w in words]))
            if len(change) and held.num_rows >= 20_000:  # the last window waits for what follows
                cut = int(change[-1]) + 1
                yield judged(held.slice(0, cut), False)
                first, held = False, held.slice(cut)
        if held is not None and held.num_rows:
            yield judged(held, True)

    order = ["lead", "p", "q", *KEY, "start"]
    schema = "lead long, p long, q long, doc_id long, text_hash long, start long, single boolean"
    cut = contexts.select("bytes", "before", "at", *KEY, "single").mapInArrow(_gathered(windows), schema)
    dealt = cut.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    seen = durable(dealt.mapInArrow(neighbours, schema + ", alike boolean, edge boolean"), "windows")
    # across boundaries: a window that ends one bucket and begins the next; at most two different ones a bucket
    key = ["lead", "p", "q"]
    across = seen.filter("edge").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    lone = seen.filter("edge and not alike and single").join(across, key, "left_semi")
    found = seen.filter("alike and single").select(*KEY, "start").union(lone.select(*KEY, "start"))
    return found.select(*KEY, F.col("start").alias("first"), F.col("start").alias("last"))


def _cut_contexts(docs: DataFrame, wanted: DataFrame, how: Repeats) -> DataFrame:
    """Context bytes of the anchors in ``wanted`` (doc_id, text_hash, at, gram, single, hot), read from their texts."""
    per_doc = durable(
        wanted.groupBy(*KEY).agg(F.collect_list(F.struct("at", "gram", "single", "hot")).alias("items")), "wanted"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary(), pa.int64()]
        for batch in batches:
            rows = []
            for doc, key, text, items in zip(*batch.columns):
                if not len(items):
                    continue
                doc, key, text = doc.as_py(), key.as_py(), text.as_py().encode()
                for at, gram, single, hot in zip(*(f.to_pylist() for f in items.values.flatten())):
                    rows.append((doc, key, at, gram, single, hot, *_context(text, at >> 16, how)))
                if len(rows) >= CONTEXTS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=CONTEXT_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=CONTEXT_NAMES)

    texts = _keyed(docs).dropDuplicates(KEY) if _repeats_rows(docs, per_doc) else _keyed(docs)
    joined = join_by_row(texts, per_doc, 16, "items")
    cut = joined.select(*KEY, "text", "items").mapInArrow(run, CONTEXTS)
    lead = F.conv(F.hex(F.substring(F.expr("substring(bytes, before + 1, 7)"), 1, 7)), 16, 10).cast("long")
    return cut.withColumn("lead", lead)


CONTEXT_NAMES = [*KEY, "at", "gram", "single", "hot", "bytes", "before"]
CONTEXTS = "doc_id long, text_hash long, at long, gram long, single boolean, hot boolean, bytes binary, before long"


def _repeats_rows(docs: DataFrame, per_doc: DataFrame) -> bool:
    """Do rows of ``per_doc`` stand for several rows of ``docs``? Their texts are to be cut once."""
    keys = _keyed(docs).select(*KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return not keys.join(per_doc.select(*KEY), _same(keys, per_doc), "left_semi").isEmpty()


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def join_by_row(texts: DataFrame, per_doc: DataFrame, item_bytes: int, items: str, how: str = "inner") -> DataFrame:
    """``texts`` beside the list of its row; the lists are broadcast where their counted size allows it."""
    size = per_doc.agg(F.sum(F.lit(64) + item_bytes * F.size(items))).first()[0] or 0
    side = F.broadcast(per_doc) if size <= BROADCAST_BYTES else per_doc
    return texts.join(side, _same(texts, per_doc), how).select(*[texts[c] for c in texts.columns], per_doc[items])


def repeated_spans(docs: DataFrame, how: Repeats = Repeats(), hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, text_hash, spans) of every different (doc_id, text) with repeated bytes.

    ``spans`` are the maximal runs of bytes that repeated strings cover, as
    struct<start, end> in order, end exclusive. ``text_hash`` is the
    ``xxhash64`` of the text, '' for null. Null, empty and short texts have
    none. Repeated rows are copies like any others and share one row here.
    A null doc_id stays null. Extra columns are not carried. No rows give none.
    """
    spark = docs.sparkSession
    shared = _anchors(docs, how, grams_only=True).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = durable(shared.select("gram"), "grams")
    kept = durable(_anchors(docs, how).join(shared, "gram", "left_semi"), "anchors")
    classes = durable(
        kept.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "at")).alias("one")), "contexts"
    )
    mixed = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    wanted = classes.join(mixed, "gram").select(
        "one.*", "gram", (F.col("n") == 1).alias("single"), (F.col("m") > hot_contexts).alias("hot")
    )
    contexts = durable(_cut_contexts(docs, wanted, how), "cut")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() * (how.reach + how.length) // (4 * SORT_BYTES)))
    parts = [_in_buckets(contexts.filter("not hot"), how, partitions)]
    if not contexts.filter("hot").isEmpty():
        parts.append(_one_by_one(contexts.filter("hot"), how, partitions))
    place = F.shiftright("at", 16)
    twice = kept.join(classes.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    parts.append(twice.select(
        *KEY, (place - F.shiftright("at", 8).bitwiseAND(255)).alias("first"), (place - F.col("at").bitwiseAND(255)).alias("last")
    ))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    starts = found.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("starts"))
    return starts.mapInArrow(_merged(how.length), "doc_id long, text_hash long, spans array<struct<start:long,end:long>>")


def _merged(length: int):
    """Runs of window starts -> the bytes they cover, touching runs as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends, counts = [], [], [0]
            for starts in batch.column(2):
                first, last = (f.to_numpy() for f in starts.values.flatten())
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order] + length)
                fresh = np.append(True, first[1:] > reach[:-1])
                begins.append(first[fresh])
                ends.append(reach[np.append(fresh[1:], True)])
                counts.append(counts[-1] + int(fresh.sum()))
            both = pa.StructArray.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (begins, ends)], ["start", "end"])
            out = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=[*KEY, "spans"])

    return run


def without_repeats(docs: DataFrame, how: Repeats = Repeats(), hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: its repeated spans, and the bytes that remain, as binary.

    A cut may fall inside a character, so what remains is bytes. Cases as in
    ``repeated_spans``; every row of ``docs`` has its row here.
    """
    spans = durable(repeated_spans(docs, how, hot_contexts), "spans")
    joined = join_by_row(_keyed(docs), spans, 16, "spans", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for text, cut in zip(batch.column(1), batch.column(2)):
                text = text.as_py().encode()
                edges = [0, *(x for s in cut.as_py() or [] for x in (s["start"], s["end"])), len(text)]
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    rows = joined.select("doc_id", "text", F.coalesce("spans", empty).alias("spans"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
