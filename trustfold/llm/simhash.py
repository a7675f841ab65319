"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in three bits at most, the two segments with the fewest
errors have (0, 0), (0, 1), (1, 0) or, when each segment has one, (1, 1)
errors. A segment without error is compared as it is; one with at most one
error by its Golay keys (see ``golay``): one side gives the key of its
nearest codeword, the other the up to six keys of its one-bit changes. Rows
that share the combined key of two segments are joined and verified by their
bit distance. Only distinct fingerprints are joined, so copies cost nothing,
and keys that many fingerprints share are compared in blocks which hand on a
spanning forest instead of all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable
from trustfold.llm import golay
from trustfold.llm.components import connected

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints with one key beyond which it is compared in blocks of BLOCK fingerprints.
HOT_KEY = 256
BLOCK = 4096
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 1 << 16


def text_fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles, A-Z in lower case; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[at:] for at in range(width)))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the signed 64-bit fingerprint of every row's whole text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(text.as_py(), width) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"]
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _pairs(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the fuzzy keys (probe) or the plain keys of fingerprints."""
    words = fp.view(np.uint64)
    raw = [(words >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    if probe:
        fuzzy = [golay.fuzzy_keys(r, bits) for r, (_, bits) in zip(raw, SEGMENTS)]
    else:
        fuzzy = [golay.key(r)[:, None] for r in raw]
    rows, keys = [], []

    def add(family: int, left: np.ndarray, right: np.ndarray) -> None:
        both = (left[:, :, None] << 23 | right[:, None, :]).reshape(len(fp), -1)
        used = ((left >= 0)[:, :, None] & (right >= 0)[:, None, :]).reshape(len(fp), -1)
        row, at = np.nonzero(used)
        rows.append(row)
        keys.append(both[row, at] | family << 48)

    for number, (i, j) in enumerate(combinations(range(3), 2)):
        add(2 * number, raw[i][:, None], fuzzy[j])
        add(2 * number + 1, raw[j][:, None], fuzzy[i])
    add(6, fuzzy[0], fuzzy[1])  # one error in each segment
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                row, key = _pairs(fp, probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links between fingerprints at ``most`` bits or fewer that connect what all such links connect."""
    nodes = np.unique(np.concatenate([left, right]))
    above = np.arange(len(nodes))
    where, among = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    links = []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for x, value in zip(where, left):
        near = among[np.bitwise_count((right ^ value).view(np.uint64)) <= most]
        for y in near:
            p, q = top(x), top(int(y))
            if p != q:
                above[max(p, q)] = min(p, q)
                links.append((int(nodes[x]), int(nodes[y])))
    return links


def _hot_links(probes: DataFrame, index: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """Links within keys of many fingerprints: every pair of blocks in a task of its own."""
    rows = probes.select("key", "fp").union(index.select("key", "fp")).join(hot, "key").distinct()
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("own", block).withColumn("other", other).select(
        "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part["own"].to_numpy()
        fp = part["fp"].to_numpy()
        left, right = fp[own == part["i"].iloc[0]], fp[own == part["j"].iloc[0]]
        return pd.DataFrame(_forest(left, right, most), columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def links(prints: DataFrame, most: int = MAX_BITS, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all those at ``most`` bits or fewer.

    Keys with up to ``hot_key`` fingerprints give every such pair, larger ones
    a spanning forest of them. ``most`` may not exceed what the segments cover.
    """
    if not 0 <= most <= MAX_BITS:
        raise ValueError(f"the segments cover distances of 0 to {MAX_BITS} bits")
    distinct = durable(prints.filter("fp is not null").select("fp").distinct(), "fingerprints")
    probes, index = _keyed(distinct, True), _keyed(distinct, False)
    hot = durable(
        index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_key)
        .select("key", F.ceil(F.col("n") / block).alias("blocks")),
        "hot-keys",
    )
    left, right = probes.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    any_hot = not hot.isEmpty()
    if any_hot:
        right = right.join(broadcast_if_small(hot), "key", "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    found = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    return found.union(_hot_links(probes, index, hot, most)) if any_hot else found


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    ``root`` is the smallest fingerprint of the component, ``component_id`` the smallest doc_id reached over links of ``most`` bits or fewer. Null and empty texts have fingerprint 0,
    linked like any other; a null doc_id never names a component unless all
    its ids are null; repeated rows share a component; extra columns are not
    carried; no rows give none.
    """
    prints = durable(fingerprints(docs, width), "prints")
    roots = connected(links(prints, most))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = least.join(broadcast_if_small(durable(roots, "roots")), F.col("fp") == F.col("node"), "left")
    named = durable(joined.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "classes")
    names = named.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    alone = named.filter("not linked").select("fp", "root", F.col("least").alias("component_id"))
    classes = named.filter("linked").select("fp", "root").join(names, "root").select("fp", "root", "component_id").union(alone)
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (nulls last), then the smallest text hash.

    Rows that repeat both id and text count once. All columns are kept.
    """
    found = durable(near_duplicates(docs, width, most), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    keys = found.groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("copies"))
    best = keys.groupBy("root").agg(F.min(rank).alias("best"))
    loses = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    verdicts = keys.join(best, "root").select(F.col("doc_id").alias("other"), F.col("text_hash").alias("hash"), loses.alias("dropped"), "copies")
    verdicts = durable(verdicts.filter("dropped or copies > 1").drop("copies"), "verdicts")
    # the row travels as one struct, so that no name of it can meet a name of these
    mine = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("key")
    )
    judged = mine.join(broadcast_if_small(verdicts), F.col("id").eqNullSafe(F.col("other")) & (F.col("key") == F.col("hash")), "left")
    kept = judged.filter("dropped is null").select("row.*")
    if verdicts.filter("not dropped").isEmpty():
        return kept
    return kept.union(judged.filter("not dropped").dropDuplicates(["id", "key"]).select("row.*"))
