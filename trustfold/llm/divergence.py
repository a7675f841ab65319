"""How the sources of a language differ in their words, by exact smoothed frequencies.

A language keeps the terms that stand in enough of its documents. A group, a
source of a language, gives every kept term the whole number
``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, and so does the language
itself. Two such numbers are ``floor((p - q)^2 / (p + q))`` apart.

Sources are compared in blocks of terms: a block is a small matrix of numbers
per source, whose pairs are summed in the task. Sources beyond one tile meet
tile by tile.

The terms that set a group apart are ranked through a dominance skyband. A term
with a higher count in its group, a lower one in the language and an earlier
name ranks before another for certain, so each partition keeps the terms that
fewer than k others dominate; the merged skybands hold the first k, and these
are ranked exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustfold.functions.positions import position
from trustfold.functions.sizing import broadcast_if_small
from trustfold.functions.storage import durable

SCALE, SMOOTHING = 1_000_000_000, 2
#: Terms of a matrix, and sources of one side of it.
BLOCK_TERMS, TILE_SOURCES = 4_096, 128
#: Terms that a worker counts before it hands them on.
HELD_TERMS = 300_000
#: Terms compared with the skyband at once.
SKYBAND_CHUNK = 512

#: Bytes outside terms as spaces, A-Z in lower case: in UTF-8 all bytes of other letters lie above 127.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Audit:
    """Documents a term must stand in, and ranks of the terms reported."""

    least_docs: int = 10
    ranks: int = 10


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term stands for the group itself.

    Null text, lang or source is ''. Every row is a document, repeated rows
    too; ids and extra columns aren't read. No rows give none.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, held, rows = defaultdict(Counter), defaultdict(Counter), Counter()

        def counted() -> pa.RecordBatch:
            out = [[], [], [], [], []]
            for (lang, source), words in said.items():
                for at, column in enumerate(([lang] * len(words), [source] * len(words), [w.decode() for w in words], words.values(), map(held[lang, source].__getitem__, words))):
                    out[at].extend(column)
            for (lang, source), n in rows.items():
                for at, value in enumerate((lang, source, None, 0, n)):
                    out[at].append(value)
            for kept in (said, held, rows):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().translate(_TERM_BYTES).split()
                said[lang, source].update(words)
                held[lang, source].update(set(words))
                rows[lang, source] += 1
                if len(said[lang, source]) >= HELD_TERMS:
                    yield counted()
            if sum(map(len, said.values())) >= HELD_TERMS:
                yield counted()
        if rows:
            yield counted()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _smoothed(count: str, total: str, kept: str) -> Column:
    """The whole number of a count among ``kept`` terms with ``total`` occurrences; decimals, so that no product overflows."""
    share = f"cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTHING} as decimal(20,0))"
    return F.expr(f"1L + {share} div cast(greatest({total} + {SMOOTHING} * {kept}, 1L) as decimal(20,0))")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


@dataclass(frozen=True)
class Kept:
    """Counts of kept terms: ``cells`` (lang, source, term, n, lang_n, t), ``groups`` (lang, source, idx, total, kept, lang_total)."""

    cells: DataFrame
    groups: DataFrame


def kept_counts(counts: DataFrame, how: Audit = Audit()) -> Kept:
    """Cells of the terms each language keeps, numbered from 0 in a language, and all groups with their totals."""
    in_lang = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = durable(position(in_lang.filter(F.col("docs") >= how.least_docs).drop("docs"), ["lang"], [F.col("term")], "t"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    cells = durable(counts.filter("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(broadcast_if_small(langs), "lang", "left")
    found = found.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))
    return Kept(cells, durable(position(found, ["lang"], [F.col("source")], "idx"), "groups"))


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Per pair of sources of two tiles: what a block of terms adds to the distance of two sources that lack them all."""
    marks = rows[rows["t"] < 0].drop_duplicates("idx").sort_values("idx")
    cells = rows[rows["t"] >= 0]
    sources, absent = marks["idx"].to_numpy(), marks["p"].to_numpy()
    _, column = np.unique(cells["t"].to_numpy(), return_inverse=True)
    n = int(column.max()) + 1 if len(column) else 0
    p = np.repeat(absent[:, None], n, axis=1)
    p[np.searchsorted(sources, cells["idx"].to_numpy()), column] = cells["p"].to_numpy()
    tile = sources // TILE_SOURCES
    i, j = rows["ti"].iloc[0], rows["tj"].iloc[0]
    out = []
    for a in np.flatnonzero(tile == i):
        others = np.flatnonzero((tile == j) & (sources > sources[a]))
        gap, both = p[others] - p[a], p[others] + p[a]
        lack = (absent[others] - absent[a]) ** 2 // (absent[others] + absent[a])
        out.append(pd.DataFrame({"a": sources[a], "b": sources[others], "more": (gap * gap // both).sum(axis=1) - n * lack}))
    found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "more": []})
    return found.astype("int64").assign(lang=rows["lang"].iloc[0])[["lang", "a", "b", "more"]]


def source_distances(known: Kept) -> DataFrame:
    """(lang, source, item, value): how far each source of a language lies from each other one, over all kept terms."""
    tiles = F.greatest(F.ceil(F.col("sources") / TILE_SOURCES), F.lit(1)).cast("long")
    blocks = F.greatest(F.expr(f"(kept + {BLOCK_TERMS - 1}L) div {BLOCK_TERMS}L"), F.lit(1).cast("long"))
    sizes = known.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = known.groups.join(broadcast_if_small(sizes), "lang").withColumn("tiles", tiles).withColumn("tile", F.expr(f"idx div {TILE_SOURCES}L"))
    groups = groups.withColumn("p0", _smoothed("0L", "total", "kept"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    narrow = groups.select("lang", "source", "idx", "tile", "tiles", "total", "kept")
    cells = known.cells.join(broadcast_if_small(narrow), ["lang", "source"]).select(
        "lang", F.expr(f"t div {BLOCK_TERMS}L").alias("block"), "tile", "idx", "t", _smoothed("n", "total", "kept").alias("p"), "tiles"
    )
    marks = groups.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "tile", "idx",
        F.lit(-1).cast("long").alias("t"), F.col("p0").alias("p"), "tiles",
    )
    dealt = cells.union(marks).select("*", other).select(
        "lang", "block", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "idx", "t", "p"
    )
    parts = dealt.groupBy("lang", "block", "ti", "tj").applyInPandas(_block_pairs, "lang string, a long, b long, more long")
    sums = durable(parts.groupBy("lang", "a", "b").agg(F.sum("more").alias("more")), "pairs")
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    one = broadcast_if_small(groups.select("lang", F.col("idx").alias("a"), "source", "kept", F.col("p0").alias("pa")))
    two = broadcast_if_small(groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb")))
    return both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select(
        "lang", "source", "item", (F.col("kept") * _apart("pa", "pb") + F.col("more")).alias("value")
    )


def skyband(count: np.ndarray, common: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Items dominated by fewer than ``k`` others with a count as high, ``common`` as low and a lesser name."""
    order = np.lexsort((name, common, -count))
    kept = order[:0]
    for at in range(0, len(order), SKYBAND_CHUNK):
        part = order[at : at + SKYBAND_CHUNK]
        above = ((common[kept][:, None] <= common[part]) & (name[kept][:, None] < name[part])).sum(axis=0)
        part, above = part[above < k], above[above < k]
        inside = np.triu((common[part][:, None] <= common[part]) & (name[part][:, None] < name[part]), 1).sum(axis=0)
        kept = np.concatenate([kept, part[above + inside < k]])
    return kept


def _skybands(k: int):
    """Rows sorted by group -> each group's skyband within the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def reduced(table: pa.Table) -> pa.Table:
            name = np.empty(table.num_rows, np.int64)
            name[pc.sort_indices(table["term"]).to_numpy()] = np.arange(table.num_rows)
            return table.take(pa.array(skyband(table["n"].to_numpy(), table["lang_n"].to_numpy(), name, k)))

        for batch in batches:
            part = pa.Table.from_batches([batch])
            group = list(zip(part["lang"].to_pylist(), part["source"].to_pylist()))
            cuts = [0, *(at for at in range(1, len(group)) if group[at] != group[at - 1]), len(group)]
            for begin, end in zip(cuts, cuts[1:]):
                piece = part.slice(begin, end - begin)
                if held is not None and all(held[c][0] == piece[c][0] for c in ("lang", "source")):
                    piece = pa.concat_tables([held, piece])
                elif held is not None:
                    yield from held.combine_chunks().to_batches()
                held = reduced(piece)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def telling_terms(known: Kept, how: Audit = Audit()) -> DataFrame:
    """(lang, source, item, value): the first ``ranks`` terms that a group has more of than its language, and ties beyond."""
    groups = known.groups.select("lang", "source", "total", "kept", "lang_total")
    cells = known.cells.join(broadcast_if_small(groups), ["lang", "source"])
    numbers = cells.select(
        "lang", "source", "term", "n", "lang_n", _smoothed("n", "total", "kept").alias("p"), _smoothed("lang_n", "lang_total", "kept").alias("q")
    ).filter("n > 0 and p > q")
    kept = numbers.sortWithinPartitions("lang", "source").mapInArrow(_skybands(how.ranks), numbers.schema)
    return kept.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))


def source_audit(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of a language, and the terms that tell a source apart.

    Part ``pair`` ranks all other sources by distance, part ``term`` the first
    ``ranks`` terms that are more frequent in the group than in its language;
    ties go to the lesser name by UTF-8. A language that keeps no term has
    pairs of value 0 and no terms, a language of one source no pairs. Null
    text, lang and source are ''; no rows give none.
    """
    known = kept_counts(durable(term_counts(docs), "term-counts"), how)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank")
    )
    return ranked(source_distances(known), "pair").union(ranked(telling_terms(known, how), "term").filter(F.col("rank") <= how.ranks))
