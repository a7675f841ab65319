"""Column helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole(text: Column) -> Column:
    """The text, '' for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def hashes(found: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(found, lambda w: F.xxhash64(w))


def loose_hashes(found: Column) -> Column:
    """64-bit hash of each word in lower case; words that agree but for A-Z share it, and so do a few others.

    Much cheaper than ``lower_ascii``, for finding what is then verified.
    """
    return F.transform(found, lambda w: F.xxhash64(F.lower(w)))


def window_hashes(hashed: Column, size: int) -> Column:
    """Hash of each run of ``size`` neighbouring word hashes; none where there are fewer."""
    starts = F.when(F.size(hashed) >= size, F.sequence(F.lit(0), F.size(hashed) - size)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda at: F.xxhash64(*(F.get(hashed, at + k) for k in range(size))))


def run_hashes(hashed: Column, size: int) -> Column:
    """Hash of each run of ``size`` neighbouring word hashes, put together from runs of 1, 2, 4, ... words.

    Long runs cost a few steps per word so. ``hashed`` should be a bound
    variable. Other values than those of ``window_hashes``, found the same way.
    """
    def joined(parts: dict[int, Column]) -> Column:
        widths = [w for w in sorted(parts, reverse=True) if size & w]
        places = [sum(widths[:k]) for k in range(len(widths))]
        first = parts[widths[0]]
        whole_runs = F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(parts[w], i + at) for w, at in zip(widths[1:], places[1:]))))
        return F.slice(whole_runs, 1, F.greatest(F.size(hashed) - size + 1, F.lit(0)))

    def grown(parts: dict[int, Column], width: int) -> Column:
        if 2 * width > size:
            return joined(parts)
        half = parts[width]
        double = F.transform(half, lambda x, i: F.xxhash64(x, F.get(half, i + width)))
        return bound(double, lambda d: grown({**parts, 2 * width: d}, 2 * width))

    return grown({1: hashed}, 1)


def text_key(text: Column) -> Column:
    """Hash of a whole text, which with its id names a row; rows that share both are repeats."""
    return F.xxhash64(text.cast("string"))


#: Elements of an array that one running fold copies at each step, and code points of a piece of text.
RUN_ELEMENTS, PIECE_CHARS = 128, 1024


def running(values: Column, fold: Callable[[Column, Column], Column], kind: str = "bigint") -> Column:
    """Fold of each prefix of an array by an associative ``fold``; runs of elements first, then the runs' results.

    A plain fold that appends copies its list at every step; here a step copies
    RUN_ELEMENTS at most, or one element for each run.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def prefixes(items: Column) -> Column:
        def step(out: Column, item: Column) -> Column:
            return F.array_append(out, F.when(F.size(out) == 0, item).otherwise(fold(F.get(out, F.size(out) - 1), item)).cast(kind))
        return F.aggregate(items, none, step)

    def joined(runs: Column) -> Column:
        totals = prefixes(F.transform(runs, lambda r: F.element_at(r, -1)))
        return bound(totals, lambda t: F.flatten(F.transform(runs, lambda r, k: F.when(k == 0, r).otherwise(
            F.transform(r, lambda x: fold(F.get(t, k - 1), x).cast(kind))))))

    def cut(items: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(items), F.lit(RUN_ELEMENTS))
        return bound(F.transform(firsts, lambda at: prefixes(F.slice(items, at, RUN_ELEMENTS))), joined)

    return bound(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(none))


def count_below(borders: Column, value: Column) -> Column:
    """How many of the ascending ``borders`` lie below ``value``, by halving; ``borders`` should be a bound variable."""
    def halve(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= F.size(borders)) & (F.get(borders, F.least(to, F.size(borders)) - 1) < value), to).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << b) for b in range(29, -1, -1))), F.lit(0), halve)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE_CHARS code points, from which ``between`` cuts without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))


def between(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` (from 0) to ``end`` (exclusive) of a text in pieces; '' where there are none."""
    first = F.floor(begin / PIECE_CHARS).cast("int")
    count = F.floor((end - 1) / PIECE_CHARS).cast("int") - first + 1
    held = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > begin, F.substr(held, (begin % PIECE_CHARS + 1).cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))
