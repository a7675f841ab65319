"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates come from regular expressions, evaluated inside the row. Regex,
gazetteer and context labelers each vote yes, no or abstain on a candidate.
How often they are right is estimated from their agreement alone, over counts
of vote patterns of the whole corpus; a logistic classifier is then fitted to
the resulting probabilities and decides on the candidates. Spans of the base
kinds are exact by definition and stay whatever the classifier says.

Everything is DataFrame expressions; the model is a row of doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.storage import durable
from trustfold.llm.columns import between, bound, count_below, pieces_of, running, text_key, whole

#: Possessive forms of the base patterns; a match may only begin where no earlier one in the same run could.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: What a text must hold for a kind to be looked for; cheaper than the pattern, never stricter.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?+[0-9]){12}"),
}
#: Regex labeler: the usual form of a kind.
USUAL = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+[1-9]",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[a-z]_?[A-Za-z0-9]{30,}|sk[A-Za-z0-9]{20,})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
#: Gazetteer labeler: words close before a span that speak for a kind, and words that speak against all.
CUES = {
    "email": ["mail", "email", "e-mail", "contact", "write", "address"],
    "ip": ["ip", "host", "server", "address", "from", "ping"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "pay", "paid"],
    "phone": ["phone", "tel", "telephone", "call", "fax", "mobile", "cell"],
    "secret": ["token", "password", "passwd", "secret", "key", "apikey", "api_key", "bearer", "auth", "pwd"],
    "national_id": ["ssn", "social", "security", "id", "insurance"],
}
AGAINST = ["version", "isbn", "issn", "doi", "page", "figure", "section", "sha", "md5", "commit", "checksum", "uuid", "build"]
CONTEXT_CHARS = 40
LABELERS = 4
EM_ROUNDS, FIT_ROUNDS, RATE = 30, 200, 2.0

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _matches(text: Column, kind: str) -> Column:
    """Spans of all matches of a kind; code points, 0-based, end exclusive.

    The gaps between matches and the matches alternate, so their lengths add
    up to the places.
    """
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.length(g) + F.length(v))
        ends = running(steps, lambda a, b: a + b, "int")
        return F.zip_with(found, ends, lambda v, end: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")
        ))

    needed = NEEDS.get(kind, lambda t: t.rlike(pattern))(text)
    found = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(_none(SPAN)))
    return F.when(needed, found).otherwise(_none(SPAN))


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """What a match of a kind must fulfil; failing matches are dropped, and not tried again shorter."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column) -> tuple[Column, Column]:
    """(base spans, other candidates) of a text; candidates that overlap a base span are left out."""
    kinds = {k: _filtered(text, k) for k in KINDS}
    return F.concat(*(kinds[k] for k in BASE)), F.concat(*(kinds[k] for k in KINDS if k not in BASE))


def _filtered(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, kind), lambda s: _valid(kind, s["value"]))


def _votes(pieces: Column, span: Column) -> Column:
    """Votes of the labelers as a string of 1 (yes), 0 (no) and 2 (abstains), on a span of a text in pieces."""
    by_kind = lambda of: reduce(lambda c, k: c.when(span["kind"] == k, of(k)), KINDS[1:], F.when(span["kind"] == KINDS[0], of(KINDS[0])))
    said = lambda yes, no: F.when(yes, "1").when(no, "0").otherwise("2")
    left = between(pieces, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["start"])
    before = F.split(F.lower(left), r"[^a-z0-9_-]+")
    usual = by_kind(lambda k: span["value"].rlike(USUAL[k]))
    cue = by_kind(lambda k: F.arrays_overlap(before, F.array(*map(F.lit, CUES[k]))))
    against = F.arrays_overlap(before, F.array(*map(F.lit, AGAINST)))
    edge = F.concat(between(pieces, F.greatest(span["start"] - 1, F.lit(0)), span["start"]), between(pieces, span["end"], span["end"] + 1))
    glued = edge.rlike(r"[\p{L}\p{N}_/\\]")
    signs = F.size(F.array_distinct(F.split(F.regexp_replace(F.lower(span["value"]), "[^a-z0-9]", ""), "")))
    varied = signs >= 5
    return F.concat(
        said(usual, ~usual),  # regex labeler
        said(cue & ~against, against),  # gazetteer labeler
        said(~glued, glued),  # context labeler: what touches the span
        said(varied, signs <= 3),  # context labeler: filler such as 0000
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a whole text, with their votes."""
    def voted(pieces: Column, span: Column, base: bool) -> Column:
        return F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(base).alias("base"),
            _votes(pieces, span).alias("votes"), (F.length(span["value"]) >= 24).alias("longer"),
        )

    def apart(base: Column, added: Column) -> Column:
        """Added spans that overlap no base span: the base spans that begin before a span's end must end by its start."""
        def kept(ordered: Column) -> Column:
            reach = running(F.transform(ordered, lambda b: b["end"]), lambda x, y: F.greatest(x, y), "int")
            return bound(F.transform(ordered, lambda b: b["start"]), lambda starts: bound(reach, lambda ends: F.filter(
                added, lambda s: bound(count_below(starts, s["end"]), lambda n: (n == 0) | (F.get(ends, F.greatest(n, F.lit(1)) - 1) <= s["start"])),
            )))

        ordered = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
        return F.when((F.size(base) == 0) | (F.size(added) == 0), added).otherwise(bound(ordered, kept))

    def all_of(t: Column) -> Column:
        base, added = _spans(t)

        def both(b: Column, other: Column) -> Column:
            some = F.size(b) + F.size(other) > 0
            pieces = F.when(some, pieces_of(t)).otherwise(_none("string"))
            return bound(pieces, lambda p: F.concat(
                F.transform(b, lambda s: voted(p, s, True)), F.transform(other, lambda s: voted(p, s, False)),
            ))

        return bound(base, lambda b: bound(added, lambda a: bound(apart(b, a), lambda other: both(b, other))))

    return bound(whole(text), all_of)


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda t, r: t + value(r))


def _sum_of(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _reliabilities(patterns: Column) -> Column:
    """struct<prior, yes, no>: share of true candidates, and each labeler's chance of a yes on true and on false ones.

    ``patterns`` is array<struct<votes, n>>, at most 3^LABELERS of them.
    """
    def posterior(model: Column, votes: Column) -> Column:
        def log_odds(j: int) -> Column:
            vote = F.substr(votes, F.lit(j + 1), F.lit(1))
            yes, no = F.get(model["yes"], F.lit(j)), F.get(model["no"], F.lit(j))
            return F.when(vote == "1", F.log(yes / no)).when(vote == "0", F.log((1 - yes) / (1 - no))).otherwise(0.0)

        total = F.log(model["prior"] / (1 - model["prior"])) + _sum_of(log_odds(j) for j in range(LABELERS))
        return 1 / (1 + F.exp(-total))

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(model, p["votes"]).alias("q")))

        def maximised(w: Column) -> Column:
            def share(j: int, true: bool) -> Column:
                part = lambda r: r["n"] * (r["q"] if true else 1 - r["q"])
                vote = lambda r: F.substr(r["votes"], F.lit(j + 1), F.lit(1))
                # four pseudo-votes that call a labeler 3/4 right keep the classes from changing places
                yes = _total(w, lambda r: F.when(vote(r) == "1", part(r)).otherwise(0.0)) + (3.0 if true else 1.0)
                return yes / (_total(w, lambda r: F.when(vote(r) != "2", part(r)).otherwise(0.0)) + 4.0)

            return F.struct(
                ((_total(w, lambda r: r["n"] * r["q"]) + 1) / (_total(w, lambda r: r["n"]) + 2)).alias("prior"),
                F.array(*(share(j, True) for j in range(LABELERS))).alias("yes"),
                F.array(*(share(j, False) for j in range(LABELERS))).alias("no"),
            )

        return bound(weighed, maximised)

    start = F.struct(
        F.lit(0.5).alias("prior"), F.array(*(F.lit(0.8) for _ in range(LABELERS))).alias("yes"),
        F.array(*(F.lit(0.2) for _ in range(LABELERS))).alias("no"),
    )
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step)
    return bound(fitted, lambda m: F.struct(
        m["prior"].alias("prior"), m["yes"].alias("yes"), m["no"].alias("no"),
        F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), posterior(m, p["votes"]).alias("q"))).alias("posteriors"),
    ))


def _features(kind: Column, votes: Column, longer: Column) -> Column:
    """Constant, kind, each labeler's yes and no, and length: what the classifier sees of a span."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    vote = lambda j: F.substr(votes, F.lit(j + 1), F.lit(1))
    return F.array(
        F.lit(1.0), *(flag(kind == k) for k in KINDS),
        *(flag(vote(j) == v) for j in range(LABELERS) for v in ("1", "0")), flag(longer),
    )


N_FEATURES = 1 + len(KINDS) + 2 * LABELERS + 1


def _dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda w, v: w * v), F.lit(0.0), lambda t, v: t + v)


def _classifier(rows: Column) -> Column:
    """Weights of the logistic classifier over array<struct<x, n, q>>, by gradient steps on the mean loss."""
    def step(weights: Column, _: Column) -> Column:
        errors = F.transform(rows, lambda r: F.struct(
            r["x"].alias("x"), (r["n"] * (r["q"] - 1 / (1 + F.exp(-_dot(weights, r["x"]))))).alias("e"),
        ))
        size = F.greatest(_total(rows, lambda r: r["n"]), F.lit(1.0))
        return bound(errors, lambda es: F.transform(
            weights, lambda w, k: w + RATE * (_total(es, lambda r: r["e"] * F.get(r["x"], k)) / size - 1e-4 * w),
        ))

    zero = F.array(*(F.lit(0.0) for _ in range(N_FEATURES)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), zero, step)


def fit(found: DataFrame) -> tuple[list[float], dict[str, list[float]]]:
    """(classifier weights, reliabilities) from rows that hold ``candidates``.

    What is gathered are counts per kind, votes and length, a number of groups
    that does not depend on the corpus. Without candidates all weights are 0.
    """
    spans = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.longer")
    groups = durable(spans.groupBy("kind", "votes", "longer").agg(F.count(F.lit(1)).cast("double").alias("n")), "votes")
    patterns = groups.groupBy("votes").agg(F.sum("n").alias("n"))
    # sorted, so that sums of doubles do not depend on the order of arrival
    gathered = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    model = gathered.select(_reliabilities(F.col("p")).alias("m")).select("m.*")
    labelled = groups.join(F.broadcast(model.select(F.explode("posteriors").alias("q")).select("q.*")), "votes")
    rows = labelled.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "longer", "n", "q"))).alias("rows"))
    shaped = rows.select(F.transform("rows", lambda r: F.struct(
        _features(r["kind"], r["votes"], r["longer"]).alias("x"), r["n"].alias("n"), r["q"].alias("q"))).alias("rows"))
    weights = durable(shaped.select(_classifier(F.col("rows")).alias("weights")), "classifier").first()["weights"]
    learnt = model.select("prior", "yes", "no").first()
    return list(weights), {"prior": [learnt["prior"]], "yes": list(learnt["yes"]), "no": list(learnt["no"])}


def accepted(found: Column, weights: list[float]) -> Column:
    """Base spans and the candidates that the classifier takes, by kind as listed, then by place."""
    w = F.array(*map(F.lit, weights))
    kept = F.filter(found, lambda c: c["base"] | (_dot(w, _features(c["kind"], c["votes"], c["longer"])) > 0))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(kept, lambda c: F.struct(
        F.array_position(order, c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"),
    ))
    return F.array_sort(ranked)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans) of every row; ``spans`` holds rank, start, end, kind and base, in that order sorted.

    Null and empty texts have no spans. Repeated rows get a row each, null ids
    stay null, extra columns are not carried, and no rows give none.
    """
    found = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), candidates(F.col("text")).alias("candidates")),
        "candidates",
    )
    weights, _ = fit(found)
    return found.select("doc_id", "text_key", accepted(F.col("candidates"), weights).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, replaced by the name of its first in brackets."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(pieces: Column, placed: Column, reach: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(reach, F.greatest(k, F.lit(1)) - 1))
        parts = F.transform(placed, lambda s, k: F.when(
            s["start"] >= before(k), F.concat(between(pieces, before(k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        ).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(reach, -1), F.length(text)))

    return bound(pieces_of(text), lambda pieces: bound(by_place, lambda placed: bound(
        running(F.transform(placed, lambda s: s["end"]), lambda x, y: F.greatest(x, y), "int"), lambda reach: cut(pieces, placed, reach)
    )))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, where there is one, follows the new text.

    Overlapping spans become one replacement, named by the first. Rows without
    spans, null and empty texts stay as they are; repeated rows and all columns
    are kept; no rows give none. The rows are written once beside their
    candidates, which the classifier is fitted to, so no text is shuffled.
    """
    seen = durable(docs.select(F.struct(*docs.columns).alias("row"), candidates(F.col("text")).alias("candidates")), "candidates")
    weights, _ = fit(seen)
    marked = seen.select("row", accepted(F.col("candidates"), weights).alias("spans"))
    some = F.size("spans") > 0
    clean = F.when(some, _redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = marked.select("row", "spans", clean.alias("clean"))
    follows = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        follows["n_chars"] = F.when(some, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return changed.select(*(follows.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
