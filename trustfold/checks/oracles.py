"""DuckDB SQL for the named queries, put together from shared CTEs."""

from __future__ import annotations

from trustfold.checks.tables import line_id

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def _with(sql: str, *needs: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTE[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    # a CTE that reads itself makes the whole list recursive
    recursive = recursive or any(f"FROM {n} " in CTE[n][1] + " " or f"JOIN {n} " in CTE[n][1] + " " for n in ordered)
    body = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{sql}" if ordered else sql


def _u(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _normal(key: str) -> str:
    a, b = _u(f"{key} || '|a'"), _u(f"{key} || '|b'")
    return f"(sqrt(-2.0::DOUBLE * ln({a} + 1e-12::DOUBLE)) * cos(2.0::DOUBLE * pi() * {b}))"


def _r(value: str, digits: int) -> str:
    return f"(CAST(floor(({value}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) AS BIGINT) / 1e{digits}::DOUBLE)"


def _ordinary(r: str, d: str, t: str, ok: str) -> str:
    moved = f"(CASE WHEN {d} <= {t} THEN {r} + 0.1::DOUBLE ELSE {r} * 0.01::DOUBLE END)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {moved} * (CASE WHEN {ok} THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END)))"


def _step(r: str, d: str, t: str, ok: str, rehab: str) -> str:
    t = f"{t}::DOUBLE"
    fixed = f"least(0.1::DOUBLE, 0.02::DOUBLE + 0.03::DOUBLE / (1.0::DOUBLE + greatest(0.0::DOUBLE, {d} - {t})))"
    return (
        f"(CASE WHEN {rehab} AND {r} <= 0.01::DOUBLE AND {d} <= {t} * 1.5::DOUBLE THEN {fixed} "
        f"ELSE {_ordinary(r, d, t, ok)} END)"
    )


def _shards(rows: str, out: str, shards: int = 40) -> None:
    _cte(
        out,
        f"SELECT row_id, features, label, CAST(CASE WHEN rn < (n % {shards}) * (n // {shards} + 1) "
        f"THEN rn // (n // {shards} + 1) "
        f"ELSE (n % {shards}) + (rn - (n % {shards}) * (n // {shards} + 1)) // (n // {shards}) END AS BIGINT) AS shard "
        f"FROM (SELECT *, row_number() OVER (ORDER BY label, row_id) - 1 AS rn, count(*) OVER () AS n FROM {rows})",
        rows,
    )


def _deals(rows: str, sharded: str, dealt: str) -> None:
    _shards(rows, sharded)
    _cte(
        dealt,
        "SELECT s.*, o.client_id, CAST(row_number() OVER (PARTITION BY o.client_id "
        "ORDER BY md5('42|order|' || row_id), row_id) - 1 AS BIGINT) AS ord "
        f"FROM {sharded} s JOIN owners o ON s.shard = o.shard",
        sharded, "owners",
    )


def _subset(dealt: str, out: str, rows: int) -> None:
    _cte(
        out,
        "SELECT * FROM (SELECT client_id, row_id, features, label, CAST(row_number() OVER (PARTITION BY client_id "
        f"ORDER BY md5('0|subset|' || row_id), row_id) - 1 AS BIGINT) AS pos FROM {dealt}) WHERE pos < {rows}",
        dealt,
    )


def _trains(out: str, rows: str, start: str, key: str, classes: int, features: int, lr: float, own: bool = False) -> None:
    """One full-batch softmax step per ``key`` from model ``start`` (per client when ``own``)."""
    match = f" AND m.{key} = x.{key}" if own else ""
    _cte(
        out + "_x",
        f"SELECT {key}, row_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS j FROM {rows}",
        rows,
    )
    _cte(
        out + "_z",
        f"SELECT x.{key}, x.row_id, x.label, m.idx // {features} AS k, sum(m.value * x.v) + max(b.value) AS z "
        f"FROM {out}_x x JOIN {start} m ON m.layer = 'weight' AND m.idx % {features} = x.j{match} "
        f"JOIN {start} b ON b.layer = 'bias' AND b.idx = m.idx // {features}{match.replace('m.', 'b.')} "
        f"GROUP BY 1, 2, 3, 4",
        out + "_x", start,
    )
    _cte(
        out + "_e",
        f"SELECT {key}, row_id, k, exp(z - max(z) OVER w) / sum(exp(z - top)) OVER w "
        "- CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e "
        f"FROM (SELECT *, max(z) OVER (PARTITION BY {key}, row_id) AS top FROM {out}_z) "
        f"WINDOW w AS (PARTITION BY {key}, row_id)",
        out + "_z",
    )
    _cte(
        out + "_g",
        f"SELECT e.{key}, 'weight' AS layer, CAST(e.k * {features} + x.j AS BIGINT) AS idx, avg(e.e * x.v) AS g "
        f"FROM {out}_e e JOIN {out}_x x ON e.{key} = x.{key} AND e.row_id = x.row_id GROUP BY 1, 2, 3 "
        f"UNION ALL SELECT {key}, 'bias', CAST(k AS BIGINT), avg(e) FROM {out}_e GROUP BY 1, 2, 3",
        out + "_e", out + "_x",
    )
    own_match = f" AND m.{key} = g.{key}" if own else ""
    _cte(
        out,
        f"SELECT g.{key}, g.layer, g.idx, m.value - {lr}::DOUBLE * g.g AS value FROM {out}_g g "
        f"JOIN {start} m ON m.layer = g.layer AND m.idx = g.idx{own_match}",
        out + "_g", start,
    )


def _grid(classes: int, features: int) -> str:
    return (
        f"SELECT CASE WHEN i < {classes} THEN 'bias' ELSE 'weight' END AS layer, "
        f"CAST(CASE WHEN i < {classes} THEN i ELSE i - {classes} END AS BIGINT) AS idx "
        f"FROM range({classes * (features + 1)}) t(i)"
    )


# --- base tables ---

_cte("embedded", "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings")
_SPLIT = _u("'0|split|' || row_id")
_cte("parted", f"SELECT *, {_SPLIT} AS draw FROM embedded", "embedded")
_cte("train", "SELECT row_id, features, label FROM parted WHERE draw >= 0.2", "parted")
_cte("test", "SELECT row_id, features, label FROM parted WHERE draw < 0.2", "parted")
_cte(
    "lines",
    "SELECT " + line_id("date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))") + " AS row_id, "
    "[l_quantity / 50.0::DOUBLE, l_extendedprice / 100000.0::DOUBLE, l_discount * 10.0::DOUBLE, l_tax * 10.0::DOUBLE] AS features, "
    "CAST((instr('ANR', l_returnflag) - 1) * 2 + instr('FO', l_linestatus) - 1 AS INTEGER) AS label FROM lineitem",
)
_cte(
    "owners",
    "SELECT shard, CAST((row_number() OVER (ORDER BY md5('42|' || shard), shard) - 1) // 4 AS BIGINT) AS client_id "
    "FROM range(40) t(shard)",
)
_deals("train", "sharded", "dealt")
_deals("lines", "line_shards", "line_deal")
_shards("embedded", "embedded_shards")
_subset("dealt", "subset", 20)
_subset("line_deal", "line_subset", 512)
_subset("line_deal", "line_subset_large", 2000)
_cte("roster", "SELECT i AS client_id FROM range(10) t(i)")
# equal scores and no history: rank is the id, offset 1
_cte("pairs", "SELECT client_id AS verifier, (client_id + 1) % 10 AS prover FROM roster", "roster")
_cte(
    "delivered",
    "SELECT p.verifier, p.prover, s.pos, s.row_id, s.features, s.label FROM subset s JOIN pairs p ON s.client_id = p.prover",
    "subset", "pairs",
)
_cte(
    "observed",
    "SELECT user_id AS client_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS round, "
    "value AS dist, event_type <> 'error' AS secure FROM events",
)
_cte(
    "traced",
    f"SELECT client_id, round, {_step('0.5::DOUBLE', 'dist', '100', 'secure', 'false')} AS score FROM observed WHERE round = 1 "
    f"UNION ALL SELECT o.client_id, o.round, {_step('t.score', 'o.dist', '100', 'o.secure', '((o.round - 1) % 10 = 0 AND o.round > 1)')} "
    "FROM traced t JOIN observed o ON o.client_id = t.client_id AND o.round = t.round + 1",
    "observed",
)
_TYPES = "['click', 'error', 'purchase', 'signup', 'view']"
_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT)"
_cte(
    "run_cells",
    f"SELECT CAST(list_position({_TYPES}, event_type) - 1 AS BIGINT) AS run, user_id % 10 AS client_id, {_DAY} AS round, "
    f"{_r('avg(value)', 6)} AS dist, max(value) < 300.0 AS secure FROM events GROUP BY 1, 2, 3",
)
_cte(
    "run_steps",
    "SELECT *, row_number() OVER (PARTITION BY run, client_id ORDER BY round) AS seq FROM run_cells",
    "run_cells",
)
_REHAB = "((o.round - 1) % 10 = 0 AND o.round > 1)"
_cte(
    "run_trace",
    f"SELECT run, client_id, round, seq, {_step('0.5::DOUBLE', 'dist', '50', 'secure', '((round - 1) % 10 = 0 AND round > 1)')} AS score "
    "FROM run_steps WHERE seq = 1 "
    f"UNION ALL SELECT o.run, o.client_id, o.round, o.seq, {_step('t.score', 'o.dist', '50', 'o.secure', _REHAB)} "
    "FROM run_trace t JOIN run_steps o ON o.run = t.run AND o.client_id = t.client_id AND o.seq = t.seq + 1",
    "run_steps",
)
_cte("history", "SELECT 'run' || run AS run_id, round, client_id, score FROM run_trace", "run_trace")
_cte(
    "run_accuracy",
    f"SELECT 'run' || (list_position({_TYPES}, event_type) - 1) AS run_id, {_DAY} AS round, "
    f"{_r('avg(CASE WHEN value <= 50.0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS accuracy FROM events GROUP BY 1, 2",
)
_cte(
    "best_log",
    "SELECT run_id, round, accuracy, coalesce(max(accuracy) OVER w, 0.0::DOUBLE) AS before FROM run_accuracy "
    "WINDOW w AS (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "run_accuracy",
)
_cte(
    "supplier_score",
    "SELECT client_id, CASE WHEN d < 0.3 THEN d * 0.03::DOUBLE ELSE d END AS score FROM "
    f"(SELECT s_suppkey AS client_id, {_u(chr(39) + 'score|' + chr(39) + ' || s_suppkey')} AS d FROM supplier)",
)


def _updates(name: str, where: str) -> None:
    _cte(
        name,
        "SELECT client_id, layer, CAST(p - 1 AS BIGINT) AS idx, m[p] AS value FROM ("
        "SELECT l_suppkey AS client_id, l_returnflag || l_linestatus AS layer, "
        "[avg(l_quantity), avg(l_extendedprice), avg(l_discount), avg(l_tax)] AS m "
        f"FROM lineitem WHERE {where} GROUP BY 1, 2), range(1, 5) t(p)",
    )


_HALF = _u("'half|' || l_orderkey || '|' || l_linenumber") + " < 0.5"
_updates("supplier_update", "true")
_updates("supplier_half1", _HALF)
_updates("supplier_half2", f"NOT ({_HALF})")
_cte(
    "supplier_pairs",
    "SELECT a.client_id AS verifier, b.client_id AS prover FROM supplier_rank a JOIN supplier_rank b "
    "ON b.rank = (a.rank + 1) % a.n",
    "supplier_rank",
)
_cte(
    "supplier_rank",
    "SELECT client_id, row_number() OVER (ORDER BY score DESC, client_id) - 1 AS rank, count(*) OVER () AS n FROM supplier_score",
    "supplier_score",
)
_cte(
    "customer_rank",
    "SELECT c_custkey AS client_id, CAST(row_number() OVER (ORDER BY (c_acctbal + 1000.0) / 11000.0 DESC, c_custkey) - 1 AS BIGINT) AS rank, "
    "count(*) OVER () AS n FROM customer",
)
_cte(
    "past_pairs",
    "SELECT CAST(a.rank + 1 AS BIGINT) AS seq, a.client_id AS verifier, b.client_id AS prover FROM customer_rank a "
    "JOIN customer_rank b ON b.rank = (a.rank + 1) % a.n ORDER BY seq DESC LIMIT 30",
    "customer_rank",
)


def _offsets(orientation: str) -> str:
    gap = "v.rank - p.rank" if orientation == "reversed" else "p.rank - v.rank"
    return (
        f"SELECT DISTINCT CAST((({gap}) % v.n + v.n) % v.n AS BIGINT) AS o FROM past_pairs h "
        "JOIN customer_rank v ON h.verifier = v.client_id JOIN customer_rank p ON h.prover = p.client_id"
    )


for _side in ("reversed", "emitted"):
    _cte(f"used_{_side}", _offsets(_side), "past_pairs", "customer_rank")
    _cte(
        f"offset_{_side}",
        f"SELECT coalesce((SELECT min(i) FROM range(1, (SELECT max(n) FROM customer_rank)) t(i) "
        f"WHERE i NOT IN (SELECT o FROM used_{_side})), 1) AS o",
        f"used_{_side}",
    )
    _cte(
        f"paired_{_side}",
        f"SELECT a.rank, a.client_id AS verifier, b.client_id AS prover FROM customer_rank a "
        f"JOIN customer_rank b ON b.rank = (a.rank + (SELECT o FROM offset_{_side})) % a.n",
        "customer_rank", f"offset_{_side}",
    )
_cte("embedding_update", "SELECT row_id AS client_id, label, 'embedding' AS layer, unnest(features) AS value, "
     "CAST(generate_subscripts(features, 1) - 1 AS BIGINT) AS idx FROM embedded", "embedded")

# --- models ---

_cte("zero", f"SELECT layer, idx, 0.0::DOUBLE AS value FROM ({_grid(10, 64)})")
_cte("line_zero", f"SELECT layer, idx, 0.0::DOUBLE AS value FROM ({_grid(6, 4)})")
_DRAW = _normal("'0|' || layer || '|' || idx")
_cte(
    "fresh",
    f"SELECT layer, idx, CASE WHEN layer = 'bias' THEN 0.0::DOUBLE ELSE {_DRAW} * sqrt(2.0::DOUBLE / 10.0::DOUBLE) END AS value "
    f"FROM ({_grid(10, 64)})",
)
_trains("stepped", "dealt", "zero", "client_id", 10, 64, 0.5)
_trains("line_stepped", "line_deal", "line_zero", "client_id", 6, 4, 0.5)
_trains("once", "dealt", "fresh", "client_id", 10, 64, 0.1)
_trains("twice", "dealt", "once", "client_id", 10, 64, 0.1, own=True)
_trains("hat", "delivered", "zero", "verifier", 10, 64, 0.5)
for _seed in (1, 2):
    _cte(f"half{_seed}", f"SELECT * FROM dealt WHERE {_u(chr(39) + f'{_seed}|half|' + chr(39) + ' || row_id')} < 0.5", "dealt")
    _trains(f"halved{_seed}", f"half{_seed}", "zero", "client_id", 10, 64, 0.5)
_cte(
    "half_distance",
    "SELECT a.client_id, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS dist FROM halved1 a "
    "JOIN halved2 b ON a.client_id = b.client_id AND a.layer = b.layer AND a.idx = b.idx GROUP BY 1",
    "halved1", "halved2",
)
_cte("limit_", "SELECT coalesce(CAST(ceil(max(dist)) AS DOUBLE), 6.0::DOUBLE) AS d_th FROM half_distance", "half_distance")
_cte(
    "average",
    "SELECT layer, idx, sum(value * 0.5::DOUBLE) / (5.0::DOUBLE + 1e-9::DOUBLE) AS value FROM stepped GROUP BY 1, 2",
    "stepped",
)


def _scores_rows(out: str, rows: str, model: str, features: int = 64) -> None:
    _cte(
        out,
        f"SELECT x.row_id, x.label, m.idx // {features} AS k, sum(m.value * x.v) + max(b.value) AS z FROM "
        f"(SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS j FROM {rows}) x "
        f"JOIN {model} m ON m.layer = 'weight' AND m.idx % {features} = x.j "
        f"JOIN {model} b ON b.layer = 'bias' AND b.idx = m.idx // {features} GROUP BY 1, 2, 3",
        rows, model,
    )


def _accuracy(scored: str) -> str:
    return (
        "SELECT avg(CASE WHEN k = label THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY z DESC, k) AS place FROM {scored}) WHERE place = 1"
    )


def _rounds(name: str, corrupted: str, bad: int) -> None:
    _cte(
        f"{name}_w",
        f"SELECT client_id, layer, idx, CASE WHEN client_id < {bad} THEN {corrupted} ELSE value END AS value FROM stepped",
        "stepped",
    )
    _cte(
        f"{name}_d",
        "SELECT p.prover AS client_id, p.verifier, sqrt(sum((w.value - h.value) * (w.value - h.value))) AS dist "
        f"FROM pairs p JOIN {name}_w w ON w.client_id = p.prover JOIN hat h ON h.verifier = p.verifier "
        "AND h.layer = w.layer AND h.idx = w.idx GROUP BY 1, 2",
        "pairs", f"{name}_w", "hat",
    )
    _cte(
        f"{name}_s",
        f"SELECT d.*, l.d_th, {_step('0.5::DOUBLE', 'd.dist', 'l.d_th', 'true', 'false')} AS score FROM {name}_d d, limit_ l",
        f"{name}_d", "limit_",
    )
    _cte(
        f"{name}_m",
        f"SELECT layer, idx, sum(w.value * s.score) / ((SELECT sum(score) FROM {name}_s WHERE score > 0.01) + 1e-9::DOUBLE) AS value "
        f"FROM {name}_w w JOIN {name}_s s ON w.client_id = s.client_id WHERE s.score > 0.01 GROUP BY 1, 2",
        f"{name}_w", f"{name}_s",
    )
    _scores_rows(f"{name}_z", "test", f"{name}_m")


_rounds("noisy", _normal("'0|1|' || client_id || '|' || layer || '|' || idx"), 6)
_rounds("constant", "1.0::DOUBLE", 2)
_scores_rows("average_z", "test", "average")


def _round(name: str) -> str:
    return _with(
        f"SELECT client_id, verifier, {_r('dist', 6)} AS dist, true AS secure, 0.5::DOUBLE AS score_before, score, "
        "CASE WHEN score <= 0.001 THEN 'attacker' ELSE 'honest' END AS status, score > 0.01 AS is_trusted, d_th, "
        f"(SELECT {_r('accuracy', 6)} FROM ({_accuracy(name + '_z')})) AS accuracy FROM {name}_s",
        f"{name}_s", f"{name}_z",
    )


def _long(source: str, keys: str, needs: tuple[str, ...], value: str = "unnest(features)") -> str:
    return _with(
        f"SELECT {keys}, CAST(pos AS BIGINT) AS pos, {_r('v', 9)} AS value FROM (SELECT {keys}, {value} AS v, "
        f"generate_subscripts(features, 1) - 1 AS pos FROM {source})",
        *needs,
    )


def _cropped(rows: str) -> str:
    """Long pixels (row_id, label, pos, v) of 8 x 8 images, zero-padded by 4 and shifted."""
    dy = f"CAST(floor({_u(chr(39) + '0|dy|' + chr(39) + ' || row_id')} * 9) AS BIGINT) - 4"
    dx = f"CAST(floor({_u(chr(39) + '0|dx|' + chr(39) + ' || row_id')} * 9) AS BIGINT) - 4"
    return (
        "SELECT row_id, label, pos, CASE WHEN pos // 8 + dy BETWEEN 0 AND 7 AND pos % 8 + dx BETWEEN 0 AND 7 "
        "THEN features[CAST((pos // 8 + dy) * 8 + pos % 8 + dx + 1 AS INTEGER)] ELSE 0.0::DOUBLE END AS v "
        f"FROM (SELECT *, {dy} AS dy, {dx} AS dx FROM {rows}), range(64) t(pos)"
    )


_FLIP = f"{_u(chr(39) + '0|flip|' + chr(39) + ' || row_id')} < 0.5"
_MIRROR = f"CASE WHEN {_FLIP} THEN (pos // 8) * 8 + 7 - pos % 8 ELSE pos END"


def _attested(updates: str, out: str, secret: str, cells: int = 16) -> None:
    """Keyed digest per client: block hashes, then the hash of the ordered block hashes."""
    _cte(
        out + "_blocks",
        f"SELECT client_id, layer, idx // {cells} AS block, "
        "sha256(string_agg(idx || ':' || CAST(round(value * 1000000000.0::DOUBLE) AS BIGINT), ',' ORDER BY idx)) AS hash "
        f"FROM {updates} GROUP BY 1, 2, 3",
        updates,
    )
    _cte(
        out,
        f"SELECT client_id, sha256({secret} || '|' || sha256(string_agg(layer || ':' || block || ':' || hash, ',' ORDER BY layer, block))) AS digest "
        f"FROM {out}_blocks GROUP BY client_id",
        out + "_blocks",
    )


_SECRET = "upper(sha256('secret|' || client_id))"
_attested("embedding_update", "signed", _SECRET)
_cte(
    "tampered",
    "SELECT client_id, layer, idx, label, CASE WHEN label = 1 AND idx = 0 THEN value + 0.001::DOUBLE ELSE value END AS value "
    "FROM embedding_update WHERE NOT (label = 2 AND idx = 63)",
    "embedding_update",
)
_cte("labels_of", "SELECT row_id AS client_id, label FROM embedded", "embedded")
_attested("tampered", "resigned", "any_value((SELECT CASE WHEN l.label = 3 THEN upper(md5(CAST(l.client_id AS VARCHAR))) ELSE "
          "upper(sha256('secret|' || l.client_id)) END FROM labels_of l WHERE l.client_id = resigned_blocks.client_id))")
CTE["resigned"] = ((*CTE["resigned"][0], "labels_of"), CTE["resigned"][1])
_cte(
    "links",
    "SELECT s.client_id, coalesce(s.digest = r.digest, false) AS secure FROM signed s LEFT JOIN resigned r ON s.client_id = r.client_id",
    "signed", "resigned",
)

_VALUE9 = f"{_r('value', 9)} AS value"
_VALUE6 = f"{_r('value', 6)} AS value"


def _corrupted(changed: str) -> str:
    return _with(
        "SELECT client_id, layer, idx, " + _r(
            f"CASE WHEN client_id < CAST(floor((SELECT count(*) FROM supplier) * 0.4::DOUBLE) AS BIGINT) THEN {changed} ELSE value END", 6
        ) + " AS value FROM supplier_update",
        "supplier_update",
    )


_NOISE = _normal("'0|1|' || client_id || '|' || layer || '|' || idx")


def _weighted(updates: str, scores: str = "supplier_score") -> str:
    return (
        f"SELECT u.layer, u.idx, sum(u.value * s.score) / ((SELECT sum(score) FROM {scores} x WHERE score > 0.01 "
        f"AND x.client_id IN (SELECT client_id FROM {updates})) + 1e-9::DOUBLE) AS value "
        f"FROM {updates} u JOIN {scores} s ON u.client_id = s.client_id WHERE s.score > 0.01 GROUP BY 1, 2"
    )


_AUDIT_STEPS = {
    "reward": _ordinary("p", "1", "1", "true"),
    "penalty": _ordinary("p", "2", "1", "true"),
    "reward_insecure": _ordinary("p", "1", "1", "false"),
    "penalty_insecure": _ordinary("p", "2", "1", "false"),
}

ORACLES: dict[str, str] = {
    # --- sources, sinks, features ---
    "labeled_source": _long("embedded", "row_id, label", ("embedded",)),
    "train_test_split": _with(
        "SELECT row_id, label, CASE WHEN draw < 0.2 THEN 'test' ELSE 'train' END AS part FROM parted", "parted"
    ),
    "materialized_training": _with(
        f"SELECT a.row_id, a.label, CAST(a.pos AS BIGINT) AS pos, {_r('(b.v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE', 9)} AS value "
        f"FROM (SELECT row_id, label, pos, {_MIRROR} AS source FROM train, range(64) t(pos)) a "
        f"JOIN ({_cropped('train')}) b ON a.row_id = b.row_id AND a.source = b.pos",
        "train",
    ),
    "scale_unit": _long("lines", "row_id", ("lines",), "unnest(features) / 255.0::DOUBLE"),
    "normalize": _long("lines", "row_id", ("lines",), "(unnest(features) - 0.5::DOUBLE) / 0.5::DOUBLE"),
    "random_crop": _with(f"SELECT row_id, CAST(pos AS BIGINT) AS pos, {_r('v', 9)} AS value FROM ({_cropped('embedded')})", "embedded"),
    "random_hflip": _with(
        f"SELECT row_id, CAST(pos AS BIGINT) AS pos, {_r(f'features[CAST({_MIRROR} + 1 AS INTEGER)]', 9)} AS value "
        "FROM embedded, range(64) t(pos)",
        "embedded",
    ),
    "prepare_test": _long("test", "row_id", ("test",), "(unnest(features) / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE"),
    "wide_history": _with(
        "SELECT run_id, round AS \"Round\", " + ", ".join(
            f"max(CASE WHEN client_id = {c} THEN score END) AS \"Client_{c}\"" for c in range(10)
        ) + " FROM history GROUP BY 1, 2",
        "history",
    ),
    "history_round_trip": _with(
        "SELECT run_id, CAST(1 AS INTEGER) AS segment, CAST(round AS BIGINT) AS round, client_id, score FROM history", "history"
    ),
    "history_segments": _with(
        "SELECT run_id, CAST(1 AS INTEGER) AS segment, round, client_id, score FROM history UNION ALL "
        "SELECT run_id, CAST(2 AS INTEGER), round, client_id, score FROM history WHERE round <= 15",
        "history",
    ),
    "run_file_metadata":
        "SELECT doc_id, CAST(length(lang) AS INTEGER) AS attack, CAST('0.' || (doc_id % 10) AS DOUBLE) AS ratio, "
        "CAST(n_chars AS DOUBLE) AS d_th FROM documents",
    "accuracy_log": _with(
        "SELECT a.run_id, a.round AS \"Round\", a.accuracy AS \"Accuracy\", coalesce(last_value(h.score IGNORE NULLS) OVER "
        "(PARTITION BY a.run_id ORDER BY a.round), 0.5::DOUBLE) AS \"Credibility_C0\" FROM run_accuracy a "
        "LEFT JOIN history h ON a.run_id = h.run_id AND a.round = h.round AND h.client_id = 0",
        "run_accuracy", "history",
    ),
    "params_in_order": _with(
        "SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY layer, idx) - 1 AS BIGINT) AS pos, "
        f"{_VALUE6} FROM supplier_update",
        "supplier_update",
    ),
    "params_in_blocks": _with(
        f"SELECT client_id, layer, idx // 16 AS block_id, count(*) AS cells, {_r('sum(value)', 6)} AS total "
        "FROM embedding_update GROUP BY 1, 2, 3",
        "embedding_update",
    ),
    "attacker_roster":
        "SELECT s_suppkey AS client_id, s_suppkey < CAST(floor((SELECT count(*) FROM supplier) * 0.29::DOUBLE) AS BIGINT) AS is_attacker FROM supplier",
    "trust_status": _with(
        "SELECT client_id, CASE WHEN score <= 0.001 THEN 'attacker' ELSE 'honest' END AS status FROM supplier_score", "supplier_score"
    ),
    "proof_flags": "SELECT event_id, event_type IN ('click', 'purchase') AS accepted FROM events",
    # --- dealing ---
    "capacity_check": "SELECT CAST(40 AS BIGINT) AS required, count(*) AS actual, count(*) >= 40 AS ok FROM lineitem",
    "label_shards": _with("SELECT row_id, label, shard FROM embedded_shards", "embedded_shards"),
    "label_shards_lineitem": _with("SELECT row_id, label, shard FROM line_shards", "line_shards"),
    "shard_audit": _with(
        "SELECT count(*) AS shards, CAST(sum(n) AS BIGINT) AS total_rows, min(n) AS smallest, max(n) AS largest, "
        "count(*) = 40 AND max(n) - min(n) <= 1 AS even FROM (SELECT shard, count(*) AS n FROM line_shards GROUP BY 1)",
        "line_shards",
    ),
    "client_deal": _with("SELECT row_id, shard, client_id FROM line_deal", "line_deal"),
    "client_order": _with("SELECT row_id, client_id, ord FROM line_deal", "line_deal"),
    "client_layout": _with("SELECT client_id, ord // 1000 AS block, count(*) AS n FROM line_deal GROUP BY 1, 2", "line_deal"),
    "client_subset": _with("SELECT client_id, row_id, pos FROM line_subset", "line_subset"),
    "client_subset_large": _with("SELECT client_id, row_id, pos FROM line_subset_large", "line_subset_large"),
    "label_skew": _with(
        "SELECT client_id, label, n, CAST(sum(n) OVER (PARTITION BY client_id) AS BIGINT) AS client_rows, "
        "count(*) OVER (PARTITION BY client_id) AS labels_held, "
        f"{_r('n / CAST(sum(n) OVER (PARTITION BY client_id) AS DOUBLE)', 9)} AS share FROM "
        "(SELECT client_id, label, count(*) AS n FROM line_deal GROUP BY 1, 2)",
        "line_deal",
    ),
    "label_skew_documents":
        "SELECT client_id, label, n, CAST(sum(n) OVER (PARTITION BY client_id) AS BIGINT) AS client_rows, "
        "count(*) OVER (PARTITION BY client_id) AS labels_held, "
        f"{_r('n / CAST(sum(n) OVER (PARTITION BY client_id) AS DOUBLE)', 9)} AS share FROM "
        "(SELECT lang AS client_id, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)",
    # --- joins ---
    "sample_delivery": _with("SELECT verifier, prover, pos, row_id, label FROM delivered", "delivered"),
    "matched_updates": _with(
        "SELECT coalesce(w.prover, h.prover) AS prover, coalesce(w.verifier, h.verifier) AS verifier, "
        "coalesce(w.layer, h.layer) AS layer, coalesce(w.idx, h.idx) AS idx, "
        f"{_r('w.value', 6)} AS w, {_r('h.value', 6)} AS w_hat FROM "
        "(SELECT p.*, u.layer, u.idx, u.value FROM supplier_pairs p JOIN supplier_half1 u ON u.client_id = p.prover) w FULL JOIN "
        "(SELECT p.*, u.layer, u.idx, u.value FROM supplier_pairs p JOIN supplier_half2 u ON u.client_id = p.verifier) h "
        "ON w.prover = h.prover AND w.verifier = h.verifier AND w.layer = h.layer AND w.idx = h.idx",
        "supplier_pairs", "supplier_half1", "supplier_half2",
    ),
    "key_lookup":
        "SELECT l_suppkey AS client_id, count(*) AS n, sha256('secret|' || l_suppkey) AS secret_hex FROM lineitem "
        "JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey",
    "score_lookup": _with(
        f"SELECT u.client_id, u.layer, u.idx, {_r('u.value * s.score', 6)} AS weighted FROM supplier_update u "
        "JOIN supplier_score s ON u.client_id = s.client_id",
        "supplier_update", "supplier_score",
    ),
    "used_offsets": _with(
        "SELECT o AS \"offset\", 'reversed' AS orientation FROM used_reversed UNION ALL "
        "SELECT o AS \"offset\", 'emitted' AS orientation FROM used_emitted",
        "used_reversed", "used_emitted",
    ),
    # --- distances, thresholds, averages ---
    "model_distance": _with(
        f"SELECT a.client_id, {_r('sqrt(sum((a.value - b.value) * (a.value - b.value)))', 6)} AS dist FROM supplier_half1 a "
        "JOIN supplier_half2 b ON a.client_id = b.client_id AND a.layer = b.layer AND a.idx = b.idx GROUP BY 1",
        "supplier_half1", "supplier_half2",
    ),
    "block_distance": _with(
        f"SELECT a.client_id, {_r('sqrt(sum((a.value - b.value) * (a.value - b.value)))', 9)} AS dist FROM embedding_update a "
        "JOIN embedding_update b ON a.client_id = b.client_id AND a.idx = 63 - b.idx GROUP BY 1",
        "embedding_update",
    ),
    "threshold_estimate": _with(
        "SELECT (SELECT d_th FROM limit_) AS d_th, count(dist) AS clients, round(min(dist), 4) AS smallest, "
        "round(max(dist), 4) AS largest FROM half_distance",
        "half_distance", "limit_",
    ),
    "trusted_clients": _with(
        f"SELECT client_id, {_r('score', 9)} AS score FROM supplier_score WHERE score > 0.01", "supplier_score"
    ),
    "weighted_average": _with(
        f"SELECT layer, idx, {_VALUE6} FROM ({_weighted('supplier_update')})", "supplier_update", "supplier_score"
    ),
    "next_global_model": _with(
        f"SELECT 'trusted' AS voters, n.layer IS NULL AS kept, p.layer, p.idx, {_r('coalesce(n.value, p.value)', 6)} AS value "
        f"FROM ({_weighted('supplier_half1')}) p LEFT JOIN ({_weighted('supplier_half2')}) n ON p.layer = n.layer AND p.idx = n.idx "
        f"UNION ALL SELECT 'none', true, layer, idx, {_r('value', 6)} FROM ({_weighted('supplier_half1')})",
        "supplier_half1", "supplier_half2", "supplier_score",
    ),
    "run_summary": _with(
        "SELECT run_id, count(*) AS rounds, arg_max(accuracy, round) AS final, max(accuracy) AS best, "
        "min(CASE WHEN accuracy = top THEN round END) AS best_round, "
        f"{_r('avg(CASE WHEN round > last - 10 THEN accuracy END)', 6)} AS tail_mean FROM "
        "(SELECT *, max(round) OVER (PARTITION BY run_id) AS last, max(accuracy) OVER (PARTITION BY run_id) AS top FROM run_accuracy) "
        "GROUP BY run_id",
        "run_accuracy",
    ),
    "detection_report": _with(
        "SELECT *, CASE WHEN client_id < 6 AND first_excluded IS NOT NULL THEN 'detected' WHEN client_id < 6 THEN 'missed' "
        "WHEN first_excluded IS NOT NULL THEN 'wrongly_excluded' ELSE 'clean' END AS verdict FROM "
        "(SELECT run_id, client_id, min(CASE WHEN score <= 0.01 THEN round END) AS first_excluded, "
        "CAST(sum(CASE WHEN score <= 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS rounds_excluded, count(*) AS rounds FROM history GROUP BY 1, 2)",
        "history",
    ),
    # --- pairing ---
    "pairing_reversed": _with("SELECT rank, verifier, prover FROM paired_reversed", "paired_reversed"),
    "pairing_emitted": _with("SELECT rank, verifier, prover FROM paired_emitted", "paired_emitted"),
    "history_retention": _with(
        "SELECT seq, verifier, prover FROM (SELECT * FROM past_pairs UNION ALL "
        "SELECT CAST((SELECT max(seq) FROM past_pairs) + rank + 1 AS BIGINT), verifier, prover FROM paired_emitted) ORDER BY seq DESC LIMIT 30",
        "past_pairs", "paired_emitted",
    ),
    "client_ranking": _with("SELECT client_id, rank FROM customer_rank", "customer_rank"),
    "rehab_rounds": _with(
        "SELECT round, count(*) AS n, (round - 1) % 10 = 0 AND round > 1 AS rehab FROM observed GROUP BY round", "observed"
    ),
    # --- credibility ---
    "credibility_step":
        f"SELECT event_id, {_step('s', 'value', '100', chr(39) + 'error' + chr(39) + ' <> event_type', chr(39) + 'view' + chr(39) + ' = event_type')} AS new_score FROM "
        f"(SELECT *, d * d * d * d AS s FROM (SELECT *, {_u(chr(39) + 'step|' + chr(39) + ' || event_id')} AS d FROM events))",
    "credibility_fold": _with(
        "SELECT client_id, max(round) AS rounds, arg_max(score, round) AS score FROM traced GROUP BY client_id", "traced"
    ),
    "credibility_trace": _with("SELECT client_id, round, score FROM traced", "traced"),
    "best_so_far": _with(
        "SELECT run_id, round, accuracy, greatest(accuracy, before) AS best, accuracy > before AS is_new_best FROM best_log", "best_log"
    ),
    "transition_audit": _with(
        "SELECT run_id, round, client_id, CASE WHEN (round - 1) % 10 = 0 AND round > 1 AND p <= 0.01::DOUBLE "
        "AND score > 0.02::DOUBLE AND score <= 0.02::DOUBLE + 0.03::DOUBLE THEN 'rehab' "
        + " ".join(f"WHEN score = {sql} THEN '{name}'" for name, sql in _AUDIT_STEPS.items())
        + " ELSE 'illegal' END AS transition FROM (SELECT *, coalesce(lag(score) OVER (PARTITION BY run_id, client_id ORDER BY round), 0.5::DOUBLE) AS p "
        "FROM (SELECT run_id, round, client_id, CASE WHEN run_id = 'run1' AND round = 5 THEN score * 0.37::DOUBLE ELSE score END AS score FROM history))",
        "history",
    ),
    # --- training and scoring ---
    "model_init": _with(f"SELECT layer, idx, {_VALUE9} FROM fresh", "fresh"),
    "fullbatch_step": _with(f"SELECT client_id, layer, idx, {_VALUE9} FROM stepped", "stepped"),
    "fullbatch_two_steps": _with(f"SELECT client_id, layer, idx, {_r('value', 7)} AS value FROM twice", "twice"),
    "fullbatch_lineitem": _with(f"SELECT client_id, layer, idx, {_VALUE9} FROM line_stepped", "line_stepped"),
    "authentication_fullbatch": _with(f"SELECT verifier, layer, idx, {_VALUE9} FROM hat", "hat"),
    "empty_clients":
        "SELECT c_custkey AS client_id, count(o_orderkey) AS \"rows\", CAST(ceil(count(o_orderkey) / 4.0::DOUBLE) * 3 AS BIGINT) AS steps, "
        "CASE WHEN count(o_orderkey) = 0 THEN 'empty' ELSE 'trained' END AS status FROM customer "
        "LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "predictions": _with(
        f"SELECT row_id, CAST(k AS BIGINT) AS pos, {_r('z', 9)} AS value FROM average_z", "average_z"
    ),
    "argmax_class": _with(
        "SELECT row_id, CAST(list_position(features, list_max(features)) - 1 AS INTEGER) AS predicted FROM lines", "lines"
    ),
    "model_accuracy": _with(f"SELECT {_r('accuracy', 6)} AS accuracy FROM ({_accuracy('average_z')})", "average_z"),
    "corruption_none": _corrupted("value"),
    "corruption_additive": _corrupted(f"value + {_NOISE}"),
    "corruption_replacement": _corrupted(_NOISE),
    "corruption_constant": _corrupted("1.0::DOUBLE"),
    # --- exchange ---
    "sealed_round_trip": _long("delivered", "verifier, prover, row_id, label", ("delivered",)),
    "opened_with_wrong_key": _with(
        "SELECT verifier, count(DISTINCT pos // 8) AS packages, CAST(0 AS BIGINT) AS opened FROM delivered GROUP BY verifier", "delivered"
    ),
    "attestations": _with("SELECT client_id, digest FROM signed", "signed"),
    "verification": _with("SELECT client_id, secure FROM links", "links"),
    "tamper_drill": _with(
        f"SELECT l.client_id, {_step('0.5::DOUBLE', 'CAST(e.label AS DOUBLE)', '6', 'l.secure', 'false')} AS new_score FROM links l "
        "JOIN labels_of e ON l.client_id = e.client_id",
        "links", "labels_of",
    ),
    # --- rounds ---
    "training_round": _round("noisy"),
    "training_round_constant": _round("constant"),
    "round_report": _with(
        "SELECT h.run_id, h.round, b.accuracy, greatest(b.accuracy, b.before) AS best, b.accuracy > b.before AS is_new_best, "
        "c.score AS score_c0, h.client_id, h.score, CASE WHEN h.score <= 0.001 THEN 'attacker' ELSE 'honest' END AS status "
        "FROM history h LEFT JOIN best_log b ON h.run_id = b.run_id AND h.round = b.round "
        "JOIN (SELECT r.run_id, r.round, coalesce(last_value(o.score IGNORE NULLS) OVER (PARTITION BY r.run_id ORDER BY r.round), "
        "0.5::DOUBLE) AS score FROM (SELECT DISTINCT run_id, round FROM history) r LEFT JOIN history o "
        "ON o.run_id = r.run_id AND o.round = r.round AND o.client_id = 0) c ON c.run_id = h.run_id AND c.round = h.round",
        "history", "best_log",
    ),
}
ORACLES["credibility_fold_blocks"] = ORACLES["credibility_fold"]
ORACLES["streaming_credibility"] = ORACLES["credibility_fold"]
ORACLES["streaming_credibility_batches"] = ORACLES["credibility_fold"]
