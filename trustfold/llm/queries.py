"""The operators of this folder as named queries over the given tables, with SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustfold.functions.storage import durable
from trustfold.llm.conversation_trie import placed_turns, prefix_trie, with_shared_starts
from trustfold.llm.decontamination import contamination
from trustfold.llm.divergence import source_audit
from trustfold.llm.fingerprints import fingerprint_report
from trustfold.llm.html_extraction import main_text
from trustfold.llm.license_texts import SHORT_NOTICES, TEMPLATES
from trustfold.llm.licenses import scan
from trustfold.llm.packing import pack_documents
from trustfold.llm.pii import BASE, KINDS, find_spans
from trustfold.llm.quality import quality
from trustfold.llm.sharding import hilbert_shards
from trustfold.llm.simhash import near_duplicates
from trustfold.llm.suffix_array import without_repeats
from trustfold.llm.token_output import Matrices, matrix_rows, pack_matrices

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the packed matrices, with checksums of its ids and positions."""
    how = Matrices()
    rows = matrix_rows(pack_matrices(table(spark, sf_dir, "documents"), vocabulary(), how), how.length)
    return rows.select(
        "sequence_id", "doc_ids", "starts", "cu_seqlens",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksum of the base spans, and all spans, of every document."""
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(kind) for kind in BASE]
    added = [_count(kind, base=False) for kind in KINDS if kind not in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *added,
        F.size("spans").cast("long").alias("n_spans"),
    )


def _count(kind: str, base: bool = True) -> Column:
    return F.size(F.filter("spans", lambda s: (s["base"] == base) & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op4_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and what they say of its likeness to that and to the next."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op5_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates that every document contains."""
    templates = spark.createDataFrame(TEMPLATES + SHORT_NOTICES, "template_id string, license string, text string")
    found = scan(table(spark, sf_dir, "documents"), templates)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: m["template_id"]), ",").alias("templates"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, by weights learned from two thirds of the labelled ones."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows, and the verdict, of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards are equal in rows."""
    found = hilbert_shards(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in repeated strings of 200 bytes, and the checksum of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt to share first turns."""
    turns, roster = with_shared_starts(durable(placed_turns(table(spark, sf_dir, "conversations")), "turns"))
    return prefix_trie(turns, roster).withColumnsRenamed({"saved": "saved_tokens", "digest": "ends_sha256"})


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source lies from the others of its language, and its ten most telling terms."""
    return source_audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_cost_balanced_packing": op1_cost_balanced_packing,
    "op2_packed_matrices": op2_packed_matrices,
    "op3_weak_supervision_pii": op3_weak_supervision_pii,
    "op4_one_permutation_minhash": op4_one_permutation_minhash,
    "op5_license_windows": op5_license_windows,
    "op6_attention_quality": op6_attention_quality,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_golay_simhash": op10_golay_simhash,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
#: CRC-32 of the decimal number in column ``conv_id``, bit by bit: reversed polynomial, all ones at first and at last.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                lambda bits, step: CASE WHEN bits % 2 = 1 THEN xor(bits // 2, 3988292384) ELSE bits // 2 END)), 4294967295)"""
_QUOTED = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in TEMPLATES + SHORT_NOTICES)

ORACLES: dict[str, str] = {
    "op5_license_windows": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), t AS (
            SELECT template_id, license, {_WORDS} AS w FROM (VALUES {_QUOTED}) AS v(template_id, license, text)
        ), s AS (
            SELECT DISTINCT r, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT least(len(w), 5) AS n FROM t WHERE len(w) > 0) WHERE len(w) >= n)
        ), u AS (
            SELECT DISTINCT template_id, license, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
            FROM (SELECT template_id, license, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM t WHERE len(w) > 0)
        ), n AS (
            SELECT template_id, count(*) AS n FROM u GROUP BY template_id
        ), m AS (
            SELECT r, template_id, license, count(*) / any_value(n) AS share
            FROM s JOIN u USING (g) JOIN n USING (template_id) GROUP BY r, template_id, license
            HAVING count(*) / any_value(n) >= 0.8
        ), a AS (
            SELECT r, count(*) AS n_matches, string_agg(template_id, ',' ORDER BY template_id) AS templates,
                   array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, max(share) AS containment
            FROM m GROUP BY r
        )
        SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(templates, '') AS templates,
               coalesce(licenses, '') AS licenses, coalesce(containment, 0.0) AS containment
        FROM d LEFT JOIN a USING (r)
    """,
    "op7_benchmark_decontamination": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r,
                   {_WORDS} AS w
            FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id,
                   {_WORDS} AS w
            FROM benchmark
        ), g AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
        ), x AS (
            SELECT r, n, i, list_slice(w, i, i + n - 1) AS gram
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
        ), hit AS (
            SELECT r, i, n, item_id FROM x JOIN g USING (n, gram)
        ), spread AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
        ), named AS (
            SELECT r, count(DISTINCT item_id) AS n_items,
                   array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names
            FROM hit GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN spread USING (r) LEFT JOIN named USING (r)
    """,
    "op11_suffix_array_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS y, hex(encode(coalesce(text, ''))) AS x FROM documents
        ), w AS MATERIALIZED (
            SELECT r, i, md5(y[i + 1 : i + 200]) AS m
            FROM (SELECT r, y, unnest(range(0, octet_length(y) - 199)) AS i FROM d WHERE octet_length(y) >= 200)
        ), i AS (
            SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
            FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)
        ), g AS (
            SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM i
        ), s AS (
            SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run
        ), k AS (
            SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM s
            UNION ALL SELECT r, max(b), NULL FROM s GROUP BY r
        ), t AS (
            SELECT r, string_agg(substr(x, 2 * a + 1, 2 * coalesce(b - a, len(x))), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r
        ), n AS (
            SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY r
        )
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN t USING (r) LEFT JOIN n USING (r)
    """,
    "op12_conversation_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, role, text
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        ), s AS (
            SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
        ), h AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM s
        ), l AS (
            SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS taken
            FROM h LEFT JOIN (SELECT conv_id AS base, n FROM s) AS b USING (base)
        ), u AS (
            SELECT t.conv_id, CASE WHEN l.base = t.conv_id THEN t.pos ELSE t.pos - l.h + l.taken END AS pos, role, text
            FROM t JOIN l ON l.conv_id = t.conv_id WHERE l.base = t.conv_id OR t.pos >= l.h
            UNION ALL
            SELECT l.conv_id, t.pos, role, text FROM l JOIN t ON t.conv_id = l.base WHERE l.base <> l.conv_id AND t.pos < l.h
        ), e AS (
            SELECT s.conv_id, coalesce(max(u.pos) + 1, 0) AS len FROM s LEFT JOIN u ON u.conv_id = s.conv_id GROUP BY s.conv_id
        ), p AS (
            SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes,
                   string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k
            FROM u
            UNION ALL SELECT conv_id, 0, 0, '' FROM s
        ), n AS (
            SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY depth, k
        ), c AS (
            SELECT depth - 1 AS depth, substr(k, 1, 32 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
        ), v AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)
        ), a AS (
            SELECT d AS depth, substr(k, 1, 32 * d) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
                   sum((n_convs - 1) * bytes) AS saved_tokens
            FROM (SELECT v.*, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY ALL
        ), m AS (
            SELECT p.depth, p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
            FROM p JOIN e ON e.conv_id = p.conv_id AND e.len = p.depth GROUP BY p.depth, p.k
        )
        SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children,
               CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
        FROM v JOIN a USING (depth, k) LEFT JOIN m USING (depth, k)
        LEFT JOIN n AS o ON o.depth = v.depth - 1 AND o.k = substr(v.k, 1, 32 * (v.depth - 1))
    """,
    "op13_source_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), x AS (
            SELECT r, lang, source, unnest(w) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 10
        ), l AS (
            SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
        ), c AS (
            SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN k ON k.lang = x.lang AND k.term = x.term GROUP BY ALL
        ), t AS (
            SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
        ), g AS (
            SELECT s.lang, s.source, coalesce(t.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS ln
            FROM (SELECT DISTINCT lang, source FROM d) AS s LEFT JOIN t USING (lang, source) LEFT JOIN l USING (lang)
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS BIGINT) AS p,
                   CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (g.ln + 2 * g.v) AS BIGINT) AS q
            FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), both_parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts
        )
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
