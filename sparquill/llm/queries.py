"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import chat, decontaminate, divergence, exact, genetic, importance, minhash, packing, quality, secrets, tokens, urls, wordpiece
from . import common as C

#: Fixed rules of the URL query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), scan=True)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_history(_table(spark, sf_dir, "documents"), path_col="doc_id", scan=True)
    base = F.filter("findings", lambda x: x["rank"] < len(secrets.BASE))
    counts = [F.size(F.expr(f"filter(findings, x -> x.kind = '{r.kind}')")).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("findings")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"), scan=True)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, text)
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = C.materialize(packing.pack_best_fit(_documents(spark, sf_dir), tokens.default_path()), "packed", compression="zstd")
    return packed.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "position_resets", F.element_at("cu_seqlens", -1).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_documents(spark, sf_dir), tokens.default_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), scan=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def _checksum(path: str):
    """The checksum of a piece's ids as a column function."""
    width = tokens.id_width(path)

    @F.pandas_udf("long")
    def checksum(ids):
        return ids.map(lambda b: packing.crc32_of(b, width)).astype("int64")

    return checksum


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.default_path()
    pieces = packing.concat_and_cut(_documents(spark, sf_dir), path)
    return pieces.select("doc_id", "start", "length", _checksum(path)("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_genetic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.default_path()
    pieces = genetic.pack(_documents(spark, sf_dir), path)
    return pieces.select("doc_id", "piece", "start", "length", _checksum(path)("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), scan=True)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash, op2_secrets, op3_url_filter, op4_exact_dedup, op5_chat_format, op6_packed_ids, op7_token_counts, op8_decontaminate, op9_quality, op10_pack,
        op11_genetic_pack, op12_divergence, op13_importance,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
    WHERE 100 * both_have >= 75 * (sa.n + sb.n - both_have)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, d.doc_id = coalesce(l.c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


#: The kinds of the secrets query with their patterns, what comes before the part that counts, and its least length: the base ones as its contract states them.
_OP2_WORDS = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_OP2_KINDS = (
    ("assign", _OP2_WORDS + "[A-Za-z0-9+/_.=-]+", "^" + _OP2_WORDS, 6),
    ("access", "AKIA[A-Z0-9]+", "", 20),
    ("hex", "[0-9a-f]+", "", 24),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "", 0),
    ("code_host_token", "gh[pousr]_[A-Za-z0-9]{36,}", "", 0),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", "", 0),
)


def _op2() -> str:
    parts = []
    for rank, (kind, pattern, head, least) in enumerate(_OP2_KINDS):
        pattern, head = pattern.replace("'", "''"), head.replace("'", "''")
        counted = f"regexp_replace(m, '{head}', '')" if head else "m"
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (
            SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
            FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM texts)))
            WHERE length({counted}) >= {least}"""
        )
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({' UNION ALL '.join(parts)}),
    lists AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN lists l ON l.doc_id = d.doc_id"""


_OP3 = r"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

_OP4 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g ON t.h = g.h
"""

_OP5 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(4 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + 2 + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, @LOWER@ AS t FROM documents),
c AS (SELECT row_number() OVER () AS row, lang, source, regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM docs),
terms AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM c),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
shares AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gn.n, 0) + l.v) AS HUGEINT) AS p,
        CAST(1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS HUGEINT) AS q
    FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""".replace("@LOWER@", _LOWER)

#: The CRC-32 of a feature goes over its bytes with the table of the 256 remainders.
_OP13 = r"""
WITH RECURSIVE steps AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS MATERIALIZED (
    SELECT true AS own, doc_id, regexp_extract_all(@LOWER@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT false, NULL, regexp_extract_all(@LOWER@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS MATERIALIZED (SELECT own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
buckets AS MATERIALIZED (
    SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1]))) % 10000 AS b FROM hexed, crc),
counts AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM runs JOIN buckets USING (f) GROUP BY b),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln((counts.t + 1.0::DOUBLE) * (sums.s + 10000.0::DOUBLE) / ((counts.s + 1.0::DOUBLE) * (sums.t + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM counts, sums),
own AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM runs JOIN buckets USING (f) JOIN gains USING (b) WHERE own GROUP BY doc_id),
scored AS (
    SELECT x.doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || x.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM texts x LEFT JOIN own o ON o.doc_id = x.doc_id WHERE x.own),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
""".replace("@LOWER@", _LOWER)

#: The other queries tokenise, learn or hash and have no SQL; tests compare them with brute force.
ORACLES = {"op1_minhash": _OP1, "op2_secrets": _op2(), "op3_url_filter": _OP3, "op4_exact_dedup": _OP4, "op5_chat_format": _OP5, "op12_divergence": _OP12, "op13_importance": _OP13}
