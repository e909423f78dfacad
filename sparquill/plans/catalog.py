"""The registered queries: every operator bound to a driver table of the right shape, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import latex, prompts, runs, scoring
from ..functions import text as X
from ..operators import ivf, overlap, places, relational, vector
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with the given columns, for costly work on each text."""
    return tables.spread(_t(spark, sf_dir, "documents").select(*columns))


# --- Overlap and retrieval -------------------------------------------------------------------------


_COSINES = r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents),
d AS (SELECT doc_id, token, count(*) AS n FROM dt GROUP BY ALL),
bt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark),
b AS (SELECT item_id, token, count(*) AS m FROM bt GROUP BY ALL),
dn AS (SELECT doc_id, sum(n * n) AS a FROM d GROUP BY doc_id), bn AS (SELECT item_id, sum(m * m) AS c FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, sum(n * m) AS dot FROM d JOIN b USING (token) GROUP BY ALL),
s AS (SELECT doc_id, item_id, dot / (sqrt(a) * sqrt(c)) AS s FROM p JOIN dn USING (doc_id) JOIN bn USING (item_id))"""


@_query(_COSINES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS k FROM s)
SELECT x.doc_id, r.item_id, round(coalesce(r.s, 0.0), 6) AS similarity, coalesce(r.s, 0.0) > 0.85 AS flagged
FROM documents x LEFT JOIN r ON r.doc_id = x.doc_id AND k = 1""")
def overlap_screen(spark, sf_dir):
    out = overlap.closest(_texts(spark, sf_dir, "doc_id", "text"), _t(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 6))


@_query(_COSINES + """,
c AS (SELECT doc_id, count(*) AS n_close FROM s WHERE s > 0.85 GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_close, 0) AS n_close, n_close IS NOT NULL AS flagged FROM documents x LEFT JOIN c ON c.doc_id = x.doc_id""")
def overlap_flags(spark, sf_dir):
    return overlap.flags(_texts(spark, sf_dir, "doc_id", "text"), _t(spark, sf_dir, "benchmark"))


@_query(_COSINES + """
SELECT doc_id, item_id, round(s, 6) AS similarity FROM s WHERE s > 0.6""")
def overlap_pairs(spark, sf_dir):
    out = overlap.similar_pairs(_texts(spark, sf_dir, "doc_id", "text"), _t(spark, sf_dir, "benchmark"), threshold=0.6)
    return out.withColumn("similarity", F.round("similarity", 6))


@_query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token""")
def term_frequency(spark, sf_dir):
    terms = overlap.term_counts(_texts(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return terms.groupBy("token").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


_TOPK = """
WITH q AS (SELECT vec_id AS query, embedding AS e, label AS gold_label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, gold_label, vec_id AS id, label,
    round(list_inner_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS sim FROM q JOIN embeddings ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s)
"""


@_query(_TOPK + "SELECT query, id, label, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10")
def vector_top_k(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return vector.top_k(rows, rows.filter("vec_id % 20 = 0"), 10).withColumn("sim", F.round("sim", 6))


@_query()
def vector_ivf_top_k(spark, sf_dir):
    """Without SQL: an inverted file finds most neighbours, not all; tests hold its recall against the exact query."""
    rows = _t(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0")
    index = ivf.build(rows, 32)
    return ivf.search(index, asked, 10, ivf.calibrated(index, asked)).withColumn("sim", F.round("sim", 6))


@_query("""
WITH t AS (SELECT 'paper/' || CAST(vec_id AS VARCHAR) AS id, embedding AS e, vec_id FROM embeddings),
s AS (SELECT q.id AS query, t.id AS id, round(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(t.e AS DOUBLE[])), 9) AS sim FROM t q JOIN t ON t.id <> q.id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s)
SELECT query, id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10""")
def vector_top_k_by_text_id(spark, sf_dir):
    """Ids are texts and there is no label, as in an index file."""
    rows = _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("paper/"), "vec_id").alias("id"), "embedding", "vec_id")
    hits = vector.top_k(rows.drop("vec_id"), rows.filter("vec_id % 20 = 0"), 10, "id", "embedding", None)
    return hits.withColumn("sim", F.round("sim", 6))


@_query(_TOPK + """, g AS (SELECT query, min_by(id, rank) AS top1_id, max(CASE WHEN label = gold_label THEN 1.0 ELSE 0.0 END) AS recall, round(avg(sim), 4) AS mean_sim
    FROM r WHERE rank <= 50 GROUP BY query)
SELECT query, top1_id, CAST(recall AS DOUBLE) AS recall, mean_sim, round(0.5 * recall + 0.5 * mean_sim, 6) AS retrieval_score FROM g""")
def retrieval_scores(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0")
    return vector.retrieval_summary(vector.top_k(rows, asked, 50), asked.select(F.col("vec_id").alias("query"), F.col("label").alias("gold_label")))


# --- Corpus building -------------------------------------------------------------------------------


@_query("""
WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 400 THEN 'short' ELSE 'kept' END AS reason,
    count(*) AS n FROM j GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.skip_counts(rows, unlabelled=F.col("quality").isNull(), low_quality=F.col("quality") == 0, toxic=F.col("toxic") == 1, short=F.col("n_chars") < 400)


@_query("""
SELECT count(*) AS n_examples, round(avg(quality), 4) AS mean_quality, round(avg(n_chars), 4) AS mean_chars,
    round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 4) AS long_share FROM documents JOIN labels USING (doc_id)""")
def score_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return rows.agg(F.count("*").alias("n_examples"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg((F.col("n_chars") > 2000).cast("double")), 4).alias("long_share"))


@_query("""SELECT doc_id, lang, source FROM documents
WHERE list_has_any([lang, source], ['fr', 'src3']) AND coalesce(text, '') <> ''""")
def category_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").withColumn("categories", F.array("lang", "source"))
    wanted = F.arrays_overlap("categories", F.array(F.lit("fr"), F.lit("src3")))
    return rows.filter(wanted & ~X.empty(F.col("text"))).select("doc_id", "lang", "source")


def _references(spark, sf_dir, least):
    """Orders as papers and line items as their references: parts over size 25 are known locally, returned items have no text of their own."""
    lines = _t(spark, sf_dir, "lineitem")
    own = F.when(F.col("l_returnflag") != "R", F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    edges = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("ref"), F.col("l_linenumber").alias("pos"), F.lit("edge").alias("title"), own.alias("abstract"), F.year("l_shipdate").alias("year"))
    part = _t(spark, sf_dir, "part").filter("p_size > 25")
    store = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_size").alias("year"))
    return relational.resolved_references(edges, store, "paper", "ref", "pos", least)


_REFS = """
WITH e AS (SELECT l_orderkey AS paper, l_partkey AS ref, l_linenumber AS pos, CASE WHEN l_returnflag <> 'R' THEN l_returnflag || ' ' || l_linestatus END AS own, year(l_shipdate) AS y FROM lineitem),
j AS (SELECT paper, ref, pos, CASE WHEN p_type IS NOT NULL THEN p_name ELSE 'edge' END AS title, coalesce(p_type, own) AS abstract, CASE WHEN p_type IS NOT NULL THEN p_size ELSE y END AS year
    FROM e LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = ref WHERE coalesce(p_type, own, '') <> ''),
g AS (SELECT paper, count(*) AS n FROM j GROUP BY paper HAVING count(*) >= 3)
"""


@_query(_REFS + "SELECT j.paper, CAST(j.pos AS INT) AS pos, j.ref, j.title, j.abstract FROM j JOIN g USING (paper)")
def resolve_references(spark, sf_dir):
    rows = _references(spark, sf_dir, 3)
    return rows.select("paper", F.explode("refs").alias("r")).select("paper", F.col("r.pos").cast("int").alias("pos"), F.col("r.id").alias("ref"), "r.title", "r.abstract")


@_query(_REFS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY pos, ref, title, abstract, year) AS i FROM j JOIN g USING (paper))
SELECT paper, string_agg('[' || i || '] ' || title || ' (' || year || ')' || chr(10) || 'Abstract: ' || abstract, chr(10) || chr(10) ORDER BY i) FILTER (i <= 4) AS ref_block,
    'Below are ' || least(4, max(n)) || ' entries.' AS prompt FROM k GROUP BY paper""")
def prompt_records(spark, sf_dir):
    rows = _references(spark, sf_dir, 3)
    head = prompts.fill("Below are {n} entries.", n=F.least(F.size("refs"), F.lit(4)))
    return rows.select("paper", prompts.reference_block(F.col("refs"), 4).alias("ref_block"), head.alias("prompt"))


@_query(_REFS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY pos, ref, title, abstract, year) AS i FROM j JOIN g USING (paper)),
o AS (SELECT paper, ref, pos, CASE WHEN i <= 2 THEN 0 ELSE 1 END AS grp, CASE WHEN i <= 2 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE md5('42|' || ref) END AS o FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY grp, o, pos, ref) AS place FROM o)
SELECT paper, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY place) AS refs FROM r WHERE place <= 4 GROUP BY paper""")
def pinned_references(spark, sf_dir):
    rows = _references(spark, sf_dir, 3)
    chosen = relational.pinned(F.col("refs"), 2, 4)
    return rows.select("paper", F.array_join(F.transform(chosen, lambda r: r["id"].cast("string")), ",").alias("refs"))


@_query(_REFS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY pos, ref, title, abstract, year) AS i FROM j JOIN g USING (paper))
SELECT paper, string_agg('[' || i || '] ' || title || ' (' || year || ')' || chr(10) || 'Abstract: ' || abstract, chr(10) || chr(10) ORDER BY i) FILTER (i <= 40) AS ref_block,
    'Below are ' || least(40, max(n)) || ' entries.' AS prompt FROM k GROUP BY paper""")
def prompt_records_40(spark, sf_dir):
    """prompt_records with the survey's limit of 40 references."""
    rows = _references(spark, sf_dir, 3)
    head = prompts.fill("Below are {n} entries.", n=F.least(F.size("refs"), F.lit(40)))
    return rows.select("paper", prompts.reference_block(F.col("refs"), 40).alias("ref_block"), head.alias("prompt"))


@_query(_REFS + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY pos, ref, title, abstract, year) AS i FROM j JOIN g USING (paper)),
o AS (SELECT paper, ref, pos, CASE WHEN i <= 2 THEN 0 ELSE 1 END AS grp, CASE WHEN i <= 2 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE md5('42|' || ref) END AS o FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY grp, o, pos, ref) AS place FROM o)
SELECT paper, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY place) AS refs FROM r WHERE place <= 40 GROUP BY paper""")
def pinned_references_40(spark, sf_dir):
    """pinned_references with the survey's limit of 40 references."""
    chosen = relational.pinned(F.col("refs"), 2, 40)
    return _references(spark, sf_dir, 3).select("paper", F.array_join(F.transform(chosen, lambda r: r["id"].cast("string")), ",").alias("refs"))


@_query("""
WITH s AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
r AS (SELECT o_custkey AS id, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey)
SELECT id, id AS ord, 0 AS part FROM s UNION ALL SELECT id, ord, 1 FROM r WHERE id NOT IN (SELECT id FROM s)""")
def ordered_union(spark, sf_dir):
    seeds = _t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    return relational.ordered_union(seeds, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord")))


@_query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)""")
def pending_rows(spark, sf_dir):
    done = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return relational.pending(_t(spark, sf_dir, "documents"), "doc_id", _t(spark, sf_dir, "labels"), done).select("doc_id", "source")


@_query("""SELECT key, arg_min(value, seq) AS value FROM (SELECT md5(text) AS key, source AS value, doc_id AS seq FROM documents) GROUP BY key""")
def cache_first_write(spark, sf_dir):
    return tables.first_writes(_t(spark, sf_dir, "documents").select(F.md5("text").alias("key"), F.col("source").alias("value"), F.col("doc_id").alias("seq")))


@_query("""
WITH u AS (SELECT 0 AS s, doc_id, source FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id, source FROM documents WHERE lang <> 'de')
SELECT doc_id, source FROM u WHERE doc_id = (SELECT max(doc_id) FROM labels) ORDER BY s LIMIT 1""")
def split_lookup(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    last = _t(spark, sf_dir, "labels").agg(F.max("doc_id")).first()[0]
    return tables.lookup("doc_id", last, docs.filter("lang = 'de'"), docs.filter("lang <> 'de'")).select("doc_id", "source")


@_query("""SELECT page_id, CASE WHEN regexp_matches(id, '^\\d{4}\\.\\d+') THEN 2000 + CAST(substr(id, 1, 2) AS INT) END AS year,
    CASE WHEN regexp_matches(id, '^\\d{4}\\.\\d+') THEN CAST(substr(id, 3, 2) AS INT) END AS month, replace(id, '/', '__') AS folder
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'math/' || page_id ELSE lpad(CAST(2001 + page_id % 300 AS VARCHAR), 4, '0') || '.' || page_id END AS id FROM pages)""".replace("\\\\", "\\"))
def paper_folders(spark, sf_dir):
    other = F.concat(F.lpad((2001 + F.col("page_id") % 300).cast("string"), 4, "0"), F.lit("."), F.col("page_id").cast("string"))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("math/"), F.col("page_id").cast("string"))).otherwise(other).alias("id"))
    year, month, folder = tables.folder_of(F.col("id"))
    return rows.select("page_id", year.alias("year"), month.alias("month"), folder.alias("folder"))


@_query("""SELECT doc_id, md5('7|' || doc_id) AS place FROM documents""")
def seeded_shuffle(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", prompts.seeded_order(F.col("doc_id"), 7).alias("place"))


@_query("""SELECT doc_id, lang, md5('7|' || doc_id) AS place FROM documents""")
def seeded_shuffle_splits(spark, sf_dir):
    """seeded_shuffle for every document, lang being the split to shuffle within."""
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", prompts.seeded_order(F.col("doc_id"), 7).alias("place"))


@_query("""SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS place FROM documents""")
def seeded_places(spark, sf_dir):
    """A shuffled order as numbers from 0, for all rows."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", prompts.seeded_order(F.col("doc_id"), 7).alias("key"))
    return places.dense_places(rows, "key", "doc_id").select("doc_id", "place")


@_query("""SELECT doc_id, 'See "' || lang || '" {n} ' || source || ': ' || coalesce(text, '') || ' {source}' AS prompt FROM documents""")
def filled_templates(spark, sf_dir):
    """Places are filled once, whatever braces the values have."""
    head = prompts.fill('See "{lang}" {{n}} {source}: {text} {{source}}', lang=F.col("lang"), source=F.col("source"), text=F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", head.alias("prompt"))


# --- Text shaping ----------------------------------------------------------------------------------


@_query("""
WITH c AS (SELECT md5(text) AS k, min('cached ' || item_id) AS v FROM benchmark GROUP BY 1)
SELECT doc_id, CASE WHEN b = '' THEN '(no abstract available)' WHEN length(b) <= 400 THEN b ELSE coalesce(v, substr(b, 1, 397) || '...') END AS short
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS b FROM documents) LEFT JOIN c ON k = md5(b)""".replace("\\\\", "\\"))
def short_texts(spark, sf_dir):
    cache = _t(spark, sf_dir, "benchmark").groupBy(F.md5("text").alias("key")).agg(F.min(F.concat(F.lit("cached "), F.col("item_id").cast("string"))).alias("value"))
    rows = _texts(spark, sf_dir, "doc_id", "text").join(cache, F.md5(X.strip(F.coalesce("text", F.lit("")))) == F.col("key"), "left")
    return rows.select("doc_id", X.short_text(F.col("text"), F.col("value")).alias("short"))


@_query(r"""
WITH b AS (SELECT page_id, html, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS inner_text, regexp_matches(html, '(?s)<p>(.*?)</p>') AS has FROM pages)
SELECT page_id, CASE WHEN has THEN regexp_replace(regexp_replace(inner_text, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE html END AS body,
    (CAST(contains(html, '<html>') AS INT) + CAST(contains(html, '<p>') AS INT) + CAST(contains(html, '<h1>') AS INT) + CAST(contains(html, '<table>') AS INT)) / 4.0 AS tag_share FROM b""")
def page_blocks(spark, sf_dir):
    html = F.col("html")
    return _t(spark, sf_dir, "pages").select("page_id", X.block(html, "p").alias("body"), X.tag_share(html, ("<html>", "<p>", "<h1>", "<table>")).alias("tag_share"))


@_query(r"""
SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') - 1) || '[mark]' || substr(text, instr(text, '. ')) ELSE regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || '[mark]' END AS marked,
    md5(regexp_replace(regexp_replace('2024. , ' || text, '^\s*\d{4}\s*\.\s*', ''), '^[\s.,;:]+', '')) AS title FROM documents""")
def marked_texts(spark, sf_dir):
    head = F.concat(F.lit("2024. , "), F.col("text"))
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", X.insert_before(F.col("text"), ". ", F.lit("[mark]")).alias("marked"), F.md5(X.clean_title(head)).alias("title"))


def _tex(spark, sf_dir):
    """Documents as LaTeX sources: their lines become sections, words after commas become commands."""
    body = F.regexp_replace("text", r"\n", "\n\\\\section{Method \\\\textbf{notes}}\n")
    body = F.regexp_replace(body, r", (\w+)", r" \\\\cite{$1} \\\\emph{\\\\textbf{$1}}, $1~x")
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.concat(F.lit("\\begin{abstract}\n"), body, F.lit(" % note\n\\end{abstract}\n")).alias("tex"))


@_query()
def latex_sections(spark, sf_dir):
    rows = _tex(spark, sf_dir).select("doc_id", F.explode(latex.sections(F.col("tex"), F.lit("main.tex"))).alias("s"))
    return rows.select("doc_id", "s.heading", "s.kind", "s.order", F.md5("s.text").alias("digest"), F.length("s.text").alias("chars"))


@_query()
def latex_selection(spark, sf_dir):
    kept = latex.selected(latex.sections(F.col("tex"), F.lit("main.tex")), 24_000)
    return _tex(spark, sf_dir).select("doc_id", kept.alias("kept")).select("doc_id", F.size("kept").alias("n"), F.aggregate("kept", F.lit(0), lambda s, x: s + F.length(x["text"])).alias("chars"))


_TAGS = "".join(f"<{t}></{t}>" for t in X.REQUIRED_TAGS)


@_query(rf"""
WITH d AS (SELECT doc_id, lang, text, CASE WHEN lang = 'fr' THEN text ELSE '<problem></problem>' || text END AS body FROM documents)
SELECT doc_id, len(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')) AS word_count, lang = 'fr' AS has_all_tags,
    regexp_matches(lower(body), 'implement|train|dataset|algorithm|baseline|metric') AS implementation, regexp_matches(lower(body), 'evaluate|baseline|ablation|metric|benchmark') AS evaluation FROM d""")
def text_quality(spark, sf_dir):
    """French documents as answers with all required tags, others with one of them and no block."""
    text = F.when(F.col("lang") == "fr", F.concat(F.lit(_TAGS + "<proposal>"), F.col("text"), F.lit("</proposal>"))).otherwise(F.concat(F.lit("<problem></problem>"), F.col("text")))
    return _texts(spark, sf_dir, "doc_id", "lang", "text").select("doc_id", X.quality(text).alias("q")).select("doc_id", "q.*")


@_query("""
SELECT conv_id, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS messages, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.md5("text").alias("digest")).alias("m"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    answers = F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("long")
    return rows.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["digest"])), ",").alias("messages"), answers.alias("answers"))


@_query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS place, turn, role, md5(text) AS digest FROM conversations""")
def chat_message_rows(spark, sf_dir):
    """The messages of chat_messages as rows, for conversations beyond one row: a task sorts each conversation's digests, on disk if need be."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "digest"))
    return rows.select("conv_id", place.cast("long").alias("place"), "turn", "role", "digest")


@_query("""SELECT 'system' AS role1, lang AS content1, 'user' AS role2, md5(text) AS content2, 'assistant' AS role3, source AS content3, doc_id
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1""")
def chat_export(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("lang").alias("system"), F.md5("text").alias("prompt"), F.concat_ws("|", "source", F.col("doc_id").cast("string")).alias("target"), (F.col("toxic") == 1).alias("flagged"))
    m = tables.chat_export(rows).select(*(F.col("messages")[i].alias(f"m{i + 1}") for i in range(3)))
    shaped = [F.col(f"m{i}.role").alias(f"role{i}") for i in (1, 2, 3)] + [F.col("m1.content").alias("content1"), F.col("m2.content").alias("content2")]
    return m.select(*shaped, F.substring_index("m3.content", "|", 1).alias("content3"), F.substring_index("m3.content", "|", -1).cast("long").alias("doc_id"))


@_query("""SELECT md5(text) AS prompt, lang AS data_source, source AS ground_truth, CAST(doc_id AS VARCHAR) AS arxiv_id FROM documents""")
def retrieval_export(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.md5("text").alias("prompt"), F.col("lang").alias("data_source"), F.col("source").alias("abstract"), F.col("doc_id").cast("string").alias("arxiv_id"))
    return tables.retrieval_export(rows).select("prompt", "data_source", "reward_model.ground_truth", "arxiv_id")


@_query(r"""
WITH n AS (SELECT event_id, list_filter(list_transform(regexp_extract_all(props, '\d+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x >= 1 AND x <= 50) AS v, regexp_extract(props, '(\d+)', 1) AS f FROM events)
SELECT event_id, CASE WHEN len(v) > 0 THEN array_to_string(list_transform(v[1:3], lambda x: x - 1), ',') ELSE '0,1,2' END AS picks, least(coalesce(TRY_CAST(f AS DOUBLE), 0.0), 10.0) / 10 AS score FROM n""")
def parsed_choices(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", F.array_join(X.index_list(F.col("props"), F.lit(50), 3).cast("array<string>"), ",").alias("picks"), X.tenth_score(F.col("props")).alias("score"))


# --- Runs ------------------------------------------------------------------------------------------


@_query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_runs(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.latest(rows, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@_query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'purchase', event_id DESC) AS k FROM events) WHERE k = 1""")
def best_targets(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return relational.best_row(rows, ["user_id"], F.col("event_type") != "purchase", -F.col("event_id")).select("user_id", "event_id", "event_type")


def _states(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("event_type") != "error").alias("done"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("passed"),
        F.round(F.avg("value"), 4).alias("mean_value"),
    )


_STATES = """
WITH s AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS errors,
    count(*) FILTER (event_type = 'purchase') AS passed, round(avg(value), 4) AS mean_value FROM events GROUP BY user_id)
"""


def _pass_sql(k: int) -> str:
    product = " * ".join(f"CAST(done - passed - {i} AS DOUBLE) / (done - {i})" for i in range(k))
    return f"CASE WHEN done < {k} THEN CAST('nan' AS DOUBLE) WHEN done - passed < {k} THEN 1.0 ELSE round(1 - {product}, 9) END AS pass_at_{k}"


@_query(_STATES + f"SELECT *, CASE WHEN done > 0 THEN passed / CAST(done AS DOUBLE) ELSE 0.0 END AS pass_rate, {_pass_sql(1)}, {_pass_sql(3)}, {_pass_sql(5)} FROM s")
def run_states(spark, sf_dir):
    rows = _states(spark, sf_dir)
    rate = F.coalesce(F.try_divide("passed", "done"), F.lit(0.0)).alias("pass_rate")
    return rows.select("*", rate, *(F.round(scoring.pass_at_k(F.col("done"), F.col("passed"), k), 9).alias(f"pass_at_{k}") for k in (1, 3, 5)))


@_query("""
WITH c AS (SELECT user_id % 10 AS label, event_type, count(*) FILTER (value > 50) || '/' || count(*) AS cell FROM events GROUP BY 1, 2)
SELECT label, max(cell) FILTER (event_type = 'purchase') AS purchase, max(cell) FILTER (event_type = 'error') AS error, max(cell) FILTER (event_type = 'signup') AS signup,
    max(cell) FILTER (event_type = 'view') AS view, max(cell) FILTER (event_type = 'click') AS click FROM c GROUP BY label""")
def strategy_pivot(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("label", F.col("user_id") % 10)
    cell = F.concat(F.count_if(F.col("value") > 50).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
    return rows.filter(F.col("event_type").isNotNull()).groupBy("label").pivot("event_type", ["purchase", "error", "signup", "view", "click"]).agg(cell)


@_query("""
SELECT user_id % 10 AS label, event_type, count(*) FILTER (value > 50) || '/' || count(*) AS cell FROM events GROUP BY 1, 2""")
def strategy_cells(spark, sf_dir):
    """The cells of strategy_pivot for every event type, in long form."""
    cell = F.concat(F.count_if(F.col("value") > 50).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
    return _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("label"), "event_type").agg(cell.alias("cell"))


@_query("""
WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'view' AND value IS NOT NULL),
m AS (SELECT user_id, avg(value) AS v FROM k WHERE n <= 5 GROUP BY user_id)
SELECT u.user_id, round(coalesce(v, 9999.0), 6) AS tail_mean FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id)""")
def tail_means(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return relational.tail_mean(rows, ["user_id"], "v", F.col("event_id"), 5, 9999.0).withColumn("tail_mean", F.round("tail_mean", 6))


@_query("""
WITH m AS (SELECT user_id, avg(value) AS loss FROM events GROUP BY user_id),
t AS (SELECT *, CASE WHEN loss > 0.01 AND loss < 10 THEN 0 WHEN loss < 9999 THEN 1 ELSE 2 END AS tier FROM m)
SELECT user_id, round(loss, 6) AS loss FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY loss, user_id LIMIT 1""")
def best_setting(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("loss"))
    valid = relational.first_tier(rows, (F.col("loss") > 0.01) & (F.col("loss") < 10), F.col("loss") < 9999)
    return valid.agg(F.min(F.struct("loss", "user_id")).alias("b")).select("b.user_id", F.round("b.loss", 6).alias("loss"))


@_query("""
SELECT e.event_id, round(CASE WHEN b.base IS NULL THEN value - 0 ELSE CASE WHEN lower_better THEN base - value ELSE value - base END END, 6) AS improvement,
    CASE WHEN coalesce(lower_better, FALSE) THEN coalesce(base, 0.0) - value >= 5 ELSE value - coalesce(base, 0.0) >= 5 END AS passed
FROM events e LEFT JOIN (SELECT event_type, round(avg(value), 2) AS base, event_type = 'error' AS lower_better FROM events WHERE event_type <> 'view' GROUP BY event_type) b USING (event_type)""")
def improvements(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    base = rows.filter("event_type <> 'view'").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("base")).withColumn("lower", F.col("event_type") == "error")
    gain = scoring.improvement(F.col("value"), F.coalesce("base", F.lit(0.0)), F.coalesce("lower", F.lit(False)))
    return rows.join(base, "event_type", "left").select("event_id", F.round(gain, 6).alias("improvement"), (gain >= 5).alias("passed"))


@_query("""
WITH x AS (SELECT event_id, event_type AS mode, (event_id % 6) / 5.0 AS form, value / 100 AS s FROM events)
SELECT event_id, round(CASE WHEN mode = 'purchase' THEN 0.8 * s + 0.2 * form
    WHEN mode = 'click' THEN 0.6 * s * 0.9 + 0.2 * form + 0.2 * CASE WHEN s <= 0.8 THEN 1.0 ELSE greatest(0.0, 1 - 5 * (s - 0.8)) END
    WHEN mode = 'view' THEN 0.8 * least(1.0, greatest(0.0, exp(-1.5 * s / 3.0))) + 0.2 * form ELSE form END, 6) AS reward FROM x""")
def rewards(spark, sf_dir):
    mode = F.when(F.col("event_type") == "purchase", "prs").when(F.col("event_type") == "click", "fas").when(F.col("event_type") == "view", "ppl").otherwise("none")
    s, form = F.col("value") / 100, (F.col("event_id") % 6) / F.lit(5.0)
    score = scoring.composite(mode, form, s, s * 0.9, s, scoring.predictability(F.array(-s, -2 * s)))
    return _t(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("reward"))


#: Log lines of every form: nested JSON, JSON with an apostrophe, console pairs, dict literals with and without a reward.
_LINES = (
    '{"critic/rewards/mean": @v, "reward": 7}', "step:@n - critic/rewards/mean:@v - x:1", "\x1b[32m 5% | @n/99 [00:01] {'loss': @v, 'grad': nan, 'lr': None}\r", '{"a": {"x": 1}, "reward": @v}',
    '{"msg": "it\'s", "reward": @v}', "step:3 {'reward': @v, 'done': True}", '{"loss": @v, "reward": 1}', "out {'train_loss': @v, 'reward': 2, 'ok': False}", "nothing here",
)


def _log_sql() -> str:
    forms = " ".join(f"WHEN {k} THEN '{line.replace(chr(39), chr(39) * 2)}'" for k, line in enumerate(_LINES)).replace("\x1b", "' || chr(27) || '").replace("\r", "' || chr(13) || '")

    def number(source: str, key: str) -> str:
        return f"TRY_CAST(json_extract_string({source}, '$.\"{key}\"') AS DOUBLE)"

    def first(source: str, keys: tuple[str, ...]) -> str:
        return f"coalesce({', '.join(number(source, k) for k in keys)})"

    return f"""
WITH r AS (SELECT event_id, replace(replace(CASE event_id % {len(_LINES)} {forms} END, '@v', printf('%.4f', value)), '@n', CAST(event_id AS VARCHAR)) AS raw FROM events),
l AS (SELECT event_id, regexp_replace(raw, chr(27) || '\\[[0-9;]*m|' || chr(13), '', 'g') AS line FROM r),
d AS (SELECT *, starts_with(line, '{{') AND json_valid(line) AS whole, regexp_extract(line, '(\\{{[^{{}}]+\\}})', 1) AS body FROM l),
n AS (SELECT *, replace(replace(replace(replace(replace(body, chr(39), '"'), 'None', 'null'), 'nan', 'null'), 'True', 'true'), 'False', 'false') AS fixed FROM d),
j AS (SELECT *, CASE WHEN json_valid(fixed) THEN fixed END AS dict FROM n)
SELECT event_id, round(CASE WHEN whole THEN {first('line', runs.REWARD_KEYS)} WHEN contains(line, 'step:') AND contains(line, 'critic/rewards/mean:') THEN TRY_CAST(regexp_extract(line, 'critic/rewards/mean:([-0-9.eE+]+)', 1) AS DOUBLE)
    ELSE {first('dict', runs.REWARD_KEYS)} END, 4) AS reward,
    round(CASE WHEN whole THEN {first('line', runs.LOSS_KEYS)} WHEN json_extract_string(dict, '$.reward') IS NULL THEN {first('dict', runs.LOSS_KEYS)} END, 4) AS loss,
    TRY_CAST(regexp_extract(line, '\\|\\s*([0-9]+)/[0-9]+', 1) AS INT) AS step FROM j"""


@_query(_log_sql())
def log_metrics(spark, sf_dir):
    v, n = F.format_string("%.4f", F.col("value")), F.col("event_id").cast("string")
    form = F.element_at(F.array(*map(F.lit, _LINES)), (F.col("event_id") % len(_LINES) + 1).cast("int"))
    line = F.replace(F.replace(form, F.lit("@v"), v), F.lit("@n"), n)
    rows = tables.spread(_t(spark, sf_dir, "events")).select("event_id", runs.plain_line(line).alias("line"))
    found = rows.select("event_id", "line", runs.parsed(F.col("line")).alias("found"))
    own, line = F.col("found"), F.col("line")
    return found.select("event_id", F.round(runs.reward_in(line, own), 4).alias("reward"), F.round(runs.loss_in(own), 4).alias("loss"), runs.progress(line)["step"].alias("step"))


#: Dict literals of mixed quotes, with tuples, lists and constants; two that are none; a repeated key.
_DICTS = (
    """{'msg': "it's", 'reward': @v}""", """{'reward': @v, 'shape': (1, 2)}""", """{"reward": true}""", """out {'a': 'x, "reward": 9', 'reward': @v, 'b': [1, 'q', None]}""",
    """{'reward': @v, oops}""", """{'reward': 0.1, "reward": @v}""", """x {'reward': True, 'loss': @v}""", """{'loss': @v, 'why': 'a \\'quoted\\' word'}""", """{'reward': @v, 'b': (}""",
)


@_query("""SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 3, 5) THEN round(value, 4) WHEN event_id % 9 IN (2, 6) THEN 1.0 END AS reward, CASE WHEN event_id % 9 = 7 THEN round(value, 4) END AS loss FROM events""")
def log_dicts(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, _DICTS)), (F.col("event_id") % len(_DICTS) + 1).cast("int"))
    rows = tables.spread(_t(spark, sf_dir, "events")).select("event_id", F.replace(form, F.lit("@v"), F.format_string("%.4f", F.col("value"))).alias("line"))
    found = rows.select("event_id", "line", runs.parsed(F.col("line")).alias("found"))
    return found.select("event_id", F.round(runs.reward_in(F.col("line"), F.col("found")), 4).alias("reward"), F.round(runs.loss_in(F.col("found")), 4).alias("loss"))


@_query("""
SELECT event_id, 'exp' || event_id AS name, 'exp' || event_id || ' 04/25' AS label, CASE WHEN event_id % 2 = 0 THEN 'm' || user_id ELSE 'run' || event_id END AS model,
    CASE event_id % 3 WHEN 0 THEN 'top_k_related_work' WHEN 1 THEN 'full_refs' ELSE 'other' END AS strategy FROM events""")
def run_labels(spark, sf_dir):
    n = F.col("event_id").cast("string")
    exp = F.concat(F.lit("exp"), n, F.lit("_20260425_193356"))
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("runs/m"), F.col("user_id").cast("string"), F.lit("/rl/step_1"))).otherwise(F.lit("runs/base/step_1"))
    tag = F.when(F.col("event_id") % 3 == 0, "a_topk_rw_related_work").when(F.col("event_id") % 3 == 1, "x_full_refs").otherwise("other")
    return _t(spark, sf_dir, "events").select("event_id", runs.without_timestamp(exp).alias("name"), runs.experiment_label(exp).alias("label"), runs.model_label(path, F.concat(F.lit("run"), n)).alias("model"), runs.strategy(tag).alias("strategy"))


@_query("""
WITH a AS (SELECT 'm' || s_suppkey AS machine, unnest(range(0, s_nationkey % 8 + 1)) AS device FROM supplier)
SELECT machine, CAST(device AS INT) AS device FROM a UNION ALL SELECT 'x' || s_suppkey, unnest([1, 3]) FROM supplier""")
def device_slots(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    spec = F.concat(F.lit("m"), n, F.lit(":0-"), (F.col("s_nationkey") % 8).cast("string"), F.lit("; x"), n, F.lit(":1,3;"))
    return _t(spark, sf_dir, "supplier").select(F.explode(runs.slots(spec)).alias("s")).select("s.machine", "s.device")


def _signed_sql(key: bytes) -> str:
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"""
WITH m AS (SELECT event_id, sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode(printf('%.6f', value))))))) AS own FROM events)
SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'bad' WHEN event_id % 5 <> 1 THEN own END = own, FALSE) AS valid FROM m"""


@_query(_signed_sql(b"example-key"))
def signed_results(spark, sf_dir):
    key = b"example-key"
    made = scoring.hmac_sha256(F.regexp_replace(F.format_number("value", 6), ",", ""), key)
    rows = _t(spark, sf_dir, "events").withColumn("sig", F.when(F.col("event_id") % 5 == 0, F.lit("bad")).when(F.col("event_id") % 5 != 1, made))
    return rows.select("event_id", scoring.signed(F.col("value"), F.col("sig"), key).alias("valid"))


@_query("""
WITH p AS (SELECT user_id, max(event_id) AS step, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n > 12 THEN 'running' WHEN step % 2 = 0 THEN 'done' WHEN n > 8 THEN 'interrupted' ELSE 'pending' END AS status, (1000000 - step) * 0.5 AS eta FROM p""")
def run_status(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("step"), F.count("*").alias("n"))
    return rows.select("user_id", runs.status(F.col("n") > 12, F.col("step") % 2 == 0, F.col("n") > 8).alias("status"), runs.eta_seconds(F.col("step"), F.lit(1_000_000), F.lit(0.5)).alias("eta"))


@_query("""
SELECT user_id, event_id, ord FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN n + 1 ELSE n END AS ord, max(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS gap
    FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n FROM events)) WHERE gap = 0""")
def sample_prefix(spark, sf_dir):
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n"))
    gap = F.max((F.col("event_id") % 7 == 0).cast("long")).over(Window.partitionBy("user_id").orderBy("n"))
    rows = rows.select("user_id", "event_id", (F.col("n") + gap).alias("ord"))
    return relational.numbered_prefix(rows, "user_id", "ord")


# --- General tables --------------------------------------------------------------------------------


@_query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@_query("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, sf_dir):
    t = {n: _t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey"))
    rows = rows.join(t["nation"], F.expr("c_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def open_customers(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    every = _t(spark, sf_dir, "customer").select("c_custkey").intersect(orders.select("o_custkey"))
    return every.subtract(orders.filter("o_orderstatus = 'F'").select("o_custkey"))
