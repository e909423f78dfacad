"""Further registered queries: selections and reports over runs, records and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, runs, scoring
from ..functions import text as X
from ..operators import hooks, relational, upkeep, vector
from ..sources import tables
from .catalog import _TOPK, ORACLES, QUERIES, _query, _t, _texts

__all__ = ["ORACLES", "QUERIES"]

# --- Runs: events stand for runs and their samples ---------------------------------------------------


def _named(spark, sf_dir):
    """Events as runs: label with a timestamp, strategy, number of proposals, path."""
    rows = _t(spark, sf_dir, "events")
    stamp = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_000000"))
    return rows.select(
        "event_id", "user_id", "event_type", "value", stamp.alias("stamp"),
        F.concat(F.lit("exp"), (F.col("user_id") % 50).cast("string"), F.lit("_"), stamp).alias("label"),
        F.col("event_type").alias("strategy"), (F.col("event_id") % 3).alias("n_proposals"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("path"),
    )


_NAMED = """
WITH n AS (SELECT event_id, user_id, event_type, value, strftime(ts, '%Y%m%d') || '_000000' AS stamp, 'exp' || (user_id % 50) || '_' || strftime(ts, '%Y%m%d') || '_000000' AS label,
    event_type AS strategy, event_id % 3 AS n_proposals, lpad(CAST(event_id AS VARCHAR), 9, '0') AS path FROM events)
"""


@_query(_NAMED + """SELECT base, strategy, stamp, n_proposals, path FROM (SELECT *, regexp_replace(label, '_[0-9]{8}_[0-9]{6}', '', 'g') AS base,
    row_number() OVER (PARTITION BY regexp_replace(label, '_[0-9]{8}_[0-9]{6}', '', 'g'), strategy ORDER BY stamp DESC, n_proposals DESC, path) AS k FROM n) WHERE k = 1""")
def latest_summaries(spark, sf_dir):
    return relational.latest_summaries(_named(spark, sf_dir).drop("stamp")).select("base", "strategy", "stamp", "n_proposals", "path")


@_query(_NAMED + """, c AS (SELECT 'run ' || user_id AS name, 'exp' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '_' || stamp || '/rl/' || path AS path, stamp, event_type <> 'error' AS usable FROM n)
SELECT experiment, name, path FROM (SELECT regexp_extract(path, '(exp[0-9]{2})', 1) AS experiment, *, row_number() OVER (PARTITION BY regexp_extract(path, '(exp[0-9]{2})', 1) ORDER BY stamp DESC, path DESC) AS k
    FROM c WHERE usable) WHERE k = 1""")
def latest_checkpoints(spark, sf_dir):
    path = F.concat(F.lit("exp"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("_"), F.col("stamp"), F.lit("/rl/"), F.col("path"))
    rows = _named(spark, sf_dir).select(F.concat(F.lit("run "), F.col("user_id").cast("string")).alias("name"), path.alias("path"), (F.col("event_type") != "error").alias("usable"))
    return relational.latest_checkpoints(rows).select("experiment", "name", "path")


@_query(_NAMED + """, c AS (SELECT 'exp' || (user_id % 40) || '_' || event_type AS name, path, event_id % 1000 AS mtime FROM n),
p AS (SELECT unnest(['exp1', 'purchase', 'p3_', 'nowhere']) AS prefix)
SELECT prefix, name, path, mtime, tier FROM (SELECT *, CASE WHEN starts_with(name, prefix) THEN 0 ELSE 1 END AS tier,
    row_number() OVER (PARTITION BY prefix ORDER BY CASE WHEN starts_with(name, prefix) THEN 0 ELSE 1 END, mtime DESC, path) AS k FROM c JOIN p ON contains(name, prefix)) WHERE k = 1""")
def newest_checkpoints(spark, sf_dir):
    name = F.concat(F.lit("exp"), (F.col("user_id") % 40).cast("string"), F.lit("_"), F.col("event_type"))
    return relational.newest_matching(_named(spark, sf_dir).select(name.alias("name"), "path", (F.col("event_id") % 1000).alias("mtime")), ["exp1", "purchase", "p3_", "nowhere"])


@_query(_NAMED + """, f AS (SELECT 'exp_' || event_type || (user_id % 30) AS base, path, event_id AS mtime FROM n WHERE event_type <> 'purchase')
SELECT label, path, 0 AS part FROM n WHERE event_type = 'purchase'
UNION ALL SELECT base, path, 1 FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY mtime DESC, path) AS k FROM f) WHERE k = 1""")
def experiment_list(spark, sf_dir):
    rows = _named(spark, sf_dir)
    name = F.concat(F.lit("exp_"), F.col("event_type"), (F.col("user_id") % 30).cast("string"), F.lit("_"), F.col("stamp"))
    return relational.experiments(rows.filter("event_type = 'purchase'").select("label", "path"), rows.select(name.alias("name"), "path", F.col("event_id").alias("mtime")))


@_query(_NAMED + """SELECT 'r' || event_id AS run_id, path AS run_dir, strategy AS task, '' AS subtask, n_proposals AS n_samples,
    CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'hosted' ELSE 'api' END WHEN user_id % 3 = 0 THEN 'm' || user_id WHEN user_id % 3 = 1 THEN '' ELSE 'r' || event_id END AS model_label
FROM n WHERE event_type <> 'purchase'""")
def registry_backfill(spark, sf_dir):
    """Runs that are not registered, as registry rows; purchases stand for what is registered."""
    n = F.col("user_id")
    checkpoint = F.when(n % 3 == 0, F.concat(F.lit("runs/m"), n.cast("string"), F.lit("/rl/final"))).when(n % 3 == 1, F.lit("runs/base/final"))
    configs = _named(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"), F.col("path").alias("run_dir"), F.col("strategy").alias("task_name"), F.lit(None).cast("string").alias("subtask"), checkpoint.alias("checkpoint"),
        (F.col("event_type") == "click").alias("is_api"), F.when(n % 2 == 0, "hosted").alias("api_model"), F.col("n_proposals").alias("n_samples"), F.col("stamp").alias("started_at"), F.lit("").alias("strategy"), "event_type",
    )
    return tables.backfilled(configs.filter("event_type = 'purchase'").select("run_id"), configs).select("run_id", "run_dir", "task", "subtask", "n_samples", "model_label")


_SAMPLES = """
WITH s AS (SELECT user_id % 10 AS label, 's' || (event_id % 5) AS strategy, event_type NOT IN ('error', 'view') AS done, event_type = 'error' AS failed, value - 50 AS gain FROM events),
c AS (SELECT label, strategy, count(*) FILTER (done) AS d, count(*) FILTER (done AND gain > 0) AS p, count(*) FILTER (failed) AS e, avg(gain) FILTER (done) AS m FROM s GROUP BY ALL),
t AS (SELECT label, strategy, CASE WHEN d > 0 THEN p || '/' || d || ' (' || CASE WHEN m >= 0 THEN '+' ELSE '' END || printf('%.2f', m) || '%)' ELSE '0/0 (' || e || ' err)' END AS cell FROM c)
"""


@_query(_SAMPLES + "SELECT label, " + ", ".join(f"max(cell) FILTER (strategy = 's{k}') AS s{k}" for k in range(5)) + " FROM t GROUP BY label")
def sweep_pivot(spark, sf_dir):
    """A cell of passed, done, mean gain and errors for each label and strategy."""
    rows = _t(spark, sf_dir, "events").withColumns({"label": F.col("user_id") % 10, "strategy": F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")), "gain": F.col("value") - 50})
    done = ~F.col("event_type").isin("error", "view")
    cell = relational.cell_text(F.count_if(done), F.count_if(done & (F.col("gain") > 0)), F.count_if(F.col("event_type") == "error"), F.avg(F.when(done, F.col("gain"))))
    return rows.groupBy("label").pivot("strategy", [f"s{k}" for k in range(5)]).agg(cell)


@_query("""
WITH l AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT count(*) AS cells, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 50) AS passed,
    count(*) FILTER (event_type NOT IN ('purchase', 'error', 'signup')) AS running FROM l""")
def status_totals(spark, sf_dir):
    rows = relational.latest(_t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    kind = F.col("event_type")
    return rows.agg(F.count("*").alias("cells"), F.count_if(kind == "purchase").alias("done"), F.count_if(kind == "error").alias("errors"), F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("passed"), F.count_if(~kind.isin("purchase", "error", "signup")).alias("running"))


@_query("""
WITH l AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'exp' || user_id ELSE event_type END AS label FROM events)
SELECT label, NOT regexp_matches(label, '^exp[0-9]+') AS other, coalesce(TRY_CAST(regexp_extract(label, '^exp([0-9]+)', 1) AS INT), 0) AS number FROM l""")
def model_labels(spark, sf_dir):
    """Distinct labels with the key they are sorted by."""
    label = F.when(F.col("event_type") == "view", F.concat(F.lit("exp"), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    return _t(spark, sf_dir, "events").select(label.alias("label")).distinct().select("label", runs.model_order(F.col("label")).alias("o")).select("label", "o.other", "o.number")


@_query("""
WITH g AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id)
SELECT (SELECT user_id FROM g ORDER BY m DESC, user_id LIMIT 1) AS best, (SELECT user_id FROM g ORDER BY n DESC, user_id LIMIT 1) AS longest""")
def best_runs(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return rows.agg(F.max_by("user_id", F.struct("m", -F.col("user_id"))).alias("best"), F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("longest"))


@_query("""
WITH s AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'generating' ELSE 'done' END AS step, 'run_' || user_id || '_x' AS name FROM events)
SELECT event_id, step FROM s WHERE step IN ('error', 'generating') AND starts_with(name, 'run_1') AND contains(name, '2')""")
def relaunch_rows(spark, sf_dir):
    step = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "generating").otherwise("done")
    rows = _t(spark, sf_dir, "events").select("event_id", step.alias("step"), F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_x")).alias("name"))
    return relational.to_relaunch(relational.matching_runs(rows, "name", "run_1", "2"), stuck=True).select("event_id", "step")


@_query("""
SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_totalprice > 100000) AS n_passed, count(*) FILTER (o_orderstatus = 'P') AS n_errors
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def run_samples(spark, sf_dir):
    step = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").otherwise("worker")
    samples = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), step.alias("step"), (F.col("o_totalprice") > 100000).alias("passed"))
    return relational.with_samples(_t(spark, sf_dir, "customer").select("c_custkey"), samples, "c_custkey")


@_query("SELECT s_suppkey, CAST(d AS INT) AS device FROM supplier, (SELECT unnest(range(0, 8)) AS d)")
def machine_slots(spark, sf_dir):
    return relational.grid(_t(spark, sf_dir, "supplier").select("s_suppkey"), "device", list(range(8)))


@_query("SELECT user_id, event_id, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def last_lines(spark, sf_dir):
    return tables.last_lines(_t(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("value")), 3, "user_id", "event_id")


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1 OFFSET 17")
def row_by_ordinal(spark, sf_dir):
    return relational.row_at(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 17, F.desc("c_acctbal"), F.asc("c_custkey"))


@_query("""
SELECT c_custkey, round(m, 4) AS mean_price FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey
ORDER BY m DESC NULLS LAST, c_custkey LIMIT 100""")
def ranked_report(spark, sf_dir):
    """A top-100 report."""
    means = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey").join(means, "c_custkey", "left")
    return relational.nulls_last(rows, "m", "c_custkey").limit(100).select("c_custkey", F.round("m", 4).alias("mean_price"))


# --- Records -----------------------------------------------------------------------------------------


@_query("""
SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'toxic' ELSE source END AS source, quality FROM documents LEFT JOIN labels USING (doc_id)""")
def overlaid_records(spark, sf_dir):
    cached = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("source"), "quality")
    return relational.overlaid(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), cached, "doc_id", ["source", "quality"])


@_query("""
WITH f AS (SELECT o_custkey AS k, round(min(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(min(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p, round(min(o_totalprice), 2) AS a FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(f, p, a) AS price, CASE WHEN f IS NOT NULL THEN 0 WHEN p IS NOT NULL THEN 1 WHEN a IS NOT NULL THEN 2 END AS source FROM customer LEFT JOIN f ON k = c_custkey""")
def first_source(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = [rows.groupBy("c_custkey").agg(F.round(F.min("o_totalprice"), 2).alias("price")) for rows in (orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'P'"), orders)]
    return relational.first_found(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "price", *found)


@_query("SELECT doc_id AS id, lang, source, NULL AS year FROM documents UNION ALL SELECT item_id, NULL, NULL, NULL FROM benchmark")
def aligned_records(spark, sf_dir):
    columns = {"id": "long", "lang": "string", "source": "string", "year": "int"}
    return relational.aligned(_t(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), columns).unionByName(relational.aligned(_t(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), columns))


_REFERENCES = """
WITH r AS (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, year(l_shipdate)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS title, year(l_shipdate) AS y FROM lineitem)
"""


@_query(_REFERENCES + """SELECT paper, string_agg('[' || i || '] ' || title || ' (' || y || ')', chr(10) ORDER BY i) FILTER (i <= 3) || CASE WHEN max(n) > 3 THEN chr(10) || '... and ' || (max(n) - 3) || ' more' ELSE '' END AS preview
FROM r GROUP BY paper""")
def reference_previews(spark, sf_dir):
    ref = F.struct(F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("title"), F.year("l_shipdate").alias("year"))
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    return rows.select("paper", prompts.preview(F.col("refs"), 3).alias("preview"))


@_query(r"""
WITH s AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '[.] ')) AS x, generate_subscripts(regexp_split_to_array(text, '[.] '), 1) AS p FROM conversations),
c AS (SELECT conv_id AS trace, turn, p, md5(x) AS name FROM s WHERE role = 'assistant' AND length(x) % 2 = 0)
SELECT trace, turn AS ord, CAST(p - 1 AS INT) AS place, name, CAST(row_number() OVER (PARTITION BY trace ORDER BY turn, p) AS INT) AS step FROM c""")
def tool_steps(spark, sf_dir):
    """Sentences of even length stand for tool calls."""
    kind = F.transform(F.split("text", "[.] "), lambda x: F.struct(F.when(F.length(x) % 2 == 0, "tool_use").otherwise("text").alias("type"), F.md5(x).alias("name")))
    return relational.step_numbers(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("ord"), F.col("role").alias("type"), kind.alias("content")))


@_query("""
WITH x AS (SELECT event_id, event_type AS mode, (event_id % 6) / 5.0 AS form, value / 100 AS s FROM events)
SELECT event_id, round(CASE WHEN mode = 'purchase' THEN 0.8 * s + 0.2 * form
    WHEN mode = 'click' THEN 0.6 * s * 0.9 + 0.2 * form + 0.2 * CASE WHEN s <= 0.8 THEN 1.0 ELSE greatest(0.0, 1 - 5 * (s - 0.8)) END
    WHEN mode = 'view' THEN 0.8 * least(1.0, greatest(0.0, exp(-1.5 * s / 3.0))) + 0.2 * form ELSE form END, 6) AS score,
    round(CASE WHEN mode = 'click' THEN CASE WHEN s <= 0.8 THEN 1.0 ELSE greatest(0.0, 1 - 5 * (s - 0.8)) END END, 6) AS antileak FROM x""")
def scored_table(spark, sf_dir):
    """The rewards by the table function of SQL, a call for each mode."""
    s = F.col("value") / 100
    rows = _t(spark, sf_dir, "events").select(
        "event_id", "event_type", ((F.col("event_id") % 6) / F.lit(5.0)).alias("form"), s.alias("similarity"), (s * 0.9).alias("retrieval"), s.alias("overlap"), F.array(-s, -2 * s).alias("logprobs")
    )
    hooks.register(spark)
    modes = {"purchase": "prs", "click": "fas", "view": "ppl"}
    kind = F.col("event_type")
    asked = [(m, rows.filter(kind == t)) for t, m in modes.items()] + [("none", rows.filter(~kind.isin(*modes)))]
    out = [spark.sql(f"SELECT * FROM score(TABLE({{t}}), '{m}')", t=t) for m, t in asked]
    score = out[1].select("event_id", "score", "antileak")
    for df in (out[0], out[2], out[3]):
        score = score.unionByName(df.select("event_id", "score"), allowMissingColumns=True)
    return score.select("event_id", F.round("score", 6).alias("score"), F.round("antileak", 6).alias("antileak"))


@_query("""
WITH e AS (SELECT l_orderkey AS paper, l_partkey AS ref, l_linenumber AS pos, CASE WHEN l_returnflag <> 'R' THEN l_returnflag || ' ' || l_linestatus END AS own FROM lineitem WHERE l_linenumber <> 5 OR l_quantity > 10),
j AS (SELECT paper, ref, pos, coalesce(p_type, own) AS abstract FROM e LEFT JOIN (SELECT * FROM part WHERE p_size > 25 AND p_size <> 30) ON p_partkey = ref WHERE coalesce(p_type, own, '') <> '')
SELECT paper, CAST(pos AS INT) AS pos, ref, abstract FROM j JOIN (SELECT paper FROM j GROUP BY paper HAVING count(*) >= 3) USING (paper)""")
def refreshed_references(spark, sf_dir):
    """References after parts of one size and some lines are gone and others are new: the keys that this touches are resolved again."""
    lines, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    own = F.when(F.col("l_returnflag") != "R", F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    fields = [F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("ref"), F.col("l_linenumber").alias("pos"), F.lit("edge").alias("title"), own.alias("abstract"), F.year("l_shipdate").alias("year")]
    store = [F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_size").alias("year")]
    edges, now_edges = lines.filter("l_linenumber <> 6 OR l_quantity > 10").select(*fields), lines.filter("l_linenumber <> 5 OR l_quantity > 10").select(*fields)
    papers, now_papers = part.filter("p_size > 26").select(*store), part.filter("p_size > 25 AND p_size <> 30").select(*store)
    before = relational.resolved_references(edges, papers, "paper", "ref", "pos", 3)
    touched = upkeep.touched_keys(now_edges, upkeep.changed_keys(edges, now_edges, "paper"), upkeep.changed_keys(papers, now_papers, "id"), "paper", "ref")
    now = upkeep.refreshed(before, touched, now_edges, now_papers, "paper", "ref", "pos", 3)
    return now.select("paper", F.explode("refs").alias("r")).select("paper", F.col("r.pos").cast("int").alias("pos"), F.col("r.id").alias("ref"), "r.abstract")


# --- Texts -------------------------------------------------------------------------------------------


@_query("""SELECT doc_id, md5(CASE WHEN length(text) > 20000 THEN '[...truncated, showing last 20000 chars...]' || chr(10) || chr(10) || right(text, 20000) WHEN coalesce(text, '') = '' THEN '(empty)' ELSE text END) AS digest FROM documents""")
def text_tails(spark, sf_dir):
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(X.tail(F.col("text"))).alias("digest"))


@_query(r"""
WITH f AS (SELECT page_id, html, CASE WHEN regexp_matches(html, '(?s)<title>.*?</title>') THEN '<title>' || chr(10) || trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), e' \t\n\r\f\v') || chr(10) END AS a,
    CASE WHEN regexp_matches(html, '(?s)<h1>.*?</h1>') THEN '<h1>' || chr(10) || trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), e' \t\n\r\f\v') || chr(10) END AS b FROM pages)
SELECT page_id, CASE WHEN a IS NULL AND b IS NULL THEN 'none' ELSE concat_ws(chr(10), a, b) END AS blocks FROM f""")
def named_parts(spark, sf_dir):
    html = F.col("html")
    some = F.regexp_like(html, F.lit("(?s)<title>.*?</title>|<h1>.*?</h1>"))
    return _t(spark, sf_dir, "pages").select("page_id", F.when(some, X.named_blocks(html, ("title", "h1"))).otherwise("none").alias("blocks"))


@_query("""SELECT event_id, printf('%.1f%%', value) AS share, CASE WHEN value * 100000 > 1e6 THEN printf('%.1fM', value * 100000 / 1e6) ELSE printf('%.1fK', value * 100000 / 1e3) END AS size,
    repeat('█', CAST(greatest(0, least(20, round_even(value / 100 * 20, 0))) AS INT)) || repeat('░', 20 - CAST(greatest(0, least(20, round_even(value / 100 * 20, 0))) AS INT)) AS bar FROM (SELECT event_id, round(value, 0) AS value FROM events)""")
def formatted_figures(spark, sf_dir):
    v = F.round("value", 0)
    return _t(spark, sf_dir, "events").select("event_id", runs.percent(v / 100).alias("share"), runs.size_text(v * 100000).alias("size"), F.substring(runs.bar(v / 100), 1, 20).alias("bar"))


@_query("""SELECT user_id, arg_max(round(value / 100, 3), event_id) FILTER (event_type = 'purchase') AS accuracy FROM events GROUP BY user_id""")
def test_accuracies(spark, sf_dir):
    """The accuracy of each user's last line that reports one."""
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("TEST_METRICS: loss=1 test_acc="), F.format_string("%.3f", F.col("value") / 100))).otherwise("epoch 1 test_acc=9")
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", runs.test_accuracy(F.array(line)).alias("accuracy"))
    return relational.last_value(rows, ["user_id"], "accuracy", "event_id").withColumn("accuracy", F.round("accuracy", 3))


@_query(r"""SELECT doc_id, md5(array_to_string(lines[1:1] || ['new', 'lines'] || lines[4:], chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def spliced_lines(spark, sf_dir):
    """Lines 2 and 3 of every document replaced."""
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(F.array_join(runs.splice(F.split("text", "\n"), 2, 3, F.array(F.lit("new"), F.lit("lines"))), "\n")).alias("digest"))


@_query(r"""
SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN text WHEN role = 'assistant' THEN text ELSE left('Below are 3 papers ' || text, 3000) END) AS digest FROM conversations""")
def reference_texts(spark, sf_dir):
    """The references inside prompts of two forms, and the first characters of what has neither."""
    t = F.col("text")
    prompt = (
        F.when(F.col("role") == "user", F.concat(F.lit("Below are 3 papers to read\n\n"), t, F.lit("\n\nThe researcher has identified a gap")))
        .when(F.col("role") == "assistant", F.concat(F.lit("Below are 12 papers:\n\n"), t, F.lit("\n\nGenerate a structured answer")))
        .otherwise(F.concat(F.lit("Below are 3 papers "), t))
    )
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.reference_text(prompt)).alias("digest"))


# --- Retrieval ---------------------------------------------------------------------------------------


@_query(_TOPK + """, g AS (SELECT a.vec_id AS query, min(b.vec_id) AS gold_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1)
SELECT g.query, CAST(CASE WHEN rank <= 50 THEN rank END AS INT) AS rank, CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END AS recall FROM g LEFT JOIN r ON r.query = g.query AND r.id = gold_id""")
def gold_recall(spark, sf_dir):
    """Whether the first other vector of a query's label is among its 50 nearest."""
    rows = _t(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("m1"))
    second = rows.join(first, "label").filter("vec_id <> m1").groupBy("label").agg(F.min("m1").alias("m1"), F.min("vec_id").alias("m2"))
    gold = asked.join(second, "label").select(F.col("vec_id").alias("query"), F.when(F.col("vec_id") == F.col("m1"), F.col("m2")).otherwise(F.col("m1")).alias("gold_id"))
    return vector.gold_recall(vector.top_k(rows, asked, 50), gold)


@_query(_TOPK + "SELECT query, round(avg(sim), 6) AS mean_sim FROM r WHERE rank <= 50 GROUP BY query")
def reward_similarity(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    hits = vector.top_k(rows, rows.filter("vec_id % 20 = 0"), 50)
    return vector.reward_similarity(hits, rows.count()).withColumn("mean_sim", F.round("mean_sim", 6))


@_query(_TOPK + "SELECT query, round(max(CASE WHEN label = 3 THEN 0.0 ELSE id % 11 / 10.0 END), 4) AS max_score, round(avg(CASE WHEN label = 3 THEN 0.0 ELSE id % 11 / 10.0 END), 4) AS mean_score FROM r WHERE rank <= 10 GROUP BY query")
def judged_retrieval(spark, sf_dir):
    """The ten nearest by a judge's scores, which some answers lack."""
    rows = _t(spark, sf_dir, "embeddings")
    hits = vector.top_k(rows, rows.filter("vec_id % 20 = 0"), 10)
    scores = hits.filter("label <> 3").select("query", "id", ((F.col("id") % 11) / F.lit(10.0)).alias("score"))
    return vector.judge_summary(hits, scores)


@_query("""
SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS prs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_similarity(spark, sf_dir):
    """Each vector with the next one, element by element."""
    rows = _t(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(scoring.dot(F.col("embedding"), F.col("other")), 6).alias("prs"))
