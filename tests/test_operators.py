import hashlib

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparquill.operators import overlap, registry, relational, vector
from sparquill.plans import catalog
from sparquill.sources import config, tables
from sparquill.streaming import latest


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


def test_chat_messages_collects_no_text(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = entry.queries()["chat_messages"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Aggregate" in line and "md5" in line] == []
    assert "collect_list(m" in plan and [line for line in plan.splitlines() if "Project" in line and "md5" in line and "AS m#" in line]
    md5 = {t: hashlib.md5(t.encode()).hexdigest() for t in "ab"}
    assert {r["conv_id"]: r["messages"] for r in df.collect()}[1] == f"user:{md5['a']},assistant:{md5['b']}"
    places = entry.queries()["chat_message_rows"](spark, str(tmp_path)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["place"], r["role"]) for r in places] == [(1, 1, "user"), (1, 2, "assistant"), (2, 1, "user")]


def test_strategy_cells_count_every_event(spark):
    cells = entry.queries()["strategy_cells"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert {r["event_type"] for r in cells} == {r[0] for r in events.select("event_type").distinct().collect()}
    assert sum(int(r["cell"].split("/")[1]) for r in cells) == events.count()


def test_latex_selection_keeps_long_sections(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 1000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert entry.queries()["latex_selection"](spark, str(tmp_path)).first()["chars"] > 4900


def test_longest_reference_lists_are_whole(spark):
    most = max(r["n"] for r in entry.queries()["resolve_references"](spark, SF).groupBy("paper").agg(F.count("*").alias("n")).collect())
    assert 4 < most <= 40
    longest = entry.queries()["prompt_records_40"](spark, SF).select(F.max(F.size(F.split("ref_block", "\n\n"))), F.max("prompt")).first()
    assert longest[0] == most
    assert entry.queries()["pinned_references_40"](spark, SF).select(F.max(F.size(F.split("refs", ",")))).first()[0] == most


def test_seeded_shuffle_places_every_document(spark):
    rows = entry.queries()["seeded_shuffle_splits"](spark, SF)
    assert rows.filter("place IS NOT NULL").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 200


def test_resolved_references(spark):
    papers = spark.createDataFrame([("a", "A", "local", 1), ("b", "B", "", 2)], "id string, title string, abstract string, year int")
    edges = spark.createDataFrame([("p", "a", 0, "x", "own", 9), ("p", "b", 1, "y", "own", 9), ("p", "c", 2, "z", None, 9)], "k string, ref string, pos int, title string, abstract string, year int")
    rows = relational.resolved_references(edges, papers, "k", "ref", "pos", 1).first()["refs"]
    assert [(r["id"], r["title"], r["abstract"]) for r in rows] == [("a", "A", "local"), ("b", "y", "own")]
    assert relational.resolved_references(edges, papers, "k", "ref", "pos", 3).isEmpty()


def test_tail_mean_sentinel(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, None)], "k string, t int, v double")
    got = dict(relational.tail_mean(rows, ["k"], "v", F.col("t"), 1, 9999.0).collect())
    assert got == {"a": 3.0, "b": 9999.0}


def test_pinned(spark):
    refs = F.array(*(F.struct(F.lit(i).alias("id")) for i in range(5)))
    got = [r["id"] for r in spark.range(1).select(relational.pinned(refs, 2, 3).alias("r")).first()["r"]]
    assert got[:2] == [0, 1] and len(got) == 3 and got[2] in (2, 3, 4)


def test_top_k_of_a_small_index(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 0), (4, None, 0)], "vec_id long, embedding array<float>, label int")
    got = vector.top_k(rows, rows.filter("vec_id = 1"), 50).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(3, 1), (2, 2)]


def test_registry(spark):
    registry.register("test", "double")(lambda rows, cfg: rows.select(F.col("id") * cfg["by"]))
    assert registry.apply("test", "double", spark.range(3), {"by": 2}).collect()[2][0] == 4
    with pytest.raises(KeyError):
        registry.apply("test", "none", spark.range(1))


def test_config():
    assert config.overridden({"a": {"b": 1}}, "a.b=2.5", "c.d=true") == {"a": {"b": 2.5}, "c": {"d": True}}


def test_json_lines_and_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key":"a","value":"1"}\nbroken\n{"key":"b","value":"2"}\n')
    cache = tables.json_lines(spark, str(tmp_path / "c.jsonl"), tables.SCHEMAS["cache"])
    assert cache.count() == 2
    new = spark.createDataFrame([("a", "9", 1), ("c", "3", 2), ("c", "4", 3)], "key string, value string, seq int")
    tables.append_new(cache, new, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("c", "3")]


def test_dated_papers(spark, tmp_path):
    d = tmp_path / "2024" / "03" / "2403.1"
    d.mkdir(parents=True)
    (d / "metadata.json").write_text('{"arxiv_id":"2403.1","abstract":"x","categories":["cs.LG"]}')
    row = tables.dated_papers(spark, str(tmp_path), [(2024, 3)], ["cs.LG"]).first()
    assert (row["year"], row["month"]) == (2024, 3)


def test_latest_state_stream(spark, tmp_path):
    for i, rows in enumerate(([("a", 1), ("b", 5)], [("a", 3), ("b", 2)])):
        spark.createDataFrame(rows, "k string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = latest.latest_state(latest.records(spark, str(tmp_path / "in"), "k string, n long", form="parquet"), str(tmp_path / "out"), str(tmp_path / "chk"), "k", "n")
        q.awaitTermination(60)
    assert dict(latest.latest_table(spark, str(tmp_path / "out"), "k").collect()) == {"a": 3, "b": 5}


def test_latest_state_is_compacted(spark, tmp_path):
    """Folders stay few, the table right, and a compacting batch may run again after a crash before or after its marker."""
    out, chk, state = tmp_path / "out", tmp_path / "chk", {}

    def run(compact=2):
        stream = latest.records(spark, str(tmp_path / "in"), "k string, n long, s string", form="parquet")
        latest.latest_state(stream, str(out), str(chk), "k", "n", compact).awaitTermination(60)
        rows = latest.latest_table(spark, str(out), "k").collect()
        assert {r["k"]: (r["n"], r["s"]) for r in rows} == state and len(rows) == len(state)
        return sorted(int(d.name[6:]) for d in out.iterdir() if d.name.startswith("batch=")), sorted(int(d.parent.name[6:]) for d in out.glob("*/_full"))

    def again(number):
        """The last batch's end is forgotten, as if the driver was lost before it was noted."""
        for f in (f"{number}", f".{number}.crc"):
            (chk / "commits" / f).unlink(missing_ok=True)

    for i in range(9):
        rows = [(f"own{i}", i, "x"), ("all", i, None if i % 2 else f"v{i}"), ("old", 100 - i, f"v{i}"), (None, i, "none")]
        state |= {k: (n, s) for k, n, s in rows if k not in state or n > state[k][0]}
        spark.createDataFrame(rows, "k string, n long, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        folders, full = run()
        assert folders[-1] == i and len(folders) <= 6
        if full and i == full[-1]:
            again(i)
            if i == 4:
                (out / f"batch={i}" / "_full").unlink()
            assert run() == (folders, full)
    assert full == [4, 6, 8][-len(full):] and folders[0] > 0
    again(8)
    run(compact=0)
    with pytest.raises(ValueError):
        latest.latest_state(spark.readStream.format("rate").load().withColumn("Batch", F.lit(1)), str(out), str(chk), "value", "Batch")


def test_first_writes_and_windows_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 4000)], "key string, n int, t int").selectExpr("key", "n", "timestamp_seconds(t) ts").coalesce(1).write.parquet(str(tmp_path / "in"))

    def collected(df, mode):
        q = df.writeStream.format("memory").queryName(f"t{mode}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(tuple(r) for r in spark.table(f"t{mode}").collect())

    rows = latest.records(spark, str(tmp_path / "in"), "key string, n int, ts timestamp", form="parquet")
    assert [r[0] for r in collected(latest.first_writes(rows, "ts"), "append")] == ["a", "b"]
    assert [r[1:] for r in collected(latest.windowed_counts(rows, "ts", "key"), "complete")] == [("a", 2), ("b", 1)]


def test_record_files(spark, tmp_path):
    """Papers of the last path, indexable ones, TeX files, logs, summaries, counts and tails of lines."""
    for month, text in (("03", "x"), ("04", "y")):
        d = tmp_path / "papers" / "2024" / month / "p1"
        d.mkdir(parents=True)
        (d / "metadata.json").write_text('{"arxiv_id":"p1","abstract":"%s","categories":["cs.LG"]}' % text)
    papers = tables.dated_papers(spark, str(tmp_path / "papers"))
    assert tables.last_papers(papers).first()["abstract"] == "y"
    assert tables.indexable(papers, ["cs.CL"]).isEmpty() and tables.indexable(papers).count() == 2
    tex = tmp_path / "tex"
    tex.mkdir()
    for name in ("main", "refs", "References", "bibliography", "biblio", "bib"):
        (tex / f"{name}.tex").write_text("x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in tables.tex_files(spark, str(tex)).collect()) == ["bib.tex", "main.tex"]
    (tmp_path / "run.log").write_text("\x1b[32ma\x1b[0m\nb\nc\n")
    assert [r["value"] for r in tables.log_lines(spark, str(tmp_path / "run.log")).collect()] == ["a", "b", "c"]
    assert tables.line_counts(spark, str(tmp_path / "run.log")).first()["lines"] == 3
    s = tmp_path / "exp1" / "eval" / "k"
    s.mkdir(parents=True)
    (s / "summary.json").write_text('{"FAS": 0.5}')
    assert tables.summaries(spark, [str(s / "summary.json")]).first()["label"] == "eval"
    assert tables.summaries(spark, [str(s / "summary.json")], depth=4).first()["label"] == "exp1"
    index = spark.createDataFrame([("p", [1.0, 2.0], None)], "id string, embedding array<double>, abstract string")
    tables.write_index(index, str(tmp_path / "index"))
    assert tuple(tables.read_index(spark, str(tmp_path / "index")).first()) == ("p", [1.0, 2.0], "")


def test_registry_file(spark, tmp_path):
    schema = tables.SCHEMAS["run_config"] + ", run_dir string, started_at string"
    rows = [("t", None, "s", 3, i, api, "hosted" if api else None, None, None, None, f"d/{i}", "2024") for i, api in (("r1", True), ("r2", False), ("r2", False))]
    configs = spark.createDataFrame(rows, schema)
    tables.append_runs(configs.filter("run_id = 'r1'"), str(tmp_path / "reg"))
    (tmp_path / "reg" / "more.json").write_text("broken\n")
    known = tables.load_runs(spark, str(tmp_path / "reg"))
    assert [tuple(r)[0] for r in known.collect()] == ["r1"] and known.first()["model_label"] == "hosted"
    assert [(r["run_id"], r["model_label"]) for r in tables.backfilled(known, configs).collect()] == [("r2", "r2")]


def test_resolved_folders(spark):
    ids = spark.createDataFrame([("2403.00001",), ("math/01",), ("2401.9",), ("none",)], "id string")
    folders = spark.createDataFrame([(2024, 3, "2403.00001", "a/2024/03/x"), (2023, 1, "2403.00001", "a/2023/01/x"), (2020, 1, "math__01", "a/2020/01/m"), (1999, 1, "2401.9", "a/1999/01/y")], "year int, month int, name string, path string")
    assert dict(tables.resolved_folders(ids, folders).collect()) == {"2403.00001": "a/2024/03/x", "math/01": "a/2020/01/m", "2401.9": "a/1999/01/y", "none": None}


def test_sections_of_several_files(spark):
    body = "Some words about it. " * 10
    files = spark.createDataFrame([("p", "b.tex", f"\\section{{Results}}{body}\\section{{Tiny}}x"), ("p", "a.tex", f"\\section{{Intro}}{body}\\section{{Method}}{body}"), ("q", "z.tex", "word " * 50)], "paper string, source string, value string")
    got = [tuple(r) for r in tables.tex_sections(files).select("paper", "source", "heading", "order", "global_order").orderBy("paper", "global_order").collect()]
    assert got == [("p", "a.tex", "Intro", 0, 0), ("p", "a.tex", "Method", 1, 1), ("p", "b.tex", "Results", 0, 2), ("q", "z.tex", "z.tex", 0, 0)]


def test_large_query_sets_meet_the_index_in_blocks(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = rows.filter("vec_id % 3 = 0")
    want = sorted(map(tuple, vector.top_k(rows, asked, 7).collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 10)
    monkeypatch.setattr(vector, "BLOCK", 60)
    assert sorted(map(tuple, vector.top_k(rows, asked, 7).collect())) == want


def test_overlap_by_join_equals_matrix(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "zzzqqq")], "doc_id long, text string"))
    want = sorted(map(str, overlap.closest(docs, items).collect()))
    monkeypatch.setattr(overlap, "MATRIX_ROWS", 10)
    assert sorted(map(str, overlap.closest(docs, items).collect())) == want
    assert overlap.closest(docs, items.limit(0)).filter("item_id is not null or similarity <> 0").isEmpty()


def test_nulls_come_last(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 2.0)], "k int, v double")
    assert [r["k"] for r in relational.nulls_last(rows, "v", "k").collect()] == [4, 3, 1, 2]


def test_settings_file():
    assert config.loaded('{"a": {"b": 1}}') == {"a": {"b": 1}}


def test_prefixes_of_long_and_hot_keys(spark):
    """Gaps at and across the bounds of blocks, rows that share an ordinal, a key without 0, one below 0, and none at all."""
    keys = {"full": range(20), "gap": [0, 1, 2, 4, 5], "edge": [*range(8), *range(9, 12)], "far": [*range(8), *range(12, 30)], "late": [3, 4], "twice": [0, 0, 1, 3], "below": [-1, 0, 1], "only": [-2]}
    rows = spark.createDataFrame([(k, o) for k, v in keys.items() for o in v], "key string, o int")
    got = dict(relational.missing_ordinals(rows, "key", "o", block=4).collect())
    assert got == {k: min(set(range(100)) - set(v)) for k, v in keys.items()}
    kept = {tuple(r) for r in relational.numbered_prefix(rows, "key", "o").collect()}
    assert kept == {(k, o) for k, v in keys.items() for o in v if 0 <= o < got[k]}
    assert relational.missing_ordinals(rows.limit(0), "key", "o").count() == 0


def test_hot_keys_are_cut_before_they_meet(spark):
    rows = spark.range(0, 10_000, 1, 8).selectExpr("concat('hot', id div 100000) AS key", "id", "IF(id < 9000, id, NULL) AS v")
    for df in (relational.latest(rows, ["key"], F.desc("id")), relational.tail_mean(rows, ["key"], "v", F.col("id"), 5, 0.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert relational.tail_mean(rows, ["key"], "v", F.col("id"), 5, 0.0).first()["tail_mean"] == 8997.0
    assert relational.last_value(rows, ["key"], "v", "id").first()["v"] == 8999


def test_sample_folders_up_to_the_first_gap(spark, tmp_path):
    def put(run, folder, text, name="state.json"):
        (tmp_path / run / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / run / folder / name).write_text(text)

    for i in (0, 1, 2, 4):
        put("a", f"sample_{i:02d}", f'{{\n"index": {i}, "step": "done", "passed": true}}')
    put("a", "sample_01", "no state {")
    put("a", "sample_00/deep", '{"index": 9, "step": "done"}')
    put("b", "sample_01", '{"index": 1, "step": "done"}')
    put("c", "sample_00", "x", "log.txt")
    put("c", "sample_01", '{"index": 1, "step": "error"}')
    put("c", "sample_2", '{"index": 2, "step": "done"}')
    for i in range(102):
        put("d", f"sample_{i:02d}", f'{{"index": {i}, "step": "done"}}')
    got = sorted((r["run"], r["ordinal"], r["step"]) for r in tables.sample_states(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "done"), ("a", 2, "done"), ("c", 1, "error"), *(("d", i, "done") for i in range(102))]
