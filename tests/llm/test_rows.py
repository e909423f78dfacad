"""Rows by their places in files, whatever columns they have; short and accented benchmark items; tokenizer files."""

import pytest
from pyspark.sql import functions as F

from sparquill.llm import common, decontaminate, divergence, exact, importance, minhash, secrets, tokens, urls

TEXTS = [(1, "same text"), (2, "same text"), (3, "an other text of its own")]


def with_metadata(spark, kind):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    own = F.lit("mine") if kind == "string" else F.struct(F.lit("one file").alias("file_path"), F.lit(7).cast("long").alias("row_index"))
    return rows.withColumn("_metadata", own)


@pytest.mark.parametrize("kind", ["string", "struct"])
@pytest.mark.parametrize("scan", [False, True])
def test_a_column_called_metadata(spark, tmp_path, kind, scan):
    """It neither fails nor stands in for the files' own."""
    rows = with_metadata(spark, kind)
    if scan:
        rows.coalesce(1).write.parquet(str(tmp_path / "t"))
        rows = spark.read.parquet(str(tmp_path / "t"))
    for drop in (exact.drop_exact_duplicates, minhash.drop_near_duplicates):
        out = drop(rows, scan=scan)
        assert out.columns == rows.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
        assert {str(r["_metadata"]) for r in out.collect()} == {str(rows.first()["_metadata"])}
    assert {r["doc_id"]: r["kept"] for r in exact.exact_duplicates(rows, scan=scan).collect()} == {1: True, 2: False, 3: True}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows, scan=scan).collect()} == {1: 1, 2: 1, 3: 3}
    assert secrets.scan_history(rows, path_col="doc_id", scan=scan).count() == 3
    bench = spark.createDataFrame([(1, "an other text of its own")], "item_id long, text string")
    for cfg in (decontaminate.SeedConfig(), decontaminate.SeedConfig(block_bytes=0)):
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(rows, bench, cfg, scan=scan).collect()) == [1, 2]
    assert divergence.audit(rows, lang_col="text", source_col="text", scan=scan).count() == 0
    assert [r["doc_id"] for r in importance.draw(rows, bench, importance.ImportanceConfig(least_words=3, percent=100), scan=scan).collect()] == [3]


@pytest.mark.parametrize("limit", [common.BITS_BYTES, 0])
def test_rows_at_places(spark, tmp_path, monkeypatch, limit):
    """By bits, and beyond their bound by a join: rows at the ends of words, spans and files."""
    monkeypatch.setattr(common, "BITS_BYTES", limit)
    spark.range(0, 20_000, 1, 2).selectExpr("id", "'x' AS __bits", "id AS place").write.parquet(str(tmp_path / "t"))
    rows, place = common.placed(spark.read.parquet(str(tmp_path / "t")), True)
    wanted = {0, 1, 62, 63, 64, 127, 4095, 4096, 8191, 8192, 9999, 10_000, 14_096, 19_999}
    some = rows.filter(F.col("id").isin(*wanted)).select(place)
    some = some.unionByName(some)
    assert {r["id"] for r in common.at_places(rows, place, some, True).collect()} == wanted
    assert common.at_places(rows, place, some, True).count() == len(wanted)
    out = common.without(rows, place, some)
    assert out.columns == ["id", "__bits", "place"] and {r["id"] for r in out.collect()} == set(range(20_000)) - wanted
    assert common.without(rows, place, some.limit(0)).count() == 20_000


def test_only_repeated_rows_shuffle_at_the_least_counters(spark, monkeypatch):
    """As many rows as one filter may have: still one filter, and of unique rows next to none counts as repeated."""
    monkeypatch.setattr(exact, "MAX_COUNTERS", 1 << 15)
    assert exact.counters_for(4096) == 1 << 15 and exact.counters_for(4097) > 1 << 15
    rows = common.materialize(spark.range(4096).select(F.col("id").alias("doc_id"), exact.text_digest((F.col("id") % 4000).cast("string")).alias("digest")), "d")
    marked = exact._marked(rows)
    assert marked.filter((F.col("doc_id") % 4000 < 96) & ~F.col("maybe")).isEmpty()
    assert marked.filter("maybe").count() <= 2 * 96 + 0.03 * 4096


@pytest.mark.parametrize("block_bytes", [4_000_000, 0])
def test_items_in_capitals_of_any_script(spark, block_bytes):
    item = "Élan ÉTÉ Ça où Über ÖL Ñandú ДОМ ΣΟΦΊΑ"
    docs = spark.createDataFrame([(1, "x " + item.lower() + " y"), (2, "x " + item.upper() + " y"), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench, decontaminate.SeedConfig(block_bytes=block_bytes)).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_equal"]) for r in got) == [(1, 1, 9), (2, 1, 9)]


@pytest.mark.parametrize("block_bytes", [4_000_000, 0])
def test_short_items_inside_texts(spark, block_bytes):
    docs = spark.createDataFrame([(1, "a text with Four short words here inside"), (2, "four short words"), (3, "four short word here"), (4, "here"), (5, "words here four short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "four short words, here"), (8, "Here")], "item_id long, text string")

    def found(**own):
        return sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.contaminated(docs, bench, decontaminate.SeedConfig(block_bytes=block_bytes, **own)).collect())

    assert found() == [(4, 8, 0)]
    assert found(inside=True) == [(1, 7, 3), (1, 8, 6), (3, 8, 3), (4, 8, 0), (5, 8, 1)]


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="part by part"):
        tokens.WordEncoder(tokens.default_path("byte_bpe_50k.json"))


def test_rules_in_capitals_and_names_with_dots(spark):
    pages = spark.createDataFrame([(1, "http://x.A.net/p")], "`page.id` long, `the.url` string")
    assert [tuple(r)[3:] for r in urls.judge(pages, [("A.net", "/", "block")], id_col="page.id", url_col="the.url").collect()] == [("A.net/".lower(), "block")]


def test_batches_are_bound_by_bytes_only(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "3m")
    common.bound_batches(spark)
    assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)
    common.bound_batches(spark)
    assert spark.conf.get(key) == common.ARROW_BYTES and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
