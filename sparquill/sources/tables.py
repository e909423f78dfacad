"""Readers and writers of the record files: JSON lines, dated folders, logs, exports, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import latex
from ..functions.runs import model_label, plain_line
from ..functions.text import empty
from ..operators.relational import best_row, missing_ordinals

REFERENCE = "struct<arxiv_id:string,title:string,abstract:string,year:int>"
#: Schemas of the record files.
SCHEMAS = {
    "papers": "arxiv_id string, title string, abstract string, categories array<string>, created string",
    "refs": f"arxiv_id string, refs array<{REFERENCE}>",
    "dataset": f"arxiv_id string, title string, abstract string, categories array<string>, created string, refs array<{REFERENCE}>, system string, prompt string, pinned_count int",
    "cache": "key string, value string",
    "index": "id string, embedding array<float>, abstract string",
    "outputs": "arxiv_id string, output string",
    "sample_state": "index int, step string, improvement double, passed boolean, elapsed_s double, error string",
    "run_config": "task_name string, checkpoint string, strategy string, n_samples int, run_id string, is_api boolean, api_model string, subtask string, machine string, temperature double",
    "registry": "run_id string, run_dir string, task string, subtask string, model_label string, n_samples int, started_at string, strategy string",
    "result": "val_metric double, _sig string, error string",
    "summary": "label string, strategy string, n_examples long, FAS double, recall double, mean_sim double, PRS double, format double, leakage double",
}


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table's scan over all cores, for costly work on each row.

    A scan with as many partitions as cores is left as it is. One with fewer, such as a single small file, is dealt out,
    unless the session sets spark.sparquill.spread to false.
    """
    session = rows.sparkSession
    cores = session.sparkContext.defaultParallelism
    if session.conf.get("spark.sparquill.spread", "true") != "true" or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema; malformed lines are left out."""
    full = T.StructType.fromDDL(schema).add("__corrupt", "string")
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    return spark.read.text(path).filter(F.trim("value") != "").select(row.alias("r")).select("r.*").filter(F.col("__corrupt").isNull()).drop("__corrupt")


def dated_papers(spark: SparkSession, root: str, months: list[tuple[int, int]] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Papers under root/YYYY/MM/id/metadata.json with year, month and path; only the given months' folders are read."""
    paths = [f"{root}/{y:04d}/{m:02d}/*/metadata.json" for y, m in months] if months else [f"{root}/*/*/*/metadata.json"]
    rows = spark.read.schema(SCHEMAS["papers"]).option("multiLine", "true").option("mode", "PERMISSIVE").json(paths)
    place = F.col("_metadata.file_path")
    rows = rows.select("*", place.alias("path"), F.regexp_extract(place, r"/(\d{4})/\d{2}/[^/]+/[^/]+$", 1).try_cast("int").alias("year"), F.regexp_extract(place, r"/(\d{2})/[^/]+/[^/]+$", 1).try_cast("int").alias("month"))
    rows = rows.filter(~empty(F.col("arxiv_id")))
    return rows.filter(F.arrays_overlap("categories", F.array(*(F.lit(c) for c in categories)))) if categories else rows


def last_papers(papers: DataFrame) -> DataFrame:
    """One row for each id, that of the last path."""
    return papers.groupBy("arxiv_id").agg(F.max_by(F.struct(*[c for c in papers.columns if c != "arxiv_id"]), "path").alias("r")).select("arxiv_id", "r.*")


def indexable(papers: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Papers with an id and an abstract, of the given categories if any."""
    rows = papers.filter(~empty(F.col("arxiv_id")) & ~empty(F.col("abstract")))
    return rows.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))) if categories else rows


def write_index(rows: DataFrame, path: str) -> None:
    """The vector index: id, embedding, abstract."""
    rows.select("id", F.col("embedding").cast("array<float>"), F.coalesce("abstract", F.lit("")).alias("abstract")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["index"]).parquet(path)


def folder_of(paper_id) -> tuple:
    """Year and month of an id's folder (YYMM.number), null for other ids, and the id as a folder name."""
    head = F.regexp_extract(paper_id, r"^(\d{4})\.\d+", 1)
    year = F.when(head != "", F.substring(head, 1, 2).try_cast("int") + 2000)
    return year, F.when(head != "", F.substring(head, 3, 2).try_cast("int")), F.replace(paper_id, F.lit("/"), F.lit("__"))


def resolved_folders(ids: DataFrame, folders: DataFrame) -> DataFrame:
    """id, path: each id's folder of folders (year, month, name, path): the one of its own year and month, else the first by path with its name.

    A name is the id with its slashes replaced, or the id itself. Ids without a folder have a null path.
    """
    year, month, safe = folder_of(F.col("id"))
    named = ids.select("id", year.alias("y"), month.alias("m"), F.explode(F.array_distinct(F.array(safe, F.col("id")))).alias("name"))
    found = named.join(folders, "name")
    own = F.struct(~F.coalesce((F.col("y") == F.col("year")) & (F.col("m") == F.col("month")), F.lit(False)).alias("other"), (F.col("name") == F.col("id")).alias("raw"), "path")
    best = found.withColumn("own", own).groupBy("id").agg(F.min("own").alias("b")).select("id", F.col("b.path").alias("path"))
    return ids.select("id").join(best, "id", "left")


#: Stems of TeX files that hold bibliographies (fixed values).
BIBLIOGRAPHIES = ("refs", "references", "bibliography", "biblio")


def tex_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = BIBLIOGRAPHIES) -> DataFrame:
    """path, value: whole .tex files under root but for bibliographies."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.filter(~F.lower(F.regexp_extract("path", r"([^/]+)\.tex$", 1)).isin(*excluded))


def tex_sections(files: DataFrame) -> DataFrame:
    """paper, source, heading, kind, text, order, global_order: the sections of all files (paper, source, value) of each paper, files by name.

    global_order numbers a paper's sections over its files; only section numbers are sorted together, not texts.
    """
    found = files.select("paper", "source", F.explode(latex.sections(F.col("value"), F.col("source"))).alias("s")).select("paper", "source", "s.*")
    place = F.row_number().over(Window.partitionBy("paper").orderBy("source", "order")) - 1
    numbers = found.select("paper", "source", "order").withColumn("global_order", place)
    return found.join(numbers, ["paper", "source", "order"])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value: lines without terminal controls."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), plain_line(F.col("value")).alias("value"))


def summaries(spark: SparkSession, paths: list[str], depth: int = 3) -> DataFrame:
    """Summary files, labelled by the folder that stands depth segments from the path's end (3: above the one they are in)."""
    rows = spark.read.schema(SCHEMAS["summary"]).option("multiLine", "true").json(paths)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.withColumn("label", F.coalesce("label", F.element_at(parts, -depth)))


def write_records(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to those there."""
    rows.write.mode("append").json(path)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, lines: the number of lines of each file."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("lines"))


def last_lines(lines: DataFrame, n: int, key: str = "path", order: str = "number") -> DataFrame:
    """Each file's last n lines; lines: path, number, value. Shares of a file's lines are cut to n each before they meet."""
    share = F.pmod(F.xxhash64(order), F.lit(64))
    within = F.row_number().over(Window.partitionBy(key, share).orderBy(F.desc(order)))
    parts = lines.withColumn("__k", within).filter(F.col("__k") <= n)
    return parts.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__k") <= n).drop("__k")


def sample_states(spark: SparkSession, root: str) -> DataFrame:
    """run, ordinal and the state of the samples under root/run/sample_NN: those from sample_00 up to the first folder that a run lacks.

    A folder counts if any file is in it; one without a state that can be read gives no row and does not end the run. Numbers have two
    digits, or more from 100 on. Only names are listed for the folders; files of states are read by the tasks.
    """
    place = F.col("_metadata.file_path")
    number = r"/([^/]+)/sample_(\d\d|[1-9]\d{2,})/"
    parts = [F.regexp_extract(place, number, 1).alias("run"), F.regexp_extract(place, number, 2).try_cast("int").alias("ordinal")]
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/sample_*").select(*parts).filter("ordinal is not null").distinct()
    states = spark.read.schema(SCHEMAS["sample_state"]).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "state.json").json(f"{root}/*/sample_*")
    own = states.select("*", *parts).filter(F.col("ordinal").isNotNull() & F.col("step").isNotNull() & F.regexp_like(place, F.lit(r"/sample_\d+/state\.json$")))
    return own.join(missing_ordinals(there, "run", "ordinal"), "run").filter(F.col("ordinal") < F.col("missing")).drop("missing")


def registry_entries(configs: DataFrame) -> DataFrame:
    """Registry rows of run configurations (as run_config, with run_dir and started_at)."""
    label = model_label(F.coalesce("checkpoint", F.lit("")), F.when(F.coalesce("checkpoint", F.lit("")) == "", F.col("run_id")).otherwise(""), F.col("is_api"), F.col("api_model"))
    return configs.select("run_id", "run_dir", F.col("task_name").alias("task"), F.coalesce("subtask", F.lit("")).alias("subtask"), label.alias("model_label"), "n_samples", "started_at", F.coalesce("strategy", F.lit("")).alias("strategy"))


def backfilled(registry: DataFrame, configs: DataFrame) -> DataFrame:
    """Registry rows of the configurations whose run_id the registry lacks, the first by folder for each run_id."""
    missing = configs.filter(~empty(F.col("run_id"))).join(registry.select("run_id"), "run_id", "left_anti")
    return registry_entries(best_row(missing, ["run_id"], F.col("run_dir")))


def append_runs(configs: DataFrame, path: str) -> None:
    write_records(registry_entries(configs), path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a registry; malformed lines are left out."""
    return json_lines(spark, path, SCHEMAS["registry"])


def lookup(key: str, value: str, *splits: DataFrame) -> DataFrame:
    """The row of a key from the first split that has it."""
    rows = [s.filter(F.col(key) == value).withColumn("__split", F.lit(i)) for i, s in enumerate(splits)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy("__split").limit(1).drop("__split")


def first_writes(entries: DataFrame) -> DataFrame:
    """key, value of the first write of each key; entries: key, value, seq."""
    return best_row(entries.select("key", "seq", "value"), ["key"], F.col("seq")).select("key", "value")


def append_new(cache: DataFrame, entries: DataFrame, path: str) -> None:
    """Appends the first writes of keys that the cache lacks."""
    first_writes(entries).join(cache.select("key"), "key", "left_anti").write.mode("append").json(path)


def retrieval_export(rows: DataFrame) -> DataFrame:
    """prompt, data_source, reward_model and arxiv_id, as a trainer reads them."""
    return rows.select("prompt", "data_source", F.struct(F.col("abstract").alias("ground_truth")).alias("reward_model"), "arxiv_id")


def chat_export(rows: DataFrame, system: str = "system", prompt: str = "prompt", target: str = "target", flagged: str = "flagged") -> DataFrame:
    """messages of three roles for rows with a target that is not flagged."""
    roles = [F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", system), ("user", prompt), ("assistant", target))]
    return rows.filter(~F.coalesce(F.col(flagged), F.lit(False)) & ~empty(F.col(target))).select(F.array(*roles).alias("messages"))
