"""Names, specifications and log lines of runs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strategies by a fragment of the label, tried in this order (fixed values).
STRATEGIES = (
    ("top_k_refs", "top_k_refs"),
    ("topk_rw", "top_k_related_work"),
    ("related_work", "related_work"),
    ("research_q", "with_research_question"),
    ("full_refs", "full_refs"),
)
#: Keys of a reward and of a loss in a log line, first found counts (fixed values).
REWARD_KEYS = ("critic/rewards/mean", "reward/reward_score/mean", "actor/reward_score/mean", "reward")
LOSS_KEYS = ("train/loss", "loss", "train_loss")


def without_timestamp(c: Column) -> Column:
    return F.regexp_replace(c, r"_\d{8}_\d{6}$", "")


def experiment_label(c: Column) -> Column:
    """name_YYYYMMDD_HHMMSS as name MM/DD; other names unchanged."""
    return F.regexp_replace(c, r"^(.+?)_\d{4}(\d{2})(\d{2})_\d{6}$", "$1 $2/$3")


def label_timestamp(c: Column) -> Column:
    """The first _YYYYMMDD_HHMMSS of a label without its dash, empty without one."""
    return F.regexp_extract(c, r"_(\d{8}_\d{6})", 1)


def label_base(c: Column) -> Column:
    """A label without any _YYYYMMDD_HHMMSS."""
    return F.regexp_replace(c, r"_\d{8}_\d{6}", "")


def experiment_number(path: Column, otherwise: Column) -> Column:
    """expNN of a path, else the first word of the other value."""
    found = F.regexp_extract(path, r"(exp\d{2})", 1)
    return F.when(found != "", found).otherwise(F.split(F.trim(otherwise), r"\s+")[0])


def model_label(path: Column, otherwise: Column, is_api: Column | None = None, api_model: Column | None = None) -> Column:
    """The path's segment before the first segment rl, else the other value; for hosted models their name, else api."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "rl")
    own = F.when(at > 1, F.element_at(parts, (at - 1).cast("int"))).otherwise(otherwise)
    if is_api is None:
        return own
    name = F.coalesce(api_model, F.lit(""))
    return F.when(F.coalesce(is_api, F.lit(False)), F.when(name == "", "api").otherwise(name)).otherwise(own)


def model_order(label: Column) -> Column:
    """A sort key: expN by number, then all other labels."""
    number = F.regexp_extract(label, r"^exp(\d+)", 1)
    return F.struct((number == "").alias("other"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("number"), label.alias("label"))


def strategy(label: Column) -> Column:
    out = F.when(F.lit(False), "")
    for fragment, name in STRATEGIES:
        out = out.when(F.contains(label, F.lit(fragment)), name)
    return out.otherwise(label)


def device_numbers(spec: Column) -> Column:
    """An array of numbers from 0-7 or 0,1,3."""
    spec = F.trim(spec)
    low, high = (F.substring_index(spec, "-", n).try_cast("int") for n in (1, -1))
    listed = F.transform(F.filter(F.transform(F.split(spec, ","), F.trim), lambda x: x != ""), lambda x: x.try_cast("int"))
    span = F.concat(F.array(low), F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<int>")))
    return F.when(F.contains(spec, F.lit("-")) & ~F.contains(spec, F.lit(",")), span).otherwise(listed)


def slots(spec: Column) -> Column:
    """An array of (machine, device) from machine:spec;machine:spec; an entry without a colon or machine, or a device that is no number, is an error."""
    chunks = F.filter(F.transform(F.split(spec, ";"), F.trim), lambda x: x != "")

    def each(chunk: Column) -> Column:
        machine = F.trim(F.substring_index(chunk, ":", 1))
        devices = device_numbers(F.regexp_extract(chunk, r"^[^:]*:(.*)$", 1))
        bad = ~F.contains(chunk, F.lit(":")) | (machine == "") | F.exists(devices, lambda d: d.isNull())
        checked = F.when(bad, F.raise_error(F.concat(F.lit("bad slot entry: "), chunk)).cast("array<int>")).otherwise(devices)
        return F.transform(checked, lambda d: F.struct(machine.alias("machine"), d.alias("device")))

    return F.flatten(F.transform(chunks, each))


#: Terminal controls and carriage returns (a fixed pattern).
CONTROLS = "\u001b\\[[0-9;]*[mABCDEFGHJKSTfsu]|\r"


def plain_line(c: Column) -> Column:
    """Without terminal colours and carriage returns."""
    return F.regexp_replace(c, CONTROLS, "")


_MAP, _STRICT = "map<string,string>", {"allowSingleQuotes": "false"}


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once, however often use names it."""
    return F.transform(F.array(c), use)[0]


def _json_metrics(line: Column) -> Column:
    """A line that is a JSON object as a map of its texts; null where it isn't one. What no JSON object begins with isn't parsed, as each failure costs an exception."""
    return F.when(F.regexp_like(line, F.lit(r'^\{\s*["}]')), F.from_json(line, _MAP, _STRICT))


#: Texts, numbers and constants as a dict literal writes them; nan is taken for none. What repeats is possessive: it never
#: matches otherwise, and takes neither stack nor tries for long texts and lists.
_TEXT = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_NUMBER = r"[-+]?(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?"
_PLAIN = rf"{_TEXT}|{_NUMBER}|True|False|None|nan"
_VALUE = rf"{_PLAIN}|[(\[]\s*+(?:(?>{_PLAIN})\s*+(?:,\s*+)?)*+[)\]]"
_PAIR = rf"({_TEXT}|{_NUMBER})\s*+:\s*+({_VALUE})"


def _unquoted(c: Column) -> Column:
    """A text literal's text, escapes of single characters undone; other literals as they are."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    plain = F.when(F.contains(inner, F.lit("\\")), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(inner)
    return F.when(F.startswith(c, F.lit("'")) | F.startswith(c, F.lit('"')), plain).otherwise(c)


def _literal_pairs(body: Column) -> Column:
    """The entries of a dict literal as a map of texts; null where it isn't one. Of equal keys the last counts; lists and tuples are no numbers, so null."""
    whole = F.regexp_like(body, F.lit(rf"^\{{\s*+{_PAIR}\s*+(?:,\s*+{_PAIR}\s*+)*+,?\s*+\}}$"))

    def entry(key: Column, value: Column) -> Column:
        none = value.isin("None", "nan") | F.startswith(value, F.lit("(")) | F.startswith(value, F.lit("["))
        text = F.when(value == "True", "true").when(value == "False", "false").when(none, F.lit(None)).otherwise(_unquoted(value))
        return F.struct(_unquoted(key).alias("key"), text.alias("value"))

    def last(entries: Column) -> Column:
        own = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.when(F.size(F.array_distinct(entries["key"])) == F.size(entries), entries).otherwise(own)

    keys, values = (F.regexp_extract_all(body, F.lit(_PAIR), F.lit(n)) for n in (1, 2))
    return F.when(whole, F.map_from_entries(_once(F.zip_with(keys, values, entry), last)))


def _dict_metrics(line: Column) -> Column:
    """The first {...} without inner braces as a map of texts: JSON as it is, else a dict literal."""
    return _once(F.regexp_extract(line, r"(\{[^{}]+\})", 1), lambda body: F.when(body != "", F.coalesce(_json_metrics(body), _literal_pairs(body))))


def _double(v: Column) -> Column:
    """A number, and true and false as 1 and 0."""
    return F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))


def _has(found: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.coalesce(F.map_contains_key(found, F.lit(k)), F.lit(False))
    return out


def metrics(line: Column) -> Column:
    """A JSON line, else the first {...} of a line, as a map of doubles; null without one."""
    return F.transform_values(F.coalesce(_json_metrics(line), _dict_metrics(line)), lambda _, v: _double(v))


def first_metric(found: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that is there; a zero counts."""
    there = F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(found, k))
    return F.try_element_at(found, F.get(there, 0))


def parsed(line: Column) -> Column:
    """A line's two maps, of a JSON line and of its first dict; select this once, then take reward_in() and loss_in() of it."""
    return F.struct(_json_metrics(line).alias("json"), _dict_metrics(line).alias("dict"))


def reward_in(line: Column, found: Column) -> Column:
    """The reward of a line: a JSON line's, else that of key:value pairs of the console, else that of a dict literal. found: parsed(line)."""
    console = F.contains(line, F.lit("step:")) & F.contains(line, F.lit("critic/rewards/mean:"))
    value = F.regexp_extract(line, r"critic/rewards/mean:([-\d.eE+]+)", 1).try_cast("double")
    return F.when(found["json"].isNotNull(), _once(first_metric(found["json"], REWARD_KEYS), _double)).when(console, value).otherwise(_once(first_metric(found["dict"], REWARD_KEYS), _double))


def loss_in(found: Column) -> Column:
    """The loss of a JSON line, else that of a dict literal that has no reward. found: parsed(line)."""
    own = _once(first_metric(found["json"], LOSS_KEYS), _double)
    return F.when(found["json"].isNotNull(), own).when(~_has(found["dict"], ("reward",)), _once(first_metric(found["dict"], LOSS_KEYS), _double))


def reward(line: Column) -> Column:
    return reward_in(line, parsed(line))


def loss(line: Column) -> Column:
    return loss_in(parsed(line))


def last_match(lines: Column, pattern: str) -> Column:
    """The first group of a pattern in the last line that has it, as a number."""
    hits = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
    return F.try_element_at(hits, F.lit(-1)).try_cast("double")


def test_accuracy(lines: Column) -> Column:
    """test_acc of the last line that reports TEST_METRICS."""
    return last_match(lines, r"TEST_METRICS:.*test_acc=([\d.]+)")


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal; a dash for null."""
    return F.coalesce(F.format_string("%.1f%%", share * 100), F.lit("\u2014"))


def size_text(size: Column) -> Column:
    """Bytes as thousands or millions with one decimal."""
    return F.when(size > 1e6, F.format_string("%.1fM", size / 1e6)).otherwise(F.format_string("%.1fK", size / 1e3))


def bar(share: Column, width: int = 20) -> Column:
    """A share as a bar of full and empty blocks and a percentage; NaN as an empty bar."""
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.rint(share * width).cast("int")))
    drawn = F.concat(F.repeat(F.lit("\u2588"), full), F.repeat(F.lit("\u2591"), width - full), F.lit(" "), F.format_string("%4.1f", share * 100), F.lit("%"))
    return F.when(F.isnan(share), F.concat(F.repeat(F.lit("\u2591"), F.lit(width)), F.lit(" NaN"))).otherwise(drawn)


def progress(line: Column) -> Column:
    """(step, total) of the last | a/b of a line before its metrics."""
    pairs = F.regexp_extract_all(F.regexp_replace(line, r"\{[^{}]+\}.*$", ""), F.lit(r"\|\s*\d+/\d+"), F.lit(0))
    last = F.try_element_at(pairs, F.lit(-1))
    return F.struct(F.regexp_extract(last, r"(\d+)/", 1).try_cast("int").alias("step"), F.regexp_extract(last, r"/(\d+)", 1).try_cast("int").alias("total"))


def status(running: Column, finished: Column, started: Column) -> Column:
    return F.when(running, "running").when(finished, "done").when(started, "interrupted").otherwise("pending")


def eta_seconds(step: Column, total: Column, step_seconds: Column) -> Column:
    return (total - step) * step_seconds


def splice(lines: Column, first: int, last: int, new: Column) -> Column:
    """An array of lines with lines first to last (1-based, inclusive) replaced by those of new."""
    return F.concat(F.slice(lines, 1, first - 1), new, F.slice(lines, F.lit(last + 1), F.greatest(F.size(lines) - last, F.lit(0))))
