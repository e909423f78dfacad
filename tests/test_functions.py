import math

import pytest
from pyspark.sql import functions as F

from sparquill.functions import latex, prompts, runs, scoring
from sparquill.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")])
    return row.select(column.alias("out")).first()["out"]


def test_words_are_unicode(spark):
    assert one(spark, X.words(F.lit("L'été naïve_x 12"))) == ["l", "été", "naïve_x", "12"]


@pytest.mark.parametrize(("a", "b", "want"), [("a b", "a c", 0.5), ("", "a", 0.0), ("x x", "x", 1.0)])
def test_bag_cosine(spark, a, b, want):
    got = one(spark, X.bag_cosine(X.counts(X.words(F.lit(a))), X.counts(X.words(F.lit(b)))))
    assert math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize(("text", "want"), [("x<proposal><gap>g</gap></proposal>y", "g"), ("no tag", "no tag")])
def test_block(spark, text, want):
    assert one(spark, X.block(F.lit(text), "proposal")) == want


def test_tag_share(spark):
    assert one(spark, X.tag_share(F.lit("<gap><problem>"))) == pytest.approx(0.4)


@pytest.mark.parametrize(("text", "want"), [("3, 9, 1", [2, 0]), ("none", [0, 1])])
def test_index_list(spark, text, want):
    assert one(spark, X.index_list(F.lit(text), F.lit(5), 2)) == want


@pytest.mark.parametrize(("text", "want"), [("12", 1.0), ("none", 0.0), ("7 of 10", 0.7)])
def test_tenth_score(spark, text, want):
    assert one(spark, X.tenth_score(F.lit(text))) == pytest.approx(want)


@pytest.mark.parametrize(("s", "want"), [(0.8, 1.0), (0.9, 0.5), (1.0, 0.0)])
def test_overlap_ramp(spark, s, want):
    assert one(spark, scoring.overlap_ramp(F.lit(s))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("n", "c", "k", "want"), [(20, 5, 3, 0.6008771929824561), (5, 4, 3, 1.0), (2, 1, 3, math.nan)])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, scoring.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(want, nan_ok=True)


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        assert one(spark, scoring.hmac_sha256(F.lit("1.500000"), key)) == hmac.new(key, b"1.500000", hashlib.sha256).hexdigest()
    good = hmac.new(b"k", b"1234.500000", hashlib.sha256).hexdigest()
    assert one(spark, scoring.signed(F.lit(1234.5), F.lit(good), b"k"))
    assert not one(spark, scoring.signed(F.lit(1234.5), F.lit(None).cast("string"), b"k"))


def test_reference_block(spark):
    refs = F.array(*(F.struct(F.lit("t").alias("title"), F.lit(None if i else 2020).cast("int").alias("year"), F.lit("a" * 401 if i == 0 else "").alias("abstract")) for i in range(2)))
    first, second = one(spark, prompts.reference_block(refs, 2)).split("\n\n")
    assert first == "[1] t (2020)\nAbstract: " + "a" * 400 + "..."
    assert second == "[2] t (n.d.)\nAbstract: (no abstract available)"


def test_fill_once(spark):
    assert one(spark, prompts.fill("{a} {b}", a=F.lit("see {b}"), b=F.lit("Z"))) == "see {b} Z"
    assert one(spark, prompts.fill("{{a}} {a}{a}", a=F.lit(None).cast("string"))) == "{a} "
    with pytest.raises(KeyError):
        prompts.fill("{missing}")


def test_log_lines(spark):
    assert one(spark, runs.reward(F.lit('{"reward": 0.5}'))) == 0.5
    assert one(spark, runs.reward(F.lit("step:3 - critic/rewards/mean:0.25 - x:1"))) == 0.25
    assert one(spark, runs.loss(F.lit("1% | 2/9 {'loss': 0, 'lr': None}"))) == 0.0
    assert one(spark, runs.progress(F.lit("| 1/9 | 2/9 {'loss': 1}"))) == (2, 9)
    assert one(spark, runs.metrics(F.lit("nothing"))) is None


@pytest.mark.parametrize(
    ("line", "reward", "loss"),
    [
        ('{"a": {"x": 1}, "reward": 2}', 2.0, None),
        ('{"msg": "it\'s", "reward": 1}', 1.0, None),
        ("step:3 {'reward': 1.0}", 1.0, None),
        ("{'reward': 1.5, 'done': True}", 1.5, None),
        ('{"loss": 0.5, "reward": 1}', 1.0, 0.5),
        ("{'loss': 0.5, 'reward': 1}", 1.0, None),
        ("{'loss': 0, 'train_loss': 3}", None, 0.0),
        ("{'msg': \"it's\", 'reward': 0.5}", 0.5, None),
        ("{'reward': 0.5, 'shape': (1, 2)}", 0.5, None),
        ("{'reward': 0.5, 'rest': [], 'x': ('a', \"b\",), 1: 2,}", 0.5, None),
        ('{"reward": true}', 1.0, None),
        ("{'reward': False}", 0.0, None),
        ("{'reward': '0.5'}", 0.5, None),
        ("{'reward': (1, 2)}", None, None),
        ("{'reward': 0.5, oops}", None, None),
        ("{'a': \"'reward': 7\", 'reward': 1e-3}", 0.001, None),
        ("{'reward': 1, 'reward': 2}", 2.0, None),
    ],
)
def test_log_line_forms(spark, line, reward, loss):
    assert (one(spark, runs.reward(F.lit(line))), one(spark, runs.loss(F.lit(line)))) == (reward, loss)


@pytest.mark.parametrize(
    ("line", "reward"),
    [
        ("{'why': '" + "it\\'s " * 20_000 + "', 'reward': 0.5}", 0.5),
        ("{" + ", ".join(f"'k{i}': {i}" for i in range(5_000)) + ", 'reward': 2}", 2.0),
        ("{'reward': 1, 'b': (" + "1" * 60 + "}", None),
        ("{'reward': 1, 'b': (" + "1, " * 5_000 + ")}", 1.0),
    ],
)
def test_long_dict_literals(spark, line, reward):
    """Long texts and lists, many keys, a list without an end: neither the stack nor the time goes with them."""
    rows = spark.createDataFrame([(line,)], "line string")
    assert rows.select(runs.reward(F.col("line"))).first()[0] == reward


def test_slots(spark):
    got = one(spark, runs.slots(F.lit("a:0-1; b:3;c:2-2;")))
    assert [tuple(x) for x in got] == [("a", 0), ("a", 1), ("b", 3), ("c", 2)]


def test_latex(spark):
    body = "We use \\textbf{bold \\emph{words}} and \\cite{x} text. " * 10
    tex = f"% c\n\\section{{Our Method}}{body}\\begin{{table}}gone\\end{{table}}\\section{{Tiny}} short"
    got = one(spark, latex.sections(F.lit(tex), F.lit("main.tex")))
    assert [(s["heading"], s["kind"], s["order"]) for s in got] == [("Our Method", "method", 0)]
    assert got[0]["text"].startswith("We use bold words and text. We use") and "gone" not in got[0]["text"]
    kept = one(spark, latex.selected(latex.sections(F.lit(tex * 30), F.lit("m")), 3000))
    assert sum(len(s["text"]) for s in kept) <= 3000 and all(len(s["text"]) >= 120 for s in kept)


@pytest.mark.parametrize("spec", ["nocolon", "m:x", ":0", "a:0;b"])
def test_bad_slots_raise(spark, spec):
    with pytest.raises(Exception, match="bad slot entry"):
        one(spark, runs.slots(F.lit(spec)))


def test_labels(spark):
    none = F.lit(None).cast("string")
    assert one(spark, runs.model_label(F.lit("a/m/rl/x"), F.lit("r"), F.lit(True), F.lit("hosted"))) == "hosted"
    assert one(spark, runs.model_label(none, F.lit("r"), F.lit(True), none)) == "api"
    assert one(spark, runs.label_base(F.lit("e_20240101_000000_x"))) == "e_x" and one(spark, runs.label_timestamp(F.lit("e"))) == ""


def test_text_tail_and_blocks(spark):
    assert one(spark, X.tail(F.lit("abc"), 2)).endswith("\n\nbc") and one(spark, X.tail(F.lit(""), 2)) == "(empty)"
    assert one(spark, X.named_blocks(F.lit("<title> t </title><approach>a</approach>"))) == "<title>\nt\n\n<approach>\na\n"
    assert one(spark, X.named_blocks(F.lit("x<thinking>no</thinking> y "))) == "x y"
    assert one(spark, runs.bar(F.lit(float("nan")), 3)).endswith(" NaN") and one(spark, runs.last_match(F.array(F.lit("a=1"), F.lit("a=2"), F.lit("b")), "a=(.)")) == 2.0


def test_italic_headings_by_their_bounds(spark):
    for title, kept in (("Ab.", "Ab"), ("Abc", "Abc"), ("A...", "A"), ("Ab", None), ("A" + "b" * 100, "A" + "b" * 100), ("A" + "b" * 100 + ".", "A" + "b" * 100), ("A" + "b" * 101, None), ("abc", None)):
        got = one(spark, latex.prepared(F.lit(f"text\n\\textit{{{title}}} more")))
        assert (f"\\section*{{{kept}}}" in got) if kept else ("section" not in got), title
