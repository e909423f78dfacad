import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparquill.llm import chat, decontaminate, exact, minhash, packing, quality, queries, secrets, tokens, urls, wordpiece

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "long " * 60_000), (7, "x" * 300_000), (8, "é ü 'll 12 <|endoftext|>"), (8, "é ü 'll 12 <|endoftext|>"), (None, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, very long and repeated texts, with a column whose name clashes with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, digest string, n int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def groups(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 7))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40)) + " " + " ".join(base[:40])) for i in range(60)]
    rows += [(200, rows[0][1]), (201, rows[0][1].upper()), (202, None), (203, ""), (204, "a b"), (205, "A  b"), (206, "a b c")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = groups(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_minhash_crowds_in_blocks(spark):
    """With tiny bounds, all comparisons go through several blocks, and the result is the same."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, base, 3)) for i in range(80)]
    cfg = minhash.SketchConfig(small=0, block=8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()}
    assert got == groups({i: shingles(t) for i, t in rows})


def test_minhash_one_id_on_two_texts(spark):
    """Each text of a repeated id keeps its links, and the id joins them."""
    rng = random.Random(7)
    a, b, c = ([f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (8, edited(rng, a, 1)), (9, edited(rng, b, 1)), (7, " ".join(c)), (11, " ".join(c)), (11, edited(rng, b, 1))]
    for cfg in (minhash.SketchConfig(), minhash.SketchConfig(small=0, block=2)):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((i, 5, i == 5) for i, _ in rows)


def test_minhash_odd_rows(spark, docs, none):
    got = {str(r["doc_id"]): (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    want = {"1": (0, 1, True), "2": (0, 2, True), "3": (0, 3, True), "4": (1, 4, True), "5": (1, 4, False), "6": (1, 6, True), "7": (1, 7, True), "8": (1, 8, True), "None": (1, 4, False)}
    assert got == want and minhash.near_duplicates(docs).count() == len(ODD)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == list("12345678".replace("5", ""))
    assert minhash.drop_near_duplicates(none).count() == 0


def test_components_converge(spark):
    """Chains, stars and many small parts, in one block and in many, come out whole."""
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 6000)]
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(200)]
    edges = spark.createDataFrame(chain + star + pairs, "a long, b long").repartition(7)
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(6000)} | {10_000 + i: 10_000 + i - i % 2 for i in range(400)}
    for block in (20_000, 10):
        got = minhash.components(edges, block=block).collect()
        assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want


def near_copies(n, words=60):
    """n distinct texts that are all one edit away from a base text."""
    base = [f"w{i}" for i in range(words)]
    return [" ".join([*base[: i % words], f"x{i}", *base[i % words + 1 :]]) for i in range(n)]


def test_minhash_work_on_a_large_group_is_linear(spark, monkeypatch):
    """One group of near copies: the texts that move to be compared are at most three a member."""
    dealt = []
    real = minhash._with_texts

    def counted(rows, *args):
        out = real(rows, *args)
        dealt.append(rows.count())
        return out

    monkeypatch.setattr(minhash, "_with_texts", counted)
    for n in (1000, 4000):
        dealt.clear()
        rows = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string")
        assert minhash.near_duplicates(rows).filter("component_id = 0").count() == n
        assert sum(dealt) <= 3 * n


def test_minhash_finds_all_pairs_just_above_the_threshold(spark):
    """600 pairs of unequal sizes with a similarity of 0.75 to 0.76."""
    rng = random.Random(11)
    rows = []
    for k in range(600):
        n = rng.randrange(40, 240)
        words = [f"p{k}w{i}" for i in range(n + 4)]
        extra = n // 3  # n shared shingles of n + n // 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *(f"p{k}v{i}" for i in range(extra))]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(1200)}


def test_similarity_estimate():
    cfg = minhash.SketchConfig()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared in (0.3, 0.75, 0.95):
        n = 2000
        both = int(2 * n * shared / (1 + shared))
        a, b = x[:n], x[n - both : 2 * n - both]
        r = minhash.registers([a, b], cfg)
        got = minhash.similarity(r[:1], r[1:], np.array([float(n)]), np.array([float(n)]), cfg)[0]
        assert abs(got - shared) < cfg.margin
        merged = minhash.registers([np.union1d(a, b)], cfg)
        assert (merged[0] == np.maximum(r[0], r[1])).all()


def brute_spans(text):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    out = [(m.start(), rank, f"{k}:{m.start()}:{m.end()}") for rank, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [s for _, _, s in sorted(out)]


SECRETS = ["é token = 'abcdef' password:x Secret=token:abcdefg", "AKIA" + "A" * 16 + " " + "a1" * 12, None, "", "😀 api_key=" + "f" * 30 + " x", "token==abcdef token=a=password=zzzzzz"]


def test_secrets_equal_brute_force(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(SECRETS + SECRETS[:2])), "path long, text string")
    base = tuple(secrets.BASE)
    got = {r["path"]: r["s"] for r in secrets.scan_history(rows, rules=base).selectExpr("path", "transform(findings, x -> concat_ws(':', x.kind, x.start, x.end)) s").collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(SECRETS + SECRETS[:2])}


def test_secret_ledger_scans_new_pairs_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame(list(enumerate(SECRETS)), "path long, text string")
    for rules in (secrets.BASE, secrets.BASE, secrets.RULES):
        last = secrets.scan_history(rows, path, rules).count()
    scanned = spark.read.parquet(path)
    assert last == len(SECRETS)
    pairs = scanned.selectExpr("blob", "explode(rules) r")
    assert pairs.count() == pairs.distinct().count() == 5 * len(secrets.RULES)  # null and empty are one blob


def test_secret_rules_narrowed_widened_removed_and_reordered(spark, tmp_path):
    """Whatever rules ran on a ledger before, the result is that of a fresh scan; what is known is not scanned again."""
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame(list(enumerate([*SECRETS, "AKIA" + "B" * 16 + " AKIA" + "C" * 30])), "path long, text string")
    assign, access, hexes = secrets.BASE
    sets = [secrets.BASE, (assign, secrets.Rule("access", 2, "AKIA[A-Z0-9]{30,}"), hexes), (secrets.Rule("access", 3, "AKIA[A-Z0-9]{8,}"), hexes), (hexes, assign), (secrets.Rule("access", 1, "AKIA[BC]+"), hexes), secrets.BASE]

    def found(*args):
        return sorted((r["path"], r["s"], r["ranks"]) for r in secrets.scan_history(rows, *args).select("path", secrets.listed(F.col("findings")).alias("s"), F.transform("findings", lambda x: x["rank"]).alias("ranks")).collect())

    for rules in sets:
        assert found(path, rules) == found(None, rules)


def test_known_blobs_are_not_read_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame(list(enumerate(SECRETS)), "path long, text string")
    first = secrets.scan_history(rows, path).collect()
    monkeypatch.setattr(secrets, "scan", lambda *a: pytest.fail("scanned again"))
    assert sorted(map(str, secrets.scan_history(rows, path).collect())) == sorted(map(str, first))


def test_secrets_odd_rows(spark, docs, none):
    own = docs.selectExpr("*", "'x' blob", "1 path", "1 place", "1 `a.b`")
    got = secrets.scan_history(own, path_col="doc_id")
    assert got.columns == ["path", "blob", "findings"] and got.count() == len(ODD)
    assert secrets.scan_history(none, path_col="doc_id").count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000 + "token=abcdef"), (1, None)], "path long, text string")
    assert sorted(r["s"] for r in secrets.scan_history(long).select(secrets.listed(F.col("findings")).alias("s")).collect()) == ["", "assign:400000:400012"]
    many = spark.createDataFrame([(1, "token=abcdef " * 20_000)], "path long, text string")
    assert len(secrets.scan_history(many).first()["findings"]) == 20_000


def brute_rule(host, path, rules):
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_rules(spark, monkeypatch):
    rules = [*queries.URL_RULES, ("net", "/e", "allow"), ("a.example.net", "/", "block")]
    found = [None, "", "no scheme", "http://NET", "http://x.Net/", "https://a.b.example.net/en/1?q#f", "http://example.net/en", "ftp://q.org/fr/x", "http://.net/e", "http://net:80/", "x://a.example.net/en/", "http://org/fr/#/de/"]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    for r in got.values():
        assert (r["rule"], r["verdict"]) == brute_rule(r["host"], r["path"], rules)
    assert (got[5]["host"], got[5]["path"]) == ("a.b.example.net", "/en/1")
    monkeypatch.setattr(urls, "MAX_BROADCAST_BYTES", 0)
    assert {r["page_id"]: tuple(r) for r in urls.judge(pages, rules).collect()} == {i: tuple(r) for i, r in got.items()}


def test_url_odd_rows(spark):
    found = [(1, None), (1, None), (None, "http://a.net/"), (2, "http://" + "a." * 50_000 + "net/" + "b/" * 50_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in found], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, queries.URL_RULES)
    assert sorted(r["verdict"] for r in got.collect()) == ["allow", "allow", "block", "block"]
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, [], default="block").collect()} == {"block"}


def test_exact(spark, docs, none):
    got = [r.asDict() for r in exact.exact_duplicates(docs).collect()]
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for i, t in ODD:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for r in got:
        norm = next(k for k in by if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(by[norm]) and r["keep_id"] == min(i for i in by[norm] if i is not None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    stays = [r["text_sha256"] for r in got if r["kept"]]
    assert len(stays) == len(set(stays)) == len(by)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(i for i in ids if i is not None) for ids in by.values())
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0


def test_exact_null_ids_and_ties(spark):
    """A null id stays only alone; of rows that repeat id and text one stays."""
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (2, "b"), (None, "b"), (2, "b"), (1, None), (3, "")], "doc_id long, text string")
    got = sorted((r["text_sha256"][:4], str(r["keep_id"]), r["group_size"], str(r["doc_id"]), r["kept"]) for r in exact.exact_duplicates(rows).collect())
    a, b, e = (hashlib.sha256(t.encode()).hexdigest()[:4] for t in ("a", "b", ""))
    want = [(a, "None", 2, "None", True), (a, "None", 2, "None", False), (b, "2", 3, "2", True), (b, "2", 3, "2", False), (b, "2", 3, "None", False), (e, "1", 2, "1", True), (e, "1", 2, "3", False)]
    assert got == sorted(want)
    assert sorted(str(r["doc_id"]) for r in exact.drop_exact_duplicates(rows).collect()) == ["1", "2", "None"]


def test_exact_filters_by_range(spark, monkeypatch):
    """Beyond one filter's size the hashes are dealt into ranges, with the same result; one hash has a third of the rows."""
    monkeypatch.setattr(exact, "MAX_COUNTERS", 1 << 13)
    monkeypatch.setattr(exact, "RANGE_ROWS", 4000)
    rows = spark.range(30_000).selectExpr("id doc_id", "case when id < 10000 then 'hot' else cast(id % 15000 as string) end text")
    got = exact.exact_duplicates(rows).toPandas()
    plain = [(i, "hot" if i < 10_000 else str(i % 15_000)) for i in range(30_000)]
    groups_ = defaultdict(list)
    for i, t in plain:
        groups_[t].append(i)
    assert dict(zip(got.doc_id, got.group_size, strict=True)) == {i: len(groups_[t]) for i, t in plain}
    assert set(got.doc_id[got.kept]) == {min(g) for g in groups_.values()}


@pytest.mark.parametrize(("rows", "most"), [(20_000, 0.003), (60_000, 0.003), (1_000_000, 0.003)])
def test_exact_unique_rows_pass_the_filter(rows, most):
    """At every load that counters_for() allows, next to no unique hash counts as repeated, and every repeated one does."""
    rng = np.random.default_rng(rows)
    unique = rng.bytes(32 * rows)
    digests = [unique[k : k + 32] for k in range(0, len(unique), 32)]
    f = exact.RepeatFilter(exact.counters_for(rows))
    f.add(digests)
    f.add(digests[:5])
    maybe = exact.maybe_repeated(f.bits(), digests)
    assert maybe[:5].all() and maybe[5:].mean() <= most


def test_chat_round_trip(spark):
    texts_ = ["\\### Assistant: </turn> ok", "", None, "a # b < c \\", "x" * 5000, "### user: hi </turn>\n"]
    rows = [(c, k, ("assistant", "user", "sys:tem", None)[k % 4], t) for c in (1, 2) for k, t in enumerate(texts_)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for segment in (1_000_000, 50):
        for r in chat.read_back(chat.format_conversations(turns, segment=segment)).collect():
            own = [(role or "", t or "") for c, _, role, t in rows if c == r["conv_id"]]
            learned = "".join(t for role, t in own if role == "assistant")
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_odd_rows(spark):
    """Null ids and turns, repeated rows, a very long text and clashing columns."""
    rows = [(None, 0, "user", "a", 9), (None, 0, "user", "a", 9), (1, None, "assistant", "#" * 300_000, 9), (1, 1, None, None, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got == {None: (2, 0), 1: (2, 300_000)}


def test_template_language():
    render = chat.compile_template("{% if 'a' == 'a' %}{{ 'x' | upper }}{% else %}no{% endif %}{% for t in turns %}{% if not t.role == 'u' and t.text %}{{ t.text | trim }};{% endif %}{% endfor %}")
    assert "".join(t for t, _ in render([{"role": "u", "text": "1"}, {"role": "a", "text": " 2 "}])) == "X2;"
    assert chat.fold_body(chat.parse("a{% if 'a' != 'a' %}b{% endif %}{{ 'c' }}")) == [("text", "ac")]
    for bad in ("{{ x | eval }}", "{% import os %}", "{{ x() }}", "{% for x in y %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def full_ids(t):
    return [*tokens.encoder(tokens.default_path()).tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_tokenizer():
    own = tokens.WordEncoder(tokens.default_path(), limit=3000)
    every = [t or "" for _, t in ODD] + list(texts().values())[:60] + ["a=\u0338 b=c=\u0338d A\u0301=b", "don't 'S 'LL İ ΣΣ k\u212a", "\x1c\x85\u3000 12ab!!x", "<|endoftext|>a<|EndOfText|>"]
    for got, t in zip(own.encode([t.encode() for t in every]), every, strict=True):
        assert got.tolist() == full_ids(t)[:-1]


def test_concat_and_cut(spark, docs, none):
    width = tokens.id_width(tokens.default_path())
    rows = [r.asDict() for r in packing.concat_and_cut(docs.repartition(3), tokens.default_path(), 64).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in ODD:
        if i == 8:  # twice, so each piece is there twice
            assert sum(r["length"] for r in by[8]) == 2 * len(full_ids(t)) and {r["doc_tokens"] for r in by[8]} == {len(full_ids(t))}
        else:
            own = sorted(by[i], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in own), f"<u{width}").tolist() == full_ids(t)
    places = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert all(r["offset"] + r["length"] <= 64 for r in rows)
    assert packing.concat_and_cut(none, tokens.default_path()).count() == 0


def test_op10_checksums(spark):
    want = {i: full_ids(t) for i, t in texts().items()}
    rows = queries.op10_pack(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"]))
    for i, ids in want.items():  # each id lies in exactly one piece
        assert [x for a, n in sorted(by[i]) for x in range(a, a + n)] == list(range(len(ids)))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert (s2, o2) == ((s, o + n) if o + n < 2048 else (s + 1, 0))
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])


def test_best_fit(spark, docs, none):
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    bins = packing.best_fit_decreasing(sizes, 100)
    free, plain = [], []
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fits = [k for k, f in enumerate(free) if f >= sizes[i]]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= sizes[i]
        else:
            free.append(100 - sizes[i])
        plain.append(i)
    assert sorted(i for b in bins for i in b) == list(range(300)) and len(bins) == len(free)
    width = tokens.id_width(tokens.default_path())
    pieces = defaultdict(dict)
    copies = 0
    for r in packing.pack_best_fit(docs, tokens.default_path(), 128).collect():
        ids = np.frombuffer(r["ids"], f"<u{width}")
        assert len(ids) == 128 and r["cu_seqlens"][:-1] == r["position_resets"]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            pieces[d][s] = ids[a:b].tolist()
            copies += d == 8 and s == 0
    assert copies == 2
    for i, t in ODD:
        assert [x for s in sorted(pieces[i]) for x in pieces[i][s]] == full_ids(t)
    assert packing.pack_best_fit(none, tokens.default_path()).count() == 0


def test_op6_query_round_trip(spark, monkeypatch):
    """All documents of the table are in the packed matrices once, and the query's columns say so."""
    kept = {}
    real = queries.C.materialize
    monkeypatch.setattr(queries.C, "materialize", lambda df, label, **o: kept.setdefault(label, real(df, label, **o)))
    rows = {r["sequence_id"]: r for r in queries.op6_packed_ids(spark, SF).collect()}
    packed = kept["packed"].collect()
    width = tokens.id_width(tokens.default_path())
    pieces = defaultdict(dict)
    used = 0
    assert len(packed) == len(rows)
    for p in packed:
        ids, r = np.frombuffer(p["ids"], f"<u{width}"), rows[p["sequence_id"]]
        cuts = r["cu_seqlens"]
        assert len(ids) == 2048 and cuts[0] == 0 and cuts[:-1] == r["position_resets"] and cuts[-1] == r["n_tokens"] and (ids[cuts[-1] :] == 0).all()
        assert r["ids_crc32"] == zlib.crc32(p["ids"])
        used += cuts[-1]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], cuts, cuts[1:], strict=False):
            assert s not in pieces[d]
            pieces[d][s] = ids[a:b].tolist()
    for i, t in texts().items():
        assert [x for s in sorted(pieces[i]) for x in pieces[i][s]] == full_ids(t)
    assert used / (2048 * len(rows)) > 0.9


def test_word_pieces(spark, docs, none):
    vocabulary = set(map(tuple, wordpiece.vocabulary(tokens.default_path()))) | {(i,) for i in range(512)}

    def brute(word):
        s, n, at = wordpiece.symbols(word), 0, 0
        while at < len(s):
            end = len(s)
            while tuple(s[at:end]) not in vocabulary:
                end -= 1
            n, at = n + 1, end
        return n

    got = {r["doc_id"]: r for r in queries.op7_token_counts(spark, SF).collect()}
    for i, t in texts().items():
        found = [w.encode() for w in wordpiece.WORDS.findall(t.lower())]
        assert (got[i]["n_words"], got[i]["n_pieces"]) == (len(found), sum(map(brute, found)))
    odd = wordpiece.token_counts(docs, tokens.default_path()).collect()
    assert len(odd) == len(ODD) and {r["doc_id"]: r["n_words"] for r in odd if r["doc_id"] in (1, 2, 3, 4, 6, 7)} == {1: 0, 2: 0, 3: 0, 4: 2, 6: 60_000, 7: 1}
    assert wordpiece.token_counts(none, tokens.default_path()).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(9999)}" for _ in range(n)) for n in (40, 12, 3)]

    def swap(t, places):
        w = t.split()
        for p in places:
            w[p] = "zz"
        return " ".join(w)

    rows = [
        (1, f"before {items[0]} after"), (2, "x, " + items[0].upper().replace(" ", ", ")), (3, "x " + swap(items[0], (5, 11, 17, 23, 29, 35))), (4, " ".join(items[0].split()[:9]) + " clean"),
        (5, "y " * 200_000 + items[1]), (6, items[2]), (7, None), (8, ""), (9, swap(items[0], range(0, 40, 2))), (10, swap(items[1], (3,)) + " tail"),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, bench).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (5, 1), (6, 2), (10, 1)}  # item 2 has three words and is all of document 6
    cfg = decontaminate.SeedConfig(block_bytes=64)
    both = [sorted(map(tuple, decontaminate.contaminated(rows, bench, c).collect())) for c in (decontaminate.SeedConfig(), cfg)]
    assert both[0] == both[1]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(none, bench, cfg).count() == 0


def test_decontamination_odd_rows(spark, docs):
    """Null and repeated ids, equal items, items under five words, and stages by row."""
    long = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5"
    bench = spark.createDataFrame([(1, long), (1, long), (None, "One, two"), (7, ""), (8, None)], "item_id long, text string")
    extra = docs.unionByName(spark.createDataFrame([(None, long, "x", 1), (4, long, "x", 1)], docs.schema))
    for cfg in (decontaminate.SeedConfig(), decontaminate.SeedConfig(block_bytes=0)):
        got = sorted(map(str, (tuple(r) for r in decontaminate.contaminated(extra, bench, cfg).collect())))
        assert got == sorted(map(str, [(None, 1, 0, 14, 14), (4, 1, 0, 14, 14), (4, None, 0, 2, 2), (5, None, 0, 2, 2), (None, None, 0, 2, 2)]))
        kept = decontaminate.drop_contaminated(extra, bench, cfg)
        assert kept.columns == extra.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "7", "8", "8"]


def test_op8_rows_equal_brute_force(spark):
    """Every column of the query: all alignments of all items with all documents, word by word."""
    def plain(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)))

    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    number = defaultdict(lambda: len(number))
    codes = {k: np.array([number[w] for w in plain(t)]) for k, t in texts().items()}
    want = {}
    for i, words in items.items():
        item = np.array([number[w] for w in words])
        size = min(13, len(item))
        for d, own in codes.items():
            if not np.isin(own, item).sum() * 13 >= size * 10:
                continue
            for shift in range(size - len(item), len(own) - size + 1):
                first, last = max(shift, 0), min(shift + len(item), len(own))
                equal = own[first:last] == item[first - shift : last - shift]
                sums = np.concatenate(([0], np.cumsum(equal)))
                if last - first >= size and (sums[size:] - sums[:-size]).max() * 13 >= size * 10:
                    best = (int(sums[-1]), last - first, -first)
                    want[d, i] = max(want.get((d, i), best), best)
    got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_words"], -r["first_word"]) for r in queries.op8_decontaminate(spark, SF).collect()}
    assert got == want and len(want) > 0


def test_masks_hit_every_overlap():
    cfg = decontaminate.SeedConfig()
    for n in range(cfg.shortest, cfg.window + 1):
        unequal = n - -(-n * cfg.matches // cfg.window)
        masks = cfg.places(n)
        for gone in itertools.combinations(range(n), unequal):
            assert any(all(at + k not in gone for k in m) for m in masks for at in range(n - m[-1]))


def test_quality(spark, docs, none):
    out = queries.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    few = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, few).count() == len(ODD)
    assert quality.classify(docs, few.limit(0)).select("predicted").distinct().collect()[0][0] == 1
    assert quality.classify(none, few).count() == 0


def test_trees_equal_plain_walk_and_search(spark):
    """The flattened trees score like a walk of each row, and the first split is the best of a plain search."""
    docs = [t.encode() for t in texts().values()]
    x = np.array([quality.statistics(t) for t in docs])
    y = (x[:, 0] > np.median(x[:, 0])).astype(float) * (np.arange(len(x)) % 7 > 0)
    cfg = quality.TreeConfig(rounds=6)
    trees = quality.fit(x, y, cfg)

    def walk(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x], atol=1e-12)
    grad, hess = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])):
            left = x[:, f] <= cut
            if min(hess[left].sum(), hess[~left].sum()) * 4 >= cfg.least:
                gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + cfg.l2) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + cfg.l2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    assert (trees.feature[0, 0], trees.cut[0, 0]) == best[1:]


def test_op9_rows_equal_scores_one_by_one(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality.learn(docs, labels)
    for r in quality.classify(docs, labels).collect():
        one = trees.score(np.array([quality.statistics(texts_()[r["doc_id"]].encode())]))[0]
        assert math.isclose(r["score"], one, abs_tol=1e-12) and r["predicted"] == (one >= 0.3)


@functools.cache
def texts_():
    return texts()
