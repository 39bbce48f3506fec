"""Operators for training data: brute force, round trips and the defined edge cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphtrail.llm import bpe, canon, incremental, leaks, placement, qdigest, queries, sentences, survivor, tokengroups
from oracle import rows_of, sql_rows

RANKS = f"{queries.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
LONG = "lengthy words go on " * 20_000


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, data, name):
    assert rows_of(queries.QUERIES[name](spark, data)) == sql_rows(queries.ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_without_repeated_rows(spark, data, name):
    rows = queries.QUERIES[name](spark, data)
    found = [repr(r) for r in rows.collect()]
    assert found and len(found) == len(set(found))


# --- p1 -------------------------------------------------------------------------------


@pytest.mark.parametrize("a,b", [("Ｄéjà １２", "Déjà 12"), ("ﬁne line", "fine line"), ("Ѕсаn", "Scan"), ("z​e­ro", "zero"), ("ｶﾞ", "ガ"), ("⾯", "面"), ("ёлка", "ëлка"), ("Κey", "Key")])
def test_looks_the_same(a, b):
    assert canon.fold(a) == canon.fold(b)


@pytest.mark.parametrize("a,b", [("Cafe", "Café"), ("A1", "Al"), ("a", "A"), ("x²", "x2"), ("日", "曰"), ("0", "O"), ("a b", "ab"), ("①", "1")])
def test_looks_different(a, b):
    assert canon.fold(a) != canon.fold(b)


def test_trie_costs():
    t = canon.Trie(["Hello world", "Help"])
    assert t.find("Неllо wоrld") == ("Hello world", 0)
    assert t.find("Helo world") is None and t.find("Helo world", 1) == ("Hello world", 1) and t.find("Helq", 1) == ("Help", 1)
    assert t.find("Hel\u200bp\u200b") == ("Help", 0) and t.find("Hell", 1) == ("Help", 1) and t.find("elp", 1) == ("Help", 1) and t.find("Helpp", 1) == ("Help", 1)
    assert t.find("", 3) is None and t.find("", 4) == ("Help", 4) and canon.Trie(["ﬁn", "ガ"]).find("fin") == ("ﬁn", 0) and canon.Trie(["ガ"]).find("ｶﾞ") == ("ガ", 0)
    assert canon.normalise_token("сдвинул") == "сдвинул" and canon.normalise_token("cдвинyл") == "сдвинул" and canon.normalise_token("ｓсаn​") == "scan"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcA", min_size=1, max_size=6), min_size=1, max_size=6), st.text("abcA", max_size=6), st.integers(1, 3))
def test_automaton_finds_the_cheapest_line(lines, seen, most):
    costs = [(incremental.edit_distance(x, seen, 9), x) for x in lines]
    best = min(c for c in costs)
    assert canon.Trie(lines).find(seen, most) == ((best[1], best[0]) if best[0] <= most else None)


def texts(spark, rows):
    return spark.createDataFrame([(k, s, "x", 1) for k, s in rows], "session_id string, observed string, form string, route int")


def test_canonical_texts(spark):
    vocabulary = spark.createDataFrame([("s", "Open gate 7"), ("s", "Open gate 7"), ("t", "Other"), (None, "null"), ("s", None)], "session_id string, text string")
    seen = [("s", "Οреn gаtе ７"), ("s", "Open gate 7"), ("s", "Open gate 8"), ("t", "Open gate 7"), ("s", None), ("s", "  "), (None, "null"), ("s", "​"), ("s", LONG), ("u", "Otһеr")]
    hit = canon.canonical_texts(texts(spark, seen * 2), vocabulary, "session_id", "observed", "text", matched_only=True)
    assert [tuple(r) for r in hit.collect()] == [("s", "Οреn gаtе ７", "Open gate 7", True)]
    every = {(r.session_id, r.observed): (r.form, r.matched) for r in canon.canonical_texts(texts(spark, seen), vocabulary, "session_id", "observed", "text").collect()}
    assert every["s", "Οреn gаtе ７"] == ("Open gate 7", True) and every["s", "Open gate 8"] == ("Open gate 8", False) and every["u", "Otһеr"] == ("Other", False)
    near = canon.canonical_texts(texts(spark, seen), vocabulary, "session_id", "observed", "text", max_cost=1, matched_only=True)
    assert ("s", "Open gate 8", "Open gate 7", True) in [tuple(r) for r in near.collect()]
    assert canon.canonical_texts(texts(spark, []), vocabulary.limit(0), "session_id", "observed", "text").count() == 0


# --- p3 -------------------------------------------------------------------------------


def test_best_values_edges(spark):
    rows = [("a", 1, 10, 3, 0.5), ("a", 1, 11, 3, None), ("a", 1, 12, None, 0.7), ("b", 1, 13, 9, 0.9), (None, 1, 14, 9, 0.9), (None, 1, 15, 9, 0.9), ("c", 2, 16, None, float("nan")), ("c", 2, 17, None, None)]
    df = spark.createDataFrame(rows, "k string, seq int, block_id long, srcq int, tconf double").withColumn("rows", F.lit(0)).withColumn("value", F.lit(0))
    got = sorted((r.k, r.field_name, r.block_id, r.value) for r in survivor.best_values(df, ["k", "seq"], "block_id", ["srcq", "tconf"]).collect())
    assert got == [("a", "srcq", 10, 3.0), ("a", "tconf", 12, 0.7)]
    assert survivor.best_values(df.limit(0), ["k"], "block_id", ["srcq"]).count() == 0


def test_model_values_edges(spark):
    rows = [("a", 1, 10, 3, 0.5, "x"), ("a", 1, 11, 3, None, "y"), ("a", 1, 12, 4, 0.7, "x"), ("a", 1, 12, 4, 0.7, "x"), ("b", 1, 13, 9, 0.9, "x"), (None, 1, 14, 9, 0.9, "x"), ("c", 2, 16, None, float("nan"), "x"), ("c", 2, 17, 5, None, None)]
    df = spark.createDataFrame(rows, "k string, seq int, block_id long, srcq int, tconf double, origin string").withColumn("value", F.lit(0)).withColumn("src", F.lit("z"))
    got = {(r.k, r.field_name): [] for r in survivor.model_values(df, ["k", "seq"], "block_id", ["srcq", "tconf"], F.col("origin")).collect()}
    assert set(got) == {("a", "srcq"), ("a", "tconf")}
    assert survivor.model_values(df.limit(0), ["k"], "block_id", ["srcq"], F.col("origin")).count() == 0


def test_two_sided_model_finds_the_careless_source(spark):
    rng, rows, truth = random.Random(3), [], {}
    for e in range(150):
        truth[e] = {f"v{e}", f"w{e}"} if e % 3 == 0 else {f"v{e}"}
        for source, hit, lie in (("a", 0.95, 0.02), ("b", 0.9, 0.05), ("c", 0.85, 0.05), ("noisy", 0.5, 0.8)):
            rows += [(e, source, v) for v in truth[e] if rng.random() < hit]
            rows += [(e, source, f"lie{e}")] if rng.random() < lie else []
    df = spark.createDataFrame(rows + [(1, None, "x"), (None, "a", "x"), (1, "a", None)], "e int, source string, val string")
    got = {}
    for r in survivor.true_values(df, ["e"], "source", "val").collect():
        got.setdefault(r.e, set()).add(r.value)
    assert sum(got.get(e) == truth[e] for e in truth) >= 0.9 * len(truth)
    facts = survivor.claim_patterns(df, ["e"], "source", "val")
    patterns = facts.groupBy("pattern").agg(F.first("votes").alias("votes"), F.count(F.lit(1)).cast("double").alias("facts"))
    quality = {r.src: r for r in survivor.source_quality(patterns)[1].collect()}
    assert quality["noisy"].specificity < quality["a"].specificity and quality["noisy"].sensitivity < quality["a"].sensitivity
    assert survivor.true_values(df.limit(0), ["e"], "source", "val").count() == 0


# --- p5 -------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=60))
def test_cells_keep_order(values):
    v = np.sort(np.array(values, np.float64))
    cells = qdigest.quantize(v)
    assert (np.diff(cells) >= 0).all() and cells.min() >= 0 and cells.max() < 1 << qdigest.BITS
    back = qdigest.cell_value(cells)
    finite = np.isfinite(v) & (np.abs(v) > 1e-300)
    assert np.all(np.abs(back[finite] - v[finite]) <= np.abs(v[finite]) * 2.0**-19)


def test_merging_keeps_the_rank_bound():
    rng, k = np.random.default_rng(1), qdigest.factor(0.02)
    parts = [rng.standard_cauchy(n) * s for n, s in ((4000, 1), (9000, 50), (30, 1e6), (20000, 0.01))]
    g, x, c = [], [], []
    for p in parts:
        cells, counts = np.unique(qdigest.quantize(p), return_counts=True)
        _, node, count = qdigest.compress(np.zeros(len(cells), np.int64), cells + (1 << qdigest.BITS), counts, k)
        x.append(node), c.append(count)
    x, c = np.concatenate(x), np.concatenate(c)
    for _ in range(3):
        _, x, c = qdigest.compress(np.zeros(len(x), np.int64), x, c, k)
    every = np.sort(np.concatenate(parts))
    assert c.sum() == len(every) and len(x) <= 3 * k
    for q, value, n, low, high in qdigest.ask(x, c):
        below, upto = np.searchsorted(every, value - abs(value) * 2**-19), np.searchsorted(every, value + abs(value) * 2**-19, "right")
        assert below - 0.02 * n <= q * n + 1 and upto + 0.02 * n >= q * n - 1 and low <= upto and high >= below


def test_percentiles_edges(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("b", float("inf")), ("b", -1.0), ("c", None), (None, 5.0)] + [("d", 2.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double").withColumn("node", F.lit(1)).withColumn("count", F.lit(1))
    parts = qdigest.build(df, ["g"], "v")
    got = {(r.g, r.q): r for r in qdigest.percentiles(parts, ["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "d", None} and got["a", 0.5].n == 1 and abs(got["d", 0.99].value - 2) < 1e-5 and got["b", 0.99].value == float("inf")
    assert {r.n for r in qdigest.percentiles(qdigest.roll_up(parts, []), []).collect()} == {54}
    assert qdigest.percentiles(qdigest.build(df.limit(0), ["g"], "v"), ["g"]).count() == 0


def test_scopes_in_one_pass(spark):
    rng = random.Random(8)
    rows = [("dx", rng.choice("abc"), rng.choice(("mon", None)), rng.gauss(0, 9)) for _ in range(900)] + [("dy", "a", "mon", 7.0), ("dy", "a", "mon", None), ("dy", "z", "mon", float("nan"))]
    df = spark.createDataFrame(rows, "f string, s string, day string, v double").withColumn("key", F.lit(1)).repartition(5)
    parts = qdigest.build_scopes(df, ["f"], {"session": "s", "day": "day", "overall": None}, "v")
    got = {(r["scope"], r.f, r.g, r.q): r for r in qdigest.scoped_percentiles(parts, ["f", "g"]).collect()}
    assert {k[:3] for k in got} == {("session", "dx", "a"), ("session", "dx", "b"), ("session", "dx", "c"), ("session", "dy", "a"), ("day", "dx", "mon"), ("day", "dx", None), ("day", "dy", "mon"), ("overall", "dx", "all"), ("overall", "dy", "all")}
    for (scope, f, g, q), r in got.items():
        v = sorted(x for a, s, day, x in rows if a == f and x is not None and x == x and (scope == "overall" or g == (s if scope == "session" else day)))
        exact = v[max(1, int(np.ceil(q * len(v)))) - 1]
        assert r.n == len(v) and abs(r.value - exact) <= abs(exact) * 2**-19 + 1e-12
    assert qdigest.scoped_percentiles(qdigest.build_scopes(df.limit(0), ["f"], {"overall": None}, "v"), ["f"]).count() == 0


def test_runs_are_released_and_only_one_key_is_compressed():
    rng, leaf = np.random.default_rng(3), 1 << qdigest.BITS
    rows = [(key, leaf + int(x)) for salt in range(3) for key in "abc" for x in np.sort(rng.choice(10_000, 2 if key == "b" else 40, replace=False))]
    for size, limit in ((7, 5), (7, 10**6), (1, 3), (50, 30), (500, 10)):
        batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "node": [r[1] for r in part], "count": [1] * len(part)}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got, runs, steps = {}, [], 0
        for keys, g, _, count in qdigest._by_runs(iter(batches), qdigest.factor(), limit):
            runs, steps = runs + keys, steps + 1
            for name, n in zip(np.array(keys)[g], count):
                got[name] = got.get(name, 0) + int(n)
        assert got == {"a": 120, "b": 6, "c": 120} and runs == list("abc" * 3) and (steps > 1 or size == 500)


# --- p6, p7 ---------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_segments_find_every_near_text(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    most = max(len(a), len(b)) // incremental.SHARE
    assert incremental.edit_distance(a, b, 99) == row[-1] and (incremental.edit_distance(a, b, most) <= most) == (row[-1] <= most)
    if a and b:
        index, rect = incremental.SegmentIndex(), (0.0, 0.0, 1.0, 1.0)
        index.add(a, rect)
        assert index.near(b, rect) == (row[-1] <= most)


BLOCKS = "block_id long, session_id string, cap int, rect array<double>, otext string, cell string, part int"


def blocks(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], BLOCKS)


def repeated(spark, new, old):
    got = incremental.repeated_rows(blocks(spark, new), blocks(spark, old), key=["session_id", "cap"], new_id="block_id", history_id="block_id", text="otext", rect="rect")
    return sorted(r.block_id for r in got.collect())


R = [0.0, 0.0, 100.0, 20.0]


def test_incremental_edges(spark):
    old = [(1, "s", 1, R, "abcdefghij"), (2, "s", 1, None, "no place at all"), (3, "s", 1, [0.0, 0.0], "short rect here"), (4, None, 1, R, "nobody's text"), (5, "s", 1, R, LONG)]
    new = [
        (10, "s", 1, R, "abcdefghXY"), (11, "s", 1, R, "abcdefgXYZ"), (12, "s", 2, R, "abcdefghij"), (13, "s", 1, [0.0, 11.0, 100.0, 31.0], "abcdefghij"), (14, "s", 1, R, None), (15, "s", 1, R, " "),
        (16, "s", 1, None, "no place at all"), (17, "s", 1, [0.0, 0.0], "short rect here"), (18, None, 1, R, "nobody's text"), (19, "s", 2, R, "abcdefghij"), (20, "s", 1, [0.0, 0.0, 0.0, 20.0], "abcdefghij"), (21, "s", 1, R, LONG[:-9]),
        (22, "s", None, R, "abcdefghij"), (23, "s", 1, [float("nan"), 0.0, 1.0, 1.0], "abcdefghij"),
    ]
    assert repeated(spark, new, old) == [10, 19, 21]
    assert repeated(spark, new[:1], []) == [] and repeated(spark, [], old) == []


def test_only_accepted_rows_count(spark):
    new = [(1, "s", 1, R, "aaaaaaaaaa"), (2, "s", 1, R, "aaaaaaaabb"), (3, "s", 1, R, "aaaaaabbbb"), (4, "s", 1, R, "aaaaaabbbb")]
    assert repeated(spark, new, []) == [2, 4]


def test_hot_cells_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(9)
    make = lambda i, s: (i, s, 1, [rng.uniform(0, 9), rng.uniform(0, 9), 100 + rng.uniform(0, 9), 40.0], "".join(rng.choice("abcd") for _ in range(10)))
    old, new = [make(i, "s") for i in range(300)], [make(1000 + i, "s") for i in range(150)]
    want = repeated(spark, new, old)
    monkeypatch.setattr(placement.meet, "__defaults__", (7,))
    assert repeated(spark, new, old) == want and want


def test_history_index_takes_batches_in_turn(spark, tmp_path):
    index = incremental.HistoryIndex(str(tmp_path / "index"), buckets=8)
    args = {"key": ["session_id", "cap"], "new_id": "block_id", "text": "otext", "rect": "rect"}
    first = [(1, "s", 1, R, "abcdefghij"), (2, "s", 1, R, "abcdefghij"), (3, "s", 2, R, "other words")]
    assert [r.block_id for r in index.check(blocks(spark, first), **args).collect()] == [2]
    second = [(4, "s", 1, R, "abcdefghiX"), (5, "s", 2, R, "something new")]
    assert [r.block_id for r in index.check(blocks(spark, second), **args).collect()] == [4]


def pairs_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "unit_id long, rect array<double>, otext string, id int, cell string")
    return sorted((r.a, r.b) for r in tokengroups.similar_pairs(df, row_id="unit_id", text="otext", rect="rect", **more).collect())


def test_token_groups_equal_brute_force(spark, monkeypatch):
    rng, rows = random.Random(11), []
    for i in range(260):
        base = [f"w{(i // 4) * 3 + j}" for j in range(10)] if rng.random() < 0.8 else ["same"] * 3 + [f"w{rng.randrange(40)}" for _ in range(9)]
        words = [w if rng.random() < 0.97 else f"z{rng.randrange(99)}" for w in base]
        x, y, h = rng.uniform(0, 30), (i // 4) * 9 % 300 + rng.uniform(0, 6), rng.choice((24, 31, 40))
        rows.append((i, [x, y, x + 200, y + h], " ".join(words)))
    want = sorted((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if placement.overlap(a[1], b[1]) >= 0.5 and tokengroups.jaccard(set(a[2].split()), set(b[2].split())) >= 0.7)
    assert pairs_of(spark, rows) == want and len(want) > 20
    assert pairs_of(spark, rows, hot=9) == want and pairs_of(spark, rows, hot=1) == want
    monkeypatch.setattr(tokengroups, "_STEP", 50)
    monkeypatch.setattr(tokengroups, "COUNTERS", 4)
    assert pairs_of(spark, rows, hot=30) == want


def test_token_group_edges(spark):
    rows = [(1, R, "One two"), (2, R, "two, ONE!"), (3, R, None), (4, R, "  "), (5, R, "!?"), (6, None, "one two"), (7, [0.0], "one two"), (8, [0.0, 0.0, 100.0, 0.0], "one two"), (9, R, LONG), (10, R, LONG + "more"), (11, [500.0, 0.0, 600.0, 20.0], "one two")]
    assert pairs_of(spark, rows) == [(1, 2), (9, 10)] and pairs_of(spark, []) == []


def test_copies_are_one_representative(spark):
    rows = [(i, R, "one two three four") for i in range(50, 90)] + [(90, R, "one two three four five"), (91, [0.0, 900.0, 10.0, 950.0], "one two three four"), (92, None, "one"), (93, R, None), (94, R, "other words")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "unit_id long, rect array<double>, otext string, id int, cell string")
    got = {r.id: r.class_id for r in tokengroups.classes_of(df, row_id="unit_id", text="otext", rect="rect").collect()}
    assert got == {i: 50 for i in range(50, 91)} | {i: i for i in range(91, 95)}
    assert tokengroups.classes_of(df.limit(0), row_id="unit_id", text="otext", rect="rect").count() == 0


def test_classes_are_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 3), (10, 11), (5, 5)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.id: r.class_id for r in tokengroups.classes(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}


# --- p8 -------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_pieces_change_no_ids(s, size):
    s = s.encode("utf-8", "replace").decode()
    e = bpe.encoder(RANKS)
    assert [i for p in bpe.pieces(s, size) for i in e.encode_ordinary(p)] == e.encode_ordinary(s)
    assert bpe.decode(bpe.encode(s, RANKS), RANKS) == s


def test_encode_corpus_edges(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "  "), (5, LONG), (6, "<|endoftext|>"), (7, "x" * 50_000), (8, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, "doc_id", "text", RANKS).collect()}
    assert got[1] == got[8] == [15496, 995] and got[2] == got[3] == [] and 50256 not in got[6] and len(got[5]) > 50_000
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df, "doc_id", "text", RANKS), "doc_id", RANKS).collect()}
    assert all(back[i] == (t or "") for i, t in rows) and bpe.encode_corpus(df.limit(0), "doc_id", "text", RANKS).count() == 0
    assert bpe.decode([15496, 447], RANKS).endswith("�")


# --- p9 -------------------------------------------------------------------------------


ITEM = "The quick brown fox, e.g. one of 31.5 px, jumps over the lazy dog near the old river bank today."
ZH = "葡萄园旁边的固定的罗盘在第904次截图之后丢失了熔炉，偏移94.49像素，而马鞍上的移动的水车又裁剪了日晷"


def leaked(spark, docs, items=((1, "en", ITEM), (2, "zh", ZH), (3, None, None), (4, "en", "too short"), (5, "en", "")), **more):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id long, lang string, text string, doc_id int") if items else spark.createDataFrame([], "item_id long, lang string, text string")
    return sorted(tuple(r) for r in leaks.contaminated(d, i, doc_id="doc_id", text="text", item_id="item_id", lang="lang", **more).collect())


def docs_with_parts():
    words = ITEM.split()
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in ITEM)
    plain = "".join(c for c in ZH if c.isalnum())
    return [
        (1, "Intro. " + ITEM), (2, " ".join(words[:9]) + " and so on"), (3, wide.upper()), (4, "​".join(" ".join(words[3:]))), (5, None), (6, " "), (7, LONG + ITEM + LONG), (8, "x " + "。\n".join(plain[:24])),
        (9, plain[:23]), (10, "Intro. " + ITEM), (11, ITEM + ZH), (12, unicodedata.normalize("NFD", ITEM)),
    ]


WANT = [(1, 1), (3, 1), (4, 1), (7, 1), (8, 2), (10, 1), (11, 1), (11, 2), (12, 1)]


def test_leaks(spark, monkeypatch):
    assert leaked(spark, docs_with_parts()) == WANT
    assert leaked(spark, docs_with_parts(), ()) == [] and leaked(spark, []) == []
    monkeypatch.setattr(leaks, "MAX_LOCAL", 0)
    assert leaked(spark, docs_with_parts()) == WANT
    assert leaked(spark, docs_with_parts(), ()) == [] and leaked(spark, []) == []


def edited(rng, words, kind):
    """Two substitutions, one word put in, or one left out, not at the ends."""
    b, at = list(words), int(rng.integers(4, len(words) - 4))
    if kind == "substitute":
        b[at] = b[int(rng.integers(4, len(words) - 4))] = "other"
    elif kind == "insert":
        b.insert(at, "other")
    else:
        b.pop(at)
    return b


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
def test_walks_of_near_windows_meet(kind):
    rng = np.random.default_rng(2)
    plan = leaks.Plan(False, 24, max_edits=2)
    hits, n = 0, 200
    for _ in range(n):
        a = [f"w{x}" for x in rng.integers(0, 400, 30)]
        index = leaks.ItemIndex([(1, " ".join(a))], plan)
        hits += 1 in index.found(leaks._Coder()(edited(rng, a, kind)))
    assert hits / n >= plan.recall - 0.05


def test_near_passages_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = [(f"item {i}", "en", " ".join(f"w{x}" for x in rng.integers(0, 150, 40))) for i in range(6)] + [("zh", "zh", ZH), (None, "en", None)]
    docs = []
    for i in range(90):
        words = items[i % 6][2].split()[5:25]
        for kind in [("substitute", "insert", "delete")[i % 3]] * (1 + i % 2):
            words = edited(rng, words, kind)
        docs.append((f"doc {i}", " ".join([f"w{x}" for x in rng.integers(0, 150, 30)] + words)))
    docs += [("zh doc", ZH[:10] + "新" + ZH[11:]), ("none", None), ("short", "w1 w2")]

    def close(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= 2

    def near(text, item, letters):
        a, b, n = leaks.symbols(text, letters), leaks.symbols(item, letters), 24 if letters else 12
        return any(close(a[i : i + n], b[j : j + n]) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if len({*a[i : i + n]} & {*b[j : j + n]}) >= n // 2 - 3)

    want = {(d, i) for d, t in docs for i, lang, s in items if near(t, s, lang == "zh")}
    frames = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, lang string, text string")
    find = lambda: {tuple(r) for r in leaks.contaminated(*frames, doc_id="doc_id", text="text", item_id="item_id", lang="lang", max_edits=2).collect()}
    got = find()
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 60
    monkeypatch.setattr(leaks, "MAX_LOCAL", 0)
    assert find() == got


def test_close_pairs_equal_the_plain_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (2000, 7)).astype(np.uint64), rng.integers(0, 3, (2000, 7)).astype(np.uint64)
    for most in (0, 1, 2, 3):
        assert leaks.close_pairs(a, b, most).tolist() == [leaks.edit_distance(x, y, most) <= most for x, y in zip(a, b)]


def test_unreachable_recall_is_an_error():
    with pytest.raises(ValueError):
        leaks.Plan(False, 12, max_edits=6, samples=12).tables


# --- p10 ------------------------------------------------------------------------------


CASES = [
    ["Dr. Ann met J. K. Low at 3 p.m. on Monday.", "It cost 3.5 px, i.e. little."], ["By Oct. 21, it moved.", "See Fig. 7 and No. 4."], ["It ended at 7 a.m.", "Then rows, tiles, etc.", "“Stop! Wait!” cried she."],
    ["He wrote, “It fell. Nobody saw,” and left."], ["The line waited ... and then moved.", "Really?!", "Yes…", "Good."], ["(A short aside.)", "Next one."], ["Am 8. März trifft Frau Dr. Rot die Höhe, z. B. bei Nr. 5.", "Version 8.1 zählt Zähler usw.", "Warum?"],
    ["„Es fällt! Wer hält das?“, rief Anna."], ["M. Rosu efface la marge, p. ex. la trame no 748.", "« Tout va. Quel bloc ! » disait Mme Lu."], ["El Sr. Paz unió la zona, p. ej. en la pág. 538.", "¿Por qué?", "¡Qué bien!"],
    ["См. рис. 3 и табл. 4, т. е. поле на 8,3 пикс. после.", "Инженер А. К. Ульев ушёл.", "«Стой! Иди.» — сказал Ровин."],
]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("gap", [" ", "\n", "  ", "\n\n", " \n \n"])
def test_sentences(parts, gap):
    s = gap.join(parts)
    assert [s[a:b] for a, b in sentences.split(s)] == parts


@pytest.mark.parametrize(
    "s,parts",
    [
        ("偏移为 67.57 像素。为什么？他说：“动了。快看！”然后走了。", ["偏移为 67.57 像素。", "为什么？", "他说：“动了。快看！”然后走了。"]), ("なぜ動く？担当者は「動いた。見て！」と言った。", ["なぜ動く？", "担当者は「動いた。見て！」と言った。"]),
        ("डॉ. वेलन ने देखा। कितना नया! क्यों?", ["डॉ. वेलन ने देखा।", "कितना नया!", "क्यों?"]), ("قال د. كارش إن الحد ثابت. لماذا؟ ما أجمل!", ["قال د. كارش إن الحد ثابت.", "لماذا؟", "ما أجمل!"]), ("ขอบคงที่675ครั้ง ป้ายเก่า1.70พิกเซล", ["ขอบคงที่675ครั้ง", "ป้ายเก่า1.70พิกเซล"]),
        ("Heading 7\r\n\r\nＤｒ. Ｂ ｗｅｎｔ. He le­ft.　", ["Heading 7", "Ｄｒ. Ｂ ｗｅｎｔ.", "He le­ft."]), ("no end mark", ["no end mark"]), ("...", ["..."]),
    ],
)
def test_scripts(s, parts):
    assert [s[a:b] for a, b in sentences.split(s)] == parts


@settings(max_examples=100, deadline=None)
@given(st.text("aB .!?\n​“”\"。ก", max_size=60))
def test_sentences_cover_the_text(s):
    spans = sentences.split(s)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(s[a:b] for a, b in spans).split() == "".join(s.split()).split() or "".join("".join(s[a:b].split()) for a, b in spans) == "".join(s.split())


def test_sentence_spans_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n ", 5), (4, "One. Two.", 5), (5, LONG, 5)], "doc_id long, text string, start_at int")
    assert [tuple(r) for r in sentences.sentence_spans(df).orderBy("doc_id", "start_at").collect()] == [(4, 0, 4), (4, 5, 9), (5, 0, len(LONG.strip()))]
    assert sentences.sentence_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,count", [('The screen is 5" wide. It works. The other is 7" wide. It fails.', 4), ('She said "Go. Now." and left. It "fell".', 2), ("He paid for the art. It was not what she had hoped to see.", 2), ("Er ist der Sohn von Prof. Rot und nicht mit auf der Reise.", 1)])
def test_straight_quotes_and_languages(text, count):
    assert len(sentences.split(text)) == count


def test_languages_of_a_paragraph():
    assert sentences.languages("The cat and the dog was here", "latin") == ("en",) and sentences.languages("The cat and der Hund und das Haus", "latin") == sentences.SCRIPTS["latin"]
    assert sentences.languages("", "latin") == sentences.SCRIPTS["latin"] and sentences.languages("дом", "cyrillic") == ("ru",)
