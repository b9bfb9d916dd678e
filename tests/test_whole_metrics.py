"""Whole texts, shared vocabularies, hot groups and long recordings, each against a plain version."""

import itertools
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurate.functions import align, bootstrap, keywords, quantiles, whole
from murmurate.functions.der import best_total, bootstrap_ci, diarization_error


# ---- alignment ------------------------------------------------------------------
def table_operations(ref, hyp):
    """The whole table and its way back."""
    n, m = len(ref), len(hyp)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, s, e, k = n, m, 0, 0, 0
    while i and j:
        cost = ref[i - 1] != hyp[j - 1]
        if d[i - 1][j - 1] + cost == d[i][j]:
            s, i, j = s + cost, i - 1, j - 1
        elif d[i - 1][j] + 1 == d[i][j]:
            e, i = e + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, e + i, k + j


def test_operations_against_table():
    rng = random.Random(1)
    for _ in range(1500):
        r, h = ("".join(rng.choices("abcd"[:k], k=rng.randint(0, 40))) for k in (3, 4))
        assert whole.operations(r, h) == table_operations(r, h)
        assert sum(whole.operations(r, h)) == whole.edits(r, h)


def test_operations_against_fold(spark):
    rng = random.Random(2)
    rows = [(k, rng.choices("abc", k=rng.randint(0, 14)), rng.choices("abc", k=rng.randint(0, 14))) for k in range(150)]
    df = spark.createDataFrame(rows, "k int, r array<string>, h array<string>").repartition(4)
    for x in df.select(align.alignment(F.col("r"), F.col("h")).alias("f"), whole.alignment(F.col("r"), F.col("h")).alias("w")).collect():
        assert [x["f"]["s"], x["f"]["d"], x["f"]["i"]] == list(x["w"])


def test_operations_of_long_texts(spark):
    rng = random.Random(3)
    ref = rng.choices([f"w{k}" for k in range(3000)], k=20000)
    hyp = [w if k % 13 else "x" for k, w in enumerate(ref) if k % 11]
    s, d, i = whole.operations(ref, hyp)
    assert (s + d + i, d - i) == (whole.edits(ref, hyp), len(ref) - len(hyp))
    assert whole.operations(ref, ref) == (0, 0, 0) and whole.operations(ref, []) == (0, 20000, 0) and whole.operations([], ref) == (0, 0, 20000)
    got = spark.createDataFrame([(None, ["a"]), (["a"], ["a", "b"])], "r array<string>, h array<string>").select(whole.alignment(F.col("r"), F.col("h")).alias("a")).collect()
    assert [r["a"] for r in got] == [None, [0, 0, 1]]


# ---- keywords -------------------------------------------------------------------
def plain_hits(text, kws):
    """Keywords as strings or objects."""
    hit = 0
    for k in kws:
        names = [k] if isinstance(k, str) else k.get("aliases") or [k.get("surface", "")]
        hit += any(n and n in text for n in names)
    return hit, len(kws)


def test_keyword_rules(spark):
    import json

    cases = [
        ("阿司匹林对头痛有效", [{"aliases": ["阿斯匹林", "阿司匹林"]}, {"aliases": ["布洛芬"]}], (1, 2)),
        ("上海到北京的高铁", ["上海", "北京", "广州"], (2, 3)),
        ("随便说点什么", [], (0, 0)),
        ("打开空调", [{"surface": "空调"}], (1, 1)),
        ("category", ["cat", "", {"surface": "", "aliases": []}, {}], (1, 4)),
        ("", ["a"], (0, 1)),
    ]
    df = spark.createDataFrame([(t, json.dumps(k, ensure_ascii=False)) for t, k, _ in cases], "t string, k string").coalesce(1)
    got = df.select(keywords.hits(F.col("t"), keywords.parsed(F.col("k"))).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [w for *_, w in cases] == [plain_hits(t, k) for t, k, _ in cases]
    none = spark.createDataFrame([(None, None)], "t string, k string").select(keywords.hits(F.col("t"), keywords.parsed(F.col("k"))).alias("x")).first()
    assert tuple(none["x"]) == (0, 0)


@pytest.mark.parametrize("limit", [keywords.AUTOMATON_BYTES, 40])
def test_shared_vocabulary(spark, limit):
    """One automaton, and a vocabulary that is dealt into many."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcä ", k=n))
    vocabulary = {k: [text(rng.randint(1, 5)) for _ in range(rng.randint(1, 3))] + [""] for k in range(60)}
    texts = [(k, text(rng.randint(0, 60)), text(rng.randint(0, 60)), 5) for k in range(80)] + [(900, None, "abc", 5), (901, "abc", None, 5)]
    a = spark.createDataFrame([(k, n) for k, names in vocabulary.items() for n in names] + [(None, "a")], "keyword long, alias string")
    got = keywords.shared(spark.createDataFrame(texts, "id int, r string, h string, keyword_ int"), "r", "h", a, limit)
    assert got.columns == ["id", "keyword_", "keyword", "hit"]
    said = lambda t, names: any(n and n in (t or "") for n in names)
    want = {(i, k, said(h, names)) for i, r, h, _ in texts for k, names in vocabulary.items() if said(r, names)}
    rows = [(r["id"], r["keyword"], r["hit"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert keywords.shared(spark.createDataFrame(texts, "id int, r string, h string, x int"), "r", "h", a.limit(0)).count() == 0


# ---- quantiles ------------------------------------------------------------------
WANTED = {"e5": quantiles.exclusive(5), "e50": quantiles.exclusive(50), "e95": quantiles.exclusive(95), "i99": quantiles.inclusive(0.99), "near": quantiles.nearest_rank(0.95)}


def check_quantiles(row, values):
    v = sorted(values)
    q, qi = statistics.quantiles(v, n=100), statistics.quantiles(v, n=100, method="inclusive")
    assert row["n"] == len(v) and row["near"] == v[round((len(v) - 1) * 0.95)]
    assert [row["e5"], row["e50"], row["e95"], row["i99"]] == pytest.approx([q[4], q[49], q[94], qi[98]], rel=1e-12)


@pytest.mark.parametrize("limit", [100, quantiles.SORTED])
def test_quantiles_of_hot_groups(spark, limit):
    """Sorted and selected groups agree with the standard library: a skewed group, one of ties, one with far outliers, small ones."""
    rng = random.Random(5)
    groups = {
        "skewed": [rng.lognormvariate(0, 6) for _ in range(4000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(3000)],
        "outliers": [rng.random() for _ in range(2000)] + [1e308, -1e308],
        "small": [float(k) for k in range(7)],
        None: [1.0, 2.5],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("skewed", None), ("none", None), ("nan", float("nan")), ("one", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.exact(df, ["g"], "v", WANTED, limit).collect()}
    assert set(got) == {*groups, "one"}
    for g, values in groups.items():
        check_quantiles(got[g], values)
    assert (got["one"]["e95"], got["one"]["near"]) == (2.0, 2.0)


def test_quantiles_of_the_whole_table(spark):
    values = [float(k * 7919 % 10007) for k in range(10007)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    check_quantiles(quantiles.exact(df, [], "v", WANTED, 1000).first(), values)
    ends = spark.createDataFrame([(float(s) * float("inf"),) for s in (-1, 1) for _ in range(700)] + [(float(k),) for k in range(3000)], "v double")
    assert quantiles.exact(ends, [], "v", {"m": quantiles.nearest_rank(0.5)}, 1000).first()["m"] == 1500.0
    assert quantiles.exact(df.limit(0), [], "v", WANTED).count() == 0


def test_percentile_rules(spark):
    got = quantiles.exact(spark.createDataFrame([(0.3,), (1.3,)], "v double"), [], "v", {"p": quantiles.exclusive(95), "k": quantiles.nearest_rank(0.5)}).first()
    assert got["p"] == pytest.approx(2.15) and got["k"] == 0.3


# ---- bootstrap ------------------------------------------------------------------
def weight(key, turn, seed):
    p = bootstrap.PRIME
    x0 = key % p
    x1 = (x0 * 48271 + turn * 69621 + seed) % p
    x2 = (x1 * x1 + x0 * 16807 + turn) % p
    x3 = (x2 * x2 + x1 * 40692 + seed) % p
    return sum(x3 >= s for s in bootstrap.STEPS)


def test_poisson_weights(spark):
    """The weights are those of the formula, and Poisson distributed in every row and every round."""
    rows = spark.range(400).crossJoin(spark.range(300).withColumnRenamed("id", "turn")).select("id", "turn", bootstrap.poisson(F.col("id"), F.col("turn"), 42).alias("w"))
    w = np.zeros((400, 300), int)
    for r in rows.collect():
        w[r["id"], r["turn"]] = r["w"]
    assert all(w[i, t] == weight(i, t, 42) for i, t in itertools.product(range(0, 400, 37), range(0, 300, 29)))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.abs(share - [0.36788, 0.36788, 0.18394, 0.06131, 0.01533]).max() < 0.005
    assert np.abs(np.corrcoef(w)[np.triu_indices(400, 1)]).mean() < 0.06 and np.abs(np.corrcoef(w.T)[np.triu_indices(300, 1)]).mean() < 0.05


def test_poisson_interval(spark):
    """Against the formula in plain Python, and about as wide as the interval of drawn rows."""
    rng = random.Random(6)
    rows = [(k, "a" if k % 3 else "b", rng.randint(0, 9), rng.randint(10, 20)) for k in range(300)] + [(999, "one", 1, 2), (1000, "zero", 1, 0), (1001, "zero", 1, 0)]
    got = {r["g"]: r for r in bootstrap.poisson_interval(spark.createDataFrame(rows, "k long, g string, num long, den long"), ["g"], "k", "num", "den", 200, 7).collect()}
    for g in "ab":
        own = [(k, n, d) for k, h, n, d in rows if h == g]
        stats = sorted(sum(weight(k, t, 7) * n for k, n, _ in own) / sum(weight(k, t, 7) * d for k, _, d in own) for t in range(200))
        assert (got[g]["lo"], got[g]["hi"], got[g]["n"]) == (stats[5], stats[195], len(own))
        lo, hi = bootstrap_ci([n for _, n, _ in own], [d for *_, d in own], 1000)
        assert 0.6 < (got[g]["hi"] - got[g]["lo"]) / (hi - lo) < 1.6
    assert got["one"]["lo"] is None and (got["zero"]["lo"], got["zero"]["hi"]) == (0.0, 0.0)


# ---- diarization ----------------------------------------------------------------
def test_assignment_against_permutations():
    rng = np.random.default_rng(7)
    for _ in range(200):
        g = rng.integers(0, 9, rng.integers(1, 6, 2)).astype(float)
        wide = g if g.shape[0] <= g.shape[1] else g.T
        want = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert best_total(g) == pytest.approx(want)


def grid_error(ref, hyp, step=0.5):
    """Frame by frame, over every map of speakers."""
    frames = [(k + 0.5) * step for k in range(80)]
    at = lambda turns, t: {k for s, e, k in turns if s <= t < e}
    pairs = [(at(ref, t), at(hyp, t)) for t in frames]
    names_r, names_h = sorted({k for *_, k in ref}), sorted({k for *_, k in hyp})
    if len(names_r) > len(names_h):
        pairs, names_r, names_h = [(h, r) for r, h in pairs], names_h, names_r
    wrong = sum(max(len(r), len(h)) for r, h in pairs) * step
    right = max(sum((names_r[i] in r and m[i] in h) for r, h in pairs for i in range(len(names_r))) * step for m in itertools.permutations(names_h, len(names_r)))
    return (wrong - right) / sum(e - s for s, e, _ in ref)


def test_diarization_against_frames():
    rng = random.Random(8)
    turns = lambda who: [(s := rng.randint(0, 60) / 2, s + rng.randint(0, 12) / 2, rng.choice(who)) for _ in range(rng.randint(1, 9))]
    for _ in range(150):
        ref, hyp = turns("abc"), turns("xyzw")
        if sum(e - s for s, e, _ in ref) > 0:
            assert diarization_error(ref, hyp) == pytest.approx(grid_error(ref, hyp))


def test_diarization_of_a_long_meeting():
    rng = random.Random(9)
    ref = [(k * 1.0, k + rng.uniform(0.5, 2.5), f"r{rng.randrange(40)}") for k in range(10000)]
    hyp = [(s + 0.1, e + 0.1, f"h{k[1:]}") for s, e, k in ref]
    began = time.time()
    assert 0 < diarization_error(ref, hyp) < 0.3 and time.time() - began < 5
    assert diarization_error(ref, [(s, e, "x" + k) for s, e, k in ref]) == pytest.approx(0, abs=1e-9)


def test_suggested_errors(spark, tmp_path):
    from murmurate.functions.der import diff_blocks
    from murmurate.plans import catalog, scores  # noqa: F401

    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 60))), "en", "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in catalog.whole_pairs(spark, str(tmp_path)).collect():
        b = diff_blocks(" ".join(r["ref"]), " ".join(r["hyp"]))
        want[r["doc_id"]] = whole.edits(r["ref"], r["hyp"]) / len(r["ref"]) >= 0.5 or len(b) >= 6 or any(x[4] for x in b)
    got = {r["doc_id"]: r["suggested"] for r in catalog.QUERIES["suggested_errors"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(got.values())) == 2
