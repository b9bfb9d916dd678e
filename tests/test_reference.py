import pytest
from pyspark.sql import functions as F

from murmurate.functions import align, textnorm, whole
from murmurate.functions.der import bootstrap_ci, diarization_error, diff_blocks
from murmurate.operators import curation, logs, ranking
from murmurate.streaming import trace


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(text):
    return F.array(*[F.lit(c) for c in text]) if text else F.array().cast("array<string>")


@pytest.mark.parametrize("ref,hyp,edits,sub,dele,ins", [("今天天气好", "今天天气坏", 1, 1, 0, 0), ("我用iphone", "我用安卓", 6, 2, 4, 0), ("", "今天", 2, 0, 0, 2), ("好", "今天天气好", 4, 0, 0, 4), ("", "", 0, 0, 0, 0)])
def test_alignment(spark, ref, hyp, edits, sub, dele, ins):
    r = one(spark, whole.edit_distance(F.lit(ref), F.lit(hyp)).alias("e"), align.alignment(arr(ref), arr(hyp)).alias("a"), whole.alignment(arr(ref), arr(hyp)).alias("w"))
    assert r["e"] == edits and (r["a"]["s"], r["a"]["d"], r["a"]["i"]) == (sub, dele, ins) and list(r["w"]) == [sub, dele, ins]


@pytest.mark.parametrize("text,want", [("今天天氣很好。", "今天天气很好"), ("１２３", "一百二十三"), ("2023年", "二零二三年"), ("100%", "百分之一百"), ("他女儿在那边儿玩儿", "他女儿在那边玩"), ("呃 我 用 iPhone 12 啊", "我用iphone十二"), ("花了12.5元，3块5", "花了十二点五元三块五"), ("电话 13812345678 或 010-12345678 。", "电话一三八一二三四五六七八或零一零一二三四五六七八"), ("1/2 的 200 个", "二分之一的两百个"), ("B2B 和 102", "b2b和一百零二"), ("<SPOKEN_NOISE>the end", "the end"), ("", ""), (None, None)])
def test_chinese(spark, text, want):
    assert one(spark, textnorm.chinese_text(F.lit(text).cast("string")).alias("t"))["t"] == want


def test_chinese_numbers():
    """Read back by a plain parser of words."""
    digit = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2}

    def read(words):
        total = section = number = 0
        for c in words:
            if c in digit:
                number = digit[c]
            elif c in "十百千":
                section += (number or 1) * {"十": 10, "百": 100, "千": 1000}[c]
                number = 0
            else:
                total = (total + section + number) * (10**8 if c == "亿" else 10**4) if c == "亿" else total + (section + number) * 10**4
                section = number = 0
        return total + section + number

    for n in [*range(2000), 10**4, 10**5 + 2, 20000, 20222, 10**8, 2 * 10**8 + 3, 12345678, 210000]:
        assert read(textnorm.chinese_number(str(n))) == n, n
    assert textnorm.chinese_number("0.05") == "零点零五" and textnorm.chinese_number("007") == "零七" and textnorm.chinese_number("222") == "两百二十二"


@pytest.mark.parametrize("code,norm,metric", [("ar", "basic", "WER"), ("id", "basic", "WER"), ("sv", "zh", "CER"), ("uk", "zh", "CER"), ("en-US", "zh", "CER"), ("ja", "ja", "CER"), ("ko", "basic", "CER"), ("yue", "zh", "CER"), (None, "zh", "CER")])
def test_router(spark, code, norm, metric):
    r = one(spark, textnorm.router(F.lit(code).cast("string")).alias("r"))["r"]
    assert (r["norm"], r["metric"]) == (norm, metric)


def test_basic_and_japanese(spark):
    r = one(spark, textnorm.basic(F.lit("Ａｂ  c-ﾊ①!")).alias("b"), textnorm.japanese(F.lit("今日 は。.")).alias("j"))
    assert r["b"] == "ab c ハ1" and r["j"] == "今日は"


def test_log_rules(spark):
    rows = [("a", 1, True, "x"), ("a", 2, True, "y"), ("a", 3, False, "z"), ("b", 4, False, "p"), ("b", 5, False, "q"), ("__meta__", 0, None, None)]
    log, meta = logs.sessions(spark.createDataFrame(rows, "id string, line_no int, ok boolean, hyp string"))
    assert {(r["id"], r["hyp"]) for r in logs.latest(log).collect()} == {("a", "y"), ("b", "p")} and meta.count() == 1
    assert [r["id"] for r in logs.todo(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), log).orderBy("id").collect()] == ["b", "c"]
    runs = logs.failure_runs(log, "id", "line_no", "ok", 2).collect()
    assert [(r["by"], r["first_line"], r["length"]) for r in runs] == [("b", 4, 2)]


def test_split_is_disjoint(spark):
    rows = spark.createDataFrame([("d", f"s{i % 7}", i) for i in range(70)], "ds string, spk string, id int")
    out = curation.group_split(rows, "ds", "spk", 0.3, 42)
    assert out.groupBy("spk").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert out.where("split = 'validation'").select("spk").distinct().count() == 2
    assert curation.cap_per(rows, F.col("spk"), 3, "id").count() == 21


def test_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "arm string, v double")
    got = {r["arm"]: r["score"] for r in ranking.rank_score(df, "v").collect()}
    assert got == {"a": 0.75, "b": 0.75, "c": 0.0}
    d = spark.createDataFrame([(0.5, None, 1.0), (None, None, None)], "quality double, latency double, cost double")
    weights = {"quality": 0.5, "latency": 0.25, "cost": 0.1}
    assert [r["c"] for r in d.select(ranking.composite(weights).alias("c")).collect()] == [pytest.approx(0.35 / 0.6), None]


def test_python_metrics():
    assert diarization_error([(0, 10, "a"), (10, 20, "b")], [(0, 10, "x"), (10, 20, "y")]) == 0
    assert diarization_error([(0, 10, "a")], [(0, 5, "x")]) == pytest.approx(0.5)
    assert diarization_error([], [(0, 1, "x")]) is None
    assert diff_blocks("abcdef", "abXdeY") == [(2, 3, 2, 3, False), (5, 6, 5, 6, False)]
    assert bootstrap_ci([1.0], [2.0]) is None
    lo, hi = bootstrap_ci([1, 0, 1, 0], [1, 1, 1, 1], 200)
    assert 0 <= lo <= hi <= 1


def test_queries_without_llm():
    """The entry point without the llm folder and the pipeline file."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "murmurate.llm" or name.startswith("murmurate.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert len(q) > 100 and not [n for n in q if n.startswith("op") and n[2].isdigit()] and "pipeline" not in q, sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_whole_texts(spark, tmp_path):
    """Words past the fortieth count, and each figure is that of a plain table of cells."""
    import difflib
    import math
    import random
    from collections import Counter

    from murmurate.functions import whole
    from murmurate.functions.der import Matcher
    from murmurate.plans import catalog, more  # noqa: F401

    def cells(a, b):
        prev, sub = list(range(len(b) + 1)), [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            cur, best = [i], [0]
            for j, y in enumerate(b, 1):
                cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
                best.append(sub[j - 1] + 1 if x == y else max(best[-1], sub[j]))
            prev, sub = cur, best
        return prev[-1], sub[-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert (whole.edits(a, b), whole.subsequence(a, b)) == cells(a, b)
        assert Matcher(None, a, b, autojunk=False).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    texts = {i: " ".join(rng.choice("the of a house river Ökonom x9".split()) for _ in range(n)) for i, n in enumerate([0, 1, 30, 150, 400])}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    pair = {r["doc_id"]: (r["ref"], r["hyp"]) for r in catalog.whole_pairs(spark, str(tmp_path)).collect()}
    assert [len(pair[i][0]) for i in (0, 1)] == [0, 1] and len(pair[4][0]) >= 400
    want = {i: cells(*p) for i, p in pair.items()}
    assert {r["doc_id"]: r["edits"] for r in run("alignment_counts")} == {i: w[0] for i, w in want.items()}
    assert {r["doc_id"]: r["lcs"] for r in run("rouge_lcs")} == {i: w[1] for i, w in want.items()}
    wer = run("edit_wer_by_lang")[0]
    assert (wer["ref_len"], wer["edits"]) == (sum(len(r) for r, _ in pair.values()), sum(w[0] for w in want.values()))
    chars = {i: ("".join(r), "".join(h)) for i, (r, h) in pair.items()}
    assert {r["doc_id"]: r["edits"] for r in run("cer_pairs")} == {i: cells(*c)[0] for i, c in chars.items() if c[0]}
    hit = lambda a, b, n: ((x := Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))) & (y := Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1)))).total() * 1j + y.total()
    p = [sum(hit(r, h, n) for r, h in pair.values()) for n in range(1, 5)]
    r, h = (sum(len(x[k]) for x in pair.values()) for k in (0, 1))
    assert run("bleu_corpus")[0]["bleu"] == pytest.approx(100 * math.exp(sum(math.log(x.imag / x.real) for x in p) / 4 + min(0, 1 - r / h)))
    p = [sum(hit(a, b, n) for a, b in chars.values()) for n in range(1, 7)]
    q = [sum(hit(b, a, n) for a, b in chars.values()) for n in range(1, 7)]
    p, q = (sum(x.imag / x.real for x in v) / 6 for v in (p, q))
    assert run("chrf_corpus")[0]["chrf"] == pytest.approx(500 * p * q / (4 * p + q))
    for x in run("rouge_unigram"):
        a, b = pair[x["doc_id"]]
        assert x["rouge1"] == (pytest.approx(2 * hit(a, b, 1).imag / (len(a) + len(b))) if a or b else None)
    base = {i: [o for o in difflib.SequenceMatcher(None, " ".join(a), " ".join(b), autojunk=False).get_opcodes() if o[0] != "equal"] for i, (a, b) in pair.items()}
    merged = lambda ops: sum(k == 0 or o[1] - ops[k - 1][2] > 1 for k, o in enumerate(ops))
    assert {x["doc_id"]: x["blocks"] for x in run("changed_blocks")} == {i: merged(o) for i, o in base.items()}


def test_zh_norm_reads_whole_texts(spark, tmp_path):
    from murmurate.plans import catalog, more  # noqa: F401

    text = "很" * 500 + "2023年"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["norm"] for r in catalog.QUERIES["zh_norm"](spark, str(tmp_path)).collect()} == {1: "很" * 500 + "二零二三年", 2: None}


def test_bootstrap_rounds(spark, tmp_path):
    """Order statistics 25 and 975 of 1000 rounds over whole texts."""
    import random

    from murmurate.functions import whole
    from murmurate.plans import catalog, more  # noqa: F401

    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 120))), "en", "s") for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    p = [("".join(r["ref"]), "".join(r["hyp"])) for r in catalog.whole_pairs(spark, str(tmp_path)).orderBy("doc_id").collect()]
    e, draw, stats = [whole.edits(*x) for x in p], random.Random(42), []
    for _ in range(1000):
        pick = draw.choices(range(25), k=25)
        stats.append(sum(e[i] for i in pick) / sum(len(p[i][0]) for i in pick))
    stats.sort()
    got = catalog.QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()
    assert (got["lo"], got["hi"]) == (pytest.approx(stats[25], abs=1e-12), pytest.approx(stats[975], abs=1e-12))


def test_bleu(spark):
    """Tokenisers by hand, and scores by plain arithmetic."""
    import math

    from murmurate.functions import bleu

    r = one(spark, bleu.words(F.lit('He said: "1,000.5 is 3-4," &amp; left.\nOk')).alias("w"), bleu.characters(F.lit("我用iPhone，好。")).alias("c"), bleu.by_character(F.lit("今天 ok")).alias("z"), bleu.by_character(F.lit("plain")).alias("p"))
    assert r["w"] == ["He", "said", ":", '"', "1,000.5", "is", "3", "-", "4", ",", '"', "&", "left", ".", "Ok"]
    assert r["c"] == ["我", "用", "iPhone", "，", "好", "。"] and r["z"] and not r["p"]
    f = lambda hits, totals, ref, hyp: one(spark, bleu.score([F.lit(float(x)) for x in hits], [F.lit(float(x)) for x in totals], F.lit(float(ref)), F.lit(float(hyp))).alias("b"))["b"]
    assert f((4, 3, 2, 1), (5, 4, 3, 2), 5, 5) == pytest.approx(100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    assert f((4, 0, 0, 1), (5, 4, 3, 2), 10, 5) == pytest.approx(100 * math.exp(-1) * (4 / 5 * 1 / 8 * 1 / 12 * 1 / 2) ** 0.25)
    assert f((1, 0, 0, 0), (2, 1, 0, 0), 2, 2) == 0.0
