import collections
import hashlib
import math
import random
import re
import zlib

from murmurate.llm import importance

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id long, text string, score long, stream string, rank string")


def target(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def buckets(t):
    w = words(t)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]]


def brute(rows, texts):
    s = collections.Counter(b for _, t in rows for b in buckets(t))
    q = collections.Counter(b for t in texts for b in buckets(t))
    big_s, big_t = s.total(), q.total()
    gain = lambda b: math.floor(1000 * math.log((q[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, t in rows:
        f = buckets(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t))))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: 25 * len(able) // 100], len(able)


def corpus():
    rng = random.Random(8)
    common = ["the", "Of", "x9", "día", "ÜBER", "naïve", "co-op", "a_b"] + [f"w{k}" for k in range(200)]
    rows = [(k, rng.choice([" ", "\n", ", "]).join(rng.choices(common, k=rng.randint(0, 80)))) for k in range(200)]
    return rows + [(300, None), (301, ""), (302, " .,!"), (303, "one"), (None, rows[3][1] * 3), (304, " ".join(common * 200)), (7, rows[7][1]), (7, rows[7][1])]


def test_against_brute_force(spark):
    rows, texts = corpus(), ["w1 w2 w3 the of " * 30, None, "", "W5 día"]
    got = importance.resample(docs(spark, rows), target(spark, texts)).collect()
    want, drawn, n = brute(rows, texts)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 25 * n // 100 + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_edges(spark):
    assert importance.resample(docs(spark, []), target(spark, ["a b"])).count() == 0
    few = importance.resample(docs(spark, [(1, "a b " * 20), (2, "c")]), target(spark, [])).collect()
    assert {(r["doc_id"], r["rank"]) for r in few} == {(1, None), (2, None)}
    many = importance.resample(docs(spark, [(k, "same words again " * 20) for k in range(40)] + [(5, "same words again " * 20)] * 20), target(spark, ["same words"])).collect()
    assert sorted(r["rank"] for r in many if r["rank"]) == list(range(1, 16))


def test_ranks_over_partitions(spark):
    """Ranks run on from one sorted partition to the next."""
    scored = spark.range(1000).selectExpr("id as doc_id", "1L as n_words", "1L as n_features", "0L as weight", "(id * 7919) % 97 as score", "id as nth")
    got = {r["doc_id"]: r["rank"] for r in importance.ranked(scored.repartition(9), 500).collect()}
    order = sorted(range(1000), key=lambda k: (-(k * 7919 % 97), k))
    assert [got[k] for k in order[:500]] == list(range(1, 501)) and all(got[k] is None for k in order[500:])


def test_streams_round_trip(spark):
    rows = corpus()
    packed = importance.streams(docs(spark, rows).select("doc_id", "text"), "doc_id").collect()
    import numpy as np

    assert sorted([(r["doc_id"], r["n_words"], np.frombuffer(bytes(r["stream"]), np.uint16).tolist()) for r in packed], key=str) == sorted([(i, len(words(t)), _by_position(t)) for i, t in rows], key=str)


def _by_position(t):
    """Features in the order of their first word, the word before the pair."""
    w = words(t)
    out = []
    for k, x in enumerate(w):
        out.append(zlib.crc32(x.encode()) % 10000)
        if k + 1 < len(w):
            out.append(zlib.crc32(f"{x} {w[k + 1]}".encode()) % 10000)
    return out
