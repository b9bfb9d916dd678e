import random
import re

import numpy as np
import pytest
import xxhash

from murmurate.llm import simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id long, text string, node long, fp string, path int")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """By doc_id the smallest doc_id within reach; every pair is compared."""
    root = {i: i for i, _ in prints if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, f) for i, f in prints if i is not None]
    for k, (i, f) in enumerate(known):
        for j, g in known[:k]:
            if (f ^ g).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def corpus(n=60):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["Über", "THE", "día"]
    out = [(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for k in range(n)]
    base = rng.choices(words, k=800)
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(800)] = rng.choice(words)
        out.append((500 + k, "\n ".join(copy)))
    return out + [(1, None), (2, ""), (3, " \t"), (None, "a b c d e"), (4, "a b c d e"), (5, "A b  c\td e"), (6, "a b c"), (7, "a b c"), (7, "z y x w v"), (8, "z y x w v"), (9, " ".join(base * 60))]


def test_against_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=str) == sorted(((i, f"{fingerprint(t):016x}") for i, t in rows), key=str)
    prints = [(i, fingerprint(t)) for i, t in rows]
    want = components(prints)
    assert want[8] == want[7] == want[6] == 6 and want[2] == 1
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert len({want[500 + k] for k in range(40)}) < 40
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1 << 18, 50])
def test_links_of_planted_neighbours(spark, limit):
    """Neighbours at every distance up to the budget, in a table whose tries are dealt once or many times; a third of all rows is one dense group."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(300):
        for b in rng.choice(64, k % 6, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    dense = np.full(600, base[0])
    for b in range(0, 64, 3):
        dense ^= (rng.random(600) < 0.2).astype(np.uint64) << np.uint64(b)
    values = np.unique(np.concatenate([base, near, dense]))
    rows = spark.createDataFrame([(int(v), k) for k, v in enumerate(values.view(np.int64))], "value long, node long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(rows, limit).collect()]
    root = np.arange(len(values))
    a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
    simhash.join_components(root, a, b)
    want = components([(k, int(v)) for k, v in enumerate(values)])
    assert {k: int(r) for k, r in enumerate(root)} == want
    assert len(links) <= 5 * (1 if limit > 50 else 25) * len(values)


@pytest.mark.parametrize("limit", [5, 1 << 18])
def test_batches_end_anywhere(spark, limit):
    """A trie that spans Arrow batches is walked whole, and a task that fills up many times loses nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        values = [(0x1234 << 48) | (1 << k) for k in range(40)]
        rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "value long, node long")
        links = [(r["a"], r["b"]) for r in simhash.trie_links(rows.selectExpr("0L as path", "value", "node"), 13, limit).collect()]
        root = np.arange(40)
        simhash.join_components(root, *(np.array(x, np.int64) for x in zip(*links, strict=True)))
        assert set(root.tolist()) == {0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_parts_and_turns(spark):
    from pyspark.sql import functions as F

    for left in (64, 51, 12, 10):
        assert sum(n for _, n in simhash.parts(left)) == left and simhash.parts(left)[0][0] == 0
    value = 0x0123456789ABCDEF
    row = spark.range(1).select(*(simhash.turned(F.lit(value), left, by).alias(f"v{left}_{by}") for left, by in ((64, 13), (51, 11), (12, 3)))).first()
    bits = f"{value:064b}"
    for left, by in ((64, 13), (51, 11), (12, 3)):
        low = bits[64 - left :]
        assert row[f"v{left}_{by}"] & (1 << 64) - 1 == int(bits[: 64 - left] + low[by:] + low[:by], 2)
