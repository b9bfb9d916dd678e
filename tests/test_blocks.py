"""Blocks of many pairs at once against difflib, and their cost."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from murmurate.functions import blocks


def pairs():
    rng = random.Random(1)
    for t in range(200):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        yield a, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) if t % 2 else "".join(c if rng.random() > 0.1 else rng.choice(["", "z", c + "é"]) for c in a)
    for _ in range(30):  # repeated lines
        a = (" ".join(rng.choice("the of a house river Ökonom x9".split()) for _ in range(rng.randint(1, 9))) + "\n") * rng.randint(1, 25)
        yield a, " ".join(x for k, x in enumerate(a.split(" ")) if (k + 3) % 11)


@pytest.mark.parametrize("chunk, joined", [(blocks.CHUNK, blocks.JOINED), (1 << 12, 300), (100, 20)])
def test_blocks_are_those_of_difflib(chunk, joined):
    refs, hyps = zip(*pairs(), strict=True)
    for a, b, found in zip(refs, hyps, blocks.matching(refs, hyps, chunk, joined), strict=True):
        joint = []
        for i, j, n in found:
            if joint and (i, j) == (joint[-1][0] + joint[-1][2], joint[-1][1] + joint[-1][2]):
                i, j, n = joint[-1][0], joint[-1][1], joint.pop()[2] + n
            joint.append((i, j, n))
        assert joint == difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]


def test_cost_of_long_texts():
    """Words taken out and replaced all over a long text: a search for each block took 30 microseconds a character."""
    rng = random.Random(2)
    a = [rng.choice([f"w{rng.randint(0, 900)}", "of", "house"]) for _ in range(30_000)]
    b = ["x" if k % 13 == 0 else w for k, w in enumerate(a) if k % 11]
    ref, hyp = " ".join(a), " ".join(b)
    start = time.process_time()
    blocks.matching([ref], [hyp])
    assert time.process_time() - start < 10e-6 * len(ref)


def test_null_text_has_no_blocks(spark):
    from murmurate.plans.more import blocks as column

    rows = spark.createDataFrame([(1, "a b", "a c"), (2, None, None)], "id long, r string, h string")
    got = {r["id"]: r["c"] for r in rows.select("id", column(F.col("r"), F.col("h")).alias("c")).collect()}
    assert (got[1]["blocks"], got[1]["large"]) == (1, 0) and (got[2] is None or got[2]["blocks"] is None)
