"""The suffix array of contexts: order, ties and the work it takes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from murmurate.llm import substrings


def contexts(rng, n, width, letters):
    """Contexts of a few anchors: (text, owned starts, place of the anchor, anchor)."""
    out = []
    for _ in range(n):
        fp = rng.randint(0, 3)
        at = rng.randint(0, width // 2)
        own = rng.randint(1, at + 1)
        core = random.Random(fp)
        body = "".join(rng.choice(letters) if rng.random() < 0.02 else "ab"[core.randint(0, 1)] for _ in range(3 * width))
        lead = body[width - at : width]
        size = max(own, rng.choice([own + width - 1, rng.randint(at + 1, at + 1 + width)]))
        out.append(((lead + body[width:])[:size].encode(), own, at, fp))
    return out


@pytest.mark.parametrize("width", [9, 16, 23, 40, 100])
def test_suffix_array_by_anchor(width):
    rng = random.Random(width)
    for turn in range(20):
        rows = contexts(rng, 1 if turn == 0 else 60, width, "abc")
        size, own, at, fp = (np.array([len(r[0]) if k == 0 else r[k] for r in rows]) for k in range(4))
        begin = np.cumsum(size + 1) - (size + 1)
        buf = np.frombuffer(b"".join(r[0] + b"\0" for r in rows), np.uint8)
        word = substrings._words(buf)
        order, rank, fresh = substrings.suffix_array(word, begin, size, own, at, fp, width)
        who = np.searchsorted(begin, order, "right") - 1
        text = [rows[c][0][s - begin[c] :][:width] for s, c in zip(order, who, strict=True)]
        group = [(fp[c], at[c] - (s - begin[c])) for s, c in zip(order, who, strict=True)]
        assert sorted(order) == [b + k for b, o in zip(begin, own, strict=True) for k in range(o)]
        assert len(set(group)) == fresh.sum()
        shared = substrings.common_prefixes(word, order, rank, fresh, begin, own, width)
        for k in range(1, len(order)):
            assert fresh[k] == (group[k] != group[k - 1])
            same = group[k] == group[k - 1] and text[k] == text[k - 1]
            assert same == (rank[order[k]] == rank[order[k - 1]])
            if not fresh[k]:
                assert text[k - 1] <= text[k]
                if not same:
                    x, y = text[k - 1] + b"\0", text[k] + b"\0"
                    assert shared[k] == next(i for i in range(width) if x[i : i + 1] != y[i : i + 1])
            else:
                assert shared[k] == 0


def test_a_shard_sorts_few_places(monkeypatch):
    """All bytes of the contexts were sorted, several times."""
    rng = random.Random(3)
    texts, fps = [], []
    for fp in range(150):
        base = "".join(rng.choice("etaoin shrdlu") for _ in range(440))
        texts += [base, base[:380] + "x" * 60, "y" * 15 + base[15:]]
        fps += [fp] * 3
    n = len(texts)
    t = pa.table({"fp": pa.array(fps, pa.int64()), "row": pa.array(range(n), pa.int64()), "lo": pa.array([0] * n, pa.int64()), "n": pa.array([1] * n, pa.int64()), "parts": pa.array([1] * n, pa.int64()), "opens": [True] * n, "context": pa.array([x.encode() for x in texts], pa.binary()), "own": pa.array([41] * n, pa.int64()), "at": pa.array([100] * n, pa.int64())})
    sorted_places, plain = [0], np.argsort

    def argsort(a, *args, **kwargs):
        sorted_places[0] += len(a)
        return plain(a, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", argsort)
    marks = substrings._shard(400, 51, 1)(t)
    assert sorted_places[0] < 1.2 * sum(map(len, texts))
    # the base and its copy with another head share the starts from 15 on; the other tail shares none
    got = {(r["row"], r["lo"], r["hi"]) for r in marks.to_pylist() if r["kind"] == substrings.BYTES}
    assert got == {(3 * k + j, 15, 40) for k in range(150) for j in (0, 2)}
