import io
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurate.sources import archives, audio, corpora


def wav(x, rate=16000, bits=16, tag=1, extensible=False):
    """A file written by hand; x has a row for each frame."""
    x = np.asarray(x, float).reshape(len(x), -1 if np.ndim(x) > 1 else 1)
    whole = np.clip(np.round(x * (1 << bits - 1)), -(1 << bits - 1), (1 << bits - 1) - 1).astype(np.int64) if tag == 1 else None
    if tag == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (whole + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(int(v).to_bytes(3, "little", signed=True) for v in whole.ravel())
    else:
        data = whole.astype(f"<i{bits // 8}").tobytes()
    n = x.shape[1]
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, n, rate, rate * n * bits // 8, n * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", tag) + b"\x00\x00\x00\x00\x10\x00\x80\x00\x00\xaa\x008\x9bq"
    body = b"WAVE" + b"LIST\x03\x00\x00\x00abc\x00" + b"fmt " + len(form).to_bytes(4, "little") + form + b"data" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + len(body).to_bytes(4, "little") + body


TONE = 0.1 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)


@pytest.mark.parametrize("bits,tag,extensible", [(8, 1, False), (16, 1, False), (24, 1, False), (32, 1, True), (16, 1, True), (32, 3, False), (64, 3, False)])
def test_formats(bits, tag, extensible):
    m = audio.measure(wav(TONE, bits=bits, tag=tag, extensible=extensible))
    assert (m["sample_rate"], m["channels"], m["frames"], m["actual_s"]) == (16000, 1, 16000, 1.0)
    assert m["peak"] == pytest.approx(0.1, abs=0.005) and m["rms"] == pytest.approx(0.1 / 2**0.5, abs=0.002) and m["clip"] == 0
    both = audio.measure(wav(np.stack([TONE, -TONE], 1), bits=bits, tag=tag, extensible=extensible))
    assert both["channels"] == 2 and both["rms"] < 0.005  # channels are averaged


def test_against_the_standard_library():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [-32768, -32768], [32767, 32767], [0, 0]], "<i2").tobytes())
    x, rate = audio.samples(raw.getvalue())
    assert rate == 8000 and x.tolist() == (np.array([[100, 300], [-32768, -32768], [32767, 32767], [0, 0]]) / 32768).tolist()
    m = audio.measure(raw.getvalue())
    assert (m["peak"], m["clip"], m["zero"]) == (1.0, 0.5, 0.25) and m["rms"] == pytest.approx(np.sqrt(np.mean([(200 / 32768) ** 2, 1, (32767 / 32768) ** 2, 0])))


def test_broken_headers():
    good = wav(TONE)
    assert audio.measure(good[:-1])["frames"] == 15999  # a frame that is cut off
    at = good.index(b"data")
    endless = good[: at + 4] + b"\xff\xff\xff\xff" + good[at + 8 :]
    assert audio.measure(endless)["frames"] == 16000
    for bad in (None, b"", b"RIFF", b"ID3" + good, good[:40], good[:at], good.replace(b"fmt ", b"xxxx"), good[: good.index(b"fmt ") + 8] + struct.pack("<HHIIHH", 7, 1, 8000, 8000, 1, 8) + good[at:], good[: good.index(b"fmt ") + 8] + struct.pack("<HHIIHH", 1, 0, 8000, 8000, 0, 8) + good[at:]):
        assert set(audio.measure(bad)) == {"decode_error"}, bad
    empty = audio.measure(wav([]))
    assert (empty["frames"], empty["peak"], empty["zero"], empty["actual_s"]) == (0, 0.0, 1.0, 0.0)


def test_screening(spark, tmp_path):
    """Decisions from bytes alone."""
    loud = np.where(np.arange(16000) % 2, 1.0, -1.0)
    rows = [
        ("clean", wav(TONE), 1.0, "zh", "你好世界", "keep", []),
        ("silent", wav(np.zeros(16000)), 1.0, "zh", "你好", "reject", ["near_silent", "many_zero_samples"]),
        ("longer", wav(TONE), 2.0, "zh", "你好世界", "reject", ["duration_mismatch"]),
        ("clipped", wav(loud), 1.0, "zh", "你好世界", "review", ["heavy_clipping"]),
        ("short", wav(TONE[:1600]), 0.1, "zh", "好", "review", ["ultra_short_under_0.2s"]),
        ("narrow", wav(TONE, rate=4000), 4.0, "en", "<b> two words", "review", ["label_markup", "low_sample_rate"]),
        ("broken", b"not audio", 1.0, "zh", "你好", "reject", ["decode_error"]),
        ("none", None, 1.0, "zh", "你好", "reject", ["decode_error"]),
    ]
    d = spark.createDataFrame([r[:5] for r in rows], "id string, bytes binary, expected double, lang string, text string")
    got = {r["id"]: r for r in audio.screened(d, "bytes", "expected", "lang", "text").collect()}
    for name, *_, decision, flags in rows:
        assert (got[name]["decision"], list(got[name]["flags"])) == (decision, flags), name
    assert got["broken"]["decode_error"] and got["broken"]["frames"] is None and got["clean"]["frames"] == 16000
    (tmp_path / "a.wav").write_bytes(wav(TONE))
    (tmp_path / "b.wav").write_bytes(b"x")
    files = {r["file"]: r["frames"] for r in audio.wav_files(spark, str(tmp_path)).collect()}
    assert files == {"a.wav": 16000, "b.wav": None}
    assert spark.range(1).select(audio.dbfs(F.lit(0.1)).alias("d")).first()["d"] == -20.0


def test_archives_in_ranges(spark, tmp_path):
    """Ranges of whole members: every member once, whatever the size of a range, and the same from tar, zip and compressed tar."""
    data = {f"w/u{k}.wav": bytes([k]) * (k * 137 % 3000) for k in range(60)} | {"w/no.txt": b"no", "ä" * 80 + ".wav": b"long name"}
    with tarfile.open(tmp_path / "a.tar", "w") as t, tarfile.open(tmp_path / "b.tgz", "w:gz") as g, zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for name, content in data.items():
            for out in (t, g):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                out.addfile(info, io.BytesIO(content))
            z.writestr(name, content)
    tarfile.open(tmp_path / "d.tar", "w").close()
    want = {k: v for k, v in data.items() if k.endswith(".wav")}
    for size in (1, 5000, archives.RANGE_BYTES):
        for name in ("a.tar", "b.tgz", "c.zip"):
            got = corpora.archive_members(spark, str(tmp_path / name), (".wav",), size).collect()
            assert len(got) == len(want) and {r["member"]: bytes(r["content"]) for r in got} == want, (size, name)
    assert len(list(archives.ranges(str(tmp_path / "a.tar"), 5000))) > 10
    assert corpora.archive_members(spark, str(tmp_path / "d.tar"), ()).count() == 0
    assert corpora.archive_members(spark, f"{tmp_path}/[ac].*", ()).count() == 2 * len(data)


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A tar of over 3 GB (sparse on disk): members behind a large one are read without it."""
    path = tmp_path / "big.tar"
    with path.open("wb") as f:
        for name, content, size in (("a.wav", b"first", 5), ("big.bin", None, 3 << 30), ("z.wav", b"last", 4)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf())
            if content is None:
                f.seek(size, 1)
            else:
                f.write(content.ljust(512, b"\0"))
        f.write(b"\0" * 10240)
    assert path.stat().st_size > 3 << 30
    got = {r["member"]: bytes(r["content"]) for r in corpora.archive_members(spark, str(path), (".wav",)).collect()}
    assert got == {"a.wav": b"first", "z.wav": b"last"}


# ---- speakers ------------------------------------------------------------------
def states(spark, spans):
    d = spark.createDataFrame([("m", *s) for s in spans], "id string, tier string, start_s double, end_s double")
    return [(r["start_s"], r["end_s"], "".join(r["speakers"]), r["state"]) for r in corpora.speaker_states(d).orderBy("start_s").collect()]


def test_speaker_states(spark):
    assert states(spark, [("a", 0.0, 2.0), ("b", 1.0, 3.0)]) == [(0, 1, "a", "single"), (1, 2, "ab", "overlap"), (2, 3, "b", "single")]
    assert states(spark, [("a", 0.0, 1.0), ("b", 2.0, 3.0)]) == [(0, 1, "a", "single"), (1, 2, "", "silence"), (2, 3, "b", "single")]
    assert states(spark, [("a", 0.0, 9.0), ("b", 2.0, 3.0), ("c", 2.0, 3.0)]) == [(0, 2, "a", "single"), (2, 3, "abc", "overlap"), (3, 9, "a", "single")]
    assert states(spark, [("a", 0.0, 2.0), ("a", 2.0, 3.0), ("a", 1.0, 2.5)]) == [(0, 3, "a", "single")]
    assert states(spark, [("a", 1.0, 1.0), ("a", 3.0, 2.0)]) == []
    assert states(spark, [("a", 0.0, 1.0), ("b", 1.0, 2.0)]) == [(0, 1, "a", "single"), (1, 2, "b", "single")]


def test_speaker_states_of_text_grids(spark, tmp_path):
    tier = lambda n, name, spans: f'    item [{n}]:\n        name = "{name}"\n' + "".join(f'        intervals [{k}]:\n            xmin = {a}\n            xmax = {b}\n            text = "{t}"\n' for k, (a, b, t) in enumerate(spans, 1))
    (tmp_path / "r.TextGrid").write_text(tier(1, "N_SPK1", [(0, 2, "hi"), (2, 4, ""), (4, 6, "so")]) + tier(2, "N_SPK2", [(1, 5, "yes")]))
    got = [(r["start_s"], r["end_s"], r["state"]) for r in corpora.speaker_states(corpora.text_grids(spark, str(tmp_path))).orderBy("start_s").collect()]
    assert got == [(0, 1, "single"), (1, 2, "overlap"), (2, 4, "single"), (4, 5, "overlap"), (5, 6, "single")]
