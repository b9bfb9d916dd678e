"""Packing by power-of-two decomposition.

Each document's token ids (with an end id) are cut into pieces whose lengths
are powers of two, longest first; every piece is a training sequence of its
own, so that no sequence crosses documents and none needs padding.  Sequences
of one length form a bucket (``bucket`` is log2 of the length); batches are
drawn from one bucket at a time.

The stage is a map: no shuffle, no state beyond a bounded word cache, and a
lost task is simply run again.  ``sequence_id`` is the partition's number and
the row's number in it, so it is unique and the same on a retry.

Defined cases: a null or empty text has only the end id and gives one piece of
length 1; a null doc_id stays null; repeated rows are packed once each; a very
long text is a slice of its own and is cut whole; an empty table gives no piece;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T

END_ID = 1
MAX_LEN = 2048
#: Words that a Python worker keeps; when it is full it starts afresh, which only costs time.
CACHE_WORDS = 200_000
#: Bytes of text that are cut into words at once: the work arrays take about 40 bytes for each.
SLICE_BYTES = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int"


def _classes() -> np.ndarray:
    """Of each Latin-1 character: 0 white space, 1 letter, 2 number, 3 other."""
    import unicodedata

    out = np.full(256, 3, np.uint8)
    for i in range(256):
        kind = unicodedata.category(chr(i))
        if i in (0x20, 0x85, 0xA0) or 0x09 <= i <= 0x0D:
            out[i] = 0
        elif kind[0] == "L":
            out[i] = 1
        elif kind[0] == "N":
            out[i] = 2
    return out


class WordEncoder:
    """Encodes texts with a word-level BPE vocabulary through a cache of whole words.

    The vocabulary's rules normalise (NFC, lower case) and cut a text into
    letters, single digits, other runs and English contractions, and then merge
    within each such word.  For Latin-1 texts the cut is done here on byte
    arrays, and only words that the cache lacks go to the tokenizer; any other
    text goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        # a task has one core; more threads only hold more memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.word = Tokenizer(self.full.model)  # the same vocabulary in memory
        self.word.normalizer = normalizers.Sequence([])
        self.word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.is_last = np.zeros(max(vocab.values()) + 1, bool)
        self.is_last[[k for word, k in vocab.items() if word.endswith("</w>")]] = True
        self.classes = _classes()
        self.lower = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        step = 200
        found = np.array([k for enc in self.word.encode_batch_fast([" ".join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False) for k in enc.ids], np.uint32)
        last = np.flatnonzero(self.is_last[found])
        if len(last) != len(words):
            raise ValueError("the vocabulary has no word ends")
        sizes_ = np.diff(last, prepend=-1)
        at = len(self.ids) + last + 1 - sizes_
        self.ids = np.concatenate([self.ids, found])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, sizes_])[order]

    def _cut(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the words of Latin-1 texts."""
        n = len(buf)
        kind = self.classes[buf]
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        prev = np.empty(n, np.uint8)
        prev[:1] = 0
        prev[1:] = kind[:-1]
        prev[first[:n]] = 0
        start = (kind != 0) & ((kind != prev) | (kind == 2))
        row_end = np.repeat(off[1:], np.diff(off))
        for i in np.flatnonzero((buf == 0x27) & (prev != 3)):  # 's 't 'm 'd 're 've 'll
            tail = bytes(buf[i + 1 : min(i + 3, row_end[i])])
            size = 2 if tail[:1] in (b"s", b"t", b"m", b"d") else 3 if tail in (b"re", b"ve", b"ll") else 0
            if size:
                start[i + 1 : i + size] = False
                if i + size < row_end[i] and kind[i + size] == 1:
                    start[i + size] = True
        starts = np.flatnonzero(start)
        stop = start | (kind == 0) | first[:n]
        stops = np.append(np.flatnonzero(stop), n)
        ends = stops[np.searchsorted(stops, starts, "right")]
        return starts, ends, np.searchsorted(off, starts, "right") - 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[bytes] = []
        where: list[int] = []
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" not in text:
                try:
                    plain.append(text.encode("latin-1"))
                    where.append(i)
                    continue
                except UnicodeEncodeError:
                    pass
            out[i] = np.array([*self.full.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        if plain:
            off = np.zeros(len(plain) + 1, np.int64)
            np.cumsum([len(x) for x in plain], out=off[1:])
            buf = self.lower[np.frombuffer(b"".join(plain), np.uint8)]
            starts, ends, rows = self._cut(buf, off)
            h = T.hash_spans(buf, starts, ends)
            keys, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.keys) + len(keys) > CACHE_WORDS:
                self.clear()
            pos = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = pos < len(self.keys)
            new[inside] = self.keys[pos[inside]] != keys[inside]
            if new.any():
                self._learn(keys[new], [buf[a:b].tobytes().decode("latin-1") for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
                pos = np.searchsorted(self.keys, keys)
            entry = pos[inverse]
            size = self.size[entry]
            done = np.cumsum(size)
            total = int(done[-1]) if len(done) else 0
            ids = self.ids[np.repeat(self.at[entry] - (done - size), size) + np.arange(total)]
            cut = np.concatenate([[0], done])[np.searchsorted(rows, np.arange(len(plain) + 1))]
            for r, i in enumerate(where):
                own = np.empty(cut[r + 1] - cut[r] + 1, np.uint32)
                own[:-1] = ids[cut[r] : cut[r + 1]]
                own[-1] = END_ID
                out[i] = own
        return out  # type: ignore[return-value]


def encoder(path: str) -> WordEncoder:
    return T.resident(("words", path), lambda: WordEncoder(path))


def binary_lengths(n: int, longest: int = MAX_LEN) -> list[int]:
    """Powers of two that add up to ``n``, in falling order, none above ``longest``."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: PIECES plus sequence_id (and the ids themselves on request)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for i, j, _, _ in T.slices(batch.column(1), SLICE_BYTES):
                cols: list[list] = [[] for _ in range(8)]
                for doc, ids in zip(docs_[i:j], enc.encode(batch.column(1).slice(i, j - i).to_pylist()), strict=True):
                    at, n, raw = 0, len(ids), memoryview(ids.astype("<u4")).cast("B")
                    for size in binary_lengths(n, longest):
                        for col, v in zip(cols, (doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, 0, size.bit_length() - 1), strict=False):
                            col.append(v)
                        if with_ids:
                            cols[7].append(ids[at : at + size].astype(np.int32))
                        at += size
                arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.int32()], strict=False)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket"]
                if with_ids:
                    arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    T.small_batches(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
