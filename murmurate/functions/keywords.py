"""Keyword recall by containment.

A keyword is said if one of its aliases occurs in the text as a substring, with
no word boundary; an empty alias never occurs, and its keyword still counts.

Two forms: keywords of each row are compared by native expressions; a vocabulary
that all rows share becomes an Aho-Corasick automaton, which walks each text once
however many aliases there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the aliases of one automaton; it takes some fifty times as much memory, and a larger vocabulary takes several walks.
AUTOMATON_BYTES = 4 << 20
#: Texts whose keywords are put out at once: each may say the whole vocabulary.
CHUNK_ROWS = 100


def parsed(json: Column) -> Column:
    """The alias arrays of a JSON list whose elements are strings or objects with ``surface`` and ``aliases``.

    An object without aliases has its surface as its only one, and neither
    surface nor aliases make one empty alias.
    """
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    fields = lambda s: F.from_json(s, "surface string, aliases array<string>")
    surface = lambda s: F.array(F.coalesce(fields(s)["surface"], F.lit("")))
    of = lambda s: F.when(F.size(fields(s)["aliases"]) > 0, fields(s)["aliases"]).otherwise(surface(s))
    return F.transform(items, lambda s: F.when(F.substring(s, 1, 1) == "{", of(s)).otherwise(F.array(s)))


def hits(text: Column, keywords: Column) -> Column:
    """struct(hit, total) of one text and the alias arrays of its own keywords; a null list has no keywords."""
    said = lambda aliases: F.exists(aliases, lambda a: (a != "") & F.contains(F.coalesce(text, F.lit("")), a))
    kws = F.coalesce(keywords, F.array().cast("array<array<string>>"))
    return F.struct(F.size(F.filter(kws, lambda k: F.coalesce(said(k), F.lit(False)))).cast("long").alias("hit"), F.size(kws).cast("long").alias("total"))


def automaton(aliases: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """The automaton of (alias, keyword) pairs, none empty; each alias has the keywords that it stands for."""
    by: dict[str, list[int]] = {}
    for alias, keyword in aliases:
        by.setdefault(alias, []).append(keyword)
    out = ahocorasick.Automaton()
    for alias, keywords in by.items():
        out.add_word(alias, tuple(keywords))
    out.make_automaton()
    return out


def _walk(machine: ahocorasick.Automaton, text: str | None) -> set[int]:
    return {k for _, keywords in machine.iter(text) for k in keywords} if text and len(machine) else set()


def shared(texts: DataFrame, ref: str, hyp: str, aliases: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """A row (other columns of ``texts``, keyword, hit) for each keyword said in ``ref``; ``hit`` if it is in ``hyp`` too.

    ``aliases`` has (keyword long, alias string).  Its size is measured first: up
    to ``limit`` bytes it is one automaton, sent to all tasks; beyond, keywords
    are dealt by hash into as many as are needed, which walk the texts one after
    the other, so no task holds more than one.
    """
    spark = texts.sparkSession
    own = [c for c in texts.columns if c not in (ref, hyp)]
    some = aliases.where("keyword is not null and alias <> ''").select(F.col("keyword").cast("long"), "alias").distinct()
    size = some.agg(F.sum(F.octet_length("alias"))).first()[0] or 0
    parts = -(-size // limit) or 1
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in texts.select(*own).schema)}, keyword long, hit boolean"
    found = None
    for part in range(parts):
        mine = some.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part) if parts > 1 else some
        sent = spark.sparkContext.broadcast([(r["alias"], r["keyword"]) for r in mine.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = automaton(sent.value)
            for batch in (b.slice(i, CHUNK_ROWS) for b in batches for i in range(0, b.num_rows, CHUNK_ROWS)):
                row, keyword, hit = [], [], []
                for i, (x, y) in enumerate(zip(batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist(), strict=True)):
                    if said := sorted(_walk(machine, x)):
                        again = _walk(machine, y)
                        row += [i] * len(said)
                        keyword += said
                        hit += [k in again for k in said]
                kept = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in batch.columns[: len(own)]), pa.array(keyword, pa.int64()), pa.array(hit, pa.bool_())], [*own, "keyword", "hit"])

        rows = texts.select(*own, ref, hyp).mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return found
