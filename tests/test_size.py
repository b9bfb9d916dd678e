"""What a query costs over larger tables: values computed once, kernels without squares, tasks that do not grow."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from murmurate.functions import quantiles, textnorm, whole
from murmurate.session import spread


def test_values_of_large_groups_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return float(x * 7919 % 5003)

    df = spark.range(0, 5003, 1, 4).select((F.col("id") % 2).alias("g"), value("id").alias("x"))
    got = {r["g"]: r["p"] for r in quantiles.exact(df, ["g"], "x", {"p": quantiles.nearest_rank(0.5)}, limit=1000).collect()}
    for g in (0, 1):
        x = sorted(float(i * 7919 % 5003) for i in range(5003) if i % 2 == g)
        assert got[g] == x[round((len(x) - 1) * 0.5)]
    assert seen.value == 5003


def test_chinese_numbers_of_long_texts():
    """The rule for money was tried from each place of a stretch without digits."""
    text = "very long words 很长 " * 4000
    start = time.process_time()
    assert textnorm.say_numbers(text + "3元") == text + "三元"
    assert textnorm.say_numbers("9" * 20_000 + "x" + text)
    assert time.process_time() - start < 2


def test_edits_in_a_band():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 400)))
        share = rng.choice([0.01, 0.1, 0.5])
        b = "".join(rng.choice(["", c + "z", "y"]) if rng.random() < share else c for c in a)[rng.choice([0, 0, 90]) :]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        assert whole.edits(a, b) == whole.edits(b, a) == row[-1]
    # a tenth of the characters is gone: the band is a fifth of the table
    a = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    places = whole._places(a)
    b = "".join(c for k, c in enumerate(a) if k % 10)
    start = time.process_time()
    mask, up, down = (1 << len(a)) - 1, (1 << len(a)) - 1, 0
    for y in b[:6000]:
        up, down, _, _ = whole._step(places.get(y, 0), up, down, mask)
    table = 9 * (time.process_time() - start)
    start = time.process_time()
    assert whole.edits(a, b) == 6000
    assert time.process_time() - start < table / 2


def test_overlaps_of_characters():
    rng = random.Random(6)
    a, b = (["", "ab", "a", "é" * 9, *("".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(80))] for _ in range(2))
    assert whole.character_overlaps(a, b, 6) == [whole.overlaps(x, y, 6) for x, y in zip(a, b, strict=True)]
    many = ["".join(map(chr, range(200, 1900))), "xyzxyz"]  # more characters than six of them fit a number
    assert whole.character_overlaps(many, many, 6) == [whole.overlaps(x, x, 6) for x in many]
    long = ["".join(rng.choice("abcdefgh") for _ in range(50_000))]
    start = time.process_time()
    whole.overlaps(long[0], long[0], 6)
    plain = time.process_time() - start
    start = time.process_time()
    whole.character_overlaps(long, long, 6)
    assert time.process_time() - start < plain / 1.5


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(0, 20_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr("murmurate.session.SPREAD_BYTES", 1 << 14)
    rows = spread(spark.read.parquet(f"{tmp_path}/t.parquet").select("text"))
    sizes = rows.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) > 50 and sizes.max() < 20_000 / 40 and sizes.sum() == 20_000


def test_all_labels_count(spark):
    """A label sample of 20,000 left out most trusted documents of a larger table."""
    from murmurate.llm import quality

    n = 45_000
    docs = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 97).alias("text"))
    labels = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    raw, own = quality.count_ngrams(quality.marked(docs, labels))
    assert raw.sum() == n and own.sum() == n * 2 // 3


def test_batches_do_not_grow_with_the_table(spark, tmp_path):
    """Files of many copies are small: a task had all rows of its share, 10,000 at once, in a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        spark.range(0, 36_000, 1, 1).select("id", F.lit("a text " * 20).alias("text")).write.parquet(f"{tmp_path}/t.parquet")
        rows = spread(spark.read.parquet(f"{tmp_path}/t.parquet").select("text"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 36_000 and max(got) <= 1000
    finally:
        spark.conf.set(name, old)
