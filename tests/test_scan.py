"""Scans in ranges: large files in many tasks."""

import csv
import random

from pyspark.sql import functions as F

from siltwork.operators.scan import running_state, running_sum
from siltwork.sources import readers


def test_running_sums_and_states(spark):
    rng = random.Random(3)
    rows = [(f, k * 7, rng.choice([0, 0, 1, 2]), rng.choice([(0, 0), (1, 1), (0, 1), (1, 0), (0, 1)])) for f in ("a", "b", None) for k in range(90)]
    df = spark.createDataFrame([(f, k, n, a, b) for f, k, n, (a, b) in rows], "f string, k long, n int, a int, b int").repartition(5)
    sums = {(r.f, r.k): r.s for r in running_sum(df, F.col("n"), "s", ["k"], ["f"], 7).collect()}
    states = {(r.f, r.k): r.s for r in running_state(df, F.col("a"), F.col("b"), "s", ["k"], ["f"], 7).collect()}
    want_sums, want_states = {}, {}
    for f in ("a", "b", None):
        total = state = 0
        for g, k, n, step in rows:
            if g == f:
                total += n
                want_sums[f, k], want_states[f, k] = total, state
                state = step[state]
    assert sums == want_sums and states == want_states
    assert running_sum(df.limit(0), F.col("n"), "s", ["k"]).count() == 0


def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def default_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_quoted_file_in_many_splits(spark, tmp_path):
    rng = random.Random(8)
    cells = ["plain", "", 'said "so"', "two\nlines", 'a "quote"\n\n and, more\n', "x,y", "5\" pipe", "end\"", "\n"]
    rows = [[str(k), rng.choice(cells), rng.choice(cells)] for k in range(700)]
    at = tmp_path / "t.csv"
    with at.open("w", newline="") as f:
        f.write("Title\n\n")
        csv.writer(f, lineterminator="\n").writerows([["id", "one", "two"], *rows])
        f.write('800,5" pipe,7" pipe\n801,"open, never closed\nto the end')
    try:
        small_splits(spark)
        assert readers.lines_of(spark, str(at), "utf-8").rdd.getNumPartitions() > 4
        df, meta = readers.read_table(spark, str(at))
        got = [list(r)[1:] for r in df.orderBy("rid").collect()]
    finally:
        default_splits(spark)
    assert meta.header_row == 1 and df.columns == ["rid", "id", "one", "two"]
    assert got[:700] == rows and got[700] == ["800", '5" pipe', '7" pipe'] and got[701][0] == "801"


def test_one_log_in_many_splits(spark, tmp_path):
    rng = random.Random(2)
    lines, want = ["lost at the start"], []
    for k in range(900):
        lines.append(f"2024-01-01 10:{k // 60 % 60:02d}:{k % 60:02d} INFO [app] message {k}")
        more = [f"  trace {k}.{j}" for j in range(rng.choice([0, 0, 0, 1, 3, 40]))]
        lines += more
        want.append(("\n".join([f"message {k}", *(m.strip() for m in more)]), len(more)))
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    try:
        small_splits(spark)
        df, name = readers.read_log(spark, str(tmp_path / "app.log"), "app")
        got = [(r.message, r.extra_lines) for r in df.orderBy("line_no").collect()]
    finally:
        default_splits(spark)
    assert got == want
