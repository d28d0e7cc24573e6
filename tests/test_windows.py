from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codelabels.operators.windows import file_lines, line_windows


def expected(n, low, high, grow, move):
    lines = [f"l{i}" for i in range(n)]
    out = []
    for size in range(min(low, n), min(high, n) + 1, grow):
        out += [(size, at, "\n".join(lines[at : at + size])) for at in range(0, n - size + 1, move)]
    return out or [(None, None, None)]


def cut(spark, lengths, *numbers, **options):
    rows = [(i, [f"l{k}" for k in range(n)]) for i, n in enumerate(lengths)]
    out = line_windows(spark.createDataFrame(rows, "id int, lines array<string>"), *numbers, **options).collect()
    found = {i: [] for i in range(len(lengths))}
    for row in out:
        found[row["id"]].append((row["size"], row["start"], row["code"]))
    return [sorted(found[i], key=str) for i in range(len(lengths))]


@pytest.mark.parametrize(
    "numbers", [(35, 35, 1, 25), (6, 6, 1, 3), (4, 9, 2, 3), (2, 4, 1, 1), (5, 3, 1, 2)]
)
@pytest.mark.parametrize("block", [1, 2, 256])
def test_windows_equal_slices(spark, numbers, block):
    lengths = [0, 1, 2, 3, 34, 35, 36, 40, 59, 60, 84, 85, 130]
    wanted = [sorted(expected(n, *numbers), key=str) for n in lengths]
    assert cut(spark, lengths, *numbers, block=block) == wanted


def test_random_grids(spark):
    rng = random.Random(3)
    for _ in range(6):
        low = rng.randrange(0, 8)
        numbers = (low, low + rng.randrange(0, 6), rng.randrange(1, 4), rng.randrange(1, 7))
        lengths = [rng.randrange(0, 60) for _ in range(12)]
        wanted = [sorted(expected(n, *numbers), key=str) for n in lengths]
        assert cut(spark, lengths, *numbers, block=rng.randrange(1, 5)) == wanted


def test_one_very_long_file(spark):
    n = 120_000
    frame = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")).alias("lines"))
    out = line_windows(frame).agg(F.count(F.lit(1)), F.max("start"), F.max(F.size(F.split("code", "\n")))).first()
    starts = range(0, n - 35 + 1, 25)
    assert tuple(out) == (len(starts), starts[-1], 35)


def test_sizes_do_not_leak_between_files(spark):
    assert cut(spark, [2, 50], 35, 35, 1, 25)[1][0][0] == 35


def test_file_lines_cleans_first(spark):
    frame = spark.createDataFrame([("package p;\n{\nint a = 1; // x\n\n}\n",)], "file_content string")
    assert file_lines(frame).first()["lines"] == ["int a = <$NUMBER>;"]
    assert file_lines(frame, normalised=False).first()["lines"] == ["int a = 1; "]
