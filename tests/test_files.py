import csv
import io
import random

import pytest

from tracewright.sources import files


@pytest.mark.parametrize("size", [16, 64, 1 << 20])
def test_line_breaks_in_quotes_across_byte_ranges(spark, tmp_path, size):
    """Records of any shape, cut into byte ranges of a few bytes, are what the csv module reads."""
    rng = random.Random(size)
    made = []
    for f in range(3):
        rows = [[f"{f}-{i}", "".join(rng.choice('ab,"\n ') for _ in range(rng.randint(0, 40))) + "x", 'five" pipe' if i % 5 == 0 else "z"] for i in range(40)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
        writer.writerow(["id", "note", "kind"])
        writer.writerows(rows)
        # quotes inside of a field without quotes around it are plain letters
        (tmp_path / f"t{f}.csv").write_bytes(out.getvalue().replace('"five"" pipe"', 'five" pipe').encode())
        made += [tuple(r) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = files.read_csv(spark, str(tmp_path))
        assert got.columns == ["id", "note", "kind"]
        clean = lambda x: (x[0], x[1].strip(), x[2])
        assert sorted(clean(tuple(r)) for r in got.collect()) == sorted(clean(r) for r in made)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
