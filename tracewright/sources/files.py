"""Delimited files as all-text tables, and Parquet tables.

Line breaks inside quotes do not end a record. Files are still read in byte
ranges by many tasks: a first pass tells for each range in which state it ends
if it starts outside or inside of quotes, chaining these tells where each range
really starts, and a second pass joins the lines of a record. Only the records
that cross a range (two pieces a range at most) are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import fixed
from tracewright.functions.scalars import blank_to_null

SAMPLE_ROWS = 20
_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def quoted_after(line: str, inside: bool, separator: str) -> bool:
    """Whether the end of the line is inside of quotes. Quotes count only at the start of a field, and doubled ones do not close."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closing = _CLOSING.match(line, at if inside else at + 1)
            if closing is None:
                return True
            inside, at = False, closing.end()
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each byte range, in order."""
    for batch in batches:
        file, block = batch.column("file"), batch.column("block")
        ends = pc.run_end_encode(block).run_ends.to_pylist() if len(block) else []
        names = pc.run_end_encode(file).run_ends.to_pylist() if len(block) else []
        lo = 0
        for hi in sorted({*ends, *names}):
            yield (file[lo].as_py(), block[lo].as_py()), batch.column("value").slice(lo, hi - lo)
            lo = hi


def _states(separator: str):
    """Of each byte range: the state at its end from either start, and whether a record ends in it when it starts inside."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[bool]] = {}
        for key, lines in _runs(batches):
            s = seen.setdefault(key, [False, True, False])
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                s[0], s[1] = quoted_after(line, s[0], separator), quoted_after(line, s[1], separator)
                s[2] |= not s[1]
        yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "plain": s[0], "quoted": s[1], "ended": s[2]} for (f, b), s in seen.items()],
                                         schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_()), ("ended", pa.bool_())]))
    return scan


def _joined(separator: str, owners: dict[tuple[str, int], int]):
    """Records and pieces of records: file, the range where the record starts, own range, whether it is the first of its file, whole or not, text."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("head", pa.bool_()), ("whole", pa.bool_()), ("record", pa.string())])

    def rows(key, owner, head, whole, texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([owner] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()),
                                           pa.array([head and i == 0 for i in range(n)], pa.bool_()), pa.array([whole] * n, pa.bool_()), pa.array(texts, pa.string())], schema=schema)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, inside, owner, first = None, [], False, None, False

        def rest():
            return [rows(key, key[1] if owner is None else owner, first and owner is None, False, ["\n".join(part)])] if part else []

        for here, lines in _runs(batches):
            if here != key:
                yield from rest()
                key, part, owner = here, [], owners.get(here)
                inside, first = owner is not None, here[1] == 0
            if not inside and not pc.any(pc.match_substring(lines, '"')).as_py():
                yield rows(key, key[1], first, True, lines.to_pylist())
                first = False
                continue
            done = []
            for line in lines.to_pylist():
                part.append(line)
                inside = quoted_after(line, inside, separator)
                if inside:
                    continue
                if owner is None:
                    done.append("\n".join(part))
                else:
                    yield rows(key, owner, False, False, ["\n".join(part)])
                    owner = None
                part = []
            if done:
                yield rows(key, key[1], first, True, done)
                first = False
        yield from rest()
    return join


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """One row per record of delimited files: ``record`` and ``head`` (the first of its file). Blank lines between records are left out.

    The driver holds three flags for each byte range of the files (one range
    per ``spark.sql.files.maxPartitionBytes``).
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ranges = lines.mapInArrow(_states(separator), "file string, block long, plain boolean, quoted boolean, ended boolean").collect()
    owners: dict[tuple[str, int], int] = {}
    file, start = None, None
    for r in sorted(ranges, key=lambda r: (r["file"], r["block"])):
        start = start if r["file"] == file else None
        file = r["file"]
        if start is None:
            start = r["block"] if r["plain"] else None
        else:
            owners[file, r["block"]] = start
            start = None if not r["quoted"] else r["block"] if r["ended"] else start
    found = lines.mapInArrow(_joined(separator, owners), "file string, owner long, block long, head boolean, whole boolean, record string")
    pieces = found.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "record", "head"))).alias("p"))
    pieces = pieces.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), F.exists("p", lambda x: x["head"]).alias("head"))
    return (found.where("whole").select("record", "head").unionByName(pieces).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
            .where(F.trim("record") != ""))


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Every column as text; tokens that mean "no value" become null. Fields may hold line breaks, separators and doubled quotes inside quotes."""
    names = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": separator, "escape": '"', "maxCharsPerColumn": "-1"}
    fields = records(spark, path, separator).where("not head").select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return fields.select(*[blank_to_null(F.col(f"r.c{i}")).alias(c) for i, c in enumerate(names)])


def read_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """CSV / TXT files or Parquet tables by name."""
    return {name: spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else read_csv(spark, p)
            for name, p in paths.items()}


def sample(table: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return table.limit(n)


def without_empty_columns(table: DataFrame) -> DataFrame:
    """The table without columns that hold no value at all."""
    counts = table.agg(*[F.max(F.when(~F.trim(F.col(f"`{c}`").cast("string")).isin(fixed.NA_TOKENS), 1)).alias(c)
                         for c in table.columns]).first()
    return table.select(*[f"`{c}`" for c in table.columns if counts[c]])
