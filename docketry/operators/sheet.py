"""Spreadsheets as tables of cells: used range, dependencies, calculation order, cycles, CSV.

A cell is a row (sheet_id, r, c, v). References between cells are a second table; calculation order comes from peeling off
cells whose inputs are done while chains are halved, so sheets of any number and length are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.formula import column_index
from docketry.functions.text import csv_field
from docketry.session import cut


def used_range(cells: DataFrame) -> DataFrame:
    """Last row and column of each sheet with a non-blank value."""
    return cells.filter(F.trim("v") != "").groupBy("sheet_id").agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"))


def csv_rows(cells: DataFrame) -> DataFrame:
    """sheet_id, r, line: the used range of each sheet as CSV; empty cells are empty fields."""
    grid = used_range(cells).select("sheet_id", F.explode(F.sequence(F.lit(0), F.col("max_r").cast("int"))).alias("r"), "max_c").select("sheet_id", "r", F.explode(F.sequence(F.lit(0), F.col("max_c").cast("int"))).alias("c"))
    full = grid.join(cells.select("sheet_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v"), ["sheet_id", "r", "c"], "left")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", csv_field(F.col("v"), newline=False).alias("f")))), lambda x: x["f"]), ",")
    return full.groupBy("sheet_id", "r").agg(line.alias("line"))


def pasted(blocks: DataFrame, rows: int = 200, cols: int = 26) -> DataFrame:
    """Tab-separated blocks (sheet_id, r0, c0, block) as cells: carriage returns and empty lines go, values are trimmed, what lies outside the sheet is cut off."""
    lines = blocks.select("sheet_id", "r0", "c0", F.filter(F.split(F.replace("block", F.lit("\r"), F.lit("")), "\n"), lambda x: x != "").alias("lines"))
    row = lines.select("sheet_id", "c0", F.col("r0"), F.posexplode("lines").alias("i", "line"))
    cell = row.select("sheet_id", (F.col("r0") + F.col("i")).alias("r"), "c0", F.posexplode(F.split("line", "\t")).alias("j", "v"))
    return cell.select("sheet_id", "r", (F.col("c0") + F.col("j")).alias("c"), F.trim("v").alias("v")).filter(f"r < {rows} AND c < {cols} AND v <> ''")


def references(formulas: DataFrame) -> DataFrame:
    """Cells that formulas read: sheet_id, r, c (the formula), rr, rc (what it reads); ranges are spread out, any corners, once each. Texts in quotes and the ends of longer words hold no reference."""
    ref = r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})"
    found = formulas.select("sheet_id", "r", "c", F.explode(F.regexp_extract_all(F.regexp_replace("f", '"(?:[^"]|"")*"', '""'), F.lit(rf"(?<![A-Za-z0-9_$.])(\$?[A-Za-z]{{1,3}}\$?[0-9]{{1,7}}(?::\$?[A-Za-z]{{1,3}}\$?[0-9]{{1,7}})?)(?![A-Za-z0-9(])"), F.lit(1))).alias("t"))
    a, b = F.split_part("t", F.lit(":"), F.lit(1)), F.when(F.col("t").contains(":"), F.split_part("t", F.lit(":"), F.lit(2))).otherwise(F.col("t"))
    at = lambda x, g: (F.regexp_extract(x, ref, 2).cast("int") - 1) if g == 2 else column_index(F.regexp_extract(x, ref, 1))
    box = found.select("sheet_id", "r", "c", at(a, 2).alias("r1"), at(b, 2).alias("r2"), at(a, 1).alias("c1"), at(b, 1).alias("c2"))
    spread = box.select("sheet_id", "r", "c", F.explode(F.sequence(F.least("r1", "r2"), F.greatest("r1", "r2"))).alias("rr"), "c1", "c2")
    return spread.select("sheet_id", "r", "c", "rr", F.explode(F.sequence(F.least("c1", "c2"), F.greatest("c1", "c2"))).alias("rc")).distinct()


def calculation_levels(formulas: DataFrame) -> DataFrame:
    """sheet_id, r, c, level: 1 for formulas that read no other formula, and so on; NULL level: part of, or dependent on, a circle of any length.

    Each round gives a level to the cells all of whose inputs have one. A cell that still waits for one input only is passed
    over by those that read it: they wait for its input, so many steps further, and a chain takes logarithmically many rounds.
    Ends when a round gives no level: what is left waits for a circle.
    """
    cell, read = ["sheet_id", "r", "c"], ["sheet_id", "rr", "rc"]
    as_read = {"r": "rr", "c": "rc"}
    other = formulas.select("sheet_id", F.col("r").alias("rr"), F.col("c").alias("rc"))
    waits = cut(references(formulas).join(other.distinct(), read).withColumn("steps", F.lit(1).cast("long")))
    left, done, rounds = cut(formulas.select(*cell).distinct().withColumn("least", F.lit(1).cast("long"))), None, 0
    while True:
        now = cut(left.join(waits, cell, "left_anti").select(*cell, F.col("least").alias("level")))
        if now.isEmpty():
            break
        rounds += 1
        done = now if done is None else done.unionByName(now)
        done = cut(done) if rounds % 16 == 0 else done
        got = waits.join(now.withColumnsRenamed(as_read), read).groupBy(*cell).agg(F.max(F.col("level") + F.col("steps")).alias("more"))
        left = cut(left.join(now, cell, "left_anti").join(got, cell, "left").select(*cell, F.greatest("least", "more").alias("least")))
        waits = cut(waits.join(now.withColumnsRenamed(as_read), read, "left_anti"))
        one = waits.groupBy(*cell).agg(F.count("*").alias("n"), F.min("rr").alias("to_r"), F.min("rc").alias("to_c"), F.min("steps").alias("on")).filter("n = 1")
        over = cut(waits.join(one.join(left, cell).select("sheet_id", F.col("r").alias("rr"), F.col("c").alias("rc"), "to_r", "to_c", "on", "least"), read, "left"))
        past = over.groupBy(*cell).agg(F.max(F.col("least") + F.col("steps")).alias("more"))
        left = cut(left.join(past, cell, "left").select(*cell, F.greatest("least", "more").alias("least")))
        far = F.least(F.col("steps") + F.coalesce("on", F.lit(0)), F.lit(1 << 60))  # round a circle it would double for ever
        waits = cut(over.select(*cell, F.coalesce("to_r", "rr").alias("rr"), F.coalesce("to_c", "rc").alias("rc"), far.alias("steps")).groupBy("sheet_id", "r", "c", "rr", "rc").agg(F.max("steps").alias("steps")))
    rest = left.select(*cell, F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.select(*cell, F.col("level").cast("int").alias("level")).unionByName(rest)
