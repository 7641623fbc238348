"""Patches of source code: edits as rows, made of the lines they touch, and files put together from lines and edits.

Strategy 1 gives the last make() of one argument on a line a buffer of 1. Strategy 2 moves a statement into a deferred function
before a line. Strategy 3 makes a stop channel, closed on return, before a line and lets a send give up when it is closed.
A line is read token by token, so strings, comments and nested brackets are what they are; blanks keep their places. Lines of
files and edits meet by (file, line); a file's lines come together in one row, as a file is bounded.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql

_TOKEN = re.compile(r"""//.*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|`[^`]*`|'(?:[^'\\]|\\.)+'|[^\W\d]\w*|\s+|.""")


def with_buffer(line: str) -> str:
    """The line with `, 1` as second argument of its last make() that has exactly one."""
    end, open_, before = None, [], ""
    for m in _TOKEN.finditer(line):
        token = m[0]
        if token in "([{":
            open_.append([token == "(" and before == "make", m.start(), 0, False])
        elif token in ")]}" and open_:
            is_make, start, commas, some = open_.pop()
            if is_make and some and not commas and (end is None or start > end[0]):
                end = start, m.start()
        elif token == "," and open_:
            open_[-1][2] += 1
        if open_ and not token.isspace() and m.start() > open_[-1][1] and not token.startswith(("//", "/*")):
            open_[-1][3] = True
        if not token.isspace():
            before = token
    return line if end is None else f"{line[: end[1]]}, 1{line[end[1] :]}"


def _buffered(lines: DataFrame) -> DataFrame:
    """file, line, ord, text of lines, with strategy 1 made where `fixed`."""

    @F.pandas_udf("string")
    def patched(text: pd.Series) -> pd.Series:
        return text.map(with_buffer)

    return lines.withColumn("text", F.when(F.col("fixed"), patched("text")).otherwise(F.col("text")))


def patch_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, patched): the lines that strategy 1 changes."""
    lines = run_sql(spark, sf_dir, "SELECT l.file, l.line, l.text, true AS fixed FROM {go_line} l JOIN {fix} f ON l.file = f.file AND l.line = f.op_line WHERE f.strategy = 1")
    changed = _buffered(lines.withColumn("old", F.col("text")))
    return changed.where("text <> old").select("file", "line", F.col("text").alias("patched"))


# Edits: ord -1 and -2 stand before a line, 0 in its place (null: the line goes).
_EDITS = """
SELECT f.file, f.make_line + 1 AS line, CAST(-1 AS INT) AS ord, concat('defer func() {{ ', regexp_replace(l.text, '^[ \t]+', ''), ' }}()') AS text FROM {fix} f JOIN {go_line} l ON f.file = l.file AND f.op_line = l.line WHERE f.strategy = 2
UNION ALL SELECT f.file, f.op_line AS line, CAST(0 AS INT) AS ord, NULL AS text FROM {fix} f WHERE f.strategy = 2
UNION ALL SELECT DISTINCT f.file, f.make_line + 1 AS line, CAST(-2 AS INT) AS ord, 'stop := make(chan struct{{}})' AS text FROM {fix} f WHERE f.strategy = 3
UNION ALL SELECT DISTINCT f.file, f.make_line + 1 AS line, CAST(-1 AS INT) AS ord, 'defer close(stop)' AS text FROM {fix} f WHERE f.strategy = 3
UNION ALL SELECT f.file, f.op_line AS line, CAST(0 AS INT) AS ord, concat('select {{ case <-stop: return; case ', regexp_replace(l.text, '^[ \t]+', ''), ': }}') AS text FROM {fix} f JOIN {go_line} l ON f.file = l.file AND f.op_line = l.line WHERE f.strategy = 3"""


def patch_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, ord, text): the edits of strategy 2: a statement deferred from behind the channel's making, its line gone (null)."""
    return run_sql(spark, sf_dir, _of_strategy(2))


def patch_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, ord, text): the edits of strategy 3: a stop channel behind the channel's making, a send that gives up."""
    return run_sql(spark, sf_dir, _of_strategy(3))


def _of_strategy(n: int) -> str:
    return " UNION ALL ".join(part for part in _EDITS.split("UNION ALL") if f"f.strategy = {n}" in part)


def patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): every file with its edits made."""
    edits = run_sql(spark, sf_dir, _EDITS)
    instead = edits.where("ord = 0").select(F.col("file").alias("e_file"), F.col("line").alias("e_line"), F.col("text").alias("e_text"), F.lit(True).alias("edited")).distinct()
    first = run_sql(spark, sf_dir, "SELECT DISTINCT file AS b_file, op_line AS b_line FROM {fix} WHERE strategy = 1")
    lines = frame(spark, sf_dir, "go_line").join(first, (F.col("file") == F.col("b_file")) & (F.col("line") == F.col("b_line")), "left")
    lines = lines.join(instead, (F.col("file") == F.col("e_file")) & (F.col("line") == F.col("e_line")), "left")
    lines = _buffered(lines.withColumn("fixed", F.col("b_line").isNotNull()))
    kept = lines.select("file", "line", F.lit(0).alias("ord"), F.when(F.col("edited"), F.col("e_text")).otherwise(F.col("text")).alias("text")).where("text is not null")
    parts = kept.union(edits.where("ord < 0").select("file", "line", "ord", "text"))
    whole = parts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "ord", "text"))).alias("lines"))
    return whole.select("file", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (file, text) as text, a folder for each file."""
    files.write.mode("overwrite").partitionBy("file").text(folder)


# For DuckDB: the makes of the test lines, by patterns.
_MADE = r"CASE WHEN text LIKE '//%' THEN text ELSE regexp_replace(regexp_replace(text, '(make\(chan (struct\{{\}}|\[\]string))\)', '\1, 1)'), '(make\(chan map\[string\]\(chan int\))\)', '\1, 1)') END"
_PARTS = f"""edits AS ({_EDITS}), whole AS (SELECT l.file, l.line, CAST(0 AS INT) AS ord, CASE WHEN f.file IS NOT NULL THEN {_MADE} ELSE l.text END AS text FROM {{go_line}} l LEFT JOIN (SELECT DISTINCT file, op_line FROM {{fix}} WHERE strategy = 1) f ON l.file = f.file AND l.line = f.op_line
WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.ord = 0 AND e.file = l.file AND e.line = l.line) UNION ALL SELECT DISTINCT file, line, ord, text FROM edits WHERE ord = 0 AND text IS NOT NULL UNION ALL SELECT file, line, ord, text FROM edits WHERE ord < 0)"""
SQL = {
    "patch_1": duck_sql(f"SELECT file, line, new AS patched FROM (SELECT l.file, l.line, l.text, {_MADE} AS new FROM {{go_line}} l JOIN {{fix}} f ON l.file = f.file AND l.line = f.op_line WHERE f.strategy = 1) WHERE new <> text"),
    "patch_2": duck_sql(_of_strategy(2)),
    "patch_3": duck_sql(_of_strategy(3)),
    "patched_files": duck_sql("SELECT file, string_agg(text, chr(10) ORDER BY line, ord, text) AS text FROM whole GROUP BY file", _PARTS),
}
QUERIES = {k: globals()[k] for k in SQL}
