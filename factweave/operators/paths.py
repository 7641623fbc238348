"""Sources and text operators: package paths, option lists, CSV reports, names taken from source lines, identifier search."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fuzzy_score
from ..sources.facts import duck_sql, frame, run_sql


def scan_pkg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir): directories below the root that hold a page, the root and excluded ones left out."""
    pages = frame(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://([^?]*)/[^/?]*", 1)
    return pages.select(path.alias("dir")).where((F.col("dir") != "") & F.col("dir").contains("/")).distinct()


def split_option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, options): the set of parts of the query string that are not empty, sorted."""
    parts = F.array_distinct(F.filter(F.split(F.coalesce(F.split_part(F.col("url"), F.lit("?"), F.lit(2)), F.lit("")), "&"), lambda x: x != ""))
    return frame(spark, sf_dir, "pages").select("page_id", F.array_join(F.sort_array(parts), ",").alias("options"))


_CSV = "SELECT p_partkey AS ord, concat(CAST(p_partkey AS STRING), ',', p_type, ',src/', replace(p_name, ' ', '_'), '.go,', CAST(p_size AS STRING)) AS line FROM {part}"


def read_bug_list_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bug_no, bug_type, src, lineno) from lines of comma-separated values."""
    lines = run_sql(spark, sf_dir, _CSV)
    row = F.from_csv("line", F.lit("bug_no bigint, bug_type string, src string, lineno bigint"))
    return lines.select(row.alias("r")).select("r.*")


def bug_list_file(spark: SparkSession, path: str) -> DataFrame:
    """The same from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="bug_no int, bug_type string, src string, lineno int")


_LOCK_LINE = """SELECT inst_id, CASE inst_id % 4 WHEN 0 THEN concat('  s.mu', CAST(prim AS STRING), '.Lock() // taken .Unlock') WHEN 1 THEN concat('case x: a.b.rw', CAST(prim AS STRING), '.RLock()')
WHEN 2 THEN concat('defer m', CAST(prim AS STRING), '.Unlock()') ELSE 'return nil' END AS text FROM {inst}"""


def mutex_name_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inst_id, name): the token left of the right-most lock call of a source line without its comment; null where none is."""
    lines = run_sql(spark, sf_dir, _LOCK_LINE)
    code = F.split_part(F.col("text"), F.lit("//"), F.lit(1))
    left = F.coalesce(*(F.when(code.contains(c), F.regexp_extract(code, r"^(.*)\." + c[1:-1] + r"\(", 1)) for c in (".Lock(", ".RLock(", ".Unlock(", ".RUnlock(")))
    name = F.element_at(F.split(F.trim(F.regexp_replace(left, "case ", "")), " "), -1)
    return lines.select("inst_id", name.alias("name"))


def lines_using_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no): lines of a document that use a name as a whole word of letters."""
    return frame(spark, sf_dir, "doc_line").where(F.col("text").rlike("(^|[^A-Za-z])(the|der|les)([^A-Za-z]|$)")).select("doc_id", "line_no")


def rank_worthy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, total, place): directories by matching lines, children folded into the best-ranked directory that is their prefix."""
    text = """SELECT dir, CAST(sum(n) AS BIGINT) AS n FROM (SELECT concat(split_part(url, '/', 3), '/', split_part(url, '/', 4)) AS dir, 1 AS n FROM {pages}
UNION ALL SELECT split_part(url, '/', 3), 1 FROM {pages} WHERE page_id % 3 = 0) GROUP BY dir"""
    counts = run_sql(spark, sf_dir, text)
    other = counts.select(F.col("dir").alias("p_dir"), F.col("n").alias("p_n"))
    # A prefix with more lines, or as many and a smaller name, ranks before its child.
    above = counts.join(other, F.col("dir").startswith(F.col("p_dir")) & (F.col("dir") != F.col("p_dir")) & ((F.col("p_n") > F.col("n")) | ((F.col("p_n") == F.col("n")) & (F.col("p_dir") < F.col("dir")))), "left")
    home = above.groupBy("dir", "n").agg(F.min_by("p_dir", F.length("p_dir")).alias("p")).select(F.coalesce("p", "dir").alias("dir"), "n")
    total = home.groupBy("dir").agg(F.sum("n").alias("total"))
    return total.select("dir", "total", F.expr("row_number() over (order by total desc, dir)").cast("long").alias("place"))


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, score): part names that match the pattern "lwd", with their score."""

    @F.pandas_udf("long")
    def score(names: pd.Series) -> pd.Series:
        return names.map(lambda x: fuzzy_score("lwd", x or ""))

    return frame(spark, sf_dir, "part").select("p_partkey", score("p_name").alias("score")).where("score > 0")


_NBMOC = """SELECT 'double close' AS reason, a.inst_id AS inst1, b.inst_id AS inst2 FROM {chan_use} a JOIN {chan_use} b ON a.prim = b.prim AND a.inst_id < b.inst_id WHERE a.op = 'Unlock' AND b.op = 'Unlock'
UNION ALL SELECT 'send after close', s.inst_id, c.inst_id FROM {chan_use} s JOIN {chan_use} c ON s.prim = c.prim AND s.fn_id <> c.fn_id WHERE s.op = 'Send' AND c.op = 'Unlock'"""


def nbmoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reason, inst1, inst2): channel-safety violations that some order of two operations allows."""
    return run_sql(spark, sf_dir, _NBMOC)


SQL = {
    "scan_pkg_paths": r"SELECT DISTINCT dir FROM (SELECT regexp_extract(url, '^https?://([^?]*)/[^/?]*', 1) AS dir FROM pages) WHERE dir <> '' AND contains(dir, '/')",
    "split_option_list": "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split(split_part(url, '?', 2), '&'), lambda x: x <> ''))), ',') AS options FROM pages",
    "read_bug_list_csv": "SELECT p_partkey AS bug_no, p_type AS bug_type, concat('src/', replace(p_name, ' ', '_'), '.go') AS src, CAST(p_size AS BIGINT) AS lineno FROM part",
    "mutex_name_from_source": duck_sql("SELECT inst_id, CASE inst_id % 4 WHEN 0 THEN concat('s.mu', CAST(prim AS STRING)) WHEN 1 THEN concat('a.b.rw', CAST(prim AS STRING)) WHEN 2 THEN concat('m', CAST(prim AS STRING)) END AS name FROM {inst}"),
    "lines_using_name": duck_sql("SELECT doc_id, line_no FROM {doc_line} WHERE regexp_matches(text, '(^|[^A-Za-z])(the|der|les)([^A-Za-z]|$)')"),
    "rank_worthy_paths": """WITH c AS (SELECT dir, sum(n) AS n FROM (SELECT concat(split_part(url, '/', 3), '/', split_part(url, '/', 4)) AS dir, 1 AS n FROM pages
UNION ALL SELECT split_part(url, '/', 3), 1 FROM pages WHERE page_id % 3 = 0) GROUP BY dir),
h AS (SELECT coalesce((SELECT p.dir FROM c p WHERE starts_with(c.dir, p.dir) AND p.dir <> c.dir AND (p.n > c.n OR (p.n = c.n AND p.dir < c.dir)) ORDER BY length(p.dir) LIMIT 1), c.dir) AS dir, n FROM c)
SELECT dir, CAST(sum(n) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(n) DESC, dir) AS place FROM h GROUP BY dir""",
    "nbmoc": duck_sql(_NBMOC),
}
QUERIES = {k: globals()[k] for k in (*SQL, "fuzzy_match")}
