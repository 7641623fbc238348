"""Line de-duplication by winnowing over line hashes. JVM operators only.

The lines of a text that hold a word are hashed, and fingerprints are selected: of every `window` consecutive lines the
smallest hash, and each line of ALONE words or more. So texts that share a run of `window` lines, or of fewer lines with one of
ALONE words, share a fingerprint at the same place of the run. Positions are joined by fingerprint; a fingerprint with one
position drops out. From the others the match extends both ways, line by line, as far as the windows reach that selected the
position: the line itself, it and a shorter neighbour, `window` lines. A window that begins earlier elsewhere is part of a
repeated run; the lines of these runs are deleted.

So: a line goes when it is in a run that also begins earlier (smaller doc_id, or same document and earlier line) and that has
`window` lines, or a line of ALONE words. Lines are compared as they stand, by 128-bit keys; lines without a word are neither
counted nor deleted. What is not found: one or two lines, all of fewer than ALONE words. A fingerprint's or window's positions
meet the earliest one only, never each other: an aggregate with a map-side combine and a join back, in which the positions
of a fingerprint that has a thousandth of all are answered by a broadcast and lie on all partitions.

Cases: null and empty texts lose nothing; a null doc_id counts as larger than any, and documents without one, or with one
doc_id, are told apart and ordered by a hash of their text; repeated rows (same id and text) are one place and both stay as
they are; extra columns are ignored; empty table -> no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import documents, keep, with_groups

_INK, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: Words of a line that is compared on its own.
ALONE = 3
_ALONE = _INK + (f"{_GAP}+{_INK}+" * (ALONE - 1))
_NO_ID = 1 << 63


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(_INK)


def _place(doc_id: Column, rid: Column, line: Column) -> Column:
    """Order of places as one number: doc_id, then line, then a part of the text's hash."""
    big = lambda x, p=20: x.cast(f"decimal({p},0)")
    doc = F.coalesce(big(doc_id), big(F.lit(str(_NO_ID))) + big(F.shiftrightunsigned(rid, 1)))
    at = (doc * big(F.lit(1 << 32), 10) + line).cast("decimal(30,0)")
    return (at * big(F.lit(1 << 24), 8) + F.pmod(rid, F.lit(1 << 24))).cast("decimal(38,0)")


def windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, rid, at, fingerprint, start, size, k1, k2: each window that selects a fingerprint, which stands at line `at`.

    Lines are counted from 0 among those with a word; docs has doc_id, text, rid.
    """
    one = lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), x.rlike(_ALONE).alias("alone"))
    hashed = docs.select("doc_id", "rid", F.transform(F.filter(_lines(F.col("text")), _has_word), one).alias("ls"))
    hashed = hashed.where(F.size("ls") > 0).select("doc_id", "rid", F.col("ls.h").alias("hs"), F.col("ls.g").alias("gs"), F.col("ls.alone").alias("alone"))

    def found(start: Column, size: int, at: Column) -> Column:
        cut = lambda c: F.slice(c, start + 1, F.lit(size))
        keys = (F.xxhash64(cut("hs")).alias("k1"), F.xxhash64(F.lit(size), cut("gs")).alias("k2"))
        return F.struct(start.alias("start"), F.lit(size).alias("size"), at.alias("at"), F.get("hs", at).alias("fingerprint"), *keys)

    def at_line(i: Column) -> Column:
        some, next_ = F.get("alone", i), F.coalesce(F.get("alone", i + 1), F.lit(False))
        lines = F.slice("hs", i + 1, F.lit(window))
        all_alone = F.forall(F.slice("alone", i + 1, F.lit(window)), lambda x: x)
        return F.array(
            F.when(some, found(i, 1, i)),
            F.when((some != next_) & (i + 1 < F.size("hs")), found(i, 2, i + F.when(some, 0).otherwise(1))),
            F.when((i + window <= F.size("hs")) & ~all_alone, found(i, window, i + F.array_position(lines, F.array_min(lines)).cast("int") - 1)),
        )

    each = F.flatten(F.transform(F.sequence(F.lit(0), F.size("hs") - 1), at_line))
    return hashed.select("doc_id", "rid", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("w")).select("doc_id", "rid", "w.*")


def repeated_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, rid, start, size of each window of lines that also begins earlier; docs has doc_id, text, rid."""
    every = keep(windows(docs, window))
    total = every.count()
    # The earliest and the latest position of each fingerprint: those with several are joined.
    at = every.select("fingerprint", _place(F.col("doc_id"), F.col("rid"), F.col("at")).alias("place"))
    again = at.groupBy(F.col("fingerprint").alias("f")).agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.count(F.lit(1)).alias("n")).where("p0 < p1")
    near = with_groups(every, again, {"fingerprint": "f"}, ["n"], "n", total).where("n is not null").drop("n")
    near = near.withColumn("place", _place(F.col("doc_id"), F.col("rid"), F.col("start")))
    first = near.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.count(F.lit(1)).alias("n")).where("p0 < p1")
    met = with_groups(near, first, {"k1": "f1", "k2": "f2"}, ["p0"], "n", total)
    return met.where("place > p0").select("doc_id", "rid", "start", "size")


def line_dedup(docs: DataFrame, window: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, text without the deleted lines: one row for each row of docs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("text"))
    late = repeated_windows(rows, window).groupBy(F.col("doc_id").alias("l_doc_id"), F.col("rid").alias("l_rid")).agg(F.collect_set(F.struct("start", "size")).alias("late"))
    joined = rows.join(late, F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("rid") == F.col("l_rid")), "left")
    lined = joined.select("doc_id", "late", _lines(F.col("text")).alias("lines"))
    inked = lined.select("doc_id", "late", "lines", F.filter(F.transform("lines", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull()).alias("inked"))
    none = F.array().cast("array<struct<start:int,size:int>>")
    gone = F.array_distinct(F.flatten(F.transform(F.coalesce("late", none), lambda w: F.slice("inked", w["start"] + 1, w["size"]))))
    marked = inked.select("doc_id", "lines", F.size("inked").cast("long").alias("n_lines"), gone.alias("gone"))
    stay = F.when(F.size("gone") == 0, F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    )
    return marked.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(stay, "\n").alias("text"))


def op7_line_dedup(spark, sf_dir):
    """The same, with the digest of the text that is left."""
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op7_line_dedup": r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s
), n AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn,
         regexp_matches(line, '[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]') AS alone
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT *, lead(line, 1) OVER d AS line2, lead(alone, 1) OVER d AS alone2, lead(line, 2) OVER d AS line3
  FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), q AS (
  SELECT doc_id, rn, 1 AS size, line AS win FROM w WHERE alone
  UNION ALL SELECT doc_id, rn, 2, line || chr(10) || line2 FROM w WHERE line2 IS NOT NULL AND (alone OR alone2)
  UNION ALL SELECT doc_id, rn, 3, line || chr(10) || line2 || chr(10) || line3 FROM w WHERE line3 IS NOT NULL
), f AS (
  SELECT doc_id, rn, size, row_number() OVER (PARTITION BY win ORDER BY doc_id, rn) AS nth FROM q
), g AS (
  SELECT DISTINCT doc_id, rn + k AS rn FROM f, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1 AND k < size
), m AS (
  SELECT l.doc_id, l.pos, l.line, n.rn, g.rn IS NOT NULL AS gone
  FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.pos = n.pos LEFT JOIN g ON n.doc_id = g.doc_id AND n.rn = g.rn
)
SELECT doc_id, count(rn) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
