"""Fill-in-middle transformation by escaped marker injection, in built-in string functions only.

A text is cut into units (runs of letters, any other code point alone). A delimiter that cannot occur in the escaped text
is put after every unit by one regexp_replace; the delimiters are counted; substring_index takes the parts by rank; the
parts lose their delimiters, are unescaped and put together. Nothing is shuffled, and the work on a text is linear in it.

Draws come from the sha256 of `1:` and the id, so they do not hang on partitions. A text stays plain if it is empty, holds a
marker, or is drawn for it; else it becomes prefix, suffix, middle (psm) or suffix, prefix, middle (spm). No marker occurs
in a text that is cut, and none can come about at a seam (each begins with its only `<`), so outputs are read back exactly.

Cases: null is the empty text (plain); a null doc_id draws as the empty string; repeated rows give repeated results; very long
texts are cut whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import documents

MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: The delimiter, the escape, and what follows the escape where the text itself holds the one or the other.
MARK, ESCAPE, FOR_MARK, FOR_ESCAPE = "\x01", "\x02", "0", "1"
UNIT = f"[A-Za-z]++|{ESCAPE}[{FOR_MARK}{FOR_ESCAPE}]|[^A-Za-z{ESCAPE}]"


def _marked(text: Column) -> Column:
    """The escaped text with a delimiter after every unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + FOR_ESCAPE)), F.lit(MARK), F.lit(ESCAPE + FOR_MARK))
    return F.regexp_replace(escaped, UNIT, f"$0{MARK}")


def _plain(part: Column) -> Column:
    """A part without its delimiters, unescaped."""
    joined = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(joined, F.lit(ESCAPE + FOR_MARK), F.lit(MARK)), F.lit(ESCAPE + FOR_ESCAPE), F.lit(ESCAPE))


def _rank(text: Column, mark: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), count.cast("int"))


def fill_in_middle(docs: DataFrame, rate: int = 90, spm_rate: int = 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output.

    rate is the percentage of texts that are cut, spm_rate that of the cut ones with the suffix first.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(ident.alias("doc_id"), text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))
    rows = rows.withColumn("marked", _marked(F.col("text")))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(MARK), F.lit("")))).cast("long"))
    ends = [F.col(f"h{k}") % (F.col("n") + 1) for k in (1, 2)]
    held = F.lit(False)
    for marker in MARKERS.values():
        held = held | F.contains("text", F.lit(marker))
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= rate)
    rows = rows.select(
        "doc_id", "text", "marked", "n", F.least(*ends).alias("first"), F.greatest(*ends).alias("last"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
    )
    cut = lambda part: F.when(F.col("form") != "plain", _plain(part))
    head = _rank(F.col("marked"), MARK, F.col("last"))  # units up to the middle's end, without the last delimiter
    rows = rows.select(
        "doc_id", "text", "n", "form",
        cut(_rank(F.col("marked"), MARK, F.col("first"))).alias("prefix"),
        cut(_rank(head, MARK, F.col("first") - F.col("last"))).alias("middle"),
        cut(_rank(F.col("marked"), MARK, F.col("last") - F.col("n") - 1)).alias("suffix"),
    )
    part = lambda name: F.concat(F.lit(MARKERS[name]), F.col(name))
    psm, spm = (F.concat(*map(part, order)) for order in (("prefix", "suffix", "middle"), ("suffix", "prefix", "middle")))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.withColumn("output", output)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = (MARKERS[name] for name in ("prefix", "suffix", "middle"))
    between = lambda a, b: _rank(_rank(output, a, F.lit(-1)), b, F.lit(1))
    after = _rank(output, m, F.lit(-1))
    psm = F.concat(between(p, s), after, between(s, m))
    spm = F.concat(between(p, m), after, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(documents(spark, sf_dir))
    chars = lambda name: F.length(name).cast("long").alias(f"{name}_chars")
    digest = lambda text, name: F.sha2(text, 256).alias(name)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output"), "output_sha256"), digest(back, "restored_sha256"))


#: DuckDB takes the units as a list and cuts it by position.
SQL = {
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t
), f AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS pre,
    CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS mid,
    CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1:n], '') END AS suf
  FROM f
)
SELECT doc_id, n, form, CAST(length(pre) AS BIGINT) AS prefix_chars, CAST(length(mid) AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
}
