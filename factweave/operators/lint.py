"""Lint passes over calls, types, declarations and struct layouts, as DataFrame plans; the statements for DuckDB are written apart.

Each is a filter or a join of facts on a site, a type or a struct; facts are linear in the program and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.facts import TYPES, duck_sql, frame


def _of(rule) -> list[str]:
    """Types that a rule on (type, kind, bits, pointee, is_iface, is_error) picks."""
    return [t[0] for t in TYPES if rule(*t)]


ERRORS = _of(lambda t, kind, bits, to, iface, error: error)
IFACES = _of(lambda t, kind, bits, to, iface, error: iface)
POINTERS = _of(lambda t, kind, bits, to, iface, error: kind == "pointer")
SLICES = _of(lambda t, kind, bits, to, iface, error: kind == "slice")
TO_ERRORS = [t for t, kind, _, to, *_ in TYPES if kind == "pointer" and (to in ERRORS or to in IFACES)]


def _calls(spark: SparkSession, sf_dir: str, *callees: str) -> DataFrame:
    return frame(spark, sf_dir, "call_arg").where(F.col("callee").isin(*callees))


def lint_errorsas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): the second argument of errors.As is no pointer to an interface or to a type that is an error."""
    return _calls(spark, sf_dir, "errors.As").where(~F.col("type2").isin(*TO_ERRORS)).select("site")


def lint_unmarshal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, callee): what is decoded into is neither a pointer nor an interface."""
    into = F.when(F.col("callee").endswith(".Decode"), F.col("type1")).otherwise(F.col("type2"))
    return _calls(spark, sf_dir, "json.Unmarshal", "xml.Unmarshal", "(*json.Decoder).Decode").where(~into.isin(*POINTERS, *IFACES)).select("site", "callee")


def lint_sortslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): what sort.Slice is given is neither a slice nor an interface."""
    return _calls(spark, sf_dir, "sort.Slice", "sort.SliceStable").where(~F.col("type1").isin(*SLICES, *IFACES)).select("site")


def lint_deepequalerrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): reflect.DeepEqual of two errors."""
    return _calls(spark, sf_dir, "reflect.DeepEqual").where(F.col("type1").isin(*ERRORS) & F.col("type2").isin(*ERRORS)).select("site")


def lint_reflectvaluecompare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): == of reflect.Value with anything but an interface, or DeepEqual of one."""
    one, two = F.col("type1") == "reflect.Value", F.col("type2") == "reflect.Value"
    return _calls(spark, sf_dir, "==", "reflect.DeepEqual").where(one | two).select("site")


def lint_unsafeptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): a number made a pointer."""
    return _calls(spark, sf_dir, "unsafe.Pointer").where("type1 = 'uintptr'").select("site")


def lint_stringintconv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site): string() of an integer that is neither a byte nor a rune."""
    kinds = frame(spark, sf_dir, "go_type").where("kind = 'integer' and type not in ('uint8', 'int32')").select(F.col("type").alias("t"))
    return _calls(spark, sf_dir, "string").join(kinds, F.col("type1") == F.col("t"), "left_semi").select("site")


def lint_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, too_far): a shift by as many bits as the integer has, or more."""
    widths = frame(spark, sf_dir, "go_type").where("kind = 'integer'").select(F.col("type").alias("t"), "bits")
    shifts = _calls(spark, sf_dir, "<<").join(widths, F.col("type1") == F.col("t")).where("const >= bits")
    return shifts.select("site", (F.col("const") - F.col("bits")).cast("long").alias("too_far"))


def _verbs(text: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text, "%%", ""), F.lit("%[a-z]"))


def lint_printf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, missing): verbs of a format less the arguments given, where they differ."""
    missing = (_verbs(F.col("format")) - F.col("n_args")).cast("long")
    return _calls(spark, sf_dir, "fmt.Printf").where(missing != 0).select("site", missing.alias("missing"))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("struct_name").orderBy("field").rowsBetween(Window.unboundedPreceding, -1)
    return frame(spark, sf_dir, "struct_layout").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def lint_atomicalign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name, field, offset): eight-byte fields that do not begin at a multiple of eight."""
    return _offsets(spark, sf_dir).where("size = 8 and offset % 8 <> 0").select("struct_name", "field", "offset")


def lint_stdmethods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, name, want): methods with an agreed name and another signature."""
    std = frame(spark, sf_dir, "std_method").select(F.col("name").alias("s_name"), F.col("signature").alias("want"))
    return frame(spark, sf_dir, "method_decl").join(std, (F.col("name") == F.col("s_name")) & (F.col("signature") != F.col("want"))).select("fn_id", "name", "want")


def lint_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, reason): test functions whose name goes on in lower case, or that take the wrong thing."""
    kind = F.regexp_extract("test_name", "^(Test|Benchmark)", 1)
    rest = F.expr("substr(test_name, length(regexp_extract(test_name, '^(Test|Benchmark)', 1)) + 1)")
    want = F.when(kind == "Test", "(*testing.T)").otherwise("(*testing.B)")
    reason = F.when(rest.rlike("^[a-z]"), "malformed name").when(F.col("test_params") != want, "wrong parameter")
    return frame(spark, sf_dir, "method_decl").where("is_test_file").select("fn_id", reason.alias("reason")).where("reason is not null")


def lint_structtag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name, field, reason): tags that are no list of key:"value", and names that a struct's tags give twice."""
    tags = frame(spark, sf_dir, "struct_tag").where("tag <> ''")
    good = F.col("tag").rlike('^[a-z]+:"[^"]*"( [a-z]+:"[^"]*")*$')
    bad = tags.where(~good).select("struct_name", "field", F.lit("bad syntax").alias("reason"))
    named = tags.where(good).select("struct_name", "field", F.regexp_extract("tag", 'json:"([^"]*)"', 1).alias("name"))
    first = named.groupBy(F.col("struct_name").alias("f_struct"), F.col("name").alias("f_name")).agg(F.min("field").alias("first"))
    again = named.join(first, (F.col("struct_name") == F.col("f_struct")) & (F.col("name") == F.col("f_name")) & (F.col("field") > F.col("first")))
    return bad.unionByName(again.select("struct_name", "field", F.lit("repeats a name").alias("reason")))


def lint_ifaceassert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, v_type, t_type, method): assertions between interfaces that no type can meet, with the first method of both whose signatures differ.

    Equal pairs of interfaces are compared once, however many sites have them. Types without methods never conflict; an assertion that is there twice stands once.
    """
    asserts, methods = frame(spark, sf_dir, "iface_assert").distinct(), frame(spark, sf_dir, "iface_method")
    of = lambda k: methods.select(F.col("type_id").alias(f"{k}_id"), F.col("name").alias(f"{k}_name"), F.col("signature").alias(f"{k}_signature"))
    pairs = asserts.select(F.col("v_type").alias("p_v"), F.col("t_type").alias("p_t")).distinct()
    both = pairs.join(of("v"), F.col("p_v") == F.col("v_id")).join(of("t"), (F.col("p_t") == F.col("t_id")) & (F.col("v_name") == F.col("t_name")))
    bad = both.where("v_signature <> t_signature").groupBy("p_v", "p_t").agg(F.min("t_name").alias("method"))
    return asserts.join(bad, (F.col("v_type") == F.col("p_v")) & (F.col("t_type") == F.col("p_t"))).select("site", "pos", "v_type", "t_type", "method")


def lint_httpresponse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stmt_id, name): responses that the very next statement of the block defers a call on, so before the error is checked.

    The call must be the http package's or a client's, and return a response and an error. A block is bounded, so is its window.
    """
    order = Window.partitionBy("fn_id", "bb_id").orderBy("pos")
    stmts = frame(spark, sf_dir, "http_stmt").withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_root", F.lead("root").over(order))
    asks = (F.col("kind") == "assign") & F.col("called_on").isin("http", "net/http.Client", "*net/http.Client") & (F.col("results") == "(*net/http.Response, error)")
    return stmts.where(asks & (F.col("next_kind") == "defer") & (F.col("root") == F.col("next_root"))).select("stmt_id", F.col("root").alias("name"))


def pta_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, new_id): dense ids, nodes that lie in an object (that have a points-to label) first.

    Ids come from ranges: counts of ranges of ids, their running sums, and a number inside each range; no task sees all.
    """
    every = frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    inside = frame(spark, sf_dir, "obj_addr").select(F.col("node").alias("o_node")).distinct()
    marked = every.join(inside, F.col("node") == F.col("o_node"), "left").select("node", F.col("o_node").isNull().cast("int").alias("late"))
    ranged = marked.withColumn("range", F.floor(F.col("node") / 1024))
    sizes = ranged.groupBy("late", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("late", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("late").alias("s_late"), F.col("range").alias("s_range"), before.alias("start"))
    nth = F.row_number().over(Window.partitionBy("late", "range").orderBy("node"))
    placed = ranged.withColumn("nth", nth).join(starts, (F.col("late") == F.col("s_late")) & (F.col("range") == F.col("s_range")))
    return placed.select("node", (F.col("start") + F.col("nth") - 1).cast("long").alias("new_id"))


def pta_type_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_name, path, offset, size): the fields of each struct with a path name, their offset and size."""
    return _offsets(spark, sf_dir).select("struct_name", F.concat(F.lit("."), F.col("field").cast("string")).alias("path"), "offset", F.col("size").cast("long").alias("size"))


def rel_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, low, high): the interval of idx of a function's locks, widened by that of its unlocks: a bound that moves is dropped."""
    inst = frame(spark, sf_dir, "inst")
    of = lambda op, a, b: inst.where(F.col("op") == op).groupBy(F.col("fn_id").alias(f"fn_{op}")).agg(F.min("idx").alias(a), F.max("idx").alias(b))
    both = of("Lock", "l1", "h1").join(of("Unlock", "l2", "h2"), F.col("fn_Lock") == F.col("fn_Unlock"))
    return both.select(F.col("fn_Lock").alias("fn_id"), F.when(F.col("l2") >= F.col("l1"), F.col("l1")).alias("low"), F.when(F.col("h2") <= F.col("h1"), F.col("h1")).alias("high"))


def rel_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_bb, dst_bb, n_fns): a join of two relations that looks at the block columns only; fn_id is sieved out."""
    edges = frame(spark, sf_dir, "bb_edge")
    return edges.groupBy("src_bb", "dst_bb").agg(F.countDistinct("fn_id").alias("n_fns"))


_T = "SELECT type FROM {go_type} WHERE "
SQL = {
    "lint_errorsas": f"SELECT site FROM {{call_arg}} c LEFT JOIN {{go_type}} t ON c.type2 = t.type LEFT JOIN {{go_type}} p ON t.pointee = p.type WHERE callee = 'errors.As' AND NOT (t.kind = 'pointer' AND (p.is_iface = 1 OR p.is_error = 1))",
    "lint_unmarshal": f"SELECT site, callee FROM {{call_arg}} WHERE (callee IN ('json.Unmarshal', 'xml.Unmarshal') AND type2 IN ({_T} kind NOT IN ('pointer', 'interface'))) OR (callee = '(*json.Decoder).Decode' AND type1 IN ({_T} kind NOT IN ('pointer', 'interface')))",
    "lint_sortslice": f"SELECT site FROM {{call_arg}} WHERE callee LIKE 'sort.Slice%' AND type1 NOT IN ({_T} kind IN ('slice', 'interface'))",
    "lint_deepequalerrors": "SELECT site FROM {call_arg} c JOIN {go_type} a ON c.type1 = a.type JOIN {go_type} b ON c.type2 = b.type WHERE callee = 'reflect.DeepEqual' AND a.is_error + b.is_error = 2",
    "lint_reflectvaluecompare": "SELECT site FROM {call_arg} WHERE callee IN ('==', 'reflect.DeepEqual') AND 'reflect.Value' IN (type1, type2)",
    "lint_unsafeptr": "SELECT site FROM {call_arg} WHERE callee = 'unsafe.Pointer' AND type1 LIKE 'uintptr'",
    "lint_stringintconv": "SELECT site FROM {call_arg} WHERE callee = 'string' AND type1 IN ('int', 'uint16', 'uintptr')",
    "lint_shift": "SELECT site, CAST(const - CASE type1 WHEN 'uint8' THEN 8 WHEN 'uint16' THEN 16 WHEN 'int32' THEN 32 ELSE 64 END AS BIGINT) AS too_far FROM {call_arg} WHERE callee = '<<' AND type1 IN ('int', 'uint8', 'int32', 'uint16', 'uintptr') AND const >= CASE type1 WHEN 'uint8' THEN 8 WHEN 'uint16' THEN 16 WHEN 'int32' THEN 32 ELSE 64 END",
    "lint_printf": "SELECT site, CAST(v - n_args AS BIGINT) AS missing FROM (SELECT site, n_args, CASE WHEN format LIKE 'no verb%' THEN 0 WHEN format LIKE '%and%' THEN 2 WHEN format LIKE '%s %d %v' THEN 3 ELSE 1 END AS v FROM {call_arg} WHERE callee = 'fmt.Printf') WHERE v <> n_args",
    "lint_atomicalign": "SELECT a.struct_name, a.field, CAST(coalesce(sum(b.size), 0) AS BIGINT) AS offset FROM {struct_layout} a LEFT JOIN {struct_layout} b ON a.struct_name = b.struct_name AND b.field < a.field WHERE a.size = 8 GROUP BY a.struct_name, a.field HAVING coalesce(sum(b.size), 0) % 8 <> 0",
    "lint_stdmethods": "SELECT d.fn_id, d.name, s.signature AS want FROM {method_decl} d, {std_method} s WHERE d.name = s.name AND NOT d.signature = s.signature",
    "lint_tests": """SELECT fn_id, CASE WHEN regexp_matches(test_name, '^(Test|Benchmark)[a-z]') THEN 'malformed name' ELSE 'wrong parameter' END AS reason FROM {method_decl}
WHERE is_test_file AND (regexp_matches(test_name, '^(Test|Benchmark)[a-z]') OR right(left(test_params, 11), 1) <> left(replace(test_name, 'Test', 'T'), 1))""",
    "lint_structtag": r'''SELECT struct_name, field, 'bad syntax' AS reason FROM {struct_tag} WHERE tag <> '' AND NOT regexp_full_match(tag, '[a-z]+:"[^"]*"( [a-z]+:"[^"]*")*')
UNION ALL SELECT struct_name, field, 'repeats a name' FROM (SELECT struct_name, field, row_number() OVER (PARTITION BY struct_name, split_part(tag, '"', 2) ORDER BY field) AS nth FROM {struct_tag} WHERE regexp_full_match(tag, '[a-z]+:"[^"]*"( [a-z]+:"[^"]*")*')) WHERE nth > 1''',
    "lint_ifaceassert": """SELECT DISTINCT a.site, a.pos, a.v_type, a.t_type, (SELECT min(t.name) FROM {iface_method} t WHERE t.type_id = a.t_type AND EXISTS (SELECT 1 FROM {iface_method} v WHERE v.type_id = a.v_type AND v.name = t.name AND v.signature <> t.signature)) AS method
FROM {iface_assert} a JOIN {iface_method} x ON a.v_type = x.type_id JOIN {iface_method} y ON a.t_type = y.type_id AND x.name = y.name WHERE x.signature <> y.signature""",
    "lint_httpresponse": """SELECT a.stmt_id, a.root AS name FROM {http_stmt} a JOIN {http_stmt} d ON a.fn_id = d.fn_id AND a.bb_id = d.bb_id AND d.pos = a.pos + 1 WHERE a.kind = 'assign' AND d.kind = 'defer' AND a.root = d.root
AND a.results LIKE '%, error)' AND (a.called_on = 'http' OR a.called_on LIKE '%http.Client')""",
    "pta_renumber": "SELECT p_partkey AS node, CAST(row_number() OVER (ORDER BY CASE WHEN EXISTS (SELECT 1 FROM {obj_addr} o WHERE o.node = p_partkey) THEN 0 ELSE 1 END, p_partkey) - 1 AS BIGINT) AS new_id FROM {part}",
    "pta_type_flatten": "SELECT a.struct_name, concat('.', CAST(a.field AS VARCHAR)) AS path, CAST((SELECT coalesce(sum(b.size), 0) FROM {struct_layout} b WHERE b.struct_name = a.struct_name AND b.field < a.field) AS BIGINT) AS offset, CAST(a.size AS BIGINT) AS size FROM {struct_layout} a",
    "rel_widen": """SELECT l.fn_id, CASE WHEN u.lo < l.lo THEN NULL ELSE l.lo END AS low, CASE WHEN u.hi > l.hi THEN NULL ELSE l.hi END AS high FROM (SELECT fn_id, min(idx) AS lo, max(idx) AS hi FROM {inst} WHERE op = 'Lock' GROUP BY fn_id) l
JOIN (SELECT fn_id, min(idx) AS lo, max(idx) AS hi FROM {inst} WHERE op = 'Unlock' GROUP BY fn_id) u ON l.fn_id = u.fn_id""",
    "rel_sieve": "SELECT src_bb, dst_bb, count(*) AS n_fns FROM (SELECT DISTINCT fn_id, src_bb, dst_bb FROM {bb_edge}) GROUP BY src_bb, dst_bb",
}
SQL = {k: duck_sql(v) for k, v in SQL.items()}
QUERIES = {k: globals()[k] for k in SQL}
