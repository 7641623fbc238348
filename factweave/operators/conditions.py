"""Path conditions: what must hold where a block is reached, whether conditions contradict each other, and what follows for locks.

A branch compares x with y (names or integers) and goes to true_bb or false_bb. A condition holds in a block if the block is
dominated by one side of the branch and that side is entered by this branch alone. Names are values that are assigned once; a
branch inside a cycle may see them anew, so it states nothing beyond it. Conjunctions are decided over the integers: equalities
and orders are difference bounds, closed by shortest paths, and an inequality is tried on either side.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql
from .cfg import _CLOSURE, _WITHOUT, _dominators
from .fixpoint import after, flipped, keep, per_function, walk

NEGATED = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "==": "!=", "!=": "=="}


@lru_cache(maxsize=1 << 16)
def satisfiable(conds: tuple[tuple[str, str, str, bool], ...]) -> bool:
    """Whether integers exist for which every condition (x, operator, y, flag) is as its flag says; operands are names or integers."""
    bounds: dict[tuple[str, str], int] = {}  # (a, b): a - b is at most this

    def atom(text: str) -> tuple[str, int]:
        return ("", int(text)) if text.lstrip("-").isdigit() else (text, 0)

    def most(a: str, b: str, c: int) -> None:
        bounds[a, b] = min(c, bounds.get((a, b), c))

    apart = []
    for k, (x, op, y, flag) in enumerate(conds):
        op = op if flag else NEGATED[op]
        (a, m), (b, n) = atom(x), atom(y)
        if op in ("<", "<=", "=="):
            most(a, b, n - m - (op == "<"))
        if op in (">", ">=", "=="):
            most(b, a, m - n - (op == ">"))
        if op == "!=":
            apart.append((k, a, b, n - m))
    names = {v for pair in bounds for v in pair}
    for mid in names:
        for a in names:
            for b in names:
                if (a, mid) in bounds and (mid, b) in bounds:
                    most(a, b, bounds[a, mid] + bounds[mid, b])
    if any(bounds.get((a, a), 0) < 0 for a in names):
        return False
    for k, a, b, c in apart:
        if a == b:
            if c == 0:
                return False
            continue
        if bounds.get((a, b), c) >= c and bounds.get((b, a), -c) >= -c:  # a - b = c is not ruled out by the bounds
            if (a, b) not in bounds or (b, a) not in bounds:
                continue  # free on one side: another value is left whatever the others take
            x, _, y, _ = conds[k]
            rest = conds[:k] + conds[k + 1 :]
            return any(satisfiable((*rest, (x, op, y, True))) for op in ("<", ">"))
    return True


def implies(first: tuple, then: tuple) -> bool:
    """Whether whatever meets the first conditions meets the others."""
    return not satisfiable(first) or all(not satisfiable((*first, (x, op, y, not flag))) for x, op, y, flag in then)


def conditions_of(succ: dict, branches: dict, entry: int) -> dict[int, list[tuple]]:
    """For each block, the conditions (branch's block, x, operator, y, flag) that hold in it; branches: block to (true, false, x, operator, y)."""
    dom, pred = _dominators(succ, entry), flipped(succ)
    out: dict = {n: [] for n in dom}
    for d in sorted(branches.keys() & dom.keys()):
        yes, no, *comparison = branches[d]
        if yes == no or d in after(succ, d):
            continue
        for side, flag in ((yes, True), (no, False)):
            if side in dom and side != entry and {p for p in pred[side] if p in dom} == {d}:
                for n in dom:
                    if side in dom[n]:
                        out[n].append((d, *comparison, flag))
    return out


_BLOCKS = """SELECT b.fn_id, b.bb_id AS id, coalesce(c.true_bb, -1) AS yes, coalesce(c.false_bb, -1) AS no, coalesce(c.x, '') AS x, coalesce(c.op, '') AS cmp, coalesce(c.y, '') AS y
FROM {bb} b LEFT JOIN {branch} c ON b.fn_id = c.fn_id AND b.bb_id = c.bb_id"""
_COLUMNS = "fn_id long, bb_id long, cond_bb long, x string, op string, y string, flag boolean"


def _branches(ids, g) -> dict:
    return {n: (yes, no, x, op, y) for n, yes, no, x, op, y in zip(ids, g["yes"].tolist(), g["no"].tolist(), g["x"], g["cmp"], g["y"], strict=True) if op}


def path_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, cond_bb, x, op, y, flag): the conditions that hold wherever a block is reached."""
    edges = frame(spark, sf_dir, "bb_edge").select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))

    def solve(g, s):
        ids = g["id"].tolist()
        held = conditions_of(s, _branches(ids, g), min(ids))
        return [(n, *c) for n, cs in held.items() for c in cs]

    return per_function(run_sql(spark, sf_dir, _BLOCKS), edges, solve, _COLUMNS)


def _sorted_text(rows: DataFrame, keys: list[str], order: str, text: Column, sep: str) -> DataFrame:
    """Texts of the rows of each key, in order, joined."""
    pairs = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("pairs"))
    return pairs.select(*keys, F.array_join(F.transform("pairs", lambda p: p["t"]), sep).alias("text"))


def path_condition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, path_key): the conditions of a block as sorted text; operands of (in)equalities in order, false ones negated."""
    rows = path_conditions(spark, sf_dir)
    op = F.when(F.col("op") == "==", "=").otherwise(F.col("op"))
    swap = F.col("op").isin("==", "!=") & (F.col("x") > F.col("y"))
    one = F.concat(F.lit("("), F.when(swap, F.col("y")).otherwise(F.col("x")), F.lit(" "), op, F.lit(" "), F.when(swap, F.col("x")).otherwise(F.col("y")), F.lit(")"))
    rows = rows.withColumn("text", F.when(F.col("flag"), one).otherwise(F.concat(F.lit("(!"), one, F.lit(")"))))
    return _sorted_text(rows, ["fn_id", "bb_id"], "text", F.col("text"), " && ").withColumnRenamed("text", "path_key")


def _body() -> Column:
    """A comparison in prefix form, without its flag."""
    op = F.when(F.col("op").isin("==", "!="), "=").otherwise(F.col("op"))
    plain = F.concat(F.lit("("), op, F.lit(" "), F.col("x"), F.lit(" "), F.col("y"), F.lit(")"))
    return F.when(F.col("op") == "!=", F.concat(F.lit("(not "), plain, F.lit(")"))).otherwise(plain)


def _flagged(body: Column) -> Column:
    return F.when(F.col("flag"), body).otherwise(F.concat(F.lit("(not "), body, F.lit(")")))


def sink_smt2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, smt): a block's conditions as a solver's script: names, a constant for each condition, what they come to."""
    rows = keep(path_conditions(spark, sf_dir))
    key, const = ["fn_id", "bb_id"], F.concat(F.lit("c"), F.col("cond_bb").cast("string"))
    operands = rows.select(*key, F.explode(F.array("x", "y")).alias("name")).where(~F.col("name").rlike("^-?[0-9]+$")).distinct()
    names = _sorted_text(operands, key, "name", F.concat(F.lit("(declare-const "), F.col("name"), F.lit(" Int)")), "")
    declared = F.concat(F.lit("(declare-const "), const, F.lit(" Bool)(assert (= "), const, F.lit(" "), _body(), F.lit("))"))
    bodies = _sorted_text(rows, key, "cond_bb", declared, "").withColumnsRenamed({"fn_id": "b_fn", "bb_id": "b_bb", "text": "bodies"})
    final = _sorted_text(rows, key, "cond_bb", _flagged(const), " ").withColumnsRenamed({"fn_id": "f_fn", "bb_id": "f_bb", "text": "final"})
    joined = bodies.join(final, (F.col("b_fn") == F.col("f_fn")) & (F.col("b_bb") == F.col("f_bb"))).join(names, (F.col("b_fn") == F.col("fn_id")) & (F.col("b_bb") == F.col("bb_id")), "left")
    smt = F.concat(F.coalesce("text", F.lit("")), "bodies", F.lit("(declare-const Final Bool)(assert (= Final (and true "), "final", F.lit(")))(assert Final)(check-sat)"))
    return joined.select(F.col("b_fn").alias("fn_id"), F.col("b_bb").alias("bb_id"), smt.alias("smt"))


_PAIRS = "SELECT DISTINCT l.fn_id AS p_fn, l.bb_id AS bb1, u.bb_id AS bb2 FROM {inst} l JOIN {inst} u ON l.fn_id = u.fn_id AND l.prim = u.prim AND l.bb_id <> u.bb_id WHERE l.op = 'Lock' AND u.op = 'Unlock'"


def _preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb1, bb2, lcd, conds1, conds2) for blocks that lock and unlock one lock: their conditions from the last common dominator on."""
    pairs = run_sql(spark, sf_dir, _PAIRS).groupBy(F.col("p_fn")).agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.concat_ws(":", F.col("bb1").cast("string"), F.col("bb2").cast("string"))))).alias("pairs"))
    nodes = run_sql(spark, sf_dir, _BLOCKS).join(pairs, F.col("fn_id") == F.col("p_fn")).drop("p_fn")
    edges = frame(spark, sf_dir, "bb_edge").select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))

    def solve(g, s):
        ids = g["id"].tolist()
        dom, held = _dominators(s, min(ids)), conditions_of(s, _branches(ids, g), min(ids))
        out = []
        for pair in g["pairs"][0].split():
            b1, b2 = map(int, pair.split(":"))
            if b1 in dom and b2 in dom:
                lcd = max(dom[b1] & dom[b2], key=lambda d: (len(dom[d]), d))
                conds = ["|".join(f"{d} {x} {op} {y} {int(flag)}" for d, x, op, y, flag in held[b] if lcd in dom[d]) for b in (b1, b2)]
                out.append((b1, b2, lcd, *conds))
        return out

    rows = per_function(nodes, edges, solve, "fn_id long, bb1 long, bb2 long, lcd long, conds1 string, conds2 string")
    part = lambda c: F.transform(F.filter(F.split(c, "\\|"), lambda t: t != ""), _cond)
    return rows.select("fn_id", "bb1", "bb2", "lcd", part("conds1").alias("conds1"), part("conds2").alias("conds2"))


def _cond(text: Column) -> Column:
    words = F.split(text, " ")
    return F.struct(words[1].alias("x"), words[2].alias("op"), words[3].alias("y"), (words[4] == "1").alias("flag"))


def _conjunction(conds: str) -> Column:
    def one(c: Column) -> Column:
        op = F.when(c["op"].isin("==", "!="), "=").otherwise(c["op"])
        plain = F.concat(F.lit("("), op, F.lit(" "), c["x"], F.lit(" "), c["y"], F.lit(")"))
        turned = (c["op"] == "!=") == c["flag"]
        return F.when(turned, F.concat(F.lit("(not "), plain, F.lit(")"))).otherwise(plain)

    return F.concat(F.lit("(and true"), F.array_join(F.transform(conds, lambda c: F.concat(F.lit(" "), one(c))), ""), F.lit(")"))


def bb_precondition_smt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb1, bb2, lcd, pre1, pre2): the conditions of two blocks from their last common dominator on."""
    rows = _preconditions(spark, sf_dir)
    return rows.select("fn_id", "bb1", "bb2", "lcd", _conjunction("conds1").alias("pre1"), _conjunction("conds2").alias("pre2"))


def smt_implication_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb1, bb2, text, implied): that the first block's conditions imply the second's, as text (stated twice) and decided."""

    @F.pandas_udf("boolean")
    def decided(first: pd.Series, then: pd.Series) -> pd.Series:
        rows = lambda cs: tuple((c["x"], c["op"], c["y"], bool(c["flag"])) for c in cs)
        return pd.Series([implies(rows(a), rows(b)) for a, b in zip(first, then, strict=True)], dtype=bool)

    one = F.concat(F.lit("(assert (=> "), _conjunction("conds1"), F.lit(" "), _conjunction("conds2"), F.lit("))"))
    return _preconditions(spark, sf_dir).select("fn_id", "bb1", "bb2", F.concat(one, one).alias("text"), decided("conds1", "conds2").alias("implied"))


_NODES = """SELECT i.fn_id, i.inst_id AS id, i.idx, i.bb_id, i.op, i.prim, i.is_defer, coalesce(c.true_bb, -1) AS yes, coalesce(c.false_bb, -1) AS no, coalesce(c.x, '') AS x, coalesce(c.op, '') AS cmp, coalesce(c.y, '') AS y
FROM {inst} i LEFT JOIN {branch} c ON i.fn_id = c.fn_id AND i.bb_id = c.bb_id"""


def forget_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, lock_id, prim): locks that may still be held after an exit instruction and that no deferred unlock releases.

    A way out does not take a branch's side that contradicts the conditions of the lock's block, so a lock whose unlock stands
    under the same conditions is no report; neither is one whose own conditions contradict each other.
    """
    edges = frame(spark, sf_dir, "bb_edge").select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))

    def solve(g, s):
        ids, idx, bb = g["id"].tolist(), g["idx"].tolist(), g["bb_id"].tolist()
        op, prim = (dict(zip(ids, g[c], strict=True)) for c in ("op", "prim"))
        first, last, block = {}, {}, dict(zip(ids, bb, strict=True))
        for _, n in sorted(zip(idx, ids, strict=True)):
            first.setdefault(block[n], n)
            last[block[n]] = n
        blocks = {b: sorted({block[m] for m in s[n]}) for b, n in last.items()}
        branches = _branches(bb, g)
        held = conditions_of(blocks, branches, block[min(zip(idx, ids, strict=True))[1]])
        ends = {n for n, ms in s.items() if not ms}
        deferred = {(prim[d], n) for d, late in zip(ids, g["is_defer"], strict=True) if late and op[d] == "Unlock" for n in walk(s, [d])}
        out = []
        for lock in (n for n in ids if op[n] == "Lock" and block[n] in held):
            base, p = tuple(c[1:] for c in held[block[lock]]), prim[lock]
            if not satisfiable(base):
                continue
            ways = dict(s)
            for b, (yes, no, *comparison) in branches.items() if base else ():
                for side, flag in ((yes, True), (no, False)):
                    if yes != no and side in first and not satisfiable((*base, (*comparison, flag))):
                        ways[last[b]] = [m for m in ways[last[b]] if m != first[side]]
            frees = lambda n, p=p: op[n] == "Unlock" and prim[n] == p
            left = {n for n in after(ways, lock, frees) if n in ends and not frees(n)} | ({lock} & ends)
            out += [(lock, p)] if any((p, n) not in deferred for n in left) else []
        return out

    return per_function(run_sql(spark, sf_dir, _NODES), edges, solve, "fn_id long, lock_id long, prim long")


# For DuckDB, over the integers from -1 to 5: the facts compare each name with one of 0 to 3.
_OK = "(CASE {0}.op WHEN '<' THEN v < CAST({0}.y AS BIGINT) WHEN '<=' THEN v <= CAST({0}.y AS BIGINT) WHEN '>' THEN v > CAST({0}.y AS BIGINT) WHEN '>=' THEN v >= CAST({0}.y AS BIGINT) WHEN '==' THEN v = CAST({0}.y AS BIGINT) ELSE v <> CAST({0}.y AS BIGINT) END = {0}.flag)"
_BASE = _CLOSURE + ", " + _WITHOUT + """, side AS (SELECT fn_id, bb_id AS cond_bb, true_bb AS to_bb, x, op, y, true AS flag FROM {branch} UNION ALL SELECT fn_id, bb_id, false_bb, x, op, y, false FROM {branch}),
base AS (SELECT s.fn_id, d.bb_id, s.cond_bb, s.x, s.op, s.y, s.flag FROM side s JOIN dom d ON s.fn_id = d.fn_id AND s.to_bb = d.dom_bb
WHERE (SELECT count(*) FROM {bb_edge} e WHERE e.fn_id = s.fn_id AND e.dst_bb = s.to_bb) = 1 AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.fn_id = s.fn_id AND r.src_bb = s.cond_bb AND r.dst_bb = s.cond_bb))"""
_BODY = "concat('(', CASE WHEN {0}.op IN ('==', '!=') THEN '=' ELSE {0}.op END, ' ', {0}.x, ' ', {0}.y, ')')"
_TURNED = f"CASE WHEN {{0}}.flag THEN {_BODY} ELSE concat('(not ', {_BODY}, ')') END"
_LCD = _BASE + ", pair AS (" + _PAIRS + """), low AS (SELECT p.p_fn AS fn_id, p.bb1, p.bb2, arg_max(a.dom_bb, (SELECT count(*) FROM dom c WHERE c.fn_id = a.fn_id AND c.bb_id = a.dom_bb) * 100000 + a.dom_bb) AS lcd
FROM pair p JOIN dom a ON a.fn_id = p.p_fn AND a.bb_id = p.bb1 JOIN dom b ON b.fn_id = p.p_fn AND b.bb_id = p.bb2 AND b.dom_bb = a.dom_bb GROUP BY p.p_fn, p.bb1, p.bb2),
pre AS (SELECT l.fn_id, l.bb1, l.bb2, l.lcd, w.nr, c.cond_bb, c.x, c.op, c.y, c.flag FROM low l, (VALUES (1), (2)) w(nr) JOIN base c ON c.fn_id = l.fn_id AND c.bb_id = CASE w.nr WHEN 1 THEN l.bb1 ELSE l.bb2 END JOIN dom d ON d.fn_id = l.fn_id AND d.bb_id = c.cond_bb AND d.dom_bb = l.lcd),
said AS (SELECT fn_id, bb1, bb2, nr, string_agg(concat(' ', """ + _TURNED.format("pre") + """), '' ORDER BY cond_bb) AS text FROM pre GROUP BY fn_id, bb1, bb2, nr),
both_pre AS (SELECT l.*, concat('(and true', coalesce(a.text, ''), ')') AS pre1, concat('(and true', coalesce(b.text, ''), ')') AS pre2 FROM low l
LEFT JOIN said a ON a.fn_id = l.fn_id AND a.bb1 = l.bb1 AND a.bb2 = l.bb2 AND a.nr = 1 LEFT JOIN said b ON b.fn_id = l.fn_id AND b.bb1 = l.bb1 AND b.bb2 = l.bb2 AND b.nr = 2),
room AS (SELECT fn_id, bb1, bb2, x, list(DISTINCT v) FILTER (fits) AS vs FROM (SELECT fn_id, bb1, bb2, x, v, bool_and(""" + _OK.format("pre") + """) AS fits FROM pre, range(-1, 6) t(v) WHERE nr = 1 GROUP BY fn_id, bb1, bb2, x, v) GROUP BY fn_id, bb1, bb2, x),
open_cond AS (SELECT DISTINCT p.fn_id, p.bb1, p.bb2 FROM pre p LEFT JOIN room r ON r.fn_id = p.fn_id AND r.bb1 = p.bb1 AND r.bb2 = p.bb2 AND r.x = p.x, range(-1, 6) t(v) WHERE p.nr = 2 AND (r.x IS NULL OR list_contains(r.vs, v)) AND NOT """ + _OK.format("p") + """),
never AS (SELECT DISTINCT fn_id, bb1, bb2 FROM room WHERE vs IS NULL)"""
_FORGET = _BASE + """, room AS (SELECT fn_id, bb_id, x, list(DISTINCT v) FILTER (fits) AS vs FROM (SELECT fn_id, bb_id, x, v, bool_and(""" + _OK.format("base") + """) AS fits FROM base, range(-1, 6) t(v) GROUP BY fn_id, bb_id, x, v) GROUP BY fn_id, bb_id, x),
shut AS (SELECT r.fn_id, r.bb_id, s.cond_bb, s.to_bb FROM room r JOIN side s ON r.fn_id = s.fn_id AND r.x = s.x LEFT JOIN range(-1, 6) t(v) ON list_contains(r.vs, v) AND """ + _OK.format("s") + """ GROUP BY r.fn_id, r.bb_id, s.cond_bb, s.to_bb HAVING count(v) = 0),
step AS (SELECT e.fn_id, e.src, e.dst, a.bb_id AS src_bb, b.bb_id AS dst_bb, b.idx = m.first_idx AND a.idx = n.last_idx AS jump FROM {inst_edge} e JOIN {inst} a ON e.src = a.inst_id JOIN {inst} b ON e.dst = b.inst_id JOIN {bb_ends} m ON m.fn_id = b.fn_id AND m.bb_id = b.bb_id JOIN {bb_ends} n ON n.fn_id = a.fn_id AND n.bb_id = a.bb_id),
held AS (SELECT l.fn_id, l.inst_id AS lock_id, l.prim, l.bb_id AS lock_bb, l.inst_id AS at FROM {inst} l WHERE l.op = 'Lock' AND NOT EXISTS (SELECT 1 FROM room r WHERE r.fn_id = l.fn_id AND r.bb_id = l.bb_id AND r.vs IS NULL)
UNION SELECT h.fn_id, h.lock_id, h.prim, h.lock_bb, s.dst FROM held h JOIN {inst} i ON h.at = i.inst_id JOIN step s ON h.at = s.src LEFT JOIN shut c ON s.jump AND c.fn_id = h.fn_id AND c.bb_id = h.lock_bb AND c.cond_bb = s.src_bb AND c.to_bb = s.dst_bb
WHERE c.fn_id IS NULL AND NOT (i.op = 'Unlock' AND i.prim = h.prim)),
ends AS (SELECT fn_id, inst_id FROM {inst} i WHERE NOT EXISTS (SELECT 1 FROM {inst_edge} e WHERE e.src = i.inst_id)),
late AS (SELECT fn_id, inst_id AS d, prim, inst_id AS at FROM {inst} WHERE is_defer AND op = 'Unlock' UNION SELECT l.fn_id, l.d, l.prim, e.dst FROM late l JOIN {inst_edge} e ON l.at = e.src)"""
SQL = {
    "path_conditions": duck_sql("SELECT fn_id, bb_id, cond_bb, x, op, y, flag FROM base", _BASE),
    "path_condition_key": duck_sql(
        """SELECT fn_id, bb_id, string_agg(t, ' && ' ORDER BY t) AS path_key FROM (SELECT fn_id, bb_id, CASE WHEN flag THEN one ELSE concat('(!', one, ')') END AS t
FROM (SELECT *, concat('(', CASE WHEN op IN ('==', '!=') THEN least(x, y) ELSE x END, ' ', CASE op WHEN '==' THEN '=' ELSE op END, ' ', CASE WHEN op IN ('==', '!=') THEN greatest(x, y) ELSE y END, ')') AS one FROM base)) GROUP BY fn_id, bb_id""",
        _BASE,
    ),
    "sink_smt2_text": duck_sql(
        f"""SELECT b.fn_id, b.bb_id, concat((SELECT string_agg(DISTINCT concat('(declare-const ', n.x, ' Int)'), '' ORDER BY concat('(declare-const ', n.x, ' Int)')) FROM base n WHERE n.fn_id = b.fn_id AND n.bb_id = b.bb_id),
string_agg(concat('(declare-const c', cond_bb, ' Bool)(assert (= c', cond_bb, ' ', {_BODY.format("b")}, '))'), '' ORDER BY cond_bb), '(declare-const Final Bool)(assert (= Final (and true ',
string_agg(CASE WHEN flag THEN concat('c', cond_bb) ELSE concat('(not c', cond_bb, ')') END, ' ' ORDER BY cond_bb), ')))(assert Final)(check-sat)') AS smt FROM base b GROUP BY b.fn_id, b.bb_id""",
        _BASE,
    ),
    "bb_precondition_smt": duck_sql("SELECT fn_id, bb1, bb2, lcd, pre1, pre2 FROM both_pre", _LCD),
    "smt_implication_of_union": duck_sql(
        """SELECT b.fn_id, b.bb1, b.bb2, repeat(concat('(assert (=> ', pre1, ' ', pre2, '))'), 2) AS text, o.fn_id IS NULL OR n.fn_id IS NOT NULL AS implied
FROM both_pre b LEFT JOIN open_cond o ON o.fn_id = b.fn_id AND o.bb1 = b.bb1 AND o.bb2 = b.bb2 LEFT JOIN never n ON n.fn_id = b.fn_id AND n.bb1 = b.bb1 AND n.bb2 = b.bb2""",
        _LCD,
    ),
    "forget_unlock": duck_sql(
        """SELECT DISTINCT h.fn_id, h.lock_id, h.prim FROM held h JOIN ends e ON h.at = e.inst_id JOIN {inst} i ON h.at = i.inst_id WHERE NOT (i.op = 'Unlock' AND i.prim = h.prim)
AND NOT EXISTS (SELECT 1 FROM late l WHERE l.prim = h.prim AND l.at = h.at)""",
        _FORGET,
    ),
}
QUERIES = {k: globals()[k] for k in SQL}
