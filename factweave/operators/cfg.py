"""Control-flow operators over the blocks of each function: reachability, dominance, loops, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import duck_sql, frame, run_sql
from .fixpoint import after, flipped, keep, per_function, walk


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = {"bb": keep(frame(spark, sf_dir, "bb"))}
    nodes = seen["bb"].select("fn_id", F.col("bb_id").alias("id"))
    return nodes, frame(spark, sf_dir, "bb_edge", seen).select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))


def reachable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, src_bb, dst_bb): blocks reached from a block; itself only if it is reached again."""
    return per_function(*_blocks(spark, sf_dir), lambda g, s: [(a, b) for a in s for b in after(s, a)], "fn_id long, src_bb long, dst_bb long")


def _dominators(succ: dict, entry: int = 0) -> dict[int, set]:
    """Textbook dominators of the blocks reachable from the entry."""
    live = walk(succ, [entry])
    pred = flipped(succ)
    dom = {n: set(live) for n in live}
    dom[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for n in sorted(live - {entry}):
            new = {n} | set.intersection(*(dom[p] for p in pred[n] if p in live))
            if new != dom[n]:
                dom[n], changed = new, True
    return dom


def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, dom_bb, bb_id): dom_bb is on every path from the entry block to bb_id."""
    return per_function(*_blocks(spark, sf_dir), lambda g, s: [(d, n) for n, ds in _dominators(s).items() for d in ds], "fn_id long, dom_bb long, bb_id long")


def _post_least(succ: dict) -> dict[int, set]:
    """after(b) = intersection of before(s) over b's successors, before(b) = after(b) + {b}, from empty sets upwards."""
    before = {n: set() for n in succ}
    end = {n: set() for n in succ}
    changed = True
    while changed:
        changed = False
        for n, ms in succ.items():
            new = set.intersection(*(before[m] for m in ms)) if ms else set()
            if new != end[n] or n not in before[n]:
                end[n], before[n], changed = new, new | {n}, True
    return end


def post_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, post_bb) as a least fixpoint: every path from bb_id, endless ones too, comes by post_bb."""
    return per_function(*_blocks(spark, sf_dir), lambda g, s: [(n, p) for n, ps in _post_least(s).items() for p in ps], "fn_id long, bb_id long, post_bb long")


def both_blocks_happen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, a_bb, b_bb), a_bb < b_bb: blocks with one predecessor each, which end in equal conditions, one post-dominating the other."""
    return run_sql(spark, sf_dir, _BOTH, post=keep(post_dominators(spark, sf_dir)))


def natural_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, header_bb, body_bb): edges whose head dominates their tail, and what reaches the tail without the head."""

    def solve(g, s):
        dom, pred = _dominators(s), flipped(s)
        out = set()
        for tail, heads in s.items():
            for head in heads:
                if tail in dom and head in dom[tail]:
                    out |= {(head, b) for b in walk(pred, [tail], lambda n, h=head: n == h) if b in dom} | {(head, head)}
        return sorted(out)

    return per_function(*_blocks(spark, sf_dir), solve, "fn_id long, header_bb long, body_bb long")


def loop_blocks_any_backedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id): blocks on a cycle, whether or not its head dominates it."""
    return per_function(*_blocks(spark, sf_dir), lambda g, s: [(n,) for n in s if n in after(s, n)], "fn_id long, bb_id long")


def reach_entry_avoiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, exit_bb, avoidable): can an exit block be reached from the entry without a block whose number is 2 mod 4?"""

    def solve(g, s):
        free = walk(s, [0], lambda n: n % 4 == 2)
        return [(n, n in free and n % 4 != 2) for n, ms in s.items() if not ms]

    return per_function(*_blocks(spark, sf_dir), solve, "fn_id long, exit_bb long, avoidable boolean")


def last_common_dominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb1, bb2, lcd): the last block, by number, that dominates two blocks that follow one another."""

    def solve(g, s):
        dom = _dominators(s)
        return [(n, n + 1, max(dom[n] & dom[n + 1])) for n in sorted(dom) if n + 1 in dom]

    return per_function(*_blocks(spark, sf_dir), solve, "fn_id long, bb1 long, bb2 long, lcd long")


def happens_before_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, inst1, inst2): inst1 may run before inst2, an operation on the same primitive: by index in a block, else by reachability; deferred ones run last."""
    inst = frame(spark, sf_dir, "inst").where("op in ('Send', 'Recv') and prim is not null")
    nodes = inst.select("fn_id", F.col("inst_id").alias("id"), F.col("bb_id").alias("block"), "idx", "prim", "is_defer")

    def solve(g, s):
        ops, ahead = {}, {b: after(s, b) for b in set(g["block"].tolist())}
        for op in zip(*(g[c].tolist() for c in ("id", "block", "idx", "prim", "is_defer")), strict=True):
            ops.setdefault(op[3], []).append(op)

        def happens(a, b):
            # Two deferred instructions run in the opposite order; a deferred one comes after every other.
            if a[4] or b[4]:
                return bool(b[4]) and (not a[4] or a[2] > b[2])
            return a[2] < b[2] if a[1] == b[1] else b[1] in ahead[a[1]]

        return [(a[0], b[0]) for same in ops.values() for a in same for b in same if a[0] != b[0] and happens(a, b)]

    # Blocks are known by their number and operations by theirs: edges are between blocks, so the two do not meet.
    return per_function(nodes, _blocks(spark, sf_dir)[1], solve, "fn_id long, inst1 long, inst2 long")


def postdominates_by_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, pre_bb, post_bb), different blocks: every way out that comes by pre_bb meets post_bb after it; some way out does.

    Ways out are paths from the entry to an exit block, loops any number of times; so post_bb may not be avoidable between
    pre_bb and an exit. Endless paths do not count, unlike in post_dominators.
    """

    def solve(g, s):
        live, back = walk(s, [0]), flipped(s)
        out = walk(back, [n for n in s if not s[n]])
        on_way = live & out
        rows = []
        for post in on_way:
            free = walk({n: [m for m in ms if m != post] for n, ms in back.items()}, [n for n in s if not s[n] and n != post])
            rows += [(pre, post) for pre in on_way if pre != post and pre not in free]
        return sorted(rows)

    return per_function(*_blocks(spark, sf_dir), solve, "fn_id long, pre_bb long, post_bb long")


def fuse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, bb_id, into_bb): live blocks, each with the first block of the straight line that it is fused into."""

    def solve(g, s):
        live = walk(s, [0])
        pred = flipped({n: ms for n, ms in s.items() if n in live})
        head: dict = {}
        for n in sorted(live):
            line = [n]
            while line[-1] not in head:
                before = pred.get(line[-1], [])
                if line[-1] == 0 or len(before) != 1 or len(s[before[0]]) != 1 or before[0] in line:
                    head[line[-1]] = line[-1]
                    break
                line.append(before[0])
            for m in reversed(line):
                head.setdefault(m, head[line[-1]])
        return sorted(head.items())

    return per_function(*_blocks(spark, sf_dir), solve, "fn_id long, bb_id long, into_bb long")


_CLOSURE = """reach AS (SELECT fn_id, src_bb, dst_bb FROM {bb_edge} UNION SELECT r.fn_id, r.src_bb, e.dst_bb FROM reach r JOIN {bb_edge} e ON r.fn_id = e.fn_id AND r.dst_bb = e.src_bb)"""
#: without(x, n): n is reached from the entry when block x is taken out.
_WITHOUT = """live AS (SELECT DISTINCT fn_id, CAST(0 AS BIGINT) AS n FROM {bb} UNION SELECT l.fn_id, e.dst_bb FROM live l JOIN {bb_edge} e ON l.fn_id = e.fn_id AND l.n = e.src_bb),
without AS (SELECT fn_id, n AS x, CAST(0 AS BIGINT) AS n FROM live WHERE n <> 0 UNION
SELECT w.fn_id, w.x, e.dst_bb FROM without w JOIN {bb_edge} e ON w.fn_id = e.fn_id AND w.n = e.src_bb WHERE e.dst_bb <> w.x),
dom AS (SELECT a.fn_id, a.n AS dom_bb, b.n AS bb_id FROM live a JOIN live b ON a.fn_id = b.fn_id
WHERE a.n = 0 OR NOT EXISTS (SELECT 1 FROM without w WHERE w.fn_id = a.fn_id AND w.x = a.n AND w.n = b.n))"""

_POST = """SELECT b.fn_id, b.bb_id, x.bb_id AS post_bb FROM {bb} b JOIN {bb} x ON b.fn_id = x.fn_id WHERE EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = b.fn_id AND e.src_bb = b.bb_id)
AND NOT EXISTS (SELECT 1 FROM {bb_edge} e JOIN bad ON bad.fn_id = e.fn_id AND bad.x = x.bb_id AND bad.n = e.dst_bb WHERE e.fn_id = b.fn_id AND e.src_bb = b.bb_id)"""
_AVOID = """av AS (SELECT e.fn_id, x.bb_id AS x, e.src_bb AS a, e.dst_bb AS b FROM {bb_edge} e JOIN {bb} x ON e.fn_id = x.fn_id WHERE e.src_bb <> x.bb_id AND e.dst_bb <> x.bb_id
UNION SELECT av.fn_id, av.x, av.a, e.dst_bb FROM av JOIN {bb_edge} e ON av.fn_id = e.fn_id AND av.b = e.src_bb WHERE e.dst_bb <> av.x),
ends AS (SELECT fn_id, bb_id AS n FROM {bb} b WHERE NOT EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = b.fn_id AND e.src_bb = b.bb_id)),
bad AS (SELECT e.fn_id, x.bb_id AS x, e.n FROM ends e JOIN {bb} x ON e.fn_id = x.fn_id WHERE e.n <> x.bb_id
UNION SELECT fn_id, x, a FROM av WHERE a = b UNION SELECT av.fn_id, av.x, av.a FROM av JOIN ends e ON av.fn_id = e.fn_id AND av.b = e.n
UNION SELECT av.fn_id, av.x, av.a FROM av JOIN av c ON av.fn_id = c.fn_id AND av.x = c.x AND av.b = c.a AND c.a = c.b)"""
_BOTH = """SELECT DISTINCT p.fn_id, least(a.dst_bb, b.dst_bb) AS a_bb, greatest(a.dst_bb, b.dst_bb) AS b_bb FROM {post} p JOIN {one_pred} a ON p.fn_id = a.fn_id AND p.bb_id = a.src_bb
JOIN {one_pred} b ON p.fn_id = b.fn_id AND p.post_bb = b.src_bb JOIN {if_cond} c ON p.fn_id = c.fn_id AND p.bb_id = c.bb_id JOIN {if_cond} d ON p.fn_id = d.fn_id AND p.post_bb = d.bb_id
WHERE a.dst_bb <> b.dst_bb AND p.bb_id <> p.post_bb AND c.cond = d.cond"""
SQL = {
    "reachable_blocks": duck_sql("SELECT fn_id, src_bb, dst_bb FROM reach", _CLOSURE),
    "dominators": duck_sql("SELECT fn_id, dom_bb, bb_id FROM dom", _WITHOUT),
    "post_dominators": duck_sql(_POST, _AVOID),
    "both_blocks_happen": duck_sql(_BOTH, _AVOID + ", post AS (" + _POST + ")"),
    "natural_loops": duck_sql(
        "SELECT DISTINCT fn_id, h AS header_bb, n AS body_bb FROM body UNION SELECT fn_id, h, h FROM back",
        _WITHOUT
        + """, back AS (SELECT e.fn_id, e.src_bb AS t, e.dst_bb AS h FROM {bb_edge} e JOIN dom d ON d.fn_id = e.fn_id AND d.dom_bb = e.dst_bb AND d.bb_id = e.src_bb),
body AS (SELECT fn_id, h, t AS n FROM back UNION SELECT b.fn_id, b.h, e.src_bb FROM body b JOIN {bb_edge} e ON b.fn_id = e.fn_id AND b.n = e.dst_bb JOIN live l ON l.fn_id = e.fn_id AND l.n = e.src_bb WHERE b.n <> b.h)""",
    ),
    "loop_blocks_any_backedge": duck_sql("SELECT fn_id, src_bb AS bb_id FROM reach WHERE src_bb = dst_bb", _CLOSURE),
    "reach_entry_avoiding": duck_sql(
        """SELECT b.fn_id, b.bb_id AS exit_bb, b.bb_id % 4 <> 2 AND EXISTS (SELECT 1 FROM free f WHERE f.fn_id = b.fn_id AND f.n = b.bb_id) AS avoidable FROM {bb} b
WHERE NOT EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = b.fn_id AND e.src_bb = b.bb_id)""",
        "free AS (SELECT DISTINCT fn_id, CAST(0 AS BIGINT) AS n FROM {bb} UNION SELECT f.fn_id, e.dst_bb FROM free f JOIN {bb_edge} e ON f.fn_id = e.fn_id AND f.n = e.src_bb WHERE f.n % 4 <> 2)",
    ),
    "last_common_dominator": duck_sql(
        "SELECT a.fn_id, a.bb_id AS bb1, b.bb_id AS bb2, max(a.dom_bb) AS lcd FROM dom a JOIN dom b ON a.fn_id = b.fn_id AND a.dom_bb = b.dom_bb AND b.bb_id = a.bb_id + 1 GROUP BY a.fn_id, a.bb_id, b.bb_id", _WITHOUT
    ),
    "happens_before_intra": duck_sql(
        """SELECT a.fn_id, a.inst_id AS inst1, b.inst_id AS inst2 FROM {inst} a JOIN {inst} b ON a.fn_id = b.fn_id AND a.inst_id <> b.inst_id AND a.prim = b.prim AND a.op IN ('Send', 'Recv') AND b.op IN ('Send', 'Recv')
WHERE CASE WHEN a.is_defer AND b.is_defer THEN a.idx > b.idx WHEN b.is_defer THEN true WHEN a.is_defer THEN false WHEN a.bb_id = b.bb_id THEN a.idx < b.idx
ELSE EXISTS (SELECT 1 FROM reach r WHERE r.fn_id = a.fn_id AND r.src_bb = a.bb_id AND r.dst_bb = b.bb_id) END""",
        _CLOSURE,
    ),
}
#: Ways out that avoid a block, walked backwards: none(x, n) says that n reaches an exit without x.
_AVOID = """live AS (SELECT DISTINCT fn_id, CAST(0 AS BIGINT) AS n FROM {bb} UNION SELECT l.fn_id, e.dst_bb FROM live l JOIN {bb_edge} e ON l.fn_id = e.fn_id AND l.n = e.src_bb),
ends AS (SELECT fn_id, bb_id AS n FROM {bb} b WHERE NOT EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = b.fn_id AND e.src_bb = b.bb_id)),
outs AS (SELECT fn_id, n FROM ends UNION SELECT o.fn_id, e.src_bb FROM outs o JOIN {bb_edge} e ON o.fn_id = e.fn_id AND o.n = e.dst_bb),
way AS (SELECT l.fn_id, l.n FROM live l JOIN outs o ON l.fn_id = o.fn_id AND l.n = o.n),
free AS (SELECT w.fn_id, w.n AS x, e.n FROM way w JOIN ends e ON w.fn_id = e.fn_id AND e.n <> w.n
UNION SELECT f.fn_id, f.x, e.src_bb FROM free f JOIN {bb_edge} e ON f.fn_id = e.fn_id AND f.n = e.dst_bb WHERE e.src_bb <> f.x)"""
SQL |= {
    "postdominates_by_paths": duck_sql(
        "SELECT a.fn_id, a.n AS pre_bb, b.n AS post_bb FROM way a JOIN way b ON a.fn_id = b.fn_id AND a.n <> b.n WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.fn_id = a.fn_id AND f.x = b.n AND f.n = a.n)", _AVOID
    ),
    "fuse_blocks": duck_sql(
        "SELECT fn_id, bb_id, min(h) AS into_bb FROM lines WHERE NOT EXISTS (SELECT 1 FROM step t WHERE t.fn_id = lines.fn_id AND t.b = lines.h) GROUP BY fn_id, bb_id",
        """live AS (SELECT DISTINCT fn_id, CAST(0 AS BIGINT) AS n FROM {bb} UNION SELECT l.fn_id, e.dst_bb FROM live l JOIN {bb_edge} e ON l.fn_id = e.fn_id AND l.n = e.src_bb),
arcs AS (SELECT DISTINCT e.fn_id, e.src_bb AS a, e.dst_bb AS b FROM {bb_edge} e JOIN live l ON e.fn_id = l.fn_id AND e.src_bb = l.n),
step AS (SELECT x.fn_id, x.a, x.b FROM arcs x WHERE x.b <> 0 AND (SELECT count(*) FROM arcs y WHERE y.fn_id = x.fn_id AND y.b = x.b) = 1 AND (SELECT count(*) FROM arcs y WHERE y.fn_id = x.fn_id AND y.a = x.a) = 1),
lines AS (SELECT fn_id, n AS bb_id, n AS h FROM live UNION SELECT l.fn_id, l.bb_id, t.a FROM lines l JOIN step t ON l.fn_id = t.fn_id AND l.h = t.b)""",
    ),
}
QUERIES = {k: globals()[k] for k in SQL}
