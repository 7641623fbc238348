"""Blocked states of channel operations: paths of goroutines, their combinations, and which of them an execution can end in.

A task is a set of channels that are looked at together; a root is the function in which its goroutines begin: the function
itself and those that it starts. A path of a function is, for a task, the word of its steps (sends, receives and closes of the
task's channels, and go statements) along one way from entry to exit; a way follows at most UNROLL edges back. Words of equal
steps are one row, so paths differ only in what the question sees.

A goroutine's option is a word, run to its end or blocked at one send or receive; what comes before is executed. Goroutines are
folded in one by one, one option for each, and each fold drops what cannot be: a goroutine that no executed go statement
started does nothing, and two blocked operations that could meet are not both blocked. Counts of the executed operations of a
channel must then allow the blocked ones to block, and the executed ones must have an order: a cut of the words (a position in
each) is left for another by an operation that may run there, and the cut at all ends must be reached. There are no more cuts
than the product of the words' lengths. How the solver of a checker states this is not published; this is our own definition.

Cost: one shuffle for all functions' words, one join a goroutine. Options are as many as a function's distinct executed
prefixes, and combinations of a root their product: bounded by a program's functions, not by how many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice, product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import brought, duck_sql, frame, run_sql
from .fixpoint import keep, per_function

#: Edges back (to the same or an earlier place) that a way follows at most.
UNROLL = 1

# Tasks of a function: those of its own operations and those of the functions that it starts.
_TASKS = """
SELECT DISTINCT c.fn_id, t.task FROM {chan_op} c JOIN {task_chan} t ON c.ch_id = t.ch_id UNION SELECT DISTINCT root, task FROM {go_task}"""
# Goroutines of a root: itself (k = 0), then the functions that it starts and that have operations of the task, by number. A
# function that starts none is a root of its own if no go statement starts it.
_MEMBERS = """
SELECT root, task, CAST(row_number() OVER (PARTITION BY root, task ORDER BY fn_id) AS BIGINT) AS k, fn_id FROM (SELECT DISTINCT root, task, fn_id FROM {go_task})
UNION ALL SELECT DISTINCT root, task, 0, root FROM {go_task}
UNION ALL SELECT DISTINCT c.fn_id, t.task, 0, c.fn_id FROM {chan_op} c JOIN {task_chan} t ON c.ch_id = t.ch_id LEFT JOIN (SELECT caller AS go_fn FROM {call_edge} WHERE site_kind = 'Go' UNION SELECT callee FROM {call_edge} WHERE site_kind = 'Go') g ON c.fn_id = g.go_fn WHERE g.go_fn IS NULL"""


def words_of(steps: dict, succ: dict, order: dict, first, unroll: int = UNROLL, ends: dict | None = None) -> set[tuple]:
    """Words along the ways from first to an end: steps of a node in turn, a function's first start only; a way takes at most
    unroll edges back. A node may stand for several in a row: ends then has the place of the last one."""
    ends = order if ends is None else ends
    grown = lambda w, more: w + tuple(x for x in more if x[0] != "G" or x not in w)
    here: list[dict] = [{} for _ in range(unroll + 1)]
    here[0][first] = {grown((), steps.get(first, ()))}
    out = set()
    for back, level_words in enumerate(here):
        for n in sorted(succ, key=order.get):
            words = level_words.get(n)
            if not words:
                continue
            if not succ[n]:
                out |= words
            for m in succ[n]:
                level = back + (order[m] <= ends[n])
                if level <= unroll:
                    here[level].setdefault(m, set()).update({grown(w, steps[m]) for w in words} if m in steps else words)
    return out


def runs_of(succ: dict, order: dict, first) -> dict:
    """Nodes in a row, by the first of each row: what follows has one way in, is the one way on and stands later."""
    into: dict = {}
    for ms in succ.values():
        for m in ms:
            into[m] = into.get(m, 0) + 1
    joined = {ms[0]: n for n, ms in succ.items() if len(ms) == 1 and ms[0] != first and into[ms[0]] == 1 and order[ms[0]] > order[n]}
    out = {}
    for n in succ:
        if n not in joined:
            row = [n]
            while len(succ[row[-1]]) == 1 and joined.get(succ[row[-1]][0]) == row[-1]:
                row.append(succ[row[-1]][0])
            out[n] = row
    return out


def _facts(spark: SparkSession, sf_dir: str, seen: dict) -> tuple[DataFrame, DataFrame]:
    """Operations (fn_id, about, task, step), and go statements (root, site, fn_id, tasks) that start a function with operations of tasks.

    Instructions, tasks and go statements are written once, for all statements that take their facts from seen. A function's tasks are
    put together before they meet the statements that start it, so that its operations are not repeated for each of these.
    """
    if not brought(spark, sf_dir, "inst"):
        seen["inst"] = keep(frame(spark, sf_dir, "inst", seen).select("inst_id", "fn_id", "idx", "bb_id", "op"))
    seen["task_chan"] = keep(frame(spark, sf_dir, "task_chan", seen))
    ops = run_sql(spark, sf_dir, "SELECT c.fn_id, c.inst_id AS about, t.task, concat(substring(c.op, 1, 1), CAST(c.ch_id AS STRING), '@', CAST(c.inst_id AS STRING)) AS step FROM {chan_op} c JOIN {task_chan} t ON c.ch_id = t.ch_id", seen)
    if brought(spark, sf_dir, "go_task"):
        goes = frame(spark, sf_dir, "go_task", seen).groupBy("root", "site", "fn_id").agg(F.collect_set("task").alias("tasks"))
    else:
        tasks = ops.groupBy(F.col("fn_id").alias("t_fn")).agg(F.collect_set("task").alias("tasks"))
        sites = run_sql(spark, sf_dir, "SELECT DISTINCT caller AS root, site, callee AS fn_id FROM {call_edge} WHERE site_kind = 'Go' AND caller <> callee", seen)
        goes = sites.join(tasks, F.col("fn_id") == F.col("t_fn")).drop("t_fn")
    goes = keep(goes)
    seen["go_task"] = goes.select("root", "site", F.explode("tasks").alias("task"), "fn_id")
    return ops, goes


def _words(spark: SparkSession, sf_dir: str, seen: dict) -> DataFrame:
    """(fn_id, task, words): the words of each function's ways from entry to exit, for each task that it takes part in."""
    ops, goes = _facts(spark, sf_dir, seen)
    nodes = frame(spark, sf_dir, "inst", seen).select("fn_id", F.col("inst_id").alias("id"), "idx", "bb_id")
    edges = frame(spark, sf_dir, "bb_edge", seen).select("fn_id", F.col("src_bb").alias("src"), F.col("dst_bb").alias("dst"))
    said = ops.select("fn_id", "about", F.concat_ws(":", F.col("task").cast("string"), "step").alias("text"))
    starts = F.concat(F.array_join(F.col("tasks").cast("array<string>"), " "), F.lit(":G"), F.col("fn_id").cast("string"))
    said = said.unionByName(goes.select(F.col("root").alias("fn_id"), F.col("site").alias("about"), starts.alias("text")))

    def solve(g, succ, said):
        steps: dict = {}
        for n, text in said:
            tasks, _, name = text.partition(":")
            steps.setdefault(n, []).extend((name, int(task)) for task in tasks.split())
        ids = g["id"].tolist()
        order = dict(zip(ids, g["idx"].tolist(), strict=True))
        first = min(ids, key=order.get)
        rows = runs_of(succ, order, first)
        short = {n: succ[row[-1]] for n, row in rows.items()}
        ends = {n: order[row[-1]] for n, row in rows.items()}
        own: dict = {task: {} for at in steps.values() for _, task in at}
        for n, row in rows.items():
            for name, task in (x for m in row if m in steps for x in sorted(steps[m])):
                names = own[task].setdefault(n, [])
                if name[0] != "G" or name not in names:
                    names.append(name)
        return [(task, [" ".join(w) for w in words]) for task in own if (words := words_of({n: tuple(x) for n, x in own[task].items()}, short, order, first, ends=ends))]

    return per_function(nodes, edges, solve, "fn_id long, task long, words array<string>", said)


def sync_paths(spark: SparkSession, sf_dir: str, seen: dict | None = None) -> DataFrame:
    """(fn_id, task, word): the words of each function's ways from entry to exit, for each task that it takes part in.

    A word is text: steps with a space between. S, R and C send to, receive from and close a channel (number@instruction), G starts
    a function with operations of the task (the first time). A function without a way to an exit has no words.
    """
    return _words(spark, sf_dir, {} if seen is None else seen).select("fn_id", "task", F.explode("words").alias("word"))


def _steps(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def mark_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fn_id, task, word, block_pos, n_executed): the steps of a word before a blocked one are executed; -2 is the exit, with all."""
    return _options(keep(sync_paths(spark, sf_dir))).select("fn_id", "task", "word", "block_pos", F.col("n_executed").cast("long").alias("n_executed"))


def _options(words: DataFrame) -> DataFrame:
    """fn_id, task, word, block_pos, n_executed, executed (text), blocked (a step, '' at the exit), of every place of a word."""
    rows = words.withColumn("steps", _steps(F.col("word")))
    at = F.transform("steps", lambda x, i: F.when(x.startswith("S") | x.startswith("R"), i.cast("long")))
    rows = rows.withColumn("block_pos", F.explode(F.concat(F.array(F.lit(-2).cast("long")), F.filter(at, lambda i: i.isNotNull()))))
    n = F.when(F.col("block_pos") < 0, F.size("steps")).otherwise(F.col("block_pos"))
    rows = rows.withColumn("n_executed", n.cast("int"))
    blocked = F.when(F.col("block_pos") < 0, "").otherwise(F.get("steps", F.col("block_pos").cast("int")))
    return rows.withColumn("executed", F.array_join(F.slice("steps", 1, F.col("n_executed")), " ")).withColumn("blocked", blocked).drop("steps")


def _folded(spark: SparkSession, sf_dir: str, seen: dict, options: DataFrame, ends: Column | None = None, tallied: Callable = lambda rows: rows) -> DataFrame:
    """(root, task, executed, blocked): one option (fn_id, task, executed, blocked) for each goroutine of a root, as arrays by k.

    A goroutine that is not started has no steps; one that is started and has no word (no way to an exit) leaves no combination.
    Blocked operations that could meet drop the combination. tallied gives options their tally, which is added up. ends: what is asked
    of whole combinations, before they are kept. What a fold compares is taken from an option's text once, not in every combination.
    """
    members = keep(run_sql(spark, sf_dir, _MEMBERS, seen))
    started = members.where("k > 0").select("root", "task", "k", F.col("fn_id").alias("m_fn"))
    goes, meet = F.filter(_steps(F.col("executed")), lambda x: x.startswith("G")), F.split_part(F.col("blocked"), F.lit("@"), F.lit(1))
    whole = keep(tallied(options.select(F.col("fn_id").alias("o_fn"), F.col("task").alias("o_task"), "executed", "blocked").distinct()).withColumns({"goes": goes, "meet": meet, "against": F.translate(meet, "SR", "RS")}))
    tally = ["tally"] if "tally" in whole.columns else []
    silent = F.array_join(F.filter(_steps(F.col("executed")), lambda x: ~x.startswith("G")), " ")  # what started functions start is not followed
    other = keep(whole.select("o_fn", "o_task", silent.alias("o_executed"), F.col("blocked").alias("o_blocked"), F.col("meet").alias("o_meet"), F.col("against").alias("o_against"), *(F.col(c).alias(f"o_{c}") for c in tally)).distinct())
    most = members.agg(F.max("k")).first()[0] or 0
    sizes = members.groupBy(F.col("root").alias("s_root"), F.col("task").alias("s_task")).agg(F.max("k").alias("last"))
    heads = members.where("k = 0").join(sizes, (F.col("root") == F.col("s_root")) & (F.col("task") == F.col("s_task")))
    lists = ("executed", "blocked", "against")
    now = heads.join(whole, (F.col("fn_id") == F.col("o_fn")) & (F.col("task") == F.col("o_task"))).select("root", "task", "last", "goes", *(F.array(c).alias(c) for c in lists), *tally)
    ask = lambda rows, k: rows if ends is None else rows.where((F.col("last") > k) | ends)
    done = ask(now.where("last = 0"), 0)
    summed = F.zip_with("tally", "o_tally", lambda x, y: F.struct(x["cap"].alias("cap"), *((x[c] + y[c]).alias(c) for c in ("rest", "shut", "sends", "recvs")))).alias("tally")
    for k in range(1, most + 1):
        here = started.where(F.col("k") == k).select(F.col("root").alias("m_root"), F.col("task").alias("m_task"), "m_fn")
        joined = now.where(F.col("last") >= k).join(here, (F.col("root") == F.col("m_root")) & (F.col("task") == F.col("m_task")))
        runs = F.array_contains("goes", F.concat(F.lit("G"), F.col("m_fn").cast("string")))
        idle = joined.where(~runs).select("root", "task", "last", "goes", *(F.array_append(c, F.lit("")).alias(c) for c in lists), *tally)
        pairs = joined.where(runs).join(other, (F.col("m_fn") == F.col("o_fn")) & (F.col("task") == F.col("o_task")))
        pairs = pairs.where((F.col("o_meet") == "") | ~F.array_contains("against", F.col("o_meet")))
        pairs = pairs.select("root", "task", "last", "goes", *(F.array_append(c, F.col(f"o_{c}")).alias(c) for c in lists), *([summed] if tally else []))
        now = keep(ask(idle.unionByName(pairs), k))
        done = done.unionByName(now.where(F.col("last") == k))
    return done.select("root", "task", "executed", "blocked")


def _paths_of(parts: list[dict]) -> Iterator[str]:
    """One word for each goroutine of a root, in all combinations; parts are its goroutines by k, with their words (null: none)."""
    started = [(f"G{p['fn_id']}", sorted({" ".join(x for x in w.split() if x[0] != "G") for w in p["words"] or ()})) for p in parts if p["k"] > 0]
    for head in (w for p in parts if p["k"] == 0 for w in p["words"] or ()):
        goes = set(head.split())
        yield from map(" | ".join, product([head], *(words if g in goes else [""] for g, words in started)))


def path_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, task, paths): one whole word for each goroutine, in all combinations.

    The words of a root's goroutines come together once, as lists; combinations are written as they are made and not shuffled.
    """
    seen: dict = {}
    words = keep(_words(spark, sf_dir, seen)).withColumnsRenamed({"fn_id": "w_fn", "task": "w_task"})
    members = run_sql(spark, sf_dir, _MEMBERS, seen)
    parts = members.join(words, (F.col("fn_id") == F.col("w_fn")) & (F.col("task") == F.col("w_task")), "left")
    parts = parts.groupBy("root", "task").agg(F.sort_array(F.collect_list(F.struct("k", "fn_id", "words"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((r, t, p) for r, t, of in zip(*map(batch.column, ("root", "task", "parts")), strict=True) for p in _paths_of(of.as_py()))
            found = ((r.as_py(), t.as_py(), p) for r, t, p in found)
            while rows := list(islice(found, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["root", "task", "paths"])

    return parts.mapInArrow(run, "root long, task long, paths string")


def _blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: dict = {}
    return _folded(spark, sf_dir, seen, _options(keep(sync_paths(spark, sf_dir, seen))), F.exists("blocked", lambda b: b != ""))


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("root", "task", F.array_join("executed", " | ").alias("executed"), F.array_join(F.filter("blocked", lambda b: b != ""), " ").alias("blocked"), *more)


def blocking_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, task, executed, blocked): what each goroutine has executed, and the operations that are blocked (one at least)."""
    return _texts(_blocking(spark, sf_dir))


def _buffers(spark: SparkSession, sf_dir: str, seen: dict) -> DataFrame:
    """(b_task, buffers): the channels of a task (ch, cap), in order."""
    buffers = run_sql(spark, sf_dir, "SELECT t.task AS b_task, t.ch_id, c.buffer FROM {task_chan} t JOIN {channel} c ON t.ch_id = c.ch_id", seen)
    return buffers.groupBy("b_task").agg(F.sort_array(F.collect_set(F.struct(F.col("ch_id").cast("string").alias("ch"), F.col("buffer").cast("int").alias("cap")))).alias("buffers"))


def _counted(spark: SparkSession, sf_dir: str, seen: dict, buffers: DataFrame) -> DataFrame:
    """The blocking combinations whose executed operations leave each channel so that the blocked ones block.

    Each option has its tally, channel by channel; folds add tallies up, and whole combinations are judged by them before they are kept.
    """
    is_op = lambda x, op, ch: F.split_part(x, F.lit("@"), F.lit(1)) == F.concat(F.lit(op), ch)
    has = lambda op, ch: F.size(F.filter("steps", lambda x: is_op(x, op, ch)))

    def tally(b: Column) -> Column:
        at = (is_op(F.col("blocked"), op, b["ch"]).cast("int") for op in "SR")
        return F.struct(b["cap"].alias("cap"), (has("S", b["ch"]) - has("R", b["ch"])).alias("rest"), has("C", b["ch"]).alias("shut"), *(x.alias(c) for x, c in zip(at, ("sends", "recvs"), strict=True)))

    def legal(x: Column) -> Column:
        fits = (x["shut"] <= 1) & (x["rest"] <= x["cap"]) & ((x["shut"] > 0) | (x["rest"] >= 0))
        return fits & ((x["sends"] == 0) | ((x["shut"] == 0) & (x["rest"] == x["cap"]))) & ((x["recvs"] == 0) | ((x["shut"] == 0) & (x["rest"] == 0)))

    def tallied(rows: DataFrame) -> DataFrame:
        steps = rows.withColumn("steps", _steps(F.col("executed"))).join(buffers, F.col("o_task") == F.col("b_task"))
        return steps.withColumn("tally", F.transform("buffers", tally)).drop("steps", "b_task", "buffers")

    return _folded(spark, sf_dir, seen, _options(keep(sync_paths(spark, sf_dir, seen))), F.exists("blocked", lambda b: b != "") & F.forall("tally", legal), tallied)


def sync_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, task, executed, blocked): the blocking combinations whose channels' counts allow them."""
    seen: dict = {}
    return _texts(_counted(spark, sf_dir, seen, keep(_buffers(spark, sf_dir, seen))))


@lru_cache(maxsize=1 << 16)
def has_order(words: tuple[tuple[str, ...], ...], buffers: tuple[tuple[str, int], ...]) -> bool:
    """Whether all steps (S, R and C with a channel, G with a goroutine's number) can run, each word in its order.

    The first word runs from the start, the others once started. A send needs a free place, or a receive of another goroutine
    on a channel without buffer; a receive needs a value or a closed channel; sending to or closing a closed channel is a panic.
    """
    cap = dict(buffers)
    goal, start = tuple(map(len, words)), (0,) * len(words)

    def moves(cut):
        ran = [s for w, n in zip(words, cut, strict=True) for s in w[:n]]
        live = [g == 0 or f"G{g}" in words[0][: cut[0]] for g in range(len(words))]
        heads = [w[n] if up and n < len(w) else "" for w, n, up in zip(words, cut, live, strict=True)]
        starts = [g for g, head in enumerate(heads) if head[:1] == "G"]
        if starts:  # always possible, and takes no other move away
            yield (starts[0],)
            return
        for g, head in enumerate(heads):
            if not head:
                continue
            op, ch = head[0], head[1:]
            level, shut = ran.count("S" + ch) - ran.count("R" + ch), "C" + ch in ran
            if op == "G" or (op == "C" and not shut) or (op == "R" and (level > 0 or shut)) or (op == "S" and not shut and level < cap[ch]):
                yield (g,)
            elif op == "S" and not shut and cap[ch] == 0:
                yield from ((g, other) for other, head2 in enumerate(heads) if other != g and head2 == "R" + ch)

    seen, todo = {start}, [start]
    while todo:
        cut = todo.pop()
        if cut == goal:
            return True
        for move in moves(cut):
            then = tuple(n + (g in move) for g, n in enumerate(cut))
            if then not in seen:
                seen.add(then)
                todo.append(then)
    return False


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combinations that pass the counts, with feasible: whether what is executed has an order."""
    seen: dict = {}
    buffers = keep(_buffers(spark, sf_dir, seen))
    rows = _counted(spark, sf_dir, seen, buffers).join(buffers, F.col("task") == F.col("b_task"))
    members = run_sql(spark, sf_dir, _MEMBERS, seen).groupBy(F.col("root").alias("m_root"), F.col("task").alias("m_task")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "fn_id"))), lambda x: x["fn_id"]).alias("fns"))
    rows = rows.join(members, (F.col("root") == F.col("m_root")) & (F.col("task") == F.col("m_task"))).drop("m_root", "m_task")

    @F.pandas_udf("boolean")
    def feasible(executed: pd.Series, fns: pd.Series, buffers: pd.Series) -> pd.Series:
        out = []
        for words, numbers, caps in zip(executed, fns, buffers, strict=True):
            number = {f"G{int(fn)}": f"G{k}" for k, fn in enumerate(numbers) if k}
            # Channels by their place in the task: tasks of equal buffers ask the same.
            place = {c["ch"]: str(i) for i, c in enumerate(caps)}
            shape = tuple(tuple(number.get(s, "G") if s[0] == "G" else s[0] + place.get(s[1:].split("@")[0], s[1:]) for s in w.split()) for w in words)
            out.append(has_order(shape, tuple((str(i), int(c["cap"])) for i, c in enumerate(caps))))
        return pd.Series(out, dtype=bool)

    return rows.withColumn("feasible", feasible("executed", "fns", "buffers"))


def sat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, task, executed, blocked, feasible): whether the executed operations of a combination that passes the counts have an order."""
    return _texts(_ordered(spark, sf_dir), "feasible")


def bmoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, task, blocked, n_combinations, witness): sets of operations that some execution leaves blocked for ever.

    blocked lists the instructions by number; witness is the smallest text of what the goroutines have executed then. A set
    of places is reported once for a root and task.
    """
    stuck = _ordered(spark, sf_dir).where("feasible")
    insts = F.transform(F.filter("blocked", lambda b: b != ""), lambda b: F.split_part(b, F.lit("@"), F.lit(2)).cast("long"))
    rows = stuck.select("root", "task", F.array_join(F.transform(F.sort_array(insts), lambda x: x.cast("string")), ",").alias("blocked"), F.array_join("executed", " | ").alias("executed"))
    return rows.groupBy("root", "task", "blocked").agg(F.count(F.lit(1)).alias("n_combinations"), F.min("executed").alias("witness"))


# Statements for DuckDB: ways as rows (instruction, edges back, word), options by position, goroutines folded in by recursion.
_STEP = """inst_step AS (SELECT f.fn_id, f.task, i.inst_id, i.idx, (SELECT coalesce(list(step ORDER BY step), []) FROM (
  SELECT concat(substr(c.op, 1, 1), c.ch_id, '@', c.inst_id) AS step FROM {chan_op} c JOIN {task_chan} t ON c.ch_id = t.ch_id WHERE c.inst_id = i.inst_id AND t.task = f.task
  UNION ALL SELECT concat('G', g.fn_id) FROM {go_task} g WHERE g.site = i.inst_id AND g.task = f.task)) AS steps
FROM (""" + _TASKS + """) f JOIN {inst} i ON f.fn_id = i.fn_id),
way AS (SELECT fn_id, task, inst_id AS at, idx, 0 AS back, steps AS word FROM inst_step WHERE idx = 0
UNION SELECT w.fn_id, w.task, s.inst_id, s.idx, w.back + CASE WHEN s.idx <= w.idx THEN 1 ELSE 0 END, list_concat(w.word, list_filter(s.steps, lambda x: x[1] <> 'G' OR NOT list_contains(w.word, x)))
FROM way w JOIN {inst_edge} e ON w.at = e.src JOIN inst_step s ON s.inst_id = e.dst AND s.task = w.task WHERE w.back + CASE WHEN s.idx <= w.idx THEN 1 ELSE 0 END <= 1),
sync_path AS (SELECT DISTINCT fn_id, task, array_to_string(word, ' ') AS word FROM way WHERE way.at NOT IN (SELECT src FROM {inst_edge}))"""
_MEMBER = "member AS (" + _MEMBERS + ")"
_OPTION = """place AS (SELECT fn_id, task, word, CASE WHEN word = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(word, ' ') END AS steps FROM sync_path),
option_at AS (SELECT fn_id, task, word, CAST(-2 AS BIGINT) AS block_pos, CAST(len(steps) AS BIGINT) AS n_executed, word AS executed, '' AS blocked FROM place
UNION ALL SELECT fn_id, task, word, p, p, array_to_string(steps[1:p], ' '), steps[p + 1] FROM place, unnest(range(0, len(steps))) AS r(p) WHERE substr(steps[p + 1], 1, 1) IN ('S', 'R')),
choice AS (SELECT DISTINCT fn_id, task, executed, blocked FROM option_at)"""
_FOLD = """fold AS (SELECT m.root, m.task, m.k, list_value(o.executed) AS executed, list_value(o.blocked) AS blocked FROM member m JOIN choice o ON m.fn_id = o.fn_id AND m.task = o.task WHERE m.k = 0
UNION ALL SELECT f.root, f.task, m.k, list_append(f.executed, o.executed), list_append(f.blocked, o.blocked)
FROM fold f JOIN member m ON f.root = m.root AND f.task = m.task AND m.k = f.k + 1
JOIN (SELECT DISTINCT fn_id, task, array_to_string(list_filter(string_split(executed, ' '), lambda x: NOT starts_with(x, 'G')), ' ') AS executed, blocked, true AS runs FROM choice UNION ALL SELECT DISTINCT fn_id, task, '', '', false FROM member WHERE k > 0) o ON o.fn_id = m.fn_id AND o.task = m.task AND o.runs = list_contains(string_split(f.executed[1], ' '), concat('G', m.fn_id))
WHERE o.blocked = '' OR len(list_filter(f.blocked, lambda b: b <> '' AND substr(split_part(b, '@', 1), 2) = substr(split_part(o.blocked, '@', 1), 2) AND substr(b, 1, 1) <> substr(o.blocked, 1, 1))) = 0),
folded AS (SELECT f.* FROM fold f JOIN (SELECT root, task, max(k) AS last FROM member GROUP BY root, task) s ON f.root = s.root AND f.task = s.task AND f.k = s.last)"""
_BLOCKING = ", ".join((_STEP, _MEMBER, _OPTION, _FOLD)) + """, blocking AS (SELECT root, task, array_to_string(executed, ' | ') AS executed, array_to_string(list_filter(blocked, lambda b: b <> ''), ' ') AS blocked FROM folded WHERE len(list_filter(blocked, lambda b: b <> '')) > 0)"""
SQL = {
    "sync_paths": duck_sql("SELECT fn_id, task, word FROM sync_path", _STEP),
    "mark_executed": duck_sql("SELECT fn_id, task, word, block_pos, n_executed FROM option_at", _STEP + ", " + _OPTION),
    "path_combinations": duck_sql("SELECT root, task, array_to_string(executed, ' | ') AS paths FROM folded", ", ".join((_STEP, _MEMBER, "choice AS (SELECT fn_id, task, word AS executed, '' AS blocked FROM sync_path)", _FOLD))),
    "blocking_combinations": duck_sql("SELECT * FROM blocking", _BLOCKING),
    "sync_rule": duck_sql(
        """SELECT root, task, executed, blocked FROM (SELECT b.root, b.task, b.executed, b.blocked, b.nr,
  len(list_filter(string_split(b.executed, ' '), lambda x: split_part(x, '@', 1) = concat('S', t.ch_id))) - len(list_filter(string_split(b.executed, ' '), lambda x: split_part(x, '@', 1) = concat('R', t.ch_id))) AS rest,
  len(list_filter(string_split(b.executed, ' '), lambda x: split_part(x, '@', 1) = concat('C', t.ch_id))) AS shut,
  len(list_filter(string_split(b.blocked, ' '), lambda x: split_part(x, '@', 1) = concat('S', t.ch_id))) AS bs, len(list_filter(string_split(b.blocked, ' '), lambda x: split_part(x, '@', 1) = concat('R', t.ch_id))) AS br, c.buffer AS cap
FROM (SELECT *, row_number() OVER () AS nr FROM blocking) b JOIN {task_chan} t ON b.task = t.task JOIN {channel} c ON t.ch_id = c.ch_id)
GROUP BY nr, root, task, executed, blocked HAVING bool_and(shut <= 1 AND rest <= cap AND (shut > 0 OR rest >= 0) AND (bs = 0 OR (shut = 0 AND rest = cap)) AND (br = 0 OR (shut = 0 AND rest = 0)))""",
        _BLOCKING,
    ),
}
QUERIES = {k: globals()[k] for k in (*SQL, "sat_check", "bmoc")}
