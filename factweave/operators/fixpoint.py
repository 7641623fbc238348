"""Recursion on DataFrames: semi-naive loops for whole-program relations, sorted batches for per-function graphs.

Loops keep each round in the session's checkpoint folder (spark.checkpoint.dir), which all executors share, so that lost
executors cost nothing and lineage stays short. Graphs that decompose by function take one shuffle in all.
"""

from __future__ import annotations

import tempfile
import weakref
from collections.abc import Callable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """df as Parquet in the session's checkpoint folder. Only a session on one machine may have none set: it gets a temporary one.

    Files and not checkpoint(): what is read back has the size of its files. A checkpoint bears its plan's estimate, a product over
    all joins before it, which a loop's joins multiply again each round until the number alone fills the driver.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factweave-ckpt-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/kept-{uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Kept relations that no relation still to be computed reads: their files go when the frame is let go of, and with the
    driver's next collection, which is asked for here, the files of the shuffles that made them."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        weakref.finalize(df, at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete, at, True).atexit = False
    df.sparkSession._jvm.System.gc()


def semi_naive(base: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int | None = None, max_rounds: int = 1000, compact: int = 8, stride: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Least set that holds base and is closed under step; step sees only the rows that the last round added.

    known is a closed set to begin with: base then has none of its rows.

    Set semantics, so cycles end. depth bounds the recursion where the operator itself does; a set that is still growing
    after max_rounds is an error. A round takes `stride` steps at once, unless steps are counted, and writes only what it
    adds; `compact` rounds at a time are put together.
    """
    names = base.columns
    delta = keep(base.distinct())
    parts = [delta] if known is None else [known, delta]
    for _ in range(max_rounds if depth is None else depth):
        total = reduce(DataFrame.unionByName, parts)
        before = total.select(*(F.col(c).alias(f"t_{c}") for c in names)).hint("merge")
        new = far = step(delta).select(*names).distinct()
        for _ in range(stride - 1 if depth is None else 0):
            far = step(far).select(*names).distinct()
            new = new.unionByName(far)
        new = new.distinct() if new is not far else new
        delta = keep(new.join(before, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in names], "left_anti"))
        if delta.isEmpty():
            return total
        parts = [*parts, delta] if len(parts) < compact else [keep(total), delta]
    if depth is None:
        raise RuntimeError(f"the relation still grows after {max_rounds} rounds")
    return reduce(DataFrame.unionByName, parts)


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node): nodes reachable from each root; start has (root, node), edges (src, dst)."""
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")).distinct()
    e = keep(e).hint("merge")  # a broadcast of all edges or of all that is known would pass through the driver in every round
    return semi_naive(start.select("root", "node"), lambda d: d.join(e, d["node"] == F.col("e_src")).select("root", F.col("e_dst").alias("node")))


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def per_function(nodes: DataFrame, edges: DataFrame, solve: Callable[..., list[tuple]], schema: str, said: DataFrame | None = None) -> DataFrame:
    """solve(columns of one function's nodes, sorted by id, successors by id) for each fn_id; solve returns rows after fn_id.

    nodes has fn_id, id and attributes; edges has fn_id, src, dst: between nodes, or, where nodes have bb_id and idx, between
    blocks (an instruction is followed by the next one of its block, a block's last one by the first of each successor).
    said (fn_id, about, text) is given to solve too, as a list of (about, text).
    One shuffle: nodes, edges and what is said travel as one relation by fn_id. A task goes through its functions one by one, so it needs
    memory for one batch and one function.
    """
    kinds = dict(part.split() for part in schema.split(", "))
    both = nodes.withColumns({"e_src": F.lit(None).cast("long"), "e_dst": F.lit(None).cast("long")})
    both = both.unionByName(edges.select("fn_id", F.col("src").alias("e_src"), F.col("dst").alias("e_dst")), allowMissingColumns=True)
    if said is not None:
        both = both.unionByName(said.select("fn_id", "about", "text"), allowMissingColumns=True)
    of_blocks, telling, attributes = "bb_id" in nodes.columns, said is not None, [c for c in nodes.columns if c != "fn_id"]

    def one(fn: int, t: pa.Table) -> list[tuple]:
        is_edge = t["e_src"].is_valid()
        more, is_node = (), pc.invert(is_edge)
        if telling:
            is_said = t["text"].is_valid()
            told, is_node = t.filter(is_said), pc.and_not(is_node, is_said)
            more = (list(zip(told["about"].to_pylist(), told["text"].to_pylist(), strict=True)),)
        own, arcs = t.filter(is_node).select(attributes), t.filter(is_edge)
        if own.num_rows == 0:
            return []
        own = own.sort_by("id")
        g = {c: own[c].to_numpy() for c in attributes}
        pairs = set(zip(arcs["e_src"].to_pylist(), arcs["e_dst"].to_pylist(), strict=True))
        succ: dict = {i: set() for i in g["id"].tolist()}
        if of_blocks:
            order = g["idx"].argsort(kind="stable")
            first, last = {}, {}
            for i, b in zip(g["id"][order].tolist(), g["bb_id"][order].tolist(), strict=True):
                first.setdefault(b, i)
                if b in last:
                    succ[last[b]].add(i)
                last[b] = i
            pairs = {(last[a], first[b]) for a, b in pairs if a in last and b in first}
        for a, b in pairs:
            succ.setdefault(a, set()).add(b)
        return [(fn, *r) for r in solve(g, {a: sorted(bs) for a, bs in succ.items()}, *more)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), ARROW[k]) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            fn = t["fn_id"].to_numpy()
            cut = [0, *(np.flatnonzero(fn[1:] != fn[:-1]) + 1).tolist()]
            yield out([r for a, b in zip(cut, cut[1:], strict=False) for r in one(int(fn[a]), t.slice(a, b - a))])
            held = t.slice(cut[-1]) if len(fn) else held
        if held is not None and held.num_rows:
            yield out(one(held["fn_id"][0].as_py(), held))

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.where("fn_id is not null").repartition(tasks, "fn_id").sortWithinPartitions("fn_id").mapInArrow(run, schema)


def walk(succ: dict, start: list, stop: Callable = lambda n: False) -> set:
    """Nodes reached from start's members (themselves included); nothing is followed beyond a node that stops."""
    seen, todo = set(start), list(start)
    while todo:
        n = todo.pop()
        if stop(n):
            continue
        for m in succ.get(n, ()):
            if m not in seen:
                seen.add(m)
                todo.append(m)
    return seen


def after(succ: dict, start, stop: Callable = lambda n: False) -> set:
    """Nodes reached by one step or more."""
    return walk(succ, list(succ.get(start, ())), stop)


def flipped(succ: dict) -> dict:
    out: dict = {n: [] for n in succ}
    for n, ms in succ.items():
        for m in ms:
            out.setdefault(m, []).append(n)
    return out
