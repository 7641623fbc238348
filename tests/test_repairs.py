"""Repairs of blocked goroutines on small programs: one that each repair fits, and variants that break one condition."""

from __future__ import annotations

import pandas as pd

from factweave.operators import repairs

MAIN = None


class Program:
    """Facts by hand: functions are lists of blocks, a block is a list of kind, callee and line."""

    def __init__(self):
        self.inst, self.edge, self.made, self.site, self.go, self.sig, self.n = [], [], [], [], [], [], 0

    def function(self, fn: int, blocks: list[list[tuple]], edges: list[tuple] = (), name: str = "f", result: str = "") -> list[list[int]]:
        ids = []
        for bb, insts in enumerate(blocks):
            ids.append([])
            for k, (kind, callee, line) in enumerate(insts):
                self.n += 1
                ids[-1].append(self.n)
                self.inst.append((fn, bb, bb * 100 + k, self.n, line, kind, callee))
        self.edge += list(edges)
        self.sig.append((fn, name, result))
        return ids

    def use(self, ch: int, inst: int, thread: int | None, by_line: bool = False) -> None:
        fn, bb, idx, _, line, kind, _ = self.inst[inst - 1]
        self.site.append((ch, inst, fn, bb, idx, line, {"Send": "send", "Call": "close"}.get(kind, "recv"), kind == "Select", thread, by_line))

    def write(self, folder) -> str:
        tables = {
            "fix_inst": (self.inst, "fn_id bb_id idx inst_id line kind callee"),
            "fix_edge": (self.edge or [(0, 0, 0)], "fn_id src_bb dst_bb"),
            "chan_made": (self.made, "ch_id fn_id bb_id line"),
            "chan_site": (self.site, "ch_id inst_id fn_id bb_id idx line dir is_select thread by_line"),
            "go_start": (self.go, "site fn_id bb_id callee is_static"),
            "fn_sig": (self.sig, "fn_id name result"),
        }
        for name, (rows, columns) in tables.items():
            df = pd.DataFrame(rows, columns=columns.split())
            df.astype({c: "Int64" for c in df.columns if c in ("thread", "line", "make_line")}).to_parquet(folder / f"{name}.parquet")
        return str(folder)


def _buffer(p: Program, fn: int, body: list[tuple] = (("Call", "time.Sleep", 11), ("Send", None, 12), ("Return", None, None)), made: tuple = (0, 9), go_bb: int = 0, edges: list[tuple] = (), thread: bool = True, by_line: bool = False, **sig: str) -> int:
    """fn makes channel fn and starts fn + 1, which runs body; the first send is asked about. Returns its id."""
    blocks = [[("MakeChan", None, 9), ("If", None, None)], [("Jump", None, None)], [("Return", None, None)]]
    blocks[go_bb].insert(0, ("Go", None, 10))
    ids = p.function(fn, blocks, edges, **sig)
    go = ids[go_bb][0]
    p.go.append((go, fn, go_bb, fn + 1, True))
    p.made.append((fn, fn, *made))
    inner = p.function(fn + 1, [list(body)])
    sent = [i for i, (kind, *_) in zip(inner[0], body, strict=True) if kind == "Send"]
    for i in sent:
        p.use(fn, i, go if thread else MAIN, by_line)
    return sent[0]


def test_a_place_in_the_buffer(spark, tmp_path):
    p, want = Program(), {}
    ends = ("Return", None, None)
    sends = ("Send", None, 12)
    want[_buffer(p, 10)] = (1, None, None)
    want[_buffer(p, 12, [sends, ("UnOp", None, 13), ("Call", "close", 13), ("RunDefers", None, None), ends])] = (1, None, None)
    want[_buffer(p, 14, [sends, ("Call", "use", 13), ends])] = (1, None, None)  # not the last, but nothing with effects follows
    want[_buffer(p, 16, [sends, ("Call", "(*log.Logger).Log", 13), ends])] = (0, None, None)
    want[_buffer(p, 18, [("Defer", "(*os.File).Close", 11), sends, ("RunDefers", None, None), ends])] = (0, None, None)
    want[_buffer(p, 20, thread=False)] = (0, None, None)  # on the main goroutine
    want[_buffer(p, 22, thread=False, by_line=True)] = (1, None, None)
    want[_buffer(p, 24, go_bb=1, edges=[(24, 0, 1), (24, 1, 1), (24, 1, 2)])] = (3, 10, "12,12")  # started in a loop
    want[_buffer(p, 26, go_bb=1, made=(1, 9), edges=[(26, 0, 1), (26, 1, 1), (26, 1, 2)])] = (1, None, None)  # made there too
    want[_buffer(p, 28, go_bb=1, edges=[(28, 0, 1), (28, 1, 1), (28, 1, 2)], name="recv", result="<-chan int")] = (0, None, None)
    want[_buffer(p, 30, go_bb=1, edges=[(30, 0, 1), (30, 1, 1), (30, 1, 2)], by_line=True, name="NewQueue", result="*pkg.Queue")] = (0, None, None)
    two = _buffer(p, 32, [sends, ("Send", None, 13), ends])  # two sends of one goroutine, both last
    want[two] = want[two + 1] = (1, None, None)
    two = _buffer(p, 34, [sends, ("Call", "use", 13), ("Send", None, 14), ends])  # the first is followed by a channel operation
    want[two] = (3, 10, "12,12,14")
    want[two + 2] = (3, 10, "14,12,14")
    first = _buffer(p, 36)  # another goroutine sends too
    other = p.function(100, [[sends, ends]])[0][0]
    p.go.append((900, 36, 0, 100, True))
    p.use(36, other, 900)
    want[first], want[other] = (3, 10, "12,12,12"), (3, 10, "12,12,12")
    got = {r.inst_id: (r.strategy, r.make_line, r.lines) for r in repairs.repair_plan(spark, p.write(tmp_path)).collect()}
    assert got == want


def test_deferred_sends_and_stop_channels(spark, tmp_path):
    p, want = Program(), {}
    ends, send, recv = ("Return", None, None), ("Send", None, 18), ("Recv", None, 12)

    def leaves(fn: int, inner: list[tuple], outer_send: list[tuple] = (send, ends), close_thread=MAIN) -> None:
        ids = p.function(fn, [[("MakeChan", None, 9), ("Go", None, 10), ("If", None, None)], [("Call", "println", 15), ends], list(outer_send)], [(fn, 0, 1), (fn, 0, 2)])
        p.go.append((ids[0][1], fn, 0, fn + 1, True))
        p.made.append((fn, fn, 0, 9))
        for i, (kind, callee, _) in zip(ids[2], outer_send, strict=True):
            if kind == "Send" or callee == "close":
                p.use(fn, i, close_thread if callee == "close" else MAIN)
                if kind == "Send":
                    want[i] = (0, None, None)
        for i, (kind, *_) in zip(p.function(fn + 1, [inner])[0], inner, strict=True):
            if kind in ("Recv", "Select"):
                p.use(fn, i, ids[0][1])
                want[i] = None
        fns[fn] = max(n for n, w in want.items() if w is None)

    fns: dict = {}
    leaves(10, [("Call", "time.Sleep", 11), recv, ends])
    leaves(12, [recv, ("Call", "use", 13), ends])  # not the last
    leaves(14, [("Select", None, 12), ("Call", "use", 13), ends])
    leaves(16, [recv, ends], [send, ("Call", "use", 19), ends])  # the send is not the last
    leaves(18, [recv, ends], [("Call", "close", 18), ends])
    leaves(20, [recv, ends], [("Call", "close", 18), ends], close_thread=900)
    leaves(22, [recv, ("UnOp", None, 13), ("Call", "close", 13), ("RunDefers", None, None), ends])
    fits = {10: "18", 14: "18", 18: "18", 22: "18"}
    for fn, inst in fns.items():
        want[inst] = (2, 10, fits[fn]) if fn in fits else (0, None, None)
    # for { sleep; send } in a goroutine
    ids = p.function(40, [[("MakeChan", None, 9), ("Go", None, 10), ends]])
    p.go.append((ids[0][1], 40, 0, 41, False))
    p.made.append((40, 40, 0, 9))
    inner = p.function(41, [[("Jump", None, None)], [("Call", "time.Sleep", 12), ("Call", "println", 13), ("Send", None, 14), ("Jump", None, None)], [("BinOp", None, 11), ("If", None, None)], [ends]], [(41, 0, 2), (41, 1, 2), (41, 2, 1), (41, 2, 3)])
    p.use(40, inner[1][2], ids[0][1])
    want[inner[1][2]] = (3, 10, "14,14")
    folder = p.write(tmp_path)
    got = {r.inst_id: (r.strategy, r.make_line, r.lines) for r in repairs.repair_plan(spark, folder).collect()}
    assert got == want
    exits = {tuple(r) for r in repairs.skippable_exits(spark, folder).collect()}
    assert exits == {(fn, fn, 1) for fn in (10, 12, 14, 16, 18, 20, 22)}
