"""Fact tables of the program-analysis engine, derived from the driver's Parquet tables.

Each fact is one SQL statement over base tables and earlier facts, in the dialect that Spark SQL and DuckDB share; the same
text feeds the engine and the reference statements. Facts are lazy: a query pulls in only those that it names, and Catalyst
prunes their columns and pushes filters into the scans. The partition key of a program is fn_id.

A folder may hold any of them as a table instead (see frame()).

inst       instructions: events of one user are one function, four consecutive instructions are a basic block
bb_edge    control flow: fall through, a branch past the next block from every third, a loop back from every fifth
inst_edge  instruction order: inside a block, and from a block's last instruction to its successors' first
call_edge  call sites (errors) and callees; every fourth site has a second callee
obj_addr / obj_copy / obj_load / obj_store   inclusion constraints over parts (variables) and suppliers (objects)
obj_offset / obj_filter / obj_untag / obj_invoke   constraints that depend on an object: its field, its type, what a value of a
           type holds, the method that a call of an interface's method reaches; obj_field, obj_type and method_impl tell which
field_use  uses of struct fields, with or without a lock held
fn_name    names of functions
fn_mutex   the mutex that guards what a function uses, null where it is not known (names without the function's number)
sync_op    operations with the name of the function called
channel    channels and how many values they hold (-999: not known before the program runs)
chan_op    sends, receives and closes of channels
task_chan  channels that one question takes together: two that depend on each other; those of unknown buffer are left out
go_task    go statements that start a function with operations of a task
branch     blocks that end in a comparison of x with y, and where they go then
ctx_fn / ctx_node   functions, whether they are analysed apart for each call, and their nodes
ctx_copy   copies inside functions
obj_typedef / obj_part   types with what they are made of, and the parts of structs and tuples; a value of a type lies in consecutive nodes
cell_addr / cell_copy   nodes and the first nodes of what they point to, and copies between nodes
fix_inst / fix_edge   instructions by kind with what they call, up to a block's end, and the blocks that follow
chan_made / chan_site   where a channel is made, and its operations with the go statement that started their goroutine (null: the main one)
go_start / fn_sig   what go statements start, and the first result of functions
fn_parent / fn_text   functions nested in others, and names with those of the functions that they are nested in
go_target   functions that go statements start, and whether the statement names them, makes them or only the call graph knows
defer_closure   deferred instructions that run a closure
iface_method / iface_assert   methods of interfaces, and assertions (pos: the case of a switch) from one interface to another
http_stmt   statements of a block: what is called on what, with the variable that it is put in or called on
path_query   access paths to be asked about, with the first node and the type of their operand
value / operand   what instructions compute, and from what
go_line / fix   lines of source files, and what to do to them
src_line   lines of pages
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Functions of Go's synchronisation packages and the operation that each stands for.
SYNC_API = [
    ("(*sync.Mutex).Lock", "Mutex_Lock"),
    ("(*sync.Mutex).Unlock", "Mutex_Unlock"),
    ("(*sync.RWMutex).Lock", "RWMutex_Lock"),
    ("(*sync.RWMutex).Unlock", "RWMutex_Unlock"),
    ("(*sync.RWMutex).RLock", "RWMutex_RLock"),
    ("(*sync.RWMutex).RUnlock", "RWMutex_RUnlock"),
    ("(*sync.Cond).Wait", "Cond_Wait"),
    ("(*sync.Cond).Signal", "Cond_Signal"),
    ("(*sync.Cond).Broadcast", "Cond_Broadcast"),
    ("(*sync.WaitGroup).Add", "WaitGroup_Add"),
    ("(*sync.WaitGroup).Done", "WaitGroup_Done"),
    ("(*sync.WaitGroup).Wait", "WaitGroup_Wait"),
    ("(*sync.Once).Do", "Once_Do"),
    ("(*sync.Pool).Get", "Pool_Get"),
    ("(*sync.Pool).Put", "Pool_Put"),
    ("(*sync.Map).Load", "SyncMap_Load"),
    ("(*sync.Map).Store", "SyncMap_Store"),
    ("(*sync.Map).LoadOrStore", "SyncMap_LoadOrStore"),
    ("(*sync.Map).Delete", "SyncMap_Delete"),
    ("(*sync.Map).Range", "SyncMap_Range"),
    ("(*sync/atomic.Value).Load", "Atomic_Value_Load"),
    ("(*sync/atomic.Value).Store", "Atomic_Value_Store"),
    ("sync/atomic.AddInt32", "Atomic_Int_Add"),
    ("sync/atomic.LoadInt64", "Atomic_Int_Load"),
    ("sync/atomic.StoreUint32", "Atomic_Int_Store"),
    ("sync/atomic.SwapInt64", "Atomic_Int_Swap"),
    ("sync/atomic.CompareAndSwapInt32", "Atomic_Int_CAS"),
    ("sync/atomic.LoadPointer", "Atomic_Pointer_Load"),
    ("close", "Channel_Close"),
    ("(*testing.common).Fatal", "Test_Fatal"),
    ("(*testing.common).Skip", "Test_Skip"),
    ("fmt.Println", "other"),
    ("(*log.Logger).Print", "other"),
    ("invoke l.Lock", "Mutex_Lock"),
    ("invoke l.RLock", "RWMutex_RLock"),
]

# Types that arguments have: kind, bits, what a pointer points to, whether an interface, whether an error.
TYPES = [
    ("int", "integer", 64, "", 0, 0),
    ("uint8", "integer", 8, "", 0, 0),
    ("int32", "integer", 32, "", 0, 0),
    ("uint16", "integer", 16, "", 0, 0),
    ("uintptr", "integer", 64, "", 0, 0),
    ("string", "string", 128, "", 0, 0),
    ("error", "interface", 128, "", 1, 1),
    ("io.Reader", "interface", 128, "", 1, 0),
    ("MyErr", "struct", 64, "", 0, 1),
    ("reflect.Value", "struct", 192, "", 0, 0),
    ("config", "struct", 96, "", 0, 0),
    ("*MyErr", "pointer", 64, "MyErr", 0, 1),
    ("*string", "pointer", 64, "string", 0, 0),
    ("*error", "pointer", 64, "error", 0, 0),
    ("*io.Reader", "pointer", 64, "io.Reader", 0, 0),
    ("[]int", "slice", 192, "", 0, 0),
    ("map[string]int", "map", 64, "", 0, 0),
]
# Functions and conversions that the lint passes know.
CALLS = [
    "errors.As", "json.Unmarshal", "(*json.Decoder).Decode", "xml.Unmarshal", "sort.Slice", "sort.SliceStable", "reflect.DeepEqual", "unsafe.Pointer", "string",
    "<<", "==", "fmt.Printf", "atomic.AddInt64", "atomic.LoadUint64", "other",
]
# Methods whose signature is agreed on.
STD_METHODS = [
    ("Format", "(fmt.State, rune)"),
    ("GobDecode", "([]byte) error"),
    ("MarshalJSON", "() ([]byte, error)"),
    ("ReadByte", "() (byte, error)"),
    ("Scan", "(fmt.ScanState, rune) error"),
    ("Seek", "(int64, int) (int64, error)"),
    ("UnreadByte", "() error"),
    ("WriteByte", "(byte) error"),
]

# What a function's name may hold, in any case, for its unlocked uses of fields to be no faults.
SOLE_OWNER = ["init", "close", "start", "new", "lockfree", "shutdown"]
# Names that functions of the test data get in turn.
FN_NAMES = "Read InitStore handle run Update CloseAll scan Merge NewClient Flush apply startWorker visit Emit lockFreeGet Walk Sync drop Shutdown Load Push pop Commit rollback".split()


def _values(rows: list[tuple], names: str) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


FACTS: dict[str, str] = {
    "inst": """
SELECT inst_id, fn_id, idx, CAST(floor(idx / 4) AS BIGINT) AS bb_id, idx % 4 AS pos, op, prim, file,
       CASE WHEN inst_id % 3 = 0 THEN NULL ELSE idx * 2 + 1 END AS line, inst_id % 11 = 0 AS is_defer
FROM (SELECT event_id AS inst_id, user_id AS fn_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
             CASE event_type WHEN 'signup' THEN 'Lock' WHEN 'purchase' THEN 'Unlock' WHEN 'click' THEN 'Send' WHEN 'view' THEN 'Recv' ELSE 'Call' END AS op,
             event_id % 5 AS prim, concat('f', CAST(user_id % 10 AS STRING), '.go') AS file
      FROM {events})""",
    "bb": "SELECT fn_id, bb_id, count(*) AS n_inst, max(max(bb_id)) OVER (PARTITION BY fn_id) AS last_bb FROM {inst} GROUP BY fn_id, bb_id",
    "bb_edge": """
SELECT fn_id, bb_id AS src_bb, bb_id + 1 AS dst_bb FROM {bb} WHERE bb_id + 1 <= last_bb
UNION ALL SELECT fn_id, bb_id, bb_id + 2 FROM {bb} WHERE bb_id % 3 = 0 AND bb_id + 2 <= last_bb
UNION ALL SELECT fn_id, bb_id, bb_id - 2 FROM {bb} WHERE bb_id % 5 = 4""",
    "bb_ends": "SELECT fn_id, bb_id, min(idx) AS first_idx, max(idx) AS last_idx, max_by(inst_id, idx) AS last_inst, min_by(inst_id, idx) AS first_inst FROM {inst} GROUP BY fn_id, bb_id",
    "inst_edge": """
SELECT a.fn_id, a.inst_id AS src, b.inst_id AS dst FROM {inst} a JOIN {inst} b ON a.fn_id = b.fn_id AND a.bb_id = b.bb_id AND b.idx = a.idx + 1
UNION ALL
SELECT e.fn_id, s.last_inst, d.first_inst FROM {bb_edge} e JOIN {bb_ends} s ON e.fn_id = s.fn_id AND e.src_bb = s.bb_id
JOIN {bb_ends} d ON e.fn_id = d.fn_id AND e.dst_bb = d.bb_id""",
    "n_fn": "SELECT count(DISTINCT user_id) AS n FROM {events}",
    "call_edge": """
SELECT e.user_id AS caller, e.event_id AS site, (e.user_id * 7 + 3) % n.n AS callee, CASE e.event_id % 7 WHEN 0 THEN 'Go' WHEN 1 THEN 'Defer' ELSE 'Call' END AS site_kind
FROM {events} e CROSS JOIN {n_fn} n WHERE e.event_type = 'error'
UNION ALL
SELECT e.user_id, e.event_id, (e.user_id * 5 + 11) % n.n, CASE e.event_id % 7 WHEN 0 THEN 'Go' WHEN 1 THEN 'Defer' ELSE 'Call' END
FROM {events} e CROSS JOIN {n_fn} n WHERE e.event_type = 'error' AND e.event_id % 4 = 0 AND (e.user_id * 5 + 11) % n.n <> (e.user_id * 7 + 3) % n.n""",
    "fn_edge": "SELECT DISTINCT caller, callee FROM {call_edge}",
    "obj_addr": "SELECT DISTINCT l_partkey AS node, l_suppkey AS label FROM {lineitem} WHERE l_linenumber = 1",
    "obj_pair": """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey
WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey""",
    "obj_copy": "SELECT src, dst FROM {obj_pair} WHERE src % 4 = 0",
    "obj_load": "SELECT src, dst FROM {obj_pair} WHERE src % 32 = 1",
    "obj_store": "SELECT src, dst FROM {obj_pair} WHERE src % 32 = 2",
    "obj_offset": "SELECT src, src % 2 AS off, dst FROM {obj_pair} WHERE src % 32 IN (3, 6)",
    "obj_filter": "SELECT src, dst % 25 AS type_id, dst FROM {obj_pair} WHERE src % 32 = 5",
    "obj_untag": "SELECT src, dst % 25 AS type_id, dst FROM {obj_pair} WHERE src % 32 = 9",
    "obj_invoke": "SELECT dst AS caller, concat(CAST(src AS STRING), ':', CAST(dst AS STRING)) AS site, src AS recv, dst % 4 AS method, dst AS arg FROM {obj_pair} WHERE src % 8 = 7",
    "obj_type": "SELECT s_suppkey AS label, s_nationkey AS type_id FROM {supplier}",
    "obj_field": "SELECT s_suppkey AS label, CAST(s_nationkey % 2 AS BIGINT) AS off, s_suppkey + 1000000000000 AS sub FROM {supplier}",
    "method_impl": """
SELECT type_id, method, type_id * 4 + method AS fn_id, 2000000000000 + type_id * 8 + method * 2 AS recv_node, 2000000000001 + type_id * 8 + method * 2 AS param_node
FROM (SELECT CAST(n.n_nationkey AS BIGINT) AS type_id, CAST(m.nr AS BIGINT) AS method FROM {nation} n CROSS JOIN (VALUES (0), (1), (2), (3)) AS m(nr)) WHERE (type_id + method) % 3 <> 0""",
    "field_use": """
SELECT p.p_brand AS struct_name, concat('f', CAST(l.l_linenumber AS STRING)) AS field, l.l_orderkey * 8 + l.l_linenumber AS inst_id, l.l_discount > 0.02 AS locked,
       concat('s', CAST(l.l_suppkey % 50 AS STRING), '.go') AS file, l.l_orderkey % 400 AS line, l.l_suppkey AS fn_id
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "sync_api": _values(SYNC_API, "callee, op"),
    "sync_name": _values([(i, c) for i, (c, _) in enumerate(SYNC_API)], "nr, callee"),
    "sync_op": f"SELECT i.inst_id, i.fn_id, i.idx, i.bb_id, i.is_defer, n.callee, i.inst_id * 3 % 41 AS value_id FROM {{inst}} i JOIN {{sync_name}} n ON i.inst_id % {len(SYNC_API)} = n.nr",
    "channel": "SELECT DISTINCT event_id % 46 AS ch_id, CASE WHEN event_id % 46 % 7 = 6 THEN -999 ELSE event_id % 46 % 3 END AS buffer FROM {events}",
    "chan_op": "SELECT inst_id, fn_id, inst_id % 46 AS ch_id, CASE op WHEN 'Unlock' THEN 'Close' ELSE op END AS op FROM {inst} WHERE op IN ('Send', 'Recv') OR (op = 'Unlock' AND inst_id % 5 = 0)",
    "task_chan": "SELECT CAST(floor(ch_id / 2) AS BIGINT) AS task, ch_id FROM {channel} WHERE buffer <> -999",
    "go_task": "SELECT DISTINCT e.caller AS root, e.site, t.task, e.callee AS fn_id FROM {call_edge} e JOIN {chan_op} c ON e.callee = c.fn_id JOIN {task_chan} t ON c.ch_id = t.ch_id WHERE e.site_kind = 'Go' AND e.caller <> e.callee",
    "src_line": "SELECT doc_id AS file_id, line_no, text FROM {doc_line}",
}
# Facts that only a few queries use.
FACTS |= {
    "one_pred": "SELECT fn_id, dst_bb, min(src_bb) AS src_bb FROM {bb_edge} GROUP BY fn_id, dst_bb HAVING count(*) = 1",
    "if_cond": "SELECT e.fn_id, e.bb_id, i.prim AS cond FROM {bb_ends} e JOIN {inst} i ON e.last_inst = i.inst_id JOIN (SELECT fn_id, src_bb FROM {bb_edge} GROUP BY fn_id, src_bb HAVING count(*) > 1) t ON e.fn_id = t.fn_id AND e.bb_id = t.src_bb",
    "branch": """SELECT e.fn_id, e.bb_id, e.bb_id + 1 AS true_bb, e.bb_id + 2 AS false_bb, concat('v', CAST(e.last_inst % 3 AS STRING)) AS x,
CASE e.last_inst % 5 WHEN 0 THEN '<' WHEN 1 THEN '<=' WHEN 2 THEN '>' WHEN 3 THEN '>=' ELSE '==' END AS op, CAST(e.last_inst % 4 AS STRING) AS y
FROM {bb_ends} e JOIN {bb} b ON e.fn_id = b.fn_id AND e.bb_id = b.bb_id WHERE e.bb_id % 3 = 0 AND e.bb_id + 2 <= b.last_bb""",
    "ctx_fn": "SELECT DISTINCT f.fn_id, n.n_fn, f.fn_id % 3 = 0 AS apart FROM (SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS fn_id FROM {part}) f CROSS JOIN (SELECT count(DISTINCT CAST(floor(p_partkey / 16) AS BIGINT)) AS n_fn FROM {part}) n",
    "ctx_copy": "SELECT DISTINCT src, CAST(floor(src / 16) AS BIGINT) * 16 + dst % 16 AS dst FROM {obj_pair} WHERE src % 16 <> dst % 16 AND src % 3 = 0",
    "ctx_node": "SELECT f.fn_id * 16 + k.nr AS node, f.fn_id, f.apart FROM {ctx_fn} f CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) AS k(nr)",
    "value": """SELECT inst_id AS value_id, fn_id, idx, kind, concat('t', CAST(inst_id % 3 AS STRING)) AS type, CASE kind WHEN 'Const' THEN CAST(inst_id % 4 AS STRING) WHEN 'Global' THEN concat('G', CAST(inst_id % 5 AS STRING)) WHEN 'UnOp' THEN '*'
WHEN 'FieldAddr' THEN concat('f', CAST(inst_id % 2 AS STRING)) WHEN 'Call' THEN concat('g', CAST(inst_id % 2 AS STRING)) WHEN 'BinOp' THEN CASE inst_id % 7 WHEN 0 THEN '==' WHEN 1 THEN '!=' WHEN 2 THEN '<' WHEN 3 THEN '>' WHEN 4 THEN '<=' WHEN 5 THEN '>=' ELSE '+' END
ELSE concat('v', CAST(inst_id AS STRING)) END AS text
FROM (SELECT inst_id, fn_id, idx, CASE WHEN idx = 0 THEN 'Alloc' ELSE CASE inst_id % 8 WHEN 0 THEN 'Const' WHEN 1 THEN 'Alloc' WHEN 2 THEN 'BinOp' WHEN 3 THEN 'Call' WHEN 4 THEN 'UnOp' WHEN 5 THEN 'FieldAddr' WHEN 6 THEN 'Global' ELSE 'Phi' END END AS kind FROM {inst})""",
    "operand": """SELECT v.value_id, 0 AS pos, a.value_id AS arg_id FROM {value} v JOIN {value} a ON v.fn_id = a.fn_id AND a.idx = CAST(floor(v.idx / 2) AS BIGINT) WHERE v.kind IN ('BinOp', 'Call', 'UnOp', 'FieldAddr', 'Phi')
UNION ALL SELECT v.value_id, 1, a.value_id FROM {value} v JOIN {value} a ON v.fn_id = a.fn_id AND a.idx = CAST(floor(v.idx / 3) AS BIGINT) WHERE v.kind IN ('BinOp', 'Phi')""",
    "go_line": """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS file, p_partkey % 20 + 1 AS line, p_partkey % 8 AS form, CASE p_partkey % 8 WHEN 0 THEN concat(name, ' := make(chan struct{{}})') WHEN 1 THEN concat(name, ' := make(chan int, 3)')
WHEN 2 THEN concat('use(', name, ', make(chan []string), "make(x)")') WHEN 3 THEN concat('// make(chan int) for ', name) WHEN 4 THEN concat(name, ' <- struct{{}}{{}}') WHEN 5 THEN concat('<-', name) WHEN 6 THEN 'return' ELSE 'go func() {{ use(make(chan map[string](chan int))) }}()' END AS text
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM {part})""",
    "fix": """SELECT l.file, l.file % 3 + 1 AS strategy, m.make_line, l.line AS op_line FROM {go_line} l JOIN (SELECT file, min(line) AS make_line FROM {go_line} WHERE form IN (0, 1) GROUP BY file) m ON l.file = m.file
WHERE (l.file % 3 = 0 AND l.form IN (0, 1, 2, 3, 7)) OR (l.file % 3 > 0 AND l.form = 4)""",
    "pts_text": "SELECT node, JOINED[label|,|label] AS labels FROM {obj_addr} GROUP BY node HAVING count(*) > 1",
    "chan_use": "SELECT inst_id, fn_id, op, CAST(floor(inst_id / 8) AS BIGINT) AS prim FROM {inst}",
    "struct_sync": "SELECT DISTINCT p_brand AS struct_name FROM {part} WHERE p_type LIKE 'PROMO%' AND p_size > 45",
    "field_ratio": "SELECT struct_name, field, count(*) AS n_uses, CAST(sum(CASE WHEN locked THEN 1 ELSE 0 END) AS BIGINT) AS n_locked FROM {field_use} GROUP BY struct_name, field",
    "fn_words": _values(list(enumerate(FN_NAMES)), "nr, word"),
    "fn_name": f"SELECT f.fn_id, concat(w.word, CAST(f.fn_id AS STRING)) AS name FROM (SELECT DISTINCT user_id AS fn_id FROM {{events}}) f JOIN {{fn_words}} w ON f.fn_id % {len(FN_NAMES)} = w.nr",
    "fn_mutex": "SELECT fn_id, CASE WHEN name LIKE concat('%', CAST(fn_id AS STRING)) THEN fn_id % 5 END AS prim FROM {fn_name}",
    "lock_next": "SELECT a.inst_id AS lock1, b.inst_id AS lock2 FROM {inst} a JOIN {inst} b ON a.fn_id = b.fn_id AND a.prim = b.prim AND b.idx > a.idx WHERE a.op = 'Lock' AND b.op = 'Lock'",
    "bb_text": "SELECT fn_id, bb_id, JOINED[op|,|idx] AS ops FROM {inst} GROUP BY fn_id, bb_id",
    "held_text": "SELECT fn_id, JOINED[prim|,|prim] AS prims FROM (SELECT DISTINCT fn_id, prim FROM {inst} WHERE op = 'Lock') GROUP BY fn_id",
    "method_set": "SELECT DISTINCT fn_id, inst_id % 13 AS prim FROM {inst} WHERE op = 'Call'",
    "method_need": "SELECT DISTINCT fn_id, inst_id % 13 AS prim FROM {inst} WHERE op = 'Call' AND is_defer",
    "bench_line": "SELECT concat('Benchmark', replace(p_name, ' ', '_'), ' ', CAST(p_size * 1000 AS STRING), ' ', CAST(p_partkey % 700 + 10 AS STRING), ' ns/op', CASE WHEN p_partkey % 3 = 0 THEN ' 12 B/op' ELSE '' END) AS line, p_partkey AS ord FROM {part}",
    "bench_run": "SELECT p_name AS name, p_partkey AS ord, p_partkey % 700 + 10 AS ns FROM {part}",
    "bench_nth": "SELECT p_name AS name, p_partkey % 2 AS half, p_partkey % 700 AS ns, CAST(row_number() OVER (PARTITION BY p_name, p_partkey % 2 ORDER BY p_partkey) AS BIGINT) AS nth FROM {part}",
}
# Facts of nested types: 64 types in a row are a group of their own, and are made of smaller ones of it.
FACTS |= {
    "obj_typedef": """SELECT type_id, CASE k WHEN 0 THEN 'basic' WHEN 1 THEN 'basic' WHEN 2 THEN 'iface' WHEN 3 THEN 'func' ELSE CASE k % 7 WHEN 0 THEN 'struct' WHEN 1 THEN 'pointer' WHEN 2 THEN 'array' WHEN 3 THEN 'slice' WHEN 4 THEN 'map' WHEN 5 THEN 'chan' ELSE 'tuple' END END AS kind,
CASE WHEN k > 3 AND k % 7 IN (1, 2, 3, 4, 5) THEN type_id - k + CAST(floor(k / 2) AS BIGINT) END AS elem, CASE WHEN k > 3 AND k % 7 = 4 THEN type_id - k + CAST(floor(k / 3) AS BIGINT) END AS key
FROM (SELECT p_partkey + 64 AS type_id, p_partkey % 64 AS k FROM {part})""",
    "obj_part": """SELECT t.type_id, CAST(n.nr AS BIGINT) AS pos, n.name, t.type_id - t.type_id % 64 + CAST(floor(t.type_id % 64 / n.step) AS BIGINT) AS part_type
FROM {obj_typedef} t JOIN (VALUES (0, 'a', 2), (1, 'b', 3), (2, 'xs', 5)) AS n(nr, name, step) ON t.kind IN ('struct', 'tuple') AND (t.kind = 'struct' OR n.nr < t.type_id % 3 + 1)""",
    "cell_addr": """SELECT (p_partkey + 64) * 64 + n.nr AS node, (p_partkey + 64 - p_partkey % 64 + (p_partkey * 3 + n.nr * 5) % 64) * 64 AS label
FROM {part} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS n(nr) WHERE (p_partkey + n.nr) % 3 > 0""",
    "cell_copy": "SELECT type_id * 64 AS src, (type_id - type_id % 64 + (type_id * 7 + 1) % 64) * 64 AS dst FROM {obj_typedef} WHERE type_id % 4 = 0",
    "path_query": """SELECT type_id AS query_id, type_id * 64 AS node, type_id, CASE type_id % 17 WHEN 0 THEN 'x' WHEN 1 THEN '*x' WHEN 2 THEN 'x.a' WHEN 3 THEN '(*x).b' WHEN 4 THEN 'x[1]' WHEN 5 THEN '<-x' WHEN 6 THEN 'x.a.xs' WHEN 7 THEN '*x.b' WHEN 8 THEN 'x[0].a'
WHEN 9 THEN '<-x[0]' WHEN 10 THEN '(x)["k"]' WHEN 11 THEN 'x.xs[2]' WHEN 12 THEN 'y.a' WHEN 13 THEN 'x.' WHEN 14 THEN '(<-x).a' WHEN 15 THEN 'x + 1' ELSE '(*x)[0]' END AS query FROM {obj_typedef}""",
}
# Facts of repairs. Blocks 4, 10, 16 and so on of a function return.
FACTS |= {
    "fix_edge": "SELECT fn_id, src_bb, dst_bb FROM {bb_edge} WHERE src_bb % 6 <> 4",
    "fix_inst": """SELECT fn_id, bb_id, idx * 4 AS idx, inst_id, line, kind, CASE kind WHEN 'Call' THEN CASE inst_id % 5 WHEN 0 THEN 'close' WHEN 1 THEN 'fmt.Println' WHEN 2 THEN 'time.Sleep' WHEN 3 THEN CASE WHEN inst_id % 4 = 0 THEN '(*log.Logger).Log' ELSE 'use' END
ELSE CASE WHEN inst_id % 3 = 0 THEN '(*testing.common).Fatal' ELSE 'run' END END WHEN 'Defer' THEN CASE WHEN inst_id % 9 = 0 THEN '(*os.File).Close' ELSE 'done' END END AS callee
FROM (SELECT *, CASE op WHEN 'Call' THEN CASE inst_id % 7 WHEN 0 THEN 'Go' WHEN 1 THEN 'Defer' ELSE 'Call' END ELSE CASE WHEN op = 'Recv' AND inst_id % 9 = 0 THEN 'Select' WHEN op IN ('Send', 'Recv') AND inst_id % 3 = 0 THEN op ELSE 'UnOp' END END AS kind FROM {inst})
UNION ALL SELECT b.fn_id, b.bb_id, b.last_idx * 4 + 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CASE WHEN e.n IS NULL THEN 'RunDefers' WHEN e.n = 1 THEN 'Jump' ELSE 'If' END, NULL FROM {bb_ends} b LEFT JOIN (SELECT fn_id, src_bb, count(*) AS n FROM {fix_edge} GROUP BY fn_id, src_bb) e ON b.fn_id = e.fn_id AND b.bb_id = e.src_bb
UNION ALL SELECT b.fn_id, b.bb_id, b.last_idx * 4 + 2, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'Return', NULL FROM {bb_ends} b LEFT JOIN {fix_edge} e ON b.fn_id = e.fn_id AND b.bb_id = e.src_bb WHERE e.src_bb IS NULL""",
    "chan_made": "SELECT i.ch_id, i.fn_id, i.bb_id, i.idx * 2 + 1 AS line FROM (SELECT CAST(floor(inst_id / 8) AS BIGINT) AS ch_id, fn_id, bb_id, idx, row_number() OVER (PARTITION BY CAST(floor(inst_id / 8) AS BIGINT) ORDER BY inst_id) AS nth FROM {inst}) i WHERE nth = 1",
    "chan_site": """SELECT CAST(floor(i.inst_id / 8) AS BIGINT) AS ch_id, i.inst_id, i.fn_id, i.bb_id, i.idx, i.line, CASE i.kind WHEN 'Send' THEN 'send' WHEN 'Call' THEN 'close' ELSE 'recv' END AS dir, i.kind = 'Select' AS is_select,
CASE WHEN i.inst_id % 4 > 0 THEN g.site END AS thread, i.inst_id % 6 = 0 AS by_line FROM {fix_inst} i LEFT JOIN (SELECT callee, min(site) AS site FROM {call_edge} WHERE site_kind = 'Go' GROUP BY callee) g ON i.fn_id = g.callee
WHERE i.kind IN ('Send', 'Recv', 'Select') OR (i.kind = 'Call' AND i.callee = 'close')""",
    "go_start": "SELECT e.site, i.fn_id, i.bb_id, e.callee, e.site % 3 <> 1 AS is_static FROM {call_edge} e JOIN {inst} i ON e.site = i.inst_id WHERE e.site_kind = 'Go'",
    "fn_sig": "SELECT fn_id, name, CASE WHEN name LIKE 'New%' THEN concat('p.', substr(name, 4)) WHEN fn_id % 9 = 0 THEN '<-chan int' WHEN fn_id % 9 = 1 THEN 'p.Client' ELSE '' END AS result FROM {fn_name}",
}
# Facts of nested functions.
FACTS |= {
    "fn_parent": "SELECT c.fn_id, p.fn_id AS parent_fn FROM (SELECT DISTINCT user_id AS fn_id FROM {events}) c JOIN (SELECT DISTINCT user_id AS fn_id FROM {events}) p ON p.fn_id = c.fn_id - 1 WHERE c.fn_id % 3 > 0",
    "fn_text": "SELECT f.fn_id, f.name, CASE WHEN n.name IS NULL THEN f.name ELSE concat(n.name, '$1') END AS text FROM {fn_name} f LEFT JOIN {fn_parent} p ON f.fn_id = p.fn_id LEFT JOIN {fn_name} n ON p.parent_fn = n.fn_id",
    "go_target": """SELECT site, caller AS fn_id, callee AS target, CASE site % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'closure' ELSE 'dynamic' END AS how FROM {call_edge} WHERE site_kind = 'Go'
UNION ALL SELECT e.site, e.caller, p.fn_id, 'dynamic' FROM {call_edge} e JOIN {fn_parent} p ON e.caller = p.parent_fn WHERE e.site_kind = 'Go'""",
    "defer_closure": "SELECT i.inst_id AS site, c.callee AS closure_fn FROM {inst} i JOIN {call_edge} c ON i.inst_id = c.site WHERE i.is_defer",
}
# Facts of the lint passes.
FACTS |= {
    "iface_method": """SELECT p_partkey AS type_id, n.name, CASE WHEN (p_size + n.nr) % 4 = 0 THEN '()' ELSE '([]byte) (int, error)' END AS signature
FROM {part} JOIN (VALUES (0, 'Read'), (1, 'Write'), (2, 'Close'), (3, 'Len')) AS n(nr, name) ON (p_partkey + n.nr) % 3 > 0""",
    "iface_assert": "SELECT l_orderkey * 8 + l_linenumber AS site, CAST(k.nr AS BIGINT) AS pos, l_partkey AS v_type, l_suppkey + k.nr AS t_type FROM {lineitem} JOIN (VALUES (0), (1)) AS k(nr) ON k.nr = 0 OR l_linenumber % 3 = 0",
    "http_stmt": """SELECT inst_id AS stmt_id, fn_id, bb_id, pos, CASE inst_id % 4 WHEN 0 THEN 'assign' WHEN 3 THEN 'other' ELSE 'defer' END AS kind,
CASE inst_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN '*net/http.Client' WHEN 2 THEN 'net/http.Client' WHEN 3 THEN '*net/http.Server' ELSE 'other' END AS called_on,
CASE WHEN inst_id % 7 = 0 THEN '(*net/http.Response)' ELSE '(*net/http.Response, error)' END AS results, CASE WHEN inst_id % 6 > 0 THEN concat('r', CAST(inst_id % 3 AS STRING)) END AS root FROM {inst}""",
    "go_type": _values([(i, *t) for i, t in enumerate(TYPES)], "nr, type, kind, bits, pointee, is_iface, is_error"),
    "go_call": _values(list(enumerate(CALLS)), "nr, callee"),
    "std_method": _values([(i, *m) for i, m in enumerate(STD_METHODS)], "nr, name, signature"),
    "call_arg": f"""
SELECT e.event_id AS site, e.user_id AS fn_id, c.callee, a.type AS type1, b.type AS type2, floor(e.event_id / 3) % 80 AS const, e.event_id % 4 AS n_args,
       CASE floor(e.event_id / 5) % 4 WHEN 0 THEN 'no verb, 100%%' WHEN 1 THEN '%d and %s' WHEN 2 THEN '%v%%' ELSE '%s %d %v' END AS format
FROM {{events}} e JOIN {{go_call}} c ON e.event_id % {len(CALLS)} = c.nr JOIN {{go_type}} a ON floor(e.event_id / 7) % {len(TYPES)} = a.nr JOIN {{go_type}} b ON floor(e.event_id / 11) % {len(TYPES)} = b.nr""",
    "struct_layout": "SELECT p_brand AS struct_name, p_partkey AS field, CASE WHEN p_size % 3 = 0 THEN 8 WHEN p_size % 3 = 1 THEN 4 ELSE 1 END AS size FROM {part}",
    "method_decl": f"""SELECT p.p_partkey AS fn_id, m.name, CASE WHEN p.p_size % 4 = 0 THEN '() error' ELSE m.signature END AS signature, p.p_type LIKE 'PROMO%' AS is_test_file,
concat(CASE p.p_size % 3 WHEN 0 THEN 'Test' WHEN 1 THEN 'Benchmark' ELSE 'Test' END, CASE WHEN p.p_size % 5 = 0 THEN lower(split_part(p.p_name, ' ', 2)) ELSE upper(split_part(p.p_name, ' ', 2)) END) AS test_name,
CASE WHEN p.p_size % 7 = 0 THEN '(int)' WHEN p.p_size % 3 = 1 THEN '(*testing.B)' ELSE '(*testing.T)' END AS test_params
FROM {{part}} p JOIN {{std_method}} m ON p.p_partkey % {len(STD_METHODS)} = m.nr""",
    "struct_tag": "SELECT p_partkey AS field, p_brand AS struct_name, CASE p_size % 5 WHEN 0 THEN concat('json:', p_name) WHEN 1 THEN concat('json:\"', split_part(p_name, ' ', 2), '\"') WHEN 2 THEN concat('json:\"', split_part(p_name, ' ', 1), '\" xml:\"x\"') WHEN 3 THEN concat('json :\"a\"') ELSE '' END AS tag FROM {part}",
}
# Row-expanding facts differ between the dialects only in how an array is unnested.
SPLIT = {
    "doc_line": (
        "SELECT doc_id, CAST(p AS BIGINT) AS line_no, text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (p, text) FROM {documents})",
        "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents",
    ),
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_JOIN = re.compile(r"JOINED\[(.*?)\|(.*?)\|(.*?)\]")


def brought(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether the folder has the fact as a table of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def frame(spark: SparkSession, sf_dir: str, name: str, seen: dict | None = None) -> DataFrame:
    """A base table or fact as a DataFrame; seen keeps those already made for the same query.

    A fact that lies in the folder as a table of its own (inst.parquet, bb_edge.parquet, call_edge.parquet and so on, with the
    fact's columns) is read instead of derived: that is how a program's own facts are analysed.
    """
    seen = {} if seen is None else seen
    if name not in seen:
        if name not in BASE and brought(spark, sf_dir, name):
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return seen[name]
        seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in BASE else run_sql(spark, sf_dir, SPLIT[name][0] if name in SPLIT else FACTS[name], seen)
    return seen[name]


def run_sql(spark: SparkSession, sf_dir: str, text: str, seen: dict | None = None, **own: DataFrame) -> DataFrame:
    """A statement of the shared dialect, with {name} for base tables, facts and the frames given by name."""
    text = _JOIN.sub(r"listagg(CAST(\1 AS STRING), '\2') WITHIN GROUP (ORDER BY \3)", text)
    seen = {} if seen is None else seen
    return spark.sql(text, **{n: own[n] if n in own else frame(spark, sf_dir, n, seen) for n in dict.fromkeys(_NAME.findall(text))})


def _order(names: list[str], out: list[str]) -> list[str]:
    for n in names:
        if n not in BASE and n not in out and (n in FACTS or n in SPLIT):
            _order(_NAME.findall(SPLIT[n][0] if n in SPLIT else FACTS[n]), out)
            out.append(n)
    return out


def duck_sql(text: str, ctes: str = "") -> str:
    """The same statement for DuckDB: facts become common table expressions; ctes are further ones, before the statement."""
    names = _order(list(dict.fromkeys(_NAME.findall(ctes + " " + text))), [])
    facts = [f"{n} AS ({SPLIT[n][1] if n in SPLIT else FACTS[n]})" for n in names] + ([ctes] if ctes else [])
    whole = (f"WITH RECURSIVE {', '.join(facts)} " if facts else "") + text
    whole = _JOIN.sub(r"string_agg(CAST(\1 AS VARCHAR), '\2' ORDER BY \3)", whole)
    return _NAME.sub(r"\1", whole).replace("{{", "{").replace("}}", "}").replace(" AS STRING)", " AS VARCHAR)")
