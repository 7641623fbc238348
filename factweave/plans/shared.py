"""Queries that one statement of the shared dialect states for both engines: Catalyst plans it here, DuckDB checks it.

Each entry is (survey id, statement). Names in braces are facts or base tables of factweave.sources.facts.
Fixed values in the statements: names of Go's functions, kinds of select cases and condition operations, prefixes of reports.
"""

from __future__ import annotations

SHARED: dict[str, tuple[str, str]] = {
    # --- sources, text and sinks -------------------------------------------------------------------------------------
    "count_lines_matching": ("S4", "SELECT file_id, count(*) AS n_lines FROM {src_line} WHERE text LIKE '%token%' OR text LIKE '%the %' GROUP BY file_id"),
    "read_source_line": (
        "S10",
        """SELECT d.doc_id AS file_id, 2 AS line_no, CASE WHEN l.text IS NULL THEN 'file has too few lines' ELSE l.text END AS text
FROM {documents} d LEFT JOIN {src_line} l ON d.doc_id = l.file_id AND l.line_no = 2""",
    ),
    "path_included": ("S8", "SELECT page_id, url FROM {pages} WHERE url LIKE '%/fr/%' AND url NOT IN ('http://x.example.com/fr/') AND url NOT LIKE '%ref=x%'"),
    "count_lines_dir": (
        "S5",
        """SELECT source AS dir, CAST(sum(CASE WHEN text LIKE '% de %' THEN 1 ELSE 0 END) AS BIGINT) AS n_lines
FROM (SELECT d.source, l.text FROM {documents} d JOIN {doc_line} l ON d.doc_id = l.doc_id) GROUP BY source""",
    ),
    "count_lines_recursive": (
        "S5",
        """SELECT p.dir, CAST(sum(c.n) AS BIGINT) AS n_lines FROM (SELECT DISTINCT source AS dir FROM {documents}) p
JOIN (SELECT d.source, count(*) AS n FROM {documents} d JOIN {doc_line} l ON d.doc_id = l.doc_id WHERE l.text LIKE '% la %' GROUP BY d.source) c
ON substr(c.source, 1, length(p.dir)) = p.dir GROUP BY p.dir""",
    ),
    "sink_bug_text": (
        "K1",
        """SELECT inst_id, concat('File: ', file, ':', CAST(coalesce(line, before, 0) AS STRING)) AS report FROM
(SELECT inst_id, file, line, max(line) OVER (PARTITION BY fn_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {inst})""",
    ),
    "sink_callgraph_text": (
        "K2",
        "SELECT concat('fn', CAST(c.caller AS STRING), ' --> fn', CAST(c.callee AS STRING), ' (', i.file, ':', CAST(coalesce(i.line, 0) AS STRING), ')') AS edge FROM {call_edge} c JOIN {inst} i ON c.site = i.inst_id WHERE c.site_kind = 'Call'",
    ),
    "sink_ops_json": (
        "K3",
        """SELECT fn_id, concat('{{', JOINED[entry|,|inst_id], '}}') AS ops FROM
(SELECT fn_id, inst_id, concat('"', file, ':', CAST(inst_id AS STRING), '":{{"Filename":"', file, '","Line":', CAST(coalesce(line, 0) AS STRING), ',"Type":"', op, '"}}') AS entry FROM {inst} WHERE op <> 'Call')
GROUP BY fn_id""",
    ),
    # --- predicates and classifiers ------------------------------------------------------------------------------------
    "call_name": ("P1", "SELECT inst_id, CASE WHEN callee LIKE 'invoke %' THEN substr(callee, 8) WHEN callee = 'close' THEN 'builtin close' ELSE callee END AS name FROM {sync_op}"),
    "is_mutex_lock": ("P2", "SELECT inst_id FROM {sync_op} WHERE callee = '(*sync.Mutex).Lock' OR (callee LIKE 'invoke %' AND lower(split_part(callee, '.', 2)) = 'lock')"),
    "is_mutex_unlock": ("P3", "SELECT inst_id FROM {sync_op} WHERE callee = '(*sync.Mutex).Unlock' OR (callee LIKE 'invoke %' AND lower(split_part(callee, '.', 2)) = 'unlock')"),
    "is_rwmutex_lock": ("P4", "SELECT inst_id, callee = '(*sync.RWMutex).Lock' AS is_lock FROM {sync_op} WHERE callee IN ('(*sync.RWMutex).Lock', '(*sync.RWMutex).Unlock')"),
    "is_rwmutex_rlock": (
        "P5",
        "SELECT inst_id FROM {sync_op} WHERE callee IN ('(*sync.RWMutex).RLock', '(*sync.RWMutex).RUnlock') OR (callee LIKE 'invoke %' AND lower(split_part(callee, '.', 2)) IN ('rlock', 'runlock'))",
    ),
    "is_mutex_operation": ("P7", "SELECT s.inst_id FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee WHERE a.op LIKE 'Mutex%' OR a.op LIKE 'RWMutex%'"),
    "is_chan_close": ("P8", "SELECT inst_id, is_defer FROM {sync_op} WHERE callee = 'close'"),
    "scan_locker_value": (
        "P9",
        """SELECT inst_id, value_id, CASE WHEN op LIKE '%Unlock' THEN 'Unlock' ELSE 'Lock' END AS comment FROM
(SELECT s.inst_id, s.value_id, a.op FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee) WHERE op IN ('Mutex_Lock', 'Mutex_Unlock', 'RWMutex_Lock', 'RWMutex_Unlock')""",
    ),
    "scan_chan_value": (
        "P10",
        """SELECT i.inst_id, i.prim AS value_id, CASE WHEN i.inst_id % 3 = 0 THEN concat(CASE WHEN i.inst_id % 2 = 0 THEN 'Blocking_Select_' ELSE 'Non_Blocking_Select_' END, i.op, '_', CAST(k.k AS STRING)) ELSE i.op END AS comment
FROM {inst} i JOIN (SELECT * FROM (VALUES (0), (1)) AS t(k)) k ON k.k = 0 OR i.inst_id % 3 = 0 WHERE i.op IN ('Send', 'Recv')""",
    ),
    "inst_kind": ("P11", "SELECT inst_id, CASE WHEN is_defer THEN 'Defer' WHEN op IN ('Lock', 'Unlock', 'Call') THEN 'Call' WHEN op = 'Send' THEN 'Send' WHEN op = 'Recv' THEN 'UnOp' ELSE 'Unknown' END AS kind FROM {inst}"),
    "is_test_fatal_call": ("P12", "SELECT s.inst_id FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee WHERE a.op IN ('Test_Fatal', 'Test_Skip') AND NOT s.is_defer"),
    "is_first_defer": ("P13", "SELECT inst_id FROM {inst} WHERE bb_id = 0 AND is_defer"),
    "sync_op_type": ("P18-P23", "SELECT s.inst_id, coalesce(a.op, 'other') AS op_type FROM {sync_op} s LEFT JOIN {sync_api} a ON s.callee = a.callee"),
    "op_to_prim": ("P24", "SELECT op, substr(op, 1, length(op) - position('_' IN reverse(op))) AS prim FROM {sync_api} WHERE position('_' IN op) > 0"),
    "is_in_slice": ("P25", "SELECT inst_id FROM {inst} i WHERE EXISTS (SELECT 1 FROM {call_edge} c WHERE c.site = i.inst_id)"),
    "fns_of_insts": ("P26", "SELECT DISTINCT fn_id FROM {inst} WHERE op = 'Send' AND prim = 3"),
    "scan_cond_value": (
        "P27",
        """SELECT s.inst_id, s.value_id, CASE a.op WHEN 'Cond_Wait' THEN 'C_Wait' WHEN 'Cond_Signal' THEN 'C_Signal' WHEN 'Cond_Broadcast' THEN 'C_Broadcast'
WHEN 'WaitGroup_Add' THEN 'W_Add' WHEN 'WaitGroup_Done' THEN 'W_Done' ELSE 'W_Wait' END AS comment FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee WHERE a.op LIKE 'Cond%' OR a.op LIKE 'WaitGroup%'""",
    ),
    "value_name": (
        "P16",
        "SELECT inst_id, concat(replace(replace(replace(replace(callee, '(', ''), ')', ''), '*', 'Ptr_'), '/', '_Of_'), '_t', CAST(value_id AS STRING)) AS name FROM {sync_op}",
    ),
    "is_type_sync": (
        "P28",
        """SELECT p_partkey AS type_id, t LIKE 'sync.%' OR t LIKE 'chan %' OR t LIKE '%<-%' AS is_sync FROM
(SELECT p_partkey, replace(replace(CASE p_partkey % 6 WHEN 0 THEN concat('*sync.', p_type) WHEN 1 THEN concat('chan ', p_name) WHEN 2 THEN concat('[]<-chan ', p_name) WHEN 3 THEN concat('[]*sync.', p_brand) ELSE p_name END, '*', ''), '[]', '') AS t FROM {part})""",
    ),
    "side_effect_inst": ("P29", "SELECT inst_id, callee FROM {sync_op} WHERE callee LIKE '%Error%' OR callee LIKE '%error%' OR callee LIKE '%Log%' OR callee LIKE '%(*sync/atomic.Value)%' OR callee LIKE '%Leave%'"),
    "new_object_fn": ("P32", "SELECT p_partkey AS fn_id, lower(name) = concat('new', lower(type_name)) AS is_new, p_type LIKE 'PROMO%' AS returns_channel FROM (SELECT p_partkey, p_type, split_part(p_name, ' ', 2) AS type_name, concat(CASE p_partkey % 3 WHEN 0 THEN 'New' WHEN 1 THEN 'new' ELSE 'make' END, CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END) AS name FROM {part})"),
    # --- control flow ----------------------------------------------------------------------------------------------------
    "prev_insts": ("C1", "SELECT dst AS inst_id, src AS prev_id FROM {inst_edge}"),
    "succ_insts": ("C2", "SELECT src AS inst_id, dst AS succ_id FROM {inst_edge}"),
    "entry_insts": (
        "C3",
        """SELECT b.fn_id, b.first_inst AS inst_id FROM {bb_ends} b JOIN
(SELECT fn_id, min(bb_id) AS bb_id FROM (SELECT b.fn_id, b.bb_id FROM {bb} b LEFT JOIN {bb_edge} e ON b.fn_id = e.fn_id AND b.bb_id = e.dst_bb WHERE e.fn_id IS NULL) GROUP BY fn_id) m ON b.fn_id = m.fn_id AND b.bb_id = m.bb_id""",
    ),
    "exit_insts": ("C4", "SELECT b.fn_id, b.last_inst AS inst_id FROM {bb_ends} b LEFT JOIN {bb_edge} e ON b.fn_id = e.fn_id AND b.bb_id = e.src_bb WHERE e.fn_id IS NULL"),
    "index_in_bb": ("C5", "SELECT inst_id, pos AS index_in_bb, pos = 0 AS is_first, idx = max(idx) OVER (PARTITION BY fn_id, bb_id) AS is_last FROM {inst}"),
    "exit_blocks": (
        "C14",
        """SELECT DISTINCT fn_id, bb_id FROM (SELECT fn_id, bb_id FROM {sync_op} WHERE callee LIKE '%Fatal%' OR callee LIKE '%assert.%'
UNION ALL SELECT b.fn_id, b.bb_id FROM {bb} b LEFT JOIN {bb_edge} e ON b.fn_id = e.fn_id AND b.bb_id = e.src_bb WHERE e.fn_id IS NULL)""",
    ),
    # --- joins -------------------------------------------------------------------------------------------------------------
    "alias_merge": ("J1", "SELECT o.label, count(*) AS n_ops, JOINED[s.inst_id|,|s.inst_id] AS ops FROM {sync_op} s JOIN {obj_addr} o ON s.value_id = o.node GROUP BY o.label"),
    "withdraw_channels": (
        "J2",
        """SELECT CASE WHEN o.label % 17 = 0 THEN -1 WHEN o.label % 17 = 1 THEN -2 ELSE o.label END AS ch_id, count(*) AS n_ops, CAST(sum(CASE WHEN i.op = 'Send' THEN 1 ELSE 0 END) AS BIGINT) AS n_send,
CAST(sum(CASE WHEN i.op = 'Recv' THEN 1 ELSE 0 END) AS BIGINT) AS n_recv, max(CASE WHEN o.label % 5 = 0 THEN -999 ELSE o.label % 3 END) AS buffer
FROM {inst} i JOIN {obj_addr} o ON i.inst_id % 200 = o.node WHERE i.op IN ('Send', 'Recv') GROUP BY CASE WHEN o.label % 17 = 0 THEN -1 WHEN o.label % 17 = 1 THEN -2 ELSE o.label END""",
    ),
    "withdraw_lockers": (
        "J3",
        """SELECT o.label AS lk_id, CASE WHEN o.label % 4 = 0 THEN 'RWMutex' ELSE 'Mutex' END AS type, CAST(sum(CASE WHEN i.op = 'Lock' THEN 1 ELSE 0 END) AS BIGINT) AS n_lock, CAST(sum(CASE WHEN i.op = 'Unlock' THEN 1 ELSE 0 END) AS BIGINT) AS n_unlock
FROM {inst} i JOIN {obj_addr} o ON i.inst_id % 200 = o.node WHERE i.op IN ('Lock', 'Unlock') GROUP BY o.label""",
    ),
    # Nodes of one class share a label; a node may be in several classes. Two nodes may alias exactly if they share a class.
    "may_alias": ("J4", "SELECT a.label AS class_id, a.node, c.members FROM {obj_addr} a JOIN (SELECT label, count(*) AS members FROM {obj_addr} GROUP BY label HAVING count(*) > 1) c ON a.label = c.label"),
    "pts_equals": (
        "J4",
        "SELECT a.node, c.same_as, c.members FROM {pts_text} a JOIN (SELECT labels, min(node) AS same_as, count(*) AS members FROM {pts_text} GROUP BY labels HAVING count(*) > 1) c ON a.labels = c.labels",
    ),
    "callsite_callees": ("J5", "SELECT site, count(DISTINCT callee) AS n_callees, JOINED[callee|,|callee] AS callees FROM {call_edge} GROUP BY site"),
    "unique_callee_filter": ("J6", "SELECT caller, site, callee FROM (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM {call_edge}) WHERE n = 1"),
    "sync_partner_recvs": (
        "J7",
        "SELECT s.inst_id AS send_id, r.inst_id AS recv_id FROM {chan_use} s JOIN {chan_use} r ON s.prim = r.prim AND s.fn_id <> r.fn_id WHERE s.op = 'Send' AND r.op = 'Recv'",
    ),
    "alias_closes": ("J8", "SELECT s.inst_id, c.inst_id AS close_id FROM {chan_use} s JOIN {chan_use} c ON s.prim = c.prim WHERE c.op = 'Unlock'"),
    "other_buffered_ops": ("J9", "SELECT a.inst_id, b.inst_id AS other_id FROM {chan_use} a JOIN {chan_use} b ON a.prim = b.prim AND a.op = b.op AND a.inst_id <> b.inst_id"),
    "has_pair": ("J10", "SELECT s.inst_id FROM {chan_use} s WHERE s.op = 'Send' AND EXISTS (SELECT 1 FROM {chan_use} r WHERE r.op = 'Recv' AND r.prim = s.prim AND r.fn_id <> s.fn_id)"),
    "double_close_pairs": ("J11", "SELECT a.prim, a.inst_id AS close1, b.inst_id AS close2 FROM {chan_use} a JOIN {chan_use} b ON a.prim = b.prim AND a.inst_id < b.inst_id WHERE a.op = 'Unlock' AND b.op = 'Unlock'"),
    "call_insts_by_name": ("J17", "SELECT c.site, f.fn_id FROM {call_edge} c JOIN (SELECT DISTINCT fn_id, fn_id % 3 AS pkg FROM {inst}) f ON c.callee = f.fn_id AND c.caller % 3 = f.pkg"),
    "go_sites_of_fn": ("J18", "SELECT callee AS fn_id, site FROM {call_edge} WHERE site_kind = 'Go'"),
    "has_direct_call_sites": ("J18", "SELECT DISTINCT callee AS fn_id FROM {call_edge} WHERE site_kind = 'Call'"),
    "make_chan_at_line": ("J19", "SELECT file, line, max(inst_id) AS make_inst FROM {inst} WHERE op = 'Send' AND line IS NOT NULL GROUP BY file, line"),
    "chan_op_at_line": ("J19", "SELECT file, line, max(inst_id) AS op_inst, max_by(CASE WHEN op = 'Send' THEN 1 ELSE 2 END, inst_id) AS op_class FROM {inst} WHERE op IN ('Send', 'Recv') AND line IS NOT NULL GROUP BY file, line"),
    "sync_globals": ("J21", "SELECT p.p_partkey AS global_id FROM {part} p WHERE p.p_type LIKE 'PROMO%' OR EXISTS (SELECT 1 FROM {struct_sync} s WHERE s.struct_name = p.p_brand)"),
    "record_cond_ops": (
        "J24",
        """SELECT s.value_id, s.fn_id % 10 AS pkg, CAST(sum(CASE WHEN a.op = 'Cond_Signal' THEN 1 ELSE 0 END) AS BIGINT) AS n_signal, CAST(sum(CASE WHEN a.op = 'Cond_Broadcast' THEN 1 ELSE 0 END) AS BIGINT) AS n_broadcast,
CAST(sum(CASE WHEN a.op = 'Cond_Wait' THEN 1 ELSE 0 END) AS BIGINT) AS n_wait FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee WHERE a.op LIKE 'Cond%' GROUP BY s.value_id, s.fn_id % 10""",
    ),
    # --- call graph -----------------------------------------------------------------------------------------------------------
    "cg_nodes_edges": ("G1", "SELECT DISTINCT caller, site, callee FROM {call_edge}"),
    "cg_callees_of": ("G2", "SELECT caller AS fn_id, count(DISTINCT callee) AS n_callees FROM {call_edge} GROUP BY caller"),
    "cg_static": ("G6", "SELECT caller, site, callee FROM {call_edge} WHERE site_kind <> 'Go' AND site % 4 <> 0"),
    "cg_cha": (
        "G5",
        """SELECT CAST(site AS STRING) AS site, callee, 'static' AS rule FROM {call_edge} WHERE site % 4 <> 0
UNION ALL SELECT DISTINCT i.site, m.fn_id, 'interface' FROM {obj_invoke} i JOIN {method_impl} m ON i.method = m.method
UNION ALL SELECT CAST(c.site AS STRING), f.fn_id, 'dynamic' FROM {call_edge} c JOIN (SELECT fn_id, CAST(floor(fn_id / 3) AS BIGINT) AS signature FROM {inst} GROUP BY fn_id) f ON f.signature = CAST(floor(c.callee / 3) AS BIGINT) AND f.fn_id <> 0 WHERE c.site % 8 = 0""",
    ),
    "check_call_relationship": ("G10", "SELECT i.inst_id FROM {inst} i WHERE EXISTS (SELECT 1 FROM {call_edge} c WHERE c.site = i.inst_id AND c.callee % 3 = 0)"),
    # --- aggregates -------------------------------------------------------------------------------------------------------------
    "field_protection_ratio": ("A1", "SELECT struct_name, field, n_uses, n_locked FROM {field_ratio} WHERE 4 * n_locked >= 3 * n_uses AND n_locked < n_uses"),
    "suspicious_fields": ("A2", "SELECT struct_name, field FROM {field_ratio} WHERE n_locked > 0"),
    "count_send_per_goroutine": ("A5", "SELECT fn_id, prim, count(*) AS n_send FROM {inst} WHERE op = 'Send' GROUP BY fn_id, prim"),
    "ops_per_primitive": ("A6", "SELECT prim, fn_id, JOINED[inst_id|,|inst_id] AS ops FROM {inst} WHERE op IN ('Send', 'Recv') GROUP BY prim, fn_id"),
    "all_finished": (
        "A7",
        "SELECT fn_id AS task, min(done) = 1 AS finished FROM (SELECT fn_id, prim, min(CASE WHEN inst_id % 50 <> 0 THEN 1 ELSE 0 END) AS done FROM {inst} GROUP BY fn_id, prim) GROUP BY fn_id",
    ),
    "set_distinct": ("A8", "SELECT DISTINCT fn_id, op, prim FROM {inst}"),
    "dedup_reports": ("A9", "SELECT lock1, lock2 FROM (SELECT lock1, lock2, row_number() OVER (PARTITION BY lock1 ORDER BY lock2) AS nr FROM {lock_next}) WHERE nr = 1"),
    "sort_desc_by_sum": ("A10", "SELECT source, n_docs, CAST(row_number() OVER (ORDER BY n_docs DESC, source) AS BIGINT) AS place FROM (SELECT source, count(*) AS n_docs FROM {documents} GROUP BY source)"),
    "bug_numbering": ("A11", "SELECT CAST(row_number() OVER (ORDER BY lock1, lock2) AS BIGINT) AS bug_id, lock1, lock2 FROM (SELECT lock1, min(lock2) AS lock2 FROM {lock_next} GROUP BY lock1)"),
    # --- ordered patterns ---------------------------------------------------------------------------------------------------------
    "last_send_before_return_same_bb": (
        "W1",
        "SELECT inst_id FROM (SELECT inst_id, op, pos, coalesce(max(CASE WHEN op NOT IN ('Call', 'Unlock') THEN 1 ELSE 0 END) OVER (PARTITION BY fn_id, bb_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS other FROM {inst}) WHERE op = 'Send' AND other = 0",
    ),
    "send_and_jump": (
        "W2",
        """SELECT i.inst_id FROM {inst} i JOIN {bb_ends} b ON i.inst_id = b.last_inst JOIN {bb_edge} e ON e.fn_id = b.fn_id AND e.src_bb = b.bb_id JOIN {bb_text} t ON t.fn_id = e.fn_id AND t.bb_id = e.dst_bb
WHERE i.op = 'Send' AND t.ops LIKE '%Unlock,%Call'""",
    ),
    "last_recv_before_return_same_bb": (
        "W3",
        """SELECT inst_id FROM (SELECT inst_id, op, sum(CASE WHEN op = 'Recv' THEN 1 ELSE 0 END) OVER (PARTITION BY fn_id, bb_id) AS n_recv,
coalesce(max(CASE WHEN op NOT IN ('Call', 'Unlock') THEN 1 ELSE 0 END) OVER (PARTITION BY fn_id, bb_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS other FROM {inst}) WHERE op = 'Recv' AND n_recv = 1 AND other = 0""",
    ),
    # --- sets ------------------------------------------------------------------------------------------------------------------------
    "set_intersect": ("U1", "SELECT prim FROM {inst} WHERE op = 'Send' INTERSECT SELECT prim FROM {inst} WHERE op = 'Recv'"),
    "set_equal": ("U2", "SELECT a.fn_id, c.same_as, c.members FROM {held_text} a JOIN (SELECT prims, min(fn_id) AS same_as, count(*) AS members FROM {held_text} GROUP BY prims) c ON a.prims = c.prims"),
    "set_union_delta": ("U3", "SELECT DISTINCT fn_id, prim FROM {inst} i WHERE op = 'Recv' AND NOT EXISTS (SELECT 1 FROM {inst} s WHERE s.op = 'Send' AND s.fn_id = i.fn_id AND s.prim = i.prim)"),
    "set_difference": ("U4", "SELECT fn_id, prim FROM {inst} WHERE op = 'Lock' EXCEPT SELECT fn_id, prim FROM {inst} WHERE op = 'Unlock'"),
    "smt_union_by_name": ("U5", "SELECT DISTINCT concat('v', CAST(prim AS STRING)) AS name FROM (SELECT prim FROM {inst} WHERE op = 'Send' UNION ALL SELECT prim FROM {inst} WHERE op = 'Recv')"),
    "wrappers_append": ("U6", "SELECT callee AS fn_id FROM {call_edge} WHERE site_kind = 'Call' UNION SELECT fn_id FROM {inst} WHERE op = 'Lock'"),
    # --- enumeration ------------------------------------------------------------------------------------------------------------------
    "blocking_positions": ("E2", "SELECT fn_id AS path_id, idx AS pos FROM {inst} WHERE op IN ('Send', 'Recv') UNION ALL SELECT DISTINCT fn_id, -2 FROM {inst}"),
    "exactly_one": ("E7", "SELECT fn_id, prim, sum(CASE WHEN op = 'Lock' THEN 1 ELSE 0 END) = 1 AS exactly_one, sum(CASE WHEN op = 'Lock' THEN 1 ELSE 0 END) = 0 AS none_true FROM {inst} GROUP BY fn_id, prim"),
    "any_happens_before": ("E8", "SELECT inst_id, coalesce(max(CASE WHEN op = 'Unlock' THEN 1 ELSE 0 END) OVER (PARTITION BY fn_id, prim ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS happens_before FROM {inst}"),
    "buffer_level_at": (
        "E9",
        "SELECT inst_id, CAST(coalesce(sum(CASE op WHEN 'Send' THEN 1 WHEN 'Recv' THEN -1 ELSE 0 END) OVER (PARTITION BY prim ORDER BY inst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level FROM {inst}",
    ),
    "node_lookup": ("E10", "SELECT i.inst_id, concat('n_', CAST(i.fn_id AS STRING), '_', CAST(i.idx AS STRING)) AS name FROM {inst} i JOIN {bb} b ON i.fn_id = b.fn_id AND i.bb_id = b.bb_id"),
    # --- checkers ------------------------------------------------------------------------------------------------------------------------
    "fatal_in_goroutine": (
        "Q7",
        "SELECT DISTINCT c.site, s.inst_id AS fatal_id FROM {call_edge} c JOIN {sync_op} s ON c.callee = s.fn_id JOIN {sync_api} a ON s.callee = a.callee WHERE c.site_kind = 'Go' AND a.op IN ('Test_Fatal', 'Test_Skip')",
    ),
    "fix_gl1": (
        "Q9",
        """SELECT m.fn_id, m.prim, m.n_send <= 1 AND g.n_go = 1 AS fits FROM (SELECT fn_id, prim, CAST(sum(CASE WHEN op = 'Send' THEN 1 ELSE 0 END) AS BIGINT) AS n_send FROM {inst} GROUP BY fn_id, prim) m
JOIN (SELECT callee, count(DISTINCT caller) AS n_go FROM {call_edge} WHERE site_kind = 'Go' GROUP BY callee) g ON m.fn_id = g.callee""",
    ),
    "fix_dispatch": (
        "Q8",
        """SELECT fn_id, prim, CASE WHEN n_send = 1 THEN 1 WHEN n_send = 0 AND n_recv > 0 THEN 2 WHEN n_send > 1 AND n_call = 0 THEN 3 ELSE 0 END AS strategy FROM
(SELECT fn_id, prim, sum(CASE WHEN op = 'Send' THEN 1 ELSE 0 END) AS n_send, sum(CASE WHEN op = 'Recv' THEN 1 ELSE 0 END) AS n_recv, sum(CASE WHEN op = 'Call' THEN 1 ELSE 0 END) AS n_call FROM {inst} GROUP BY fn_id, prim)""",
    ),
    "fix_gl2": (
        "Q10",
        """SELECT fn_id, prim, min(line) + 1 AS make_line, JOINED[line|,|line] AS delete_lines FROM (SELECT i.fn_id, i.prim, i.line, max(i.idx) OVER (PARTITION BY i.fn_id, i.prim) AS last_idx, max(CASE WHEN i.op = 'Recv' THEN i.idx ELSE -1 END) OVER (PARTITION BY i.fn_id, i.prim) AS last_recv FROM {inst} i WHERE i.op <> 'Call')
WHERE last_idx = last_recv AND line IS NOT NULL GROUP BY fn_id, prim""",
    ),
    "fix_gl3": (
        "Q11",
        """SELECT s.fn_id, s.prim, min(s.line) + 1 AS make_line FROM {inst} s WHERE s.op = 'Send' AND s.line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {inst} c WHERE c.fn_id = s.fn_id AND c.prim = s.prim AND c.idx > s.idx AND c.op = 'Call') GROUP BY s.fn_id, s.prim""",
    ),
    "report_direct_usage": ("Q12", "SELECT prim AS ch_id, fn_id, concat('channel ', CAST(prim AS STRING), ' used at ', JOINED[line|,|idx]) AS report FROM {inst} WHERE op IN ('Send', 'Recv') AND line IS NOT NULL GROUP BY prim, fn_id"),
    # --- relational engine ------------------------------------------------------------------------------------------------------------------
    "rel_scan": ("R1", "SELECT src_bb, dst_bb, fn_id FROM {bb_edge}"),
    "rel_contains_fact": ("R2", "SELECT fn_id, src_bb, dst_bb FROM {bb_edge} WHERE dst_bb < src_bb UNION SELECT 0, 0, 0"),
    "rel_join": ("R3", "SELECT a.fn_id, a.src_bb AS a, a.dst_bb AS b, b.dst_bb AS c FROM {bb_edge} a JOIN {bb_edge} b ON a.fn_id = b.fn_id AND a.dst_bb = b.src_bb"),
    "rel_join_project": ("R4", "SELECT DISTINCT a.fn_id, a.src_bb AS a, b.dst_bb AS c FROM {bb_edge} a JOIN {bb_edge} b ON a.fn_id = b.fn_id AND a.dst_bb = b.src_bb"),
    "rel_project": ("R5", "SELECT DISTINCT fn_id, src_bb FROM {bb_edge}"),
    "rel_rename": ("R6", "SELECT fn_id, dst_bb AS src_bb, src_bb AS dst_bb FROM {bb_edge}"),
    "rel_union_delta": ("R7", "SELECT DISTINCT a.fn_id, a.src_bb, b.dst_bb FROM {bb_edge} a JOIN {bb_edge} b ON a.fn_id = b.fn_id AND a.dst_bb = b.src_bb WHERE NOT EXISTS (SELECT 1 FROM {bb_edge} t WHERE t.fn_id = a.fn_id AND t.src_bb = a.src_bb AND t.dst_bb = b.dst_bb)"),
    "rel_filter_identical": ("R9", "SELECT inst_id FROM {inst} WHERE prim = pos"),
    "rel_filter_equal": ("R10", "SELECT inst_id FROM {inst} WHERE prim = 2"),
    "rel_filter_interpreted": ("R11", "SELECT inst_id FROM {inst} WHERE prim + pos > 5 AND op <> 'Call'"),
    "rel_select_equal_project": ("R12", "SELECT inst_id, fn_id FROM {inst} WHERE pos = 1"),
    "rel_filter_intersection": ("R13", "SELECT i.inst_id FROM {inst} i WHERE EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = i.fn_id AND e.src_bb = i.bb_id AND e.dst_bb < e.src_bb)"),
    "rel_filter_negation": ("R14", "SELECT i.inst_id FROM {inst} i WHERE NOT EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = i.fn_id AND e.dst_bb = i.bb_id)"),
    "rel_bitvector_key": ("R15", "SELECT inst_id, (fn_id * 8 + prim) * 4 + pos AS packed FROM {inst}"),
    # --- query tools ------------------------------------------------------------------------------------------------------------------------------
    "guru_callees": ("V1", "SELECT DISTINCT site, callee FROM {call_edge} WHERE site_kind = 'Call'"),
    "guru_callers": ("V2", "SELECT DISTINCT callee, site, caller FROM {call_edge}"),
    "guru_peers": (
        "V4",
        "SELECT a.inst_id, b.op AS dir, count(*) AS n_peers, min(b.inst_id) AS first_peer FROM {chan_use} a JOIN {chan_use} b ON a.prim = b.prim WHERE a.op IN ('Send', 'Recv') AND b.op IN ('Send', 'Recv', 'Unlock') GROUP BY a.inst_id, b.op",
    ),
    "guru_implements": (
        "V6",
        """SELECT t.fn_id AS type_id, q.fn_id AS iface_id FROM {method_set} t JOIN {method_need} q ON t.prim = q.prim JOIN (SELECT fn_id, count(*) AS n FROM {method_need} GROUP BY fn_id) s ON q.fn_id = s.fn_id
GROUP BY t.fn_id, q.fn_id, s.n HAVING count(*) = s.n""",
    ),
    "guru_freevars": ("V8", "SELECT DISTINCT u.fn_id, u.prim FROM {inst} u WHERE u.idx BETWEEN 8 AND 15 AND NOT EXISTS (SELECT 1 FROM {inst} d WHERE d.fn_id = u.fn_id AND d.prim = u.prim AND d.idx BETWEEN 8 AND 15 AND d.op = 'Lock' AND d.idx <= u.idx)"),
    "guru_definition": ("V9", "SELECT u.inst_id, min(d.inst_id) AS def_id FROM {inst} u JOIN {inst} d ON u.fn_id = d.fn_id AND u.prim = d.prim GROUP BY u.inst_id"),
    "guru_referrers": ("V10", "SELECT fn_id, prim, count(*) AS n_refs, JOINED[idx|,|idx] AS refs FROM {inst} GROUP BY fn_id, prim"),
    "digraph_nodes": ("V12", "SELECT caller AS node FROM {fn_edge} UNION SELECT callee FROM {fn_edge}"),
    "digraph_succs": ("V12", "SELECT DISTINCT callee AS node FROM {fn_edge} WHERE caller IN (1, 2, 3)"),
    "digraph_preds": ("V12", "SELECT DISTINCT caller AS node FROM {fn_edge} WHERE callee IN (10, 17, 24)"),
    "bench_parse": (
        "V16",
        "SELECT CAST(split_part(line, ' ', 2) AS BIGINT) AS n, split_part(line, ' ', 1) AS name, CAST(split_part(line, ' ', 3) AS BIGINT) AS ns_per_op, CASE WHEN split_part(line, ' ', 5) = '' THEN 1 ELSE 5 END AS measured, ord FROM {bench_line}",
    ),
    "bench_best": ("V17", "SELECT name, min(ord) AS ord, min(ns) AS ns FROM {bench_run} GROUP BY name"),
    "bench_correlate": (
        "V18",
        "SELECT a.name, a.nth, a.ns AS before_ns, b.ns AS after_ns FROM {bench_nth} a JOIN {bench_nth} b ON a.name = b.name AND a.nth = b.nth WHERE a.half = 0 AND b.half = 1",
    ),
    "bench_delta": (
        "V19",
        """SELECT name, nth, CASE WHEN before_ns = 0 AND after_ns = 0 THEN '+0' WHEN before_ns = 0 THEN '+Inf' ELSE CAST(CAST(floor((after_ns - before_ns) * 1000 / before_ns) AS BIGINT) AS STRING) END AS permille FROM
(SELECT a.name, a.nth, a.ns AS before_ns, b.ns AS after_ns FROM {bench_nth} a JOIN {bench_nth} b ON a.name = b.name AND a.nth = b.nth WHERE a.half = 0 AND b.half = 1)""",
    ),
    "type_hash_map": ("V21", "SELECT form, count(*) AS n_types, min(p_partkey) AS first_type FROM (SELECT p_partkey, concat('struct{{', p_brand, ';', p_type, '}}') AS form FROM {part}) GROUP BY form"),
    "doc_dirtree": ("V24", "SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS dir, count(*) AS n_pages, CAST(length(url) - length(replace(url, '/', '')) AS BIGINT) AS depth FROM {pages} GROUP BY split_part(url, '/', 3), split_part(url, '/', 4), length(url) - length(replace(url, '/', ''))"),
    # --- lint passes on theme ------------------------------------------------------------------------------------------------------------------------
    "lint_assign": ("2.14", "SELECT inst_id FROM {inst} WHERE inst_id % 5 = prim AND pos = prim"),
    "lint_copylock": ("2.14", "SELECT p.p_partkey FROM {part} p JOIN {struct_sync} s ON p.p_brand = s.struct_name WHERE p.p_size % 2 = 0"),
    "lint_fieldalignment": (
        "2.14",
        "SELECT p_brand, p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p_size AS BIGINT) AS field_offset FROM {part}",
    ),
    "lint_sigchanyzer": ("2.14", "SELECT label AS ch_id FROM (SELECT DISTINCT label, label % 3 AS buffer FROM {obj_addr}) WHERE buffer = 0"),
    "lint_testinggoroutine": ("2.14", "SELECT DISTINCT s.inst_id FROM {sync_op} s JOIN {call_edge} c ON c.callee = s.fn_id WHERE c.site_kind = 'Go' AND s.callee = '(*testing.common).Fatal'"),
    "lint_unusedresult": ("2.14", "SELECT s.inst_id FROM {sync_op} s WHERE s.callee LIKE '%Load%' AND NOT EXISTS (SELECT 1 FROM {sync_op} u WHERE u.fn_id = s.fn_id AND u.value_id = s.value_id AND u.idx > s.idx)"),
    "lint_unusedwrite": ("2.14", "SELECT s.inst_id FROM {sync_op} s WHERE s.callee LIKE '%Store%' AND NOT EXISTS (SELECT 1 FROM {sync_op} u WHERE u.fn_id = s.fn_id AND u.value_id = s.value_id AND u.idx > s.idx AND u.callee LIKE '%Load%')"),
    "lint_shadow": ("2.14", "SELECT a.inst_id AS outer_id, b.inst_id AS inner_id FROM {inst} a JOIN {inst} b ON a.fn_id = b.fn_id AND a.prim = b.prim AND b.idx > a.idx WHERE a.op = 'Lock' AND b.op = 'Lock'"),
    "is_mutex_make": ("P6", "SELECT p_partkey AS inst_id, CASE WHEN p_size % 2 = 0 THEN 'sync.Mutex' ELSE 'sync.RWMutex' END AS made FROM {part} WHERE p_type LIKE 'PROMO%'"),
    "rel_explanations": ("R17", "SELECT a.fn_id, a.src_bb AS a, b.dst_bb AS c, JOINED[a.dst_bb|,|a.dst_bb] AS proof FROM {bb_edge} a JOIN {bb_edge} b ON a.fn_id = b.fn_id AND a.dst_bb = b.src_bb GROUP BY a.fn_id, a.src_bb, b.dst_bb"),
    "guru_whicherrs": ("V7", "SELECT DISTINCT i.fn_id, o.label AS err, CASE WHEN o.label % 3 = 0 THEN 'global' WHEN o.label % 3 = 1 THEN 'constant' ELSE 'type' END AS kind FROM {inst} i JOIN {obj_addr} o ON i.inst_id % 200 = o.node WHERE i.op = 'Call' AND o.label % 4 <> 0"),
    "guru_what": ("V9", "SELECT i.inst_id, concat('fn', CAST(i.fn_id AS STRING), '/bb', CAST(i.bb_id AS STRING), '/', i.op) AS enclosing, i.op IN ('Send', 'Recv') AS peers_apply FROM {inst} i"),
    "lint_bools": ("2.14", "SELECT b.inst_id FROM {inst} a JOIN {inst} b ON a.fn_id = b.fn_id AND b.idx = a.idx + 1 AND a.op = b.op AND a.prim = b.prim"),
    "lint_unreachable": ("2.14", "SELECT b.fn_id, b.bb_id FROM {bb} b WHERE b.bb_id <> 0 AND NOT EXISTS (SELECT 1 FROM {bb_edge} e WHERE e.fn_id = b.fn_id AND e.dst_bb = b.bb_id AND e.src_bb <> b.bb_id - 1)"),
    "lint_loopclosure": ("2.14", "SELECT DISTINCT c.site FROM {call_edge} c JOIN {inst} i ON c.site = i.inst_id JOIN {bb_edge} e ON e.fn_id = i.fn_id AND e.dst_bb < e.src_bb AND i.bb_id BETWEEN e.dst_bb AND e.src_bb WHERE c.site_kind IN ('Go', 'Defer')"),
    "lint_atomic": ("2.14", "SELECT s.inst_id FROM {sync_op} s JOIN {sync_api} a ON s.callee = a.callee WHERE a.op = 'Atomic_Int_Add' AND s.value_id % 2 = 0"),
    "lint_nilfunc": ("2.14", "SELECT inst_id FROM {sync_op} WHERE value_id = 0 AND callee LIKE '%.%'"),
    "lint_findcall": ("2.14", "SELECT inst_id, fn_id FROM {sync_op} WHERE callee = 'fmt.Println'"),
}
