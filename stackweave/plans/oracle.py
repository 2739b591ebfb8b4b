"""The same results as plain SQL over the given tables, written independently of the Spark plans.

Common tables are CTEs; a query lists the ones it needs.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
SELECT event_id AS seq, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_type, value, ts,
       user_id % 4 + (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) // 90) * 10 AS pid,
       user_id AS tid, epoch_us(ts) * 1000 AS time, event_id % 8 AS cpu
FROM events"""),
    "sm": (("ev",), """
SELECT *, CASE WHEN k % 10 = 0 THEN 1 ELSE 2 END AS cpumode,
       1 + CASE WHEN event_type IN ('click', 'view') THEN 2 WHEN event_type IN ('purchase', 'signup') THEN 4 ELSE 0 END
         + CASE WHEN k % 16 = 1 THEN 256 WHEN k % 16 = 2 THEN 512 ELSE 0 END AS flags,
       CASE WHEN k % 19 = 3 THEN 0 WHEN k % 23 = 5 THEN n + 2 ELSE ipPart + 1 END AS ipLocationId,
       CASE WHEN (k + seq) % 19 = 4 THEN 0 WHEN (k + seq) % 29 = 6 THEN n + 3 ELSE addrPart + 1 END AS addressLocationId,
       CASE WHEN k % 31 = 7 THEN 0 ELSE (ipPart + 1) * 16 END AS ip,
       CASE WHEN (k + seq) % 19 = 4 THEN 0 ELSE (addrPart + 1) * 16 END AS addr,
       CASE WHEN k % 13 <> 0 THEN event_type END AS ipComm, CASE WHEN k % 5 = 0 THEN 'worker' END AS addressComm,
       CASE WHEN k % 3 <> 0 THEN 'ips' || (k % 7) END AS ipSym, 'ads' || (k % 5) AS addressSym
FROM (SELECT ev.*, n, (tid * 8 + (k * 7) % 40) % n AS ipPart, (tid * 8 + (k * 3 + seq) % 40) % n AS addrPart
      FROM ev, (SELECT count(*) AS n FROM part))"""),
    "br": (("sm",), "SELECT *, row_number() OVER (PARTITION BY pid, tid ORDER BY seq) AS id FROM sm"),
    "loc": ((), """
SELECT p_partkey + 1 AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS buildId,
       CASE WHEN g % 13 = 12 THEN '' ELSE '/lib/d' || (g % 16) END AS dso, (p_partkey + 1) * 16 AS relativeAddress,
       CASE WHEN g % 7 = 0 THEN 'main' WHEN g % 7 <> 6 THEN 'fn' || g END AS symbol,
       CASE WHEN p_partkey % 4 <> 0 THEN '/src/' || lower(p_type) || '.c' END AS sourceFileName,
       CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS sourceLineNumber
FROM (SELECT *, p_partkey // 4 AS g FROM part)"""),
    "aux": (("ev",), """
SELECT seq, time + (k % 2) * 500 AS time, pid, tid, cpu, CASE WHEN k % 9 = 0 THEN 1 + k % 3 ELSE 0 END AS flags
FROM ev WHERE event_type = 'error'"""),
    "loss": (("aux",), "SELECT *, row_number() OVER (ORDER BY seq) AS id FROM aux WHERE flags <> 0"),
    "entries": (("loc",), """
SELECT dso, symbol, min(relativeAddress) AS entryAddress FROM loc
WHERE dso <> '' AND symbol <> '' GROUP BY dso, symbol"""),
    # Classified branches; the two ends are compared by name, not by a function id.
    "cl": (("br", "loc", "entries"), """
SELECT *, NOT isCall AND (((flags & 4) <> 0) OR (NOT sameFunction AND NOT isEntry)) AS isReturn,
       isCall AND NOT isStackCall AS isIgnoredCall
FROM (SELECT *, ((flags & 2) <> 0) OR (NOT sameFunction AND isEntry) AS isCall, NOT sameFunction OR isEntry AS isStackCall,
             CASE WHEN cpumode = 2 THEN 0 ELSE 1 END AS kind
      FROM (SELECT b.*, i.dso AS ipDso, i.symbol AS ipSymbol, a.dso AS addressDso, a.symbol AS addressSymbol,
                   a.relativeAddress AS addressRelative, e.entryAddress,
                   coalesce(i.dso <> '' AND i.symbol <> '' AND i.dso = a.dso AND i.symbol = a.symbol, false) AS sameFunction,
                   coalesce(a.relativeAddress = e.entryAddress, false) AS isEntry
            FROM br b LEFT JOIN loc i ON i.id = b.ipLocationId LEFT JOIN loc a ON a.id = b.addressLocationId
                 LEFT JOIN entries e ON e.dso = a.dso AND e.symbol = a.symbol))"""),
    "ordered": (("cl",), """
SELECT *, max(time) OVER (PARTITION BY tid ORDER BY rn) AS reached
FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CAST(pid AS VARCHAR), id) AS rn FROM cl)"""),
    "placed": (("ordered", "loss"), """
SELECT l.tid, l.time, coalesce(min(o.rn), (SELECT max(rn) + 1 FROM ordered x WHERE x.tid = l.tid)) AS rn
FROM loss l LEFT JOIN ordered o ON o.tid = l.tid AND o.reached > l.time
GROUP BY l.id, l.tid, l.time"""),
    "names": (("loc",), "SELECT id, CASE WHEN dso <> '' AND symbol <> '' THEN dso || ' ' || symbol ELSE '#' || id END AS fn, coalesce(symbol, '') <> '' AS named, coalesce(symbol = 'main', false) AS main FROM loc"),
    # Steps of each thread: rows, then an end step; `lost` is the first loss just before the step.
    "steps": (("ordered", "placed", "names"), """
SELECT r.tid, r.rn, false AS done, r.id, r.time, r.cpu, r.kind, r.sameFunction AS same,
       CASE WHEN r.isCall AND r.isStackCall THEN 'call' WHEN r.isReturn THEN 'return' ELSE '' END AS act,
       r.ipLocationId AS ipLoc, CASE WHEN r.addressLocationId <> 0 THEN r.addressLocationId ELSE r.ipLocationId END AS toLoc,
       coalesce(i.fn, '#' || r.ipLocationId) AS ipFn,
       coalesce(t.fn, '#' || CASE WHEN r.addressLocationId <> 0 THEN r.addressLocationId ELSE r.ipLocationId END) AS toFn,
       coalesce(i.named, false) AS ipNamed, coalesce(i.main, false) AS ipMain, coalesce(t.main, false) AS toMain,
       (SELECT min(p.time) FROM placed p WHERE p.tid = r.tid AND p.rn = r.rn) AS lost
FROM ordered r LEFT JOIN names i ON i.id = r.ipLocationId
     LEFT JOIN names t ON t.id = CASE WHEN r.addressLocationId <> 0 THEN r.addressLocationId ELSE r.ipLocationId END
UNION ALL
SELECT tid, max(rn) + 1, true, max_by(id, rn), max_by(time, rn), max_by(cpu, rn), 0, false, '', 0, 0, '', '', false, false, false,
       (SELECT min(p.time) FROM placed p WHERE p.tid = o.tid AND p.rn = (SELECT max(x.rn) + 1 FROM ordered x WHERE x.tid = o.tid))
FROM ordered o GROUP BY tid"""),
    # One recursion level = the next step of every thread; stacks are lists of open frames.
    "RECURSIVE walk": (("steps",), """
SELECT DISTINCT tid, CAST(0 AS BIGINT) AS rn, CAST(-1 AS INTEGER) AS active, CAST(0 AS BIGINT) AS lastId, CAST(0 AS BIGINT) AS lastCpu,
       CAST([] AS STRUCT(fn VARCHAR, loc BIGINT, main BOOLEAN, st BIGINT, tr BIGINT, cpu BIGINT, why INTEGER)[]) AS us,
       CAST([] AS STRUCT(fn VARCHAR, loc BIGINT, main BOOLEAN, st BIGINT, tr BIGINT, cpu BIGINT, why INTEGER)[]) AS ks,
       CAST([] AS STRUCT(kind INTEGER, depth BIGINT, st BIGINT, et BIGINT, tr BIGINT, etr BIGINT, loc BIGINT, c BIGINT, ec BIGINT, why INTEGER, ewhy INTEGER)[]) AS em,
       CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS resyncs, CAST(0 AS BIGINT) AS dropped
FROM steps
UNION ALL
SELECT tid, rn, CASE WHEN done THEN active3 ELSE kind END, id, cpu,
       CASE WHEN NOT done AND kind = 0 THEN after ELSE us3 END, CASE WHEN NOT done AND kind = 1 THEN after ELSE ks3 END,
       em1 || em2 || em3, skipped, ignored, resyncs, dropped
FROM (
 SELECT *,
  CASE WHEN done THEN [] WHEN act = 'call' THEN list_append(base, {'fn': toFn, 'loc': toLoc, 'main': toMain, 'st': time, 'tr': id, 'cpu': cpu, 'why': 0})
       WHEN closing > 0 THEN s[1:closing - 1] ELSE s END AS after,
  CASE WHEN done AND active3 >= 0 THEN list_reverse(list_filter(list_transform(CASE WHEN active3 = 0 THEN us3 ELSE ks3 END, lambda f, i:
            {'kind': active3, 'depth': CAST(i - 1 AS BIGINT), 'st': f.st, 'et': greatest(time, f.st), 'tr': f.tr, 'etr': CASE WHEN id = 0 THEN f.tr ELSE id END,
             'loc': CASE WHEN f.main THEN f.loc ELSE -1 END, 'c': f.cpu, 'ec': cpu, 'why': f.why, 'ewhy': 5}), lambda e: e.loc >= 0))
       WHEN closing > 0 THEN [{'kind': kind, 'depth': CAST(closing - 1 AS BIGINT), 'st': s[closing].st, 'et': greatest(time, s[closing].st), 'tr': s[closing].tr,
             'etr': id, 'loc': s[closing].loc, 'c': s[closing].cpu, 'ec': cpu, 'why': s[closing].why, 'ewhy': 2}]
       ELSE [] END AS em3,
  CASE WHEN act = 'return' AND (len(s) = 0 OR (NOT quiet AND hit = 0 AND len(s) = 1)) THEN 1 ELSE 0 END AS skipped,
  CASE WHEN act = 'return' AND len(s) > 0 AND quiet THEN 1 ELSE 0 END AS ignored,
  CASE WHEN act = 'call' AND NOT same THEN CASE WHEN hit > 0 AND hit < len(s) OR (hit = 0 AND ipNamed) THEN 1 ELSE 0 END
       WHEN act = 'return' AND len(s) > 0 AND NOT quiet AND ((hit > 0 AND hit < len(s)) OR (hit = 0 AND len(s) > 1)) THEN 1 ELSE 0 END AS resyncs,
  CASE WHEN (act = 'call' AND NOT same OR act = 'return' AND len(s) > 0 AND NOT quiet) AND hit > 0 THEN len(s) - hit ELSE 0 END AS dropped
 FROM (
  SELECT *,
   CASE WHEN act = 'call' AND NOT same AND hit > 0 THEN s[1:hit]
        WHEN act = 'call' AND NOT same AND ipNamed THEN list_append(s, {'fn': ipFn, 'loc': ipLoc, 'main': ipMain, 'st': time, 'tr': id, 'cpu': cpu, 'why': 0})
        ELSE s END AS base,
   CASE WHEN act = 'return' AND len(s) > 0 AND NOT quiet THEN CASE WHEN hit > 0 THEN hit WHEN len(s) > 1 THEN len(s) ELSE 0 END ELSE 0 END AS closing
  FROM (
   SELECT *, coalesce(list_max(list_transform(s, lambda f, i: CASE WHEN f.fn = ipFn THEN i ELSE 0 END)), 0) AS hit,
     same AND NOT coalesce(len(s) > 1 AND s[len(s)].fn = ipFn AND s[len(s) - 1].fn = ipFn, false) AS quiet
   FROM (
    SELECT *, CASE WHEN kind = 0 THEN us3 ELSE ks3 END AS s
    FROM (
     SELECT *, active2 AS active3,
      CASE WHEN NOT done AND active2 <> kind AND kind = 0 THEN list_transform(us2, lambda f: {'fn': f.fn, 'loc': f.loc, 'main': f.main, 'st': time, 'tr': id, 'cpu': cpu, 'why': 1}) ELSE us2 END AS us3,
      CASE WHEN NOT done AND active2 <> kind AND kind = 1 THEN list_transform(ks2, lambda f: {'fn': f.fn, 'loc': f.loc, 'main': f.main, 'st': time, 'tr': id, 'cpu': cpu, 'why': 1}) ELSE ks2 END AS ks3,
      CASE WHEN NOT done AND active2 >= 0 AND active2 <> kind THEN list_reverse(list_transform(CASE WHEN active2 = 0 THEN us2 ELSE ks2 END, lambda f, i:
          {'kind': active2, 'depth': CAST(i - 1 AS BIGINT), 'st': f.st, 'et': greatest(time, f.st), 'tr': f.tr, 'etr': id, 'loc': f.loc, 'c': f.cpu, 'ec': cpu, 'why': f.why, 'ewhy': 3})) ELSE [] END AS em2
     FROM (
      SELECT st.*, CASE WHEN lost IS NULL THEN w.active ELSE -1 END AS active2,
       CASE WHEN lost IS NULL THEN w.us ELSE [] END AS us2, CASE WHEN lost IS NULL THEN w.ks ELSE [] END AS ks2,
       CASE WHEN lost IS NOT NULL AND w.active >= 0 THEN list_reverse(list_transform(CASE WHEN w.active = 0 THEN w.us ELSE w.ks END, lambda f, i:
          {'kind': w.active, 'depth': CAST(i - 1 AS BIGINT), 'st': f.st, 'et': greatest(lost, f.st), 'tr': f.tr, 'etr': CASE WHEN w.lastId = 0 THEN f.tr ELSE w.lastId END,
           'loc': f.loc, 'c': f.cpu, 'ec': w.lastCpu, 'why': f.why, 'ewhy': 4})) ELSE [] END AS em1
      FROM walk w JOIN steps st ON st.tid = w.tid AND st.rn = w.rn + 1))))))"""),
    "rawframes": (("RECURSIVE walk",), """
SELECT row_number() OVER (ORDER BY tid, rn, pos) AS frameId, tid, e.depth AS depth, e.st AS startTime, e.et AS endTime,
       e.tr AS startTrace, e.etr AS endTrace, e.loc AS locationId, e.c AS startCpu, e.ec AS endCpu,
       e.why AS startReason, e.ewhy AS endReason, e.kind AS kind
FROM (SELECT tid, rn, unnest(em) AS e, generate_subscripts(em, 1) AS pos FROM walk)"""),
    # Depth = number of earlier frames still open: they end after this start and no frame since,
    # this one included, ends later than they do.
    "numbered": (("rawframes",), """
SELECT *, row_number() OVER (PARTITION BY tid, kind ORDER BY startTime, startTrace, endTime DESC, endTrace DESC, frameId) AS rank,
       CAST(endTime AS HUGEINT) * 1000000 + endTrace AS endKey, CAST(startTime AS HUGEINT) * 1000000 + startTrace AS startKey
FROM rawframes"""),
    "fr": (("numbered",), """
SELECT g.frameId, g.tid, count(f.frameId) AS depth, g.startTime, g.endTime, g.startTrace, g.endTrace, g.locationId, g.startCpu, g.endCpu,
       g.startReason, g.endReason, g.kind
FROM numbered g LEFT JOIN numbered f ON f.tid = g.tid AND f.kind = g.kind AND f.rank < g.rank AND f.endKey > g.startKey AND f.endKey >= g.endKey
     AND NOT EXISTS (SELECT 1 FROM numbered h WHERE h.tid = g.tid AND h.kind = g.kind AND h.rank > f.rank AND h.rank < g.rank AND h.endKey > f.endKey)
GROUP BY ALL"""),
}


CTES.update({
    # Raw samples: names of both ends by arithmetic; the target counts only if gated.
    "raw": (("br",), """
SELECT *, k % 6 <> 1 AS gated, ipPart // 4 AS ipG, addrPart // 4 AS adG,
       CASE event_type WHEN 'click' THEN 'branches' WHEN 'view' THEN 'branches:u' WHEN 'error' THEN 'cpu-clock:'
            WHEN 'purchase' THEN '' ELSE 'sw ev/é:k' END AS event,
       CASE event_type WHEN 'click' THEN 'branches' WHEN 'view' THEN 'branches' WHEN 'error' THEN 'cpu-clock'
            WHEN 'purchase' THEN 'unknown' ELSE '73772065762FC3A9' END AS component
FROM br"""),
    "ends": (("raw",), """
SELECT seq * 2 AS arrival, ipPart AS part, ipG AS g FROM raw
UNION ALL SELECT seq * 2 + 1, addrPart, adG FROM raw WHERE gated"""),
    "dim": (("ends",), """
SELECT row_number() OVER (ORDER BY min(arrival)) AS id, part, any_value(g) AS g,
       CASE WHEN part % 5 = 0 THEN '' ELSE 'b' || (part % 25) END AS buildId,
       CASE WHEN any_value(g) % 13 = 12 THEN '' ELSE '/lib/d' || (any_value(g) % 16) END AS dso, (part + 1) * 16 AS relativeAddress,
       CASE WHEN any_value(g) % 7 = 0 THEN 'main' WHEN any_value(g) % 7 <> 6 THEN 'fn' || any_value(g) END AS sym
FROM ends GROUP BY part"""),
    "flat": (("raw", "dim"), """
SELECT r.id, r.seq * 3 AS perfId, r.pid, r.tid, r.time, r.flags, r.seq, r.event, r.component, (r.ipPart + 1) * 16 AS ip,
       CASE WHEN gated THEN (r.addrPart + 1) * 16 ELSE 0 END AS addr, i.id AS ipLocationId,
       CASE WHEN gated THEN a.id ELSE 0 END AS addressLocationId, gated AS haveAddress, i.sym AS ipSym,
       CASE WHEN gated THEN CASE WHEN adG % 7 = 0 THEN 'main' WHEN adG % 7 <> 6 THEN 'fn' || adG END END AS addressSym,
       CASE WHEN gated THEN CASE WHEN adG % 13 = 12 THEN '' ELSE '/lib/d' || (adG % 16) END END AS addressDso,
       CASE WHEN gated THEN hex(CASE WHEN addrPart % 5 = 0 THEN '' ELSE 'b' || (addrPart % 25) END) END AS addressBuildId,
       CASE WHEN gated THEN adG * 64 + 16 ELSE 0 END AS addressSymStart, r.ipComm, CASE WHEN gated THEN r.addressComm END AS addressComm
FROM raw r LEFT JOIN dim i ON i.part = r.ipPart LEFT JOIN dim a ON a.part = r.addrPart"""),
    "symtab": ((), """
SELECT '/lib/d' || (p_partkey % 2) AS dso, (p_partkey // 2) * 160 AS address, p_name AS name FROM part WHERE p_partkey % 6 < 4"""),
    "linetab": (("loc",), """
SELECT dso, (p_partkey + 1) * 16 AS address, '/src/' || lower(p_type) || '.c' AS file, CAST(p_size AS BIGINT) AS line
FROM part JOIN loc ON loc.id = p_partkey + 1 WHERE p_partkey % 11 NOT IN (0, 1, 2, 4) AND p_size > 0"""),
    "q": (("loc",), """
SELECT id, CASE WHEN dso <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(symbol, '') <> '' THEN 2 ELSE 0 END
         + CASE WHEN coalesce(sourceFileName, '') <> '' AND sourceLineNumber <> 0 THEN 4 ELSE 0 END AS quality FROM loc"""),
    "ep": (("br",), """
SELECT ip AS address, ipLocationId AS locationId, event_type FROM br UNION ALL SELECT addr, addressLocationId, event_type FROM br"""),
    "epq": (("ep", "q"), """
SELECT address, locationId, event_type, coalesce(CASE WHEN locationId <> 0 THEN quality END, 0) AS quality,
       locationId <> 0 AND q.id IS NULL AS isMissing
FROM ep LEFT JOIN q ON q.id = locationId WHERE address <> 0"""),
    "disp": (("loc",), """
SELECT id, symbol, sourceFileName, sourceLineNumber,
  CASE WHEN coalesce(symbol, '') <> '' THEN symbol
       WHEN sourceFileName <> '' AND sourceLineNumber <> 0 THEN regexp_extract(sourceFileName, '[^/]*$') || ':' || sourceLineNumber
       WHEN dso <> '' THEN regexp_extract(dso, '[^/]*$') || '+0x' || printf('%x', relativeAddress)
       ELSE '0x' || printf('%x', relativeAddress) END AS display
FROM loc"""),
    "fall": (("br",), """
SELECT locationId, arg_min(sym, (tid, CAST(pid AS VARCHAR), id, side)) AS fallbackName FROM (
  SELECT tid, pid, id, 0 AS side, ipLocationId AS locationId, ipSym AS sym FROM br
  UNION ALL SELECT tid, pid, id, 1, addressLocationId, addressSym FROM br) WHERE locationId <> 0 AND coalesce(sym, '') <> ''
GROUP BY locationId"""),
    "eventnames": (("disp", "fall", "ep"), """
SELECT l.locationId, CASE WHEN l.locationId = 0 THEN 'Unknown' ELSE coalesce(nullif(d.display, ''), f.fallbackName, 'location:' || l.locationId) END AS name,
       CASE WHEN l.locationId <> 0 THEN d.symbol END AS function, CASE WHEN l.locationId <> 0 THEN d.sourceFileName END AS file,
       CASE WHEN l.locationId <> 0 AND (coalesce(d.symbol, '') <> '' OR coalesce(d.sourceFileName, '') <> '') THEN nullif(CAST(d.sourceLineNumber AS BIGINT), 0) END AS line
FROM (SELECT DISTINCT locationId FROM ep) l LEFT JOIN disp d ON d.id = l.locationId LEFT JOIN fall f ON f.locationId = l.locationId"""),
    "comms": (("br",), """
SELECT tid, pid, rn, comm, row_number() OVER (PARTITION BY tid ORDER BY rn) AS run FROM (
  SELECT *, lag(comm) OVER (PARTITION BY tid ORDER BY rn) AS before FROM (
    SELECT tid, pid, row_number() OVER (PARTITION BY tid ORDER BY CAST(pid AS VARCHAR), id) AS rn, coalesce(ipComm, addressComm) AS comm FROM br)
  WHERE comm IS NOT NULL) WHERE before IS NULL OR before <> comm"""),
    "info": (("br", "comms"), """
SELECT b.tid, arg_min(b.pid, CAST(b.pid AS VARCHAR)) AS pid,
  coalesce((SELECT string_agg(comm, ' -> ' ORDER BY run) FROM comms c WHERE c.tid = b.tid AND run <= 16), 'Thread ' || b.tid) AS threadName
FROM br b GROUP BY b.tid"""),
    "stk": (("ev",), """
SELECT seq AS sampleId, tid, time, list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]) AS symbols FROM (
  SELECT *, list_filter(['main', CASE WHEN a % 7 = 0 THEN 'main' WHEN a % 7 <> 6 THEN 'fn' || a END,
                         CASE WHEN b % 7 = 0 THEN 'main' WHEN b % 7 <> 6 THEN 'fn' || b END], lambda x: x IS NOT NULL) AS s FROM (
    SELECT ev.*, ((tid * 8 + k % 40) % n) // 4 AS a, ((tid * 8 + (k * 3) % 40) % n) // 4 AS b
    FROM ev, (SELECT count(*) AS n FROM part)))"""),
    "want": (("stk",), "SELECT DISTINCT unnest(symbols) AS symbol FROM stk"),
    "matches": (("want", "loc"), """
SELECT DISTINCT loc.symbol AS locationSymbol, want.symbol FROM loc, want
WHERE loc.symbol IS NOT NULL AND CASE WHEN want.symbol = 'main' THEN loc.symbol = 'main' ELSE contains(loc.symbol, want.symbol) END"""),
    "fbs": (("fr", "matches"), """
SELECT m.symbol, fr.*, row_number() OVER (ORDER BY fr.tid, fr.kind, fr.startTime, fr.startTrace, fr.endTime DESC, fr.endTrace DESC, fr.frameId) AS place
FROM fr JOIN loc ON loc.id = fr.locationId JOIN matches m ON m.locationSymbol = loc.symbol"""),
    "pos": (("stk",), """
SELECT sampleId, time, len(symbols) AS size, unnest(symbols) AS symbol, generate_subscripts(symbols, 1) - 1 AS position FROM stk"""),
    "alone": (("pos", "fbs"), """
SELECT p.sampleId, p.symbol, arg_min(f.frameId, (f.depth, f.startTime, f.place)) AS frameId
FROM (SELECT DISTINCT sampleId, time, symbol FROM pos) p JOIN fbs f ON f.symbol = p.symbol
 AND p.time >= greatest(f.startTime - 3600000000000, 0) AND p.time <= f.endTime + 3600000000000 GROUP BY ALL"""),
    "held": (("pos", "fbs"), """
SELECT p.sampleId, p.position, p.size, f.frameId, f.depth, f.startTime, f.endTime, f.startTrace, f.endTrace, f.place
FROM pos p JOIN fbs f ON f.symbol = p.symbol AND p.size > 1
 AND p.time >= greatest(f.startTime - 3600000000000, 0) AND p.time <= f.endTime + 3600000000000"""),
    # Sampled stacks hold at most three symbols, so two upward steps cover all walks.
    "up1": (("held",), """
SELECT c.sampleId, c.size, c.frameId AS leaf, c.startTime AS lt, c.startTrace AS ln, c.place AS lp,
       arg_min((p.frameId, p.depth, p.startTime, p.startTrace, p.endTime, p.endTrace), (-p.depth, p.startTime, p.place)) AS par
FROM held c JOIN held p ON p.sampleId = c.sampleId AND p.position = c.position - 1 AND c.position = c.size - 1 AND p.depth < c.depth
 AND (p.startTime, p.startTrace) <= (c.startTime, c.startTrace) AND (c.endTime, c.endTrace) <= (p.endTime, p.endTrace)
GROUP BY ALL"""),
    "up2": (("up1",), """
SELECT c.sampleId, c.leaf, c.lt, c.ln, c.lp, c.par[1] AS mid, arg_min(p.frameId, (-p.depth, p.startTime, p.place)) AS root
FROM up1 c JOIN held p ON p.sampleId = c.sampleId AND p.position = 0 AND c.size = 3 AND p.depth < c.par[2]
 AND (p.startTime, p.startTrace) <= (c.par[3], c.par[4]) AND (c.par[5], c.par[6]) <= (p.endTime, p.endTrace)
GROUP BY ALL"""),
    "won": (("up1", "up2"), """
SELECT sampleId, arg_min(chain, (lt, ln, lp)) AS chain FROM (
  SELECT sampleId, lt, ln, lp, [par[1], leaf] AS chain FROM up1 WHERE size = 2
  UNION ALL SELECT sampleId, lt, ln, lp, [root, mid, leaf] FROM up2) GROUP BY sampleId"""),
    "matched": (("pos", "alone", "won"), """
SELECT p.sampleId, p.position, p.symbol, CASE WHEN w.chain IS NOT NULL THEN w.chain[p.position + 1] ELSE a.frameId END AS frameId,
       w.chain IS NOT NULL AS chained
FROM pos p LEFT JOIN alone a ON a.sampleId = p.sampleId AND a.symbol = p.symbol LEFT JOIN won w ON w.sampleId = p.sampleId"""),
    "eps": (("fr",), """
SELECT tid, kind, frameId, depth, locationId, isBegin, startTime = endTime AND startTrace = endTrace AS isInstant,
       CASE WHEN isBegin THEN startTime ELSE endTime END AS time, CASE WHEN isBegin THEN startTrace ELSE endTrace END AS trace
FROM fr, (VALUES (true), (false)) v(isBegin)"""),
    "vis": (("fr",), """
SELECT tid, frameId, depth, isBegin, startReason <> 1 AND endReason = 2 AND startTime = endTime AND startTrace = endTrace AS isInstant,
       CASE WHEN isBegin THEN startTime ELSE endTime END AS time, CASE WHEN isBegin THEN startTrace ELSE endTrace END AS trace
FROM fr, (VALUES (true), (false)) v(isBegin) WHERE CASE WHEN isBegin THEN startReason <> 1 ELSE endReason = 2 END"""),
    "opens": (("vis",), """
SELECT *, sum(CASE WHEN isBegin THEN 1 ELSE -1 END) OVER (PARTITION BY tid ORDER BY time, trace,
   CASE WHEN isInstant THEN 2 WHEN isBegin THEN 1 ELSE 0 END, CASE WHEN NOT isBegin AND NOT isInstant THEN -depth ELSE depth END, frameId, isBegin DESC) AS open,
  row_number() OVER (PARTITION BY tid ORDER BY time, trace,
   CASE WHEN isInstant THEN 2 WHEN isBegin THEN 1 ELSE 0 END, CASE WHEN NOT isBegin AND NOT isInstant THEN -depth ELSE depth END, frameId, isBegin DESC) AS rn
FROM vis"""),
    "snaps": (("ev",), """
SELECT *, 'pid=' || pid || '/tid=' || tid || '/branches.parquet' AS file, CASE WHEN k % 10 = 0 THEN 'CLOSED' ELSE 'BUFFERING' END AS status,
       seq * (1 + k % 2) * 0.5::DOUBLE AS elapsedMs, k % 20 <> 1 AS longForm, epoch_us(ts) AS us FROM ev WHERE k % 20 <> 2"""),
    "filerates": (("snaps",), """
SELECT *, CASE WHEN us > pus THEN CAST(round_even(greatest(seq - pseq, 0) / ((us - pus) / 1e6), 0) AS BIGINT) END AS rate
FROM (SELECT *, lag(us) OVER (PARTITION BY file ORDER BY us, seq) AS pus, lag(seq) OVER (PARTITION BY file ORDER BY us, seq) AS pseq FROM snaps)"""),
})


CTES["clips"] = (("ordered",), """
SELECT seq, tid FROM (SELECT *, lag(ends) OVER (PARTITION BY tid ORDER BY rn) AS before FROM (
  SELECT *, flags & 256 <> 0 AS begins, flags & 512 <> 0 AND NOT isIgnoredCall AS ends FROM ordered) WHERE begins OR ends)
WHERE ends AND NOT (coalesce(before, false) AND NOT begins)""")


def sql(body: str, *needs: str, swap: dict[str, str] | None = None) -> str:
    """`body` preceded by the CTEs it needs, in dependency order; `swap` rewrites CTE texts."""
    order: list[str] = []

    def visit(name: str) -> None:
        key = name if name in CTES else f"RECURSIVE {name}"
        if key in order:
            return
        for dependency in CTES[key][0]:
            visit(dependency)
        order.append(key)

    for need in needs:
        visit(need)
    if not order:
        return body
    recursive = any(n.startswith("RECURSIVE ") for n in order)
    def clause(name: str) -> str:
        short = name.removeprefix("RECURSIVE ")
        kept = "" if name.startswith("RECURSIVE ") else "MATERIALIZED "
        text = (swap or {}).get(name, "{0}").format(CTES[name][1].strip())
        return f"{short} AS {kept}({text})"

    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(clause(n) for n in order) + "\n" + body


_FRAME = "frameId, tid, depth, startTime, endTime, startTrace, endTrace, locationId, startCpu, endCpu, startReason, endReason, kind"
_ORDER = """time, trace, CASE WHEN isInstant THEN 2 WHEN isBegin THEN 1 ELSE 0 END,
  CASE WHEN NOT isBegin AND NOT isInstant THEN -depth ELSE depth END, frameId, isBegin DESC"""
_STATS = """count(*) AS {p}, count(*) FILTER (quality & 1 <> 0) AS {s}WithDso, count(*) FILTER (quality & 2 <> 0) AS {s}WithSymbol,
  count(*) FILTER (quality & 4 <> 0) AS {s}WithSourceLine"""
_SOURCE = "SELECT " + _STATS.format(p="sourceLocs", s="source") + " FROM q"
_FILES = "SELECT count(DISTINCT (pid, tid)) AS branchFiles, count(*) AS branchRows FROM br{where}"
_ENDS = """SELECT count(*) AS addressEndpoints, count(*) FILTER (locationId <> 0) AS endpointsWithLocationId,
  count(*) FILTER (quality & 1 <> 0) AS endpointsWithDso, count(*) FILTER (quality & 2 <> 0) AS endpointsWithSymbol,
  count(*) FILTER (quality & 4 <> 0) AS endpointsWithSourceLine, count(*) FILTER (isMissing) AS locationIdsMissing FROM epq{where}"""
_DISTINCT = "SELECT " + _STATS.format(p="distinctAddresses", s="distinct") + " FROM (SELECT address, bit_or(quality) AS quality FROM epq{where} GROUP BY address)"


def _report(label: str, path: str, where: str = "") -> str:
    return (f"SELECT '{label}' AS variant, '{path}' AS path, * FROM ({_SOURCE}), ({_FILES.format(where=where)}), "
            f"({_ENDS.format(where=where)}), ({_DISTINCT.format(where=where)})")


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN '0.00%' ELSE printf('%.2f%%', round({part} / {whole}::DOUBLE * 100, 2)) END"


def _reasons(condition: str) -> str:
    return sql(f"SELECT tid, locationId, count(*) AS frames, CAST(sum(depth) AS BIGINT) AS depths FROM rawframes WHERE {condition} GROUP BY tid, locationId", "rawframes")


_REASON = "CASE {c} WHEN 0 THEN 'Call' WHEN 1 THEN 'TraceResume' WHEN 2 THEN 'Return' WHEN 3 THEN 'TraceEnd' WHEN 4 THEN 'AuxLoss' ELSE 'EndOfInput' END"
_FLAT = "SELECT id, pid, tid, time, flags, ip, addr, haveAddress, ipSym, addressSym, ipComm FROM flat"
_TRACK = "1152921504606846976"  # 1 << 60
_EXPORT = f"""
SELECT 0 AS section, 'process' AS event, pid, NULL::BIGINT AS tid, NULL::BIGINT AS kind, NULL::BIGINT AS timestamp, {_TRACK} | pid AS trackUuid, NULL::BIGINT AS parentUuid,
  CASE WHEN pid = 0 THEN 'Unknown process' ELSE 'Process ' || pid END AS name, NULL::VARCHAR AS function, NULL::VARCHAR AS file, NULL::BIGINT AS line,
  NULL::BIGINT AS sequenceId, NULL::BIGINT AS frameId FROM (SELECT DISTINCT pid FROM info)
UNION ALL SELECT 1, 'thread', pid, tid, NULL, NULL, 2 * {_TRACK} | (pid << 32) | tid, {_TRACK} | pid, threadName, NULL, NULL, NULL, NULL, NULL FROM info
UNION ALL SELECT 2, 'track', NULL, NULL, NULL, NULL, 4 * {_TRACK}, NULL, 'AUX loss', NULL, NULL, NULL, NULL, NULL FROM (SELECT count(*) AS n FROM loss) WHERE n > 0
UNION ALL SELECT 3, 'instant', NULL, NULL, NULL, time, 4 * {_TRACK}, NULL, 'AUX loss tid=' || tid || ' cpu=' || cpu || ' flags=0x' || printf('%x', flags), NULL, NULL, NULL, 0, NULL FROM loss
UNION ALL SELECT 4, 'stack', i.pid, t.tid, t.kind, NULL, 3 * {_TRACK} | (t.kind::BIGINT << 56) | (i.pid << 32) | t.tid, 2 * {_TRACK} | (i.pid << 32) | t.tid,
  i.threadName || CASE WHEN t.kind = 1 THEN ' / kernel' ELSE ' / user' END, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT tid, kind FROM fr) t JOIN info i USING (tid)
UNION ALL SELECT 4, CASE WHEN isBegin THEN 'begin' ELSE 'end' END, i.pid, e.tid, e.kind, e.time, 3 * {_TRACK} | (e.kind::BIGINT << 56) | (i.pid << 32) | e.tid, NULL,
  CASE WHEN isBegin THEN n.name END, CASE WHEN isBegin THEN n.function END, CASE WHEN isBegin THEN n.file END, CASE WHEN isBegin THEN n.line END,
  (3 * {_TRACK} | (e.kind::BIGINT << 56) | (i.pid << 32) | e.tid) & 4294967295, e.frameId
FROM eps e JOIN info i USING (tid) LEFT JOIN (
  SELECT l.locationId, CASE WHEN l.locationId = 0 THEN 'Unknown' ELSE coalesce(nullif(d.display, ''), f.fallbackName, 'location:' || l.locationId) END AS name,
   CASE WHEN l.locationId <> 0 THEN d.symbol END AS function, CASE WHEN l.locationId <> 0 THEN d.sourceFileName END AS file,
   CASE WHEN l.locationId <> 0 AND (coalesce(d.symbol, '') <> '' OR coalesce(d.sourceFileName, '') <> '') THEN nullif(CAST(d.sourceLineNumber AS BIGINT), 0) END AS line
  FROM (SELECT DISTINCT locationId FROM fr) l LEFT JOIN disp d ON d.id = l.locationId LEFT JOIN fall f ON f.locationId = l.locationId) n ON n.locationId = e.locationId"""
_EXPORT_NEEDS = ("info", "loss", "fr", "eps", "disp", "fall")


def oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    # sources and sinks
    o["read_branches"] = sql(_FLAT + " WHERE component = 'branches'", "flat")
    o["read_events"] = sql("SELECT pid, tid, component AS eventComponent, count(*) AS rows, max(id) AS lastId FROM flat GROUP BY ALL", "flat")
    o["read_source_locations"] = sql("SELECT id, nullif(dso, '') AS dso, relativeAddress, symbol, sourceFileName, CAST(sourceLineNumber AS BIGINT) AS sourceLineNumber FROM loc", "loc")
    loss_rows = "SELECT id, time, pid, tid, cpu, CAST(flags AS BIGINT) AS flags FROM loss"
    o["read_aux_loss"] = o["write_aux_loss"] = sql(loss_rows, "loss")
    o["loss_id"] = sql("SELECT seq, time, pid, tid, cpu, CAST(flags AS BIGINT) AS flags, id FROM loss", "loss")
    frames = sql(f"SELECT {_FRAME} FROM fr", "fr")
    o["read_stack_frames"] = o["write_stack_frames"] = o["normalize_depths"] = frames
    o["read_symbol_table"] = sql("SELECT dso, address, name FROM symtab", "symtab")
    o["read_line_table"] = sql("SELECT dso, address, file, line FROM linetab", "linetab")
    o["parse_sampled_stacks"] = sql("""
SELECT time, array_to_string(list_reverse(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1])), '>') AS fullStack,
       array_to_string(list_reverse(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1])), '>') AS stack
FROM (SELECT *, list_filter(l, lambda x: x = 'main' OR TRY_CAST(substr(x, 3) AS INTEGER) % 2 = 0) AS w FROM (
  SELECT time, [CASE WHEN b % 7 = 0 THEN 'main' WHEN b % 7 <> 6 THEN 'fn' || b ELSE '[unknown]' END,
                CASE WHEN a % 7 = 0 THEN 'main' WHEN a % 7 <> 6 THEN 'fn' || a ELSE '[unknown]' END, 'main', '_start'] AS l
  FROM (SELECT ev.*, ((tid * 8 + k % 40) % n) // 4 AS a, ((tid * 8 + (k * 3) % 40) % n) // 4 AS b
        FROM ev, (SELECT count(*) AS n FROM part))))""", "ev")
    o["read_metric_snapshots"] = sql("""
SELECT seq, seq + 1 AS totalEvents, value AS currentRate, CASE WHEN longForm THEN 1704067200000000000 ELSE -1 END AS firstNs,
  CASE WHEN longForm THEN time ELSE -1 END AS lastNs, CAST(1 AS BIGINT) AS files, file, seq AS flushed, status, CASE WHEN longForm THEN event_type END AS stage,
  CASE WHEN longForm THEN elapsedMs END AS elapsedMs, CASE WHEN longForm THEN 99 - k END AS resolvedDepth FROM snaps""", "snaps")
    o["read_stack_ranges"] = sql("SELECT startTrace, endTrace FROM fr", "fr")
    o["write_stack_ranges"] = sql("SELECT startTrace, count(*) AS ranges, max(endTrace) AS lastTrace FROM fr GROUP BY startTrace", "fr")
    o["write_samples"] = sql("SELECT pid, tid, component AS eventComponent, id, perfId, event FROM flat", "flat")
    o["write_source_locations"] = sql("""
SELECT id, relativeAddress, sym AS symbol, CAST(CASE WHEN buildId <> '' THEN 2 WHEN dso <> '' THEN 1 ELSE 0 END AS BIGINT) AS keyStrength FROM dim""", "dim")
    o["write_trace_events"] = sql(f"SELECT event, count(*) AS events, coalesce(min(timestamp), -1) AS first, coalesce(max(timestamp), -1) AS last FROM ({_EXPORT}) GROUP BY event", *_EXPORT_NEEDS)
    o["write_quality_csv"] = sql(f"""
SELECT variant, path, sourceLocs AS source_locs, sourceWithDso AS source_with_dso, sourceWithSymbol AS source_with_symbol, sourceWithSourceLine AS source_with_source_line,
  branchFiles AS branch_files, branchRows AS branch_rows, addressEndpoints AS address_endpoints, endpointsWithLocationId AS endpoints_with_location_id,
  endpointsWithDso AS endpoints_with_dso, endpointsWithSymbol AS endpoints_with_symbol, endpointsWithSourceLine AS endpoints_with_source_line,
  locationIdsMissing AS location_ids_missing_from_source_table, distinctAddresses AS distinct_addresses, distinctWithDso AS distinct_with_dso,
  distinctWithSymbol AS distinct_with_symbol, distinctWithSourceLine AS distinct_with_source_line FROM ({_report('a,"b"', '/traces/a,"b"')})""", "epq")
    o["write_quality_markdown"] = sql(f"""
SELECT '| Variant | Source locs | Source lines | Source line % | Branch rows | Address endpoints | Endpoint symbols | Symbol % | Endpoint source lines | Source line % | Distinct addresses | Distinct symbols | Distinct source lines |' AS value
UNION ALL SELECT '|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|---:|---:|---:|'
UNION ALL SELECT '| ' || concat_ws(' | ', variant, sourceLocs, sourceWithSourceLine, {_percent('sourceWithSourceLine', 'sourceLocs')}, branchRows, addressEndpoints,
  endpointsWithSymbol, {_percent('endpointsWithSymbol', 'addressEndpoints')}, endpointsWithSourceLine, {_percent('endpointsWithSourceLine', 'addressEndpoints')},
  distinctAddresses, distinctWithSymbol, distinctWithSourceLine) || ' |' FROM ({_report('all', '/traces/all')})""", "epq")
    o["sampled_stack_report"] = sql("""
SELECT stack, count(*) AS samples, arg_min(ids, sampleId) AS frameIds FROM (
  SELECT s.sampleId, array_to_string(s.symbols, ' -> ') AS stack,
    (SELECT string_agg(coalesce(CAST(m.frameId AS VARCHAR), 'missing'), ',' ORDER BY m.position) FROM matched m WHERE m.sampleId = s.sampleId) AS ids
  FROM stk s) GROUP BY stack""", "matched", "stk")
    # projections and filters
    o["flatten_samples"] = sql("""
SELECT id, perfId, pid, tid, time, ip, addr, ipLocationId, addressLocationId, haveAddress, ipSym, addressSym, addressDso, addressBuildId,
  addressSymStart, ipComm, addressComm, 4294967295 AS machinePid, NULL::VARCHAR AS srcFileName, CAST(0 AS BIGINT) AS srcLineNumber FROM flat""", "flat")
    o["gate_branch_target"] = sql("SELECT seq, CASE WHEN haveAddress THEN addr END AS address, addressDso AS dso FROM flat", "flat")
    o["event_component"] = sql("SELECT event, component, count(*) AS rows FROM raw GROUP BY ALL", "raw")
    o["filter_aux_loss"] = sql("SELECT seq, time, pid, tid, cpu, CAST(flags AS BIGINT) AS flags FROM aux WHERE flags <> 0", "aux")
    o["nonzero_endpoints"] = sql("SELECT address, locationId FROM ep WHERE address <> 0", "ep")
    o["union_endpoints"] = sql("SELECT address, locationId FROM ep", "ep")
    o["same_function"] = sql("SELECT seq, sameFunction FROM cl", "cl")
    o["same_function_by_id"] = sql("SELECT seq, ipLocationId = addressLocationId OR (ipLocationId <> 0 AND addressLocationId <> 0 AND sameFunction) AS sameFunctionById FROM cl", "cl")
    o["is_function_entry"] = sql("SELECT seq, isEntry FROM cl", "cl")
    o["classify_branches"] = sql("SELECT seq, isCall, isReturn, isStackCall, isIgnoredCall FROM cl", "cl")
    o["stack_kind"] = sql("SELECT CAST(CASE WHEN cpumode = 2 THEN 0 ELSE 1 END AS BIGINT) AS kind, count(*) AS rows, CAST(sum(time % 1000003) AS BIGINT) AS times FROM sm GROUP BY 1", "sm")
    o["emit_filter"] = sql(f"""
SELECT {_REASON.format(c='endReason')} AS reason, count(*) AS frames, count(*) FILTER (symbol = 'main') AS mains, min(endTime - startTime) AS shortest
FROM rawframes LEFT JOIN loc ON loc.id = locationId GROUP BY 1""", "rawframes", "loc")
    o["symbol_match"] = sql("SELECT locationSymbol, symbol FROM matches", "matches")
    o["endpoint_filter"] = sql("SELECT frameId, endTime FROM fr WHERE endReason IN (2, 3, 4, 5)", "fr")
    o["valid_trace_time"] = sql("SELECT seq, time FROM sm WHERE seq % 2 = 0", "sm")
    # joins
    o["join_branch_locations"] = sql("""
SELECT seq, ipDso, ipSymbol, (SELECT relativeAddress FROM loc WHERE loc.id = ipLocationId) AS ipRelative, addressDso, addressSymbol, addressRelative FROM cl""", "cl")
    o["join_function_entries"] = sql("SELECT seq, entryAddress FROM cl", "cl")
    o["assign_loss_epoch"] = sql("SELECT seq, (SELECT count(*) FROM loss l WHERE l.tid = o.tid AND l.time < o.reached) AS epoch FROM ordered o", "ordered", "loss")
    o["join_endpoint_quality"] = sql("SELECT address, locationId, CAST(quality AS BIGINT) AS quality, isMissing FROM epq", "epq")
    o["join_frame_names"] = sql("""
SELECT f.frameId, n.name, n.function, n.file, n.line FROM fr f JOIN (
  SELECT l.locationId, CASE WHEN l.locationId = 0 THEN 'Unknown' ELSE coalesce(nullif(d.display, ''), b.fallbackName, 'location:' || l.locationId) END AS name,
    d.symbol AS function, d.sourceFileName AS file, CASE WHEN coalesce(d.symbol, d.sourceFileName) IS NOT NULL THEN nullif(CAST(d.sourceLineNumber AS BIGINT), 0) END AS line
  FROM (SELECT DISTINCT locationId FROM fr) l LEFT JOIN disp d ON d.id = l.locationId LEFT JOIN fall b ON b.locationId = l.locationId) n USING (locationId)""", "fr", "disp", "fall")
    o["join_thread_info"] = sql("""
SELECT f.frameId, coalesce(i.pid, 0) AS pid, coalesce(i.threadName, 'Thread ' || f.tid) AS threadName FROM fr f LEFT JOIN info i USING (tid)""", "fr", "info")
    o["resolve_symbol_asof"] = sql("""
SELECT k.lookupId, s.name FROM (SELECT l_orderkey * 8 + l_linenumber AS lookupId, '/lib/d' || (l_suppkey % 3) AS dso, l_partkey * 97 + l_linenumber AS address FROM lineitem) k
ASOF LEFT JOIN symtab s ON s.dso = k.dso AND s.address <= k.address""", "symtab")
    o["resolve_source_line"] = sql("SELECT loc.id, t.file, coalesce(t.line, 0) AS line FROM loc LEFT JOIN linetab t ON t.dso = loc.dso AND t.address = loc.relativeAddress", "loc", "linetab")
    o["sample_frame_containment"] = sql("SELECT sampleId, symbol, frameId FROM alone", "alone")
    o["nested_overlap"] = sql("""
SELECT parent, child, EXISTS (SELECT 1 FROM fbs p JOIN fbs c ON p.symbol = parent AND c.symbol = child AND p.depth < c.depth
    AND (p.startTime, p.startTrace) <= (c.startTime, c.startTrace) AND (c.endTime, c.endTrace) <= (p.endTime, p.endTrace)) AS overlaps
FROM (SELECT DISTINCT symbols[i] AS parent, symbols[i + 1] AS child FROM stk, (VALUES (1), (2)) v(i) WHERE i < len(symbols))""", "fbs", "stk")
    o["sampled_stack_match"] = sql("SELECT sampleId, position, symbol, frameId, chained FROM matched", "matched")
    o["frames_by_symbol"] = sql("SELECT symbol, frameId FROM fbs", "fbs")
    # aggregations
    o["source_stats"] = sql(_SOURCE, "q")
    o["branch_endpoint_stats"] = sql(f"SELECT * FROM ({_FILES.format(where='')}), ({_ENDS.format(where='')})", "epq")
    o["distinct_address_quality"] = sql(_DISTINCT.format(where=""), "epq")
    o["quality_report"] = sql(f"""
SELECT *, {_percent('sourceWithSourceLine', 'sourceLocs')} AS sourceLinePercent, {_percent('endpointsWithSymbol', 'addressEndpoints')} AS symbolPercent,
  {_percent('endpointsWithSourceLine', 'addressEndpoints')} AS endpointLinePercent FROM ({_report('all', '/traces/all')})""", "epq")
    o["function_entries"] = sql("SELECT dso, symbol, entryAddress FROM entries", "entries")
    o["build_source_locations"] = sql("""
SELECT d.id, hex(d.buildId) AS buildId, d.dso, d.relativeAddress, coalesce(s.name, d.sym) AS symbol, part % 4 * 16 AS symbolOffset, g * 64 + 16 AS symbolStart,
  t.file AS sourceFileName, coalesce(t.line, 0) AS sourceLineNumber, CAST(CASE WHEN d.buildId <> '' THEN 2 WHEN d.dso <> '' THEN 1 ELSE 0 END AS BIGINT) AS keyStrength,
  CAST(CASE WHEN part % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS isKernelIp
FROM dim d ASOF LEFT JOIN symtab s ON s.dso = d.dso AND s.address <= d.relativeAddress LEFT JOIN linetab t ON t.dso = d.dso AND t.address = d.relativeAddress""", "dim", "symtab", "linetab")
    o["location_ids_for_samples"] = sql("SELECT seq, ipLocationId, addressLocationId FROM flat", "flat")
    o["reconstruction_summary"] = sql("""
SELECT (SELECT count(*) FROM rawframes) AS frames, (SELECT count(*) FROM cl WHERE isCall) AS calls, (SELECT count(*) FROM cl WHERE isIgnoredCall) AS ignoredCalls,
  (SELECT count(*) FROM cl WHERE isReturn) AS returns, CAST(sum(skipped) AS BIGINT) AS skippedReturns, CAST(sum(ignored) AS BIGINT) AS ignoredReturns,
  CAST(sum(resyncs) AS BIGINT) AS resyncs, CAST(sum(dropped) AS BIGINT) AS droppedFrames, (SELECT count(*) FROM clips) AS traceClips,
  (SELECT count(*) FROM loss WHERE tid IN (SELECT tid FROM br)) AS lossesApplied FROM walk""", "rawframes", "clips")
    o["trace_time_range"] = sql("""
SELECT min(time) AS firstNs, max(time) AS lastNs, max(time) - min(time) AS spanNs,
  ((max(time) - min(time)) // 1000000000) || '.' || lpad(CAST((max(time) - min(time)) % 1000000000 AS VARCHAR), 9, '0') || 's' AS spanText FROM sm""", "sm")
    o["events_per_file"] = sql("SELECT pid, tid, component AS eventComponent, count(*) AS rows FROM raw GROUP BY ALL", "raw")
    o["aux_scan_summary"] = sql("SELECT count(*) AS scanned, count(*) FILTER (flags <> 0) AS losses FROM aux", "aux")
    o["thread_info"] = sql("SELECT tid, pid, threadName FROM info", "info")
    o["thread_comm_chain"] = sql("SELECT tid, threadName FROM info", "info")
    o["fallback_names"] = sql("SELECT locationId, fallbackName FROM fall", "fall")
    o["symbol_frame_stats"] = sql("SELECT w.symbol, count(f.frameId) AS frames, max(f.depth) AS maxDepth FROM want w LEFT JOIN fbs f ON f.symbol = w.symbol GROUP BY w.symbol", "want", "fbs")
    folded = sql("SELECT array_to_string(symbols, ' -> ') AS stack, count(*) AS samples FROM stk GROUP BY 1", "stk")
    o["folded_stack_counts"] = o["top_sampled_stacks"] = folded
    o["call_pairs"] = sql("SELECT DISTINCT symbols[i] AS parent, symbols[i + 1] AS child FROM stk, (VALUES (1), (2)) v(i) WHERE i < len(symbols)", "stk")
    # ordered per-key computations
    o["entry_id"] = sql("SELECT pid, tid, seq, id FROM br", "br")
    o["location_id"] = sql("SELECT id, hex(buildId) AS buildId, dso, relativeAddress FROM dim", "dim")
    o["frame_id"] = sql("SELECT frameId, tid, endTrace, locationId FROM rawframes", "rawframes")
    o["trace_clips"] = sql("SELECT seq, tid FROM clips", "clips")
    o["trace_flag"] = sql("SELECT tid, count(*) AS clips FROM clips GROUP BY tid", "clips")
    o["collapse_consecutive"] = sql("""
SELECT seq, tid, ipComm FROM (SELECT *, lag(ipComm) OVER (PARTITION BY tid ORDER BY CAST(pid AS VARCHAR), id) AS before FROM br WHERE ipComm IS NOT NULL)
WHERE before IS NULL OR before <> ipComm""", "br")
    o["max_open_frames"] = sql("SELECT tid, CAST(max(open) AS BIGINT) AS maxOpen FROM opens GROUP BY tid", "opens")
    o["rate_from_counter"] = sql("""
SELECT seq, event_type AS stage, CASE WHEN us > pus THEN CAST(round_even(greatest(c - pc, 0) / ((us - pus) / 1e6), 0) AS BIGINT) END AS rate FROM (
  SELECT *, lag(us) OVER w AS pus, lag(c) OVER w AS pc FROM (SELECT *, epoch_us(ts) AS us, seq * (1 + k % 2) AS c FROM ev) WINDOW w AS (PARTITION BY event_type ORDER BY us, c))""", "ev")
    o["frame_islands"] = sql("""
SELECT frameId, CAST(sum(CASE WHEN before IS NULL OR startKey >= before THEN 1 ELSE 0 END) OVER (PARTITION BY tid, kind ORDER BY rank) AS BIGINT) AS island FROM (
  SELECT *, max(endKey) OVER (PARTITION BY tid, kind ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM numbered)""", "numbered")
    # stateful
    o["reconstruct_stacks"] = sql(f"SELECT {_FRAME} FROM rawframes", "rawframes")
    o["reconstruct_stacks_split"] = o["reconstruct_stacks"]
    o["fold_order"] = sql("SELECT seq, tid, rn AS position FROM ordered", "ordered")
    o["switch_kind"] = _reasons("startReason = 1")
    o["push_call"] = _reasons("startReason = 0")
    o["pop_return"] = _reasons("endReason = 2")
    o["close_on_loss"] = _reasons("endReason = 4")
    o["close_on_end"] = _reasons("endReason = 5")
    o["sync_caller"] = sql("SELECT tid, CAST(sum(resyncs) AS BIGINT) AS resyncs, CAST(sum(dropped) AS BIGINT) AS droppedFrames FROM walk GROUP BY tid", "walk")
    o["slice_endpoints"] = sql("SELECT frameId, time, trace, depth, isBegin FROM eps", "eps")
    o["trace_event_export"] = sql(f"SELECT * EXCLUDE (section) REPLACE (coalesce(timestamp, -1) AS timestamp, coalesce(parentUuid, -1) AS parentUuid) FROM ({_EXPORT})", *_EXPORT_NEEDS)
    o["union_trace_events"] = sql(f"SELECT CAST(section AS BIGINT) AS section, event, count(*) AS events, count(name) AS named FROM ({_EXPORT}) GROUP BY section, event", *_EXPORT_NEEDS)
    o["check_well_nested"] = sql("""
SELECT tid, count(*) FILTER (NOT isBegin AND (lvl <= 0 OR coalesce(innermost <> frameId, true))) AS violations, CAST(max(open) AS BIGINT) AS maxOpen,
  max(open) >= 512 AS overLimit FROM (
  SELECT *, last_value(CASE WHEN isBegin THEN frameId END IGNORE NULLS) OVER (PARTITION BY tid, lvl ORDER BY rn) AS innermost
  FROM (SELECT *, CASE WHEN isBegin THEN open ELSE open + 1 END AS lvl FROM opens)) GROUP BY tid""", "opens")
    o["check_visible_depths"] = sql(f"""
SELECT frameId, isBegin, depth, visibleDepth, CAST(openBelow AS BIGINT) AS openBelow FROM (
 SELECT *, CASE WHEN depth >= base THEN depth - base ELSE depth END AS visibleDepth, CASE WHEN isBegin THEN open - 1 ELSE open END AS openBelow FROM (
  SELECT *, last_value(CASE WHEN isBegin AND open = 1 THEN depth END IGNORE NULLS) OVER (PARTITION BY tid, kind ORDER BY rn) AS base FROM (
   SELECT *, sum(CASE WHEN isBegin THEN 1 ELSE -1 END) OVER (PARTITION BY tid, kind ORDER BY {_ORDER}) AS open,
     row_number() OVER (PARTITION BY tid, kind ORDER BY {_ORDER}) AS rn
   FROM (SELECT * REPLACE (CASE WHEN frameId % 2 = 0 THEN depth + 1 ELSE depth END AS depth) FROM eps))))
WHERE visibleDepth <> openBelow""", "eps")
    # sorts
    o["order_slice_endpoints"] = sql(f"SELECT row_number() OVER (ORDER BY tid, kind, {_ORDER}) AS position, frameId, isBegin FROM eps", "eps")
    o["order_frames"] = sql("SELECT row_number() OVER (ORDER BY tid, kind, startTime, startTrace, endTime DESC, endTrace DESC, frameId) AS position, frameId FROM fr", "fr")
    o["order_threads"] = sql("SELECT row_number() OVER (ORDER BY pid, tid) AS position, pid, tid FROM info", "info")
    o["order_losses"] = sql("SELECT row_number() OVER (ORDER BY tid, time, id) AS position, tid, time, id FROM loss", "loss")
    o["top_active_files"] = sql("""
SELECT file, max(us) AS lastActivity, split_part(file, '/', 1) AS pidPart, split_part(file, '/', 2) AS tidPart, 'branches.parquet' AS filePart
FROM snaps GROUP BY file ORDER BY 2 DESC, 1 LIMIT 16""", "snaps")
    o["first_frames_per_symbol"] = sql("SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY startTime, frameId) AS rank, frameId FROM fbs) WHERE rank <= 12", "fbs")
    # set operations
    o["union_variants"] = sql(" UNION ALL ".join(_report(t, "/traces/error/" if t == "error" else f"/traces/{t}", f" WHERE event_type = '{t}'") for t in ("click", "view", "error", "purchase", "signup")), "epq")
    # scalars
    o["utf8_or_null"] = sql("SELECT id, nullif(buildId, '') AS text FROM loc", "loc")
    o["display_name"] = sql("SELECT id, display AS name FROM disp", "disp")
    o["event_name"] = sql("SELECT locationId, name FROM eventnames", "eventnames")
    o["source_location_struct"] = sql("""
SELECT id, coalesce(symbol, '') = '' AND coalesce(sourceFileName, '') = '' AS isNull, symbol AS function, sourceFileName AS file,
  CASE WHEN coalesce(symbol, '') <> '' OR coalesce(sourceFileName, '') <> '' THEN nullif(CAST(sourceLineNumber AS BIGINT), 0) END AS line FROM loc""", "loc")
    o["track_uuid"] = sql(f"""
SELECT *, stack & 4294967295 AS sequence FROM (SELECT DISTINCT pid, tid, kind, {_TRACK} | pid AS process, 2 * {_TRACK} | (pid << 32) | tid AS thread,
  3 * {_TRACK} | (kind << 56) | (pid << 32) | tid AS stack FROM (SELECT *, CAST(CASE WHEN cpumode = 2 THEN 0 ELSE 1 END AS BIGINT) AS kind FROM sm))""", "sm")
    o["track_names"] = sql("""
SELECT DISTINCT pid, event_type, CAST(CASE WHEN cpumode = 2 THEN 0 ELSE 1 END AS BIGINT) AS kind, CASE WHEN pid = 0 THEN 'Unknown process' ELSE 'Process ' || pid END AS process,
  event_type || CASE WHEN cpumode = 2 THEN ' / user' ELSE ' / kernel' END AS stack FROM sm""", "sm")
    o["loss_marker_name"] = sql("SELECT id, 'AUX loss tid=' || tid || ' cpu=' || cpu || ' flags=0x' || printf('%x', CAST(flags * 6148914691236517205::HUGEINT AS UBIGINT)) AS name FROM loss", "loss")
    o["quality_bits"] = sql("SELECT id, CAST(quality AS BIGINT) AS quality FROM q", "q")
    o["percent_text"] = sql(f"SELECT tid, {_percent('count(*) FILTER (k > 90)', 'count(*) FILTER (k > 50)')} AS percent FROM sm GROUP BY tid", "sm")
    o["key_strength"] = sql("SELECT id, CAST(CASE WHEN buildId <> '' THEN 2 WHEN dso <> '' THEN 1 ELSE 0 END AS BIGINT) AS strength FROM loc", "loc")
    o["partition_value"] = sql("SELECT seq, pid, CASE WHEN k % 2 = 0 THEN tid END AS tid FROM sm", "sm")
    o["split_file_key"] = sql("""
SELECT seq, CASE WHEN k % 3 = 0 THEN '-' ELSE 'pid=' || pid END AS pidPart, CASE WHEN k % 3 = 0 THEN '-' ELSE 'tid=' || tid END AS tidPart,
  CASE WHEN k % 3 = 0 THEN 'source_locations.parquet' ELSE 'branches.parquet' END AS filePart FROM sm""", "sm")
    o["format_trace_time"] = sql("""
SELECT seq, CASE WHEN k % 5 = 0 THEN '-' ELSE CAST(floor(v / 1e9) AS BIGINT) || '.' || lpad(CAST(((v % 1000000000) + 1000000000) % 1000000000 AS VARCHAR), 9, '0') || 's' END AS text
FROM (SELECT *, (k - 50) * 1234567890 AS v FROM sm)""", "sm")
    o["parse_trace_time"] = sql("""
SELECT seq, CASE WHEN k % 9 <> 0 THEN seq * 1000000000 + CASE WHEN k % 2 = 0 THEN k * 1000000 + 123456 ELSE k * 1000000 END END AS ns FROM sm""", "sm")
    o["strip_symbol_offset"] = sql("SELECT seq, CASE WHEN k % 4 <> 0 THEN event_type END AS symbol FROM sm", "sm")
    o["flag_names"] = sql("""
SELECT seq, 'BRANCH' || CASE WHEN flags & 2 <> 0 THEN '|CALL' ELSE '' END || CASE WHEN flags & 4 <> 0 THEN '|RETURN' ELSE '' END
  || CASE WHEN flags & 256 <> 0 THEN '|TRACE_BEGIN' ELSE '' END || CASE WHEN flags & 512 <> 0 THEN '|TRACE_END' ELSE '' END AS names FROM sm""", "sm")
    o["enum_labels"] = sql(f"SELECT frameId, {_REASON.format(c='startReason')} AS started, {_REASON.format(c='endReason')} AS ended, CASE kind WHEN 0 THEN 'User' ELSE 'Kernel' END AS kind FROM fr", "fr")
    # telemetry
    o["overall_rate"] = sql("""
SELECT max_by(seq + 1, us) AS events, CAST(round_even(max_by(seq + 1, us) / ((max(us) - min(us)) / 1e6), 0) AS BIGINT) AS overallRate FROM snaps""", "snaps")
    o["rate_history_1m"] = sql("""
SELECT seq, count(*) OVER w AS points, round(avg(value) OVER w, 6) AS meanRate, max(value) OVER w AS peakRate FROM (SELECT *, epoch_us(ts) AS us FROM ev)
WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""", "ev")
    o["file_status_stream"] = sql("""
SELECT file, status, buffered, flushed, CASE WHEN status = 'CLOSED' THEN 0 ELSE coalesce(lastRate, 0) END AS rate FROM (
  SELECT file, max_by(status, us) AS status, max_by(k, us) AS buffered, max_by(seq, us) AS flushed, max_by(rate, us) FILTER (rate IS NOT NULL) AS lastRate,
    max(us) FILTER (status = 'CLOSED') AS closedAt FROM filerates GROUP BY file)
WHERE NOT (status = 'CLOSED' AND (SELECT max(us) FROM snaps) - closedAt > 86400000000)""", "filerates")
    o["pipeline_bottleneck"] = sql("""
SELECT us AS observed, CASE WHEN pace > 0 THEN event_type END AS stage, CASE WHEN pace > 0 THEN round(pace, 6) END AS msPerSecond FROM (
  SELECT *, CASE WHEN us > pus THEN greatest(elapsedMs - pe, 0) / ((us - pus) / 1e6) ELSE 0 END AS pace FROM (
    SELECT *, lag(us) OVER (PARTITION BY event_type ORDER BY us) AS pus, lag(elapsedMs) OVER (PARTITION BY event_type ORDER BY us) AS pe FROM snaps WHERE longForm))""", "snaps")
    o["queue_depths"] = sql("""
SELECT 'pending' AS queue, max_by(k, us) AS depth, CAST(512 AS BIGINT) AS capacity FROM snaps WHERE longForm
UNION ALL SELECT 'resolved', max_by(99 - k, us), 512 FROM snaps WHERE longForm""", "snaps")
    o["downsample_history"] = sql("""
SELECT b AS bucket, round(avg(value), 6) AS mean, count(*) AS points FROM (
  SELECT v.b, e.value FROM (SELECT count(*) AS n FROM ev), range(97) v(b) JOIN ev e ON e.seq >= v.b * n // 97 AND e.seq < (v.b + 1) * n // 97) GROUP BY b""", "ev")
    o["stream_event_totals"] = sql("SELECT epoch_us(date_trunc('hour', ts)) AS start, count(*) AS events FROM ev GROUP BY 1", "ev")
    # streams
    o["stream_ingest_samples"] = sql("SELECT pid, tid, id, perfId, ipLocationId, addressLocationId FROM flat", "flat")
    single = "SELECT * REPLACE (tid * 100 + pid AS tid) FROM ({0})"
    o["stream_reconstruct_stacks"] = sql("""
SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY frameId) AS n, depth, startTime, endTime, startTrace, endTrace, locationId, startCpu, endCpu
FROM rawframes""", "rawframes", swap={"cl": single, "loss": single})
    o["stream_file_status"] = sql("""
SELECT file, status, seq AS flushed, CASE WHEN status = 'CLOSED' OR pus IS NULL THEN 0 ELSE rate END AS rate, us AS observed FROM filerates""", "filerates")
    o["stream_rate_history"] = sql("""
SELECT event_type AS stage, us AS observed, CAST(round(value, 6) AS DOUBLE) AS value, count(*) OVER w AS points, round(avg(value) OVER w, 6) AS meanRate, CAST(round(max(value) OVER w, 6) AS DOUBLE) AS peakRate
FROM (SELECT *, epoch_us(ts) AS us FROM ev) WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""", "ev")
    o["stream_rate_totals"] = sql("SELECT epoch_us(date_trunc('hour', ts)) AS start, count(*) AS events, round(count(*) / 3600.0, 9) AS rate FROM ev GROUP BY 1", "ev")
    return o
