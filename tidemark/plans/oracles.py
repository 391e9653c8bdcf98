"""The same queries as SQL."""

TRACE = """
trace AS (SELECT user_id AS stream_id, epoch_us(ts) / 3.6e9::DOUBLE AS t, event_id AS seq, value AS score, coalesce(event_type = 'error', false) AS disturbed
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))"""


def noise(name: str, source: str, keys: str, q: float) -> str:
    return f"""
{name}_b AS (SELECT {keys}, count(score) AS n, quantile_cont(score, {q}) AS base FROM {source} GROUP BY {keys}),
{name}_s AS (SELECT {keys}, 1.4826::DOUBLE * median(abs(score - base)) AS sigma FROM {source} JOIN {name}_b USING ({keys}) WHERE score <= base GROUP BY {keys}),
{name} AS (SELECT {keys}, n, base, CASE WHEN n < 2 THEN 0 ELSE coalesce(sigma, 0) END AS sigma FROM {name}_b LEFT JOIN {name}_s USING ({keys}))"""


def levels(name: str, source: str, enter: float, exit_: float, floor: float) -> str:
    return f"""
{name} AS (SELECT *, least(enter, greatest({floor / 2}::DOUBLE, base + {exit_}::DOUBLE * sigma)) AS exit FROM (SELECT *, greatest({floor}::DOUBLE, base + {enter}::DOUBLE * sigma) AS enter FROM {source}))"""


def active(name: str, source: str, keys: str, dense: bool) -> str:
    start, end = ("t", "prev") if dense else ("prev", "t")
    w = f"PARTITION BY {keys} ORDER BY t, seq"
    return f"""
{name}_1 AS (SELECT *, coalesce(lag(t) OVER ({w}), t) AS prev, max(t) OVER (PARTITION BY {keys}) AS lst FROM {source}),
{name}_2 AS (SELECT *, coalesce(last_value(CASE WHEN score >= enter THEN 1 WHEN score < exit THEN 0 END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING), 0) AS st FROM {name}_1 WHERE NOT disturbed),
{name}_3 AS (SELECT *, coalesce(lag(st) OVER ({w}), 0) AS was FROM {name}_2),
{name}_4 AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS island FROM {name}_3),
{name} AS (SELECT {keys}, min(CASE WHEN st = 1 AND was = 0 THEN {start} END) AS "start", coalesce(min(CASE WHEN st = 0 AND was = 1 THEN {end} END), max(lst)) AS "end"
  FROM {name}_4 WHERE st = 1 OR was = 1 GROUP BY {keys}, island)"""


def bridged(name: str, source: str, keys: str, gap: float) -> str:
    w = f'PARTITION BY {keys} ORDER BY "start", "end"'
    return f"""
{name}_1 AS (SELECT *, CASE WHEN "start" - max("end") OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_i AS (SELECT *, sum(fresh) OVER ({w} ROWS UNBOUNDED PRECEDING) AS island FROM {name}_1),
{name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM {name}_i GROUP BY {keys}, island)"""


S = "stream_id"
LEVELS = TRACE + "," + noise("stats", "trace", S, 0.5) + "," + levels("lev", "stats", 6.0, 3.0, 0.004) + ",\nlt AS (SELECT trace.*, enter, exit FROM trace JOIN lev USING (stream_id))"
COARSE = LEVELS + "," + active("act", "lt", S, False) + "," + bridged("bri", "act", S, 48.0) + ',\ncand AS (SELECT * FROM bri WHERE "end" - "start" >= 1.0)'
DENSE = LEVELS + "," + active("dact", "lt", S, True)
PEAKS = """
{n}_p AS (SELECT c.stream_id, c."start", c."end", coalesce(max(score), 0) AS peak FROM {c} c LEFT JOIN trace ON c.stream_id = trace.stream_id AND t BETWEEN c."start" AND c."end" GROUP BY ALL),
{n} AS (SELECT stream_id, "start", "end", peak, n > {k} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY peak DESC, "start") AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM {n}_p) WHERE r <= {k})"""
W = "stream_id, window_id"
WINDOWS = (
    COARSE
    + ","
    + PEAKS.format(n="top", c="cand", k=200)
    + """,
win AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "end") AS window_id, "start" AS c_start, "end" AS c_end, greatest(fst, "start" - 72.0) AS w_start, least(lst, "end" + 72.0) AS w_end
  FROM top JOIN (SELECT stream_id, min(t) AS fst, max(t) AS lst FROM trace GROUP BY 1) USING (stream_id))"""
)
REFINED = (
    WINDOWS
    + """,
ins AS (SELECT trace.*, window_id, c_start, c_end, w_start, w_end FROM trace JOIN win ON trace.stream_id = win.stream_id AND t BETWEEN w_start AND w_end),"""
    + noise("fs", "ins", W, 0.25)
    + ","
    + levels("fl", "fs", 4.0, 2.0, 0.0015)
    + """,
gaps AS (SELECT stream_id, window_id, t - lag(t) OVER (PARTITION BY stream_id, window_id ORDER BY t, seq) AS step FROM ins),
spc AS (SELECT stream_id, window_id, (list_sort(list(step)))[(count(*) // 2 + 1)::INT] AS spacing FROM gaps WHERE step IS NOT NULL GROUP BY 1, 2),
fin AS (SELECT ins.*, enter, exit FROM ins JOIN fl USING (stream_id, window_id)),"""
    + active("fa", "fin", W, True)
    + ","
    + bridged("fb", "fa", W, 12.0)
    + """,
tou AS (SELECT fb.*, w_start, w_end, enter, n, spacing FROM fb JOIN win USING (stream_id, window_id) JOIN fl USING (stream_id, window_id) LEFT JOIN spc USING (stream_id, window_id)
  WHERE "end" - "start" >= 0.0 AND "start" <= c_end AND c_start <= "end"),
ev AS (SELECT t.stream_id, t.window_id, t."start", t."end", t.w_start, t.w_end, t.enter, t.spacing, t.n, coalesce(max(score), 0) AS peak, coalesce(sum(round_even(score * 100, 0)::BIGINT)::DOUBLE / 100 / count(score), 0) AS mean,
    count(score) AS held, count(*) FILTER (WHERE score >= t.enter) AS active
  FROM tou t LEFT JOIN ins ON t.stream_id = ins.stream_id AND t.window_id = ins.window_id AND ins.t BETWEEN t."start" AND t."end" GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9),
shp AS (SELECT stream_id, window_id, avg(disturbed::INT::DOUBLE) AS disturbed_ratio, max(score) AS most, sum(round_even(score * 100, 0)::BIGINT)::DOUBLE / 100 / count(score) AS average FROM ins GROUP BY 1, 2),
ev2 AS (SELECT ev.*, n AS samples, disturbed_ratio, "start" - w_start <= coalesce(spacing, 0) AS clipped_start, w_end - "end" <= coalesce(spacing, 0) AS clipped_end FROM ev JOIN shp USING (stream_id, window_id) WHERE n >= 3),
ref AS (SELECT stream_id, window_id, "start", "end", peak, mean, enter, samples, active, disturbed_ratio, clipped_start, clipped_end,
    greatest(0.05::DOUBLE, least(0.99::DOUBLE, 0.45::DOUBLE + 0.30::DOUBLE * greatest(0, least(1, (peak - enter) / greatest(enter, 1e-6::DOUBLE))) + 0.25::DOUBLE * active / greatest(held, 1)
      - CASE WHEN clipped_start OR clipped_end THEN 0.15::DOUBLE ELSE 0 END - 0.30::DOUBLE * disturbed_ratio)) AS confidence FROM ev2
  UNION ALL SELECT stream_id, window_id, c_start, c_end, coalesce(most, 0), coalesce(average, 0), 0, coalesce(n, 0), 0, coalesce(disturbed_ratio, 0), true, true, 0.35 FROM win LEFT JOIN fl USING (stream_id, window_id) LEFT JOIN shp USING (stream_id, window_id) WHERE coalesce(n, 0) < 3)"""
)
EVENT = 'struct_pack(s := "start", e := "end", i := window_id, peak := peak::DOUBLE, mean := mean::DOUBLE, enter := enter::DOUBLE, samples := samples::BIGINT, active := active::BIGINT, dist := disturbed_ratio::DOUBLE, cs := clipped_start, ce := clipped_end, conf := confidence::DOUBLE)'
MERGED = (
    REFINED
    + ","
    + bridged("mb", "ref", S, 0.0)
    + f""",
ml AS (SELECT stream_id, list({EVENT} ORDER BY "start", "end", window_id) AS l FROM mb_i GROUP BY stream_id, island),
mr AS (SELECT stream_id, list_reduce(l, lambda a, b: struct_pack(s := a.s, e := greatest(a.e, b.e), i := a.i, peak := greatest(a.peak, b.peak), mean := (a.mean + b.mean) / 2, enter := CASE WHEN b.conf > a.conf THEN b.enter ELSE a.enter END,
    samples := a.samples + b.samples, active := a.active + b.active, dist := greatest(a.dist, b.dist), cs := a.cs, ce := b.ce, conf := greatest(a.conf, b.conf))) AS r FROM ml),
mer AS (SELECT stream_id, r.s AS "start", r.e AS "end", r.peak AS peak, r.mean AS mean, r.enter AS enter, r.samples AS samples, r.active AS active, r.dist AS disturbed_ratio, r.cs AS clipped_start, r.ce AS clipped_end, r.conf AS confidence FROM mr)"""
)


def pauses(name: str, source: str, idle: float) -> str:
    w = 'PARTITION BY stream_id ORDER BY "start", "end"'
    return f"""
{name} AS (SELECT stream_id, e AS "start", nxt AS "end", greatest(0.05::DOUBLE, least(0.95::DOUBLE, sure)) AS confidence
  FROM (SELECT stream_id, "end" AS e, lead("start") OVER ({w}) AS nxt, least(confidence, lead(confidence) OVER ({w})) AS sure FROM {source}) WHERE nxt - e >= {idle})"""


EVENTS = (
    MERGED
    + ","
    + pauses("pau", "mer", 96.0)
    + """,
evt AS (SELECT stream_id, CASE WHEN "end" - "start" > 40.0 THEN 'unusually long run' ELSE 'activity' END AS label, "start", "end", confidence, CASE WHEN confidence >= 0.6::DOUBLE THEN 'confirmed' ELSE 'review' END AS status,
    concat_ws(' | ', CASE WHEN clipped_start THEN 'start may be earlier' END, CASE WHEN clipped_end THEN 'end may be later' END, CASE WHEN disturbed_ratio > 0.05::DOUBLE THEN 'partly disturbed' END) AS notes FROM mer
  UNION ALL SELECT stream_id, 'extended pause', "start", "end", confidence, CASE WHEN confidence >= 0.6::DOUBLE THEN 'confirmed' ELSE 'review' END, '' FROM pau)"""
)
PLAN = (
    TRACE
    + """,
fil AS (SELECT stream_id, count(*) AS n, min(t) AS first, max(t) AS last FROM trace GROUP BY 1),
pl1 AS (SELECT *, (n - 1) / (last - first) AS fps FROM fil WHERE last > first),
pl2 AS (SELECT *, greatest(greatest(4.0::DOUBLE, least(48.0::DOUBLE, 60.0::DOUBLE / 3)), 1 / fps) AS interval FROM pl1),
pl3 AS (SELECT *, greatest(1, round_even(interval * fps, 0)::BIGINT) AS step FROM pl2),
plan AS (SELECT *, floor((last - first) / (step / fps))::BIGINT + 1 AS samples FROM pl3),
sta AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS frame, round_even(t * 1000, 0) + 0.0 AS pts_ms FROM trace)"""
)


def persistent(name: str, source: str, cond: str, hold: float, order: str) -> str:
    return f"""
{name}_1 AS (SELECT *, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS {name}_run FROM {source}),
{name}_2 AS (SELECT *, CASE WHEN {cond} THEN min(CASE WHEN {cond} THEN t END) OVER (PARTITION BY stream_id, {name}_run) END AS {name}_start FROM {name}_1),
{name} AS (SELECT *, coalesce(t - {name}_start >= {hold}, false) AS {name}_fires FROM {name}_2)"""


FLOW = (
    TRACE
    + """,
f0 AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) AS pos, NOT disturbed AS ok, NOT disturbed AND score >= 60.0 AS at_outlet,
    NOT disturbed AND coalesce(CASE WHEN seq % 5 = 0 THEN score > 20 END, score >= 60.0) AS present, (seq % 7)::DOUBLE AS contrast, (1 + seq % 3)::DOUBLE AS noise FROM trace),"""
    + persistent("o", "f0", "at_outlet", 12.0, "t, seq")
    + """,
f1 AS (SELECT *, min(CASE WHEN o_fires THEN pos END) OVER (PARTITION BY stream_id) AS c_pos FROM o),
f2 AS (SELECT *, max(CASE WHEN pos = c_pos THEN o_start END) OVER (PARTITION BY stream_id) AS flow_start, coalesce(pos > c_pos, false) AND ok AND NOT present AS absent FROM f1),"""
    + persistent("g", "f2", "absent", 30.0, "t, seq")
    + """,
f3 AS (SELECT *, min(CASE WHEN g_fires THEN pos END) OVER (PARTITION BY stream_id) AS e_pos FROM g),
ph AS (SELECT *, pos > c_pos AS aft FROM f3 WHERE e_pos IS NULL OR pos <= e_pos),
brk AS (SELECT stream_id, frm AS "start", t AS "end" FROM (SELECT *, lag(CASE WHEN absent THEN g_start END) OVER (PARTITION BY stream_id ORDER BY pos) AS frm FROM ph) WHERE present AND t - frm >= 10.0),
m1 AS (SELECT *, sum(CASE WHEN ok AND NOT at_outlet THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS mrun,
    coalesce(max(CASE WHEN aft AND present THEN pos END) OVER (PARTITION BY stream_id), c_pos) AS last_pos FROM ph),
m2 AS (SELECT *, max(CASE WHEN pos = c_pos THEN mrun END) OVER (PARTITION BY stream_id) AS crun FROM m1),
m3 AS (SELECT stream_id, max(flow_start) AS "start", max(CASE WHEN pos = last_pos THEN t END) AS "end", max(e_pos) IS NOT NULL AS end_confirmed, count(*) AS frames, count(*) FILTER (WHERE present) AS with_liquid,
    count(*) FILTER (WHERE disturbed) AS disturbed, count(*) FILTER (WHERE aft AND ok) - CASE WHEN max(e_pos) IS NOT NULL THEN count(*) FILTER (WHERE absent AND pos > last_pos) ELSE 0 END AS timed,
    count(*) FILTER (WHERE aft AND present) AS timed_with_liquid, coalesce(avg(CASE WHEN at_outlet AND mrun = crun AND pos <= c_pos THEN score END) / 60.0::DOUBLE - 1, 0) AS start_margin,
    coalesce(avg(CASE WHEN present AND contrast <> 0 THEN contrast END), 0) AS contrast, coalesce(avg(noise), 0) AS noise FROM m2 GROUP BY 1),
flo AS (SELECT m3.*, coalesce(b.k, 0)::BIGINT AS breaks FROM m3 LEFT JOIN (SELECT stream_id, count(*) AS k FROM brk GROUP BY 1) b USING (stream_id)),
j1 AS (SELECT *, greatest(0, "end" - "start") AS efflux, CASE WHEN timed > 0 THEN timed_with_liquid / timed ELSE 0 END::DOUBLE AS continuity FROM flo),
j2 AS (SELECT *, 0.35::DOUBLE + 0.2::DOUBLE * greatest(0, least(1, start_margin)) + 0.2::DOUBLE * greatest(0, least(1, continuity)) + 0.15::DOUBLE * greatest(0, least(1, contrast / greatest(noise, 1e-6::DOUBLE) / 8))
    + CASE WHEN breaks <= 1 THEN 0.1::DOUBLE ELSE 0 END - 0.35::DOUBLE * disturbed / greatest(1, frames) AS c0 FROM j1),
j3 AS (SELECT *, CASE WHEN end_confirmed THEN c0 ELSE least(0.5::DOUBLE, c0) END AS c1 FROM j2),
j4 AS (SELECT *, CASE WHEN "start" IS NULL OR "end" IS NULL THEN 0 ELSE greatest(0, least(0.98::DOUBLE, CASE WHEN efflux > 0 AND efflux < 24 THEN least(0.45::DOUBLE, c1) ELSE c1 END)) END AS confidence FROM j3),
jud AS (SELECT *, CASE WHEN "start" IS NULL OR "end" IS NULL OR confidence < 0.4::DOUBLE THEN 'failed' WHEN confidence < 0.7::DOUBLE OR NOT end_confirmed THEN 'review' ELSE 'confirmed' END AS status FROM j4)"""
)
TIMING_RULES = """
ws AS (SELECT DISTINCT stream_id, n, first * 0 AS z, round_even(i * (greatest(0, n - 40) / 4.0::DOUBLE), 0)::BIGINT AS w_start FROM fil, range(0, 5) g(i)),
sb AS (SELECT stream_id, min(pts_ms) AS p0, max(pts_ms) AS p1 FROM sta GROUP BY 1),
iv AS (SELECT ws.stream_id, n, w_start, pts_ms - lag(pts_ms) OVER (PARTITION BY ws.stream_id, w_start ORDER BY frame) AS gap,
    CASE WHEN frame = w_start THEN pts_ms - p0 - frame * ((p1 - p0) / (n - 1)) END AS off FROM sta JOIN ws ON sta.stream_id = ws.stream_id AND frame >= w_start AND frame < w_start + 40 JOIN sb ON sb.stream_id = sta.stream_id),
md AS (SELECT stream_id, n, w_start, count(*) AS k, median(gap) AS med FROM iv WHERE gap > 0 GROUP BY 1, 2, 3),
us AS (SELECT md.stream_id, md.w_start, k, med, count(*) FILTER (WHERE abs(gap - med) > 0.5 * med) AS irr FROM md JOIN iv ON md.stream_id = iv.stream_id AND md.w_start = iv.w_start AND gap > 0 WHERE k >= 20 GROUP BY 1, 2, 3, 4),
ov AS (SELECT stream_id, median(med) AS overall FROM us GROUP BY 1),
ag AS (SELECT us.stream_id, overall, count(*) AS usable, max(k) AS most, max(irr / k) AS irr, max(abs(med - overall)) AS drift FROM us JOIN ov USING (stream_id) GROUP BY 1, 2),
sp AS (SELECT stream_id, n, count(off) AS offs, max(off) - min(off) AS spread FROM iv GROUP BY 1, 2),
ver AS (SELECT stream_id, n, coalesce(usable, 0)::BIGINT AS usable, CASE WHEN n <= 21 THEN 'too_short_to_matter' WHEN usable IS NULL THEN 'no_usable_timestamps' WHEN usable < 2 AND (most + 1) * 2 < n THEN 'unrepresentative_sample'
    WHEN irr > 0.1::DOUBLE THEN 'irregular_within_window' WHEN overall > 0 AND drift > 0.15::DOUBLE * overall THEN 'rate_changes_between_windows' WHEN offs >= 2 AND spread > 2000000.0 THEN 'timing_drift' ELSE 'constant' END AS reason
  FROM sp LEFT JOIN ag USING (stream_id))"""
TIMING = PLAN + "," + TIMING_RULES
RULE_STAMPS = (
    PLAN.replace("sta AS (", "sta0 AS (").replace("fil AS (", "fil0 AS (").replace("FROM fil WHERE", "FROM fil0 WHERE")
    + """,
sta AS (SELECT stream_id, frame, CASE stream_id % 7 WHEN 2 THEN 0 WHEN 3 THEN 40.0 * least(frame, 22) WHEN 4 THEN 100.0 * frame - CASE WHEN frame % 2 = 1 THEN 60 ELSE 0 END
    WHEN 5 THEN 40.0 * least(frame, 33) + 60.0 * (frame - least(frame, 33)) WHEN 6 THEN 40.0 * least(frame, 33) + 45.0 * (frame - least(frame, 33)) ELSE 40.0 * frame END::DOUBLE AS pts_ms
  FROM sta0 WHERE stream_id % 7 <> 1 OR frame < 15),
fil AS (SELECT stream_id, count(*) AS n, min(pts_ms) AS first, max(pts_ms) AS last FROM sta GROUP BY 1),"""
    + TIMING_RULES.replace("spread > 2000000.0", "spread > 50.0")
)
STARTS = """
rec AS (SELECT DISTINCT stream_id, CASE WHEN stream_id % 3 <> 0 THEN TIMESTAMP '2024-02-28 23:59:58' + to_seconds(stream_id * 3661) END AS recording_start FROM trace),
exp AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "end", label) AS number, label AS event, @A@ AS start_video_time, @B@ AS end_video_time,
    round_even("end" - "start", 3) AS duration_s, coalesce(strftime(recording_start + to_microseconds(round_even("start" * 1000000, 0)::BIGINT), '%Y-%m-%d %H:%M:%S'), '') AS start_wall_clock,
    coalesce(strftime(recording_start + to_microseconds(round_even("end" * 1000000, 0)::BIGINT), '%Y-%m-%d %H:%M:%S'), '') AS end_wall_clock, round_even(confidence * 100, 0)::INT AS confidence_pct,
    CASE status WHEN 'confirmed' THEN 'detected' WHEN 'review' THEN 'needs review' ELSE 'failed' END AS status, 'activity' AS detector, notes
  FROM (SELECT *, round_even("start" * 1000, 0)::BIGINT AS a, round_even("end" * 1000, 0)::BIGINT AS b FROM evt) JOIN rec USING (stream_id))"""
WALK = """
fr AS (SELECT stream_id, frame_index, NOT disturbed AND NOT (stream_id % 5 = 0 AND frame_index BETWEEN 10 AND 50) AS readable
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS frame_index FROM trace))"""
REASONS = """SELECT stream_id, CASE WHEN "start" IS NULL THEN 'No liquid stream was detected at the outlet.' WHEN "end" IS NULL THEN 'Flow started but no end of flow could be determined.'
  WHEN found = '' THEN 'Stream detected continuously with a clear start and a sustained end.' ELSE found END AS reasons
FROM (SELECT *, concat_ws(' | ', CASE WHEN NOT end_confirmed THEN 'The video ended while liquid was still visible, so the efflux time is a lower bound rather than a measurement.' END,
    CASE WHEN cont < 0.6::DOUBLE THEN 'The stream was only visible in ' || round_even(cont * 100, 0)::BIGINT || '% of the timed interval, which makes the end of flow ambiguous.' END,
    CASE WHEN breaks > 1 THEN breaks || ' interruptions of the stream were seen before the end.' END,
    CASE WHEN dis > 0.02::DOUBLE THEN round_even(dis * 100, 0)::BIGINT || '% of frames showed movement around the cup (camera or hand movement).' END,
    CASE WHEN greatest(0, least(1, contrast / greatest(noise, 1e-6::DOUBLE) / 8)) < 0.3::DOUBLE THEN 'The stream contrast against the background is low; consider improving lighting or the background behind the stream.' END,
    CASE WHEN efflux > 0 AND efflux < 24 THEN printf('The measured interval (%.2f s) is very short for a Zahn cup test.', round_even(efflux, 2)) END) AS found
  FROM (SELECT *, greatest(0, least(1, continuity)) AS cont, greatest(0, least(1, disturbed::DOUBLE / greatest(1, frames))) AS dis FROM jud))"""
TYPED = """SELECT o_orderkey, coalesce(strftime(s, '%Y-%m-%d %H:%M:%S'), '') AS start, coalesce(strftime(s + to_microseconds(round_even(greatest(0::DOUBLE, o_orderkey / 8 - 100) * 1000000, 0)::BIGINT), '%Y-%m-%d %H:%M:%S'), '') AS later
FROM (SELECT o_orderkey, o_orderdate::DATE + [INTERVAL 27780 SECOND, INTERVAL 27780 SECOND, INTERVAL 27780 SECOND, INTERVAL 86399 SECOND, INTERVAL 250 MILLISECOND, INTERVAL 21900 SECOND, INTERVAL 0 SECOND, NULL, NULL, NULL][o_orderkey % 10 + 1] AS s FROM orders)"""
PLAYER = r"""SELECT o_orderkey, CASE WHEN sec IS NULL THEN 'unknown' ELSE CASE WHEN w >= 3600 THEN printf('%d:%02d:%02d', w // 3600, w // 60 % 60, w % 60) ELSE printf('%d:%02d', w // 60, w % 60) END || ' (' || printf('%d.%d', k // 10, k % 10) || ' s)' END AS length,
  CASE WHEN coalesce(b, 0) = 0 THEN 'unknown' WHEN b / 1048576 >= 1024 THEN printf('%.2f GB', floor(b / 1048576 / 1024 * 100 + 0.5::DOUBLE) / 100) ELSE printf('%.1f MB', b / 1048576) END AS size, printf('%d:%02d:%02d', v // 3600, v // 60 % 60, v % 60) AS at,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Efflux time measured: ' || o_orderkey % 100 || ' s' WHEN 1 THEN 'A time was measured but needs review' ELSE 'No reliable efflux time could be measured' END
    WHEN o_orderkey % 5 = 0 THEN 'Analysis complete - no events detected' ELSE 'Analysis complete - ' || o_orderkey % 5 || ' event(s) detected' END AS message,
  replace(coalesce(o_orderpriority, ''), '-', '') || ' é.mp4' AS name
FROM (SELECT *, floor(sec)::BIGINT AS w, coalesce(floor(sec), 0)::BIGINT AS v, floor(sec * 10 + 0.5::DOUBLE)::BIGINT AS k
  FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 90000) / 8 END AS sec, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::BIGINT * 1048576 % 5000000000 END AS b FROM orders))"""
STAMP = "printf('%d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
LOG = f"""SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "end", label) AS number, label, {STAMP.format("a")} AS start_text,
  {STAMP.format("b")} AS end_text, d AS duration_ms, round_even(confidence * 100, 0)::INT AS confidence_percent,
  CASE status WHEN 'confirmed' THEN 'detected' WHEN 'review' THEN 'needs review' ELSE 'failed' END AS status_text, notes AS notes_text
FROM (SELECT *, round_even("start" * 1000, 0)::BIGINT AS a, round_even("end" * 1000, 0)::BIGINT AS b, round_even(("end" - "start") * 1000, 0)::BIGINT AS d FROM evt)"""
ROIS = "r AS (SELECT l_orderkey, l_linenumber, (l_partkey % 400 - 20)::INT AS x, (l_suppkey % 300 - 20)::INT AS y, l_quantity::INT AS w, (l_quantity * 2)::INT AS h FROM lineitem)"
TIMES = r"""SELECT stream_id, seq, printf('%d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp,
  CASE WHEN d < 60 THEN printf('%.1f s', (k % 600) / 10.0::DOUBLE) WHEN d < 3600 THEN printf('%d m %04.1f s', k // 600 % 60, (k % 600) / 10.0::DOUBLE) ELSE printf('%d h %02d m %04.1f s', k // 36000, k // 600 % 60, (k % 600) / 10.0::DOUBLE) END AS duration,
  strftime(make_timestamp(round_even(t * 3.6e9::DOUBLE, 0)::BIGINT), '%Y-%m-%d %H') AS clock, floor(t - floor(t / 24) * 24)::INT AS hour, 'clip_' || seq || 'é_x_motion_events.csv' AS file
FROM (SELECT *, round_even(score * 1000, 0)::BIGINT AS ms, score * 20 AS d, round_even(score * 20 * 10, 0)::BIGINT AS k FROM trace)"""


RATES = """
SELECT stream_id, CASE WHEN k >= 5 AND hi > lo AND (k - 1) / ((hi - lo) / 1000) BETWEEN 0.5 AND 1000 THEN round((k - 1) / ((hi - lo) / 1000), 6) END AS fps
FROM (SELECT stream_id, count(*) FILTER (pts > 0) AS k, arg_min(pts, frame) FILTER (pts > 0) AS lo, arg_max(pts, frame) FILTER (pts > 0) AS hi
  FROM (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS frame, round_even(t * 1000, 0) / 100 AS pts FROM trace) WHERE frame < 60 GROUP BY 1)"""

MEDIA = """
SELECT o_orderkey, CASE WHEN code > 0 AND text <> '' THEN text ELSE 'unknown' END AS codec, round(coalesce(frames / fps, stamp / 1000), 6) AS duration,
       CASE WHEN frames IS NOT NULL THEN 'frame_count' WHEN stamp IS NOT NULL THEN 'timestamps' ELSE 'unknown' END AS duration_source
FROM (SELECT *, trim(list_aggregate(list_transform(list_filter([code & 255, (code >> 8) & 255, (code >> 16) & 255, (code >> 24) & 255], lambda b: b BETWEEN 32 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255), lambda b: chr(b::INT)), 'string_agg', '')) AS text
  FROM (SELECT o_orderkey, o_orderkey * 2654435 % 2147483647 AS code, 10::DOUBLE + o_orderkey % 50 AS fps, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10000 > 0 THEN (o_orderkey % 10000)::DOUBLE END AS frames, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey * 10::DOUBLE END AS stamp FROM orders))"""

REVIEW = """
SELECT stream_id, seq, CASE WHEN tenths >= 36000 THEN (tenths // 36000) || ':' ELSE '' END || printf('%02d:%02d.%d', tenths // 600 % 60, tenths // 10 % 60, tenths % 10) AS elapsed,
       round(least(6000::DOUBLE, greatest(0::DOUBLE, s - 500)), 6) AS seek, round(least(6000::DOUBLE, greatest(0::DOUBLE, s - 1)), 6) AS jump, round(least(100::DOUBLE, greatest(0::DOUBLE, s / 6000::DOUBLE * 100)), 6) AS percent,
       CASE WHEN w > 0 AND h > 0 THEN greatest(1, floor(w * (480 / greatest(w, h)) + 0.5::DOUBLE)::INT) END AS canvas_w, CASE WHEN w > 0 AND h > 0 THEN greatest(1, floor(h * (480 / greatest(w, h)) + 0.5::DOUBLE)::INT) END AS canvas_h
FROM (SELECT stream_id, seq, score * 20 AS s, floor(greatest(0::DOUBLE, score * 20) * 10 + 0.5::DOUBLE)::BIGINT AS tenths, (seq % 90)::INT AS w, (seq % 70)::INT AS h FROM trace)"""


ONE = TRACE.replace("user_id AS stream_id", "0::BIGINT AS stream_id")
ONE_FLOW = FLOW.replace("user_id AS stream_id", "0::BIGINT AS stream_id").replace(">= 12.0, false)", ">= 0.5, false)").replace(">= 30.0, false)", ">= 3.0, false)").replace("t - frm >= 10.0", "t - frm >= 0.5")
#: Frames with the planted signal in place of scores, through the same rules.
FLOW_CASES = (
    FLOW.replace(TRACE, """
fc AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, user_id % 5 AS c FROM events WHERE ts IS NOT NULL),
trace AS (SELECT stream_id, i::DOUBLE AS t, i AS seq, CASE WHEN CASE WHEN c IN (0, 2) THEN i BETWEEN 8 AND 23 WHEN c = 1 THEN i BETWEEN 8 AND 13 OR i BETWEEN 17 AND 22 OR i BETWEEN 26 AND 31 WHEN c = 3 THEN i >= 8 ELSE false END
    THEN 100.0 ELSE 0.0 END AS score, c = 2 AND i BETWEEN 2 AND 6 AS disturbed FROM fc)""")
    .replace("coalesce(CASE WHEN seq % 5 = 0 THEN score > 20 END, score >= 60.0)", "score >= 60.0").replace(">= 12.0, false)", ">= 2.0, false)").replace(">= 30.0, false)", ">= 4.0, false)").replace("t - frm >= 10.0", "t - frm >= 2.0")
)


def oracle_sql() -> dict[str, str]:
    def q(ctes, select):
        return f"WITH {ctes.strip()}\n{select}"

    iv = 'stream_id, round("start", 6) AS "start", round("end", 6) AS "end"'
    ev = iv + ", round(peak, 6) AS peak, round(mean, 6) AS mean, round(enter, 6) AS enter, samples::BIGINT AS samples, active::BIGINT AS active, round(disturbed_ratio, 6) AS disturbed_ratio, clipped_start, clipped_end, round(confidence, 6) AS confidence"
    return {
        "sampling_plan": q(PLAN, "SELECT stream_id, n, round(first, 6) AS first, round(last, 6) AS last, round(fps, 6) AS fps, round(interval, 6) AS interval, step, samples FROM plan"),
        "sample_grid": q(PLAN, "SELECT stream_id, frame, pts_ms FROM sta JOIN plan USING (stream_id) WHERE frame % step = 0"),
        "robust_stats": q(LEVELS, "SELECT stream_id, n, round(base, 6) AS base, round(sigma, 6) AS sigma FROM stats"),
        "adaptive_thresholds": q(LEVELS, "SELECT stream_id, round(enter, 6) AS enter, round(exit, 6) AS exit FROM lev"),
        "active_intervals_coarse": q(COARSE, f"SELECT {iv} FROM act"),
        "active_intervals_dense": q(DENSE, f"SELECT {iv} FROM dact"),
        "bridged_candidates": q(COARSE, f"SELECT {iv} FROM bri"),
        "drop_short": q(COARSE, f"SELECT {iv} FROM cand"),
        "strongest_candidates": q(DENSE + "," + PEAKS.format(n="top", c="dact", k=1), f"SELECT {iv}, round(peak, 6) AS peak, truncated FROM top"),
        "refined_windows": q(WINDOWS, "SELECT stream_id, window_id::INT AS window_id, round(c_start, 6) AS c_start, round(c_end, 6) AS c_end, round(w_start, 6) AS w_start, round(w_end, 6) AS w_end FROM win"),
        "refined_events": q(REFINED, f"SELECT window_id::INT AS window_id, {ev} FROM ref"),
        "merged_events": q(MERGED, f"SELECT {ev} FROM mer"),
        "extended_pauses": q(DENSE + ",\ndc AS (SELECT *, 0.8::DOUBLE AS confidence FROM dact)," + pauses("pau", "dc", 96.0), f"SELECT {iv}, round(confidence, 6) AS confidence FROM pau"),
        "activity_events": q(EVENTS, f"SELECT {iv}, label, round(confidence, 6) AS confidence, status, notes FROM evt"),
        "event_log": q(EVENTS, LOG),
        "event_summary": q(EVENTS, "SELECT stream_id, count(*) AS n_events, count(*) FILTER (WHERE status = 'confirmed') AS n_confirmed, count(*) FILTER (WHERE status = 'review') AS n_review, count(*) FILTER (WHERE status = 'failed') AS n_failed, sum(round_even((\"end\" - \"start\") * 1000, 0)::BIGINT)::BIGINT AS active_ms FROM evt GROUP BY 1"),
        "run_warnings": q(DENSE, """SELECT stream_id, coalesce(k, 0)::BIGINT AS n_candidates, coalesce(k, 0) > 1 AS truncated,
  CASE WHEN k > 1 THEN 'More than 1 candidate periods were found; only the strongest were analysed in detail. Consider lowering the sensitivity or selecting a region of interest.'
    WHEN k IS NULL THEN 'No activity above the detection threshold was found. If activity was expected, raise the sensitivity or narrow the region of interest.' ELSE '' END AS warnings
FROM (SELECT DISTINCT stream_id FROM trace) LEFT JOIN (SELECT stream_id, count(*) AS k FROM dact WHERE "end" - "start" >= 1 GROUP BY 1) USING (stream_id)"""),
        "trace_downsample": q(TRACE, "SELECT stream_id, round(t, 6) AS t, score, disturbed FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM trace) x WHERE n <= 20 OR k IN (SELECT i * n // 20 FROM range(0, 20) g(i))"),
        "persistence": q(TRACE + "," + persistent("p", "trace", "score >= 30", 12.0, "t, seq"), "SELECT stream_id, seq, round(p_start, 6) AS run_start, p_fires AS fires FROM p"),
        "flow_measurement": q(FLOW, f"SELECT {iv}, end_confirmed, frames, with_liquid, disturbed, timed, timed_with_liquid, round(start_margin, 6) AS start_margin, round(contrast, 6) AS contrast, round(noise, 6) AS noise, breaks FROM flo"),
        "flow_breaks": q(FLOW, f"SELECT {iv} FROM brk"),
        "flow_confidence": q(FLOW, "SELECT stream_id, round(efflux, 6) AS efflux, round(continuity, 6) AS continuity, round(confidence, 6) AS confidence, status FROM jud"),
        "timing_windows": q(TIMING, "SELECT stream_id, n, w_start FROM ws"),
        "timing_verdict": q(TIMING, "SELECT stream_id, n, usable, reason, reason IN ('too_short_to_matter', 'constant') AS reliable FROM ver"),
        "format_time": q(TRACE, TIMES),
        "rate_estimates": q(TRACE, RATES),
        "media_probe": MEDIA,
        "orphaned_files": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
        "record_lookup": "SELECT k AS c_custkey, c_nationkey, c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey * 3 AS k FROM orders) LEFT JOIN customer ON c_custkey = k",
        "expired_records": "SELECT o_custkey, max(o_orderdate) AS used_at FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-01-01' - INTERVAL 2190 MINUTE",
        "review_times": q(TRACE, REVIEW),
        "roi_geometry": q(ROIS, "SELECT *, w >= 4 AND h >= 4 AND x >= 0 AND y >= 0 AND x + w <= 320 AND y + h <= 240 AS valid, greatest(0, x) AS c_x, greatest(0, y) AS c_y, greatest(0, least(320, x + w) - greatest(0, x)) AS c_w, greatest(0, least(240, y + h) - greatest(0, y)) AS c_h, round_even(x * 0.5, 0)::INT AS s_x, round_even(y * 0.5, 0)::INT AS s_y, greatest(1, round_even(w * 0.5, 0)::INT) AS s_w, greatest(1, round_even(h * 0.5, 0)::INT) AS s_h, greatest(0, x - 9) AS g_x, greatest(0, y - 9) AS g_y, least(320, x + w + 9) - greatest(0, x - 9) AS g_w, least(240, y + h + 4) - greatest(0, y - 9) AS g_h FROM r"),
        "inner_regions": q(
            ROIS
            + ",\ng AS (SELECT *, greatest(0, x - 9) AS gx, greatest(0, y - 9) AS gy, least(320, x + w + 9) - greatest(0, x - 9) AS gw, least(240, y + h + 4) - greatest(0, y - 9) AS gh FROM r),"
            + "\nk AS (SELECT *, round_even((x - gx) * 0.7::DOUBLE, 0)::INT AS ox, round_even((y - gy) * 0.7::DOUBLE, 0)::INT AS oy FROM g)",
            "SELECT l_orderkey, l_linenumber, greatest(0, ox) AS i_x, greatest(0, oy) AS i_y, greatest(1, least(round_even(w * 0.7::DOUBLE, 0)::INT, greatest(1, round_even(gw * 0.7::DOUBLE, 0)::INT) - ox)) AS i_w, "
            "greatest(1, least(round_even(h * 0.7::DOUBLE, 0)::INT, greatest(1, round_even(gh * 0.7::DOUBLE, 0)::INT) - oy)) AS i_h, x, y, w AS width, h AS height, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= 320 AND y + h <= 240 AS usable FROM k",
        ),
        "last_frames": "SELECT o_orderkey, CASE WHEN c > 0 THEN least(floor(greatest(0, e) * f), c - 1) WHEN d IS NOT NULL THEN floor(greatest(0, least(e, d)) * f) WHEN e > 0 THEN floor(e * f) ELSE 1073741824 END::BIGINT AS last FROM (SELECT o_orderkey, (o_orderkey % 400 - 20)::DOUBLE AS e, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 250)::DOUBLE END AS d, 10::DOUBLE + o_orderkey % 50 AS f, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5000 END AS c FROM orders)",
        "event_rows": q(EVENTS + "," + STARTS.replace("@A@", STAMP.format("a")).replace("@B@", STAMP.format("b")), "SELECT * FROM exp"),
        "boundary_events": q(DENSE, f'SELECT {iv}, number::INT AS number FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "end") AS number FROM dact) WHERE number <= 2'),
        "recording_starts": TYPED,
        "player_texts": PLAYER,
        "flow_reasons": q(FLOW, REASONS),
        "timing_rules": q(RULE_STAMPS, "SELECT stream_id, n, usable, reason, reason IN ('too_short_to_matter', 'constant') AS reliable, CASE WHEN reason IN ('no_usable_timestamps', 'unrepresentative_sample') THEN 'unverifiable' WHEN reason = 'timing_drift' THEN 'drift' WHEN reason NOT IN ('too_short_to_matter', 'constant') THEN 'variable_rate' END AS message FROM ver"),
        "verified_windows": q(TIMING, "SELECT stream_id, w_start, landed FROM (SELECT stream_id, w_start, (w_start + (stream_id + w_start) % 71)::DOUBLE AS landed FROM ws WHERE (stream_id + w_start) % 4 <> 0 AND (stream_id + w_start) % 5 <> 0) WHERE abs(landed - w_start) <= 40"),
        "scan_walk": "WITH RECURSIVE " + q(TRACE + "," + WALK + """,
walk AS (SELECT DISTINCT stream_id, 0::BIGINT AS idx, 0 AS failed FROM trace UNION ALL
  SELECT w.stream_id, CASE WHEN readable THEN idx + w.stream_id % 4 + 2 ELSE idx + 1 END, CASE WHEN readable THEN 0 ELSE failed + 1 END FROM walk w JOIN fr ON fr.stream_id = w.stream_id AND fr.frame_index = w.idx WHERE readable OR failed + 1 < 30)""", "SELECT w.stream_id, idx AS frame_index FROM walk w JOIN fr ON fr.stream_id = w.stream_id AND fr.frame_index = w.idx WHERE readable").removeprefix("WITH "),
        "shown_frames": q(TRACE + "," + WALK, "SELECT *, min(CASE WHEN readable THEN frame_index END) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS shown FROM fr"),
        "merged_overlaps": q(MERGED.replace("mb_1 AS (", 'ref60 AS (SELECT * REPLACE ("start" - 60 AS "start", "end" + 60 AS "end") FROM ref),\nmb_1 AS (', 1).replace("AS fresh FROM ref)", "AS fresh FROM ref60)"), f"SELECT {ev} FROM mer"),
        "motion_events": """WITH n AS (SELECT user_id AS stream_id, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
s AS (SELECT stream_id, (24 * k + 8)::DOUBLE AS "start", least(24 * k + 15, n - 1)::DOUBLE AS "end" FROM n, range(0, 10000) g(k) WHERE least(24 * k + 15, n - 1) - (24 * k + 8) >= 1),
p AS (SELECT stream_id, "end" AS "start", lead("start") OVER (PARTITION BY stream_id ORDER BY "start") AS "end" FROM s)
SELECT stream_id, 'Machine active' AS label, "start", "end", false AS truncated FROM s UNION ALL SELECT stream_id, 'Extended pause', "start", "end", false FROM p WHERE "end" IS NOT NULL""",
        "liquid_run": """SELECT user_id AS stream_id, 8::DOUBLE AS "start", 15::DOUBLE AS "end", true AS end_confirmed, 'confirmed' AS status, 'Stream detected continuously with a clear start and a sustained end.' AS reasons FROM events WHERE ts IS NOT NULL GROUP BY 1""",
        "one_stream_intervals": q(ONE + ",\nlt AS (SELECT *, 60.0::DOUBLE AS enter, 20.0::DOUBLE AS exit FROM trace)," + active("dact", "lt", S, True), f"SELECT {iv} FROM dact"),
        "one_stream_persistence": q(ONE + "," + persistent("p", "trace", "score >= 20", 1.0, "t, seq"), "SELECT seq, round(p_start, 6) AS run_start, p_fires AS fires FROM p"),
        "one_stream_flow": q(ONE_FLOW, f"SELECT {iv}, end_confirmed, frames, with_liquid, disturbed, timed, timed_with_liquid, round(start_margin, 6) AS start_margin, round(contrast, 6) AS contrast, round(noise, 6) AS noise, breaks FROM flo"),
        "recorded_events": """WITH n AS (SELECT user_id AS stream_id, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT stream_id, 'Motion' AS label, (24 * k + 8)::DOUBLE AS "start", least(24 * k + 15, n - 1)::DOUBLE AS "end", false AS truncated FROM n, range(0, 10000) g(k) WHERE least(24 * k + 15, n - 1) - (24 * k + 8) >= 1""",
        "flow_cases": q(FLOW_CASES, """SELECT stream_id, "start", "end", end_confirmed, breaks, "start" IS NOT NULL AS started FROM flo"""),
        "boundary_frames": q(DENSE + """,
fi AS (SELECT stream_id, count(*) AS n, min(t) AS first, (count(*) - 1) / (max(t) - min(t)) AS fps FROM trace GROUP BY 1 HAVING max(t) > min(t)),
fr AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t, seq) - 1 AS i, NOT disturbed AS readable, score FROM trace),
nb AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY "start", "end") AS number FROM dact),
bo AS (SELECT stream_id, number, 'start' AS boundary, "start" AS t FROM nb UNION ALL SELECT stream_id, number, 'end', "end" FROM nb),
ak AS (SELECT bo.stream_id, number, boundary, least(floor(greatest(0, bo.t - first) * fps), n - 1)::BIGINT AS asked FROM bo JOIN fi USING (stream_id)),
sh AS (SELECT ak.*, (SELECT min(i) FROM fr WHERE fr.stream_id = ak.stream_id AND readable AND i BETWEEN asked AND asked + 29) AS shown FROM ak)""", "SELECT sh.stream_id, number::INT AS number, boundary, asked, shown, score::FLOAT::DOUBLE AS level FROM sh LEFT JOIN fr ON fr.stream_id = sh.stream_id AND i = shown"),
        "brightness_stretches": """WITH m AS (SELECT label::BIGINT AS stream_id, vec_id AS frame_index, list_sum(list_transform(embedding, lambda v: round_even(greatest(0::DOUBLE, least(255::DOUBLE, (v::DOUBLE + 0.6::DOUBLE) * 200)), 0))) / 64 AS mean FROM embeddings),
j AS (SELECT *, coalesce(abs(mean - lag(mean) OVER (PARTITION BY stream_id ORDER BY frame_index)) >= 2, false) AS jump FROM m)
SELECT stream_id, frame_index, coalesce(last_value(CASE WHEN jump THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING), -1) AS stretch FROM j""",
        "film_headers": "SELECT label::BIGINT AS stream_id, 'DIB' AS codec, 8 AS width, 8 AS height, count(*) AS frame_count, 25::DOUBLE AS fps, round(count(*) / 25::DOUBLE, 6) AS duration, 'frame_count' AS duration_source FROM embeddings GROUP BY 1",
        "film_levels": "SELECT label::BIGINT AS stream_id, i AS frame_index, list_sum(px)::DOUBLE AS total, list_max(px)::DOUBLE AS brightest FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda v: round_even(greatest(0::DOUBLE, least(255::DOUBLE, (v::DOUBLE + 0.6::DOUBLE) * 200)), 0)) AS px FROM embeddings) WHERE i >= 10",
        "click_region": q(ROIS, "SELECT l_orderkey, l_linenumber, x AS px, y AS py, greatest(0, least(320 - 60, x - 30)) AS x, greatest(0, least(240 - 108, y - 4)) AS y, 60 AS w, 108 AS h FROM r"),
        "frame_levels": "SELECT label::BIGINT AS stream_id, vec_id AS frame_index, list_sum(px)::DOUBLE AS total, list_max(px)::DOUBLE AS brightest FROM (SELECT label, vec_id, list_transform(embedding, lambda v: round_even(greatest(0::DOUBLE, least(255::DOUBLE, (v::DOUBLE + 0.6::DOUBLE) * 200)), 0)) AS px FROM embeddings)",
    }
