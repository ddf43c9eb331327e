"""The registered queries as SQL for DuckDB, written apart from the engine's plans.

``PARTS`` has named common table expressions over the driver's tables; ``query`` puts those before a statement that it
needs. Numbers are those of ``EVENTS_PROFILE``.
"""

from __future__ import annotations

import re

KEY = "subject, condition, segment, belt"

PARTS = {
    "raw_rows": r"""
      SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4
             WHEN 'view' THEN 5 ELSE 0 END::INTEGER AS subject, 1::INTEGER AS condition, ts, event_id,
             round(value * 100)::DOUBLE AS resp_l, regexp_extract(props, '(\d+)', 1)::BIGINT AS d FROM events""",
    "signals": """
      SELECT subject, condition, (row_number() OVER w - 1)::BIGINT AS k,
             100.0::DOUBLE - (sum(d) OVER f)::DOUBLE / ((count(d) OVER f) * 5.0::DOUBLE) AS spo2, resp_l, (d * 100)::DOUBLE AS resp_d
      FROM raw_rows WINDOW w AS (PARTITION BY subject, condition ORDER BY ts, event_id),
        f AS (PARTITION BY subject, condition ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
    "lens": "SELECT subject, condition, max(k) + 1 AS n FROM signals GROUP BY ALL",
    "belts": """
      SELECT subject, condition, 'full' AS segment, 'lungs' AS belt, k, resp_l AS x FROM signals
      UNION ALL SELECT subject, condition, 'full', 'diaph', k, resp_d FROM signals
      UNION ALL SELECT subject, condition, 'baseline', 'lungs', k, resp_l FROM signals WHERE k < 60
      UNION ALL SELECT subject, condition, 'baseline', 'diaph', k, resp_d FROM signals WHERE k < 60""",
    "centred": f"SELECT {KEY}, k, x - median(x) OVER (PARTITION BY {KEY}) AS x FROM belts",
    "smooth": f"""
      SELECT {KEY}, k, avg(x) OVER (PARTITION BY {KEY} ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x0 FROM centred""",
    "steps": f"""
      SELECT * FROM (SELECT *, lag(x0) OVER w AS b, row_number() OVER w AS r FROM smooth WINDOW w AS (PARTITION BY {KEY} ORDER BY k))
      WHERE r = 1 OR x0 IS DISTINCT FROM b""",
    "maxima": f"""
      SELECT {KEY}, k, x0 AS h FROM (
        SELECT *, lag(x0) OVER w AS p, lead(x0) OVER w AS q FROM steps WINDOW w AS (PARTITION BY {KEY} ORDER BY k))
      WHERE x0 > p AND x0 > q""",
    "proms": f"""
      SELECT m.subject, m.condition, m.segment, m.belt, m.k, m.h, m.h - greatest(
          min(s.x0) FILTER (WHERE s.k BETWEEN m.lo AND m.k), min(s.x0) FILTER (WHERE s.k BETWEEN m.k AND m.hi)) AS prominence
      FROM (SELECT a.*, coalesce(max(b.k) FILTER (WHERE b.k < a.k), -1) AS lo, coalesce(min(b.k) FILTER (WHERE b.k > a.k), 1000000000) AS hi
            FROM maxima a LEFT JOIN maxima b ON b.subject = a.subject AND b.condition = a.condition AND b.segment = a.segment
              AND b.belt = a.belt AND b.h > a.h GROUP BY ALL) m
      JOIN smooth s ON s.subject = m.subject AND s.condition = m.condition AND s.segment = m.segment AND s.belt = m.belt
        AND s.k BETWEEN m.lo AND m.hi
      GROUP BY m.subject, m.condition, m.segment, m.belt, m.k, m.h""",
    "ranked": f"""
      SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY h DESC, k) AS r FROM proms WHERE prominence >= 2000""",
    "thin": f"""
      SELECT {KEY}, 0::BIGINT AS r, []::BIGINT[] AS acc FROM (SELECT DISTINCT {KEY} FROM ranked)
      UNION ALL
      SELECT c.subject, c.condition, c.segment, c.belt, c.r,
             CASE WHEN len(list_filter(t.acc, lambda a: abs(a - c.k) <= 2)) > 0 THEN t.acc ELSE list_append(t.acc, c.k) END
      FROM thin t JOIN ranked c ON c.subject = t.subject AND c.condition = t.condition AND c.segment = t.segment
        AND c.belt = t.belt AND c.r = t.r + 1""",
    "peaks": f"""
      SELECT p.* FROM proms p JOIN (
        SELECT {KEY}, unnest(acc) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY r DESC) AS z FROM thin) WHERE z = 1) t
      USING ({KEY}, k)""",
    "steps_of": f"""
      SELECT * FROM (SELECT *, lead(k) OVER w AS next_k, row_number() OVER w AS breath_no,
        count(*) OVER (PARTITION BY {KEY}) AS m FROM peaks WINDOW w AS (PARTITION BY {KEY} ORDER BY k)) WHERE m >= 3""",
    "breaths": f"""
      SELECT {KEY}, breath_no, k AS peak_k, h AS peak_val, low.k AS trough_k, low.x AS trough_val, h - low.x AS amp,
             (next_k - k)::DOUBLE AS ibi_s, 60.0::DOUBLE / (next_k - k) AS rr_bpm
      FROM (SELECT p.subject, p.condition, p.segment, p.belt, p.breath_no, p.k, p.h, p.next_k,
              min({{'x': s.x0, 'k': s.k}}) AS low
            FROM steps_of p LEFT JOIN smooth s ON s.subject = p.subject AND s.condition = p.condition AND s.segment = p.segment
              AND s.belt = p.belt AND s.k BETWEEN p.k AND p.next_k
            GROUP BY ALL)""",
    "low_parts": f"""
      SELECT p.subject, p.condition, p.segment, p.belt, p.breath_no, list_sort(list(s.x0) FILTER (WHERE s.x0 IS NOT NULL)) AS xs,
             least(greatest(0.25::DOUBLE * count(s.x0) + 0.5, 1.0::DOUBLE), count(s.x0)::DOUBLE) AS place, list({{'x': s.x0, 'k': s.k}}) AS own
      FROM steps_of p JOIN smooth s ON s.subject = p.subject AND s.condition = p.condition AND s.segment = p.segment
        AND s.belt = p.belt AND s.k BETWEEN p.k AND p.next_k
      GROUP BY ALL""",
    "low_values": f"""
      SELECT {KEY}, breath_no, own, xs[floor(place)::BIGINT] + (xs[ceil(place)::BIGINT] - xs[floor(place)::BIGINT]) * (place - floor(place)) AS p FROM low_parts""",
    "low_ends": f"""
      SELECT {KEY}, breath_no, min({{'d': abs(o.x - p), 'k': o.k, 'x': o.x}}) AS low
      FROM (SELECT {KEY}, breath_no, p, unnest(own) AS o FROM low_values) WHERE o.x IS NOT NULL GROUP BY ALL""",
    "channels": """
      SELECT subject, condition, k, 'spo2' AS channel, spo2 AS value FROM signals WHERE spo2 IS NOT NULL
      UNION ALL SELECT subject, condition, k, 'resp_l', resp_l FROM signals WHERE resp_l IS NOT NULL
      UNION ALL SELECT subject, condition, k, 'resp_d', resp_d FROM signals WHERE resp_d IS NOT NULL""",
    "base": """
      SELECT h.subject, h.condition, h.spo2_median, h.spo2_mean, lungs_amp_ref, lungs_rr_ref, diap_amp_ref, diap_rr_ref
      FROM (SELECT subject, condition, median(spo2) AS spo2_median, avg(spo2) AS spo2_mean FROM signals WHERE k < 60 GROUP BY ALL) h
      LEFT JOIN (SELECT subject, condition, median(amp) FILTER (WHERE belt = 'lungs') AS lungs_amp_ref,
          60.0::DOUBLE / avg(ibi_s) FILTER (WHERE belt = 'lungs') AS lungs_rr_ref,
          median(amp) FILTER (WHERE belt = 'diaph') AS diap_amp_ref, 60.0::DOUBLE / avg(ibi_s) FILTER (WHERE belt = 'diaph') AS diap_rr_ref
        FROM breaths WHERE segment = 'baseline' GROUP BY ALL) b USING (subject, condition)""",
    "full_breaths": """
      SELECT b.subject, b.condition, b.belt, b.breath_no, b.peak_k, b.amp,
             CASE WHEN b.belt = 'lungs' THEN r.lungs_amp_ref ELSE r.diap_amp_ref END AS amp_ref
      FROM breaths b JOIN base r ON r.subject = b.subject AND r.condition = b.condition
      WHERE b.segment = 'full' AND r.lungs_amp_ref > 0 AND r.diap_amp_ref > 0
        AND (SELECT count(DISTINCT c.belt) FROM breaths c WHERE c.segment = 'full' AND c.subject = b.subject AND c.condition = b.condition) = 2""",
    "grid": "SELECT subject, condition, unnest(range(n)) AS g, n FROM lens",
    "win": """
      SELECT g.subject, g.condition, b.belt, g.g, b.amp_ref,
             count(f.peak_k) AS n, median(f.amp) AS med_amp, list(f.peak_k ORDER BY f.peak_k) FILTER (WHERE f.peak_k IS NOT NULL) AS ks
      FROM grid g JOIN (SELECT DISTINCT subject, condition, belt, amp_ref FROM full_breaths) b
        ON b.subject = g.subject AND b.condition = g.condition
      LEFT JOIN full_breaths f ON f.subject = g.subject AND f.condition = g.condition AND f.belt = b.belt AND f.peak_k BETWEEN g.g - 30 AND g.g
      GROUP BY ALL""",
    "gaps": """
      SELECT * EXCLUDE (ks), [ks[i + 1] - ks[i] for i in range(1, len(ks))] AS ibis FROM win""",
    "stats": """
      SELECT *, CASE WHEN n >= 2 THEN 60.0::DOUBLE / list_avg(ibis) END AS rr,
             CASE WHEN n >= 3 THEN list_stddev_samp(ibis) / list_avg(ibis) END AS cov,
             CASE WHEN n >= 3 THEN sqrt(list_avg([(ibis[i + 1] - ibis[i])::DOUBLE ^ 2 for i in range(1, len(ibis))])) END AS rmssd,
             len(list_filter(ibis, lambda x: x >= 25)) AS pauses
      FROM gaps""",
    "shallow_pts": """
      SELECT subject, condition, g, coalesce(bool_or(med_amp / amp_ref BETWEEN 1.0::DOUBLE - 0.35::DOUBLE AND 1.0::DOUBLE - 0.2::DOUBLE), false)
             AND min(n) >= 3 AND g >= 30 AS flag FROM win GROUP BY subject, condition, g""",
    "slow_pts": "SELECT subject, condition, g, coalesce(bool_or(n >= 3 AND rr <= 10), false) AND g >= 30 AS flag FROM stats GROUP BY subject, condition, g",
    "rapid_pts": "SELECT subject, condition, g, coalesce(bool_or(n >= 3 AND rr >= 12), false) AND g >= 30 AS flag FROM stats GROUP BY subject, condition, g",
    "irregular_pts": """
      SELECT subject, condition, g, coalesce(bool_or(n >= 3 AND pauses = 0 AND (cov >= 0.45::DOUBLE OR rmssd >= 4)), false) AND g >= 30 AS flag
      FROM stats GROUP BY subject, condition, g""",
    "apnea_pts": """
      SELECT subject, condition, g, coalesce(bool_and(coalesce(med_amp / amp_ref <= 0.9::DOUBLE, false)), false) AND min(n) >= 2 AND count(*) = 2
             AND g >= 30 AS flag FROM win GROUP BY subject, condition, g""",
    "low_pts": """
      SELECT s.subject, s.condition, s.k, coalesce(s.spo2 < 88 OR b.m - s.spo2 >= 3, false) AS flag
      FROM signals s JOIN (SELECT subject, condition, median(spo2) AS m FROM signals WHERE k < 60 GROUP BY ALL) b USING (subject, condition)""",
    "desat": """
      SELECT subject, condition, 'desaturation' AS type, min(k) + 1 AS start_idx, max(k) + 1 AS end_idx, min(k)::DOUBLE AS start_t, max(k)::DOUBLE AS end_t
      FROM (SELECT *, k - row_number() OVER (PARTITION BY subject, condition ORDER BY k) AS i FROM low_pts WHERE flag)
      GROUP BY subject, condition, i HAVING count(*) >= 3""",
    "near_desat": """
      SELECT d.subject, d.condition, d.type, d.start_idx, d.end_idx, greatest(0.0::DOUBLE, d.start_t - 20) AS start_t,
             least((n - 1)::DOUBLE, d.end_t + 20) AS end_t FROM desat d JOIN lens USING (subject, condition)""",
    "shb_pts": """
      SELECT p.* FROM shallow_pts p WHERE flag AND NOT EXISTS (SELECT 1 FROM desat d WHERE d.subject = p.subject AND d.condition = p.condition
        AND p.g BETWEEN d.start_t AND d.end_t)""",
    "slow_voted": """
      SELECT e.*, v.share FROM slow_runs e LEFT JOIN LATERAL (SELECT avg(p.flag::INTEGER) AS share FROM shallow_pts p
        WHERE p.subject = e.subject AND p.condition = e.condition AND p.g BETWEEN e.start_t AND e.end_t) v ON true""",
    "rapid_voted": """
      SELECT e.*, v.share FROM rapid_runs e LEFT JOIN LATERAL (SELECT avg(p.flag::INTEGER) AS share FROM shallow_pts p
        WHERE p.subject = e.subject AND p.condition = e.condition AND p.g BETWEEN e.start_t AND e.end_t) v ON true""",
    "apn": """
      SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM desat d WHERE d.subject = e.subject AND d.condition = e.condition
        AND d.end_t >= e.start_t AND d.start_t <= e.end_t + 45) THEN 'apnea_desat' ELSE 'apnea' END AS type) FROM apnea_runs e""",
    "sigh_pts": """
      SELECT *, coalesce(peak_k >= 30 AND n_prev >= 3 AND med_prev > 0 AND amp >= 1.5::DOUBLE * med_prev, false) AS flag FROM (
        SELECT a.subject, a.condition, a.belt, a.peak_k, a.amp, count(b.peak_k) AS n_prev, median(b.amp) AS med_prev
        FROM full_breaths a LEFT JOIN full_breaths b ON b.subject = a.subject AND b.condition = a.condition AND b.belt = a.belt
          AND b.peak_k >= a.peak_k - 30 AND b.peak_k < a.peak_k GROUP BY ALL)""",
    "sigh_spans": """
      SELECT subject, condition, belt, 'sigh' AS type, s + 1 AS start_idx, e + 1 AS end_idx, s::DOUBLE AS start_t, e::DOUBLE AS end_t
      FROM (SELECT subject, condition, belt, least(n - 1, round((p + peak_k) * 0.5::DOUBLE))::BIGINT AS s,
                   least(n - 1, round((peak_k + q) * 0.5::DOUBLE))::BIGINT AS e
            FROM (SELECT z.*, lag(peak_k) OVER w AS p, lead(peak_k) OVER w AS q FROM sigh_pts z
                  WINDOW w AS (PARTITION BY subject, condition, belt ORDER BY peak_k)) JOIN lens USING (subject, condition)
            WHERE flag AND p IS NOT NULL AND q IS NOT NULL)""",
    "all_raw": """
      SELECT * FROM shb UNION ALL SELECT * FROM irb UNION ALL SELECT * FROM slb UNION ALL SELECT * FROM rab
      UNION ALL SELECT * FROM desat UNION ALL SELECT * FROM apn UNION ALL SELECT * FROM sig""",
}


def _runs(points: str, label: str, least: int) -> str:
    return f"""
      SELECT subject, condition, '{label}' AS type, min(g) + 1 AS start_idx, max(g) + 1 AS end_idx, min(g)::DOUBLE AS start_t, max(g)::DOUBLE AS end_t
      FROM (SELECT *, g - row_number() OVER (PARTITION BY subject, condition ORDER BY g) AS i FROM {points} WHERE flag)
      GROUP BY subject, condition, i HAVING count(*) >= {least}"""


def _rated(voted: str, label: str) -> str:
    return f"""
      SELECT * EXCLUDE (share) REPLACE (
        CASE WHEN share >= 0.5 THEN '{label}_shallow' WHEN share IS NOT NULL THEN '{label}_deep' ELSE '{label}' END ||
        CASE WHEN EXISTS (SELECT 1 FROM near_desat d WHERE d.subject = e.subject AND d.condition = e.condition
          AND d.end_t >= e.start_t AND d.start_t <= e.end_t) THEN '_desat' ELSE '' END AS type)
      FROM {voted} e"""


def _merged(source: str, tolerance: float, by: str) -> str:
    return f"""
      SELECT subject, condition, arg_min(type, r) AS type, arg_min(start_idx, r) AS start_idx, max(end_idx) AS end_idx,
             min(start_t) AS start_t, max(end_t) AS end_t
      FROM (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY r) AS island
            FROM (SELECT *, CASE WHEN start_t <= max(end_t) OVER (PARTITION BY {by} ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                    + {tolerance}::DOUBLE THEN 0 ELSE 1 END AS new
                  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY start_t, end_t, start_idx, end_idx, type) AS r FROM {source})))
      GROUP BY {by}, island"""


PARTS |= {
    "shb": _runs("shb_pts", "shallow_breathing", 10),
    "irb": _runs("irregular_pts", "irregular_breathing", 10),
    "slow_runs": _runs("slow_pts", "slow_breathing", 10),
    "rapid_runs": _runs("rapid_pts", "rapid_breathing", 10),
    "apnea_runs": _runs("apnea_pts", "apnea", 5),
    "slb": _rated("slow_voted", "slow_breathing"),
    "rab": _rated("rapid_voted", "rapid_breathing"),
    "sig": _merged("(SELECT * EXCLUDE (belt) FROM sigh_spans)", 0.5, "subject, condition"),
    "merged": _merged("all_raw", 0, "subject, condition, type"),
}

RULES = """CASE WHEN starts_with(s, 'shallow_breathing') OR s = 'shb' OR contains(s, 'shallowbreathing') THEN 'ShB'
    WHEN starts_with(s, 'irregular_breathing') OR s = 'irb' OR contains(s, 'irregularbreathing') THEN 'IrB'
    WHEN starts_with(s, 'slow_breathing') OR s = 'slb' OR contains(s, 'slowbreathing') THEN 'SlB'
    WHEN starts_with(s, 'rapid_breathing') OR s = 'rab' OR contains(s, 'rapidbreathing') OR contains(s, 'tachypnea') THEN 'RaB'
    WHEN starts_with(s, 'respiratory_asynchrony') OR s = 'rea' OR contains(s, 'asynchron') THEN 'ReA'
    WHEN starts_with(s, 'desaturation') OR s = 'des' OR contains(s, 'hypoxia') THEN 'Des'
    WHEN starts_with(s, 'apnea') OR s = 'apn' THEN 'Apn' WHEN starts_with(s, 'sigh') OR s = 'sig' THEN 'Sig' ELSE s END"""
DEPTH = "CASE WHEN contains(s, 'shallow') THEN 'shallow' WHEN contains(s, 'deep') THEN 'deep' ELSE '' END"

PARTS["final"] = f"""
      SELECT subject, condition, {RULES} AS type, start_idx, end_idx, start_t, end_t, contains(s, 'desat') AS desat, {DEPTH} AS depth, type AS raw_type
      FROM (SELECT *, replace(replace(lower(trim(type)), ' ', '_'), '-', '_') AS s FROM merged)"""


def query(statement: str, **extra: str) -> str:
    parts = PARTS | extra
    need, todo = set(), [statement]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = [p for p in parts if p in words and p not in need]
        need.update(new)
        todo += [parts[p] for p in new]
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        words = set(re.findall(r"\w+", parts[name]))
        for other in parts:
            if other in words and other != name and other in need:
                place(other)
        if name not in done:
            done.append(name)

    for name in parts:
        if name in need:
            place(name)
    kind = "WITH RECURSIVE " if "thin" in need else "WITH "
    listed = ", ".join(f"{n} AS {'' if n == 'thin' else 'MATERIALIZED '}({parts[n]})" for n in done)
    return f"{kind if done else ''}{listed}\n{statement}"


EV = "subject, condition, type, start_idx, end_idx, start_t, end_t"
R = "round({0}, 6) AS {0}".format

SAMPLE_TYPES = [
    "slow_breathing_shallow_desat", "apnea_desat", "desaturation", "Rapid Breathing", "foo-bar", " Shallow_Breathing ", "SHB", "tachypnea-x",
    "hypoxia", "sigh", "Sig", "RespiratoryAsynchrony", "slow breathing deep", "irb", "apn", "deep sigh",
]
_TYPES = ", ".join(f"'{t}'" for t in SAMPLE_TYPES)

ORACLES = {
    "scan_wide_files": query("SELECT subject, condition, k, spo2, resp_l, resp_d FROM signals"),
    "scan_channel_major_files": query("SELECT subject, condition, k, spo2, resp_l, resp_d FROM signals"),
    "stored_events": query(f"SELECT {EV} FROM desat"),
    "trough_prctile": query(f"SELECT {KEY}, breath_no, low.k AS trough_k, round(low.x, 6) AS trough_val FROM low_ends"),
    "figure_traces": query("SELECT subject, condition, k::DOUBLE AS t, channel, value FROM channels WHERE k BETWEEN 1 AND 10"),
    "figure_limits": query("""SELECT subject, condition, channel, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM channels GROUP BY ALL"""),
    "figure_event_spans": query("""SELECT subject, condition, type, greatest(start_t, 100.0::DOUBLE) AS "left", least(end_t, 1000.0::DOUBLE) AS "right"
        FROM desat WHERE end_t >= 100 AND start_t <= 1000"""),
    "figure_mask_spans": query("""SELECT subject, condition, min(g)::DOUBLE AS "left", max(g)::DOUBLE AS "right"
        FROM (SELECT *, g - row_number() OVER (PARTITION BY subject, condition ORDER BY g) AS i FROM shallow_pts WHERE flag)
        GROUP BY subject, condition, i"""),
    "scan_signals": query("SELECT subject, condition, k, spo2, resp_l, resp_d FROM signals"),
    "head_segment": query("SELECT subject, condition, k, spo2 FROM signals WHERE k < 60"),
    "grid_points": query("SELECT subject, condition, unnest(range((n - 1) // 60 + 1)) AS g FROM lens"),
    "label_dictionary": query("""SELECT l.subject, l.condition, idx, long_name, short_name, count(f.type) AS n_events
        FROM lens l JOIN (VALUES (1, 'ShallowBreathing', 'ShB'), (2, 'IrregularBreathing', 'IrB'), (3, 'SlowBreathing', 'SlB'),
        (4, 'Rapid Breathing', 'RaB'), (5, 'RespiratoryAsynchrony', 'ReA'), (6, 'Desaturation', 'Des'), (7, 'Apnea', 'Apn'), (8, 'Sigh', 'Sig'))
        t(idx, long_name, short_name) ON true LEFT JOIN final f ON f.subject = l.subject AND f.condition = l.condition AND f.type = short_name GROUP BY ALL"""),
    "scan_split_files": query("SELECT subject, condition, k, spo2, resp_l, resp_d FROM signals"),
    "recording_files": query("SELECT subject, condition, n, printf('ECG1_ECG2_SpO2_RespL_BP_RespD_fs200_Sub%d_Pom%d_DeTr_Norm.dat', subject, condition) AS file FROM lens"),
    "config_rows": query("""SELECT subject, condition, n::DOUBLE AS seconds, least(n, 60) AS baseline_rows, 3 AS smooth_rows, 2 AS peak_dist_rows,
        n AS grid_points, 3 AS desat_rows FROM lens"""),
    "spo2_units": query("""SELECT subject, condition, round(median(spo2), 6) AS spo2_median, median(spo2) BETWEEN 50 AND 100 AS plausible
        FROM signals WHERE k < 60 GROUP BY ALL"""),
    "belt_medians": query(f"SELECT {KEY}, median(x) AS median FROM belts GROUP BY ALL"),
    "sliding_median": query("""SELECT subject, condition, k, round(median(spo2) OVER w, 6) AS median FROM signals
        WINDOW w AS (PARTITION BY subject, condition ORDER BY k ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)"""),
    "asof_breath": query("""SELECT p.subject, p.condition, p.belt, p.g, f.peak_k, round(f.amp, 6) AS amp, p.g - f.peak_k AS since
        FROM (SELECT g.subject, g.condition, b.belt, g.g FROM grid g JOIN (SELECT DISTINCT subject, condition, belt FROM full_breaths) b
              ON b.subject = g.subject AND b.condition = g.condition) p
        ASOF LEFT JOIN full_breaths f ON f.subject = p.subject AND f.condition = p.condition AND f.belt = p.belt AND f.peak_k <= p.g"""),
    "baseline_spo2": query("SELECT subject, condition, round(median(spo2), 6) AS spo2_median, round(avg(spo2), 6) AS spo2_mean FROM signals WHERE k < 60 GROUP BY ALL"),
    "detrend": query(f"SELECT {KEY}, k, x FROM centred"),
    "moving_mean": query(f"SELECT {KEY}, k, {R('x0')} FROM smooth"),
    "local_maxima": query(f"SELECT {KEY}, k, {R('h')} FROM maxima"),
    "peak_prominence": query(f"SELECT {KEY}, k, {R('h')}, {R('prominence')} FROM proms"),
    "peak_distance_nms": query(f"SELECT {KEY}, k FROM peaks"),
    "breath_table": query(f"SELECT {KEY}, breath_no, peak_k, {R('peak_val')}, trough_k, {R('trough_val')}, {R('amp')}, {R('ibi_s')}, {R('rr_bpm')} FROM breaths"),
    "trough_argmin": query(f"SELECT {KEY}, breath_no, trough_k FROM breaths WHERE trough_k IS NOT NULL"),
    "ibi_rr": query(f"SELECT {KEY}, count(*) AS n_peaks, round(60.0::DOUBLE / avg(ibi_s), 6) AS rr_mean_bpm, round(stddev_samp(rr_bpm), 6) AS rr_std_bpm FROM breaths GROUP BY ALL"),
    "baseline_amp_ref": query("SELECT subject, condition, " + ", ".join(map(R, ("spo2_median", "spo2_mean", "lungs_amp_ref", "lungs_rr_ref", "diap_amp_ref", "diap_rr_ref"))) + " FROM base"),
    "win_median_amp": query(f"SELECT subject, condition, belt, g, n, {R('med_amp')} FROM win"),
    "win_rr": query(f"SELECT subject, condition, belt, g, n, {R('rr')} FROM stats"),
    "win_cov_rmssd": query(f"SELECT subject, condition, belt, g, {R('cov')}, {R('rmssd')}, CASE WHEN n > 0 THEN pauses END AS pauses FROM stats"),
    "win_amp_ratio": query("SELECT subject, condition, belt, g, CASE WHEN n >= 2 THEN round(med_amp / amp_ref, 6) END AS ratio FROM win"),
    "cond_shallow": query("SELECT * FROM shallow_pts"),
    "cond_slow": query("SELECT * FROM slow_pts"),
    "cond_rapid": query("SELECT * FROM rapid_pts"),
    "cond_irregular": query("SELECT * FROM irregular_pts"),
    "cond_apnea": query("SELECT * FROM apnea_pts"),
    "desat_flags": query("SELECT * FROM low_pts"),
    "runs_desat": query(f"SELECT {EV} FROM desat"),
    "runs_to_events": query(f"SELECT {EV} FROM irb"),
    "grid_to_sample": query(f"SELECT {EV} FROM slow_runs"),
    "pad_intervals": query(f"SELECT {EV} FROM near_desat"),
    "overlap_semi": query(f"SELECT {EV} FROM slow_runs e WHERE EXISTS (SELECT 1 FROM desat d WHERE d.subject = e.subject AND d.condition = e.condition AND NOT (e.end_t < d.start_t OR e.start_t > d.end_t))"),
    "overlap_lag": query(f"SELECT {EV}, EXISTS (SELECT 1 FROM desat d WHERE d.subject = e.subject AND d.condition = e.condition AND NOT (e.end_t + 45 < d.start_t OR e.start_t > d.end_t)) AS met FROM apnea_runs e"),
    "point_anti": query("SELECT subject, condition, g FROM shb_pts"),
    "intersect_events": query("""SELECT subject, condition, type, start_idx, end_idx, start_t, end_t FROM sigh_spans a WHERE belt = 'lungs' AND EXISTS (
        SELECT 1 FROM sigh_spans b WHERE b.belt = 'diaph' AND b.subject = a.subject AND b.condition = a.condition AND b.end_t >= a.start_t AND b.start_t <= a.end_t)"""),
    "merge_within_type": query(f"SELECT {EV} FROM merged"),
    "merge_tolerance": query(f"SELECT {EV} FROM sig"),
    "depth_vote": query(f"SELECT {EV}, {R('share')} FROM slow_voted"),
    "sigh_flags": query(f"SELECT subject, condition, belt, peak_k, {R('amp')}, n_prev, {R('med_prev')}, flag FROM sigh_pts"),
    "sigh_intervals": query(f"SELECT {EV}, belt FROM sigh_spans"),
    "sigh_frequency": query("""SELECT subject, condition, g, sighs, sighs >= 7 AS many FROM (
        SELECT p.subject, p.condition, p.g, count(e.start_t) AS sighs
        FROM (SELECT subject, condition, unnest(range((n - 1) // 60 + 1)) AS g FROM lens
              WHERE EXISTS (SELECT 1 FROM sig WHERE sig.subject = lens.subject AND sig.condition = lens.condition)) p
        LEFT JOIN sig e ON e.subject = p.subject AND e.condition = p.condition AND (e.start_t + e.end_t) / 2 BETWEEN p.g * 60 - 1800 AND p.g * 60
        GROUP BY ALL)"""),
    "normalize_types": f"""SELECT event_type, raw_type, {RULES} AS type, contains(s, 'desat') AS desat, {DEPTH} AS depth, count(*) AS n
        FROM (SELECT event_type, raw_type, replace(replace(lower(trim(raw_type)), ' ', '_'), '-', '_') AS s
              FROM (SELECT event_type, [{_TYPES}][event_id % {len(SAMPLE_TYPES)} + 1] AS raw_type FROM events)) GROUP BY ALL""",
    "detect_shb": query(f"SELECT {EV} FROM shb"),
    "detect_irb": query(f"SELECT {EV} FROM irb"),
    "detect_slb": query(f"SELECT {EV} FROM slb"),
    "detect_rab": query(f"SELECT {EV} FROM rab"),
    "detect_rea": query("SELECT subject, condition, 0::BIGINT AS n_events FROM lens"),
    "detect_des": query(f"SELECT {EV} FROM desat"),
    "detect_apn": query(f"SELECT {EV} FROM apn"),
    "detect_sig": query(f"SELECT {EV} FROM sig"),
    "pipeline_events": query("SELECT * FROM final"),
    "event_sample_mask": query("SELECT s.subject, s.condition, s.k, EXISTS (SELECT 1 FROM desat d WHERE d.subject = s.subject AND d.condition = s.condition AND s.k BETWEEN d.start_t AND d.end_t) AS flag FROM signals s"),
    "sample_mask": query("SELECT s.subject, s.condition, s.k, " + ", ".join(
        f"""coalesce(bool_or(e.type = '{x}'), false) AS "{x}" """ for x in ("ShB", "IrB", "SlB", "RaB", "ReA", "Des", "Apn", "Sig"))
        + "FROM signals s LEFT JOIN final e ON e.subject = s.subject AND e.condition = s.condition AND s.k + 1 BETWEEN e.start_idx AND e.end_idx GROUP BY s.subject, s.condition, s.k"),
    "label_order": query("""SELECT subject, condition, type, row_number() OVER (PARTITION BY subject, condition ORDER BY f) AS position
        FROM (SELECT subject, condition, type, min(raw_type) AS f FROM final GROUP BY ALL)"""),
    "label_cube": query("SELECT condition, type, count(*) AS n_events, round(sum(end_t - start_t), 6) AS seconds FROM final GROUP BY CUBE (condition, type)"),
}
