"""DuckDB SQL for the queries that SQL can express."""

SIGNAL = """s AS (
  SELECT user_id AS clip_key, 'user_' || lpad(user_id::VARCHAR, 5, '0') AS clip_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id AS frame_number, 30.0::DOUBLE AS fps,
         user_id % 10 = 0 AS is_reference, CASE WHEN user_id % 20 = 0 THEN 'relevant' ELSE 'irrelevant' END AS category, event_type, value
  FROM events)"""

HIERARCHY = """h AS (
  SELECT n_name AS school, c_custkey AS participant, o_orderkey AS recording,
         s1, s2, s3, s4, s5, s6, s7, s1 + s2 + s3 + s4 + s5 + s6 + s7 AS completed
  FROM (SELECT o_orderkey, o_custkey, """ + ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {k} THEN 1 ELSE 0 END), 0)::INT AS s{k}" for k in range(1, 8)) + """
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""

WINDOWS = SIGNAL + """,
  clips AS (SELECT clip_key, count(*) AS t, any_value(is_reference) AS is_reference FROM s GROUP BY clip_key),
  size AS (SELECT greatest(2, round_even(greatest(2, round_even(avg(t / 30.0) * 30, 0)) / 4, 0))::INT AS w FROM clips WHERE is_reference),
  placed AS (
    SELECT clip_key, is_reference, CASE WHEN is_reference THEN t ELSE least(t, w) END AS n,
           CASE WHEN is_reference THEN 1073741824 ELSE greatest(1, round_even(w * 0.5, 0)::INT) END AS step, t FROM clips, size),
  wins AS (SELECT clip_key, n, step, unnest(generate_series(0, (t - n) // step)) AS window_index FROM placed),
  feats AS (
    SELECT clip_key, clip_id, is_reference, window_index, window_index * step AS window_start_frame, n AS n_frames,
           CASE WHEN count(value) >= greatest(2, 0.5 * n) THEN avg(value) END AS value_mean,
           CASE WHEN count(value) >= greatest(2, 0.5 * n) THEN stddev_pop(value) END AS value_std
    FROM wins JOIN s USING (clip_key) WHERE frame_index >= window_index * step AND frame_index < window_index * step + n
    GROUP BY clip_key, clip_id, is_reference, window_index, step, n),
  whole AS (SELECT * FROM feats WHERE value_mean IS NOT NULL AND value_std IS NOT NULL)"""


def _median(before: int, after: int) -> str:
    frame = f"PARTITION BY clip_key ORDER BY frame_index ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING"
    return f"round(CASE WHEN value IS NOT NULL THEN quantile_cont(value, 0.5) OVER ({frame}) END, 6) AS smoothed"


def _normalised(f: str) -> str:
    own = "NOT is_reference AND count(*) OVER c > 1"
    mean = f"CASE WHEN {own} THEN avg({f}) OVER c ELSE avg({f}) OVER k END"
    std = f"CASE WHEN {own} THEN coalesce(nullif(stddev_pop({f}) OVER c, 0), stddev_pop({f}) OVER k) ELSE stddev_pop({f}) OVER k END"
    return f"round(coalesce(({f} - {mean}) / nullif({std}, 0), 0), 4) + 0 AS {f}"


_NO_ERRORS = ", m AS (SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN value END AS value) FROM s)"
_SOURCE = "(SELECT strftime(ts, '%Y-%m-%d %H') AS frame, arg_min(value, event_id) FILTER (value IS NOT NULL) AS v FROM events WHERE event_type = '{}' GROUP BY 1)"

# Poses. Slots: shoulders 0 1, elbows 2 3, wrists 4 5, hand roots 6 7, then the finger tips of the left and the right hand.
# A clip is a label's vectors of one range of ids; in POSE_LONG it is a whole label.
POSE = """p AS (
  SELECT label * 1000000::BIGINT + vec_id // 640 AS clip_key, 'clip_' || lpad(label::VARCHAR, 2, '0') || '_' || lpad((vec_id // 640)::VARCHAR, 6, '0') AS clip_id,
         row_number() OVER (PARTITION BY label, vec_id // 640 ORDER BY vec_id) - 1 AS frame_index,
         vec_id AS frame_number, 30.0::DOUBLE AS fps, label < 3 AS is_reference, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"""
POSE_LONG = """p AS (
  SELECT label AS clip_key, 'clip_' || lpad(label::VARCHAR, 2, '0') AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
         vec_id AS frame_number, 30.0::DOUBLE AS fps, label < 3 AS is_reference, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"""
TIPS_2D = {"left": dict(zip(("thumb", "index", "middle", "ring", "pinky"), range(8, 13))), "right": dict(zip(("thumb", "index", "middle", "ring", "pinky"), range(13, 18)))}
TIPS_3D = {"left": {"thumb": 8, "index": 9, "pinky": 10}, "right": {"thumb": 11, "index": 12, "pinky": 13}}
ROOT = {"left": 6, "right": 7}
SIGNALS_2D = "wrist_distance lr_keypoint_distance hand_speed_x hand_speed_y hand_accel_x hand_accel_y hand_opening index_thumb_distance thumb_pinky_distance hand_y_position".split()
SIGNALS_3D = "wrist_distance lr_keypoint_distance hand_speed_x hand_speed_y hand_speed_z hand_accel_x hand_accel_y hand_accel_z hand_opening index_thumb_distance thumb_pinky_distance hand_y_position elbow_angle hand_shoulder_distance".split()


def _lik(slot: int, dims: int) -> str:
    return f"least(1.0, 8 * abs(e[{(dims + 1) * (slot + 1)}]))"


def _raw(slot: int, axis: int, dims: int) -> str:
    return f"e[{(dims + 1) * slot + axis + 1}]"


def _gap(a: list[str], b: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({x} - {y}) ** 2" for x, y in zip(a, b)) + ")"


def _mean(values: list[str]) -> str:
    return f"list_avg([{', '.join(values)}])"


def signals_sql(dims: int, pose: str = POSE) -> str:
    """CTEs down to ``g``: the pose columns and one column for each signal."""
    tips, slots = (TIPS_2D, range(18)) if dims == 2 else (TIPS_3D, range(14))
    masked = lambda j, x: f"CASE WHEN {_lik(j, dims)} < 0.1 THEN NULL ELSE {x} END"
    camera = lambda j: [masked(j, _raw(j, a, dims)) for a in range(dims)]
    base = f"{pose}, w AS (SELECT clip_key, median({_gap(camera(0), camera(1))}) AS sw FROM p GROUP BY clip_key)"
    if dims == 2:
        joints = ", ".join(f"{x} AS {'xyz'[a]}{j}" for j in slots for a, x in enumerate(camera(j)))
        base += f", j AS (SELECT p.*, CASE WHEN sw > 0 THEN sw END AS sw, {joints} FROM p JOIN w USING (clip_key))"
    else:
        raw = lambda j: [_raw(j, a, 3) for a in range(3)]
        origin = ", ".join(f"CASE WHEN {_lik(0, 3)} >= 0.1 AND {_lik(1, 3)} >= 0.1 THEN ({a} + {b}) / 2 END AS o{n}" for a, b, n in zip(raw(0), raw(1), "xyz"))
        half = ", ".join(f"({b} - {a}) / 2 AS r{n}" for a, b, n in zip(raw(0), raw(1), "xyz"))
        base += f", b1 AS (SELECT p.*, CASE WHEN sw > 0 THEN sw END AS sw, {origin}, {half} FROM p JOIN w USING (clip_key))"
        base += ", b2 AS (SELECT *, " + ", ".join(f"r{n} / nullif(sqrt(rx * rx + ry * ry + rz * rz), 0) AS u{n}" for n in "xyz") + " FROM b1)"
        base += ", b3 AS (SELECT *, uz * ux AS fx, uz * uy AS fy, uz * uz - 1 AS fz FROM b2)"
        base += ", b4 AS (SELECT *, " + ", ".join(f"f{n} / nullif(sqrt(fx * fx + fy * fy + fz * fz), 0) AS z{n}" for n in "xyz") + " FROM b3)"
        base += ", b5 AS (SELECT *, zy * uz - zz * uy AS yx, zz * ux - zx * uz AS yy, zx * uy - zy * ux AS yz FROM b4)"
        turned = lambda j, v: masked(j, " + ".join(f"{v}{n} * ({_raw(j, i, 3)} - o{n})" for i, n in enumerate("xyz")))
        base += ", j AS (SELECT clip_key, clip_id, frame_index, frame_number, fps, is_reference, sw, " + ", ".join(f"{turned(j, v)} AS {n}{j}" for j in slots for v, n in (("u", "x"), ("y", "y"), ("z", "z"))) + " FROM b5)"
    at = lambda j: [f"{n}{j}" for n in "xyz"[:dims]]
    both = lambda make: _mean([make(s) for s in ("left", "right")])
    pairs = [(6, 7)] + [(tips["left"][f], tips["right"][f]) for f in tips["left"]]
    out = {
        "wrist_distance": f"{_gap(at(6), at(7))} / sw",
        "lr_keypoint_distance": _mean([f"{_gap(at(a), at(b))} / sw" for a, b in pairs]),
        "hand_opening": both(lambda s: _mean([_gap(at(t), at(ROOT[s])) for t in tips[s].values()])) + " / sw",
        "index_thumb_distance": both(lambda s: _gap(at(tips[s]["index"]), at(tips[s]["thumb"]))) + " / sw",
        "thumb_pinky_distance": both(lambda s: _gap(at(tips[s]["thumb"]), at(tips[s]["pinky"]))) + " / sw",
        "hand_y_position": f"({_mean(['y6', 'y7'])}" + (f" - {_mean(['y0', 'y1'])}" if dims == 2 else "") + ") / sw",
    }
    if dims == 3:
        def angle(shoulder: int, elbow: int, wrist: int) -> str:
            u, v = ([f"({a} - {b})" for a, b in zip(at(x), at(elbow))] for x in (shoulder, wrist))
            dot = lambda p, q: " + ".join(f"{a} * {b}" for a, b in zip(p, q))
            cosine = f"(({dot(u, v)}) / nullif(sqrt({dot(u, u)}) * sqrt({dot(v, v)}), 0))"
            return f"CASE WHEN {cosine} IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, {cosine})))) END"

        out["elbow_angle"] = f"CASE WHEN sw IS NOT NULL THEN {_mean([angle(0, 2, 4), angle(1, 3, 5)])} END"
        out["hand_shoulder_distance"] = _mean([_gap(at(6), at(0)), _gap(at(7), at(1))]) + " / sw"
    over = "OVER (PARTITION BY clip_key ORDER BY frame_index)"
    speed = ", ".join(f"({n}{j} - lag({n}{j}) {over}) * fps / sw AS v{n}{j}" for j in (6, 7) for n in "xyz"[:dims])
    accel = ", ".join(f"(v{n}{j} - lag(v{n}{j}) {over}) * fps AS a{n}{j}" for j in (6, 7) for n in "xyz"[:dims])
    base += f", v AS (SELECT *, {speed} FROM j), a AS (SELECT *, {accel} FROM v)"
    for kind, short in (("speed", "v"), ("accel", "a")):
        for n in "xyz"[:dims]:
            out[f"hand_{kind}_{n}"] = _mean([f"abs({short}{n}6)", f"abs({short}{n}7)"])
    return base + ", g AS (SELECT clip_key, clip_id, frame_index, frame_number, fps, is_reference, " + ", ".join(f"{x} AS {n}" for n, x in out.items()) + " FROM a)"


def _digits(names: list[str], digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) + 0 AS {n}" for n in names)


def window_features_sql(dims: int) -> str:
    """CTEs down to ``feats``: whole-clip rows of references, window rows of the others."""
    aggregates = []
    for n in SIGNALS_2D if dims == 2 else SIGNALS_3D:
        skip = 1 if "_speed_" in n else 2 if "_accel_" in n else 0
        value = f"CASE WHEN frame_index - window_index * step >= {skip} THEN {n} END"
        enough = f"count({value}) >= greatest(2, 0.5 * (n - {skip}))"
        aggregates += [f"CASE WHEN {enough} THEN avg({value}) END AS {n}_mean", f"CASE WHEN {enough} THEN stddev_pop({value}) END AS {n}_std"]
    return signals_sql(dims) + f""",
      clips AS (SELECT clip_key, count(*) AS t, any_value(is_reference) AS is_reference FROM g GROUP BY clip_key),
      size AS (SELECT greatest(2, round_even(greatest(2, round_even(avg(t / 30.0) * 30, 0)) / 4, 0))::INT AS w FROM clips WHERE is_reference),
      placed AS (SELECT clip_key, CASE WHEN is_reference THEN t ELSE least(t, w) END AS n,
                        CASE WHEN is_reference THEN 1073741824 ELSE greatest(1, round_even(w * 0.5, 0)::INT) END AS step, t FROM clips, size),
      wins AS (SELECT clip_key, n, step, unnest(generate_series(0, (t - n) // step)) AS window_index FROM placed),
      feats AS (SELECT clip_key, clip_id, is_reference, window_index::INT AS window_index, (window_index * step)::INT AS window_start_frame, n AS n_frames, {", ".join(aggregates)}
        FROM wins JOIN g USING (clip_key) WHERE frame_index >= window_index * step AND frame_index < window_index * step + n GROUP BY clip_key, clip_id, is_reference, window_index, step, n)"""


def _features(dims: int) -> list[str]:
    return [f"{n}_{k}" for n in (SIGNALS_2D if dims == 2 else SIGNALS_3D) for k in ("mean", "std")]


def _channels(dims: int) -> list[str]:
    return [n for n in (SIGNALS_2D if dims == 2 else SIGNALS_3D) if n not in ("hand_accel_x", "hand_accel_y")]


def weights_sql(dims: int) -> str:
    """CTEs down to ``weights``."""
    long = " UNION ALL ".join(f"SELECT clip_id, '{c}' AS channel, {c} AS v FROM g WHERE is_reference" for c in _channels(dims))
    return signals_sql(dims) + f""", l AS ({long}),
      stats AS (SELECT clip_id, channel, coalesce(avg(v), 0) AS mean, CASE WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 1 END AS std, coalesce(stddev_pop(v), 0) AS raw_std FROM l GROUP BY ALL),
      scales AS (SELECT channel, CASE WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 1 END AS scale FROM l GROUP BY ALL),
      ratio AS (SELECT clip_id, channel, raw_std / scale AS r FROM stats JOIN scales USING (channel)),
      weights AS (SELECT clip_id, channel, coalesce(r / nullif(sum(r) OVER (PARTITION BY clip_id), 0), 0) AS weight FROM ratio)"""


# Bones of the 16-slot skeleton: name, mirror key, slots; and the raster of a frame.
BONES = [("left_shoulder-left_elbow", "A", 0, 2), ("right_shoulder-right_elbow", "A", 1, 3), ("left_elbow-left_wrist", "B", 2, 4), ("right_elbow-right_wrist", "B", 3, 5), ("left_shoulder-right_shoulder", "C", 0, 1)]
BONE_SAMPLES = POSE + ", b AS (" + " UNION ALL ".join(
    f"SELECT clip_key, '{m}' AS mirror, {_gap([_raw(i, a, 3) for a in range(3)], [_raw(j, a, 3) for a in range(3)])} AS length FROM p WHERE {_lik(i, 3)} >= 0.5 AND {_lik(j, 3)} >= 0.5" for _, m, i, j in BONES
) + "), names AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m}')" for n, m, _, _ in BONES) + ") t(bone, mirror))"
BONE_ROWS = "count(*) AS n, round(median(length), 6) AS median_m, round(stddev_pop(length), 6) AS std_m, round(CASE WHEN median(length) > 1e-9 THEN stddev_pop(length) / median(length) END, 6) AS cv"


def _bilinear(x: str, y: str) -> str:
    cx, cy = (f"greatest(0.0, least({c}, 7.0))" for c in (x, y))
    x0, y0 = f"floor({cx})::INT", f"floor({cy})::INT"
    x1, y1 = f"least({x0} + 1, 7)", f"least({y0} + 1, 7)"
    fx, fy = f"({cx} - floor({cx}))", f"({cy} - floor({cy}))"
    at = lambda b, a: f"abs(e[{b} * 8 + {a} + 1])"
    return f"(({at(y0, x0)} * (1 - {fx}) + {at(y0, x1)} * {fx}) * (1 - {fy}) + ({at(y1, x0)} * (1 - {fx}) + {at(y1, x1)} * {fx}) * {fy})"


SHOULDERS = POSE + ", q AS (SELECT clip_key AS run, frame_number, " + ", ".join(
    f"{_raw(s, 0, 2)} AS {n}x, {_raw(s, 1, 2)} AS {n}y, {_lik(s, 2)} AS {n}lik, {_bilinear(f'(({_raw(s, 0, 2)} + 1) * 3)', f'(({_raw(s, 1, 2)} + 1) * 3)')} AS d{n}" for s, n in ((0, "l"), (1, "r"))
) + " FROM p)"
HANDS = POSE + ", h AS (" + " UNION ALL ".join(
    f"SELECT frame_number, '{side}' AS side, {joint} AS joint, {_raw(slot, 0, 3)} AS x, {_raw(slot, 1, 3)} AS y, {_raw(slot, 2, 3)} AS z, {_lik(slot, 3)} AS lik FROM p"
    for side, slots in (("left", (6, 8, 9, 10)), ("right", (7, 11, 12, 13))) for joint, slot in enumerate(slots)
) + ")"


BOXES = """s AS (SELECT frame_number, side, greatest(0, min((x + 1) * 320)) AS x0, least(639, max((x + 1) * 320)) AS x1, greatest(0, min((y + 1) * 240)) AS y0, least(479, max((y + 1) * 240)) AS y1
          FROM h WHERE lik > 0.1 GROUP BY ALL HAVING count(*) >= 2 AND avg(lik) >= 0.3),
        z AS (SELECT frame_number, side, greatest(0, (x0 + x1) / 2 - (x1 - x0)) AS ax, least(639, (x0 + x1) / 2 + (x1 - x0)) AS bx, greatest(0, (y0 + y1) / 2 - (y1 - y0)) AS ay, least(479, (y0 + y1) / 2 + (y1 - y0)) AS high_y
          FROM s WHERE x1 > x0 AND y1 > y0)"""

ORACLES = {
    "merge_sources": f"""SELECT frame, round(b.v, 6) AS body_value, round(f.v, 6) AS full_body_value, round(h.v, 6) AS hand_value, round(coalesce(b.v, f.v, h.v), 6) AS value
        FROM {_SOURCE.format("click")} b FULL JOIN {_SOURCE.format("view")} f USING (frame) FULL JOIN {_SOURCE.format("purchase")} h USING (frame)""",
    "smooth_centered": f"WITH {SIGNAL}{_NO_ERRORS} SELECT clip_key, frame_number, {_median(2, 2)} FROM m",
    "smooth_asymmetric": f"WITH {SIGNAL} SELECT clip_key, frame_number, {_median(5, 4)} FROM s",
    "gap_interpolation": f"""WITH {SIGNAL}, g AS (
          SELECT *, last_value(CASE WHEN event_type <> 'error' THEN {{'i': frame_index, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY clip_key ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                 first_value(CASE WHEN event_type <> 'error' THEN {{'i': frame_index, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY clip_key ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM s)
        SELECT clip_key, frame_number, round(CASE WHEN event_type = 'error' THEN a.v + (b.v - a.v) * (frame_index - a.i) / (b.i - a.i) ELSE value END, 6) AS filled FROM g""",
    "locf": f"""WITH {SIGNAL}{_NO_ERRORS} SELECT clip_key, frame_number,
        round(last_value(value IGNORE NULLS) OVER (PARTITION BY clip_key ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS carried FROM m""",
    "midpoint_window": f"""WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY clip_key) AS n FROM s)
        SELECT clip_key, frame_index::INT AS frame_index, frame_index - (n - 10) // 2 = 5 AS is_middle FROM n
        WHERE n >= 10 AND frame_index >= (n - 10) // 2 AND frame_index < (n - 10) // 2 + 10""",
    "reference_length_table": f"""WITH {SIGNAL}, c AS (SELECT clip_id, category, count(*) AS n_frames, max(fps) AS fps FROM s WHERE is_reference GROUP BY ALL)
        SELECT clip_id, category, n_frames, fps, round(n_frames / fps, 6) AS duration_s, round(n_frames - avg(n_frames) OVER (), 6) AS diff_from_mean_frames,
               round(n_frames / fps - avg(n_frames / fps) OVER (), 6) AS diff_from_mean_s FROM c""",
    "window_size": f"WITH {SIGNAL} SELECT 30.0::DOUBLE AS fps, greatest(2, round_even(avg(n / 30.0) * 30, 0))::INT AS window_frames FROM (SELECT count(*) AS n FROM s WHERE is_reference GROUP BY clip_key)",
    "sliding_window_features": f"""WITH {WINDOWS} SELECT clip_key, clip_id, is_reference, window_index::INT AS window_index, window_start_frame::INT AS window_start_frame, n_frames,
        round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std FROM feats""",
    "normalize_per_clip": f"""WITH {WINDOWS} SELECT clip_id, is_reference, window_index::INT AS window_index, {_normalised("value_mean")}, {_normalised("value_std")} FROM whole
        WINDOW c AS (PARTITION BY is_reference, clip_id), k AS (PARTITION BY is_reference)""",
    "standard_scaler": f"""WITH {WINDOWS} SELECT clip_id, window_index::INT AS window_index, """ + ", ".join(
        f"round(({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1), 4) + 0 AS {f}" for f in ("value_mean", "value_std")) + " FROM whole",
    "knn_reference_windows": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, w.vec_id AS window_index, sqrt((q.u - w.u) ** 2 + (q.v - w.v) ** 2) AS distance FROM p q, p w WHERE q.vec_id % 100 = 0 AND w.vec_id % 100 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, window_index) AS rank FROM d)
        SELECT query_id, window_index, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""",
    "convex_hull": """WITH p AS (SELECT DISTINCT label, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings),
        sides AS (SELECT a.label, a.u, a.v, (b.u - a.u) * (r.v - a.v) - (b.v - a.v) * (r.u - a.u) AS turn, (b.u - a.u) * (r.u - a.u) + (b.v - a.v) * (r.v - a.v) AS ahead, b.u AS bu, b.v AS bv
                  FROM p a JOIN p b ON a.label = b.label AND (a.u <> b.u OR a.v <> b.v) JOIN p r ON r.label = a.label AND (r.u <> a.u OR r.v <> a.v)),
        edges AS (SELECT label, u, v, max(turn) AS most FROM sides GROUP BY label, u, v, bu, bv HAVING min(turn) >= 0 AND min(CASE WHEN turn = 0 THEN ahead ELSE 0 END) >= 0),
        corners AS (SELECT DISTINCT label, u, v FROM edges WHERE most > 0),
        turned AS (SELECT *, count(*) OVER w AS n, atan2(v - avg(v) OVER w, u - avg(u) OVER w) AS angle FROM corners WINDOW w AS (PARTITION BY label)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY angle) AS at_angle, row_number() OVER (PARTITION BY label ORDER BY u, v) AS at_left FROM turned)
        SELECT label, ((c.at_angle - s.at_angle + c.n) % c.n)::INT AS corner, c.u, c.v FROM placed c JOIN (SELECT label, at_angle FROM placed WHERE at_left = 1) s USING (label) WHERE c.n >= 3""",
    "channel_zscore": f"""WITH {SIGNAL}, r AS (SELECT coalesce(avg(value), 0) AS m, CASE WHEN stddev_pop(value) > 1e-6 THEN stddev_pop(value) ELSE 1 END AS d FROM s WHERE clip_id = 'user_00010' AND is_reference)
        SELECT clip_key, frame_number, round(coalesce((value - m) / d, 0), 5) + 0 AS value FROM s, r""",
    "match_overlay_progress": f"""WITH {SIGNAL} SELECT 'user_00010' AS reference_id, clip_key, frame_index::INT AS frame_index, round((frame_index - 3) / 11, 6) AS progress, round(value, 6) AS value
        FROM s WHERE NOT is_reference AND frame_index BETWEEN 3 AND 14""",
    "depth_delta_roundtrip": f"""WITH {SIGNAL}, r AS (SELECT *, ((floor(value * 1000)::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768 AS raw FROM s)
        SELECT clip_key, frame_number, raw, ((raw - coalesce(lag(raw) OVER (PARTITION BY clip_key ORDER BY frame_index), 0) + 32768) % 65536 + 65536) % 65536 - 32768 AS delta, raw AS decoded FROM r""",
    "depth_blocks": """SELECT label * 1000000::BIGINT + vec_id // 640 AS run, vec_id::INT AS frame_number, len(list_filter(embedding, lambda v: abs(v) > 0.15::DOUBLE))::INT AS sky_pixels, true AS close FROM embeddings""",
    "axis_limits": "SELECT axis, round(lo - (hi - lo) * 0.08, 6) AS low, round(hi + (hi - lo) * 0.08, 6) AS high FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS axis, quantile_cont(embedding[{i}]::DOUBLE, 0.01) AS lo, quantile_cont(embedding[{i}]::DOUBLE, 0.99) AS hi FROM embeddings" for a, i in (("u", 1), ("v", 2))) + ")",
    "progress_stages": f"WITH {HIERARCHY} SELECT * FROM h",
    "progress_rollup": f"""WITH {HIERARCHY} SELECT school, participant, grouping(school, participant)::INT AS level, count(*) AS recordings, count(*) FILTER (completed = 7) AS fully_complete,
        round(100.0 * count(*) FILTER (completed = 7) / count(*), 6) AS percent_complete, """ + ", ".join(f"sum(s{k})::BIGINT AS s{k}_done" for k in range(1, 8)) + " FROM h GROUP BY ROLLUP (school, participant)",
    "progress_totals": f"WITH {HIERARCHY} SELECT count(DISTINCT school) AS schools, count(DISTINCT (school, participant)) AS participants, count(*) AS recordings FROM h",
    "progress_missing_stage": f"""WITH {HIERARCHY} SELECT school, participant, recording, completed FROM h
        WHERE contains(lower(school || ' ' || participant || ' ' || recording), 'nation_1') AND completed <> 7 AND s3 = 0""",
    "reference_ids": f"WITH {SIGNAL} SELECT category, clip_id, (row_number() OVER (ORDER BY category, clip_id))::INT AS reference_number FROM (SELECT DISTINCT category, clip_id FROM s WHERE is_reference)",
    "participant_palette_rank": f"""WITH {HIERARCHY}, p AS (SELECT DISTINCT school, participant FROM h)
        SELECT school, participant, ((dense_rank() OVER (ORDER BY school) - 1) % 6)::INT AS hue,
               round(0.30 + 0.42 * CASE WHEN count(*) OVER (PARTITION BY school) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY school ORDER BY participant) END, 6) AS lightness FROM p""",
    "stale_runs_antijoin": f"WITH {HIERARCHY} SELECT recording, completed FROM h WHERE s7 <> 1",
    "unknown_references": f"WITH {SIGNAL} SELECT DISTINCT clip_id FROM s WHERE NOT is_reference",
    "props_field": "SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS sum_k, count(*) AS n FROM events GROUP BY event_type",
    "shoulder_width": f"WITH {POSE} SELECT clip_key, round(median({_gap(*[[f'CASE WHEN {_lik(j, 2)} >= 0.1 THEN {_raw(j, a, 2)} END' for a in (0, 1)] for j in (0, 1)])}), 6) AS shoulder_width FROM p GROUP BY clip_key",
    "likelihood_mask_rate": f"WITH {POSE} SELECT clip_key, count(*) * 21 AS n_joints, sum(" + " + ".join(f"({_lik(j, 2)} < 0.1)::INT" for j in range(21)) + ")::BIGINT AS n_masked FROM p GROUP BY clip_key",
    "nanmean_rowwise": f"WITH {POSE} SELECT clip_key, frame_number, round({_mean([f'CASE WHEN {_lik(j, 2)} >= 0.1 THEN {_raw(j, 1, 2)} END' for j in range(8, 18)])}, 6) + 0 AS mean_tip_y FROM p",
    "frame_signals_2d": f"WITH {signals_sql(2)} SELECT clip_key, frame_number, {_digits(SIGNALS_2D, 5)} FROM g",
    "frame_signals_long": f"WITH {signals_sql(2, POSE_LONG)} SELECT clip_key, frame_number, {_digits(SIGNALS_2D, 5)} FROM g",
    "signal_changes": f"""WITH {SIGNAL}, a AS (SELECT *, (value - lag(value) OVER (PARTITION BY clip_key ORDER BY frame_index)) * fps AS v FROM s)
        SELECT clip_key, frame_number, round(v, 4) + 0 AS speed, round((v - lag(v) OVER (PARTITION BY clip_key ORDER BY frame_index)) * fps, 4) + 0 AS acceleration FROM a""",
    "event_type_quantiles": "SELECT event_type, count(value) AS n, " + ", ".join(
        f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("low", 0.01), ("first_quarter", 0.25), ("middle", 0.5), ("last_quarter", 0.75), ("high", 0.99))) + " FROM events GROUP BY event_type",
    "frame_signals_3d": f"WITH {signals_sql(3, POSE_LONG)} SELECT clip_key, frame_number, {_digits(SIGNALS_3D, 4)} FROM g",
    "timeseries_time_s": f"""WITH {signals_sql(2)} SELECT clip_key, frame_number AS frame, round((frame_number - first_value(frame_number) OVER (PARTITION BY clip_key ORDER BY frame_index)) / fps, 6) AS time_s,
        round(wrist_distance, 6) AS wrist_distance FROM g""",
    "pose_window_features": f"WITH {window_features_sql(2)} SELECT clip_key, clip_id, is_reference, window_index, window_start_frame, n_frames, {_digits(_features(2), 4)} FROM feats",
    "pose_window_features_3d": f"WITH {window_features_sql(3)} SELECT clip_key, clip_id, is_reference, window_index, window_start_frame, n_frames, {_digits(_features(3), 3)} FROM feats",
    "dropna_features": f"WITH {window_features_sql(2)} SELECT clip_id, count(*) AS windows FROM feats WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _features(2)) + " GROUP BY clip_id",
    "channel_stats": f"WITH {weights_sql(2)} SELECT clip_id, channel, {_digits(['mean', 'std', 'raw_std'], 5)} FROM stats",
    "global_channel_scale": f"WITH {weights_sql(2)} SELECT channel, {_digits(['scale'], 5)} FROM scales",
    "channel_weights": f"WITH {weights_sql(2)} SELECT clip_id, channel, {_digits(['weight'], 5)} FROM weights",
    "channel_weights_3d": f"WITH {weights_sql(3)} SELECT clip_id, channel, {_digits(['weight'], 4)} FROM weights",
    "weight_report": f"WITH {weights_sql(2)} SELECT clip_id, channel, {_digits(['weight'], 5)}, (row_number() OVER (PARTITION BY clip_id ORDER BY weight DESC, channel))::INT AS place FROM weights",
    "bone_lengths": f"WITH {BONE_SAMPLES}, m AS (SELECT clip_key, mirror, {BONE_ROWS} FROM b GROUP BY ALL) SELECT clip_key, bone, n, median_m, std_m, cv FROM m JOIN names USING (mirror)",
    "bone_length_cv_report": f"WITH {BONE_SAMPLES}, m AS (SELECT clip_key, mirror, {BONE_ROWS} FROM b GROUP BY ALL) SELECT clip_key, bone, n, median_m, std_m, cv, (row_number() OVER (PARTITION BY clip_key ORDER BY cv DESC NULLS LAST, bone))::INT AS place FROM m JOIN names USING (mirror)",
    "depth_bilinear_sample": f"WITH {POSE} SELECT frame_number, round({_bilinear('((frame_number % 11) * 0.77::DOUBLE - 0.4::DOUBLE)', '((frame_number % 7) * 1.21::DOUBLE - 0.3::DOUBLE)')}, 6) AS depth_at FROM p",
    "depth_calibrate_scale": f"""WITH {SHOULDERS}, s AS (SELECT run, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) AS n, (dl + dr) / 2 AS z FROM q WHERE llik >= 0.5 AND rlik >= 0.5 AND dl > 0 AND dr > 0),
        m AS (SELECT run, count(*) AS n_samples, median(n * z) AS m FROM s WHERE n >= 1e-3 GROUP BY run)
        SELECT run, coalesce(n_samples, 0) AS n_samples, round(coalesce(0.4::DOUBLE * 8 / nullif(m, 0), 1), 6) AS depth_scale FROM (SELECT DISTINCT run FROM q) LEFT JOIN m USING (run)""",
    "backproject_lift": f"WITH {SHOULDERS} SELECT frame_number, round((lx - 4) * dl / 8, 6) + 0 AS x, round((ly - 4) * dl / 8, 6) + 0 AS y, round(dl, 6) + 0 AS z FROM q",
    "hand_outlier_flags": f"""WITH {HANDS}, c AS (SELECT frame_number, side, count(*) AS n, median(x) AS cx, median(y) AS cy, median(z) AS cz FROM h WHERE lik >= 0.05 GROUP BY ALL)
        SELECT frame_number, side, joint, coalesce(lik >= 0.05 AND n >= 2 AND joint <> 0 AND sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) > 0.15, false) AS outlier FROM h LEFT JOIN c USING (frame_number, side)""",
    "hand_bboxes": f"""WITH {HANDS}, {BOXES} SELECT frame_number, side, round(ax, 6) AS x, round(ay, 6) AS y, round(bx - ax, 6) AS size_x, round(high_y - ay, 6) AS size_y FROM z""",
    "hand_boxes_of_frames": f"""WITH {HANDS}, {BOXES}, n AS (SELECT frame_number, count(*) AS boxes, max(side) AS last_side FROM z WHERE frame_number % 6 <> 0 GROUP BY ALL)
        SELECT frame_number, coalesce(boxes, 0) AS boxes, last_side FROM p LEFT JOIN n USING (frame_number)""",
    "match_overlay_channels": f"""WITH {SIGNAL}, r AS (SELECT coalesce(avg(value), 0) AS m, CASE WHEN stddev_pop(value) > 1e-6 THEN stddev_pop(value) ELSE 1 END AS d FROM s WHERE clip_id = 'user_00010' AND is_reference),
        o AS (SELECT clip_key, (frame_index - 3) / 11 AS progress, value FROM s WHERE NOT is_reference AND frame_index BETWEEN 3 AND 14
          UNION ALL SELECT NULL, frame_index / nullif(count(*) OVER () - 1, 0), value FROM s WHERE clip_id = 'user_00010')
        SELECT 'user_00010' AS reference_id, clip_key, round(progress, 5) AS progress, round(coalesce((value - m) / d, 0), 5) + 0 AS value FROM o, r""",
    "person_frame_flatten": "WITH p AS (SELECT vec_id AS frame, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) " + " UNION ALL ".join(
        f"SELECT frame, {i} AS person_id, " + ", ".join(
            f"round_even(e[{o + 3 * j + 1}], 2) + 0 AS kpt{j}_x, round_even(e[{o + 3 * j + 2}], 2) + 0 AS kpt{j}_y, round_even(abs(e[{o + 3 * j + 3}]), 3) + 0 AS kpt{j}_score" for j in range(3)
        ) + " FROM p" for i, o in ((0, 0), (1, 9))),
}
