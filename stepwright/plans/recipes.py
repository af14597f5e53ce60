"""One query per standardization recipe: every dim of action and proprio against SQL written from the dataset's definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import standardize as S
from ..sources.steps import EVENT_STEPS, event_steps
from .base import query

#: Raw columns: element i is scale * a0 + i, the last one as told where that is an expression of the gripper a1.
RAW = {
    "action": (1, 8, "a1"),
    "state": (2, 15, "a1 / 2"),
    "world_vector": (3, 3, None),
    "rotation_delta": (4, 3, None),
    "open_gripper": (0, 1, "a1"),
    "gripper_closedness_action": (0, 1, "a1 * 2 - 1"),
    "rel_actions_world": (5, 7, "a1 * 2 - 0.5"),
    "robot_obs": (6, 15, "a1"),
    "robot_state": (7, 15, "a1"),
    "end_effector_cartesian_pos": (8, 7, "a1"),
    "cartesian_position": (9, 7, "a1"),
    "gripper_position": (10, 2, "a1"),
    "future_xyz": (11, 30, None),
    "future_axis_angle": (12, 30, None),
    "target_close": (13, 10, None),
    "end_effector_pose": (14, 7, "a1"),
    "ground_truth_states": (15, 6, None),
    "position": (16, 2, None),
    "yaw": (17, 1, None),
    "eef_pose": (18, 6, None),
    "state_gripper_pose": (19, 1, None),
    "tcp_base": (20, 7, None),
    "gripper": (21, 1, None),
    "state_tcp_base": (22, 7, None),
    "gripper_width": (23, 1, None),
    "cartesian_velocity": (0.01, 6, None),
    "state_cartesian": (0.02, 6, None),
    "state_gripper": (24, 1, None),
    "base_pose_tool_reached": (25, 7, None),
    "gripper_closed": (26, 1, None),
    "flat": (27, 2, None),
}
QUATERNION = "[sin(a1) * 0.6, sin(a1) * 0.8, 0.0::DOUBLE, cos(a1)]"
BLOBS = ("base_pose_tool_reached", "gripper_closed")


def elements(scale: float, width: int, last: str | None) -> list[str]:
    return [*(f"{scale} * a0 + {i}" for i in range(width - bool(last))), *([last] if last else [])]


VECTORS = ", ".join(f"[{', '.join(f'CAST({e} AS DOUBLE)' for e in elements(*x))}] AS {name}" for name, x in RAW.items())

#: The steps with all raw columns, the gripper rules over the episode, and the next step's a0.
STEPS = f"""{EVENT_STEPS},
marked AS (
  SELECT *, CASE WHEN a1 > 0.95 THEN 1.0 WHEN a1 < 0.05 THEN 0.0 END AS shut, CASE WHEN a1 * 2 - 1 < -0.1 THEN 1.0 WHEN a1 * 2 - 1 > 0.1 THEN -1.0 END AS move FROM steps),
wide AS (
  SELECT episode_id, t, n, text, a0, a1, {VECTORS},
    [CAST(a0 AS DOUBLE), a0 + 1, a0 + 2] AS arm, {QUATERNION} AS q,
    [CAST(coalesce(first_value(shut IGNORE NULLS) OVER after_, last_value(a1) OVER after_) AS DOUBLE)] AS binary_grip,
    [CAST(coalesce(last_value(move IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS UNBOUNDED PRECEDING), -first_value(move IGNORE NULLS) OVER after_, 1.0) / 2 + 0.5 AS DOUBLE)] AS absolute_grip,
    CAST((lead(a0) OVER (PARTITION BY episode_id ORDER BY t) - a0) * 2 AS DOUBLE) AS reached
  FROM marked WINDOW after_ AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

Z = "[0.0::DOUBLE]"
Z2, Z3, Z4, Z5 = (" || ".join([Z] * n) for n in (2, 3, 4, 5))
CLIPPED = "[1 - greatest(0, least(1, action[-1]))]"
WV = "world_vector || rotation_delta || "
EULER = "arm || [atan2(2 * (q[4] * q[1] + q[2] * q[3]), 1 - 2 * (q[1] ** 2 + q[2] ** 2)), asin(2 * (q[4] * q[2] - q[3] * q[1])), atan2(2 * (q[4] * q[3] + q[1] * q[2]), 1 - 2 * (q[2] ** 2 + q[3] ** 2))] || "
SIX_LAST = "state[1:6] || state[15:15]"
GRIPPER_OUT = "[1 - greatest(0, least(1, gripper_closedness_action[1]))]"

#: Dataset -> (action, its width, proprio, its width), lists in SQL, from 1.
EXPECTED = {
    "ppgm": ("action[1:6] || binary_grip", 7, "cartesian_position[1:6] || gripper_position[2:2]", 7),
    "kuka": (WV + "absolute_grip", 7, "base_pose_tool_reached::FLOAT[]::DOUBLE[] || gripper_closed::FLOAT[]::DOUBLE[]", 8),
    "taco_play": ("rel_actions_world[1:6] || [greatest(0, least(1, rel_actions_world[7]))]", 7, "robot_obs[1:6] || robot_obs[8:8]", 7),
    "jaco_play": (f"world_vector || {Z3} || absolute_grip", 7, "end_effector_cartesian_pos", 7),
    "berkeley_cable_routing": (WV + Z, 7, Z, 1),
    "roboturk": (WV + GRIPPER_OUT, 7, Z, 1),
    "nyu_door_opening": (WV + "absolute_grip", 7, Z, 1),
    "viola": (WV + GRIPPER_OUT, 7, Z, 1),
    "berkeley_autolab_ur5": (WV + "absolute_grip", 7, "robot_state[7:14]", 8),
    "toto": (WV + "open_gripper", 7, Z, 1),
    "pusht": (WV + "gripper_closedness_action", 7, Z, 1),
    "stanford_kuka_multimodal": (f"action[1:3] || {Z3} || action[8:8]", 7, Z, 1),
    "nyu_rot": ("action[1:7]", 7, SIX_LAST, 7),
    "stanford_hydra": ("action[1:6] || [1 - action[8]]", 7, "state[1:3] || state[8:10] || state[13:13]", 7),
    "austin_buds": (f"action[1:6] || {CLIPPED}", 7, "state[1:8]", 8),
    "nyu_franka_play": ("action[1:6] || [greatest(0, least(1, action[7]))]", 7, "state[10:15]", 6),
    "maniskill": ("action", 8, "state[8:8]", 1),
    "furniture_bench": (f"{EULER}{CLIPPED}", 7, "state[1:7] || state[15:15]", 8),
    "cmu_franka_exploration": ("action[1:7]", 7, Z, 1),
    "ucsd_kitchen": ("action[1:7]", 7, "state[1:7]", 7),
    "ucsd_pick_place": (f"action[1:3] || {Z3} || action[8:8]", 7, SIX_LAST, 7),
    "austin_sailor": (f"action[1:6] || {CLIPPED}", 7, Z, 1),
    "austin_sirius": (f"action[1:6] || {CLIPPED}", 7, Z, 1),
    "bc_z": ("future_xyz[1:3] || future_axis_angle[1:3] || [1 - target_close[1]]", 7, Z, 1),
    "tokyo_pr2_opening_fridge": ("action[1:7]", 7, SIX_LAST, 7),
    "tokyo_pr2_tabletop": ("action[1:7]", 7, SIX_LAST, 7),
    "utokyo_xarm_pick_place": ("action", 8, Z, 1),
    "utokyo_xarm_bimanual": ("action[2:8]", 7, Z, 1),
    "robo_net": (f"action[1:4] || {Z2} || action[8:8]", 7, f"state[1:4] || {Z2} || state[15:15]", 7),
    "berkeley_mvp": ("action", 8, Z, 1),
    "berkeley_rpt": ("action", 8, Z, 1),
    "kaist_nonprehensible": (f"action[1:6] || {Z}", 7, "state[9:15]", 7),
    "stanford_mask_vit": (f"action[1:4] || {Z2} || action[8:8]", 7, f"end_effector_pose[1:4] || {Z2} || end_effector_pose[7:7]", 7),
    "tokyo_lsmo": ("action", 8, SIX_LAST, 7),
    "dlr_sara_pour": ("action", 8, Z, 1),
    "dlr_sara_grid_clamp": ("action", 8, "state[1:6]", 6),
    "dlr_edan_shared_control": ("action[1:6] || [1 - action[8]]", 7, Z, 1),
    "asu_table_top": ("action", 8, "ground_truth_states || state[15:15]", 7),
    "robocook": ("action", 8, SIX_LAST, 7),
    "imperial_wristcam": ("action[1:7]", 7, Z, 1),
    "iamlab_pick_insert": (f"{EULER}[a1]", 7, "state[1:8]", 8),
    "uiuc_d3field": (f"world_vector || {Z4}", 7, Z, 1),
    "utaustin_mutex": (f"action[1:6] || {CLIPPED}", 7, "state[1:8]", 8),
    "berkeley_fanuc": ("action || [1 - state[7]]", 9, "state[1:7]", 7),
    "cmu_playing_with_food": (f"{EULER}[a1]", 7, Z, 1),
    "playfusion": ("action[1:3] || action[5:8]", 7, Z, 1),
    "cmu_stretch": ("action[1:7]", 7, f"state[1:3] || {Z3} || state[15:15]", 7),
    "gnm": (f"flat || {Z5}", 7, f"position || {Z3} || yaw", 6),
    "fmb": ("action", 8, "eef_pose || state_gripper_pose", 7),
    "dobbe": ("action", 8, "state", 15),
    "roboset": (f"action[1:7] || {CLIPPED}", 8, "state", 15),
    "rh20t": ("tcp_base || gripper", 8, "state_tcp_base || gripper_width", 8),
    "tdroid": ("action[1:6] || binary_grip", 7, "cartesian_position[1:6] || gripper_position[2:2]", 7),
    "droid_finetuning": ("cartesian_velocity || [1 - gripper_position[1]]", 7, "state_cartesian || state_gripper", 7),
    "aloha": ("action", 8, Z, 1),
}
#: Recipes whose raw action is another of the columns.
ACTIONS = {"uiuc_d3field": "world_vector", "gnm": "flat", **dict.fromkeys(("furniture_bench", "iamlab_pick_insert", "cmu_playing_with_food"), "quaternion_action")}
ONE_GRIPPER = ("droid_finetuning", "droid_wristact")


def dims(action: int, proprio: int) -> list[tuple[str, str, int]]:
    return [*((f"a{i}", "action", i) for i in range(action)), *((f"p{i}", "proprio", i) for i in range(proprio))]


def sql_of(action: str, n_action: int, proprio: str, n_proprio: int, where: str = "", t: str = "t") -> str:
    columns = ", ".join(f"round(made_{v}[{i + 1}], 4) AS {name}" for name, v, i in dims(n_action, n_proprio))
    return f"WITH {STEPS}, made AS (SELECT episode_id, {t} AS t, {action} AS made_action, {proprio} AS made_proprio FROM wide {where}) SELECT episode_id, CAST(t AS INT) AS t, CAST(len(made_action) AS INT) AS n_action, CAST(len(made_proprio) AS INT) AS n_proprio, {columns} FROM made"


def raw_steps(spark, sf_dir, name: str):
    steps = event_steps(spark, sf_dir).withColumns({"a0": F.col("action")[0], "a1": F.col("action")[1]})
    wide = steps.withColumns({c: F.array(*[F.expr(e).cast("double") for e in elements(*x)]) for c, x in RAW.items()})
    q = F.array(F.sin("a1") * 0.6, F.sin("a1") * 0.8, F.lit(0.0), F.cos("a1"))
    wide = wide.withColumn("quaternion_action", F.concat(F.slice("action", 1, 3), q, F.slice("action", 8, 1)))
    wide = wide.withColumn("natural_language_instruction", F.col("language_instruction")).withColumn("action", F.col(ACTIONS.get(name, "action")))
    if name in ONE_GRIPPER:
        wide = wide.withColumn("gripper_position", F.slice("gripper_position", 1, 1))
    if name == "kuka":
        wide = wide.withColumns({c: packed()(F.col(c)) for c in BLOBS})
    return wide


def packed():
    """An array as a ZLIB blob of 32-bit floats, the form in which some datasets store their states."""

    @F.pandas_udf("binary")
    def pack(vectors):
        import zlib

        import numpy as np

        return vectors.map(lambda v: zlib.compress(np.asarray(v, "<f4").tobytes()))

    return pack


def register(name: str, n_action: int, n_proprio: int, sql: str) -> None:
    @query(f"std_{name}", sql)
    def run(spark, sf_dir):
        s = S.standardize(raw_steps(spark, sf_dir, name), name)
        return s.select("episode_id", "t", F.size("action").alias("n_action"), F.size("proprio").alias("n_proprio"), *[F.round(F.col(v)[i], 4).alias(c) for c, v, i in dims(n_action, n_proprio)])


for _name, (_action, _n, _proprio, _m) in EXPECTED.items():
    register(_name, _n, _m, sql_of(_action, _n, _proprio, _m))

register("bridge_oxe", 7, 7, sql_of("[reached, reached, reached, reached, reached, reached] || open_gripper", 7, SIX_LAST, 7, "WHERE t >= 1 AND reached IS NOT NULL", "t - 1"))


# ---------------------------------------------------------------- the wrist's frame
#: rows of yaw after pitch after roll of the angles x, y, z
def rotation_sql(x: str, y: str, z: str) -> list[list[str]]:
    return [
        [f"cos({z}) * cos({y})", f"(cos({z}) * sin({y}) * sin({x}) - sin({z}) * cos({x}))", f"(cos({z}) * sin({y}) * cos({x}) + sin({z}) * sin({x}))"],
        [f"sin({z}) * cos({y})", f"(sin({z}) * sin({y}) * sin({x}) + cos({z}) * cos({x}))", f"(sin({z}) * sin({y}) * cos({x}) - cos({z}) * sin({x}))"],
        [f"(-sin({y}))", f"cos({y}) * sin({x})", f"cos({y}) * cos({x})"],
    ]


def wrist_sql(velocity: str, pose: str) -> tuple[str, str]:
    """(columns f00 to f22 and r00 to r22 of the two rotations, the nine dims made of them)."""
    f = rotation_sql(f"{pose}[4]", f"{pose}[5]", f"{pose}[6]")
    r = rotation_sql(f"{velocity}[4]", f"{velocity}[5]", f"{velocity}[6]")
    columns = ", ".join(f"{m[i][j]} AS {k}{i}{j}" for k, m in (("f", f), ("r", r)) for i in range(3) for j in range(3))
    moved = [" + ".join(f"f{k}{i} * {velocity}[{k + 1}]" for k in range(3)) for i in range(3)]
    turned = [" + ".join(f"f{k}{i} * r{k}{m} * f{m}{j}" for k in range(3) for m in range(3)) for i in range(2) for j in range(3)]
    return columns, f"[{', '.join([*moved, *turned])}]"


_columns, _nine = wrist_sql("cartesian_velocity", "state_cartesian")
register("droid_wristact", 10, 7, sql_of(f"{_nine} || gripper_position[1:1]", 10, "state_cartesian || state_gripper", 7).replace("made AS (", f"turned AS (SELECT *, {_columns} FROM wide), made AS (").replace("FROM wide )", "FROM turned)"))
