"""Raw tables to standard steps: recipes as configuration, one engine that turns them into projections."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import pad_to
from ..functions.rotations import quaternion_to_euler, wrist_frame
from . import windows as W

Transform = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- parts of a vector
@dataclass(frozen=True)
class Part:
    """Elements begin to end (Python slice rules) of a raw column, or zeros, changed by `how`.

    how: "" as it is, "clip" to [0, 1], "invert" 1 - x, "invert_clip" 1 - clip(x), "binarize" and "absolute" the
    gripper rules that look along the episode, "euler" a quaternion (x, y, z, w) to roll, pitch and yaw, "zeros"
    and "ones" constants of width `end`.
    """

    column: str = "action"
    begin: int = 0
    end: int | None = None
    how: str = ""


def cut(c: Column, begin: int, end: int | None) -> Column:
    n = F.size(c)
    first = F.lit(begin) if begin >= 0 else n + begin
    last = n if end is None else F.lit(end) if end >= 0 else n + end
    return F.slice(c, first + 1, F.greatest(F.lit(0), last - first))


def part(p: Part) -> Column:
    if p.how in ("zeros", "ones"):
        return F.array_repeat(F.lit(1.0 if p.how == "ones" else 0.0), p.end or 1)
    v = cut(F.col(p.column), p.begin, p.end)
    if "clip" in p.how:
        v = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    if p.how == "euler":
        v = quaternion_to_euler(v)
    if p.how.startswith("invert"):
        v = F.transform(v, lambda x: F.lit(1.0) - x)
    return v


@dataclass(frozen=True)
class Recipe:
    """How a dataset's raw steps become standard ones."""

    action: tuple[Part, ...] = (Part(),)
    proprio: tuple[Part, ...] = ()
    text: str = "language_instruction"
    drop_first: bool = False
    relabel: int = 0  # leading state dims whose reached change replaces the action's
    before: tuple[Transform, ...] = field(default=())  # on the raw steps
    extra: tuple[Transform, ...] = field(default=())  # on the standard ones


def _inflated(*columns: str) -> Transform:
    """ZLIB blobs of 32-bit floats as arrays of doubles."""
    from .stages import unpacked_floats

    return lambda df: reduce(lambda d, c: unpacked_floats(d, c, c).withColumn(c, F.col(c).cast("array<double>")), columns, df)


def _in_wrist_frame(velocity: str, pose: str) -> Transform:
    return lambda df: df.withColumn("wrist_velocity", wrist_frame(F.col(velocity), F.col(pose)))


def _wv(g: Part) -> tuple[Part, ...]:
    return (Part("world_vector"), Part("rotation_delta"), g)


_NL = "natural_language_instruction"
_S = "state"
_clip_inv = (Part(end=6), Part(begin=-1, how="invert_clip"))

#: What each dataset's raw columns are made of. Datasets of equal recipes share an entry.
RECIPES: dict[str, Recipe] = {
    "bridge_oxe": Recipe(_wv(Part("open_gripper")), (Part(_S, 0, 6), Part(_S, -1)), _NL, True, 6),
    "bridge_orig": Recipe((Part(end=6), Part(begin=-1, how="binarize")), (Part(_S, 0, 6), Part(_S, -1)), drop_first=True, relabel=6),
    "ppgm": Recipe((Part(end=6), Part(begin=-1, how="binarize")), (Part("cartesian_position", 0, 6), Part("gripper_position", -1))),
    "rt1": Recipe(_wv(Part("gripper_closedness_action", how="absolute")), (), _NL),
    "kuka": Recipe(_wv(Part("gripper_closedness_action", how="absolute")), (Part("base_pose_tool_reached"), Part("gripper_closed")), _NL, before=(_inflated("base_pose_tool_reached", "gripper_closed"),)),
    "taco_play": Recipe((Part("rel_actions_world", 0, 6), Part("rel_actions_world", -1, how="clip")), (Part("robot_obs", 0, 6), Part("robot_obs", 7, 8)), _NL),
    "jaco_play": Recipe((Part("world_vector"), Part(end=3, how="zeros"), Part("gripper_closedness_action", how="absolute")), (Part("end_effector_cartesian_pos", 0, 6), Part("end_effector_cartesian_pos", -1)), _NL),
    "berkeley_cable_routing": Recipe(_wv(Part(end=1, how="zeros")), (), _NL),
    "roboturk": Recipe(_wv(Part("gripper_closedness_action", how="invert_clip")), (), _NL),
    "nyu_door_opening": Recipe(_wv(Part("gripper_closedness_action", how="absolute")), (), _NL),
    "viola": Recipe(_wv(Part("gripper_closedness_action", how="invert_clip")), (), _NL),
    "berkeley_autolab_ur5": Recipe(_wv(Part("gripper_closedness_action", how="absolute")), (Part("robot_state", 6, 14),), _NL),
    "toto": Recipe(_wv(Part("open_gripper")), (), _NL),
    "language_table": Recipe((Part(), Part(end=2, how="zeros"), Part(end=2, how="zeros"), Part(end=1, how="ones"))),
    "pusht": Recipe(_wv(Part("gripper_closedness_action")), (), _NL),
    "stanford_kuka_multimodal": Recipe((Part(end=3), Part(end=3, how="zeros"), Part(begin=-1))),
    "nyu_rot": Recipe((Part(end=7),), (Part(_S, 0, 6), Part(_S, -1))),
    "stanford_hydra": Recipe((Part(end=6), Part(begin=-1, how="invert")), (Part(_S, 0, 3), Part(_S, 7, 10), Part(_S, -3, -2))),
    "austin_buds": Recipe(_clip_inv, (Part(_S, 0, 8),)),
    "nyu_franka_play": Recipe((Part(begin=-8, end=-2), Part(begin=-2, end=-1, how="clip")), (Part(_S, -6),)),
    "maniskill": Recipe(proprio=(Part(_S, 7, 8),)),
    "furniture_bench": Recipe((Part(end=3), Part(begin=3, end=7, how="euler"), Part(begin=-1, how="invert_clip")), (Part(_S, 0, 7), Part(_S, -1))),
    "cmu_franka_exploration": Recipe((Part(end=-1),)),
    "ucsd_kitchen": Recipe((Part(end=-1),), (Part(_S, 0, 7),)),
    "ucsd_pick_place": Recipe((Part(end=3), Part(end=3, how="zeros"), Part(begin=-1)), (Part(_S, 0, 6), Part(_S, -1))),
    "austin_sailor": Recipe(_clip_inv),
    "austin_sirius": Recipe(_clip_inv),
    "bc_z": Recipe((Part("future_xyz", 0, 3), Part("future_axis_angle", 0, 3), Part("target_close", 0, 1, "invert")), (), _NL),
    "tokyo_pr2_opening_fridge": Recipe((Part(end=-1),), (Part(_S, 0, 6), Part(_S, -1))),
    "tokyo_pr2_tabletop": Recipe((Part(end=-1),), (Part(_S, 0, 6), Part(_S, -1))),
    "utokyo_xarm_pick_place": Recipe(),
    "utokyo_xarm_bimanual": Recipe((Part(begin=-7),)),
    "robo_net": Recipe((Part(end=4), Part(end=2, how="zeros"), Part(begin=-1)), (Part(_S, 0, 4), Part(end=2, how="zeros"), Part(_S, -1))),
    "berkeley_mvp": Recipe(),
    "berkeley_rpt": Recipe(),
    "kaist_nonprehensible": Recipe((Part(end=6), Part(end=1, how="zeros")), (Part(_S, -7),)),
    "stanford_mask_vit": Recipe((Part(end=4), Part(end=2, how="zeros"), Part(begin=-1)), (Part("end_effector_pose", 0, 4), Part(end=2, how="zeros"), Part("end_effector_pose", -1))),
    "tokyo_lsmo": Recipe(proprio=(Part(_S, 0, 6), Part(_S, -1))),
    "dlr_sara_pour": Recipe(),
    "dlr_sara_grid_clamp": Recipe(proprio=(Part(_S, 0, 6),)),
    "dlr_edan_shared_control": Recipe((Part(end=6), Part(begin=-1, how="invert"))),
    "asu_table_top": Recipe(proprio=(Part("ground_truth_states"), Part(_S, -1))),
    "robocook": Recipe(proprio=(Part(_S, 0, 6), Part(_S, -1))),
    "imperial_wristcam": Recipe((Part(end=-1),)),
    "iamlab_pick_insert": Recipe((Part(end=3), Part(begin=3, end=7, how="euler"), Part(begin=7, end=8)), (Part(_S, 0, 7), Part(_S, 7, 8))),
    "uiuc_d3field": Recipe((Part(), Part(end=3, how="zeros"), Part(end=1, how="zeros"))),
    "utaustin_mutex": Recipe(_clip_inv, (Part(_S, 0, 8),)),
    "berkeley_fanuc": Recipe((Part(), Part(_S, 6, 7, how="invert")), (Part(_S, 0, 6), Part(_S, 6, 7))),
    "cmu_playing_with_food": Recipe((Part(end=3), Part(begin=3, end=7, how="euler"), Part(begin=-1))),
    "playfusion": Recipe((Part(end=3), Part(begin=-4))),
    "cmu_stretch": Recipe((Part(end=-1),), (Part(_S, 0, 3), Part(end=3, how="zeros"), Part(_S, -1))),
    "gnm": Recipe((Part(), Part(end=4, how="zeros"), Part(end=1, how="zeros")), (Part("position"), Part(end=3, how="zeros"), Part("yaw"))),
    "fmb": Recipe(proprio=(Part("eef_pose"), Part("state_gripper_pose"))),
    "dobbe": Recipe(proprio=(Part(_S),)),
    "roboset": Recipe((Part(end=7), Part(begin=-1, how="invert_clip")), (Part(_S),)),
    "rh20t": Recipe((Part("tcp_base"), Part("gripper")), (Part("state_tcp_base"), Part("gripper_width"))),
    "tdroid": Recipe((Part(end=6), Part(begin=-1, how="binarize")), (Part("cartesian_position", 0, 6), Part("gripper_position", -1))),
    "libero": Recipe(_clip_inv, (Part(_S, 0, 6), Part(_S, -2))),
    "droid_baseact": Recipe((Part("cartesian_velocity"), Part("gripper_position", how="invert")), (Part("state_cartesian"), Part("state_gripper"))),
    "droid_wristact": Recipe((Part("wrist_velocity"), Part("gripper_position")), (Part("state_cartesian"), Part("state_gripper")), before=(_in_wrist_frame("cartesian_velocity", "state_cartesian"),)),
    "droid_finetuning": Recipe((Part("cartesian_velocity"), Part("gripper_position", how="invert")), (Part("state_cartesian"), Part("state_gripper"))),
    "aloha": Recipe(),
}

_CONVERTED = "_converted_externally_to_rlds"
#: Names under which datasets are published, where they are not their recipe's.
ALIASES: dict[str, str] = {
    "bridge_dataset": "bridge_orig",
    "ppgm_static": "ppgm",
    "ppgm_wrist": "ppgm",
    "fractal20220817_data": "rt1",
    "nyu_door_opening_surprising_effectiveness": "nyu_door_opening",
    "columbia_cairlab_pusht_real": "pusht",
    f"stanford_kuka_multimodal_dataset{_CONVERTED}": "stanford_kuka_multimodal",
    f"nyu_rot_dataset{_CONVERTED}": "nyu_rot",
    f"stanford_hydra_dataset{_CONVERTED}": "stanford_hydra",
    f"austin_buds_dataset{_CONVERTED}": "austin_buds",
    f"nyu_franka_play_dataset{_CONVERTED}": "nyu_franka_play",
    f"maniskill_dataset{_CONVERTED}": "maniskill",
    f"furniture_bench_dataset{_CONVERTED}": "furniture_bench",
    f"cmu_franka_exploration_dataset{_CONVERTED}": "cmu_franka_exploration",
    f"ucsd_kitchen_dataset{_CONVERTED}": "ucsd_kitchen",
    f"ucsd_pick_and_place_dataset{_CONVERTED}": "ucsd_pick_place",
    f"austin_sailor_dataset{_CONVERTED}": "austin_sailor",
    f"austin_sirius_dataset{_CONVERTED}": "austin_sirius",
    f"utokyo_pr2_opening_fridge{_CONVERTED}": "tokyo_pr2_opening_fridge",
    f"utokyo_pr2_tabletop_manipulation{_CONVERTED}": "tokyo_pr2_tabletop",
    f"utokyo_xarm_pick_and_place{_CONVERTED}": "utokyo_xarm_pick_place",
    f"utokyo_xarm_bimanual{_CONVERTED}": "utokyo_xarm_bimanual",
    f"berkeley_mvp{_CONVERTED}": "berkeley_mvp",
    f"berkeley_rpt{_CONVERTED}": "berkeley_rpt",
    f"kaist_nonprehensile{_CONVERTED}": "kaist_nonprehensible",
    f"stanford_mask_vit{_CONVERTED}": "stanford_mask_vit",
    f"tokyo_u_lsmo{_CONVERTED}": "tokyo_lsmo",
    f"dlr_sara_pour{_CONVERTED}": "dlr_sara_pour",
    f"dlr_sara_grid_clamp{_CONVERTED}": "dlr_sara_grid_clamp",
    f"dlr_edan_shared_control{_CONVERTED}": "dlr_edan_shared_control",
    f"asu_table_top{_CONVERTED}": "asu_table_top",
    f"stanford_robocook{_CONVERTED}": "robocook",
    "imperialcollege_sawyer_wrist_cam": "imperial_wristcam",
    f"iamlab_cmu_pickup_insert{_CONVERTED}": "iamlab_pick_insert",
    "berkeley_fanuc_manipulation": "berkeley_fanuc",
    "cmu_play_fusion": "playfusion",
    "berkeley_gnm_recon": "gnm",
    "berkeley_gnm_cory_hall": "gnm",
    "berkeley_gnm_sac_son": "gnm",
    "droid": "droid_baseact",
    "fmb_dataset": "fmb",
    "droid_wipe": "droid_finetuning",
    "libero_spatial_no_noops": "libero",
    "libero_object_no_noops": "libero",
    "libero_goal_no_noops": "libero",
    "libero_10_no_noops": "libero",
    "libero_4_task_suites_no_noops": "libero",
}


def recipe_of(name: str) -> Recipe:
    """The recipe of a dataset by its own or a published name; tdroid_ and aloha1_ datasets share one each."""
    key = ALIASES.get(name, name)
    for family in ("tdroid", "aloha"):
        if key not in RECIPES and key.startswith((f"{family}_", f"{family}1_")):
            key = family
    if key not in RECIPES:
        raise KeyError(f"no recipe for dataset {name}")
    return RECIPES[key]


def standardize(steps: DataFrame, name: str) -> DataFrame:
    """Standard steps of a dataset's raw ones (dataset_name, episode_id, t, n and the recipe's columns).

    Everything is a projection; only gripper rules and relabelling look along the episode, all over one window.
    """
    r = recipe_of(name)
    out = reduce(lambda d, f: d.transform(f), r.before, W.drop_first(steps) if r.drop_first else steps)
    for i, p in enumerate(r.action):
        if p.how in ("binarize", "absolute"):
            rule = W.binarize_gripper if p.how == "binarize" else W.relative_to_absolute_gripper
            out = rule(out, cut(F.col(p.column), p.begin, p.end)[0], f"__grip{i}")
    made = [F.array(F.col(f"__grip{i}").cast("double")) if p.how in ("binarize", "absolute") else part(p) for i, p in enumerate(r.action)]
    state = F.concat(*[part(p) for p in r.proprio]) if r.proprio else F.array(F.lit(0.0))
    keep = [c for c in out.columns if c not in ("action", "proprio", "language_instruction") and not c.startswith("__grip")]
    text = F.col(r.text) if r.text in out.columns else F.lit("")
    out = out.select(*keep, F.concat(*made).alias("action"), state.alias("proprio"), text.alias("language_instruction"))
    if r.relabel:
        reached = F.zip_with(F.slice(F.lead("proprio").over(W.episode_window()), 1, r.relabel), F.slice("proprio", 1, r.relabel), lambda a, b: a - b)
        last = F.slice("action", F.lit(r.relabel + 1), F.size("action") - r.relabel)
        out = out.withColumn("__reached", reached).where(F.col("__reached").isNotNull()).withColumn("action", F.concat("__reached", last)).drop("__reached")
    return reduce(lambda d, f: d.transform(f), r.extra, out)


# ---------------------------------------------------------------- columns by path, pattern and request
def restructure(raw: DataFrame, dataset: str, images: Mapping[str, str | None], states: Sequence[str | None], text: str | None) -> DataFrame:
    """image_<name> columns ("" where a view is None), proprio from the states in order (None: one zero), text and dataset name."""
    missing = [c for c in [*images.values(), *states, text] if c and c not in raw.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    views = [(F.col(c) if c else F.lit("")).alias(f"image_{k}") for k, c in images.items()]
    parts = [F.col(c) if c else F.array(F.lit(0.0)) for c in states]
    return raw.select("episode_id", "t", "n", "action", *views, F.concat(*parts).alias("proprio"), (F.col(text) if text else F.lit("")).alias("language_instruction"), F.col("t").alias("timestep"), F.lit(dataset).alias("dataset_name"))


def repack(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """New names for nested fields given by path."""
    return df.select(*[F.col(path.replace("/", ".")).alias(name) for name, path in paths.items()])


def renamed(df: DataFrame, patterns: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Rename or drop (None) columns by the first pattern that matches the whole name; clashes are errors."""
    out: dict[str, str] = {}
    for c in df.columns:
        target: str | None = c
        for pattern, new in patterns:
            if m := re.fullmatch(pattern, c):
                target = m.expand(new) if new is not None else None
                break
        if target is None:
            continue
        if target in out:
            raise ValueError(f"{c} and {out[target]} would both be {target}")
        out[target] = c
    for a in out:
        for b in out:
            if b.startswith(f"{a}/"):
                raise ValueError(f"{a} would be both a column and the parent of {b}")
    return df.select(*[F.col(f"`{c}`").alias(t) for t, c in out.items()])


def policy_inputs(df: DataFrame, states: Sequence[Column], cameras: Mapping[str, str | None], size: int) -> DataFrame:
    """state padded to `size`, one column per camera slot and a mask of the slots that hold a view."""
    views = {k: F.col(c) if c else F.lit(None).cast("string") for k, c in cameras.items()}
    return df.withColumns({"state": pad_to(F.concat(*states), size), **{k: v for k, v in views.items()}, **{f"{k}_mask": v.isNotNull() for k, v in views.items()}})


def optional_columns(df: DataFrame, columns: Mapping[str, T.DataType]) -> DataFrame:
    """Columns that may be absent, as nulls of their type where they are."""
    return df.withColumns({c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in columns.items()})


def composed(*groups: Sequence[Transform]) -> Transform:
    """Transforms in order: repack, data, normalize, model."""
    return lambda df: reduce(lambda d, f: f(d), [f for g in groups for f in g], df)


def map_columns(df: DataFrame, chosen: Callable[[str], bool], f: Callable[[Column], Column]) -> DataFrame:
    """f applied to every leaf whose path (names joined by "/", through any depth of structs) is chosen; all else stays."""

    def walked(c: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StructType):
            inner = F.struct(*[walked(c.getField(x.name), x.dataType, f"{path}/{x.name}").alias(x.name) for x in kind.fields])
            return F.when(c.isNotNull(), inner)
        return f(c) if chosen(path) else c

    return df.select(*[walked(F.col(f"`{x.name}`"), x.dataType, x.name).alias(x.name) for x in df.schema.fields])
