"""Gripper conventions and the frames of a two-armed robot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bounded


def to_signed(x: Column, binarize: bool = True) -> Column:
    """[0, 1] to [-1, 1], made a sign if asked for."""
    y = x * 2 - 1
    return F.signum(y) if binarize else y


def inverted(x: Column) -> Column:
    return F.lit(1.0) - x


def thresholded(x: Column) -> Column:
    """1 above zero, else -1."""
    return F.when(x > 0, 1.0).otherwise(-1.0)


#: Linear gripper opening in metres, its angles in radians, the arm and horn of its linkage,
#: and the sign of each joint of an arm.
OPENING = (0.01844, 0.05800)
ANGLES = (0.4, 1.5)
ANGLES_OUT = (-0.6213, 1.4910)
ARM, HORN = 0.036, 0.022
JOINT_SIGNS = (1, -1, -1, 1, 1, 1, 1)


def linear_to_angular(x: Column) -> Column:
    """Normalized opening to normalized angle, through the linkage."""
    metres = x * (OPENING[1] - OPENING[0]) + OPENING[0]
    value = (F.lit(HORN**2 - ARM**2) + metres * metres) / (metres * (2 * HORN))
    angle = F.asin(bounded(value, -1.0, 1.0))
    return (angle - ANGLES[0]) / (ANGLES[1] - ANGLES[0])


def angular_to_commanded(x: Column) -> Column:
    """Normalized angle to the range that commands use."""
    radians = x * (ANGLES[1] - ANGLES[0]) + ANGLES[0]
    return (radians - ANGLES_OUT[0]) / (ANGLES_OUT[1] - ANGLES_OUT[0])


def commanded_to_angular(x: Column) -> Column:
    radians = x * (ANGLES_OUT[1] - ANGLES_OUT[0]) + ANGLES_OUT[0]
    return (radians - ANGLES[0]) / (ANGLES[1] - ANGLES[0])


def flipped_joints(x: Column) -> Column:
    """Signs of both arms' joints turned to the other convention; its own inverse."""
    signs = F.array(*[F.lit(float(s)) for s in JOINT_SIGNS * 2])
    return F.zip_with(x, signs, lambda v, s: v * s)


