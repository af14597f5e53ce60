"""Rotations as column arithmetic: quaternions, Euler angles, axis-angle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quaternion_to_axis_angle(q: Column) -> Column:
    """(x, y, z, w) to axis times angle; w is clipped to [-1, 1] and a rotation near zero gives zeros."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3]))
    size = F.sqrt(F.lit(1.0) - w * w)
    angle = F.acos(w) * 2
    return F.when(size < 1e-8, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(*[q[i] * angle / size for i in range(3)]))


def quaternion_to_euler(q: Column) -> Column:
    """(x, y, z, w) to roll, pitch and yaw about fixed x, y and z."""
    x, y, z, w = (q[i] for i in range(4))
    roll = F.atan2((w * x + y * z) * 2, F.lit(1.0) - (x * x + y * y) * 2)
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (w * y - z * x) * 2)))
    yaw = F.atan2((w * z + x * y) * 2, F.lit(1.0) - (y * y + z * z) * 2)
    return F.array(roll, pitch, yaw)


def unit(q: Column) -> Column:
    size = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(q, lambda v: v / size)


def euler_matrix(e: Column) -> Column:
    """Roll, pitch and yaw to the nine elements, by rows, of yaw after pitch after roll."""
    (cr, cp, cy), (sr, sp, sy) = (F.cos(e[i]) for i in range(3)), (F.sin(e[i]) for i in range(3))
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def product(a: Column, b: Column, width: int, turned: bool = False) -> Column:
    """The 3 x 3 matrix a, or its transpose, times the 3 x `width` matrix b, both by rows."""
    at = (lambda i, k: a[3 * k + i]) if turned else (lambda i, k: a[3 * i + k])
    return F.array(*[sum((at(i, k) * b[width * k + j] for k in range(1, 3)), at(i, 0) * b[j]) for i in range(3) for j in range(width)])


def wrist_frame(velocity: Column, pose: Column) -> Column:
    """A base-frame velocity of six dims in the frame of the wrist, whose Euler angles are the pose's last three.

    Translation, then the first two rows of the turned rotation: nine dims.
    """
    one = F.transform(F.array(F.struct(velocity.alias("v"), euler_matrix(F.slice(pose, 4, 3)).alias("f"), euler_matrix(F.slice(velocity, 4, 3)).alias("r"))), lambda x: F.struct(x["v"].alias("v"), x["f"].alias("f"), product(x["r"], x["f"], 3).alias("rf")))
    return F.transform(one, lambda x: F.concat(product(x["f"], x["v"], 1, True), F.slice(product(x["f"], x["rf"], 3, True), 1, 6)))[0]
