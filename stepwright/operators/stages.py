"""Sticky grippers, and stages that work on Arrow batches in Python: images, text ratios, scorers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import matching_ratio
from ..sources.steps import EPISODE, episode_window


# ---------------------------------------------------------------- gripper with memory
def sticky_gripper(steps: DataFrame, value: Column, repeats: int, jump: float = 0.5) -> DataFrame:
    """dataset_name, episode_id, t, gripper: a change of more than `jump` is sent for `repeats` steps, clipped to [-1, 1]; else 0.

    Changes that come while one is being sent are lost. So the changes that count are picked along an episode's
    jumps alone (a fold over their times), and a frame of `repeats` rows then finds the one that a step sends.
    """
    change = F.lag("__g").over(episode_window()) - F.col("__g")
    moved = steps.select(*EPISODE, "t", value.cast("double").alias("__g")).select(*EPISODE, "t", change.alias("__change"))
    jumps = moved.where(F.abs("__change") > jump).groupBy(*EPISODE).agg(F.sort_array(F.collect_list(F.struct("t", F.col("__change").alias("sent")))).alias("jumps"))
    none = F.struct(F.lit(-1).alias("free"), F.slice("jumps", 1, 0).alias("kept"))
    picked = F.aggregate("jumps", none, lambda s, x: F.when(x["t"] >= s["free"], F.struct((x["t"] + repeats).alias("free"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s))
    starts = jumps.select(*EPISODE, F.explode(picked["kept"]).alias("s")).select(*EPISODE, "s.t", "s.sent")
    sending = F.last("sent", ignorenulls=True).over(episode_window().rowsBetween(1 - repeats, 0))
    limited = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sending))
    return moved.join(starts, [*EPISODE, "t"], "left").select(*EPISODE, "t", F.when(sending.isNotNull(), limited).otherwise(0.0).alias("gripper"))


def unpacked_floats(df: DataFrame, column: str, out: str) -> DataFrame:
    """A ZLIB blob of little-endian 32-bit floats as an array."""
    @F.pandas_udf("array<float>")
    def unpack(blobs):
        return blobs.map(lambda b: None if b is None else np.frombuffer(zlib.decompress(b), "<f4").tolist())

    return df.withColumn(out, unpack(F.col(column)))


def text_of_codes(codes: Column) -> Column:
    """Code points up to the first zero as text."""
    end = F.array_position(codes, 0)
    used = F.when(end > 0, F.slice(codes, F.lit(1), F.greatest(F.lit(0), (end - 1).cast("int")))).otherwise(codes)
    return F.array_join(F.transform(used, lambda c: F.char(c)), "")


# ---------------------------------------------------------------- images as (height, width, pixels) rows
def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """HWC image sampled at pixel centres with linear weights."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    image = image.astype(float)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def resize_with_pad(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The largest copy of the image that fits the frame, its sides rounded down, in the middle of black."""
    shrink = max(image.shape[0] / height, image.shape[1] / width)
    fitted = resize_bilinear(image, *(max(1, int(side / shrink)) for side in image.shape[:2]))
    room = [(frame - side) for frame, side in zip((height, width), fitted.shape)]
    return np.pad(fitted, [*((r // 2, r - r // 2) for r in room), (0, 0)])


def as_uint8_hwc(image: np.ndarray) -> np.ndarray:
    """Channels last, 8 bits, three channels; floats are taken as 0 to 1."""
    if image.ndim == 3 and image.shape[0] in (1, 3, 4) and image.shape[2] not in (1, 3, 4):
        image = image.transpose(1, 2, 0)
    if np.issubdtype(image.dtype, np.floating):
        image = np.rint(np.clip(image, 0, 1) * 255)
    image = image.astype(np.uint8)
    return image.repeat(3, axis=2) if image.shape[2] == 1 else image[:, :, :3]


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG file of eight bits and no interlace: gray, gray and alpha, RGB or RGBA."""
    at, body, head = 8, [], b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or channels is None or head[12]:
        raise ValueError("only PNG files of eight bits, without palette and interlace, are decoded")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # a row above and a pixel on the left of zeros
    for y in range(height):
        line, above, now = rows[y, 1:].reshape(width, channels).astype(np.int32), out[y], out[y + 1]
        if rows[y, 0] in (0, 2):
            now[1:] = line + (above[1:] if rows[y, 0] == 2 else 0) & 255
        elif rows[y, 0] == 1:
            now[1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(1, width + 1):
                a, b, c = now[x - 1], above[x], above[x - 1]
                if rows[y, 0] == 3:
                    guess = (a + b) // 2
                else:  # of left, above and above left, the one nearest to left + above - above left
                    near = np.abs(np.stack([b - c, a - c, a + b - 2 * c]))
                    guess = np.choose(near.argmin(0), [a, b, c])
                now[x] = line[x - 1] + guess & 255
    return out[1:, 1:].astype(np.uint8)


def decoded(data: bytes) -> np.ndarray:
    """Pixels of an encoded image: PNG here, other kinds by Pillow where it is installed."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        image = png_pixels(data)
        return image[:, :, :1] if image.shape[2] == 2 else image
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("images other than PNG need Pillow") from None
    from io import BytesIO

    image = np.asarray(Image.open(BytesIO(data)))
    return image[:, :, None] if image.ndim == 2 else image


def adjusted(image: np.ndarray, seed: int, brightness: float = 0.2, contrast: tuple[float, float] = (0.8, 1.2)) -> np.ndarray:
    """Brightness and contrast changed by amounts that hang on the seed alone."""
    r = np.random.default_rng(seed)
    x = image.astype(float) / 255 + r.uniform(-brightness, brightness)
    mean = x.mean(axis=(0, 1), keepdims=True)
    return np.clip(np.rint(((x - mean) * r.uniform(*contrast) + mean) * 255), 0, 255).astype(np.uint8)


def prepared_images(rows: DataFrame, keys: Sequence[str], height: int, width: int, augment_seed: str | None = None, rotate: bool = False) -> DataFrame:
    """keys and `pixels` of height x width x 3 from rows (height, width, data) of images; empty data gives a black image.

    Data of a null height or width is an encoded image, else it is raw pixels.

    Decoding and resizing come after all filters, so keep this the last stage. Padding is not augmented.
    """
    kinds = dict(rows.dtypes)

    def of(batches: Iterator) -> Iterator:
        for b in batches:
            made = []
            for i, (h, w, data) in enumerate(zip(b["height"], b["width"], b["data"])):
                if not data:
                    made.append(bytes(height * width * 3))
                    continue
                raw = h == h and w == w and h is not None and w is not None  # nulls come as NaN
                image = as_uint8_hwc(np.frombuffer(data, np.uint8).reshape(int(h), int(w), -1) if raw else decoded(bytes(data)))
                if rotate:
                    image = image[::-1, ::-1]
                image = resize_with_pad(image, height, width)
                if augment_seed:
                    image = adjusted(image, int(b[augment_seed].iloc[i]) & 0xFFFFFFFF)
                made.append(image.tobytes())
            yield b[list(keys)].assign(pixels=made)

    extra = [augment_seed] if augment_seed and augment_seed not in keys else []
    return rows.select(*keys, "height", "width", "data", *extra).mapInPandas(of, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pixels binary"]))


def side_by_side(rows: DataFrame, views: Sequence[str], height: int, out: str) -> DataFrame:
    """Add `out`: images of equal height (pixels of three channels) next to each other, row of pixels by row."""
    width = [F.octet_length(v) / height for v in views]
    lines = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.concat(*[F.hex(F.substring(F.col(v), (y * w + 1).cast("int"), w.cast("int"))) for v, w in zip(views, width)]))
    return rows.withColumn(out, F.unhex(F.array_join(lines, "")))


# ---------------------------------------------------------------- text similarity and scorers
def similarity_ratios(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Matching-block ratio of distinct unordered pairs of texts, joined back; case and outer blanks do not count.

    Texts are shuffled once, to tell pairs apart; ratios come back to their rows by the SHA-256 of the pair.
    """
    left, right = F.lower(F.trim(a)), F.lower(F.trim(b))
    keyed = pairs.withColumns({"__a": F.least(left, right), "__b": F.greatest(left, right)})
    told = F.unhex(F.sha2(F.concat(F.length("__a").cast("string"), F.lit(" "), F.col("__a"), F.col("__b")), 256)).alias("__pair")

    @F.pandas_udf("double")
    def ratio(x, y):
        import pandas as pd

        return pd.Series([matching_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    scored = keyed.select("__a", "__b").distinct().select(told, ratio("__a", "__b").alias("similarity"))
    return keyed.select(*pairs.columns, told).join(scored, "__pair").drop("__pair")


def scored(rows: DataFrame, scorer: Callable, inputs: Sequence[str], batch: int, out: str = "score") -> DataFrame:
    """A caller's model over batches: scorer takes a pandas DataFrame of the inputs and returns one number a row.

    `batch` rows go to the model at once, whatever the Arrow batch's size; the rest is drained at the end of a partition.
    """
    def of(batches: Iterator) -> Iterator:
        import pandas as pd

        held = None
        for b in batches:
            held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
            while len(held) >= batch:
                now, held = held.iloc[:batch], held.iloc[batch:]
                yield now.assign(**{out: np.asarray(scorer(now[list(inputs)]), float)})
        if held is not None and len(held):
            yield held.assign(**{out: np.asarray(scorer(held[list(inputs)]), float)})

    from pyspark.sql import types as T

    return rows.mapInPandas(of, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))
