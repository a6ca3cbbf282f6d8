"""Colours as #RRGGBB strings: luminance, contrast, and the nearest colour that contrasts enough."""

from __future__ import annotations

import colorsys

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.columns import let

ENOUGH = 4.5


def channels(colour: Column) -> Column:
    """struct<r, g, b> in [0, 1]; null if the text is no six-digit hex colour."""

    def parts(plain: Column) -> Column:
        part = lambda k: F.conv(F.substring(plain, k, 2), 16, 10).cast("double") / 255
        return F.when(plain.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))

    return let(F.regexp_replace(F.trim(colour), "^#", ""), parts)


def luminance(colour: Column) -> Column:
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return let(channels(colour), lambda rgb: 0.2126 * linear(rgb["r"]) + 0.7152 * linear(rgb["g"]) + 0.0722 * linear(rgb["b"]))


def contrast(a: Column, b: Column) -> Column:
    ratio = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))  # noqa: E731  greatest() skips nulls
    return let(F.struct(luminance(a).alias("x"), luminance(b).alias("y")), lambda v: ratio(v["x"], v["y"]))


def is_low_contrast(a: Column, b: Column, enough: float = ENOUGH) -> Column:
    """False also where a colour can't be read."""
    return F.coalesce(contrast(a, b) < enough, F.lit(False))


#: The grid of tones that a repair looks through: shares of the colour's strength, and steps of lightness away from the ground's.
STRENGTHS, STEPS, STEP = (1.0, 0.85, 0.65, 0.45, 0.25, 0.0), 59, 0.02


def _linear_light(rgb: np.ndarray) -> np.ndarray:
    return np.where(rgb <= 0.03928, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4) @ np.array([0.2126, 0.7152, 0.0722])


def _tones(hue: np.ndarray, light: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """[n, m, 3]: m colours of each of n hues, of [n, m] lightnesses and strengths."""
    top = np.where(light <= 0.5, light * (1 + strength), light + strength - light * strength)
    low = 2 * light - top
    turns = np.stack([hue + 1 / 3, hue, hue - 1 / 3], axis=1) % 1.0
    share = np.select([turns < 1 / 6, turns < 0.5, turns < 2 / 3], [turns * 6, 1.0, (2 / 3 - turns) * 6], 0.0)
    return low[:, :, None] + (top - low)[:, :, None] * share[:, None, :]


def _read(colour: str) -> tuple[float, ...] | None:
    plain = colour.strip().lstrip("#")
    try:
        return tuple(int(plain[i : i + 2], 16) / 255 for i in (0, 2, 4))
    except ValueError:
        return None


def _shown(tones: np.ndarray) -> list[str]:
    return ["".join(f"{c:02X}" for c in row) for row in np.rint(np.clip(tones, 0, 1) * 255).astype(int).tolist()]


def _ratios(own: np.ndarray, dark: np.ndarray) -> np.ndarray:
    return (np.maximum(own, dark) + 0.05) / (np.minimum(own, dark) + 0.05)


#: Pairs whose tones are worked out together.
PAIRS = 256


def _repaired(pairs: list[tuple[str, str]]) -> list[str]:
    """The repaired colour of each pair of colour and ground. A strength of the grid is only looked through for those that no stronger one helped."""
    read = [(_read(a), _read(b)) for a, b in pairs]
    out = [a.strip().lstrip("#").upper() for a, _ in pairs]
    known = [k for k, x in enumerate(read) if None not in x]
    for at in range(0, len(known), PAIRS):
        mine = np.array(known[at : at + PAIRS])
        start, below = (np.array([read[k][side] for k in mine]) for side in (0, 1))
        dark = _linear_light(below)[:, None]
        hue, light, strength = np.array([colorsys.rgb_to_hls(*x) for x in start]).T
        way = np.where(dark > 0.5, -STEP, STEP)
        lights = np.clip(light[:, None] + way * np.arange(1, STEPS + 1), 0, 1)
        own = _ratios(_linear_light(start)[:, None], dark)[:, 0]
        best, ratio, left = start.copy(), own.copy(), np.arange(len(mine))
        for part in (*STRENGTHS, None):
            if part is None:  # black and white
                tones = np.broadcast_to(np.array([[0.0] * 3, [1.0] * 3]), (len(left), 2, 3))
            else:
                tones = _tones(hue[left], lights[left], np.broadcast_to(np.minimum(1.0, strength[left] * part)[:, None], lights[left].shape))
            found = _ratios(_linear_light(tones), dark[left])
            enough = found >= ENOUGH
            first = np.where(enough.any(axis=1), enough.argmax(axis=1), found.argmax(axis=1))
            reached = np.take_along_axis(found, first[:, None], axis=1)[:, 0]
            better = enough.any(axis=1) | (reached > ratio[left])
            best[left[better]] = tones[np.flatnonzero(better), first[better]]
            ratio[left[better]] = reached[better]
            left = left[~enough.any(axis=1)]
            if not len(left):
                break
        for k, shown in zip(mine, _shown(best), strict=True):
            out[k] = shown
    return out


def _accessible_series(colour: pd.Series, ground: pd.Series) -> pd.Series:
    """Each pair of colours of a batch once."""
    given = list(zip(colour, ground, strict=True))
    pairs = list(dict.fromkeys(x for x in given if x[0] is not None and x[1] is not None))
    known = dict(zip(pairs, _repaired(pairs), strict=True))
    return pd.Series([known.get(x) for x in given], dtype=object)


def accessible(colour: Column, ground: Column) -> Column:
    """The first of a fixed grid of lighter or darker, then paler tones that reaches the contrast, else black or white, else the best."""
    return F.pandas_udf(_accessible_series, "string")(colour, ground)


def _hex(channels_: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))).cast("long")), 2, "0") for c in channels_])


def tinted(colour: Column, tint: Column, shade: Column) -> Column:
    """A colour drawn to white by tint, then to black by shade, both two hex digits as a share of 255 or null. RRGGBB; as it was if it can't be read."""
    share = lambda x: F.when(x.rlike("^[0-9A-Fa-f]{1,2}$"), F.conv(x, 16, 10).cast("double") / 255)
    up, down, rgb = share(tint), share(shade), channels(colour)
    lit = [F.bround(c * 255) for c in (rgb["r"], rgb["g"], rgb["b"])]
    lit = [F.when(up.isNotNull(), F.bround(c + (255 - c) * up)).otherwise(c) for c in lit]
    lit = [F.when(down.isNotNull(), F.bround(c * down)).otherwise(c) for c in lit]
    return F.when(rgb.isNotNull(), _hex(lit)).otherwise(colour)
