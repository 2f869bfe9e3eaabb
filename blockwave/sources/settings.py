"""Encoder settings as a table: missing ones take their defaults, and each row says what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formats import LARGEST_SIDE, LEVELS, NEWEST, PROFILES

#: What a setting is unless it is given; a width and a height have no default.
DEFAULTS = {"preset": 2, "rc_method": 0, "qp": 32, "bitrate": 0, "fps_num": 60, "fps_den": 1, "interval": 30, "version": 1, "profile": 0, "level": 0}
PRESETS, METHODS, QP_MOST = 3, 2, 63


def with_defaults(rows: DataFrame) -> DataFrame:
    """``rows`` with every setting; a column that is absent or null takes the default."""
    known = set(rows.columns)
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in known else F.lit(v) for k, v in DEFAULTS.items()})


def _limit(k: int) -> Column:
    return F.get(F.array(*[F.lit(row[k]) for row in LEVELS]), F.col("level").cast("int"))


def checked(rows: DataFrame) -> DataFrame:
    """``with_defaults`` and ``error``: empty, or the first setting that is wrong. Rates need a bitrate but for constant QP,
    and a level's frame and bitrate hold where one is given."""
    s = with_defaults(rows)
    c = {k: F.col(k) for k in ("width", "height", *DEFAULTS)}
    inside = lambda k, low, high: c[k].isNotNull() & c[k].between(low, high)
    tests = {
        "width": inside("width", 1, LARGEST_SIDE), "height": inside("height", 1, LARGEST_SIDE), "preset": inside("preset", 0, PRESETS), "rc_method": inside("rc_method", 0, METHODS), "qp": inside("qp", 0, QP_MOST),
        "bitrate": (c["bitrate"] > 0) | ((c["rc_method"] == 0) & (c["bitrate"] == 0)), "fps_num": c["fps_num"] > 0, "fps_den": c["fps_den"] > 0, "interval": c["interval"] > 0,
        "version": inside("version", 0, NEWEST), "profile": inside("profile", 0, PROFILES), "level": inside("level", 0, len(LEVELS) - 1),
    }
    error = F.lit(None).cast("string")
    for name, good in tests.items():
        error = F.coalesce(error, F.when(~good, name))
    over = (c["level"] > 0) & ((c["width"] > _limit(1)) | (c["height"] > _limit(2)) | (c["bitrate"] > _limit(4)))
    return s.withColumn("error", F.coalesce(error, F.when(over, "limits"), F.lit("")))
