"""The geometry algorithms as SQL functions: ``register(spark)`` makes them known to a session by name."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import geometry

LINE = T.ArrayType(T.ArrayType(T.DoubleType()))
LINES = T.ArrayType(LINE)


def _line(points) -> np.ndarray:
    return np.array([list(p) for p in points], float) if points is not None and len(points) else np.zeros((0, 2))


@pandas_udf(LINES)
def clip_line(lines: pd.Series, axis: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([[p.tolist() for p in geometry.clip_line(_line(x), int(k), a, b)] for x, k, a, b in zip(lines, axis, low, high, strict=True)])


@pandas_udf(LINE)
def clip_ring(rings: pd.Series, axis: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([geometry.clip_ring(_line(x), int(k), a, b).tolist() for x, k, a, b in zip(rings, axis, low, high, strict=True)])


@pandas_udf(LINE)
def simplify_line(lines: pd.Series, tolerance: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([geometry.simplified(_line(x), t, int(n)).tolist() for x, t, n in zip(lines, tolerance, least, strict=True)])


@pandas_udf(LINE)
def simplify_line_3d(lines: pd.Series, tolerance: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([geometry.simplified_3d(_line(x), t, int(n)).tolist() for x, t, n in zip(lines, tolerance, least, strict=True)])


@pandas_udf(LINE)
def smooth_path(lines: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series([geometry.smoothed(_line(x), int(s)).tolist() for x, s in zip(lines, steps, strict=True)])


@pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def triangulate(polygons: pd.Series) -> pd.Series:
    return pd.Series([geometry.triangulated([_line(r) for r in p])[1].tolist() for p in polygons])


@pandas_udf(T.BinaryType())
def geojson_to_wkb(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: geometry.to_wkb(json.loads(t)) if t else None)


@pandas_udf(T.StringType())
def wkb_to_geojson(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: json.dumps(geometry.from_wkb(bytes(b))) if b is not None else None)


@pandas_udf(T.LongType())
def murmur3_64(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: int(np.uint64(geometry.murmur3_64(int(k))).astype(np.int64)))


FUNCTIONS = {
    "quad_clip_line": clip_line, "quad_clip_ring": clip_ring, "quad_simplify": simplify_line, "quad_simplify_3d": simplify_line_3d, "quad_smooth": smooth_path,
    "quad_triangulate": triangulate, "quad_to_wkb": geojson_to_wkb, "quad_from_wkb": wkb_to_geojson, "quad_murmur3": murmur3_64,
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
