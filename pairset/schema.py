"""Table schemas and the missing-value policy.

Ids are strings everywhere: leading zeros are part of the id and inference would lose them. A missing
number is NULL, never NaN, because Spark orders NaN above every number and ``avg`` returns NaN for it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(),
}


def struct_of(columns: str) -> T.StructType:
    """A schema from ``name type, name type, ...``; usable before a session exists."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PAIR_INDEX = struct_of(
    "id string, source string, product_id bigint, title string, url string, split string, "
    "target_type string, cloth_path string, person_path string, cloth_w int, cloth_h int, "
    "cloth_mp double, cloth_aspect double, person_w int, person_h int, person_mp double, "
    "person_aspect double, pose_score double, garment_score double, garment_phash string, "
    "is_hi_res boolean, is_clean boolean, is_duplicate boolean, agnostic_path string, "
    "pose_path string, parse_path string, densepose_path string"
)

SAMPLE_STATS = struct_of(
    "id string, colorfulness double, white_frac double, flat_frac double, n_components int, "
    "person_frac double, face_frac double, top_frac double, dress_frac double, skirt_frac double, "
    "pants_frac double, probe_ok boolean, probe_error string"
)

RUN_LOG = struct_of(
    "id string, mode string, source string, is_clean boolean, fabric_family string, res_bucket string, "
    "gscore_q string, garment_score double, target_type string, title string, "
    "garment_photo_type string, ok boolean, seconds double, peak_vram_gb double, out_w int, out_h int, "
    "person_w int, person_h int, error string, attempt_ts timestamp"
)

METRIC_TABLE = struct_of(
    "id string, mode string, source string, is_clean boolean, fabric_family string, res_bucket string, "
    "gscore_q string, target_type string, ssim double, psnr double, lpips double, ok boolean, "
    "error string, seconds double"
)

IMAGE_TABLE = struct_of("id string, height int, width int, data binary")
LABEL_PIXELS = struct_of("id string, label_id int, n_pixels bigint")
LABEL_LOOKUP = struct_of("label_id int, name string")
DETECTIONS = struct_of("image_id string, x1 double, y1 double, x2 double, y2 double, score double, cls int")
ARTEFACT_LISTING = struct_of("id string, kind string, path string, bytes bigint")


def null_if_nan(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c, F.lit(None).cast("double"))


def without_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float and double column of ``df``."""
    numeric = {f.name for f in df.schema.fields if f.dataType in (T.DoubleType(), T.FloatType())}
    if not numeric:
        return df
    return df.select([null_if_nan(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def holds(condition: Column) -> Column:
    """A predicate in which an unknown outcome counts as false."""
    return F.coalesce(condition, F.lit(False))


def as_flag(column: Column | str) -> Column:
    """A boolean flag from a boolean or 0/1 column; unknown counts as false."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("boolean"), F.lit(False))


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the types of ``schema``; a text that does not fit its type becomes NULL."""
    typed = [F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return without_nan(df.select(*typed))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that ``df`` has, in the order asked for."""
    have = set(df.columns)
    return [n for n in names if n in have]
