"""Raster jobs: one decode per image, all statistics in one pass, images never leave their task.

Images come as ``(id, height, width, data)`` rows of RGB bytes; results are narrow tables keyed by id, so
pixel bytes are not carried through later shuffles. Label maps travel as ``(id, label_id, n_pixels)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairset.functions.columns import CATEGORY_COVERAGE, fit_geometry
from pairset.operators import pixels
from pairset.operators.incremental import map_rows
from pairset.schema import struct_of
from pairset.session import map_batches

# The named label sets that the shares are built from.
BODY_LABELS = ("face", "hair", "arms", "hands", "legs", "feet", "torso")
SHARE_SETS = {
    "person_frac": BODY_LABELS,
    "face_frac": ("face", "hair"),
    "top_frac": ("top",),
    "dress_frac": ("dress",),
    "skirt_frac": ("skirt",),
    "pants_frac": ("pants",),
}

# Body parts masked along with a garment, and parts kept visible, per body coverage.
MASKED_LIMBS = {"full": ("arms", "torso", "legs"), "upper": ("arms", "torso"), "lower": ("legs",)}
KEPT_PARTS = {"full": ("hands", "feet"), "upper": ("legs", "hands"), "lower": ("arms", "feet")}


def category_roles(
    spark: SparkSession, garments: Mapping[str, Sequence[str]], identity: Sequence[str],
    coverage: Mapping[str, str] = CATEGORY_COVERAGE,
) -> DataFrame:
    """``(category, role, label)``: what each category masks and what it keeps.

    ``garments`` lists the garment labels per body coverage and ``identity`` the labels that are always
    kept; both belong to the segmentation model. Joined with its label lookup this gives label ids.
    """
    rows = []
    for category, body in coverage.items():
        rows += [(category, "mask", label) for label in (*garments[body], *MASKED_LIMBS[body])]
        rows += [(category, "keep", label) for label in (*identity, *KEPT_PARTS[body])]
    return spark.createDataFrame(rows, "category string, role string, label string")


def _shape(row: dict) -> tuple[int, int, int]:
    return int(row["height"]), int(row["width"]), 3


def image_stats(
    images: DataFrame, id_col: str = "id", min_share: float = 0.02, white_at: int = 235, swapped_colours: bool = False,
) -> DataFrame:
    """White share, colourfulness, flat share and number of large dark blobs, failures captured."""
    result = struct_of("white_frac double, colorfulness double, flat_frac double, n_components int")

    def probe(row: dict) -> dict:
        img = pixels.raster(row["data"], _shape(row))
        return {
            "white_frac": pixels.white_fraction(img, white_at), "colorfulness": pixels.colorfulness_abs(img, swapped_colours),
            "flat_frac": pixels.flat_fraction(img), "n_components": pixels.large_components(img, min_share),
        }

    return map_rows(images, probe, result, [id_col], "probe_ok", "probe_error")


def label_histograms(maps: DataFrame, id_col: str = "id") -> DataFrame:
    """Label maps ``(id, data)`` as one row per image: ``label_ids`` and their ``n_pixels``, or ``probe_ok`` false and an error.

    Where the maps have ``height`` and ``width``, a map of another length is an error.
    """
    sized = {"height", "width"} <= set(maps.columns)

    def probe(row: dict) -> dict:
        labels = pixels.raster(row["data"], (int(row["height"]) * int(row["width"]),)) if sized else np.frombuffer(row["data"], dtype=np.uint8)
        values, counts = np.unique(labels, return_counts=True)
        return {"label_ids": values.tolist(), "n_pixels": counts.tolist()}

    return map_rows(maps, probe, T.StructType.fromDDL("label_ids array<int>, n_pixels array<bigint>"), [id_col], "probe_ok", "probe_error")


def label_counts(maps: DataFrame, id_col: str = "id") -> DataFrame:
    """Label maps as ``(id, label_id, n_pixels)``; maps that cannot be read give no rows, ``label_histograms`` names them."""
    pairs = F.arrays_zip(F.col("label_ids").alias("label_id"), F.col("n_pixels"))
    return label_histograms(maps, id_col).where("probe_ok").select(id_col, F.inline(pairs).alias("label_id", "n_pixels"))


def label_shares(
    long: DataFrame, lookup: DataFrame, sets: dict[str, Sequence[str]] = SHARE_SETS, id_col: str = "id",
) -> DataFrame:
    """Share of an image's pixels in each named label set; label ids come from the lookup only.

    The lookup has one row per class of the segmentation model.
    """
    named = long.join(lookup, "label_id", "left")
    total = F.sum("n_pixels")
    shares = [F.try_divide(F.sum(F.when(F.col("name").isin(*names), F.col("n_pixels")).otherwise(0)), total).alias(out)
              for out, names in sets.items()]
    return named.groupBy(id_col).agg(*shares)


def share_flag(share: Column | str, threshold: float = 0.002) -> Column:
    c = F.col(share) if isinstance(share, str) else share
    return F.coalesce(c >= threshold, F.lit(False))


def colour_histograms(images: DataFrame, id_col: str = "id") -> DataFrame:
    """The distinct colours of an image and their pixels in one row: ``colours`` as ``r * 65536 + g * 256 + b`` and ``n``.

    An image that cannot be read is a row with ``probe_ok`` false and its error.
    """
    def probe(row: dict) -> dict:
        rgb = np.frombuffer(row["data"], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        values, counts = np.unique(rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], return_counts=True)
        return {"colours": values.tolist(), "n": counts.tolist()}

    return map_rows(images, probe, T.StructType.fromDDL("colours array<int>, n array<bigint>"), [id_col], "probe_ok", "probe_error")


def pixel_table(images: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per distinct colour of a readable image: ``(id, r, g, b, n)``."""
    pairs = F.arrays_zip("colours", "n")
    colours = colour_histograms(images, id_col).where("probe_ok").select(id_col, F.inline(pairs).alias("_c", "n"))
    parts = {c: F.shiftright("_c", shift).bitwiseAND(F.lit(255)).alias(c) for c, shift in (("r", 16), ("g", 8), ("b", 0))}
    return colours.select(id_col, *parts.values(), "n")


def with_hsv(colours: DataFrame) -> DataFrame:
    """Add hue, saturation and value, each in [0, 1], to ``r, g, b`` columns of 0..255."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    rc, gc, bc = (F.try_divide(hi - c, span) for c in (r, g, b))
    turn = F.when(r == hi, bc - gc).when(g == hi, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    hue = F.when(span == 0, 0.0).otherwise(F.pmod(turn / 6.0, F.lit(1.0)))
    return colours.withColumns({
        "h": hue, "s": F.when(hi == 0, 0.0).otherwise(F.try_divide(span, hi)), "v": hi,
    })


def dominant_hue(
    colours: DataFrame, id_col: str = "id", bins: int = 18, min_sat: float = 0.15, min_val: float = 0.15,
    max_val: float = 0.97, min_kept: int = 50,
) -> DataFrame:
    """Centre of the fullest hue bin with mean saturation and value, per image.

    Near-white and near-black pixels are left out unless at most ``min_kept`` pixels would remain. Both
    variants are aggregated per (image, bin) in one pass and the choice is made on those few rows.
    """
    hsv = with_hsv(colours)
    vivid = (F.col("s") > min_sat) & (F.col("v") > min_val) & (F.col("v") < max_val)
    at = F.least(F.floor(F.col("h") * bins), F.lit(bins - 1)).cast("int")
    n = F.col("n")
    per_bin = hsv.groupBy(id_col, at.alias("bin")).agg(
        F.sum(n).alias("n_all"), F.sum(F.when(vivid, n).otherwise(0)).alias("n_kept"),
        F.sum(F.col("s") * n).alias("s_all"), F.sum(F.when(vivid, F.col("s") * n).otherwise(0.0)).alias("s_kept"),
        F.sum(F.col("v") * n).alias("v_all"), F.sum(F.when(vivid, F.col("v") * n).otherwise(0.0)).alias("v_kept"),
    )
    per_image = per_bin.groupBy(id_col).agg(
        *[F.sum(c).alias(c) for c in ("n_all", "n_kept", "s_all", "s_kept", "v_all", "v_kept")],
        F.max_by("bin", F.struct("n_all", -F.col("bin"))).alias("bin_all"),
        F.max_by("bin", F.struct("n_kept", -F.col("bin"))).alias("bin_kept"),
    )
    enough = F.col("n_kept") > min_kept

    def chosen(name: str) -> Column:
        return F.when(enough, F.col(f"{name}_kept")).otherwise(F.col(f"{name}_all"))

    return per_image.select(
        id_col, ((chosen("bin") + 0.5) / bins).alias("hue"),
        F.try_divide(chosen("s"), chosen("n")).alias("sat"), F.try_divide(chosen("v"), chosen("n")).alias("val"),
    )


def to_canvas(
    images: DataFrame, target_w: int, target_h: int, channels: int = 3, id_col: str = "id", fill: int = 0,
    allow_upsampling: bool = True,
) -> DataFrame:
    """Fit every image onto the canvas: geometry as columns, sampling per image.

    Label maps (``channels=1``) are sampled by nearest neighbour, photographs by area average.
    """
    geometry = fit_geometry("width", "height", target_w, target_h, "fit", allow_upsampling)
    placed = images.withColumns({k: v for k, v in geometry.items() if k != "scale"})
    result = struct_of("out_height int, out_width int, out_data binary")

    def place(row: dict) -> dict:
        shape = (int(row["height"]), int(row["width"])) + ((channels,) if channels > 1 else ())
        a = pixels.resized(pixels.raster(row["data"], shape), int(row["new_h"]), int(row["new_w"]), channels == 1)
        a = pixels.padded(a, *(int(row[c]) for c in ("pad_left", "pad_top", "pad_right", "pad_bottom")), fill)
        return {"out_height": a.shape[0], "out_width": a.shape[1], "out_data": a.tobytes()}

    return map_rows(placed, place, result, [id_col])


def flipped(images: DataFrame, chosen: Column, id_col: str = "id", columns: Sequence[str] = ("data",)) -> DataFrame:
    """Mirror the chosen rows' rasters left to right, all raster columns of a row together.

    A row with a raster that is NULL or not a whole number of ``height`` by ``width`` planes stays as it is, with ``flip_ok`` false
    and the reason in ``flip_error``.
    """
    marked, names = images.withColumn("_flip", F.coalesce(chosen, F.lit(False))), images.columns
    schema = T.StructType([*images.schema.fields, T.StructField("flip_ok", T.BooleanType()), T.StructField("flip_error", T.StringType())])

    def mirrored(data: bytes | None, height: int, width: int) -> bytes:
        planes = np.frombuffer(data, dtype=np.uint8).reshape(height, width, -1)
        return np.ascontiguousarray(planes[:, ::-1]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rasters = {c: batch[c].tolist() for c in columns}
            errors: list[str | None] = []
            for i, (height, width, flip) in enumerate(zip(batch["height"], batch["width"], batch["_flip"], strict=True)):
                try:
                    turned = [mirrored(rasters[c][i], int(height), int(width)) for c in columns]
                except Exception as e:  # one bad raster must not end the job
                    errors.append(f"{type(e).__name__}: {e}")
                    continue
                errors.append(None)
                if flip:
                    for c, data in zip(columns, turned, strict=True):
                        rasters[c][i] = data
            kept = {c: rasters.get(c, batch[c]) for c in names}
            yield pd.DataFrame({**kept, "flip_ok": [e is None for e in errors], "flip_error": errors})

    return map_batches(marked, run, schema)


def keep_labels(images: DataFrame, keep: Sequence[int], id_col: str = "id", fill: int = 127) -> DataFrame:
    """Grey out every pixel whose label in ``labels`` is not among ``keep``."""
    result = struct_of("height int, width int, data binary")

    def mask_out(row: dict) -> dict:
        img, labels = pixels.raster(row["data"], _shape(row)), pixels.raster(row["labels"], _shape(row)[:2])
        shown = np.where(np.isin(labels, list(keep))[..., None], img, np.uint8(fill))
        return {"height": row["height"], "width": row["width"], "data": shown.tobytes()}

    return map_rows(images, mask_out, result, [id_col])


def bounding_boxes(masks: DataFrame, id_col: str = "id") -> DataFrame:
    """Bounding box, mask area and box area of 0/1 masks; empty masks have NULL boxes and area 0."""
    result = struct_of("x1 int, y1 int, x2 int, y2 int, area bigint, box_area bigint")

    def box(row: dict) -> dict:
        mask = pixels.raster(row["mask"], _shape(row)[:2])
        found = pixels.bounding_box(mask)
        if found is None:
            return {"area": 0, "box_area": 0}
        x1, y1, x2, y2 = found
        return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "area": int((mask > 0).sum()),
                "box_area": (x2 - x1 + 1) * (y2 - y1 + 1)}

    return map_rows(masks, box, result, [id_col])


def bounded_mask(masks: DataFrame, id_col: str = "id") -> DataFrame:
    """Masks replaced by their filled bounding boxes."""
    return _mask_job(masks, id_col, _fill_box)


def _fill_box(mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    found = pixels.bounding_box(mask)
    if found is not None:
        x1, y1, x2, y2 = found
        out[y1:y2 + 1, x1:x2 + 1] = 1
    return out


def dilated(masks: DataFrame, left: int, right: int, up: int, down: int, id_col: str = "id") -> DataFrame:
    """Masks grown by a number of pixels in each direction."""
    return _mask_job(masks, id_col, lambda m: pixels.dilate(m, left, right, up, down))


def _mask_job(masks: DataFrame, id_col: str, change) -> DataFrame:
    result = struct_of("height int, width int, mask binary")

    def run(row: dict) -> dict:
        mask = change(pixels.raster(row["mask"], _shape(row)[:2]))
        return {"height": row["height"], "width": row["width"], "mask": mask.astype(np.uint8).tobytes()}

    return map_rows(masks, run, result, [id_col])


def psnr_of_arrays(pred: Column, truth: Column, data_range: float = 255.0) -> Column:
    """PSNR of two equally long numeric arrays, JVM-side; NULL where they are identical."""
    squares = F.zip_with(pred, truth, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    mse = F.try_divide(total, F.size(truth))
    return F.when(mse > 0, 10 * F.log10(F.lit(data_range**2) / mse))


def aligned(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of equal size, and the others for quarantine."""
    same = (F.col("pred_height") == F.col("truth_height")) & (F.col("pred_width") == F.col("truth_width"))
    return pairs.where(F.coalesce(same, F.lit(False))), pairs.where(~F.coalesce(same, F.lit(False)))
