"""Detection and keypoint tables."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairset.operators.sequence import PRUNED_BELOW, top_k
from pairset.session import checkpointed, keyed, map_batches

# Detector and keypoint thresholds.
PRE_SCORE, POST_SCORE, NMS_IOU = 0.1, 0.3, 0.45
VISIBLE = 0.3

CORNERS = ("x1", "y1", "x2", "y2")
_ROW, _HOME = "_row", "_home"
_AXES = (("x1", "x2"), ("y1", "y2"))
_TILE = {"_lx": ("x", "level"), "_tx": ("x", "tile"), "_ly": ("y", "level"), "_ty": ("y", "tile")}

#: Boxes up to which an (image, class) is one tile, boxes that a tile of a crowded one settles in a round, and its side in
#: largest boxes of its level.
TILE_BOXES, ROUND_BOXES, TILE_SPAN = 4_000, PRUNED_BELOW - 1, 4


def corner_boxes(raw: DataFrame, ratio: Column, min_score: float = PRE_SCORE) -> DataFrame:
    """Centre/size boxes ``(cx, cy, w, h)`` as corners in original pixels, weak scores dropped."""
    half_w, half_h = F.col("w") / 2.0, F.col("h") / 2.0
    return raw.where(F.col("score") > min_score).withColumns({
        "x1": (F.col("cx") - half_w) / ratio, "y1": (F.col("cy") - half_h) / ratio,
        "x2": (F.col("cx") + half_w) / ratio, "y2": (F.col("cy") + half_h) / ratio,
    }).drop("cx", "cy", "w", "h")


def confident(dets: DataFrame, min_score: float = POST_SCORE, cls: int = 0) -> DataFrame:
    return dets.where((F.col("score") > min_score) & (F.col("cls") == cls))


def overlap(a: str, b: str) -> Column:
    """IoU of two aliased boxes with inclusive pixel ends."""
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("double")

    def area(side: str) -> Column:
        return (c(side, "x2") - c(side, "x1") + 1) * (c(side, "y2") - c(side, "y1") + 1)

    w = F.greatest(F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")) + 1, F.lit(0.0))
    h = F.greatest(F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")) + 1, F.lit(0.0))
    return (w * h) / (area(a) + area(b) - w * h)


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    area_a, area_b = ((m[:, 2] - m[:, 0] + 1) * (m[:, 3] - m[:, 1] + 1) for m in (a, b))
    span_x = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1
    span_y = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + 1
    inter = np.maximum(span_x, 0.0) * np.maximum(span_y, 0.0)
    return inter / (area_a[:, None] + area_b[None, :] - inter)


def _suppress(boxes: np.ndarray, limit: float, slab: int = 256, home: np.ndarray | None = None) -> np.ndarray:
    """Kept positions of boxes that are already in order of preference, a slab of them at a time.

    Boxes that are not at ``home`` may have better neighbours elsewhere: unless a kept box suppresses them they stay open, and so
    does everything that only an open box overlaps. Open boxes are not returned.
    """
    alive = np.ones(len(boxes), dtype=bool)
    open_ = np.zeros(len(boxes), dtype=bool) if home is None else ~home
    for start in range(0, len(boxes), slab):
        own = start + np.flatnonzero(alive[start:start + slab])
        hits = np.triu(_ious(boxes[own], boxes[own]) > limit, 1)
        for i in np.flatnonzero(hits.any(axis=1)):
            if alive[own[i]]:
                (open_ if open_[own[i]] else alive)[own[hits[i]]] = open_[own[i]]
        left = own[alive[own]]
        for judge, mark, value in ((left[~open_[left]], alive, False), (left[open_[left]], open_, True)):
            later = start + slab + np.flatnonzero(alive[start + slab:])
            if len(judge) and len(later):
                mark[later[(_ious(boxes[judge], boxes[later]) > limit).any(axis=0)]] = value
    return np.flatnonzero(alive & ~open_)


def _preference(dets: DataFrame, id_col: str) -> list[Column]:
    """Best score first; ids may repeat or be absent, so the corners decide among the rest."""
    return [F.col("score").desc(), *[F.col(c) for c in (id_col, *CORNERS) if c in dets.columns]]


def _settled(dets: DataFrame, key: Sequence[str], order: Sequence[Column], limit: float) -> DataFrame:
    """Kept boxes of each group, over batches of a partition sorted by group and preference.

    Spark sorts, so a task holds one batch and the group that runs past its end.
    """
    columns, coords = dets.columns, list(CORNERS)

    def kept(group: pd.DataFrame) -> np.ndarray:
        home = group[_HOME].to_numpy(dtype=bool) if _HOME in columns else None
        return _suppress(group[coords].to_numpy(dtype=float), limit, home=home)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            new_group = np.zeros(len(rows), dtype=bool)
            for c in key:
                values = rows[c].to_numpy()
                new_group[1:] |= values[1:] != values[:-1]
            starts = [0, *np.flatnonzero(new_group)]
            done = [s + kept(rows.iloc[s:e]) for s, e in zip(starts, starts[1:])]
            if done:
                yield rows.iloc[np.concatenate(done)][columns]
            held = rows.iloc[starts[-1]:]
        if held is not None:
            yield held.iloc[kept(held)][columns]

    ordered = keyed(dets, key).sortWithinPartitions(*key, *order)
    return map_batches(ordered, run, dets.schema)


def _places(low: str, high: str, limit: float, wide: int) -> tuple[Column, Column]:
    """Along one axis, the tiles in which a box may overlap another by more than ``limit``, and its own one.

    Boxes of such an overlap have sizes within ``limit`` of each other. Tiles of a level hold sizes up to its largest, and are
    ``wide`` times as wide as that.
    """
    size = F.col(high).cast("double") - F.col(low).cast("double") + 1.0
    centre = F.col(low).cast("double") + size / 2.0
    step, slack = -2.0 * math.log(limit), 1e-9

    def level(factor: float) -> Column:
        return F.floor((F.log(size) + math.log(factor)) / step)

    def side(at: Column) -> Column:
        return wide * F.exp(step * (at + 1))

    def tiles(at: Column) -> Column:
        reach = (size + side(at) / wide) * (0.5 + slack)
        span = F.sequence(F.floor((centre - reach) / side(at)), F.floor((centre + reach) / side(at)))
        return F.transform(span, lambda tile: F.struct(at.alias("level"), tile.alias("tile")))

    places = F.flatten(F.transform(F.sequence(level(limit * (1 - slack)), level((1 + slack) / limit)), tiles))
    own = F.struct(level(1.0).alias("level"), F.floor(centre / side(level(1.0))).alias("tile"))
    return places, own


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({c: F.col(f"_{axis}.{part}") for c, (axis, part) in _TILE.items()}).drop("_x", "_y")


def _own_tile(boxes: DataFrame, limit: float, wide: int) -> DataFrame:
    own = [_places(low, high, limit, wide)[1] for low, high in _AXES]
    return _flat(boxes.withColumns({"_x": own[0], "_y": own[1]}))


def _copies(boxes: DataFrame, limit: float, wide: int) -> DataFrame:
    """A copy of every box for each tile where it may overlap a box at home there; ``_home`` marks its own."""
    (x, own_x), (y, own_y) = [_places(low, high, limit, wide) for low, high in _AXES]
    placed = boxes.withColumns({"_own_x": own_x, "_own_y": own_y}).withColumn("_x", F.explode(x)).withColumn("_y", F.explode(y))
    home = (F.col("_x") == F.col("_own_x")) & (F.col("_y") == F.col("_own_y"))
    return _flat(placed.withColumn(_HOME, home).drop("_own_x", "_own_y"))


def suppress_overlaps(
    dets: DataFrame, image: str = "image_id", id_col: str = "det_id", limit: float = NMS_IOU,
    tile_boxes: int = TILE_BOXES,
) -> DataFrame:
    """Greedy class-aware suppression: of boxes overlapping by more than ``limit`` the best-scored stays.

    An (image, class) of up to ``tile_boxes`` boxes is one tile. A crowded one is cut into tiles of space and box size,
    and a box is copied to all tiles where it may overlap one that is at home there. Every tile settles its best
    boxes in order: a box is kept when it is at home, so that all its better neighbours are there, and none of
    them is kept or open. What kept boxes suppress leaves the table, and open boxes go into the next round, each of which
    settles the best open box of any neighbourhood. All decisions are those of the full greedy pass, whatever the tiles.
    Rows carry a number of their own, so boxes of one id are judged one by one; equal boxes of equal score leave one row.
    Boxes without an area or with a corner that is NULL or not finite overlap nothing.
    """
    if not 0 < limit < 1:
        raise ValueError("limit has to lie between 0 and 1")
    key = [image, "cls"]
    order = _preference(dets, id_col)
    sizes = dets.groupBy(*key).agg(F.count("*").alias("_n"))
    crowded = checkpointed(sizes.where(F.col("_n") > tile_boxes).select(*key))
    if crowded.isEmpty():
        return _settled(dets, key, order, limit)
    # at most one crowded group for so many rows
    crowded = F.broadcast(crowded)
    kept = _settled(dets.join(crowded, key, "left_anti").select(dets.columns), key, order, limit)
    boxes = checkpointed(dets.join(crowded, key, "left_semi").select(dets.columns).withColumn(_ROW, F.monotonically_increasing_id()))
    corners = [F.col(c).cast("double") for c in CORNERS]
    finite = functools.reduce(operator.and_, [F.abs(c) < float("inf") for c in corners])
    solid = F.coalesce(finite & (corners[2] - corners[0] + 1 > 0) & (corners[3] - corners[1] + 1 > 0), F.lit(False))
    kept = kept.unionByName(boxes.where(~solid).drop(_ROW))
    tile, order = [*key, *_TILE], [*order, F.col(_ROW)]
    same = functools.reduce(operator.and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in tile])
    # the tiles in which kept boxes look for what they suppress are as wide as the boxes
    left = checkpointed(_own_tile(boxes.where(solid), limit, 1))
    while not left.isEmpty():
        best = top_k(_copies(left.drop(*_TILE), limit, TILE_SPAN), tile, order, min(tile_boxes, ROUND_BOXES))
        settled = checkpointed(_settled(best, tile, order, limit).drop(*_TILE, _HOME))
        kept = kept.unionByName(settled.select(dets.columns))
        reached = _copies(settled, limit, 1)
        left = checkpointed(left.alias("a").join(reached.alias("b"), same & (overlap("a", "b") > limit), "left_anti"))
    return kept


def best_candidate(
    keypoints: DataFrame, image: str = "image_id", candidate: str = "candidate", visible: float = VISIBLE,
) -> DataFrame:
    """The candidate with the largest sum of visible scores times the area its visible joints span.

    ``keypoints`` has one row per joint: ``(image, candidate, joint, x, y, score)``; joints 1 to 13 count.
    Each candidate is judged by its own visible joints. Where no candidate of an image spans an area, the
    score sum alone decides. Ties go to the lower candidate number.
    """
    seen = F.col("score") > visible
    x, y = F.when(seen & (F.col("x") > 0), F.col("x")), F.when(seen & (F.col("y") > 0), F.col("y"))
    span = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    judged = keypoints.where(F.col("joint").between(1, 13)).groupBy(image, candidate).agg(
        F.sum(F.when(seen, F.col("score")).otherwise(0.0)).alias("joint_score"),
        F.coalesce(span, F.lit(0.0)).alias("area"),
    ).withColumn("weight", F.col("joint_score") * F.col("area"))
    # Weights are not negative: if the best is zero, all of them are, and only then the score sum decides.
    fallback = F.when(F.col("weight") == 0, F.col("joint_score"))
    first = W.partitionBy(image).orderBy(F.col("weight").desc(), fallback.desc(), F.col(candidate))
    return judged.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def normalised(points: Column, width: Column, height: Column, visible: float = VISIBLE) -> Column:
    """Keypoints ``array<struct<x,y,score>>`` as fractions of the image, invisible ones at -1."""
    def place(p: Column) -> Column:
        hidden = p["score"] < visible
        return F.struct(
            F.when(hidden, -1.0).otherwise(F.try_divide(p["x"], width)).alias("x"),
            F.when(hidden, -1.0).otherwise(F.try_divide(p["y"], height)).alias("y"),
            p["score"].alias("score"),
        )

    return F.transform(points, place)


# Source joint of each of the 18 joints of the output layout; -1 is the neck.
BODY_LAYOUT = (0, -1, 6, 8, 10, 5, 7, 9, 12, 14, 16, 11, 13, 15, 2, 1, 4, 3)
LEFT_SHOULDER, RIGHT_SHOULDER = 5, 6


def with_neck(points: Column, visible: float = VISIBLE) -> Column:
    """17 body joints in detector order as 18 joints with a neck between the shoulders."""
    a, b = F.get(points, LEFT_SHOULDER), F.get(points, RIGHT_SHOULDER)
    both = (a["score"] > visible) & (b["score"] > visible)
    neck = F.struct(
        ((a["x"] + b["x"]) / 2.0).alias("x"), ((a["y"] + b["y"]) / 2.0).alias("y"),
        F.when(both, 1.0).otherwise(0.0).alias("score"),
    )
    body = [neck if j < 0 else F.struct(*[F.get(points, j)[f].alias(f) for f in ("x", "y", "score")])
            for j in BODY_LAYOUT]
    return F.array(*body)


def peak(x_response: Column, y_response: Column, split_ratio: float = 2.0) -> Column:
    """Position of the strongest response on each axis and the weaker of the two peaks as confidence.

    Without a positive response the position is -1, scaled like every other one.
    """
    px, py = F.array_max(x_response), F.array_max(y_response)
    value = F.least(px, py)
    at_x = F.when(value <= 0, -1).otherwise(F.array_position(x_response, px) - 1)
    at_y = F.when(value <= 0, -1).otherwise(F.array_position(y_response, py) - 1)
    return F.struct((at_x / split_ratio).alias("x"), (at_y / split_ratio).alias("y"), value.alias("score"))


def centre_and_scale(padding: float = 1.25, aspect: float | None = None) -> dict[str, Column]:
    """Centre and padded size of corner boxes; with ``aspect`` (w/h) the shorter side is extended."""
    w = (F.col("x2") - F.col("x1")) * padding
    h = (F.col("y2") - F.col("y1")) * padding
    out = {"center_x": (F.col("x1") + F.col("x2")) * 0.5, "center_y": (F.col("y1") + F.col("y2")) * 0.5}
    if aspect is None:
        return {**out, "scale_w": w, "scale_h": h}
    wide = w > h * aspect
    return {**out, "scale_w": F.when(wide, w).otherwise(h * aspect), "scale_h": F.when(wide, w / aspect).otherwise(h)}


def flatten_points(df: DataFrame, points: str, keep: Sequence[str]) -> DataFrame:
    """Keypoint arrays as one row per joint."""
    return df.select(*keep, F.posexplode(points).alias("joint", "p")).select(
        *keep, "joint", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.score").alias("score"))
