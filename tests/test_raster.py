import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairset.operators import pixels, raster
from pairset.plans.catalogue import raster as catalogue
from pairset.sources.tables import read_images
from tests.conftest import rows

RNG = np.random.default_rng(3)


def images(spark, *arrays, **extra):
    """Rows ``(id, height, width, data, ...)`` numbered from 0."""
    data = []
    for i, a in enumerate(arrays):
        data.append((str(i), a.shape[0], a.shape[1], a.astype(np.uint8).tobytes(), *[v[i].astype(np.uint8).tobytes() for v in extra.values()]))
    more = "".join(f", {n} binary" for n in extra)
    return spark.createDataFrame(data, f"id string, height int, width int, data binary{more}")


def noise(h, w):
    return RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_image_stats(spark):
    white, dull = np.full((12, 10, 3), 250), np.full((12, 10, 3), 90)
    busy = noise(12, 10)
    got = {r["id"]: r for r in raster.image_stats(images(spark, white, dull, busy)).collect()}
    assert (got["0"]["white_frac"], got["0"]["flat_frac"], got["0"]["colorfulness"]) == (1.0, 1.0, 0.0)
    assert got["1"]["white_frac"] == 0.0 and got["2"]["flat_frac"] < 0.1
    r, g, b = (busy[..., i].astype(float) for i in range(3))
    rg, yb = abs(r - g), abs((r + g) / 2 - b)
    want = np.sqrt(rg.std() ** 2 + yb.std() ** 2) + 0.3 * np.sqrt(rg.mean() ** 2 + yb.mean() ** 2)
    assert got["2"]["colorfulness"] == pytest.approx(want)


def test_canvases_are_made_in_tasks_of_bounded_size(spark, out):
    n = 4 * catalogue.CANVASES + 900
    vector = F.array(*[((F.col("id") + i) % 64 / 64.0 - 0.5).cast("float") for i in range(64)])
    spark.range(n).coalesce(1).select(F.col("id").alias("vec_id"), vector.alias("embedding")).write.parquet(f"{out}/embeddings.parquet")
    made = catalogue.canvases(spark, out).select("vec_id", F.length("data").alias("n"), F.spark_partition_id().alias("task"))
    per_task = made.groupBy("task").agg(F.count("*").alias("rows"), F.countDistinct("vec_id").alias("ids"), F.min("n").alias("n")).collect()
    assert sum(r["ids"] for r in per_task) == n and {r["n"] for r in per_task} == {48 * 48 * 3}
    assert max(r["rows"] for r in per_task) <= catalogue.CANVASES + 1


def test_damaged_rows_are_captured(spark):
    bad = spark.createDataFrame([("x", 4, 4, b"123")], "id string, height int, width int, data binary")
    row = raster.image_stats(bad).first()
    assert not row["probe_ok"] and row["white_frac"] is None and row["probe_error"].startswith("ValueError")


def flood(mask):
    seen, sizes = np.zeros_like(mask, dtype=bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        seen[y, x], stack, size = True, [(y, x)], 0
        while stack:
            cy, cx = stack.pop()
            size += 1
            for ny in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        sizes.append(size)
    return sorted(sizes)


@pytest.mark.parametrize("density", [0.1, 0.3, 0.5, 0.9, 0.0])
def test_component_sizes_equal_a_flood_fill(density):
    mask = np.random.default_rng(int(density * 10)).random((40, 53)) < density
    assert sorted(pixels.component_sizes(mask)) == flood(mask)


def test_spiral_is_one_component():
    mask = np.zeros((31, 31), dtype=bool)
    for k in range(0, 15, 2):
        mask[k, k:31 - k] = mask[k:31 - k, 30 - k] = mask[30 - k, k:31 - k] = True
        mask[k + 2:31 - k, k] = True
        if k + 2 < 15:
            mask[k + 2, k:k + 3] = True
    assert sorted(pixels.component_sizes(mask)) == flood(mask)


def test_large_components():
    img = np.full((120, 120, 3), 240, dtype=np.uint8)
    img[10:50, 10:50] = img[70:110, 60:110] = 20
    img[60:63, 5:8] = 20
    assert pixels.large_components(img) == 2


def test_otsu_is_the_best_split():
    g = np.concatenate([RNG.normal(60, 10, 500), RNG.normal(180, 15, 700)]).clip(0, 255).astype(int)

    def between(t):
        lo, hi = g[g <= t], g[g > t]
        return 0 if not len(lo) or not len(hi) else len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2

    assert pixels.otsu_threshold(g) == max(range(256), key=between)


def test_dominant_hue(spark):
    blue, grey = np.zeros((10, 10, 3)), np.full((10, 10, 3), 128)
    blue[..., 2] = 200
    blue[:3] = 255
    got = {r["id"]: r for r in raster.dominant_hue(raster.pixel_table(images(spark, blue, grey))).collect()}
    assert got["0"]["hue"] == pytest.approx((12 + 0.5) / 18) and got["0"]["sat"] == 1.0
    assert got["0"]["val"] == pytest.approx(200 / 255)
    assert (got["1"]["hue"], got["1"]["sat"]) == (pytest.approx(0.5 / 18), 0.0)


def test_hsv_equals_colorsys(spark):
    import colorsys

    colours = [(0, 0, 0), (255, 0, 0), (10, 200, 30), (1, 2, 3), (255, 255, 0), (200, 10, 199), (7, 7, 7)]
    for r in raster.with_hsv(spark.createDataFrame(colours, "r int, g int, b int")).collect():
        assert (r["h"], r["s"], r["v"]) == pytest.approx(colorsys.rgb_to_hsv(r["r"] / 255, r["g"] / 255, r["b"] / 255))


def test_label_shares(spark):
    maps = images(spark, np.array([[1, 1, 2, 9]]))
    lookup = spark.createDataFrame([(1, "face"), (2, "top"), (3, "legs")], "label_id int, name string")
    row = raster.label_shares(raster.label_counts(maps), lookup).first()
    assert (row["person_frac"], row["face_frac"], row["top_frac"], row["dress_frac"]) == (0.5, 0.5, 0.25, 0.0)


def test_canvas(spark):
    photo = np.kron(RNG.integers(0, 256, (4, 6, 3)), np.ones((2, 2, 1))).astype(np.uint8)
    row = raster.to_canvas(images(spark, photo), 6, 6).first()
    got = np.frombuffer(row["out_data"], dtype=np.uint8).reshape(6, 6, 3)
    assert np.array_equal(got[1:5], photo[::2, ::2]) and not got[0].any() and not got[5].any()
    small = raster.to_canvas(images(spark, photo), 20, 20, allow_upsampling=False).first()
    placed = np.frombuffer(small["out_data"], dtype=np.uint8).reshape(20, 20, 3)
    assert np.array_equal(placed[6:14, 4:16], photo)


def test_area_average_keeps_the_mean():
    a = noise(30, 45)
    assert pixels.resized(a, 10, 15, False).mean() == pytest.approx(a.mean(), abs=0.6)
    assert set(np.unique(pixels.resized(a[..., 0] % 3, 7, 11, True))) <= {0, 1, 2}


def test_masks(spark):
    mask = np.zeros((9, 9))
    mask[3, 4] = mask[5, 2] = 1
    empty = np.zeros((9, 9))
    table = images(spark, noise(9, 9), noise(9, 9), mask=[mask, empty])
    boxes = rows(raster.bounding_boxes(table), "id", "x1", "y1", "x2", "y2", "area", "box_area")
    assert boxes == [("0", 2, 3, 4, 5, 2, 9), ("1", None, None, None, None, 0, 0)]
    filled = raster.bounded_mask(table).where("id = '0'").first()
    assert np.frombuffer(filled["mask"], dtype=np.uint8).sum() == 9
    grown = raster.dilated(table, left=1, right=2, up=0, down=3).where("id = '0'").first()
    got = np.frombuffer(grown["mask"], dtype=np.uint8).reshape(9, 9)
    want = np.zeros((9, 9))
    for y, x in zip(*np.nonzero(mask)):
        want[y:y + 4, x - 1:x + 3] = 1
    assert np.array_equal(got, want)


def test_keep_labels(spark):
    img = noise(5, 6)
    labels = RNG.integers(0, 4, (5, 6))
    row = raster.keep_labels(images(spark, img, labels=[labels]), [1, 3]).first()
    got = np.frombuffer(row["data"], dtype=np.uint8).reshape(5, 6, 3)
    want = img.copy()
    want[~np.isin(labels, [1, 3])] = 127
    assert np.array_equal(got, want)


def test_flip(spark):
    a, b = noise(4, 5), noise(4, 5)
    got = {r["id"]: r["data"] for r in raster.flipped(images(spark, a, b), F.col("id") == "1").collect()}
    assert got["0"] == a.tobytes() and got["1"] == b[:, ::-1].tobytes()


def test_array_psnr_equals_the_raster_one(spark):
    a, b = noise(3, 4), noise(3, 4)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<int>, b array<int>")
    cast = [F.transform(c, lambda x: x.cast("double")) for c in "ab"]
    row = df.select(raster.psnr_of_arrays(*cast).alias("ab"), raster.psnr_of_arrays(cast[0], cast[0]).alias("aa")).first()
    assert row["ab"] == pytest.approx(pixels.psnr(a, b)) and row["aa"] is None


def write_png(path, a):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, c = a.shape
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, out):
    colour, grey = noise(3, 5), noise(4, 2)[..., :1].copy()
    write_png(f"{out}/0001.png", colour)
    write_png(f"{out}/0002.png", grey)
    with open(os.path.join(out, "0003.png"), "wb") as f:
        f.write(b"not an image")
    good, bad = read_images(spark, out)
    got = {r["id"]: np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], 3) for r in good.collect()}
    assert np.array_equal(got["0001"], colour) and np.array_equal(got["0002"], np.repeat(grey, 3, axis=2))
    assert rows(bad, "id") == [("0003",)]


def test_sizes_are_aligned_before_scoring(spark):
    df = spark.createDataFrame([("a", 2, 3, 2, 3), ("b", 2, 3, 3, 2), ("c", None, 3, 2, 3)],
                               "id string, pred_height int, pred_width int, truth_height int, truth_width int")
    same, other = raster.aligned(df)
    assert rows(same, "id") == [("a",)] and rows(other, "id") == [("b",), ("c",)]


def test_category_roles(spark):
    garments = {"full": ["dress", "top"], "upper": ["top"], "lower": ["pants"]}
    table = raster.category_roles(spark, garments, ["face", "hair"])
    lookup = spark.createDataFrame([(3, "top"), (12, "arms"), (14, "legs")], "label_id int, name string")
    ids = table.where("role = 'mask'").join(lookup, F.col("label") == F.col("name"))
    assert rows(ids, "category", "label_id") == [("bottoms", 14), ("one-pieces", 3), ("one-pieces", 12), ("one-pieces", 14), ("tops", 3), ("tops", 12)]
    assert ("tops", "legs") in rows(table.where("role = 'keep'"), "category", "label")


def test_swapped_colours():
    img = noise(6, 6)
    assert pixels.colorfulness_abs(img, swapped=True) == pixels.colorfulness_abs(img[..., ::-1])


def brute_foreground(img):
    """Threshold, then opening and closing with a 9 x 9 square, pixel by pixel."""
    g = pixels.grey(img)
    mask = g <= pixels.otsu_threshold(g)

    def each(m, pick):
        out = np.zeros_like(m)
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                out[y, x] = pick(m[max(y - 4, 0):y + 5, max(x - 4, 0):x + 5])
        return out

    opened = each(each(mask, np.all), np.any)
    return each(each(opened, np.any), np.all)


@pytest.mark.parametrize("seed", range(4))
def test_component_count_equals_a_pixelwise_pass(spark, seed):
    blocks = np.random.default_rng(seed).integers(0, 256, (6, 7, 3))
    img = np.kron(blocks, np.ones((8, 8, 1))).astype(np.uint8)
    want = sum(s >= 0.02 * 48 * 56 for s in flood(brute_foreground(img)))
    assert raster.image_stats(images(spark, img)).first()["n_components"] == want


def test_box_means():
    a = RNG.integers(0, 256, (11, 13)).astype(float)
    got = pixels.box_means(a, 5)
    assert got.shape == (7, 9)
    assert all(got[y, x] == pytest.approx(a[y:y + 5, x:x + 5].mean()) for y in range(7) for x in range(9))


def test_rows_in_small_batches(spark):
    """Large rasters arrive in batches bounded by bytes, and nothing is lost between them."""
    arrays = [noise(64, 64) for _ in range(12)]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "20000")
    try:
        got = {r["id"]: r["white_frac"] for r in raster.image_stats(images(spark, *arrays)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert got == {str(i): pixels.white_fraction(a) for i, a in enumerate(arrays)}


def test_rasters_that_cannot_be_read_are_rows_of_their_own(spark):
    rows_in = [("a", 1, 2, bytes([1, 2, 3, 4, 5, 6])), ("b", 1, 2, None), ("c", 1, 2, bytes(5)), ("d", None, 2, bytes(6))]
    df = spark.createDataFrame(rows_in, "id string, height int, width int, data binary")
    turned = {r["id"]: r for r in raster.flipped(df, F.lit(True)).collect()}
    assert bytes(turned["a"]["data"]) == bytes([4, 5, 6, 1, 2, 3]) and turned["a"]["flip_ok"]
    assert [turned[i]["flip_ok"] for i in "bcd"] == [False] * 3 and turned["b"]["data"] is None and bytes(turned["c"]["data"]) == bytes(5)
    maps = spark.createDataFrame([("a", 1, 3, bytes([7, 7, 2])), ("b", 1, 3, None), ("c", 1, 3, bytes(2))], "id string, height int, width int, data binary")
    found = {r["id"]: r for r in raster.label_histograms(maps).collect()}
    assert (found["a"]["label_ids"], found["a"]["n_pixels"]) == ([2, 7], [1, 2]) and [found[i]["probe_ok"] for i in "bc"] == [False] * 2
    assert rows(raster.label_counts(maps)) == [("a", 2, 1), ("a", 7, 2)]
    colours = {r["id"]: r for r in raster.colour_histograms(df).collect()}
    assert colours["a"]["colours"] == [0x010203, 0x040506] and not colours["b"]["probe_ok"] and not colours["c"]["probe_ok"]
    assert rows(raster.pixel_table(df).where("id = 'a'")) == [("a", 1, 2, 3, 1), ("a", 4, 5, 6, 1)]
