"""Media columns: copies of images, cropped or edited ones too, by local descriptors.

Corners are found at several scales; each gets an orientation (its patch's intensity centroid) and 256 binary tests of
smoothed intensities, turned by it; their number grows with the image's area. Hamming tables join them: in each of TABLES
tables the corners that agree in the table's share of the bits meet, and those that differ in few enough of all bits are kept.
Every block of query images meets every block of images, and both stand in the tables of one task; what goes on from there
is verified. An image is a copy of a query image when enough corners agree on one scale, turn and shift.

Equal pixels are one class before anything else, so groups of exact copies of any size cost one image. A stated set
of query images is searched against all images.

Defined results: null, empty or too small pixels, or sizes that don't fit them, have no corners and match nothing, but
have their class; repeated rows and null ids each get their result; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, durable

SCALES = (1.0, 0.75, 0.5)
CORNERS, RADIUS, BITS = 12, 11, 256
#: Pixels for which a scale has CORNERS corners; larger images have more, smaller ones as many.
AREA = 64 * 64
#: Bytes of corners in a block of images and of query images.
BLOCK, ASKED_BLOCK = 2e6, 8e6
#: Tables, whose keys share out the bits; pairs of corners that are compared at once.
TABLES, CANDIDATES = 12, 1 << 20
#: Bits that two descriptors of one corner may differ in; corners that must agree; places of an agreement's bins.
MOST_DIFFERENT, LEAST_AGREE, SHIFT_BIN, TURN_BIN = 24, 5, 8.0, 30.0
#: The tests: pairs of places around a corner, from a rule.
_TESTS = np.clip(np.random.default_rng(256).normal(0, 4.5, (BITS, 2, 2)), -RADIUS * 0.68, RADIUS * 0.68)
_disc = np.add.outer(np.arange(-7, 8) ** 2, np.arange(-7, 8) ** 2) <= 49
#: A corner as kept: place in quarter pixels, number of the scale, angle in degrees, tests.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("angle", "<i2"), ("bits", "u1", (BITS // 8,))])
FEATURES = "class_id long, corners binary"


def _smooth(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 places, edges repeated."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:-1, k:-1] - p[:-k - 1, k:-1] - p[k:-1, :-k - 1] + p[:-k - 1, :-k - 1]) / k**2


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    y, x = np.minimum((np.arange(h) + 0.5) / scale - 0.5, a.shape[0] - 1.001).clip(0), np.minimum((np.arange(w) + 0.5) / scale - 0.5, a.shape[1] - 1.001).clip(0)
    i, j = y.astype(int), x.astype(int)
    u, v = (y - i)[:, None], (x - j)[None]
    i, j = i[:, None], j[None]
    return a[i, j] * (1 - u) * (1 - v) + a[i + 1, j] * u * (1 - v) + a[i, j + 1] * (1 - u) * v + a[i + 1, j + 1] * u * v


def describe(image: np.ndarray) -> np.ndarray:
    """The corners of an image, as CORNER; places are in the image's own pixels."""
    out = []
    for level, scale in enumerate(SCALES):
        a = image.astype(float) if scale == 1 else _resized(image.astype(float), scale)
        if min(a.shape) < 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
        strength = xx * yy - xy**2 - 0.05 * (xx + yy) ** 2
        inner = np.full(a.shape, -np.inf)
        s = slice(RADIUS + 1, -RADIUS - 1)
        inner[s, s] = strength[s, s]
        around = np.max([np.roll(strength, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
        ys, xs = np.nonzero((inner > around) & (inner > 1.0))
        best = np.lexsort((xs, ys, -inner[ys, xs]))[: max(CORNERS, CORNERS * a.size // AREA)]
        ys, xs = ys[best], xs[best]
        soft = _smooth(a, 1)
        for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
            patch = soft[y - 7 : y + 8, x - 7 : x + 8] * _disc
            angle = float(np.arctan2((patch * np.arange(-7, 8)[:, None]).sum(), (patch * np.arange(-7, 8)).sum()))
            turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
            at = np.rint(_TESTS @ turn).astype(int)
            bits = soft[y + at[:, 0, 1], x + at[:, 0, 0]] < soft[y + at[:, 1, 1], x + at[:, 1, 0]]
            out.append((round(4 * x / scale), round(4 * y / scale), level, round(np.degrees(angle)), np.packbits(bits)))
    return np.array(out, dtype=CORNER)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corners of each class that this task hasn't met before."""
    known: set[int] = set()
    for batch in batches:
        rows = []
        for c, w, h, raw in zip(batch["class_id"], batch["width"], batch["height"], batch["pixels"], strict=True):
            if c not in known and raw is not None and w > 0 and h > 0 and w * h == len(raw):
                rows.append((c, describe(np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w))).tobytes()))
            if len(known) > 1_000_000:
                known.clear()
            known.add(c)
        yield pd.DataFrame(rows, columns=["class_id", "corners"])


def agreement(query: np.ndarray, image: np.ndarray, met: np.ndarray) -> int:
    """Most corners of two images that agree on a turn, a scale and a shift; met: pairs of corner numbers."""
    q, x = query[met[:, 0]], image[met[:, 1]]
    near = np.unpackbits(q["bits"] ^ x["bits"], axis=1).sum(axis=1) <= MOST_DIFFERENT
    q, x, met = q[near], x[near], met[near]
    turn = np.rint((x["angle"].astype(float) - q["angle"]) / TURN_BIN) % (360 / TURN_BIN)
    grow = np.array(SCALES)[q["scale"]] / np.array(SCALES)[x["scale"]]
    rad = np.radians(turn * TURN_BIN)
    qx, qy = q["x"] / 4, q["y"] / 4
    sx = x["x"] / 4 - grow * (qx * np.cos(rad) - qy * np.sin(rad))
    sy = x["y"] / 4 - grow * (qx * np.sin(rad) + qy * np.cos(rad))
    bins: dict[tuple, tuple[set, set]] = {}
    for k, key in enumerate(zip(turn, np.rint(np.log2(grow) * 2), sx // SHIFT_BIN, sy // SHIFT_BIN, strict=True)):
        own = bins.setdefault(key, (set(), set()))
        own[0].add(met[k, 0])
        own[1].add(met[k, 1])
    return max((min(len(a), len(b)) for a, b in bins.values()), default=0)


def _keys(bits: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The key of each descriptor in each table: every TABLES-th of the ordered bits."""
    weigh = 1 << np.arange(BITS // TABLES, dtype=np.int64)
    return np.stack([bits[:, order[t::TABLES][: len(weigh)]] @ weigh for t in range(TABLES)])


def _near(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in asked and in held (bits of descriptors) of the pairs that share a key in a table and differ in MOST_DIFFERENT bits at most."""
    order = np.argsort(np.abs(held.mean(axis=0) - 0.5), kind="stable")  # each table gets its share of the bits that tell most
    packed = lambda x: np.ascontiguousarray(np.packbits(x, axis=1)).view("<u8")
    p, q, met = packed(asked), packed(held), []
    for own, other in zip(_keys(asked, order), _keys(held, order), strict=True):
        by = np.argsort(other, kind="stable")
        first, last = (np.searchsorted(other[by], own, side) for side in ("left", "right"))
        upto = np.cumsum(last - first)
        for part in np.split(np.arange(len(own)), np.searchsorted(upto, np.arange(CANDIDATES, upto[-1], CANDIDATES))):
            n = last[part] - first[part]
            r, c = np.repeat(part, n), by[concat_ranges(first[part], n)]
            half = np.bitwise_count(p[r, :2] ^ q[c, :2]).sum(axis=1) <= MOST_DIFFERENT
            r, c = r[half], c[half]
            near = np.bitwise_count(p[r] ^ q[c]).sum(axis=1) <= MOST_DIFFERENT
            met.append(r[near] * len(held) + c[near])
    return np.divmod(np.unique(np.concatenate(met)), len(held))


def _search(asked: pd.DataFrame, images: pd.DataFrame) -> pd.DataFrame:
    """(q, class_id, n) of all images of a block that agree with a query image of a block in enough corners."""
    corners = lambda df, c: [np.frombuffer(x, dtype=CORNER) for x in df[c]]
    left, right = corners(asked, "qc"), corners(images, "corners")
    found = []
    if sum(map(len, left)) and sum(map(len, right)):
        bits = lambda own: np.unpackbits(np.concatenate([x["bits"] for x in own]), axis=1)
        r, c = _near(bits(left), bits(right))
        sizes = [np.array([len(x) for x in own], dtype=np.int64) for own in (left, right)]
        of = [np.repeat(np.arange(len(n)), n) for n in sizes]
        first = [np.cumsum(n) - n for n in sizes]
        pair = of[0][r] * len(right) + of[1][c]
        by = np.argsort(pair, kind="stable")
        r, c = r[by], c[by]
        pairs, at, n = np.unique(pair[by], return_index=True, return_counts=True)
        q, classes = asked["q"].tolist(), images["class_id"].tolist()
        for k, a, m in zip(pairs[n >= LEAST_AGREE].tolist(), at[n >= LEAST_AGREE].tolist(), n[n >= LEAST_AGREE].tolist(), strict=True):  # fewer corners met than must agree: no copy
            i, j = divmod(k, len(right))
            if q[i] != classes[j]:
                agreed = agreement(left[i], right[j], np.stack([r[a : a + m] - first[0][i], c[a : a + m] - first[1][j]], axis=1))
                found += [(q[i], classes[j], agreed)] if agreed >= LEAST_AGREE else []
    return pd.DataFrame(found, columns=["q", "class_id", "n"]).astype(np.int64)


def copies(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, class_id, n): all pairs of a query class and another class that is a copy of it. found: class_id, corners; asked: class_id."""
    asking = found.join(asked, "class_id", "left_semi")
    blocks = lambda df, target: max(1, int(-(-(df.agg(F.sum(F.length("corners"))).first()[0] or 0) // target)))
    wide, deep = blocks(found, BLOCK), blocks(asking, ASKED_BLOCK)
    own = lambda n: F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("class_id", "corners", own(deep).alias("d"), every(wide).alias("w")).select((F.col("w") * deep + F.col("d")).cast("long").alias("at"), F.col("class_id").alias("q"), F.col("corners").alias("qc"))
    right = found.select("class_id", "corners", own(wide).alias("w"), every(deep).alias("d")).select((F.col("w") * deep + F.col("d")).cast("long").alias("cell"), "class_id", "corners")
    cells = lambda df: df.repartition(wide * deep, df.columns[0]).groupBy(df.columns[0])
    return cells(left).cogroup(cells(right)).applyInPandas(_search, "q long, class_id long, n long")


def find_copies(images: DataFrame, queries) -> DataFrame:
    """One row for each image: image_id, class_id (of equal pixels), query_class (the query image's class that it is the best
    copy of, or null), corners (that agree), copy_of (all query classes that it is a copy of with their corners, best first). images: image_id, width, height, pixels (grey bytes); queries: a condition on image_id."""
    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    own = images.select(F.col("image_id").cast("long").alias("image_id"), size("width"), size("height"), F.col("pixels").cast("binary").alias("pixels"))
    classed = own.withColumn("class_id", F.xxhash64("width", "height", "pixels"))
    found = durable(classed.select("class_id", "width", "height", "pixels").mapInPandas(_features, FEATURES).groupBy("class_id").agg(F.max("corners").alias("corners")))
    members = durable(classed.select("image_id", "class_id", F.coalesce(queries, F.lit(False)).alias("asked")))
    asked = members.where("asked").select("class_id").distinct()
    agreed = copies(found, asked).groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("n", "q")), asc=False).alias("all"))
    best = F.col("all")[0]
    copy_of = F.transform(F.coalesce("all", F.array().cast("array<struct<n:bigint,q:bigint>>")), lambda x: F.struct(x["q"].alias("query_class"), x["n"].alias("corners"))).alias("copy_of")
    return members.join(agreed, "class_id", "left").select("image_id", "class_id", best["q"].alias("query_class"), F.coalesce(best["n"], F.lit(0)).cast("long").alias("corners"), copy_of)


def rendered(embeddings: DataFrame, side: int = 16, zoom: int = 4) -> DataFrame:
    """Vectors as images: the tables have no media, so each vector, through a fixed projection, is drawn as side * side grey cells."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        through = np.random.default_rng(64).normal(size=(64, side * side))
        for batch in batches:
            pictures = []
            for v in batch["embedding"]:
                own = np.nan_to_num(np.asarray(v, dtype=float)) if v is not None and len(v) else np.zeros(64)
                a = (np.resize(own, 64) @ through).reshape(side, side)
                spread = a.max() - a.min()
                grey = np.kron((a - a.min()) / spread if spread else a, np.ones((zoom, zoom))) * 255
                pictures.append(_smooth(grey, 1).clip(0, 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"image_id": batch["vec_id"], "width": side * zoom, "height": side * zoom, "pixels": pictures})

    return embeddings.select("vec_id", "embedding").mapInPandas(draw, "image_id long, width int, height int, pixels binary")


def op3(embeddings: DataFrame) -> DataFrame:
    return find_copies(rendered(embeddings), F.col("image_id") % 20 == 0).withColumnRenamed("image_id", "vec_id")
