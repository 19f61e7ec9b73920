"""Pixel work on raw grey rasters pages(scan_id, width, height, pixels): NumPy inside tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.operators import deadline

PAGES_AT_ONCE = 64
TILE = 256  # pixels of a histogram of grey levels: half a megabyte in a task, little of it when packed
TILES_HELD = 500  # histograms a task keeps between batches
Box = tuple[str, int, str, int, int, int, int]  # field, place, value, x, y, width, height


def _raster(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)


def _ellipse(h: int, w: int) -> np.ndarray:
    y, x = np.ogrid[:h, :w]
    return ((x - (w - 1) / 2) / (w / 2)) ** 2 + ((y - (h - 1) / 2) / (h / 2)) ** 2 <= 1.0


def _one_box(scan_ids: pd.Series, stack: np.ndarray, box: Box, dark: float) -> pd.DataFrame:
    """One bubble on all pages of a batch at once; the part off the page is left out."""
    name, place, value, x, y, w, h = box
    n, page_h, page_w = stack.shape
    x1, y1 = min(x + w, page_w), min(y + h, page_h)
    roi = stack[:, max(y, 0) : max(y1, 0), max(x, 0) : max(x1, 0)]
    mean, fill = np.full(n, 255.0), np.zeros(n)
    if roi.size:
        inner = roi[:, _ellipse(*roi.shape[1:])]
        mean = np.round(roi.mean(axis=(1, 2)), 2)
        fill = np.round((inner < dark).mean(axis=1), 3) if inner.size else fill
    off = x < 0 or y < 0 or x + w > page_w or y + h > page_h
    return pd.DataFrame(
        {
            "scan_id": scan_ids.to_numpy(),
            "name": name,
            "opt_pos": place,
            "opt": value,
            "mean_intensity": mean,
            "fill_ratio": fill,
            "out_of_page": off,
        }
    )


def measure(pages: DataFrame, boxes: Sequence[Box], dark: float) -> DataFrame:
    """Mean intensity, filled share of the inner ellipse and off-page flag of every bubble.

    The template's boxes travel with the task; pages stay where they are (no shuffle). Pages whose pixels do
    not fill their size have no rows here; `quality` names them.
    """
    pages = pages.where(F.length("pixels") == F.col("width") * F.col("height"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (w, h), part in batch.groupby(["width", "height"]):
                stack = np.frombuffer(b"".join(part["pixels"]), np.uint8).reshape(len(part), h, w)
                yield pd.concat([_one_box(part["scan_id"], stack, box, dark) for box in boxes])

    return pages.select("scan_id", "width", "height", "pixels").mapInPandas(
        run,
        "scan_id bigint, name string, opt_pos int, opt string, mean_intensity double, "
        "fill_ratio double, out_of_page boolean",
    )


def sharpness_of(stack: np.ndarray) -> list[tuple[float, float]]:
    """Variance of the Laplacian and 1-99 % contrast of the interior of pages of one size, from exact sums."""
    n, h, w = stack.shape
    inner = stack[:, h // 10 : h - h // 10, w // 10 : w - w // 10].astype(np.int32)
    if not inner.size:
        raise ValueError("a page without pixels")
    rows, columns = inner.shape[1:]
    lap = -4 * inner
    # beyond an edge comes the row or column before it once more (all there is, if it is the only one)
    lap[:, 1:] += inner[:, :-1]
    lap[:, :-1] += inner[:, 1:]
    lap[:, 0] += inner[:, min(1, rows - 1)]
    lap[:, -1] += inner[:, max(rows - 2, 0)]
    lap[:, :, 1:] += inner[:, :, :-1]
    lap[:, :, :-1] += inner[:, :, 1:]
    lap[:, :, 0] += inner[:, :, min(1, columns - 1)]
    lap[:, :, -1] += inner[:, :, max(columns - 2, 0)]
    area = rows * columns
    total, squares = lap.sum(axis=(1, 2), dtype=np.int64), (lap * lap).sum(axis=(1, 2), dtype=np.int64)
    levels = inner.reshape(n, area) + 256 * np.arange(n, dtype=np.int64)[:, None]
    seen = np.bincount(levels.ravel(), minlength=256 * n).reshape(n, 256).cumsum(axis=1)
    low, high = ((seen >= share * area).argmax(axis=1) for share in (0.01, 0.99))
    spread = [(area * s - t * t) / (area * area) for s, t in zip(squares.tolist(), total.tolist())]
    return [(round(v, 1), float(c)) for v, c in zip(spread, high - low)]


def sharpness(page: np.ndarray) -> tuple[float, float]:
    """Variance of the Laplacian and 1-99 % contrast of the page interior."""
    return sharpness_of(page[None])[0]


def quality(pages: DataFrame) -> DataFrame:
    """Sharpness (variance of the Laplacian) and 1-99 % contrast of the page interior.

    Pages of one size are measured together, a few at a time. A page that cannot be measured becomes an
    error row and the run carries on.
    """

    def one(row) -> tuple:
        try:
            return row.scan_id, *sharpness(_raster(row)), None
        except Exception as error:  # noqa: BLE001 - one broken page must not lose the rest
            return row.scan_id, None, None, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = (batch["pixels"].str.len() == batch["width"] * batch["height"]) & (batch["width"] > 0) & (batch["height"] > 0)
            rows = [one(r) for r in batch[~whole].itertuples(index=False)]
            for (w, h), part in batch[whole].groupby(["width", "height"]):
                for start in range(0, len(part), PAGES_AT_ONCE):
                    some = part.iloc[start : start + PAGES_AT_ONCE]
                    stack = np.frombuffer(b"".join(some["pixels"]), np.uint8).reshape(len(some), h, w)
                    rows += [(ident, *found, None) for ident, found in zip(some["scan_id"], sharpness_of(stack))]
            yield pd.DataFrame(rows, columns=["scan_id", "sharpness", "contrast", "error"])

    return pages.select("scan_id", "width", "height", "pixels").mapInPandas(
        run, "scan_id bigint, sharpness double, contrast double, error string"
    )


def quality_in_time(pages: DataFrame, seconds: float, raster: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """`quality` with a time limit per page: a page whose raster does not come in time is an error row.

    `raster` turns a row into its pixels, as a codec does that can hang on a broken file.
    """

    def one(item: dict) -> tuple[float, float]:
        page = np.frombuffer(item["pixels"], np.uint8).reshape(item["height"], item["width"]) if raster is None else raster(item)
        return sharpness(page)

    rows = pages.select("scan_id", "width", "height", "pixels")
    return deadline.read_each(rows, "scan_id", one, {"sharpness": "double", "contrast": "double"}, seconds)


def blank_page(pages: DataFrame, quantile: float = 0.8) -> DataFrame:
    """The blank form of each template: a high quantile of every pixel over its sheets.

    A page is cut into tiles of `TILE` pixels. A task adds the grey levels of its pages up in one histogram
    per tile, which travels as one binary value, and tiles are added in a stream sorted by tile, so neither the
    number of sheets nor of tasks fills memory and no row stands for a pixel before the result.
    Pages whose pixels do not fill their size have no vote.
    """
    levels = 256

    def packed(histogram: np.ndarray) -> bytes:
        return zlib.compress(histogram.astype("<i8").tobytes(), 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for (template, w, h), part in batch.groupby(["template_id", "width", "height"]):
                cell = np.arange(w * h, dtype=np.int64) * levels
                # A few pages at a time: the work array is eight times as large as the pixels
                for start in range(0, len(part), PAGES_AT_ONCE):
                    some = part["pixels"].iloc[start : start + PAGES_AT_ONCE]
                    stack = np.stack([np.frombuffer(p, np.uint8) for p in some])
                    for tile, lo in enumerate(range(0, w * h, TILE)):
                        codes = (stack[:, lo : lo + TILE] + cell[: min(TILE, w * h - lo)]).ravel()
                        key = (template, w, tile)
                        found[key] = found.get(key, 0) + np.bincount(codes, minlength=TILE * levels)
            if len(found) > TILES_HELD:
                yield rows_of(found)
                found = {}
        yield rows_of(found)

    def rows_of(found: dict[tuple, np.ndarray]) -> pd.DataFrame:
        rows = [(*key, packed(h)) for key, h in found.items()]
        return pd.DataFrame(rows, columns=["template_id", "width", "tile", "histogram"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                histogram = np.frombuffer(zlib.decompress(row.histogram), "<i8")
                if row[:3] != key:
                    if key is not None:
                        yield levels_of(key, total)
                    key, total = row[:3], np.zeros_like(histogram)
                total = total + histogram
        if key is not None:
            yield levels_of(key, total)

    def levels_of(key: tuple, total: np.ndarray) -> pd.DataFrame:
        upto = total.reshape(TILE, levels).cumsum(axis=1)
        some = np.flatnonzero(upto[:, -1])
        place = np.floor(quantile * (upto[some, -1] - 1) + 0.5)
        level = (upto[some] > place[:, None]).argmax(axis=1).astype(np.int32)
        return pd.DataFrame({"template_id": key[0], "width": key[1], "pixel": key[2] * TILE + some, "level": level})

    whole = pages.where(F.length("pixels") == F.col("width") * F.col("height")).select("template_id", "width", "height", "pixels")
    tiles = whole.mapInPandas(count, "template_id string, width int, tile bigint, histogram binary")
    keys = ["template_id", "width", "tile"]
    sorted_tiles = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_tiles.mapInPandas(merge, "template_id string, width int, pixel bigint, level int")
