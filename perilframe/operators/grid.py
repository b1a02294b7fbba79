"""Points to cells, and cells to cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- windows over a grid: every frame is one row or one column of a layer -----------------


def _row(*keys: str):
    return Window.partitionBy(*keys, "row").orderBy("col")


def _col(*keys: str):
    return Window.partitionBy(*keys, "col").orderBy("row")


def nbr3x3(df: DataFrame, value: str, keys: tuple[str, ...] = (), replicate: bool = True) -> DataFrame:
    """df with n_nw, n_n, n_ne, n_w, n_e, n_sw, n_s, n_se, the eight neighbours' values.

    Two window passes and no join. Neighbours outside the grid are null, or the nearest value of the
    grid if ``replicate``. The grid must be whole: a missing row of df isn't a gap.
    """
    w, c = F.lag(value).over(_row(*keys)), F.lead(value).over(_row(*keys))
    own = F.col(value)
    three = F.struct(*(x.alias(n) for x, n in ((F.coalesce(w, own) if replicate else w, "w"), (own, "m"), (F.coalesce(c, own) if replicate else c, "e"))))
    step = df.withColumn("_3", three)
    up, down = F.lag("_3").over(_col(*keys)), F.lead("_3").over(_col(*keys))
    if replicate:
        up, down = F.coalesce(up, F.col("_3")), F.coalesce(down, F.col("_3"))
    step = step.withColumn("_u", up).withColumn("_d", down)
    names = {"n_nw": ("_u", "w"), "n_n": ("_u", "m"), "n_ne": ("_u", "e"), "n_w": ("_3", "w"), "n_e": ("_3", "e"), "n_sw": ("_d", "w"), "n_s": ("_d", "m"), "n_se": ("_d", "e")}
    return step.withColumns({n: F.col(a)[b] for n, (a, b) in names.items()}).drop("_3", "_u", "_d")


def box_mean(df: DataFrame, value: str, k: int, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the mean over the square of 2k + 1 cells, edges replicated: a pass along rows, one along columns."""

    def one(d: DataFrame, col: str, to: str, window) -> DataFrame:
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at, n = F.row_number().over(window), F.count(F.lit(1)).over(whole)
        left, right = F.greatest(F.lit(0), k - (at - 1)), F.greatest(F.lit(0), k - (n - at))
        total = F.sum(col).over(window.rowsBetween(-k, k)) + left * F.first(col).over(whole) + right * F.last(col).over(whole)
        return d.withColumn(to, total / (2 * k + 1))

    return one(one(df, value, "_b", _row(*keys)), "_b", out, _col(*keys)).drop("_b")


def lower_envelope(at: np.ndarray, height: np.ndarray) -> tuple[list[int], list[int]]:
    """Parabolas (i - at)^2 + height, ``at`` rising: which of them are lowest somewhere, and the first integer i at which each is.

    They are taken in order, each once onto a stack and at most once off it. Equal values go to the earlier parabola.
    """
    kept: list[int] = []
    since: list[int] = []
    for k, (b, h) in enumerate(zip(at.tolist(), height.tolist())):
        first = None
        while kept:
            a, g = int(at[kept[-1]]), int(height[kept[-1]])
            first = (b * b + h - a * a - g) // (2 * (b - a)) + 1
            if first > since[-1]:
                break
            kept.pop()
            since.pop()
            first = None
        kept.append(k)
        since.append(-(2**62) if first is None else first)
    return kept, since


def nearest_where(df: DataFrame, flag: Column, carry: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every cell with its nearest flagged cell: near_d2 (squared, in cells) and near_<carry>; ties to (row, col). Null without any.

    Separable: along a row the nearest flagged cell on either side is looked up by windows. Then each column is
    one group: its rows' squared distances are parabolas, and each cell takes the lowest one at its row, by their
    lower envelope. The work goes with the number of cells, however far flagged cells are.
    """
    packed = F.when(flag, F.struct(F.col("row").alias("frow"), F.col("col").alias("fcol"), *(F.col(c).alias(f"near_{c}") for c in carry)))
    step = df.withColumn("_f", packed)
    before = F.last("_f", True).over(_row(*keys).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_f", True).over(_row(*keys).rowsBetween(0, Window.unboundedFollowing))
    step = step.withColumn("_a", before).withColumn("_z", after)
    pick = F.when(F.col("_z").isNull() | (F.col("col") - F.col("_a.fcol") <= F.col("_z.fcol") - F.col("col")), F.col("_a")).otherwise(F.col("_z"))
    step = step.withColumn("_r", pick).drop("_f", "_a", "_z")
    names = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField("near_d2", T.DoubleType()), *(T.StructField(f"near_{c}", df.schema[c].dataType) for c in carry)])

    def column(table: pa.Table) -> pa.Table:
        row = table["row"].to_numpy().astype(np.int64)
        found = table["_r"].combine_chunks()
        has = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        take, d2 = pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.float64())
        if len(has):
            dx = pc.struct_field(found, "fcol").take(pa.array(has)).to_numpy(zero_copy_only=False).astype(np.int64) - table["col"][0].as_py()
            order = np.lexsort((dx * dx, row[has]))
            order = order[np.r_[True, np.diff(row[has][order]) > 0]]
            at, height = row[has][order], (dx * dx)[order]
            kept, since = lower_envelope(at, height)
            best = np.array(kept)[np.searchsorted(np.array(since), row, side="right") - 1]
            take, d2 = pa.array(has[order][best]), pa.array(((row - at[best]) ** 2 + height[best]).astype(float))
        nearest = found.take(take)
        return pa.table([*(table[n] for n in names), d2, *(pc.struct_field(nearest, f"near_{c}") for c in carry)], [*names, "near_d2", *(f"near_{c}" for c in carry)])

    return step.groupBy(*keys, "col").applyInArrow(column, schema)


# --- rasterising -----------------------------------------------------------------------------


def grid_extent(points: DataFrame, res: float) -> DataFrame:
    """One row: extent, and the number of rows and columns; none for a degenerate extent."""
    box = points.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    sized = box.withColumn("n_cols", F.ceil((F.col("xmax") - F.col("xmin")) / res).cast("int")).withColumn("n_rows", F.ceil((F.col("ymax") - F.col("ymin")) / res).cast("int"))
    return sized.where("n_cols > 0 and n_rows > 0")


def cell_of(x: Column, y: Column, res: float) -> tuple[Column, Column]:
    """Row (0 is north) and column in the extent's columns, clamped to the grid."""
    clamp = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), n - 1).cast("int")
    return clamp((F.col("ymax") - y) / res, F.col("n_rows")), clamp((x - F.col("xmin")) / res, F.col("n_cols"))


def assign_cell(points: DataFrame, meta: DataFrame, res: float) -> DataFrame:
    row, col = cell_of(F.col("x"), F.col("y"), res)
    return points.crossJoin(F.broadcast(meta)).withColumn("row", row).withColumn("col", col).drop(*meta.columns)  # one row of meta


def full_grid(meta: DataFrame) -> DataFrame:
    """Every (row, col) of the extent."""
    return meta.select(F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols").select("row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))


def rasterize(points: DataFrame, res: float, fill: bool = False, ground_min: int = 100, surface: str = "max") -> DataFrame:
    """All layers of a point cloud in one aggregation: z, dem, dsm, building, intensity, n.

    dem is the mean of ground points, or of all if there are ``ground_min`` or fewer; dsm the highest
    (or mean) z; building marks cells with a building return. ``fill``: empty cells are rows too.
    """
    meta = grid_extent(points, res)
    ground = points.agg(F.count_if(F.col("classification") == 2).alias("n_ground"))
    placed = assign_cell(points, meta, res).crossJoin(F.broadcast(ground))
    dem = F.avg(F.when((F.col("n_ground") > ground_min) & (F.col("classification") != 2), F.lit(None)).otherwise(F.col("z")))
    cells = placed.groupBy("row", "col").agg(
        F.avg("z").alias("z"), dem.alias("dem"), (F.max("z") if surface == "max" else F.avg("z")).alias("dsm"), F.max((F.col("classification") == 6).cast("int")).alias("building"), F.avg("intensity").alias("intensity"), F.count(F.lit(1)).alias("n"),
    )
    return full_grid(meta).join(cells, ["row", "col"], "left") if fill else cells


def canopy_height(dsm: Column, dem: Column) -> Column:
    return F.greatest(dsm - dem, F.lit(0.0))


def fill_nearest(cells: DataFrame, value: str = "z", least: float = 0.01) -> DataFrame:
    """Null values from the nearest valid cell, if more than ``least`` of all are null."""
    share = cells.agg(F.avg(F.col(value).isNull().cast("double")).alias("_null_share"))
    near = nearest_where(cells, F.col(value).isNotNull(), [value]).crossJoin(F.broadcast(share))
    filled = F.when(F.col(value).isNull() & (F.col("_null_share") > least), F.col(f"near_{value}")).otherwise(F.col(value))
    return near.withColumn(value, filled).select(*cells.columns)


def class_filter(points: DataFrame, kind: int) -> DataFrame:
    return points.where(F.col("classification") == kind)


def detect_crs(points: DataFrame) -> DataFrame:
    """The coordinate system of each tile by its mean easting."""
    east = F.col("mean_x")
    return points.groupBy("tile").agg(F.avg("x").alias("mean_x")).withColumn("crs", F.when(east.between(1_500_000, 2_200_000), 2264).when(east.between(600_000, 750_000), 32617).otherwise(2264))


def cell_xy(x0: float, y0: float, res: float) -> tuple[Column, Column]:
    return F.lit(x0) + (F.col("col") + 0.5) * res, F.lit(y0) - (F.col("row") + 0.5) * res


def regrid_nearest(cells: DataFrame, value: str, rows: int, cols: int, factor: float) -> DataFrame:
    """Cells of another resolution, ``factor`` source cells wide each, with the nearest source cell's value."""
    target = cells.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    index = lambda c: F.floor((F.col(c) + 0.5) * factor).cast("int")
    source = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    return target.withColumn("_r", index("row")).withColumn("_c", index("col")).join(source, ["_r", "_c"], "left").drop("_r", "_c")


def regrid_bilinear(cells: DataFrame, value: str, rows: int, cols: int, factor: float) -> DataFrame:
    """The mean of the four source cells around each target centre, by distance; missing ones weigh nothing."""
    target = cells.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    at = lambda c: (F.col(c) + 0.5) * factor - 0.5
    spread = target.withColumn("_y", at("row")).withColumn("_x", at("col")).withColumn("_k", F.explode(F.array(*(F.lit(i) for i in range(4)))))
    spread = spread.withColumn("_r", (F.floor("_y") + F.floor(F.col("_k") / 2)).cast("int")).withColumn("_c", (F.floor("_x") + F.col("_k") % 2).cast("int"))
    weight = (1 - F.abs(F.col("_y") - F.col("_r"))) * (1 - F.abs(F.col("_x") - F.col("_c")))
    source = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    joined = spread.join(source, ["_r", "_c"], "left").withColumn("_w", F.when(F.col(value).isNotNull(), weight))
    return joined.groupBy("row", "col").agg((F.sum(F.col(value) * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias(value))


def sample_nearest(places: DataFrame, cells: DataFrame, values: dict[str, float | None], x0: float, y0: float, res: float, rows: int, cols: int) -> DataFrame:
    """places (cx, cy) with the values of the cell that each is in, clamped to the grid; nulls take defaults."""
    clamp = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    at = places.withColumn("row", clamp((F.lit(y0) - F.col("cy")) / res, rows)).withColumn("col", clamp((F.col("cx") - x0) / res, cols))
    out = at.join(cells.select("row", "col", *values), ["row", "col"], "left").drop("row", "col")
    return out.withColumns({n: F.coalesce(n, F.lit(d)) for n, d in values.items() if d is not None})


def sample_or_mean(places: DataFrame, cells: DataFrame, value: str, x0: float, y0: float, res: float, rows: int, cols: int) -> DataFrame:
    """The cell's value inside the extent, the layer's mean outside it."""
    inside = F.col("cx").between(x0, x0 + res * cols) & F.col("cy").between(y0 - res * rows, y0)
    mean = cells.agg(F.avg(value).alias("_mean"))
    sampled = sample_nearest(places, cells, {value: None}, x0, y0, res, rows, cols).crossJoin(F.broadcast(mean))
    return sampled.withColumn(value, F.when(inside, F.col(value)).otherwise(F.col("_mean"))).drop("_mean")


def locate_cell(spark, x: float, y: float, meta: DataFrame, res: float) -> DataFrame:
    row, col = cell_of(F.lit(x), F.lit(y), res)
    return meta.select(row.alias("row"), col.alias("col"))


def validate_range(layers: DataFrame, ranges: DataFrame) -> DataFrame:
    """(product, ok): values within the product's range; none at all is not ok, an unknown product is."""
    seen = layers.groupBy("product").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))
    ok = F.when(F.col("n") == 0, False).when(F.col("lo").isNull(), True).otherwise((F.col("least") >= F.col("lo")) & (F.col("most") <= F.col("hi")))
    return seen.join(F.broadcast(ranges), "product", "left").select("product", "least", "most", "n", ok.alias("ok"))


def split_bands(cells: DataFrame, bands: dict[str, str]) -> DataFrame:
    """(row, col, product, value): one layer for each band, named by its product."""
    return cells.select("row", "col", *(F.col(b).cast("double").alias(p) for b, p in bands.items())).unpivot(["row", "col"], list(bands.values()), "product", "value")
