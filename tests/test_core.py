"""Invariants of the hazard operators, and every query against its SQL on the smallest tables."""

import heapq
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe import dims, plans
from perilframe.functions import geometry as geo
from perilframe.operators import fire as X
from perilframe.operators import grid as G
from perilframe.operators import hydrology as H
from perilframe.operators import properties as P
from perilframe.operators import scoring as S
from perilframe.operators import terrain as T
from perilframe.operators import vegetation as V
from perilframe.operators import weather as W
from perilframe.plans.fixtures import TABLES
from perilframe.plans.registry import Inputs
from perilframe.sources import readers as R
from perilframe.sources import writers as K
from perilframe.streaming.weather import daily_stream

SF = "/root/testdata/sf0.001"
SAMPLE = ["src8_read_weather_records", "src17_labelled_classes", "snk2_write_wind_rose", "snk9_export_stats", "qry5_overview", "sco2_wildfire_score", "mit4_counterfactual_sequence", "grid10_fill_nearest", "ter5_tri", "wx9_fire_weather_index", "fire1_spread_rate", "hyd3_flow_accumulation", "prx7_neighbor_distance", "veg6_zonal_veg_stats", "fire11_isochrone_segments", "fire11_isochrone_lines", "snk8_export_isochrones"]


def grid(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row int, col int, z double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(plans.oracle_sql()[name]).df(), plans.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    key = lambda df: sorted((tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, (float, int, np.number)) else str(x) for x in r) for r in df[columns].itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_terrain_on_planes(spark):
    flat = T.terrain_features(grid(spark, np.full((12, 12), 100.0)), 10.0)
    assert abs(back(flat, "slope_deg", (12, 12))).max() < 1e-9 and abs(back(flat, "tpi", (12, 12))).max() < 1e-9
    z = np.repeat(np.arange(20)[:, None] * math.tan(math.radians(10)) * 10, 20, axis=1)
    assert np.allclose(back(T.slope_aspect(grid(spark, z), 10.0), "slope_deg", z.shape), 10)
    ridge = np.zeros((15, 15))
    ridge[7] = 50
    tpi = back(T.tpi(grid(spark, ridge), 10.0, 30.0), "tpi", ridge.shape)
    assert tpi[7].min() > 0 and tpi[6].max() < 0


def test_box_mean_and_nearest_are_brute_force(spark):
    rng = np.random.default_rng(2)
    z = rng.random((9, 7))
    padded = np.pad(z, 2, mode="edge")
    want = np.array([[padded[r : r + 5, c : c + 5].mean() for c in range(7)] for r in range(9)])
    assert np.allclose(back(G.box_mean(grid(spark, z), "z", 2, "m"), "m", z.shape), want)
    flags = rng.random((9, 7)) < 0.15
    df = G.nearest_where(grid(spark, flags.astype(float)), F.col("z") == 1, [])
    at = np.argwhere(flags)
    want = np.array([[((at - (r, c)) ** 2).sum(axis=1).min() for c in range(7)] for r in range(9)])
    assert np.allclose(back(df, "near_d2", z.shape), want)


def test_drainage_is_brute_force(spark):
    rng = np.random.default_rng(5)
    z = rng.random((12, 12)) + np.add.outer(np.arange(12), np.arange(12)) * 0.05
    filled = H.fill_depressions(grid(spark, z), eps=1e-4, tile=5)
    level = z.copy()
    level[1:-1, 1:-1] = 1e18
    for _ in range(500):
        p = np.pad(level, 1, mode="edge")
        low = np.min([p[1 + a : 13 + a, 1 + b : 13 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], axis=0) + 1e-4
        level[1:-1, 1:-1] = np.minimum(level, np.maximum(z, low))[1:-1, 1:-1]
    assert np.allclose(back(filled, "filled", z.shape), level)
    directed = H.d8_direction(filled, "filled")
    acc = back(H.flow_accumulation(directed), "accumulation", z.shape)
    code = back(directed, "direction", z.shape).astype(int)
    want = np.zeros(z.shape)
    for r in range(12):
        for c in range(12):
            y, x = r, c
            while True:
                want[y, x] += 1
                if code[y, x] < 0:
                    break
                _, dr, dc = H.DIRECTIONS[code[y, x]]
                y, x = y + dr, x + dc
    assert (acc == want).all()


def test_flow_features_drain_pits(spark):
    # A plane that falls to the east, with a pit: every cell must drain to the last column.
    n, pit = 6, {(2, 2): 1.0, (2, 3): 1.5}
    z = {(r, c): pit.get((r, c), 20.0 - 2 * c + 0.01 * r) for r in range(n) for c in range(n)}
    cells = spark.createDataFrame([(r, c, v, 5.0) for (r, c), v in z.items()], "row int, col int, z double, slope_deg double")
    got = {(r.row, r.col): r for r in H.flow_features(cells, 10.0, 4).collect()}
    level, heap = {}, [(v, rc) for rc, v in z.items() if 0 in rc or n - 1 in rc]
    heapq.heapify(heap)
    near = [(dr, dc) for _, dr, dc in H.DIRECTIONS]
    while heap:
        v, rc = heapq.heappop(heap)
        if rc in level:
            continue
        level[rc] = v
        for dr, dc in near:
            o = (rc[0] + dr, rc[1] + dc)
            if o in z and o not in level:
                heapq.heappush(heap, (z[o] if 0 in o or n - 1 in o else max(z[o], v + 1e-4), o))
    to = {}
    for r, c in z:
        drops = [((level[r, c] - level[r + dr, c + dc]) / (1.414 if dr and dc else 1.0), -i) for i, (dr, dc) in enumerate(near) if (r + dr, c + dc) in z]
        if max(drops)[0] > 0:
            to[r, c] = (r + near[-max(drops)[1]][0], c + near[-max(drops)[1]][1])
    assert all(rc in to for rc in z if 0 not in rc and n - 1 not in rc)
    acc = dict.fromkeys(z, 0)
    for rc in z:
        while rc is not None:
            acc[rc] += 1
            rc = to.get(rc)
    assert {rc: r.accumulation for rc, r in got.items()} == acc
    down = {}
    for rc in z:
        at = rc
        while at is not None and acc[at] <= 4:
            at = to.get(at)
        down[rc] = None if at is None else max(level[rc] - level[at], 0.0)
    most = max(v for v in down.values() if v is not None)
    assert all(got[rc].hand_m == pytest.approx(most if v is None else v) for rc, v in down.items())


def test_reach_is_dijkstra(spark):
    cells = spark.createDataFrame([(r, c, 5.0 + (r * 3 + c * 5) % 11) for r in range(8) for c in range(8)], "row int, col int, rate double")
    edges = X.travel_cost_edges(cells, 20.0, 225.0)
    out = {(r.source_id, r.row, r.col): r.arrival for r in X.reach_within_budget(edges, spark.createDataFrame([(1, 0, 0), (2, 7, 3)], "source_id int, row int, col int"), 30.0).collect()}
    near = {}
    for e in edges.collect():
        near.setdefault((e.row, e.col), []).append((e.row2, e.col2, e.minutes))
    for source, start in ((1, (0, 0)), (2, (7, 3))):
        best, heap = {}, [(0.0, start)]
        while heap:
            t, at = heapq.heappop(heap)
            if at in best or t > 30:
                continue
            best[at] = t
            for r, c, m in near[at]:
                heapq.heappush(heap, (t + m, (r, c)))
        mine = {k[1:]: v for k, v in out.items() if k[0] == source}
        assert mine.keys() == best.keys() and all(abs(mine[k] - best[k]) < 1e-9 for k in best)


def test_spread_rate_values(spark):
    cells = spark.createDataFrame([(123, 10.0), (104, 5.0), (121, 5.0), (91, 5.0), (7, 5.0)], "fbfm40 int, slope_deg double")
    conf = spark.createDataFrame([(15.0, 0.07, 0.09, 0.11)], "wind_mph double, m1 double, m10 double, m100 double")
    got = {r.fbfm40: r.rate for r in X.spread_rate(cells, dims.dim(spark, "fuel_models"), conf).collect()}
    assert abs(got[123] - 14.817368) < 1e-5 and got[91] == 0 and got[7] == 0 and got[104] > got[121]


def test_fire_weather_first_day(spark):
    day = spark.createDataFrame([(1, 1, 17.0, 42.0, 25.0, 0.0)], "station int, day_no int, temp_c double, rh_pct double, wind_kmh double, precip_mm double")
    assert abs(W.fire_weather_index(day).first().ffmc - 87.692981) < 1e-5


def test_fire_weather_goes_on_over_days_and_stations(spark):
    days = [(s, d, 20.0 + d % 9, 40.0, 15.0, (None if s == 2 else 0.0) if d % 6 else 9.0) for s in (1, 2, 3) for d in range(1, 40)]
    df = spark.createDataFrame(days, "station int, day_no int, temp_c double, rh_pct double, wind_kmh double, precip_mm double")
    got = {}
    for r in W.fire_weather_index(df.repartition(4)).collect():
        got.setdefault(r.station, {})[r.day_no] = (r.ffmc, r.dmc, r.dc)
    assert got[1] == got[2] == got[3] and len(got[1]) == 39
    assert all((got[1][d][0] < got[1][d - 1][0]) == (d % 6 == 0) for d in range(3, 40)) and got[1][5][2] > got[1][4][2]


def test_scores_are_monotone(spark):
    base = {"slope_degrees": 10.0, "zone1_fuel_load": 0.5, "roof_material": "wood_shingles_shake", "vent_screening_status": "unscreened", "tpi_class": "ridge"}
    rows = [base, base | {"roof_material": "metal_standing_seam"}, base | {"vent_screening_status": "screened"}, base | {"zone1_fuel_load": 0.0}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in base.items()))
    s = [r.wildfire_risk_score for r in S.wildfire_score(df).orderBy("id").collect()]
    assert all(0 <= x <= 100 for x in s) and max(s[1:]) < s[0]


def test_geometry(spark):
    df = spark.createDataFrame([(3.0, 4.0, 2.0)], "cx double, cy double, half double")
    ring = geo.square(F.col("cx"), F.col("cy"), F.col("half"))
    other = geo.square(F.col("cx") + 7, F.col("cy") + 8, F.col("half"))
    x, y = geo.to_utm(F.lit(-78.94), F.lit(36.0))
    lon, lat = geo.from_utm(x, y)
    r = df.select(geo.area(ring).alias("a"), geo.centroid(ring).alias("c"), geo.contains(ring, F.lit(3.5), F.lit(4.5)).alias("i"), geo.contains(ring, F.lit(9.0), F.lit(9.0)).alias("o"), geo.ring_distance(ring, other).alias("d"), x.alias("e"), y.alias("n"), lon.alias("lon"), lat.alias("lat")).first()
    assert r.a == 16 and (r.c.x, r.c.y) == (3, 4) and r.i and not r.o and abs(r.d - 5) < 1e-9
    assert abs(r.e - 685_700) < 400 and abs(r.n - 3_985_900) < 600 and abs(r.lon + 78.94) < 1e-8 and abs(r.lat - 36) < 1e-8


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "tiles" / "a").mkdir(parents=True)
    (tmp_path / "tiles" / "a" / "one.las").write_bytes(b"x" * 2000)
    (tmp_path / "tiles" / "two.laz").write_bytes(b"y")
    assert {r.name for r in R.list_tiles(spark, f"{tmp_path}/tiles").collect()} == {"one.las", "two.laz"}
    assert [r.name for r in R.tile_manifest(spark, f"{tmp_path}/tiles").collect()] == ["one.las"]
    assert {r.label for r in R.labelled_manifest(spark, f"{tmp_path}/tiles").collect()} == {"a", "tiles"}
    (tmp_path / "map.json").write_text('{"elements": [{"type": "node", "id": 1, "lon": 0.0, "lat": 1.0}, {"type": "way", "id": 9, "nodes": [1, 1], "tags": {"name": "n"}}]}')
    nodes, ways = R.read_elements(spark, f"{tmp_path}/map.json")
    assert nodes.count() == 1 and ways.first().tags == {"name": "n"}
    (tmp_path / "p.geojson").write_text('{"features": [{"properties": {"pid": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert len(R.read_geojson(spark, f"{tmp_path}/p.geojson", "pid: string").first().ring) == 3
    (tmp_path / "twins.json").write_text('{"parcel_id": "1", "score": 2.0, "other": 1}\n{broken\n')
    assert R.read_twins(spark, f"{tmp_path}/twins.json", "parcel_id string, score double").count() == 1
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert K.cached_step(spark, f"file://{tmp_path}/step", build).count() == 3 == K.cached_step(spark, f"file://{tmp_path}/step", build).count() and len(calls) == 1
    status = {r.step: r for r in K.step_status(spark, {"good": lambda: spark.range(2), "bad": lambda: spark.table("no_such_table")}).collect()}
    assert status["good"].rows == 2 and not status["bad"].ok
    i = Inputs(spark, SF)
    K.write_cells(i.cells, f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").count() == i.cells.count()
    K.write_weather(i.weather_daily, f"{tmp_path}/wx")
    assert spark.read.parquet(f"{tmp_path}/wx").where("year is not null").count() == i.weather_daily.count()


def test_stream_of_days(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00", "TMAX", 1.0), ("a", "2024-01-01 12:00:00", "TMAX", 3.0), ("a", "2024-01-09 12:00:00", "TMAX", 5.0)], "station string, ts string, datatype string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = daily_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from days").collect()
    assert [(str(r.day), r.value, r.n) for r in got] == [("2024-01-01", 2.0, 2)]


def test_neighbours_at_any_distance(spark):
    rng = np.random.default_rng(5)
    rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in np.column_stack((rng.uniform(0, 4000, (40, 2)), rng.uniform(2, 30, (40, 2)))).tolist()]
    rings += [[(9e4, 9e4), (9e4 + 5, 9e4), (9e4, 9e4 + 5)], rings[0], [(0.0, 10.0), (20.0, 10.0), (20.0, 12.0), (0.0, 12.0)], [(9.0, 0.0), (11.0, 0.0), (11.0, 30.0), (9.0, 30.0)]]
    rows = [(str(i), [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)] + [("none", None)]
    df = spark.createDataFrame(rows, "parcel_id string, ring array<struct<x: double, y: double>>")

    def apart(a, b):
        box = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r))
        (a0, a1, a2, a3), (b0, b1, b2, b3) = box(a), box(b)
        return float(np.hypot(max(0, a0 - b2, b0 - a2), max(0, a1 - b3, b1 - a3)))

    got = {r.parcel_id: r.neighbor_distance_m for r in P.neighbor_distance(df).collect()}
    assert got["none"] is None and got["0"] == 0 == got["41"] and got["42"] == 0 == got["43"] and got["40"] > 1e5
    for i in range(40):
        assert abs(got[str(i)] - min(apart(rings[i], r) for j, r in enumerate(rings) if j != i)) < 1e-6
    assert P.neighbor_distance(df.limit(0)).count() == 0 and P.neighbor_distance(df.where("parcel_id = '3'")).first()[1] is None


def test_pages_classes_rose_and_stats(spark, tmp_path):

    pages = [[{"station": "s", "date": "2024-01-01T00:00:00", "datatype": "TMAX", "value": 3.5, "seq": k, "attributes": ",,N"} for k in page] for page in ((0, 1), (2,), ())]
    for n, page in enumerate(pages):
        (tmp_path / f"p{n}.json").write_text(json.dumps(page, indent=1))
    assert sorted(r.seq for r in R.read_records(spark, f"{tmp_path}/p*.json").collect()) == [0, 1, 2]
    (tmp_path / "pages.txt").write_text("\n".join(json.dumps(p) for p in pages))
    assert sorted(r.seq for r in R.read_records(spark, f"{tmp_path}/pages.txt", lines=True).collect()) == [0, 1, 2]
    for k, folder in enumerate(("metal_corrugated", "membrane_flat", "metal_corrugated", "elsewhere")):
        (tmp_path / "patches" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "patches" / folder / f"{k}.npy").write_bytes(b"x")
    counts = R.class_counts(R.labelled_manifest(spark, f"{tmp_path}/patches", "*.npy"), dims.dim(spark, "roof_classes")).collect()
    assert len(counts) == 8 and {r.label: r.files for r in counts if r.files} == {"metal_corrugated": 2, "membrane_flat": 1} and all(r.class_id is not None for r in counts)
    wind = spark.createDataFrame([(10.0, 0.0), (20.0, 359.0), (30.0, 90.0), (None, 90.0)], "wind_speed_mph double, wind_dir_deg double")
    K.write_wind_rose(W.wind_rose(wind), f"{tmp_path}/rose")
    (doc,) = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/rose").collect()]
    assert doc["sectors"] == [k * 22.5 for k in range(16)] and abs(doc["frequency"][0] - 2 / 3) < 1e-9 and abs(doc["pct_90"][0] - 19) < 1e-9 and doc["pct_99"][4] == 30 and doc["pct_95"][8] == 0
    scored = spark.createDataFrame([(60.0,), (55.0,), (30.0,), (29.96,)], "wildfire_risk_score double")
    runs = spark.createDataFrame([(12.34,), (None,)], "toa double")
    for some, want in ((scored, (4, 43.7, 60.0, 30.0, 2, 1, 1, 12.3, 1)), (scored.limit(0), (0, 0.0, 0.0, 0.0, 0, 0, 0, 12.3, 1))):
        K.export_stats(some, runs, f"{tmp_path}/stats")
        (doc,) = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/stats").collect()]
        assert tuple(doc.values()) == want


def test_neighbours_of_a_dense_downtown(spark):
    """20,000 footprints on a block of 60 m, one footprint of 3 km around it all, and farms far off."""
    rng = np.random.default_rng(9)
    n = 20_000
    low = np.column_stack((rng.uniform(1000, 1060, (n, 2)), rng.uniform(0.01, 0.1, (n, 2))))
    farms = np.column_stack((rng.uniform(20_000, 90_000, (50, 2)), rng.uniform(5, 40, (50, 2))))
    boxes = np.concatenate((low, farms))
    x0, y0, x1, y1 = boxes[:, 0], boxes[:, 1], boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
    point = lambda x, y: {"x": float(x), "y": float(y)}
    square = lambda a, b, c, d: [point(a, b), point(c, b), point(c, d), point(a, d)]
    rows = [(str(k), [square(*v)]) for k, v in enumerate(zip(x0, y0, x1, y1))]
    rows += [("yard", [square(-1500, -1500, 1500, 1500), square(-1400, -1400, 1400, 1400)]), ("empty", []), ("none", None)]
    df = spark.createDataFrame(rows, "parcel_id string, rings array<array<struct<x: double, y: double>>>")
    got = {r.parcel_id: r.neighbor_distance_m for r in P.neighbor_distance(df).collect()}
    assert len(got) == len(rows) and got["none"] is None and got["empty"] is None
    gaps = lambda k: np.hypot(np.maximum(0, np.maximum(x0[k] - x1, x0 - x1[k])), np.maximum(0, np.maximum(y0[k] - y1, y0 - y1[k])))
    for k in [*rng.choice(n, 300, replace=False), *range(n, n + 50)]:
        others = np.delete(gaps(k), k)
        assert abs(got[str(k)] - others.min()) < 1e-6
    assert abs(got["yard"] - (1400 - max(x1[:n].max(), y1[:n].max()))) < 1e-6


def test_zones_of_a_hot_bucket_are_dealt_in_shares(spark):
    rng = np.random.default_rng(10)
    spots = [(float(x), float(y)) for x, y in rng.uniform(0, 50, (150, 2))]
    rows = [(str(k), [{"x": x + a, "y": y + b} for a, b in ((0, 0), (3, 0), (3, 3), (0, 3))]) for k, (x, y) in enumerate(spots)]
    b = spark.createDataFrame(rows, "parcel_id string, ring array<struct<x: double, y: double>>")
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-40, 90, (80, 2)))], "id int, x double, y double")
    zones = lambda share: sorted(tuple(r) for r in P.zone_cells(b, c, share=share).select("parcel_id", "id", "zone").collect())
    few = zones(10)
    assert few == zones(10**6) and len(few) == len(set(few))
    at = {r.id: (r.x, r.y) for r in c.collect()}
    want = []
    for k, (x, y) in enumerate(spots):
        for i, (u, v) in at.items():
            d = float(np.hypot(max(0, x - u, u - x - 3), max(0, y - v, v - y - 3)))
            if 0 < d <= 30.5:
                want.append((str(k), i, 1 if d <= 1.5 else 2 if d <= 9 else 3))
    assert few == sorted(want)


def test_nearest_where_is_whole_at_any_distance(spark):
    rng = np.random.default_rng(6)
    for share in (0.0, 0.002, 0.3):
        flags = rng.random((70, 50)) < share
        flags[69, 3] = True
        cells = grid(spark, flags.astype(float)).withColumn("name", F.when(F.col("row") % 2 == 0, F.concat_ws("-", "row", "col")))
        out = G.nearest_where(cells, F.col("z") == 1, ["row", "col", "name"])
        assert out.columns == [*cells.columns, "near_d2", "near_row", "near_col", "near_name"]
        at = np.argwhere(flags)
        for r in out.collect():
            d2, row, col = min((int(((x - (r.row, r.col)) ** 2).sum()), int(x[0]), int(x[1])) for x in at)
            assert (r.near_d2, r.near_row, r.near_col, r.near_name) == (d2, row, col, f"{row}-{col}" if row % 2 == 0 else None)
            assert r.name == (f"{r.row}-{r.col}" if r.row % 2 == 0 else None)
    none = G.nearest_where(grid(spark, np.zeros((3, 4))), F.col("z") == 1, ["z"])
    assert none.count() == 12 and none.where("near_d2 is not null or near_z is not null").isEmpty()
    assert G.nearest_where(grid(spark, np.zeros((3, 4))).limit(0), F.col("z") == 1, ["z"]).count() == 0


def test_lower_envelope_is_linear_and_exact():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 60):
        at = np.sort(rng.choice(200, n, replace=False))
        height = rng.integers(0, 50, n) ** 2
        kept, since = G.lower_envelope(at, height)
        assert all(np.diff(since) > 0) and len(kept) <= n
        for i in range(-20, 220):
            cost = (i - at) ** 2 + height
            assert kept[np.searchsorted(since, i, side="right") - 1] == cost.argmin()
    assert len(G.lower_envelope(np.arange(200_000), np.zeros(200_000, int))[0]) == 200_000


def test_snap_wind_keeps_repeats(spark):
    bins = spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate((d, s) for d in (0.0, 90.0, 180.0, 270.0) for s in (10.0, 20.0))], "bin_dir double, bin_speed double, ord int")
    asked = spark.createDataFrame([(350.0, 19.0), (350.0, 19.0), (45.0, 15.0)], "wind_dir double, wind_speed double")
    assert sorted(tuple(r)[2:4] for r in X.snap_wind(asked, bins).collect()) == [(0.0, 10.0), (0.0, 20.0), (0.0, 20.0)]


def test_percentiles_of_hot_scores(spark):
    rows = [(float(x),) for x in [5.0] * 200 + [5.001, 7.0, 7.0, 9.5]] + [(None,)]
    out = S.risk_percentile(spark.createDataFrame(rows, "wildfire_risk_score double")).collect()
    scores = sorted(x for x, in rows if x is not None)
    assert len(out) == len(rows)
    for r in out:
        x = r.wildfire_risk_score
        assert r.risk_percentile is None if x is None else abs(r.risk_percentile - 100 * scores.index(x) / (len(scores) - 1)) < 1e-9


def test_isochrone_features_and_layers(spark, tmp_path):
    import json

    point = lambda x, y: {"x": x, "y": y}
    lines = spark.createDataFrame([(0.5, [point(-79.0, 36.0), point(-79.1, 36.1), point(-79.2, 36.1)]), (15.0, [point(-79.0, 36.0), point(-79.2, 36.1)])], "level double, points array<struct<x: double, y: double>>")
    K.export_isochrones(lines, f"{tmp_path}/iso")
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/iso").collect()), key=lambda f: f["properties"]["minutes"])
    want = ((0.5, "30 sec", [[-79.0, 36.0], [-79.1, 36.1], [-79.2, 36.1]]), (15.0, "15 min", [[-79.0, 36.0], [-79.2, 36.1]]))
    assert got == [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": c}, "properties": {"minutes": m, "label": t}} for m, t, c in want]
    K.write_param_layers(spark.createDataFrame([(0, 1, 0.5, "TU1")], "row int, col int, w1 double, model string"), f"{tmp_path}/layers", ["w1"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/layers").select("row", "col", "w1").collect()] == [(0, 1, 0.5)]


def test_scenarios_of_a_file(spark, tmp_path):
    low = {"wind_speed_mph": 10, "wind_direction_deg": 180, "fuel_moisture_1hr": 0.12, "note": ["a", 1]}
    (tmp_path / "c.json").write_text(json.dumps({"scenarios": {"low": low, "odd": {"wind_speed_mph": "fast"}, "runs": 9}, "other": {}}))
    path = str(tmp_path / "c.json")
    assert {tuple(r) for r in R.read_scenarios(spark, path).collect()} == {("low", 10.0, 180.0, 0.12), ("odd", None, None, None)}
    got = {(r.name, r.setting): r.value for r in R.read_config_dims(spark, path, "scenarios").collect()}
    assert got[None, "runs"] == "9" and got["low", "note"] == '["a", 1]' and len(got) == 6
    assert R.read_config_dims(spark, path, "other").count() == 0 == R.read_scenarios(spark, path).where("scenario = 'runs'").count()
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"scenarios": {"low": low}}))
    assert R.read_scenarios(spark, str(tmp_path / "c.yaml")).first().wind_dir == 180.0


def test_list_ranks_of_chains_and_rings(spark):
    from perilframe.operators.chains import list_ranks

    rng = np.random.default_rng(8)
    nodes, rows, want, at = rng.permutation(4000), [], {}, 0
    for size, closed in [(1, False), (2, True), (700, False), (1, True), (257, True), (64, False), (33, True), (3, True)] * 2:
        own = nodes[at : at + size].tolist()
        at += size
        if closed:
            k = own.index(min(own))
            own = own[k:] + own[:k]
        rows += [("k", n, own[(i + 1) % size] if closed or i + 1 < size else None) for i, n in enumerate(own)]
        want |= {n: (own[0], i, closed) for i, n in enumerate(own)}
    links = spark.createDataFrame(rows + [("other", n, m) for _, n, m in rows[:3]], "k string, node long, next long")
    got = {r.node: (r.chain, r.rank, r.closed) for r in list_ranks(links.where("k = 'k'"), ("k",)).collect()}
    assert got == want
    assert list_ranks(links.limit(0), ("k",)).count() == 0
    small = spark.createDataFrame([("a", 1, 2), ("a", 2, None), ("b", 1, 2), ("b", 2, 1)], "k string, node long, next long")
    assert {(r.k, r.node, r.chain, r.rank, r.closed) for r in list_ranks(small, ("k",)).collect()} == {("a", 1, 1, 0, False), ("a", 2, 1, 1, False), ("b", 1, 1, 0, True), ("b", 2, 1, 1, True)}


def test_isochrone_lines_are_whole(spark):
    # A cone gives one closed line; a slope one from edge to edge; a lone low cell a diamond of four sides; a missing cell ends lines.
    r, c = np.mgrid[0:30, 0:30]
    cone = np.hypot(r - 14.3, c - 15.2)
    slope = c + 0.1 * r
    dot = np.full((30, 30), 90.0)
    dot[4, 7] = 10
    holed = slope.astype(object)
    holed[12, 9] = None
    rows = [(k, int(y), int(x), None if z[y, x] is None else float(z[y, x])) for k, z in (("cone", cone), ("slope", slope), ("dot", dot)) for y in range(30) for x in range(30)]
    rows += [("holed", y, x, float(slope[y, x])) for y in range(30) for x in range(30) if holed[y, x] is not None]
    cells = spark.createDataFrame(rows, "k string, row int, col int, toa double")
    levels = spark.createDataFrame([(k, 9.7) for k in ("cone", "slope", "holed")] + [("dot", 50.0)], "k string, level double")
    got = {}
    for x in X.isochrone_lines(cells, levels, ("k",)).collect():
        got.setdefault(x.k, []).append((x.closed, [(p.x, p.y) for p in x.points]))
    (closed, ring), = got["cone"]
    assert closed and ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1
    assert all(abs(math.hypot(y - 14.3, x - 15.2) - 9.7) < 0.1 for x, y in ring)
    assert all(math.hypot(a[0] - b[0], a[1] - b[1]) < 1.5 for a, b in zip(ring, ring[1:]))
    (closed, line), = got["slope"]
    assert not closed and {line[0][1], line[-1][1]} == {0.0, 29.0} and all(abs(x + 0.1 * y - 9.7) < 1e-9 for x, y in line)
    (closed, ring), = got["dot"]
    assert closed and sorted(ring[:-1]) == [(6.5, 4.0), (7.0, 3.5), (7.0, 4.5), (7.5, 4.0)]
    assert len(got["holed"]) == 2 and not any(closed for closed, _ in got["holed"])


def heap_fill(z, eps=0.0):
    """Water from the edge inwards, lowest first; cells without a value let it through and are no outlets."""
    rows, cols = z.shape
    low = np.where(np.isnan(z), -9999.0, z)
    edge = [(r, c) for r in range(rows) for c in range(cols) if (r in (0, rows - 1) or c in (0, cols - 1)) and not np.isnan(z[r, c])]
    level = {rc: low[rc] for rc in edge}
    heap = [(level[rc], rc) for rc in edge]
    heapq.heapify(heap)
    while heap:
        v, (r, c) = heapq.heappop(heap)
        if v > level[r, c]:
            continue
        for y in range(max(r - 1, 0), min(r + 2, rows)):
            for x in range(max(c - 1, 0), min(c + 2, cols)):
                w = max(low[y, x], v + eps)
                if w < level.get((y, x), math.inf):
                    level[y, x] = w
                    heapq.heappush(heap, (w, (y, x)))
    return np.array([[level[r, c] for c in range(cols)] for r in range(rows)])


@pytest.mark.parametrize("eps", [0.0, 1e-3])
def test_fill_is_a_heap_fill_whatever_the_tiles(spark, eps):
    rng = np.random.default_rng(12)
    rough = rng.random((23, 31)) * 10
    rough[5:8, 9:12] = np.nan
    bowl = np.full((40, 40), 50.0) + rng.random((40, 40))  # a pit wider than a tile, with a gap in its rim
    bowl[4:36, 4:36] = 5 + rng.random((32, 32))
    bowl[0:5, 20] = 30.0
    steps = np.round(rng.random((20, 20)) * 3)  # ties
    for z, tile in ((rough, 4), (rough, 64), (bowl, 8), (steps, 7)):
        got = back(H.fill_depressions(grid(spark, z).withColumn("z", F.nanvl("z", F.lit(None).cast("double"))), eps=eps, tile=tile), "filled", z.shape)
        assert np.allclose(got, heap_fill(z, eps), atol=1e-9)
    if not eps:
        assert back(H.fill_depressions(grid(spark, bowl), tile=8), "filled", bowl.shape)[20, 20] == 30.0


def test_barriers_take_a_logarithm_of_rounds(spark):
    from perilframe.operators.forest import least_barriers

    rng = np.random.default_rng(3)
    n = 600  # a chain, which takes as many steps as it has nodes, and side ways
    edges = [(i, i + 1, float(rng.integers(1, 50))) for i in range(n)] + [(int(a), int(b), float(rng.integers(1, 50))) for a, b in rng.integers(0, n, (60, 2))] + [(n, -1, 7.0), (9_000, 9_001, 1.0)]
    got, rounds = least_barriers(spark.createDataFrame(edges, "a long, b long, w double"))
    near, best, heap = {}, {}, [(-math.inf, -1)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        v, a = heapq.heappop(heap)
        if a not in best:
            best[a] = v
            for b, w in near[a]:
                heapq.heappush(heap, (max(v, w), b))
    del best[-1]
    assert {r.node: r.level for r in got.collect()} == best
    assert rounds <= math.log2(n) + 1


def test_reach_by_buckets_and_tiles(spark):
    from perilframe.operators.reach import reach

    def layer(n):
        rng = np.random.default_rng(n)
        rate = 2.0 + 30 * rng.random((n, n))
        rate[n // 3, : 2 * n // 3] = 0  # a wall, around which ways turn back
        return spark.createDataFrame([(r, c, float(rate[r, c])) for r in range(n) for c in range(n)], "row int, col int, rate double")

    work = {}
    for n, delta in ((10, 8.0), (20, 8.0)):
        edges = X.travel_cost_edges(layer(n), 20.0, 225.0).cache()
        sources = spark.createDataFrame([("a", 0, 0), ("b", n - 1, 3), ("c", n // 2, n // 2)], "source_id string, row int, col int")
        got, told = reach(edges, sources, 24.0, delta, tile=5, tell=True)
        got = {tuple(r)[:3]: r.arrival for r in got.collect()}
        near = {}
        for e in edges.collect():
            near.setdefault((e.row, e.col), []).append((e.row2, e.col2, e.minutes))
        want = {}
        for s, *start in sources.collect():
            heap = [(0.0, tuple(start))]
            while heap:
                t, rc = heapq.heappop(heap)
                if t <= 24 and (s, *rc) not in want:
                    want[(s, *rc)] = t
                    for r, c, m in near.get(rc, ()):
                        heapq.heappush(heap, (t + m, (r, c)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert told["settled"] == len(want) and told["buckets"] <= 9
        work[n, delta] = told["solved"] / told["settled"]
    assert work[20, 8.0] < 1.5 * work[10, 8.0] + 0.5  # work goes with the cells reached
    none = spark.createDataFrame([], "source_id string, row int, col int")
    assert X.reach_within_budget(edges, none, 5.0).count() == 0


def test_texts_are_found_by_their_grams(spark):
    from perilframe.operators.lookups import resolve_property

    rng = np.random.default_rng(4)
    words = ["Oak", "Elm", "oakum", "élan", "Unit 7", "UNIT 77", "12", "7", "ab", "100% new", "a_b"]
    rows = [(f"p{i:03}", " ".join(rng.choice(words, 3)), None if i % 9 == 0 else str(rng.choice(words))) for i in range(80)] + [("p900", None, None), ("p000x", "Oak Elm oakum", "12")]
    properties = spark.createDataFrame(rows, "parcel_id string, address string, name string")
    texts = ["oak", "OAKUM", "k e", "Élan", "unit 77", "7", "ab", "1", "%", "a_b", "nowhere", "oak elm oakum 12", "12 unit", "", None, "zz", "k", "unit 7 7"]
    asked = [(i, None, t) for i, t in enumerate(texts)] + [(100, "p900", "oak"), (101, "gone", "oak"), (102, "p005", None)]
    hays = {i: " ".join(x for x in (a, n) if x is not None).lower() for i, a, n in rows}
    want = {i: p if p in hays else min((h for h, v in hays.items() if t and t.lower() in v), default=None) for i, p, t in asked}
    out = resolve_property(spark.createDataFrame(asked, "request_id int, parcel_id string, text string"), properties)
    assert {r.request_id: r.resolved_id for r in out.collect()} == want and out.count() == len(asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Contains" not in plan.split("Join")[1].split("\n")[0]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_percentiles_by_selection_are_exact(spark):
    from perilframe.operators.quantiles import exact_percentiles

    rng = np.random.default_rng(7)
    groups = {"wide": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), "ties": np.repeat([1.0, 2.0, 2.5], [500, 900, 2]), "one": [4.25], "few": rng.random(40), "mixed": np.round(rng.random(2000), 2)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("none", None), ("few", None)], "k string, x double").repartition(6)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    want = {r[0]: r[1:] for r in df.where("x is not null").groupBy("k").agg(*(F.percentile("x", F.lit(p)) for p in probs.values())).collect()}
    got = {r[0]: r[1:] for r in exact_percentiles(df, "x", probs, ("k",), pick=16).select("k", *probs).collect()}
    assert got == want
    whole = exact_percentiles(df, "x", {"m": 0.5}, pick=16).collect()
    assert [r.m for r in whole] == [df.agg(F.percentile("x", F.lit(0.5))).first()[0]]
    assert exact_percentiles(df.limit(0), "x", {"m": 0.5}).first().m is None and exact_percentiles(df.limit(0), "x", {"m": 0.5}, ("k",)).count() == 0


def test_polygons_of_several_rings(spark, tmp_path):
    square = lambda x, y, h: [[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]
    wedge = [[60.0, 0.0], [90.0, 5.0], [70.0, 40.0], [60.0, 0.0]]
    shapes = {
        "plain": ("Polygon", [square(10, 10, 8)]), "hole": ("Polygon", [square(30, 30, 20), square(25, 28, 6)[::-1], square(42, 40, 4)]),
        "parts": ("MultiPolygon", [[square(20, 20, 15), square(20, 20, 9)], [square(20, 20, 5)], [wedge]]), "point": ("Point", [1.0, 2.0]),
    }
    features = [{"type": "Feature", "properties": {"parcel_id": k}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in shapes.items()]
    (tmp_path / "p.geojson").write_text(json.dumps({"features": features}))
    df = R.read_geojson(spark, str(tmp_path / "p.geojson"), "parcel_id string").cache()
    rings = {k: c if t == "Polygon" else [r for part in c for r in part] for k, (t, c) in shapes.items() if t != "Point"}
    assert {r.parcel_id: None if r.rings is None else [[[p.x, p.y] for p in ring] for ring in r.rings] for r in df.collect()} == rings | {"point": None}

    def inside(polygon, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for ring in polygon for a, b in zip(ring, ring[1:])) % 2 == 1

    def apart(polygon, x, y):
        def one(a, b):
            t = min(max(((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2), 0), 1)
            return math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1]))

        return min(one(a, b) for ring in polygon for a, b in zip(ring, ring[1:]))

    # Area and centroid by fine cells; what is inside, and the zones, exactly.
    fine = [(x / 4 + 0.126, y / 4 + 0.127) for x in range(-20, 420) for y in range(-20, 220)]
    got = {r.parcel_id: r for r in df.where("rings is not null").select("parcel_id", geo.polygon_area(F.col("rings")).alias("a"), geo.polygon_centroid(F.col("rings")).alias("c")).collect()}
    for k, polygon in rings.items():
        held = np.array([p for p in fine if inside(polygon, *p)])
        assert abs(got[k].a - len(held) / 16) < 0.01 * got[k].a and np.allclose([got[k].c.x, got[k].c.y], held.mean(axis=0), atol=0.1)
    assert got["hole"].a == 1600 - 144 - 64 and got["parts"].a == 900 - 324 + 100 + 575
    assert {r.parcel_id for r in P.footprint_area(df.where("rings is not null"), 300.0).collect()} == {"hole", "parts"}
    assert {r.parcel_id for r in P.clip_bbox(df.where("rings is not null"), 80.0, 0.0, 99.0, 9.0).collect()} == {"parts"}
    spots = [(i, float(x) + 0.3, float(y) + 0.6) for i, (x, y) in enumerate((x, y) for x in range(-8, 100, 3) for y in range(-8, 60, 3))]
    boundary = F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring)) for ring in rings["parts"]))
    within = P.within_boundary(spark.createDataFrame(spots, "id int, cx double, cy double"), boundary, several=True)
    assert {r.id for r in within.collect()} == {i for i, x, y in spots if inside(rings["parts"], x, y)}
    zoned = P.zone_cells(df.where("rings is not null"), spark.createDataFrame(spots, "id int, x double, y double"))
    zone = lambda d: None if d <= 0 else 1 if d <= 1.5 else 2 if d <= 9 else 3 if d <= 30.5 else None
    want = {(k, i): zone(0 if inside(p, x, y) else apart(p, x, y)) for k, p in rings.items() for i, x, y in spots}
    assert {(r.parcel_id, r.id): r.zone for r in zoned.collect()} == {k: z for k, z in want.items() if z}
    cells = spark.createDataFrame([(r, c, 1, float(r + c), 0.0, 0.0, 0.0) for r in range(30) for c in range(50)], "row int, col int, red int, ndvi double, ndwi double, evi double, npv double")
    stats = {r.parcel_id: r.ndvi_mean for r in V.zonal_veg_stats(df.where("rings is not null").select("parcel_id", "rings"), cells, 2.0, 0.0, 60.0).collect()}
    for k, p in rings.items():
        assert stats[k] == pytest.approx(np.mean([r + c for r in range(30) for c in range(50) if inside(p, (c + 0.5) * 2, 60 - (r + 0.5) * 2)]))


def test_trained_model_as_a_table_of_nodes(spark, tmp_path):
    rng = np.random.default_rng(21)
    rows = [(i, *(None if rng.random() < 0.05 else float(np.round(x, 3)) for x in rng.random(len(S.MODEL_FEATURES)) * 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} double" for f in S.MODEL_FEATURES))
    a, b = (F.coalesce(S.MODEL_FEATURES[k], F.lit(0.0)) for k in (0, 5))
    df = df.withColumn("label", a / 8 + F.when(b > 2, 0.3).otherwise(0.05)).cache()
    model = S.train_risk_model(df, "label", trees=6, depth=3)
    S.save_model(model, f"{tmp_path}/model")
    want = {r.id: r.model_score for r in S.model_score(S.load_model(f"{tmp_path}/model"), df).collect()}
    nodes = S.model_nodes(model, spark)
    assert nodes.select("tree").distinct().count() == 6 and nodes.where("feature is null").count() == nodes.where("feature is not null").count() + 6
    got = {r[0]: r[1] for r in df.select("id", S.tree_score(nodes)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    con = duckdb.connect()
    con.register("t", df.toPandas())
    said = dict(con.execute(f"SELECT id, {S.tree_sql(nodes)} FROM (SELECT * REPLACE ({', '.join(f'CASE WHEN isnan({f}) THEN NULL ELSE {f} END AS {f}' for f in S.MODEL_FEATURES)}) FROM t)").fetchall())
    assert all(abs(said[i] - want[i]) < 1e-9 for i in want)
    top = [(r.feature, r.importance) for r in S.feature_importance(model, spark).collect()]
    assert {f for f, _ in top[:2]} == {S.MODEL_FEATURES[0], S.MODEL_FEATURES[5]} and abs(sum(x for _, x in top) - 1) < 1e-9 and [x for _, x in top] == sorted((x for _, x in top), reverse=True)
    e = np.array([want[r.id] / 100 - r.label for r in df.collect()])
    y = np.array([r.label for r in df.collect()])
    m = S.model_metrics(model, df, "label").first()
    assert np.allclose([m.rmse, m.mae, m.r2], [np.sqrt((e**2).mean()), np.abs(e).mean(), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()], atol=1e-6) and m.r2 > 0.5


def test_climatology_draws_by_station_and_day(spark):
    spans = spark.createDataFrame([("a", 0, 3650), ("b", 0, 3650)], "station string, x int, y int").select("station", F.date_add(F.lit("2010-01-01").cast("date"), F.col("x")).alias("start"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("y")).alias("end"))
    climate = spark.createDataFrame([(m, 70.0, 50.0, 3.0) for m in range(1, 13)], "month int, tmax_f double, tmin_f double, precip_in double")
    df = W.climatology(spans, climate).toPandas()
    assert len(df) == 2 * 3651 and not df.duplicated(["station", "date"]).any()
    # Means and spreads of a normal, a gamma of shape 2, an exponential and a choice, within four standard errors.
    n = len(df) ** 0.5
    assert abs(df.temp_f.mean() - 70) < 20 / n and abs(df.temp_f.std() - 5) < 15 / n and abs(df.temp_min_f.mean() - 50) < 20 / n
    assert abs(df.wind_speed_mph.mean() - 8) < 4 * 5.7 / n and abs(df.wind_speed_mph.var() - 32) < 4 * 32 * 2.3 / n
    assert abs(df.precip_in.mean() - 0.1) < 0.4 / n and abs(df.precip_in.std() - 0.1) < 0.9 / n
    assert (abs(df.wind_dir_deg.value_counts(normalize=True).loc[[180.0, 225.0, 270.0]] - 1 / 3) < 4 * 0.48 / n).all()
    a, b = (df[df.station == s].sort_values("date") for s in "ab")
    assert abs(np.corrcoef(a.temp_f, b.temp_f)[0, 1]) < 4 / 3651**0.5 and abs(np.corrcoef(a.temp_f, a.temp_min_f)[0, 1]) < 4 / 3651**0.5
    later = W.climatology(spans.where("station = 'b'").withColumn("start", F.date_add("start", 100)).repartition(3), climate).orderBy("date").first()
    assert (later.temp_f, later.precip_in) == tuple(b.iloc[100][["temp_f", "precip_in"]])


def test_totals_before_in_levels(spark):
    from perilframe.operators.prefix import totals_before

    rng = np.random.default_rng(5)
    orders = np.unique(rng.integers(-40_000, 40_000, 900))
    rows = [(int(o), int(v)) for o, v in zip(orders, rng.integers(0, 9, len(orders)))]
    got = {r.o: r.t for r in totals_before(spark.createDataFrame(rows, "o long, v long").repartition(5), "o", "v", "t", span=16).collect()}
    assert got == dict(zip(orders.tolist(), (np.cumsum([v for _, v in rows]) - [v for _, v in rows]).tolist()))
    assert totals_before(spark.createDataFrame([], "o long, v long"), "o", "v", "t").count() == 0


def test_correlation_of_arrivals_at_one_time(spark):
    from perilframe.operators.validation import arrival_correlation

    run = lambda *toa: spark.createDataFrame([(0, k, t) for k, t in enumerate(toa)], "row int, col int, toa double")
    r = lambda a, b: arrival_correlation(run(*a), run(*b)).first().r
    assert math.isnan(r([1.0, 1.0, 1.0], [1.0, 2.0, 4.0])) and math.isnan(r([1.0, 3.0], [2.0, 2.0])) and math.isnan(r([1.0], [2.0]))
    assert r([1.0, None], [None, 2.0]) is None
    assert r([1.0, 2.0, 4.0, None], [3.0, 1.0, 7.0, 8.0]) == pytest.approx(np.corrcoef([1, 2, 4], [3, 1, 7])[0, 1])
    want = duckdb.sql("SELECT corr(x, y) FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE), (1.0, 2.0)) t(x, y)").fetchall()
    assert math.isnan(want[0][0])


def test_equal_polygons_are_measured_once(spark):
    ring = lambda x, h: [{"x": x + a * h, "y": 5.0 + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    rows = [(str(k), None if k % 10 == 9 else ring(40.0 * (k % 3), 3.0)) for k in range(60)]
    b = spark.createDataFrame(rows, "parcel_id string, ring array<struct<x: double, y: double>>")
    cells = spark.createDataFrame([(x * 4.0 - 38, y * 4.0 - 31, float((x + y) % 3), "TU1" if (x * y) % 2 else "GR1", float(x % 5)) for x in range(40) for y in range(18)], "x double, y double, load double, model string, canopy_height double")
    seen = []

    def measure(shapes):
        seen.append(shapes.count())
        return P.zone_metrics(shapes, P.zone_cells(shapes, cells))

    once, each = P.once_a_shape(b, measure), P.zone_metrics(b, P.zone_cells(b, cells))
    assert seen == [4] and once.columns == each.columns
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert len(key(once)) == 60 and str(key(once)) == str(key(each))
    report = P.proximity_report(b, cells).collect()
    assert len(report) == 60 and {(r.neighbor_distance_m, r.neighbor_flag_15m) for r in report} == {(0.0, True), (None, False)}


def test_area_and_centroid_of_parts_once_a_row(spark):
    ring = lambda x, y, h: [{"x": float(x + a * h), "y": float(y + b * h)} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    line = [{"x": 1.0, "y": 2.0}, {"x": 4.0, "y": 6.0}]
    rows = [(1, [ring(9, 9, 2), ring(9, 9, 4), ring(21, 9, 3)]), (2, [line, ring(0, 0, 5)]), (3, [line]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>")
    area, c = geo.polygon_area(F.col("rings")), geo.polygon_centroid(F.col("rings"))
    got = {r.id: (r.a, r.x, r.y) for r in df.select("id", area.alias("a"), c["x"].alias("x"), c["y"].alias("y")).collect()}
    assert got[1] == pytest.approx((84.0, (48 * 9 + 36 * 21) / 84, 9.0)) and got[2] == pytest.approx((100.0, 0.0, 0.0))
    assert got[3] == (0.0, 2.5, 4.0) and got[4] == (None, None, None) and got[5] == (0.0, None, None)
    # Sides are listed once, not for each use.
    plan = df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1


def test_attributions_are_ranked_in_their_row(spark):
    from perilframe.operators import attribution as A

    names = S.MODEL_FEATURES
    rng = np.random.default_rng(12)
    rows = [(str(k), *(None if x == 4 else float(x) for x in rng.integers(-3, 5, len(names)))) for k in range(40)]
    df = spark.createDataFrame(rows, "parcel_id string, " + ", ".join(f"{n} double" for n in names))
    features = dims.dim(spark, "features")
    wide = A.attributed(df, features)
    long = [r.asDict() for r in A.attribute_linear(df, features).collect()]
    top, helps, edges = A.top_risks(wide), A.top_mitigations(wide), A.waterfall_rows(wide, 10.0)
    for out in (top, helps, edges, A.attribution_summary(wide), A.controllable_points(wide)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan
    got, bars = {(r.parcel_id, r["rank"]): r for r in top.collect()}, {(r.parcel_id, r["rank"]): r for r in edges.collect()}
    mild = {(r.parcel_id, r["rank"]): r.feature for r in helps.collect()}
    for k in range(40):
        own = [r for r in long if r["parcel_id"] == str(k)]
        want = sorted(own, key=lambda r: (r["contribution"] is None, -abs(r["contribution"] or 0), r["feature"]))[:5]
        left = 10.0
        for j, r in enumerate(want, 1):
            assert all(got[str(k), j][c] == v for c, v in r.items())
            assert (bars[str(k), j].left_edge, bars[str(k), j].right_edge) == pytest.approx((left, left + r["contribution"]))
            left += r["contribution"]
        good = sorted((r for r in own if r["controllable"] and (r["contribution"] or 0) > 0), key=lambda r: (-r["contribution"], r["feature"]))[:3]
        assert [mild.get((str(k), j)) for j in (1, 2, 3)] == [*(r["feature"] for r in good), None, None, None][:3]


def test_training_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(S, "TRAINING_ROWS", 50)
    df = S.wildfire_score(Inputs(spark, SF).properties.limit(150).coalesce(1)).withColumn("label", F.col("wildfire_risk_score") / 100)
    assert df.rdd.getNumPartitions() == 1
    assert S.dealt(df, "label").rdd.getNumPartitions() == 3 and S.dealt(df, "label").count() == 150
    assert S.dealt(df.limit(0), "label").rdd.getNumPartitions() == 1


def test_texts_meet_their_rarest_gram_alone(spark, monkeypatch):
    from perilframe.operators import lookups as L

    hay = spark.createDataFrame([(f"{k:03}", f"unit {k}, xy") for k in range(200)] + [("500", None), ("501", "unit 7, xy")], "id string, hay string")
    texts = spark.createDataFrame([(t,) for t in ("unit 7", "unit 77", "unit", "it 199", "unit 7,", "99", "7", "nowhere", "unit 2000")], "text string")
    stored, kept = L.stored, []
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append(name) or stored(df, name))
    out = {r.text: r.id for r in L.first_containing(texts, hay).collect()}
    want = {"unit 7": "007", "unit 77": "077", "unit": "000", "it 199": "199", "unit 7,": "007", "99": "099", "7": "007"}
    assert out == want and "postings" not in kept
