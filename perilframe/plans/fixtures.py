"""Derived views over the shared test tables. The same SQL runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: In order of dependence.
VIEWS: dict[str, str] = {
    "points": """
SELECT CAST((l_partkey*37 + l_linenumber*11 + l_orderkey*7) % 1000 AS DOUBLE) + l_linenumber/8.0 AS x,
       CAST((l_suppkey*53 + l_orderkey*17) % 1000 AS DOUBLE) + l_linenumber/8.0 AS y,
       100.0 + l_extendedprice/5000.0 AS z,
       CASE WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber = 4 THEN 3 WHEN l_linenumber = 5 THEN 5
            WHEN l_linenumber = 6 THEN 6 ELSE 1 END AS classification,
       CAST(l_quantity AS INT) AS intensity,
       l_returnflag AS tile
FROM lineitem
""",
    "cells": """
SELECT r AS row, c AS col, avg(z) AS z, avg(CASE WHEN classification = 2 THEN z END) AS dem, max(z) AS dsm,
       max(CASE WHEN classification = 6 THEN 1 ELSE 0 END) AS building, avg(intensity) AS intensity, count(*) AS n
FROM (SELECT CAST(least(greatest(floor((1001.0 - y)/20.0), 0), 49) AS INT) AS r,
             CAST(least(greatest(floor(x/20.0), 0), 49) AS INT) AS c, z, classification, intensity FROM points) t
GROUP BY r, c
""",
    "pixels": """
SELECT CAST(min((l_partkey*31 + l_orderkey) % 256) AS INT) AS red, CAST(max((l_suppkey*17 + l_orderkey) % 256) AS INT) AS green,
       CAST(min((l_orderkey*7) % 256) AS INT) AS blue, CAST(max((l_partkey*53) % 256) AS INT) AS nir,
       CAST(l_orderkey % 200 AS INT) AS row, CAST(l_partkey % 200 AS INT) AS col
FROM lineitem GROUP BY l_orderkey % 200, l_partkey % 200
""",
    "fuel_cells": """
SELECT row, col, CASE (row*7 + col*13) % 17 WHEN 0 THEN 101 WHEN 1 THEN 102 WHEN 2 THEN 103 WHEN 3 THEN 104 WHEN 4 THEN 107
       WHEN 5 THEN 121 WHEN 6 THEN 123 WHEN 7 THEN 128 WHEN 8 THEN 129 WHEN 9 THEN 141 WHEN 10 THEN 145 WHEN 11 THEN 161
       WHEN 12 THEN 165 WHEN 13 THEN 169 WHEN 14 THEN 91 WHEN 15 THEN 99 ELSE 55 END AS fbfm40,
       CAST((row*3 + col*5) % 30 AS DOUBLE) AS slope_deg, CAST((row*11 + col*29) % 360 AS DOUBLE) AS aspect_deg,
       CAST((row + col) % 9 AS DOUBLE) AS canopy_height, CAST((row + 2*col) % 5 AS DOUBLE) AS canopy_base
FROM cells
""",
    "properties": """
SELECT CAST(c.c_custkey AS VARCHAR(20)) AS parcel_id, c.c_name AS name, n.n_name AS county,
       concat('Unit ', CAST(c.c_custkey AS VARCHAR(20)), ', ', n.n_name) AS address,
       CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'BUILDING' THEN 'dormitory' WHEN 'MACHINERY' THEN 'garage'
            WHEN 'FURNITURE' THEN 'church' ELSE 'academic' END AS land_use,
       CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'wood_shingles_shake' WHEN 'BUILDING' THEN 'asphalt_shingles'
            WHEN 'MACHINERY' THEN 'metal_standing_seam' WHEN 'FURNITURE' THEN 'concrete_clay_tile' ELSE 'slate_tile' END AS roof_material,
       CASE c.c_custkey % 3 WHEN 0 THEN 'screened' WHEN 1 THEN 'partial' ELSE 'unscreened' END AS vent_screening_status,
       CASE c.c_custkey % 4 WHEN 0 THEN 'valley' WHEN 1 THEN 'mid_slope' WHEN 2 THEN 'upper_slope' ELSE 'ridge' END AS tpi_class,
       CAST(c.c_custkey*13 % 400 AS DOUBLE)/10 AS slope_degrees, CAST(c.c_custkey*7 % 101 AS DOUBLE)/100 AS heat_load_index,
       CAST(c.c_custkey*3 % 20 AS DOUBLE)/10 AS zone1_fuel_load, CAST(c.c_custkey*5 % 60 AS DOUBLE)/10 AS zone2_fuel_load,
       CAST(c.c_custkey*11 % 90 AS DOUBLE)/10 AS zone3_fuel_load, CAST(c.c_custkey % 11 AS DOUBLE)/10 AS zone3_fuel_continuity,
       c.c_custkey % 5 = 0 AS ladder_fuel_present, CAST(1900 + c.c_custkey % 125 AS INT) AS year_built,
       CAST(1 + c.c_custkey % 6 AS INT) AS stories, CAST(500 + (c.c_custkey*97) % 30000 AS DOUBLE) AS building_sf,
       CAST(c.c_custkey*17 % 500 AS DOUBLE)/10 AS neighbor_distance_m, CAST(c.c_custkey*19 % 101 AS DOUBLE)/100 AS ember_exposure_probability,
       CAST(c.c_custkey*23 % 250 AS DOUBLE)/10 AS hand_m, CAST((c.c_custkey*29) % 1500 AS DOUBLE) AS distance_to_stream_m,
       CAST(c.c_custkey*31 % 200 AS DOUBLE)/10 AS cti, c.c_custkey % 7 = 0 AS in_fema_100yr,
       c.c_nationkey % 6 = 0 AS is_owner_flagged, coalesce(o.v, CAST(0 AS DOUBLE)) AS assessed_value,
       CAST((c.c_custkey*37) % 1000 AS DOUBLE) AS cx, CAST((c.c_custkey*53 + 11) % 1000 AS DOUBLE) AS cy,
       CAST(3 + c.c_custkey % 5 AS DOUBLE) AS half
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100 AS v FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
""",
    "weather_long": """
SELECT CAST(o_custkey % 3 AS INT) AS station, CAST(o_orderdate AS DATE) AS date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'TMAX' WHEN '2-HIGH' THEN 'TMIN' WHEN '3-MEDIUM' THEN 'AWND'
            WHEN '4-NOT SPECIFIED' THEN 'WDF2' ELSE 'PRCP' END AS datatype,
       CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 200 + o_orderkey % 180 WHEN '2-HIGH' THEN o_orderkey % 200
            WHEN '3-MEDIUM' THEN 10 + o_orderkey % 120 WHEN '4-NOT SPECIFIED' THEN o_orderkey % 360
            ELSE (CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 ELSE 0 END) END AS DOUBLE) AS value, o_orderkey AS seq
FROM orders
""",
    "weather_daily": """
SELECT station, date, coalesce(min(CASE WHEN datatype='TMAX' THEN value END), 290.0)/10.0 AS temp_c,
       least(100.0, 20.0 + coalesce(min(CASE WHEN datatype='TMIN' THEN value END), 90.0)/3.0) AS rh_pct,
       coalesce(min(CASE WHEN datatype='AWND' THEN value END), 40.0)*0.36 AS wind_kmh,
       coalesce(min(CASE WHEN datatype='PRCP' THEN value END), 0.0)/10.0 AS precip_mm,
       CAST(row_number() OVER (PARTITION BY station ORDER BY date) AS INT) AS day_no
FROM weather_long GROUP BY station, date
""",
    "runs": """
SELECT CAST(l_linenumber AS INT) AS run_id, CAST(l_orderkey % 40 AS INT) AS row, CAST(l_partkey % 40 AS INT) AS col,
       CASE WHEN min(l_quantity) > 25 THEN NULL ELSE min(l_quantity) END AS toa, max(l_extendedprice)/100.0 AS intensity
FROM lineitem GROUP BY l_linenumber, l_orderkey % 40, l_partkey % 40
""",
    "requests": """
SELECT CAST(event_id AS BIGINT) AS request_id, CAST(user_id AS VARCHAR(20)) AS parcel_id, event_type AS kind, ts,
       35 + CAST(event_id % 20 AS DOUBLE)/10 AS ignition_lat, -80 + CAST(event_id % 25 AS DOUBLE)/10 AS ignition_lon, value AS wind_speed_mph
FROM events
""",
}


def names_in(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = names_in(sql, (*TABLES, *VIEWS))
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str, extra: dict[str, str]) -> str:
    """sql as one statement: the views and tables of fixed values that it needs come before it."""
    known = VIEWS | extra
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for n in names_in(text, known):
            if n not in needed:
                visit(known[n])
                needed[n] = None

    visit(sql)
    head = ",\n".join(f"{n} AS ({known[n].strip()})" for n in needed)
    if not head:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"(?i)^with\s+recursive\b", "", body)
    return f"WITH {head},\n" + body[4:] if body[:5].lower() == "with " or body[:5].lower() == "with\n" else f"WITH {head}\n{body}"
