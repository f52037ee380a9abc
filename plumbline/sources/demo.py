"""The demonstration scene: one parcel, a building of eight storeys, seventeen volumes and a corridor, with two conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .cadastre import Cadastre

#: Fixed values of the scene.
PARCEL, BUILDING, CORRIDOR = (0.0, 0.0, 80.0, 52.0), (10.0, 8.0, 70.0, 44.0), (18.0, 21.0, 62.0, 25.0)
FLOORS, FLOOR_HEIGHT, OVERLAP_FLOOR, ENCROACHING_FLOOR = 8, 3.2, 2, 5
_BOX = "x0 double, y0 double, x1 double, y1 double"


def scene(spark: SparkSession) -> Cadastre:
    """The scene's collections under the names that the rules read."""
    storey = lambda k: (round((k - 1) * FLOOR_HEIGHT, 3), round(k * FLOOR_HEIGHT, 3))
    volumes = [(0, "PV-B001", -1, "Basement Parking", "MAPPED", *BUILDING, -3.2, 0.0)]
    for k in range(1, FLOORS + 1):
        right = {OVERLAP_FLOOR: (35.0, 8.0, 70.0, 44.0), ENCROACHING_FLOOR: (40.0, 8.0, 86.0, 44.0)}.get(k, (40.0, 8.0, 70.0, 44.0))
        for n, box in ((1, (10.0, 8.0, 40.0, 44.0)), (2, right)):
            status = "HUMAN_REVIEW_REQUIRED" if n == 2 and k == ENCROACHING_FLOOR else "MAPPED"
            volumes.append((len(volumes), f"PV-{k}0{n}", k, f"Apartment {k}0{n}", status, *box, *storey(k)))
    make = spark.createDataFrame
    tables: dict[str, DataFrame] = {
        "parcels": make([(0, "P-001", *PARCEL, "RESIDENTIAL", 0)], f"seq long, id string, {_BOX}, land_use string, nation int"),
        "buildings": make([(0, "B-001", "P-001", *BUILDING, FLOORS, 0)], f"seq long, id string, parcel_id string, {_BOX}, floor_count int, cust long"),
        "floors": make([(k, f"B-001-F{k}", "B-001", k, *BUILDING, *storey(k)) for k in range(1, FLOORS + 1)], f"seq long, id string, building_id string, floor_number int, {_BOX}, z_min double, z_max double"),
        "properties": make([(q, i, "B-001", "P-001", k, label, 1, "P-001", *rest[:-2], *rest[-2:], f"VC-VP-P001-{i.replace('-', '')}", 0, 0, status) for q, i, k, label, status, *rest in volumes], f"seq long, id string, building_id string, parcel_id string, floor_number int, unit_label string, block long, site string, {_BOX}, z_min double, z_max double, ulpin string, part long, supp long, status string"),
        "infrastructure": make([(0, "I-001", *CORRIDOR, -2.2, 0.0, "UTILITY")], f"seq long, id string, {_BOX}, z_min double, z_max double, kind string"),
        "sources": make([("DS-001", "SURVEY", "demo.geojson", "EPSG:4326")], "id string, source_type string, filename string, crs string"),
    }
    return Cadastre(spark, tables)
