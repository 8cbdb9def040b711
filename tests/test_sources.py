import json

from pyspark.sql import functions as F

from spark_climbs.sources import overpass, tables, tiles
from spark_climbs.streaming.documents import ingest_documents

WAYS = {
    "elements": [
        {"type": "way", "id": 1, "tags": {"name": "A"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": None, "lon": 2.1}, {"lat": 1.2, "lon": 2.2}]},
        {"type": "way", "id": 2, "nodes": [11, 12, 13]},
        {"type": "node", "id": 11, "lat": 5.0, "lon": 6.0},
        {"type": "node", "id": 13, "lat": 5.2, "lon": 6.2},
        {"type": "way", "id": 3, "geometry": [{"lat": 1.0, "lon": 2.0}]},
        {"type": "way", "id": 4},
    ]
}


def documents(folder):
    folder.mkdir(exist_ok=True)
    (folder / "a.json").write_text("junk before " + json.dumps(WAYS, indent=1))
    (folder / "b.json").write_text("junk {bad")
    (folder / "c.json").write_text("no object here")
    return str(folder)


def test_overpass(spark, tmp_path):
    ways = overpass.ways_from_elements(overpass.read_overpass_json(spark, documents(tmp_path / "docs")))
    got = {r.way_id: [(n.node_id, n.lat, n.lon) for n in r.nodes] for r in ways.collect()}
    assert got == {1: [("1_0", 1.0, 2.0), ("1_2", 1.2, 2.2)], 2: [("11", 5.0, 6.0), ("13", 5.2, 6.2)]}
    assert {r.way_id: r.start_lat for r in overpass.way_start(ways).collect()} == {1: 1.0, 2: 5.0}
    assert overpass.explode_nodes(ways).count() == 4


def test_stream_takes_each_document_once(spark, tmp_path):
    folder = documents(tmp_path / "docs")
    out, checkpoint = str(tmp_path / "ways"), str(tmp_path / "cp")
    for _ in range(2):
        ingest_documents(spark, folder, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "docs" / "d.json").write_text(json.dumps(WAYS))
    ingest_documents(spark, folder, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_tiles(spark, tmp_path):
    (tmp_path / "manifest.txt").write_text("n06e162\n\n  s14w170.tif \n")
    (tmp_path / "bad.txt").write_text("n06e162\n")
    inventory = tiles.read_tile_manifest(spark, str(tmp_path / "manifest.txt"))
    flagged = tiles.flag_bad_tiles(inventory, tiles.read_bad_tiles(spark, str(tmp_path / "bad.txt")))
    assert {r.tile: (r.is_bad, r.repacked_name) for r in flagged.collect()} == {
        "n06e162": (True, "n06e162.SRTMGL1.repacked.hgt.zip"),
        "s14w170": (False, None),
    }


def test_file_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.hgt", "b.txt", "sub/c.hgt"):
        (tmp_path / name).write_text("x")

    def names(**options):
        return sorted(r.file_name for r in tables.list_files(spark, str(tmp_path), **options).collect())

    assert names(pattern="*.hgt") == ["a.hgt"]
    assert names(pattern="*.hgt", recursive=True) == ["a.hgt", "c.hgt"]


def test_report_export_keeps_order(spark, tmp_path):
    ranked = spark.range(1000).orderBy(F.desc("id"))
    for fmt in ("csv", "parquet"):
        tables.write_report(ranked, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1000
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1000
