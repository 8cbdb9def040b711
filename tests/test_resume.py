"""An interrupted and resumed analysis equals a straight one."""

import pytest
from pyspark.sql import functions as F

from spark_climbs import fixtures as X
from spark_climbs import schemas
from spark_climbs.operators.area import chunk_grid
from spark_climbs.plans import resume
from spark_climbs.plans.catalog import CENTER
from spark_climbs.sources.stages import read_table

SF = "/root/testdata/sf0.001"


def chunks(spark, analysis_id):
    area = spark.createDataFrame([(analysis_id, *CENTER, 60.0)], "area_id string, center_lat double, center_lon double, radius_km double")
    return chunk_grid(area, 16.0)


def run(spark, base, analysis_id, only=None, **options):
    grid = chunks(spark, analysis_id)
    return resume.process_chunks(
        X.plain_ways(spark, SF), grid if only is None else grid.filter(only), base, analysis_id, size_km=16.0, n_batches=2, **options
    )


def test_resumed_equals_straight(spark, tmp_path):
    straight, base = str(tmp_path / "a"), str(tmp_path / "b")
    want = run(spark, straight, "run_1")
    run(spark, base, "run_1", F.col("chunk_index") % 3 == 0)
    status = read_table(spark, f"{base}/status", schemas.CHUNK_STATUS)
    done = status.count()
    left = resume.remaining_chunks(chunks(spark, "run_1").withColumn("analysis_id", F.col("area_id")), status).count()
    assert done > 0 and left == chunks(spark, "run_1").count() - done
    got = run(spark, base, "run_1")
    columns = ["chunk_index", "seq", "way_ids", "street_name", "surface", "tracktype"]
    assert got.count() > 0
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert run(spark, base, "run_1").count() == got.count()  # nothing left to do
    assert set(r.status for r in status.collect()) <= {"ok", "empty"}

    analyses = spark.createDataFrame([("run_1", chunks(spark, "run_1").count())], "analysis_id string, total_chunks int")
    progress = resume.analysis_progress(analyses, read_table(spark, f"{base}/status", schemas.CHUNK_STATUS)).first()
    assert progress.percentage == 100.0

    elevation = X.elevation(spark, SF)
    args = (elevation, X.places(spark, SF), CENTER)
    a = resume.finish_analysis(straight, "run_1", *args).collect()
    b = resume.finish_analysis(base, "run_1", *args).collect()
    assert a and a == b


def test_failed_batch_is_recorded_and_redone(spark, tmp_path, monkeypatch):
    base = str(tmp_path)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(resume, "write_stage", broken)
    with pytest.raises(RuntimeError):
        run(spark, base, "run_2")
    status = read_table(spark, f"{base}/status", schemas.CHUNK_STATUS)
    assert {r.status for r in status.collect()} == {"failed"}
    assert resume.saved_chunks(status).count() == 0


def test_elevation_cache_only_looks_up_what_is_missing(spark, tmp_path):
    cache = str(tmp_path / "elevation")
    coords = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "lat_e6 long, lon_e6 long")
    source = spark.createDataFrame([(1, 1, 10.0), (2, 2, None)], schemas.ELEVATION)
    assert resume.enrich_incremental(coords, source, cache).count() == 1
    asked = []

    def lookup(missing):
        asked.extend(sorted(tuple(r) for r in missing.collect()))
        return missing.withColumn("elevation", F.lit(5.0))

    got = {(r.lat_e6, r.elevation) for r in resume.enrich_incremental(coords, lookup, cache).collect()}
    assert asked == [(2, 2), (3, 3)] and got == {(1, 10.0), (2, 5.0), (3, 5.0)}


def test_find_resumable(spark):
    analyses = spark.createDataFrame([("a_1", 2), ("a_2", 2), ("a_3", 0), ("ab_9", 5)], "analysis_id string, total_chunks int")
    status = spark.createDataFrame(
        [("a_1", 0, "ok"), ("a_2", 0, "ok"), ("a_2", 1, "empty"), ("a_2", 1, "empty")], "analysis_id string, chunk_index int, status string"
    )
    none = spark.createDataFrame([], "analysis_id string")
    assert resume.find_resumable(analyses, status, none, "a").first().analysis_id == "a_1"
    cached = spark.createDataFrame([("a_2",), ("a_2",)], "analysis_id string")
    found = resume.find_resumable(analyses, status, cached, "a").first()
    assert (found.analysis_id, found.phase, found.percentage, found.elevation_coords) == ("a_2", "elevation_fetching", 100.0, 2)


def test_ways_given_twice_count_once(spark, tmp_path):
    ways = X.plain_ways(spark, SF)
    grid = chunks(spark, "twice")
    options = {"size_km": 16.0, "n_batches": 2}
    want = resume.process_chunks(ways, grid, str(tmp_path / "a"), "twice", **options)
    got = resume.process_chunks(ways.unionByName(ways), grid, str(tmp_path / "b"), "twice", **options)
    columns = ["chunk_index", "seq", "way_ids", "street_name"]
    assert want.count() and sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_chunk_that_is_empty_now_is_not_read(spark, tmp_path):
    base = str(tmp_path)
    paved = run(spark, base, "again", surface="paved").count()
    none = resume.process_chunks(X.plain_ways(spark, SF).limit(0), chunks(spark, "again"), base, "again", size_km=16.0, n_batches=2, resume=False)
    assert paved > 0 and none.count() == 0


def test_analyses_that_share_a_cut_name_are_told_apart(spark, tmp_path):
    base, long = str(tmp_path), "A very long address, number 12345, in some town far away"
    ids = [resume.begin_analysis(spark, base, long, CENTER, r, f, started=t) for r, f, t in [(30.0, "all", 1), (31.0, "all", 2), (30.0, "dirt", 3), (30.0, "all", 9)]]
    assert len({i[:40] for i in ids}) == 1 and len(set(ids)) == 4
    analyses = read_table(spark, f"{base}/analysis", schemas.ANALYSIS)
    status = read_table(spark, f"{base}/status", schemas.CHUNK_STATUS)
    none = spark.createDataFrame([], "analysis_id string")
    key = resume._key(spark, long, "all", 30.0)
    assert [r.analysis_id for r in resume.resumable_analyses(analyses, status, none, key).orderBy("analysis_id").collect()] == [ids[0], ids[3]]
    assert resume.find_resumable(analyses, status, none, key).first().analysis_id == ids[3]
    with pytest.raises(ValueError, match="no analysis"):
        resume.resume_analysis(X.plain_ways(spark, SF), X.elevation(spark, SF), X.places(spark, SF), base, "other")
