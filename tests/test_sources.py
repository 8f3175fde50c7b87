"""Scans and sinks on small files."""

from lumenfold.sources import catalogs as K


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_detections_csv(spark, tmp_path):
    path = write(tmp_path, "d.csv", "id,x,y_image,score\n1,1.5,2,0.5\n2,bad,3,1\n3,4,nan,1\n4,5,6,zz\n")
    rows = K.scan_detections_csv(spark, path).orderBy("id").collect()
    assert [(r.id, r.x, r.y, r.score) for r in rows] == [(1, 1.5, 2.0, 0.5), (4, 5.0, 6.0, None)]


def test_x_image_is_used_only_without_x(spark, tmp_path):
    path = write(tmp_path, "d.csv", "x,x_image,y\n,7,1\n2,8,3\n")
    assert [r.x for r in K.scan_detections_csv(spark, path).collect()] == [2.0]


def test_refit_csv_takes_the_last_good_row(spark, tmp_path):
    path = write(tmp_path, "r.csv", "source_id,row_index,proxy_nan0_good,proxy_nan0_flux_aperture_radius,aperture_pixel_count\n1,1,True,2.0,5\n1,2,True,3.0,6\n1,3,False,9,9\n2,4,True,0,1\n-3,5,1,4.0,\n")
    rows = {r.source_id: (r.radius, r.pixel_count) for r in K.scan_refit_csv(spark, path).collect()}
    assert rows == {1: (3.0, 6.0), -3: (4.0, None)}


def test_weights_csv(spark, tmp_path):
    path = write(tmp_path, "w.csv", "product_collection,group_num,weight,has_valid_hsctile_weight\n Half ,1,2.5,true\nhalf,1,x,false\nnoisy,2,1,1\n")
    assert [(r.grp, r.weight) for r in K.scan_weights(spark, path, "HALF", True).collect()] == [(1, 2.5)]


def test_group_meta_json(spark, tmp_path):
    path = write(tmp_path, "m.json", '{"group_index": 3, "selected_weights": [1.0, 3.0, 0.0]}')
    r = K.scan_group_meta_json(spark, path).first()
    assert (r.group_index, r.total, r.n, r.low, r.high) == (3, 4.0, 2, 1.0, 3.0)


def test_tracks_and_nuclei(spark, tmp_path):
    path = write(tmp_path, "t.tsv", "t\tz\ty\tx\tcell_id\tparent_id\ttrack_id\tradius\tname\tdiv_state\n0\t1\t2\t3\t4\t-1\t6\t2.5\ta\t0\n")
    r = K.scan_tracks_tsv(spark, path, "s").first()
    assert (r.t, r.x, r.y, r.z, r.diameter, r.parent_id) == (0, 3.0, 2.0, 1.0, 5.0, -1)
    write(tmp_path, "t012-nuclei", "7, 1, 0, 0, 0, 10, 20, 3.5, 8, name, 99\nshort, 1\n")
    r = K.scan_nuclei_rows(spark, str(tmp_path / "t012-nuclei")).collect()
    assert [(x.frame, x.cell, x.x, x.y, x.z, x.radius) for x in r] == [(11, 7, 10.0, 20.0, 3.5, 4.0)]


def test_discover_samples(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a", "m.json", '{"source": "s", "bands": ["i"], "patch": "4,5", "num_samples": 9, "finished": true}')
    write(tmp_path / "a", "n.json", '{"source": "s", "bands": ["i", "z"], "patch": "4,5", "finished": true}')
    write(tmp_path / "a", "o.json", '{"source": "s", "bands": ["i"], "patch": "1,1", "finished": false}')
    assert [(r.patch, r.num_samples) for r in K.discover_samples(spark, str(tmp_path), ["s"], ["i"]).collect()] == [("4,5", 9)]


def test_sinks_and_worklist(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 1.0, 0.0, "clean", "t", "p", "i"), (2, 5.0, 5.0, 900.0, 900.0, 0.0, "ignore", "t", "p", "i"), (3, float("nan"), 1.0, 1.0, 1.0, 0.0, "clean", "t", "p", "i")], "source_id long, x double, y double, a double, b double, theta double, source_class string, tract string, patch string, band string")
    K.sink_classed_catalog(df, str(tmp_path / "c"))
    assert {r.source_class for r in K.scan_catalog(spark, str(tmp_path / "c")).filter("band = 'i'").collect()} == {"clean", "ignore"}
    K.sink_quality_csv(df, str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).filter("x is null").count() == 1
    K.sink_region_text(df, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["image;ellipse(1.000,2.000,2.000,1.000,0.000) # color=green", "image;point(6.000,6.000) # point=x color=yellow"]
    done = spark.createDataFrame([(1, None), (2, "boom")], "source_id long, error string")
    K.sink_failures(done, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1
    assert sorted(r.source_id for r in K.incremental_worklist(df, done, ["source_id"]).collect()) == [2, 3]
    assert [r.source_id for r in K.incremental_worklist(df, done, ["source_id"], True).collect()] == [2]
