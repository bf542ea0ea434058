"""Readers, the store and the stream."""

import base64
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from scanlake.plans import matrices
from scanlake.sources import readers, store
from scanlake.streaming import ingest


def array(values, accession, bits=64, packed=False):
    raw = struct.pack(f"<{len(values)}{'d' if bits == 64 else 'f'}", *values)
    raw = zlib.compress(raw) if packed else raw
    cv = [accession, "MS:1000523" if bits == 64 else "MS:1000521"] + ["MS:1000574"] * packed
    return "<binaryDataArray>" + "".join(f'<cvParam accession="{a}" name="x"/>' for a in cv) + f"<binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>"


def spectrum(i, params, mz, v, rt=1.0, **kw):
    cv = "".join(f'<cvParam accession="{a}" value="{x}"/>' for a, x in params)
    scan = "" if rt is None else f'<scanList><scan><cvParam accession="MS:1000016" value="{rt}"/></scan></scanList>'
    return f'<spectrum index="{i}" id="scan={i}">{cv}{scan}<binaryDataArrayList count="2">{array(mz, "MS:1000514", **kw)}{array(v, "MS:1000515", **kw)}</binaryDataArrayList></spectrum>'


def write(path, *spectra):
    path.write_text('<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>' + "".join(spectra) + "</spectrumList></run></mzML>")


def test_mzml(spark, tmp_path):
    write(
        tmp_path / "x_MabThera_y_1.mzML",
        spectrum(0, [("MS:1000511", 1), ("MS:1000285", 99), ("MS:1000504", 101.5), ("MS:1000505", 7)], [100.0, 101.5], [5.0, 7.0], 1.5),
        spectrum(1, [("MS:1000511", "")], [100.0, 101.0], [5.0, 6.0], 1.0, bits=32, packed=True),
        spectrum(2, [("MS:1000511", 2)], [100.0], [5.0]),
        spectrum(3, [("MS:1000511", 1)], [100.0], [5.0], None),
    )
    rows = readers.read_mzml(spark, str(tmp_path)).orderBy("scan_ord").collect()
    assert [(r["scan_id"], r["rt"], r["tic"], r["base_peak_mz"], r["base_peak_intensity"], r["mz_array"]) for r in rows] == [
        ("scan=1", 1.0, 11.0, None, 6.0, [100.0, 101.0]), ("scan=0", 1.5, 99.0, 101.5, 7.0, [100.0, 101.5])]
    assert rows[0]["sample_id"] == "MabThera_1"


def test_mzml_errors(spark, tmp_path):
    write(tmp_path / "a.mzML", spectrum(0, [], [1.0, 2.0], [3.0]))
    with pytest.raises(Exception, match="differ in length"):
        readers.read_mzml(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        readers.decode_binary(base64.b64encode(b"abc").decode(), [])


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfscan_id,sample_id,rt,mz,intensity\ns1,A,2.0,500,7\ns1,A,2.0,501,7\ns0,A,1.0,502,1\n")
    rows = readers.read_centroid_csv(spark, str(tmp_path / "a.csv")).orderBy("scan_ord").collect()
    assert [(r["scan_id"], r["tic"], r["base_peak_mz"], r["mz_array"]) for r in rows] == [("s0", 1.0, 502.0, [502.0]), ("s1", 14.0, 500.0, [500.0, 501.0])]
    (tmp_path / "b.csv").write_text("scan_id,rt\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_centroid_csv(spark, str(tmp_path / "b.csv"))


def test_directory(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.load_directory(spark, str(tmp_path))
    (tmp_path / "p_MabThera_Untreated_1.raw").write_text("")
    (tmp_path / "p_Reditux_Untreated_1.raw").write_text("")
    (tmp_path / "note.txt").write_text("")
    raw, scans = readers.load_directory(spark, str(tmp_path), "p1")
    assert {(r["sample_id"], r["scan_count"], r["data_format"]) for r in raw.collect()} == {("MabThera_1", 260, "raw"), ("Reditux_1", 260, "raw")}
    from scanlake.operators.match import candidate_mz
    from scanlake.operators.points import to_points

    pts = to_points(scans)
    assert scans.count() == 520 and scans.where("size(mz_array) <> size(intensity_array)").count() == 0
    near = candidate_mz(pts, ["sample_id"], 4.5, 5.1).where("abs(cluster_mz - 548.3124) < 0.02").collect()
    assert len(near) == 2 and all(r["scan_count"] >= 4 for r in near)


def test_store_and_saved_features(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    s.write("t", a, "k")
    s.write("t", spark.createDataFrame([("y", 5)], "k string, v int"), "k", replace=False)
    assert {(r["k"], r["v"]) for r in s.read("t").collect()} == {("x", 1), ("y", 5)} and s.read("t", k="y").count() == 1
    schema = "ord int, region_id string, feature_id string, feature_json string, created_at string"
    new = spark.createDataFrame([(1, "r1", None, '{"mz": 1.5, "aligned_rt": 2.0, "sample_intensities": {"A": {"raw": 3.0, "normalized": 0.5}}}', None), (2, None, None, "{}", None), (3, None, "f", "not json", None)], schema)
    assert s.replace_features(new, "2020") == 2
    assert s.replace_features(new.where("ord = 1"), "2021") == 1
    s.write("t", a, "k")
    row = s.features().first()
    assert (row["feature_id"], row["created_at"], row["updated_at"]) == ("r1", "2020", "2021")
    m = matrices.feature_matrix(s.features(), ["A", "B"]).first()
    assert (m["A_raw"], m["A_status"], m["B_raw"], m["B_status"]) == (3.0, "present", 0.0, "missing")
    with pytest.raises(Exception, match="repeated feature id"):
        s.replace_features(new.where("ord = 1").unionByName(new.where("ord = 1")), "2022")
    s.write_metadata({"a": "1"})
    assert s.read("metadata").count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456789, {"x": 1.0}), ("b", None, None)], "id string, v double, m map<string,double>")
    store.write_csv(df, str(tmp_path / "c"), {"v": 3})
    text = sorted(line for f in os.listdir(tmp_path / "c") if f.endswith(".csv") for line in (tmp_path / "c" / f).read_text().splitlines())
    assert any("1.235" in x for x in text)
    store.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    scans = spark.createDataFrame([("A", 1.0, 2.0, 2.0), ("A", 0.5, 1.0, 1.0)], "sample_id string, rt double, tic double, bpi double")
    candidates = spark.createDataFrame([("A", 2, 600.0), ("A", 1, 500.0)], "sample_id string, candidate_rank int, cluster_mz double")
    features = spark.createDataFrame([("A", 500.0, 1.0, 9.0)], "sample_id string, mz double, rt double, area double")
    kinds = "feature_group_id string, difference_type string, confidence_score double, representative_rt double, area_by_sample map<string,double>"
    groups = spark.createDataFrame([("g1", "common_feature", 0.9, 1.0, {"A": 1.0}), ("g2", "rt_shift", 0.1, 1.0, None), ("g3", "rt_shift", 0.7, 2.0, None)], kinds)
    xics = spark.createDataFrame([("g1", "A", 1.0, 5.0), ("g1", "A", 0.5, 4.0), ("g1", "B", 0.5, 0.0)], "feature_group_id string, sample_id string, rt double, intensity double")
    out = store.report(scans, candidates, features, groups, xics)
    parsed = {k: [{**r.asDict(), "payload": json.loads(r["payload_json"])} for r in df.collect()] for k, df in out.items()}
    assert parsed["samples"][0]["scan_count"] == 2 and [x["rt"] for x in parsed["samples"][0]["payload"]["tic"]] == [0.5, 1.0]
    assert [x["cluster_mz"] for x in parsed["candidates_by_sample"][0]["payload"]] == [500.0, 600.0] and parsed["features_by_sample"][0]["payload"][0]["area"] == 9.0
    assert [r["feature_group_id"] for r in sorted(parsed["feature_groups"], key=lambda r: r["place"])] == ["g3", "g2", "g1"]
    [g1] = parsed["xics_by_group"]
    assert [(t["sample_id"], [p["intensity"] for p in t["trace"]]) for t in g1["payload"]] == [("A", [4.0, 5.0]), ("B", [0.0])]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.csv").write_text(f"scan_id,sample_id,rt,mz,intensity\ns{i},A,1.0,500,2\ns{i},A,1.0,501,3\n")
    q = ingest.append_points(ingest.stream_points(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = ingest.running_chromatogram(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted((r["scan_id"], r["tic"]) for r in got) == [("s0", 5.0), ("s1", 5.0)]


def test_csv_exports(spark, tmp_path):
    import csv
    import glob

    from scanlake.operators import grid as G
    from scanlake.operators import views as V
    from scanlake.sources import store

    rows = lambda d: [r for f in glob.glob(f"{d}/part-*.csv") for r in csv.DictReader(open(f, encoding="utf-8"))]
    groups = spark.createDataFrame([("FG0001", 200.5, 1.25, 2, 1, None, 2.0, "common_feature", 0.7, {"A": 1.5, "N": 2.0})], "feature_group_id string, representative_mz double, representative_rt double, sample_count int, missing_sample_count int, cv double, max_fold_change double, difference_type string, confidence_score double, area_by_sample map<string,double>")
    store.feature_matrix_csv(groups, f"{tmp_path}/m", ["A", "N", "R"])
    assert rows(f"{tmp_path}/m") == [{"feature_group_id": "FG0001", "representative_mz": "200.500000", "representative_rt": "1.25000", "sample_count": "2", "missing_sample_count": "1", "cv": "", "max_fold_change": "2.000000", "difference_type": "common_feature", "confidence_score": "0.7000", "A": "1.500000", "N": "2.000000", "R": "0.000000"}]
    g = G.Grid(0.0, 10.0, 100.0, 200.0, 10, 10)
    near = spark.createDataFrame([(3, 2, "A", 5.0, 1.0), (3, 2, "N", 0.0, 0.0)], "mz_index int, rt_index int, sample_id string, raw double, norm double")
    scans = spark.createDataFrame([("A", "a1", 2.25), ("A", "a2", 2.75), ("N", "n1", 9.0)], "sample_id string, scan_id string, rt double")
    points = spark.createDataFrame([("A", "a1", 135.2, 7.0), ("A", "a1", 150.0, 9.0)], "sample_id string, scan_id string, mz double, intensity double")
    shifts = spark.createDataFrame([("A", 0.25), ("N", 0.0)], "sample_id string, rt_shift double")
    cells = spark.createDataFrame([(3, 2, 2.5, 135.0, 1, 0.4, 0.6, "new_signal")], "mz_index int, rt_index int, rt double, mz double, region_rank int, score double, weighted_difference_score double, difference_type string")
    t = V.traces(scans, points, shifts, cells, V.mz_tolerance_of(g))
    store.cell_intensities_csv(t, near, f"{tmp_path}/c", V.mz_tolerance_of(g))
    got = {r["sample"]: r for r in rows(f"{tmp_path}/c")}
    assert got["A"]["scan_id"] == "a1" and got["A"]["scan_raw_intensity"] == "7.000000" and got["A"]["raw_relative_pct"] == "100.000000" and got["N"]["status"] == "missing"
    f = V.cell_features(cells, near, t, g, "h")
    store.saved_features_csv(f, f"{tmp_path}/s")
    one = rows(f"{tmp_path}/s")[0]
    assert one["rt_start"] == "2.000000" and one["mz_end"] == "140.000000" and one["sample_presence"] == "A" and "a1" in one["source_scans"]
    assert V.not_saved(f, f).count() == 0 and V.not_saved(f, f.limit(0)).count() == 1
    store.auto_outputs(cells, near, f"{tmp_path}/auto")
    assert len(rows(f"{tmp_path}/auto/auto_feature_matrix_csv")) == 2


def test_payload_is_split_and_put_together(spark, tmp_path):
    import json

    from scanlake.sources.store import Store

    s = Store(spark, str(tmp_path))
    spectra = spark.createDataFrame([("A", "a1", 100.0, 1.0), ("A", "a1", 200.0, 2.0), ("N", "n1", 100.0, 3.0)], "sample_id string, scan_id string, mz double, intensity double")
    maps = spark.createDataFrame([("cohort", 1, 2, 0.5), ("A_vs_N", 1, 2, 0.25)], "comparison string, mz_index int, rt_index int, score double")
    keys = {"spectra": "sample_id", "heatmaps": "comparison"}
    s.write_payload({"spectra": spectra, "heatmaps": maps}, keys)
    got = {r["artifact_key"]: json.loads(r["payload_json"]) for r in s.read_payload(keys).collect()}
    assert set(got) == {"spectra:A", "spectra:N", "heatmaps:cohort", "heatmaps:A_vs_N"}
    assert sorted(x["mz"] for x in got["spectra:A"]) == [100.0, 200.0] and got["heatmaps:A_vs_N"][0]["score"] == 0.25


def test_peak_first_record(spark):
    from scanlake.operators import views as V

    peaks = spark.createDataFrame([(3, 1.0, 2.0, 3.0, 0.75, 0.9)], "peak_id int, rt_start double, rt_apex double, rt_end double, peak_consistency_score double, spectrum_score double")
    areas = spark.createDataFrame([(3, "A", 5.0), (3, "N", 7.0), (4, "A", 1.0)], "peak_id int, sample_id string, area double")
    r = V.peak_feature_record(peaks, areas, 700.0, 0.5).collect()
    assert len(r) == 1 and r[0]["feature_id"] == "PF_00003" and r[0]["difference_score"] == 0.25 and r[0]["raw_area_by_sample"] == {"A": 5.0, "N": 7.0}
