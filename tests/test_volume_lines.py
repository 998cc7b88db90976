"""Volumes with geometry: files, the data source and its commits, the store, and the stages on ingested files."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import stages
from voxloom.__main__ import main
from voxloom.sources import config, volume_lines, volume_store

AFFINE = np.array([[0, -1.0, 0, 5], [2.0, 0, 0, 6], [0, 0, 3.0, 7], [0, 0, 0, 1]])


def _arrays(lines) -> dict[str, np.ndarray]:
    out = {}
    for r in lines.collect():
        v = out.setdefault(f"{r.patient_id}-{r.pulse}", np.full(r.shape, np.nan, np.float32))
        v[(r.z, r.y, slice(None), r.t) if v.ndim == 4 else (r.z, r.y)] = r["values"]
    return out


def _store_rows(spark, arrays: dict[tuple, np.ndarray], affine=AFFINE, attributes=None):
    rows = []
    for (patient, kind, model, spacing, pulse), v in arrays.items():
        for t in range(v.shape[3] if v.ndim == 4 else 1):
            for z in range(v.shape[0]):
                for y in range(v.shape[1]):
                    rows.append((patient, t, z, y, (v[z, y, :, t] if v.ndim == 4 else v[z, y]).tolist(), list(v.shape), affine.ravel().tolist(), attributes, kind, model, spacing, pulse))
    return spark.createDataFrame(rows, volume_lines.STORE_SCHEMA)


def test_files_to_store_to_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    vols = {"BX-GLI-00033-100": rng.normal(size=(5, 4, 6)).astype(np.float32), "P2": rng.normal(size=(3, 4, 5, 4)).astype(np.float32)}
    for p, v in vols.items():
        (tmp_path / "in" / "deep" / f"{p}-t1c.nii.gz").write_bytes(volume_store.write_nifti(v, AFFINE, attributes={"models": '["a", "b"]', "patch": "32"}))
    (tmp_path / "in" / "P3-t1c.nii").write_bytes(b"short")
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    wanted = spark.createDataFrame([("P2", "t1c"), ("P9", "t1c")], "patient_id string, pulse string")
    got = {r.patient_id: r.state.split(":")[0] for r in volume_lines.ingest(spark, str(tmp_path / "in"), store, "hr", wanted=wanted).collect()}
    assert got.pop("P3") not in ("stored", "skipped", "missing") and got == {"BX-GLI-00033-100": "stored", "P2": "stored", "P9": "missing"}
    facts = {r.patient_id: r for r in volume_lines.volumes(volume_lines.read(spark, store)).collect()}
    assert facts["P2"].shape == [3, 4, 5, 4] and np.allclose(np.reshape(facts["P2"].affine, (4, 4)), AFFINE) and facts["P2"].attributes == {"models": '["a", "b"]', "patch": "32"}
    for key, v in _arrays(volume_lines.read(spark, store)).items():
        assert np.array_equal(v, vols[key.removesuffix("-t1c")])
    volume_lines.write_files(volume_lines.read(spark, store), out)
    for p, v in vols.items():
        found = volume_store.open_nifti(next((tmp_path / "out").rglob(f"{p}-t1c.nii.gz")).read_bytes())
        assert np.array_equal(found.raw, v) and np.allclose(found.affine, AFFINE) and found.attributes["patch"] == "32"
    assert not list((tmp_path / "out").glob(".staging*"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    rows = _store_rows(spark, {("P1", "hr", None, "3mm", "t1"): v, ("P2", "hr", None, "3mm", "t1"): v})
    holed = rows.where("NOT (patient_id = 'P2' AND z = 1 AND y = 2)")
    with pytest.raises(Exception, match="5 of 6 lines"):
        volume_lines.write_files(holed, str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.gz"))
    with pytest.raises(Exception, match="repeats line"):
        volume_lines.write_files(rows.union(rows.where("z = 0 AND y = 0")), str(tmp_path / "out"))
    volume_lines.write_files(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.gz"))) == 2
    more = rows.withColumn("values", F.transform("values", lambda x: x + 1))
    volume_lines.write_files(more, str(tmp_path / "out"))
    one = next((tmp_path / "out").rglob("P1-t1.nii.gz"))
    assert volume_store.read_nifti(one.read_bytes())[0][0, 0, 0] == 0
    volume_lines.write_files(more, str(tmp_path / "out"), overwrite=True)
    assert volume_store.read_nifti(one.read_bytes())[0][0, 0, 0] == 1
    volume_lines.write_files(rows.limit(0), str(tmp_path / "none"))


def test_conditions_choose_files(spark, tmp_path):
    for p in ("P1", "P2"):
        for pulse in ("t1", "t2"):
            np.save(tmp_path / f"{p}-{pulse}.npy", np.ones((2, 2, 3)))
    (tmp_path / "P5-t1.npy").write_bytes(b"never opened")
    some = volume_lines.read_files(spark, str(tmp_path)).where("patient_id = 'P1' AND pulse IN ('t1', 't2') AND z = 1")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 4 and some.where("error IS NOT NULL").count() == 0
    heads = volume_lines.read_files(spark, str(tmp_path), headers=True)
    assert heads.count() == 5 and heads.where("values IS NOT NULL").count() == 0
    (tmp_path / "empty").mkdir()
    assert volume_lines.read_files(spark, str(tmp_path / "empty")).count() == 0
    np.savez(tmp_path / "P6-t1.npz", arr=np.zeros((2, 2, 2, 2, 2)))
    np.save(tmp_path / "P7-t1.npy", np.zeros((0, 2, 2)))
    bad = volume_lines.read_files(spark, str(tmp_path)).where("error IS NOT NULL")
    assert {r.patient_id for r in bad.collect()} == {"P5", "P6", "P7"}


def test_quaternion_and_bare_headers():
    v = np.zeros((3, 4, 5), np.float32)
    data = bytearray(volume_store.write_nifti(v, np.eye(4), compress=False))
    struct.pack_into("<4f", data, 76, -1, 2, 3, 4)
    struct.pack_into("<2h", data, 252, 1, 0)
    half = 0.5**0.5  # a quarter turn about the third axis
    struct.pack_into("<6f", data, 256, 0, 0, half, 7, 8, 9)
    assert np.allclose(volume_store.open_nifti(bytes(data)).affine, [[0, -3, 0, 7], [2, 0, 0, 8], [0, 0, -4, 9], [0, 0, 0, 1]], atol=1e-6)
    struct.pack_into("<2h", data, 252, 0, 0)
    assert np.allclose(volume_store.open_nifti(bytes(data)).affine, [[-2, 0, 0, 2], [0, 3, 0, -4.5], [0, 0, 4, -8], [0, 0, 0, 1]])
    big = volume_store.open_nifti(volume_store.write_nifti(v + 1, np.eye(4), attributes={"a": "x" * 1000}))
    assert big.attributes == {"a": "x" * 1000} and (big.raw == 1).all()


def test_put_replaces_whole_volumes(spark, tmp_path):
    store = str(tmp_path / "store")
    a, b = np.ones((4, 4, 4), np.float32), np.full((2, 3, 8), 2, np.float32)
    volume_lines.put(_store_rows(spark, {("P1", "hr", None, "3mm", "t1"): a, ("P2", "hr", None, "3mm", "t1"): a, ("P1", "expert", "e1", "3mm", "t1"): a}), store)
    volume_lines.put(_store_rows(spark, {("P1", "hr", None, "3mm", "t1"): b}), store)
    shapes = {(r.patient_id, r.kind): tuple(r.shape) for r in volume_lines.volumes(volume_lines.read(spark, store)).collect()}
    assert shapes == {("P1", "hr"): (2, 3, 8), ("P2", "hr"): (4, 4, 4), ("P1", "expert"): (4, 4, 4)}
    assert volume_lines.read(spark, store, kind="hr").count() == 6 + 16
    assert volume_lines.read(spark, str(tmp_path / "no store")).count() == 0


def test_stages_on_ingested_files(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    truth = {f"P{i}": rng.random((8, 8, 16)).astype(np.float32) for i in range(6)}
    for name, change in {"hr": lambda v: v, "a": lambda v: v * 0.8, "b": lambda v: v + 0.2 * rng.random(v.shape).astype(np.float32)}.items():
        (tmp_path / name).mkdir()
        for p, v in truth.items():
            if (p, name) != ("P5", "b"):  # P5 lacks an expert and is left out
                (tmp_path / name / f"{p}-t1.nii.gz").write_bytes(volume_store.write_nifti(change(v).astype(np.float32), AFFINE))
    store = str(tmp_path / "store")
    for name in ("hr", "a", "b"):
        volume_lines.ingest(spark, str(tmp_path / name), store, "hr" if name == "hr" else "expert", None if name == "hr" else name).count()
    rows = volume_lines.bound(volume_lines.read(spark, store), ["a", "b"], spacing="3mm", pulse="t1")
    assert {r.patient for r in rows.select("patient").distinct().collect()} == {f"P{i}" for i in range(5)} and rows.count() == 5 * 64
    c = {"store": store, "folds": 2, "spacings": ["3mm"], "pulses": ["t1"], "fit": {"experts": ["a", "b"], "patch": [4, 4, 8], "stride": [4, 4, 8]}}
    with pytest.raises(ValueError):
        config.from_dict(c | {"pulses": ["t1", "t2"]})
    folder = str(tmp_path / "run")
    stages.run(spark, config.from_dict(c), folder)
    got = {r.patient: r.psnr for r in spark.read.parquet(f"{folder}/evaluate").collect()}
    assert set(got) == {f"P{i}" for i in range(5)}
    for p, v in got.items():
        assert v > 10 * np.log10(np.ptp(truth[p]) ** 2 / np.mean((truth[p] * 0.2) ** 2))  # better than the first expert
    assert {r.model for r in spark.read.parquet(f"{folder}/analyse").collect()} == {"b", "blend"}
    (tmp_path / "c.json").write_text(json.dumps(c))
    for fold in (1, 2):
        assert main(["predict", "--config", str(tmp_path / "c.json"), "--folder", folder, "--fold", str(fold)]) == 0
    made = volume_lines.read(spark, store, kind="blend")
    assert {r.patient_id for r in volume_lines.volumes(made).collect()} == set(got)
    for key, v in _arrays(made).items():
        t = truth[key.removesuffix("-t1")]
        assert abs(10 * np.log10(np.ptp(t) ** 2 / np.mean((t - v) ** 2)) - got[key.removesuffix("-t1")]) < 1e-2
    assert all(np.allclose(np.reshape(r.affine, (4, 4)), AFFINE) for r in volume_lines.volumes(made).collect())
