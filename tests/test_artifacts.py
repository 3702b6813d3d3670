import json

import numpy as np
import pytest

from tessella.extend import Registry, provide_candidates
from tessella.operators import compose, kernels
from tessella.sources import artifacts, config, images, tables
from tessella.streaming import audit


def png(path, a):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_png(np.asarray(a)))


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((7, 5), (4, 9, 3), (1, 1)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(images.decode(images.encode_png(a)), a)
    assert images.decode(b"P5\n# c\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    with pytest.raises(ValueError):
        images.decode(b"GIF89a")


def test_compose_checks_before_it_writes(spark, tmp_path):
    for n, v in (("a", 25), ("b", 50)):
        png(tmp_path / "fine" / f"sample_{n}.png", np.full((4, 4), v))
        png(tmp_path / "soft" / f"sample_{n}.png", np.full((4, 4), v * 5))
    cohort = spark.createDataFrame([("TR-A", "sample_a"), ("TR-B", "sample_b")], "dataset string, image_name string")
    fine = cohort.where("dataset = 'TR-A'").select("image_name")
    sources = [("fine", str(tmp_path / "fine"), fine), ("soft", str(tmp_path / "soft"), None)]
    out = compose.compose(spark, cohort, sources, tmp_path / "out", "one")
    value = lambda n: int(images.decode((out / "labels" / f"sample_{n}.png").read_bytes())[0, 0])
    assert (value("a"), value("b")) == (25, 250)
    state = json.loads((out / "manifest.json").read_text())
    assert state["status"] == "complete" and state["source_counts"] == {"fine": 1, "soft": 1}
    with pytest.raises(FileExistsError):
        compose.compose(spark, cohort, sources, tmp_path / "out", "one")
    with pytest.raises(ValueError, match="sample_b"):
        compose.compose(spark, cohort, sources[:1], tmp_path / "out", "two")
    assert not (tmp_path / "out" / "two").exists()


def test_evaluate_with_fallback(spark, tmp_path):
    square = lambda y: np.pad(np.full((16, 16), 255, np.uint8), ((y, 16 - y), (y, 16 - y)))
    for n in ("sample", "other"):
        png(tmp_path / "d" / "gt" / f"{n}.png", square(8))
        png(tmp_path / "base" / f"{n}.png", square(5))
    png(tmp_path / "refined" / "sample.png", square(8))
    folders = {"base": str(tmp_path / "base"), "refined": str(tmp_path / "refined")}
    facts = compose.evaluate(spark, str(tmp_path / "d" / "gt"), folders, {"refined": str(tmp_path / "base")}, bands=(5,))
    facts = facts.cache()
    assert facts.count() == 4 and facts.where("fallback").count() == 1
    only = spark.createDataFrame([("sample",)], "image_name string")
    one = compose.summarise(compose.evaluate(spark, str(tmp_path / "d" / "gt"), folders, None, only, ()), ["iou", "bf"], "base")
    d = one["comparison"].where("dataset = 'ALL'").first()
    assert d.n == 1 and d.d_iou > 0 and d.d_bf > 0 and d.failure_rate == 0
    with pytest.raises(ValueError):
        compose.evaluate(spark, str(tmp_path / "d" / "gt"), folders).count()


def test_images_are_found_by_alias_and_must_be_unique(spark, tmp_path):
    png(tmp_path / "A" / "im" / "x.png", np.zeros((2, 2)))
    png(tmp_path / "B" / "images" / "y.png", np.zeros((2, 3)))
    found = images.discover(spark, str(tmp_path), ["A", "B"])
    assert [(r.position, r.dataset, r.image_name) for r in found.orderBy("position").collect()] == [(0, "A", "x"), (1, "B", "y")]
    png(tmp_path / "B" / "images" / "x.png", np.zeros((2, 3)))
    with pytest.raises(ValueError):
        images.discover(spark, str(tmp_path), ["A", "B"])
    with pytest.raises(FileNotFoundError):
        images.image_folder(spark, str(tmp_path / "nothing"))
    shapes = images.with_rasters(images.list_images(spark, str(tmp_path), recursive=True), ["path"])
    assert {(r.h, r.w) for r in shapes.collect()} == {(2, 2), (2, 3)}
    written = images.write_png(shapes.selectExpr("concat('n', monotonically_increasing_id()) AS image_name", "h", "w", "data"), str(tmp_path / "again"))
    assert written.count() == 3 and len(list((tmp_path / "again").glob("*.png"))) == 3


def test_tables(spark, tmp_path):
    sample = {"index": 0, "dataset": "A", "image_name": "x"}
    (tmp_path / "c.json").write_text(json.dumps({"cohort_size": 1, "generated_without_gt": True, "samples": [sample]}))
    assert tables.read_cohort(spark, str(tmp_path / "c.json")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps({"cohort_size": 1, "generated_without_gt": True, "samples": [sample | {"image_name": "../x"}]}))
    with pytest.raises(ValueError):
        tables.read_cohort(spark, str(tmp_path / "bad.json"))
    (tmp_path / "r.csv").write_text("﻿a,b\n1,x\n", encoding="utf-8")
    assert tables.read_exact_csv(spark, str(tmp_path / "r.csv"), "a long, b string").first() == (1, "x")
    with pytest.raises(ValueError):
        tables.read_exact_csv(spark, str(tmp_path / "r.csv"), "b long, a string")
    (tmp_path / "i.json").write_text(json.dumps({"0": "d0", "1": "d1"}))
    assert tables.read_dense_index(spark, str(tmp_path / "i.json"), 2).count() == 2
    (tmp_path / "j.json").write_text(json.dumps({"0": "d0", "2": "d1"}))
    with pytest.raises(ValueError):
        tables.read_dense_index(spark, str(tmp_path / "j.json"))
    rows = spark.createDataFrame([("e", "train", d, i) for i, d in enumerate("ABC")], "extractor string, mode string, dataset string, v int")
    tables.write_label_cache(rows, str(tmp_path / "cache"))
    assert {r.v for r in tables.label_cache(spark, str(tmp_path / "cache"), "e", "train", "A+C").collect()} == {0, 2}
    assert tables.named_paths(["a=/x=y"]) == {"a": "/x=y"}
    with pytest.raises(ValueError):
        tables.named_paths(["a=/x", "a=/y"])


def test_artifact_protocol(tmp_path):
    out = artifacts.create(tmp_path, "exp-1")
    with pytest.raises(FileExistsError):
        artifacts.create(tmp_path, "exp-1")
    with pytest.raises(ValueError):
        artifacts.create(tmp_path, "../x")
    with pytest.raises(RuntimeError), artifacts.manifest(out):
        raise RuntimeError("broken")
    assert json.loads((out / "manifest.json").read_text())["status"] == "failed"
    with pytest.raises(RuntimeError):
        artifacts.run_once(out, lambda: None)
    done = artifacts.create(tmp_path, "exp-2")
    with artifacts.manifest(done):
        pass
    assert artifacts.run_once(done, lambda: 1 / 0) is False
    with pytest.raises(ValueError):
        artifacts.run_once(tmp_path / "new", lambda: None, {"labels": (1, 2)})
    (tmp_path / "f").write_bytes(b"abc")
    assert artifacts.file_record(tmp_path / "f")["sha256"].startswith("ba7816bf")
    artifacts.copy_verified(tmp_path / "f", tmp_path / "g")
    with pytest.raises(FileExistsError):
        artifacts.copy_verified(tmp_path / "f", tmp_path / "g")
    assert artifacts.git_state(tmp_path)["head"] is None


def test_config(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"b": 1, "c": [1]}, "d": "x"}))
    (tmp_path / "own.json").write_text(json.dumps({"_BASE_": "base.json", "a": {"b": 2}}))
    tree = config.load(tmp_path / "own.json")
    assert tree == {"a": {"b": 2, "c": [1]}, "d": "x"}
    assert config.override(tree, ["a.c", (3, 4), "d", None])["a"]["c"] == [3, 4]
    for bad, error in ((["a.b"], ValueError), (["a.z", 1], KeyError), (["a.b", "text"], ValueError)):
        with pytest.raises(error):
            config.override(tree, bad)
    (tmp_path / "c.py").write_text("x = 1")
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.py")


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    assert r.get("a") == 1 and "a" in r
    with pytest.raises(KeyError):
        r.register("a")(2)
    with pytest.raises(KeyError):
        r.get("b")


def fake_predictor():
    class Fake:  # local, so that workers get it by value
        encoded = 0

        def encode(self, image):
            self.shape = image.shape[:2]
            self.encoded += 1

        def predict(self, points, labels, box):
            return [(np.full(self.shape, self.encoded == 1), s) for s in (0.8, 0.7, 0.6)]

    return Fake


def test_candidates_by_a_provider(spark):
    prompt = lambda n, box: (n, [[1, 1]], [], box)
    schema = "image_name string, h int, w int, data binary, prompts array<struct<name: string, positive_points: array<array<long>>, negative_points: array<array<long>>, box_xyxy: array<long>>>"
    rows = spark.createDataFrame([("x", 10, 12, bytes(360), [prompt("p", None), prompt("q", [1, 1, 5, 5])]), ("y", 10, 12, bytes(360), [])], schema)
    got = provide_candidates(rows, fake_predictor()).collect()
    assert [(r.prompt_name, r.mask_index, r.score) for r in got] == [(p, i, s) for p in "pq" for i, s in enumerate((0.8, 0.7, 0.6))]
    assert all(kernels.unpack_mask(r.mask, 10, 12).all() for r in got)  # one encoding
    bad = spark.createDataFrame([("x", 10, 12, bytes(360), [prompt("p", [0, 0, 12, 5])])], schema)
    with pytest.raises(Exception, match="not inside"):
        provide_candidates(bad, fake_predictor()).count()


def test_audit_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"route": "high", "fallback_reason": null}\n\n{"route": "low", "fallback_reason": "x"}\n')
    stream = audit.audit_stream(spark, str(tmp_path / "in"), "route string, fallback_reason string")
    q = audit.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = audit.counts(spark.read.parquet(str(tmp_path / "out")), ["route"]).collect()
    assert {(r.route, r.n, r.fallbacks) for r in got} == {("high", 1, 0), ("low", 1, 1)}


def test_maps_by_a_dense_index(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    for i, a in enumerate((np.full((1, 2, 3), 2.0), np.zeros((2, 3)))):
        np.save(tmp_path / "maps" / f"data_{i}.npy", a)
    (tmp_path / "i.json").write_text(json.dumps({"0": "data_0.npy", "1": "data_1.npy"}))
    got = tables.read_maps(spark, str(tmp_path / "i.json"), str(tmp_path / "maps")).orderBy("position").collect()
    assert [r.shape for r in got] == [[2, 3]] * 2 and got[0].data == [1.0] * 6
    with pytest.raises(Exception, match="axes"):
        tables.read_maps(spark, str(tmp_path / "i.json"), str(tmp_path / "maps"), 3).count()
    (tmp_path / "j.json").write_text(json.dumps({"0": "data_0.npy", "1": "gone.npy"}))
    with pytest.raises(ValueError):
        tables.read_maps(spark, str(tmp_path / "j.json"), str(tmp_path / "maps"))
