import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import masks, models, stages
from loomframe.sources import files, web


def test_coco(spark, tmp_path):
    doc = {
        "licenses": [{"id": 0, "name": "CC BY"}, {"id": 3, "name": "NC"}],
        "categories": [{"id": 1, "name": "coat"}, {"id": 2, "name": "bag"}],
        "images": [{"id": 10, "file_name": "a", "license": 0}, {"id": 11, "file_name": "b", "license": 3}, {"id": 12, "file_name": "c", "license": 0}],
        "annotations": [{"id": 1, "image_id": 10, "category_id": 1}, {"id": 2, "image_id": 11, "category_id": 1}, {"id": 3, "image_id": 10, "category_id": 2}],
    }
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    schema = "licenses array<struct<id:int,name:string>>, categories array<struct<id:int,name:string>>, images array<struct<id:int,file_name:string,license:int>>, annotations array<struct<id:int,image_id:int,category_id:int>>"
    tables = files.coco(spark, f"{tmp_path}/x.json", schema)
    kept = files.filter_coco(tables, [0], [1])
    assert (kept["images"].count(), kept["annotations"].count()) == (2, 1)
    assert [r["file_name"] for r in files.filter_coco(tables, [0], [1], drop_empty=True)["images"].collect()] == ["a"]


def test_text_csv_last_wins_and_states(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿file,pass\na,1\nb,0\na,0\n", encoding="utf-8")
    assert {r["file"]: r["pass"] for r in files.text_csv(spark, f"{tmp_path}/l.csv", ["file"]).collect()} == {"a": "0", "b": "0"}
    for name, body in (("x", '{"n": 1, "extra": 2}'), ("y", '{"n": ')):
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "state.json").write_text(body)
    from pyspark.sql import types as T

    assert [r["n"] for r in files.states(spark, f"{tmp_path}/s", T.StructType([T.StructField("n", T.IntegerType())])).collect()] == [1]


def test_zip_and_images(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.png", b"1")
        z.writestr("two.png", b"2")
    (tmp_path / "p.JPG").write_bytes(b"\xff\xd8rest")
    found = files.images(spark, str(tmp_path)).select(files.is_jpeg(F.col("content")).alias("j")).collect()
    assert [r["j"] for r in found] == [True]
    archives = spark.read.format("binaryFile").load(f"{tmp_path}/a.zip")
    got = files.zip_members(archives, spark.createDataFrame([("one.png",)], "name string")).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("one.png", b"1")]


def test_rewrite_with_backup(spark, tmp_path):
    at = f"{tmp_path}/log"
    spark.createDataFrame([(1, True), (2, False)], "k int, ok boolean").write.json(at)
    assert files.rewrite_with_backup(spark, at, spark.createDataFrame([(1, True), (2, True)], "k int, ok boolean"), "ok") == {"before": 1, "after": 2}
    assert spark.read.json(f"{at}_v0").count() == 2


def pages(request):
    all_rows = [{"id": f"{request['seed']}{i}"} for i in range(7)]
    start = {"offset": request.get("offset", 0), "page": (request.get("page", 1) - 1) * 3}.get(request["how"], int(request.get("token", request.get("cursor", 0)) if str(request.get("token", request.get("cursor", 0))).isdigit() else 0))
    part = all_rows[start : start + 3]
    return {"rows": part, "total": 7, "page_count": 3, "next": start + 3 if start + 3 < 7 else None}


@pytest.mark.parametrize("kind", ["token", "offset", "page", "cursor"])
def test_paged_source(kind):
    rows = [r["id"] for p in web.Paging(kind, 3, extra={"how": kind}).pages(pages, {"seed": "s"}) for r in p]
    assert rows == [f"s{i}" for i in range(7)]


def test_paged_reader_and_walk(spark):
    def transport(request):
        start = request.get("offset", 0)
        return {"rows": [{"id": f"{request['seed']}{i}"} for i in range(start, min(start + 2, 5))], "total": 5}

    got = web.read_paged(spark, transport, ["a", "b"], web.Paging("offset", 2), limit=4).collect()
    assert sorted((r["seed"], r["pos"]) for r in got) == [(s, i) for s in "ab" for i in range(4)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    walked = web.walk_categories(edges, spark.createDataFrame([("a",)], "category string"), 2)
    assert {r["category"]: r["level"] for r in walked.collect()} == {"a": 0, "b": 1, "c": 2}


def test_retries():
    waits, calls = [], []

    def flaky(request):
        calls.append(1)
        if len(calls) < 3:
            raise web.Retry
        return {"ok": 1}

    assert web.with_retries(flaky, {}, sleep=waits.append) == {"ok": 1} and waits == [1.0, 2.0]
    assert web.with_retries(lambda q: (_ for _ in ()).throw(web.Retry()), {}, tries=2, sleep=lambda s: None) is None


def test_masks(spark):
    rng = np.random.default_rng(0)
    m = rng.random((37, 23)) < 0.4
    assert (masks.decode(masks.encode(m), 37, 23) == m).all()
    full, none = np.ones((4, 4), bool), np.zeros((4, 4), bool)
    assert masks.iou(none, none) == 0.0 and masks.iou(none, none, empty=1.0) == 1.0 and masks.iou(full, full) == 1.0
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert masks.fill_holes(ring).sum() == 25 and masks.bounding_box(ring) == (2, 2, 7, 7) and masks.bounding_box(none) is None
    assert masks.erode(masks.dilate(ring & ~ring | masks.fill_holes(ring), 1), 1).sum() == 25
    two = np.zeros((8, 20), bool)
    two[1:4, 1:5] = two[5:7, 10:18] = True
    two[4, 5] = True  # touches the first by a corner
    ids, n = masks.label(two)
    assert n == 2 and (ids > 0).sum() == two.sum()
    assert masks.boundary_f1(ring, ring) == 1.0
    assert masks.merge([full, full[:, :4], none | np.eye(4, dtype=bool)]) == [[0, 1, 2]]
    df = spark.createDataFrame([(masks.encode(m), masks.encode(~m), 37, 23)], "a array<int>, b array<int>, h int, w int")
    row = masks.pairwise(df, "a", "b", "h", "w", "iou", masks.iou).select("iou", masks.area(F.col("a")).alias("n")).first()
    assert row["iou"] == 0.0 and row["n"] == m.sum()


def test_models_and_stages(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    assert models.predict(df, "scene", "none", "id int, t string, case string, error string").count() == 2
    with pytest.raises(KeyError):
        models.build("scene", "unknown")
    done = spark.createDataFrame([(1, "cut")], "id int, stage string")
    store = {}

    def save(name, rows):
        store[name] = sorted(r["id"] for r in rows.collect())
        return df

    stages.run_stages(df, done, [stages.Stage("cut", lambda d: d), stages.Stage("export", lambda d: d)], save, key="id")
    assert store == {"cut": [2], "export": [1, 2]}


def test_folders_lists_and_labels(spark, tmp_path):
    with pytest.raises(Exception):
        files.images(spark, f"{tmp_path}/none").count()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "note.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.images(spark, f"{tmp_path}/empty")
    (tmp_path / "ids.txt").write_text("3 14\n\n15\t9\n")
    assert sorted(r["id"] for r in files.id_list(spark, f"{tmp_path}/ids.txt").collect()) == [3, 9, 14, 15]
    at = tmp_path / "bank" / "station2" / "day1"
    at.mkdir(parents=True)
    (at / "labels_i7.json").write_text('{"type": "Top", "size": "M"}')
    (at / "other.json").write_text('{"type": "no"}')
    (row,) = files.labels(spark, f"{tmp_path}/bank", "type string, size string").collect()
    assert (row["item"], row["station"], row["type"]) == ("i7", "station2", "Top") and row["front"].endswith("day1/front_i7.jpg") and row["back"].endswith("day1/back_i7.jpg")
    assert files.labels_json(spark, f"{tmp_path}/absent.json", "struct<a:int>").collect() == []


def test_splits_and_annotations_by_file_and_id(spark, tmp_path):
    doc = lambda f: {"categories": [{"id": 1, "name": "coat"}, {"id": 2, "name": "shoe"}], "images": [{"id": 1, "file_name": f, "license": 0}], "annotations": [{"id": 5, "image_id": 1, "category_id": 1}, {"id": 6, "image_id": 1, "category_id": 2}]}
    for split in ("train", "val"):
        (tmp_path / f"{split}.json").write_text(json.dumps(doc(f"{split}.jpg")))
    schema = "categories array<struct<id:int,name:string>>, images array<struct<id:int,file_name:string,license:int>>, annotations array<struct<id:int,image_id:int,category_id:int>>"
    tables = files.coco_splits(spark, {s: f"{tmp_path}/{s}.json" for s in ("train", "val", "test")}, schema)
    store = files.annotation_store(tables)
    assert sorted((r["file"], r["ann_id"], r["category"]) for r in store.collect()) == [("train.jpg", 5, "coat"), ("train.jpg", 6, "shoe"), ("val.jpg", 5, "coat"), ("val.jpg", 6, "shoe")]
    assert files.garments(store, spark.createDataFrame([("val.jpg",)], "file string"), ["coat"]).count() == 1
    out = {(r["section"], r["body"]) for r in files.coco_document(tables, {"coat": "outer"}, "filtered").collect()}
    assert ("info", '{"note": "filtered"}') in out and any(s == "categories" and '"coarse":"outer"' in b for s, b in out)
    urls = spark.createDataFrame([("http://x/a/000.jpg?k=1",), ("http://x/b/7.png",)], "u string")
    assert [r[0] for r in urls.select(files.url_base_name(F.col("u"))).collect()] == ["000.jpg", "7.png"]


def test_csv_filters(spark, tmp_path):
    (tmp_path / "seg.csv").write_text("ImageID,LabelName\na,/m/1\nb,/m/2\nc,/m/9\n")
    got = files.segment_rows(spark, f"{tmp_path}/seg.csv", {"/m/1": ("Coat", "outer"), "/m/2": ("Hat", "other")})
    assert sorted((r["ImageID"], r["label"], r["coarse"]) for r in got.collect()) == [("a", "Coat", "outer"), ("b", "Hat", "other")]
    (tmp_path / "info.csv").write_text("ImageID,Title\na,old\nb,x\na,new\n")
    info = files.info_rows(spark, f"{tmp_path}/info.csv", got.where("label = 'Coat'"))
    assert [(r["ImageID"], r["Title"]) for r in info.collect()] == [("a", "new")]
    (tmp_path / "review.csv").write_text("file,item,verdict\nf,1,1\nf,2,\nf,1,0\n")
    assert [(r["item"], r["verdict"]) for r in files.human_review(spark, f"{tmp_path}/review.csv").collect()] == [("1", "0")]


def test_sinks(spark, tmp_path):
    files.write_report(spark, f"{tmp_path}/r", "Title", {"n": 1}, "body")
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"n": 1} and (tmp_path / "r" / "report.md").read_text() == "# Title\n\nbody\n"
    files.label_template(spark.createDataFrame([("b",), ("a,1",)], "file string"), f"{tmp_path}/t.csv", ["file", "category"])
    assert (tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbffile,category\r\n\"a,1\",\r\nb,\r\n")
    pairs = spark.createDataFrame([("p1", 3.0), ("p2", 9.0)], "id string, palette double")
    assert files.write_pairs(pairs, f"{tmp_path}/pairs", "palette", 6.0) == {"skipped": 1}
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/pairs").collect()] == ["p1"]
    for again in (pairs.limit(1), spark.createDataFrame([("q", 1.0), ("q", 2.0)], "id string, palette double")):
        with pytest.raises(Exception):
            files.write_pairs(again, f"{tmp_path}/pairs", "palette", 6.0)
    items = spark.createDataFrame([("i", "coat", "s.jpg", 10, 20, "a", [1, 2, 3, 4], 0.123456, 0.5, 0.25, True)], "id string, category string, source string, width int, height int, case string, bbox array<int>, score double, area_ratio double, occlusion double, ai_restored boolean")
    meta = json.loads(files.item_metadata(items, {"a": "one garment"}).first()["metadata"])
    assert meta["schema_version"] == 1 and meta["source_size"] == [10, 20] and meta["case_desc"] == "one garment" and meta["score"] == 0.1235 and meta["ai_restored"] is True
    files.write_scores(pairs, pairs.agg(F.count(F.lit(1)).alias("n")), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/summary").first()["n"] == 2


def test_transports(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("SOME_KEY", "k")
    assert web.secret("SOME_KEY") == "k"
    (tmp_path / "key").write_text(" f\n")
    assert web.secret("NO_KEY", f"{tmp_path}/key") == "f"
    with pytest.raises(ValueError):
        web.secret("NO_KEY")
    seen, rested = [], []
    web.polite(lambda q: seen.append(q) or {}, 0.3, {"User-Agent": "a"}, rested.append)({"x": 1})
    assert seen == [{"x": 1, "headers": {"User-Agent": "a"}}] and rested == [0.3]

    def wiki(q):
        if "cmcontinue" not in q:
            return {"status": 200, "json": {"query": {"categorymembers": [{"title": "A"}]}, "continue": {"cmcontinue": "2"}}}
        return {"status": 200, "json": {"query": {"categorymembers": [{"title": "B"}]}}}

    got = web.read_paged(spark, web.wiki_transport(wiki, "files"), ["Category:X"], web.Paging("token")).collect()
    assert [json.loads(r["body"])["title"] for r in sorted(got, key=lambda r: r["pos"])] == ["A", "B"]
    with pytest.raises(web.Retry):
        web.wiki_transport(lambda q: {"status": 200, "json": {"error": {"code": "maxlag"}}}, "search")({"seed": "x"})
    pages = {1: {"status": 200, "json": {"rows": [1], "page_count": 9}}, 2: {"status": 401}}
    asked = web.status_transport(lambda q: pages[q["page"]])
    assert list(web.Paging("page").pages(lambda q: web.with_retries(asked, q), {})) == [[1]]

    def museum(q):
        return {"ids": [1, 2]} if "department" in q else ({"title": f"o{q['object']}"} if q["object"] == "1" else None)

    assert [(r["department"], r["object_id"], r["body"]) for r in web.department_objects(spark, museum, ["11"]).collect()] == [("11", "1", '{"title": "o1"}')]


def test_fetching(spark):
    ticks = iter(range(0, 1000, 20))
    assert web.receive({"chunks": iter([b"a", b"b", b"c"])}, 10, 45, lambda: next(ticks)) == (None, "too_late")
    assert web.receive({"chunks": iter([b"aa", b"bb"])}, 3, 45) == (None, "too_large")
    assert web.receive({"status": 404}, 3, 45) == (None, "http_404") and web.receive(None, 1, 1) == (None, "failed")
    answers = {"u1": {"content": b"1"}, "u2": {"status": 404}, "u3": {"content": b"x" * 100}, "u4": {"content": b"4"}}
    rows = spark.createDataFrame([(u,) for u in answers], "url string")
    got = web.fetch_blobs(rows, "url", lambda q: answers[q["url"]], max_bytes=50, existing=spark.createDataFrame([("u4",)], "url string"))
    assert {r["url"]: r["status"] for r in got.collect()} == {"u1": "ok", "u2": "http_404", "u3": "too_large", "u4": "exists"}
    assert {r["status"]: r["n"] for r in web.status_counts(got).collect()} == {"ok": 1, "http_404": 1, "too_large": 1, "exists": 1}


def test_filtered_annotations_meet_images_dealt_out_by_image(spark, capsys):
    """Partitions are not put together by their compressed size, a filter does not go below it, and an image that is listed twice takes its annotations once."""
    images = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1)], "id int, license int")
    kinds = spark.createDataFrame([(1, "coat"), (2, "hat")], "id int, name string")
    notes = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 3, 1), (13, None, 1)], "id int, image_id int, category_id int")
    kept = files.filter_coco({"images": images, "categories": kinds, "annotations": notes}, [0], [1], drop_empty=True)
    assert kept["annotations"].columns == notes.columns and [tuple(r) for r in kept["annotations"].collect()] == [(10, 1, 1)]
    assert [r["id"] for r in kept["images"].collect()] == [1, 1]
    capsys.readouterr()
    kept["annotations"].explain()
    assert any("REPARTITION_BY_NUM" in line and "image_id#" in line for line in capsys.readouterr().out.splitlines())
