"""Sources, sinks and the stream on files made here."""

import io
import json
import os
import random
import tarfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lumenpair.functions.records import has_caption_and_image
from lumenpair.operators import curation as C
from lumenpair.operators import duplicates as U
from lumenpair.sinks import results as W
from lumenpair.sources import benchmarks as B
from lumenpair.sources.documents import json_entries
from lumenpair.sources.files import count_files, list_files
from lumenpair.sources.records import manifest_samples, read_manifest, read_records, synthetic_pairs
from lumenpair.sources.retrieval_sets import read_coco_captions, read_karpathy
from lumenpair.sources.shards import expand_braces, expand_shards
from lumenpair.sources import tar as tar_source
from lumenpair.sources.tar import read_tar_shards
from lumenpair.streaming.running import refresh_accuracy


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


MANIFESTS = {
    "m.csv": "image,caption\nsample.jpg,a small image\n",
    "m.tsv": "image\tcaption\nsample.jpg\ta small image\n",
    "m.jsonl": '{"image":"sample.jpg","caption":"a small image"}\n\n',
    "m.json": '[{"image":"sample.jpg","caption":"a small image"}]',
    "n.json": '{"data":[{"image":"sample.jpg","caption":"a small image"}]}',
}


@pytest.mark.parametrize("name", sorted(MANIFESTS))
def test_manifest_formats(spark, tmp_path, name):
    path = put(tmp_path / name, MANIFESTS[name])
    got = manifest_samples(read_manifest(spark, path), "image", "caption", str(tmp_path), order=["image"])
    assert rows(got) == [(f"{tmp_path}/sample.jpg", "a small image", "sample.jpg", "0")]
    if name.endswith(("json", "jsonl")):
        assert rows(read_manifest(spark, path, schema="image string, caption string")) == [("sample.jpg", "a small image")]
    with pytest.raises(ValueError):
        read_manifest(spark, path, "xml")


def test_keyed_records(spark, tmp_path):
    schema = "caption string, n int"
    path = put(tmp_path / "a.json", '{"7":{"caption":"x","n":1},"8":"plain","9":{"sample_id":"own","n":2}}')
    got = read_records(spark, path, schema).select("sample_id", "caption", "n", "value", "record_index")
    assert rows(got) == rows(
        spark.createDataFrame([("7", "x", 1, None, 0), ("8", None, None, "plain", 1), ("own", None, 2, None, 2)], got.schema)
    )
    path = put(tmp_path / "b.json", '{"images":[{"caption":"x"},{"caption":["p","q"]}]}')
    assert [r.caption for r in read_records(spark, path, schema, unwrap="images").orderBy("record_index").collect()] == ["x", '["p","q"]']
    path = put(tmp_path / "c.csv", "caption,n\nfirst,1\nsecond,2\n")
    assert [(r.caption, r.n, r.record_index) for r in read_records(spark, path, schema).orderBy("n").collect()] == [("first", 1, 0), ("second", 2, 1)]
    many = "".join(json.dumps({"caption": f"c{i}", "n": i}) + "\n" for i in range(500))
    paths = [put(tmp_path / d / "r.jsonl", many) for d in ("d1", "d2")]
    got = read_records(spark, paths, schema).collect()
    assert len(got) == 1000 and all(r.record_index == r.n for r in got)


def test_shard_patterns(tmp_path):
    assert expand_braces("s-{0008..0011}.tar") == [f"s-{i:04d}.tar" for i in (8, 9, 10, 11)]
    assert expand_braces("{a,b}/{2..0..-1}") == ["a/2", "a/1", "a/0", "b/2", "b/1", "b/0"]
    assert expand_braces("x{3..1..1}") == ["x3", "x2", "x1"]
    assert expand_braces("{a,b{c,d}}-{x..z..2}{8..10}") == [f"{p}-{q}{n}" for p in ("a", "bc", "bd") for q in "xz" for n in (8, 9, 10)]
    assert expand_braces("{07..9}{q}{") == ["07{q}{", "08{q}{", "09{q}{"]
    assert expand_braces("{{1..2},x}{,y}") == ["1", "1y", "2", "2y", "x", "xy"]
    for n in ("b.tar", "a.tar", "c.txt"):
        put(tmp_path / n, "")
    assert expand_shards([f"{tmp_path}/*.tar", f"{tmp_path}/a.tar", "/none/*.tar"]) == ["/none/*.tar", f"{tmp_path}/a.tar", f"{tmp_path}/b.tar"]


def make_tar(path, members):
    with tarfile.open(path, "w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def meta(**fields):
    return json.dumps(fields).encode()


def test_tar_scan_filters_and_survives_damage(spark, tmp_path):
    make_tar(
        tmp_path / "s0.tar",
        [("d/1.jpg", b"img1"), ("d/1.txt", b"one"), ("d/2.jpg", b"img2"), ("d/3.txt", b"three"), ("d/3.PNG", b"img3")],
    )
    make_tar(tmp_path / "s1.tar", [("4.webp", b"x" * 3000), ("4.txt", b"four"), ("5.txt", b"y" * 5000)])
    whole = (tmp_path / "s1.tar").read_bytes()
    (tmp_path / "s1.tar").write_bytes(whole[:6000])
    (tmp_path / "s2.tar").write_bytes(b"not a tar file")
    present = has_caption_and_image(F.col("members"))
    samples, problems = read_tar_shards(spark, f"{tmp_path}/s{{0..3}}.tar", where=present)
    got = {r.key: {k: bytes(v) for k, v in r.members.items()} for r in samples.collect()}
    assert got["d/1"] == {"jpg": b"img1", "txt": b"one"} and got["d/3"] == {"txt": b"three", "png": b"img3"}
    assert set(got) == {"d/1", "d/3", "4"}
    assert {r.shard.rsplit("/", 1)[1] for r in problems.collect()} >= {"s2.tar", "s3.tar"}
    only, _ = read_tar_shards(spark, f"{tmp_path}/s0.tar", members=["txt"], where=present)
    assert {r.key: list(r.members) for r in only.collect()} == {"d/1": ["txt"], "d/3": ["txt"]}
    with pytest.raises(Exception):
        read_tar_shards(spark, f"{tmp_path}/s2.tar", errors="fail")


def test_curation_of_shards(spark, tmp_path):
    text = b"grey ferry leaves the quay"
    make_tar(
        tmp_path / "c.tar",
        [
            ("1.jpg", b"i"), ("1.txt", text),
            ("1.json", meta(captions={"raw": "ferry at the quay", "longSV": text.decode()}, default_caption_key="longSV")),
            ("2.jpg", b"i"), ("2.txt", text), ("2.json", meta(key="000000002", status="failed")),
            ("3.txt", text), ("3.json", meta(captions={"longSV": text.decode()})),
        ],
    )
    samples, _ = read_tar_shards(spark, f"{tmp_path}/c.tar", members=["json", "txt"])
    assert C.relabelled_samples(samples).count() == 0  # image members were left out
    samples, _ = read_tar_shards(spark, f"{tmp_path}/c.tar")
    drawn = C.curate(samples, k=4, max_merged=2).collect()
    assert len(drawn) == 4 and {r.key for r in drawn} == {"1"}
    assert {p for r in drawn for p in r.subcaption.split(".\n")} <= {"ferry at the quay", "grey ferry leaves the quay"}
    plain = C.plain_samples(samples)
    assert sorted(r.key for r in plain.collect()) == ["1", "2"]


def test_listing_digests_and_archives(spark, tmp_path):
    put(tmp_path / "a" / "x.JSON", "same")
    put(tmp_path / "b" / "y.json", "same")
    put(tmp_path / "b" / "z.json", "else")
    put(tmp_path / "b" / "w.zip", "longer file")
    listing = list_files(spark, str(tmp_path))
    assert rows(count_files(listing)) == [(".json", 3, 12), (".zip", 1, 11)]
    assert list_files(spark, str(tmp_path), [".ZIP"]).count() == 1
    assert [r.size_bytes for r in U.largest_archives(listing).collect()] == [11]
    digests = U.file_digests(listing)
    assert digests.where("sha256 is null").count() == 1
    assert [(r.copies, r.reclaimable_bytes) for r in U.duplicate_groups(digests.where("sha256 is not null")).collect()] == [(2, 4)]


KARPATHY = {
    "images": [
        {"filepath": "", "filename": "1.jpg", "split": "test", "sentences": [{"raw": " first "}, {"tokens": ["two", "words"]}, {"raw": " "}]},
        {"filename": "2.jpg", "split": "train", "sentences": [{"raw": "other"}]},
        {"filepath": "test2014", "filename": "3.jpg", "split": "test", "sentences": []},
    ]
}


def test_karpathy(spark, tmp_path):
    path = put(tmp_path / "k.json", json.dumps(KARPATHY))
    images, captions = read_karpathy(spark, path, "/r", split="test")
    assert rows(images) == [(0, "/r/val2014/1.jpg", "first"), (1, "/r/test2014/3.jpg", "")]
    assert rows(captions) == [(0, 0, "first"), (1, 0, "two words")]
    images, captions = read_karpathy(spark, put(tmp_path / "l.json", json.dumps(KARPATHY["images"])), "/r", limit_images=2, folders=False)
    assert [r.image_path for r in images.orderBy("image_idx").collect()] == ["/r/1.jpg", "/r/2.jpg"]


def test_coco_captions_limit_before_dropping(spark, tmp_path):
    payload = {
        "images": [{"id": 3, "file_name": "c.jpg"}, {"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
        "annotations": [
            {"image_id": 2, "caption": " b one "}, {"image_id": 3, "caption": "c"}, {"image_id": 2, "caption": "b two"},
            {"image_id": 1, "caption": "  "}, {"image_id": 9, "caption": "stray"},
        ],
    }
    path = put(tmp_path / "c.json", json.dumps(payload))
    images, captions = read_coco_captions(spark, path, "/r", limit_images=2)
    assert rows(images) == [(0, "/r/b.jpg", "b one")]
    assert rows(captions) == [(0, 0, "b one"), (1, 0, "b two")]


def test_attribution_records(spark, tmp_path):
    path = put(
        tmp_path / "visual_genome_attribution.json",
        json.dumps([
            {"image_id": 5, "image_path": "1.jpg", "true_caption": "the red  dog", "false_caption": "the blue dog",
             "bbox_x": 1, "bbox_y": 2, "bbox_w": 0, "bbox_h": 9, "attributes": ["red", "old"]},
            {"image_id": 6, "image_path": "gone.jpg", "true_caption": "x", "false_caption": "y"},
            {"image_path": "1.jpg", "true_caption": "", "false_caption": "y"},
        ]),
    )
    schema = "image_id string, image_path string, true_caption string, false_caption string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, attributes array<string>"
    listing = spark.createDataFrame([("/vg/1.jpg",)], "path string")
    good, bad = B.load_attribution(read_records(spark, path, schema), "attr", ["/vg"], listing)
    row = good.first()
    assert (row.sample_id, row.image_path, row.positive_caption, row.subcategory, row.image_id) == ("attr_5_0", "/vg/1.jpg", "the red dog", "red_old", "5")
    assert tuple(row.crop_box) == (1, 2, 2, 11) and row.negative_types == ["hard_negative"]
    assert tuple(good.columns) == B.PAIRWISE_FIELDS
    assert rows(bad.select("sample_id", "reason")) == [("6", "image not found: gone.jpg"), ("attr_2", "missing image or caption fields")]


def test_sugarcrepe_files(spark, tmp_path):
    record = {"filename": "1.jpg", "caption": "a dog", "caption2": "one dog", "negative_caption": "a cat"}
    path = put(tmp_path / "swap_att.json", json.dumps({"0": record, "1": {**record, "caption": ""}}))
    rows_in = read_records(spark, path, "filename string, caption string, caption2 string, negative_caption string")
    good, bad = B.load_sugarcrepe(rows_in)
    assert [(r.sample_id, r.category, r.subcategory) for r in good.collect()] == [("swap_att_0", "swap_att", "att")]
    assert bad.count() == 1
    good, bad = B.load_sugarcrepe_pp(rows_in)
    assert rows(good.select("sample_id", "positive_caption")) == [("swap_att_0_caption", "a dog"), ("swap_att_0_caption2", "one dog")]
    assert rows(bad.select("sample_id", "reason")) == [("1", "missing image or caption fields")]
    assert json.loads(good.where("sample_id like '%2'").first().metadata)["positive_variant"] == "caption2"


def test_flat_winoground_drops_odd_row(spark, tmp_path):
    lines = [{"image": f"{i}.png", "true_caption": f"t{i}", "false_caption": f"f{i}"} for i in range(5)]
    path = put(tmp_path / "examples.jsonl", "\n".join(map(json.dumps, lines)))
    records = read_records(spark, path, "image string, true_caption string, false_caption string")
    good, bad = B.load_winoground(records)
    assert rows(good.select("sample_id", "image_0_path", "image_1_path", "caption_0", "caption_1")) == [
        ("0", "0.png", "1.png", "t0", "f0"), ("1", "2.png", "3.png", "t2", "f2"),
    ]
    listing = spark.createDataFrame([("/w/0.png",), ("/w/1.png",), ("/w/2.png",)], "path string")
    good, bad = B.load_winoground(records, ["/w"], listing)
    assert rows(bad.select("sample_id", "reason")) == [("1", "flattened image pair not found")]


def test_file_choice():
    names = ["/a/coco_karpathy_val.json", "/a/coco_karpathy_test.json", "/b/x.json"]
    assert B.prefer_split(names, "coco_karpathy", ["test", "val"]) == names[1]
    assert B.prefer_split(names[:1], "coco_karpathy", ["test"]) == names[0]
    assert B.prefer_split(names, "flickr30k", ["test"]) is None
    assert B.choose_files(["/a/swap_att.json", "/a/other.json"], B.CREPE_PP_FILES) == ["/a/swap_att.json"]
    assert B.choose_files(["/a/other.json"], B.CREPE_FILES) == ["/a/other.json"]


def test_synthetic(spark):
    assert rows(synthetic_pairs(spark, 2)) == [("synthetic sample 0", "0", "0"), ("synthetic sample 1", "1", "1")]


def test_widening_and_ragged(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "i int, x string")
    new = spark.createDataFrame([(2, "b", 0.5)], "i int, x string, y double")
    wide = W.rewrite_rectangular(old, new, str(tmp_path / "w"))
    assert rows(wide) == [(1, "a", None), (2, "b", 0.5)]
    W.write_metric_rows([old, new.drop("x")], str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m" / "retrieval_metrics.csv"))
    assert back.columns == ["i", "x", "y"] and back.count() == 2


def test_empty_quarantine_has_a_header(spark, tmp_path):
    W.write_skipped(None, spark, str(tmp_path / "s"))
    text = "".join(open(tmp_path / "s" / n).read() for n in os.listdir(tmp_path / "s") if n.endswith(".csv"))
    assert text.strip() == "benchmark,source_file,sample_id,reason"


def test_stream_takes_new_files_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([("m", "b", "1", 1), ("m", "b", "2", 0)], "model_name string, benchmark string, sample_id string, correct int")
    df.write.json(inbox)
    assert rows(refresh_accuracy(spark, inbox, out, state)) == [("m", "b", 1, 2, 0.5)]
    df.limit(1).write.mode("append").json(inbox)
    assert rows(refresh_accuracy(spark, inbox, out, state)) == [("m", "b", 2, 3, pytest.approx(2 / 3))]


def test_stream_counts_redelivered_results_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "model_name string, benchmark string, sample_id string, negative_index int, correct int"
    first = spark.createDataFrame([("m", "b", "1", 0, 1), ("m", "b", "1", 1, 0), ("m", "b", "1", 1, 0), ("m", None, None, None, 1)], schema)
    first.write.json(inbox)
    refresh = lambda: rows(refresh_accuracy(spark, inbox, out, state, files_per_batch=2, remember_days=30))
    want = [("m", "b", 1, 2, 0.5), ("m", None, 1, 1, 1.0)]
    assert refresh() == want
    first.write.mode("append").json(inbox)
    assert refresh() == want
    # A late file, 20 days older than all others: its new result counts, its old one does not.
    first.limit(1).unionByName(spark.createDataFrame([("m", "b", "3", 0, 1)], schema)).coalesce(1).write.mode("append").json(inbox)
    newest = max((os.path.join(inbox, n) for n in os.listdir(inbox) if n.endswith(".json")), key=os.path.getmtime)
    dated = os.path.getmtime(newest) - 20 * 86_400
    os.utime(newest, (dated, dated))
    assert refresh() == [("m", "b", 2, 3, pytest.approx(2 / 3)), ("m", None, 1, 1, 1.0)]


def _json_value(rng, depth=0):
    kind = rng.random()
    if kind < 0.35:
        return "".join(rng.choice('ab,"\\[]{}: é\n,,') for _ in range(rng.randint(0, 30)))
    if kind < 0.6:
        return rng.choice([None, True, 7, -3, 10**6])
    if depth > 3:
        return 1.5
    if kind < 0.8:
        return [_json_value(rng, depth + 1) for _ in range(rng.randint(0, 5))]
    return {rng.choice(["images", 'a"b', "x,", "y"]): _json_value(rng, depth + 1) for _ in range(rng.randint(0, 5))}


@pytest.mark.parametrize("range_bytes", [100, 1 << 27])
def test_json_documents_cut_into_ranges(spark, tmp_path, range_bytes):
    """Quotes, escapes, brackets and commas across the ends of ranges; entries longer than several ranges."""
    rng = random.Random(range_bytes)
    value = lambda n: [_json_value(rng) for _ in range(n)]
    cases = {
        "list": (value(12), None),
        "object": ({f"m{i}": v for i, v in enumerate(value(12))}, None),
        "named": ({"info": {"images": [1, 2]}, "images": value(12), "z": [1, {"images": [3]}]}, "images"),
        "late": ({"a": value(6), "images": value(8)}, "images"),
        "no_list": ({"images": {"a": 1}, "b": [1, 2]}, "images"),
        "long": (["x" * 3000 + ",", {"a": "y," * 500}], None),
        "empty_list": ([], None),
        "empty_object": ({}, None),
        "empty_named": ({"images": []}, "images"),
    }
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, (doc, unwrap) in cases.items():
            path = tmp_path / f"{name}.json"
            path.write_text(json.dumps(doc, ensure_ascii=False, indent=rng.choice([None, 2])))
            if range_bytes == 100 and name == "long":
                assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 30
            got = sorted(json_entries(spark, str(path), unwrap).collect(), key=lambda r: r.record_index)
            inner = doc[unwrap] if unwrap and isinstance(doc[unwrap], list) else doc
            want = list(inner.items()) if isinstance(inner, dict) else [(None, v) for v in inner]
            assert [(r.key, r.record_index) for r in got] == [(k, n) for n, (k, _) in enumerate(want)], name
            assert [r.record if isinstance(v, str) or r.record is None else json.loads(r.record) for r, (_, v) in zip(got, want)] == [v for _, v in want], name
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_json_keys_given_twice(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text('{"a": 1, "b": {"c": 2}, "a": "x, y"}')
    got = json_entries(spark, str(path)).collect()
    assert sorted((r.record_index, r.key, r.record) for r in got) == [(0, "a", "x, y"), (1, "b", '{"c":2}')]


def test_tar_reads_neighbours_at_once_and_nothing_else():
    body = bytes(range(256)) * 4000
    asked = []

    def read_at(size, offset):
        asked.append((offset, size))
        return body[offset : offset + size]

    far = tar_source.GAP_BYTES + 1000
    spans = [(0, 10), (512, 20), (far * 2, 7), (30, 5), (far * 5, 0), (far * 5 + 100, 50)]
    assert tar_source.read_runs(read_at, spans) == [body[o : o + n] for o, n in spans]
    assert asked == [(0, 532), (far * 2, 7), (far * 5, 150)]


def test_tar_pushdown(spark, tmp_path):
    """A condition on the shard opens no other one; unread members stay as names."""
    for k in range(3):
        with tarfile.open(tmp_path / f"p{k}.tar", "w") as archive:
            for name, data in ((f"a{k}.txt", b"text"), (f"a{k}.jpg", b"x" * 5000)):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    reader = tar_source.TarShardReader([f"{tmp_path}/p{k}.tar" for k in range(3)], False)
    other = tar_source.EqualTo(("key",), "a1")
    assert list(reader.pushFilters([tar_source.EqualTo(("shard",), f"{tmp_path}/p1.tar"), other])) == [other]
    assert [p.path for p in reader.partitions()] == [f"{tmp_path}/p1.tar"]
    index = tar_source.read_index(spark, f"{tmp_path}/p{{0..2}}.tar")
    assert index.where(F.col("shard") == f"{tmp_path}/p2.tar").select("key").collect() == [("a2",)]
    samples, _ = read_tar_shards(spark, f"{tmp_path}/p0.tar", members=["txt"], keep_names=True)
    row = samples.collect()[0]
    assert {k: v and bytes(v) for k, v in row.members.items()} == {"txt": b"text", "jpg": None}
    assert samples.where(has_caption_and_image(F.col("members"))).count() == 1


def test_index_deals_many_small_shards_to_few_tasks(spark, tmp_path):
    n = tar_source.INDEX_TASKS * spark.sparkContext.defaultParallelism + 9
    for k in range(n):
        make_tar(tmp_path / f"m{k:03d}.tar", [(f"{k}.txt", b"a")])
    (tmp_path / "m004.tar").write_bytes(b"not a tar at all" * 64)
    index = tar_source.read_index(spark, f"{tmp_path}/m*.tar")
    assert index.rdd.getNumPartitions() < n
    found = index.collect()
    assert sorted(r.key for r in found if r.error is None) == sorted(str(k) for k in range(n) if k != 4)
    assert [r.shard[-8:] for r in found if r.error is not None] == ["m004.tar"]
