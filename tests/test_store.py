"""Versions of tables that are published together, the bucketed master table, and packages of media."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelight.functions.lineage import shared_folder
from framelight.sinks.master import clear_master, clear_pages, load_master, master, upsert_master
from framelight.sinks.media import as_png, is_within, media_files, package_mark, png, read_package, with_media_paths, within, write_package
from framelight.sinks.versions import Conflict, Versions

ROWS = "main_category string, subcategory string, page_label string, page_url string, product_name string, product_url string, seq int"


def rows(spark, *items):
    """items: (page, product, seq)"""
    return spark.createDataFrame([("m", "s", p, f"https://x/{p}", n, f"https://x/{n}", i) for p, n, i in items], ROWS)


def held(store, number=None):
    return sorted((r.page_label, r.product_name) for r in master(store, number).collect())


def files_under(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root.removeprefix("file://")) for f in names if not f.startswith((".", "_"))}


def test_an_upsert_writes_what_it_touches(spark):
    store = Versions(spark, shared_folder(spark, "m"))
    assert store.number() == 0 and store.table("master") is None
    pages = [(f"p{i}", f"n{i}-{k}", 10 * i + k) for i in range(20) for k in range(3)]
    load_master(store, rows(spark, *pages, ("p0", "n0-0", 999)), buckets=16)
    assert len(held(store)) == 60
    before = files_under(store.root)
    with store.change() as change:
        counts = upsert_master(change, rows(spark, ("p3", "new", 1), ("p3", "n3-0", 2)))
        assert change.commit() == 2
    assert counts == {"before": 60, "after": 59, "added": 2, "removed": 3}
    made = {f for f in files_under(store.root) - before if f.endswith(".parquet")}
    assert before <= files_under(store.root) and len({f.split("bucket_=")[1].split("/")[0] for f in made}) == 1, "one page, one bucket"
    assert [h for h in held(store) if h[0] == "p3"] == [("p3", "n3-0"), ("p3", "new")] and len(held(store, 1)) == 60
    with store.change() as change:
        assert upsert_master(change, rows(spark, ("p3", "new", 5), ("p4", "more", 6), ("p4", "n4-1", 7)), "append") == {"before": 59, "after": 60, "added": 1, "removed": 0}
        change.commit()
    with store.change() as change:
        assert upsert_master(change, rows(spark)) == {"before": 60, "after": 60, "added": 0, "removed": 0} and change.made == []
    with store.change() as change:
        assert clear_pages(change, rows(spark, ("p4", "", 0), ("nowhere", "", 0)).drop("product_name")) == 4
        change.commit()
    assert len(held(store)) == 56 and not [h for h in held(store) if h[0] == "p4"]
    with store.change() as change:
        clear_master(change)
        change.commit()
    assert held(store) == [] and store.number() == 5 and len(held(store, 3)) == 60


def test_tables_are_published_together_or_not_at_all(spark):
    """A failure between two tables leaves both as they were; of two changes the second is told."""
    store = Versions(spark, shared_folder(spark, "v"))
    edits = lambda *x: spark.createDataFrame(list(x), "product_key string, n int")
    key = F.col("product_key")
    with store.change() as change:
        change.put("edits", edits(("a", 1), (None, 2)), key)
        change.put("revisions", edits(("a", 1)), key)
        change.commit()
    whole = files_under(store.root)
    with pytest.raises(ZeroDivisionError), store.change() as change:
        change.put("edits", edits(("a", 7)), key)
        raise ZeroDivisionError
    with pytest.raises(Exception, match="boom"), store.change() as change:
        change.put("edits", edits(("a", 8)), key)
        change.put("revisions", edits(("a", 8)).withColumn("n", F.when(F.rand() < 2, F.raise_error(F.lit("boom")).cast("int"))), key)
        change.commit()
    assert {f for f in files_under(store.root) if "_temporary" not in f} >= whole and store.number() == 1
    first, second = store.change(), store.change()
    first.put("edits", edits(("a", 2)), key)
    second.put("edits", edits(("a", 3)), key)
    second.put("revisions", edits(("a", 3)), key)
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert [tuple(r) for r in store.table("edits").collect()] == [("a", 2)] and [tuple(r) for r in store.table("revisions").collect()] == [("a", 1)]
    assert sorted(str(r) for r in store.table("edits", 1).collect()) == sorted(str(r) for r in edits(("a", 1), (None, 2)).collect())
    with store.change() as again:
        again.put("edits", edits(("a", 3)), key, replaced=again.touched("edits", edits(("a", 0)), key))
        with pytest.raises(ValueError, match="outside"):
            again.put("edits", edits(*[(f"k{i}", 0) for i in range(50)]), key, replaced={0})
        again.commit()
    lost = store.change()
    lost.put("edits", edits(("z", 9)), key)  # its driver is lost: neither committed nor rolled back
    assert store.sweep() >= 1 and [tuple(r) for r in store.table("edits").collect()] == [("a", 3)] and store.sweep() == 0


def test_paths_stay_within_their_package(spark):
    good = ["a.png", "media/x/y.png", "a b/..c", "ä/1"]
    bad = ["", None, "/a", "../a", "a/../b", "a/..", "./a", "a//b", "a/", "C:/x", "a\\..\\b", "\\a", "a\x00b", "a\nb", "_PACKAGE", "_PACKAGE/x"]
    got = spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", is_within(F.col("p")).alias("ok")).collect()
    assert [r.p for r in got if r.ok] == good
    for p in good:
        assert within(p) == p
    for p in bad:
        with pytest.raises(ValueError):
            within(p)


def test_a_package_is_whole_or_not_there(spark):
    root = shared_folder(spark, "media")
    os.makedirs(root.removeprefix("file://"))
    files = spark.createDataFrame([(f"media/Ö+%/p{i}/current.png", bytes([i]) * i) for i in range(40)] + [("media/none.bin", None)], "path string, content binary").repartition(5)
    write_package(files, root, "one")
    assert package_mark(root, "one") == {"files": 39, "size": sum(range(40))}
    assert sorted((r.path, bytes(r.content)) for r in read_package(spark, root, "one").collect()) == sorted((r.path, bytes(r.content)) for r in files.collect() if r.content)
    with pytest.raises(Exception, match="already"):
        write_package(files, root, "one")
    with pytest.raises(Exception, match="leaves its package"):
        write_package(files.unionByName(spark.createDataFrame([("../out.png", b"x")], files.schema)), root, "two")

    def die(batches):  # the worker of one task is killed
        for b in batches:
            if any(p.endswith("p17/current.png") for p in b.column(0).to_pylist()):
                os._exit(1)
            yield b

    with pytest.raises(Exception):  # noqa: B017
        write_package(files.mapInArrow(die, files.schema), root, "three")
    assert os.listdir(root.removeprefix("file://")) == ["one"] and package_mark(root, "three") is None
    with pytest.raises(FileNotFoundError):
        read_package(spark, root, "three")


def test_a_package_is_read_by_its_tasks_lists(spark):
    """No folder is listed: what stands in a package beside its files is none of it."""
    root = shared_folder(spark, "media")
    files = spark.createDataFrame([(f"media/p{i}/current.png", bytes([i])) for i in range(1, 9)], "path string, content binary").repartition(3)
    write_package(files, root, "one")
    with open(f"{root.removeprefix('file://')}/one/media/stray.png", "wb") as f:
        f.write(b"x")
    got = read_package(spark, root, "one")
    assert sorted(r.path for r in got.collect()) == sorted(r.path for r in files.collect()) and got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_media_of_rows(spark):
    has = {"current_image_file": "now", "normalized_image_file": "then", "comparison_image_file": "both"}
    form = "main_category string, subcategory string, page_label string, page_url string, product_name string, product_url string, now binary, then binary, both binary"
    df = spark.createDataFrame([("A/B", None, "P", "", "CON", "https://x/1", b"1", b"2", None), ("A/B", None, "P", "", "CON", "https://x/2", b"3", None, None), ("", "", "", "", None, None, None, None, None)], form)
    got = with_media_paths(df, has)
    paths = [(r.current_image_file, r.normalized_image_file, r.comparison_image_file) for r in got.collect()]
    assert paths[0][0].endswith("/current.png") and paths[0][1].endswith("/normalized.png") and paths[0][2] == "" and paths[1][1] == "" and paths[2] == ("", "", "")
    assert paths[0][0] != paths[1][0] and all(within(p) == p for row in paths for p in row if p)
    assert sorted(bytes(r.content) for r in media_files(got, has).collect()) == [b"1", b"2", b"3"]


def test_png(spark):
    x = np.random.default_rng(0).integers(0, 256, (7, 5, 3), np.uint8)
    data = png(x)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (5, 7)
    body = data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(7, 16)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(7, 5, 3) == x).all()
    got = spark.createDataFrame([(x.tobytes(), 7, 5, 3), (x.tobytes(), 7, 5, 4), (None, 7, 5, 3)], "d binary, h int, w int, c int").select(as_png("d", "h", "w", "c")).collect()
    assert bytes(got[0][0]) == data and got[1][0] is None and got[2][0] is None
