import json
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillwise import schema
from tillwise.sources import documents, export, files
from tillwise.streaming import jobs, tables


def write_inbox(path, names):
    path.mkdir(exist_ok=True)
    for name, content in names.items():
        (path / name).write_bytes(content)


def test_scan_real_files(spark, tmp_path):
    write_inbox(tmp_path / "in", {"a.pdf": b"%PDF one", "b.JPG": b"%PDF one", "c.txt": b"text", "d.png": b"old"})
    processed = spark.createDataFrame([], schema.PROCESSED_FILES)
    stored = spark.createDataFrame([("x",)], "v string").select(F.sha2(F.lit("old"), 256).alias("content_hash"))
    known = files.known_fingerprints(processed, stored)
    scanned = files.scan_receipt_files(files.read_inbox(spark, str(tmp_path / "in")), known)
    assert {r.filename: r.status for r in scanned.collect()} == {"a.pdf": "imported", "b.JPG": "duplicate", "d.png": "duplicate"}
    new = files.imported_receipts(scanned, "2024-01-01").first()
    assert (new.filename, new.extract_status, new.receipt_category) == ("a.pdf", "queued", "grocery")


def test_classify(spark):
    rows = [("a.png", "my fridge", b"x"), ("a.pdf", None, b"x"), ("a.png", None, b"x"), ("a.bin", None, b"%PDF-1"), ("a.doc", None, b"x"), ("a.png", "Kvitto", b"x")]
    df = spark.createDataFrame(rows, "f string, c string, b binary").select(files.classify_upload(F.col("f"), F.col("c"), F.col("b")).alias("v"))
    assert [(r.v.kind, r.v.confidence) for r in df.collect()] == [("inventory", 0.95), ("receipt", 0.95), ("receipt", 0.4), ("receipt", 0.95), ("receipt", 0.4), ("receipt", 0.95)]
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"RIFF1234WEBPVP8 ", b"0000ftypheic", b"zz", b""]
    got = spark.createDataFrame([(h,) for h in heads], "b binary").select(files.detected_ext(F.col("b"))).collect()
    assert [r[0] for r in got] == [".jpg", ".png", ".webp", ".heic", None, None]


def test_saved_store_is_migrated(spark, tmp_path):
    saved = {"data": {
        "receipts": {
            "a": {"id": "a", "total": 10, "receipt_type": "eating_out", "receipt_subcategory": "pub", "extract_status": "queued", "file_path": "/x", "purchased_at": "2024-01-02"},
            "b": {"id": "b", "total": 5, "receipt_category": "grocery", "grocery_subcategories": [{"subcategory": "dairy", "total": 2.004}, {"subcategory": "", "total": 3}]},
            "c": {"id": "c", "receipt_subcategories": []},
        },
        "stores": {"s": {"store_entity_id": "s", "chain_name": "ICA", "aliases": ["ICA"]}}, "store_aliases": {"willy s": "Willys"},
    }}
    (tmp_path / "store.json").write_text(json.dumps(saved, indent=1))
    tables = documents.load_snapshot(spark, str(tmp_path / "store.json"))
    got = {r.receipt_id: (r.receipt_category, r.extract_status, [tuple(s) for s in r.receipt_subcategories]) for r in tables["receipts"].collect()}
    assert got == {"a": ("dining", "pending", [("pub", 10.0)]), "b": ("grocery", "done", [("dairy", 2.0)]), "c": (None, "done", [])}
    assert [tuple(r) for r in tables["store_aliases"].collect()] == [("willy s", "Willys")]
    assert tables["stores"].count() == 1 and tables["products"].count() == 0


def test_write_and_export(spark, tmp_path):
    ddl = "receipt_id string, purchased_at timestamp, store_entity_id string, raw_text string, source_meta string"
    receipts = spark.createDataFrame([("a", datetime(2024, 1, 31, 23, 59), "s1", "t", "m"), ("b", datetime(2024, 2, 1), "s2", "t", "m"), ("c", None, None, "t", "m")], ddl)
    obs = spark.createDataFrame([("a", "p1"), ("b", "p2")], "receipt_id string, product_id string")
    tables = {"receipts": receipts, "observations": obs, "products": spark.createDataFrame([("p1",), ("p2",)], "product_id string"),
              "stores": spark.createDataFrame([("s1",), ("s2",)], "store_entity_id string"), "activities": obs}
    documents.write_tables({"receipts": receipts, "observations": obs}, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t" / "receipts"))
    assert back.count() == 3 and "purchase_month" in back.columns
    out = export.export_data(tables, "analytics", None, "2024-01-31")
    assert out["receipts"].columns == ["receipt_id", "purchased_at", "store_entity_id"]
    counts = {r.table_name: r.row_count for r in export.export_counts(out).collect()}
    assert counts == {"receipts": 1, "observations": 1, "products": 1, "stores": 1}
    none = export.export_data(tables, "full", "2030-01-01", None)
    assert {r.table_name: r.row_count for r in export.export_counts(none).collect()} == {"receipts": 0, "observations": 0, "products": 0, "stores": 0, "activities": 2}
    export.write_export(out, str(tmp_path / "e"), "2024-03-01")
    assert spark.read.json(str(tmp_path / "e" / "manifest")).where("schema_version = 1").count() == 4


def test_refused_uploads(spark, monkeypatch):
    monkeypatch.setattr(files, "MAX_UPLOAD_BYTES", 3)
    uploads = spark.createDataFrame([("u1", "c1", b"1234"), ("u2", "c1", b"123"), ("u3", "c9", b"1"), ("u4", None, b"1")], "upload_id string, chat_id string, content binary")
    allowed = spark.createDataFrame([("c1",), ("c1",)], "chat_id string")
    assert {r.upload_id: r.reason for r in files.refused_uploads(uploads, allowed).collect()} == {"u1": "too_large", "u3": "chat_not_allowed", "u4": "chat_not_allowed"}
    assert [r.upload_id for r in files.refused_uploads(uploads, None).collect()] == ["u1"]


def test_file_stream_sees_each_content_once(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    write_inbox(inbox, {"a.pdf": b"one", "b.pdf": b"one", "c.pdf": b"two", "d.txt": b"three"})
    known = lambda: files.known_fingerprints(spark.createDataFrame([], schema.PROCESSED_FILES), spark.createDataFrame([("x",)], "v string").select(F.sha2(F.lit("two"), 256).alias("content_hash")))
    sink = lambda df, epoch: df.write.mode("append").parquet(target)
    for _ in range(2):
        jobs.stream_ingest_files(jobs.stream_inbox(spark, str(inbox)), known, sink, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 1 and got.first().fingerprint == "sha256:" + __import__("hashlib").sha256(b"one").hexdigest()


def test_table_streams_read_folders(spark, sf_dir, tmp_path):
    """Large tables are folders of part files, not one file each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet.old")
    seen = entry.queries()["stream_ingest_files"](spark, str(tmp_path))
    assert seen.count() == docs.select("text").distinct().count()


def test_file_stream_keeps_old_files(spark, tmp_path):
    import os

    inbox, target = tmp_path / "in", str(tmp_path / "out")
    known = lambda: spark.createDataFrame([], "fingerprint string")
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    write_inbox(inbox, {"a.pdf": b"one"})
    for names in ({"epoch.pdf": b"two", "old.pdf": b"three", "copy.pdf": b"one"}, {}):
        jobs.stream_ingest_files(jobs.stream_inbox(spark, str(inbox)), known, sink, str(tmp_path / "cp")).awaitTermination()
        write_inbox(inbox, names)
        for name, when in (("epoch.pdf", 1), ("old.pdf", 10**8)):
            os.utime(inbox / name, (when, when))
    assert sorted(r.filename for r in spark.read.parquet(target).collect()) == ["a.pdf", "epoch.pdf", "old.pdf"]


def test_file_stream_forgets_nothing_and_rereads_nothing(spark, tmp_path):
    """Copies of contents from any earlier batch are left out, known ones too, and a batch that is run again feeds the same."""
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    known = lambda: spark.createDataFrame([("sha256:" + __import__("hashlib").sha256(b"known").hexdigest(),)], "fingerprint string")
    sink = lambda df, epoch: df.select("filename", "fingerprint", "status").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    for i in range(5):
        write_inbox(inbox, {f"new{i}.pdf": b"new%d" % i, f"copy{i}.pdf": b"new0", f"known{i}.pdf": b"known", f"x{i}.txt": b"text%d" % i})
        jobs.stream_ingest_files(jobs.stream_inbox(spark, str(inbox)), known, sink, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 5 == got.select("fingerprint").distinct().count() and {r.status for r in got.collect()} == {"imported"}
    before = sorted(tuple(r) for r in got.collect())
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    (tmp_path / "cp" / "commits" / str(last)).unlink()
    (tmp_path / "cp" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    jobs.stream_ingest_files(jobs.stream_inbox(spark, str(inbox)), known, sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == before


def test_weeks_are_local_monday_weeks(spark, tmp_path):
    rows = [("2024-03-10 23:30:00", 1.0), ("2024-03-11 10:00:00", 2.0), ("2024-03-18 10:00:00", 4.0), ("2024-06-01 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "purchased_at string, total double").select(F.col("purchased_at").cast("timestamp"), "total", F.lit("grocery").alias("receipt_category"))
    df.write.parquet(str(tmp_path / "r"))
    stream = jobs.stream_spend_by_week(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r")), "Europe/Stockholm")
    for late in ("2024-03-12 08:00:00", None):
        jobs.upsert(stream, str(tmp_path / "weeks"), str(tmp_path / "state"), ["week_start", "category"]).awaitTermination()
        if late:  # months after the newest row
            df.limit(1).select(F.lit(late).cast("timestamp").alias("purchased_at"), F.lit(8.0).alias("total"), "receipt_category").write.mode("append").parquet(str(tmp_path / "r"))
    got = {str(r.week_start): r.total for r in jobs.latest(spark, str(tmp_path / "weeks"), stream.schema, ["week_start", "category"]).collect()}
    assert got == {"2024-03-11 00:00:00": 11.0, "2024-03-18 00:00:00": 4.0, "2024-05-27 00:00:00": 0.0}


ITEM = "line_item_id string, receipt_id string, raw_name string, line_total double, qty_raw string, unit_price_raw double, arrival long"
HEAD = "receipt_id string, store_name string, purchased_at timestamp, updated_at timestamp"


def arrive(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))


def day_of(n):
    return datetime(2024, 1, n)


def test_observations_wait_for_their_receipt(spark, tmp_path):
    """Items and receipts come in any order, change, and are withdrawn; a batch that is run again adds nothing."""
    items, heads = tmp_path / "i", tmp_path / "h"
    arrive(spark, items, [("r1-0", "r1", "Milk", 6.0, "2 pcs", None, 1), ("r2-0", "r2", "Oat bread", 9.0, "3 pcs", None, 2), ("r3-0", "r3", " ", 9.0, None, None, 3)], ITEM)
    arrive(spark, heads, [("r1", "S", day_of(1), day_of(1)), ("r3", "S", day_of(1), day_of(1))], HEAD)
    observed, names = jobs.observation_table(spark, str(tmp_path / "o"), 3), jobs.product_name_table(spark, str(tmp_path / "n"), 3)

    def run():
        sides = [spark.readStream.schema(ddl).parquet(str(folder)) for folder, ddl in ((items, ITEM), (heads, HEAD))]
        jobs.stream_observations(*sides, observed, str(tmp_path / "cp"), names).awaitTermination()
        return {r.line_item_id: (r.store_name, r.unit_price, r.product_id) for r in jobs.current_observations(spark, observed).collect()}

    first = run()
    assert {k: v[:2] for k, v in first.items()} == {"r1-0": ("S", 3.0)}
    arrive(spark, heads, [("r2", "T", day_of(2), day_of(2))], HEAD)  # the receipt comes after its item
    arrive(spark, items, [("r1-1", "r1", "Milk", 8.0, "2 pcs", None, 4), ("r1-2", "r1", "Oat breads", 5.0, "1 pcs", None, 5)], ITEM)
    second = run()
    assert {k: v[:2] for k, v in second.items()} == {"r1-0": ("S", 3.0), "r2-0": ("T", 3.0), "r1-1": ("S", 4.0), "r1-2": ("S", 5.0)}
    assert second["r1-0"][2] == second["r1-1"][2] == first["r1-0"][2] and second["r2-0"][2] == second["r1-2"][2]
    arrive(spark, heads, [("r1", "Moved", day_of(1), day_of(5))], HEAD)  # a receipt corrected later
    arrive(spark, items, [("r2-0", "r2", "Oat bread", None, "3 pcs", None, 6), ("r1-3", "r1", "Oat bread", 2.0, "1 pcs", None, 7)], ITEM)
    third = run()
    assert {k: v[:2] for k, v in third.items()} == {"r1-0": ("Moved", 3.0), "r1-1": ("Moved", 4.0), "r1-2": ("Moved", 5.0), "r1-3": ("Moved", 2.0)}
    assert third["r1-3"][2] == second["r2-0"][2]
    arrive(spark, heads, [("r2", "T", None, day_of(3))], HEAD)
    fourth = run()
    assert fourth == third == run()
    # The last batch is run again after a crash between its writes and its commit.
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    (tmp_path / "cp" / "commits" / str(last)).unlink()
    (tmp_path / "cp" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert run() == third
    assert names.read(spark).count() == 3


def test_batch_tables_merge(spark, tmp_path):
    """After any number of batches a reader needs one base and fewer than ``every`` batches, and nothing is lost."""
    rows = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    table = tables.BatchTable(str(tmp_path / "t"), rows([]).schema, ["k"], every=4)
    want = {}
    for epoch in range(18):
        batch = {"a": epoch, f"k{epoch % 5}": epoch}
        table.write(rows(list(batch.items())), epoch)
        if epoch in (6, 7, 11):
            table.write(rows(list(batch.items())), epoch)  # run again
        want |= batch
        assert {r.k: r.v for r in table.read(spark).collect()} == want and len(table.sources(spark)) <= 4
    assert {r.k: r.v for r in table.read(spark, before=17).collect()} == want | {"a": 16, "k2": 12}
    assert tables.numbered(spark, f"{table.path}/base", "upto") == [11, 15] and tables.numbered(spark, f"{table.path}/batches", "epoch") == [12, 13, 14, 15, 16, 17]
    assert tables.numbered(spark, str(tmp_path / "none"), "x") == []


def test_batch_tables_keep_the_newest_version(spark, tmp_path):
    rows = lambda triples: spark.createDataFrame(triples, "k string, at int, v string")
    table = tables.BatchTable(str(tmp_path / "t"), rows([]).schema, ["k"], ["at"], every=2)
    table.write(rows([("a", 5, "new"), ("b", 1, "b1"), (None, 1, "n")]), 0)
    table.write(rows([("a", 3, "old"), ("b", 1, "b2")]), 1)
    table.write(rows([("a", None, "none")]), 2)
    assert {r.k: r.v for r in table.read(spark).collect()} == {"a": "new", "b": "b2", None: "n"}


def test_observations_without_names_are_stored_once(spark, sf_dir, monkeypatch):
    from tillwise.plans.queries_data import stream_observations

    def refuse(df):
        raise AssertionError("stored between the join and the table")

    monkeypatch.setattr(jobs, "settle", refuse)
    assert stream_observations(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_observations_wait_in_a_table(spark, tmp_path):
    """No row is held in the state of the stream; random arrivals give what all pairs give, through merges and batches that are run again."""
    import random

    rng = random.Random(7)
    observed, lines, heads = jobs.observation_table(spark, str(tmp_path / "o"), 2), [], []
    for n in range(5):
        new = [(f"l{rng.randrange(9)}", f"r{rng.randrange(6)}", rng.choice(["Milk", "Tea", None]), float(rng.randrange(1, 9)), rng.choice(["2 pcs", None, "500 g"]), None, rng.randrange(10**6)) for _ in range(6)]
        new += [("x", None, "Milk", 1.0, None, None, n), (None, "r1", "Tea", 2.0, "1 pcs", None, 100 + n)]
        told = [(f"r{rng.randrange(6)}", f"S{rng.random()}", rng.choice([day_of(1), day_of(2), None]), datetime.fromtimestamp(rng.randrange(1, 10**9))) for _ in range(2 * (n % 3))]
        told += [(None, "nowhere", day_of(1), day_of(1))] + [("r1", "undated", day_of(3), None)] * (n == 1)
        for folder, rows, ddl, known in ((tmp_path / "i", new, ITEM, lines), (tmp_path / "h", told, HEAD, heads)):
            arrive(spark, folder, rows, ddl)
            known += rows

        def run():
            sides = [spark.readStream.schema(ddl).parquet(str(tmp_path / name)) for name, ddl in (("i", ITEM), ("h", HEAD))]
            query = jobs.stream_observations(*sides, observed, str(tmp_path / "cp"))
            query.awaitTermination()
            assert query.lastProgress is None or query.lastProgress["stateOperators"] == []
            return sorted(map(str, ((r.line_item_id, r.receipt_id, r.raw_name, r.store_name, r.unit_price, r.arrival) for r in observed.read(spark).collect())))

        best = {}
        for l in lines:
            for h in heads:
                order = (h[3] is not None, h[3] or day_of(1), l[6])
                if l[1] is not None and l[1] == h[0] and (l[0] not in best or order > best[l[0]][0]):
                    each = l[3] / {"2 pcs": 2, "1 pcs": 1, "500 g": 0.5}[l[4]] if l[4] and l[2] and h[2] else None
                    best[l[0]] = order, (l[0], l[1], l[2], h[1], each, l[6])
        want = sorted(map(str, (row for _, row in best.values())))
        assert run() == want, n
        if n in (1, 3, 4):  # 1 and 3 merge
            (tmp_path / "cp" / "commits" / str(n)).unlink()
            (tmp_path / "cp" / "commits" / f".{n}.crc").unlink(missing_ok=True)
            assert run() == want, n
    assert len(want) > 8 and not (tmp_path / "cp" / "state").exists()


def test_a_merge_that_is_run_again_reads_nothing_it_replaces(spark, tmp_path):
    rows = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    table = tables.BatchTable(str(tmp_path / "t"), rows([]).schema, ["k"], every=2)
    table.write(rows([("a", 0), ("b", 0)]), 0)
    table.write(rows([("a", 1)]), 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the batches of a stream with state
    try:
        table.write(rows([("a", 1)]), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.k: r.v for r in table.read(spark).collect()} == {"a": 1, "b": 0}


def test_items_are_priced_in_compiled_code(spark):
    from tillwise.operators.derive import priced_items

    rows = priced_items(spark.createDataFrame([("2 pcs", 6.0, None)], "qty_raw string, line_total double, unit_price_raw double"))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.first().unit_price == 3.0
