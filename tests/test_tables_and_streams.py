"""Readers, keyed state and streams on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from verdigris.operators import metrics, similarity, splits
from verdigris.sources import tables
from verdigris.streaming import streams

START = dt.datetime(2024, 1, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿label,text\nham,\"a\nb\"\n".encode())
    assert tables.read_any_encoding(spark, str(tmp_path / "bom.csv")).collect()[0].asDict() == {"label": "ham", "text": "a\nb"}
    (tmp_path / "old.csv").write_bytes("label,text\nspam,caf\xe9\n".encode("cp1252"))
    assert tables.load_mendeley(spark, str(tmp_path / "old.csv")).select("label", "text", "dataset").first() == ("promo_spam", "café", "mendeley")
    (tmp_path / "x.tsv").write_bytes(b"ham\thello\nspam\t\nspam\tx\ty\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "x.tsv")).collect()] == [("ham", "hello"), ("spam", "x\ty")]
    body = "".join(f"## {x}\ntext\n" for x in tables.SECTIONS)
    full = "slug: {0}\ntitle: A\ncategory: qr_code\nkind: scam"
    docs = {
        "good-one": (full.format("good-one").replace("A", '"A: \\"b\\""  # said') + "\n\n# comment\nsource_url: 'it''s'\nneeds_source_check: no", body, None),
        "none": (None, "no front matter", "no front matter"),
        "list": ("- a\n- b", body, "the front matter is no mapping"),
        "word": ("just words", body, "the front matter is no mapping"),
        "quote": (full.format("quote") + '\nsource_url: "open', body, 'invalid YAML: source_url: "open'),
        "nested": (full.format("nested") + "\na: b: c", body, "invalid YAML: a: b: c"),
        "keys": ("slug: keys\ntitle: ''\nkind: scam", body, "missing keys: title, category"),
        "name": (full.format("other"), body, "slug other is not the name name"),
        "kind": (full.format("kind").replace("kind: scam", "kind: odd"), body, "unknown kind"),
        "type": (full.format("type").replace("qr_code", "generic"), body, "not a type of scam: generic"),
        "calm": (full.format("calm").replace("kind: scam", "kind: genuine"), body, "a genuine document of another category"),
        "parts": (full.format("parts"), body.replace("## Red flags", "### Red flags"), "missing sections: Red flags"),
        "empty": ("slug: empty\ntitle: A\ncategory: genuine\nkind: genuine", " \n", "no content"),
        "fine": ("slug: fine\r\ntitle: A\r\ncategory: genuine\r\nkind: genuine", "words", None),
    }
    (tmp_path / "kb").mkdir()
    for name, (front, text, _) in docs.items():
        (tmp_path / f"kb/{name}.md").write_bytes(("\ufeff" * (name == "fine") + (text if front is None else f"---\n{front}\n---\n{text}")).encode())
    read = {r["name"]: r for r in tables.read_patterns(spark, str(tmp_path / "kb")).collect()}
    assert {n: read[n]["reason"] for n in docs} == {n: why for n, (_, _, why) in docs.items()}
    good = read["good-one"]
    assert (good["title"], good["source_url"], good["needs_source_check"], good["sections"]) == ('A: "b"', "it's", False, tables.SECTIONS) and read["fine"]["needs_source_check"]


def test_records_over_quoted_line_breaks(spark, tmp_path):
    import csv
    import random

    from verdigris.sources import records

    rng = random.Random(2)
    bits = ["a", ",", '"', "\n", " ", "é", "x" * 30, ""]
    files = {}
    for f in range(3):
        rows = [["text", "Label ", "scam_type"]] + [["".join(rng.choices(bits, k=rng.randint(0, 12))), rng.choice(["scam", "genuine", "odd"]), rng.choice(["qr_code", "", "none"])] for _ in range(120)]
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8-sig") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            for i, row in enumerate(rows):
                w.writerow(row)
                if i % 7 == 0:
                    out.write("\n")
        with open(tmp_path / f"f{f}.csv", newline="", encoding="utf-8-sig") as back:
            files[f"f{f}.csv"] = [r for r in csv.reader(back) if r]
    want = {(name, n): r for name, rows in files.items() for n, r in enumerate(rows, 1) if n > 1}
    # blocks far smaller than a file: records that lie over their borders
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("700", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {(r["file"], r["record"]): r["fields"] for r in records.records(spark, f"{tmp_path}/f*.csv").collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])

    (tmp_path / "late.csv").write_text("message,label\nx,scam\n")
    rows, problems = records.collected(spark, [f"{tmp_path}/f0.csv", f"{tmp_path}/late.csv"])
    found = {(r["file"], r["record"]): r["problem"] for r in problems.collect()}
    bad = {}
    for n, (text, label, kind) in enumerate(files["f0.csv"][1:], 2):
        why = "empty text" if not text.strip(" ") else "unknown label" if label == "odd" else "scam without a known type" if label == "scam" and kind != "qr_code" else "type on a row that is no scam" if label != "scam" and kind else None
        bad |= {("f0.csv", n): why} if why else {}
    assert found == {**bad, ("late.csv", None): "missing columns text; the file is skipped"}
    assert rows.count() == 120 - len(bad) and {r[0] for r in rows.select("label_source").distinct().collect()} == {"manual"}


def test_synthetic_and_india_loaders(spark, tmp_path):
    from verdigris.sources import records

    (tmp_path / "a.csv").write_text('text,label,scam_type,parent_id\n"one\nline",scam,qr_code,p1\n,scam,qr_code,\nodd,strange,,\n')
    (tmp_path / "b.csv").write_text("label,text,source\ngenuine,One line,second\ngenuine,other,second\n")
    got = {r["text"]: r for r in records.synthetic(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).collect()}
    assert set(got) == {"one\nline", "other"} and (got["one\nline"]["label"], got["one\nline"]["parent_id"], got["other"]["source"]) == ("scam", "p1", "second") and got["other"]["dataset"] == "synthetic"
    (tmp_path / "in.csv").write_bytes("Msg,Label\nSee you at nine caf\xe9,ham\nScan the QR code to receive Rs 5000 in your account now,spam\nBig sale 50% off today,spam\n,ham\nx,odd\n".encode("cp1252"))
    rows = {r["label_source"] + ":" + r["text"][:3]: r for r in records.india(spark, f"{tmp_path}/in.csv").collect()}
    assert set(rows) == {"dataset:See", "auto:Sca", "auto:Big"} and rows["dataset:See"]["label"] == "genuine" and rows["auto:Big"]["label"] == "promo_spam"
    assert (rows["auto:Sca"]["label"], rows["auto:Sca"]["auto_label"], rows["dataset:See"]["auto_label"]) == ("scam", "scam", None) and rows["auto:Sca"]["dataset"] == "india"
    key = rows["auto:Sca"]["text_id"]
    import datetime

    reviews = spark.createDataFrame([(key, "genuine", "manual", datetime.date(2024, 1, 1))], "text_id string, label string, label_source string, reviewed_at date")
    again = {r["text_id"]: r for r in records.india(spark, f"{tmp_path}/in.csv", reviews).collect()}
    assert (again[key]["label"], again[key]["label_source"], again[key]["auto_label"]) == ("genuine", "manual", "scam")


def test_lookup_columns(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("172.20.0.1",), ("nope",)], "ip string")
    assert [r[0] for r in df.select(tables.is_public_ip(F.col("ip"))).collect()] == [True, False, False, False]
    answer = '{"events":[{"eventAction":"Registration","eventDate":"2020-01-02T00:00:00Z"}]}'
    assert spark.range(1).select(tables.registration_date(F.lit(answer))).first()[0] == dt.date(2020, 1, 2)


def test_append_new(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert tables.append_new(df, str(tmp_path / "t"), "id") == 2
    assert tables.append_new(df.union(spark.createDataFrame([("c",)], "id string")), str(tmp_path / "t"), "id") == 1


def test_average_precision_with_ties(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, truth boolean")
    assert abs(metrics.average_precision(rows).first()[0] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12
    assert metrics.fpr_at_recall(rows, 1.0).first().asDict() == {"threshold": 0.8, "fpr": 0.5}
    best = metrics.temperature(spark.createDataFrame([(2.0, True), (-2.0, False), (1.0, False)], "logit double, truth boolean")).first()
    assert 0.2 <= best["temperature"] <= 5


def test_groups_and_greedy_drop(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")
    got = {r["id"]: r["component"] for r in similarity.groups(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    rows = spark.createDataFrame([(1, "auto"), (2, "manual"), (3, "auto"), (4, "auto"), (7, "auto"), (8, "auto")], "id long, label_source string")
    assert {r["id"] for r in similarity.greedy_dropped(pairs, rows).collect()} == {1, 3, 8}


def test_splits(spark):
    rows = spark.createDataFrame([(str(i), str(i // 3), "synthetic" if i % 5 == 0 else "real", str(i - 1) if i % 5 == 0 else None) for i in range(60)], "text_id string, group_id string, source string, parent_id string")
    frozen = spark.createDataFrame([("1",)], "text_id string")
    got = {r["text_id"]: r["split"] for r in splits.splits(rows, frozen).collect()}
    assert got["1"] == "test" and got["2"] == "heldout"
    assert all(got[str(i)] == "train" and got.get(str(i - 1), "train") == "train" for i in range(5, 60, 5) if str(i) in got)


def collected(spark, stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}").collect()


def hits(spark, tmp_path):
    rows = [("a", START + dt.timedelta(seconds=10 * i), float(i)) for i in range(10)] + [("b", START, 1.0)]
    schema = "key string, ts timestamp, value double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, streams.source(spark, str(tmp_path / "in"), schema)


def test_stream_counters_match_batch(spark, tmp_path):
    df, stream = hits(spark, tmp_path)
    batch = {tuple(r) for r in streams.counters(df, ["key"]).collect()}
    assert {tuple(r) for r in collected(spark, streams.counters(stream, ["key"]), "complete", "counters")} == batch


def test_stream_windows_and_sessions(spark, tmp_path):
    _, stream = hits(spark, tmp_path)
    got = collected(spark, streams.windows(stream, "key", width="1 minute"), "update", "windows")
    assert sorted((r["key"], r["n"]) for r in got) == [("a", 4), ("a", 6), ("b", 1)]


def test_stream_rate_limit(spark, tmp_path):
    _, stream = hits(spark, tmp_path)
    got = collected(spark, streams.rate_limited(stream, "key", 3), "append", "limited")
    allowed = sorted((r["ts"] - START).seconds for r in got if r["key"] == "a" and r["allowed"])
    assert allowed == [0, 10, 20, 60, 70, 80]


def test_stream_upsert(spark, tmp_path):
    _, stream = hits(spark, tmp_path)
    q = streams.upserted(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["key"])
    assert q.awaitTermination(180)
    assert {r["key"]: r["report_count"] for r in spark.read.parquet(str(tmp_path / "out/version=0")).collect()} == {"a": 10, "b": 1}


def test_reviews_by_authority(spark):
    rows = spark.createDataFrame([("a", "scam", "auto"), ("b", "scam", "manual"), ("c", "scam", "dataset"), ("d", "scam", None), ("e", "scam", "assisted")], "text_id string, label string, label_source string")
    day = lambda n: dt.date(2024, 1, n)
    reviews = [("a", "genuine", "assisted", day(1)), ("a", "promo_spam", "assisted", day(2)), ("b", "genuine", "assisted", day(3)), ("c", "genuine", "manual", day(1)), ("c", "scam", "assisted", day(9)), ("d", "genuine", "auto", day(1)), ("e", "genuine", "manual", day(1))]
    got = {r["text_id"]: (r["label"], r["label_source"]) for r in tables.with_reviews(rows, spark.createDataFrame(reviews, "text_id string, label string, label_source string, reviewed_at date")).collect()}
    assert got == {"a": ("promo_spam", "assisted"), "b": ("scam", "manual"), "c": ("genuine", "manual"), "d": ("genuine", "auto"), "e": ("genuine", "manual")}
