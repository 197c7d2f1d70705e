"""Links against tables, senders, the classifier and what they add to the score, reports and splits, on small fixtures with expected values."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.functions import entities as E
from verdigris.operators import blocks, classifier, links, reports, scoring, senders, similarity, splits
from verdigris.sources import journal

DAY = dt.date(2024, 6, 1)


@pytest.fixture(scope="module")
def checked(spark):
    urls = ["https://bit.ly/a", "https://bit.ly/gone", "https://bit.ly/old", "https://sbi-verify.com/x", "https://plain.org/", "https://sbi.co.in/login", "https://bad.net/", "https://bit.ly/bank", "https://young.dev/"]
    redirects = spark.createDataFrame([("https://bit.ly/a", 301, "https://fresh.com/p"), ("https://bit.ly/gone", 410, None), ("https://bit.ly/old", 302, "https://old.com/"), ("https://bit.ly/bank", 301, "https://sbi.co.in/")], "url string, status int, location string")
    ages = [("fresh.com", 3), ("old.com", 4000), ("sbi-verify.com", 5), ("young.dev", 100), ("bit.ly", 4000)]
    domains = spark.createDataFrame([(d, DAY - dt.timedelta(days=n)) for d, n in ages], "domain string, registered date")
    bad = spark.createDataFrame([("https://bad.net/", ["malware"]), ("https://plain.org/", [])], "url string, threats array<string>")
    found = links.checked(spark.createDataFrame([(u,) for u in urls + urls[:1]], "url string"), redirects, domains, bad, F.lit(DAY))
    return found.cache()


def test_links(checked):
    got = {r["url"].split("//")[1]: (sorted(r["findings"]), r["score"], r["floor"], r["allowlisted"]) for r in checked.collect()}
    assert len(got) == 9
    assert got["bit.ly/a"] == (["new_domain", "shortener_redirect"], 72, 50, False)
    assert got["bit.ly/gone"] == (["short_link_disabled"], 30, None, False)
    assert got["bit.ly/old"] == (["shortener_redirect"], 10, None, False)
    assert got["sbi-verify.com/x"] == (["lookalike", "new_domain"], 88, 75, False)
    assert got["plain.org/"] == ([], 0, None, False)
    assert got["sbi.co.in/login"] == ([], 0, None, True)
    assert got["bad.net/"] == (["blocklisted"], 100, 90, False)
    assert got["bit.ly/bank"] == ([], 0, None, True)
    assert got["young.dev/"][0] == ["young_domain"]


def test_riskiest_link_decides(spark, checked):
    of = spark.createDataFrame([(1, "https://bit.ly/a"), (1, "https://bad.net/"), (2, "https://sbi.co.in/login"), (2, "https://bit.ly/bank"), (3, "https://plain.org/"), (3, "https://sbi.co.in/login")], "m int, url string")
    got = {r["m"]: (r["score"], r["informative"], r["floor"]) for r in links.riskiest(of.join(checked, "url"), "m").collect()}
    assert got == {1: (100, True, 90), 2: (0, True, None), 3: (0, False, None)}


SENDERS = {"VM-SBIINB": "dlt_header", "jd-airtel0-S": "name", "JD-AIRTEL-S": "dlt_header", "+44 7911 123456": "international", "0044 7911 123456": "international", "+91 98765 43210": "personal_mobile", "9876543210": "personal_mobile", "1800 11 2211": "other_number", "Asha": "name", "": None, None: None}


def test_senders(spark):
    df = spark.createDataFrame([(s,) for s in SENDERS], "s string").select("s", senders.sender_kind(F.col("s")).alias("k"))
    assert {r["s"]: r["k"] for r in df.collect()} == SENDERS
    text = "\n 10:42 \nVM-SBIINB\nPayment is successful\n+91 98765 43210"
    got = spark.createDataFrame([(text,), ("hello\na.b@c.org",), (None,)], "t string").select(senders.guess_fields(F.col("t")).alias("g")).select("g.*").collect()
    assert [tuple(r) for r in got] == [("VM-SBIINB", "payment_app", True), ("a.b@c.org", "email", False), (None, "other", False)]


def test_each_table_changes_the_score(spark):
    rows = [
        (1, "Dear customer, we will visit soon", ("+44 7911 123456", False)),
        (2, "I sent money by mistake, please return the money to me", ("Asha", True)),
        (3, "see you at http://plain.org/ for lunch", ("VM-SBIINB", False)),
        (4, "lunch at one", (None, False)),
    ]
    df = spark.createDataFrame(rows, "id int, text string, shown struct<sender:string,is_receipt:boolean>")
    known = F.when(F.col("id") == 4, F.struct(F.lit(100).alias("score"), F.lit(90).alias("floor")))
    link = F.when(F.col("id") == 3, F.struct(F.lit(100).alias("score"), F.lit(True).alias("informative"), F.lit(90).alias("floor")))
    df = df.withColumns({"known": known, "link": link, "p": F.when(F.col("id") == 4, 0.99).otherwise(0.1), "near": F.struct(F.lit(0.8).alias("scam"), F.lit(0.3).alias("genuine"), F.lit("task_job").alias("category"))})
    plain = {r["id"]: r["risk_score"] for r in scoring.analyzed(df.select("id", "text")).select("id", "risk_score").collect()}
    with_sender = {r["id"]: r["risk_score"] for r in scoring.analyzed(df, sender="shown").select("id", "risk_score").collect()}
    with_all = {r["id"]: (r["risk_score"], r["verdict"]) for r in scoring.analyzed(df, classifier="p", reputation="known", patterns="near", links="link", sender="shown").select("id", "risk_score", "verdict").collect()}
    assert with_sender[1] >= 50 > plain[1] and with_sender[2] >= 75
    assert with_all[3] == (90, "scam") or with_all[3][0] >= 90
    assert with_all[4][0] >= 90 and plain[4] == 0


def test_patterns_need_length_and_cannot_decide(spark):
    near = lambda s, g: F.struct(F.lit(s).alias("scam"), F.lit(g).alias("genuine"), F.lit("x").alias("category"))
    row = spark.range(1).select(*[scoring.pattern_signal(near(s, g), F.lit(w)).alias(n) for n, s, g, w in (("counts", 0.8, 0.6, 12), ("short", 0.8, 0.6, 11), ("close", 0.8, 0.77, 20), ("far", 0.3, 0.0, 20))]).first()
    assert [row[n]["informative"] for n in ("counts", "short", "close", "far")] == [True, False, False, False]
    assert row["counts"]["score"] == 100 and not row["counts"]["can_decide_scam"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ("win a free prize now" if i % 3 == 0 else "your loan is approved pay a fee" if i % 3 == 1 else "meeting moved to noon") + f" w{i % 4}", "abc"[i % 3]) for i in range(60)] + [(60, "", "a"), (61, None, "b")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    return df, classifier.trained(df, "id", most={"char": 200, "word": 50}, iterations=30)


def plain_probabilities(m, grams):
    z, at = list(m["intercept"]), 0
    for b in m["blocks"]:
        tf = {t: grams[b["analyzer"]].count(t) for t in set(grams[b["analyzer"]]) if t in b["terms"]}
        v = {t: (1 + math.log(n)) * b["idf"][b["terms"].index(t)] for t, n in tf.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        for c in range(len(z)):
            z[c] += sum(m["coef"][c][at + b["terms"].index(t)] * x / size for t, x in v.items())
        at += len(b["terms"])
    e = [math.exp(x / m["temperature"]) for x in z]
    return [x / sum(e) for x in e]


def test_classifier_learns_and_agrees_with_plain_python(spark, model):
    df, m = model
    assert m["classes"] == ["a", "b", "c"] and all(len(b["terms"]) <= classifier.MOST_TERMS[b["analyzer"]] for b in m["blocks"])
    masked = F.col("masked")
    got = classifier.predicted(df, m).withColumn("masked", E.preprocessed("text")).withColumns({k: c for k, c in classifier.ngrams(masked).items()}).collect()
    assert sum(r["predicted"] == r["label"] for r in got) >= 60
    for r in got[::7]:
        want = plain_probabilities(m, {"char": r["char"] or [], "word": r["word"] or []})
        assert [r["probabilities"][c] for c in m["classes"]] == pytest.approx(want, abs=1e-9)


def test_classifier_file_and_shapes(spark, model, tmp_path):
    _, m = model
    classifier.saved(spark, m, f"file://{tmp_path}/model")
    assert classifier.loaded(spark, f"file://{tmp_path}/model") == m
    for broken in ({**m, "version": 9}, {**m, "coef": m["coef"][:1]}, {**m, "blocks": [{**m["blocks"][0], "analyzer": "odd"}]}):
        with pytest.raises(classifier.ModelError):
            classifier.validated(broken)


def test_calibration_takes_the_best_of_the_grid(model):
    df, m = model
    t = classifier.calibrated(m, df.where("id < 60"))["temperature"]
    assert 0.2 <= t <= 1.0  # the model is right everywhere, so sharper is better
    assert classifier.top_ngrams(m, 5)[0][0] == "a" and len(classifier.top_ngrams(m, 5)) == 15


def test_advisories_count_by_half(spark):
    texts = {"SBI never asks for your OTP. Beware of such calls": True, "Never share your OTP, pay a fee now": False, "Beware, call 9876543210": False, "lunch at one": False}
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("e", E.entities("text"))
    got = {r["text"]: (r["cue"] is not None, r["o"]["factor"], r["o"]["informative"]) for r in df.select("text", classifier.advisory(F.col("e")).alias("cue"), classifier.signal(F.lit(0.95), F.col("e")).alias("o")).collect()}
    assert got == {t: (w, 0.5 if w else 1.0, True) for t, w in texts.items()}


def test_close_to_any_against_all_pairs(spark):
    sets = [[f"t{(i * j) % 17}" for j in range(1, 2 + i % 9)] for i in range(80)] + [[], ["only"]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, tokens array<string>")
    got = {r["id"] for r in similarity.close_to_any(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.6).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    assert got == {i for i in range(0, 82, 2) if any(like(set(sets[i]), set(sets[j])) >= 0.6 for j in range(1, 82, 2))}


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_blocks_lose_no_pair_and_give_few_others(spark, least):
    """Sets that share many words and aren't close make no pairs; codes that fall together lose none."""
    rng = random.Random(5)
    sets = [sorted({f"w{rng.randrange(40 if i % 3 else 400)}" for _ in range(rng.randrange(1, 40))}) for i in range(300)]
    sets += [[*s[2:], "new"] for s in sets[:40]]
    like = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    want = {(i, j) for i in range(340) for j in range(0, 340, 4) if i % 4 and like(i, j) >= least}
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, tokens array<string>")
    hashed = rows.select(F.when(F.col("id") % 4 == 0, "h").otherwise("c").alias("side"), F.col("id").cast("long").alias("class"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    found = lambda df, most: {(r["a"], r["b"]) for r in blocks.close(journal.written(blocks.packed(df, most), "blocks"), "c", "h", least).collect()}
    assert found(hashed, 1 << 16) == found(hashed, 0) == want != set()
    low = F.transform("hashes", lambda h: F.shiftleft(F.shiftright(h, 30), 30) + F.pmod(h, F.lit(150)))  # 150 codes for all words
    assert found(hashed.withColumn("hashes", low), 0) >= want
    got = similarity.close_to_any(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), least)
    assert {r["id"] for r in got.collect()} == {i for i, _ in want}


def test_near_pairs_against_all_pairs(spark):
    """Rarest tokens don't depend on which ones are broadcast; pairs are those that share one and are close, long sets and those of common tokens alone among them."""
    rng = random.Random(7)
    sets = [sorted({f"w{rng.randrange(30 if i % 5 == 0 else 3000)}" for _ in range(rng.choice([1, 2, 5, 60, 900]))}) for i in range(120)]
    sets += [sorted({*s[len(s) // 9 :], "new"}) for s in sets[:60]] + [[]]
    df = Counter(t for s in sets for t in s)
    rare = [{t for _, t in sorted((df[t], t) for t in s)[:3]} for s in sets]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    for most in (0, 10, 1 << 17):
        got = similarity.rare_tokens(rows, most=most).collect()
        assert Counter((r["id"], r["token"]) for r in got) == Counter((i, t) for i, s in enumerate(rare) for t in s)
    like = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    want = {(i, j): like(i, j) for i in range(180) for j in range(i + 1, 180) if rare[i] & rare[j] and like(i, j) >= 0.7}
    assert want and {(r["a"], r["b"]): r["similarity"] for r in similarity.near_pairs(rows, 0.7).collect()} == want


def test_interleaving_and_empty_tables(spark):
    place = lambda n: spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("place"))
    order = lambda a, b: "".join(r["kind"][0] for r in splits.interleaved(place(a), place(b)).orderBy("position").collect())
    assert order(5, 1) == "vvhvvv" and order(5, 4) == "vvhvvhvhh" and order(0, 2) == "hh" and order(3, 0) == "vvv"


def test_reports_without_rows(spark):
    none = spark.createDataFrame([], "id int, truth boolean, flagged boolean, score int, label string, label_source string, verdict string")
    assert reports.negative_rates(none).count() == 0 and reports.mistakes(none).count() == 0
    assert reports.sweep(none, [10], {"s": "score"}).first()["recall"] is None


def test_grid_chooses_by_macro_f1(spark):
    from verdigris.operators import splits

    rows = [(i, ("alpha beta common" if i % 3 else "gamma delta common") + (f" noise{i % 7}"), "a" if i % 3 else "b", f"g{i // 2}", i % 5 == 0, "val" if i % 4 == 0 else "train") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, text string, label string, group_id string, is_indian boolean, part string")
    weighted = splits.sample_weights(df.where("part = 'train'"), cap=1.0).unionByName(df.where("part = 'val'").withColumn("weight", F.lit(1.0)))
    m, tried = classifier.selected(weighted, "id", "part", grid=(8.0, 0.01, 1.0, 4.0), patience=2, weight="weight", most={"word": 50}, iterations=30)
    assert [c for c, _ in tried] == [0.01, 1.0, 4.0, 8.0][: len(tried)] and all(0 <= s <= 1 for _, s in tried) and max(s for _, s in tried) == 1.0
    first = [s for _, s in tried].index(1.0)
    assert len(tried) <= first + 3  # two more without a better one end the grid
    got = classifier.predicted(df.where("part = 'val'"), m)
    assert got.where("label <> predicted").count() == 0
    # words of the rows kept back alone are not in the vocabulary
    only = weighted.withColumn("text", F.when(F.col("part") == "val", F.concat("text", F.lit(" unseen"))).otherwise(F.col("text")))
    made = classifier.vectors(only, "id", weight="weight", part="part", most={"word": 50})
    assert "unseen" not in {r["term"] for r in made.found} and made.n == 60 and made.data.count() == 80
    assert classifier.macro_f1_of({("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2, ("b", "c"): 2}) == pytest.approx((6 / 7 + 4 / 7 + 0) / 3) and classifier.macro_f1_of({}) == 0


JOINS = ["g", "./g", "g/", "/g", "//h/p", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "http://x.y/a/../b", "mailto:a@b"]


def test_relative_locations(spark):
    from urllib.parse import urljoin

    from verdigris.functions import urls

    bases = ["http://a/b/c/d?q=1", "https://a.example", "http://a.example/?x=/y/z"]
    rows = [(b, r) for b in bases for r in JOINS]
    got = {(r["b"], r["r"]): r["j"] for r in spark.createDataFrame(rows, "b string, r string").withColumn("j", urls.joined(F.col("b"), F.col("r"))).collect()}
    for (b, r), j in got.items():
        want = urljoin(b, r)
        assert j == want or (r == "" and j == b) or (b == "https://a.example" and r in (".", "./", "..", "../", "../..") and j == "https://a.example/"), (b, r, j, want)


def test_chains_stop_at_private_links(spark):
    from verdigris.operators import state

    hops = [("http://a.in/1", 301, " ../2 "), ("http://a.in/2", 302, "//b.in/x"), ("http://b.in/x", 307, "http://192.168.1.9/"), ("http://192.168.1.9/", 301, "http://c.in/"), ("http://d.in/", 404, None), ("http://d.in/", 404, "http://e.in/"), ("http://f.in/", 300, "http://e.in/"), ("http://h.in/", 301, "http://inner.in/"), ("http://inner.in/", 301, "http://e.in/")]
    hops += [(f"http://l.in/{i}", 301, f"/{(i + 1) % 3}") for i in range(3)] + [("http://a.in/1", 301, " ../2 ")]
    table = spark.createDataFrame(hops, "url string, status int, location string")
    starts = spark.createDataFrame([(u,) for u in ("http://a.in/1", "http://d.in/", "http://f.in/", "http://h.in/", "http://l.in/0", "http://localhost/", "ftp://a.in/", "http://[::1]/", "http://unknown.in/")], "url string")
    hosts = spark.createDataFrame([("inner.in", False), ("inner.in", False), ("a.in", True)], "host string, public boolean")
    got = {r["url"]: tuple(r)[1:] for r in state.redirect_chain(starts, table, 5, hosts).collect()}
    assert got == {
        "http://a.in/1": ("http://192.168.1.9/", 3, None), "http://d.in/": ("http://d.in/", 0, 404), "http://f.in/": ("http://f.in/", 0, 300), "http://h.in/": ("http://inner.in/", 1, None), "http://l.in/0": ("http://l.in/2", 5, None),
        "http://localhost/": ("http://localhost/", 0, None), "ftp://a.in/": ("ftp://a.in/", 0, None), "http://[::1]/": ("http://[::1]/", 0, None), "http://unknown.in/": ("http://unknown.in/", 0, None),
    }
    twice = table.unionByName(spark.createDataFrame([("http://bit.ly/q", 301, "http://e.in/"), ("http://bit.ly/q", 302, "http://g.in/")], table.schema))
    links_ = spark.createDataFrame([("http://bit.ly/q",)], "url string")
    empty = spark.createDataFrame([], "domain string, registered date"), spark.createDataFrame([], "url string, threats array<string>")
    assert [(r["url"], r["final"]) for r in links.checked(links_, twice, *empty, F.lit("2024-01-01").cast("date")).collect()] == [("http://bit.ly/q", "http://e.in/")]


def test_network_file(spark, tmp_path):
    from verdigris.sources import tables

    (tmp_path / "n.json").write_text('{"domains": {"New.in": {"age_days": 3}, "old.com": {"registered": "1999-05-06"}, "none.io": {"rdap": false}}, "redirects": {"bit.ly/a": "https://new.in/x", "bit.ly/gone": 404}}')
    domains, redirects = tables.read_network(spark, str(tmp_path / "n.json"), "2024-03-02")
    assert {(r[0], str(r[1])) for r in domains.collect()} == {("new.in", "2024-02-28"), ("old.com", "1999-05-06")}
    assert {tuple(r) for r in redirects.collect()} == {(f"{s}://bit.ly/a", 301, "https://new.in/x") for s in ("http", "https")} | {(f"{s}://bit.ly/gone", 404, None) for s in ("http", "https")}
