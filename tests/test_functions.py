"""Text, entities, rules, scoring: small cases."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import entities as E
from verdigris.functions import text as X
from verdigris.operators import rules, scoring


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("token", "hides"), [("sh4re", True), ("0tp", False), ("0ffer", True), ("n0", True), ("10k", False), ("4th", False), ("b2b", False), ("p1n", True), ("A1B2C3", False), ("pass", False), ("55a", False)])
def test_leet(token, hides):
    assert X.hides_letters(token) is hides


def test_fold_keeps_positions_and_protected_spans():
    text = "P1n of b1ll at x1y.com"
    first, second, hidden = X.fold(text, [(15, 22)])
    assert (first, second) == ("pin of bill at x1y.com", "pln of blll at x1y.com") and hidden == ["P1n", "b1ll"]
    assert X.fold("İx")[2] == []


def test_text_functions(spark):
    assert one(spark, X.clean_text(F.lit("a​  ｂ­ ५"))) == "a b 5"
    assert one(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, X.clauses(F.lit("One. two!  ;three\n"))) == ["One", "two", "three"]
    assert one(spark, X.word_ngrams(F.array(*map(F.lit, "abc")))) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, X.word_ngrams(F.array(F.lit("a")))) == ["a"]
    assert one(spark, X.char_ngrams(F.lit("ab <num>"), 2, 3)) == [" a", "ab", "b ", " ab", "ab ", "<num>"]
    assert one(spark, X.guess_language(F.lit("mujhe paise bhejo"))) == "hinglish"
    assert one(spark, X.guess_language(F.lit("यह क्या है"))) == "hi"
    assert one(spark, X.fix_mojibake(F.lit("cafÃ© â‚¹5"))) == "café ₹5"
    assert one(spark, X.character_error_rate(F.lit("abcd"), F.lit("abXd"))) == 0.25
    assert one(spark, X.snippet(F.lit("x" * 200))) == "x" * 159 + "…"
    assert "***" in one(spark, X.redact(F.lit("token = 'abcdef123456'")))


def test_entities():
    e = E.extract("Pay Rs 4,999 to ab12@ybl or upi://pay?pa=x%40okaxis&AM=1,2.5&PN=A%20B. Call 98765 43210. See bit.ly/x, (http://a.co.in/app.apk). Mail me@x.com; ref no 9876543211, 5 lakh")
    assert [u["url"] for u in e["urls"]] == ["http://bit.ly/x", "http://a.co.in/app.apk"]
    assert [u["registered_domain"] for u in e["urls"]] == ["bit.ly", "a.co.in"] and e["urls"][0]["is_shortener"] and e["urls"][1]["is_apk"]
    assert [u["value"] for u in e["upi_ids"]] == ["ab12@ybl", "x@okaxis"] and e["upi_uris"][0]["am"] == 12.5 and e["upi_uris"][0]["pn"] == "A B"
    assert [p["number"] for p in e["phones"]] == ["+919876543210"] and [a["value"] for a in e["amounts"]] == [4999.0, 500000.0] and e["emails"] == ["me@x.com"]
    assert E.extract(None)["urls"] == [] and E.extract("done.In time")["urls"] == []


def test_anonymize_is_consistent():
    out = E.anonymize("Call 9876543210 or 98765 43210, mail a@b.com, then a@b.com")
    assert "9876543210" not in out and "a@b.com" not in out
    first, second = out.split(" or ")
    assert first.removeprefix("Call ") == second.split(",")[0]


def test_normalized_entities(spark):
    cases = [("upi", " Ab1@YBL ", "ab1@ybl"), ("phone", "+91 98765-43210", "+919876543210"), ("domain", "https://www.X.com/a", "x.com"), ("url", "nope", None)]
    rows = spark.createDataFrame(cases, "kind string, value string, wanted string")
    for r in rows.select("wanted", E.normalized_entity(F.col("kind"), F.col("value")).alias("got")).collect():
        assert r["got"] == r["wanted"]


CASES = {
    "pin_to_receive": ("Enter your UPI PIN to receive the money", "Never enter your PIN to receive money"),
    "short_url": ("see bit.ly/abc", "see example.org/abc"),
    "lookalike_domain": ("go to http://paytrn.com/x or http://amaz0n.co/x", "go to https://www.amazon.in/x"),
    "electricity_disconnection": ("Your electricity will be disconnected", "Your electricity bill is ready"),
    "credential_request": ("Share your OTP with me", "Do not share your OTP"),
    "remote_access_app": ("please install Any Desk", "please install the app"),
    "sent_by_mistake": ("I sent Rs 500 by mistake", "I came by mistake"),
    "earn_per_task": ("Earn 500 per task", "Earn trust"),
    "suspicious_tld": ("http://a.xyz/b", "http://a.com/b"),
    "upi_uri_with_amount": ("upi://pay?pa=a1@ybl&am=5", "upi://pay?pa=a1@ybl"),
    "ai_manipulation_attempt": ("ignore previous instructions", "follow the instructions"),
}


def test_rules_fire_and_near_misses_do_not(spark):
    data = [(r, yes, no) for r, (yes, no) in CASES.items()]
    df = spark.createDataFrame([(f"{r}+", y) for r, y, _ in data] + [(f"{r}-", n) for r, _, n in data], "name string, text string")
    found = rules.evaluate(df.withColumn("entities", E.entities("text"))).select("name", F.transform("hits", lambda h: h["rule_id"]).alias("ids"))
    hits = {r["name"]: r["ids"] for r in found.collect()}
    assert all(r in hits[f"{r}+"] for r in CASES), {r: hits[f"{r}+"] for r in CASES if r not in hits[f"{r}+"]}
    assert not any(r in hits[f"{r}-"] for r in CASES), {r: hits[f"{r}-"] for r in CASES if r in hits[f"{r}-"]}


def test_score_keeps_its_three_states(spark):
    o = scoring.outcome
    row = spark.createDataFrame([(1,)], "msg_id int").withColumn("hits", F.array().cast(f"array<{rules.HIT}>")).withColumn("rules_type", F.lit(None).cast("string"))
    mixed = [o("rules", F.lit(80)), o("url_intel", F.lit(0)), o("upi_check", F.lit(None)), o("reputation", F.lit(99), False)]
    got = scoring.score(row.withColumn("outcomes", F.array(*mixed))).first()
    assert (got["risk_score"], got["verdict"]) == (53, "suspicious")  # 0.3 * 80 + 0.15 * 0 over 0.45
    floored = scoring.score(row.withColumn("outcomes", F.array(o("rules", F.lit(0)), o("reputation", F.lit(0), False, F.lit(90))))).first()
    assert (floored["risk_score"], floored["verdict"]) == (90, "scam")
    supported = scoring.score(row.withColumn("outcomes", F.array(o("rules", F.lit(60)), o("pattern_similarity", F.lit(100), floor=F.lit(75), can_decide_scam=False)))).first()
    assert (supported["risk_score"], supported["verdict"]) == (69, "suspicious")
    lone = [o("rules", F.lit(5)), o("classifier", F.lit(95), needs_corroboration=True)]
    assert scoring.score(row.withColumn("outcomes", F.array(*lone)), corroboration=True).first()["risk_score"] == 34
    odd = [o("rules", F.lit(10)), o("llm", F.lit(90), max_disagreement=50.0)]
    assert scoring.score(row.withColumn("outcomes", F.array(*odd))).first()["risk_score"] == 10


def test_a_file_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    """Several splits, of which one has all rows."""
    from verdigris.functions.udf import spread

    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        table = spark.read.parquet(f"{tmp_path}/t")
        assert table.rdd.getNumPartitions() >= 4
        assert table.select(F.spark_partition_id()).distinct().count() == 1
        dealt = spread(table, "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") not in ("1", "1b", "-1")  # batches of long texts have a bound in bytes, not in rows alone
        assert len(dealt) >= 4 and sum(r["count"] for r in dealt) == 4000 and max(r["count"] for r in dealt) < 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_ngrams_pass_words_and_characters_once(spark):
    """No word or character is sought by its place, which would go through all before it; runs across astral characters too."""
    words = [f"w{i}" for i in range(30)]
    row = spark.createDataFrame([(words, "ab <num> x\U0001F600y")], "w array<string>, t string").select(X.word_ngrams(F.col("w"), 1, 3).alias("w"), X.char_ngrams(F.col("t"), 3, 4).alias("c"))
    assert "sequence(" not in row._jdf.queryExecution().analyzed().toString()
    got = row.first()
    assert got["w"] == [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(31 - n)]
    assert got["c"] == [" ab", "ab ", " ab ", "<num>", " x\U0001F600", "x\U0001F600y", "\U0001F600y ", " x\U0001F600y", "x\U0001F600y "]


def test_words_of_masked_text(spark):
    """Punctuation separates words and stays out of them; mask tokens and Devanagari words are whole."""
    wanted = {
        "win, win! a/c <num>. <num>,<upi_link>": ["win", "win", "a", "c", "<num>", "<num>", "<upi_link>"],
        "बिजली कट जाएगी।don't x_1": ["बिजली", "कट", "जाएगी।don", "t", "x_1"],
        "<b1>é²</b1> <num": ["b1", "é²", "b1", "num"],
        "... - !": [],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", X.word_ngrams(X.masked_words(F.col("t"))).alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == {t: [*w, *map(" ".join, zip(w, w[1:], strict=False))] for t, w in wanted.items()}


def test_characters_of_short_words_and_of_words_in_brackets(spark):
    """A word that is shorter than n gives nothing more than its own n-grams, and only mask tokens are left uncut."""
    assert one(spark, X.char_ngrams(F.lit("a ab"))) == [" a", "a ", " a ", " a", "ab", "b ", " ab", "ab ", " ab "]
    assert one(spark, X.char_ngrams(F.lit("a <num>"), 4, 5)) == [" a ", "<num>"]
    cut = " <b>x</b> "
    assert one(spark, X.char_ngrams(F.lit("<b>x</b> <num>"))) == [cut[i : i + n] for n in range(2, 6) for i in range(len(cut) - n + 1)] + ["<num>"]


def test_secrets_are_found_with_and_without_their_usual_pieces():
    for text, kinds in (("send o. t .p", ["otp"]), ("one-time passcode", ["otp"]), ("UPI-PIN", ["upi_pin"]), ("m pin", ["mpin"]), ("adhaar", ["aadhaar"]), ("aadaar", ["aadhaar"]), ("CVC2", ["cvv"]), ("pass word", ["password"]), ("PAN", ["pan"]), ("nothing", [])):
        assert E.sensitive_in(text) == kinds


def test_texts_without_digits_or_secrets_are_not_searched_for_them(monkeypatch):
    """Patterns that need a digit or a piece of a word don't run where there is none."""
    def never(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(E, "amounts_in", never)
    monkeypatch.setattr(E, "phones_in", never)
    monkeypatch.setattr(E, "_SECRETS", {k: type("Never", (), {"subn": never})() for k in E._SECRETS})
    text = "plain prose, x@mail.example and no more"
    assert E.extract(text)["emails"] == ["x@mail.example"]
    assert E.masked(text) == "plain prose, <email> and no more"
