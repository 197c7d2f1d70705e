"""Every operator against a brute-force version on a small table that holds nulls, empty and long texts, copies, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("verdigris.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from verdigris.llm import bpe, fingerprint, lm, media, mixing, neardup, quality, range_coder, suffix_dedup, token_files, toxicity  # noqa: E402
from verdigris.llm.common import Remembered, batches, given_back, held_out  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(5)
    syllables = "tion ing er the an re on at en nd ti es or te of ed is it al ar".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(150)
    texts = [text(rng.randint(1, 200)) for _ in range(40)]
    base = text(120).split()
    for i in range(12):  # near copies
        copy = list(base)
        for _ in range(1 + i % 3):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [texts[3]] * 4 + [text(5) + " " + shared + " " + text(7), shared, text(3) + shared]  # copies, a shared passage
    texts += [None, "", "   ", "one", "One", "Straße é É ﬁ  ＡＢ", "ab" * 3000, ("word " * 900).strip(), "x" * 5000, "ΑΣ don't <|endoftext|> 12!! ₟ 😀", "a\x1cb\x85c"]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(0, 60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def windows(texts, length):
    seen = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    return seen


def removed(texts, length):
    """For each text its repeated stretches, by counting all windows."""
    seen = windows(texts, length)
    for t in texts:
        b = (t or "").encode()
        yield suffix_dedup.union_of([(p, p + length) for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1])


@pytest.mark.parametrize(("lengths", "most"), [((400,), 8192), ((100, 160), 8192), ((100, 160), 1), ((250, 400), 1)])
def test_suffix_dedup(docs, monkeypatch, lengths, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got, texts = table(suffix_dedup.judged(docs, lengths)), [r[1] for r in rows()]
    for (i, t, *_), short, long in zip(rows(), removed(texts, lengths[0]), removed(texts, lengths[-1]), strict=True):
        b = (t or "").encode()
        left, at = b"", 0
        for a, e in long:
            left, at = left + b[at:a], e
        left += b[at:]
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), len(b) - len(left), len(long), hashlib.sha256(left).hexdigest())
        assert r["n_passage"] == sum(e - a for a, e in short)


def test_suffix_dedup_over_pieces(spark, monkeypatch):
    """Texts longer than a piece of anchoring: strings that lie across its border."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = [noise(n) for n in (399, 400, 700)]
    texts = [noise(3800) + shared[0] + noise(3300) + shared[2] + noise(900), noise(7900) + shared[1] + noise(4000), noise(90) + shared[1] + noise(8000) + shared[2], shared[0] + noise(20_000)]
    got = table(suffix_dedup.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(4)] == [sum(b - a for a, b in s) for s in removed(texts, 400)] == [700, 400, 1100, 0]


def test_suffix_dedup_stage(spark, docs):
    data, texts = rows(), [r[1] for r in rows()]
    out = table(suffix_dedup.without_repeats(docs))
    assert len(out) == len(data) and suffix_dedup.without_repeats(docs).columns == docs.columns
    for (i, t, *_), spans in zip(data, removed(texts, 400), strict=True):
        b, left, at = (t or "").encode(), b"", 0
        for a, e in spans:
            left, at = left + b[at:a], e
        assert (out[i]["text"] or "") == (left + b[at:]).decode("utf-8", "ignore")
    clash = docs.select("doc_id", "text", F.lit(7).alias("left"), F.lit(8).alias("n_removed"), F.lit(9).alias("tid"), F.lit("x").alias("kept_bytes"))
    again = table(suffix_dedup.without_repeats(clash))
    assert {i: r["text"] for i, r in again.items()} == {i: r["text"] for i, r in out.items()} and {(r["left"], r["n_removed"], r["tid"], r["kept_bytes"]) for r in again.values()} == {(7, 8, 9, "x")}


def test_fingerprints(docs):
    got, data = table(fingerprint.fingerprints(docs)), rows()
    for k, (i, t, *_) in enumerate(data):
        t, following = t or "", data[(k + 1) % len(data)][1] or ""
        n = len(t) // 2
        other = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert r["near_edited"] == float(fingerprint.canonical(t) == fingerprint.canonical(other))
        assert r["near_next"] == float(fingerprint.canonical(t) == fingerprint.canonical(following))
    assert got[62]["fingerprint"] == got[63]["fingerprint"] != got[5]["fingerprint"]  # 'one' and 'One'


def test_fingerprint_collisions_are_settled(docs, monkeypatch):
    found = fingerprint.compared(docs).withColumn("fingerprint", F.when(F.col("doc_id") < 2, "same").otherwise(F.col("fingerprint")))
    assert fingerprint.collisions(docs, found).count() == 0  # buckets are judged by the canonical bytes themselves


def test_forced_fingerprint_collisions_are_settled(docs):
    """With one hex digit most buckets hold different texts: their fingerprints are lengthened until equal ones are equal texts."""
    got, data = table(fingerprint.fingerprints(docs, digits=1)), rows()
    same = collections.defaultdict(set)
    for i, t, *_ in data:
        same[got[i]["fingerprint"]].add(fingerprint.canonical(t))
    assert all(len(texts) == 1 for texts in same.values()) and len(same) == len({fingerprint.canonical(r[1]) for r in data})


def shingles(t, k):
    w = WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    got = table(neardup.classes(docs, k, 80))
    sets = {r[0]: shingles(r[1], k) for r in rows()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i, s in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i)
    kept = {r["doc_id"] for r in neardup.deduplicated(docs, k, 80).collect()}
    assert kept == {i for i in sets if find(i) == i}


def test_signature_estimate_rarely_fails_a_true_pair():
    n, p = neardup.WIDTH, 0.8
    assert sum(math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(neardup.LEAST_MATCHES)) < 1e-6
    # a pair shares a table if it shares a collection of either side
    shared = [1 - (1 - p**each) ** groups for groups, each in neardup.SIDES]
    assert 1 - shared[0] * shared[1] < 2e-5


def test_near_duplicates_in_long_runs_are_settled_by_prefixes(spark, monkeypatch):
    """A cloud of texts around one base, likenesses on both sides of the threshold: no link may be lost when all runs count as long, nor with the first round alone."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        t = list(base)
        for _ in range(i % 9):
            t[rng.randrange(60)] = f"x{rng.randrange(400)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = table(neardup.classes(df, 2, 80))
    monkeypatch.setattr(neardup, "SMALL", 1)
    assert {i: r["component_id"] for i, r in table(neardup.classes(df, 2, 80)).items()} == {i: r["component_id"] for i, r in whole.items()}
    sets = [shingles(t, 2) for t in texts]
    root = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert [whole[i]["component_id"] for i in range(150)] == root and 1 < len(set(root)) < 150


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_shingles_of_a_single_short_text(n):
    import pyarrow as pa

    assert [len(s) for s in neardup.shingle_sets(pa.array([" ".join("abcde"[:n])]), 5)] == [1]


def test_groups_that_still_change_are_an_error(spark):
    from verdigris.llm.components import components
    from verdigris.operators import similarity

    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, 1)
    with pytest.raises(RuntimeError):
        similarity.groups(chain.toDF("a", "b"), 1)


def test_near_duplicates_in_long_runs(spark, monkeypatch):
    """A group whose members are linked to a centre and not to one another, over the size of a run that is expanded."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(60):
        copy = list(base)
        for p in rng.sample(range(0, 100, 3), 4):
            copy[p] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in neardup.classes(df, 2, 80).collect()} == {0}


def test_media(docs):
    got = table(media.document_media(docs))
    for i, t, *_ in rows():
        b = (t or "").encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.pack(b)).hexdigest() and r["media_bytes"] == len(media.pack(b))


def test_media_sequences(spark):
    page = "<html><head><title>no</title></head><body><p>First</p><figure><img src='media:sha256:aa'><figcaption>A &amp; B</figcaption></figure><p>Then<script>x</script></p><img src='media:sha256:zz' alt='alone'>end"
    items = media.parse(page)
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "First", None, None), (1, "media", None, "aa", "A & B"), (2, "text", "Then", None, None), (3, "media", None, "zz", "alone"), (4, "text", "end", None, None)]
    df = media.sequences(spark.createDataFrame([(1, page, "old"), (2, None, "old")], "page_id long, html string, items string"))
    assert {r["page_id"]: len(r["items"]) for r in df.collect()} == {1: 5, 2: 0}
    with pytest.raises(ValueError):
        media.unpack(b"RIFFxxxxNOPE")


BROKEN = {
    "<html><head><title>no</title><p>kept": ["kept"],
    "<head>words before any tag": ["words before any tag"],
    "<script/>after<p>more": ["after", "more"],
    "<script>var a='</p>'</script>left": ["left"],
    "<style>p{}</style><template><p>hidden</p></template>shown": ["shown"],
    "<figure><img src=x><figcaption>said": [("x", "said")],
    "<figure><figcaption>alone</figcaption></figure>rest": ["alone", "rest"],
    "<figure><img src=x><figcaption>one<figure><img src=y><figcaption>two</figcaption></figure>": [("x", "one"), ("y", "two")],
    "a<noscript><b>b</noscript>c": ["ac"],
    "<p>a<p>b</p></div></p>c</head>d": ["a", "b", "cd"],
    "<img src=x alt=q>text<!-- gone --> &lt;b&gt;": [("x", "q"), "text <b>"],
    "plain": ["plain"],
    "": [],
    " \n ": [],
}


@pytest.mark.parametrize("page", BROKEN)
def test_pages_lose_no_text(page):
    assert [x["text"] if x["kind"] == "text" else (x["digest"], x["caption"]) for x in media.parse(page)] == BROKEN[page]


def test_interleaved_media(spark):
    a, b = (hashlib.sha256(media.pack(t.encode())).hexdigest() for t in ("one", "two"))
    ref = lambda d, c: f"<figure><img src='media:sha256:{d}'><figcaption>{c}</figcaption></figure>"
    pages = [(1, f"first{ref(a, 'A')}then{ref('0' * 64, 'gone')}{ref(b, 'B')}last{ref(a, 'again')}"), (2, None), (2, "only text"), (None, ref(b, "x")), (3, "")] + [(10 + i, ref(a, str(i))) for i in range(40)]
    stored = media.described(media.store(spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "text string")))
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({"digest": F.lit("d"), "items": F.lit(1), "media": F.lit(2)})
    got = collections.defaultdict(list)
    for r in media.interleaved(df, stored).collect():
        got[r["page_id"]].append([x["text"] if x["kind"] == "text" else (x["caption"], x["media"] and x["media"]["payload_bytes"], x["media"] and x["media"]["media_sha256"] == x["digest"]) for x in r["items"]])
    assert got[1] == [["first", ("A", 64, True), "then", ("gone", None, None), ("B", 64, True), "last", ("again", 64, True)]]
    assert sorted(map(len, got[2])) == [0, 1] and got[3] == [[]] and got[None] == [[("x", 64, True)]] and all(got[10 + i] == [[(str(i), 64, True)]] for i in range(40))
    assert media.interleaved(df.where("false"), stored).count() == 0


def test_page_sequences_query(spark, tmp_path):
    from verdigris.llm import queries

    rows = [(i, None if i == 3 else f"http://x/{i}", None if i == 4 else f"<head><title>t</title><body><p>one {i}<p>two<br>three</p>") for i in range(8)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = table(queries.page_sequences(spark, str(tmp_path)), "page_id")
    for i, _, page in rows:
        texts = [f"one {i}", "two", "three"] if page else []
        assert tuple(got[i][c] for c in ("n_items", "texts_sha256", "n_resolved", "caption", "position", "payload_bytes")) == (len(texts) + 2, hashlib.sha256("\n".join(texts).encode()).hexdigest(), 1, str(i), len(texts) + 1, 64)


def plain_score(text, learned, stems):
    """The grammar's score without machines: every word of a clause looks at the words before and behind it."""
    pairs, found = set(), toxicity.Lexicon(stems)
    for clause in re.split(r"[.!?;\n]+", text or ""):
        words = " ".join(re.findall(r"[\w'’]+", clause.lower()))
        for phrase in toxicity.INSULT_PHRASES + toxicity.THREAT_PHRASES:
            words = re.sub(rf"(?<!\S){phrase}(?!\S)", phrase.replace(" ", "~"), words)
        looked = [(found.paths[p], p) if "~" in w else found.look(w) for w in words.split() for p in [w.replace("~", " ")]]
        kinds = [k for k, _ in looked]
        for i, (k, lexeme) in enumerate(looked):
            run = i - next(j for j in range(i, -2, -1) if j < 0 or kinds[j] != "I") if k == "I" else 1
            if k not in "IT" or (k == "I" and run > 1):
                continue
            near = kinds[max(0, i - toxicity.REACH) : i]
            arcs = ["insult"] if k == "I" else ["threat", "intent"] if "W" in near else ["threat"]
            if "N" in near:
                arcs.append("negated")
            elif "R" in kinds[:i]:
                arcs.append("reported")
            elif "Y" in kinds:
                arcs.append("target")
            pairs.add((lexeme, tuple(arcs)))
    odds = 1.0 - learned_share(learned[""])
    for lexeme, arcs in pairs:
        odds *= 1 - learned_share(max(0, sum(learned[f"arc {a}"] for a in arcs)) + learned.get(f"{lexeme} {'+'.join(arcs)}", 0))
    return 1 - odds


def learned_share(weight):
    return 1 - math.exp(-weight)


def test_toxicity(spark, docs, labels, nothing):
    bad = "You are a worthless idiot."
    df = spark.createDataFrame([(i, f"{r[1] or ''} {bad if i % 9 == 0 else ''}") for i, r in enumerate(rows())], "doc_id long, text string")
    stems = toxicity.induced(df, labels, ~held_out(5))
    found = toxicity.matches(df.withColumn("clauses", F.lit("clash")), stems)
    learned = toxicity.weights(found, labels, ~held_out(5))
    got = table(toxicity.scored(found, learned))
    assert all((r["predicted"] == 1) == (i % 9 == 0) for i, r in got.items())
    kept = {r["doc_id"] for r in toxicity.accepted(df, labels, ~held_out(5)).collect()}
    assert kept == {i for i in got if i % 9}
    assert toxicity.scored(toxicity.matches(nothing), learned).count() == 0 and toxicity.accepted(nothing, labels, ~held_out(5)).count() == 0
    said = lambda t: toxicity.clauses(t, toxicity.Lexicon())
    assert said("He is not an idiot. They said you idiot!") == ["idiot insult+negated", "idiot insult+reported"]
    assert said("idiots, you") == ["idiots insult+target"] and said("Idiots. You") == ["idiots insult"]
    assert said("he said: you idiot") == ["idiot insult+reported"]
    assert said("I will surely kill you. Kill the lights, stupid idiot") == ["kill threat+intent+target", "kill threat", "stupid insult"]
    assert said("such a piece of  garbage, and we will hunt you down") == ["piece of garbage insult", "hunt you down threat+intent"]
    for i, r in got.items():
        assert r["score"] == pytest.approx(plain_score(df.where(F.col("doc_id") == i).first()["text"], learned, stems), abs=1e-9)
    assert toxicity.Lexicon(["lowei"]).look("loweischaft") == ("I", "lowei")
    # the path decides: another weight of an arc is another score, for a lexeme that was never seen too
    for arc, text in (("target", "you moron"), ("negated", "no moron"), ("reported", "she said moron"), ("intent", "we will stab"), ("threat", "stab"), ("insult", "moron")):
        pairs = said(text)
        assert abs(toxicity.total(pairs, learned) - toxicity.total(pairs, {**learned, f"arc {arc}": learned[f"arc {arc}"] + 1})) > 1e-3
    plain = toxicity.total(said("moron"), learned)
    assert toxicity.total(said("no moron"), learned) < plain < toxicity.total(said("you moron"), learned)
    assert toxicity.weights(toxicity.matches(nothing), labels, F.lit(True))["arc insult"] == toxicity.ARCS["insult"]


def test_induction_counts_all_but_copies(spark):
    """Documents that share words, among them the one of least hash, all count; copies of one label count once."""
    import xxhash

    rng = random.Random(9)
    shared = [f"common{i}" for i in range(30)]
    shared.append(min((f"q{i}" for i in range(20_000)), key=xxhash.xxh3_64_intdigest))
    own = lambda: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(30)]
    texts = [" ".join(shared + own() + ["schurke"] * (i < 15)) for i in range(60)]
    texts += [" ".join([*shared, *own(), "kopiert"])] * 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 15 or i >= 60)) for i in range(75)], "doc_id long, toxic int")
    for frame in (df, df.orderBy(F.desc("doc_id")).repartition(5)):
        assert toxicity.induced(frame, marks, F.lit(True)) == ["schurke"]


def test_token_files(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = table(token_files.round_trip(docs)), 0
    for i, t, *_ in rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.round_trip(nothing).count() == 0
    files = token_files.written(token_files.coded(docs), "files").withColumn("file", F.col("_metadata.file_name"))
    order = [(r["file"], r["bucket"], r["block"]) for r in files.collect()]
    assert [b for _, b, _ in sorted(order)] == sorted(b for _, b, _ in order)  # files hold ranges of documents in order
    words = ["of", "\ue000", "a\ue000b", "<|endoftext|>", "naïve", "12!!", "₟", "x" * 700]
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for word, ids in zip(words, [library.encode(w, add_special_tokens=False).ids for w in words], strict=True):
        assert encoder.ids([word])[0].tolist() == ids


def test_encoder_agrees_with_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    signs = [*"aAbBÉéßÿµºª Kk'sStlLrRvVeE.,;:!?)#$%&*\"<|>1２½²\u00d7\u00f7\u0301\u030cJİıΣςœŒ中\x00\x1c\x85\xa0\n\t", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "'re"]
    texts = ["", *("".join(rng.choices(signs[: rng.choice([12, 24, len(signs)])], k=rng.randint(0, 24))) for _ in range(6000)), "x" * 700, "that's thats' 's", "'l" + "'l"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for bits, most in ((20, 1 << 19), (9, 256)):  # a table that is renewed over and over too
        monkeypatch.setattr(token_files.Pieces, "BITS", bits)
        monkeypatch.setattr(token_files.Pieces, "MOST", most)
        encoder = token_files.Encoder(path)
        assert encoder.parted
        got = [x.tolist() for at in range(0, len(texts), 20) for x in encoder.ids(texts[at : at + 20])]
        assert got == want


def test_encoder_asks_for_a_run_of_letters_once():
    encoder, asked = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    library = encoder.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **options)

    encoder.library = Counted()
    for text in ("Thonre thonre, (THONRE)", "thonre. thonre!"):
        encoder.ids([text])
    assert sum("thonre" in w.lower() for w in asked) == 1


def test_remembered_words_are_not_walked_through():
    class Walked(Remembered):
        def __iter__(self):
            raise AssertionError("the whole dictionary was read for a few words")

    known = Walked(3)
    known.update(a=1, b=2)
    assert known.missing({"a", "c"}) == {"c"}
    known["c"] = 3
    assert known.missing({"a", "d", "e"}) == {"d", "e"}  # a new generation; what is asked for comes along
    assert known["a"] == 1 and "b" in known.old


def test_range_coder_compresses_text():
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.concatenate(encoder.ids([r[1] for r in rows()[:52]]))
    blocks = [ids[i : i + range_coder.BLOCK] for i in range(0, len(ids), range_coder.BLOCK)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert sum(map(len, coded)) < 0.8 * 2 * len(ids)  # plain 16-bit ids


def test_range_coder():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint32), np.array([2], np.uint32), np.full(4096, 7, np.uint32), np.arange(4096, dtype=np.uint32), *[(rng.zipf(1.3, n) % 49000).astype(np.uint32) for n in (1, 63, 64, 65, 1000, 4096)]]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert [x.tobytes() for x in range_coder.decode([coded[5]])] == [blocks[5].astype("<u4").tobytes()]  # blocks need no others
    broken = bytearray(coded[8])
    broken[-9] ^= 4
    with pytest.raises(range_coder.DamagedBlock):
        range_coder.decode([bytes(broken)])
    assert range_coder.crc_joined(zlib.crc32(b"abc" * 9), zlib.crc32(b"xy" * 5), 10) == zlib.crc32(b"abc" * 9 + b"xy" * 5)


def shared_out(sizes, most=3):
    """Targets by resharing again and again."""
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    while open_ := [n for n in names if n not in full]:
        left = sum(sizes.values()) - sum(target[n] for n in full)
        for n in open_:
            target[n] = left * weight[n] / sum(weight[m] for m in open_)
        over = [n for n in open_ if target[n] > most * sizes[n]]
        if not over:
            break
        for n in over:
            target[n] = most * sizes[n]
        full.update(over)
    return target


def test_mixing(docs, nothing):
    got = table(mixing.mix(docs.withColumn("copies", F.lit("clash"))))
    sizes = collections.Counter()
    for _, t, _, s, _ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    target = shared_out(dict(sizes))
    taken = collections.Counter()
    for i, t, _, s, _ in rows():
        r = got[i]
        assert r["size"] == len(WORD.findall(t or "")) and r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    longest = max(len(WORD.findall(t or "")) for _, t, *_ in rows())
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in sizes)
    assert mixing.mix_rows(docs).count() == sum(r["copies"] for r in got.values()) and mixing.mix_rows(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 3}, {None: 7, "z": 1, "a": 500, "b": 2}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(math.isclose(got[s], t, abs_tol=1e-9) for s, t in shared_out(sizes).items())


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.loaded(path)
    got = table(bpe.encoded(docs.withColumn("n_tokens", F.lit("clash"))))
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and own.decode(ids) == text
    rng = random.Random(2)
    for k in range(24):
        piece = "".join(rng.choice(["etaoinshr", "ab", "éèàüßñ", "αβγδεж", "zxqj"][k % 5]) for _ in range(rng.choice([1140, 1500, 3000])))
        stream, data, cut = bpe.Stream(own.merges), piece.encode(), rng.randint(1, 1100)
        assert [*stream.feed(data[:cut]), *stream.feed(data[cut:]), *stream.end()] == library.encode(piece, add_special_tokens=False).ids
    pieces = [w.encode() for t in rows() for w in own.words(t[1] or "") for w in own.split(w) if len(w.encode()) <= bpe.NARROW]
    assert own.rows.merged(pieces) == [own.piece(p.decode()) for p in pieces]
    assert "".join(own.text_of(own.names[i] for i in library.encode("Straße 😀!", add_special_tokens=False).ids)) == "straße 😀! "
    assert bpe.encoded(nothing).count() == 0


def test_bpe_decodes_the_ids_it_made(monkeypatch):
    own, given = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    plain = bpe.Decoder.feed
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, ids: given.extend(ids) or plain(self, ids))
    [(n, ids, text)] = own.encode(["Straße of words, of words"])
    assert given == [int(i) for i in ids.split()] and n == len(given) and text == " ".join(own.names[i] for i in given)


def test_bpe_remembers_a_word_as_four_bytes_an_id():
    own = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straße of words, of unheard-of words", "", "<|endoftext|> 12345"]
    got = own.encode(texts)
    assert {w: list(np.frombuffer(own.known[w], np.uint32)) for w in own.known} == {w: own.ids(w) for t in texts for w in own.words(t)}
    assert got == [(len(ids), " ".join(map(str, ids)), own.decode(ids)) for ids in map(own.ids, texts)]


def test_what_an_earlier_task_freed_goes_back_before_the_next_one():
    def held():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    given_back()
    before = held()
    blocks = [bytes(2000) for _ in range(50_000)]
    last = blocks[::500]  # what stays among the freed keeps the heap from shrinking by itself
    del blocks
    assert held() - before > 60
    assert list(batches(iter([]))) == [] and len(last) == 100
    assert held() - before < 30


def test_bpe_decoder_keeps_its_state_between_portions():
    own = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, machine = own.ids("Straße of words, of words"), bpe.Decoder(own)
    assert "".join(machine.feed(ids[i : i + 1]) for i in range(len(ids))) == own.decode(ids) == bpe.Decoder(own).feed([*ids[:3], 1 << 30, *ids[3:]])


def test_lm(docs, nothing):
    got = table(lm.scored(docs, held_out(10)))
    counts, data = collections.Counter(), rows()
    for i, t, *_ in data:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*lm.words_of(t), b" "])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in data:
        tokens = [*lm.words_of(t), b" "]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and -1e6 < r["score"] < 0
    assert got[57]["score"] == got[3]["score"] or rows()[57][1] != rows()[3][1]
    assert lm.scored(nothing, held_out(10)).count() == 0


def test_lm_lays_words_out_without_a_lookup_each():
    rng = random.Random(4)
    parts = [*"aAbBzéÉ.,;:!?)\"'| \n\t\x0b\x1c\x85中\x00", "the ", "of", "x" * 15, "x" * 16, "x" * 17]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(800)), None]
    each = [lm.words_of(t) for t in texts]
    head = [(w, 5) for w in dict.fromkeys([b"a", b"a\x00", b"x" * 15, b"x" * 16, b"x" * 17, b"\xc3\xa9", *[w for ws in each[:300] for w in ws]])]
    for known in (lm.Words(head, 20), lm.Words(head, 1536), lm.Words([], 768)):
        (low, first, end), places, classes, starts = known.laid(pa.array(texts, pa.string()))
        data, want = low.tobytes(), [(known.place.get(w, -1), w) for ws in each for w in [*ws, None]]
        assert [data[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)] == [w for ws in each for w in ws]
        assert places.tolist() == [p for p, _ in want]
        assert classes.tolist() == [known.end if w is None else int(known.kind[p]) if p >= 0 else known.group(w) for p, w in want]
        assert starts.tolist() == np.cumsum([0, *(len(ws) + 1 for ws in each[:-1])]).tolist()

    class Asked(dict):
        def get(self, word, *default):
            assert len(word) > 16 or 0 in word
            return super().get(word, *default)

    known = lm.Words(head, 1536)
    known.table  # noqa: B018  made once
    known.place = Asked(known.place)
    assert np.array_equal(known.laid(pa.array(texts, pa.string()))[1], lm.Words(head, 1536).laid(pa.array(texts, pa.string()))[1])


def test_lm_is_normalised():
    share = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.Model.start(share)
    first, second, z = model.tables()
    assert np.allclose(np.exp(first[3] + second[5] - z[3, 5]).sum(), 1, atol=1e-4)


def test_lm_learns_rare_words_and_ignores_partitions(spark):
    """A text of rare words alone has a score that depends on their order, and that neither order nor partitions of the table change."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(1100)]
    texts = [" ".join(rng.choice(common) for _ in range(600)) for _ in range(10)]
    texts += [" ".join(f"{rng.randrange(10**9)}{e}" for _ in range(80) for e in ("ung", "tion", "ado")) for _ in range(20)]
    rare = [f"x{i}{e}" for i in range(20) for e in ("ung", "tion", "ado")]
    texts += [" ".join(rare), " ".join(sorted(rare, key=lambda w: w[::-1]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {r["doc_id"]: r["score"] for r in lm.scored(df.coalesce(1), F.col("doc_id") >= 30).collect()}
    other = {r["doc_id"]: r["score"] for r in lm.scored(df.orderBy(F.desc("doc_id")).repartition(7), F.col("doc_id") >= 30).collect()}
    assert first[30] > first[31] + 1
    assert all(math.isclose(first[i], other[i], rel_tol=1e-5) for i in first)
    assert lm.size_for(10) < lm.size_for(10**7)


def test_quality_trees_against_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.NAMES))).astype(np.float32)
    y = ((x[:, 2] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    trees = quality.fit(x, y, trees=12)
    binned = quality.bins(x, trees.cuts)
    for row, score in list(zip(binned, trees.scores(x), strict=True))[:100]:
        total = trees.base
        for feature, limit, left, value in zip(trees.feature, trees.limit, trees.left, trees.value, strict=True):
            node = 0
            while left[node]:
                node = left[node] + (row[feature[node]] > limit[node])
            total += value[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9


def test_mixing_keeps_columns_of_the_same_names(docs):
    clash = docs.withColumns({"size": F.lit(7), "target": F.lit(8), "copies": F.lit(9), "taken": F.lit(10), "source_size": F.lit(11)})
    out = mixing.mix_rows(clash)
    assert out.columns == clash.columns and {tuple(r) for r in out.select("size", "target", "copies", "taken", "source_size").collect()} == {(7, 8, 9, 10, 11)}
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in mixing.mix_rows(docs).select("doc_id").collect())


def test_lm_beats_its_base_on_held_out_texts(spark):
    """Texts of a grammar in which a word decides the next: the model knows that, the base can't."""
    rng = random.Random(6)
    follows = {i: [rng.randrange(80) for _ in range(3)] for i in range(80)}

    def text():
        at, out = rng.randrange(80), []
        for _ in range(120):
            at = rng.choice(follows[at])
            out.append(f"word{at}")
        return " ".join(out)

    got = lm.scored(spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string"), held_out(10)).where("held_out").collect()
    assert len(got) > 5 and sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


def test_lm_head_is_bounded_by_a_threshold(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1000 // (i + 1) + 1) for i in range(400)], "word binary, c long")
    head = lm.most_frequent(counts, 50)
    assert 0 < len(head) <= 50 and head[0] == (b"w0", 1001) and min(c for _, c in head) > 1000 // (len(head) + 1)
    assert lm.most_frequent(counts.limit(0), 50) == []


def test_quality(docs, labels, nothing):
    trees = quality.train(docs, labels, ~held_out(5))
    got = table(quality.score(docs.withColumn("score", F.lit("clash")), trees))
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert quality.score(nothing, trees).count() == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.fit(x[:1500], y[:1500]).scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_empty_tables(nothing):
    assert suffix_dedup.judged(nothing).count() == 0 and suffix_dedup.without_repeats(nothing).count() == 0
    assert fingerprint.fingerprints(nothing).count() == 0
    assert neardup.classes(nothing).count() == 0 and neardup.deduplicated(nothing).count() == 0
    assert media.document_media(nothing).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short"), (2, None)], "doc_id long, text string")
    assert suffix_dedup.judged(df).where("n_removed > 0").count() == 3
    assert sorted(str(r["component_id"]) for r in neardup.classes(df, 2).collect()) == ["1", "1", "2", "2", "None"]
    for frame in (fingerprint.fingerprints(df), media.document_media(df), token_files.round_trip(df), mixing.mix(df.withColumn("source", F.lit(None).cast("string"))), bpe.encoded(df), lm.scored(df, held_out(10))):
        assert frame.count() == 5


def test_likeness_of_the_tables(docs):
    assert [neardup.least_matches(p) for p in (75, 80, 90, 100)] == [36, 41, 54, 75]
    for percent in (50, 74, 101):
        with pytest.raises(ValueError, match="75 to 100"):
            neardup.classes(docs, k=2, percent=percent)


@pytest.mark.parametrize("percent", [75, 90])
def test_other_likenesses(spark, percent):
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        words = list(base) if i % 2 else [f"u{i // 4}x{j}" for j in range(60)]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2, percent=percent).collect()}
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    root = list(range(60))
    for a in range(60):
        for b in range(a + 1, 60):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert [got[i] for i in range(60)] == root
