"""Ranked search, filter audit and chat formatting against plain versions, on small tables with nulls, ties, copies, long texts and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("verdigris.llm")

from verdigris.llm import chat, filter_audit, queries, search  # noqa: E402
from verdigris.llm.common import written  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ranked search


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 3))) for _ in range(60)] + ["the"] * 30
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 80]))) for _ in range(150)]
    texts += [texts[7]] * 30  # ties, to be settled by id
    texts += [None, "", " ,.! \x00\x1f", "The-THE the x", "Straße ÀB 😀x9 _a_", "the " * 20_000 + "rare", "the\x7fend", "ﬁ Ａ"]
    ids = list(range(-20, len(texts) - 20))
    rng.shuffle(ids)
    docs = [(i, t, 5) for i, t in zip(ids, texts, strict=True)] + [(ids[3], "the again abc", 1), (None, texts[8], 1), (None, texts[9], 1)]
    items = [(k, " ".join(rng.choices(vocabulary + ["absent"], k=12))) for k in range(25)] + [(90, None), (91, " .. "), (92, "absent only here"), (93, "THE Straße 😀x9 rare"), (94, texts[7]), (3, "ﬁ Ａ end")]
    return docs, items


def ranking(docs, items, most):
    fold = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, collections.Counter(fold(t))) for i, t, *_ in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for k, t in items:
        wanted[k] |= set(fold(t))
    out = []
    for k, terms in wanted.items():
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(k, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:most])]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize(("shard", "block", "most"), [(16_384, 200_000, 50), (9, 40, 50), (30, 200_000, 3)])
def test_ranked_search(spark, monkeypatch, shard, block, most):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    docs, items = corpus()
    # columns that bear the names of the operator's own
    table = spark.createDataFrame(docs, "doc_id long, text string, score int").withColumns({"term": F.lit("x"), "shard": F.lit(1), "n": F.lit(2)}).repartition(3)
    made = written(search.index(table), "t")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(made, spark.createDataFrame(items, "item_id long, text string"), most, block).collect()), key=lambda r: r[:2])
    assert got == ranking(docs, items, most)


def test_ranked_search_on_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"] and search.ranked(docs, items).count() == 0
    assert search.ranked(spark.createDataFrame([(1, "the")], "doc_id long, text string"), items.where("false")).count() == 0
    assert search.ranked(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).count() == 0


def test_postings():
    values = np.array([0, 1, 127, 128, 300, 16_384, 2**31, 2**40], np.int64)
    data, size = search.packed(values)
    assert search.unpacked(data.tobytes()).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 5, 6]
    assert search.unpacked(b"").tolist() == []


def test_best_drops_nothing():
    """The bounded heap with and without bounds that end a term's merge."""
    rng = random.Random(2)
    for _ in range(200):
        postings, scores = [], collections.Counter()
        for _ in range(rng.randint(1, 8)):
            docs = sorted(rng.sample(range(60), rng.randint(1, 60)))
            gains = [rng.randint(1, 9) ** rng.randint(1, 4) for _ in docs]
            scores.update(dict(zip(docs, gains, strict=True)))
            postings.append((max(gains), docs, gains, dict(zip(docs, gains, strict=True))))
        most = rng.randint(1, 12)
        assert sorted(search.best(postings, most), reverse=True) == sorted(((s, -d) for d, s in scores.items()), reverse=True)[:most]


# filter audit


def audited():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    text = lambda n, of=400: " ".join(rng.choices(words[:of], k=n))
    texts = [text(rng.choice([5, 190, 199, 200, 260])) for _ in range(60)] + [text(250, 20) for _ in range(15)]
    texts += [t + "#" for t in texts[:8]] + [t.upper() for t in texts[8:14]] + ["A" + "a" * 49, "A" + "a" * 48, "Éa" * 40, "a b c\x0bd\x1ce", "", None, " \n ", None, "x " * 30_000]
    texts += [texts[0]] * 25 + [texts[61]] * 9
    rows = [(i, t, None if i % 11 == 0 else ["", "s1", "s2"][i % 3]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    # an id with two texts, an id that repeats its text, rows without id
    return rows + [(5, texts[9], "s1"), (rows[0][0], rows[0][1], "s2"), (0, texts[0], "s1"), (None, texts[0], "s1"), (None, texts[1], None)]


def failed(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, source in rows:
        t = t or ""
        words = WORD.findall(t)
        yield (
            source or "",
            i,
            frozenset(
                f
                for f, bad in zip(
                    "ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]], strict=True
                )
                if bad
            ),
        )


def audit_of(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    out, shapley = {}, collections.Counter()
    parts = collections.defaultdict(list)
    for part, i, fails in failed(rows):
        parts[part].append((i, fails))
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("print_", [None, "7", "length(coalesce(text, '')) % 3"])
def test_copies_by_one_sort(spark, print_):
    """Copies over many ranges; with forced fingerprints that different texts share, all of them at one border."""
    rows = audited()
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    masks = filter_audit.judged(table, F.expr(print_) if print_ else None)
    got = collections.Counter((r["part"], r["doc_id"], r["mask"]) for r in masks.collect())
    assert got == collections.Counter((p, i, sum(1 << "ABCDE".index(f) for f in fails)) for p, i, fails in failed(rows))


def test_filter_audit(spark):
    rows = audited()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90)] + [(3, None, 1), (4, 1, None), (None, 1, 1), (4, 0, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit(3), "part": F.lit("p"), "n": F.lit(1)}).repartition(4)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audit_of(rows, labels)
    assert filter_audit.audit(table.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# chat formatting


def folded(log):
    """Final messages of each conversation, event by event in the order of seq."""
    out = collections.defaultdict(dict)
    for conv, turn, tie, entry, seq, kind, role, text, start, length in sorted(log, key=lambda e: (e[4], e[5], e[7] or "")):
        key, text = (turn is None, turn or 0, tie, entry), text or ""
        has = out[conv]
        m = has.setdefault(key, {"role": None, "text": "", "opened": None, "live": False})
        if kind == "open":
            m.update(role=role or "", text=text, opened=seq, live=True)
        elif kind == "delta":
            if m["opened"] is None:
                m.update(role=role or "", opened=seq, live=True)
            m["text"] += text
        elif kind == "edit":
            m["text"] = text if start is None else m["text"][:start] + text + m["text"][start + (length or 0) :]
        else:
            m["text"] = ""
            for k, later in has.items():
                if k > key:
                    later["live"] = False
    return {c: [(m["role"], m["text"]) for _, m in sorted(has.items()) if m["live"]] for c, has in out.items() if any(m["live"] for m in has.values())}


def described(turns, size):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size)


def events():
    rng = random.Random(8)
    bits = ["[INST]", "</s>", "\\", "[\\INST]", "<\\\\s>", " ", "é😀", "[ROLE]", "[/SYS]", "<", "[", "ok", "\n", "[SEP]x", ""]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 6)))
    log = []
    for conv in [*range(12), None, 77]:
        seq, turns = 0, 60 if conv == 77 else rng.randint(1, 9)
        for turn in range(turns):
            role = rng.choice(["user", "assistant", "system", "tool [SEP]", "", None])
            for _ in range(rng.randint(1, 4)):
                kind = rng.choice(["open", "delta", "delta", "edit", "regenerate"])
                seq += rng.randint(0, 2)
                of = rng.randint(0, turn) if rng.random() < 0.3 else turn
                start = rng.choice([None, 0, 1, 3, 50])
                log.append((conv, of, 0, 0, seq, kind, role, rng.choice([None, text()]), start, rng.choice([None, 0, 2, 9])))
    # distinct (seq, kind, text) in a conversation, so that the order of events is one
    seen, out = set(), []
    for e in log:
        while (e[0], e[4]) in seen:
            e = (*e[:4], e[4] + 1, *e[5:])
        seen.add((e[0], e[4]))
        out.append(e)
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_chat_events(spark, chunk):
    log = events()
    table = spark.createDataFrame(log, chat.LOG).withColumns({"formatted": F.lit("x"), "cut": F.lit(1), "piece": F.lit(2)}).repartition(3)
    chunks = chat.formatted(table, chunk)
    texts = collections.defaultdict(list)
    for r in chunks.collect():
        texts[r["conv_id"]].append((r["piece"], r["number"], r["formatted"], r["starts"], r["ends"]))
    want = folded(log)
    assert set(texts) == set(want) and any(len(v) > 1 for v in texts.values())
    for conv, pieces in texts.items():
        whole = "".join(p[2] for p in sorted(pieces))
        assert list(chat.turns_of(whole)) == want[conv]
        assert "".join(chat.unescaped(p[2][a:b]) for p in sorted(pieces) for a, b in zip(p[3], p[4], strict=True)) == "".join(t for r, t in want[conv] if r == "assistant")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.described(chunks).collect()}
    assert got == {c: described(turns, sum(len(p[2]) for p in texts[c])) for c, turns in want.items()}


def test_chat_escapes():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ANS]", "SEP]", "ROLE]", " ", "x"], k=rng.randint(0, 7)))
        assert chat.unescaped(chat.escaped(text)) == text and not chat._BARE.search(chat.escaped(text))
        turns = [("user", text), ("assistant", text), (text, text), ("system", ""), ("assistant", "")]
        assert list(chat.turns_of("".join(chat.rendered(*t)[0] for t in turns))) == [(r, t) for r, t in turns]


def test_chat_unknown_event(spark):
    with pytest.raises(Exception, match="no such event"):
        chat.formatted(spark.createDataFrame([(1, 1, 0, 0, 1, "shout", "user", "x", None, None)], chat.LOG))


def test_chat_table(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "[INST] \\ </s>", "long " * 900, "é" * 600])) for c in range(30) for t in range(rng.randint(1, 8))]
    rows += [(None, 1, "user", "no id"), (3, None, "assistant", "last"), (4, 2, "user", "same"), (4, 2, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(9), "kind": F.lit("z"), "tie": F.lit(1)}).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.described(chat.formatted(chat.log_of(table))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", x or "") for c, t, r, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)) if c == conv]
        if conv != 4:
            assert got[conv] == described(turns, sum(len(chat.rendered(*t)[0]) for t in turns))
        assert (got[conv][0], got[conv][2]) == (len(turns), sum(len(x) for r, x in turns if r == "assistant"))
    assert chat.described(chat.formatted(chat.log_of(table.where("false")))).count() == 0


# through the registered queries, against their SQL


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_filter_audit", "op13_chat_formatting"])
def test_queries(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    docs, items = corpus()
    rows = [(n, t, ["s", "", None][n % 3]) for n, (_, t, _) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([i for i in items if i[0] != 3 or i[1] != items[3][1]], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(150)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i // 4, i % 4, "user" if i % 2 else "assistant", t) for i, (_, t, _) in enumerate(docs)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found, con = queries.QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        file = next(tmp_path.glob(f"{t}.parquet/part-*"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{file}'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
