"""The pipeline's rows against brute-force versions of its stages, chained."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from verdigris.llm import mixing, suffix_dedup, toxicity  # noqa: E402
from verdigris.llm.common import held_out  # noqa: E402

from .test_operators import SCHEMA, WORD, plain_score, removed, rows  # noqa: E402


def folder_of(spark, tmp_path, data):
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 900)) for r in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def not_toxic(spark, folder, data):
    """What a scorer without machines keeps, with the weights learned from the labels."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stems = toxicity.induced(docs, labels, ~held_out(5))
    learned = toxicity.weights(toxicity.matches(docs.select("doc_id", "text"), stems), labels, ~held_out(5))
    return [r for r in data if plain_score(r[1], learned, stems) < 0.5]


def not_copied(data, k=5):
    """The document of the least id of each component, by all pairs of sets."""

    def shingles(text):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()

    sets, parent = {r[0]: shingles(r[1]) for r in data}, {r[0]: r[0] for r in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [r for r in data if root(r[0]) == r[0]]


def cut(data):
    out = []
    for r, spans in zip(data, removed([r[1] for r in data], suffix_dedup.PASSAGE), strict=True):
        b, left, at = (r[1] or "").encode(), b"", 0
        for a, e in spans:
            left, at = left + b[at:a], e
        out.append((r[0], (left + b[at:]).decode("utf-8", "ignore"), *r[2:]))
    return out


def mixed(data):
    """Each row as often as the mix takes it, by the operator's SQL."""
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in data], pa.int64()), "text": pa.array([r[1] for r in data], pa.string()), "source": pa.array([r[3] for r in data], pa.string())}))
    sql = mixing.SQL.rpartition("SELECT doc_id, size")[0] + "SELECT doc_id, CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT) FROM r"
    copies = dict(con.sql(sql).fetchall())
    return [r for r in data for _ in range(copies[r[0]])]


def encoded(data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = collections.Counter()
    for doc, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out[doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    return out


def test_rows_of_the_pipeline(spark, tmp_path):
    data = rows() + [(900 + i, f"You worthless idiot, {'x' * i} is here", "en", "s1", 0) for i in range(12)]
    folder = folder_of(spark, tmp_path, data)
    clean = not_toxic(spark, folder, data)
    single = not_copied(clean)
    shorter = cut(single)
    taken = mixed(shorter)
    assert len(clean) == len(data) - 12 and len(single) < len(clean) and any(len(a[1] or "") > len(b[1]) for a, b in zip(single, shorter, strict=True)) and len({r[0] for r in taken}) < len(taken)
    got = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == encoded(taken)


def test_stages_one_by_one(spark, tmp_path):
    data = rows()
    folder = folder_of(spark, tmp_path, data)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"key": F.lit("own"), "score": F.lit(2)})
    wanted = {"toxicity": lambda d: d, "minhash near-dedup": not_copied, "suffix-array dedup": cut, "mixing": mixed}
    assert [n for n, _ in corpus_pipeline.STAGES] == [*wanted, "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns  # those of documents and more, whatever their names
        plain = lambda t: (t or "") if name in ("suffix-array dedup", "mixing") else t  # noqa: E731, B023
        assert collections.Counter((r["doc_id"], plain(r["text"]), r["source"], r["score"]) for r in out.collect()) == collections.Counter((r[0], plain(r[1]), r[3], 2) for r in wanted[name](data)), name


def test_nothing_to_do(spark, tmp_path):
    folder = folder_of(spark, tmp_path, rows()[:1])
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
