import io
import json
import math

import numpy as np
import pytest

from vecspan.operators import cli, embed, evaluate, rag, search
from vecspan.operators.prep import chunk_documents
from vecspan.operators.search import top_k, top_k_batch
from vecspan.operators.store import VectorStore
from vecspan.schema import StoreError, StoreFinalizedError
from vecspan.sources.json_dir import array_elements, read_json_dir
from vecspan.sources.sinks import write_json_arrays
from vecspan.streaming.ingest import ingest_stream

CYCLE = [0.1 * k for k in range(1, 11)]


def doc(i, e, **more):
    return {"id": i, "text": f"text of {i}", "metadata": {"embedding": e, **more}}


def rotated(n):
    return (CYCLE[n:] + CYCLE[:n]) * 2


def test_life_cycle(spark):
    s = VectorStore(spark, 3)
    s.add_document(doc("a", [3, 4, 0]))
    assert s.size() == 1 and not s.is_finalized
    assert s.search([3, 4, 0], 5).collect() == []
    s.finalize()
    s.finalize()
    assert s.is_finalized and s.size() == 1
    with pytest.raises(StoreFinalizedError):
        s.add_document(doc("b", [1, 0, 0]))
    s.load_dir("/nowhere")  # silently nothing
    assert s.documents.first().embedding == pytest.approx([0.6, 0.8, 0])
    assert s.search([3, 4, 0], 1).first().score == pytest.approx(1)
    assert s.search([0, 0, 1], 1).first().score == 0
    assert s.search([3, 4, 0], 1, normalize_query=False).first().score == pytest.approx(5)
    assert s.search([3, 4, 0], 1).columns == ["score", "id", "text", "metadata_json"]


@pytest.mark.parametrize("bad", [{"id": 7}, {"text": None}, {"metadata": []}, {"metadata": {}}, {"metadata": {"embedding": [1, 2]}}, {"metadata": {"embedding": [1, "2", 3]}}, {"metadata": {"embedding": [1, True, 3]}}, {"metadata": {"embedding": [1e300, 0, 0]}}])
def test_rejected_documents(spark, bad):
    s = VectorStore(spark, 3)
    with pytest.raises(StoreError):
        s.add_document({**doc("a", [1, 2, 3]), **bad})
    assert s.size() == 0


def test_directory(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"doc{n + 1}.json").write_text(json.dumps(doc(f"doc{n + 1}", rotated(n), category="x")))
    (tmp_path / "all.json").write_text(" " + json.dumps([doc(f"doc{n + 1}", rotated(n)) for n in range(3)]))
    s = VectorStore(spark, 20)
    s.load_dir(str(tmp_path))
    assert s.size() == 6
    rows = s.search(rotated(0), 6).collect()
    assert [r.id for r in rows] == ["doc1", "doc1", "doc2", "doc2", "doc3", "doc3"]
    assert [round(r.score, 6) for r in rows] == pytest.approx([1, 1, 0.883117, 0.883117, 0.792208, 0.792208], abs=2e-6)
    assert s.search(rotated(0), 100).count() == 6 and s.search(rotated(0), 0).count() == 0
    assert s.search(rotated(0), 1, False).first().score == pytest.approx(math.sqrt(7.7), abs=1e-5)
    with pytest.raises(StoreError):
        s.search(rotated(0), -1)
    with pytest.raises(StoreError):
        s.search([1.0], 1)


def test_ingest_edges(spark, tmp_path):
    good = doc("q\"\\\n😀", [1, 0, 0], nested={"a": [1]})
    mixed = [good, {**good, "id": 7}, "junk", {"text": "t", "metadata": {}}, doc("b", [1, 2]), doc("b", [1, "1.5", 0]), doc("b", [1, None, 0]), doc("b", [True, 0, 0]), doc("b", [1e300, 0, 0])]
    (tmp_path / "a.json").write_text(json.dumps(mixed))
    (tmp_path / "b.json").write_text("\n " + json.dumps(dict(reversed(good.items()))))
    (tmp_path / "bad.json").write_text('[{"id": "x"')
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "UP.JSON").write_text(json.dumps(good))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.json").write_text(json.dumps(good))
    valid, rejected = read_json_dir(spark, str(tmp_path), 3)
    rows = valid.collect()
    assert [r.id for r in rows] == [good["id"]] * 2
    assert json.loads(rows[0].metadata_json)["nested"] == {"a": [1]}
    streamed = [df.collect() for df in read_json_dir(spark, str(tmp_path), 3, large=0)]
    assert [r.id for r in streamed[0]] == [good["id"]] * 2 and all(json.loads(r.metadata_json)["nested"] == {"a": [1]} for r in streamed[0])
    reasons = sorted(r.reason for r in rejected.collect())
    assert sorted(r.reason for r in streamed[1]) == reasons
    assert reasons == sorted(["bad_id", "not_object", "bad_id", "wrong_dim", "bad_embedding", "bad_embedding", "bad_embedding", "non_finite", "parse_error"])


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_array_elements(chunk):
    good = [[], [1], ["a", "b,]\"\\", {"k": [1, {"x": "}"}]}], [None, True, -1.5e3, ["[", [[]]], {}], {"a": [1]}, 5, "x"]
    for value in good:
        for text in (json.dumps(value), " \n" + json.dumps(value, indent=1) + " "):
            got = [json.loads(e) for e in array_elements(io.BytesIO(text.encode()).read, chunk)]
            assert got == (value if isinstance(value, list) else [value])
    for text in ("", "[", "[1", "[1,]", "[,1]", "[1}", "[1] 2", "[{]", "[1 2]", '["a]', "nul", "[NaN]"):
        with pytest.raises(ValueError):
            list(array_elements(io.BytesIO(text.encode()).read, chunk))


def test_capacity(spark):
    s = VectorStore(spark, 2, max_docs=2)
    s.add_documents(spark.createDataFrame([(str(k), "t", "{}", [1.0, float(k)]) for k in range(3)], "id string, text string, metadata_json string, embedding array<double>"))
    with pytest.raises(StoreError):
        s.finalize()
    assert not s.is_finalized and s.size() == 3


def test_batch_with_missing_and_ragged_vectors(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [9.0, 9.0, 9.0]), ("d", [2.0]), ("e", [1.0, 0.0]), ("f", [None, 1.0])], "id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0] * 5)], "qid int, embedding array<double>")
    got = sorted(tuple(r) for r in top_k_batch(docs, q, 2).collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "e", 1.0), (3, 1, "d", 2.0)]
    assert top_k_batch(docs, q.where("false"), 2).count() == top_k_batch(docs.where("false"), q, 2).count() == 0


def test_large_k(spark, monkeypatch):
    rows = [(f"i{k:03d}", "t", [float(k // 2), 0.0]) for k in range(100)]
    docs = spark.createDataFrame(rows, "id string, text string, embedding array<double>").repartition(3)
    want = [r.id for r in top_k(docs, [1.0, 0.0], 30).collect()]
    monkeypatch.setattr(search, "LARGE_K", 10)
    assert [r.id for r in top_k(docs, [1.0, 0.0], 30).collect()] == want


def test_near_zero_vectors(spark):
    s = VectorStore(spark, 64)
    for i, x in (("zero", 0.0), ("tiny", 1e-7), ("small", 1e-4)):
        s.add_document(doc(i, [x] * 64))
    s.finalize()
    by = {r.id: r.embedding for r in s.documents.collect()}
    assert by["zero"] == [0.0] * 64 and by["tiny"][0] == pytest.approx(1e-7) and by["small"][0] == pytest.approx(1 / 8)


def test_batch_is_brute_force_for_any_partitions(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(200, 16))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "id long, embedding array<double>")
    q = docs.where("id % 20 = 0").withColumnRenamed("id", "qid")
    expected = {(a, r): int(b) for a in range(0, 200, 20) for r, b in enumerate(np.argsort(-(e @ e[a]), kind="stable")[:4], 1)}
    for n in (1, 7):
        got = {(r.qid, r.rank): r.id for r in top_k_batch(docs.repartition(n), q, 4).collect()}
        assert got == expected


def test_retrieval(spark):
    s = VectorStore(spark, 2)
    s.add_documents([{"id": "std::vector", "text": "A container. ```int x;``` more", "metadata": {"embedding": [1, 0]}}, {"id": "std::mutex", "text": "x" * 700, "metadata": {"embedding": [0, 1]}}])
    r = rag.Retrieval(s, lambda text: [1.0, 0.5])
    assert "error" in r.handle("vector_search", {"embedding": [1, 0]})
    s.finalize()
    assert [x.id for x in r.search("q").collect()] == ["std::vector", "std::mutex"]
    assert r.search("q").collect()[1].preview == "x" * 500 + "..."
    code = r.search_code("q").collect()
    assert code[0].code == "```int x;```" and code[0].relevance == "89.4%" and code[1].content == "x" * 700 + "..."
    assert [x.id for x in r.search_category("concurrency", "q").collect()] == ["std::mutex"]
    assert r.search_category("unknown", "q").count() == 0
    assert r.section("MUTEX").first().id == "std::mutex" and r.section("none").first().id == "std::vector"
    found = r.handle("vector_search", {"embedding": [1, 0], "threshold": 0.5})
    assert found["count"] == 1 and r.handle("nope") == {"error": "unknown method: nope"}
    assert r.handle("get_stats")["documentCount"] == 2 and r.topics().count() == 15
    assert cli.answer(r, "quit") is None and "std::vector" in cli.answer(r, "q") and "2" in cli.answer(r, "stats")


def test_demo_embedding():
    v = embed.demo_embedding("move semantics")
    h = [round((x + 1) / 2 * 0x7FFFFFFF) for x in (v[0], v[1], v[2], v[-1])]
    assert h == [926259072, 49983872, 1876083640, 216921088]


def test_embedding_failures(spark):
    def broken(texts):
        raise RuntimeError

    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.embedding for r in embed.embed_column(df, "text", broken, wait=0.01).collect()] == [None, None]
    assert len(embed.embed_column(df, "text", embed.with_fallback(broken)).first().embedding) == 1536


def test_chunks_and_sink(spark, tmp_path):
    docs = spark.range(25).selectExpr("id", "concat('t', id) AS text").repartition(5)
    rows = chunk_documents(docs, "id", 10).collect()
    assert all(r.position == r.id and r.chunk == r.id // 10 for r in rows) and len(rows) == 25
    write_json_arrays(docs, str(tmp_path / "out"), "id", 10)
    sizes = {p.name: len(json.loads(p.read_text())) for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert sizes == {"part_0000.json": 10, "part_0001.json": 10, "part_0002.json": 5}
    same = spark.createDataFrame([(1, k) for k in range(40)], "a int, b int").repartition(4)
    assert sorted(r.position for r in chunk_documents(same, "a", 10).collect()) == list(range(40))


def test_timings(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)], "k string, v double")
    r = evaluate.timing_summary(df, "k", "v").first()
    assert (r.min, r.max, r.mean, r.median) == (1, 4, 2.5, 3) and r.stddev == pytest.approx(1.25**0.5)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps([doc(str(n), [3, 4]), "junk"]))
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in rows) == ["0", "1"] and rows[0].embedding == pytest.approx([0.6, 0.8])
