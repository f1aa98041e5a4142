"""The pipeline's stages on a small corpus with planted junk, boilerplate, copies and leaks."""

import random

import corpus_pipeline as P
import pytest


@pytest.fixture(scope="module")
def planted(spark, docs, tmp_path_factory):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    clean = ["\n".join(line(r.randint(8, 15)) for _ in range(r.randint(3, 8))) for _ in range(120)]
    boiler, items = line(9), [line(35) for _ in range(4)]
    rows, kind = [], {}

    def add(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, "en", f"src{len(rows) // 2 % 16}", len(text or "")))

    for i, t in enumerate(clean):
        add(boiler + "\n" + t if i % 2 else t, "boiler" if i % 2 else "clean")
    for i in range(6):
        add(clean[2 * i], "copy")
        w = clean[2 * i].split(" ")
        w[-1] = "changed"
        add(" ".join(w), "copy")
    for i in range(5):
        add(line(20) + "\n" + items[i % 4].upper() + "\n" + line(20), "leak")
    for i in range(30):
        add(" ".join(f"{word()}{r.choice(['***', '%%%', '&&&'])}" for _ in range(40)), "junk")
        add(" | ".join(word() for _ in range(40)), "junk")
    for t in (None, "", " \n"):
        add(t, "junk")
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, docs.schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {x[0]: x for x in rows}, kind, boiler


def test_stages(spark, planted):
    folder, rows, kind, boiler = planted
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, folder), "test")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        seen[name] = {x["doc_id"]: x for x in out.collect()}
        docs = out
    a, b, c, d = seen.values()
    assert set(a) == {i for i in rows if kind[i] != "junk"}
    assert set(b) == set(a)
    for i in b:
        want = rows[i][1].replace(boiler + "\n", "") if kind[i] == "boiler" else rows[i][1]
        assert b[i]["text"] == want and b[i]["n_chars"] == len(want)
    assert set(c) == {i for i in b if kind[i] != "copy"}
    assert set(d) == {i for i in c if kind[i] != "leak"}
    got = {x["doc_id"]: x for x in P.run(spark, folder).collect()}
    assert set(got) == set(d) and all(x["exact"] for x in got.values())


def test_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, clash, tmp_path):
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns and 0 < out.count() <= clash.count()
    assert P.STAGES[-1][1](spark, clash, str(tmp_path)).count() == clash.count()
