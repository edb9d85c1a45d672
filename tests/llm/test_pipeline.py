import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tillage.llm import decontaminate as D
from tillage.llm import language_id as L
from tillage.llm import quality_rules as R
from tillage.llm import simhash as S

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES][0] == "language ID" and len(P.STAGES) == 5
    out = P.run(spark, SF)
    assert out.columns == [*docs.columns, "rate", "copies"]
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert 0 < len(ids) == len(set(ids)) <= docs.count() and all(r["copies"] > 0 and r["rate"] >= 0 for r in rows)
    kept = docs.join(out.select("doc_id"), "doc_id")
    assert D.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet"), out="b").where("b.contaminated").count() == 0


def test_every_stage_by_its_operator(spark):
    """What each stage keeps is what the operator's own verdict says of the stage's input, row by row."""
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = L.fit_field(docs.where(~L.held_out(F.col("doc_id"))))
    said = L.identify(docs, field, out="o").select("doc_id", "o.*").collect()
    first = P.language(spark, docs, SF).cache()
    assert ids(first) == sorted(r["doc_id"] for r in said if r["lang"] != "und" and r["score"] >= P.MIN_LANGUAGE_SHARE)
    second = P.quality(spark, first, SF).cache()
    assert ids(second) == sorted(r["doc_id"] for r in R.judge_quality(first, out="q").select("doc_id", "q.kept").collect() if r["kept"])
    third = P.near_duplicates(spark, second, SF).cache()
    assert ids(third) == sorted({r["component_id"] for r in S.similar_texts(second, params=S.SimilarParams()).collect()})
    fourth = P.benchmarks(spark, third, SF).cache()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(fourth) == sorted(r["doc_id"] for r in D.contamination(third, bench, out="b").select("doc_id", "b.contaminated").collect() if not r["contaminated"])
    last = P.mixture(spark, fourth, SF)
    assert set(ids(last)) <= set(ids(fourth)) and last.where("copies < 1 or rate <= 0").count() == 0
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns


def test_duplicates_and_benchmarks_by_brute_force(spark):
    """Both stages on a whole small table, against all pairs of texts and all windows of all items."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    low = {chr(c): chr(c + 32) for c in range(65, 91)}
    lower = lambda t: (t or "").translate(str.maketrans(low))
    rows = {r["doc_id"]: lower(r["text"]) for r in docs.collect()}
    words = {i: tuple(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows.items()}
    cut = {i: {w[j : j + 5] for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    top = {i: i for i in rows}

    def of(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and (words[a] == words[b] or len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b]) > 0):
                x, y = sorted((of(a), of(b)))
                top[y] = x
    kept = P.near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in rows if of(i) == i) and kept.columns == docs.columns

    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict[int, set] = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r["text"])
        n = min(13, len(w))
        windows.setdefault(n, set()).update(tuple(w[j : j + n]) for j in range(len(w) - n + 1) if n)
    clean = []
    for i, t in rows.items():
        w = plain(t)
        hit = {p for n, own in windows.items() if n for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in own for p in range(j, j + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    assert len(clean) < len(rows) and sorted(r["doc_id"] for r in P.benchmarks(spark, docs, SF).collect()) == sorted(clean)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_on_odd_rows(spark, stage):
    prose = "the river and the house of that man were in the town with all of their people . " * 8
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose, None, None, None), (3, prose, "en", "s", 9), (None, prose + " more", "en", "s", 1), (4, prose * 400, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = ["_language", "_quality", "_mix", "rate", "copies", "kept", "row", "_row", "pattern", "_benchmark_hits", "digest"]
    wide = docs.withColumns({c: F.lit(i) for i, c in enumerate(more)})
    last = stage is P.mixture
    for df in (docs, docs.limit(0), wide):
        out = stage(spark, df, SF)
        assert out.columns[: len(df.columns)] == df.columns and (last or out.columns == df.columns)
        got = out.collect()
        assert len(got) <= df.count() and {r["doc_id"] for r in got} <= {1, 2, 3, 4, None}
        assert last or df is not wide or all(r["digest"] == more.index("digest") and r["rate"] == more.index("rate") for r in got)


def test_stages_catch_what_they_are_for(spark):
    prose = " ".join(f"the w{i} of and in that" for i in range(60))
    docs = spark.createDataFrame([(5, prose), (6, prose), (7, prose.replace("w30", "x30")), (8, "12 34 %% " * 40), (9, " ".join(f"die z{i} und der mit" for i in range(60)))], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    assert sorted(r["doc_id"] for r in P.language(spark, docs, SF).collect()) == [5, 6, 7, 9]
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()) == [5, 8, 9]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    dirty = docs.where("doc_id = 5").withColumn("text", F.lit(f"some words before {item} and after"))
    assert P.benchmarks(spark, docs.unionByName(dirty.withColumn("doc_id", F.lit(99).cast("long"))), SF).where("doc_id = 99").count() == 0
