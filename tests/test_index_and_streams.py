"""The stored index, exact order statistics, split series, and state processors over several batches and restarts."""

import datetime
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import lexical
from tillage.operators import lexindex as X
from tillage.operators import statistics as Q
from tillage.session import scratch
from tillage.streaming import stateful as K
from tillage.streaming import telemetry as Z

WORDS = ["uno", "dos", "tres", "cuatro", "cinco", "seis"] + [f"raro{i}" for i in range(40)]


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, None if i % 17 == 3 else " ".join(rng.choices(WORDS, weights=[30, 20, 9, 5, 3, 2] + [1] * 40, k=rng.randint(0, 30)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def updated(spark):
    """An index after two updates, and the documents that are left."""
    at, p = f"{scratch(spark)}/index", X.IndexParams(parts=5, chunk=8)
    live = dict(texts(1, range(120)))
    X.build_index(frame(spark, list(live.items())), at, params=p)
    for seed, fresh, gone in ((2, range(100, 140), range(0, 120, 7)), (3, [0, 7, 3, 300], [101, 999])):
        new = texts(seed, fresh)
        X.update_index(spark, at, frame(spark, new), frame(spark, [(i, "") for i in gone]))
        live = {i: t for i, t in live.items() if i not in gone} | dict(new)
    return at, live


QUERIES = [(1, "uno raro3"), (2, "dos dos seis"), (3, "raro7 raro8 raro9"), (4, "no está"), (5, ""), (6, "cuatro uno tres")]


@pytest.mark.parametrize("k,first", [(5, 1), (3, 4), (100, 2)])
def test_index_gives_what_reading_the_texts_gives(spark, updated, k, first):
    at, live = updated
    assert rows_of(X.search_index(spark, at, QUERIES, k=k, first=first)) == rows_of(lexical.bm25(frame(spark, list(live.items())), QUERIES, k=k))


def test_index_reads_only_the_folders_of_its_terms(spark, updated):
    plan = X.Index(spark, updated[0]).blocks(["raro3", "uno"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "In(term, [raro3,uno])" in plan.replace("In(term, [uno,raro3])", "In(term, [raro3,uno])")


def test_index_of_nothing(spark):
    at = f"{scratch(spark)}/index"
    X.build_index(frame(spark, []), at)
    assert X.search_index(spark, at, QUERIES).count() == 0
    X.update_index(spark, at, frame(spark, [(1, "uno raro3")]), frame(spark, []))
    assert [r["doc_id"] for r in X.search_index(spark, at, QUERIES[:1]).collect()] == [1]


def test_phrases_and_excluded_words(spark, updated):
    at, live = updated
    q = [X.TextQuery(1, phrases=["uno dos"]), X.TextQuery(2, words="raro1", must="uno tres", without="seis"), X.TextQuery(3, phrases=["dos uno dos", "uno uno"], without="cuatro"), X.TextQuery(4, words="raro5 raro6")]
    tokens = {i: (t or "").split() for i, t in live.items()}
    runs = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w)))

    def fits(x, w):
        asked = [*x.must.split(), *[p for p in x.phrases]]
        ok = all(m in w for m in x.must.split()) and all(runs(w, p.split()) for p in x.phrases) and not any(n in w for n in x.without.split())
        return ok and (bool(asked) or any(v in w for v in x.words.split()))

    got = X.search_phrases(spark, at, q).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(x.query_id, i) for x in q for i, w in tokens.items() if fits(x, w)}
    # a phrase weighs what its words weigh, and counts where it occurs
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    idf = lambda t: lexical.idf(n, sum(t in w for w in tokens.values()))
    for r in got:
        if r["query_id"] == 1:
            w = tokens[r["doc_id"]]
            tf = runs(w, ["uno", "dos"])
            want = (idf("uno") + idf("dos")) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
            assert r["score"] == pytest.approx(want, abs=1e-8)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    a = [*rng.normal(0, 1e6, 3000).tolist(), *[7.25] * 500, 1e300, -1e300]
    rows = [(x, float(i % 3), None, 5.0) for i, x in enumerate(a)] + [(math.nan, None, None, 5.0), (math.inf, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    asked = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.quantiles(df, {c: asked for c in "abcd"})
    for p in asked:
        assert got["a", p] == pytest.approx(float(np.quantile(np.array(a), p)), rel=1e-12)
        assert got["b", p] == pytest.approx(float(np.quantile([r[1] for r in rows if r[1] is not None], p)))
        assert got["c", p] is None and got["d", p] == 5.0
    ranked = sorted(a)
    assert Q.order_statistics(df, {"a": [0, 17, 1750, len(a) - 1]}) == {("a", r): ranked[r] for r in (0, 17, 1750, len(a) - 1)}


def test_series_of_one_key_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [("big", i, rng.gauss(0, 1) if i % 50 else None) for i in range(4000)] + [(k, i, rng.gauss(0, 1)) for k in ("x", "y", None) for i in range(60)] + [("one", 0, 2.0), ("null", 0, None)]
    df = spark.createDataFrame(rows, "k string, i long, e double").repartition(7)
    found = Q.durbin_watson(df, "e", "k", ["i"])
    got = {r["k"]: r["dw"] for r in found.collect()}
    for key in {r[0] for r in rows}:
        x = np.array([r[2] if r[2] is not None else math.nan for r in rows if r[0] == key], float)
        squares = np.nansum(x**2)
        want = np.nansum(np.diff(x) ** 2) / squares if squares else None
        assert got[key] == (pytest.approx(want) if want is not None else None)
    assert "rangepartitioning" in found._jdf.queryExecution().toString()


UTC = datetime.timezone.utc


def at_second(s):
    return datetime.datetime(2024, 1, 1, tzinfo=UTC) + datetime.timedelta(seconds=s)


EVENTS = "user_id long, event_id long, ts timestamp, value double, ok boolean"


def run_batches(spark, batches, build):
    """What a stream over a folder has emitted after each further file: every run is a restart from the checkpoint."""
    source, at, out = f"{scratch(spark)}/in", scratch(spark), []
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source).withWatermark("ts", "0 seconds")
        out.append([tuple(r) for r in Z.drained(build(stream), "update", at).collect()])
    return out


def test_breaker_half_opens_by_its_timer_and_survives_restarts(spark):
    bad = [(1, i, at_second(i), 1.0, False) for i in range(3)]
    build = lambda s: K.breaker(s, "user_id", "ok", "value", size=10, open_ms=30_000)
    later = [(2, 10, at_second(20), 1.0, True)]  # before the timer's end
    passed = [(2, 11, at_second(90), 1.0, True)]  # the watermark passes it, user 1 has sent nothing
    good = [(1, 20 + i, at_second(100 + i), 1.0, True) for i in range(5)]
    seen = run_batches(spark, [bad, later, passed, good], build)
    last = lambda rows, user: max((r for r in rows if r[0] == user), key=lambda r: (r[4], r[1] == "half-open"))[1]
    assert [last(rows, 1) for rows in seen] == ["open", "open", "half-open", "closed"]
    # it opened with the first observation, so its timer was due 30 seconds after that
    half = [r for r in seen[2] if r[0] == 1 and r[1] == "half-open"]
    assert len(half) == 1 and half[0][4] >= at_second(30).timestamp() * 1000
    assert last(seen[3], 2) == "closed"


def test_latest_state_goes_on_after_a_restart(spark):
    first = [(1, 1, at_second(5), 10.0, True), (1, 2, at_second(9), 20.0, True), (2, 3, at_second(1), 5.0, True)]
    second = [(1, 4, at_second(7), 30.0, True), (2, 5, at_second(3), 6.0, True)]
    newest = lambda rows, user: max((r for r in rows if r[0] == user), key=lambda r: r[4])
    seen = run_batches(spark, [first, second], lambda s: K.latest_state(s))
    assert [newest(seen[1], u)[1::2] for u in (1, 2)] == [(2, 20.0), (5, 6.0)] and newest(seen[1], 1)[4] == 3


def test_latest_state_forgets_idle_keys(spark):
    """By the clock, so the stream runs on until it is stopped: a run that ends with its input would wait for timers for ever."""
    source, at, got = f"{scratch(spark)}/in", scratch(spark), []
    put = lambda i, v: spark.createDataFrame([(1, i, at_second(i), v, True)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    put(1, 10.0)
    found = K.latest_state(spark.readStream.schema(EVENTS).parquet(source), keep_ms=2000)
    with K.with_rocksdb(spark):
        query = found.writeStream.outputMode("update").option("checkpointLocation", f"{at}/c").trigger(processingTime="500 milliseconds").foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).start()

    def until(n):
        end = time.time() + 60
        while len(got) < n and time.time() < end and query.isActive:
            time.sleep(0.1)
        assert len(got) >= n, query.exception()

    try:
        until(1)
        time.sleep(4)
        put(2, 20.0)
        until(2)
    finally:
        query.stop()
    assert [(r[1], r[4]) for r in got] == [(1, 1), (2, 1)]  # counting begins anew


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(K.PROVIDER, None)
    with K.with_rocksdb(spark):
        assert spark.conf.get(K.PROVIDER) == K.ROCKSDB
    assert spark.conf.get(K.PROVIDER, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
