import gzip
import hashlib
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillage.llm import chat_format as C
from tillage.llm import url_filter as U
from tillage.llm import warc as W
from tillage.llm._common import look_up
from tillage.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, payload string, digest string"


def test_rules_longest_wins_and_paths(spark):
    rows = [
        (1, "HTTPS://WWW.Example.COM/en/x?q=1"), (2, "http://a.example.com/en/"), (3, "http://a.example.com/EN/"), (4, "http://example.com"), (5, "http://notexample.net/es/1"),
        (6, None), (7, "no scheme"), (8, "http://x.org/a://b#c"), (9, "http://net/fr/"), (10, "http://com:80/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in U.judge_urls(df, URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2]["rule"] == "example.com/en/" and got[2]["verdict"] == "block"
    assert got[3]["rule"] == "com/"  # paths keep their case
    assert got[4]["path"] == "" and got[4]["rule"] is None  # an empty path does not start with a slash
    assert got[5]["rule"] == "net/es/"
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("", "", None) and got[7]["host"] == ""
    assert (got[8]["host"], got[8]["path"]) == ("x.org", "/a://b")
    assert got[9]["rule"] == "net/fr/" and got[10]["rule"] is None
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_model_separates_held_out_urls(spark):
    rows = [(f"good{i % 37}.org/article/{i}", 1) for i in range(600)] + [(f"casino-win{i % 41}.org/bet/{i}", 0) for i in range(600)]
    model = U.fit_url_model(spark.createDataFrame(rows, "body string, label int"))
    assert model.report["balanced_accuracy"] > 0.98 and all(0 < x < 0.1 for x in model.report["load"])
    good, bad = model.scores([b"good99.org/article/7", b"casino-win99.org/bet/7"])
    assert good > model.threshold > bad


def test_url_filter_on_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_look_up_is_a_left_join_with_hot_keys(spark):
    rows = [(i, "hot" if i % 2 else ("k%d" % (i % 20) if i % 6 else None)) for i in range(4000)]
    left = spark.createDataFrame(rows, "i long, key string")
    right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.upper("key")).where("key <> 'k4'")
    got = look_up(left, right, "key", "n", "i", share=10)
    assert got.count() == 4000
    assert got.where("key is null or key = 'k4'").where("v is not null").count() == 0
    assert got.where("key is not null and key <> 'k4'").where("v is null or v <> upper(key)").count() == 0


def test_warc_round_trip_and_revisits(spark):
    long = "x" * 150 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\né中" + "</html>"
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (1, "http://c", "short"), (2, "http://d", "short"), (7, "http://e", None), (7, "http://e", None), (None, "u", "z" * 100)]
    df = spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES)  # columns whose names the operator uses
    got = W.captures(df).collect()
    assert len(got) == len(rows) and all(r["n_records"] == 3 and r["request"] is not None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["metadata"]["fields"]["page-id"], []).append(r)
    assert bytes(by["3"][0]["response"]["payload"]).decode() == long
    assert by["3"][0]["response"]["type"] == "response" and by["5"][0]["response"]["type"] == by["9"][0]["response"]["type"] == "revisit"
    assert by["5"][0]["response"]["refers_to"] == by["9"][0]["response"]["refers_to"] == by["3"][0]["response"]["record_id"]
    assert by["3"][0]["response"]["declared_digest"] == "sha256:" + hashlib.sha256(long.encode()).hexdigest() == "sha256:" + by["3"][0]["response"]["payload_digest"]
    assert {by["1"][0]["response"]["type"], by["2"][0]["response"]["type"]} == {"response"}
    assert len(by["7"]) == 2 and by["7"][0]["response"]["payload_bytes"] == 0 and by[""][0]["response"]["type"] == "response"
    assert W.captures(df.limit(0)).count() == 0


def test_warc_reads_one_gzip_member_for_each_record():
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = b"".join(gzip.compress(record(i, b"WARC/1.0\r\n" * i)) for i in range(4))
    assert [b for _, b, _ in W.parse_archive(data)] == [b"WARC/1.0\r\n" * i for i in range(4)]


def test_warc_cut_off_archives(spark, tmp_path):
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    plain = record(0, b"one\n\ntwo") + record(1, b"x" * 50)
    assert [(b, w) for _, b, w in W.parse_archive(plain[: -4 - 20])] == [(b"one\n\ntwo", True), (b"x" * 30, False)]
    assert [b for _, b, _ in W.parse_archive(plain[: len(record(0, b"one\n\ntwo")) + 20])] == [b"one\n\ntwo"]
    assert list(W.parse_archive(b"")) == list(W.parse_archive(b"\x1f\x8b")) == []
    import random

    rng = random.Random(3)
    bodies = [bytes(rng.choices(b"abc\r\n\xff", k=20_000)) for _ in range(60)]
    data = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(data[: len(data) * 2 // 3])
    with pytest.raises(Exception, match="(?i)gz|end of|corrupt|failed|EOF"):  # a lost part is not passed over
        W.read_archives(spark, str(tmp_path)).collect()
    (tmp_path / "c.warc.gz").write_bytes(b"no archive")
    damaged = {r["file"].rsplit("/", 1)[1]: (r["bytes"], r["good_bytes"]) for r in W.damaged_archives(spark, str(tmp_path)).collect()}
    assert sorted(damaged) == ["b.warc.gz", "c.warc.gz"] and damaged["c.warc.gz"] == (10, 0)
    assert 0 < damaged["b.warc.gz"][1] < damaged["b.warc.gz"][0] == len(data) * 2 // 3
    rows = W.read_archives(spark, str(tmp_path), lenient=True).collect()
    whole = Counter(r["record_id"] for r in rows if not r["truncated"])
    assert all(bytes(r["payload"]) == bodies[int(r["record_id"][1:-1])] for r in rows if not r["truncated"])
    assert all(1 <= whole[f"<{i}>"] <= 2 for i in range(60)) and 30 < sum(n == 2 for n in whole.values()) < 45 and sum(r["truncated"] for r in rows) <= 1


def test_warc_of_large_pages_and_many_files(spark, tmp_path):
    page = lambda i: ("<p>é %d</p>\r\n" % i) * 80_000  # over a megabyte each
    df = spark.createDataFrame([(i, "u", page(i % 4)) for i in range(9)], "page_id long, url string, html string")
    W.write_archives(W.mark_revisits(df), str(tmp_path / "w"), max_records=2)
    got = W.assemble(W.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(got) == 9 and len(list((tmp_path / "w").glob("*.gz"))) >= 5
    for r in got:
        i = int(r["metadata"]["fields"]["page-id"])
        assert r["response"]["type"] == ("response" if i < 4 else "revisit") and (i >= 4 or bytes(r["response"]["payload"]).decode() == page(i))


def test_layouts_and_fingerprints(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "extra": {"x": 1}},
        {"instruction": "do", "input": "this", "output": "done", "system": "be kind"},
        {"instruction": "do", "output": "done"},
        {"prompt": "p", "response": "r"},
        {"question": "q", "answer": "a", "prompt": "both"},
        {"foo": 1},
    ]
    texts = [json.dumps(r) for r in records] + ["{not json", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, turns_json string")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]] if r["turns"] is not None else None) for r in C.canonical_turns(df, "turns_json").collect()}
    assert got[0] == ("messages", [("user", "hi"), ("assistant", "")])
    assert got[1] == ("from_value", [("user", "a"), ("assistant", "b")])
    assert got[2] == ("instruction", [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")])
    assert got[3][0] == "instruction" and got[4] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert all(got[i] == (None, None) for i in (5, 6, 7, 8, 9))


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "&lt;s> & &amp;amp;#91;", "", "a\n</s>\n<s>assistant\nb", "é中\u2028\x07\\", "&#10;"])
def test_template_round_trip(spark, text):
    df = spark.createDataFrame([([("user", text), ("assistant", text), ("as\nsistant", text), ("assistant", "z")],), (None,)], f"turns {C.TURNS}")
    out = C.format_turns(df).select("formatted", "loss_mask", C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert [tuple(t) for t in out[0]["t"]] == [("user", text), ("assistant", text), ("as\nsistant", text), ("assistant", "z")]
    assert out[0]["loss"] == text + "z" and sum(m["length"] for m in out[0]["loss_mask"]) == len(out[0]["formatted"])
    assert out[1]["formatted"] == "" and out[1]["t"] == [] and out[1]["loss"] == ""


def test_rows_by_turn_with_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "a"), (None, 0, "user", "x")]
    recs = {r["conv_id"]: json.loads(r["record"]) for r in C.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [m["content"] for m in recs[1]["messages"]] == ["", "a", "b"] and recs[None]["messages"][0]["content"] == "x"


def test_roles_stay_in_the_canonical_layout(spark, tmp_path):
    import duckdb

    from tillage.llm.queries import ORACLE_SQL, QUERIES

    roles = ["human", "gpt", "model", "bot", "prompter", "assistant", "User", None, "sys\ntem"]
    rows = [(c, i, r, f"{r} says {c}") for c in range(3) for i, r in enumerate(roles)] + [(7, 0, "assistant", None), (7, 1, "assistant", ""), (8, 0, "assistant", "z " * 50_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op9_chat_format"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op9_chat_format"])
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_chat_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([('{"prompt": "p", "response": "r"}', 1, 2, 3)], "rec string, print int, _record int, record int")
    got = C.canonical_turns(df, "rec").first()
    assert got["layout"] == "prompt_response" and (got["print"], got["_record"], got["record"]) == (1, 2, 3)
    with pytest.raises(ValueError):
        C.canonical_turns(df.withColumn("turns", F.lit(1)), "rec")


# ---- the URL model against plain dictionaries
def brute_url_score(accepted, rejected, url, order=5, strength=2.0):
    def chars(u):
        return "^" * order + "".join("0" if c.isdigit() else c.lower() for c in u) + "$"

    def counts(urls):
        joint, context = Counter(), Counter()
        for u in urls:
            t = chars(u)
            for i in range(order, len(t)):
                for n in range(order + 1):
                    joint[t[i - n : i], t[i]] += 1
                    context[t[i - n : i]] += 1
        return joint, context

    def total(model, u):
        (joint, context), t, out = model, chars(u), 0.0
        for i in range(order, len(t)):
            p = 1 / 256
            for n in range(order + 1):
                p = (joint[t[i - n : i], t[i]] + strength * p) / (context[t[i - n : i]] + strength)
            out += math.log(p)
        return out, len(t) - order

    (a, n), (b, _) = total(counts(accepted), url), total(counts(rejected), url)
    return (a - b) / n


def test_url_scores_equal_plain_counts(spark):
    good, bad = [f"good{i % 7}.org/article/{i}" for i in range(60)], [f"casino{i % 5}.biz/BET/{i}" for i in range(50)]
    rows = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad] + [(None, 1), ("x", None)], "body string, label int")
    p = U.UrlModelParams(holdout=3)
    model = U.fit_url_model(rows, p)
    held = {r["body"] for r in rows.where("body is not null").where(U._fold(F.col("body"), p)).collect()}
    a, b = [u for u in good if u not in held], [u for u in bad if u not in held]
    tests = ["good3.org/article/9", "casino.biz/bet", "", "other.net/a/b?c", "x" * 5000]
    for url, got in zip(tests, model.scores([t.encode() for t in tests])):
        assert got == pytest.approx(brute_url_score(a, b, url), abs=1e-4)


def test_url_filter_keeps_repeated_ids(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://b.net/es/"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    got = sorted((r["page_id"] or 0, r["rule"] or "") for r in U.judge_urls(df, URL_RULES).collect())
    assert got == [(0, ""), (1, "com/"), (1, "com/"), (1, "net/es/")]
