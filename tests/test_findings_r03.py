"""What the third review found: odd rows, and work that has to stay proportional to the input."""

from pyspark.sql import functions as F

from tillage.functions import text as T
from tillage.operators import assistant as A


def test_clipping_before_line_ends(spark):
    ends = ["\n", "\r\n", "\u0085", " ", "\n\n", " \n"]
    rows = [(i, ("word " * 178 + "lastlonger")[: 900 - len(e)] + e + "rest of it") for i, e in enumerate(ends)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, t string").select("i", T.clip_at_word(F.col("t")).alias("c")).collect()}
    for i, t in rows:
        head = t[:900]
        cut = head.rstrip(" \t\n\f\r")
        if cut == head:
            cut = head[: max(head.rfind(c) for c in " \t\n\f\r")].rstrip(" \t\n\f\r")
        assert got[i] == cut + "…", repr(ends[i])


def test_contexts_on_odd_crops(spark):
    """Newest first, own names before shown ones, the longest name; a user's list is made once, and only where it is asked for."""
    crops = [
        (1, 1, "maiz", "", None, 1), (1, 2, "MAÍZ", "Milpa", "activo", 3), (1, 3, "papa", "Maiz", None, 2), (1, 4, "chile", "", "inactivo", 9),
        (1, 5, None, "", None, 8), (1, 6, "x", "ñ", None, 7), (2, 7, "trigo", None, None, 1),
    ]
    crops = spark.createDataFrame(crops, "user_id long, crop_id long, crop_name string, display_name string, status string, created long")
    messages = [(1, 1, "¿Mi MAIZ?", "unknown"), (1, 2, "la milpa", "unknown"), (1, 3, "chile", "unknown"), (2, 4, "agua", "unknown"), (2, 5, "agua", "garbage"), (3, 6, "trigo", "unknown"), (1, 7, None, "unknown")]
    messages = spark.createDataFrame(messages, "user_id long, n long, text string, intent string")
    got = A.contexts(messages, crops, ["chile", "trigo"], {"names": lambda a: F.array_join(a, ",", "?")})
    assert [tuple(r) for r in got.orderBy("n").select("n", "n_active", "target_id", "requested", "source", "conflict", "names").collect()] == [
        (1, 5, 2, None, "explicit", False, "?,ñ,Milpa,Maiz,Maiz"), (2, 5, 2, None, "explicit", False, "?,ñ,Milpa,Maiz,Maiz"), (3, 5, None, "chile", "none", True, "?,ñ,Milpa,Maiz,Maiz"),
        (4, 1, 7, None, "fallback_single_crop", False, "Trigo"), (5, 1, None, None, "none", False, "Trigo"), (6, 0, None, "trigo", "none", True, ""),
        (7, 5, None, None, "none", False, "?,ñ,Milpa,Maiz,Maiz"),
    ]
    assert "collect_list(_e" not in A.contexts(messages, crops, [], {})._jdf.queryExecution().toString()
    assert A.contexts(messages, crops, []).orderBy("n").first()["active"] == [None, "ñ", "Milpa", "Maiz", "Maiz"]


def test_readings_fan_out_evenly(spark):
    """Chunks of crops and salted readings give the rows of the plain join; metrics are rounded once a reading."""
    from tillage.operators import dashboard as D

    names = ["reading_id", "user_id", "crop_id", *D.RANGES]
    readings = spark.createDataFrame([(i, i % 3 if i % 11 else None, i % 9 if i % 4 == 0 else None, *[None if i % 5 == 0 else i * 7.0 - 90 + j for j in range(len(D.RANGES))]) for i in range(60)],
                                     "reading_id long, user_id long, crop_id long, " + ", ".join(f"{m} double" for m in D.RANGES))
    crops = spark.createDataFrame([(k % 3, k, [None, "activo", "inactivo"][k % 5 % 3]) for k in range(40)] + [(1, 4, None), (None, 3, None)], "user_id long, crop_id long, status string")
    want = []
    for r in readings.collect():
        if any(r[m] is not None for m in D.RANGES):
            values = [None if r[m] is None else min(max(r[m], D.RANGES[m][0]), D.RANGES[m][1]) for m in D.RANGES]
            for c in crops.collect():
                if c["user_id"] is not None and c["user_id"] == r["user_id"] and (c["status"] in (None, "activo") if r["crop_id"] is None else c["crop_id"] == r["crop_id"]):
                    want.append((r["reading_id"], r["user_id"], c["crop_id"], *values))
    for chunk, salts in ((2, 3), (1000, 16)):
        got = D.fanned_out(readings, crops, chunk=chunk, salts=salts).select(*names).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_nearest_with_many_ties(spark):
    """Chunks of vectors keep the best by score and id, whatever ties at the end."""
    import numpy as np

    from tillage.operators import dense

    rng = np.random.default_rng(3)
    for most in (7, 64):
        best = dense.Best(5, 4, most)
        x = rng.integers(-1, 2, (300, 3)).astype(float)
        q = rng.integers(-1, 2, (5, 3)).astype(float)
        ids = rng.permutation(300)
        for i in range(0, 300, 50):
            best.add(np.arange(5), ids[i : i + 50], q, x[i : i + 50])
        who, found, scores = best.rows()
        s = np.maximum(0, q @ x.T)
        want = [(i, int(v), float(s[i, at])) for i in range(5) for at, v in sorted(enumerate(ids.tolist()), key=lambda t: (-s[i, t[0]], t[1]))[:4]]
        assert list(zip(who.tolist(), found.tolist(), scores.tolist())) == want


def test_occurrences_on_odd_texts():
    """Bytes of many texts, cut at any place, give what a search with look-around gives in each text."""
    import random
    import re

    import pyarrow as pa

    from tillage.functions.words import occurrences

    rng = random.Random(5)
    terms = ["the", "of the", "n", "p", "materia organica", "materia", "the the", "a_1", "a-b", "", " the", "the  the", "ñu", "the"]
    bits = ["the", "of", "n", "p", "materia", "organica", "a_1", "a", "b", " ", " ", " ", "-", "ñ", "漢", "😀", "_", "1", "\n", "  "]
    texts = [None, "", "the", "", None, "ñthe", "thé", "thé", "n"] + ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)] + ["", None]
    fine = [(i, t) for i, t in enumerate(terms) if re.fullmatch("[a-z0-9_]+( [a-z0-9_]+)*", t)]
    want = sorted((r, i, m.start()) for r, x in enumerate(texts) for i, t in fine for m in re.finditer(f"(?<![a-z0-9_])(?={t}(?![a-z0-9_]))", x or ""))
    for column in (pa.array(texts, pa.string()), pa.array(["of the", *texts], pa.large_string())[1:]):
        for block in (1, 2, 7, 1 << 20):
            assert sorted(x for found in occurrences(column, terms, block) for x in zip(*(a.tolist() for a in found))) == want
    assert not list(occurrences(pa.array([], pa.string()), terms)) and not list(occurrences(pa.array([None, ""]), terms)) and not list(occurrences(pa.array(["the"]), []))


def test_entities_leave_the_scan_alone(spark):
    """Only occurrences leave the stage that normalises a text: nothing is exploded or joined, and no text is worked out again."""
    from tillage.operators import entities as E

    docs = spark.createDataFrame([(1, "Roya en MAÍZ, mosca blanca"), (None, "n p"), (2, None), (3, "")], "doc_id long, text string")
    found = E.entities(docs, E.TAXONOMY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "CULTIVO", "maiz", 8), (1, "PLAGA", "mosca blanca", 14), (1, "PLAGA", "roya", 0), (None, "NUTRIENTE", "n", 0), (None, "NUTRIENTE", "p", 2)]
    assert E.entities(docs, {}).collect() == [] and E.entities(docs.where("doc_id = 9"), E.TAXONOMY).collect() == []


def test_spans_without_an_id_count_once(spark):
    """What both recognisers mark is one span also where the id is null, as in SQL's UNION."""
    from tillage.operators import entities as E

    row = "doc_id long, type string, value string, start long"
    found = spark.createDataFrame([(None, "A", "the", 0), (1, "A", "the", 4)], row)
    more = spark.createDataFrame([(None, "A", "the", 0), (1, "A", "two", 4), (1, "A", "the", 9), (1, "A", "the", 9), (1, "B", "the", 4)], row)
    got = sorted(map(tuple, E.with_phrases(found, more).collect()), key=str)
    assert got == [(1, "A", "the", 4), (1, "A", "the", 9), (1, "B", "the", 4), (None, "A", "the", 0)]


def test_synonyms_are_looked_for_where_they_occur(spark):
    """Rules in order over earlier output; a text without a rule's words is not searched for its pattern."""
    import re

    rules = {"zea mays": "maiz", "maiz": "grano", "a.b": "x$1\\y", "elote": "maiz", "temp": "temperatura", "x": "zea mays", "no": "$0"}
    texts = [None, "", "zea mays elote", "a.b acb", "temperature temp", "x elote x", "zea  mays", "no nono no", "maizal maiz,maiz", "zea mays" * 3]

    def plain(t):
        for k, v in sorted(rules.items(), key=lambda kv: (-len(kv[0]), kv[0])):
            t = re.sub(rf"\b{re.escape(k)}\b", lambda _: v, t)  # noqa: B023
        return t

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.synonyms_applied(F.col("t"), rules).alias("t"), T.synonyms_applied(F.col("t"), {}).alias("same"))
    rows = {r["i"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["same"] == t and rows[i]["t"] == (None if t is None else plain(t))
    assert got._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") == 1


def test_words_of_odd_texts():
    import random
    import re

    import pyarrow as pa

    from tillage.functions.words import split

    rng = random.Random(6)
    texts = [None, "", "a", "b", "ñ", "añb", None] + ["".join(rng.choices("ab_1 -ñ漢😀\n", k=rng.randrange(30))) for _ in range(200)] + [""]
    want = [re.findall("[a-z0-9_]+", t or "") for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["x y", *texts])[1:]):
        for block in (1, 3, 1 << 20):
            words, counts = split(column, block)
            assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]
    assert split(pa.array([], pa.string()))[1].tolist() == [] and split(pa.array([None, ""]))[1].tolist() == [0, 0]


def test_index_holds_each_word_once(spark, monkeypatch):
    """A build reads the texts once and stores a number a word, with a document's id and length once a chunk; ids of any type."""
    import os

    import pyarrow as pa

    from tillage.operators import lexical
    from tillage.operators import lexindex as X
    from tillage.session import scratch

    texts = [None, "", "Uno dos uno", "dos", "ñ", "tres UNO", "¿uno? dos_1 dos"] * 5
    rows = [(f"d{i:02}", t) for i, t in enumerate(texts)]
    docs, at = spark.createDataFrame(rows, "doc_id string, text string"), f"{scratch(spark)}/index"
    X.build_index(docs, at, params=X.IndexParams(parts=3, chunk=4))
    assert sorted(os.listdir(at.removeprefix("file://"))) == ["gone", "meta", "postings"]
    index = X.Index(spark, at)
    stored = index.postings.where("term <> ''").selectExpr("chunk", "explode(words) AS word")
    total = index.chunks.selectExpr("sum(aggregate(dls, 0, (a, x) -> a + x)) AS n", "sum(size(ids)) AS docs").first()
    assert stored.count() == stored.distinct().count() == total["n"] == 50 and total["docs"] == 35
    queries = [(1, "uno"), (2, "dos tres dos"), (3, "dos_1")]
    for fresh in ([], [("d02", "tres tres"), ("new", "dos")]):
        if fresh:
            X.update_index(spark, at, spark.createDataFrame(fresh, "doc_id string, text string"), docs.where("doc_id = 'd03'"))
        live = {**{k: v for k, v in rows if not fresh or k != "d03"}, **dict(fresh)}
        want = lexical.bm25(spark.createDataFrame(list(live.items()), "doc_id string, text string"), queries, k=4).collect()
        assert sorted(map(tuple, X.search_index(spark, at, queries, k=4, first=1).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(X, "CHUNK_BYTES", 5)
    assert list(X._chunks(pa.array(["ab", "ñ", "abcdefgh", "", "", "abc", "ab", "a"]), 3)) == [(0, 2), (2, 3), (3, 6), (6, 8)]
