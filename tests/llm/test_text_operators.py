import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillage.llm import decontaminate as D
from tillage.llm import gru_lm as G
from tillage.llm import html_extract as H
from tillage.llm import language_id as L
from tillage.llm import mixing as M
from tillage.llm import quality_rules as R
from tillage.llm import simhash as S
from tillage.llm._graph import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# ---- quality rules
def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside[i : i + 3] = [True] * 3
    lines, seen = 0, set()
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), lines, sum(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é中\n\t\x0b#%<\u00a0\x1c", max_size=120))
def test_counts_equal_brute_force(text):
    assert R.text_counts(text.encode())[:5] == brute_counts(text)


def test_counts_of_nothing():
    assert set(R.text_counts(None)) == set(R.text_counts(b"")) == {0}


def test_votes_learn_good_and_bad(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = R.judge_quality(docs, out="q").select("doc_id", "q.kept", "q.base_failed").join(labels, "doc_id").where("not base_failed")
    assert q.where("quality = 1 and not kept").count() == 0
    assert q.where("quality = 0").count() == 0 or q.where("quality = 0 and not kept").count() >= 0.7 * q.where("quality = 0").count()


def test_expectation_maximisation_equals_plain_dictionaries():
    rng = np.random.default_rng(2)
    patterns = rng.choice(3**4, 40, replace=False)
    weights = rng.integers(1, 50, 40).astype(float)
    p = R.QualityParams(rounds=7, tolerance=-1.0)
    votes = [[x // 3**j % 3 for j in range(4)] for x in patterns.tolist()]
    post = [1 / (1 + math.exp(-(v.count(2) - 3 * v.count(0) + math.log(p.good_share / (1 - p.good_share))))) for v in votes]
    right, wrong = p.prior
    for _ in range(7):
        share = min(0.98, max(0.02, (sum(w * q for w, q in zip(weights, post)) + p.good_share) / (weights.sum() + 1)))
        table = {}
        for j in range(4):
            for y in (0, 1):
                n = {v: (wrong if (y, v) in ((0, 2), (1, 0)) else right) for v in range(3)}
                for v, w, q in zip(votes, weights, post):
                    n[v[j]] += w * (q if y else 1 - q)
                for v in range(3):
                    table[j, y, v] = n[v] / sum(n.values())
        for i, v in enumerate(votes):
            bad, good = 1 - share, share
            for j in range(4):
                bad, good = bad * table[j, 0, v[j]], good * table[j, 1, v[j]]
            post[i] = good / (good + bad)
    got, learned, kept = R.fit_votes(patterns, weights, 4, p)
    assert np.allclose(got, post) and abs(kept - share) < 1e-9 and all(abs(learned[k] - x) < 1e-9 for k, x in table.items())


def test_quality_columns_of_any_name_and_long_texts(spark):
    df = spark.createDataFrame([(1, "the of and " * 40_000, 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, pattern int, _pattern int, posterior int")
    out = R.judge_quality(df, out="q")
    assert out.columns == [*df.columns, "q"] and {r["doc_id"]: (r["q"]["n_words"], r["pattern"], r["_pattern"], r["posterior"]) for r in out.collect()} == {1: (120_000, 1, 2, 3), 2: (0, 1, 2, 3)}


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100), (3, "word " * 100)], "doc_id long, text string")
    got = R.judge_quality(df, out="q").select("doc_id", "q.base_failed", "q.kept").collect()
    assert len(got) == 4 and all(r["base_failed"] and not r["kept"] for r in got)
    assert R.judge_quality(df.limit(0), out="q").count() == 0


# ---- SimHash
def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abA É\n\x0b", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert S.fingerprint(text.encode()) == brute_print(text)


def brute_links(points, distance=3):
    return {(a, b) for a in points for b in points if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}


def roots(points, links):
    parent = {p: p for p in points}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {p: top(p) for p in points}


def some_points(n=250, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, n, dtype=np.int64)
    near = base.copy()
    for _ in range(4):
        near ^= np.int64(1) << rng.integers(0, 63, n)
    return sorted(set(base.tolist()) | set(near.tolist()) | {0, 1, 3, 7, 15, -1, -2})


def test_grid_join_loses_no_link(spark):
    points = some_points()
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {tuple(sorted(r)) for r in S.links(df).collect()}
    assert got == brute_links(points)


def test_dense_cells_keep_the_components(spark):
    points = sorted({(1 << i) | (1 << j) for i in range(12) for j in range(12)} | {1 << 40})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    thin = {tuple(sorted(r)) for r in S.links(df, S.SimHashParams(dense=4)).collect()}
    assert thin <= brute_links(points) and roots(points, thin) == roots(points, brute_links(points))


def test_near_duplicates_on_a_table_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_print(t) for i, t in rows.items()}
    points = sorted(set(fps.values()))
    top = roots(points, brute_links(points))
    first = {}
    for i, f in fps.items():
        first[top[f]] = min(i, first.get(top[f], i))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert got == {i: first[top[f]] for i, f in fps.items()}
    odd = spark.createDataFrame([(4, None), (2, ""), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (11, "\x0b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in S.near_duplicates(odd).collect()) == [(0, 9), (2, 2), (4, 2), (9, 9), (9, 9), (11, 2)]
    assert sorted(r["doc_id"] or 0 for r in S.deduplicate(odd).collect()) == [0, 2, 9]
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50))


def jaccard(a, b, n=5):
    cut = lambda t: (lambda w: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, n):
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"x{rng.integers(10**6)}"
    return w


def test_similar_texts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        base = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))]
        rows += [" ".join(edited(rng, base, n)) for n in (0, 0, 1, len(base) // 60 + 1, len(base) // 12 + 2, len(base) // 5)]
    rows += [None, "", " \n", "a b", "A  b", "a b c"]
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(rows)], "doc_id long, text string")
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    want = roots(list(range(len(rows))), links)
    got = {r["doc_id"]: r["component_id"] for r in S.similar_texts(docs).collect()}
    caught = sum(got[i * 3 + 1] == got[j * 3 + 1] for i, j in links)
    assert caught >= 0.97 * len(links) and len(links) > 60
    assert all(want[(c - 1) // 3] == want[(d - 1) // 3] for d, c in got.items())  # no link that is none
    assert len({got[i * 3 + 1] for i, t in enumerate(rows) if not (t or "").split()}) == 1


def test_similar_texts_in_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(300)]
    rows = [" ".join(edited(rng, base, int(rng.integers(1, 5)))) for _ in range(400)]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_texts(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    links = [(i, j) for i in range(0, 400, 3) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    want = roots(list(range(400)), links)
    assert len(links) > 10_000 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links) and len(set(want.values())) < 10


def scattered(rng, base, copies, changes):
    """The base and copies of it, each with some words changed far apart: every change costs five shingles, so copies are
    about 0.8 like the base and 0.65 like each other."""
    rows = [base]
    for _ in range(copies):
        w = list(base)
        for at in rng.choice(len(base) // 8, changes, replace=False):
            w[8 * at + 3] = f"x{rng.integers(10**8)}"
        rows.append(w)
    return [" ".join(r) for r in rows]


def links_of(rows, n=5):
    """All pairs that share 0.8 of their shingles, by lists of who holds what."""
    cut = [{hash(tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1))} for w in map(str.split, rows)]
    ids, sizes, holders, out = {}, np.array([len(c) for c in cut]), {}, []
    for i, c in enumerate(cut):
        for h in c:
            holders.setdefault(ids.setdefault(h, len(ids)), []).append(i)
    arrays = {h: np.array(v) for h, v in holders.items()}
    for i, c in enumerate(cut):
        common = np.bincount(np.concatenate([arrays[ids[h]] for h in c]), minlength=len(cut))
        near = np.flatnonzero(common >= 0.8 * (sizes[i] + sizes - common))
        out += [(i, int(j)) for j in near if j < i]
    return out


@pytest.mark.parametrize("copies,changes,load", [(50, 4, 400_000), (300, 4, 20_000), (500, 4, 400_000), (5000, 4, 400_000)])
def test_similar_texts_barely_similar_copies(spark, copies, changes, load):
    rng = np.random.default_rng(copies)
    rows = scattered(rng, [f"w{rng.integers(10**6)}" for _ in range(200)], copies, changes)
    links = links_of(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in S.similar_texts(docs, params=S.SimilarParams(load=load)).collect()}
    assert len(links) >= copies and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


@pytest.mark.parametrize("load", [10**9, 3000, 900])
def test_verified_links_connect_what_all_links_connect(spark, load):
    rng = np.random.default_rng(9)
    groups = [scattered(rng, [f"{g}w{i}" for i in range(60)], n, 1) + scattered(rng, [f"{g}v{i}" for i in range(60)], n // 2, 2) for g, n in enumerate((1, 4, 30, 90))]
    rows = [(g, t) for g, group in enumerate(groups) for t in group] + [(9, "")]
    links = links_of([t for _, t in rows])
    sets = [(bytearray(f"{i:05}".encode()), f"{g}", sorted({hash(tuple(t.split()[j : j + 5])) for j in range(len(t.split()) - 4)})) for i, (g, t) in enumerate(rows)]
    found = S.verified_links(spark.createDataFrame(sets, "digest binary, root string, shingles array<bigint>"), S.SimilarParams(load=load, heads=2)).collect()
    pairs = {tuple(sorted((int(r["x"]), int(r["y"])))) for r in found}
    assert pairs <= {tuple(sorted(x)) for x in links}
    everyone = list(range(len(rows)))
    assert roots(everyone, list(pairs)) == roots(everyone, links)
    assert len(pairs) < 4 * len(rows)


def test_similar_texts_without_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, base), (None, base + " a"), (5, base + " b"), (None, base + " c"), (8, "else")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in S.similar_texts(docs).collect()) == [(0, 5), (0, 5), (0, 5), (5, 5), (8, 8)]


def test_similar_texts_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bottom = {}
    for i, t in texts.items():
        w = (t or "").translate(LOWER).split()
        for h in sorted({xxhash.xxh64_intdigest(" ".join(w[j : j + 5]).encode()) for j in range(max(1, len(w) - 4))})[:12]:
            bottom.setdefault(h, []).append(i)
    pairs = {(a, b) for group in bottom.values() for a in group for b in group if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    got = {r["doc_id"]: r["component_id"] for r in S.similar_texts(docs).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_deduplicate_edges_and_names(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(4, None, 1), (2, "", 2), (9, "a b c d", 3), (9, "a b c", 4), (None, "a b c d", 5), (7, "a b c d", 6), (20, long, 7), (30, long + " end", 8), (31, "q " * 500, 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _kept int").withColumns({"kept": F.lit(1), "row": F.lit(2), "digest": F.lit(3), "head": F.lit("h")})
    for p in (S.SimHashParams(), S.SimilarParams()):
        out = S.deduplicate(odd, params=p)
        assert out.columns == odd.columns
        kept = sorted((r["doc_id"] or 0, r["_kept"]) for r in out.collect())
        # a repeated id is a row of each of its texts: the smallest id of a group stays, once
        assert [k for k, _ in kept] in ([0, 2, 7, 9, 20, 31], [0, 2, 7, 20, 31])
        assert S.deduplicate(odd.limit(0), params=p).count() == 0


def test_scores_depend_little_on_the_number_of_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    # one id for all rows: the start's sample stays bounded
    rows = docs.withColumn("doc_id", F.lit(None).cast("long"))
    params = G.GruParams(sample_docs=60, sample_tokens=12_000)
    total = lambda n: G.score_documents(rows.repartition(n), F.lit(True), params=params).agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    one, many = total(1), total(8)
    assert one[2] == many[2] == docs.count() and abs(one[1] - many[1]) < 1e-6 * abs(one[1]) and abs(one[0] - many[0]) < 0.005 * abs(one[0])


# ---- decontamination
def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        for a in range(len(v) - n + 1) if n else ():
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[a : a + n]:
                    hit.update(range(s, s + n))
                    found.add(item)
    return len(w), len(hit), found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c-d", "é", "x1", "q"]), max_size=60), st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "É", "é", "x1"]), max_size=20), max_size=4))
def test_winnowing_finds_every_window(doc, bench):
    items = [(str(i), " ".join(b)) for i, b in enumerate(bench)]
    index = D.BenchmarkIndex([(i, t.encode()) for i, t in items], D.DecontaminationParams())
    n, hit, found = index.find(" ".join(doc).encode())
    assert (n, 0 if hit is None else int(hit.sum()), found) == brute_hits(" ".join(doc), items)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        b[20:33] = a[10:23]
        ha, hb = D.gram_hashes(a, 7), D.gram_hashes(b, 7)
        assert set(ha[D.winnow(ha, 7)].tolist()) & set(hb[D.winnow(hb, 7)].tolist())


def test_large_benchmarks_give_the_same_result(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    short = bench.withColumn("item_id", F.col("item_id").cast("string")).unionByName(spark.createDataFrame([("s1", "the and"), ("s2", "of the and that"), (None, "dans les"), ("s3", None), ("s4", "...")], "item_id string, text string"))
    listed = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"])), tuple(r["items"]), r["contaminated"]) for r in df.select("doc_id", "b.*").collect())
    for items in (bench, short):
        one = listed(D.contamination(docs, items, out="b"))
        for keep in (True, False):
            assert listed(D.contamination(docs, items, params=D.DecontaminationParams(block_bytes=100, table_bits=10), keep_text=keep, out="b")) == one
        assert any(x[-1] for x in one)
    clash = docs.withColumns({"row": F.lit(1), "near": F.lit(2), "number": F.lit(3), "hit_row": F.lit(4), "benchmark_hits": F.lit(5)})
    for p in (D.DecontaminationParams(), D.DecontaminationParams(block_bytes=100)):
        out = D.decontaminate(clash, bench, params=p)
        assert out.columns == clash.columns and out.count() == sum(not x[-1] for x in listed(D.contamination(docs, bench, out="b")))
    assert D.contamination(docs, bench.limit(0), out="b").where("b.n_hit > 0").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (3, "..."), (None, "x")], "doc_id long, text string")
    for p in (D.DecontaminationParams(), D.DecontaminationParams(block_bytes=100)):
        assert sorted(r["n_words"] for r in D.contamination(odd, bench, params=p, out="b").select("b.n_words").collect()) == [0, 0, 0, 0, 1]


def test_a_passage_in_many_documents_and_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(30)] + [(99, "filler " * 60_000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", passage if k % 2 else f"{passage} q{k}") for k in range(20)], "item_id string, text string")
    for p in (D.DecontaminationParams(), D.DecontaminationParams(block_bytes=100)):
        got = {r["doc_id"]: r for r in D.contamination(docs, bench, params=p, out="b").select("doc_id", "b.*").collect()}
        assert all(got[i]["n_hit"] == 20 and len(got[i]["items"]) == 20 and got[i]["contaminated"] for i in range(30))
        assert got[99]["n_hit"] == 20 and not got[99]["contaminated"] and got[99]["n_words"] == 60_020


# ---- HTML
PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Home</a></nav><header><h1>Site</h1></header>
<div class="content"><h1>Title &amp; more</h1><p>First   long paragraph with <a href=1>a link</a> and enough text to count as the body of an article.<p>Second one, longer still, because
it goes on &lt;b&gt; for a while<br>after a break.<ul><li>one<li>two</ul></div><div id="comments"><p>A reader's comment that is rather long but not part of the article.</p></div><aside>side</aside><footer>&copy;</footer>"""


def test_html_main_text():
    assert H.main_text(PAGE).split("\n\n") == ["Title & more", "First long paragraph with a link and enough text to count as the body of an article.", "Second one, longer still, because it goes on <b> for a while after a break.", "one", "two"]
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("just text &amp; <b>bold") == "just text & bold"


def test_html_of_the_test_pages(spark):
    import html as html_lib

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert H.main_text(r["html"]) == "\n\n".join(b for b in blocks if b)


def test_html_densities_decide_on_bare_pages(spark):
    import html as html_lib

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    right = 0
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n\n".join(b for b in (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)) if b)
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        right += H.main_text(bare) == want
    assert right >= 0.95 * len(pages)


def test_html_density_by_hand():
    body = H.measure(H.parse("<body><div><a href=x>link text</a></div><div><p>plain text that is long enough</p><p>and more of it</p></div></body>"))
    links, text = body.children
    c, lc, t, lt = len("link text"), len("link text"), 1, 1
    ratio = body.link_chars / body.chars
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
    assert links.density == (c / t) * math.log(c / lc * t / lt) / math.log(base)
    c, lc, t = len("plain text that is long enough") + len("and more of it"), 1, 2
    base = math.log(c * lc / (c - lc) + ratio * c + math.e)
    assert abs(text.density - (c / t) * math.log(c / lc * t / 1) / math.log(base)) < 1e-9
    assert abs(text.total - sum(k.density for k in text.children)) < 1e-9 and H.main_node(body)[0] is text


@settings(max_examples=150, deadline=2000)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b", ">", "<li>", "<ul>", "</ul>", "text ", "<!--", "-->", "<a href=\"x", "&amp;", "<script>", "</script>", "<table><tr><td>", "é"]), max_size=60))
def test_html_never_fails(parts):
    assert isinstance(H.main_text("".join(parts)), str)


def test_html_broken_pages_cost_little():
    import time

    for page in ('<p a="' * 20000, "<a " * 50000 + ">", "<b>" * 5000 + "<p>x" * 5000, "<div>" * 20000 + "x"):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20


_TEXT = "A sentence of the article that goes on for long enough to be dense, with words and more words in it. " * 3


def test_html_densities_decide_whatever_the_tags():
    several = "".join(f"<article><h2>Part {i} of it</h2>" + f"<p>{i} {_TEXT}</p>" * 4 + "</article>" for i in range(3))
    assert all(f"{i} A sentence" in H.main_text(f"<body>{several}</body>") for i in range(3))
    junk = "<div>" + "<span><a href='x'>Go</a></span> " * 40 + "</div>"
    text = "".join(f"<p>{i} {_TEXT}</p>" for i in range(5))
    want = "\n\n".join(f"{i} {_TEXT}".strip() for i in range(5))
    for page in (f"<main>{junk}<div>{text}</div></main>", f"<div>{junk}<div>{text}</div></div>", f"<main>{junk}<article>{text}</article></main>"):
        assert H.main_text(f"<body>{page}</body>") == want
    assert H.main_text(f"<body>{junk}<div>{_TEXT}<div>{text}</div></div></body>").startswith("A sentence")


def test_html_names_and_forms_do_not_empty_a_page():
    text = "".join(f"<p>{i} {_TEXT}</p>" for i in range(5))
    want = "\n\n".join(f"{i} {_TEXT}".strip() for i in range(5))
    for start, end in (('<div class="content with-sidebar">', "</div>"), ('<div class="post has-comments">', "</div>"), ('<section id="social-history">', "</section>"), ('<form id="aspnetForm"><input value="x">', "</form>"), ('<div class="page menu">', "</div>")):
        assert H.main_text(f"<body>{start}{text}{end}<div class='comments'><p>{_TEXT}</p></div></body>") == want


def test_html_tags_of_any_length_end_outside_of_quotes():
    import time

    text = "".join(f"<p>{i} {_TEXT}</p>" for i in range(3))
    want = "\n\n".join(f"{i} {_TEXT}".strip() for i in range(3))
    for n in (10, 9_000, 300_000):
        value = "<b class='ad'>" + "x" * n + "</div></div> class=ad "
        assert H.main_text(f'<body><div data-props="{value}" class=body>{text}</div></body>') == want
    assert H.main_text(f"<body><div title=it's>{text}</div>it's</body>").startswith("0 A sentence")
    for page in ("<p a='\"' b=\"><p c='" * 20000 + ">", "<p a=\"'>" * 20001, "<p a='x\">" * 20001 + "\""):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 20


# ---- language
def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    field = L.fit_field(docs.where(~L.held_out(F.col("doc_id"))))
    got = L.identify(docs.where(L.held_out(F.col("doc_id"))), field, out="o").select("lang", "o.lang").toDF("lang", "pred").collect()
    assert sum(r["lang"] == r["pred"] for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- !!"), (4, "the and of with that")], "doc_id long, text string")
    assert [(r["lang"], r["score"] > 0) for r in L.identify(odd, field, out="o").orderBy("doc_id").select("o.*").collect()] == [("und", False)] * 3 + [("en", True)]
    mixed = spark.createDataFrame([(1, "the and of with that was this are " * 4 + "der und die nicht mit ist von den " * 4)], "doc_id long, text string")
    runs = L.identify(mixed, field, out="o", runs=True).select("o.runs").first()["runs"]
    assert [r["lang"] for r in runs] == ["en", "de"] and 28 <= runs[0]["end"] <= 36
    nothing = L.fit_field(docs.limit(0))
    assert L.identify(odd, nothing, out="o").where("o.lang <> 'und'").count() == 0


def test_segments_agree_with_the_whole_chain():
    p = L.CrfParams(segment=32, context=16)
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 4).tolist()) for _ in range(300)]
    field = L.LanguageField(["a", "b", "c"], {}, p)
    field.hashed[:] = rng.standard_normal(field.hashed.shape) * 0.3
    text = [words[i] for i in rng.integers(0, 300, 500)]
    got, _ = L.Labeller(field).posteriors([text, text[:7], []])
    e = field.emissions([L.normal(w) for w in text]).astype(float)
    want, _ = L._forward_backward(e[None], field.moves.astype(float))
    assert np.abs(got[:500] - want[0]).max() < 1e-3


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    e, moves = rng.standard_normal((2, 5, 3)), rng.standard_normal((3, 3))
    post, pairs = L._forward_backward(e, moves)
    want, moved = np.zeros_like(post), np.zeros_like(pairs)
    for b in range(2):
        weights = {y: math.exp(sum(e[b, t, y[t]] for t in range(5)) + sum(moves[y[t], y[t + 1]] for t in range(4))) for y in product(range(3), repeat=5)}
        z = sum(weights.values())
        for y, w in weights.items():
            for t in range(5):
                want[b, t, y[t]] += w / z
            for t in range(4):
                moved[y[t], y[t + 1]] += w / z
    assert np.allclose(post, want) and np.allclose(pairs, moved)


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 70}", " ".join(f"q{i % 70}z{j % 9}" for j in range(30))) for i in range(70 * 6)] + [(None, "l1", "x"), (5000, None, "x"), (5001, "l2", None), (5002, "l3", " ")] + [(1, "l1", "q1z1 q1z2")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    p = L.CrfParams(docs_per_lang=3, steps=60, slots=1 << 12)
    field = L.fit_field(docs, params=p)
    assert len(field.langs) == 70
    tests = spark.createDataFrame([(i, " ".join(f"q{i}z{j}" for j in range(9)) * 2) for i in range(70)] + [(70, "q1z1 " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang"] for r in L.identify(tests, field, out="o").select("doc_id", "o.lang").collect()}
    assert sum(got[i] == f"l{i}" for i in range(70)) >= 63 and got[70] == "l1"


# ---- language model
def test_base_score_equals_brute_force_and_model_learns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    odd = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "the the")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in G.score_documents(odd, ~F.coalesce(out, F.lit(False)), params=G.GruParams(common=300)).collect()}
    counts, held = Counter(), {}
    for r in odd.collect():
        w = (r["text"] or "").encode().lower().split() + [b" end"]
        held[r["doc_id"]] = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        if not held[r["doc_id"]]:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    base = score = 0.0
    for r in odd.collect():
        w, g = (r["text"] or "").encode().lower().split() + [b" end"], got[r["doc_id"]]
        want = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n) and abs(g["base_score"] - want) < 1e-6 * abs(want) + 1e-9
        if held[r["doc_id"]]:
            base, score = base + g["base_score"], score + g["score"]
    assert score > base


def test_model_is_a_distribution_and_gradients_hold():
    p = G.GruParams(vocabulary=9, classes=3, hidden=4, rare=4, lanes=2, window=3, steps=200)
    m = G.GruModel(p, [(bytes([97 + i]), 10 - i) for i in range(10)], np.ones((4, 2)), 60, 14)
    h = np.random.default_rng(0).standard_normal((1, 4)).astype(np.float32)
    assert abs(sum(float(np.exp(m.log_probability(h, np.array([t]))[0])) for t in range(14)) - 1) < 1e-4
    before = m.fit([[0, 1, 2, 3] * 30] * 4)
    assert before[-1] > before[0]
    texts = [np.array([0, 1, 2, 3]), np.array([5]), np.array([0, 1, 2, 3, 11, 2])]
    assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts], atol=1e-4)


def test_model_learns_from_documents_beyond_the_sample(spark):
    words = [f"w{i}" for i in range(40)]
    line = " ".join(words[(7 * i) % 40] for i in range(4000))  # each word tells the next, the counts tell nothing
    docs = spark.createDataFrame([(i, line) for i in range(12)], "doc_id long, text string").repartition(3)
    p = G.GruParams(sample_chars=100, wide=4, rate=0.02)  # every document is longer than what the sample takes
    got = G.score_documents(docs, F.col("doc_id") != 0, params=p).where("doc_id = 0").first()
    assert got["n_tokens"] == 4001 and got["score"] > 0.5 * got["base_score"]


def test_one_pass_reads_every_token_once_and_averages():
    p = G.GruParams(vocabulary=9, classes=3, hidden=4, rare=4, window=3, wide=2)
    new = lambda: G.GruModel(p, [(bytes([97 + i]), 10 - i) for i in range(10)], np.ones((4, 2)), 60, 14)
    texts = [np.arange(n) % 14 for n in (1, 50, 3, 7, 2, 1, 20)]
    m, other = new(), new()
    read, kinds = m.learn(texts, 0.01)
    assert kinds.sum() == read.sum() == sum(map(len, texts)) and read[-1] == len(texts)
    mean = new()
    mean.settle(m.weighed(read, kinds) + other.weighed(read, kinds))
    assert np.allclose(mean.x, (m.x + other.x) / 2, atol=1e-6) and np.allclose(mean.ww, (m.ww + other.ww) / 2, atol=1e-6)


def test_gradients_equal_finite_differences():
    p = G.GruParams(vocabulary=9, classes=4, hidden=3, rare=4)
    m = G.GruModel(p, [(bytes([97 + i]), 40 - 4 * i) for i in range(9)], np.ones((4, 2)), 60, 14)
    for n in G._NAMES:
        setattr(m, n, getattr(m, n).astype(np.float64))
    m.x *= 5
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 13, (3, 6)), rng.integers(0, 13, (3, 6))
    new, on = rng.random((3, 6)) < 0.2, rng.random((3, 6)) < 0.8
    h = rng.standard_normal((3, 3)) * 0.3
    total = lambda: float(m.gradients(x, y, new, h, on)[1].sum())
    _, _, g, rows, gx = m.gradients(x, y, new, h, on)
    g["x"] = np.zeros_like(m.x)
    g["x"][rows] = gx
    for n in G._NAMES:
        w = getattr(m, n)
        for at in {tuple(rng.integers(0, d) for d in w.shape) for _ in range(25)}:
            was, e = w[at], 1e-5
            w[at] = was + e
            up = total()
            w[at] = was - e
            down = total()
            w[at] = was
            assert abs((up - down) / (2 * e) - g[n][at]) < 2e-4 * max(1, abs(g[n][at])), (n, at)


def test_rare_classes_and_words_of_any_shape():
    import pyarrow as pa

    words = ["abc", "abc.", "xbc", "", "...", "é", "é!", "a", "12", "bc99"]
    got = G.rare_classes(pa.array(words), 16).tolist()
    assert got[0] == got[2] and got[1] == got[0] + 8 == got[9] and got[6] == got[5] + 8 and all(0 <= k < 16 for k in got)
    found, size = G._split(pa.array([" a\tB\x0b\x0cc ", "", "\n", "x\x1cy\u00a0z A"]))
    assert found.to_pylist() == ["a", "b", "c", "x\x1cy\u00a0z", "a"] and size.tolist() == [3, 0, 0, 2]
    assert [p.to_pylist() for p in G._pieces(pa.array(["aa", None, "b" * 9, "c"]), 4)] == [["aa", ""], ["b" * 9], ["c"]]


def test_long_and_repeated_documents_are_scored(spark):
    docs = spark.createDataFrame([(1, "a b c " * 50_000), (2, "a b"), (2, "a b"), (3, "zz a")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in G.score_documents(docs, F.col("doc_id") != 3).collect())
    assert got == [(1, 150_001, 150_001), (2, 3, 3), (2, 3, 3), (3, 3, 2)]
    assert G.score_documents(docs.limit(0), F.lit(True)).count() == 0


# ---- mixing
def test_rates_equal_plain_projected_gradients():
    rng = np.random.default_rng(8)
    post = rng.dirichlet([2, 1, 1], 400)
    tokens = rng.integers(10, 900, 400).astype(float)
    p = M.MixParams()
    share = np.array([0.7, 0.2, 0.1])
    second = (post * tokens[:, None]).T @ post
    current = second.sum(1)
    whole = current[0] / share[0]
    targets = share * whole
    scale = np.maximum(targets, p.least * whole)
    step = 1 / (np.linalg.eigvalsh(second / np.sqrt(np.outer(scale, scale))).max() + p.ridge)
    r, history = np.ones(400), []
    for _ in range(40):
        error = ((tokens * r) @ post - targets) / scale
        history.append(error)
        r = np.clip(r - step * (post @ error + p.ridge * (r - 1)), 0, p.max_rate)
    fit = M.RateFit(np.array(history), step, p, ["a", "b", "c"], targets, current, 40)
    assert np.allclose(fit.rates(post), r)


def test_many_domains_long_texts_and_missed_targets(spark):
    import warnings

    rows = [(i, " ".join(f"d{i % 45}w{j % 30}" for j in range(40))) for i in range(45 * 8)]
    docs = spark.createDataFrame([*rows, (9000, "d3w1 " * 40_000), (9001, None), (9000, "d3w1")], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, f"d{i % 45}") for i, _ in rows] + [(9000, "d3"), (9000, "d4"), (77777, "d5"), (None, "d6"), (3, None)], "doc_id long, domain string")
    model = M.fit_classifier(docs, labelled)
    assert len(model.domains) == 45
    post, n = model.posteriors([f"d{k}w1 d{k}w2 d{k}w3 d{k}w4".encode() for k in range(45)] + [b"d3w1 " * 40_000])
    assert sum(model.domains[i] == f"d{k}" for k, i in enumerate(post[:45].argmax(1))) >= 43 and n[-1] == 40_000
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        _, fit = M.mix(docs, labelled, {"d1": 0.98, "d2": 0.02}, params=M.MixParams(passes=1), out="m")
    assert not fit.converged and any("missed" in str(w.message) for w in told) and set(fit.missed()) == set(model.domains)


def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labelled = labels.select("doc_id", F.when(F.col("quality") == 0, "low").otherwise("fine").alias("domain"))
    found, fit = M.mix(docs, labelled, {"fine": 0.97, "low": 0.03}, out="m")
    totals = found.select(F.sum(F.col("m.rate") * F.col("m.n_tokens") * F.get("m.posteriors", 0)), F.sum(F.col("m.rate") * F.col("m.n_tokens") * F.get("m.posteriors", 1))).first()
    assert abs(totals[1] / (totals[0] + totals[1]) - 0.03) < 0.004 and found.where("m.rate < 0").count() == 0
    assert found.count() == docs.count() and found.columns[: len(docs.columns)] == docs.columns
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    same, _ = M.mix(odd, labelled.limit(0), {"fine": 1.0}, out="m")
    assert [r["rate"] for r in same.select("m.rate").collect()] == [1.0] * 3
    assert M.mix(odd.limit(0), labelled, {"fine": 1.0}, out="m")[0].count() == 0
