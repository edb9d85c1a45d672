"""Token files, vector codes and tokenizer alignment against brute force and exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillage.llm import token_alignment as ta
from tillage.llm import token_files as tf
from tillage.llm import vector_codes as vc
from tillage.llm._common import table
from tillage.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
WORD = tokenizer_file("word_bpe_49k.json")
ODD = [
    (7, "plain words, twice plain"), (7, "plain words, twice plain"), (7, "other"), (None, "no id"), (3, None), (4, ""), (5, " \t\n "),
    (6, "<|endoftext|> x<|startoftext|>"), (-9, "Ünïcode é ́x ＷＩＤＥ 東京 İstanbul ΣΑΣ \x1c!\x1c   \x85 naïve’s"), (8, "a" * 5000), (9, "word " * 3000)
]


def brute_files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_coder_round_trip():
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.integers(0, 70_000), max_size=400), st.integers(1, 9), st.integers(1, 5))
    def run(ids, lanes, segment):
        ids = np.array(ids, np.uint32)
        t = tf.Table(tf.frequencies(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True))))))
        states, places, stream = tf.encode_ids(ids, t, lanes, segment)
        assert (tf.decode_ids(len(ids), states, places, stream, t, segment) == ids).all()
        for g in range(len(states)):  # decoding starts at any checkpoint
            part = tf.decode_ids(len(ids), states, places, stream, t, segment, g, g + 1)
            assert (part == ids[g * lanes * segment : (g + 1) * lanes * segment]).all()

    run()


def test_coder_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 100_000), 40_000).astype(np.uint32)
    n = np.unique(ids, return_counts=True)
    t = tf.Table(tf.frequencies(dict(zip(n[0].tolist(), n[1].tolist()))))
    states, _, stream = tf.encode_ids(ids, t, 64, 10_000)  # one checkpoint
    entropy = -(n[1] * np.log2(n[1] / len(ids))).sum()
    assert stream.nbytes * 8 + states.nbytes * 8 < 1.01 * entropy


def test_frequencies_keep_every_id():
    f = tf.frequencies({1: 10**15, 2: 1, 3: 1})
    assert sum(f.values()) == 1 << 20 and min(f.values()) == 1


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=400))
def test_joined_checksum(a, b):
    assert tf.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_blocks_avoid_the_mark_and_show_damage():
    ids = np.arange(300, dtype=np.uint32) % 7
    t = tf.Table(tf.frequencies({i: 1 + i for i in range(7)}))
    mark = tf.MARK.encode()
    # a piece whose bytes hold the mark
    fields = np.frombuffer(mark + bytes(2 * tf._PIECE.itemsize - len(mark)), tf._PIECE)
    data = tf.pack_block(ids, fields, t, 0, 0, 0, tf.FileParams(lanes=8, segment=4))
    assert mark not in data and (tf.unpack_block(data).ids(t) == ids).all()
    block = tf.unpack_block(data)
    assert (block.from_checkpoint(t, 2, 4) == ids[64:128]).all()
    for at in (len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            tf.unpack_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        block.ids(tf.Table(tf.frequencies({i: 1 for i in range(7)})))


@pytest.mark.parametrize("params", [tf.FileParams(), tf.FileParams(block=64, lanes=8, segment=2)])
def test_token_files_on_odd_rows(spark, params):
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(ODD)], "doc_id long, text string, ids int, value string")
    found = tf.token_files(docs.repartition(3), WORD, with_ids=True, params=params).collect()
    want = brute_files(ODD)
    key = lambda r: (r[1],)
    # rows of one id are ordered by their tokens, not as they came
    assert sorted((r[0] or 0, r[2], r[3]) for r in want) == sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found)
    got, start = sorted(found, key=lambda r: r["start"]), 0
    for r in got:
        assert r["start"] == start and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [d for d, *_ in sorted(want, key=key)]


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.token_files(docs, WORD).count() == 0


def test_op11_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, SF).collect()) == sorted(brute_files(rows))


def brute_codes(rows, p=vc.CodeParams()):
    """Plain product quantisation in Python integers; rows of (id, vector, group)."""
    import math

    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = -(-max((len(v) for _, v, _ in rows), default=0) // p.parts) * p.parts
    size = dim // p.parts
    most = vc.limit(dim)
    whole = [[max(-most, min(most, math.floor(p.scale * x))) for x in v] + [0] * (dim - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[: p.entries]
    cut = lambda v, k: v[k * size : (k + 1) * size]
    books = [[cut(whole[i], k) for i in order] for k in range(p.parts)]

    def nearest(v, k):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, k), e)) for e in books[k]]
        return d.index(min(d)), min(d)

    for _ in range(p.rounds):
        found = [[nearest(v, k)[0] for k in range(p.parts)] for v in whole]
        for k in range(p.parts):
            for e in range(len(order)):
                own = [cut(v, k) for v, f in zip(whole, found) if f[k] == e]
                if own:
                    books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for (i, _, group), v in zip(rows, whole):
        found = [nearest(v, k) for k in range(p.parts)]
        error = sum(d for _, d in found)
        sums[group] = sums.get(group, 0) + error
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error, group))
    return sorted(((i, c, e, sums[g]) for i, c, e, g in out), key=str), [[list(e) for e in b] for b in books]


def check_codes(spark, rows, kind="array<float>"):
    docs = spark.createDataFrame([(i, v, g, 1, "c") for i, v, g in rows], f"vec_id long, embedding {kind}, label int, key int, c string")
    found, books = vc.vector_codes(docs.repartition(3))
    want, plain = brute_codes(rows)
    assert sorted(((r["id"], r["code"], r["error"], r["group_error"]) for r in found.collect()), key=str) == want
    assert [b.tolist() for b in books.entries] == plain


def test_codes_against_plain_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 24)], int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    check_codes(spark, rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 10, 1), (5, [0.5] * 10, 1), (5, [-0.25] * 10, None), (None, [1.0, 2.0], None), (2, [], 7), (3, None, 7), (4, [nan] * 8, 7), (6, [inf], 7),
            (7, [0.0, None, 1.0], 7), (8, [3e38, -3e38] + [1e-30, -1e-30] * 4, 2), (-1, [0.1] * 9, 2)] + [(100 + i, [1.0] * 10, 9) for i in range(40)]
    check_codes(spark, rows, "array<double>")
    check_codes(spark, [(1, [], 1), (2, None, 1)])
    check_codes(spark, [])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 17), st.integers(1, 20), st.sampled_from([3, 4096, 1 << 26]), st.integers(0, 10**6))
def test_bounds_never_lose_the_nearest(dim, entries, size, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-size, size + 1, (50, dim)), rng.integers(-size, size + 1, (entries, dim))
    x[:10] = book[rng.integers(0, entries, 10)]
    book[entries // 2] = book[0]  # a tie
    search = vc.NearestEntry(book)
    at, d = search(x)
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()


def test_bounds_rule_entries_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4000, (64, 8)).astype(np.int64)
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 8))
    search = vc.NearestEntry(centres)
    search(x)
    assert search.compared < 10 * len(x)  # of 64 each


def test_codes_decode_near_the_vectors(spark):
    rows = table(spark, SF, "embeddings")
    books = vc.fit_codebooks(rows)
    found = vc.encode_vectors(rows, books).collect()
    x = np.array([r["embedding"] for r in found])
    codes = np.array([[int(r["codes"]["code"][i : i + 2], 16) for i in range(0, 16, 2)] for r in found])
    assert ((books.decode(codes) - x) ** 2).sum() < 0.7 * ((x - x.mean(0)) ** 2).sum()


BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def brute_tokens(text):
    """(A ids, their byte ranges, B ids, their byte ranges) of the whole text at once, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    if not hasattr(brute_tokens, "a"):
        brute_tokens.a, brute_tokens.b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
        brute_tokens.a.encode_special_tokens = True
        brute_tokens.decode = ByteLevel()
    if not text:
        return None
    raw = f" {text}".encode()
    a, b = brute_tokens.a.encode(f" {text}", add_special_tokens=False).ids, brute_tokens.b.encode(text)
    # characters of byte-level tokens stand for one byte each
    size_a = [len(brute_tokens.a.id_to_token(i)) for i in a]
    part_b = [bytes.fromhex(p[3:5]) if brute_tokens.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, map(brute_tokens.b.id_to_piece, b))]
    whole = brute_tokens.decode.decode([brute_tokens.a.id_to_token(i) for i in a]).encode()
    if whole != raw or b"".join(part_b) != raw:
        return None
    spans = lambda sizes: [(int(e - s), int(e)) for s, e in zip(sizes, np.cumsum(sizes))]
    return a, spans(size_a), b, spans([len(p) for p in part_b])


def brute_alignment(rows):
    import hashlib
    from collections import Counter

    docs, held = [], Counter()
    for doc, text in rows:
        t = brute_tokens(text)
        if t is None:
            docs.append((doc, [], 0, 0, None))
            continue
        a, sa, b, sb = t
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (u, v) in zip(b, sb) if max(s, u) < min(e, v)]
        held.update(set(links))
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [(",".join(str(x) for x, (_, e) in zip(a, sa) if lo < e <= hi), ",".join(str(y) for y, (_, e) in zip(b, sb) if lo < e <= hi)) for lo, hi in zip([0, *both], both)]
        docs.append((doc, links, len(a), len(b), groups))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc, links, n_a, n_b, groups in docs:
        spelled = ";".join(f"{x}|{y}" for x, y in groups) if groups is not None else ""
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups is not None else ""
        out.append((doc, n_a, n_b, len(groups or []), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), digest))
    return sorted(out, key=str)


HARD = [
    (1, "a  b\n c\t<s>  x ﬁ e\u0301 </s>"), (1, "a  b\n c\t<s>  x ﬁ e\u0301 </s>"), (None, "  leading and trailing  "), (2, ""), (3, None), (4, " "),
    (5, "\u2581 a piece mark"), (6, "<|endoftext|>don't I'LL we've\u00a0x \u3000 y\x1c z\x00"), (7, "東京 naïve 😀 <0x41> ﷽"), (8, "\n\n \n  \t x\r\n  y"),
    (2**62 + 1, "tail "), (9, "ab" * 2000), (10, "one two " * 500),
]


def alignment_rows(found):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best_a", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.mark.parametrize("hot", [65536, 1])
def test_alignment_of_odd_rows(spark, hot):
    docs = spark.createDataFrame([(d, t, 1, "p") for d, t in HARD], "doc_id long, text string, row int, pairs string")
    found, _ = ta.align_tokens(docs.repartition(3), ta.AlignParams(BYTES, PIECES, hot=hot))
    assert alignment_rows(found) == brute_alignment(HARD)
    import hashlib

    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in found.collect())


def test_alignment_of_nothing(spark):
    assert ta.align_tokens(spark.createDataFrame([], "doc_id long, text string"), ta.AlignParams(BYTES, PIECES))[0].count() == 0


def test_op13_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    # texts of thousands of words are left to the test of units: comparing all tokens with all is slow
    short = [r for r in rows if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    assert alignment_rows(ta.align_tokens(docs, ta.AlignParams(BYTES, PIECES))[0]) == brute_alignment(short)
    names = ["doc_id", "n_a", "n_b"]
    whole = {r["doc_id"]: (r["n_a"], r["n_b"]) for r in QUERIES["op13_token_alignment"](spark, SF).select(*names).collect()}
    want = {d: brute_tokens(t) for d, t in rows}
    assert whole == {d: (len(t[0]), len(t[2])) if t else (0, 0) for d, t in want.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_merged_ends_against_all_pairs(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    total = max(a[-1], b[-1])
    a, b = np.append(a[a < total], total), np.append(b[b < total], total)
    m = ta.merge_ends(a, b)
    span = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    want = [(i, j) for i, (s, e) in enumerate(span(a)) for j, (u, v) in enumerate(span(b)) if max(s, u) < min(e, v)]
    assert list(zip(m.a.tolist(), m.b.tolist())) == want
    assert m.last_a.tolist() == [e in b for e in a] and m.last_b.tolist() == [e in a for e in b]


SPACES = st.sampled_from([" ", "  ", "\n", " \n", "\n ", "\t", "\u00a0", "\u3000", "\x1c", "\r\n  ", ""])
WORDS = st.sampled_from(["ÀÉß.", "Ÿx", "ÿ)", "×y", "İ", "<|endoftext|>", "a<|startoftext|>.", "(x)", "the", "don't", "x'll", "12", "é", "!", "...", "<s>", "東京", "\U0001f600", "zz9", "'", "s"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(SPACES, WORDS), max_size=12), SPACES)
def test_units_spell_the_whole_text(parts, tail):
    text = "".join(s + w for s, w in parts) + tail
    found, want = ta.aligner(BYTES, PIECES)([text, None, text, "and"]), brute_tokens(text)
    assert found[1] == ta.NOTHING and found[3].n_a == 1 and found[0].groups == found[2].groups
    if want is None:
        assert found[0] == ta.NOTHING
    else:
        groups = [g.split("|") for g in found[0].groups.decode().split(";")]
        assert [int(i) for g in groups for i in g[0].split(",")] == want[0] and [int(i) for g in groups for i in g[1].split(",")] == want[2]


@pytest.mark.parametrize("text", ["a\n", "ÀÉß.\n", "one two\n", "one\n two", "end.\n\n"])
def test_line_ends_behind_plain_words(text):
    want, found = brute_tokens(text), ta.aligner(BYTES, PIECES)([text])[0]
    groups = [g.split("|") for g in found.groups.decode().split(";")]
    assert (found.n_a, found.n_b) == (len(want[0]), len(want[2]))
    assert [int(i) for g in groups for i in g[0].split(",")] == want[0] and [int(i) for g in groups for i in g[1].split(",")] == want[2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(SPACES, WORDS), max_size=12), SPACES)
def test_words_spell_the_whole_text(parts, tail):
    from tokenizers import Tokenizer

    text = "".join(s + w for s, w in parts) + tail
    test_words_spell_the_whole_text.t = getattr(test_words_spell_the_whole_text, "t", None) or Tokenizer.from_file(WORD)
    ids, ends = tf.word_tokenizer(WORD).texts(pa.array([text, None, text]))
    assert ends.tolist() == [len(ids) // 2, len(ids) // 2, len(ids)]
    assert ids[: ends[0]].tolist() == ids[ends[1] :].tolist() == test_words_spell_the_whole_text.t.encode(text, add_special_tokens=False).ids
