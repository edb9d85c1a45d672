"""Benchmark decontamination by winnowing.

Of every `window` consecutive k-gram hashes the smallest is kept as a fingerprint, on both sides. Two
texts that share `window + k - 1` consecutive words share all hashes of one such window, so they share
a fingerprint: no shared span of that length is missed. Documents are joined to the benchmark through
these fingerprints and every match is extended to the words it really covers, compared word by word.

A benchmark whose texts fit into `block_bytes` is indexed whole and broadcast: the documents are not
shuffled. A larger one stays distributed: its fingerprints go into a bit table of bounded size, every
document picks the windows whose fingerprint may be in it, and only those windows, as 128-bit digests of
their words, are shuffled to meet the benchmark's. Either way the documents are read once, whatever the
benchmark's size, and texts are never stored or shuffled for the search.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import check_absent, fresh, release, stored


@dataclass(frozen=True)
class DecontaminationParams:
    """span: words of a benchmark window, which is what must be found. k: words to a hash; the
    winnowing window is span - k + 1. share: a document is contaminated from hits/words of this on.
    block_bytes: benchmark text up to which its index is broadcast. table_bits: power of two, the size of
    the bit table beyond that (32 MB); a fuller table only lets more windows through to the exact join."""

    span: int = 13
    k: int = 7
    share: tuple[int, int] = (1, 20)
    block_bytes: int = 4 << 20
    table_bits: int = 28


#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x, h = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the last among equals) of each `window` consecutive hashes."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class BenchmarkIndex:
    """Windows of a block of items, by their exact words, and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[str, bytes | None]], p: DecontaminationParams):
        self.p = p
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, tuple[str, ...]] = {}
        self.short: dict[int, np.ndarray] = {}
        prints, short = [], {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            length = min(p.span, len(ids))
            for i in range(len(ids) - length + 1):
                key = ids[i : i + length].tobytes()
                had = self.windows.get(key, ())
                if item not in had:
                    self.windows[key] = (*had, item)
            if length < p.span:  # too short for the guarantee: looked up by all of its words
                short.setdefault(length, []).append(gram_hashes(ids, length)[0])
            else:
                h = gram_hashes(ids, p.k)
                prints.append(h[winnow(h, p.span - p.k + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.short = {n: np.unique(np.array(v, np.uint64)) for n, v in short.items()}
        self.least = min([*self.short, p.span])

    @staticmethod
    def _known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table) or not len(h):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return table[at] == h

    def find(self, text: bytes | None) -> tuple[int, np.ndarray | None, set[str]]:
        """Words of the text, which of them are hit (None: none), and the items that have occurring windows."""
        words = words_of(text)
        n, p = len(words), self.p
        if n < self.least:
            return n, None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        hit, items = None, set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):  # runs of words that occur in the benchmark
            if end - start < self.least:
                continue
            run = ids[start:end]
            spans: list[tuple[int, int]] = []
            if len(run) >= p.span and len(self.prints):
                h = gram_hashes(run, p.k)
                at = winnow(h, p.span - p.k + 1)
                for q in at[self._known(h[at], self.prints)].tolist():
                    spans += [(s, p.span) for s in range(max(0, q + p.k - p.span), min(q, len(run) - p.span) + 1)]
            for length, table in self.short.items():
                spans += [(s, length) for s in np.flatnonzero(self._known(gram_hashes(run, length), table)).tolist()]
            for s, length in dict.fromkeys(spans):
                if found := self.windows.get(run[s : s + length].tobytes()):
                    if hit is None:
                        hit = np.zeros(n, bool)
                    hit[start + s : start + s + length] = True
                    items.update(found)
        return n, hit, items


_FOUND = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<string>>"


def _pass(index):
    """A UDF: what a broadcast index finds in a text."""

    @F.arrow_udf(_FOUND)
    def run(texts):
        import pyarrow as pa

        release()
        counts, spans, items = [], [], []
        for text in texts:
            n, hit, found = index.value.find(text.as_py())
            counts.append(n)
            edges = [] if hit is None else np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            items.append(sorted(found))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "spans", "items"]
        )

    return run


class _Words(dict):
    """Word to a 64-bit hash, dropped when it has grown to a bound."""

    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[w] = h = xxh64_intdigest(w)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


_WINDOW = "item string, digest binary, print long"


def _item_windows(p: DecontaminationParams):
    """(item, digest, print) of every window of an item; print leads to it: the hash of the window's winnowed
    k-gram, or of all words of an item shorter than a window, with that length in the low bits."""

    def run(it):
        import pyarrow as pa

        hashes, rows = _Words(), []

        def batch():
            columns = list(zip(*rows)) or [[], [], []]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["item", "digest", "print"])

        for b in it:
            for item, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(body)
                if not words:
                    continue
                h, length = hashes.of(words), min(p.span, len(words))
                grams = gram_hashes(h, p.k if length == p.span else length)
                for i in range(len(words) - length + 1):
                    own = grams[i : i + p.span - p.k + 1] if length == p.span else grams
                    rows.append((item, _digest(words[i : i + length]), _marked(int(own[winnow(own, p.span - p.k + 1)[0]]), length)))
                    if len(rows) >= 20_000:
                        yield batch()
        yield batch()

    return run


def _marked(h: int, length: int) -> int:
    """The hash as a signed number whose low six bits are the window's length."""
    x = (h & ~63 | length) & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _bit_table(prints: DataFrame, bits: int) -> np.ndarray:
    """A table of 2^bits bits in which those of all prints are set, made in the tasks and merged in a tree."""

    def run(it):
        import pyarrow as pa

        table = np.zeros(1 << bits - 3, np.uint8)
        for b in it:
            at = _places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    # few enough partial tables that merging them stays cheap
    parts = prints.select("print").distinct().coalesce(64).mapInArrow(run, "table binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.uint8))
    merge = lambda a, b: b if a is None else a if b is None else a | b
    found = parts.treeAggregate(None, merge, merge)
    return np.zeros(1 << bits - 3, np.uint8) if found is None else found


def _places(prints: np.ndarray, bits: int) -> np.ndarray:
    return ((prints * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


_CANDIDATES = "struct<n_words: bigint, near: array<struct<start: int, length: int, digest: binary>>>"


def _near(shared, lengths: list[int], p: DecontaminationParams):
    """A UDF: the number of words of a text, and its windows whose fingerprint may be the benchmark's."""

    @F.arrow_udf(_CANDIDATES)
    def run(texts):
        import pyarrow as pa

        table, hashes = shared.value, _Words()
        window = p.span - p.k + 1

        def known(h: np.ndarray, length: int) -> np.ndarray:
            x = h & ~np.uint64(63) | np.uint64(length)
            at = _places(x, p.table_bits)
            return np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)

        counts, found = [], []
        for text in texts:
            words = words_of(text.as_py())
            counts.append(len(words))
            h = hashes.of(words)
            spans: dict[tuple[int, int], None] = {}
            if len(words) >= p.span and p.span in lengths:
                grams = gram_hashes(h, p.k)
                at = winnow(grams, window)
                for q in at[known(grams[at], p.span)].tolist():
                    spans.update(dict.fromkeys((s, p.span) for s in range(max(0, q + p.k - p.span), min(q, len(words) - p.span) + 1)))
            for n in lengths:
                if n < p.span and len(words) >= n:
                    spans.update(dict.fromkeys((s, n) for s in known(gram_hashes(h, n), n).tolist()))
            found.append([{"start": s, "length": n, "digest": _digest(words[s : s + n])} for s, n in spans])
        near = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, pa.list_(near))], ["n_words", "near"])

    return run


def _joined(docs: DataFrame, rows: DataFrame, text_col: str, p: DecontaminationParams, keep_text: bool, out: str) -> DataFrame:
    """docs with `out` (n_words, spans, items) by a shuffle join of window digests; rows: (item, body)."""
    if p.span > 63:
        raise ValueError("windows have at most 63 words")
    spark = docs.sparkSession
    windows = stored(rows.mapInArrow(_item_windows(p), _WINDOW), "benchmark-windows")
    lengths = sorted(r["n"] for r in windows.select(F.col("print").bitwiseAND(F.lit(63)).alias("n")).distinct().collect())  # at most `span`
    shared = spark.sparkContext.broadcast(_bit_table(windows, p.table_bits))
    row, near = fresh(docs, "row"), fresh(docs, "near")
    kept = docs if keep_text else docs.drop(text_col)
    if keep_text:  # the one time that texts are written: row numbers must hold for two readings
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        searched = docs.select(row, _near(shared, lengths, p)(F.col(text_col).cast("binary")).alias(near))
    else:
        searched = docs.withColumn(
            near, _near(shared, lengths, p)(F.col(text_col).cast("binary"))
        ).drop(text_col).withColumn(row, F.monotonically_increasing_id())
    searched = stored(searched, "windows")
    each = searched.select(F.col(row).alias("_row"), F.explode(f"{near}.near").alias("_w")).select("_row", "_w.start", "_w.length", "_w.digest")
    # a passage may be in a third of all documents, or in many items: both sides meet once for a digest and a salt
    often = each.groupBy("digest").agg(F.count("*").alias("_n")).where(F.col("_n") > 10_000)
    salts = stored(often.select(F.col("digest").alias("_hot"), F.ceil(F.col("_n") / 10_000).cast("int").alias("_salts")), "hot-windows")
    salted = lambda df, salt: df.join(salts, F.col("digest") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    count = F.coalesce("_salts", F.lit(1))
    left = salted(each, F.pmod(F.xxhash64("_row"), count).cast("int"))
    of_item = salted(windows.select("digest", "item").distinct(), F.explode(F.sequence(F.lit(0), count - 1)))
    hits = left.join(of_item, ["digest", "_salt"])
    spans = hits.select("_row", "start", "length").distinct().groupBy("_row").agg(F.collect_list(F.struct("start", F.col("start") + F.col("length"))).alias("_spans"))
    items = hits.select("_row", "item").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    hit_row, hit_spans, hit_items, number = (fresh(searched, n) for n in ("hit_row", "hit_spans", "hit_items", "number"))
    found = spans.join(items, "_row").select(F.col("_row").alias(hit_row), _merged(F.col("_spans")).alias(hit_spans), F.col("_items").alias(hit_items))
    if keep_text:
        hit_row, hit_spans, hit_items, number = (fresh(docs, n) for n in (hit_row, hit_spans, hit_items, number))
        found = found.toDF(hit_row, hit_spans, hit_items)
        searched = docs.join(searched.withColumnRenamed(row, number), F.col(row) == F.col(number))
    full = searched.join(found, F.col(row) == F.col(hit_row), "left")
    none = F.expr("array()")
    struct = F.struct(
        F.col(f"{near}.n_words").alias("n_words"), F.coalesce(hit_spans, none.cast("array<struct<start: int, end: int>>")).alias("spans"),
        F.coalesce(hit_items, none.cast("array<string>")).alias("items")
    )
    return full.select(*[F.col(c) for c in kept.columns], struct.alias(out))


def _merged(spans: Column) -> Column:
    """Spans (start, end) as the fewest that cover the same words."""
    kind = "array<struct<start: int, end: int>>"

    def step(done, s):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (s["start"] > last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(apart, F.array_append(done, s)).otherwise(F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).cast(kind)

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    params: DecontaminationParams = DecontaminationParams(), keep_text: bool = True, out: str = "benchmark_hits"
) -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, spans (word positions), items, contaminated.

    A document word is hit inside an occurrence of 13 consecutive words of an item, or of all words of
    a shorter item. Null and empty texts have no words and no hits, and as items they match nothing.
    Items with one id count once; a null id is written "null". Repeated rows are judged alike, other
    columns pass through; `out` must not be one of them. An empty benchmark leaves nothing hit. With
    keep_text False texts are not carried.
    """
    check_absent(docs, out)
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("n"), F.count("*").alias("m")).first()
    if (size["n"] or 0) + 16 * size["m"] <= params.block_bytes:
        index = spark.sparkContext.broadcast(BenchmarkIndex([(r["item"], bytes(r["body"]) if r["body"] is not None else None) for r in rows.collect()], params))
        marked = docs.withColumn(out, _pass(index)(F.col(text_col).cast("binary")))
        marked = marked if keep_text else marked.drop(text_col)
    else:
        marked = _joined(docs, rows, text_col, params, keep_text, out)
    c = F.col(out)
    n_hit = F.aggregate(c["spans"], F.lit(0).cast("bigint"), lambda total, s: total + (s["end"] - s["start"]))
    marked = marked.withColumn(out, F.struct(c["n_words"].alias("n_words"), n_hit.alias("n_hit"), c["spans"].alias("spans"), c["items"].alias("items")))
    part, whole = params.share
    return marked.withColumn(out, c.withField("contaminated", (c["n_hit"] > 0) & (c["n_hit"] * whole >= c["n_words"] * part)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), **names) -> DataFrame:
    """docs without the contaminated rows, columns as they were, whatever they are called."""
    out = fresh(docs, "benchmark_hits")
    return contamination(docs, benchmark, params=params, out=out, **names).where(~F.col(f"{out}.contaminated")).drop(out)
