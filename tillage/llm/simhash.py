"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, exact verification, components.

A 64-bit fingerprint is embedded as the bit counts of its two-bit segments. The Manhattan distance
of two embeddings never exceeds the Hamming distance, so cells of the embedding grid further apart
than the threshold need no comparison. With at most 3 differing bits one half of the fingerprint has
at most 1, hence for that half the two points lie in one cell or in cells one step apart. A step
changes the parity of the cell's sum: only points of odd cells visit their neighbours, which are
even, and every close pair meets exactly once for a half.

`near_duplicates` links equal and close fingerprints as they are. `similar_texts` is for texts that share
most of their word shingles, which a single fingerprint tells apart too often: several fingerprints over
the distinct words go through the same grid join and give groups of candidates, inside which the shingles decide.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import discard, fresh, look_up, release, stored
from tillage.llm._graph import components


@dataclass(frozen=True)
class SimHashParams:
    """shingle: words to a shingle. distance: differing bits that still link, at most 3 (the grid's
    guarantee). dense: fingerprints in a cell beyond which only a spanning forest of its links is kept, found in
    blocks of `block`: the plan of such cells differs, their components do not."""

    shingle: int = 3
    distance: int = 3
    seed: int = 42
    dense: int = 1024
    block: int = 1024


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit majority of the XXH64 of word shingles; without words zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    h = np.array([xxh64_intdigest(join(s), seed) for s in zip(*[words[i:] for i in range(shingle)])], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_column(text: Column, p: SimHashParams = SimHashParams()) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""

    @F.arrow_udf("bigint")
    def run(texts):
        import pyarrow as pa

        return pa.array(np.array([fingerprint(t.as_py(), p.shingle, p.seed) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text.cast("binary"))


_ALTERNATE = 0x55555555


def _cells(half: Column) -> Column:
    """The 16 two-bit segments' bit counts, two bits each, of a 32-bit half."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(_ALTERNATE))


def _places(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points in their own cells (which, half, cell, fp), and the cells each point visits."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("fp"), 32)
    halves = F.explode(F.array(
        F.struct(F.lit(0).alias("half"), _cells(low).alias("cell"), F.bit_count(low).alias("ones")),
        F.struct(F.lit(1).alias("half"), _cells(high).alias("cell"), F.bit_count(high).alias("ones"))
    ))
    own = points.select("which", "fp", halves.alias("h")).select("which", "fp", "h.half", "h.cell", "h.ones")
    steps = []
    for j in range(16):
        field = F.shiftright(F.col("cell"), 2 * j).bitwiseAND(F.lit(3))
        steps.append(F.when(field < 2, F.col("cell") + (1 << 2 * j)))
        steps.append(F.when(field > 0, F.col("cell") - (1 << 2 * j)))
    here = F.array(F.struct(F.col("cell").alias("at"), F.lit(True).alias("home")))
    around = F.transform(F.filter(F.array(*steps), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("at"), F.lit(False).alias("home")))
    goes = F.when(F.pmod(F.col("ones"), F.lit(2)) == 1, F.concat(here, around)).otherwise(here)
    visits = own.select("which", "fp", "half", F.explode(goes).alias("v")).select(
        "which", "fp", "half", F.col("v.at").alias("cell"), F.col("v.home").alias("home")
    )
    return own.select("which", "fp", "half", "cell"), visits


def _forest(distance: int):
    """Links inside one pair of blocks, thinned to a spanning forest of what they connect."""

    def run(group):
        import pyarrow as pa

        column = lambda n: group.column(n).to_numpy()
        fp, mine, at_home = column("fp").astype(np.int64), column("is_own").astype(bool), column("home").astype(bool)
        own, x, home = fp[mine], fp[~mine], at_home[~mine]
        parent: dict[int, int] = {}

        def top(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        kept = []
        for i in range(len(x)):
            near = own[np.bitwise_count((own ^ x[i]).view(np.uint64)) <= distance]
            if home[i]:
                near = near[near < x[i]]
            for o in near.tolist():
                a, b = top(o), top(int(x[i]))
                if a != b:
                    parent[b] = a
                    kept.append((o, int(x[i])))
        ends = np.array(kept, np.int64).reshape(-1, 2)
        which = np.full(len(ends), column("which")[0], np.int32)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1]), "which": pa.array(which)})

    return run


def links(points: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): pairs of distinct fingerprints of `points` (fp, without repeats) at most `distance` bits apart.

    With a column `which` only fingerprints of the same kind are compared, and the pairs carry it. Cells of
    more than `dense` points are compared in blocks, each block pair a group of its own that keeps a spanning
    forest of its links: components are those of all links, and no task and no output grows with the square
    of a cell.
    """
    if not 0 <= p.distance <= 3:
        raise ValueError("the grid finds every link up to 3 bits")
    kinds = "which" in points.columns
    own, visits = _places(points if kinds else points.withColumn("which", F.lit(0)))
    many = own.groupBy("which", "half", "cell").agg(F.count("*").alias("n")).where(F.col("n") > p.dense)
    crowd = stored(
        many.select(
            F.col("which").alias("_which"), F.col("half").alias("_half"), F.col("cell").alias("_cell"),
            F.ceil(F.col("n") / p.block).cast("int").alias("_blocks")
        ),
        "crowd"
    )
    crowded = not crowd.isEmpty()
    on = (F.col("which") == F.col("_which")) & (F.col("half") == F.col("_half")) & (F.col("cell") == F.col("_cell"))
    thin = (lambda df: df.join(crowd, on, "left_anti")) if crowded else (lambda df: df)
    o = thin(own).select(F.col("which").alias("ow"), F.col("half").alias("oh"), F.col("cell").alias("oc"), F.col("fp").alias("a"))
    v = thin(visits).select("which", "half", "cell", F.col("fp").alias("b"), "home")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.distance
    same = (F.col("ow") == F.col("which")) & (F.col("oh") == F.col("half")) & (F.col("oc") == F.col("cell"))
    pairs = o.join(v, same & close & (~F.col("home") | (F.col("a") < F.col("b")))).select("a", "b", "which")
    if crowded:
        blocks = F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)
        side = lambda df, flag, mine, others: df.join(crowd, on).select(
            "which", "half", "cell", "fp", "home", F.lit(flag).alias("is_own"), F.pmod(F.xxhash64("fp"), F.col("_blocks")).alias(mine),
            F.explode(blocks).alias(others)
        )
        both = side(own.withColumn("home", F.lit(True)), True, "i", "j").unionByName(side(visits, False, "j", "i"))
        pairs = pairs.union(both.groupBy("which", "half", "cell", "i", "j").applyInArrow(_forest(p.distance), "a long, b long, which int"))
    return pairs if kinds else pairs.drop("which")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of at most 3 differing bits.

    Equal fingerprints are one point, so copies are never paired. Null and empty texts have
    fingerprint zero and link like any other. A row with a null id is a row, and belongs to the
    smallest non-null id of its component (null if none). Repeated rows stay. Other columns are not
    carried. Empty input gives no rows.
    """
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), params).alias("fp")), "fingerprints")
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "points")
    found = components(links(points.select("fp"), params))
    tops = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = points.join(tops, F.col("fp") == F.col("_node"), "left").select("fp", "first_id", "n", F.coalesce("_root", "fp").alias("root"))
    placed = stored(joined, "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("_n"))
    # a root has at most as many rows here as distinct fingerprints
    of_point = placed.select("fp", "n", "root").join(
        smallest.select(F.col("root").alias("_r"), "component_id"), F.col("root") == F.col("_r")
    ).select("fp", "n", "component_id")
    by_point = stored(of_point, "components")
    discard(points, placed, found)
    return look_up(marked, by_point, "fp", "n", "doc_id")


@dataclass(frozen=True)
class SimilarParams:
    """words, similarity: shingles of so many words, and the share of common shingles (Jaccard) from which two texts
    are duplicates. prints: fingerprints over distinct words. load: shingles that a task compares at a time on either
    side, the bound of what it holds. heads: texts that all of a large group are compared with first. grid: the grid
    join; cells that hold many times what chance puts there keep a forest of their links, which is all that groups
    of candidates need."""

    words: int = 5
    similarity: float = 0.8
    prints: int = 6
    seed: int = 42
    load: int = 400_000
    heads: int = 8
    grid: SimHashParams = SimHashParams(dense=12)


def _sketch(p: SimilarParams):
    """A UDF: a digest of the text's words in order, and the fingerprints of its distinct words."""

    @F.arrow_udf("struct<digest: binary, fps: array<bigint>>")
    def run(texts):
        import pyarrow as pa
        from hashlib import blake2b

        release()
        known: dict[bytes, bytes] = {}
        salt, size = p.seed.to_bytes(8, "little"), 8 * p.prints
        digests, prints = [], []
        for text in texts:
            words = text.as_py().lower().split() if text.is_valid else []
            digests.append(_digest(words))
            distinct = set(words)
            if len(known) > 100_000:
                known.clear()
            hashes = [known.get(w) or known.setdefault(w, blake2b(w, digest_size=size, key=salt).digest()) for w in distinct]
            ones = np.zeros(8 * size, np.int64)
            for i in range(0, len(hashes), 16384):
                part = np.frombuffer(b"".join(hashes[i : i + 16384]), np.uint8).reshape(-1, size)
                ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
            prints.append(np.packbits(2 * ones > len(hashes)).view(">i8").astype(np.int64))
        flat = np.concatenate(prints) if prints else np.zeros(0, np.int64)
        fps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, p.prints, dtype=np.int32)), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), fps], ["digest", "fps"])

    return run


def _digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def _shingles(p: SimilarParams):
    """A UDF: the digest of the text's words, and the hashes of its distinct shingles."""

    @F.arrow_udf("struct<digest: binary, shingles: array<bigint>>")
    def run(texts):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        release()
        digests, rows = [], []
        for text in texts:
            words = text.as_py().lower().split() if text.is_valid else []
            digests.append(_digest(words))
            parts = zip(*[words[i:] for i in range(p.words)]) if len(words) >= p.words else [words] if words else []
            rows.append(np.unique(np.array([xxh64_intdigest(b" ".join(s)) for s in parts], np.uint64)).view(np.int64))
        sizes = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), lists], ["digest", "shingles"])

    return run


def similar_forest(similarity: float):
    """A function of groups: verified links between texts, thinned to a spanning forest of what they connect.

    A group holds rows (digest, shingles, row, column): texts marked `row` are compared with all marked `column`. The
    texts that hold a shingle are listed once, so one count over a text's lists gives what it shares with every
    other text, and no pair is looked at twice.
    """

    def run(group):
        import pyarrow as pa

        release()
        lists = group.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, ends = len(sizes), np.cumsum(sizes)
        _, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owners = np.repeat(np.arange(n), sizes)
        row, column = (group.column(c).to_numpy().astype(bool) for c in ("row", "column"))
        # owners of a shingle, those marked `column`, one shingle after the other
        listed = column[owners]
        by_shingle = np.argsort(at[listed], kind="stable")
        holders = owners[listed][by_shingle]
        length = np.bincount(at[listed], minlength=int(at.max()) + 1 if len(at) else 0)
        begin = np.cumsum(length) - length
        parent = np.arange(n)

        def top(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        kept, left = [], n
        for i in np.flatnonzero(row).tolist():
            if left == 1:
                break
            own = at[ends[i] - sizes[i] : ends[i]]
            counts = length[own]
            stops = np.cumsum(counts)
            total = int(stops[-1]) if len(stops) else 0
            places = np.arange(total) + np.repeat(begin[own] - (stops - counts), counts)
            common = np.bincount(holders[places], minlength=n)
            near = np.flatnonzero((common > 0) & (common >= similarity * (sizes[i] + sizes - common)))
            for j in near.tolist():
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept.append((i, j))
                    left -= 1
        digests = group.column("digest").combine_chunks()
        ends_ = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({"x": digests.take(pa.array(ends_[:, 0])), "y": digests.take(pa.array(ends_[:, 1]))})

    return run


def verified_links(sets: DataFrame, p: SimilarParams) -> DataFrame:
    """(x, y): links between texts of one candidate group that connect what all links inside it connect.

    sets is (digest, root, shingles), a row a text. Groups of few shingles are compared whole, many to a task. A large one is cut into
    blocks by digest: each block is compared with itself and with a few heads of its group; then the texts outside of
    the group's largest part so far meet all others, block by block. Texts of one part need no comparison any
    more, so a group of close copies takes one round, and no task holds more than two blocks.
    """
    size = F.size("shingles")
    groups = sets.groupBy("root").agg(F.sum(size).alias("load"), F.count("*").alias("texts"))
    large = stored(groups.where(F.col("load") > p.load).select(F.col("root").alias("_root"), F.ceil(F.col("load") / p.load).cast("int").alias("blocks")), "large-groups")
    total = sets.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    compare = lambda df, *by: df.groupBy(*by).applyInArrow(similar_forest(p.similarity), "x binary, y binary")
    yes, no = F.lit(True), F.lit(False)
    rows = ["digest", "shingles", "row", "column"]
    small = sets.join(F.broadcast(large), F.col("root") == F.col("_root"), "left_anti") if large.count() <= 10_000 else sets.join(large, F.col("root") == F.col("_root"), "left_anti")
    bucket = F.pmod(F.xxhash64("root"), F.lit(1 + total // p.load))
    found = compare(small.select("digest", "shingles", yes.alias("row"), yes.alias("column"), bucket.alias("bucket")), "bucket")
    if large.isEmpty():
        return found
    members = stored(sets.join(large, F.col("root") == F.col("_root")).select("digest", "root", "shingles", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).alias("i")), "members")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of).cast("long") - 1))
    # a head is the text with the smallest digest of a block; the first few blocks give theirs
    heads = members.where(F.col("i") < p.heads).groupBy("root", "i").agg(F.min("digest").alias("digest"), F.min_by("shingles", "digest").alias("shingles"), F.max("blocks").alias("blocks"))
    inside = members.select("root", "i", *rows[:2], yes.alias("row"), yes.alias("column"))
    beside = heads.select("root", F.col("i").alias("own"), *rows[:2], every("blocks").alias("i")).where("own <> i").select("root", "i", *rows[:2], yes.alias("row"), no.alias("column"))
    first = stored(compare(inside.unionByName(beside), "root", "i"), "first-links")
    tops = components(first, "x", "y")
    placed = members.join(tops.select(F.col("node").alias("_node"), F.col("root").alias("_top")), F.col("digest") == F.col("_node"), "left").select(
        "digest", "root", "shingles", "i", "blocks", F.coalesce("_top", "digest").alias("part")
    )
    parts = placed.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum(F.size("shingles").cast("long")).alias("load"))
    largest = parts.groupBy(F.col("root").alias("_r")).agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("load").alias("all"), F.max_by("load", F.struct("n", "part")).alias("held"))
    # blocks of the texts that are not in the largest part; none of them, and the group is done
    open_ = stored(largest.where(F.col("all") > F.col("held")).select("_r", "largest", F.ceil((F.col("all") - F.col("held")) / p.load).cast("int").alias("others")), "open-groups")
    if not open_.isEmpty():
        again = placed.join(open_, F.col("root") == F.col("_r"))
        outside = again.where(F.col("part") != F.col("largest")).select(
            "root", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("others")).alias("j"), *rows[:2], yes.alias("row"), no.alias("column"), every("blocks").alias("i")
        )
        whole = again.select("root", every("others").alias("j"), *rows[:2], no.alias("row"), yes.alias("column"), "i")
        # a text outside stands on both sides
        second = stored(compare(outside.unionByName(whole), "root", "i", "j").where("x <> y"), "second-links")
        first = first.union(second)
    out = stored(found.union(first), "links")
    discard(large, members, tops, open_)
    return out


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimilarParams = SimilarParams()) -> DataFrame:
    """(doc_id, component_id): the smallest id reachable over pairs of texts that share 0.8 of their five-word shingles.

    A-Z are lower-cased. Texts with the same words in the same order are one text, whatever their number. Texts whose
    fingerprints are at most three bits apart, for one of six fingerprints, are candidates of each other; groups of texts that
    candidates connect are then compared by their shingles, every text of a group with every other, and only links that
    the shingles confirm count. Texts without words, null ones among them, are one text. A null id belongs to the smallest
    id of its component (null if none). Repeated rows stay; other columns are not carried.
    """
    p = params
    marked = stored(
        docs.select(F.col(id_col).alias("doc_id"), _sketch(p)(F.col(text_col).cast("binary")).alias("s")).select("doc_id", "s.digest", "s.fps"),
        "sketches"
    )
    texts = stored(marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.any_value("fps").alias("fps"), F.count("*").alias("n")), "texts")
    each = texts.select("digest", F.posexplode("fps").alias("which", "fp"))
    heads = stored(each.groupBy("which", "fp").agg(F.min("digest").alias("head"), F.count("*").alias("texts")), "heads")
    shared = heads.where("texts > 1").select(F.col("which").alias("_which"), F.col("fp").alias("_fp"), "head")
    star = each.join(shared, (F.col("which") == F.col("_which")) & (F.col("fp") == F.col("_fp"))).select(F.col("head").alias("x"), F.col("digest").alias("y"))
    # by chance the fullest cell holds one in 65,536 fingerprints of a kind
    usual = 4 * heads.count() // (65536 * p.prints)
    near = links(heads.select("which", "fp"), replace(p.grid, dense=max(p.grid.dense, usual), block=max(p.grid.block, usual)))
    side = lambda end, name: heads.select(F.col("which").alias(f"_{end}_which"), F.col("fp").alias(f"_{end}"), F.col("head").alias(name))
    met = lambda df, end, name: df.join(
        side(end, name), (F.col("which") == F.col(f"_{end}_which")) & (F.col(end) == F.col(f"_{end}"))
    ).drop(f"_{end}_which", f"_{end}")
    linked = met(met(near, "a", "x"), "b", "y").select("x", "y")
    candidates = components(star.union(linked), "x", "y")
    tops = lambda found: found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    # the texts of candidate groups, one document each
    wanted = texts.join(tops(candidates), F.col("digest") == F.col("_node")).select(F.col("digest").alias("_digest"), F.col("first_id").alias("_first"), "_root")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    shingled = lambda df: df.withColumn("s", _shingles(p)(F.col("_text")))
    cut = shingled(own.join(wanted.where("_first is not null").hint("merge"), F.col("_id") == F.col("_first"))).where(F.col("_digest") == F.col("s.digest"))
    cut = cut.select("_digest", "_root", "s.shingles")
    nameless = wanted.where("_first is null").select("_digest", "_root")
    if not nameless.isEmpty():  # texts that stand on rows without an id alone
        bare = shingled(own.where("_id is null")).select(F.col("s.digest").alias("_d"), "s.shingles")
        cut = cut.union(bare.join(nameless, F.col("_d") == F.col("_digest")).select("_digest", "_root", "shingles"))
    once = cut.groupBy("_digest").agg(F.any_value("_root").alias("root"), F.any_value("shingles").alias("shingles"))
    sets = stored(once.select(F.col("_digest").alias("digest"), "root", "shingles"), "shingles")
    groups = components(verified_links(sets, p), "x", "y")
    placed = stored(
        texts.join(tops(groups), F.col("digest") == F.col("_node"), "left").select("digest", "first_id", "n", F.coalesce("_root", "digest").alias("root")),
        "placed"
    )
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_text = placed.select("digest", "n", "root").join(
        smallest.select(F.col("root").alias("_r"), "component_id"), F.col("root") == F.col("_r")
    ).select("digest", "n", "component_id")
    by_text = stored(of_text, "components")
    discard(texts, heads, candidates, sets, placed, groups)
    return look_up(marked, by_text, "digest", "n", "doc_id").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SimHashParams | SimilarParams = SimHashParams()) -> DataFrame:
    """docs with one row of each component, that with the smallest id; columns as they were, whatever they are called.

    Components are those of `similar_texts` if its parameters are given, else of `near_duplicates`. Of rows
    that repeat the kept id, that with the smallest text stays. Rows with a null id have nothing to be chosen
    by and stay.
    """
    group = similar_texts if isinstance(params, SimilarParams) else near_duplicates
    found = stored(group(docs, id_col, text_col, params).select("doc_id", "component_id"), "near-duplicates")
    id_name, row_name, kept_name = fresh(docs, "id"), fresh(docs, "row"), fresh(docs, "kept")
    # an id may stand on rows of several components: all its rows count
    kept = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")
    ).where("first")
    ids, key = kept.select(F.col("doc_id").alias(kept_name), "n"), F.col(id_col)
    once = ids.where("n = 1").select(kept_name).hint("merge")  # the same plan at every size: the ids grow with the input
    repeated = ids.where("n > 1").select(kept_name)
    parts = docs.join(once, key == F.col(kept_name), "left_semi").unionByName(docs.where(key.isNull()))
    if not repeated.isEmpty():
        # the minimum over whole rows is found before the shuffle, however often an id repeats
        least = F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit("")))
        first = docs.join(repeated, key == F.col(kept_name), "left_semi").groupBy(key.alias(id_name)).agg(least.alias(row_name))
        parts = parts.unionByName(first.select(f"{row_name}.*"))
    return parts
