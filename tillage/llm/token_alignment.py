"""Alignment of two tokenizers' tokens on the bytes of a text.

Tokens of both sides are ranges of the text's bytes. Walking along both lists of cumulative ends with two pointers gives
the links (pairs of tokens whose ranges overlap) and the groups (stretches between bytes where tokens of both sides
end). A link's worth is how many documents of the corpus hold its pair of ids linked.

Both tokenizers begin a new token at every space that follows something else than white space: the one splits texts
there before it merges, the other has no piece with a space after anything else. So a text is cut into units there, a unit
is aligned once, and texts are put together from units.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import discard, release, stored
from tillage.llm.token_files import PLAIN, gather, joined_row, slices, strings


@dataclass(frozen=True)
class AlignParams:
    """byte_level: a byte-level BPE of the tokenizers library (side A). pieces: a sentencepiece model with byte fallback
    that adds a space (side B). hot: pairs that hold 1/hot of all rows are broadcast, at most `hot` of them. with_groups: whether the
    groups themselves are returned, not only their digest."""

    byte_level: str
    pieces: str
    hot: int = 65536
    with_groups: bool = True


class Merged(NamedTuple):
    """Links as places of tokens (a, b), and whether each token of a side ends a group."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> Merged:
    """Walks along two ascending lists of ends with the same last one. Token i of side A begins where the one before
    ends, so the first token of side B that overlaps it is the first to end behind that, and the last one the first to
    end where it ends or later; both pointers only move on."""
    begins = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, begins, "right"), np.searchsorted(ends_b, ends_a, "left")
    count = last - first + 1
    stops = np.cumsum(count)
    a = np.repeat(np.arange(len(ends_a)), count)
    b = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - count - first, count)
    last_a = ends_b[last] == ends_a
    last_b = np.zeros(len(ends_b), bool)
    last_b[last[last_a]] = True
    return Merged(a, b, last_a, last_b)


def units_of(text: str) -> list[str]:
    """The text, with a space before it, cut before spaces that do not follow white space; units lack that space."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if not held or held[-1].isspace():
            held = f"{held} {p}"
        else:
            out.append(held)
            held = p
    return [*out, held]


#: Texts in which some space is no cut, or stands at an end: their units are found one by one. White space.
_UNEVEN = "[\\s\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}] |^ | $"


#: Bytes of text that a task aligns together; a longer text goes alone.
_SLICE = 2 << 20


class Aligned(NamedTuple):
    """What a text's alignment comes to. groups: `a1,a2|b1;a3|b2,b3` in decimal ids. pairs: a id * 2^32 + b id, distinct and
    ascending, times: how often each is linked."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray
    times: np.ndarray


NOTHING = Aligned(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligner:
    """Aligns texts; the ids of short units are remembered, a bounded number of them."""

    def __init__(self, byte_level: str, pieces: str, most: int = 300_000, longest: int = 40):
        import pyarrow as pa
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.merges = self.a.model
        self.b = SentencePieceProcessor(model_file=pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.most, self.longest = most, longest
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.plain = re.compile(PLAIN).fullmatch if plain else None  # $ alone would leave out a line end behind the word
        # byte-level tokens name bytes by characters: printable ones by themselves, the others by what comes after 255
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [i for i in range(256) if i not in set(printable)]
        self.names = {i: 256 + n for n, i in enumerate(others)}
        byte_of = {chr(i): i for i in printable} | {chr(n): i for i, n in self.names.items()}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        spelled_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]
        piece = self.b.id_to_piece
        spelled_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.spelled = pa.array(spelled_a, pa.large_binary()), pa.array(spelled_b, pa.large_binary())
        self.sizes = tuple(np.array([len(x) for x in s]) for s in (spelled_a, spelled_b))
        n, m = len(spelled_a), len(spelled_b)
        # ids in decimal with what follows them: inside a group and at the end of its side
        shown = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]
        self.shown = pa.array([x.encode() for x in shown], pa.large_binary())
        self.space = array("I", [self.b.piece_to_id("▁")]).tobytes()

    def _ids_a(self, new: list[str]) -> list[bytes]:
        """A word of letters falls into itself and its marks; every other unit goes through the whole library."""
        out: list[bytes | None] = []
        name = lambda t: t if t.isascii() else t.encode().decode("latin-1").translate(self.names)
        for u in new:
            m = self.plain and self.plain(u)
            if m:
                found = [t.id for t in self.merges.tokenize("\u0120" + name(m[1]))]
                out.append(array("I", found + [t.id for t in self.merges.tokenize(m[2])] if m[2] else found).tobytes())
            else:
                out.append(None)
        rest = [f" {u}" for u, x in zip(new, out) if x is None]
        coded = iter(self.a.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [array("I", next(coded).ids).tobytes() if x is None else x for x in out]

    def ids(self, units: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of 32 bits of both sides for different units."""
        known = self.known
        found = [known.get(u) for u in units]
        if None in found:
            new = [u for u, x in zip(units, found) if x is None]
            # side B adds the space itself, but not to nothing
            b = [array("I", ids).tobytes() if u else self.space for u, ids in zip(new, self.b.encode(new, num_threads=1))]
            spelled = dict(zip(new, zip(self._ids_a(new), b)))
            if len(known) + len(spelled) > self.most:
                known.clear()
            known.update((u, x) for u, x in spelled.items() if len(u) <= self.longest)
            found = [spelled[u] if x is None else x for u, x in zip(units, found)]
        return [x for x, _ in found], [x for _, x in found]

    def _misspelled(self, units: list[str], sides) -> np.ndarray:
        """Whether some side's tokens do not spell a unit."""
        raw = [b" " + u.encode() for u in units]
        bad = np.zeros(len(units), bool)
        for (ids, sizes), spelled, length in zip(sides, self.spelled, self.sizes):
            joined = self._bytes(spelled, ids)
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(sizes)]
            if joined != b"".join(raw) or (np.cumsum([len(r) for r in raw]) != ends).any():
                begins = np.concatenate([[0], ends[:-1]])
                bad |= np.array([joined[i:j] != r for i, j, r in zip(begins.tolist(), ends.tolist(), raw)], bool)
        return bad

    @staticmethod
    def _bytes(table, at: np.ndarray) -> bytes:
        return _data(table.take(_arrow(at)))[0]

    def _together(self, lists, out: list[Aligned], rows: np.ndarray) -> None:
        """Aligns texts given as an Arrow array of lists of units, and puts them into out at rows."""
        coded = lists.flatten().dictionary_encode()
        units = strings(coded.dictionary)
        sides = [joined_row(x) for x in self.ids(units)]
        at, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bad = self._misspelled(units, sides)
        if bad.any():
            before = np.concatenate([[0], np.cumsum(bad[at])])
            good = before[offsets[1:]] == before[offsets[:-1]]
            if good.any():
                self._together(lists.filter(_arrow(good)), out, rows[good])
            return
        (a, ends_a), (b, ends_b) = (gather(ids, sizes, at) for ids, sizes in sides)
        of = lambda ends: np.concatenate([[0], ends])[offsets]  # noqa: E731  a text's first and last token
        cut_a, cut_b = of(ends_a), of(ends_b)
        m = merge_ends(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        groups = np.concatenate([[0], np.cumsum(m.last_a)])
        # ids in the order in which groups are written: a token stands behind all tokens of earlier groups, and those of side B
        # behind their group's of side A
        stop_a, stop_b = np.flatnonzero(m.last_a) + 1, np.flatnonzero(m.last_b) + 1
        place_a = np.arange(len(a)) + np.concatenate([[0], stop_b])[groups[:-1]]
        place_b = np.arange(len(b)) + stop_a[np.cumsum(m.last_b) - m.last_b]
        n, k = len(self.sizes[0]), len(self.sizes[1])
        written = np.zeros(len(a) + len(b), np.int64)
        written[place_a] = a + n * m.last_a
        written[place_b] = 2 * n + b + k * m.last_b
        text, marks = _data(self.shown.take(_arrow(written)))
        marks = marks[cut_a + cut_b]
        # distinct pairs of each text
        doc = np.repeat(np.arange(len(rows)), np.diff(cut_a))[m.a]
        keys, times = np.unique((doc * n + a[m.a]) * k + b[m.b], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(rows) + 1) * (n * k))
        pairs = ((keys // k % n) << 32) + keys % k
        linked = np.searchsorted(m.a, cut_a)
        for i, row in enumerate(rows.tolist()):
            own = slice(cuts[i], cuts[i + 1])
            out[row] = Aligned(
                int(cut_a[i + 1] - cut_a[i]), int(cut_b[i + 1] - cut_b[i]), int(groups[cut_a[i + 1]] - groups[cut_a[i]]), int(linked[i + 1] - linked[i]),
                text[marks[i] : marks[i + 1] - 1], pairs[own], times[own]
            )

    def __call__(self, texts: list[str | None]) -> list[Aligned]:
        """Null and empty texts, and those that some side's tokens do not spell, have no tokens."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column, out, at = pa.array(texts, pa.string()), [NOTHING] * len(texts), 0
        for part in slices(column, _SLICE):
            rows = np.arange(at, at + len(part))
            full = pc.fill_null(pc.greater(pc.binary_length(part), 0), False)
            uneven = pc.fill_null(pc.match_substring_regex(part, _UNEVEN), False)
            even, odd = (pc.and_(full, x).to_numpy(zero_copy_only=False) for x in (pc.invert(uneven), uneven))
            if even.any():
                self._together(pc.split_pattern(part.filter(_arrow(even)), " "), out, rows[even])
            if odd.any():
                self._together(pa.array([units_of(t) for t in part.filter(_arrow(odd)).to_pylist()], pa.list_(pa.string())), out, rows[odd])
            at += len(part)
        return out


def _arrow(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _data(column) -> tuple[bytes, np.ndarray]:
    """All bytes of a new Arrow array of byte strings in a row, and where each begins and the last ends."""
    if not len(column):
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    return column.buffers()[2].to_pybytes()[: offsets[-1]], offsets


@functools.lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One for each worker."""
    return Aligner(byte_level, pieces)


_ALIGNED = "doc string, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def aligned(docs: DataFrame, id_col: str, text_col: str, p: AlignParams) -> DataFrame:
    """Each text by itself: counts, groups, and its distinct pairs with how often each is linked."""

    def run(frames):
        import pandas as pd
        from hashlib import sha256

        align = aligner(p.byte_level, p.pieces)
        for frame in frames:
            release()
            for i in range(0, len(frame), 1000):
                part = frame.iloc[i : i + 1000]
                found = align(part["text"].tolist())
                rows = [
                    (doc, *x[:4], x.groups.decode() if p.with_groups else None, sha256(x.groups).hexdigest() if x.n_a else "", x.pairs, x.times)
                    for doc, x in zip(part["doc"], found)
                ]
                yield pd.DataFrame(rows, columns=["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])

    # ids pass as strings: pandas would turn longs beside nulls into doubles
    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n_docs, best_a, best_b): documents that hold a pair linked, and whether no pair of its A (B) id has more."""
    counted = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair-counts")
    sided = counted.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    for side in "ab":
        top = sided.groupBy(side).agg(F.max("n_docs").alias(f"_top_{side}")).withColumnRenamed(side, f"_{side}")
        sided = sided.join(top, F.col(side) == F.col(f"_{side}")).withColumn(f"best_{side}", F.col("n_docs") == F.col(f"_top_{side}"))
    out = stored(sided.select("pair", "n_docs", "best_a", "best_b"), "pairs")
    discard(counted)
    return out


def align_tokens(docs: DataFrame, params: AlignParams, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). A row for each row of docs: the id, n_a, n_b, n_groups, n_links, n_best_a and n_best_b (links whose
    pair is the most frequent of its A or B id), count_sum (documents of the pair, over links), groups, groups_sha256.

    Null and empty texts, and those that a side's tokens do not spell byte by byte, have no tokens: zeros and an empty string in
    place of groups and digest. Repeated rows and null ids are rows like others. Other columns are not carried. Empty input gives no
    rows. A text's tokens are never cut, whatever its length. Pairs that hold much of the rows are broadcast (their number is bounded
    by the share that makes them so), the others meet their rows in a shuffle join, so no task gathers a frequent pair.
    """
    p = params
    found = stored(aligned(docs, id_col, text_col, p).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(found)
    total = pairs.agg(F.sum("n_docs").alias("n")).first()["n"] or 0
    often = F.col("n_docs") * p.hot >= F.lit(max(total, p.hot))
    side = pairs.select(F.col("pair").alias("_pair"), "n_docs", "best_a", "best_b")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    near = each.join(F.broadcast(side.where(often)), F.col("pair") == F.col("_pair"), "left")
    sums = lambda df: df.groupBy("row").agg(
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best_a"),
        F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    rest = near.where("_pair is null").select("row", "pair", "times").join(side.where(~often), F.col("pair") == F.col("_pair"))
    names = ["n_best_a", "n_best_b", "count_sum"]
    both = sums(near.where("_pair is not null")).union(sums(rest)).groupBy(F.col("row").alias("_of")).agg(*[F.sum(n).alias(n) for n in names])
    out = found.join(both, F.col("row") == F.col("_of"), "left").select(
        F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names],
        "groups", "groups_sha256"
    )
    return out, pairs
