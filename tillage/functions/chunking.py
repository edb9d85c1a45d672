"""Chunkers: token windows as expressions; greedy packers, which depend on what was packed before, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approximate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("long")


def token_windows(words: Column, target: int = 110, overlap: float = 0.2) -> Column:
    """Windows of `target` words, each starting target x (1 - overlap) after the last; the short tail counts."""
    step = max(1, int(target * (1 - overlap)))
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(target)))


def greedy(pieces: list[str], most: int, joiner: str, size=len) -> list[str]:
    """Pieces joined in order while the size stays within `most`; a longer piece stands alone."""
    out, held, n = [], [], 0
    for p in pieces:
        extra = size(p) + (len(joiner) if held and size is len else 0)
        if held and n + extra > most:
            out.append(joiner.join(held))
            held, n, extra = [], 0, size(p)
        held.append(p)
        n += extra
    return out + ([joiner.join(held)] if held else [])


def pack(pieces: Column, most: int, joiner: str = " ", unit: str = "chars") -> Column:
    """Greedy packing of an array of texts by characters or by words."""

    @F.arrow_udf("array<string>")
    def run(rows):
        import pyarrow as pa

        size = len if unit == "chars" else (lambda s: len(s.split()))
        return pa.array([None if r is None else greedy([x for x in r if x], most, joiner, size) for r in rows.to_pylist()], pa.list_(pa.string()))

    return run(pieces)


def with_previous_tail(chunks: Column, n: int) -> Column:
    """Every chunk after the first prefixed with the last n characters of the one before."""
    return F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get(chunks, i - 1), F.lit(n)), F.lit(" "), c)))


def with_previous_words(chunks: Column, n: int) -> Column:
    """Every chunk after the first prefixed with the last n words of the one before."""
    words = lambda c: F.split(c, r"\s+")
    tail = lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")
    return F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(words(F.get(chunks, i - 1))), F.lit(" "), c)))


def fragment_uid(doc: Column, section: Column, page: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", doc.cast("string"), section.cast("string"), page.cast("string"), F.sha1(F.substring(text, 1, 64))))
