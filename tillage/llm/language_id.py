"""Language identification by a linear-chain conditional random field over words.

Every word gets scores from hashed affixes and character n-grams and from a lexicon of frequent words;
learned transitions say how readily one language follows another, so words of code-switched text are
labelled one by one. Forward-backward gives each word's posterior; a document's language is the one
with the largest posterior mass over its words with letters.

The field is fitted on a bounded sample of labelled documents (see the parameters), spliced into
code-switched training sequences; prediction reads whole texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm._common import check_absent, release


@dataclass(frozen=True)
class CrfParams:
    """The bound of the labelled sample: of every language the `docs_per_lang` documents with the smallest
    hashes, and of each `window` consecutive words at a place given by its hash.
    slots, lexicon: sizes of the feature tables, the bound on what is broadcast. length, steps, batch,
    rate: training sequences and their gradient steps. segment, context: prediction runs over segments of
    so many words, each with context on both sides, far beyond what the chain remembers."""

    docs_per_lang: int = 400
    window: int = 160
    slots: int = 1 << 16
    lexicon: int = 20_000
    grams: tuple[int, ...] = (1, 2, 3, 4)
    length: int = 40
    steps: int = 120
    batch: int = 192
    rate: float = 0.15
    decay: float = 1e-6
    segment: int = 1024
    context: int = 64
    cache: int = 80_000
    seed: int = 7


_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-0123456789"


def normal(word: bytes) -> bytes:
    return word.lower().strip(_EDGE)


def has_letter(word: bytes) -> bool:
    if word.isascii():
        return any(65 <= c <= 90 or 97 <= c <= 122 for c in word)
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def _features(words: list[bytes], p: CrfParams) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of every hashed feature: n-grams anywhere, and the first and last n bytes as affixes."""
    bodies = [b"\x02" + w + b"\x03" for w in words]
    x = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    slots, owners = [], []
    for n in p.grams:
        m = len(x) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + x[j : j + m] + np.uint64(1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(33)
        whole = np.flatnonzero(of[:m] == of[n - 1 : n - 1 + m])
        slots.append(h[whole])
        owners.append(of[whole])
        if n > 1:  # the word's edge lies inside: these are its prefixes and suffixes
            fits = size >= n
            for at, salt in ((start[fits], 0x51), (start[fits] + size[fits] - n, 0x52)):
                slots.append(h[at] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt))
                owners.append(np.flatnonzero(fits))
    slot = np.concatenate(slots) if slots else np.zeros(0, np.uint64)
    slot = (slot ^ (slot >> np.uint64(29))) & np.uint64(p.slots - 1)
    return slot.astype(np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


class LanguageField:
    """Weights of the field; langs in alphabetical order."""

    def __init__(self, langs: list[str], lexicon: dict[bytes, int], params: CrfParams):
        k = len(langs)
        self.langs, self.lexicon, self.params = langs, lexicon, params
        self.hashed = np.zeros((params.slots, k), np.float32)
        self.known = np.zeros((len(lexicon) + 1, k), np.float32)  # row 0: not in the lexicon
        self.moves = (np.eye(k) * 2).astype(np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """[word, language] scores of normalised words; words without characters score 0."""
        out = self.known[self._rows(words)].copy()
        slot, owner = _features(words, self.params)
        for k in range(len(self.langs)):
            out[:, k] += np.bincount(owner, self.hashed[slot, k], len(words)).astype(np.float32)
        out[np.fromiter((not w for w in words), bool, len(words))] = 0
        return out

    def fit(self, windows: list[tuple[int, list[bytes]]]) -> None:
        """Stochastic gradient of the sequences' log-likelihood; half of them are spliced from several languages."""
        p, k = self.params, len(self.langs)
        rng = np.random.default_rng(p.seed)
        vocabulary: dict[bytes, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in windows]
        langs = np.array([y for y, _ in windows])
        by_lang = [np.flatnonzero(langs == y) for y in range(k)]
        present = [y for y in range(k) if len(by_lang[y])]
        words = list(vocabulary)
        known, empty = self._rows(words), np.fromiter((not w for w in words), bool, len(words))
        slot, owner = _features(words, p)
        order = np.argsort(owner, kind="stable")
        slot, owner = slot[order], owner[order]
        begin = np.searchsorted(owner, np.arange(len(words) + 1))
        squares = [np.full(self.hashed.shape, 1e-2, np.float32), np.full(self.known.shape, 1e-2, np.float32), np.full(self.moves.shape, 1e-2, np.float32)]
        for _ in range(p.steps):
            x, y = np.zeros((p.batch, p.length), np.int64), np.zeros((p.batch, p.length), np.int64)
            for b in range(p.batch):
                cuts = [0, p.length] if rng.random() < 0.5 else [0, *sorted(rng.integers(3, p.length - 3, rng.integers(1, 4)).tolist()), p.length]
                for a, z in zip(cuts, cuts[1:]):
                    lang = present[rng.integers(len(present))]
                    text = coded[by_lang[lang][rng.integers(len(by_lang[lang]))]]
                    at = rng.integers(max(1, len(text) - (z - a) + 1))
                    x[b, a:z] = np.resize(text[at : at + z - a], z - a)
                    y[b, a:z] = lang
            used, inverse = np.unique(x, return_inverse=True)
            spans = [(begin[w], begin[w + 1]) for w in used.tolist()]
            at = np.concatenate([np.arange(a, z) for a, z in spans]) if spans else np.zeros(0, np.int64)
            local, s = np.repeat(np.arange(len(used)), [z - a for a, z in spans]), slot[at]
            scores = self.known[known[used]].astype(np.float64)
            for c in range(k):
                scores[:, c] += np.bincount(local, self.hashed[s, c], len(used))
            scores[empty[used]] = 0
            e = scores[inverse.reshape(x.shape)]
            post, pairs = _forward_backward(e, self.moves.astype(np.float64))
            gold = np.eye(k)[y]
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, inverse.reshape(-1), (gold - post).reshape(-1, k))
            by_word[empty[used]] = 0
            n = p.batch
            grad_moves = np.zeros((k, k))
            np.add.at(grad_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            grad_moves -= pairs
            rows, back = np.unique(s, return_inverse=True)
            grad_hashed = np.stack([np.bincount(back, by_word[local, c], len(rows)) for c in range(k)], 1)
            seen, to = np.unique(known[used], return_inverse=True)
            grad_known = np.stack([np.bincount(to, by_word[:, c], len(seen)) for c in range(k)], 1)
            for table, square, at_rows, g in (
                (self.hashed, squares[0], rows, grad_hashed), (self.known, squares[1], seen, grad_known),
                (self.moves, squares[2], slice(None), grad_moves)
            ):
                g = (g / n - p.decay * table[at_rows]).astype(np.float32)
                square[at_rows] += g * g
                table[at_rows] += p.rate * g / np.sqrt(square[at_rows])


def _forward_backward(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [sequence, place, state] and expected transitions, for sequences of one length."""
    b, n, k = e.shape
    f = np.exp(e - e.max(2, keepdims=True))
    m = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(f), np.empty_like(f)
    a = f[:, 0] / f[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = a
    for t in range(1, n):
        a = (a @ m) * f[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    z = np.ones((b, k))
    beta[:, n - 1] = z
    pairs = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        right = z * f[:, t + 1]
        joint = alpha[:, t, :, None] * m[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        z = right @ m.T
        z /= z.sum(1, keepdims=True)
        beta[:, t] = z
    post = alpha * beta
    return post / post.sum(2, keepdims=True), pairs


class Labeller:
    """Applies a field to whole texts; word scores are cached up to a bound."""

    def __init__(self, field: LanguageField):
        self.field = field
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(field.langs)), np.float32)
        self.letters = np.zeros(0, bool)

    def _codes(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.ids) > self.field.params.cache:
            self.ids, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.ids]
        if fresh:
            for w in fresh:
                self.ids[w] = len(self.ids)
            parts = [self.field.emissions([normal(w) for w in fresh[i : i + 4096]]) for i in range(0, len(fresh), 4096)]  # features of all at once would take a multiple of the texts
            self.scores = np.concatenate([self.scores, *parts])
            self.letters = np.concatenate([self.letters, np.fromiter(map(has_letter, fresh), bool, len(fresh))])
        get = self.ids.__getitem__
        return np.fromiter((get(w) for t in texts for w in t), np.int64)

    def posteriors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """For the words of all texts in a row: posteriors [word, language], and which have letters."""
        codes = self._codes(texts)
        p, k = self.field.params, len(self.field.langs)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length) - length
        # segments: (from, to) of the words read, (a, z) of the words kept
        reads, keeps = [], []
        for s, n in zip(first.tolist(), length.tolist()):
            for a in range(0, n, p.segment):
                z = min(a + p.segment, n)
                reads.append((s + max(0, a - p.context), s + min(n, z + p.context)))
                keeps.append((s + a, s + z))
        out = np.zeros((len(codes), k), np.float32)
        if not reads:
            return out, self.letters[codes]
        span = np.array(reads)
        order = np.argsort(-(span[:, 1] - span[:, 0]), kind="stable")
        span, kept = span[order], np.array(keeps)[order]
        size = span[:, 1] - span[:, 0]
        offset = np.cumsum(size) - size
        f = self.scores[codes[np.repeat(span[:, 0] - offset, size) + np.arange(size.sum())]]
        f = np.exp(f - f.max(1, keepdims=True))
        m = np.exp(self.field.moves - self.field.moves.max()).astype(np.float32)
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # segments longer than t
        alpha = np.empty_like(f)
        a = None
        for t in range(int(size[0])):
            at = offset[: active[t]] + t
            a = f[at] if a is None else (a[: active[t]] @ m) * f[at]
            a = a / a.sum(1, keepdims=True)
            alpha[at] = a
        z = np.ones((0, k), np.float32)
        for t in range(int(size[0]) - 1, -1, -1):
            n = active[t]
            if len(z) < n:
                z = np.concatenate([z, np.ones((n - len(z), k), np.float32)])
            at = offset[:n] + t
            right = z * f[at]
            alpha[at] *= z
            z = right @ m.T
            z /= z.sum(1, keepdims=True)
        alpha /= alpha.sum(1, keepdims=True)
        wide = kept[:, 1] - kept[:, 0]
        row = np.repeat(offset + kept[:, 0] - span[:, 0] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        place = np.repeat(kept[:, 0] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        out[place] = alpha[row]
        return out, self.letters[codes]

    def label(self, texts, runs: bool = False) -> list[tuple]:
        """(language or None, score, runs) of each text (bytes or None, any iterable); runs are (start word, end word, language)."""
        result: list[tuple] = []
        for group in _groups(texts):
            words = [t.split() if t else [] for t in group]
            post, letter = self.posteriors(words)
            at = 0
            for w in words:
                q, on = post[at : at + len(w)], letter[at : at + len(w)]
                at += len(w)
                mass = q[on].sum(0, dtype=np.float64) if len(w) else np.zeros(len(self.field.langs))
                if not mass.sum() > 0:
                    result.append((None, 0.0, []))
                    continue
                best = int(mass.argmax())
                spans = []
                if runs:
                    y = q.argmax(1)
                    edge = np.flatnonzero(np.diff(y)) + 1
                    spans = [(int(a), int(z), self.field.langs[y[a]]) for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(y)])]
                result.append((self.field.langs[best], float(mass[best] / mass.sum()), spans))
        return result


def _groups(texts, size: int = 2 << 20):
    """Texts in groups of about `size` bytes."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or b"")
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def fit_field(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", params: CrfParams = CrfParams()) -> LanguageField:
    """A field learned from text and lang of docs; rows with a null text, lang or id are left out, and
    every language that a row names is learned. What is collected is bounded by the parameters for each
    language; documents without words are not drawn."""
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    n = params.docs_per_lang
    draw = F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.lit(1 << 30))
    # somewhat more than needed, so that few rows are sorted; then exactly the smallest hashes of each language
    near = docs.sparkSession.createDataFrame([(k, int((1 << 30) * min(1.0, (n + 10 * n**0.5 + 50) / c))) for k, c in counts.items()], "lang string, below long")
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    start = F.greatest(F.lit(1), (F.pmod(F.xxhash64("id"), F.greatest(F.size("words") - params.window + 1, F.lit(1))) + 1).cast("int"))
    drawn = rows.withColumn("draw", draw).join(F.broadcast(near), "lang").where("draw < below")
    cut = drawn.select("id", "lang", "draw", words.alias("words")).where(F.size("words") > 0).select(
        "id", "lang", "draw", F.slice("words", start, params.window).alias("words")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "words"))
    sample = cut.withColumn("place", place).where(F.col("place") <= n)
    taken = {lang: [] for lang in langs}
    for r in sorted(sample.collect(), key=lambda r: r["place"]):
        taken[r["lang"]].append([normal(w.encode()) for w in r["words"]])
    windows = [(y, w) for y, lang in enumerate(langs) for w in taken[lang]]
    times: dict[bytes, int] = {}
    for _, ws in windows:
        for w in ws:
            times[w] = times.get(w, 0) + 1
    frequent = sorted((w for w, n in times.items() if n > 2 and w), key=lambda w: (-times[w], w))[: params.lexicon]
    field = LanguageField(langs, {w: i + 1 for i, w in enumerate(frequent)}, params)
    if windows:
        field.fit(windows)
    return field


def _predict(shared, runs: bool):
    kind = "struct<lang: string, score: double" + (", runs: array<struct<start: int, end: int, lang: string>>>" if runs else ">")

    @F.arrow_udf(kind)
    def run(texts):
        import pyarrow as pa

        release()
        field = shared.value
        labeller = field.__dict__.get("_labeller") or field.__dict__.setdefault("_labeller", Labeller(field))
        rows = labeller.label((t.as_py() for t in texts), runs) if field.langs else [(None, 0.0, [])] * len(texts)
        columns = [pa.array([r[0] or "und" for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
        if runs:
            span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
            columns.append(pa.array([[{"start": a, "end": z, "lang": y} for a, z, y in r[2]] for r in rows], pa.list_(span)))
        return pa.StructArray.from_arrays(columns, ["lang", "score", "runs"][: len(columns)])

    return run


def identify(docs: DataFrame, field: LanguageField, text_col: str = "text", out: str = "language", runs: bool = False) -> DataFrame:
    """docs with a struct column `out`: lang, score and, if asked for, runs of words of one language.

    lang is `und` and score 0 for texts that are null or have no letter, and when nothing was learned.
    The score is the winning language's share of the posterior mass of words with letters. Other
    columns pass through; `out` must not be one of them. Repeated rows are judged alike.
    """
    check_absent(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.withColumn(out, _predict(shared, runs)(F.col(text_col).cast("binary")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold whose labels nothing may learn from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
