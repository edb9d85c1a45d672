"""Language-model scoring with a gated recurrent network, trained and applied in numpy.

Words in the model's vocabulary are predicted in two steps, class and word within class, so that the
output layer costs the square root of the vocabulary. All other words fall into rare classes that
their spelling decides; inside a rare class the corpus counts give the probability, with one share
for unseen words. Over words and the end of text this is a proper distribution. A document is read
from its first to its last word in windows, the state carried from each window to the next.

Corpus counts cover every training document and stay distributed. The network's weights start from a
bounded sample and are then learned from every training document, whole: in each round every task runs
truncated backpropagation over its documents, and the tasks' weights are averaged. What reaches the driver
is bounded: the most frequent words, one row per rare class, that sample, and one sum of weights a round.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import release, stored

#: A key no word can be: words hold no space.
END = b" end"


@dataclass(frozen=True)
class GruParams:
    """vocabulary, classes, hidden: sizes of the network; the vocabulary grows to `growth` times the cube root
    of the training tokens, at most `common`, and the classes to its square root. rare: rare classes. common:
    words whose counts are broadcast; any other word is looked up by a join, and none of those has more than
    1/common of all tokens. sample_docs, sample_chars, sample_tokens: bounds of the sample of whole documents
    that the weights start from (how many, how long each, how much in all). steps: gradient steps on the sample,
    in as many whole epochs as it takes. lanes, window: training batch and truncation of backpropagation.
    rounds, wide: averaged rounds that together read every training document once, and their lanes; stretch:
    tokens that a lane reads on end. piece: bytes
    of texts that are coded at a time. group: tokens scored together."""

    vocabulary: int = 1023
    classes: int = 32
    hidden: int = 12
    rare: int = 16
    common: int = 1 << 16
    sample_docs: int = 1200
    sample_chars: int = 40_000
    sample_tokens: int = 240_000
    steps: int = 1000
    lanes: int = 48
    window: int = 20
    rate: float = 4e-3
    growth: int = 4
    rounds: int = 3
    wide: int = 384
    stretch: int = 640
    piece: int = 12 << 20
    group: int = 350_000
    seed: int = 5


_EDGE = np.zeros(256, bool)
_EDGE[np.frombuffer(b".,;:!?\"'()[]{}<>|*#$%&-0123456789", np.uint8)] = True


def rare_classes(words, classes: int) -> np.ndarray:
    """Of each word (an Arrow array of strings) its rare class: by the last two bytes before the marks and digits
    that end it, and by whether any do."""
    data, start, stop = _bytes(words)
    end = stop.copy()
    while True:
        more = np.flatnonzero(end > start)
        more = more[_EDGE[data[end[more] - 1]]]
        if not len(more):
            break
        end[more] -= 1
    last = np.where(end > start, data[np.maximum(end - 1, 0)], 0).astype(np.int64)
    second = np.where(end > start + 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    half = classes // 2
    return ((last * 31 + second * 131) % half + half * (end < stop)).astype(np.int32)


def _bytes(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings, and where each begins and ends."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2] if len(words) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    return data, offsets[:-1], offsets[1:]


def _pieces(texts, size: int):
    """An Arrow array of texts in slices of about `size` bytes, texts whole; nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def _split(texts) -> tuple:
    """The words of texts in a row, A-Z lower-cased, as an Arrow array; and how many each text has."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # blanks at a text's edges leave empty words; every text has one word at least
        size = np.add.reduceat(full.astype(np.int64), np.cumsum(size) - size)
        words = words.filter(full)
    return words, size.astype(np.int64)


_NAMES = ("x", "u", "b", "wc", "bc", "ww", "bw")


class GruModel:
    """Weights, vocabulary and counts. Token ids: words 0.., then rare classes, then the start.

    Words are dealt to classes in order of frequency, each class with about the same sum of the counts' square
    roots: frequent words stand in classes of few words, or alone, so that most tokens cost little.
    """

    def __init__(self, p: GruParams, words: list[tuple[bytes, int]], rare: np.ndarray, tokens: int, distinct: int):
        """words: the vocabulary with counts, most frequent first. rare: [class, (tokens, distinct words)]."""
        self.p = p
        self.ids = {w: i for i, (w, _) in enumerate(words)}
        n, k, rng, f = len(words), p.hidden, np.random.default_rng(p.seed), np.float32
        self.n = n
        c = np.array([m for _, m in words], float)
        weight = np.sqrt(c + 1)
        own = np.minimum((p.classes * (weight.cumsum() - weight / 2) / max(weight.sum(), 1)).astype(np.int64), p.classes - 1)
        _, own = np.unique(own, return_inverse=True) if n else (None, own)
        self.n_classes = int(own[-1]) + 1 if n else 0
        self.kinds = np.concatenate([own, self.n_classes + np.arange(p.rare)])
        self.edges = np.searchsorted(own, np.arange(self.n_classes + 1))
        self.rare_den = np.log10(rare.sum(1) + 1.0)
        self.log_den = float(np.log10(tokens + distinct + 1.0))
        self.x = (rng.standard_normal((n + p.rare + 1, 3 * k)) * 0.1).astype(f)
        self.u = (rng.standard_normal((k, 3 * k)) / np.sqrt(k)).astype(f)
        self.b = np.zeros(3 * k, f)
        self.wc = (rng.standard_normal((k, self.n_classes + p.rare)) * 0.05).astype(f)
        self.ww = (rng.standard_normal((n, k)) * 0.05).astype(f)
        inside = np.add.reduceat(c, self.edges[:-1]) if n else np.zeros(0)
        mass = np.concatenate([inside, rare[:, 0]]) + 1.0
        self.bc = np.log(mass / mass.sum()).astype(f)
        self.bw = np.log((c + 1) / (inside + np.diff(self.edges))[own]).astype(f) if n else np.zeros(0, f)

    def tokens(self, texts) -> list[np.ndarray]:
        """The token ids of each text of an Arrow array, the end included."""
        words, size = _split(texts)
        coder = self.__dict__.get("coder") or self.__dict__.setdefault("coder", _Coder(list(self.ids)))
        ids, new = coder(words)
        rare = self.n + rare_classes(new, self.p.rare)
        ids = np.concatenate([np.arange(self.n), rare])[ids]
        stop = np.cumsum(size)
        return np.split(np.insert(ids, stop, self.ids[END]), (stop + np.arange(1, len(size) + 1))[:-1])

    def _cell(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from inputs g (with bias) and states h: new state, both gates in one array, candidate, and
        what the reset gate scales."""
        k = self.p.hidden
        a = h @ self.u
        zr = g[:, : 2 * k] + a[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        inner = a[:, 2 * k :]
        c = zr[:, k:] * inner
        c += g[:, 2 * k :]
        np.tanh(c, out=c)
        new = c - h
        new *= zr[:, :k]
        new += h
        return new, zr, c, inner

    def log_probability(self, h: np.ndarray, target: np.ndarray, grads: bool = False):
        """Natural log of P(class) times P(word | class); with grads also the gradients of its sum."""
        kind = self.kinds[target].astype(np.int16)  # short numbers sort fast
        rows = np.arange(len(h))
        out, e, total = _softmax(h @ self.wc + self.bc, rows, kind)
        if grads:
            e /= -total[:, None]
            e[rows, kind] += 1
            dh, dwc, dbc = e @ self.wc.T, h.T @ e, e.sum(0)
            dww, dbw = np.zeros_like(self.ww), np.zeros_like(self.bw)
        order = np.argsort(kind, kind="stable")
        edge = np.searchsorted(kind[order], np.arange(self.n_classes + 1)).tolist()
        for c in range(self.n_classes):
            at, a, z = order[edge[c] : edge[c + 1]], self.edges[c], self.edges[c + 1]
            if not len(at) or z - a == 1:  # a word that stands alone is certain
                continue
            own, place = h[at], np.arange(len(at))
            within = target[at] - a
            lp, e, total = _softmax(own @ self.ww[a:z].T + self.bw[a:z], place, within)
            out[at] += lp
            if grads:
                e /= -total[:, None]
                e[place, within] += 1
                dh[at] += e @ self.ww[a:z]
                dww[a:z], dbw[a:z] = e.T @ own, e.sum(0)
        return (out, dh, dwc, dbc, dww, dbw) if grads else out

    def gradients(self, x, y, new, h, on=None):
        """One window, [lane, step]: the last state, the log-probabilities, the gradients of their sum and, for
        the inputs, the rows touched and their gradients. Where `on` is false there is no token."""
        k, (lanes, steps), kind = self.p.hidden, x.shape, self.u.dtype
        inputs = self.x[x.T] + self.b
        before, states = np.empty((steps, lanes, k), kind), np.empty((steps, lanes, k), kind)
        trail = []
        for t in range(steps):
            before[t] = h
            before[t][new[:, t]] = 0
            h, *rest = self._cell(inputs[t], before[t])
            states[t] = h
            trail.append(rest)
        flat = states.reshape(-1, k)
        at = slice(None) if on is None else np.flatnonzero(on.T.ravel())
        out, d_at, dwc, dbc, dww, dbw = self.log_probability(flat[at], y.T.ravel()[at], True)
        dh = np.zeros((steps, lanes, k), kind)
        dh.reshape(-1, k)[at] = d_at
        to_x, to_a = np.empty((steps, lanes, 3 * k), kind), np.empty((steps, lanes, 3 * k), kind)
        back, turned = np.zeros((lanes, k), kind), np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            zr, c, inner = trail[t]
            z, r = zr[:, :k], zr[:, k:]
            d = dh[t]
            d += back
            dz = d * z
            dc = 1 - c * c
            dc *= dz  # through the candidate
            to_x[t, :, 2 * k :] = dc
            to_a[t, :, 2 * k :] = dc * r
            dz *= 1 - z
            dz *= c - before[t]
            dr = dc * inner
            dr *= r
            dr *= 1 - r
            to_x[t, :, :k] = to_a[t, :, :k] = dz
            to_x[t, :, k : 2 * k] = to_a[t, :, k : 2 * k] = dr
            back = to_a[t] @ turned
            d *= 1 - z
            back += d
            back[new[:, t]] = 0
        full = to_x.reshape(-1, 3 * k)
        g = {"u": before.reshape(-1, k).T @ to_a.reshape(-1, 3 * k), "b": full.sum(0), "wc": dwc, "bc": dbc, "ww": dww, "bw": dbw}
        ids = x.T.ravel()
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        return h, out, g, rows, np.add.reduceat(full[order], first, axis=0)

    def _stretches(self, texts, lanes: int, stretch: int):
        """x, y, new, on of [lane, step] from an iterable of token arrays, every token once: the texts in a row,
        cut into equal stretches, one a lane."""
        begin = last = self.n + self.p.rare

        def cut(flow, fresh):
            nonlocal last
            x = np.concatenate([[last], flow[:-1]])
            x[fresh] = begin
            last = flow[-1]
            used = min(lanes, len(flow))
            width = -(-len(flow) // used)
            pad = lambda v, fill: np.concatenate([v, np.full(used * width - len(v), fill, v.dtype)]).reshape(used, width)
            return pad(x, begin), pad(flow, begin), pad(fresh, False), pad(np.ones(len(flow), bool), False)

        tokens, starts, size = [], [], 0
        for text in texts:
            if len(text):
                tokens.append(text)
                starts.append(np.arange(len(text)) == 0)
                size += len(text)
            if size >= lanes * stretch:
                flow, fresh = np.concatenate(tokens), np.concatenate(starts)
                whole = size - size % (lanes * stretch)
                for i in range(0, whole, lanes * stretch):
                    yield cut(flow[i : i + lanes * stretch], fresh[i : i + lanes * stretch])
                tokens, starts, size = [flow[whole:]], [fresh[whole:]], size - whole
        if size:
            yield cut(np.concatenate(tokens), np.concatenate(starts))

    def _train(self, texts, lanes: int, stretch: int, rate, moments: dict) -> tuple[float, np.ndarray, np.ndarray]:
        """One pass of truncated backpropagation with Adam; each lane carries its state from window to window and
        resets it where a document starts. rate: of a step's number. Returns the sum of log-probabilities, and how
        often each input row and each class was learned from."""
        read, kinds, total = np.zeros(len(self.x)), np.zeros(self.n_classes + self.p.rare), 0.0
        full = lanes * self.p.window
        for x, y, new, on in self._stretches(texts, lanes, stretch):
            h = np.zeros((len(x), self.p.hidden), np.float32)
            whole = bool(on.all())
            for a in range(0, x.shape[1], self.p.window):
                part = slice(a, a + self.p.window)
                some = on[:, part]
                h, out, g, rows, g["x"] = self.gradients(x[:, part], y[:, part], new[:, part], h, None if whole else some)
                read += np.bincount(x[:, part][some], minlength=len(read))
                kinds += np.bincount(self.kinds[y[:, part][some]], minlength=len(kinds))
                total += float(out.sum())
                step = moments["step"] = moments.get("step", 0) + 1
                # a thin last window moves the weights less
                pace = rate(step) * min(1.0, len(out) / full) / (1 - 0.9**step)
                for n in _NAMES:
                    pick = rows if n == "x" else slice(None)
                    w = getattr(self, n)
                    if n not in moments:
                        moments[n] = np.zeros_like(w), np.zeros_like(w)
                    first, second = moments[n]
                    q = g[n] / np.float32(len(out))
                    one = first[pick] + 0.1 * (q - first[pick])
                    two = second[pick] + 0.01 * (q * q - second[pick])
                    first[pick], second[pick] = one, two
                    w[pick] += (pace * one / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return total, read, kinds

    def learn(self, texts, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Learns from an iterable of token arrays, every token of each once, in one pass."""
        return self._train(texts, self.p.wide, self.p.stretch, lambda step: rate * min(1.0, step / 20), {})[1:]

    def fit(self, texts: list) -> list[float]:
        """Learns from a sample in as many epochs as `steps` takes; mean log-probability of each epoch."""
        p, rng = self.p, np.random.default_rng(self.p.seed)
        size = sum(map(len, texts))
        epochs = max(1, -(-p.steps // max(1, size // (p.lanes * p.window))))
        steps = epochs * -(-size // (p.lanes * p.window))
        report, moments = [], {}
        rate = lambda step: p.rate * min(1.0, step / 50) * max(0.1, 1 - step / max(steps, 1))
        for _ in range(epochs):
            order = [np.asarray(texts[i], np.int64) for i in rng.permutation(len(texts)).tolist()]
            total = self._train(order, p.lanes, max(1, -(-size // p.lanes)), rate, moments)[0]
            report.append(total / max(size, 1))
        return report

    def _weights(self, read: np.ndarray, kinds: np.ndarray):
        """(name, weight of each of its rows): a row counts as often as it was learned from."""
        inside = np.repeat(kinds[: self.n_classes], np.diff(self.edges))
        whole = kinds.sum()
        return [("x", read[:, None]), ("ww", inside[:, None]), ("bw", inside), *[(n, whole) for n in ("u", "b", "wc", "bc")]]

    def weighed(self, read: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The weights times how often they were learned from, and those numbers, as one vector to be summed."""
        return np.concatenate([*[(getattr(self, n) * w).ravel() for n, w in self._weights(read, kinds)], read, kinds])

    def settle(self, total: np.ndarray) -> None:
        """Takes the mean of the weights in a sum of `weighed`; rows nobody learned from stay."""
        at = len(total) - self.n_classes - self.p.rare
        read, kinds = total[at - len(self.x) : at], total[at:]
        at = 0
        for n, w in self._weights(read, kinds):
            old = getattr(self, n)
            part = total[at : at + old.size].reshape(old.shape)
            setattr(self, n, np.where(w > 0, part / np.maximum(w, 1), old).astype(np.float32))
            at += old.size

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each text's tokens, up to the word within a rare class."""
        sums = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order])
        if not len(size) or size[0] == 0:
            return sums
        y = np.concatenate([texts[i] for i in order])
        offset = np.cumsum(size) - size
        x = np.concatenate([[self.n + self.p.rare], y[:-1]])
        x[offset[size > 0]] = self.n + self.p.rare
        lp, h, inputs = np.empty(len(y)), np.zeros((len(size), self.p.hidden), np.float32), self.x + self.b
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right").tolist()
        states, places, held = [], [], 0
        for t in range(int(size[0])):
            n = active[t]
            at = offset[:n] + t
            h = self._cell(inputs[x[at]], h[:n])[0]
            states.append(h)
            places.append(at)
            held += n
            if held >= 32768 or t + 1 == size[0]:  # the output layer of a window at once; h goes on
                at = np.concatenate(places)
                lp[at] = self.log_probability(np.concatenate(states), y[at])
                states, places, held = [], [], 0
        sums[np.array(order)[size > 0]] = np.add.reduceat(lp, offset[size > 0])
        return sums


def _softmax(a: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of the targets; and the exponentials with their sums, of which a is overwritten."""
    top = a.max()
    if top - a.min() > 60:  # one shift for all rows could lose some of them
        a -= a.max(1, keepdims=True)
    else:
        a -= top
    out = a[rows, target]
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype)
    out -= np.log(total)
    return out, a, total


def word_counts(docs: DataFrame, text_col: str, p: GruParams) -> DataFrame:
    """(word, kind, n): counts over all texts, A-Z lower-cased; kind is the word's rare class. Tasks count
    before the shuffle."""

    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in it:
            for texts in _pieces(b.column(0), p.piece):
                found = pc.value_counts(_split(texts)[0])
                words, n = found.field("values"), found.field("counts")
                yield pa.RecordBatch.from_arrays([words, pa.array(rare_classes(words, p.rare)), n], ["word", "kind", "n"])

    return docs.select(text_col).mapInArrow(run, "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


_SCORED = "struct<n_tokens: bigint, n_known: bigint, base: double, model: double, rest: array<struct<word: string, n: int>>>"


class _Coder:
    """Words to numbers: listed words by their place in the list, others by what comes after it."""

    def __init__(self, words: list[bytes]):
        self.words = words

    def __call__(self, words) -> tuple[np.ndarray, object]:
        """The distinct words' numbers spread over the words, and the distinct words that are not listed."""
        import pyarrow as pa
        import pyarrow.compute as pc

        listed = self.__dict__.get("listed")
        if listed is None:  # made once a worker
            listed = self.listed = pa.array(self.words, pa.binary()).cast(pa.string())
        coded = words.dictionary_encode()
        own = pc.index_in(coded.dictionary, value_set=listed)
        new = pc.is_null(own).to_numpy(zero_copy_only=False)
        number = pc.fill_null(own, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[new] = len(self.words) + np.arange(int(new.sum()))
        return number[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.filter(new)

    def __getstate__(self):
        return {"words": self.words}


class _Scorer:
    """The model with the common words; by row of a word: token id, log10(count + 1), log10 of the rare class's
    denominator (0: in the vocabulary), whether the count is positive. The last row is the end of a text."""

    def __init__(self, model: GruModel, common: dict[bytes, int], ends: int):
        import pyarrow as pa

        self.model, self.coder = model, _Coder(list(common))
        kinds = model.n + rare_classes(pa.array(list(common), pa.binary()).cast(pa.string()), model.p.rare)
        token = np.array([model.ids.get(w, -1) for w in common], np.int32)
        self.token = np.append(np.where(token < 0, kinds, token), model.ids[END]).astype(np.int32)
        count = np.array([*common.values(), ends], float)
        self.log_count, self.positive = np.log10(count + 1.0), count > 0
        self.den = np.where(self.token < model.n, 0.0, model.rare_den[np.maximum(self.token - model.n, 0)])


def _score_piece(scorer: _Scorer, texts):
    """The columns of _SCORED for an Arrow array of texts."""
    import pyarrow as pa

    m = scorer.model
    words, size = _split(texts)
    rows, new = scorer.coder(words)
    rows += rows >= len(scorer.coder.words)  # the place of the end
    kinds = rare_classes(new, m.p.rare)
    token = np.concatenate([scorer.token, m.n + kinds])
    log_count = np.concatenate([scorer.log_count, np.zeros(len(kinds))])
    den = np.concatenate([scorer.den, m.rare_den[kinds]])
    positive = np.concatenate([scorer.positive, np.zeros(len(kinds), bool)])
    inside = np.where(token < m.n, 0.0, log_count) - den
    at = np.insert(rows, np.cumsum(size), len(scorer.coder.words))
    size = size + 1
    start = np.cumsum(size) - size
    total = lambda x: np.add.reduceat(x, start)
    base = total(log_count[at]) - m.log_den * size
    lp = total(inside[at])
    code = np.split(token[at], start[1:])
    # documents of like length go together, so that the lanes stay full
    order, held, group = np.argsort(-size, kind="stable"), 0, []
    scores = np.zeros(len(size))
    for n, i in enumerate(order.tolist()):
        group.append(i)
        held += int(size[i])
        if held >= m.p.group or n + 1 == len(order):
            scores[group] = m.score([code[j] for j in group])
            held, group = 0, []
    lp += scores / np.log(10)
    # what the join must look up: distinct words of each document, with how often they occur
    first = len(scorer.token)
    far = np.flatnonzero(at >= first)
    width = max(len(new), 1)
    pair, times = np.unique(np.repeat(np.arange(len(size)), size)[far] * width + (at[far] - first), return_counts=True)
    entry = pa.StructArray.from_arrays([new.take(pa.array(pair % width)), pa.array(times.astype(np.int32))], ["word", "n"])
    ends = np.searchsorted(pair // width, np.arange(len(size) + 1)).astype(np.int32)
    return [pa.array(size), pa.array(total(positive[at].astype(np.int64))), pa.array(base), pa.array(lp), pa.ListArray.from_arrays(pa.array(ends), entry)]


def _scored(shared):
    @F.arrow_udf(_SCORED)
    def run(texts):
        import pyarrow as pa

        release()
        names = ["n_tokens", "n_known", "base", "model", "rest"]
        parts = [_score_piece(shared.value, piece) for piece in _pieces(texts, shared.value.model.p.piece)]
        if not parts:
            entry = pa.struct([("word", pa.string()), ("n", pa.int32())])
            return pa.array([], pa.struct([(n, t) for n, t in zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(entry)])]))
        out = pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names)
        return out

    return run


def _learn_all(learn: DataFrame, model: GruModel) -> None:
    """Trains the model on every document of learn (doc_id, text): rounds of documents by hash, each round's
    tasks from the same weights, which are then averaged in a tree."""
    p, sc = model.p, learn.sparkSession.sparkContext
    turn = F.pmod(F.xxhash64(F.lit(p.seed + 1), "doc_id", "text"), F.lit(p.rounds))
    for r in range(p.rounds):
        shared, rate = sc.broadcast(model), p.rate / 2 * (1 - r / p.rounds)

        def run(it, shared=shared, rate=rate):
            import copy

            import pyarrow as pa

            own = copy.deepcopy(shared.value)

            def tokens():
                for b in it:
                    for texts in _pieces(b.column(0), own.p.piece):
                        yield from own.tokens(texts)

            read, kinds = own.learn(tokens(), rate)
            if kinds.sum() > 0:
                yield pa.RecordBatch.from_arrays([pa.array([own.weighed(read, kinds).tobytes()], pa.binary())], ["weights"])

        parts = learn.where(turn == r).select("text").mapInArrow(run, "weights binary").rdd.map(lambda x: np.frombuffer(bytes(x[0])))
        add = lambda a, b: b if a is None else a if b is None else a + b
        total = parts.treeAggregate(None, add, add, depth=3)  # the driver merges the cube root of the tasks' number
        if total is not None:
            model.settle(total)
        shared.destroy()


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", params: GruParams = GruParams()) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    `training` says which rows are learned from. Null and empty texts are one token, the end. Repeated
    rows count as often as they occur. Base: add-one unigram log10 probability; score: the network's
    log10 probability of the whole text. With no training rows both are uniform guesses. Other columns
    are not carried; an empty table gives no rows. Tasks learn from equal weights that are then averaged, so the
    network, and with it `score`, depends a little on how the rows are cut into tasks (a test holds the total within 0.5 %
    between one task and eight); base_score does not.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("training")
    )
    learn = rows.where("training")
    counts = stored(word_counts(learn, "text", params), "word-counts")
    ends = learn.count()
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (whole["n"] or 0) + ends, whole["v"] + (ends > 0)
    # the common words are all from some count on; the finest such cut, in eighths of a power of two, that leaves at most the bound
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    cut, found = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        found += r["count"]
        if found > params.common:
            break
        cut = r["step"]
    top = [] if cut is None else sorted(
        ((r["word"].encode(), r["n"]) for r in counts.where(step >= cut).select("word", "n").collect()), key=lambda x: (-x[1], x[0])
    )
    size = min(max(params.vocabulary, int(params.growth * tokens ** (1 / 3))), max(params.common, params.vocabulary))
    if size > params.vocabulary:
        params = replace(params, vocabulary=size, classes=max(params.classes, int(size**0.5)))
    vocabulary = sorted([*top[: params.vocabulary], (END, ends)], key=lambda x: (-x[1], x[0]))
    rare = np.zeros((params.rare, 2))
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rare[r["kind"]] = r["n"], r["v"]
    known = [(w, n) for w, n in vocabulary if w != END]
    for kind, (_, n) in zip(rare_classes(pa.array([w for w, _ in known], pa.binary()).cast(pa.string()), params.rare).tolist(), known):
        rare[kind] -= n, 1
    model = GruModel(params, vocabulary, rare, tokens, distinct)
    # the sample: documents with the smallest hashes, as many as the bound allows
    share = min(1.0, 1.5 * params.sample_docs / max(ends, 1))
    draw = F.pmod(F.xxhash64(F.lit(params.seed), "doc_id", "text"), F.lit(1 << 30))
    near = learn.select(draw.alias("draw"), "doc_id", "text").where((F.col("draw") < int(share * (1 << 30)) + 1) & (F.length("text") <= params.sample_chars))
    sample, used = [], 0
    # rows that repeat an id and a text are drawn together: the limit holds for them, too
    for r in near.orderBy("draw", "doc_id", "text").limit(params.sample_docs).collect():
        ids = model.tokens(pa.array([r["text"]], pa.string()))[0]
        if used + len(ids) > params.sample_tokens:
            continue
        sample.append(ids)
        used += len(ids)
    if sample:
        model.fit(sample)
    _learn_all(learn, model)
    shared = spark.sparkContext.broadcast(_Scorer(model, dict(top), ends))
    marked = rows.withColumn("s", _scored(shared)(F.col("text"))).select("doc_id", "training", "s").withColumn("row", F.monotonically_increasing_id())
    marked = stored(marked.select("row", "doc_id", "training", "s.*"), "scores")
    rest = marked.select("row", F.explode("rest").alias("w")).select("row", F.col("w.word").alias("rare_word"), F.col("w.n").alias("times"))
    looked = rest.join(counts.select("word", F.col("n").alias("c")), F.col("rare_word") == F.col("word"), "left")
    sums = looked.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more")
    )
    full = marked.drop("rest").join(sums, F.col("row") == F.col("_row"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return full.select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
