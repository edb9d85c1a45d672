"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document posteriors over domains. Nonnegative
document rates are then fitted by projected gradient least squares so that the expected token totals,
sum of rate x tokens x posterior, match the targets. A rate depends only on the document's posteriors
and on the gradients so far, which are vectors over domains: each pass recomputes rates from that
short history, sums the totals in the tasks and returns one vector, so nothing per document is kept
between passes and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm._common import check_absent, discard, release, stored


@dataclass(frozen=True)
class MixParams:
    """The bound of the labelled sample: `sample` documents by smallest hashes over all domains, `per_domain`
    of every domain, and of each document the `doc_features` features with the smallest hashes; texts of any
    length are drawn and read whole. slots: hashed features. passes, tolerance: limits of the fit (relative
    error of the totals). ridge: pull of rates to 1. max_rate: upper bound of a rate. least: share of the
    whole below which a domain's error weighs no more."""

    sample: int = 6000
    per_domain: int = 64
    doc_features: int = 4096
    slots: int = 1 << 17
    epochs: int = 6
    rate: float = 0.3
    shrink: float = 2e-6
    passes: int = 60
    tolerance: float = 1e-3
    ridge: float = 1e-3
    max_rate: float = 4.0
    least: float = 0.05
    seed: int = 11


_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_"


def features(text: bytes | None, slots: int) -> tuple[np.ndarray, int]:
    """Slots of the distinct words and of shares of capitals and of runs of marks; and the number of words."""
    words = text.split() if text else []
    keys: set[bytes] = set()
    shapes: Counter = Counter()
    for w, n in Counter(words).items():
        core = w.strip(_EDGE)
        keys.add(core.lower())
        tail = w[len(w.rstrip(_EDGE)) :]
        if len(tail) > 1 or not core:
            shapes[b"\x01" + tail[:3]] += n
        if len(core) > 1 and core.isupper():
            shapes[b"\x02"] += n
    for shape, n in shapes.items():
        keys.update(shape + cut for cut, least in ((b"0", 0.02), (b"1", 0.1), (b"2", 0.3)) if n >= least * len(words))
    return np.fromiter((zlib.crc32(k) % slots for k in keys), np.int64, len(keys)), len(words)


@dataclass
class DomainClassifier:
    """Multinomial logistic regression on feature presence; without domains posteriors are empty."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    report: dict = field(default_factory=dict)

    def posteriors(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        out, n = np.zeros((len(texts), len(self.domains))), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            at, n[i] = features(t, len(self.weights))
            a = self.bias + self.weights[at].sum(0)
            e = np.exp(a - a.max()) if len(a) else a
            out[i] = e / e.sum() if len(a) else e
        return out, n


def _sample_features(p: MixParams):
    """The features of a whole text as packed 32-bit slots, at most doc_features of them."""

    @F.arrow_udf("binary")
    def run(texts):
        import pyarrow as pa

        return pa.array([np.sort(_order(features(t.as_py(), p.slots)[0]))[: p.doc_features].astype("<u4").tobytes() for t in texts], pa.binary())

    return run


def _order(slots: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers, so that the smallest are a draw among features."""
    x = slots.astype(np.uint32) * np.uint32(0x9E3779B1)
    return x ^ (x >> np.uint32(15))


def _slots_of(packed: bytes) -> np.ndarray:
    """The slots that _order permuted."""
    x = np.frombuffer(packed, "<u4")
    x = x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))
    return (x * np.uint32(pow(0x9E3779B1, -1, 1 << 32))).astype(np.int64)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MixParams = MixParams()) -> DomainClassifier:
    """labelled: (id, domain). Every domain that a label names is learned. Ids without a document, null ids,
    texts and domains are left out; of several labels of an id the smallest counts. What is collected is
    bounded by (sample + per_domain x domains) x doc_features slots of four bytes."""
    p, spark = params, docs.sparkSession
    named = labelled.select(
        F.col(id_col).alias("_id"), F.col("domain").cast("string").alias("_domain")
    ).where("_id is not null and _domain is not null").groupBy("_id").agg(F.min("_domain").alias("_domain"))
    counts = {r["_domain"]: r["count"] for r in named.groupBy("_domain").count().collect()}  # one row a domain
    domains = sorted(counts)
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "_id"), F.lit(1 << 30))
    # twice as many as wanted, since some have no document: the bound of the broadcast. Few more than those are
    # sorted: a share of the hashes that holds them for certain, however often a domain occurs
    share_of = lambda n, m: int((1 << 30) * min(1.0, (n + 10 * n**0.5 + 50) / max(m, 1)))
    of_all = named.where(draw < share_of(2 * p.sample, sum(counts.values()))).orderBy(draw, "_id").limit(2 * p.sample)
    below = F.broadcast(spark.createDataFrame([(d, share_of(2 * p.per_domain, m)) for d, m in counts.items()], "_domain string, _below long"))
    place = F.row_number().over(Window.partitionBy("_domain").orderBy(draw, "_id"))
    near = named.join(below, "_domain").where(draw < F.col("_below")).select("_id", "_domain")
    of_each = near.withColumn("_place", place).where(F.col("_place") <= 2 * p.per_domain).drop("_place")
    chosen = of_all.union(of_each).distinct()
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where("_text is not null")
    met = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(
        "_id", "_domain", F.xxhash64("_text").alias("_print"), _sample_features(p)(F.col("_text").cast("binary")).alias("_slots")
    )
    # repeated rows of an id: the one with the smallest hash of its text
    single = stored(met.groupBy("_id", "_domain").agg(F.min_by("_slots", F.struct("_print", "_slots")).alias("_slots")), "labelled")
    each = single.withColumn("_place", place).where(F.col("_place") <= p.per_domain).drop("_place")
    found = {r["_id"]: r for r in [*single.orderBy(draw, "_id").limit(p.sample).collect(), *each.collect()]}
    discard(single)
    rows = list(found.values())
    model = DomainClassifier(domains, np.zeros((p.slots, len(domains)), np.float32), np.zeros(len(domains)))
    if not rows:
        return model
    x = [_slots_of(r["_slots"]) for r in rows]
    number = {d: i for i, d in enumerate(domains)}
    y = np.array([number[r["_domain"]] for r in rows])
    share = np.bincount(y, minlength=len(domains)) + 1.0
    model.bias = np.log(share / share.sum())
    square, rng = np.full(model.weights.shape, 1e-2, np.float32), np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for start in range(0, len(rows), 32):
            batch = rng.integers(0, len(rows), 32)
            size = np.array([len(x[i]) for i in batch])
            at, of = np.concatenate([x[i] for i in batch]), np.repeat(np.arange(len(batch)), size)
            a = model.bias + np.stack([np.bincount(of, model.weights[at, k], len(batch)) for k in range(len(domains))], 1)
            e = np.exp(a - a.max(1, keepdims=True))
            miss = np.eye(len(domains))[y[batch]] - e / e.sum(1, keepdims=True)
            used, back = np.unique(at, return_inverse=True)
            g = np.stack([np.bincount(back, miss[of, k], len(used)) for k in range(len(domains))], 1) / len(batch)
            square[used] += (g * g).astype(np.float32)
            step = p.rate / np.sqrt(square[used])
            w = model.weights[used] + step * g
            model.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * p.shrink * 100, 0)
            model.bias += 0.05 * miss.mean(0)
    # rare domains are drawn more often than they occur: back to the share of all labels
    true = np.array([counts[d] for d in domains]) + 1.0
    model.bias += np.log(true / true.sum()) - np.log(share / share.sum())
    return model


def _memberships(shared, fit: RateFit | None = None):
    """A UDF for memberships, and with a fit for rates too: one Python worker does both."""
    kind = "struct<n_tokens: bigint, posteriors: array<double>" + (", rate: double>" if fit else ">")

    @F.arrow_udf(kind)
    def run(texts):
        import pyarrow as pa

        release()
        post, n = shared.value.posteriors([t.as_py() for t in texts])
        columns = [pa.array(n, pa.int64()), pa.array(post.tolist(), pa.list_(pa.float64()))]
        if fit:
            columns.append(pa.array(fit.rates(post), pa.float64()))
        return pa.StructArray.from_arrays(columns, ["n_tokens", "posteriors", "rate"][: len(columns)])

    return run


def with_memberships(docs: DataFrame, model: DomainClassifier, text_col: str = "text", out: str = "membership", fit: RateFit | None = None) -> DataFrame:
    """docs with a struct column: n_tokens and posteriors in the order of model.domains; with a fit the rate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(out, _memberships(shared, fit)(F.col(text_col).cast("binary")))


@dataclass
class RateFit:
    """What gives any document its rate: the gradients of all passes, the step and the bounds."""

    history: np.ndarray
    step: float
    params: MixParams
    domains: list[str]
    targets: np.ndarray
    totals: np.ndarray
    passes: int
    converged: bool = True

    def missed(self) -> dict[str, float]:
        """By domain, how far its expected tokens are from the target, as a share of all target tokens."""
        whole = max(float(self.targets.sum()), 1.0)
        return {d: float((t - w) / whole) for d, t, w in zip(self.domains, self.totals, self.targets)}

    def rates(self, post: np.ndarray) -> np.ndarray:
        r = np.ones(len(post))
        for g in self.history:
            r = np.clip(r - self.step * (post @ g + self.params.ridge * (r - 1)), 0, self.params.max_rate)
        return r


def _matrix(column, k: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if hasattr(column, "combine_chunks") else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], params: MixParams = MixParams()) -> RateFit:
    """members: (n_tokens, posteriors), to be read once for each pass, so a stored table.

    Targets are shares of one total, chosen so that the domain with the largest target share keeps its
    expected tokens: the others are thinned or raised to it. A domain without a weight has target 0.
    A fit that the bounds or the passes keep from its targets is not `converged`, says so in a warning and
    has the misses in `missed()`; so does a weight on a domain that no label names.
    """
    k = len(domains)
    unknown = sorted(d for d, w in weights.items() if w > 0 and d not in domains)
    if unknown:
        warnings.warn(f"no label names the domains {unknown}: their weight goes to the others", stacklevel=2)
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])

    def gather(f, width: int) -> np.ndarray:
        def run(it):
            import pyarrow as pa

            total = np.zeros(width)
            for b in it:
                if b.num_rows:
                    total += f(b.column(0).to_numpy(zero_copy_only=False).astype(float), _matrix(b.column(1), k))
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["place", "value"])

        sums = members.select("n_tokens", "posteriors").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(width)
        for r in sums:
            out[r["place"]] = r["value"]
        return out

    nothing = RateFit(np.zeros((0, k)), 0.0, params, domains, np.zeros(k), np.zeros(k), 0)
    if k == 0 or share.sum() <= 0:
        return nothing
    share = share / share.sum()
    second = gather(lambda n, post: ((post * n[:, None]).T @ post).ravel(), k * k).reshape(k, k)
    current = second.sum(1)  # posteriors add up to 1
    if current.sum() <= 0:
        return nothing
    lead = int(share.argmax())
    whole = current[lead] / share[lead]
    targets = share * whole
    scale = np.maximum(targets, params.least * whole)
    curvature = np.linalg.eigvalsh(second / np.sqrt(np.outer(scale, scale))).max() + params.ridge
    fit = RateFit(np.zeros((0, k)), 1.0 / curvature, params, domains, targets, current, 0)
    while fit.passes < params.passes:
        error = (fit.totals - targets) / scale
        if np.abs(error).max() <= params.tolerance:
            break
        fit.history = np.concatenate([fit.history, error[None]])
        now = fit
        before = fit.totals
        fit.totals = gather(lambda n, post: (post * (n * now.rates(post))[:, None]).sum(0), k)
        fit.passes += 1
        if np.abs(fit.totals - before).max() <= 1e-3 * params.tolerance * whole:  # the bounds keep the targets out of reach
            break
    fit.converged = bool(np.abs((fit.totals - targets) / scale).max() <= params.tolerance)
    if not fit.converged:
        warnings.warn(f"targets missed after {fit.passes} passes: {fit.missed()}", stacklevel=2)
    return fit


def rate_column(fit: RateFit, posteriors: Column) -> Column:
    """A document's rate from its posteriors; 1 where nothing was fitted."""
    if not len(fit.history):
        return F.lit(1.0)

    @F.arrow_udf("double")
    def run(post):
        import pyarrow as pa

        return pa.array(fit.rates(_matrix(post, len(fit.domains)))) if len(post) else pa.array([], pa.float64())

    return run(posteriors)


def copies_column(rate: Column, id_col: Column, seed: int) -> Column:
    """The rate as a whole number of copies: its fraction rounds up for that share of ids, by hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    params: MixParams = MixParams(), keep_text: bool = True, out: str = "mix"
) -> tuple[DataFrame, RateFit]:
    """docs with a struct column `out` (n_tokens, posteriors, rate, copies), and the fit.

    Every document gets a rate; nothing is dropped here. Null and empty texts have no tokens and the
    classifier's prior as posteriors. With no labelled documents, or no weight on any domain, all rates
    are 1. Repeated rows get equal rates. With keep_text False texts are not carried and memberships
    come from the stored table instead of a second reading. `out` must not be a column.
    """
    check_absent(docs, out)
    model = fit_classifier(docs, labelled, id_col, text_col, params)
    marked = with_memberships(docs, model, text_col, out)
    slim = stored(marked.select(*[c for c in docs.columns if c != text_col] if not keep_text else [], out), "memberships")
    fit = fit_rates(slim.select(f"{out}.n_tokens", f"{out}.posteriors"), model.domains, weights, params)
    c = F.col(out)
    full = with_memberships(docs, model, text_col, out, fit) if keep_text else slim.withColumn(out, c.withField("rate", rate_column(fit, c["posteriors"])))
    return full.withColumn(out, c.withField("copies", copies_column(c["rate"], F.col(id_col), params.seed))), fit
