"""URL filter: two smoothed variable-order Markov models over characters, and a rule list.

One model is counted over accepted URLs and one over rejected URLs. A URL's score is the difference
of the two log-likelihoods divided by the number of characters; the threshold is set on labelled
URLs that were held out of the counts. Counts cover all labelled rows: every task counts its own
n-grams, the shuffle sums them, and what reaches the driver is bounded by the number of slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import ascii_lower, batches


@dataclass(frozen=True)
class UrlModelParams:
    """order: longest context in characters. slots: size of the hashed count tables, a power of two,
    the bound on what is collected and broadcast; the model reports how full they are. strength: weight of the shorter context's estimate.
    holdout: one in so many labelled URLs (by hash) calibrates instead of being counted."""

    order: int = 5
    slots: int = 1 << 20
    strength: float = 2.0
    holdout: int = 5
    bins: int = 4001
    span: float = 10.0


_PAD, _END = ord("^"), ord("$")
_DIGITS = bytes.maketrans(b"123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"000000000abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(urls: list[bytes], p: UrlModelParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order+1) x characters: slots of (context, character), of the context, and the URL of each character."""
    k = p.order
    bodies = [bytes([_PAD]) * k + u.translate(_DIGITS) + bytes([_END]) for u in urls]
    x = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(lengths) - lengths
    scored = np.ones(len(x), bool)
    for j in range(k):
        scored[starts + j] = False
    at = np.flatnonzero(scored)
    url = np.repeat(np.arange(len(urls)), lengths - k)
    joint, context = np.empty((k + 1, len(at)), np.int64), np.empty((k + 1, len(at)), np.int64)
    h, mask = np.zeros(len(at), np.uint64), np.uint64(p.slots - 1)
    for n in range(k + 1):
        if n:
            h = h * np.uint64(1_000_003) + x[at - n] + np.uint64(1)
        seed = _mix(h + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        context[n] = (seed & mask).astype(np.int64)
        joint[n] = (_mix(seed + x[at] + np.uint64(1)) & mask).astype(np.int64)
    return joint, context, url


def _chunks(it: Iterator, columns: list[str], size: int = 2000):
    for lists in batches(it, columns):
        for i in range(0, len(lists[0]), size):
            yield [c[i : i + size] for c in lists]


def _count(p: UrlModelParams):
    def run(it):
        import pyarrow as pa

        for body, label in _chunks(it, ["body", "label"]):
            joint, context, url = _slots(body, p)
            accepted = np.asarray(label, np.int64)[url]
            cells = np.concatenate([(joint + 2 * p.slots * accepted).ravel(), (context + p.slots + 2 * p.slots * accepted).ravel()])
            slot, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    return run


@dataclass
class UrlModel:
    """counts[a]: joint and context tables of class a (0 rejected, 1 accepted)."""

    params: UrlModelParams
    counts: np.ndarray
    threshold: float = 0.0
    report: dict = field(default_factory=dict)

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Length-normalised log-likelihood difference, accepted minus rejected."""
        if not urls:
            return np.zeros(0)
        joint, context, url = _slots(urls, self.params)
        ll = []
        for a in (0, 1):
            prob = np.full(joint.shape[1], 1.0 / 256)
            for n in range(self.params.order + 1):
                prob = (self.counts[a, 0][joint[n]] + self.params.strength * prob) / (self.counts[a, 1][context[n]] + self.params.strength)
            # slots shared by chance could push a quotient over 1
            ll.append(np.bincount(url, np.log(np.minimum(prob, 1.0)), len(urls)))
        return (ll[1] - ll[0]) / np.bincount(url, minlength=len(urls))


def _fold(body: Column, p: UrlModelParams) -> Column:
    return F.pmod(F.xxhash64(body), F.lit(p.holdout)) == 0


def _scored(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """rows with column `score`; model is a broadcast."""
    names = [*keep, "score"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep], "score double"])

    def run(it):
        import pyarrow as pa

        m = model.value
        for b in it:
            body = b.column(b.schema.get_field_index("body")).cast(pa.binary()).to_pylist()
            parts = [m.scores(body[i : i + 2000]) for i in range(0, len(body), 2000)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(score)], names)

    return rows.select("body", *[c for c in keep if c != "body"]).mapInArrow(run, schema)


def fit_url_model(labelled: DataFrame, params: UrlModelParams = UrlModelParams()) -> UrlModel:
    """labelled: body string (host and path), label int (1 accepted, 0 rejected).

    Rows with a null body or label are left out. With no held-out rows of one class the threshold
    stays 0, with no rows at all every score is 0 and every URL is accepted. The report holds the load of the
    tables and the accuracy on held-out URLs.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col("body"), F.col("label").cast("int").alias("label")).where("body is not null and label in (0, 1)")
    found = rows.where(~_fold(F.col("body"), params)).mapInArrow(_count(params), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(4 * params.slots)
    flat[found["slot"].to_numpy()] = found["n"].to_numpy()
    model = UrlModel(params, flat.reshape(2, 2, params.slots).astype(np.float32))
    # the share of slots in use by class: from about a half on, long contexts share slots and slots should be raised
    model.report = {"load": [float((model.counts[a, 0] > 0).mean()) for a in (0, 1)]}
    shared = spark.sparkContext.broadcast(model)
    step = 2 * params.span / (params.bins - 1)
    bin_of = F.greatest(F.lit(0), F.least(F.lit(params.bins - 1), F.floor((F.col("score") + params.span) / step).cast("int")))
    held = _scored(rows.where(_fold(F.col("body"), params)), shared, ["label"]).groupBy("label", bin_of.alias("bin")).count().collect()
    hist = np.zeros((2, params.bins))
    for r in held:
        hist[r["label"], r["bin"]] = r["count"]
    totals = hist.sum(1)
    if totals.min() > 0:
        # accepted when the bin is at or above the cut; all cuts with the best balanced accuracy, then the middle one
        right = (hist[1][::-1].cumsum()[::-1] / totals[1] + np.concatenate([[0], hist[0].cumsum()[:-1]]) / totals[0]) / 2
        best = np.flatnonzero(right >= right.max() - 1e-12)
        cut = best[len(best) // 2]
        model.threshold = float(cut * step - params.span)
        model.report |= {"balanced_accuracy": float(right[cut]), "held_out": totals.tolist()}
    return model


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no `://` occurs."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule `host/path` that fits, as struct(rule, verdict), or null.

    A rule fits its host and every subdomain if the path starts with the rule's path; among rules
    of one length the first in the list wins.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(on_host & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], params: UrlModelParams = UrlModelParams(), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Every row's host, path, rule, verdict and score.

    Rows a rule decides are the labelled rows that the two models learn from; the models decide the
    others. Nulls, empty and repeated URLs are rows like any other (host and path empty, judged on
    the empty string); columns besides id and url are not carried. Empty input gives no rows.
    """
    host, path = parse_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hit = match_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", F.concat("host", "path").alias("body"), hit.alias("hit"))
    parsed = parsed.select("page_id", "host", "path", "body", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    model = fit_url_model(parsed.select("body", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0).alias("label")), params)
    scored = _scored(parsed, pages.sparkSession.sparkContext.broadcast(model), ["page_id", "host", "path", "rule", "ruled"])
    own = F.when(F.col("score") >= F.lit(model.threshold), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
