"""Soft-membership mixing: document rates whose expected domain token totals match target shares.

A multinomial classifier, fitted on a bounded sample of labelled rows (MAX_LABELLED, the smallest hashes of
doc_id) in one task, gives every document a posterior over domains. Rates r >= 0 then minimise

    1/2 (S - t)' M (S - t)  +  ridge/2 sum_d n_d / N (r_d - 1)**2,    S_k = (sum_d r_d n_d p_dk) / N

with n the tokens of a document, p its posterior, N all tokens and t the target shares. M is the inverse of
G + SOFT diag(s), G the second moments of the posteriors and s the shares at rate 1: in this metric all domains
can be moved equally well, so soft posteriors need few steps. The method is projected gradient in the metric of n / N
with momentum that restarts when it leads uphill: with u = M (S(y) - t),

    r <- max(0, y - step * (p.u + ridge * (y - 1))),    y <- r + momentum * (r - r before).

A document's rate depends on the past only through u and the momentum of all steps, k + 1 numbers per step. So nothing
is stored per document and step: each pass over the written table of posteriors replays them and sums the next totals.
The same pass sums the dual bound of the last u, so the distance to the best objective is known: the passes end
when this gap is at most GAP of the objective at rate 1, or after PASSES. A Mixture holds the gap and the totals reached;
targets that no nonnegative rates reach show there.

Defined results: null and empty texts have the posterior of the class shares (bias alone), no tokens and the rate that follows
from that posterior; repeated rows count as often as they stand; without labelled rows every domain is equally likely;
targets are scaled to sum to 1; a domain without mass cannot be raised and keeps its shortfall; an empty table gives
an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import arrow_map, map_batches, table
from pairlens.session import written

MAX_LABELLED = 10_000
#: Hashed words of the classifier, besides the shape features.
SLOTS = 1 << 14
RIDGE = 1e-4
SOFT = 1e-3
#: Optimality gap at which the passes end, and the number of passes after which they end anyway; the gap is returned.
GAP = 1e-5
PASSES = 400
SHAPES = 8


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  # (SLOTS + SHAPES, domains)
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior rows and word counts of the texts."""
        scores, counts = np.tile(self.bias, (len(texts), 1)), np.zeros(len(texts), np.int64)
        for first, place, value, cuts, words in features(texts):
            part = value[:, None] * self.weights[place]
            total = np.concatenate([np.zeros((1, part.shape[1])), np.cumsum(part, axis=0)])
            scores[first : first + len(cuts) - 1] += total[cuts[1:]] - total[cuts[:-1]]
            counts[first : first + len(cuts) - 1] = words
        scores = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        return scores / scores.sum(axis=1, keepdims=True), counts


def _shapes(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shares of character kinds, mean word length and logarithm of the length, each about 0 to 1."""
    n = np.maximum(np.diff(offsets), 1)

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / n

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    symbol = X.PUNCTUATION[data] & (data > 32)
    cols = [share(upper), share(digit), share(letter), share(symbol), share(data == 10) * 10, share(data == 124) * 10, np.minimum(words / n * 5, 2), np.log1p(n) / 10]
    return np.stack(cols, axis=1) * (np.diff(offsets) > 0)[:, None]


def features(texts: pa.Array):
    """Per block: first row, places and values of its rows' features, the cuts between rows, their words."""
    for first, end, data, offsets in X.blocks(texts):
        words = X.Words(data, offsets, X.PUNCTUATION)
        counts = np.diff(words.bounds)
        owner = np.repeat(np.arange(end - first), counts)
        keys = np.unique(owner * SLOTS + (words.hashes >> np.uint64(50)).astype(np.int64))
        row, place = np.divmod(keys, SLOTS)
        norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=end - first), 1))
        shape = _shapes(data, offsets, counts)
        rows = np.concatenate([row, np.repeat(np.arange(end - first), SHAPES)])
        order = np.argsort(rows, kind="stable")
        places = np.concatenate([place, np.tile(np.arange(SLOTS, SLOTS + SHAPES), end - first)])[order]
        values = np.concatenate([norm[row], shape.reshape(-1)])[order]
        yield first, places, values, np.searchsorted(rows[order], np.arange(end - first + 1)), counts


def _softmax_fit(rows: list, labels: np.ndarray, domains: int, passes: int = 8, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the log loss, one row at a time in the given order."""
    share = (np.bincount(labels, minlength=domains) + 0.5) / (len(labels) + 0.5 * domains)
    bias = np.log(share)
    weights, squares = np.zeros((SLOTS + SHAPES, domains)), np.full((SLOTS + SHAPES, domains), 1e-2)
    for _ in range(passes):
        for (place, value), label in zip(rows, labels.tolist(), strict=True):
            s = value @ weights[place] + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            squares[place] += g * g
            weights[place] -= rate * (g / np.sqrt(squares[place]) + 1e-3 * weights[place])
            bias -= 0.01 * p
    return weights, bias


def train(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on the rows of labelled (doc_id, domain) that docs has; labels outside domains are left out."""
    chosen = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))

    def fit(batches):
        found = []
        for batch in batches:
            ids, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, place, value, cuts, _ in features(batch.column(2)):
                for i in range(len(cuts) - 1):
                    cut = slice(cuts[i], cuts[i + 1])
                    found.append((ids[first + i], domains.index(names[first + i]), (place[cut].astype(np.int32), value[cut].astype(np.float32))))
        if found:
            order = X.mix(np.array([f[0] % (1 << 64) for f in found], np.uint64)).tolist()
            found = [f for _, f in sorted(zip(order, found, strict=True), key=lambda x: (x[0], x[1][0]))]
            weights, bias = _softmax_fit([f[2] for f in found], np.array([f[1] for f in found]), len(domains))
            yield table(["weights", "bias"], [[weights.astype(np.float32).tobytes()], [bias.tobytes()]], [pa.binary(), pa.binary()])

    fitted = arrow_map(rows.repartition(1), fit, "weights binary, bias binary").collect()
    if not fitted:
        return Classifier(domains, np.zeros((SLOTS + SHAPES, len(domains)), np.float32), np.zeros(len(domains)))
    weights = np.frombuffer(fitted[0].weights, np.float32).reshape(-1, len(domains))
    return Classifier(domains, weights, np.frombuffer(fitted[0].bias, float))


def memberships(docs: DataFrame, classifier: Classifier, carry: list[str]) -> DataFrame:
    """carry columns, n_tokens (words) and posteriors of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], "text")
    fields = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)] + ["n_tokens long", "posterior array<double>"])

    def build():
        def work(batch):
            p, n = shared.value.posteriors(batch.column(len(carry)))
            flat = pa.array(p.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(n), lists], names=[*batch.schema.names[: len(carry)], "n_tokens", "posterior"])

        return work

    out = map_batches(rows, build, fields)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "posterior")


def path(posterior: np.ndarray, history: np.ndarray, step: float, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after the steps of history (rows: u, then the momentum), the rates before the last step, and the point it went out from."""
    rates = before = start = point = np.ones(len(posterior))
    for row in history:
        before, start = rates, point
        rates = np.maximum(0, start - step * (posterior @ row[:-1] + ridge * (start - 1)))
        point = rates + row[-1] * (rates - before)
    return rates, before, start


def replay(posterior: np.ndarray, history: np.ndarray, step: float, ridge: float) -> np.ndarray:
    """Rates after the steps of history."""
    return path(posterior, history, step, ridge)[0]


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Rates:
    """Fitted rates: u and momentum of all steps, step size, targets, totals at rate 1 and at the end, gap as a share of the objective at rate 1."""

    history: np.ndarray
    step: float
    targets: np.ndarray
    before: np.ndarray
    totals: np.ndarray
    gap: float


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE, gap: float = GAP, passes: int = PASSES) -> Rates:
    """Rates for a table (n_tokens, posterior)."""
    k, small = len(targets), members.select("n_tokens", "posterior")
    targets = targets / targets.sum()

    def sum_of(value, width):
        """Sum of value(posterior, tokens) over all rows, by one partial sum per batch."""

        def build():
            def work(batch):
                yield table(["i", "v"], [list(range(width)), value(_matrix(batch, 1), batch.column(0).to_numpy().astype(float))], [pa.int32(), pa.float64()])

            return work

        parts = map_batches(small, build, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for row in parts:
            out[row.i] = row.v
        return out

    sums = sum_of(lambda p, n: np.concatenate([((p * n[:, None]).T @ p).reshape(-1), n @ p, [n.sum()]]), k * k + k + 1)
    if not sums[-1]:
        return Rates(np.zeros((0, k + 1)), 1.0, targets, np.zeros(k), np.zeros(k), 0.0)
    all_tokens = sums[-1]
    gram, share = sums[: k * k].reshape(k, k) / all_tokens, sums[k * k : -1] / all_tokens
    inverse = gram + SOFT * np.diag(np.maximum(share, 1e-9))
    metric, step = np.linalg.inv(inverse), 1 / (1 + ridge)

    def objective(totals, moved):
        return (totals - targets) @ metric @ (totals - targets) / 2 + ridge / 2 * moved

    rates, point, weight, history, bound = share, share, 1.0, [], -np.inf
    first = left = objective(share, 0.0)
    while left > gap * first and len(history) < passes:
        u = metric @ (point - targets)
        past = np.array([*history, [*u, 0.0]])

        def pass_sums(p, n, past=past, u=u):
            new, before, start = path(p, past, step, ridge)
            pull = p @ u
            best = np.maximum(0, 1 - pull / ridge)
            dual = pull * best + ridge / 2 * (best - 1) ** 2
            return np.concatenate([(new * n) @ p, [n @ (new - 1) ** 2, n @ ((start - new) * (new - before)), n @ dual]])

        *totals, moved, uphill, dual = sum_of(pass_sums, k + 3) / all_tokens
        totals = np.array(totals)
        bound = max(bound, dual - u @ inverse @ u / 2 - u @ targets)
        left = objective(totals, moved) - bound
        weight = 1.0 if uphill > 0 else weight
        after = (1 + np.sqrt(1 + 4 * weight**2)) / 2
        momentum, weight = (weight - 1) / after, after
        history.append([*u, momentum])
        rates, point = totals, totals + momentum * (totals - rates)
    return Rates(np.array(history).reshape(-1, k + 1), step, targets, share, rates, float(max(left, 0.0) / first) if first else 0.0)


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: classifier, rates, and the table they were fitted on."""

    classifier: Classifier
    rates: Rates
    members: DataFrame

    def report(self) -> list[tuple[str, float, float, float]]:
        """Per domain: name, target share, share at rate 1, and rated tokens as a share of all tokens."""
        r = self.rates
        return list(zip(self.classifier.domains, r.targets.tolist(), r.before.tolist(), r.totals.tolist(), strict=True))


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], carry: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED) -> Mixture:
    """Classifier and rates for docs; the table of memberships keeps the carry columns."""
    classifier = train(docs, labelled, tuple(targets), max_labelled)
    members = written(memberships(docs, classifier, list(carry)), "memberships")
    return Mixture(classifier, fit_rates(members, np.array(list(targets.values()), float)), members)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])


def member_rates(mixture: Mixture) -> DataFrame:
    """The table of memberships with `rate`."""
    history, step, members = mixture.rates.history, mixture.rates.step, mixture.members
    at = members.columns.index("posterior")

    def build():
        def work(batch):
            rates = replay(_matrix(batch, at), history, step, RIDGE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=[*batch.schema.names, "rate"])

        return work

    return map_batches(members, build, _schema(members, "rate double"))


def document_rates(docs: DataFrame, mixture: Mixture, name: str = "rate") -> DataFrame:
    """All columns of docs and a last column `name` with the rate of the row, in place of one of that name; reads the texts once more."""
    docs = docs.drop(name)
    history, step = mixture.rates.history, mixture.rates.step
    shared = docs.sparkSession.sparkContext.broadcast(mixture.classifier)
    at = docs.columns.index("text")

    def build():
        def work(batch):
            rates = replay(shared.value.posteriors(batch.column(at))[0], history, step, RIDGE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=[*batch.schema.names, name])

        return work

    return map_batches(docs, build, _schema(docs, f"`{name}` double"))
