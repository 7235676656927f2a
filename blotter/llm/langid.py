"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased, everything ASCII that is no letter becomes a blank, and its 1- to 4-byte subwords are hashed to
``BUCKETS`` rows of an embedding table. The mean of a text's rows goes through a linear softmax. Table and softmax are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``sample_rows`` in all, shared
equally by the languages); a fifth of the sample is kept back to fit the temperature and a threshold of the score.

A score tells languages apart but is high for foreign text too. So a text is also rejected if its subwords surprise: their
mean negative log share among the subwords of the predicted language's sample rows is compared with a bound. Each fifth of
the sample is held to the shares of the other four, and what it lies above its language's median counts. The bound is the
median and ``MARGIN`` times the 99 % quantile of that, or the quantile that costs ``LOST`` of the rows if it is more (it rests
on too few rows to be taken alone). Languages with fewer than ``FEW`` sample rows
and samples of fewer than ``LEAST`` rows can't be calibrated and don't reject by surprise. Prediction uses whole texts,
counted block by block.

Null texts and texts without a letter are predicted ``und`` with score 0 and are rejected; so is every text if there is
nothing to learn from. Rows without a label or an identifier are not learned from. Rows are predicted one by one, so
repeated rows, very long texts and other columns don't matter; ties go to the first language in alphabetic order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import fresh_name, map_arrow, quoted
from blotter.session import bounded_rows

BUCKETS = 1 << 15
LONGEST = 4
BLOCK = 1 << 20
UNKNOWN = "und"
MAX_LANGUAGES = 1000
#: Share of right answers on the kept-back rows that rejection may cost.
LOST = 0.001
#: No calibrated score above this is ever rejected for its score.
CEILING = 0.4
#: The bound of surprise: its margin, rows it takes, and the weight of even shares.
MARGIN, FEW, LEAST, EVEN = 4.0, 5, 50, 0.01


def _folded_bytes() -> bytes:
    kept = [b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)]
    return bytes(kept)


FOLD = _folded_bytes()


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the subwords of the whole text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(FOLD), np.uint8)
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))]
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), BLOCK):
        part = raw[start : start + BLOCK + LONGEST - 1].astype(np.uint32)
        size = min(BLOCK, len(raw) - start)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            ends = part[n - 1 :]
            code = code[: len(ends)] * np.uint32(257) + ends
            hashed = (code[:size] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)
            total += np.bincount(hashed, minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embedding table times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    surprise: np.ndarray  # bucket x language: negative log share
    bound: np.ndarray  # of each language's mean surprise

    def foreign(self, counts: np.ndarray, language: int) -> bool:
        hit = counts.nonzero()[0]
        return bool(counts[hit] @ self.surprise[hit, language] > self.bound[language] * counts.sum())

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        hit = counts.nonzero()[0]
        share = counts[hit] / max(1, counts.sum())
        logits = (share @ self.weights[hit] + self.bias) / self.temperature
        logits = np.exp(logits - logits.max())
        return logits / logits.sum()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its identifier as text, modulo 4, is 2. True without an identifier."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _sample(docs: DataFrame, text: str, label: str, doc_id: str, sample_rows: int) -> list[tuple]:
    """(language, buckets, shares) of at most about ``sample_rows`` labelled rows, evenly over languages.

    Rows are chosen by hash against a share that the counted languages give, so no language is ranked or gathered.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.lit("sample")).alias("h")
    )
    counts = {r["label"]: r["count"] for r in bounded_rows(rows.groupBy("label").count(), MAX_LANGUAGES, "languages")}
    if not counts:
        return []
    each = max(1, sample_rows // len(counts))
    top = 1 << 53
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(top * min(1.0, each / n)))])
    chosen = rows.filter(F.shiftrightunsigned("h", 11) < share[F.col("label")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1).to_pylist():
                c = subword_counts(t)
                hit = c.nonzero()[0]
                found.append((hit.astype(np.int32), (c[hit] / max(1, c.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([y for _, y in found], pa.list_(pa.float32()))],
                ["label", "h", "hit", "share"],
            )

    got = chosen.mapInArrow(features, "label string, h long, hit array<int>, share array<float>").toArrow()
    columns = [got.column(i) for i in range(4)]
    rows_ = [
        (label_, h, np.asarray(hit.values, np.int64), np.asarray(part.values, np.float32))
        for label_, h, hit, part in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3])
    ]
    return [(a, c, d) for a, _, c, d in sorted(rows_, key=lambda r: (r[1], r[0], len(r[2])))]


def _negative_log(mass: np.ndarray) -> np.ndarray:
    """Negative log shares of buckets, mixed with even shares so that none is zero."""
    share = mass / np.maximum(mass.sum(0), 1e-12)
    return -np.log((1 - EVEN) * share + EVEN / BUCKETS).astype(np.float32)


def surprises(rows: list[tuple], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Negative log shares of all rows, and the bound of each language."""
    place = {x: i for i, x in enumerate(languages)}

    def mass_of(part: list[tuple]) -> np.ndarray:
        mass = np.zeros((BUCKETS, len(languages)))
        for label, hit, share in part:
            mass[hit, place[label]] += share
        return mass

    whole = mass_of(rows)
    own: list[list[float]] = [[] for _ in languages]
    for fold in range(5):
        rest = whole - mass_of(rows[fold::5])
        log = _negative_log(np.maximum(rest, 0))
        known = rest.sum(0) > 0.5
        for label, hit, share in rows[fold::5]:
            if known[place[label]]:
                own[place[label]].append(float(share @ log[hit, place[label]]))
    bound = np.full(len(languages), np.inf)
    calibrated = [i for i, x in enumerate(own) if len(x) >= FEW]
    above = np.concatenate([np.array(own[i]) - np.median(own[i]) for i in calibrated] or [np.zeros(0)])
    if len(above) >= LEAST:
        for i in calibrated:
            bound[i] = np.median(own[i]) + max(MARGIN * np.quantile(above, 0.99), np.quantile(above, 1 - LOST))
    return _negative_log(whole), bound


def train(rows: list[tuple], width: int = 16, epochs: int = 12, rate: float = 10.0, seed: int = 7) -> Model | None:
    """Fit the model to ``(language, buckets, shares)`` rows."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    kept_back = rows[::5] if len(rows) >= 50 else rows
    fitted = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 1, (BUCKETS, width))
    softmax = np.zeros((width, len(languages)))
    bias = np.zeros(len(languages))
    steps, done = epochs * len(fitted), 0
    for _ in range(epochs):
        for i in draw.permutation(len(fitted)):
            label, hit, share = fitted[i]
            step = rate * (1 - done / steps)
            done += 1
            own = table[hit]
            mean = share @ own
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[place[label]] -= 1
            back = softmax @ p
            softmax -= step * np.outer(mean, p)
            bias -= 0.01 * step * p
            table[hit] = own - step * np.outer(share, back)
    model = Model(languages, table @ softmax, bias, 1.0, 0.0, *surprises(rows, languages))
    scored = [(share @ model.weights[hit] + bias, place[label]) for label, hit, share in kept_back]
    logits, truth = np.array([x for x, _ in scored]), np.array([y for _, y in scored])

    def softened(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(softened(t)[np.arange(len(truth)), truth] + 1e-12).mean())

    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    p = softened(model.temperature)
    right = p.max(1)[p.argmax(1) == truth]
    model.threshold = min(CEILING, 0.5 * float(np.quantile(right, LOST))) if len(right) else CEILING
    return model


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample_rows: int = 2000) -> Model | None:
    """Learn from the rows of ``docs`` that aren't held out; None if there are none.

    ``sample_rows`` bounds the labelled rows that are fitted, and so what the driver holds (a row is at most
    ``BUCKETS`` pairs, mostly under a thousand).
    """
    return train(_sample(docs, text, label, doc_id, sample_rows))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with ``lang_pred``, ``score`` and ``rejected``."""
    # Plain values, so that executors without this package can read them.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.weights, model.bias, model.temperature, model.threshold, model.surprise, model.bound))
    keep = docs.columns if keep is None else keep
    names = [fresh_name(docs.select(*map(quoted, keep)), n) for n in ("lang_pred", "score", "rejected")]
    at, kept_at = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        known = Model(*shared.value) if shared.value else None
        for batch in batches:
            found = []
            for t in batch.column(at).to_pylist():
                if not t or known is None or not letter(t):
                    found.append((UNKNOWN, 0.0, True))
                    continue
                counts = subword_counts(t)
                p = known.probabilities(counts)
                best = int(p.argmax())
                found.append((known.languages[best], float(p[best]), bool(p[best] < known.threshold) or known.foreign(counts, best)))
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept_at), *new], [*(batch.schema.names[i] for i in kept_at), *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*(docs.schema.fields[i] for i in kept_at), *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return map_arrow(docs, run, schema)
