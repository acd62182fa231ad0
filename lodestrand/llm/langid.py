"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are its byte pairs and triples (ASCII letters lower-cased, white space as one separator),
hashed into buckets; the mean of the buckets' embeddings is the text's vector.  Embeddings and softmax weights
are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows (at most
about ``per_lang`` of each language, by a hash of the row).  A fifth of the sample is held back to fit the softmax
temperature.  At prediction the product of embeddings and weights is folded into one table, which gives the same
logits.

A softmax is as sure of a language it never saw as of its own, so rejection asks how usual a text is: the mean log
frequency, in the predicted language's training texts, of the triples around each of its letters (``PRIOR`` triples
of average frequency are added, so that a short text needs more than one odd word).  The bound is calibrated on the
held-back texts, against texts of no known language: each language with itself left out of the table, and texts with
shuffled bytes.  It lies halfway between the known texts' lowest half per cent and the others' highest
twentieth, and never above the former.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text when
no labelled row exists; null languages are never learned; texts of any length are read whole; repeated rows get
equal predictions; other columns are carried along, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.scratch import without
from lodestrand.llm.textkit import SPACE, slices

LOG_BUCKETS, DIM = 13, 16
LOG_TRIPLES, PRIOR = 16, 10
#: Triples of shuffled bytes that a sampled text gives to the calibration.
JUNK = 400
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32
_LETTER = np.array([bytes([b]).isalpha() or b > 127 for b in range(256)])
ADDED = ("lang_pred", "score", "rejected")


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    usual: np.ndarray  # triples x languages: log frequency
    middle: float  # the average of known texts
    reject_below: float


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, off - off[0]


def triples(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes around each letter of all rows (what is no letter counts as a space), and each row's first."""
    letter = _LETTER[raw]
    x = np.where(letter, _FOLD[raw], np.uint32(32))
    left, right = np.concatenate([[32], x[:-1]]).astype(np.uint32)[: len(x)], np.concatenate([x[1:], [32]]).astype(np.uint32)[: len(x)]
    some = np.diff(off) > 0
    left[off[:-1][some]] = 32
    right[off[1:][some] - 1] = 32
    at = np.flatnonzero(letter)
    h = (left[at] << np.uint32(16) | x[at] << np.uint32(8) | right[at]) * np.uint32(2654435761) >> np.uint32(32 - LOG_TRIPLES)
    return h, np.searchsorted(at, off)


def usualness(log: np.ndarray, begin: np.ndarray, middle: float) -> np.ndarray:
    """Each row's mean of its triples' log frequencies, with the prior."""
    total = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
    return (total[begin[1:]] - total[begin[:-1]] + PRIOR * middle) / (np.diff(begin) + PRIOR)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of all rows, and each row's first; a row of under three bytes has none."""
    d, off = _bytes(texts)
    d = _FOLD[d]
    if len(d) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    pair = d[:-2] << np.uint32(8) | d[1:-1]
    both = np.empty((len(pair), 2), np.uint32)
    both[:, 0] = pair * np.uint32(2654435761) >> np.uint32(32 - LOG_BUCKETS)
    both[:, 1] = ((pair << np.uint32(8) | d[2:]) * np.uint32(2246822519) + np.uint32(0x9E3779B9)) * np.uint32(2654435761) >> np.uint32(32 - LOG_BUCKETS)
    keep = np.ones(len(pair), bool)
    for back in (1, 2):
        cut = off[1:-1] - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    begin = np.concatenate([[0], np.cumsum(keep)])[np.clip(off, 0, len(keep))]
    return both[keep].ravel(), 2 * begin


@dataclass
class _Row:
    lang: str
    buckets: np.ndarray
    counts: np.ndarray
    triples: np.ndarray
    times: np.ndarray
    shuffled: np.ndarray


_FIELDS = ("buckets", "counts", "triples", "times", "shuffled")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct subwords and distinct triples with their counts, and some triples of the text's shuffled bytes.

    Numbers of 16 bits in binary columns, so that a sample's rows stay small.
    """
    packed = lambda arrays: pa.array([x.astype(np.uint16).tobytes() for x in arrays], pa.binary())
    cut = lambda h, begin: [np.unique(h[a:b], return_counts=True) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    for whole in batches:
        for batch in slices(whole, "text"):
            found = cut(*subwords(batch["text"]))
            raw, off = _bytes(batch["text"])
            plain = cut(*triples(raw, off))
            rng = np.random.default_rng(len(raw))
            mixed = np.concatenate([np.zeros(0, np.uint8), *[rng.permutation(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]])
            shuffled, begin = triples(mixed, off)
            columns = [
                packed(x for x, _ in found),
                packed(np.minimum(n, 65535) for _, n in found),
                packed(x for x, _ in plain),
                packed(np.minimum(n, 65535) for _, n in plain),
                packed(shuffled[a : min(b, a + JUNK)] for a, b in zip(begin[:-1], begin[1:], strict=True)),
            ]
            yield pa.record_batch([batch["o"], batch["lang"], *columns], names=["o", "lang", *_FIELDS])


def _sample(docs: DataFrame, train: Column, per_lang: int) -> list[_Row]:
    """About ``per_lang`` rows of each language; never more than one and a half times as many, whatever rows repeat."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return []
    fraction = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7), F.col("text"))
    picked = rows.select(order.alias("o"), "lang", "text").where(F.pmod("o", F.lit(1 << 20)) < fraction * (1 << 20))
    schema = "o long, lang string, " + ", ".join(f"{c} binary" for c in _FIELDS)
    found = picked.mapInArrow(_features, schema).orderBy("o", "lang").limit(3 * per_lang * len(share) // 2).toArrow().combine_chunks()
    numbers = lambda c, i: np.frombuffer(found[c][i].as_py(), np.uint16)
    return [_Row(found["lang"][i].as_py(), *[numbers(c, i) for c in _FIELDS]) for i in range(found.num_rows)]


def fit(docs: DataFrame, train: Column, per_lang: int = 800, epochs: int = 12, rate: float = 1.0, seed: int = 5) -> Model | None:
    """Learn from the rows of ``docs`` where ``train`` holds; None without any."""
    rows = _sample(docs, train, per_lang)
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = len(rows) // 5
    embed = (rng.normal(size=(1 << LOG_BUCKETS, DIM)) * 0.1).astype(np.float32)
    weight = (rng.normal(size=(len(langs), DIM)) * 0.1).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)

    def dense(part: list[_Row]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(part), 1 << LOG_BUCKETS), np.float32)
        for i, r in enumerate(part):
            x[i, r.buckets] = r.counts / max(1, int(r.counts.sum(dtype=np.int64)))
        return x, np.array([langs.index(r.lang) for r in part])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    fitted = rows[held:]
    # A small sample is gone through more often, up to some three thousand steps.
    epochs = max(epochs, min(3000 * 16 // len(fitted), 20 * epochs))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(fitted))
        for a in range(0, len(order), 16):
            x, y = dense([fitted[i] for i in order[a : a + 16]])
            h = x @ embed
            g = softmax(h @ weight.T + bias)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = g @ weight
            weight -= step * (g.T @ h)
            bias -= step * g.sum(0)
            used = np.flatnonzero(x.any(0))
            embed[used] -= step * 16 * (x[:, used].T @ back)
    table = embed @ weight.T
    check = rows[:held] or rows
    logits = np.concatenate([dense(check[a : a + 64])[0] @ table + bias for a in range(0, len(check), 64)])
    y = np.array([langs.index(r.lang) for r in check])
    grid = np.geomspace(1e-3, 20, 100)
    # Smoothed targets, so that held-back texts without an error don't ask for a temperature of zero.
    target = np.full(logits.shape, 1 / (2 * len(y) * len(langs)))
    target[np.arange(len(y)), y] += 1 - 1 / (2 * len(y))
    loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    usual, middle, bound = _rejection(fitted, check, logits.argmax(1), langs)
    return Model(langs, table, bias, t, usual, middle, bound)


def _rejection(fitted: list[_Row], check: list[_Row], predicted: np.ndarray, langs: list[str]) -> tuple[np.ndarray, float, float]:
    """Log frequencies of triples, the average of known texts, and the bound under which a text is rejected."""
    usual = np.full((1 << LOG_TRIPLES, len(langs)), 0.5, np.float32)
    for r in fitted:
        usual[r.triples, langs.index(r.lang)] += np.minimum(r.times, 20)
    usual = np.log(usual / usual.sum(0))

    def mean(r: _Row, columns: list[int], middle: float, prior: float = PRIOR) -> float:
        total = r.times.astype(np.float64) @ usual[r.triples][:, columns]
        return float((total.max(initial=-np.inf) + prior * middle) / (r.times.sum(dtype=np.int64) + prior))

    some = [i for i, r in enumerate(check) if len(r.times)]
    if not some:
        return usual, 0.0, -np.inf
    long, own = [check[i] for i in some], [[int(predicted[i])] for i in some]
    middle = float(np.mean([mean(r, c, 0.0, 0.0) for r, c in zip(long, own, strict=True)]))
    known = np.quantile([mean(r, c, middle) for r, c in zip(long, own, strict=True)], 0.005)
    others = lambda r: [i for i, x in enumerate(langs) if x != r.lang]
    foreign = [mean(r, others(r), middle) for r in long if len(langs) > 1]
    for r in long:
        if len(r.shuffled):
            foreign.append(float((usual[r.shuffled].sum(0, dtype=np.float64).max() + PRIOR * middle) / (len(r.shuffled) + PRIOR)))
    odd = np.quantile(foreign, 0.95) if foreign else known - 2
    return usual, middle, float(min(known, (known + odd) / 2))


def _predict(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                ids, begin = subwords(batch.column(text_at))
                total = np.zeros((batch.num_rows, len(m.langs)), np.float64)
                some = np.flatnonzero(np.diff(begin))
                if len(some):
                    total[some] = np.add.reduceat(m.table[ids], begin[some], 0)
                z = (total / np.maximum(np.diff(begin), 1)[:, None] + m.bias) / m.temperature
                e = np.exp(z - z.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                best, score = p.argmax(1), p.max(1)
                letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                h, first = triples(*_bytes(batch.column(text_at)))
                how = usualness(m.usual[h, np.repeat(best, np.diff(first))], first, m.middle)
                name = pa.array([m.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], pa.string())
                score = np.where(letter, score, 0.0)
                yield pa.record_batch([*batch.columns[:-1], name, pa.array(score), pa.array(~letter | (how < m.reject_below))], names=[*batch.schema.names[:-1], *ADDED])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected."""
    docs = without(docs, *ADDED)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    # The tables' sizes are fixed by the buckets and the languages.
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return docs.select("*", letter).mapInArrow(_predict(held, [c.lower() for c in docs.columns].index("text")), schema)
