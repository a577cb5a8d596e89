"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A sentence's probability is logistic in its words and word beginnings (hashed);
a document is toxic unless all its sentences are not: 1 - prod(1 - p).  Only
document labels are needed, and the sentences that carry the label come out of
the fit.  Features are picked by how much more often they stand in toxic than in other
training documents; the weights then minimise the document log loss.

Training looks at no more than TRAIN_ROWS labelled ids, picked by a hash (rows
that repeat an id all train); scoring looks at every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import with_computed
from pactum.llm.wordhash import TextColumn, runs

TRAIN_ROWS = 40_000
BUCKET_BITS, SLICES = 18, 32
#: Beginnings of words in bytes that are features beside the whole word; features kept at most.
PREFIXES, FEATURES = (4, 5, 6), 8192
LEAST_DOCS, LEAST_LIFT = 4, 2.0
STEPS, RATE, RIDGE = 300, 0.2, 2e-4


def _buckets(words) -> np.ndarray:
    """One column of bucket numbers for whole words and for each length of beginning."""
    shift = np.uint64(64 - BUCKET_BITS)
    return np.stack([words.hash >> shift, *(words.prefix_hash(k) >> shift for k in PREFIXES)], axis=1).astype(np.int64)


def _sentences(words) -> np.ndarray:
    """For each word the number of its sentence in its text: one ends after . ! ? and at a line end."""
    raw = np.frombuffer(words.raw, dtype=np.uint8)
    if not len(words.start):
        return np.zeros(0, np.int64)
    last = raw[words.end - 1]
    breaks = np.cumsum(np.concatenate(([0], raw == 0x0A)))
    ends = np.isin(last, (0x2E, 0x21, 0x3F))
    ends[:-1] |= breaks[words.start[1:]] > breaks[words.end[:-1]]
    number = np.concatenate(([0], np.cumsum(ends)[:-1]))
    first = np.searchsorted(words.doc, words.doc, side="left")
    return number - number[first]


def _units(column):
    """Yield, for each text, (words' buckets, sentence numbers, byte starts, byte ends) over the whole text, in pieces for very long ones.

    Every piece has words: a text without any (null, empty, blank) has no piece, wherever it stands among others.
    """
    n, pending = 0, None
    for first, w in runs(column):
        sentence = _sentences(w)
        bucket = _buckets(w)
        # a text larger than one run comes again with the same number
        top = int(w.doc[-1]) if len(w.doc) else -1
        cut = np.searchsorted(w.doc, np.arange(top + 2))
        for d in range(top + 1):
            if cut[d] == cut[d + 1]:
                continue
            own = slice(cut[d], cut[d + 1])
            piece = (bucket[own], sentence[own], w.start[own], w.end[own], w)
            if pending is not None and pending[0] == first + d:
                pending[1].append(piece)
                continue
            if pending is not None:
                yield pending
                n = pending[0] + 1
            while n < first + d:
                yield n, []
                n += 1
            pending = (first + d, [piece])
    if pending is not None:
        yield pending
        n = pending[0] + 1
    while n < len(column):
        yield n, []
        n += 1


def _goes_on(before, after) -> bool:
    """Whether a sentence runs on from one piece of a long text into the next."""
    raw, end = before[4].raw, int(before[3][-1])
    # a piece's buffer ends with a line end of its own
    between = raw[end:-1] + after[4].raw[: int(after[2][0])]
    return raw[end - 1] not in b".!?" and b"\n" not in between


def _text_sentences(pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets, sentence numbers and sentence count of a text."""
    if not pieces:
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64), 0
    numbers = [pieces[0][1]]
    for before, p in zip(pieces, pieces[1:], strict=False):
        numbers.append(p[1] + int(numbers[-1][-1]) + (not _goes_on(before, p)))
    return np.concatenate([p[0] for p in pieces]), np.concatenate(numbers), int(numbers[-1][-1]) + 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep) -> DataFrame:
    """doc text and label (0 or 1) of at most `rows` labelled documents; contrary or null labels are left out.

    Of rows that repeat an id one text is taken, so the bound holds for rows as well.
    """
    clear = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_most"))
        .where("_label = _most").drop("_most").where(keep(F.col("doc_id")))
    )
    # at most `rows` rows of 12 bytes, so a broadcast is bounded
    picked = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.first("_label").alias("_label"), F.min_by("text", F.xxhash64("text")).alias("text")).select("_label", "text")


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """Weights of words in sentences, from at most `rows` labelled documents whose id `keep` lets through, over their whole texts.

    Null and empty texts are documents without sentences; without labels all weights are zero.
    """
    sample = training_rows(docs, labels, label, rows, keep)
    size = 1 << BUCKET_BITS
    part = size // SLICES

    def count(batches):
        import pyarrow as pa

        counts = np.zeros((2, size), dtype=np.int32)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            marks = batch.column("_label").to_pylist()
            for k, pieces in _units(TextColumn(batch.column("text"))):
                n[marks[k]] += 1
                if pieces:
                    counts[marks[k], np.unique(_text_sentences(pieces)[0])] += 1
        if n.sum():
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([int(n[1])] * SLICES, pa.int64()), pa.array([int(n[0])] * SLICES, pa.int64()), pa.array([counts[:, s * part : (s + 1) * part].tobytes() for s in range(SLICES)], pa.binary())], names=["slice", "bad", "good", "counts"])

    def add(frame):
        import pandas as pd

        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "bad": [frame["bad"].sum()], "good": [frame["good"].sum()], "counts": [total.astype(np.int64).tobytes()]})

    schema = "slice int, bad long, good long, counts binary"
    sums = {r["slice"]: r for r in sample.mapInArrow(count, schema).groupBy("slice").applyInPandas(add, schema).collect()}
    if not sums or not sums[0]["bad"] or not sums[0]["good"]:
        rate = 0.0 if not sums else float(sums[0]["bad"] > 0)
        return {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 8.0 if rate else -8.0}
    counts = np.concatenate([np.frombuffer(sums[s]["counts"], np.int64).reshape(2, part) for s in range(SLICES)], axis=1)
    bad, good = sums[0]["bad"], sums[0]["good"]
    lift = (counts[1] + 0.5) / (bad + 1) / ((counts[0] + 0.5) / (good + 1))
    useful = np.flatnonzero((counts[1] >= LEAST_DOCS) & (lift >= LEAST_LIFT))
    weight = (counts[1] * np.log(lift))[useful]
    buckets = np.sort(useful[np.argsort(-weight, kind="stable")][:FEATURES])
    return fit(sample, buckets)


def _hits(bucket, sentence, lookup):
    """(sentence, feature) pairs of a text, each once."""
    f = lookup[bucket]
    r, c = np.nonzero(f >= 0)
    pairs = np.unique(sentence[r] * (1 << 20) + f[r, c])
    return pairs >> 20, pairs & ((1 << 20) - 1)


def _lookup(buckets: np.ndarray) -> np.ndarray:
    out = np.full(1 << BUCKET_BITS, -1, dtype=np.int64)
    out[buckets] = np.arange(len(buckets))
    return out


def fit(sample: DataFrame, buckets: np.ndarray) -> dict:
    """Weights by gradient descent on the documents' log loss under noisy-or."""

    def bags(batches):
        import pyarrow as pa

        lookup = _lookup(buckets)
        for batch in batches:
            rows = []
            marks = batch.column("_label").to_pylist()
            for k, pieces in _units(TextColumn(batch.column("text"))):
                b, s, n = _text_sentences(pieces)
                sentence, feature = _hits(b, s, lookup) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                rows.append((marks[k], n, np.unique(sentence, return_inverse=True)[1].astype("<i4").tobytes(), feature.astype("<i4").tobytes()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["label", "n", "sentence", "feature"])

    rows = sample.mapInArrow(bags, "label int, n int, sentence binary, feature binary").collect()
    # one order whatever the tasks' order
    rows.sort(key=lambda r: (r["label"], r["n"], bytes(r["sentence"]), bytes(r["feature"])))
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    doc_of, sent_of, feat_of, at = [], [], [], 0
    plain = np.zeros(len(rows))
    for d, r in enumerate(rows):
        s, f = np.frombuffer(r["sentence"], "<i4"), np.frombuffer(r["feature"], "<i4")
        m = int(s.max()) + 1 if len(s) else 0
        doc_of.append(np.full(m, d))
        sent_of.append(s + at)
        feat_of.append(f)
        at += m
        plain[d] = max(r["n"] - m, 0)
    doc, sent, feat = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (doc_of, sent_of, feat_of))
    w, b = np.zeros(len(buckets)), -6.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent, weights=w[feat], minlength=at)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        safe = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, b)
        hit = -np.expm1(np.minimum(safe, -1e-12))
        # d loss / d z of a sentence: p where the label is 0, -p (1 - P) / P where it is 1
        pull = np.where(y == 1, -(1 - hit) / hit, 1.0)
        gz = pull[doc] * p
        gw = np.bincount(feat, weights=gz[sent], minlength=len(w)) / len(y) + RIDGE * w
        gb = (gz.sum() + (pull * plain).sum() * p0) / len(y)
        g = np.append(gw, gb)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], -3.0)
    return {"buckets": buckets, "weights": w, "bias": float(b)}


SCORED = "score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), n_sentences and the sentences at or over 0.5, as code point spans.

    Null and empty texts have no sentence and score 0.  Very long texts are walked in
    segments, and a sentence that a segment ends in stays one.  An empty table stays one, and
    without labels of both kinds all scores are alike.  Rows pass one by one: repeats
    and other columns stay as they are; columns named like results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        m = shared.value
        lookup, weights, bias = _lookup(m["buckets"]), m["weights"], m["bias"]
        plain = np.logaddexp(0, bias)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

        def scan(batch):
            column = TextColumn(batch.column(text))
            blobs = iter(column)
            scores, sizes, spans = [], [], []
            for _, pieces in _units(column):
                blob = next(blobs)
                b, s, n = _text_sentences(pieces)
                sentence, feature = _hits(b, s, lookup) if n else (np.zeros(0, np.int64),) * 2
                own, at = np.unique(sentence, return_inverse=True)
                z = bias + np.bincount(at, weights=weights[feature], minlength=len(own))
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum() - (n - len(own)) * plain)))
                sizes.append(n)
                p = 1 / (1 + np.exp(-z))
                spans.append(_located(blob, pieces, s, own[p >= 0.5], p[p >= 0.5]))
            return [pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), pa.array(spans, kind)]

        return scan

    return with_computed(docs, SCORED, start)


def _located(blob: bytes, pieces, sentence, wanted, p) -> list[dict]:
    """Code point spans of sentences, by their first and last word's bytes."""
    if not len(wanted):
        return []
    starts, ends, base = [], [], 0
    for piece in pieces:
        w = piece[4]
        # where this text begins in the run's buffer
        line = int(np.searchsorted(w.doc, w.doc[np.searchsorted(w.start, piece[2][0])])) if len(piece[2]) else 0
        raw_start = w.start[line] if len(w.start) else 0
        lead = blob.find(bytes(w.raw[raw_start : w.end[line]]), base) if len(piece[2]) else base
        starts.append(piece[2] - raw_start + lead)
        ends.append(piece[3] - raw_start + lead)
        base = int(ends[-1][-1]) if len(ends[-1]) else base
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    out = []
    for k, q in zip(wanted, p, strict=True):
        a, b = np.searchsorted(sentence, (k, k + 1))
        before = len(blob[: starts[a]].decode("utf-8", "surrogatepass"))
        out.append({"start": before, "end": before + len(blob[starts[a] : ends[b - 1]].decode("utf-8", "surrogatepass")), "score": float(q)})
    return out
