"""Quality by hierarchical empirical Bayes: a document classifier's evidence on top of its site's posterior.

The classifier is logistic in binned surface features of the text (shares of
character classes, repetition, word and line shape), fitted on a bounded
sample of labelled documents.  Labels of all documents are counted by host and by
host and path; a host's rate is shrunk toward the global rate and a path's
toward its host's, by beta priors whose strengths come from the spread between
sites.  Sites without labels get their parent's rate.  The final log-odds are
the classifier's, less the base rate's, plus the site's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import broadcast_if_small, free_name, stash, with_computed
from pactum.llm.toxicity import training_rows
from pactum.llm.wordhash import TextColumn, shingles, word_hashes

TRAIN_ROWS = 20_000
BINS, STEPS, RATE, RIDGE = 12, 400, 0.15, 1e-4
#: A document is kept unless its probability of good quality is under this.
THRESHOLD = 0.5
#: A site's prior counts as so many documents at least and at most.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
N_FEATURES = 18

_CLASSES = np.zeros((256, 10), dtype=np.int32)
for _k, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" ", b"\n", b".,;:?", b"!", b"|", b"#$%&*@^~<>{}[]=+\\/_", range(0x80, 0x100))):
    _CLASSES[list(_bytes), _k] = 1


def features(column: TextColumn) -> np.ndarray:
    """One row per text: what a text looks like, whatever its language."""
    out = np.zeros((len(column), N_FEATURES))
    blobs = iter(column)
    for k, words in word_hashes(column):
        blob = next(blobs)
        n, m = len(blob), len(words)
        if not m:
            continue
        upper, lower, digit, space, line, stop, bang, bar, sign, high = np.bincount(np.frombuffer(blob, np.uint8), minlength=256) @ _CLASSES
        letters = max(1, upper + lower + high)
        _, counts = np.unique(words, return_counts=True)
        five = shingles(words)
        lines = [x for x in blob.split(b"\n") if x.strip()]
        ends = sum(x.rstrip()[-1:] in b".!?\":" for x in lines)
        out[k] = (
            np.log1p(n), upper / letters, digit / n, space / n, line / n, stop / n, bang / n, bar / n, sign / n, high / n,
            (n - space - line) / m, len(counts) / m**0.75, counts.max() / m, 1 - len(np.unique(five)) / len(five),
            1 - len(set(lines)) / len(lines), ends / len(lines), np.log1p(n / len(lines)), np.log1p(m),
        )
    return out


def _design(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    steps = [(x[:, [j]] > model["cuts"][j][None, :]) for j in range(x.shape[1])]
    return np.concatenate([np.clip(z, -6, 6), *steps], axis=1).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The document classifier, from at most `rows` labelled documents; a base rate alone where labels are of one kind or there are none."""
    sample = training_rows(docs, labels, "quality", rows, lambda _: F.lit(True))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = features(TextColumn(batch.column("text")))
            yield pa.record_batch([batch.column("_label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    got = sorted((r["label"], bytes(r["x"])) for r in sample.mapInArrow(run, "label int, x binary").collect())
    y = np.array([g[0] for g in got], dtype=np.float64)
    x = np.array([np.frombuffer(g[1]) for g in got]).reshape(len(got), N_FEATURES)
    if not len(y) or y.min() == y.max():
        return {"base": float(np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99)), "weights": None}
    quantiles = np.linspace(0, 1, BINS + 2)[1:-1]
    # bins of the rarer class tell where it stands, bins of all where most do
    rare = x[y == (y.mean() < 0.5)]
    model = {
        "mean": x.mean(0), "scale": x.std(0) + 1e-9,
        "cuts": [np.unique(np.concatenate((np.quantile(x[:, j], quantiles), np.quantile(rare[:, j], quantiles)))) for j in range(N_FEATURES)],
        "base": float(y.mean()),
    }
    a = _design(x, model)
    w, b = np.zeros(a.shape[1]), np.log(y.mean() / (1 - y.mean()))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        miss = 1 / (1 + np.exp(-(a @ w + b))) - y
        g = np.append(a.T @ miss / len(y) + RIDGE * w, miss.mean())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return model | {"weights": w, "bias": float(b)}


def _strength(rates: DataFrame, good: str, n: str, mean: Column) -> Column:
    """Strength of the beta prior by moments: between-site variance of rates beyond what counts of that size give."""
    spread = F.sum((F.col(good) / F.col(n) - mean) * (F.col(good) / F.col(n) - mean) * F.col(n)) / F.sum(n)
    noise = F.sum(mean * (1 - mean)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, labelled, rate) for every site of docs, and the global rate, from all labelled documents."""
    clear = (
        labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("quality").alias("_q")).where("q = _q").select("doc_id", "q")
    )
    keys = [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path")]
    rated = docs.select("doc_id", *keys).join(clear, "doc_id", "left")
    sites = stash(rated.groupBy("_host", "_path").agg(F.count("q").alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("good")), "quality-sites")
    total = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    mean = F.lit(base)
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    s = hosts.where("host_n > 0").agg(_strength(hosts, "host_good", "host_n", mean).alias("s")).first()["s"] or LEAST_STRENGTH
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + s * mean) / (F.col("host_n") + s))
    both = sites.join(broadcast_if_small(hosts, 80), "_host")
    s = both.where("n > 0").agg(_strength(both, "good", "n", F.col("host_rate")).alias("s")).first()["s"] or LEAST_STRENGTH
    return both.select("_host", "_path", F.col("n").alias("labelled"), ((F.col("good") + s * F.col("host_rate")) / (F.col("n") + s)).alias("rate")), base


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs with doc_score, site_rate, quality_score (0 to 1) and keep.

    Null and wordless texts have no evidence of their own: the features of an
    empty text decide with the site's rate.  Null hosts and paths are sites of
    their own.  Documents with contrary or null labels don't train.  Repeated rows and other
    columns stay as they are; columns named like results are replaced.  Very long texts are walked in segments, over
    their whole length.  An empty table gives an empty table; without usable labels every document has the same score
    and is kept.
    """
    model = train(docs, labels)
    sites, base = site_posteriors(docs, labels, host, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        m = shared.value

        def scan(batch):
            column = TextColumn(batch.column("text"))
            if m["weights"] is None:
                return [pa.array(np.full(len(column), m["base"]))]
            z = _design(features(column), m) @ m["weights"] + m["bias"]
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

        return scan

    at_host, at_path, rate = (free_name(docs, x) for x in ("_host", "_path", "_rate"))
    scored = with_computed(docs, "doc_score double", start)
    sites = broadcast_if_small(stash(sites, "quality-rates").select(F.col("_host").alias(at_host), F.col("_path").alias(at_path), F.col("rate").alias(rate)), 120)
    scored = scored.withColumns({at_host: F.coalesce(F.col(host).cast("string"), F.lit("")), at_path: F.coalesce(F.col(path).cast("string"), F.lit(""))})
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = logit(inside(F.col("doc_score"))) - logit(inside(F.lit(model["base"]))) + logit(inside(F.coalesce(rate, F.lit(base))))
    return (
        scored.join(sites, [at_host, at_path], "left")
        .withColumn("site_rate", F.coalesce(rate, F.lit(base)))
        .withColumn("quality_score", 1 / (1 + F.exp(-odds)))
        .withColumn("keep", F.col("quality_score") >= THRESHOLD)
        .drop(at_host, at_path, rate)
    )
