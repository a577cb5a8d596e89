"""Resampling, centroids and exact duplicates against brute force, on odd rows too."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

LOWER = {i: chr(i + 32) for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(t, widths=2):
    w = WORD.findall((t or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, widths + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent=25, least=20, widths=2, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) by the rule, one document after another."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in features(x, widths)[1]:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x, widths)[1]:
            t[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, x in rows:
        n, fs = features(x, widths)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(fit, 1):
        r.append(place if place <= len(fit) * percent // 100 else None)
    return sorted((tuple(r[:4]) + ((r[5] if len(r) > 5 else None),) for r in out), key=str)


def odd_rows(rng):
    texts = [None, "", " \n", "one", "ONE two", "Ünïcode É word 日本 𝒳𝒴 end", "a-b_c.d", "x\x7fy\x00z", "z" * 5000, "one two " * 4000]
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(7, "again the same id"), (3, "one"), (3, "one"), (None, "no id " * 30), (None, "no id " * 30), (12, texts[12])]
    return rows


def test_resample(spark):
    from pactum.llm.resample import resample

    rng = random.Random(5)
    rows = odd_rows(rng)
    target = [" ".join(f"w{rng.randrange(60)}" for _ in range(50)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, rank string, units int, bucket string").repartition(7)
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == resampled(rows, target)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(features(t)[0] >= 20 for _, t in rows) * 25 // 100


def test_resample_in_pieces_and_of_nothing(spark):
    from pactum.llm.resample import bucket_counts, importance_weights, resample

    rng = random.Random(6)
    texts = [t for _, t in odd_rows(rng)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for widths in (1, 2, 3):
        whole = bucket_counts(docs, "text", widths, 101)
        assert whole == bucket_counts(docs, "text", widths, 101, piece=13)
        expected = [0] * 101
        for t in texts:
            for f in features(t, widths)[1]:
                expected[zlib.crc32(f.encode()) % 101] += 1
        assert whole == expected
        gains = [(k * 37) % 53 - 20 for k in range(101)]
        a = importance_weights(docs, gains, widths).collect()
        assert sorted(map(str, a)) == sorted(map(str, importance_weights(docs, gains, widths, piece=13).collect()))
    none = docs.where("false")
    assert resample(none, docs.select("text")).count() == 0
    assert resample(docs, none.select("text")).count() == len(texts)


def lloyd(rows, k=40, rounds=5):
    """Integer k-means, every distance worked out; rows of (vec_id, list of int)."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(r[1]) for r in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        held = [[] for _ in c]
        for _, x in rows:
            held[near(x)[1]].append(x)
        c = [[sum(col) // len(h) for col in zip(*h)] if h else m for h, m in zip(held, c)]
    out = [(i, *reversed(near(x))) for i, x in rows]
    return sorted(out, key=str), c


def test_centroids(spark):
    from pactum.llm.centroids import cluster_vectors, kept_vectors

    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.4, (12, 64))
    vectors = [(middle[k % 12] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist() for k in range(400)]
    vectors += [vectors[0]] * 30 + [[0.0] * 64] * 5 + [[1e30] * 64, [-1e30] * 64, [700.0] * 32 + [-700.0] * 32]
    rows = [(k, v, 1, "x") for k, v in enumerate(vectors)]
    rows += [(7, vectors[3], 1, "x"), (None, vectors[9], 1, "x")]
    bad = [(900, None, 1, "x"), (901, [], 1, "x"), (902, [0.5] * 63, 1, "x"), (903, [0.5] * 63 + [None], 1, "x"), (904, [float("nan")] * 64, 1, "x"), (905, [float("inf")] + [0.0] * 63, 1, "x")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int, distance string").repartition(5)
    largest = 189_812_531
    whole = [(i, [max(-largest, min(largest, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v, *_ in rows]
    assigned, found = cluster_vectors(kept_vectors(table))
    expected, centroids = lloyd(whole)
    got = assigned.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == expected
    named = {r["cluster"]: r for r in found.collect()}
    for j, c in enumerate(centroids):
        inertia = sum(d for _, at, d in expected if at == j)
        assert named[j]["components"] == c and named[j]["cluster_inertia"] == min(inertia, (1 << 63) - 1)
        assert named[j]["centroid_sha256"] == hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # bounds save scans: without them every vector is scanned in each of six rounds
    assert sum(r["scans"] for r in got) < 4 * len(got)


def test_centroids_of_few_vectors_and_ties(spark):
    from pactum.llm.centroids import assign, cluster_vectors, kept_vectors

    table = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64), (3, [1.0] * 64)], "vec_id long, embedding array<float>")
    assigned, found = cluster_vectors(kept_vectors(table))
    assert found.count() == 3 and {r["distance"] for r in assigned.collect()} == {0}
    # equal centroids: the smaller number has the vectors, the other stays empty where it was
    rows = {r["cluster"]: r["size"] for r in found.collect()}
    assert sorted(rows.values()) == [0, 1, 2]
    assigned, found = cluster_vectors(kept_vectors(table.where("false")))
    assert assigned.count() == 0 and found.count() == 0
    # a vector in the middle of two centroids stays with the smaller number though centroids move about it
    x, c = np.array([[0, 0], [5, 0]]), np.array([[-2, 0], [2, 0]])
    state = assign(x, c)
    again = assign(x, np.array([[-1, 0], [1, 0]]), state, c)
    assert state["cluster"].tolist() == [0, 1] and again["cluster"].tolist() == [0, 1]
    back = assign(x, np.array([[3, 0], [-3, 0]]), again, np.array([[-1, 0], [1, 0]]))
    assert back["cluster"].tolist() == [0, 0]
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (500, 3))
    centers = rng.integers(-40, 40, (9, 3))
    state = assign(x, centers)
    for _ in range(25):
        moved = centers + rng.integers(-3, 4, centers.shape)
        state = assign(x, moved, state, centers)
        centers = moved
        d = ((x[:, None, :] - centers[None]) ** 2).sum(2)
        assert (state["cluster"] == d.argmin(1)).all()
    assert state["scans"].sum() < 26 * 500


def deduped(rows):
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        for k, i in enumerate(ids):
            out.append((i, keep, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def long_texts(rng):
    sentence = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 20))) + rng.choice([". ", "! ", "\n", "?\n"])
    base = ["".join(sentence() for _ in range(rng.randrange(1, 200))) for _ in range(25)]
    return base + [base[3]] * 4 + [base[5] + "x", base[5][:-1], "y" + base[5], base[6].upper()] + ["a" * 20_000] * 2 + ["a" * 20_001, "𝒳é日" * 3000, "\n" * 3000, "\n" * 3001]


def test_chunks(spark):
    from pactum.llm.exact_dedup import LEAST, MOST, chunks

    texts = [*long_texts(random.Random(8)), "", "a", "b" * LEAST, "b" * (LEAST + 1), "c" * (2 * MOST + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", chunks(F.col("text")).alias("c")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert "".join(r["c"]) == texts[r["k"]] and all(0 < len(c) <= MOST for c in r["c"])
    # a change at the front leaves later chunks as they were
    by = {r["k"]: r["c"] for r in rows}
    assert len(set(by[3]) & set(by[25])) == len(set(by[3]))


def test_exact_dedup(spark):
    from pactum.llm.exact_dedup import dedup_exact, exact_groups, recipes

    rng = random.Random(9)
    texts = [None, "", "", " ", None, "one", "One", "one ", "one"] + long_texts(rng)
    rows = [*enumerate(texts), (3, " "), (None, "one"), (None, "only without id"), (None, "only without id"), (11, texts[11]), (11, texts[11])]
    docs = spark.createDataFrame([(i, t, "r", 1, "s") for i, t in rows], "doc_id long, text string, recipe string, row int, salt string").repartition(6)
    got = lambda df: sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got(dedup_exact(docs)) == deduped(rows)
    # a digest that most contents share: lists are told apart by the contents' ranks
    poor = lambda c: F.lpad(F.hex(F.length(c) % 3), 4, "0")
    assert got(exact_groups(recipes(docs, poor), salts=2)) == deduped(rows)
    assert dedup_exact(docs.where("false")).count() == 0


def test_exact_dedup_plan_is_native(spark):
    from pactum.llm.exact_dedup import exact_groups, recipes

    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_groups(recipes(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD\\[python", plan.replace("LogicalRDD", ""))


def judged(url, rules, default="allow"):
    """Host, path, rule and verdict by the rule, one URL against all rules."""
    rest = url.split("://", 1)[1] if url and "://" in url else None
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S) if rest is not None else None
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_thousands_of_url_rules(spark):
    """Rules of many shapes are one literal, not a plan of their own size each; results as rule by rule."""
    from pactum.llm.url_filter import judge_urls

    rng = random.Random(31)
    names = ["com", "net", "example.com", "a.example.com", "b.net", "c.b.net", "x"]
    path = lambda: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randrange(60)))
    rules = {(rng.choice(names), path()): rng.choice(["allow", "block"]) for _ in range(3000)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{rng.choice(['', 'www.', 'B.'])}{rng.choice(names)}{path()}{rng.choice(['', '?q=/', '#x'])}" for _ in range(300)]
    urls += [f"https://{h}{p}tail" for h, p, _ in rules[:200]] + [None, "", "no scheme", "://", "http://", "http://.com/", "x://com", "http://com?//a"] + [urls[0]] * 3
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (1 << 26, 0):
        got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, table, broadcast_bytes=limit).select("page_id", "host", "path", "rule", "verdict").collect()}
        assert got == {k: judged(u, rules) for k, u in enumerate(urls)}
    assert len(judge_urls(pages, table)._jdf.queryExecution().logical().toString()) < 400_000
    none = judge_urls(pages, table.where("false"))
    assert none.count() == len(urls) and none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert judge_urls(pages.where("false"), table).count() == 0


def test_training_rows_are_bounded(spark):
    """An id that many rows repeat gives one row; so no more rows train than the bound says."""
    from pactum.llm.toxicity import training_rows

    docs = spark.createDataFrame([(k % 40 if k < 400 else 7, f"text {k}") for k in range(2000)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(5, 0, 0), (6, None, 0)], "doc_id long, toxic int, quality int")
    rows = training_rows(docs, labels, "toxic", 30, lambda _: F.lit(True)).collect()
    assert len(rows) == 30
    every = training_rows(docs, labels, "toxic", 1000, lambda _: F.lit(True)).collect()
    # 5 has contrary labels
    assert len(every) == 39 and sum(r["_label"] for r in every) == 19


def test_texts_without_words_stand_anywhere(spark):
    """Null, empty and blank texts before and between others, in training and in scoring: no sentences, score 0, and the others score as without them."""
    from pactum.llm.toxicity import score, train

    rng = random.Random(47)
    blanks = [None, "", " \n\t ", "\u000b"]
    said = [". ".join(" ".join(f"w{rng.randrange(200)}" for _ in range(8)) for _ in range(4)) + (" nastyword." if k % 3 == 0 else ".") for k in range(90)] + ["long words. " * 110_000]
    texts = [t for k, text in enumerate(said) for t in (blanks[k % 4], text)]
    frame = lambda rows: spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(2 * k + j, int(j and k % 3 == 0), 0) for k in range(90) for j in (0, 1)], "doc_id long, toxic int, quality int")
    model = train(frame(texts), labels, lambda _: F.lit(True))
    got = [tuple(r) for r in score(frame(texts), model).orderBy("doc_id").select("score", "n_sentences", "offending").collect()]
    assert got[::2] == [(0.0, 0, [])] * len(said)
    assert got[1::2] == [tuple(r) for r in score(frame(said), model).orderBy("doc_id").select("score", "n_sentences", "offending").collect()]
    assert all((s >= 0.5) == (k % 3 == 0) for k, (s, _, _) in enumerate(got[1:180:2]))


def test_all_item_indexes_in_one_stage(spark, monkeypatch):
    from pactum.llm import decontaminate

    rng = random.Random(41)
    item = lambda k: f"what is the name of thing {k} in the {rng.randrange(9)} old books of town {k * 7}? it is called thing number {k * 3} by all {k}"
    items = [(k, item(k)) for k in range(60)]
    texts = [(k, f"some words before {items[k % 60][1] if k % 2 else 'nothing'} and after " + " ".join(f"w{rng.randrange(99)}" for _ in range(40))) for k in range(150)]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaked(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 400)
    parts = decontaminate.leaked(docs, benchmark)
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, parts.collect())) == whole and {(k, k % 60) for k in range(1, 150, 2)} <= {r[:2] for r in whole}


def test_tables_of_operators_go_with_their_block(spark, tmp_path):
    """Tables that cut lineage are removed at the end of scratch(); the written result stays and is that of a run without it."""
    from pactum.llm import ngram_join
    from pactum.llm.shared import fresh_path
    from pactum.sources.files import children, scratch

    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 4) * 50 + j}" for j in range(40))) for k in range(40)], "doc_id long, text string")
    base = fresh_path(spark, "x").rsplit("/", 1)[0]
    want = sorted(map(tuple, ngram_join.join_documents(docs).collect()))
    before = children(spark, base)
    with scratch(spark):
        ngram_join.join_documents(docs).write.parquet(f"file://{tmp_path}/out")
        assert len(children(spark, base)) > len(before)
    assert children(spark, base) == before
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect())) == want
