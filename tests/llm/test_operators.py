"""Each operator against a brute-force version on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: chr(i + 32) for i in range(65, 91)}


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def docs_of(spark, texts, extra=()):
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def odd_texts():
    return [None, "", " \n\t ", "one two", "ONE Two", "é" * 50, "a" * 5000, "x. y! z?\n" * 200]


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(spark, monkeypatch):
    from pactum.llm import ngram_join

    rng = random.Random(1)
    texts = odd_texts() + [words(rng, 200) for _ in range(15)]
    base = words(rng, 150).split()
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = f"new{rng.randrange(9)}"
        texts.append(" ".join(t))
    common = words(rng, 40)
    texts += [common + " " + words(rng, 20) for _ in range(20)] + [texts[10]] * 3
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 80 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    want = {k: (len(sets[k]), find(k)) for k in range(len(texts))}
    for short, few in ((8, 256), (2, 4)):
        monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
        monkeypatch.setattr(ngram_join, "OPEN", few)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs_of(spark, texts)).collect()}
        assert got == want
    again = ngram_join.join_documents(docs_of(spark, ["a b c d e f"], [(0, "a b c d e f", None, None, None), (None, "q r s t u", None, None, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in again) == [("0", "0"), ("0", "0"), ("None", "None")]
    assert ngram_join.join_documents(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_ngram_links(spark, monkeypatch):
    """Every link is counted, also those inside a hot group, whatever the sizes of blocks and tiles."""
    from pactum.llm import ngram_join

    rng = random.Random(11)
    base = words(rng, 150).split()
    texts = odd_texts() + [words(rng, 100) for _ in range(5)]
    for k in range(60):
        t = list(base)
        for _ in range(k % 5):
            t[rng.randrange(len(t))] = f"new{rng.randrange(99)}"
        texts.append(" ".join(t))
    extra = [(None, texts[20], None, None, None), (3, "one two", None, None, None)]
    every = [*texts, texts[20], "one two"]
    sets = [shingle_set(t) for t in every]
    near = [[bool(a) and 100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    ids = [*range(len(texts)), None, 3]
    want = sorted((str(i), sum(row) - row[k]) for k, (i, row) in enumerate(zip(ids, near, strict=True)))
    docs = docs_of(spark, texts, extra)
    for block in (300_000, 2_000):
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
        got = ngram_join.join_documents(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want
    same = ("doc_id", "n_shingles", "component_id")
    assert rows(ngram_join.join_documents(docs).select(*same)) == rows(ngram_join.join_documents(docs, links=False))


def test_overlaps_are_derived(monkeypatch):
    """Derived overlaps equal counted ones, and similar sets are answered from each other."""
    from pactum.llm import ngram_join

    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 120, replace=False)
    sets = [np.unique(np.concatenate((base[rng.random(120) < 0.95], rng.choice(10_000, rng.integers(0, 6))))).astype(np.uint64) for _ in range(80)]
    sets += [np.unique(rng.choice(10_000, n)).astype(np.uint64) for n in (1, 2, 50, 130)]
    true = np.array([[len(np.intersect1d(x, y)) for x in sets] for y in sets])
    for difference in (0.0, 0.5, 2.0):
        monkeypatch.setattr(ngram_join, "DIFFERENCE", difference)
        index, asked = ngram_join.Overlaps(sets), []
        listed = index._listed
        index._listed = lambda t: (asked.append(len(t)), listed(t))[1]  # noqa: B023
        order = ngram_join._alike_first(sets)
        assert sorted(order) == list(range(len(sets)))
        for k in order:
            assert (index.of(sets[k]) == true[k]).all()
            size = np.array([len(s) for s in sets])
            assert (index.linked(sets[k]) == (100 * true[k] >= 80 * (size + len(sets[k]) - true[k]))).all()
        if difference == 0.5:
            assert sum(asked) < 0.5 * sum(map(len, sets)) * 2


def test_sets_of_one_id_are_renamed(spark, monkeypatch):
    """Different sets that share an id get others that nobody has; the join is the same under any ids."""
    from pactum.llm import ngram_join

    rows = [(0, 0, 1, 7, 1, 5, None), (0, 0, 2, 7, 2, 6, None), (0, 0, 3, 7, 2, 6, None), (0, 0, 4, 8, 2, 6, None), (1, 3, None, None, None, None, b"x")]
    first = iter([9, 8, 9, 11])
    with monkeypatch.context() as m:
        m.setattr(ngram_join, "describe_sets", lambda docs, bits: spark.createDataFrame(rows, ngram_join.SETS))
        m.setattr(ngram_join, "_another", lambda key, proof, turn: next(first))
        described, renamed = ngram_join._described(spark.range(1), 8)
    # 9 is free and taken at once, 8 is another set's, 9 is taken by then
    assert renamed == {(7, 1): 9, (7, 2): 11}
    assert sorted((r["doc_id"], r["set_id"]) for r in described.where("kind = 0").collect()) == [(1, 9), (2, 11), (3, 11), (4, 8)]
    rng = random.Random(11)
    base = words(rng, 100).split()
    texts = [" ".join(base[: 60 + k]) for k in range(30)] + [words(rng, 50) for _ in range(10)] + ["", None, "one two"]
    docs = docs_of(spark, texts)
    expected = rows_of(ngram_join.join_documents(docs))
    told = ngram_join._described

    def all_renamed(docs, bits):
        described, _ = told(docs, bits)
        found = described.where("kind = 0").select("set_id", "proof").distinct().collect()
        names = {(r["set_id"], r["proof"]): k for k, r in enumerate(sorted(found))}
        table = spark.createDataFrame([(*k, v) for k, v in names.items()], "set_id long, proof long, other long")
        return described.join(table, ["set_id", "proof"], "left").withColumn("set_id", F.coalesce("other", "set_id")).drop("other"), names

    monkeypatch.setattr(ngram_join, "_described", all_renamed)
    assert rows_of(ngram_join.join_documents(docs)) == expected


def rows_of(df):
    return sorted(map(str, df.collect()))


def thue_morse(letters):
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def test_long_words_of_regular_build_stay_apart(spark):
    """Words whose polynomial sums agree modulo 2**64 are different words, alone and within texts."""
    from pactum.llm.decontaminate import leaked
    from pactum.llm.ngram_join import join_documents
    from pactum.llm.wordhash import word_hashes

    texts = [w for n in (1024, 2048, 8192, 65_536) for w in thue_morse(n)]
    hashes = [h for _, h in word_hashes(texts)]
    assert all(len(h) == 1 for h in hashes) and len({int(h[0]) for h in hashes}) == len(texts)
    got = join_documents(docs_of(spark, texts)).collect()
    assert all(r["n_links"] == 0 and r["component_id"] == r["doc_id"] for r in got)
    items = spark.createDataFrame([(1, f"what is {texts[2]} called in old books? it is {texts[2]} of course my friend")], "item_id long, text string")
    docs = spark.createDataFrame([(1, items.first()["text"]), (2, items.first()["text"].replace(texts[2], texts[3]))], "doc_id long, text string")
    assert {r["doc_id"] for r in leaked(docs, items).collect()} == {1}


def test_word_hashes_are_those_of_words():
    """Equal for equal words wherever they stand and whatever A-Z case, different for all others here."""
    from pactum.llm.wordhash import runs, word_hashes

    rng = random.Random(21)
    pool = ["".join(rng.choice("abé日z\x00\x01") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 25, 40) for _ in range(60)]
    pool += ["a" * n for n in range(1, 60)] + ["\x00" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 30)]
    seen = {}
    for _ in range(40):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "  \t"]) for _ in range(200))
        ((_, h),) = word_hashes([rng.choice([" ", ""]) + (text.upper().replace("É", "é") if rng.random() < 0.3 else text)])
        for w, x in zip(re.findall("[^\x20\x09-\x0d]+", text), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    ((_, a),) = runs(["abcdefgh x"])
    ((_, b),) = runs(["  abcdxxxx abcd y"])
    assert a.prefix_hash(4)[0] == b.prefix_hash(4)[0] == b.prefix_hash(4)[1] and a.prefix_hash(3)[0] != a.prefix_hash(4)[0]


def test_components_rounds(spark):
    from pactum.llm.shared import components

    rng = random.Random(2)
    links = [(k, k + 1) for k in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    df = spark.createDataFrame(links, "src long, dst long")
    one, many = (sorted(map(tuple, components(df, "t", few_links=n).collect())) for n in (10**6, 0))
    assert one == many and dict(one)[30] == 0 and dict(one)[539] == 500


def test_decontamination(spark):
    from pactum.llm import decontaminate

    rng = random.Random(3)
    items = [f"{words(rng, 20)}. {words(rng, 15)}." for _ in range(30)] + ["two words", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = odd_texts() + [words(rng, 600) for _ in range(20)]
    for k in range(10):
        t = words(rng, 400).split()
        t[150:150] = items[k].upper().split()
        texts.append(" ".join(t))
    texts.append(words(rng, 30) + " Two, words! " + words(rng, 30))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked(docs_of(spark, texts), bench).collect()}
    assert got == {(28 + k, k) for k in range(10)} | {(38, 30)}
    kept = decontaminate.remove_leaked(docs_of(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(28)) and kept.columns == docs_of(spark, texts).columns
    assert decontaminate.leaked(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_finds_spread_leaks(spark, monkeypatch):
    """Items whose parts, or shingles, stand far apart in a document; all leaks as brute force over every pair finds them."""
    from pactum.llm import decontaminate

    rng = random.Random(13)
    items = [f"{words(rng, 30)}. {words(rng, 30)}." for _ in range(12)] + [" ".join(["again and"] * 9) + " once. " + words(rng, 6) + ".", f"short one here. {words(rng, 25)}."]
    texts = []
    for k in range(30):
        t = words(rng, 1500).split()
        parts = items[k % 14].split(". ")
        for at, part in zip((1200, 100), parts, strict=True):
            p = part.rstrip(".").split()
            for _ in range(k // 14):
                p[rng.randrange(len(p))] = f"new{k}"
            t[at:at] = p
        texts.append(" ".join(t))
    for item in items[:6]:
        # runs of ten words, each far from the next
        w = item.replace(".", "").split()
        texts.append(" ".join(" ".join(w[a : a + 14]) + " " + words(rng, 300) for a in range(0, len(w), 10)))
    norm = lambda t: re.findall(r"[a-z0-9]+", t.lower())

    def grams(t):
        w = norm(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    def has(part, doc):
        g, w = grams(part), norm(doc)
        return sum(any(tuple(w[i : i + len(x)]) == x for i in range(len(w))) if len(x) < 5 else x in grams_of[doc] for x in g) / len(g)

    grams_of = {t: grams(t) for t in texts}
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            q, a = decontaminate._parts(item)
            if has(item, t) >= 0.8 or min(has(q, t), has(a, t)) >= 0.8:
                want.add((d, k))
    assert {(14 + k, k) for k in range(12)} <= want and {(30 + k, k) for k in range(6)} <= want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    first = decontaminate.leaked(docs_of(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in first} == want
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1000)
    second = decontaminate.leaked(docs_of(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["bm25"], 3)) for r in first) == sorted((r["doc_id"], r["item_id"], round(r["bm25"], 3)) for r in second)


@pytest.mark.parametrize("n_items", [10, 5000])
def test_retrieval_against_every_pair(n_items, monkeypatch):
    """BM25 of every document and item by the formula, and the items that reach their thresholds; whatever the sizes of blocks, pivots and tables."""
    from pactum.llm import decontaminate
    from pactum.llm.wordhash import word_hashes

    rng = random.Random(n_items)
    items = [f"{words(rng, rng.randrange(5, 40), 3000)}. {words(rng, rng.randrange(1, 20), 3000)}." for _ in range(n_items - 2)] + ["one", " ".join(["twice"] * 30)]
    texts = [words(rng, 300, 3000) for _ in range(25)] + ["", "one", "zzz"]
    for k in range(12):
        t = words(rng, 200, 3000).split()
        t[50:50] = items[k % len(items)].split()[: 40 - 2 * k]
        texts.append(" ".join(t))
    said = [re.findall("[a-z0-9]+", t.lower()) for t in items]
    df, mean = {}, sum(map(len, said)) / len(said)
    for w in said:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    held = {}
    for k, w in enumerate(said):
        for x in set(w):
            tf = w.count(x)
            score = np.log(1 + (len(said) - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            held.setdefault(x, []).append((k, score))
    index = decontaminate.Index(list(enumerate(items)))
    asked = [w for _, w in word_hashes(texts, loose=True)]
    place = {int(i): k for k, i in enumerate(index.ids)}
    want = []
    for t in texts:
        total = {}
        for x in set(re.findall("[a-z0-9]+", t.lower())):
            for k, score in held.get(x, ()):
                total[k] = total.get(k, 0) + score
        want.append({place[k]: score for k, score in total.items() if score >= index.least[place[k]]})
    assert sum(map(len, want)) >= 6
    for cells, pivot, block in ((1 << 22, 0.5, 8), (0, 0.0, 8), (1 << 10, 0.9, 3)):
        for name, value in (("CELLS", cells), ("PIVOT", pivot), ("BLOCK_ITEMS", block)):
            monkeypatch.setattr(decontaminate, name, value)
        got = decontaminate.Index(list(enumerate(items))).retrieve(asked)
        assert [sorted(g) for g in got] == [sorted(w) for w in want]
        assert all(abs(g[k] - w[k]) < 1e-6 for g, w in zip(got, want, strict=True) for k in w)
    # lists, not a table of terms and items
    assert index.bytes() < 3_000_000 + 4_000 * n_items


def test_chat(spark):
    from pactum.llm import chat

    rows = [(1, 0, "user", "a\\b<|end|>"), (1, 1, "assistant", "<s>x"), (1, 2, "assistant", None), (2, 0, None, "é"), (None, 0, "assistant", "n"), (1, 1, "assistant", "<s>x"), (3, 0, "ro\nle", "<|turn|>user\n")]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", f"t{k} " * (k % 5)) for k in range(200)]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.MarkedTemplate().render(turns)) and r["rewrites"] == 0


def test_rewriting_template_is_found():
    from pactum.llm.chat import MarkedTemplate, PrefixRenderer

    class Last(MarkedTemplate):
        def render(self, turns):
            return super().render([(role, text if k == len(turns) - 1 else "...") for k, (role, text) in enumerate(turns)])

    r = PrefixRenderer(Last())
    assert [r.add("user", f"text {k}")["rewrites"] for k in range(3)] == [False, True, True]


def test_templates_that_look_far_back():
    """Rewriting that only long conversations show, and turns that depend on the first one, are seen; a template may ask for its first turn."""
    from pactum.llm.chat import MarkedTemplate, PrefixRenderer

    class Latest(MarkedTemplate):
        def render(self, turns):
            return super().render(turns[-100:])

    r = PrefixRenderer(Latest())
    assert [r.add("user", f"text {k}")["rewrites"] for k in range(150)] == [k >= 100 for k in range(150)]

    class FirstAgain(MarkedTemplate):
        def render(self, turns):
            assert turns[0][0] == "system"
            return super().render([(role, f"{turns[0][1]} {text}") for role, text in turns])

    r, turns = PrefixRenderer(FirstAgain()), [("system", "rule"), *((("user", "assistant")[k % 2], f"t{k}") for k in range(150))]
    out = [r.add(*t) for t in turns]
    assert "".join(x["piece"] for x in out) == FirstAgain().render(turns) and not any(x["rewrites"] for x in out[1:])


def test_mixing(spark):
    from pactum.llm import mixing

    rows = [(k, "t", "en", None if k % 50 == 0 else "big" if k % 3 else f"s{k % 7}", 1) for k in range(5000)]
    got = sorted(mixing.mix(spark.createDataFrame([*rows, rows[1]], DOCS)).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(5001))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
        slots[r["slot"]] = (r["source"], r["phase"])
    left = {s: -(-n // mixing.BLOCK_DOCS) for s, n in sizes.items()}
    weights = mixing.target_weights(sizes, None)
    done, phase, begin = {}, 0, 0
    for slot in sorted(slots):
        source, p = slots[slot]
        if p != phase:
            left = {s: n - done.get(s, 0) for s, n in left.items() if n > done.get(s, 0)}
            done, phase, begin = {}, p, slot
        done[source] = done.get(source, 0) + 1
        total = sum(weights[s] for s in left)
        assert all(abs(done.get(s, 0) - (slot - begin + 1) * weights[s] / total) < 1 for s in left)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def schedule_by_hand(sources):
    """The rule itself: in every slot all sources are looked through; sources of weight zero aren't handled here."""
    from math import ceil, floor

    left, had, slot, phase, made = {n: b for n, b, _ in sources if b}, {n: 0 for n, _, _ in sources}, 0, 0, []
    weight = {n: w for n, _, w in sources}
    while left:
        total, begin, j = sum(weight[n] for n in left), slot, {n: 1 for n in left}
        share = {n: weight[n] / total for n in left}
        while True:
            free = [n for n in left if floor((j[n] - 1) / share[n]) <= slot - begin]
            n = min(free, key=lambda n: (ceil(j[n] / share[n]), (j[n] / share[n]).denominator == 1, -share[n], n))  # noqa: B023
            made.append((n, had[n], slot, phase, begin + floor((j[n] - 1) / share[n]), begin + ceil(j[n] / share[n])))
            had[n], j[n], left[n], slot = had[n] + 1, j[n] + 1, left[n] - 1, slot + 1
            if not left[n]:
                del left[n]
                phase += 1
                break
    return made


def test_mixing_against_windows_by_hand():
    """The schedule against one that looks through all sources in every slot, straight from the rule; ties and sources that end included."""
    from fractions import Fraction

    from pactum.llm import mixing

    rng = random.Random(16)
    for _ in range(60):
        sources = [(f"s{k}", rng.randrange(0, 25), Fraction(rng.choice([0.1, 0.3, 1 / 3, 0.5, 1, 2, 7.7]))) for k in range(rng.randrange(1, 7))]
        assert list(mixing.schedule(sources)) == schedule_by_hand(sources)


def test_mixing_of_a_million_blocks():
    """Every block in its window, every slot taken once, every source less than one block from its share in every slot of a phase."""
    from pactum.llm import mixing

    sizes = {f"s{k}": 30_000 * (k + 1) for k in range(8)}
    weights = mixing.target_weights(sizes, None)
    rows = list(mixing.schedule([(name, n, weights[name]) for name, n in sizes.items()]))
    assert len(rows) == sum(sizes.values()) >= 10**6 and [r[2] for r in rows] == list(range(len(rows)))
    assert all(r[4] <= r[2] < r[5] for r in rows)
    assert {r[0] for r in rows} == set(sizes) and all(sum(r[0] == name for r in rows[:: len(rows) // 5000]) for name in sizes)
    first = [r for r in rows if r[3] == 0]
    total = float(sum(weights.values()))
    for name in sizes:
        got = np.cumsum([r[0] == name for r in first])
        assert np.abs(got - np.arange(1, len(first) + 1) * float(weights[name]) / total).max() < 1


def test_mixing_blocks_are_the_same_at_every_size(spark):
    from pactum.llm.mixing import BLOCK_DOCS, mix

    rows = mix(spark.range(300_000).selectExpr("id AS doc_id", "concat('s', least(id % 4, 2)) AS source")).selectExpr("source", "block", "position").groupBy("source", "block").count()
    sizes = [r["count"] for r in rows.collect()]
    assert max(sizes) == BLOCK_DOCS and sum(sizes) == 300_000 and sum(n < BLOCK_DOCS for n in sizes) <= 3


def test_mixing_keeps_exact_weights():
    """Every prefix is less than a block from the unrounded targets, however long; tiny weights stay tiny, zero ones come last."""
    from fractions import Fraction

    from pactum.llm import mixing

    given = {"a": 1 / 3, "b": 2 / 3}
    shares = mixing.target_weights({"a": 10, "b": 10}, given)
    done = {"a": 0, "b": 0}
    for name, _, slot, phase, release, deadline in mixing.schedule([("a", 40_000, shares["a"]), ("b", 70_000, shares["b"])]):
        if phase:
            break
        done[name] += 1
        assert release <= slot < deadline and abs(3 * done["a"] - (slot + 1)) < 3 and abs(3 * done["b"] - 2 * (slot + 1)) < 3
    assert slot > 100_000
    many = {f"s{k}": 1 + k % 7 for k in range(100_000)}
    exact, total = mixing.target_weights(many, None), sum(many.values())
    assert all(abs(float(exact[s]) / (n / total) ** 0.7 - 1) < 1e-12 for s, n in many.items())
    odd = mixing.target_weights({"x": 1, "y": 1, "z": 1, "v": 1}, {"x": 0, "y": 1e-6, "z": 1.0, "v": 0})
    assert odd == {"x": 0, "y": Fraction(1e-6), "z": 1, "v": 0}
    order = list(mixing.schedule([("v", 2, odd["v"]), ("x", 4, odd["x"]), ("y", 1, odd["y"]), ("z", 9, odd["z"])]))
    assert [s[2] for s in order] == list(range(16)) and {s[0] for s in order[-6:]} == {"x", "v"} and all(s[4] <= s[2] < s[5] for s in order)
    assert [s[2] for s in mixing.schedule([("v", 2, Fraction(0))])] == [0, 1] and list(mixing.schedule([])) == []
    far = list(mixing.schedule([("t", 2, Fraction(1e-300)), ("z", 3, Fraction(1))]))
    assert len(far) == 5 and all(s[5] < 1 << 63 for s in far)


def test_vectors(spark):
    from pactum.llm import vector_dedup

    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v[100:300] = v[100] + 0.12 * rng.normal(size=(200, 16))
    v[300:310] = 3 * v[300]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [2.0] * 3), (905, [None, 1.0]), (906, [])]
    got = {r["vec_id"]: r for r in vector_dedup.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    true = near.sum() - len(v)
    assert sum(got[k]["n_links"] for k in range(600)) >= 0.99 * true and all(got[k]["n_links"] <= near[k].sum() - 1 for k in range(600))
    assert got[305]["component_id"] == 300 and not got[305]["kept"] and got[903]["n_links"] == 1 and got[904]["component_id"] == 903
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in (900, 901, 902, 905, 906))


def test_vectors_lose_no_sparse_links(spark, monkeypatch):
    """A hot group doesn't hide that pairs elsewhere are lost, and a graph that can't reach vectors gives way to brute force."""
    from pactum.llm import vector_dedup

    true = np.array([3000] * 21 + [1] * 43)
    assert vector_dedup.recalled(true, true) and not vector_dedup.recalled(np.where(true == 1, 0, true), true)
    assert not vector_dedup.recalled(np.where(np.arange(64) == 0, 1500, true), true)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(1200, 16))
    v[:400] = v[0] + 0.02 * rng.normal(size=(400, 16))
    v[400:800] = v[800:1200] + 0.02 * rng.normal(size=(400, 16))
    ids = np.arange(1200)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9

    within = vector_dedup.Graph.within

    def hot_only(self, units, *args):
        who, which = within(self, units, *args)
        kept = np.linalg.norm(units[who] - unit[0], axis=1) < 0.5
        return who[kept], which[kept]

    monkeypatch.setattr(vector_dedup.Graph, "within", hot_only)
    import pandas as pd

    side = lambda k: pd.DataFrame({"shard": 0, "side": k, "node": ids, "n": 1, "packed": [u.tobytes() for u in unit]})
    got = pd.concat(vector_dedup._answer(0.9, False)(iter([side(0), side(1)])))
    counts = got[got["kind"] == 0].groupby("a")["b"].sum().reindex(ids, fill_value=0).to_numpy()
    assert (counts == near.sum(axis=1) - 1).all()


def grouped_vectors(seed, groups, size, noise, width=64):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(groups, width)), size, axis=0) + noise * rng.normal(size=(groups * size, width))
    return v.astype(np.float32)


@pytest.mark.parametrize(("groups", "size"), [(25, 200), (100, 15), (400, 15)])
def test_graphs_hang_together(groups, size):
    """Tight groups don't become islands: a graph over them leads to every node, and finds nearly all links of nearly all nodes."""
    from pactum.llm import vector_dedup

    v = grouped_vectors(groups, groups, size, 0.25)
    n = len(v)
    own = vector_dedup.Shard(np.arange(n), np.ones(n), v)
    unit = v.astype(np.float64) / own.norms[:, None]
    graph = vector_dedup.Graph(own.singles())
    near = unit @ unit.T >= 0.9
    assert all(not len(islands) for _, _, islands in graph.layers) and graph.layers[-1][0] == n
    who, which = graph.within(unit, own, 0.9, vector_dedup.QUERY_BEAM)
    assert near[who, which].all()
    counts = np.bincount(who, minlength=n)
    assert (counts == near.sum(axis=1)).mean() >= 0.98 and counts.sum() >= 0.99 * near.sum()


def test_islands_are_entries():
    """What no node of the layer above leads to is found all the same."""
    from pactum.llm import vector_dedup

    v = grouped_vectors(3, 6, 50, 0.05)
    graph = vector_dedup.Graph(v / np.linalg.norm(v, axis=1, keepdims=True))
    size, links, _ = graph.layers[-1]
    group = graph.order // 50
    cut = np.where(group[np.maximum(links, 0)] == group[:, None], links, -1)
    islands = graph._islands(cut, 1)
    assert len(islands) >= 5 and len({group[0], *group[islands]}) == 6
    graph.layers[-1] = (size, cut, islands)
    found, cos = graph.search(v / np.linalg.norm(v, axis=1, keepdims=True), 16)
    assert (found[:, 0] == np.arange(300)).all() and (cos[:, 0] > 0.999).all()


def test_vectors_of_groups_copies_and_shared_ids(spark, monkeypatch):
    """All links over several shards, equal vectors folded, ids with several vectors; the audit tells what it saw."""
    from pactum.llm import vector_dedup

    v = grouped_vectors(5, 40, 15, 0.25)
    v = np.concatenate((v, np.repeat(v[:1], 200, axis=0)))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(0, v[0].tolist()), (2000, v[20].tolist()), (2000, v[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    keys = [(k, i) for i, (k, _) in enumerate(rows) if i != len(v)]
    every = np.array([rows[i][1] for _, i in keys])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want, root = {}, {k: k for k, _ in keys}
    for a, (k, _) in enumerate(keys):
        want[k] = want.get(k, 0) + int(near[a].sum()) - 1
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            x, y = keys[a][0], keys[b][0]
            low = min(root[x], root[y])
            changed |= root[x] != low or root[y] != low
            root[x] = root[y] = low
    for audit in (32, 1):
        monkeypatch.setattr(vector_dedup, "AUDIT_SHARE", audit)
        got = vector_dedup.dedup_vectors(df).collect()
        assert len(got) == len(rows)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {k: (n, root[k], root[k] == k) for k, n in want.items()}
    _, nodes, single = vector_dedup._nodes(df)
    assert single and nodes.count() == 600
    found = vector_dedup.find_links(nodes, single)
    # the graph answers, of a table of 600 too, and what it found is known to be nearly all
    assert vector_dedup.audited_recall(found) >= 0.99 and vector_dedup.brute_share(found) < 0.5


def labelled(spark, rng, bad):
    texts, labels = [], []
    for k in range(400):
        t = ". ".join(words(rng, 12, 300) for _ in range(8))
        y = int(k % 4 == 0)
        texts.append(bad(t, rng) if y else t)
        labels.append((k, 1 - y, y))
    labels += [(5, 1, 1), (7, None, None)]
    return docs_of(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    from pactum.llm import toxicity

    def bad(t, rng):
        s = t.split(". ")
        s[3] += f" nasty{rng.randrange(3)}word"
        return ". ".join(s)

    docs, labels = labelled(spark, random.Random(5), bad)
    model = toxicity.train(docs, labels, lambda c: c % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[k]["score"] >= 0.5) == (k % 4 == 0) for k in range(0, 400, 5))
    assert right >= 79 and got[400]["score"] == 0 and got[401]["n_sentences"] == 0
    span = got[20]["offending"][0]
    assert "nasty" in got[20]["text"][span["start"] : span["end"]] and len(got[20]["offending"]) == 1
    none = toxicity.train(docs, labels.limit(0), lambda c: F.lit(True))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, none).collect())


def test_quality(spark):
    from pactum.llm import quality

    docs, labels = labelled(spark, random.Random(6), lambda t, rng: t.upper().replace(" ", "!! | "))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert sum(got[k]["keep"] == (k % 4 != 0) for k in range(400)) >= 398 and len(got) == 402
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())


def test_noisy_or_of_sentences(spark):
    """A document's score is one less the product of what its sentences lack, each scored as a document of its own."""
    from pactum.llm import toxicity

    def bad(t, rng):
        return t.replace(". ", f" nasty{rng.randrange(3)}word. ", 1)

    docs, labels = labelled(spark, random.Random(17), bad)
    model = toxicity.train(docs, labels, lambda c: F.lit(True))
    rng = random.Random(18)
    texts = [". ".join(words(rng, 6, 300) + (" nasty1word" if rng.random() < 0.2 else "") for _ in range(1 + k % 5)) for k in range(40)]
    parts = [(k, t) for k, text in enumerate(texts) for t in re.split(r"(?<=[.]) ", text)]
    whole = [r["score"] for r in toxicity.score(docs_of(spark, texts), model).orderBy("doc_id").collect()]
    alone = toxicity.score(docs_of(spark, [t for _, t in parts]), model).orderBy("doc_id").collect()
    left = [1.0] * len(texts)
    for (k, _), r in zip(parts, alone, strict=True):
        assert r["n_sentences"] == 1
        left[k] *= 1 - r["score"]
    assert max(abs(1 - x - y) for x, y in zip(left, whole, strict=True)) < 1e-9 and max(whole) > 0.5 > min(whole)


def test_site_posteriors(spark):
    """Rates of hosts and paths recomputed by hand from all labels, shrunk by the strengths that the spread gives."""
    from pactum.llm import quality

    rng = random.Random(19)
    rows = [(k, "t", rng.choice("ab") if k % 5 else None, f"h{rng.randrange(6)}" if k % 7 else None, 1) for k in range(300)]
    labels = [(k, int(rng.random() < (0.9 if rows[k][3] == "h1" else 0.4)), 0) for k in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 0), (6, None, 0)]
    got, base = quality.site_posteriors(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "source", "lang")
    said = {}
    for d, q, _ in labels:
        if q is not None:
            said.setdefault(d, set()).add(q)
    sure = {d: q.pop() for d, q in said.items() if len(q) == 1}
    host, site = {}, {}
    for d, _, path, h, _ in rows:
        for table, key in ((host, h or ""), (site, (h or "", path or ""))):
            n, good = table.get(key, (0, 0))
            table[key] = (n + (d in sure), good + sure.get(d, 0))
    total, good = sum(n for n, _ in host.values()), sum(g for _, g in host.values())
    assert abs(base - (good + 1) / (total + 2)) < 1e-12

    def strength(table, mean):
        used = [(n, g, mean(key)) for key, (n, g) in table.items() if n]
        weight = sum(n for n, _, _ in used)
        spread = sum((g / n - m) ** 2 * n for n, g, m in used) / weight
        between = max(spread - sum(m * (1 - m) for _, _, m in used) / weight, 1e-9)
        return min(max(sum(m * (1 - m) for _, _, m in used) / len(used) / between - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    s = strength(host, lambda _: base)
    rate = {h: (g + s * base) / (n + s) for h, (n, g) in host.items()}
    s = strength(site, lambda key: rate[key[0]])
    want = {key: (n, (g + s * rate[key[0]]) / (n + s)) for key, (n, g) in site.items()}
    seen = {(r["_host"], r["_path"]): (r["labelled"], r["rate"]) for r in got.collect()}
    assert seen.keys() == want.keys() and all(seen[k][0] == want[k][0] and abs(seen[k][1] - want[k][1]) < 1e-9 for k in want)


def test_texts_beyond_a_segment(spark, tokenizer):
    """Texts of more than one segment (1 MiB): what stands at their ends or across a cut is found, and nothing is counted twice."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pactum.llm import chat, decontaminate, ngram_join, pii, quality, token_files, toxicity
    from pactum.llm.wordhash import SEGMENT_BYTES, TextColumn

    rng = random.Random(20)
    long = " ".join(f"w{rng.randrange(30_000)}x" for _ in range(145_000))
    assert len(long) > SEGMENT_BYTES + 50_000
    item = f"{words(rng, 20)}. {words(rng, 12)}."
    cut = long.rfind(" ", 0, SEGMENT_BYTES)
    across = f"{long[: cut - 40].rsplit(' ', 1)[0]} {item} {long[cut:]}"
    mail = f"{long} write to a@b.cd"
    docs = docs_of(spark, [long, mail, across])
    leaks = decontaminate.leaked(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["overlap"]) for r in leaks] == [(2, 1.0)]
    joined = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.join_documents(docs).collect()}
    assert joined == {k: (len(shingle_set(t)), 0, 2) for k, t in enumerate((long, mail, across))}
    spans = pii.pii_report(docs.where("doc_id = 1")).first()["spans"]
    assert spans == f"email:{len(long) + 10}:{len(mail)}"
    ids = {r["doc_id"]: r["n_tokens"] for r in token_files.token_report(docs, tokenizer).collect()}
    assert ids[1] == len(Tokenizer.from_file(tokenizer).encode(mail, add_special_tokens=False).ids) + 1
    small, labels = labelled(spark, rng, lambda t, rng: t.replace(". ", f" nasty{rng.randrange(3)}word. ", 1))
    model = toxicity.train(small, labels, lambda c: F.lit(True))
    stop = long[: cut - 400].rsplit(" ", 1)[0]
    whole = f"{stop}. {long[len(stop) + 1 : cut + 400]} nasty1word. {long[cut + 401 :]}. end"
    scored = toxicity.score(docs_of(spark, [long, whole]), model).orderBy("doc_id").collect()
    assert [r["n_sentences"] for r in scored] == [1, 4]
    span = scored[1]["offending"][0]
    assert whole[span["start"] : span["end"]] == f"{long[len(stop) + 1 : cut + 400]} nasty1word."
    assert quality.features(TextColumn(pa.array([long, long.encode()[:0].decode()])))[0, 0] == np.log1p(len(long))
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(turns)).first()["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, tokenizer):
    from tokenizers import Tokenizer

    from pactum.llm import token_files
    from pactum.llm.shared import fresh_path

    rng = random.Random(7)
    texts = odd_texts() + [words(rng, 300) for _ in range(30)] + ["a  b", " lead", "trail ", "x \n y", "it's 12 <|endoftext|> ok", "đ ằ 你好 \u00a0 z", "\n\n", "a\u00a0 b"]
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(docs_of(spark, texts, [(3, "one two", None, None, None)]), path, tokenizer)
    got = sorted(map(tuple, token_files.read_token_files(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    t, at, want = Tokenizer.from_file(tokenizer), 0, []
    for k, text in sorted([*enumerate(texts), (3, "one two")], key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((at, k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_document(spark, path, 10) == [[*t.encode(texts[10], add_special_tokens=False).ids, 2]]
    assert token_files.token_report(docs_of(spark, ["x"]).limit(0), tokenizer).count() == 0


def test_added_tokens_beside_accents(tokenizer):
    """An added token is found in any chunk, ASCII or not, as the tokenizer itself finds it."""
    from pathlib import Path

    from tokenizers import Tokenizer

    from pactum.llm.token_files import ChunkEncoder

    whole, own = Tokenizer.from_file(tokenizer), ChunkEncoder(Path(tokenizer).read_text(encoding="utf-8"))
    texts = ["a café<|endoftext|>", "a b é\n<|endoftext|> c", "é <|endoftext|>é x", "a <|endoftext|>", "<|endoftext|> é", "a café <|endoftext| >", "a b"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    token = whole.token_to_id("<|endoftext|>")
    assert token is not None and [token in ids for ids in want] == [True] * 5 + [False] * 2


def test_letters_before_marks_are_remembered(tokenizer):
    """The model is asked once for letters, whatever mark or line feed follows them, and ids are the tokenizer's own."""
    from pathlib import Path

    from tokenizers import Tokenizer

    from pactum.llm import token_files

    whole, own = Tokenizer.from_file(tokenizer), token_files.ChunkEncoder(Path(tokenizer).read_text(encoding="utf-8"))
    asked, model = [], own.model

    class Asked:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    own.model = Asked()
    texts = ["x deséoiench deséoiench, deséoiench. (deséoiench) deséoiench.\nHeeror deséoiench;\nHeeror", "x Heeror Heeror! Heeror? Heeror: don't don' 12, 12. ., !! a.b. ½. đ. 你好. ǅ, ª: \u0345. \u0301!"]
    texts += ["x " + "long" * 40 + ". " + "long" * 40 + "," , "a .", "a. b.", "a , b"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts[::-1])] == want[::-1]
    assert sum("Heeror" in p for p in asked) == 2 and sum("oiench" in p for p in asked) == 2


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    from pactum.llm import pii

    rng = random.Random(8)
    texts = odd_texts() + ["".join(rng.choice("ab1.@+- ()9é0\n") for _ in range(400)) for _ in range(60)]
    texts += ["a@b.c+d@e.f x@y.z-", "1.2.3.4.5.6.7.8 000255.1.1.256 10.0.0.255", "4111 1111 1111 1111, 4111-1111-1111-1112", "IBAN DE89 3704 0044 0532 0130 00.", "call 415-555-1234", "9" * 30000, "a.b" * 9000, "q@r.s " * 700]
    got = {r["doc_id"]: r for r in pii.pii_report(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d), "phone": lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15}
        base = {kind: [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok[kind](m[0])] for kind, p in PATTERNS.items()}
        every = [s for kind in PATTERNS for s in base[kind]]
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [len(base[kind]) for kind in PATTERNS], t[:80]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(every).encode()).hexdigest()
        assert got[k]["spans"].split(",")[: len(every)] == (every or [""])[: len(every)]
    n = len(texts)
    assert "iban:5:32" in got[n - 5]["spans"] and "local_phone:5:17" in got[n - 4]["spans"]


def test_urls(spark):
    from pactum.llm.url_filter import judge_urls

    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), (None, "/", "block"), ("", "/", "block"), ("com", "/", "allow")]
    urls = [None, "", "nothing", "http://", "https://WWW.Example.com/en/x?q#f", "https://a.www.example.com/en/", "http://example.com/en", "http://example.com/en/?", "http://a.net/esx", "http://com/", "http://xcom/", "x://a.b.com", "http://" + "a." * 20000 + "com/" + "p/" * 9000, "http://example.com/en/"]
    pages = spark.createDataFrame([*enumerate(urls), (4, urls[4])], "page_id long, url string").withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow")

    want = sorted(str((k, *judge(u))) for k, u in [*enumerate(urls), (4, urls[4])])
    for limit in (1 << 20, 0):
        got = judge_urls(pages, table, broadcast_bytes=limit).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_pipeline(spark):
    import corpus_pipeline
    from pactum.llm.shared import stash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, seen = {r["doc_id"] for r in docs.select("doc_id").collect()}, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stash(stage(spark, docs, sf), "test-stage")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or k == 4
    assert ids > seen[0] > seen[1] >= seen[2] == seen[3] == seen[4]


@pytest.mark.parametrize("names", [None, 3])
def test_near_duplicate_stage_on_shared_ids(spark, monkeypatch, names):
    """Against brute force where doc_ids are shared or null: one row of each group of linked texts stays, unique texts always;
    also where different rows are given the same few names."""
    import corpus_pipeline

    if names:
        monkeypatch.setattr(corpus_pipeline, "row_name", lambda: F.pmod(F.xxhash64("doc_id", "text"), F.lit(names)))

    rng = random.Random(14)
    texts = [words(rng, 80) for _ in range(8)]
    near = lambda t: t + " " + words(rng, 2)
    pairs = [(1, texts[0]), (5, texts[0]), (5, texts[1])]
    pairs += [(7, texts[2]), (7, near(texts[2])), (7, texts[2])]
    pairs += [(None, texts[3]), (None, near(texts[3])), (None, texts[3])]
    pairs += [(None, texts[4]), (9, near(texts[4])), (8, texts[5]), (None, texts[6]), (12, None), (13, ""), (14, "")]
    sets = [shingle_set(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in pairs], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    least = lambda i: (i is None, i or 0)
    for g in set(group):
        members = [p for p, x in zip(pairs, group, strict=True) if x == g]
        stay = [p for p in got if p in members]
        assert len(stay) == 1 and least(stay[0][0]) == min(least(i) for i, _ in members)
    assert len(got) == len(set(group)) and (5, texts[1]) in got


def test_stages_against_operators_and_order(spark):
    """Quality keeps what the classifier keeps, decontamination what holds no item, and mixing orders rows by the mix."""
    import corpus_pipeline
    from pactum.llm import decontaminate, mixing, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.keep_good(spark, docs, sf)) == ids(quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep"))
    bad = set(ids(decontaminate.leaked(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))))
    assert bad and ids(corpus_pipeline.keep_unleaked(spark, docs, sf)) == [k for k in ids(docs) if k not in bad]
    mixed = [r["doc_id"] for r in corpus_pipeline.in_mixed_order(spark, docs, sf).collect()]
    assert mixed == [r["doc_id"] for r in mixing.mix(docs).orderBy("position").collect()]


def test_names_of_rows(spark, monkeypatch):
    """Rows share a name only if doc_id and text are the same, nulls and empty texts apart, however few names there are at first."""
    import corpus_pipeline

    pairs = [(k % 40, f"t{k % 60}") for k in range(400)] + [(None, None), (None, ""), (1, None), (1, ""), (None, None), (None, "-"), (1, "1:+")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in pairs], DOCS)
    for few in (1, 7, None):
        if few:
            monkeypatch.setattr(corpus_pipeline, "row_name", lambda few=few: F.pmod(F.xxhash64("doc_id", "text"), F.lit(few)))
        else:
            monkeypatch.undo()
        named, several = corpus_pipeline.named_rows(docs)
        got = named.select("_key", "doc_id", "text").distinct().collect()
        assert len(got) == len({r["_key"] for r in got}) == len(set(pairs)) and named.count() == len(pairs)
        twice = {r["_key"] for r in several.collect()}
        assert {(r["doc_id"], r["text"]) for r in got if r["_key"] in twice} == {p for p in pairs if pairs.count(p) > 1}


def test_stages_by_hand(spark, tokenizer):
    """Quality, mixing and token stages against versions that share no code with them but the trained document scores."""
    from fractions import Fraction
    from math import exp, log

    import corpus_pipeline
    from pactum.llm import quality
    from pactum.llm.shared import stash
    from tokenizers import Tokenizer

    sf, rng = "/root/testdata/sf0.001", random.Random(31)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(docs, labels).select("doc_id", "source", "lang", "doc_score").collect()
    said = {r["doc_id"]: r["quality"] for r in labels.collect()}
    host, site = {}, {}
    for r in scored:
        for table, key in ((host, r["source"]), (site, (r["source"], r["lang"]))):
            n, good = table.get(key, (0, 0))
            table[key] = (n + (r["doc_id"] in said), good + said.get(r["doc_id"], 0))
    total, good = sum(n for n, _ in host.values()), sum(g for _, g in host.values())
    base = (good + 1) / (total + 2)

    def strength(table, mean):
        used = [(n, g, mean(key)) for key, (n, g) in table.items() if n]
        weight = sum(n for n, _, _ in used)
        between = max((sum((g / n - m) ** 2 * n for n, g, m in used) - sum(m * (1 - m) for _, _, m in used)) / weight, 1e-9)
        return min(max(sum(m * (1 - m) for _, _, m in used) / len(used) / between - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    s = strength(host, lambda _: base)
    rate = {h: (g + s * base) / (n + s) for h, (n, g) in host.items()}
    s = strength(site, lambda key: rate[key[0]])
    logit = lambda p: log(min(max(p, 1e-6), 1 - 1e-6)) - log(1 - min(max(p, 1e-6), 1 - 1e-6))
    trained = quality.train(docs, labels)["base"]
    want = set()
    for r in scored:
        n, g = site[r["source"], r["lang"]]
        odds = logit(r["doc_score"]) - logit(trained) + logit((g + s * rate[r["source"]]) / (n + s))
        if 1 / (1 + exp(-odds)) >= quality.THRESHOLD:
            want.add(r["doc_id"])
    kept = stash(corpus_pipeline.keep_good(spark, docs, sf), "test-good")
    assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()

    texts = [words(rng, 1 + k % 30) for k in range(2000)]
    source = [rng.choice("aaaaabbcd") for _ in texts]
    table = spark.createDataFrame([(k, t, "en", source[k], 1) for k, t in enumerate(texts)], DOCS)
    sizes = {x: source.count(x) for x in "abcd"}
    plan = schedule_by_hand([(x, -(-n // 64), Fraction((n / 2000) ** 0.7)) for x, n in sizes.items()])
    order = "".join(x * min(64, sizes[x] - 64 * block) for x, block, *_ in plan)
    mixed = stash(corpus_pipeline.in_mixed_order(spark, table.repartition(5), ""), "test-mix")
    got = corpus_pipeline.to_token_files(spark, mixed, "", tokenizer).orderBy("start").collect()
    assert "".join(source[r["doc_id"]] for r in got) == order and sorted(r["doc_id"] for r in got) == list(range(2000))
    encoder, at = Tokenizer.from_file(tokenizer), 0
    for r in got:
        ids = [*encoder.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_keep_the_mix(spark, tokenizer):
    """The last stage writes ids in the order in which the stage before left the rows."""
    import corpus_pipeline
    from pactum.llm.shared import stash

    rng = random.Random(15)
    docs = docs_of(spark, [words(rng, 1 + k % 40) for k in range(300)])
    mixed = stash(corpus_pipeline.in_mixed_order(spark, docs.repartition(7), ""), "test-mix")
    want = [r["doc_id"] for r in corpus_pipeline.in_mixed_order(spark, docs, "").collect()]
    got = corpus_pipeline.to_token_files(spark, mixed, "", tokenizer).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == want != sorted(want)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    unstored = corpus_pipeline.to_token_files(spark, docs, "", tokenizer).orderBy("start").collect()
    assert [r["doc_id"] for r in unstored] == list(range(300))


CLASHING = ("_host", "_path", "_rate", "rate", "labelled", "doc_score", "site_rate", "quality_score", "keep", "_label", "score", "n_sentences", "offending", "_leaks", "leaks", "item_id", "_id", "_position", "position", "count", "component_id", "column_0", "a.b", "vec_id", "pii", "_body", "n", "tie", "shard")


def clashing(df, but=()):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING if c not in but])


def rows(df):
    return sorted(map(str, df.collect()))


def test_clashing_columns(spark, tokenizer):
    """Further columns change no result and, where rows pass through, keep their values; results replace columns of their name."""
    from pactum.llm import chat, decontaminate, mixing, ngram_join, pii, quality, token_files, toxicity, vector_dedup

    docs, labels = labelled(spark, random.Random(9), lambda t, rng: t.upper().replace(" ", "!! nasty "))
    bench = spark.createDataFrame([(1, words(random.Random(9), 40, 300)), (2, None)], "item_id long, text string")
    wide, wide_labels, wide_bench = clashing(docs), clashing(labels), clashing(bench, ("item_id",))
    plain = (ngram_join.join_documents, mixing.mix, pii.pii_report, lambda d: token_files.token_report(d, tokenizer), lambda d: decontaminate.leaked(d, bench))
    for operator in plain:
        assert rows(operator(wide)) == rows(operator(docs))
    assert rows(decontaminate.leaked(wide, wide_bench)) == rows(decontaminate.leaked(docs, bench))
    kept = decontaminate.remove_leaked(wide, wide_bench)
    assert kept.columns == wide.columns and kept.first()["_leaks"] == "own _leaks"
    result = ("doc_id", "doc_score", "site_rate", "quality_score", "keep")
    scored = quality.classify(wide, wide_labels)
    assert rows(scored.select(*result)) == rows(quality.classify(docs, labels).select(*result)) and scored.first()["_host"] == "own _host"
    keep = lambda c: c % 5 != 0
    result = ("doc_id", "score", "n_sentences", "offending")
    scored = toxicity.score(wide, toxicity.train(wide, wide_labels, keep))
    assert rows(scored.select(*result)) == rows(toxicity.score(docs, toxicity.train(docs, labels, keep)).select(*result)) and scored.first()["keep"] == "own keep"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert rows(vector_dedup.dedup_vectors(clashing(vectors, ("vec_id",)))) == rows(vector_dedup.dedup_vectors(vectors))
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    digests = lambda t: rows(chat.conversation_digests(chat.format_conversations(t)))
    assert digests(clashing(turns)) == digests(turns)


def test_empty_tables(spark, tokenizer):
    from pactum.llm import chat, pii, quality, toxicity, url_filter, vector_dedup

    docs = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 0 == pii.pii_report(docs).count()
    assert toxicity.score(docs, toxicity.train(docs, labels, lambda c: F.lit(True))).count() == 0
    assert vector_dedup.dedup_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


def test_stages_on_odd_documents(spark, tokenizer):
    """Every stage takes nulls in any column, odd texts, repeated rows, clashing columns and empty tables; other columns keep their values."""
    import corpus_pipeline
    from pactum.llm.shared import stash

    sf = "/root/testdata/sf0.001"
    rng = random.Random(10)
    texts = odd_texts() + [words(rng, 60) for _ in range(12)]
    extra = [(None, texts[9], None, None, None), (None, None, None, None, None), (9, texts[9], "en", "src0", 1), (9, texts[10], None, None, None)]
    odd = docs_of(spark, texts, extra)
    wide = clashing(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stash(stage(spark, wide, sf), "test-odd")
        bare = stash(stage(spark, odd, sf), "test-odd")
        if k == 4:
            assert rows(got) == rows(bare) and got.count() == odd.count()
            continue
        assert got.columns == wide.columns and rows(got.select(*odd.columns)) == rows(bare), name
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHING), name
        if name in ("decontamination", "mixing"):
            assert rows(bare) == rows(odd)
        assert stage(spark, wide.limit(0), sf).count() == 0, name


@pytest.mark.parametrize("name", ["op4_ngram_join", "op5_vector_dedup"])
def test_pair_queries_match_sql(spark, name):
    import duckdb

    from pactum.llm import catalog

    sf, other = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings"):
        other.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    twin = other.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, sf).select(*twin.columns).collect()
    assert sorted(map(tuple, got)) == sorted(twin.fetchall())
