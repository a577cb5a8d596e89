"""Benchmark decontamination: a BM25 index of test items, every training passage a query, whole overlap verified.

Items (the bounded side) are indexed as inverted lists: for each term the items
that hold it, in order, with their impacts (BM25 weights), cut into blocks of
consecutive items with the largest impact of each.  A document's distinct
terms, from anywhere in it, are one query.  Its longest lists come first up to
a pivot: all their largest impacts together stay below the least threshold, so
an item that stands in no list beyond the pivot can't reach its own, and the
lists before the pivot open no block.  The block maxima of the lists beyond it,
and the largest impacts of those before, bound the scores of each block they
touch; only blocks whose bound reaches the least threshold in them are opened
and scored exactly, over all lists.  All items that reach their own threshold
are retrieved.  That is an item's whole score less the most that it can lose
while enough of its shingles remain to be a leak, so retrieval leaves out
nothing that verification would keep.

Retrieval proposes; an item counts as leaked if at least OVERLAP of the
distinct 5-word shingles of its question and of its answer (its last sentence), or of the item as
a whole, occur in the document.  Words are compared lower-cased
(A-Z) and without ASCII punctuation.

Null or wordless texts, on either side, match nothing, and neither do null
item_ids; an empty table on either side gives no rows.  Repeated rows each get
their own result, and items that tie are told in order of item_id.  An item
under five words is one shingle, its whole sequence.  Very long texts are
queried as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import free_name, with_computed
from pactum.llm.wordhash import TextColumn, shingles, word_hashes

WIDTH, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Words of documents that are queried together.
AT_ONCE = 100_000
#: Items in a block; bytes of items' texts in one index; share of the least threshold before the pivot.
BLOCK_ITEMS, INDEX_BYTES, PIVOT = 8, 8 << 20, 0.5
#: Sums of bounds that are laid out as a table of texts and blocks at most; larger ones are sorted.
CELLS = 1 << 22
LEAKS = "item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"


def _parts(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last; a single sentence is both."""
    import re

    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text.strip())]
    body = text.strip()
    return (body[: cut[-1]], body[cut[-1] :]) if cut else (body, body)


def may_miss(words: np.ndarray, distinct: int) -> int:
    """How many distinct terms of a part can be missing where at least OVERLAP of its distinct shingles are present.

    Positions of k different terms lie in at least k shingles (or in all).
    Where shingles repeat, each term still ends a shingle of its own where it
    first stands, but for those that stand among the first four words.
    """
    lost = int((1 - OVERLAP) * distinct + 1e-9)
    return lost + WIDTH - 1 if lost and distinct < len(words) - WIDTH + 1 else lost


class Corpus:
    """Items, mean length and items per term of a whole benchmark, from which all its indexes take their weights."""

    def __init__(self):
        self.n, self.words, self.terms, self.df = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        words = [w for _, w in word_hashes(texts, loose=True) if len(w)]
        if words:
            self.n, self.words = self.n + len(words), self.words + sum(map(len, words))
            terms, df = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
            every, at = np.unique(np.concatenate((self.terms, terms)), return_inverse=True)
            self.terms, self.df = every, np.bincount(at, weights=np.concatenate((self.df, df)), minlength=len(every)).astype(np.int64)


class Index:
    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        texts = [t or "" for _, t in items]
        words = [w for _, w in word_hashes(texts, loose=True)]
        sound = [k for k, w in enumerate(words) if len(w)]
        # long items by long ones, so that thresholds in a block are alike
        sound.sort(key=lambda k: (len(words[k]), k))
        self.ids = np.array([items[k][0] for k in sound], dtype=np.int64)
        own_words = [words[k] for k in sound]
        self.whole = [np.unique(shingles(w, WIDTH)) for w in own_words]
        parts = [_parts(texts[k]) for k in sound]
        asked = [w for _, w in word_hashes([p[0] for p in parts], loose=True)]
        told = [w for _, w in word_hashes([p[1] for p in parts], loose=True)]
        self.question, self.answer = ([np.unique(shingles(w, WIDTH)) for w in part] for part in (asked, told))
        n = len(sound)
        self.terms = np.unique(np.concatenate([np.unique(w) for w in own_words])) if n else np.zeros(0, np.uint64)
        self.least = np.zeros(n)
        if not n:
            return
        if corpus is None:
            corpus = Corpus()
            corpus.add(texts)
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (corpus.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * np.array([len(w) for w in own_words]) * corpus.n / corpus.words)
        lists = []
        for k, w in enumerate(own_words):
            t, tf = np.unique(w, return_counts=True)
            at = np.searchsorted(self.terms, t)
            impact = tf * (K1 + 1) / (tf + norm[k]) * idf[at]
            lists.append((at, np.full(len(at), k), impact))

            def most(part, held, t=t, impact=impact):
                """The most that can be missing of the score where a part overlaps enough."""
                at = np.searchsorted(t, np.unique(part))
                return float(np.sort(impact[at])[::-1][: may_miss(part, len(held))].sum())

            lost = most(w, self.whole[k])
            if len(asked[k]) and len(told[k]):
                lost = max(lost, most(asked[k], self.question[k]) + most(told[k], self.answer[k]))
            # a little less, since sums may differ in their last places
            whole = float(impact.sum())
            self.least[k] = max(0.0, whole - lost - 1e-6 * whole)
        term, self.item, self.impact = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.lexsort((self.item, term))
        term, self.item, self.impact = term[order], self.item[order].astype(np.int32), self.impact[order]
        # blocks of each list: where they begin among all postings, which items they are of, their largest impacts
        block = self.item // BLOCK_ITEMS
        head = np.ones(len(term), dtype=bool)
        head[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.begin = np.append(np.flatnonzero(head), len(term))
        self.block, self.block_max = block[head], np.maximum.reduceat(self.impact, self.begin[:-1])
        self.list_begin = np.searchsorted(term[head], np.arange(len(self.terms) + 1))
        self.list_max = np.maximum.reduceat(self.block_max, self.list_begin[:-1])
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, n, BLOCK_ITEMS))
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def bytes(self) -> int:
        """Memory of the lists and of the items' shingles."""
        arrays = (self.terms, self.item, self.impact, self.begin, self.block, self.block_max, self.known, *self.whole, *self.question, *self.answer)
        return sum(a.nbytes for a in arrays)

    def _asked(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct terms of the index: (text, term), in order."""
        none = np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts])
        words = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint64)
        if not len(self.ids) or not len(words):
            return none, none
        maybe = np.flatnonzero(self.known[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == words[maybe]
        place, term = maybe[hit], at[hit]
        pairs = np.sort(np.searchsorted(np.cumsum(sizes), place, side="right") * len(self.terms) + term)
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        return pairs // len(self.terms), pairs % len(self.terms)

    def _before_pivot(self, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of each text's lists, the longest ones whose largest impacts sum up to less than a share of the least threshold."""
        order = np.lexsort((-(self.list_begin[term + 1] - self.list_begin[term]), text))
        total = np.cumsum(self.list_max[term[order]])
        first = np.flatnonzero(np.diff(text[order], prepend=-1))
        before = np.repeat(np.concatenate(([0.0], total[first[1:] - 1])), np.diff(np.append(first, len(text))))
        out = np.zeros(len(text), dtype=bool)
        out[order] = total - before < PIVOT * self.least.min()
        return out

    def retrieve(self, texts: list[np.ndarray]) -> list[dict[int, float]]:
        """For each text the score of every item that reaches its threshold in it."""
        out: list[dict[int, float]] = [{} for _ in texts]
        text, term = self._asked(texts)
        if not len(text):
            return out
        # many long lists: some texts at a time
        if len(texts) > 1 and (self.list_begin[term + 1] - self.list_begin[term]).sum() > 4 * CELLS:
            half = len(texts) // 2
            return self.retrieve(texts[:half]) + self.retrieve(texts[half:])
        light = self._before_pivot(text, term)
        spare = np.bincount(text, weights=np.where(light, self.list_max[term], 0.0), minlength=len(texts))
        blocks = len(self.block_least)
        of, entry = _ranges(self.list_begin, term[~light])
        keys, bound = _sums(text[~light][of] * blocks + self.block[entry], self.block_max[entry], len(texts) * blocks)
        opened = keys[bound + spare[keys // blocks] >= self.block_least[keys % blocks] * (1 - 1e-9)]
        if not len(opened):
            return out
        # all lists of the texts that open a block, and in them the opened blocks alone
        some = np.isin(text, opened // blocks)
        text, term = text[some], term[some]
        of, entry = _ranges(self.list_begin, term)
        key = text[of] * blocks + self.block[entry]
        at = np.minimum(np.searchsorted(opened, key), len(opened) - 1)
        hit = opened[at] == key
        of, entry = of[hit], entry[hit]
        back, posting = _ranges(self.begin, entry)
        n = len(self.ids)
        keys, score = _sums(text[of[back]] * n + self.item[posting], self.impact[posting], len(texts) * n)
        enough = score >= self.least[keys % n]
        for t, k, x in zip((keys // n)[enough].tolist(), (keys % n)[enough].tolist(), score[enough].tolist(), strict=True):
            out[t][k] = x
        return out

    def leaks(self, texts: list[np.ndarray]):
        """Yield for each text (its word hashes) the items that leaked into it."""
        for words, found in zip(texts, self.retrieve(texts), strict=True):
            have = np.unique(shingles(words, WIDTH)) if found and len(words) >= WIDTH else None
            out = []
            if have is not None and len(found) > 1:
                found = self._likely(found, have)
            for item, score in sorted(found.items(), key=lambda x: self.ids[x[0]]):
                share = [self._share(s, have, words) for s in (self.whole[item], self.question[item], self.answer[item])]
                if share[0] >= OVERLAP or min(share[1:]) >= OVERLAP:
                    out.append({"item_id": int(self.ids[item]), "bm25": score, "overlap": share[0], "question_overlap": share[1], "answer_overlap": share[2]})
            yield out

    def _likely(self, found: dict[int, float], have: np.ndarray) -> dict[int, float]:
        """Those retrieved items of which the document has any shingle, or that are one shingle themselves; one look-up for all."""
        items = list(found)
        wanted = np.concatenate([self.whole[k] for k in items])
        hit = have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] == wanted
        begin = np.concatenate(([0], np.cumsum([len(self.whole[k]) for k in items])[:-1]))
        some = np.logical_or.reduceat(hit, begin)
        short = [min(map(len, (self.whole[k], self.question[k], self.answer[k]))) <= 1 for k in items]
        return {k: found[k] for k, yes, single in zip(items, some, short, strict=True) if yes or single}

    def _share(self, wanted: np.ndarray, have, words: np.ndarray) -> float:
        if not len(wanted):
            return 0.0
        if have is not None:
            hits = np.isin(wanted, have).sum()
            if len(wanted) == 1 and not hits:
                # perhaps a sequence under five words, which is one shingle of its own length
                hits = any(np.isin(wanted, shingles_of(words, k)).any() for k in range(1, WIDTH))
            return float(hits) / len(wanted)
        return float(any(np.isin(wanted, shingles_of(words, k)).any() for k in range(1, WIDTH)))


def _ranges(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges begin[w] to begin[w + 1]: the place in `which` that each number belongs to, and the number."""
    size = begin[which + 1] - begin[which]
    of = np.repeat(np.arange(len(which)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[which], size)


def _sums(keys: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their (positive) values."""
    if limit <= CELLS:
        total = np.bincount(keys, weights=values, minlength=1)
        found = np.flatnonzero(total)
        return found, total[found]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else np.zeros(0)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    return shingles(words, k) if len(words) >= k else np.zeros(0, np.uint64)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """docs with a column of leaked items: array<struct<item_id, bm25, overlap, question_overlap, answer_overlap>>.

    Up to INDEX_BYTES of items are one index.  Every task gets all of them and puts each group of documents, whose words
    are hashed once, to one after another in the same stage; all take their weights from the whole benchmark, so results
    don't depend on how many there are.  The driver holds one index at a time and the benchmark's distinct terms; a
    worker holds all indexes, some ten times the bytes of the items.  A column named like `out` is replaced, others stay.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // INDEX_BYTES))
    shares = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]
    corpus = Corpus()
    for share in shares:
        corpus.add([r["text"] for r in share.collect()])
    context = docs.sparkSession.sparkContext
    indexes = [context.broadcast(Index(sorted((r["item_id"], r["text"]) for r in share.collect()), corpus)) for share in shares]
    return with_computed(docs, f"{out} array<struct<{', '.join(f.replace(' ', ':') for f in LEAKS.split(', '))}>>", _scanner(indexes, text))


def _scanner(indexes: list, text: str):
    def start():
        import pyarrow as pa

        kind = pa.list_(pa.struct([(f.split()[0], pa.int64() if f.endswith("long") else pa.float64()) for f in LEAKS.split(", ")]))

        def told(held: list) -> list[list[dict]]:
            """What leaked into each of a group of documents, over all indexes, in order of item_id."""
            found = [list(own.value.leaks(held)) for own in indexes]
            return found[0] if len(found) == 1 else [sorted((x for part in each for x in part), key=lambda x: x["item_id"]) for each in zip(*found, strict=True)]

        def scan(batch):
            out, held, size = [], [], 0
            for _, words in word_hashes(TextColumn(batch.column(text)), loose=True):
                held.append(words)
                size += len(words)
                if size >= AT_ONCE:
                    out += told(held)
                    held, size = [], 0
            out += told(held)
            return [pa.array(out, kind)]

        return scan

    return start


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that leaked into it: doc_id, item_id, bm25 and overlaps."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def remove_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns as before."""
    out = free_name(docs, "_leaks")
    return with_leaks(docs, benchmark, out=out).where(F.size(out) == 0).drop(out)
