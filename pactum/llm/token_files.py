"""Token ids in block files: one zstandard frame per document, a shared dictionary, an offset index in every block.

The file format is a folder in the shared store with two Parquet tables that
any Hadoop file system can hold and whose writers commit per task:

- dictionary: one row, the zstandard dictionary and its SHA-256.  It is trained on the first DICTIONARY_IDS ids
  of about DICTIONARY_DOCS documents picked by hash; the files hold every id of every document;
- blocks: shard, block, dictionary hash, id width, first token, and for the
  documents in the block their doc_ids, token counts and frame offsets into
  `payload`, the concatenated frames.  One document is read by its block's
  index columns and one slice of the payload.

Shards follow ascending doc_id, or another order that is given.  A frame holds one document's ids as
little-endian unsigned integers, 16 bits wide when the vocabulary allows.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import broadcast_if_small, fresh_path
from pactum.llm.wordhash import worker_memory

#: The dictionary is trained on at most so many documents and ids of each; it is a model, the files hold every id.
DICTIONARY_DOCS, DICTIONARY_IDS, DICTIONARY_BYTES = 1024, 2048, 64 << 10
#: A block is closed when its frames reach this size.
BLOCK_BYTES = 1 << 20
#: Texts are encoded about so many characters at a time.
ENCODE_CHARS = 1 << 21
#: Chunks remembered with their ids in one worker, and the longest that are.
CACHE_CHUNKS, CACHE_CHARS = 1_200_000, 14
#: Pieces remembered that don't begin with a space, such as letters after a line feed.
CACHE_PIECES = 100_000
#: One of these after letters is a piece of its own.
MARKS = frozenset(".,;:!?")
#: Letters before this are the same in all recent versions of Unicode.
LETTERS_END = "\u0530"
#: White space other than spaces and line feeds.
OTHER_SPACES = tuple(chr(k) for k in range(0x3001) if chr(k).isspace() and chr(k) not in " \n")


class ChunkEncoder:
    """The tokenizer's own ids for whole texts, with a memory for the chunks between single spaces.

    The vocabulary's splitting never joins a character to a single space after
    it, so a text whose spaces all stand between other characters is the
    concatenation of its chunks (a space and what follows it).  A new chunk is
    split by the vocabulary's own pattern and its pieces go to the tokenizer's
    model, if they aren't remembered: letters after a space are a chunk by
    themselves, whatever mark follows them.  Texts with other white space
    beside a space are encoded whole, as are texts that hold an added token
    anywhere.
    """

    def __init__(self, spec: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        pre = parsed.get("pre_tokenizer") or {}
        self.chunked = parsed.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {x["content"]: x for x in parsed.get("added_tokens", [])}
        self.chunked &= not any(" " in c or x.get("lstrip") or x.get("rstrip") for c, x in added.items())
        self.added = tuple(added)
        self.spaced = regex.compile(r"\s | \s| \Z")
        # fixed value: the splitting pattern of byte-level vocabularies
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.memory, self.model = ChunkMemory(self._chunk), self.tokenizer.model
        # how byte-level vocabularies write bytes: printable ones as themselves, the others as characters from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        self.characters = {k: chr(k) if k in own else chr(next(others)) for k in range(256)}
        self.space, self.short = self.characters[32], {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of what the vocabulary's splitting leaves in one piece: the model takes it as it is."""
        return self._packed(self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters)))

    def _packed(self, tokens) -> bytes:
        return array("I", [t.id for t in tokens]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and a chunk; scripts whose classes depend on the Unicode version go through the whole tokenizer."""
        if chunk.isascii():
            if chunk.isalpha():
                return self._packed(self.model.tokenize(self.space + chunk))
        elif max(chunk) >= LETTERS_END:
            return self._alone([f" {chunk}"])[0]
        elif chunk.isalpha():
            return self._piece(f" {chunk}")
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            mark = chunk[-1]
            return self.memory[chunk[:-1]] + (self.short[mark] if mark in self.short else self._remember(mark))
        return b"".join([self.short[x] if x in self.short else self._remember(x) for x in self.pattern.findall(f" {chunk}")])

    def _remember(self, piece: str) -> bytes:
        if len(piece) > 2 and piece[0] == " " and piece[1:].isalpha():
            return self.memory[piece[1:]]
        ids = self._piece(piece)
        if len(piece) <= 2 or piece[0] != " " and len(piece) <= CACHE_CHARS and len(self.short) < CACHE_PIECES:
            self.short[piece] = ids
        return ids

    def _simple(self, text: str) -> bool:
        """Whether all spaces stand between other characters than white space, and no added token is in the text."""
        if any(x in text for x in self.added):
            return False
        if any(x in text for x in OTHER_SPACES):
            return self.spaced.search(text) is None
        return not (text.endswith(" ") or "  " in text or " \n" in text or "\n " in text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        parts = [t.split(" ") if self.chunked and self._simple(t) else [t] for t in texts]
        heads = self._alone([p[0] for p in parts])
        for p in parts:
            del p[0]
        known = self.memory.__getitem__
        out = [head + b"".join(map(known, p)) for head, p in zip(heads, parts, strict=True)]
        self.memory.forget()
        return out


class ChunkMemory(dict):
    """Ids by chunk, made when first asked for; long chunks, which rarely come again, are kept for a while only."""

    def __init__(self, make):
        self.make, self.long = make, []

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.make(chunk)
        if len(chunk) > CACHE_CHARS:
            self.long.append(chunk)
        return ids

    def forget(self) -> None:
        for c in self.long:
            del self[c]
        self.long.clear()
        if len(self) > CACHE_CHUNKS:
            self.clear()


def _tokenizer_spec(path: str) -> str:
    """The vocabulary file, read once by the driver and sent along, so executors need no local copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoder(spec: str) -> ChunkEncoder:
    """One per worker process, with what it has learnt."""
    memory, key = worker_memory(), f"encoder {hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in memory:
        memory[key] = ChunkEncoder(spec)
    return memory[key]


def _encoded(texts, encoder: ChunkEncoder, end_id: int | None):
    """Yield an array of ids per text, about ENCODE_CHARS at a time."""
    import numpy as np

    held, size = [], 0

    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def flush():
        for ids in encoder.encode(held):
            yield np.frombuffer(ids + tail, dtype="<u4")

    for t in texts:
        held.append(t)
        size += len(t)
        if size >= ENCODE_CHARS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def train_dictionary(docs: DataFrame, spec: str, end_id: int | None, n_rows: int) -> bytes:
    """A dictionary from the ids of a bounded set of documents picked by hash; b'' if there are too few to train on."""
    import zstandard

    share = min(1.0, DICTIONARY_DOCS / max(1, n_rows))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("text")

    def ids(batches):
        import pandas as pd

        encoder = _encoder(spec)
        dtype = "<u2" if encoder.size <= 1 << 16 else "<u4"
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            yield pd.DataFrame({"ids": [a[:DICTIONARY_IDS].astype(dtype).tobytes() for a in _encoded(texts, encoder, end_id)]})

    rows = picked.mapInPandas(ids, "ids binary").limit(2 * DICTIONARY_DOCS).collect()
    samples = sorted(bytes(r["ids"]) for r in rows)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


BLOCKS = "shard int, block int, dictionary_sha256 string, width int, first_token long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, order: tuple = ("doc_id",)) -> None:
    """Encode every whole text into block files under `path`, in ascending order of doc_id or of the columns in `order`.

    Null text counts as empty; nulls come first in the order; rows that tie in
    it follow by doc_id and a hash of their text.  Very long texts are encoded
    whole, and one makes a block of its own.  An empty table gives an empty
    folder of blocks.  Further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    spec = _tokenizer_spec(tokenizer_path)
    keys = [f"_o{k}" for k in range(len(order))]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys, strict=True)])
    dictionary = train_dictionary(docs, spec, end_id, docs.count())
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((spec, dictionary))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys, "doc_id", "tie").sortWithinPartitions(*keys, "doc_id", "tie").select("doc_id", "text")

    def pack(batches):
        import numpy as np
        import pandas as pd
        import zstandard
        from pyspark import TaskContext

        spec, dictionary = shared.value
        encoder, shard = _encoder(spec), TaskContext.get().partitionId()
        dtype = "<u2" if encoder.size <= 1 << 16 and (end_id or 0) < 1 << 16 else "<u4"
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        block, first, ids, counts, frames, size = 0, 0, [], [], [], 0
        names = [x.split()[0] for x in BLOCKS.split(", ")]

        def closed():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.int64)))
            row = (shard, block, digest, np.dtype(dtype).itemsize, first, pd.array(ids, dtype="Int64").to_numpy(dtype=object, na_value=None), np.array(counts, dtype=np.int64), offsets, b"".join(frames))
            return pd.DataFrame({n: [v] for n, v in zip(names, row, strict=True)})

        for batch in batches:
            doc_ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for doc, a in zip(doc_ids, _encoded(batch["text"], encoder, end_id), strict=True):
                ids.append(doc)
                counts.append(len(a))
                frames.append(squeeze.compress(a.astype(dtype).tobytes()))
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield closed()
                    block, first = block + 1, first + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield closed()

    ordered.mapInPandas(pack, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, dictionary_sha256 string, bytes long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the files: its first id's place among all ids, token count, CRC-32 of the ids."""
    # only now is the dictionary's own hash checked against what the blocks name
    stored = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = stored["sha256"], bytes(stored["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary doesn't have the hash it is stored under")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row per shard, that is per task of the writing stage
    from pyspark.sql import Window

    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.join(broadcast_if_small(starts, 16), "shard")

    def unpack(batches):
        import numpy as np
        import pandas as pd
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.dictionary_sha256 != digest:
                    raise ValueError("a block was written with another dictionary")
                at, payload = row.shard_start + row.first_token, memoryview(row.payload)
                for doc, n, a, b in zip(row.doc_ids, row.n_tokens, row.offsets[:-1], row.offsets[1:], strict=True):
                    ids = np.frombuffer(expand.decompress(payload[int(a) : int(b)]), dtype=f"<u{row.width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError(f"document {doc}: {len(ids)} ids instead of {n}")
                    out.append((None if pd.isna(doc) else int(doc), at, len(ids), zlib.crc32(ids.tobytes()), digest, int(b - a)))
                    at += len(ids)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return placed.mapInPandas(unpack, READ)


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, order: tuple = ("doc_id",)) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32 and more, one row per row of docs."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, order)
    return read_token_files(docs.sparkSession, path)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that doc_id): block index first, then one slice of a payload."""
    import numpy as np
    import zstandard

    stored = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(stored["dictionary"])
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    found = (
        spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        .where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
        .select("width", F.explode(F.filter(F.arrays_zip("doc_ids", "n_tokens", F.slice("offsets", 1, F.size("n_tokens")).alias("a"), F.slice("offsets", F.lit(2), F.size("n_tokens")).alias("b")), lambda x: x["doc_ids"] == doc_id)).alias("x"), "payload")
        .select("width", F.substring("payload", F.col("x.a").cast("int") + 1, (F.col("x.b") - F.col("x.a")).cast("int")).alias("frame"))
    )
    return [np.frombuffer(expand.decompress(bytes(r["frame"])), dtype=f"<u{r['width']}").tolist() for r in found.collect()]
