"""Token ids in fixed-width binary blocks.

Documents are dealt into ranges of doc_id and sorted; each range is encoded, every document ends with `end_id`, and the ids
are written as blocks of BLOCK_IDS ids of `width` bits each, the least that hold the vocabulary. A document begins on a bit
of its own, not a byte. The file format: two Parquet tables in one folder, which Spark's committer writes whole or not at
all, on any file system that Spark knows.

    blocks: shard, block (number in the shard), first (ids of the shard before it), n_ids, width, payload (little-endian bits)
    index:  shard, row (place in the shard), doc_id, offset (ids of the shard before it), n_tokens

A document's ids lie at shard, offset; block = offset // BLOCK_IDS is read alone (payloads are unpacked with numpy shifts), so
random access reads one or two blocks. `start`, the ids of all documents before, is offset plus the totals of the shards
before it.

With a tokenizer of the form WORDWISE encoding goes word by word: its pre-tokenizer's pieces never hold white space, and its normalisation is
local to what stands between white space, so a text's ids are those of its words in turn. Each worker keeps the ids of up to MAX_CACHED
words; new words go to the library in batches. Words of one step (STEP bytes) are told apart by 64-bit hashes, kept words by themselves.
With any other tokenizer the library encodes whole texts.

A null text is empty: its only id is end_id. Rows without doc_id come first. Repeated rows stand side by side, each with a row of its
own. A table without rows gives tables without rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, CASED, LOWER, buffers, new_path, ship, steps, tidy, word_hashes

BLOCK_IDS = 1 << 16
MAX_CACHED = 150_000
MAX_WORD = 64
BATCH_WORDS = 4096
#: Bytes of text whose distinct words are looked up together.
STEP = 1 << 20
_loaded: dict[str, Encoder] = {}
#: Settings of a tokenizer whose texts can be encoded word by word: fixed values, as they stand in its file.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Letters that are composed already and whose lower case is one letter.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,;:!?*$%&#|")] = True
_ALPHA[97:123] = True
_COMBINING = (b"\xcc", b"\xcd")


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in width bits, least first."""
    if width == 8 or width == 16 or width == 32:
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, n: int, first: int = 0) -> np.ndarray:
    """n ids of a block from its id number first on."""
    if width == 8 or width == 16 or width == 32:
        return np.frombuffer(payload, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    lo = first * width
    raw = np.frombuffer(payload, np.uint8)[lo // 8 : (lo + n * width + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + n * width].reshape(n, width).astype(np.uint32)
    return (bits << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ids: dict[bytes, bytes] = {}  # of words
        self.wordwise = self._is_wordwise()
        # the pre-tokenizer's letters for bytes, as the library itself maps them
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(32, 256) if chr(c).isalpha()}

    def _is_wordwise(self) -> bool:
        form = json.loads(self.tokenizer.to_str())
        model = form["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        # special strings are seen by how they begin, and hold no white space
        special = all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] and not re.search(r"\s", x["content"]) for x in form["added_tokens"])
        return plain and special and all(form[k] == v for k, v in WORDWISE.items())

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of words, in their order."""
        found, rest, model, letters = [], [], self.tokenizer.model.tokenize, self.letters
        for w in new:
            word = w.decode()
            if word.isascii() and word.isalpha():
                found.append(array("I", [t.id for t in model(word.lower())]).tobytes())
            elif _LETTERS.fullmatch(word):
                found.append(array("I", [t.id for t in model(word.lower().translate(letters))]).tobytes())
            else:
                rest.append((len(found), word))
                found.append(b"")
        for lo in range(0, len(rest), BATCH_WORDS):
            some = rest[lo : lo + BATCH_WORDS]
            for (i, _), ids in zip(some, self._library([x for _, x in some]), strict=True):
                found[i] = ids
        return found

    @staticmethod
    def _segments(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), and a mark after an ASCII letter begins a word: a run of letters ends there for the pre-tokenizer, too."""
        mapped = table[data]
        is_word = mapped != 0
        cut = ~is_word
        if len(mapped):
            cut[1:] |= (_MARKS[mapped[1:]] if table is BLANK else False) & _ALPHA[mapped[:-1]] | ~is_word[:-1]
            cut[0] = True
        cut = np.append(cut, True)
        cut[offs] = True
        starts = np.flatnonzero(is_word & cut[:-1])
        ends = np.flatnonzero(is_word & (cut[1:] | ~np.append(is_word[1:], False))) + 1
        return starts, ends, np.searchsorted(starts, offs)

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For ranges of rows: their number, all their ids with end_id after each row, and the ids before each row (one more than rows)."""
        data, offs = buffers(column)
        for lo, hi in steps(offs, STEP):
            if not self.wordwise:
                ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in self._library([x.as_py() or "" for x in column[lo:hi]])]
                yield hi - lo, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                continue
            part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            text = part.tobytes()
            # lower case first where that can't change what the library does: no special strings, nothing to compose
            table = CASED if b"<|" in text or any(x in text for x in _COMBINING) else BLANK
            if table is BLANK:
                text = text.translate(LOWER)
            starts, ends, before = self._segments(part, own, table)
            distinct, first, which = np.unique(word_hashes(part, starts, ends, table), return_index=True, return_inverse=True)
            if len(self.ids) > MAX_CACHED:
                self.ids.clear()
            keys = [text[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            found = list(map(self.ids.get, keys))
            new = [i for i, x in enumerate(found) if x is None]
            for i, ids in zip(new, self._learn([keys[i] for i in new]), strict=True):
                found[i] = ids
                if len(keys[i]) <= MAX_WORD:
                    self.ids[keys[i]] = ids
            found.append(np.array([end_id], "<u4").tobytes())
            flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            where = np.insert(which, before[1:], len(distinct))
            each, begin = size[where], np.concatenate([[0], np.cumsum(size)[:-1]])
            total = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(begin[where] - total[:-1], each) + np.arange(total[-1])]
            yield hi - lo, ids, total[before + np.arange(len(before))]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


#: Rows of both tables: kind 0 has a block, 1 an entry of the index.
_ROW = "shard int, kind int, row long, first long, n_ids long, payload binary, doc_id long"
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64())])


def _writer(tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own = TaskContext.get().partitionId(), encoder(tokenizer)
        total, row, block, rest = 0, 0, 0, np.zeros(0, "<u4")

        def rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
            columns |= {"shard": pa.repeat(pa.scalar(shard, pa.int32()), n), "kind": pa.repeat(pa.scalar(kind, pa.int32()), n)}
            return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)

        def cut(ids: np.ndarray, first: int) -> pa.RecordBatch:
            each = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
            number = np.arange(first, first + len(each))
            return rows(0, len(each), row=pa.array(number), first=pa.array(number * BLOCK_IDS), n_ids=pa.array([len(x) for x in each], pa.int64()), payload=pa.array([pack(x, width) for x in each], pa.binary()))

        for batch in batches:
            at = 0
            for n, ids, before in own.encode(batch.column(1), end_id):
                yield rows(1, n, row=pa.array(np.arange(row, row + n)), first=pa.array(total + before[:-1]), n_ids=pa.array(np.diff(before)), doc_id=batch.column(0).slice(at, n))
                at, row, total = at + n, row + n, total + len(ids)
                rest = np.concatenate([rest, ids])
                if full := len(rest) // BLOCK_IDS:
                    yield cut(rest[: full * BLOCK_IDS], block)
                    rest, block = rest[full * BLOCK_IDS :], block + full
        if len(rest):
            yield cut(rest, block)
        tidy()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int | None = None) -> int:
    """Write the blocks and index of docs to path; the number of bits of an id is returned."""
    spark = docs.sparkSession
    ship(spark)
    width = width_for(max(vocabulary or encoder(tokenizer).vocabulary, end_id + 1))
    # rows of one doc_id, or of none, are dealt by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(_writer(tokenizer, end_id, width), _ROW).withColumn("width", F.lit(width)).write.partitionBy("kind").parquet(path)
    return width


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW + ", width int").parquet(path).where("kind = 0").select("shard", F.col("row").alias("block"), "first", "n_ids", "width", "payload")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index with each document's start over all shards."""
    own = spark.read.schema(_ROW).parquet(path).where("kind = 1").select("shard", "row", "doc_id", F.col("first").alias("offset"), F.col("n_ids").alias("n_tokens"))
    # one row for each shard
    totals = own.groupBy("shard").agg(F.sum("n_tokens").alias("n")).selectExpr("shard", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as before")
    return own.join(F.broadcast(totals), "shard").withColumn("start", F.col("before") + F.col("offset")).drop("before")


def read_ids(spark: SparkSession, path: str, shard: int, offset: int, n: int) -> np.ndarray:
    """Random access: n ids of a shard, from the blocks that hold them only."""
    lo, hi = offset // BLOCK_IDS, (offset + n - 1) // BLOCK_IDS
    found = blocks(spark, path).where((F.col("shard") == shard) & F.col("block").between(lo, hi)).orderBy("block").collect()
    ids = np.concatenate([unpack(bytes(r.payload), r.width, r.n_ids) for r in found])
    return ids[offset - lo * BLOCK_IDS : offset - lo * BLOCK_IDS + n]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Blocks and index entries meet by shard in order of their first id; a task holds one block at a time and what is left of one
    document, of which only a running crc32 is kept.
    """
    ship(spark)
    docs = index(spark, path).select("shard", F.col("offset").alias("first"), F.lit(1).alias("kind"), "doc_id", F.col("n_tokens").alias("n_ids"), "start", "row", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("int").alias("width"))
    data = blocks(spark, path).select("shard", "first", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "n_ids", F.lit(None).cast("long").alias("start"), F.col("block").alias("row"), "payload", "width")
    rows = data.unionByName(docs).repartition("shard").sortWithinPartitions("shard", "first", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, base = None, np.zeros(0, "<u4"), 0
        open_docs: list[list] = []  # doc_id, start, n_tokens, next id wanted, end, crc

        def feed() -> Iterator[list]:
            while open_docs:
                doc = open_docs[0]
                lo, hi = doc[3], min(doc[4], base + len(held))
                if hi > lo:
                    doc[5], doc[3] = zlib.crc32(held[lo - base : hi - base].tobytes(), doc[5]), hi
                if doc[3] < doc[4]:
                    return
                yield open_docs.pop(0)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, held, base = r["shard"], np.zeros(0, "<u4"), 0
                if r["kind"] == 0:
                    # documents that reach beyond their block wait for the next; all others are done
                    held, base = unpack(r["payload"], r["width"], r["n_ids"]).astype("<u4"), r["first"]
                else:
                    open_docs.append([r["doc_id"], r["start"], r["n_ids"], r["first"], r["first"] + r["n_ids"], 0])
                out += feed()
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1, 2, 5)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if open_docs:
            raise ValueError("blocks are missing")

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write docs' tokens (to the shared folder where no path is given) and read the documents back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
