"""Token counts with a SentencePiece model: Arrow batches in, lengths out.

Texts are split at safe boundaries into units: a run of spaces and what follows up to the next space. No piece of the
vocabulary has a space mark after another character (checked when the model is loaded), and the model neither rewrites nor
trims text, so no merge crosses a boundary and the counts of a text's units add up to its own. Each worker keeps the counts
of up to MAX_CACHED short units; new units are encoded in batches of about BATCH_BYTES. So a long text costs what its
bytes cost; its units are held at once, as pieces of the text that is in memory anyway. A text without spaces is one unit. Where a model
isn't safe in this way, whole texts are encoded.

A null text counts as empty: no bytes, no tokens. Repeated rows get a row each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

LIMIT = 4096
BATCH_BYTES = 1 << 18
MAX_CACHED = 600_000
#: Longer units are encoded each time, not kept.
MAX_UNIT = 64
MARK = "▁"
_RUNS = re.compile(r" *[^ ]+| +")
_loaded: dict[str, Counter] = {}


def units(text: str) -> list[str]:
    """The text in pieces that can be encoded apart, without the space that the encoder puts before each."""
    if MARK in text:  # the model takes it for a space
        text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        found = _RUNS.findall(text)
        return [found[0], *(x[1:] for x in found[1:])]
    return text.split(" ") if text else []


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.counts: dict[str, int] = {}
        self.safe = all(MARK not in x.lstrip(MARK) and " " not in x for x in (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))) and self.model.piece_to_id(MARK) != self.model.unk_id() and self._plain()

    def _plain(self) -> bool:
        """Spaces are neither trimmed nor joined, one is put in front, and other characters stay."""
        return self.model.encode("  a  b ", out_type=str) == self._marks("   a  b ") and "".join(self.model.encode("Ａ²", out_type=str)).lstrip(MARK) not in ("A2",)

    def _marks(self, text: str) -> list[str]:
        found = self.model.encode("  a  b ", out_type=str)
        return found if "".join(found) == text.replace(" ", MARK) else []

    def _encoded(self, texts: list[str]) -> Iterator[int]:
        batch: list[str] = []
        size = 0
        for x in texts:
            batch.append(x)
            size += len(x.encode()) + 8
            if size >= BATCH_BYTES:
                yield from map(len, self.model.encode(batch, num_threads=1))
                batch, size = [], 0
        if batch:
            yield from map(len, self.model.encode(batch, num_threads=1))

    def count(self, texts: Iterable[str]) -> list[int]:
        texts = list(texts)
        if not self.safe:
            return list(self._encoded(texts))
        if len(self.counts) > MAX_CACHED:
            self.counts.clear()
        self.counts[""] = 1  # one space at the end of a text: the mark alone
        split = [units(x) for x in texts]
        known = self.counts
        new = {u for x in split for u in x if u not in known}
        once = {}
        for u, n in zip(new := list(new), self._encoded(new), strict=True):
            (known if len(u) <= MAX_UNIT else once)[u] = n
        if once:
            return [sum(once[u] if u in once else known[u] for u in x) for x in split]
        return [sum(map(known.__getitem__, x)) for x in split]


def counter(path: str) -> Counter:
    """One for each worker process, which runs many tasks."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. model: the file's path, the same on all workers."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            counts: list[int] = []
            held: list[str] = []
            size = 0
            for x, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                held.append(x.as_py() or "")
                size += n
                if size >= 8 * BATCH_BYTES:
                    counts += own.count(held)
                    held, size = [], 0
            counts += own.count(held)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
