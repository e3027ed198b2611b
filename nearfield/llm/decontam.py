"""Benchmark decontamination: test phrases searched in an FM-index of each shard of the training text.

A shard is a slice of about ``SHARD_WORDS`` words of a task's documents, from as many
batches as it takes.  Its words become symbols: those of the benchmark's vocabulary get numbers, all others part
the text (no phrase can span them), and stretches shorter than the shortest
phrase are left out.  The phrases run through backward search together; their
occurrences are located by sampled suffix positions and merged into spans.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import column_bytes, scratch, sent, small_batches, staged, table_batch, tidy
from nearfield.llm.common import without as leaving
from nearfield.llm.fm_index import FMIndex

SHARD_WORDS = 1_000_000
#: Benchmark words of one broadcast block, about; a larger benchmark is searched block after block.
BLOCK_WORDS = 500_000
#: A longer item is dealt out in pieces that overlap by a window less one word.
PIECE_WORDS = 100_000
#: A-Z lowered; every other ASCII character that is no letter or digit parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


class Phrases:
    """The windows of some items: distinct symbol rows, and the items of each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.symbols: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in words)
            for k in range(max(1, len(ids) - window + 1)):
                rows.setdefault(ids[k : k + window], set()).add(item)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, window - len(r) :] = r
        self.items = [sorted(x) for x in rows.values()]
        self.shortest = int(self.lengths.min()) if rows else 0


def search_shard(phrases: Phrases, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of all occurrences; places count through the shard, each document followed by one 0."""
    full = np.zeros(sum(map(len, docs)) + len(docs), np.int64)
    at = 0
    for d in docs:
        full[at : at + len(d)] = d
        at += len(d) + 1
    zeros = np.flatnonzero(full == 0)
    run = np.diff(np.concatenate(([-1], zeros))) - 1
    keep = np.repeat(run >= phrases.shortest, run + 1)
    places = np.flatnonzero(keep)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(full[places])
    lo, hi = index.search(phrases.rows, phrases.lengths)
    many = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]
    return which, places[index.locate(rows)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the word spans: from the first letter of a span's first word to the next word's."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at : words[a][0]])
        at = words[b][0] if b < len(words) else words[b - 1][1]
    return b"".join(parts) + text[at:]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, items array<long>, spans array<struct<start:long,end:long>>"


def _scan(phrases, first: bool, cut: bool):
    def run(batches):
        known = phrases()
        waiting: deque = deque()  # batches whose rows are not all searched
        held: list[np.ndarray] = []
        n_words: list[int] = []
        items: list[list[int]] = []
        spans: list[list[tuple[int, int]]] = []

        def shard():
            which, place = search_shard(known, held)
            starts = np.cumsum([0] + [len(d) + 1 for d in held])
            doc = np.searchsorted(starts, place, side="right") - 1
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(len(held) + 1))
            for k in range(len(held)):
                own = order[cuts[k] : cuts[k + 1]]
                n_words.append(len(held[k]))
                items.append(sorted({i for w in np.unique(which[own]) for i in known.items[w]}))
                begin = np.unique(np.stack((place[own] - starts[k], known.lengths[which[own]]), 1), axis=0) if len(own) else ()
                spans.append(merged([(int(a), int(a + n)) for a, n in begin]))
            held.clear()

        def ready():
            while waiting and len(n_words) >= waiting[0][0].num_rows:
                batch, texts = waiting.popleft()
                n, own_items, own_spans = n_words[: len(texts)], items[: len(texts)], spans[: len(texts)]
                del n_words[: len(texts)], items[: len(texts)], spans[: len(texts)]
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                if not first:  # what earlier blocks found
                    own_items = [sorted({*a, *b}) for a, b in zip(own_items, columns["items"].to_pylist(), strict=True)]
                    own_spans = [merged([*a, *((x["start"], x["end"]) for x in b)]) for a, b in zip(own_spans, columns["spans"].to_pylist(), strict=True)]
                columns |= {"n_words": pa.array(n, pa.int64()), "items": pa.array(own_items, pa.list_(pa.int64())), "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in own_spans], _SPAN)}
                if cut:
                    columns["text"] = pa.array([without(t, s) if s else t for t, s in zip(texts, own_spans, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

        size = 0
        for batch in batches:
            texts = column_bytes(batch, "text")
            waiting.append((batch, texts))
            for text in texts:
                words = (text or b"").translate(FOLD).split()
                held.append(np.fromiter(map(known.symbols.get, words, repeat(0)), np.int64, len(words)))
                size += len(words)
                if size >= SHARD_WORDS:
                    shard()
                    size = 0
                    yield from ready()
        if held:
            shard()
        yield from ready()

    return tidy(run)


def _pieces(window: int):
    schema = pa.schema([("item", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                words = text.translate(FOLD).split()
                for k in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    part = words[k : k + PIECE_WORDS + window - 1]
                    yield table_batch(schema, item=[item], piece=[k], n=[len(part)], words=[b" ".join(part)])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, items (ids of the items found, sorted) and spans (merged hit words, [start, end)).

    docs has a string column ``text``; columns of those three names are replaced.  benchmark
    has ``item_id`` and ``text``.  An item of fewer words than the window is one
    phrase; items without words, null texts and null ids are never found; an
    empty benchmark finds nothing.  Null and empty texts have no words; very long
    ones are searched whole.  Repeated rows, equal items and other columns stay as they are.
    cut: the spans are cut out of ``text``, each with what parts it from the next word.
    The benchmark is split on the executors and reaches them in blocks of about
    BLOCK_WORDS words; with more than one, the result of each block is written before the next.
    """
    spark, docs = docs.sparkSession, leaving(docs, "n_words", "items", "spans")
    small_batches(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    with scratch(spark):
        given = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
        pieces = staged(given.mapInArrow(_pieces(window), "item long, piece long, n long, words binary"))
        blocks = int((pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS) + 1
        out = docs
        for k in range(blocks):
            block = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == k).select("item", "words").orderBy("item", "piece")
            phrases = Phrases([(r["item"], bytes(r["words"]).split()) for r in block.collect()], window)
            out = out.mapInArrow(_scan(sent(spark, phrases), k == 0, cut and k == blocks - 1), f"{kinds}, {FOUND}")
            if blocks > 1:
                out = staged(out, stays=k == blocks - 1)
    return out
