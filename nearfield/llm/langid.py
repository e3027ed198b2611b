"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum over all its segmentations into
pieces of a fixed public vocabulary; a forward pass over the word adds them up.
Piece probabilities are learned by expectation-maximisation: the expected piece
counts of a word are those of its segmentations, weighted by their probability.
Words are handled once a task, in groups of equal length; very long ones, as in
scripts without blanks, run through the same sums one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import column_bytes, scratch, sent, small_batches, staged, table_batch, tidy, without

#: About so many labelled texts the fit reads, chosen by hash.
MOST_TRAINING = 6_000
#: Beside these, about so many texts of each language are read, or all it has.
LEAST_TRAINING = 500
#: Words of more bytes run through the sums one by one, in memory that the scoring pass keeps bounded.
LONG_WORD = 192
#: Tasks of a round of the fit.
FIT_TASKS = 24
#: Count that every piece has in every language besides what is seen.
UNSEEN = 0.05
#: Stands for the mark of a word's begin in the pieces; no UTF-8 text has this byte.
BEGIN = b"\xff"
#: Distinct words remembered per task.
REMEMBERED = 400_000
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def vocabulary(path: str) -> dict[bytes, int]:
    """Pieces of a sentencepiece model as bytes, with the 256 single bytes; numbers count from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.setdefault(model.id_to_piece(i).encode().replace("▁".encode(), BEGIN), len(pieces))
    return pieces


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def has_letter(text: bytes) -> bool:
    """Whether a character is a letter; digits, marks and signs of any script are none."""
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode()))


class Segmenter:
    """Forward and backward passes over the segmentations of words."""

    def __init__(self, pieces: dict[bytes, int]):
        self.none = max(pieces.values(), default=-1) + 1
        self.longest = max(map(len, pieces), default=1)
        # Every beginning of a piece, with the piece's number or ``none``: a substring that is not here begins none.
        begins = {p[:k]: self.none for p in pieces for k in range(1, len(p))}
        self.get = (begins | pieces).get
        self.bytes_first = all(self.get(bytes([b])) == b for b in range(256))

    def edges(self, words: list[bytes]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, piece numbers) of the pieces in words of one length, by end."""
        n, out = len(words[0]), []
        get, none = self.get, self.none
        every = np.arange(len(words))
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(np.int64)
        for b in range(n):
            rows, live = every, words
            if self.bytes_first:
                out.append((b, b + 1, every, letters[:, b]))
            for e in range(b + 1 + self.bytes_first, min(n, b + self.longest) + 1):
                found = [get(w[b:e], -1) for w in live]
                ids = np.array(found)
                if (ids < 0).any():
                    keep = np.flatnonzero(ids >= 0)
                    if not len(keep):
                        break
                    rows, ids, live = rows[keep], ids[keep], [live[i] for i in keep]
                piece = np.flatnonzero(ids != none)
                if len(piece):
                    out.append((b, e, rows[piece], ids[piece]))
        return sorted(out, key=lambda x: x[1])

    def sums(self, m: int, n: int, table: np.ndarray, edges: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled prefix sums of m words of length n at each place, and the log of each place's scale; table: piece x language."""
        alpha = [np.ones((m, table.shape[1]))] + [np.zeros((m, table.shape[1])) for _ in range(n)]
        log = np.zeros((m, table.shape[1]))
        logs = [log] * (n + 1)
        done = 0
        for e in range(1, n + 1):
            while done < len(edges) and edges[done][1] == e:
                b, _, rows, ids = edges[done]
                alpha[e][rows] += alpha[b][rows] * table[ids]
                done += 1
            if e % 24 == 0:  # keeps the numbers in range; scales the places still in reach alike
                top = np.maximum(np.where(alpha[e] > 0, alpha[e], np.max(alpha[max(0, e - self.longest) : e + 1], axis=0)), 1e-300)
                log = log + np.log(top)
                for k in range(max(0, e - self.longest), e + 1):
                    alpha[k] = alpha[k] / top
                    logs[k] = log
                logs[e + 1 :] = [log] * (n - e)
        return alpha, logs

    def forward(self, words: list[bytes], table: np.ndarray, edges: list) -> tuple[list[np.ndarray], np.ndarray]:
        """Scaled prefix sums at each place, and the log of each word's total; table: piece x language."""
        alpha, logs = self.sums(len(words), len(words[0]), table, edges)
        return alpha, logs[-1] + np.log(np.maximum(alpha[-1], 1e-300))

    def pieces_from(self, word: bytes, b: int):
        """(end, piece number) of the pieces of ``word`` that begin at ``b``."""
        for e in range(b + 1, min(len(word), b + self.longest) + 1):
            piece = self.get(word[b:e])
            if piece is None:
                return
            if piece != self.none:
                yield e, piece

    def long_total(self, word: bytes, table: np.ndarray) -> np.ndarray:
        """As ``forward``, of one word of any length, with as many prefix sums as the longest piece is long."""
        ring = np.zeros((self.longest + 1, table.shape[1]))
        ring[0], log, size = 1.0, np.zeros(table.shape[1]), self.longest + 1
        for b in range(len(word)):
            if b % 8 == 0:
                top = np.maximum(ring.max(0), 1e-300)
                ring, log = ring / top, log + np.log(top)
            own = ring[b % size].copy()
            ring[b % size] = 0
            for e, piece in self.pieces_from(word, b):
                ring[e % size] += own * table[piece]
        return log + np.log(np.maximum(ring[len(word) % size], 1e-300))

    def totals(self, words: list[bytes], table: np.ndarray) -> np.ndarray:
        """The log of each word's total; words of one length."""
        if len(words[0]) > LONG_WORD:
            return np.stack([self.long_total(w, table) for w in words])
        return self.forward(words, table, self.edges(words))[1]

    def expected(self, words: list[bytes], counts: np.ndarray, table: np.ndarray, total: np.ndarray) -> None:
        """Adds to ``total`` (piece x language) the expected piece counts; counts: word x language."""
        n, m = len(words[0]), len(words)
        if n > LONG_WORD:
            for w, c in zip(words, counts, strict=True):
                self.long_expected(w, c, table, total)
            return
        edges = self.edges(words)
        back = sorted(((n - e, n - b, rows, ids) for b, e, rows, ids in edges), key=lambda x: x[1])
        with np.errstate(divide="ignore"):
            alpha, beta = ([np.log(x) + y for x, y in zip(*self.sums(m, n, table, way), strict=True)] for way in (edges, back))
            weight = np.log(counts) - np.where(np.isneginf(alpha[n]), 0, alpha[n])
        for b, e, rows, ids in edges:
            np.add.at(total, ids, np.exp(alpha[b][rows] + beta[n - e][rows] + weight[rows]) * table[ids])

    def long_expected(self, word: bytes, counts: np.ndarray, table: np.ndarray, total: np.ndarray) -> None:
        """As ``expected``, of one word, in logarithms; only languages that have the word."""
        own = np.flatnonzero(counts)
        edges = [list(self.pieces_from(word, b)) for b in range(len(word))]
        with np.errstate(divide="ignore"):
            log = np.log(table[:, own])
        alpha, beta = (np.full((len(word) + 1, len(own)), -np.inf) for _ in range(2))
        alpha[0], beta[-1] = 0, 0
        for b, found in enumerate(edges):
            for e, piece in found:
                alpha[e] = np.logaddexp(alpha[e], alpha[b] + log[piece])
        for b in range(len(word) - 1, -1, -1):
            ends, ids = zip(*edges[b], strict=True) if edges[b] else ((), ())
            if ids:
                beta[b] = np.logaddexp.reduce(beta[list(ends)] + log[list(ids)], axis=0)
        live = np.isfinite(alpha[-1])
        weight = np.where(live, np.log(counts[own]) - np.where(live, alpha[-1], 0), -np.inf)
        for b, found in enumerate(edges):
            for e, piece in found:
                total[piece, own] += np.exp(alpha[b] + log[piece] + beta[e] + weight)


def by_length(words) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


@dataclass
class Model:
    pieces: dict[bytes, int]
    languages: list[str]
    table: np.ndarray  # piece x language, the last row 0
    prior: np.ndarray


def expected_counts(words: dict[bytes, dict[int, int]], segmenter: Segmenter, table: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece x language) of words with their counts by language number."""
    total = np.zeros_like(table)
    for n, group in by_length(words).items():
        step = max(1, 4096 * 41 // max(41, n))  # the longer the words, the more places each has
        for k in range(0, len(group), step):
            part = group[k : k + step]
            own = np.zeros((len(part), table.shape[1]))
            for i, w in enumerate(part):
                for lang, c in words[w].items():
                    own[i, lang] = c
            segmenter.expected([BEGIN + w for w in part], own, table, total)
    return total


def maximised(expect, pieces: dict[bytes, int], languages: list[str], known: dict[str, int], rounds: int = 2) -> Model:
    """The model after some rounds; expect: from a table of probabilities to expected counts."""
    start = np.zeros(max(pieces.values()) + 2)
    for piece, i in pieces.items():
        start[i] = 0.1 ** (1 + 0.25 * len(piece))
    table = np.repeat(start[:, None] / start.sum(), len(languages), 1)
    for _ in range(rounds):
        smooth = expect(table) + UNSEEN
        smooth[-1] = 0
        table = smooth / smooth.sum(0, keepdims=True)
    prior = np.array([known[x] for x in languages], float)
    return Model(pieces, languages, table, np.log(prior / prior.sum()))


def fit(rows, pieces: dict[bytes, int], rounds: int = 2) -> Model | None:
    """From (text bytes, language) pairs, in this process; ``train`` does the same by tasks."""
    rows = list(rows)
    texts = Counter(lang for _, lang in rows)
    languages = sorted(texts)
    if not languages:
        return None
    words: dict[bytes, dict[int, int]] = {}
    for text, lang in rows:
        for w, c in Counter(words_of(text)).items():
            own, at = words.setdefault(w, {}), languages.index(lang)
            own[at] = own.get(at, 0) + c
    segmenter = Segmenter(pieces)
    return maximised(lambda table: expected_counts(words, segmenter, table), pieces, languages, texts, rounds)


def _words_by_language(batches):
    schema = pa.schema([("word", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
    for batch in batches:
        seen: Counter = Counter()
        for text, lang in zip(column_bytes(batch, "text"), batch.column(batch.schema.get_field_index("lang")).to_pylist(), strict=True):
            for w, c in Counter(words_of(text)).items():
                seen[w, lang] += c
        yield table_batch(schema, word=[w for w, _ in seen], lang=[x for _, x in seen], n=list(seen.values()))


def _expected_by_task(pieces, languages: list[str], table):
    schema = pa.schema([("lang", pa.int32()), ("task", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        known, now = pieces(), table()
        place = {x: i for i, x in enumerate(languages)}
        words, task = {}, 0
        for batch in batches:
            for w, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[w] = {place[e["lang"]]: e["n"] for e in entries}
            task = batch.column(2)[0].as_py() if batch.num_rows else task
        total = expected_counts(words, Segmenter(known), now)
        for lang in range(len(languages)):
            ids = np.flatnonzero(total[:, lang])
            yield table_batch(schema, lang=[lang], task=[task], ids=[ids.astype(np.int32).tobytes()], counts=[total[ids, lang].tobytes()])

    return tidy(run)


def _sum_counts(size: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for r in sorted(table.to_pylist(), key=lambda r: r["task"]):  # in one order, so that reruns agree
            total[np.frombuffer(r["ids"], np.int32)] += np.frombuffer(r["counts"])
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, train_fold: Column, pieces: dict[bytes, int]) -> Model | None:
    """Fits on about MOST_TRAINING texts with a language, chosen by the hash of their id, and more of a language with few.

    Of each language about LEAST_TRAINING texts are read at least, or all where
    it has no more than twice as many; the prior counts all texts.  The words of
    these texts stay on the executors, which count by tasks; a row a language
    and round comes back.  Null texts and null languages teach nothing; without
    any text there is no model.  Repeated rows count each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        pool = docs.select("doc_id", "text", "lang").where(train_fold).where("lang is not null and text is not null")
        known = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        share = min(1.0, MOST_TRAINING / max(1, sum(known.values())))

        def cut(part: float) -> int:
            return max(-(2**63), min(2**63 - 1, int((part - 0.5) * 2.0**64)))

        limits = [(x, cut(1.0 if n <= 2 * LEAST_TRAINING else LEAST_TRAINING / n)) for x, n in known.items() if n * share < LEAST_TRAINING]
        limit = F.lit(cut(share))
        if limits:
            limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in limits for v in pair)), F.col("lang")), limit)
        rows = staged(pool.where(F.xxhash64("doc_id", F.lit(21)) <= limit).select("text", "lang").repartition(FIT_TASKS))
        languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
        if not languages:
            return None
        words = rows.mapInArrow(tidy(_words_by_language), "word binary, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
        words = words.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
        words = staged(words.withColumn("task", F.pmod(F.xxhash64("word"), F.lit(FIT_TASKS)).cast("int")).repartition(FIT_TASKS, "task").sortWithinPartitions("task", "word"))
        vocabulary = sent(spark, pieces)

        def expect(table: np.ndarray) -> np.ndarray:
            counted = words.repartition(FIT_TASKS, "task").sortWithinPartitions("task", "word").mapInArrow(_expected_by_task(vocabulary, languages, sent(spark, table)), "lang int, task int, ids binary, counts binary")
            total = np.zeros_like(table)
            for r in counted.groupBy("lang").applyInArrow(_sum_counts(len(table)), "lang int, counts binary").collect():
                total[:, r["lang"]] = np.frombuffer(bytes(r["counts"]))
            return total

        return maximised(expect, pieces, languages, known)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score, for every row; only ``text`` is read.

    lang_pred: the likeliest learned language, ties to the first in order; ``und``
    with score 0 for a null text, one without letters, or without a model.  score:
    its posterior probability.  Very long texts and words are read whole.
    Columns of those names are replaced; other columns and repeated rows stay; an
    empty table gives no rows.
    """
    docs = without(docs, "lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    small_batches(docs.sparkSession)
    get = sent(docs.sparkSession, model)

    def run(batches):
        known = get()
        segmenter = Segmenter(known.pieces)
        width = len(known.languages)
        place: dict[bytes, int] = {}
        logs, known_bytes = np.zeros((0, width)), 0

        def full(new) -> bool:
            return len(place) + len(new) > REMEMBERED or known_bytes + sum(map(len, new)) > 32 * REMEMBERED

        def learn(new: list[bytes]):
            nonlocal logs, known_bytes
            if full(new):
                place.clear()
                logs, known_bytes = np.zeros((0, width)), 0
            known_bytes += sum(map(len, new))
            parts, at = [logs], len(logs)
            for words in by_length(new).values():
                for k in range(0, len(words), 4096):
                    part = [BEGIN + w for w in words[k : k + 4096]]
                    parts.append(segmenter.totals(part, known.table))
                    place.update(zip(words[k : k + 4096], range(at, at + len(part)), strict=True))
                    at += len(part)
            logs = np.concatenate(parts)

        for batch in batches:
            texts = column_bytes(batch, "text")
            langs, scores = [], []
            held, size = [], 0

            def flush():
                nonlocal size
                new = {w for words in held for w in words}
                if full(fresh := [w for w in new if w not in place]):
                    learn(list(new))  # the memory is emptied first, so all of them
                else:
                    learn(fresh)
                for words in held:
                    if not words:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    z = logs[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(0) + known.prior
                    best = int(z.argmax())
                    langs.append(known.languages[best])
                    scores.append(float(1 / np.exp(z - z[best]).sum()))
                held.clear()
                size = 0

            for text in texts:
                held.append(words_of(text) if text is not None and has_letter(text) else [])
                size += len(text or b"")
                if size > 1_500_000:
                    flush()
            if held:
                flush()
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")
