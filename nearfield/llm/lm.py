"""Language-model scores by a weighted backoff automaton.

The model: n-grams with Dirichlet-smoothed probabilities,

    p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

h' being h without its first word, and m = s c(h)^b.  c(h)^b stands for the number
of different words after h; for each order b is such that these add up to the
number of different n-grams.  As an automaton, each history is a state;
a seen n-gram is an arc; any other word takes the failure arc to h', which
weighs m / (c(h) + m).  The probabilities sum to one over the vocabulary and one
unknown word.

The model is never gathered in one place.  Documents are dealt into blocks; a
block sends its distinct n-grams, with its own training counts, to the buckets
of their hashes, one packed message for each bucket that it has n-grams for.
There counts are summed, and the block gets back those of its n-grams.  Sums over
the whole model are taken once, from one row a bucket.  From the counts a block
builds the part of the automaton that its texts can reach: states, their failure
arcs, and a sorted table of arcs.  One walk from left to right carries the state
of each text from token to token and adds up weights; texts are walked side by
side, long ones in segments whose first state the tokens before them give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WordHashes, give_back, hashed_words, joined, small_batches

#: Text bytes of a block, and n-grams of a bucket, about.
BLOCK_BYTES = 16_000_000
BUCKET_GRAMS = 1_500_000
#: Scale of each order's backoff: s above, from order 2 on.
STRENGTH = 2.0
#: Exponents for which sums of powers of the counts are taken; b is read off between them.
EXPONENTS = np.linspace(0.2, 1.0, 17)
END, START = np.uint64(1), np.uint64(2)
#: Tokens of a segment of a walk.
SEGMENT = 512


@dataclass
class Block:
    """Tokens of the texts of a block, and its distinct n-grams by order."""

    first: np.ndarray  # place of each text's first token; one more for the end
    train: np.ndarray  # per token: whether its text is learned from
    grams: list[np.ndarray]  # by order: sorted distinct hashes
    at: list[np.ndarray]  # by order: where each token's n-gram stands in grams
    histories: list[np.ndarray]  # by order from 2: where the history stands in the grams one order lower, or -1: the start


def encode(texts: list[bytes], train: np.ndarray, order: int) -> Block:
    memory = WordHashes()
    parts, first = [], [0]
    end = np.array([END])
    for t in texts:
        words = hashed_words(t, memory)
        parts += [words, end]
        first.append(first[-1] + len(words) + 1)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    starts = np.array(first)
    offset = (np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.int32)
    grams, at, histories = [], [], []
    for k in range(order):
        if not k:
            g, i = np.unique(tokens, return_inverse=True)
        else:
            columns = []
            for back in range(k, -1, -1):
                moved = np.concatenate((np.zeros(back, np.uint64), tokens[: len(tokens) - back]))
                columns.append(np.where(offset >= back, moved, START))
            g, i = np.unique(joined(columns, k + 1), return_inverse=True)
            before = np.concatenate((np.zeros(1, np.int32), at[-1][:-1]))[: len(tokens)]
            histories.append(np.where(offset >= 1, before, -1))
        grams.append(g)
        at.append(i.astype(np.int32))
    return Block(starts, np.repeat(train, np.diff(starts)), grams, at, histories)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 or 64 bits as byte planes apart, after their width; the planes of small numbers compress to nothing."""
    return bytes([numbers.itemsize]) + numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T).view(f"<u{data[0]}").ravel()


def packed(grams: np.ndarray) -> bytes:
    """Sorted hashes as planes of their differences."""
    return planes(np.diff(grams, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


SENT = "block int, bucket int, grams array<binary>, counts array<binary>, starts long"


def _send(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = encode(_texts(table), np.asarray(table.column("train")), order)
        number = table.column("block")[0].as_py()
        starts = int(np.asarray(table.column("train")).sum())
        give_back()
        width = (1 << 64) // buckets + 1
        counts = [np.bincount(block.at[k][block.train], minlength=len(g)).astype("<u4") for k, g in enumerate(block.grams)]
        held = np.unique(np.concatenate([g // np.uint64(width) for g in block.grams])).astype(np.int64)
        cuts = [[np.searchsorted(g, np.array([b * width for b in held], np.uint64)), np.append(np.searchsorted(g, np.array([(b + 1) * width for b in held[:-1]], np.uint64)), len(g))] for g in block.grams]
        return pa.table(
            {
                "block": pa.array([number] * len(held), pa.int32()),
                "bucket": pa.array(held, pa.int32()),
                "grams": pa.array([[packed(g[lo[i] : hi[i]]) for g, (lo, hi) in zip(block.grams, cuts, strict=True)] for i in range(len(held))], pa.list_(pa.binary())),
                "counts": pa.array([[planes(c[lo[i] : hi[i]]) for c, (lo, hi) in zip(counts, cuts, strict=True)] for i in range(len(held))], pa.list_(pa.binary())),
                "starts": pa.array([starts if not i else 0 for i in range(len(held))], pa.int64()),
            }
        )

    return run


REPLY = "block int, bucket int, counts array<binary>, tokens array<long>, types array<long>, powers array<array<double>>, starts long"


def _sum(order: int):
    """The summed counts of a bucket's n-grams, back to every block that asked; block -1 is the bucket's own sums by order."""

    def run(table: pa.Table) -> pa.Table:
        asked, sent = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        back: list[list[bytes]] = [[] for _ in asked]
        tokens, types, powers = [], [], []
        for k in range(order):
            grams = [unpacked(x[k]) for x in asked]
            distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([unplanes(x[k]) for x in sent]), minlength=len(distinct)).astype(np.int64)
            for reply, part in zip(back, np.split(total[at], np.cumsum([len(g) for g in grams])[:-1]), strict=True):
                reply.append(planes(part.astype("<u4" if part.max(initial=0) < 1 << 32 else "<u8")))
            value, many = np.unique(total[total > 0].astype(float), return_counts=True)
            tokens.append(int(total.sum()))
            types.append(int((total > 0).sum()))
            powers.append([float((value**b * many).sum()) for b in EXPONENTS])
        none, n = [None], table.num_rows
        return pa.table(
            {
                "block": pa.array(table.column("block").to_pylist() + [-1], pa.int32()),
                "bucket": pa.array(table.column("bucket").to_pylist() + table.column("bucket").to_pylist()[:1], pa.int32()),
                "counts": pa.array(back + none, pa.list_(pa.binary())),
                "tokens": pa.array(none * n + [tokens], pa.list_(pa.int64())),
                "types": pa.array(none * n + [types], pa.list_(pa.int64())),
                "powers": pa.array(none * n + [powers], pa.list_(pa.list_(pa.float64()))),
                "starts": pa.array(none * n + [sum(table.column("starts").to_pylist())], pa.int64()),
            }
        )

    return run


class Automaton:
    """The states and arcs that a block's texts can reach.

    State 0 is the empty history.  Each order has one state for the start of a text
    and one for each n-gram of the block; longer histories have higher numbers.
    fail, fail_weight: by state.  An arc's key is state * words + word, in order;
    arc_weight and arc_next belong to the keys.  The arcs of state 0 are by word.
    """

    def __init__(self, counts: list[np.ndarray], block: Block, total: int, types: int, texts: int, scale: float, exponents: list[float]):
        self.block, self.order, self.words = block, len(counts), max(1, len(counts[0]))
        self.base = np.log10((counts[0] + 0.1) / (total + 0.1 * (types + 1)))
        firsts = np.cumsum([1] + [len(c) + 1 for c in counts[:-1]])  # by order: its start state; its n-grams follow
        self.begin = int(firsts[self.order - 2]) if self.order > 1 else 0
        self.fail = np.zeros(firsts[-1] if self.order > 1 else 1, np.int64)
        self.fail_weight = np.zeros(len(self.fail))
        self.next_word = firsts[0] + 1 + np.arange(len(counts[0])) if self.order > 1 else np.zeros(len(counts[0]), np.int64)
        self.keys, self.arc_weight, self.arc_next = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for k in range(1, self.order):
            # States of the histories of k words.  Any token at which an n-gram stands tells its parts.
            token = np.zeros(len(counts[k - 1]), np.int32)
            token[block.at[k - 1]] = np.arange(len(block.at[k - 1]), dtype=np.int32)
            seen = np.concatenate(([texts], counts[k - 1])).astype(float)
            strength = scale * np.maximum(seen, 1.0) ** exponents[k - 1]
            own = slice(firsts[k - 1], firsts[k - 1] + len(seen))
            self.fail_weight[own] = np.log10(strength / (seen + strength))
            self.fail[own] = np.concatenate(([firsts[k - 2]], firsts[k - 2] + 1 + block.at[k - 2][token])) if k > 1 else 0
            # Their arcs: the n-grams of k + 1 words that are in the training texts.
            arcs = np.flatnonzero(counts[k] > 0)
            token = np.zeros(len(counts[k]), np.int32)
            token[block.at[k]] = np.arange(len(block.at[k]), dtype=np.int32)
            token = token[arcs]
            history = block.histories[k - 1][token] + 1
            state, word = firsts[k - 1] + history, block.at[0][token]
            lower, _ = self.step(self.fail[state], word)
            weight = np.log10((counts[k][arcs] + strength[history] * 10**lower) / (seen[history] + strength[history]))
            after = firsts[k] + 1 + arcs if k < self.order - 1 else firsts[k - 1] + 1 + block.at[k - 1][token]
            keys = state * self.words + word
            order = np.argsort(keys)  # longer histories have higher keys than all before
            self.keys = np.concatenate((self.keys, keys[order]))
            self.arc_weight = np.concatenate((self.arc_weight, weight[order]))
            self.arc_next = np.concatenate((self.arc_next, after[order]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight, next state) of reading ``word`` in ``state``: failure arcs until a state has an arc for it."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left, state, word = np.arange(len(state)), state.copy(), word
        while len(left):
            if len(self.keys):
                key = state * self.words + word
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (state > 0)
                weight[left[hit]] += self.arc_weight[at[hit]]
                after[left[hit]] = self.arc_next[at[hit]]
            else:
                hit = np.zeros(len(left), bool)
            root = state == 0
            weight[left[root]] += self.base[word[root]]
            after[left[root]] = self.next_word[word[root]]
            on = ~(hit | root)
            left, state, word = left[on], state[on], word[on]
            weight[left] += self.fail_weight[state]
            state = self.fail[state]
        return weight, after

    def walk(self) -> np.ndarray:
        """The log10 probability of each text: all segments side by side, token by token."""
        first, words = self.block.first, self.block.at[0]
        lengths = np.diff(first)
        pieces = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[:-1][text] + number * SEGMENT
        end = np.minimum(begin + SEGMENT, first[1:][text])
        # The state at a segment's begin follows from the few tokens before it.
        state = np.where(number == 0, self.begin, 0)
        for back in range(self.order - 1, 0, -1):
            inner = np.flatnonzero(number > 0)
            state[inner] = self.step(state[inner], words[begin[inner] - back])[1]
        score = np.zeros(len(text))
        by_length = np.argsort(begin - end, kind="stable")  # longest first, so that those still running come first
        begin, end, state = begin[by_length], end[by_length], state[by_length]
        running, part = len(begin), np.zeros(len(begin))
        for t in range(int((end - begin).max(initial=0))):
            running = int(np.searchsorted(begin[:running] - end[:running], -t))
            weight, state[:running] = self.step(state[:running], words[begin[:running] + t])
            part[:running] += weight
        score[by_length] = part
        return np.bincount(text, weights=score, minlength=len(lengths))

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """(score, base score) of each text."""
        return self.walk(), np.add.reduceat(self.base[self.block.at[0]], self.block.first[:-1])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def exponent(powers: np.ndarray, types: int) -> float:
    """b such that the counts to the power b add up to ``types``; powers: the sums for EXPONENTS."""
    return float(np.interp(types, powers, EXPONENTS))


@dataclass
class Sums:
    """Sums over the whole model, by order."""

    tokens: int
    types: list[int]
    powers: list[np.ndarray]
    texts: int


def _score(order: int, scale: float):
    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})
        train = np.asarray(docs.column("train"))
        block = encode(_texts(docs), train, order)
        whole, *got = sorted(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist(), replies.column("sums").to_pylist(), strict=True), key=lambda r: r[0])
        by_order = whole[2]  # bucket -1
        sums = Sums(by_order[0]["tokens"], [r["types"] for r in by_order], [np.array(r["powers"]) for r in by_order], by_order[0]["starts"])
        exponents = [exponent(sums.powers[k - 1], sums.types[k]) for k in range(1, order)]
        got = [r for _, r, _ in got]
        counts = [np.concatenate([unplanes(r[k]) for r in got]).astype(np.int64) for k in range(order)]
        score, base = Automaton(counts, block, sums.tokens, sums.types[0], sums.texts, scale, exponents).scores()
        give_back()
        known = np.add.reduceat((counts[0] > 0)[block.at[0]].astype(np.int64), block.first[:-1])
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(np.diff(block.first), pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array([sums.tokens] * len(known), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def lm_scores(docs: DataFrame, train: str, order: int = 2, scale: float = STRENGTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs(doc_id, text)``.

    train: SQL condition on doc_id, never null, that holds for the texts to learn
    from; the others are held out.  Tokens are the words, A-Z lowered, and one
    end.  A null text is empty: its one token is the end.  base_score: of the
    unigrams alone.  Without training texts all counts are 0.  A null doc_id stays.
    Very long texts are read whole, by the task of their block.  Repeated rows count each;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.expr(train).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, int(size // BLOCK_BYTES) + 1)
    buckets = max(8, int(size * order // 8 // BUCKET_GRAMS) + 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")).repartition(max(blocks, 12), "block")
    asked = dealt.groupBy("block").applyInArrow(_send(order, buckets), SENT)
    replies = asked.groupBy("bucket").applyInArrow(_sum(order), REPLY)
    # The model's sums are one row, dealt out to the blocks; the exchanges before are made once.
    by_order = replies.where("block = -1").select(F.posexplode(F.arrays_zip("tokens", "types", "powers")), "starts").groupBy("pos")
    powers = F.array(*(F.sum(F.col("col.powers")[i]) for i in range(len(EXPONENTS))))
    by_order = by_order.agg(F.sum("col.tokens").alias("tokens"), F.sum("col.types").alias("types"), F.sum("starts").alias("starts"), powers.alias("powers"))
    whole = by_order.agg(F.sort_array(F.collect_list(F.struct("pos", "tokens", "types", "starts", "powers"))).alias("sums"))
    whole = whole.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("bucket"), F.lit(None).cast("array<binary>").alias("counts"), "sums")
    back = replies.where("block >= 0").select("block", "bucket", "counts", F.lit(None).cast(whole.schema["sums"].dataType).alias("sums")).unionByName(whole)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(order, scale), SCORED)
