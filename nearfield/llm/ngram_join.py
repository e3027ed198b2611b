"""Exact Jaccard self-join of word n-gram sets, size-aware.

Two sets link when ``percent * |union| <= 100 * |intersection|``.  Sets that are
equal collapse to one class first, so only links between different sets are
searched:

* All tokens have one global order: rare before frequent, by the level of a
  count sketch over all documents, then by hash.  Any order gives exact results;
  this one keeps common passages out of the prefixes.
* A *large* set stands on the inverted list of each token of its prefix.  A
  *small* set enumerates the two-element subsets of its prefix, one token longer;
  small sets that a large one may reach also stand on the inverted lists.  The
  size that parts small from large is the one of least cost, counted on the lists
  as they are: keys sent, and members that stand on one list.
* A list is parted where no member can reach the next size: a token at place i of
  a set of n bounds the overlap by n - i, and so the size of a partner.
* On each list every member is first tested against one hub; connected members
  need no further test.  Members of one list that are still in different
  components meet in blocks, lists of mostly the same members once.  There shortened hashes bound each overlap from
  above, and a union-find keeps at most one candidate link for each join of two
  components, so a group sends no more rows than it has members.  Candidates are
  tested exactly; a group that a failed candidate joined runs once more on whole
  hashes, which leave nothing to test.

No list is cut: a list with many members is dealt out in pairs of blocks, and
joins on it by parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import WordHashes, column_bytes, give_back, joined, mixed, scratch, small_batches, staged, table_batch, text_words, tidy
from nearfield.llm.components import components

#: Most cells of the count sketch that orders tokens; its levels (one byte a cell) are broadcast: 16 MB.
SKETCH_BITS = 24
SKETCH_BLOCKS = 128
#: Tasks whose sketches one task adds up.
TASKS_AT_ONCE = 4096
#: Least and most bits of the bitmap that picks the documents whose sets are needed again: at most 32 MB, eight bits a set.
PICK_BITS = (16, 28)
PICK_PARTS = 64
#: n-grams of a block of a list; a task compares two blocks.
BLOCK_GRAMS = 1 << 19
#: Members of a list that meet in one task of a join; longer lists are joined by parts.
LIST_PART = 512
#: Rows of one hub that meet in one task of the exact test.
HUB_PART = 1024
#: Pairs up to this number are broadcast (64 MB) to leave out sets that no pair names; more are joined by shuffle.
MOST_BROADCAST = 2_000_000
FLUSH_BYTES, FLUSH_POSTS = 2_000_000, 400_000
#: Postings of a bucket, about; 16 bytes each, and some 150 more while a task sorts them.
BUCKET_POSTS = 400_000
#: A token that so many sets may hold is heavy: its postings are not gathered in one task.
HEAVY = 200_000
HEAVY_PARTS = 64
#: Sizes up to this one are weighed as small; beyond, a set has five times more pairs than tokens to send.
MOST_SMALL = 40
#: Cost of a partner on a list, which may take a comparison of two sets, against that of sending a key of 16 bytes.
LOOK = 0.5


def ngram_sets(texts: list[bytes | None], n: int, memory: WordHashes) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct n-gram hashes) of each text; a shorter text is one n-gram, no words give none."""
    first, size = 0, 0

    def emit(first, after):
        words, counts = text_words(texts[first:after], memory)
        full = joined([words[i : len(words) - n + 1 + i] for i in range(n)], n) if len(words) >= n else words[:0]
        start = 0
        for place, count in enumerate(counts.tolist(), first):
            end = start + count
            if count >= n:
                grams = full[start : end - n + 1].copy()
                grams.sort()
                yield place, grams[np.concatenate(([True], grams[1:] != grams[:-1]))]
            elif count:
                yield place, joined([words[start + i : start + i + 1] for i in range(count)], count)
            else:
                yield place, words[:0]
            start = end

    for place, text in enumerate(texts):
        size += len(text or b"")
        if size >= FLUSH_BYTES:
            yield from emit(first, place + 1)
            first, size = place + 1, 0
    if first < len(texts):
        yield from emit(first, len(texts))


def set_class(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap a set of size n can have with any partner."""
    return -(-n * percent // 100)


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])


def _first_pass(n: int, bits: int):
    def run(batches):
        memory, seen = WordHashes(), set()
        sketch = np.zeros(1 << bits, np.uint16)
        lane = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lane = len(ids) if lane is None else lane
            out_id, out_class, out_n = [], [], []
            for place, grams in ngram_sets(column_bytes(batch, "text"), n, memory):
                c = set_class(grams) if len(grams) else None
                out_id.append(ids[place])
                out_class.append(c)
                out_n.append(len(grams))
                if c is not None and c not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(c)
                    cells = (grams & np.uint64((1 << bits) - 1)).astype(np.int64)
                    now = sketch[cells]
                    sketch[cells] = now + (now < 65535)
                    lane ^= c
            k = len(out_id)
            yield table_batch(_MEMBERS, doc_id=out_id, **{"class": out_class}, n=out_n, block=[None] * k, cells=[None] * k, counts=[None] * k, more=[None] * k)
        step = (1 << bits) // SKETCH_BLOCKS
        lane = mixed(np.array([lane], np.uint64))[0] if lane is not None else 0
        for b in range(SKETCH_BLOCKS):
            part = sketch[b * step : (b + 1) * step]
            cells, high = np.flatnonzero(part), np.flatnonzero(part > 3)
            more = np.stack((high, part[high] - 3), 1).astype(np.uint32).tobytes() if len(high) else None
            part = np.minimum(part, 3).astype(np.uint8)
            if 8 * len(cells) > step:  # two bits for each cell; below, four bytes for each cell in use
                cells, counts = None, (part[0::4] | part[1::4] << 2 | part[2::4] << 4 | part[3::4] << 6).tobytes()
            else:
                cells, counts = (cells.astype(np.uint32) << np.uint32(2) | part[cells]).tobytes(), None
            if cells or counts:
                yield table_batch(_MEMBERS, doc_id=[int(lane) >> 1], **{"class": [None]}, n=[None], block=[b], cells=[cells], counts=[counts], more=[more])

    return tidy(run)


def _sum_sketch(bits: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SKETCH_BLOCKS, np.uint32)
        for cells, counts, more, sums in zip(*(table.column(k).to_pylist() for k in ("cells", "counts", "more", "sums")), strict=True):
            if sums is not None:
                total += np.frombuffer(sums, np.uint32)
                continue
            if cells is not None:
                packed = np.frombuffer(cells, np.uint32)
                total[packed >> 2] += packed & 3
            else:
                packed = np.frombuffer(counts, np.uint8)
                for k in range(4):
                    total[k::4] += (packed >> (2 * k)) & 3
            if more is not None:
                high = np.frombuffer(more, np.uint32).reshape(-1, 2)
                total[high[:, 0]] += high[:, 1]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary()), "total": pa.array([int(total.sum(dtype=np.int64))], pa.int64())})

    return run


def _level(count: np.ndarray, mean: float) -> np.ndarray:
    """Steps of half a standard deviation of the collision noise, further up doublings: 0 to 63.

    The finer the steps, the fewer documents share their rarest tokens by a common passage alone.
    """
    steps = count / max(1.0, mean**0.5 / 2)
    with np.errstate(divide="ignore"):
        far = 40 + np.floor(np.log2(np.maximum(steps, 40) / 40) * 2)
    return np.where(steps < 40, np.floor(steps), np.minimum(far, 63)).astype(np.uint8)


def _levels(sketched: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A level for each cell, and the level from which tokens are heavy."""
    parts = sketched.withColumn("sums", F.lit(None).cast("binary"))
    lanes = sketched.where("block = 0").count() // TASKS_AT_ONCE
    if lanes:  # many tasks: their sketches are added up in two steps
        lane = F.pmod("doc_id", F.lit(lanes + 1)).cast("int").alias("lane")
        parts = parts.groupBy("block", lane).applyInArrow(_sum_sketch(bits), "block int, sums binary, total long").withColumns({k: F.lit(None).cast("binary") for k in ("cells", "counts", "more")})
    sums = staged(parts.select("block", "cells", "counts", "more", "sums").groupBy("block").applyInArrow(_sum_sketch(bits), "block int, sums binary, total long"))
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    schema = pa.schema([("block", pa.int32()), ("levels", pa.binary())])

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield table_batch(schema, block=[block], levels=[_level(np.frombuffer(data, np.uint32), mean).tobytes()])

    step = (1 << bits) // SKETCH_BLOCKS
    level = np.zeros(1 << bits, np.uint8)
    for row in sums.select("block", "sums").mapInArrow(run, "block int, levels binary").coalesce(4).toLocalIterator():  # one byte a cell: 16 MB at most
        level[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return level, int(_level(np.array([HEAVY]), mean)[0])


def small_size(costs: dict[int, tuple[float, float]], percent: int) -> int:
    """The boundary of least cost; costs: by size, of pairs and of single tokens, for the sizes that may be small."""
    best, best_cost, small = 0, None, 0.0
    large = sum(single for _, single in costs.values())
    for n in [0, *sorted(costs)]:
        if n:
            small += costs[n][0]
            large -= costs[n][1]
        halo = sum(single for m, (_, single) in costs.items() if m <= n and m * 100 >= percent * (n + 1))
        if best_cost is None or small + large + halo < best_cost:
            best, best_cost = n, small + large + halo
    return best


_POSTINGS = pa.schema([("bucket", pa.int32()), ("posts", pa.binary())])
#: 32 bits part the keys of a bucket; two that meet make one longer list, which loses nothing.
#: n and most, the size and the largest size of a partner, are logarithms, rounded down and up.  The top bit of class marks pairs.
_POST = np.dtype([("key", "<u4"), ("class", "<u8"), ("n", "<u2"), ("most", "<u2")])
PAIR = np.uint64(1 << 63)


def _log(sizes: np.ndarray, up: bool) -> np.ndarray:
    x = np.log(np.maximum(sizes, 1).astype(float)) * 1500
    return (np.ceil(x) if up else np.floor(x)).clip(0, 65535).astype(np.uint16)


def largest_partner(n: int, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that a set of n can link with if their first common token stands at ``place`` of it."""
    return (n - place) * (100 + percent) // percent - n


def _second_pass(n: int, percent: int, bits: int, level, heavy: int, buckets: int):
    """Postings of each class once a task, as one blob a bucket: its prefix tokens, and the pairs of a longer prefix if it may be small.

    Light keys go to the bucket of the key; those of heavy tokens to further buckets, by class.
    """

    def run(batches):
        memory, seen, held, size = WordHashes(), set(), [], 0
        levels = level.value

        def flush():
            raw = np.concatenate([k for k, *_ in held])
            many = [len(k) for k, *_ in held]
            pair = np.repeat([p for *_, p in held], many)
            key = mixed(raw)
            posts = np.empty(len(key), _POST)
            posts["key"], posts["class"] = key >> np.uint64(32), np.repeat(np.array([c for _, c, *_ in held], np.uint64), many) | (pair * PAIR)
            posts["n"] = np.repeat(_log(np.array([m for *_, m, _, _ in held]), False), many)
            posts["most"] = _log(np.concatenate([x for *_, x, _ in held]), True)
            bucket = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            apart = (raw >> np.uint64(58) >= np.uint64(heavy)) & ~pair
            bucket[apart] = buckets + (mixed(posts["class"][apart]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            posts, bucket = posts[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(posts)]))
            return table_batch(_POSTINGS, bucket=bucket[starts], posts=[posts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])

        for batch in batches:
            for _, grams in ngram_sets(column_bytes(batch, "text"), n, memory):
                m = len(grams)
                if not m or (c := set_class(grams)) in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(c)
                low = levels[(grams & np.uint64((1 << bits) - 1)).astype(np.int64)]
                keys = (low.astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
                p = m - int(least_overlap(np.int64(m), percent)) + 1
                if p + 1 < m:
                    keys = np.partition(keys, p)[: p + 1]
                keys.sort()
                most = largest_partner(m, np.arange(len(keys)), percent)
                held.append((keys[:p], c, m, most[:p], False))
                size += p
                if m <= MOST_SMALL and len(keys) > 1:
                    i, j = np.triu_indices(len(keys), 1)
                    held.append((joined([keys[i], keys[j]], 2), c, m, most[i], True))
                    size += len(i)
                if size >= FLUSH_POSTS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return tidy(run)


_LISTS = "list long, pair boolean, salt int, salts int, class long, weight long"


def _lists(buckets: int, percent: int):
    """The lists of a bucket that have two members at least, parted where sizes cannot meet; equal lists once, with their number as weight.

    A heavy token's list is whatever carries its name; its members come from many
    buckets, by bands of size that overlap.  salt parts the members of a long list.
    """

    def run(table: pa.Table) -> pa.Table:
        posts = np.concatenate([np.frombuffer(x, _POST) for x in table.column("posts").to_pylist()])
        pair, key = (posts["class"] & PAIR) > 0, posts["key"].astype(np.uint64)
        key |= pair.astype(np.uint64) << np.uint64(33)
        order = np.lexsort((posts["class"], posts["n"], key))
        posts, key = posts[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (posts["class"][1:] != posts["class"][:-1])))
        posts, key = posts[new], key[new]
        pair, own = (posts["class"] & PAIR) > 0, posts["class"] & ~PAIR
        if table.column("bucket")[0].as_py() >= buckets:
            band = np.floor(posts["n"] / (1500 * np.log(100 / percent) + 2)) if percent < 100 else posts["n"].astype(float)
            names = [mixed(mixed(key + np.uint64(1 << 40)) + (band + k).astype(np.uint64)) for k in (0, 1)]
            out = (np.concatenate(names), np.concatenate((pair, pair)), np.concatenate((own, own)), np.ones(2 * len(own), np.int64), np.full(2 * len(own), HEAVY_PARTS))
        else:
            group = np.concatenate(([True], key[1:] != key[:-1]))
            reach = np.maximum.accumulate(np.cumsum(group) * 65536 + posts["most"]) - np.cumsum(group) * 65536
            group[1:] |= posts["n"][1:] > reach[:-1]
            first = np.flatnonzero(group)
            length = np.diff(np.concatenate((first, [len(posts)])))
            many = length > 1
            two = np.flatnonzero(length == 2)  # the larger of two must reach the smaller, too
            many[two] &= posts["most"][first[two] + 1] >= posts["n"][first[two]]
            # Pairs and single tokens make lists of their own: they are weighed against each other.
            names = mixed(np.add.reduceat(mixed(own), first) + length.astype(np.uint64) + pair[first] * np.uint64(1 << 50))
            _, once, equal = np.unique(names[many], return_index=True, return_counts=True)
            weight = np.zeros(len(first), np.int64)
            weight[np.flatnonzero(many)[once]] = equal
            rows = np.repeat(weight > 0, length)
            out = (np.repeat(names, length)[rows], pair[rows], own[rows], np.repeat(weight, length)[rows], np.repeat(-(-length // LIST_PART), length)[rows])
        names, pair, own, weight, salts = out
        give_back()
        return pa.table(
            {
                "list": pa.array((names >> np.uint64(1)).astype(np.int64)),
                "pair": pa.array(pair),
                "salt": pa.array((mixed(own) % salts.astype(np.uint64)).astype(np.int32)),
                "salts": pa.array(salts.astype(np.int32)),
                "class": pa.array(own.astype(np.int64)),
                "weight": pa.array(weight),
            }
        )

    return run


_SETS = pa.schema([("class", pa.int64()), ("grams", pa.binary())])


def _picked_sets(n: int, picked):
    """The sets of the documents that the bitmap picks."""

    def run(batches):
        memory, seen = WordHashes(), set()
        bits = picked.value
        for batch in batches:
            at = np.asarray(batch.column(batch.schema.get_field_index("bit")), np.int64)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            texts = batch.filter(pa.array(keep.astype(bool)))
            classes, grams_out = [], []
            for _, grams in ngram_sets(column_bytes(texts, "text"), n, memory):
                if not len(grams) or (c := set_class(grams)) in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(c)
                classes.append(c)
                grams_out.append(short(grams))
            yield table_batch(_SETS, **{"class": classes}, grams=grams_out)

    return tidy(run)


def short(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order; the exact test compares these."""
    return (grams >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sketched(grams: np.ndarray, whole: bool = False) -> bytes:
    """The upper bits of each 48-bit hash, twelve more than number the set or all, as differences; the first byte is their number."""
    bits = 48 if whole else min(48, 12 + max(1, len(grams) - 1).bit_length())
    step = np.diff(grams >> np.uint64(48 - bits), prepend=np.uint64(0))
    kind = next(k for k in ("<u2", "<u4", "<u8") if int(step.max()) <= np.iinfo(k).max)
    return bytes([bits, int(kind[2])]) + step.astype(kind).tobytes()


def unsketched(data: bytes) -> tuple[int, np.ndarray]:
    return data[0], np.cumsum(np.frombuffer(data, f"<u{data[1]}", offset=2), dtype=np.int64)


def _with_sketches(whole: bool):
    schema = pa.schema([("class", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            yield table_batch(schema, **{"class": batch.column(0)}, sketch=[sketched(unshort(x), whole) for x in batch.column(1).to_pylist()])

    return tidy(run)


def _bitmap(bits: int):
    def run(table: pa.Table) -> pa.Table:
        part = np.zeros((1 << bits) // PICK_PARTS, np.uint8)
        part[np.asarray(table.column("bit"), np.int64) & (len(part) - 1)] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    return run


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep_a, keep_b = [], []
            for i in range(len(a)):
                both = np.sort(np.concatenate((unshort(x[i]), unshort(y[i]))))
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    keep_a.append(a[i])
                    keep_b.append(b[i])
            yield table_batch(schema, a=keep_a, b=keep_b)

    return tidy(run)


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; sets of a meet those of b by shuffle, at any size.

    Up to MOST_BROADCAST pairs reach the sets by broadcast, so only sets that a
    pair names are shuffled; more pairs are joined by shuffle.  The set of a b
    with many pairs is sent once for each part of them.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts")).where("parts > 1")
    if hubs.count() <= MOST_BROADCAST:
        hubs = F.broadcast(hubs)
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    pairs = staged(pairs.join(hubs, "b", "left").select("a", "b", part))
    one = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    named = pairs.select("b", "part").distinct()
    if pairs.count() <= MOST_BROADCAST:
        one, two = one.join(F.broadcast(pairs), "a"), two.join(F.broadcast(named), "b")
    else:
        one, two = one.hint("merge").join(pairs, "a"), two.hint("merge").join(named, "b")
    return one.join(two.hint("merge"), ["b", "part"]).select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long").distinct()


def _candidates(percent: int, every: bool):
    """Candidate links of a group whose overlap the shortened hashes do not rule out.

    Whole hashes leave the links alone.  Unless ``every``, only links between
    components, and one for each join of two: the others follow from them.
    """

    def run(table: pa.Table) -> pa.Table:
        c, n, comp, side = (np.asarray(table.column(k), np.int64).copy() for k in ("class", "n", "comp", "side"))
        _, comp = np.unique(comp, return_inverse=True)
        across = len(np.unique(side)) > 1  # only pairs of the two sides
        values = [unsketched(x) for x in table.column("sketch").to_pylist()]
        bits = np.array([b for b, _ in values])
        reach = (100 // percent).bit_length()
        out_a, out_b = [], []
        for w in np.unique(bits):  # a set meets those of its own width and of wider ones within reach
            rows = np.flatnonzero((bits >= w) & (bits <= w + reach))
            if len(rows) < 2 or not every and (comp[rows] == comp[rows[0]]).all():
                continue
            _, ids = np.unique(np.concatenate([values[k][1] >> int(bits[k] - w) for k in rows]), return_inverse=True)
            ends = np.cumsum([len(values[k][1]) for k in rows])
            starts = np.concatenate(([0], ends[:-1]))
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            for at, k in enumerate(rows):
                if bits[k] != w:
                    continue
                fit = (np.arange(len(rows)) > at) | (bits[rows] > w)
                fit &= 100 * np.minimum(n[rows], n[k]) >= percent * np.maximum(n[rows], n[k])
                if not every:
                    fit &= comp[rows] != comp[k]
                if across:
                    fit &= side[rows] != side[k]
                near = np.flatnonzero(fit)
                if not len(near):
                    continue
                own = ids[starts[at] : ends[at]]
                mark[own] = 1
                if int((ends[near] - starts[near]).sum()) * 4 < len(ids):
                    picked = np.concatenate([ids[starts[j] : ends[j]] for j in near])
                    cuts = np.concatenate(([0], np.cumsum(ends[near] - starts[near])[:-1]))
                    most = np.add.reduceat(mark[picked], cuts)
                else:
                    most = np.add.reduceat(mark[ids], starts)[near]
                mark[own] = 0
                near = near[100 * most >= percent * (n[rows[near]] + n[k] - most)]
                for j in rows[near]:
                    if not every:
                        if comp[j] == comp[k]:
                            continue
                        comp[comp == comp[j]] = comp[k]
                    out_a.append(min(c[k], c[j]))
                    out_b.append(max(c[k], c[j]))
        first = [table.column(k)[0].as_py() for k in GROUP] if table.num_rows else [0, 0, 0, 0]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), **{k: pa.array([v] * len(out_a), t) for k, v, t in zip(GROUP, first, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)}})

    return run


GROUP = ("list", "kind", "i", "j")


def _merged(placed: DataFrame) -> DataFrame:
    """The rows (list, salt, salts, class, n, comp) of lists with several components, lists of mostly the same members as one.

    A passage that texts share puts them on a list for each of its tokens.  Lists
    whose least hashed member agrees become one where that has at most twice the
    members of the longest, so every pair stays and no list grows beyond that.
    """
    lists = placed.groupBy("list").agg(F.min(F.xxhash64("class")).alias("least"), F.count("*").alias("m"), F.max("salts").alias("salts"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    lists = lists.select("list", "least", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = staged(placed.join(lists, ["list", "salt"]))
    union = rows.groupBy("least", "class").agg(F.max("m").alias("m"), F.count("*").alias("times"))
    near = staged(union.groupBy("least").agg(F.count("*").alias("members"), F.max("m").alias("m"), F.max("times").alias("times")).where("times > 1 AND members <= 2 * m").select("least", "members"))
    rows = rows.join(F.broadcast(near) if near.count() <= MOST_BROADCAST else near, "least", "left")
    salts = F.ceil(F.col("members") / LIST_PART).cast("int")
    one = rows.where("members IS NOT NULL").select(F.col("least").alias("list"), F.pmod(F.xxhash64("class"), salts).cast("int").alias("salt"), salts.alias("salts"), "class", "n", "comp").distinct()
    return staged(rows.where("members IS NULL").select("list", "salt", "salts", "class", "n", "comp").unionByName(one))


def _dealt(placed: DataFrame) -> DataFrame:
    """The rows (list, salt, salts, class, n, comp) of lists with several components, dealt into groups (list, kind, i, j).

    A list of up to BLOCK_GRAMS is one group.  In a longer one only members
    outside its largest component need the others: blocks of them meet blocks of
    that component (kind 0) and each other (kind 1); side parts what was compared.
    """
    parts = placed.groupBy("list", "comp").agg(F.sum("n").alias("g"), F.max("salts").alias("salts"))
    shape = parts.groupBy("list").agg(F.sum("g").alias("m"), F.max(F.struct("g", "comp")).alias("top"), F.count("*").alias("comps"), F.max("salts").alias("salts")).where("comps > 1")
    blocks = lambda g: F.greatest(F.ceil(g / BLOCK_GRAMS), F.lit(1)).cast("int")
    shape = shape.select("list", F.col("top.comp").alias("most"), (F.col("m") <= BLOCK_GRAMS).alias("short"), blocks(F.col("top.g")).alias("inner"), blocks(F.col("m") - F.col("top.g")).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = placed.join(shape, ["list", "salt"]).withColumn("inside", F.expr("comp = most"))
    rows = rows.withColumn("part", F.expr("pmod(xxhash64(class), IF(inside, inner, outer))").cast("int"))
    groups = F.expr("""
        CASE WHEN short THEN array(named_struct('kind', 2, 'i', 0, 'j', 0, 'side', 0))
             WHEN inside THEN transform(sequence(0, outer - 1), j -> named_struct('kind', 0, 'i', part, 'j', j, 'side', 0))
             ELSE concat(transform(sequence(0, inner - 1), i -> named_struct('kind', 0, 'i', i, 'j', part, 'side', 1)),
                         transform(sequence(0, outer - 1), o -> named_struct('kind', 1, 'i', least(part, o), 'j', greatest(part, o), 'side', part)))
        END""")
    return rows.select("list", "class", "n", "comp", F.explode(groups).alias("g")).select("list", "class", "n", "comp", "g.*")


def _compared(placed: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """The links (a, b) that the lists' blocks find, all tested exactly; see ``_candidates``."""
    dealt = staged(_dealt(_merged(placed)))

    def found(rows: DataFrame, whole: bool) -> DataFrame:
        named = staged(rows.select("class").distinct())
        own = sets.join(F.broadcast(named), "class", "left_semi") if named.count() <= MOST_BROADCAST else sets
        sketches = own.mapInArrow(_with_sketches(whole), "class long, sketch binary").hint("merge")
        rows = rows.join(sketches, "class").select(*GROUP, "class", "n", "comp", "side", "sketch")
        return staged(rows.groupBy(*GROUP).applyInArrow(_candidates(percent, every), "a long, b long, list long, kind int, i int, j int"))

    loose = found(dealt, False)
    links = staged(_exact(loose.select("a", "b").distinct(), sets, percent))
    if every:
        return links
    # Near copies share what their shortened hashes have in common by chance, so one failed candidate may
    # stand for as many as two components have pairs: such groups run once more, on whole hashes.
    again = staged(loose.join(links, ["a", "b"], "left_anti").select(*GROUP).distinct())
    if not again.limit(1).count():
        return links
    return links.unionByName(found(dealt.join(again, list(GROUP), "left_semi"), True).select("a", "b")).distinct()


def _once(sets: DataFrame) -> DataFrame:
    """One row of ``sets(class, grams)`` for each class; equal texts that several tasks pick give it more than once."""
    sets = staged(sets.withColumn("at", F.monotonically_increasing_id()))
    twice = staged(sets.groupBy("class").agg(F.min("at").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("class", "first"))
    many = twice.count()
    if many:
        sets = sets.join(F.broadcast(twice) if many <= MOST_BROADCAST else twice, "class", "left").where("first IS NULL OR first = at")
    return sets.select("class", "grams")


def _members(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None, int]:
    """(rows by class, classes, lists of classes, sets by class, boundary): what both joins start from."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    # About eight words a cell, whatever the size, up to the bound of what is broadcast.
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = min(SKETCH_BITS, max(16, int(words / 8).bit_length()))
    first = staged(docs.mapInArrow(_first_pass(n, bits), "doc_id long, class long, n long, block int, cells binary, counts binary, more binary"))
    members = first.where("block is null").select("doc_id", "class", "n")
    classes = staged(members.where("class is not null").groupBy("class").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))

    sizes = {r["size"]: (r["sets"], r["tokens"]) for r in classes.groupBy(F.least("n", F.lit(MOST_SMALL + 1)).alias("size")).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).collect()}
    if not sizes:
        return members, classes, None, None, 0
    levels, heavy = _levels(first.where("block is not null").select("doc_id", "block", "cells", "counts", "more"), bits)
    keys = {m: int(m - least_overlap(np.int64(m), percent)) + 1 for m in sizes}
    pairs = {m: (p := min(k + 1, m)) * (p - 1) / 2 for m, k in keys.items()}
    posts = sum(c * (100 - percent) / 100 + s for s, c in sizes.values()) + sum(sizes[m][0] * pairs[m] for m in sizes if m <= MOST_SMALL)
    buckets = max(12, int(posts // BUCKET_POSTS) + 1)
    posts = docs.mapInArrow(_second_pass(n, percent, bits, sc.broadcast(levels), heavy, buckets), "bucket int, posts binary")
    lists = posts.groupBy("bucket").applyInArrow(_lists(buckets, percent), _LISTS).groupBy("list", "pair", "salt", "salts", "class").agg(F.sum("weight").alias("weight"))
    lists = staged(lists.join(classes.select("class", "n"), "class"))

    by_size = lists.groupBy("list", "pair", F.least("n", F.lit(MOST_SMALL + 1)).alias("size")).agg(F.count("*").alias("c"))
    partners = by_size.withColumn("partners", F.sum("c").over(Window.partitionBy("list")) - 1).where(F.col("size") <= MOST_SMALL)
    scan = {(r["size"], r["pair"]): r["s"] for r in partners.groupBy("size", "pair").agg(F.sum(F.col("c") * F.col("partners")).alias("s")).collect()}
    costs = {m: (s * pairs[m] + LOOK * scan.get((m, True), 0), s * keys[m] + LOOK * scan.get((m, False), 0)) for m, (s, _) in sizes.items() if m <= MOST_SMALL}
    boundary = small_size(costs, percent)
    lists = lists.where(f"IF(pair, n <= {boundary}, n > {boundary} OR n * 100 >= {percent * (boundary + 1)})")

    wanted = staged(lists.select("class").distinct().join(classes, "class").select(F.xxhash64("least").alias("h")))
    bits = min(PICK_BITS[1], max(PICK_BITS[0], (8 * wanted.count()).bit_length()))
    bit = F.pmod("h", F.lit(1 << bits)).alias("bit")
    picked = np.zeros(1 << (bits - 3), np.uint8)
    step = len(picked) // PICK_PARTS
    for row in wanted.select(bit).distinct().withColumn("part", F.floor(F.col("bit") / ((1 << bits) // PICK_PARTS))).groupBy("part").applyInArrow(_bitmap(bits), "part long, bits binary").collect():
        picked[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(bytes(row["bits"]), np.uint8)
    sets = docs.select("text", F.xxhash64("doc_id").alias("h")).select("text", bit).mapInArrow(_picked_sets(n, sc.broadcast(picked)), "class long, grams binary")
    return members, classes, lists, _once(sets), boundary


def boundary_size(docs: DataFrame, n: int = 5, percent: int = 80) -> int:
    """The size up to which sets enumerate pairs, as the cost of ``docs`` sets it."""
    with scratch(docs.sparkSession):
        return _members(docs, n, percent)[4]


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row of ``docs(doc_id, text)``.

    component_id: the smallest doc_id that links reach; class_id: the smallest
    doc_id with the same set.  ``ngram_links`` lists all links between classes.
    A text that is null or has no words has an empty set, no links and its own
    id as component and class.  Repeated rows are rows of one class.  Rows whose
    doc_id is null are kept; the smallest id leaves nulls out.  Very long texts
    are read whole; their sets meet others in blocks of bounded size.  Ties in
    the order of tokens go by hash and do not change the result.  An empty table
    gives no rows.  Extra columns are ignored.  Links are tested on 48 bits of the
    64-bit hashes of the n-grams, and equal sets found by 64-bit hashes of sets.
    """
    with scratch(docs.sparkSession):
        members, classes, lists, sets, _ = _members(docs, n, percent)
        if lists is None:
            return staged(members.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")), stays=True)

        # One hub a list: the member whose tokens are most often shared.  Only pairs that share a good
        # part of a prefix are worth a test; where that misses a link, the comparison in blocks finds it.
        share = lists.groupBy("class").agg((F.sum("weight") / F.min("n")).alias("share"))
        scored = lists.join(share, "class")
        hub = scored.groupBy("list").agg(F.max(F.struct("share", F.expr("-class").alias("neg"), "n")).alias("h"), F.max("salts").alias("salts"))
        hub = hub.select("list", F.expr("-h.neg").alias("hub"), F.col("h.n").alias("hub_n"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        ratio = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n) AND class <> hub")
        star = lists.join(hub, ["list", "salt"]).where(ratio).groupBy(F.col("class").alias("a"), F.col("hub").alias("b"))
        star = star.agg(F.sum("weight").alias("shared"), F.min(F.least("n", "hub_n")).alias("n")).where(F.col("shared") * 400 >= F.col("n") * (100 - percent)).select("a", "b")
        edges = staged(_exact(staged(star), sets, percent))

        labels = components(edges)
        placed = lists.join(labels, F.col("class") == F.col("node"), "left").select("list", "salt", "salts", "class", "n", F.coalesce("comp", "class").alias("comp"))
        more = _compared(placed, sets, percent, every=False)
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))

        named = classes.join(labels, F.col("class") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "class"))
        least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = named.join(least, "comp").select("class", "component_id", F.col("least").alias("class_id"))
        out = members.join(named, "class", "left")
        return staged(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), stays=True)


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(class_a, class_b): every link between different sets of ``docs(doc_id, text)``, once, by the class_id of ``ngram_jaccard``, class_a below class_b.

    Every pair of a list is compared, so a group of m near copies costs m * m
    comparisons and as many rows as it has links: for listing links, not for
    finding groups.  Sets held only by rows without doc_id have no name and are left out.
    """
    with scratch(docs.sparkSession):
        _, classes, lists, sets, _ = _members(docs, n, percent)
        if lists is None:
            return docs.sparkSession.createDataFrame([], "class_a long, class_b long")
        links = _compared(lists.select("list", "salt", "salts", "class", "n", F.col("class").alias("comp")), sets, percent, every=True)
        one = classes.select(F.col("class").alias("a"), F.col("least").alias("x"))
        two = classes.select(F.col("class").alias("b"), F.col("least").alias("y"))
        named = links.join(one, "a").join(two, "b").where("x IS NOT NULL AND y IS NOT NULL")
        return staged(named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")), stays=True)
