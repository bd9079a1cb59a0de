"""Exact substring de-duplication by suffix order and longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidelens.llm._shared import materialise, need

LENGTH = 400
#: Snippets of one key compared in one task, starts of a block at each narrower level, text positions sorted at a time, window starts scanned at a time.
GROUP, LEVELS, SORTED, SCANNED = 128, (32, 4, 1), 1 << 20, 1 << 19
BASE, PRIME, BITS, SEED = 0x9E3779B97F4A7C15, np.uint64((1 << 31) - 1), np.uint64(31), 11
#: Rows of a key: the snippet's name, how many there are, its text, the anchor's place in it, whether it has several.
SNIPPETS = "key bigint, snip bigint, n bigint, text binary, align int, multi boolean, doc_id bigint, th bigint, at bigint"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _modulo(x: np.ndarray) -> np.ndarray:
    """Below 2^64 to the rest by PRIME."""
    for _ in range(3):
        x = (x & PRIME) + (x >> BITS)
    return np.where(x == PRIME, np.uint64(0), x)


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _modulo(out[:more] * np.uint64(base))
        base, done = base * base % int(PRIME), done * 2
    return out


class Anchors:
    """Quick 64-bit hashes of any substrings of a text, for choosing anchors only: texts with equal hashes need not be equal."""

    def __init__(self, text: np.ndarray):
        n, letters = len(text) + 1, np.random.default_rng(SEED).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(letters[text] * np.cumprod(up)[:-1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + np.asarray(b - a).astype(np.uint64))


class Rolling:
    """Hashes of any substrings of a text: two polynomials of random base and letters modulo a prime, 62 bits together.

    (Modulo a power of two, a Thue-Morse string and its complement would have one hash whatever the base.)
    """

    def __init__(self, text: np.ndarray):
        r, n = np.random.default_rng(SEED), len(text)
        self.parts = []
        for _ in range(2):
            base, letters = int(r.integers(1 << 20, int(PRIME) - 1)), r.integers(1, int(PRIME) - 1, 256).astype(np.uint64)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_modulo(letters[text] * _powers(base, n)), out=sums[1:])
            self.parts.append((_modulo(sums), _powers(pow(base, -1, int(PRIME)), n + 1)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one, two = (_modulo((sums[b] + PRIME - sums[a]) * down[a]) for sums, down in self.parts)
        return _mix((one << BITS | two) + np.asarray(b - a).astype(np.uint64))


class Regions(NamedTuple):
    anchor: np.ndarray
    snip: np.ndarray
    at: np.ndarray
    size: np.ndarray
    align: np.ndarray
    multi: np.ndarray


def regions(text: np.ndarray, length: int) -> Regions | None:
    """Where repeated strings of ``length`` bytes must be looked for.

    Of the k-grams of each such string the one with the smallest hash (the last of equal ones) is its anchor, a
    function of the string's bytes alone, so equal strings have equal anchors at equal places. A region is the
    text of all neighbouring strings with one anchor; regions of equal anchors that overlap are one (``multi``).
    """
    k = 1 << int(np.log2(length / 4))
    windows = len(text) - length + 1
    if windows <= 0:
        return None
    firsts, places, w = [], [], length - k + 1
    roll = Anchors(text)
    for at in range(0, windows, SCANNED):
        m = min(SCANNED, windows - at)
        i = np.arange(at, at + m + w - 1)
        low = np.uint64((1 << 20) - 1)
        best = (roll(i, i + k) & ~low) | (low - (i - at).astype(np.uint64))
        done = 1
        while done * 2 <= w:
            best, done = np.minimum(best[:-done], best[done:]), done * 2
        best = np.minimum(best[:m], best[w - done : w - done + m])
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        firsts.append(first + at)
        places.append((low - (best[first] & low)).astype(np.int64) + at)
    first, place = np.concatenate(firsts), np.concatenate(places)
    new = np.r_[True, place[1:] != place[:-1]]
    first, place = first[new], place[new]
    end = np.r_[first[1:], windows] - 1 + length
    anchor = roll(place, place + k)
    order = np.lexsort((first, anchor))
    first, place, end, anchor = first[order], place[order], end[order], anchor[order]
    joined = np.r_[False, (anchor[1:] == anchor[:-1]) & (first[1:] < end[:-1])]
    head = np.flatnonzero(~joined)
    end = np.maximum.reduceat(end, head)
    first, multi = first[head], np.diff(np.r_[head, len(joined)]) > 1
    align = np.where(multi, -1, place[head] - first)
    raw = memoryview(text)
    snip = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))
    snip = _mix(snip + align.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return Regions(anchor[head].view(np.int64), snip.view(np.int64), first, (end - first).astype(np.int32), align.astype(np.int32), multi)


def _regions(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows = [], []
            for i, text in enumerate(b.column(2)):
                r = regions(np.frombuffer(text.as_buffer(), np.uint8), length)
                if r:
                    found.append(r)
                    rows.append(np.full(len(r.anchor), i))
            if found:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]], ["doc_id", "th", *Regions._fields])

    return run


def suffix_order(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their group and of the ``length`` bytes from each, equal ones by place, and for each
    place of that order whether the common prefix with the one before is all of these bytes.

    Sorted by the first eight bytes; each set of ties is then split around its first member: by the length of the
    common prefix with it (a binary search over rolling hashes) and the byte behind, until only equal strings tie.
    """
    word, roll = np.zeros(len(starts), np.uint64), Rolling(text)
    for i in range(min(8, length)):
        word = (word << np.uint64(8)) | text[starts + i]
    order = np.lexsort((starts, word, group))
    starts, g, w = starts[order], group[order], word[order]
    tie = np.r_[False, (g[1:] == g[:-1]) & (w[1:] == w[:-1])]  # with the one before, on ``known`` bytes
    known = np.full(len(starts), min(8, length))
    final = np.zeros(len(starts), bool)
    todo = np.flatnonzero(tie | np.r_[tie[1:], False])
    while len(todo):
        head = ~tie[todo]
        first = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        at, pivot, low = starts[todo], starts[todo][first], known[todo]
        high = np.full(len(todo), length)
        while True:  # the common prefix lies in [low, high]
            middle = (low + high + 1) // 2
            if (low == high).all():
                break
            same = roll(at, at + middle) == roll(pivot, pivot + middle)
            low, high = np.where(same, middle, low), np.where(same | (low == high), high, middle - 1)
        whole = low == length
        behind = np.minimum(low, length - 1)
        own, mid = text[at + behind].astype(np.int64), text[pivot + behind].astype(np.int64)
        size = 256 * (length + 1)
        place = np.where(whole, size, np.where(own < mid, low * 256 + own, size + 1 + (length - low) * 256 + own))
        # Sets are contiguous, and so are their places in the order: sort inside each.
        into = np.lexsort((at, place, first))
        starts[todo], known[todo], final[todo] = at[into], low[into] + 1, whole[into]
        place, first = place[into], first[into]
        tie[todo] = np.r_[False, (place[1:] == place[:-1]) & (first[1:] == first[:-1])]
        open_ = ~final[todo] & (tie[todo] | np.r_[tie[todo][1:], False])
        todo = todo[open_]
    return starts, tie


def previous_smaller(x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each i the last j < i of its run with x[j] < x[i], or -1; by jumps over what is known to be no smaller."""
    p = np.where(np.r_[False, run[1:] == run[:-1]], np.arange(-1, len(x) - 1), -1)
    todo = np.flatnonzero(p >= 0)
    while len(todo := todo[(p[todo] >= 0) & (x[p[todo]] >= x[todo])]):
        p[todo] = p[p[todo]]
    return p


def previous_factor(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix order whether the longest previous factor, and whether the longest next one, has
    the full length. The previous factor of a suffix starts at the previous or the next smaller start in suffix
    order; its length is the least common prefix on the way there, full only if both lie in one run of ``same``."""
    run = np.cumsum(~same)

    def reach(x: np.ndarray) -> np.ndarray:
        return (previous_smaller(x, run) >= 0) | (previous_smaller(x[::-1], run[::-1])[::-1] >= 0)

    return reach(order), reach(-order)


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of the strings at ``starts`` (ascending) as maximal intervals."""
    if not len(starts):
        return []
    head = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    last = np.r_[head[1:], len(starts)] - 1
    return list(zip(starts[head].tolist(), (starts[last] + length).tolist(), strict=True))


MARKS = "key bigint, snip bigint, whole boolean, every array<struct<a:bigint,b:bigint>>, later array<struct<a:bigint,b:bigint>>"
SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _marked(length: int) -> Callable:
    """Rows sorted by key to marks: what repeats in each snippet (``every``), and what repeats something earlier (``later``).

    A snippet that occurs more than once repeats as a whole. Keys are gathered up to SORTED positions of text and
    sorted together, apart by key.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[6] is not None, r[6] or 0, r[7], r[8], r[1]))
        sizes = np.array([len(r[3]) for r in rows])
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        count = sizes - length + 1
        base = np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        owner = np.repeat(np.arange(len(rows)), count)
        starts = begin[owner] + np.arange(len(owner)) - base
        keys = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        order, same = suffix_order(text, starts, keys[owner], length)
        earlier, next_ = previous_factor(order, same)
        flag = np.zeros((2, len(text)), bool)
        flag[0][order], flag[1][order] = earlier, earlier | next_
        out = []
        for r, at, n in zip(rows, begin, count, strict=True):
            later, every = (np.flatnonzero(f[at : at + n]) for f in flag)
            whole = r[2] > 1
            if whole or len(every):
                out.append((r[0], r[1], whole, _spans(np.arange(n) if whole else every, length), _spans(later, length)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.bool_(), SPAN, SPAN], strict=True)], ["key", "snip", "whole", "every", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size > SORTED and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield solve(rows)

    return run


SUB = "key bigint, snip bigint, sub bigint, part bigint, starts array<bigint>, n bigint, text binary, align int, doc_id bigint, th bigint, at bigint"


def _narrowed(length: int, block: int) -> Callable:
    """Snippets of a key with many: the windows that start in each block of ``block`` starts, under a key of the bytes
    that all of them hold. With blocks of one start that key is the whole window, wherever it starts, and no text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, snip, n, text, align, _, doc_id, th, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.frombuffer(text, np.uint8)
                roll, count, salt = Rolling(x), len(x) - length + 1, np.uint64(key % 2**64)
                if block == 1:
                    i = np.arange(count)
                    h = _mix(roll(i, i + length) ^ salt).view(np.int64)
                    order = np.argsort(h, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
                    for starts in np.split(order, cuts[1:]):
                        out.append((key, snip, int(h[starts[0]]), 0, starts.tolist(), n * len(starts), b"", 0, doc_id, th, at + int(starts[0])))
                    continue
                # Blocks are counted from the anchor, so that equal windows are in equal blocks. Every window that starts
                # in [s, s + block) holds the bytes from s + block - 1 to s + length.
                for s in range(align % block - block, count, block):
                    a, e = max(s, 0), min(s + block, count)
                    if a < e:
                        core, part = roll(np.array([s + block - 1, a]), np.array([s + length, e - 1 + length]))
                        place = np.array([(s - align) // block, a - s], np.int64).view(np.uint64)
                        sub, part = _mix(np.array([core ^ salt, part]) ^ place * np.uint64(0x165667B19E3779F9)).view(np.int64).tolist()
                        out.append((key, snip, sub, part, [a], n, x[a : e - 1 + length].tobytes(), align - a, doc_id, th, at + a))
            if out:
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SUB.split(", ")])

    return run


def _pairs(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda x: F.struct((x["a"] + by).alias("a"), (x["b"] + by).alias("b")))


def _one(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")))


def _marks(snippets: DataFrame, length: int, level: int) -> DataFrame:
    """Marks of all snippets of keys (rows of SNIPPETS, one a key and name); keys with many are narrowed first."""
    hot = snippets.groupBy("key").agg(F.count("*").alias("snips"), F.max("multi").alias("several")).where(F.col("snips") > GROUP)
    hot = materialise(hot.drop("snips"), f"hot{level}")
    few = snippets.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_marked(length), MARKS)
    found = [materialise(few, f"marks{level}")]
    if not hot.isEmpty():
        many = materialise(snippets.join(hot, "key"), f"many{level}")
        block = max(1, min(LEVELS[level], length // 8))
        for size, rows in ((block, many.where("not several")), (1, many.where("several"))) if block > 1 else ((1, many),):
            found.append(_narrow_marks(rows.drop("several"), length, level, size))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _narrow_marks(many: DataFrame, length: int, level: int, block: int) -> DataFrame:
    sub = materialise(many.mapInArrow(_narrowed(length, block), SUB), f"narrow{level}-{block}")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "th", "at")
    if block == 1:
        named = sub.groupBy(F.col("sub").alias("key")).agg(F.sum("n").alias("n"), F.min(place).alias("first")).where("n > 1")
        back = sub.join(named.select(F.col("key").alias("sub"), "first"), "sub")
        here = place.eqNullSafe(F.col("first"))
        runs = F.transform("starts", lambda x: F.struct(x.alias("a"), (x + length).alias("b")))
        # The first of all is the first start of its row; a row with more copies of its snippet is whole anyway.
        back = back.select("key", "snip", runs.alias("every"), F.when(here, F.filter(runs, lambda x: x["a"] != F.element_at(F.col("starts"), 1))).otherwise(runs).alias("later"))
    else:
        s = sub.groupBy(F.col("sub").alias("key"), F.col("part").alias("snip")).agg(F.sum("n").alias("n"), F.any_value("text").alias("text"), F.min("align").alias("align"), F.lit(False).alias("multi"), F.min(place).alias("first"))
        total = s.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
        s = s.join(total, "key").select("key", "snip", "n", "text", "align", "multi", "first.doc_id", "first.th", "first.at")
        s = materialise(s, f"snippets{level + 1}")
        marks = _marks(s, length, level + 1).join(s.select("key", "snip", F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "th", "at").alias("first")), ["key", "snip"])
        marks = marks.select(F.col("key").alias("sub"), F.col("snip").alias("part"), "every", "later", "first")
        back = sub.join(marks, ["sub", "part"]).withColumn("by", F.element_at("starts", 1))
        back = back.select("key", "snip", _pairs(F.col("every"), F.col("by")).alias("every"), _pairs(F.when(place.eqNullSafe(F.col("first")), F.col("later")).otherwise(F.col("every")), F.col("by")).alias("later"))
    back = back.groupBy("key", "snip").agg(F.flatten(F.collect_list("every")).alias("every"), F.flatten(F.collect_list("later")).alias("later"))
    whole = F.col("n") > 1
    out = many.select("key", "snip", "n", F.octet_length("text").alias("size")).join(back, ["key", "snip"], "left").where(whole | F.col("every").isNotNull())
    nothing = F.lit([]).cast("array<struct<a:bigint,b:bigint>>")
    every = F.when(whole, _one(F.lit(0), F.col("size"))).otherwise(F.col("every"))
    return materialise(out.select("key", "snip", whole.alias("whole"), every.alias("every"), F.coalesce("later", nothing).alias("later")), f"back{level}-{block}")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, spans, kept = [], [], []
        for text, found in zip(b.column(1), b.column(2), strict=True):
            text, merged, rest, at = text.as_buffer(), [], [], 0
            for x in sorted(found.as_py() or [], key=lambda x: x["a"]):
                if merged and x["a"] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], x["b"])
                else:
                    merged.append(dict(x))
            for x in merged:
                rest.append(text[at : x["a"]])
                at = x["b"]
            rest.append(text[at:])
            sizes.append(len(text))
            spans.append(merged)
            kept.append(b"".join(rest))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, SPAN), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs`` (``doc_id``, ``text``, as UTF-8 bytes; null: empty).

    ``spans`` are the maximal runs of bytes covered by a string of ``length`` bytes that also starts elsewhere, in
    the same document or another, and ``kept`` the other bytes. With ``keep="first"`` only strings count that
    start earlier as well (by doc_id, then by place), so one copy stays; with "none" no copy does. Texts
    shorter than ``length`` lose nothing; rows that repeat a doc_id are documents each, those with equal text
    in no order between them; null doc_ids come first. An empty table gives an empty one.

    Equal strings have equal anchors (:func:`regions`), so only the regions of an anchor are compared. Of equal
    regions one stays, with a count; the others of an anchor are put in suffix order, in which
    longest-previous-factor arrays show what repeats. Anchors with over GROUP different regions are split by longer
    common strings, in the end by whole windows, which are only counted.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    d = need(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("th"), text.alias("text"))
    r = d.where(F.octet_length("text") >= length).mapInArrow(_regions(length), "doc_id bigint, th bigint, anchor bigint, snip bigint, at bigint, size int, align int, multi boolean")
    r = materialise(r, "regions")
    first = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "th", "at", "size", "align", "multi")
    by = materialise(r.groupBy(F.col("anchor").alias("key"), "snip").agg(F.count("*").alias("n"), F.min(first).alias("first")), "snips")
    total = by.groupBy("key").agg(F.count("*").alias("snips"), F.sum("n").alias("total"), F.max("first.multi").alias("several")).where("total > 1 or several")
    by = materialise(by.join(total, "key").select("key", "snip", "n", "first.*", ((F.col("snips") > 1) | F.col("several")).alias("compare")), "repeated")
    asked = by.where("compare").select("key", "snip", "n", "doc_id", "th", "at", "size", "align", "multi")
    of = d.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "text")
    s = asked.join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    s = s.select("key", "snip", "n", F.expr("substring(text, cast(at + 1 as int), size)").alias("text"), "align", "multi", "doc_id", "th", "at")
    # Rows that repeat a document's id and text fetch a snippet more than once.
    s = materialise(s.dropDuplicates(["key", "snip"]), "snippets")
    marks = _marks(s, length, 0).select("key", "snip", "every", "later")
    alone = by.where("not compare").select("key", "snip", _one(F.lit(0), F.col("size")).alias("every"), F.lit([]).cast("array<struct<a:bigint,b:bigint>>").alias("later"))
    marks = marks.union(alone).join(by.select("key", "snip", F.struct("doc_id", "th", "at").alias("first")), ["key", "snip"])
    marks = materialise(marks.withColumnRenamed("key", "anchor"), "marks")
    found = r.select("doc_id", "th", "anchor", "snip", "at").join(marks, ["anchor", "snip"])
    spans = F.col("every") if keep == "none" else F.when(F.struct("doc_id", "th", "at").eqNullSafe(F.col("first")), F.col("later")).otherwise(F.col("every"))
    spans = found.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.flatten(F.collect_list(_pairs(spans, F.col("at")))).alias("spans"))
    spans = materialise(spans, "spans")
    out = d.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, spans array<struct<a:bigint,b:bigint>>, kept binary")
