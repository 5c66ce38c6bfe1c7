"""SimHash near-duplicates by a binary-trie self-join over the distinct fingerprints.

A fingerprint is a path of 64 bits. Two tries are walked together, node pair by node pair; differing bits add up, and a
pair of nodes is dropped as soon as they exceed the budget. Spark deals the walk out: the 64 bits are cut into
blocks, a few more than the budget, so that two fingerprints within it agree on one block (up to three bits) or two; the
values of every such choice of blocks are the roots of separate tries over the other bits (the blocks come first). A root with more than ``node_limit``
fingerprints is split into pairs of its children, eight bits down, by Spark joins, again under the budget, until every
task holds a bounded pair of nodes; one fingerprint's copies never leave the fingerprint table.

Defined results: a null or empty text (no word) has fingerprint zero and links like any other; texts with fewer words
than a shingle use the whole sequence; repeated rows share a fingerprint; a null doc_id is ignored when the smallest
doc_id is taken; very long texts count in whole, their shingles in batches; ties between fingerprints go by value; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .collocations import bitmap, passes
from .components import connected_components, forest

#: Differing bits of two texts' word fingerprints within which their shingles are compared.
NEAR_BITS = 6
#: Parts of a shingle set whose sizes bound what two sets have in common.
PARTS = 128
#: Words of a shingle, and the share of all shingles of two texts that both have, at which the texts are near-duplicates.
SHINGLE_WORDS, SHARE = 5, 0.8
#: Distinct fingerprints of one trie root beyond which its children become tasks of their own.
NODE_LIMIT = 20_000
#: Node pairs that are held at once within a task.
FRONTIER = 200_000
#: Leaf pairs under which two nodes are compared outright.
SMALL = 256
#: Stands for a fingerprint without a label.
NO_LABEL = -(2**63)
#: A bound holds three numbers of so many bits: shingles that other candidates have as well, those that at least COMMON
#: of them have (or MOST, if these are fewer than half: then the text is not part of a dense group), and all.
PART_BITS, MOST, COMMON = 21, 2**21 - 1, 16
NO_BOUND = MOST << 2 * PART_BITS | MOST << PART_BITS
#: Bits of a bitmap for each key, where a row that is let through in vain is a long one.
EACH = 128


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z and ASCII blanks count


def _hashes(own: list[bytes], words: int, seed: int = 42) -> list[int]:
    """64-bit hashes of the word shingles, in order; fewer words than a shingle's are one shingle."""
    from xxhash import xxh64_intdigest

    if len(own) <= words:
        return [xxh64_intdigest(b" ".join(own), seed)]
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) + np.arange(len(own))
    begins = np.concatenate(([0], ends[: len(own) - words] + 1)).tolist()
    return list(map(partial(xxh64_intdigest, seed=seed), map(joined.__getitem__, map(slice, begins, ends[words - 1 :].tolist()))))


def _fingerprint(own: list[bytes], words: int, seed: int = 42) -> int:
    if not own:
        return 0
    hashes = _hashes(own, words, seed)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text."""
    return _fingerprint(_words(text), words, seed)


def word_fingerprint(own: list[bytes], seed: int = 42) -> int:
    """64-bit SimHash of the words themselves, each as heavy as its count has binary digits.

    One changed word moves one word here, but ``words`` shingles there: copies lie closer together.
    """
    if not own:
        return 0
    from xxhash import xxh64_intdigest

    counts = Counter(own)
    hashes = np.array([xxh64_intdigest(w, seed) for w in counts], "<u8")
    weight = np.fromiter((c.bit_length() for c in counts.values()), np.int64, len(counts))
    bits = weight @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits > weight.sum(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for every row of docs (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def walk(left: np.ndarray, right: np.ndarray | None, budget: int, spent: int = 0, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted, distinct 64-bit values whose bits from ``depth`` on differ in at most budget-spent.

    right None: a self-join of left, each pair once. Nodes are ranges of the sorted array; children come from counting
    zero bits in a range. The walk goes depth first over chunks of the frontier, so its memory is bounded.
    """
    own = right is None
    a, b = left, left if own else right

    def zeros(x: np.ndarray, d: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum((x >> np.uint64(63 - d)) & np.uint64(1) == 0)))

    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    stack = [(depth, *(np.array([v], np.int64) for v in (0, len(a), 0, len(b), spent)))]
    while stack:
        d, al, ah, bl, bh, used = stack.pop()
        if len(al) > FRONTIER:
            for begin in range(0, len(al), FRONTIER):
                stack.append((d, *(x[begin : begin + FRONTIER] for x in (al, ah, bl, bh, used))))
            continue
        size = (ah - al) * (bh - bl)
        done = (size <= SMALL) | (d == 64)
        if done.any():
            begins, width = np.cumsum(size[done]) - size[done], (bh - bl)[done]
            at = np.arange(int(size[done].sum())) - np.repeat(begins, size[done])
            i, j = np.repeat(al[done], size[done]) + at // np.repeat(width, size[done]), np.repeat(bl[done], size[done]) + at % np.repeat(width, size[done])
            if own:
                i, j = i[i < j], j[i < j]
            mask = np.uint64(2**64 - 1 >> depth) if depth < 64 else np.uint64(0)
            near = np.bitwise_count((a[i] ^ b[j]) & mask) <= budget - spent
            if near.any():
                yield i[near], j[near]
        if done.all():
            continue
        al, ah, bl, bh, used = (x[~done] for x in (al, ah, bl, bh, used))
        if d not in levels:
            levels[d] = zeros(a, d), (zeros(b, d) if not own else np.empty(0))
        za, zb = levels[d][0], levels[d][0] if own else levels[d][1]
        am, bm = al + za[ah] - za[al], bl + zb[bh] - zb[bl]
        same = own & (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + 1), tuple(x[~same] for x in (am, ah, bl, bm, used + 1))]
        al, ah, bl, bh, used = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ah > al) & (bh > bl) & (used <= budget)
        if keep.any():
            stack.append((d + 1, *(x[keep] for x in (al, ah, bl, bh, used))))


def hubs(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (hub, other) of the values that share a label: the hub is the one closest to their majority of bits,
    as the text that the others were copied from is."""
    order = np.argsort(label, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(order)))
    many = np.repeat(sizes > 1, sizes)
    order, sizes = order[many], sizes[sizes > 1]
    if not len(order):
        return order, order
    begins = np.cumsum(sizes) - sizes
    own = np.ascontiguousarray(values[order])
    sums = np.add.reduceat(np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64), begins, axis=0)
    most = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    best = np.lexsort((own, np.bitwise_count(own ^ most[group]), group))[begins]
    hub = order[best][group]
    return hub[hub != order], order[hub != order]


def within_bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two sets can share SHARE of their union, by their bounds. What two texts of dense groups share beyond the
    common shingles is rare, and such pairs are found by it."""
    tenths, size = round(10 * SHARE), (x & MOST) + (y & MOST)
    cx, cy = x >> PART_BITS & MOST, y >> PART_BITS & MOST
    both = np.where((cx < MOST) & (cy < MOST), np.minimum(cx, cy), np.minimum(x >> 2 * PART_BITS, y >> 2 * PART_BITS))
    return (10 + tenths) * both >= tenths * size


def lowest_neighbours(values: np.ndarray, rank: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (lowest, own) for each value that has a neighbour of lower rank: the lowest one, ties by value."""
    order = np.lexsort((values, rank))
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    best = place.copy()
    for i, j in pairs:
        np.minimum.at(best, i, place[j])
        np.minimum.at(best, j, place[i])
    own = np.flatnonzero(best != place)
    return order[best[own]], own


class Layout:
    """The order in which the bits of a fingerprint are laid out along the path of one trie: (from, to, width) from the
    top, the first ``lead`` bits being the root's."""

    def __init__(self, cuts: list[int], chosen: tuple[int, ...]):
        parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in (*chosen, *(j for j in range(len(cuts) - 1) if j not in chosen))]
        self.moves, to = [], 0
        for begin, width in parts:
            self.moves.append((begin, to, width))
            to += width
        self.lead = sum(width for _, width in parts[: len(chosen)])

    def path(self, fp: np.ndarray) -> np.ndarray:
        """Unsigned fingerprints in this order."""
        out = np.zeros(len(fp), np.uint64)
        for begin, to, width in self.moves:
            out |= ((fp >> np.uint64(64 - begin - width)) & np.uint64((1 << width) - 1)) << np.uint64(64 - to - width)
        return out

    def back(self, path: np.ndarray) -> np.ndarray:
        """Signed fingerprints of unsigned paths."""
        out = np.zeros(len(path), np.uint64)
        for begin, to, width in self.moves:
            out |= ((path >> np.uint64(64 - to - width)) & np.uint64((1 << width) - 1)) << np.uint64(64 - begin - width)
        return out.view(np.int64)


def layouts(budget: int) -> list[Layout]:
    """Layouts such that two fingerprints within the budget agree on the lead of at least one.

    Up to three bits: budget+1 blocks, of which one agrees. Beyond: budget+2 blocks, of which two agree, so that roots
    stay narrow.
    """
    n, agree = (budget + 1, 1) if budget <= 3 else (budget + 2, 2)
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [Layout(cuts, chosen) for chosen in combinations(range(n), agree)]


def trie_links(fps: DataFrame, budget: int = 3, node_limit: int = NODE_LIMIT, all_pairs: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``budget`` bits apart.

    all_pairs: every pair, each once, but for those whose fingerprints have one and the same ``label`` (a long column of
    fps, if there is one). Otherwise enough of them to connect what belongs together: each task returns, for each of its
    fingerprints, one link to the most central that it reaches, or, if fps have a long column ``rank``, to its neighbour of
    the lowest rank. A long column ``bound`` of fps leaves out pairs that can't be alike anyway (within_bounds).
    """
    if not 0 <= budget < 16:
        raise ValueError("a budget of 0 to 15 bits")
    laid = layouts(budget)

    def lay_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, own in enumerate(laid):
                path = own.path(fp)
                root = pa.array((path >> np.uint64(64 - own.lead)).view(np.int64))
                zero = pa.array(np.zeros(len(fp), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), root, root, zero, zero, pa.array(path.view(np.int64)), batch.column("label"), batch.column("bound")], names=["block", "pa", "pb", "spent", "side", "path", "label", "bound"])

    given = next((c for c in ("label", "rank") if c in fps.columns), None)
    labelled = fps.select("fp", (F.col(given) if given else F.lit(None)).cast("long").alias("label"), (F.col("bound") if "bound" in fps.columns else F.lit(None)).cast("long").alias("bound"))
    rows = labelled.where("fp IS NOT NULL").dropDuplicates(["fp"]).mapInArrow(common.trimmed(lay_out), "block int, pa long, pb long, spent int, side int, path long, label long, bound long")
    node = ["block", "pa", "pb", "spent"]
    wide = {i: x.lead for i, x in enumerate(laid)}
    found, down = None, 0
    while True:
        rows = common.written(rows, "trie")
        heavy = rows.groupBy(node).count().where(F.col("count") > node_limit).select(node)
        heavy = common.written(heavy, "heavy")
        some, last = not heavy.isEmpty(), down + 8 > 64 - max(wide.values())
        light = rows if last or not some else rows.join(heavy, node, "left_anti")
        got = _compared(light, laid, down, budget, all_pairs)
        found = got if found is None else found.unionByName(got)
        if last or not some:
            break
        begin = F.create_map(*(F.lit(x) for kv in wide.items() for x in kv))[F.col("block")] + F.lit(down)
        split = rows.join(heavy, node, "left_semi").withColumn("child", F.shiftrightunsigned(F.call_function("shiftleft", F.col("path"), begin), 56))
        split = common.written(split, "children")
        kids = split.groupBy(*node, "side", "child").agg(F.count(F.lit(1)).alias("n"))
        x = kids.where("side = 0").select(*node, F.col("child").alias("ca"))
        y = kids.where((F.col("side") == 1) | (F.col("pa") == F.col("pb"))).select(*node, F.col("child").alias("cb"))
        apart = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
        pairs = x.join(y, node).where(((F.col("pa") != F.col("pb")) | (F.col("ca") <= F.col("cb"))) & (F.col("spent") + apart <= budget)).withColumn("more", apart)
        new = [F.xxhash64("pa", "ca").alias("pa"), F.xxhash64("pb", "cb").alias("pb"), (F.col("spent") + F.col("more")).alias("spent")]
        left = split.where("side = 0").withColumnRenamed("child", "ca").join(pairs, [*node, "ca"]).select("block", *new, F.lit(0).alias("side"), "path", "label", "bound")
        right = split.where((F.col("side") == 1) | (F.col("pa") == F.col("pb"))).withColumnRenamed("child", "cb").join(pairs, [*node, "cb"]).where((F.col("pa") != F.col("pb")) | (F.col("ca") != F.col("cb"))).select("block", *new, F.lit(1).alias("side"), "path", "label", "bound")
        rows, down = left.unionByName(right), down + 8
    return found.distinct()


def _compared(rows: DataFrame, laid: list[Layout], down: int, budget: int, all_pairs: bool) -> DataFrame:
    """Walks every node pair of rows; the rows of a node pair lie together in their partition's order."""
    node = ["block", "pa", "pb", "spent"]

    leads = [x.back(np.array([~((1 << 64 - x.lead) - 1) & (1 << 64) - 1], np.uint64))[0] for x in laid]

    def anew(x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The pairs that agree on the lead of no earlier block, where they were found already."""
        new = np.ones(len(x), bool)
        for b in range(int(block.max(initial=0))):
            new &= (b >= block) | (((x ^ y) & leads[b]) != 0)
        return new

    def open_(i: np.ndarray, j: np.ndarray, label: np.ndarray, bound: np.ndarray) -> np.ndarray:
        apart = (label[i] != label[j]) | (label[i] == NO_LABEL) if all_pairs else True
        return apart & within_bounds(bound[i], bound[j])

    def back(v: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        for b in np.unique(block):
            own = block == b
            out[own] = laid[b].back(v[own])
        return out

    def large(block: int, spent: int, path: np.ndarray, side: np.ndarray, label: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((path, side))
        values, label, bound, n = path[order], label[order], bound[order], int((side == 0).sum())
        a, b = values[:n], values[n:]
        shift = n if len(b) else 0
        pairs = ((i, j + shift) for i, j in walk(a, b if len(b) else None, budget, spent, min(64, laid[block].lead + down)))
        pairs = ((i[new], j[new]) for i, j in pairs if (new := open_(i, j, label, bound)).any())
        if all_pairs:
            got = list(pairs)
            i, j = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in (0, 1))
        else:
            i, j = lowest_neighbours(values, label, pairs) if (label != NO_LABEL).any() else hubs(values, forest(len(values), pairs))
        return values[i], values[j]

    def complete(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, pa_, pb, spent, side, path, label, bound = cols
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1]) | (spent[1:] != spent[:-1]))))
        size = np.diff(np.append(new, len(block)))
        group = np.repeat(np.arange(len(new)), size)
        few = (size <= 16) & (pa_[new] == pb[new])
        path = path.view(np.uint64)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for k in range(1, 16):  # nodes with few leaves: all their pairs, k apart
            i = np.flatnonzero((group[k:] == group[:-k]) & few[group[k:]]) if len(group) > k else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(path[i] ^ path[i + k]) <= budget]
            i = i[open_(i, i + k, label, bound)]
            x, y = back(path[i], block[i]), back(path[i + k], block[i])
            once = anew(x, y, block[i]) if all_pairs else slice(None)
            out.append((x[once], y[once]))
        for g in np.flatnonzero(~few & (size > 1)):
            own = slice(new[g], new[g] + size[g])
            x, y = large(int(block[new[g]]), int(spent[new[g]]), path[own], side[own], label[own], bound[own])
            own_layout = laid[int(block[new[g]])]
            x, y = own_layout.back(x), own_layout.back(y)
            once = anew(x, y, np.full(len(x), block[new[g]])) if all_pairs else slice(None)
            out.append((x[once], y[once]))
        x, y = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in cols[:4]]) == 0)[-1]) + 1 if any((c != c[-1]).any() for c in cols[:4]) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield from complete([c[:cut] for c in cols])
        if rest is not None and len(rest[0]):
            yield from complete(rest)

    return rows.repartition(*node).sortWithinPartitions(*node).select(*node, "side", "path", F.coalesce("label", F.lit(NO_LABEL)).alias("label"), F.coalesce("bound", F.lit(NO_BOUND)).alias("bound")).mapInArrow(common.trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, its own included) for every row of docs.

    A fingerprint goes by its smallest doc_id while components are found, so their smallest node is the answer.
    """
    prints = common.written(fingerprints(docs, words), "fingerprints")
    low = F.lit(NO_LABEL)
    name = F.concat(F.when(F.col("root").isNull(), "n").otherwise("d"), F.lpad(F.hex(F.coalesce("root", "fp").bitwiseXOR(low)), 16, "0"))  # in the order of the numbers
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("root")).select("fp", name.alias("node")), "distinct")
    links = trie_links(distinct, budget)
    a, b = (distinct.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}")) for c in "ab")
    label = connected_components(links.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    known = distinct.join(label, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    number = F.conv(F.substring("c", 2, 16), 16, -10).cast("long").bitwiseXOR(low)
    return prints.join(known, "fp").select("doc_id", "fp", F.when(F.col("c").startswith("d"), number).alias("component_id"))


def forms(docs: DataFrame) -> DataFrame:
    """doc_id, row, fp (of the words) and form for every row of docs (doc_id, text, row): texts of one form have the same
    words in the same order, and so the same fingerprint and shingles."""
    from xxhash import xxh3_128_hexdigest

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [(word_fingerprint(own), xxh3_128_hexdigest(b" ".join(own))) for own in map(_words, batch.column("text").to_pylist())]
            fp = np.array([g[0] for g in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp, pa.int64()), pa.array([g[1] for g in got], pa.string())], names=["doc_id", "row", "fp", "form"])

    return docs.select("doc_id", "text", "row").mapInArrow(common.trimmed(run), "doc_id long, row string, fp long, form string")


def _perhaps(key: Column, few: DataFrame) -> Column:
    """Whether the key may be that of a row of few (a written table with a column ``key`` of 64-bit hashes): false is
    certain. A bitmap of bounded size goes to the tasks, so rows that are surely not met don't move."""
    bits = few.sparkSession.sparkContext.broadcast(bitmap(few, EACH))

    @F.arrow_udf("boolean")
    def test(found: pa.Array) -> pa.Array:
        return pa.array(passes(bits.value, found.to_numpy(zero_copy_only=False).view(np.uint64)))

    return test(key)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """row, the sorted hashes of the distinct shingles (a text without words has none), a digest of them, and how many of
    them lie in each of PARTS parts (null if any part has too many for a byte), for every row of docs (text, row) that
    ``wanted`` (a written table with a column row) has, and few others. Texts don't move for that."""
    from xxhash import xxh3_128_hexdigest

    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("row").alias("key")), EACH))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(passes(bits.value, batch.column("key").to_numpy().view(np.uint64))))
            for part in common.batches(batch):
                got = [np.unique(np.array(_hashes(own, words) if own else [], np.uint64)).view(np.int64) for own in map(_words, part.column("text").to_pylist())]
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.array(np.concatenate([*got, np.empty(0, np.int64)]), pa.int64()))
                dealt = [np.bincount((g & (PARTS - 1)).astype(np.int64), minlength=PARTS) for g in got]
                parts = [d.astype(np.int8).tolist() if d.max() < 128 else None for d in dealt]
                yield pa.RecordBatch.from_arrays([part.column("row"), sets, pa.array([xxh3_128_hexdigest(g.tobytes()) for g in got], pa.string()), pa.array(parts, pa.list_(pa.int8()))], names=["row", "shingles", "digest", "parts"])

    return docs.select("text", "row", F.xxhash64("row").alias("key")).mapInArrow(common.trimmed(run), "row string, shingles array<long>, digest string, parts array<tinyint>")


def _sent(hashes: DataFrame) -> Broadcast:
    """The bitmap of a written table with a column h, for the tasks."""
    return hashes.sparkSession.sparkContext.broadcast(bitmap(hashes.select(F.col("h").alias("key"))))


def _met(held: DataFrame, hashes: DataFrame | Broadcast, among: DataFrame | None = None) -> DataFrame:
    """id and h: the shingles of held (node, shingles) that hashes (a written table with a column h, or what _sent() made of
    it) has, and few others. among (a written table with a column id): only of the nodes that it has, and of few others. Both
    tests are one function, as a task of two holds two workers."""
    spark = held.sparkSession.sparkContext
    bits = hashes if isinstance(hashes, Broadcast) else _sent(hashes)
    few = None if among is None else spark.broadcast(bitmap(among.select(F.col("id").alias("key")), EACH))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if few is not None:
                batch = batch.filter(pa.array(passes(few.value, batch.column("id").to_numpy().view(np.uint64))))
            sets, ids = batch.column("shingles"), batch.column("id").to_numpy()
            h = sets.flatten().to_numpy()
            some = passes(bits.value, h.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.asarray(sets.value_lengths()))[some]), pa.array(h[some])], names=["id", "h"])

    return held.select(F.xxhash64("node").alias("id"), "shingles").mapInArrow(common.trimmed(run), "id long, h long")


def verified_links(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b: nodes) whose shingle sets (node, n, parts, shingles) share SHARE or more of their union.

    Two sets have no more in common than the smaller counts of their parts add up to: pairs that this leaves short are out
    before a set moves, and only sets of the pairs that are left do.
    """
    tenths = round(10 * SHARE)
    size = {c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"p_{c}")) for c in "ab"}
    enough = lambda common: (10 + tenths) * common >= tenths * (F.col("n_a") + F.col("n_b"))
    most = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda t, x: t + x)
    able = candidates.distinct().join(size["a"], "a").join(size["b"], "b").where((10 * F.least("n_a", "n_b") >= tenths * F.greatest("n_a", "n_b")) & F.coalesce(enough(most), F.lit(True)))
    able = common.written(able.select("a", "b", "n_a", "n_b"), "pairs")
    key = F.xxhash64("node").alias("key")
    used = able.select(F.col("a").alias("node")).unionByName(able.select(F.col("b").alias("node"))).select(key).distinct()
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(common.written(used, "used")))  # of bounded size; it may let more through

    def needed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(passes(bits.value, batch.column("key").to_numpy().view(np.uint64)))).select(["node", "shingles"])

    few = common.written(sets.select("node", "shingles", key).mapInArrow(common.trimmed(needed), "node string, shingles array<long>"), "used-sets")
    held = {c: few.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab"}
    both = able.join(held["a"], "a").join(held["b"], "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(enough(F.col("common"))).select("a", "b")


def near_groups(rows: DataFrame, told: DataFrame, budget: int = NEAR_BITS) -> DataFrame:
    """first (unnamed, doc_id, row) and component for every distinct form of rows (doc_id, text, row), whose forms() are
    ``told``: the smallest row of the form, and the group that near-duplicates have in common.

    Fingerprints of the words within ``budget`` bits make candidates; two texts are linked if they share SHARE or more of
    their five-word shingles, counted over the sets themselves. No pair is lost, yet a large group of copies is not
    compared pair by pair: a text of whose shingles less than SHARE occur in any other candidate has no partner and is left
    out; each of the others is first compared with the neighbour whose shingles are the most common ones, as those of the
    text are that the group was copied from; of the pairs that are not in one group by then, those are compared in full that have enough
    shingles which others have as well. In a dense group only shingles that many have count for that, as pairs that share a
    rare one are found by it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    known = common.written(told.groupBy("fp", "form").agg(first.alias("first")), "forms")
    prints = common.written(known.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct")
    tree = common.settled(lambda: trie_links(prints, budget), "tree")
    asked = common.written(tree.select(F.col("a").alias("fp")).unionByName(tree.select(F.col("b").alias("fp"))).unionByName(prints.where("n > 1").select("fp")).distinct(), "asked")
    wanted = common.written(known.join(asked, "fp", "left_semi").select("fp", "form", F.col("first.row").alias("row")), "wanted")
    # A repeated row gives the same set again; the smallest form stands for all of one fingerprint and set.
    found = shingle_sets(rows, wanted).dropDuplicates(["row"])
    sets = common.written(found.join(wanted, "row").select("fp", "form", "digest", F.size("shingles").alias("n"), "parts", "shingles"), "sets")
    nodes = sets.groupBy("fp", "digest").agg(F.min("form").alias("node"))
    node_of = common.written(sets.select("fp", "digest", "form").join(nodes, ["fp", "digest"]).select("fp", "form", "node"), "nodes")
    at = node_of.where("form = node").select("fp", "node")
    others = common.written(node_of.where("form <> node").select(F.col("form").alias("other"), F.xxhash64("form").alias("key")), "others")
    perhaps = _perhaps(F.xxhash64("form"), others.select("key"))
    alone = sets.where(perhaps).join(others, F.col("form") == F.col("other"), "left_anti")
    held = common.written(sets.where(~perhaps).unionByName(alone).withColumnRenamed("form", "node"), "held")
    each = held.select(F.explode("shingles").alias("h"))
    twice = common.written(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "twice")
    bits = _sent(twice)
    met = _met(held, bits).join(twice, "h").groupBy("id").agg(F.count(F.lit(1)).alias("met"), F.count_if(F.col("c") >= COMMON).alias("often"), F.sum("c").alias("c"))
    rank = -(F.lit(1000) * F.col("c") / F.col("n")).cast("long")
    able = held.select("fp", "node", F.col("n").cast("long").alias("n"), F.xxhash64("node").alias("id")).join(met, "id").where(10 * F.col("met") >= round(10 * SHARE) * F.col("n"))
    often = F.when(2 * F.col("often") >= F.col("n"), F.col("often"))  # null: no dense group
    able = common.written(able.select("id", "fp", "node", rank.alias("rank"), "met", often.alias("often"), "n"), "able")
    dense = F.when(F.count("often") == F.count(F.lit(1)), F.max("often")).otherwise(MOST)
    bound = F.when(F.max("n") < MOST // 2, F.max("met") * (1 << 2 * PART_BITS) + dense * (1 << PART_BITS) + F.min("n")).alias("bound")
    low = common.written(able.groupBy("fp").agg(F.min(F.struct("rank", "node")).alias("x"), bound).select("fp", F.col("x.rank").alias("rank"), F.col("x.node").alias("low"), "bound"), "low")
    ends = {c: low.select(F.col("fp").alias(c), F.col("low").alias(f"n{c}")) for c in "ab"}
    few = common.settled(lambda: trie_links(low, budget), "few").join(ends["a"], "a").join(ends["b"], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    few = few.unionByName(able.join(low.select("fp", "low"), "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))
    links = common.settled(lambda: verified_links(few, held), "links")
    label = common.settled(lambda: connected_components(links), "label")
    grouped = common.written(able.join(label, "node", "left").select("id", "fp", "node", "met", "often", "n", F.coalesce("component", "node").alias("component")), "grouped")
    whole = grouped.groupBy("fp").agg(F.min("component").alias("x"), F.max("component").alias("y"), bound).select("fp", F.when(F.col("x") == F.col("y"), F.xxhash64("x")).alias("label"), "bound")
    whole = common.written(whole, "whole")
    near = common.settled(lambda: trie_links(whole, budget, all_pairs=True), "near")
    one, other = (grouped.select(F.col("fp").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("id", "node", "component", "met", "often", "n"))) for c in "ab")
    tenths = round(10 * SHARE)
    enough = lambda x, y: (F.col("component_a") != F.col("component_b")) & ((10 + tenths) * F.least(x, y) >= tenths * (F.col("n_a") + F.col("n_b")))
    both = F.col("often_a").isNotNull() & F.col("often_b").isNotNull()
    can = enough(F.when(both, F.col("often_a")).otherwise(F.col("met_a")), F.when(both, F.col("often_b")).otherwise(F.col("met_b")))
    within = one.join(whole.where("label IS NULL").select(F.col("fp").alias("a")), "a", "left_semi").join(other.withColumn("a", F.col("b")), "a").where("node_a < node_b")
    dense = able.where("often IS NOT NULL").select("id")
    some = _met(held, bits, dense)
    rare = some.join(twice.where(F.col("c") < COMMON).select("h"), "h").join(dense, "id")
    sharing = rare.withColumnRenamed("id", "id_a").join(rare.withColumnRenamed("id", "id_b"), "h").where("id_a < id_b").select("id_a", "id_b").distinct()

    def open_() -> DataFrame:
        """Each kind of pair by a plan of its own: while a plan runs, the driver makes it anew with every stage that ends."""
        by_rare = common.written(sharing, "sharing").join(one, "id_a").join(other, "id_b").where(enough(F.col("met_a"), F.col("met_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget))
        kinds = near.join(one, "a").join(other, "b").where(can), within.where(can), by_rare
        return reduce(DataFrame.unionByName, [common.written(k.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "open") for k in kinds])

    more = common.settled(lambda: verified_links(open_(), held), "more")
    label = common.settled(lambda: connected_components(links.unionByName(more)), "label")
    named = node_of.join(label, "node", "left").select("form", F.coalesce("component", "node").alias("component"))
    return known.join(named, "form", "left").select("first", F.coalesce("component", "form").alias("component"))


def one_of_each(docs: DataFrame, budget: int = NEAR_BITS) -> DataFrame:
    """docs without near-duplicates: of each group (near_groups) the row with the smallest doc_id stays, all columns kept.

    Rows are told apart by doc_id and text: unlike texts under one doc_id or none all stay, rows that repeat both count
    once, and a row without doc_id stays only if none of its group has one. Texts stay where they are, however many rows go:
    a bitmap of the keys of rows that go or repeat tells which texts these keys must meet.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(" "), text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    told = common.written(forms(rows), "told")
    groups = common.settled(lambda: near_groups(rows, told, budget), "groups")
    kept = common.written(groups.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "kept")
    times = told.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    marks = times.join(kept.withColumn("stays", F.lit(True)), "row", "left").where("stays IS NULL OR n > 1").select("row", F.col("stays").isNotNull().alias("stays"))
    marks = common.written(marks, "marks")
    key, mark = common.fresh("row", docs), common.fresh("stays", docs)
    perhaps = _perhaps(F.xxhash64(row), marks.select(F.xxhash64("row").alias("key")))
    marked = docs.where(perhaps).withColumn(key, row).join(marks.toDF(key, mark), key, "left")
    out = docs.where(~perhaps).unionByName(marked.where(F.col(mark).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)))
    if marks.where("stays").isEmpty():
        return out
    return out.unionByName(marked.where(F.col(mark)).dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns)))
