"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most k edits leaves at least one of k+1 pieces of the item untouched. The
pieces of all items go into one multi-pattern automaton; each exact hit of a piece says where the item would have to
lie, and Myers' bit-parallel distance verifies that stretch of the document. Items are handled in blocks of at most
``block_bytes`` of text, so what a task holds does not grow with the benchmark; documents are never shuffled.

Comparison folds A-Z to lower case and every ASCII blank to a space; positions are code points of the document.

Defined results: null and empty documents match nothing; null and empty items are ignored; items shorter than
``exact_below`` code points must match exactly; repeated documents or items are reported once per row; very long
documents are searched in whole, very long items have as many pieces as their budget asks for; an empty table on either side
gives no matches. Other columns of the documents are kept by remove_contaminated().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .edits import best_match

#: Edits allowed, as a share of the item's code points.
ERROR_RATE = 0.08
#: Items with fewer code points allow no edits.
EXACT_BELOW = 40
#: Text of the items that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
_FOLD = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(text: str | None) -> str:
    return (text or "").encode().translate(_FOLD).decode()


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Folded items as (item_id, text), dealt into blocks by a hash; a block is about block_bytes, or one item."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("trim(text) <> ''")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-total // block_bytes)
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        if own:
            yield [(r["item_id"], fold(r["text"]).strip()) for r in own]


def _matcher(items: list[tuple[int, str]], error_rate: float, exact_below: int) -> Callable[[str], list[tuple[int, int, int, int]]]:
    """A function from a folded text to (item_id, distance, start, end), the best match of each item that occurs."""
    import ahocorasick

    pieces: dict[str, list[tuple[int, int]]] = {}
    budgets = []
    for at, (_, text) in enumerate(items):
        k = int(error_rate * len(text)) if len(text) >= exact_below else 0
        budgets.append(k)
        cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(text[lo:hi], []).append((at, lo))
    automaton = ahocorasick.Automaton()
    for piece, where in pieces.items():
        automaton.add_word(piece, (len(piece), where))
    if pieces:
        automaton.make_automaton()

    def match(text: str) -> list[tuple[int, int, int, int]]:
        begins: dict[int, set[int]] = {}
        for end, (size, where) in automaton.iter(text):
            for at, offset in where:
                begins.setdefault(at, set()).add(end + 1 - size - offset)
        found = []
        for at, starts in begins.items():
            item_id, item = items[at]
            k, best = budgets[at], None
            if any(s >= 0 and text.startswith(item, s) for s in starts):
                s = min(s for s in starts if s >= 0 and text.startswith(item, s))
                best = (0, s, s + len(item))
            elif k:
                lo = hi = None
                for s in [*sorted(starts), None]:  # overlapping stretches are verified as one
                    if s is not None and lo is not None and s - k <= hi:
                        hi = s + len(item) + k
                        continue
                    if lo is not None:
                        got = best_match(item, text[max(0, lo) : hi], k if best is None else best[0] - 1)
                        if got:
                            best = (got[0], max(0, lo) + got[1], max(0, lo) + got[2])
                    if s is not None:
                        lo, hi = s - k, s + len(item) + k
            if best:
                found.append((item_id, *best))
        return found

    return match


def find_matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, exact_below: int = EXACT_BELOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, end: the closest occurrence of each item in each document that has it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance long, start long, end long"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared.value, error_rate, exact_below)
            for batch in it:
                out = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for m in match(fold(t))]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def remove_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, exact_below: int = EXACT_BELOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the rows in which some item occurs."""
    spark = docs.sparkSession
    for block in item_blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared.value, error_rate, exact_below)
            for batch in it:
                yield batch.filter(pa.array([not (t and match(fold(t))) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(common.trimmed(run), docs.schema)
    return docs
