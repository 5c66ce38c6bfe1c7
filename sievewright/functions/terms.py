"""Whole-term matching against a vocabulary: a text is cut into words once, and its word n-grams are looked up.

A term is there if it stands between characters that are neither letters nor digits. A term is runs of letters and
digits with what stands between them, so it is found as an n-gram of the text's runs with their gaps; a term that ends in
another character (``t.i.``, ``demo `` with its blank) also needs that character, and one more that is no letter or digit
or the end, behind its last run. All terms of all vocabularies are looked up in one array_intersect, which hashes; the
order of the result is the order of the terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN, _GAP = "[a-z0-9]+", "[^a-z0-9]+"


def _ending(term: str) -> str:
    return re.search(r"[^a-z0-9]*$", term).group()


def with_hits(df: DataFrame, column: str, terms: list[str], name: str) -> DataFrame:
    """Adds name: the terms, in their order, that stand in the column (lower case) as whole terms; null counts as empty.

    Terms must be in lower case and begin with a letter or digit.
    """
    if wrong := [t for t in terms if not re.match(_RUN, t)]:
        raise ValueError(f"terms must begin with a letter or digit: {wrong}")
    longest = max((len(re.findall(_RUN, t)) for t in terms), default=1)
    endings = sorted({_ending(t) for t in terms} - {""})
    bare = F.regexp_replace(F.coalesce(column, F.lit("")), f"^{_GAP}", "")
    rows = df.withColumn("_bare", bare).withColumns({"_runs": F.regexp_extract_all("_bare", F.lit(_RUN), F.lit(0)), "_gaps": F.regexp_extract_all("_bare", F.lit(_GAP), F.lit(0))}).drop("_bare")
    gap, run = lambda i: F.get("_gaps", i), lambda i: F.get("_runs", i)
    rows = rows.withColumn("_g1", F.col("_runs"))

    def longer(n: int) -> Callable[[Column, Column], Column]:
        return lambda g, i: F.concat(g, gap(i + (n - 2)), run(i + (n - 1)))  # null behind the end

    def closed(n: int, ending: str) -> Callable[[Column, Column], Column]:
        more = lambda i: run(i + n).isNull() | (F.length(gap(i + (n - 1))) > len(ending))
        return lambda g, i: F.when(F.startswith(gap(i + (n - 1)), F.lit(ending)) & more(i), F.concat(g, F.lit(ending)))

    for n in range(2, longest + 1):
        rows = rows.withColumn(f"_g{n}", F.transform(f"_g{n - 1}", longer(n)))
    every = [F.col(f"_g{n}") for n in range(1, longest + 1)] + [F.transform(f"_g{n}", closed(n, ending)) for n in range(1, longest + 1) for ending in endings]
    rows = rows.withColumn("_all", F.concat(*every))
    return rows.withColumn(name, F.array_intersect(F.array(*map(F.lit, terms)), "_all")).drop("_runs", "_gaps", "_all", *(f"_g{n}" for n in range(1, longest + 1)))


def named(hits: str | Column, terms: dict[str, tuple[str, ...]] | tuple[str, ...]) -> Column:
    """Names, in the order of the vocabulary, of which a term is among the hits; a plain term is its own name."""
    found = F.col(hits) if isinstance(hits, str) else hits
    if isinstance(terms, dict):
        return F.array_compact(F.array(*(F.when(F.arrays_overlap(found, F.array(*map(F.lit, own))), F.lit(name)) for name, own in terms.items())))
    return F.array_intersect(F.array(*map(F.lit, terms)), found)
