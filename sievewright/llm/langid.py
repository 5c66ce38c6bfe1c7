"""Language identification by compression: a text belongs to the language whose dictionary compresses it best.

Each language gets a raw-content zstandard dictionary of its own text. A text is compressed once per language, in
chunks that each start from the dictionary alone, so that a long text does not come to rely on itself; the sizes are
summed over all chunks, i.e. the whole text counts. The smallest sum wins. Where the runner-up is within
``margin`` of it, the text is rejected.

Fitting reads a bounded sample of labelled rows, at most ``sample_rows`` per language in the order of a hash of doc_id.
Of their whole texts, cut into slices, those go into the dictionary that come first by a hash, up to ``dict_bytes``.

Defined results: null text or a text without any letter is ``und`` with score 0 and is rejected; so is every text if
there is nothing to learn from. Very long texts count in whole. Ties go to the language with more labelled rows, then to
the smaller name. Repeated rows are predicted once each; an empty table gives no rows. Other columns of the input are
carried along by ``classify`` unless their names clash with its own, which then win; ``known_only`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bytes of text that each language's dictionary holds.
DICT_BYTES = 96 << 10
#: Labelled rows per language that are sampled at most.
SAMPLE_ROWS = 400
#: Characters of a slice of a sampled text.
SLICE_CHARS = 2 << 10
#: Bytes that are compressed from one start of the dictionary.
CHUNK_BYTES = 8 << 10
#: The runner-up needs at least this many times more bytes, or else the text is rejected.
MARGIN = 0.001
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    """Lower-case letters, with one blank for whatever stands between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode()


def fit(docs: DataFrame, labelled: Column, dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS, slice_chars: int = SLICE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language from the labelled rows of docs (text, lang, doc_id): at most dict_bytes each.

    Rows are first thinned by a hash of doc_id to a few times the wanted number per language, then ordered by it.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, 4 * sample_rows / n)).otherwise(share)
    order = F.xxhash64(F.lit("dictionary"), F.col("doc_id").cast("string"), F.col("text"))
    thinned = rows.select("lang", "text", order.alias("_order")).where(F.pmod("_order", F.lit(1 << 20)) <= share * (1 << 20))
    sampled = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order"))).where(F.col("_rank") <= sample_rows)
    begin = F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / slice_chars).cast("int")))
    slices = sampled.select("lang", "_order", "text", begin.alias("_slice")).select("lang", F.xxhash64("_order", "_slice").alias("_place"), F.expr(f"substring(text, _slice * {slice_chars} + 1, {slice_chars})").alias("text"))
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("_place", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts: dict[str, list[bytes]] = {}
    for r in slices.withColumn("_before", before).where(F.col("_before") < 2 * dict_bytes).orderBy("lang", "_place", "text").collect():
        texts.setdefault(r["lang"], []).append(_letters(r["text"]))
    return {lang: b" ".join(own)[-dict_bytes:] for lang, own in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0]))}


def _judge(dictionaries: dict[str, bytes], margin: float, level: int, chunk_bytes: int) -> Callable[[str | None], tuple[str, float, float, bool]]:
    """A function from a text to (language, score, margin, rejected)."""
    langs = list(dictionaries)
    import zstandard as zstd

    packers = []
    for lang in langs:
        content = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        packers.append(zstd.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
    frame = 6  # bytes of a frame that say nothing about the text

    def one(text: str | None) -> tuple[str, float, float, bool]:
        if not langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        data = _letters(text)
        chunks = [data[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
        sizes = [sum(len(p.compress(c)) - frame for c in chunks) for p in packers]
        best = min(range(len(langs)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return langs[0], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        gap = (second - sizes[best]) / max(second, 1)
        return langs[best], min(1.0, 0.5 + 2 * gap), gap, gap < margin

    return one


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = 9, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Adds lang_pred, score (0 to 1), lang_margin and lang_rejected to docs."""
    added = {"lang_pred": "string", "score": "double", "lang_margin": "double", "lang_rejected": "boolean"}
    kept = [c for c in docs.columns if c not in added]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _judge(dictionaries, margin, level, chunk_bytes)
        for batch in it:
            got = list(map(one, batch.column("text").to_pylist()))
            new = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{k} {v}" for k, v in added.items())])
    return docs.select(kept).mapInArrow(run, schema)


def known_only(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = 9, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs, all columns as they are, without the rows that are rejected."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _judge(dictionaries, margin, level, chunk_bytes)
        for batch in it:
            yield batch.filter(pa.array([not one(t)[3] for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(common.trimmed(run), docs.schema)
