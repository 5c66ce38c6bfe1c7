"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Everything that touches rows is a SQL expression. A generator is a regular expression whose matches become spans with
code-point positions; generators overlap on purpose (a card number is also a run of digits, a key's value also an opaque
token). Spans that satisfy the fixed rule of their kind always stay. All other candidates are scored by
gradient-boosted trees over their format and over the text on either side.

The tables hold no labelled spans, so labels are weak. Half of the training rows are candidates of a bounded sample of
documents: a cue of personal data before a span makes it right, a cue of something else (a version, an order, a
checksum) makes it wrong, and without either the strict format of its kind decides. The others are drawn up here: values
of every kind, well-formed and not, each of them next to personal, technical and plain words, so that the same value is
right in one place and wrong in another and only the context tells. A kind's threshold is the lowest score at which both
the drawn-up rows that were not fitted on and the candidates of all documents reach ``precision``; a kind for which no
score does adds nothing. Fitted trees are turned into CASE expressions, so that documents are scored where they lie,
without a shuffle.

Patterns use possessive repeats and \\G so that no text makes them backtrack; they find the same leftmost matches as the
plain forms in the contract. Positions are added up in blocks, so a text with very many matches costs no square.

Defined results: null and empty texts have no spans and stay as they are; very long texts are read whole; repeated rows
are handled one by one, and of spans that tie the first kind in KINDS is listed first; an empty table gives no rows, and
a model from the drawn-up rows alone; other columns are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents with candidates that the trees are fitted on, at most about this many.
SAMPLE_DOCS = 4000
#: Rows that are drawn up for fitting and calibration.
DRAWN_ROWS = 6000
#: Precision that a kind's threshold must reach.
PRECISION = 0.95
#: Characters of context on either side.
BEFORE, AFTER = 32, 12

#: Fixed rules of the contract: (kind, leftmost pattern). Order is the order of kinds in every listing.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Further generators: (kind, pattern).
MORE = (
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|bearer|api[_-]?key|access[_-]?key)\b)[\x20]{0,3}+[:=][\x20]{0,3}+[\"']?+[^\s\"']{6,}+[\"']?+"),
    ("opaque", r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])[0-9A-Za-z_+/-]{20,}+={0,2}+"),
    ("number", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}[0-9]{2,6}){2,5}+(?![0-9A-Za-z])"),
    ("digits", r"(?<![0-9A-Za-z.,+-])[0-9]{7,19}+(?![0-9A-Za-z])"),
    ("dotted", r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++)++(?![0-9A-Za-z])"),
    ("account", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+\b"),
)
KINDS = tuple(k for k, _ in (*BASE, *MORE))
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Words right before a span that speak of personal data, and those that speak of something else, in the four languages.
PERSONAL = r"(?i)\b(?:phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|m[oó]vil|handy|fax|mail|contact|kontakt|card|karte|carte|tarjeta|visa|iban|konto|compte|cuenta|account|ssn|passport|password|secret|token|key|login|host|addr|address|ip)[^0-9A-Za-z]{0,4}(?:(?:is|no|number|nr|ist|est|es)[^0-9A-Za-z]{1,3})?$"
TECHNICAL = r"(?i)\b(?:version|ver|release|section|chapter|figure|fig|table|page|isbn|issn|doi|order|invoice|ticket|build|commit|sha|sha1|md5|checksum|revision|licen[sc]e|price|total|line|item|serial|size|port|v)[^0-9A-Za-z]{0,4}(?:(?:is|no|number|nr)[^0-9A-Za-z]{1,3})?$"
ASSIGNED, MONEY, UNIT = r"[:=]\x20{0,3}[\"']?$", r"[$€£#]\x20?$", r"^\x20?(?:%|€|\$|kg|km|px|ms|MB|GB)"
#: Features of a candidate x (struct kind, s, e, h, before, after): name -> SQL. Those of the context come last.
FEATURES = {
    "kind": "CAST(array_position(array({kinds}), x.kind) AS DOUBLE)",
    "length": "CAST(char_length(x.h) AS DOUBLE)",
    "digits": "CAST(char_length(regexp_replace(x.h, '[^0-9]', '')) AS DOUBLE)",
    "letters": "CAST(char_length(regexp_replace(x.h, '[^A-Za-z]', '')) AS DOUBLE)",
    "groups": "CAST(size(split(x.h, '[^0-9A-Za-z]+')) AS DOUBLE)",
    "plus": "IF(startswith(x.h, '+'), 1D, 0D)",
    "dots": "CAST(char_length(regexp_replace(x.h, '[^.]', '')) AS DOUBLE)",
    "luhn": "IF({luhn}, 1D, 0D)",
    "part": "coalesce(array_max(transform(split(x.h, '[.]'), p -> try_cast(p AS DOUBLE))), -1D)",
    "upper": "CAST(char_length(regexp_replace(x.h, '[^A-Z]', '')) AS DOUBLE)",
    "personal": "IF(x.before RLIKE {personal}, 1D, 0D)",
    "technical": "IF(x.before RLIKE {technical}, 1D, 0D)",
    "assigned": "IF(x.before RLIKE {assigned}, 1D, 0D)",
    "priced": "IF(x.before RLIKE {money} OR x.after RLIKE {unit}, 1D, 0D)",
    "glued": "IF(x.before RLIKE '[0-9A-Za-z]$' OR x.after RLIKE '^[0-9A-Za-z]', 1D, 0D)",
    "digit_before": "IF(x.before RLIKE '[0-9][^A-Za-z0-9]{{0,2}}$', 1D, 0D)",
    "digit_after": "IF(x.after RLIKE '^[^A-Za-z0-9]{{0,2}}[0-9]', 1D, 0D)",
}
CONTEXT_FEATURES = ("personal", "technical", "assigned", "priced", "glued", "digit_before", "digit_after")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    doubled = "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(substr(q, i, 1) AS INT) + 1)"
    check = f"aggregate(sequence(1, length(q)), 0, (t, i) -> t + IF((length(q) - i) % 2 = 1, {doubled}, CAST(substr(q, i, 1) AS INT))) % 10 = 0"
    return f"element_at(transform(array({digits}), q -> length(q) BETWEEN 12 AND 19 AND {check}), 1)"


_DIGITS = "regexp_replace({x}.h, '[^0-9]', '')"
#: The fixed rule, and for further kinds the strict format, that a match x must satisfy.
RULES = {
    "email": "TRUE",
    "ip": f"x.h RLIKE {_literal(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}",
    "card": f"length({_DIGITS.format(x='x')}) BETWEEN 16 AND 19 AND {_luhn(_DIGITS.format(x='x'))}",
    "phone": f"length({_DIGITS.format(x='x')}) BETWEEN 8 AND 15",
    "secret": "x.h RLIKE '(?i)^(?:password|passwd|pwd|secret|token|bearer|api[_-]?key|access[_-]?key).*[:=].*(?:[0-9].*[A-Za-z]|[A-Za-z].*[0-9])'",
    "opaque": "x.h RLIKE '^AKIA[0-9A-Z]{16}$'",
    "number": "x.h RLIKE '^[(][0-9]{3}[)][ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$'",
    "digits": "FALSE",
    "dotted": "FALSE",
    "account": "x.h RLIKE '^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,6}(?: ?[0-9]{1,3})?$'",
}


_NONE = "CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT, h: STRING>>)"
#: Matches of one text that are added up in one fold.
FOLD = 256


def _matches(kind: str, pattern: str) -> str:
    """SQL for the matches of a pattern in _text: array of struct(kind, s, e, h), code points, end exclusive."""
    p, k = _literal(pattern), _literal(kind)
    step = f"struct(a.p + x.g + char_length(x.h) AS p, concat(a.o, array(struct({k} AS kind, a.p + x.g AS s, a.p + x.g + char_length(x.h) AS e, x.h AS h))) AS o)"
    fold = f"aggregate({{m}}, struct(0 AS p, {_NONE} AS o), (a, x) -> {step})"
    pairs = f"transform(regexp_extract_all(_text, {p}, 0), (h, i) -> struct(char_length(g[i]) AS g, h AS h))"
    pairs = f"element_at(transform(array(split(_text, {p}, -1)), g -> {pairs}), 1)"
    blocks = f"transform(sequence(0, CAST((size(m) - 1) DIV {FOLD} AS INT)), b -> {fold.format(m=f'slice(m, b * {FOLD} + 1, {FOLD})')})"
    moved = "transform(b.o, x -> struct(x.kind AS kind, x.s + q AS s, x.e + q AS e, x.h AS h))"
    begins = "aggregate(bs, struct(0 AS p, CAST(array() AS ARRAY<INT>) AS o), (a, b) -> struct(a.p + b.p AS p, concat(a.o, array(a.p)) AS o), a -> a.o)"
    many = f"element_at(transform(array({blocks}), bs -> flatten(zip_with(bs, {begins}, (b, q) -> {moved}))), 1)"
    return f"element_at(transform(array({pairs}), m -> CASE WHEN size(m) = 0 THEN {_NONE} WHEN size(m) <= {FOLD} THEN {fold.format(m='m')}.o ELSE {many} END), 1)"


#: What a text must have for a generator to be worth a run. Most texts have no digit, which rules out all but two kinds.
_WORTH = {
    "email": "instr(_text, '@') > 0", "phone": "_digit AND instr(_text, '+') > 0", "ip": "_digit AND _text RLIKE '[0-9][.][0-9]'", "dotted": "_digit AND _text RLIKE '[0-9][.][0-9]'",
    "card": "_digit AND _text RLIKE '[0-9](?:[ -]?[0-9]){11}'", "number": "_digit AND _text RLIKE '[0-9]{2}[^0-9A-Za-z]{1,3}[0-9]{2}'", "digits": "_digit AND _text RLIKE '[0-9]{7}'",
    "opaque": "_digit AND _text RLIKE '[0-9A-Za-z_+/-]{20}'", "account": "_digit AND _text RLIKE '[A-Z]{2}[0-9]{2}'", "secret": "(instr(_text, ':') > 0 OR instr(_text, '=') > 0) AND _text RLIKE '(?i)(?:password|passwd|pwd|secret|token|bearer|key)'",
}


def _in_context(array: str) -> str:
    return f"transform({array}, x -> struct(x.kind AS kind, x.s AS s, x.e AS e, x.h AS h, substr(_text, greatest(1, x.s - {BEFORE - 1}), least(x.s, {BEFORE})) AS before, substr(_text, x.e + 1, {AFTER}) AS after))"


def candidates(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), _text, _base (array of spans under the fixed rules) and _more (all other candidates,
    with their context) for every row of docs."""
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    out = out.withColumns({f"_{kind}": F.expr(f"IF({_WORTH[kind]}, {_matches(kind, pattern)}, {_NONE})") for kind, pattern in (*BASE, *MORE)})
    kept = ", ".join(f"filter(_{k}, x -> {RULES[k]})" for k, _ in BASE)
    failed = ", ".join([*(f"filter(_{k}, x -> NOT ({RULES[k]}) AND length(x.h) >= 5)" for k, _ in BASE), *(f"_{k}" for k, _ in MORE)])
    out = out.select("_row", "_text", F.expr(f"concat({kept})").alias("_base"), F.expr(f"concat({failed})").alias("_failed"))
    return out.select("_row", "_text", "_base", F.expr(_in_context("_failed")).alias("_more"))


def _features() -> dict[str, str]:
    fill = {"kinds": ", ".join(map(_literal, KINDS)), "luhn": _luhn(_DIGITS.format(x="x")), "personal": _literal(PERSONAL), "technical": _literal(TECHNICAL), "assigned": _literal(ASSIGNED), "money": _literal(MONEY), "unit": _literal(UNIT)}
    return {name: sql.format(**fill) for name, sql in FEATURES.items()}


def _score(model_score: str, x: str = "x") -> str:
    """SQL for the score of a candidate."""
    features = "named_struct(" + ", ".join(f"'{n}', {s}" for n, s in _features().items()) + ")"
    return f"element_at(transform(array({features}), f -> {model_score}), 1)"


_STRICT = "CASE x.kind " + " ".join(f"WHEN {_literal(k)} THEN {RULES[k]}" for k in KINDS) + " END"
#: Weak label of a candidate that stands in a document.
WEAK = f"CASE WHEN x.before RLIKE {_literal(TECHNICAL)} THEN FALSE WHEN x.before RLIKE {_literal(PERSONAL)} AND x.kind <> 'dotted' THEN TRUE ELSE {_STRICT} END"

#: Words around the values that are drawn up: (before, after, what the value is there: 1 personal, 0 not, -1 as its format says).
PLACES = (
    ("Please call ", " today", 1), ("Telefon: ", ".", 1), ("my card ", ", thanks", 1), ("contact number is ", " now", 1), ("host ", " answered", 1), ("Konto Nr. ", "\n", 1), ("login ", " ok", 1),
    ("api key ", " was sent", 1), ("la tarjeta ", " y", 1), ("version ", " of it", 0), ("order no. ", " has left", 0), ("commit ", " fixes", 0), ("ISBN ", ".", 0), ("section ", " says", 0),
    ("checksum ", " differs", 0), ("price $", " each", 0), ("build ", " ran", 0), ("page ", " and", 0), ("and the ", " in the", -1), ("(", ")", -1), ("heit und ", " der", -1), ("", " la ", -1), ("x = ", ";", -1),
)
#: Values by kind, from a number n: SQL, well-formed or not.
VALUES = {
    "ip": "concat_ws('.', n % 400, n % 251, n % 13, n % 199)", "card": "rpad(CAST(4000 + n % 999 AS STRING), 16, CAST(1234567 + n * 7919 % 8999999 AS STRING))", "phone": "concat('+', n % 97 + 1, ' ', 100 + n % 899, IF(n % 3 = 0, '', concat(' ', 1000 + n * 31 % 8999)))",
    "secret": "concat(element_at(array('password: ', 'token = ', 'secret=', 'api_key: '), n % 4 + 1), IF(n % 3 = 0, 'changeit', substr(sha1(CAST(n AS STRING)), 1, 12 + n % 28)))", "opaque": "IF(n % 4 = 0, concat('AKIA', upper(substr(md5(CAST(n AS STRING)), 1, 16))), substr(sha1(CAST(n AS STRING)), 1, 20 + n % 20))",
    "number": "IF(n % 2 = 0, concat('(', 200 + n % 700, ') ', 200 + n * 7 % 700, '-', 1000 + n * 13 % 8999), concat_ws('-', 10 + n % 89, 10 + n * 3 % 89, 1000 + n * 17 % 8999))", "digits": "rpad(CAST(1 + n % 9 AS STRING), 7 + n % 12, CAST(1234567 + n * 7919 % 8999999 AS STRING))",
    "dotted": "concat_ws('.', n % 12, n % 31, IF(n % 2 = 0, CAST(n % 7 AS STRING), NULL))", "account": "concat(element_at(array('DE', 'FR', 'ES', 'GB'), n % 4 + 1), 10 + n % 89, ' ', 1000 + n % 8999, ' ', 1000 + n * 3 % 8999, ' ', 1000 + n * 7 % 8999, IF(n % 2 = 0, ' 12', ' AB1'))",
}


def drawn_up(spark: SparkSession, n: int = DRAWN_ROWS) -> DataFrame:
    """x (a candidate with context) and label for n values of all kinds in all places."""
    places = "array(" + ", ".join(f"struct({_literal(b)} AS before, {_literal(a)} AS after, {v} AS says)" for b, a, v in PLACES) + ")"
    kinds = ", ".join(map(_literal, VALUES))
    value = "CASE kind " + " ".join(f"WHEN {_literal(k)} THEN {v}" for k, v in VALUES.items()) + " END"
    rows = spark.range(n).selectExpr("id", f"element_at(array({kinds}), CAST(id % {len(VALUES)} AS INT) + 1) AS kind", "CAST(pmod(xxhash64(id), 100003) AS INT) AS n", f"element_at({places}, CAST(pmod(xxhash64(id, 'place'), {len(PLACES)}) AS INT) + 1) AS place")
    rows = rows.selectExpr("id", "place.says AS says", f"struct(kind, char_length(place.before) AS s, 0 AS e, {value} AS h, place.before AS before, place.after AS after) AS x")
    return rows.select(F.xxhash64(F.lit("drawn"), "id").alias("_hash"), "x", F.expr(f"CASE says WHEN 1 THEN x.kind <> 'dotted' WHEN 0 THEN FALSE ELSE {_STRICT} END").alias("label"))


@dataclass
class Model:
    """score: SQL of a candidate x with features f; thresholds: least score by kind."""

    score: str
    thresholds: dict[str, float]


def _tree_sql(node, names: list[str]) -> str:
    """A fitted tree as nested CASE expressions over the struct f."""
    if node.numDescendants() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"CASE WHEN f.{names[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION, trees: int = 12, depth: int = 4) -> Model:
    """Trees from the candidates of about sample_docs documents and from drawn-up rows; thresholds from the drawn-up rows
    that were not fitted on and from the candidates of all documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark, features = docs.sparkSession, _features()
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = docs.select("text").withColumn("_hash", F.xxhash64(F.lit("pii"), "text")).where(F.pmod("_hash", F.lit(1 << 20)) <= min(1.0, sample_docs / max(total, 1)) * (1 << 20))
    met = candidates(rows).select(F.col("_row._hash").alias("_hash"), F.explode(F.expr(f"concat(_more, {_in_context('_base')})")).alias("x")).select("_hash", "x", F.expr(WEAK).alias("label"))
    met = met.orderBy("_hash", "x").limit(5 * sample_docs)
    drawn = drawn_up(spark)
    half = F.pmod(F.shiftright("_hash", 20), F.lit(2)) == 0
    seen = met.unionByName(drawn.where(half)).select("_hash", F.col("label").cast("double").alias("label"), *(F.expr(sql).alias(n) for n, sql in features.items()))
    table = seen.repartition(1).sortWithinPartitions("_hash", "label", *features).cache()
    names = list(features)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(table)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=64, subsamplingRate=1.0).fit(assembled)
    table.unpersist()
    score = " + ".join(f"{w!r}D * ({_tree_sql(t._java_obj.rootNode(), names)})" for w, t in zip(model.treeWeights, model.trees, strict=True))
    return Model(score, thresholds(score, docs, drawn.where(~half), precision))


def thresholds(score: str, docs: DataFrame, drawn: DataFrame, precision: float) -> dict[str, float]:
    """By kind, the lowest score from which on both tables are right often enough. Trees give few distinct scores, so what
    is collected is bounded by their leaves, not by the documents."""
    found = candidates(docs.select("text")).select(F.explode("_more").alias("x")).select("x", F.expr(WEAK).alias("label"), F.lit(0).alias("of"))
    both = found.unionByName(drawn.select("x", "label", F.lit(1).alias("of")))
    counts = both.groupBy(F.col("x.kind").alias("kind"), "of", F.round(F.expr(_score(score)), 4).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("right")).collect()
    out = {}
    for kind in KINDS:
        least = [_lowest([r for r in counts if r["kind"] == kind and r["of"] == of], precision) for of in (0, 1)]
        if least[1] is not None:
            out[kind] = max(x for x in least if x is not None) if least[0] is not None or not any(r["of"] == 0 and r["kind"] == kind for r in counts) else None
    return {k: v for k, v in out.items() if v is not None}


def _lowest(rows: list, precision: float) -> float | None:
    """The lowest score, above zero, from which on the share of right rows is at least ``precision``."""
    n = right = 0
    best = None
    for r in sorted(rows, key=lambda r: -r["score"]):
        n, right = n + r["n"], right + r["right"]
        if r["score"] > 0 and right >= precision * n:
            best = r["score"]
    return best


def quality(model: Model, drawn: DataFrame, docs: DataFrame) -> DataFrame:
    """source, kind, n_right (labelled so), n_found, n_both: what the model finds among drawn-up rows and the candidates
    of documents, against their labels."""
    found = candidates(docs.select("text")).select(F.explode("_more").alias("x")).select("x", F.expr(WEAK).alias("label"), F.lit("documents").alias("source"))
    both = found.unionByName(drawn.select("x", "label", F.lit("drawn up").alias("source"))).withColumn("hit", F.expr(_enough(model, f"round({_score(model.score)}, 4)")))
    return both.groupBy("source", F.col("x.kind").alias("kind")).agg(F.count_if("label").alias("n_right"), F.count_if("hit").alias("n_found"), F.count_if(F.col("hit") & F.col("label")).alias("n_both"))


def _enough(model: Model, score: str) -> str:
    least = "CASE x.kind " + " ".join(f"WHEN {_literal(k)} THEN {v!r}D" for k, v in sorted(model.thresholds.items())) + " END" if model.thresholds else "CAST(NULL AS DOUBLE)"
    return f"coalesce({score} >= {least}, FALSE)"


def _detected(docs: DataFrame, model: Model | None) -> DataFrame:
    """_row, pii_base, pii_spans and pii_text."""
    out = candidates(docs)
    extra = _NONE.replace(", h: STRING", "")
    if model and model.thresholds:
        scored = f"filter(transform(_more, x -> struct(x.kind AS kind, x.s AS s, x.e AS e, round({_score(model.score)}, 4) AS v)), x -> {_enough(model, 'x.v')})"
        out = out.withColumn("_scored", F.expr(f"IF(size(_more) = 0, CAST(array() AS ARRAY<STRUCT<kind: STRING, s: INT, e: INT, v: DOUBLE>>), {scored})"))
        inside = "y.s <= x.s AND x.e <= y.e"
        better = f"{inside} AND (y.v > x.v OR (y.v = x.v AND (y.e - y.s > x.e - x.s OR (y.e - y.s = x.e - x.s AND array_position(array({', '.join(map(_literal, KINDS))}), y.kind) < array_position(array({', '.join(map(_literal, KINDS))}), x.kind)))))"
        extra = f"transform(filter(_scored, x -> NOT exists(_base, y -> {inside}) AND NOT exists(_scored, y -> {better})), x -> struct(x.kind AS kind, x.s AS s, x.e AS e))"
    order = f"array({', '.join(map(_literal, KINDS))})"
    less = f"(l, r) -> CASE WHEN array_position({order}, l.kind) < array_position({order}, r.kind) THEN -1 WHEN array_position({order}, l.kind) > array_position({order}, r.kind) THEN 1 WHEN l.s < r.s THEN -1 WHEN l.s > r.s THEN 1 ELSE 0 END"
    out = out.withColumn("pii_base", F.expr("transform(_base, x -> struct(x.kind AS kind, x.s AS s, x.e AS e))"))
    out = out.withColumn("pii_spans", F.expr(f"array_sort(concat(pii_base, {extra}), {less})"))
    by_start = "array_sort(transform(pii_spans, x -> struct(x.s AS s, x.e AS e, x.kind AS kind)))"
    merged = f"aggregate({by_start}, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, kind: STRING>>), (m, x) -> IF(size(m) > 0 AND element_at(m, -1).e > x.s, concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).s AS s, greatest(element_at(m, -1).e, x.e) AS e, element_at(m, -1).kind AS kind))), concat(m, array(x))))"
    out = out.withColumn("_merged", F.expr(merged))
    # what stands before each span, the span's name, and after the last one the rest
    pieces = "transform(_merged, (x, i) -> concat(substr(_text, IF(i = 0, 0, _merged[greatest(i - 1, 0)].e) + 1, x.s - IF(i = 0, 0, _merged[greatest(i - 1, 0)].e)), '[', upper(x.kind), ']'))"
    whole = f"concat(array_join({pieces}, ''), substr(_text, element_at(_merged, -1).e + 1))"
    return out.select("_row", "pii_base", "pii_spans", F.expr(f"CASE WHEN size(_merged) = 0 THEN CAST(_row.text AS STRING) ELSE {whole} END").alias("pii_text"))


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with pii_base and pii_spans (arrays of struct kind, s, e; by kind as in KINDS, then start) and pii_text, the
    text with every span (overlapping ones as one) replaced by the kind in brackets. These three names win over columns
    of docs. A span inside a fixed one, or inside one of a higher score, is not listed again."""
    own = [c for c in docs.columns if c not in ("pii_base", "pii_spans", "pii_text")]
    return _detected(docs, model).select(*(F.col("_row")[c].alias(c) for c in own), "pii_base", "pii_spans", "pii_text")


def joined(spans: str) -> str:
    """SQL for spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, same columns, with the spans in text replaced; n_chars follows the text where there is such a column."""
    new = {"text": F.col("pii_text")}
    if "n_chars" in docs.columns:
        changed = F.size("pii_spans") > 0
        new["n_chars"] = F.when(changed, F.char_length("pii_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return _detected(docs, model).select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
