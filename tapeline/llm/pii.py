"""Personal data by patterns, and by contexts learnt from them; DataFrame operations only.

Four kinds are matched directly: email, ip, card and phone. These, and long hexadecimal keys,
are the seeds of a bootstrap. A lexical pattern is what stands before an identifier: a label with
its sign ("token =", "password="), or the two words before it ("badge number"). An instance is the
identifier. Patterns and instances form a graph. In each round a pattern's score is the mean of its
different instances' scores; to a pattern, an instance is worth 1 if it is a seed, and else the
chance that one of its other patterns in the lexicon is right. All patterns of enough score and
support make the next lexicon,
until a round adds none and changes no score by a hundredth. The lexicon is a staged table. What follows a pattern of the lexicon is
personal data too, seen before or not; it is looked for in what the direct matches, blanked out
one kind after the other, leave of a text.

Places are code points. They come from splitting a text at marks put around each match, so no
rows are multiplied, and are added up in blocks, so that the work is in proportion to the number
of matches in a text. The mark is U+FFFF, a noncharacter; where a text holds one, U+FFFD is
read in its place. A null or empty text has no spans. Rows without a doc_id and repeated rows
are treated like any other. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.storage import staged

MARK, STAND_IN = "￿", "�"

# The patterns of the contract, written so that a run of letters or digits is tried once: a match begins where a
# run does or where the last match ended, and runs are never given back where giving back cannot help.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KEY = r"[0-9a-f]{16,}"
_SIGN = r"\x20?[:=#]\x20?[\"']?"
#: A label, its sign, perhaps a quotation mark, and an identifier.
LABEL = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{1,30}+" + _SIGN
_IDENTIFIER = r"(?=[A-Za-z._@+/-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9._@+/-]{4,}+"
#: No identifier is what is itself a label with an identifier of its own: that one is matched.
VALUE = _IDENTIFIER + r"(?!(?<=(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]{1,30})" + _SIGN + _IDENTIFIER + ")"
#: Two words, and an identifier or what is written like a telephone number.
WORDS = r"(?<![A-Za-z0-9_])[A-Za-z]{1,20}+\x20[A-Za-z]{1,20}+\x20"
CONTEXT = f"(?:{LABEL}{VALUE}|{WORDS}(?:{PHONE}|{VALUE}))"
_BEFORE = f"^(?:{LABEL}|{WORDS})"

#: What a pattern needs to join the lexicon: good instances, and their mean score.
SEEDS, SURE = 3, 0.6
#: The most that one pattern alone vouches for an instance.
MOST = 0.95
#: Patterns that are written into a plan; more are joined.
FEW = 1000
#: Numbers that are added up in one go.
RUN = 128

KINDS = ("email", "ip", "card", "phone")
_SPANS = "array<struct<s:int,e:int,v:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the ends of all matches: every second piece, from the second, is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of a bound array.

    An array grows by being copied, so blocks are added up apart: no array that grows is longer
    than a block, or than the number of blocks.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def block(b: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
        return F.aggregate(F.slice(lengths, b * RUN + 1, F.lit(RUN)), zero, step)

    def joined(blocks: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        before = F.aggregate(blocks, zero, step, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, before, lambda x, base: F.transform(x["out"], lambda v: v + base)))

    return _bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), block), joined)


def _spans(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): start, end and text of each match."""

    def of(pieces: Column) -> Column:
        def cut(ends: Column) -> Column:
            one = lambda i: F.struct(F.get(ends, i - 1).alias("s"), F.get(ends, i).alias("e"), F.get(pieces, i).alias("v"))
            return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)

        places = _bound(F.transform(pieces, lambda x: F.length(x)), lambda n: _bound(_running(n), cut))
        return F.when(F.size(pieces) > 2, places).otherwise(F.array().cast(_SPANS))

    return _bound(_pieces(text, pattern), of)


def _ip_valid(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _card_valid(v: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(v, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _phone_valid(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)


def _always(v: Column) -> Column:
    return F.lit(True)


#: Kind to pattern, what a text with a match must hold, and what a match must pass.
_RULES = {
    "email": (EMAIL, lambda t: t.contains("@"), _always),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _ip_valid),
    "card": (CARD, lambda t: t.rlike(CARD), _card_valid),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]"), _phone_valid),
}


def _clean(text: Column) -> Column:
    """The text without marks of its own, of the same length."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.contains(MARK), F.translate(text, MARK, STAND_IN)).otherwise(text)


def _valid_only(spans: Column, valid) -> Column:
    return F.filter(spans, lambda x: valid(x["v"]))


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (s, e, v) of each kind's valid matches, in order."""
    out = {}
    for kind, (pattern, may, valid) in _RULES.items():
        out[kind] = F.when(may(text), _valid_only(_spans(text, pattern), valid)).otherwise(F.array().cast(_SPANS))
    return out


def _value(found: Column) -> Column:
    return F.regexp_replace(found, _BEFORE, "")


def _name(found: Column) -> Column:
    """A pattern's name: the words, or the label and its sign without spaces or quotation marks, in lower case."""
    before = F.regexp_extract(found, _BEFORE, 0)
    return F.lower(F.rtrim(F.regexp_replace(before, r"\x20?([:=#])\x20?[\"']?$", "$1")))


def _is_seed(v: Column) -> Column:
    whole = lambda pattern: v.rlike(f"^(?:{pattern})$")
    base = whole(EMAIL) | (whole(IP) & _ip_valid(v)) | (whole(CARD) & _card_valid(v)) | (whole(PHONE) & _phone_valid(v))
    return base | (whole(KEY) & v.rlike("[a-f]") & v.rlike("[0-9]"))


def learnt(docs: DataFrame) -> DataFrame:
    """Staged table of the patterns whose instances are personal data, with their scores (sure).

    Scores only grow from round to round, so the lexicon does not depend on the order in which
    patterns join. Patterns of fewer instances than the lexicon asks for are left out beforehand.
    """
    text = _clean(F.col("text"))
    found = docs.select(text.alias("t")).filter(F.col("t").rlike("[0-9]"))
    found = found.select(F.explode(F.regexp_extract_all("t", F.lit(CONTEXT), F.lit(0))).alias("x"))
    # copies of a document add nothing: instances count once per pattern
    graph = found.select(_name(F.col("x")).alias("pattern"), _value(F.col("x")).alias("instance")).distinct()
    graph = staged(graph.withColumn("seed", _is_seed(F.col("instance"))), "pattern-instances")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds")).filter(F.col("n") >= SEEDS)
    sizes = staged(sizes, "pattern-sizes")
    unsure = staged(graph.filter("not seed").join(sizes, "pattern").select("pattern", "instance"), "unsure-instances")
    known, state = staged(sizes.select("pattern", F.lit(0.0).alias("sure")).limit(0), "lexicon"), None
    while True:
        doubts = known.select("pattern", (1 - F.least("sure", F.lit(MOST))).alias("doubt"))
        told = unsure.join(doubts, "pattern").groupBy("instance").agg(F.exp(F.sum(F.log("doubt"))).alias("all"))
        edges = unsure.join(staged(told, "instance-doubts"), "instance").join(doubts, "pattern", "left")
        score = 1 - F.col("all") / F.coalesce("doubt", F.lit(1.0))
        reached = edges.groupBy("pattern").agg(F.sum(score).alias("more"), F.count_if(score > 0.5).alias("good"))
        zero = F.lit(0)
        patterns = sizes.join(reached, "pattern", "left").select(
            "pattern", F.round((F.col("seeds") + F.coalesce("more", zero)) / F.col("n"), 9).alias("sure"), (F.col("seeds") + F.coalesce("good", zero)).alias("support")
        )
        known = staged(patterns.filter((F.col("support") >= SEEDS) & (F.col("sure") >= SURE)).select("pattern", "sure"), "lexicon")
        before, state = state, known.agg(F.count("*"), F.sum(F.floor(100 * F.col("sure")))).first()
        if state == before:
            return known


def lexicon(docs: DataFrame) -> list[str]:
    """The patterns of ``learnt`` in order, for looking at; operators use the table."""
    return sorted(r["pattern"] for r in learnt(docs).collect())


def _tested(rows: DataFrame, patterns: DataFrame | list[str], names: Column) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``rows``, and what tells whether a name is in the lexicon; ``names`` are those that a row asks for.

    A lexicon of up to ``FEW`` patterns is part of the plan. Beyond that, rows meet the table by
    their set of names, so that none is multiplied; rows without names get keys that meet nothing,
    dealt by their text ``t``.
    """
    few = patterns if isinstance(patterns, list) else [r["pattern"] for r in patterns.select("pattern").limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return rows, lambda name: name.isin(few) if few else F.lit(False)
    if isinstance(patterns, list):
        patterns = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    rows = rows.withColumn("names", F.array_sort(F.array_distinct(names)))
    some, key = F.size("names") > 0, F.array_join("names", MARK)
    sets = rows.filter(some).select("names").distinct()
    known = sets.select(key.alias("key"), F.explode("names").alias("pattern")).join(patterns.select("pattern"), "pattern")
    known = staged(known.groupBy("key").agg(F.collect_set("pattern").alias("known")), "known-names")
    none = F.concat(F.lit(MARK), F.xxhash64("t").cast("string"))
    rows = rows.withColumn("key", F.when(some, key).otherwise(none)).join(known, "key", "left")
    return rows, lambda name: F.coalesce(F.array_contains("known", name), F.lit(False))


def _replaced(rows: DataFrame, column: str, by: Callable[[str, Column], Column]) -> DataFrame:
    """``column`` with the valid matches of each kind replaced, one kind after the other."""
    t = F.col(column)

    def without(kind: str) -> Column:
        pattern, may, valid = _RULES[kind]
        pieces = F.transform(_pieces(t, pattern), lambda x, i: F.when((i % 2 == 1) & valid(x), by(kind, x)).otherwise(x))
        return F.when(may(t), F.array_join(pieces, "")).otherwise(t)

    for kind in KINDS:
        rows = rows.withColumn(column, without(kind))
    return rows


def detected(docs: DataFrame, patterns: DataFrame | list[str]) -> DataFrame:
    """doc_id and arrays of (s, e, v): email, ip, card, phone and context."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _clean(F.col("text")).alias("t"))
    rows = rows.select("doc_id", "t", *[x.alias(k) for k, x in base_spans(F.col("t")).items()], F.col("t").alias("rest"))
    rows = _replaced(rows, "rest", lambda kind, x: F.repeat(F.lit(STAND_IN), F.length(x)))

    def cut(x: Column) -> Column:
        value = _value(x["v"])
        return F.struct((x["e"] - F.length(value)).alias("s"), x["e"].alias("e"), value.alias("v"), _name(x["v"]).alias("name"))

    hits = F.transform(_spans(F.col("rest"), CONTEXT), cut)
    none = F.array().cast("array<struct<s:int,e:int,v:string,name:string>>")
    rows = rows.withColumn("hits", F.when(F.col("rest").rlike("[0-9]"), hits).otherwise(none)).drop("rest")
    rows, known = _tested(rows, patterns, F.col("hits.name"))
    sure = F.filter("hits", lambda x: known(x["name"]))
    context = F.transform(sure, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    return rows.select("doc_id", *KINDS, context.alias("context"))


def _written(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def masked(docs: DataFrame, patterns: DataFrame | list[str]) -> DataFrame:
    """The rows of ``docs`` with personal data replaced by the kind's name in brackets, and n_chars made to fit."""
    names = docs.columns
    t = F.col("t")
    # other columns apart: their names may be those used here
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias("row"), F.when(F.col("text").isNotNull(), _clean(F.col("text"))).alias("t"))
    rows = _replaced(rows, "t", lambda kind, x: F.lit(f"[{kind.upper()}]"))
    pieces = F.when(t.rlike("[0-9]"), _pieces(t, CONTEXT)).when(t.isNotNull(), F.array("t")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pieces", pieces)
    rows, known = _tested(rows, patterns, F.transform(F.filter("pieces", lambda x, i: i % 2 == 1), _name))

    def secret(x: Column, i: Column) -> Column:
        tag = F.concat(F.regexp_extract(x, _BEFORE, 0), F.lit("[SECRET]"))
        return F.when((i % 2 == 1) & known(_name(x)), tag).otherwise(x)

    text = F.when(F.size("pieces") > 0, F.array_join(F.transform("pieces", secret), ""))
    out = rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names])
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: spans of personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = detected(docs, learnt(docs))
    base = F.concat(*[_written(k) for k in KINDS])
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written("context")), ",").alias("spans"),
        F.size("context").cast("long").alias("n_context"),
    )
