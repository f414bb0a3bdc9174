"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its ``k`` smallest hashes.
Documents of one shingle set are collapsed first. Two linked sets share at least half of their
retained values (the chance of less is 3e-5 at a similarity of 0.8 and 6e-7 at 0.85), so their
prefixes of ``k - k / 2 + 1`` retained values, rarest first, meet in an inverted list. A set so
small that the sketches of all sets it can be linked with hold them whole must share as much of
itself as the threshold says, and its prefix is shorter: short texts of one template meet only if
what differs between them leaves enough in common. Values of a passage that many documents share
come last and stay out of the lists of documents that are more than that passage. Lists with the
same centre form a group. Every member is compared with its centre, by the sketch of the union
and then on full sets. Members that this leaves in different components are compared among
themselves: small groups as pairs, large ones in blocks, bounded in sets and in shingles, that
return a spanning forest and never the pairs.

Nulls, empty texts and texts without words have the empty set and link with nothing; rows
without a doc_id likewise (their component is null, and they are kept). Repeated rows and
copies share one set. Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import idfilter, textbytes
from tapeline.llm.graph import components
from tapeline.llm.storage import small_batches, staged

SHINGLE = 5
K = 32
#: Groups of up to this many sets are compared as pairs, larger ones in blocks.
SMALL = 32
#: Shingles and sets in a block of a large group, on average.
BLOCK, ROWS = 400_000, 4096
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(column: pa.Array):
    """Yields each text's sorted distinct 63-bit shingle hashes, in row order."""
    data, offsets = textbytes.flat(column)
    for i, j in textbytes.chunks(offsets):
        low = textbytes.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = textbytes.words(low, offsets[i : j + 1] - offsets[i])
        word = textbytes.span_hash(low, starts, ends)
        rolled, n = np.zeros(len(word), np.uint64), len(word)
        for q in range(min(SHINGLE, n)):
            rolled[: n - q] += word[q:] * _ODD[q]
        rolled = textbytes.mix(rolled) >> np.uint64(1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                whole = sum(int(w) * int(m) for w, m in zip(word[a:b], _ODD, strict=False)) + (b - a)
                yield textbytes.mix(np.array([whole & (1 << 64) - 1], np.uint64)) >> np.uint64(1)
            else:
                yield rolled[:0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=at[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int64)))


def _sketches(batches):
    for batch in batches:
        sizes, prints, sketches = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketches.append(s[:K].copy())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(sketches)], names=["doc_id", "n_shingles", "print", "sketch"]
        )
    textbytes.tidy()


def _full_sets(words: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            some = batch.filter(pa.array(idfilter.may_contain(words, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
            for at in range(0, some.num_rows, 512):
                part = some.slice(at, 512)
                sets = list(shingle_sets(part.column(1)))
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), _lists(sets)], names=["doc_id", "print", "shingles"])
        textbytes.tidy()

    return run


def _alike(left: str, right: str, percent: int) -> F.Column:
    """Whether two sketches' estimate, taken on the sketch of the union, leaves a link possible."""
    a, b = F.col(f"{left}.sketch"), F.col(f"{right}.sketch")
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    return (100 * small >= percent * large) & (2 * shared >= F.size(union))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose full sets reach the similarity."""
    first = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s")), "a")
    both = first.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.select("a", "b", shared.alias("i"), (F.size("s") + F.size("t") - shared).alias("u")).filter(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def _forest(percent: int):
    """Compares two blocks of a group on full sets; returns links that join components, no others."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low = key[1].as_py() == key[2].as_py()
        side, comp = table["side"].to_numpy(), table["comp"].to_numpy()
        cid = table["cid"].to_numpy()
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values = lists.flatten().to_numpy()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(cid)), sizes)
        left = np.flatnonzero(side == 0)
        right = left if low else np.flatnonzero(side == 1)
        _, token, count = np.unique(values, return_inverse=True, return_counts=True)
        common = count[token] > 1
        row, token = row[common], token[common]
        token = np.unique(token, return_inverse=True)[1]
        shared = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(cid), np.int64)
        place[left] = np.arange(len(left))
        is_left = side[row] == 0
        where = np.zeros(len(cid), np.int64)
        where[right] = np.arange(len(right))
        is_right = is_left if low else ~is_left
        for t in range(0, int(token.max(initial=-1)) + 1, 2048):
            inside = (token >= t) & (token < t + 2048)
            m = np.zeros((len(left), 2048), np.float32)
            m[place[row[inside & is_left]], token[inside & is_left] - t] = 1
            n = m if low else np.zeros((len(right), 2048), np.float32)
            n[where[row[inside & is_right]], token[inside & is_right] - t] = 1
            shared += m @ n.T
        out_a, out_b = [], []
        root = {c: c for c in np.unique(comp).tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, x in enumerate(left):
            union = sizes[x] + sizes[right] - shared[i]
            for j in np.flatnonzero((100 * shared[i] >= percent * union) & (comp[right] != comp[x])):
                a, b = find(int(comp[x])), find(int(comp[right[j]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out_a.append(int(cid[x]))
                    out_b.append(int(cid[right[j]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _links(spark: SparkSession, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links a, b between classes, enough of them that the components are those of all links."""
    tokens = classes.select("cid", F.explode("sketch").alias("v"))
    spread = staged(tokens.groupBy("v").agg(F.count("*").alias("df"), F.min("cid").alias("one")).filter("df > 1").select("v", "df"), "frequent")
    found = tokens.join(spread, "v").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("common"))
    rare_first = classes.select("cid", F.size("sketch").alias("k")).join(found, "cid")
    # values that no other set retains come first; the prefix goes on with the rarest of the rest
    k = F.col("k")
    least = F.when(100 * k <= percent * K, F.ceil(percent * k / 100)).otherwise(F.floor(k / 2))
    left = F.size("common") - least + 1
    prefix = rare_first.filter(left > 0).select("cid", F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"), F.explode(F.slice("common", 1, left.cast("int"))).alias("x"))
    posts = staged(prefix.select(F.col("x.v").alias("v"), "cid", "weight"), "posts")
    centres = posts.groupBy("v").agg(F.count("*").alias("size"), F.max(F.struct("weight", -F.col("cid"))).alias("best")).filter("size > 1")
    # written before it is joined, so that the join has two plain inputs and frequent values can be split
    centres = staged(centres.select("v", (-F.col("best.col2")).alias("centre")), "centres")
    groups = staged(posts.select("v", "cid").join(centres, "v").select("centre", "cid").distinct(), "groups")

    slim = classes.select("cid", "n", "sketch")
    wanted = groups.select("cid").distinct().join(classes.select("cid", "rep", "print"), "cid")
    wanted = staged(wanted, "wanted")
    sifted = docs.select("doc_id", "text").mapInArrow(_full_sets(idfilter.build(wanted.select("rep"))), "doc_id long, print binary, shingles array<long>")
    sets = sifted.join(wanted, (sifted["doc_id"] == wanted["rep"]) & (sifted["print"] == wanted["print"])).select("cid", "shingles")
    sets = staged(sets.dropDuplicates(["cid"]), "sets")

    stars = groups.filter("centre != cid").select(F.col("centre").alias("b"), F.col("cid").alias("a"))
    stars = stars.join(slim.alias("x"), F.col("a") == F.col("x.cid")).join(slim.alias("y"), F.col("b") == F.col("y.cid"))
    links = staged(_verified(stars.filter(_alike("x", "y", percent)).select("a", "b"), sets, percent), "stars-linked")

    known = components(links)
    named = groups.join(known, groups["cid"] == known["node"], "left").select("centre", "cid", F.coalesce("component", "cid").alias("comp"))
    named = staged(named.join(slim.select("cid", "n"), "cid"), "named")
    mixed = named.groupBy("centre").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("total")).filter("lo != hi").drop("lo", "hi")
    rest = staged(named.join(staged(mixed, "mixed"), "centre"), "rest")

    small = rest.filter(F.col("size") <= SMALL).select("centre", "cid", "comp", "n")
    pairs = small.alias("x").join(small.alias("y"), "centre").filter("x.cid < y.cid and x.comp != y.comp and x.cid != centre and y.cid != centre")
    pairs = pairs.filter(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    pairs = pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    pairs = pairs.join(slim.alias("x"), F.col("a") == F.col("x.cid")).join(slim.alias("y"), F.col("b") == F.col("y.cid"))
    by_pairs = _verified(pairs.filter(_alike("x", "y", percent)).select("a", "b"), sets, percent)

    large = rest.filter(F.col("size") > SMALL).withColumn("blocks", F.ceil(F.greatest(F.col("total") / BLOCK, F.col("size") / ROWS)).cast("long"))
    large = large.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).join(sets, "cid")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    large = large.select("centre", "cid", "comp", "shingles", "block", others.alias("other"))
    large = large.select("centre", "cid", "comp", "shingles", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    by_blocks = large.groupBy("centre", "p", "q").applyInArrow(_forest(percent), "a long, b long")
    return staged(links.unionByName(by_pairs).unionByName(by_blocks), "all-links")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows are linked if ``100 * shared shingles >= percent * shingles of both``, from 80;
    ``component_id`` is the smallest doc_id reachable by links and ``kept`` marks that row. Copies
    of one doc_id are kept or not as one.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the prefix of the sketches is laid out for a similarity of 0.8 and more")
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, print binary, sketch array<long>"), "sketches")
    classes = rows.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    linked = components(_links(spark, docs, classes, percent))
    member = classes.select("print", "rep", "cid").join(linked, F.col("cid") == F.col("node"), "left").select("print", "rep", F.coalesce("component", "cid").alias("component"))
    member = staged(member, "members")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "component").select("print", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    owner = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", owner.alias("component_id"), F.coalesce(owner == F.col("doc_id"), F.lit(True)).alias("kept"))


def kept_only(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, unchanged.

    Most rows are passed without a shuffle: only those whose doc_id falls on a bit that a dropped
    one has set (a table of 2 MB at most, whatever the number of rows) are joined exactly. Rows
    travel as one struct, so that no column's name can clash.
    """
    dropped = staged(near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct(), "dropped")
    place = f"pmod(xxhash64(doc_id), {idfilter.BITS})"
    bits = dropped.select(F.expr(f"{place} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias("bit"))
    bits = F.broadcast(bits.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumns({"word": F.expr(f"{place} div 64"), "at": F.expr(f"cast({place} % 64 as int)")})
    marked = rows.join(bits, "word", "left")
    doubt = F.expr("coalesce(getbit(bits, at) = 1, false)")
    sure = marked.filter(~doubt).select("row")
    unsure = marked.filter(doubt).select("row", "doc_id").join(dropped, "doc_id", "left_anti").select("row")
    return sure.unionByName(unsure).select("row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links at a similarity of 0.85 over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
