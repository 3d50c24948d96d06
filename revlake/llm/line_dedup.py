"""Fuzzy line de-duplication, in DataFrame functions only.

A line's set are the distinct SHINGLE-byte shingles of its normalised form. All shingles are hashed; the signature are
MINIMA, each the least hash under a mask of its own (x XOR mask; the shingle whose hash lies nearest to the mask), and a
band are three of them: the 12 lines of the affine plane whose points the nine minima are, so that sets that agree in any
five minima share a band, and 72 of 126 that agree in four. Short lines, whose minima repeat each other, have further
bands of two. Lines that share a band with another line get a sketch of BITS bits, of which each shingle sets one; two of these lines are candidates if their sketches do not rule out that they are linked. Every
candidate pair is verified exactly or lies in one component already: in the first round each line meets the least line of
its bands; in round t it meets those lines of its bands whose number, a hash in [0, 1), is below STEP^t / (lines in the
band), as long as the band has lines of different components. Of the pairs that would join the same two components the one
whose sketches differ least is verified first, the others only if that did not join them. Components come from distributed
union-find, and of each the first occurrence stays.

For signatures and sketches shingles are exploded rather than kept in arrays: generated code works through them several
times faster than the interpreted array functions do. Candidates are verified in arrays of 64-bit hashes, pair by pair:
there an aggregate would have to keep a row of each shingle of each pair. Only lines over LONG bytes are exploded there too.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlake.llm.common import Stored, connected_components, packed, unpacked

SHINGLE = 8
#: Lines of at most SHORT bytes have bands of two minima besides.
SHORT = 64
#: By how much the centres of a band grow in number from round to round.
STEP = 16.0
#: Lines of more bytes are verified without arrays.
LONG = 1 << 20
MINIMA = [f"m{j}" for j in range(9)]
#: Points 3 * x + y of the lines of the affine plane of order 3: each two points lie on one line.
TRIPLES = [(3 * x, 3 * x + 1, 3 * x + 2) for x in range(3)] + [(c, 3 + (a + c) % 3, 6 + (2 * a + c) % 3) for a in range(3) for c in range(3)]
PAIRS = [(j, (j + k) % 9) for k in (1, 2) for j in range(9)]
BITS = 2048
WORDS = BITS // 64


def normalised(line: Column) -> Column:
    """Lower case, single spaces. The pattern is looked for only where there is something to replace."""
    odd = line.contains("  ")
    for c in "\t\r\f\x0b":
        odd = odd | line.contains(c)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def places_in(size: Column) -> Column:
    """How many shingles a line of `size` bytes has at most; one shorter than a shingle is one itself."""
    return F.greatest(size - (SHINGLE - 1), F.lit(1))


def once(values: list[Column], f) -> Column:
    """f(*values), each value worked out once for a row: inside a lambda an expression is worked out for each element,
    a variable is not."""
    return F.transform(F.array(F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))), lambda s: f(*(s[f"v{k}"] for k in range(len(values)))))[0]


@contextlib.contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Generated methods over 8000 bytes, which the JVM never compiles, are made as several ones meanwhile. Those that put
    a sketch's words side by side would be."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mask(j: int) -> int:
    """The j-th of masks that are spread over all 32-bit numbers, as a signed one."""
    x = (j + 1) * 0x9E3779B9 & 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def hashed(lines: DataFrame, *keep: str) -> DataFrame:
    """lines (line and what is kept) to a row of each shingle, with the line's size and the shingle's 32-bit hash."""
    each = lines.select(*keep, F.col("line").cast("binary").alias("b"))
    each = each.select(*keep, F.octet_length("b").alias("size"), "b", F.explode(F.sequence(F.lit(1), places_in(F.octet_length("b")))).alias("i"))
    return each.select(*keep, "size", F.hash(F.substring("b", F.col("i"), F.lit(SHINGLE))).alias("h"))


def minimal(lines: DataFrame) -> DataFrame:
    """lines (node, line) to (node, size, minima): a row of each node."""
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(mask(j)))).alias(m) for j, m in enumerate(MINIMA)]
    return hashed(lines, "node").groupBy("node", "size").agg(*minima)


def signed(lines: DataFrame) -> DataFrame:
    """lines (node, line), nodes once each, to (node, size, sketch)."""
    each = hashed(lines.repartition("node"), "node").select("node", "size", F.col("h").bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, h >>> 5)").alias("bit"))
    words = each.groupBy("node", "size", "word").agg(F.bit_or("bit").alias("bits"))
    sketch = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(WORDS)]
    return words.groupBy("node", "size").agg(F.array(*sketch).alias("sketch"))


def banded(signatures: DataFrame) -> DataFrame:
    """(node, band): a row of each band."""
    of = lambda at: F.xxhash64(*(F.lit(j) for j in at), *(F.col(MINIMA[j]) for j in at))
    whole, pairs = [of(at) for at in TRIPLES], [of(at) for at in PAIRS]
    bands = F.when(F.col("size") <= SHORT, F.array(*whole, *pairs)).otherwise(F.array(*whole))
    return signatures.select("node", F.explode(bands).alias("band"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, line_no, node, line) of all lines that are not blank, normalised."""
    every = docs.select("doc_id", "uid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "raw"))
    # blank ones go by the raw text: the filter would normalise every line a second time
    lines = every.where(F.ltrim("raw", F.lit(" \t\n\r\f\x0b")) != "").select("doc_id", "uid", "line_no", normalised(F.col("raw")).alias("line"))
    return lines.select("doc_id", "uid", "line_no", F.xxhash64("line").alias("node"), "line")


def marks(line: Column) -> Column:
    """16 bits of the hash of each shingle of a binary line, each once: another measure beside the sketches. Sets of marks
    differ in no more elements than the sets of shingles do, and for lines of ordinary length in hardly fewer."""
    places = F.sequence(F.lit(1), places_in(F.octet_length(line)))
    return F.array_distinct(F.transform(places, lambda i: F.shiftright(F.hash(F.substring(line, i, F.lit(SHINGLE))), 16).cast("short")))


def difference(x: str, y: str) -> Column:
    """In how many bits rows' sketches differ. One sum over arrays: as 32 terms it takes twice as long inside a join."""
    each = F.zip_with(f"sketch_{x}", f"sketch_{y}", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(each, F.lit(0), lambda n, k: n + k)


def unlike(x: str, y: str, num: int, den: int) -> Column:
    """Whether rows' sketches alone tell that sets x and y are less than num / den alike: each bit that only one sketch has
    comes from a shingle that only one line has, and sets so alike differ in (den - num) / (den + num) of their sizes' sum
    at most. Sizes are numbers of places, thus not too small. No linked pair is lost."""
    return difference(x, y) * (den + num) > (places_in(F.col(f"size_{x}")) + places_in(F.col(f"size_{y}"))) * (den - num)


def alike(line_a: Column, line_b: Column, num: int, den: int) -> Column:
    """Whether two binary lines' sets are at least num / den alike. Distinct shingles are counted only if the numbers of
    places, which are no smaller, do not tell."""
    hashes = lambda line: F.transform(F.sequence(F.lit(1), places_in(F.octet_length(line))), lambda i: F.xxhash64(F.substring(line, i, F.lit(SHINGLE))))

    def counted(x: Column, y: Column) -> Column:
        def enough(shared: Column) -> Column:
            of = lambda n: shared * (den + num) >= n * num
            return F.when(of(F.size(x) + F.size(y)), True).otherwise(of(F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))))

        return once([F.size(F.array_intersect(x, y))], enough)

    return once([line_a, line_b], lambda a, b: once([hashes(a), hashes(b)], counted))


def exploded(both: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of those of (a, b, line_a, line_b) whose sets are at least num / den alike, however long the lines are."""
    # places of both lines' shingles, those of b from its end; all of a pair lie in one task as they come from one row
    n_b = F.octet_length("line_b")
    both_places = F.concat(F.sequence(F.lit(1), places_in(F.octet_length("line_a"))), F.sequence(-n_b, places_in(n_b) - n_b - 1))
    each = both.select("a", "b", "line_a", "line_b", F.explode(both_places).alias("i"))
    shingle = F.substring(F.when(F.col("i") > 0, F.col("line_a")).otherwise(F.col("line_b")), F.col("i"), F.lit(SHINGLE))
    sides = each.select("a", "b", F.xxhash64(shingle).alias("h"), F.when(F.col("i") > 0, 1).otherwise(2).alias("side")).groupBy("a", "b", "h").agg(F.bit_or("side").alias("sides"))
    counts = sides.groupBy("a", "b").agg(F.count_if(F.col("sides") == 3).alias("shared"), F.count("*").alias("n"))
    return counts.where(F.col("shared") * den >= F.col("n") * num).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, num: int, den: int, longest: int) -> DataFrame:
    """Those of pairs (a, b), once each, whose lines' sets are at least num / den alike; texts (node, line), no line of
    more than `longest` bytes."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("line").cast("binary").alias(f"line_{x}")).hint("merge")
    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    if longest <= LONG:
        return both.where(alike(F.col("line_a"), F.col("line_b"), num, den)).select("a", "b")
    long = F.greatest(F.octet_length("line_a"), F.octet_length("line_b")) > LONG
    short = both.where(F.when(long, False).otherwise(alike(F.col("line_a"), F.col("line_b"), num, den))).select("a", "b")
    return short.unionByName(exploded(both.where(long), num, den))


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known (node, component) after more links (a, b): only the components that they join are worked out again."""
    name = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).hint("merge")
    edges = links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    edges = Stored(edges, "line-edges")
    ends = edges.df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    moved = connected_components(ends, edges.df).select(F.col("id").alias("component"), F.col("component").alias("to"))
    out = Stored(known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "line-components")
    edges.drop()
    return out


def components(lines: DataFrame, num: int, den: int) -> DataFrame:
    """lines (node, rid, line), rid unique and stored: (node, component) of the nodes that links connect to another node."""
    every = Stored(minimal(lines.select("node", "line")), "line-signatures")
    one = Window.partitionBy("band")
    bands = banded(every.df).withColumns({"m": F.count("*").over(one), "least": F.min("node").over(one)}).where("m > 1")
    found = Stored(bands, "line-found")
    every.drop()
    nodes = Stored(found.df.groupBy("node").agg(F.min("least").alias("least")), "line-nodes")
    rids = lines.select("node", "rid").join(nodes.df.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
    texts = Stored(lines.select("rid", "line").join(rids.hint("shuffle_hash"), "rid").select("node", "line"), "line-texts")
    sketches = Stored(signed(texts.df), "line-sketches")
    longest = sketches.df.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    side = lambda df, x: df.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in df.columns))
    meet = nodes.df.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    meet = meet.join(side(sketches.df, "a").hint("merge"), "a").join(side(sketches.df, "b").hint("merge"), "b").where(~unlike("a", "b", num, den))
    links = Stored(verified(meet, texts.df, num, den, longest), "line-links")
    known = Stored(connected_components(nodes.df.select(F.col("node").alias("id")), links.df).select(F.col("id").alias("node"), "component"), "line-components")
    links.drop()
    number = F.xxhash64("node", F.lit("centre")).cast("double") / 2.0**64 + 0.5
    open_ones, t = found, 0
    while True:
        # bands that have lines of different components, and lines in them that have not met
        named = open_ones.df.select("band", "node", "m").where(F.col("m") > (STEP**t if t else 1)).join(known.df.hint("merge"), "node")
        mixed = named.withColumns({"lo": F.min("component").over(one), "hi": F.max("component").over(one)}).where("lo < hi").select("band", "node", "m", "component")
        rest = Stored(mixed.join(sketches.df.hint("merge"), "node"), "line-open")
        open_ones.drop()
        open_ones, t = rest, t + 1
        if not rest.df.limit(1).count():
            break
        share = F.lit(STEP**t) / F.col("m")
        # a line that has been a centre has met all others of its band; of two centres the one with the larger id asks
        wide = rest.df.where(number >= share / STEP if t > 1 else F.lit(True)).withColumn("centre", number < share)
        by = lambda df, x: df.select("band", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("component", "centre", "size", "sketch")))
        asked = (F.col("component_a") != F.col("component_b")) & (~F.col("centre_b") | (F.col("a") > F.col("b")))
        pairs = by(wide.where("centre"), "a").join(by(wide, "b").hint("merge"), "band").where(asked).where(~unlike("a", "b", num, den))
        # a pair meets once, in whatever bands
        pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.greatest("component_a", "component_b").alias("hi"), F.least("component_a", "component_b").alias("lo")]
        pairs = Stored(pairs.select(*pair, difference("a", "b").alias("apart")).distinct(), "line-pairs")
        first = pairs.df.groupBy("hi", "lo").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
        known = linked(known, first, texts.df, num, den, longest)
        name = lambda x: known.df.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).hint("merge")  # noqa: E731, B023
        others = pairs.df.select("a", "b").join(first.hint("merge"), ["a", "b"], "left_anti").join(name("a"), "a").join(name("b"), "b").where("ca <> cb")
        known = linked(known, others, texts.df, num, den, longest)
        pairs.drop()
    out = Stored(known.df.where("node <> component"), "line-parts")
    for x in (known, open_ones, nodes, sketches, texts):
        x.drop()
    return out.df


def linked(known: Stored, pairs: DataFrame, texts: DataFrame, num: int, den: int, longest: int) -> Stored:
    """known after those of pairs (a, b) that turn out to be links; what was known before is dropped if there are any."""
    links = Stored(verified(pairs, texts, num, den, longest), "line-links")
    after = merged(known.df, links.df) if links.df.limit(1).count() else known
    links.drop()
    if after is not known:
        known.drop()
    return after


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns kept, with text replaced, and n_lines (not blank), n_removed added under those names.

    Of lines whose links of similarity >= num / den connect them, the first (by doc_id, then line) stays; blank lines
    stay where they are. Defined cases: null text stays null, with 0 lines; a row left without lines keeps empty text;
    rows equal in doc_id and text count as one and fare alike; rows without doc_id come first; an empty table gives no
    rows; columns named like the added ones are replaced, others may have any names. Lines are compared in lower case
    with single spaces.
    """
    doc_id, text = F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")
    rows = packed(docs).withColumn("uid", F.xxhash64(doc_id, text))
    lines = rows.select(doc_id.alias("doc_id"), text.alias("text"), "uid")
    lines = Stored(lines_of(lines).withColumn("rid", F.monotonically_increasing_id()), "lines")  # rid is final once stored
    with short_methods(docs.sparkSession):
        parts = components(lines.df.select("node", "rid", "line"), num, den)
    at = F.struct("doc_id", "uid", "line_no")
    # the components of several occurrences, by nodes; most lines are alone and go no further
    named = lines.df.groupBy("node").agg(F.count("*").alias("n")).join(parts.hint("merge"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    named = Stored(named, "line-named")
    several = named.df.groupBy("component").agg(F.sum("n").alias("m")).where("m > 1").select("component")
    several = named.df.select("node", "component").join(several.hint("merge"), "component", "left_semi")
    several = Stored(lines.df.select("doc_id", "uid", "line_no", "node").join(several.hint("merge"), "node").select("doc_id", "uid", "line_no", "component"), "line-occurrences")
    lines.drop()
    named.drop()
    named = several
    kept = named.df.groupBy("component").agg(F.min(at).alias("kept"))
    gone = named.df.join(kept.hint("merge"), "component").where(~at.eqNullSafe(F.col("kept")))
    per_doc = Stored(gone.groupBy("uid").agg(F.collect_set("line_no").alias("cut")), "line-cuts")
    named.drop()
    left = lambda every, cut: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), cut), lambda i: F.get(every, i)), "\n")
    joined = rows.join(per_doc.df.hint("shuffle_hash"), "uid", "left")
    every = F.split(text, "\n", -1)
    kept_text = F.when(F.size("cut") > 0, once([every, F.col("cut")], left)).otherwise(text)
    n_lines = F.coalesce(F.size(F.filter(every, lambda x: x.rlike(r"\S"))), F.lit(0))
    return joined.select(*unpacked(joined, text=kept_text, n_lines=n_lines.cast("long"), n_removed=F.coalesce(F.size("cut"), F.lit(0)).cast("long")))
