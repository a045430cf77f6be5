"""Line dedup (operator 4): fuzzy lines by MinHash, with DataFrame functions only.

A line is taken in lower case without the spaces around it. Its shingles are all runs of ``SHINGLE`` characters (a shorter
line is one shingle), read as UTF-16 so that each is cut out by position; a character beyond the basic plane counts as two.
Equal lines are one node from the start, so each text is shingled once.

The signature is MinHash by one permutation: the hash range is cut into ``BINS`` ranges, and the least hash of each is kept;
``ROWS`` bins make a band of the ``BANDS`` bands. Empty bins agree with empty bins, so two lines of Jaccard similarity J
agree in a bin with probability J at least and in some band with probability 0.97 to 0.985 at J = 0.8, 0.99 at 0.85.
Lines that fill fewer than ``FULL`` bins have few shingles and nearly all of these in their bins: their bands are the three least of
what is in the bins, hashed anew for each band. Lines that fill ``FULL`` to ``FEW`` bins have both kinds. A band of ``ROWS`` bins of
which fewer than ``HELD`` are filled is none: unlike lines, which agree in what they lack, would meet there.
Lines of more than ``MANY`` spaces have their signature from the shingles that begin a word, those of fewer than ``SOME`` from all
shingles; those between, and those whose first shingle comes again, have both signatures.

Each band is settled by exact comparisons, by all shingles. Its members are compared with the one of most copies, and distributed
union-find (``common.connected_components``) gives the components of the links. In bands that still hold several components
each pair of lines of different ones is decided (``block_links``): by a bitmap of the shingles of each line, which refuses
only pairs that cannot reach the threshold, then by the shingles themselves. Every candidate pair is decided so. Only links are put
out, and a hot band is neither a window nor a group of one task: counts and greatest values are combined before the exchange, joins
on the band are sort-merge joins that adaptive execution can split, and bands of more than ``MOST`` lines are cut into blocks.

Before members and texts are fetched again, a blocked Bloom filter of bounded size drops those that met no other line.

Defined results: lines of white space always stay; "first" means smallest doc_id (null before all), then smallest line
number; the query numbers rows that share a doc_id, so that they are documents of their own (``dedup`` takes rows with one
key for one document: copies at one line number stay or go together); a null text has no lines; a text whose lines all go becomes empty; an empty table gives an empty one; very long lines and texts are taken
whole; the columns n_lines, n_removed and removed of the input are replaced, all others are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, materialize, separate

THRESHOLD, SHINGLE = 0.8, 10
BANDS, ROWS = 8, 4
#: A power of two: the bin is the hash's first bits.
BINS = BANDS * ROWS
FULL, FEW, LEAST = BINS // 2, BINS * 3 // 4, 3
#: Wide bands have at least so many filled bins.
HELD = 2
#: Lines of fewer spaces than SOME have their signature from all shingles, those of more than MANY from the shingles that begin
#: a word; those between, and those whose first shingle comes again, from both.
SOME, MANY = 30, 42
#: Bands of more than MOST undecided lines are cut into blocks of about BLOCK lines.
MOST, BLOCK = 1024, 512
#: 64-bit words of a line's bitmap of shingles. Those of two lines are columns of one join, which is compiled up to 100 columns.
WORDS = 40
#: The Bloom filter has at most so many blocks of 64 bits; beyond that it only drops less.
MOST_BLOCKS = 1 << 20


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, n, low, lid, lid2) of the lines that take part; lid and lid2 are two hashes of ``low``, the line as compared."""
    rows = df.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    rows = rows.where(F.regexp_like("line", F.lit(r"\S"))).select("doc", "n", F.lower(F.trim("line")).alias("low"))
    return rows.select("doc", "n", "low", F.xxhash64("low").alias("lid"), F.xxhash64("low", F.lit(7)).alias("lid2"))


def _wide(low: Column) -> Column:
    """The line with two bytes a character."""
    return F.encode(low, "UTF-16BE")


def _count(wide: Column, shingle: int) -> Column:
    return F.greatest(F.octet_length(wide).bitwiseAND(-2) - 2 * shingle + 2, F.lit(2))


def _shingle(wide: Column, place: Column, shingle: int, seed: int) -> Column:
    """The hash of the shingle at a byte, counted from 1."""
    return F.xxhash64(F.substring(wide, place, F.lit(2 * shingle)), F.lit(seed))


def shingle_hashes(wide: Column, shingle: int = SHINGLE) -> Column:
    """Distinct shingle hashes of a line. The line is the variable of an outer lambda, for a column of bytes would be copied
    anew for each shingle."""

    def hashes(line: Column) -> Column:
        places = F.sequence(F.lit(1), _count(line, shingle), F.lit(2))
        return F.array_distinct(F.transform(places, lambda i: _shingle(line, i, shingle, 0)))

    return F.transform(F.array(wide), hashes)[0]


def band_keys(bins: list[Column], sparse: Column) -> Column:
    """Keys of all bands of a line with these bins, NULL where they are empty. A wide band of fewer than ``HELD`` filled bins has
    no key: lines that have next to nothing in common would meet there."""
    held = F.array_compact(F.array(*bins))
    filled = lambda part: reduce(Column.__add__, [x.isNotNull().cast("int") for x in part])
    size = filled(bins)

    def wide(band: int) -> Column:
        part = bins[band * ROWS : (band + 1) * ROWS]
        return F.when(filled(part) >= HELD, F.xxhash64(F.lit(band), sparse, *part))

    def again(band: int) -> Column:
        return F.transform(held, lambda x: F.xxhash64(x, F.lit(band)))

    broad = F.array_compact(F.array(*[wide(b) for b in range(BANDS)]))
    tight = F.array(*[F.xxhash64(F.lit(-1 - b), sparse, F.slice(F.sort_array(again(b)), 1, LEAST)) for b in range(BANDS)])
    return F.when(size > FEW, broad).when(size < FULL, tight).otherwise(F.concat(broad, tight))


def kinds_of(low: Column) -> Column:
    """Which signatures a line has: from the shingles that begin a word (true), from all shingles (false), or both."""
    more_than = lambda n: F.octet_length(F.substring_index(low, " ", n + 1)) < F.octet_length(low)
    repeats = F.position(F.left(low, F.lit(SHINGLE)), low, F.lit(2)) > 0
    return F.when(~more_than(SOME - 1), F.array(F.lit(False))).when(more_than(MANY) & ~repeats, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))


def signatures(lines: DataFrame, shingle: int = SHINGLE, seed: int = 0) -> DataFrame:
    """(lid, keys) of lines (lid, wide; low, the text, and rank if at hand), one row each, with their rank. Runs in the stage
    that brings equal lines together."""
    more = [c for c in ("rank",) if c in lines.columns]
    top = [F.max(c).alias(c) for c in more]
    low = F.col("low") if "low" in lines.columns else F.decode("wide", "UTF-16BE")
    rows = lines.select("lid", *more, "wide", _count(F.col("wide"), shingle).alias("n"), F.explode(kinds_of(low)).alias("sparse"))
    rows = rows.select("lid", *more, "sparse", "wide", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(2))).alias("i"))
    begins = (F.col("i") == 1) | (F.substring("wide", F.col("i") - 2, F.lit(2)) == F.lit(b"\0 "))
    hashed = rows.where(~F.col("sparse") | begins).select("lid", *more, "sparse", _shingle(F.col("wide"), F.col("i"), shingle, seed).alias("h"))
    # the bin is the hash's first bits: those of the band, then those of the row
    first = lambda n: F.shiftrightunsigned("h", 65 - n.bit_length())
    hashed = hashed.select("lid", *more, "sparse", first(BANDS).cast("int").alias("band"), first(BINS).bitwiseAND(F.lit(ROWS - 1)).cast("int").alias("row"), "h")
    bands = hashed.groupBy("lid", "sparse", "band").agg(*[F.min(F.when(F.col("row") == r, F.col("h"))).alias(f"h{r}") for r in range(ROWS)], *top)
    at = [(b, r) for b in range(BANDS) for r in range(ROWS)]
    bins = bands.groupBy("lid", "sparse").agg(*[F.max(F.when(F.col("band") == b, F.col(f"h{r}"))).alias(f"h{b}_{r}") for b, r in at], *top)
    keys = bins.select("lid", *more, band_keys([F.col(f"h{b}_{r}") for b, r in at], F.col("sparse")).alias("keys"))
    return keys.groupBy("lid").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), *top)


def _bloom_bits(h: Column) -> Column:
    """Four bits of one 64-bit block."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def maybe_in(rows: DataFrame, found: DataFrame, column: str, keep_all: bool = False) -> DataFrame:
    """Rows whose value may be among those of ``found`` (or all rows, with a column ``maybe`` that says so): a blocked Bloom
    filter, broadcast as at most MOST_BLOCKS rows."""
    blocks = max(64, min(MOST_BLOCKS, found.count() // 4))
    block = F.pmod(F.xxhash64(column, F.lit(5)), F.lit(blocks)).cast("int")
    bits = _bloom_bits(F.xxhash64(column, F.lit(3)))
    bloom = found.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    joined = rows.withColumn("block", block).join(F.broadcast(bloom), "block", "left" if keep_all else "inner")
    hit = F.coalesce(F.col("bits").bitwiseAND(bits) == bits, F.lit(False))
    return joined.withColumn("maybe", hit).drop("block", "bits") if keep_all else joined.where(hit).drop("block", "bits")


def _alike(a: Column, b: Column, threshold: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= threshold * (F.size(a) + F.size(b) - both)


def similar(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (src, dst) whose Jaccard similarity, by all shingles, reaches the threshold. Texts travel, not shingles."""
    a = texts.select(F.col("lid").alias("src"), F.col("wide").alias("a"))
    b = texts.join(pairs.select(F.col("dst").alias("lid")).distinct(), "lid", "left_semi").repartition("lid").select(F.col("lid").alias("dst"), shingle_hashes(F.col("wide"), shingle).alias("hb"))
    met = pairs.join(a, "src").join(b, "dst")
    return met.where(_alike(shingle_hashes(F.col("a"), shingle), F.col("hb"), threshold)).select("src", "dst")


def bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """(lid, n, w0, w1, ...) of the texts: a bitmap that has a bit for each shingle, and how many shingles there are at most."""
    rows = texts.select("lid", "wide", _count(F.col("wide"), shingle).alias("to"))
    rows = rows.select("lid", "to", "wide", F.explode(F.sequence(F.lit(1), F.col("to"), F.lit(2))).alias("i"))
    hashed = rows.select("lid", "to", _shingle(F.col("wide"), F.col("i"), shingle, 0).alias("h"))
    place = F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = hashed.groupBy("lid", "to", F.pmod("h", F.lit(WORDS)).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    of_word = lambda i: F.max(F.when(F.col("word") == i, F.col("bits")))
    return words.groupBy("lid", F.expr("(to + 1) div 2").alias("n")).agg(*[of_word(i).alias(f"w{i}") for i in range(WORDS)])


def undecided(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (band, lid, class, size) of the bands that hold several classes, without those that all others were compared with."""
    known = members.where("lid <> top").join(classes, F.col("lid") == F.col("node"), "left").select("band", "lid", F.coalesce("component", "lid").alias("class"))
    bands = known.groupBy("band").agg(F.min("class").alias("c1"), F.max("class").alias("c2"), F.count("*").alias("size"))
    return materialize(known.join(bands.where("c1 < c2").select("band", "size"), "band"))


def block_links(members: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (src, dst) of one band and different classes that reach the threshold; members has band, lid, class, size.

    Lines of x bits that only one of them has differ in x shingles at least, so that their similarity is (n - x) / (n + x) at
    most, n being the shingles of both (half a bit is added for rounding). Only pairs that may reach the threshold leave the join, once for all bands they share,
    and are compared by their shingles. A band of more than MOST lines is cut into blocks: a line goes to its own and those after it.
    """
    of_line = members.groupBy("lid").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    lines = materialize(of_line.join(bitmaps(texts.join(of_line, "lid", "left_semi"), shingle), "lid"))
    cut = F.when(F.col("size") > MOST, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int")
    words = [f"w{i}" for i in range(WORDS)]
    rows = members.select("band", "lid", "class", cut.alias("cut")).withColumn("own", F.pmod(F.xxhash64("lid", F.lit(9)), "cut").cast("int")).join(lines, "lid")
    rows = rows.select("band", "own", "cut", "lid", "class", "bands", "n", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in words])
    held = rows.select("band", F.col("own").alias("block"), *[F.col(c).alias(f"{c}_") for c in ("lid", "class", "bands", "n", *words)])
    asking = rows.withColumn("block", F.explode(F.sequence("own", F.col("cut") - 1)))
    apart = reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in words])
    most = (F.col("n") + F.col("n_")) * ((1 - threshold) / (1 + threshold)) + 0.5
    once = ((F.col("own") < F.col("block")) | (F.col("lid") < F.col("lid_"))) & (F.col("class") != F.col("class_"))
    first = F.array_min(F.array_intersect("bands", "bands_")) == F.col("band")
    may = asking.join(held, ["band", "block"]).where(once & (apart <= most) & first)
    return similar(materialize(may.select(F.col("lid").alias("src"), F.col("lid_").alias("dst"))), texts, threshold, shingle)


def collisions(keyed: DataFrame) -> DataFrame:
    """(band, lid, top) of the lines (lid, rank, keys) that share a band with others; top is the one of the highest rank."""
    each = keyed.select("lid", "rank", F.explode("keys").alias("band"))
    bands = materialize(each.groupBy("band").agg(F.count("*").alias("size"), F.max_by("lid", "rank").alias("top")).where("size > 1").select("band", "top"))
    return materialize(maybe_in(each.drop("rank"), bands, "band").join(bands, "band").select("band", "lid", "top"))


def signed(rows: DataFrame, shingle: int) -> DataFrame:
    """(lid, rank, keys) of all distinct lines; lines of more copies rank higher, equal ones by some of their hash, so that one line is
    the highest in all bands that it shares with the same others."""
    lines = rows.groupBy("lid").agg(F.first("low").alias("low"), F.count("*").alias("copies"))
    rank = F.least("copies", F.lit(1 << 40)) * 4096 + F.col("lid").bitwiseAND(F.lit(4095))
    return materialize(signatures(lines.select("lid", "low", rank.alias("rank"), _wide(F.col("low")).alias("wide")), shingle))


def merged(classes: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The classes (node, component) once new links join them: found from the classes, not from all links again."""
    edges = classes.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    for new in links:
        edges = edges.unionByName(new)
    return materialize(connected_components(edges))


def line_classes(texts: DataFrame, members: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(lid, component) of every line that is linked to a different line, of the members of bands and their texts."""
    pairs = members.where("lid <> top").select(F.col("lid").alias("src"), F.col("top").alias("dst")).distinct()
    # whole components, so that a large group of near copies is one class
    classes = materialize(connected_components(similar(materialize(pairs), texts, threshold, shingle)))
    left = undecided(members, classes)
    if not left.isEmpty():
        classes = merged(classes, [block_links(left, texts, threshold, shingle)])
    return classes.withColumnRenamed("node", "lid")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc, n): every line that is not the first of its component."""
    rows = line_rows(df, key, text)
    members = collisions(signed(rows.select("lid", "low"), shingle))
    # the one table of all lines; texts only of those that met another one
    marked = maybe_in(rows, members.select("lid").distinct(), "lid", keep_all=True)
    rows = materialize(marked.select("doc", "n", "lid", "lid2", F.when(F.col("maybe"), F.col("low")).alias("low")))
    texts = rows.where("low is not null").groupBy("lid").agg(F.first("low").alias("low")).select("lid", _wide(F.col("low")).alias("wide"))
    classes = line_classes(materialize(texts), members, threshold, shingle)
    place = F.struct("doc", "n")
    met = rows.where("low is not null").join(classes, "lid", "left").select("doc", "n", "lid", "lid2", "component")
    alone = rows.where("low is null").select("doc", "n", "lid", "lid2", F.lit(None).cast("long").alias("component"))
    own = met.unionByName(alone).select("doc", "n", F.coalesce("component", "lid").alias("class"), F.when(F.col("component").isNull(), F.col("lid2")).otherwise(F.lit(0).cast("long")).alias("class2"))
    # places are compared only in classes of several lines
    several = materialize(own.groupBy("class", "class2").count().where("count > 1").select("class"))
    own = materialize(maybe_in(own, several, "class"))
    first = own.groupBy("class", "class2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return own.join(first.drop("last"), ["class", "class2"]).where(place > F.col("first")).select("doc", "n")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with its repeated lines cut out of the text, and n_lines, n_removed, removed (line numbers from 0)."""
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed", "removed", "_doc", "_all")]
    gone = repeated_lines(df, key, text, threshold, shingle).groupBy(F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_set("n")).alias("removed"))
    counted = df.select(*kept).withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"))
    joined = counted.join(gone, F.col(key).eqNullSafe(F.col("_doc")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    joined = joined.withColumn("removed", F.filter("removed", lambda n: n < F.col("n_lines"))).withColumn("_all", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("removed"))
    cut = F.when(F.size("removed") == 0, F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.col("_all")[i]), "\n"))
    return joined.select(*[cut.alias(c) if c == text else F.col(c) for c in kept], "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def document_lines(documents: DataFrame) -> DataFrame:
    """The query: doc_id, n_lines, n_removed and the removed line numbers."""
    out = dedup(separate(documents, "doc_id", "text"), "doc")
    return out.select(F.col("key").alias("doc_id"), "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))
