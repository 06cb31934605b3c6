"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line is the set of its words, which white space of any kind separates.  Equal sets are classes, found by aggregation.
Between classes: the words of a line are ordered by rarity, a line is filed under the words of its prefix, lines that
share a key and pass the length and positional filters (and one of 128 bits over all words) are candidates, and the
candidates' full word sets decide.  A line that matches an earlier one is removed.

Texts are cut into words twice and never shuffled for it: to count words, and to write a row for each line with its keys.
For the last check they are cut into lines again, and only the lines of candidates go on.  Rarity is a count of all words in a fixed number of hash
buckets, so the order is a table of fixed size; ties are broken by hash, and any one order gives the same pairs.

A frequent word gives no key of its own.  Sets that are alike and share no rare word of their prefixes share B + 1
frequent words in prefixes that are longer by B, so that of B buckets of words one has two of them: pairs of words of
one bucket are the keys.  B grows with the set, and the number of pairs so only in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import dropped, written
from siltstone.llm.sieve import marked, sieve

#: Similarity as a fraction: with o words in common, (4 + 5) o >= 4 (m + n).
NUMERATOR, DENOMINATOR = 4, 5
#: Lines with fewer words are left alone by default; the query and the pipeline ask for 1.
LEAST_WORDS = 5
#: Sets of fewer words are alike only if they are equal, so they are not filed.
LEAST_FILED = 4
#: Buckets of words; a rank, of seven bits, is 4 times the logarithm of the bucket's count.
RARITY_BUCKETS, RANKS_A_BIT = 1 << 22, 4
#: A word whose bucket has more occurrences is frequent.
FREQUENT = 512
#: A class of more than one in so many lines is hot: it is broadcast, and there are no more of them than this.
HOT_ONE_IN = 1_000
#: A key with more filings is heavy if more than one in MARKED of them have one mark (lines that are alike mostly have the
#: same), and with MIXED times as many whatever their marks.  Under a heavy key each filing is first compared
#: with an early one, of SALTS that its keys have between them, and only what has no match by then with the rest.  So a
#: group of lines that are all alike costs a comparison a line, not one a pair.  A word that isn't frequent has fewer than
#: HEAVY * MIXED filings: lines that merely share it are compared at once, which is cheaper than to part them.
HEAVY, MARKED, MIXED, SALTS = 64, 4, 16, 8
#: White space but the blank and the line feed.  The range before the list spares most characters a walk through it.
BLANKS = r"[\t\x0B\f\r\x{85}-\x{3000}&&[\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"

FILING = ("key", "k1", "low", "high", "sizes")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and text_hash; rows are told apart by doc_id and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def _lines(text: Column) -> Column:
    """The lines of a text, with blanks as the only white space."""
    return F.split(F.regexp_replace(text, BLANKS, " "), "\n")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _hashes(words: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(RARITY_BUCKETS - 1))


def _rank(count: int) -> int:
    """The rank of a bucket with ``count`` words, as ``rarity`` has it."""
    import math

    return math.floor(math.log2(count) * RANKS_A_BIT)


def rarity(docs: DataFrame) -> DataFrame:
    """One row, one array: the ranks of all buckets, a byte each; ranks go to 127, by the logarithm of the count.

    Eight buckets are gathered as one number, for there are fewer of these to collect."""
    word = F.explode(F.split(F.replace(F.regexp_replace("text", BLANKS, " "), F.lit("\n"), F.lit(" ")), " "))
    counts = docs.select(word.alias("w")).where("w != ''").groupBy(_bucket(F.xxhash64("w")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.floor(F.log2("n") * RANKS_A_BIT), F.lit(127)).cast("long")
    eight = counts.groupBy(F.shiftright("b", 3).cast("int").alias("at")).agg(F.bit_or(_shift("shiftleft", rank, F.col("b").bitwiseAND(F.lit(7)) * 8)).alias("r"))
    every = docs.sparkSession.range(RARITY_BUCKETS // 8).select(F.col("id").cast("int").alias("at")).join(eight, "at", "left")
    eights = every.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("r", F.lit(0).cast("long")).alias("r")))).alias("e"))
    parted = lambda x: F.array(*[F.shiftright(x["r"], 8 * k).bitwiseAND(F.lit(127).cast("long")).cast("tinyint") for k in range(8)])
    return eights.select(F.flatten(F.transform("e", parted)).alias("ranks"))


def _prefix(n: Column) -> Column:
    """A set of n words shares at least ceil(4 n / 5) words with one that is alike."""
    return n - F.ceil(n * NUMERATOR / DENOMINATOR).cast("int") + 1


def _parts(n: Column) -> Column:
    """B of a set of n words: the power of two up to n / 8."""
    return _shift("shiftleft", F.lit(1), F.floor(F.log2(F.greatest(F.lit(1), F.floor(n / 8)))))


def prepared(docs: DataFrame, ranks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each line that takes part: doc_id, text_hash, line_no (these give the order of lines), k1 and k2 (two
    hashes of the set of words), n, low and high (128 bits, of which each word flips the one of its hash modulo 128: two
    sets differ in at least as many words as bits, and long sets don't fill them), mark (by the least and
    the greatest hash) and filed (key, position in the order and maybe_heavy of each filing).  A word that occurs once is
    no key, since no other line has it.

    The words are made inside the generator, which gives them once; a filter on a later column would split anew."""
    enough = lambda x: F.size(x["hashes"]) >= 1
    if least_words > 1:
        enough = lambda x: F.size(_words(x["line"])) >= least_words
    lines = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("line_no"), _hashes(_words(x)).alias("hashes"), x.alias("line"))), enough)
    out = docs.select("doc_id", "text_hash", F.explode(lines).alias("l")).select("doc_id", "text_hash", "l.line_no", "l.hashes", ranks.scalar().alias("ranks"))
    # A subquery's value enters the function that uses it once the projections are merged; no row carries the table.
    # Words become numbers that sort by rarity.
    rank = lambda h: F.get("ranks", _bucket(h).cast("int")).cast("long")
    order = F.sort_array(F.transform("hashes", lambda h: F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))
    one = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(1).cast("long"))
    low, high = (F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(_shift("shiftleft", bit(h), h.bitwiseAND(F.lit(63))))) for bit in (lambda h: F.lit(1).cast("long") - one(h), one))
    eight = lambda at: F.get("hashes", at).bitwiseAND(F.lit(255))
    mark = (eight(F.lit(0)) * 256 + eight(F.size("hashes") - 1)).cast("int")
    keep = ("doc_id", "text_hash", "line_no", "k1", "k2", "n", "low", "high", "mark")
    n = F.col("n")
    out = out.select("doc_id", "text_hash", "line_no", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(7), "hashes").alias("k2"), F.size("hashes").alias("n"), low.alias("low"), high.alias("high"), mark.alias("mark"), order.alias("order"))
    out = out.select(*keep, F.when(n >= LEAST_FILED, F.slice("order", 1, _prefix(n) + _parts(n))).alias("order"))
    out = out.select("*", F.filter(F.slice("order", 1, _prefix(n)), lambda w: w < F.lit((_rank(FREQUENT) + 1) << 56)).alias("rare"))
    out = out.select("*", F.when(F.size("rare") < _prefix(n), F.slice("order", F.size("rare") + 1, F.size("order"))).alias("frequent"))
    # The partner's size decides on B; for all sizes that may be the lesser of the two, B has at most two values.
    low, high = _parts(F.ceil(n * NUMERATOR / DENOMINATOR)), _parts(n)
    out = _paired(_paired(out, high, F.lit(True), "p"), low, low != high, "q")
    once = F.lit(1 << 56)  # rank 0
    single = F.transform("rare", lambda w, i: F.struct(w.alias("key"), i.alias("at"), (w >= F.lit(_rank(HEAVY) << 56)).alias("maybe_heavy")))
    single = F.filter(single, lambda f: f["key"] >= once)
    none = F.array().cast("array<struct<key:long,at:int,maybe_heavy:boolean>>")
    return out.select(*keep, F.concat(F.coalesce(single, none), F.coalesce("p", none), F.coalesce("q", none)).alias("filed"))


def _paired(lines: DataFrame, parts: Column, wanted: Column, name: str) -> DataFrame:
    """Adds the filings under pairs of frequent words of one of B = ``parts`` buckets, where ``wanted``.

    Each step is a column of its own, so that none is made again for every element of the next."""
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).alias("run"), F.lit(1).alias("most"))

    def follow(s: Column, x: Column) -> Column:
        run = F.when(s["b"] == x["b"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x["b"].alias("b"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    def pair(x: Column, y: Column) -> Column:
        # Up to B - 1 shared words may come before the first of a pair, and the position says so.
        at = F.greatest(F.size("rare") + x["i"] - F.col("_parts") + 1, F.lit(0))
        return F.when(y["b"] == x["b"], F.struct(F.xxhash64("_parts", x["w"], y["w"]).alias("key"), at.alias("at"), F.lit(True).alias("maybe_heavy")))

    def apart(d: Column) -> Column:
        return F.filter(F.transform("_placed", lambda x, i: pair(x, F.get("_placed", i + d))), lambda p: p.isNotNull())

    out = lines.withColumn("_parts", parts)
    words = F.slice("frequent", 1, _prefix(F.col("n")) + F.col("_parts") - F.size("rare"))
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(F.pmod(F.xxhash64(w), F.col("_parts")).alias("b"), w.alias("w"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(wanted & F.col("frequent").isNotNull(), placed))
    # Words of a bucket are at a distance of 1, 2, ... in the list sorted by bucket.
    out = out.withColumn("_most", F.aggregate("_placed", start, follow, lambda s: s["most"]))
    out = out.withColumn(name, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.col("_most") - 1, F.lit(1))), apart)))
    return out.drop("_parts", "_placed", "_most")


def repeats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of classes of several (as ``prepared``, but first, whether a line is its class's first), and a sieve of
    those classes."""
    pos = F.struct("doc_id", "text_hash", "line_no")
    several = written(lines.groupBy("k1", "k2").agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    total = lines.count()
    passed = written(sieve(several, "k1"))
    mine = marked(lines, F.col("k1"), passed).where("may_match").drop("may_match")
    least = max(total // HOT_ONE_IN, 1)
    # No more than HOT_ONE_IN classes have so many lines: they are broadcast, the rest is joined by shuffle.
    hot = F.broadcast(several.where(F.col("members") > least))
    cold = several.where(F.col("members") <= least)
    one = mine.join(hot, ["k1", "k2"])
    many = mine.join(F.broadcast(several.where(F.col("members") > least).select("k1", "k2")), ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"], "left")
    both = one.unionByName(many)
    first = F.col("first_pos").isNull() | (pos == F.col("first_pos"))
    both = both.withColumn("first", first).withColumn("filed", F.when(F.col("first"), F.col("filed")))
    out = written(both.select(*lines.columns, "first"))
    dropped(several)
    return out, passed


def classes_of(lines: DataFrame, repeated: DataFrame, passed: DataFrame) -> DataFrame:
    """One row a class: its first line."""
    alone = marked(lines, F.col("k1"), passed).where("not may_match").drop("may_match", "k2")
    firsts = repeated.where("first").drop("first").dropDuplicates(["k1", "k2"]).drop("k2")
    return alone.unionByName(firsts).where(F.col("n") >= LEAST_FILED)


def filings(classes: DataFrame) -> DataFrame:
    """For each key under which a class is filed: key, k1, low, high, sizes (the set's size and the position of the key's first
    word in the order, in one number), doc, mark and maybe_heavy, false if the key can't have many filings."""
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")
    out = classes.select("k1", "low", "high", "n", doc, "mark", F.explode("filed").alias("f"))
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("f.at").cast("long")).alias("sizes")
    return out.select("f.key", "k1", "low", "high", sizes, "doc", "mark", "f.maybe_heavy")


def heavy_keys(filed: DataFrame) -> DataFrame:
    """The heavy ones among the keys, by counts of each key's marks."""
    cells = filed.where("maybe_heavy").groupBy("key", "mark").agg(F.count(F.lit(1)).alias("filings"))
    return cells.groupBy("key").agg(F.max("filings").alias("alike"), F.sum("filings").alias("filings")).where((F.col("filings") > HEAVY) & ((F.col("alike") * MARKED > F.col("filings")) | (F.col("filings") > HEAVY * MIXED))).select("key")


def passes(xs: str, ys: str) -> Column:
    """The length, positional and bit filters between two filings."""
    xn, yn = (F.shiftright(F.col(f"{s}.sizes"), 32) for s in (xs, ys))
    x_at, y_at = (F.col(f"{s}.sizes").bitwiseAND(F.lit((1 << 32) - 1)) for s in (xs, ys))
    same_size = (xn * DENOMINATOR >= yn * NUMERATOR) & (yn * DENOMINATOR >= xn * NUMERATOR)
    # The key's first word and those after it must make up the wanted overlap, 4/9 of both sizes.
    enough = F.least(xn - x_at, yn - y_at) * (NUMERATOR + DENOMINATOR) >= (xn + yn) * NUMERATOR
    apart = sum(F.bit_count(F.col(f"{xs}.{c}").bitwiseXOR(F.col(f"{ys}.{c}"))) for c in ("low", "high"))
    near = apart * (NUMERATOR + DENOMINATOR) <= xn + yn
    return near & same_size & enough


def _pairs(x: DataFrame, y: DataFrame, also: Column, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """a, b: classes (by k1) that share a key, pass the filters and meet ``also``."""
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    for c in same[1:]:
        also = also & c
    both = x.alias("x").join(y.alias("y"), same[0] & also & passes("x", "y"))
    return both.select(F.least("x.k1", "y.k1").alias("a"), F.greatest("x.k1", "y.k1").alias("b")).distinct()


def light_pairs(light: DataFrame) -> DataFrame:
    """All candidates under keys of few filings."""
    return _pairs(light, light, F.col("x.k1") < F.col("y.k1"))


def first_pairs(heavy: DataFrame) -> DataFrame:
    """Candidates of each filing with an early one under its key: no more than filings.  The early ones of a class's keys
    are not all the same: they are the earliest of SALTS parts of the classes, and the key says of which."""
    early = heavy.groupBy("key").agg(F.min_by(F.struct("k1", "low", "high", "sizes"), F.struct(F.pmod(F.xxhash64("key").bitwiseXOR(F.col("k1")), F.lit(SALTS)), "doc", "k1")).alias("f")).select("key", "f.*")
    return _pairs(heavy, early, F.col("x.k1") != F.col("y.k1"))


def _band(n: Column) -> Column:
    """Sizes by powers of (5/4)², not rounded; sets that are alike to one are in no more than two bands, or three where
    rounding leaves it open."""
    return F.log(n.cast("double")) / F.log(F.lit((DENOMINATOR / NUMERATOR) ** 2))


def rest_pairs(heavy: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates of each filing whose class isn't found yet with all filings that may be earlier, by bands of sizes."""
    split = marked(heavy, F.col("k1"), sieve(found, "k1"))
    maybe = split.where("may_match").drop("may_match").join(found, "k1", "left_anti").select(*heavy.columns)
    undecided = split.where("not may_match").drop("may_match").unionByName(maybe)
    band = _band(F.shiftright("sizes", 32))
    near = undecided.withColumn("band", F.explode(F.sequence(F.floor(band - 0.5 - 1e-6), F.floor(band + 0.5 + 1e-6))))
    return _pairs(near, heavy.withColumn("band", F.floor(band)), (F.col("x.k1") != F.col("y.k1")) & (F.col("y.doc") <= F.col("x.doc")), ("key", "band"))


def class_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """k1, pos and words (in one string, which takes a third of an array's space) of the classes in ``ids``, from the
    documents of their first lines."""
    at = ("doc_id", "text_hash", "line_no")
    passed = written(sieve(ids.select(F.xxhash64(*at).alias("place")), "place"))
    every = docs.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    likely = marked(every, F.xxhash64(*at), passed).where("may_match").groupBy(*at).agg(F.first("line").alias("line"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"i.{c}"))
    out = likely.alias("l").join(ids.alias("i"), same).select("i.k1", F.struct("l.doc_id", "l.text_hash", "l.line_no").alias("pos"), F.array_join(F.array_distinct(_words(F.col("l.line"))), " ").alias("words"))
    out = written(out)
    dropped(passed)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """k1 and pos of the later class of each pair whose sets of words are alike."""
    a, b = (sets.select(F.col("k1").alias(s), F.col("pos").alias(f"{s}_pos"), F.col("words").alias(f"{s}_words")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b")
    # One generator makes the two arrays once.
    sets = F.explode(F.array(F.struct(F.split("a_words", " ").alias("a"), F.split("b_words", " ").alias("b"))))
    both = both.select("a", "b", "a_pos", "b_pos", sets.alias("s"))
    alike = F.size(F.array_intersect("s.a", "s.b")) * (NUMERATOR + DENOMINATOR) >= (F.size("s.a") + F.size("s.b")) * NUMERATOR
    later = F.col("a_pos") > F.col("b_pos")
    return both.where(alike).select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("k1"), F.when(later, F.col("a_pos")).otherwise(F.col("b_pos")).alias("pos"))


def alike(docs: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """k1 and pos of the later class of each of ``pairs`` that is alike, as a table; ``named`` has the classes' places.
    Only the lines of these pairs are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    ids = written(named.join(wanted, "k1", "left_semi"))
    sets = class_sets(docs, ids)
    out = written(verified(pairs, sets).distinct())
    dropped(ids, sets)
    return out


def duplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash and line_nos (an array) of the lines that match an earlier line; ``docs`` as from ``keyed``.

    Every step is written to the shared folder, and tables go as soon as no later step reads them."""
    ranks = written(rarity(docs))
    lines = written(prepared(docs, ranks, least_words), "zstd")
    repeated, passed = repeats(lines)
    filed = filings(classes_of(lines, repeated, passed))
    heavy = written(heavy_keys(filed))
    # Some keys of few filings are treated as heavy ones, which gives the same result.  The filings are a table, so that
    # both sides of the join below are one exchange.
    heavy_sieve = written(sieve(heavy, "key"))
    filed = marked(filed, F.col("key"), heavy_sieve)
    filed = written(filed.select(*FILING, "doc", (F.col("maybe_heavy") & F.col("may_match")).alias("heavy")))
    named = written(classes_of(lines, repeated, passed).select("k1", "doc_id", "text_hash", "line_no"))
    dropped(ranks, lines, passed, heavy, heavy_sieve)
    heavy = filed.where("heavy").drop("heavy")
    light = filed.where("not heavy").select(*FILING)
    under_light = written(light_pairs(light))
    few = written(under_light.unionByName(first_pairs(heavy)).distinct())
    dropped(under_light)
    near = alike(docs, named, few)
    more = written(rest_pairs(heavy, near.select("k1").distinct()))
    dropped(filed, few)
    rest = alike(docs, named, more)
    equal = repeated.where("not first").select(F.struct("doc_id", "text_hash", "line_no").alias("pos"))
    every = equal.unionByName(near.select("pos")).unionByName(rest.select("pos"))
    found = written(every.groupBy("pos.doc_id", "pos.text_hash").agg(F.collect_set("pos.line_no").alias("line_nos")))
    dropped(repeated, named, more, near, rest)
    return found


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text (without the lines that match an earlier one), n_lines and n_removed of every document.

    The order of lines is by doc_id (null first), then a hash of the text, then line number.  A line is removed if its
    set of words has Jaccard similarity of 0.8 or more with that of any earlier line, removed or not, in the same or
    another document.  Lines of fewer than ``least_words`` words stay.  A null text counts as empty.  Rows that agree in doc_id and
    text are one document with respect to this and give equal rows.  Other columns are not read.
    """
    docs = keyed(df, id_col, text_col)
    return removed(docs, duplicate_lines(docs, least_words)).select("doc_id", "text", "n_lines", "n_removed")


def removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, text_hash and at most one further column, row) without the lines found; adds n_lines and
    n_removed."""
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    docs = marked(docs, F.col("text_hash"), written(sieve(found, "found_hash")))
    untouched = docs.where("not may_match").drop("may_match").withColumn("line_nos", F.lit(None).cast("array<int>"))
    touched = docs.where("may_match").drop("may_match").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left").drop("found_id", "found_hash")
    touched = touched.withColumn("all_lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("line_nos"))
    touched = touched.withColumn("kept", kept).withColumn("text", F.when(F.col("line_nos").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("all_lines", i)), "\n")))
    both = touched.withColumn("n_lines", F.size("all_lines").cast("long")).drop("all_lines", "kept").unionByName(untouched.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")))
    return both.withColumns({"n_removed": F.when(F.col("line_nos").isNull(), F.lit(0)).otherwise(F.size("line_nos")).cast("long")}).drop("line_nos")
