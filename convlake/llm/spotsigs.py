"""SpotSigs fingerprints: chains of content words that follow common-word anchors (DataFrame and SQL functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import clear, settle

# Common function words of English, French, German and Spanish.
ANCHORS = """
a all an and are as at be but by can for from had has have he her his i if in is it its more not of on or our she so that the their they
this to was we were what which who will with would you your
au aux avec ce dans des du elle en est et il je la le les leur mais ne ou par pas plus pour que qui sa se son sur un une vous
auf aus bei das dem den der die durch ein eine einer es für ich ihr im ist mit nach nicht noch nur oder sich sie sind über um und von wie zu zum zur
al como con cuando de del el ella era esta este ha hay las lo los me mi muy no o para pero por porque sin sobre su sus también todo una y
""".split()
WORD_GAP = r"[^\p{L}\p{N}\p{M}]+"
START, MARK = "^", "~"  # neither is in a word
NO_KEY = -(1 << 63)
LATER = 1 << 30  # the cut of a part's rows that aren't of a crowded key


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spots(text: Column, anchors: list[str] = ANCHORS, chain: int = 2, gap: int = 4) -> Column:
    """The distinct spot signatures of a text: a sorted array of 32-bit hashes (of n signatures
    some n * n / 2**33 share theirs with another).

    Words are runs of letters, marks and digits, lower-cased. A content word whose word before is an anchor starts a signature: that
    anchor and `chain` content words from there on, anchors between them skipped. The start of the text counts as an anchor, so any
    text with words has a signature, and chains at its end are shorter. Where `gap` content words passed without an anchor (tables,
    other languages), each further one starts its own until the next anchor. Texts that are null, empty or without words have
    no signature.
    """
    known = sorted(set(anchors))
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP)
    marked = F.transform(words, lambda w: F.when(w == "", w).otherwise(F.concat(w, F.when(w.isin(known), F.lit(MARK)).otherwise(F.lit(" ")))))
    # "^~of~the~big dog ": every content word carries the anchors before it
    line = F.concat(F.lit(START + MARK), F.array_join(marked, ""))

    def signatures(run: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = [F.substring_index(F.get(run, i + k), MARK, -1) for k in range(1, chain)]
            near = F.get(run, i - 1).contains(MARK)
            for k in range(2, gap + 1):
                near = near | F.get(run, i - k).contains(MARK)
            return F.when(x.contains(MARK) | ~near, F.hash(F.concat_ws(" ", F.substring_index(x, MARK, -2), *after)))

        found = F.sort_array(F.array_distinct(F.array_compact(F.transform(run, one))))
        return F.when(run == F.array(F.lit(START + MARK)), F.array().cast("array<int>")).otherwise(found)

    return let(F.split(F.rtrim(line), " "), signatures)


def spelled(spots: Column) -> Column:
    """A fingerprint as a string: its signatures in hexadecimal, eight digits each; empty without signatures."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.hex(F.lit((1 << 32) - 1).bitwiseAND(x.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; equal sets, empty ones too, are alike (1).

    Pruned by size: no intersection is formed where the sizes alone keep the value below `least` (the result is 0 then), where
    one set is empty, or where both are equal. With least = 0 all values are exact.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    value = let(shared, lambda s: s / (F.size(a) + F.size(b) - s))
    return F.when(a == b, F.lit(1.0)).when((small == 0) | (small < F.lit(float(least)) * large), F.lit(0.0)).otherwise(value)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")


def _parts(narrow: DataFrame, rows_per_part: int, most: int) -> Callable[[DataFrame], DataFrame]:
    """What adds __part to rows with __d and __h: stretches of the order (__d falling, __h rising) of about rows_per_part rows, at most `most`.

    Parts are ranges of __d between percentiles; a __d with more rows than a part stands at the head of its part and is cut into
    ranges of __h. At 16384 parts the marks are 128 KB, and a corpus of 100 TB has parts of 6 GB that sort by spilling. narrow has
    the same __d, and is read three times.
    """
    n, low, high = narrow.agg(F.count("*"), F.min("__d"), F.max("__d")).first()
    parts = max(2, min(most, n // rows_per_part))
    marks = narrow.agg(F.percentile_approx("__d", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if n else [0]
    marks = sorted({*marks, low, high} if n else {0}, reverse=True)
    full = narrow.where(F.col("__d").isin(marks)).groupBy("__d").agg(F.count("*").alias("n")).where(F.col("n") > 2 * n / parts).collect()
    step = math.isqrt(len(marks))
    reach = lambda values: F.size(F.filter(values, lambda b: b >= F.col("__d")))
    fine = F.array(*[_longs(marks[i : i + step]) for i in range(0, len(marks), step)])
    part = let(reach(_longs(marks[::step])), lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + reach(F.get(fine, c - 1))))
    cut = F.lit(LATER)
    for r in full:  # fewer than parts / 2
        cut = F.when(F.col("__d") == r["__d"], F.floor((F.col("__h") / float(1 << 64) + 0.5) * max(1, round(r.n * parts / n))).cast("int")).otherwise(cut)
    # one column: a constant cut beside the part would cost the window its partitioning, and a second shuffle of the texts
    return lambda rows: rows.withColumn("__part", F.shiftleft(part.cast("long"), 31) + cut)


def with_next(docs: DataFrame, key: str, text: str, derive: Callable[[Column], Column], rows_per_part: int = 256, most: int = 16_384) -> DataFrame:
    """docs with __own = derive(text), and __next_text and __next_own: those of the next row by falling key, the first after the last.

    A null key comes last; rows of one key follow a hash of their text. The rows are shuffled once, dealt by stretches of the order,
    and each looks at the next in its stretch; only the first row of each stretch crosses to the one before. Where stretches
    begin follows from keys and hashes, which are written once.
    """
    own = clear(docs, "__d", "__h", "__part", "__own", "__next_text", "__next_own")
    d, h = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), F.xxhash64(text)
    own = own.withColumn("__d", d).withColumn("__h", h)
    narrow = settle(own.select("__d", "__h"))
    dealt = _parts(narrow, rows_per_part, most)
    placed, order = dealt(own), [F.desc("__d"), F.asc("__h")]
    heads = dealt(narrow).groupBy("__part").agg(F.max(F.struct(F.col("__d"), F.bitwise_not("__h").alias("__u"))).alias("f"))
    heads = settle(heads.select("__part", "f.__d", F.bitwise_not("f.__u").alias("__h")))
    # the stretches in a ring, a narrow row each
    ends = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.coalesce(F.lag("__part").over(Window.orderBy(*order)), F.last("__part").over(ends))
    ring = heads.withColumn("__back", back).drop("__part")
    edge = own.select("__d", "__h", F.col(text).alias("__edge")).join(F.broadcast(ring), ["__d", "__h"])
    edge = edge.groupBy(F.col("__back").alias("__part")).agg(F.min("__edge").alias("__edge")).withColumn("__edge_own", derive(F.col("__edge")))
    mine = placed.repartition("__part").withColumn("__own", derive(F.col(text)))
    here = Window.partitionBy("__part").orderBy(*order)
    ahead = lambda c: F.lead(c).over(here)
    out = mine.withColumns({"__has": ahead(F.lit(True)), "__next_text": ahead(text), "__next_own": ahead("__own")}).join(edge, "__part", "left")
    pick = lambda c, e: F.when(F.col("__has"), F.col(c)).otherwise(F.col(e))
    out = out.withColumns({"__next_text": pick("__next_text", "__edge"), "__next_own": pick("__next_own", "__edge_own")})
    return out.drop("__d", "__h", "__part", "__has", "__edge", "__edge_own")


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] = ANCHORS, chain: int = 2) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots, edited_spots) of every row.

    The edited text has its last half replaced by the beginning of the next row's text, by falling key and cyclic: see with_next for
    null and repeated keys. A null text is empty; a single row is its own next. Sizes of sets come along; near_* are exact
    Jaccard similarities of the sets, 1 for equal fingerprints. An empty table gives an empty result.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = with_next(rows, key, "__text", lambda t: spots(t, anchors, chain))
    rows = rows.withColumn("n_chars", F.length("__text").cast("long")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substr("__text", F.lit(1), (F.col("n_chars") - F.col("__half")).cast("int"))
    rows = rows.withColumn("__edited", F.concat(kept, F.substr("__next_text", F.lit(1), F.col("__half"))))
    rows = rows.select(key, "n_chars", "__own", "__next_own", F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), spots(F.col("__edited"), anchors, chain).alias("__other"))
    return rows.select(
        key, "n_chars", "edited_sha256", spelled(F.col("__own")).alias("fingerprint"), spelled(F.col("__other")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__other")).alias("near_edited"), likeness(F.col("__own"), F.col("__next_own")).alias("near_next"),
        F.size("__own").cast("long").alias("n_spots"), F.size("__other").cast("long").alias("edited_spots"),
    )


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, anchors: list[str] = ANCHORS, chain: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): all documents whose fingerprints are alike by `least` or more.

    members: key, class (the smallest key with the same fingerprint), n_spots; rows without a key or signatures are in none. pairs: class, other_class
    (class < other_class) and likeness. Copies are one class, so pairs join different fingerprints only, and none is lost.

    Classes are parted by set length, lengths within a ratio of `least` in one part or in neighbours, and meet in a part only
    on the rarest of their signatures: of two sets alike by `least`, one of the first n - ceil(least * n) + 1 signatures by rising frequency
    is shared. A first shared signature's places bound what can follow; what is left is compared whole.
    """
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), spots(F.col(text), anchors, chain).alias("spots")).where(F.size("spots") > 0)
    own = settle(own)
    classes = settle(own.groupBy("spots").agg(F.min("key").alias("class")).withColumn("n", F.size("spots")))
    members = own.join(classes, "spots").select(F.col("key").alias(key), "class", F.col("n").cast("long").alias("n_spots"))
    single = classes.select("class", "n", F.explode("spots").alias("spot"))
    often = single.groupBy("spot").agg(F.count("*").alias("often"))
    ranked = single.join(often, "spot").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("often", "spot")))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    part = F.floor(F.log(F.col("n")) / -math.log(least)).cast("int")
    left = settle(prefix.where("often > 1").select("class", "n", "spot", "place", part.alias("part")))
    right = left.select(F.col("class").alias("other_class"), F.col("n").alias("m"), "spot", F.col("place").alias("other_place"), F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)).alias("part"))
    near = left.join(right, ["part", "spot"]).where("n < m or (n = m and class < other_class)").where(F.col("n") >= F.lit(least) * F.col("m") - 1e-9)
    need = F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9)
    first = near.groupBy("class", "other_class", "n", "m").agg(F.min(F.struct("place", "other_place")).alias("at"))
    first = first.where(F.least(F.col("n") - F.col("at.place"), F.col("m") - F.col("at.other_place")) + 1 >= need)
    both = first.join(classes.select("class", F.col("spots").alias("a")), "class").join(classes.select(F.col("class").alias("other_class"), F.col("spots").alias("b")), "other_class")
    alike = both.withColumn("likeness", likeness(F.col("a"), F.col("b"), least)).where(F.col("likeness") >= least)
    return members, alike.select(F.least("class", "other_class").alias("class"), F.greatest("class", "other_class").alias("other_class"), "likeness")
