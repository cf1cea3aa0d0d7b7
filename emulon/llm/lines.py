"""Near-duplicate lines over all documents, by an exact set-similarity join in SQL functions.

A line is the set of its lower-cased words. A line goes if an earlier one has a Jaccard similarity of at least
``similarity`` with it; earlier means a smaller key, or the same key and a smaller line number.  Lines
without words stay.

Equal sets are one set at their first place. Of each set, words are ordered from rare to frequent; two neighbours in
this order are a run.  Where few words differ, few runs do, so two similar sets share a run within the first
``0.4 * size + 1`` (the prefix, for a similarity of 0.8).  A set has a sketch: the parity of its words in each of 256 classes; two sets differ
by as many words at least as parities, so the sketches rule out most pairs that are not similar.

Sets with a common run meet first with the earliest of those that have it and, where they are many, with the earlier one that shares
most runs with others: two candidates a run, however many near copies there are.  Sets that find no match so meet all others of their runs, if
sizes (length filter), words before and after the run (positional filter) and the sketches allow a match; runs that follow one
another in both sets list the pair once.  What remains is verified on the words.

Rarity need only be roughly known, as any order is exact: words are counted in 2**16 buckets by hash, and the logarithms of the
counts travel with the plan (512 KB).  A table of bits tells which lines verification must fetch, 16 bits a line and 64 MB at most; a
line wrongly fetched is dropped by the join.

Everything on the main path is DataFrame and SQL functions.

Nulls and oddities: a null text stays null; an empty one, and empty lines, stay; a null key comes last; rows that share
a key are one document as far as order goes, so lines at the same place in them do not remove each other, and
repeated rows are treated alike; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulon.llm.common import spare
from emulon.runtime import cut_lineage, drop_step, passing_steps

LAST = 2**63 - 1
RARITY_BITS = 16  # buckets of words: enough to tell frequent words from others
PART_SETS = 250_000  # sets whose runs are dealt at a time, until there are three parts
CROWD = 8  # sets of a run among which the one that shares most with others is worth looking for


def _table(counted: DataFrame, value: Column) -> Column:
    """An array of the ``value`` of each row of ``counted``, which has all numbers ``bucket`` from 0 on.

    A written table of one row, read by a scalar subquery, so that the plan does not hold the array."""
    items = counted.select(F.shiftright("bucket", PIECE).alias("piece"), F.struct("bucket", value.alias("value")).alias("item"))
    pieces = items.groupBy("piece").agg(
        F.transform(F.sort_array(F.collect_list("item")), lambda i: i["value"]).alias("values")).select(F.struct("piece", "values").alias("item"))
    return cut_lineage(pieces.agg(F.flatten(F.transform(F.sort_array(F.collect_list("item")), lambda i: i["values"])).alias("values"))).scalar()


PIECE = 12  # bits of the buckets joined in the first step
SKETCH = 4  # longs of 64 parities
WIDE = 1  # the places' number among the steps: the table of rarities comes first


def _rarity() -> Column:
    """A quarter of a power of two per step, 124 at most, in the upper byte; 0 is for what does not occur."""
    level = F.when(F.col("n") > 0, F.least(F.lit(124), 1 + F.floor(4 * F.log2("n")))).otherwise(0)
    return F.shiftleft(level.cast("long"), 56)


def _bucket(hashed: Column, bits: int) -> Column:
    return hashed.bitwiseAND((1 << bits) - 1)


def _plain(text: Column) -> Column:
    """In lower case, with a blank for each other white space but the end of a line."""
    low = F.lower(text)
    other = ["\t", "\r", "\f", "\v"]
    blanks = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), other, low)
    return F.when(reduce(lambda x, y: x | y, [F.contains(low, F.lit(c)) for c in other]), blanks).otherwise(low)


def _split(line: Column) -> Column:
    """Words of a plain line and, where white space is doubled, empty strings."""
    return F.split(line, " ")


def _lines(docs: DataFrame, key: str, text: str, plain: bool = True) -> DataFrame:
    """doc (null key: last), whole (hash of the text), line, content (plain or as it is)."""
    body = F.col(f"`{text}`")
    base = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(body).alias("whole"), (_plain(body) if plain else body).alias("text"))
    return base.select("doc", "whole", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def _flags(places: DataFrame, keys: list[str], bits: int) -> Column:
    """Whether the place of the current row may be among ``places``; wrong only in that it may be true too often."""
    hashed = F.xxhash64(*keys)
    bucket, bit = _bucket(F.shiftright(hashed, 6), bits - 6), hashed.bitwiseAND(63).cast("int")  # 64 flags a number
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    every = places.select(bucket.alias("bucket"), one.alias("flag")).unionAll(
        places.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("flag")))
    table = _table(every.groupBy("bucket").agg(F.bit_or("flag").alias("flags")), F.col("flags"))
    return F.get(table, bucket.cast("int")).bitwiseAND(one) != 0


def _flag_bits(places: DataFrame) -> int:
    """Sixteen flags for each place, up to 64 MB."""
    return min(29, max(PIECE, (16 * places.count()).bit_length()))


def later_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc, whole, lines: per document the numbers of the lines that go (written; the steps on the way are deleted)."""
    with passing_steps(docs.sparkSession) as passing:
        going = cut_lineage(_going(docs, key, text, similarity))
        if passing:
            passing.pop()  # the result, written last
    return going


def _going(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    places = cut_lineage(_places(docs, key, text, similarity)).where("size > 0")
    firsts = places.groupBy("name", "check").agg(F.min(F.struct("doc", "line", "whole", "size")).alias("first"))
    # ids are in the order of places
    firsts = cut_lineage(firsts.select("name", "check", "first.*").orderBy("doc", "line").withColumn("id", F.monotonically_increasing_id()))
    # a set too small to be similar to a larger one only matches itself
    some = places.where(F.floor(F.col("size") / similarity + 1e-9) > F.col("size"))
    at = ["name", "check", "doc", "line"]
    sets = cut_lineage(some.join(firsts.select(*at, "id"), at).select("id", "size", "prefix", *_sketches()))
    places = cut_lineage(places.select("doc", "whole", "line", "name", "check"))
    drop_step(docs.sparkSession, WIDE)  # prefixes and sketches of sets are enough

    met = _meetings(sets, similarity)
    # a line goes by one match: the first of all that share a run and the one among many are tried first, others where that fails
    pairs = cut_lineage(_resembling(_leaders(met, similarity).union(_centres(met, similarity)).distinct(), sets, similarity))
    gone = cut_lineage(_verified(docs, key, text, pairs, firsts, similarity))
    others = cut_lineage(_others(met, sets, gone, pairs, similarity))
    gone = gone.unionByName(_verified(docs, key, text, others, firsts, similarity))
    gone = gone.select(F.col("later").alias("id")).withColumn("gone", F.lit(True))
    known = firsts.select("id", "name", "check", "doc", "line").join(gone, "id", "left").select(
        "name", "check", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"), "gone")
    going = places.join(known, ["name", "check"]).where(
        F.col("gone").isNotNull() | (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line")))
    return going.groupBy("doc", "whole").agg(F.collect_set("line").alias("lines"))


def _sketches() -> list[str]:
    return [f"s{i}" for i in range(SKETCH)]


def _places(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """Each line with its set's name, size, prefix (from rare words to frequent ones) and sketch.

    The sketch is the parity of the number of words in each of 256 classes: two sets differ by as many words at least as parities."""
    bits = RARITY_BITS
    words = _lines(docs, key, text).select(F.explode(_split(F.col("content"))).alias("word"))
    every = words.select(_bucket(F.xxhash64("word"), bits).alias("bucket")).unionAll(docs.sparkSession.range(1 << bits).toDF("bucket"))
    rarity = _table(every.groupBy("bucket").agg((F.count("*") - 1).alias("n")), _rarity())

    def rank(h: Column) -> Column:
        """A word's number: its rarity, then its hash.  Equal words have equal numbers."""
        return F.col("rarity")[_bucket(h, bits)].bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.array_remove(F.transform(_split(F.col("content")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    numbers = F.sort_array(F.array_distinct(F.transform(hashes, rank)))
    # content and table are used once, so Spark puts the subquery into the expression and no row holds the table
    lines = _lines(docs, key, text).withColumn("rarity", rarity).select("doc", "whole", "line", numbers.alias("numbers"))
    # parts of a sketch take the words between two borders of the hash
    borders = [(2 * i - SKETCH) * (2**63 // SKETCH) for i in range(1, SKETCH)]
    dealt = F.sort_array(F.concat(F.transform("numbers", lambda n: F.shiftleft(n, 8)), F.array(*[F.lit(b).cast("long") for b in borders])))
    dealt = lines.select("*", dealt.alias("dealt")).select("*", *[F.array_position("dealt", F.lit(b).cast("long")).cast("int").alias(f"at{i}") for i, b in enumerate(borders, 1)])
    ends = [F.lit(0), *[F.col(f"at{i}") for i in range(1, SKETCH)], F.size("dealt") + 1]

    def odd(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda found, n: found.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(n, 8).bitwiseAND(63).cast("int"))))

    head = F.slice("numbers", F.lit(1), _runs(F.size("numbers"), similarity) + _run(similarity) - 1)
    # a filter on the size would have the numbers made twice: lines without words go when this is read
    return dealt.select(
        "doc", "whole", "line", F.xxhash64("numbers").alias("name"), F.hash("numbers").alias("check"), F.size("numbers").alias("size"),
        F.transform(head, lambda n: n.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
        *[odd(F.slice("dealt", ends[i] + 1, ends[i + 1] - ends[i] - 1)).alias(s) for i, s in enumerate(_sketches())])


def _run(similarity: float) -> int:
    """Words of a run: two neighbours, or one where a small similarity could leave no two neighbours together."""
    return 2 if similarity >= 0.7 else 1


def _runs(size: Column, similarity: float) -> Column:
    """How many runs of a set are looked at: one more than can be missing in a similar set.

    If ``d`` of ``size`` words are missing there and ``i`` others come in, ``d + similarity * i <= (1 - similarity) * size``.  A missing word
    breaks as many runs as have it, a new one between two words one run of two: with ``similarity >= 0.5`` missing words break the most."""
    return (F.floor((1 - similarity) * _run(similarity) * size + 1e-9) + 1).cast("int")


def _meetings(sets: DataFrame, similarity: float) -> DataFrame:
    """``word, id, size, place, n, leader``: the runs that ``n`` sets share, their place in the set, and the first of these sets.

    Of many sets a part of the runs is dealt at a time, so that no more than that lies on the disks."""
    length = F.size("prefix") - (_run(similarity) - 1)
    runs = sets.select("id", "size", "prefix", F.posexplode(F.slice("prefix", F.lit(1), length)).alias("place", "word"))
    word = F.col("word").cast("long")
    if _run(similarity) == 2:
        word = F.shiftleft(word, 31).bitwiseOR(F.get("prefix", F.col("place") + 1))
    runs = runs.select("id", "size", "place", word.alias("word"))
    sharing = Window.partitionBy("word")
    parts = 1 + min(2, sets.count() // PART_SETS)
    met = [cut_lineage(runs.where(F.col("word") % parts == i).withColumns({
        "leader": F.min(F.struct("id", "size", "place")).over(sharing), "last": F.max("id").over(sharing), "n": F.count("*").over(sharing)}).where(
            "leader.id < last").drop("last")) for i in range(parts)]
    return reduce(DataFrame.unionByName, met)


def _overlap(one: str, other: str, similarity: float) -> Column:
    """The words that sets of these sizes share at least, if they are similar."""
    return F.ceil(similarity / (1 + similarity) * (F.col(f"{one}.size") + F.col(f"{other}.size")) - 1e-9)


def _differ(one: str, other: str, similarity: float) -> Column:
    """The words that similar sets of these sizes have apart at most."""
    return F.col(f"{one}.size") + F.col(f"{other}.size") - 2 * _overlap(one, other, similarity)


def _fits(one: str, other: str, similarity: float) -> Column:
    """Whether two different sets that share a run may be similar, by their sizes and the number of words before and after its start."""
    a, b = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    differ = _differ(one, other, similarity)
    before, after = F.abs(a("place") - b("place")), F.abs(a("size") - a("place") - b("size") + b("place"))
    return (differ >= 1) & (before + after <= differ)


def _alike(one: str, other: str, similarity: float) -> Column:
    """Whether two sets may be similar, by their sketches."""
    apart = [F.bit_count(F.col(f"{one}.{s}").bitwiseXOR(F.col(f"{other}.{s}"))) for s in _sketches()]
    return reduce(lambda x, y: x + y, apart) <= _differ(one, other, similarity)


def _leaders(met: DataFrame, similarity: float) -> DataFrame:
    """``later, earlier``: sets with the first of those that share a run, if the two may be similar."""
    both = met.select(F.struct("id", "size", "place").alias("b"), F.col("leader").alias("a")).where("a.id < b.id")
    return both.where(_fits("a", "b", similarity)).select(F.col("b.id").alias("later"), F.col("a.id").alias("earlier")).distinct()


def _centres(met: DataFrame, similarity: float) -> DataFrame:
    """``later, earlier``: sets with the earlier one of a run that shares most with others, if the two may be similar.

    Copies with few changes share the most, and they resemble the most."""
    several = met.where(F.col("n") > CROWD).select("word", "id", "size", "place", F.sum(F.floor(4 * F.log2("n"))).over(Window.partitionBy("id")).alias("shared"))
    before = Window.partitionBy("word").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    both = several.select(F.struct("id", "size", "place").alias("b"), F.max(F.struct("shared", "id", "size", "place")).over(before).alias("a")).where("a.id < b.id")
    return both.where(_fits("a", "b", similarity)).select(F.col("b.id").alias("later"), F.col("a.id").alias("earlier")).distinct()


def _resembling(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``later, earlier`` of the pairs that may be similar by their sketches."""
    known = F.struct("size", *_sketches())
    # a set has a row for each repetition of its first place
    both = pairs.join(sets.select(F.col("id").alias("later"), known.alias("b")), "later").join(sets.select(F.col("id").alias("earlier"), known.alias("a")), "earlier")
    return both.where(_alike("a", "b", similarity)).select("later", "earlier").distinct()


def _others(met: DataFrame, sets: DataFrame, gone: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """``later, earlier``: sets that are left with all others of their runs that may be similar, but for those tried.

    Of runs that follow one another in both sets only the first lists the pair."""
    known = sets.select("id", "prefix", *_sketches()).join(gone.select(F.col("later").alias("id"), F.lit(True).alias("gone")), "id", "left")
    several = met.where("n > 2").select("word", "id", "size", "place", (F.col("leader.id") < F.col("id")).alias("follows")).join(known, "id")
    several = several.select("word", "id", "size", "place", *_sketches(), F.coalesce(F.get("prefix", F.col("place") - 1), F.lit(-1)).alias("prior"),
                             (F.col("gone").isNull() & F.col("follows")).alias("open"))
    several = several.withColumn("asked", F.max("open").over(Window.partitionBy("word"))).where("asked")
    new = (F.col("a.prior") != F.col("b.prior")) | (F.col("a.prior") < 0)
    both = several.where("open").alias("b").join(several.alias("a"), (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id"))
                                                 & new & _fits("a", "b", similarity) & _alike("a", "b", similarity))
    pairs = both.select(F.col("b.id").alias("later"), F.col("a.id").alias("earlier")).distinct()
    return pairs.join(tried, ["later", "earlier"], "left_anti")


def _verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """``later`` of the pairs of sets (later, earlier) that are similar: their texts are fetched from the documents and compared."""
    asked = pairs.select(F.col("later").alias("id")).union(pairs.select("earlier")).distinct()
    asked = cut_lineage(asked.join(firsts.select("id", "doc", "line", "whole", "size"), "id"))
    at = ["doc", "line", "whole"]
    found = _lines(docs, key, text, plain=False).where(_flags(asked, at, _flag_bits(asked))).join(asked, at).dropDuplicates(["id"])
    one, other = (found.select(F.col("id").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in ("doc", "line", "size")],
                              _plain(F.col("content")).alias(f"{c}_content"))
                  for c in ("later", "earlier"))
    # ids of sets at one place have an order, the sets have none
    apart = (F.col("later_doc") != F.col("earlier_doc")) | (F.col("later_line") != F.col("earlier_line"))
    # sizes are known and each text is used once, so each is split once
    shared = F.size(F.array_intersect(F.array_remove(_split(F.col("later_content")), ""), _split(F.col("earlier_content"))))
    enough = shared * (1 + similarity) >= similarity * (F.col("later_size") + F.col("earlier_size")) - 1e-9
    return pairs.join(one, "later").join(other, "earlier").where(apart & enough).select("later").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8,
                counts: tuple[str, str] | None = ("__lines", "__gone")) -> DataFrame:
    """All rows and columns, ``text`` without the lines that go; and the numbers of lines before and removed, under the names of ``counts``.

    Documents that may lose lines meet their list in a join; the others pass without a shuffle."""
    going = later_matches(docs, key, text, similarity)
    body = F.col(f"`{text}`")
    doc, whole, gone = (spare(docs, c) for c in ("__doc", "__whole", "__list"))
    named = docs.withColumns({doc: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)), whole: F.xxhash64(body)})
    flagged = _flags(going.select(F.col("doc").alias(doc), F.col("whole").alias(whole)), [doc, whole], _flag_bits(going))
    losing = named.where(flagged).join(
        going.select(F.col("doc").alias(doc), F.col("whole").alias(whole), F.col("lines").alias(gone)), [doc, whole], "left")
    every = F.split(body, "\n")
    kept = F.array_join(F.filter(every, lambda _, i: ~F.array_contains(gone, i)), "\n")
    before = F.when(body.isNotNull(), F.size(every))
    named_counts = (lambda n: [before.alias(counts[0]), n.alias(counts[1])]) if counts else (lambda n: [])
    others = [F.col(f"`{c}`") for c in docs.columns]
    changed = [F.when(F.col(gone).isNull(), body).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return losing.select(*changed, *named_counts(F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))).unionByName(
        named.where(~flagged).select(*others, *named_counts(F.lit(0))))
