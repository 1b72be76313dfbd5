"""WARC records and a Merkle audit of their fixity.

``records`` makes WARC/1.1 ``resource`` records of pages; a file is a run of records, each at the offset where the one
before ends. A file takes the pages of one range of ids and gives each id a slot, so that a missing or surplus record
leaves all others in their slots. ``trees`` hashes of every slot its records (id, SHA-256 of the bytes, length, number of
equal ones) and, apart from that, their ranges of offsets; ordered slots are hashed by ``fanout`` into nodes, level by
level, up to one root a file. ``audit`` compares the roots of two replicas and descends only where digests differ, for
contents and for ranges apart; ``verdicts`` compares the records of the slots found: a record that the replica lacks or
holds with other bytes is damaged, one that it holds at another offset is moved, what it holds beyond that is surplus.

Bounds: an id of more than ``per_file`` different records, in either replica, takes files of its own (shelves), as many as
its records need, with slots by digest; so a file's records and slots are bounded, whatever repeats. Equal records of one
id are counted before anything is shuffled, and a tree is one row a file.

Defined results: null urls and bodies are empty; pages without an id are an id of their own (file null, slots by digest, in
which a changed record is one missing and one surplus); pages of equal ids
are records of their own, in the order of their digests; an empty replica is all missing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CRLF = "\r\n"
#: Stands for the file of pages without an id in joins; no range of ids has this number.
NO_FILE = -(1 << 63)


def record(url: Column, body: Column, ident: Column) -> Column:
    """The bytes of a WARC resource record, its date fixed so that equal pages give equal records."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(CRLF.join(["WARC/1.1", "WARC-Type: resource", "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Record-ID: <urn:page:"])), F.coalesce(ident.cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF * 2).cast("binary"))


def digests(pages: DataFrame, per_file: int) -> DataFrame:
    """page_id, fk (the file), digest, length and n of the different records; n counts equal ones."""
    data = pages.select(F.col("page_id").cast("bigint").alias("page_id"), record(F.col("url").cast("string"), F.col("html").cast("string"), F.col("page_id")).alias("data"))
    small = data.select("page_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("bigint").alias("length"))
    counted = small.groupBy("page_id", "digest", "length").agg(F.count("*").alias("n"))
    return counted.withColumn("fk", F.coalesce(F.floor(F.col("page_id") / per_file).cast("bigint"), F.lit(NO_FILE)))


def shelves(per_file: int, *sides: DataFrame) -> DataFrame:
    """page_id and shelves (a power of two) of the ids that need files of their own; the same for all sides."""
    most = [d.groupBy("page_id").agg(F.count("*").alias("n")).filter(F.col("n") > per_file) for d in sides]
    every = most[0]
    for m in most[1:]:
        every = every.unionByName(m)
    return every.groupBy("page_id").agg(F.pow(F.lit(2), F.ceil(F.log2(F.max("n") / (per_file / 2)))).cast("bigint").alias("shelves"))


def placed(found: DataFrame, big: DataFrame | None, per_file: int) -> DataFrame:
    """``found`` with shelf, slot, place and offset of the first of equal records."""
    bits = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")
    own = F.pmod(F.col("page_id"), F.lit(per_file))
    if big is None:
        got = found.withColumn("shelf", F.lit(0).cast("bigint")).withColumn("slot", F.coalesce(own, F.pmod(bits, F.lit(per_file))))
    else:
        big = big.select(F.col("page_id").alias("big_id"), "shelves")
        got = found.join(big, F.col("page_id").eqNullSafe(F.col("big_id")), "left").drop("big_id")
        # Shelf 0 is the range's common file; those of its large ids are numbered behind it, each id's apart.
        at = 1 + F.coalesce(own, F.lit(0)) * (1 << 40) + F.pmod(bits, F.col("shelves"))
        got = got.withColumn("slot", F.coalesce(F.when(F.col("shelves").isNull(), own), F.pmod(F.floor(bits / F.coalesce("shelves", F.lit(1))), F.lit(per_file))))
        got = got.withColumn("shelf", F.when(F.col("shelves").isNull(), 0).otherwise(at)).drop("shelves")
    w = Window.partitionBy("fk", "shelf").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("offset", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)))


def records(pages: DataFrame, *, per_file: int = 512) -> DataFrame:
    """page_id, file, shelf, place, offset, length and digest of every record."""
    found = common.written(digests(pages, per_file), "digests")
    big = shelves(per_file, found)
    return _each(placed(found, None if big.isEmpty() else big, per_file)).select("page_id", F.when(F.col("fk") != NO_FILE, F.col("fk")).alias("file"), "shelf", "place", "offset", "length", "digest")


def _each(recs: DataFrame) -> DataFrame:
    """A row each of equal records, numbered by ``copy``."""
    one = recs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return one.withColumn("place", F.col("place") + F.col("copy")).withColumn("offset", F.col("offset") + F.col("copy") * F.col("length"))


def depth(per_file: int, fanout: int) -> int:
    d, n = 0, max(1, per_file)
    while n > 1:
        n, d = -(-n // fanout), d + 1
    return d


def _sha(values: Column) -> Column:
    return F.sha2(F.concat_ws(",", values), 256)


def _above(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above, each holding its up to ``fanout`` kids in order: their hashes hashed together, contents and ranges apart."""
    kids = [c for c in ("node", "contents", "ranges", "kids") if c in level.columns]
    up = level.groupBy("fk", "shelf", F.floor(F.col("node") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct(*kids))).alias("kids"))

    def hashed(what: str) -> Column:
        return _sha(F.transform("kids", lambda x: F.concat_ws("=", (x["node"] % fanout).cast("string"), x[what]))).alias(what)

    return up.select("fk", "shelf", F.col("up").alias("node"), hashed("contents"), hashed("ranges"), "kids")


def trees(recs: DataFrame, *, per_file: int = 512, fanout: int = 16) -> DataFrame:
    """A row each file: its root (node, contents, ranges, kids), which holds the nodes below it, down to the slots.

    Every level is one aggregation over rows that are dealt by file already.
    """
    kept = F.array_sort(F.collect_list(F.struct("page_id", "digest", "length", "n", "offset")))
    slots = recs.groupBy("fk", "shelf", F.col("slot").cast("bigint").alias("node")).agg(kept.alias("recs"))
    contents = _sha(F.transform("recs", lambda r: F.concat_ws(":", F.coalesce(r["page_id"].cast("string"), F.lit("")), r["digest"], r["length"].cast("string"), r["n"].cast("string"))))
    ranges = _sha(F.transform("recs", lambda r: F.concat_ws(":", r["offset"].cast("string"), (r["length"] * r["n"]).cast("string"))))
    out = slots.select("fk", "shelf", "node", contents.alias("contents"), ranges.alias("ranges"))
    for _ in range(max(1, depth(per_file, fanout))):
        out = _above(out, fanout)
    return out


def audit(left: DataFrame, right: DataFrame, *, per_file: int = 512, fanout: int = 16) -> DataFrame:
    """(fk, shelf, slot, contents, ranges) of the slots that differ, and in what: roots first, then only the kids of
    differing nodes, at most ``fanout`` a side."""
    a, b = (x.select("fk", "shelf", F.struct("node", "contents", "ranges", "kids").alias(name)) for x, name in ((left, "a"), (right, "b")))
    both, differ = a.join(b, ["fk", "shelf"], "full"), F.expr("not (a.contents <=> b.contents and a.ranges <=> b.ranges)")
    for _ in range(max(1, depth(per_file, fanout))):
        kids = F.expr("transform(array_union(transform(coalesce(a.kids, array()), x -> x.node), transform(coalesce(b.kids, array()), x -> x.node)), n -> struct(get(filter(a.kids, x -> x.node = n), 0) as a, get(filter(b.kids, x -> x.node = n), 0) as b))")
        both = both.filter(differ).select("fk", "shelf", F.explode(kids).alias("kid")).select("fk", "shelf", "kid.a", "kid.b")
    return both.filter(differ).selectExpr("fk", "shelf", "coalesce(a.node, b.node) as slot", "not (a.contents <=> b.contents) as contents", "not (a.ranges <=> b.ranges) as ranges")


def verdicts(left: DataFrame, right: DataFrame, *, per_file: int = 512, fanout: int = 16, surplus: bool = False) -> DataFrame:
    """page_id, warc_file, shelf, place, record_offset, record_length, record_sha256, damaged and moved of every record of
    ``left``, audited against ``right``.

    surplus: also, as damaged, the records of ``right`` that ``left`` lacks, at their places there, beyond those that stand for
    a damaged one of the same id.
    """
    found = [common.written(digests(x, per_file), "digests") for x in (left, right)]
    big = shelves(per_file, *found)
    big = None if big.isEmpty() else common.written(big, "shelves")
    a, b = (common.written(placed(x, big, per_file), "records") for x in found)
    for x in found:
        common.discard(x)
    bad = common.written(audit(*(trees(x, per_file=per_file, fanout=fanout) for x in (a, b)), per_file=per_file, fanout=fanout), "slots")
    at, key = ["fk", "shelf", "slot"], ["page_id", "digest"]
    theirs = b.join(bad, at, "left_semi").select(*at, F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("n").alias("r_n"), F.col("offset").alias("r_offset"))
    slots = a.join(bad.select(*at, F.lit(True).alias("bad")), at, "left")
    same = [slots[c] == theirs[c] for c in at] + [slots["page_id"].eqNullSafe(theirs["r_id"]), slots["digest"] == theirs["r_digest"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    mine = slots.join(theirs, cond, "left").select(*(slots[c] for c in a.columns), "bad", "r_n", "r_offset")
    held = F.when(F.col("bad").isNull(), F.col("n")).otherwise(F.coalesce("r_n", F.lit(0)))
    one = _each(mine.withColumn("held", held))
    moved = F.coalesce((F.col("copy") < F.col("held")) & (F.col("offset") - F.col("copy") * F.col("length") != F.col("r_offset")), F.lit(False))
    got = one.select("page_id", "fk", "shelf", "place", "offset", "length", "digest", (F.col("copy") >= F.col("held")).alias("damaged"), moved.alias("moved"))
    if surplus:
        both = a.join(bad.filter("contents"), at, "left_semi").select(*at, *key, "length", F.col("n").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("offset"))
        both = both.unionByName(b.join(bad.filter("contents"), at, "left_semi").select(*at, *key, "length", F.lit(0).cast("bigint").alias("x"), F.col("n").alias("y"), "place", "offset"))
        net = both.groupBy(*at, *key, "length").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("place").alias("place"), F.max("offset").alias("offset"))
        of_id = Window.partitionBy(*at, "page_id")
        over = F.greatest(F.col("y") - F.col("x"), F.lit(0))
        net = net.withColumn("missing", F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).over(of_id)).withColumn("before", F.coalesce(F.sum(over).over(of_id.orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        extra = net.withColumn("n", F.least(over, F.col("before") + over - F.col("missing"))).filter("n > 0")
        # Of equal records the last ones are the surplus.
        extra = extra.withColumn("place", F.col("place") + F.col("y") - F.col("n")).withColumn("offset", F.col("offset") + (F.col("y") - F.col("n")) * F.col("length"))
        got = got.unionByName(_each(extra).select("page_id", "fk", "shelf", "place", "offset", "length", "digest", F.lit(True).alias("damaged"), F.lit(False).alias("moved")))
    file = F.when(F.col("fk") != NO_FILE, F.col("fk"))
    return got.select("page_id", file.alias("warc_file"), "shelf", "place", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("record_sha256"), "damaged", "moved")
