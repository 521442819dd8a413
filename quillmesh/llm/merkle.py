"""Fixity audit of WARC archives by Merkle trees, in DataFrame operations.

A page becomes a WARC response record; records lie one after another in the
order of their ids, so each has an offset. The index of the archive (id,
offset, length, place) is what its replicas share.

Leaves are digests of records with their offset and length. Level 1 joins the
records whose offsets fall into one range of ``range_bytes``; every further
level joins ``FANOUT`` neighbouring nodes; the root joins all that is left. A
node's digest is the SHA-256 of its children's digests in order, each with its
own number, so a missing child changes it.

A replica is audited against the index of the primary: its records take the
places that the index gives them, whatever its own bytes are, so that damage
that moves all later offsets is still found where it is. Records that the index
doesn't know form a range of their own, ``UNKNOWN``, which the root joins too:
equal roots prove equal archives.

The audit compares roots; below, it opens only children of nodes that differ,
level by level, and ends at the damaged records. Where the roots are equal,
nothing below them is read. Leaves lie in order of their range; those of open
ranges alone are read, the rest is left out by the files' own statistics. No
level is collected; a few hundred numbers of open ranges are, or their bounds.

Null urls and bodies are empty; null ids come first, in order of their urls,
and of their digests where they have none (damage to such a record shows as a
missing and an extra one); rows that repeat an id keep their place by url and
digest, so damage to one of two rows with equal id and url may be reported for
the other. A record that a
replica lacks is ``missing``, one with other bytes ``corrupt``; the replica's
rows that the index doesn't know are ``extra``. Very long bodies are hashed
where they are read and never shuffled. An empty archive has no root and
nothing to report. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import running_sums
from .common import stored

RANGE_BYTES = 1 << 16
FANOUT = 16
#: The range of a replica's records that the index doesn't know.
UNKNOWN = -1
#: Open ranges up to which a read names each of them; beyond, their bounds.
NAMED = 256


def payload(url: Column, body: Column) -> Column:
    """The bytes of a record, two line ends after it included."""
    text = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), text, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id, key (the id as text; of a null id the url, or else the digest, so that such rows are told apart and join too), turn (of rows that repeat a key), length and SHA-256 of each record; the bodies stay where they are read."""
    raw = payload(F.col(url_col), F.col(body_col))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.coalesce(F.col(url_col), F.sha2(raw, 256))))
    out = pages.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    return out.withColumn("turn", F.row_number().over(W.partitionBy("key").orderBy("url", "digest"))).drop("url")


def index(recs: DataFrame) -> DataFrame:
    """id, key, turn, offset, length, place: offsets and places are running sums over range partitions of the ids."""
    order = [F.col("id").asc_nulls_first(), F.col("key"), F.col("turn")]
    run = running_sums(recs.select("id", "key", "turn", "length"), order, {"offset": F.col("length"), "place": F.lit(1)})
    return run.select("id", "key", "turn", "offset", "length", "place")


def _joined(children: DataFrame, level: int) -> DataFrame:
    """Nodes (level, node, digest) from children (parent, child, digest)."""
    ordered = F.array_sort(F.collect_list(F.struct("child", "digest")))
    text = F.concat_ws("|", F.transform(ordered, lambda c: F.concat_ws(":", c["child"], c["digest"])))
    return children.groupBy("parent").agg(F.sha2(text.cast("binary"), 256).alias("digest")).select(F.lit(level).alias("level"), F.col("parent").alias("node"),
        "digest")


def placed(recs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The leaves: records with what the index gives them, in order of their range."""
    out = recs.withColumnRenamed("id", "own").join(ranges, ["key", "turn"], "left").withColumn("range", F.coalesce("range", F.lit(UNKNOWN).cast("long")))
    out = out.withColumn("id", F.coalesce("id", "own")).select("id", "key", "turn", "offset", "length", "place", "range", "digest")
    return stored(out.repartitionByRange("range", "key").sortWithinPartitions("range"), "merkle-leaves")


def tree(leaves: DataFrame, last: int) -> DataFrame:
    """level, node, digest of levels 1 to last, and of the root above them, node 0 of level last + 1."""
    child = F.coalesce(F.col("place").cast("string"), F.concat_ws(" ", "key", "turn"))
    leaf = F.concat_ws("+", F.coalesce(F.col("offset"), F.lit(-1)), "length", "digest")
    out = now = stored(_joined(leaves.select(F.col("range").alias("parent"), child.alias("child"), leaf.alias("digest")), 1), "merkle-ranges")
    for level in range(2, last + 2):
        parent = F.floor(F.col("node") / FANOUT) if level <= last else F.lit(0).cast("long")
        now = _joined(now.select(parent.alias("parent"), F.col("node").alias("child"), "digest"), level)
        out = out.unionByName(now)
    return stored(out, "merkle-tree")


def under(leaves: DataFrame, open_: DataFrame) -> DataFrame:
    """The leaves of open ranges (parent), by a filter that their files' statistics answer, then exactly."""
    if (some := open_.limit(NAMED + 1).collect()) and len(some) <= NAMED:
        return leaves.where(F.col("range").isin([r.parent for r in some]))
    low, high = open_.agg(F.min("parent"), F.max("parent")).first()
    return leaves.where(F.col("range").between(low, high)).join(open_, F.col("range") == F.col("parent"), "left_semi")


class Archive:
    """The leaves and the tree of a primary; its replicas are audited against them."""

    def __init__(self, pages: DataFrame, range_bytes: int = RANGE_BYTES, **columns: str):
        self.columns = columns
        recs = stored(records(pages, **columns), "merkle-records")
        self.index = stored(index(recs).withColumn("range", F.floor(F.col("offset") / range_bytes)), "merkle-index")
        top = self.index.agg(F.max("range")).first()[0]
        self.last = 1
        while top is not None and top // FANOUT ** (self.last - 1) > 0:
            self.last += 1
        self.ranges = self.index.select("id", "key", "turn", "offset", "place", "range")
        self.leaves = placed(recs, self.ranges)
        self.tree = tree(self.leaves, self.last)

    def audit(self, replica: DataFrame) -> DataFrame:
        """id, key, turn, status of each record of a replica that isn't as in the primary."""
        theirs = placed(stored(records(replica, **self.columns), "merkle-replica"), self.ranges)
        other = tree(theirs, self.last)
        open_ = None
        for level in range(self.last + 1, 0, -1):
            a = self.tree.where(F.col("level") == level).select("node", "digest")
            b = other.where(F.col("level") == level).select("node", F.col("digest").alias("copy"))
            if open_ is not None:
                parent = F.floor(F.col("node") / FANOUT) if level < self.last else F.lit(0).cast("long")
                a, b = a.join(open_, parent == F.col("parent"), "left_semi"), b.join(open_, parent == F.col("parent"), "left_semi")
            wrong = a.join(b, "node", "full").where(~F.col("digest").eqNullSafe(F.col("copy")))
            open_ = wrong.select(F.col("node").alias("parent"))
            if level > self.last and open_.isEmpty():  # equal roots: nothing below is read
                return replica.sparkSession.createDataFrame([], self.index.select("id", "key", "turn", F.lit("").alias("status")).schema)
        open_ = stored(open_, "merkle-open")
        mine = under(self.leaves, open_).select("id", "key", "turn", "digest")
        copies = under(theirs, open_).select(F.col("id").alias("id2"), "key", "turn", F.col("digest").alias("copy"))
        pair = mine.join(copies, ["key", "turn"], "full").where(~F.col("digest").eqNullSafe(F.col("copy")))
        status = F.when(F.col("copy").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
        return pair.select(F.when(F.col("digest").isNull(), F.col("id2")).otherwise(F.col("id")).alias("id"), "key", "turn", status.alias("status"))


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with known damage: by a hash of the id, one body in 211 has a byte changed, one page in 499 is gone."""
    h = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long")
    body = F.when(h % 211 == 7, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    return pages.where(~F.coalesce(h % 499 == 11, F.lit(False))).withColumn("html", body)


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, rec_offset, rec_length, range_id, digest and status (ok, corrupt, missing) of every record of the primary."""
    archive = Archive(pages)
    bad = archive.audit(replica).where("status != 'extra'")
    out = archive.leaves.join(bad.drop("id"), ["key", "turn"], "left")
    return out.select(F.col("id").alias("page_id"), F.col("offset").alias("rec_offset"), F.col("length").alias("rec_length"), F.col("range").alias("range_id"),
        "digest", F.coalesce("status", F.lit("ok")).alias("status"))


FIXITY_SQL = r"""
WITH r AS (SELECT page_id, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS raw FROM pages),
o AS (SELECT page_id, html, strlen(raw)::BIGINT AS rec_length, sha256(raw) AS digest,
    coalesce(sum(strlen(raw)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec_offset FROM r)
SELECT page_id, rec_offset, rec_length, rec_offset // 65536 AS range_id, digest,
    CASE WHEN ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 499 = 11 THEN 'missing'
         WHEN ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 211 = 7 AND '?' || substr(html, 2) <> html THEN 'corrupt' ELSE 'ok' END AS status FROM o
"""
