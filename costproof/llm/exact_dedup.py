"""Exact de-duplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered; adjacent
numbers are then named in pairs, level by level, until each document has one integer. Two documents
have equal integers (at equal depth) exactly when their texts are equal: every name stands for one
block or one pair, never for a digest.

Text crosses the network once, already de-duplicated by each task. Block names find their way back over a
128-bit routing key that has been checked, against the sorted blocks, to be different for different
blocks; where it is not, other seeds are drawn and the check is made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costproof.llm.common import key_of, only, sha256_hex, stored

BLOCK_BYTES = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(data: Column, size: int) -> Column:
    """The blocks of a binary column; an empty one has a single empty block."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(data, i * F.lit(size) + 1, F.lit(size))
    )


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows sorted inside their partitions and numbered: a name per row, no two alike."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """A name per distinct block with its routing key, and the seed for which keys don't clash."""
    while True:
        keyed = blocks.select(*_route(F.col("block"), seed), "block").distinct()
        names = stored(_numbered(keyed, "h1", "h2", "block").select("h1", "h2", "name"), "block-names")
        clash = names.groupBy("h1", "h2").count().where("count > 1").limit(1).count()
        if not clash:
            return names, seed
        seed += 2


def _route(block: Column, seed: int) -> tuple[Column, Column]:
    return (
        F.xxhash64(F.lit(seed), block).alias("h1"),
        F.xxhash64(F.lit(seed + 1), block).alias("h2"),
    )


def identities(docs: DataFrame, data: Column, *keep: Column, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` numbered as ``uid`` with the columns ``keep``, and ``uid, depth, name`` of each.

    Equal pairs (depth, name) mean equal bytes ``data``, and nothing else does.
    """
    names, seed = _block_names(docs.select(F.explode(_blocks(data, block_bytes)).alias("block")), 42)
    routes = F.transform(_blocks(data, block_bytes), lambda b: F.struct(*_route(b, seed)))
    rows = stored(
        docs.select(F.monotonically_increasing_id().alias("uid"), *keep, routes.alias("routes")), "routes"
    )
    placed = rows.select("uid", F.posexplode("routes").alias("pos", "r")).select("uid", "pos", "r.*")
    level = placed.join(names, ["h1", "h2"]).select("uid", "pos", "name")
    return rows.drop("routes"), _paired(stored(level, "block-level"), 0)


def _paired(level: DataFrame, depth: int) -> DataFrame:
    """Name adjacent pairs until every document has one name; levels are as many as the longest needs."""
    done = None
    while True:
        sizes = level.groupBy("uid").agg(F.max("pos").alias("last"))
        out = level.join(sizes.where("last = 0").select("uid"), "uid").select(
            "uid", F.lit(depth).alias("depth"), "name"
        )
        done = out if done is None else done.unionByName(out)
        longer = level.join(sizes.where("last > 0").select("uid"), "uid")
        pairs = stored(
            longer.groupBy("uid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            f"pairs-{depth}",
        )
        if pairs.isEmpty():
            return done
        depth += 1
        names = stored(_numbered(pairs.select("a", "b").distinct(), "a", "b"), f"pair-names-{depth}")
        level = stored(pairs.join(names, ["a", "b"]).select("uid", "pos", "name"), f"level-{depth}")


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each row of ``docs`` with the row of its equal texts that stays.

    Adds ``keep_id, group_size, kept, text_sha256`` to ``doc_id``. Texts are compared after every run of
    white space has become one space; a null text is an empty one. The row with the smallest
    ``doc_id`` stays (null ids come last; of repeated ids the first row read). Repeated rows are copies
    of each other and one of them stays; an empty table gives an empty result.
    """
    clean = normalised(F.col(text))
    base, named = identities(
        docs,
        clean.cast("binary"),
        F.col(doc_id).alias("doc_id"),
        sha256_hex(clean).alias("text_sha256"),
        block_bytes=block_bytes,
    )
    rows = base.join(named, "uid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    kept = rows.groupBy("depth", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
    kept = stored(kept, "groups")  # so that both sides of the join are dealt anew and a hot group can be split
    return rows.join(kept, ["depth", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256",
        F.col("uid").alias("row"),
    )


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; every column stays as it was.

    The same row stays as in :func:`groups`. Rows go back to their text by id and text hash, so rows
    that agree in both are one row.
    """
    rows, named = identities(
        docs, normalised(F.col(text)).cast("binary"), key_of(doc_id, text).alias("key"), block_bytes=block_bytes
    )
    first = F.min(F.struct(F.col("key.id").isNull().alias("none"), F.col("key.id"), "uid", "key"))
    stay = rows.join(named, "uid").groupBy("depth", "name").agg(first.alias("f")).select("f.key")
    return only(docs, stay, doc_id, text)
