"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. In round d each active class is split by its members' d-th
turn, so the classes of round d are the trie's nodes of depth d. A class with one distinct sequence
left is retired: the rest of that sequence is a chain of nodes with one child each, which is emitted
straight from its turns. When no class is active, counts are folded back from the deepest round to
the root. Conversations with the same sequence of turns are one member with a weight, so copies cost
no rounds; a class is named by the SHA-256 of its parent's name and the turn, a turn by the SHA-256
of its role and text, so splitting needs no join on a class, which may hold all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.llm.running import join_hot, running
from tidewatch.operators.components import stored

#: Turns of the conversation before that may be copied: a hash of the id, modulo this.
COPIED = 9
#: A conversation's turns may be copied by those whose ids share its run of so many.
FAMILY = 5
#: Turns of this depth or more lie in one partition of the table of turns.
DEEP = 16
#: Ids of members in one piece of text, before the pieces are hashed.
PIECE = 2000
EMPTY = hashlib.sha256(b"").hexdigest()


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, name, bytes): each turn's digest and the UTF-8 bytes of its text, for rows with an id."""
    some = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role_, text_ = some(role), some(text)
    name = _name(F.encode(F.concat(F.octet_length(role_).cast("string"), F.lit(":")), "UTF-8"), F.encode(role_, "UTF-8"), F.encode(text_, "UTF-8"))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), name.alias("name"), F.octet_length(text_).cast("long").alias("bytes"), F.lit(1).alias("one")).where("conv IS NOT NULL")


def rebuilt(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, pos, name, bytes, after) and (conv, length).

    Conversation c has the first h turns of c - c % FAMILY and then its own after its first h, where
    h is crc32(c) % COPIED. A remainder has the sign of its number, as in SQL. pos counts from 1; after is the bytes of this turn and all later ones.
    """
    # Places and bytes before come from running totals over the order of all turns.
    line = stored(running(given, ["conv", "turn", "name"], {"seq": "one", "before": "bytes"}).drop("turn", "one"), "line")
    own = line.groupBy("conv").agg(F.min("seq").alias("first"), F.min("before").alias("start"), F.count("*").alias("n"), F.sum("bytes").alias("total"))
    own = stored(own, "own")
    total = line.count()
    placed = join_hot(line, own, "conv", "n", total).select("conv", (F.col("seq") - F.col("first") + 1).alias("pos"), "name", "bytes", (F.col("start") + F.col("total") - F.col("before")).alias("after"))
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    heads = own.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % COPIED).alias("h"))
    plans = heads.join(base, "base", "left").select("conv", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("copied"))
    plans = stored(plans, "plans")
    keeps = join_hot(stored(placed, "placed"), plans.select("conv", "h", "copied", F.col("n").alias("size")), "conv", "size", total)
    tails = keeps.where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("copied")).alias("pos"), "name", "bytes", "after")
    # The first turns of a conversation, fewer than COPIED, for each of its family.
    front = keeps.where(F.col("pos") < COPIED).select(F.col("conv").alias("base"), "pos", "name", "bytes")
    front = front.join(plans.select("conv", "base", "h"), "base").where("pos <= h")
    rest = tails.groupBy("conv").agg(F.max("after").alias("rest"))
    from pyspark.sql import Window as W

    later = F.sum("bytes").over(W.partitionBy("conv").orderBy(F.desc("pos")))
    copies = front.join(rest, "conv", "left").select("conv", "pos", "name", "bytes", (later + F.coalesce("rest", F.lit(0))).alias("after"))
    lengths = plans.select("conv", (F.col("copied") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return tails.unionByName(copies), lengths


def member_digests(members: DataFrame, keys: list[str], conv: str = "conv") -> DataFrame:
    """(keys, ends): the SHA-256 of each group's ids, ascending and comma-joined.

    Ids are ranged by group and id and joined into pieces where they are, so the task that hashes a
    group gets pieces in place of members, and holds one at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = [members.schema[k] for k in keys]
    piece_schema = StructType([*kinds, StructField("low", members.schema[conv].dataType), StructField("text", StringType())])
    out_schema = StructType([*kinds, StructField("ends", StringType()), StructField("pieces", LongType())])
    n = len(keys)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, key, ids = to_arrow_schema(piece_schema), [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key or len(ids) >= PIECE:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = row[:n], []
                ids.append(row[n])
                if len(rows) >= 1000:
                    yield batch_of(rows, schema)
                    rows = []
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))
        if rows:
            yield batch_of(rows, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, key, state, pieces = to_arrow_schema(out_schema), [], None, None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest(), pieces))
                    key, state, pieces = row[:n], hashlib.sha256(), 0
                state.update((("," if pieces else "") + row[n + 1]).encode())
                pieces += 1
                if len(rows) >= 1000:
                    yield batch_of(rows, schema)
                    rows = []
        if state is not None:
            rows.append((*key, state.hexdigest(), pieces))
        if rows:
            yield batch_of(rows, schema)

    ranged = members.select(*keys, conv).repartitionByRange(*keys, conv).sortWithinPartitions(*keys, conv)
    texts = ranged.mapInArrow(join, piece_schema).repartition(*keys).sortWithinPartitions(*keys, "low")
    return texts.mapInArrow(digest, out_schema).drop("pieces")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    conv_id is the node's smallest member, depth its number of turns, parent_conv_id its parent's
    conv_id; n_convs counts members, n_children children, n_leaves the childless nodes of the
    subtree; saved_tokens sums (members - 1) times the bytes of the last text over the subtree;
    ends_sha256 is the digest of the members that end here. Turns are ordered by turn, null first,
    and equal ones by a digest of role and text. A null role or text is empty; a row without conv_id
    belongs to no conversation and is left out; repeated rows are turns of their own; a table without
    conversations has no nodes, not even a root. Only the four columns are read.
    """
    given = turns(rows, conv, turn, role, text)
    every, lengths = rebuilt(given)
    every = stored(every.withColumn("deep", F.least("pos", F.lit(DEEP)).cast("int")), "turns", ["deep"])
    # Conversations by what they say: two hashes of places and turns, whose order does not matter.
    said = every.groupBy("conv").agg(*[F.bit_xor(F.xxhash64("pos", "name", F.lit(i))).alias(f"k{i}") for i in (0, 1)])
    keys = ["length", "k0", "k1"]
    convs = lengths.join(said, "conv", "left").select("conv", "length", *[F.coalesce(k, F.lit(0)).alias(k) for k in keys[1:]])
    convs = stored(convs, "conversations")
    groups = convs.groupBy(*keys).agg(F.min("conv").alias("rep"), F.count("*").alias("n")).join(member_digests(convs, keys), keys)
    groups = stored(groups.select("rep", "length", "n", "ends"), "sequences")
    all_ = groups.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("n_seq"), F.min(F.when(F.col("length") == 0, F.col("ends"))).alias("ends")).first()
    spark = rows.sparkSession
    if not all_["n_seq"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    active = groups.select("rep", "length", "n", "ends", F.unhex(F.lit(EMPTY)).alias("cls"))
    levels: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        here = every.where((F.col("deep") == min(depth, DEEP)) & (F.col("pos") == depth)).select(F.col("conv").alias("rep"), "name", "bytes", "after")
        split = active.where(F.col("length") >= depth).join(here, "rep")
        split = stored(split.select("rep", "length", "n", "ends", F.col("cls").alias("parent"), _name("cls", "name").alias("cls"), "bytes", "after"), f"split-{depth}")
        level = split.groupBy("cls").agg(
            F.min("parent").alias("parent"), F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("n_seq"), F.max("bytes").alias("bytes"),
            F.max("after").alias("after"), F.max("length").alias("longest"), F.min(F.when(F.col("length") == depth, F.col("ends"))).alias("ends"),
        )
        level = stored(level, f"level-{depth}")
        levels.append(level)
        if level.where("n_seq > 1").isEmpty():
            break
        alone = level.where("n_seq = 1").select(F.col("conv_id").alias("rep"))
        active = split.join(alone, "rep", "left_anti").select("rep", "length", "n", "ends", "cls")
    root = spark.createDataFrame([(all_["conv_id"], all_["n_convs"], all_["ends"])], f"conv_id {groups.schema['rep'].dataType.simpleString()}, n_convs long, ends string")
    root = root.select(F.unhex(F.lit(EMPTY)).alias("cls"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(2).cast("long").alias("n_seq"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("longest"), "ends")
    return _folded([root, *levels], every, groups)


def _folded(levels: list[DataFrame], every: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes with the counts of their subtrees, from the deepest classes to the root, and the chains of the retired."""
    done: list[DataFrame] = []
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        alone = F.col("n_seq") == 1
        saved = (F.col("n_convs") - 1) * F.col("bytes")
        if below is None:
            level = level.withColumns({"kids": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "gain": F.lit(0).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("cls")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("gain"))
            level = level.join(sums, "cls", "left").fillna(0, ["kids", "leaves", "gain"])
        level = level.select(
            "cls", "parent", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_seq", "ends", "longest", F.when(alone, (F.col("longest") > depth).cast("long")).otherwise(F.col("kids")).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.greatest("leaves", F.lit(1))).cast("long").alias("n_leaves"), F.when(alone, (F.col("n_convs") - 1) * F.col("after")).otherwise(saved + F.col("gain")).alias("saved_tokens"),
        )
        below = stored(level, f"folded-{depth}")
        done.append(below)
    nodes = stored(reduce(DataFrame.unionByName, done), "nodes")
    count = nodes.count()
    # Names of classes differ from depth to depth, as each holds its parent's.
    above = stored(nodes.where("n_seq > 1").select(F.col("cls").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size")), "parents")
    named = join_hot(nodes.where("parent IS NOT NULL"), above, "parent", "size", count)
    named = named.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")]
    alone = stored(
        nodes.where("n_seq = 1").join(groups.select("rep", F.col("ends").alias("last")), F.col("conv_id") == F.col("rep")).select(F.col("rep").alias("conv"), F.col("depth").alias("retired"), "n_convs", "longest", "last", F.col("longest").alias("size")),
        "retired",
    )
    turns_ = every.select("conv", "pos", "after")
    tail = join_hot(turns_, alone, "conv", "size", every.count()).where("pos > retired")
    chain = tail.select(
        F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.col("conv").alias("parent_conv_id"), "n_convs", (F.col("pos") < F.col("longest")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"), F.when(F.col("pos") == F.col("longest"), F.col("last")).otherwise(EMPTY).alias("ends_sha256"),
    )
    return named.select(*columns).unionByName(chain)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 by its bits: the reversed polynomial is shifted in for each of a byte's eight bits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
plan AS (SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS base, a.h, least(a.h, coalesce(b.n, 0)) AS copied
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
r AS (SELECT p.conv_id, t.pos - p.h + p.copied AS pos, role, text FROM t JOIN plan p USING (conv_id) WHERE t.pos > p.h
  UNION ALL SELECT p.conv_id, t.pos, role, text FROM t JOIN plan p ON t.conv_id = p.base WHERE t.pos <= p.h),
s AS (SELECT conv_id, pos AS depth, strlen(text) AS bytes,
    string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
    string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM r UNION ALL SELECT conv_id, 0, 0, '', NULL FROM own),
len AS (SELECT conv_id, max(depth) AS n FROM s GROUP BY conv_id),
node AS (SELECT depth, path, any_value(CASE WHEN depth > 0 THEN coalesce(above, '') END) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM s JOIN len USING (conv_id) GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)),
sub AS (SELECT s.depth, s.path, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM s JOIN full_ f ON f.conv_id = s.conv_id AND f.depth >= s.depth GROUP BY ALL)
SELECT f.conv_id::BIGINT AS conv_id, f.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (depth, path) LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.path = f.above
"""
