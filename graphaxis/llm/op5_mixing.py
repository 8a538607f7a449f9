"""Mixing sources to target weights, in DataFrame expressions only.

Each source's documents form a stream of words, in an order drawn by hashing, cut into blocks of
``BLOCK`` words. A source gets as many slots as its target holds blocks. How many slots of a source
each output shard has is drawn multinomially, one hashed ticket for each slot, so that the totals are
met; a source's slots are then numbered through the shards. Slot k of
a source is entry k mod n of pass k div n over its n blocks; every pass has a pseudorandom
permutation of its own (a generalised Feistel network on a grid just over n, walked until the index
falls below n). Blocks join slots by index. As targets stop at three times the size, no block
is taken more than three times.

Places in a stream are prefix sums over ``BUCKETS`` hashed buckets and then inside a bucket, so no
source is ever sorted in one task. Defined results: a null text has size 0; null is the last
source; identical rows are separate members of their stream, in the order of id, text hash and row;
an empty table gives an empty mix; a text of any length is cut into all its blocks; other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphaxis.llm.scratch import materialise

BLOCK = 64
BUCKETS = 1024
#: Slots of a shard; more where there would be over ``MOST_SHARDS`` shards.
SHARD_SLOTS = 4096
MOST_SHARDS = 1 << 16
CHUNK_SLOTS = 8192
MOST = 3
ROUNDS = 4
SEED = "mix-1"
#: With at most so many sources their table is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 20_000
_SPACES = "[ \t-\r]+"
_BLANKS = " \t\n\x0b\x0c\r"


def words_in(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, _SPACES))).cast("long")


def draw(*parts: Column | str) -> Column:
    """A 60-bit number from the parts, the same in any engine that has md5."""
    joined = F.concat_ws("/", F.lit(SEED), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, id: str, text: str, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A table of rows with ``id``, ``source``, ``size``, a text hash ``tie`` and a row number."""
    sized = docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    return materialise(sized.withColumn("row", F.monotonically_increasing_id()), "measured")


def targets(rows: DataFrame) -> DataFrame:
    """One row a source: ``sid`` by code point (null last), size, target, blocks and slots."""
    sums = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = sums.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MOST))
    # Filling by weight up to the caps: in order of cap by weight a prefix of sources is capped.
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid").asc())
    everything = W.partitionBy()
    filled = ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    filled = filled.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_from"))
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    filled = filled.withColumn("fill", F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("fill")))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    # Whole passes take the source's words as they are; the last block of a source may be short.
    passes = F.floor(target / F.greatest(F.col("source_size"), F.lit(1)) + 1e-9).cast("long")
    rest = F.floor((target - passes * F.col("source_size")) / BLOCK + 0.5).cast("long")
    slots = passes * blocks + F.least(F.greatest(rest, F.lit(0)), blocks)
    side = F.greatest(F.ceil(F.sqrt(blocks.cast("double"))).cast("long"), F.lit(1))
    return materialise(
        filled.select("source", "sid", "source_size", target.alias("target"), blocks.alias("blocks"), slots.alias("slots"), side.alias("side")).withColumn(
            "other", F.greatest(F.ceil(F.col("blocks") / F.col("side")).cast("long"), F.lit(1))
        ),
        "targets",
    )


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    small = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    return rows.join(small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _permuted(x: Column) -> Column:
    """One pass of the Feistel network on [0, side * other), keyed by source and pass."""
    left, right = F.floor(x / F.col("other")).cast("long"), x % F.col("other")
    for i in range(ROUNDS):
        left = (left + draw(f"l{i}", F.col("sid"), F.col("pass"), right)) % F.col("side")
        right = (right + draw(f"r{i}", F.col("sid"), F.col("pass"), left)) % F.col("other")
    return left * F.col("other") + right


def _feistel(df: DataFrame, start: str, end: str) -> DataFrame:
    """The same pass round by round, so that each half is computed once."""
    df = df.withColumn("__l", F.floor(F.col(start) / F.col("other")).cast("long")).withColumn("__r", F.col(start) % F.col("other"))
    for i in range(ROUNDS):
        df = df.withColumn("__l", F.explode(F.array((F.col("__l") + draw(f"l{i}", F.col("sid"), F.col("pass"), F.col("__r"))) % F.col("side"))))
        df = df.withColumn("__r", F.explode(F.array((F.col("__r") + draw(f"r{i}", F.col("sid"), F.col("pass"), F.col("__l"))) % F.col("other"))))
    return df.withColumn(end, F.col("__l") * F.col("other") + F.col("__r")).drop("__l", "__r")


def shard_counts(sources: DataFrame) -> DataFrame:
    """The draw: ``sid``, ``shard``, how many slots ``n`` of the source the shard has, and the first of them, ``lo``."""
    shards = F.least(F.greatest(F.ceil(F.sum("slots") / SHARD_SLOTS).cast("long"), F.lit(1)), F.lit(MOST_SHARDS))
    total = F.broadcast(sources.agg(shards.alias("shards")))  # one row
    runs = sources.where("slots > 0").select("sid", "slots").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK_SLOTS).cast("long"))))
    # A stated number of partitions: these few rows grow many-fold, and must not be coalesced.
    runs = runs.join(total).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "from")
    each = runs.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK_SLOTS, F.col("slots")) - 1)))
    drawn = each.groupBy("sid", (draw("shard", F.col("sid"), F.col("k")) % F.col("shards")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # At most MOST_SHARDS rows a source.
    return drawn.withColumn("lo", F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n"))


def slots(sources: DataFrame) -> DataFrame:
    """Every slot of the mix: ``sid``, number ``k``, ``pass``, ``shard`` and the ``block`` it takes."""
    drawn = materialise(shard_counts(sources), "shards")
    used = sources.where("slots > 0").select("sid", "blocks", "side", "other")
    runs = drawn.join(used.hint("merge"), "sid").withColumn("from", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1, F.lit(CHUNK_SLOTS).cast("long"))))
    runs = runs.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "from")
    each = runs.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK_SLOTS, F.col("lo") + F.col("n")) - 1)))
    each = each.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long")).withColumn("x", F.col("k") % F.col("blocks"))
    each = _feistel(each, "x", "y")
    # Out of range (a chance of about 1 / sqrt(blocks)): walk on; 64 steps leave one in 10**38.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("y"), lambda y, _: F.when(y < F.col("blocks"), y).otherwise(_permuted(y)))
    each = each.withColumn("block", F.when(F.col("y") < F.col("blocks"), F.col("y")).otherwise(walked))
    return each.select("sid", "k", "pass", "shard", "block")


def pieces(placed: DataFrame) -> DataFrame:
    """Where each row's words lie in blocks: ``row``, ``sid``, ``block``, first word and count."""
    last = F.col("start") + F.col("size") - 1
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("long"), F.floor(last / BLOCK).cast("long"))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(last, F.col("block") * BLOCK + BLOCK - 1)
    return cut.select("row", "sid", "block", (lo - F.col("start")).alias("first"), (hi - lo + 1).alias("words"))


def placed_rows(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's numbers and ``start``, their place in the source's stream."""
    bucket = F.coalesce(draw("bucket", F.coalesce(F.col("id").cast("string"), F.lit(""))) % BUCKETS, F.lit(0))
    known = _with_source(rows.select("row", "id", "source", "size", "tie"), sources.select("source", "sid", "source_size", "target")).withColumn("bucket", bucket)
    known = materialise(known, "known")
    heads = known.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    heads = heads.select("sid", "bucket", (F.sum("held").over(W.partitionBy("sid").orderBy("bucket")) - F.col("held")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("id", "tie", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return known.withColumn("inside", inside).join(heads, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("inside", "before", "bucket")


# Joins with slots are hinted: the optimiser doesn't see that their few source rows were exploded,
# and would broadcast them.


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row's id, ``size``, its source's size and target, the words the mix takes, and in how many shards."""
    rows = measured(docs, id, text, source)
    sources = targets(rows)
    placed = materialise(placed_rows(rows, sources), "placed")
    hits = pieces(placed).join(slots(sources).select("sid", "block", "shard").hint("merge"), ["sid", "block"])
    taken = hits.groupBy("row").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"))
    return placed.join(taken, "row", "left").select(
        F.col("id").alias(id), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias("mixed_source"),
        F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"),
    )


def mixed_shards(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix itself: ``shard`` and ``row``, a struct with the columns of ``docs``, for each document, shard and pass.

    A shard that takes all of a document in one pass has its text as it was; one that takes some of
    its blocks has those runs of words, a line each.
    """
    rows = measured(docs, id, text, source, tuple(docs.columns))
    sources = targets(rows)
    placed = materialise(placed_rows(rows, sources), "placed")
    hits = pieces(placed).join(slots(sources).select("sid", "block", "pass", "shard").hint("merge"), ["sid", "block"])
    # What different shards hold of one document in one pass stays together where they are neighbours' words:
    # a document's blocks of a pass go to the least of their shards, so that a text is not cut at every block.
    parts = hits.groupBy("row", "pass").agg(F.min("shard").alias("shard"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("words"))
    joined = rows.select("row", "size", *[F.col(f"c_{c}") for c in docs.columns]).join(parts, "row")
    whole = F.col("words") == F.col("size")
    body = F.col(f"c_{text}")
    held = joined.withColumn("tokens", F.explode(F.array(F.when(whole, F.array().cast("array<string>")).otherwise(F.split(F.btrim(body, F.lit(_BLANKS)), _SPACES)))))
    # A piece that goes on where the one before it ended continues its line.
    before = lambda i: F.get("parts", i - 1)
    touches = lambda p, i: before(i).getField("first") + before(i).getField("words") == p.first
    lead = lambda p, i: F.when(i == 0, "").when(touches(p, i), " ").otherwise("\n")
    cut = F.array_join(F.transform("parts", lambda p, i: F.concat(lead(p, i), F.array_join(F.slice("tokens", (p.first + 1).cast("int"), p.words.cast("int")), " "))), "")
    held = held.withColumn("mixed", F.when(whole, body).otherwise(cut))
    kinds = dict(docs.dtypes)
    out = {text: F.col("mixed"), length: F.length("mixed").cast(kinds.get(length, "long"))}
    return held.select("shard", F.struct(*[out.get(c, F.col(f"c_{c}")).alias(c) for c in docs.columns]).alias("row"))


def materialised_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix's rows with the columns of ``docs``."""
    return mixed_shards(docs, id, text, source, length).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
