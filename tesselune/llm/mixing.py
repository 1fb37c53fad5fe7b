"""Mixing sources to target weights, by DataFrame functions alone.

Targets are filled like water in tanks: shares follow the weights until a source's cap is reached, and what
is over goes to the others. Whole epochs of a source are taken, and of a last epoch the blocks that come first
in a hashed order, until the words are met. The number of blocks of each source is then split among output
shards by a tree: at every node the left half's capacity is drawn from the sources without replacement
(multivariate hypergeometric, as conditional draws by inversion from the mode). A shard takes its quota as a
range of ranks in the source's permuted deck, so shards are disjoint and together take every block; within a
shard rows are shuffled by ``order_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, stored, tune

WORD = r"[^\x20\x09-\x0D]+"
#: About so many rows of a source are ranked in one task.
RANK_ROWS = 65_536


def source_ranks(per: DataFrame) -> DataFrame:
    """Adds rank, from 1 on, to rows of one a source: by code point, null last."""
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))


def last_key(seed: int, doc: str = "doc_id", block: Column | str = "block") -> Column:
    """The hash by which a source's blocks are permuted for its last epoch."""
    return F.xxhash64(F.lit(seed), F.lit(1), "rank", doc, block)


def deck_key(seed: int, doc: str = "doc_id", block: Column | str = "block") -> Column:
    """The hash by which a source's deck, all blocks that it gives, is permuted."""
    return F.xxhash64(F.lit(seed), F.lit(2), "rank", "epoch", doc, block)


def order_key(seed: int, doc: str = "doc_id", block: Column | str = "block") -> Column:
    """The hash by which a shard is shuffled."""
    return F.xxhash64(F.lit(seed), F.lit(3), doc, "epoch", block)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(rank, source, source_size, rows, target) of each source; sizes has source and size.

    One row a source is all that the window sees. A source of no words gets a target of 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = source_ranks(per)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("rank", "source", "source_size", "rows", target.alias("target"))


def _ranked(blocks: DataFrame, key: Column) -> DataFrame:
    """Adds ``place`` (blocks before), ``words_before`` and the key u of each block in its source's order by the key.

    A source is cut into buckets of the hash, as many as its blocks ask for; ranks are local to a bucket and
    bucket totals are added up per source, so no task needs a whole source.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("blocks") / RANK_ROWS))
    blocks = blocks.withColumn("u", key).withColumn("bucket", F.floor((F.shiftrightunsigned("u", 32) * parts) / F.lit(1 << 32)))
    local = Window.partitionBy("rank", "bucket").orderBy(F.shiftrightunsigned("u", 32), "u", "doc_id", "epoch", "block")
    so_far = local.rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("rank", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w"))
    ranked = blocks.withColumn("place", F.row_number().over(local) - 1).withColumn("words_before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    ranked = ranked.join(totals, ["rank", "bucket"])
    return ranked.withColumn("place", F.col("place") + F.col("n")).withColumn("words_before", F.col("words_before") + F.col("w")).drop("n", "w", "bucket")


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL of a draw: how many of ``drawn`` from ``total``, of which ``marked``, are marked; u is uniform in [0, 1).

    Outcomes are weighed relative to the mode by the ratio of neighbours, over 12 standard deviations each
    way; what u asks for is found by going up from the mode and then down. The mass beyond is below 1e-30.
    """
    n, k, d = f"CAST({total} AS double)", f"CAST({marked} AS double)", f"CAST({drawn} AS double)"
    mode = f"least({marked}, {drawn}, greatest(0L, {drawn} + {marked} - {total}, CAST(floor(({d} + 1) * ({k} + 1) / ({n} + 2)) AS bigint)))"
    spread = f"CAST(ceil(12 * sqrt({d} * {k} / greatest({n}, 1D) * (1 - {k} / greatest({n}, 1D)))) + 12 AS bigint)"
    up, down = f"least({marked}, {drawn}, z.mode + {spread})", f"greatest(0L, {drawn} + {marked} - {total}, z.mode - {spread})"
    higher = f"(({k} - x + 1) * ({d} - x + 1) / (x * ({n} - {k} - {d} + x)))"  # weight of x over that of x - 1
    lower = f"((x + 1) * ({n} - {k} - {d} + x + 1) / (({k} - x) * ({d} - x)))"  # weight of x over that of x + 1

    def scan(first: str, last: str, step: int, ratio: str, left: str) -> str:
        """Sum of weights, and the first outcome at which ``left`` is used up."""
        walk = f"IF({first} {'<=' if step > 0 else '>='} {last}, sequence({first}, {last}, {step}L), CAST(array() AS array<bigint>))"
        return f"""aggregate({walk}, named_struct('p', 1D, 'sum', 0D, 'at', CAST(NULL AS bigint)), (s, x) -> named_struct(
            'p', s.p * {ratio}, 'sum', s.sum + s.p * {ratio}, 'at', coalesce(s.at, IF(s.sum + s.p * {ratio} > {left}, x, CAST(NULL AS bigint)))))"""

    rise, fall = scan("z.mode + 1", up, 1, higher, "1e300D"), scan("z.mode - 1", down, -1, lower, "1e300D")
    return f"""element_at(transform(transform(transform(array({mode}), m -> named_struct('mode', m)),
        z -> named_struct('mode', z.mode, 'up', {rise}.sum, 'down', {fall}.sum)),
        z -> CASE WHEN {u} * (1 + z.up + z.down) < 1 THEN z.mode
                  WHEN {u} * (1 + z.up + z.down) < 1 + z.up THEN coalesce({scan("z.mode + 1", up, 1, higher, f"{u} * (1 + z.up + z.down) - 1")}.at, {up})
                  ELSE coalesce({scan("z.mode - 1", down, -1, lower, f"{u} * (1 + z.up + z.down) - 1 - z.up")}.at, {down}) END), 1)"""


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, quota): quotas (rank, quota) split by the tree; a shard's sizes differ by the halving's rounding only."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    draw = _hypergeometric("a.total", "e.quota", "a.room", f"(pmod(xxhash64({seed}, lo, hi, e.rank), 4503599627370496L) / 4503599627370496D)")
    split = f"""aggregate(q,
        named_struct('total', aggregate(q, 0L, (t, e) -> t + e.quota),
                     'room', CAST(floor(aggregate(q, 0L, (t, e) -> t + e.quota) * ((lo + hi) div 2 - lo) / (hi - lo)) AS bigint),
                     'left', CAST(array() AS array<struct<rank:int,quota:bigint>>)),
        (a, e) -> element_at(transform(array({draw}), d -> named_struct('total', a.total - e.quota, 'room', a.room - d, 'left', concat(a.left, array(named_struct('rank', e.rank, 'quota', d))))), 1),
        a -> a.left)"""
    for _ in range(max(0, shards - 1).bit_length()):
        nodes = nodes.withColumn("l", F.when(F.col("hi") - F.col("lo") > 1, F.expr(split)))
        halves = """IF(l IS NULL, array(named_struct('lo', lo, 'hi', hi, 'q', q)), array(
            named_struct('lo', lo, 'hi', CAST((lo + hi) div 2 AS int), 'q', l),
            named_struct('lo', CAST((lo + hi) div 2 AS int), 'hi', hi, 'q', zip_with(q, l, (a, b) -> named_struct('rank', a.rank, 'quota', a.quota - b.quota)))))"""
        nodes = nodes.select(F.explode(F.expr(halves)).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("e")).select("shard", "e.rank", "e.quota")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 512,
    shards: int = 8,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and targets, and the blocks that the mix takes.

    First (doc_id, source, size, source_size, target), a row for each document: size counts words
    ``[^\\x20\\x09-\\x0D]+``, 0 for a null text. Sources rank by code point, null last and a source of its own;
    ``weights`` repeat along the ranks. Second (shard, order_key, doc_id, epoch, block, start, words), a row
    for each block taken: ``words`` words from word ``start`` on. A source's blocks have its target in words,
    rounded; the last block is cut to meet it. With ``block_words`` 0 a block is a whole document, none is
    cut, and a source ends within half a document of its target. No document gives more than ``cap`` rounded
    up times its size. Ids must be unique. All draws are hashes of ids and ``seed``: reruns agree. Documents
    without words and empty tables take nothing; other columns are ignored.
    """
    tune(docs.sparkSession)
    t = Scratch(docs.sparkSession)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = t.put(sizes)
    targets = t.put(source_targets(sizes, weights, share, cap))
    n = targets.count()
    named = sizes.join(small(targets.withColumnRenamed("source", "s"), n, 200), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    width = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    count = F.ceil(F.col("size") / width)
    want = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0)
    blocks = named.where("size > 0").select("doc_id", "rank", "size", "source_size", full.alias("full"), (want - full * F.col("source_size")).alias("rest"), width.alias("width"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    blocks = blocks.withColumn("start", F.col("block") * F.col("width")).withColumn("words", F.least("width", F.col("size") - F.col("start"))).drop("width", "size")
    counted = small(blocks.groupBy("rank").agg(F.count("*").alias("blocks")), n, 24)
    blocks = t.put(blocks.join(counted, "rank"))
    last = _ranked(blocks.where("rest > 0").withColumn("epoch", F.col("full")), last_key(seed))
    if block_words:
        last = last.where(F.col("words_before") < F.col("rest")).withColumn("words", F.least("words", F.col("rest") - F.col("words_before")))
    else:
        last = last.where(2 * F.col("words_before") + F.col("words") <= 2 * F.col("rest"))
    whole = blocks.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    keep = ["rank", "doc_id", "epoch", "block", "start", "words"]
    deck = t.put(whole.select(keep).unionByName(last.select(keep)))
    t.drop(blocks)
    quotas = deck.groupBy("rank").agg(F.count("*").alias("quota"))
    ends = Window.partitionBy("rank").orderBy("shard")
    bounds = shard_quotas(quotas, shards, seed).withColumn("end", F.sum("quota").over(ends)).groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    dealt = _ranked(deck.join(small(quotas.withColumnRenamed("quota", "blocks"), n, 24), "rank"), deck_key(seed))
    dealt = dealt.join(small(bounds, n, 24 + 8 * shards), "rank").withColumn("shard", F.expr("size(filter(ends, e -> e <= place))"))
    dealt = dealt.select("shard", order_key(seed).alias("order_key"), "doc_id", "epoch", "block", "start", "words", "rank", F.col("u").alias("deck_key"))
    dealt = t.put(dealt)
    t.drop(deck)
    return named.drop("rank", "rows"), dealt


def taken(sizes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), a row for each document.

    taken: the words that the mix takes of it, repeats counted. shards: the output shards that the tree's quotas
    deal its blocks to, ascending and joined by commas; empty where nothing is taken.
    """
    per = blocks.groupBy("doc_id").agg(F.sum("words").alias("taken"), F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards"))
    return sizes.join(per, "doc_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def unused(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def mixed_documents(
    docs: DataFrame, blocks: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, ordered: bool = True
) -> DataFrame:
    """The documents' rows as often as the mix of whole documents (``block_words=0``) takes them.

    A source gives a prefix of its permuted documents in its last epoch and all of them before, and a shard is a
    range of its permuted deck: so each source's cuts tell where a row goes, and texts are not joined with blocks.
    Cuts are a row a source. With ``ordered`` rows come by shard in shuffled order, by the only shuffle of texts;
    tasks take ranges of that order, as many as the session's shuffle partitions, so a shard may span several.
    Without, rows stay where they are, for consumers that order them by themselves. docs, its columns and ``seed``
    are those that ``mix`` had; columns of any name are carried.
    """
    high, key = F.shiftrightunsigned, unused("_mix", docs.columns)
    last = blocks.groupBy("rank").agg(F.max(F.struct("epoch", high(last_key(seed), 32).alias("h"), last_key(seed).alias("u"), "doc_id")).alias("cut"))
    first = blocks.groupBy("rank", "shard").agg(F.min(F.struct(high("deck_key", 32).alias("h"), F.col("deck_key").alias("u"), "doc_id", "epoch")).alias("at"))
    first = first.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("bounds"))
    sources = source_ranks(docs.select(F.col(source_col).alias("source")).distinct())
    cuts = stored(sources.join(last, "rank").join(first, "rank"))
    n = cuts.count()
    shards = cuts.agg(F.max(F.size("bounds"))).first()[0] or 1
    cuts = small(cuts.select(F.struct("source", "rank", "cut", "bounds").alias(key)), n, 80 + 48 * shards)
    rows = docs.where(F.col(text_col).rlike(WORD)).join(cuts, F.col(source_col).eqNullSafe(F.col(f"{key}.source")))
    rows = rows.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(f"{key}.rank").alias("rank"), F.col(f"{key}.cut").alias("cut"), F.col(f"{key}.bounds").alias("bounds"), F.lit(0).cast("long").alias("block"))
    own = F.struct(high(last_key(seed), 32).alias("h"), last_key(seed).alias("u"), "doc_id")
    copies = F.col("cut.epoch") + (own <= F.struct("cut.h", "cut.u", "cut.doc_id")).cast("long")
    rows = rows.select("row", "doc_id", "rank", "bounds", "block", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1))).alias("epoch"))
    if not ordered:
        return rows.select("row.*")
    rows = rows.withColumn("at", F.struct(high(deck_key(seed), 32).alias("h"), deck_key(seed).alias("u"), "doc_id", "epoch"))
    rows = rows.select("row", F.expr("element_at(filter(bounds, b -> b.at <= at), -1).shard").alias("shard"), order_key(seed).alias("order_key"))
    rows = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "order_key").sortWithinPartitions("shard", "order_key")
    return rows.select("row.*")


def write_shards(docs: DataFrame, blocks: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Parquet under ``path``/shard=n: each block's words joined by a space, in the shard's shuffled order.

    Tasks take ranges of (shard, place), as many as the session's shuffle partitions, so a large shard has several files, in
    order of their names.
    """
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.array_join(F.slice(words, F.col("start").cast("int") + 1, F.col("words").cast("int")), " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col).join(blocks.drop("rank", "deck_key"), "doc_id").select("shard", "order_key", "doc_id", "epoch", "block", text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "shard", "order_key").sortWithinPartitions("shard", "order_key").write.mode("overwrite").partitionBy("shard").parquet(path)
