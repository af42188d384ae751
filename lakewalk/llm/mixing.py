"""Mixing sources to target shares of all tokens, by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewalk.storage import written

#: The fractional part of the golden ratio (fixed value): slot s gets the point frac((s + 1) * GOLDEN).
GOLDEN = 0.6180339887498949
#: Tokens per block.
BLOCK_TOKENS = 8192
#: Tokens, or slots, per chunk of a running sum, so that no task ever holds a whole source.
CHUNK_TOKENS = 2_000_000
CHUNK_SLOTS = 200_000


def running(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` before each row, by ``chunk`` and then ``order`` within ``group``: sums of
    chunks first, then sums within each chunk, so that a group is never sorted as a whole."""
    chunks = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*group, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [*group, chunk]).withColumn(
        name, F.col("_offset") + F.col("_local")
    ).drop("_offset", "_local")


def allotment(totals: DataFrame, targets: DataFrame, block_tokens: int, total_tokens: int | None) -> list[dict]:
    """Per source, in order of name: its share of the schedule, its tokens, how often it may be read, and the blocks that
    it can fill. One row per target, so it is small: targets are a configuration table.

    Of repeated target rows one counts; of differing rows of a source the one with the least weight, then least
    max_repeat. Sources without tokens (or with a null or non-positive weight) get nothing and the other weights are
    scaled up. The size of the mix is ``total_tokens`` or, by default, the number of tokens of all its sources. A source
    that can't fill its share even if it is repeated max_repeat times gives all that it may; the others keep their
    proportions to each other.
    """
    first = targets.filter("source IS NOT NULL AND target_weight > 0").groupBy("source").agg(
        F.min(F.struct("target_weight", F.coalesce("max_repeat", F.lit(2**31 - 1)).alias("max_repeat"))).alias("t")
    )
    rows = [
        r.asDict() for r in first.join(totals, "source", "left").select(
            "source", "t.*", F.coalesce("tokens", F.lit(0)).alias("tokens")
        ).orderBy("source").collect()
    ]
    weight = sum(r["target_weight"] for r in rows if r["tokens"] > 0)
    size = sum(r["tokens"] for r in rows) if total_tokens is None else total_tokens
    for r in rows:
        r["target_share"] = r["target_weight"] / weight if r["tokens"] > 0 else 0.0
        r["wanted"] = max(0, min(r["tokens"] * r["max_repeat"], round(size * r["target_share"])))
        r["epochs"] = -(-r["wanted"] // r["tokens"]) if r["tokens"] else 0
        r["blocks"] = -(-r["wanted"] // block_tokens)
    return rows


def schedule(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """slot, source, block: which source each slot takes its next block from, for the sources of ``allotment``.

    The golden-ratio points of the slots are looked up in the cumulative shares of the blocks, so any run of slots has
    nearly the mix of the whole; the k-th slot of a source takes its k-th block. There are as many slots as blocks. The points
    give a source a few slots more or less than it has blocks (their discrepancy is logarithmic); the slots that one has too
    many, in order, take the blocks that others have left, in turns. Every slot has one block and every block one slot.
    """
    live = [r for r in rows if r["blocks"] > 0]
    slots = sum(r["blocks"] for r in live)
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    frac, upto, source, blocks = point - F.floor(point), 0, F.lit(""), F.lit(0)
    for i, r in enumerate(live):
        upto += r["blocks"]
        source = (source if i else F).when(frac < upto / slots, r["source"])
        blocks = (blocks if i else F).when(F.col("source") == r["source"], r["blocks"])
    if live:
        source = source.otherwise(live[-1]["source"])
    picked = spark.range(slots).select(F.col("id").alias("slot")).withColumn("source", source)
    picked = picked.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS)).withColumn("one", F.lit(1))
    ranked = running(picked, ["source"], "chunk", ["slot"], "one", "block").select("slot", "source", F.col("block").cast("bigint").alias("block"))
    # One row per source.
    taken = {r["source"]: r["n"] for r in picked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = sorted(
        (k - taken.get(r["source"], 0), r["source"], k) for r in live for k in range(taken.get(r["source"], 0), r["blocks"])
    )
    if not left:
        return ranked
    over = F.col("block") >= blocks
    numbers = Window.orderBy("slot")  # over the few slots that are too many
    free = ranked.filter(over).select("slot", (F.row_number().over(numbers) - 1).alias("no"))
    given = spark.createDataFrame([(i, s, k) for i, (_, s, k) in enumerate(left)], "no int, source string, block bigint")
    return ranked.filter(~over).unionByName(free.join(F.broadcast(given), "no").select("slot", "source", "block"))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    total_tokens: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix as rows, and the shares reached.

    ``docs`` has doc_id, source and tokens; ``targets`` source, target_weight and max_repeat. Mix: slot, source, block,
    epoch, doc_id, first_token, n_tokens, at: which tokens of which document fill the slot from place ``at`` on; sorted by slot
    and place it is the mixed corpus. A source's documents are shuffled anew in each epoch and laid end to end; blocks of
    ``block_tokens`` are cut from that stream, so a document may continue in the source's next block. No token occurs in more than max_repeat epochs. Shares: source, target_share, supply_tokens,
    max_repeat, epochs, tokens, actual_share.

    Documents with null source, null or no tokens don't occur. An empty table or no targets give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(
        "doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")
    ).filter("source IS NOT NULL AND tokens > 0")
    rows = allotment(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, block_tokens, total_tokens)
    slots = schedule(spark, rows)
    live = [r for r in rows if r["wanted"] > 0] or [{"source": "", "wanted": 0, "epochs": 0, "tokens": 1}]
    plan = F.broadcast(
        spark.createDataFrame(
            [(r["source"], r["wanted"], r["epochs"], -(-r["tokens"] // CHUNK_TOKENS)) for r in live],
            "source string, wanted bigint, epochs int, chunks bigint",
        )
    )
    copies = docs.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    h = F.xxhash64(F.lit(seed), "epoch", "doc_id", "tokens")
    shuffled = copies.withColumn("h", h).withColumn(
        "chunk",
        F.col("epoch") * F.col("chunks") + F.least(
            F.col("chunks") - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("chunks"))
        ),
    )
    stream = running(shuffled, ["source"], "chunk", ["h", "doc_id"], "tokens", "start").filter("start < wanted")
    end = F.least(F.col("start") + F.col("tokens"), F.col("wanted"))
    block = F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((end - 1) / block_tokens)))
    pieces = stream.withColumn("end", end).withColumn("block", block)
    low, high = F.greatest("start", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    pieces = pieces.select(
        "source",
        "block",
        "epoch",
        "doc_id",
        (low - F.col("start")).cast("bigint").alias("first_token"),
        (high - low).cast("bigint").alias("n_tokens"),
        (low - F.col("block") * block_tokens).cast("int").alias("at"),
    )
    mixed = written(
        pieces.join(slots, ["source", "block"]).select(
            "slot", "source", "block", "epoch", "doc_id", "first_token", "n_tokens", "at"
        ),
        "mix",
    )
    return mixed, _shares(mixed, rows)


def records(mixed: DataFrame, encoded: DataFrame) -> DataFrame:
    """The mixed corpus itself: slot, source and the token ids of the slot's block, in order, from doc_id and ids of the
    documents. A slot is never longer than a block."""
    cut = mixed.join(encoded.select("doc_id", "ids"), "doc_id").select(
        "slot", "source", "at", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("ids")
    )
    whole = cut.groupBy("slot", "source").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return whole.select("slot", "source", F.flatten("parts.ids").alias("ids"))


def consistency(mixed: DataFrame, shares: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row of truths: each block is in one slot and each slot holds one block, the slots are numbered without gaps, blocks
    are filled from 0 without gaps and only a source's last one isn't full, and the shares' tokens are those of the mix."""
    blocks = mixed.groupBy("slot", "source", "block").agg(
        F.sum("n_tokens").alias("n"), F.max(F.col("at") + F.col("n_tokens")).alias("end"), F.count_distinct("at").alias("starts"), F.count(F.lit(1)).alias("pieces")
    )
    last = mixed.groupBy("source").agg(F.max("block").alias("_last"))
    per = blocks.join(F.broadcast(last), "source").withColumn("last", F.col("block") == F.col("_last")).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_distinct("slot").alias("slots"),
        F.count_distinct("source", "block").alias("named"),
        F.coalesce(F.max("slot") + 1, F.lit(0)).alias("upto"),
        F.coalesce(F.bool_and((F.col("n") == F.col("end")) & (F.col("starts") == F.col("pieces"))), F.lit(True)).alias("filled"),
        F.coalesce(F.bool_and(F.col("last") | (F.col("n") == block_tokens)), F.lit(True)).alias("full"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
    )
    said = shares.agg(F.sum("tokens").alias("tokens"), F.sum("actual_share").alias("all")).first()
    tokens, whole = said["tokens"] or 0, abs((said["all"] or 0.0) - 1) < 1e-9
    return per.select(
        (F.col("blocks") == F.col("named")).alias("blocks_once"),
        (F.col("blocks") == F.col("slots")).alias("slots_unique"),
        (F.col("upto") == F.col("slots")).alias("slots_dense"),
        (F.col("filled") & F.col("full")).alias("blocks_full"),
        ((F.col("tokens") == F.lit(tokens)) & ((F.col("tokens") == 0) | F.lit(whole))).alias("tokens_agree"),
    )


def _shares(mixed: DataFrame, rows: list[dict]) -> DataFrame:
    spark = mixed.sparkSession
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    wanted = spark.createDataFrame(
        [
            (
                r["source"],
                r["target_share"],
                r["tokens"],
                None if r["max_repeat"] == 2**31 - 1 else r["max_repeat"],
                r["epochs"],
            ) for r in rows
        ],
        "source string, target_share double, supply_tokens bigint, max_repeat int, epochs int",
    )
    joined = wanted.join(reached, "source", "left").withColumn("total", F.lit(total).cast("bigint"))
    tokens = F.coalesce("tokens", F.lit(0))
    return joined.select(
        "source",
        "target_share",
        "supply_tokens",
        "max_repeat",
        "epochs",
        tokens.alias("tokens"),
        F.coalesce(tokens / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )
