"""Sharding along a Hilbert curve over metadata, with DataFrame functions only.

Size (by powers of two), source and language are quantised to BITS bits each, all in their own order (source and language by quantiles
over their counted values, compared whole); their Hilbert index puts rows that are close in all three next to each other; the sorted rows are cut into runs, so each shard
covers short ranges of every dimension and a reader prunes shards by any of them (see manifest()).

Positions are global without a global window: rows are range-partitioned by (index, hash of doc_id, doc_id), which splits a
cell of equal metadata however many rows it has, numbered inside their partition, and shifted by the counts of the
partitions before (a table with one row for each partition).

Laws: "rows" gives every shard the same count, at most one apart; "bytes" cuts where the running size passes equal parts.

Defined results: a null text has size 16 and checksum 0; null lang, source or doc_id count as values of their own; repeated
rows get slots of their own; an empty table has no rows; other columns are ignored unless asked to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 6
OVERHEAD = 16


def curve_table(dims: int) -> list[int]:
    """next state * 2**dims + digit, for each state and each corner (state = entry * dims + direction)."""
    corners = 1 << dims
    mask = corners - 1
    gray = [i ^ (i >> 1) for i in range(corners)]
    place = {g: i for i, g in enumerate(gray)}
    left = lambda x, k: ((x << k) | (x >> (dims - k))) & mask
    right = lambda x, k: ((x >> k) | (x << (dims - k))) & mask
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, corners)]
    turn = [0] + [ones(i - 1 if i % 2 == 0 else i) % dims for i in range(1, corners)]
    out = []
    for e in range(corners):
        for d in range(dims):
            for corner in range(corners):
                w = place[right(corner ^ e, (d + 1) % dims)]
                state = (e ^ left(entry[w], (d + 1) % dims)) * dims + (d + turn[w] + 1) % dims
                out.append(state * corners + w)
    return out


def hilbert_index(*dims: Column, bits: int = BITS) -> Column:
    """The Hilbert index of whole-number columns below 2**bits, first to last digit along the curve."""
    n = len(dims)
    table = F.array(*(F.lit(x) for x in curve_table(n)))
    point = F.struct(*(d.cast("int").alias(f"d{k}") for k, d in enumerate(dims)))

    def step(acc: Column, at: Column) -> Column:
        corner = F.lit(0)
        for k in range(n):
            corner = corner + F.pmod(F.floor(acc[f"d{k}"] / F.pow(F.lit(2.0), at)), F.lit(2)).cast("int") * (1 << k)
        code = F.element_at(table, acc["s"] * (1 << n) + corner + 1)
        return F.struct(F.floor(code / (1 << n)).cast("int").alias("s"), (acc["h"] * (1 << n) + F.pmod(code, F.lit(1 << n))).cast("long").alias("h"), *(acc[f"d{k}"].alias(f"d{k}") for k in range(n)))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"), *(point[f"d{k}"].alias(f"d{k}") for k in range(n)))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


#: Cells of a dimension.
CELLS = 1 << BITS


def _ranked(counts: DataFrame) -> DataFrame:
    """value, n of counts(value, n), with at (values before it), before (rows before it), values and rows (all), by running sums inside range partitions."""
    local = cut(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("m", F.monotonically_increasing_id()))
    local = local.withColumn("part", F.shiftright("m", 33))
    up_to, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = local.groupBy("part").agg(F.count("*").alias("v"), F.sum("n").alias("r"))  # a row for each partition
    parts = parts.select("part", zero(F.sum("v").over(up_to)).alias("v_before"), zero(F.sum("r").over(up_to)).alias("r_before"), F.sum("v").over(every).alias("values"), F.sum("r").over(every).alias("rows"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    out = local.join(F.broadcast(parts), "part")
    return out.select("value", "n", (F.col("m").bitwiseAND((1 << 33) - 1) + F.col("v_before")).alias("at"), (zero(inside) + F.col("r_before")).alias("before"), "values", "rows")


def bounds(rows: DataFrame, column: str) -> list[tuple[bytes, int]]:
    """The least value of each cell, with the cell's number, CELLS at most, in order of values.

    Values are counted first, so a value of any number of rows is one row here. As many values as cells or fewer have a cell each, spread evenly;
    of more, a value's cell is its quantile, that of the middle of its rows.
    """
    counts = rows.select(F.col(column).cast("binary").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    few = F.expr(f"cast(at * {CELLS - 1} div greatest(values - 1, 1) as int)")
    many = F.expr(f"cast((2 * before + n) * {CELLS} div (2 * rows) as int)")
    cells = _ranked(counts).withColumn("cell", F.when(F.col("values") <= CELLS, few).otherwise(many))
    return sorted((bytes(r.least), r.cell) for r in cells.groupBy("cell").agg(F.min("value").alias("least")).collect())


def quantised(rows: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    """For each string column a cell below CELLS, in the order of its strings, whole; null is in the first."""

    def cell(value: Column, found: list[tuple[bytes, int]]) -> Column:
        if len(found) < 2:
            return F.lit(found[0][1] if found else 0)
        mid = len(found) // 2
        return F.when(value < F.lit(found[mid][0]), cell(value, found[:mid])).otherwise(cell(value, found[mid:]))

    return [F.when(F.col(c).isNull(), 0).otherwise(cell(F.col(c).cast("binary"), bounds(rows, c))).cast("int") for c in columns]


def hilbert_shards(docs: DataFrame, shards: int, law: str = "rows", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, law, shard, slot (and keep) of docs(doc_id, text, lang, source)."""
    body = F.col("text").cast("string").cast("binary")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *(F.col(f"`{c}`") for c in keep))
    level = F.least(F.floor(F.log2(F.col("size").cast("double")) * 2.5), F.lit((1 << BITS) - 1)).cast("int")
    rows = rows.withColumn("curve", hilbert_index(*quantised(rows.select("source", "lang"), ("source", "lang")), level))
    rows = cut(rows)  # a range sort reads its input twice, for the bounds and for the rows
    order = ["curve", F.xxhash64("doc_id", F.lit(11)), "doc_id", "text_crc32"]
    ways = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = cut(rows.repartitionByRange(ways, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    local = local.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))  # a row for each partition
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("part", zero(F.sum("n").over(up_to)).alias("rows_before"), zero(F.sum("b").over(up_to)).alias("bytes_before"), F.sum("n").over(every).alias("all_rows"), F.sum("b").over(every).alias("all_bytes"))
    placed = local.join(F.broadcast(parts), "part").withColumn("at", F.col("at") + F.col("rows_before"))
    if law == "rows":
        first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
        placed = placed.withColumn("shard", F.expr(f"cast(at * {shards} div all_rows as int)")).withColumn("slot", F.col("at") - first)
    elif law == "bytes":
        inside = F.sum("size").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
        placed = placed.withColumn("before", F.col("bytes_before") + zero(inside)).withColumn("shard", F.expr(f"cast(before * {shards} div all_bytes as int)"))
        first = placed.groupBy("shard").agg(F.min("at").alias("first"))
        placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first"))
    else:
        raise ValueError(law)
    return placed.select("doc_id", "size", "text_crc32", "lang", "source", "curve", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), *(F.col(f"`{c}`") for c in keep))


def manifest(sharded: DataFrame) -> DataFrame:
    """For each shard: rows, bytes, and the ranges by which a reader prunes it."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *(f("size").alias(f"{n}_size") for n, f in (("min", F.min), ("max", F.max))), *(f(c).alias(f"{n}_{c}") for c in ("lang", "source") for n, f in (("min", F.min), ("max", F.max))))
