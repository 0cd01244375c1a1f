"""The inverted index: postings of two fields in blocks, bounds of blocks, document frequencies, statistics; built, saved, loaded, measured and published as tables.

Postings are packed: one row for each term and block, a block being up to 2 ** BLOCK_BITS passages that follow each other, with
its postings as an array of whole numbers.  Columns beside it bound the greatest contribution of any of them to a score.  A search reads bounds
first, and postings only of blocks that can hold a result (search.py).

A block's passages lie together in one task, so words are counted there.  What a task has of a term is exchanged as one row of narrow
arrays, once, and blocks are made from it where it arrives: as rows of their own they would be several times as many bytes.

The table is bucketed by (field, term, part), so questions' terms meet it without an exchange of postings.  A term with more than HOT
postings is dealt to several parts by block, so no bucket holds all of a frequent term; which terms these are is estimated from every
(HOT / PRECISION)-th passage, which decides about the distribution and not about any result.

Under a path, an index is a snapshot, a folder that is never written again, and a log of snapshots whose last entry counts.  The log gets
its entry when all tables of a snapshot are there; a writer that stops before leaves the index as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..functions.text import folded, kept_tokens, stem, stem_of
from .checkpoints import cut, small_batches

FIELDS = {"body": "testo", "rubrica": "rubrica"}
#: Tables of a snapshot, in the order in which they are written; the manifest, with a digest of each, is last.
TABLES = ("meta", "postings", "terms", "texts", "stats", "manifest")
#: BM25's constants: bounds hold for these.
K1, B = 1.2, 0.75
#: A block is what positions share above so many bits: 32 paragraphs. Postings of a term in one part.
BLOCK_BITS, HOT = 5, 1_000_000
#: Passages, for each of which an index has a bucket at least: what a task sorts stays the same for larger tables.
BUCKET_PASSAGES = 40_000
#: Postings in the sample by which a term is found to have HOT.
PRECISION = 10_000
_KEY = ("field", "term", "part")
#: most: the greatest tf; ratio: the least len / tf; hits: each posting as one number, see hit().
_BLOCK = "block bigint, n int, most int, ratio double, recitals int, hits array<bigint>"
_PACKED = f"field string, term string, part int, {_BLOCK}"
#: What tasks exchange of a term: the bits of blocks above _NEAR, which a group shares; of each posting those below, the low bits of its hit, tf and len.
_GROUP = "high bigint, near array<int>, marks array<tinyint>, tfs array<int>, lens array<int>"
#: Bits of a block that a group has for each posting; blocks of a group at most.
_NEAR, GROUP = 31, 4096
#: A hit, from its low bits on: place in the block, recital, whether it is the first term of its field, tf, len.
_RECITAL, _FIRST, _TF, _LEN, _COUNT = BLOCK_BITS, BLOCK_BITS + 1, BLOCK_BITS + 2, BLOCK_BITS + 30, (1 << 28) - 1
#: Each byte of a folded text as words are told: itself or a space.
_WORDS = bytes(x if chr(x).isascii() and chr(x).isalnum() and not chr(x).isupper() else 32 for x in range(256))


@dataclass(frozen=True)
class Index:
    """packed(field, term, part, block, n, most, ratio, recitals, hits, entries), bounds(field, term, part, block, n, top, most, ratio, least, recitals), terms(field, term, df, parts),
    stats(n, avg_body, avg_rub; one row), meta(passages without text), texts(pos, testo), stemmed, saved (each table's digest, for a saved index), groups (see groups(); of an index that is not saved), passages (how many, where that is known without a manifest)."""

    packed: DataFrame
    bounds: DataFrame
    terms: DataFrame
    stats: DataFrame
    meta: DataFrame
    texts: DataFrame
    stemmed: bool
    saved: dict[str, str] = field(default_factory=dict)
    groups: DataFrame | None = None
    passages: int = 0

    @property
    def postings(self) -> DataFrame:
        """field, term, pos, tf, len, recital: one row for each term of each field of each passage."""
        rows = self.packed.select("field", "term", "block", F.explode("hits").alias("hit"))
        return rows.select("field", "term", *(c.alias(k) for k, c in hit(F.col("block"), F.col("hit")).items()))


def hit(block: Column, x: Column) -> dict[str, Column]:
    """pos, tf, len, recital of a hit of a block."""
    part = lambda at, mask: F.shiftright(x, at).bitwiseAND(F.lit(mask).cast("long"))
    pos = F.shiftleft(block, BLOCK_BITS).bitwiseOR(part(0, (1 << BLOCK_BITS) - 1))
    return {"pos": pos, "tf": part(_TF, _COUNT), "len": part(_LEN, _COUNT).cast("int"), "recital": part(_RECITAL, 1) == 1}


def occurrences(passages: DataFrame, stemmed: bool = True) -> DataFrame:
    """field, term, pos, tf, len, recital.

    Lengths and type ride along, so a search joins nothing but its terms.  Words become rows before they are stemmed, so that the
    stemmer runs in generated code.
    """
    fields = F.array(*(F.struct(F.lit(k).alias("field"), kept_tokens(F.coalesce(F.col(c), F.lit(""))).alias("words")) for k, c in FIELDS.items()))
    rows = passages.select("pos", (F.col("tipo") == "considerando").alias("recital"), F.explode(fields).alias("f")).select("pos", "recital", "f.field", F.size("f.words").alias("len"), F.explode("f.words").alias("word"))
    term = stem(F.col("word")) if stemmed else F.col("word")
    rows = rows.select("field", term.alias("term"), "pos", "len", "recital")
    return rows.groupBy("field", "term", "pos", "len", "recital").agg(F.count("*").alias("tf")).select("field", "term", "pos", "tf", "len", "recital")


def frequencies(rows: DataFrame) -> DataFrame:
    """field, term, df, parts of packed()."""
    return rows.groupBy("field", "term").agg(F.sum("n").cast("long").alias("df"), (F.max("part") + 1).alias("parts"))


def _plain(texts: pa.Array) -> pa.Array:
    """Folded texts with a space for each byte outside a-z, 0-9: the words of normalize(), whose regular expression costs more than all else that is done to a text."""
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, pa.py_buffer(data.to_pybytes().translate(_WORDS))], offset=texts.offset)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with pos, in which those of a block follow each other, in tables of whole blocks."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        blocks = rows["pos"].to_numpy() >> BLOCK_BITS
        ends = np.flatnonzero(blocks != blocks[-1])
        begin = int(ends[-1]) + 1 if len(ends) else 0
        if begin:
            yield rows.slice(0, begin)
        rest = rows.slice(begin)
    if rest is not None:
        yield rest


def _grouped(stemmed: bool, name: str, texts: pa.Array, pos: np.ndarray, recital: np.ndarray, known: dict[str, str]) -> pa.RecordBatch | None:
    """Groups of one field of whole blocks in order of pos, but for their part; known: terms of words, added to."""
    words = pc.ascii_split_whitespace(_plain(texts))
    row = np.repeat(np.arange(len(pos)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    found = []
    for word in coded.dictionary.to_pylist():
        term = known.get(word)
        if term is None:
            known[word] = term = "" if len(word) < 2 or word in STOP_WORDS else stem_of(word) if stemmed else word
        found.append(term)
    terms = sorted(set(found) - {""})
    if not terms:
        return None
    place = {t: k for k, t in enumerate(terms)}
    term = np.array([place.get(t, -1) for t in found])[coded.indices.to_numpy()]
    row, term = row[term >= 0], term[term >= 0]
    sizes = np.bincount(row, minlength=len(pos))
    key, tf = np.unique(term * len(pos) + row, return_counts=True)
    term, row = np.divmod(key, len(pos))
    if sizes.max() > _COUNT:
        raise ValueError(f"a passage of {sizes.max()} words is too long for the index")
    first = np.zeros(len(key), bool)
    first[np.unique(row, return_index=True)[1]] = True
    block = pos[row] >> BLOCK_BITS
    marks = pos[row] & ((1 << BLOCK_BITS) - 1) | recital[row].astype(np.int64) << _RECITAL | first.astype(np.int64) << _FIRST
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    own, high = term[at], block[at] >> _NEAR
    begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (high[1:] != high[:-1])])
    nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    begin = np.flatnonzero(nth % GROUP == 0)
    ends = pa.array(np.r_[at[begin], len(key)].astype(np.int32))
    lists = {"near": (block & ((1 << _NEAR) - 1)).astype(np.int32), "marks": marks.astype(np.int8), "tfs": tf.astype(np.int32), "lens": sizes[row].astype(np.int32)}
    columns = {
        "field": pa.array([name]).take(pa.array(np.zeros(len(begin), np.int64))),
        "term": pa.array(terms).take(pa.array(own[begin])),
        "high": pa.array(high[begin]),
    } | {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in lists.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _slices(rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    for begin in range(0, rows.num_rows if rows else 0, 20_000):
        yield rows.slice(begin, 20_000)


def sampled(passages: DataFrame, stemmed: bool = True) -> DataFrame:
    """field, term, df in every (HOT / PRECISION)-th passage."""
    every = max(1, HOT // PRECISION)
    return occurrences(passages.where(F.pmod(F.xxhash64("pos"), F.lit(every)) == 0), stemmed).groupBy("field", "term").agg(F.count("*").alias("df"))


def dealt(counted: DataFrame) -> DataFrame:
    """field, term, parts of the terms of sampled() that have several: of n postings, n / HOT at most."""
    every = max(1, HOT // PRECISION)
    return counted.select("field", "term", F.ceil(F.col("df") * every / HOT).cast("int").alias("parts")).where("parts > 1")


def groups(passages: DataFrame, stemmed: bool = True, clustered: bool = False, several: DataFrame | None = None) -> DataFrame:
    """field, term, part and what blocks_of() makes their blocks from: a task's postings of a term as one row of narrow arrays, which is what is exchanged.

    clustered: each block's passages follow each other in one task already, as documents' do; several: dealt(), where it is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for rows in _whole_blocks(batches):
            pos = rows["pos"].to_numpy()
            order = np.argsort(pos, kind="stable")
            rows = rows if (order[1:] > order[:-1]).all() else rows.take(order)
            for name in FIELDS:
                yield from _slices(_grouped(stemmed, name, rows[name].combine_chunks(), pos[order], rows["recital"].to_numpy(), known))
            if len(known) > 1_000_000:  # words of other texts
                known.clear()

    block = F.shiftright("pos", BLOCK_BITS)
    if not clustered:
        passages = passages.repartition(block).sortWithinPartitions("pos")
    small_batches(passages.sparkSession)
    texts = passages.select("pos", F.coalesce(F.col("tipo") == "considerando", F.lit(False)).alias("recital"), *(F.coalesce(folded(F.col(c)), F.lit("")).alias(k) for k, c in FIELDS.items()))
    rows = texts.mapInArrow(run, f"field string, term string, {_GROUP}")
    several = dealt(sampled(passages, stemmed)) if several is None else several
    # a term of several parts has a row for each of them, with its postings
    own = F.transform("near", lambda x: F.pmod(F.xxhash64(F.shiftleft("high", _NEAR).bitwiseOR(x.cast("long"))), F.col("parts")).cast("int"))
    rows = rows.join(F.broadcast(several), ["field", "term"], "left").withColumn("own", F.when(F.col("parts").isNotNull(), own))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    of_part = lambda c: F.when(F.col("own").isNull(), F.col(c)).otherwise(F.filter(c, lambda _, i: F.get("own", i) == F.col("part"))).alias(c)
    return rows.select(*_KEY, "high", *map(of_part, ("near", "marks", "tfs", "lens"))).where(F.size("near") > 0)


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows of _PACKED, one for each term and block, from groups()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            whole = lambda name: rows[name].flatten().to_numpy().astype(np.int64)  # noqa: E731, B023
            near, marks, tf, length = map(whole, ("near", "marks", "tfs", "lens"))
            group = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["near"]).to_numpy())
            at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (near[1:] != near[:-1])])
            ends = np.r_[at[1:], len(near)]
            group = group[at]
            columns = {name: rows[name].take(pa.array(group)) for name in _KEY} | {
                "block": rows["high"].to_numpy()[group] << _NEAR | near[at],
                "n": (ends - at).astype(np.int32),
                "most": np.maximum.reduceat(tf, at).astype(np.int32),
                "ratio": np.minimum.reduceat(length / tf, at),
                "recitals": np.add.reduceat(marks >> _RECITAL & 1, at).astype(np.int32),
                "hits": pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), marks | tf << _TF | length << _LEN),
            }
            yield from _slices(pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], names=list(columns)))

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, _PACKED)


def packed(passages: DataFrame, stemmed: bool = True, clustered: bool = False) -> DataFrame:
    """The postings of passages in blocks; clustered: see groups()."""
    return _shown(blocks_of(groups(passages, stemmed, clustered)))


def _stored(rows: DataFrame) -> DataFrame:
    """What is written, and digested, of packed()."""
    return rows.select(*(x.split()[0] for x in _PACKED.split(", ")))


def _shown(rows: DataFrame) -> DataFrame:
    """Rows of _PACKED with their hits as entries(pos, tf, len, recital) too."""
    entry = lambda x: F.struct(*(c.alias(k) for k, c in hit(F.col("block"), x).items()))
    return _stored(rows).withColumn("entries", F.transform("hits", entry))


def weight_of(tf: Column, length: Column, average: Column) -> Column:
    """What an occurrence contributes to a score, but for the weight of its term."""
    return tf / (tf + K1 * ((1 - B) + B * length / average))


def average_of(stats_field: Column) -> Column:
    """Mean length of the fields, from statistics; a field without any counts as of length 1."""
    average = F.when(stats_field == "body", F.col("avg_body")).otherwise(F.col("avg_rub"))
    return F.coalesce(F.nullif(average, F.lit(0.0)), F.lit(1.0))


def bound(most: Column, ratio: Column, floor: Column, average: Column) -> Column:
    """The most that a posting contributes, but for its term's weight, given the greatest tf and the least len / tf.

    tf / (tf + a + b len) = 1 / (1 + a / tf + b len / tf), of which each part is as small as it can be; a length below floor counts as floor.
    """
    return 1 / (1 + K1 * (1 - B) / most + K1 * B * F.greatest(ratio, floor / most) / average)


def bounds(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """For each row of packed(): the most that its postings contribute without a floor of lengths, their greatest tf, least len / tf and a length that none is below, and how many are of recitals."""
    own = rows.crossJoin(F.broadcast(stats.drop("n")))  # one row
    top = bound(F.col("most"), F.col("ratio"), F.lit(0), average_of(F.col("field")))
    return own.select(*_KEY, "block", "n", top.alias("top"), "most", "ratio", F.ceil("ratio").cast("int").alias("least"), "recitals")


def lengths(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """pos, len_body, len_rub of all passages of meta, from their postings: number of index terms of each field, 0 for none."""
    size = lambda field, name: F.coalesce(F.max(F.when(F.col("field") == field, F.col("len"))), F.lit(0)).alias(name)
    found = rows.groupBy("pos").agg(size("body", "len_body"), size("rubrica", "len_rub"))
    return meta.select("pos").join(found, "pos", "left").select("pos", F.coalesce("len_body", F.lit(0)).alias("len_body"), F.coalesce("len_rub", F.lit(0)).alias("len_rub"))


def statistics(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """n, avg_body over all passages, avg_rub over those with terms in the heading; each field of a passage has one hit that is its first, with the field's length."""
    x = hit(F.col("block"), F.col("hit"))
    firsts = rows.select("field", "block", F.explode("hits").alias("hit")).where(F.shiftright("hit", _FIRST).bitwiseAND(F.lit(1).cast("long")) == 1)
    total = lambda name: F.sum(F.when(F.col("field") == name, x["len"]))
    sums = firsts.agg(total("body").alias("body"), total("rubrica").alias("rub"), F.count_if(F.col("field") == "rubrica").alias("headed"))
    counted = meta.agg(F.count("*").alias("n")).crossJoin(sums)  # one row each
    share = lambda x, n: F.col(x).cast("double") / F.nullif(F.col(n), F.lit(0))
    return counted.select("n", F.coalesce(share("body", "n"), F.when(F.col("n") > 0, 0.0)).alias("avg_body"), share("rub", "headed").alias("avg_rub"))


def buckets_of(spark: SparkSession, passages: int) -> int:
    """As many as a shuffle has partitions, since with fewer Spark would rather exchange both sides of a join, or more for many passages."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), passages // BUCKET_PASSAGES)


def build(passages: DataFrame, stemmed: bool = True, clustered: bool = False) -> Index:
    """The index as a plan. What is searched more than once should be saved: save() computes the postings once and all else from them. clustered: see groups()."""
    made, meta = groups(passages, stemmed, clustered), passages.drop("testo")
    blocks = _shown(blocks_of(made))
    stats = statistics(blocks, meta)
    return Index(blocks, bounds(blocks, stats), frequencies(blocks), stats, meta, passages.select("pos", "testo"), stemmed, groups=made)


def _digested(df: DataFrame) -> list[str]:
    return sorted(set(df.columns) - {"entries"})  # which are the hits


def _part(columns: list[str], name: str = "") -> list[Column]:
    """rows, one, two of some rows of a table: what adds up to its digest."""
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0))
    return [F.count("*").alias(name + "rows"), total(1).alias(name + "one"), total(2).alias(name + "two")]


def _whole(columns: list[str], rows: Column, one: Column, two: Column) -> Column:
    """The digest of a table from the sums of its parts."""
    return F.concat_ws(":", F.lit(",".join(columns)), rows.cast("string"), one.cast("string"), two.cast("string"))


def digest(df: DataFrame) -> DataFrame:
    """rows, digest: one row that is the same for the same rows in any order, and, but for chance, for no others; it adds up over parts of a table."""
    columns = _digested(df)
    return df.agg(*_part(columns)).select("rows", _whole(columns, F.col("rows"), F.col("one"), F.col("two")).alias("digest"))


def digests(index: Index) -> dict[str, str]:
    """Each table's digest: the saved ones of a saved index, without reading its tables."""
    if index.saved:
        return index.saved
    tables = {"postings": index.packed, "terms": index.terms, "stats": index.stats, "meta": index.meta, "texts": index.texts}
    return {name: digest(df).first().digest for name, df in tables.items()}


def revised(passages: DataFrame, before: DataFrame, after: DataFrame, stemmed: bool = True) -> list[dict[str, str]]:
    """Digests of postings, terms, meta and texts of two indexes built anew: of passages, and of passages with those of before replaced by after, all clustered.

    before: all passages of some blocks, of which after has the same positions.  What the indexes have in common is made once: postings are
    made of all passages, and their sums of each term are corrected by the postings of before and after.  The second index is built by itself
    where it deals a term to other parts.
    """
    signed = lambda make: [(make(passages), 1), (make(before), -1), (make(after), 1)]
    counts = [cut(df) for df, _ in signed(lambda x: sampled(x, stemmed))]
    second = reduce(DataFrame.unionByName, (df.withColumn("df", F.col("df") * sign) for df, sign in zip(counts, (1, -1, 1), strict=True))).groupBy("field", "term").agg(F.sum("df").alias("df"))
    first, second = (cut(dealt(df)) for df in (counts[0], second))
    other = None
    if first.exceptAll(second).count() or second.exceptAll(first).count():
        rest = passages.join(F.broadcast(before.select("pos")), "pos", "left_anti").select(*after.columns)
        other = digests(build(rest.unionByName(after), stemmed, clustered=True))

    sums = ("rows", "one", "two")
    columns = _digested(_stored(blocks_of(groups(before, stemmed, True, first))))
    blocks = [(blocks_of(groups(df, stemmed, True, first)).groupBy(*_KEY).agg(F.sum("n").alias("n"), *_part(columns)), sign) for df, sign in ((passages, 1), (before, -1), (after, 1))]
    own = cut(blocks[0][0])
    added = [df.select(*_KEY, *((F.col(c) * sign).alias(c) for c in ("n", *sums))) for df, sign in [(own, 1), *blocks[1:]]]
    changed = cut(reduce(DataFrame.unionByName, added).groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in ("n", *sums))).where("rows <> 0"))
    out = []
    for rows in (own, changed):
        total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in sums))
        out.append({"postings": total.select(_whole(columns, *map(F.col, sums)).alias("digest")).first().digest, "terms": digest(frequencies(rows)).first().digest})

    tables = {"meta": sorted(set(passages.columns) - {"testo"}), "texts": ["pos", "testo"]}
    parts = [df.agg(*(c for name, of in tables.items() for c in _part(of, name))).select(F.lit(sign).alias("second"), F.lit(int(df is passages)).alias("first"), "*") for df, sign in signed(lambda x: x)]
    both = cut(reduce(DataFrame.unionByName, parts))  # a row each
    for which, own in zip(("first", "second"), out, strict=True):
        for name, of in tables.items():
            total = [F.sum(F.col(name + c) * F.col(which)).cast("decimal(38,0)") for c in sums]
            own[name] = both.agg(_whole(of, *total).alias("digest")).first().digest
    return out if other is None else [out[0], {name: other[name] for name in out[0]}]


def _name(path: str) -> str:
    return "lexgrove_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _table(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """A bucketed table under path, known to the session by a name of its own."""
    keys = ", ".join(_KEY)
    spark.sql(f"create table if not exists {_name(path)} ({schema}) using parquet clustered by ({keys}) sorted by ({keys}) into {buckets} buckets location '{path}'")
    return spark.table(_name(path))


def _write(df: DataFrame, path: str, buckets: int = 0) -> None:
    """A table of a snapshot."""
    if buckets:
        df.write.option("compression", "zstd").bucketBy(buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(_name(path))
    else:
        df.write.option("compression", "zstd").parquet(path)


def _snapshot(spark: SparkSession, path: str) -> str | None:
    """The folder of the index under path: what the last entry of its log names."""
    try:
        last = spark.read.schema("version long, snapshot string").parquet(f"{path}/log").orderBy(F.col("version").desc(), F.col("snapshot").desc()).first()
    except AnalysisException:
        return None
    return f"{path}/{last.snapshot}" if last else None


def _append(spark: SparkSession, path: str, snapshot: str) -> None:
    """The entry that makes a snapshot the index: one row, one file, which Spark's commit lets be seen whole or not at all."""
    try:
        last = spark.read.schema("version long, snapshot string").parquet(f"{path}/log").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        last = 0
    spark.range(1).coalesce(1).select(F.lit(last + 1).cast("long").alias("version"), F.lit(snapshot).alias("snapshot")).write.mode("append").parquet(f"{path}/log")


def save(index: Index, path: str) -> Index:
    """The index, written as a new snapshot under path and read from there. Two passages of one position, as two documents of one id give, are an error, found before the postings are made.

    Postings are written once; terms and statistics are made from what was written. No timestamps: rebuilding gives equal tables.
    """
    spark = index.packed.sparkSession
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    at = lambda name: f"{path}/{snapshot}/{name}"
    read = lambda name: spark.read.parquet(at(name))
    _write(index.meta, at("meta"))
    if twice := read("meta").groupBy("pos").count().where("count > 1").first():
        raise ValueError(f"position {twice.pos} occurs {twice['count']} times: ids of documents must differ")
    buckets = buckets_of(spark, read("meta").count())
    postings = _stored(index.packed).repartition(buckets, *_KEY) if index.groups is None else blocks_of(index.groups.repartition(buckets, *_KEY))
    _write(postings, at("postings"), buckets)
    rows = _table(spark, at("postings"), _PACKED, buckets)
    _write(frequencies(rows), at("terms"))
    _write(index.texts, at("texts"))
    _write(statistics(rows, read("meta")), at("stats"))
    tables = {"postings": rows} | {name: read(name) for name in ("terms", "stats", "meta", "texts")}
    parts = [digest(df).select(F.lit(name).alias("name"), "rows", "digest", F.lit(index.stemmed).alias("stemmed"), F.lit(buckets).alias("buckets")) for name, df in tables.items()]
    _write(reduce(DataFrame.unionByName, parts).coalesce(1), at("manifest"))
    _append(spark, path, snapshot)
    return load(spark, path)


def unstemmed(index: Index, passages: DataFrame, terms: DataFrame, few: bool, path: str, clustered: bool = False) -> Index:
    """An index without stems beside the stemmed one of the same passages, for questions that ask for terms(term; each once) alone: their postings of all passages, written under path.

    Passages, texts and, since a stem is never empty, lengths and their means do not depend on stems: these are the stemmed index's.  A word is
    dealt to as many parts as its stem, which has all its postings and more.  few: whether terms can be broadcast.
    """
    spark, n = index.packed.sparkSession, index.stats.first().n
    buckets = buckets_of(spark, n)
    hot = index.terms.where("parts > 1").select("field", F.col("term").alias("stem"), "parts")
    several = terms.select("term", stem(F.col("term")).alias("stem")).join(F.broadcast(hot), "stem").select("field", "term", "parts")
    made = groups(passages, False, clustered, several)
    made = made.join(F.broadcast(terms) if few else terms, "term", "left_semi").select(*made.columns)
    _write(blocks_of(made.repartition(buckets, *_KEY)), path, buckets)
    rows = _table(spark, path, _PACKED, buckets)
    return Index(_shown(rows), bounds(rows, index.stats), cut(frequencies(rows)), index.stats, index.meta, index.texts, False, passages=n)


def load(spark: SparkSession, path: str) -> Index:
    """An index as saved; whether it is stemmed is the index's own property, never an option of a search."""
    at = _snapshot(spark, path)
    if at is None:
        raise ValueError(f"no index under {path}")
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    manifest = {r.name: r for r in read("manifest").collect()}  # a row for each table
    one = manifest["postings"]
    rows = _table(spark, f"{at}/postings", _PACKED, one.buckets)
    return Index(_shown(rows), bounds(rows, read("stats")), read("terms"), read("stats"), read("meta"), read("texts"), one.stemmed, {k: r.digest for k, r in manifest.items()})


def missing(spark: SparkSession, path: str) -> list[str]:
    """Tables that a saved index under path lacks."""
    at, out = _snapshot(spark, path), []
    for name in TABLES:
        try:
            spark.read.parquet(f"{at or path}/{name}")
        except AnalysisException:
            out.append(name)
    return out


def load_if_there(spark: SparkSession, path: str) -> Index | None:
    """The index under path; None where there is none, or no whole one."""
    return None if _snapshot(spark, path) is None or missing(spark, path) else load(spark, path)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, files, bytes of the saved index's tables, by their names."""
    at = _snapshot(spark, path)
    one = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{at}/{name}").select(F.lit(name).alias("name"), "length")
    return reduce(DataFrame.unionByName, map(one, TABLES)).groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy("name")


def altered(spark: SparkSession, path: str) -> list[str]:
    """Tables of the saved index whose rows are not those of its manifest."""
    index = load(spark, path)
    now = digests(Index(index.packed, index.bounds, index.terms, index.stats, index.meta, index.texts, index.stemmed))
    return [name for name, value in now.items() if value != index.saved[name]]


def publish(spark: SparkSession, path: str, target: str) -> Index:
    """A copy of the saved index under target, if it is whole and consistent; else an error, and target stays as it is.

    Consistent: its tables are those of its manifest, index and texts have the same positions, no id or position occurs twice.
    """
    if lost := missing(spark, path):
        raise ValueError(f"the index under {path} lacks {', '.join(lost)}")
    index = load(spark, path)
    both = index.meta.select("pos", F.lit(1).alias("m")).join(index.texts.select("pos", F.lit(1).alias("t")), "pos", "full").agg(F.count_if(F.col("m").isNull() | F.col("t").isNull()).alias("odd")).first()
    twice = index.meta.groupBy("id").count().where("count > 1").union(index.meta.groupBy("pos").count().where("count > 1").withColumn("pos", F.col("pos").cast("string"))).limit(1).count()
    if both.odd or twice:
        raise ValueError(f"the index under {path}: {both.odd} positions lack passage or text; ids or positions that occur twice: {'some' if twice else 'none'}")
    if changed := altered(spark, path):
        raise ValueError(f"the index under {path} has been altered: {', '.join(changed)}")
    return save(index, target)
