"""Batched search: two-field BM25 with corrections, explicit references first, top results by question.

Postings are not all read.  The bounds of the blocks (index.py) that have a question's terms add up to the most that any passage of a block
can score.  The PROBE blocks of the highest sums over a question's leading terms, which are its rarest, are scored, and the score of the last
place there is a threshold: of the other blocks only those whose sum reaches it are read.  A question's least terms, which are the most
frequent, are spared if all of them together stay well below the threshold: their weights, the most that they can add anywhere, stand for their
bounds.  A tie at the threshold is read too, so results are those of all postings.

Sums over blocks are as many as questions times blocks, so they are made where they are used and never kept: a task has all of a block's
postings that any question asks for, as one exchange deals them, and gives on the best blocks, or those that reach the threshold.

Contributions are added as whole numbers of 2 ** -SCALE, so a score does not depend on the order or the partitions in which they meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.question import expand, reference
from ..functions.text import tokens
from .checkpoints import cut
from .expansion import expanded
from .index import BLOCK_BITS, K1, Index, average_of, bound, hit, weight_of

#: Bits of a contribution after the point; blocks that are scored for a threshold.
SCALE, PROBE = 40, 24
#: Share of a question's weight that its leading terms have; share of the threshold that the terms spared may reach together.
LEADING, SPARED = 0.85, 0.2
#: Terms of all questions together, and references, beyond this many are joined by shuffle instead of broadcast.
BROADCAST_TERMS = 500_000
#: Passages whose postings a task takes, about: sums of all questions over their blocks lie in its memory.
TASK_PASSAGES = 20_000


@dataclass(frozen=True)
class SearchConfig:
    """minimum_length: floor of body lengths; recital_weight, heading_weight; coverage: exponent of the share of found terms, 0 is off; synonyms: expand questions; limit: results a question."""

    minimum_length: int = 25
    recital_weight: float = 0.55
    coverage: float = 0.0
    synonyms: bool = True
    heading_weight: float = 2.2
    limit: int = 8


DEFAULTS = SearchConfig()


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame, stemmed: bool, synonyms: bool = True) -> DataFrame:
    """qid, ord, term: each distinct term of a question once, in order of first occurrence."""
    text = expand(F.col("d")) if synonyms else F.col("d")
    return questions.select("qid", F.posexplode(F.array_distinct(tokens(text, stemmed))).alias("ord", "term"))


def few_rows(df: DataFrame) -> bool:
    """Whether df is counted to be small enough to be broadcast."""
    return df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _option(terms: DataFrame, config: SearchConfig | None, name: str) -> Column:
    """An option as a column: the config's, or, where config is None, each term row's own."""
    return F.col(name) if config is None else F.lit(getattr(config, name))


def _weight(heading_weight: Column, idf: Column) -> Column:
    """What a term of a field is worth."""
    return F.when(F.col("field") == "body", 1.0).otherwise(heading_weight) * idf * (K1 + 1)


def weighted(terms: DataFrame, index: Index, config: SearchConfig | None, few: bool, keys: tuple[str, ...] = ("qid",), fields: tuple[str, ...] = ()) -> DataFrame:
    """keys, field, part, ord, term, df, average, idf, weight, floor, recital_weight, coverage: every question's terms with what they are worth; fields: only these.

    config None: terms carry the options of their own configuration as columns (see configured()).
    """
    body = F.col("field") == "body"
    rows = _small(terms, few).join(index.terms.where(F.col("field").isin(*fields)) if fields else index.terms, "term").crossJoin(F.broadcast(index.stats))  # one row
    rows = rows.withColumn("idf", idf(F.col("n"), F.col("df")))
    weight = _weight(_option(terms, config, "heading_weight"), F.col("idf"))
    floor = F.when(body, _option(terms, config, "minimum_length")).otherwise(0)
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    options = (_option(terms, config, c).cast("double").alias(c) for c in ("recital_weight", "coverage"))
    return rows.select(*keys, "field", parts.alias("part"), "ord", "term", "df", average_of(F.col("field")).alias("average"), "idf", weight.alias("weight"), floor.alias("floor"), *options)


def _ways(index: Index) -> int:
    """Into how many tasks blocks are dealt: as the session says, or more for a large index that is written."""
    ways = max(1, int(index.packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(ways, (index.stats.first().n if index.saved else index.passages) // TASK_PASSAGES)


def _met(table: DataFrame, asked: DataFrame, few: bool, ways: int = 1, blocks: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of a bucketed table of the index with the terms that ask for them. Many terms are exchanged, the table is not.

    A few terms are broadcast; what is found is dealt by block, with a number for its key, before the terms multiply it, so that
    sums are made where their parts are.  blocks: only these, broadcast; wanted(block, ...): only these, with their columns.
    """
    key = ["field", "term", "part"]
    if not few:
        return table.join(asked, key)
    # a number for each key, the same wherever it is computed; as many as are broadcast
    numbered = asked.agg(F.array_sort(F.collect_set(F.struct(*key))).alias("keys")).select(F.posexplode("keys").alias("k", "key")).select("k", "key.*")
    table = table.join(F.broadcast(numbered), key).drop(*key)
    if blocks is not None:
        table = table.join(F.broadcast(blocks), "block", "left_semi")
    table = table.repartition(ways, "block")
    if wanted is not None:
        table = table.join(wanted.repartition(ways, "block").hint("shuffle_hash"), "block")
    return table.join(F.broadcast(asked.join(F.broadcast(numbered), key).drop("term", "part")), "k")


def _counted(terms: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return terms.groupBy(*keys).agg(F.count("*").alias("asked"))


def _share(found: Column, coverage: Column) -> Column:
    """What is left of a score if so many of the terms asked are found."""
    return F.pow(found / F.greatest("asked", F.lit(1)), coverage)


def upper(asked: DataFrame, index: Index, few: bool, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, block, most, n, found: the most that a passage of a block can score for a question but for its coverage, how many postings its terms have there, and how many terms bodies have."""
    of_type = F.when(F.col("recitals") == F.col("n"), F.col("recital_weight")).when(F.col("recitals") > 0, F.greatest("recital_weight", F.lit(1.0))).otherwise(1.0)
    worth = F.col("weight") * bound(F.col("most"), F.col("ratio"), F.col("floor"), F.col("average")) * of_type
    rows = _met(index.packed.select("field", "term", "part", "block", "n", "most", "ratio", "recitals"), asked, few, _ways(index))
    return rows.groupBy(*keys, "block").agg(F.sum(F.greatest(worth, F.lit(0.0))).alias("most"), F.sum("n").alias("n"), F.count_if(F.col("field") == "body").alias("found"))


def _found(asked: DataFrame, index: Index, blocks: DataFrame | None, few: bool, keys: tuple[str, ...]) -> DataFrame:
    """Rows of asked with pos, tf, len, recital of each of their postings in blocks(keys, block), or in all."""
    table, ways = index.packed.select("field", "term", "part", "block", "hits"), _ways(index)
    if blocks is None:
        found = _met(table, asked, few, ways)
    elif few_rows(blocks):
        found = _met(table, asked, few, ways, blocks.select("block").distinct()).join(F.broadcast(blocks), [*keys, "block"], "left_semi")
    elif few:  # a block's questions meet its postings by the block alone, as both are dealt; two of one hash would only have more candidates
        asking = F.xxhash64(*keys)
        wanted = blocks.groupBy("block").agg(F.collect_list(asking).alias("wanted"))
        found = _met(table, asked, few, ways, wanted=wanted).where(F.array_contains("wanted", asking))
    else:
        found = _met(table, asked, few).join(blocks, [*keys, "block"], "left_semi")
    rows = found.select(*(c for c in asked.columns if c not in ("term", "part", "df")), "block", F.explode("hits").alias("hit"))
    return rows.select("*", *(c.alias(k) for k, c in hit(F.col("block"), F.col("hit")).items()))


def _total(worth: Column) -> Column:
    """The sum of contributions as whole numbers of 2 ** -SCALE; round() would make a decimal of each."""
    return F.sum(F.floor(worth * float(1 << SCALE) + 0.5)) / float(1 << SCALE)


def _first() -> Column:
    return F.min(F.when(F.col("field") == "body", 0).otherwise(1000) + F.col("ord")).alias("first")


def _of_type(score: Column, recital_weight: Column) -> Column:
    return F.when(F.col("recital"), score * recital_weight).otherwise(score)


def exact(asked: DataFrame, index: Index, blocks: DataFrame | None, terms: DataFrame, few: bool, keys: tuple[str, ...] = ("qid",), covered: bool = False, least: DataFrame | None = None) -> DataFrame:
    """keys, pos, score, first: one row for each candidate in blocks(keys, block), or in all; first decides ties (field, then term of the question).

    least(keys, least): a question's candidates below it are left out.
    """
    rows, body = _found(asked, index, blocks, few, keys), F.col("field") == "body"
    total = _total(F.col("weight") * weight_of(F.col("tf"), F.greatest("len", "floor"), F.col("average")))
    out = rows.groupBy(*keys, "block", "pos").agg(total.alias("score"), F.count_if(body).alias("found"), _first(), *(F.max(c).alias(c) for c in ("recital", "recital_weight", "coverage")))
    if covered:
        out = out.join(_small(_counted(terms, keys), few), list(keys)).withColumn("score", F.col("score") * _share(F.col("found"), F.col("coverage")))
    out = out.select(*keys, "pos", _of_type(F.col("score"), F.col("recital_weight")).alias("score"), "first")
    if least is not None:  # the same sums as where the threshold was found, so a tie stays
        out = out.join(_small(least, few), list(keys), "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
    return out


def exact_each(asked: DataFrame, index: Index, blocks: DataFrame | None, terms: DataFrame, few: bool, keys: tuple[str, ...], kinds: list[SearchConfig]) -> DataFrame:
    """keys, kind, pos, score, first: exact() under each of kinds, of which kind is the place; postings are met once and summed under all of them."""
    rows, body = _found(asked.select(*keys, "field", "part", "ord", "term", "average", "idf"), index, blocks, few, keys), F.col("field") == "body"

    def total(c: SearchConfig) -> Column:
        return _total(_weight(F.lit(c.heading_weight), F.col("idf")) * weight_of(F.col("tf"), F.greatest("len", F.when(body, c.minimum_length).otherwise(0)), F.col("average")))

    out = rows.groupBy(*keys, "block", "pos").agg(*(total(c).alias(f"s{k}") for k, c in enumerate(kinds)), F.count_if(body).alias("found"), _first(), F.max("recital").alias("recital"))
    covered = any(c.coverage for c in kinds)
    if covered:
        out = out.join(_small(_counted(terms, keys), few), list(keys))

    def score(k: int, c: SearchConfig) -> Column:
        whole = F.col(f"s{k}") * _share(F.col("found"), F.lit(float(c.coverage))) if covered else F.col(f"s{k}")
        return F.struct(F.lit(k).alias("kind"), _of_type(whole, F.lit(float(c.recital_weight))).alias("score"))

    return out.select(*keys, "pos", "first", F.inline(F.array(*(score(k, c) for k, c in enumerate(kinds)))))


def leading(asked: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The rows of asked of each question's heaviest terms: the least number of them that have LEADING of its weight, and postings for PROBE blocks."""
    once = lambda c: F.when(F.col("part") == 0, F.col(c)).otherwise(0)
    falling = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "field", "term")
    rows = asked.withColumns({"so_far": F.sum(once("weight")).over(falling) - F.col("weight"), "postings": F.sum(once("df")).over(falling) - F.col("df"), "total": F.sum(once("weight")).over(Window.partitionBy(*keys))})
    return rows.where((F.col("so_far") <= LEADING * F.col("total")) | (F.col("postings") < (PROBE << BLOCK_BITS))).drop("so_far", "postings", "total")


def spared(asked: DataFrame, least: DataFrame, few: bool, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """asked with least and rest, the most that a question's terms up to this one, from the lightest on, can score together, and spared: whether that stays below the threshold for certain."""
    own = F.when(F.col("part") == 0, F.col("weight")).otherwise(0) * F.greatest("recital_weight", F.lit(1.0))
    rising = Window.partitionBy(*keys).orderBy("weight", "field", "term")
    rows = asked.join(_small(least, few), list(keys), "left").withColumn("rest", F.sum(own).over(rising))
    # a threshold near 0 is left alone: contributions are rounded
    return rows.withColumn("spared", F.coalesce((F.col("least") > 1e-3) & (F.col("rest") <= SPARED * F.col("least")), F.lit(False)))


def promising(asked: DataFrame, index: Index, limit: int, terms: DataFrame, few: bool, keys: tuple[str, ...] = ("qid",), covered: bool = False) -> DataFrame:
    """keys, block: the blocks that can hold one of the first limit results."""
    return bounded_by(asked, index, limit, terms, few, keys, covered)[0]


def bounded_by(asked: DataFrame, index: Index, limit: int, terms: DataFrame, few: bool, keys: tuple[str, ...] = ("qid",), covered: bool = False) -> tuple[DataFrame, DataFrame]:
    """promising(), and the thresholds keys, least that none of the first limit results is below."""
    options = asked.groupBy(*keys).agg(F.max("coverage").alias("coverage"))
    options = cut(options.join(_counted(terms, keys), list(keys)) if covered else options.withColumn("asked", F.lit(1)))
    kept = lambda found: _share(F.least(found, "asked"), F.col("coverage")) if covered else F.lit(1.0)
    first = upper(leading(asked, keys), index, few, keys).join(_small(options, few), list(keys)).withColumn("most", F.col("most") * kept(F.col("found")))
    by = Window.partitionBy(*keys).orderBy(F.col("most").desc(), "block")
    probed = cut(first.withColumn("k", F.row_number().over(by)).where(F.col("k") <= PROBE).select(*keys, "block"))
    last = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    least = cut(exact(asked, index, probed, terms, few, keys, covered).withColumn("k", F.row_number().over(last)).where(F.col("k") == limit).select(*keys, F.col("score").alias("least")))
    rows = cut(spared(asked, least, few, keys))
    away = F.col("spared") & (F.col("part") == 0)
    rest = rows.groupBy(*keys).agg(F.max("least").alias("least"), F.coalesce(F.max(F.when(away, F.col("rest"))), F.lit(0.0)).alias("rest"), F.count_if(away & (F.col("field") == "body")).alias("more"))
    blocks = upper(rows.where("not spared").drop("least", "rest", "spared"), index, few, keys).join(_small(rest.join(options, list(keys)), few), list(keys))
    # sums of doubles: room for their rounding, and for that of whole contributions
    reach = (F.col("most") + F.col("rest")) * kept(F.col("found") + F.col("more")) * (1 + 1e-9) + 1e-6
    return blocks.where(F.col("least").isNull() | (reach >= F.col("least"))).select(*keys, "block"), least


def scores(terms: DataFrame, index: Index, config: SearchConfig | None, limit: int, keys: tuple[str, ...] = ("qid",), few: bool = False, fields: tuple[str, ...] = ()) -> DataFrame:
    """keys, pos, score, first: candidates, the first limit of each question among them."""
    asked = cut(weighted(terms, index, config, few, keys, fields))
    covered = config is None or config.coverage != 0
    bounded = config is None or (config.coverage >= 0 and config.heading_weight >= 0)  # else a part may outweigh the whole
    if not bounded:
        return exact(asked, index, None, terms, few, keys, covered)
    blocks, least = bounded_by(asked, index, limit, terms, few, keys, covered)
    return exact(asked, index, cut(blocks), terms, few, keys, covered, least)


def reading(questions: DataFrame, index: Index, config: SearchConfig = DEFAULTS) -> DataFrame:
    """qid, postings, blocks, postings_read, blocks_read: what a search of questions(qid, d) reads of what its terms have."""
    terms = question_terms(questions, index.stemmed, config.synonyms)
    few = few_rows(terms)
    asked = weighted(terms, index, config, few)
    blocks = upper(asked, index, few)
    all_ = blocks.groupBy("qid").agg(F.sum("n").alias("postings"), F.count("*").alias("blocks"))
    read = blocks.join(promising(asked, index, config.limit, terms, few, covered=config.coverage != 0), ["qid", "block"], "left_semi").groupBy("qid").agg(F.sum("n").alias("postings_read"), F.count("*").alias("blocks_read"))
    return all_.join(read, "qid", "left")


def _options(config: SearchConfig) -> tuple:
    return config.minimum_length, config.recital_weight, config.coverage, config.heading_weight


def kinds_of(configs: dict[str, SearchConfig]) -> list[SearchConfig]:
    """The configurations whose options, but for synonyms, no earlier one has."""
    return list({_options(c): c for c in reversed(configs.values())}.values())[::-1]


def configured(questions: DataFrame, stemmed: bool, configs: dict[str, SearchConfig]) -> tuple[DataFrame, DataFrame]:
    """of, v, kind, qid, ord, term and the options of each configuration: the terms of all questions under all configurations that differ; of, qid, config: what each stands for.

    of is the place in configs of the first configuration that asks a question's terms with the same options: one that differs in
    synonyms alone is another only for questions that have any.  kind is the place of its options in kinds_of(), v tells a question's terms
    with synonyms from those without where they differ.
    """
    names, options = list(configs), ("minimum_length", "recital_weight", "coverage", "heading_weight")
    distinct, kinds = kinds_of(configs), [_options(c) for c in configs.values()]
    synonyms = [c.synonyms for c in configs.values()]
    asked = questions.select("qid", *(F.array_distinct(tokens(expand(F.col("d")) if x else F.col("d"), stemmed)).alias(f"t{x:d}") for x in (False, True)))
    asked = asked.withColumn("alike", F.min(F.col("t0").eqNullSafe(F.col("t1"))).over(Window.partitionBy("qid")))  # a qid may occur with several texts

    def one(k: int) -> Column:
        apart = next(j for j in range(k + 1) if (kinds[j], synonyms[j]) == (kinds[k], synonyms[k]))
        return F.struct(F.lit(names[k]).alias("config"), F.lit(k).alias("own"), F.when(F.col("alike"), kinds.index(kinds[k])).otherwise(apart).alias("of"), F.when(F.col("alike"), 0).otherwise(int(synonyms[k])).alias("v"), F.lit([_options(c) for c in distinct].index(kinds[k])).alias("kind"), F.col(f"t{synonyms[k]:d}").alias("terms"), *(F.lit(v).alias(name) for name, v in zip(options, kinds[k], strict=True)))

    rows = asked.select("qid", F.inline(F.array(*map(one, range(len(names)))))) if names else asked.select("qid", F.lit("").alias("config"), F.lit(0).alias("own"), F.lit(0).alias("of"), F.lit(0).alias("v"), F.lit(0).alias("kind"), F.col("t0").alias("terms"), *(F.lit(0.0).alias(k) for k in options)).limit(0)
    return rows.where("own = of").select("of", "v", "kind", *options, "qid", F.posexplode("terms").alias("ord", "term")), rows.select("of", "qid", "config").distinct()


def exact_hits(questions: DataFrame, meta: DataFrame) -> DataFrame:
    """qid, pos of the passages that a question names; a reference without a paragraph takes all of the article."""
    asked = questions.select("qid", reference(F.col("d")).alias("ref")).where("ref is not null").select("qid", F.col("ref.tipo").alias("tipo"), F.col("ref.n").cast("long").alias("n"), F.col("ref.par").alias("wanted"))
    return meta.select("tipo", "n", "par", "pos").join(asked, ["tipo", "n"]).where("wanted is null or par = wanted").select("qid", "pos")


def named(questions: DataFrame, index: Index, few: bool) -> DataFrame:
    """exact_hits(), looked up once, so that a few need not move the candidates."""
    hits = cut(exact_hits(_small(questions, few), index.meta))
    return _small(hits, few_rows(hits))


def ranked(named: DataFrame | None, found: DataFrame, limit: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, rank, pos, punteggio, esatto: exact hits in corpus order, then by score; both count towards the limit.

    The rank is a window with a limit, which Spark applies before and after its shuffle.
    """
    rows = found.select(*keys, "pos", "score", "first", F.lit(False).alias("esatto"))
    if named is not None:
        rows = rows.join(named, [*keys, "pos"], "left_anti").unionByName(named.select(*keys, "pos", F.lit(float("inf")).alias("score"), F.lit(0).alias("first"), F.lit(True).alias("esatto")))
    by = Window.partitionBy(*keys).orderBy(F.col("esatto").desc(), F.when(F.col("esatto"), 0.0).otherwise(F.col("score")).desc(), "first", "pos")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select(*keys, "rank", "pos", F.when(F.col("esatto"), F.col("score")).otherwise(F.round("score", 6)).alias("punteggio"), "esatto")


def search(questions: DataFrame, index: Index, config: SearchConfig = DEFAULTS, rules: DataFrame | None = None) -> DataFrame:
    """Results of questions(qid, d): qid, rank, the passage's metadata, punteggio (infinite for exact hits), esatto, termini.

    rules: a table of synonym rules (see expansion.py) in place of the lexicon's. Text is not joined here; late_text adds it to the
    few rows that are left.
    """
    if rules is None or not config.synonyms:
        terms = cut(question_terms(questions, index.stemmed, config.synonyms))
    else:
        terms = cut(question_terms(expanded(questions, rules).withColumnRenamed("expanded", "d"), index.stemmed, False))
    few = few_rows(terms)
    found = scores(terms, index, config, config.limit, few=few)
    top = cut(ranked(named(questions, index, few), found, config.limit))
    words = terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("t")).select("qid", F.col("t.term").alias("termini"))
    return _small(top, few_rows(top)).join(index.meta, "pos").join(_small(words, few), "qid", "left").select("qid", "rank", "pos", "id", "tipo", "n", "par", "citazione", "rubrica", "capo", "termine", "punteggio", "esatto", F.coalesce("termini", F.array().cast("array<string>")).alias("termini"))


def search_each(questions: DataFrame, index: Index, configs: dict[str, SearchConfig], limit: int) -> DataFrame:
    """config, qid, rank, pos, punteggio, esatto of questions under all configurations in one job: the configuration is part of the key. What several configurations ask alike is searched once."""
    terms, shared = map(cut, configured(questions, index.stemmed, configs))
    few, keys, own, kinds = few_rows(terms), ("config", "qid"), ("of", "qid"), kinds_of(configs)
    places, each = cut(terms.select(*own, "v", "kind").distinct()), cut(terms.select("v", "qid", "ord", "term").distinct())
    blocks, least = None, places.select(*own, F.lit(None).cast("double").alias("least")).limit(0)
    if all(c.coverage >= 0 and c.heading_weight >= 0 for c in kinds):  # else a part may outweigh the whole
        asked = cut(weighted(terms, index, None, few, own))
        blocks, least = bounded_by(asked, index, limit, terms, few, own, any(c.coverage for c in kinds))
        blocks = cut(blocks.join(_small(places, few), list(own)).select("v", "qid", "block").distinct())
    # all that a question has under several configurations comes from one pass over its postings
    found = exact_each(cut(weighted(each, index, DEFAULTS, few, ("v", "qid"))), index, blocks, each, few, ("v", "qid"), kinds)
    limits = cut(places.join(least, list(own), "left"))
    found = cut(found.join(_small(limits, few), ["v", "qid", "kind"]).where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).select(*own, "pos", "score", "first"))
    found = found.join(_small(shared, few_rows(shared)), list(own)).drop("of")
    names = F.explode(F.array(*(F.lit(x) for x in configs)))
    asked = named(questions, index, few).select(names.alias("config"), "qid", "pos")
    return cut(ranked(asked, found, limit, keys))


def interactive(questions: DataFrame, index: Index, config: SearchConfig = DEFAULTS) -> DataFrame:
    """search() of those questions that have three characters or more."""
    return search(questions.where(F.length(F.trim("d")) >= 3), index, config)


def late_text(results: DataFrame, index: Index) -> DataFrame:
    """results with testo, joined after the cut to the top; of few results, which are then computed once, the texts alone move."""
    results, texts = cut(results), index.texts
    if few_rows(results):
        texts = texts.join(F.broadcast(results.select("pos").distinct()), "pos", "left_semi")
    return results.join(texts, "pos", "left").withColumn("testo", F.coalesce("testo", F.lit("")))
