"""Blocks, bounds, snapshots, digests and containment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import evaluate, index, search
from lexgrove.sources import passages as P

WORDS = ["".join(random.Random(k).choices("bcdfglmnprst", k=random.Random(k).randint(3, 6))) + "u" for k in range(40)]


def corpus(spark, n=60, seed=1):
    """Documents of many like lines, so that scores tie, some of them long, some recitals."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS[: rng.choice([5, 40])]) for _ in range(rng.randint(3, 30)))
    rows = []
    for k in range(n):
        lines = [line() for _ in range(rng.choice([1, 3, 80]))]
        if k % 4 == 0:
            lines += lines[:5]
        rows.append((k, "\n".join(lines), f"src{rng.randint(0, 9)}"))
    return P.from_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    passages = corpus(spark)
    path = str(tmp_path_factory.mktemp("blocks"))
    return passages, index.save(index.build(passages), path), path


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    rows = [(q, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 6, 40])))) for q in range(40)] + [(90, ""), (91, None), (92, "nowhere")]
    return spark.createDataFrame(rows, "qid long, d string")


CONFIGS = [search.SearchConfig(), search.SearchConfig(minimum_length=0, recital_weight=1.0, limit=3), search.SearchConfig(recital_weight=1.7, coverage=0.5, limit=1), search.SearchConfig(coverage=-0.5), search.SearchConfig(heading_weight=0.0)]


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("few", [500_000, 0])
def test_pruned_search_is_whole(spark, monkeypatch, built, asked, config, few):
    """The first results are those of a search that reads every posting, ties and all, whether terms are broadcast or exchanged."""
    monkeypatch.setattr(search, "BROADCAST_TERMS", few)
    monkeypatch.setattr(search, "PROBE", 2)
    ix = built[1]
    terms = search.question_terms(asked, True)
    is_few = search.few_rows(terms)
    assert is_few == (few > 0)
    weighted = search.weighted(terms, ix, config, is_few)
    everything = search.exact(weighted, ix, None, terms, is_few, covered=config.coverage != 0)
    want = search.ranked(None, everything, config.limit).collect()
    got = search.ranked(None, search.scores(terms, ix, config, config.limit, few=is_few), config.limit).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 30


@pytest.mark.parametrize("config", [*CONFIGS, search.SearchConfig(recital_weight=0.0), search.SearchConfig(coverage=3.0, limit=2)])
@pytest.mark.parametrize(("leads", "spares"), [(0.1, 0.99), (0.85, 0.2)])
def test_spared_terms_lose_nothing(spark, monkeypatch, built, asked, config, leads, spares):
    """Blocks found by a question's heaviest terms alone, and sums without its lightest, give the results of all postings."""
    monkeypatch.setattr(search, "LEADING", leads)
    monkeypatch.setattr(search, "SPARED", spares)
    monkeypatch.setattr(search, "PROBE", 3)
    ix, terms = built[1], search.question_terms(asked, True)
    weighted = search.weighted(terms, ix, config, True)
    covered = config.coverage != 0
    want = search.ranked(None, search.exact(weighted, ix, None, terms, True, covered=covered), config.limit).collect()
    got = search.ranked(None, search.scores(terms, ix, config, config.limit, few=True), config.limit).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_frequent_terms_are_spared(spark, monkeypatch, built, asked):
    """Neither sum over blocks has all terms of the questions: their most frequent ones are in none."""
    summed, upper, ix = [], search.upper, built[1]
    monkeypatch.setattr(search, "upper", lambda rows, *a, **b: (summed.append(rows.count()), upper(rows, *a, **b))[1])
    monkeypatch.setattr(search, "PROBE", 2)
    terms = search.question_terms(asked, True)
    weighted = search.weighted(terms, ix, search.DEFAULTS, True)
    search.promising(weighted, ix, 1, terms, True).count()
    assert len(summed) == 2 and max(summed) < weighted.count()


def test_coverage_bounds_blocks(spark, built, asked):
    """Blocks that could reach the threshold but for their coverage are not read."""
    ix, terms, config = built[1], search.question_terms(asked, True), search.SearchConfig(coverage=4.0)
    weighted = search.weighted(terms, ix, config, True)
    best = search.exact(weighted, ix, None, terms, True, covered=True).groupBy("qid").agg(F.max("score").alias("least"))
    reach = search.upper(weighted, ix, True).join(best, "qid").where("most >= least").count()
    assert search.promising(weighted, ix, 1, terms, True, covered=True).count() < reach


def test_large_tables_have_more_buckets(spark, monkeypatch, tmp_path, built):
    """A task sorts the postings of so many passages, whatever the session's number of partitions."""
    monkeypatch.setattr(index, "BUCKET_PASSAGES", 100)
    ix = index.save(index.build(built[0]), str(tmp_path))
    n = ix.meta.count()
    assert n // 100 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{index._snapshot(spark, str(tmp_path))}/manifest").first().buckets == n // 100
    assert {k: ix.saved[k] for k in index.TABLES[:5]} == {k: built[1].saved[k] for k in index.TABLES[:5]}


def test_less_is_read(spark, built, asked):
    r = search.reading(asked, built[1], search.SearchConfig(limit=3)).agg(*(F.sum(c).alias(c) for c in ("postings", "postings_read", "blocks", "blocks_read"))).first()
    assert 0 < r.postings_read < r.postings and r.blocks_read < r.blocks


def test_blocks_hold_all_postings(spark, built):
    passages, ix, _ = built
    rows = index.occurrences(passages).select("field", "term", "pos", "tf", "len", "recital")
    assert sorted(map(tuple, ix.postings.collect())) == sorted(map(tuple, rows.collect()))
    worst = ix.bounds.join(ix.packed.select("field", "term", "block", F.explode("entries").alias("e")), ["field", "term", "block"]).crossJoin(ix.stats.drop("n"))
    worth = index.weight_of(F.col("e.tf"), F.col("e.len"), index.average_of(F.col("field")))
    assert worst.where((worth > F.col("top") + 1e-12) | (F.col("e.tf") > F.col("most")) | (F.col("e.len") < F.col("least"))).isEmpty()


def test_scores_do_not_depend_on_partitions(spark, built, asked):
    ix, out = built[1], []
    for n in (1, 3, 11):
        terms = search.question_terms(asked, True).repartition(n)
        moved = index.Index(ix.packed.repartition(n), ix.bounds.repartition(n), ix.terms, ix.stats, ix.meta, ix.texts, True)
        weighted = search.weighted(terms, moved, search.DEFAULTS, True)
        out.append({(r.qid, r.pos): r.score for r in search.exact(weighted, moved, None, terms, True).repartition(n).collect()})
    assert out[0] == out[1] == out[2]


def test_postings_are_not_exchanged(spark, monkeypatch, built, asked):
    """Many questions' terms go to the buckets; neither postings nor bounds move."""
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = search.question_terms(asked, True)
        weighted = search.weighted(terms, built[1], search.DEFAULTS, False)
        for table in (built[1].packed, built[1].bounds):
            plan = search._met(table, weighted, False)._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("SortMergeJoin") :]
            sides = [k for k, line in enumerate(join.split("\n")) if "Bucketed: true" in line]
            assert sides, plan
            above = []  # what stands between the join and the bucketed scan
            for line in join.split("\n")[: sides[0]][::-1]:
                above.append(line)
                if "+- " not in line and ":- " not in line:
                    break
            chain = join.split("\n")
            depth = chain[sides[0]].index("FileScan")
            for line in reversed(chain[: sides[0]]):
                at = len(line) - len(line.lstrip(" :+-"))
                if at < depth:
                    depth = at
                    assert "Exchange" not in line, plan
                    if "SortMergeJoin" in line:
                        break
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_terms_have_parts(spark, monkeypatch, asked):
    monkeypatch.setattr(index, "HOT", 20)
    passages = corpus(spark, 20, 3)
    ix = index.build(passages)
    assert ix.terms.agg(F.max("parts")).first()[0] > 1 and ix.packed.agg(F.max("part")).first()[0] > 0
    monkeypatch.setattr(index, "HOT", 1_000_000)
    plain = index.build(passages)
    results = [sorted(map(tuple, search.ranked(None, search.scores(search.question_terms(asked, True), x, search.DEFAULTS, 8, few=True), 8).collect())) for x in (ix, plain)]
    assert results[0] == results[1]


@pytest.mark.parametrize("at", range(len(index.TABLES) + 1))
def test_a_stop_while_writing_leaves_the_index(spark, monkeypatch, tmp_path, at):
    """A writer that stops before any table, or before the log's entry, leaves the old index; the next one replaces it."""
    path = str(tmp_path)
    old = index.save(index.build(corpus(spark, 4, 5)), path)
    kept = old.meta.count()
    new = index.build(corpus(spark, 9, 6))
    done = []
    write = index._write

    def stopping(df, to, buckets=0):
        if len(done) == at:
            raise RuntimeError("stopped")
        done.append(to)
        write(df, to, buckets)

    monkeypatch.setattr(index, "_write", stopping)
    if at == len(index.TABLES):
        monkeypatch.setattr(index, "_append", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        index.save(new, path)
    assert index.missing(spark, path) == [] and index.altered(spark, path) == []
    now = index.load(spark, path)
    assert now.saved == old.saved and now.meta.count() == kept
    monkeypatch.undo()
    assert index.save(new, path).meta.count() != kept and index.load(spark, path).saved != old.saved


def test_digests(spark):
    rows = [(k, f"x{k % 3}", [k, None]) for k in range(50)] + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "a int, b string, c array<int>")
    of = lambda d: index.digest(d).first().digest
    assert of(df) == of(df.repartition(7, "b").select("c", "a", "b")) != of(df.withColumn("a", F.when(F.col("a") == 3, 4).otherwise(F.col("a"))))
    assert of(df) != of(df.limit(51)) and of(df) != of(df.union(df.limit(1)))
    assert index.digest(df.limit(0)).first().rows == 0


def test_places_are_guarded(spark):
    make = lambda n: P.from_documents(spark.createDataFrame([(n, "a line that is long enough", "src9")], "doc_id long, text string, source string"))
    assert make((1 << 39) - 1).first().pos > 1 << 60
    assert make(None).count() == 0
    for n in (1 << 39, 1 << 62, -1):
        with pytest.raises(Exception, match="no place for document"):
            make(n).collect()


def test_repeated_documents_are_refused(spark, tmp_path):
    twice = spark.createDataFrame([(1, "a line that is long enough", "src9"), (1, "another line, long enough", "src9")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        index.save(index.build(P.from_documents(twice)), str(tmp_path))
    assert index.load_if_there(spark, str(tmp_path)) is None


def test_containment(spark):
    """Items of every number of words, cut words, and white space of every kind, against contains; no plan has a nested loop."""
    rng = random.Random(3)
    gap = [" ", "  ", "\n", "\t ", "  ", " "]
    make = lambda n: "".join(rng.choice(["ab", "abc", "b", "cabab", "é🙂", "aé"]) + rng.choice(gap) for _ in range(n))
    texts = [make(rng.randint(0, 25)) for _ in range(60)] + ["", " ", "\n", "ab", " ab", "ab ", None]
    items = ["", " ", "a", "b", "é", "ab ", " ab", " ab ", "b a", "b  a", "ab\nab", "🙂", "nowhere", "abc ab", None]
    for _ in range(60):
        t = rng.choice([x for x in texts if x])
        a = rng.randrange(len(t))
        items.append(t[a : a + rng.randint(1, 40)])
    left = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    right = spark.createDataFrame(list(enumerate(items)), "item long, text string")
    found = evaluate.containing(left, right, "key")
    got = [tuple(r) for r in found.select("item", "key").collect()]
    want = {(i, k) for i, x in enumerate(items) for k, t in enumerate(texts) if x is not None and t is not None and x in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert evaluate.containing(left, right.limit(0), "key").count() == 0


def test_words_are_packed_where_they_are(spark):
    """Whole blocks of clustered passages are packed without an exchange; passages in any order give the same index."""
    passages = corpus(spark, 30, 4)
    here = index.build(passages, clustered=True)
    plan = here.packed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[plan.index("MapInArrow") : plan.index("BroadcastExchange")], plan  # which has a sample's frequent terms
    mixed = index.build(passages.orderBy("testo").repartition(5))
    assert index.digest(here.packed).first() == index.digest(mixed.packed).first()
    assert here.stats.first() == mixed.stats.first() and here.stats.first().n == passages.count()


def test_block_of_several_batches_is_one(spark):
    """A block that begins in one Arrow batch and ends in the next one has one row for each term."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    passages = corpus(spark, 12, 6)
    want = index.digest(index.build(passages, clustered=True).packed).first()
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert index.digest(index.build(passages, clustered=True).packed).first() == want
    finally:
        spark.conf.set(name, before)


def test_sums_over_blocks_are_not_kept(spark, monkeypatch, built, asked):
    """What a search keeps is the probed and the promising blocks, not each block of each question."""
    kept, ix = [], built[1]
    cut = search.cut
    monkeypatch.setattr(search, "cut", lambda df: (kept.append(df.columns), cut(df))[1])
    monkeypatch.setattr(search, "PROBE", 2)
    search.search(asked, ix, search.SearchConfig(limit=3)).count()
    assert kept and not any("most" in columns for columns in kept)


@pytest.mark.parametrize("config", CONFIGS[:3])
def test_many_promising_blocks(spark, monkeypatch, built, asked, config):
    """Few terms and blocks too many to broadcast: both are dealt by block, and results stay those of all postings."""
    ix, terms = built[1], search.question_terms(asked, True)
    weighted = search.weighted(terms, ix, config, True)
    covered = config.coverage != 0
    want = search.ranked(None, search.exact(weighted, ix, None, terms, True, covered=covered), config.limit).collect()
    monkeypatch.setattr(search, "few_rows", lambda df: False)
    found = search.scores(terms, ix, config, config.limit, few=True)
    assert "array_contains" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, search.ranked(None, found, config.limit).collect())) == sorted(map(tuple, want))


def test_windows_of_texts_stay(spark):
    """Few items go to the texts: neither the texts nor their windows are exchanged for them."""
    texts = spark.createDataFrame([(k, f"one two three four five six seven {k} eight") for k in range(50)], "key long, text string")
    items = spark.createDataFrame([(1, "two three four five six seven 7 eight"), (2, "seven 9")], "item long, text string")
    found = evaluate.containing(texts, items, "key")
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 9)]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_exchanged_as_groups(spark, monkeypatch, tmp_path):
    """What a saved index exchanges is a row for each term of a task, not one for each of its blocks, which are made after the exchange."""
    written, write = {}, index._write
    monkeypatch.setattr(index, "_write", lambda df, path, buckets=0: (written.setdefault(path.rsplit("/", 1)[1], df), write(df, path, buckets))[1])
    made = index.build(corpus(spark, 60, 5).coalesce(2), clustered=True)
    ix = index.save(made, str(tmp_path))
    plan = written["postings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange hashpartitioning") < plan.rindex("MapInArrow"), plan
    assert made.groups.count() * 3 < ix.packed.count()
    assert ix.saved["postings"] == index.digest(index._stored(made.packed)).first().digest


def test_groups_of_far_documents_and_hot_terms(spark, monkeypatch):
    """Postings are whole where a task's documents lie far apart and a term has several parts, which no block is in two of."""
    monkeypatch.setattr(index, "HOT", 5)
    rows = [(k * (1 << 34) + j, "head word\n" + "\n".join(f"alpha beta{i % 3} alpha gamma{j}" for i in range(70)), f"src{j}") for k in (0, 1, 20) for j in (1, 8)]
    passages = P.from_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    ix = index.build(passages, clustered=True)
    want = index.occurrences(passages).select("field", "term", "pos", "tf", "len", "recital")
    assert sorted(map(tuple, ix.postings.collect())) == sorted(map(tuple, want.collect()))
    assert ix.terms.where("parts > 1").count() and not ix.packed.groupBy("field", "term", "block").count().where("count > 1").count()


def test_words_are_told_without_a_regular_expression(spark):
    """Postings are those of tokens() whatever stands in or between words, and no regular expression is replaced in the texts that are counted."""
    odd = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x371), *range(0x1E00, 0x2150), 0xFB01, 0xFF21, 0x1F600) if chr(c) != "\n"]
    rows = [(k, f"zentrale{ch}nnabile Quer{ch} {ch} {ch}volta 1{ch}2", f"src{k % 9}") for k, ch in enumerate(odd)] + [(len(odd), "", "src1"), (len(odd) + 1, "—" * 20, "src7")]
    passages = P.from_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    made = index.build(passages)
    assert sorted(map(tuple, made.postings.collect())) == sorted(map(tuple, index.occurrences(passages).select("field", "term", "pos", "tf", "len", "recital").collect()))
    plan = made.groups._jdf.queryExecution().optimizedPlan().toString()
    counted = plan[plan.index("MapInArrow") : plan.index("Aggregate")]
    assert "translate" in counted and "regexp_replace" not in counted, counted


@pytest.mark.parametrize("hot", [index.HOT, 40])
def test_revised_digests(spark, monkeypatch, hot):
    """Digests of an index and of the one with a changed passage, made together, are those of two indexes built by themselves; the common postings are made once."""
    monkeypatch.setattr(index, "HOT", hot)
    monkeypatch.setattr(index, "PRECISION", 40)
    passages = corpus(spark).repartition(5, "n")
    least = passages.agg(F.min("pos")).first()[0]
    n = passages.where(F.col("pos") == least).first().n
    changed = lambda df: df.withColumn("rubrica", F.when(F.col("pos") == least, "nuovo lexgrovius").otherwise(F.col("rubrica")))
    before = passages.where(F.col("n") == n).coalesce(1)
    made, groups = [], index.groups
    want = [index.digests(index.build(x, clustered=True)) for x in (passages, changed(passages))]
    monkeypatch.setattr(index, "groups", lambda x, *a, **k: (made.append(x), groups(x, *a, **k))[1])
    got = index.revised(passages, before, changed(before))
    assert got == [{k: v for k, v in x.items() if k != "stats"} for x in want] and got[0]["postings"] != got[1]["postings"] and got[0]["texts"] == got[1]["texts"]
    assert sum(x is passages for x in made) == 1


@pytest.mark.parametrize("more", [{}, {"lower": search.SearchConfig(coverage=-0.5, limit=3)}])
def test_configurations_share_a_pass(spark, monkeypatch, built, asked, more):
    """Each configuration's results are those of a search of its own; what several ask alike is searched once, and postings are met once for all of them."""
    ix, base = built[1], search.SearchConfig(limit=3)
    configs = {"base": base, "bare": search.SearchConfig(0, 1.0, heading_weight=0.0, limit=3), "covered": search.SearchConfig(coverage=0.5, limit=3), "same": base, "plain": search.SearchConfig(synonyms=False, limit=3)} | more
    questions = asked.union(spark.createDataFrame([(95, f"garante {WORDS[0]} {WORDS[1]}"), (96, "art. 3")], "qid long, d string"))
    terms, shared = search.configured(questions, True, configs)
    assert {(r.qid, r.config): r.of for r in shared.where("qid in (3, 95)").collect()} == {(q, c): of for q in (3, 95) for c, of in zip(configs, (0, 1, 2, 0, 4 if q == 95 else 0, *range(5, 5 + len(more))), strict=True)}
    assert terms.where("of = 4").select("qid").distinct().count() == 1
    met, found = [], search._found
    monkeypatch.setattr(search, "_found", lambda *a: (met.append(a), found(*a))[1])
    monkeypatch.setattr(search, "PROBE", 2)
    got = {}
    for r in search.search_each(questions, ix, configs, 3).collect():
        got.setdefault(r.config, []).append((r.qid, r.rank, r.pos, r.punteggio, r.esatto))
    assert len(met) == (1 if more else 2)  # with bounds, that of the thresholds too
    for name, config in configs.items():
        want = search.search(questions, ix, config).select("qid", "rank", "pos", "punteggio", "esatto").collect()
        assert sorted(got[name]) == sorted(map(tuple, want)) and len(want) > 30


@pytest.mark.parametrize("hot", [index.HOT, 40])
def test_unstemmed(spark, monkeypatch, tmp_path, built, asked, hot):
    """Beside a stemmed index, searches without stems need their words' postings alone: rows are those of an index without stems built by itself, and no other word is written."""
    monkeypatch.setattr(index, "HOT", hot)
    monkeypatch.setattr(index, "PRECISION", 40)
    passages = corpus(spark)
    stemmed = index.save(index.build(passages), str(tmp_path / "stemmed")) if hot == 40 else built[1]
    some = asked.where("qid % 3 <> 1")
    words = search.question_terms(some, False).select("term").distinct()
    plain = index.unstemmed(stemmed, passages, words, True, str(tmp_path / "words"))
    whole = index.build(passages, stemmed=False)
    assert plain.stats.first() == whole.stats.first() and not plain.stemmed
    assert {r.term for r in plain.packed.select("term").collect()} == {r.term for r in words.collect()} & {r.term for r in whole.terms.collect()} and (hot > 40 or plain.terms.where("parts > 1").count())
    order = lambda df: sorted(map(tuple, df.drop("testo").collect()))
    assert order(plain.postings) == order(whole.postings.join(words, "term", "left_semi").select(*plain.postings.columns))
    assert order(search.search(some, plain).select("qid", "rank", "pos", "punteggio")) == order(search.search(some, whole).select("qid", "rank", "pos", "punteggio"))
