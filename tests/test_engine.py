"""Extraction, index and search on a small corpus made by hand."""

import json
import math
import re
import unicodedata
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.functions.lexicon import STOP_WORDS, SUFFIXES
from lexgrove.operators import evaluate, index, search, store
from lexgrove.plans import queries
from lexgrove.sources import passages as P
from lexgrove.sources.fetch import fetch
from lexgrove.streaming.questions import answer

HTML = """
<html><body><div id="rct_1"><p>(1) Il considerando spiega il trattamento<sup>9</sup>.</p></div>
<p class="oj-ti-section-1">CAPO I</p><p class="oj-ti-section-2">Principi</p>
<div id="art_1"><p class="oj-ti-art">Articolo 1</p><div class="eli-title"><p class="oj-sti-art">Oggetto</p></div>
<div>1. Il titolare protegge i dati personali.</div><div>a) anche cartacei</div><div>2. L'interessato ha diritto di accesso.</div></div>
<p class="oj-ti-section-1">SEZIONE 1</p>
<div id="art_2"><p class="oj-sti-art">Definizioni</p><div>Articolo 2 Definizioni 1) «dato»: ogni informazione; 2) «titolare»: chi decide; 3) «consenso»: volontà libera;</div></div>
<p class="oj-ti-section-1">CAPO II</p>
<div id="art_3"><p class="oj-sti-art">Breve</p><div>1. corto</div></div></body></html>"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "passages")
    P.from_legal_pages(spark.createDataFrame([(1, HTML)], "page_id long, html string")).drop("page_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def saved(spark, corpus, tmp_path_factory):
    """(index, where it is saved)"""
    path = str(tmp_path_factory.mktemp("index") / "ix")
    return index.save(index.build(corpus), path), path


def test_extraction(corpus):
    rows = {r.id: r for r in corpus.collect()}
    assert sorted(rows) == ["a1p1", "a1p2", "a2d1", "a2d2", "a2d3", "c1"]
    assert rows["c1"].testo == "Il considerando spiega il trattamento ." or rows["c1"].testo == "Il considerando spiega il trattamento."
    assert rows["a1p1"].testo == "Il titolare protegge i dati personali. a) anche cartacei"
    assert rows["a1p1"].capo == "CAPO I — Principi" and rows["a1p1"].rubrica == "Oggetto" and rows["a1p1"].citazione == "Articolo 1, paragrafo 1"
    assert rows["a2d1"].capo == "SEZIONE 1" and rows["a2d1"].termine == "dato" and rows["a2d1"].testo == "ogni informazione" and rows["a2d1"].rubrica == "Definizioni — dato"


def plain_terms(text):
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    out = []
    for w in re.sub("[^a-z0-9 ]+", " ", re.sub("['’`]", " ", flat)).split():
        if len(w) >= 2 and w not in STOP_WORDS:
            w = next((w[: -len(x)] for x in SUFFIXES if w.endswith(x) and len(w) - len(x) >= 4), w)
            out.append(w[:-1] if len(w) >= 4 and w[-1] in "aeio" else w)
    return out


def plain_scores(passages, question):
    """BM25 over both fields with floor, heading weight and recital weight, passage by passage."""
    fields = [(plain_terms(p.testo), plain_terms(p.rubrica)) for p in passages]
    n, headed = len(fields), [len(r) for _, r in fields if r]
    mean = (sum(len(b) for b, _ in fields) / n, sum(headed) / max(1, len(headed)) or 1.0)
    out = {}
    for p, both in zip(passages, fields, strict=True):
        total = 0.0
        for t in dict.fromkeys(plain_terms(question)):
            for k, (weight, floor) in enumerate(((1.0, 25), (2.2, 0))):
                df, tf = sum(t in f[k] for f in fields), Counter(both[k])[t]
                if tf:
                    norm = 0.25 + 0.75 * max(len(both[k]), floor) / mean[k]
                    total += weight * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * norm)
        if total:
            out[p.id] = total * (0.55 if p.tipo == "considerando" else 1)
    return out


def test_search(spark, corpus, saved, tmp_path):
    ix, path = saved
    asked = spark.createDataFrame([(1, "chi decide sui dati"), (2, "art. 1"), (3, "considerando 1"), (4, "zzz"), (5, "art. 2 comma 1"), (6, "titolare e trattamento"), (9, " a ")], "qid int, d string")
    rows = search.interactive(asked, ix).orderBy("qid", "rank").collect()
    by = {q: [r.id for r in rows if r.qid == q] for q in (1, 2, 3, 4, 5, 6, 9)}
    assert by[1][0] == "a2d1" and by[2][:2] == ["a1p1", "a1p2"] and by[3][0] == "c1" and by[4] == by[9] == []
    assert all(r.esatto == (r.punteggio == float("inf")) for r in rows)
    passages = corpus.collect()
    for q, d in ((1, "chi decide sui dati"), (6, "titolare e trattamento")):
        assert {r.id: r.punteggio for r in rows if r.qid == q} == pytest.approx(plain_scores(passages, d), abs=1e-6)
        assert [r.punteggio for r in rows if r.qid == q] == sorted((r.punteggio for r in rows if r.qid == q), reverse=True)
    for q in by:
        assert [r["rank"] for r in rows if r.qid == q] == list(range(1, len(by[q]) + 1))
    assert search.search(asked.where("qid = 2"), ix, replace(search.DEFAULTS, limit=1)).count() == 1
    unsaved = search.search(asked.where("qid < 9"), index.build(corpus)).orderBy("qid", "rank").collect()
    assert [r.asDict() for r in unsaved] == [r.asDict() for r in rows]
    none = str(tmp_path / "none")
    assert index.load_if_there(spark, none) is None and set(index.missing(spark, none)) == set(index.TABLES)
    assert {r.name for r in index.sizes(spark, path).where("bytes > 0").collect()} == set(index.TABLES)
    out = index.publish(spark, path, str(tmp_path / "out"))
    assert out.stemmed and evaluate.same_index(out, ix) and evaluate.same_index(index.build(corpus), ix)
    assert not evaluate.same_index(index.build(corpus.where("id <> 'c1'")), ix)


def test_publish_refuses(spark, corpus, tmp_path):
    path, passages = str(tmp_path / "ix"), corpus
    index.save(index.build(passages), path)
    passages.select("pos", "testo").limit(2).write.mode("overwrite").parquet(f"{index._snapshot(spark, path)}/texts")
    with pytest.raises(ValueError, match="lack passage or text"):
        index.publish(spark, path, str(tmp_path / "out"))
    index.save(index.build(passages.withColumn("id", F.lit("a1"))), path)
    with pytest.raises(ValueError, match="occur twice: some"):
        index.publish(spark, path, str(tmp_path / "out"))
    assert index.load_if_there(spark, str(tmp_path / "out")) is None


def test_kept_index_follows_its_source(spark, tmp_path):
    source = str(tmp_path / "documents.parquet")
    docs = lambda text: spark.createDataFrame([(1, text, "src9")], "doc_id long, text string, source string")
    docs("una riga di prova").write.parquet(source)
    get = lambda: store.kept_index(P.from_documents(spark.read.parquet(source)), source)
    first = {r.term for r in get().terms.collect()}
    assert {r.term for r in get().terms.collect()} == first and "prov" in first
    docs("tutta un'altra frase qui").write.mode("overwrite").parquet(source)
    assert "fras" in {r.term for r in get().terms.collect()}


def test_lengths_and_statistics(spark):
    docs = spark.createDataFrame([(1, "titolo\nil lo la di a da\ncasa casa strada", "src9"), (2, "considerando lungo abbastanza\naltro testo qui", "src0")], "doc_id long, text string, source string")
    ix = index.build(P.from_documents(docs))
    got = {r.pos % (1 << 20): (r.len_body, r.len_rub) for r in index.lengths(ix.postings, ix.meta).collect() if r.pos >= 1 << 60}
    assert got == {1: (0, 1), 2: (3, 1)}
    stats = ix.stats.first()
    assert stats.n == 4 and stats.avg_rub == 1.0 and stats.avg_body == pytest.approx((0 + 3 + 3 + 2) / 4)


def test_evaluation(spark, corpus, saved, tmp_path):
    ix = saved[0]
    with open(tmp_path / "q.json", "w", encoding="utf-8") as f:
        json.dump({"nota": ["x"], "domande": [{"d": "diritto di accesso", "attesi": ["a1p2"]}, {"d": "volontà libera", "attesi": ["a2d1", "a2d1"]}]}, f)
    asked, expected = evaluate.read_questions(spark, str(tmp_path / "q.json"))
    assert [tuple(r) for r in asked.orderBy("qid").collect()] == [(1, "diritto di accesso"), (2, "volontà libera")] and expected.count() == 2
    m = {r.target: r for r in evaluate.report(evaluate.evaluate(asked, expected, ix)).collect()}
    assert m["articolo"].p1 == 1.0 and m["esatto"].p1 == 0.5 and m["esatto"].n == 2
    assert m["articolo"].line == "P@1 100 %  P@3 100 %  MRR 1.000"
    assert evaluate.ghosts(expected, ix.meta).count() == 0
    a = evaluate.alignment(ix.meta, ix.texts).first()
    assert a.passages == a.texts == 6 and a.unmatched == 0
    assert evaluate.duplicate_ids(ix.meta).count() == 0 and evaluate.duplicate_ids(ix.meta, "pos").count() == 0
    grid = evaluate.ablation(asked, expected, ix).cache()
    assert grid.count() == 2 * len(evaluate.ABLATION)
    assert {r.questions for r in evaluate.deltas(grid).where("config = 'no_coverage'").collect()} == {0}
    for name in ("no_heading", "bare_plain"):
        alone = evaluate.evaluate(asked, expected, ix, replace(search.DEFAULTS, **evaluate.ABLATION[name])).orderBy("target").collect()
        assert [tuple(r) for r in grid.where(F.col("config") == name).drop("config").orderBy("target").collect()] == [tuple(r) for r in alone]
    plain = index.build(corpus, stemmed=False)
    both = evaluate.stemming(asked, expected, ix, plain)
    assert both.count() == 4 and both.where("config = 'stemmed' and questions <> 0").count() == 0 and evaluate.stemming(asked, expected, ix, None).count() == 2


def test_containing_is_contains(spark):
    words = ["uno", "due", "tre", "quattro", "cinque", "sei", "sette", "otto"]
    texts = [(1, " ".join(words)), (2, "x" + " ".join(words) + "y"), (3, "uno  due tre"), (4, None), (5, ""), (6, "due tre\nquattro cinque sei sette otto nove"), (7, "quattro quattro quattro quattro quattro quattro quattro quattro")]
    items = [(1, "due tre quattro cinque sei sette"), (2, "no due tr"), (3, "e"), (4, "due  tre"), (5, None), (6, "tre\nquattro cinque sei sette ott"), (7, "attro quattro quattro quattro quattro quattro qu"), (8, "uno due tre quattro cinque sei sette otto nove"), (9, "ue tre qua")]
    got = evaluate.containing(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(items, "item long, text string"), "k").collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, x in items for k, t in texts if x is not None and t is not None and x in t)


def test_json(spark, corpus, tmp_path):
    passages = corpus
    P.write_json(passages.repartition(3), str(tmp_path / "p"))
    assert sorted(map(tuple, P.read_json(spark, str(tmp_path / "p")).collect()), key=repr) == sorted(map(tuple, passages.collect()), key=repr)
    with open(tmp_path / "brani.json", "w", encoding="utf-8") as f:
        json.dump([{"id": "c1", "tipo": "considerando", "n": 1, "testo": "è"}, {"id": "a1", "tipo": "articolo", "n": 1, "par": None, "testo": "b"}], f, indent=1)
    assert [(r.pos, r.id, r.par, r.testo) for r in P.read_json(spark, str(tmp_path / "brani.json"), array=True).orderBy("pos").collect()] == [(0, "c1", None, "è"), (1, "a1", None, "b")]


def test_places_do_not_clash(spark):
    """Definitions and numbered paragraphs in one article, the same article on two pages."""
    html = '<div id="art_4"><p class="oj-sti-art">Definizioni</p><div>1. Il paragrafo uno del testo.</div><div>2. Un «a» qui: 1) «dato»: ogni informazione; 2) «titolare»: chi decide; 3) «consenso»: volontà libera;</div></div>'
    rows = P.from_legal_pages(spark.createDataFrame([(1, html), (2, html), (3, None)], "page_id long, html string")).collect()
    assert len(rows) == 8 == len({r.pos for r in rows}) and {r.id for r in rows} == {"a4p1", "a4d1", "a4d2", "a4d3"}
    with pytest.raises(Exception, match="no place for"):
        P.from_legal_pages(spark.createDataFrame([(1 << 40, html)], "page_id long, html string")).collect()


def test_chapters_of_a_long_document(spark):
    kinds = ["art", "subtitle", "capo", "art", "subtitle", "art", "sezione", "subtitle", "art", "art", "capo", "art", "sezione", "art"]
    nodes = spark.createDataFrame([(1, i, k, f"t{i}") for i, k in enumerate(kinds)] + [(2, i, "art" if i else "sezione", "s") for i in range(3000)], "doc int, ord int, kind string, title string")
    rows = P.fill_chapters(nodes).where("kind = 'art'").orderBy("doc", "ord").collect()
    assert [(r.ord, r.capo, r.sezione) for r in rows if r.doc == 1] == [(0, None, None), (3, "t2", None), (5, "t2 — t4", None), (8, "t2 — t4", "t6 — t7"), (9, "t2 — t4", "t6 — t7"), (11, "t10", None), (13, "t10", "t12")]
    assert {(r.capo, r.sezione) for r in rows if r.doc == 2} == {(None, "s")}


def test_composition(spark):
    given = ["e\u0301 \u1100\u1161\u11a8 \u212b \u00e9", "plain", "", None, "a\u0323\u0302"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, x string").select("i", X.clean(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [None if t is None else unicodedata.normalize("NFC", t) for t in given]
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), X.recomposing()))
    for code in (*range(0x80, 0x3000), *range(0xAC00, 0xAC20), *range(0x1D100, 0x1D200)):
        for t in (chr(code), "a" + chr(code), "\u1100" + chr(code)):
            assert unicodedata.normalize("NFC", t) == t or pattern.search(t), hex(code)


def test_fetch(tmp_path):
    page = tmp_path / "page.html"
    page.write_text("è «testo»", encoding="utf-8")
    copy = str(tmp_path / "kept" / "copy.html")
    assert fetch(page.as_uri(), copy) == "è «testo»"
    page.write_text("altro", encoding="utf-8")
    assert fetch(page.as_uri(), copy) == "è «testo»" and fetch(page.as_uri(), copy, force=True) == "altro"
    with pytest.raises(OSError):
        fetch((tmp_path / "missing").as_uri(), copy, force=True)
    assert fetch("", copy) == "altro"


def test_definitions_need_three(spark):
    df = spark.createDataFrame([(1, '1) "a b": x; 2) "c d": y; 3) "e f": z'), (2, '1) "a b": x; 2) "c d": y'), (3, None)], "i int, testo string")
    assert [(r.i, r.num, r.termine, r.corpo) for r in P.split_definitions(df).orderBy("num").collect()] == [(1, 1, "a b", "x"), (1, 2, "c d", "y"), (1, 3, "e f", "z")]


def test_stream(spark, saved, tmp_path):
    ix = saved[0]
    spark.createDataFrame([(7, "diritto di accesso")], "qid int, d string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid int, d string").parquet(str(tmp_path / "in"))
    answer(stream, ix, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("rank = 1").first().id == "a1p2"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    ix = index.build(P.from_documents(docs))
    assert search.search(spark.createDataFrame([(1, "dati")], "qid int, d string"), ix).count() == 0
    assert ix.stats.select(F.col("n")).first().n == 0


def test_targets_come_from_whole_documents(spark, tmp_path):
    """A benchmark text over a line break, and one in a recital's first line, have article targets and are judged, whole and short."""
    docs = [(1, "rubrica uno\nprima riga del testo\nseconda riga", "src9"), (2, "prima riga di un considerando\naltra riga", "src0"), (3, "rubrica tre\nuna frase intera qui", "src9")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "del testo\nseconda"), (2, "riga di un considerando"), (3, "frase intera"), (4, "assente")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    both = lambda *qids: {q + k for q in qids for k in (0, queries.SHORT)}
    assert {r.qid for r in queries.qrels(spark, str(tmp_path)).collect()} == both(2, 3)
    found = {(r.qid, r.tipo, r.n) for r in queries.qrels_article(spark, str(tmp_path)).collect()}
    assert found == {(q, t, n) for n, t in ((1, "articolo"), (2, "considerando"), (3, "articolo")) for q in both(n)}
    n = {r.target: r.n for r in queries.eval_metrics(spark, str(tmp_path)).collect()}
    assert n == {"articolo": 6, "esatto": 4}
    assert {r.qid for r in queries.match_article(spark, str(tmp_path)).collect()} == both(1, 2, 3)


def test_definitions_of_all_lines(spark, tmp_path):
    """Lines beyond the 99th give definitions, also where fewer than three are left."""
    docs = [(n, "\n".join(f"voce numero {i}" for i in range(1, n + 1)), "src9") for n in (3, 99, 101, 250)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.definition_split(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.num, r.termine, r.corpo) for r in rows) == [(n, i, f"voce numero {i}", f"voce numero {i}") for n in (3, 99, 101, 250) for i in range(1, n + 1)]


def test_legal_pages_are_parsed_once(spark, tmp_path):
    """Recitals, articles, headings and blocks come from one run of the parser."""
    from lexgrove.sources import passages as P

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    page = '<html><body><div id="rct_1"><p>(1) a recital</p></div><div id="art_2"><p class="oj-sti-art">Head</p><div>1. the first paragraph</div></div></body></html>'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string").mapInPandas(counted, "page_id long, html string")
    assert P.from_legal_pages(pages).count() == 2 and seen.value == 1
