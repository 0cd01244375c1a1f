"""The queries of the retrieval engine over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import question as Q
from ..functions import text as X
from ..operators import display, evaluate, expansion, search, store
from ..operators import index as I
from ..sources import passages as P
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: First qids of references to articles and to recitals, of short questions, and of users' turns.
ARTICLES, RECITALS, SHORT, SAID = 1_000_000, 2_000_000, 3_000_000, 4_000_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return store.spread(_t(spark, sf_dir, "documents"), "doc_id")


def _passages(spark, sf_dir):
    return P.from_documents(_documents(spark, sf_dir))


def _questions(spark, sf_dir):
    """Whole benchmark texts; references to articles and recitals; and, beside the whole texts, their first eight words as short questions."""
    b = _t(spark, sf_dir, "benchmark")
    some = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 8), " ")
    item = F.col("item_id")
    forms = ((0, F.col("text")), (ARTICLES, F.concat(F.lit("art. "), item.cast("string"), F.lit(", comma 1"))), (RECITALS, F.concat(F.lit("considerando "), item.cast("string"))), (SHORT, some))
    return b.select(F.explode(F.array(*(F.struct((item + first).alias("qid"), d.alias("d")) for first, d in forms))).alias("q")).select("q.*")


def _italian(spark):
    return spark.createDataFrame(list(enumerate(O.ITALIAN)), "qid long, d string")


def _all_questions(spark, sf_dir):
    """Italian questions, the questions above, and users' turns."""
    said = _t(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn") + SAID).alias("qid"), F.col("text").alias("d"))
    return _italian(spark).unionByName(_questions(spark, sf_dir)).unionByName(said)


def _index(spark, sf_dir, stemmed=True) -> I.Index:
    return store.kept_index(_passages(spark, sf_dir), f"{sf_dir}/documents.parquet", stemmed, clustered=True)


def _finite(df: DataFrame) -> DataFrame:
    """Exact hits score infinity in the engine; here they have no number."""
    return df.withColumn("punteggio", F.when(~F.col("esatto"), F.col("punteggio")))


def _both_forms(df: DataFrame) -> DataFrame:
    """qid for item: a benchmark text is asked whole and short, and both expect the same."""
    return df.withColumn("qid", F.explode(F.array(F.col("item"), F.col("item") + SHORT))).drop("item")


def _items(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")


def _qrels(spark, sf_dir, docs=None):
    """qid, id: the passages that contain a benchmark text; docs(n): the documents that contain one, where they are known, as no other has such a passage."""
    index = _index(spark, sf_dir)
    texts = index.texts.withColumnRenamed("testo", "text")
    if docs is not None and search.few_rows(docs):
        texts = texts.withColumn("n", P.document_of(F.col("pos"))).join(F.broadcast(docs), "n", "left_semi").drop("n")
    found = evaluate.containing(texts, _items(spark, sf_dir), "pos")
    return _both_forms(found.join(index.meta.select("pos", "id"), "pos")).select("qid", "id")


def _norms(spark, sf_dir):
    """qid, tipo, n: the documents that contain a benchmark text anywhere, over line breaks too."""
    docs = _documents(spark, sf_dir)
    found = evaluate.containing(docs.select("doc_id", "text"), _items(spark, sf_dir), "doc_id")
    return _both_forms(found.join(docs.select("doc_id", P.type_of(F.col("source")).alias("tipo")), "doc_id")).select("qid", "tipo", F.col("doc_id").alias("n"))


def _targets(spark, sf_dir):
    """questions that have a target, qrels, norms; the targets are few and used several times, so they are looked up once."""
    norms = store.cut(_norms(spark, sf_dir))
    qrels = store.cut(_qrels(spark, sf_dir, norms.select("n").distinct()))
    return _questions(spark, sf_dir).join(qrels.select("qid").union(norms.select("qid")).distinct(), "qid", "left_semi"), qrels, norms


_CORE = (O.PASSAGES, O.QUESTIONS, O.POSTINGS, O.terms())


@query(f"select doc_id, {O.norm('text')} norm from documents")
def normalize_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.normalize(F.col("text")).alias("norm"))


@query(f"select doc_id, array_to_string({O.toks('text')}, ' ') tokens from documents")
def tokenize(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(f"select term, {O.stem('term')} root, count(*) n from (select unnest({O.kept('text')}) term from documents) group by term")
def stem_terms(spark, sf_dir):
    words = _documents(spark, sf_dir).select(F.explode(X.kept_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return words.select("term", X.stem(F.col("term")).alias("root"), "n")


@query(f"select doc_id, len(list_filter(regexp_split_to_array({O.norm('text')}, ' +'), lambda w: w <> ''))::int words, len({O.kept('text')})::int kept from documents")
def stopword_filter(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(X.raw_tokens(F.col("text"))).alias("words"), F.size(X.kept_tokens(F.col("text"))).alias("kept"))


@query(f"select doc_id, {O.clean('text')} cleaned from documents")
def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query(O.sql(O.PASSAGES, select="select pos, id, tipo, n, par, citazione, rubrica, termine, capo, testo from passages"))
def passages_from_lines(spark, sf_dir):
    return _passages(spark, sf_dir)


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select field, term, pos, tf from postings"))
def term_frequency(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("field", "term", "pos", "tf")


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select field, term, count(*) df from postings group by field, term"))
def document_frequency(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("field", "term", "df")


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select pos, len_body, len_rub from lens"))
def document_length(spark, sf_dir):
    index = _index(spark, sf_dir)
    return I.lengths(index.postings, index.meta)


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select n, round(avg_body, 9) avg_body, round(avg_rub, 9) avg_rub from stats"))
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n", F.round("avg_body", 9).alias("avg_body"), F.round("avg_rub", 9).alias("avg_rub"))


@query(O.sql(O.PASSAGES, select="select count(*) passages, count(*) filter (tipo = 'considerando') recitals, count(*) filter (tipo = 'articolo') paragraphs, count(distinct n) filter (tipo = 'articolo') articles, coalesce(sum(length(testo)), 0)::bigint chars, (coalesce(sum(length(testo)), 0) // greatest(count(*), 1))::bigint mean_chars from passages"))
def corpus_report(spark, sf_dir):
    return P.corpus_report(_passages(spark, sf_dir))


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select field, count(distinct term) terms, sum(tf)::bigint occurrences from postings group by field"))
def vocabulary(spark, sf_dir):
    return _index(spark, sf_dir).postings.groupBy("field").agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("occurrences"))


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select field, term, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 9) idf from (select field, term, count(*) df from postings group by field, term) cross join stats"))
def idf(spark, sf_dir):
    index = _index(spark, sf_dir)
    df = index.terms.crossJoin(F.broadcast(index.stats))  # one row
    return df.select("field", "term", F.round(search.idf(F.col("n"), F.col("df")), 9).alias("idf"))


def _bm25(spark, sf_dir, body_only=False, **options):
    index, config = _index(spark, sf_dir), replace(search.DEFAULTS, limit=10, **options)
    terms = store.cut(search.question_terms(_questions(spark, sf_dir), index.stemmed, config.synonyms))
    few = search.few_rows(terms)
    found = search.scores(terms, index, config, config.limit, few=few, fields=("body",) if body_only else ())
    return search.ranked(None, found, config.limit).select("qid", "rank", "pos", "punteggio")


_PLAIN = "select qid, rank, pos, punteggio from top"


@query(O.sql(*_CORE, O.scores(0, 1.0, fields="p.field = 'body'"), O.ranked(10, False), select=_PLAIN))
def bm25_body_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, body_only=True, minimum_length=0, recital_weight=1.0)


@query(O.sql(*_CORE, O.scores(0, 1.0), O.ranked(10, False), select=_PLAIN))
def bm25_two_field_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, minimum_length=0, recital_weight=1.0)


@query(O.sql(*_CORE, O.scores(25, 1.0), O.ranked(10, False), select=_PLAIN))
def bm25_length_floor(spark, sf_dir):
    return _bm25(spark, sf_dir, recital_weight=1.0)


@query(O.sql(*_CORE, O.scores(), O.ranked(10, False), select=_PLAIN))
def bm25_type_weight(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(O.sql(*_CORE, O.scores(coverage=0.5), O.ranked(10, False), select=_PLAIN))
def bm25_coverage(spark, sf_dir):
    return _bm25(spark, sf_dir, coverage=0.5)


_ASKED = (O.ITALIAN_SQL, O.QUESTIONS.replace("questions as", "asked_ as"), O.SAID, "questions as (select qid, d from italian union all select qid, d from asked_ union all select qid, d from said)")


@query(O.sql(*_ASKED, select=f"select qid, {O.expand('d')} expanded from questions"))
def expand_query(spark, sf_dir):
    """The lexicon's rules as a table, joined on words in a row."""
    return expansion.expanded(_all_questions(spark, sf_dir), expansion.builtin(spark))


@query(O.sql(*_ASKED, O.REFS, select="select qid::bigint qid, tipo, n, par from refs where tipo is not null"))
def explicit_reference(spark, sf_dir):
    return _all_questions(spark, sf_dir).select("qid", Q.reference(F.col("d")).alias("r")).where("r is not null").select("qid", "r.tipo", "r.n", "r.par")


@query(O.sql(O.PASSAGES, O.QUESTIONS, O.EXACT, select="select qid, pos, id, citazione from exact join passages using (pos)"))
def exact_hits(spark, sf_dir):
    index, asked = _index(spark, sf_dir), _questions(spark, sf_dir)
    return search.named(asked, index, search.few_rows(asked)).join(index.meta, "pos").select("qid", "pos", "id", "citazione")


_SEARCH = (*_CORE, O.scores(), O.EXACT, O.ranked())
_TERMINI = "words as (select qid, list(term order by ord) w from terms group by qid)"


@query(O.sql(*_SEARCH, _TERMINI, select="select qid, rank, pos, id, tipo, n, par, citazione, rubrica, capo, termine, punteggio, esatto, coalesce(array_to_string(w, ' '), '') termini from top join passages using (pos) left join words using (qid)"))
def search_merged(spark, sf_dir):
    return _finite(search.interactive(_questions(spark, sf_dir), _index(spark, sf_dir))).withColumn("termini", F.array_join("termini", " "))


@query(O.sql(*_SEARCH, select="select qid, rank, pos, testo from top join passages using (pos)"))
def late_text_join(spark, sf_dir):
    index = _index(spark, sf_dir)
    return search.late_text(search.search(_questions(spark, sf_dir), index), index).select("qid", "rank", "pos", "testo")


@query(O.sql(*_SEARCH, _TERMINI, f"seg as (select qid, rank, w, unnest(s) seg, unnest(range(len(s))) seg_no from (select qid, rank, coalesce(w, []) w, regexp_extract_all(testo, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)', 1) s from top join passages using (pos) left join words using (qid)))", select=f"select qid, rank, seg_no::int seg_no, seg, (root <> '' and list_contains(w, root)) hit from (select *, {O.stem('trim(' + O.norm('seg') + ')')} root from seg)"))
def highlight_segments(spark, sf_dir):
    index = _index(spark, sf_dir)
    shown = display.highlighted(search.late_text(search.search(_questions(spark, sf_dir), index), index))
    return shown.select("qid", "rank", F.posexplode("segments").alias("seg_no", "s")).select("qid", "rank", "seg_no", "s.seg", "s.hit")


@query(O.sql(*_SEARCH, select="select qid, rank, case when esatto then 'esatto' else '' end badge, citazione, rubrica, capo, length(testo) > 700 folded from top join passages using (pos)"))
def result_cards(spark, sf_dir):
    index = _index(spark, sf_dir)
    return display.cards(search.late_text(search.search(_questions(spark, sf_dir), index), index)).drop("segments")


@query(O.sql(O.DEFINED, select=O.DEFINITION_ROWS))
def definition_split(spark, sf_dir):
    """All lines of a document as definitions, in even lists of 99 lines at most, since a marker has two digits; num is the line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("i"), F.replace(x, F.lit('"'), F.lit("")).alias("x")))
    rows = _documents(spark, sf_dir).select("doc_id", F.filter(lines, lambda s: F.length(s["x"]) >= 2).alias("kept")).where(F.size("kept") > 0)
    rows = rows.select("doc_id", "kept", F.size("kept").alias("n"), F.ceil(F.size("kept") / 99).cast("int").alias("g"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("k"))
    begin = lambda k: F.floor(k * F.col("n") / F.col("g")).cast("int")
    rows = rows.select("doc_id", F.slice("kept", begin(F.col("k")) + 1, begin(F.col("k") + 1) - begin(F.col("k"))).alias("part"))
    piece = lambda s, i: F.concat((i + 1).cast("string"), F.lit(') "'), F.substring(s["x"], 1, 30), F.lit('": '), s["x"], F.lit("; "))
    found = P.split_definitions(rows.select("doc_id", "part", F.array_join(F.transform("part", piece), "").alias("testo")))
    return found.select("doc_id", F.element_at("part", F.col("num"))["i"].alias("num"), "termine", "corpo")


@query(O.sql(O.NODES, "c as (select *, sum((kind = 'capo')::int) over (partition by doc order by ord) c from nodes)", "s as (select *, sum((kind = 'sezione')::int) over (partition by doc, c order by ord) s from c)", "f as (select *, case when c > 0 then nullif(string_agg(case when s = 0 and kind in ('capo', 'subtitle') then title end, ' — ') over (partition by doc, c order by ord), '') end capo, case when s > 0 then nullif(string_agg(case when kind in ('sezione', 'subtitle') then title end, ' — ') over (partition by doc, c, s order by ord), '') end sezione from s)", select="select doc, ord::int ord, capo, sezione from f where kind = 'art'"))
def chapter_forward_fill(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    k = F.length("line") % 7
    nodes = rows.select("doc", (F.col("ord") + 1).alias("ord"), F.when(k == 0, "capo").when(k == 1, "sezione").when(k == 2, "subtitle").otherwise("art").alias("kind"), F.col("line").alias("title"))
    return P.fill_chapters(nodes).where("kind = 'art'").select("doc", "ord", "capo", "sezione")


_PAGE = "html"
for _tag in ("script", "style", "nav", "footer"):
    _PAGE = f"regexp_replace({_PAGE}, '(?is)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '(?is)<div class=\"ad\">.*?</div>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


def _bare(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return O.clean(x)


@query(f"select page_id, ord::int ord, heading, testo from (select page_id, ord, {_bare(chr(39) * 2 + ' || h')} heading, {_bare('part')} testo from (select page_id, h, i - 1 ord, regexp_split_to_array(p[i], '(?i)</p>|</article>|</body>')[1] part from (select page_id, regexp_extract(x, '(?is)<h1>(.*?)</h1>', 1) h, regexp_split_to_array(x, '(?i)<p>') p from (select page_id, {_PAGE} x from pages)), unnest(range(2, len(p) + 1)) u(i))) where length(testo) >= 12")
def page_passages(spark, sf_dir):
    return P.from_pages(store.spread(_t(spark, sf_dir, "pages"), "page_id"))


@query(O.sql(O.PASSAGES, "legal as (select n, list(testo order by par) filter (par is not null) ps, any_value(rubrica) r from (select n, par, rubrica, " + O.clean("replace(replace(replace(testo, '<', ' '), '>', ' '), '&', ' ')") + " testo from passages where tipo = 'articolo') group by n)", select="select n page, n, i::int par, ps[i] testo from legal, unnest(range(1, len(ps) + 1)) u(i) where length(ps[i]) >= 12 and not regexp_matches(ps[i], '^\\d+\\.')"))
def dom_extraction(spark, sf_dir):
    """Articles rendered in the legal markup, then extracted from the HTML by the parser."""
    testo = X.clean(F.translate("testo", "<>&", "   "))
    arts = _passages(spark, sf_dir).where("tipo = 'articolo' and par is not null").select("n", "par", testo.alias("testo"))
    parts = arts.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("par", "testo"))), lambda x, i: F.concat(F.lit("<div>"), (i + 1).cast("string"), F.lit(". "), x["testo"], F.lit("<sup>1</sup></div>"))).alias("ps"))
    html = F.concat(F.lit('<html><body><p class="oj-ti-section-1">CAPO I</p><div id="art_'), F.col("n").cast("string"), F.lit('"><div class="eli-title">x</div>'), F.array_join("ps", ""), F.lit("</div></body></html>"))
    found = P.from_legal_pages(parts.select(F.col("n").alias("page"), html.alias("html")), "page").where("tipo = 'articolo' and termine is null")
    return found.where(~F.col("testo").rlike(r"^\d+\.")).select("page", "n", "par", "testo")


@query("select doc_id page, testo from (select doc_id, regexp_replace(" + O.clean("'(1) ' || translate(text, '<>&', '   ')") + ", '^\\(\\d+\\)\\s*', '') testo from documents where source in ('src0','src1','src2','src3','src4','src5')) where testo <> ''")
def dom_recitals(spark, sf_dir):
    """Whole documents rendered as recitals in the legal markup, then extracted by the parser."""
    docs = _documents(spark, sf_dir).where(P.type_of(F.col("source")) == "considerando")
    html = F.concat(F.lit('<html><body><div id="rct_1"><p>(1) '), F.translate("text", "<>&", "   "), F.lit("<span class='oj-super'>7</span></p></div></body></html>"))
    return P.from_legal_pages(docs.select(F.col("doc_id").alias("page"), html.alias("html")), "page").where("tipo = 'considerando'").select("page", "testo")


@query(O.sql(O.PASSAGES, select="select pos, id, tipo, n, par, citazione, rubrica, termine, capo, testo from passages"))
def json_round_trip(spark, sf_dir):
    """All passages, written as JSON and read from there."""
    path = f"{store.folder(spark)}/passages-{store.version(spark, f'{sf_dir}/documents.parquet')}.json"
    P.write_json(_passages(spark, sf_dir), path)
    return P.read_json(spark, path)


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select * from (select 'postings' name, count(*) rows from postings union all select 'terms', count(*) from (select distinct field, term from postings) union all select 'meta', count(*) from passages union all select 'texts', count(*) from passages union all select 'stats', 1)"))
def saved_index(spark, sf_dir):
    """Rows of the saved index's tables; the first query to need the index builds and saves it."""
    index, out = _index(spark, sf_dir), None
    for name in ("postings", "terms", "meta", "texts", "stats"):
        one = getattr(index, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(O.sql(O.PASSAGES, O.POSTINGS, select="select *, true rebuilt, name not in ('meta', 'postings', 'terms') unchanged from (select 'terms' name, count(*) rows from (select distinct field, term from postings) union all select 'meta', count(*) from passages union all select 'texts', count(*) from passages union all select 'postings', count(*) from (select distinct field, term, pos >> 5 from postings))"))
def index_digest(spark, sf_dir):
    """Digests of the saved index's tables: whether those of an index built anew from shuffled documents equal them, and, one passage's heading being changed, which stay."""
    saved, docs = _index(spark, sf_dir), _documents(spark, sf_dir)
    again = P.from_documents(docs.repartition(max(7, I.buckets_of(spark, saved.stats.first().n)), "source", "doc_id"))
    least = F.lit(saved.meta.agg(F.min("pos")).first()[0]).cast("long")
    before = P.from_documents(docs.where(F.col("doc_id") == P.document_of(least))).coalesce(1)  # all blocks of its document
    after = before.withColumn("rubrica", F.when(F.col("pos") == least, F.lit("lexgrovius")).otherwise(F.col("rubrica")))
    out, two = None, I.revised(again, before, after)
    for name, table in (("terms", "terms"), ("meta", "meta"), ("texts", "texts"), ("postings", "packed")):
        one = getattr(saved, table).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", *(F.lit(saved.saved[name] == x[name]).alias(c) for x, c in zip(two, ("rebuilt", "unchanged"), strict=True)))
        out = one if out is None else out.unionByName(one)
    return out


@query(O.sql(O.PASSAGES, O.QRELS, select="select qid, id from qrels"))
def qrels(spark, sf_dir):
    return _qrels(spark, sf_dir)


@query(O.sql(O.ARTICLE_TARGETS, select="select qid, tipo, n from article_targets"))
def qrels_article(spark, sf_dir):
    return _norms(spark, sf_dir)


@query(O.sql(O.PASSAGES, "expected as (select 'a' || item_id || 'p1' id from benchmark union all select 'c' || item_id from benchmark)", select="select distinct id from expected anti join passages using (id)"))
def ghost_ids(spark, sf_dir):
    item = F.col("item_id").cast("string")
    b = _t(spark, sf_dir, "benchmark")
    expected = b.select(F.concat(F.lit("a"), item, F.lit("p1")).alias("id")).union(b.select(F.concat(F.lit("c"), item)))
    return evaluate.ghosts(expected, _index(spark, sf_dir).meta).select("id")


_JUDGED = (O.PASSAGES, O.QUESTIONS, O.QRELS, O.ARTICLE_TARGETS, O.JUDGED)


def _eval(*, stemmed=True, config=search.DEFAULTS) -> tuple[str, ...]:
    return (O.indexed(stemmed), O.terms("judged", config.synonyms, stemmed), O.scores(config.minimum_length, config.recital_weight, config.coverage, config.heading_weight), O.EXACT, O.ranked(10), O.METRICS)


_EVAL = (*_JUDGED, *_eval())


def _evaluated(spark, sf_dir):
    """questions, their results, and qid, target, r."""
    asked, expected, norms = _targets(spark, sf_dir)
    results = search.search(asked, _index(spark, sf_dir), replace(search.DEFAULTS, limit=evaluate.DEPTH))
    return asked, results, evaluate.target_ranks(results, expected, norms)


@query(O.sql(*_EVAL, select="select qid, r::int esatto from targets where target = 'esatto'"))
def match_exact(spark, sf_dir):
    return _evaluated(spark, sf_dir)[2].where("target = 'esatto'").select("qid", F.col("r").alias("esatto"))


@query(O.sql(*_EVAL, select="select qid, r::int articolo from targets where target = 'articolo'"))
def match_article(spark, sf_dir):
    return _evaluated(spark, sf_dir)[2].where("target = 'articolo'").select("qid", F.col("r").alias("articolo"))


@query(O.sql(*_EVAL, select="select target, n, p1, p3, mrr from metrics"))
def eval_metrics(spark, sf_dir):
    return evaluate.target_metrics(_evaluated(spark, sf_dir)[2])


@query(O.sql(*_EVAL, "cited as (select qid, string_agg(citazione, ' | ' order by rank) found from top join passages using (pos) where rank <= 3 group by qid)", select="select qid, d, r::int articolo, found from targets join questions using (qid) left join cited using (qid) where target = 'articolo' and (r is null or r <> 1)"))
def eval_misses(spark, sf_dir):
    return evaluate.misses(*_evaluated(spark, sf_dir))


def _ablation_sql() -> str:
    one = lambda name, c: "select * from (" + O.sql(*_eval(config=c)[1:], select=f"select '{name}' config, target, n, p1, p3, mrr from metrics") + ")"
    return O.sql(*_JUDGED, O.POSTINGS, select=" union all ".join(one(name, replace(search.DEFAULTS, **options)) for name, options in evaluate.ABLATION.items()))


@query(_ablation_sql())
def ablation_grid(spark, sf_dir):
    asked, expected, norms = _targets(spark, sf_dir)
    return evaluate.ablation(asked, expected, _index(spark, sf_dir), norms)


@query(O.sql(*_JUDGED, select="select * from (" + O.sql(*_eval(), select="select 'stemmed' config, target, n, p1 from metrics") + ") union all select * from (" + O.sql(*_eval(stemmed=False), select="select 'plain' config, target, n, p1 from metrics") + ")"))
def stemming(spark, sf_dir):
    """The stemmed index against one without stems, over the same questions; of the latter, the postings that these ask for."""
    asked, expected, norms = _targets(spark, sf_dir)
    index, words = _index(spark, sf_dir), store.cut(search.question_terms(asked, False).select("term").distinct())
    plain = I.unstemmed(index, _passages(spark, sf_dir), words, search.few_rows(words), f"{store.folder(spark)}/words-{uuid.uuid4().hex}", clustered=True)

    def one(name, index):
        results = search.search(asked, index, replace(search.DEFAULTS, limit=evaluate.DEPTH))
        return evaluate.target_metrics(evaluate.target_ranks(results, expected, norms)).select(F.lit(name).alias("config"), "target", "n", "p1")

    return one("stemmed", index).unionByName(one("plain", plain))


@query(O.sql(*_EVAL, "floors(target, metric, floor) as (values " + ", ".join(f"('{t}', '{m}', {v}::double)" for t, m, v in evaluate.FLOORS) + ")", "long as (select target, 'p1' metric, p1 value from metrics union all select target, 'p3', p3 from metrics)", select="select target, metric, floor, value, coalesce(value >= floor, false) ok from floors left join long using (target, metric)"))
def threshold_gate(spark, sf_dir):
    return evaluate.gate(spark, evaluate.target_metrics(_evaluated(spark, sf_dir)[2]))


@query(O.sql(O.PASSAGES, "kept as (select pos from passages where n in (select doc_id from labels))", select="select (select count(*) from passages) passages, (select count(*) from kept) texts, (select count(*) from passages anti join kept using (pos)) + (select count(*) from kept anti join passages using (pos)) unmatched"))
def index_text_alignment(spark, sf_dir):
    """The whole index against the texts of labelled documents alone: what lacks a text is counted."""
    texts = _passages(spark, sf_dir).join(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("n")).distinct(), "n", "left_semi")
    return evaluate.alignment(_index(spark, sf_dir).meta, texts)


@query(O.sql("merged as (select doc_id, text, source from documents union all select item_id, text, 'src9' from benchmark)", O.PASSAGES.replace("from documents", "from merged"), select="select id, count(*) n from passages group by id having count(*) > 1"))
def duplicate_ids(spark, sf_dir):
    """Ids that occur twice where benchmark texts are added under numbers that documents have."""
    more = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("src9").alias("source"))
    return evaluate.duplicate_ids(P.from_documents(_documents(spark, sf_dir).select("doc_id", "text", "source").unionByName(more)))
