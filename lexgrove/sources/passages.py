"""Passages, the retrieval unit: from plain documents, from a JSON file, from HTML with plain or legal markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import DEFINITION, DEFINITIONS
from ..functions.text import clean, tidy
from ..operators.checkpoints import cut
from . import html

SCHEMA = T.StructType(
    [T.StructField("pos", T.LongType()), T.StructField("id", T.StringType()), T.StructField("tipo", T.StringType()), T.StructField("n", T.LongType()), T.StructField("par", T.IntegerType()), T.StructField("citazione", T.StringType()), T.StructField("rubrica", T.StringType()), T.StructField("termine", T.StringType()), T.StructField("capo", T.StringType()), T.StructField("testo", T.StringType())]
)
#: Sources whose documents count as recitals, shortest paragraph that is kept.
RECITAL_SOURCES = ("src0", "src1", "src2", "src3", "src4", "src5")
SHORTEST = 12


def place(tipo: Column, n: Column, par: Column) -> Column:
    """Corpus order as one number: recitals first, then by document and paragraph. It needs no global sort.

    39 bits of document, 20 of paragraph; a number beyond that is an error, not a clash.
    """
    n, at = n.cast("long"), F.coalesce(par, F.lit(0))
    fits = n.between(0, (1 << 39) - 1) & at.between(0, (1 << 20) - 1)
    pos = F.when(tipo == "considerando", F.lit(0)).otherwise(F.lit(1 << 60)).cast("long") + n * F.lit(1 << 20) + at
    return F.when(fits, pos).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no place for document"), n.cast("string"), F.lit("paragraph"), at.cast("string"))).cast("long"))


def document_of(pos: Column) -> Column:
    """The document of a place()."""
    return F.shiftright(pos.bitwiseAND(F.lit((1 << 59) - 1)), 20)


def place_on_page(page: Column, tipo: Column, n: Column, par: Column, definition: bool = False) -> Column:
    """The same over many pages: recitals first, then by page, article or recital, and paragraph; an article's definitions come after its paragraphs.

    30 bits of page, 14 of article, 17 of paragraph; a number beyond that is an error, not a clash.
    """
    page, par = page.cast("long"), F.coalesce(par, F.lit(0))
    low = F.lit(0).cast("long")
    fits = page.between(0, (1 << 30) - 1) & n.between(0, (1 << 14) - 1) & par.between(0, (1 << 17) - 1)
    at = F.when(tipo == "considerando", low).otherwise(F.lit(1 << 62)) + page * F.lit(1 << 32) + n * F.lit(1 << 18) + F.lit(definition << 17) + par
    return F.when(fits, at).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no place for"), page.cast("string"), tipo, n.cast("string"), par.cast("string"))).cast("long"))


def identify(df: DataFrame, pos: Column | None = None) -> DataFrame:
    """Adds pos, id and citazione to (tipo, n, par)."""
    with_par = lambda mark: F.when(F.col("par").isNotNull() & (F.col("par") != 0), F.concat(F.lit(mark), F.col("par").cast("string"))).otherwise("")
    recital = F.col("tipo") == "considerando"
    out = df.withColumn("pos", place(F.col("tipo"), F.col("n"), F.col("par")) if pos is None else pos)
    out = out.withColumn("id", F.concat(F.when(recital, "c").otherwise("a"), F.col("n").cast("string"), with_par("p")))
    return out.withColumn("citazione", F.concat(F.when(recital, "Considerando ").otherwise("Articolo "), F.col("n").cast("string"), with_par(", paragrafo ")))


def type_of(source: Column) -> Column:
    """Whether a document's passages are recitals or articles."""
    return F.when(source.isin(*RECITAL_SOURCES), "considerando").otherwise("articolo")


def from_documents(docs: DataFrame) -> DataFrame:
    """Each document is an article or recital. An article's first line is its heading, each further line a paragraph; all lines of a recital are paragraphs, the first without a number; one line alone is a passage without a number. A document without an id cannot be cited and is left out."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("n"), type_of(F.col("source")).alias("tipo"), F.split("text", "\n").alias("lines"))
    one, recital = F.size("lines") == 1, F.col("tipo") == "considerando"
    rows = rows.select("n", "tipo", F.when(one | recital, "").otherwise(F.element_at("lines", 1)).alias("rubrica"), one.alias("one"), F.posexplode("lines").alias("ord", "testo"))
    rows = rows.where((F.col("one") | recital | (F.col("ord") > 0)) & (F.length("testo") >= SHORTEST)).withColumn("par", F.when(~F.col("one"), F.col("ord")))
    return identify(rows).select("pos", "id", "tipo", "n", "par", "citazione", "rubrica", F.lit(None).cast("string").alias("termine"), F.lit("").alias("capo"), "testo")


def read_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Passages from JSON: lines as write_json writes them, each with its pos; or files that hold one array each, whose pos is the place in the array (a second file's places come after)."""
    if not array:
        return spark.read.schema(SCHEMA).json(path)
    one = T.StructType(SCHEMA.fields[1:])
    return array_elements(spark, path).select("pos", F.from_json("element", one, {"mode": "FAILFAST"}).alias("x")).select("pos", "x.*")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """pos, element of files under path that hold one JSON array of objects each: the objects' text, each file read by as many tasks as it has splits.

    The files are read in pieces that end at a closing brace.  Whether a piece begins inside a string follows from the quotes before it,
    and how deep it lies from the braces outside strings; both are running sums inside a split, moved by the sums of the splits before (a
    row for each split).  An object ends where the depth is zero again; its pieces are put together by its number.  What is
    no object is left out; an array that never ends is an error; an empty file has no objects.
    """
    place = ("file", "block")
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    pieces = pieces.withColumn("plain", plain).withColumn("quotes", F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit(""))))
    inside = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one split's pieces
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one file's splits

    def running(rows: DataFrame, amount: str, name: str) -> DataFrame:
        """rows with the sum of amount over all pieces of the file before this one."""
        sums = rows.groupBy(*place).agg(F.sum(amount).alias("s")).select(*place, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"))
        own = rows.withColumn("r", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        return own.join(sums, [*place]).withColumn(name, F.col("r") + F.col("s")).drop("r", "s")

    pieces = running(pieces, "quotes", "quoted")
    opened = F.pmod("quoted", F.lit(2)) == 1
    bare = F.regexp_replace(F.concat(F.when(opened, '"').otherwise(""), F.col("plain")), r'"[^"]*(?:"|$)', "")
    closes = F.when(F.pmod(F.col("quoted") + F.col("quotes"), F.lit(2)) == 0, 1).otherwise(0)
    pieces = pieces.withColumn("closes", closes).withColumn("step", F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit(""))) - F.col("closes")).drop("plain", "quotes", "quoted")
    pieces = running(pieces, "step", "depth")
    pieces = pieces.withColumn("ends", F.when((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 0), 1).otherwise(0))
    pieces = running(pieces, "ends", "number")
    files = pieces.groupBy("file").agg(F.sum("ends").alias("n")).select("file", "n", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for each file
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda x: x["piece"]), "}")
    whole = pieces.groupBy("file", "number").agg(text.alias("text"), F.max("ends").alias("ends")).join(files, "file")
    # what follows the last object ends the array; else a brace that is not there would be taken for read
    over = whole.where("ends = 0").select("file", F.col("text").rlike(r"\]\s*$").alias("over"))
    whole = whole.join(over, "file", "left").withColumn("over", F.coalesce("over", F.lit(False))).where("ends = 1 or not over")
    element = F.when(F.col("over"), F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit("}"))).otherwise(F.raise_error(F.concat(F.lit("no end of the array in "), F.col("file"))).cast("string"))
    return whole.select((F.col("first") + F.col("number")).cast("long").alias("pos"), element.alias("element"))


def write_json(passages: DataFrame, path: str) -> None:
    """Passages as JSON lines, which read_json reads in any number of tasks."""
    passages.select(*(f.name for f in SCHEMA.fields)).write.mode("overwrite").json(path)


def from_pages(pages: DataFrame) -> DataFrame:
    """page_id, ord, heading, testo of pages(page_id, html) with plain markup: h1 and p outside navigation, footers, advertisements, scripts and styles."""
    rows = html.paragraphs(pages)  # composed, so that tidying is what is left of cleaning
    # an array's filter, since a predicate on the tidied text would be pushed below it and tidy every text twice
    long = F.filter(F.array(tidy(F.col("body"))), lambda x: F.length(x) >= SHORTEST)
    return rows.select("page_id", "ord", tidy(F.col("heading")).alias("heading"), F.explode(long).alias("testo"))


def split_definitions(df: DataFrame, text: str = "testo") -> DataFrame:
    """One row (num, termine, corpo) for each entry of a list of definitions of three or more; other rows give none.

    Each marker is replaced by sentinels; what stands before the first is dropped.
    """
    marked = F.split(F.regexp_replace(F.col(text), DEFINITION, "\u0001$1\u0002$2\u0003"), "\u0001")
    rows = df.withColumn("__parts", marked).where(F.size("__parts") > DEFINITIONS).withColumn("__part", F.explode(F.slice("__parts", 2, F.size("__parts"))))
    part = F.col("__part")
    out = rows.withColumn("num", F.split_part(part, F.lit("\u0002"), F.lit(1)).cast("int"))
    rest = F.split_part(part, F.lit("\u0002"), F.lit(2))
    out = out.withColumn("termine", F.trim(F.split_part(rest, F.lit("\u0003"), F.lit(1)))).withColumn("corpo", F.btrim(F.split_part(rest, F.lit("\u0003"), F.lit(2)), F.lit(" ;")))
    return out.where("corpo <> ''").drop("__parts", "__part")


def fill_chapters(nodes: DataFrame) -> DataFrame:
    """nodes(doc, ord, kind, title) with capo and sezione, the last chapter and section titles before each node.

    kind: capo opens a chapter and closes the section; sezione opens a section; subtitle extends what is open; others are content.
    """
    order = lambda *by: Window.partitionBy("doc", *by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    titled = kind.isin("capo", "sezione", "subtitle")
    out = nodes.withColumn("__c", F.sum((kind == "capo").cast("int")).over(order())).withColumn("__s", F.sum((kind == "sezione").cast("int")).over(order("__c")))
    # titles alone gather the titles before them; every other row then takes the last label, so the work grows with the rows
    label = F.array_join(F.collect_list(F.when(titled, F.col("title"))).over(order("__c", "__s", "__t")), " — ")
    out = out.withColumn("__t", titled).withColumn("__l", F.when(titled, label))
    last = lambda when, *by: F.nullif(F.last(F.when(when, F.col("__l")), ignorenulls=True).over(order(*by)), F.lit(""))
    out = out.withColumn("capo", F.when(F.col("__c") > 0, last(F.col("__s") == 0, "__c"))).withColumn("sezione", F.when(F.col("__s") > 0, last(F.col("__s") > 0, "__c", "__s")))
    return out.drop("__c", "__s", "__t", "__l")


def fold_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc, par, testo) of blocks(doc, ord, testo): a block "N. text" opens paragraph N, another one continues the open one; blocks before any number are a paragraph without one."""
    run = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = F.col("testo").rlike(r"(?s)^\d+\.\s*.*$")
    rows = blocks.where("testo <> ''").withColumn("__n", numbered).withColumn("__g", F.sum(F.col("__n").cast("int")).over(run))
    body = F.when(F.col("__n"), F.trim(F.regexp_extract("testo", r"(?s)^\d+\.\s*(.*)$", 1))).otherwise(F.col("testo"))
    number = F.when(F.col("__n"), F.regexp_extract("testo", r"^(\d+)\.", 1).cast("int"))
    grouped = rows.select("doc", "ord", "__g", body.alias("body"), number.alias("number")).groupBy("doc", "__g")
    return grouped.agg(F.max("number").alias("par"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), " ").alias("testo")).select("doc", F.col("__g").alias("grp"), "par", "testo")


class _Nodes(HTMLParser):
    """The legal markup as (kind, number, text) in document order."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    NOTES = frozenset(("oj-note-tag", "oj-super"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None, bool]] = []
        self.open: list[dict] = []
        self.out: list[dict] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        at = dict(attrs)
        classes, ident = (at.get("class") or "").split(), at.get("id") or ""
        node = None
        head, _, number = ident.partition("_")
        inside = next((n for n in reversed(self.open) if n["kind"] in ("art", "rct")), None)
        if tag == "div" and head in ("art", "rct") and number.isdigit():
            node = {"kind": head, "number": int(number), "level": len(self.stack)}
        elif tag in ("p", "div") and "oj-ti-section-1" in classes:
            node = {"kind": "title", "number": None}
        elif tag in ("p", "div") and "oj-ti-section-2" in classes:
            node = {"kind": "subtitle", "number": None}
        elif inside and tag == "p" and "oj-sti-art" in classes:
            node = {"kind": "heading", "number": inside["number"]}
        elif inside and inside["kind"] == "art" and tag == "div" and len(self.stack) == inside["level"] + 1:
            node = {"kind": "skip" if "eli-title" in classes else "block", "number": inside["number"]}
        quiet = tag == "sup" or bool(self.NOTES & set(classes))
        self.mute += quiet
        if node:
            node["text"] = []
            self.open.append(node)
            self.out.append(node)
        self.stack.append((tag, node, quiet))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, node, quiet = self.stack.pop()
                self.mute -= quiet
                if node:
                    self.open.remove(node)
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.mute and data.strip():
            for node in self.open:
                node["text"].append(data.strip())


def legal_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, kind, number, text) of pages with legal markup: rct, art, block, heading, title, subtitle, in document order. An HTML parser has no native form, so this runs on the executors in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, html in zip(frame["k"], frame["html"], strict=True):
                parser = _Nodes()
                parser.feed(html or "")
                parser.close()
                rows += [(k, i, n["kind"], n["number"], " ".join(n["text"])) for i, n in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["k", "ord", "kind", "number", "text"]).astype({"number": "Int64"})

    nodes = pages.select(F.col(key).alias("k"), "html").mapInPandas(run, "k long, ord int, kind string, number long, text string")
    return nodes.select(F.col("k").alias(key), "ord", "kind", "number", clean(F.col("text")).alias("text"))


def from_legal_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Passages of pages with legal markup: recitals, article paragraphs, and definitions as passages of their own.

    pos is unique over all pages; id, whose form is fixed, within a page.
    """
    nodes = cut(legal_nodes(pages, key))  # used four times; else each page is parsed as often
    recitals = nodes.where("kind = 'rct'").select(key, F.lit("considerando").alias("tipo"), F.col("number").alias("n"), F.lit(None).cast("int").alias("par"), F.lit("").alias("rubrica"), F.lit("").alias("capo"), F.regexp_replace("text", r"^\(\d+\)\s*", "").alias("testo")).where("testo <> ''")
    upper = F.upper("text")
    titled = nodes.select(F.col(key).alias("doc"), "ord", "number", "text", F.when(F.col("kind") == "subtitle", "subtitle").when((F.col("kind") == "title") & upper.startswith("CAPO"), "capo").when((F.col("kind") == "title") & upper.startswith("SEZIONE"), "sezione").otherwise(F.col("kind")).alias("kind"), F.col("text").alias("title"))
    arts = fill_chapters(titled).where("kind = 'art'").select(F.col("doc").alias(key), F.col("number").alias("n"), F.coalesce("sezione", "capo", F.lit("")).alias("capo"), F.col("text").alias("whole"))
    headings = nodes.where("kind = 'heading'").groupBy(key, F.col("number").alias("n")).agg(F.min_by("text", "ord").alias("rubrica"))
    blocks = nodes.where("kind = 'block' and text <> ''").select(F.struct(key, F.col("number").alias("n")).alias("doc"), "ord", F.col("text").alias("testo"))
    folded = fold_paragraphs(blocks).select(F.col(f"doc.{key}").alias(key), F.col("doc.n").alias("n"), "grp", "par", "testo")
    base = arts.join(headings, [key, "n"], "left").join(folded, [key, "n"], "left").withColumn("rubrica", F.coalesce("rubrica", F.lit("")))
    text = F.regexp_replace(F.coalesce("testo", "whole"), r"^Articolo\s+\d+\s*", "")
    base = base.withColumn("testo", F.when((F.col("rubrica") != "") & F.startswith(text, F.col("rubrica")), F.trim(F.substring(text, F.length("rubrica") + 1, F.length(text)))).otherwise(text)).where(F.length("testo") >= SHORTEST)
    base = cut(base.select(key, F.lit("articolo").alias("tipo"), "n", "par", "rubrica", "capo", "testo"))
    listed = split_definitions(base)
    names = [key, "pos", "id", "tipo", "n", "par", "citazione", "rubrica", "termine", "capo", "testo"]
    at = lambda par, definition: place_on_page(F.col(key), F.col("tipo"), F.col("n"), F.col(par), definition)
    plain = recitals.unionByName(base.where(F.size(F.split(F.regexp_replace("testo", DEFINITION, "\u0001"), "\u0001")) <= DEFINITIONS))
    plain = identify(plain, at("par", False)).withColumn("termine", F.lit(None).cast("string"))
    n = F.col("n").cast("string")
    listed = listed.select(key, at("num", True).alias("pos"), F.concat(F.lit("a"), n, F.lit("d"), F.col("num").cast("string")).alias("id"), "tipo", "n", F.lit(None).cast("int").alias("par"), F.concat(F.lit("Articolo "), n, F.lit(", punto "), F.col("num").cast("string"), F.lit(")")).alias("citazione"), F.concat_ws(" — ", "rubrica", "termine").alias("rubrica"), "termine", "capo", F.col("corpo").alias("testo"))
    return plain.select(*names).unionByName(listed.select(*names))


def corpus_report(passages: DataFrame) -> DataFrame:
    """Counts of passages by type, articles, characters and their whole mean, in one aggregation."""
    n = F.count("*")
    chars = F.coalesce(F.sum(F.length("testo")), F.lit(0))
    return passages.agg(n.alias("passages"), F.count_if(F.col("tipo") == "considerando").alias("recitals"), F.count_if(F.col("tipo") == "articolo").alias("paragraphs"), F.countDistinct(F.when(F.col("tipo") == "articolo", F.col("n"))).alias("articles"), chars.cast("long").alias("chars"), F.floor(chars / F.greatest(n, F.lit(1))).cast("long").alias("mean_chars"))
