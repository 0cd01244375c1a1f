"""SQL statements (DuckDB) of what the queries of this package return, built from shared pieces."""

from __future__ import annotations

from ..functions.lexicon import DEFINITION, DEFINITIONS, STOP_WORDS, SUFFIXES, SYNONYMS

_SFX, _STOP = "|".join(SUFFIXES), ", ".join(f"'{w}'" for w in STOP_WORDS)
_ART = r"\b(?:art|articolo|articoli)\s*(\d{1,3})(?:\s*(?:par|paragrafo|comma)\s*(\d{1,2}))?"
_REC = r"\bconsiderando\s*(\d{1,3})\b"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents(lower({x})), '[''’`]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')"


def stem(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '^(.{{4,}}?)(?:{_SFX})$', '\\1'), '^(.{{3,}})[aeio]$', '\\1')"


def kept(x: str) -> str:
    return f"list_filter(regexp_split_to_array({norm(x)}, ' +'), lambda w: length(w) >= 2 and w not in ({_STOP}))"


def toks(x: str) -> str:
    return f"list_transform({kept(x)}, lambda w: {stem('w')})"


def clean(x: str) -> str:
    return f"trim(replace(regexp_replace(translate(nfc_normalize({x}), '   ’‘“”«»', '   ''''\"\"\"\"'), '[\\s   -     　\u0085\x0b]+', ' ', 'g'), '\" :', '\":'))"


def expand(x: str) -> str:
    rules = ", ".join(f"case when regexp_matches(b, '\\b(?:{'|'.join(w)})\\b') then '{m}' end" for w, m in SYNONYMS)
    return f"(select concat_ws(' ', b, {rules}) from (select {norm(x)} b))"


PASSAGES = """passages as materialized (
  select case when tipo = 'considerando' then 0 else 1152921504606846976 end + n * 1048576 + coalesce(par, 0) pos,
    case when tipo = 'considerando' then 'c' else 'a' end || n || case when par > 0 then 'p' || par else '' end id, tipo, n, par,
    case when tipo = 'considerando' then 'Considerando ' else 'Articolo ' end || n || case when par > 0 then ', paragrafo ' || par else '' end citazione,
    rubrica, null::varchar termine, '' capo, testo
  from (select doc_id n, tipo, case when len(l) = 1 then null else i - 1 end::int par, case when len(l) = 1 or tipo = 'considerando' then '' else l[1] end rubrica, l[i] testo, len(l) = 1 one, i
    from (select doc_id, case when source in ('src0','src1','src2','src3','src4','src5') then 'considerando' else 'articolo' end tipo, string_split(text, chr(10)) l from documents), unnest(range(1, len(l) + 1)) u(i))
  where (one or i > 1 or tipo = 'considerando') and length(testo) >= 12)"""
#: Whole benchmark texts; beside them their first words as short questions; and references.
QUESTIONS = """questions as materialized (
  select item_id qid, text d from benchmark
  union all select 1000000 + item_id, 'art. ' || item_id || ', comma 1' from benchmark
  union all select 2000000 + item_id, 'considerando ' || item_id from benchmark
  union all select 3000000 + item_id, array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:8], ' ') from benchmark)"""
ITALIAN = (
    "entro quando devo segnalare una violazione al garante",
    "c'e' stato un data breach: chi devo avvisare?",
    "il dpo può ricevere ordini?",
    "cosa scrivere nell'informativa per i clienti",
    "diritto all'oblio e cancellazione, art. 17",
    "quando serve una valutazione d'impatto",
    "posso mandare i dati negli Stati Uniti",
    "Articolo 33, paragrafo 1",
    "art 1234",
    "considerando 39",
    "considerando 1234",
    "qual è la sanzione massima",
    "risarcimento del danno: articoli 82 e 83 comma 2",
    "un ragazzo può dare il consenso da solo",
)
ITALIAN_SQL = "italian(qid, d) as (values " + ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(ITALIAN)) + ")"
def indexed(stemmed: bool = True) -> str:
    f = toks if stemmed else kept
    return f"""tok as materialized (select pos, tipo, {f('testo')} b, {f('rubrica')} r from passages),
lens as materialized (select pos, len(b)::int len_body, len(r)::int len_rub from tok),
stats as materialized (select count(*) n, avg(len_body) avg_body, avg(len_rub) filter (len_rub > 0) avg_rub from lens),
postings as materialized (
  select 'body' field, term, pos, count(*) tf, len, tipo from (select pos, tipo, len(b)::int len, unnest(b) term from tok) group by term, pos, len, tipo
  union all select 'rubrica', term, pos, count(*), len, tipo from (select pos, tipo, len(r)::int len, unnest(r) term from tok) group by term, pos, len, tipo)"""


POSTINGS = indexed()


def terms(source: str = "questions", synonyms: bool = True, stemmed: bool = True) -> str:
    text = expand("d") if synonyms else "d"
    return f"""terms as materialized (select qid, term, min(o) ord from (select qid, unnest(t) term, unnest(range(len(t))) o from (select qid, {(toks if stemmed else kept)('e')} t from (select qid, {text} e from {source}))) group by qid, term)"""


def scores(floor: int = 25, recital: float = 0.55, coverage: float = 0.0, heading: float = 2.2, fields: str = "true") -> str:
    cov = f"* pow(found::double / greatest(asked, 1), {coverage})" if coverage else ""
    return f"""df as materialized (select field, term, count(*) df from postings semi join terms using (term) group by field, term),
contrib as materialized (
  select qid, pos, tipo, p.field, ord, case when p.field = 'body' then 1.0::double else {heading}::double end * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
    / (tf + 1.2::double * (0.25::double + 0.75::double * greatest(len, case when p.field = 'body' then {floor} else 0 end) / case when p.field = 'body' then avg_body else avg_rub end)) c
  from terms t join postings p using (term) join df on df.field = p.field and df.term = p.term cross join stats where {fields}),
asked as (select qid, count(*) asked from terms group by qid),
scored as materialized (
  select qid, pos, s {cov} * case when tipo = 'considerando' then {recital} else 1 end score, first from (
    select qid, pos, tipo, sum(c) s, count(*) filter (field = 'body') found, min(case when field = 'body' then 0 else 1000 end + ord) first from contrib group by qid, pos, tipo) join asked using (qid))"""


REFS = f"""refs as (
  select qid, case when regexp_matches(b, '{_ART}') then 'articolo' when regexp_matches(b, '{_REC}') then 'considerando' end tipo,
    case when regexp_matches(b, '{_ART}') then nullif(regexp_extract(b, '{_ART}', 1), '')::int when regexp_matches(b, '{_REC}') then nullif(regexp_extract(b, '{_REC}', 1), '')::int end n,
    case when regexp_matches(b, '{_ART}') then nullif(regexp_extract(b, '{_ART}', 2), '')::int end par
  from (select qid, {norm('d')} b from questions))"""
EXACT = REFS + """,
exact as materialized (select r.qid, p.pos from refs r join passages p on p.tipo = r.tipo and p.n = r.n and (r.par is null or p.par = r.par))"""


def ranked(limit: int = 8, exact: bool = True) -> str:
    merged = "select qid, pos, true esatto, 0 s, 0 first, null score from exact union all select qid, pos, false, round(score, 9), first, round(score, 6) from scored anti join exact using (qid, pos)" if exact else "select qid, pos, false esatto, round(score, 9) s, first, round(score, 6) score from scored"
    return f"top as materialized (select * from (select qid, pos, esatto, score punteggio, row_number() over (partition by qid order by esatto desc, s desc, first, pos) rank from ({merged})) where rank <= {limit})"


#: Both questions of a benchmark text expect the passages that contain it (exact) and the documents that do (article); judged is each question with such a target.
QRELS = "qrels as materialized (select k.a + b.item_id qid, p.id from benchmark b join passages p on contains(p.testo, b.text) cross join (values (0), (3000000)) k(a))"
ARTICLE_TARGETS = "article_targets as materialized (select k.a + b.item_id qid, case when d.source in ('src0','src1','src2','src3','src4','src5') then 'considerando' else 'articolo' end tipo, d.doc_id n from benchmark b join documents d on contains(d.text, b.text) cross join (values (0), (3000000)) k(a))"
JUDGED = "judged as materialized (select * from questions where qid in (select qid from qrels union select qid from article_targets))"
METRICS = """named as (select t.qid, t.rank, p.id, p.tipo, p.n from top t join passages p using (pos)),
hit_e as (select qid, min(rank) r from named semi join qrels using (qid, id) group by qid),
hit_a as (select qid, min(rank) r from named semi join article_targets using (qid, tipo, n) group by qid),
targets as materialized (
  select qid, 'esatto' target, r from (select distinct qid from qrels) left join hit_e using (qid)
  union all select qid, 'articolo', r from (select distinct qid from article_targets) left join hit_a using (qid)),
metrics as (select target, count(*) n, round(avg((r is not null and r = 1)::int), 6) p1, round(avg((r is not null and r <= 3)::int), 6) p3, round(avg(coalesce(1.0::double / r, 0)), 6) mrr from targets group by target)"""
#: Lists of definitions over all lines: a document's lines go in even lists of 99 at most, so that every marker has two digits.
DEFINED = """kept as (select doc_id, list(i order by i) ix, list(x order by i) xs from (select doc_id, unnest(range(1, len(l) + 1)) i, unnest(l) x from (select doc_id, list_transform(string_split(text, chr(10)), lambda x: replace(x, '"', '')) l from documents)) where length(x) >= 2 group by doc_id),
defined as (select doc_id, ix[a + 1:b] ix, array_to_string(list_transform(xs[a + 1:b], lambda x, i: i || ') "' || substr(x, 1, 30) || '": ' || x || '; '), '') t
  from (select doc_id, ix, xs, k * len(ix) // g a, (k + 1) * len(ix) // g b from (select *, (len(ix) + 98) // 99 g from kept), unnest(range(g)) u(k)))"""
MARKED = "string_split(regexp_replace(t, '" + DEFINITION.replace("'", "''") + "', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1))"
DEFINITION_ROWS = f"""select doc_id, ix[split_part(p, chr(2), 1)::int]::int num, trim(split_part(split_part(p, chr(2), 2), chr(3), 1)) termine, trim(split_part(split_part(p, chr(2), 2), chr(3), 2), ' ;') corpo
from (select doc_id, ix, unnest(m[2:]) p from (select doc_id, ix, {MARKED} m from defined) where len(m) > {DEFINITIONS}) where trim(split_part(split_part(p, chr(2), 2), chr(3), 2), ' ;') <> ''"""
NODES = "nodes as (select doc_id doc, i ord, case length(l[i]) % 7 when 0 then 'capo' when 1 then 'sezione' when 2 then 'subtitle' else 'art' end kind, l[i] title from (select doc_id, string_split(text, chr(10)) l from documents), unnest(range(1, len(l) + 1)) u(i))"


def sql(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


#: Texts of users' turns beside the questions.
SAID = "said as (select 4000000000 + conv_id * 100000 + turn qid, text d from conversations where role = 'user')"
