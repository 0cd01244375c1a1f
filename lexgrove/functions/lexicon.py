"""Word lists and rules of Italian legal retrieval.

The stop words, suffixes and synonym rules are fixed values: results depend on them being exactly these.  They come from an
MIT-licensed public project for the same task; negations and exceptions (non, salvo, senza) are deliberately no stop words.
"""

# Stop words, compared after normalisation and before stemming.
STOP_WORDS = tuple(
    """
a ad agli ai al alla alle allo anche c che chi ci co coi col come con cui
da dagli dai dal dalla dalle dallo degli dei del della delle dello di
e ed egli gli ha hanno ho i il in io la le lei li lo loro lui ma me mi
nei nel nella nelle nello noi o per piu questa queste questi questo qui
si sia sono su sugli sui sul sulla sulle sullo ti tra tu tuo un una uno
vi voi essere stato stati essendo avere avuto quale quali quanto quando
ove ovvero nonche altresi cio esso essa essi esse tale tali
""".split()
)

# Suffixes in the order in which they are tried; at most one is dropped, and four characters stay.
SUFFIXES = tuple(
    """
amento amenti imento imenti azione azioni zione zioni sione sioni mente abile abili ibile ibili
ante anti ente enti ismo ismi ista isti ato ati ata ate uto uti uta ute oso osi osa ose ivo ivi iva ive
ale ali are ere ire ita ite
""".split()
)

# Fixed values: (words or phrases that trigger it in a normalised question, what is appended to the question).
SYNONYMS = (
    (("garante", "autorita garante"), "autorita di controllo"),
    (("data breach", "databreach", "fuga di dati"), "violazione dei dati personali"),
    (("dpo", "data protection officer"), "responsabile della protezione dei dati"),
    (("privacy",), "protezione dei dati personali"),
    (("informativa",), "informazioni da fornire all interessato"),
    (("cliente", "clienti", "utente", "utenti", "dipendente", "dipendenti"), "interessato persona fisica"),
    (("azienda", "impresa", "societa", "ditta"), "titolare del trattamento impresa"),
    (("fornitore", "fornitori"), "responsabile del trattamento"),
    (("algoritmo", "automatico", "automatizzato"), "processo decisionale automatizzato profilazione"),
    (("cancellare", "cancellazione", "oblio"), "diritto alla cancellazione"),
    (("valutazione d impatto", "dpia", "via"), "valutazione impatto sulla protezione dei dati"),
    (("sanzione", "sanzioni", "multa", "multe"), "sanzioni amministrative pecuniarie"),
    (("registro",), "registri delle attivita di trattamento"),
    (("extra ue", "estero", "stati uniti", "usa", "paese terzo"), "trasferimento paese terzo"),
    (("salute", "medico", "medici", "sanitari"), "categorie particolari dati relativi alla salute"),
    (("minore", "minori", "ragazzo", "bambino", "bambini"), "minore eta consenso servizi societa informazione"),
    (("sicurezza",), "sicurezza del trattamento misure tecniche organizzative"),
    (("reclamo", "denuncia"), "proporre reclamo autorita di controllo"),
    (("risarcimento", "danno", "danni"), "diritto al risarcimento responsabilita"),
    (("consenso",), "condizioni per il consenso"),
)

# Explicit references in a normalised question.
ARTICLE = r"\b(?:art|articolo|articoli)\s*(\d{1,3})(?:\s*(?:par|paragrafo|comma)\s*(\d{1,2}))?"
RECITAL = r"\bconsiderando\s*(\d{1,3})\b"

# A numbered definition in a cleaned text, and how many make a list.
DEFINITION = r'(\d{1,2})\)\s*"([^"]{2,80})"\s*:?\s*'
DEFINITIONS = 3
