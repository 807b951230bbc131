"""Word lists and constants that results depend on."""

from __future__ import annotations

#: Words that say nothing about a question's subject, Dutch and English.
STOPWORDS = frozenset(
    """
    de het een en of maar want dus als dan dat die dit deze zulke zo er daar hier ik je jij u we wij ze zij hij hem haar
    me mij mijn ons onze jouw uw hun is was waren ben bent zijn wordt worden werd heb hebt heeft had hadden kan kon
    kunnen zou zal zullen moet moeten mag mocht wil wilde in op aan bij met van voor naar over onder tussen tot uit door
    om te ook nog al eens even weer niet geen wel toch gewoon iets iemand ergens niets alle elke ieder sommige wat wie
    waar wanneer welke hoe welk
    the a an and or but of to for with about from into at on in by as that this these those it its is was were be been
    am are do does did have has had my your his her our their me you we they he she some any please find search show
    """.split()
)

#: Words that mean the same; the first word of a line finds the others. A comma ends a phrase.
SYNONYM_LINES = """
aanbesteding: tender, tendering, offerteaanvraag, inschrijving, gunning, bestek, tenderprocedure
tender: aanbesteding, offerteaanvraag, inschrijving, gunning
offerte: quotation, quote, prijsopgave, aanbieding, tender
factuur: rekening, nota, invoice, billing, facturatie
rekening: factuur, nota, invoice, bankafschrift
nota: factuur, rekening, invoice
betaling: payment, incasso, overschrijving, betaalopdracht, afschrijving, transactie
incasso: betaling, afschrijving, automatische incasso
overschrijving: betaling, overboeking, transactie, transfer
bankafschrift: rekening, transactie, afschrift, betaling
belasting: tax, aangifte, btw, voorlopige aanslag
aangifte: belasting, belastingaangifte, btw, tax
verzekering: insurance, polis, premie, dekking
polis: verzekering, premie, insurance
salaris: loon, loonstrook, salary, uitbetaling
loonstrook: salaris, loon, payslip, uitbetaling
vergadering: overleg, meeting, bijeenkomst, bespreking, vergaderstukken, notulen
overleg: vergadering, meeting, bespreking, afstemming
meeting: vergadering, overleg, bespreking
notulen: verslag, minutes, vergadering, bespreking
verslag: rapport, report, notulen, samenvatting, verantwoording
rapport: verslag, report, onderzoek, eindrapport
afspraak: appointment, agenda, kalender, agendapunt, afspreken
agenda: afspraak, kalender, schedule, planning, agenderen
planning: agenda, plan, schedule, rooster, tijdschema
project: projectplan, traject, programma, opdracht
opdracht: assignment, klus, project, taak, briefing
klant: client, opdrachtgever, relatie, klanten
sollicitatie: solliciteren, vacature, application, cv, sollicitatiebrief
vacature: sollicitatie, functie, job, opening, werving
contract: overeenkomst, agreement, getekend, verbintenis
overeenkomst: contract, agreement, afspraak
document: bestand, file, stuk, papier, documentatie
brief: letter, mail, schrijven, begeleidend schrijven
handleiding: manual, instructie, gebruiksaanwijzing, gids
instructie: handleiding, uitleg, procedure, instructies
formulier: form, formulieren, aanvraagformulier, invulformulier
aanvraag: request, verzoek, application, formulier, indienen
verzoek: aanvraag, request, vraag, oproep
beslissing: besluit, decision, goedkeuring, akkoord
goedkeuring: akkoord, approval, toestemming, beslissing
storing: error, fout, probleem, incident, defect
fout: error, storing, probleem, bug, failure
wachtwoord: password, inloggen, login, credentials, aanmelden
inloggen: login, wachtwoord, aanmelden, signin, account
update: wijziging, release, nieuwe versie, patch, vernieuwing
backup: reservekopie, kopie, archief, herstelpunt
computer: pc, laptop, werkstation, systeem, machine
reis: trip, vakantie, booking, reisbescheiden, itinerary
vlucht: flight, boarding, vliegticket, luchtvaart
trein: ns, rail, spoor, ov, treinticket
hotel: overnachting, booking, accommodatie, verblijf
woning: huis, pand, koopwoning, woningmarkt, adres
adres: address, locatie, straat, postcode, woonplaats
"""

#: Plurals that shorten a vowel, and what they share a stem with.
IRREGULAR_STEMS = {
    "factuur": "factuur", "facturen": "factuur", "jaar": "jaar", "jaren": "jaar", "uur": "uur", "uren": "uur",
    "boom": "boom", "bomen": "boom", "maan": "maan", "manen": "maan", "schaar": "schaar", "scharen": "schaar",
}

#: Words that name the kind of result asked for.
KIND_LINES = """
mail: mailtje mail mailtjes e-mail email e-mails emails mailbericht bericht berichten inbox postvak outlook thunderbird verzonden ontvangen e-mailtje reply forward
image: screenshot screenshots schermafdruk schermopname printscreen foto foto's fotos afbeelding afbeeldingen plaatje plaatjes image images picture pictures png jpg jpeg gif bmp webp scan ingescand
browser: website websites site sites webpagina webpage link links browser browsen bezocht bezochte url urls bookmark favoriet favorieten chrome edge firefox internet online gedownload download
file: pdf document documenten bestand bestanden file files word docx excel xlsx powerpoint pptx presentatie spreadsheet tekstdocument notitie notities rapport verslag brief map mapje folder
"""

#: Months and weekdays, Dutch and English.
MONTHS_NL = "januari februari maart april mei juni juli augustus september oktober november december".split()
MONTHS_EN = "january february march april may june july august september october november december".split()
MONTH_SHORT = {"mrt": 3, "sept": 9, "oct": 10}
WEEKDAYS_NL = "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag".split()
WEEKDAYS_EN = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBER_WORDS = {"een": 1, "twee": 2, "drie": 3, "vier": 4, "vijf": 5, "zes": 6, "zeven": 7, "acht": 8, "negen": 9, "tien": 10, "dertig": 30}

#: How a day is named by its distance from today, and how it is called in an explanation.
DAY_WORDS = {
    0: (["vandaag", "vandaag de dag", "vanochtend", "vanmorgen", "vanmiddag", "vanavond", "vannacht"], "today"),
    -1: (["gisteren", "gisteravond", "net"], "yesterday"),
    -2: (["eergisteren"], "the day before yesterday"),
    1: (["morgen"], "tomorrow"),
}
#: For each unit of time its singular (if that can follow a word for the latest one), its plural, the words for the
#: latest one, and the numbers that it is counted with.
TIME_UNITS = {
    "day": ("", "dagen", "afgelopen vorige laatste", "een 1 twee 2 drie 3 vier 4 vijf 5 zes 6 zeven 7 tien 10 14 30 dertig"),
    "week": ("week", "weken", "afgelopen vorige verleden deze", "een 1 twee 2 drie 3 vier 4"),
    "month": ("maand", "maanden", "afgelopen vorige verleden deze", "een 1 twee 2 drie 3 vier 4 vijf 5 zes 6"),
    "year": ("jaar", "jaar", "afgelopen vorige verleden deze dit", "een 1 twee 2 drie 3 vier 5"),
}
AGO = "geleden terug"
LATEST_WEEKDAY = "afgelopen vorige verleden deze"
#: Prepositions that a bare month or year needs before it, and those that go with a time expression.
TIME_PREPOSITIONS = "in van uit rond omstreeks tijdens gedurende"
LOOSE_PREPOSITIONS = TIME_PREPOSITIONS + " op over betreffende aangaande omtrent"

#: File extensions by kind, junk files, and folders that are never opened.
EXTENSIONS = {
    "tekst": ".txt .md .markdown .csv .tsv .log .json .xml .py .ini .cfg .conf .htm .html .xhtml .css .js .yml .yaml .rst .srt .vtt .sql".split(),
    "office": ".docx .xlsx .pptx".split(),
    "mail": ".eml .mbox .mbx".split(),
    "image": ".png .jpg .jpeg .bmp .gif .tif .tiff .webp".split(),
    "pdf": [".pdf"],
    "muziek": ".mp3 .wav .flac .m4a .ogg .wma .aac .aiff .aif .opus".split(),
}
SKIPPED_NAMES = "desktop.ini thumbs.db ehthumbs.db .ds_store iconcache.db".split()
SKIPPED_FOLDERS = frozenset(
    (
        "__pycache__ .git .svn node_modules .mypy_cache .pytest_cache .ruff_cache .tox .gradle .m2 .nuget .npm .cache .thumbnails "
        ".idea .vscode venv .venv site-packages dist build obj target temp tmp cache caches cache2 crashpad logs onedrivetemp "
        "softwaredistribution packages windows winsxs system32 syswow64 servicing assembly driverstore catroot prefetch winsat "
        "installer $windows.~bt $windows.~ws windows.old config.msi $sysreset recovery perflogs msocache programdata "
        "$recycle.bin appdata"
    ).split()
    + ["program files", "program files (x86)", "system volume information", "documents and settings", "all users", "default user"]
)

#: Limits and weights.
MAX_TEXT = 400_000
MAX_FILE_SIZE = 25 * 1024 * 1024
FIELD_CHARS = 16_000
CHUNK_MIN, CHUNK_MAX = 400, 900
WEIGHTS = {"text": 1.0, "title": 3.0, "extra": 1.5, "words": 1.0}
TITLE_BOOST, RECENT_BOOST, URL_BOOST = 0.35, 0.15, 0.4
ERROR_FACTOR, UNDATED_FACTOR = 0.9, 0.7
BM25_K1, BM25_B = 1.2, 0.75
CANDIDATES, RESULTS, FRAGMENTS, SNIPPET = 400, 40, 40, 240
FUZZY_CUTOFF, FUZZY_MATCHES, FUZZY_LENGTH = 0.84, 2, 4


def synonyms() -> dict[str, list[str]]:
    pairs = (line.split(":") for line in SYNONYM_LINES.strip().splitlines())
    return {word: [w.strip() for w in others.split(",")] for word, others in pairs}


def kind_words() -> dict[str, str]:
    pairs = (line.split(":") for line in KIND_LINES.strip().splitlines())
    found: dict[str, str] = {}
    for kind, words in pairs:
        for w in words.split():
            found.setdefault(w, kind)
    return found


def months() -> dict[str, int]:
    found = {name: i % 12 + 1 for i, name in enumerate(MONTHS_NL + MONTHS_EN)}
    for i, (nl, en) in enumerate(zip(MONTHS_NL, MONTHS_EN, strict=True), 1):
        for name in (nl, en):
            found.setdefault(name[:3], i)
    return found | MONTH_SHORT
