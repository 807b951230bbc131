import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero.functions import dates, language, text
from quaero.plans.question import understand

NOW = dt.datetime(2026, 9, 28, 12)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("words", "want"), [("De Aanbesteding, fietsbrug 2026!", ["de", "aanbesteding", "fietsbrug", "2026"]), ("Curaçao — één", ["curacao", "een"])])
def test_tokens(spark, words, want):
    assert one(spark, language.tokenise(F.col("t")), t=words) == want


def test_stems_agree_in_every_form(spark):
    words = "facturen vergadering kas mei bus ns mogelijkheden vergaderingen lopende invoices tokens token class status basis jaren heden ending ing 2026 it's ab12en lopenden".split()
    want = {"facturen": "factuur", "vergadering": "vergader", "kas": "kas", "mei": "mei", "bus": "bus", "ns": "ns", "mogelijkheden": "mogelijkheid", "tokens": "token", "token": "tok"}
    rows = spark.createDataFrame([(w,) for w in words], ["w"]).select("w", language.stem(F.col("w")).alias("s"), language.stems(F.array("w"))[0].alias("a")).collect()
    for r in rows:
        assert r.s == r.a == language.stem_word(r.w), r
        if r.w in want:
            assert r.s == want[r.w]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abdeghinrsu", min_size=0, max_size=9))
def test_stem_of_a_word_is_a_beginning_or_heid(word):
    s = language.stem_word(word)
    assert word.startswith(s) or s.endswith("heid") or word in ("facturen", "jaren", "uren", "bomen", "manen", "scharen")


def test_synonyms_and_stopwords(spark):
    assert {"factuur", "nota"} <= set(language.variants_of("rekening"))
    assert "factuur" in language.variants_of("rekeningen")
    assert one(spark, language.remove_stopwords(F.array(*map(F.lit, "dat mailtje over aanbesteding".split()))), a=1) == ["mailtje", "aanbesteding"]
    assert one(spark, language.remove_stopwords(F.array(*map(F.lit, ["de", "x"]))), a=1) == ["de"]
    words = ["rekening", "facturen", "tender"]
    assert one(spark, language.keywords(F.array(*map(F.lit, words))), a=1) == language.keywords_of(words)


def test_exact_folding_in_python(spark):
    assert one(spark, language.normalise_exact(F.col("t")), t="ﬁets ½ Één’s") == "fiets 1⁄2 een's"


@pytest.mark.parametrize(
    ("question", "first", "last", "label"),
    [
        ("aanbesteding in maart", "2026-03-01", "2026-03-31", "March 2026"), ("aanbesteding maart 2025", "2025-03-01", "2025-03-31", "March 2025"),
        ("verslag 2026-03-11", "2026-03-11", "2026-03-11", "11-03-2026"), ("wat ik gisteren zag", "2026-09-27", "2026-09-27", "yesterday"),
        ("iets van deze maand", "2026-08-01", "2026-08-31", "August 2026"), ("mail in oktober", "2027-10-01", "2027-10-31", "October 2027"),
        ("foto 2 weken geleden", "2026-09-15", "2026-09-28", "last 2 weeks"), ("3 dagen geleden", "2026-09-26", "2026-09-28", "last 3 days"),
        ("vorige donderdag", "2026-09-24", "2026-09-24", "last Thursday"), ("11 maart", "2026-03-11", "2026-03-11", "11-03-2026"), ("dit jaar", "2025-01-01", "2025-12-31", "2025"),
    ],
)
def test_periods(question, first, last, label):
    p = dates.parse_time(question, NOW).period
    assert (str(p.first), str(p.last), p.describe()) == (first, last, label)
    assert p.end.time() == dt.time(23, 59, 59)


@pytest.mark.parametrize("question", ["handleiding koffiemachine", "maart", "14 dagen termijn", "31-02-2026", ""])
def test_no_period(question):
    assert dates.parse_time(question, NOW).period is None


def test_question():
    q = understand("dat mailtje over die aanbesteding in maart", NOW)
    assert (q.kind, q.period.label, q.terms) == ("mail", "March 2026", ["aanbesteding"])
    assert "tender" in q.search_words and q.explain().startswith("searching for: aanbesteding")
    q = understand("screenshot van de factuur", NOW)
    assert q.kind == "image" and "factuur" in q.terms
    assert understand("mail van gisteren", NOW).search_words == []


def test_browser_clocks(spark):
    assert one(spark, dates.chrome_time(F.col("v")).cast("string"), v=13_350_000_000_000_000) == "2024-01-17 21:20:00"
    assert one(spark, dates.firefox_time(F.col("v")), v=0) is None


def test_chunks():
    assert text.pieces("") == [] and text.pieces("kort") == ["kort"]
    long = "Een zin met woorden. " * 200
    parts = text.pieces(long)
    assert all(0 < len(p) <= 900 for p in parts) and "".join(parts).replace(" ", "").replace(".", "") == long.replace(" ", "").replace(".", "")


def test_html_and_titles(spark):
    page = "<html><title>Kop &amp; staart</title><style>x{}</style><h1>Eén</h1><p>a <b>b</b></p><script>no()</script>c</html>"
    assert one(spark, text.strip_html(F.col("t")), t=page) == "Kop & staart Eén\na b\nc"
    assert one(spark, text.title_of(F.col("t"), F.lit("stam")), t="ab\n{x: 1}\n## Een kop ##\n") == "Een kop ##"
    artist, title = text.artist_and_title(F.col("t"))
    name = "10. Mr. Probz - Gold Days (ft Action Bronson).mp3"
    assert (one(spark, artist, t=name), one(spark, title, t=name)) == ("Mr. Probz", "Gold Days")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abdeghinrsu1'é ", min_size=0, max_size=12))
def test_stem_by_endings_is_the_stem_by_passes(word):
    line = f" {language.IRREGULAR_STEMS.get(word, word)} "
    for pattern, left in language.STEM_PASSES:
        line = language.re.sub(pattern, left.replace("$", "\\"), line)
    assert language.normal_stem(word).strip() == line.strip().replace("=", "")


def test_keywords_of_whole_texts(spark):
    texts = ["De facturen van de rekening, en de rekeningen", "", None, "vergaderingen notulen ÉÉN it's"] * 100
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for r in rows.select("t", language.text_keywords(F.col("t")).alias("k")).collect():
        assert r.k == language.keywords_of(language._WORD.findall(language.normal_text(r.t)))


def test_chunks_of_a_batch_go_a_few_texts_at_a_time(spark):
    texts = [("woord " * (i % 400)).strip() for i in range(3 * text.ASIDE + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert {r.i: r.c for r in rows.select("i", text.chunks(F.col("t")).alias("c")).collect()} == {i: text.pieces(t) for i, t in enumerate(texts)}
