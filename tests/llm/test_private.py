"""Personal information and languages."""

import random

import pytest
from pyspark.sql import functions as F

from stenoflow.llm import language, personal

KNOWN = frozenset({"olga", "brunoret", "gruvanici", "peltalschi", "helen"})


class Everything:
    """The known names, and every value."""

    def __contains__(self, term):
        return "|" in term or term in KNOWN


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Trimiteți la olga.brunoret@spital.example azi", ["email"]), ("olga punct brunoret arond posta punct example", ["email"]), ("a.b [at] mail.test", ["email"]), ("radu точка orvoret собака mail точка test", ["email"]), ("ion.x @ mail.test", ["email"]),
        ("Sunați la +373 59 429 823 sau (059) 402 315", ["phone", "phone"]), ("тел. 059-84-58-89", ["phone"]), ("059.400.717", ["phone"]), ("0037359801020", ["phone"]), ("(555) 010-0186", ["phone"]), ("zero cinci nouă, ăm, opt nouă patru, trei unu trei", ["phone"]), ("ноль пять девять, два семь один, один два семь", ["phone"]),
        ("IDNP 7466564699464", ["idnum"]), ("7 632 429 456 853", ["idnum"]), ("489-00-4856", ["idnum"]), ("QX 4109109 și QX8798605", ["idnum", "idnum"]), ("000-480-474 06", ["idnum"]), ("7508-9438-28745", ["idnum"]),
        ("str. Lunca Mare, nr. 32", ["address"]), ("bulevardul Fântânii 72/9, scara 1", ["address"]), ("ул. Старый Мост 36-28", ["address"]), ("улица Вишнёвая, дом 76, квартира 52", ["address"]), ("He lives at 51 Mill Bridge Street, flat 69 now", ["address"]), ("locuiește pe Cireșilor 20, ap. 68", ["address"]), ("lunca mare numărul 44 apartamentul 1", ["address"]),
        ("doamna OLGA Gruvanici a venit", ["name"]), ("Груваники Т. М. пришла", ["name"]), ("ПЕЛТАЛСКХИ", ["name"]), ("o​lga", ["name"]),
        ("codul de bare este 4843280169684", []), ("Lotul 88232091", []), ("Счёт 55470491 по договору 5305090410", []), ("factura 62600288 din contractul 0440131484 până la 24.11.2025", []), ("tensiunea 120/80 la patul 7, salonul 12, etajul 3", []), ("Sindromul Velmar", []), ("", []),
    ],
)
def test_kinds(text, kinds):
    clean, found = personal.redact(text, Everything())
    assert found == kinds
    assert sum(clean.count(p) for p in personal.PLACEHOLDER.values()) == len(kinds)


def test_nothing_else_changes():
    text = "Ăă, Сonsult cu doamna Olga Brunoreț, tel. ０59-84-58-89;  și a​tât №5"
    clean, _ = personal.redact(text, Everything())
    assert clean == "Ăă, Сonsult cu doamna [NAME], tel. [PHONE];  și a​tât №5"


def test_corpus_names(spark):
    rng = random.Random(2)
    people = spark.createDataFrame([("Olga Brunoreț",), ("dr. Ion Peltilă",), (None,), ("",)], "name string")
    said = [f"A venit {rng.choice(['Helen', 'Olga'])} {rng.choice(['Brunoreț', 'Peltilă'])} la consult, și scorul Torvik este mare." for _ in range(40)] + ["Trecem pe Zemozan pentru că este bun."] * 20 + [None, ""]
    texts = spark.createDataFrame([(s,) for s in said], "text string")
    got = {r["term"] for r in personal.names(texts, people).collect()}
    assert got == {"olga", "brunoret", "ion", "peltila", "helen"}
    rows = texts.select(F.monotonically_increasing_id().cast("string").alias("rec_key"), "text")
    known = personal.names(texts, people)
    assert {r["kind"] for r in personal.found_kinds(rows, known).collect()} == {"name"}
    done = personal.redacted(rows, known)
    assert done.where("text like '%Helen%' and clean_text like '%Helen%'").count() == 0
    assert done.where("text is null and clean_text is null").count() == 1 and done.count() == rows.count()
    assert personal.found_kinds(rows.limit(0), known).collect() == []


def test_any_number_of_names(spark, monkeypatch):
    """Names far beyond what the filter can tell apart give the rows that few names in a wide filter give."""
    words = spark.range(20_000).select(F.concat(F.lit("zx"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("term"))
    known = words.unionByName(spark.createDataFrame([("olga",), ("zoltan",)], "term string"))
    rows = spark.createDataFrame([("1", "Olga olga@a.test"), ("2", "ZOLTAN vine"), ("3", "nimeni"), ("4", None), ("5", "olga@zoltan.test"), ("6", "Zxbc și ОLGA"), ("7", "")], "rec_key string, text string")
    want = [("1", "email"), ("1", "name"), ("2", "name"), ("5", "email"), ("6", "name")]
    for most in (12, 26):
        monkeypatch.setattr(personal.bits, "MOST_BITS", most)
        assert sorted(map(tuple, personal.found_kinds(rows, known).collect())) == want
        clean = {r["rec_key"]: r["clean_text"] for r in personal.redacted(rows, known).collect()}
        assert clean == {"1": "[NAME] [EMAIL]", "2": "[NAME] vine", "3": "nimeni", "4": None, "5": "[EMAIL]", "6": "[NAME] și [NAME]", "7": ""}


def test_partitions_do_not_matter(spark):
    """Spellings of one word count together, wherever their texts lie."""
    said = ["doamna Zоltin vine", "Zoltin a plecat"] * 10 + ["domnul Zoltin, azi", "nici o sondă"] * 5 + ["doamna Brel"] * 3
    people = spark.createDataFrame([("Olga Brunoreț",)], "name string")
    got = []
    for n in (1, 20):
        texts = spark.createDataFrame([(s,) for s in said], "text string").repartition(n)
        got.append(sorted(map(tuple, personal.disclosing_terms(texts, personal.seed_names(people)).collect())))
    assert got[0] == got[1] and [(r[0], r[1], r[2]) for r in got[0]] == [("brel", 3, 3), ("zoltin", 25, 15)]


def test_values_that_everybody_shares(spark):
    rows = [(str(i), f"m{i % 20}", "Sunați la +373 59 429 823") for i in range(40)] + [("x", "m1", "Sunați la +373 59 111 222")]
    df = spark.createDataFrame(rows, "rec_key string, entity string, text string")
    none = spark.createDataFrame([], "term string")
    assert sorted(map(tuple, personal.found_kinds(df, none).collect())) == [("x", "phone")]
    assert {r["clean_text"] for r in personal.redacted(df, none).collect()} == {"Sunați la +373 59 429 823", "Sunați la [PHONE]"}
    few = df.where("entity in ('m1', 'm2')")
    assert personal.found_kinds(few, none).count() == few.count(), "too few entities to call a value common"


SAID = {
    "ro": ["Pacientul de la patul opt respiră mai bine după ce am schimbat sonda", "Dacă potasiul nu se corectează, îl mutăm la chirurgie fără discuții", "Graficul pentru luni nu este încă semnat de medicul de gardă", "Familia întreabă în fiecare zi și cineva trebuie să le explice"],
    "ru": ["Больной на койке дышит лучше после того, как поменяли зонд", "Если функция почек не изменится, переводим его в другое отделение", "График на пятницу ещё не подписал никто, даже главный врач", "Родственники спрашивают каждый день, и кто-то должен объяснить"],
    "en": ["The patient in the bed breathes better after we replaced the probe", "If the lactate does not improve, we move him without discussion", "The schedule for Monday is still not signed by the head nurse", "The family asks every day and someone should explain it to them"],
    "fr": ["Le lit près de la fenêtre sera libre demain, on pourra le transférer", "Il manque du personnel dans le service, donc le rapport sera reporté", "Merci de préparer le planning et de l'envoyer avant vendredi"],
    "de": ["Das Bett am Fenster wird morgen frei, dann verlegen wir den Jungen", "Wenn sich der Zustand verschlechtert, muss man den Dienstarzt rufen", "Wir haben gestern über den Dienstplan gesprochen und ändern nichts"],
    "uk": ["Ліжко біля вікна звільниться завтра, тоді й переведемо хлопця", "Якщо стан хворого погіршиться, треба одразу викликати лікаря", "Ми вчора обговорили графік чергувань і вирішили нічого не змінювати"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [("documents", lang, ". ".join(rng.sample(said, 2))) for lang, said in SAID.items() for _ in range(60)]
    rows += [("documents", rng.choice(list(SAID)), ". ".join(rng.sample(SAID["ro"], 2))) for _ in range(12)]  # wrong labels
    return language.train(rows)


def test_single_languages(model):
    for lang, said in SAID.items():
        for text in said:
            n, parts = language.stretches(model, text)
            assert n >= 8 and [p[2] for p in parts] == [lang]
            assert parts[0][3] > 0.5


def test_mixed_and_borrowed(model):
    ro, ru, en = SAID["ro"][0], SAID["ru"][0], SAID["en"][0]
    assert [p[2] for p in language.stretches(model, f"{ro}, {ru.lower()}, {en.lower()}")[1]] == ["ro", "ru", "en"]
    assert [p[2] for p in language.stretches(model, f"{ro}, every day")[1]] == ["ro"]
    assert [p[2] for p in language.stretches(model, f"{ro} (olga точка x собака mail точка test)")[1]] == ["ro"]
    assert language.stretches(model, None) == (0, []) and language.stretches(model, " [S1] 00:12 ")[1] == []
    assert language.stretches(model, "ха-ха-ха-ха-ха-ха " + ro)[1][-1][2] == "ro"


def test_labels(spark):
    df = spark.createDataFrame([("ro",), ("ron",), ("Romanian",), ("ro-MD",), ("RU",), ("rus",), ("en_GB",), ("??",), ("",), (None,), ("und",), ("xq",), ("українська",)], "lang string")
    assert [r[0] for r in df.select(language.label_language(F.col("lang"))).collect()] == ["ro", "ro", "ro", "ro", "ru", "ru", "en", None, None, None, None, "other", "uk"]


def test_cases(spark, model):
    ro, ru = SAID["ro"][0], SAID["ru"][0]
    rows = [("a", "ro", ro), ("b", "rum", ro), ("c", None, ro), ("d", "ru", ro), ("e", "ro", f"{ro}. {ru}"), ("f", None, "Da."), ("g", None, None), ("h", "es", ro), ("c", None, ro), ("i", "", "")]
    df = spark.createDataFrame([("t", *r) for r in rows], "tab string, rec_key string, lang string, text string").withColumn("label", F.lit("clash"))
    got = language.cases(language.identify(df, model)).collect()
    assert sorted((r["rec_key"], r["lang"]) for r in got) == [("c", "ro"), ("d", "ro"), ("e", "ro"), ("e", "ru"), ("h", "ro")]
    assert language.cases(language.identify(df.limit(0), model)).collect() == []
    assert {x[1] for x in language.sample(df, 10)} <= set(language.LANGS)
    assert language.sample(df.limit(0)) == []
