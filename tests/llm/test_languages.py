import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm import languages as lg

EN = ["The animal stopped after the trial and drank some water.", "We kept the unit because the signal was stable.", "Please check why the number of trials differs from the notebook."]
FR = ["La souris ne lèche plus après les essais, donc il faut retirer le bloc.", "Nous avons gardé les unités après avoir vérifié le signal.", "Il faudrait savoir pourquoi le nombre d'essais diffère du cahier."]
DE = ["Die Maus leckte nach den Durchgängen nicht mehr, der Block muss weg.", "Wir haben die Einheiten behalten, nachdem das Signal geprüft war.", "Jemand muss klären, warum die Zahl der Durchgänge abweicht."]


def trees():
    return lg.grow({g: [lg.symbols(s) for s in x] * 3 for g, x in (("de", DE), ("en", EN), ("fr", FR))})


def slow_cost(samples, text):
    """Plain PPM with escapes, by dictionaries."""
    counts = [{} for _ in range(lg.ORDER + 1)]
    for s in samples:
        full = [lg.PAD] * lg.ORDER + s.tolist()
        for i in range(lg.ORDER, len(full)):
            for k in range(lg.ORDER + 1):
                c = counts[k].setdefault(tuple(full[i - k : i]), {})
                c[full[i]] = c.get(full[i], 0) + 1
    bits = 0.0
    full = [lg.PAD] * lg.ORDER + text.tolist()
    for i in range(lg.ORDER, len(full)):
        for k in range(lg.ORDER, -1, -1):
            c = counts[k].get(tuple(full[i - k : i]))
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if full[i] in c:
                bits -= np.log2(c[full[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += lg.BITS
    return bits


def test_tables_equal_plain_ppm():
    t = trees()
    texts = [lg.symbols(x) for x in (EN[0], "The mouse ran away from 12 trials!", "xyzzy qqq", "é")]
    got = lg.code_lengths(t, texts)
    for i, x in enumerate(texts):
        for j, s in enumerate((DE, EN, FR)):
            assert abs(got[i, j] - slow_cost([lg.symbols(y) for y in s] * 3, x)) < 1e-2
    assert lg.code_lengths(t, []).shape == (0, 3)
    assert lg.code_lengths(t, [np.zeros(0, np.uint32)]).tolist() == [[0, 0, 0]]


def test_bytes_keep_accents_and_drop_case():
    assert (lg.symbols("ÉTÉ l’œil 27") == lg.symbols("été l'œil 09")).all()
    assert len(lg.symbols("é")) == 2 and lg.symbols("été").tolist() != lg.symbols("ete").tolist()
    assert lg.unaccented("ÉTÉ Straße l’œil") == "ete strasse l’oeil"


# sentences written for this test, about nothing that the test tables are about
ORDINARY = {
    "en": ["The baker on the corner closes early on Thursdays in winter.", "She had forgotten her umbrella and arrived completely soaked.", "Which of these two roads leads back to the village?", "They painted the kitchen yellow because the old colour looked sad."],
    "fr": ["Le boulanger du coin ferme plus tôt le jeudi en hiver.", "Elle avait oublié son parapluie et elle est arrivée trempée.", "Laquelle de ces deux routes ramène au village ?", "Ils ont peint la cuisine en jaune parce que l'ancienne couleur était triste."],
    "de": ["Der Bäcker an der Ecke schließt im Winter donnerstags früher.", "Sie hatte ihren Regenschirm vergessen und kam völlig durchnässt an.", "Welche dieser beiden Straßen führt zurück ins Dorf?", "Sie haben die Küche gelb gestrichen, weil die alte Farbe traurig aussah."],
    "es": ["El panadero de la esquina cierra más temprano los jueves en invierno.", "Ella había olvidado su paraguas y llegó completamente mojada.", "¿Cuál de estos dos caminos lleva de vuelta al pueblo?", "Pintaron la cocina de amarillo porque el color anterior era muy triste."],
    "it": ["Il fornaio all'angolo chiude prima il giovedì durante l'inverno.", "Aveva dimenticato l'ombrello ed è arrivata completamente bagnata.", "Quale di queste due strade riporta al villaggio?", "Hanno dipinto la cucina di giallo perché il vecchio colore era triste."],
    "pt": ["O padeiro da esquina fecha mais cedo às quintas-feiras no inverno.", "Ela tinha esquecido o guarda-chuva e chegou completamente molhada.", "Qual destes dois caminhos leva de volta à aldeia?", "Pintaram a cozinha de amarelo porque a cor antiga era muito triste."],
    "nl": ["De bakker op de hoek sluit in de winter op donderdag vroeger.", "Ze had haar paraplu vergeten en kwam helemaal doorweekt aan.", "Welke van deze twee wegen leidt terug naar het dorp?", "Ze hebben de keuken geel geverfd omdat de oude kleur er somber uitzag."],
}
FOREIGN = [
    "Пекарь на углу зимой по четвергам закрывается раньше.", "Она забыла свой зонт и пришла совсем мокрая.", "街角的面包店冬天每个星期四都很早关门。", "她忘了带雨伞,到的时候全身都湿透了。",
    "Bagaren på hörnet stänger tidigare på torsdagar under vintern.", "Hon hade glömt sitt paraply och kom fram alldeles genomblöt.", "Vilken av de här två vägarna leder tillbaka till byn?",
]


def test_ordinary_sentences_and_other_languages(spark):
    """Trees built from the test tables tell ordinary sentences apart, and leave other languages undecided."""
    docs = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(docs):
        pytest.skip("no test tables here")
    t = lg.train_trees(spark.read.parquet(docs))
    rows = [(g, s) for g, ss in ORDINARY.items() for s in ss] + [("und", s) for s in FOREIGN]
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in lg.segment_languages(df, t, every=True).collect()}
    assert len(got) == len(rows) and all(r.seg is not None for r in got.values())
    right = [got[i].seg_lang == g for i, (g, _) in enumerate(rows)]
    known = [ok for ok, (g, _) in zip(right, rows) if g != "und"]
    assert sum(known) / len(known) >= 0.9, [(g, got[i].seg_lang) for i, (g, _) in enumerate(rows)]
    assert all(ok for ok, (g, _) in zip(right, rows) if g == "und"), [(g, got[i].seg_lang) for i, (g, _) in enumerate(rows)]


def test_every_document_has_a_row(spark):
    df = spark.createDataFrame(corpus(spark) + [(2000, None, "en"), (2001, "", None), (2002, "12; 13", "fr"), (2003, "街角的面包店冬天每个星期四都很早关门。", "zh"), (None, EN[0], "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lg.document_languages(lg.segment_languages(df, lg.train_trees(df), every=True)).collect()}
    assert set(got) == {r.doc_id for r in df.collect()}
    assert all((got[i].lang, got[i].confidence, got[i].n_langs) == ("und", 0.0, 0) for i in (2000, 2001, 2002, 2003))
    assert [got[i].n_sentences for i in (2000, 2001, 2002, 2003)] == [0, 0, 0, 1] and got[None].lang == "en"


@pytest.mark.parametrize("text,n", [("", 0), ("[imec0 #332]\n0.5; 2.1; 3.3", 0), ("df.groupby(['CP', 'CA1']).agg('37')\nbin_size = 0.01", 0), (EN[0] + " " + FR[0] + "\n> " + DE[0], 3), ("It fires at 14.0 spikes per second in PERI. " + EN[1], 2), (" ".join(["word"] * 150), 3)])
def test_sentences(text, n):
    assert len([1 for a, b in lg.split_sentences(text) if lg.is_sentence(text[a:b])]) == n


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("fra", "FR", "fr-CH", "French", " fr ", "und", "", None, "ca", "??", "pt_BR", "English (UK)", "fro")], "l string")
    got = [r[0] for r in df.select(lg.label_code(F.col("l"))).collect()]
    assert got == ["fr"] * 5 + [None] * 5 + ["pt", "en", None]


def corpus(spark):
    rows = []
    for i in range(30):
        for g, s in (("en", EN), ("fr", FR), ("de", DE)):
            rows.append((len(rows), f"{s[i % 3]} {s[(i + 1) % 3]}", g if i % 10 else "de"))
    return rows


def run(spark, extra):
    df = spark.createDataFrame(corpus(spark) + extra, "doc_id long, text string, lang string").withColumn("seg", F.lit("clash")).withColumn("_code", F.lit(1)).withColumn("confidence", F.lit("x"))
    got = {}
    for r in lg.wrong_labels(df).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    return got


def test_cases(spark):
    extra = [
        (1000, EN[0], "eng"), (1001, FR[0], None), (1002, DE[0], "und"), (1003, EN[1] + "\n" + FR[1], "en"), (1004, None, "en"), (1005, "", "xx"), (1006, "12; 13", None),
        (1007, DE[1].upper(), "fr"), (1008, EN[2] + " (souris)", "en"), (1009, FR[2].lower().replace("é", "e"), "French"), (1010, "x" * 100000 + "\n" + EN[0], "fr"), (1011, EN[0], "sv"),
    ]
    got = {k: v for k, v in run(spark, extra + [extra[1]]).items() if k >= 1000}
    assert got == {1001: {"fr"}, 1002: {"de"}, 1003: {"en", "fr"}, 1007: {"de"}, 1010: {"en"}, 1011: {"en"}}


def test_wrong_labels_in_the_sample_do_not_stick(spark):
    got = run(spark, [])
    wrong = {i for i, (_, t, g) in enumerate(corpus(spark)) if g == "de" and not any(t.startswith(x) for x in DE)}
    assert set(got) == wrong


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lg.wrong_labels(df).count() == 0


def test_held_out_accuracy(spark, data_dir):
    """Trained on half of the test documents, sentences of the other half agree with their document's (possibly wrong) label."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    t = lg.train_trees(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").withColumn("_code", lg.label_code(F.col("lang"))).where("_code is not null")
    got = lg.document_languages(lg.segment_languages(held, t)).withColumnRenamed("lang", "found").join(held.select("doc_id", "_code"), "doc_id").toPandas()
    assert len(got) > 30 and (got["found"] == got["_code"]).mean() > 0.8
