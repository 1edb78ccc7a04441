"""Language priors are shares of all rows, however small the sample."""

import math

from stenoflow.llm import language

RO = "pacientul respiră greu și are febră mare de ieri seară numărul"
DE = "der patient atmet schwer und hat seit gestern abend hohes fieber nummer"
EN = "the patient breathes badly and has had a high fever since yesterday number"
LETTERS = "abcdefghij"


def rows_of(spark):
    def many(tab, lang, text, n):
        return [(tab, f"{tab}{lang}{i}", lang, f"{text} {''.join(LETTERS[int(d)] for d in str(i))}") for i in range(n)]

    rows = many("documents", "ro", RO, 900) + many("documents", "de", DE, 100) + many("segment", "ro", RO, 100) + many("segment", "en", EN, 300)
    return spark.createDataFrame(rows, "tab string, rec_key string, lang string, text string").repartition(2)


def shares(prior):
    return {x: math.exp(p / language.PRIOR) for x, p in zip(language.LANGS, prior)}


def test_priors_do_not_depend_on_the_bound(spark):
    rows = rows_of(spark)
    for bound in (60, 5000):
        labelled, totals = language.sample_and_totals(rows, bound)
        model = language.train(labelled, totals=totals)
        documents, segments = shares(model.by_table["documents"]), shares(model.by_table["segment"])
        assert abs(documents["de"] - 0.1) < 0.03 and abs(documents["ro"] - 0.9) < 0.05
        assert abs(segments["en"] - 0.75) < 0.06 and segments["de"] < 0.02
        assert abs(shares(model.prior)["de"] - 100 / 1400) < 0.03


def test_stretches_use_the_prior_of_their_table(spark):
    labelled, totals = language.sample_and_totals(rows_of(spark), 60)
    model = language.train(labelled, totals=totals)
    model.weights[:] = 0  # words that tell nothing: the prior alone decides
    assert [language.stretches(model, RO, tab)[1][0][2] for tab in ("documents", "segment", None)] == ["ro", "en", "ro"]


def test_language_probabilities(spark):
    """They are weak evidence for a row, and rows at odds with them do not teach."""
    rows = rows_of(spark)
    model = language.train(language.sample(rows, 60))
    model.weights[:] = 0
    assert language.stretches(model, RO, "segment", {"ro": 0.98, "en": 0.01, "ru": None})[1][0][2] == "ro"
    probs = [("segment", "a", "ro", RO, {"en": 0.9, "ro": 0.1}), ("segment", "b", "ro", RO, {"en": 0.1, "ro": 0.9}), ("segment", "c", "ro", RO, None), ("segment", "d", "ro", RO, {})]
    df = spark.createDataFrame(probs, "tab string, rec_key string, lang string, text string, lang_probs map<string,double>")
    assert len(language.sample(df)) == 3
    found = {r["rec_key"]: r["stretches"][0]["lang"] for r in language.identify(df.drop("lang").selectExpr("*", "'ro' as lang"), language.train(language.sample(rows, 60))).collect()}
    assert found == {"a": "ro", "b": "ro", "c": "ro", "d": "ro"}
