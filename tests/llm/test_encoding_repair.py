import random

import numpy as np
import pytest

from termforge.llm import encoding_repair as E

WORDS = {
    "fr": "été forêt où déjà château fenêtre élève leçon garçon noël à très après rivière gelée".split(),
    "de": "straße grün über mädchen schön käse müller größe fließt brücke jährlich gehört".split(),
    "ru": "сегодня старый город новая школа зелёный лес тихая река большой дом стоит рядом".split(),
    "el": "παλιός δρόμος σχολείο γέφυρα μικρή λίμνη κήπος ανήκει κοντά αύριο".split(),
    "en": "the quiet river crosses old town by night while seven boats wait".split(),
}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = []
    for i in range(2500):
        lang = rng.choice(list(WORDS))
        out.append(" ".join(rng.choices(WORDS[lang], k=12)) + (" costs 20° or €5 …" if i % 7 == 0 else "."))
    return out


@pytest.fixture(scope="module")
def judged(spark, texts):
    damaged = {
        1: texts[0] + " forêt où".encode().decode("cp1252"), 2: "déjà été".encode().decode("latin-1"), 3: "старый город новая школа".encode("koi8-r").decode("cp1251"),
        4: "größe über straße".encode().decode("cp1252").encode().decode("cp1252"), 5: "forêt très".encode().decode("cp437"), 6: "it costs " + "€5".encode().decode("cp1252"),
        7: "d�j� vu", 8: "зелёный лес".encode().decode("cp1251"), 9: "for&Atilde;&ordf;t o&Atilde;&sup1;", 10: "σχολείο κοντά".encode("cp1253").decode("cp1252"),
        11: "forêt où déjà".encode().decode("cp1252").lower(), 12: "cafe\x85 lost", 13: "mädchen schön über brücke".encode("cp1252").decode("mac_roman"),
    }
    clean = {
        101: "ÉTÉ FORÊT OÙ", 102: "for&ecirc;t &amp; ch&acirc;teau", 103: "straße\xa0grün\xa0über", 104: "", 105: None, 106: "tihs is a typnig eror", 107: "plain ascii",
        108: "СТАРЫЙ ГОРОД", 109: "el​ève très", 110: "été" + " très" * 50_000,
    }
    rows = [(1000 + i, t, "x") for i, t in enumerate(texts)] + [(i, t, "x") for i, t in {**damaged, **clean}.items()]
    found = E.garbled(spark.createDataFrame(rows, "row_id bigint, text string, kind string")).collect()
    return damaged, {r["row_id"]: r for r in found}


def test_every_damaged_row_and_no_clean_one(judged):
    damaged, found = judged
    assert set(found) == set(damaged)


def test_restored(judged):
    _, found = judged
    want = {2: "déjà été", 3: "старый город новая школа", 4: "größe über straße", 5: "forêt très", 6: "it costs €5", 8: "зелёный лес", 9: "forêt où", 10: "σχολείο κοντά", 13: "mädchen schön über brücke"}
    assert {i: found[i]["restored"] for i in want} == want
    assert found[7]["kind"] == "lost" and found[7]["restored"] is None and found[3]["kind"] == "page" and found[2]["kind"] == "utf8"


def test_held_out_accuracy(spark, texts):
    half = spark.createDataFrame([(t,) for t in texts[::2]], "text string")
    report = E.validation_report(E.trained_model(half), texts[1:600:2], (E.FIRST_MARGIN, E.FIRST_MARGIN))
    assert report["accepted_clean"] == 0 and report["found_damaged"] > 0.97 and report["restored"] > 0.85


def test_candidates():
    assert "é" in E.utf8_candidates("Ã©") and "’" in E.utf8_candidates("â€™") and "ü" in E.utf8_candidates("ÃƒÂ¼")
    assert E.utf8_candidates("é") == set() and E.utf8_candidates("plain") == set()
    assert "Geb\xe4ude" in E.page_candidates("Geb‰ude")


def test_sketch_buckets_agree():
    for g in ("abc", "łóж", "😀 a"):
        rows = [b[0] for b in E.gram_buckets(g)]
        want = [E.Model._bucket(row, part) for part, rs in zip((g[2], g[1:], g), E.ROWS, strict=True) for row in rs]
        assert rows == want


def test_empty(spark):
    e = spark.createDataFrame([], "row_id bigint, text string")
    assert E.garbled(e).count() == 0 and E.damaged_rows(spark.createDataFrame([(1, None), (2, "")], "row_id bigint, text string")).count() == 0


def small_model(*texts):
    """A model of few texts, by which small gains occur."""
    buckets = E.gram_buckets(E._shape_text(" ".join(texts)))
    return E.Model(np.stack([np.bincount(b, minlength=E.SIZE) for b in buckets]))


@pytest.mark.parametrize("validated", [4.0, 12.0])
def test_restored_by_the_margins_of_the_search(spark, monkeypatch, validated):
    """A token is replaced where it gains more than the validated margin, be that under or over 6."""
    model = small_model("the old town été forêt déjà")
    weak, middle, strong = "grÃ¼n", "fenÃªtre", "forÃªt"
    gains = [E.Judge(model).token(t)[0] for t in (weak, middle, strong)]
    assert 4 < gains[0] < 6 < 8 < gains[1] < 12 < gains[2]
    monkeypatch.setattr(E, "_trained", lambda texts: (spark.sparkContext.broadcast(model), model))
    monkeypatch.setattr(E, "_clean_gains", lambda *a: None)
    monkeypatch.setattr(E, "validated_margins", lambda *a, **k: (validated, validated))
    rows = spark.createDataFrame([(1, weak), (2, f"{weak} {middle} {strong}")], "row_id bigint, text string")
    under, over = {1: "grün", 2: "grün fenêtre forêt"}, {2: f"{weak} {middle} forêt"}
    assert {r["row_id"]: r["restored"] for r in E.garbled(rows).collect()} == (under if validated < 6 else over)
    given = {r["row_id"]: r["restored"] for r in E.garbled(rows, margins=(8.0, 8.0)).collect()}
    assert given == {2: f"{weak} fenêtre forêt"}
    few = {r["row_id"]: r["restored"] for r in E.garbled(rows, margins=(1.0, 1.0)).collect()}
    assert few == under


def test_one_floor_at_every_size(spark, monkeypatch):
    """A row gaining between 4 and 6 is a case in a small table as in a large one."""
    model = small_model("the old town été forêt déjà")
    assert 4 < E.Judge(model).token("grÃ¼n")[0] < 6
    monkeypatch.setattr(E, "_trained", lambda texts: (spark.sparkContext.broadcast(model), model))
    for clean in (20, 3000):
        texts = ["grÃ¼n", *(f"été forêt {k}" for k in range(clean))]
        found = E.damaged_rows(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string"))
        assert [r["row_id"] for r in found.collect()] == [0]


def test_cross_fitting_judges_without_the_own_fold(spark):
    """What only one text teaches is unknown to the model that judges it."""
    own = next(t for t in (f"gr‰n f‰r {k}" for k in range(999)) if E._fold(t) == 1)
    other = next(t for t in (f"grän fär forêt {k}" for k in range(999)) if E._fold(t) > 1)
    texts = spark.createDataFrame([(t,) for t in [own, own, *[other] * 40]], "text string")
    first, shared = (spark.sparkContext.broadcast(small_model(*[own] * 2, *[other] * 40)) for _ in range(2))
    got = E.cross_fitted(texts, 0, first, shared).collect()
    assert sorted(r["n"] for r in got) == [2, 40] and E.cross_fitted(texts, E.ENOUGH, first, shared) is None
    mine = next(r for r in got if r["n"] == 2)
    within, without = (E.Judge(m).record(own)[1] for m in (shared.value, small_model(*[other] * 40)))
    assert within + 2 < without and mine["page"] == pytest.approx(without, abs=0.5)


@pytest.mark.parametrize("held", [3, 2 * E.ENOUGH])
def test_margins_come_from_all_clean_records(spark, held):
    """However many records are held out, those of other folds count as well, by the same gains."""
    clean = [f"grün für forêt {k}" for k in range(200)] * 2 + ["gr‰n", "plain", "Ã©tÃ©"]
    texts = spark.createDataFrame([(t,) for t in clean], "text string")
    first, shared = (spark.sparkContext.broadcast(small_model(*clean)) for _ in range(2))
    scored = spark.range(held).selectExpr("0 AS fold", "-1D AS utf8", "-1D AS page")
    gains = E._clean_gains(texts, scored, first, shared).collect()
    others = [t for t in clean if not t.isascii() and E._looks_clean(t) and E._fold(t) > 0]
    assert sum(r["n"] for r in gains) == held + len(others) and sum(r["n"] for r in gains if r["utf8"] >= 0) == len(others)


def test_folds_in_parts(spark):
    """A fold cut into many ranges is judged as in one: by the model less all that the fold taught."""
    clean = [f"{w} für {k}" for w in ("grün", "forêt", "город") for k in range(60)]
    twice = [*clean, *clean[:30]]
    model = small_model(*twice)
    first, shared = (spark.sparkContext.broadcast(model) for _ in range(2))
    texts = spark.createDataFrame([(t,) for t in twice], "text string")
    got = E.judged_folds(texts, [1, 2], first, shared)
    want = []
    for fold in (1, 2):
        counts = model.counts.copy()
        for t in twice:
            if E._fold(t) == fold and (shaped := E._taught(t, E.Judge(model))) is not None:
                for k, b in enumerate(E.gram_buckets(shaped)):
                    np.subtract.at(counts[k], b, np.float32(1))
        judge = E.Judge(E.Model(np.maximum(counts, 0)))
        want += [(*judge.record(t)[:2], twice.count(t)) for t in clean if E._fold(t) == fold]
    key = lambda r: tuple(round(x, 6) for x in r)
    assert len(want) > 20 and sorted(map(key, got.collect())) == sorted(map(key, want))


def test_gain_is_the_difference_of_scores(texts):
    model = small_model(*texts[:200])
    tokens = {t for x in texts[:300] for t in x.split()} | {"straße\xa0grün", "ÉTÉ", "İx", "é12", "\xa0é", "x​é"}
    pairs = [(t, c) for t in tokens for c in E.page_candidates(t)]
    assert len(pairs) > 500
    for t, c in pairs:
        assert abs(model.gain(t, c) - (model.score(c) - model.score(t))) < 1e-9


def test_plain_and_suspicious_counts_make_the_whole(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts[:300], "&amp; plain", "", "Ã©tÃ©"]], "text string")
    counts = E._counts(df)
    taught = [E._shape_text(t) for t in [*texts[:300], "&amp; plain", ""] if t.isascii() or not E._held_out(t)]
    whole = sum(np.bincount(E.gram_buckets(s)[5], minlength=E.SIZE) for s in taught)
    inside = counts.sum(axis=0)[5]  # texts are counted one after another, which adds grams of spaces between them
    assert (inside >= whole).all() and (inside - whole).sum() <= 2 * len(taught) and counts[0].sum() > 0 and counts[1].sum() > 0


def test_validation_measures_both_sides(spark, texts):
    report = E.validation(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")).first()
    held = [t for t in texts if not t.isascii() and E._looks_clean(t) and E._held_out(t)]
    assert report["n_clean"] == len(held) and report["n_accepted"] == 0
    assert 0.9 * len(held) < report["n_damaged"] <= len(held) and report["n_found"] > 0.97 * report["n_damaged"] and report["n_restored"] > 0.8 * report["n_damaged"]
    assert E.validation(spark.createDataFrame([], "row_id bigint, text string")).first()["n_clean"] == 0
