"""Mixing and text statistics."""

import os
import random

import pytest

from ledgerlens.llm import mixing, quality

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")


@needs_tokenizer
def test_mix_meets_its_targets(spark):
    random.seed(4)
    words = {"a": "loan bank credit rate".split(), "b": "tree river bird stone".split(), "c": "code class test build".split()}
    rows = [(i, s, " ".join(random.choices(words[s], k=random.randint(20, 60)))) for i, s in enumerate(random.choices("aabbbbbbc", k=600))]
    rows += [(9000, None, "loan"), (9001, "zzz", "loan " * 5), (9002, "a", None), (9003, "a", ""), (None, "a", "loan"), rows[0]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mix(docs, targets).collect()
    cap = {"a": 3, "b": 1, "c": 5}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in used) and len({r["doc_id"] for r in used}) == len(used)
    assert {r["doc_id"] for r in used} <= {r[0] for r in rows if r[1] in cap and r[2]}
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s]["share"] - share) < 0.02 and report[s]["most_repeats"] <= cap[s]
    assert mixing.mix(docs, targets.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(docs.limit(0), targets)


@needs_tokenizer
def test_classifier_tells_held_out_rows(spark):
    import numpy as np

    random.seed(5)
    words = {"a": "loan bank credit rate money".split(), "b": "tree river bird stone wind".split()}
    rows = [(s, " ".join(random.choices(words[s] + ["the", "of"], k=30)), i % 5 == 0) for i, s in enumerate(random.choices("ab", k=200))]
    logs = mixing.train_sources(spark.createDataFrame(rows, "source string, text string, held boolean"), ["a", "b"])
    right = [int(np.argmax(logs[:, mixing._features(t)].mean(1))) == "ab".index(s) for s, t, h in rows if h]
    assert sum(right) / len(right) > 0.95


PROSE = [
    "She had worked at the shop since 2005, and nobody had ever mentioned a loan to her. The report does not say why.",
    "NOBODY COULD SAY WHO HAD SIGNED THE FORM, AND THE BANK DID NOT ASK FOR IT AGAIN.",
    "La señora que atiende en el banco nos dijo que el plazo ya había pasado. No es necesario enviar otra vez los documentos.",
    "Il n'est pas nécessaire de renvoyer les documents si la banque les a déjà reçus. Le prêt a été accordé en mai.",
    "caller from Ruskdale upset, says it never arrived\nno answer at the number for them, left a message\nthey want to know if that is enough for the form",
    "THE CLERK: When did you see the form?\nTHE OWNER: It was on the desk that day, but I do not know who put it there.",
    "Wherc the filing and the sheet dis~gree, the older of the two should be used f1rst, as the bank has said.",
    "He said that the figures were guesses and\nthat he would not stand by them today, although\nthe others had signed all of the papers.",
]
OTHER = [
    "• Lodestar Bank\n• Ridgemont Funding Inc\n• Harrowgate Lending LLC\n• Old Harbor Credit Union", "1. careful cover letter\n2. strict identity card\n3. draft payroll summary\n4. first wage report", "Quilldale ........ 87553.75\nQuillport ........ 312166.47\nElliswick ........ 24213.65",
    "| Quillton | textiles | 444 | 884219.97 |\n| Wickmouth | furniture | 226 | 376144.41 |\n| Sablefield | studios | 389 | 46157.57 |", "624\t34%\t$862729.01\n5\t70%\t$786656.58\n113\t5%\t$895398.59", "#bakery #tutoring #realty2012 #foodsnow #hotel #supplyloans #golf2012",
    "tqgx xslsgrc vcwgpxlwk jkhrrqg pstzwt hkxpkqrngnq kxmkvmg mxfxzffqvtw", "9c6158fd c4029aec 4f9158a6 1ace3f26 7cd737f7 a41500c3", "Ã± Â â€œ Ã± ï¿½ Ã© lÃ¡ Ã¼r crÃ©dit Ã± â€œ Ã©", "-----------\n===========\n***********", "Menu Menu Menu Menu Menu Menu Menu Menu", "<div class=\"c768\"></div>\n{{ field_468 }}\nvar x184 = function(){return null;};\n.btn-709{margin:0;padding:4px}",
    "headcount sheet, business licence, identity card, tax return, lease, bank statement, cover letter",
]


def test_profiles_tell_prose_from_the_rest(spark):
    rows = [(i, t) for i, t in enumerate(PROSE + OTHER)]
    rows += [(100, PROSE[0] + "\n" + OTHER[2] * 9), (101, PROSE[0] * 9 + "\n" + OTHER[2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, profile string")
    found = {r["doc_id"] for r in quality.not_prose(quality.text_statistics(df)).collect()}
    assert found == {*range(len(PROSE), len(PROSE) + len(OTHER)), 100}


def test_statistics_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "One two. three!"), (5, "word " * 100_000), (5, "x")], "doc_id long, text string")
    got = quality.text_statistics(df).orderBy("doc_id", "n_words").collect()
    assert len(got) == 6 and got[0]["n_words"] is None and got[1]["n_words"] == 0 and got[2]["prose"] == 0
    assert got[3]["n_words"] == 3 and abs(got[3]["mean_word_length"] - 11 / 3) < 1e-9 and got[3]["punctuated_lines"] == 1.0 and got[5]["n_words"] == 100_000
    assert quality.text_statistics(df.limit(0)).isEmpty()


def test_languages_of_prose():
    from ledgerlens.llm.quality import language

    said = {
        "en": "the loan was made to a firm that had no staff and it was not repaid when they asked for it", "es": "el préstamo fue para una empresa que no tenía personal y no se ha pagado cuando lo pidieron por carta",
        "fr": "le prêt était pour une société qui ne payait pas ses employés et il est dans les mains de la banque", "de": "der kredit war für eine firma die nicht mehr da ist und wir haben ihn noch nicht zurück",
    }
    for k, text in said.items():
        got, d = language(text.split())
        assert got == k and 0 < d < 0.95
    assert language(["xq", "zzkl"]) == (None, None) and language([]) == (None, None)
    assert language("the".split())[1] > language(said["en"].split())[1]


def test_a_source_without_documents_leaves_the_others_to_mix(spark):
    docs = spark.createDataFrame([(i, f"words of {'loans' if i % 2 else 'grants'} number {i} " * (3 + i % 4), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 2), ("gone", 0.4, 3)], "source string, target_share double, max_repeats int")
    with pytest.warns(UserWarning):
        got = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    assert got["gone"]["documents"] == 0 and got["gone"]["share"] == 0 and abs(got["a"]["share"] - 0.5) < 0.05
    assert abs(got["a"]["expected_share"] + got["b"]["expected_share"] + got["gone"]["expected_share"] - 1) < 1e-3
