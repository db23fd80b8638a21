import random
import re

import pytest
from conftest import SF

from waymark.llm.licenses import FAMILIES, TEMPLATES, confirmed, fit, scan, scan_documents, train, variations, words_of


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_variations(model):
    rng = random.Random(99)
    right = total = 0
    for family, texts in TEMPLATES.items():
        for t in texts:
            for v in variations(t, 6, rng):
                total += 1
                right += any(f == family for _, f, _, _ in scan("Some line before.\n" + v, model))
    assert right / total > 0.9


def test_unknown_and_ordinary(model):
    assert {f for _, f, _, _ in scan("Released under the Grumbo License.", model)} <= {"unknown"}
    assert scan("The cat sat on the mat.\nNothing here.", model) == [] == scan("", model)
    assert abs(model.probabilities(words_of("Released under the MIT License.")).sum() - 1) < 1e-9
    assert confirmed("MIT", words_of("released under the MIT license")) and not confirmed("MIT", words_of("a b c"))


def test_documents_of_the_table(spark, model):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = {}
    for r in docs.collect():
        for family, pattern in (("MIT", "the MIT License"), ("Apache", "Apache License"), ("GPL", "GNU General Public"), ("CC-BY-NC", "CC BY-NC")):
            if re.search(pattern, r.text):
                want[r.doc_id] = family
    got = {r.doc_id: (r.license, r.confirmed) for r in scan_documents(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(got[i] == (f, True) for i, f in want.items())
    assert sum(f is not None and i not in want for i, (f, _) in got.items()) < 0.05 * len(got)


def test_odd_rows(spark):
    model = train([])
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "word " * 5000 + "Released under the MIT License. " + "word " * 300, "z")], "doc_id bigint, text string, license string")
    rows = scan_documents(docs, model).collect()
    assert len(rows) == 3 and sorted(str(r.license) for r in rows) == ["MIT", "None", "None"]
    assert scan_documents(docs.limit(0), model).count() == 0 and fit(docs.limit(0)).weights.shape[1] == len(FAMILIES)


def test_ordinary_text_takes_no_statement_away():
    ordinary = ["The park is available to the public and under the domain of the work of many.", "They work under a public domain that is available to any person who may use the source."]
    prose = "the old road went over a hill " * 8
    model = train([*ordinary, prose] * 5)
    for family, texts in TEMPLATES.items():
        for t in texts:
            assert any(f == family for _, f, _, _ in scan(t, model)), t
            assert any(f == family for _, f, _, _ in scan(f"{prose}{t} {prose}", model)), t
    for t, family in (("CC BY 4.0", "CC-BY"), ("CC BY-SA 4.0", "CC-BY-SA"), ("CC BY-NC 4.0", "CC-BY-NC")):
        assert [(f, c) for _, f, _, c in scan(t, model)] == [(family, True)]
    assert all(scan(t, model) == [] for t in [*ordinary, prose])
