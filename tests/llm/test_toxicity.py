import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm.toxicity import CONTEXT, LexiconAutomaton, errors, features, fit, learn_context, logistic, score, score_documents

TERMS = ["idiot", "clown", "disgusting", "worthless", "bad", "moron", "moronic"]


def distance(a, b):
    """Letters added, left out, replaced, or changed with their neighbour, none touched twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abdiot "), st.sampled_from("isdt")), max_size=3))
def test_automaton_against_edit_distance(word, edits):
    for at, ch, how in edits:
        word = word[:at] + {"i": ch, "s": ch, "d": "", "t": word[at : at + 2][::-1]}[how] + word[at + {"i": 0, "t": 2}.get(how, 1) :]
    got = LexiconAutomaton(TERMS).match(word)
    want = min(((distance(t, word), i) for i, t in enumerate(TERMS) if distance(t, word) <= errors(t)), default=None)
    assert (got is None) == (want is None)
    if got:
        assert (got[1], got[0]) == want


def test_misspellings():
    lex = LexiconAutomaton(TERMS, frozenset(["boron"]))
    for word, term in [("idoit", "idiot"), ("moorn", "moron"), ("1diot", "idiot"), ("ldiot", "idiot"), ("diot", "idiot"), ("vorthless", "worthless"), ("owrthles", "worthless")]:
        assert TERMS[lex.match(word)[0]] == term
    assert lex.match("boron") is None and lex.match("bda") is None and lex.match("") is None
    assert LexiconAutomaton(TERMS).match("boron") == (TERMS.index("moron"), 1)


def test_context_is_learned():
    rows = [((False, False, True, False), 1, 90), ((False, False, False, False), 1, 10), ((True, False, False, False), 0, 400), ((False, True, False, False), 0, 600)]
    base, quotes, reports, address, _ = learn_context(rows, 100, 1000)
    assert quotes < 0 and reports < 0 < address and learn_context([], 5, 5) == CONTEXT
    other = learn_context([((True, False, False, False), 1, 100), ((False, False, False, False), 0, 1000)], 100, 1000)
    assert other[1] > CONTEXT[1] and other[0] < base


def test_quotation_weighs_less_than_abuse():
    lex = LexiconAutomaton(TERMS)
    w = (5.0,) * len(TERMS)
    abuse, quote = features("you are such an idiot!", lex, w), features('she said the word "idiot" was used there', lex, w)
    assert abuse[0] > quote[0] and quote[2] > abuse[2]
    assert features("you idoit, you clwn", lex, w)[1] > 0
    assert features(None, lex, w) == features("", lex, w) == features("fine words", lex, w)


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = logistic(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_held_out_documents_of_the_table(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = score_documents(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    # labels of other languages follow no word of their texts in this small table
    test = out.where("held_out").join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in test) / len(test) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "idiot " * 5000, 3), (2, "x", 3)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = fit(docs, none)
    rows = score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score < 1e-6 and r.predicted == 0 for r in rows)
    assert score(docs.limit(0), model).count() == 0
    some = spark.createDataFrame([(2, 1, None), (None, 1, 1), (1, 0, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert fit(docs, some).terms == ()
