import numpy as np
import pytest

from almanac.llm import language


def plain(scores, first, switch):
    out = np.zeros(len(scores), int)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        value, back = scores[a].copy(), []
        for t in range(a + 1, b):
            jump = value.max() - switch
            back.append(np.where(value >= jump, np.arange(len(value)), value.argmax()))
            value = np.maximum(value, jump) + scores[t]
        out[b - 1] = value.argmax()
        for t in range(b - 2, a - 1, -1):
            out[t] = back[t - a][out[t + 1]]
    return out


@pytest.mark.parametrize("states", [1, 2, 5])
def test_chunked_viterbi_is_viterbi(states):
    rng = np.random.default_rng(states)
    first = np.concatenate(([0, 0], np.cumsum(rng.integers(0, 900, 12))))
    scores = rng.normal(size=(first[-1], states)) * 3
    assert (language.best_labels(scores, first, 5.0) == plain(scores, first, 5.0)).all()


LATIN = {"aa": "balo keru tami balo", "bb": "zwyx qorv zwyx vrot"}


def test_mixed_text_gets_spans_and_scripts_narrow(spark):
    rows = [(f"{t} {t}", lang) for lang, t in LATIN.items() for _ in range(5)] + [("привет мир привет", "ru")] * 5 + [(None, "aa"), ("x", None)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("aa", "bb", "ru")
    text = "balo keru tami, zwyx qorv vrot zwyx. привет"
    docs = spark.createDataFrame(
        [(1, text), (2, None), (3, ""), (4, "12 34 !"), (5, "—… ×"), (6, "мир"), (1, text)], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    spans = [(text[s.start : s.end], s.lang) for s in got[1].spans]
    assert spans == [("balo keru tami", "aa"), ("zwyx qorv vrot zwyx", "bb"), ("привет", "ru")]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 5))
    assert got[6].lang_pred == "ru"


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "abc", 2)], "doc_id long, text string, SPANS int")
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    (row,) = language.identify(docs, model).collect()
    assert row.lang_pred == "und" and row.spans == []
    assert language.identify(docs.limit(0), model).count() == 0
