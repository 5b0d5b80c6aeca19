import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import sentencepiece_codec as x

MODEL = x.default_model()
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = x.Codec(MODEL)
ODD = ["", " ", "   ", " lead", "a  b\t c\n\nd", "é́ 日本 🙂", "▁x", "\0a\0", "x" * 20_000, " " * 300, "<s> </s><unk>", "\r\n\x85"]


def test_ids_equal_the_library_and_round_trip():
    ids, count = OWN.encode(ODD)
    for text, own, back in zip(ODD, np.split(ids, np.cumsum(count)[:-1]), OWN.decode(ids, count), strict=True):
        assert own.tolist() == SP.encode(text), text
        assert back == SP.decode(own.tolist())
        assert "▁" in text or back == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aberstion TH.,\n▁é0日"), max_size=40), max_size=5))
def test_random_texts(texts):
    ids, count = OWN.encode(texts)
    assert [i.tolist() for i in np.split(ids, np.cumsum(count)[:-1])][: len(texts)] == [SP.encode(t) for t in texts]


def test_suffix_array_and_edges_against_brute_force():
    rng = random.Random(1)
    points = np.array([rng.randrange(3) for _ in range(300)])
    order = x.suffix_array(points, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: points[i:].tolist())
    text = "the nation interned"
    edges = set(zip(*(e.tolist() for e in OWN.v.edges(np.array([ord(c) for c in text]))), strict=True))
    plain = {OWN.v.pieces[i]: i for i in OWN.v.ids.tolist()}
    assert edges == {(a, b, plain[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in plain}


def test_unigram_relaxation_takes_the_best_path():
    v = x.Codec(MODEL)
    v.v.score = np.zeros_like(v.v.score) - 5
    v.v.score[3] = -9.0
    edges = {(0, 1): 3, (1, 2): 3, (0, 2): 4, (2, 3): 5, (1, 3): 3}
    assert v._relax_unigram("abc", edges) == [4, 5]


def test_query_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None, "b a", "b a"])]
    got = {r.doc_id: r for r in x.codec(spark.createDataFrame(rows, "doc_id long, text string, N_tokens int").repartition(2), MODEL).collect()}
    assert all(list(got[i].ids) == SP.encode(t or "") and got[i].n_tokens == len(got[i].ids) for i, t, _ in rows)
    assert all(got[i].round_trip == ("▁" not in (t or "")) for i, t, _ in rows)
    assert x.codec(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
