import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.packing import WordTokenizer, default_tokenizer, pack

OWN = WordTokenizer(default_tokenizer())
TEXTS = ["<|endoftext|> x<|endoftext|>y","One line.\nand  another", None, "", "É l'été can't 42 ok?!  tail ", "日本 x\ty   z q", "a" * 30_000, "One line.\nand  another"] + ["word " * 900] * 9


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]


def test_chunks_give_the_ids_of_whole_texts(ids):
    found, count = WordTokenizer(default_tokenizer(), cache=3).encode(pa.array([x or "" for x in TEXTS]), 2)
    assert [list(x) for x in np.split(found, np.cumsum(count)[:-1])] == ids


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces_cover_every_id_once_and_windows_are_full(spark, ids, length):
    docs = spark.createDataFrame([(i, x, "z", "extra") for i, x in enumerate(TEXTS)], "doc_id long, text string, Offset string, part string").repartition(3)
    rows = pack(docs, default_tokenizer(), length).collect()
    by_doc: dict[int, list] = {}
    windows: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            want = np.array(own[at : at + r.length], "<u4").tobytes()
            assert (bytes(r.ids), r.ids_crc32) == (want, zlib.crc32(want))
            at += r.length
        assert at == len(own)
    for k, spans in windows.items():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:j]) for j in range(len(spans))]
        assert sum(n for _, n in spans) == length or k == max(windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("aAbsT'd\u2019 .,!_-09éßÉſıİ²½ªµŉ\u0301<|endoftext|>\x85\x0b\x0c\x1c\xa0\t\nΣσ日<|>"), max_size=30), st.text(max_size=20)), max_size=5))
def test_any_text_gives_the_tokenizers_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    found, count = OWN.encode(pa.array(texts, pa.string()), 2)
    assert [list(x) for x in np.split(found, np.cumsum(count)[:-1])][: len(texts)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), default_tokenizer()).count() == 0
