"""Ids against the public library, exact round trips, nulls and empties."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from billspark.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def auto():
    return T.MergeAutomaton(T.read_ranks(T.DEFAULT_VOCABULARY), memo_size=500)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_compiled(auto):
    assert len(auto.merge) == 50_000 and all(auto.arc(p[0], p[1]) is False for p in list(auto.merge)[:500])


CASES = ["", " ", "\n\n \t", "a" * 5001, " " * 3000, "<|endoftext|>", "don't  STOP", "Überweisung nº 5 – 🏥‍", "ﬁ ​ x", "x" * 63 + " " + "y" * 65, "0123456789" * 30, "ẹ́"]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(auto, library, text):
    ids = auto.encode(text)
    assert ids == library(text) and auto.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(auto, library, text):
    text = text.encode("utf-8", "replace").decode()
    assert auto.encode(text) == library(text)


def test_repeats_that_merge_both_ways(auto, library):
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice("abe \n") * r.choice((1, 1, 2, 5)) for _ in range(30))
        assert auto.encode(t) == library(t)


def test_tables_start_anew(library):
    small = T.MergeAutomaton(T.read_ranks(T.DEFAULT_VOCABULARY), memo_size=1, table_size=50)
    r = random.Random(8)
    for _ in range(200):
        t = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 14))) for _ in range(6))
        assert small.encode(t) == library(t)
    assert len(small.table) <= 50 + 14 and len(small.states) == len(small.last)


def test_worker_compiles_once(auto):
    import pickle

    ranks = {b"a": 0, b"b": 1, b"ab": 2}
    load = pickle.loads(pickle.dumps(T.worker_automaton))
    assert load(T.digest(ranks), ranks) is T.worker_automaton(T.digest(dict(ranks)), dict(ranks))


def test_small_vocabulary_without_a_byte():
    a = T.MergeAutomaton({b"a": 0, b"b": 1, b"ab": 2, b"abab": 3})
    assert a.encode("ababab") == [3, 2] and a.encode("ba") == [1, 0]
    with pytest.raises(ValueError):
        a.encode("c")


def test_corpus(spark, library):
    rows = [(1, "The bill"), (2, ""), (3, None), (4, "The bill"), (4, "The bill"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids", "1 as id")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in T.encode_corpus(df).collect())
    b = library("The bill")
    assert got == [(0, library("x")), (1, b), (2, []), (3, []), (4, b), (4, b)]
    back = T.decode_corpus(T.encode_corpus(df.where("doc_id < 4"))).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "The bill", 2: "", 3: ""}
    assert T.encode_corpus(df.limit(0)).count() == 0
