import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.splitting import WHITE, longest_sentence, plan_pieces, sentence_ends, split_points, split_texts, tidy


def pieces(text, limit=900, overlap=100):
    words, paragraphs, items = tidy(text)
    return words, split_points(words, paragraphs, items, sentence_ends(words), limit, overlap)


def check(text, limit, overlap):
    words, got = pieces(text, limit, overlap)
    end = 0
    for i, (a, b, _) in enumerate(got):
        assert 0 < b - a <= limit or not words
        assert a <= end + 1 and b > end or i == 0
        assert i == 0 or end - a <= overlap
        assert i == 0 or words[end:a].strip(" ") == ""
        end = b
    assert end == len(words)
    return words, got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB. !?…)\"»\n\t  ;-é1"), max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_tidy_is_white_space_reduced():
    text = "  a\n\n b \tc \r\n- d e\x85f　"
    assert tidy(text)[0] == "a b c - d e f"
    assert tidy(text)[1] == [1] and tidy(text)[2] == [5]
    assert tidy("")[0] == tidy(WHITE)[0] == ""


def test_sentences():
    text = 'One e.g. two. "Three!" (Four? five) Six… «Sept» 8. Neuf.) Z'
    ends = sentence_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)])] == ['One e.g. two.', '"Three!"', '(Four? five) Six…', '«Sept» 8.', 'Neuf.)', 'Z']
    assert longest_sentence("ab. Cde", sentence_ends("ab. Cde")) == 3


def test_cuts_at_sentences_where_it_can():
    text = " ".join(f"Sentence {i} is about {'water ' * (i % 9)}here." for i in range(60))
    words, got = check(text, 900, 100)
    assert all(k >= 4 for _, _, k in got[:-1]) and len(got) == -(-(len(words) - 100) // 800)


def test_no_boundary_at_all():
    _, got = check("x" * 5_000, 900, 100)
    assert len(got) <= 8
    check("y" * 901, 900, 0)


def test_exactly_the_limit(spark):
    df = spark.createDataFrame([(1, "a" * 900), (2, "a" * 901), (3, ""), (4, None), (5, "é" * 900), (6, " " + "b " * 450)], "i int, text string")
    got = {r.i: r for r in plan_pieces(df, "text").collect()}
    assert [got[i].plan is not None for i in range(1, 7)] == [False, True, False, False, False, False]
    assert (got[3].n_chars_tidy, got[4].n_chars_tidy, got[6].n_chars_tidy) == (0, None, 899)


def test_jvm_and_python_see_the_same_white_space(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(WHITE + "ab.C") for _ in range(1_500)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in plan_pieces(df, "text", 200, 20).collect():
        assert row.tidy_text == tidy(texts[row.i])[0] and row.plan.ends[-1] == row.n_chars_tidy


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_new_ordinals(spark, limit):
    long = "Word and more of it here. " * 80
    rows = [(1, "s", 0, "short", "x"), (2, "s", 1, long, "x"), (2, "s", 1, long, "x"), (3, "s", 2, "last", "x"), (4, None, 0, "alone", "x"), (5, "s", 3, "", "x"), (6, "s", 4, None, "x")]
    df = spark.createDataFrame(rows, "pid int, source string, ordinal int, text string, piece string")
    got = split_texts(df, "pid", "source", "ordinal", "text", rows_per_bucket=limit).orderBy("source", "ordinal").collect()
    assert [r.ordinal for r in got if r.source == "s"] == list(range(len(got) - 1))
    assert [r.pid for r in got] == [4, 1, *[2] * (len(got) - 3), 3] and all(len(r.text) <= 900 for r in got)
    assert split_texts(df.limit(0), "pid", "source", "ordinal", "text").count() == 0


def test_refuses_an_overlap_over_the_limit(spark):
    with pytest.raises(ValueError):
        plan_pieces(spark.createDataFrame([(1, "a")], "i int, text string"), "text", 10, 10)
