import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import tokenize as t

with open(t.default_vocabulary(), "rb") as f:
    RANKS = t.read_ranks(f.read())
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(encoder, texts):
    flat, ends, _ = encoder.encode(texts)
    at = [0, *ends.tolist()]
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


CASES = ["", None, " ", "a", "it's we're 'tis ''s 's'll x'", "a  b\n\n c\t\td  e", "<|endoftext|>", "日本語 テスト。", "x" * 5000, "é 🇪🇺👩🏽‍🔧", "'re've'd 12'm '", "\n's", "  's", "don't\n", "'l 'r 'v", "a'", "'"]


def test_cases_and_round_trip():
    for native in (True, False):
        got = ids(t.Encoder(RANKS, native), CASES)
        assert got == [OTHER.encode_ordinary(x or "") for x in CASES]
        assert [t.decode(g, RANKS) for g in got] == [x or "" for x in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("'’stremdl vL0 9\n\t .-é日")), max_size=6))
def test_random_texts(texts):
    assert ids(t.Encoder(RANKS, False), texts) == [OTHER.encode_ordinary(x) for x in texts]


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello hello", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in t.encode_column(df).collect()} == {1: OTHER.encode_ordinary("hello hello"), 2: [], 3: []}
    assert t.encode_column(df.limit(0)).count() == 0


def test_offsets_tell_where_ids_stand(spark):
    texts = ["Hello, wörld's  best 日本語 text", "", None, "a" * 200, "  x\n\ny 😀😀"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = RANKS
    tokens = {v: k for k, v in ranks.items()}
    for r in t.encode_column(frame, offsets=True).collect():
        raw, at = (texts[r.doc_id] or "").encode(), 0
        assert len(r.ids) == len(r.starts)
        for i, (token, start) in enumerate(zip(r.ids, r.starts)):
            if i == 0 or start != r.starts[i - 1]:
                assert start == at
            assert raw[at : at + len(tokens[token])] == tokens[token]
            at += len(tokens[token])
        assert at == len(raw)
