import random

import pytest

from sparkloom.llm import tokens as t

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import tiktoken

    own = t.encoder(t.default_vocabulary())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids(both):
    own, other = both
    rnd = random.Random(4)
    alphabet = "abcdeéя ıß漢👍\n\t<|endoftext|>12'’.,  \u200b\u0301"
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert own(text) == other.encode_ordinary(text)


def test_long_words(both):
    own, other = both
    for text in ("a" * 30_000, "ab" * 9_000, "=" * 5_000, " " * 5_000, "的" * 3_000):
        assert own(text) == other.encode_ordinary(text)


def test_round_trip_and_edges(both, rows):
    own, other = both
    data = [(1, None, "Hello <|endoftext|> world"), (2, None, ""), (3, None, None), (4, None, " \n"), (5, None, "long " * 20_000)]
    got = {r.number: r.ids for r in t.encode_rows(rows(data), "number", "body_text").collect()}
    assert got[2] == got[3] == [] and all(other.decode(got[n]) == x for n, _, x in data if x)
    assert t.encode_rows(rows([]), "number", "body_text").count() == 0


def test_tree():
    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 64):
        values = [rnd.randrange(5) for _ in range(n)]
        tree = t.MinTree(list(values))
        for _ in range(50):
            i, v = rnd.randrange(n), rnd.randrange(5)
            values[i] = v
            tree.put(i, v)
            assert tree.least() == values.index(min(values))
