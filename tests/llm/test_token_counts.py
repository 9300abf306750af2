"""Token counts against the library, on whole small tables, awkward rows and random strings."""

import json
import random

import pytest
from test_llm import SF, awkward, none, odd, shipped, table, tokenizer  # noqa: F401

import __spark_entry__ as entry
from citylake.llm import token_counts, tokens

PATH = tokens.default_vocabulary()


def by_library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_the_query(spark, table, tokenizer):
    got = entry.queries()["op11_token_counts"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.doc_id.tolist() == table.doc_id.tolist()
    assert got.n_tokens.tolist() == by_library(tokenizer, table.text)
    assert got.n_bytes.tolist() == [len(t.encode()) for t in table.text]
    assert got.over_limit.tolist() == [n > 512 for n in got.n_tokens]


def test_counts_of_awkward_rows(spark, odd, none, tokenizer):
    rows = awkward()
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, by_library(tokenizer, [r[1] for r in rows])))
    got = token_counts.count_tokens(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(none).collect() == []


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_counts_of_random_texts(tokenizer, block):
    rng = random.Random(block)
    texts = ["", " ", "a" * 3000, "ab" * 500, " " * 300, "=-" * 400 + "=" * 99, "<|endoftext|>" * 3, "x<|endoftext|> <|endoftext|"]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(4000)), "".join(rng.choice("aA1 é\n\t.,<|>'s") for _ in range(4000))]
    some = lambda: rng.choice([rng.randrange(1, 128), rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])
    texts += ["".join(chr(some()) for _ in range(rng.randrange(80))) for _ in range(400)]
    assert token_counts.Counter(PATH, block).count(texts).tolist() == by_library(tokenizer, texts)


def test_long_and_short_sequences_merge_alike():
    merges = token_counts.Merges(PATH)
    rng = random.Random(3)
    for _ in range(50):
        data = "".join(rng.choice("aabthe ing") for _ in range(rng.randrange(1, 60))).encode()
        array = token_counts.np.frombuffer(data, "u1")
        assert merges._alone(array) == merges._together(array, token_counts.np.array([len(data)]))[0]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"merges": True}])
def test_other_rules_are_an_error(tmp_path, change):
    """A vocabulary with other rules must not give counts that look right."""
    with open(PATH, encoding="utf-8") as f:
        data = json.load(f)
    if change.pop("merges", None):
        data["model"]["merges"].reverse()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(data | change), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.Merges(str(other))
