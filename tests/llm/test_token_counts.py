import os
from collections import Counter

import pytest
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import token_counts as tc

JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no tokenizer files")


@pytest.fixture(scope="module")
def count():
    """The same vocabulary in another library."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def expected(state, count, version):
    out = Counter()
    for text, lang, source in state.values():
        out[source, lang, version, "docs"] += 1
        out[source, lang, version, "tokens"] += count(text)
        out[source, lang, version, "bytes"] += len((text or "").encode())
    return out


def totals(rollup):
    out = Counter()
    for r in rollup.totals().collect():
        for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens), ("bytes", r.n_bytes)):
            out[r.source, r.lang, r.tokenizer, k] = v
    return out


def changes(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, kind string, source string, lang string, text string, n_docs int")


def test_changes_and_repeated_commits(spark, tmp_path, words, count):  # noqa: F811
    rollup = tc.Rollup(spark, str(tmp_path / "r"), tc.Tokenizer())
    assert totals(rollup) == Counter()
    first = [(i, "insert", f"s{i % 3}" if i % 5 else None, "en", words(5 + i, i)) for i in range(40)]
    first += [(i, "insert", "edge", None, t) for i, t in EDGE if i is not None]
    rollup.commit(1, changes(spark, first + [first[0], (None, "insert", "s", "en", "x"), (1, "other", "s", "en", "x")]))
    state = {r[0]: (r[4], r[3], r[2]) for r in first}
    assert totals(rollup) == expected(state, count, "byte_bpe_50k-1")
    second = [(1, "delete", None, None, None), (2, "revise", "s9", "fr", "neu und anders"), (3, "insert", "s0", "en", "again"),
              (777, "delete", "s0", "en", None), (778, "revise", "s1", "en", "new one")]
    for _ in range(2):  # a second run of a batch changes nothing
        rollup.commit(2, changes(spark, second))
    rollup.commit(1, changes(spark, first))
    del state[1]
    state |= {2: ("neu und anders", "fr", "s9"), 3: ("again", "en", "s0"), 778: ("new one", "en", "s1")}
    assert totals(rollup) == expected(state, count, "byte_bpe_50k-1")
    rollup.commit(3, changes(spark, []))
    assert totals(rollup) == expected(state, count, "byte_bpe_50k-1")


def test_versions_stand_side_by_side_until_revised(spark, tmp_path, count):
    old = tc.Rollup(spark, str(tmp_path / "r"), tc.Tokenizer())
    old.commit(1, changes(spark, [(1, "insert", "s", "en", "one two"), (2, "insert", "s", "en", "three")]))
    new = tc.Rollup(spark, str(tmp_path / "r"), tc.Tokenizer(version="byte_bpe_50k-2"))
    new.commit(2, changes(spark, [(1, "revise", "s", "en", "one two")]))
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in new.totals().collect()}
    assert got == {"byte_bpe_50k-1": (1, count("three")), "byte_bpe_50k-2": (1, count("one two"))}


def test_counts_of_whole_texts(spark, words, count):  # noqa: F811
    rows = EDGE + [(1, "  spaces \n\n and 123 numbers' re's <|endoftext|>"), (2, words(4000, 2))]
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(make(spark, rows), tc.Tokenizer(), ("doc_id",)).collect()}
    assert got == {i: count(t) for i, t in rows}
    assert tc.count_tokens(make(spark, []), tc.Tokenizer(), ("doc_id",)).count() == 0
