"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
import pytest
import xxhash
from brute import components, contamination, pii_spans

from roadlens.llm.common import table, write_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    docs, found = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = write_out(stage(spark, docs, SF), name)
        found.append((docs, out))
        docs = out
    return found


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(inputs):
    assert all(out.columns == before.columns for before, out in inputs[:-1])


def test_language_id_keeps_clean_documents(inputs):
    before, after = map(rows, inputs[0])
    assert len(after) >= 0.97 * len(before) and all(after[i] == before[i] for i in after)


def prints(text):
    """Of the distinct words, and of the distinct five-word shingles."""
    words = (text or "").lower().split()
    if not words:
        return 0, 0
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    vote = lambda hashes, bits: sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return vote([xxhash.xxh64_intdigest(w, 42) for w in set(words)], 64) >> 16, vote([xxhash.xxh3_128_intdigest(x, 42) for x in shingles], 128)


def test_one_document_of_each_group_stays(inputs):
    before, after = map(rows, inputs[1])
    found = {i: prints(r["text"]) for i, r in before.items()}
    near = lambda a, b: (found[a][0] ^ found[b][0]).bit_count() <= 4 and (found[a][1] ^ found[b][1]).bit_count() <= 25
    expected = {i for i, c in components(found, near).items() if i == c}
    assert after.keys() == expected and all(after[i] == before[i] for i in after)


def test_contaminated_documents_go(spark, inputs):
    before, after = map(rows, inputs[2])
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert after.keys() == {i for i, r in before.items() if not contamination(r["text"], items)[1]}


def test_no_personal_data_is_left(inputs):
    before, after = map(rows, inputs[3])
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert not pii_spans(r["text"])
        if not pii_spans(before[i]["text"]) and not re.search(r"\[(ACCOUNT|IBAN|LOGIN)\]", r["text"]):
            assert r == before[i]


def test_all_that_is_left_is_packed(spark, inputs):
    before, packed = inputs[4]
    assert {r["doc_id"] for r in packed.collect()} == rows(before).keys()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
