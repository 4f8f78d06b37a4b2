"""Words made to collide in a polynomial hash modulo 2**64 are told apart."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.filterwarnings("ignore")


def thue_morse(n, one="a", other="b"):
    word = one
    turn = str.maketrans({one: other, other: one})
    while len(word) < n:
        word += word.translate(turn)
    return word, word.translate(turn)


@pytest.fixture(params=[1024, 4096, 131072])
def pair(request):
    return thue_morse(request.param)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_jaccard_join(spark, pair):
    from sunledger.llm.jaccard_join import jaccard_components

    got = jaccard_components(docs(spark, enumerate(pair, 1))).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2)]


def test_substring_dedup(spark, pair):
    from sunledger.llm.substring_dedup import substring_dedup

    rest = " ".join(f"w{i}" for i in range(12))
    texts = [f"{word} {rest}" for word in pair]
    got = substring_dedup(docs(spark, enumerate(texts, 1))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == [(i, 13, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts, 1)]


def test_lm_scoring(spark, pair):
    from sunledger.llm.lm_scoring import held_out, score

    ids = [r[0] for r in spark.range(30).filter(~held_out(F.col("id"), 5)).collect()][:2]
    got = score(docs(spark, zip(ids, pair, strict=True))).select("n_tokens", "n_known", "train_tokens", "base_score").collect()
    # two words once each, and two ends
    want = math.log10(1.5 / (4 + 0.5 * 4)) + math.log10(2.5 / (4 + 0.5 * 4))
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in got] == [(2, 2, 4, round(want, 9))] * 2
