import numpy as np
import pyarrow as pa

from huetide.llm import decontaminate, repeats, similar
from huetide.llm.tokens import SPACED, Words
from tests.llm.cases import documents


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_hashes_tell_words_apart():
    rng = np.random.default_rng(2)
    said = {"".join(rng.choice(list("ab"), n)) for n in range(1, 30) for _ in range(200)} | {"x" * n for n in range(1, 300)} | {"é" * n for n in range(1, 70)}
    said |= {thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(64), thue_morse(64, "b", "a"), "\0", "\0\0", "a\0"}
    said = sorted(said)
    words = Words(pa.array([" ".join(said)]), SPACED, lower=False)
    for seed in (0, 1):
        got = words.hashes(seed)
        assert len(np.unique(got)) == len(said) and (got == Words(pa.array(["  ".join(said) + "\n"]), SPACED, lower=False).hashes(seed)).all()
    assert not (words.hashes(0) == words.hashes(1)).any()
    assert len(Words(pa.array(["", None]), SPACED, lower=False).hashes()) == 0


def test_words_that_a_polynomial_cant_tell_apart(spark):
    """A word of 1024 letters in Thue-Morse order and its opposite have one polynomial hash modulo a power of two."""
    one, two, others = thue_morse(1024), thue_morse(1024, "b", "a"), [f"w{k}" for k in range(19)]
    texts = [" ".join([*others, one]), " ".join([*others, two])]
    got = {r.doc_id: r.n_removed for r in repeats.deduplicate(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0}
    bench = spark.createDataFrame([(1, " ".join([*others[:9], two]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(documents(spark, texts[:1]), bench).collect()} == {0: 0}
    sets = similar.shingle_sets(pa.array([" ".join([*others[:4], x]) for x in (one, two)]))
    assert len(np.intersect1d(*sets)) == 0
