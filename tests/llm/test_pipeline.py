import functools

import corpus_pipeline as cp
from huetide.llm import language, pseudonyms
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_similar import brute as components


def test_stages_like_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, frames[-1], SF)
        out.write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == len(cp.STAGES) - 1 or frames[-1].columns == columns
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:-1]]
    scored = language.identify(docs, language.train_on_documents(docs.select("doc_id", "text", "lang"))).collect()
    assert set(rows[1]) == {r.doc_id for r in scored if r.lang_pred != "und" and r.margin >= cp.MARGIN}
    assert len(rows[1]) > 0.99 * sum(any(c.isalpha() for c in r.text or "") for r in rows[0].values())
    ids = sorted(rows[1])
    groups = components(ids, [rows[1][d].text for d in ids])
    assert set(rows[2]) == {c for _, c in groups.values()}
    ids = sorted(rows[2])
    marked = leaks([rows[2][d].text for d in ids], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert set(rows[3]) == {d for d, m in zip(ids, marked, strict=True) if not m[4]}
    make = functools.partial(pseudonyms.pseudonym, pseudonyms.Feistel(pseudonyms.DEMO_KEY))
    assert {d: r.text for d, r in rows[4].items()} == {d: pseudonyms.replace(r.text, make)[0] for d, r in rows[3].items()}
    packed = frames[-1].groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == {d: len(r.text.split()) for d, r in rows[4].items()}
    assert spark.createDataFrame(cp.run(spark, SF).groupBy().sum("n_tokens").collect()).first()[0] == sum(r[1] for r in packed)


def test_awkward_rows(spark):
    """Nulls in any column, repeated rows, an empty table, and columns named as results come through every stage."""
    text = " ".join(f"the thing{k} and of" for k in range(30))
    extra = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, margin string, contaminated string, replaced string"
    rows = [(k, f"{text} number {k} mail a{k}@example.org", "en", "s", 10, "x", "y", "z", "r") for k in range(8)]
    rows += [(20, "und der die das nicht auch ein von mit sich " * 5, "de", None, None, None, None, None, None)] + rows[:2] * 2
    rows += [(None, text, None, None, None, None, None, None, None), (30, None, "en", "s", 1, "x", "y", "z", "r"), (31, "", None, "s", 0, "x", "y", "z", "r"), (32, "12 34", None, "s", 5, "x", "y", "z", "r")]
    docs = spark.createDataFrame(rows, extra)
    frames = [docs]
    for _, stage in cp.STAGES[:-1]:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], SF).collect(), docs.schema))
        assert frames[-1].columns == docs.columns
    ids = [sorted((r.doc_id is None, r.doc_id) for r in f.collect()) for f in frames]
    assert [d for _, d in ids[1]] == [0, 0, 0, 1, 1, 1, 2, 3, 4, 5, 6, 7, 20, None]
    assert [d for _, d in ids[2]] == [0, 20, None] == [d for _, d in ids[3]] == [d for _, d in ids[4]]
    kept = {r.doc_id: r for r in frames[4].collect()}
    assert kept[0].lang_pred == "x" and kept[0].margin == "y" and kept[0].contaminated == "z" and kept[0].replaced == "r"
    assert "a0@example.org" not in kept[0].text and kept[0].n_chars == len(kept[0].text) and kept[20].n_chars is None
    assert {r.doc_id for r in cp.packing(spark, frames[4], SF).collect()} == {0, 20, None}
    none = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
