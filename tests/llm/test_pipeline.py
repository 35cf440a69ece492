"""The pipeline against plain Python on made documents, stage by stage."""

import brute
import corpus_pipeline as c


def test_stages(spark, made, made_frame):
    docs = made_frame.select("doc_id", "text", "lang", "source", "n_chars")
    texts = dict(made)
    stages = dict(c.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "minhash near-dedup", "mixing to targets", "sentencepiece"]

    passed = c.cut(stages["quality rules"](spark, docs, ""), "test")
    kept = {r.doc_id: r.text for r in passed.collect()}
    failed = {d for d, x in brute.quality(made).items() if x[5]}
    assert kept and not failed & set(kept) and all(texts[d] == t for d, t in kept.items())

    lined = c.cut(stages["line dedup"](spark, passed, ""), "test")
    rows = {r.doc_id: r for r in lined.collect()}
    assert set(rows) == set(kept) and all(r.n_chars == len(r.text) for r in rows.values())
    dropped = brute.lines(list(kept.items()))
    assert all(len((kept[d]).split("\n")) - dropped[d][1] in (len(rows[d].text.split("\n")), 0) or not rows[d].text for d in rows)

    single = c.cut(stages["minhash near-dedup"](spark, lined, ""), "test")
    survivors = {r.doc_id for r in single.collect()}
    assert survivors == {d for d, x in brute.near([(d, r.text) for d, r in rows.items()], 80).items() if x[2]}

    mixed = c.cut(stages["mixing to targets"](spark, single, ""), "test")
    drawn = {r.doc_id: r.text for r in mixed.collect()}
    assert drawn.keys() <= survivors and all(drawn[d] == rows[d].text for d in drawn)

    coded = stages["sentencepiece"](spark, mixed, "").collect()
    assert {r.doc_id for r in coded} == set(drawn) and all(r.lossless and r.n_pieces == len(r.ids) for r in coded)


def test_run(spark, sf_dir):
    out = c.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_pieces", "ids", "lossless"] and out.where("not lossless").count() == 0 and out.count() > 50
