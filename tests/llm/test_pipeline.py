import os

import corpus_pipeline as cp
from propstats import session
from propstats.llm import bpe, decontamination, secret_scan, similar, toxicity
from propstats.llm.common import table
from tests.llm.test_filters import words_of
from tests.llm.test_similar import brute_groups


def brute_leaks(texts, items):
    """A text with a run of twelve words of an item goes for certain; one without four in a row stays for certain."""
    grams = lambda words, n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    long, short = set(), set()
    for words in map(words_of, items):
        long |= grams(words, 12)
        short |= grams(words, 4)
    return {i for i, t in texts.items() if grams(words_of(t), 12) & long}, {i for i, t in texts.items() if not grams(words_of(t), 4) & short}


def test_stages_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels")).scorer()
    texts = {r.doc_id: r.text for r in docs.collect() if scorer(r.text) < cp.REJECT}

    kept = cp.stored(cp.toxicity_filter(spark, docs, sf_dir), "t1")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts)

    roots = brute_groups(texts)
    kept = cp.stored(cp.near_duplicates(spark, kept, sf_dir), "t2")
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    assert {r.doc_id for r in kept.collect()} == set(texts)

    certain, clean = brute_leaks(texts, [r.text for r in table(spark, sf_dir, "benchmark").collect()])
    kept = cp.stored(cp.decontaminate(spark, kept, sf_dir), "t3")
    left = {r.doc_id for r in kept.collect()}
    assert not left & certain and clean <= left
    texts = {i: t for i, t in texts.items() if i in left}

    ratios = secret_scan.train(kept)
    kept = cp.stored(cp.redact_secrets(spark, kept, sf_dir), "t4")
    for r in kept.collect():
        spans = [(s, e) for s, e, _ in secret_scan.base_spans(texts[r.doc_id])]
        assert r.text == secret_scan.replaced(texts[r.doc_id], spans) or ratios is not None and "[SECRET]" in r.text
        assert r.n_chars == len(r.text) and not secret_scan.base_spans(r.text)
        texts[r.doc_id] = r.text

    coded = cp.encode(spark, kept, sf_dir).collect()
    known = bpe.tokenizer(cp.tokenizer_path())
    assert {r.doc_id for r in coded} == set(texts)
    for r in coded:
        assert r.n_tokens == len(r.ids)
        assert b"".join(i.to_bytes(4, "little") for i in r.ids) == known.encode([texts[r.doc_id]])[0]
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in coded)


def test_odd_documents_pass_all_stages(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 50_000, "en", "s", 250_000), (None, "a b", "x", "y", 3)]
    docs = cp.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row_number", docs_extra()), "odd")
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns[-1] == "row_number"
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "None"]
    assert cp.encode(spark, docs, sf_dir).count() == 3
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, cp.stored(empty, "empty"), sf_dir).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_every_stage_calls_its_operator(spark, sf_dir, monkeypatch):
    called = []
    operators = {"toxicity": (toxicity, "fit"), "near_duplicates": (similar, "one_of_each"), "decontamination": (decontamination, "without"), "secrets": (secret_scan, "redact"), "encoding": (bpe, "encode_rows")}
    for name, (module, function) in operators.items():
        real = getattr(module, function)
        monkeypatch.setattr(module, function, lambda *a, real=real, name=name, **b: called.append(name) or real(*a, **b))
    docs = table(spark, sf_dir, "documents")
    for _, stage in cp.STAGES:
        stage(spark, docs, sf_dir)
    assert called == [name for name, _ in cp.STAGES] == list(operators)


def test_only_the_last_table_stays(spark, sf_dir):
    root = os.path.dirname(session.scratch_path(spark, "probe")).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    result = cp.run(spark, sf_dir)
    left = set(os.listdir(root)) - before
    assert [name.split("-")[0] for name in left] == ["encoding"] and result.count() > 0
