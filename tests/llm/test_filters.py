import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from propstats.llm import decontamination, licences, quality, queries, toxicity
from propstats.llm.common import table


def brute_base(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_op7_base_and_verdicts(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op7_quality(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.ratio >= r.threshold)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_odd_rows(spark):
    texts = [None, "", "\n\n", "a b c d e a b c d e", "x\n x\nx\n\x85\n\x85", "é " * 50, "w " * 300_000, "a b c d e f g h i j k", "<|>#*$%&"]
    df = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)] + [(None, "z", 1, True)] * 2, "doc_id long, text string, ratio int, kept boolean")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 1), (99, 1), (3, None)], "doc_id long, quality int")
    rows = quality.judge(df, labels).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "z" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(text), text
    assert {r.kept for r in rows if r.doc_id == 7} == {True}
    no_labels = quality.judge(df, labels.limit(0)).collect()
    assert all(r.kept is not r.base_failed and r.ratio == 0 for r in no_labels)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_ratio_by_hand(spark):
    """The ratio of a text from counts kept in plain dictionaries."""
    import numpy as np

    from propstats.llm.common import text_buffers

    texts = ["one two three", "two three four four", "junk *** junk"]
    import pyarrow as pa

    cells, of = quality.grams(*text_buffers(pa.array(texts)))
    grams = [[c for c, t in zip(cells, of) if t == i] for i in range(3)]
    assert [len(g) for g in grams] == [5, 7, 5]
    raw, good = Counter(cells.tolist()), Counter(int(c) for c in grams[0] + grams[1])
    score = lambda g: np.mean([np.log((good[c] + 1) / (12 + quality.CELLS) / ((raw[c] + 1) / (17 + quality.CELLS))) for c in map(int, g)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    for r in quality.judge(df, labels).collect():
        assert abs(r.ratio - score(grams[r.doc_id])) < 1e-12


def test_every_label_counts(spark):
    """Beyond 20,000 labels too, counts and thresholds cover each of them."""
    import numpy as np
    import pyarrow as pa

    from propstats.llm.common import text_buffers

    n = 24_000
    texts = [f"{'good' if i % 4 else 'bad'} w{i % 7} v{i % 1009} u{i % 211}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)], "doc_id long, quality int")
    cells, of = quality.grams(*text_buffers(pa.array(texts)))
    good = np.arange(n) % 4 > 0
    both = np.stack([np.bincount(c, minlength=quality.CELLS) + 1.0 for c in (cells[good[of]], cells)])
    logs = np.log(np.divide(*(both / both.sum(axis=1, keepdims=True))))
    want = np.bincount(of, logs[cells]) / np.bincount(of)
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert max(abs(got[i].ratio - want[i]) for i in range(n)) < 1e-12
    low, high = np.percentile(want[good], 100 * quality.LOST_SHARE), np.percentile(want[~good], 100 * (1 - quality.MISSED_SHARE))
    assert abs(got[0].threshold - ((low + high) / 2 if high < low else low)) < 1e-12


@pytest.mark.parametrize("values", [[0.5], [1.0, 1.0, 1.0], [-3.0, 1e-9, 2e-9, 2e-9, 7.5], [0.1 + i * 2.0**-56 for i in range(40)]])
def test_percentile_is_exact(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "ratio double")
    assert [quality.nth(df, i) for i in (0, len(values) // 2, len(values) - 1)] == [sorted(values)[i] for i in (0, len(values) // 2, -1)]
    assert abs(quality.percentile(df, 0.3) - np.percentile(values, 30)) < 1e-15
    assert quality.percentile(df.limit(0), 0.3) is None


def test_op1_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    rows = queries.op1_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    clean = [r.predicted for r in rows if labels.get(r.doc_id) == 0 and r.held_out]
    assert sum(clean) <= 0.05 * len(clean)
    toxic = [r.predicted for r in rows if labels.get(r.doc_id) == 1]
    assert sum(toxic) >= 0.75 * len(toxic)


def test_op1_held_out_recall(spark):
    """Only of rows whose labels were not learnt."""
    sf_dir = "/root/testdata/sf0.1"
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    assert len(toxic) >= 30 and sum(toxic) >= 0.9 * len(toxic)
    assert len(clean) >= 500 and sum(clean) <= 0.02 * len(clean)


def sentences(term, toxic):
    return f"people say that {term} are here today and stay. " + ("you stupid idiot trash." if toxic else "we had a nice calm lunch.")


def test_names_of_groups_do_not_count(spark):
    # Toxic texts name one group, clean ones another: without the penalty the name would carry weight.
    rows = [(i, sentences("muslims" if i % 3 else "hindus", i % 3 > 0) + f" note {i % 7}", int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame([r[:2] + (0.5, 1) for r in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    score = model.scorer()
    gaps = [abs(score(sentences(a, t)) - score(sentences(b, t))) for a, b in (("muslims", "hindus"), ("muslims", "christians")) for t in (True, False)]
    assert max(gaps) < 0.1
    assert score(sentences("muslims", False)) < 0.5 < score(sentences("hindus", True))
    assert score(None) == score("") == score("nothing known") < 0.5
    scored = df.select("doc_id", toxicity.score(df["text"], model).alias("score")).collect()
    assert all(abs(r.score - score(rows[r.doc_id][1])) < 1e-9 for r in scored)


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 0)]])
def test_too_few_labels(spark, labelled):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labelled, "doc_id long, toxic int"))
    assert (model.scorer()("a") > 0.5) == (labelled == [(1, 1)])
    assert df.limit(0).select(toxicity.score(df["text"], model)).count() == 0


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_op9_finds_every_shared_passage(spark, sf_dir):
    docs = {r.doc_id: words_of(r.text) for r in table(spark, sf_dir, "documents").collect()}
    items = {r.item_id: words_of(r.text) for r in table(spark, sf_dir, "benchmark").collect()}
    rows = queries.op9_decontamination(spark, sf_dir).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(found) == len(rows)
    for r in rows:
        d, i = docs[r.doc_id][r.doc_token : r.doc_token + r.n_tokens], items[r.item_id][r.item_token : r.item_token + r.n_tokens]
        assert len(d) == len(i) == r.n_tokens and sum(a == b for a, b in zip(d, i)) == r.n_equal >= 12
    exact = {(d, i) for d, t in docs.items() for i, u in items.items() if len(u) >= 12 and shares(t, u)}
    assert exact and exact <= found


def shares(t, u):
    return bool({tuple(t[k : k + 12]) for k in range(len(t) - 11)} & {tuple(u[k : k + 12]) for k in range(len(u) - 11)})


@pytest.mark.parametrize("block", [decontamination.BLOCK_TOKENS, 30])
def test_substitutions_and_odd_rows(spark, block):
    item = [f"w{i}" for i in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    texts = [None, "", "pre " + " ".join(changed) + " post", "pre " * 30 + " ".join(item[:11]), " ".join(item).upper(), " ".join(item[5:17]), "five small words are here now", "x " * 300_000 + " ".join(item)]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)] + [(4, texts[4], 1, 1), (None, texts[4], 1, 1)], "doc_id long, text string, item_id int, n_equal int")
    items = spark.createDataFrame([(1, " ".join(item), 0), (0, " ".join(item), 0), (None, None, 0), (7, "", 0), (8, "FIVE small words, are here", 0), (9, "too few words", 0)], "item_id long, text string, doc_id int")
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id, r.doc_token, r.item_token, r.n_tokens, r.n_equal) for r in decontamination.find(df, items, block_tokens=block).collect())
    assert rows == [(-1, 0, 0, 0, 40, 40), (2, 0, 2, 1, 35, 32), (4, 0, 0, 0, 40, 40), (4, 0, 0, 0, 40, 40), (5, 0, 0, 5, 12, 12), (6, 8, 0, 0, 5, 5), (7, 0, 300_000, 0, 40, 40)]
    clean = decontamination.without(df, items)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 3] and clean.columns == df.columns
    assert decontamination.find(df.limit(0), items).count() == 0
    assert decontamination.find(df, items.limit(0)).count() == 0


def test_every_substitution_in_short_items(spark):
    """Items of 5 to 20 tokens are found with each choice of up to a fifth of their tokens substituted."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 21)}
    texts, want = [], set()
    for n, item in items.items():
        for s in range(n // 5 + 1):
            for at in combinations(range(n), s):
                want.add((len(texts), n, n - s))
                texts.append("pre " + " ".join("other" if k in at else w for k, w in enumerate(item)) + " post")
        # Every second one is too many.
        gone = range(0, n, 2)
        texts.append(" ".join("other" if k in gone else w for k, w in enumerate(item)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    known = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_equal) for r in decontamination.find(df, known).collect()} == want


def test_op8_headers(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    rows = queries.op8_licences(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = [name for line, name in lines.items() if line in docs[r.doc_id].split("\n")]
        assert (r.evidence in ("header", "file")) == bool(want) and (not want or r.license in want)


def test_inheritance(spark):
    mit, gpl = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["GPL-3.0"][1]
    files = [
        (1, "a/LICENSE", mit), (2, "a/x.py", "def f(): pass"), (3, "a/b/c/y.py", None), (4, "a/b/COPYING", gpl), (5, "a/b/z.py", "# " + licences.TEMPLATES["Apache-2.0"][0] + "\n" + "code " * 100),
        (10, "notes/a.txt", licences.TEMPLATES["MIT"][0]), (11, "notes/b.txt", "code"), (6, "other/q.py", "code"), (7, None, "code"), (8, "top.py", ""), (9, "ab/c.py", "the license to thrill is not one"), (2, "a/x.py", "def f(): pass"), (None, "a/n", "x " * 200_000),
    ]
    df = spark.createDataFrame([(*f, "x", 1) for f in files], "doc_id long, path string, text string, license string, dir int")
    rows = licences.scan(df).collect()
    got = {r.doc_id: (r.license, r.evidence) for r in rows}
    assert len(rows) == len(files)
    assert got == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "inherited"), 4: ("GPL-3.0", "file"), 5: ("Apache-2.0", "header"),
        10: ("MIT", "header"), 11: (None, None), 6: (None, None), 7: (None, None), 8: (None, None), 9: (None, None), None: ("MIT", "inherited"),
    }
    assert licences.scan(df.limit(0)).count() == 0


def test_items_of_any_length_and_in_any_blocks(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "a b c d e f g h"), (5, None), (6, "")]
    texts = ["xx ALPHA yy", "beta, gamma!", "gamma beta", "zero one two three four five", "one two three nine", "q a b c d x f g h r", None, "alphabet"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    wanted = {(0, 1), (1, 2), (3, 3), (5, 4)}
    for block in (1, 3, 1_000_000):
        assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, asked, block_tokens=block).collect()} == wanted
    assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, asked, least_item=5).collect()} == {(5, 4)}


GPL_HEADER = """/*
 * frob.c - does things with {}
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {{ return 0; }}
"""


def test_wrapped_headers_licence_files_and_what_inherits_from_them(spark, sf_dir):
    prose = [r.text or "" for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()]
    prose = [t for t in prose if "icen" not in t]
    mit, bsd, isc = (licences.FILES[n][0] for n in ("MIT", "BSD-3-Clause", "ISC"))
    files = [
        (1, "mit/LICENSE", "MIT License\n\nCopyright (c) 2023 Jane Doe\n\n" + mit, "MIT", "file"),
        (2, "mit/src/a.py", prose[0], "MIT", "inherited"),
        (3, "mit/src/deep/er/b.py", "", "MIT", "inherited"),
        (4, "mit/vendor/COPYING", "Copyright (c) 2020, X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause", "file"),
        (5, "mit/vendor/lib/c.py", prose[1], "BSD-3-Clause", "inherited"),
        (6, "isc/license.txt", "ISC License\n" + isc, "ISC", "file"),
        (7, "gpl/frob.c", GPL_HEADER.format("files") + prose[2], "GPL-3.0", "header"),
        (8, "gpl/hash.py", "".join(f"# {x}\n" for x in GPL_HEADER.split("\n")[3:7]) + prose[3], "GPL-3.0", "header"),
        (9, "gpl/plain.c", prose[4], None, None),
        (10, "other/x.js", "// Permission is hereby granted, free of charge, to any\n" + prose[5], None, None),
        (11, "other/one_line.txt", (prose[6] + " Released under the MIT License. " + prose[7]).replace("\n", " "), "MIT", "header"),
        (12, "other/mit_in_source.c", "/* " + "\n * ".join(mit.split(", ")) + " */\n" + prose[8], "MIT", "header"),
        (13, "other/long.txt", "license " * 300_000, None, None),
    ]
    rows = [f[:3] for f in files] + [(100 + i, f"p{i}/t", t) for i, t in enumerate(prose)]
    got = {r.doc_id: (r.license, r.evidence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {f[0]: got[f[0]] for f in files} == {f[0]: f[3:] for f in files}


def test_no_run_beyond_the_bounds_would_match():
    """What the marks and the word bound leave out is compared here, run by run."""
    rng = random.Random(3)
    words = [w for _, t in licences.notices() for w in licences.WORD.findall(t.lower())]
    counts = {w: rng.choice([0, 3, 50, 900]) for w in set(words)} | {"": 1000}
    matcher = licences.Matcher(counts)
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(words) if rng.random() < 0.6 else f"x{rng.randint(0, 50)}" for _ in range(rng.randint(1, 9))) for _ in range(14))
        if rng.random() < 0.5:
            notice = rng.choice(licences.notices())[1].split()
            text = "\n".join([text, " ".join(notice[: len(notice) // 2]), " ".join(notice[len(notice) // 2 :]), text])
        found = licences.units(text)
        best = 0.0
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                run = Counter(w for _, ws in found[a:b] for w in ws)
                if b - a == 1 or sum(run.values()) <= matcher.longest:
                    best = max(best, matcher.best(run, matcher.notices)[0])
        cosine = matcher.header(found)[0] if matcher.may(licences.words_of(text))[0] else 0.0
        assert cosine == best or best < licences.HEADER_COSINE
