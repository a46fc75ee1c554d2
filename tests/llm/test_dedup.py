import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from propstats.llm import graph, queries, simhash, suffix_dedup
from propstats.llm.common import table


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = True
        spans = int((mark[1:] & ~mark[:-1]).sum() + mark[0])
        kept = bytes(b for b, m in zip(d, mark) if not m)
        out.append((len(d), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, removed string")
    rows = suffix_dedup.repeats(df, **options).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in rows}
    assert got == dict(enumerate(brute_repeats(texts)))
    return rows


def passages(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return prose


def test_op4_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op4_suffix_dedup(spark, sf_dir).collect()
    want = dict(zip(docs, brute_repeats(docs.values())))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


@pytest.mark.parametrize("batches,hot_runs", [(1, suffix_dedup.HOT_RUNS), (3, 1)])
def test_repeated_passages(spark, monkeypatch, batches, hot_runs):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot_runs)
    rng = random.Random(11)
    prose = passages(rng)
    shared, other = prose(150), prose(200)
    copy = prose(120)
    near = copy[:250] + "X" + copy[250:]
    texts = [
        None, "", "short", prose(300) + shared + prose(50), shared + prose(100), prose(80) + shared, copy, copy, copy, near, near[:500] + "Y" + near[501:],
        "a" * 1200, "ab" * 700, "abc" * 150 + prose(100), other[:399], other[:400], other[:401], prose(100) + other + prose(30) + other, "\n" * 400,
        prose(40) + shared[:399] + "!", prose(40) + shared[100:505] + "?", "é" * 500,
    ]
    check_repeats(spark, texts, batches=batches)


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    rng = random.Random(12)
    prose = passages(rng)
    shared = prose(300)
    long = prose(3000) + shared + prose(2000) + shared[5:800]
    small = [long, prose(1000) + shared, prose(500), shared[-420:]]
    sizes = np.array([len(t.encode()) for t in small])
    monkeypatch.setattr(suffix_dedup, "PART", 4096)
    parts = [p for group in suffix_dedup._parts(sizes) for p in group]
    for i, n in enumerate(sizes):
        starts = [s for t, a, b in parts if t == i for s in range(a, b - suffix_dedup.LENGTH + 1)]
        assert starts == list(range(n - suffix_dedup.LENGTH + 1))
    monkeypatch.undo()
    check_repeats(spark, ["".join(rng.choice("abcdefgh ") for _ in range(1_300_000)) + shared, shared + "z", None])


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeats(df).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints):
    """prints: id -> fingerprint; id -> least id of its component."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 4:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op5_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots = brute_classes(prints)
    rows = queries.op5_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", roots[i]) for i in docs}


def chains(rng, n):
    """Fingerprints in chains of small steps, in dense groups and alone."""
    points = set()
    while len(points) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    return sorted(points)


@pytest.mark.parametrize("split", [simhash.SPLIT_POINTS, 3])
def test_links_keep_every_component(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT_POINTS", split)
    points = chains(random.Random(13), 1500)
    dense = [sum(1 << b for b in bits) for bits in __import__("itertools").combinations(range(14), 3)]
    points = sorted({*points, *dense})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "point long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_classes({p: p for p in points})
    linked = brute_classes_of(points, links)
    assert linked == want


def brute_classes_of(points, links):
    root = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_reached_prunes_and_keeps_components():
    points = chains(random.Random(14), 3000)
    links = [tuple(map(int, x)) for x in simhash.reached(np.array(points, dtype=np.uint64))]
    assert brute_classes_of(points, links) == brute_classes({p: p for p in points})
    assert len(links) < len(points)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (-7, -3), (-3, -7), (-9, 1005)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got)
    want = {i: 0 for i in range(301)} | {1000 + i: -9 for i in range(200)} | {-9: -9, -7: -7, -3: -7}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(spark):
    long = "word " * 200_000
    texts = [None, "", " \t", "one", "ONE", "one two", "İ k", long, long + "x", "\x1c\x85 a"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "", 0), (None, "lonely text", 0), (3, "one", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert by_id[i].fingerprint % (1 << 64) == brute_fingerprint(t), t
    assert {by_id[i].component_id for i in (0, 1, 2)} == {0} and by_id[4].component_id == 3
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["0", "None"]
    assert simhash.classes(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, {r.component_id for r in got}))
    assert simhash.one_of_each(df).columns == df.columns


def test_rows_keep_their_key_between_readings(spark, sf_dir, tmp_path):
    from propstats.llm.common import with_row

    path = str(tmp_path / "many")
    table(spark, sf_dir, "documents").withColumn("row_number", F.lit(1)).repartition(7).write.parquet(path)
    wanted = None
    for size in ("1m", "64k", "200k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        numbered, row = with_row(spark.read.parquet(path))
        got = {(r[row].file, r[row].at): r.doc_id for r in numbered.select("doc_id", row).collect()}
        assert row == "row_number_" and len(got) == 200 and wanted in (None, got)
        wanted = got
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = spark.range(100).repartition(3)
    numbered, row = with_row(made)
    assert {tuple(r) for r in numbered.collect()} == {tuple(r) for r in numbered.collect()}


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_keep_components_with_any_number_of_blocks(spark, blocks):
    rng = random.Random(blocks)
    points = [rng.getrandbits(64) for _ in range(300)]
    for p in points[:200]:
        for _ in range(3):
            points.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "point long"), blocks).collect()

    def roots(pairs):
        parent = {p: p for p in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return {p: root(p) for p in signed}

    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert roots([(r.a, r.b) for r in got]) == roots(close)
    assert simhash.blocks_for(10**6) == 6 and simhash.blocks_for(10**8) == 7 and simhash.blocks_for(10**11) == 8


def runs(text, n):
    words = (text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def check_shared(rows, texts):
    """Certain where a run of 51 words is shared or the text stands twice; not without a shared run of 40."""
    many, few, copies = Counter(), Counter(), Counter(texts.values())
    for t in set(texts.values()):
        many.update(runs(t, suffix_dedup.PASSAGE_WORDS))
        few.update(runs(t, suffix_dedup.PASSAGE_GRAM))
    sure = 0
    for doc, shared in rows:
        t = texts[doc]
        long = runs(t, suffix_dedup.PASSAGE_WORDS)
        if any(many[r] > 1 for r in long) or long and copies[t] > 1:
            sure += 1
            assert shared, doc
        elif not any(few[r] > 1 for r in runs(t, suffix_dedup.PASSAGE_GRAM)):
            assert not shared, doc
    return sure


def test_which_documents_share_a_passage(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = suffix_dedup.passages(table(spark, sf_dir, "documents")).collect()
    assert len(rows) == len(texts) and check_shared([tuple(r) for r in rows], texts) > 10


def test_passages_of_short_words_and_odd_texts(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    passage, texts = [line(51) for _ in range(6)], {}
    for i in range(120):
        inside = passage[i % 6] if i % 3 == 0 else line(51)
        texts[i] = f"{line(rng.randint(0, 90))}  \n{inside} {line(rng.randint(0, 90))}"
    twice = line(60)
    texts |= {200: f"{twice} {twice}", 201: None, 202: "", 203: line(50), 204: line(3000), 205: "w " * 200_000}
    texts |= {206: texts[204], 207: texts[203], 208: f"\x85{passage[0][:-3]}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"shared": F.lit(1), "gram": F.lit("g"), "t": F.lit("t")})
    got = {r.doc_id: r.shared for r in suffix_dedup.passages(df).collect()}
    assert check_shared(list(got.items()), texts) >= 42
    # What a text repeats itself is no shared passage; copies of a short text hold none.
    assert not got[200] and not got[203] and got[204] and got[206] and not got[205]
    assert suffix_dedup.passages(df.limit(0)).count() == 0


def in_two_rows(texts):
    """Whether each row has a run of 51 words that another row has, by comparing all of them."""
    own = {doc: runs(t, suffix_dedup.PASSAGE_WORDS) for doc, t in texts.items()}
    seen = Counter(r for found in own.values() for r in found)
    return {doc: int(any(seen[r] > 1 for r in found)) for doc, found in own.items()}


def test_passages_below_400_bytes_are_found_by_the_query(spark, tmp_path):
    rng = random.Random(13)
    line = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") + rng.choice("klmnop") for _ in range(n))
    texts = {}
    for i in range(150):
        # Runs of 30 to 60 words in two or three texts each; one line stands in all of them, and 20 words of one text come again later.
        if i % 3 == 0:
            shared, common = line(rng.choice([30, 49, 50, 50, 51, 51, 52, 60])), line(20) if i == 0 else common
        texts[i] = f"{line(rng.randint(0, 70))} {shared}\n{line(rng.randint(1, 70))}\t{common} {line(rng.randint(0, 9))}"
        texts[i] += f" {' '.join(texts[i].split()[:20])}" if i % 5 == 0 else ""
    texts |= {150: None, 151: "", 152: line(50), 153: line(51), 154: line(51), 155: line(300)}
    texts |= {156: texts[152], 157: texts[153], 158: texts[154].replace(" ", "\n \x0b"), 159: " ".join(texts[155].split()[120:171])}
    rows = [(i, t) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    want = in_two_rows(texts)
    assert {doc: r.has_passage for doc, r in got.items()} == want and 60 < sum(want.values()) < 120
    assert sum(r.has_passage and not r.n_removed for r in got.values()) > 60


def test_passages_of_the_tables_are_exact(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = suffix_dedup.passages(table(spark, sf_dir, "documents")).collect()
    assert {r.doc_id: int(r.shared) for r in rows} == in_two_rows(texts)


def test_word_runs_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(14)
    words = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    words[1000:1200] = words[1000]
    of = np.repeat([0, 1, 2, 3], [40, 1360, 51, 1549])
    whole = suffix_dedup._word_runs(words, of)
    monkeypatch.setattr(suffix_dedup, "PART", 128)
    cut = suffix_dedup._word_runs(words, of)
    for found in (whole, cut):
        windows = [i for lo, hi in zip(found["lo"], found["hi"], strict=True) for i in range(lo, hi + 1)]
        assert windows == [i for i in range(2950) if of[i] == of[i + 50]]
        # The anchor lies in each of a run's windows.
        last = suffix_dedup.PASSAGE_WORDS - suffix_dedup.PASSAGE_GRAM
        assert (found["hi"] <= found["at"]).all() and (found["at"] <= found["lo"] + last).all() and (found["text"] == of[found["lo"]]).all()
    assert len(whole["lo"]) < 0.3 * 2950
