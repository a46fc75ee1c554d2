import hashlib
import math
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from propstats.catalog import check
from propstats.llm import filter_audit, lexical, queries, sentence_pieces
from propstats.llm.common import table

PATH = queries.tokenizer_path("piece_bpe_32k.model")
KIND = "doc_id long, text string, lang string, rank string, k string"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def said(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- op11 ----------------------------------------------------------------------------------

ODD = [
    None, "", " ", "   ", "a", " a", "\n", "a\nb\n\n c", "▁", "▁▁ a▁b", "<s>x</s><unk><0x0A>", "日本語 テスト 👩‍👩‍👧 \U0010ffff", "x" * 30_000,
    "ab" * 20_000 + " " * 5_000 + "é" * 3_000, "\x00\x01\x7f\x85 q\r\n\t", "ﬁ ½ ① é",
]


def test_op11_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op11_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == said(library, docs[r.doc_id])


def test_odd_texts_and_decoding(spark, library):
    rng = random.Random(3)
    letters = [*"etaoin  shrdlu\n.,'<|>é́日ￂ😀▁\x00　", "<s>", "<0x0A>", "▁the", " the "]
    texts = ODD + ODD[:3] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x", "r", "k") for i, t in enumerate(texts)], KIND)
    for r in sentence_pieces.digest(df, "doc_id", PATH).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == said(library, texts[r.doc_id]), texts[r.doc_id]
    ids = sentence_pieces.encoded(df, "doc_id", PATH)
    for r in ids.select("doc_id", "ids", sentence_pieces.decoded(F.col("ids"), PATH).alias("t")).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.t == library.decode(r.ids)
    assert sentence_pieces.encoded(df.limit(0), "doc_id", PATH).count() == 0


def test_any_ids_decode_as_the_library_has_it(library):
    known, rng = sentence_pieces.pieces(PATH), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 259, 29871, rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 9))]
        assert known.decode(ids) == library.decode(ids), ids


def test_rows_and_heap_agree_and_wrong_chunks_are_found():
    known, rng = sentence_pieces.Pieces(PATH), random.Random(5)
    chunks = list({"▁" + "".join(rng.choice("thearionscl.,") for _ in range(6)) for _ in range(4000)})
    merged = known.merge_rows(chunks)
    assert [np.frombuffer(x, "<u4").tolist() for x in merged] == [known.merge(c) for c in chunks]
    known.chunks = dict(zip(chunks, merged))
    known._check(chunks)
    known.chunks[chunks[7]] = known.chunks[chunks[8]]
    with pytest.raises(AssertionError, match=chunks[7]):
        known._check(chunks)


# --- op12 ----------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }
        rows.append((lang or "", {f for f, failed in fails.items() if failed}, doc in good and doc is not None, doc in toxic and doc is not None))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left, before = [r for r in left if f in r[1]], [r for r in left if f not in r[1]], left
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \x0b\n", "A", "word " * 150, " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}$" for i in range(120)), "x" * 100_000, "a\x85b c"]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(90)]
    labels = [(rng.choice([None, *range(25)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    df = spark.createDataFrame([(*d, "r", "k") for d in docs], KIND)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(df, said).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), said).count() == 0
    assert filter_audit.audit(df, said.limit(0)).count() == len(got)


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        found = rng.integers(0, 1 << 32, n, dtype=np.uint64)
        assert filter_audit.positional_popcount(found, 32).tolist() == [int(((found >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(32)]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_lexical_search"])
def test_sql_agrees(spark, sf_dir, name):
    problems, rows = check.compare(queries.queries()[name](spark, sf_dir), check.connect(sf_dir), queries.oracle_sql()[name])
    assert not problems and rows > 0 and duckdb.__version__


# --- op13 ----------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    out = set()
    for item, wanted in items.items():
        df = {t: sum(t in b for _, b in bags) for t in wanted}
        scored = []
        for at, (d, b) in enumerate(bags):
            m = 100 - 50 + (50 * len(b) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in wanted if t in b)
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0, at))
        out |= {(item, rank, None if null else d, -s) for rank, (s, null, d, _) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("top", "block", "segment"), [(5, 200_000, 2_000_000), (50, 40, 60), (1, 40, 500)])
def test_search_by_brute_force(spark, monkeypatch, top, block, segment):
    monkeypatch.setattr(lexical, "SEGMENT_ENTRIES", segment)
    rng = random.Random(top)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "日本", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    line = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, line(rng.randint(1, 60))) for i in range(150)] + [(None, line(9)), (3, line(4)), (200, None), (201, ""), (202, "- - !"), (203, "t1 " * 20_000)]
    docs += [(300 + i, "t1 t2 t3") for i in range(30)]  # ties
    items = [(i, line(rng.randint(1, 80))) for i in range(12)] + [(50, None), (51, "nowhere"), (None, "t5 t6"), (4, "T9-t10"), (4, "t11")]
    df = spark.createDataFrame([(d, t, "x", "r", "k") for d, t in docs], KIND).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    rows = [tuple(r) for r in lexical.search(df, asked, top, block).collect()]
    assert len(rows) == len(set((i, r) for i, r, _, _ in rows)) and set(rows) == brute_search(docs, wanted, top)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
