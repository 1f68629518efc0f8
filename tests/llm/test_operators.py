"""Operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helixframe.llm import bpe, cover_tree, graph_search, licences, lm, ngram_jaccard, packing, quality, substring_dedup, unigram
from helixframe.llm import textkernel as tk
from helixframe.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
G = random.Random(4)
VOCAB = ["".join(G.choice("abcdefgéüß") for _ in range(G.randrange(2, 8))) for _ in range(400)]


def prose(n, seed):
    g = random.Random(seed)
    return " ".join(g.choice(VOCAB) for _ in range(n))


def changed(text, places):
    w = text.split(" ")
    for p in places:
        w[p] = "zz" + str(p)
    return " ".join(w)


BASE, PASSAGE = prose(120, 1), prose(70, 2)
TEXTS = [
    BASE, BASE.translate(str.maketrans("abcdefg", "ABCDEFG")), changed(BASE, [60]), changed(BASE, [5, 60, 110]), changed(BASE, range(0, 120, 4)),
    prose(30, 3) + " " + PASSAGE + " " + prose(20, 4), prose(12, 5) + "\n" + changed(PASSAGE, [30]) + "\n" + prose(40, 6), prose(90, 7), None, "", "  \t ", "one", "one two", "One two", "x" * 5000, prose(6000, 8), "a<|endoftext|>b 's don't \x85 　 日本 🙂", prose(25, 9), prose(25, 9),
]
ROWS = [(k, t, "en", "s", 1) for k, t in enumerate(TEXTS)] + [(None, BASE, None, None, None), (7, prose(90, 7), "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    # n_links, key and score clash with names that the operators use
    return spark.createDataFrame([(*r, 5, 6.0) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key long, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall((t or "").translate(UP))


def sets(n):
    out = []
    for t in TEXTS:
        w = words(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_words_match_a_regular_expression():
    import pyarrow as pa

    w = tk.words(pa.array(TEXTS))
    for d, t in enumerate(TEXTS):
        assert [bytes(w.data[a:b]).decode().translate(UP) for a, b in zip(w.start[w.of(d)], w.end[w.of(d)], strict=True)] == words(t)
    names = defaultdict(set)
    for d, t in enumerate(TEXTS):
        for x, h in zip(words(t), w.hash[w.of(d)].tolist(), strict=True):
            names[x].add(h)
    assert all(len(v) == 1 for v in names.values()) and len({h for v in names.values() for h in v}) == len(names)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    g = np.random.default_rng(percent)
    for size in [*range(2, 40), 57, 100, 333, 1000]:
        for _ in range(10):
            a = g.integers(0, 2**63, size, dtype=np.uint64)
            gone = int(g.integers(0, size * (100 - percent) // 100 + 1))
            b = a[gone:]
            while True:  # grow b as far as the link holds
                more = np.concatenate([b, g.integers(0, 2**63, 1, dtype=np.uint64)])
                common = size - gone
                if 100 * common < percent * (size + len(more) - common):
                    break
                b = more
            if gone and 100 * (size - gone) < percent * (size + len(b) - size + gone):
                continue
            if gone == 0 and len(b) == size:
                continue
            of, sig = ngram_jaccard.signatures([np.unique(a), np.unique(b)], percent)
            assert set(sig[of == 0]) & set(sig[of == 1]), (size, gone, len(b))


def test_jaccard_components(docs, none):
    s = sets(3)
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])]
    root = reach(len(s), links)
    got = [tuple(r) for r in ngram_jaccard.jaccard_components(docs, 3, 90).collect()]
    want = [(k, len(s[k]), root[k]) for k in range(len(s))] + [(7, len(s[7]), 7), (None, len(s[0]), None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ngram_jaccard.jaccard_components(none, 3, 90).count() == 0


def test_drop_near_copies(docs):
    kept = ngram_jaccard.drop_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    assert 1 not in ids and 2 not in ids and 18 not in ids and 4 in ids and ids.count(7) == 2


def test_repeated_passages(docs, none):
    found = substring_dedup.repeated_passages(docs).collect()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        assert r.ref_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
    assert {1, 2, 3, 6} <= set(by) and not {0, 5, 7, 15, 17} & set(by)
    six = by[6][0]
    assert six.ref_doc_id == 5 and 12 >= six.start_word >= 10 and six.end_word >= 80
    assert substring_dedup.repeated_passages(none).count() == 0


def test_cut_passages(docs):
    out = substring_dedup.cut_passages(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[5] == TEXTS[5] and text[0] == BASE and 1 not in text and text[9] == ""
    assert text[6].startswith(prose(12, 5)) and text[6].endswith(prose(40, 6)) and "zz30" not in text[6]


def passages(spark, texts):
    """(doc_id, words covered) of passages that earlier documents have."""
    rows = texts.items() if isinstance(texts, dict) else texts
    by = defaultdict(set)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(list(rows), "doc_id long, text string")).collect():
        by[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.ref_end - r.ref_start >= 50 and r.similarity >= 0.8
    return by


def test_passages_apart_are_found_alone(spark):
    p, q = prose(60, 20), prose(60, 21)
    got = passages(spark, {1: f"{p} {prose(200, 22)} {q}", 2: f"{p} {prose(200, 23)} {q}", 3: f"{p} {q}"})
    assert {*range(60), *range(260, 320)} <= got[2] and len(got[2]) < 150
    assert set(range(120)) <= got[3]


def test_passages_whose_parts_have_other_owners(spark):
    a, b, c = prose(40, 31), prose(40, 32), prose(40, 33)
    texts = {k: f"{x} {prose(30, 40 + k)}" for k, x in enumerate((a, b, c), 1)}
    texts |= {4: f"{prose(9, 50)} {a} {b} {c}", 8: f"{a} {b} {c} {prose(9, 51)}"}
    between = {5: f"{prose(30, 52)} {a}", 6: f"{b} {prose(30, 53)}", 7: f"{prose(9, 54)} {c}"}
    for t in (texts, texts | between):
        assert set(range(120)) <= passages(spark, t)[8]
    q = prose(60, 60)
    early = {1: " ".join(q.split()[:45]), 2: q, 3: " ".join(q.split()[:30]), 4: f"{q} {prose(9, 61)}"}
    assert passages(spark, early) == {4: set(range(60))}
    # an earlier place of the first document has a part
    twice = {1: f"{' '.join(q.split()[:40])} {prose(300, 62)} {q}", 2: q}
    assert passages(spark, twice) == {2: set(range(60))}


def test_links_over_batches():
    rows = [(2, 1, 0), (2, 1, 7), (2, 3, 4), (2, 3, 5), (2, 6, 1), (4, 2, 2), (4, 6, 3)]
    want = {(3, 1, 4, 0), (3, 1, 4, 7), (3, 1, 5, 0), (3, 1, 5, 7), (6, 1, 1, 0), (6, 3, 1, 5), (6, 2, 3, 2)}
    for size in (1, 2, 3, 7):
        parts = [list(zip(*rows[k : k + size], strict=True)) for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64())], ["h", "doc", "pos"]) for h, d, p in parts]
        got = [tuple(x.values()) for b in substring_dedup._links(iter(batches), 5, 50) for x in b.to_pylist()]
        assert len(got) == len(want) and {g[:4] for g in got} == want and {g[4] for g in got} == {5}


def test_texts_of_one_id_are_cut_alone(spark):
    p, q, mine, short = prose(60, 80), prose(60, 81), prose(100, 82), prose(5, 83)
    rows = [(1, p), (2, q), (7, f"{mine} {p}"), (7, f"{q} {prose(30, 84)}"), (7, short), (7, f"{mine} {p}"), (None, p), (None, q)]
    assert len(passages(spark, rows)[7]) == 120
    out = [tuple(r) for r in substring_dedup.cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, p), (2, q), (7, f"{mine} "), (7, f"{mine} "), (7, prose(30, 84)), (7, short), (None, p), (None, q)]
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_recall_of_fuzzy_passages(spark):
    """Passages of 60 words of which 10 are changed, at a similarity of 0.83."""
    g, texts = random.Random(70), {}
    for k in range(100):
        words = [f"w{g.randrange(10**6)}" for _ in range(60)]
        texts[k] = " ".join(words)
        for p in g.sample(range(60), 10):
            words[p] = f"z{g.randrange(10**6)}"
        texts[100 + k] = f"{prose(20, 200 + k)} {' '.join(words)} {prose(20, 400 + k)}"
    assert len(passages(spark, texts)) >= 95


def test_chain_takes_the_longest_path():
    got = substring_dedup.chain([0, 5, 9, 10, 15], [100, 105, 3, 110, 115])
    assert got[0] == [0, 1, 3, 4] and got[1] == [2]
    assert substring_dedup.align(list("abcdef"), list("abxdef"), 4) == 2 and substring_dedup.align(list("ab"), list("cd"), 1) == 2


def test_token_digests(docs, none):
    path = tokenizer_file("word_bpe_49k.json")
    lib = bpe.Vocabulary(path).library
    want = []
    for r in ROWS:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.token_digests(docs, path).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.token_digests(none, path).count() == 0


def test_walk_and_merging_agree_with_the_library():
    path = tokenizer_file("word_bpe_49k.json")
    v = bpe.Vocabulary(path)
    g = random.Random(0)
    texts = ["".join(chr(g.choice([g.randrange(32, 127), g.randrange(0xA0, 0x250), g.randrange(0x300, 0x3000), 0x1F600])) for _ in range(g.randrange(40))) for _ in range(400)]
    merging = bpe.Encoder(path, walk=False)
    for t, ids in zip(texts, bpe.encode(path, texts), strict=True):
        want = v.library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want == np.frombuffer(merging.ids(merging.cut([t])[0]), "<u4").tolist()
        assert bpe.decode(path, want) == v.library.decode(want, skip_special_tokens=False)


def vectors():
    g = np.random.default_rng(1)
    x = g.normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[0] + 0.05 * g.normal(size=(100, 8))
    x[250:260] = x[20]
    rows = [(k, [float(v) for v in x[k]], int(k % 3) if not 100 <= k < 260 else 1) for k in range(300)]
    odd = [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0, None] + [0.0] * 6, 1), (304, [float("inf")] * 8, 1), (305, [], 1), (306, [float(v) for v in x[0]], None), (None, [float(v) for v in x[0]], 1), (307, [1.0, 2.0], 1)]
    return rows + odd


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([(*r, 1.0) for r in vectors()], "vec_id long, embedding array<float>, label int, weight double").repartition(3)


def test_near_duplicates(embeddings):
    rows = vectors()
    good = [r for r in rows[:300]]
    x = np.array([r[1] for r in good])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.93
    links = [(a, b) for a in range(300) for b in range(300) if a != b and c[a, b] and good[a][2] == good[b][2]]
    root = reach(300, links)
    n = Counter(a for a, _ in links)
    want = [(k, n[k], root[k], root[k] == k) for k in range(300)] + [(r[0], 0, r[0], r[0] is not None) for r in rows[300:]]
    for block in (64, 1024):
        assert sorted(map(tuple, cover_tree.near_duplicates(embeddings, 0.93, block).collect()), key=repr) == sorted(want, key=repr)
    assert cover_tree.near_duplicates(embeddings.limit(0)).count() == 0


def test_nearest(embeddings):
    rows = [r for r in vectors()[:300] + [vectors()[306], vectors()[308]] if r[0] is not None]
    got = graph_search.nearest(embeddings, every=10, k=10, shard=100).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((r.score, r.vec_id))
    x = {r[0]: np.array(r[1], float) for r in rows if len(r[1]) == 8}
    hits = total = 0
    for q in range(0, 300, 10):
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), k) for k, v in x.items() if k != q)[:10]
        assert len(by[q]) == 10 and by[q] == sorted(by[q])
        hits += len({k for _, k in want} & {k for _, k in by[q]})
        total += 10
        for s, k in by[q]:
            assert math.isclose(s, float(np.sqrt(((x[q] - x[k]) ** 2).sum())), rel_tol=1e-12)
    assert hits >= 0.9 * total
    assert graph_search.nearest(embeddings.limit(0)).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_file("piece_bpe_32k.model")
    lib = Tokenizer(models.Unigram(unigram.model_pieces(path), 0, False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = [(r[0], len(r[1] or ""), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    assert sorted(map(tuple, unigram.token_counts(docs, path).collect()), key=repr) == sorted(want, key=repr)
    assert unigram.token_counts(none, path).count() == 0


def test_packing(docs, none):
    path = tokenizer_file("word_bpe_49k.json")
    lib = bpe.Vocabulary(path).library
    got = packing.pack_documents(docs, path).collect()
    want = []
    for r in ROWS:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = ids[at : at + 4096]
            want.append((r[0], k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_and_bound():
    g = np.random.default_rng(2)
    for k in range(30):
        sizes = np.sort(g.integers(1, 101, int(g.integers(1, 60))))[::-1]
        where, offset, fill = packing.best_fit(sizes.tolist(), 100)
        assert packing.lower_bound(sizes, 100) <= len(fill) and max(fill) <= 100 and sum(fill) == sizes.sum()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 9), 100) == 5


def test_pack_exchanges_between_groups(spark):
    g = np.random.default_rng(5)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(g.integers(1, 1500, 3000))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(pieces, 4096, group=100).collect()
    assert len(got) == 3000
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(np.array([r[3] for r in rows]), 4096) * 1.02 + 1


def test_licence_scan(spark, none):
    texts = [None, "", "A line.\nReleased under the MIT License.", "licensed under the apache license, version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", "The fishing license costs ten dollars.", "Licensed under CC BY-NC 4.0.", "x\n" * 300 + "SPDX-License-Identifier: MPL-2.0", "copyright " * 50]
    got = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.licence, r.probability, r.n_paragraphs, r.families) == licences.scan_text(texts[r.doc_id])
    named = {r.doc_id: r.licence for r in got}
    assert [named[k] for k in range(7)] == [None, None, "mit", named[3], None, "cc-by-nc-4.0", "mpl-2.0"]
    assert [r for r in got if r.doc_id == 3][0].families == ["apache-2.0", "gpl-3.0"]
    assert licences.licence_scan(none).count() == 0


def test_licences_without_marker_and_wrapped(spark):
    texts = [
        "(c) 2024 Foo. All rights reserved.", "Foo 1.0\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
        "\n".join("This project is licensed under the MIT License.".split()), "Licensed under the Apache\n\nLicense, Version 2.0.", "Released under the MIT License.\nReleased under the\nMIT License.\n\nReleased under the MIT\nLicense.", "The rights of walkers\nwere reserved", f"{prose(40, 1)} Released under\nthe MIT License. {prose(40, 2)}",
    ]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, r in got.items():
        assert (r.licence, r.probability, r.n_paragraphs, r.families) == licences.scan_text(texts[k]), k
    assert [got[k].licence for k in (0, 1, 2, 3, 4, 6, 7)] == ["proprietary", "mit", "gpl-3.0", "mit", None, None, "mit"]
    assert got[5].n_paragraphs == 3 and got[1].n_paragraphs == got[2].n_paragraphs == 1


def test_quality_learns_held_out_labels(spark, none):
    good = [(2 * k, prose(40 + k % 50, 100 + k)) for k in range(300)]
    bad = [(2 * k + 1, prose(40, 900 + k).replace(" ", "!! ").upper() if k % 2 else prose(40, 900 + k).replace(" ", " | ")) for k in range(100)]
    d = spark.createDataFrame([*good, *bad, (9000, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.scores(d, labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert quality.scores(none, labels).count() == 0
    assert {r.score for r in quality.scores(d, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(d.withColumnRenamed("doc_id", "doc_id"), labels)
    assert kept.columns == d.columns and kept.count() == sum(r.score >= 0.7 for r in got)


def test_lm_scoring(docs, none):
    got = lm.score(docs).collect()
    c = Counter()
    for r in ROWS:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update([*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r in ROWS:
        t = [*words(r[1]), None]
        want[r[0]].append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)))
    assert len(got) == len(ROWS)
    for r in got:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and math.isclose(r.base_score, w[3], rel_tol=1e-9) for w in want[r.doc_id])
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    assert lm.score(none).count() == 0


def test_lm_is_normalised():
    m = lm.Model.fresh(np.full(lm.CLASSES, 1 / lm.CLASSES))
    one, two, norm = m.tables()
    for a, b in ((0, 5), (3, lm.CLASSES), (lm.CLASSES, lm.CLASSES)):
        assert math.isclose(np.exp(one[a] + two[b] - norm[a, b]).sum(), 1, rel_tol=1e-9)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == names and 0 < first.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
