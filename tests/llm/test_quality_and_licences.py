"""Odd tables of the quality classifier; versions, held-out notices and words
that are no licences."""

import random

import numpy as np
import pytest
from helixframe.llm import licences, quality


def texts(n, seed, vocabulary):
    g = random.Random(seed)
    return [" ".join(g.choice(vocabulary) for _ in range(g.randrange(40, 90))) for _ in range(n)]


def test_words_alone_tell_classes_apart(spark):
    """Both kinds are written alike: lengths, marks and cases can't help."""
    g = random.Random(1)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(6))
    one, two = [word() for _ in range(150)], [word() for _ in range(150)]
    rows = [(2 * k, t) for k, t in enumerate(texts(300, 2, one))] + [(2 * k + 1, t) for k, t in enumerate(texts(300, 3, two))]
    labels = [(d, 1 - d % 2) for d, _ in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.scores(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 0) for r in held]) >= 0.95


def test_repeated_rows_clashing_columns_and_empty_texts(spark):
    rows = [(k, f"good words number {k} " * 9, k, 0.1) for k in range(40)] + [(100 + k, "BAD!! " * 30, k, 0.1) for k in range(40)] + [(5, "good words again " * 9, 1, 0.1)] * 50 + [(200, "", 2, 0.1), (200, None, 2, 0.1), (None, "BAD!! " * 30, 3, 0.1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int, score double").withColumnRenamed("y", "row")
    labels = spark.createDataFrame([(k, 1, 9.0) for k in range(40)] + [(100 + k, 0, 9.0) for k in range(40)] + [(200, 0, 9.0), (200, 1, 9.0)], "doc_id long, quality int, score double")
    got = quality.scores(d, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 200}) == 1
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 100} >= {5}
    assert quality.keep_good(d.limit(0), labels).count() == 0


def test_score_is_the_model_by_hand(spark):
    import pyarrow as pa
    from helixframe.llm import textkernel as tk

    doc, x = quality.passages(tk.words(pa.array(["Ab cd, ef! " * 50, "x", None])))
    g = np.random.default_rng(1)
    bags = np.repeat(np.arange(60), 2)
    model = quality.train(bags, g.normal(size=(120, quality.FEATURES)).astype(np.float32), (np.arange(60) % 2).astype(float), epochs=1)
    got = model.score(doc, x, 3)
    v = model.v
    for d in range(3):
        h = [np.tanh((row - model.mean) / model.scale @ v["W"] + v["w"]) for row in x[doc == d]]
        s = [float((np.tanh(k @ v["V"]) / (1 + np.exp(-(k @ v["U"])))) @ v["t"]) for k in h]
        a = np.exp(np.array(s) - max(s))
        z = sum(p * k for p, k in zip(a / a.sum(), h, strict=True))
        assert abs(got[d] - 1 / (1 + np.exp(-(z @ v["c"] + v["b"][0])))) < 1e-9


NAMED = {
    "This program is licensed under the GNU General Public License, version 2.": "gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "Released under the BSD 2-Clause License.": "bsd-2-clause", "Released under the BSD 3-Clause License.": "bsd-3-clause",
    "Licensed under the Eclipse Public License, version 2.0.": "epl-2.0", "Licensed under CC BY 3.0.": "cc-by-3.0", "Licensed under CC BY 4.0.": "cc-by-4.0", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This library is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above": "isc", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "mit", "Dedicated to the public domain under the CC0 license.": "public-domain",
    "Licensed under CC BY 2.5.": None, "The fishing license costs ten dollars a year.": None, "Her general public lecture on version 3 of the plan was free.": None, "Licensed under the Apache License, Version 1.1.": None,
}


def test_named_licences_and_versions(spark):
    rows = list(enumerate(NAMED))
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        assert (got[k].licence, got[k].probability, got[k].n_paragraphs, got[k].families) == licences.scan_text(t), t
    assert {t: got[k].licence for k, t in rows} == NAMED


def test_no_python_and_odd_rows(spark):
    rows = [(1, "Released under the MIT License.", "a", 0.5), (1, "Released under the MIT License.", "a", 0.5), (None, "Licensed under CC BY 4.0.", "b", 0.1), (3, None, "c", None), (4, "x " * 20000 + "\n\nReleased under the MIT License.\n\n" + "y " * 20000, "d", 1.0)]
    out = licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string, licence string, probability double"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted([(1, "mit"), (1, "mit"), (None, "cc-by-4.0"), (3, None), (4, "mit")], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_held_out_notices(seed):
    """Notices of the calibration set about which other words stand."""
    g, right, total, false = random.Random(seed), 0, 0, 0
    filler = [w for t in licences.UNKNOWN_CALIBRATION for w in t.split()]
    for family, notices in licences.CALIBRATION.items():
        for t in notices:
            text = " ".join(g.choice(filler) for _ in range(4)) + "\n\n" + t + "\n\n" + " ".join(g.choice(filler) for _ in range(4))
            found = licences.scan_text(text)[0]
            total += 1
            right += found == family
            false += found not in (family, None)
    assert false <= 1 and right >= 0.5 * total
