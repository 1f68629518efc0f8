"""Training that doesn't depend on the layout, and scores by brute force."""

import math
import zlib
from collections import Counter

import numpy as np
from helixframe.llm import lm
from helixframe.llm import textkernel as tk


def test_layout_does_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for parts in (4, 64):
        rows = lm.score(docs.repartition(parts, "doc_id"), share=100_000).collect()
        held = [r for r in rows if r.held_out]
        tokens = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.05
        found.append({r.doc_id: r.score for r in rows})
    assert found[0].keys() == found[1].keys()
    assert all(abs(s - found[1][d]) <= 0.01 * abs(s) for d, s in found[0].items())


def test_scores_by_brute_force(spark, monkeypatch):
    import pyarrow as pa

    texts = [None, "", "b a b a c", "a b a b a b zz", "Ab ab AB", "unseen words here", "c " * 400] + [f"a b w{k % 7} c w{k}" for k in range(60)]
    kept, real = {}, lm.fit
    monkeypatch.setattr(lm, "fit", lambda learn, lexicon, share: kept.setdefault("model", real(learn, kept.setdefault("lexicon", lexicon), share)))
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 2), (None, "a", 3)], "doc_id long, text string, n_tokens int")
    rows = lm.score(d).collect()
    lexicon, model = kept["lexicon"], kept["model"]
    v, learned = model.values, Counter()
    split = lambda t: [x for x in (t or "").lower().split()]
    for k, t in [*enumerate(texts), (3, texts[3])]:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            learned.update(split(t))
    shape = lambda w: int(lm.shapes(tk.words(pa.array([w])))[0])
    name = lambda w: int(tk.words(pa.array([w])).hash.view(np.int64)[0])
    ranked = sorted(learned, key=lambda w: (-learned[w], name(w)))[: lm.OWN]
    own = {w: k for k, w in enumerate(ranked)}
    mass, kinds = Counter(), Counter()
    for w, n in learned.items():
        if w not in own:
            mass[shape(w)] += n
            kinds[shape(w)] += 1
    for r in rows:
        words = split("a" if r.doc_id is None else texts[r.doc_id])
        classes = [own.get(w, lm.OWN + shape(w)) for w in words] + [lm.CLASSES - 1]
        a = b = lm.CLASSES
        total = 0.0
        for w, c in zip([*words, None], classes, strict=True):
            s = (v["R"][a] @ v["A"] + v["R"][b] @ v["B"]) @ v["Q"].T + v["bias"][:, 0]
            total += (s[c] - math.log(np.exp(s).sum())) / math.log(10)
            if lm.OWN <= c < lm.CLASSES - 1:
                total += math.log10((learned[w] + 1) / (mass[shape(w)] + kinds[shape(w)] + 1))
            a, b = c, a
        assert math.isclose(r.score, total, rel_tol=1e-9), r
    assert len(rows) == len(texts) + 2 and lexicon.total == sum(learned.values())
