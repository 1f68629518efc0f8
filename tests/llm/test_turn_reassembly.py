"""The stateful stream against a plain replay of the same rules."""

import hashlib
from collections import defaultdict

from helixframe.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, batch string, first double"


def plain(rows, batches, idle):
    """Events of (conv_id, turn, role, text) rows, in one process."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if t is not None]
    first, sent = {}, defaultdict(dict)
    for c, t, _, _ in rows:
        first[c] = min(first.get(c, t), t)
    for c, t, r, x in rows:
        h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
        for b, role in [(h % batches, r)] + ([((h + 3) % batches, "user")] if h % 7 < 2 else []):
            payload = (f"{role}|{x}".encode(), role)
            sent[b][c, t] = min(sent[b].get((c, t), payload), payload)
    out, kept, following, last, closed = [], defaultdict(dict), {}, {}, set()

    def close(c, b):
        closed.add(c)
        mine = kept[c]
        rest = ",".join(str(t) for t in sorted(mine) if t >= following[c])
        breaks = sum(t - 1 in mine and mine[t - 1][1] == p[1] for t, p in mine.items())
        out.append(("close", c, -1, b, rest.encode(), max(mine) - first[c] + 1 - len(mine), breaks))
        del last[c]

    for b in range(batches):
        for (c, t), payload in sent[b].items():
            if c in closed:
                out.append(("reject", c, t, b, payload[0], None, None))
            else:
                kept[c].setdefault(t, payload)
                last[c] = b
                following.setdefault(c, first[c])
        for c in [c for c in last if last[c] == b]:
            while following[c] in kept[c]:
                out.append(("release", c, following[c], b, kept[c][following[c]][0], None, None))
                following[c] += 1
        for c in [c for c in last if last[c] + idle == b]:
            close(c, b)
    for c in list(last):
        close(c, batches)
    return sorted((e, c is None, c or 0, t, b, hashlib.sha256(p).hexdigest(), m, k) for e, c, t, b, p, m, k in out)


def found(df):
    return sorted((r.event, r.conv_id is None, r.conv_id or 0, r.turn, r.batch, r.sha256, r.n_missing, r.n_breaks) for r in turns.event_digests(df).collect())


def test_stream_equals_plain_replay(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} é") for c in range(40) for t in range(c % 5, c % 5 + 1 + c % 7)]
    rows += [(None, 1, "user", "of none"), (None, 2, None, None), (7, None, "user", "no turn"), (3, 4, "user", "again"), (3, 4, "user", "Again"), (-5, -2, "user", ""), (-5, -1, "user", "x" * 200_000)]
    rows += rows[:9]
    table = spark.createDataFrame([(*r, "a", 0.5) for r in rows], SCHEMA)
    want = plain(rows, 6, 1)
    assert {w[0] for w in want} == {"release", "reject", "close"}
    before = {k: spark.conf.get(k, None) for k in (*turns.STORE, turns.PARTITIONS)}
    assert found(turns.replay(table, batches=6, idle=1)) == want
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_no_rows(spark):
    assert turns.replay(spark.createDataFrame([], SCHEMA), batches=1, idle=1).count() == 0
