import hashlib
import random

import numpy as np

from colloquy.llm import substring_dedup as sd


def test_cover_brings_any_two_positions_together():
    cover = set(sd.COVER)
    for i in range(sd.PERIOD):
        for j in range(sd.PERIOD):
            assert any((i + s) % sd.PERIOD in cover and (j + s) % sd.PERIOD in cover
                       for s in range(sd.PERIOD))


def test_rolling_hash_does_not_depend_on_place(monkeypatch):
    words = sd.word_hashes([b"%d" % (i % 13) for i in range(300)])
    found = sd.rolling(words, 20, sd.BASES[0])
    assert len(found) == 281 and len(np.unique(found)) == 13
    assert (found[:13] == found[13:26]).all()
    monkeypatch.setattr(sd, "SPAN", 37)
    assert (sd.rolling(words, 20, sd.BASES[0]) == found).all()
    assert len(sd.rolling(words[:5], 20, sd.BASES[0])) == 0


def brute(rows):
    """``{row: (n_words, n_removed, sha256)}`` for distinct ids."""
    first = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k:k + 50]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def some_rows():
    rng = random.Random(2)
    fresh = iter(range(10 ** 6))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(60):
        words = new(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages) + new(rng.randrange(40))
        rows.append((i, " ".join(words)))
    # part of a passage shared with one document, another part with a second
    p = passages[4]
    rows += [(70, " ".join(p[100:170])), (71, " ".join(p[60:130] + p[140:200])),
             (72, rows[5][1]), (73, rows[5][1]), (74, " ".join(["same"] * 120)),
             (75, " ".join(["same"] * 60)), (76, None), (77, ""),
             (78, "A\t" + "\n".join(p[:70]))]
    return rows


def test_against_brute_force(docs):
    rows = some_rows()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           sd.substring_dedup(docs(rows).repartition(5)).collect()}
    assert got == brute(rows)


def test_joins_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(sd, "OUT_ROWS", 7)
    rows = some_rows()[40:]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           sd.substring_dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_texts_null_ids_and_repeats(docs):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p + " tail"), (1, p + " tail"), (None, p), (2, "head " + p), (1, p + " other")]
    got = sd.substring_dedup(docs(rows), texts=True).collect()
    seen = sorted((r.doc_id or 0, r.n_removed, r.kept_text or "") for r in got)
    assert seen == [(0, 60, ""), (1, 0, ""), (1, 0, ""), (1, 0, ""), (2, 60, "head")]


def test_empty_table(docs):
    assert sd.substring_dedup(docs([])).count() == 0
