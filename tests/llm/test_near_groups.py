"""Near duplicates: a large group of loosely similar texts, and rows without a text or an id."""

import random

from globeframe.llm.near_duplicates import near_duplicates

WORDS = 4


def test_loose_group_and_gaps(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(90)]
    texts = {0: " ".join(base)}
    for doc in range(1, 160):
        words = list(base)
        for _ in range(draw.randrange(7)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        texts[doc] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \t", 203: "one two", 204: "ONE two"}
    sets = {}
    for doc, text in texts.items():
        words = (text or "").lower().split()
        runs = {tuple(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}
        sets[doc] = runs or ({tuple(words)} if words else set())
    smallest = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                linked = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                if linked and smallest[b] < smallest[a]:
                    smallest[a], changed = smallest[b], True
    rows = [*texts.items(), (None, "no id at all here")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    assert len(out) == len(rows)
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == smallest
    assert 1 < len({smallest[d] for d in range(160)}) < 160
