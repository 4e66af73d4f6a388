"""The recall of the whole search on copies at the largest distance, inside other text."""

from __future__ import annotations

import random

from tonelake.llm import decontamination


def test_recall_at_the_largest_distance():
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 10))) for _ in range(n))
    index = decontamination.Index([(k, text(rng.randrange(14, 70))) for k in range(120)])
    texts, own = [], []
    for j in range(600):
        k = j % 120
        item = index.items[k][1]
        texts.append(f"{text(20)} {decontamination.edited(item, int(0.1 * len(item)), rng)} {text(9)}")
        own.append((j, k))
    got = {(d, k) for d, k, _, _ in index.matches(texts, index.places(texts))}
    assert len(got & set(own)) >= decontamination.RECALL * len(own)
