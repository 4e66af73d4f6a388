"""Leaks are found whether or not a whole word of theirs stands in the text."""

from __future__ import annotations

import random

from tonelake.llm import decontamination


def found(items, texts):
    index = decontamination.Index([(k, decontamination.normal(t)) for k, t in enumerate(items)])
    texts = [decontamination.normal(t) for t in texts]
    return {(d, index.items[k][0]) for d, k, _, _ in index.matches(texts, index.places(texts))}


def test_verbatim_copies_without_spaces():
    rng = random.Random(3)
    run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    items = [run(n) for n in (60, 24, 9, 7)] + ["answer", "two words"]
    texts = [run(40) + t + run(30) for t in items[:4]] + ["(answer)", "«two words»", run(900)]
    assert found(items, texts) == {(k, k) for k in range(6)}


def test_every_long_word_changed():
    item = "señoría caminó despacio mañana según decían todavía después cañón pequeño"
    text = "antes " + item.replace("ñ", "n").replace("ó", "o").replace("á", "a") + " luego"
    assert sum(x != y for x, y in zip(item, text[6:])) <= 0.1 * len(item)
    assert found([item], [text]) == {(0, 0)}
