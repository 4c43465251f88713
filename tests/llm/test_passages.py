"""Repeated passages against brute force over runs of words, whatever their lines."""

import random

from emberline.llm import paragraphs

from .helpers import docs, prose, words

N = paragraphs.PASSAGE


def plain_passages(texts):
    """By text, the words that lie in a run of N words of an earlier place."""
    seen, gone = {}, []
    for d, text in enumerate(texts):
        w, out = words(text), set()
        for k in range(len(w) - N + 1):
            first = seen.setdefault(tuple(w[k : k + N]), (d, k))
            if first[0] != d or k >= first[1] + N:
                out.update(range(k, k + N))
        gone.append(out)
    return gone


def wrapped(text, every):
    w = text.split(" ")
    return "\n".join(" ".join(w[k : k + every]) for k in range(0, len(w), every))


def covered(text, spans):
    """Numbers of the words within spans of bytes."""
    at, out = 0, set()
    for k, w in enumerate(text.split()):
        at = text.encode().index(w.encode(), at)
        if any(s["first"] <= at and at + len(w.encode()) <= s["last"] for s in spans):
            out.add(k)
        at += len(w.encode())
    return out


def test_passages_are_those_of_brute_force_over_words(spark):
    r = random.Random(2)
    shared = [prose(500 + k, n) for k, n in enumerate((49, 50, 51, 60, 130))]
    texts = []
    for i in range(40):
        s = r.choice(shared)
        s = r.choice([s, wrapped(s, 7), wrapped(s, 33), s.upper()])
        texts.append(f"{prose(2000 + i, r.choice([0, 8, 90]))} {s} {prose(3000 + i, r.choice([0, 8, 90]))}".strip())
    once = prose(9, 70)
    texts += [None, "", "la " * 400, once + " x y z " + once, texts[3], wrapped(texts[4], 5), "\n" + shared[1] + "\n"]
    want = plain_passages(texts)
    table = docs(spark, texts)
    got = {x.doc_id: x for x in paragraphs.duplicates(table).collect()}
    for i, t in enumerate(texts):
        assert covered(t or "", got[i].passages) == want[i], i
        assert bool(got[i].n_passages) == bool(want[i])
    assert sum(map(bool, want)) > 25
    left = {x.doc_id: x.text for x in paragraphs.remove(table).collect()}
    assert not any(map(bool, plain_passages([left[i] for i in range(len(texts))])))
    for i, t in enumerate(texts):
        keep = [w for k, w in enumerate(words(t)) if k not in want[i]]
        assert set(words(left[i])) <= set(keep)
