"""Small tables and plain counterparts for the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "an", "er", "on", "re", "é", "ñ"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def edited(text, at, word="zzz"):
    w = text.split(" ")
    for i in at:
        w[i] = word
    return " ".join(w)
