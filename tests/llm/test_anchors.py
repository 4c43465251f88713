"""Anchors come from the counts of all texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from emberline.llm import lm
from emberline.llm import textkernel as K

from .helpers import docs


def test_anchors_are_the_most_frequent_words_of_all_texts(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{min(r.randrange(600), r.randrange(600))}" for _ in range(12)) for _ in range(5500)] + ["copy of it"] * 5000
    count = Counter(w for t in texts for w in t.split())
    data, offsets = K.flat(pa.array(list(count)))
    hashes = K.words(data, offsets)[0]
    signed = hashes.view(np.int64).tolist()
    top = sorted(zip(count.values(), signed), key=lambda x: (-x[0], x[1]))[: lm.ANCHORS]
    got = lm.fit_contexts(docs(spark, texts).select("text"))
    assert sorted(got.anchors.view(np.int64).tolist()) == sorted(h for _, h in top)
