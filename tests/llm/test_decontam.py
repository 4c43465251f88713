import random
import re

import numpy as np

from emberline.llm import decontam

from .helpers import docs, prose

ITEM = "The quick brown fox jumps over the lazy dog, and then it runs back home before the rain begins to fall."


def find(spark, texts, items):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {r.doc_id: r for r in decontam.find(docs(spark, texts), bench, ["doc_id"]).collect()}


def test_whole_items_are_found_with_their_place(spark):
    long = prose(1, 3000)
    texts = [f"{long} {ITEM} {long}", ITEM.upper().replace(",", " - "), ITEM[:60], None, "", long, ITEM.replace("quick", "quack").replace("rain", "rein"), ITEM + "\n" + ITEM]
    got = find(spark, texts, [ITEM, "short", None, ITEM])
    assert [sorted(got[i].item_ids) for i in range(8)] == [[0, 3], [0, 3], [], [], [], [], [0, 3], [0, 3]]
    hit = got[0].hits[0]
    assert texts[0][hit.first : hit.last].strip(" .") == ITEM.strip(".") and hit.distance == 0
    assert got[6].hits[0].distance == 2
    assert got[7].n_hits == 4


def test_items_do_not_run_over_two_texts(spark):
    got = find(spark, [ITEM[:50], ITEM[50:]], [ITEM])
    assert [got[i].n_hits for i in (0, 1)] == [0, 0]


def test_alignment_is_the_edit_distance():
    def distance(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 3, 30).astype(np.uint8)
        b = np.concatenate([r.integers(0, 3, 4).astype(np.uint8), np.delete(a, r.integers(0, 30, 2)), r.integers(0, 3, 4).astype(np.uint8)])
        got = decontam.align(a, b, 4)
        want = distance(a.tolist(), b.tolist())
        assert (got[0] if got else 9) == want if want <= 4 else got is None or got[0] >= want


def test_empty_tables(spark):
    assert find(spark, [], [ITEM]) == {}
    assert find(spark, ["a"], [])[0].n_hits == 0


def test_more_items_than_one_index_holds(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BYTES", 60)
    got = find(spark, [ITEM, prose(3, 40)], [ITEM, prose(3, 40), prose(4, 40)])
    assert (got[0].item_ids, got[1].item_ids) == ([0], [1])


def plain_hits(texts, items, errors=0.05):
    """By text the items that stand in it: short ones exactly, the others within their edits, by the full table."""

    def fold(t):
        return re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", t or "").lower().strip()

    def within(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    out = []
    for t in map(fold, texts):
        hits = set()
        for k, item in enumerate(map(fold, items)):
            if item and (f" {item} " in f" {t} " if len(item) < 32 else within(item, t) <= int(len(item) * errors)):
                hits.add(k)
        out.append(sorted(hits))
    return out


def test_the_whole_result_is_that_of_brute_force(spark):
    r = random.Random(5)
    items = [" ".join(r.choice(["red", "blue", "green", "stone", "river", "cloud", "seven"]) + str(r.randint(0, 99)) for _ in range(n)) for n in (1, 2, 4, 6, 9, 14, 30)] + ["", None, "...", "one two"]
    texts = [None, "", "x" * 50_000]
    for _ in range(60):
        k = r.randrange(7)
        part = list(items[k])
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            at = r.randrange(len(part))
            part[at] = r.choice(["", "z", part[at] + "q"])
        texts.append(f"{prose(r.randint(0, 999), r.choice([0, 5, 200]))} {''.join(part).upper() if r.random() < 0.3 else ''.join(part)} {prose(r.randint(0, 999), 6)}")
    got = find(spark, texts, items)
    assert [got[i].item_ids for i in range(len(texts))] == plain_hits(texts, items)


def test_null_item_ids_repeated_rows_long_texts_and_clashing_names(spark):
    bench = spark.createDataFrame([(None, ITEM), (4, "public key"), (4, "public key")], "item_id long, text string")
    rows = [(None, f"{'word ' * 200_000}{ITEM} {ITEM}", 1), (7, "a PUBLIC-KEY b", 2), (7, "a PUBLIC-KEY b", 2), (8, "publickey", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    got = sorted(decontam.find(table, bench, ["doc_id", "hits"]).collect(), key=lambda x: x.hits)
    assert [(x.doc_id, x.hits, x.n_hits, x.item_ids) for x in got] == [(None, 1, 2, [None]), (7, 2, 2, [4]), (7, 2, 2, [4]), (8, 3, 0, [])]
    assert [x.distance for x in got[0].hits_] == [0, 0]
    kept = decontam.clean(table, bench).collect()
    assert [(x.doc_id, x.hits) for x in sorted(kept, key=lambda x: x.hits)] == [(7, 2), (7, 2), (8, 3)]


def test_alignment_in_a_band_is_that_of_the_whole_table():
    r = np.random.default_rng(9)
    for _ in range(300):
        a = r.integers(0, 4, 40).astype(np.uint8)
        lead = int(r.integers(0, 12))
        b = np.concatenate([r.integers(0, 4, lead).astype(np.uint8), np.delete(a, r.integers(0, 40, int(r.integers(0, 3)))), r.integers(0, 4, 9).astype(np.uint8)])
        whole, band = decontam.align(a, b, 4), decontam.align(a, b, 4, lead - 4, lead + 4)
        assert (whole is None) == (band is None) and (whole is None or whole[0] == band[0])
