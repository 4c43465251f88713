"""What a rule matches passes the gate, however its words are set apart."""

import random
import re
from re import _constants as C
from re import _parser

from emberline.llm import licenses
from emberline.llm.license_rules import rules

from .helpers import docs


def sample(parsed, r):
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.ANY:
            out += "x"
        elif op is C.IN:
            kind, value = r.choice(arg)
            out += chr(value) if kind is C.LITERAL else chr(r.randint(*value))
        elif op is C.BRANCH:
            out += sample(r.choice(arg[1]), r)
        elif op is C.SUBPATTERN:
            out += sample(arg[-1], r)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            out += "".join(sample(inner, r) for _ in range(r.randint(low, min(int(high), low + 1))))
        else:
            assert op is C.ASSERT
    return out


def test_samples_of_every_rule_pass_the_gate():
    r, gate = random.Random(1), re.compile(licenses._GATE)
    for label, regex, keyword, _ in rules():
        parsed = _parser.parse(regex)
        for _ in range(40):
            text = sample(parsed, r)
            assert re.search(regex, f" {text} ") and any(k in text for k in keyword.split("|")), (label, text)
            for gap in (" ", "\n", "-", "  * "):
                assert gate.search(text.replace(" ", gap)), (label, text, gap)


def test_wrapped_and_unlicensed_wordings_are_found(spark):
    texts = ["two-clause bsd", "released under the bsd 3-clause terms", "0bsd", "cecill", "mulan psl", "mit no attribution", "for non commercial use only", "All rights\nreserved", "placed in the public\n  domain", "creative-commons attribution", "unauthorized copying\nof this\nfile", "plain prose"]
    got = {x.doc_id: x.labels for x in licenses.scan(docs(spark, texts), ["doc_id"]).collect()}
    want = ["bsd-2-clause", "bsd-3-clause", "0bsd", "cecill", "mulanpsl", "mit-0", "noncommercial", "proprietary", "public-domain", "cc-by", "proprietary", ""]
    assert [got[i] for i in range(len(texts))] == want


def plain_detections(text):
    """All matches of all rules but those within a stronger one, by Python's regexes over the whole text."""
    joined = " " + re.sub(licenses._GAP, " ", (text or "").translate(str.maketrans(licenses._UPPER, licenses._LOWER))).strip(" ") + " "
    found = [(label, rank, m.start(), m.end() - 1) for label, regex, _, rank in rules() for m in re.finditer(regex, joined)]

    def beaten(x, y):
        inside = y[2] <= x[2] and y[3] >= x[3]
        longer, same = y[3] - y[2] > x[3] - x[2], y[2:] == x[2:]
        return inside and (y[1] > x[1] or (y[1] == x[1] and (longer or (same and y[0] < x[0]))))

    return sorted(x for x in found if not any(beaten(x, y) for y in found))


def test_detections_are_those_of_a_plain_version(spark, monkeypatch):
    r, texts = random.Random(7), [None, "", "mit license"]
    shown = [_parser.parse(x[1]) for x in rules()]
    for n in (1, 3, 8, 40):
        for _ in range(6):
            parts = [sample(r.choice(shown), r) if r.random() < 0.7 else "some other words and a license" for _ in range(n)]
            texts.append(r.choice(["\n", " ", " -- "]).join(parts))
    texts += [texts[-1]] + ["mit license, all rights reserved. " * 300]
    want = [plain_detections(x) for x in texts[:-1]]
    for window, overlap in ((20_000, 1_000), (2_000, 400)):
        monkeypatch.setattr(licenses, "WINDOW", window)
        monkeypatch.setattr(licenses, "OVERLAP", overlap)
        got = {x.doc_id: x for x in licenses.scan(docs(spark, texts), ["doc_id"]).collect()}
        for i, w in enumerate(want):
            assert sorted((x.label, x.priority, x.first, x.last) for x in got[i].detections) == w, texts[i]
        assert got[len(texts) - 1].n_detections == 600
