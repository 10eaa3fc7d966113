import random
import re

import numpy as np
import pytest

from sparkloom.llm import nearcopies as n
from sparkloom.llm.lookalike import unified


def texts(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(150)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randint(0, 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append((len(out) + 1, " ".join(copy[:5]), " ".join(copy[5:])))
    out += [(100, "short", "too few words"), (101, None, None), (102, None, out[0][2]), out[3], (103, out[0][1], out[0][2].upper() + "!"), (104, "t", "same " * 400)]
    return out


def brute(data, threshold=0.6):
    sets = {}
    for k, a, b in data:
        w = re.findall(r"\w+", unified(f"{a or ''}\n{b or ''}").lower())
        s = set(zip(w, w[1:], w[2:]))
        if len(s) >= 50:
            sets[k] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_all_pairs(rows):
    data = texts()
    got = {(r.number_a, r.number_b) for r in n.near_pairs(rows(data), "number", "title", "body_text").collect()}
    assert got == brute(data) and (1, 103) in got


def test_classes_and_links(rows):
    data = texts()
    got = {r.number: (r.class_id, r.links) for r in n.near_classes(rows(data), "number", "title", "body_text").collect()}
    pairs = brute(data)
    assert got[103] == got[1] and got[1][0] == 1 and 100 not in got and 104 not in got
    assert got[1][1] == len({b for a, b in pairs if a == 1} - {103})


def test_empty(rows):
    assert n.near_pairs(rows([]), "number", "title", "body_text").count() == 0


def test_many_copies(rows):
    """A third of all rows alike: one class, met once."""
    body = " ".join(f"k{i}" for i in range(90))
    data = [(i, "t", body) for i in range(30)] + [(100 + i, "t", " ".join(f"x{i}y{j}" for j in range(80))) for i in range(60)]
    assert n.near_pairs(rows(data), "number", "title", "body_text").count() == 30 * 29 // 2


@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 4.0)])
def test_signature_agreement_is_the_probability_jaccard(weights):
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(1, 2**62, 60).astype(np.uint64) for _ in range(3))
    ws, wo = weights
    doc = np.repeat([0, 0, 1, 1], 60)
    element, weight = np.concatenate([shared, a, shared, b]), np.tile(np.repeat([ws, wo], 60), 2)
    s = n.probminhash(doc, element, weight, 2, 4000)
    x = np.concatenate([weight[:60], weight[60:120], np.zeros(60)]) / weight[:120].sum()
    y = np.concatenate([weight[:60], np.zeros(60), weight[60:120]]) / weight[:120].sum()
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_a_task_describes_a_class_once(rows):
    body = " ".join(f"k{i}" for i in range(90))
    made = n.described(rows([(i, "t", body) for i in range(400)] + [(1000, "t", body + " more")]).coalesce(1), "number", "title", "body_text")
    assert made.count() == 401 and made.where("size(bands) > 0").count() == 2
    got = n.near_classes(rows([(i, "t", body) for i in range(400)] + [(1000, "t", body + " more")]), "number", "title", "body_text").collect()
    assert {(r.class_id, r.links) for r in got} == {(0, 1), (1000, 1)} and len(got) == 401
