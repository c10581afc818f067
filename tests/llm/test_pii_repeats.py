"""Added spans: planted variants, unrelated numbers, and the search for repeats against plain enumeration."""

import dataclasses
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from inkwell.llm import pii


@pytest.fixture(scope="module")
def model(spark, small):
    return pii.train(spark.read.parquet(f"{small}/documents.parquet"))


def variants(rng, i):
    """(a base form, its kind, a variant that no pattern finds) of one invented entity."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = i % 4
    if kind == 0:
        name = "".join(rng.choice("abcdefgh") for _ in range(6)) + f".{i}"
        return f"{name}@mail.example.com", kind, rng.choice([f"{name}@mail", f"{name} [at] mail [dot] example [dot] com", f"{name.title()}@localhost"])
    if kind == 1:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return ".".join(parts), kind, rng.choice(["-", "[.]", " . "]).join(parts)
    if kind == 2:
        d = next(d for d in iter(lambda: "4" + digits(15), None) if pii.luhn(d))
        groups = [d[j : j + 4] for j in range(0, 16, 4)]
        return " ".join(groups), kind, rng.choice(["/", ".", "_"]).join(groups)
    area, a, b = str(rng.randint(200, 999)), str(rng.randint(200, 999)), digits(4)
    return f"+1 ({area}) {a}-{b}", kind, rng.choice([f"({area}) {a}-{b}", f"{area}.{a}.{b}", f"1{area}{a}{b}", f"0{area} {a} {b}"])


def cases(n=400):
    rng = random.Random(3)
    words = "we met the team in a small town and wrote down what they said about it then".split()
    for i in range(n):
        base, kind, variant = variants(rng, i)
        filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))
        other = f"{rng.randint(1000, 99999)} parts, order {rng.randint(10**8, 10**9)}, {rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}, {rng.randint(1, 99)}.{rng.randint(1, 99)}"
        first, second = (base, variant) if i % 3 else (variant, base)
        before, between = f"{filler()} ", f", {filler()} {other} {filler()} "
        at = len(before) + (len(first + between) if second is variant else 0)
        yield f"{before}{first}{between}{second} {filler()}", kind, (at, at + len(variant))


def score(model):
    found = right = wanted = 0
    planted = list(cases())
    for (_, kind, (x, y)), (_, added) in zip(planted, pii.find_spans(model, [t for t, _, _ in planted])):
        found += len(added)
        wanted += 1
        right += any(k == kind and x <= a <= x + 1 and y - 1 <= b <= y for a, k, b in added)
    return right / wanted, right / max(1, found)


def test_planted_variants_are_added_and_other_numbers_are_not(model):
    recall, precision = score(model)
    print(f"added spans: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.98


def test_nothing_is_added_without_skip_potentials(model):
    assert score(dataclasses.replace(model, skip=np.zeros_like(model.skip)))[0] < 0.1


def test_the_query_holds_base_and_added_spans(spark, model):
    planted = list(cases(40))
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    for r in pii.personal_data(docs, model).collect():
        ((base, added),) = pii.find_spans(model, [planted[r.doc_id][0]])
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added))


def brute(text, known):
    out = []
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            s = text[a:b]
            if not re.fullmatch(r"[0-9]+(?:[\s().\-/_+\[\]·‐-―]{1,3}[0-9]+)*", s) or a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
                continue
            groups = re.findall("[0-9]+", s)
            keys = ["#" + "".join(groups).lstrip("0")] + ["." + ".".join(g.lstrip("0") or "0" for g in groups)] * (len(groups) == 4)
            out += [(a - (a > 0 and text[a - 1] in "+("), b, k) for k in keys if k in known]
    kept, end = [], 0
    for a, b, key in sorted(out, key=lambda x: (x[0], -x[1])):
        if a >= end:
            kept.append((a, b, key))
            end = b
    return kept


@settings(max_examples=300, deadline=None)
@given(st.text("0123 .-(+a", max_size=24), st.lists(st.text("123", min_size=1, max_size=6), max_size=4))
def test_repeats_against_enumeration(text, numbers):
    known = {"#" + n for n in numbers} | {"." + ".".join(n) for n in numbers if len(n) == 4}
    assert [x[:2] for x in pii.repeats(text, known)] == [x[:2] for x in brute(text, known)]


def test_many_repeats_take_linear_time(model):
    number = "+1 (293) 555-9123"
    text = number + " or" + " 293.555.9123" * 20_000 + " 1 2 3" * 50_000 + " a@b" * 20_000
    ((base, added),) = pii.find_spans(model, [text])
    assert len(base) >= 1 and len(added) >= 19_999
