import hashlib
import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from inkwell.llm import pii

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        return (True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else False, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]

    return sorted((m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r, text or "") if ok(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text("ab.@-+% 0123459()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_the_corpus(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = pii.query(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total = Counter()
    for r in rows:
        base = brute(docs[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert set(joined.split(",")) <= set(r.spans.split(","))
        total.update(x[1] for x in base)
    assert all(total[k] for k in (0, 3))


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_repeats_of_an_entity_are_labelled():
    nodes, chain, skip = Counter(), Counter(), Counter()
    texts = [f"mail jo.smith{i}@mail.example.com now or call +1 (293) 555-9{i % 900 + 100} again 555-9{i % 900 + 100} and 17 of {i} parts" for i in range(300)]
    for t in texts:
        g = pii.graph(t, pii.base_spans(t))
        nodes.update(zip(g.features, g.labels))
        chain.update((g.labels[a], g.labels[b]) for a, b in g.chain)
        skip.update((g.labels[a], g.labels[b]) for a, b in g.skip)
    model = pii.fit(nodes, chain, skip)
    for base, _ in pii.find_spans(model, texts[:5]):
        assert base
    ((base, added),) = pii.find_spans(model, ["plain words 17 and 18 parts"])
    assert not base and not added


def test_messages_agree_with_enumeration_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = pii.Model(rng.normal(size=(pii.FEATURES, pii.LABELS)), (lambda a: a + a.T)(rng.normal(size=(5, 5))), (lambda a: a + a.T)(rng.normal(size=(5, 5))))
    g = pii.Graph([(0, 1)] * 4, [(0, 1 + i) for i in range(4)], [0, 2, 0, 0], [(0, 1), (1, 2)], [(1, 3)])
    want = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[1] == 2:
            s = sum(model.weights[list(f), c].sum() for i, (f, c) in enumerate(zip(g.features, y)) if i != 1) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]] + model.skip[y[1], y[3]]
            for i in range(4):
                want[i, y[i]] += np.exp(s)
    got = pii.marginals(model, [g])[0]
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-2)


def test_odd_rows(spark, odd, none):
    got = pii.personal_data(odd).collect()
    assert len(got) == 11 and all(r.spans == "" for r in got)
    assert pii.personal_data(none).count() == 0
