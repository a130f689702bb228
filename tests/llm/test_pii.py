from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wireloom.llm import pii
from wireloom.llm.queries import QUERIES

# The patterns of the contract as they stand.
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def slow_base(text):
    out = []
    for kind, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = [
                True,
                kind == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                16 <= len(digits) <= 19 and slow_luhn(digits),
                8 <= len(digits) <= 15,
            ][kind]
            if fits:
                out.append((kind, *m.span()))
    return out


CASES = [
    "mail a.b+c@x-y.co.uk, or @x.y a@b a@b. a@b.c@d.e _x@y.z_q@r.s", "a@b.c_d@e.f.g", "é@x.y ü a@é.x",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255 1.2.3 0000000.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1 22 6304000000000000000",
    "+1 (555) 123-4567 +1234567 +49 30 1234567890123456 ++4 5678901 +1(((((", "日本 a@b.cd 🤦 +81 3 1234 5678",
    None, "", "no data at all", "x" * 5000 + "@" + "y" * 5000 + ".z", "1" * 20000, "1." * 9000, "+1" + "(" * 9000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert pii.base_spans(text or "") == slow_base(text)


@given(st.text(alphabet="ab_%.@-+ ()0123456789é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == slow_base(text)


PEOPLE = ["Maria Lopez", "Hans Becker", "Claire Dubois", "James Miller", "Elena Rossi"]
FAKE = ["The The", "Of Which", "Der Wald", "Open Source", "Red House", "Public License"]


def corpus():
    """Documents with true and false candidates of every kind, some with cues and some without."""
    rng, rows = random.Random(3), []
    for i in range(120):
        who, junk = rng.choice(PEOPLE), rng.choice(FAKE)
        rows.append((i, f"word {junk} goes. {junk} on, my name is {who}, bye" if i % 2 else f"we met {who} there. {junk} is {junk}"))
    for i in range(60):
        social, date = f"{100 + i}-{10 + i % 80}-{1000 + 7 * i}", f"20{10 + i % 10}-0{1 + i % 9}-{10 + i % 18}"
        rows.append((200 + i, f"ssn {social} born {date}" if i % 2 else f"her number {social}, order {1000 + i}-{2000 + i}, date {date}"))
        body = f"{i:018d}"
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        rows.append((300 + i, f"iban DE{check:02d}{body} ok" if i % 2 else f"part QX{i:02d}{body} of the list"))
        rows.append((400 + i, f"write to jan{i} [at] site [dot] org" if i % 2 else "look at this dot here now"))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    table = pii.tagged(df)
    return df, table, pii.learn(table)


def test_spans_that_are_added(learned):
    df, _, model = learned
    texts = dict(corpus())
    found = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.spans} for r in pii.scan(df).collect()}
    want = {}
    for i, t in texts.items():
        people = {p for p in PEOPLE if p in t}
        want[i] = people | set(re.findall(r"\d{3}-\d{2}-\d{4}|DE\d{20}|jan\d+ \[at\] site \[dot\] org", t))
    hits = sum(len(found[i] & want[i]) for i in texts)
    assert hits / sum(map(len, want.values())) > 0.95
    assert hits / sum(map(len, found.values())) > 0.98
    assert model.weights.shape == (len(pii.KINDS), pii.BITS + 1)


def slow_reliabilities(cast):
    """The same from one row a candidate, term by term."""
    n, labelers = len(cast), len(cast[0])
    weight = pii.PRIOR_WEIGHT * n
    prior = {1: list(pii.PRIOR_VOTES), 0: [pii.PRIOR_VOTES[0], pii.PRIOR_VOTES[2], pii.PRIOR_VOTES[1]]}
    q = [1 / (1 + math.exp(1 - 1.5 * (c.count(1) - c.count(2)))) for c in cast]
    for _ in range(pii.ROUNDS):
        share = (sum(q) + weight * pii.PRIOR_TRUE) / (n + weight)
        table = []
        for j in range(labelers):
            rows = {z: [sum((p if z else 1 - p) for p, c in zip(q, cast, strict=True) if c[j] == v) + weight * prior[z][v] for v in range(3)] for z in (0, 1)}
            rows = {z: [x / sum(r) for x in r] for z, r in rows.items()}
            for v, right in ((1, 1), (2, 0)):
                if rows[right][v] < rows[1 - right][v]:
                    rows[0][v] = rows[1][v] = (rows[0][v] + rows[1][v]) / 2
            table.append({z: [x / sum(r) for x in r] for z, r in rows.items()})
        new = []
        for c in cast:
            odds = math.log(share / (1 - share)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(c))
            new.append(1 / (1 + math.exp(-odds)))
        if max(abs(a - b) for a, b in zip(new, q, strict=True)) < 1e-10:
            break
        q = new
    return share, table, q


def test_reliabilities_and_classifier_against_brute_force(learned):
    _, table, model = learned
    seen = [(c.kind, c.signals) for r in table.collect() for c in r.candidates]
    for i, kind in enumerate(pii.KINDS):
        signals = [s for k, s in seen if k == i + len(pii.BASE)]
        cast = pii.votes(kind, np.array(signals)).tolist()
        share, rows, q = slow_reliabilities(cast)
        assert model.shares[i] == pytest.approx(share, abs=1e-6)
        for j in range(len(kind.labelers)):
            for z in (0, 1):
                assert model.tables[i][j, z] == pytest.approx(rows[j][z], abs=1e-6)
        # The loss has one minimum: its slope is 0 there.
        x = np.array([[s >> b & 1 for b in range(pii.BITS)] + [1] for s in signals], float)
        p = 1 / (1 + np.exp(-x @ model.weights[i]))
        assert np.abs(x.T @ (p - np.array(q)) / len(x) + pii.RIDGE * model.weights[i]).max() < 1e-6


def test_labelers_are_found_reliable(learned):
    model = learned[2]
    given_names = model.tables[0][0]
    assert given_names[1, 1] > 0.8 > 0.1 > given_names[0, 1]


def slow_row(text, model):
    base = slow_base(text)
    more = [c[:3] for c in pii.candidates(text or "", base) if model.accepts(c[0], c[3])]
    show = lambda spans: ",".join(f"{pii.NAMES[k]}:{a}:{b}" for k, a, b in sorted(spans))
    return *(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(base + more)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.learn(pii.tagged(docs))
    want = sorted((r.doc_id, *slow_row(r.text, model)) for r in docs.collect())
    assert sorted(tuple(r) for r in QUERIES["op11_personal_data"](spark, sf).collect()) == want


def test_odd_tables(spark, docs, tmp_path):
    rows = [*enumerate(CASES), (0, CASES[0]), (None, "a@b.c"), (3, None)]
    df = docs(rows).withColumnRenamed("source", "spans").withColumnRenamed("lang", "candidates").withColumn("id", F.lit("x"))
    got = pii.scan(df).collect()
    fast = [(i, [tuple(s) for s in pii.base_spans(t or "")]) for i, t in rows]
    assert sorted([(r.doc_id, [tuple(s) for s in r.spans if s.kind < 4]) for r in got], key=repr) == sorted(fast, key=repr)
    assert pii.scan(docs([])).count() == 0
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_personal_data"](spark, str(tmp_path)).count() == 0


def test_masked_texts(spark, docs, learned):
    text = "my name is Maria Lopez, mail m@x.org or +1 (555) 123-4567 from 10.0.0.1"
    got = {r.doc_id: r.text for r in pii.redacted(docs([text, None, "plain"]), learned[2]).collect()}
    assert got == {0: "my name is [PERSON], mail [EMAIL] or [PHONE] from [IP]", 1: None, 2: "plain"}
    assert pii.masked("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a[EMAIL]f"
