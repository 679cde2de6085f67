import random
import re
import time

from airloom.llm import pii

TEXTS = [
    None,
    "",
    "no data here",
    "mail a.b@example.co.uk, c@d.e f@g and @@x@y.z",
    "10.0.0.1 999.1.1.1 1.2.3.4.5 010.020.030.040",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 41111111111111111111",
    "+1 (389) 555-5010 +12 +123456789012345678",
    "é" * 50 + " +358 40 123 4567 x@y.fi",
    "a@b.c@d.e.f " * 30,
    "a@b.c_d@e.f a@b.c.-x@y.z @a.b x@.a.b x@-.- a@b..c a+%@b.c1.2.3.4",
    "1" * 5000 + ".1.1.1 " + "0" * 5000 + "1.2.3.4 1.2.3.4.5.6.7.8 12.3.4.5x6.7.8.9",
]


def brute(x):
    x = x or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(m.group()) % 10 == 0]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    for x in TEXTS:
        assert pii.base_spans(x) == brute(x)


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    for _ in range(3000):
        x = "".join(rng.choice("a1@.-_ +(2%\u00e9") for _ in range(rng.randrange(40)))
        assert pii.base_spans(x) == brute(x)


def test_long_runs_take_linear_time():
    began = time.time()
    for x in ("1" * 1_000_000, "a" * 1_000_000 + "@b", "a@" * 300_000, "+1 " * 300_000, "1." * 300_000):
        pii.base_spans(x)
    assert time.time() - began < 30


def sample():
    mails = [f"write to user{i}.x@mail{i % 7}.example.com today please" for i in range(60)]
    phones = [f"call +1 ({200 + i}) 555-{1000 + 37 * i} now or later" for i in range(60)]
    ips = [f"host {i}.{i + 3}.{i + 9}.{i % 250} is up" for i in range(60)]
    plain = [f"in {1900 + i} there were {i} of {i * 3} items" for i in range(60)] + [f'token = "{i:08x}deadbeef{i:012x}" end' for i in range(60)]
    return mails + phones + ips + plain


def test_field_adds_only_what_looks_like_data():
    field = pii.fit(sample())
    base, spans = pii.all_spans(field, "ring (212) 555-1234 at noon")
    assert base == [] and [("ring (212) 555-1234 at noon"[s:e], pii.KINDS[c]) for s, e, c in spans] == [("(212) 555-1234", "phone")]
    for x in ("in 1999 there were 12 of 36 items", "no numbers at all", 'token = "f0ddae3b09ae356cbefecdd3232fa548"'):
        assert pii.all_spans(field, x) == ([], [])
    for x in TEXTS:
        base, spans = pii.all_spans(field, x)
        assert set(base) <= set(spans)
    assert pii.masked(field, "to a.b@example.com or c@d.org") == "to [EMAIL] or [EMAIL]"
    assert pii.masked(field, None) is None


def cuts(rows, j):
    """All cuts of the first j tokens: lists of (first, end, kind), kind None for no entity."""
    if j == 0:
        return [[]]
    out = [c + [(j - 1, j, None)] for c in cuts(rows, j - 1)]
    for i, _, _ in rows[j - 1]:
        out += [c + [(i, j, k)] for c in cuts(rows, i) for k in range(len(pii.KINDS))]
    return out


def score(field, rows, cut):
    total, prev, none = 0.0, len(pii.KINDS), len(pii.KINDS)
    feats = {(i, j): f for j, row in enumerate(rows, 1) for i, _, f in row}
    for i, j, c in cut:
        c = none if c is None else c
        total += field.t[prev, c] + (field.w[c] @ pii.np.array(feats[i, j]) if c < none else 0.0)
        prev = c
    return total


SHORT = ["a@b.c 10.0.0.1", "+1 555 0101 x", "4111 1111 1111", "me (at) x.org", "1 2345\n6789 1"]


def test_best_path_and_posteriors_match_enumeration(monkeypatch):
    rng = pii.np.random.default_rng(1)
    k = len(pii.KINDS)
    for x in SHORT:
        field = pii.Field(rng.normal(size=(k, pii.N_FEATURES)), rng.normal(size=(k + 1, k + 1)))
        (tokens,) = pii.islands(x)
        rows = pii.lattice(x, tokens)
        every = [(score(field, rows, c), c) for c in cuts(rows, len(tokens))]
        z = pii.np.logaddexp.reduce([v for v, _ in every])
        best = max(every, key=lambda v: v[0])[1]
        for block in (1, 2, 100):
            monkeypatch.setattr(pii, "BLOCK", block)
            got = sorted(field.decoded(x, tokens))
            assert [g[:3] for g in got] == [c for c in best if c[2] is not None]
            for i, j, c, _, p in got:
                assert abs(p - (pii.np.logaddexp.reduce([v for v, cut in every if (i, j, c) in cut]) - z)) < 1e-6


def test_likelihood_matches_enumeration_and_its_gradient_differences():
    rng = pii.np.random.default_rng(2)
    k = len(pii.KINDS)
    w, t = rng.normal(size=(k, pii.N_FEATURES)), rng.normal(size=(k + 1, k + 1))
    data = [pii.example(x, pii.base_spans(x)) for x in SHORT if pii.example(x, pii.base_spans(x))]
    f = pii.Likelihood(data)
    value, gw, gt = f(w, t, 0.01)
    want = 0.0
    for rows, gold in data:
        covered = {m for i, j, _ in gold for m in range(i, j)}
        cut = sorted([*gold, *[(m, m + 1, None) for m in range(len(rows)) if m not in covered]], key=lambda x: x[0])
        field = pii.Field(w, t)
        want += score(field, rows, cut) - pii.np.logaddexp.reduce([score(field, rows, c) for c in cuts(rows, len(rows))])
    assert abs(value - (want / len(data) - 0.005 * ((w * w).sum() + (t * t).sum()))) < 1e-6
    for g, a in ((gw, w), (gt, t)):
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(12)]:
            old = a[at]
            a[at] = old + 1e-5
            up = f(w, t, 0.01)[0]
            a[at] = old - 1e-5
            down = f(w, t, 0.01)[0]
            a[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_held_out_recall_of_rewritten_spans_and_precision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    field = pii.fitted(docs.filter("doc_id % 2 = 0"))
    held = [r.text for r in docs.filter("doc_id % 2 = 1").collect()]
    found, n, wrong = {}, {}, 0
    for x in held:
        base = pii.base_spans(x)
        wrong += len(field.added(x, base)) if x else 0
        for tokens in pii.islands(x):
            y = x[tokens[0][0] : tokens[-1][1]]
            spans = pii.base_spans(y)
            for how in range(len(pii.REWRITES[spans[0][2]]) if len(spans) == 1 and len(tokens) < 12 else 0):
                other, span = pii.rewritten(y, spans[0], how)
                if other != y:
                    own = pii.base_spans(other)
                    n[span[2]] = n.get(span[2], 0) + 1
                    found[span[2]] = found.get(span[2], 0) + (span in own + field.added(other, own))
    assert len(n) == 4 and all(found[k] >= 0.9 * n[k] for k in n), (found, n)
    assert wrong <= 0.001 * len(held)


def test_spellings_that_were_not_trained_on(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    own = [[x[t[0][0] : t[-1][1]] for t in pii.islands(x) if len(t) < 12] for x in docs]
    train, held = ([y for ys in part for y in ys] for part in (own[::2], own[1::2]))
    has, plain = ([y for y in sorted(set(train)) if bool(pii.base_spans(y)) == h][:300] for h in (True, False))
    unseen = {(0, 1), (0, 4), (0, 7), (1, 1), (2, 1), (2, 4), (3, 1), (3, 4)}
    field = pii.fit(has + plain, learnt=lambda kind, how: (kind, how) not in unseen)
    found = {}
    for y in held:
        spans = pii.base_spans(y)
        for kind, how in unseen if len(spans) == 1 else []:
            if kind == spans[0][2]:
                other, span = pii.rewritten(y, spans[0], how)
                if other != y:
                    n = found.setdefault((kind, how), [0, 0])
                    n[0], n[1] = n[0] + (span in pii.all_spans(field, other)[1]), n[1] + 1
    assert len(found) >= 7 and sum(a for a, _ in found.values()) >= 0.9 * sum(b for _, b in found.values()), found


def test_numbers_of_other_things_are_left_alone():
    field = pii.fit(sample())
    for x in [
        "paid 1,234,567.89 euro", "it cost 12,500.00 in all", "nr 555-123-4567-99 sent", "ticket 123-456-7890 open", "order 2291-4471-9938-02 shipped", "isbn 978-3-16-148410-0 in print", "on 2024-03-17 at 12:30:45.678",
        "version 4.17.2 of it", "ratio 3 / 4 of 1,024", "from 1998 to 2003 and on", "at 60.1699 24.9384 north", "in 123 456 7890 people",
    ]:
        assert pii.all_spans(field, x) == ([], []), x
    for x, kind in [("write anna at mail dot org now", "email"), ("to x {at} mail.org", "email"), ("anna(AT)mail(DOT)org", "email"), ("host 10[.]0[.]0[.]1 up", "ip"), ("ring (212) 555-1234 now", "phone")]:
        assert [pii.KINDS[c] for _, _, c in pii.all_spans(field, x)[1]] == [kind], x


def test_a_megabyte_of_numbers_takes_linear_time():
    field = pii.fit(sample())
    x = " ".join(str(i * 7919 % 99733) for i in range(200_000))
    took = []
    for n in (100_000, 400_000):
        began = time.time()
        field.added(x[:n], [])
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


def test_long_texts_and_long_spans():
    field = pii.fit(sample())
    x = "call " + " ".join(str(i * 7919 % 9973) for i in range(5000)) + " please write to " + "q" * 300 + " [at] mail1.example.com today"
    found = [(e - s, c) for tokens in pii.islands(x) for _, _, c, (s, e), _ in field.decoded(x, tokens)]
    assert (300 + len(" [at] mail1.example.com"), 0) in found


def test_frames(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L as n_chars", "'x' as spans", "1 as f")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = {r.doc_id: r for r in pii.scan(df).collect()}
    assert [got[i].n_email for i in range(len(TEXTS))] == [sum(s[2] == 0 for s in brute(x)) for x in TEXTS]
    assert pii.scan(df.limit(0)).count() == 0
