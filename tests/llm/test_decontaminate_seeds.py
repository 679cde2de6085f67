import itertools

from airloom.llm import decontaminate as d


def masks_of(n):
    return d.MASKS if n >= d.LONG else d.short_masks(n)


def test_every_accepted_pattern_shares_a_seed():
    for n in range(1, 21):
        masks = [(len(m), [k for k, x in enumerate(m) if x == "1"]) for m in masks_of(n)]
        placed = [{at + k for k in ones} for size, ones in masks for at in range(n - size + 1)]
        for wrong in range(n // 5 + 1):
            assert (n - wrong) >= 0.8 * n
            for lost in itertools.combinations(range(n), wrong):
                assert any(p.isdisjoint(lost) for p in placed), (n, lost)


def test_edited_and_short_items_are_found(spark):
    items, docs, want = [], [], set()
    for n in (1, 2, 4, 5, 7, 9, 10, 12, 15, 20, 25):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        wrong = min(n, 20) // 5
        for at in range(n - wrong + 1):
            lost = item[:at] + [f"other{k}" for k in range(wrong)] + item[at + wrong :]
            docs.append((len(docs), " ".join(["before"] * 3 + lost + ["after"] * (at % 2))))
            want.add((docs[-1][0], n))
            if 1 < n < 20:
                docs.append((len(docs), " ".join(["before"] * 3 + lost[:at] + ["more"] + lost[at + 1 :][::-1])))
    rows = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id in {x for x, _ in want}} == want
    assert all(r.matched >= 0.8 * r.compared for r in rows)
