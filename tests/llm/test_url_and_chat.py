import itertools

from pyspark.sql import functions as F

from airloom.llm import chat, url_filter


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(x) for x in "/?#" if x in rest] or [len(rest)])
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(x) for x in "?#" if x in path] or [len(path)])]
    fit = [r for _, r in url_filter.HOST_RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?y#z", "https://m.example.com/en/1", "http://com/", "http://x.net/es/", "http://x.net?a=/es/", "ftp://a.b://c/d", "http://É.COM/en", "http://a.com#/x", "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([], "tokens array<string>, bad boolean")
    got = {r.page_id: r for r in url_filter.judged(pages, labelled).collect()}
    verdict = {r: v for v, r in url_filter.HOST_RULES}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == brute_rule(u)
        assert got[i].verdict == verdict.get(got[i].rule, "allow")


def test_mined_rules_match_brute_force(spark):
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        host = "win-big.shop.org" if bad and i % 10 else "blog.shop.org" if i % 3 else "news.org"
        path = "/offer/free" if bad and not i % 10 else "/offer/x" if i % 2 else "/free/y"
        rows.append((f"http://{host}{path}?id=1", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean").select(url_filter.tokens(F.col("url")).alias("tokens"), "bad")
    rules = {frozenset(r.rule): r for r in url_filter.mined(df).collect()}
    data = [(frozenset(r.tokens), r.bad) for r in df.collect()]
    sure = set()
    for n in (1, 2, 3):
        for s in {frozenset(x) for t, b in data if b for x in itertools.combinations(sorted(t), n)}:
            k, total = sum(b for t, b in data if s <= t), sum(s <= t for t, _ in data)
            if k >= url_filter.MIN_SUPPORT and k / total >= url_filter.MIN_CONFIDENCE:
                sure.add(s)
    assert set(rules) == {s for s in sure if not any(o < s for o in sure)}
    pages = spark.createDataFrame([(1, "http://win-big.org/a"), (2, "http://blog.shop.org/offer/x"), (3, None), (1, "http://win-big.org/a")], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.judged(pages, df).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]


def best_cost(roles):
    """Least cost by trying all states."""
    cost = {chat.NONE: 0.0}
    for r in roles:
        new = {}
        for (s, to), way in chat.OPTIONS[r].items():
            if s in cost:
                new[to] = min(new.get(to, 1e9), cost[s] + way[0])
        cost = new
    return min(v + chat.END[s] for s, v in cost.items())


def legal(text):
    import re

    roles = re.findall(r"<\|start\|>(\w+)\n", text)
    body = roles[1:] if roles[:1] == ["system"] else roles
    return body == ["user", "assistant"] * (len(body) // 2) and text.count("<|end|>") == len(roles)


def test_every_short_chat_becomes_legal_at_least_cost(spark):
    rows = []
    for n in range(1, 5):
        for k, roles in enumerate(itertools.product(["system", "user", "assistant", "bot", None], repeat=n)):
            rows += [(n * 1000 + k, t, r, f"m{t} <|end|>") for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "2 as seq", "'x' as action")
    got = {}
    for r in chat.repaired(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(r)
    for c, roles in by.items():
        own = sorted(got[c], key=lambda r: (r.block, r.seq))
        assert legal("".join(r.rendered for r in own))
        assert abs(sum(r.cost for r in own) - best_cost([chat.known(r) for r in roles])) < 1e-9


def test_blocks_give_the_same_repair(spark):
    import random

    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", None]), f"t{t}") for c in range(4) for t in range(rng.randrange(30, 90))]
    rows += [(None, None, "user", "the same")] * 50
    rows += [(None, 1, "user", None), (None, None, "user", "x"), (9, 5, "user", "same"), (9, 5, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cost = lambda n: {r.conv_id: round(r.c, 6) for r in chat.repaired(df, n).groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()}
    by = {}
    for c, t, r, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        by.setdefault(c, []).append(chat.known(r))
    want = {c: round(best_cost(roles), 6) for c, roles in by.items()}
    assert cost(7) == cost(1) == cost(1024) == want
    text = {}
    for r in chat.repaired(df, 7).orderBy("block", "seq").collect():
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert all(map(legal, text.values())) and len(text) == 6
    assert chat.repaired(df.limit(0)).count() == 0
