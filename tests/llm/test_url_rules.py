"""URL rules against the definition, on made-up hosts with deep nesting and on odd URLs."""

import random

from tripweave.llm import url_rules


def by_hand(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        tail = url.split("://", 1)[1]
        end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tail[:end])
        rest = tail[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for of, start, verdict in rules:
        if not of or verdict is None or not host:
            continue
        start = start or ""
        if (host == of or host.endswith("." + of)) and path.startswith(start):
            best = max(best or (0,), (len(of + start), len(of), of + start, verdict))
    return host, path, best[2] if best else None, best[3] if best else default


def run(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    found = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **options)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r.page_id: tuple(r)[1:] for r in found.collect()}


def test_nested_hosts(spark):
    rng = random.Random(5)
    labels = ["a", "b", "a-b", "ab", "c"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 5))) for _ in range(400)]
    rules = [(h, rng.choice(["", "/", "/en/", "/en/x", "/d"]), rng.choice(["allow", "block"])) for h in rng.sample(hosts, 60)]
    urls = [f"http://{h}{rng.choice(['', '/', '/en/x/1', '/en/', '/dx?q=/en/', '#/en/'])}" for h in hosts for _ in range(3)]
    found = run(spark, urls, rules)
    assert found == {i: by_hand(u, rules) for i, u in enumerate(urls)}


def test_odd_urls_and_rules(spark):
    urls = [
        None, "", "no scheme.com/", "http://", "http:///en/", "http://COM/", "http://x.Example.COM/en/a?b#c", "http://example.com.", "http://.com/", "http://a..com/",
        "ftp://com://en/", "http://éx.com/", "http://com?x=/", "http://İ.com/", "http://com-/", "http://com0/", "http://a\nb.com/x\ny", "http://b.com/" + "z" * 100_000,
    ]
    rules = [("com", "/", "allow"), ("COM", "/", "block"), ("example.com", None, "block"), (None, "/", "block"), ("", "/", "block"), ("x.com", "/", None)]
    found = run(spark, urls, rules)
    lowered = [(h.lower() if h else h, p, v) for h, p, v in rules]
    assert found == {i: by_hand(u, lowered) for i, u in enumerate(urls)}


def test_empty_tables_and_repeats(spark):
    assert run(spark, [], [("com", "/", "block")]) == {}
    assert run(spark, ["http://com/"] * 3, [], default="block") == dict.fromkeys(range(3), ("com", "/", None, "block"))
    assert run(spark, ["http://com/"] * 3, [("com", "/", "block")] * 2) == dict.fromkeys(range(3), ("com", "/", "com/", "block"))


def test_no_python(spark, sf):
    from tripweave.llm.queries import QUERIES

    plan = QUERIES["op2_url_rules"](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
