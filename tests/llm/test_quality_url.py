import random

from paperloom.llm import quality_rules, url_filter
from tests.llm.brute import base_figures

GOOD = "The committee met in the old hall and talked for a long time about roads. " * 1


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    words = [r.choice("river stone lamp green walk under seven clouds paper market light window".split()) + str(r.randrange(99)) for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words)) + "."


def test_base_figures_match_plain_version(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", " ", "\n", "|", "é ", "ab ", "\t", "#"]) for _ in range(r.randrange(300))) for _ in range(150)] + ["", None, "\n\n", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality_rules.quality_rules(rows).collect():
        q = x["quality"]
        expected = base_figures(texts[x["doc_id"]])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == expected
        assert q["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (q["base_failed"] and q["kept"])


def test_line_rules_and_verdict(spark):
    body = "\n".join(prose(40, i) for i in range(4))
    nav = "Home | About | Contact | Shop | News | Help | Terms | Jobs | Press | Blog"
    docs = {1: body, 2: body + "\n" + nav, 3: "\n".join([nav + str(i) for i in range(9)]), 4: body + "\n" + body.split("\n")[0], 5: None}
    rows = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, clean_text string")
    got = {x["doc_id"]: x["quality"] for x in quality_rules.quality_rules(rows).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [True, True, False, True, False]
    assert got[2]["clean_text"] == body and got[2]["failed_lines"] == "navigation:1"
    assert got[4]["clean_text"] == body and got[4]["n_dup_lines"] == 1
    assert quality_rules.quality_rules(rows.limit(0)).count() == 0


RULES = [url_filter.UrlRule(*x) for x in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))]


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "https://x.example.com/de/4#top": ("x.example.com", "/de/4", "example.com/de/", "block"),
        "https://notexample.com/de/4": ("notexample.com", "/de/4", None, "allow"),
        "https://q.org?/fr/": ("q.org", "", None, "allow"),
        "ftp://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(u, "mine") for u in cases] * 2, "url string, host string")
    out = url_filter.filter_urls(rows, 0.0, RULES).collect()
    assert len(out) == 2 * len(cases)
    for x in out:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == cases[x["url"]]


def test_url_model_learns_and_degrades(spark):
    r = random.Random(1)
    word = lambda bad: r.choice(["casino", "lottery", "jackpot"] if bad else ["library", "museum", "garden"])
    data = [(i, f"http://{word(i % 2)}{r.randrange(99)}.com/{word(i % 2)}/{r.randrange(999)}", i % 2) for i in range(600)]
    rows = spark.createDataFrame(data, "id long, url string, blocked int")
    model = url_filter.fit_url_model(rows.where("id < 400"))
    held = url_filter.filter_urls(rows.where("id >= 400"), model, []).collect()
    right = sum((x["verdict"] == "block") == bool(x["blocked"]) for x in held)
    assert right >= 0.95 * len(held)
    assert url_filter.fit_url_model(rows.limit(0)) == 0.0
    assert url_filter.fit_url_model(rows.where("blocked = 1")) == 1.0


def test_verdicts_are_those_of_the_fitted_weights(spark):
    """Every verdict is computed again in plain Python from the model's weights: rules first, then the logistic function."""
    import math
    from collections import Counter

    r = random.Random(3)
    hosts = ["a.net", "news.example.net", "example.com", "x.org", "shop.example.com", "plain.de"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr', 'buy'])}/{r.choice(['tea', 'win', 'list'])}{r.randrange(50)}" for _ in range(300)] + [None, "", "no scheme", "http://plain.de"]
    rows = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    model = url_filter.fit_url_model(rows.selectExpr("id", "url", "CASE WHEN url LIKE '%win%' THEN 1 ELSE 0 END AS blocked"))
    tf, lr = model.stages
    weights, base = lr.coefficients.toArray(), lr.intercept
    p, verdicts = url_filter.UrlModelParams(), []
    for x in url_filter.filter_urls(rows, model, RULES).collect():
        rest = (x["url"] or "").split("://", 1)
        host, path = "", ""
        if len(rest) == 2:
            cut = min([rest[1].index(c) for c in "/?#" if c in rest[1]] or [len(rest[1])])
            host, path = rest[1][:cut].lower(), rest[1][cut:].split("?")[0].split("#")[0]
        fits = [rule for rule in RULES if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)]
        if fits:
            expected = max(fits, key=lambda rule: len(rule.text)).verdict
        else:
            grams = [mark + part[i : i + n] for mark, part in (("h:", host), ("p:", path)) for n in p.ngrams for i in range(max(len(part) - n + 1, 1))]
            score = base + sum(weights[tf.indexOf(g)] * c for g, c in Counter(grams).items())
            expected = "block" if 1 / (1 + math.exp(-score)) > p.threshold else "allow"
        assert (x["host"], x["path"], x["verdict"]) == (host, path, expected)
        verdicts.append(expected)
    assert {"allow", "block"} == set(verdicts)
