"""URL rules and the secret ledger against plain Python."""

import hashlib

from pyspark.sql import functions as F

from barloom.llm import secret_scan, url_rules

URLS = [
    "https://www.example.com/en/1?x", "http://a.example.com/en/2", "http://example.com/de/", "http://EXAMPLE.com/en/", "http://example.com", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/#t", "http://net/es/", "http://org/en/", "ftp://com/", "no scheme", "", None, "http://", "http:///en/", "a://b.com?q/en/",
    "http://www.example.com./en/", "http://deep.www.example.com/en/x/y", "http://x.net/es/1",
]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def pages_of(spark, urls):
    rows = [(i if i % 5 else None, u, "x", "y") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")


def test_rules_match_plain_python(spark):
    more = url_rules.RULES + [("example.com", "/en/x", "allow"), ("deep.www.example.com", "/en/x/", "block"), ("com", "/de", "block")]
    for rules in (url_rules.RULES, more):
        got = url_rules.judge_urls(pages_of(spark, URLS * 3), spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")).collect()
        want = [(i if i % 5 else None, *judge(u, rules)) for i, u in enumerate(URLS * 3)]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_pages_and_no_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages_of(spark, []), spark.createDataFrame(url_rules.RULES, rules.schema)).count() == 0
    got = url_rules.judge_urls(pages_of(spark, URLS), rules).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in got] == [(None, "allow")]


def test_equal_rules_block(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages_of(spark, ["http://a.com/"]), rules).first().verdict == "block"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_no_python_in_the_plan(spark):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    plan = plan_of(url_rules.judge_urls(pages_of(spark, URLS), rules))
    assert "Python" not in plan and "Arrow" not in plan


def test_base_spans():
    hex32 = "0123456789abcdef" * 2
    text = f"é password = 'longenough1' Token:short API_KEY=\"abcd1234\" AKIA{'B' * 12} {hex32} {hex32[:31]} apikey=secret=abcdefgh1 password: token= longvalue99"
    spans = secret_scan.find_spans(text)
    assert [(k, text[s:e]) for k, s, e in spans] == [
        ("assign", "password = 'longenough1"), ("assign", 'API_KEY="abcd1234'), ("access", "AKIA" + "B" * 12), ("hex", hex32), ("assign", "apikey=secret=abcdefgh1"),
    ]
    assert secret_scan.find_spans(None) == secret_scan.find_spans("") == [] and not secret_scan.find_spans("toKen=\u017fhort7 pa\u017f\u017fword=abcdefgh")


def test_ledger_scans_each_blob_once_and_joins_back(spark):
    texts = ["token=abcdefgh1", None, "", "x" * 200_000 + " secret: zzzzzzzz9", "token=abcdefgh1", "clean"]
    docs = spark.createDataFrame([(i if i else None, t, "b", "s") for i, t in enumerate(texts)], "doc_id long, text string, blob string, spans string")
    found, ledger = secret_scan.scan_documents(docs)
    assert ledger.count() == 4  # the empty blob, two secrets, one clean
    got = {(r.doc_id, r.n_assign, r.spans) for r in secret_scan.digest(found).collect()}
    assert (None, 1, "assign:0:15") in got and (4, 1, "assign:0:15") in got and (1, 0, "") in got and (3, 1, "assign:200001:200018") in got
    assert secret_scan.digest(found).filter("doc_id = 2").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    # the next version of one path: one new blob, the rest is known
    more = docs.union(spark.createDataFrame([(9, "token=otherone2", "b", "s")], docs.schema))
    again, larger = secret_scan.scan_documents(more, ledger)
    assert larger.count() == 5 and again.count() == 7
    other = secret_scan.extend_ledger(docs, larger, rules="next")
    assert other.groupBy("rules").count().orderBy("rules").collect()[1]["count"] == 4


def test_ledger_trusts_what_it_holds(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string")
    blob = secret_scan.versions_of(docs).first().blob
    known = spark.createDataFrame([(blob, secret_scan.RULE_VERSION, [("hex", 1, 2)])], secret_scan.LEDGER)
    assert secret_scan.scan_documents(docs, known)[0].first().spans[0].kind == "hex"


def test_two_runs_over_one_ledger_give_the_rows_of_one(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, f"token=abcdefgh{i % 5}" if i % 3 else None, "b") for i in range(60)], "doc_id long, text string, known string")
    one, two = secret_scan.scan_documents(docs)[0], secret_scan.scan_history(docs, parts=2)
    rows = lambda found: sorted(map(str, secret_scan.digest(found).collect()))
    assert rows(one) == rows(two) and len(rows(two)) == 60
    # what the first run left is on the path of the second
    before = secret_scan.extend_ledger(docs.filter("doc_id < 4"))
    after = secret_scan.extend_ledger(docs, before)
    assert 0 < before.count() < after.count() == after.select("blob").distinct().count() == 6


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found, ledger = secret_scan.scan_documents(none)
    assert secret_scan.digest(found).count() == ledger.count() == 0 and F.lit(1) is not None
