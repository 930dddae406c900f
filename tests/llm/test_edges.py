"""Empty tables, clashing columns, very long rows and repeated ones for operators whose own tests lack them."""

import random

from metaloom.llm import decontaminate, secret_scan, token_count, url_filter

DOC = "doc_id long, text string, spans string, n_tokens string, contaminated string, word string"
PAGE = "page_id long, url string, html string, host string, rule string, score string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], DOC)


def test_clashing_columns_and_empty_tables(spark):
    docs = docs_of(spark, [None, "", "token = abcdefghijklmnop", "plain text"])
    path = token_count.default_path("byte_bpe_50k.json")
    assert [r.spans for r in secret_scan.scan_secrets(docs).orderBy("doc_id").collect()] == ["", "", "assign:0:24", ""]
    assert [r.n_tokens for r in token_count.count_tokens(docs, path).orderBy("doc_id").collect()][:2] == [0, 0]
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_a_passage_in_a_very_long_text_and_in_repeated_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = " ".join(word() for _ in range(40))
    long = " ".join([*(word() for _ in range(60_000)), item, *(word() for _ in range(60_000))])
    docs = docs_of(spark, [long, long, item, " ".join(word() for _ in range(500)), None, ""])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 6
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_long_repeated_and_missing_urls(spark):
    urls = [None, "", "no scheme", "http://x.org/" + "a" * 200_000, "https://EN.example.org/es/1", "https://EN.example.org/es/1", "http://shop.com/de/x", "http://shop.com/fr/x", "http://other.net/q"]
    pages = spark.createDataFrame([(i, u, "", "clash", "clash", "clash") for i, u in enumerate(urls)], PAGE)
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert [got[i].rule for i in (3, 4, 5, 6, 7)] == ["org/", "example.org/es/", "example.org/es/", "com/de/", "com/fr/"]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (0, 1, 2)] == [("", "", None)] * 3
    assert got[4].verdict == got[5].verdict == "block" and got[3].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
