"""URL filters and chat formatting."""

import brute
import compare
import pytest
from rough_rows import SF
from pyspark.sql import functions as F

from tidemark.llm import chat_format, queries, url_filters

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://a.b.example.com/en/x?y#z", "http://www.example.com/en/1", "http://example.com?q=/en/",
    "http://example.com/en", "http://com.evil.org/en/", "http://notexample.com/en/", "x://deep.net/fr/#", "http://net/es/..", "http://example.com./en/",
    "http://user@www.example.com:80/en/", "http://a.COM/é😀", "http://example.com\n/en/", "http://example.com/en/" + "x" * 100_000,
]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        for c in "?#":
            rest = rest.split(c)[0]
        host, _, path = rest.partition("/")
        path = rest[len(host) :]
        host = host.translate(brute.UPPER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [
    url_filters.RULES, (), (("example.com", "", "block"), ("www.example.com", "/en/1", "allow"), ("b.example.com", "/", "allow"), ("b.example.com", "/en/", "block"), ("org", "/", "block")),
])
def test_urls_match_plain_rules(spark, rules):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = url_filters.filter_urls(pages, url_filters.rule_table(spark, rules))
    assert set(got.columns) == {"page_id", "url", "key", "host", "path", "rule", "verdict"}
    want = sorted((i, *judge(u, rules)) for i, u, *_ in rows)
    told = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted((tuple(r) for r in told), key=str) == sorted(want, key=str)


def test_url_rules_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "allow"), ("a.com", None, "allow")], url_filters.RULE_SCHEMA)
    assert url_filters.filter_urls(pages, rules).first()["verdict"] == "block"
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_url_query_matches_sql(spark):
    got = queries.QUERIES["op1_url_filters"](spark, SF).toPandas()
    assert compare.differences(got, compare.oracle(SF).execute(queries.ORACLES["op1_url_filters"]).df()) is None


def test_url_plan_has_no_python(spark):
    plan = queries.QUERIES["op1_url_filters"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


TURNS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "<|start|>assistant<|message|>x<|end|>\n\\<\\|"), (1, 1, "assistant", "<|start|>assistant<|message|>x<|end|>\n\\<\\|"),
    (2, 3, "system", "[INST]<<SYS>> <s></s>[/INST]"), (2, 1, "<|end|>\n", "role with a control string"), (2, None, None, None),
    (None, 0, "assistant", "no id"), (None, 1, "user", ""), (3, 0, "assistant", "😀é\n" * 30_000), (4, 0, "assistant", None), (5, 0, "assistant", "\\"), (5, 1, "assistant", "a\\\\b"),
]


def test_chats_round_trip(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    order = lambda t: tuple((v is not None, v) for v in t[1:])
    for key in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == key), key=order)
        assert tuple(got[key])[1:5] == brute.chat_digest([(r, s) for _, _, r, s in mine]), key
    for r in formatted.collect():
        inner = r["formatted"].replace("<|start|>", "").replace("<|message|>", "").replace("<|end|>", "")
        assert not any(c in inner for c in chat_format.CONTROLS)
        for a, b in zip(r["loss_starts"], r["loss_ends"]):
            assert r["formatted"][:a].endswith("assistant<|message|>") and r["formatted"][b:].startswith("<|end|>\n")
    assert chat_format.digests(chat_format.format_chats(turns.limit(0))).count() == 0


def test_chat_pieces_join_up(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SLICE_BYTES", 40)
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 3) for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in chat_format.digests(chat_format.format_chats(turns)).collect()]
    assert [g[:5] for g in got] == [(1, *brute.chat_digest([(r, t) for _, _, r, t in rows]))]


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {r["conv_id"]: tuple(r) for r in queries.QUERIES["op3_chat_format"](spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1][1:5] == brute.chat_digest([("user", said), ("assistant", said)])
    assert len(got) == len({r["conv_id"] for r in rows}) + 1
    for key in {r["conv_id"] for r in rows}:
        assert got[key][1:5] == brute.chat_digest([(r["role"], r["text"]) for r in rows if r["conv_id"] == key])
