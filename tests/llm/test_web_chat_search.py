import hashlib
import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import chat, topk, warc
from trialframe.llm import html_text
from trialframe.llm.html_text import extract_text, main_text, minimum_cut, read_blocks, smoothness

# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><a href="/">Site</a> name</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div><div id="ad1" class="ad">Buy now!</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
line&nbsp;here.<p>Second &lt;tag&gt; &#233;.<br>after</p><ul><li>item one</li><li>item <a href=x>two</a></li></ul><form>Name: <input><button>Send</button></form>
<!-- hidden --><p></p><p>Last.</p><section class="comments"><p>Nice article, thanks for it, reader number one here.</p></section></article>
<aside>Related stories you may like</aside><div class="sidebar"><p>Most read</p></div><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
MAIN = "Title & more\nFirst bold line here.\nSecond <tag> é. after\nitem one\nitem two\nLast."


def test_main_text():
    assert main_text(PAGE) == MAIN
    assert main_text("") == ""
    assert html_text.main_text(PAGE.replace("<article>", "<main>").replace("</article>", "</main>")) == MAIN
    assert main_text("<body><p>Just a plain page with one long paragraph of text that has no marks around it at all, which is content.</p></body>").startswith("Just a plain page")
    assert main_text("<nav><a href=x>a</a></nav>") == ""
    assert main_text("<article>" + "<div>" * 500 + "deep text." + "</div>" * 500 + "</article>") == "deep text."


def test_extract_keeps_columns_and_nulls(spark):
    pages = spark.createDataFrame([(1, PAGE, "old"), (1, PAGE, "old"), (2, None, "x"), (3, "", None), (None, "<article><p>" + "long " * 200_000 + "</p></article>", "y")], "page_id long, html string, text string")
    out = extract_text(pages)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == MAIN and got[2] == "" and got[3] == "" and len(got[None]) == 999_999
    assert sorted(out.columns) == ["html", "page_id", "text"] and extract_text(pages.where("false")).count() == 0


def page_edges(r, n):
    """A chain and edges that do not cross, like those of a page."""
    edges = [(i, i + 1, r.choice((0.5, 1, 2))) for i in range(n - 1) if r.random() < 0.9]

    def inside(a, b):
        if b - a > 1:
            if r.random() < 0.7:
                edges.append((a, b, r.choice((0.5, 1, 2))))
            m = r.randint(a + 1, b - 1)
            inside(a, m), inside(m, b)

    inside(0, n - 1)
    return edges


def labelling_cost(side, source, sink, edges):
    return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])


@pytest.mark.parametrize("seed", range(25))
def test_minimum_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 10)
    source, sink = [r.choice((0, 1, 3.5, 7)) for _ in range(n)], [r.choice((0, 1, 2.5, 6)) for _ in range(n)]
    edges = page_edges(r, n)
    got = labelling_cost(minimum_cut(source, sink, edges), source, sink, edges)
    assert got == pytest.approx(min(labelling_cost(s, source, sink, edges) for s in itertools.product((True, False), repeat=n)))


def maximum_flow(source, sink, edges):
    """The value of the maximum flow, by augmenting paths."""
    n = len(source)
    room = [[0.0] * (n + 2) for _ in range(n + 2)]
    for i in range(n):
        room[n][i], room[i][n + 1] = source[i], sink[i]
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += c
    value = 0.0
    while True:
        came, queue = {n: n}, [n]
        for a in queue:
            for b in range(n + 2):
                if b not in came and room[a][b] > 1e-9:
                    came[b] = a
                    queue.append(b)
        if n + 1 not in came:
            return value
        path, b = [], n + 1
        while b != n:
            path.append((came[b], b))
            b = came[b]
        least = min(room[a][b] for a, b in path)
        value += least
        for a, b in path:
            room[a][b] -= least
            room[b][a] += least


@pytest.mark.parametrize("seed", range(10))
def test_the_cut_is_as_small_as_the_flow_is_large(seed):
    r = random.Random(seed)
    n = r.randint(20, 60)
    source, sink = [5 * r.random() for _ in range(n)], [5 * r.random() for _ in range(n)]
    edges = page_edges(r, n)
    assert labelling_cost(minimum_cut(source, sink, edges), source, sink, edges) == pytest.approx(maximum_flow(source, sink, edges))


def test_the_edges_of_pages_do_not_cross():
    r = random.Random(1)
    tags = ["div", "p", "ul", "li", "b", "a", "section", "td", "h2", "span"]
    for _ in range(200):
        page = "".join(r.choice((f"<{t}>", f"</{t}>", f"word{t} ", f"<{t} class=x>more")) for t in r.choices(tags, k=80))
        blocks = read_blocks(page)
        edges = smoothness(blocks)
        source, sink = [r.random() for _ in blocks], [r.random() for _ in blocks]
        got = labelling_cost(minimum_cut(source, sink, edges), source, sink, edges)
        assert got == pytest.approx(maximum_flow(source, sink, edges))


def test_deep_and_long_pages_need_little():
    began = time.time()
    deep = "<article>" + "<div>" * 100_000 + "deep text." + "</div>" * 100_000 + "</article>"
    assert main_text(deep) == "deep text."
    long = "<article>" + "".join(f"<p>A paragraph, number {i}.</p><div class=menu><a href=x>Link {i}</a></div>" for i in range(10_000)) + "</article>"
    assert main_text(long) == "\n".join(f"A paragraph, number {i}." for i in range(10_000))
    assert main_text("<p>" + "<b>" * 20_000 + "<div>x</p>" * 5_000) == ""
    assert time.time() - began < 20


LONG = ("The council met on Tuesday to discuss the new library, which has been delayed for several years, and voted in favour of funding.", "Residents said that they were pleased with the decision, although some worried about the cost of parking and the noise of works.")
NEUTRAL = f"""<div class="a1"><div class="b1"><a href=x>Home</a></div><div class="b1"><a href=x>World</a></div><div class="b1">See what is new today, right here.</div><div class="b1"><a href=x>Sport</a></div><div class="b1"><a href=x>Contact</a></div></div>
<div class="c9"><div class="k">{LONG[0]}</div><div class="k">{LONG[1]}</div><div class="k">Why now</div><div class="k">{LONG[0]}</div></div><div class="z"><div><a href=x>Imprint</a></div><div><a href=x>Terms</a></div></div>"""


def test_the_cut_corrects_what_evidence_alone_gets_wrong(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for weights in (html_text._prior(), html_text.learn_blocks(pages)):
        blocks = read_blocks(NEUTRAL)
        alone = [b.text for b in blocks if (c := html_text.costs(b, weights))[0] > c[1]]
        assert "Why now" not in alone and "See what is new today, right here." in alone
        assert main_text(NEUTRAL, weights) == "\n".join((*LONG, "Why now", LONG[0]))


def plain_article(page):
    """The article of a page of the given table, without a parser: its blocks are headings, paragraphs and line breaks."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p)))).strip() for p in re.split(r"</?(?:p|h1|li|ul)>", inner)]
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_every_article_of_the_table(spark, sf):
    from trialframe.llm.queries import op2_html_extraction

    page = {r["page_id"]: r["html"] for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    got = op2_html_extraction(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(page)
    for r in got:
        assert r["text"] == (plain_article(page[r["page_id"]]) if page[r["page_id"]] else "") and r["n_chars"] == len(r["text"])


# -- WARC


@pytest.mark.parametrize("archive,broadcast", [(64 << 20, 1 << 18), (3_000, 2), (1, 1 << 18)])
def test_archives_round_trip(spark, monkeypatch, archive, broadcast):
    monkeypatch.setattr(warc, "CHUNK", 700)  # records run over chunk ends
    monkeypatch.setattr(warc, "ARCHIVE", archive)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(warc, "HOT_ROWS", 4)
    r = random.Random(1)
    bodies = [None, "", "same é", "x" * 5000, "line\r\n\r\nWARC/1.1\r\n"] + ["".join(chr(r.randint(32, 900)) for _ in range(r.randint(0, 900))) for _ in range(20)]
    rows = [(i, f"http://e/{i}\r\nX: y" if i % 7 == 0 else None, bodies[i % len(bodies)], "z") for i in range(60)] + [(59, "u", bodies[59 % len(bodies)], "z"), (None, "n", "same é", "z"), (None, "n", "only here", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    archives = warc.write_archives(pages)
    sizes = archives.groupBy("archive").agg(F.sum(F.length("data")).alias("n")).collect()
    assert all(r["n"] < archive + 6_000 for r in sizes) and (len(sizes) == len(rows) if archive == 1 else len(sizes) <= 3 if archive > 10_000 else len(sizes) > 3)
    out = warc.read_archives(archives).collect()
    assert len(out) == len(rows)
    most = {}
    for i, _, b, _ in rows:
        if i is not None:
            most[b or ""] = max(i, most.get(b or "", -1))
    text = {i: (b or "") for i, _, b, _ in rows if i is not None}
    for o in out:
        if o["page_id"] is None:
            continue
        data = text[o["page_id"]].encode()
        assert o["payload_bytes"] == len(data) and o["payload_digest"] == warc.base32_sha1(data)
        target = most[text[o["page_id"]]]
        assert (o["record_type"], o["refers_to"]) == (("response", None) if target == o["page_id"] else ("revisit", target))
        assert o["payload"] == (data if o["record_type"] == "response" else None)
    assert sorted((o["record_type"], o["refers_to"]) for o in out if o["page_id"] is None)[1] == ("revisit", most["same é"])
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_small_payloads_may_be_left_alone(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_damage_is_found():
    whole = warc.record(1, "u", b"payload", None, False) + warc.record(2, "u", b"other", None, False)
    for size in (1, 7, 10_000):
        chunks = [whole[i : i + size] for i in range(0, len(whole), size)]
        assert [warc.parse(m)[2] for m in warc.members(chunks)] == [b"payload", b"other"]
    zeros = warc.record(3, "u", b"\0" * 5_000_000, None, False)  # much more than goes in comes out
    many = [warc.record(i, "u", b"x" * (i % 50), None, False) for i in range(3_000)]
    assert len(warc.parse(next(warc.members([zeros])))[2]) == 5_000_000
    assert [warc.parse(m)[2] for m in warc.members([b"".join(many)])] == [b"x" * (i % 50) for i in range(3_000)]
    with pytest.raises(ValueError):
        list(warc.members([whole[:-3]]))
    member = next(warc.members([whole]))
    with pytest.raises(ValueError):
        warc.parse(member.replace(b"payload", b"Payload"))
    with pytest.raises(ValueError):
        warc.parse(member[:-6] + b"\r\n\r\n")


# -- chat


def test_escape_is_reversible():
    for t in ("", "\\", "<|im_end|>", "<\\|im_end|>", "\\<|", "a\nb", "<<||", "\\n", "<|im_end|><|im_start|>assistant ok"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.read_turns(chat.marked_turns([(t, t), ("user", "x")])) == [(t, t), ("user", "x")]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo\\<|"), (1, 1, "assistant", "yo\\<|"), (1, None, "system", None), (2, 0, None, "only user"), (None, 0, "assistant", "é🙂"), (3, 0, "assistant", "z" * 100_000), (3, 1, "assistant", "")]
    turns = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.chat_digests(made).collect()}
    assert got[1]["n_turns"] == 4 and got[2]["n_turns"] == 1 and len(got) == 4
    whole = "system\n\nuser\nhi <|im_end|>\nassistant\nyo\\<|\nassistant\nyo\\<|\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"yo\\<|yo\\<|").hexdigest() and got[1]["loss_chars"] == 10
    assert got[None]["loss_chars"] == 2 and got[3]["loss_chars"] == 100_000 and got[2]["loss_chars"] == 0
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_rewriting_templates_are_reported():
    messages = [("user", "a"), ("assistant", "b"), ("user", "c")]

    def only_last(ms):
        return "".join(f"[{t}]" for _, t in ms[-2:])

    assert chat.turn_spans(messages, only_last)[2] == 2
    text, spans, rewrites = chat.turn_spans(messages, lambda ms: "<s>" + "".join(f"{r}: {t}; " for r, t in ms))
    assert rewrites is None and [text[c:d] for _, _, c, d in spans] == ["a", "b", "c"] and spans[-1][1] == len(text)


def test_long_conversations_take_time_in_proportion():
    r = random.Random(3)
    messages = [(r.choice(("user", "assistant")), "x" * r.randint(0, 9) + r.choice(("", "<|im_end|>", "\\"))) for _ in range(4_000)]
    began = time.time()
    text, spans, rewrites = chat.turn_spans(messages, chat.marked_turns)
    assert time.time() - began < 5 and rewrites is None and text == chat.marked_turns(messages)
    assert [chat.unescape(text[c:d]) for _, _, c, d in spans] == [t for _, t in messages]
    assert [a for a, _, _, _ in spans[1:]] == [b for _, b, _, _ in spans[:-1]]


@pytest.mark.parametrize("n", [10, 40, 70, 200])
def test_windows_and_prefixes_agree(n):
    messages = [("user" if i % 2 else "assistant", f"t{i}") for i in range(n)]

    def numbered(ms):
        return "<s>" + "".join(f"[{i}] {r}: {t}\n" for i, (r, t) in enumerate(ms))

    def forgets(ms):  # drops the oldest turns of long conversations
        return "".join(f"{t};" for _, t in ms[-50:])

    def first(ms):
        return "".join(f"{ms[0][1] if k % 10 == 0 else ''}{t};" for k, (_, t) in enumerate(ms))

    for template in (chat.marked_turns, numbered, forgets, first, lambda ms: "<s>" + "".join(f"{r}={t}|" for r, t in ms)):
        assert chat.turn_spans(messages, template) == chat._by_prefixes(messages, template)
    assert (chat.turn_spans(messages, forgets)[2] is None) == (n <= 50)


# -- search


def brute_top(ids, x, q, k):
    out = []
    for i in q:
        v = x[ids.index(i)]
        s = sorted(((-int(np.dot(v, w)), j) for j, w in zip(ids, x) if j != i))[:k]
        out += [(i, r + 1, j, -c) for r, (c, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,block", [(300, 8, 64), (7, 3, 16384), (900, 16, 512)])
def test_top_k_against_brute_force(spark, monkeypatch, n, dims, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FEW", 20)
    r = np.random.default_rng(n)
    x = np.round(r.normal(0, 40, (n, dims))).astype(int)
    x[n // 2 :: 3] = x[0]  # ties
    ids = [int(i) for i in r.permutation(n * 2)[:n]]
    v = spark.createDataFrame([(i, [int(c) for c in w], "s") for i, w in zip(ids, x)], "vec_id long, vector array<long>, score string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 5 = 0"), 5).collect())
    assert got == brute_top(ids, x, [i for i in ids if i % 5 == 0], 5)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, 0.1]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.1]), (7, [0.5, 0.1]), (None, [1.0, 1.0])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 128 * 128 - 64 * 25), (0, 2, 7, 128 * 128 - 64 * 25)]
    assert topk.top_k(v, v.where("false")).count() == 0 and topk.top_k(v.where("false"), v, 5).count() == 0
    assert [r["vector"] for r in topk.quantise(spark.createDataFrame([(1, [-0.001, 0.999])], "vec_id long, embedding array<float>")).collect()] == [[-1, 255]]
    twice = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (0, [5, 0]), (1, [3, 1]), (2, [1, 9])], "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 0"), 1).collect())
    assert got == [(0, 1, 1, 15), (0, 1, 2, 19)]


def test_top_k_of_large_components(spark, monkeypatch):
    r = random.Random(8)
    x = [[r.choice((1, -1)) * r.choice((3, 10**6, 2 * 10**9 // 3, 7 * 10**8)) for _ in range(2)] for _ in range(60)] + [[2 * 10**9, 2 * 10**9], [10**6, 10**6]]
    v = spark.createDataFrame([(i, w) for i, w in enumerate(x)], "vec_id long, vector array<long>").repartition(3)
    monkeypatch.setattr(topk, "BLOCK", 16)
    want = []
    for i in range(0, 62, 5):
        best = sorted((-sum(a * b for a, b in zip(x[i], w)), j) for j, w in enumerate(x) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(t) for t in topk.top_k(v, v.where("vec_id % 5 = 0"), 5).collect()) == sorted(want)
    huge = topk.quantise(spark.createDataFrame([(0, [1e300, 1e300]), (1, [1.0, -1.0]), (2, [-1e300, -1e300])], "vec_id long, embedding array<double>"))
    assert [tuple(t) for t in topk.top_k(huge.where("vec_id < 2"), huge.where("vec_id = 0"), 1).collect()] == [(0, 1, 1, 0)]
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(huge, huge.where("vec_id = 0"), 5).collect()
