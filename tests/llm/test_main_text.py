"""Main text of pages."""

import html
import random
import re
from collections import defaultdict

from skyquilt.llm import main_text


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r for r in main_text.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)
        want = re.sub(r"</?b>", "", inside[1] if inside else "")
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", want)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def brute(rows):
    """Text of each page by the rules, from token tuples: runs outside articles, where all suffixes count."""
    run, parsed = main_text.RUN, {i: [t for t, furniture, _ in main_text.blocks(h) if not furniture] for i, _, h in rows}
    where, streams = defaultdict(set), defaultdict(set)
    for i, url, _ in rows:
        tokens, host = [w for t in parsed[i] for w in t.split()], url.split("/")[2]
        streams[host].add(tuple(tokens))
        for k in range(len(tokens) - run + 1):
            where[(host, *tokens[k : k + run])].add(tuple(tokens))
    out = {}
    for i, url, _ in rows:
        tokens, host = [w for t in parsed[i] for w in t.split()], url.split("/")[2]
        covered = [False] * len(tokens)
        for k in range(len(tokens) - run + 1):
            n = len(where[(host, *tokens[k : k + run])])
            if n >= 2 and n >= main_text.OUTSIDE_SHARE * len(streams[host]):
                covered[k : k + run] = [True] * run
        at, kept = 0, []
        for t in parsed[i]:
            n = len(t.split())
            if sum(covered[at : at + n]) < main_text.COVERED * n:
                kept.append(t)
            at += n
        out[i] = " ".join(kept)
    return out


def test_whole_texts_against_brute_force_however_rows_are_dealt(spark):
    rng = random.Random(8)
    shared = [" ".join(f"s{k}w{j}" for j in range(rng.randrange(4, 30))) for k in range(12)]
    rows = []
    for i in range(150):
        blocks = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"p{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 8))]
        rows.append((i, f"http://h{i % 3}.org/{i}", "<body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body>"))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(40)]
    want = brute(rows)
    assert sum(want[i] != " ".join(t for t, f, _ in main_text.blocks(h) if not f) for i, _, h in rows) > 100
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        assert {r.page_id: r.text for r in main_text.main_text(pages.repartition(parts)).collect()} == want


def test_pages_without_an_article_lose_what_their_host_repeats(spark):
    furniture = "<div>Welcome to the site of many things that we all like a lot</div>"
    rows = [(i, f"http://h.example.com/{i}", f"<body>{furniture}<p>story {i} has words {i * 7} of its own {i}</p><div class='cookie-notice'>ok?</div></body>") for i in range(700)]
    rows += [(1000, None, None), (1001, "x", ""), (1002, "http://a/", "a < b &lt;i&gt; &#233;&nbsp;&nbsp;c<br>d<b>e</b>f <p class=\"x"), (1003, "http://h.example.com/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
    assert all(got[i] == f"story {i} has words {i * 7} of its own {i}" for i in range(700))
    assert got[1000] == "" and got[1001] == "" and got[1002] == "a < b <i> é c def" and got[1003] == got[0]
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_articles_keep_copies_and_lose_what_most_of_them_repeat(spark, monkeypatch):
    advert = "<p>Please send us your own news by post or bring it to our desk</p>"
    long = f"<p>{' '.join(f'notice{k}' for k in range(90))}</p>"
    pages = [f"<article><h1>t{i}</h1>{advert}<p>{' '.join(f'w{i}x{k}' for k in range(20))}</p>{long}</article>" for i in range(20)]
    copy = "<article><p>one two three four five six seven eight nine ten</p></article>"
    rows = [(i, "http://a.b/x", p) for i, p in enumerate([*pages, copy, copy, copy.replace("<article>", "<article><h2>again</h2>")])]
    rows += [((1 << 53) + 1, "http://a.b/y", copy), (None, "http://a.b/y", f"<article><p>{'long ' * 400_000}</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    for most in (main_text.BROADCAST_HEADS, 0):
        monkeypatch.setattr(main_text, "BROADCAST_HEADS", most)
        texts = {r.page_id: r.text for r in main_text.main_text(df).collect()}
        assert all(texts[i] == f"t{i} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(20))
        assert texts[20] == texts[21] == texts[(1 << 53) + 1] == "one two three four five six seven eight nine ten" and texts[22].startswith("again one two")
        assert len(texts[None]) == 400_000 * 5 - 1
