"""The operators against brute force, on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flowlens.llm import decontaminate as D
from flowlens.llm import host_reputation as H
from flowlens.llm import jaccard_join as J
from flowlens.llm import main_text as M
from flowlens.llm import mixing as X
from flowlens.llm import quality as Q
from flowlens.llm import token_counts as TC
from flowlens.llm import token_files as TF
from flowlens.llm import toxicity as TX
from flowlens.llm import warc as W
from flowlens.session import scratch_path

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, row_id string, mix string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta"]) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty, tiny and very long texts, repeated rows and
    ids, near copies, and extra columns named like the operators' own."""
    rng = random.Random(3)
    base = words(rng, 200)
    near = base.split()
    near[100] = "changed"
    rows = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, "b"), (5, "", None), (6, "one", "a"), (7, "one", "b"),
            (None, base, None), (None, None, None), (8, words(rng, 60), "c"), (9, words(rng, 40000), "c"), (10, "x " * 300, "c"),
            (11, "# $ % " * 60 + words(rng, 60), "a"), (12, "same line here\n" * 40 + words(rng, 30), "a"), (13, " \n\t ", "a"),
            (14, "see <|endoftext|> 日本語 \U0001F600 it's  two   spaces\r\n end\n", "b")]
    rows += [(20 + i, words(rng, 80), "hot") for i in range(30)]
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", "y") for i, t, s in rows], DOCS)


def test_quality_rules(spark, docs):
    got = Q.quality_rules(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id}
    p = Q.QualityParams()
    for r in got:
        if r.doc_id is None:
            continue
        t = text[r.doc_id] or ""
        ws = WORD.findall(t)

        def hit(n):
            grams = collections.Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
            on = set()
            for i in range(len(ws) - n + 1):
                if grams[tuple(ws[i:i + n])] > 1:
                    on.update(range(i, i + n))
            return on

        lines, dup, chars = set(), 0, 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup, chars = (dup + 1, chars + sum(map(len, WORD.findall(x)))) if x in lines else (dup, chars)
                lines.add(x)
        total, sym, rep = sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(hit(3))
        base = len(ws) < 50 or 100 * rep > 50 * len(ws)
        bad = chars > p.line_share * total or sym > p.symbols_per_word * len(ws) or any(
            sum(len(ws[i]) for i in hit(n)) > s * total for n, s in p.gram_share.items())
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), total, sym, dup, rep)
        assert (r.base_failed, r.kept) == (base, not base and not bad)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_host_reputation(spark):
    urls = ["http://Shop.COM/a?x", "https://example.com/en/1", "https://www.example.com/en/1", "http://a.example.com/en/2#t", "x.net/es/1", None, "",
            "http://b.net/es/", "http://b.net/de/", "http://bad.org/1", "http://good.org/1", "http://7.7.7.7:80/x", "http://notcom/", "http://ba\nd.org/x"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, bad int")
    out = spark.createDataFrame([("http://bad.org/9", 1)] * 40 + [("http://good.org/9", 0)] * 60 + [(None, None), ("http://good.org/", None)], "url string, bad int")
    got = {r.page_id: r for r in H.host_reputation(pages, out).collect()}
    assert len(got) == 15 and got[0].host == "shop.com" and got[0].path == "/a"
    assert [got[i].rule for i in range(9)] == ["com/", "example.com/en/", "www.example.com/en/", "example.com/en/", None, None, None, "net/es/", None]
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "block"]
    assert got[9].verdict == "block" and got[10].verdict == "allow" and got[9].bad_mean > 0.8 > got[8].bad_mean
    assert got[5].host == got[5].path == "" and got[12].rule is None
    none = H.host_reputation(pages, out.limit(0)).collect()
    assert len(none) == 15 and not [r for r in none if r.rule is None and r.verdict == "block"]
    assert H.host_reputation(pages.limit(0), out.limit(0)).count() == 0


def test_main_text(spark):
    page = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>'
            '<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>First  long\n paragraph of the text, '
            'quite long.<br>more<p>Short.</p><p>Another paragraph that has a good many words in it.</p><form>mail<input></form></article>'
            '<aside>side bar text</aside><section class="comments"><p>I think this comment is long enough to count as text.</p></section><footer>&copy; me')
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "plain text only"), (5, "u", "<p>" * 2000 + "deep words here"), (1, "u", page),
            (6, "u", "<nav>only menu</nav>"), (7, "u", "<" * 50 + "&#x41;&nbsp;b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in M.extract_text(df).collect()}
    want = "Head & line\nFirst long paragraph of the text, quite long. more\nShort.\nAnother paragraph that has a good many words in it."
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[i].text for i in (2, 3, 4, 5, 6)] == ["", "", "plain text only", "deep words here", ""]
    assert M.extract_text(df).count() == 8 and M.extract_text(df.limit(0)).count() == 0


def test_main_text_keeps_what_surrounds_the_longest_part():
    rng = random.Random(8)
    long = [words(rng, 80) for _ in range(12)]
    body, side, menu = "".join(f"<p>{x}</p>" for x in long), words(rng, 30), "<nav><a>Home</a></nav><ul><li><a>one</a><li><a>two</a></ul>"
    for tag in ("div", "section", "table><tr><td"):
        inner = f"<{tag}>{body}</{tag.split('>')[0]}>"
        want = ["Headline", "Intro.", *long, "Out."]
        assert M.main_text(f"{menu}<article><h1>Headline</h1><p>Intro.</p>{inner}<p>Out.</p></article>").split("\n") == want
        assert M.main_text(f"{menu}<main><h1>Headline</h1><p>Intro.</p><article>{inner}</article><p>Out.</p></main>").split("\n") == want
        # one dominating section, and no article at all
        for top in ("article", "div"):
            assert M.main_text(f"<{top}>{inner}<section><h2>Second</h2><p>{side}</p></section></{top}>").split("\n") == [*long, "Second", side]
    two = f"<body>{menu}<article>{body}</article><article><p>{side}</p></article></body>"
    assert M.main_text(two).split("\n")[-13:] == [*long, side]


def test_main_text_names_and_ratios():
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    links = "".join(f"<li><a href='/{k}'>{w}</a></li>" for k, w in enumerate(["Home", "News", "About us", "Contact", "Jobs"] * 2))
    # slugs and classes of the text's own
    text = (f"<h1>Head</h1><p>{a}</p><h2 id='related-work'>Related work</h2><p class='share-price'>{b}</p><section id='social-policy'><h2>Policy</h2><p>{c}</p>"
            f"</section><h2 id='cookies'>Cookies</h2><div id='notice-of-results'><p>{d}</p></div><p id='comments'>Short.</p>")
    want = ["Head", a, "Related work", b, "Policy", c, "Cookies", d, "Short."]
    # named as boilerplate, with the ratio of it; also where the name has a wrapper's word
    named = [f"<div class='{n}'><ul>{links}</ul></div>" for n in ("main-nav", "page-footer", "post-comments", "sidebar-content", "social-share", "related")]
    for top in ("article", "main"):
        assert M.main_text(f"<body><{top}>{text}</{top}>").split("\n") == want
        for n in named:
            assert M.main_text(f"<body>{n}<{top}>{text}</{top}>{n}").split("\n") == want
            assert M.main_text(f"<body><{top}>{text}{n}</{top}>").split("\n") == want
    # a wrapper of the text keeps it, without what is low inside it
    for n in named:
        for wrap in ("content-with-sidebar", "has-sidebar layout"):
            assert M.main_text(f"<body><div class='{wrap}'>{n}<div><p>{a}</p><p>{b}</p></div>{n}</div>").split("\n") == [a, b]
    assert M.main_text("<div class='main-nav'>only this</div>") == "only this"
    deep = "<div class='main-nav'>" * 3000 + "low" + "</div>" * 3000
    assert M.main_text(f"{deep}<article><p>{a}</p></article>") == a


def test_main_text_drops_sure_blocks_inside_the_article():
    rng = random.Random(11)
    a, b, c, d = (words(rng, 50) + "." for _ in range(4))
    say = "I read this with great interest, and I have a good many words to say about it too."
    want = ["Head", a, b, c]
    page = "<body><nav>Home</nav>{}<article><h1>Head</h1><p>" + a + "</p>{}<section id='discussion'><h2 id='ad'></h2><p>" + b + "</p></section><p>" + c + "</p>{}</article>{}<footer>x</footer></body>"
    blocks = [f"<section class='comments'><p>{say}</p><div class='comment'><p>{say}</p></div></section>", f"<div class='ad'><p>{say}</p></div>", f"<p class='advert'>{say}</p>",
              f"<div class='cookie-notice'><p>{say}</p></div>", f"<div class='Newsletter box'><p>{say}</p></div>", f"<div id='comments'><p>{say}</p></div>", f"<figure class='ad_banner'>{say}</figure>", f"<ul class='breadcrumbs'><li>{say}</li></ul>"]
    talk = f"<div id='discussion'><article class='comment'><p>{say}</p></article><article><p>{say}</p></article></div>"
    for x in blocks:
        for html in (page.format("", x, "", ""), page.format("", "", x, ""), page.format("", "", "", x), page.format(x, "", "", talk)):
            assert M.main_text(html).split("\n") == want, html
            assert M.main_text(html.replace("article", "main", 2).replace("</article>", "</main>", 1)).split("\n")[-1] != say
    two = f"<body><article><h1>Head</h1><p>{a}</p><p>{b} {c} {d}</p></article><article><h2>Next</h2><p>Short one.</p><p>{d[:60]}</p></article></body>"
    assert M.main_text(two).split("\n") == ["Head", a, f"{b} {c} {d}", "Next", "Short one.", d[:60].strip()]


def naive_text(html):
    """An independent extractor of the generator's own pages: block texts of the
    article, by regular expressions."""
    import html as H

    body = re.sub(r"(?is)<(script|style|nav|aside|footer|form|header)\b.*?</\1>|<!--.*?-->", " ", html)
    body = re.sub(r"(?is)<(div|p|section|ul)\b[^>]*class=[\"']?(?:ad|ads|advert|comments|cookie[\w-]*|notice|sidebar|menu)\b[^>]*>.*?</\1>", " ", body)
    found = re.findall(r"(?is)<article\b[^>]*>(.*?)</article>", body)
    lines = []
    for x in found:
        for block in re.split(r"(?i)</?(?:p|h[1-6]|div|section|ul|ol|li|table|tr|td|blockquote|pre)\b[^>]*>", x):
            text = " ".join(H.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<br[^>]*>", " ", block))).split())
            if text:
                lines.append(text)
    return "\n".join(lines)


def test_main_text_of_all_pages_equals_a_naive_extractor(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in M.extract_text(pages).collect()}
    with_article = [i for i, h in html.items() if "<article" in (h or "")]
    assert len(with_article) > 0.9 * len(html)
    assert [i for i in with_article if got[i] != naive_text(html[i])] == []


def test_main_text_is_linear():
    import time

    for page in ("<a " * 100_000, "<b>" * 100_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>" * 100_000, "<!-- " + "x " * 4_000_000, "</a" * 100_000, "<li><i>" * 50_000):
        began = time.process_time()
        assert M.main_text(page + "<p>tail</p>") in ("tail", "") or page.startswith("<!--")
        assert time.process_time() - began < 10


def test_decontamination(spark, docs):
    rng = random.Random(5)
    items = [(100, words(rng, 30)), (101, words(rng, 12)), (102, "tiny item Five words"), (102, "tiny item Five words"), (103, None), (None, "one two"), (104, ""),
             (105, "solo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b = items[0][1].split(), items[1][1]
    extra = [(900, "pre " + " ".join(a[5:20]).upper().replace("É", "É") + " mid " + b + " post", None), (901, "say TINY item, five WORDS now tiny item five words", None),
             (902, " ".join(a[5:14]), None), (903, "solo", None), (903, "solo", None), (904, " ".join(a) + " " + " ".join(a), None), (905, "tiny item five", None)]
    every = docs.select("doc_id", "text", F.col("lang").alias("items")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, items string"))
    got = D.decontaminate(every, bench).collect()
    rows = every.collect()
    assert len(got) == len(rows)

    def brute(text):
        dw, on, ids = D.words_of(text or ""), set(), set()
        for i, t in items:
            iw = D.words_of(t or "")
            k = min(10, len(iw))
            if i is None or not k:
                continue
            for x in range(len(iw) - k + 1):
                for y in range(len(dw) - k + 1):
                    if dw[y] == iw[x] and dw[y:y + k] == iw[x:x + k]:
                        on.update(range(y, y + k))
                        ids.add(str(i))
        return len(dw), len(on), sorted(ids)

    key = lambda r: (r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted([(r.doc_id, *brute(r.text)) for r in rows], key=key)
    assert all(r.n_hit == 0 for r in D.decontaminate(docs, bench.limit(0)).collect())
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def brute_join(rows, least=0.8):
    sets = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        sets.append({tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws and i is not None else set())
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    return sorted(((i, min(low[find(k)]) if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("params", [J.JoinParams(), J.JoinParams(bucket=4, tile=3, levels=2)])
def test_jaccard_join(spark, docs, params):
    rng = random.Random(9)
    base = words(rng, 120).split()
    group = [(500 + k, " ".join(base[:40] + [f"w{k}"] + base[41:])) for k in range(25)]  # splits and tiles with the small limits
    shared = [(600 + k, " ".join(base[:40]) + " " + words(rng, 100)) for k in range(15)]  # a passage in common, no near copies
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(group + shared, "doc_id long, text string")).withColumn("class_id", F.lit("z"))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(every, params).collect()), key=str)
    assert got == brute_join([(r.doc_id, r.text) for r in every.collect()])


def test_jaccard_join_empty(spark, docs):
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = X.mix_sources(docs, mix="m").collect()
    n = {s: len(WORD.findall(" ".join(t or "" for t in ts))) for s, ts in _by_source(docs).items()}
    used = collections.Counter()
    for r in got:
        used[r.source] += r.m[1]
    total, p = sum(n.values()), X.MixParams()
    shares = np.array([v for v in n.values() if v]) / total
    mixed = np.array([used[s] for s, v in n.items() if v], float)
    assert mixed.sum() <= total
    entropy = lambda q: -(q / q.sum() * np.log(q / q.sum())).sum()
    assert entropy(shares) < p.entropy_share * np.log(len(shares))  # so the exponent is below 1
    assert max(m / (s * total) for m, s in zip(mixed, shares, strict=True)) <= p.max_repeat + 1e-9
    small = X.mix_sources(docs, mix="m", params=X.MixParams(budget_tokens=0)).collect()
    assert {r.m[1] for r in small} <= {0}
    twice = X.mix_sources(docs.where("source = 'hot'"), mix="m", params=X.MixParams(budget_tokens=2 * n["hot"], block_rows=4)).collect()
    assert len(twice) == 60 and {r.m[0] for r in twice} == {0, 1}
    part = X.mix_sources(docs.where("source = 'hot'"), mix="m", params=X.MixParams(budget_tokens=n["hot"] * 3 // 2, block_rows=4)).collect()
    assert len(part) == 45 and all(0 <= r.m[2] < 1 for r in part)  # 80 words each: half of the second epoch fits
    assert X.mix_sources(docs.limit(0)).count() == 0


def _by_source(docs):
    out = collections.defaultdict(list)
    for r in docs.collect():
        out[r.source].append(r.text)
    return out


def _ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs):
    got = sorted(TF.token_files(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in docs.collect())
    want = {(r.doc_id, zlib.crc32(np.array(_ids(r.text) + [0], "<u4").tobytes())): len(_ids(r.text)) + 1 for r in docs.collect()}
    at = 0
    for r in got:
        assert r.start == at and want[(r.doc_id, r.ids_crc32)] == r.n_tokens
        at += r.n_tokens
    assert TF.token_files(docs.limit(0), PATH).count() == 0


def test_token_counts(spark, docs):
    got = TC.token_counts(docs.select("doc_id", "text", F.lit(1).alias("n_bytes")), PATH, limit=100).collect()
    want = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id:
            n = len(_ids(want[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 100)
    assert TC.token_counts(docs.limit(0), PATH).count() == 0


def test_pieces_equal_the_library():
    rng, enc, count = random.Random(2), TF.Encoder(PATH), TC.MergeCounter(PATH)
    alphabet = ["a", "B", "é", "中", "1", "٣", " ", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "a.", "!!", "<|endoftext|>", "\U0001F600", "\x1c", "\r\n", "\x85", "the"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        want = enc.tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([s], b"")[0], enc.dtype).tolist() == want
        assert count.count([s]) == [len(want)]


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/é", "<p>x</p>"), (1, "http://b/é", "<p>x</p>"), (2, None, None), (5, "u", ""), (None, "n", "<p>x</p>"),
            (7, "v", "long " * 200000), (8, "w", "own")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in W.archive_round_trip(pages).collect()), key=str)
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        kind = "revisit" if b in first else "response"
        want.append((i or 0, kind, first.get(b), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()))
        first.setdefault(b, i)
    assert got == sorted(want, key=str)
    assert all(r.record_type == "response" for r in W.archive_round_trip(pages, min_bytes=10**9).collect())
    assert W.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_rejects_a_changed_payload(spark):
    out = scratch_path(spark, "warc-bad")
    W.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), out)
    stored = spark.read.parquet(f"{out}/payloads").withColumn("payload", F.lit(b"abd")).collect()
    spark.createDataFrame(stored, "sha256 binary, payload binary").write.mode("overwrite").parquet(f"{out}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        W.index_archive(spark, out).collect()


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    toxic = ["scumword", "trashword", "vileword"]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        t = words(rng, rng.randint(20, 120)).split()
        if bad:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(toxic))
        rows.append((i, " ".join(t), "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(5000, None, None), (5001, "", "en"), (None, "scumword", "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = TX.toxicity(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.98
    assert {r.score for r in TX.toxicity(docs, lab.limit(0)).collect()} == {0.0}
    # toxic labels alone: positives and unlabelled texts
    alone = [r for r in TX.toxicity(docs, lab.where("toxic = 1")).collect() if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in alone]) > 0.95 and sum(r.predicted for r in alone) > 20


def test_toxicity_risk_and_gradient():
    """The gradient against differences of the risk, on both sides of zero."""
    rng = np.random.default_rng(3)
    sides = set()
    for shift in (-3.0, -1.0, 0.0, 2.0):
        zp, zu, prior = rng.normal(2, 1, 9) , rng.normal(shift, 1, 14), 0.6
        plain = lambda a, b: sum(np.log1p(np.exp(-x)) for x in a) / len(a) * prior, lambda a, b: sum(np.log1p(np.exp(x)) for x in b) / len(b) - prior * sum(np.log1p(np.exp(x)) for x in a) / len(a)
        assert TX.risk(zp, zu, prior) == pytest.approx([f(zp, zu) for f in plain])
        below = TX.risk(zp, zu, prior)[1] < 0
        sides.add(below)
        loss = (lambda a, b: -plain[1](a, b)) if below else (lambda a, b: plain[0](a, b) + plain[1](a, b))
        gp, gu = TX.risk_gradient(zp, zu, prior, 0.0)
        for z, g in ((zp, gp), (zu, gu)):
            for i in range(len(z)):
                z[i] += 1e-5
                up = loss(zp, zu)
                z[i] -= 2e-5
                down = loss(zp, zu)
                z[i] += 1e-5
                assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-7)
    assert sides == {True, False}


def test_toxicity_document_frequencies(spark, docs):
    bits = 12
    got, n = TX.document_frequencies(docs.repartition(4), np.ones(1 << bits, bool), bits)
    want = np.zeros(1 << bits, int)
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        want[np.unique(TX.features(raw, np.array([0, len(raw)]), bits)[1])] += 1
    assert n == docs.count() and (got == want).all()
    few = np.arange(1 << bits) % 3 == 0
    assert (TX.document_frequencies(docs, few, bits)[0] == np.where(few, want, 0)).all()


def test_mixing_limits(spark):
    """A budget that no exponent keeps within ``max_repeat`` is an error; many
    small blocks end where one running sum over a source ends."""
    rows = [(i, f"{'w ' * (1 + i % 7)}", f"s{min(i % 5, 1)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(len(t.split()) for _, t, _ in rows)
    with pytest.raises(ValueError, match="readings"):
        X.mix_sources(df, X.MixParams(budget_tokens=4 * total + 1))
    few = X.mix_sources(df, X.MixParams(budget_tokens=total // 3, block_rows=5)).select("doc_id", "mix.epoch").collect()
    one = X.mix_sources(df, X.MixParams(budget_tokens=total // 3, block_rows=10**6)).select("doc_id", "mix.epoch").collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, one)) and 0 < len(few) < 400
    full = X.mix_sources(df, X.MixParams(budget_tokens=4 * total, entropy_share=0.1)).select("source", "mix.n_tokens").collect()
    assert sum(r.n_tokens for r in full) <= 4 * total


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    for c in ("kept", "hit_id", "hit_key", "key", "mix", "mark", "id_", "key_"):
        docs = docs.withColumn(c, F.lit(1))
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    path = scratch_path(spark, "pipeline-in")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    judged = corpus_pipeline.quality_stage(spark, docs, SF)
    assert judged.columns == docs.columns
    assert judged.count() == Q.quality_rules(docs).where("kept").count()
    near = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    cls = {r.doc_id: r.class_id for r in J.jaccard_join(docs).collect() if r.doc_id is not None}
    kept = [r.doc_id for r in near.collect()]
    assert near.columns == docs.columns and kept.count(None) == 1
    assert sorted(i for i in kept if i is not None) == sorted(i for i, c in cls.items() if i == c)
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    hit = D.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert clean.columns == docs.columns and clean.count() == hit.where("n_hit = 0").count()
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.token_stage(spark, docs, SF).count() == docs.count()
    none = docs.limit(0)
    assert [f(spark, none, SF).count() for _, f in corpus_pipeline.STAGES] == [0] * 5


def test_near_duplicates_of_reused_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 120) for _ in range(4))
    near = f"{c} more"
    rows = [(1, a), (5, a), (5, b), (7, c), (7, near), (7, d), (7, d), (8, near), (9, b), (2, "tiny"), (2, "tiny"), (2, ""), (2, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    pair = [(7, t) for t in (c, near) if (7, t) in kept]  # one of two near copies under one id
    assert len(pair) == 1 and kept.pop(pair[0]) == 1
    assert kept.pop((2, ""), 0) + kept.pop((2, None), 0) == 1
    assert kept == {(1, a): 1, (5, b): 1, (7, d): 1, (2, "tiny"): 1, (None, a): 2}


def test_new_pieces_are_encoded_joined(monkeypatch):
    """Few texts reach the library, with the ids that it gives piece by piece;
    pieces whose joined ids don't end where they do go one by one."""
    enc = TF.Encoder(PATH)
    single = lambda p: np.array(enc.tok.encode(p, add_special_tokens=False).ids, enc.dtype).tobytes()
    rng, given, plain = random.Random(5), [], enc.encode_texts
    monkeypatch.setattr(enc, "encode_texts", lambda texts: given.extend(texts) or plain(texts))
    letters = "abcdefgé日本😀'’-_\n\t<|endoftext|>0.,"
    pieces = list(dict.fromkeys(" " + "".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(5000)))
    pieces += [" <|endoftext|>", " x<|endoftext|>y", "  two", " ", "", "first", " end\n"]
    assert enc.encode_pieces(pieces) == [single(p) for p in pieces]
    assert len(given) < 0.2 * len(pieces)
    given.clear()
    enc.n_bytes = enc.n_bytes + 1
    words = [" some", " new", " words,", " " + "z" * 40_000]
    assert enc.encode_joined(words) == [single(p) for p in words] and len(given) > len(words)
    assert enc.encode_joined([]) == []
