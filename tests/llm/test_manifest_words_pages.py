"""Merkle manifest, spelling variants and main text of pages against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle, queries, spelling, wrappers
from quarry.llm.html_tokens import parse

SMALL = "/root/testdata/sf0.001"


def clashing(df, *names):
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


# ---- Merkle manifest ------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root of a list of digests, and for each the levels of its run: (slot, run)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for k, a in enumerate(at):
            paths[k].append((a % 3, runs[a // 3]))
            at[k] = a // 3
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def brute_manifest(rows):
    """(key, source, leaf digest, changed digest) rows: the result rows, in order."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
             for s in sources]
    own = [climb([r[2] for r in t]) for t in trees]
    root, over = climb([o[0] for o in own])
    out = []
    for tree, (subroot, paths), above in zip(trees, own, over):
        for r, path in zip(tree, paths):
            siblings, now = [], r[3]
            for slot, run in path + above:
                siblings += run[:slot] + run[slot + 1:]
                now = sha(*run[:slot], now, *run[slot + 1:])
            out.append((r[0], r[1], r[2], subroot, root, sha(*siblings), now, now == root))
    return out


def manifest(spark, rows, height):
    df = spark.createDataFrame([(k, s, bytearray.fromhex(a), bytearray.fromhex(b)) for k, s, a, b in rows],
                               "key long, source string, leaf binary, changed binary")
    got = merkle.verify(clashing(df, "tree", "pos", "n", "block", "digest", "part"), height).collect()
    return [tuple(r) for r in got]


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_hashing_every_node(spark, height):
    r = random.Random(height)
    rows = []
    for source, n in (("hot", 95), ("b", 1), (None, 27), ("", 4), ("é", 10), ("c", 2), ("d", 9)):
        for i in range(n):
            key = r.randrange(-5, 200) if r.random() > 0.05 else None
            a = leaf(key, source, i)
            rows.append((key, source, a, a if r.random() < 0.6 else leaf("changed", i)))
    rows += rows[:3]  # repeated rows
    assert sorted(manifest(spark, rows, height), key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "a", leaf(1), leaf(1))]
    assert manifest(spark, one, 8) == brute_manifest(one) == [(1, "a", leaf(1), leaf(1), leaf(1), sha(), leaf(1), True)]
    assert manifest(spark, one[:0], 8) == []


def test_leaves_are_length_prefixed(spark):
    rows = [(1, "s", None, "é\n"), (None, None, 3, None), (2, "", 0, "long " * 100_000)]
    df = spark.createDataFrame(rows, "a long, b string, c long, d string")
    got = df.select(F.hex(merkle.leaf_digest("a", "b", "c", "d"))).collect()
    assert [g[0].lower() for g in got] == [leaf(*r) for r in rows]


# ---- spelling variants ----------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_sorted_scan_finds_all_words_one_edit_apart():
    r = random.Random(3)
    for _ in range(400):
        letters = r.choice(["ab", "a", "abc", "aéz"])
        words = sorted({"".join(r.choices(letters, k=r.randint(0, 8))) for _ in range(r.randint(1, 40))})
        want = [(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])]
        assert sorted(spelling.near_words(words)) == sorted(want)


def brute_variants(counts):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("list_words", [2, 7, 4000])
def test_variants_equal_comparing_all_words(spark, list_words):
    r = random.Random(list_words)
    words = {"".join(r.choices("ab", k=r.randint(6, 9))) for _ in range(150)}
    words |= {"stationary"[:i] + c + "stationary"[i + 1:] for i in range(10) for c in "xyzé"}
    words |= {"a" * 30, "a" * 31, "a" * 5000, "a" * 4999 + "b"}
    counts = {w: 5 * 6 ** r.randint(0, 4) + r.randint(0, 1) for w in words}
    df = clashing(spark.createDataFrame(list(counts.items()), "word string, n long"), "front", "size", "near", "root")
    got = [tuple(x) for x in spelling.variants(df, list_words=list_words).collect()]
    assert sorted(got) == brute_variants(counts)


def test_vocabulary_drops_characters_and_counts(spark):
    rows = [(i, " ".join(["Straße", "größer?", "kitchen-table", "ÉCLAIRE", "abcdef"] * 2)) for i in range(300)]
    rows += [(None, "kitchen " * 7), (5, None), (6, ""), (7, "short word"), (8, "x" * 30_000), (8, "x" * 30_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "word", "n", "k", "w")
    want = Counter()
    for k, s in rows:
        run = ""
        for c in (s or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{k}:{run}".encode()) if k is not None else 1
                if h % 7 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                want[run] += len(run) >= 6
            run = ""
    got = {r.word: r.n for r in spelling.vocabulary(df, drop_every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert {"itchen", "kitchen", "x" * 30_000} - set(got) == {"x" * 30_000} and len(got) == 7


def test_no_words(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(df)).collect() == []


# ---- main text ------------------------------------------------------------------------

def sentence(r, n=25):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n)) + "."


def boxed(r, k):
    """A page of nested boxes without article elements, with optional and repeated parts."""
    body = [sentence(r) for _ in range(r.randint(2, 6))]
    head = sentence(r, 5)
    note = '<div class="cookie-notice"><p>We use cookies on this site, please accept them all now.</p></div>'
    links = "".join(f'<li><a href="/{i}">{sentence(r, 3)}</a>' for i in range(r.randint(1, 5)))
    comments = "".join(f'<div class="comment c{i}"><p>{sentence(r)}</p></div>' for i in range(r.randint(0, 3)))
    html = (f'<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header>Site</header>'
            f'<div id="top"><ul>{links}</ul></div>{note if k % 2 else ""}<div id=post-{k} class="wrap"><h1>{head}</h1>'
            f'<div class="text"><p>{"<p>".join(body)}</div></div>'
            f'<p>All rights reserved by the owners of this site and their friends, {"since 1999" if 1 else ""}.</p>'
            f'<div id="comments">{comments}</div><form><p>Write <b>to</b> us</p></form></body></html>')
    return html, "\n\n".join([head, *body])


def article(r, k):
    body = [sentence(r) for _ in range(r.randint(1, 4))]
    ad = f'<div class="ad-box"><p>{sentence(r)}</p></div>'
    html = (f"<!doctype html><body><nav><a href=/>Home</a></nav><main><article><header><h1>Title &amp; {k}</h1></header>"
            f"<p>{body[0]}<br>more &lt;b&gt; <i>in</i>line&nbsp;text</p>{ad if k % 3 == 0 else ''}"
            + "".join(f"<p>{b}</p>" for b in body[1:])
            + f"<ul><li>one<li>two</ul></article><section class=comments><article class=comment><p>{sentence(r)}"
              "</p></article></section></main><aside>side</aside><footer>&copy; us</footer>")
    return html, "\n\n".join([f"Title & {k}", body[0] + " more <b> inline text", *body[1:], "one", "two"])


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    out = []
    for k in range(60):
        out.append((k, f"https://boxes.example/{k}", *boxed(r, k)))
        out.append((100 + k, f"http://News.example:80/{k}?x=//y", *article(r, k)))
    out += [(300, "http://alone.example/", *article(r, 9)), (301, None, *boxed(r, 3)), (302, "http://boxes.example", None, ""),
            (303, "", "", ""), (None, "http://news.example/x", *article(r, 3)), (305, "http://a.example/", "<p>" * 3000 + "x", "x"),
            (306, "http://b.example/", "<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
            (307, "http://c.example/", "<!-- open", ""), (308, "http://d.example/", "< 3 > 2 <", "< 3 > 2 <")]
    return out + out[:2]


@pytest.mark.parametrize("group", [2, 64])
def test_main_text_of_unlike_templates(spark, pages, group):
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    df = clashing(df.repartition(5), "host", "stream", "texts", "slot", "flags", "text", "kept_0")
    got = sorted(((x.page_id, x.url, x.text, x.n_chars) for x in wrappers.main_text(df, group=group).collect()), key=repr)
    want = sorted(((p[0], p[1], p[3], len(p[3])) for p in pages), key=repr)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert len(got) == len(want) and not wrong, wrong[0]


def test_wrappers_mark_optional_and_repeated_parts():
    def shape(node):
        return node[0].split()[0] + ["", "?", "+", "*"][node[1]] + (f"({' '.join(map(shape, node[3]))})" if node[3] else "")

    def one(html):
        stream, texts, linked, slot = wrappers.page_stream(html)
        return wrappers.with_stats(stream, [(1, 1, 0, None)] * (max(slot) + 1))

    a = one("<h1>a</h1><ul><li>x<li>y</ul><p>t</p>")
    b = one("<h1>a</h1><div class=ad>z</div><ul><li>x</ul><p>t</p><p>u</p>")
    assert shape(wrappers.infer([a, b])) == "page(h1(#) div?(#) ul(li+(#)) p+(#))"
    assert shape(wrappers.infer([b, a])) == shape(wrappers.infer([a, b]))


def test_broken_markup_is_read_to_its_end():
    tree = parse("<p>a<p>b<table><tr><td>c<td>d</table><a title='>'>e</a></p><script>x")
    texts = []

    def walk(n):
        texts.extend([n.text] if n.tag == "#" else [])
        for c in n.children:
            walk(c)
    walk(tree)
    assert texts == ["a", "b", "c", "d", "e"]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_text(df).collect() == []


def test_registered_queries_agree_with_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in ("op11_spelling", "op12_merkle", "op13_main_text"):
        got = queries.query.__globals__["QUERIES"][name](spark, SMALL)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.query.__globals__['ORACLE'][name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))
