"""Edit embedding, HTML extraction and chat rotation against brute force."""

import functools
import hashlib
import random

import numpy as np
import pytest

from cadence.llm import chat, edit_embedding, html_text


def brute_walk(text: str) -> list[int]:
    _, rows = edit_embedding.stay()
    j, out = 0, []
    for c in edit_embedding.classes(text):
        out.append(j)
        j += rows[j % edit_embedding.PERIOD][c]
    return [*out, j]


def test_walks_side_by_side_are_the_walk():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé🙂") for _ in range(n)) for n in [0, 1, 5, 300, 2000] + [rng.randrange(80) for _ in range(120)]]
    for text, at in zip(texts, edit_embedding.walk([edit_embedding.classes(t) for t in texts])):
        assert at.tolist() == brute_walk(text)


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))

    def edited(k: int) -> str:
        t = list(text)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
        return "".join(t)

    own, few, many, other = edit_embedding.fingerprint_texts([text, edited(5), edited(200), text[::-1]])
    near = [edit_embedding.likeness(own, p) for p in (own, few, many, other)]
    assert near[0] == 1.0 and near[1] > 0.7 > near[2] > near[3]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(10))) for _ in range(2))

        @functools.lru_cache(None)
        def d(i, j, a=a, b=b):
            return max(i, j) if not i or not j else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

        assert edit_embedding.edit_distance(a, b, 20) == d(len(a), len(b))
        assert edit_embedding.edit_distance(a, b, 2) == min(3, d(len(a), len(b)))


@pytest.mark.parametrize("bytes_each", [24 << 20, 64])
def test_fingerprints_and_neighbours(spark, monkeypatch, bytes_each):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice("abcd é") for _ in range(rng.randrange(40)))) for i in range(60)] + [(500, None), (501, "")]
    whole = edit_embedding.neighbours
    monkeypatch.setattr(edit_embedding, "neighbours", lambda d, a, b: whole(d, a, b, bytes_each))
    got = {r["doc_id"]: r for r in edit_embedding.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        p, q, n = edit_embedding.fingerprint_texts([t, e, u])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (p.tobytes().hex(), q.tobytes().hex())
        assert r["candidate"] == (edit_embedding.bands(np.array([p])) == edit_embedding.bands(np.array([q]))).any()
        assert r["near_edited"] == edit_embedding.likeness(p, q) and r["near_next"] == edit_embedding.likeness(p, n)


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    got = edit_embedding.fingerprints(odd_docs).toPandas()
    assert len(got) == 10 and got["near_edited"].between(0, 1).all() and edit_embedding.fingerprints(no_docs).count() == 0
    assert got[got["doc_id"] == 6]["fingerprint"].nunique() == 1


def test_similar_texts_share_a_band():
    rng = np.random.default_rng(6)
    a = rng.integers(1, 256, (50, edit_embedding.BINS)).astype(np.uint8)
    b = a.copy()
    b[:, :12] = 0
    keys, other = edit_embedding.bands(a), edit_embedding.bands(b)
    assert (keys == other).any(1).mean() > 0.95 and not (keys == np.roll(other, 1, 0)).any()


def test_links_are_edits(spark):
    rng = random.Random(7)
    rows, group = [], {}
    for g in range(12):
        base = [rng.choice("abcdefghijk ") for _ in range(600)]
        for c in range(rng.choice([1, 3])):
            own = list(base)
            for _ in range(4 * c):
                own[rng.randrange(600)] = rng.choice(["", "z", "yy"])
            rows.append((len(rows), "".join(own)))
            group[len(rows) - 1] = g
    rows += [(100, rows[0][1]), (101, None), (None, "x")]
    rows.append((None, rows[1][1] + "z"))  # a second row without id, near a text that has one
    rows.append((0, "another text of the same id"))
    members, edges = edit_embedding.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    node: dict = {}
    for r in members.collect():
        node.setdefault(r["id"], []).append(r["node"])
    assert members.count() == len(rows) and node[100][0] in node[0] and len(node[0]) == len(node[None]) == 2
    linked = [(r["a"], r["b"]) for r in edges.collect()]
    assert any({x, y} == {n, node[1][0]} for x, y in linked for n in node[None])
    names = {r["node"]: i for i, r in ((r["id"], r) for r in members.filter("id < 90").collect()) if r["node"] != next(n for n in node[0] if n != node[100][0])}
    from tests.llm.test_duplicates import classes

    got = edges.collect()
    got = [r for r in got if r["a"] in names and r["b"] in names]
    found = classes(len(group), [(names[r["a"]], names[r["b"]]) for r in got])
    # no link between groups; walks that don't catch up in time cost a few links within them
    assert [group[i] for i in range(len(group))] == [group[c] for c in found] and len(set(found)) <= len(set(group.values())) + 2
    for r in got[:10]:
        x, y = (rows[names[r[k]]][1] for k in "ab")
        assert r["distance"] == edit_embedding.edit_distance(x, y, 600) and r["likeness"] >= 0.3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Welcome to the site, dear reader.</p></header>
<div id="cookie-notice">We use cookies, ok?</div><nav><a href=x>Home</a> <a href=y>About</a></nav><div class="ad">Buy now, buy more, buy often.</div>
<div class="post"><h2>A title</h2><p><b>First para, with &amp; sign.<br><p>Second&nbsp; one, which
goes on.<p>Tiny.<ul><li>item one<li>item two</ul></div><div class="sidebar"><p>Related things, many of them, are listed here.</p></div>
<section id=comments><p>Nice post! I agree, really, with all of it.</p></section><form><p>Sign up for news, now.</p></form><script>var a="<p>no, not, this.</p>"</script><footer>c 2020, all rights.</footer>"""


def test_article_is_found():
    assert html_text.main_text(PAGE).split("\n\n") == ["A title", "First para, with & sign.", "Second one, which goes on.", "Tiny.", "item one", "item two"]


def test_paths_tell_where_nothing_is_named():
    menu = "".join(f"<li><a href='{i}'>Link {i}</a></li>" for i in range(20))
    text = "A sentence of the story, which goes on; and on, until it ends."
    html = f"<body><div><ul>{menu}</ul></div><div>" + f"<p>{text}</p>" * 5 + f"</div><table><tr>{'<td>x</td>' * 30}</tr></table></body>"
    assert html_text.main_text(html) == "\n\n".join([text] * 5)


def without_names(html: str) -> str:
    import re

    return re.sub(r"""\s(?:class|id|role|aria-label)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def test_pages_without_names_give_the_same(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert all(html_text.main_text(h) == html_text.main_text(without_names(h)) for h in pages)


def test_thresholds_decide_inside_the_article():
    text = "A sentence of the story, which goes on; and on, until it ends."
    cells = "".join(f"<div><div>{k}</div></div>" for k in range(20))
    html = f"<article><h2>Title</h2>{f'<p>{text}</p>' * 8}<ul><li>one point</li></ul><p><a href=x>A paragraph that is one link, as a source.</a></p>{cells}</article>"
    got = html_text.main_text(html).split("\n\n")
    assert got == ["Title", *[text] * 8, "one point", "A paragraph that is one link, as a source."]


def test_names_do_not_set_the_whole_article_apart():
    text = "A sentence of the story, which goes on; and on, until it ends."
    html = f'<body><div class="content with-sidebar">{f"<p>{text}</p>" * 6}</div><div class="sidebar"><p>Related, or not.</p></div></body>'
    assert html_text.main_text(html) == "\n\n".join([text] * 6)


def test_long_attributes_are_one_value():
    text = "A sentence of the story, which goes on; and on, until it ends."
    for n in (990, 1100, 100_000):
        junk = "x > y <p>no text</p> " * (n // 20)
        html = f"<body><article><p>{text}</p><img alt='{junk}'><p>{text}</p></article><aside data-x=\"{junk}\"><p>Aside, with text.</p></aside><div title='{junk}' class=sidebar><p>Beside, as well.</p></div></body>"
        assert html_text.main_text(html) == f"{text}\n\n{text}", n


def test_names_count_in_their_attributes_only():
    text = "A sentence of the story, which goes on; and on, until it ends."
    html = f"""<body><div title="a hidden gem" data-x="class='menu' id=sidebar style='display: none'"><p>{text}</p><p>{text}</p></div><div hidden><p>Not seen, ever.</p></div><p style="color: red; display:none">Nor this, no.</p></body>"""
    assert html_text.main_text(html) == f"{text}\n\n{text}"


def test_long_sidebars_stay_out():
    text = "A sentence of the story, which goes on; and on, until it ends."
    beside = "".join(f"<p>Another story, number {k}, that stands beside; it is longer, and has more to say.</p>" for k in range(12))
    for name in ("sidebar", "page-sidebar", "sideBar widget", "related"):
        html = f'<body><h1>Title</h1><div class="post"><p>{text}</p><p>{text}</p></div><div class="{name}">{beside}</div></body>'
        assert html_text.main_text(html).split("\n\n")[-2:] == [text, text] and "Another" not in html_text.main_text(html), name


def test_broken_tags_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("<a '\">", '<a "><a" ', '<a "', "<a '\"' \"'\" ", '<a "x" ', '<a x="y>', "<a ' <b \" "):
        html_text.main_text(part * 30_000)
    assert time.perf_counter() - began < 20


def test_path_values_by_brute_force():
    rng = random.Random(8)
    n = 40
    paths = [rng.randrange(6) for _ in range(n)]
    paths[:6] = range(6)
    length, marks, open_ = ([f() for _ in range(n)] for f in (lambda: rng.randrange(1, 400), lambda: rng.randrange(9), lambda: rng.random() < 0.8))
    mean = {p: [sum(v[i] for i in range(n) if paths[i] == p) / paths.count(p) for v in (length, marks)] for p in range(6)}

    def value(i: int) -> float:
        near = [mean[paths[min(max(i + d, 0), n - 1)]] for d in (-2, -1, 0, 1, 2)]
        smooth = [sum(w * x[k] for w, x in zip((1, 2, 4, 2, 1), near)) / 10 for k in (0, 1)]
        own = mean[paths[i]]
        return ((own[0] * smooth[0]) ** 0.5 * (1 + (own[1] * smooth[1]) ** 0.5)) ** 0.5

    got = html_text.path_values(np.array(paths), np.array(length, float), np.array(marks, float), np.array(open_))
    for p in range(6):
        own = [i for i in range(n) if paths[i] == p and open_[i]]
        want = sum(value(i) * length[i] for i in own) / max(1, sum(length[i] for i in own))
        assert abs(got[p] - want) < 1e-9


def test_broken_tags_are_dropped_in_linear_time():
    import time

    assert html_text.main_text('<article><p>One, two.</p><div class="x') == "One, two."
    assert html_text.main_text('<p>One < two, a<3.</p><p title="a>b">Three</p>') == "One < two, a<3.\n\nThree"
    began = time.perf_counter()
    for odd in ('<a "', "<a \"'>", "<!", "<a \"><b '", "<!--", "<p title='"):
        html_text.main_text(odd * 50_000)
    assert time.perf_counter() - began < 20


def test_broken_pages(spark):
    assert [html_text.main_text(x) for x in ("", "<!-- x", "<p>a", "<div>" * 3000 + "deep", "</p></p>x<b>y", "a &lt;b&gt;")] == ["", "", "a", "deep", "xy", "a <b>"]
    rows = [(1, "u", None, "clash"), (2, None, "<p>Some text, here.</p>", "clash"), (2, None, "<p>Some text, here.</p>", "clash"), (None, "v", "", "clash")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert sorted(got["text"]) == ["", "", "Some text, here.", "Some text, here."] and got["n_chars"].sum() == 32
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_rotation(rows: list[tuple], most: int) -> set:
    out = set()
    for conv in {r[0] for r in rows}:
        own = [(t, s or "unknown", (x or "").replace("<|", "< |")) for c, t, s, x in rows if c == conv]
        buckets = -(-sum(t is None for t, _, _ in own) // most)
        low = min((t // most for t, _, _ in own if t is not None and t < 0), default=0)

        def part_of(r):
            return r[0] // most if r[0] is not None else low - 1 - int(hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()[:8], 16) % buckets  # noqa: B023

        first = min(((t, x) for t, s, x in own if s == "system" and t is not None), default=None)
        for who in {s for _, s, _ in own if s != "system"}:
            for part in {part_of(r) for r in own}:
                text, mask, n = "", [], 0
                if first and first[0] // most != part:
                    text = f"<|im_start|>system\n{first[1]}<|im_end|>\n"
                for _, s, x in sorted((r for r in own if part_of(r) == part), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
                    text += "<|im_start|>" + ("assistant" if s == who else "system" if s == "system" else f"user name={s}") + "\n"
                    a = len(text)
                    text += x + "<|im_end|>\n"
                    n += 1
                    if s == who:
                        mask.append((a, len(text)))
                out.add((conv, who, part, n, text, ",".join(f"{a}:{b}" for a, b in mask), sum(b - a for a, b in mask)))
    return out


def test_rotation(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hé 🙂"), (1, 2, "ann", None), (1, 3, "bob", ""), (1, 3, "bob", ""), (2, 0, None, "who?"), (None, 5, "eve", "alone"), (1, None, "ann", "when"), (3, 0, "system", "only")] + [(4, None, "ann", f"n{k}") for k in range(7)] + [(4, 9, "system", "late"), (4, 9, "system", "later")]
    # negative numbers beside null ones
    rows += [(5, -3, "ann", "before"), (5, None, "bob", "when"), (5, 1, "ann", "after"), (5, -300, "bob", "long before"), (6, -1, "ann", "one"), (6, -2, "bob", "two")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for most in (256, 2):
        got = {tuple(r) for r in chat.rotate(df, most).collect()}
        assert got == brute_rotation([r for r in rows if r[0] != 3], most)
    assert chat.rotate(df.limit(0)).count() == 0
