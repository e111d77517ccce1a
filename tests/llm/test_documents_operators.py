import json
import re

import numpy as np
import pytest
from helpers import save

from chronofold.llm import media, quotes, wrappers

FRAME = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li>{links}</ul></nav><div class="cookie-notice">We use cookies</div><article><h1>{title}</h1>{body}</article><aside>Related</aside><div id="comments"><p>First!</p></div><footer>&copy; host</footer></body></html>'


def page(i):
    return FRAME.format(links="".join(f'<li><a href="/{k}">L{k}</a></li>' for k in range(i % 4)), title=f"Title {i}", body=f"<p>Text &amp; {i}<br>more\n  lines</p><p><b>bold {i}</b> end</p>" + (f"<ul><li>one {i}</li><li>two {i}</li></ul>" if i % 2 else ""))


def want(i):
    return "\n".join([f"Title {i}", f"Text & {i} more lines", f"bold {i} end", *([f"one {i}", f"two {i}"] if i % 2 else [])])


def alone(raw):
    return wrappers.extract(raw, wrappers.Wrapper())


def extracted(spark, pages, host="h.x"):
    """What the operator makes of all pages of one host."""
    rows = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(wrappers.main_text(rows).collect(), key=lambda r: r.page_id)]


def test_wrappers_extract_the_article(spark):
    assert extracted(spark, [page(i) for i in range(12)]) == [want(i) for i in range(12)] == [alone(page(i)) for i in range(12)]


def prose(i, n=20):
    rng = __import__("random").Random(i)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_the_wrapper_decides_inside_the_article(spark):
    """A line that the host repeats and a list of links go, changing prose stays whatever its section is called."""

    def one(i):
        links = "".join(f'<li><a href="/{k}">{prose(100 + k, 2)}</a></li>' for k in range(i % 3 + 2))
        return f'<article><h1>{prose(i, 4)}</h1><p>{prose(i + 1000)}</p><p>Share this story with your friends</p><section id="related-work"><p>{prose(i + 2000)}</p></section><ul class="more">{links}</ul><p>{prose(i + 3000)}</p></article><div class="related">{prose(i + 4000)}</div>'

    got = extracted(spark, [one(i) for i in range(9)])
    assert got == ["\n".join([prose(i, 4), prose(i + 1000), prose(i + 2000), prose(i + 3000)]) for i in range(9)]
    single = alone(one(0))
    assert single != got[0] and "Share this story" in single and prose(2000) not in single


def test_copies_of_a_page_keep_their_text(spark):
    same = "<article><h1>Title</h1><p>The same article at many addresses</p></article>"
    bare = "<body><div><p>The same text, no article</p></div></body>"
    assert extracted(spark, [same] * 6) == ["Title\nThe same article at many addresses"] * 6
    assert extracted(spark, [bare] * 6) == ["The same text, no article"] * 6
    assert extracted(spark, [same] * 2) == ["Title\nThe same article at many addresses"] * 2


def test_a_hot_host_is_dealt_to_copies_of_its_wrapper(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(wrappers, "hot_limit", lambda rows: 4)
    assert extracted(spark, [page(i) for i in range(15)]) == [want(i) for i in range(15)]


def nodes_of(w):
    yield w
    for c in w.get("c", []):
        yield from nodes_of(c)


def test_alignment_is_union_free():
    nodes = list(nodes_of(wrappers.infer([page(0), page(1), page(3)])))
    assert any(n.get("k") == "li" and n["q"] in "+*" for n in nodes)
    assert any(n.get("k") == "ul" and n["q"] == "?" for n in nodes)
    assert any("t" in n and n["t"] is None for n in nodes) and any(n.get("t") == "We use cookies" for n in nodes)


def test_common_subsequence_equals_trying_all():
    rng = np.random.default_rng(9)

    def longest(x, y):
        if not x or not y:
            return 0
        return max(longest(x[1:], y), longest(x, y[1:]), 1 + longest(x[1:], y[1:]) if x[0] == y[0] else 0)

    for _ in range(300):
        x, y = ("".join(rng.choice(list("abc"), rng.integers(0, 7))) for _ in range(2))
        pairs = wrappers.common(list(x), list(y))
        assert len(pairs) == longest(x, y) and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def generates(wrapper, tree):
    """Whether a folded page is an instance of a wrapper, by trying all ways to read it."""
    if "t" in wrapper:
        return "t" in tree and wrapper["t"] in (None, tree["t"])
    if wrapper["k"] != tree.get("k"):
        return False

    def read(parts, items):
        if not parts:
            return not items
        one, most = parts[0], len(items) if parts[0]["q"] in "+*" and parts[0]["q"] else 1
        least = 0 if parts[0]["q"] in ("?", "*") else 1
        return any(all(generates(one, x) for x in items[:n]) and read(parts[1:], items[n:]) for n in range(least, min(most, len(items)) + 1))

    return read(wrapper["c"], tree["c"])


def test_the_wrapper_generates_every_page_it_was_inferred_from():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pages = ["".join(f"<{t}>{rng.integers(0, 3)}</{t}>" for t in rng.choice(["p", "h2", "table", "section"], rng.integers(0, 6))) for _ in range(4)]
        wrapper = wrappers.infer(pages)

        def plain(node):
            return {"k": node.key, "c": [plain(x) if isinstance(x, wrappers.Node) else {"t": wrappers.clean(x[0])} for x in node.items]}

        assert all(generates(wrapper, plain(wrappers.parse(p))) for p in pages), pages


def test_frames_without_article(spark):
    pages = [f'<body><div class="top">Site name</div><div><p>Body {i} text of this page</p></div><h5>Same line</h5><div><a href=1>a</a> <a href=2>b</a></div></body>' for i in range(5)]
    assert extracted(spark, pages) == [f"Body {i} text of this page" for i in range(5)]


def test_depth_bounds_no_result():
    for deep in (0, 10, 130, 3000):
        raw = "<div>" * deep + '<div class="advert">Buy</div><nav>Menu</nav><article><p>Text</p><div class="comments">First</div></article>'
        assert alone(raw) == "Text"
        assert len(json.loads(wrappers.packed(wrappers.infer([raw, raw + "<p>x"]))))


def test_a_slash_does_not_close_a_script():
    assert alone('<p>a</p><script src="x"/>var q=1;</script><p>b</p><style/>p{}</style>') == "a\nb"


def test_broken_markup_never_fails():
    for raw in (None, "", "<", "<p", "plain", "<p>a<p>b", "<article><p>x</div></section>y", "<script>", "<!-- open", "<p title='a>b'>c</p>", "<div>" * 3000 + "deep"):
        assert isinstance(alone(raw), str)
    assert alone("<p>a<p>b") == "a\nb"
    assert alone("<p>&#x41;&nbsp;&nbsp;&lt;b&gt;</p>") == "A <b>"


def test_wrapper_query_edges(spark, tmp_path):
    rows = [(i, f"http://h{i % 2}.x/{i}", page(i)) for i in range(20)] + [(30, None, page(30)), (31, "http://h0.x/", None), (32, "junk", ""), (None, "http://h1.x", page(33)), (1, "http://h1.x/1", page(1))]
    save(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as wrapper", "1 as rank", "2 as h", "3 as pages", "4 as place"), tmp_path, "pages")
    got = wrappers.op4_wrappers(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == want(r.page_id) for r in got if r.page_id is not None and r.page_id < 20)
    assert {r.text for r in got if r.page_id in (31, 32)} == {""}
    save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    assert wrappers.op4_wrappers(spark, str(tmp_path)).count() == 0


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you"),
        (1, 1, "a", "On Monday Bob wrote:\n> How are YOU\nFine, thanks"),
        (1, 2, "u", "something else"),
        (1, 3, "a", ">> How are you\n> Fine,  thanks\nGood!"),
        (1, 4, "u", None),
        (2, 0, "u", "> never said\nx"),
        (None, None, None, "> q"),
        (1, 2, "u", "something else"),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].text, by[1, 1].reply_to, by[1, 1].thread) == ("Fine, thanks", 0, 0)
    assert (by[1, 3].text, by[1, 3].reply_to, by[1, 3].n_quotes, by[1, 3].quote_depth, by[1, 3].thread) == ("Good!", 1, 2, 2, 0)
    assert by[2, 0].reply_to is None and by[2, 0].text == "x" and by[1, 4].text == ""
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.reply_order)]
    assert order == [0, 1, 3, 2, 2, 4]
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_lines_link_to_the_latest_earlier_message(spark):
    rows = [(1, t, "u", "ok") for t in range(0, 200, 2)] + [(1, 199, "a", "> ok\nyes")]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[199].reply_to == 198


def brute_replies(rows):
    """reply_to of each (conv, turn, role, text) by trying every earlier message for every passage."""
    out = {}
    split = lambda t: (t or "").replace("\r\n", "\n").split("\n")
    level = lambda line: len(re.match(r"(?:[ \t]*>)*", line)[0].replace(" ", "").replace("\t", ""))
    words = lambda text: text.lower().split()

    def own(t):
        lines = split(t)
        return [x for i, x in enumerate(lines) if not level(x) and not (re.match(quotes.ANNOUNCED[:-1] + r"\Z", x) and i + 1 < len(lines) and level(lines[i + 1]))]

    for conv, turn, _, text in rows:
        if turn is None:
            continue
        passages, lines = [], split(text)
        for i, x in enumerate(lines):
            if level(x) and (not i or level(lines[i - 1]) != level(x)):
                passages.append((level(x), []))
            if level(x):
                passages[-1][1].extend(words(re.sub(r"^(?:[ \t]*>)+[ \t]?", "", x)))
        votes = {}
        for at, w in passages:
            for c, t, _, other in sorted((r for r in rows if r[0] == conv and r[1] is not None and r[1] < turn), key=lambda r: -r[1]):
                base = words(" ".join(own(other)))
                if w and (len(w) < 4 and w in [words(x) for x in own(other)] or len(w) >= 4 and any(base[k : k + len(w)] == w for k in range(len(base)))):
                    votes[at, t] = votes.get((at, t), 0) + len(w)
                    break
        out[conv, turn, text] = min(votes, key=lambda v: (v[0], -votes[v], -v[1]))[1] if votes else None
    return out


def test_quotation_links_equal_brute_force(spark):
    rng = __import__("random").Random(4)
    rows = []
    for conv in (1, 2, None):
        texts = []
        for turn in range(14):
            own = [" ".join(rng.choice(["red", "green", "blue", "ok", "cat"]) for _ in range(rng.choice([1, 2, 5, 9]))) for _ in range(rng.randrange(1, 4))]
            quoted = []
            for _ in range(rng.randrange(0, 3)):
                if texts:
                    w = " ".join(x for x in rng.choice(texts).split("\n") if not x.startswith(">")).split()
                    a = rng.randrange(0, max(1, len(w)))
                    part, mark = w[a : a + rng.randrange(1, 9)], ">" * rng.randrange(1, 3)
                    cut = rng.randrange(0, len(part) + 1)
                    quoted += [f"{mark} {' '.join(part[:cut]).upper()}", f"{mark}{' '.join(part[cut:])}", rng.choice(["", "so"])]
            texts.append("\n".join([*(["On Monday Bob wrote:"] if quoted and rng.random() < 0.5 else []), *quoted, *own]))
            rows.append((conv, turn, "u", texts[-1]))
    rows += [(3, 0, "u", "ok"), (3, 1, "u", "that is ok with me"), (3, 2, "u", "> ok\nfine"), (3, 3, "u", "> is OK with\n> me\nyes"), (None, None, "u", "> red"), (3, 3, "u", "> is OK with\n> me\nyes")]
    rows.append((4, 0, "u", "word " * 30_000 + "the needle stands here")), rows.append((4, 1, "u", "> the needle stands here\nok"))
    want = brute_replies([r for r in rows if r[0] != 4]) | {(4, 0, rows[-2][3]): None, (4, 1, rows[-1][3]): 0}
    assert want[3, 2, "> ok\nfine"] == 0 and want[3, 3, "> is OK with\n> me\nyes"] == 1 and sum(v is not None for v in want.values()) > 8
    keyed = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mid", "2 as h", "3 as lines")
    got = quotes.conversations(keyed).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault((r.conv_id, r.turn), set()).add(r.reply_to)
    for (conv, turn, _), reply in want.items():
        assert found[conv, turn] == {reply}, (conv, turn)


def pictures():
    rng = np.random.default_rng(1)
    out = []
    for i in range(25):
        b = media.resize(rng.uniform(0, 255, (10, 10)).astype(np.float32), 80, 80)
        out += [(i, b), (100 + i, b[8:72, 6:76]), (200 + i, np.clip(b * 0.8 + 30 + rng.normal(0, 2, b.shape), 0, 255)), (300 + i, np.rot90(b))]
    return [(k, bytearray(media.encode_pgm(b))) for k, b in out]


def test_edited_pictures_share_a_class(spark):
    rows = [*pictures(), (900, None), (901, bytearray(b"broken")), (902, bytearray(media.encode_pgm(np.zeros((50, 50)))))]
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert sum(got[k] == k % 100 for k in got if k < 900) >= 0.95 * 100
    assert all(got[k] % 100 == k % 100 for k in got if k < 900) and all(got[k] == k for k in (900, 901, 902))


def described(rows):
    return {k: media.describe(media.decode(bytes(raw))[None])[0] for k, raw in rows}


def crowd():
    """Edits of one picture, which crowd its table entries, among pictures that share a corner with it."""
    rng = np.random.default_rng(4)
    b = media.resize(rng.uniform(0, 255, (10, 10)).astype(np.float32), 80, 80)
    out = [(i, b * (0.9 + i / 400) + rng.normal(0, 3, b.shape)) for i in range(40)]
    for i in range(40, 70):
        other = media.resize(rng.uniform(0, 255, (10, 10)).astype(np.float32), 80, 80)
        other[:32, :32] = b[20:52, 20:52]
        out.append((i, other))
    return [(i, bytearray(media.encode_pgm(image))) for i, image in out]


@pytest.mark.parametrize(("few", "tile_weight"), [(16, 1_000_000), (0, 3_000)])
def test_crowded_entries_lose_no_link(spark, few, tile_weight):
    """The classes are those of all pairs that meet in a table, however many images share an entry."""
    rows = crowd()
    points, test = described(rows), media.Copies()
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and len(np.intersect1d(media.words(points[i]), media.words(points[j]))) and test.same(points[i], points[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert len(set(want)) > 5
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, image binary"), few=few, tile_weight=tile_weight).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_tables_find_what_comparing_all_pairs_finds():
    """Recall of the tables against comparing every pair of pictures, on crops, noise, light, turns and sizes."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 1, (60, 64))
    images = [media.decode(raw) for raw in media.render(list(vectors))]
    edits = [lambda a: a[6:58, 6:58] * 0.9 + rng.normal(0, 5, (52, 52)), lambda a: a + rng.normal(0, 8, a.shape), lambda a: a * 0.7 + 20, lambda a: np.rot90(a), lambda a: media.resize(a, 48, 48), lambda a: a[12:52, 12:52]]
    points = described([(i, media.encode_pgm(a)) for i, a in enumerate([*images, *(e(a) for a in images for e in edits)])])
    test = media.Copies()
    true = [(i, j) for i in points for j in range(i) if test.same(points[i], points[j])]
    met = sum(bool(len(np.intersect1d(media.words(points[i]), media.words(points[j])))) for i, j in true)
    source = lambda i: i if i < 60 else (i - 60) // len(edits)
    assert met >= 0.9 * len(true) and all(source(i) == source(j) for i, j in true)
    assert sum(i >= 60 and j == source(i) for i, j in true) >= 0.9 * 60 * len(edits)


def test_media_links_of_a_large_group_grow_with_its_images(spark, monkeypatch):
    """Near copies of one picture share very many keys; no more than a few links an image are kept."""
    from chronofold.llm import blocks

    rng, seen, inner = np.random.default_rng(8), [], blocks.components
    b = media.resize(rng.uniform(0, 255, (10, 10)).astype(np.float32), 80, 80)
    rows = [(k, bytearray(media.encode_pgm(b + rng.normal(0, 6, b.shape)))) for k in range(90)]

    def counted(edges):
        seen.append(edges.count())
        return inner(edges)

    monkeypatch.setattr(blocks, "components", counted)
    got = {r.id: r.class_id for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert set(got.values()) == {0}
    assert seen and max(seen) <= 3 * len(rows)


def test_media_query_edges(spark, tmp_path):
    rows = [(1, [0.1] * 64, 0), (2, None, 1), (3, [], None), (4, [float("nan")] * 64, 0), (5, [float(i % 7) for i in range(64)], 0), (6, [float(i % 7) for i in range(64)], 1), (6, [float(i % 7) for i in range(64)], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as node")
    save(df, tmp_path, "embeddings")
    got = media.op9_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.class_id for r in got if r.vec_id in (5, 6)} == {5}
    save(df.limit(0), tmp_path, "embeddings")
    assert media.op9_media(spark, str(tmp_path)).count() == 0
