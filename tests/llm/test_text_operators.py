"""Tokens, exact copies, packing, page extraction against libraries and brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandloom.llm import bpe_automaton, exact_dedup, html_extract, packing, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: A null, empty and very long texts, repeated rows, an id that repeats, no id, and columns with clashing names.
EDGES = "doc_id long, text string, n_tokens string, kept string, ids string, bucket string, length string, rank string"
ROWS = [(1, None), (2, ""), (3, "the cat sat on the mat"), (4, "the cat sat on the mat"), (4, "the cat sat on the mat"), (None, "x y"), (6, " \n\t é 漢字 😀 <|endoftext|> don't  stop"), (7, "word " * 30_000), (8, "a" * 5_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in ROWS], EDGES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EDGES)


def texts(seed, n):
    r = random.Random(seed)
    letters = [*"aabc  \n\t.,!'sréß漢字😀01▁　\r\x00\x1c\x85", "<|endoftext|>", " the", "ing", "'ll", "  ", "\n\n", "<s>"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_automaton_equals_library():
    own, library = bpe_automaton.automaton(BPE), Tokenizer.from_file(BPE)
    for text in texts(1, 4_000):
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_characters_have_the_classes_of_the_library():
    """Every code point beside a letter, a digit, a mark, a space and a letter of another plane; texts over all planes."""
    own, library = bpe_automaton.MergeAutomaton(BPE), Tokenizer.from_file(BPE)
    r = random.Random(3)
    points = [*range(128, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200), *r.sample(range(0x34000, 0xE0000), 2_000), *r.sample(range(0xF0000, 0x110000), 2_000)]
    near = ["a{0}1{0}! {0}中{0}".format(chr(p)) for p in points]
    disputed = [chr(p) for p in points if bpe_automaton.disputed(chr(p), own.pieces)]
    assert {"\U00018e08", "\U00018f88", "\U000191c8", "\U00010948"} <= set(disputed)
    some = [*"aZ 1!\n中é'", "  ", "<|endoftext|>"]
    pick = lambda: r.choice(some) if r.random() < 0.5 else r.choice(disputed) if r.random() < 0.3 else chr(r.choice(points))
    mixed = ["".join(pick() for _ in range(r.randint(1, 12))) for _ in range(50_000)]
    for texts in (near, mixed):
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(own.encode(t), "<u4").tolist() != w.ids] == []
    library.encode_special_tokens = True
    want = library.encode_batch(mixed, add_special_tokens=False)
    assert [t for t, w in zip(mixed, want, strict=True) if np.frombuffer(own.encode_plain(t), "<u4").tolist() != w.ids] == []


def test_the_table_stays_bounded_within_one_word(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "TRANSITIONS", 1_000)
    own, library, r = bpe_automaton.MergeAutomaton(BPE), Tokenizer.from_file(BPE), random.Random(4)
    word = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    assert np.frombuffer(own.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    assert own.transitions <= 1_001 and len(own.rows) <= 1_002


def test_arcs_forbid_what_merges():
    own = bpe_automaton.automaton(BPE)
    arc, vocab = own.gadgets.arc, own.vocab
    assert not arc(vocab["t"], vocab["h"]) and arc(vocab["q"], vocab["z"])
    assert own.encode_word(b"th") == [vocab["th"]]


def test_arcs_are_what_the_gadgets_leave():
    """The changes that the gadgets keep, against an automaton that is rebuilt as a whole by every gadget."""
    for seed in range(40):
        r = random.Random(seed)
        labels, gadgets = [bytes([i]) for i in range(3)], bpe_automaton.MergeGadgets(20)
        arcs = {i: {0, 1, 2} for i in range(3)}
        for _ in range(12):
            a, b = (r.randrange(len(labels)) for _ in range(2))
            if labels[a] + labels[b] in labels:
                continue
            c = len(labels)
            gadgets.add(a, b, c)
            labels.append(labels[a] + labels[b])
            if b in arcs[a]:  # else the merge can never happen
                arcs[c] = set(arcs[b])
                arcs[a].discard(b)
                for state in arcs.values():
                    if a in state:
                        state.add(c)
            else:
                break
        else:
            for s, own in arcs.items():
                assert own == {t for t in range(len(labels)) if gadgets.arc(s, t)}


def test_every_byte_is_read_once_and_a_dropped_table_changes_nothing(monkeypatch):
    class Counted(bytes):
        read = 0

        def __iter__(self):
            for byte in bytes.__iter__(self):
                Counted.read += 1
                yield byte

    own, library = bpe_automaton.MergeAutomaton(BPE), Tokenizer.from_file(BPE)
    words = [f" {w}" for w in ("interesting", "abababab" * 30, "ththth", "unbelievablyness", "xqzjk" * 20)]
    for word in words:
        want = library.encode(word, add_special_tokens=False).ids
        Counted.read = 0
        assert own.encode_word(Counted(word.encode())) == want and Counted.read == len(word)
    monkeypatch.setattr(bpe_automaton, "TRANSITIONS", 5)
    for word in words * 2:
        assert own.encode_word(word.encode()) == library.encode(word, add_special_tokens=False).ids
        assert own.transitions <= 5 + len(word)


def test_automaton_knows_the_vocabulary():
    own = bpe_automaton.automaton(BPE)
    assert all(own.encode_word(own.labels[i]) == [i] for i in own.vocab.values())


def test_round_trip_edges(edges, none):
    library = Tokenizer.from_file(BPE)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_automaton.round_trip_digests(edges, BPE).collect())
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_automaton.round_trip_digests(none, BPE).count() == 0
    back = bpe_automaton.decode(bpe_automaton.encode(edges, BPE), BPE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(len(r.ids) == 4 * r.n_tokens for r in back)
    assert bpe_automaton.decode(bpe_automaton.encode(none, BPE), BPE).count() == 0


def test_piece_counts_equal_library():
    own, library = token_counts.counter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts(2, 4_000):
        assert own.count(text, own.lengths) == len(library.encode(text)), repr(text)


def test_token_counts_edges(edges, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(edges, PIECES).collect())
    want = [(i or 0, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in ROWS]
    assert got == sorted(want)
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_table_size_changes_no_count(edges):
    count = lambda **k: sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(edges, PIECES, **k).collect())
    assert count() == count(table_entries=1) == count(table_entries=0)


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_duplicates_edges(edges, none, keep, best):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        stays = best((i for i in ids if i is not None), default=None)
        want += [(i or 0, stays or 0, len(ids), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [(r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(edges, keep).collect()]
    assert sorted(got) == sorted(want)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_trie_spills_without_loss(spark):
    rows = [(i, random.Random(i % 50).choice("abcdef") * (i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (sorted(map(tuple, exact_dedup.exact_duplicates(df, trie_bytes=n).collect())) for n in (1, 1 << 20))
    assert small == large and len(small) == 400


def test_trie_keeps_prefixes_apart():
    trie = exact_dedup.PatriciaTrie(max)
    for i, key in enumerate([b"abc", b"ab", b"abd", b"", b"abc", b"abcd", b"a\0"]):
        trie.insert(key, i, 1)
    assert {k: (i, n) for k, i, n in trie.terminals()} == {b"abc": (4, 2), b"ab": (1, 1), b"abd": (2, 1), b"": (3, 1), b"abcd": (5, 1), b"a\0": (6, 1)}


def packed(df, capacity):
    rows = packing.pack(packing.pieces(df, BPE, capacity), capacity).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, by


def test_packing_edges(edges, none):
    library = Tokenizer.from_file(BPE)
    rows, by = packed(edges, 64)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id or 0].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, start, length, crc in got[i or 0]:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            assert piece == 0 or length == 64
        assert sum(p[2] for p in got[i or 0]) == len(ids) * (2 if i == 4 else 1)
    assert len(by) == -(-sum(r.length for r in rows) // 64)
    assert packed(none, 64)[0] == []


def test_plan_places_every_piece_once():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([7, 12, 64, 2048])
        counts = {n: r.choice([1, 2, 5, 1000]) for n in r.sample(range(1, capacity + 1), min(capacity, 20))}
        total, slots = 0, defaultdict(int)
        ranks = defaultdict(list)
        for n, first, count, sequence, offset in packing.plan(counts, capacity):
            assert offset + n <= capacity
            ranks[n].append((first, count))
            for i in range(count):
                assert slots[sequence + i] == offset
                slots[sequence + i] += n
            total += count
        assert total == sum(counts.values())
        for n, runs in ranks.items():
            at = 0
            for first, count in sorted(runs):
                assert first == at
                at += count
            assert at == counts[n]
        # Best fit of large items in decreasing order stays within 1.25 of what the volume needs, plus one.
        assert len(slots) <= max(1.34 * sum(n * c for n, c in counts.items()) / capacity + 1, sum(c for n, c in counts.items() if 2 * n > capacity) + sum(counts.values()) * 0.51)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a>Home</a></nav></header>
<div id="cookie-notice">We use cookies to improve, really, your experience. Accept, please.</div><script>var x = "</p>";</script>
<div class="wrap"><div class="content"><div class="post-header"><h1>Real title</h1></div><p>First paragraph, which is long enough to be taken, and has marks. It goes on.</p>
<h2>Sub</h2><p>Short.</p><ul><li>item one, is here</li><li>item two</li></ul><div class="ad">Buy now, cheap. Very cheap, really.</div>
<p>A &lt;b&gt; &amp; c&nbsp;d<br>e <b>f</b>g</p></div><div class="sidebar"><p>Related: links, and other things that are long. Really long sidebars, with marks.</p></div></div>
<section class="comments"><div class="comment"><p>I think, as a reader, that this is a very long comment, with commas, and so on. And so on.</p></div></section>
<form><p>Subscribe, please, to our letters.</p></form><footer><p>Copyright, 2020. All rights reserved, and so on.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE).split("\n\n") == ["Real title", "First paragraph, which is long enough to be taken, and has marks. It goes on.", "Sub", "Short.", "item one, is here", "item two", "A <b> & c d e fg"]


@pytest.mark.parametrize("html,text", [("", ""), ("plain, text.", "plain, text."), ("<p>a", "a"), ("<script>x", ""), ("<p>a<b", "a"), ("<p>1 < 2</p>", "1 < 2"), ("<!-- x --><p>a&am", "a&am"), ("<p>a<p>b", "a\n\nb")])
def test_main_text_of_broken_pages(html, text):
    assert html_extract.main_text(html) == text


LONG = "A long part, with marks, that goes on for a while: so it is content, and more."


@pytest.mark.parametrize("part", [f"<{t}>" + f"<{i}>{LONG}</{i}>" * 10 + f"</{t}>" for t, i in (("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("dl", "dd"), ("section", "p"), ("div", "p"))] + ["<table>" + f"<tr><td>{LONG}</td></tr>" * 10 + "</table>"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_title_and_lead_stay_beside_a_long_part(part, around):
    got = html_extract.main_text(f"<html><body><nav><a>Home</a></nav><{around}><h1>T</h1><p>intro</p>{part}</{around}></body></html>")
    assert got.split("\n\n") == ["T", "intro"] + [LONG] * 10


def test_no_selected_block_is_dropped():
    got = html_extract.main_text(f"<body><div>{f'<p>{LONG}</p>' * 9}</div><section><p>{LONG}</p></section></body>")
    assert got.split("\n\n") == [LONG] * 10


@pytest.mark.parametrize("wrapper", ["div id='page' class='has-sidebar'", "div class='with-ads'", "div class='no-comments'", "div class='content social-theme'", "form action='/'", "div class='comments-open'"])
def test_wrapper_with_a_word_of_asides_keeps_the_article(wrapper):
    junk = "<div class='related'><article><p>Other, page.</p></article></div><div class='comments'><p>I agree, with all of it.</p></div><form><p>Subscribe, please.</p></form>"
    got = html_extract.main_text(f"<body><{wrapper}><article><h1>T</h1>{f'<p>{LONG}</p>' * 5}</article>{junk}</{wrapper.split()[0]}></body>")
    assert got.split("\n\n") == ["T"] + [LONG] * 5


def test_section_of_an_article_stays_and_links_go():
    got = html_extract.main_text(f"<body><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><section id='related-work'><p>{LONG} {LONG}</p></section><section class='related'><p>One</p><p>Two</p></section><section class='comments'><p>{LONG}</p></section></article></body>")
    assert got.split("\n\n") == ["T", LONG, LONG, f"{LONG} {LONG}"]


def paragraphs(n):
    return f"<p>{LONG}</p>" * n


@pytest.mark.parametrize("one,two", [("div class='part one'", "div class='part two'"), ("div", "div"), ("section", "section id='s2'"), ("div id='a'", "section")])
def test_article_in_two_containers_is_whole(one, two):
    inside = f"<h1>T</h1><{one}>{paragraphs(8)}</{one.split()[0]}><{two}><h2>Sub</h2>{paragraphs(3)}</{two.split()[0]}>"
    nav, foot = "<nav><a href='/'>Home, sweet home.</a></nav>", "<footer>All rights reserved.</footer>"
    for page in (f"<body>{nav}{inside}{foot}</body>", f"<body>{nav}<div id='page'>{inside}</div>{foot}</body>"):
        assert html_extract.main_text(page).split("\n\n") == ["T"] + [LONG] * 8 + ["Sub"] + [LONG] * 3


@pytest.mark.parametrize("name", ["links", "tools", "legal", "disclaimer", "user-reviews", "discussion", "partners", "trending", "related-posts", "site-search", "cookie-banner", "reader-comments"])
def test_boilerplate_goes(name):
    text = "We are not liable, in any way, for what is said here. Read on, please."
    for part in (f"<div class='{name}'><p>{text}</p><p>{text}</p></div>", f"<div class='{name}'>{text}</div>", f"<section id='{name}'><ul><li><a href='/x'>{text}</a></li></ul></section>"):
        for page in (f"<body><div>{paragraphs(4)}</div>{part}</body>", f"<body>{part}<article>{paragraphs(4)}</article></body>"):
            assert html_extract.main_text(page).split("\n\n") == [LONG] * 4


def test_short_or_linked_parts_go_whatever_their_names():
    parts = ["<div class='xq'><p>Buy it</p></div>", "<div class='qy'>" + f"<p><a href='/'>{LONG}</a></p>" * 3 + "</div>", "<div><span>12 of 30</span></div>"]
    for part in parts:
        assert html_extract.main_text(f"<body><div>{paragraphs(6)}</div>{part}</body>").split("\n\n") == [LONG] * 6
        assert html_extract.main_text(f"<body>{part}<main><h1>T</h1>{paragraphs(6)}</main></body>").split("\n\n") == ["T"] + [LONG] * 6


@pytest.mark.parametrize("name", ["social-policy", "related-work", "share-prices", "alert-level", "notice-period", "search-results-explained"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_names_of_sections_are_not_taken_for_boilerplate(name, tag):
    page = f"<body><article><h1>T</h1>{paragraphs(3)}<{tag} class='{name}'><h2>Sub</h2><p>{LONG}</p><p>Short.</p></{tag}>{paragraphs(2)}</article></body>"
    assert html_extract.main_text(page).split("\n\n") == ["T"] + [LONG] * 3 + ["Sub", LONG, "Short."] + [LONG] * 2


@pytest.mark.parametrize("piece", ["<div>x y.", "<b>x", "<p><b>", "<ul><li>a", "<tr><td>a", "</i><b>", "<a '", "<"])
def test_hostile_pages_take_time_in_proportion(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text("<i><p>" + piece * n)
        return time.process_time() - began

    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (4, "u", "<p>" + "a, " * 100_000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: len(r.text) for r in html_extract.extract(df).collect()}
    assert got[1] == got[2] == 0 and got[3] > 100 and got[4] == 3 * 100_000 - 1
    assert html_extract.extract(df.where("false")).count() == 0


def test_extract_equals_what_pages_hold(spark, tiny):
    """Pages of the test data hold one article; its blocks, read with patterns, are the result."""
    import html as entities
    import re

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    want = {}
    for row in pages.collect():
        blocks = re.split(r"</?p>|</?h1>", row.html.split("<article>")[1].split("</article>")[0])
        clean = (" ".join(entities.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
        want[row.page_id] = "\n\n".join(b for b in clean if b)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def random_name(r):
    """A name that no list can know."""
    return "".join(r.choices("bcdfghjklmnpqrstvwxz", k=7)) + random_mark(r)


def random_mark(r):
    return r.choice(["", "-x", "_9", "-qq-zz"])


@pytest.mark.parametrize("seed", range(6))
def test_selected_paths_decide_within_an_article(seed):
    """Short boxes under names that no list can know go, wherever they stand; what an article consists of stays."""
    r = random.Random(seed)
    box = lambda text: r.choice([f"<div class='{random_name(r)}'>{text}</div>", f"<div class='{random_name(r)}'><p>{text}</p></div>", f"<p class='{random_name(r)}'>{text}</p>"])
    junk = [box("Buy now"), box("Advertisement"), box("Most read: one, two"), "<div class='author-bio'><p>By A. B.</p></div>", "<div class='share-this-article'>Share this</div>"]
    r.shuffle(junk)
    start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<article><div class='content'>", "</div></article>")])
    body = [f"<p>{LONG}</p>", "<p>Short.</p>", "<h2>Sub</h2>", f"<p>{LONG}</p>", "<ul><li>one</li><li>two</li></ul>", f"<p>{LONG}</p>", "<blockquote>Said so</blockquote>", f"<p>{LONG}</p>"]
    for piece in junk:
        body.insert(r.randrange(1, len(body)), piece)
    page = f"<body><nav><a>Home</a></nav>{start}<h1>T</h1>{''.join(body)}{end}<div id='responses'><p>I think so, too.</p></div></body>"
    assert html_extract.main_text(page).split("\n\n") == ["T", LONG, "Short.", "Sub", LONG, "one", "two", LONG, "Said so", LONG]


@pytest.mark.parametrize("name", ["class='terms'", "id='privacy'", "id='reviews'", "class='discussion'", "class='links'"])
def test_named_parts_of_an_article_that_read_like_the_rest_stay(name):
    page = f"<body><article><h1>T</h1>{paragraphs(3)}<div {name}><h2>Sub</h2><p>{LONG}</p></div>{paragraphs(1)}</article><div {name}><p>One, two.</p></div></body>"
    assert html_extract.main_text(page).split("\n\n") == ["T"] + [LONG] * 3 + ["Sub", LONG, LONG]


def test_controls_within_a_sentence_are_text():
    page = f"<body><article><p>{LONG}</p><p>Press <button>OK</button> to go on, and name the <label>second field</label> too.</p><button>Send</button><div><label>Name</label> <button>Go</button></div></article></body>"
    assert html_extract.main_text(page).split("\n\n") == [LONG, "Press OK to go on, and name the second field too."]


def test_titles_in_pages_of_containers():
    body = "".join(f"<div class='row'>{LONG}</div>" for _ in range(4))
    page = f"<body><div class='page'><div class='title'>A title</div>{body}<div class='{'zq' * 4}'>Long ago, and far away</div></div></body>"
    assert html_extract.main_text(page).split("\n\n") == ["A title"] + [LONG] * 4
