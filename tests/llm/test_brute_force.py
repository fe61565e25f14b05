"""Queries on a small fixture against plain restatements."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from seqloom.llm import html_extract, media, mixing, packing
from seqloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ngram_join(spark, texts):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, parent = {}, {k: k for k in texts}
    for k, text in texts.items():
        w = text.encode().translate(fold).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in queries()["op10_ngram_join"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))


def test_substring_dedup(spark, texts):
    first, words = {}, {}
    for k in sorted(texts):
        w = words[k] = texts[k].encode().split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    for r in queries()["op8_substring_dedup"](spark, SF).collect():
        w = words[r["doc_id"]]
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < r["doc_id"]:
                gone[i : i + 50] = True
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), gone.sum(), hashlib.sha256(left).hexdigest())


def test_line_dedup(spark, texts):
    got = {r["doc_id"]: r["text"] for r in queries()["op1_line_dedup"](spark, SF).collect()}
    holds, sizes = collections.defaultdict(list), []
    for k in sorted(texts):
        left = []
        for line in texts[k].split("\n"):
            w = frozenset(line.encode().split())
            both = collections.Counter(i for x in w for i in holds[x])
            if not any(5 * n >= 4 * (len(w) + sizes[i] - n) for i, n in both.items()):
                left.append(line)
            for x in w:
                holds[x].append(len(sizes))
            sizes.append(len(w))
        assert got[k] == "\n".join(left)


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got, hits, all_ = collections.defaultdict(set), 0, 0
    for r in queries()["op7_nearest_neighbours"](spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    for i in np.flatnonzero(ids % 100 == 0):
        apart = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        apart[i] = np.inf
        near = ids[np.lexsort((ids, apart))[: min(10, len(ids) - 1)]]
        hits, all_ = hits + len(got[ids[i]] & set(near.tolist())), all_ + len(near)
    assert hits >= 0.9 * all_


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = collections.defaultdict(dict)
    for r in packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for k, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(v for _, v in sorted(pieces[k].items())) == ids


@pytest.mark.parametrize("text", ["", "  ", "a  b", "a   b", " a", " \n a", "a \n b", "x  ", "x \n", "it's  we'll", "<|endoftext|> hi", "a\x1c b", "a\t\tb c", "　 x"])
def test_encoder(text):
    import public_tokenizers

    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_media_round_trip(spark, texts):
    for r in queries()["op3_media_columns"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        whole = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))


def test_media_formats():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 255 7 9").tolist() == [[7, 9]] and media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]] and media.decode(b"P5 1 1 65535 \x01\x02").tolist() == [[258]]
    head = lambda bits, n: b"BM" + bytes(8) + (54 + 4 * n).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0" + bits.to_bytes(2, "little") + bytes(16) + n.to_bytes(4, "little") + bytes(4)
    assert media.decode(head(24, 0) + bytes([1, 2, 3, 4, 5, 6, 0, 0])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert media.decode(head(8, 2) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([1, 0, 0, 0])).tolist() == [[[6, 5, 4], [3, 2, 1]]]
    grid = np.arange(12).reshape(3, 4)
    assert np.allclose(media.area_resize(grid, 1, 1), grid.mean()) and np.allclose(media.area_resize(grid, 3, 2), grid.reshape(3, 2, 2).mean(axis=2))
    with pytest.raises(media.MediaError):
        media.decode(b"P6 9 9 255 ")


def test_mix_parts():
    for n in (1, 2, 5, 64, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    assert mixing.shard_counts([5000, 7, 0]).sum(axis=0).tolist() == [5000, 7, 0]
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5] and mixing.targets([10, 1000]) == [30.0, 980.0]


def test_mixing(spark):
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries()["op4_mixing"](spark, SF).collect():
        own = by[source[r["doc_id"]]]
        own[0], own[1], own[2] = own[0] + r["taken"], r["target"], own[2] + r["size"]
        assert r["taken"] <= 3 * r["size"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= 2 * mixing.BLOCK + 0.02 * target


def test_html():
    page = '<body><div class="cookie-notice">We use cookies</div><article><h1>T</h1><p>One &amp; <b>two<br><p>three</article><footer>f</footer>'
    assert html_extract.main_text(page) == "T\n\nOne & two\n\nthree"


def _page(body):
    return html_extract.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>")


PARAGRAPHS = [f"Paragraph {i} of the story, " + "with quite a lot of words in it, " * 6 + "and an end." for i in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
MENU = '<div class="top"><a href="/a">Home page</a> <a href="/b">All the news</a> <a href="/c">Contact</a></div>'
NOTE = '<div class="lower">This site keeps small files.</div>'
COMMENTS = '<div class="talk"><div>Nice one.</div><div>I do not agree.</div></div>'


@pytest.mark.parametrize("body", [
    f"{MENU}<div class='c'>{STORY}</div>{NOTE}{COMMENTS}", f"<div>{MENU}<div class='c'>{STORY}</div>{NOTE}{COMMENTS}</div>", f"{MENU}<main>{STORY}</main>{NOTE}", f"{MENU}<main><div>{STORY}</div>{NOTE}</main>{NOTE}",
    f"{MENU}<div id='w'><section>{STORY}</section></div>{NOTE}", f"{MENU}{STORY}{NOTE}", f"<div>{MENU}{STORY}</div>", f"<main>{MENU}<div class='c'>{STORY}</div>{COMMENTS}</main>",
])
def test_html_without_article(body):
    assert _page(body).split("\n\n") == PARAGRAPHS


def test_html_sections_and_title():
    parts = "".join(f"<section><h2>Part {k}</h2>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS[2 * k : 2 * k + 2]) + "</section>" for k in range(3))
    want = ["Title"] + [x for k in range(3) for x in [f"Part {k}", *PARAGRAPHS[2 * k : 2 * k + 2]]]
    for page in (f"<div id='page'>{MENU}<h1>Title</h1><div>{parts}</div>{NOTE}</div>", f"{MENU}<main><h1>Title</h1>{parts}</main>{NOTE}", f"<div>{MENU}<h1>Title</h1>{parts}{NOTE}</div>"):
        assert _page(page).split("\n\n") == want


def test_html_one_short_article():
    for tag in ("div", "main"):
        assert _page(f"<{tag}>{MENU}<article><h1>T</h1><p>{PARAGRAPHS[0]}</p></article><div class='x'><div>{NOTE}</div></div></{tag}>").split("\n\n") == ["T", PARAGRAPHS[0]]


@pytest.mark.parametrize("page, want", [
    ("<article><header class='entry-header'><h1>Title</h1></header>{0}</article>", ["Title", *PARAGRAPHS]),
    ("<article><h2 class='section-header'>Title</h2>{0}<h2 id='related-work'>Work</h2><p class='ad-hoc'>Ad hoc.</p><h2 id='social-history'>Social</h2></article>", ["Title", *PARAGRAPHS, "Work", "Ad hoc.", "Social"]),
    ("<article><h2 class='header'>Title</h2>{0}<p style='overflow:hidden' data-x='hidden'>Last.</p><pre>a <span class='comment'># b</span></pre></article>", ["Title", *PARAGRAPHS, "Last.", "a # b"]),
    ("<div class='layout with-sidebar'><div class='c'>{0}</div><div class='sidebar'>" + NOTE + "</div></div>", PARAGRAPHS),
    ("<div class='widget'><div class='c'>{0}</div></div>", PARAGRAPHS),
    ("<form action='x'><div class='c'>{0}</div></form>", PARAGRAPHS),
    ("<div class='post'><header class='entry-header'><h1>Title</h1></header><div>{0}</div></div><header><h1>Site</h1></header>", ["Title", *PARAGRAPHS]),
    ("<article>{0}<article class='comment'><p>I do not agree.</p></article><div class='comment-list'><p>Nor do I.</p></div><div class='ad'>Buy.</div></article>", PARAGRAPHS),
    ("<article>{0}</article><div id='comments'><article class='comment'>" + "<p>Long talk, long talk.</p>" * 70 + "</article></div>", PARAGRAPHS),
])
def test_html_names_are_evidence(page, want):
    assert _page(page.replace("{0}", STORY)).split("\n\n") == want
