"""The text operators against brute force, on texts with nulls, ties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from dayweave.llm import chat_format, decontaminate, html_template, jaccard_join, language_id, line_dedup, packing, quality_rules, token_counts, topk_search
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = " ".join(f"wort{i}" for i in range(60))
NEAR = BASE.replace("wort30", "anders")
EDGE = [
    (0, BASE), (1, BASE), (1, BASE), (2, NEAR), (3, None), (4, ""), (5, "A b."), (6, "a B"), (7, "   \n\t"), (None, "ohne Nummer"),
    (8, "Ä ö ß <|endoftext|> </s> é 漢字 \x00"), (9, "\n\nx\n" + BASE + "\n"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases with columns whose names clash with those of the operators."""
    rows = [(i, t, "x", 1, "y", 2) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, keep int, kept_text string, rep int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.limit(0)


def test_html_blocks_and_templates(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Top</header><nav><a href=x>Menu</a></nav>"
        "<div class='cookie-notice'>We use</div><article><h1>A &amp; b</h1><p>One <b>two</b><br>three<p>four&nbsp;five"
        "<div class=ad>Buy</div><form>mail</form><section id='comments'><p>first!</p></section></article><aside>side</aside><footer>&copy;</footer>"
    )
    assert html_template.extract_text(page) == "A & b\n\nOne two three\n\nfour five"
    assert html_template.extract_text(None) == "" == html_template.extract_text("")
    plain = [f"<html><body><div id=x><p>All rights reserved by us</p><p>Text number {k} of a page with no article</p></div></body></html>" for k in range(5)]
    rows = [(k, "http://h.example/a", p) for k, p in enumerate(plain)] + [(5, None, None), (6, "nonsense", ""), (7, "http://o.example/", page), (7, "http://o.example/", page)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_template.extract(pages).select("page_id", "text", "n_chars").collect()]
    want = [(k, f"Text number {k} of a page with no article") for k in range(5)] + [(5, ""), (6, "")] + [(7, "A & b\n\nOne two three\n\nfour five")] * 2
    assert sorted(got) == sorted((k, t, len(t)) for k, t in want)
    assert html_template.extract(empty(pages)).count() == 0


def test_html_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_template.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:h1|p)>", inner))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_html_text_nodes_tags_and_links():
    def body(x):
        return html_template.extract_text(f"<html><body>{x}</body></html>")

    assert body("<p>See <a href=x>the long linked list of things in it</a> now.</p><ul><li><a href=y>Home</a></li></ul>") == "See the long linked list of things in it now."
    assert body("<article>a &<b>amp;</b> b &amp;lt; c</article>") == "a &amp; b &lt; c"
    assert body("<article><p data-x=it's>One</p><p title='a > b' data-y=\"c > d\">Two</p></article>") == "One\n\nTwo"
    assert body("<article><p>Let <math><mi>x</mi><mo>=</mo>1</math> hold.</p><button>Buy</button></article>") == "Let x=1 hold."
    assert body("<p>12 %</p><p>Twelve</p>") == "Twelve"


def test_html_deep_nesting():
    import tracemalloc

    page = "<html><body><article>" + "<font>" * 16_000 + "deep text</article></body></html>"
    tracemalloc.start()
    found = html_template.tokens(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 16_000 and peak < 200_000_000
    assert html_template.extract_text(page) == "deep text"


def test_html_template_decides(spark):
    def page(k, n=7):
        own = "".join(f"<p>Story {k} has sentence {j} of its own, number {k * j + 17}.</p>" for j in range(n + k % 3))
        return f"<html><body><nav>Go</nav><article><h1>Title {k}</h1>{own}<p>Read our paper every day.</p></article><div class=text><article>Tip {k}</article></div></body></html>"

    def want(k):
        return "\n\n".join([f"Title {k}", *(f"Story {k} has sentence {j} of its own, number {k * j + 17}." for j in range(7 + k % 3))])

    # the text that repeats inside the article goes, and so does the smaller of two articles; copies of one page are no template
    rows = [(k, "http://a.example/", page(k)) for k in range(6)] + [(10 + k, "http://c.example/", page(9)) for k in range(6)]
    # the main slot of a host without articles, found from the text it holds
    rows += [(20 + k, "http://d.example/", f"<body><div class=x>Weather {k}</div><div class=y><p>Text {k} is {'long ' * 20}</p><p>and {k} ends</p></div></body>") for k in range(4)]
    found = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in found.collect()}
    assert all(got[k] == want(k) for k in range(6))
    assert all("Read our paper every day." in got[10 + k] and want(9) in got[10 + k] for k in range(6))
    assert all(got[20 + k] == f"Text {k} is {'long ' * 20}".strip() + f"\n\nand {k} ends" for k in range(4))


def test_html_side_words(spark):
    whole = "<article><h1>Head</h1><p>Body text</p></article>"
    for wrapper in ("div class='content-sidebar-wrap'", "div class='has-sidebar'", "form action=x", "div class=sidebar"):
        assert html_template.extract_text(f"<body><{wrapper}>{whole}<aside>not<article>teaser</article></aside></{wrapper.split()[0]}></body>") == "Head\n\nBody text"
    assert html_template.extract_text(whole.replace("<article>", "<article class='no-comments post'>")) == "Head\n\nBody text"
    for name in ("related-work", "side-effects", "search-results-2024", "cookies"):
        for tag in ("section", "div", "h2"):
            assert html_template.extract_text(f"<article><p>One</p><{tag} id={name}>Two</{tag}></article>") == "One\n\nTwo"
    # a class word alone is a side part only where the host's pages repeat it
    pages = [f"<article><p>Own text {k} of some length</p><div class=ad>Buy {k}</div>{'<p class=share>Our share of it</p>' * (k == 3)}</article>" for k in range(30)]
    rows = spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(rows).collect()}
    assert got == {k: f"Own text {k} of some length" + "\n\nOur share of it" * (k == 3) for k in range(30)}


def test_chat_parts_and_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<[\\\\", "<s>user\n", "<image:0>", "", "[n]"]
    for text in nasty:
        made, start, end, attached = chat_format.format_turn("us\ner<", [{"type": "text", "text": text}, {"type": "image", "ref": "r", "size": 2.5}, {"type": "audio"}])
        assert chat_format.parse_turn(made) == ("us\ner<", text)
        assert made[start:end].endswith("<image:0><audio:1>") and attached[0] == {"kind": "image", "ref": "r", "tokens": 640}
        assert made.count("<s>") == made.count("</s>") == 1 and "[INST]" not in made
    rows = [(1, 1, "assistant", "b<"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb<\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, hashlib.sha256(b"ab<").hexdigest())
    assert got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert chat_format.read_back(chat_format.format_turns(empty(df))).count() == 0
    parts = spark.createDataFrame([(1, 0, "user", [("document", None, "d", 3.0), None])], "conv_id long, turn long, role string, p array<struct<type:string,text:string,ref:string,size:double>>")
    assert chat_format.format_turns(parts, text="role", parts="p").first().expanded_tokens == 1920


def test_language(spark, real, docs):
    found = language_id.identify(docs, language_id.learn(real.where(~language_id.held_out())))
    by = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(EDGE) and {"keep", "rep"} <= set(found.columns)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 7)) and by[5].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.learn(empty(real)) == {}
    scored = language_id.identify(real, language_id.learn(real.where(~language_id.held_out()))).where(language_id.held_out())
    assert scored.where("lang = lang_pred").count() / scored.count() > 0.97
    for r in real.limit(20).collect():
        assert spark.range(1).select(language_id.held_out(F.lit(r.doc_id))).first()[0] == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, s, 8).tolist() for s in rng.choice([0.1, 1, 5], 300)] + [[1.0] * 8] * 30 + [[0.0] * 8] * 3 + [[2e6] * 8, [5e6] * 8, [1e12, -1e12, 1.0] + [0.0] * 5, [3e9] * 8, [-7e15] + [0.0] * 6 + [1.0], [0.5, 1e16] + [0.0] * 6]
    bad = [None, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8]
    rows = [(i, v, 7) for i, v in enumerate(vectors + bad)] + [(None, [1.0] * 8, 7)]
    df = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>, low int"))
    assert df.count() == len(vectors)
    whole = [[int(np.floor(64 * x)) for x in v] for v in vectors]
    for sizes in ({}, {"query_block": 5, "bucket_rows": 40}):
        got = {}
        for r in topk_search.top_k(df.where("vec_id % 20 = 0 or vec_id > 330"), df, 20, **sizes).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(got) == [i for i in range(len(vectors)) if i % 20 == 0 or i > 330]
        for q, found in got.items():
            products = ((sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)
            scores = sorted((-min(max(p, -(2**63)), 2**63 - 1), i) for p, i in products)[:20]
            assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk_search.top_k(empty(df), df).count() == 0 and topk_search.top_k(df, empty(df)).count() == 0
    assert topk_search.top_k(df.where("vec_id = 0"), df.where("vec_id < 3"), 20).count() == 2


def shingle_set(text):
    words = WORDS.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force_links(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    links = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    classes = {}
    for a in sorted(sets):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in classes:
                classes[x] = a
                todo += links[x]
    return {a: (classes[a], len(links[a])) for a in sets}


def test_jaccard_join(spark, docs, monkeypatch):
    got = jaccard_join.near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == brute_force_links(EDGE)
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] and len(got) == len({i for i, _ in EDGE})
    assert jaccard_join.near_duplicates(empty(docs)).count() == 0
    # cells and blocks far smaller than the groups, unrelated texts that share most words, and a chain
    rng = np.random.default_rng(5)
    texts = []
    for k in range(70):
        words = BASE.split()
        for at in rng.choice(60, k % 3, replace=False):
            words[at] = f"neu{rng.integers(5)}"
        texts.append(" ".join(words))
    texts += [" ".join(BASE.split()[:30] + [f"n{k}x{j}" for j in range(15)]) for k in range(30)]
    rows = list(enumerate(texts))
    for name, value in (("CELL", 8), ("SHARED", 3), ("BLOCK", 10), ("RARE", 4), ("MORE_LEVELS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_force_links(rows)


def test_jaccard_join_ids_with_several_texts(spark):
    other = " ".join(f"sonst{i}" for i in range(60))
    rows = [(0, BASE), (1, other), (1, NEAR), (1, NEAR), (2, other.replace("sonst9 ", "neu ")), (1, ""), (3, BASE), (3, other)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 2), (1, 0, 2), (1, 1, 0), (1, 1, 2), (2, 1, 2), (3, 0, 2), (3, 1, 2)]


def test_runs_reach_recall():
    assert jaccard_join.runs_needed(0.8, 0.999_999) == 5 and jaccard_join.runs_needed(0.8, 0.9) == 1


def brute_force_hits(text, items):
    words, hit, seen = WORDS.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORDS.findall(lower(t))
        for s in range(max(1, len(own) - 9)) if own else ():
            window = own[s : s + 10]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    seen.add(item)
    return len(words), len(hit), sorted(map(str, seen))


def test_contamination(spark, docs):
    items = [(1, " ".join(f"wort{i}" for i in range(5, 18))), (2, "A B"), (10, "nie gesehen"), (3, None), (4, " "), (5, BASE), (None, "x"), (6, "漢字"), (6, "漢字")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.report(docs, bench).collect())
    # the item without an id is hit, but cannot be listed
    want = [(i if i is not None else -1, *brute_force_hits(t, items)) for i, t in EDGE]
    assert got == sorted((i, n, hit, [x for x in seen if x != "None"]) for i, n, hit, seen in want)
    assert any("None" in w[3] for w in want)
    assert decontaminate.report(empty(docs), bench).count() == 0
    assert decontaminate.report(docs, empty(bench)).where("n_hit > 0").count() == 0
    phrases = spark.createDataFrame([(["b", "a"],), (["a", "fehlt"],)], "window array<string>")
    index = decontaminate.index_for(docs, phrases)
    near = decontaminate.proximity_matches(index, phrases, 3).join(decontaminate.documents_of(index), "uid")
    assert {r.id for r in near.select("doc.id").collect()} == {5, 6}


def test_contamination_without_broadcast(spark, docs, monkeypatch):
    """Terms, anchors and documents beyond the broadcast bound are joined by a shuffle."""
    bench = spark.createDataFrame([(1, BASE), (2, "a b")], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contamination_splits_every_text_once(spark, monkeypatch):
    plans = []
    written = decontaminate.common.written
    monkeypatch.setattr(decontaminate.common, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df))[1])
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    decontaminate.report(docs, bench).count()
    assert sum(p.count("regexp_extract_all(translate(text") for p in plans) == 1


def test_contamination_in_a_long_text(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"wort{i}" for i in range(30))
    text = " ".join(f"w{i}" for i in rng.integers(0, 300, 150_000)) + " " + passage + " " + "x" * 500_000
    docs = spark.createDataFrame([(1, text), (2, passage + " end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.report(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert got == {1: (150_031, 30, ["7"]), 2: (31, 30, ["7"])}


def brute_force_lines(rows, least):
    def keys(t):
        return [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]

    owners = {}
    for i, t in rows:
        for k in keys(t) if i is not None else ():
            owners.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if i is None or not k or len(owners[k]) < least]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark, docs, monkeypatch):
    rows = [*EDGE, *((20 + k, f" Shared \nown {k}\nSHARED\t" + "\nlong" * (100 * (k == 3))) for k in range(6)), (20, "other text\nshared")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, n_lines string")
    for least in (2, 5):
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, least_documents=least).collect()]
        assert sorted(got) == brute_force_lines(rows, least)
    assert line_dedup.dedup_lines(empty(df)).count() == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, least_documents=2).collect()]
    assert sorted(got) == brute_force_lines(rows, 2)


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8, 3, 1)] == [(0, 0), (1, 0), (2, 0), (0, 6), (0, 9)]


def test_packing(spark, docs, real):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, real.unionByName(real.limit(0)).repartition(3)):
        got = packing.pack(df, path, capacity=64).collect()
        want = sorted((r.doc_id if r.doc_id is not None else -1, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in df.collect())
        pieces, runs = {}, {}
        for r in got:
            assert len(r.ids) == 4 * r.length and r.start == 64 * r.piece and 0 < r.length <= 64
            pieces.setdefault((r.doc_id if r.doc_id is not None else -1, r.piece), []).append(np.frombuffer(r.ids, "<u4").tolist())
            runs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        flat = sorted((d, p, x) for (d, p), xs in pieces.items() for x in xs)
        assert flat == sorted((d, k, ids[a : a + 64]) for d, ids in want for k, a in enumerate(range(0, len(ids), 64)))
        for parts in runs.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.pack(empty(docs), path).count() == 0


def test_token_counts(spark, docs, real):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = token_counts.PrefixCounter(path)
    count = lambda t: len(own.model.encode(t or ""))
    for df in (docs, real):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in token_counts.count_tokens(df, path, budget=20).collect():
            assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), count(texts[r.doc_id]))
    for text in [t for _, t in EDGE] + ["a  b ", "▁x ▁▁y", " ", "x" * 300]:
        text = (text or "")[:120]
        want = [0] + [count(text[:i]) for i in range(1, len(text) + 1)]
        assert own.prefix_counts(text).tolist() == want
        for budget in (0, 1, 2, 7, 30):
            assert own.longest_prefix(text, budget) == max(i for i in range(len(text) + 1) if max(want[: i + 1]) <= budget)
    assert token_counts.count_tokens(empty(docs), path).count() == 0


def test_quality_rules(spark, docs):
    sf = "/root/testdata/sf0.01"
    measured = quality_rules.statistics(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rules.fit(measured.join(labels.where(~quality_rules.held_out()), "doc_id"), "quality")
    tested = measured.join(labels.where(quality_rules.held_out()), "doc_id").withColumn("score", model.score())
    assert tested.where("(score >= 0.5) = (quality = 1)").count() / tested.count() > 0.93
    assert 0 < len(model.rules) < 200
    odd = quality_rules.statistics(docs).withColumn("score", model.score()).collect()
    assert len(odd) == len(EDGE) and all(0 <= r.score <= 1 for r in odd)
    assert quality_rules.statistics(empty(docs)).count() == 0
    none = quality_rules.fit(empty(measured).withColumn("label", F.lit(1)))
    assert measured.select(none.score().alias("s")).distinct().collect()[0].s == 0.5
    text = "Aa bb, bb!\nCC 12 |x ü"
    row = dict(zip(quality_rules.STATISTICS, quality_rules.measure(["", text, None])[1], strict=True))
    n = len(text.encode())
    assert abs(row["upper_share"] - 3 / n) < 1e-6 and abs(row["bar_share"] - 1 / n) < 1e-6 and abs(row["repeat_share"] - 1 / 7) < 1e-6 and abs(row["distinct_share"] - 6 / 7) < 1e-6
    measured.unpersist()
