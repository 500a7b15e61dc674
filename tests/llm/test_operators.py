"""Each operator on small tables: nulls, empty texts, ties, repeats, empty tables, clashing columns, brute force."""

import gzip
import hashlib
import io
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import packing, warc
from trajlake.llm.components import components
from trajlake.llm.exact_dedup import exact_dedup
from trajlake.llm.fingerprint import fingerprints, hashes, merge, sketch
from trajlake.llm.html_text import Page, extract
from trajlake.llm.language_id import identify
from trajlake.llm.licenses import scan
from trajlake.llm.lm_score import score
from trajlake.llm.mixing import mix_sources, source_targets
from trajlake.llm.ngram_join import compare, ngram_join
from trajlake.llm.packing import best_fit, pack, plan_runs, reduce_histogram
from trajlake.llm.queries import tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN, DE = "the of and to in that it is with for as was on be at by this ".split(), "der die und in den von zu das mit sich des auf ist im dem nicht ".split()


def words(rng, n, stock=None):
    return " ".join(rng.choice(stock or [f"w{i}" for i in range(400)], n))


def docs(spark, rows):
    """Rows of (id, text, lang, source) with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("name", "h", "rid", "pos", "key", "kept", "e", "word", "n", "size", "target", "score", "chunk", "length")})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, words(rng, 60, EN), "en", "s1") for i in range(20)] + [(20 + i, words(rng, 60, DE), "de", "s2") for i in range(20)]
    out += [(40, None, None, None), (41, "", "en", "s1"), (42, " \t\n", None, ""), (43, "12 34 !", "de", "s3"), (44, "the", "en", "s1"), (45, out[3][1], "en", "s1"), (45, out[3][1], "en", "s1")]
    out += [(46, out[3][1].upper(), "en", None), (47, words(rng, 30_000), "en", "s4"), (None, "der die und", "de", "s2")]
    return out


def collect(df):
    return [r.asDict() for r in df.collect()]


EMPTY = [("lang", identify), ("fp", fingerprints), ("dedup", exact_dedup), ("join", ngram_join), ("lm", score), ("mix", mix_sources), ("pack", lambda d: pack(d, tokenizer_file())), ("licences", scan)]


@pytest.mark.parametrize(("name", "run"), EMPTY)
def test_empty_table(spark, name, run):
    assert run(docs(spark, []).limit(0)).count() == 0


def test_language(spark, rows):
    out = collect(identify(docs(spark, rows)))
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "en" for i in range(20)) and all(by[i]["lang_pred"] == "de" for i in range(20, 40))
    assert [by[i]["lang_pred"] for i in (40, 41, 42, 43)] == ["und"] * 4 and by[None]["lang_pred"] == "de"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_without_labels(spark):
    out = collect(identify(docs(spark, [(1, "some words", None, "s")])))
    assert out[0]["lang_pred"] == "und"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(spark, rows):
    more = [(100 + i, "Ab" * 3000 + tail, "en", "s") for i, tail in enumerate(["", "x", "", "X", "É", "é"])]
    table = rows + more
    for size in (7, 2048):
        out = collect(exact_dedup(docs(spark, table), block_chars=size))
        groups = {}
        for r in table:
            groups.setdefault(lower(r[1]), []).append(-1 if r[0] is None else r[0])
        assert len(out) == len(table) and sum(r["kept"] for r in out) == len(groups)
        shas = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in out:
            ids = shas[r["text_sha256"]]
            assert r["group_size"] == len(ids) and (-1 if r["keep_id"] is None else r["keep_id"]) == max(ids)


def test_fingerprints(spark, rows):
    table = [r for r in rows if r[0] is not None and r[0] != 45] + [(45, rows[3][1], "en", "s")]
    out = {r["doc_id"]: r for r in collect(fingerprints(docs(spark, table)))}
    order = sorted(out)
    text = {r[0]: r[1] or "" for r in table}
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, k = text[i], len(text[i]) // 4
        edited = t[: len(t) - k] + text[nxt][:k]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert out[3]["fingerprint"] == out[45]["fingerprint"] != out[4]["fingerprint"] and out[40]["fingerprint"] == "0"
    assert 0.5 < out[5]["near_edited"] < 1 and out[47]["near_next"] == 0
    one = collect(fingerprints(docs(spark, [(1, "a b c d e f g h", "en", "s")])))
    assert one[0]["near_next"] == 1


def likeness(a, b):
    """What two fingerprints say on their own."""
    level = max(int(a[0]), int(b[0]))
    x, y = ({int(f[k : k + 10], 16) for k in range(1, len(f), 10)} for f in (a, b))
    x, y = ({h for h in s if h < (1 << 40) >> level} for s in (x, y))
    return len(x & y) / min(len(x), len(y)) if x and y else float(a == b)


def test_likeness_needs_only_the_two_fingerprints(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**9, "x y z"), (10**9 + 1, "q"), (10**9 + 2, None), (10**9 + 3, ""), (10**9 + 4, "a b c d e f g h i j")], "doc_id bigint, text string")
    out = sorted(collect(fingerprints(sf.select("doc_id", "text").unionByName(odd))), key=lambda r: r["doc_id"])
    levels = {r["fingerprint"][0] for r in out}
    assert levels == {"0", "1", "2"}
    for r, after in zip(out, out[1:] + out[:1], strict=True):
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], after["fingerprint"]))
        assert r["fingerprint"][0] == "0" or len(r["fingerprint"]) > 80
    short = {r["doc_id"]: r for r in out}
    assert short[10**9]["fingerprint"] != short[10**9 + 1]["fingerprint"] and short[10**9]["near_next"] == 0 and short[10**9 + 2]["near_next"] == 1


@pytest.mark.parametrize("shingles", [40, 200])
def test_fingerprints_of_a_short_text_in_a_long_one(spark, shingles):
    rng = np.random.default_rng(shingles)
    long = [f"v{i}" for i in rng.permutation(3000)]
    half = long[1000 : 1000 + shingles + 4] + [f"u{i}" for i in range(shingles + 4)]
    table = [(1, " ".join(long[500 : 504 + shingles]), "en", "s"), (2, " ".join(long), "en", "s"), (3, " ".join(half), "en", "s"), (4, " ".join(long), "en", "s")]
    out = {r["doc_id"]: r["near_next"] for r in collect(fingerprints(docs(spark, table)))}
    true = shingles / (2 * shingles + 4)
    assert out[1] == 1 and out[4] == 1
    assert out[2] == out[3] == pytest.approx(true, abs=0.25)


def test_sketches_are_threshold_sets_and_merge_by_union(spark):
    rng = np.random.default_rng(3)
    a, b = words(rng, 300), words(rng, 90)
    df = spark.createDataFrame([(a, b, None)], "a string, b string, c string")
    every, kept, other, both, none = df.select(hashes(F.col("a")), sketch(F.col("a")), sketch(F.col("b")), merge(sketch(F.col("a")), sketch(F.col("b"))), sketch(F.col("c"))).first()
    assert len(every) == 296 and kept["level"] == 2 and kept["kept"] == sorted({x for x in every if x < (1 << 40) // 4}) and none["kept"] == []
    assert both["kept"] == sorted({*kept["kept"], *other["kept"]})


def test_fingerprints_with_repeated_and_null_ids(spark):
    table = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "x y z", "en", "s"), (2, None, "en", "s")]
    out = collect(fingerprints(docs(spark, table)))
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "2", "None"] and sum(r["near_next"] == 1 for r in out if r["doc_id"] == 1) == 1


HTML = "<html><head><title>T</title></head><body><div class=menu><a href=/>Home</a></div><div class='post-body p12'><h1>Head &amp; tail</h1><p>First  para&eacute; one<br>goes on and on.<p>Second, with <b>bold</b> text &lt;x&gt;.</div><div id='comments'><p>{}</p></div><aside>side</aside><footer>&copy; me</footer><script>var a = '<p>no</p>'</script></body></html>"


def test_html(spark):
    rows = [(i, f"http://www.a.example/{i}", HTML.format("reader comment " * (40 if i == 5 else 1))) for i in range(6)]
    rows += [(7, None, None), (8, "", ""), (9, "http://b.example", "<p>plain &amp text &notin; here"), (10, "http://b.example", "no < tags > at \"all"), (11, "http://c", "<div " * 3 + "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit(1))
    out = {r["page_id"]: r for r in collect(extract(pages))}
    want = "Head & tail\n\nFirst paraé one goes on and on.\n\nSecond, with bold text <x>."
    assert all(out[i]["text"] == want for i in range(6)) and out[7]["text"] == out[8]["text"] == ""
    assert out[9]["text"] == "plain & text ∉ here" and out[0]["n_chars"] == len(want)
    assert extract(pages.limit(0)).count() == 0


def test_html_host_path_overrules_a_page():
    page = Page("<body><div class=box><p>" + "noise " * 60 + "</div><article class=a1><p>The text.</article></body>")
    assert page.text("/html/body/article.a#") == page.text(None) and page.text("/body/article.a#") == "The text."


LONG = " ".join(["A long sentence of the article that goes on and on for the reader."] * 6)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div class='wrapper menu-closed'><article><h1>Hd</h1><p>{}</p></article></div>", "Hd\n\n{}"),
        ("<body><div class='content ad-free'><p>{}</p></div>", "{}"),
        ("<article><div class='related-work'><p>{}</p></div></article>", "{}"),
        ("<div id=main class='page nav-open'><h1>Hd</h1><p>{}</p></div>", "Hd\n\n{}"),
        ("<article><p>first</p><svg/><p>{}</p></article>", "first\n\n{}"),
        ("<article><p>a<object/><p>{}</p></article>", "a\n\n{}"),
        ("<article><svg><path d=x><p>{}</p></article>", "{}"),
        ("<article><p>x <math><mi>y</mi></math> z</p><figure><figcaption>cap</figcaption></figure><p>{}</p></article>", "x y z\n\ncap\n\n{}"),
        ("<body><div class=t><h1>Head</h1></div><div class=c><p>{}</p></div>", "Head\n\n{}"),
        ("<body><div class=page><h1>T</h1><p>lead</p><div class=section><p>{}</p></div></div>", "T\n\nlead\n\n{}"),
        ("<article><p>{}</p><h2 id=related-work>Rel</h2><section id=search-methods><p>m</p></section></article><div class=related-posts><p>no</p></div>", "{}\n\nRel\n\nm"),
    ],
)
def test_html_keeps_whole_articles(source, want):
    assert Page(source.format(LONG)).text(None) == want.format(LONG)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body><form id='aspnetForm' action=/><div class='content'><h1>Hd</h1><p>{}</p></div></form>", "Hd\n\n{}"),
        ("<body><form><table><tr><td><h1>Hd</h1><p>{}</p></td></tr></table></form>", "Hd\n\n{}"),
        ("<article title='The hidden truth'><p>{}</p></article>", "{}"),
        ("<div class=content data-t='a hidden gem'><p>{}</p></div>", "{}"),
        ("<div role=form><article><p>{}</p></article></div>", "{}"),
        ("<noscript><article><p>{}</p></article></noscript>", "{}"),
        ("<body><aside class=main><p>{}</p></aside>", "{}"),
        ("<article><p title='see hidden note'>one</p><p>{}</p></article>", "one\n\n{}"),
        ("<article><p>{}</p><div title='id=menu'><p>two</p></div></article>", "{}\n\ntwo"),
        ("<article><p>Lead text <select><option>x</option></select> tail</p><p>{}</p></article>", "Lead text tail\n\n{}"),
        ("<article><p>Lead <audio><p>no sound</p></audio></p><p>{}</p></article>", "Lead\n\n{}"),
        ("<article><p>Seen <span style='display: none'>SECRET</span> text</p><p>{}</p></article>", "Seen text\n\n{}"),
        ("<article><p>Seen <span class='ad'>BUY</span> text</p><p>{}</p></article>", "Seen text\n\n{}"),
        ("<article><p>{}</p><form><p>Subscribe here</p></form><aside><p>aside</p></aside></article>", "{}"),
        ("<body><div role=navigation><p>go there</p></div><div class=content><p>{}</p></div><noscript>turn it on</noscript>", "{}"),
        ("<article><p class=a class=hidden>x</p><p hidden>no</p><p>{}</p></article>", "x\n\n{}"),
    ],
)
def test_html_neither_loses_nor_leaks(source, want):
    assert Page(source.format(LONG)).text(None) == want.format(LONG)


def test_html_stray_quotes_take_linear_time():
    import time

    began = time.process_time()
    text = Page("<article>" + '<p class="a title=x>text</p>\n' * 20_000 + "</article>").text(None)
    assert len(text) > 1000 and time.process_time() - began < 5


def test_warc(spark, tmp_path, monkeypatch):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, "other ü"), (4, "http://c", None), (5, "http://d", ""), (6, "http://e\r\nx", "y" * 300_000), (6, "http://e", "y" * 300_000), (None, "http://n", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1))
    out = collect(warc.archive(pages, f"file://{tmp_path}/w", keep_payload=True))
    by = {r["page_id"]: r for r in out}
    assert len(out) == 8 and by[1]["record_type"] == "response" and by[1]["payload"] == b"same" and (by[3]["record_type"], by[3]["refers_to"]) == ("revisit", 1)
    assert by[5]["refers_to"] == 4 and by[4]["payload_bytes"] == 0 and by[2]["payload"] == "other ü".encode() and by[6]["payload_bytes"] == 300_000
    assert all(r["payload_digest"] == warc.digest((t or "").encode()) for p, _, t in rows for r in out if r["page_id"] == p)
    assert {r["url"] for r in out if r["page_id"] == 6} == {"http://e\r\nx", "http://e"}
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    small = {r["page_id"]: r["record_type"] for r in collect(warc.archive(pages, least_bytes=5))}
    assert small[3] == small[1] == small[5] == "response"
    assert warc.archive(pages.limit(0)).count() == 0


def foreign(kind, block, **head):
    lines = {"WARC-Type": kind, "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in head.items()}
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n")


@pytest.mark.parametrize("indexed", ["plain", "gzip", "none"])
def test_packages_of_other_tools(spark, tmp_path, indexed):
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n"
    records = [foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields")]
    records += [foreign("response", http + b"page %d" % i, WARC_Record_ID=f"<urn:uuid:{i}>", WARC_Target_URI=f"http://h/{i}", Content_Type="application/http;msgtype=response") for i in range(1, 900)]
    records.append(foreign("revisit", http, WARC_Record_ID="<urn:uuid:900>", WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest="sha1:" + warc.digest(b"page 1"), Content_Type="application/http"))
    at, lines = 0, ["!meta {}"]
    for i, r in enumerate(records):
        if i % 300 or not i:  # an index may leave records out
            lines.append(f'h)/{i} 20200101 {{"url": "http://h/{i}", "offset": "{at}", "length": "{len(r)}", "filename": "crawl-7.warc.gz", "mime": "text/html"}}')
        at += len(r)
    index = "\n".join(lines).encode()
    with zipfile.ZipFile(tmp_path / "other.wacz", "w") as z:
        with z.open(zipfile.ZipInfo("archive/crawl-7.warc.gz"), "w", force_zip64=True) as f:
            f.write(b"".join(records))
        if indexed != "none":
            z.writestr(*(("indexes/all.cdx.gz", gzip.compress(index)) if indexed == "gzip" else ("indexes/all.cdxj", index)), zipfile.ZIP_DEFLATED)
        z.writestr("datapackage.json", "{}")
    paths = spark.createDataFrame([(f"file://{tmp_path}/other.wacz",)], "path string")
    out = {r["record_id"]: r for r in collect(warc.read_packages(paths, range_records=100))}
    assert len(out) == 901 and all(out[f"<urn:uuid:{i}>"]["payload"] == b"page %d" % i for i in range(1, 900))
    assert out["<urn:uuid:0>"]["record_type"] == "warcinfo" and out["<urn:uuid:5>"]["payload_digest"] == warc.digest(b"page 5") and out["<urn:uuid:5>"]["page_id"] is None
    assert (out["<urn:uuid:900>"]["record_type"], out["<urn:uuid:900>"]["payload"]) == ("revisit", None)


def test_ranges_are_unpacked_in_linear_time():
    import time

    def took(n):
        raw = b"".join(warc.record(i, "http://u", np.random.default_rng(i).bytes(30_000), None) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.unpacked(raw)) == n
        return time.process_time() - began

    took(50)
    assert took(1600) < 16 * max(took(200), 0.01)
    with pytest.raises(ValueError, match="no end"):
        list(warc.unpacked(gzip.compress(b"x")[:-3]))


def test_zip_directories():
    for wide in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for k in range(70_000 if wide else 3):
                z.writestr(f"m{k}", b"%d" % k)
            z.comment = b"note"
        data = out.getvalue()
        found = warc.members(lambda at, n: data[at : at + n], len(data))
        for k in (0, 2, 69_999 if wide else 1):
            at, n, method = found[f"m{k}"]
            assert data[at : at + n] == b"%d" % k and method == 0


def brute(table, n, percent):
    sets = {}
    for i, text, *_ in table:
        w = lower(text).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "group"), [(3, 90, 384), (5, 80, 8), (2, 50, 16)])
def test_ngram_join(spark, rows, n, percent, group):
    rng = np.random.default_rng(2)
    table = [r for r in rows if r[0] is not None and r[0] != 45]
    passage, base = words(rng, 60), words(rng, 120).split()
    for k in range(60):  # a large group of near copies, and texts that only share a passage
        w = list(base)
        for at in rng.choice(120, k % 5, replace=False):
            w[at] = "new"
        table.append((200 + k, " ".join(w), "en", "s"))
        table.append((300 + k, f"{passage} {words(rng, 20 + 3 * k)}", "en", "s"))
    out = collect(ngram_join(docs(spark, table), words=n, percent=percent, group=group))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(table, n, percent)


def test_join_repeats_and_null_ids(spark):
    table = [(5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (None, "a b c d e f", None, None), (None, "q r s t u v", None, None), (9, "", None, None)]
    out = collect(ngram_join(docs(spark, table)))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (0, 5), (5, 5), (5, 5), (9, 9)]


def test_compare_spans_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 30)) for _ in range(60)]
    links = compare(list(range(60)), sets, 70)
    up = list(range(60))
    for a, b in [(a, b) for a in range(60) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 70 * len(set(sets[a]) | set(sets[b]))]:
        up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    got = list(range(60))
    for a, b in links:
        got = [min(got[a], got[b]) if x in (got[a], got[b]) else x for x in got]
    assert got == up


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (100, 2000), (2000, 300)]
    out = {r["v"]: r["label"] for r in collect(components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert all(out[i] == 1 for i in range(1, 41)) and out[60] == 50 and out[2000] == out[300] == 100 and 70 not in out
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_lm_score(spark, rows):
    out = collect(score(docs(spark, rows)))
    count = Counter()
    token = {}
    for i, t, *_ in rows:
        w = [*lower(t).encode().split(), b""]
        token[i] = w
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        w = token[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(w), n, sum(count[x] > 0 for x in w))
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and r["bits_per_byte"] > 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    out = [r for r in collect(score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_probabilities_sum_to_one_at_most(spark):
    from trajlake.llm.lm_score import fit, score_words, word_counts

    texts = spark.createDataFrame([(True, "ab ab ba ca bb"), (True, "ab cc ba")], "train boolean, text string")
    counts = word_counts(texts)
    known = {r.word: r.c for r in counts.collect()}
    n, kinds, once = sum(known.values()), len(known), sum(c == 1 for c in known.values())
    mixer = fit(counts.where("c > 0"))
    other = spark.createDataFrame([(bytearray(b"zz"), 0, 1)], "word binary, c bigint, n bigint")
    lp = {bytes(r.word): r.lp for r in score_words(counts.unionByName(other), mixer, n, kinds, once).collect()}
    assert 0.9 < sum(10**x for x in lp.values()) <= 1 + 1e-9
    every = [bytes([a]) for a in range(256)]
    assert np.exp2(-mixer.word_bits(every)).sum() < 1


def test_mixing(spark):
    rng = np.random.default_rng(6)
    table = [(i, words(rng, int(rng.integers(1, 60))), "en", ["b", "a", None, "é", "z"][i % 5] if i % 3 else "b") for i in range(900)] + [(1000, None, "en", "a"), (1001, "", "en", "empty"), (7, "again and again", "en", "a")]
    df = docs(spark, table)
    one, two = (sorted(map(str, collect(mix_sources(d, fan_in=8)))) for d in (df, df.repartition(7)))
    assert one == two and len(one) == len(table)
    out = collect(mix_sources(df, fan_in=8))
    by, total = {}, sum(r["size"] for r in out)
    for r in out:
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        g = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        g[0] += r["taken"]
        g[3] = max(g[3], r["size"])
    assert sum(g[2] for g in by.values()) == pytest.approx(1.5 * total)
    for taken, size, target, largest in by.values():
        assert abs(taken - target) <= largest and target <= 2 * size + 1e-6
    free = {k: g for k, g in by.items() if g[2] < 2 * g[1] - 1e-6}
    weight = dict(zip(["a", "b", "empty", "z", "é", None], [3, 1, 2, 3, 1, 2], strict=True))
    assert len({round(g[2] / weight[k], 4) for k, g in free.items()}) == 1


def test_targets_of_one_source(spark):
    out = source_targets(spark.createDataFrame([("a", 10), ("a", 6)], "source string, size bigint")).first()
    assert out.target == pytest.approx(24)


def test_reduction_and_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(30):
        counts = dict(Counter(rng.integers(1, 101, 60).tolist()))
        fixed, left = reduce_histogram(counts, 100)
        bins = fixed + best_fit(left, 100)
        used = Counter()
        for pattern, times in bins:
            assert sum(pattern) <= 100 and times > 0
            for x in pattern:
                used[x] += times
        assert used == counts
        rooms: list[int] = []
        for size in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            k = next((k for k, room in enumerate(rooms) if room >= size), None)
            rooms = [*rooms, 100 - size] if k is None else [room - size * (x == k) for x, room in enumerate(rooms)]
        assert sum(t for _, t in bins) <= len(rooms)
    assert reduce_histogram({60: 2, 40: 2}, 100) == ([((60, 40), 2)], {})
    runs = plan_runs({60: 2, 40: 3, 100: 1}, 100)
    assert len(runs) and runs[:, 0].max() == 100 and plan_runs({}, 100).shape == (0, 4)


def best_possible(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(9)
    for _ in range(60):
        sizes = sorted(rng.integers(5, 31, 8).tolist(), reverse=True)
        fixed, left = reduce_histogram(dict(Counter(sizes)), 30)
        rest = sorted((k for k, v in left.items() for _ in range(v)), reverse=True)
        assert sum(t for _, t in fixed) + best_possible(rest, 30) == best_possible(sizes, 30)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    table = [r for r in rows if r[0] is not None] + [(60, "it's don't WE'LL <|endoftext|> a<|startoftext|>b Straße ΣΑΣ İx 12ab3 a,b.c!!", "en", "s")]
    out = collect(pack(docs(spark, table), tokenizer_file(), capacity=128))
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in table}
    assert Counter(r["doc_id"] for r in out) == Counter({i: -(-len(ids[i]) // 128) * sum(r[0] == i for r in table) for i in ids})
    seqs = {}
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + 128]
        assert r["start"] == 128 * r["piece"] and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(seqs) <= 1.02 * sum(r["length"] for r in out) / 128
    assert packing.CAPACITY == 4096


def test_licences(spark):
    rng = np.random.default_rng(10)
    table = [(i, "\n".join(words(rng, 30, EN) for _ in range(5)), "en", "s") for i in range(60)]
    table += [(100, "x\nReleased under the MIT License.\nmore", "en", "s"), (101, "Licensed under CC BY-NC 4.0. " + words(rng, 40, EN), "en", "s"), (102, None, None, None), (103, "", "en", "s"), (104, "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "en", "s")]
    out = {r["doc_id"]: r for r in collect(scan(docs(spark, table)))}
    assert {k: r["family"] for k, r in out.items()} == {100: "MIT", 101: "CC-BY-NC", 104: "GPL"} and out[100]["paragraph"] == 1


def test_licences_wrapped_and_two_in_a_line(spark):
    import textwrap

    from trajlake.llm.licenses import STATEMENTS

    rng = np.random.default_rng(11)
    plain = ["\n".join(words(rng, 12, EN) for _ in range(12)) for _ in range(60)]
    table = [(i, t, "en", "s") for i, t in enumerate(plain)]
    table += [(100, plain[0] + "\n" + "\n".join(textwrap.wrap(STATEMENTS["MIT"][3], 50)) + "\n" + plain[1], "en", "s"), (101, "Licensed under the MIT License. Licensed under the BSD 3-Clause License.", "en", "s")]
    out = collect(scan(docs(spark, table)))
    assert sorted((r["doc_id"], r["family"]) for r in out if r["family"] != "unknown") == [(100, "MIT"), (101, "BSD"), (101, "MIT")]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    plain = [(i, words(rng, 80), "en", f"s{i % 3}") for i in range(60)]
    rows = [*plain, (100, plain[0][1].upper(), "en", "s0"), (101, plain[1][1] + " tail", "en", "s1"), (102, None, None, "s2"), (103, "12 34", None, "s2")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "packing"]
    data, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        data = stage(spark, data, str(tmp_path))
        assert data.columns == corpus_pipeline.COLUMNS
        data.write.parquet(f"{tmp_path}/stage{k}.parquet")
        data = spark.read.parquet(f"{tmp_path}/stage{k}.parquet")
        left.append({r.doc_id for r in data.collect()})
    assert left[0] == set(range(60)) | {100, 101} and left[1] == left[0] - {0} and left[2] == left[1] - {101}
    assert data.count() > 0.8 * len(left[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left[3]


def test_pipeline_keeps_clean_rows_with_repeated_or_null_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    a, b, c, d, e, f = (words(rng, 80) for _ in range(6))
    rows = [(1, a, "en", "s"), (1, "12 34", "en", "s"), (None, b, "en", "s"), (None, None, "en", "s"), (None, c, "en", "s"), (2, c.upper(), "en", "s"), (2, d, "en", "s"), (3, d, "en", "s")]
    rows += [(4, e, "en", "s"), (5, e + " tail", "en", "s"), (5, f, "en", "s"), (None, f + " tail", "en", "s"), (6, f, "en", "s"), (6, f, "en", "s")]
    data = docs(spark, rows).select(corpus_pipeline.COLUMNS)
    left = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        data = stage(spark, data, "")
        left.append(sorted(((r.doc_id or 0, r.text) for r in data.collect())))
    first = sorted((r[0] or 0, r[1]) for r in rows if r[1] and "12 34" not in r[1])
    second = sorted([(1, a), (0, b), (2, c.upper()), (3, d), (4, e), (5, e + " tail"), (0, f + " tail"), (6, f)])
    third = sorted([(1, a), (0, b), (2, c.upper()), (3, d), (4, e), (6, f)])
    assert left == [first, second, third]
    many = docs(spark, [(None if i % 3 else i % 5, words(rng, 20), "en", "s") for i in range(200)]).select(corpus_pipeline.COLUMNS)
    taken = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixed(spark, many, "").collect())
    assert sum(20 * n for n in taken.values()) == pytest.approx(1.5 * 200 * 20, abs=20) and set(taken.values()) == {1, 2} and len(taken) == 200


def test_licences_need_the_classifier(spark, monkeypatch):
    from trajlake.llm import licenses

    table = [(1, "Released under the MIT License.", "en", "s"), (1, "Released under the MIT License.", "en", "s"), (None, "Licensed under CC BY 4.0.", None, None)]
    out = collect(scan(docs(spark, table)))
    assert sorted((str(r["doc_id"]), r["family"], r["predicted"]) for r in out) == [("1", "MIT", "MIT"), ("1", "MIT", "MIT"), ("None", "CC-BY", "CC-BY")]
    once = collect(scan(docs(spark, table[1:])))
    assert {r["probability"] for r in out if r["doc_id"] == 1} == {r["probability"] for r in once if r["doc_id"] == 1}
    # A classifier that takes MIT for GPL: the template of another family doesn't decide.
    true = licenses.train

    def swapped(texts, n):
        classes, vocabulary, weights, intercepts, threshold = true(texts, n)
        a, b = classes.index("MIT"), classes.index("GPL")
        for x in (weights, intercepts):
            x[a], x[b] = x[b], x[a]
        return classes, vocabulary, weights, intercepts, threshold

    monkeypatch.setattr(licenses, "train", swapped)
    assert {(r["family"], r["predicted"]) for r in collect(scan(docs(spark, table[:1])))} == {("unknown", "GPL")}


def test_language_learns_from_rows_without_ids(spark):
    """Rows that share an id, or have none, are drawn each for itself; a repeated text counts once."""
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null")
    anonymous = sf.withColumn("doc_id", F.lit(None).cast("bigint"))
    anonymous = anonymous.unionByName(spark.range(500).join(anonymous.limit(1)).drop("id"))
    out = identify(anonymous.withColumnRenamed("lang", "given").withColumn("lang", F.col("given")), sample_docs=40)
    seen = {r["lang_pred"] for r in out.collect()}
    assert seen == {r["lang"] for r in sf.select("lang").distinct().collect()} | (seen & {"und"})


def test_lm_scores_do_not_depend_on_partitions(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    sf = spark.createDataFrame(sf.collect(), sf.schema)
    a, b = ({r["doc_id"]: r["score"] for r in score(sf.repartition(n)).collect()} for n in (2, 7))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_lm_codes_texts_of_a_batch_together():
    """Codes of texts in one array are those of each alone, and those of a plain reading of the model, bit by bit."""
    from trajlake.llm import lm_score as M

    rng = np.random.default_rng(4)
    texts = [np.append(rng.choice([0, *range(2, 40)], int(n), p=np.array([2, *([1] * 38)]) / 40), M.END_LEAF) for n in rng.integers(0, 60, 50)]
    ids = np.concatenate(texts)
    model = M.Runs(np.bincount(ids, minlength=40))
    for bit, slots, n in model.bits(ids):
        assert n.sum() == len(bit) and slots.shape == (M.CONTEXTS, len(bit))
        np.add.at(model.total, slots, 1)
        np.add.at(model.ones, slots, bit)
    assert model.learn(ids, model.tables(True)) == model.size[ids].sum()
    tables = model.tables(False)
    both = model.code(ids, tables)
    assert np.abs(np.concatenate([model.code(x, tables) for x in texts]) - both).max() < 1e-6

    bit, slots, n = next(model.bits(ids))
    total, ones = model.total[slots].astype(float), model.ones[slots].astype(float)
    level = (total > 0).astype(int) + (total > 3) + (total > 30)
    gate = 4 * level[1] + level[2]
    logit = (np.log((ones + 0.2) / (total - ones + 0.2)) * model.weights[gate, :-1].T).sum(0) + model.weights[gate, -1]
    cell = model.cells(logit, gate)
    p = 1 / (1 + np.exp(-logit))
    p += (model.map_ones[cell] - model.map_total[cell] * p) / (2 * (model.map_total[cell] + 1000))
    plain = np.add.reduceat(np.log10(np.where(bit, p, 1 - p)), np.cumsum(n) - n)
    # A logit at a cell's border may fall to either side.
    assert np.quantile(np.abs(plain - both[: len(n)]), 0.98) < 1e-4


def test_lm_scores_running_text(spark):
    """What comes before a word counts, as often as it did: here three times of four."""
    rng = np.random.default_rng(3)
    pairs = np.array(["red fox", "red fox", "red fox", "red sky", "blue sky", "blue sky", "blue sky", "blue fox"])
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:12]
    told, swapped = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    table = [(i, " ".join(rng.choice(pairs, 80))) for i in train] + [(told, "red fox blue sky " * 5), (swapped, "red sky blue fox " * 5)]
    out = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    assert len(out) == 14 and out[told] > out[swapped] + 2
