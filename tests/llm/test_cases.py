"""Brute-force versions, and rows that operators must not stumble over: nulls, repeats, ties, very long values, crowded keys."""

import base64
import hashlib
import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DE, DOCS, EN, brute, collect, docs, words
from trajlake.llm import ngram_join as join_module
from trajlake.llm.html_text import extract
from trajlake.llm.language_id import ORDER, UNKNOWN, identify
from trajlake.llm.lm_score import score
from trajlake.llm.ngram_join import ngram_join
from trajlake.llm.packing import pack
from trajlake.llm.queries import tokenizer_file
from trajlake.llm.warc import archive

SF = "/root/testdata/sf0.001"


class Tree:
    """Prediction by partial matching as the textbook has it: one dictionary of contexts, byte by byte."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            for word in text.encode().lower().split():
                padded = b" " + word + b" "
                for at in range(1, len(padded)):
                    for k in range(min(ORDER, at) + 1):
                        self.seen[padded[at - k : at]][padded[at]] += 1

    def bits(self, text):
        total = 0.0
        for word in text.encode().lower().split():
            padded = b" " + word + b" "
            for at in range(1, len(padded)):
                for k in range(min(ORDER, at), -1, -1):
                    n = self.seen.get(padded[at - k : at])
                    if not n:
                        continue
                    if padded[at] in n:
                        total -= math.log2(n[padded[at]] / (n.total() + len(n)))
                        break
                    total -= math.log2(len(n) / (n.total() + len(n)))
                else:
                    total += 8
        return total


def test_language_matches_trees_of_dictionaries(spark):
    rng = np.random.default_rng(21)
    table = [(i, words(rng, 25, EN), "en", "s") for i in range(30)] + [(100 + i, words(rng, 25, DE), "de", "s") for i in range(30)]
    # Repeated rows and ids, unseen bytes, a tie of no known bytes, a text of both.
    table += [table[0], table[0], (1, words(rng, 5, DE), "de", None), (None, words(rng, 5, EN), "en", "s"), (200, "żółć straße naïve", None, "s"), (201, "日本語", None, "s"), (202, words(rng, 9, EN) + " " + words(rng, 9, DE), None, "s"), (203, "12 345", "en", "s"), (204, "", "de", "s"), (205, None, "de", "s"), (206, words(rng, 40_000, EN + DE), None, "s")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in table]
    trees = {x: Tree({t for (_, t, lang, _), h in zip(table, held, strict=True) if lang == x and t and not h}) for x in ("de", "en")}
    want = Counter()
    for (i, text, *_), h in zip(table, held, strict=True):
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            want[i, h, UNKNOWN, 0.0] += 1
            continue
        bits = {x: tree.bits(text) for x, tree in trees.items()}
        best = min(sorted(bits), key=bits.get)
        want[i, h, best, round(1 / sum(2.0 ** min(bits[best] - b, 0) for b in bits.values()), 3)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in collect(identify(docs(spark, table))))
    assert got == want


@pytest.mark.parametrize("hot_rows", [64, 1])
def test_one_passage_in_many_unlike_sets(spark, hot_rows, monkeypatch):
    """A crowded element links nothing by itself, and loses no link of those who share more."""
    import trajlake.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rng = np.random.default_rng(22)
    passage = words(rng, 7)
    table = [(i, f"{passage} x{i} y{i} z{i % 40}", None, None) for i in range(700)]
    table += [(1000 + i, f"{passage} x{i} y{i} z{i % 40} tail", None, None) for i in range(0, 700, 7)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collect(ngram_join(docs(spark, table), words=2, percent=85, group=64))}
    assert got == brute(table, 2, 85)
    assert sum(a != b for a, (_, b) in got.items()) == 100


def test_rows_of_a_crowded_element_are_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("e"), F.col("id").alias("rep"))
    side = rows.groupBy("e").agg(F.count("*").alias("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = join_module._by(rows, side, ["e"], "k")
        assert met.count() == 4000 and met.where("e = 1").agg(F.min("k"), F.max("k")).first() == (3000, 3000)
        places = met.where("e = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(places) > 1 or met.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_warc_of_the_given_pages_matches_a_dictionary(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    long_url = "http://h.example/" + "a" * 70_000 + "?q=ü ö"
    extra = [(900_001, long_url, "<p>same</p>"), (900_002, None, "<p>same</p>"), (900_003, "http://x", None), (900_004, "", ""), (900_005, "http://x\r\ny", "é" * 300_000)]
    table = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id bigint, url string, html string"))
    given = [(r.page_id, r.html or "") for r in table.collect()]
    first = {}
    for i, html in sorted(given):
        first.setdefault(html, i)
    want = {}
    for i, html in given:
        raw, of = html.encode(), first[html]
        want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if of == i else "revisit", None if of == i else of)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in collect(archive(table))}
    assert got == want


def test_pages_that_repeat_or_have_no_id(spark):
    page = "<html><body><div class='menu'><a href=1>Home</a></div><div class='story'><h1>Title</h1><p>{}</p></div></body></html>"
    body = "A paragraph of running text that is long enough to be an article. " * 4
    rows = [(1, "http://a/1", page.format(body)), (1, "http://a/1", page.format(body)), (None, None, page.format(body)), (None, "not a url", page.format("<b>x</b> " + body)), (2, "http://a/2", None), (3, "http://a/3", ""), (4, "http://a/4", page.format(body * 3000))]
    out = collect(extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1), "host": F.lit("h")})))
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    one = f"Title\n\n{body.strip()}"
    assert [r["text"] for r in out if r["page_id"] == 1] == [one, one]
    assert sorted(r["text"] for r in out if r["page_id"] is None) == sorted([one, f"Title\n\nx {body.strip()}"])
    assert {r["page_id"]: r["text"] for r in out if r["page_id"] in (2, 3)} == {2: "", 3: ""}
    assert [r["n_chars"] for r in out if r["page_id"] == 4] == [len(f"Title\n\n{(body * 3000).strip()}")]


def test_packing_of_rows_without_ids(spark):
    rng = np.random.default_rng(23)
    long = words(rng, 9000)
    table = [(None, long, None, None), (None, long, None, None), (None, None, None, None), (None, "", None, None), (5, "a", None, None), (5, "a", None, None)]
    out = collect(pack(docs(spark, table), tokenizer_file()))
    whole = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert sum(r["piece"] == 0 for r in out) == 6 and {n for (i, p, *_), n in whole.items()} == {2}
    ends = defaultdict(list)
    for r in out:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in ends.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_base_score_of_the_given_documents_matches_counters(spark):
    import re

    data = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))) for r in data.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    seen, n = Counter(), 0
    for i, w in rows:
        if not held[i]:
            seen.update(w)
            n += len(w) + 1
    docs_in = sum(not h for h in held.values())
    v = len(seen) + 1
    got = {r["doc_id"]: r for r in collect(score(data))}
    for i, w in rows:
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w) + math.log10((docs_in + 1) / (n + v + 1))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(x in seen for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_row_keys_of_written_files(spark, tmp_path, most, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "BROADCAST_FILES", most)
    monkeypatch.setattr(corpus_pipeline, "FILE_BUCKETS", 4)
    rows = [(i % 5 or None, f"text {i}", "en", "s", 6) for i in range(300)]
    spark.createDataFrame(rows, DOCS).repartition(30).write.parquet(f"{tmp_path}/d.parquet")
    data = spark.read.parquet(f"{tmp_path}/d.parquet")
    keyed = corpus_pipeline._keyed(data, "rows")
    one, two = ({r._row: r.text for r in keyed.collect()} for _ in range(2))
    assert one == two and len(one) == 300 and set(one.values()) == {r[1] for r in rows}
    if most:
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pipeline_against_a_loop(spark, tmp_path):
    """The first three stages row by row, as plain Python has them; the last two by what they must keep."""
    import corpus_pipeline

    rng = np.random.default_rng(24)
    texts = [words(rng, int(rng.integers(6, 90))) for _ in range(50)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), "en", "s1") for i in range(0, 20, 3)] + [(200 + i, f"{texts[i]} tail", "de", "s2") for i in range(0, 50, 6)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, "77 %", "en", "s1"), (303, words(rng, 60_000), "en", "s3"), (304, "one word", "en", "s3"), (305, "ONE WORD", "en", "s3")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")

    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in sorted(letters):
        last[r[1].lower()] = r
    near = brute([r for r in last.values()], 5, 80)
    third = sorted(r[0] for r in last.values() if near[r[0]][1] == r[0])

    data, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        data = stage(spark, data, str(tmp_path))
        data.write.parquet(f"{tmp_path}/stage{k}.parquet")
        data = spark.read.parquet(f"{tmp_path}/stage{k}.parquet")
        left.append(sorted(r.doc_id for r in data.collect()))
    assert left[:3] == [sorted(r[0] for r in letters), sorted(r[0] for r in last.values()), third]
    taken = Counter(left[3])
    assert set(taken) <= set(third) and set(taken.values()) <= {1, 2}
    packed = collect(corpus_pipeline.packed(spark, data, ""))
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == taken


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
