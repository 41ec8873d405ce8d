"""Each operator against SQL, a brute-force version or an exact round trip, and on nulls, empty tables, repeats and odd columns."""

import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assaya.llm import bpe, common, components, decontam, html, jaccard, passages, quality, registry, tokenfile, toxicity, urlfilter, warc
from assaya.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words int"
PAGES = "page_id long, url string, html string, digest string, salt int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, t, s in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{k}" for k in range(30_000))
    return docs_of(spark, [(1, None, None), (2, "", "a"), (None, "some words here", "a"), (3, long, "a"), (4, long, "b"), (4, long, "b"), (5, " \n\t ", "b"), (6, "a b", "b")])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, against, name):
    against(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_odd_rows_and_empty_tables(spark, odd):
    none = odd.where("false")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    for run in (quality.judge, bpe.round_trips, jaccard.cluster, lambda d: decontam.judge(d, items)):
        assert len(run(odd).collect()) == 8
        assert run(none).collect() == []
    assert {r.doc_id for r in decontam.judge(odd, items).where("contaminated").collect()} == {3, 4}
    assert decontam.judge(odd, items.where("false")).where("contaminated").count() == 0
    assert {r.doc_id: r.component_id for r in jaccard.cluster(odd).collect()} == {1: 1, 2: 2, None: None, 3: 3, 4: 3, 5: 5, 6: 6}
    assert {(r.doc_id, r.other_id) for r in passages.find(odd).collect()} == {(4, 3)}
    assert passages.find(none).collect() == []
    assert passages.remove_repeats(none).collect() == []
    left = passages.remove_repeats(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6]
    assert quality.keep(odd).columns == odd.columns


def test_failing_host_loses_its_documents(spark):
    good = " ".join(f"g{k}" for k in range(60))
    rows = [(k, good, f"h{k % 20}") for k in range(400)] + [(1000 + k, "bad text" if k < 38 else good, "junk") for k in range(40)]
    out = quality.judge(docs_of(spark, rows)).collect()
    assert {r.source for r in out if r.host_failed} == {"junk"}
    assert sum(r.kept for r in out) == 400


def test_warc_round_trip(spark):
    big, small = "é" * 80, "tiny"
    rows = [(3, "http://a/\r\nx\u2028\u0085WARC-Type: x ÅWARC-Payload-Digest: y", big), (2, None, big), (2, None, big), (9, "u", small), (8, "u", small), (5, "u", None), (None, "u", big)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)
    path = scratch(spark, "warc-test")
    warc.write_archive(pages, path)
    got = warc.parsed(warc.read_archive(spark, path)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "revisit", 2), (5, "response", None), (8, "response", None), (9, "response", None)]
    for r in got:
        assert r.type_read == r.record_type and r.digest_read == r.digest and r.block_bytes == r.length_read
        assert r.page_read == r.page_id and r.refers_read == r.refers_to
        assert r.block_digest == (r.digest if r.record_type == "response" else hashlib.sha256(b"").hexdigest())
    assert {r.payload_bytes for r in got} == {0, 4, 160}
    assert spark.read.parquet(f"{path}/blobs").count() == 3
    assert {bytes(r.payload) for r in warc.resolved(spark, path).collect()} == {b"", small.encode(), big.encode()}
    warc.write_archive(pages.where("false"), path + "-none")
    assert warc.read_archive(spark, path + "-none").collect() == []


def test_url_rules_and_terms(spark):
    urls = ["http://x.example.net/en/a", "http://EXAMPLE.com/de/", "https://a.org/fr/x?porn", "https://a.org/x?porn", "https://a.org/unporned", "http://a.com/casino-poker", "http://a.com/casino", "http://a.net?x", None, "no scheme", "", "http://h#/en/"]
    pages = spark.createDataFrame([(k, u, None, "x", 1) for k, u in enumerate(urls)], PAGES)
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got[0] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert [g[3] for g in got] == ["allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    terms = spark.createDataFrame([("Unporned", 0.4), ("casino", 0.3), ("casino", 0.6), ("poker", 0.4), (None, 9.0), ("", 9.0), ("x", None)], "term string, weight double")
    words = urlfilter.vocabulary_of(terms)
    assert words == {"unporned": 0.4, "casino": 0.6, "poker": 0.4}
    weighed = {r.page_id: (r.n_strict, r.n_soft, r.weight, r.verdict) for r in urlfilter.judge(pages.unionByName(pages), (), words).collect()}
    assert weighed[4] == (0, 1, 0.4, "allow") and weighed[5] == (0, 2, 1.0, "block") and weighed[6] == (0, 1, 0.6, "allow") and weighed[3][3] == "allow"
    assert urlfilter.judge(pages.where("false")).collect() == []
    assert got[7][:3] == ("a.net", "", None) and got[8][:2] == ("", "") and got[11][:2] == ("h", "")


def test_main_text():
    tree = html.train()
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>home</a></nav><script>var x='</p>';</script><div class=\"ad\">buy this now please</div><article><h1>A &amp; B</h1><p>one\n two<b>three</b><br>four</p><p>Be.</p><div class='comments'><p>nice read</p></div></article><!-- <p>no</p> --><form><p>mail</p></form><footer>&copy; x</footer>"
    assert html.main_text(page, tree) == "A & B\n\none twothree four\n\nBe."
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<", tree).strip("<") == ""
    assert html.main_text("<article><p>cut of", tree) == "cut of"
    long = "a text of many words that goes on for a while and tells a story to whoever reads it to the end of this line"
    for start, end in (
        ('<div class="page nav-open"><article>', "</article></div>"),
        ('<div class="post-body popular-science">', "</div>"),
        ('<article><section id="related-work">', "</section></article>"),
        ('<div class="layout sidebar"><main>', "</main></div>"),
    ):
        page = f"{start}<p>{long}</p><p>{long}</p>{end}<div class='related-posts'><p>{long}</p></div><div id=sidebar><main></main><p>{long}</p></div>"
        assert html.main_text(page, tree) == f"{long}\n\n{long}", start
    assert html.main_text(f"<article><p>{long}</p></article><div class='comments'><article class='comment'><p>{long}</p></article><article><p>{long}</p></article></div>", tree) == long


def test_pages_with_odd_rows(spark):
    """Nulls, repeated rows, a very long page, clashing columns and an empty table."""
    long = "words and more words " * 100_000
    pages = spark.createDataFrame([(None, None, None, "x", 1), (1, "u", "<article><p>a b</p>", "x", 1), (1, "u", "<article><p>a b</p>", "x", 1), (2, "u", f"<article><p>{long}</p>", "x", 1)], PAGES.replace("digest", "text").replace("salt", "n_chars"))
    got = sorted((r.page_id or 0, r.url, r.n_chars, r.text) for r in html.extract(pages).collect())
    assert got == [(0, None, 0, ""), (1, "u", 3, "a b"), (1, "u", 3, "a b"), (2, "u", len(long) - 1, long.strip())]
    assert html.extract(pages.where("false")).collect() == []


def test_tree_on_held_out_pages():
    """Pages of another seed than the table's: the tree classifies their blocks, and hardly any text of an article is lost."""
    tree, right, total, lost, kept = html.train(), 0, 0, 0, 0
    for page in html.labelled_pages(99, 300):
        blocks = html.blocks_of(page)
        for block, row in zip(blocks, html.features(blocks), strict=True):
            main, found = bool(re.search(r"\bm\d", block.text)), html.is_main(tree, row)
            right, total = right + (main == found), total + 1
            lost, kept = lost + (main and not found), kept + main
    assert right >= 0.98 * total and lost <= 0.005 * kept


def test_what_surrounds_an_article_does_not_erase_it():
    tree = html.train()
    long = " ".join(f"w{k}" for k in range(120))
    for mark in ('form id="aspnetForm"', "form", 'div class="story-promo"', 'div class="post-share"', 'div class="content-widget"', 'div class="main-menu-page"', 'div id="main-content-nav"'):
        tag = mark.split()[0]
        page = f"<nav><a href=/>home</a></nav><{mark}><article><h1>Title here</h1><p>{long}</p><p>{long}</p></article></{tag}><footer>c</footer>"
        assert html.main_text(page, tree) == f"Title here\n\n{long}\n\n{long}", mark
    assert html.main_text(f"<article><p>{long}</p><section id=discussion><p>{long}</p></section></article>", tree) == f"{long}\n\n{long}"
    for words, linked in ((200, 24), (40, 5), (90, 11)):
        rich = " ".join(f"w{k}" for k in range(words - linked)) + " <a href=x>" + " ".join(f"l{k}" for k in range(linked)) + "</a>"
        page = f"<ul><li><a href=x>home</a><li><a href=y>about us</a></ul><h1>Some title words</h1><p>{long}</p><p>{rich}</p><p>{long}</p><p>Copyright 2024 Foo</p>"
        assert html.main_text(page, tree) == f"Some title words\n\n{long}\n\n{re.sub('<[^>]*>', '', rich)}\n\n{long}"



def merges_of(rng, letters):
    bytes_of, pairs = {i: bytes([97 + i]) for i in range(letters)}, []
    for _ in range(60):
        a, b = rng.choice(list(bytes_of)), rng.choice(list(bytes_of))
        if bytes_of[a] + bytes_of[b] not in bytes_of.values() and len(bytes_of[a] + bytes_of[b]) <= 8 and len(pairs) < 12:
            bytes_of[len(bytes_of)] = bytes_of[a] + bytes_of[b]
            pairs.append((a, b, len(bytes_of) - 1))
    return bpe.Merges([max(0, min(i - 97, letters - 1)) for i in range(256)], pairs, bytes_of)


def plain_bpe(m, data):
    ids = [m.byte_ids[b] for b in data]
    while found := [(m.ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in m.ranks]:
        k = min(found)[1]
        ids[k : k + 2] = [m.ranks[(ids[k], ids[k + 1])][1]]
    return ids


def test_transducer_is_stable_and_bounded():
    rng = random.Random(2)
    for trial in range(80):
        m = merges_of(rng, 2 + trial % 2)
        words = [bytes(rng.choice(range(97, 99 + trial % 2)) for _ in range(rng.randrange(1, 40))) for _ in range(5)]
        assert m.encode_many(words) == [plain_bpe(m, w) for w in words]
        data, t, out = b"".join(words) * 3, bpe.Transducer(m), []
        for k in range(0, len(data), 37):
            out += t.feed(data[k : k + 37])
            assert len(t.held) <= 2 * t.most
        assert out + t.finish() == plain_bpe(m, data)


ODD_TEXTS = ["", " ", "  a  b ", "don't we'll I'RE x'r 're", "a\n\n b\t c \n", "<|endoftext|> hi<|endoftext|>", "日本語 text 😀😀 é x", "a" * 20_000, "ab1²½_ __ \x1c x \x85 y", "x" * 70 + " " + "9" * 100, "a '\ns b"]


def test_bpe_as_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    docs = docs_of(spark, [(k, t, "s") for k, t in enumerate(ODD_TEXTS)])
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(ODD_TEXTS)}
    assert {r.doc_id: r.ids for r in bpe.encoded(docs).collect()} == want
    assert {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs)).collect()} == dict(enumerate(ODD_TEXTS))
    for r in bpe.round_trips(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(ODD_TEXTS[r.doc_id].encode()).hexdigest()
    path, start = scratch(spark, "tokens-test"), 0
    got = tokenfile.read_tokens(spark, path, tokenfile.write_tokens(docs, path)).orderBy("doc_id").collect()
    for r in got:
        ids = np.array([*want[r.doc_id], 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.read_tokens(spark, path, tokenfile.write_tokens(docs.where("false"), path + "-none")).collect() == []


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_token_file_reads_only_what_is_asked_for():
    sink = io.BytesIO()
    w = tokenfile.Writer(sink)
    lists = {5: [1, 2, 3], 7: [], None: [9] * 1000, 8: [65535]}
    for k, v in lists.items():
        w.add(k, np.array(v, np.int64))
    w.close()
    r = tokenfile.Reader(Source(sink.getvalue()))
    assert r.document(r.find(8)[0]).tolist() == [65535] and r.document(2).tolist() == [9] * 1000
    broken = bytearray(sink.getvalue())
    broken[6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        tokenfile.Reader(Source(bytes(broken))).document(0)


def test_count_tree_bounds():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (300, 8))
    for q in points[:20]:
        got = set(jaccard.CountTree(points).search(q, lambda n, q=q: 0.45 * (n + q.sum())).tolist())
        assert got == {k for k, p in enumerate(points) if np.minimum(p, q).sum() >= 0.45 * (p.sum() + q.sum())}


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    of = lambda x: np.frombuffer(jaccard.parity_bits(x), np.uint64)
    for n, m in ((1, 1), (200, 250), (255, 257), (1000, 1250), (1500, 700), (0, 3)):
        a, b = (np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (n, m))
        b[: m // 2] = a[: m // 2] if m // 2 <= n else b[: m // 2]
        differ = jaccard.apart_bits(of(a), of(b)[None])[0]
        assert differ == jaccard.apart_bits(of(b), of(a)[None])[0] <= len(np.setxor1d(a, b))


def test_trees_let_few_pairs_of_long_unrelated_texts_through():
    """Over 64 groups all sets of 2,000 shingles look alike, so that every pair of a key went on to the verification."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 1600 + 20 * k, np.uint64)) for k in range(60)]
    for k in range(30, 60, 3):  # near copies of an earlier one, some with more or fewer members
        sets[k] = np.unique(np.concatenate([sets[k - 30][rng.integers(0, 20) * (k % 2) :], rng.integers(0, 1 << 63, 3 * k, np.uint64)]))
    rows = [(7, 0, 0, True, k, k, jaccard.count_vector(x).astype(np.uint32).tobytes(), jaccard.parity_bits(x)) for k, x in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "lo", "hi", "upper", "doc_id", "label", "counts", "bits"])
    got = {(a, b) for x in jaccard._across(80, 100)(iter([batch])) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    links = {(a, b) for a in range(60) for b in range(a) if jaccard.similar(sets[a], sets[b], 80, 100)}
    assert len(links) >= 8 and links <= got and len(got) <= 2 * len(links)


def test_shuffles_go_when_their_table_is_written(spark):
    """They stayed until the driver collected its garbage, so that the shuffles of all steps lay on the disks together."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {str(f) for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = held()
    kept, _ = common.written(spark.range(50_000).repartition(7, "id").groupBy("id").count(), "shuffles")
    end = time.time() + 10
    while held() - before and time.time() < end:
        time.sleep(0.1)
    assert not held() - before and kept.count() == 50_000


def test_jaccard_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(400)] = f"x{rng.random()}"
        rows.append((k, " ".join(w), "s"))
    rows += [(200 + k, " ".join(f"{k}y{j}" for j in range(100)), "s") for k in range(20)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t, _ in rows}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert {r.doc_id: r.component_id for r in jaccard.cluster(docs_of(spark, rows)).collect()} == label


def test_classes_are_not_broadcast_by_the_size_of_their_files(spark):
    rows = [(k, " ".join(f"w{k % 1500 * 6 + x}" for x in range(6)), "s") for k in range(3000)] + [(k, "one text for all of these", "s") for k in range(3000, 4500)]
    out = jaccard.cluster(docs_of(spark, rows))
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: min(k % 1500, k) if k < 3000 else 3000 for k in range(4500)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1  # the few large classes alone


@pytest.mark.parametrize("hot", [50, 3])
def test_jaccard_loses_no_link_between_near_misses(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(hot)
    families = []
    for f in range(6):
        families.append([[f"f{f}w{k}" for k in range(150)]])
    rows = []
    common = [f"c{k}" for k in range(60)]
    for k in range(240):
        family = families[rng.randrange(6)]
        w = list(rng.choice(family))
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(150)] = f"x{rng.random()}"
        family.append(w)
        rows.append((rng.randrange(10**9), " ".join((common if k % 2 else []) + w), "s"))
    rows += [(rng.randrange(10**9), " ".join([*common, *(f"z{rng.random()}" for _ in range(6))]), "s") for _ in range(80)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t, _ in rows}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert 20 < len(set(label.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in jaccard.cluster(docs_of(spark, rows)).collect()} == label


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, least = int(rng.integers(5, 80)), int(rng.integers(2, 9))
        v = rng.integers(1, 1 << 38, n).astype(np.uint64) << np.uint64(24)
        ends = np.array(sorted({n - 1, *rng.integers(0, n, 3).tolist()}))
        v[ends] = 0
        want = set()
        for c in range(n):
            a = b = c
            while v[c] and a > 0 and v[a - 1] > v[c]:
                a -= 1
            while v[c] and b < n - 1 and v[b + 1] > v[c]:
                b += 1
            if v[c] and b - a + 1 >= least:
                want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, ends, least)), strict=True)) == want


def test_repeated_passages(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    shared = words("p", 60)
    edited = shared.replace("p30 ", "other ")
    rows = [(1, f"{words('a', 80)} {shared} {words('b', 40)}", "s"), (2, f"{words('c', 30)} {shared}", "s"), (3, f"{edited} {words('d', 90)}", "s"), (4, f"{words('e', 60)} {words('p', 40)} {words('f', 60)}", "s")]
    got = {(r.doc_id, r.other_id, r.start_word, r.end_word) for r in passages.find(docs_of(spark, rows)).collect()}
    assert (2, 1, 30, 90) in got and (3, 1, 0, 60) in got and not any(4 in g[:2] for g in got)
    left = {r.doc_id: r.text for r in passages.remove_repeats(docs_of(spark, rows)).collect()}
    assert left[1] == rows[0][1] and left[2].strip() == words("c", 30) and left[3] == words("d", 90) and left[4] == rows[3][1]


def test_toxicity_held_out(spark):
    rows = toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    mine = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert sum(p == t for p, t in mine) / len(mine) > 0.9
    assert toxicity.fit([], [], []).constant == 0.0 and toxicity.fit([b"a"], [1], [None]).constant == 1.0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = after
    items = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    texts = [r.text for r in docs.collect()]
    assert texts and len(set(texts)) == len(texts)
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
