"""Each operator against brute force, an exact round trip or held-out labels, and on awkward tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from glimmer.llm import bpe, chat_format, embedding_join, imatch, licenses, ngram_join, packing, quality, toxicity, url_filter, word_bpe
from glimmer.llm.common import connected_components, table

DOCS = "doc_id long, text string, score string, label int, component_id string, n long"
LONG = "lorem ipsum dolor sit amet consectetur " * 2000
ODD = [
    (1, None, "a", 1, "x", 1),
    (2, "", "a", 1, "x", 1),
    (3, "   \n\t ", "a", 1, "x", 1),
    (4, "One two three four five six seven eight nine ten.", "a", 1, "x", 1),
    (4, "One two three four five six seven eight nine ten.", "a", 1, "x", 1),
    (5, "ONE two three four five six seven eight nine ten.", None, None, None, None),
    (None, "Nobody owns this text but it stays.", "a", 1, "x", 1),
    (6, LONG, "a", 1, "x", 1),
    (7, LONG + "end", "a", 1, "x", 1),
    (8, "naïve café — Σας 日本語 \U0001f600 \x1c \u0085 don't", "a", 1, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def groups(links, nodes):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


# --- components ----------------------------------------------------------------------------------------------------
def test_components_are_those_of_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)] + [(500, 500 + i) for i in range(40)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    for one_task in (0, 1000):
        df = connected_components(spark.createDataFrame(edges + [(None, 3), (7, 7)], "u long, v long"), one_task=one_task)
        assert {r.id: r.component for r in df.collect()} == groups([e for e in edges if e[0] != e[1]], nodes)
        assert df.count() == len(nodes)


# --- 1 toxicity ----------------------------------------------------------------------------------------------------
def test_toxicity_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    from glimmer.llm.toxicity import op1_toxicity

    got = op1_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic.predicted.mean() > 0.5 and got[got.toxic == 0].predicted.mean() < 0.03
    assert got.score.between(0, 1).all()
    # no order of the two classes better than chance would pass this
    assert toxic.score.mean() > got[got.toxic == 0].score.mean() + 0.2


def test_the_risk_stays_sound_when_positives_hide_in_the_unlabelled():
    rng = np.random.default_rng(0)
    bad, plain = np.arange(10), np.arange(100, 400)
    doc = lambda toxic: np.unique(np.append(rng.choice(plain, 40), rng.choice(bad, 3) if toxic else [])).astype(int)
    model = toxicity.fit_nnpu([doc(True) for _ in range(80)], [doc(i % 5 == 0) for i in range(500)], 0.2)
    w = dict(zip(model.features.tolist(), model.weights))
    score = lambda d: model.intercept + sum(w.get(x, 0) for x in d.tolist())
    assert min(np.mean([score(doc(True)) > 0 for _ in range(100)]), np.mean([score(doc(False)) <= 0 for _ in range(100)])) > 0.95


def test_toxicity_on_awkward_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    never = F.lit(False)
    for docs, y in ((odd, labels), (odd, labels.limit(0)), (nothing, labels), (nothing, labels.limit(0))):
        model = toxicity.train_toxicity(docs.select("doc_id", "text"), y, never)
        got = toxicity.score_toxicity(docs, model).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all() and set(docs.columns) <= set(got.columns)


# --- 2 n-gram join -------------------------------------------------------------------------------------------------
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def similar(sets):
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = Counter((a, b) for v in where.values() for a in v for b in v if a < b)
    return [(a, b) for (a, b), o in shared.items() if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o)]


@pytest.mark.parametrize("hot,members", [(128, 4_000_000), (3, 4_000_000), (128, 300), (3, 300)])
def test_ngram_join_equals_brute_force(spark, docs, hot, members):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    words = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(words) for _ in range(60))
    for k in range(12):  # families of drifting copies, passages that many share, and copies
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for m in range(6):
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((10_000 + 100 * k + m, " ".join(base) + (" " + common if k % 3 == 0 else "")))
        rows.append((20_000 + k, " ".join(base)))
    got = {r.doc_id: r for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_run=hot, group_members=members).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = groups(similar(sets), sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_hot_columns_settle_in_blocks(spark, monkeypatch):
    """Chains of which only neighbours link, two families and strangers under one common passage, in blocks of three."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for family in range(2):
        text = [rng.choice(words) for _ in range(30)] + passage
        for _ in range(40):
            text[rng.randrange(30)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    for _ in range(30):
        rows.append((len(rows), " ".join(passage + [rng.choice(words) for _ in range(rng.choice([3, 14, 17, 18, 60]))])))
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    want = groups(similar(sets), sets)
    assert 3 < len(set(want.values())) < 100
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_run=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_that_share_a_doc_id_keep_every_link(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a + " x"), (5, b), (9, b + " y"), (9, b + " y"), (12, ""), (12, b + " z"), (14, "alone")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (9, 1), (9, 1), (12, 1), (12, 1), (14, 14)]


def test_large_families_leave_a_forest(spark):
    """Pairs that leave the hot columns follow the rows, not their square."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    made = {}
    for n in (200, 400):
        rows = [(i, " ".join(w if rng.random() > 0.01 else f"r{rng.random()}" for w in base)) for i in range(n)]
        df = spark.createDataFrame([(1, 5, 0, 0, i, i, ngram_join.shingle_hashes(t).tobytes()) for i, t in rows], "kind int, key long, part long, role int, node long, label long, members binary")
        made[n] = df.coalesce(1).mapInPandas(ngram_join.block_links(75), "u long, v long").count()
    assert made[200] < 200 and made[400] < 400


def test_ngram_join_on_awkward_tables(odd, nothing):
    got = [tuple(r) for r in ngram_join.jaccard_components(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 6, 4), (4, 6, 4), (5, 6, 4), (None, 3, None), (6, 6, 6), (7, 7, 6), (8, len(shingles(ODD[-1][1])), 8)], key=str)
    assert ngram_join.jaccard_components(nothing).count() == 0


# --- 3 url filter --------------------------------------------------------------------------------------------------
def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_url_rules_equal_brute_force(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url").collect()
    urls = [r.url for r in pages] + [None, "", "nohost", "http://", "http://COM/", "http://notexample.com/en/x", "http://example.com/en", "http://WWW.Example.com/en/?q", "ftp://a.net/fr/#x", "x://net/es/", "http://com?x=/", "a://b://c/d", "http://www.example.com/en/\nx"]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    seen = {r.page_id: r for r in got.collect()}
    for i, u in rows:
        host, path, rule, verdict = judged(u)
        assert (seen[i].host, seen[i].path, seen[i].rule) == (host, path, rule), u
        assert seen[i].verdict == verdict if verdict else seen[i].verdict in ("allow", "block")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(1)
    rows = [([t for t in "abcd" if rng.random() < 0.5], rng.choice(["allow", "block"])) for _ in range(300)] + [(["x", "y"], "block")] * 40 + [(["x"], "allow")] * 40
    df = spark.createDataFrame([(t, v == "block", i) for i, (t, v) in enumerate(rows)], "tokens array<string>, blocked boolean, order_hash long")
    mined = {r.tokens: r for r in url_filter.mine_rules(df, 0.05, 0.9)}
    assert set(mined) == {frozenset("y")}
    assert mined[frozenset("y")].confidence == 1.0 and abs(mined[frozenset("y")].support - 40 / 380) < 1e-9


def test_rules_are_mined_from_all_tokens_of_a_long_url(spark):
    rows = [([f"p=r{i}x{k}" for k in range(40)] + ["p=late"] * (i % 2), bool(i % 2), i) for i in range(60)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean, order_hash long")
    assert [set(r.tokens) for r in url_filter.mine_rules(labelled, min_support=0.1)] == [{"p=late"}]


def test_undecided_urls_are_judged_by_counting(spark):
    """Every combination of tokens, counted by brute force; undecided urls count against a rule."""
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['net', 'org', 'example.com'])}/{rng.choice(['es'] * 9 + ['fr', 'de', 'en', 'en', 'x/es', 'x/en'])}/{rng.choice(['one', 'two'])}" for _ in range(800)]
    rows = [*enumerate(urls)] + [(900, None), (901, "nothing"), (902, "http://" + "a/" * 5000), (902, "http://z.net/es/" + "q/" * 3000)]
    df = spark.createDataFrame([(i, u, "mine", "mine", 1) for i, u in rows], "page_id long, url string, verdict string, rule string, blocked int")
    got = {r.page_id: r for r in url_filter.filter_urls(df.where("page_id < 902"), min_support=0.01, min_confidence=0.8).collect()}
    host_path = url_filter.with_host_and_path(df.where("page_id < 902").select("page_id", "url"))
    tokens = {r.page_id: frozenset(r.t) for r in host_path.select("page_id", url_filter.url_tokens(F.col("host"), F.col("path")).alias("t")).collect()}
    given = {i: judged(u)[3] for i, u in rows if i < 902}
    counted = Counter(c for i, ts in tokens.items() for k in range(1, len(ts) + 1) for c in map(frozenset, combinations(sorted(ts), k)))
    bad = Counter(c for i, ts in tokens.items() if given[i] == "block" for k in range(1, len(ts) + 1) for c in map(frozenset, combinations(sorted(ts), k)))
    share = sum(v == "block" for v in given.values()) / len(given)
    rules = [c for c, n in counted.items() if bad[c] / len(given) >= 0.01 and bad[c] / n >= max(0.8, 1.5 * share)]
    assert rules and not any(c in rules for c in (frozenset(["h0=net"]), frozenset(["p=es"])))
    held = {i: any(c <= ts for c in rules) for i, ts in tokens.items()}
    for i, v in given.items():
        assert got[i].verdict == (v or ("block" if held[i] else "allow")) and got[i].mined == (v is None and held[i])
    assert any(r.mined for r in got.values()) and url_filter.filter_urls(df).count() == len(rows)


# --- 4 I-Match -----------------------------------------------------------------------------------------------------
def imatch_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return imatch.op4_imatch(spark, str(tmp_path)).toPandas()


def test_imatch_edits_fingerprints_and_likeness(spark, docs, tmp_path):
    got = imatch_rows(spark, docs, tmp_path).set_index("doc_id")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        m = len(t) // 3
        edited = t[: len(t) - m] + rows[(k + 1) % len(rows)][1][:m]
        assert got.loc[i].n_chars == len(t) and got.loc[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(got.loc[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert (got.near_edited > got.near_next).mean() > 0.9


def test_imatch_on_awkward_tables(spark, odd, nothing, tmp_path):
    got = imatch_rows(spark, odd, tmp_path / "a")
    assert len(got) == len(ODD) and got[got.doc_id == 2].n_chars.item() == 0
    assert got[got.doc_id == 4].fingerprint.nunique() == 1
    assert len(imatch_rows(spark, nothing, tmp_path / "b")) == 0
    one = imatch_rows(spark, spark.createDataFrame([(1, "abc")], "doc_id long, text string"), tmp_path / "c")
    assert one.edited_sha256.item() == hashlib.sha256(b"aba").hexdigest() and one.near_next.item() == 1.0


# --- 5 embeddings --------------------------------------------------------------------------------------------------
def test_embedding_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.25 for c in centres] + [np.repeat(centres[:1], 30, 0), 3 * centres[1:2]])
    rows = [(i * 3 + 1, [float(e) for e in v]) for i, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [1.0, None] * 8), (9006, [1.0, 2.0]), (9007, [1e300] * 16), (9008, [1e-300] * 16)]
    got = {r.vec_id: r for r in embedding_join.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32, fan=3).collect()}
    unit = {}
    for i, v in rows:
        if v and len(v) == 16 and all(e is not None and np.isfinite(e) for e in v) and any(v):
            a = np.array(v) / max(map(abs, v))
            unit[i] = a / np.linalg.norm(a)
    ids = list(unit)
    m = np.array([unit[i] for i in ids])
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    want = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit))], [i for i, _ in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: got[i].n_links for i in ids} == {i: int(hit[k].sum()) for k, i in enumerate(ids)}
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006))


def test_embedding_join_on_an_empty_table(spark):
    assert embedding_join.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, n_links string")).count() == 0
    one = embedding_join.embedding_components(spark.createDataFrame([(None, [1.0]), (5, [1.0]), (5, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), str(r.component_id), r.kept) for r in one) == [("5", "5", True), ("5", "5", True), ("None", "None", False)]


# --- 6 licenses ----------------------------------------------------------------------------------------------------
def test_license_notices_are_found_and_clean_texts_left(spark, docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    notices = {v: k for k, v in licenses.TEMPLATES.items()}
    for r in docs.collect():
        have = {k for v, k in notices.items() if v in (r.text or "")}
        assert got[r.doc_id].license in have if have else got[r.doc_id].license is None


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(50):
        t = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))]
        x = [w for w in t if rng.random() < 0.8] + [rng.choice("xyz") for _ in range(5)]
        pairs = licenses.align(x, t)
        assert all(x[i] == t[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    unique = list("abcdefghij")
    assert len(licenses.align(list("zzabcxdefyghij"), unique)) == 10
    edited = licenses.TEMPLATES["MIT-text"].replace("free of charge", "at no cost")
    assert licenses.scan_text("Words before. " + edited + " and after", {"MIT-text": licenses.words_of(licenses.TEMPLATES["MIT-text"])})[1] > 0.9


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"])
def test_a_notice_that_stands_twice_is_found(name):
    parsed = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    notice = licenses.TEMPLATES[name]
    for between in ("\n", "\nsome other words here\n"):
        found = licenses.scan_text(f"Words stand before it.\n{notice}{between}{notice}\nAnd words stand after it.", parsed)
        assert found[:2] == (name, 1.0) and found[3] - found[2] == len(parsed[name])


def test_a_notice_is_found_without_the_rarest_word():
    parsed = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    edited = "This work is licensed under the GNU General Public License, v3."
    for stray in ("3", "version 3", "3 version the work is"):
        for text in (f"{edited} {'filler ' * 40}{stray}", f"{stray} {'filler ' * 40}{edited}"):
            assert licenses.scan_text(text, parsed)[:2] == ("GPL-3.0", 10 / 12)


def test_license_coverage_is_that_of_the_longest_run():
    rng = random.Random(9)
    for _ in range(300):
        t = [rng.choice("abcdef") for _ in range(rng.randint(1, 8))]
        x = [rng.choice("abcdefxyz") for _ in range(rng.randint(1, 40))]
        slack = rng.randint(0, 3)
        best = {}  # (text position, template position): words of the longest run that ends there
        for i, w in enumerate(x):
            for j, v in enumerate(t):
                if v == w:
                    best[i, j] = 1 + max((n for (a, b), n in best.items() if b < j and 0 < i - a <= slack + 1), default=0)
        want = max(best.values(), default=0) / len(t)
        got = licenses.scan_text(" ".join(x), {"t": t}, slack)[1]
        assert got == want if want >= 0.8 else got <= want


def test_alignment_ends_where_it_can_no_longer_win(monkeypatch):
    rng = random.Random(12)
    for _ in range(60):
        t = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        x = [w if rng.random() < 0.7 else rng.randint(1, max(t)) for w in t for _ in range(rng.choice((0, 1, 1, 2)))]
        full = licenses.align(x, t)
        for wide in (0, 10**9):  # anchors by numpy and by the places of the template
            monkeypatch.setattr(licenses, "_WIDE", wide)
            for beat in range(len(t) + 2):
                assert licenses.align(x, t, np.array(x, np.int64), np.array(t), beat=beat) == (full if len(full) >= beat else [])
    calls = []
    monkeypatch.setattr(licenses, "increasing", lambda pairs, f=licenses.increasing: calls.append(1) or f(pairs))
    prose = (
        "You may use the work free of charge, and any person may copy it without limitation, so the river is free to all. In no event is it held, and this is the work of all "
        "who do it, or who publish it, with the rights that they have under the sun. Redistribution is permitted in any form, provided that the notice and the conditions of "
        "this license are in all copies of the software."
    )
    found = licenses.Scanner({k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}, whole_under=10)(prose)
    assert found[0][:2] == ("Apache-2.0", 2 / 7) and not found[1] and len(calls) < 60  # 120 with every alignment to its end


def test_every_license_of_a_text_is_found(spark):
    parsed = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    for name, text in licenses.TEMPLATES.items():
        assert licenses.scan_text(f"Some words before. {text} Some words after.", parsed)[:2] == (name, 1.0)
    texts = [licenses.TEMPLATES["MIT"] + " filler" * 30 + " " + licenses.TEMPLATES["Apache-2.0-text"], licenses.TEMPLATES["ISC-text"], "no license at all"]
    got = [[x.license for x in r.licenses] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0][0] == "Apache-2.0-text" and "MIT" in got[0] and got[1:] == [["ISC-text"], []]
    # a tie goes to the longer template, whatever the names
    assert licenses.scan_text("a b c d", {"x": ["a", "b"], "y": ["a", "b", "c"]})[0] == "y"
    assert licenses.scan_text("a b c d", {"x": ["a", "b", "c"], "y": ["a", "b"]})[0] == "x"


def test_license_scan_on_awkward_tables(odd, nothing):
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(nothing).count() == 0
    assert {r.license for r in licenses.scan_licenses(odd).collect()} == {None}


def test_short_notices_need_every_word(spark):
    prose = "They were released under the bridge, the license of the river was old."
    scan = licenses.Scanner({k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}, whole_under=10)
    assert scan(prose)[1] == []
    assert scan("so " * 30 + "Released under the MIT License. " + "so " * 30)[1][0][0] == "MIT"
    mit = licenses.TEMPLATES["MIT-text"].split()
    far = "word " * 300 + mit[7] + " word" * 300
    edited = " ".join("odd" if k == 11 else w for k, w in enumerate(mit))
    for text in (edited, edited + " " + far, far + " " + edited, edited + " " + far + " " + edited):
        best = scan(text)[1][0]
        assert best[0].startswith("MIT") and best[1] > 0.9


# --- 7 quality -----------------------------------------------------------------------------------------------------
def test_quality_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("quality", "label"), "doc_id").toPandas()
    assert got[got.label == 1].kept.mean() > 0.98 and got[got.label == 0].kept.mean() < 0.2


def test_em_recovers_labeller_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((4000, 4)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    votes[rng.random((4000, 4)) < 0.2] = 0
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(rows, counts.astype(float))
    assert abs(model.prior - y.mean()) < 0.05
    good = model.likelihood[1][:, 2] / (model.likelihood[1][:, 0] + model.likelihood[1][:, 2])
    assert np.abs(good - right).max() < 0.06


def test_quality_on_awkward_tables(odd, nothing):
    got = quality.score_quality(odd, quality.train_quality(odd.select("doc_id", "text")))
    assert got.count() == len(ODD) and set(odd.columns) <= set(got.columns)
    assert quality.score_quality(nothing, quality.train_quality(nothing.select("doc_id", "text"))).count() == 0


# --- 8 chats -------------------------------------------------------------------------------------------------------
def test_chats_read_back_exactly(spark):
    t = chat_format.ChatTemplate()
    rng = random.Random(8)
    bits = [*t.controls(), "\\", "\\\\", "<", "|", "$1", "\n", "é", "\U0001f600", "a", "[\\INST]", "<\\|end|>"]
    said = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(c, k, rng.choice(["system", "user", "assistant", "tool<|is|>", None]), rng.choice([said(), said(), None])) for c in range(40) for k in range(rng.randint(1, 6))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df, t), t).collect()}
    for c in range(40):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(x.role, x.text) for x in got[c].turns] == want
        assert got[c].learned == "".join(x for role, x in want if role == "assistant")
        state, ok = "start", True
        for role, _ in want:
            ok &= role in t.moves.get(state, ())
            state = role
        assert got[c].valid == ok
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_query_digests(spark, sf_dir):
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, sf_dir).collect()}
    convs = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- 9 byte-level BPE ----------------------------------------------------------------------------------------------
def test_bpe_equals_tiktoken(spark, odd, docs, nothing):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd.unionByName(docs.limit(40), allowMissingColumns=True)
    special = [(900, "a\u00a0\u2003b\u3000 \u0085c  d\u200be"), (901, "x" * 3000), (902, "!!??" * 200 + "\n\n \t"), (903, "It's we'll I'D １２３ ⅷ"), (904, "q\x1c\x1f z\u180e"), (905, "".join(random.Random(3).choice("abcdeé漢") for _ in range(5000))), (906, "zqx" * 341 + "z"), (907, "a" * 1025)]
    rows = rows.unionByName(spark.createDataFrame(special, "doc_id long, text string"), allowMissingColumns=True)
    for most_words in (200_000, 3):
        codec = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN, most_words)
        if most_words == 3:
            codec.learn_words(rows, most_words=50)
            assert len(codec.known) == 50
        got = codec.decode(codec.encode(rows, decoded="same")).collect()
        assert len(got) == rows.count() and set(rows.columns) < set(got[0].asDict())
        for r in got:
            assert r.same == r.decoded
            want = library.encode_ordinary(r.text or "")
            assert r.ids == ",".join(map(str, want)) and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
    assert codec.decode(codec.encode(nothing)).count() == 0
    clash = spark.createDataFrame([(1, "some text", 7, "x")], "doc_id long, text string, ids long, decoded string")
    assert codec.decode(codec.encode(clash)).first().ids == ",".join(map(str, library.encode_ordinary("some text")))


def test_heap_and_fold_join_alike(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinsrhlé漢字xyz") for _ in range(rng.randint(2, 40))) for _ in range(500)]
    arrays = bpe.byte_array([w.encode() for w in words], *codec.byte_rows).to_pylist()
    df = spark.createDataFrame([*zip(arrays, words)], "word array<long>, w string")
    for r in df.select("w", bpe.let(codec.rank_map, lambda m: codec.fold(F.col("word"), m)).alias("ids")).collect():
        want = library._encode_single_piece(r.w)
        if r.w.encode() not in ranks:
            assert [int(x) for x in r.ids.split(",")] == want == bpe.heap_fold(r.w.encode(), codec.byte_ids, codec.pairs)


def test_bpe_looks_up_a_pair_in_one_place_and_writes_a_word_once(spark, monkeypatch):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(7)
    words = sorted({w for w in ("".join(rng.choice("etaoinsrhlé漢字xyz") for _ in range(rng.randint(2, 30))) for _ in range(300)) if w.encode() not in ranks})
    want = [library._encode_single_piece(w) for w in words]
    df = spark.createDataFrame([*zip(words, bpe.byte_array([w.encode() for w in words], *codec.byte_rows).to_pylist())], "w string, word array<long>")
    folded = df.select("w", bpe.let(codec.rank_map, lambda m: codec.folded(F.col("word"), m)).alias("tokens"))
    # functions of arrays are interpreted: a step's two pairs share one lookup
    plan = folded._jdf.queryExecution().analyzed().toString()
    assert plan.count(".entries") == plan.count(".shifts") == 1
    tokens = {r.w: r.tokens for r in folded.collect()}
    texts, sizes, decoded = bpe._named(pa.array([tokens[w] for w in words], pa.list_(pa.int64())), *codec._written({})[1:])
    assert texts.to_pylist() == [",".join(map(str, x)) for x in want]
    assert sizes.to_pylist() == [len(x) for x in want] and decoded.to_pylist() == [w.encode() for w in words]
    # batches and generations that end between any two documents
    monkeypatch.setattr(bpe, "_CHUNK", 64)
    said = lambda: " ".join(rng.choice([*words, "the", "\n\n", "x" * 1500]) for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice([said(), said(), said(), "", None])) for i in range(200)]
    for most_words in (5, 250_000):
        codec.most_words = most_words
        got = {r.doc_id: r for r in codec.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), decoded="decoded").collect()}
        for i, text in rows:
            ids = library.encode_ordinary(text or "")
            assert (got[i].ids, got[i].n_tokens, bytes(got[i].decoded)) == (",".join(map(str, ids)), len(ids), (text or "").encode())


def test_first_joins_are_those_of_the_fold():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(8)
    words = [b"", *("".join(rng.choice("aeetoinsrhlé漢xyz") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)), b"a" * 1024, b""]
    pieces = codec._written({})[-1]
    sizes = []
    for joins in (0, 1, 2, 3, 2000):
        rows = bpe.byte_array(words, *codec.byte_rows, joins=joins).to_pylist()
        sizes.append(sum(map(len, rows)))
        for word, row in zip(words, rows):
            ids = [x & (1 << bpe._ID_BITS) - 1 for x in row]
            assert ids[0] == ids[-1] == codec.edge and b"".join(pieces[i].as_py() for i in ids[1:-1]) == word
            assert [x >> bpe._LOW for x in row] == [codec.pairs.get(i, {}).get(j, bpe._NONE) for i, j in zip(ids, [*ids[1:], codec.edge])]
            assert joins < 2000 or word in ranks or ids[1:-1] == (library._encode_single_piece(word) if word else [])
    # without the first joins a fold had a step for every byte
    assert sizes == sorted(sizes, reverse=True) and sum(map(len, bpe.byte_array(words, *codec.byte_rows).to_pylist())) == sizes[bpe.FIRST_JOINS] < sizes[0]
    assert len(bpe.byte_array([], *codec.byte_rows)) == 0


# --- 10 packing ----------------------------------------------------------------------------------------------------
def test_tokens_equal_the_library_and_packing_is_sound(spark, odd, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    marks = spark.createDataFrame([(90, "a <|endoftext|> b"), (91, "x<|startoftext|><|endoftext|>y <|END"), (92, "<|endoftext|>")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(marks).unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = packing.pack_pieces(packing.token_pieces(rows, path)).toPandas()
    for r in rows.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("piece")
        assert mine.length.tolist() == [min(2048, len(ids) - s) for s in range(0, len(ids), 2048)] and mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == np.append(0, seq.length.cumsum()[:-1]).tolist() and seq.length.sum() <= 2048
    bound = packing.lower_bound(got.length.to_numpy(np.int64), 2048)
    assert bound <= got.sequence_id.nunique() <= bound + 2
    assert packing.pack_pieces(packing.token_pieces(nothing, path)).count() == 0
    assert packing.pack_pieces(packing.token_pieces(odd, path)).count() >= len(ODD)


def test_partitions_with_gaps_pack_again(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.randint(1, 1400)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    alone = packing.pack_pieces(df, partition_pieces=100, rounds=0).select("sequence_id").distinct().count()
    again = packing.pack_pieces(df.withColumn("offset", F.lit("mine")), partition_pieces=100)
    gap = packing.packing_gap(again).first()
    assert gap.gap == gap.sequences - packing.lower_bound(np.array([r[2] for r in rows]), 2048) and gap.gap >= 0
    bins = again.select("sequence_id").distinct().count()
    assert packing.lower_bound(np.array([r[2] for r in rows]), 2048) <= bins <= alone
    assert again.count() == 2000 and again.groupBy("sequence_id").agg(F.sum("length").alias("s")).where("s > 2048").count() == 0


def test_tokenizer_numbers_words_and_merges_each_new_part_once():
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), most_words=4)
    asked = []
    encode = t.merger.encode
    t.merger.encode = lambda words: asked.append(words) or encode(words)
    texts = ["Alpha beta, alpha. Beta", "Alpha gamma!", "\u65e5\u672c alpha don't", None, "delta Alpha epsilon zeta eta", "Alpha \u65e5\u672c delta"]
    got = [*t.encode_batch(texts)]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) and b"alpha" in asked[0]
    assert len(t.ids) == len(t.numbers) == len({w for x in texts for w in (x or "").split()})
    got += t.encode_batch(texts)  # all words are met again in the older generation
    assert len(asked) == 1 and t.older[0]
    got += t.encode_batch(texts, most_chars=1)  # words come and go
    assert len(asked) > 1 and len(t.older[0]) <= 4 + 5
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts * 3]


def test_ids_of_words_lie_in_one_array():
    rng = random.Random(21)
    rows = [[rng.randint(0, 2**32 - 1) for _ in range(rng.randint(0, 4))] for _ in range(40)]
    held = word_bpe.IdRows.of([np.array(x, "<u4") for x in rows[:25]]) + word_bpe.IdRows.of([np.array(x, "<u4") for x in rows[25:]])
    at = [rng.randrange(40) for _ in range(100)]
    taken = held.take(np.array(at))
    written = [np.array(rows[k], "<u4").tobytes() for k in at]
    assert len(held) == 40 and taken.bytes() == written and held.take(np.zeros(0, np.int64)).bytes() == []
    assert taken.joined(np.array([0, 60, 1, 0, 39, 0])).bytes() == [b"", b"".join(written[:60]), written[60], b"", b"".join(written[61:]), b""]

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), most_words=3)
    ranked = []
    rank = t.merger._rank
    t.merger._rank = lambda a, b: ranked.append(len(a)) or rank(a, b)
    texts = ["", " ", None, "it", "The \u65e5\u672c<|endoftext|> it", "They're no. 12 (or so), he'd said: \u00bd caf\u00e9.%%% \u65e5\u672c! \u0130x", "so it said <|END", "Caf\u00e9"]
    for _ in range(3):
        for size in (1, 30, 4_000_000):
            assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_batch(texts, most_chars=size)] == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    ranked.clear()
    assert len(t.merger.encode([b"qq", b"q"])) == 2 and not ranked  # pairs of bytes have a table of their own


def test_bounds_never_pass_the_best_packing():
    rng = random.Random(7)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 9))])
        best = len(sizes)

        def place(k, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if k == len(sizes):
                best = len(loads)
                return
            for i in range(len(loads)):
                if loads[i] + sizes[k] <= 20:
                    place(k + 1, loads[:i] + [loads[i] + sizes[k]] + loads[i + 1 :])
            place(k + 1, loads + [sizes[k]])

        place(0, [])
        assert packing.lower_bound(sizes, 20) <= best <= packing.best_fit_decreasing(sizes, 20)[2]
